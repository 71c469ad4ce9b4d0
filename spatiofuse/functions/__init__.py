"""Column expressions and small table helpers shared by every operator."""
