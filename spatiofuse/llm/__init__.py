"""Training-data operators. Nothing outside this folder, ``corpus_pipeline.py`` and the entry file imports it."""
