"""Terms of a text as UTF-8 bytes: runs of digits, letters a-z and characters beyond ASCII, only A-Z lower-cased."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Every byte of a text as it stands in a term; all separators are a space. Bytes from 0x80 on belong to longer characters.
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
#: Bytes split at a time, so that a very long text never becomes one list of its terms.
_SLICE = 1 << 20


def term_slices(raw: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size; none for null."""
    clean = (raw or b"").translate(_BYTES)
    start = 0
    while start < len(clean):
        stop = clean.find(b" ", start + _SLICE)
        stop = len(clean) if stop < 0 else stop
        yield clean[start:stop].split()
        start = stop


def collapsed(raw: bytes | None) -> bytes:
    """The terms with one space between them."""
    return b" ".join(part for part in (b" ".join(terms) for terms in term_slices(raw)) if part)
