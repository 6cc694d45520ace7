"""Runs of ASCII letters, digits and non-ASCII characters, ASCII letters lowered.

This is the tokenisation that importance resampling and lexical search share: both their
patterns exclude the same bytes once A-Z are lowered, so one byte table serves both.
"""

from __future__ import annotations

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Letters lowered, every other excluded byte a space; bytes of non-ASCII characters stay.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in order; null has none."""
    return text.encode().translate(_TABLE).split() if text else []
