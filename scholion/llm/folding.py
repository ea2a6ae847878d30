"""Plain forms of names for comparison."""

from __future__ import annotations

import unicodedata

# Letters that Unicode does not decompose.
_PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h", "ŧ": "t", "’": "'", "‐": "-", "‑": "-"})


def plain(text: str) -> str:
    """Compatibility form, lower case, without accents."""
    folded = unicodedata.normalize("NFKD", text).lower().translate(_PLAIN)
    if folded.isascii():
        return folded
    return "".join(c for c in folded if not unicodedata.combining(c))
