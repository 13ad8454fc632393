"""Text folding shared by the training-data operators.

``fold`` is the comparison form of a text: NFKC, lower case, letters and digits only.  Null is empty.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache


def _ranges(*majors: str) -> str:
    """A regular-expression class body of every code point in the given major categories."""
    out, start = [], None
    for c in range(0x110001):
        inside = c < 0x110000 and unicodedata.category(chr(c))[0] in majors
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@cache
def _patterns() -> tuple[re.Pattern[str], re.Pattern[str]]:
    junk = re.compile(f"[^{_ranges('L', 'N')}]+")
    # Characters for which dropping non-letters first and NFKC commute: no marks, no compatibility letters or digits.
    plain = re.compile("[\\x00-\\x7fÀ-ÖØ-öø-ÿ一-鿿、。《-】"
                       "“”‘’—，：；！？（）～]*")
    return junk, plain


def fold(text: str | None) -> str:
    """NFKC, lower case, then only letters and digits (classes L and N); null gives ''."""
    if not text:
        return ""
    junk, plain = _patterns()
    if plain.fullmatch(text):
        return junk.sub("", text).lower()
    return junk.sub("", unicodedata.normalize("NFKC", text).lower())


def trigrams(folded: str) -> set[str]:
    """The distinct runs of 3 successive characters."""
    return {folded[i:i + 3] for i in range(len(folded) - 2)}


def trigram_similarity(a: str, b: str) -> float:
    """Jaccard similarity of the trigram sets of two folded texts; 0 when both are shorter than 3."""
    x, y = trigrams(a), trigrams(b)
    union = len(x | y)
    return len(x & y) / union if union else 0.0
