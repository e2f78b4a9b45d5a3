"""Indian scripts: which texts are written in one, and their letters in Latin ones, as column expressions.

The nine blocks have one layout, so a letter's Latin form follows from its place in the block. Consonants are written
without an inherent vowel, as a character-by-character transliteration does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First code points of Devanagari, Bengali, Gurmukhi, Gujarati, Oriya, Tamil, Telugu, Kannada and Malayalam.
BLOCKS = [0x900 + 0x80 * k for k in range(9)]
#: Place in a block, and the Latin letters from there on.
PLACES = {
    0x01: "m m h", 0x05: "a a i i u u r l e e e ai o o o au", 0x15: "k kh g gh ng c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h",
    0x3E: "a i i u u r", 0x45: "e e e ai o o o au", 0x58: "k kh g z d dh f y", 0x66: "0 1 2 3 4 5 6 7 8 9",
}
#: Signs without a sound: nukta, avagraha, virama.
SILENT = [0x3C, 0x3D, 0x4D]


def _letters() -> dict[int, str]:
    return {start + i: latin for start, row in PLACES.items() for i, latin in enumerate(row.split())}


def indian(x) -> Column:
    """Some character is neither ASCII nor of the Latin blocks up to U+024F."""
    return (F.col(x) if isinstance(x, str) else x).rlike("[^\\x00-\\x7F\\u00C0-\\u024F]")


def latin(x) -> Column:
    """Letters and digits of the nine blocks in Latin ones; other characters stay. Texts without any pass through."""
    x = F.col(x) if isinstance(x, str) else x
    letters = _letters()
    single = {p: v for p, v in letters.items() if len(v) == 1}
    several = {p: v for p, v in letters.items() if len(v) > 1}
    first = BLOCKS[0]
    # letters of one Latin letter, and those of several into the first block; then these, one by one
    source = "".join(chr(b + p) for b in BLOCKS for p in single) + "".join(chr(b + p) for b in BLOCKS[1:] for p in several) + "".join(chr(b + p) for b in BLOCKS for p in SILENT)
    target = "".join(single.values()) * len(BLOCKS) + "".join(chr(first + p) for _ in BLOCKS[1:] for p in several)
    out = F.translate(x, source, target)
    for p, v in several.items():
        out = F.replace(out, F.lit(chr(first + p)), F.lit(v))
    return F.when(x.rlike("[\\u0900-\\u0D7F]"), out).otherwise(x)
