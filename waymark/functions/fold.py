"""Folding tables: which letters a code point is written with on a plain keyboard, from Unicode names and a few fixed values."""

from __future__ import annotations

import re
import unicodedata

# Letters whose Unicode name doesn't spell the base letter.
NAMED = {
    "AE": "ae", "OE": "oe", "IJ": "ij", "HV": "hv", "HWAIR": "hv", "U BAR": "u", "DZ": "dz", "LJ": "lj", "NJ": "nj", "SHARP S": "ss",
    "ETH": "d", "THORN": "t", "ENG": "n", "KRA": "k", "LONG S": "s", "SCHWA": "e", "TONE SIX": "b", "TONE TWO": "s", "TONE FIVE": "z",
    "TURNED DELTA": "d", "DELTA": "d", "GAMMA": "g", "IOTA": "i", "LAMBDA": "l", "OI": "o", "YR": "r", "ESH": "s", "REVERSED ESH LOOP": "s",
    "UPSILON": "u", "EZH": "z", "EZH REVERSED": "z", "WYNN": "w", "YOGH": "g", "OU": "o", "DB DIGRAPH": "d", "QP DIGRAPH": "q",
    "TWO": "z", "INVERTED GLOTTAL STOP": "z", "MIDDLE-WELSH LL": "l", "MIDDLE-WELSH V": "v", "REVERSED OPEN E": "e",
}
# Readings of umlauts, compatibility ligatures, and two small letters outside the Latin blocks that follow.
GERMAN = {"ä": "ae", "ö": "oe", "ü": "ue"}
PLAIN = {"ä": "a", "ö": "o", "ü": "u"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
OTHERS = {"ⱥ": "a", "ⱦ": "t"}
# Blocks of Latin letters, and code points that part words (beside ASCII that isn't a letter or digit).
LATIN = ((0xC0, 0x24F), (0x1E00, 0x1EFF))
PARTING = ((0x80, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x1C0, 0x1C3), (0x241, 0x242), (0x2B0, 0x2FF), (0x2000, 0x206F), (0xFF00, 0xFF0F))
MARKS = (0x300, 0x36F)
BLANKS = " \t  "
DASHES = "-‐‑‒–—−"

_NAME = re.compile(r"LATIN (?:CAPITAL |SMALL )?(?:LETTER|LIGATURE) (.+?)(?: (?:WITH|PRECEDED) .*)?$")
_BASE = re.compile(r"(?:AFRICAN|OPEN|REVERSED|TURNED|DOTLESS|SMALL|CAPITAL) ")


def _latin(c: str) -> str | None:
    """The base letters of a Latin letter by its name."""
    name = unicodedata.name(c, "")
    if m := re.match(r"LATIN CAPITAL LETTER (DZ|LJ|NJ|D|L|N)(?: WITH SMALL LETTER ([ZJ]).*)", name):
        return (m[1][0] + m[2]).lower()
    if not (m := _NAME.match(name)):
        return None
    word = m[1]
    if word in NAMED:
        return NAMED[word]
    word = _BASE.sub("", word)
    return word.lower() if len(word) == 1 else NAMED.get(word)


_LETTERS: dict[str, str] = {}


def letters() -> dict[str, str]:
    """Code point to plain letters, but for umlauts."""
    if not _LETTERS:  # kept in a plain table, as functions that travel to workers can't carry a cache
        for low, high in LATIN:
            for c in map(chr, range(low, high + 1)):
                if c.lower() not in GERMAN and not parts(c) and (base := _latin(c)):
                    _LETTERS[c] = base
        _LETTERS.update({chr(c): chr(c + 32) for c in range(65, 91)} | LIGATURES | OTHERS)
        # Greek and Cyrillic capitals are lowered and kept.
        _LETTERS.update({chr(c): chr(c + 0x20) for c in (*range(0x391, 0x3AA), *range(0x410, 0x430))})
        _LETTERS.update({chr(c): chr(c + 0x50) for c in range(0x400, 0x410)})
    return _LETTERS


def parts(c: str) -> bool:
    """Whether a code point ends a word."""
    o = ord(c)
    return not c.isalnum() if o < 0x80 else any(low <= o <= high for low, high in PARTING)
