"""Words of a text: folded, split, abbreviations grown, compounds taken apart.

words(col) is made of column expressions (no Python in the workers); tokenize(text) is the same on the driver, for queries. A token
has word, grp (ordinal of the written word; both readings share it), part (piece of a compound) and joint (what stood before the word: none,
`-`, `/` or `.` for anything else).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import fold

# Abbreviations of whole words, of compounds' ends, and the ends that compounds are split at; words and folded bytes that a text has at most.
ABBREVIATIONS = {"str": "strasse", "st": "sankt", "pl": "platz"}
TAILS = {"str": "strasse", "pl": "platz"}
COMPOUNDS = ("strasse", "weg", "allee", "platz", "gasse", "ring", "damm", "ufer", "chaussee", "steig")
HEAD = 3
MOST_TOKENS, MOST_BYTES = 48, 1024

WORDS_TYPE = "array<struct<word:string,grp:int,part:boolean,joint:string>>"
_OTHER = "\u0001"  # stands for a separator that is neither blank, dash nor slash


class Token(NamedTuple):
    word: str
    grp: int
    part: bool
    joint: str


def _translate(col: Column, table: dict[str, str]) -> Column:
    one = {k: v for k, v in table.items() if len(v) == 1}
    col = F.translate(col, "".join(one), "".join(one.values()))
    for k, v in table.items():
        if len(v) > 1:
            col = F.replace(col, F.lit(k), F.lit(v))
    return col


def _separators() -> dict[str, str]:
    out = {c: " " for c in fold.BLANKS} | {c: "-" for c in fold.DASHES}
    for o in [*range(1, 0x80), *(x for low, high in fold.PARTING for x in range(low, high + 1))]:
        c = chr(o)
        if c not in out and c != "/" and fold.parts(c):
            out[c] = _OTHER
    return out


def folded(col: Column, german: bool = True) -> Column:
    """The text with each word folded; separators come as a blank, `-`, `/` or one other mark."""
    apart = _separators()
    umlauts = fold.GERMAN if german else fold.PLAIN
    out = F.regexp_replace(col, "([aouAOU])\u0308", F.concat(F.lit("$1"), F.lit("e" if german else "")))
    out = F.regexp_replace(out, "[\u0300-\u036f]", "")
    out = _translate(out, {k.upper(): k for k in umlauts})
    for k, v in umlauts.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    out = _translate(out, fold.letters() | apart)
    # Most texts are ASCII, which needs one pass.
    plain = _translate(F.lower(col), {k: v for k, v in apart.items() if ord(k) < 0x80})
    return F.when(F.length(col) == F.octet_length(col), plain).otherwise(out)


def special(col: Column) -> Column:
    """Whether the text has a letter with two readings."""
    return col.rlike("[äöüÄÖÜ]|[aouAOU]̈")


def grown(word: Column) -> Column:
    """The word an abbreviation stands for."""
    out = word
    for short, full in TAILS.items():
        ends = F.endswith(word, F.lit(short)) & (F.octet_length(word) >= HEAD + len(short))
        out = F.when(ends, F.concat(F.regexp_replace(word, f"{short}$", ""), F.lit(full))).otherwise(out)
    for short, full in ABBREVIATIONS.items():
        out = F.when(word == short, F.lit(full)).otherwise(out)
    return out


def pieces(word: Column) -> Column:
    """Head and tail of a compound, or an empty array."""
    out = F.array().cast("array<string>")
    for tail in reversed(COMPOUNDS):
        head = F.regexp_extract(word, f"^(.+){tail}$", 1)
        out = F.when(F.octet_length(head) >= HEAD, F.array(head, F.lit(tail))).otherwise(out)
    return out


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once: as the variable of a lambda, which is not computed anew where it stands."""
    return F.transform(F.array(value), use)[0]


def _reading(col: Column, german: bool) -> Column:
    mark = f" /{_OTHER}-"
    written = F.regexp_extract_all(folded(col, german), F.lit(f"[{mark}]*[^{mark}]+"), F.lit(0))

    def cut(x: Column, i: Column) -> Column:
        gap = F.replace(F.regexp_extract(x, f"^[{mark}]*", 0), F.lit(" "), F.lit(""))
        return F.struct(i.cast("int").alias("i"), gap.alias("gap"), F.regexp_extract(x, f"[^{mark}]+$", 0).alias("word"))

    def named(x: Column) -> Column:
        joint = F.when(x["gap"].isin("", "-", "/"), x["gap"]).otherwise(".")
        return F.struct(x["i"].alias("i"), joint.alias("joint"), grown(x["word"]).alias("word"))

    def token(x: Column) -> Column:
        one = lambda w, part: F.struct(w.alias("word"), x["i"].alias("grp"), F.lit(part).alias("part"), x["joint"].alias("joint"))
        return F.concat(F.array(one(x["word"], False)), F.transform(pieces(x["word"]), lambda w: one(w, True)))

    return F.flatten(F.transform(F.transform(F.transform(written, cut), named), token))


def words(col: Column) -> Column:
    """WORDS_TYPE: tokens of the German reading, then of the plain one where they differ; a word counts once, MOST_TOKENS at most."""
    col = F.coalesce(col, F.lit(""))
    both = F.concat(_reading(col, True), F.when(special(col), _reading(col, False)).otherwise(F.array().cast(WORDS_TYPE)))

    def first(tokens: Column) -> Column:
        return _once(F.transform(tokens, lambda y: y["word"]), lambda ws: F.filter(tokens, lambda x, i: F.array_position(ws, x["word"]) == i + 1))

    return _once(both, lambda x: F.slice(first(x), 1, F.when(F.octet_length(col) > MOST_BYTES, _fitting(first(x))).otherwise(MOST_TOKENS)))


def _fitting(tokens: Column) -> Column:
    """How many of the tokens stand before the cap on words, or before the word that oversteps the cap on bytes."""

    def step(acc: Column, t: Column) -> Column:
        used = acc["used"] + F.when(t["part"], 0).otherwise(F.octet_length(t["word"]))
        over = acc["over"] | (used > MOST_BYTES)
        return F.struct(used.alias("used"), (acc["n"] + F.when(over, 0).otherwise(1)).alias("n"), over.alias("over"))

    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("over"))
    return F.least(F.aggregate(tokens, start, step, lambda acc: acc["n"]), F.lit(MOST_TOKENS))


def dropped(col: Column) -> Column:
    """How many words of a text the caps leave out."""
    text = F.coalesce(col, F.lit(""))
    every = F.concat(_reading(text, True), F.when(special(text), _reading(text, False)).otherwise(F.array().cast(WORDS_TYPE)))
    return F.size(F.array_distinct(F.transform(every, lambda x: x["word"]))) - F.size(words(col))


def distinct_words(col: Column) -> Column:
    return F.transform(words(col), lambda x: x["word"])


# The same on the driver.


def _folded_words(text: str, german: bool):
    """(word, joint) of the written words."""
    table, out, word, joint, before, base = fold.letters(), [], "", "", "", ""
    umlauts = fold.GERMAN if german else fold.PLAIN
    for c in text:
        o = ord(c)
        if fold.MARKS[0] <= o <= fold.MARKS[1]:
            if o == 0x308 and base in ("a", "o", "u") and german:
                word += "e"
            base = ""
            continue
        if o == 0 or fold.parts(c):
            if word:
                out.append((word, before))
                word, joint = "", ""
            if c not in fold.BLANKS:
                mark = "-" if c in fold.DASHES else "/" if c == "/" else "."
                joint = mark if not joint else "."
            base = ""
            continue
        if not word:
            before = joint
        got = umlauts[c.lower()] if c.lower() in umlauts else table.get(c, c)
        word += got
        base = got if len(got) == 1 else ""
    if word:
        out.append((word, before))
    return out


def grown_word(word: str) -> str:
    if word in ABBREVIATIONS:
        return ABBREVIATIONS[word]
    for short, full in TAILS.items():
        if word.endswith(short) and len(word.encode()) >= len(short) + HEAD:
            return word[: -len(short)] + full
    return word


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    seen: set[str] = set()
    used = 0

    def add(word, grp, part, joint):
        nonlocal used
        if not word or word in seen:
            return
        seen.add(word)
        used += 0 if part else len(word.encode())
        if len(out) < MOST_TOKENS and used <= MOST_BYTES:
            out.append(Token(word, grp, part, joint))

    twice = any(c in "äöüÄÖÜ" for c in text) or any(text[i] in "aouAOU" and text[i + 1] == "̈" for i in range(len(text) - 1))
    for german in (True, False)[: 1 + twice]:
        for grp, (w, joint) in enumerate(_folded_words(text, german)):
            w = grown_word(w)
            add(w, grp, False, joint)
            for tail in COMPOUNDS:
                if w.endswith(tail) and len(w.encode()) >= len(tail) + HEAD:
                    add(w[: -len(tail)], grp, True, joint)
                    add(tail, grp, True, joint)
                    break
    return out


def written_form(word: str) -> str | None:
    """The abbreviation of a whole word, if there is one."""
    return next((k for k, v in ABBREVIATIONS.items() if v == word), None)


def loose(col: Column) -> Column:
    """For comparing texts: lower case without marks, runs of anything else as one blank."""
    table = {k: v for k, v in fold.letters().items() if ord(k) < 0x180} | fold.PLAIN | {k.upper(): v for k, v in fold.PLAIN.items()}
    return F.trim(F.regexp_replace(_translate(F.coalesce(col, F.lit("")), table), "[^a-z0-9]+", " "))
