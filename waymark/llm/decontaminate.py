"""Benchmark decontamination by template windows.

Tokens lose punctuation at their ends and are canonicalised: numbers, capitalised words (names) and units after a number
become typed placeholders, other words are lowered. Windows of WIDTH tokens (the whole item, if it is shorter) with
at least LITERAL tokens that are no placeholders are hashed; documents' windows are hash-joined with the items'. Windows with
fewer, and items of fewer than LEAST tokens, are hashed with the tokens themselves (lowered) in place of placeholders, so
they match exact copies only, and have no slots. Matched windows are aligned: those at one offset between document and item are a run, and so are
neighbouring offsets (up to SHIFT tokens were put in or left out). A run counts where its slots are consistent over the whole item: equal slot values of the
item stand for equal values in the document, and different for different; of an inconsistent run only windows with the item's own values
count. A document is contaminated by an item when what counts of one run covers at least
COVERED tokens of it, or all but EDGE of a shorter item. `reparameterised` tells that slots were filled with other values.

Before the join, a document's windows pass a bit table of fixed size (2**TABLE_BITS bits) of the items' hashes, so the
documents' share of the join is little more than what matches; what is shuffled are matches. A passage that many documents hold
costs each its own matches, grouped by document, item and offset, whose positions are at most the item's length.

Defined results: null or empty text, or item: no match. Repeated rows of one doc_id, or of null: as one document (`clean` tells rows by doc_id and text). No item: no rows. Items of
one token or more have windows; a short one is found wherever its words stand in a row. Texts of any length: windows are hashed in one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import Texts, bit_table, groups, mix, powers, small, span_hashes, staged, table, tidied

WIDTH, LITERAL, COVERED, EDGE, LEAST, SHIFT = 8, 4, 13, 2, 5, 3
TABLE_BITS = 26

# Words that are units after a number.
UNITS = "km m cm mm mi mile miles ft feet inch inches yard yards kg g mg lb lbs pound pounds ounce ounces oz ton tons liter liters litre litres l ml gallon gallons hour hours minute minutes second seconds day days week weeks month months year years percent degrees dollar dollars euro euros cents mph kmh"
_PLACE = mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
NUMBER, NAME, UNIT = (int(x) for x in _PLACE)
_EXACT = np.uint64(0x6A09E667F3BCC909)  # sets hashes of exact windows apart
_WORD = np.ones(256, dtype=bool)  # bytes that aren't stripped
_WORD[:128] = [chr(i).isalnum() for i in range(128)]
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _hash_of(word: str) -> int:
    b = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0])


def canonical(texts: Texts):
    """start, end, row, hash, whether a placeholder stands, and the hash of the token itself, of every token that has a letter or digit."""
    start, end, row = texts.tokens()
    solid = np.flatnonzero(_WORD[texts.data])
    if not len(solid) or not len(start):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(bool), none.astype(np.uint64)
    i = np.searchsorted(solid, start)
    j = np.searchsorted(solid, end) - 1
    keep = j >= i
    start, end, row = solid[i[keep]], solid[j[keep]] + 1, row[keep]
    h = span_hashes(texts.low, start, end)
    first, second = texts.data[start], texts.data[np.minimum(start + 1, len(texts.data) - 1)]
    number = _DIGIT[first]
    upper = (first >= 65) & (first <= 90)
    latin = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)  # capitals of Latin-1
    after = texts.data[np.minimum(start + 2, len(texts.data) - 1)]
    shout = np.where(latin, (after >= 65) & (after <= 90), (second >= 65) & (second <= 90))
    name = (upper & (end - start > 1) | latin & (end - start > 2)) & ~shout
    units = np.array(sorted(_hash_of(u) for u in UNITS.split()), dtype=np.uint64)
    before = np.concatenate([[False], number[:-1] & (row[1:] == row[:-1])])
    unit = before & (units[np.minimum(np.searchsorted(units, h), len(units) - 1)] == h)
    placed = np.where(number, _PLACE[0], np.where(name, _PLACE[1], np.where(unit, _PLACE[2], h)))
    return start, end, row, placed, number | name | unit, h


def windows(texts: Texts, width: int):
    """(start, end, row, slot of each token; of each window that begins at a token its hash, whether it is within a row, and whether it is exact)."""
    start, end, row, h, slot, plain = canonical(texts)
    n = len(h) - width + 1
    if n <= 0:
        return start, end, row, slot, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    mult = powers(width, 0xC6BC279692B5C323)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out += h[k : n + k] * mult[k]
    literal = np.concatenate([[0], np.cumsum(~slot)])
    ok = row[:n] == row[width - 1 :]
    exact = (literal[width:] - literal[:-width] < min(LITERAL, width - 1)) | (width < LEAST)
    out = mix(out + np.uint64(width))
    at = np.flatnonzero(exact & ok)
    own = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        own += plain[at + k] * mult[k]
    out[at] = mix(own + np.uint64(width)) ^ _EXACT
    return start, end, row, slot, out, ok, exact


def _values(texts: Texts, start, end, slot, i: int, width: int) -> list[str]:
    """What fills the slots of a window, in order."""
    return [texts.data[start[i + k] : end[i + k]].tobytes().decode("utf-8", "replace") for k in range(width) if slot[i + k]]


def _item_windows(batches):
    """Of every item: its windows, of WIDTH tokens or of all it has."""
    for batch in batches:
        ids = batch.column(batch.schema.names.index("item_id"))
        out = [[] for _ in range(6)]
        for first, texts in groups(batch):
            for r in range(texts.n):
                o = texts.offsets[r : r + 2]
                one = Texts(texts.data[o[0] : o[1]], o - o[0])
                n = len(canonical(one)[0])
                width = min(WIDTH, n)
                if not width:
                    continue
                start, end, _, slot, h, ok, exact = windows(one, width)
                for i in np.flatnonzero(ok).tolist():
                    for x, v in zip(out, (ids[first + r].as_py(), n, i, width, int(h[i].astype(np.int64)), [] if exact[i] else _values(one, start, end, slot, i, width)), strict=True):
                        x.append(v)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["item_id", "item_tokens", "item_at", "width", "h", "item_slots"])


def _doc_windows(shared):
    """Of every document: the windows that the bit table admits, with the token and the byte where they begin."""

    def run(batches):
        widths, packed = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.names.index("doc_id"))
            out = [[] for _ in range(5)]
            for first, texts in groups(batch):
                for width in widths:
                    start, end, row, slot, h, ok, exact = windows(texts, width)
                    begins = np.searchsorted(row, np.arange(texts.n))  # first token of each row
                    s = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                    hit = np.flatnonzero(ok & ((packed[s >> 3] >> (s & 7).astype(np.uint8)) & 1).astype(bool)) if len(h) else []
                    for i in hit:
                        for x, v in zip(out, (ids[first + int(row[i])].as_py(), int(i - begins[row[i]]), int(start[i] - texts.offsets[row[i]]), int(h[i].astype(np.int64)), [] if exact[i] else _values(texts, start, end, slot, i, width)), strict=True):
                            x.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "doc_token", "doc_at", "h", "doc_slots"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_tokens, covered, n_windows, reparameterised, first_at (byte) of every contaminated document, by item."""
    items = benchmark.select("item_id", "text").mapInArrow(_item_windows, "item_id long, item_tokens int, item_at int, width int, h long, item_slots array<string>")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # WIDTH of them at most
    packed = bit_table(items.select(F.shiftrightunsigned("h", 64 - TABLE_BITS).alias("s")), "s", TABLE_BITS)
    shared = docs.sparkSession.sparkContext.broadcast((widths, packed))
    found = docs.select("doc_id", "text").mapInArrow(tidied(_doc_windows(shared)), "doc_id long, doc_token long, doc_at long, h long, doc_slots array<string>")
    both = found.join(items, "h").where(F.size("item_slots") == F.size("doc_slots"))
    one = F.struct("item_at", "width")
    runs = both.groupBy("doc_id", "item_id", (F.col("doc_token") - F.col("item_at")).alias("offset")).agg(
        F.first("item_tokens").alias("item_tokens"), F.collect_set(one).alias("at"), F.min("doc_at").alias("first_at"),
        F.collect_set(F.when(F.col("item_slots") == F.col("doc_slots"), one)).alias("own"),
        F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("item_slots", "doc_slots")))).alias("pairs"),
    )
    # Each offset is a run, and so are neighbouring offsets together.
    line = Window.partitionBy("doc_id", "item_id").orderBy("offset")
    gap = F.when(F.col("offset") - F.lag("offset").over(line) <= SHIFT, 0).otherwise(1)
    chained = runs.withColumn("gap", gap).withColumn("run", F.sum("gap").over(line))
    joined = chained.groupBy("doc_id", "item_id", "run").agg(
        F.first("item_tokens").alias("item_tokens"), *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("at", "own", "pairs")], F.min("first_at").alias("first_at"), F.count("*").alias("n")
    )
    cols = ("doc_id", "item_id", "item_tokens", "at", "own", "pairs", "first_at")
    every = runs.select(*cols).unionByName(joined.where("n > 1").select(*cols))
    values = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    consistent = (F.size("pairs") == values("item_slots")) & (F.size("pairs") == values("doc_slots"))
    hits = every.withColumn("at", F.when(consistent, F.col("at")).otherwise(F.col("own")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda w: F.sequence(w["item_at"], w["item_at"] + w["width"] - 1)))))
    hits = hits.withColumn("covered", covered).withColumn("n_windows", F.size("at")).withColumn("reparameterised", F.size(F.array_except("at", "own")) > 0)
    hits = hits.where((F.col("n_windows") > 0) & (F.col("covered") >= F.least(F.lit(COVERED), F.col("item_tokens") - F.when(F.col("item_tokens") > WIDTH, EDGE).otherwise(0))))
    best = F.max_by(F.struct("item_tokens", "covered", "n_windows", "reparameterised"), F.struct("covered", ~F.col("reparameterised"), "n_windows", -F.col("first_at")))
    return hits.groupBy("doc_id", "item_id").agg(best.alias("best"), F.min("first_at").alias("first_at")).select("doc_id", "item_id", "best.item_tokens", "best.covered", "best.n_windows", "best.reparameterised", "first_at")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows. Rows are told by a 64-bit hash of doc_id and text, so ids that are null or stand for several texts harm none."""
    key = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")
    bad = staged(contaminated(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    return docs.join(small(bad, 1 << 20), key == F.col("_bad"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
