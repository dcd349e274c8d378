"""Sharding by histogram sort: `shards` runs of one key order, near equal in bytes, with one exchange of the rows.

Key: 32 bits of the hash of the text over 31 bits of the hash of doc_id, so equal texts stand side by side, and a group of
copies of any size can still be cut. Probes: exact bytes are counted by ranges of the key across all partitions: first
FAN equal ranges; then each range that holds a splitter and more bytes than the tolerance, or is too heavy for one task, is
probed again by FAN ranges of its own, until none is (or its keys are all equal). The splitters are the probed
boundaries nearest to the even cuts. Neighbouring ranges of a shard are joined to leaves of at most 1 / (shards * FINE) of all
bytes, or LEAF_BYTES if that is less; the rows are then exchanged once, by leaf, and a row's slot is its rank in the leaf plus the counted rows of
the shard's leaves before. Between the driver and the executors pass at most FAN counts for each range probed.

Law `bytes`: a splitter is off its even cut by half the tolerance (1 / (shards * EXACT) of all bytes) or half of the row there.

Defined results: null text: 16 bytes, crc 0, one group. Ties (repeated rows of one doc_id and text): one key, kept together.
Fewer rows than shards: some shards are empty. No rows: no rows. Columns of docs named shard, slot or size are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import staged, table, tidied

SHARDS, OVERHEAD = 40, 16
FAN, FINE, EXACT = 1024, 8, 1000
LEAF_BYTES = 512 << 20
KEY_BITS = 63
KEY, SIZE, LEAF, SHARD, BEFORE = "_shard_key", "_shard_size", "_shard_leaf", "_shard_no", "_shard_before"


def keyed(docs: DataFrame) -> DataFrame:
    text, ident = F.xxhash64("text"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    key = F.shiftleft(F.shiftrightunsigned(text, 32), 31).bitwiseOR(F.shiftrightunsigned(ident, 33))
    return docs.withColumns({KEY: key, SIZE: (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long")})


def _probed(low: np.ndarray, width: np.ndarray):
    """Bytes and rows by FAN ranges of each range [low, low + width)."""
    narrow = np.maximum(1, width // FAN)

    def run(batches):
        found: dict[int, list[int]] = {}
        for batch in batches:
            key, size = (np.asarray(batch.column(batch.schema.names.index(c))) for c in (KEY, SIZE))
            at = np.searchsorted(low, key, side="right") - 1
            inside = (at >= 0) & (key - low[np.maximum(at, 0)] < width[np.maximum(at, 0)])
            key, size, at = key[inside], size[inside], at[inside]
            first, back = np.unique(low[at] + (key - low[at]) // narrow[at] * narrow[at], return_inverse=True)
            n, b = np.bincount(back, minlength=len(first)), np.zeros(len(first), dtype=np.int64)
            np.add.at(b, back, size)
            for f, x, y in zip(first.tolist(), b.tolist(), n.tolist(), strict=True):
                have = found.setdefault(f, [0, 0])
                have[0] += x
                have[1] += y
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1] for k in keys], pa.int64())], ["low", "b", "n"])

    return run


def _probe(slim: DataFrame, low: np.ndarray, width: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first key, width, bytes, rows) of the ranges with rows."""
    rows = slim.mapInArrow(tidied(_probed(low, width)), "low long, b long, n long").groupBy("low").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()
    own = np.maximum(1, width // FAN)
    at = np.searchsorted(low, [r.low for r in rows], side="right") - 1
    return [(r.low, int(own[i]), r.b, r.n) for r, i in zip(rows, at, strict=True)]


class Plan:
    """Leaves in key order: first key, shard, and the rows of the shard before."""

    def __init__(self, low, shard, before):
        self.low, self.shard, self.before = low, shard, before


def plan(slim: DataFrame, shards: int) -> Plan:
    """Splitters and leaves for slim(KEY, SIZE)."""
    ranges = sorted(_probe(slim, np.zeros(1, dtype=np.int64), np.array([(1 << KEY_BITS) - 1])))
    total = sum(r[2] for r in ranges)
    cuts = [total * i / shards for i in range(1, shards)]
    leaf = min(total / (shards * FINE), LEAF_BYTES)
    while True:
        ends = np.cumsum([r[2] for r in ranges])
        held = np.searchsorted(ends, cuts, side="right")  # the range in which each cut falls
        holds = set(held.tolist())
        again = [i for i, (_, w, b, n) in enumerate(ranges) if w > 1 and n > 1 and (b > leaf or i in holds and b * shards * EXACT > total)]
        if not again:
            break
        finer = _probe(slim, np.array([ranges[i][0] for i in again]), np.array([ranges[i][1] for i in again]))
        drop = set(again)
        ranges = sorted([r for i, r in enumerate(ranges) if i not in drop] + finer)
    starts = np.concatenate([[0], ends]) if ranges else np.zeros(1)
    splits = np.array([min(range(max(0, h), min(len(ranges), h + 1) + 1), key=lambda j, c=c: abs(starts[j] - c)) for h, c in zip(held, cuts, strict=True)], dtype=np.int64)
    shard_of = np.searchsorted(splits, np.arange(len(ranges)), side="right")
    low, shard, before = [], [], []
    size, rows = 0, 0
    for (k, _, b, n), s in zip(ranges, shard_of.tolist(), strict=True):
        if not low or s != shard[-1] or size + b > leaf:
            rows = 0 if not low or s != shard[-1] else rows
            low.append(k)
            shard.append(s)
            before.append(rows)
            size = 0
        size += b
        rows += n
    return Plan(np.array(low, dtype=np.int64), np.array(shard, dtype=np.int32), np.array(before, dtype=np.int64))


def _dealt(p: Plan):
    def run(batches):
        for batch in batches:
            at = np.searchsorted(p.low, np.asarray(batch.column(batch.schema.names.index(KEY))), side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(p.shard[at]), pa.array(p.before[at])], [*batch.schema.names, LEAF, SHARD, BEFORE])

    return run


def placed(rows: DataFrame, slim: DataFrame, shards: int) -> DataFrame:
    """Rows with KEY and SIZE, which come as size, with shard and slot; slim: a table of their KEY and SIZE, which is probed."""
    p = plan(slim.select(KEY, SIZE), shards)
    if not len(p.low):
        return rows.withColumnRenamed(SIZE, "size").drop(KEY).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.mapInArrow(tidied(_dealt(p)), f"{kinds}, {LEAF} int, {SHARD} int, {BEFORE} long")
    slot = (F.col(BEFORE) + F.row_number().over(Window.partitionBy(LEAF).orderBy(KEY, "doc_id")) - 1).cast("long")
    return dealt.withColumn("slot", slot).withColumnsRenamed({SIZE: "size", SHARD: "shard"}).drop(KEY, LEAF, BEFORE)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with size, shard and slot."""
    rows = keyed(docs.drop("shard", "slot", "size"))
    return placed(rows, staged(rows.select(KEY, SIZE), "keys"), shards)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # What is exchanged here needs no text: its key, size and crc stand for it.
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = staged(keyed(docs.withColumn("text_crc32", crc)).drop("text"), "keys")
    out = placed(rows, rows, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
