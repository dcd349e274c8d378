"""Mixing sources to target weights, in DataFrame operations only.

Each row gets a hash-random key, which falls into one of BUCKETS equal ranges of its source; sums by range give each
range's offset, a window within the range the rest of the prefix sum. Each source takes as many whole epochs as its budget
holds, and of one more the rows below the budget, cut exactly within the row where it ends. A source with a third of
all rows is spread over BUCKETS ranges; what stands in one task is a range, and one row a source and range.

Targets: `share` of all sizes by weight; a source's target stops at `most` times its size, the excess goes to the others by
weight until none is above (found in closed form: sources in order of most * size / weight, the capped ones are a prefix).

Defined results: null text, or no words: size 0, taken 0. Null source: a source of its own, the last. No source at all: no rows.
Ties in the key: by doc_id, then by the hash of the text; equal rows are interchangeable and each counts. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import small, staged, table

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BUCKETS = 512


def words(text):
    """How many runs of bytes other than 0x20 and 0x09-0x0D a text has."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(seed: int = 5):
    digits = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digits, 1, 15), 16, 10).cast("long")


def keyed(docs: DataFrame, size, seed: int = 5) -> DataFrame:
    """doc_id, source, size, key and bucket of every row."""
    rows = docs.select("doc_id", "source", size.alias("size"), _key(seed).alias("key"), F.xxhash64("text").alias("tie"))
    return rows.withColumn("bucket", F.shiftright("key", 60 - BUCKETS.bit_length() + 1).cast("int"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target of sources(source, source_size), one row each."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward, whole = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    rate = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    open_ = ranked.withColumn("rate", rate).withColumn("free", F.col("rate") * F.col("weight") <= F.col("cap"))
    final = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("rate").alias("rate")))).over(whole)["rate"]
    return open_.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(final, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _planned(rows: DataFrame, **how) -> DataFrame:
    """s, b, bucket_size, offset, source_size, target, epochs and rest (of the last, partial epoch) of every bucket of rows."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), **how)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    offsets = offsets.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    return offsets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_size", "offset", "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))


def _bucket():
    return F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows of the plan's buckets, and before: what their source has before them."""
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(plan, _bucket()).withColumn("before", F.col("offset") + F.col("within"))


def mixed(docs: DataFrame, size=None, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of docs(doc_id, source, text)."""
    rows = staged(keyed(docs, words(F.col("text")) if size is None else size), "mix")
    placed = _placed(rows, _planned(rows, **how))
    taken = F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """Rows of docs as often as the mix takes them; the one row a source in which its budget ends is taken where at least half of it is. Rows without words come once.

    A source's order is cut in one place, so a row is compared with its source's cut, and rows of text aren't shuffled. Only rows equal to the
    row at the cut are told from each other, by their number.
    """
    rows = staged(keyed(docs, words(F.col("text"))), "mix")
    plan = staged(_planned(rows, **how), "plan")
    holds = plan.where((F.col("source_size") > 0) & (F.col("offset") <= F.col("rest")) & (F.col("rest") < F.col("offset") + F.col("bucket_size")))
    near = _placed(rows.join(holds.select("s", "b"), _bucket(), "left_semi"), holds)
    same = near.groupBy("s", "epochs", "rest", "key", "doc_id", "tie", "size").agg(F.min("before").alias("start"), F.count("*").alias("n"))
    cut = same.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("n") * F.col("size")))
    full = F.floor((F.col("rest") - F.col("start") + F.floor(F.col("size") / 2)) / F.col("size"))  # rows of the cut's that are taken once more: whole, or at least half
    cut = staged(cut.select(F.col("s").alias("_s"), F.col("epochs").alias("_epochs"), F.struct("key", "doc_id", "tie").alias("_cut"), full.alias("_full")), "cuts")
    kept = docs.columns
    at = F.struct(_key().alias("key"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("tie"))
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    told = docs.withColumns({"_at": at, "_wordy": wordy}).join(small(cut), F.col("source").eqNullSafe(F.col("_s")), "left")
    told = told.withColumn("_equal", F.coalesce(F.col("_at") == F.col("_cut"), F.lit(False)) & F.col("_wordy"))
    times = F.when(~F.col("_wordy"), 1).otherwise(F.coalesce("_epochs", F.lit(0)) + F.when(F.col("_at") < F.col("_cut"), 1).otherwise(0))
    plain = told.where("not _equal").withColumn("_times", times.cast("int")).select(*kept, "_times")
    # Rows equal to the cut's are numbered: each written part of them apart, after the counts of the parts before.
    equal = staged(told.where("_equal").select(*kept, "_s", "_epochs", "_full").withColumn("_m", F.monotonically_increasing_id()), "equal")
    part = F.shiftright("_m", 33)
    counts = equal.groupBy(F.col("_s").alias("_o"), part.alias("_p")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(Window.partitionBy("_o").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    equal = equal.withColumn("_r", F.row_number().over(Window.partitionBy("_s", part).orderBy("_m")) - 1).join(counts, F.col("_s").eqNullSafe(F.col("_o")) & (part == F.col("_p")))
    equal = equal.withColumn("_times", (F.col("_epochs") + F.when(F.col("_first") + F.col("_r") < F.col("_full"), 1).otherwise(0)).cast("int")).select(*kept, "_times")
    return plain.unionByName(equal).where("_times > 0").select(*kept, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select(kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':5'), 1, 15))::bigint as key
  from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select source, source_size, 2.0::double * source_size as cap,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s
), r as (
  select *, (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as rate from w
), f as (
  select min(rate) as rate from (select rate from r where rate * weight <= cap order by cap / weight, source nulls last limit 1)
), t as (
  select r.source, r.source_size, least(r.cap, coalesce(f.rate, 'infinity'::double) * r.weight) as target from r, f
), e as (
  select d.doc_id, d.size, t.source_size, t.target, d.source, round(t.target)::bigint as budget,
         case when t.source_size > 0 then round(t.target)::bigint // t.source_size else 0 end as epochs,
         coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, budget - epochs * source_size - before)))::bigint as taken, source from e
"""
