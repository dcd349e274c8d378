"""Language ID: nearest of several centroids a language, over TF-IDF vectors of hashed byte 3-grams, by cosine.

Document frequencies cover every labelled training row. Centroids come from a bounded sample of them: the SAMPLE rows
(parameter; over all languages together, PER_LANGUAGE at most of one) with the least hash of doc_id and text, equally many a language; spherical k-means of
the sample runs on the driver. A vector has DIM entries whatever the corpus, so frequencies (DIM counts), the
sample and the centroids have a fixed size.

A document is rejected where its best cosine is under a floor: FLOOR_SHARE of the 1 % quantile within the sample, less
for short texts (fewer 3-grams give sparser vectors), or where it has no letter at all.

Defined results: null or letterless text: `und`, score 0, rejected. No labelled training row: `und` for all. Ties:
the language that is first by code point. Repeated rows: one result each. Columns other than doc_id, text and lang aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import Texts, groups, small, staged, table, tidied

DIM = 4096
SAMPLE, PER_LANGUAGE = 2000, 1000
CENTROIDS = 3
ROUNDS = 12
FLOOR_SHARE = 0.25
SHARE = 0.1  # of its language's sample that a centroid must stand for
FULL = 200  # 3-grams from which the floor holds in full


def _slots(padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every 3-gram, and whether it counts (not all blank)."""
    code = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 12)).astype(np.int64), code != 0x202020


def counts(texts: Texts) -> np.ndarray:
    """3-grams of bytes of each row by slot; ASCII that isn't a letter is as blank, and each text stands between two blanks."""
    n, size = texts.n, len(texts.low)
    if n == 1:  # one text of any length, in pieces
        out = np.zeros(DIM, dtype=np.int64)
        padded = np.full(size + 2, 0x20, dtype=np.uint8)
        padded[1:-1] = _PLAIN[texts.low]
        for i in range(0, size, PIECE):
            slot, ok = _slots(padded[i : i + PIECE + 2].astype(np.uint32))
            out += np.bincount(slot[ok], minlength=DIM)
        return out.reshape(1, DIM)
    lengths = np.diff(texts.offsets)
    padded = np.full(size + 2 * n, 0x20, dtype=np.uint32)
    padded[np.arange(size) + 2 * np.repeat(np.arange(n), lengths) + 1] = _PLAIN[texts.low]
    slot, ok = _slots(padded)
    owner = np.repeat(np.arange(n), lengths + 2)[:-2]
    ends = (texts.offsets[:-1] + 2 * np.arange(n) + lengths)[:-1]
    ok[np.concatenate([ends, ends + 1])] = False  # 3-grams across two texts
    return np.bincount(owner[ok] * DIM + slot[ok], minlength=n * DIM).reshape(n, DIM)


PIECE = 1 << 20
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:0x80] = 0x20
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)


def vectors(texts: Texts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors and the number of 3-grams of each row."""
    c = counts(texts)
    v = np.log1p(c).astype(np.float32) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1), c.sum(1)


def _parts(texts: Texts, rows: int = 512):
    """texts in runs of at most so many rows, so that the dense vectors stay small."""
    for i in range(0, texts.n, rows):
        o = texts.offsets[i : i + rows + 1]
        yield i, Texts(texts.data[o[0] : o[-1]], o - o[0])


def _frequencies(batches):
    df = np.zeros(DIM, dtype=np.int64)
    n = 0
    for batch in batches:
        for _, texts in groups(batch):
            for _, part in _parts(texts):
                df += (counts(part) > 0).sum(0)
                n += part.n
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(df, n))], ["slot", "n"])


def _sampled(idf: np.ndarray):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            lang = batch.column(names.index("lang"))
            for first, texts in groups(batch):
                for i, part in _parts(texts):
                    v, n = vectors(part, idf)
                    yield pa.RecordBatch.from_arrays([lang.slice(first + i, part.n), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(n)], ["lang", "v", "n"])

    return run


def _clustered(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centre is the mean's nearest, each further one the farthest from those so far."""
    centres = [v[np.argmax(v @ v.mean(0))]]
    while len(centres) < min(k, len(v)):
        centres.append(v[np.argmin((v @ np.array(centres).T).max(1))])
    c = np.array(centres)
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].mean(0)
                c[j] = m / max(np.sqrt((m * m).sum()), 1e-12)
    return c


class Model:
    """idf, centroids with their languages, and the floor of cosines."""

    def __init__(self, idf, centroids, langs, floor):
        self.idf, self.centroids, self.langs, self.floor = idf, centroids, langs, floor

    def shared(self, spark: SparkSession):
        """Its parts, broadcast: plain values, which workers read without this module."""
        return spark.sparkContext.broadcast((self.idf, self.centroids, self.langs, self.floor))


def fit(train: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from train(doc_id, text, lang)."""
    train = train.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    df = {int(r.slot): int(r.n) for r in train.select("text").mapInArrow(tidied(_frequencies), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    counts = np.array([df.get(i, 0) for i in range(DIM + 1)], dtype=np.float64)
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])).astype(np.float32) + np.float32(0.05)
    # Rows are ranked by a hash, each row of text once; those above a language's threshold can't be among its first and aren't ranked.
    rows = train.select("lang", F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 40)).alias("k"))
    most = min(sample, PER_LANGUAGE)
    limits = rows.groupBy(F.col("lang").alias("l")).agg(F.approx_count_distinct("k").alias("n")).select("l", (F.lit(float(1 << 40)) * (4 * most + 100) / F.col("n")).alias("limit"))
    rows = rows.join(small(staged(limits, "limits")), F.col("lang") == F.col("l")).where("k < limit").select("lang", "k").distinct()
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("k"))).where(F.col("rn") <= most)
    rows = rows.withColumn("all", F.row_number().over(Window.orderBy("rn", "lang"))).where(F.col("all") <= sample).select(F.col("lang").alias("l"), F.col("k").alias("_k"))
    own = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 40))
    picked = train.withColumn("k", own).join(F.broadcast(rows), (F.col("k") == F.col("_k")) & (F.col("lang") == F.col("l"))).groupBy("lang", "k").agg(F.first("text").alias("text"))
    got = picked.select("text", "lang").mapInArrow(tidied(_sampled(idf)), "lang string, v binary, n long").toPandas()
    centroids, langs, sampled, labels = [], [], [], []
    for lang, rows in sorted(got.groupby("lang"), key=lambda x: x[0]):
        v = np.stack([np.frombuffer(x, dtype=np.float32) for x in rows.v])
        v = v[np.lexsort(v[:, ::-1].T[:8])]
        c = _clustered(v, CENTROIDS)
        share = np.bincount((v @ c.T).argmax(1), minlength=len(c)) / len(v)
        c = c[(share >= SHARE) | (share == share.max())]  # a small one may be rows with a wrong label
        centroids.append(c)
        langs += [lang] * len(c)
        sampled.append(v)
        labels += [lang] * len(v)
    if not langs:
        return Model(idf, np.zeros((0, DIM), dtype=np.float32), [], 0.0)
    c, v, labels = np.concatenate(centroids), np.concatenate(sampled), np.array(labels)
    cos = v @ c.T
    own = cos.argmax(1)
    # Rows with a wrong label may make a centroid of their own: it takes the language of most rows that are nearest to it.
    for j in range(len(c)):
        names, n = np.unique(labels[own == j], return_counts=True)
        if len(n) and n.max() > (n[names == langs[j]].sum()):
            langs[j] = str(names[n.argmax()])
    return Model(idf, c, langs, float(FLOOR_SHARE * np.quantile(cos.max(1), 0.01)))


def _has_letter(texts: Texts) -> np.ndarray:
    ascii_ = (texts.low >= 97) & (texts.low <= 122)
    sums = np.concatenate([[0], np.cumsum(ascii_)])
    out = np.diff(sums[texts.offsets]) > 0
    for r in np.flatnonzero(~out & (np.diff(texts.offsets) > 0)):
        out[r] = any(c.isalpha() for c in texts.text(r))
    return out


def _predicted(model):
    def run(batches):
        m = Model(*model.value)
        for batch in batches:
            pred, score, reject = [], [], []
            for _, texts in groups(batch):
                for _, part in _parts(texts):
                    ok = _has_letter(part)
                    if not m.langs:
                        pred += ["und"] * part.n
                        score.append(np.zeros(part.n))
                        reject.append(np.ones(part.n, dtype=bool))
                        continue
                    v, n = vectors(part, m.idf)
                    cos = np.clip(v @ m.centroids.T, 0, 1)
                    best = cos.argmax(1)
                    top = np.where(ok, cos[np.arange(part.n), best], 0).astype(np.float64)
                    pred += [m.langs[b] if o else "und" for b, o in zip(best, ok, strict=True)]
                    score.append(top)
                    reject.append(~ok | (top < m.floor * np.minimum(1, np.sqrt(n / FULL))))
            ids = batch.column(batch.schema.names.index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pred, pa.string()), pa.array(np.concatenate([np.zeros(0), *score])), pa.array(np.concatenate([np.zeros(0, dtype=bool), *reject]))], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id with lang_pred, score (cosine, 0 to 1) and rejected, a row for each row."""
    shared = model.shared(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidied(_predicted(shared)), "doc_id long, lang_pred string, score double, rejected boolean")


def training(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _accepted(model, schema):
    def run(batches):
        m = Model(*model.value)
        for batch in batches:
            keep = []
            for _, texts in groups(batch):
                for _, part in _parts(texts):
                    v, n = vectors(part, m.idf)
                    top = np.clip(v @ m.centroids.T, 0, 1).max(1) if m.langs else np.zeros(part.n)
                    keep.append(_has_letter(part) & (top >= m.floor * np.minimum(1, np.sqrt(n / FULL))) & bool(m.langs))
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, dtype=bool), *keep])))

    return run


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    shared = model.shared(docs.sparkSession)
    return docs.mapInArrow(tidied(_accepted(shared, docs.schema)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(training(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
