"""Each stage of the pipeline against a plain version of it, on what the stage before wrote."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from fixtures import documents, prose, rows
from test_ngram_join import components_of, sets_of
from test_operators import expected_copies, plain_contaminated
from waymark.llm import language_id

pipeline = pytest.importorskip("corpus_pipeline")


def recognised(data, model):
    """The rows whose text has a letter and is near enough to a centroid, by plain loops over 3-grams."""
    out = []
    for r in data:
        text = (r[1] or "").encode()
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in text)
        padded = b" " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in low) + b" "
        grams = Counter(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i : i + 3] != b"   ")
        v = np.zeros(language_id.DIM)
        for g, n in grams.items():
            v[(int.from_bytes(g, "big") * 2654435761 & 0xFFFFFFFF) >> 20] += n
        v = np.log1p(v) * model.idf
        norm = np.sqrt((v * v).sum())
        best = (model.centroids @ v).max() / norm if norm else 0
        floor = model.floor * min(1, np.sqrt(sum(grams.values()) / language_id.FULL))
        if any(c.isalpha() for c in r[1] or "") and best >= floor:
            out.append(r)
    return out


def test_stages(spark, tmp_path):
    item = prose(77, 30)
    data = rows() + [(200, f"before {item} after", "en", "b"), (201, "12 34", "en", "b")] + [(300 + i, prose(500 + i, 50), "en", "c") for i in range(30)]
    documents(spark, data).drop("shard", "size").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, before = docs.columns, data
    model = language_id.fit(docs)

    def nearest(kept):
        sets = sets_of(kept)
        comp, first = components_of(sets), {}
        for r in kept:
            if comp[r[0]] == r[0]:
                first.setdefault(r[0], r)
        return list(first.values())

    def clean(kept):
        bad = {d for d, _ in plain_contaminated([(r[0], r[1]) for r in kept], [(1, item)])}
        return [r for r in kept if r[0] not in bad]

    plain = {
        "language_id": lambda kept: recognised(kept, model), "ngram_jaccard_join": nearest, "decontamination": clean,
        "mixing": lambda kept: [r for r in {tuple(x) for x in kept} for _ in range(expected_copies(kept)[r[0], r[1], r[3]])], "sharding": lambda kept: kept,
    }
    assert list(plain) == [name for name, _ in pipeline.STAGES]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        got = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        assert Counter(got) == Counter(plain[name](before)), name
        if i + 1 < len(pipeline.STAGES):
            assert docs.columns == columns
        assert len(got) < len(before) or name in ("mixing", "sharding")
        before = got
    slots, sizes = defaultdict(list), Counter()
    for r in docs.collect():
        assert r["size"] == len((r.text or "").encode()) + 16
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(40))
    total, largest = sum(sizes.values()), max(len((t or "").encode()) + 16 for _, t, *_ in before)
    assert all(abs(b - total / 40) <= largest * max(Counter(before).values()) + total / 1000 for b in sizes.values())


def test_run(spark, tmp_path):
    """run() is the stages one after another."""
    documents(spark, rows()).drop("shard", "size").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(77, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert {"shard", "slot", "size", "doc_id"} <= set(out.columns) and out.count() > 0
