"""The other operators against brute force, and their defined results on odd rows."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import WORDS, documents, prose, rows
from waymark.llm import decontaminate, embedding_dedup, language_id, lm_score, mixing, pii, sharding, tool_calls, url_filter


def test_pii_base_spans_are_leftmost(spark):
    texts = [
        "mail a.b+c@x-y.org, a@b@c.de.f. and @no.one x@nodot 1.2.3.4.5 999.1.1.1 10.0.0.255", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004", "+49 (30) 1234-567 +1 +123456789012345678 ++49301234567",
        "", None, "é€ a@b.c " * 300 + "x" * 5000 + "@", "GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789", "9" * 4000 + " 1.1.1.1",
    ]
    data = [(i, t, "en", "a") for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in pii.detect(documents(spark, [*data, data[0]])).collect()}
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[ -]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
    }
    for i, t, *_ in data:
        spans = [f"{k}:{x.start()}:{x.end()}" for k, (p, ok) in kinds.items() for x in re.finditer(p, t or "") if ok(x[0])]
        assert found[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (t or "")[:60]
        assert set(spans) <= set(found[i].spans.split(",") if found[i].spans else [])
    assert "iban" in found[6].spans and "ssn" in found[6].spans
    assert pii.redacted("to a@b.de now") == "to [EMAIL] now"
    assert pii.detect(documents(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("the hotel (020) 1234 5678 is full", "tel", 0), ("tel (020) 1234 5678", "tel", 1), ("(020) 1234 5678 (phone)", "tel", 1), ("the ship 10.1.2.3 sank", "ip", 0.7), ("ip 10.1.2.3", "ip", 1.0), ("10.1.2.3 is my IP", "ip", 1.0),
        ("x" * 50 + " monkey=abcdef1234567890", "secret", 0), ("password: abcdef1234567890", "secret", 1), ("microphone (020) 1234 5678", "tel", 0), ("telefono (020) 1234 5678", "tel", 1),
    ],
)
def test_pii_context_is_told_by_words(text, kind, want):
    found = pii.spans(text)[kind]
    if kind == "ip":
        assert [pii.score(kind, text, *s) for s in found] == [want]
    else:
        assert len(found) == want


def test_sharding_places_every_row(spark):
    data = rows() + [(1000 + i, "same text", "en", "a") for i in range(300)]
    out = sharding.sharded(documents(spark, data), 7).collect()
    assert len(out) == len(data)
    by = defaultdict(list)
    for r in out:
        assert r["size"] == len((r.text or "").encode()) + 16
        by[r.shard].append(r)
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    for rows_ in by.values():
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
        assert abs(sum(r["size"] for r in rows_) - total / 7) <= largest + total / 1000
    assert sharding.sharded(documents(spark, []).limit(0)).count() == 0


def test_sharding_query(spark, tmp_path):
    """The digest columns and the slots, by hand; leaves of few bytes change nothing but the exchange."""
    data = rows() + [(1000 + i, "same text", "en", "a") for i in range(50)] + [(None, "Ünï", "en", "a")]
    documents(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.query(spark, str(tmp_path)).collect()
    texts = defaultdict(list)
    for i, t, *_ in data:
        texts[i].append((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    assert len(out) == len(data) and Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, *x) for i, v in texts.items() for x in v)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)} and {r.shard for r in out} <= set(range(40))
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    same = sorted((r.shard, r.slot) for r in out if r.text_crc32 == zlib.crc32(b"same text"))
    for (s1, a), (s2, b) in zip(same, same[1:]):  # equal texts stand side by side
        assert (s1 == s2 and b == a + 1) or (s2 == s1 + 1 and b == 0) or s2 > s1


def test_sharding_leaves_follow_bytes(spark, monkeypatch):
    data = [(i, f"text {i % 7} " + "x" * (i % 50), "en", "a") for i in range(2000)]
    key = lambda rs: sorted((r.doc_id, r.shard, r.slot) for r in rs)
    whole = key(sharding.sharded(documents(spark, data), 4).collect())
    monkeypatch.setattr(sharding, "LEAF_BYTES", 700)
    assert key(sharding.sharded(documents(spark, data), 4).collect()) == whole


def test_sharding_splits_evenly_without_large_rows(spark):
    data = [(i, f"text {i % 7} " + "x" * (i % 50), "en", "a") for i in range(4000)]
    sizes = [r.b for r in sharding.sharded(documents(spark, data), 40).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 200


def mixed(data):
    tokens = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    size = Counter()
    for _, t, _, s in data:
        size[s] += tokens(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while True:
        rate = left / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * rate > 2 * size[s]]
        if not over:
            return size, target | {s: weight[s] * rate for s in free}
        for s in over:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
            free.discard(s)


@pytest.mark.parametrize("extra", [[], [(500 + i, prose(i, 20), "en", "huge") for i in range(60)], [(900, "", "en", "none")]])
def test_mixing_meets_targets(spark, extra):
    data = rows() + extra
    out = mixing.mixed(documents(spark, data)).collect()
    again = sorted(map(str, mixing.mixed(documents(spark, data).repartition(3)).collect()))
    size, target = mixed(data)
    assert sorted(map(str, out)) == again and len(out) == len(data)
    taken = Counter()
    for r in out:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-12)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.51
    assert mixing.mixed(documents(spark, []).limit(0)).count() == 0


def expected_copies(data):
    """How often the mix takes each (doc_id, text, source): in the order of keys, the row at the cut if half of it is taken."""
    tokens = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    size, target = mixed(data)
    out = Counter()
    for s in size:
        own = [r for r in data if r[3] == s]
        key = lambda r: int(hashlib.md5(f"{'' if r[0] is None else r[0]}:5".encode()).hexdigest()[:15], 16)
        budget = int(math.floor(target[s] + 0.5))
        epochs, rest = divmod(budget, size[s]) if size[s] else (0, 0)
        for r in sorted(own, key=lambda r: (key(r), r[1] or "")):
            n = tokens(r[1])
            more = min(n, max(0, rest))
            rest -= n
            out[(r[0], r[1], s)] += epochs + (2 * more >= n and more > 0) if n else 1
    return Counter({k: v for k, v in out.items() if v})


@pytest.mark.parametrize("extra", [[], [(500 + i, prose(i, 20), "en", "huge") for i in range(60)], [(900, "", "en", "none")], [(77, prose(5, 10), "en", "same")] * 6, [(None, prose(6, 9), "en", None)] * 3])
def test_mixture_meets_targets(spark, extra):
    """Each row as often as computed by hand, also rows that are repeated; the words of a source are its target but for the row at the cut."""
    data = rows() + extra
    docs = documents(spark, data).repartition(3)
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == expected_copies(data)
    words = Counter()
    for r in got:
        words[r.source] += len((r.text or "").split())
    _, target = mixed(data)
    for s, t in target.items():
        assert abs(words[s] - t) <= max([len((r[1] or "").split()) for r in data if r[3] == s]) / 2 + 1
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_embedding_links(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((12, 16))
    near = np.concatenate([base + s * r.standard_normal((12, 16)) for s in (0.03, 0.1, 0.25, 0.3)])
    v = [x.tolist() for x in np.concatenate([base, near, np.repeat(base[:1], 30, 0), 5 * base[:2]])]
    v += [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, []]
    data = [(i, x, 1) for i, x in enumerate(v)] + [(0, v[0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n long").withColumn("class_id", F.lit(1))
    out = embedding_dedup.linked(df).collect()
    ok = [i for i, x in enumerate(data) if x[1] and len(x[1]) == 16 and None not in x[1] and np.isfinite(x[1]).all() and any(x[1])]
    m = np.array([data[i][1] for i in ok])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.95
    ids = np.array([data[i][0] for i in ok])
    comp = ids.copy()
    for _ in range(len(ok)):
        comp = np.array([comp[row].min() for row in link])
    want = defaultdict(list)
    for k, i in enumerate(ok):
        want[data[i][0]].append((int(link[k].sum()) - 1, int(comp[k])))
    assert len(out) == len(data)
    for x in out:
        assert (x.n_links, x.component_id) == want.get(x.vec_id, [(0, x.vec_id)])[0], x.vec_id
        assert x.kept == (x.vec_id == x.component_id)
    assert embedding_dedup.linked(df.limit(0)).count() == 0


@pytest.mark.parametrize(("chunk", "leaf", "tile"), [(16, 8192, 512), (16, 24, 8), (8192, 24, 8)])
def test_embedding_crowded_cells(spark, monkeypatch, chunk, leaf, tile):
    """Cells of more vectors than a chunk are dealt to pairs of chunks, and crowds are cut, with the same links."""
    for name, value in (("CHUNK", chunk), ("LEAF", leaf), ("TILE", tile)):
        monkeypatch.setattr(embedding_dedup, name, value)
    r = np.random.default_rng(4)
    v = np.concatenate([c + 0.08 * r.standard_normal((60, 8)) for c in r.standard_normal((3, 8))])
    out = embedding_dedup.linked(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    m = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert [x.n_links for x in out] == ((m @ m.T >= 0.95).sum(1) - 1).tolist()


@pytest.mark.parametrize("spread", [0.02, 0.2, 1.0])
def test_embedding_trees_bring_near_vectors_together(spread, monkeypatch):
    """Any two vectors within the radius meet in one cell, one of them at home and just once."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 20)
    r = np.random.default_rng(8)
    y = np.concatenate([c + spread * r.standard_normal((50, 4)) for c in r.standard_normal((6, 4))])
    tree = embedding_dedup.grown(y[::2], 2, 0.3)
    row, cell, home = embedding_dedup.routed(tree, y, 0.3)
    assert sorted(row[home]) == list(range(len(y)))
    met = Counter()
    for c in np.unique(cell):
        inside, at_home = row[cell == c], home[cell == c]
        for i, a in enumerate(inside):
            for j, b in enumerate(inside):
                if at_home[i] and (not at_home[j] or a < b):
                    met[tuple(sorted((int(a), int(b))))] += 1
    assert max(met.values()) == 1
    near = {(i, j) for i in range(len(y)) for j in range(i + 1, len(y)) if np.linalg.norm(y[i] - y[j]) <= 0.3}
    assert near <= set(met)


def test_lm_scores(spark):
    data = rows() + [(300 + i, prose(i, 30), "en", "a") for i in range(30)]
    df = documents(spark, data).withColumn("held_out", lm_score.held_out())
    out = lm_score.scored(df).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in data}
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t, *_ in data]
    c = Counter(w for i, ws in tokens for w in ws if not held[i])
    n, v = sum(c.values()), len(c)
    want = {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens}
    assert len(out) == len(data)
    for r in out:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
        assert r.score < 0
    assert lm_score.scored(df.limit(0)).count() == 0


def test_lm_context_tree_by_hand():
    """The mixture of the whole tree against a plain recursion over dictionaries."""
    texts = [b"abracadabra", b"abacus", b"cab"]
    counts = Counter()
    for t in texts:
        s = b" " * lm_score.DEPTH + t + b"\xff"
        for i in range(lm_score.DEPTH, len(s)):
            counts[s[i - lm_score.DEPTH : i][::-1], s[i]] += 1
    gram = np.array([int.from_bytes(c + bytes([b]), "big") for c, b in counts], dtype=np.uint64)
    order = np.argsort(gram)
    gram, n = gram[order], np.array(list(counts.values()))[order]
    t = {"grams": gram.tobytes(), "times": n.tobytes()}
    import pyarrow as pa

    batch = pa.record_batch({k: pa.array([x], pa.binary()) for k, x in t.items()})
    model = lm_score.planted([r for b in lm_score._planted(1)([batch]) for r in b.to_pylist()])
    nodes = defaultdict(lambda: [0, 0])
    for (c, b), k in counts.items():
        for bit in range(8):
            for d in range(lm_score.DEPTH + 1):
                nodes[c[:d], 1 << bit | b >> 8 - bit][b >> 7 - bit & 1] += k
    pe = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def pw(c, node):
        own = pe(*nodes[c, node])
        if len(c) == lm_score.DEPTH:
            return own, 1.0
        below = sum(pw(k[0], node)[0] for k in list(nodes) if k[1] == node and len(k[0]) == len(c) + 1 and k[0][:-1] == c)
        both = np.logaddexp(own, below) + math.log(0.5)
        return both, math.exp(own + math.log(0.5) - both)

    def p(c, node, d=0):
        a, b = nodes[c[:d], node]
        kt = (b + 0.5) / (a + b + 1)
        if d == lm_score.DEPTH or (c[: d + 1], node) not in nodes:
            return kt
        share = pw(c[:d], node)[1]
        return share * kt + (1 - share) * p(c, node, d + 1)

    got = lm_score.log10_of(model, gram)
    for g, have in list(zip(gram.tolist(), got, strict=True))[::3]:
        raw = int(g).to_bytes(8, "big")[-lm_score.DEPTH - 1 :]
        c, b = raw[:-1], raw[-1]
        want = sum(math.log10(q if b >> 7 - bit & 1 else 1 - q) for bit in range(8) for q in [p(c, 1 << bit | b >> 8 - bit)])
        assert math.isclose(want, have, rel_tol=1e-4)


def test_lm_keeps_every_counted_node(spark):
    """A corpus of more than 2**21 nodes is scored by its whole tree."""
    from waymark.llm.common import Texts

    r = np.random.default_rng(5)
    texts = [bytes(r.integers(97, 123, 500, dtype=np.uint8)).decode() for _ in range(400)]
    data = [(i, t, "en", "a") for i, t in enumerate(texts + texts)]  # what occurs twice is told by deep contexts
    df = documents(spark, data).withColumn("held_out", F.col("doc_id") >= 790)
    joined = lambda texts: Texts(np.frombuffer("".join(texts).encode(), dtype=np.uint8), np.cumsum([0, *map(len, texts)]))
    gram, n = np.unique(np.concatenate([g for _, g in lm_score.grams(joined([t for i, t, *_ in data if i < 790]))]), return_counts=True)
    tree = lm_score.levels(gram, n, 0)
    assert sum(len(key) for key, *_ in tree) > 1 << 21
    model = [(key, (n1 + 0.5) / (n0 + n1 + 1), share) for (key, n0, n1), (_, share) in zip(tree, lm_score.weighted(tree), strict=True)]
    want = np.zeros(len(data))
    for row, g in lm_score.grams(joined([t for _, t, *_ in data])):
        u, back = np.unique(g, return_inverse=True)
        want += np.bincount(row, lm_score.log10_of(model, u)[back], len(data))
    out = {r.doc_id: r.score for r in lm_score.scored(df).collect()}
    assert len(out) == len(data) and all(math.isclose(out[i], want[i], rel_tol=1e-5) for i in out)


def sample(lang, seed, n=60):
    words = {"en": "the of and that with from this have which", "de": "der die und das nicht mit sich auch werden", "fr": "le la les des est dans pour que avec"}[lang].split()
    r = np.random.default_rng(seed)
    return " ".join(r.choice(words) for _ in range(n))


def test_language_id_learns(spark):
    data = [(i, sample(lang, i), lang, "a") for i in range(300) for lang in [("en", "de", "fr")[i % 3]]]
    data += [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, "12 34 !?", "de", "a"), (1003, sample("de", 7, 4), None, "a"), (1004, sample("fr", 1, 40000), None, "a"), (5, sample("de", 5), "de", "a"), (1005, "北京 上海 " * 40, None, "a")]
    df = documents(spark, data)
    model = language_id.fit(language_id.training(df))
    out = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang, _ in data[:300] if i != 5)
    assert [out[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "de", "fr"]
    assert out[1000].rejected and out[1005].rejected and not out[1004].rejected and not any(out[i].rejected for i in range(300))
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = language_id.recognised(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.rejected}
    none = language_id.identify(df, language_id.fit(df.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_language_counts_do_not_depend_on_grouping():
    from waymark.llm.common import Texts

    texts = [b"Hello w0rld", b"", b"abc" * 50, "é".encode()]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    together = language_id.counts(Texts(data, offsets))
    for i, t in enumerate(texts):
        alone = language_id.counts(Texts(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)])))
        assert (alone[0] == together[i]).all()


ITEM = "If Alice buys 12 apples and Bob buys 12 pears for 30 dollars then how many fruits does Alice have after 5 days"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, prose(8, 40)), (3, None), (4, ""), (5, "too short")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    data = [
        (1, f"intro {ITEM} outro", "en", "a"), (2, "x " + ITEM.replace("12", "77").replace("Alice", "Zoe").replace("30", "9"), "en", "a"), (3, ITEM.replace("Bob buys 12", "Bob buys 13").replace("Alice have", "Carol have"), "en", "a"),
        (4, prose(8, 40)[50:], "en", "a"), (5, prose(8, 6), "en", "a"), (6, prose(30, 200), "en", "a"), (7, None, "en", "a"), (8, "", "en", "a"), (9, "1 2 3 4 5 6 7 8 9 " * 50, "en", "a"), (10, prose(31, 20000) + " " + ITEM, "en", "a"), (1, f"intro {ITEM} outro", "en", "a"),
    ]
    out = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(documents(spark, data), bench).collect()}
    assert {(1, 1), (2, 1), (4, 2), (10, 1)} <= set(out) and not {5, 6, 7, 8, 9} & {d for d, _ in out}
    assert out[2, 1].reparameterised and not out[1, 1].reparameterised
    # Slots that don't fit together are no match: one of two equal numbers changed, one of two equal names.
    whole = out[1, 1].n_windows
    assert (3, 1) not in out or out[3, 1].n_windows < whole
    assert sorted(r.doc_id for r in decontaminate.clean(documents(spark, data), bench).collect() if r.doc_id in (1, 2, 4, 5, 6, 7, 8, 9, 10)) == [5, 6, 7, 8, 9]
    assert decontaminate.contaminated(documents(spark, data), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(documents(spark, []).limit(0), bench).count() == 0


def plain_contaminated(docs, items):
    """(doc_id, item_id): (covered, reparameterised), written out plainly."""

    def canonical(text):
        out = []
        for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
            w = re.sub(rb"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$", b"", w).decode()
            if not w:
                continue
            after = bool(out) and out[-1][1] == "#"
            kind = "#" if w[0] in "0123456789" else "N" if len(w) > 1 and re.match("[A-ZÀ-Þ]", w) and not re.match("[A-Z]", w[1]) else "U" if after and w.lower() in decontaminate.UNITS.split() else ""
            out.append((w, kind))
        return out

    def windows(toks, width):
        for i in range(len(toks) - width + 1):
            part = toks[i : i + width]
            exact = sum(not k for _, k in part) < min(4, width - 1) or width < 5
            low = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
            yield i, (exact, *(low(w) if exact or not k else k for w, k in part)), [] if exact else [(j, w) for j, (w, k) in enumerate(part) if k]

    out = {}
    for d, text in docs:
        dt = canonical(text)
        for q, item in items:
            it = canonical(item)
            width = min(8, len(it))
            if not width:
                continue
            own = list(windows(it, width))
            runs = defaultdict(list)
            for i, key, slots in windows(dt, width):
                for j, key2, slots2 in own:
                    if key == key2:
                        runs[i - j].append((j, [(j + a, x, y) for (a, x), (_, y) in zip(slots2, slots, strict=True)]))
            chains, last = [], None
            for o in sorted(runs):
                if last is not None and o - last <= 3:
                    chains[-1] += runs[o]
                else:
                    chains.append(list(runs[o]))
                last = o
            for hits in [*runs.values(), *chains]:
                pairs = {p for _, ps in hits for p in ps}
                # One value of the item at one place may meet several of the document only by an inconsistent run.
                values = {(x, y) for _, x, y in pairs}
                places = {(j, x) for j, x, _ in pairs}
                whole = len(values) == len({x for x, _ in values}) == len({y for _, y in values}) and len(places) == len({p[0] for p in pairs})
                count = [(j, all(x == y for _, x, y in ps)) for j, ps in hits if whole or all(x == y for _, x, y in ps)]
                covered = len({j + k for j, _ in count for k in range(width)})
                if count and covered >= min(13, len(it) - (2 if len(it) > 8 else 0)):
                    different = bool({j for j, _ in count} - {j for j, same in count if same})
                    best = (covered, not different)
                    out[d, q] = max(out.get((d, q), best), best)
    return out


def test_decontamination_against_a_plain_version(spark):
    """Slots are consistent over the whole item: times of day, names far apart, words put in, copies of which one is changed."""
    story = "At 10:30 Alice left the old town hall and walked along the quiet river for 12 km until she met a friend near the bridge and at 11:30 Alice went back home again by the last train of the day"
    r = np.random.default_rng(2)
    items = [(1, ITEM), (2, story), (3, prose(8, 40)), (4, "Compute 12 + 35 + 7 + 91 + 4 + 66 + 23"), (5, "the same five words here"), (6, None), (7, "Zoe ate 3 kg of rice and Zoe ate 3 kg of beans and Zoe ate 3 kg of rice and then some more of it")]
    docs = [
        (1, "x " + story.replace("10:30", "12:15").replace("11:30", "12:15")), (2, "x " + story.replace("10:30", "12:15").replace("11:30", "13:15")), (3, story.replace("Alice left", "Zoe left").replace("Alice went", "Carol went")), (4, story.replace("Alice", "Zoe") + " tail"),
        (5, story.replace("walked along", "walked slowly along").replace("Alice", "Zoe")), (6, ITEM.replace("12", "77") + " and then " + ITEM.replace("Alice", "Mia")), (7, story.replace("Alice left", "Zoe left")), (8, None), (9, "so the same five words here and there"),
        (10, items[6][1].replace("Zoe", "Ann").replace("3", "8")), (11, items[6][1].replace("Zoe", "Ann", 1)),
    ]
    for k in range(60):
        words = [w for _, t in items if t for w in t.split()]
        base = (items[k % 7][1] or "").split()
        for _ in range(int(r.integers(0, 6))):
            if base:
                base[int(r.integers(len(base)))] = words[int(r.integers(len(words)))]
        docs.append((100 + k, " ".join(base)))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id): (x.covered, not x.reparameterised) for x in found}
    want = plain_contaminated(docs, items)
    assert got == want and len(got) == len(found)
    assert (2, 2) in got and (4, 2) in got and (5, 2) in got and (1, 2) not in {k for k, v in got.items() if not v[1]} and (3, 2) not in {k for k, v in got.items() if not v[1]}


def test_clean_bears_null_and_repeated_ids(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    data = [(None, f"a {ITEM}", "en", "a"), (None, prose(1, 30), "en", "a"), (1, ITEM, "en", "a"), (1, prose(2, 30), "en", "a"), (2, None, None, None)]
    assert sorted(str(r.text) for r in decontaminate.clean(documents(spark, data), bench).collect()) == sorted([prose(1, 30), prose(2, 30), "None"])


def test_decontamination_finds_copies_with_few_literals(spark):
    """Items of numbers, names or title case, and short ones, are found as they stand; with other values they aren't."""
    items = ["Compute 12 + 35 + 7 + 91 + 4 + 66 + 23 + 18 + 5 + 42", "What Is The Capital Of France And Of Spain And Of Old Prussia Before", "Anna Bertha Clara Dora Emma Frieda", "zebras eat grass", "Add 4 7 9 2", "Say how many fruits does Alice have 1 2 3 4 5 6 7 8 9 10"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    data = [(i, f"some words before {t} and others after", "en", "a") for i, t in enumerate(items)]
    other = ["Compute 13 + 35 + 7 + 92 + 4 + 67 + 23 + 19 + 5 + 43", "Why Was My Capital In Poland Or In Italy Or In New Bavaria After", "Anna Bertha Clara Dora Emma Gerda", "zebras eat hay", "Add 4 7 9 3"]
    data += [(100 + i, f"some words before {t} and others after", "en", "a") for i, t in enumerate(other)]
    out = decontaminate.contaminated(documents(spark, data), bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(i, i) for i in range(len(items))}
    assert not any(r.reparameterised for r in out)


def test_decontamination_leaves_common_words_alone(spark):
    bench = spark.createDataFrame([(1, " ".join(WORDS[:8] + ["x1", "x2", "x3", "x4", "x5", "x6", "x7", "x8"]))], "item_id long, text string")
    assert decontaminate.contaminated(documents(spark, [(1, " ".join(WORDS), "en", "a")]), bench).count() == 0


def test_url_filter_as_of(spark):
    log = [("bad.com", "block", "2024-02-01"), ("bad.com", "remove", "2024-03-01"), ("ok.bad.com", "allow", "2024-01-01"), ("BAD.com", "block", "2024-04-01"), ("x.org", "block", "2024-01-01"), ("x.org", "allow", "2024-01-01"), (None, "block", "2024-01-01"), ("y.org", "block", None)]
    log = spark.createDataFrame(log, "pattern string, action string, listed string").withColumn("listed", F.to_date("listed"))
    caps = [
        (1, "http://bad.com/a", "2024-01-31"), (2, "http://sub.bad.com:80/a", "2024-02-01"), (3, "http://bad.com", "2024-03-05"), (4, "https://u:p@OK.bad.com/x", "2024-02-10"), (5, "http://bad.com", "2024-05-01"), (6, "http://notbad.com", "2024-02-10"),
        (7, None, "2024-02-10"), (8, "nonsense", "2024-02-10"), (9, "http://x.org", "2024-02-10"), (10, "http://bad.com", None), (2, "http://sub.bad.com:80/a", "2024-02-01"), (11, "http://a.b.c.d.e.x.org/", "2024-02-02"),
    ]
    df = spark.createDataFrame(caps, "page_id long, url string, fetched string").withColumns({"fetched": F.to_date("fetched"), "pattern": F.lit("z"), "host": F.lit("z")})
    out = url_filter.filtered(df, log).collect()
    assert len(out) == len(caps)
    assert {r.page_id: r.verdict for r in out} == {1: "pass", 2: "block", 3: "pass", 4: "allow", 5: "block", 6: "pass", 7: "pass", 8: "pass", 9: "allow", 10: "pass", 11: "allow"}
    assert url_filter.filtered(df.limit(0), log).count() == 0 and url_filter.filtered(df, log.limit(0)).where("verdict <> 'pass'").count() == 0


def test_url_filter_deep_entries_reach_subdomains(spark):
    deep = "foo.s3.eu-west-1.amazonaws.com"
    log = spark.createDataFrame([(deep, "block", "2024-01-01"), ("amazonaws.com", "allow", "2024-01-01"), ("b.c.d.e.f.g.h", "block", "2024-01-01")], "pattern string, action string, listed string").withColumn("listed", F.to_date("listed"))
    df = spark.createDataFrame([(1, f"http://img.{deep}/x"), (2, f"http://{deep}"), (3, f"http://not{deep}"), (4, "http://x.y.z.a.b.c.d.e.f.g.h"), (5, "http://c.d.e.f.g.h")], "page_id long, url string").withColumn("fetched", F.lit("2024-02-01").cast("date"))
    out = {r.page_id: (r.verdict, r.pattern) for r in url_filter.filtered(df, log).collect()}
    dots = spark.createDataFrame([(6, "http://a.b.c.d.com./x"), (7, "http://b.c.d.com/")], "page_id long, url string").withColumn("fetched", F.lit("2024-02-01").cast("date"))
    assert {r.verdict for r in url_filter.filtered(dots, log.limit(0).union(spark.createDataFrame([("C.d.com.", "block")], "p string, a string").withColumn("d", F.lit("2024-01-01").cast("date")))).collect()} == {"block"}
    assert out == {1: ("block", deep), 2: ("block", deep), 3: ("allow", "amazonaws.com"), 4: ("block", "b.c.d.e.f.g.h"), 5: ("pass", None)}


def test_tool_calls(spark):
    call = lambda *cs: json.dumps({"content": "c", "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in cs]})
    answer = lambda i: json.dumps({"tool_call_id": i, "content": "r"})
    data = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("a", "lookup", {"query": "q", "limit": 2}), ("b", "lookup", {"query": "q", "limit": 9}), ("c", "lookup", '{"query": "s", "limit": 1}'))), (1, 2, "tool", answer("a")), (1, 3, "tool", answer("a")), (1, 4, "tool", answer("zz")),
        (2, 0, "tool", answer("late")), (2, 1, "assistant", call(("late", "other", {}))), (2, 2, None, None), (2, 3, "user", "{broken"), (3, 0, "tool", json.dumps({"tool_call_id": "s", "tool_calls": [{"id": "s", "name": "lookup", "arguments": {}}]})), (1, 0, "user", "hi"), (4, 0, "user", ""),
        (5, 0, "tool", answer("m")), (5, 1, "tool", json.dumps({"tool_call_id": "n", "tool_calls": [{"id": "m", "name": "lookup", "arguments": {}}]})), (5, 2, "assistant", call(("n", "lookup", {}))),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"row": F.lit(1), "id": F.lit("x")})
    out = tool_calls.formatted(df).collect()
    assert len(out) == len(data)
    at = {(r.conv_id, r.turn): r for r in out}
    status = {k: r.status for k, r in at.items()}
    assert status == {(1, 0): "plain", (1, 1): "call", (1, 2): "answer", (1, 3): "extra", (1, 4): "orphan", (2, 0): "answer", (2, 1): "call", (2, 2): "plain", (2, 3): "plain", (3, 0): "cyclic", (4, 0): "plain", (5, 0): "answer", (5, 1): "answer", (5, 2): "call"}
    assert (at[1, 1].n_calls, at[1, 1].n_valid, at[1, 1].n_answered) == (3, 2, 1)
    assert list(at[2, 0].position) == [1, 0] and list(at[2, 1].position) == [1]
    order = [t for (c, t), r in sorted(at.items(), key=lambda x: (x[0][0], list(x[1].position))) if c == 5]
    assert order == [2, 1, 0]
    assert at[1, 0].json == '{"content":"hi","role":"user"}' and json.loads(at[1, 1].json)["tool_calls"][2]["arguments"] == {"limit": 1, "query": "s"}
    assert tool_calls.formatted(df.limit(0)).count() == 0


def test_tool_calls_in_long_chains_and_circles(spark):
    """Results that stand before their calls, 70 deep, are placed in order; only what hangs from a circle is cyclic."""
    both = lambda answers, calls: json.dumps({"tool_call_id": answers, "tool_calls": [{"id": calls, "name": "lookup", "arguments": {}}]})
    data = [(1, t, "tool", both(f"c{t + 1}", f"c{t}")) for t in range(70)] + [(1, 70, "assistant", json.dumps({"tool_calls": [{"id": "c70", "name": "lookup", "arguments": {}}]}))]
    data += [(2, 0, "tool", both("y", "x")), (2, 1, "tool", both("z", "y")), (2, 2, "tool", both("y", "z")), (2, 3, "tool", json.dumps({"tool_call_id": "x"}))]
    out = {(r.conv_id, r.turn): r for r in tool_calls.formatted(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    assert all(out[1, t].status == "answer" and list(out[1, t].position) == list(range(70, t - 1, -1)) for t in range(70)) and out[1, 70].status == "call"
    assert {t: out[2, t].status for t in range(4)} == {0: "answer", 1: "cyclic", 2: "cyclic", 3: "answer"}
    assert [list(out[2, t].position) for t in range(4)] == [[1, 0], [1], [2], [3]]


def test_schema_validation():
    schema = {"properties": {"a": {"type": "array", "items": {"type": "integer"}}, "e": {"enum": ["x", None]}, "f": {"type": "number", "maximum": 1}}, "required": ["a"]}
    assert tool_calls.valid(schema, {"a": [1, 2], "e": None, "f": 0.5})
    assert not any(tool_calls.valid(schema, v) for v in ({}, {"a": [True]}, {"a": [], "z": 1}, {"a": [], "f": 2}, {"a": [], "e": "y"}, [], None))
