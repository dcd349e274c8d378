import itertools

import numpy as np
import pyarrow as pa
import pytest

from fixtures import documents, prose, rows
from waymark.llm import components as c
from waymark.llm import ngram_join as m
from waymark.llm.common import bit_table


def sets_of(data):
    out = {}
    for i, t, *_ in data:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def components_of(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def check(df, data):
    found = df.collect()
    assert len(found) == len(data)
    sets = sets_of(data)
    want = components_of(sets)
    for r in found:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r.doc_id


def test_brute_force(spark):
    data = rows()
    check(m.jaccard_components(documents(spark)), data)


@pytest.mark.parametrize("pair_bits", [1 << 25, 64])
def test_clusters_that_resemble_each_other(spark, monkeypatch, pair_bits):
    """Clusters of copies, chained copies, and clusters near the threshold of each other."""
    monkeypatch.setattr(m, "PAIR_BITS", pair_bits)
    data, k = [], 0
    for c in range(6):
        base = prose(50, 120).split()
        base[c * 20 : c * 20 + 12] = prose(60 + c, 12).split()
        for v in range(12):
            w = list(base)
            w[(v * 7) % 120] = f"v{v}"
            w[(v * 11) % 120] = f"u{v}"
            data.append((k, " ".join(w), "en", "a"))
            k += 1
    chain = prose(70, 60).split()
    for v in range(15):
        chain = list(chain)
        chain[4 * v] = f"step{v}"
        data.append((k, " ".join(chain), "en", "a"))
        k += 1
    check(m.jaccard_components(documents(spark, data)), data)


def test_empty_table(spark):
    assert m.jaccard_components(documents(spark, []).limit(0)).count() == 0


def test_one_of_each(spark):
    kept = m.one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns
    want = components_of(sets_of(rows()))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, c in want.items() if i == c})


def test_one_of_each_bears_null_and_repeated_ids(spark):
    """Every component keeps one row, also where its ids are null or an id stands for different texts."""
    far, null, twin, late = (prose(s, 40) for s in (80, 81, 82, 83))
    near = lambda t: t.rsplit(" ", 1)[0]
    data = [
        (1, far, "en", "a"), (1, near(null), "en", "a"), (None, null, "en", "a"), (None, twin, "en", "a"), (None, near(twin), "en", "a"), (None, twin, "en", "a"), (3, prose(84, 30), "en", "a"), (3, prose(85, 30), "en", "a"), (3, near(far), "en", "a"),
        (None, late, "en", "a"), (None, None, "en", "a"),
    ]
    kept = [(r.doc_id, r.text) for r in m.one_of_each(documents(spark, data)).collect()]
    twins = [x for x in kept if x[1] in (twin, near(twin))]
    assert len(twins) == 1
    assert sorted(map(str, set(kept) - set(twins))) == sorted(map(str, [(1, far), (1, near(null)), (3, data[6][1]), (3, data[7][1]), (None, late), (None, None)]))
    assert len(kept) == 7


@pytest.mark.parametrize("n", [3, 8, 20, 60, 300])
def test_similar_sets_share_a_signature(n):
    r = np.random.default_rng(n)
    for _ in range(60):
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        drop = r.integers(0, n // 4 + 1)
        b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**64, r.integers(0, n // 4 + 1), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 4 * both >= 3 * (len(a) + len(b) - both):
            assert np.intersect1d(m.signatures(a), m.signatures(b)).size
            assert m._may_link(m.sketch(a), m.sketch(b))
            assert not m.Sketches([m.wide_sketch(a), m.wide_sketch(b)]).apart(0, np.array([1]), len(a) + len(b)).any()


def test_hubs_apart_is_safe():
    """The distance that sketches give is never more than the sets'."""
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(8, 200))
        x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: int(r.integers(0, n))], r.integers(0, 2**64, int(r.integers(1, n)), dtype=np.uint64)]))
        d = len(x) + len(y) - 2 * len(np.intersect1d(x, y))
        both = m.Sketches([m.wide_sketch(x), m.wide_sketch(y)])
        assert both.distance(0, np.array([1]))[0] <= d and both.distance(1, np.array([0, 1])).tolist()[1] == 0
        assert not both.apart(0, np.array([1]), 7 * d).any()


def test_bit_table(spark):
    for bits, numbers in ((17, [0, 5, 32767, 32768, 131071]), (15, [7]), (16, [])):
        packed = bit_table(spark.createDataFrame([(x,) for x in [*numbers, *numbers, None]], "s long"), "s", bits)
        assert np.flatnonzero(np.unpackbits(packed, bitorder="little")).tolist() == numbers


def test_signatures_of_one_group_meet_in_one_part():
    """Groups of holders go to the part of their least hub, once each, whichever part their signatures are in."""
    apart = pa.table({"node": pa.array([], pa.int64()), "component": pa.array([], pa.int64()), "hub": pa.array([], pa.int64())})
    sent = {}
    for part in range(20):
        groups = [[7, 9, 50 + part], [7, 9], [7, 9], [-4, 8]]
        own, sizes = np.array(sum(groups, []), dtype=np.int64), np.array([len(g) for g in groups], dtype=np.int32)
        out = m._mixed(16)(None, pa.table({"part": [part], "owners": [own.tobytes()], "sizes": [sizes.tobytes()]}), apart)
        for r in out.to_pylist():
            hubs, at = np.frombuffer(r["hubs"], np.int64), 0
            for n in np.frombuffer(r["sizes"], np.int32):
                sent.setdefault(int(hubs[at]), []).append((r["part"], part, tuple(hubs[at : at + n].tolist())))
                at += n
    assert sorted(sent) == [-4, 7] and all(len({x for x, *_ in v}) == 1 and len(set(v)) == len(v) for v in sent.values())
    assert len(sent[-4]) == 20 and {g for *_, g in sent[7]} == {(7, 9), *((7, 9, 50 + p) for p in range(20))} and len(sent[7]) == 40


@pytest.mark.parametrize("bits", [5, 64, 1 << 20])
def test_pairs_of_lists(monkeypatch, bits):
    monkeypatch.setattr(m, "PAIR_BITS", bits)
    r = np.random.default_rng(bits)
    for _ in range(20):
        groups = [np.sort(r.choice(50, int(r.integers(2, 30)), replace=False)) for _ in range(int(r.integers(1, 12)))]
        lists = [(np.concatenate(g), np.cumsum([0, *map(len, g)])) for g in (groups[:3], groups[3:]) if g]
        found = list(m._pairs(lists, 50))
        assert {divmod(int(x), 50) for f in found for x in f} == {p for g in groups for p in itertools.combinations(g.tolist(), 2)}
        assert all(len(f) <= 2 * max(bits, 30) for f in found)


@pytest.mark.parametrize("marks", [100, 1 << 24])
def test_long_lists_are_dealt_by_blocks(monkeypatch, marks):
    """Pairs of a large group, which many lists hold, go to many parts; each pair is told once there, and none is missing."""
    monkeypatch.setattr(m, "MARKS", marks)
    monkeypatch.setattr(m, "PAIR_BITS", 1 << 10)
    r, told = np.random.default_rng(23), []
    ids = np.sort(r.integers(-(2**63), 2**63, 400))
    groups = [np.concatenate([ids[:1], np.sort(r.choice(ids[1:], int(n), replace=False))]) for n in r.integers(150, 300, 30)] + [ids[3:5], ids[-70:-2]]
    none = pa.table({k: pa.array([], pa.int64()) for k in ("node", "component", "hub")})
    own, sizes = np.concatenate(groups), np.array([len(g) for g in groups], dtype=np.int32)
    out = m._mixed(64)(None, pa.table({"part": [0], "owners": [own.tobytes()], "sizes": [sizes.tobytes()]}), none)
    monkeypatch.setattr(m.Sketches, "apart", lambda self, i, j, allowed: told.append(len(j)) or np.zeros(len(j), dtype=bool))
    found, most, wide = [], [], m.wide_sketch(np.arange(9, dtype=np.uint64))
    for part in sorted(set(out.column("part").to_pylist())):
        lists = out.filter(pa.compute.equal(out.column("part"), part))
        held = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in lists.column("hubs").to_pylist()]))
        hubs = pa.table({"hub": held, "component": held, "reach": np.zeros(len(held), dtype=np.int64), "most": np.full(len(held), 9), "wide": [wide] * len(held)})
        told.clear()
        found += [(x["a"], x["b"]) for x in m._near(None, lists, hubs, 64).to_pylist()]
        most.append(sum(told))
    want = {p for g in groups for p in itertools.combinations(g.tolist(), 2)}
    assert set(found) == want and sum(most) == len(found) <= len(want) + 1
    assert max(most) < len(want) / 4


def test_members_of_two_hubs_are_told_together(monkeypatch):
    """300 sets under one hub and 300 under another cost a few comparisons of arrays, not one each, and the only link is found."""
    calls, r = [], np.random.default_rng(3)
    for name in ("_may_link", "_link"):
        monkeypatch.setattr(m, name, lambda *x, f=getattr(m, name), name=name: calls.append(name) or f(*x))
    sets = [np.unique(r.integers(0, 2**64, 40, dtype=np.uint64)) for _ in range(600)]
    sets[599] = np.unique(np.concatenate([sets[17][:38], sets[599][:2]]))
    nodes = pa.table({"hub": pa.array([1] * 300 + [2] * 300), "node": pa.array(range(600)), "component": pa.array([1] * 300 + [2] * 300), "features": pa.array([s.tobytes() for s in sets])})
    assert m._linked_members(None, pa.table({"a": [1], "b": [2]}), nodes).to_pylist() == [{"a": 17, "b": 599, "n": 1}]
    assert len(calls) < 100


def test_components_at_once(spark, monkeypatch):
    """One task finds what rounds find, in two steps however long a chain is."""
    r, written = np.random.default_rng(11), []
    edges = [(i, i + 1) for i in range(60)] + [(100 + 7 * i % 60, 100 + 7 * (i + 1) % 60) for i in range(50)] + [tuple(map(int, x)) for x in r.integers(200, 400, (120, 2))] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = sorted(map(tuple, c.components(df, "a", "b").collect()))
    monkeypatch.setattr(c, "staged", lambda df, name, f=c.staged: written.append(name) or f(df, name))
    assert sorted(map(tuple, c.components(df, "a", "b", at_once=len(edges)).collect())) == want
    assert written == ["edges", "components"]
    written.clear()
    assert sorted(map(tuple, c.components(df, "a", "b", at_once=10).collect())) == want
    assert len(written) > 2
    assert c.components(df.limit(0), "a", "b", at_once=10).count() == 0


def test_only_texts_that_go_on_are_cut_again(monkeypatch):
    cut, hashes = [], np.arange(100, dtype=np.uint64) << np.uint64(56)
    monkeypatch.setattr(m, "feature_sets", lambda batch, words, f=m.feature_sets: cut.append(batch.num_rows) or f(batch, words))
    bits = np.zeros(1 << 16, dtype=np.uint8)
    bits[(hashes[[3, 60]] >> np.uint64(48)).astype(int)] = 1
    admit = type("Sent", (), {"value": (16, np.packbits(bits, bitorder="little"))})
    batch = pa.RecordBatch.from_pydict({"doc_id": range(100), "text": [prose(1000 + i, 40) for i in range(100)], "text_id": hashes.view(np.int64)})
    out = pa.Table.from_batches(list(m._signed(5, 8, admit)([batch])))
    want = {m.digest(s) for _, s in m.feature_sets(batch.take(pa.array([3, 60])), 5)}
    assert cut[0] == 2 and set(out.column("class_id").drop_null().to_pylist()) == want
