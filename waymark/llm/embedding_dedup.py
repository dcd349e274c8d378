"""Embedding near-dedup: exact links at cosine >= 0.95 by a subspace pigeonhole join.

Unit vectors u, v link when |u - v|**2 <= 2 - 2 * 0.95. A fixed random rotation spreads their difference over the
dimensions; the rotated vectors are split into BLOCKS blocks, and in one block at least the squared distance is within
the block's share of the budget, in proportion to its dimensions. Each block is range-joined: a tree of cuts, each on the axis
that a node's vectors spread most along, splits a block until a cell has about LEAF vectors. The cuts come from a sample of some SAMPLE
vectors; they route every vector and decide nothing else, so results don't depend on them. A vector is at home in one cell, and
visits those cells whose region lies within the block's radius of it; of two cells one side visits the other, so a pair meets once a block.
Cells with more than CHUNK vectors at home or visiting are dealt to pairs of chunks (home with home, home with visitors; visitors never meet).

Within a task, tiles whose boxes lie further apart than the radius are passed over, the other tiles' distances within the block are matrix
products in single precision (with slack), and what is left is verified by the exact cosine in double precision. A
pair is counted in the first block whose budget holds it, so once. A task returns counts by vector and a spanning
forest of its links: as many rows as vectors at most, however many pairs link.

Equal vectors are one class from the start. n_links of a vector: rows of its own class but itself, and of the classes linked with it.

Defined results: null, zero, non-finite or empty: linked with nothing (n_links 0, a component of its own). Lengths differ: vectors link
within their own length only. Repeated rows with one vec_id: each is a row, and each other one is linked. A null vec_id: a row like any
other, null counts as larger than any id, and a component of such rows alone has a null component_id.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import mix, staged, table
from waymark.llm.components import components

COSINE = 0.95
BLOCKS = 4
LEAF, CHUNK, SAMPLE = 8192, 8192, 1 << 14
TILE = 512
SLACK, COARSE = 1e-9, 1e-5  # of rounding in double and in single precision; the verification has none


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(6 * 1000 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def bounds(d: int) -> list[tuple[int, int, float]]:
    """First and last dimension and squared budget of each block."""
    edges = np.linspace(0, d, min(BLOCKS, d) + 1).astype(int)
    return [(int(a), int(b), (2 - 2 * COSINE) * (b - a) / d) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Tree(NamedTuple):
    """Cuts of a block. axis: of a node (-1: a cell); cut; first of its two children (the other is the next one), or the cell's number."""

    axis: np.ndarray
    cut: np.ndarray
    down: np.ndarray


def grown(y: np.ndarray, each: float, radius: float) -> Tree:
    """A tree from a sample of a block's vectors, each of which stands for so many; what is narrower than the radius isn't cut."""
    axis, cut, down, todo, cells = [-1], [0.0], [0], [(0, np.arange(len(y)))], 0
    while todo:
        node, rows = todo.pop()
        spread = y[rows].std(0) if len(rows) else np.zeros(1)
        if len(rows) < 32 or len(rows) * each <= LEAF or 4 * spread.max() <= radius:
            down[node], cells = cells, cells + 1
            continue
        a = int(spread.argmax())
        c = float(np.median(y[rows, a]))
        right = y[rows, a] >= c
        if right.all():
            down[node], cells = cells, cells + 1
            continue
        axis[node], cut[node], down[node] = a, c, len(axis)
        todo += [(len(axis), rows[~right]), (len(axis) + 1, rows[right])]
        axis += [-1, -1]
        cut += [0.0, 0.0]
        down += [0, 0]
    return Tree(np.array(axis), np.array(cut), np.array(down))


def routed(tree: Tree, y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether at home): each vector's own cell, and those it visits. Of two cells, the one on the right of the cut between them visits."""
    found = []
    todo = [(0, np.arange(len(y)), np.zeros(y.shape), np.ones(len(y), dtype=bool))]
    while todo:
        node, rows, off, home = todo.pop()
        a = tree.axis[node]
        if not len(rows):
            continue
        if a < 0:
            found.append((rows, np.full(len(rows), tree.down[node]), home))
            continue
        gap = y[rows, a] - tree.cut[node]
        for right in (False, True):
            own = (gap >= 0) == right
            far = off.copy()
            far[:, a] = np.abs(gap)
            visits = ~own & ((far * far).sum(1) <= radius * radius)
            if right:
                visits &= ~home
            go = own | visits
            todo.append((int(tree.down[node]) + right, rows[go], np.where(own[:, None], off, far)[go], home[go] & own[go]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3


def _radius(budget: float) -> float:
    return float(np.sqrt(budget)) * (1 + 1e-6) + SLACK


def _many(batches, least: int = 8192):
    """Batches of at least so many rows, but the last."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= least:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _routes(t: pa.Table, trees: dict):
    """(row, cell, home) of a table's vectors in all blocks."""
    lists = t.column("v").combine_chunks()
    offsets = np.asarray(lists.offsets)
    values, lengths = np.asarray(lists.values), np.diff(offsets)
    out = []
    for d in np.unique(lengths):
        pick = np.flatnonzero(lengths == d)
        y = _unit(values[offsets[pick][:, None] + np.arange(d)].astype(np.float64)) @ rotation(int(d))
        for b, (lo, hi, budget) in enumerate(bounds(int(d))):
            if tree := trees.get((int(d), b)):
                rows, cell, home = routed(tree, y[:, lo:hi], _radius(budget))
            else:
                rows, cell, home = np.arange(len(pick)), np.zeros(len(pick), dtype=np.int64), np.ones(len(pick), dtype=bool)
            out.append((pick[rows], (int(d) << 40) + (b << 32) + cell, home))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))


def _counted(trees: dict):
    """Of every cell how many are at home, and how many visit."""

    def run(batches):
        for t in _many(batches):
            _, cell, home = _routes(t, trees)
            cells, back = np.unique(cell, return_inverse=True)
            n = np.bincount(back, home, len(cells)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n), pa.array(np.bincount(back, minlength=len(cells)) - n)], ["cell", "homes", "visitors"])

    return run


_DEALT = "cell long, i int, j int, side int, home boolean, class_id long, size long"


def _dealt(trees: dict, crowded: dict):
    """Each class in its cells' tasks. crowded: chunks of those at home, and of visitors, of cells that one task doesn't take whole."""

    def run(batches):
        for t in _many(batches):
            ids, size, lists = np.asarray(t.column("class_id")), np.asarray(t.column("size")), t.column("v").combine_chunks()
            row, cell, home = _routes(t, trees)
            cells, back = np.unique(cell, return_inverse=True)
            h, w = (np.array([crowded.get(c, (1, 0))[k] for c in cells.tolist()], dtype=np.int64)[back] for k in (0, 1))
            own = (mix(ids[row].astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
            own = np.where(home, own % h, own % np.maximum(w, 1))
            # At home in chunk o: with each chunk at home, and with each of the visitors'. A visitor: with each chunk at home.
            times = np.where(home, h + w, h)
            pick = np.repeat(np.arange(len(row)), times)
            other = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
            o, at_home = own[pick], home[pick]
            i = np.where(at_home, np.minimum(o, other), other)
            j = np.where(at_home, np.maximum(o, other), np.where(w[pick] > 0, h[pick] + o, 0))
            side = np.where(at_home, o > other, True).astype(np.int32)
            where = pa.array(row[pick])
            cols = [cell[pick], i.astype(np.int32), j.astype(np.int32), side, at_home, ids[row[pick]], size[row[pick]]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), lists.take(where)], ["cell", "i", "j", "side", "home", "class_id", "size", "v"])

    return run


def _near(y: np.ndarray, left: np.ndarray, right: np.ndarray, budget: float, ahead: int):
    """Positions in left and right of what lies within the budget, tile by tile. The first `ahead` of right are left itself: of them each pair once."""

    def boxes(rows):
        cuts = np.arange(0, len(rows), TILE)
        return np.minimum.reduceat(y[rows], cuts), np.maximum.reduceat(y[rows], cuts)

    if not len(left) or not len(right):
        return
    z = y.astype(np.float32)
    norm, one = (z * z).sum(1, keepdims=True), np.ones((len(z), 1), dtype=np.float32)
    a, b = np.hstack([-2 * z, norm, one]), np.hstack([z, one, norm])
    a, b = a[left], np.ascontiguousarray(b[right].T)
    low, high = boxes(right)
    lows, highs = boxes(left)
    for s in range(0, len(left), TILE):
        gap = np.maximum(0, np.maximum(low - highs[s // TILE], lows[s // TILE] - high))
        for k in np.flatnonzero((gap * gap).sum(1) <= budget + SLACK):
            e = int(k) * TILE
            stop = min(e + TILE, len(right))
            if stop <= ahead and stop <= s + 1:
                continue
            p, q = np.nonzero(a[s : s + TILE] @ b[:, e:stop] <= np.float32(budget + COARSE))
            p, q = p + s, q + e
            keep = (q >= ahead) | (p < q)
            if len(p):
                yield p[keep], q[keep]


def _joined(t):
    """Of one task: verified links between vectors at home, and between them and visitors, counted in their first block."""
    block = t.column("cell")[0].as_py() >> 32 & 0xFF
    whole = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    home, side = (np.asarray(t.column(c).combine_chunks()).astype(bool) for c in ("home", "side"))
    ids, size = (np.asarray(t.column(c).combine_chunks()) for c in ("class_id", "size"))
    x = _unit(np.asarray(t.column("v").combine_chunks().flatten()).astype(np.float64).reshape(len(ids), -1))
    y = x @ rotation(x.shape[1])
    limits = bounds(x.shape[1])
    lo, hi, budget = limits[block]
    starts, budgets = [b[0] for b in limits], np.array([b[2] for b in limits]) + SLACK
    own = y[:, lo:hi]
    line = own[:, own.std(0).argmax()]
    left = np.flatnonzero(home if whole else ~side)
    right = np.flatnonzero(~home if whole else side)
    left, right = left[np.argsort(line[left])], right[np.argsort(line[right])]
    ahead = len(left) if whole else 0
    right = np.concatenate([left, right]) if whole else right
    count, parent, forest = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids)), []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def verified(p, q):
        sums = np.add.reduceat((y[p] - y[q]) ** 2, starts, axis=1)
        away = sums.sum(1) - (2 - 2 * COSINE)
        edge = np.abs(away) <= SLACK
        ok = away < 0
        ok[edge] = (x[p[edge]] * x[q[edge]]).sum(1) >= COSINE
        ok &= (sums[:, block] <= budgets[block]) & (sums[:, :block] > budgets[:block]).all(1)
        p, q = p[ok], q[ok]
        np.add.at(count, p, size[q])
        np.add.at(count, q, size[p])
        top = parent
        while (up := top[top]).tolist() != top.tolist():
            top = up
        new = top[p] != top[q]
        for m, n in zip(p[new].tolist(), q[new].tolist(), strict=True):
            f, g = root(m), root(n)
            if f != g:
                parent[f] = g
                forest.append((m, n))

    held, n = [], 0
    for p, q in _near(own, left, right, budget, ahead):
        held.append((left[p], right[q]))
        n += len(p)
        if n > 1 << 15:
            verified(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, n = [], 0
    if held:
        verified(*(np.concatenate(c) for c in zip(*held, strict=True)))
    used = np.flatnonzero(count)
    fa, fb = (np.array([f[k] for f in forest], dtype=np.int64) for k in (0, 1))
    return pa.table({"a": pa.array(np.concatenate([ids[used], ids[fa]])), "b": pa.array([None] * len(used) + ids[fb].tolist(), pa.int64()), "n": pa.array(np.concatenate([count[used], np.zeros(len(fa), dtype=np.int64)]))})


def _trees(classes: DataFrame) -> dict:
    """Trees by (length, block), from some SAMPLE classes by hash."""
    n = classes.count()
    some = classes.where(F.pmod(F.xxhash64("class_id", F.lit(5)), F.lit(1 << 20)) < min(1 << 20, -(-(SAMPLE << 20) // max(1, n)))).select("class_id", "v")
    rows = sorted((r.class_id, r.v) for r in some.collect())
    out = {}
    for d in {len(v) for _, v in rows}:
        y = _unit(np.array([v for _, v in rows if len(v) == d], dtype=np.float64)) @ rotation(d)
        for b, (lo, hi, budget) in enumerate(bounds(d)):
            tree = grown(y[:, lo:hi], n / len(rows), _radius(budget))
            if len(tree.axis) > 1:
                out[d, b] = tree
    return out


def linked(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"
    v = F.transform("embedding", lambda x: x.cast(kind))
    sound = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", v.alias("v")).withColumn("v", F.when(sound, F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x))))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256)))
    members = staged(rows.select("vec_id", "key"), "members")
    classes = rows.where("v is not null").groupBy("key").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = staged(classes.withColumn("class_id", F.xxhash64("key")), "classes")
    trees = _trees(classes)
    slim = classes.select("class_id", "size", "v")
    crowd = slim.mapInArrow(_counted(trees), "cell long, homes long, visitors long").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors"))
    # As many rows as cells that one task doesn't take, which the sample bounds.
    crowded = {r.cell: (max(1, -(-r.homes // CHUNK)), -(-r.visitors // CHUNK)) for r in crowd.where((F.col("homes") > CHUNK) | (F.col("visitors") > CHUNK)).collect()}
    dealt = slim.mapInArrow(_dealt(trees, crowded), f"{_DEALT}, v array<{kind}>")
    found = staged(dealt.groupBy("cell", "i", "j").applyInArrow(_joined, "a long, b long, n long"), "found")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(found.where("b is not null"), "a", "b")
    named = classes.join(counts.withColumnRenamed("a", "class_id"), "class_id", "left").join(comp.withColumnRenamed("node", "class_id"), "class_id", "left")
    named = named.select("key", "least", "size", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "class_id").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("key", (F.col("n") + F.col("size") - 1).alias("n_links"), "component_id")
    out = members.join(named, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
