"""N-gram Jaccard join: exact links between documents whose sets of word n-grams have a Jaccard of at least 3/4.

PartEnum: sets fall into bands of equal size ratio. For sets of one band or two neighbouring ones, at most
k = floor(2 r (1-J)/(1+J)) features differ, r being the upper band's largest size. The feature domain is dealt into
n1 = floor(k / (DIFFER + 1)) + 1 partitions, so in one of them at most DIFFER features differ; each is dealt into CELLS cells again, and
each choice of all but DIFFER of them gives a signature (the sum of the hashes of the features that fall there, plain if k = 0).
Similar sets share one signature at least; each signature's holders are candidates, whose sets are compared exactly.

Before that, sets that can't have a partner are told by an exact count. In similar sets A and B at most |A|/4 of A's
features are missing in B, so of A's features in the lower half of the hash domain, as many but |A|/4 must stand in
another set too. That half is shuffled (8 bytes each), each set gets the number of its features that are shared, and
only sets with enough of them go on to signatures.

Shuffled are then packed signatures (8 bytes each), and the sets of documents that have a candidate. Links are
verified in rounds: first each candidate set against one partner, then what isn't connected by links yet, so a group of many
copies costs about one comparison each and no link between groups is missed. Pairs between groups are told by hubs: what links with
two sets far enough apart can't link, as differing features are a metric. The bound is that sets' counts of features (or whether they are odd) in equal shares
of the domain can't differ more than the sets do; these sketches go to the signatures, so pairs that are apart are never shuffled. Lists of hubs that share a signature meet in the part of their least hub: there a pair is
told a few times, however many signatures it shares, and by some words of bits.

Defined results: null text, or text without words: n_shingles 0, a component of its own. Fewer words than n: the whole
sequence is the one n-gram. Equal texts, ties and repeated rows: one class each, all rows return. Features are 64-bit
hashes and classes 64-bit digests of sets: two different ones coincide with a probability of pairs / 2**64.
"""

from __future__ import annotations

from itertools import combinations
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import bit_table, groups, mix, powers, span_hashes, staged, table, tidied, tidy
from waymark.llm.components import components

NUM, DEN = 3, 4  # Jaccard
WORDS = 5
#: Features that may differ in one of the partitions, cells of a partition, and the choices of cells.
DIFFER, CELLS = 2, 6
CHOSEN = np.array([[c not in out for out in combinations(range(CELLS), DIFFER)] for c in range(CELLS)], dtype=np.uint64)
#: log2 of the most bits of the table that tells texts whose classes go on (32 MB at most; beyond it, more go on than need to).
FILTER_BITS = 28
#: Pairs of hubs that a task tells at once.
PAIR_BITS = 1 << 20
#: Hubs of the longest list that goes to one part whole; pairs of longer ones are dealt by blocks.
LONG = 64
#: Pairs of a block of hubs that a task marks at once (a byte each).
MARKS = 1 << 24
#: Pairs of sets under two hubs that are told at once.
MEMBER_PAIRS = 1 << 16
#: Links whose components one task finds (64 MB); more go by rounds.
AT_ONCE = 1 << 22
HALF, _MASK = np.uint64(1 << 63), (1 << 64) - 1


def feature_sets(batch: pa.RecordBatch, words: int):
    """(row, sorted distinct 64-bit n-gram hashes) of each row of a batch."""
    mult = powers(words + 1, 0xD1342543DE82EF95)
    for first, texts in groups(batch):
        start, end, row = texts.tokens()
        h = span_hashes(texts.low, start, end)
        bounds = np.searchsorted(row, np.arange(texts.n + 1))
        m = len(h) - words + 1
        if m > 0:
            g = np.zeros(m, dtype=np.uint64)
            for i in range(words):
                g += h[i : m + i] * mult[i]
            g = mix(g)
        for r in range(texts.n):
            a, b = int(bounds[r]), int(bounds[r + 1])
            if b - a >= words:
                yield first + r, np.unique(g[a : b - words + 1])
            elif b > a:
                yield first + r, mix((h[a:b] * mult[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield first + r, np.zeros(0, dtype=np.uint64)


def digest(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set, not 0 for a set with features."""
    with np.errstate(over="ignore"):
        d = mix(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))], dtype=np.uint64))
    return int(d.astype(np.int64)[0]) or 1


def _bands(most: int) -> list[int]:
    """The largest sizes of the bands, in order."""
    out, low = [], 1
    while low <= most:
        high = low * DEN // NUM
        out.append(high)
        low = high + 1
    return out


BANDS = np.array(_bands(1 << 40))


def signatures(s: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a set: with its own band, the next and the one before."""
    band = int(np.searchsorted(BANDS, len(s)))
    out = []
    for b, across in ((band, 0), (band, 1), (band - 1, 1)):
        if b < 0:
            continue
        # Most features that differ between sets of band b, or between one of it and one of the next band.
        k = int(2 * BANDS[b] * (DEN - NUM) // (DEN + NUM)) if not across else int((BANDS[b] + min(BANDS[b + 1], BANDS[b] * DEN // NUM)) * (DEN - NUM) // (DEN + NUM))
        salt = np.uint64((2 * b + across + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)
        if not k:
            out.append(mix(s.sum(keepdims=True) + salt))
            continue
        n1 = k // (DIFFER + 1) + 1
        m = mix(s ^ salt)
        cell = ((m >> np.uint64(32)) * np.uint64(n1) >> np.uint64(32)) * np.uint64(CELLS) + (m & np.uint64(0xFFFF)) % np.uint64(CELLS)
        cell = cell.astype(np.int64)
        low = np.bincount(cell, (m & np.uint64(0xFFFFFFFF)).astype(float), CELLS * n1)
        high = np.bincount(cell, (m >> np.uint64(32)).astype(float), CELLS * n1)
        sums = (low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))).reshape(n1, CELLS)
        signed = (sums @ CHOSEN).ravel()
        out.append(mix(signed + salt + np.arange(len(signed), dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    return np.concatenate(out)


_SENT = "part int, packed binary, ids binary"
_MEMBERS = f"{_SENT}, doc_id long, n_shingles long, n_half long, class_id long, text_id long"
_SIGNED = f"{_SENT}, class_id long, sketch binary, features binary"


def _rows(schema: str, **cols) -> pa.RecordBatch:
    """A batch of the schema, null where no column is given."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    n = len(next(iter(cols.values())))
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(cols[k], kinds[v]) if k in cols else pa.nulls(n, kinds[v]) for k, v in fields], [k for k, _ in fields])


class _Packer:
    """By part, hashes of sets: gaps of the sorted upper 32 bits, and the set's number among the part's ids, byte plane by byte plane (the high ones compress away)."""

    def __init__(self, parts: int):
        self.parts = parts
        self.clear()

    def clear(self):
        self.sigs, self.owners, self.ids, self.size = [], [], [], 0

    def add(self, ident: int, sigs: np.ndarray):
        self.sigs.append(sigs)
        self.owners.append(len(sigs))
        self.ids.append(ident)
        self.size += len(sigs)

    def full(self) -> bool:
        return self.size > 1_000_000 or len(self.ids) >= 60_000

    def flush(self) -> dict:
        sig, own = np.concatenate(self.sigs), np.repeat(np.arange(len(self.ids), dtype=np.uint64), self.owners)
        ids = np.array(self.ids, dtype=np.int64)
        self.clear()
        part = ((sig & np.uint64(0xFFFFFF)) * np.uint64(self.parts) >> np.uint64(24)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        packed = ((sig >> np.uint64(32) << np.uint64(16)) | own)[order]
        bounds = np.searchsorted(part[order], np.arange(self.parts + 1))
        used = np.flatnonzero(np.diff(bounds))
        blobs, names = [], []
        for p in used:
            x = np.sort(packed[bounds[p] : bounds[p + 1]])
            o, back = np.unique(x & np.uint64(0xFFFF), return_inverse=True)
            gaps = np.diff(x >> np.uint64(16), prepend=np.uint64(0)).astype("<u4")
            blobs.append(gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + back.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())
            names.append(ids[o.astype(np.int64)].tobytes())
        return {"part": used.astype(np.int32), "packed": blobs, "ids": names}


def _members(words: int, parts: int):
    """Of each row its set's size, features in the lower half, and class; and the packed lower halves of a task's distinct sets."""

    def run(batches):
        seen, packer = set(), _Packer(parts)
        for batch in batches:
            n, half, d = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for r, s in feature_sets(batch, words):
                n[r] = len(s)
                if len(s):
                    half[r], d[r] = np.searchsorted(s, HALF), digest(s)
                    if (c := int(d[r])) not in seen:
                        seen.add(c)
                        packer.add(c, _lower(s))
                        if packer.full():
                            yield _rows(_MEMBERS, **packer.flush())
                            seen = seen if len(seen) < 2_000_000 else set()
            doc, text = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_id"))
            yield _rows(_MEMBERS, part=np.arange(len(n), dtype=np.int32) % parts, doc_id=doc, n_shingles=n, n_half=half, class_id=d, text_id=text)
        if packer.ids:
            yield _rows(_MEMBERS, **packer.flush())

    return run


def _signed(words: int, parts: int, admit):
    """Of the distinct sets of a task whose texts the bit table admits: class, sketch and features; and their packed signatures."""

    def run(batches):
        seen, packer, admitted = set(), _Packer(parts), _admitted(admit)
        for batch in batches:
            sets = []
            for _, s in feature_sets(batch.filter(admitted(batch.column(batch.schema.get_field_index("text_id")))), words):
                if not len(s) or (d := digest(s)) in seen:
                    continue
                seen.add(d)
                sets.append(((d & _MASK) % parts, d, sketch(s), s.tobytes()))
                packer.add(d, signatures(s))
                if packer.full():
                    yield _rows(_SIGNED, **packer.flush())
                    seen = seen if len(seen) < 2_000_000 else set()
            for i in range(0, len(sets), 1000):
                yield _rows(_SIGNED, **dict(zip(("part", "class_id", "sketch", "features"), zip(*sets[i : i + 1000], strict=True), strict=True)))
        if packer.ids:
            yield _rows(_SIGNED, **packer.flush())

    return run


def _lower(s: np.ndarray) -> np.ndarray:
    return mix(s[: np.searchsorted(s, HALF)])


def _sorted_holders(t) -> tuple[np.ndarray, np.ndarray]:
    """Of one part: holders by hash, each once, and where each hash begins."""
    sig, own = [], []
    for packed, ids in zip(t.column("packed"), t.column("ids"), strict=True):
        planes = np.frombuffer(packed.as_buffer(), dtype=np.uint8).reshape(6, -1)
        names = np.frombuffer(ids.as_buffer(), dtype=np.int64)
        sig.append(np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel().astype(np.int64)))
        own.append(names[np.ascontiguousarray(planes[4:].T).view("<u2").ravel()])
    sig, own = np.concatenate(sig), np.concatenate(own)
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])])
    sig, own = sig[keep], own[keep]
    return own, np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]]))


def _split(t) -> tuple[pa.Table, pa.Table]:
    """Packed rows, and the others."""
    packed = t.column("packed").is_valid()
    return t.filter(packed), t.filter(pa.compute.invert(packed))


_COUNTED = "part int, ids binary, times binary, doc_id long, n_shingles long, n_half long, class_id long, text_id long"


def _shared(parts: int):
    def run(key, t):
        """Of one part: for each class, how many of its features another class has too, packed by the class's part; and the members that came along."""
        tidy()
        packed, rest = _split(t)
        out = [pa.Table.from_batches([_rows(_COUNTED, **{c: rest.column(c).combine_chunks() for c in ("doc_id", "n_shingles", "n_half", "class_id", "text_id")})])] if rest.num_rows else []
        if packed.num_rows:
            own, cut = _sorted_holders(packed)
            n = np.diff(cut)
            ids, times = np.unique(own[np.repeat(n > 1, n)], return_counts=True)
            part = (ids.astype(np.uint64) >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            ids, times, part = ids[order], times[order].astype("<u4"), part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            used = np.flatnonzero(np.diff(cuts))
            blobs = [(ids[cuts[p] : cuts[p + 1]].tobytes(), times[cuts[p] : cuts[p + 1]].view(np.uint8).reshape(-1, 4).T.tobytes()) for p in used]
            if blobs:
                out.append(pa.Table.from_batches([_rows(_COUNTED, part=used.astype(np.int32), ids=[x for x, _ in blobs], times=[y for _, y in blobs])]))
        return pa.concat_tables(out) if out else pa.Table.from_batches([_rows(_COUNTED, part=np.zeros(0, dtype=np.int32))])

    return run


def _added(key, t):
    """Of one part: classes with their counts from all parts."""
    ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t.column("ids")])
    times = np.concatenate([np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1).T).view("<u4").ravel() for x in t.column("times")])
    uniq, back = np.unique(ids, return_inverse=True)
    return pa.table({"class_id": pa.array(uniq), "n": pa.array(np.bincount(back, times, len(uniq)).astype(np.int64))})


_MERGED = "part int, owners binary, sizes binary, class_id long, sketch binary, features binary"


def _merged(key, t):
    """Of one part: the holders of each signature that more than one class has, in one row; and each set that came along once."""
    tidy()
    packed, rest = _split(t)
    out = []
    if packed.num_rows:
        own, cut = _sorted_holders(packed)
        n = np.diff(cut)
        owners = own[np.repeat(n > 1, n)]
        out.append(pa.Table.from_batches([_rows(_MERGED, part=np.array([t.column("part")[0].as_py()], dtype=np.int32), owners=[owners.tobytes()], sizes=[n[n > 1].astype(np.int32).tobytes()])]))
    if rest.num_rows:
        _, first = np.unique(np.asarray(rest.column("class_id").combine_chunks()), return_index=True)
        rest = rest.take(pa.array(first)).combine_chunks()
        out.append(pa.Table.from_batches([_rows(_MERGED, **{c: rest.column(c).combine_chunks() for c in ("class_id", "sketch", "features")})]))
    return pa.concat_tables(out)


def _runs(owners, sizes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(sizes.as_buffer(), np.int32)
    return np.frombuffer(owners.as_buffer(), np.int64), np.concatenate([[0], np.cumsum(n)])


def _proposed(batches):
    """Pairs of the first holder of a signature with each other one, and how often, by part."""
    for batch in batches:
        names = batch.schema.names
        for owners, sizes in zip(batch.column(names.index("owners")), batch.column(names.index("sizes")), strict=True):
            own, cut = _runs(owners, sizes)
            first, keep = np.repeat(own[cut[:-1]], np.diff(cut)), np.ones(len(own), dtype=bool)
            keep[cut[:-1]] = False
            if keep.any():
                pairs, times = np.unique(np.stack([first[keep], own[keep]], 1), axis=0, return_counts=True)
                yield _rows("a long, b long, n long", a=pairs[:, 0], b=pairs[:, 1], n=times.astype(np.int64))


def _placed(batches):
    """part, node: the classes that each part has signatures of."""
    for batch in batches:
        names = batch.schema.names
        for part, owners in zip(batch.column(names.index("part")), batch.column(names.index("owners")), strict=True):
            x = np.unique(np.frombuffer(owners.as_buffer(), np.int64))
            yield _rows("part int, node long", part=np.full(len(x), part.as_py(), dtype=np.int32), node=x)


_MIXED = "part int, hubs binary, sizes binary"


def _groups(parts: int) -> int:
    """Groups that hubs of long lists fall into; their pairs make the blocks, some parts / 8 of them."""
    return max(4, isqrt(parts) // 2)


def _group(hubs: np.ndarray, groups: int) -> np.ndarray:
    return (mix(hubs.view(np.uint64) ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(groups)).astype(np.int64)


def _in_blocks(hs: np.ndarray, n: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists hs of n hubs each, cut into what each pair of groups holds of them: part (beyond the others), number of hubs, and hubs."""
    groups = _groups(parts)
    x, y = np.tile(_group(hs, groups), groups), np.repeat(np.arange(groups), len(hs))
    to, which, hs = parts + np.minimum(x, y) * groups + np.maximum(x, y), np.tile(np.repeat(np.arange(len(n)), n), groups), np.tile(hs, groups)
    order = np.argsort(place := to * len(n) + which, kind="stable")  # lists ascend already
    to, x, hs = to[order], x[order], hs[order]
    first = np.flatnonzero(np.diff(place[order], prepend=-1))
    n, to = np.diff(first, append=len(hs)), to[first]
    low, high = np.divmod(to - parts, groups)
    keep = (n > 1) & ((low == high) | (np.minimum.reduceat(x, first) != np.maximum.reduceat(x, first)))
    return to[keep], n[keep], hs[np.repeat(keep, n)]


def _mixed(parts: int):
    def run(key, t, c):
        """Of one part: the hubs of the holders of each signature that spans components, each list once, by the part of the list's least hub.

        What several signatures say of one group comes together there, so a pair is told a few times and not once a signature. Long lists, most of
        whose pairs stand in many of them, go by blocks instead: a pair is told in one of them, and no part gets all pairs of a large group.
        """
        tidy()
        empty = np.zeros(0, dtype=np.int64)
        node, comp, hub = (np.asarray(c.column(x).combine_chunks()) if c.num_rows else empty for x in ("node", "component", "hub"))
        order = np.argsort(node)
        node, comp, hub = node[order], comp[order], hub[order]
        out = [_rows(_MIXED, part=np.zeros(0, dtype=np.int32))]
        for owners, sizes in zip(t.column("owners"), t.column("sizes"), strict=True):
            own, cut = _runs(owners, sizes)
            if not len(own):
                continue
            cs, hs = own, own
            if len(node):
                at = np.minimum(np.searchsorted(node, own), len(node) - 1)
                cs, hs = np.where(node[at] == own, comp[at], own), np.where(node[at] == own, hub[at], own)
            spans = np.maximum.reduceat(cs, cut[:-1]) != np.minimum.reduceat(cs, cut[:-1])
            if not spans.any():
                continue
            where = np.repeat(np.arange(len(spans)), np.diff(cut))
            where, hs = where[np.repeat(spans, np.diff(cut))], hs[np.repeat(spans, np.diff(cut))]
            order = np.lexsort((hs, where))
            where, hs = where[order], hs[order]
            keep = np.concatenate([[True], (where[1:] != where[:-1]) | (hs[1:] != hs[:-1])])
            hs, first = hs[keep], np.flatnonzero(np.concatenate([[True], np.diff(where[keep]) != 0]))
            n = np.diff(first, append=len(hs))
            marks = mix(np.add.reduceat(mix(hs.view(np.uint64)), first) + n.astype(np.uint64))
            _, once = np.unique(marks, return_index=True)
            to = (mix(hs[first[once]].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            once = once[order := np.argsort(to, kind="stable")]
            to, n = to[order], n[once]
            ends = np.concatenate([[0], np.cumsum(n)])
            hs = hs[np.repeat(first[once] - ends[:-1], n) + np.arange(ends[-1])]
            if (long := n > LONG).any():
                more = _in_blocks(hs[np.repeat(long, n)], n[long], parts)
                to, n, hs = (np.concatenate([a, b]) for a, b in zip((to[~long], n[~long], hs[np.repeat(~long, n)]), more, strict=True))
                ends = np.concatenate([[0], np.cumsum(n)])
            used = np.unique(to)
            low, high = np.searchsorted(to, used), np.searchsorted(to, used, side="right")
            blobs = [(hs[ends[x] : ends[y]].tobytes(), n[x:y].astype(np.int32).tobytes()) for x, y in zip(low, high, strict=True)]
            out.append(_rows(_MIXED, part=used, hubs=[x for x, _ in blobs], sizes=[y for _, y in blobs]))
        return pa.Table.from_batches(out)

    return run


def _held(batches):
    """place, hub: the hubs that the lists of each part hold."""
    for batch in batches:
        for part, hubs in zip(batch.column(0), batch.column(1), strict=True):
            x = np.unique(np.frombuffer(hubs.as_buffer(), np.int64))
            yield _rows("place int, hub long", place=np.full(len(x), part.as_py(), dtype=np.int32), hub=x)


def _pairs(lists: list[tuple[np.ndarray, np.ndarray]], n: int):
    """Pairs i < j of numbers under n that stand in one list, as i * n + j; some PAIR_BITS at once, each once among those. lists: ascending runs (numbers, bounds)."""
    by_size: dict[int, list] = {}
    for at, cut in lists:
        sizes = np.diff(cut)
        for m in np.unique(sizes):
            by_size.setdefault(int(m), []).append(at[cut[:-1][sizes == m][:, None] + np.arange(m)])
    held, size = [], 0
    for m in sorted(by_size):
        same = np.unique(np.concatenate(by_size.pop(m)), axis=0)
        # Rows of the triangle, then lists, that make no more pairs than are told at once.
        rows, low = max(1, PAIR_BITS // m), 0
        while low < m - 1:
            x, y = (k + low for k in np.nonzero(np.arange(low, min(low + rows, m))[:, None] < np.arange(low, m)[None]))
            low += rows
            step = max(1, PAIR_BITS // len(x))
            for k in range(0, len(same), step):
                held.append((same[k : k + step, x] * n + same[k : k + step, y]).ravel())
                size += len(held[-1])
                if size >= PAIR_BITS:
                    yield np.unique(np.concatenate(held))
                    held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held))


def _crossed(lists: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray, n: int):
    """Pairs i < j of numbers under n, one of left and one of right (the same, or without a common one), that stand in one list, as i * n + j; each once, at most PAIR_BITS at once."""
    of_left, of_right = (np.full(n, -1) for _ in range(2))
    of_left[left], of_right[right] = np.arange(len(left)), np.arange(len(right))
    runs = [(of_left[own], of_right[own]) for at, cut in lists for own in np.split(at, cut[1:-1])]
    runs = [(a[a >= 0], b[b >= 0]) for a, b in runs]
    step = max(1, MARKS // max(1, len(right)))
    for low in range(0, len(left), step):
        seen = np.zeros((min(step, len(left) - low), len(right)), dtype=bool)
        for a, b in runs:
            a = a[np.searchsorted(a, low) : np.searchsorted(a, low + step)] - low
            seen[a[:, None], b] = True
        seen = seen.ravel()
        for k in range(0, len(seen), PAIR_BITS):
            i, j = np.divmod(np.flatnonzero(seen[k : k + PAIR_BITS]) + k, len(right))
            i, j = left[i + low], right[j]
            codes = np.minimum(i, j) * n + np.maximum(i, j)
            yield codes[i < j] if left is right else codes


def _near(key, t, s, parts: int = 0):
    """Of one part: pairs of hubs that stand in one list, and in different components, and aren't apart by their sketches. Parts from `parts` on are blocks."""
    tidy()
    hub, comp, reach, most, wide = (s.column(c).combine_chunks() for c in ("hub", "component", "reach", "most", "wide"))
    order = np.argsort(np.asarray(hub))
    hub, comp, reach, most = (np.asarray(c)[order] for c in (hub, comp, reach, most))
    sketches = Sketches([wide[int(i)].as_buffer() for i in order])
    lists = []
    for hubs, sizes in zip(t.column("hubs"), t.column("sizes"), strict=True):
        own, cut = _runs(hubs, sizes)
        lists.append((np.searchsorted(hub, own), cut))
    found = [np.zeros(0, dtype=np.int64)]
    if parts and (part := t.column("part")[0].as_py()) >= parts:
        x, y = divmod(part - parts, _groups(parts))
        group = _group(hub, _groups(parts))
        left = np.flatnonzero(group == x)
        told = _crossed(lists, left, left if x == y else np.flatnonzero(group == y), len(hub))
    else:
        told = _pairs(lists, len(hub))
    for codes in told:
        i, j = np.divmod(codes, len(hub))
        differ = comp[i] != comp[j]
        codes, i, j = codes[differ], i[differ], j[differ]
        found.append(codes[~sketches.apart(i, j, reach[i] + reach[j] + most[i] + most[j])])
    i, j = np.divmod(np.unique(np.concatenate(found)), max(1, len(hub)))
    return pa.table({"a": pa.array(hub[i]), "b": pa.array(hub[j])})


def wide_sketch(s: np.ndarray) -> bytes:
    """Size of a set, then one bit for each of 4 to 8 equal shares of the domain a feature: whether an odd number of features falls there."""
    bits = max(6, (4 * len(s)).bit_length())
    odd = np.bincount((s & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits).astype(np.uint8) & 1
    return len(s).to_bytes(8, "little") + np.packbits(odd, bitorder="little").tobytes()


class Sketches:
    """Wide sketches of sets, to be compared with each other.

    Shares are told by the lower bits of features, so a sketch's halves, one upon the other, are the sketch of half as many shares.
    """

    def __init__(self, wide: list):
        raw = [np.frombuffer(x, "<u8") for x in wide]
        self.size = np.array([x[0] for x in raw], dtype=np.int64)
        self.length = np.array([len(x) - 1 for x in raw], dtype=np.int64)
        self.place = np.zeros(len(raw), dtype=np.int64)  # within the sketches of that length
        self.of = {}
        for n in np.unique(self.length):
            at = np.flatnonzero(self.length == n)
            self.place[at] = np.arange(len(at))
            self.of[int(n), int(n)] = np.stack([raw[i][1:] for i in at])

    def _folded(self, n: int, words: int) -> np.ndarray:
        """The sketches of n words, in so many."""
        if (n, words) not in self.of:
            twice = self._folded(n, 2 * words)
            self.of[n, words] = twice[:, :words] ^ twice[:, words:]
        return self.of[n, words]

    def distance(self, i, j: np.ndarray, fold: int = 0) -> np.ndarray:
        """At most as many features as differ between sets i (one, or one a set j) and sets j. fold: how often sketches are halved before."""
        i = np.broadcast_to(i, len(j))
        out = np.abs(self.size[j] - self.size[i])
        lengths = self.length[i] << 32 | self.length[j]
        for both in np.unique(lengths):
            n, m = int(both) >> 32, int(both) & 0xFFFFFFFF
            words, at = max(1, min(n, m) >> fold), np.flatnonzero(lengths == both)
            x, y = self._folded(n, words), self._folded(m, words)
            step = max(1, (1 << 17) // words)
            for s in range(0, len(at), step):
                k = at[s : s + step]
                d = np.bitwise_count(x[self.place[i[k]]] ^ y[self.place[j[k]]]).sum(1, dtype=np.int64)
                out[k] = np.maximum(out[k], d)
        return out

    def apart(self, i, j: np.ndarray, allowed) -> np.ndarray:
        """Whether no set with hub i (one, or one a hub j) can link with one that has hub j.

        Differing features are a metric: sets u, v that link with hubs x, y differ in at least |x - y| - (|u| + |x|) / 7 - (|v| + |y|) / 7, and link
        only at (|u| + |v|) / 7 or less. allowed: the largest |u| + |x| (0 if x is alone), |v| + |y|, |u| and |v|, added.
        """
        i, allowed = np.broadcast_to(i, len(j)), np.broadcast_to(allowed, len(j))
        out = (DEN + NUM) * np.abs(self.size[j] - self.size[i]) > (DEN - NUM) * allowed
        for fold in (2, 0):
            left = np.flatnonzero(~out)
            out[left] = (DEN + NUM) * self.distance(i[left], j[left], fold) > (DEN - NUM) * allowed[left]
        return out


def _widened(batches):
    for batch in batches:
        names = batch.schema.names
        sets = batch.column(names.index("features"))
        yield pa.RecordBatch.from_arrays([batch.column(names.index("class_id")), pa.array([wide_sketch(np.frombuffer(x.as_buffer(), np.uint64)) for x in sets], pa.binary())], ["class_id", "wide"])


def _hubs(links: DataFrame, comp: DataFrame) -> DataFrame:
    """node, component, hub: a node's hub is itself, or the neighbour with most links if that has more, so everything links with its hub."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy("a").agg(F.count("*").alias("d"))
    around = both.join(degree.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max(F.struct("d", "b")).alias("top"))
    hubs = degree.join(around, "a").select(F.col("a").alias("node"), F.when(F.struct("d", "a") < F.col("top"), F.col("top.b")).otherwise(F.col("a")).alias("hub"))
    return staged(comp.join(hubs, "node"), "hubs")


def _near_hubs(signed: DataFrame, sets: DataFrame, assigned: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) of hubs in different components whose members signatures propose and the hubs' distance doesn't rule out.

    Pairs are told apart where the signature is, by sketches that go there: one for each hub and part with a signature that spans
    components, so at most one for each signature. What is proposed and apart makes no row.
    """
    parts = max(64, signed.count())  # a row a part
    known = signed.mapInArrow(_placed, "part int, node long").join(assigned, "node")
    lists = staged(signed.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_mixed(parts), _MIXED), "mixed")
    placed = staged(lists.mapInArrow(_held, "place int, hub long").distinct(), "placed")
    wide = sets.select("class_id", "features").join(placed.select(F.col("hub").alias("class_id")).distinct(), "class_id", "left_semi").mapInArrow(_widened, "class_id long, wide binary")
    of = lambda c, to: sizes.select(F.col("class_id").alias(c), F.col("size").alias(to))
    spread = assigned.where("node <> hub").join(of("node", "s"), "node").join(of("hub", "h"), "hub").groupBy(F.col("hub").alias("class_id")).agg(F.max(F.col("s") + F.col("h")).alias("reach"), F.max("s").alias("largest"))
    wide = wide.join(sizes.select("class_id", "size"), "class_id").join(spread, "class_id", "left").join(assigned.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    wide = wide.select(
        F.col("class_id").alias("hub"), "wide", F.coalesce("component", "class_id").alias("component"),
        F.coalesce("reach", F.lit(0)).alias("reach"), F.greatest("size", F.coalesce("largest", F.lit(0))).alias("most"),
    )
    near = lists.groupBy("part").cogroup(placed.join(staged(wide, "wide"), "hub").groupBy("place")).applyInArrow(lambda key, t, s: _near(key, t, s, parts), "a long, b long")
    return staged(near.distinct(), "near-hubs")


def _linked_members(key, t, s):
    """Of one block: links between what has one hub of a pair and what has the other. A pair of hubs whose components are connected already is passed over."""
    tidy()
    node, comp, hub = (np.asarray(s.column(c).combine_chunks()) for c in ("node", "component", "hub"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in s.column("features")]
    brief = Sketches([wide_sketch(x) for x in sets])
    order = np.argsort(hub, kind="stable")
    under = lambda h: order[np.searchsorted(hub, h, sorter=order) : np.searchsorted(hub, h, "right", sorter=order)]
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    def link(left, right):
        """A link between the sets left and the sets right."""
        step = max(1, MEMBER_PAIRS // len(right))
        for k in range(0, len(left), step):
            i, j = np.repeat(left[k : k + step], len(right)), np.tile(right, len(left[k : k + step]))
            for n in np.flatnonzero(~brief.apart(i, j, brief.size[i] + brief.size[j])):
                if _link(sets[i[n]], sets[j[n]]):
                    return i[n], j[n]

    found = []
    for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True):
        left, right = under(a), under(b)
        if len(left) and len(right):  # what has one hub is one component
            x, y = find(int(comp[left[0]])), find(int(comp[right[0]]))
            if x != y and (pair := link(left, right)):
                root[max(x, y)] = min(x, y)
                found.append((node[pair[0]], node[pair[1]]))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64()), "n": pa.array([1] * len(found), pa.int64())})


def _block(total: int, least: int = 6):
    """Of pairs (a, b) of hubs the pair of groups they belong to; a block is some 16 MB of sets."""
    g = max(least, -(-total // (8 << 20)))
    x, y = (F.pmod(F.xxhash64(F.col(c), F.lit(9)), F.lit(g)) for c in ("a", "b"))
    return F.least(x, y) * g + F.greatest(x, y)


def _member_links(near: DataFrame, sets: DataFrame, assigned: DataFrame, comp: DataFrame) -> DataFrame:
    """Links (a, b, n) between members of near hubs (a, b)."""
    ends = near.select(F.explode(F.array("a", "b")).alias("hub")).distinct()
    every = assigned.select("hub", "node").join(ends, "hub", "left_semi").union(ends.select("hub", F.col("hub").alias("node"))).distinct()
    now = comp.select(F.col("node"), "component")
    nodes = every.join(now, "node", "left").join(sets.select(F.col("class_id").alias("node"), "features"), "node")
    nodes = staged(nodes.select("hub", "node", F.coalesce("component", "node").alias("component"), "features"), "members")
    total = nodes.agg(F.sum(F.length("features"))).first()[0] or 0
    pairs = near.select("a", "b", _block(total).alias("block"))
    dealt = pairs.select(F.col("block").alias("place"), F.explode(F.array("a", "b")).alias("hub")).distinct().join(nodes, "hub")
    return pairs.groupBy("block").cogroup(dealt.groupBy("place")).applyInArrow(_linked_members, "a long, b long, n long")


def _table_of(rows: DataFrame, col: str):
    """A bit table of bounded size, broadcast: whether a hash that starts so stands in the column."""
    bits = min(FILTER_BITS, max(16, int(rows.agg(F.approx_count_distinct(col)).first()[0]).bit_length() + 6))
    return rows.sparkSession.sparkContext.broadcast((bits, bit_table(rows.select(F.shiftrightunsigned(col, 64 - bits).alias("s")), "s", bits)))


def _admitted(admit):
    """Which of a column of hashes the table admits."""
    bits, packed = admit.value

    def run(col: pa.Array) -> pa.Array:
        x = np.asarray(col).view(np.uint64) >> np.uint64(64 - bits)
        return pa.array((packed[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool))

    return run


def sketch(s: np.ndarray) -> bytes:
    """Size of a set, then how many of its features fall into each of 16 or more equal ranges of the domain (255 at most)."""
    bits = max(4, (len(s) // 4).bit_length())
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return len(s).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes()


def _may_link(x: bytes, y: bytes) -> bool:
    """Sets link if at most a seventh of the sum of their sizes differs; the difference of counts is a lower bound."""
    total = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
    p, q = np.frombuffer(x, np.uint8, offset=8).astype(np.int64), np.frombuffer(y, np.uint8, offset=8).astype(np.int64)
    if len(p) != len(q):  # a clipped count can't be summed
        if max(p.max(), q.max()) == 255:
            return True
        n = min(len(p), len(q))
        p, q = p.reshape(n, -1).sum(1), q.reshape(n, -1).sum(1)
    return (DEN + NUM) * int(np.abs(p - q).sum()) <= (DEN - NUM) * total


def _kept(test):
    """Pairs whose x and y pass the test."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            x, y = batch.column(names.index("x")), batch.column(names.index("y"))
            keep = pa.array([test(x[i].as_buffer().to_pybytes(), y[i].as_buffer().to_pybytes()) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)).filter(keep) for c in ("a", "b", "n")], ["a", "b", "n"])

    return run


def _link(x: bytes, y: bytes) -> bool:
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(p, q, assume_unique=True))
    return DEN * both >= NUM * (len(p) + len(q) - both)


def _passed(pairs: DataFrame, sets: DataFrame, col: str, test) -> DataFrame:
    """The pairs (a, b, n) whose sets, or their sketches, pass the test."""
    x, y = (sets.select(F.col("class_id").alias(k), F.col(col).alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").mapInArrow(_kept(test), "a long, b long, n long")


def jaccard_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, class_id (null: no words; equal sets share it), component_id of every row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_id"))
    parts = max(64, 2 * docs.rdd.getNumPartitions())
    first = docs.mapInArrow(tidied(_members(words, parts)), _MEMBERS).groupBy("part").applyInArrow(_shared(parts), _COUNTED)
    first = staged(first, "members")
    members = first.where("part is null").select("doc_id", "n_shingles", "n_half", "class_id", "text_id")
    common = first.where("part is not null").select("part", "ids", "times").groupBy("part").applyInArrow(_added, "class_id long, n long")
    sizes = members.where("n_shingles > 0").groupBy("class_id").agg(F.first("n_shingles").alias("size"), F.first("n_half").alias("half"))
    # A class without a count may still have a partner where nothing must be shared.
    onward = staged(sizes.join(common, "class_id", "left").where(F.coalesce("n", F.lit(0)) >= F.col("half") - F.floor(F.col("size") * (DEN - NUM) / DEN)).select("class_id"), "onward")
    # Only texts of those classes are cut into words again.
    texts = members.join(onward, "class_id", "left_semi").select("text_id")
    merged = docs.mapInArrow(tidied(_signed(words, parts, _table_of(texts, "text_id"))), _SIGNED).groupBy("part").applyInArrow(_merged, _MERGED)
    merged = staged(merged, "signed")
    signed = merged.where("part is not null").select("part", "owners", "sizes")
    sets = merged.where("class_id is not null").select("class_id", "sketch", "features")
    proposed = signed.mapInArrow(_proposed, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # Of the first holder of each signature with the others, the likeliest pair of each set.
    once = proposed.groupBy("b").agg(F.max(F.struct("n", "a")).alias("top")).select(F.col("top.a").alias("a"), "b", F.col("top.n").alias("n"))
    links = staged(_passed(once, sets, "features", _link), "links")
    comp = components(links, "a", "b", at_once=AT_ONCE)
    # Between components: first hubs themselves, then what has hubs that are near each other and still apart.
    assigned = _hubs(links, comp)
    near = _near_hubs(signed, sets, assigned, sizes).withColumn("n", F.lit(1).cast("long"))
    links = staged(links.unionByName(_passed(_passed(near, sets, "sketch", _may_link), sets, "features", _link)), "links")
    comp = components(links, "a", "b", at_once=AT_ONCE)
    links = staged(links.unionByName(_member_links(_apart(near, comp), sets, assigned, comp)), "links")
    comp = components(links, "a", "b", at_once=AT_ONCE)
    classes = members.where("n_shingles > 0").groupBy("class_id").agg(F.min("doc_id").alias("first_id"))
    named = classes.join(comp.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select("class_id", "component_id")
    return (
        members.join(named, "class_id", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class_id")).alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends no chain of links connects."""
    a = comp.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "n")


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays, with its own columns.

    Rows are told by a 64-bit hash of doc_id and text, so a doc_id that is null or stands for several texts loses none: rows
    with the same doc_id and the same text are one, null comes after all ids, and of equal ids the least hash stays.
    """
    key, columns = "_row_key", docs.columns
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))
    comp = jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), words).select(F.col("doc_id").alias(key), "component_id").distinct()
    ids = keyed.select(key, "doc_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", key)).alias("least")
    keep = comp.join(ids, key).groupBy("component_id").agg(least).select(F.col(f"least.{key}").alias(key))
    return keyed.join(keep, key, "left_semi").dropDuplicates([key]).select(columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")
