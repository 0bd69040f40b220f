"""MinHash near-duplicates with an LSH forest.

Texts with the same set of shingles form one class from the start, so copies are never compared. Each class has a
signature of minimum hashes. A tree of the forest is an order: the classes sorted by a stretch of the signature of
their own. In a sorted order the classes that share the longest prefixes are neighbours; the more classes of a region
share a prefix, the deeper the prefix by which the next neighbours agree, so the depth adapts to the region. Every
class is held against the `reach` classes of other components before and behind it that share at least `depth` values,
however many of its own component lie between. Of these pairs a sketch of the sets
tells those that are worth a look at the texts (see `_likely`).

A first pass takes for each class its likeliest partner. Its links are confirmed on full shingle sets and joined into
components. A second pass over the same orders takes every likely pair, near or far in similarity, whose components
differ, so that large groups of copies, whose members all lie in one component by then, cost no pairs.

Where other components fill a row's window, or a partition ends in it, the row sees its partners only as deep as the
window reaches: the pass measures that depth, and from it follows the chance that all orders miss a partner. Rows for which that chance is
above `MISS` get further orders, of more values by hash functions of their own, until it is not. So a dense region
of unlike texts is not cut off at the window but sorted again and again, as often as its depth asks.

Orders are range-partitioned by (tree, prefix, id) and so no region, however dense, meets in one task; pairs across a
partition's edge are found in groups of the rows on either side, and rows too far from the edge count it as the end of
their window.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import discard, materialise, skew_join, small_enough
from quiverlake.llm.components import connected, merged

SHINGLE, TREES, LEVELS = 5, 12, 8
HASHES = TREES * LEVELS
#: Bits in each half of a set's sketch, and the largest set that is sketched whole; of larger ones a half, a quarter and so on of their shingles are.
BITS, WHOLE = 512, 512
#: 64-bit numbers in a sketch: its two halves, and one with the scale and the sizes of the halves.
SKETCH = 2 * BITS // 64 + 1
#: Values of further orders, the chance at which a pair of 75 % may be missed before there are no more of them, and how many are made before it is measured again.
LONG, MISS, ROUND = 16, 1e-4, 64
#: Rows of other components on either side that a row is held against: in the first pass, in the second, and in further orders.
REACH = (16, 256, 512)
#: Rows of sorted orders that a task takes at once.
PART_ROWS = 40_000
#: Pairs at most (16 bytes each) that are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_PAIRS = 1_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles, A-Z lower-cased; with fewer words the whole sequence is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = len(words) - n + 1
    out = h[:m] * _MIX[0]
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _MIX[k % 5] + h[k : k + m]
    out = (out ^ (out >> np.uint64(32))) * _MIX[2]
    out ^= out >> np.uint64(29)
    out.sort()
    return out if m == 1 else out[np.r_[True, out[1:] != out[:-1]]]


@lru_cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    return rng.integers(0, 2**31, (HASHES, 1), np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, (HASHES, 1), np.uint32)


@lru_cache(maxsize=256)
def _drawn(tree: int) -> tuple[np.ndarray, np.ndarray]:
    """LONG hash functions of a further order's own."""
    rng = np.random.default_rng([2, tree])
    return rng.integers(0, 2**31, (LONG, 1), np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, (LONG, 1), np.uint32)


def minima(sh: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 2048) -> bytes:
    """The minimum of each hash function, mixed down to 16 bits."""
    low = sh.astype(np.uint32)
    best = (low[:step] * a + b).min(axis=1)
    for k in range(step, len(low), step):
        best = np.minimum(best, (low[k : k + step] * a + b).min(axis=1))
    best = (best ^ (best >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (best >> np.uint32(16)).astype(">u2").tobytes()


def signature(sh: np.ndarray) -> bytes:
    """HASHES minimum hashes of 16 bits each, and then the sketch."""
    return minima(sh, *_functions()) + sketch(sh)


def sketch(sh: np.ndarray) -> bytes:
    """Parities of how many shingles fall on each of BITS places, from two halves of the set.

    A hash deals shingles to levels: half to 0, a quarter to 1 and so on. With scale s, those of level s make one half of
    the sketch and all above the other, s being the least that leaves WHOLE shingles or fewer on average. So sets of one
    scale have both halves to compare; of two that are one apart, the smaller set's upper half and all of the larger's.
    """
    scale = (max(len(sh), WHOLE) - 1).bit_length() - (WHOLE - 1).bit_length()
    y = sh * _MIX[4]
    y = y[y >> np.uint64(8) & np.uint64((1 << scale) - 1) == 0]
    lower = y >> np.uint64(8 + scale) & np.uint64(1)
    places = ((y >> np.uint64(32)) * np.uint64(BITS) >> np.uint64(32)) + lower * np.uint64(BITS)
    odd = np.bincount(places.astype(np.int64), minlength=2 * BITS) & 1
    n = int(lower.sum())
    return np.packbits(odd.astype(np.uint8)).tobytes() + np.array([scale | (len(y) - n) << 8 | n << 32], "<u8").tobytes()


def _text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, n (size of the shingle set), k1 and k2 (its 128-bit hash) and sig, null without shingles."""

    def run(batches):
        for b in batches:
            n, k1, k2, sig = [], [], [], []
            for x in b.column(1):
                sh = shingles(x.as_py())
                n.append(len(sh))
                if len(sh):
                    d = xxhash.xxh3_128_intdigest(sh.tobytes())
                    k1.append((d >> 64) - (1 << 63))
                    k2.append((d & (2**64 - 1)) - (1 << 63))
                    sig.append(signature(sh))
                else:
                    k1.append(None)
                    k2.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], ["doc", "n", "k1", "k2", "sig"])

    return _text(df, id_col, text_col).mapInArrow(run, "doc bigint, n bigint, k1 bigint, k2 bigint, sig binary")


def _ties(doc: np.ndarray, tree: int) -> np.ndarray:
    """32 bits for each row by which an order sorts rows of equal values, other ones in each order; as bytes."""
    y = (doc.astype(np.uint64) + np.uint64((tree + 1) * int(_MIX[1]) & (1 << 64) - 1)) * _MIX[0]
    y = (y ^ (y >> np.uint64(29))) * _MIX[2]
    y = (y ^ (y >> np.uint64(32))) * _MIX[3]
    return (y >> np.uint64(32)).astype(">u4")[:, None].view(np.uint8)


_ORDERED = ["tree", "key", "doc", "comp", "short"]


def _orders(classes: DataFrame) -> DataFrame:
    """classes (doc, sig, comp) once for each of the first TREES: tree, key (the tree's stretch of the signature, and the tie), doc, comp and short (the sketch)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, 2 * HASHES + 8 * SKETCH)
            short = pa.array([r.tobytes() for r in np.ascontiguousarray(sig[:, 2 * HASHES :])], pa.binary())
            doc = b.column(0).to_numpy()
            for t in range(TREES):
                key = np.hstack([sig[:, 2 * t * LEVELS : 2 * (t + 1) * LEVELS], _ties(doc, t)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array([r.tobytes() for r in key], pa.binary()), b.column(0), b.column(2), short], _ORDERED)

    return classes.select("doc", "sig", "comp").mapInArrow(run, "tree int, key binary, doc bigint, comp bigint, short binary")


def _further(dense: DataFrame, start: int) -> DataFrame:
    """The same of dense (doc, text, comp, orders) for each of its trees from start on, by hash functions drawn for the tree."""

    def run(batches):
        for b in batches:
            for doc, text, comp, orders in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sh = shingles(text)
                if not len(sh):
                    continue
                trees = range(start, start + orders)
                key = [minima(sh, *_drawn(t)) + _ties(np.array([doc]), t).tobytes() for t in trees]
                yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), pa.array(key, pa.binary()), *(pa.array([x] * orders, kind) for x, kind in ((doc, pa.int64()), (comp, pa.int64()), (sketch(sh), pa.binary())))], _ORDERED)

    return dense.select("doc", "text", "comp", "orders").mapInArrow(run, "tree int, key binary, doc bigint, comp bigint, short binary")


def _differing(unlike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the bits in which half sketches differ: shingles of one set alone, at least so many, and an estimate."""
    flips = np.bitwise_count(unlike).sum(axis=1, dtype=np.int64)
    return flips, -BITS / 2 * np.log1p(-2 * np.minimum(flips, BITS // 2 - 1) / BITS)


def _likely(x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the sets of two rows of sketches may be linked, and their estimated similarity.

    Two shingles on one place cancel out, so differing places never outnumber differing shingles: sets sketched whole
    that differ too much by them can't be linked, which is no estimate. Besides, similarities estimated 4.6 standard
    deviations below the limit or more are taken to be below: 0.013 for sets sketched whole (WHOLE shingles; less
    for fewer), 0.0195 for others of one scale, 0.028 for scales one apart. Scales further apart are sizes too unlike.
    So a linked pair that is looked at is left aside with a chance of about 2e-6.
    """
    half = BITS // 64
    meta = x[:, -1], y[:, -1]
    scale = [(m & np.uint64(255)).astype(np.int64) for m in meta]
    upper = [(m >> np.uint64(8) & np.uint64(0xFFFFFF)).astype(np.int64) for m in meta]
    size = [u + (m >> np.uint64(32)).astype(np.int64) for u, m in zip(upper, meta, strict=True)]
    likely, est = np.zeros(len(x), bool), np.zeros(len(x))
    k = np.flatnonzero(scale[0] == scale[1])
    if len(k):
        unlike = x[k] ^ y[k]
        (least, some), (least2, more) = _differing(unlike[:, :half]), _differing(unlike[:, half : 2 * half])
        both, least, apart, whole = size[0][k] + size[1][k], least + least2, some + more, scale[0][k] == 0
        est[k] = (both - apart) / np.maximum(1, both + apart)
        possible = ~whole | (100 * (both - least) >= percent * (both + least))
        likely[k] = possible & (est[k] >= percent / 100 - np.where(whole, 0.06, 0.09))
    for lo, hi, ls, hs in ((x, y, 0, 1), (y, x, 1, 0)):
        k = np.flatnonzero(scale[ls] + 1 == scale[hs])
        if len(k):
            apart = _differing(lo[k, :half] ^ hi[k, :half] ^ hi[k, half : 2 * half])[1]
            both = upper[ls][k] + size[hs][k]
            est[k] = (both - apart) / np.maximum(1, both + apart)
            likely[k] = est[k] >= percent / 100 - 0.13
    return likely, est


def _ahead(region: np.ndarray, comp: np.ndarray, reach: int):
    """For each row the next `reach` rows of its region that are of other components, one step at a time: index, index."""

    def ends(x: np.ndarray) -> np.ndarray:
        at = np.r_[np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)]
        return np.repeat(at, np.diff(at, prepend=0))

    if not len(region):
        return
    stop, run, i = ends(region), ends(comp), np.arange(len(region))
    at = i + 1
    for _ in range(reach):
        keep = at < stop[i]
        i, at = i[keep], at[keep]
        at = np.where(comp[at] == comp[i], run[at], at)
        keep = at < stop[i]
        i, at = i[keep], at[keep]
        if not len(i):
            return
        yield i, at
        at = at + 1


def _pairs(rows: dict[str, np.ndarray], reach: int, percent: int, cross: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Likely pairs (index, index, estimate) among sorted rows of one region: one is among the `reach` rows of other components that follow the other or lead up to it.

    Then the last row in each row's window ahead, and in that behind; n or -1 where the window ends with the rows or the
    region. cross: only pairs over this edge.
    """
    region, comp, short = rows["region"], rows["comp"], rows["short"]
    n, found = len(region), ([], [], [])
    last, first = np.full(n, n), np.full(n, -1)

    def add(i: np.ndarray, j: np.ndarray, seen: np.ndarray | None = None) -> None:
        keep = np.ones(len(i), bool) if cross is None else (i < cross) & (j >= cross)
        if seen is not None:
            keep &= j > seen[i]
        i, j = i[keep], j[keep]
        if len(i):
            good, est = _likely(short[i], short[j], percent)
            found[0].append(i[good])
            found[1].append(j[good])
            found[2].append(est[good])

    for k, (i, j) in enumerate(_ahead(region, comp, reach), 1):
        add(i, j)
        if k == reach:
            last[i] = j
    for k, (j, i) in enumerate(_ahead(region[::-1], comp[::-1], reach), 1):
        i, j = n - 1 - i, n - 1 - j
        add(i, j, last)
        if k == reach:
            first[j] = i
    none = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return *(tuple(np.concatenate(x) for x in found) if found[0] else none), last, first


def _as_rows(t: pa.RecordBatch | pa.Table, depth: int) -> dict[str, np.ndarray]:
    key = np.frombuffer(b"".join(t.column("key").to_pylist()), np.uint8)
    key = key.reshape(t.num_rows, len(key) // max(1, t.num_rows))
    tree = t.column("tree").to_numpy()
    region = np.zeros(t.num_rows, np.uint64)
    for k in range(2 * depth):
        region = region * np.uint64(256) + key[:, k]
    return {
        "region": region * np.uint64(1 << 20) + tree.astype(np.uint64),
        "tree": tree,
        "key": key[:, :-4],
        "tie": np.ascontiguousarray(key[:, -4:]).view(">u4")[:, 0].astype(np.float64),
        "comp": t.column("comp").to_numpy(),
        "doc": t.column("doc").to_numpy(),
        "short": np.frombuffer(b"".join(t.column("short").to_pylist()), "<u8").reshape(t.num_rows, SKETCH),
    }


#: Columns of what a pass finds, and the value of edge that marks depths among them.
_FOUND, DEPTHS = ["a", "b", "est", "edge", "tree", "key", "doc", "comp", "short"], -2


def _emit(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, est: np.ndarray, best: bool) -> pa.RecordBatch:
    if best and len(i):
        # for each row the likeliest partner behind it and the likeliest before it
        keep = np.zeros(len(i), bool)
        for side in (i, j):
            order = np.lexsort((np.abs(j - i), -est, side))
            keep[order[np.r_[True, side[order][1:] != side[order][:-1]]]] = True
        i, j, est = i[keep], j[keep], est[keep]
    a, b = rows["doc"][i], rows["doc"][j]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(est), *(pa.nulls(len(i), x) for x in (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], _FOUND)


def _depth(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For rows i whose windows end at rows j of their region, the depth by which a partner must agree to be in them.

    Of rows that tie on all values only some lie in a window: by the share of all ties that it spans, which then counts
    as so many values more.
    """
    same = (rows["key"][i] == rows["key"][j]).reshape(len(i), rows["key"].shape[1] // 2, 2).all(axis=2)
    agree = np.cumprod(same, axis=1).sum(axis=1)
    spanned = np.maximum(np.abs(rows["tie"][i] - rows["tie"][j]), 1) / 2**32
    return np.where(agree == same.shape[1], agree + np.log(spanned) / np.log(0.75), agree + 1.0)


def _depths(rows: dict[str, np.ndarray], i: np.ndarray, depth: np.ndarray, edge: int | None = None) -> pa.RecordBatch:
    """Rows i and their depths. edge: that of the partition at which their windows end."""
    n = len(i)
    null = {x: pa.nulls(n, x) for x in (pa.int64(), pa.binary())}
    return pa.RecordBatch.from_arrays([null[pa.int64()], null[pa.int64()] if edge is None else pa.array(np.full(n, edge, np.int64)), pa.array(depth), pa.array(np.full(n, DEPTHS, np.int64)), pa.array(rows["tree"][i].astype(np.int32)), null[pa.binary()], pa.array(rows["doc"][i]), null[pa.int64()], null[pa.binary()]], _FOUND)


def candidates(classes: DataFrame, n_rows: int, start: int = 0, depth: int = 2, reach: int = REACH[1], percent: int = 75, best: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Likely pairs (a, b, est), a < b, of classes whose components differ; doc, tree and depth of rows in dense regions; and the table that both are read from.

    classes: doc, sig and comp for the first trees; for further ones, from the one numbered start on, doc, text, comp
    and orders (how many of them). n_rows: rows of all orders together.
    """
    part = -(-n_rows // PART_ROWS)
    ordered = _further(classes, start) if start else _orders(classes)
    ordered = (ordered.repartitionByRange(part, "tree", "key", "doc") if part > 1 else ordered.coalesce(1)).sortWithinPartitions("tree", "key", "doc")
    schema = "a bigint, b bigint, est double, edge bigint, tree int, key binary, doc bigint, comp bigint, short binary"

    def edge_rows(t: pa.Table, edge: int, head: int) -> list[pa.RecordBatch]:
        n = t.num_rows
        out = pa.table({"a": pa.array(np.full(n, head, np.int64)), "b": pa.nulls(n, pa.int64()), "est": pa.nulls(n, pa.float64()), "edge": pa.array(np.full(n, edge, np.int64)), **{c: t.column(c) for c in _ORDERED}})
        return out.combine_chunks().to_batches()

    def run(batches):
        p, got = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).cast(pa.schema([("tree", pa.int32()), ("key", pa.binary()), ("doc", pa.int64()), ("comp", pa.int64()), ("short", pa.binary())])).combine_chunks()
        rows, n = _as_rows(t, depth), t.num_rows
        i, j, est, last, first = _pairs(rows, reach, percent)
        yield _emit(rows, i, j, est, best)
        if not best:
            deep = np.full(n, -1.0)
            for full, end in ((np.flatnonzero(last < n), last), (np.flatnonzero(first >= 0), first)):
                deep[full] = np.maximum(deep[full], _depth(rows, full, end[full]))
            some = np.flatnonzero(deep >= 0)
            yield _depths(rows, some, deep[some])
        if part > 1:
            # the rows of the region that an edge may cut, and one of another region, which tells that the region ends
            region = rows["region"]
            upto, start = int((region == region[0]).sum()), n - int((region == region[-1]).sum())
            yield from edge_rows(t.slice(0, min(reach, upto + 1)), p - 1, 1)
            yield from edge_rows(t.slice(max(0, n - reach, start - 1)), p, 0)
            if not best:
                # windows that are open at the edge, of rows too far from it to meet those on its other side
                at = np.arange(n)
                ahead = np.flatnonzero((last == n) & (region == region[-1]) & (at < n - reach))
                yield _depths(rows, ahead, _depth(rows, ahead, np.full(len(ahead), n - 1)), p)
                behind = np.flatnonzero((first < 0) & (region == region[0]) & (at >= reach))
                yield _depths(rows, behind, _depth(rows, behind, np.zeros(len(behind), int)), p - 1)

    def across(t: pa.Table) -> pa.Table:
        t = t.take(pa.compute.sort_indices(t, [("a", "ascending"), ("tree", "ascending"), ("key", "ascending"), ("doc", "ascending")]))
        rows, n, cross = _as_rows(t, depth), t.num_rows, t.num_rows - pa.compute.sum(t.column("a")).as_py()
        i, j, est, last, first = _pairs(rows, reach, percent, cross)
        out = [_emit(rows, i, j, est, best)]
        if not best:
            region, at = rows["region"], np.arange(n)
            full = np.flatnonzero((at < cross) & ((last < n) | (region == region[-1])))
            out.append(_depths(rows, full, _depth(rows, full, np.minimum(last[full], n - 1))))
            full = np.flatnonzero((at >= cross) & ((first >= 0) | (region == region[0])))
            out.append(_depths(rows, full, _depth(rows, full, np.maximum(first[full], 0))))
        return pa.Table.from_batches(out).select(["a", "b", "est", "tree", "doc"])

    found = materialise(ordered.mapInArrow(run, schema), "dedup-found")
    pairs, cut = found.where("edge IS NULL").select("a", "b", "est"), found.where(F.col("edge") == DEPTHS)
    if part > 1:
        # rows lie on both sides of an edge from the first partition that has some up to the last
        lo, hi = found.where("edge >= 0 AND a = 0").agg(F.min("edge"), F.max("edge")).first()
        lo, hi = (0, 0) if lo is None else (lo, hi)
        over = found.where(F.col("edge").between(lo, hi - 1)).select("edge", "a", *_ORDERED).groupBy("edge").applyInArrow(across, "a bigint, b bigint, est double, tree int, doc bigint")
        pairs = pairs.union(over.where("a IS NOT NULL").select("a", "b", "est"))
        cut = cut.where(F.col("b").isNull() | F.col("b").between(lo, hi - 1)).select("doc", "tree", "est").union(over.where("a IS NULL").select("doc", "tree", "est"))
    return pairs.groupBy("a", "b").agg(F.max("est").alias("est")), cut.groupBy("doc", "tree").agg(F.max("est").alias("depth")), found


def _owed(chance: DataFrame, depths: DataFrame, plain: float = 0.75**2) -> DataFrame:
    """doc, orders still owed (ROUND at most, then the rest by what those find), chance (log of that of missing a pair of 75 %) and depth, of the docs that are owed any.

    chance: doc and chance as it were with an open region in every tree so far; depths: what those trees had instead.
    """
    lost = depths.groupBy("doc").agg(F.sum(F.log1p(-F.pow(F.lit(0.75), "depth")) - F.lit(float(np.log1p(-plain)))).alias("lost"), F.max("depth").alias("depth"))
    now = chance.join(lost, "doc").withColumn("chance", F.col("chance") + F.col("lost"))
    need = F.ceil((F.lit(float(np.log(MISS))) - F.col("chance")) / F.log1p(-F.pow(F.lit(0.75), F.least("depth", F.lit(LONG + 1.0)))))
    return now.select("doc", F.least(need, F.lit(ROUND)).cast("int").alias("orders"), "chance").where("orders > 0")


def verified(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) whose full shingle sets link: 100 x intersection >= percent x union. texts: doc, text."""
    fits = small_enough(pairs, BROADCAST_PAIRS)
    hint = F.broadcast if fits else (lambda x: x)
    left = texts.join(hint(pairs.select(F.col("a").alias("doc"), "b")), "doc").select(F.col("doc").alias("a"), "b", F.col("text").alias("ta"))
    right = texts.join(hint(pairs.select(F.col("b").alias("doc")).distinct()), "doc").select(F.col("doc").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        last: dict[str, tuple] = {}

        def sets(side: str, doc: int, text) -> np.ndarray:
            if last.get(side, (None,))[0] != doc:
                last[side] = (doc, shingles(text.as_py()))
            return last[side][1]

        for b in batches:
            ok = []
            for a_id, b_id, ta, tb in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                x, y = sets("a", a_id, ta), sets("b", b_id, tb)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                if 100 * len(small) < percent * len(large):
                    ok.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return left.hint("merge").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links) and kept (it is that one).

    Null and empty texts have no shingles and are linked with nothing. Rows with a null id stay, linked with nothing,
    without a component and kept. An id in several rows is one document with several texts: each row has its own
    n_shingles, and the links of all hold for it. Texts whose sets of shingles (64-bit hashes) have the same 128-bit hash
    are taken to have the same set. Ties in similarity don't matter. An empty table gives an empty result; other columns
    are not read.
    """
    sig = materialise(signatures(df, id_col, text_col), "dedup-signatures")
    texts = _text(df, id_col, text_col)
    usable = sig.where("doc IS NOT NULL AND k1 IS NOT NULL")
    classes = materialise(usable.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")).withColumn("comp", F.col("doc")), "dedup-classes")
    n, n_docs = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    several = materialise(usable.groupBy("doc").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y")).where("x <> y").select("doc"), "dedup-several")
    one, ties = classes.select("doc", "sig", "comp"), None
    if several.limit(1).count():
        # a document in several classes (an id in several rows) ties them, and may stand for more than one
        ties = usable.select("doc", "k1", "k2").join(several, "doc", "left_semi").distinct()
        ties = ties.join(classes.select("k1", "k2", F.col("doc").alias("rep")), ["k1", "k2"]).where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
        one = materialise(classes.groupBy("doc").agg(F.min(F.struct("k1", "k2", "sig")).alias("s")).select("doc", "s.sig", F.col("doc").alias("comp")), "dedup-one")
    near, _, found = candidates(one, n * TREES, best=True, reach=REACH[0], percent=percent)
    first = materialise(near, "dedup-first")
    discard(found)
    # of what a class found in all trees, the likeliest partner on either side
    top = first.groupBy(F.col("a").alias("d")).agg(F.max_by("b", "est").alias("e")).select(F.col("d").alias("a"), F.col("e").alias("b"))
    top = top.union(first.groupBy(F.col("b").alias("d")).agg(F.max_by("a", "est").alias("e")).select(F.col("e").alias("a"), F.col("d").alias("b"))).distinct()
    tried = materialise(top, "dedup-pairs")
    discard(first)
    links = verified(tried, texts, percent)
    comps = materialise(connected(links if ties is None else links.union(ties)), "dedup-components")

    def labelled() -> DataFrame:
        return one.drop("comp").join(comps.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).select("doc", "sig", "comp")

    rows, start, each = labelled(), 0, TREES
    chance = one.select("doc", F.lit(TREES * float(np.log1p(-(0.75**2)))).alias("chance"))
    total = n * TREES
    while True:
        more, depths, found = candidates(rows, total, start, reach=REACH[2 if start else 1], percent=percent)
        more = materialise(more.join(tried, ["a", "b"], "left_anti").select("a", "b"), "dedup-pairs")
        owed = materialise(_owed(chance, depths), "dedup-owed")
        discard(found, rows)
        links = materialise(verified(more, texts, percent), "dedup-links")
        if links.limit(1).count():
            comps = merged(comps, links)
        start += each
        total, each = owed.agg(F.coalesce(F.sum("orders"), F.lit(0)), F.coalesce(F.max("orders"), F.lit(0))).first()
        if not total:
            break
        tried = tried.union(more)
        hint = F.broadcast if small_enough(owed, BROADCAST_PAIRS) else (lambda x: x)
        dense = labelled().select("doc", "comp").join(owed.select("doc", "orders"), "doc")
        rows = materialise(texts.join(hint(materialise(dense, "dedup-owed")), "doc").select("doc", "text", "comp", "orders"), "dedup-dense")
        # the coming orders count as open until they turn out otherwise
        chance = owed.select("doc", (F.col("chance") + F.col("orders") * F.lit(float(np.log1p(-(0.75**2))))).alias("chance"))
    known = classes.select("k1", "k2", "doc", "copies").join(comps.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")).where("copies > 1 OR component <> doc").select("k1", "k2", "component", "copies")
    # rows without shingles have no class and stay where they are; a class with many copies does, too
    rows = sig.select("doc", "n", "k1", "k2")
    out = skew_join(rows.where("k1 IS NOT NULL"), known, ["k1", "k2"], "copies", n_docs, "left")
    out = out.unionByName(rows.where("k1 IS NULL"), allowMissingColumns=True).withColumn("component", F.coalesce("component", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """df without the documents that are not kept, with all columns.

    One document of each component stays, that of the smallest id; an id in several rows is one document, all rows of
    which stay or go. Rows without an id and texts without words (null ones too) are linked with nothing and stay. An
    empty table stays empty.
    """
    gone = near_duplicates(df, id_col, text_col, percent).where("NOT kept").select(F.col(id_col).alias("_q_gone")).distinct()
    return df.join(gone, df[id_col] == gone["_q_gone"], "left_anti")
