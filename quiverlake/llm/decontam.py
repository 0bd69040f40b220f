"""Benchmark decontamination: BM25 over an inverted index of the test items with block-max WAND.

The items are the documents of the index and every passage of the training texts is a query. Passages are windows of
words, twice as long as the longest item and half overlapping, so that an item lies whole in one of them. Impacts are
scaled so that an item's own words score 1; a passage is a possible leak of each item that it scores at least
`least` for. Upper bounds spare most of the work. A passage's terms with the smallest maxima, which together stay below
the threshold, can't make a hit alone; so only the blocks that one of its other terms occurs in are looked at, first with
the rest's maxima, then with their block maxima. Inside blocks that can reach the threshold, WAND pivots skip every item
whose bounds fall short. All pairs at or above the threshold are found. They are confirmed by the share of the pairs of
adjacent words of the item's question and of its answer that the passage holds; both must overlap. An item of fewer than
SHORT words says little by itself: it leaks only from a document that holds nothing else.

Items are cut into parts of bounded size by Spark, and each part is indexed in a task. The driver passes the parts on one
at a time and never holds the items; every part is a pass over the documents, in which no row moves.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import materialise

#: ASCII other than letters and digits separates words; all else is kept.
_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Characters of items in a part of the index; items of fewer words than SHORT.
PART_CHARS, SHORT = 4_000_000, 5
#: Share of the threshold that the terms of a passage whose postings are not walked can reach together.
REST = 0.5
#: Block bounds that are computed at a time.
_STEP = 2_000_000


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item without columns for them is cut in two at the sentence end that lies nearest to its middle, else at the middle word."""
    parts = [words(s) for s in _SENTENCE.split(text)]
    parts = [p for p in parts if p]
    total = sum(map(len, parts))
    ends = np.cumsum([len(p) for p in parts])[:-1] if parts else []
    inner = [e for e in ends if 0.25 * total <= e <= 0.75 * total]
    cut = int(min(inner, key=lambda e: abs(e - total / 2))) if inner else total // 2
    flat = [w for p in parts for w in p]
    return flat[:cut], flat[cut:]


def _runs(seq: list[bytes], n: int = 2) -> set[bytes]:
    n = min(n, len(seq))
    return {b" ".join(seq[k : k + n]) for k in range(len(seq) - n + 1)} if n else set()


def _spread(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of the lists of terms, and for each the index of its term."""
    size = starts[terms + 1] - starts[terms]
    of = np.repeat(np.arange(len(terms)), size)
    return np.arange(len(of)) + np.repeat(starts[terms] - (np.cumsum(size) - size), size), of


class Index:
    """Postings of the items with scaled BM25 impacts, in blocks of items by position."""

    def __init__(self, items: list[tuple], stats: tuple[int, float, int, dict[bytes, int]] | None = None, block: int = 4, k1: float = 1.2, b: float = 0.75):
        """items: (id, question words, answer words). stats: number of items, mean and most words and document frequencies of all items, if these are only a part."""
        self.ids = [i for i, _, _ in items]
        self.parts = [(_runs(q), _runs(a)) for _, q, a in items]
        seqs = [q + a for _, q, a in items]
        self.short = {k: s for k, s in enumerate(seqs) if len(s) < SHORT}
        if stats is None:
            stats = len(seqs), sum(map(len, seqs)) / max(1, len(seqs)), max(map(len, seqs), default=0), Counter(w for s in seqs for w in set(s))
        n, mean, longest, df = stats
        self.block, self.n_blocks = block, -(-len(items) // block)
        self.window = max(64, 2 * longest)
        self.vocab: dict[bytes, int] = {}
        postings: list[list[tuple[int, float]]] = [[]]
        for k, s in enumerate(seqs):
            tf = Counter(s)
            impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(s) / mean)) for w, f in tf.items()}
            total = sum(impact.values())
            for w, x in impact.items():
                t = self.vocab.setdefault(w, len(self.vocab) + 1)
                if t == len(postings):
                    postings.append([])
                postings[t].append((k, x / total))
        self.postings = postings
        self.block_max = [{} for _ in postings]
        starts, cells, maxima = [0], [], []
        for t, p in enumerate(postings):
            for k, x in p:
                self.block_max[t][k // block] = max(x, self.block_max[t].get(k // block, 0.0))
            cells += list(self.block_max[t])
            maxima += list(self.block_max[t].values())
            starts.append(len(cells))
        self.starts, self.cells, self.maxima = np.array(starts), np.array(cells, np.int64), np.array(maxima)
        self.places = np.repeat(np.arange(len(postings)), np.diff(self.starts)) * self.n_blocks + self.cells
        self.top = np.array([max((x for _, x in p), default=0.0) for p in postings])

    def blocks(self, terms: np.ndarray, of: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose block maxima together reach `least`, in order. terms and of (passage): distinct pairs, sorted by passage."""
        order = np.lexsort((self.top[terms], of))
        terms, of = terms[order], of[order]
        top = self.top[terms]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        before = np.cumsum(top) - top
        upto = before + top - np.repeat(before[first], np.diff(np.r_[first, len(of)]))  # of the passage's terms so far
        main = upto >= REST * least - 1e-9
        rest = np.zeros(int(of[-1]) + 1)  # what a passage's other terms can add at most
        np.maximum.at(rest, of[~main], upto[~main])
        others, other_of = terms[~main], of[~main]
        terms, of = terms[main], of[main]
        size = np.cumsum(self.starts[terms + 1] - self.starts[terms])
        found: list[np.ndarray] = []
        lo = 0
        while lo < len(terms):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _STEP, "right")))
            hi = int(np.searchsorted(of, of[hi - 1], "right"))  # whole passages
            at, own = _spread(self.starts, terms[lo:hi])
            key, place = np.unique(of[lo:hi][own] * self.n_blocks + self.cells[at], return_inverse=True)
            bound = np.bincount(place, self.maxima[at], len(key))
            some = bound + rest[key // self.n_blocks] >= least - 1e-9
            key, bound = key[some], bound[some]
            for k in range(0, len(key), _STEP // 64):
                found.append(self._whole(key[k : k + _STEP // 64], bound[k : k + _STEP // 64], others, other_of, least))
            lo = hi
        keys = np.concatenate(found) if found else np.zeros(0, np.int64)
        return keys // self.n_blocks, keys % self.n_blocks

    def _whole(self, key: np.ndarray, bound: np.ndarray, others: np.ndarray, other_of: np.ndarray, least: float) -> np.ndarray:
        """The keys whose bounds, with the maxima of the passages' other terms in the block itself, reach `least`."""
        passage, block = key // self.n_blocks, key % self.n_blocks
        lo, hi = np.searchsorted(other_of, passage), np.searchsorted(other_of, passage, "right")
        of = np.repeat(np.arange(len(key)), hi - lo)
        term = others[np.arange(len(of)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)]
        want = term * self.n_blocks + block[of]
        at = np.minimum(np.searchsorted(self.places, want), len(self.places) - 1)
        more = np.bincount(of, np.where(self.places[at] == want, self.maxima[at], 0.0), len(key))
        return key[bound + more >= least - 1e-9]

    def wand(self, terms: list[int], blocks: set[int], least: float) -> list[tuple[int, float]]:
        """Items of the given blocks that the terms score at least `least` for, by document-at-a-time WAND with block maxima."""
        lists = []
        for t in terms:
            p = [x for x in self.postings[t] if x[0] // self.block in blocks]
            if p:
                lists.append([p, 0, max(x for _, x in p), t])
        least -= 1e-9
        out = []
        while lists:
            lists.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, None
            for j, c in enumerate(lists):
                bound += c[2]
                if bound >= least:
                    pivot = j
                    break
            if pivot is None:
                break
            doc = lists[pivot][0][lists[pivot][1]][0]
            own = doc // self.block
            upto = pivot
            while upto + 1 < len(lists) and lists[upto + 1][0][lists[upto + 1][1]][0] == doc:
                upto += 1
            if sum(self.block_max[c[3]].get(own, 0.0) for c in lists[: upto + 1]) < least:
                # no item of this block from the first cursor to the next list's item can reach it
                to = (own + 1) * self.block
                if upto + 1 < len(lists):
                    to = min(to, lists[upto + 1][0][lists[upto + 1][1]][0])
                to = max(to, doc + 1)
            elif lists[0][0][lists[0][1]][0] == doc:
                score = sum(c[0][c[1]][1] for c in lists[: upto + 1])
                if score >= least:
                    out.append((doc, score))
                to = doc + 1
            else:
                to = doc
            for c in lists[: upto + 1]:
                while c[1] < len(c[0]) and c[0][c[1]][0] < to:
                    c[1] += 1
            lists = [c for c in lists if c[1] < len(c[0])]
        return out

    def leaks(self, texts: list[str | None], least: float, overlap: float) -> list[tuple[int, int, float, float, float, int]]:
        """(text, item, score, question overlap, answer overlap, first word of the passage), the best passage for each text and item; of equal ones the first."""
        half = self.window // 2
        seqs = [words(t) for t in texts]
        ids = [np.fromiter(map(self.vocab.get, s, [0] * len(s)), np.int64, len(s)) for s in seqs]
        segments = [-(-len(s) // half) for s in seqs]  # passage p of a text is its segments p and p + 1
        base = np.r_[0, np.cumsum(segments)].astype(np.int64)
        n = int(base[-1])
        if not n or not self.ids:
            return []
        flat = np.concatenate(ids)
        seg = np.concatenate([np.arange(len(s)) // half + base[k] for k, s in enumerate(seqs)])
        known = flat > 0
        flat, seg = flat[known], seg[known]
        text_of = np.repeat(np.arange(len(seqs)), segments)
        inner = np.r_[False, text_of[1:] == text_of[:-1]]  # segments that the passage before holds, too
        again = inner[seg]
        pair = np.r_[seg, seg[again] - 1] * (len(self.vocab) + 1) + np.r_[flat, flat[again]]
        pair = np.unique(pair)
        of, term = pair // (len(self.vocab) + 1), pair % (len(self.vocab) + 1)
        if not len(of):
            return []
        # passages whose words can't reach the threshold together go first
        able = np.bincount(of, self.top[term], n) >= least - 1e-9
        live = able[of]
        of, term = of[live], term[live]
        if not len(of):
            return []
        at, blk = self.blocks(term, of, least)
        found: dict[tuple[int, int], tuple] = {}
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
        for a, b in zip(cut, np.r_[cut[1:], len(at)] if len(at) else [], strict=True):
            p = int(at[a])
            t = int(text_of[p])
            start = (p - int(base[t])) * half
            own = term[np.searchsorted(of, p) : np.searchsorted(of, p + 1)]
            for item, score in self.wand(own.tolist(), set(blk[a:b].tolist()), least):
                if item in self.short and seqs[t] != self.short[item]:
                    continue
                have = _runs(seqs[t][start : start + self.window])
                have.update(seqs[t][start : start + self.window])  # for parts of one word
                q, r = (len(s & have) / len(s) if s else 1.0 for s in self.parts[item])
                if q >= overlap and r >= overlap and (score, -start) > found.get((t, item), ((-1.0, 0),))[0]:
                    found[t, item] = ((score, -start), q, r)
        return [(t, i, s, q, r, -start) for (t, i), ((s, start), q, r) in sorted(found.items())]


def index_parts(items: DataFrame, item_id: str = "item_id", text_col: str = "text", question_col: str | None = None, answer_col: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (part, blob): the items' index in parts of about `part_chars` characters, each indexed in a task; statistics are those of all items.

    Items without words and null ids are left out. Repeated items count once; an id with several texts is several items.
    """
    cols = [F.col(f"`{question_col}`").cast("string").alias("q"), F.col(f"`{answer_col}`").cast("string").alias("a")] if question_col else [F.col(f"`{text_col}`").cast("string").alias("q"), F.lit(None).cast("string").alias("a")]
    kind = items.schema[item_id].dataType.simpleString()
    known = items.select(F.col(f"`{item_id}`").alias("i"), *cols).where("i IS NOT NULL").distinct()
    whole = question_col is None

    def cut(batches):
        for b in batches:
            q, a, n = [], [], []
            for x, y in zip(b.column(1), b.column(2), strict=True):
                left, right = question_and_answer(x.as_py() or "") if whole else (words(x.as_py()), words(y.as_py()))
                q.append(b" ".join(left))
                a.append(b" ".join(right))
                n.append(len(left) + len(right))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(q, pa.binary()), pa.array(a, pa.binary()), pa.array(n, pa.int64())], ["i", "q", "a", "n"])

    def unique(batches):
        for b in batches:
            out: list[list[bytes]] = [sorted(set(q.as_py().split() + a.as_py().split())) for q, a in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(np.repeat(np.arange(len(out)), [len(x) for x in out]))), pa.array([w for x in out for w in x], pa.binary())], ["part", "w"])

    known = materialise(known.mapInArrow(cut, f"i {kind}, q binary, a binary, n bigint").where("n > 0"), "decontam-items")
    n, n_words, longest, chars = known.agg(F.count(F.lit(1)), F.sum("n"), F.max("n"), F.sum(F.length("q") + F.length("a"))).first()
    if not n:
        return items.sparkSession.createDataFrame([], "part int, blob binary")
    parts, mean = max(1, -(-chars // part_chars)), n_words / n
    dealt = known.withColumn("part", F.pmod(F.xxhash64("i", "q", "a"), F.lit(parts)).cast("int"))
    used = dealt.select("q", "a", "part").mapInArrow(unique, "part int, w binary")
    df = used.groupBy("w").agg(F.count(F.lit(1)).alias("df"), F.collect_set("part").alias("parts")).select(F.explode("parts").alias("part"), "w", "df")

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(zip(left["i"].to_pylist(), left["q"].to_pylist(), left["a"].to_pylist(), strict=True))
        counts = dict(zip(right["w"].to_pylist(), right["df"].to_pylist(), strict=True))
        index = Index([(i, q.split(), a.split()) for i, q, a in rows], (n, mean, longest, counts))
        return pa.table({"part": pa.array([left["part"][0].as_py()], pa.int32()), "blob": pa.array([pickle.dumps(index)], pa.binary())})

    return materialise(dealt.groupBy("part").cogroup(df.groupBy("part")).applyInArrow(build, "part int, blob binary"), "decontam-index")


def indexes(items: DataFrame, **columns):
    """The index's parts, as pickled objects, one at a time."""
    parts = index_parts(items, **columns)
    for k in sorted(r[0] for r in parts.select("part").collect()):
        yield parts.where(F.col("part") == k).first()["blob"]


def _loaded(shared, cache: dict = {}) -> Index:  # noqa: B006 - one index a Python worker
    if shared.id not in cache:
        cache.clear()
        cache[shared.id] = pickle.loads(shared.value)
    return cache[shared.id]


class _Part:
    """A part of the index on its way to the tasks, which unpickle it once a worker."""

    def __init__(self, spark, blob: bytes):
        self.value_of = spark.sparkContext.broadcast(blob)
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> bytes:
        return self.value_of.value


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, overlap: float = 0.35, batch: int = 128, **columns) -> DataFrame:
    """One row per document and item that it leaks: id, item_id, score, question_overlap, answer_overlap, first_word.

    Every passage of every text is queried. Null and empty texts hold nothing; a null id stays null; repeated rows each
    give their rows; without documents or items the result is empty. Of passages that score alike the first counts. Items
    are taken as `index_parts` says. Other columns are not read.
    """
    kind, item_kind = df.schema[id_col].dataType, items.schema[columns.get("item_id", "item_id")].dataType
    schema = f"id {kind.simpleString()}, item_id {item_kind.simpleString()}, score double, question_overlap double, answer_overlap double, first_word bigint"
    spark, out = df.sparkSession, None
    for blob in indexes(items, **columns):
        shared = _Part(spark, blob)

        def run(batches, shared=shared):
            ix = _loaded(shared)
            for b in batches:
                for k in range(0, b.num_rows, batch):
                    part = b.slice(k, batch)
                    hits = ix.leaks(part.column(1).to_pylist(), least, overlap)
                    if hits:
                        ids = part.column(0)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([h[0] for h in hits], pa.int64())), pa.array([ix.ids[h[1]] for h in hits]), *(pa.array([h[c] for h in hits]) for c in (2, 3, 4)), pa.array([h[5] for h in hits], pa.int64())], ["id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        part = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("id", id_col)


def drop_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", least: float = 0.5, overlap: float = 0.35, batch: int = 128, **columns) -> DataFrame:
    """df without the documents that leak an item, with all columns and in the same types. No row moves: each is judged where it is.

    Documents with a null or empty text stay, as do all if there are no items; repeated rows are each judged alike; null
    ids don't matter. An empty table stays empty.
    """
    spark = df.sparkSession
    for blob in indexes(items, **columns):
        shared = _Part(spark, blob)
        at = df.columns.index(text_col)

        def run(batches, shared=shared, at=at):
            ix = _loaded(shared)
            for b in batches:
                for k in range(0, b.num_rows, batch):
                    part = b.slice(k, batch)
                    bad = {h[0] for h in ix.leaks([None if x is None else str(x) for x in part.column(at).to_pylist()], least, overlap)}
                    yield part.filter(pa.array([j not in bad for j in range(part.num_rows)], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
