"""Toxic spans with a linear-chain conditional random field.

Two states, clean and toxic. A token's features are itself and its first four, five and six characters; transitions
are learned. Token labels for training come from labelled documents: in a toxic document those tokens are toxic of
which a feature is found in toxic documents (nearly) alone; all other tokens, and all of clean documents, are clean.
The field is fitted on windows of tokens by gradient steps on its likelihood, with forward-backward expectations.

Only features that some toxic token of the training rows has carry weight, so long stretches of text are neutral
steps of the chain. Their product is a power of one 2 x 2 matrix; forward-backward runs over the other tokens and
jumps the stretches, which gives the same marginals as walking every token.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quiverlake.llm.common import materialise

#: Training rows at most (a documented bound): those of the smallest hash of their id; what they are does not depend on the order of rows.
TRAIN_ROWS = 3000
#: Characters of all of them together at most (a documented bound): texts of more than a fiftieth of it are no training rows, and neither are those by which it is exceeded, in order of the hash.
TRAIN_CHARS = 50_000_000
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(word: str) -> tuple[str, ...]:
    return ("w:" + word, *("p:" + word[:n] for n in (4, 5, 6) if len(word) > n), *(("p:" + word,) if 4 <= len(word) <= 6 else ()))


@dataclass
class Crf:
    """Weights are toxic minus clean; trans[a, b] is the log weight of going from state a to b; start: toxic minus clean."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0

    def __post_init__(self) -> None:
        self.heads = {f[2:][:4] for f in self.weights}
        step = np.exp(self.trans) * np.array([1.0, math.exp(self.bias)])
        self.powers, self.doubled = [np.eye(2)], [step / step.sum()]
        for _ in range(255):
            m = self.powers[-1] @ step
            self.powers.append(m / m.sum())

    def delta(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def _neutral(self, n: int) -> np.ndarray:
        """Product of n neutral steps, up to a factor; those beyond the table by repeated squaring."""
        if n < len(self.powers):
            return self.powers[n]
        out, k = np.eye(2), 0
        while n >> k:
            if k == len(self.doubled):
                m = self.doubled[-1] @ self.doubled[-1]
                self.doubled.append(m / m.sum())
            if n >> k & 1:
                out = out @ self.doubled[k]
                out /= out.sum()
            k += 1
        return out

    def marginals(self, words: list[str]) -> list[tuple[int, float]]:
        """(token, probability of being toxic) for every token that is not neutral."""
        at = [k for k, w in enumerate(words) if w[:4] in self.heads and any(f in self.weights for f in features(w))]
        if not at:
            return []
        first = np.array([1.0, math.exp(self.start)])
        emit = [np.array([1.0, math.exp(min(50.0, self.delta(words[k])))]) for k in at]
        link = np.exp(self.trans)
        fwd, bwd = [], [np.ones(2)]
        for j, k in enumerate(at):
            if j == 0:
                a = first * emit[0] if k == 0 else ((first * np.array([1.0, math.exp(self.bias)])) @ self._neutral(k - 1) @ link) * emit[0]
            else:
                a = (fwd[-1] @ self._neutral(k - at[j - 1] - 1) @ link) * emit[j]
            fwd.append(a / a.sum())
        tail = self._neutral(len(words) - 1 - at[-1]).sum(axis=1)
        bwd = [tail / tail.sum()]
        for j in range(len(at) - 1, 0, -1):
            b = self._neutral(at[j] - at[j - 1] - 1) @ (link @ (emit[j] * bwd[-1]))
            bwd.append(b / b.sum())
        bwd.reverse()
        out = []
        for k, a, b in zip(at, fwd, bwd, strict=True):
            p = a * b
            out.append((k, float(p[1] / p.sum())))
        return out

    def score(self, text: str | None) -> float:
        """Probability that some token is toxic, tokens taken as independent given their marginals.

        Neutral tokens all have the same small marginal, which says nothing of the text, and are left out. Empty texts: 0.
        """
        clean = 1.0
        for _, p in self.marginals(tokens(text)):
            clean *= 1.0 - p
        return min(1.0, max(0.0, 1.0 - clean))

    def spans(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Offending spans as (first character, end, probability); neighbours are joined."""
        text = text or ""
        low = text.lower()
        source = text if len(low) != len(text) else low  # where lower-casing changes the length, offsets are those of the text
        places = [m.span() for m in _WORD.finditer(source)]
        out: list[list] = []
        last = -2
        for k, p in self.marginals([source[a:b].lower() for a, b in places]):
            if p >= least:
                if k == last + 1 and out:
                    out[-1][1:] = [places[k][1], max(out[-1][2], p)]
                else:
                    out.append([*places[k], p])
                last = k
        return [tuple(s) for s in out]


def label_tokens(docs: list[tuple[list[str], int]], least: int = 3, purity: float = 0.95, chance: float = 0.02) -> set[str]:
    """Features that mark toxic tokens.

    In `least` toxic documents or more, with `purity` of their documents toxic, and so often that by chance fewer than
    `chance` features of their kind would be. Occurrences between the same neighbours count once, so copies of a
    document don't add up.
    """
    ids: dict[str, int] = {"": 0}
    uses = [(array("q"), array("q")), (array("q"), array("q"))]  # clean, toxic: words, and their neighbours as two ids in one number
    for words, toxic in docs:
        row = [0, *(ids.setdefault(w, len(ids)) for w in words), 0]
        word, context = uses[1 if toxic else 0]
        for w, k in {w: k for k, w in enumerate(row[1:-1])}.items():
            word.append(w)
            context.append(row[k] << 32 | row[k + 2])
    found = []
    for word, context in uses:
        places = np.unique(np.array(context), return_inverse=True)[1]
        found.append((np.array(word), places, int(places.max(initial=0)) + 1))
    del uses
    base = min(0.5, max(1e-9, sum(t for _, t in docs) / max(1, len(docs))))
    marks = set()
    for size in (0, 4, 5, 6):  # one kind of feature at a time: words, then their beginnings; a word has one of a kind at most
        grams: dict[str, int] = {}
        own = np.array([grams.setdefault("p:" + w[:size] if size else "w:" + w, len(grams)) if len(w) >= size else -1 for w in ids])
        counts = []
        for word, places, width in found:
            of = own[word]
            has = of >= 0
            counts.append(np.bincount(np.unique(of[has] * width + places[has]) // width, minlength=len(grams)))
        both, n = counts[0] + counts[1], counts[1]
        ranked = np.sort(both)
        likely = np.flatnonzero((n >= least) & (n >= purity * both)).tolist()
        names = list(grams) if likely else []
        for k in likely:
            peers = len(ranked) - int(np.searchsorted(ranked, both[k]))
            if peers * base ** int(n[k]) * math.comb(int(both[k]), int(n[k])) < chance:
                marks.add(names[k])
    return marks


def fit(docs: list[tuple[list[str], int]], span: int = 12, rounds: int = 90, l2: float = 1e-5, seed: int = 5) -> Crf:
    """Fits the field on windows of `span` tokens: around all tokens that have a mark, and one at a random place of each document.

    A token that lies in the window of the one before it needs none of its own, so a document has no more windows than words.
    """
    marks = label_tokens(docs)
    is_toxic: dict[str, bool] = {}
    names: dict[str, int] = {}
    rng = np.random.default_rng(seed)
    windows: list[tuple[list[str], list[int]]] = []
    clean: list[tuple[list[str], list[int]]] = []

    def toxic(w: str) -> bool:
        if w not in is_toxic:
            is_toxic[w] = any(f in marks for f in features(w))
        return is_toxic[w]

    for words, label in docs:
        y = [int(label and toxic(w)) for w in words]
        near = [k for k, v in enumerate(y) if v or (not label and toxic(words[k]))]
        upto = 0
        for k in near:
            if k >= upto:
                lo = max(0, min(k - int(rng.integers(0, span)), len(words) - span))
                windows.append((words[lo : lo + span], y[lo : lo + span]))
                upto = lo + span
        for _ in range(1 if words else 0):
            lo = int(rng.integers(0, max(1, len(words) - span + 1)))
            clean.append((words[lo : lo + span], y[lo : lo + span]))
    if not any(any(y) for _, y in windows):
        return Crf()
    windows += clean
    for words, y in windows:
        for w, v in zip(words, y, strict=True):
            if v:
                for f in features(w):
                    names.setdefault(f, len(names))
    n, width = len(windows), span
    size = np.array([len(w) for w, _ in windows])
    live = np.arange(width)[None] < size[:, None]
    gold = np.zeros((n, width), int)
    rows, cols = [], []
    for i, (words, y) in enumerate(windows):
        gold[i, : len(y)] = y
        for j, w in enumerate(words):
            for f in features(w):
                if f in names:
                    rows.append(i * width + j)
                    cols.append(names[f])
    rows, cols = np.array(rows), np.array(cols)
    theta = {"w": np.zeros(len(names)), "b": np.array([-6.0]), "t": np.zeros((2, 2)), "s": np.array([0.0])}
    sums = {k: np.full_like(v, 1e-6) for k, v in theta.items()}
    both = live[:, 1:]
    for _ in range(rounds):
        delta = (np.bincount(rows, theta["w"][cols], n * width).reshape(n, width) + theta["b"][0]) * live
        link = np.exp(theta["t"])
        emit = np.stack([np.ones_like(delta), np.exp(np.minimum(delta, 50))], -1)
        fwd, bwd = np.empty((n, width, 2)), np.empty((n, width, 2))
        a = np.array([1.0, math.exp(theta["s"][0])]) * emit[:, 0]
        fwd[:, 0] = a / a.sum(1, keepdims=True)
        for j in range(1, width):
            a = (fwd[:, j - 1] @ link) * emit[:, j]
            fwd[:, j] = np.where(live[:, j, None], a / a.sum(1, keepdims=True), fwd[:, j - 1])
        bwd[:, -1] = 1
        for j in range(width - 2, -1, -1):
            b = (emit[:, j + 1] * bwd[:, j + 1]) @ link.T
            bwd[:, j] = np.where(live[:, j + 1, None], b / b.sum(1, keepdims=True), 1.0)
        p = fwd * bwd
        p = p[..., 1] / p.sum(-1)
        pair = fwd[:, :-1, :, None] * link * (emit[:, 1:] * bwd[:, 1:])[:, :, None, :]
        pair = pair / pair.sum((2, 3), keepdims=True) * both[:, :, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        miss = (gold - p) * live
        grad = {"w": np.bincount(cols, miss.ravel()[rows], len(names)) / n - l2 * theta["w"], "b": np.array([miss.sum() / n]), "t": (seen - pair.sum((0, 1))) / n - l2 * theta["t"], "s": np.array([miss[:, 0].sum() / n])}
        for k, g in grad.items():
            sums[k] += g * g
            theta[k] += g / np.sqrt(sums[k])
    return Crf({f: float(theta["w"][k]) for f, k in names.items() if abs(theta["w"][k]) > 1e-6}, float(theta["b"][0]), theta["t"], float(theta["s"][0]))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves remainder 2 by 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Crf:
    """Fits on at most `rows` labelled documents that are not held out, of at most `chars` characters together.

    Labels of null and of ids without a document are left out; of repeated labels of an id the toxic one counts, of
    several texts of an id the first in order. Only these rows' texts reach the driver.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    found = materialise(found.where(F.length("text") <= chars // 50), "toxicity-sample")
    upto = F.sum(F.length("text")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over `rows` rows at most
    fits = found.select("doc_id", upto.alias("upto")).where(F.col("upto") <= chars).select("doc_id")
    got = found.join(F.broadcast(fits), "doc_id").select("doc_id", "toxic", "text").collect()
    got.sort(key=lambda r: r[0])
    one: dict[str, str] = {}  # equal words share one string
    return fit([([one.setdefault(w, w) for w in tokens(r[2])], int(r[1] == 1)) for r in got])


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, spans (first character, end, probability).

    Null and empty texts score 0, and so do texts without a marked word, however long. Repeated rows each give a row; a
    null doc_id stays null and is not held out. Without labelled toxic rows every score is 0. Equal texts have equal
    scores; an empty table gives none. Other columns are not read.
    """
    model = train(docs, labels, train_rows)

    def run(batches):
        for b in batches:
            score, spans = [], []
            for x in b.column(1):
                text = x.as_py()
                s = model.score(text)
                score.append(s)
                spans.append([{"first": f, "end": e, "probability": p} for f, e, p in model.spans(text)] if s >= threshold else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])))], ["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<first:bigint,end:bigint,probability:double>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without those that score `threshold` or more, with all columns. No row moves: each is judged where it is.

    Documents with a null or empty text stay, and all do without labelled toxic rows. Ids don't matter: rows that repeat
    are judged alike, null ids like others. An empty table stays empty.
    """
    model, at = train(docs, labels, train_rows), docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([model.score(None if x is None else str(x)) < threshold for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
