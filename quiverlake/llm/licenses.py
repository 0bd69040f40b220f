"""Licence scans with a generalised suffix automaton.

The automaton holds every run of words of a set of licence notices. A text is streamed through it once, which
gives for each word the longest run ending there that some notice contains (matching statistics). Notices that hold
only an end of that run are met on the way up the suffix links, down to runs of `min_run` words; so each notice has
all its maximal runs, whatever longer ones others have. They are chained, in order and with bounded gaps, into spans
of one notice; a span's coverage is the share of the notice's words that its runs hold. Where spans of several labels
overlap by half or more, the one that covers most words stays. Words outside the automaton's vocabulary reset it, so
only stretches of known words are walked.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quiverlake.llm.notices import NOTICES

#: Base phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Bytes outside 0-9, a-z and those of other alphabets separate words; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """All runs of several sequences; each state knows where (sequence, last position) its runs occur."""

    def __init__(self, sequences: Iterable[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for at, x in enumerate(seq):
                last = self._extend(last, x)
                self.ends[last].add((k, at))
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.ends[self.link[s]] |= self.ends[s]
        self._fresh: dict[int, tuple[tuple[int, int], ...]] = {}

    def fresh(self, s: int) -> tuple[tuple[int, int], ...]:
        """Where the runs of the state that s links to occur without those of s."""
        if s not in self._fresh:
            self._fresh[s] = tuple(sorted(self.ends[self.link[s]] - self.ends[s]))
        return self._fresh[s]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, x: int, q: int) -> int:
        """The state of the runs that reach q from p and its suffixes: q itself or a shorter twin of it."""
        if self.len[q] == self.len[p] + 1:
            return q
        twin = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            return self._split(last, x, self.next[last][x])
        new, p = self._state(self.len[last] + 1, {}, 0), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, x, self.next[p][x])
        return new

    def statistics(self, seq: list[int]) -> list[tuple[int, int]]:
        """For each position the length of the longest known run ending there, and its state."""
        out, s, n = [], 0, 0
        for x in seq:
            while s and x not in self.next[s]:
                s = self.link[s]
                n = self.len[s]
            s, n = (self.next[s][x], n + 1) if x in self.next[s] else (0, 0)
            out.append((n, s))
        return out


class Scanner:
    """Finds spans of notices. min_run: words of the shortest run that counts; gap: most words between runs of a span."""

    def __init__(self, notices: dict[str, list[str]] = NOTICES, base: dict[str, str] = BASE, min_run: int = 3, gap: int = 6, coverage: float = 0.75):
        self.names = [k for k, texts in notices.items() for _ in texts]
        seqs = [words(t) for texts in notices.values() for t in texts]
        phrases = [words(p) for p in base]
        self.ids: dict[bytes, int] = {}
        for seq in [*seqs, *phrases]:
            for w in seq:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.seqs = [[self.ids[w] for w in seq] for seq in seqs]
        self.auto = SuffixAutomaton(self.seqs)
        self.base = [(np.array([self.ids[w] for w in p]), label) for p, label in zip(phrases, base.values(), strict=True)]
        self.min_run, self.gap, self.least = min_run, gap, coverage

    def _runs(self, ids: np.ndarray, at: int, out: dict[int, list[tuple[int, int, int]]]) -> None:
        """Maximal runs of one stretch, by notice: (start in the text, words, start in the notice)."""
        auto, words_ = self.auto, ids.tolist()
        for k, (n, s) in enumerate(auto.statistics(words_)):
            nxt = words_[k + 1] if k + 1 < len(words_) else 0
            fresh = auto.ends[s]
            while n >= self.min_run:
                for notice, end in fresh:
                    seq = self.seqs[notice]
                    if end + 1 == len(seq) or seq[end + 1] != nxt:
                        out.setdefault(notice, []).append((at + k - n + 1, n, end - n + 1))
                # shorter ends of the run, and who holds them but not the longer ones
                fresh, s = auto.fresh(s), auto.link[s]
                n = auto.len[s]

    def _chain(self, notice: int, runs: list[tuple[int, int, int]]) -> list[tuple[float, int, int]]:
        """Best chains as (coverage, first word, last word); each run belongs to one span at most."""
        out: list[tuple[float, int, int]] = []
        near: list[tuple[int, int, int]] = []
        end = 0
        for run in [*sorted(set(runs)), None]:
            if near and (run is None or run[0] > end + self.gap):  # no chain goes over such a gap
                while found := self._spans(notice, near):
                    out += [s for s, _ in found]
                    used = {r for _, path in found for r in path}
                    near = [r for r in near if r not in used]
                near = []
            if run:
                end = max(end, run[0] + run[1]) if near else run[0] + run[1]
                near.append(run)
        return out

    def _spans(self, notice: int, runs: list[tuple[int, int, int]]) -> list[tuple[tuple[float, int, int], list]]:
        """Disjoint chains of these runs that cover enough, each with its runs; the best chain is always among them."""
        size = len(self.seqs[notice])
        best: list[tuple[int, int]] = []  # words covered by the best chain that ends with this run, and the run before
        for k, (t, n, p) in enumerate(runs):
            top = (n, -1)
            for j in range(k - 1, -1, -1):
                tj, nj, pj = runs[j]
                if t - tj > size + self.gap + n:
                    break
                over = max(0, tj + nj - t, pj + nj - p)
                if pj < p and tj < t and t - (tj + nj) <= self.gap and over < n and best[j][0] + n - over > top[0]:
                    top = (best[j][0] + n - over, j)
            best.append(top)
        spans, used = [], set()
        for k in sorted(range(len(runs)), key=lambda k: -best[k][0]):
            j, path = k, []
            while j >= 0 and j not in used:
                path.append(j)
                j = best[j][1]
            # a chain that runs into another one counts with what it adds to that
            covered = best[k][0] - (best[j][0] if j >= 0 and path else 0)
            if path and covered >= self.least * size:
                used.update(path)
                spans.append(((min(1.0, covered / size), runs[path[-1]][0], runs[k][0] + runs[k][1] - 1), [runs[x] for x in path]))
        return spans

    def _resolved(self, spans: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int]]:
        """Spans (label, coverage, first, last, words covered) without those of which half or more lies in another label's that covers more."""
        kept: list[tuple[str, float, int, int]] = []
        longest = 0
        by_first: list[tuple[int, int, str]] = []
        for label, share, first, last, _ in sorted(spans, key=lambda s: (-s[4], -s[1], s[0], s[2], s[3])):
            lo = bisect.bisect_left(by_first, (first - longest, -1, ""))
            clash = False
            for a, b, other in by_first[lo:]:
                if a > last:
                    break
                if other != label and 2 * (min(b, last) - max(a, first) + 1) >= last - first + 1:
                    clash = True
                    break
            if not clash:
                kept.append((label, share, first, last))
                bisect.insort(by_first, (first, last, label))
                longest = max(longest, last - first + 1)
        return sorted(kept, key=lambda s: (s[2], s[3], s[0]))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, float, int, int]]]:
        """Number of words, places of base phrases, spans of notices as (label, coverage, first word, last word)."""
        w = words(text)
        ids = np.fromiter(map(self.ids.get, w, [0] * len(w)), np.int32, len(w)) if w else np.zeros(0, np.int32)
        known = np.flatnonzero(ids)
        if len(known) < 2:
            return len(w), [], []
        places = []
        for seq, label in self.base:
            at = known[: len(known) - len(seq) + 1]
            at = at[ids[at] == seq[0]]
            at = at[at + len(seq) <= len(ids)]
            for k in range(1, len(seq)):
                at = at[ids[at + k] == seq[k]]
            places += [(int(x), label) for x in at]
        edge = np.flatnonzero(np.diff(known) > 1)
        first, last = known[np.r_[0, edge + 1]], known[np.r_[edge, len(known) - 1]]
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(first, last, strict=True):
            if b - a + 1 >= self.min_run:
                self._runs(ids[a : b + 1], int(a), runs)
        spans = [(self.names[n], share, a, b, round(share * len(self.seqs[n]))) for n, r in runs.items() for share, a, b in self._chain(n, r)]
        return len(w), sorted(places), self._resolved(spans)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, n_words, base places (word, label), spans (label, coverage, first, last word).

    Null texts count as empty: no words, no places, no spans. Repeated rows each give a row, an empty table none; other
    columns of df are not read and cannot clash. Texts are read whole.
    """

    def run(batches):
        s = Scanner(**options)
        for b in batches:
            n, places, spans = zip(*(s.scan(x.as_py()) for x in b.column(1)), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(n, pa.int64()),
                    pa.array([[{"word": w, "label": x} for w, x in p] for p in places], pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                    pa.array([[{"label": x, "coverage": c, "first": f, "last": t} for x, c, f, t in p] for p in spans], pa.list_(pa.struct([("label", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))),
                ],
                ["id", "n_words", "base", "spans"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return (
        df.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text")
        .mapInArrow(run, f"id {kind}, n_words bigint, base array<struct<word:bigint,label:string>>, spans array<struct<label:string,coverage:double,first:bigint,last:bigint>>")
        .withColumnRenamed("id", id_col)
    )


def license_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """scan_licenses as one flat row per document: n_words, n_base, first_word, last_word, base_labels, labels, n_spans, score (best coverage, 1 where a base phrase stands).

    Null and empty texts have 0 words, no places (first_word and last_word null), empty labels and score 0. Repeated rows
    each give a row, a null id stays null, an empty table gives none, other columns are not read. Labels are distinct and
    in order of code points, so ties don't matter.
    """
    return scan_licenses(df, id_col, text_col, **options).selectExpr(
        f"`{id_col}`",
        "n_words",
        "CAST(size(base) AS bigint) AS n_base",
        "array_min(base.word) AS first_word",
        "array_max(base.word) AS last_word",
        "array_join(array_sort(array_distinct(base.label)), ',') AS base_labels",
        "array_join(array_sort(array_distinct(concat(base.label, spans.label))), ',') AS labels",
        "CAST(size(spans) AS bigint) AS n_spans",
        "CASE WHEN size(base) > 0 THEN 1D ELSE coalesce(array_max(spans.coverage), 0D) END AS score",
    )
