"""Token counts with a prefix table.

A byte-level BPE first splits a text into pieces and merges inside each piece only, and no piece goes from a visible
character over to the white space behind it; nor can a cut behind a piece change the pieces before it, unless it falls
into white space. So the dynamic program goes over the text's units (white space, then visible characters; long ones
fall into their pieces): the exact count up to a unit's end is the one before plus the memoised count of the unit.
The count of any other prefix is the last entry before it plus the count of the rest, which is less than one unit.
Counts, truncation and budget questions are all answered from the table; no prefix is encoded anew.

Texts with characters on whose class Unicode versions differ take their pieces from the tokenizer itself; in texts that
hold the string of an added token, units that touch one are counted by the library. Both have tables as all others do.
Tokenizers that are no plain byte-level BPE (a normalizer, another split, SentencePiece) have tables of one entry.
"""

from __future__ import annotations

import bisect
import json
import re
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Blocks whose white space, letters and numbers all Unicode versions class alike.
_ODD = re.compile("[^\u0000-ԯ‐-‧‰-⁞₠-₿一-龥가-힣ぁ-ヿ]")
#: Characters that Python takes as white space and the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: The split of the tokenizer's byte-level pre-tokenizer into pieces (a fixed value).
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest unit that is one entry of the table, and that is memoised.
LONG = 64


class PrefixCounter:
    """Counts tokens of texts and of their prefixes as the tokenizer in `path` gives them (.json: tokenizers, .model: sentencepiece).

    Special tokens are never inserted, and truncation or padding that the file asks for is switched off. At most `memo`
    units of at most LONG characters are kept, which bounds the memory in bytes.
    """

    def __init__(self, path: str, memo: int = 500_000):
        self.plain, self.added, self.whole = False, [], None
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.whole = lambda text: len(model.encode(text))
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.library = library
            self.whole = lambda text: len(library.encode(text, add_special_tokens=False))
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
            byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            local = all(not t.get("lstrip") and not t.get("rstrip") and not re.search(r"\s", t["content"]) for t in added)
            self.plain = spec.get("normalizer") is None and byte_level and local
            self.added = [t["content"] for t in added]
        self.runs = re.compile(r"\s\s").search
        self.units = re.compile(r"\s*\S+|\s+").findall
        self.apart = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+").findall
        self.split = regex.compile(_SPLIT).findall
        self.memo: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.room = memo

    def odd(self, text: str) -> bool:
        """Whether the text's pieces are to come from the library."""
        return any(t in text for t in self.added) or _SEPARATORS.search(text) is not None or (not text.isascii() and _ODD.search(text) is not None)

    def parts(self, text: str) -> list[str]:
        """The units of a text."""
        if self.runs(text) or "\0" in text:
            return self.units(text)
        parts = text.replace(" ", "\0 ").split("\0")  # every white space stands alone: cut before blanks
        return parts if parts[0] else parts[1:]

    def fill(self, parts: list[str]) -> list[int]:
        memo = self.memo
        got = list(map(memo.get, parts))
        if None in got:
            if len(memo) > self.room:
                memo.clear()
            for k, n in enumerate(got):
                if n is None:
                    u = parts[k]
                    n = memo.get(u)
                    if n is None:
                        n = sum(map(self.piece, self.split(u)))
                        if len(u) <= LONG:
                            memo[u] = n
                    got[k] = n
        return got

    def piece(self, p: str) -> int:
        n = self.pieces.get(p)
        if n is None:
            n = self.whole(p)
            if len(p) <= LONG:
                if len(self.pieces) > self.room:
                    self.pieces.clear()
                self.pieces[p] = n
        return n

    def _by_pieces(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Ends and counts of pieces; those of white space count with the next."""
        ends, totals, at, total = [], [], 0, 0
        for p in pieces:
            at += len(p)
            total += self.piece(p)
            if not p.isspace():
                ends.append(at)
                totals.append(total)
        if at and (not ends or ends[-1] < at):
            ends.append(at)
            totals.append(total)
        return ends, totals

    def _by_library(self, text: str) -> tuple[list[int], list[int]]:
        if not any(t in text for t in self.added):
            return self._by_pieces([text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)])
        ends, totals, at, total = [], [], 0, 0
        for u in self.apart(text):  # white space, and then what is none: no added token goes over its edge
            if any(t in u for t in self.added):
                more, n = [len(u)], [self.whole(u)]
            else:
                more, n = self._by_library(u)
            ends += [at + e for e in more]
            totals += [total + x for x in n]
            at, total = ends[-1], totals[-1]
        return ends, totals

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Ends (in characters) of the units, and the count of the text up to each; the last entry is that of the whole text."""
        if not text:
            return [], []
        if not self.plain:
            return [len(text)], [self.whole(text)]
        if self.odd(text):
            return self._by_library(text)
        parts = self.parts(text)
        if max(map(len, parts)) <= LONG:
            return list(accumulate(map(len, parts))), list(accumulate(self.fill(parts)))
        ends, totals, at, total = [], [], 0, 0
        for u, n in zip(parts, self.fill([u if len(u) <= LONG else "" for u in parts]), strict=True):
            more = ([len(u)], [n]) if len(u) <= LONG else self._by_pieces(self.split(u))
            ends += [at + x for x in more[0]]
            totals += [total + x for x in more[1]]
            at, total = ends[-1], totals[-1]
        return ends, totals

    def at(self, text: str, table: tuple[list[int], list[int]], p: int) -> int:
        """Exact number of tokens of text[:p]."""
        p = max(0, min(p, len(text)))
        ends, totals = table
        if p == 0:
            return 0
        if p == len(text):
            return totals[-1]
        if not self.plain:
            return self.whole(text[:p])
        k = bisect.bisect_right(ends, p)
        start, base = (ends[k - 1], totals[k - 1]) if k else (0, 0)
        return base + (self.whole(text[start:p]) if p > start else 0)

    def every(self, text: str) -> list[int]:
        """The count of every prefix, from the empty one to the whole."""
        t = self.table(text)
        return [self.at(text, t, p) for p in range(len(text) + 1)]

    def longest(self, text: str, table: tuple[list[int], list[int]], budget: int) -> int:
        """Characters of the longest prefix that has at most `budget` tokens: between the last entry within it and the next."""
        ends, totals = table
        if not ends or totals[-1] <= budget:
            return len(text)
        k = bisect.bisect_right(totals, budget)
        low, upto = (ends[k - 1] if k else 0), ends[k]
        return next((p for p in range(upto - 1, low, -1) if self.at(text, table, p) <= budget), low)


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_tables(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """Per row: id, ends and counts of the prefix table, n_tokens, and (given a budget) cut, the characters of the longest prefix that keeps to it.

    Null and empty texts have an empty table, 0 tokens and cut 0; repeated rows each give a row, a null id stays null, an
    empty table of texts gives none; other columns are not read. A text's table is about as large as the text.
    """

    def run(batches):
        c = counter(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows: dict[str, list] = {"ends": [], "counts": [], "n_tokens": [], "cut": []}
                for x in part.column(1):
                    text = x.as_py() or ""
                    t = c.table(text)
                    rows["ends"].append(t[0])
                    rows["counts"].append(t[1])
                    rows["n_tokens"].append(t[1][-1] if t[1] else 0)
                    rows["cut"].append(None if budget is None else c.longest(text, t, budget))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows["ends"], pa.list_(pa.int32())), pa.array(rows["counts"], pa.list_(pa.int32())), pa.array(rows["n_tokens"], pa.int64()), pa.array(rows["cut"], pa.int32())],
                    ["id", "ends", "counts", "n_tokens", "cut"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text").mapInArrow(run, f"id {kind}, ends array<int>, counts array<int>, n_tokens bigint, cut int").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens (the last entry of its prefix table), over_limit and cut (characters of the longest prefix of at most `limit` tokens).

    Null texts count as empty: 0 bytes, 0 tokens, cut 0. Texts are read whole; repeated rows each give
    a row; a null id stays null; an empty table gives none; columns of df other than the two named are not read and cannot clash.
    """

    def run(batches):
        c = counter(path)
        for b in batches:
            col = b.column(1)
            n, cut = [], []
            for x in col:
                text = x.as_py() or ""
                t = c.table(text)
                n.append(t[1][-1] if t[1] else 0)
                cut.append(c.longest(text, t, limit))
            size = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(cut, pa.int64())], ["id", "n_bytes", "n_tokens", "over_limit", "cut"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text").mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, cut bigint").withColumnRenamed("id", id_col)
