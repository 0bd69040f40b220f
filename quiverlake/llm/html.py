"""Main text of web pages by site template removal.

Every element's subtree is hashed (its tag, its words and the hashes of its children). Spark counts on how many different
pages a hash occurs, for every host and for every section of a host (the first folder of its paths, for hosts with several
layouts); subtrees that recur on a large share of them are template and are deleted.
What names itself no article (navigation, header, footer, aside, forms, scripts, styles, adverts, notices, comments) is
deleted too, for hosts with few pages have no template to count. A name alone does not delete what holds the article:
elements around the page's main or article element stay, and so do, if next to nothing else would be left, those with the
bulk of the text. If the page names its article (main, else article), the text is that of the article; then what recurs is
deleted inside it only if it is neither prose (paragraphs, headlines, list items and the like, for articles quote each
other) nor the bulk of it.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import materialise, small_enough
from quiverlake.llm.urls import SALTS, split_urls

#: Elements without content; those whose content is not markup; those that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math object canvas audio video".split())
NEVER = RAW | frozenset("head button select".split())
#: Elements that seldom hold main text; a name in class, id or role says the same.
SELDOM = frozenset("nav header footer aside form menu dialog".split())
#: Elements that hold prose; those that stand in a line.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element (value) that a start tag (key) ends.
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "optgroup": ("select",)}
#: Words in class, id and role names by which pages mark what is not the article; those of readers' comments; those that make a name a state of the page and not what the element is.
_NOISE = frozenset("ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sponsors sidebar nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended toolbar widget widgets search contentinfo complementary dialog form paywall".split())
_COMMENTS = frozenset("comment comments commentlist respond disqus replies".split())
_STATES = frozenset("no not non has have with without is show hide".split())
_ARTICLE_NOISE = frozenset("ad advert promo related teaser".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: What an element is by its own account.
PLAIN, SELDOM_MAIN, COMMENTS, NO_TEXT = range(4)


def _mark(tag: str, attrs: str) -> int:
    if tag in NEVER:
        return NO_TEXT
    mark = SELDOM_MAIN if tag in SELDOM else PLAIN
    if not attrs:
        return mark
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return NO_TEXT
        if name not in ("class", "id", "role") or tag in ("body", "html", "main"):
            continue
        for token in value.split():
            words = re.split("[_-]+", token)
            if not _COMMENTS.isdisjoint(words) and words[0] not in _STATES:
                return COMMENTS
            noise = _ARTICLE_NOISE if tag == "article" else _NOISE
            if (words[0] not in _STATES and not noise.isdisjoint(words)) or (tag != "article" and ("side-bar" in token or "skip-link" in token)):
                mark = SELDOM_MAIN
    return mark


class Page:
    """Elements in page order: tag, parent, mark, and parts (texts, and the numbers of child elements). Element 0 is the root.

    Tags that are missing or out of place are mended as browsers do in the common cases; any text is accepted, however
    deep its elements lie.
    """

    __slots__ = ("hashes", "marks", "parent", "parts", "size", "tags")

    def __init__(self, html: str):
        self.tags, self.parent, self.marks = ["#root"], [0], [PLAIN]
        self.parts: list[list[int | str]] = [[]]
        self._parse(html)
        self._judge()
        self._hash()

    def _add(self, tag: str, mark: int, parent: int) -> int:
        k = len(self.tags)
        self.tags.append(tag)
        self.parent.append(parent)
        self.marks.append(mark)
        self.parts.append([])
        self.parts[parent].append(k)
        return k

    def _parse(self, html: str) -> None:
        tags = self.tags
        stack, opened = [0], Counter()

        def close(k: int) -> None:
            for x in stack[k:]:
                opened[tags[x]] -= 1
            del stack[k:]

        at, low = 0, None
        for m in iter(lambda: _TOKEN.search(html, at), None):
            if m.start() > at:
                self.parts[stack[-1]].append(html[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if not opened[tag]:
                    if tag in ("br", "p"):
                        self._add(tag, PLAIN, stack[-1])
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        close(k)
                        break
                    if tags[stack[k]] in ("article", "main", "body", "table", "td") and (tag in INLINE or tag in ("p", "li")):
                        break
                continue
            if tag in _P_ENDS and opened["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "p":
                        close(k)
                        break
                    if tags[stack[k]] not in INLINE:
                        break
            ends = _ENDS.get(tag)
            if ends and any(opened[x] for x in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in _SCOPE[tag]:
                        break
                    if tags[stack[k]] in ends:
                        close(k)
                        if tag not in ("tr", "tbody", "tfoot"):
                            break
            if tag == "body" and opened["head"]:
                close(next(k for k, n in enumerate(stack) if tags[n] == "head"))
            node = self._add(tag, _mark(tag, attrs), stack[-1])
            if tag in VOID or attrs.rstrip().endswith("/") and tag in RAW:
                continue
            if tag in RAW:
                if low is None:
                    low = html.lower()
                    low = low if len(low) == len(html) else re.sub("[A-Z]", lambda c: c[0].lower(), html)
                end = low.find(f"</{tag}", at)
                stop = len(html) if end < 0 else html.find(">", end)
                at = len(html) if stop < 0 or end < 0 else stop + 1
                continue
            stack.append(node)
            opened[tag] += 1
        if at < len(html):
            self.parts[stack[-1]].append(html[at:])

    def _keep(self, saved: set[int]) -> list[bool]:
        keep = [True]
        for k in range(1, len(self.tags)):
            keep.append(keep[self.parent[k]] and (self.marks[k] == PLAIN or k in saved))
        return keep

    def scopes(self) -> list[list[int]]:
        """Elements that hold the page's main text: outermost main elements, outermost articles, the root; a list counts where those before have no text."""
        out = []
        for tag in ("main", "article"):
            found, inside = [], [False]
            for k in range(1, len(self.tags)):
                own = self.tags[k] == tag and self.marks[k] == PLAIN
                inside.append(inside[self.parent[k]] or own)
                if own and not inside[self.parent[k]]:
                    found.append(k)
            if found:
                out.append(found)
        return [*out, [0]]

    def _judge(self) -> None:
        """Settles marks: those of elements that hold the article are taken back, and what lies in a marked element gets its mark."""
        n = len(self.tags)
        own, link = [0] * n, [False] * n
        for k in range(n):
            link[k] = self.tags[k] == "a" or (k > 0 and link[self.parent[k]])
            if not link[k]:
                own[k] = sum(len(p.strip()) for p in self.parts[k] if isinstance(p, str))
        prose = own[:]  # text outside links and of no comments, by subtree
        core = [True] * n  # elements that can hold the article: not in comments, nor in what never has text
        for k in range(1, n):
            core[k] = core[self.parent[k]] and self.marks[k] < COMMENTS
        for k in range(n - 1, 0, -1):
            if core[k]:
                prose[self.parent[k]] += prose[k]
        saved: set[int] = set()
        named = ([k for k in range(1, n) if self.tags[k] == tag and self.marks[k] == PLAIN and core[k] and prose[k]] for tag in ("main", "article"))
        named = next((found for found in named if found), [])
        if named:
            k = max(named, key=lambda x: (prose[x], -x))
            while k:
                saved.add(k)
                k = self.parent[k]
        keep = self._keep(saved)
        # where next to nothing is left, or not much more than a headline, what has the bulk of the text holds the article, whatever its name
        scope = next(s for s in ({k for k in found if keep[k]} for found in self.scopes()) if 0 in s or any(prose[k] for k in s))
        within = [False] * n
        kept, headline = 0, False
        for k in range(n):
            within[k] = k in scope or (k > 0 and within[self.parent[k]])
            if within[k] and keep[k]:
                kept += own[k]
                headline = headline or (self.tags[k] == "h1" and prose[k] > 0)
        top = max(scope, key=lambda x: (prose[x], -x))
        if kept * (10 if headline else 4) < prose[top]:
            while True:
                child = max((p for p in self.parts[top] if not isinstance(p, str) and core[p]), key=lambda x: (prose[x], -x), default=None)
                if child is None or 2 * prose[child] <= prose[top]:
                    break
                saved.add(child)
                top = child
            keep = self._keep(saved)
        self.marks, self.size = [PLAIN if x else NO_TEXT for x in keep], prose

    def _hash(self) -> None:
        """Hash of every kept subtree that holds words (else None), from the leaves up."""
        self.hashes: list[int | None] = [None] * len(self.tags)
        for k in range(len(self.tags) - 1, -1, -1):
            if self.marks[k] == PLAIN:
                own = []
                for p in self.parts[k]:
                    if isinstance(p, str):
                        words = " ".join(p.split())
                        if words:
                            own.append(b"\x02" + words.encode("utf-8", "surrogatepass"))
                    elif self.hashes[p] is not None:
                        own.append(b"\x03%d" % self.hashes[p])
                if own:
                    self.hashes[k] = xxhash.xxh3_64_intdigest(b"\x01".join([self.tags[k].encode("utf-8", "surrogatepass"), *own])) - (1 << 63)

    def subtrees(self) -> set[int]:
        """Hashes of the subtrees that may be template."""
        return {h for h, tag in zip(self.hashes, self.tags, strict=True) if h is not None and tag not in ("#root", "html", "body")}

    def text(self, scope: int, drop: frozenset[int] | set[int]) -> str:
        """Text of an element without the subtrees in `drop`; white space in a block is one blank, and so is what lies between blocks."""
        if self.marks[scope] != PLAIN:
            return ""
        named = self.tags[scope] in ("main", "article")
        out: list[str] = []
        stack = [(scope, iter(self.parts[scope]))]
        while stack:
            k, rest = stack[-1]
            for p in rest:
                if isinstance(p, str):
                    out.append(unescape(p) if "&" in p else p)
                elif self.marks[p] == PLAIN:
                    if self.tags[p] not in INLINE:
                        out.append("\n")
                    stays = named and (self.tags[p] in PROSE or self.tags[p] in INLINE or 2 * self.size[p] > self.size[scope])
                    if self.hashes[p] is not None and (stays or self.hashes[p] not in drop):
                        stack.append((p, iter(self.parts[p])))
                        break
            else:
                stack.pop()
                if self.tags[k] not in INLINE:
                    out.append("\n")
        return " ".join("".join(out).split())

    def main_text(self, drop: frozenset[int] | set[int] = frozenset()) -> str:
        for scope in self.scopes():
            texts = [t for t in (self.text(k, drop) for k in scope) if t]
            if texts:
                return " ".join(texts)
        return ""


def main_text(html: str | None, drop: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text without the subtrees in `drop`; null and empty pages have the empty text."""
    return Page(html).main_text(drop) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 8, min_share: float = 0.6, broadcast_rows: int = 200_000) -> DataFrame:
    """Per page: id, url, text (never null) and n_chars (code points).

    A subtree is template on a host, or in a section of it, if it recurs on `min_pages` different pages there and on
    `min_share` of them; pages of one tree (without what is left out anyway) are one page, however many rows they have.
    Null and empty pages
    have the empty text; pages whose URL is null or has no host belong to no site and lose no template; repeated rows
    each give a row; an empty table gives none; other columns are not read. The counts cover all
    pages; a site's table of templates is bounded by min_share (at most 1 / min_share pages' worth). The tables are
    broadcast only while all of them together have at most `broadcast_rows` rows, else joined, a site's pages being dealt out.
    """
    base = split_urls(pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")), "url").withColumnRenamed("_q_host", "host")
    # a site is a host, or a section of one; 64-bit hashes stand for both
    section = F.regexp_extract("_q_path", "^/([^/]+)/", 1)
    whole = F.when(F.col("host") != "", F.xxhash64("host"))
    part = F.when((F.col("host") != "") & (section != ""), F.xxhash64("host", section))
    base = base.select("id", "url", "html", whole.alias("whole"), part.alias("part"))

    def hashes(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                cut = b.slice(lo, 64)
                sizes, trees, out = [], [], []
                for page in cut.column(2):
                    got = Page(page.as_py() or "")
                    own = [None, *got.subtrees()]  # null stands for the page
                    sizes.append(len(own))
                    trees += [got.hashes[0] or 0] * len(own)
                    out += own
                at = pa.array(np.repeat(np.arange(cut.num_rows), sizes))
                yield pa.RecordBatch.from_arrays([cut.column(0).take(at), cut.column(1).take(at), pa.array(trees, pa.int64()), pa.array(out, pa.int64())], ["whole", "part", "tree", "h"])

    # a page that counts in a section counts on its host too
    found = base.where("whole IS NOT NULL").select("whole", "part", "html").mapInArrow(hashes, "whole bigint, part bigint, tree bigint, h bigint")
    found = found.select(F.explode(F.when(F.col("part").isNull(), F.array("whole")).otherwise(F.array("whole", "part"))).alias("site"), "h", "tree")
    counts = found.groupBy("site", "h").agg(F.countDistinct("tree").alias("n")).where(F.col("n") >= min_pages)
    counts = materialise(counts, "html-counts")
    sizes = counts.where("h IS NULL").select("site", F.col("n").alias("pages"))
    seen = counts.where("h IS NOT NULL").join(sizes, "site").where(F.col("n") >= F.col("pages") * min_share)
    templates = materialise(seen.groupBy("site").agg(F.collect_list("h").alias("hashes")), "html-templates")
    fits = small_enough(templates.select(F.explode("hashes")), broadcast_rows)
    joined = base
    for key in ("whole", "part"):
        own = templates.select(F.col("site").alias(key), F.col("hashes").alias(f"of_{key}"))
        if fits:
            joined = joined.join(F.broadcast(own), key, "left")
        else:
            salted = own.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
            joined = joined.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], "left").drop("salt")
    drop = F.array_union(*(F.coalesce(f"of_{key}", F.array().cast("array<bigint>")) for key in ("whole", "part")))
    joined = joined.select("id", "url", "html", drop.alias("hashes"))

    def texts(batches):
        for b in batches:
            out = [main_text(h.as_py(), frozenset(d.as_py() or ())) for h, d in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])

    kind, url_kind = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    return joined.mapInArrow(texts, f"id {kind}, url {url_kind}, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
