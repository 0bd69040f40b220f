"""Cases and brute-force versions beyond the plain runs of test_operators."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, SF, ascii_lower, brute_components, docs, plain_targets

from quiverlake.llm import ann, chat, common, decontam, dedup, html, licenses, mixing, queries, tokens, toxicity, urls

PAGES = "page_id bigint, url string, html string"

# 1


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="content no-sidebar"><h1>T</h1><p>one two</p></div>', "T one two"),
        ('<div class="layout with-sidebar"><p>one two</p><div class="sidebar">no</div></div>', "one two"),
        ('<body><nav>no</nav><div class="search-results"><p>one two three</p></div></body>', "one two three"),
        ('<h1>Title</h1><div class="entry social"><p>' + "one two " * 40 + "</p></div>", "Title " + ("one two " * 40).strip()),
        ('<div id="page-header-wrapper"><header>no</header><p>one two</p><footer>no</footer></div>', "one two"),
        ('<div role="form"><p>one</p></div>', "one"),
        ("<form><header>no</header><div><p>body text</p></div><footer>no</footer></form>", "body text"),
        ('<div class="related"><main><p>one</p></main></div><div>no</div>', "one"),
        ("<main><h1>H</h1><p>intro</p><article>a</article><article>b</article><p>end</p></main>", "H intro a b end"),
        ('<article><p>one</p><section class="comments"><p>' + "no " * 200 + "</p></section></article>", "one"),
        ('<article class="post"><p>' + "one " * 30 + '</p></article><div class="related"><article><p>no</p></article></div>', ("one " * 30).strip()),
        ('<div class="related"><article><p>one two</p></article></div><main></main>', "one two"),
        ('<p>one</p><div class="newsletter">no</div><div class="sidebar">no</div>', "one"),
        ("<div>" * 2000 + "<header>no</header>deep" + "</div>" * 2000 + "<footer>no</footer>", "deep"),
        ("<p>" + "w " * 200000, ("w " * 200000).strip()),
    ],
)
def test_html_wrappers(page, want):
    assert html.main_text(page) == want


def test_html_deep_pages_take_time_by_size():
    """A hundred thousand levels; parsing them all took less than a second when this was written."""
    page = html.Page("<div>" * 100_000 + "<p>x</p>" + "</div>" * 100_000)
    assert page.main_text() == "x" and len(page.tags) == 100_002


def brute_templates(rows, least=8, share=0.6):
    """Subtrees (by page) of all different pages of a host and of a section, counted in plain Python."""
    groups = collections.defaultdict(dict)
    for _, url, page in rows:
        m = re.match(r"[^:]*://([^/]*)(?:/([^/]+)/)?", url or "")
        if m:
            p = html.Page(page or "")
            for key in {(m[1], ""), (m[1], m[2] or "")}:
                groups[key][p.hashes[0]] = p.subtrees()
    out = {}
    for key, pages in groups.items():
        n = collections.Counter(h for s in pages.values() for h in s)
        out[key] = {h for h, c in n.items() if c >= least and c >= share * len(pages)}
    return out


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_html_templates_of_hosts_and_sections(spark, broadcast_rows):
    """As counted by brute force; two layouts, each below 60 % of the host, lose their blocks; copies count once; broadcast or not."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        section = "news" if i % 2 else "shop"
        menu = "<div><p>Our paper</p><p>Every day</p></div>" if i % 2 else "<div><p>Buy hats</p></div>"
        own = " ".join(rng.choices(["red", "blue", "green", "stone", "tree"], k=20))
        rows.append((i, f"http://h.org/{section}/{i}", f"<body>{menu}<div><p>{own} {i}</p></div><p>Terms</p></body>"))
    rows += [(100 + i, rows[0][1], rows[0][2]) for i in range(90)] + [(300, None, rows[0][2]), (301, "no", None), (None, "http://h.org/news/x", "")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, PAGES), broadcast_rows=broadcast_rows).collect()}
    drop = brute_templates(rows)
    for i, url, page in rows:
        m = re.match(r"[^:]*://([^/]*)(?:/([^/]+)/)?", url or "")
        gone = drop.get((m[1], ""), set()) | drop.get((m[1], m[2] or ""), set()) if m else set()
        assert got[i]["text"] == html.main_text(page, gone) and got[i]["n_chars"] == len(got[i]["text"])
    assert got[1]["text"].endswith(" 1") and "paper" not in got[1]["text"] and "hats" not in got[100]["text"] and "Terms" in got[300]["text"]


def test_html_keeps_shared_prose_of_articles(spark):
    """Articles that all quote one paragraph keep it; a box that recurs among them goes."""
    rows = [(i, f"http://h.org/{i}", f"<article><p>Quoted by all</p><p>own {i} {'x' * i}</p><div><div>Share this</div></div></article>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Quoted by all own {i} {'x' * i}".strip() for i in range(20)}


# 2


def leaky(items, seed=3):
    rng = random.Random(seed)
    return [(k, f"{'pad ' * rng.randint(0, 90)}{t} {'tail ' * 5}", "s") for k, (_, t) in enumerate(items)]


def test_decontamination_in_parts_is_that_of_one(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of"] * 20
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 60)))) for k in range(40)]
    items += [items[0], items[0], (0, items[1][1])]  # repeated, and an id with two texts
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = docs(spark, leaky(items) + [(500, None, "s"), (501, "", "s"), (None, items[2][1], "s")])
    results = []
    for chars in (400, 10**6):
        rows = decontam.find_leaks(frame, bench, part_chars=chars).collect()
        results.append(sorted((str(r["doc_id"]), r["item_id"], round(r["score"], 9), r["first_word"]) for r in rows))
        assert decontam.drop_leaks(frame, bench, part_chars=chars).count() == 2
    assert results[0] == results[1]
    assert {(str(k), i) for k, (i, _) in enumerate(items)} <= {r[:2] for r in results[0]} and ("None", 2) in {r[:2] for r in results[0]}
    assert decontam.index_parts(bench, part_chars=400).count() > 3


def test_decontamination_of_short_items_and_long_texts(spark):
    """An item of one word leaks only from a document that is that word; a text of half a million words is searched whole."""
    rng = random.Random(6)
    item = " ".join(f"u{k}" for k in range(30))
    bench = spark.createDataFrame([(1, "The"), (2, "Yes. No!"), (3, item)], "item_id bigint, text string")
    long = " ".join(rng.choices(["the", "a", "yes", "no", "of"], k=500_000))
    got = decontam.find_leaks(docs(spark, [(1, "the", "s"), (2, "The cat", "s"), (3, "yes no", "s"), (4, f"{long} {item} {long}", "s"), (5, long, "s")]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (3, 2), (4, 3)}


def test_block_bounds_hold_every_hit():
    """Every (passage, block) with an item at or above the threshold is among those that the bounds leave."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    ix = decontam.Index([(k, *decontam.question_and_answer(" ".join(rng.choices(vocabulary, k=rng.randint(5, 30))))) for k in range(50)])
    terms, of = [], []
    for p in range(40):
        own = sorted(rng.sample(range(1, len(ix.vocab) + 1), rng.randint(1, 40)))
        terms += own
        of += [p] * len(own)
    at, blk = ix.blocks(np.array(terms), np.array(of), 0.4)
    left = set(zip(at.tolist(), blk.tolist()))
    for p in range(40):
        score, bound = collections.Counter(), collections.Counter()
        for t, o in zip(terms, of):
            if o == p:
                for i, x in ix.postings[t]:
                    score[i] += x
                for b, x in ix.block_max[t].items():
                    bound[b] += x
        assert {(p, i // ix.block) for i, s in score.items() if s >= 0.4} <= left
        assert {b for q, b in left if q == p} == {b for b, x in bound.items() if x >= 0.4 - 1e-9}


# 3


def test_skew_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    left = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 7), (3, 8)], "a bigint, v bigint")
    right = spark.createDataFrame([(1, "x", 50), (2, "y", 1)], "a bigint, r string, n bigint")
    inner = sorted(map(tuple, common.skew_join(left, right, ["a"], "n", 52).collect()))
    assert inner == sorted([(1, k, "x") for k in range(50)] + [(2, 7, "y")])
    outer = common.skew_join(left, right, ["a"], "n", 52, "left").where("r IS NULL").collect()
    assert [tuple(r) for r in outer] == [(3, 8, None)]


def test_near_duplicates_with_hot_groups(spark, monkeypatch):
    """A group of exact copies, empty texts and an id with two texts, with the joins for hot keys in use."""
    from quiverlake.llm import components

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    plain = components.connected
    monkeypatch.setattr(dedup, "connected", lambda edges: plain(edges, finish=0))
    rng = random.Random(8)
    rows = [(k, "one text that stands here many times over and over", "s") for k in range(60)] + [(100 + k, "" if k % 2 else None, "s") for k in range(40)]
    rows += [(200 + k, " ".join(rng.choices([f"w{j}" for j in range(50)], k=30)), "s") for k in range(20)]
    got = dedup.near_duplicates(docs(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components([(i, t) for i, t, _ in rows])
    both = docs(spark, [*rows[:3], (2, rows[-1][1], "s"), rows[-1]])  # id 2 ties two texts
    assert {r["doc_id"]: r["component_id"] for r in dedup.near_duplicates(both).collect()} == {0: 0, 1: 0, 2: 0, rows[-1][0]: 0}


# 4


def test_crf_long_neutral_stretches_and_many_marks():
    """Marginals behind thousands of neutral tokens are those of walking all of them."""
    m = toxicity.Crf({"w:bad": 5.0}, -1.0, np.array([[0.5, -1.0], [-2.0, 3.0]]), 0.3)
    for gap in (0, 255, 256, 257, 3000):
        text = ["x"] * gap + ["bad"] + ["x"] * gap + ["bad"] + ["x"] * gap
        link, f = np.exp(m.trans), []
        for k, w in enumerate(text):
            v = np.array([1.0, math.exp(m.delta(w))])
            a = (np.array([1.0, math.exp(m.start)]) if k == 0 else f[-1] @ link) * v
            f.append(a / a.sum())
        b = np.ones(2)
        want = {}
        for k in range(len(text) - 1, -1, -1):
            p = f[k] * b
            want[k] = p[1] / p.sum()
            b = link @ (np.array([1.0, math.exp(m.delta(text[k]))]) * b)
            b /= b.sum()
        assert all(abs(p - want[k]) < 1e-9 for k, p in m.marginals(text))


def test_toxic_sample_is_bounded(spark):
    """Rows and characters of the training sample keep to their bounds; repeated ids and rows are one; the rest is scored all the same."""
    rng = random.Random(5)
    rows = [(k, " ".join([*rng.choices("abcdefgh", k=9), *(["grobian"] if k % 4 == 0 else []), *rng.choices("abcdefgh", k=9)]), "s") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] * 2, "doc_id bigint, toxic int")
    frame = docs(spark, rows + rows[:50] + [(4, "fine " * 10_000, "s")])
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(frame, labels).collect()}
    assert all(got[k] == int(k % 4 == 0) for k in range(200) if k != 4)
    assert toxicity.train(frame, labels, chars=100).weights == {} != toxicity.train(frame, labels).weights  # no text is short enough
    assert toxicity.train(frame, labels.limit(0)).weights == {}


def test_toxic_spans_and_scores_by_brute_force(spark):
    """The query's scores and spans are those of the trained field, token by token."""
    rows = [(k, "a b " + ("c grobian d Grobian, e " if k % 5 == 0 else "c d e ") + f"t{k}", "s") for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(300)], "doc_id bigint, toxic int")
    model = toxicity.train(docs(spark, rows), labels)
    for r in toxicity.score_documents(docs(spark, rows), labels).collect():
        text = rows[r["doc_id"]][1]
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", text)]
        p = dict(model.marginals([w for *_, w in words]))
        assert abs(r["score"] - (1 - np.prod([1 - x for x in p.values()]))) < 1e-12
        toxic = [(a, b) for k, (a, b, _) in enumerate(words) if p.get(k, 0) >= 0.5]
        assert [(s["first"], s["end"]) for s in r["spans"]] == (toxic if r["score"] >= 0.3 else [])


# 5


def test_tokens_of_texts_outside_the_plain_blocks():
    """Emoji, Devanagari, Thai, separators and added tokens: the table answers every prefix as the library does."""
    c = tokens.PrefixCounter(queries.tokenizer_path())
    added = c.added[0] if c.added else "x"
    texts = ["\U0001f600 ok \U0001f600\U0001f600。はい。", "नमस्ते दुनिया  और\n", "ภาษาไทย 123", "a\x1c b\x1d\x1dc \x1f", f"a {added}  b{added}c　 {added} ", "x　  y z   w", "don't we'll '", "漢字" * 60 + "。", "a" * 200 + "  " + "b1" * 50]
    for t in texts:
        table = c.table(t)
        want = [c.whole(t[:p]) for p in range(len(t) + 1)]
        assert [c.at(t, table, p) for p in range(len(t) + 1)] == want, t
        for budget in range(0, want[-1] + 2, 3):
            assert c.longest(t, table, budget) == max(p for p, n in enumerate(want) if n <= budget)


def test_long_odd_texts_have_long_tables():
    """Ten thousand characters outside the plain blocks: many entries, so that a budget is answered from one piece."""
    c = tokens.PrefixCounter(queries.tokenizer_path())
    t = "\U0001f600 नमस्ते。ภาษา, " * 600
    ends, totals = c.table(t)
    assert len(ends) > 2000 and totals[-1] == c.whole(t)
    cut = c.longest(t, (ends, totals), totals[-1] // 2)
    assert c.whole(t[:cut]) <= totals[-1] // 2 < c.whole(t[: cut + 40])


def test_truncation_and_padding_of_the_file_are_off(tmp_path):
    import json

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    spec["padding"] = {"strategy": {"Fixed": 9}, "direction": "Right", "pad_to_multiple_of": None, "pad_id": 0, "pad_type_id": 0, "pad_token": "!"}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    plain = tokens.PrefixCounter(queries.tokenizer_path())
    for t in ("", "one", "one two three four five six", "\U0001f600 x"):
        assert tokens.PrefixCounter(str(path)).table(t) == plain.table(t)


# 6


def test_mixing_tilts_every_document_and_meets_the_dual(spark):
    """Rates are exp(multiplier x size) cut at the most, they differ within a source, and the gradient of the dual vanishes."""
    rng = random.Random(1)
    rows = [(k, "w " * int(1 + rng.paretovariate(1.1) * 4), "abcde"[k % 5]) for k in range(3000)]
    got = mixing.mix(docs(spark, rows)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    bent = 0
    for own in by.values():
        target = own[0]["target"]
        assert abs(sum(r["rate"] * r["size"] for r in own) - target) <= 1e-6 * target
        free = [(math.log(r["rate"]) / r["size"]) for r in own if r["rate"] < 3 * (1 - 1e-9)]
        assert max(free) - min(free) < 1e-9 and len({r["rate"] for r in own}) > 10
        full = [r["size"] for r in own if r["rate"] >= 3 * (1 - 1e-9)]
        bent += bool(full)
        assert not full or all(math.exp(free[0] * s) >= 3 * (1 - 1e-6) for s in full)
        assert np.mean([abs(r["copies"] - r["rate"]) < 1 for r in own]) > 0.9
    assert bent


def test_mixing_of_many_sources_and_repeated_rows(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(0, 9), f"s{k % 97:02d}" if k % 97 else None) for k in range(970)] + [(5, "w w w w", "dup")] * 400 + [(None, None, "dup")] * 50
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(dict(sizes))
    got = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert len(got) == len(rows) and all(abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]]) for r in got)
    copies = collections.Counter(r["copies"] for r in got if r["doc_id"] == 5 and r["source"] == "dup")
    assert sum(copies.values()) == 400 and max(copies) - min(copies) <= 1
    order = mixing.ranked(spark.createDataFrame([(s,) for s in [None, "b", "a", "ü", "B", ""]], "source string").repartition(3), "source").collect()
    assert [r["source"] for r in sorted(order, key=lambda r: r["position"])] == ["", "B", "a", "b", "ü", None]


# 7


def test_urls_of_any_length(spark):
    """A host of 120 thousand characters with 60 thousand labels, and a path as long, against rules of many lengths."""
    host, path = "a." * 60_000 + "example.org", "/" + "p/" * 60_000
    rows = [(1, f"http://{host}/es/x"), (2, f"http://x.org{path}"), (3, f"http://{host}"), (4, "http://example.org/es/" + "y" * 100_000)]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), *(("x.org", "/" + "p/" * k, "block" if k % 2 else "allow") for k in range(1, 3000)), ("org", "/", "block")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), urls.rule_table(spark, rules)).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("x.org/" + "p/" * 2999, "block"), 3: (None, "allow"), 4: ("example.org/es/", "block")}


def test_single_urls_are_compared_by_canonical_form(spark):
    listed = spark.createDataFrame([("HTTP://Example.org:80", "block"), ("https://a.org./x?q=1#top", "allow"), (None, "block"), ("nothing", "block")], "url string, verdict string")
    rows = [(1, "http://example.ORG/"), (2, "https://example.org:443#f"), (3, "http://example.org/y"), (4, "http://a.org/x?q=1"), (5, "http://a.org/x?q=2"), (6, None)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), urls.rule_table(spark, [("org", "", "block")]), urls=listed).collect()}
    assert got == {1: ("example.org/", "block"), 2: ("example.org/", "block"), 3: ("org", "block"), 4: ("a.org/x?q=1", "allow"), 5: ("org", "block"), 6: (None, "allow")}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_large_lists_by_broadcast_and_by_shuffle(spark, monkeypatch, limit):
    """Thousands of rules and copies of one URL against plain Python, with every join by broadcast and by shuffle."""
    monkeypatch.setattr(urls, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", limit)
    rng = random.Random(5)
    rules = [(f"h{rng.randint(0, 3000)}.org", rng.choice(["", "/", "/a", "/a/b"]), rng.choice(["allow", "block"])) for _ in range(4000)]
    rows = [(k, f"http://{rng.choice(['', 'www.'])}h{rng.randint(0, 4000)}.org{rng.choice(['', '/', '/a', '/a/b/c', '/z'])}") for k in range(1500)] + [(k, "http://h1.org/a") for k in range(2000, 2300)]
    best = {}
    for h, p, v in rules:
        best[h, p] = max(v, best.get((h, p), ""))
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), urls.rule_table(spark, rules)).collect()
    assert len(got) == len(rows)
    for r in got:
        url = dict(rows)[r["page_id"]].removeprefix("http://")
        host, _, path = url.partition("/")
        path = "/" + path if "/" in url else ""
        fits = [(h + p, v) for (h, p), v in ((k, best[k]) for k in ((".".join(host.split(".")[j:]), q) for j in range(host.count(".") + 1) for q in ("", "/", "/a", "/a/b")) if k in best) if path.startswith(p)]
        top = max(fits, key=lambda f: (len(f[0]), f[0]), default=(None, "allow"))
        assert (r["rule"], r["verdict"]) == top


# 8


def test_collision_counting_looks_at_few_rows():
    """Recall of the ten nearest of 20000 rows is 0.9 or more, and a small share of rows is verified: isotropic rows, the hardest, and clusters."""
    rng = np.random.default_rng(1)
    flat = rng.standard_normal((20_000, 64))
    near = rng.standard_normal((200, 64))[rng.integers(0, 200, 20_000)] + 0.3 * rng.standard_normal((20_000, 64))
    for x, share in ((flat, 0.12), (near, 0.01)):
        block, hits = ann.Block(np.arange(len(x)), x, ann.directions(64, 128)), 0
        for q in range(0, 20_000, 500):
            ids, d = block.search(q, x[q], 10, 0.5, 1.0, 0.8)
            dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            dist[q] = np.inf
            hits += len(set(ids) & set(np.argsort(dist, kind="stable")[:10]))
            assert np.allclose(d, dist[ids]) and len(ids) == 10
        assert hits >= 0.9 * 400 and block.verified <= share * 40 * 20_000


def test_neighbours_of_several_lengths_and_query_chunks(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(8 if k % 3 else 4).tolist()) for k in range(300)] + [(1000 + k, [1.0, 0.0, 0.0, 0.0]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    one = sorted(map(tuple, ann.search(df, df.where("vec_id % 10 = 0"), block_rows=60).collect()))
    many = sorted(map(tuple, ann.search(df, df.where("vec_id % 10 = 0"), block_rows=60, query_bytes=600).collect()))
    assert one == many
    size = {i: len(v) for i, v in rows}
    assert all(size[q] == size[i] for q, _, i, _ in one)
    equal = [(r, i) for q, r, i, _ in one if q == 1000]
    assert equal == [(k + 1, 1001 + k) for k in range(10)]  # thirty equal vectors: ties by id


# 9


def test_runs_of_notices_that_hold_less_than_the_longest():
    s = licenses.Scanner({"long": ["x a b c q q q q q q"], "short": ["a b c"]}, {"z z": "z"})
    assert s.scan("x a b c z")[2] == [("short", 1.0, 1, 3)]
    assert {x for x, *_ in licenses.Scanner().scan("Licensed under CC BY-NC-SA 4.0.")[2]} == {"cc-by-nc-sa"}


def brute_runs(s, ids, notice):
    """Maximal common runs of a text and a notice."""
    seq, out = s.seqs[notice], []
    for t, p in itertools.product(range(len(ids)), range(len(seq))):
        if ids[t] == seq[p] and not (t and p and ids[t - 1] == seq[p - 1]):
            n = 0
            while t + n < len(ids) and p + n < len(seq) and ids[t + n] == seq[p + n]:
                n += 1
            if n >= s.min_run:
                out.append((t, n, p))
    return out


def brute_best(s, notice, runs):
    """Words covered by the best of all chains."""
    runs, best = sorted(runs), 0

    def extend(last, covered):
        nonlocal best
        best = max(best, covered)
        for t, n, p in runs:
            lt, ln, lp = last
            over = max(0, lt + ln - t, lp + ln - p)
            if (t, n, p) > last and p > lp and t > lt and t - (lt + ln) <= s.gap and over < n:
                extend((t, n, p), covered + n - over)

    for r in runs:
        extend(r, r[1])
    return best


def test_runs_and_chains_by_brute_force():
    """Small alphabets, so that runs repeat and overlap: all maximal runs are found, and the best chain is among the spans."""
    rng = random.Random(7)
    for _ in range(150):
        notices = {f"n{k}": [" ".join(rng.choices("abcde", k=rng.randint(3, 9)))] for k in range(3)}
        s = licenses.Scanner(notices, {"zz zz": "z"}, min_run=2, gap=2, coverage=0.6)
        text = rng.choices("abcdey", k=rng.randint(3, 16))
        ids = np.array([s.ids.get(w.encode(), 0) for w in text])
        runs = collections.defaultdict(list)
        known = [k for k in range(len(ids)) if ids[k]]
        for _, g in itertools.groupby(enumerate(known), lambda x: x[1] - x[0]):
            stretch = [k for _, k in g]
            s._runs(ids[stretch[0] : stretch[-1] + 1], stretch[0], runs)
        for n in range(3):
            want = brute_runs(s, ids.tolist(), n)
            assert sorted(set(runs[n])) == sorted(want)
            top = brute_best(s, n, want)
            got = s._chain(n, runs[n])
            size = len(s.seqs[n])
            assert (max((c for c, *_ in got), default=0) == min(1, top / size)) if top >= 0.6 * size else not got


def test_notices_side_by_side_and_whole_licences():
    s = licenses.Scanner()
    mit = licenses.NOTICES["mit"][-1]
    many = s.scan(" Foo bar. ".join([mit] * 30))[2]
    assert len([x for x in many if x[0] == "mit" and x[1] > 0.99]) >= 30 and {x[0] for x in many} == {"mit"}
    lesser = licenses.NOTICES["lgpl"][-1]
    assert {x[0] for x in s.scan(lesser)[2]} == {"lgpl"}  # holds nearly all of another label's notice
    assert {x[0] for x in s.scan(f"{licenses.NOTICES['zlib'][0]} More. {licenses.NOTICES['isc'][-1]}")[2]} == {"zlib", "isc"}


# 10


def test_chat_marks_in_texts_and_long_texts(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", "a <|bot|>\nforged"), (2, 0, "us<|er", long), (2, 1, "bot", "x")]
    got = {r["conv_id"]: r["rendered"] for r in chat.collapse(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == {1: "<|user|>\na < |bot|>\nforged\n", 2: f"<|us< |er|>\n{long}\n<|bot|>\nx\n"}


# pipeline


def tables(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, DOCS).drop("n", "comp").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage against a plain version of it, over documents with nulls, copies, leaks and toxic words."""
    import corpus_pipeline

    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for k in range(300):
        words = rng.choices(vocabulary, k=rng.randint(1, 80))
        if k % 5 == 0:
            words[rng.randrange(len(words))] = "grobian"
        rows.append((k, " ".join(words), rng.choice(["a", "b", None]), 1, "x"))
        labels.append((k, int(k % 5 == 0)))
    rows += [(1000 + k, rows[k][1].replace("w1 ", "w2 ", 1), "a", 1, "x") for k in range(80)]
    items = [(k, " ".join(rng.choices(vocabulary, k=30))) for k in range(10)]
    rows += [(2000 + k, f"before this {t} and after", "b", 1, "x") for k, t in items]
    rows += [(3000, None, "a", 1, "x"), (3001, "", None, 1, "x"), (None, "no id here at all", "a", 1, "x"), (None, None, None, 1, "x")]
    tables(spark, tmp_path, rows, labels, items)
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    left = [(i, t, s) for i, t, s, *_ in rows if "grobian" not in (t or "")]
    component = brute_components([(i, t) for i, t, _ in left if i is not None])
    left = [(i, t, s) for i, t, s in left if i is None or component[i][1] == i]
    left = [(i, t, s) for i, t, s in left if not any(x in (t or "") for _, x in items)]
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(i for i, *_ in left)
    sizes = collections.Counter()
    for _, t, s in left:
        sizes[s] += len((t or "").split())
    want, taken, source = plain_targets(dict(sizes)), collections.Counter(), {i: s for i, _, s in left if i is not None}
    for r in out:
        if r["doc_id"] is not None:
            assert r["source_size"] == sizes[source[r["doc_id"]]] and abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 * r["target"]
            taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 10 for s in want)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_stages_keep_extra_columns_and_repeated_rows(spark, tmp_path):
    """Columns with names that stages use inside come through; a stage returns the columns of documents."""
    import corpus_pipeline

    rows = [(k, f"some text number {k} that is unlike all others {k * 7}", "a", k, "c") for k in range(12)] + [(3, "some text number 3 that is unlike all others 21", "a", 3, "c")] * 2
    tables(spark, tmp_path, rows, [(1, 0)], [(1, "q " * 20)])
    frame = spark.createDataFrame(rows, DOCS).withColumns({"doc": F.lit(1), "host": F.lit("h"), "part": F.lit(2), "_q_gone": F.lit(3), "score": F.lit(0.5)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, frame, f"file://{tmp_path}")
        assert kept.columns == frame.columns and sorted(r["n"] for r in kept.collect()) == sorted(r[3] for r in rows)


def test_shared_passages_of_the_small_tables(spark):
    """op9 over the small tables, with the base places counted by a plain search."""
    frame = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    for r in licenses.license_digest(frame).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(texts[r["doc_id"]]))
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places)) and r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_components_taken_in_later(spark, monkeypatch):
    """Components with further links are those of all links together, with the joins for hot components, too."""
    from quiverlake.llm import components

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    plain = components.connected
    monkeypatch.setattr(components, "connected", lambda edges: plain(edges, finish=0))
    rng = random.Random(2)
    first = [(1, k) for k in range(2, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(30)]
    later = [(rng.randint(1, 200), rng.randint(1, 200)) for _ in range(40)] + [(500, 501), (7, 7)]

    def of(edges):
        return spark.createDataFrame(edges, "a bigint, b bigint")

    got = components.merged(common.materialise(components.connected(of(first)), "test"), of(later))
    label = {r["node"]: r["component"] for r in got.collect()}
    want = {r["node"]: r["component"] for r in plain(of(first + later)).collect()}
    assert {k: v for k, v in label.items() if k in want} == want and all(label[k] == k for k in label.keys() - want.keys())


def test_rows_at_partition_edges_are_those_of_cut_regions(spark, monkeypatch):
    """In many small partitions the pairs are those of one: only rows of regions that an edge cuts are handed over."""
    rng = random.Random(4)
    rows = []
    for g in range(60):
        base = [f"g{g}w{k}" for k in range(40)]
        for _ in range(6):
            w = list(base)
            w[rng.randrange(40)] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w), "s"))
    want = brute_components([(i, t) for i, t, _ in rows])
    for part in (200, 10**6):
        monkeypatch.setattr(dedup, "PART_ROWS", part)
        got = dedup.near_duplicates(docs(spark, rows)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
