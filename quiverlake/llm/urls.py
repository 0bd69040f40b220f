"""URL filters: a blocked Bloom filter lets possible hits through to an exact hash join.

Rules are (host, path) pairs that fit a host, its subdomains and every path that starts with theirs; single URLs may be
listed besides. Both are listed under canonical keys. A URL has one key for its canonical form, and one for each number
of host labels and each path length that occur together among the rules and that it can have, so the number of probes
follows from the list, however long the URL is. The filter is a table of blocks (four 64-bit words, one bit set in each
by a key); probes whose four bits are all set go on to the exact join, which removes the false positives. DataFrame
operations only.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.common import materialise, small_enough

#: Most rows of the list, or of the places that it hits, that are broadcast; more are joined by shuffle, dealt by SALTS.
BROADCAST_ROWS = 200_000
#: Most blocks of the filter (40 bytes each) that are broadcast, whatever the list's own size.
BROADCAST_BLOCKS = 1_000_000
#: Parts among which the rows of one key are dealt in joins by shuffle.
SALTS = 16
_SEEDS = ("a", "b", "c", "d")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, else the empty string."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def split_urls(df: DataFrame, url_col: str) -> DataFrame:
    """df with host and path."""
    rest = _rest(F.col(f"`{url_col}`").cast("string"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.select("*", host.alias("_q_host"), path.alias("_q_path"))


def canonical(url: Column) -> Column:
    """A URL's canonical form: no scheme, no fragment, host in lower case without its last dot and a default port, `/` for an empty path; null without a host."""
    rest = F.regexp_extract(_rest(url), r"^[^#]*", 0)
    host = F.regexp_replace(F.translate(F.regexp_extract(rest, r"^[^/?]*", 0), _UPPER, _LOWER), r"\.?(?::(?:80|443)?)?$", "")
    tail = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    return F.when(host != "", F.concat(host, F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))))


def _bits(key: str, blocks: int) -> list[Column]:
    k = F.col(key)
    return [F.pmod(F.xxhash64(k, F.lit("block")), F.lit(blocks)).alias("_q_block"), *(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({key}, '{s}'), 64) AS int))").alias(f"_q_{s}") for s in _SEEDS)]


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of a column of keys: one row for each block in use."""
    return keys.select(*_bits(key, blocks)).groupBy("_q_block").agg(*(F.bit_or(f"_q_{s}").alias(f"_f_{s}") for s in _SEEDS))


def may_hold(probes: DataFrame, key: str, filt: DataFrame, blocks: int, broadcast: bool) -> DataFrame:
    """The probes that the filter lets through."""
    hit = F.lit(True)
    for s in _SEEDS:
        hit = hit & (F.col(f"_f_{s}").bitwiseAND(F.col(f"_q_{s}")) == F.col(f"_q_{s}"))
    side = F.broadcast(filt) if broadcast else filt
    return probes.select("*", *_bits(key, blocks)).join(side, "_q_block").where(hit).select(*probes.columns)


def _join(left: DataFrame, right: DataFrame, on: list[str], small: bool, spread: list[str], how: str = "inner") -> DataFrame:
    """left with the rows of right, of which a key has one: by broadcast if small, else dealt over SALTS by a hash of `spread`, so that no key meets in one task."""
    if small:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("_q_salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return left.withColumn("_q_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "_q_salt"], how).drop("_q_salt")


def filter_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", urls: DataFrame | None = None, keys_per_block: int = 12) -> DataFrame:
    """Per row of df: id, host, path, rule (of the longest rule that fits, as host and path together; else null) and verdict.

    rules: host, path, verdict. urls: url, verdict of single URLs, compared by canonical form; they win over rules. The
    longest rule wins (its host and path counted together; equally long ones: by their text); what is listed twice counts
    once, `block` before `allow`. URLs that are null or have no `://` have an empty host
    and path and get the default verdict, as do all if nothing is listed. Rows that repeat each give a row; a null id
    stays null; an empty table gives none. Other columns of df are not read. Equal host and path are looked up once, so a host with a third of the
    rows costs no more than its distinct paths; URLs of any length are taken whole.
    """
    listed = rules.selectExpr(f"translate(host, '{_UPPER}', '{_LOWER}') AS h", "coalesce(path, '') AS p", "verdict AS v").where("h IS NOT NULL AND h <> ''")
    listed = listed.select(F.concat("h", "p").alias("rule"), F.concat_ws("\n", "h", "p").alias("_q_key"), "v", (F.length("h") - F.length(F.replace("h", F.lit("."))) + 1).alias("labels"), F.length("p").alias("n"))
    if urls is not None:
        single = urls.select(canonical(F.col("url").cast("string")).alias("u"), F.col("verdict").alias("v")).where("u IS NOT NULL")
        listed = listed.unionByName(single.select(F.col("u").alias("rule"), F.concat(F.lit("\n"), "u").alias("_q_key"), "v", F.lit(0).alias("labels"), F.length("u").alias("n")))
    listed = listed.groupBy("_q_key").agg(F.max(F.struct("v", "rule", "labels", "n")).alias("x")).select("_q_key", "x.rule", F.col("x.v").alias("r_verdict"), "x.labels", "x.n")
    rows = df.sparkSession.createDataFrame(listed.collect(), listed.schema) if small_enough(listed, 1000) else materialise(listed, "urls-list")
    n_listed = rows.count()
    small = n_listed <= BROADCAST_ROWS
    blocks = max(1, -(-n_listed // keys_per_block))
    shapes = defaultdict(list)  # path lengths by number of labels: bounded by how long listed hosts and paths are, not by how many
    for labels, n in rows.where("labels > 0").select("labels", "n").distinct().collect():
        shapes[labels].append(n)
    shape = F.from_json(F.lit(json.dumps([{"k": k, "n": sorted(n)} for k, n in sorted(shapes.items())])), "array<struct<k:int,n:array<int>>>")
    # what is looked up once: host and path, and the canonical form where single URLs are listed
    pages = split_urls(df.select(F.col(f"`{id_col}`").alias("_q_id"), F.col(f"`{url_col}`").cast("string").alias("_q_url")), "_q_url")
    pages = pages.withColumn("_q_one", F.lit("") if urls is None else F.coalesce(canonical(F.col("_q_url")), F.lit("")))
    place = ["_q_host", "_q_path", "_q_one"]
    places = pages.where("_q_host <> ''").select(*place).distinct()
    probes = (
        places.select(*place, F.explode(F.filter(shape, lambda s: s["k"] <= F.length("_q_host") - F.length(F.replace("_q_host", F.lit("."))) + 1)).alias("s"))
        .select(*place, F.expr("substring_index(_q_host, '.', -s.k)").alias("_q_suffix"), F.explode(F.filter("s.n", lambda n: n <= F.length("_q_path"))).alias("_q_n"))
        .select(*place, F.expr("concat_ws('\n', _q_suffix, substring(_q_path, 1, _q_n))").alias("_q_key"))
    )
    if urls is not None:
        probes = probes.unionByName(places.where("_q_one <> ''").withColumn("_q_key", F.concat(F.lit("\n"), "_q_one")))
    passed = may_hold(probes, "_q_key", bloom(rows, "_q_key", blocks), blocks, blocks <= BROADCAST_BLOCKS)
    hits = _join(passed, rows, ["_q_key"], small, place)
    best = hits.groupBy(*place).agg(F.max(F.struct((F.col("labels") == 0).alias("single"), F.length("rule").alias("n"), "rule", "r_verdict")).alias("_q_best"))
    best = materialise(best, "urls-places")
    known = _join(pages.where("_q_host <> ''"), best, place, small_enough(best, BROADCAST_ROWS), ["_q_id", "_q_url"], "left")
    known = known.unionByName(pages.where("_q_host = ''"), allowMissingColumns=True)
    return known.select(F.col("_q_id").alias(id_col), F.col("_q_host").alias("host"), F.col("_q_path").alias("path"), F.col("_q_best.rule").alias("rule"), F.coalesce("_q_best.r_verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")
