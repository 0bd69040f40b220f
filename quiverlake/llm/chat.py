"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation once for every turn it had so far. Each turn is hashed with its place, and the
running XOR of these hashes (two independent 64-bit ones) is the hash of the prefix that ends there. A conversation
whose whole hash is the prefix hash of a longer one goes, by an anti-join; of equal conversations the one with the
smallest id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def collapse(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: id, n_turns, n_copies (equal conversations, itself included) and rendered.

    Turns stand in the order of their number (null first), then of role and text; rows that repeat within a conversation
    count once. Null roles and texts are turns like others and differ from empty ones, but render as empty. Rows without
    an id belong to no conversation and are left out; a table without conversations gives none; other columns are not
    read. Rendering: each turn as `<|role|>`, a line break, its text and a line break; in roles and texts `<|` becomes
    `< |`, so that no text can pass for a turn.
    """
    turns = df.select(*(F.col(f"`{c}`").alias(n) for c, n in ((id_col, "c"), (turn_col, "t"), (role_col, "r"), (text_col, "x")))).where("c IS NOT NULL")
    turns = turns.repartition("c").distinct()  # dealt by conversation once: all that follows on turns stays there
    w = W.partitionBy("c").orderBy(F.col("t").asc_nulls_first(), F.col("r").asc_nulls_first(), F.col("x").asc_nulls_first())
    placed = turns.withColumn("n", F.row_number().over(w))
    mark = [F.col("n"), F.col("r").isNull(), F.coalesce("r", F.lit("")), F.col("x").isNull(), F.coalesce("x", F.lit(""))]
    rolled = placed.select("c", "n", F.xxhash64(F.lit(17), *mark).alias("a"), F.xxhash64(F.lit(71), *mark[::-1]).alias("b"), "r", "x").select("c", "n", "r", "x", *(F.expr(f"bit_xor({k}) OVER (PARTITION BY c ORDER BY n ROWS UNBOUNDED PRECEDING)").alias(k) for k in "ab"))
    whole = rolled.groupBy("c").agg(F.max(F.struct("n", "a", "b")).alias("h")).select("c", "h.n", "h.a", "h.b")
    # a prefix hash with its length; it ends inside a longer conversation unless it is the whole of each that has it
    prefixes = rolled.groupBy("n", "a", "b").agg(F.count(F.lit(1)).alias("holders"))
    wholes = whole.groupBy("n", "a", "b").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_copies"))
    longer = prefixes.alias("p").join(wholes.alias("w"), ["n", "a", "b"]).where("p.holders > w.n_copies").select("n", "a", "b")
    kept = wholes.join(longer, ["n", "a", "b"], "left_anti").select("c", "n_copies")
    plain = [F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |")) for c in "rx"]
    text = F.concat(F.lit("<|"), plain[0], F.lit("|>\n"), plain[1], F.lit("\n"))
    rendered = (
        placed.select("c", "n", text.alias("s")).join(kept, "c").groupBy("c").agg(F.max("n").cast("long").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda t: t["s"]), "").alias("rendered"))
    )
    return rendered.withColumnRenamed("c", id_col)
