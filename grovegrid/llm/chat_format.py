"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Loggers write a conversation anew after each turn, so a log holds prefixes of longer conversations.
Each turn has two 64-bit hashes of its position, role and text, and a turn's prefix hash is the running
XOR of those up to it: 128 bits that stand for the turns so far. Conversations with equal prefix hashes
over all their turns are copies, of which the lowest conv_id stays; an anti-join with the proper prefixes
of all conversations then leaves the maximal ones. Texts are shuffled for those alone, and rendered.

Turns are taken in the order of turn (nulls first), role and text hash. Null roles and texts are empty.
Rows without a conv_id belong to no conversation and give none. Rows that repeat are turns of their own.
Other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _turns(log: DataFrame) -> DataFrame:
    rows = log.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.withColumns({"t1": F.xxhash64(F.lit(1), "text"), "t2": F.xxhash64(F.lit(2), "text")})


def maximal_conversations(log: DataFrame) -> DataFrame:
    """log(conv_id, turn, role, text) -> conv_id, n_turns, n_copies of the conversations that prefix no longer one."""
    turns = _turns(log).select("conv_id", "turn", "role", "t1", "t2")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "t1", "t2")
    placed = turns.withColumns({"pos": F.row_number().over(order), "n": F.count(F.lit(1)).over(W.partitionBy("conv_id"))})
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    chain = placed.select("conv_id", "pos", "n", *(F.bit_xor(F.xxhash64(F.lit(s), "pos", "role", f"t{s}")).over(so_far).alias(f"h{s}") for s in (1, 2)))
    whole = chain.where("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = chain.where("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def render(log: DataFrame, keep: DataFrame, system: str = "") -> DataFrame:
    """The conversations of keep(conv_id, ...) with all their turns as one text: <|role|>, the text, <|end|>, by lines.

    A conversation without a system turn at its start gets the default one, if that is not empty.
    """
    rows = _turns(log).select("conv_id", F.struct("turn", "role", "t1", "t2", "text").alias("x"))
    kept = rows.join(keep.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    line = F.transform("xs", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n<|end|>\n")))
    text = F.array_join(line, "")
    if system:
        text = F.concat(F.when(F.col("xs")[0]["role"] == "system", "").otherwise(f"<|system|>\n{system}\n<|end|>\n"), text)
    return keep.join(kept.select("conv_id", text.alias("text")), "conv_id")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return render(log, maximal_conversations(log)).select("conv_id", "n_turns", "n_copies", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("text_chars"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) ORDER BY turn, role, text) AS xs, count(*) AS n FROM t GROUP BY conv_id),
g AS (SELECT xs, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY xs, n),
p AS (SELECT DISTINCT xs[1:i] AS xs FROM (SELECT xs, unnest(generate_series(1, n - 1)) AS i FROM g WHERE n > 1))
SELECT conv_id, n AS n_turns, n_copies, md5(array_to_string(xs, '')) AS text_md5, length(array_to_string(xs, ''))::BIGINT AS text_chars
FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.xs = g.xs)
"""
