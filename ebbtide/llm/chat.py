"""Chat formatting by prefix-target expansion: one example per assistant turn, all turns before it as context, only the reply trainable.

Template: every turn is ``<s>`` marker text ``</s>``. A user's text stands in ``[INST] [/INST]``, a system text in ``[SYS] [/SYS]``, an
assistant's bare, and any other role is named in ``[ROLE] [/ROLE]`` before the text. A control string inside a role or text gets one
backslash after its bracket, an escaped one gets one more, so that taking one away restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TAIL = r"(\\*/?(?:INST\]|SYS\]|ROLE\]|s>))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])" + _TAIL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\" + _TAIL, r"$1$2")


def _head(role: Column) -> Column:
    return (F.when(role == "assistant", F.lit("<s>")).when(role == "user", F.lit("<s>[INST]")).when(role == "system", F.lit("<s>[SYS]"))
            .otherwise(F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]"))))


def _foot(role: Column) -> Column:
    return F.when(role == "user", F.lit("[/INST]</s>")).when(role == "system", F.lit("[/SYS]</s>")).otherwise(F.lit("</s>"))


def expand(turns: DataFrame) -> DataFrame:
    """Examples of conversations given as rows (conv_id, turn, role, text), ordered by turn, then role and text.

    Returns conv_id, example (from 0), n_turns, text, loss_start and loss_chars (code points of text; 0 chars: nothing trainable).
    Turns after the last reply would be lost: they come, with all before them, as one more example without a trainable part, as does a
    conversation without a reply. Null role and text count as empty. Rows without conv_id belong to no known conversation and
    are each their own. Repeated rows are turns of their own. Other columns are not read. Conversations are gathered one by one,
    formatted once, and examples are cut out of that text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct("turn", role.alias("role"), text.alias("text"))
    whole = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    lone = turns.where("conv_id IS NULL").select("conv_id", F.array(one).alias("turns"))
    parts = whole.unionByName(lone).select("conv_id", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), _head(t["role"]).alias("head"), escape(t["text"]).alias("body"), _foot(t["role"]).alias("foot"))).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<n:int,start:int,chars:int,upto:int>>").alias("cuts"))

    def step(acc: Column, p: Column) -> Column:
        body = acc["at"] + F.length(p["head"])
        upto = body + F.length(p["body"]) + F.length(p["foot"])
        reply = p["role"] == "assistant"
        return F.struct(upto.alias("at"), F.concat(acc["cuts"], F.array(F.struct(
            (F.size(acc["cuts"]) + 1).alias("n"), body.alias("start"), F.when(reply, F.length(p["body"])).otherwise(-1).alias("chars"), upto.alias("upto")))).alias("cuts"))

    cut = (parts.select("conv_id", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], p["foot"])), "").alias("all"),
                        F.aggregate("parts", start, step)["cuts"].alias("cuts"))
           .select("conv_id", "all", F.filter("cuts", lambda c: (c["chars"] >= 0) | (c["n"] == F.size("cuts"))).alias("cuts"))
           .select("conv_id", "all", F.posexplode("cuts").alias("example", "cut")))
    return cut.select("conv_id", "example", F.col("cut.n").alias("n_turns"), F.expr("substring(all, 1, cut.upto)").alias("text"),
                      F.col("cut.start").alias("loss_start"), F.greatest(F.col("cut.chars"), F.lit(0)).alias("loss_chars"))


def read_back(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    pieces = F.filter(F.split(text, "</s>", -1), lambda x: x != "")

    def turn(p: Column) -> Column:
        inner = F.substring(p, 4, 2_147_483_647)
        kind = F.regexp_extract(inner, r"^\[(INST|SYS|ROLE)\]", 1)
        other = F.regexp_extract(inner, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)
        body = (F.when(kind == "", inner).when(kind == "ROLE", F.regexp_replace(inner, r"(?s)^\[ROLE\].*?\[/ROLE\]", ""))
                .otherwise(F.regexp_replace(inner, r"(?s)^\[(?:INST|SYS)\]|\[/(?:INST|SYS)\]$", "")))
        role = F.when(kind == "", "assistant").when(kind == "INST", "user").when(kind == "SYS", "system").otherwise(unescape(other))
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted texts and loss spans alone."""
    loss = F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_chars"))
    each = examples.select("conv_id", "example", "n_turns", F.length("text").alias("chars"), "text", unescape(loss).alias("loss"))
    known = each.where("conv_id IS NOT NULL").groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"))
    lone = each.where("conv_id IS NULL").select("conv_id", "text", F.array(F.struct("example", "loss")).alias("losses"), F.col("chars").cast("long").alias("formatted_chars"))
    both = known.unionByName(lone).select("conv_id", read_back(F.col("text")).alias("turns"), F.array_join(F.col("losses.loss"), "").alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return both.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       F.col("formatted_chars").cast("long").alias("formatted_chars"))


def op3_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(expand(turns.unionByName(added)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS m,
         length(regexp_replace(text, '([\[<])(\\*/?(?:INST\]|SYS\]|ROLE\]|s>))', '\1\\\2', 'g')) + 3 + 4
         + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 0
           ELSE 13 + length(regexp_replace(role, '([\[<])(\\*/?(?:INST\]|SYS\]|ROLE\]|s>))', '\1\\\2', 'g')) END AS chars
  FROM t),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR n = m THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
