"""Chat formatting with typed content parts: a visitor over the parts, ordered placeholders, attachments, loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.llm._common import table

#: The control strings of the template.
START, SAYS, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Tokens that one unit of an attachment expands to: an image unit is a tile, an audio unit a second, a document unit a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    """Breaks up every control string, of this template or a known other one, by a backslash after its first character."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(<(?=\||/?s>)|\[(?=/?INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`: what follows a backslash stands for itself."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def placeholder(part: Column) -> Column:
    return F.concat(F.lit("<|"), part["type"], F.lit("|>"))


def visit(part: Column) -> Column:
    """One part's formatted text: escaped text as it is, an attachment as its placeholder, an unknown type as nothing."""
    return (
        F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
        .when(part["type"].isin(*TOKENS_PER_UNIT), placeholder(part))
        .otherwise(F.lit(""))
    )


def expanded(part: Column) -> Column:
    """Tokens that a placeholder stands for; null units count as one."""
    each = F.lit(0)
    for kind, n in TOKENS_PER_UNIT.items():
        each = F.when(part["type"] == kind, n).otherwise(each)
    return each.cast("long") * F.coalesce(part["units"], F.lit(1))


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: its template text, the loss mask and the attachments.

    ``content`` is an array of parts (type, text, ref, units). Returns ``conv_id``; ``formatted``; ``loss`` (array of start,
    length in code points and first_byte, n_bytes in UTF-8, each covering the text of one turn of ``learn_roles``);
    ``attachments`` (array of turn number from 0, type, ref, tokens, in order of their placeholders); ``attachment_tokens``.

    Turns are ordered by ``turn``, then role and text, so ties and repeated rows have a fixed order; null turns come first. A
    null role or content is empty; rows with a null conversation id form one conversation; other columns are not read; an
    empty table gives an empty result. Offsets are running sums over the conversation, whose rows meet in one shuffle: a
    conversation is one output cell, so its rows have to fit a task.
    """
    parts = F.coalesce(F.col(content), F.array().cast(f"array<{PART}>"))
    kinds = list(TOKENS_PER_UNIT)
    each = turns.select(
        F.col(conv_id).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.array_join(F.transform(parts, visit), "").alias("_body"),
        F.transform(F.filter(parts, lambda p: p["type"].isin(*kinds)), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens"))).alias("_files"),
    )
    each = each.withColumn("_head", F.concat(F.lit(START), escape(F.col("_role")), F.lit(SAYS)))
    each = each.withColumn("_whole", F.concat("_head", "_body", F.lit(END)))
    order = W.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_body")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    each = each.select(
        "_conv", "_whole", "_files", (F.row_number().over(order) - 1).cast("long").alias("_no"),
        F.when(F.col("_role").isin(*learn_roles), F.struct(
            (F.coalesce(F.sum(F.char_length("_whole")).over(before), none) + F.char_length("_head")).alias("start"),
            F.char_length("_body").cast("long").alias("length"),
            (F.coalesce(F.sum(F.octet_length("_whole")).over(before), none) + F.octet_length("_head")).alias("first_byte"),
            F.octet_length("_body").cast("long").alias("n_bytes"),
        )).alias("_loss"),
    )
    whole = each.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("_no", "_whole", "_loss", "_files"))).alias("_turns"))
    files = F.flatten(F.transform("_turns", lambda t: F.transform(t["_files"], lambda f: F.struct(t["_no"].alias("turn"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    return whole.select(
        F.col("_conv").alias(conv_id),
        F.array_join(F.transform("_turns", lambda t: t["_whole"]), "").alias("formatted"),
        F.filter(F.transform("_turns", lambda t: t["_loss"]), lambda x: x.isNotNull()).alias("loss"),
        files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: an array of (role, text). Placeholders stay in the text."""
    whole = F.split(formatted, r"<\|im_end\|>")
    whole = F.slice(whole, 1, F.size(whole) - 1)
    split = F.transform(whole, lambda t: F.split(F.substr(t, F.lit(len(START) + 1)), r"<\|im_sep\|>", 2))
    return F.transform(split, lambda t: F.struct(unescape(t[0]).alias("role"), unescape(t[1]).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, read back by their byte ranges."""
    raw = F.encode(formatted, "UTF-8")
    return F.transform(loss, lambda s: unescape(F.decode(F.substring(raw, s["first_byte"].cast("int") + 1, s["n_bytes"].cast("int")), "UTF-8")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    out = format_chats(turns.unionByName(added).withColumn("content", text_part(F.col("text"))))
    said = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss")), "").alias("learned"), "attachment_tokens")
    return said.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op3_chat_format": op3_chat_format}
ORACLES = {
    "op3_chat_format": """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(role) + length(text) + 12 + 10 + 10
    + length(text) - length(replace(text, chr(92), ''))
    + (length(text) - length(replace(text, '<|', ''))) // 2
    + (length(text) - length(replace(text, '<s>', ''))) // 3
    + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[INST]', ''))) // 6
    + (length(text) - length(replace(text, '[/INST]', ''))) // 7 AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""
}
