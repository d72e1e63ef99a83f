"""Line deduplication across documents: explode normalised lines, hash, count documents per hash, drop, reassemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm._common import BLANKS, ascii_lower, hash128, join_counted, set_aside, table, written


def line_key(line: Column) -> Column:
    """What makes two lines the same: white space at both ends stripped, A-Z lower-cased."""
    return F.btrim(ascii_lower(line), F.lit(BLANKS))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drops lines whose key occurs in at least ``min_docs`` documents, except in the smallest ``doc_id`` that holds it.

    Returns the input columns with ``text`` replaced, plus ``n_lines`` (before) and ``n_dropped``; input columns of these two
    names are replaced. A null or empty text is one empty line. Keys under ``min_chars`` code points always stay. Rows with a
    null id are left as they are and count for no line. Repeated rows with one id count as one document and get equal results.
    An empty table gives an empty result.

    Only (id, hash, position) rows are shuffled to count; hot lines are salted; the texts move once, to meet their dropped positions.
    """
    docs, back = set_aside(docs, *{"_id", "_text", "_pos", "_line", "_key", "_gone", "_lines"} - {doc_id, text})
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    each = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_text"), F.posexplode(lines).alias("_pos", "_line")
    )
    each = each.select("_id", "_text", "_pos", line_key(F.col("_line")).alias("_key")).where(F.char_length("_key") >= min_chars)
    each = each.select("_id", "_text", "_pos", *(h.alias(f"_h{i}") for i, h in enumerate(hash128(F.col("_key")))))
    keys = ["_h0", "_h1"]
    if min_docs == 2:  # two ids differ exactly when the smallest and the largest do: one shuffle of partial results
        counts = each.groupBy(keys).agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.count("*").alias("_n"))
        counts = counts.where(F.col("_first") != F.col("_last")).drop("_last")
    else:
        counts = each.groupBy(*keys, "_id").agg(F.count("*").alias("_n")).groupBy(keys)
        counts = counts.agg(F.min("_id").alias("_first"), F.count("*").alias("_docs"), F.sum("_n").alias("_n"))
        counts = counts.where(F.col("_docs") >= min_docs).drop("_docs")
    repeated = written(counts, "repeated-lines")
    gone = join_counted(each, repeated, keys, "_n", F.xxhash64("_id")).where(F.col("_id") != F.col("_first"))
    gone = gone.groupBy("_id", "_text").agg(F.collect_set("_pos").alias("_gone"))

    kept = docs.withColumns({"_id": F.col(doc_id), "_text": F.xxhash64(text)}).join(gone, ["_id", "_text"], "left")
    kept = kept.withColumn("_lines", lines).withColumn("n_lines", F.size("_lines").cast("long"))
    kept = kept.withColumn("n_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = kept.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stays, lambda i: F.get(F.col("_lines"), i)), "\n")))
    return back(kept.drop("_id", "_text", "_gone", "_lines"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {
    "op7_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM lines),
counted AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT keyed.doc_id, pos, line, coalesce(first_id <> keyed.doc_id, false) AS gone
  FROM keyed LEFT JOIN counted USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
}
