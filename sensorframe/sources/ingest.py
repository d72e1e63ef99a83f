"""Instrument text files and JSON documents to tables, with issues and quarantined files beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Tokens that mean a missing cell, time headers, unit suffixes that may be split off a channel's name.
MISSING = ["", "na", "n/a", "nan", "null", "missing"]
TIME = ["time", "timestamp"]
UNITS = ["V", "mV", "uV", "A", "mA", "uA", "C", "K", "S/m", "mS/cm", "s", "sec", "min", "h", "hz", "ohm", "deg"]
TEXT_KINDS = {"csv": "table", "txt": "table", "dat": "table", "json": "document", "xlsx": "sheet", "xls": "sheet"}


def header_parts(header: Column) -> Column:
    """(name, unit) of a column header: the unit after a slash or in brackets is split off only if it is a known one."""
    h = F.trim(header)
    slash, bracket = F.regexp_extract(h, r"^(.*)/([^/]+)$", 2), F.regexp_extract(h, r"^(.*?)\s*\(([^()]+)\)$", 2)
    known = [u.lower() for u in UNITS]
    return F.struct(
        F.when(F.lower(F.trim(slash)).isin(known), F.trim(F.regexp_extract(h, r"^(.*)/([^/]+)$", 1))).when(F.lower(F.trim(bracket)).isin(known), F.trim(F.regexp_extract(h, r"^(.*?)\s*\(([^()]+)\)$", 1))).otherwise(h).alias("name"),
        F.when(F.lower(F.trim(slash)).isin(known), F.trim(slash)).when(F.lower(F.trim(bracket)).isin(known), F.trim(bracket)).alias("unit"),
    )


def number(token: Column) -> Column:
    """A finite number, or null."""
    v = token.try_cast("double")
    return F.when(~F.lower(F.trim(token)).isin(MISSING) & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


#: Ends a log in a bundle: ASCII's record separator.
END = "\x1e"


def bundle_logs(logs: DataFrame, path: str) -> None:
    """Writes logs (file, value) one after another into large files, as many as ``logs`` has partitions: each a line with its name, its text
    and ``END`` (which is dropped from texts, where it has no meaning). A folder of hundreds of thousands of small files costs a directory entry, a rename and an open each; a bundle costs none."""
    logs.select(F.concat_ws("\n", "file", F.translate("value", END, ""))).write.option("lineSep", END).text(path)


def read_logs(spark: SparkSession, path: str, name: str = "file_name", bundled: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delimited logs of a folder as (readings, issues, failed). ``name`` says what tells files apart: file_name, or file_path where
    folders hold files of one name. ``bundled`` reads what :func:`bundle_logs` wrote, whose logs carry their names; Spark splits bundles.

    The preamble ends at the first line of two or more fields one of which is a time header; other columns are channels. Lines
    keep their numbers in the file. A bad time skips the row, a bad value is null; both, and rows of another width, are issues.
    Files without a time header are in ``failed``. Files are read in parallel, a log in one row.
    """
    if bundled:
        text = spark.read.option("lineSep", END).text(path).select(F.substring_index("value", "\n", 1).alias("file"), F.regexp_replace("value", r"^[^\n]*\n?", "").alias("value"))
    else:
        text = spark.read.text(path, wholetext=True).select(F.col(f"_metadata.{name}").alias("file"), F.col("value"))
    lines = text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("row", "line")).where(F.trim("line") != "")
    lines = lines.withColumn("cells", F.transform(F.split("line", r"\s*[,;\t]\s*"), lambda c: F.trim(c)))
    name = F.transform("cells", lambda c: F.lower(header_parts(c)["name"]))
    head = lines.where((F.size("cells") >= 2) & F.arrays_overlap(name, F.array(*map(F.lit, TIME)))).groupBy("file").agg(F.min_by(F.struct("row", "cells"), "row").alias("h"))
    at = F.array_position(F.transform("h.cells", lambda c: F.lower(header_parts(c)["name"]).isin(TIME)), True)
    head = head.select("file", F.col("h.row").alias("head_row"), F.col("h.cells").alias("names"), at.cast("int").alias("time_at"))
    rows = lines.join(head, "file").where("row > head_row").withColumn("t_s", number(F.get("cells", F.col("time_at") - 1)))
    bad = rows.select(
        "file", "row", F.explode(F.array_compact(F.array(F.when(F.col("t_s").isNull(), F.lit("bad_time")), F.when(F.size("cells") != F.size("names"), F.lit("ragged_row"))))).alias("code")
    )
    cells = rows.where("t_s IS NOT NULL").select("file", "row", "t_s", "time_at", F.posexplode("names").alias("i", "header"), "cells").where("i <> time_at - 1")
    cells = cells.withColumns({"token": F.coalesce(F.get("cells", F.col("i")), F.lit("")), "_p": header_parts(F.col("header"))}).withColumn("value", number(F.col("token")))
    readings = cells.select("file", F.col("_p.name").alias("channel"), F.col("row").cast("long").alias("row_idx"), "t_s", "value", F.col("_p.unit").alias("unit"))
    odd = cells.where(F.col("value").isNull() & ~F.lower("token").isin(MISSING)).select("file", "row", F.lit("bad_value").alias("code"))
    failed = text.select("file").join(head.select("file"), "file", "left_anti")
    return readings, bad.unionByName(odd), failed


def classify(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind): by extension; a NUL byte in the first 8 KiB makes a text kind binary."""
    f = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit("unknown")
    for e, k in TEXT_KINDS.items():
        kind = F.when(ext == e, k).otherwise(kind)
    # two hexadecimal digits stand for a byte, so a NUL is 00 at an even place
    true_nul = F.hex(F.substring("content", 1, 8192)).rlike("^(..)*?00")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.when(kind.isin("table", "document") & true_nul, "binary").otherwise(kind).alias("kind"))


def read_documents(spark: SparkSession, path: str, kind: str, schema: str, versions: list[int]) -> tuple[DataFrame, DataFrame]:
    """JSON documents, one per line, as (good, quarantined with a reason): the kind and version must fit and numbers be finite.

    ``schema`` describes the payload; earlier versions in ``versions`` are accepted as they are.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    d = raw.withColumn("d", F.from_json("value", f"kind string, schema_version int, payload struct<{schema}>, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    reason = (
        F.when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), "malformed").when(F.col("d.kind").isNull() | (F.col("d.kind") != kind), "kind")
        .when(F.col("d.schema_version").isNull() | ~F.col("d.schema_version").isin(versions), "version").when(F.col("value").rlike(r"(?i):\s*\"?-?(nan|inf(inity)?)\b"), "not_finite")
    )
    d = d.withColumn("reason", reason)
    return d.where("reason IS NULL").select("file", "d.schema_version", "d.payload.*"), d.where("reason IS NOT NULL").select("file", "value", "reason")


def read_truth(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A headed CSV whose columns may have any of several names, in any case."""
    df = spark.read.option("header", True).csv(path)
    found = {c.strip().lower(): c for c in df.columns}
    picked = {}
    for name, others in aliases.items():
        hits = [found[o.lower()] for o in [name, *others] if o.lower() in found]
        if not hits:
            raise ValueError(f"no column for {name}: {df.columns}")
        picked[name] = hits[0]
    return df.select(*(F.col(f"`{c}`").try_cast("double").alias(n) for n, c in picked.items()))


def run_manifest(manifest: DataFrame, readings: DataFrame, record: str = "record", file: str = "file") -> tuple[DataFrame, DataFrame]:
    """Readings of the manifest's records, and the records some of whose files are missing with those files: one job for all."""
    have = readings.select(file).distinct()
    gone = manifest.join(have, file, "left_anti").groupBy(record).agg(F.array_sort(F.collect_list(file)).alias("missing"))
    return readings.join(manifest, file).join(gone.select(record), record, "left_anti"), gone


def write_results(df: DataFrame, path: str, by: list[str], fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """A result table partitioned by its keys, one file per key and task at most."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).format(fmt).option("header", True).save(path)


def history(entries: DataFrame, prior: DataFrame, key: list[str], order: str = "at", entry_id: str = "history_id") -> DataFrame:
    """New history entries (known ids skipped) with their index after the prior ones and the level before each."""
    new = entries.join(prior.select(entry_id), entry_id, "left_anti").dropDuplicates([entry_id])
    last = prior.groupBy(key).agg(F.count("*").alias("_n"), F.max_by("level", order).alias("_level"))
    w = W.partitionBy(key).orderBy(order, entry_id)
    new = new.join(last, key, "left").withColumn("index", (F.coalesce("_n", F.lit(0)) + F.row_number().over(w)).cast("long"))
    return new.withColumn("prior_level", F.coalesce(F.lag("level").over(w), F.col("_level"))).drop("_n", "_level")
