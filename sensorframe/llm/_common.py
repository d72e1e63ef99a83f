"""Helpers shared by the text operators: shared storage, text keys and skew-safe joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.sources.storage import PLAIN_READS, fresh_path, shared_dir, told, written  # noqa: F401

#: The six white-space characters that end words and surround lines.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A join key is hot when it holds over 1/HOT of the joined rows, or over 1/(rows / HOT_ROWS) where these are so many that 1/HOT of
#: them is too much for a task. There are at most as many hot keys, MOST_HOT at the utmost, which bounds their broadcast.
HOT, HOT_ROWS, MOST_HOT = 1000, 1_000_000, 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.options(**PLAIN_READS).parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Plain ASCII takes the fast built-in; other texts keep letters such as É as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def hash128(*cols: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes, used together as a key."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with a caller's columns of these names renamed, so that an operator can use the names, and what renames them back."""
    moved = {c: c + "_of_caller" for c in df.columns if c in names}
    while set(moved.values()) & set(df.columns):
        moved = {c: m + "_" for c, m in moved.items()}
    return df.withColumnsRenamed(moved), lambda out: out.withColumnsRenamed({m: c for c, m in moved.items()})


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, spread: Column, total: int | None = None) -> DataFrame:
    """Inner join of ``left`` with the table ``right`` whose hot keys are salted.

    ``right`` (a written table) tells in ``count`` how many rows of ``left`` have the key; it is small beside them. A hot key gets a
    salt for each share of rows that makes a key hot, so it is dealt over about as many tasks as other keys with as many rows;
    ``spread`` deals its rows. ``total`` is the sum of ``count`` where it is known.
    """
    left, back = set_aside(left, "_salt", "_salts")
    total = right.agg(F.sum(count)).first()[0] or 0 if total is None else total
    share = max(1, total // min(MOST_HOT, max(HOT, total // HOT_ROWS)))
    salts = F.ceil(F.col(count) / share).cast("int")
    hot = right.where(F.col(count) > share).select(*keys, salts.alias("_salts")).distinct()
    left = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(spread, F.col("_salts")).cast("int")))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > share, salts).otherwise(1) - 1)))
    return back(left.drop("_salts").join(right, [*keys, "_salt"]).drop("_salt"))


#: A bitmap of 2^MAP_BITS bits, by which tasks drop what a later join would drop; the size is fixed, whatever the input. Each hash
#: sets two bits, its highest MAP_BITS bits and the next as many.
MAP_BITS = 25
_SHIFTS = (64 - MAP_BITS, 64 - 2 * MAP_BITS)


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the hashes (bigint) in a column, put together by Spark: at most 2^MAP_BITS / 64 words come to the driver."""
    slots = F.array(*(F.shiftrightunsigned(column, n).bitwiseAND(F.lit((1 << MAP_BITS) - 1)) for n in _SHIFTS))
    slot = F.col("slot")
    words = hashes.select(F.explode(slots).alias("slot"))
    words = words.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each unsigned hash may be one of the bitmap's."""
    found = np.ones(len(hashes), bool)
    for n in _SHIFTS:
        at = ((hashes >> np.uint64(n)) & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
        found &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
    return found


#: Bytes of rows that go to a Python worker at a time, instead of Spark's 64 MB.
BATCH_BYTES = 1 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on an Arrow batch from Spark's default to ``BATCH_BYTES``: long texts would else take hundreds of
    MB of an executor outside its heap. A limit that the session has set itself stays."""
    if spark.conf.get(_BATCH_CONF) == f"{64 << 20}b":
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


#: Bytes of text that a task turns into Python and numpy values at a time.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``PIECE_BYTES`` in column ``text`` (string or binary), one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32)
        ends = ends[column.offset : column.offset + batch.num_rows + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            after = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE_BYTES, "right")) - 1)
            yield batch.slice(at, after - at)
            at = after
