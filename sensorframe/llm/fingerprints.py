"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits, bias correction.

Everything is DataFrame functions: the shingle hashes of a document are an array, no row is exploded and nothing is shuffled
to fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.llm._common import set_aside, table

WORDS = 5
BINS = 256  # a power of two; the top bits of a hash name its bin
BITS = 4  # low-order bits kept of each bin's smallest hash
PROBES = 12
_LOW = (1 << 56) - 1  # the bits below the bin's
_PER_LONG = 64 // BITS
_ONES = int("1" * 16, 16)


def _shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the hashes of all shingles of ``WORDS`` words, the whole sequence where there are fewer, none without words."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("_words", F.transform(words, lambda x: F.xxhash64(x)))
    w = F.col("_words")
    each = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WORDS - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WORDS))).bitwiseOR(F.lit(1)))
    short = F.array(F.xxhash64(w).bitwiseOR(F.lit(1)))
    return df.withColumn(out, F.when(F.size(w) >= WORDS, each).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))).drop("_words")


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the packed fingerprint, an array of longs; empty for a text without words.

    One pass bins the hashes: sorted together with one mark per bin (the bin's smallest number, which no odd hash equals), the
    element after each mark is the bin's smallest hash, or the next mark where the bin is empty. An empty bin takes the value
    of the first filled one in its own order of all bins: a few hashed probes, then the rest by smallest hash of (bin, other);
    it is hashed with the bin, so that one value lent to many bins does not agree with another by chance in all of them.

    A null text is as an empty one. A text of any length is one array of hashes. Repeated rows each keep theirs; an empty table
    stays empty; other columns are kept as they are, whatever their names, but for one named ``out``, which is replaced.
    """
    df, back = set_aside(df, *{"_words", "_hashes", "_sorted", "_bins", "_full", "_low"} - {text, out})
    df = _shingles(df, text, "_hashes")
    marks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("bigint"), 56))
    df = df.withColumn("_sorted", F.sort_array(F.concat("_hashes", marks, F.array(F.lit((1 << 63) - 1)))))
    first = F.filter("_sorted", lambda x, i: (i > 0) & (F.get(F.col("_sorted"), i - 1).bitwiseAND(F.lit(_LOW)) == 0))
    df = df.withColumn("_bins", F.when(F.size("_hashes") > 0, F.transform(first, lambda x: F.when((x.bitwiseAND(F.lit(_LOW)) != 0) & (x != (1 << 63) - 1), x))))
    full = F.filter(F.transform("_bins", lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    df = df.withColumn("_full", full)

    def filled(x: Column, b: Column) -> Column:
        probes = [F.get(F.col("_bins"), F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        rest = F.array_min(F.transform("_full", lambda j: F.struct(F.xxhash64(j, b), F.get(F.col("_bins"), j).alias("v"))))["v"]
        return F.coalesce(x, F.xxhash64(F.coalesce(*probes, rest), b))

    df = df.withColumn("_low", F.transform("_bins", lambda x, b: F.shiftright(filled(x, b), 1).bitwiseAND(F.lit((1 << BITS) - 1))))
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)),
        lambda n: F.aggregate(F.slice(F.col("_low"), n * _PER_LONG + 1, F.lit(_PER_LONG)), F.lit(0).cast("bigint"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v)),
    )
    df = df.withColumn(out, F.when(F.col("_low").isNull(), F.array().cast("array<bigint>")).otherwise(packed))
    return back(df.drop("_hashes", "_sorted", "_bins", "_full", "_low"))


def as_text(packed: Column) -> Column:
    """A packed fingerprint as hexadecimal digits, one per bin."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1.

    Unlike bins agree in their kept bits by chance once in 2^BITS; that share is taken out. Two texts without words are alike
    (1), one without words is unlike any other (0).
    """

    def apart(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        some = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return F.bit_count(some.bitwiseAND(F.lit(_ONES)))

    agree = 1 - F.aggregate(F.zip_with(a, b, apart), F.lit(0), lambda s, n: s + n) / F.lit(BINS)
    chance = 1.0 / (1 << BITS)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), (agree - chance) / (1 - chance)))


def with_next(df: DataFrame, order: str, tie: str, carry: list[str], derive: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Adds columns by ``derive``, and ``next_<c>`` for each carried column: the value of the next row by descending ``order`` (nulls last, ties by
    ``tie``); after the last row comes the first.

    A global order without one task for all rows: cut points from approximate quantiles of ``order`` deal the rows into as many
    ranges as there are shuffle partitions, each range looks ahead by itself, and the first row of each range, one per range,
    completes the one before. The cut points are literals, so a lost task is recomputed the same way. Rows of one id, null ids among
    them, are in one range: what follows a row is defined by an order of all rows. An empty table stays empty.
    """
    df, back = set_aside(df, "_range", "_last", "_no", *(f"next_{c}" for c in carry), *(f"_head_{c}" for c in carry))
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(df.where(F.col(order).isNotNull()).stat.approxQuantile(order, [i / parts for i in range(1, parts)], 1 / (8 * parts))))
    cut = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    # the highest values are in range 0; null ids come last
    rank = F.when(F.col(order).isNull(), len(cuts) + 1).otherwise(F.size(F.filter(cut, lambda c: c >= F.col(order))))
    df = df.withColumn("_range", rank)
    within = W.partitionBy("_range").orderBy(F.col(order).desc_nulls_last(), tie)
    names = {c: f"next_{c}" for c in carry}
    ahead = derive(df).withColumns({n: F.lead(c).over(within) for c, n in names.items()} | {"_last": F.lead(F.lit(1)).over(within).isNull()})
    # the first rows are found before anything is derived, so that it is derived for them alone
    heads = derive(df.withColumn("_no", F.row_number().over(within)).where("_no = 1").drop("_no")).select("_range", *(F.col(c).alias(f"_head_{c}") for c in carry))
    # one row per range: a window over them all is bounded by the number of ranges
    ring = W.partitionBy(F.lit(0)).orderBy("_range")
    heads = heads.select("_range", *(F.coalesce(F.lead(f"_head_{c}").over(ring), F.first(f"_head_{c}").over(ring)).alias(f"_head_{c}") for c in carry))
    ahead = ahead.join(heads, "_range", "left")
    done = {n: F.when(F.col("_last"), F.col(f"_head_{c}")).otherwise(F.col(n)) for c, n in names.items()}
    return back(ahead.withColumns(done).drop("_range", "_last", *(f"_head_{c}" for c in carry)))


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows each give a row; ties of doc_id follow the order of their texts. A null text is empty, an empty text has no
    fingerprint and a null id comes last; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, "doc_id", "text", ["text", "fp"], lambda d: fingerprint(d, "text", "fp"))
    docs = docs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("edited"), "fp", "next_fp")
    docs = fingerprint(docs, "edited", "efp")
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLES: dict[str, str] = {}
