"""Quality selection by importance resampling: two hashed n-gram models, their likelihood ratio, Gumbel top-k; a second
ratio, fitted on toxic labels, puts toxic documents last."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm._common import bitmap, in_bitmap, small_batches, table, written
from sensorframe.llm._grams import ngrams, word_hashes

BUCKETS = 1 << 17  # n-grams are counted by hash in so many buckets: the size of both models, whatever the input
ORDERS = (1, 2)
SMOOTHING = 100.0
WHOLE = 1000.0  # a document's weight is its mean log ratio times this many n-grams
TOXIC_SMOOTHING = 20.0
TOXIC_GRAMS = 3  # a document is as toxic as so many of its n-grams together, those that tell most: a word in a long text counts as much
TOXIC_LEAST = 0.25  # n-grams with a smaller log ratio tell nothing
TOXIC_SCALE = 100.0
LOWERED = 2 * WHOLE  # what a document judged toxic loses in weight
EXACT_AT = 20_000  # the search for the k-th key ends with a sort of at most about this many
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]+")


def features(raw: bytes) -> np.ndarray:
    """Buckets of all words, runs of punctuation and pairs of neighbours, one entry for each occurrence."""
    words = word_hashes(_MARKS.sub(rb" \g<0> ", raw))
    grams = [ngrams(words, n, whole_if_short=False) for n in ORDERS]
    return (np.concatenate(grams) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _counts(docs: DataFrame) -> np.ndarray:
    """Counts (2, BUCKETS) of the documents of each fold, from columns text and fold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for t, fold in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n[fold] += np.bincount(features(t.as_buffer().to_pybytes()), minlength=BUCKETS)
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(row[at]) for row in n)], ["bucket", "n0", "n1"])

    rows = docs.select("text", "fold").mapInArrow(count, "bucket bigint, n0 bigint, n1 bigint")
    rows = rows.groupBy("bucket").agg(F.sum("n0"), F.sum("n1")).toArrow()  # at most BUCKETS rows
    n = np.zeros((2, BUCKETS))
    n[:, rows.column(0).to_numpy()] = np.stack([rows.column(i).to_numpy() for i in (1, 2)])
    return n


def _label_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """From columns text, fold, target and toxic: counts (2, BUCKETS) of the target documents of each fold, and for documents that
    are (not toxic, toxic) how many of each fold hold each bucket, (2, 2, BUCKETS + 1), with the number of all last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((6, BUCKETS + 1), np.int64)
        for batch in batches:
            for t, fold, target, toxic in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                at, times = np.unique(features(t.as_buffer().to_pybytes()), return_counts=True)
                if target:
                    n[fold, at] += times
                if toxic is not None:
                    n[2 + 2 * toxic + fold, at] += 1
                    n[2 + 2 * toxic + fold, BUCKETS] += 1
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(row[at]) for row in n)], ["bucket", *(f"n{i}" for i in range(6))])

    rows = docs.select("text", "fold", "target", "toxic").mapInArrow(count, "bucket bigint, " + ", ".join(f"n{i} bigint" for i in range(6)))
    rows = rows.groupBy("bucket").agg(*(F.sum(f"n{i}") for i in range(6))).toArrow()  # at most BUCKETS + 1 rows
    n = np.zeros((6, BUCKETS + 1))
    n[:, rows.column(0).to_numpy()] = np.stack([rows.column(i + 1).to_numpy() for i in range(6)])
    return n[:2, :BUCKETS], n[2:].reshape(2, 2, BUCKETS + 1)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (id, text, fold) whose id is in ``labels``, with its other columns. A bitmap of fixed size drops most others in
    their tasks, so that few texts move to the join."""
    wanted = bitmap(labels.select(F.xxhash64("id").alias("h")), "h")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(in_bitmap(wanted, batch.column(3).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["id", "text", "fold"]).filter(at)

    kind = docs.schema["id"].dataType.simpleString()
    some = docs.select("id", "text", "fold", F.xxhash64("id").alias("h")).mapInArrow(keep, f"id {kind}, text binary, fold int")
    return some.hint("merge").join(labels, "id")


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket, (2, BUCKETS): for documents of one fold from the target documents of the
    other, so that no document is weighed by its own label. Both models get the same prior of ``SMOOTHING`` raw occurrences."""
    raw, out = raw.sum(0), np.zeros((2, raw.shape[1]))
    for fold, own in enumerate((target[1], target[0])):
        if own.sum():
            out[fold] = np.log((own * (raw.sum() / own.sum()) + SMOOTHING) / (raw + SMOOTHING))
    return out.astype(np.float32)


def toxic_ratios(held: np.ndarray) -> np.ndarray:
    """Log of the toxic share among labelled documents that hold a bucket over that share among all, (2, BUCKETS), cross-fitted as
    ``log_ratios``; each share gets a prior of ``TOXIC_SMOOTHING`` documents. Ratios under ``TOXIC_LEAST`` are 0."""
    out = np.zeros((2, held.shape[2] - 1))
    for fold in (0, 1):
        clean, toxic = held[:, 1 - fold, :-1]
        n_clean, n_toxic = held[:, 1 - fold, -1]
        if n_toxic:
            base = n_toxic / (n_clean + n_toxic)
            out[fold] = np.log((toxic + TOXIC_SMOOTHING * base) / (toxic + clean + TOXIC_SMOOTHING) / base)
    return np.where(out > TOXIC_LEAST, out, 0).astype(np.float32)


def toxicity(ratios: np.ndarray, grams: np.ndarray) -> float:
    """The sum of the largest ``TOXIC_GRAMS`` ratios among a document's distinct buckets, times ``TOXIC_SCALE``."""
    found = ratios[np.unique(grams[ratios[grams] > 0])]
    return TOXIC_SCALE * float(np.sort(found)[-TOXIC_GRAMS:].sum())


def _fold(doc_id) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), doc_id), F.lit(2)).cast("int")


def weigh(docs: DataFrame, ratios: np.ndarray, toxic: np.ndarray, doc_id: str, text: str, seed: int) -> DataFrame:
    """(doc_id, log_weight, key, toxicity): ``key`` is the weight plus a Gumbel draw that depends on the id and the seed alone."""
    draw = (F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    only = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), (-F.log(-F.log(draw))).alias("noise"), _fold(F.col(doc_id)).alias("fold"))
    kind = only.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, weight, hurt = batch.column(3).to_pylist(), np.full(batch.num_rows, -WHOLE), np.zeros(batch.num_rows)
            for i, (t, f) in enumerate(zip(batch.column(1), folds, strict=True)):
                if len(grams := features(t.as_buffer().to_pybytes())):
                    weight[i], hurt[i] = WHOLE * float(ratios[f][grams].mean()), toxicity(toxic[f], grams)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(weight + batch.column(2).to_numpy()), pa.array(hurt)], ["id", "log_weight", "key", "toxicity"])

    return only.mapInArrow(score, f"id {kind}, log_weight double, key double, toxicity double").withColumnRenamed("id", doc_id)


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column without a global sort: quantiles of what is left close in on it, then a short sort."""
    low, high, above = float("-inf"), float("inf"), 0  # the value is in (low, high]; ``above`` values are over high
    while k > 0:
        inside = rows.where((F.col(column) > low) & (F.col(column) <= high))
        n = inside.count()
        if above + n < k:
            return None
        if n <= EXACT_AT:
            return inside.orderBy(F.desc(column)).limit(k - above).agg(F.min(column)).first()[0]
        cuts = sorted(set(inside.approxQuantile(column, [i / 64 for i in range(65)], 1 / 256)))
        over = inside.agg(*(F.count_if(F.col(column) > c).alias(f"c{i}") for i, c in enumerate(cuts))).first()
        # the first cut with fewer than k values over it bounds from above, the cut before it from below
        at = next(i for i in range(len(cuts)) if above + over[i] < k)
        if at and inside.where((F.col(column) > cuts[at - 1]) & (F.col(column) < cuts[at])).isEmpty():
            return cuts[at]
        low, high, above = (cuts[at - 1] if at else low), cuts[at], above + over[at]
        if not at and inside.agg(F.min(column)).first()[0] == cuts[at]:
            return cuts[at]
    return None


def best_cut(weighed: DataFrame, labels: DataFrame, column: str, label: str, doc_id: str) -> tuple[float | None, float]:
    """The whole-numbered value of a column at which documents with the label over it and labelled ones without it under it make up
    the largest shares, and by how much these exceed a half each, twice; None without any with the label. A histogram of at most
    4,001 values comes to the driver."""
    own = labels.where(F.col(label).isNotNull()).select("id", F.col(label).alias("yes"))
    both = weighed.select(F.col(doc_id).alias("id"), F.floor(F.greatest(F.least(column, F.lit(2000.0)), F.lit(-2000.0))).alias("w")).join(own, "id")
    rows = both.groupBy("w").agg(F.count_if("yes").alias("yes"), F.count_if(~F.col("yes")).alias("no")).collect()
    rows = np.array(sorted((float(w), y, n) for w, y, n in rows)).reshape(-1, 3)
    yes, no = rows[:, 1].sum(), rows[:, 2].sum()
    if not yes:
        return None, 0.0
    over = (yes - np.cumsum(rows[:, 1]) + rows[:, 1]) / yes - (no - np.cumsum(rows[:, 2]) + rows[:, 2]) / max(no, 1)
    return float(rows[int(over.argmax()), 0]), float(over.max())


def resample(docs: DataFrame, labels: DataFrame, *, k: int | None = None, doc_id: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """The ``k`` documents with the largest keys: (doc_id, log_weight, key). Target documents are those with labels of which all
    have quality 1 and toxic 0; the raw model counts all documents. Without ``k`` as
    many are drawn as have the weight that best parts target documents from all others with labels.

    A document's weight is the mean log ratio over its words, punctuation and pairs times ``WHOLE``, so long documents do not
    win by length. A document is judged toxic when its few n-grams that are most toxic by the labels pass the sum that best parts
    toxic from other labelled documents; its weight and key are ``LOWERED`` less. A null or empty text has the weight -``WHOLE``. Null
    labels are no labels, but a document without a quality can be labelled toxic; labels of unknown documents and other
    columns are not used. Repeated rows have equal keys and come together: rows tied with the k-th key all stay. Rows with a
    null id are weighed like others. Without good labels and without ``k``, and for an empty table, the result
    is empty.
    """
    small_batches(docs.sparkSession)
    own = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min("quality").alias("q"), (F.max("toxic") != 0).alias("toxic"))
    hurts = F.coalesce("toxic", F.lit(False))
    own = own.select("id", "toxic", F.when(F.col("q").isNotNull() | hurts, F.coalesce(F.col("q") == 1, F.lit(False)) & ~hurts).alias("target"))
    own = written(own.where(F.coalesce("toxic", "target").isNotNull()), "labels")
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), _fold(F.col(doc_id)).alias("fold"))
    target, held = _label_counts(_labelled(texts, own))
    weighed = written(weigh(docs, log_ratios(_counts(texts), target), toxic_ratios(held), doc_id, text, seed), "weights")
    limit, gain = best_cut(weighed, own, "toxicity", "toxic", doc_id)
    if limit and gain > 0:
        loss = F.when(F.col("toxicity") >= limit, LOWERED).otherwise(0.0)
        weighed = weighed.withColumns({"log_weight": F.col("log_weight") - loss, "key": F.col("key") - loss})
    weighed = weighed.drop("toxicity")
    if k is None:
        cut, _ = best_cut(weighed, own, "log_weight", "target", doc_id)
        k = 0 if cut is None else weighed.where(F.col("log_weight") >= cut).count()
    least = kth_largest(weighed, "key", k)
    return weighed.where(F.lit(k > 0)) if least is None else weighed.where(F.col("key") >= least)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES: dict[str, str] = {}
