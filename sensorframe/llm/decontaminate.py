"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm._common import bitmap, in_bitmap, join_counted, pieces, small_batches, table, written
from sensorframe.llm._grams import ngrams, word_hashes

SEED = 3  # words of a seed
LEAST_WORDS = 5  # shorter items can't be told from chance and are never matched
THRESHOLD = 0.4
MATCH, MISMATCH, GAP = 2, -1, -1
CELLS = 1 << 20  # of a row of the table, over all pairs that are aligned side by side
_MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def words_of(raw: bytes) -> np.ndarray:
    """Word hashes of a text without ASCII punctuation, A-Z lower-cased."""
    return word_hashes(raw.translate(None, _MARKS))


def _seeds(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, words, seed, at): every n-gram of every item, with the item's words."""
    own = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).dropDuplicates()
    kind = own.schema["item"].dataType.simpleString()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_buffer().to_pybytes()) for t in batch.column(1)]
            words = [w if len(w) >= LEAST_WORDS else w[:0] for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())), pa.array([ngrams(w, SEED).view(np.int64) for w in words], pa.list_(pa.int64()))],
                ["item", "words", "seeds"],
            )

    return own.mapInArrow(spell, f"item {kind}, words array<bigint>, seeds array<bigint>").select("item", "words", F.posexplode("seeds").alias("at", "seed"))


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each pair: score as a share of a whole match, and the passage word where it ends.

    Rows of the Smith-Waterman table are computed for all pairs at once; a row's gaps along the passage are a running maximum.
    """
    rows, cols = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((len(items), rows), np.uint64), np.ones((len(items), cols), np.uint64)
    real_a, real_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
        real_a[i, : len(x)], real_b[i, : len(y)] = True, True
    slope = -GAP * np.arange(1, cols + 1, dtype=np.int32)
    above = np.zeros((len(items), cols + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    every = np.arange(len(items))
    for i in range(rows):
        same = (a[:, i : i + 1] == b) & real_a[:, i : i + 1] & real_b
        row = np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope, 1) - slope
        above = np.concatenate((np.zeros((len(items), 1), np.int32), row), 1)
        at = row.argmax(1)
        top = row[every, at]
        end = np.where(top > best, at, end)
        best = np.maximum(best, top)
    return best / (MATCH * np.array([max(1, len(x)) for x in items])), end


def _side_by_side(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pairs by the length of their passages, as many together as fill ``CELLS`` when all are as long as the longest."""
    size = np.diff(np.asarray(batch.column(3).offsets))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        most = np.arange(1, len(order) - at + 1) * size[order[at:]]
        n = max(1, int(np.searchsorted(most, CELLS, "right")))
        yield batch.take(pa.array(order[at : at + n]))
        at += n


def contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, end_word): document and item pairs whose best alignment scores ``threshold`` or more of a whole
    match; ``end_word`` is the document's word (from 0) where that passage ends.

    Null texts are empty; rows with a null id, and items of fewer than ``LEAST_WORDS`` words, are in no pair. Repeated rows give
    one pair; rows that repeat an id are compared each and the best one is told. Other columns are not read. Without documents
    or items the result is empty.

    One pass over the texts finds, through a bitmap of fixed size, the words around possible seeds; what passes is joined with
    the benchmark's seeds by Spark. All items that share a seed with a passage are aligned with it, so what is found in one document
    does not depend on the others.
    """
    small_batches(docs.sparkSession)
    seeds = written(_seeds(items, item_id, item_text), "seeds")
    bits = bitmap(seeds, "seed")
    longest = seeds.agg(F.max(F.size("words"))).first()[0] or 0
    only = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("version"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = only.schema["doc"].dataType.simpleString()

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            of, first, around, found = [], [], [], []
            for i, t in enumerate(batch.column(2)):
                words = words_of(t.as_buffer().to_pybytes())
                grams = ngrams(words, SEED, whole_if_short=False)
                hits = np.flatnonzero(in_bitmap(bits, grams))
                if not len(hits):
                    continue
                # hits whose surroundings touch are one passage
                for part in np.split(hits, np.flatnonzero(np.diff(hits) > longest) + 1):
                    lo, hi = max(0, part[0] - longest), part[-1] + SEED + longest
                    of.append(i)
                    first.append(lo)
                    around.append(words[lo:hi].view(np.int64))
                    found.append(np.unique(grams[part]).view(np.int64))
            rows = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first, pa.int64()), pa.array(around, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))],
                ["doc", "version", "first", "around", "seeds"],
            )

    hits = only.mapInArrow(passages, f"doc {kind}, version bigint, first bigint, around array<bigint>, seeds array<bigint>")
    hits = written(hits, "passages")
    each = hits.select("doc", "version", "first", F.explode("seeds").alias("seed"))
    # every seed counts, however common: an edited copy may have left no other one whole
    held = seeds.select("item", "seed").distinct().join(each.groupBy("seed").agg(F.count("*").alias("n")), "seed")
    pairs = join_counted(each, written(held, "held-seeds"), ["seed"], "n", F.col("version")).select("doc", "version", "first", "item").distinct()
    pairs = written(pairs, "passage-pairs")
    texts = seeds.select("item", "words").dropDuplicates(["item", "words"]).join(pairs.groupBy("item").agg(F.count("*").alias("n")), "item")
    pairs = pairs.join(hits.drop("seeds"), ["doc", "version", "first"])
    pairs = join_counted(pairs, written(texts, "item-texts"), ["item"], "n", F.col("version"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _side_by_side(batch):
                got, end = align(*([np.asarray(v.values).view(np.uint64) for v in part.column(c)] for c in (4, 3)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got), pa.array(end + part.column(2).to_numpy())], ["doc", "item", "score", "end_word"])

    items_kind = texts.schema["item"].dataType.simpleString()
    scored = pairs.select("doc", "item", "first", "around", "words").mapInArrow(score, f"doc {kind}, item {items_kind}, score double, end_word bigint")
    best = scored.where(F.col("score") >= threshold).groupBy("doc", "item").agg(F.max(F.struct("score", -F.col("end_word"))).alias("b"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("b.score").alias("score"), (-F.col("b.col2")).alias("end_word"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
ORACLES: dict[str, str] = {}
