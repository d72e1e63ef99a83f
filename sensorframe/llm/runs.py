"""Periodic runs of words, by online dyadic square catching, and texts with the repetitions taken out."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm._common import pieces, set_aside, small_batches, table
from sensorframe.llm._grams import mix

#: A run is at least so many words long, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: How many known stretches that begin before a place are looked at, to see whether one of them explains a catch there.
_LOOK_BACK = 4


def _extent(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words ``period`` apart are the same: (start, end). Compares in doubling steps, so the
    work is that of the stretch's length."""

    def reach(step: int) -> int:
        done, size = 0, 16
        while True:
            if step > 0:
                a = words[at + done : min(at + done + size, len(words) - period)]
                b = words[at + done + period : at + done + period + len(a)]
            else:
                a = words[max(0, at - done - size) : at - done][::-1]
                b = words[max(0, at - done - size) + period : at - done + period][::-1]
            if not len(a):
                return done
            if (differ := a != b).any():
                return done + int(differ.argmax())
            done += len(a)
            size *= 2

    return at - reach(-1), at + reach(1) + period


class Catcher:
    """Squares caught so far in a sequence of word numbers, as stretches (start, end, period).

    Each block of 2^k words that begins at a multiple of 2^k becomes a catcher once it is complete: as words are appended, it compares
    itself with every suffix 2^k words long that begins 2^k to 2^(k+1) - 1 words after it. A stretch of period p that is four periods
    long holds two such blocks in a row, of the largest 2^k up to p, whose copies stand p words on; so each run is caught. The
    comparisons of one level are one numpy comparison of hashes over all appended words; a catch is then compared word by word and
    grown both ways into its whole stretch. A catch whose distance is a multiple of a known stretch's period, in that stretch, is the
    same stretch again and is passed over, so the work is n log n and the length of the stretches.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.starts = np.empty(0, np.int64)
        self.ends = np.empty(0, np.int64)
        self.periods = np.empty(0, np.int64)

    def _known(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether a stretch caught at a lower level covers a whole period at a place and has a period that divides it."""
        out = np.zeros(len(at), bool)
        if len(self.starts):
            last = np.searchsorted(self.starts, at, "right") - 1
            for back in range(_LOOK_BACK):
                i = np.maximum(last - back, 0)
                out |= (last >= back) & (self.ends[i] >= at + period) & (period % self.periods[i] == 0)
        return out

    def catch(self, longest: int) -> None:
        """Runs all levels for sequences of at most ``longest`` words."""
        suffix = mix(self.words.astype(np.uint64))  # a hash of each suffix's first 2^k words
        block = 1
        while LEAST_TIMES * block <= longest and len(suffix) > 2 * block:
            rows = (len(suffix) - block) // block  # catchers with all their suffixes
            full = suffix[block : block + rows * block].reshape(rows, block) == suffix[: rows * block : block, None]
            rest = len(suffix) - block - rows * block  # the last catcher has not met all of its suffixes
            if rest:
                tail = np.zeros((1, block), bool)
                tail[0, :rest] = suffix[block + rows * block :] == suffix[rows * block]
                full = np.concatenate((full, tail))
            both = full[:-1] & full[1:]
            both[1:] &= ~full[:-2]  # the first catcher of several in a row that catch at one distance
            row, ahead = np.nonzero(both)
            at, period = row * block, ahead + block
            new = ~self._known(at, period)
            self._grow(at[new], period[new])
            suffix = mix(suffix[:-block] * np.uint64(0xD6E8FEB86659FD93) + suffix[block:])
            block *= 2

    def _grow(self, at: np.ndarray, period: np.ndarray) -> None:
        found = {(*_extent(self.words, a, p), p) for a, p in zip(at.tolist(), period.tolist(), strict=True)}
        found = np.array(sorted(s for s in found if s[1] - s[0] >= 2 * s[2]), np.int64).reshape(-1, 3)
        starts = np.concatenate((self.starts, found[:, 0]))
        order = np.argsort(starts, kind="stable")
        self.starts = starts[order]
        self.ends = np.concatenate((self.ends, found[:, 1]))[order]
        self.periods = np.concatenate((self.periods, found[:, 2]))[order]

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run, by start and then period. One stretch caught with several periods has the smallest."""
        least: dict[tuple[int, int], int] = {}
        for start, end, period in zip(self.starts.tolist(), self.ends.tolist(), self.periods.tolist(), strict=True):
            least[start, end] = min(period, least.get((start, end), period))
        return sorted((a, b - a, p) for (a, b), p in least.items() if b - a >= max(LEAST_WORDS, LEAST_TIMES * p))


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several lists of words. All are one sequence with a word of its own between any two."""
    numbers: dict[bytes, int] = {}
    sequence, first, at = [], [], 0
    for i, words in enumerate(texts):
        first.append(at)
        sequence.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        sequence.append(np.array([-1 - i]))
        at += len(words) + 1
    catcher = Catcher(np.concatenate(sequence) if sequence else np.empty(0, np.int64))
    catcher.catch(max(map(len, texts), default=0))
    out: list[list] = [[] for _ in texts]
    for start, length, period in catcher.runs():
        i = int(np.searchsorted(first, start, "right")) - 1
        out[i].append((start - first[i], length, period))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def find_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, runs, best, collapsed) of every row: ``runs`` lists all runs as (start, length, period) by start and then period, ``best``
    is the one with the greatest length / period (ties: smallest start, then period; null without runs), ``collapsed`` the
    words that no run holds after its first period, joined by one space.

    Words are split by the six ASCII blanks and compared as they are. A run is a stretch of words with smallest period p and at least
    max(6, 4 p) words that cannot be longer with that period. A null or empty text has no words; a null id stays null;
    repeated rows each give a row; other columns are not read; an empty table gives an empty result. Texts are handled one by one,
    whole: no shuffle, and memory is bounded by a batch or the longest text.
    """
    small_batches(docs.sparkSession)
    only = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ("start", "length", "period")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            texts = [t.as_buffer().to_pybytes().split() for t in batch.column(1)]
            found = runs_of(texts)
            best = [min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None) for r in found]
            columns = [
                batch.column(0),
                pa.array([[dict(zip(names, x, strict=True)) for x in r] for r in found], pa.list_(run)),
                pa.array([b and dict(zip(names, b, strict=True)) for b in best], run),
                pa.array([_collapsed(w, r) for w, r in zip(texts, found, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "runs", "best", "collapsed"])

    fields = "struct<start:bigint,length:bigint,period:bigint>"
    out = only.mapInArrow(scan, f"_id {only.schema['_id'].dataType.simpleString()}, runs array<{fields}>, best {fields}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string")).withColumnRenamed("_id", doc_id)


def with_planted_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Makes a known share of texts periodic from some word on, for measuring: with h the CRC-32 of the decimal id, g = h / 10, where
    h % 10 = 0 each word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) / (3 + g % 8), of n words. Other texts, and
    those with a null id, stay."""
    docs, back = set_aside(docs, *{"_words", "_g", "_a", "_p"} - {doc_id, text})
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    hit = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    docs = docs.withColumn("_words", F.when(hit, words)).withColumn("_g", F.floor(h / 10))
    n = F.size("_words")
    docs = docs.withColumn("_a", F.when(n > 0, (F.col("_g") % n).cast("int")))
    docs = docs.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    a, p = F.col("_a"), F.col("_p")
    turned = F.transform("_words", lambda w, i: F.when(i < a, w).otherwise(F.get(F.col("_words"), a + (i - a) % p)))
    return back(docs.withColumn(text, F.when(a.isNotNull(), F.array_join(turned, " ")).otherwise(F.col(text))).drop("_words", "_g", "_a", "_p"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = [F.col(f"best.{c}") for c in ("start", "length", "period")]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *best, F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
