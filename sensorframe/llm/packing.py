"""Best-fit packing of tokenised documents into sequences of fixed capacity, large items matched in pairs.

Which lengths go together depends on how many pieces have each length, not on which pieces those are. So the packing is planned
over the histogram of lengths (at most ``capacity`` numbers, however many documents there are), as runs of equal placements, and
every piece finds its place in its own task by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.llm._common import small_batches, table, written

CAPACITY = 4096
END_ID = 1
SALTS = 64
CACHE_WORDS = 250_000  # words whose ids a task remembers, in each of two generations
TOGETHER = 32  # texts that are encoded together


#: Texts of these characters are cut by a plain expression as the tokenizer cuts them; it sees any other text whole.
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_CUT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u017f]")


class _Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    The tokenizer lower-cases, cuts a text into words, digits and runs of marks, and encodes each by itself; so repeated ones
    are looked up. Two generations of ``CACHE_WORDS`` words and those of one call bound the memory. Texts that may hold a special
    string are not cut.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        ask = []
        for word in new:
            if (ids := self.older.get(word)) is None:
                ask.append(word)
            else:
                self.known[word] = ids
        if not ask:
            return
        found = self.tokenizer.encode(" ".join(ask), add_special_tokens=False)
        ids, of = np.array(found.ids, "<u4"), np.array(found.word_ids)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        if len(first) != len(ask):  # a word that the tokenizer cuts otherwise; not known to happen
            self.known.update((w, self._whole(w)) for w in ask)
            return
        raw, edges = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
        self.known.update((w, raw[a:b]) for w, a, b in zip(ask, edges, edges[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [None if "<|" in t or (not t.isascii() and _OTHER.search(t)) else _CUT.findall(t.lower()) for t in texts]
        if len(self.known) > CACHE_WORDS:  # only here, so what is learned below is all there when it is looked up
            self.known, self.older = {}, self.known
        missing = set().union(*(w for w in words if w is not None)).difference(self.known)
        if missing:
            self._learn(sorted(missing))
        return [self._whole(t) if w is None else b"".join(map(self.known.__getitem__, w)) for t, w in zip(texts, words, strict=True)]


def token_pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and ``end_id``, cut into pieces of ``capacity``: (doc_id, piece, start, length, ids), ids as binary
    of little-endian unsigned 32-bit numbers. A null or empty text is ``end_id`` alone. A null id stays null; repeated rows each
    give their pieces; other columns are not read; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    only = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = only.schema["_id"].dataType.simpleString()
    tail = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(path)
        for batch in batches:
            of, piece, parts = [], [], []
            for low in range(0, batch.num_rows, TOGETHER):
                texts = [t.as_py() for t in batch.column(1).slice(low, TOGETHER)]
                for i, ids in enumerate(encoder.encode(texts), low):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        of.append(i)
                        piece.append(k)
                        parts.append(ids[at : at + 4 * capacity])
            piece = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                ["_id", "piece", "start", "length", "ids"],
            )

    return only.mapInArrow(encode, f"_id {kind}, piece int, start bigint, length bigint, ids binary").withColumnRenamed("_id", doc_id)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places ``counts[length]`` pieces of each length. Returns runs (length, first rank, pieces, first sequence, pieces in each
    sequence, offset): the pieces of that length with these ranks lie side by side in consecutive sequences, from the offset on.

    Lengths above a third of the capacity come first, each sequence taking one or two of them: the longest with the longest
    other that fits. Then the rest by falling length, each into the smallest gap that holds it, a new sequence where none does.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = {}
    gaps: dict[int, list[list[int]]] = {}  # free tokens -> ranges [first, after) of sequences
    free: list[int] = []  # the gaps that occur, ascending
    sequences = 0

    def place(n: int, each: int, bins: int, first: int, offset: int) -> None:
        rank = used.get(n, 0)
        used[n] = rank + each * bins
        left[n] -= each * bins
        runs.append((n, rank, each * bins, first, each, offset))

    def leave(gap: int, first: int, after: int) -> None:
        if gap > 0 and after > first:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(free, gap)
            gaps[gap].append([first, after])

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            fits = [m for m in large if left[m] and m <= capacity - n and (m != n or left[n] > 1)]
            first = sequences
            if not fits:
                bins = left[n]
                place(n, 1, bins, first, 0)
                leave(capacity - n, first, first + bins)
            elif fits[0] == n:
                bins = left[n] // 2
                place(n, 2, bins, first, 0)
                leave(capacity - 2 * n, first, first + bins)
            else:
                m = fits[0]
                bins = min(left[n], left[m])
                place(n, 1, bins, first, 0)
                place(m, 1, bins, first, n)
                leave(capacity - n - m, first, first + bins)
            sequences = first + bins

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(free, n)
            if at == len(free):
                bins = -(-left[n] // (capacity // n))
                leave(capacity, sequences, sequences + bins)
                sequences += bins
                continue
            gap = free[at]
            each = min(gap // n, left[n])
            span = gaps[gap][-1]
            bins = min(span[1] - span[0], left[n] // each)
            place(n, each, bins, span[0], capacity - gap)
            leave(gap - each * n, span[0], span[0] + bins)
            span[0] += bins
            if span[0] == span[1]:
                gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    free.remove(gap)
    return runs


def _rank_in_length(pieces: DataFrame, tie: list[Column]) -> DataFrame:
    """Adds ``_rank``: 0.. among the pieces of one length, in two levels so that a frequent length is no single task."""
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64(*tie), F.lit(SALTS)).cast("int"))
    cells = pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n"))  # at most capacity x SALTS rows
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("length", "_salt").orderBy(*tie))
    return pieces.withColumn("_own", own).join(cells, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1).drop("_salt", "_own", "_before")


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, tie: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` is read twice: give a written table. Only the histogram of lengths comes to the driver.
    """
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").agg(F.count("*")).collect()}
    runs = plan_packing(counts, capacity)
    by_length: dict[int, list] = {}
    for run in runs:
        by_length.setdefault(run[0], []).append(run[1:])
    plan = {n: np.array(r, np.int64).T for n, r in by_length.items()}
    ranked = _rank_in_length(pieces, [F.col(c) for c in tie])
    columns = pieces.columns
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                rank0, _, first, each, start = plan[int(n)]
                run = np.searchsorted(rank0, ranks[rows], "right") - 1
                k = ranks[rows] - rank0[run]
                sequence[rows] = first[run] + k // each[run]
                offset[rows] = start[run] + (k % each[run]) * n
            keep = [batch.column(batch.schema.get_field_index(f)) for f in columns]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(locate, ", ".join([*names, "sequence_id bigint", "offset bigint"]))


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece, with ``ids`` if asked for; see
    :func:`token_pieces` for unusual rows. The sequences are the pieces of one ``sequence_id`` in order of ``offset``."""
    pieces = token_pieces(docs, doc_id=doc_id, text=text, tokenizer=tokenizer, capacity=capacity)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    pieces = written(pieces if with_ids else pieces.drop("ids"), "pieces")
    return pack(pieces, capacity=capacity, tie=(doc_id, "piece", "ids_crc32"))  # rows that repeat an id differ in their ids, or are alike


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}
