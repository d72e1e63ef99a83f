"""Spelling variants: words one edit apart, found in a trie of letter-group counts, and the commoner forms that they lead to."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm._common import HOT, ascii_lower, set_aside, small_batches, table, written

#: Letters that are a group each; all other characters fall into REST groups by their code point.
FREQUENT, REST = "etaoinsrhdlu", 4
GROUPS = len(FREQUENT) + REST
#: So many queries to one part of the trie are no reason to salt it; so many are searched for at a time.
LEAST_HOT, QUERIES_AT_ONCE = 100_000, 50_000
#: A node of the trie with more words is split by the next group's count; there are at most MOST_NODES such nodes at each level, whatever
#: the vocabulary, and they travel to each task.
BUCKET, MOST_NODES = 4096, 20_000
#: A node with so few words or queries is searched without descending any further.
FEW = 8
LEAST_CHARS, LEAST_TIMES, DOMINANT = 6, 5, 5

_GROUP_OF = np.array([FREQUENT.index(chr(c)) if chr(c) in FREQUENT else len(FREQUENT) + c % REST for c in range(256)])


def vectors(words: list[str]) -> np.ndarray:
    """(words, GROUPS) counts of each word's letter groups, cut at 255: cutting never makes two counts differ by more."""
    out = np.zeros((len(words), GROUPS), np.uint8)
    if words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        group = np.where(points < 256, _GROUP_OF[np.minimum(points, 255)], len(FREQUENT) + points % REST)
        cells = np.bincount(np.repeat(np.arange(len(words)), sizes) * GROUPS + group, minlength=len(words) * GROUPS)
        out[:] = np.minimum(cells, 255).reshape(-1, GROUPS)
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether ``b`` is ``a`` with one code point inserted, or one replaced and ``a`` is the smaller."""
    if len(a) == len(b):
        if a >= b:
            return False
        i = next(i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y)
        return a[i + 1 :] == b[i + 1 :]
    if len(a) + 1 != len(b):
        return False
    i = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[i:] == b[i + 1 :]


def halves_of_member(word: str) -> list[tuple]:
    half = len(word) // 2
    return [(len(word), "p", word[:half]), (len(word), "s", word[half:])]


def halves_of_query(word: str) -> list[tuple]:
    """The halves that words with one more or one other character share with ``word``: one of two stays whole."""
    out = []
    for size in (len(word), len(word) + 1):
        half = size // 2
        out += [(size, "p", word[:half]), (size, "s", word[len(word) - (size - half) :])]
    return out


def _steps(counts: np.ndarray, more: np.ndarray, less: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each count that a branch may have: (count, which queries may take it, what is left of their surplus and deficit)."""
    for c in range(max(0, int(counts.min()) - 1), min(255, int(counts.max()) + 1) + 1):
        ahead = c - counts.astype(np.int64)
        may = np.flatnonzero((ahead == 0) | ((ahead == 1) & more) | ((ahead == -1) & less))
        if len(may):
            yield c, may, more[may] & (ahead[may] != 1), less[may] & (ahead[may] != -1)


def buckets(vecs: np.ndarray, split: set[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """(prefix, queries) for each part of the trie that queries can reach with a surplus and a deficit of one each, depth first.
    ``split`` holds the prefixes of the nodes that are split further."""

    def visit(prefix: bytes, who: np.ndarray, more: np.ndarray, less: np.ndarray) -> Iterator[tuple[bytes, np.ndarray]]:
        if prefix not in split or len(prefix) == GROUPS:
            yield prefix, who
            return
        for c, may, m, d in _steps(vecs[who, len(prefix)], more, less):
            yield from visit(prefix + bytes([c]), who[may], m, d)

    if len(vecs):
        yield from visit(b"", np.arange(len(vecs)), np.ones(len(vecs), bool), np.ones(len(vecs), bool))


def homes(vecs: np.ndarray, split: set[bytes]) -> list[bytes]:
    """The part of the trie that each word belongs to."""
    out = []
    for v in vecs:
        raw, d = v.tobytes(), 0
        while d < GROUPS and raw[:d] in split:
            d += 1
        out.append(raw[:d])
    return out


#: Words of up to so many code points are compared many pairs at a time, so many pairs.
WIDTH, PAIRS = 32, 20_000


def _points(words: list[str]) -> np.ndarray:
    """(words, WIDTH) code points, 0 after a word's end; longer words are cut."""
    return np.array(words, f"<U{WIDTH}").view(np.uint32).reshape(-1, WIDTH)


def edits(queries: list[str], words: list[str], pairs: np.ndarray) -> np.ndarray:
    """Those of the (query, word) numbers in ``pairs``, (n, 2), for which ``one_edit`` holds."""
    q, w = (np.fromiter(map(len, x), np.int64, len(x)) for x in (queries, words))
    ahead = w[pairs[:, 1]] - q[pairs[:, 0]]
    pairs = pairs[(ahead == 0) | (ahead == 1)]
    long = w[pairs[:, 1]] > WIDTH
    kept = [np.array([p for p in pairs[long] if one_edit(queries[p[0]], words[p[1]])], np.int64).reshape(-1, 2)]
    pairs = pairs[~long]
    some, of_query = np.unique(pairs[:, 0], return_inverse=True)
    a_points, b_points = _points([queries[i] for i in some]), _points(words)
    for at in range(0, len(pairs), PAIRS):
        part, a = pairs[at : at + PAIRS], a_points[of_query[at : at + PAIRS]]
        b = b_points[part[:, 1]]
        differ = a != b
        first, row = differ.argmax(1), np.arange(len(a))
        same_size = q[part[:, 0]] == w[part[:, 1]]
        replaced = same_size & (differ.sum(1) == 1) & (a[row, first] < b[row, first])
        moved = np.zeros_like(differ)
        moved[:, :-1] = (a[:, :-1] != b[:, 1:]) & (np.arange(WIDTH - 1) >= first[:, None])
        kept.append(part[replaced | (~same_size & ~moved.any(1))])
    return np.concatenate(kept)


class Trie:
    """Words arranged by successive letter-group counts, below a prefix of ``depth`` counts that they all share."""

    def __init__(self, words: list[str], depth: int):
        vecs = vectors(words)
        order = np.lexsort(vecs.T[::-1])
        self.vecs, self.words, self.depth = vecs[order], [words[i] for i in order], depth

    def search(self, queries: list[str]) -> np.ndarray:
        """(query, word) numbers of all pairs of ``one_edit``, (n, 2): a depth-first search that takes all queries along, each with its
        own surplus and deficit; the words of the leaves that it comes to are verified."""
        vecs, found = vectors(queries), [np.empty((0, 2), np.int64)]
        ahead = self.vecs[:1, : self.depth].astype(np.int64) - vecs[:, : self.depth]
        more, less = ahead.clip(0).sum(1), (-ahead).clip(0).sum(1)
        who = np.flatnonzero((more <= 1) & (less <= 1))
        if len(self.words) and len(who):
            waiting, size = [], 0
            for pairs in self._visit(0, len(self.words), self.depth, who, more[who] == 0, less[who] == 0, vecs, queries):
                waiting.append(pairs)
                size += len(pairs)
                if size > 10 * PAIRS:
                    found.append(edits(queries, self.words, np.concatenate(waiting)))
                    waiting, size = [], 0
            if waiting:
                found.append(edits(queries, self.words, np.concatenate(waiting)))
        return np.concatenate(found)

    def _visit(self, low, high, level, who, more, less, vecs, queries) -> Iterator[np.ndarray]:
        """Pairs to verify: words from ``low`` to ``high`` have the same counts before ``level``, queries ``who`` may have ``more`` and
        ``less`` of what is to come."""
        if high - low <= FEW:
            rest = self.vecs[None, low:high, level:].view(np.int8) - vecs[who, None, level:].view(np.int8)
            # differences wrap around at 256, which can only let more pairs pass
            q, w = np.nonzero((np.maximum(rest, 0).sum(2) <= more[:, None]) & (np.maximum(-rest, 0).sum(2) <= less[:, None]))
            if len(q):
                yield np.stack((who[q], low + w), 1)
        elif level == GROUPS:
            yield self._leaf(low, high, who, queries)
        else:
            column = self.vecs[low:high, level]
            for c, may, m, d in _steps(vecs[who, level], more, less):
                a, b = (int(np.searchsorted(column, np.uint8(c), side)) for side in ("left", "right"))
                if b > a:
                    yield from self._visit(low + a, low + b, level + 1, who[may], m, d, vecs, queries)

    def _leaf(self, low, high, who, queries) -> np.ndarray:
        """The words of a leaf have the same counts; where there are many, the half of a word that an edit leaves finds them."""
        half = defaultdict(list)
        for i in range(low, high):
            for key in halves_of_member(self.words[i]):
                half[key].append(i)
        pairs = {(int(q), i) for q in who for key in halves_of_query(queries[q]) for i in half.get(key, ())}
        return np.array(sorted(pairs), np.int64).reshape(-1, 2)


def _nodes(words: DataFrame, limit: int) -> set[bytes]:
    """Prefixes of all trie nodes over more than ``limit`` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = defaultdict(int)
            for v in vectors(batch.column(0).to_pylist()):
                raw = v.tobytes()
                for d in range(GROUPS + 1):
                    seen[raw[:d]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["prefix", "n"])

    rows = words.select("word").mapInArrow(count, "prefix binary, n bigint").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    return {bytes(r.prefix) for r in rows.select("prefix").toLocalIterator()}  # at most words / limit of each length


def _routed(words: DataFrame, split: set[bytes]) -> DataFrame:
    """(bucket, query, word, n): each word at home, and as a query in each part of the trie that it can reach. A leaf with very many words
    is parted by halves of words."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            vecs, keys, at, asks = vectors(texts), [], [], []

            def put(key: bytes, i: int, ask: bool, halves) -> None:
                parts = [key + repr(h).encode() for h in halves(texts[i])] if key in split else [key]
                keys.extend(parts)
                at.extend([i] * len(parts))
                asks.extend([ask] * len(parts))

            for i, key in enumerate(homes(vecs, split)):
                put(key, i, False, halves_of_member)
            for key, who in buckets(vecs, split):
                for i in who.tolist():
                    put(key, i, True, halves_of_query)
            for start in range(0, len(keys), 20_000):
                own = slice(start, start + 20_000)
                columns = [pa.array(keys[own], pa.binary()), pa.array(asks[own]), *(batch.column(k).take(pa.array(at[own])) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "query", "word", "n"])

    return words.select("word", "n").mapInArrow(route, "bucket binary, query boolean, word string, n bigint")


def _pairs(routed: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways for each pair of near words. Buckets with very many queries are salted; their words are repeated."""
    sizes = routed.where("query").groupBy("bucket").agg(F.count("*").alias("size"))
    share = max(LEAST_HOT, (sizes.agg(F.sum("size")).first()[0] or 0) // HOT)
    hot = sizes.where(F.col("size") > share).select("bucket", F.ceil(F.col("size") / share).cast("int").alias("salts"))  # at most HOT rows
    rows = routed.join(F.broadcast(hot), "bucket", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salt = F.when(F.col("query"), F.array(F.pmod(F.xxhash64("word"), F.col("salts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    rows = rows.withColumn("salt", F.explode(salt)).select("bucket", "salt", "query", "word", "n")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, asking = None, [], []  # rows of one bucket and salt: words at home, then queries
        trie = None

        def answers() -> pa.RecordBatch:
            nonlocal trie, asking
            queries, asking = asking, []
            if trie is None:
                trie = Trie([w for w, _ in members], min(len(key[0]), GROUPS)), dict(members)
            second_half = b", 's', " in key[0][GROUPS:]  # a pair that shares the first half is found by that one
            out = []
            for q, m in trie[0].search([w for w, _ in queries]).tolist():
                (word, n), near = queries[q], trie[0].words[m]
                if not second_half or word[: len(near) // 2] != near[: len(near) // 2]:
                    out += [(word, near, trie[1][near]), (near, word, n)]
            kinds = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], kinds[i]) for i in range(3)], ["word", "near", "near_n"])

        for batch in batches:
            names, salts, asks, texts, ns = (batch.column(i).to_pylist() for i in range(5))
            cuts = [i for i in range(len(names)) if not i or (names[i], salts[i], asks[i]) != (names[i - 1], salts[i - 1], asks[i - 1])]
            for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True):
                if (names[a], salts[a]) != key:
                    if asking:
                        yield answers()
                    key, members, trie = (names[a], salts[a]), [], None
                rows_here = zip(texts[a:b], ns[a:b], strict=True)
                if not asks[a]:
                    members += rows_here
                elif members:
                    asking += rows_here
                    if len(asking) >= QUERIES_AT_ONCE:
                        yield answers()
        if asking:
            yield answers()

    rows = rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "query")
    return rows.mapInArrow(match, "word string, near string, near_n bigint")


def near_forms(words: DataFrame, *, dominant: int = DOMINANT, bucket: int = BUCKET) -> DataFrame:
    """``words`` (word, n), each word once. Returns (word, n, n_near, form, form_n): how many other words are one inserted, deleted or
    replaced code point away, and of these the one with the largest n (ties: the smallest in code-point order), null where its
    n is not ``dominant`` times the word's own.

    Each word goes to the part of the trie that it belongs to and asks in all parts that it can reach. Parts hold at most ``bucket``
    words, or a MOST_NODES-th of all where that is more; the nodes above them are few and known to all tasks. Each pair is found
    once, from the shorter or smaller word. Nulls are dropped; an empty table gives an empty result.
    """
    small_batches(words.sparkSession)
    words = words.where(F.col("word").isNotNull())
    split = _nodes(words, max(bucket, words.count() // MOST_NODES))
    pairs = _pairs(written(_routed(words, split), "spelling-routes"))
    none = F.lit(None)
    rows = words.select("word", "n", none.cast("string").alias("near"), none.cast("bigint").alias("near_n"))
    rows = rows.unionByName(pairs.withColumn("n", none.cast("bigint")).select("word", "n", "near", "near_n"))
    first = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))))
    out = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), first.alias("best"))
    out = out.withColumn("best", F.when(-F.col("best.minus") >= dominant * F.col("n"), F.col("best")))
    return out.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds ``root``: the last word reached by following ``form`` from word to word, the word itself without a form.

    Forms are commoner by a factor, so chains are short and have no cycles; each round doubles the steps that are covered and is written."""
    steps = written(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while steps.where("moved").limit(1).count():
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        steps = written(steps, "spelling-roots")
    return forms.join(steps.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", slips: int | None = None, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased that occur often enough and are long enough.

    ``slips`` plants misspellings to measure by: with h the CRC-32 of '<doc_id>:<word>', where ``slips`` divides h the word loses its
    code point h % length. A null text has no words; a null id counts as an empty one; repeated rows each count."""
    docs, _ = set_aside(docs, *{"_id", "word"} - {doc_id, text})
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_chars},}}+"), F.lit(0))  # whole runs that are long enough
    words = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("word"))
    words = words.select("_id", ascii_lower(F.col("word")).alias("word"))
    if slips:
        words = words.withColumn("h", F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.char_length("word")).cast("int")
        lost = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        words = words.withColumn("word", F.when(F.col("h") % slips == 0, lost).otherwise(F.col("word")))
    counted = words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_times)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = written(word_counts(table(spark, sf_dir, "documents"), slips=199), "spelling-words")
    return with_roots(written(near_forms(words), "spelling-forms")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLES: dict[str, str] = {}
