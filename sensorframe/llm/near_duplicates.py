"""N-gram Jaccard join by grouped prefixes, and the components of near-duplicate documents.

A document is its set of word shingles. In one fixed global order of all shingles, two sets of similarity 0.8 or more share a
shingle among the first n - ceil(0.8 n) + 1 of each (the prefix). Documents with an identical prefix and size form one group;
groups, not documents, are joined. Group pairs are filtered by size and by position, expanded to members, filtered by a parity
signature that bounds the difference of two sets from below, and verified on whole sets.

Near copies by the thousand must not become all their pairs. A shingle in at most ``CROWD`` prefixes pairs its groups directly.
Where more meet, every group is compared with two leaders first, components are formed, leaders are chosen once more where groups
are still apart, and only then all pairs that still lie in different components. A pair inside one component can add nothing to
the result; every other candidate pair is verified: no link between different texts is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm._common import bitmap, in_bitmap, join_counted, pieces, small_batches, table, told, written
from sensorframe.llm._grams import ngrams, word_hashes
from sensorframe.llm.components import connected_components

WORDS = 5
PERCENT = 80
SKETCH_BITS = 20  # shingles are counted in 2^20 buckets, whatever the input
SLICES = 64
CROWD = 16  # a shingle that more prefixes hold is joined by leaders first
PARITY_BITS = 1024


def shingle_set(raw: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a UTF-8 text."""
    return np.unique(ngrams(word_hashes(raw), words))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _ids_and_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def _counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many documents' shingles fall into each bucket, over all documents: the global order puts full buckets last.

    The sketch has a fixed size. Tasks send it in slices, which are added up as they stream in.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in pieces(batches, 0):
            for t in batch.column(0):
                np.add.at(n, _bucket(shingle_set(t.as_buffer().to_pybytes(), words)), 1)
        width = next(w for w in (1, 2, 4, 8) if n.max() < 256**w)
        parts = n.astype(f"<u{width}").reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([width] * SLICES, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "width", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, width, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(n, f"<u{width}").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n.tobytes() for n in total.values()], pa.binary())], ["slice", "n"])

    parts = texts.select("text").mapInArrow(count, "slice int, width int, n binary").repartition(SLICES, "slice").mapInArrow(add, "slice int, n binary")
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    for k, n in parts.collect():
        out[k] = np.frombuffer(n, np.int64)
    # a fine logarithmic scale in two bytes, to send with each task
    return np.floor(1500 * np.log2(out.reshape(-1) + 1)).clip(0, 65535).astype(np.uint16)


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of ``PARITY_BITS`` classes of hashes whether a set holds an odd number: bits of two sets differ in no more places
    than the sets have elements that the other lacks."""
    odd = np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _described(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: id, n (set size), whole (digest of the set), g (hash of size and prefix), odd (parities), prefix (hashes in the
    global order)."""
    full = _counts(texts, words)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            sizes, whole, group, odd, prefix = [], [], [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_buffer().to_pybytes(), words)
                keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                p = s[np.argsort(full[_bucket(s)], kind="stable")[:keep]]
                sizes.append(len(s))
                whole.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                group.append(int.from_bytes(hashlib.blake2b(p.tobytes() + len(s).to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True))
                odd.append(parities(s))
                prefix.append(p.view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(group, pa.int64()), pa.array(odd, longs), pa.array(prefix, longs)],
                ["id", "n", "whole", "g", "odd", "prefix"],
            )

    return texts.select("id", "text").mapInArrow(describe, "id bigint, n bigint, whole binary, g bigint, odd array<bigint>, prefix array<bigint>")


def _placed(prefixes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(g, n, pos, t) of the prefixes' shingles that are in the written table ``tokens``, some others among them: a bitmap of fixed
    size drops in the tasks nearly all that a join with ``tokens`` would drop."""
    maybe = bitmap(tokens, "t")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = np.asarray(lists.flatten())
            at = np.flatnonzero(in_bitmap(maybe, flat.view(np.uint64)))
            edges = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            row = np.searchsorted(edges, at, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array((at - edges[row]).astype(np.int32)), pa.array(flat[at])], ["g", "n", "pos", "t"])

    return prefixes.mapInArrow(keep, "g bigint, n bigint, pos int, t bigint")


def _promising(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids that sizes and parities do not rule out: of two sets that are alike at most a share of
    (100 - percent) / (100 + percent) of all their elements are not in both."""
    a, b = (sets.select(F.col("low").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"odd{x}")) for x in "ab")
    apart = sum((F.bit_count(F.get("odda", F.lit(i)).bitwiseXOR(F.get("oddb", F.lit(i)))) for i in range(PARITY_BITS // 64)), F.lit(0))
    near = apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    return pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").where(near).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the written pairs (a, b) of ids those that are alike on whole sets. Only the texts of compared documents move: the
    others are dropped in their tasks, by a bitmap of fixed size, before the joins."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    wanted = bitmap(ids.select(F.xxhash64("id").alias("h")), "h")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(in_bitmap(wanted, batch.column(2).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["id", "text"]).filter(at)

    some = texts.where("id IS NOT NULL").select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(compared, "id bigint, text binary")
    left, right = some.toDF("a", "ta").hint("merge"), some.toDF("b", "tb").hint("merge")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for i in range(batch.num_rows):
                x, y = (shingle_set(batch.column(c)[i].as_buffer().to_pybytes(), words) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(alike, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """Returns (doc_id, n_shingles, component_id), a row per row of ``docs``.

    A null text is empty; an empty set (n_shingles 0) links with nothing. A null id stays a row of its own with a null
    component. Rows that repeat an id are told the components of their own texts, which link by any text of that id. Other columns are not read. An empty table gives
    an empty result. Sets are compared by 64-bit shingle hashes. ``crowd`` decides how candidates are found, not which links are.
    """
    small_batches(docs.sparkSession)
    texts = _ids_and_texts(docs, doc_id, text)
    rows = written(_described(texts, words, percent), "prefixes")
    real = rows.where("n > 0 AND id IS NOT NULL")
    sets = real.groupBy("whole", "g", "n").agg(F.min("id").alias("low"), F.first("odd").alias("odd"))
    sets = written(sets, "sets")  # one row per different set; low stands for it
    heads = written(sets.groupBy("g").agg(F.min("low").alias("head"), F.count("*").alias("members")), "groups")
    prefixes = real.select("g", "n", "prefix")
    fits = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"
    # sets of n and n2 shingles are alike only with an overlap of p / (100 + p) of both; what follows the shared one bounds it
    reaches = f"{100 + percent} * least(n - pos, n2 - pos2) >= {percent} * (n + n2)"
    compared, links = None, None

    def link(pairs: DataFrame, step: str) -> bool:
        """Compares pairs (a, b) of ids that were not compared before and adds what is alike to ``links``."""
        nonlocal compared, links
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti")
        pairs, found = told(_promising(pairs, sets, percent), f"{step}-pairs", F.count(F.lit(1)).alias("rows"))
        compared = pairs if compared is None else compared.union(pairs)
        if links is not None and not found.rows:
            return False
        new, found = told(_verified(pairs, texts, words, percent), f"{step}-links", F.count(F.lit(1)).alias("rows"))
        links = new if links is None else links.union(new)
        return found.rows > 0

    def of_heads(pairs: DataFrame) -> DataFrame:
        a, b = (heads.select(F.col("g").alias(x), F.col("head").alias(y)) for x, y in (("g", "a"), ("g2", "b")))
        return pairs.join(a, "g").join(b, "g2").select("a", "b")

    # shingles in the prefixes of two groups or more; a group is all rows of one size and prefix
    shared = prefixes.select("g", F.explode("prefix").alias("t")).groupBy("t").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("rows"))
    shared, crowds = told(shared.where("g0 <> g1").select("t", "rows"), "shared-shingles", F.sum(F.when(F.col("rows") > crowd, F.col("rows"))).alias("rows"))
    few, many = shared.where(F.col("rows") <= crowd), shared.where(F.col("rows") > crowd)

    # few groups meet: all their pairs
    meet = _placed(prefixes, few).join(few, "t").groupBy("t").agg(F.collect_set(F.struct("g", "n", "pos")).alias("all")).select("all", F.explode("all").alias("one"))
    meet = meet.select("one.g", "one.n", "one.pos", F.explode("all").alias("two")).select("g", "n", "pos", F.col("two.g").alias("g2"), F.col("two.n").alias("n2"), F.col("two.pos").alias("pos2"))
    meet = written(meet.where(f"g < g2 AND {fits} AND {reaches}").select("g", "g2").distinct(), "group-pairs")
    # the members of a group with its head; of two different sets of one size at most n - 1 are in both
    inside = sets.join(heads.where("members > 1"), "g").where(f"low <> head AND 100 * (n - 1) >= {percent} * (n + 1)").select(F.col("head").alias("a"), F.col("low").alias("b"))
    first = of_heads(meet).union(inside)

    crowded = bool(crowds.rows)
    if crowded:  # each group with two leaders
        placed = written(join_counted(_placed(prefixes, many).distinct(), many, ["t"], "rows", F.col("g"), crowds.rows), "crowded-prefixes")
        # the group in which a shingle comes earliest has the fewest rarer ones, so it is the likest to all the others
        first = first.union(of_heads(_led(placed, 0).where(fits).select("g", "g2").distinct()))
    link(first, "first")
    found = written(connected_components(links.toDF("u", "v")), "first-components")

    def of_members() -> DataFrame:
        """Each set with its component so far; written, as the steps below read it several times."""
        out = sets.select("g", "n", "low", "whole").join(found.withColumnRenamed("node", "low"), "low", "left")
        return written(out.select("g", "n", "low", "whole", F.coalesce("component", "low").alias("c")), "members")

    members = of_members()
    if crowded:  # again with other leaders where groups are still apart
        apart = placed.join(members.groupBy("g").agg(F.min("c").alias("c")), "g")
        apart = apart.join(apart.groupBy("t").agg(F.min("c").alias("m0"), F.max("c").alias("m1")).where("m0 <> m1").select("t"), "t")
        if link(of_heads(_led(apart, 1).where(f"c <> c2 AND {fits}").select("g", "g2").distinct()), "again"):
            found = written(connected_components(links.toDF("u", "v")), "again-components")
            members = of_members()

    # what may be alike and is still in different components: pairs of groups and pairs inside a group
    spans = written(members.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")), "spans")
    other = spans.select(F.col("g").alias("g2"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    torn = "NOT (c0 = c1 AND c0 = d0 AND d0 = d1)"
    plural = heads.where("members > 1")
    pairs = meet.join(plural.select("g"), "g").union(meet.join(plural.select(F.col("g").alias("g2")), "g2").select("g", "g2")).join(spans, "g").join(other, "g2").where(torn).select("g", "g2")
    if crowded:
        # sizes of two sets that are alike fall into one class or the next
        size = (F.log("n") / F.lit(-np.log(percent / 100))).cast("int")
        apart = placed.select("t", "g", "n", "pos").join(spans, "g")
        apart = apart.join(apart.groupBy("t").agg(F.min("c0").alias("m0"), F.max("c1").alias("m1")).where("m0 <> m1").select("t"), "t").withColumn("size", size)
        apart = written(apart, "apart-prefixes")
        right = apart.select("t", "size", *(F.col(x).alias(y) for x, y in (("g", "g2"), ("n", "n2"), ("pos", "pos2"), ("c0", "d0"), ("c1", "d1"))))
        left = apart.withColumn("size", F.explode(F.array("size", F.col("size") + 1)))
        pairs = pairs.union(left.join(right, ["t", "size"]).where(f"(n < n2 OR n = n2 AND g < g2) AND {fits} AND {reaches} AND {torn}").select("g", "g2"))
    a, b = (members.select(F.col("g").alias(x), F.col("low").alias(y), F.col("c").alias(z)) for x, y, z in (("g", "a", "ca"), ("g2", "b", "cb")))
    last = pairs.distinct().join(a, "g").join(b, "g2").where("ca <> cb").select("a", "b")
    within = members.where(f"100 * (n - 1) >= {percent} * (n + 1)").join(spans.where("c0 <> c1").select("g"), "g")
    within = within.select("g", F.col("low").alias("a"), F.col("c").alias("ca")).join(within.select("g", F.col("low").alias("b"), F.col("c").alias("cb")), "g")
    if link(last.union(within.where("a < b AND ca <> cb").select("a", "b")), "last"):
        found = connected_components(links.toDF("u", "v"))
        members = of_members()

    out = rows.select("id", "n", "whole").join(members.select("whole", F.col("c").alias("component")), "whole", "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def _led(placed: DataFrame, turn: int) -> DataFrame:
    """Each row of (t, g, n, pos) with the two leaders of its shingle, as g2, n2, pos2 and, after the first turn, c2."""
    carried = ["g", "n", "pos", *(["c"] if turn else [])]
    lead = F.struct((F.lit(0) if turn else F.col("pos")).alias("early"), F.xxhash64("g", F.lit(turn)).alias("h"), *carried)
    leaders = placed.withColumn("h", F.xxhash64("g", F.lit(turn))).groupBy("t").agg(F.min(lead).alias("lo"), F.max_by(lead, "h").alias("hi"), F.count("*").alias("count"))
    leaders, all_of = told(leaders, "leaders", F.sum("count").alias("rows"))
    led = join_counted(placed.select("t", *carried), leaders, ["t"], "count", F.col("g"), all_of.rows or 0)
    led = led.select(*carried, F.explode(F.array("lo", "hi")).alias("lead")).select(*carried, *(F.col(f"lead.{x}").alias(f"{x}2") for x in carried))
    return led.where("g <> g2")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_near_duplicates": op8_near_duplicates}
ORACLES: dict[str, str] = {}
