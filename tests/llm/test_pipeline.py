import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tokenizers

import corpus_pipeline
from sensorframe.llm import language_id
from sensorframe.llm._common import table
from tests.llm.test_operators import ascii_lower, brute_components, smith_waterman


def brute_line_dedup(rows):
    key = lambda s: ascii_lower(s).strip(" \t\n\x0b\x0c\r")
    held = defaultdict(set)
    for d, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 10 and d is not None:
                held[key(s)].add(d)
    out = []
    for d, t in rows:
        kept = [s for s in (t or "").split("\n") if d is None or len(held[key(s)]) < 2 or min(held[key(s)]) == d]
        if kept:
            out.append((d, "\n".join(kept)))
    return out


def brute_contaminated(rows, items):
    plain = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[!-/:-@\[-`{-~]", "", ascii_lower(t or "")))
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    found = set()
    for d, t in rows:
        for i, q in items:
            w, v = plain(t), plain(q)
            if d is not None and i is not None and len(v) >= 5 and grams(w) & grams(v) and smith_waterman(v, w) >= 0.4:
                found.add(d)
    return found


def brute_pipeline(spark, docs, items):
    """The rows of run(), but for places in sequences; the trained network is taken as it is."""
    model = language_id.train_on(docs)
    least = language_id.least_score(docs, model)
    known = language_id.predict_languages(docs.withColumn("doc_id", docs.text), model)  # by text, as ids repeat
    good = {r.doc_id for r in known.collect() if r.lang_pred != "und" and r.score >= least}
    rows = brute_line_dedup([(r.doc_id, r.text) for r in docs.collect() if r.text in good])
    low = brute_components(rows)
    rows = [(d, t) for d, t in rows if d is None or low[d] == d]
    gone = brute_contaminated(rows, items)
    out = Counter()
    encoder = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, t in rows:
        if d not in gone:
            ids = [*encoder.encode(t, add_special_tokens=False).ids, 1]
            for k in range(0, len(ids), 4096):
                part = ids[k : k + 4096]
                out[(d, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    return out


def test_run_against_brute_force(spark, stored):
    docs, items = table(spark, stored, "documents"), [(r.item_id, r.text) for r in table(spark, stored, "benchmark").collect()]
    rows = corpus_pipeline.run(spark, stored).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute_pipeline(spark, docs.select("doc_id", "text", "lang"), items)
    ends = defaultdict(list)
    for r in rows:
        ends[r.sequence_id].append((r.offset, r.length))
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_rows_of_one_id_stay_or_go_together(spark, stored, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (2, text), (2, "other words that are in no other document"), (3, "some row that comes twice"), (3, "some row that comes twice"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, stored).collect())
    assert kept == Counter([rows[0], *rows[3:]])


def test_stages(spark, stored):
    docs = table(spark, stored, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "pack"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, stored)
        assert docs.columns == columns
    assert table(spark, stored, "documents").where("doc_id = 11").count() == 1
    out = corpus_pipeline.run(spark, stored)
    ids = {r.doc_id for r in out.collect()}
    # no letters, nothing left of an exact copy, a near copy, a benchmark passage: gone; clean documents stay
    assert not ids & {1, 2, 3, 4, 5, 7, 8, 16} and {10, 11, 12, 13} <= ids


def test_empty_table(spark, stored, tmp_path):
    table(spark, stored, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, stored, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_rejects_junk_and_an_unlearned_language(spark):
    words = {"en": "the of and to in that with for was hand", "de": "der und die nicht ein schule über auch"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[g].split(), 40)), g) for i in range(800) for g in (("en", "de")[i % 2],)]
    rows += [(1000 + i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(40)), None) for i in range(40)]
    rows += [(2000 + i, " ".join(rng.choice("kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan".split(), 40)), None) for i in range(40)]
    kept = [r.doc_id for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "").collect()]
    own, junk, other = (sum(lo <= i < lo + 1000 for i in kept) for lo in (0, 1000, 2000))
    assert own > 780 and junk < 4 and other < 4
