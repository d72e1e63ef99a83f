"""Language models and limits take all labelled rows, not a sample of them."""

import numpy as np
from pyspark.sql import functions as F

from sensorframe.llm import language_id

WORDS = {"en": "the of and to in that with for was hand", "de": "der und die nicht ein schule über auch"}
KIND = "doc_id bigint, text string, lang string"


def labelled(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[g].split(), 30)), g) for i in range(n) for g in (("en", "de")[i % 2],)]


def weights(model):
    return np.concatenate([w.ravel() for w in (model.inputs, model.state, model.out, model.bias)])


def test_rows_outside_the_first_sample_change_the_model(spark):
    rows = labelled(400)
    docs = spark.createDataFrame(rows, KIND)
    few = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / (1 << 30) < 0.3).collect()}
    held = {r.doc_id for r in docs.where(language_id.is_held_out(F.col("doc_id"))).collect()}
    other = next(i for i, _, _ in rows if i not in few | held)
    changed = [(i, t[::-1] if i == other else t, g) for i, t, g in rows]
    one, same, two = (weights(language_id.train_on(d, per_language=20)) for d in (docs, docs.repartition(7), spark.createDataFrame(changed, KIND)))
    assert np.array_equal(one, same) and not np.array_equal(one, two)


def test_lanes_read_on_from_the_first_network(spark):
    """Words that only rows outside the sample hold are learned."""
    rows = labelled(1200)
    docs = spark.createDataFrame(rows, KIND)
    model = language_id.train_on(docs, per_language=40, dealt=20_000)
    right = docs.join(language_id.predict_languages(docs, model), "doc_id").where("lang = lang_pred").count()
    assert right > 1180


def test_limit_counts_all_held_out_rows(spark):
    rows = labelled(8000)
    docs = spark.createDataFrame(rows, KIND)
    model = language_id.train_on(docs)
    held = docs.where(language_id.is_held_out(F.col("doc_id")))
    scores = sorted(r.score for r in language_id.predict_languages(held, model).collect())
    want = scores[int(0.005 * (len(scores) - 1))]
    assert want - 1.1e-4 < language_id.least_score(docs, model) <= want
