"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text's bytes are cut into windows of ``WINDOW``; every byte of every window gets a language distribution from a network that
has read the window from both ends, and a document's score is the mean over all its bytes.

Training starts from a network fitted to a bounded number of windows. From there it reads every window of every labelled row once: rows are
dealt to lanes by hash, each lane trains a copy of the network on its own, and the copies' mean is the model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm._common import pieces, small_batches, table

WINDOW = 64
HIDDEN = 8
PER_LANGUAGE = 800  # labelled rows that the first network is fitted to of each language, expected number
WINDOWS_PER_TEXT = 16
STEPS, LANES, RATE = 220, 512, 0.03
DEALT, POOL, SIDE, LATER_RATE = 4 << 20, 1 << 16, 1024, 0.003  # bytes of a lane's rows, windows that it mixes at a time and reads at once, its first rate
FIXED = 1 << 24  # weights are added up as whole multiples of 1 / FIXED, in any order alike
RUN = 2048  # windows that are read side by side
LEAST = 0.3  # a document whose best language has less is rejected by a filter, where too few rows tell a better limit
BINS = 10_000  # a score is told by which of so many equal parts it lies in
LOWEST, TELLING = 0.005, 100  # the limit is what this share of labelled rows that training never read stay under, of so many at least
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str]
    inputs: np.ndarray  # (2, 3 H, 256): what each byte adds to the gates, by direction
    state: np.ndarray  # (2, 3 H, H)
    out: np.ndarray  # (languages, 2 H)
    bias: np.ndarray  # (languages, 1)


def _soft(u: np.ndarray) -> np.ndarray:
    """u / (1 + |u|): the squashing function; half of it plus a half serves as the gates' sigmoid."""
    return u / (1 + np.abs(u))


@lru_cache(maxsize=2)
def _room(steps: int, size: int, lanes: int, kind: np.dtype) -> np.ndarray:
    """Memory for one reading at a time: fresh memory for each would cost more than the arithmetic."""
    return np.empty((steps, 2, 6 * size, lanes), kind)


def read_windows(model: Model, x: np.ndarray, valid: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
    """States (2 H, steps, lanes) of both directions for bytes ``x`` (steps, lanes). ``valid`` holds the state at zero on padding
    and ``keep`` gathers what backpropagation needs."""
    steps, lanes = x.shape
    size = model.state.shape[2]
    kind = model.state.dtype
    states = np.empty((2, size, steps, lanes), kind)
    h = np.zeros((2, size, lanes), kind)
    gates = np.empty((2, 3 * size, lanes), kind)
    room = _room(1 if keep is None else steps, size, lanes, kind)
    for t in range(steps):
        at = (t, steps - 1 - t)
        for d in (0, 1):
            np.take(model.inputs[d], x[at[d]], axis=1, out=gates[d], mode="clip")
        own = room[0 if keep is None else t]
        a, zr, n = own[:, : 3 * size], own[:, 3 * size : 5 * size], own[:, 5 * size :]
        np.matmul(model.state, h, out=a)
        np.add(gates[:, : 2 * size], a[:, : 2 * size], out=zr)
        den = np.abs(zr)
        den += 1
        zr /= den
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :size], zr[:, size:]
        np.multiply(r, a[:, 2 * size :], out=n)
        n += gates[:, 2 * size :]
        den = np.abs(n)
        den += 1
        n /= den
        new = h - n
        new *= z
        new += n
        if valid is not None:
            for d in (0, 1):
                new[d] *= valid[at[d]]
        if keep is not None:
            keep.append((h, z, r, n, a[:, 2 * size :]))
        h = new
        for d in (0, 1):
            states[d, :, at[d]] = h[d]
    return states.reshape(2 * size, steps, lanes)


def _distribution(model: Model, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (languages, steps, lanes) of every position, and whether each language is its label."""
    scores = (model.out @ states.reshape(len(states), -1) + model.bias).reshape(-1, *states.shape[1:])
    top = scores.max(0)
    label = scores == top
    scores -= top
    np.exp(scores, out=scores)
    scores /= scores.sum(0)
    return scores, label


def loss(model: Model, x: np.ndarray, valid: np.ndarray, y: np.ndarray) -> float:
    """Mean cross-entropy of the valid positions of windows ``x`` (steps, lanes), all of which have their lane's target ``y``."""
    p, _ = _distribution(model, read_windows(model, x, valid))
    return float(-(np.log(p[y, :, np.arange(len(y))].T) * valid).sum() / valid.sum())


def gradients(model: Model, x: np.ndarray, valid: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> list[np.ndarray]:
    """Derivatives of ``loss`` for inputs, state, out and bias, by backpropagation through time; ``weight`` weighs the lanes' positions in the mean."""
    h, k, steps, kind = model.state.shape[2], len(model.languages), len(x), model.state.dtype
    kept: list = []
    states = read_windows(model, x, valid, kept)
    wrong, _ = _distribution(model, states)
    wrong[y, :, np.arange(len(y))] -= 1
    share = valid if weight is None else valid * weight
    wrong *= share / share.sum()
    flat = wrong.reshape(k, -1)
    grads = [np.zeros_like(w) for w in (model.inputs, model.state, model.out, model.bias)]
    grads[2] = flat @ states.reshape(2 * h, -1).T
    grads[3] = flat.sum(1, keepdims=True)
    from_out = (model.out.T @ flat).reshape(2, h, *x.shape)
    held, place = np.unique(x, return_inverse=True)  # few bytes are in use: sums by byte are products with a mark of each
    marks = np.eye(len(held), dtype=kind)[place.reshape(x.shape)]
    by_byte, later, back = np.zeros((2, 3 * h, len(held)), kind), np.zeros((2, h, x.shape[1]), model.state.dtype), model.state.transpose(0, 2, 1).copy()
    da, into = np.empty((2, 3 * h, x.shape[1]), kind), np.empty((2, 3 * h, x.shape[1]), kind)
    for t in reversed(range(steps)):
        before, z, r, n, an = kept.pop()
        at = (t, steps - 1 - t)
        dh = later
        for d in (0, 1):
            dh[d] += from_out[d, :, at[d]]
            dh[d] *= valid[at[d]]
        u = np.abs(n)
        u -= 1
        u *= u
        u *= 1 - z
        dn = np.multiply(dh, u, out=into[:, 2 * h :])
        for gate, inner, slope in ((z, before - n, dh), (r, an, dn)):
            u = gate * 2
            u -= 1
            np.abs(u, out=u)
            u -= 1
            u *= u
            u *= inner
            u *= slope
            u *= 0.5
            part = slice(0, h) if gate is z else slice(h, 2 * h)
            into[:, part] = da[:, part] = u
        np.multiply(dn, r, out=da[:, 2 * h :])
        grads[1] += np.matmul(da, before.transpose(0, 2, 1))
        dh *= z
        later = np.matmul(back, da)
        later += dh
        for d in (0, 1):
            by_byte[d] += into[d] @ marks[at[d]]
    grads[0][:, :, held] = by_byte
    return grads


def train(windows: list[bytes], languages: list[str], seed: int = 7) -> Model:
    """Fits the network by backpropagation through time with Adam. Every position of a window has its text's language as target."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    h, k = HIDDEN, len(names)
    draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    model = Model(names, draw(2, 3 * h, 256), draw(2, 3 * h, h), draw(k, 2 * h), np.zeros((k, 1), np.float32))
    if k < 2:
        return model
    x_all = np.zeros((len(windows), WINDOW), np.uint8)
    v_all = np.zeros((len(windows), WINDOW), np.float32)
    for i, w in enumerate(windows):
        x_all[i, : len(w)] = np.frombuffer(w, np.uint8)
        v_all[i, : len(w)] = 1
    y_all = np.array([names.index(x) for x in languages])
    of = [np.flatnonzero(y_all == i) for i in range(k)]
    adam = _adam(model)
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(of[i], LANES // k) for i in range(k)])
        x, valid, y = x_all[pick].T.copy(), v_all[pick].T.copy(), y_all[pick]
        adam(gradients(model, x, valid, y), RATE * min(1, 2 * (1 - step / (STEPS + 1))))
    return model


def _weights(model: Model) -> list[np.ndarray]:
    return [model.inputs, model.state, model.out, model.bias]


def _adam(model: Model) -> Callable[[list[np.ndarray], float], None]:
    """A function of gradients and rate that moves the model's weights."""
    weights, step = _weights(model), 0
    first, second = ([np.zeros_like(w) for w in weights] for _ in (0, 1))

    def move(grads: list[np.ndarray], rate: float) -> None:
        nonlocal step
        step += 1
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    return move


def _flat(model: Model) -> np.ndarray:
    return np.concatenate([w.ravel() for w in _weights(model)])


def _shaped(names: list[str], flat: np.ndarray) -> Model:
    h, k, out, at = HIDDEN, len(names), [], 0
    for shape in ((2, 3 * h, 256), (2, 3 * h, h), (k, 2 * h), (k, 1)):
        out.append(flat[at : at + int(np.prod(shape))].reshape(shape).astype(np.float32))
        at += int(np.prod(shape))
    return Model(names, *out)


def is_held_out(doc_id: Column) -> Column:
    """Rows that training never reads."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_on(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, dealt: int = DEALT) -> Model:
    """Trains on all labelled rows that are not held out. A first network is fitted, in one task, to ``per_language`` rows of each language
    in expectation, taken by hash, of each up to ``WINDOWS_PER_TEXT`` windows. From it :func:`_all_read` reads every window of every
    row. Null texts, languages and ids are no labelled rows; without any the model knows no language."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~is_held_out(F.col("id")))
    sizes = own.groupBy("lang").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).collect()  # a row per language
    if not sizes:
        return Model([], *(np.zeros((0,), np.float32) for _ in range(4)))
    own = own.where(F.col("text").isNotNull())
    first = _first(own, {r.lang: min(1.0, per_language / r.n) for r in sizes})
    if len(first.languages) < 2:
        return first
    return _all_read(own.where(F.col("lang").isin(first.languages)), first, {r.lang: r.bytes for r in sizes}, dealt)


def _first(own: DataFrame, rates: dict[str, float]) -> Model:
    share = F.element_at(F.create_map(*(F.lit(v) for pair in rates.items() for v in pair)), F.col("lang"))
    some = own.where(F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 30)) / (1 << 30) < share)
    room = F.greatest(F.char_length("text") - WINDOW, F.lit(1))
    spans = F.transform(F.sequence(F.lit(1), F.lit(WINDOWS_PER_TEXT)), lambda k: F.substring(F.col("text"), (F.pmod(F.xxhash64("text", k), room) + 1).cast("int"), F.lit(WINDOW)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((lang, w) for batch in batches for lang, w in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        windows = [(w.encode().lower()[:WINDOW], lang) for lang, all_of in got for w in all_of if w]
        model = train([w for w, _ in windows], [x for _, x in windows])
        yield pa.RecordBatch.from_arrays([pa.array([model.languages], pa.list_(pa.string())), pa.array([_flat(model).tobytes()], pa.binary())], ["names", "weights"])

    # a bounded number of rows, whatever the table
    row = some.select("lang", F.array_distinct(spans).alias("w")).repartition(1).mapInArrow(fit, "names array<string>, weights binary").first()
    return _shaped(list(row.names), np.frombuffer(row.weights, np.float32)) if row else Model([], *(np.zeros((0,), np.float32) for _ in range(4)))


def _all_read(own: DataFrame, model: Model, sizes: dict[str, int], dealt: int) -> Model:
    """The mean of copies of ``model`` that each trained on the rows of one lane, all windows once, weighted by their steps.

    A lane has about ``dealt`` bytes of text, so there are as many as the rows need; which rows it gets and in which order depends on
    hashes of the rows alone, not on splits. Languages weigh the same whatever their share of the bytes. A task holds ``POOL``
    windows and the weights; a number per weight comes to the driver."""
    lanes, names = -(-sum(sizes.values()) // dealt) or 1, model.languages
    even = np.array([sum(sizes.values()) / max(1, sizes[x]) for x in names], np.float32)
    rows = own.select(F.pmod(F.xxhash64("id", "lang", "text"), F.lit(lanes)).alias("lane"), "lang", "text", F.xxhash64(F.lit("order"), "id", "lang", "text").alias("h"))
    parts = min(lanes, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "lane").sortWithinPartitions("lane", "h", "text", "lang").select("lane", "lang", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now, pool = np.zeros(len(_flat(model)) + 1, np.int64), None, []
        copy = rng = None

        def read() -> int:
            """Trains the lane's copy on the pool in a random order."""
            x, size, y = (np.concatenate(c) for c in zip(*pool, strict=True))
            order = rng.permutation(len(x))
            steps = -(-len(x) // SIDE)
            adam = _adam(copy)
            for i in range(steps):
                pick = order[i * SIDE : (i + 1) * SIDE]
                valid = (np.arange(WINDOW)[:, None] < size[pick]).astype(np.float32)
                adam(gradients(copy, x[pick].T.copy(), valid, y[pick], even[y[pick]]), LATER_RATE * (1 - i / steps))
            pool.clear()
            return steps

        def end(steps: int) -> None:
            if pool:
                steps += read()
            total[:-1] += np.round(_flat(copy).astype(np.float64) * FIXED).astype(np.int64) * steps
            total[-1] += steps

        held = steps = 0
        for batch in pieces(batches, 2):
            for lane, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lane != now:
                    if now is not None:
                        end(steps)
                    now, held, steps, copy, rng = lane, 0, 0, _shaped(names, _flat(model)), np.random.default_rng(lane)
                raw = text.encode().lower()
                n = -(-len(raw) // WINDOW)
                if n:
                    pool.append((np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW), np.minimum(WINDOW, len(raw) - WINDOW * np.arange(n)), np.full(n, names.index(lang))))
                    held += n
                if held >= POOL:
                    held, steps = 0, steps + read()
        if now is not None:
            end(steps)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["slot", "total"])

    sums = rows.mapInArrow(learn, "slot int, total bigint").groupBy("slot").agg(F.sum("total").alias("total")).toArrow().sort_by("slot")
    sums = sums.column("total").to_numpy()
    return _shaped(names, sums[:-1] / (sums[-1] * FIXED)) if len(sums) and sums[-1] else model


def score_texts(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Mean probability and number of labelled positions (texts, languages) of each text; zeros for empty ones."""
    k = len(model.languages)
    mean, labels = np.zeros((len(texts), k)), np.zeros((len(texts), k), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum() or not k:
        return mean, labels
    whole = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    per = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(texts)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = begins[doc] + nth * WINDOW
    length = np.minimum(WINDOW, sizes[doc] - nth * WINDOW)
    step = np.arange(WINDOW)[:, None]
    for rows in (np.flatnonzero(length == WINDOW), np.flatnonzero(length < WINDOW)):
        for i in range(0, len(rows), RUN):
            own = rows[i : i + RUN]
            valid = None if length[own[0]] == WINDOW else (step < length[own]).astype(np.float32)
            p, label = _distribution(model, read_windows(model, whole[start[own] + step], valid))
            if valid is not None:
                p *= valid
                label = label & (valid > 0)
            for j in range(k):
                mean[:, j] += np.bincount(doc[own], p[j].sum(0), len(texts))
                labels[:, j] += np.bincount(doc[own], label[j].sum(0), len(texts)).astype(np.int64)
    return mean / np.maximum(sizes, 1)[:, None], labels


def predict_languages(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, positions) per row: the language of the largest mean probability (ties: the first by name), that
    probability, and a map from language to the number of bytes labelled with it.

    A text that is null or has no letter is ``und`` with score 0. A null id stays null; repeated rows each give a row; other
    columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    only = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = only.schema["_id"].dataType.simpleString()
    names = model.languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            texts = [t.as_py() for t in batch.column(1)]
            mean, labels = score_texts(model, [t.encode().lower() for t in texts])
            best = mean.argmax(1) if names else np.zeros(len(texts), int)
            known = [bool(names) and _LETTER.search(t) is not None for t in texts]
            score = [min(1.0, float(mean[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, known, strict=True))]
            pred = [names[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
            counts = [[(n, int(c)) for n, c in zip(names, row, strict=True)] for row in labels]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(counts, pa.map_(pa.string(), pa.int64()))],
                ["_id", "lang_pred", "score", "positions"],
            )

    return only.mapInArrow(predict, f"_id {kind}, lang_pred string, score double, positions map<string,bigint>").withColumnRenamed("_id", doc_id)


def keep_known(docs: DataFrame, model: Model, *, text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is not ``und`` and scores ``least`` or more. A model without
    languages keeps every text that has a letter."""
    small_batches(docs.sparkSession)
    at, names = docs.columns.index(text), model.languages

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            texts = [t.as_py() or "" for t in batch.column(at)]
            score = score_texts(model, [t.encode().lower() for t in texts])[0].max(1) if names else np.ones(len(texts))
            yield batch.filter(pa.array([s >= least and _LETTER.search(t) is not None for s, t in zip(score, texts, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def least_score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> float:
    """The score that all but a share ``LOWEST`` of the held-out labelled rows reach: all those of the model's languages that have a
    letter. It is told to 1 / ``BINS`` from how many rows lie in each part. It follows the number of languages and how well they part. A
    model of fewer than two languages gives every text the same score, so its limit is 0; with fewer than ``TELLING`` rows it is
    ``LEAST``."""
    if len(model.languages) < 2:
        return 0.0
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    own = own.where(F.col("lang").isin(model.languages) & is_held_out(F.col("id")))
    known = predict_languages(own, model, doc_id="id").where(F.col("lang_pred") != UNKNOWN)
    parts = sorted(known.groupBy(F.floor(F.col("score") * BINS)).count().collect())  # at most BINS + 1 rows
    n = sum(c for _, c in parts)
    if n < TELLING:
        return LEAST
    before = np.cumsum([c for _, c in parts])
    at = parts[int(np.searchsorted(before, int(LOWEST * (n - 1)), "right"))][0]
    return at / BINS - 1e-6  # sums differ in the last digits with the texts read side by side


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict_languages(docs, train_on(docs))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
