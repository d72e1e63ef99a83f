"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sensorframe.llm import chat_format, decontaminate, fingerprints, language_id, line_dedup, near_duplicates, packing, quality, secrets, warc
from sensorframe.llm._grams import ngrams, word_hashes
from sensorframe.llm.components import connected_components
from tests.llm.conftest import EN, documents

ROWS = [(d, t) for d, t, *_ in documents()]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def shingles(text, n=5):
    w = WORD.findall(ascii_lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fingerprints(spark, stored):
    rows = fingerprints.op1_fingerprints(spark, stored).collect()
    assert len(rows) == len(ROWS)
    ordered = sorted(((d is not None, d or 0, t or "") for d, t in ROWS), key=lambda r: (-r[0], -r[1], r[2]))
    want = Counter()
    for (ok, d, t), (_, _, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        want[(d if ok else None, len(t), sha(t[: len(t) - half] + after[:half]))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[3].fingerprint == "" == by_id[5].fingerprint
    assert all(0 <= v <= 1 for r in rows for v in (r.near_edited, r.near_next))


def test_fingerprint_likeness_estimates_jaccard(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0) * 6:
        a = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        b = a[: int(400 * share)] + [f"v{x}" for x in rng.integers(0, 10**6, 400 - int(400 * share))]
        pairs.append((" ".join(a), " ".join(b)))
    df = fingerprints.fingerprint(fingerprints.fingerprint(spark.createDataFrame(pairs, "a string, b string"), "a", "fa"), "b", "fb")
    got = df.select("a", "b", fingerprints.likeness(F.col("fa"), F.col("fb")).alias("s")).collect()
    errors = [r.s - len(shingles(r.a) & shingles(r.b)) / len(shingles(r.a) | shingles(r.b)) for r in got]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def spark_hash(*values):
    """The chained 64-bit hash of numpy ints of 4 or 8 bytes and of strings, as a signed number."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.tobytes(), h)
    return int(np.uint64(h).astype(np.int64))


def brute_fingerprint(text):
    """A hexadecimal digit per bin, with one loop for everything."""
    low = (text or "").lower()
    words = [np.int64(spark_hash(w)) for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return ""
    grams = [spark_hash(*words[i : i + 5]) | 1 for i in range(len(words) - 4)] or [spark_hash(*words) | 1]
    bins = [min((g for g in grams if g >> 56 == b), default=None) for b in range(-128, 128)]
    out = ""
    for b, value in enumerate(bins):
        if value is None:
            probes = [bins[spark_hash(np.int32(b), np.int32(t)) % 256] for t in range(fingerprints.PROBES)]
            rest = [min((spark_hash(np.int32(j), np.int32(b)), v) for j, v in enumerate(bins) if v is not None)[1]]
            value = spark_hash(np.int64(next(v for v in probes + rest if v is not None)), np.int32(b))
        out += f"{value >> 1 & 15:x}"
    return out


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    agree = sum(x == y for x, y in zip(a, b, strict=True)) / 256
    return max(0.0, (agree - 1 / 16) / (15 / 16))


def test_fingerprints_against_brute_force(spark, stored):
    rows = sorted(((d, t or "") for d, t in ROWS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        f = [brute_fingerprint(x) for x in (t, e, after)]
        want[(d, len(t), sha(e), f[0], f[1], round(brute_likeness(f[0], f[1]), 9), round(brute_likeness(f[0], f[2]), 9))] += 1
    got = Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, fingerprints.op1_fingerprints(spark, stored).collect()))
    assert got == want


def test_columns_of_the_caller_stay(spark):
    own = spark.createDataFrame([(1, "a line of some words\nb", 7, 8, 9, 10), (2, "a line of some words", 7, 8, 9, 10)], "doc_id int, text string, _bins int, _lines int, _id int, _salt int")
    for out in (fingerprints.fingerprint(own, "text", "fp"), line_dedup.dedup_lines(own), fingerprints.with_next(own, "doc_id", "text", ["text"])):
        assert {tuple(r) for r in out.select("_bins", "_lines", "_id", "_salt").collect()} == {(7, 8, 9, 10)}
    assert line_dedup.dedup_lines(own).agg(F.sum("n_dropped")).first()[0] == 1


def test_fingerprints_of_nothing(spark, empty):
    out = fingerprints.with_next(empty.select("doc_id", "text"), "doc_id", "text", ["text"])
    assert out.count() == 0


def test_secrets(docs, empty):
    got = defaultdict(list)
    for r in secrets.find_secrets(docs).collect():
        got[r.doc_id].append([(s.kind, s.start, s.end) for s in r.spans])
    assign = re.compile(rf"({secrets._WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for d, t in ROWS:
        t = t or ""
        want = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(want, key=lambda s: s[1]) in got[d]
    assert len(got[13]) == 2 and len(got[13][0]) == 3
    assert secrets.find_secrets(empty).count() == 0


def test_secret_checksums():
    words = secrets._automaton()
    body = "a1B2" * 7 + "xy"
    right = f"ghp_{body}{secrets.crc_base62(body.encode())}"
    wrong = f"ghp_{body}000000"
    text = f"é {right} {wrong} eyJhbGciOiJIUzI1NiJ9.e30.abc eyJxxxx.e30.abc"
    found = secrets.scan_text(text.encode(), words)
    assert [k for k, *_ in found] == ["github", "jwt"] and text[found[0][1] : found[0][2]] == right
    edge = "AKIA" + "A" * 16
    assert secrets.scan_text((edge + "AKIA" * 5).encode(), words) == [("access", 0, 40)]
    for n in range(20, 60):
        for shift in range(5):
            assert [s[0] for s in secrets.scan_text(b"z" * shift + b"a" * n + b"z", words)] == ["hex"] * (n >= 24)


def test_hex_runs_after_any_prefix():
    words = secrets._automaton()
    assert secrets.scan_text(b"zzza" + b"z" + b"0" * 24 + b"z", words) == [("hex", 5, 29)]
    rng = np.random.default_rng(5)
    texts = [f"{'z' * shift}{name}: {'0f' * (n // 2)}" for shift in range(8) for name in ("md5", "sha256") for n in (22, 24, 32, 64)]
    for _ in range(5000):
        parts = [("".join(rng.choice(list("abc019 :=z"), rng.integers(0, 40))), "".join(rng.choice(list("0a9f"), rng.integers(18, 40)))) for _ in range(rng.integers(1, 4))]
        texts.append("".join(a + b for a, b in parts) + "z" * int(rng.integers(0, 5)))
    for t in texts:
        got = [s for s in secrets.scan_text(t.encode(), words) if s[0] == "hex"]
        assert got == [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24], t


def test_chat_format(spark, stored):
    rows = {r.conv_id: r for r in chat_format.op3_chat_format(spark, stored).collect()}
    said = "x\n"
    assert rows[1].n_turns == 4 and rows[1].turns_sha256 == sha("\n" + said + "user\nhi\n" + "assistant\n\n" + "assistant\na\\<|im_end|>b\n")
    assert rows[1].loss_sha256 == sha("a\\<|im_end|>b") and rows[None].loss_chars == 4 and rows[2].n_turns == 1
    assert rows[-1].loss_sha256 == sha("</s>[INST] ok [/INST]")


def test_chat_parts(spark):
    part = f"conv_id int, turn int, role string, content array<{chat_format.PART}>"
    content = [("text", "see <|image|> ", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", None), ("video", "no", "c", 1), ("document", None, "d.pdf", 3)]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None)], part)
    row = chat_format.format_chats(df).first()
    assert [(a.type, a.ref, a.tokens) for a in row.attachments] == [("image", "a.png", 512), ("audio", "b.wav", 25), ("document", "d.pdf", 1536)]
    assert row.attachment_tokens == 2073 and row.formatted.count("<|image|>") == 1 and "<\\|image|>" in row.formatted
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_packing_is_exact(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t in ROWS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[(d, k // 4096, k, len(part), zlib.crc32(part.tobytes()))] += 1
    rows = packing.pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = [9, 30, 4096][seed % 3]
    counts = Counter(rng.integers(1, capacity + 1, rng.integers(1, 300)).tolist())
    fill, used = defaultdict(int), Counter()
    for n, rank, k, first, each, offset in packing.plan_packing(counts, capacity):
        assert rank == used[n]
        used[n] += k
        for i in range(k):
            fill[first + i // each] = max(fill[first + i // each], offset + (i % each + 1) * n)
    assert used == counts and max(fill.values()) <= capacity
    assert len(fill) <= 1 + 11 / 9 * -(-sum(n * c for n, c in counts.items()) // capacity) + sum(c for n, c in counts.items() if 2 * n > capacity)


def test_encoder_cuts_as_the_tokenizer():
    encoder = packing._Encoder(packing.public_tokenizers.path("word_bpe_49k.json"))
    odd = ["It's <|endoftext|> ok", "don't 12½ ÉÊ İx ŉ", "a b\x1cc\x85d", "Σας ΣΑΣ", "x" * 300, "  ", "...!!!'s", "ñ é", "A²B ªº µ", "Ǆ", ""]
    assert encoder.encode(odd) == [encoder._whole(t) for t in odd]


def test_warc(spark, stored):
    rows = warc.op5_warc(spark, stored).collect()
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows)
    html = "<p>" + "x" * 1200
    n = len(html)
    assert got == Counter({(1, n, "revisit", 2): 1, (2, n, "response", None): 1, (3, 5, "response", None): 1, (4, 5, "response", None): 1, (5, 0, "response", None): 2, (None, n, "response", None): 1, (6, 18000, "response", None): 1})
    assert {r.payload_digest for r in rows if r.payload_bytes == n} == {hashlib.sha1(html.encode()).hexdigest()}


def test_warc_pushdown(spark, stored, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.records_of(spark.read.parquet(f"{stored}/pages.parquet")), path)
    reader = warc.WarcReader(path, True)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 5)]))
    assert len(left) == 1 and len(reader.wanted) == 1
    rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert [r["record_id"] for r in rows] == ["urn:page:1"] and rows[0]["payload"] is None
    assert warc.read_warc(spark, path).where("target_uri LIKE 'http://e%'").count() == 2
    assert warc.read_warc(spark, path, payload=False).where("payload IS NOT NULL").count() == 0


def archive(rows, line="\r\n"):
    """Records as other writers make them: bare, with odd cases of header names."""
    out = []
    for kind, name, digest, block, http in rows:
        head = ["WARC/1.0", f"warc-type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-PAYLOAD-DIGEST: sha1:{digest}", f"content-length:{len(block)}"]
        head += ["Content-Type: application/http; msgtype=response"] if http else []
        out.append((line.join(head) + line * 2).encode() + block + b"\r\n\r\n")
    return out


def test_archives_of_other_writers(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\ncontent-length: 3\r\n\r\n" + b"x\r\n" * 40000
    digest = base64.b32encode(hashlib.sha1(b"p").digest()).decode()
    records = archive([("warcinfo", "urn:i", "-", b"software: x\r\n", False), ("response", "urn:a", digest, page, True), ("revisit", "urn:b", digest, b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n", True), ("resource", "urn:c", "00", b"", False)])
    (tmp_path / "bare.warc").write_bytes(b"".join(records))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "mixed.warc.gz").write_bytes(warc._member(records[0]) + b"".join(map(gzip.compress, records[1:])))
    got = Counter((r.record_type, r.record_id, r.payload_bytes, r.payload and bytes(r.payload), r.payload_digest) for r in warc.read_warc(spark, str(tmp_path)).collect())
    hexed = hashlib.sha1(b"p").hexdigest()
    want = [("warcinfo", "urn:i", 13, b"software: x\r\n", "-"), ("response", "urn:a", 120000, b"x\r\n" * 40000, hexed), ("revisit", "urn:b", 9, None, hexed), ("resource", "urn:c", 0, b"", "00")]
    assert got == Counter({(k, i, n, p, d): 4 for k, i, n, p, d in want})
    assert warc.read_warc(spark, str(tmp_path), payload=False).where("record_id LIKE 'urn:a%' AND payload_bytes = 120000 AND payload IS NULL").count() == 4
    (tmp_path / "bare.warc").write_bytes(b"no archive")
    with pytest.raises(Exception, match="no archive record"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_files_of_lost_tasks_go(tmp_path):
    writer = warc.WarcWriter(str(tmp_path))
    row = {"record_type": "response", "record_id": "urn:1", "target_uri": None, "date": "d", "payload_digest": "", "payload_bytes": 1, "refers_to": None, "payload": b"x"}
    batch = [warc.pa.RecordBatch.from_pylist([row])]
    writer.write(iter(batch))  # its message is lost
    writer.commit([writer.write(iter(batch))])
    assert [p.name[0] != "." for p in tmp_path.iterdir()] == [True]
    writer.write(iter(batch))
    writer.abort([None])
    assert len(list(tmp_path.iterdir())) == 1


def test_language_id(spark, docs, empty, stored):
    words = {"en": "the of and to in that with for was hand", "de": "der und die nicht ein schule über auch"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[g].split(), 40)), g) for i in range(300) for g in (("en", "de")[i % 2],)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train_on(table)
    held = table.join(language_id.predict_languages(table, model), "doc_id").where(language_id.is_held_out(F.col("doc_id")))
    assert held.where("lang <> lang_pred").count() == 0 and held.count() > 30
    out = defaultdict(list)
    for r in language_id.predict_languages(docs, model).collect():
        out[r.doc_id].append(r)
    assert all(out[d][0].lang_pred == "und" and out[d][0].score == 0 for d in (3, 4, 5, 16))
    assert out[12][0].lang_pred == "de" and out[6][0].lang_pred == "en" and len(out[13]) == 2
    assert sum(out[12][0].positions.values()) == len(ROWS[11][1].encode())
    assert language_id.predict_languages(empty, model).count() == 0
    none = language_id.train_on(empty)
    assert language_id.predict_languages(docs, none).where("lang_pred <> 'und'").count() == 0
    assert language_id.keep_known(docs, model).columns == docs.columns
    assert language_id.op6_language_id(spark, stored).count() == len(ROWS)


def test_gradient_of_the_network():
    """Backpropagation against finite differences of the loss, on windows of different lengths."""
    rng = np.random.default_rng(1)
    m = language_id.Model(["a", "b", "c"], *(rng.normal(0, 0.5, s) for s in ((2, 24, 256), (2, 24, 8), (3, 16), (3, 1))))
    x = rng.integers(97, 103, (7, 5)).astype(np.uint8)
    valid = (np.arange(7)[:, None] < np.array([7, 7, 3, 1, 5])).astype(np.float64)
    y = np.array([0, 1, 2, 0, 1])
    p, label = language_id._distribution(m, language_id.read_windows(m, x))
    assert np.allclose(p.sum(0), 1, atol=1e-9) and (label.sum(0) == 1).all()
    for w, g in zip((m.inputs, m.state, m.out, m.bias), language_id.gradients(m, x, valid, y), strict=True):
        flat, got = w.reshape(-1), g.reshape(-1)
        # bytes that do not occur have no gradient; of the others some entries
        for i in rng.choice(np.flatnonzero(got), min(40, np.count_nonzero(got)), replace=False):
            was, e = flat[i], 1e-6
            flat[i] = was + e
            up = language_id.loss(m, x, valid, y)
            flat[i] = was - e
            down = language_id.loss(m, x, valid, y)
            flat[i] = was
            assert abs((up - down) / (2 * e) - got[i]) < 1e-6


def test_held_out_accuracy(spark):
    """On rows of the given documents that training never reads."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.op6_language_id(spark, "/root/testdata/sf0.01").where("held_out AND lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    n, right = held.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right >= 0.97 * n


def test_line_dedup(spark, docs, empty, stored):
    key = lambda s: ascii_lower(s).strip(" \t\n\x0b\x0c\r")
    held = defaultdict(set)
    for d, t in ROWS:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 10 and d is not None:
                held[key(s)].add(d)
    want = Counter()
    for d, t in ROWS:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (d is not None and len(held[key(s)]) >= 2 and min(held[key(s)]) != d)]
        want[(d, len(lines), len(lines) - len(kept), sha("\n".join(kept)))] += 1
    assert Counter(map(tuple, line_dedup.op7_line_dedup(spark, stored).collect())) == want
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs, min_docs=3).where("n_dropped > 0").count() == 0


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    low = {d: d for d, _ in sets}
    changed = True
    links = [(a, b) for a, x in sets for b, y in sets if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_near_duplicates(docs, empty):
    got = Counter(map(tuple, near_duplicates.near_duplicates(docs).collect()))
    low = brute_components(ROWS)
    assert got == Counter((d, len(shingles(t)), low[d] if d is not None else None) for d, t in ROWS)
    assert near_duplicates.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowd", [2, 16])
def test_near_duplicates_of_chains(spark, crowd):
    """Families of edited copies whose ends are unlike, with a passage that all share, and short texts that share all but a word."""
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for family in range(12):
        base = [f"f{family}w{i}" for i in rng.integers(0, 10**6, 120)]
        for step in range(6):
            rows.append((len(rows), " ".join(base + common)))
            base[rng.integers(0, 120)] = f"e{len(rows)}"
            base[rng.integers(0, 120)] = f"g{len(rows)}"
    for i in range(20):  # sets of 4 and 5, of 9 with one other, and of one shingle
        rows += [(len(rows), " ".join(common[i : i + 8 + i % 2])), (len(rows) + 1, " ".join([*common[:13], f"z{i % 3}", *common[14 : 14 + i % 7]])), (len(rows) + 2, f"one {i % 4}")]
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), crowd=crowd).collect()}
    assert got == brute_components(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    from sensorframe.llm import _grams

    text = (EN + "\n").encode() * 50
    whole = word_hashes(text)
    monkeypatch.setattr(_grams, "_BLOCK", 64)
    assert (word_hashes(text) == whole).all() and len(whole) == len(text.split())
    assert len(ngrams(whole[:3], 5)) == 1 and len(ngrams(whole[:0], 5)) == 0


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(a))


def test_alignment():
    rng = np.random.default_rng(2)
    a = [rng.integers(0, 9, n).astype(np.uint64) for n in (5, 12, 30, 7)]
    b = [rng.integers(0, 9, n).astype(np.uint64) for n in (40, 3, 25, 60)]
    assert np.allclose(decontaminate.align(a, b)[0], [smith_waterman(x, y) for x, y in zip(a, b)])


def test_decontamination(spark, docs, empty, stored):
    rng = np.random.default_rng(4)
    noise = lambda n: [f"n{x}" for x in rng.integers(0, 10**6, n)]
    items = [(i, noise(40)) for i in range(8)]
    rows, want = [], set()
    for i, words in items:
        for edits in (0, 4, 8):
            copy = list(words)
            for at in rng.choice(40, edits, replace=False):
                copy[at] = "changed"
            want.add((len(rows), i))
            rows.append((len(rows), " ".join(noise(200) + copy + noise(100)).upper().replace("N", "n") if edits == 0 else " ".join(noise(50) + copy)))
        rows.append((len(rows), " ".join(noise(100) + words[:4] + noise(100))))
    rows += [(1000 + i, " ".join(items[0][1])) for i in range(60)]
    want |= {(1000 + i, 0) for i in range(60)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.op9_benchmark_decontamination(spark, stored).collect()} == {1, 2, 6, 7, 8}
    assert decontaminate.contaminated(empty, bench).count() == 0 == decontaminate.contaminated(table, bench.limit(0)).count()


def test_decontamination_by_common_wording(spark):
    copy = [(0, "a b c X e f X h i X k l")]
    common = [(1 + i, f"n{i} a b c m{i}") for i in range(60)]
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id bigint, text string")
    rare = [(100, "u b c d v"), (101, "u c d e v")]
    found = decontaminate.contaminated(spark.createDataFrame(copy + common + rare, "doc_id bigint, text string"), bench).collect()
    assert [r.doc_id for r in found] == [0]


def test_quality(spark, stored):
    rng = np.random.default_rng(6)
    good, bad = [f"good{i}" for i in range(80)], [f"bad{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice(bad if i % 4 == 0 else good, 60)) if i else None) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 3)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in quality.resample(table, labels).collect()}
    assert len(kept & {i for i in range(400) if i % 4}) > 285 and not kept & set(range(0, 400, 4))
    exact = quality.resample(table, labels, k=37).collect()
    assert len(exact) == 37
    assert quality.resample(table.limit(0), labels).count() == 0 == quality.resample(table, labels.limit(0)).count()
    assert quality.op10_quality_classifier(spark, stored).columns == ["doc_id", "log_weight", "key"]


def test_quality_leaves_toxic_documents_out(spark):
    rng = np.random.default_rng(8)
    good, bad, toxic = ([f"{kind}{i}" for i in range(n)] for kind, n in (("good", 80), ("bad", 80), ("toxic", 3)))
    hurts = lambda i: i % 4 > 0 and i % 5 == 0
    rows = [(i, " ".join([*rng.choice(good if i % 4 else bad, 60), *rng.choice(toxic, 2 * hurts(i))])) for i in range(1200)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(hurts(i))) for i in range(0, 1200, 3)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in quality.resample(table, labels).collect()}
    clean = {i for i in range(1200) if i % 4 and not hurts(i)}
    assert len(kept & clean) > 0.9 * len(clean) and len(kept - clean) < 10


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(quality, "EXACT_AT", 50)
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(0, 1, 3000), np.full(700, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").cache()
    for k in (1, 60, 1200, 1500, 3700):
        assert quality.kth_largest(df, "v", k) == np.sort(values)[::-1][k - 1]
    assert quality.kth_largest(df, "v", 3701) is None


def test_encoder_with_more_new_words_than_it_remembers(monkeypatch):
    """Calls that bring more new words than a generation holds, and words of an older one, encode as the tokenizer does."""
    from tokenizers import Tokenizer

    path = packing.public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    own, plain = packing._Encoder(path), Tokenizer.from_file(path)
    for lo in (0, 7, 3, 20, 0):
        text = " ".join(f"{a}{b}x" for a in "abcd" for b in "efghijkl"[lo % 5 :]) + " again"
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
