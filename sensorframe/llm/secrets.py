"""Secret scans: keyword prefilter by Aho-Corasick, anchored expressions near the hits only, checksum validation."""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm._common import small_batches, table

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
#: Expressions that are only ever tried at a keyword's place. They hold ASCII alone, so they are run over UTF-8 bytes.
_ANCHORED = {
    "assign": re.compile(rb"(%s)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % _WORDS.encode()),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
}
_JWT, _PART = re.compile(rb"eyJ[A-Za-z0-9_-]+"), re.compile(rb"\.[A-Za-z0-9_-]+")
_PEM, _PEM_END = re.compile(rb"-----BEGIN ([A-Z ]*)PRIVATE KEY-----"), re.compile(rb"-----END ([A-Z ]*)PRIVATE KEY(?=-----)")
#: Lower-case keywords that lead to each kind.
_KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "eyj": "jwt", "-----begin": "pem",
}
_HEX_RUN, _HEX_STEP = 24, 4
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_HEX_MATCH = re.compile(rb"[0-9a-f]+")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: bytes) -> str:
    """The six base-62 digits that end a token whose checksum is CRC-32 of what stands between prefix and checksum."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out


def _is_json_header(part: bytes) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def _valid(kind: str, found: re.Match) -> bool:
    whole = found[0]
    if kind == "assign":
        return len(found[2]) >= 6
    if kind == "access":
        return len(whole) >= 20
    return whole[-6:].decode() == crc_base62(whole[4:-6])


class _Long:
    """Matches of the two kinds without a bound on their length, such that a text is read a fixed number of times however many places
    fail: what ends a run of token characters decides for all places in that run, and end lines are looked up in one list."""

    def __init__(self, raw: bytes):
        self.raw, self.failed, self.ends = raw, 0, None

    def jwt(self, at: int) -> tuple[int, bool] | None:
        """The end of a token of three parts that begins here, and whether its header is valid."""
        if at < self.failed or not (first := _JWT.match(self.raw, at)):
            return None
        second = _PART.match(self.raw, first.end())
        third = second and _PART.match(self.raw, second.end())
        if not third:
            self.failed = first.end()
            return None
        return third.end(), _is_json_header(first[0])

    def pem(self, at: int) -> tuple[int, bool] | None:
        """The end of the first end line with the label of the begin line that stands here."""
        if not (head := _PEM.match(self.raw, at)):
            return None
        if self.ends is None:
            self.ends = defaultdict(list)
            for m in _PEM_END.finditer(self.raw):
                self.ends[m[1]].append(m.start())
        ends = self.ends[head[1]]
        i = bisect.bisect_left(ends, head.end())
        return (ends[i] + len(b"-----END " + head[1] + b"PRIVATE KEY-----"), True) if i < len(ends) else None


def _automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        words.add_word(word, (len(word), kind))
    words.make_automaton()
    return words


def _hex_stretches(raw: bytes) -> np.ndarray:
    """Ranges (start, end) that hold all runs that are long enough, each run whole: a run of 24 holds at least six consecutive
    probes, four bytes apart, and goes on for less than four bytes before and after its probes. Between the probes of a range
    there may be other bytes, so it can hold short runs and several long ones."""
    hit = _HEX[np.frombuffer(raw, np.uint8)[_HEX_STEP - 1 :: _HEX_STEP]]
    need = _HEX_RUN // _HEX_STEP
    if len(hit) < need:
        return np.empty((0, 2), int)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    first, after = edge[::2], edge[1::2]
    long = after - first >= need
    return np.stack((first[long] * _HEX_STEP, after[long] * _HEX_STEP + _HEX_STEP - 1), 1)


def scan_text(raw: bytes, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of one UTF-8 text in code points, by start and then kind."""
    spans, free, long = [], dict.fromkeys(KINDS, 0), _Long(raw)
    for last, (size, kind) in words.iter(raw.lower().decode("latin-1")):
        at = last + 1 - size
        if at < free[kind]:
            continue
        if kind in ("jwt", "pem"):
            end, valid = getattr(long, kind)(at) or (0, False)
        else:
            found = _ANCHORED[kind].match(raw, at)
            end, valid = (found.end(), _valid(kind, found)) if found else (0, False)
        if end:
            free[kind] = end
            if valid:
                spans.append((kind, at, end))
    for start, end in _hex_stretches(raw).tolist():
        spans += [("hex", m.start(), m.end()) for m in _HEX_MATCH.finditer(raw, start, end) if m.end() - m.start() >= _HEX_RUN]
    if spans and not raw.isascii():
        point = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        spans = [(kind, int(point[a]) - 1, int(point[b - 1])) for kind, a, b in spans]
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]]))


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns ``doc_id`` and ``spans``, an array of (kind, start, end) in code points with exclusive ends, for every row.

    Kinds assign, access and hex are plain patterns; github and npm tokens must carry a right CRC-32, a jwt a JSON header,
    a pem its end line. Matches are leftmost and non-overlapping within a kind. A null or empty text has no spans; a null id
    stays null; repeated rows each give a row; other columns are not read; an empty table gives an empty result.
    Each text is scanned by itself: no shuffle, and memory is bounded by an Arrow batch.
    """
    small_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    only = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    kind_of_id = only.schema["_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _automaton()
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan_text(t.as_buffer().to_pybytes(), words)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["_id", "spans"])

    schema = f"_id {kind_of_id}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return only.mapInArrow(scan, schema).withColumnRenamed("_id", doc_id)


def digest_of_spans(spans: list[tuple[str, int, int]]) -> str:
    """What the query digests, for one text: used by tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op2_secret_scans": op2_secret_scans}
ORACLES: dict[str, str] = {}
