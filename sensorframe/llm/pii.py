"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs the labelers, a classifier trained on that decides.

Candidates, votes, features and scores are DataFrame functions. Only counts of vote patterns and of feature patterns, whose number
is bounded by the number of labelers and features, come to the driver, where two small models are fitted to them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm._common import table, written

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Patterns of base candidates. Possessive, and only tried where a run begins or the last match ended, so time is linear in the text;
#: they match what the plain patterns match.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BASE = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
#: Characters without which a pattern cannot match.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Looser forms, looked for together with the base forms so that parts of base spans are passed over.
_LOOSE = {
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9\x20().-]{6,18}[0-9]",
    "ip": r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}",
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{1,63}){1,8}",
}
_MIXED = "|".join([_EMAIL, _PHONE, *(f"(?<![A-Za-z0-9])(?:{p})(?![A-Za-z0-9])" for p in _LOOSE.values()), _CARD])
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: Gazetteer: endings of mail domains and of file names, issuer numbers of cards, networks of no person, countries of bank accounts, and
#: country codes of telephone numbers.
_DOMAINS = "com|org|net|edu|gov|info|biz|io|me|co|uk|us|de|fr|es|it|nl|be|ch|at|se|no|dk|fi|pl|pt|ie|eu|ca|au|nz|in|jp|cn|br|mx|ru"
_FILES = "png|jpg|jpeg|gif|svg|css|js|py|java|txt|csv|json|xml|html|pdf|zip|gz"
_ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|65|62|35)"
_OWN_NETWORKS = r"^0*(?:0|10|127|192\.0*168|169\.0*254|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
_ACCOUNTS = "^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK|TR|SA|AE|IL)"
_DIALLING = "^(?:00)?(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[1-9]|37[0-9]|38[0-9]|42[01])"
#: Context: words before a span that speak for its kind, and words that speak against any.
_FOR = {
    "email": "mail|contact|write to|reply",
    "ip": r"\bip\b|address|host|client|login|server",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": r"\btel|phone|call|mobile|cell|fax|whatsapp",
    "iban": "iban|account|bank|konto",
    "ssn": r"\bssn\b|social|security|tax id",
}
_AGAINST = r"version|release|isbn|order|invoice|serial|issue|ticket|commit|build|part no|page|chapter|section"
_CONTEXT = 24  # code points before a span, at most as far as the match before it

LABELERS = ("form", "check", "gazetteer", "context", "surroundings")
FEATURES = ("separated", "few_digits", "long", "at_line_start", *(f"{name}_{sign}" for name in LABELERS[:4] for sign in ("for", "against")))
ROUNDS, PRIOR_RIGHT, PRIOR_WRONG, MOST_RIGHT = 100, 8.0, 2.0, 0.999
RIDGE, STEPS = 1.0, 30
LEAST = 0.8  # the score from which a looser candidate is a span
_BLOCK = 256


def _located(df: DataFrame, out: str, text: Column, pattern: str, needs: str | None = None) -> DataFrame:
    """Adds ``out``: an array of (start, end, match, before, after) of all matches, in code points. Starts are sums of the lengths before
    them, taken over blocks of ``_BLOCK`` and then within a block, so a text with many matches costs no quadratic time."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn("_m", F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast("array<string>")) if needs else found)
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)))
    m, p, step = F.col("_m"), F.col("_p"), F.col("_step")
    zero = F.lit(0).cast("bigint")
    df = df.withColumn("_step", F.transform(p, lambda x, i: (F.char_length(x) + F.coalesce(F.char_length(F.get(m, i)), F.lit(0))).cast("bigint")))

    def total(first: Column, size: Column) -> Column:
        return F.aggregate(F.slice(step, first + 1, size), zero, lambda a, x: a + x)

    last = F.floor((F.size("_step") - 1) / _BLOCK).cast("int")
    df = df.withColumn("_heads", F.aggregate(F.sequence(F.lit(0), last), F.array(zero), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + total(b * _BLOCK, F.lit(_BLOCK))))))

    def span(x: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        start = F.get(F.col("_heads"), block) + total(block * _BLOCK, i % _BLOCK) + F.char_length(F.get(p, i))
        before = F.substring(F.get(p, i), -_CONTEXT, _CONTEXT)
        return F.struct(start.alias("start"), (start + F.char_length(x)).alias("end"), x.alias("match"), before.alias("before"), F.substring(F.get(p, i + 1), 1, 1).alias("after"))

    return df.withColumn(out, F.transform(m, span)).drop("_m", "_p", "_step", "_heads")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def _iban_rest(match: Column) -> Column:
    """The remainder by 97 of an account number whose first four characters moved to its end, letters counting from 10."""
    bare = F.regexp_replace(match, " ", "")
    signs = F.filter(F.split(F.concat(F.substring(bare, F.lit(5), F.char_length(bare)), F.substring(bare, 1, 4)), ""), lambda c: c != "")
    value = [F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
    return F.aggregate(signs, F.lit(0), lambda a, c: ((a * F.when(c < "A", 10).otherwise(100) + F.instr(value[0], c) - 1) % 97).cast("int"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _candidate(kind: str, x: Column, base: Column) -> Column:
    """(kind, start, end, base, votes, features) of one match."""
    match, before, digits = x["match"], F.lower(x["before"]), _digits(x["match"])
    n = F.char_length(digits)
    ending = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1))
    none = F.lit(False)
    check = {
        "email": _vote(ending.rlike("^[a-z]{2,}$"), ending.rlike("^[0-9]*$")),
        "ip": _vote(match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$|:"), ~match.contains(":")),
        "card": _vote((n >= 13) & (n <= 19) & _luhn(digits), F.lit(True)),
        "phone": _vote((n >= 8) & (n <= 15), F.lit(True)),
        "iban": _vote(_iban_rest(match) == 1, F.lit(True)),
        "ssn": _vote(~match.rlike("^(?:000|666|9)|-00-|-0000$"), F.lit(True)),
    }[kind]
    gazetteer = {
        "email": _vote(ending.rlike(f"^(?:{_DOMAINS})$"), ending.rlike(f"^(?:{_FILES})$")),
        "ip": _vote(none, match.rlike(_OWN_NETWORKS)),
        "card": _vote(digits.rlike(_ISSUERS), F.lit(True)),
        "phone": _vote(digits.rlike(_DIALLING) & match.rlike(r"^(?:\+|00)"), none),
        "iban": _vote(match.rlike(_ACCOUNTS), F.lit(True)),
        "ssn": F.lit(0),
    }[kind]
    context = _vote(before.rlike(_FOR[kind]), before.rlike(_AGAINST))
    alone = ~x["before"].rlike("[A-Za-z0-9_]$") & ~x["after"].rlike("[A-Za-z0-9_]")
    votes = {"form": _vote(base, check == -1), "check": check, "gazetteer": gazetteer, "context": context, "surroundings": _vote(alone, F.lit(True))}
    seen = [
        match.rlike(r"[\x20().-]"), F.size(F.array_distinct(F.split(digits, ""))) <= 3, F.char_length(match) > 20, x["before"].rlike(r"(?:^|\n)\s*$"),
        *(votes[name] == sign for name in LABELERS[:4] for sign in (1, -1)),
    ]
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(seen)), F.lit(0))
    code = sum(((votes[name] + 1) * 3**j for j, name in enumerate(LABELERS)), F.lit(0))
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base.alias("base"), code.cast("int").alias("votes"), bits.cast("int").alias("features")
    )


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, found) of every row: all candidates of a text by kind and start."""
    df = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for kind, pattern in _BASE.items():
        df = _located(df, f"_{kind}", F.col("text"), pattern, _NEEDS.get(kind))
    df = _located(df, "_mixed", F.col("text"), _MIXED)

    def size(x: Column) -> Column:
        return F.char_length(_digits(x["match"]))

    base = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["match"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": lambda x: (size(x) >= 16) & (size(x) <= 19) & _luhn(_digits(x["match"])),
        "phone": lambda x: (size(x) >= 8) & (size(x) <= 15),
    }

    def described(kind: str, matches: Column, is_base: Callable[[Column], Column]) -> Column:
        return F.transform(matches, lambda x: _candidate(kind, x, is_base(x)))

    def loose(pattern: str) -> Column:
        return F.filter("_mixed", lambda x: x["match"].rlike(f"^(?:{pattern})$"))

    numbers = F.filter("_card", lambda x: (size(x) >= 13) & (size(x) <= 19))
    found = [described(kind, numbers if kind == "card" else F.col(f"_{kind}"), base[kind]) for kind in _BASE]
    found += [described(kind, loose(pattern), lambda x: F.lit(False)) for kind, pattern in _LOOSE.items()]
    return df.select("id", F.array_sort(F.array_distinct(F.concat(*found))).alias("found"))


def votes_of(code: int) -> tuple[int, ...]:
    return tuple(code // 3**j % 3 - 1 for j in range(len(LABELERS)))


def _odds(p: float) -> float:
    return math.log(p / (1 - p))


def weigh_labelers(counts: dict[tuple[int, int], int]) -> dict[int, tuple[float, ...]]:
    """From the number of candidates of each (kind, votes): for each kind the log odds that a candidate is personal data before any vote,
    then what a vote of each labeler adds, by expectation-maximisation.

    A labeler that votes is right with one probability, whatever the truth; at first, and as a prior worth ten votes, it is right in
    eight of ten, at least as often as chance and never always."""
    kinds, n_lab = sorted({k for k, _ in counts}), len(LABELERS)
    share = dict.fromkeys(kinds, 0.5)
    right = {(k, j): PRIOR_RIGHT / (PRIOR_RIGHT + PRIOR_WRONG) for k in kinds for j in range(n_lab)}
    rows = [(k, votes_of(code), n) for (k, code), n in sorted(counts.items())]
    for _ in range(ROUNDS):
        yes, all_ = dict.fromkeys(kinds, 1.0), dict.fromkeys(kinds, 2.0)
        hit = {key: [PRIOR_RIGHT, PRIOR_RIGHT + PRIOR_WRONG] for key in right}
        for k, votes, n in rows:
            log_odds = _odds(share[k]) + sum(v * _odds(right[k, j]) for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-log_odds))
            yes[k] += n * p
            all_[k] += n
            for j, v in enumerate(votes):
                if v:
                    hit[k, j][0] += n * (p if v > 0 else 1 - p)
                    hit[k, j][1] += n
        share = {k: yes[k] / all_[k] for k in kinds}
        right = {key: min(MOST_RIGHT, max(0.5, a / b)) for key, (a, b) in hit.items()}
    return {k: (_odds(share[k]), *(_odds(right[k, j]) for j in range(n_lab))) for k in kinds}


def train(rows: list[tuple[int, int, float, float]]) -> np.ndarray:
    """Weights of a logistic model, one for each kind and then each feature, from (kind, features, candidates, expected personal ones)."""
    rows = sorted(rows)
    x = np.zeros((len(rows), len(KINDS) + len(FEATURES)))
    for i, (kind, bits, _, _) in enumerate(rows):
        x[i, kind] = 1
        x[i, len(KINDS) :] = [bits >> j & 1 for j in range(len(FEATURES))]
    n, yes = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (yes - n * p) - RIDGE * w
        w += np.linalg.solve((x.T * (n * np.clip(p * (1 - p), 1e-4, None))) @ x + RIDGE * np.eye(len(w)), slope)
    return w


def _picked(values: list[float], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), index + 1)


def find_personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, spans) of every row: ``spans`` are (kind, start, end, base, score) by kind as in ``KINDS`` and then start, in code points
    with exclusive ends. Base spans (valid e-mail and IPv4 addresses, card numbers of 16 to 19 digits, telephone numbers with +)
    are always kept; looser forms (account numbers, social security numbers, national telephone numbers, IPv6, mail addresses with
    (at), card numbers of 13 to 15 digits) are kept with a score of ``least`` or more. Candidates that fail their kind's check (a checksum, a
    range, a number of digits) teach the labelers and the classifier, but have the score 0.

    Labelers vote for, against or not at all; their reliabilities are estimated from how often each pattern of votes occurs over all
    rows. The classifier is trained on the features of all candidates, labelled with the chance that the votes give them. At most
    6 * 3^5 and 6 * 2^12 counts come to the driver. Texts are read once; candidates are written.

    A null or empty text has no spans; a null id stays null; repeated rows each give a row and count; other columns are not read;
    an empty table, or one without candidates, gives no spans.
    """
    found = written(candidates(docs, doc_id, text), "personal-data")
    each = found.select(F.explode("found").alias("c")).select("c.*")
    patterns = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    odds = weigh_labelers({(r.kind, r.votes): r.n for r in patterns})
    none = (0.0,) * (len(LABELERS) + 1)
    log_odds = _picked([odds.get(k, none)[0] for k in range(len(KINDS))], F.col("kind"))
    for j in range(len(LABELERS)):
        vote = F.floor(F.col("votes") / 3**j) % 3 - 1
        log_odds = log_odds + vote * _picked([odds.get(k, none)[1 + j] for k in range(len(KINDS))], F.col("kind"))
    rows = each.groupBy("kind", "features", "votes").agg(F.count("*").alias("n")).withColumn("yes", F.col("n") / (1 + F.exp(-log_odds)))
    rows = rows.groupBy("kind", "features").agg(F.sum("n"), F.sum("yes")).collect()
    weights = train([tuple(r) for r in rows]).tolist()

    def scored(c: Column) -> Column:
        z = _picked(weights[: len(KINDS)], c["kind"])
        for j in range(len(FEATURES)):
            z = z + F.when(c["features"].bitwiseAND(F.lit(1 << j)) != 0, weights[len(KINDS) + j]).otherwise(0.0)
        name = F.element_at(F.array(*map(F.lit, KINDS)), c["kind"] + 1)
        failed = c["features"].bitwiseAND(F.lit(1 << FEATURES.index("check_against"))) != 0
        score = F.when(failed, 0.0).otherwise(1 / (1 + F.exp(-z)))
        return F.struct(name.alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), score.alias("score"))

    spans = F.filter(F.transform("found", scored), lambda s: s["base"] | (s["score"] >= least))
    return found.select(F.col("id").alias(doc_id), spans.alias("spans"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op11_personal_data": op11_personal_data}
ORACLES: dict[str, str] = {}
