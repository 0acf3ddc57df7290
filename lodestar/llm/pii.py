"""Personal data by weak supervision (operator 7).

Base patterns give spans that always stay. Wider patterns give candidates; labelers vote on every span, expectation
maximisation estimates how reliable each labeler is from all votes of the corpus, and the probable labels train a
logistic span classifier that admits or rejects the candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.memo import release
from lodestar.llm.spans import Span, masked
from lodestar.session import staged, table

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is taken whole or not at all: a shorter end of it meets the same characters after it
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# wider patterns of candidates, beside the base ones that fail
SPELLED_EMAIL = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?[\[({]\x20?at\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63})+", re.IGNORECASE | re.ASCII)
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.)-])(?<![0-9)]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])")

# fixed values: context words of each kind, and words that speak against personal data
NEAR = {
    "email": ("mail", "contact", "write", "reach", "send"),
    "ip": ("ip", "address", "host", "client", "server", "login", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "pay", "cc"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "contact", "whatsapp"),
}
AGAINST = ("version", "release", "build", "section", "isbn", "order", "invoice", "serial", "example:", "sku", "id")
SUFFIXES = frozenset(["com", "net", "org", "edu", "gov", "io", "co", "info", "biz", "de", "fr", "es", "uk", "us", "eu", "ca", "au", "it", "nl", "ch", "at", "mx", "ar", "br", "jp", "cn", "in"])

LABELERS = ("pattern", "check", "gazetteer", "context", "against", "shape")
FEATURES = ("email", "ip", "card", "phone", "base", "grouped", "separated", *(f"{n}{v}" for n in LABELERS for v in ("+", "-")))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain. Each @ is looked at once, so long runs cost no more than they hold."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, by kind as listed and then start, and further candidates."""
    base: list[Span] = []
    more: list[Span] = []
    if "@" in text:
        base += [("email", s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        (base if all(map(octet, m.groups())) else more).append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            base.append(("card", m.start(), m.end()))
        elif 13 <= len(digits) <= 19:
            more.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 8 <= n <= 15:
                base.append(("phone", m.start(), m.end()))
    low = text.lower() if "at" in text or "AT" in text else ""
    if any(f"{a}at{b}" in low or f"{a} at {b}" in low for a, b in ("[]", "()", "{}")):
        more += [("email", m.start(), m.end()) for m in SPELLED_EMAIL.finditer(text)]
    more += [("phone", m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
    if more:
        taken = sorted((s, e) for _, s, e in base)
        more = [x for x in more if not any(s < x[2] and x[1] < e for s, e in taken)]
    return base, more


def votes(text: str, span: Span, is_base: bool) -> tuple[int, ...]:
    """Of each labeler: 1 for personal data, -1 against, 0 for no opinion. Texts are only read near the span."""
    kind, start, end = span
    own = text[start : min(end, start + 400)]
    before = re.findall(r"[^\W\d_]+:?", text[max(0, start - 40) : start].lower())[-5:]
    digits = re.sub(r"[^0-9]", "", own)
    if kind == "email":
        check = 1 if own.rpartition(".")[2].lower().strip("])} ") in SUFFIXES else 0
        gazetteer = 1 if re.search(r"mail|inbox|post|info|contact", own.lower()) else 0
        shape = -1 if ".." in own or own.startswith(".") else 1
    elif kind == "ip":
        check = 1 if is_base else -1
        gazetteer = -1 if own.split(".")[0] in ("0", "127", "255") or own.endswith(".0.0.0") else 0
        shape = -1 if any(len(p) > 1 and p[0] == "0" for p in own.split(".")) else 1
    elif kind == "card":
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" and len(digits) in (14, 15, 16) and check > 0 else -1 if digits[0] not in "3456" and check < 0 else 0
        shape = -1 if len(set(digits)) <= 2 else 0
    else:
        check = 1 if 8 <= len(digits) <= 15 else 0
        gazetteer = 1 if own.startswith("+1") else 0
        shape = 1 if re.search(r"[ ().-]", own) else -1
    context = 1 if any(w.startswith(NEAR[kind]) for w in before) else 0
    against = -1 if any(w.startswith(AGAINST) for w in before) else 0
    return (1 if is_base else 0, check, gazetteer, context, against, shape)


def code_of(text: str, span: Span, is_base: bool) -> str:
    """Kind, base, form and votes in short: all that the classifier sees of a span. There are at most 4 * 2 * 4 * 3 ** 6 codes."""
    own = text[span[1] : min(span[2], span[1] + 400)]
    form = 2 * bool(re.search(r"[0-9][ -][0-9]{2,}", own)) + bool(re.search(r"[().\[\]{}]", own))
    return f"{KINDS.index(span[0])}{int(is_base)}{form}" + "".join("-0+"[v + 1] for v in votes(text, span, is_base))


def vote_matrix(codes: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in code[3:]] for code in codes]).reshape(-1, len(LABELERS))


def feature_matrix(codes: list[str]) -> np.ndarray:
    rows = []
    for code in codes:
        kind, base, form = int(code[0]), int(code[1]), int(code[2])
        rows.append([*(kind == k for k in range(4)), base, form >> 1, form & 1, *(c == s for c in code[3:] for s in "+-")])
    return np.array(rows, float).reshape(-1, len(FEATURES))


@dataclass
class Reliability:
    prior: float
    hit: np.ndarray  # labeler x (-, 0, +): chance of the vote on personal data
    noise: np.ndarray  # the same on other spans


def estimate(vote: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[Reliability, np.ndarray]:
    """Expectation maximisation over vote patterns and their counts; also each pattern's chance of personal data.

    It starts from the sum of votes; the pseudo-counts hold that a labeler is rather right than wrong.
    """
    start = vote.sum(axis=1)
    p = 1 / (1 + np.exp(-1.5 * (start - 0.5)))
    prior_hit, prior_noise = np.array([1.0, 2.0, 4.0]), np.array([4.0, 2.0, 1.0])
    state = None
    for _ in range(rounds):
        hit, noise = [], []
        for k in range(vote.shape[1]):
            is_vote = np.stack([vote[:, k] == v for v in (-1, 0, 1)], 1)
            a, b = is_vote.T @ (weight * p) + prior_hit, is_vote.T @ (weight * (1 - p)) + prior_noise
            hit.append(a / a.sum())
            noise.append(b / b.sum())
        prior = ((weight * p).sum() + 1) / (weight.sum() + 2)
        state = Reliability(prior, np.array(hit), np.array(noise))
        at = vote + 1
        odds = np.log(prior / (1 - prior)) + sum(np.log(state.hit[k, at[:, k]]) - np.log(state.noise[k, at[:, k]]) for k in range(vote.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return state, p


def fit(features: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on probable labels by Newton steps; the last weight is the constant."""
    x = np.hstack([features, np.ones((len(features), 1))])
    beta = np.zeros(x.shape[1])
    weight = weight / max(weight.mean(), 1e-12)  # many repeats of one pattern must not outweigh the ridge by themselves
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(beta)), x.T @ (weight * (target - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return beta


def classify(counts: dict[str, int]) -> dict[str, float]:
    """Chance of personal data for every code, from the counts of all codes in the corpus."""
    codes = sorted(counts)
    if not codes:
        return {}
    weight = np.array([counts[c] for c in codes], float)
    _, target = estimate(vote_matrix(codes), weight)
    beta = fit(feature_matrix(codes), target, np.sqrt(weight))
    x = np.hstack([feature_matrix(codes), np.ones((len(codes), 1))])
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))).tolist(), strict=True))


SPAN = "struct<kind:string,start:long,end:long,code:string>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("code", pa.string())]))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, base and more: arrays of (kind, start, end, code)."""

    def coded(text: str, spans: list[Span], is_base: bool) -> list[dict]:
        return [{"kind": s[0], "start": s[1], "end": s[2], "code": code_of(text, s, is_base)} for s in spans]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            base, more = [], []
            for text in batch.column(1).to_pylist():
                b, m = spans_of(text or "")
                base.append(coded(text, b, True))
                more.append(coded(text, m, False))
            yield pa.record_batch([batch.column(0), pa.array(base, SPAN_TYPE), pa.array(more, SPAN_TYPE)], names=["id", "base", "more"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, f"id long, base array<{SPAN}>, more array<{SPAN}>")


def learn(found: DataFrame, least: float) -> list[str]:
    """The codes that the trained classifier admits. All spans of the corpus count; their codes are a bounded set."""
    codes = found.select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.code").count().collect()
    return [code for code, p in classify({r["code"]: r["count"] for r in codes}).items() if p >= least]


def detect(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text: id_col, base and found, arrays of (kind, start, end), by kind and then start.

    A null text counts as empty and has no spans; a null id stays null; repeated rows are scanned row by row, long texts whole; spans that tie
    in kind and start are in the order of their end; an empty table gives no rows; other columns are ignored, whatever their names.
    The text is read once; what is kept of it is its spans.
    """
    found = staged(candidates(docs, id_col, text_col))
    admitted = learn(found, least)
    order = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    plain = lambda c: F.transform(F.array_sort(F.transform(c, order)), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    more = F.filter("more", lambda s: s["code"].isin(admitted)) if admitted else F.filter("more", lambda s: F.lit(False))
    return found.select(F.col("id").alias(id_col), plain(F.col("base")).alias("base"), plain(F.concat("base", more)).alias("found"))


def redact(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with every span of personal data replaced by its kind in angle brackets.

    Null and empty texts stay; repeated rows and rows without an id are treated row by row, long texts whole; of overlapping spans the earlier,
    then the longer one names the kind; an empty table stays empty; all other columns are kept, whatever their names.
    """
    admitted = frozenset(learn(staged(candidates(docs, id_col, text_col).drop("id")), least))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            out = []
            for text in batch.column(text_col).to_pylist():
                if text:
                    base, more = spans_of(text)
                    if spans := [*base, *(s for s in more if code_of(text, s, False) in admitted)]:
                        text = masked(text, spans)
                out.append(text)
            yield batch.set_column(batch.schema.names.index(text_col), text_col, pa.array(out, pa.string()))

    return docs.mapInArrow(each, docs.schema)


def joined_spans(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; and n_spans, the number of all spans."""
    found = detect(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(joined_spans("base"), 256).alias("base_sha256"), joined_spans("found").alias("spans"), F.size("found").cast("long").alias("n_spans"))
