"""Operators 2, 3 and 7 against their definitions taken literally."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import pii, quality, secrets
from tests.llm.helpers import AWKWARD, frame, prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def literal_secrets(t):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def literal_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def literal_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), [], 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.append(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_base_secrets_follow_their_definition():
    rng = random.Random(1)
    parts = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH", "0123456789", "abcdef", "xyz", "/", ".", "-", "_", "\n", "é", "ſecret", "toKen"]
    for _ in range(4000):
        t = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert secrets.base_spans(t) == literal_secrets(t), t


def test_base_pii_follows_its_definition():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", ".", "-", "%", "12", "255", "256", "0001", "+1", " ", "(", ")", "4111111111111111", "5500 0000 0000 0004", "com", "\n", "é", "+49 30 123456", "..", "_"]
    for _ in range(6000):
        t = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert pii.spans_of(t)[0] == literal_pii(t), t


def test_base_rules_follow_their_definition():
    rng = random.Random(3)
    numbers = quality.WordNumbers()
    for _ in range(1500):
        t = "".join(rng.choices(["a", "b", "a b a", " ", "\n", "\t", "\x0b", "\x1c", " ", "\xa0", "#", "&x", "é", "a b a\n"], k=rng.randint(0, 30)))
        assert quality.base_rules(t, numbers) == literal_rules(t), repr(t)
    many = [b"%d" % i for i in range(100)] * 2
    assert quality.repeated_words(many, quality.WordNumbers(), most=10) == 200


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "+1 " * 60_000, "a@" * 100_000, "a@b " * 50_000, "f" * 200_000, "token=" * 30_000, "(555) " * 30_000])
def test_long_runs_take_linear_time(text):
    pii.spans_of(text)
    secrets.base_spans(text)
    quality.base_rules(text, quality.WordNumbers())


def test_markov_ratio_on_held_out_samples():
    w = secrets.train(secrets.labelled_samples(2000))
    held = secrets.labelled_samples(1000, seed=99)
    right = sum((secrets.ratio(s, w) >= 18) == bool(y) for s, y in held)
    assert right >= 0.99 * len(held)


def test_secret_query_keeps_base_spans_and_adds_random_ones(spark):
    key = "q7Zp0Xk2Vb9Rt4Wm8Ns1Lc6"
    texts = [*AWKWARD, f"see {key} there", 'token = "0123456789abcdef0123456789abcdef"', "getUserAccountSettingsFromDatabase"]
    rows = {r["doc_id"]: r for r in secrets.scan(frame(spark, texts, "base found kind id")).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        spans = lambda c: [(s["kind"], s["start"], s["end"]) for s in rows[i][c]]  # noqa: B023, E731
        assert spans("base") == literal_secrets(t or "") and set(spans("base")) <= set(spans("found"))
    n = len(AWKWARD)
    assert [s["kind"] for s in rows[n]["found"]] == ["random"] and [s["kind"] for s in rows[n + 1]["found"]] == ["assign", "hex"] and not rows[n + 2]["found"]


def test_expectation_maximisation_finds_reliabilities():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.4
    right = [0.95, 0.9, 0.8, 0.7, 0.55]
    votes = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) * 2 - 1 for r in right], 1)
    patterns, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    state, p = pii.estimate(patterns, n.astype(float))
    assert np.allclose(state.hit[:, 2], right, atol=0.05) and abs(state.prior - 0.4) < 0.05
    assert ((p[back.ravel()] >= 0.5) == truth).mean() > 0.95


def test_pii_candidates_and_masks(spark):
    rng = random.Random(5)
    # the corpus: sound cards, numbers that fail the check, phones, mails
    texts = [f"{prose(rng, 6)} pay by card 4111 1111 1111 1111 or call +1 (243) 555-{i:04d} now" for i in range(60)]
    texts += [f"order number {rng.randrange(10**15, 10**16)} {prose(rng, 4)}" for _ in range(60)]
    texts += [f"write to a{i}@mail.example.com from 10.1.2.{i}" for i in range(60)] + [None, "", "call (243) 555-1234 today", *AWKWARD]
    docs = frame(spark, texts, "base more found id kind")
    found = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in found[i]["base"]] == literal_pii(t or "")
        assert set(found[i]["base"]) <= set(found[i]["found"])
    assert not any(found[i]["found"] for i in range(60, 120) if not literal_pii(texts[i]))
    assert [s["kind"] for s in found[182]["found"]] == ["phone"]
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert masked[0].endswith("pay by card <CARD> or call <PHONE> now") and masked[120] == "write to <EMAIL> from <IP>" and masked[180] is None
    assert pii.redact(docs).columns == docs.columns and pii.detect(docs.limit(0)).count() == 0


def test_pii_query_columns(spark, tmp_path):
    frame(spark, ["a@b.co and 4111111111111111", None]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in pii.op7_pii(spark, str(tmp_path)).collect()}
    assert rows[0]["spans"] == "email:0:6,card:11:27" and (rows[0]["n_email"], rows[0]["n_card"]) == (1, 1)
    assert rows[0]["base_sha256"] == hashlib.sha256(b"email:0:6,card:11:27").hexdigest() and rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_quality_separates_good_from_bad(spark):
    rng = random.Random(6)
    good = [prose(rng, 80) for _ in range(120)]
    bad = [" ".join(w + "$$$" for w in prose(rng, 80).split()) for _ in range(60)]
    texts = [*good, *bad, *AWKWARD]
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 180, 2)] + [(None, 1, 0), (3, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts, "kind bucket quality")
    rows = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        if len(t or "") < 20_000:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == literal_rules(t or "")
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert all(rows[i]["kept"] for i in range(120)) and not any(rows[i]["kept"] for i in range(120, 180))
    bare = quality.quality(docs, labels.limit(0)).where(F.col("kept") == F.col("base_failed")).count()
    assert bare == 0 and quality.quality(docs.limit(0), labels).count() == 0
