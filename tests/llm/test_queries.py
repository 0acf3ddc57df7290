"""The registered queries over a small folder of tables, each against a version written out plainly."""

import hashlib
import math
import random
import re

import pytest

from lodestar.llm import fingerprint as fp
from lodestar.llm import langid, secrets
from lodestar.llm.registry import QUERIES
from tests.llm.helpers import DOCS, frame, prose

GERMAN = ("sch", "ung", "ein", "keit", "en", "pf")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    texts = [prose(rng, rng.randint(55, 120)) for _ in range(30)] + [prose(rng, 80, GERMAN) for _ in range(12)]
    texts += [texts[0], texts[1] + " more", None, "", "12 34", "short text", "x " * 60]
    texts += [f"{prose(rng, 40)} {''.join(rng.choices('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', k=32))} password: hunter{i}x9" for i in range(6)]
    texts += [f"{prose(rng, 40)} mail me at p{i}@mail.example.com or call +1 555 010 99{i}7, host 10.0.0.{i}" for i in range(4)]
    langs = ["de" if t and "sch" in t else "en" for t in texts]
    path = tmp_path_factory.mktemp("tables")
    docs = frame(spark, texts, lang=langs, source=[f"src{i % 3}" for i in range(len(texts))])
    docs = docs.unionAll(spark.createDataFrame([(None, texts[2], "en", "src0", 9), (None, texts[5][:300], "en", "src0", 9)], DOCS))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(42)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"http://WWW.ex{i % 7}.com/{'en' if i % 2 else 'es'}/p{i}?utm_x=1&b={i}", f"<html lang='en'>{prose(rng, 30)}</html>") for i in range(20)]
    spark.createDataFrame([*pages, (None, None, None), (99, "no address", "x")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="module")
def rows(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


def by_text(spark, folder, name):
    """The query's rows with an id, by doc_id."""
    out = QUERIES[name](spark, folder).collect()
    return out, {r["doc_id"]: r for r in out if r["doc_id"] is not None}


def test_every_query_gives_a_row_for_every_row(spark, folder, rows):
    for name in ("op2_secret_scan", "op3_quality_rules", "op5_language_id", "op6_fingerprints", "op7_pii", "op9_near_duplicates"):
        got = sorted((r["doc_id"] for r in QUERIES[name](spark, folder).collect()), key=str)
        assert got == sorted((r["doc_id"] for r in rows), key=str), name
    first = [r["doc_id"] for r in QUERIES["op1_best_fit_packing"](spark, folder).collect() if r["piece"] == 0]
    assert sorted(first, key=str) == sorted((r["doc_id"] for r in rows), key=str)
    assert QUERIES["op4_url_filter"](spark, folder).count() == 22 and QUERIES["op8_revisits"](spark, folder).count() > 0
    assert QUERIES["op10_source_mix"](spark, folder).count() > 0


def plain_anchors(text, k=16, s=10):
    """k-mers whose smallest inner s-mer is at an edge, each at its first place, in text order."""
    if len(text) < k:
        return {text: 0} if text else {}
    value = lambda w: int(fp.windows(fp.np.array([ord(c) for c in w], fp.np.uint64), s)[0])
    inner = {}
    out = {}
    for i in range(len(text) - k + 1):
        parts = [inner.setdefault(w, 0) or inner.__setitem__(w, value(w)) or inner[w] for w in (text[i + j : i + j + s] for j in range(k - s + 1))]
        if min(parts) in (parts[0], parts[-1]):
            out.setdefault(text[i : i + k], i)
    return out


def plain_likeness(a, b):
    common = [b[w] for w in sorted(a, key=a.get) if w in b]
    best = []
    for i, x in enumerate(common):
        best.append(1 + max((best[j] for j in range(i) if common[j] < x), default=0))
    union = len(a) + len(b) - len(common)
    return max(best, default=0) / union if union else 1.0


def test_fingerprints(spark, folder, rows):
    _, got = by_text(spark, folder, "op6_fingerprints")
    order = sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: -r["doc_id"])
    for one, two in list(zip(order, order[1:], strict=False))[::4]:
        text, following = one["text"] or "", two["text"] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        own, other, after = plain_anchors(text), plain_anchors(changed), plain_anchors(following)
        r = got[one["doc_id"]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        places = lambda spelled: [int(x.split(":")[1]) for x in spelled.split(",") if x]
        assert places(r["fingerprint"]) == sorted(own.values()) and places(r["edited_fingerprint"]) == sorted(other.values())
        assert math.isclose(r["near_edited"], plain_likeness(own, other)) and math.isclose(r["near_next"], plain_likeness(own, after))


def test_added_secrets(spark, folder, rows):
    n = {0: {}, 1: {}}
    for token, label in secrets.labelled_samples(3_000):
        for pair in zip("^" + token, token, strict=False):
            n[label][pair] = n[label].get(pair, 0) + 1
    after = {y: {} for y in n}
    for y in n:
        for (a, _), c in n[y].items():
            after[y][a] = after[y].get(a, 0) + c
    size = len(secrets.ALPHABET)
    p = lambda y, a, b: math.log((n[y].get((a, b), 0) + 0.1) / (after[y].get(a, 0) + 0.1 * size))
    _, got = by_text(spark, folder, "op2_secret_scan")
    added = 0
    for r in rows:
        if r["doc_id"] is None:
            continue
        text = r["text"] or ""
        base = secrets.base_spans(text)
        spans = list(base)
        for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
            score = sum(p(1, a, b) - p(0, a, b) for a, b in zip("^" + m[0], m[0], strict=False))
            if score >= 18 and not any(s < m.end() and m.start() < e for _, s, e in base):
                spans.append(("random", m.start(), m.end()))
        spans.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert got[r["doc_id"]]["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        added += len(spans) - len(base)
    assert added >= 6


def test_quality_verdicts(spark, folder, rows):
    bucket = lambda g: (int.from_bytes(g, "little") * 2654435761 % (1 << 32)) >> 18
    grams = lambda t: [bucket(t[i : i + 4]) for i in range(len(t) - 3)]
    count = {"raw": {}, 1: {}, 0: {}}
    for r in rows:
        for kind in ("raw", int(r["doc_id"] < 30)) if r["doc_id"] is not None and r["doc_id"] < 42 else ("raw",):
            for g in grams((r["text"] or "").encode()):
                count[kind][g] = count[kind].get(g, 0) + 1
    total = {k: sum(c.values()) for k, c in count.items()}
    log = lambda k, g: math.log((count[k].get(g, 0) + 0.5) / (total[k] + 0.5 * (1 << 14)))
    weight = lambda g: log(1, g) - log("raw", g)
    good, bad = (sum(weight(g) * c for g, c in count[k].items()) / total[k] for k in (1, 0))
    threshold = good + 0.25 * (bad - good)
    _, got = by_text(spark, folder, "op3_quality_rules")
    seen = set()
    for r in rows:
        if r["doc_id"] is None:
            continue
        own = grams((r["text"] or "").encode())
        score = sum(map(weight, own)) / max(len(own), 1)
        assert math.isclose(got[r["doc_id"]]["score"], score, abs_tol=1e-9)
        assert got[r["doc_id"]]["kept"] == (not got[r["doc_id"]]["base_failed"] and score >= threshold)
        seen.add((got[r["doc_id"]]["base_failed"], got[r["doc_id"]]["kept"]))
    assert seen == {(True, False), (False, True), (False, False)}


def against_fusion(out, flat):
    """The fusion by hand: text likelihoods over the smoothed shares of hosts, suffixes and declared languages."""
    names, model = langid.text_model(flat, 8_000)
    scored = langid.text_evidence(flat, names, model, 6.0).collect()
    n = len(names) + 1
    suffix_of = lambda h: None if h is None else h.rpartition(".")[2].split(":")[0] if "." in h else ""
    tally = lambda keep: [sum(r["seen"] == k for r in scored if keep(r)) for k in range(n)]
    every = tally(lambda r: True)
    overall = [(c + 1) / (sum(every) + n) for c in every]
    smooth = lambda c, above: [(x + 20 * a) / (sum(c) + 20) for x, a in zip(c, above, strict=True)]
    for r in scored:
        prior, beside = overall, overall
        if r["host"] is not None:
            prior = smooth(tally(lambda x, s=suffix_of(r["host"]): suffix_of(x["host"]) == s), overall)
            prior = smooth(tally(lambda x, h=r["host"]: x["host"] == h), prior)
        if r["declared"] is not None:
            beside = smooth(tally(lambda x, d=r["declared"]: x["declared"] == d), overall)
        logs = [e + math.log(h) + math.log(b / o) for e, h, b, o in zip(r["evidence"], prior, beside, overall, strict=True)]
        peak = max(logs)
        p = 1 / sum(math.exp(x - peak) for x in logs)
        lang = [*names, None][logs.index(peak)]
        assert out[r["row"]]["lang"] == lang and math.isclose(out[r["row"]]["p"], p, rel_tol=1e-6)
        assert out[r["row"]]["kept"] == (lang is not None and p >= 0.5)


def test_language_posteriors(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null")
    out = {r["doc_id"]: r for r in langid.identify(docs, declared=langid.F.col("lang"), host=langid.F.col("source")).collect()}
    against_fusion(out, docs.select(langid.F.col("doc_id").alias("row"), langid.F.coalesce("text", langid.F.lit("")).alias("text"), langid.F.col("lang").alias("declared"), langid.F.col("source").alias("host")))
    assert {r["lang"] for r in out.values()} == {"de", "en", None}


def test_page_posteriors(spark, tmp_path):
    """Pages of two languages, hosts of several suffixes, markup that is right, wrong or silent, and awkward rows."""
    rng = random.Random(5)
    pages, plain = [], []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        text = prose(rng, rng.choice([2, 40]), *([GERMAN] if lang == "de" else []))
        declared = [lang, "de", None][i % 4 % 3]
        host = f"h{i % 5}.{lang if i % 7 else 'org'}"
        markup = f"<html lang='{declared.upper()}'>" if declared else "<html>"
        pages.append((i, f"http://{host.upper()}/p?{i}", f"{markup}<script>the the the</script><p>{text}</p><!-- ing --></html>"))
        plain.append((i, text, declared, host))
    pages += [(100, None, "<html lang=de><p>er"), (101, "no address", "12"), (102, "http://h1.de:80/", None)]
    plain += [(100, "er", "de", None), (101, "12", None, None), (102, "", None, "h1.de:80")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["page_language"](spark, str(tmp_path)).collect()
    out = {r["page_id"]: r for r in rows}
    assert len(rows) == len(out) == len(pages)
    against_fusion(out, spark.createDataFrame(plain, "row long, text string, declared string, host string"))
    assert {"de", "en"} <= {r["lang"] for r in rows}
