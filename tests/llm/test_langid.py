import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import langid
from tests.llm.helpers import AWKWARD, frame, prose

SYLLABLES = {
    "en": ("the", "ing", "and", "wh", "er", "th", "ea"),
    "de": ("sch", "ung", "ü", "ein", "ß", "keit", "en"),
    "fr": ("eau", "é", "tion", "è", "oi", "que", "ai"),
}


def corpus(rng, n, words):
    langs = [rng.choice(list(SYLLABLES)) for _ in range(n)]
    return langs, [prose(rng, words, SYLLABLES[x]) for x in langs]


def test_held_out_accuracy_and_rejection(spark):
    rng = random.Random(1)
    langs, texts = corpus(rng, 240, 30)
    declared = [x if i % 2 else None for i, x in enumerate(langs)]
    wrong = {5: "de", 7: "en", 9: "fr"}  # declared, but not so
    noise = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(200)) for _ in range(6)]
    docs = frame(spark, [*texts, *noise, *AWKWARD], "row host suffix declared evidence seen logs", lang=[*(wrong.get(i, x) for i, x in enumerate(declared)), *[None] * (6 + len(AWKWARD))])
    rows = {r["doc_id"]: r for r in langid.identify(docs, declared=F.col("lang"), host=F.col("source")).collect()}
    assert len(rows) == 246 + len(AWKWARD)
    right = sum(rows[i]["lang"] == x and rows[i]["kept"] for i, x in enumerate(langs))
    assert right >= 0.98 * len(langs)
    assert not any(rows[i]["kept"] for i in range(240, 246))
    assert not any(rows[246 + k]["kept"] for k, t in enumerate(AWKWARD) if not any(c.isalpha() for c in t or ""))


def test_priors_decide_short_texts(spark):
    """A text that could be either language follows its host, its suffix or what its markup declares."""
    rng = random.Random(2)
    langs, texts = corpus(rng, 300, 40)
    rows = [(i, t, x, f"http://{x}.{rng.choice(['a', 'b'])}.{x}/p") for i, (x, t) in enumerate(zip(langs, texts))]
    rows += [(1000, "er", None, "http://de.a.de/x"), (1001, "er", None, "http://en.b.en/x"), (1002, "er", "de", None), (1003, "er", "en", None), (1004, "er", None, "http://new.de/x"), (1005, "er", None, "http://new.en/x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    got = {r["doc_id"]: r["lang"] for r in langid.identify(docs, declared=F.col("lang"), host=langid.host_of(F.col("url"))).where("doc_id >= 1000").collect()}
    assert got == {1000: "de", 1001: "en", 1002: "de", 1003: "en", 1004: "de", 1005: "en"}


def test_no_declared_language_is_left_out(spark):
    """70 languages, the rarest with 2 texts among 600, and one whose texts have no letters; a sample of 8 rows each."""
    rng = random.Random(7)
    alphabets = {f"l{k:02}": [chr(0x100 + 40 * k + j) * 2 for j in range(12)] for k in range(70)}
    langs = [x for k, x in enumerate(alphabets) for _ in range(2 if k == 69 else 8)]
    texts = [prose(rng, 60, alphabets[x]) for x in langs]
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(texts, langs))] + [(900, "12 34", "empty"), (901, "56", "empty")]
    rows += [(1000 + k, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(200)), None) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang"], r["kept"]) for r in langid.identify(docs, declared=F.col("lang"), sample=8).collect()}
    assert [got[i] for i in range(len(langs))] == [(x, True) for x in langs]
    assert not any(got[i][1] for i in (900, 901)) and not any(got[1000 + k][0] == "empty" for k in range(5))


def test_page_evidence(spark):
    rows = [('<!DOCTYPE html><HTML data-x="1" lang="FR"><p>', "https://A.Example.com:80/x?q"), ("<html lang=de-AT>", "http://b.net"), ("<p lang='en'>", "x"), (None, None)]
    df = spark.createDataFrame(rows, "html string, url string")
    host = langid.host_of(F.col("url"))
    got = df.select(langid.declared_in(F.col("html")), host, langid.suffix_of(host)).collect()
    assert [tuple(r) for r in got] == [("fr", "a.example.com:80", "com"), ("de", "b.net", "net"), (None, "", ""), (None, None, None)]


def test_page_text(spark):
    given = ["<p>a</p>b", "x<!-- <p> y -->z", "<SCRIPT a='b'>var t = '</p>';</Script >k<style>p{}</style>", "a&amp;b&#39;c & d", "<p unended", "<script>never ended", "a < b", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, html string").orderBy("i")
    got = [r[0] if r[0] is None else r[0].split() for r in rows.select(langid.page_text(F.col("html"))).collect()]
    assert got == [["a", "b"], ["x", "z"], ["k"], ["a", "b", "c", "&", "d"], ["<p", "unended"], [], ["a", "<", "b"], [], None]


def test_without_declared_languages_or_rows(spark):
    docs = frame(spark, ["some text", None])
    assert [r["kept"] for r in langid.identify(docs).collect()] == [False, False]
    assert langid.identify(docs.limit(0), declared=F.col("lang")).count() == 0


def test_gram_sums_match_a_plain_count():
    from lodestar.llm import bytegrams

    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 1, 3, 4, 5, 50, 2)]
    weights = rng.normal(size=(2, 1 << 10))
    hashed = lambda b: (int.from_bytes(b, "little") * 2654435761 % (1 << 32)) >> 22
    sums, n = bytegrams.sums(texts, 10, weights)
    total = np.zeros(1 << 10)
    for i, t in enumerate(texts):
        grams = [hashed(t[k : k + 4]) for k in range(len(t) - 3)]
        assert n[i] == len(grams) and np.allclose(sums[i], weights[:, grams].sum(axis=1))
        np.add.at(total, grams, 1)
    assert (bytegrams.counts(texts, 10) == total).all()
