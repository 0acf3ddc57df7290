import hashlib
import random

import numpy as np
import pytest

from lodestar.llm import fingerprint as fp
from tests.llm.helpers import AWKWARD, frame, prose


def test_syncmers_by_definition_and_context_free():
    rng = random.Random(1)
    text = prose(rng, 60)
    at, hashed = fp.syncmers(text, 16, 10)
    inner = fp.windows(np.array([ord(c) for c in text], np.uint64), 10)
    want = [i for i in range(len(text) - 15) if min(inner[i], inner[i + 6]) == inner[i : i + 7].min()]
    assert at.tolist() == want
    for i, h in zip(at.tolist()[:20], hashed.tolist()):
        alone = fp.syncmers("??" + text[i : i + 16] + "!!", 16, 10)
        assert h in alone[1].tolist()  # chosen wherever it stands


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    text = prose(random.Random(2), 500)
    whole = fp.fingerprint(text, 16, 10, 64)
    monkeypatch.setattr(fp, "BLOCK", 97)
    assert fp.fingerprint(text, 16, 10, 64) == whole


def test_likeness():
    rng = random.Random(3)
    a, b = prose(rng, 300), prose(rng, 300)
    f = lambda t: fp.fingerprint(t, 16, 10, 64)
    assert fp.likeness(f(a), f(a), 64) == 1 and fp.likeness([], [], 64) == 1 and fp.likeness(f(a), [], 64) == 0
    assert fp.likeness(f(a), f(b), 64) < 0.1 < 0.35 < fp.likeness(f(a), f(a[: 2 * len(a) // 3] + b[: len(a) // 3]), 64) < 0.8
    half = len(a) // 2
    assert fp.likeness(f(a), f(a[half:] + a[:half]), 64) < 0.75  # the same anchors, but not in step


def test_a_passage_keeps_its_anchors_in_a_long_text(spark):
    """A passage of 60 words in 20,000: nearly all of its anchors are in the fingerprint, in the same order."""
    rng = random.Random(6)
    passage = prose(rng, 60)
    text = prose(rng, 10_000) + " " + passage + " " + prose(rng, 10_000)
    whole, part = dict(fp.fingerprint(text, 16, 10)), fp.fingerprint(passage, 16, 10)
    assert len(part) > 60 and all(a in whole for a, _ in part)
    at, hashed = fp.syncmers(text, 16, 10)
    assert whole.keys() == set((hashed >> np.uint64(32)).tolist()) and all(text[whole[a] :].startswith(passage[p : p + 16]) for a, p in part)
    assert 0 < fp.likeness(fp.fingerprint(text, 16, 10), part) == fp.likeness(part, fp.fingerprint(text, 16, 10))
    rows = dict(fp.compare_with_next(frame(spark, [passage, text])).select("doc_id", "near_next").collect())
    assert rows[0] > 0 and rows[1] == rows[0]
    assert dict(fp.fingerprints(frame(spark, [passage, text])).collect()) == {0: fp.spelled(part), 1: ",".join(f"{a:08x}:{p}" for a, p in whole.items())}
    some = fp.fingerprint(text, 16, 10, 16)
    assert 0.2 < len(some) / len(whole) < 0.3 and set(some) <= set(whole.items())


@pytest.mark.parametrize("ranges", [1, 7, 1000])
def test_next_documents(spark, monkeypatch, ranges):
    rng = random.Random(4)
    texts = [*AWKWARD, *(prose(rng, rng.randint(1, 60)) for _ in range(50)), "twin", "twin"]
    docs = frame(spark, texts, "span ghost tie")
    monkeypatch.setattr(fp.followed, "__defaults__", (ranges, 100_000))
    rows = {r["doc_id"]: r for r in fp.compare_with_next(docs.repartition(5)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""  # descending; the first of all follows the last
        third = len(t) // 3
        changed = t[: len(t) - third] + following[:third]
        assert (rows[i]["n_chars"], rows[i]["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert rows[i]["fingerprint"] == fp.spelled(fp.fingerprint(t, 16, 10, 64)) and rows[i]["edited_fingerprint"] == fp.spelled(fp.fingerprint(changed, 16, 10, 64))
        assert rows[i]["near_next"] == fp.likeness(fp.fingerprint(t, 16, 10, 64), fp.fingerprint(following, 16, 10, 64), 64)
    assert rows[len(texts) - 1]["fingerprint"] == rows[len(texts) - 2]["fingerprint"]


def test_few_rows_nulls_and_repeats(spark):
    docs = frame(spark, ["only this one text here"])
    assert fp.compare_with_next(docs.limit(0)).count() == 0
    assert [r["near_next"] for r in fp.compare_with_next(docs).collect()] == [1.0]
    many = spark.createDataFrame([(1, "a b c")] * 5 + [(None, "x"), (2, None)], "doc_id long, text string")
    assert fp.compare_with_next(many).count() == 7
    assert fp.fingerprints(many).count() == 7


@pytest.mark.parametrize("few", [3, 2_000])
def test_large_and_hot_ids(spark, monkeypatch, few):
    """Ids that doubles cannot tell apart, one id on a third of the rows and nulls on another third: every row has its follower."""
    monkeypatch.setattr(fp.followed, "__defaults__", (few, 100_000))
    top = (1 << 63) - 1
    ids = [top - i for i in range(40)] + [(1 << 60) + i for i in range(40)] + [5] * 90 + [-(1 << 63)] * 3 + [None] * 90
    rows = [(d, f"{i % 80} words of text" if d in (5, None) else f"a text of number {i}") for i, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {r["text"]: r["tie"] for r in docs.selectExpr("text", "xxhash64(text) as tie").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = [(d, hashlib.sha256(fp.edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order)]
    got = [tuple(r) for r in fp.compare_with_next(docs.repartition(5)).select("doc_id", "edited_sha256").collect()]
    plain = lambda rows: sorted((d is None, d or 0, h) for d, h in rows)
    assert plain(got) == plain(want)
    hot = fp.followed(docs).where("not ghost and (none or doc_id = 5)").groupBy("span").count()
    assert few > 3 or max(r["count"] for r in hot.collect()) <= 20  # of 90 each


def test_edited_anchors_are_those_of_the_edited_text():
    """Found from both texts' anchors and the seam, for texts shorter than a k-mer too."""
    rng = random.Random(7)
    texts = [*(t or "" for t in AWKWARD), *("".join(rng.choices("ab", k=rng.randint(0, 70))) for _ in range(400)), *(prose(rng, rng.randint(1, 40)) for _ in range(40))]
    rng.shuffle(texts)
    for keep in (64, 16):
        for one, two in zip(texts, texts[1:]):
            own, after = fp.found(one, 16, 10, keep), fp.found(two, 16, 10, keep)
            other = fp.edited_anchors(own, after, one, two, 16, 10, keep)
            assert other.tolist() == fp.found(fp.edited(one, two), 16, 10, keep).tolist()
            plain = fp.likeness(fp.fingerprint(one, 16, 10, keep), fp.fingerprint(fp.edited(one, two), 16, 10, keep), keep)
            assert fp.alike(fp.first(own), fp.first(other)) == plain


def test_little_is_shuffled_and_sorted_at_once(spark, monkeypatch):
    """Texts go compressed, of equal ids one row a batch goes twice, and many rows are sorted in more tasks than the session's."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i // 50, f"{i} {prose(rng, 300)}") for i in range(2_000)], "doc_id long, text string").repartition(2)
    monkeypatch.setattr(fp.followed, "__defaults__", (50, 100_000))
    dealt = fp.followed(docs)
    kinds = dict(dealt.dtypes)
    sent = sum(len(r["packed"]) for r in dealt.select("packed").collect())
    assert kinds["packed"] == "binary" and sent < 0.5 * docs.selectExpr("sum(octet_length(text)) as n").first()["n"]
    spans = dealt.select("span").distinct().count()
    assert spans > 30 and dealt.where("ghost").count() <= 2 * spans  # one from each of two tasks
    assert dealt.rdd.getNumPartitions() == -(-spans // fp.RANGES_A_TASK) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fp.compare_with_next(docs).count() == 2_000
    for text in [*AWKWARD, *("ab" * n + "c" * m for n in range(20) for m in range(20))]:  # some as long as when compressed
        packed, size = fp.packs(fp.pa.array([text or ""]))
        assert fp.unpacked(packed[0].as_py(), size[0].as_py()) == (text or "")
