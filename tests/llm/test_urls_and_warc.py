import random
import re

from pyspark.sql import functions as F

from lodestar.llm import urlfilter, urls, warc


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def plain_rule(host, path):
    best = None
    for _, rule in urlfilter.RULES:
        domain, rest = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best)):
            best = rule
    return best


URLS = [None, "", "x", "http://", "http://com/", "http://COM", "http://a.com", "http://a.com/", "http://xcom/", "https://Example.com/en/1", "https://www.example.com/en/", "http://m.www.example.com/en/x?y", "http://b.net/es/1#t", "http://net/fr/", "http://b.net/de", "ftp://É.com:80/ü", "a://b://c.com/", "http://x.com?q=/en/", "http://x.com/#a", "http://q.net/p\nz", "mailto:a@b"]


def pages(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("block", F.lit("x")).withColumn("listed", F.lit(0))


def test_rules_list_and_edge_cases(spark):
    rng = random.Random(1)
    many = [f"http://{rng.choice(['', 'www.'])}h{rng.randrange(40)}.org/p{rng.randrange(30)}{rng.choice(['', '/', '?utm_source=x', '?a=1&utm_x=2', '#f'])}" for _ in range(600)]
    values = [*URLS, *many, *["http://hot.org/one"] * 300]
    listed = spark.createDataFrame([(u,) for u in [*many[::5], "https://hot.org/one/", None, "nothing"]], "url string")
    rows = {r["page_id"]: r for r in urlfilter.judged(pages(spark, values), listed).collect()}
    assert len(rows) == len(values)
    canonical = dict(enumerate(r[0] for r in pages(spark, values).orderBy("page_id").select(urls.canonical(F.col("url"))).collect()))
    bad = {canonical[len(URLS) + i] for i in range(0, 600, 5)} | {"hot.org/one"}
    for i, u in enumerate(values):
        r = rows[i]
        assert (r["host"], r["path"]) == plain_host_path(u)
        rule = plain_rule(r["host"], r["path"])
        assert r["rule"] == rule and r["listed"] == (canonical[i] in bad)
        verdicts = {rule: verdict for verdict, rule in urlfilter.RULES}
        assert r["verdict"] == (verdicts[rule] if rule else "block" if canonical[i] in bad else "allow")
    assert sum(rows[i]["verdict"] == "block" for i in range(len(values) - 300, len(values))) == 300
    assert urlfilter.judged(pages(spark, values), listed.limit(0)).where("listed").count() == 0
    assert urlfilter.judged(pages(spark, values).limit(0), listed).count() == 0


def test_a_full_filter_only_adds_work(spark, monkeypatch):
    """With one block for hundreds of URLs nearly all are possible hits; the exact join still removes false ones."""
    monkeypatch.setattr(urlfilter, "MOST_BLOCKS", 1)
    df = pages(spark, [f"http://a.org/{i}" for i in range(2000)])
    out = urlfilter.judged(df, df.where("page_id % 4 = 0").select("url"))
    assert sorted(r["page_id"] for r in out.where("listed").collect()) == list(range(0, 2000, 4))


def test_the_filter_holds_all_keys_and_few_others(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("canonical"))
    blocks, n = urlfilter.bloom_filter(keys)
    probe = spark.range(20_000).select("id", F.concat(F.lit("k"), "id").alias("canonical")).withColumn("block", urlfilter.block(F.col("canonical"), n)).join(blocks, "block")
    held = F.lit(True)
    for w, bit in enumerate(urlfilter.bits(F.col("canonical"))):
        held = held & (F.col(f"w{w}").bitwiseAND(bit) != 0)
    hit = {r["id"] for r in probe.where(held).collect()}
    assert set(range(4000)) <= hit and len(hit) < 4000 + 160


def test_canonical_forms(spark):
    forms = {"HTTP://Www.A.com:80/x/": "www.a.com/x", "https://a.com:443": "a.com", "http://a.com/x?utm_a=1#f": "a.com/x", "http://a.com/?utm_a=1&b=2&utm_c=3": "a.com?b=2", "a.com/x": None}
    df = spark.createDataFrame([(u,) for u in forms], "url string")
    assert {r[0]: r[1] for r in df.select("url", urls.canonical(F.col("url"))).collect()} == forms


RECORD = "record_id long, kind string, url string, ts long, etag string, digest string, headers map<string,string>"


def plain_resolve(rows, canonical):
    out = {}
    for rid, kind, url, ts, etag, digest, headers in rows:
        if kind != "revisit":
            continue
        key = canonical.get(url)
        before = [r for r in rows if r[1] == "response" and key is not None and ts is not None and r[3] is not None and canonical.get(r[2]) == key and r[3] < ts]
        if not before:
            out[rid] = ("orphan", None, None)
            continue
        s = max(before, key=lambda r: (r[3], r[0]))
        if any(a is not None and b is not None and a != b for a, b in ((etag, s[4]), (digest, s[5]))):
            out[rid] = ("mismatch", s[0], None)
        else:
            out[rid] = ("resolved", s[0], {**(s[6] or {}), **{k: v for k, v in (headers or {}).items() if k in warc.PERMITTED}})
    return out


def test_revisits_against_a_plain_search(spark):
    rng = random.Random(2)
    names = ["http://a.com/x", "https://a.com/x/", "http://a.com/x?utm_a=1", "http://b.com", "nowhere", None]
    canonical = {"http://a.com/x": "a.com/x", "https://a.com/x/": "a.com/x", "http://a.com/x?utm_a=1": "a.com/x", "http://b.com": "b.com"}
    rows = []
    for i in range(700):
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        url = rng.choices(names, [60, 10, 10, 15, 3, 2])[0]  # one URL holds most of the records
        headers = rng.choice([None, {}, {"date": str(i), "server": "edge"}, {"etag": "n", "content-length": "0"}, {"content-type": "t", "date": "d"}])
        rows.append((i, kind, url, rng.choice([None, *range(0, 900, 3)] if rng.random() < 0.05 else list(range(0, 900, 3))), rng.choice(["e1", "e1", None, "e2"]), rng.choice(["d1", "d1", None]), headers))
    want = plain_resolve(rows, canonical)
    df = spark.createDataFrame(rows, RECORD)
    for spans in (1, 16, 256):
        got = {r["record_id"]: (r["status"], r["source_id"], r["headers"]) for r in warc.resolved(df.withColumn("span", F.lit(1)).withColumn("near", F.lit(2)), spans).collect()}
        assert got == want
    assert {s for s, _, _ in want.values()} == {"resolved", "mismatch", "orphan"}
    assert warc.resolved(df.limit(0)).count() == 0 and warc.resolved(df.where("kind = 'response'")).count() == 0
