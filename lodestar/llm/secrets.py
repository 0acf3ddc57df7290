"""Secret scans: base patterns, and character Markov models of random strings and ordinary identifiers (operator 2)."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.spans import Span
from lodestar.session import table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# a run that is too short fails as a whole, and so does every shorter end of it: the bounds can stand in the patterns
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
CODES = np.full(128, len(ALPHABET), np.int64)
CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

# fixed values: common parts of identifiers and words
PARTS = """
account action active add address admin after agent all allow analysis and answer app application apply are area argument
array assert async attribute audio author auto available back background base batch before begin between binary block body
book bool border bottom bound box branch buffer build bundle button by byte cache call callback cancel card case category
cell center chain change channel char check child class clean clear click client clock close cluster code collect color
column command comment commit common compare complete component compute config connect constant container content context
control convert copy core count create current cursor custom data database date day debug decode default define delete
depth describe design detail device dialog dict digit directory disable display distance document domain done double down
download draw driver drop edit element email empty enable encode end engine entry enum error event example exception
execute exist exit expand expect export expression extend extension factory feature fetch field file fill filter final find
first flag float flush folder font for format forward frame free from function future game general generate get global graph
great group handle handler hash have head header height help hidden history home host hour icon identifier image import in
index info init inner input insert instance int interface internal is item iterator job join json jump key keyboard kind
label language last layer layout left length level library license light limit line link list listener load local location
lock log login loop machine main make manager map margin mark mask master match matrix max maximum media member memory menu
merge message metadata method middle min minute mobile mode model module month mouse move multiple name network new next
node normal not note notify null number object of offset old on open operation option or order other out output over
override package padding page panel paragraph parameter parent parse part password path pattern pause people phone picture
pixel place platform play player plugin point policy pool popup port position post power prefix prepare present press
preview previous price print private process product profile program progress project property protocol provider public
push put quality query queue quick random range rate read ready receive record recover reference refresh region register
release remote remove render repeat replace report repository request require reset resize resource response rest result
return right role root rotate route row rule run runtime safe sample save scale scan schedule schema scope screen script
scroll search second section select selector send sequence server service session set settings setup shape share show
shutdown side signal simple single site size slice sort source space special split stack standard start state static status
step stop storage store stream string strong style subject submit success suffix summary support switch symbol sync system
tab table tag target task template test text that the their theme thing thread this thumbnail time title to toggle token
tool top total touch trace track transaction transform translate tree trigger type under undo union unit unknown update
upload upper url usage user utility valid validate value variable vector version video view visible visit volume wait
warning watch weather web week weight when where which width window with without word work worker world wrap write year zone
""".split()


def labelled_samples(n: int, seed: int = 7) -> list[tuple[str, int]]:
    """n random strings (1) and n ordinary identifiers and run-together words (0), drawn by a seeded generator."""
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", string.ascii_letters + string.digits, ALPHABET, string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits]
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 64))), 1) for _ in range(n)]
    for _ in range(n):
        parts = rng.choices(PARTS, k=rng.randint(3, 7))
        style = rng.randrange(8)
        if style == 0:
            word = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif style == 1:
            word = "".join(p.capitalize() for p in parts)
        elif style in (2, 3):
            word = "_-"[style == 3].join(parts)
        elif style == 4:
            word = "_".join(parts).upper()
        elif style == 5:
            word = "/".join(parts) + rng.choice(["", f"-{rng.randint(0, 99)}", f"_{rng.randint(1990, 2030)}", "=" * rng.randint(1, 9), "-" * rng.randint(1, 30)])
        elif style == 6:  # a plain number names an order or an account; it is no key
            word = "".join(rng.choices(string.digits, k=rng.randint(16, 40)))
        else:
            word = "".join(parts)
        out.append((rng.choice([word, word, word.upper()]), 0))
    return out


def markov(strings: list[str], alpha: float = 0.1) -> np.ndarray:
    """Log probability of a character after another; the row before the first character is the last one."""
    n = len(ALPHABET)
    count = np.full((n + 1, n), alpha)
    for s in strings:
        codes = [n, *CODES[np.frombuffer(s.encode(), np.uint8)]]
        np.add.at(count, (codes[:-1], codes[1:]), 1)
    return np.log(count / count.sum(axis=1, keepdims=True))


def train(samples: list[tuple[str, int]]) -> np.ndarray:
    """Log-likelihood ratio of each pair of characters: random string over ordinary identifier."""
    return markov([s for s, y in samples if y == 1]) - markov([s for s, y in samples if y == 0])


def ratio(token: str, weights: np.ndarray) -> float:
    """Total log-likelihood ratio of a token."""
    codes = CODES[np.frombuffer(token.encode(), np.uint8)]
    return float(weights[-1, codes[0]] + weights[codes[:-1], codes[1:]].sum())


def base_spans(text: str) -> list[Span]:
    """Base matches by start, then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find(text: str, weights: np.ndarray, least: float) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base ones and tokens outside them whose ratio is at least `least`."""
    base = base_spans(text)
    more = [("random", m.start(), m.end()) for m in TOKEN.finditer(text) if ratio(m[0], weights) >= least and not any(s < m.end() and m.start() < e for _, s, e in base)]
    return base, sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, samples: list[tuple[str, int]] | None = None, least: float = 18.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: id_col, base and found, arrays of (kind, start, end) by start, then kind.

    `samples` are labelled strings (1: random, 0: ordinary) that train the two models; the default ones are drawn by
    rule. A null text counts as empty and has no spans; a null id stays null; repeated rows are scanned row by row; long texts are scanned
    whole; spans that start together are in the order of their kinds; an empty table gives no rows; other columns are ignored.
    """
    weights = train(labelled_samples(3_000) if samples is None else samples)  # about 70 x 70, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t or "", shared.value, least) for t in batch.column(1).to_pylist()]
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[k]] for f in found], span) for k in (0, 1)]
            yield pa.record_batch([batch.column(0), *lists], names=["id", "base", "found"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, f"id long, base {kind}, found {kind}").withColumnRenamed("id", id_col)


def joined_spans(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans; also n_random."""
    found = scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(n(k) for k in KINDS[:3]), F.sha2(joined_spans("base"), 256).alias("base_sha256"), joined_spans("found").alias("spans"), n("random"))
