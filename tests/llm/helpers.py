import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, more="", **cols):
    """documents from texts; ids follow their place. `more` adds columns whose names clash with the operators' own."""
    rows = [(i, t, (cols.get("lang") or ["en"] * len(texts))[i], (cols.get("source") or ["s"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in more.split():
        df = df.withColumn(name, F.lit("x"))
    return df


def prose(rng: random.Random, words: int, syllables=("an", "the", "er", "ing", "on", "re", "tion", "st", "ou", "ea")) -> str:
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words))


AWKWARD = [None, "", " ", "\n\n\t", "a", "\x00", "é" * 5, "İstanbul ſ K ß", "<|endoftext|> x", "x" * 30_000, "1" * 5_000, "@" * 300, "+" * 300, "a b " * 4_000, "  \x1c z", "😀 token=\"abcdefgh\""]
