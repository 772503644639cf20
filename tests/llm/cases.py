"""Small documents with the cases that every operator must bear."""

import random
import re

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghiou") for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd_texts(rng):
    """Null, empty and blank texts, ties, repeats, other scripts and a long text."""
    long = "\n".join(prose(rng, 30) for _ in range(60))
    return [None, "", " \n\t", "a", "One two", "日本語 テキスト ü", "x\n" * 40, long, long, "é" * 300, prose(rng, 80), prose(rng, 80)]


def of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
