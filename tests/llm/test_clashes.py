"""Input columns with the names that operators use for their own work: kept, and without effect."""

import random

import pytest
from cases import documents, odd_texts, prose
from pyspark.sql import functions as F

from busline.llm import banding, bayes, pii, postings, quotes, setsketch, votes, winnow

NAMES = ["_lines", "_body", "_bare", "_s", "_r", "_w", "_spans", "_id", "_key", "_own", "_words", "_hashes", "_sorted", "_found", "_base", "_m0", "_g0", "_l0",
         "_e0", "_rest", "_rows", "_starts", "own", "quoted", "units", "text_key", "windows", "votes", "set_key", "id", "key", "row", "doc", "a.b", "first", "last"]


def texts():
    rng = random.Random(3)
    return [*odd_texts(rng), *[prose(rng, 90)] * 2, "mail me@x.org or call +1 202 555 0123 now", "\n".join(["same line of words " + prose(random.Random(1), 60)] * 3)]


def clashing(df, names=NAMES):
    return df.select("*", *[F.lit(f"kept {n}").alias(n) for n in names if n not in df.columns])


OPERATORS = {
    "dedup_lines": winnow.dedup_lines,
    "counted": votes.counted,
    "keep_good": votes.keep_good,
    "redact": pii.redact,
    "keep_first": banding.keep_first,
    "keep_clean": lambda docs: postings.keep_clean(docs, docs.sparkSession.createDataFrame([(1, prose(random.Random(9), 20))], "item_id long, text string")),
    "near_duplicates": setsketch.keep_first,
}


def rows_of(df, columns):
    return sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name_stay(spark, name):
    docs = documents(spark, texts()).persist()
    plain = OPERATORS[name](docs)
    more = OPERATORS[name](clashing(docs))
    assert rows_of(more, plain.columns) == rows_of(plain, plain.columns)
    kept = [n for n in NAMES if n not in plain.columns]
    assert set(kept) <= set(more.columns) and all(r[n] == f"kept {n}" for r in more.collect() for n in kept)


def test_quotes_keep_columns_of_any_name(spark):
    rows = [(1, 0, "user", "First message of words"), (1, 1, "assistant", "> First message of words\nAn answer"), (1, None, None, None), (None, 0, "user", "x")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain, more = quotes.link(messages), quotes.link(clashing(messages))
    assert rows_of(more, plain.columns) == rows_of(plain, plain.columns)
    assert all(r["_rows"] == "kept _rows" for r in more.collect())


def test_obfuscated_addresses_of_many_labels_are_one_span(spark):
    text = "write me(at)a.b.c.d.e.f.g.h.i.j.k.l soon"
    found = pii.candidates(spark.createDataFrame([(text,)], "text string")).first()["_found"]
    assert [text[c.start:c.end] for c in found if not c.base] == ["me(at)a.b.c.d.e.f.g.h.i.j.k.l"]
