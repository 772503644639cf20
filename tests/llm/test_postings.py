import hashlib
import random

from cases import documents, odd_texts, of, prose, words
from pyspark.sql import functions as F

from busline.llm import postings


def brute(texts, items, width=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + width]), set()).add(item)
    out = {}
    for d, text in enumerate(texts):
        w, hit, held = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found is not None:
                    hit |= set(range(i, i + n))
                    held |= found
        names = ",".join(sorted(str(h) for h in held if h is not None))
        out[d] = (len(w), len(hit), len([h for h in held if h is not None]), hashlib.sha256(names.encode()).hexdigest(),
                  len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    item = prose(rng, 40)
    w = item.split()
    texts = [*odd_texts(rng), item.upper(), prose(rng, 300) + " " + " ".join(w[3:16]) + ". " + prose(rng, 5),
             " ".join(w[:12]), "one two", "zero, ONE-two; one two", prose(rng, 20) + " " + item + " " + item]
    items = [(7, item), (8, "One two"), (9, None), (10, ""), (11, prose(rng, 20)), (12, item), (None, " ".join(w[20:34])), (7, item)]
    docs = documents(spark, texts).withColumn("count", F.lit(1)).withColumn("term", F.lit("x"))
    got = of(postings.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")))
    want = brute(texts, items)
    assert {d: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for d, r in got.items()} == want
    kept = postings.keep_clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, r in want.items() if not r[4]] and kept.columns == docs.columns


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (1, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_hit) for r in postings.decontaminate(docs, items).collect())
    assert got == [(0, 2), (1, 0), (1, 2), (1, 2)]
    assert postings.keep_clean(docs, items).count() == 1


def test_phrase_and_proximity_positions(spark):
    docs = documents(spark, ["the cat sat on the mat", "mat the on sat cat", "the mat", "on the mat the mat", None])
    index = postings.build(docs)
    ask = spark.createDataFrame([(["the", "mat"],), (["no", "mat"],)], "phrase array<string>")
    got = {r.doc_id: (r["first"], r["last"]) for r in postings.phrase_matches(index, ask).collect()}
    assert got == {0: ([4], [5]), 2: ([0], [1]), 3: ([1, 3], [2, 4])}
    near = {r.doc_id: list(zip(r["first"], r["last"])) for r in postings.proximity_matches(
        index, spark.createDataFrame([(["cat", "mat"],)], "phrase array<string>"), 5).collect()}
    assert near == {0: [(1, 5)], 1: [(0, 4)]}
    assert postings.proximity_matches(index, spark.createDataFrame([(["cat", "mat"],)], "phrase array<string>"), 4).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert postings.decontaminate(documents(spark, []), none).count() == 0
    assert [r.n_hit for r in postings.decontaminate(documents(spark, ["a b"]), none).collect()] == [0]
