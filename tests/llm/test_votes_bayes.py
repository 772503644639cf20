import collections
import random
import re

from cases import documents, odd_texts, of, prose
from pyspark.sql import functions as F

from busline.llm import bayes, votes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [*odd_texts(rng), "a b c a b c", "x y z\n\n x y z\nx y z", "# * $ % & | < > !", "a a a a", "a b c", "\x0b\x0c\x1cw"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    got = of(votes.counted(documents(spark, texts).withColumnRenamed("lang", "n_words")))
    assert [tuple(got[i][c] for c in votes.COUNTS) for i in range(len(texts))] == [counts(t) for t in texts]


def fleet(rng):
    good = [". ".join("the " + prose(rng, 9) + " of " + prose(rng, 2) for _ in range(8)) + "." for _ in range(120)]
    noisy = [" ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in prose(rng, 90).split()) for _ in range(15)]
    loud = [" ".join(w.upper() + "!!" for w in prose(rng, 90).split()) for _ in range(10)]
    return good, noisy + loud


def test_votes_find_junk_and_keep_prose(spark):
    good, junk = fleet(random.Random(3))
    docs = documents(spark, good + junk + ["short text", None])
    kept = {r.doc_id for r in votes.keep_good(docs).collect()}
    assert kept == set(range(len(good)))
    rated = votes.voted(votes.counted(docs))
    judged = of(votes.judged(rated, votes.fit(rated)))
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in judged.values())
    assert {d for d, r in judged.items() if r.kept} == kept
    assert votes.keep_good(docs.limit(0)).count() == 0 and votes.keep_good(docs).columns == docs.columns


def test_bayes_learns_from_labels_and_sites(spark):
    rng = random.Random(4)
    good, junk = fleet(rng)
    docs = documents(spark, good + junk + [None]).withColumn("source", F.when(F.col("doc_id") == 0, None).otherwise(F.col("source")))
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(0, len(good + junk), 2)] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = of(bayes.classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")))
    held_out = [i for i in range(1, len(good + junk), 2)]
    assert sum(got[i].kept == (i < len(good)) for i in held_out) >= 0.97 * len(held_out)
    assert len(got) == len(good + junk) + 1
    nothing = bayes.classify(docs, labels.limit(0), F.col("source"), F.col("lang")).select("evidence").distinct().collect()
    assert [r.evidence for r in nothing] == [0.0]
    assert bayes.classify(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink_towards_the_level_above(spark):
    groups = spark.createDataFrame([(1000, 900.0), (1000, 300.0), (2, 0.0)], "n long, good double")
    assert bayes._strength(groups, F.lit(0.6)) < 20
    alike = spark.createDataFrame([(1000, 600.0)] * 5, "n long, good double")
    assert bayes._strength(alike, F.lit(0.6)) > 900
