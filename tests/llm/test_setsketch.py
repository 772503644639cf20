import random
import re

import numpy as np
import pytest
from cases import LOWER, documents, odd_texts, of, prose
from pyspark.sql import functions as F

from busline.llm import setsketch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    sets = [grams(t) for t in texts]
    label = list(range(len(sets)))
    links = [[j for j in range(len(sets)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])] for i in range(len(sets))]
    while True:
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(sets))]
        if new == label:
            return sets, label
        label = new


def near_copies(rng, n, count, edits):
    base = prose(rng, n).split()
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("rows", [1024, 16])
def test_components_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", rows)  # one block a bucket, and several
    rng = random.Random(rows)
    texts = [*odd_texts(rng), "One TWO", "one\x0btwo", "", *near_copies(rng, 120, 60, 4), *near_copies(rng, 40, 10, 2), *[prose(rng, 60)] * 5,
             *near_copies(rng, 400, 20, 12), *(prose(rng, 50) for _ in range(20))]
    sets, label = brute(texts)
    clash = documents(spark, texts).select("*", *[F.lit("x").alias(c) for c in ("id", "key", "id_", "key_", "row", "set_key", "least", "kept", "component_id", "worded")])
    got = of(setsketch.link(clash))
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == label
    assert [got[i].kept for i in range(len(texts))] == [i == c for i, c in enumerate(label)]
    kept = setsketch.keep_first(clash)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label)) and kept.columns == clash.columns


def test_repeated_rows_and_null_ids(spark):
    text = "one two three four five six"
    rows = [(None, text), (None, text), (3, text), (3, text), (4, None), (5, ""), (None, "other words"), (6, "words that are quite different")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in setsketch.link(docs).collect()), key=str) == sorted([
        (None, 3, False), (None, 3, False), (3, 3, True), (3, 3, True), (4, 4, True), (5, 5, True), (None, None, True), (6, 6, True)], key=str)
    assert sorted((r.doc_id for r in setsketch.keep_first(docs).collect()), key=str) == [3, 4, 5, 6, None]
    assert setsketch.link(docs.limit(0)).count() == 0


def test_registers_merge_and_estimate_the_similarity():
    rng = np.random.default_rng(5)
    errors, collisions = [], []
    for similarity in (0.3, 0.6, 0.8, 0.85, 0.95):
        for _ in range(60):
            size = int(rng.integers(50, 3000))
            common = int(round(2 * size * similarity / (1 + similarity)))
            draw = rng.integers(0, 2**63, 2 * size - common, dtype=np.uint64)
            a, b = draw[:size], draw[size - common:]
            x, y = setsketch.sketch(a), setsketch.sketch(b)
            assert (setsketch.merged(x, y) == setsketch.sketch(draw)).all()
            true = common / len(draw)
            best, _ = setsketch.estimate(size, np.array([size]), np.array([(x > y).sum()]), np.array([(x < y).sum()]))
            errors.append(best[0] - true)
            collisions.append((x == y).mean() - true)
            if true >= setsketch.SHARE / 100:
                assert setsketch.possible(x, size, y[None, :], np.array([size])).all()
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    assert np.mean(collisions) > -0.01  # registers are equal at least as often as the sets are similar


def test_unlike_sets_are_ruled_out():
    rng = np.random.default_rng(6)
    x, y = (setsketch.sketch(rng.integers(0, 2**63, 500, dtype=np.uint64)) for _ in range(2))
    assert not setsketch.possible(x, 500, y[None, :], np.array([500])).any()
