import random

from cases import documents, odd_texts, of, prose, words

from busline.llm import banding


def grams(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else text or ""


def brute(texts):
    sets = [grams(t) for t in texts]

    def linked(a, b):
        if isinstance(a, str) or isinstance(b, str):
            return a == b and type(a) is type(b)
        return 10 * len(a & b) >= 8 * len(a | b)

    links = [{j for j in range(len(sets)) if j != i and linked(sets[i], sets[j])} for i in range(len(sets))]
    label = list(range(len(sets)))
    while True:
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(sets))]
        if new == label:
            return links, label
        label = new


def near_copies(rng, n, count):
    base = prose(rng, n).split()
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


def test_links_and_classes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    texts = [*odd_texts(rng), "One, TWO", "", *near_copies(rng, 120, 60), *near_copies(rng, 40, 10), *[prose(rng, 60)] * 5, *(prose(rng, 50) for _ in range(20))]
    links, label = brute(texts)
    for block in (512, 16):  # one block a bucket, and several
        monkeypatch.setattr(banding, "BLOCK_ROWS", block)
        got = of(banding.link(documents(spark, texts)))
        assert [got[i].n_links for i in range(len(texts))] == [len(s) for s in links]
        assert [got[i].class_id for i in range(len(texts))] == label
    kept = banding.keep_first(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label)) and kept.columns[:2] == ["doc_id", "text"]


def test_repeated_rows_and_null_ids(spark):
    text = "one two three four five six"
    rows = [(None, text), (None, text), (3, text), (3, text), (4, None), (5, ""), (6, "other words that are quite different")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.n_links for r in banding.link(docs).collect()) == [0, 1, 1, 3, 3, 3, 3]
    assert sorted(r.doc_id for r in banding.keep_first(docs).collect()) == [3, 4, 6]
    assert banding.link(docs.limit(0)).count() == 0


def test_banding_reaches_its_recall():
    for similarity in (0.5, 0.7, 0.8, 0.9):
        bands, rows = banding.banding(similarity, 0.99)
        assert 1 - (1 - similarity**rows) ** bands >= 0.99 and bands * rows <= banding.MOST_HASHES
    assert banding.banding(1.0) == (1, 1)


def test_components_of_long_chains(spark):
    pairs = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("a", "b"), ("b", "a"), ("c", "c")]
    got = {r.node: r.root for r in banding.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {**{f"{i:03d}": "000" for i in range(1, 61)}, "b": "a"}
