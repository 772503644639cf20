import hashlib
import random

import pytest
from cases import SCHEMA, documents, odd_texts
from pyspark.sql import functions as F

from busline.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])])


def ascend(values):
    """Sort keys with nulls first, texts bytewise."""
    return [(v is not None, v.encode() if isinstance(v, str) else v) for v in values]


def climb(level, fanout):
    """(root, for each leaf its siblings' hashes level by level)."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i - i % fanout
            paths[k] += [level[j] for j in range(first, min(first + fanout, len(level))) if j != i]
        at = [i // fanout for i in at]
        level = [h(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows, fanout):
    leaves = sorted(((r["lang"], r["doc_id"], leaf(r)) for r in rows), key=lambda x: (*ascend(x[:2]), x[2]))
    langs = sorted({x[0] for x in leaves}, key=lambda x: ascend([x]))
    trees = [climb([x[2] for x in leaves if x[0] == lang], fanout) for lang in langs]
    root, tops = climb([t[0] for t in trees], fanout) if trees else ("", [])
    out = []
    for lang, (subroot, paths), top in zip(langs, trees, tops, strict=True):
        for (_, key, own), path in zip([x for x in leaves if x[0] == lang], paths, strict=True):
            out.append((key, lang, own, subroot, root, "".join(path + top)))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_equals_plain_python(spark, fanout):
    rng = random.Random(fanout)
    texts = [*odd_texts(rng), *("x" * k for k in range(25))]
    rows = [(None if k % 11 == 5 else k % 29, t, rng.choice(["en", "de", None, "é", ""]), rng.choice([None, "s1"]), None if k % 7 == 3 else len(t or "")) for k, t in enumerate(texts)]
    rows += rows[:3]  # repeated rows
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    # extra columns with the names of helpers
    clash = docs.select("*", *[F.lit("x").alias(c) for c in ("g", "i", "n", "hash", "sib", "path", "place", "part", "number", "total", "leaf", "name", "key")])
    got = merkle.manifest(clash, fanout=fanout).collect()
    plain = [r.asDict() for r in docs.collect()]
    assert sorted(((r.doc_id, r.lang, r.leaf, r.subroot, r.root, r.path) for r in got), key=str) == brute(plain, fanout)
    assert all(r.folded == r.root for r in got)


def test_tampered_rows_do_not_fold_to_the_root(spark):
    docs = documents(spark, [f"text {k}" for k in range(30)])
    bad = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    changed = merkle.leaf_of(*[bad if f == "text" else F.col(f) for f in merkle.FIELDS])
    got = merkle.manifest(docs, carry={"changed": changed}).collect()
    assert len(got) == 30 and all((r.folded == r.root) == (r.doc_id % 4 != 0) for r in got)


def test_small_trees(spark):
    docs = documents(spark, ["only"])
    row = merkle.manifest(docs).first()
    assert row.leaf == row.subroot == row.root == row.folded and row.path == ""
    assert merkle.manifest(docs.limit(0)).count() == 0
    # every group a single leaf: only the tree over the groups
    langs = documents(spark, ["a", "b", "c"]).withColumn("lang", F.col("text"))
    assert sorted(((r.doc_id, r.lang, r.leaf, r.subroot, r.root, r.path) for r in merkle.manifest(langs).collect()), key=str) == brute(
        [r.asDict() for r in langs.collect()], 2)
