"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Documents with equal sets of word n-grams form a variant; only variants are compared. Variants that agree in all rows of
a band share a bucket. Buckets with the same members are looked at once, and a pair is verified only in the first band in
which it agrees, so no pair is formed twice and none is emitted: a bucket is cut into blocks of bounded size, a task counts
the common n-grams of all pairs of one or two blocks, and returns one row per variant: its links, and the smallest
member of its connected part inside the task. Those rows give link counts and, by star contraction, classes.

Words are those of ``postings`` (A-Z lower-cased). A document of fewer words than the width is one n-gram. Documents
without words are linked when their texts are equal, null counting as empty. Repeated rows are documents of their own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.llm.common import beside, slices, stored, text_key
from busline.llm.postings import _word_bytes

WIDTH, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: A block holds about so many n-grams and variants.
BLOCK_GRAMS, BLOCK_ROWS = 200_000, 512


def banding(similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so the fewest false candidates, with the recall at that similarity.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands.
    """
    if similarity >= 1:
        return 1, 1
    fitting = [(bands, rows) for rows in range(1, most_hashes + 1)
               if (bands := math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))) * rows <= most_hashes]
    if not fitting:
        raise ValueError("the recall needs more hashes")
    return fitting[-1]


# --- n-gram sets ----------------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams."""
    table = _word_bytes()
    split = [t.encode("utf-8", "surrogatepass").translate(table).split() if t else [] for t in texts]
    coded = pa.array([w for part in split for w in part], pa.binary()).dictionary_encode()
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    flat = each[np.asarray(coded.indices)] if len(each) else np.zeros(0, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(parts[0]), len(parts), np.uint64)
        for p in parts:
            h = h * step + p
        return _mixed(h)

    grams = joined([flat[k:len(flat) - width + 1 + k] for k in range(width)]) if len(flat) >= width else flat[:0]
    at = 0
    for part in split:
        n = len(part)
        if n >= width:
            found = np.sort(grams[at:at + n - width + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        else:
            yield joined([flat[k:k + 1] for k in range(at, at + n)]) if n else flat[:0]
        at += n


def _sketch(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """(doc_id, text_key, set_key, grams, bands) of every document."""
    draw = np.random.default_rng(7)
    factor = draw.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    mask = draw.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def minima(grams: np.ndarray) -> np.ndarray:
        high, low = (grams >> np.uint64(32)).astype(np.uint32), np.full(len(mask), 2**32 - 1, np.uint32)
        for first in range(0, len(high), 2048):
            low = np.minimum(low, ((high[first:first + 2048, None] ^ mask) * factor).min(axis=0))
        h = np.arange(bands, dtype=np.uint64)
        for column in low.reshape(bands, rows).T:
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + column)
        return h.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(2)):
                keys, sizes, hashes = [], [], []
                for text, grams in zip(texts, gram_sets(texts, width), strict=True):
                    keys.append(hashlib.blake2b(grams.tobytes() if len(grams) else b"text " + (text or "").encode(
                        "utf-8", "surrogatepass"), digest_size=16).digest())
                    sizes.append(len(grams))
                    hashes.append(minima(grams) if len(grams) else None)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()),
                     pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "text_key", "set_key", "grams", "bands"])

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text").mapInArrow(
        run, "doc_id long, text_key binary, set_key binary, grams int, bands array<long>")


# --- verification ---------------------------------------------------------------------------------


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all pairwise intersections."""
    count = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column) > 1
    kept = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[kept]], owner[kept]
    common = np.zeros((count, count), np.float32)
    for first in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(column, [first, first + 2048])
        part = np.zeros((count, 2048), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        common += part @ part.T
    return common


def _parts(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each vertex's connected part."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(cell: pa.Table, similarity: float) -> pa.Table:
    cell = cell.sort_by("set_key")
    keys = cell.column("set_key").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in cell.column("gram_set").to_pylist()]
    block, band = np.asarray(cell.column("block")), cell.column("band")[0].as_py()
    first, second = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    sizes = np.array([len(s) for s in sets])
    common = _common(sets)
    linked = common >= np.ceil(similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6)
    np.fill_diagonal(linked, False)
    if first != second:
        linked &= block[:, None] != block[None, :]
    hashes = np.array(cell.column("bands").to_pylist(), np.int64)
    for k in range(band):  # seen in an earlier band
        linked &= hashes[:, None, k] != hashes[None, :, k]
    links = linked @ np.asarray(cell.column("copies")).astype(np.float64)
    roots = _parts(linked)
    some = np.flatnonzero(links > 0)
    return pa.table({"set_key": pa.array([keys[n] for n in some], pa.binary()),
                     "links": pa.array(links[some].astype(np.int64)),
                     "root": pa.array([keys[roots[n]] for n in some], pa.binary())})


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node's smallest connected node, by alternating large and small stars.

    Every round is a grouped minimum and a join; the edges of a round are written to the shared folder.
    """
    def stars(e: DataFrame, large: bool) -> DataFrame:
        # e holds each edge once, as (a larger node, a smaller one)
        sides = e.select(F.col("u").alias("x"), F.col("v").alias("y"))
        near = sides.union(sides.select("y", "x")) if large else sides
        least = near.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        joined = near.join(least, "x")
        if large:
            out = joined.filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("y").alias("u"), F.col("m").alias("v")).union(least.select(F.col("x"), F.col("m")))
        return out.filter("u <> v").distinct()

    current = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        new = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if new == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
        current = stored(stars(stars(current, True), False), "edges")


def link(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, n_links, n_copies, class_key, first.

    ``n_links`` counts the other documents whose n-gram sets have at least the similarity, copies included; ``n_copies``
    those with the same set. A class is what links connect; ``class_id`` is its smallest doc_id (null if it has
    none), ``class_key`` its key, and ``first`` (doc_id is null, doc_id, text_key) its representative.
    """
    bands, rows = banding(similarity, recall)
    sketch = stored(_sketch(docs, bands, rows, width), "sketch")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    variants = stored(sketch.groupBy("set_key").agg(
        F.count("*").alias("copies"), F.min(rank).alias("first"), F.first("grams").alias("grams"),
        F.first("bands").alias("bands")), "variants")
    member = variants.filter("grams > 0").select("set_key", "grams", F.posexplode("bands").alias("band", "bucket"))
    buckets = (member.groupBy("band", "bucket").agg(
                   F.count("*").alias("members"), F.sum("grams").alias("weight"),
                   F.bit_xor(F.xxhash64("set_key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "set_key")).alias("y"))
               .filter("members > 1")
               # buckets with the same members: the one of the first band stays
               .groupBy("members", "weight", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b"))
               .select("b.band", "b.bucket", F.greatest(F.ceil(F.col("weight") / BLOCK_GRAMS), F.ceil(F.col("members") / BLOCK_ROWS))
                       .cast("int").alias("blocks")))
    placed = stored(member.drop("grams").join(buckets, ["band", "bucket"]), "members")

    # n-gram sets of the variants that share a bucket, from one document each
    wanted = placed.select("set_key").distinct().join(variants, "set_key").select("set_key", "first.doc_id", "first.text_key", "copies", "bands")
    source = docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("key"), "text")
    texts = (source.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")))
             .select("set_key", "copies", "bands", "text").dropDuplicates(["set_key"]))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in slices(batch.column(3)):
                part = batch.slice(first, len(some))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([g.tobytes() for g in gram_sets(some, width)], pa.binary())],
                                                 names=["set_key", "copies", "bands", "gram_set"])

    known = texts.mapInArrow(sets, "set_key binary, copies long, bands array<long>, gram_set binary")
    block = F.pmod(F.xxhash64("set_key", "bucket"), F.col("blocks")).cast("int")
    dealt = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("set_key", "band", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    verified = stored(cells.join(known, "set_key").groupBy("band", "bucket", "i", "j").applyInArrow(
        lambda cell: _verify(cell, similarity), "set_key binary, links long, root binary"), "links")

    degree = verified.groupBy("set_key").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("set_key").alias("a"), F.col("root").alias("b")))
    linked = degree.join(roots, degree.set_key == roots.node, "left").select("set_key", "links", F.coalesce("root", "set_key").alias("class_key"))
    linked = linked.join(variants.select("set_key", "first"), "set_key")
    heads = linked.groupBy("class_key").agg(F.min("first").alias("head"))
    classes = linked.select("set_key", "links", "class_key").join(heads, "class_key")
    full = variants.select("set_key", "copies", F.col("first").alias("own")).join(classes, "set_key", "left").select(
        "set_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies"),
        F.hex(F.coalesce("class_key", "set_key")).alias("class_key"), F.coalesce("head", "own").alias("first"))
    return sketch.select("doc_id", "text_key", "set_key").join(full, "set_key").select(
        "doc_id", "text_key", F.col("first.doc_id").alias("class_id"), "n_links", "n_copies", "class_key", "first")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents without near-duplicates: of each class the row with the smallest (doc_id, text) stays, once."""
    return beside(lambda rows: _firsts(rows, **options), docs, "doc_id", "text")


def _firsts(docs: DataFrame, **options) -> DataFrame:
    heads = link(docs, **options).select("first").distinct().select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    marked = docs.withColumn("_own", text_key())
    return (marked.join(heads, marked.doc_id.cast("long").eqNullSafe(heads["_id"]) & (marked["_own"] == heads["_key"]))
            .dropDuplicates(["_id", "_key"]).select(*docs.columns))
