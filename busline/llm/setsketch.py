"""Near duplicates by SetSketch registers.

A document's set of word shingles is kept as registers: the i-th one is the least of exponential hashes of all shingles,
as the number of its step on a scale whose steps grow by the factor ``BASE``, truncated to 16 bits. The registers of a union
are the larger ones of both, so sketches merge. Two registers are equal at least as often as the sets are similar,
so documents that agree on a band of registers are candidates; how often one sketch's registers are above, below and
equal to the other's gives the likelihood of every similarity, given both sizes. A pair is verified on its full sets unless
that likelihood rules the threshold out.

Documents with equal sets form a variant, and only variants are compared. Buckets with the same members are looked at once. A
bucket is cut into blocks of bounded size; a task takes one or two blocks and compares only what it has not connected yet, so a
group of near copies costs one comparison per member and never all pairs. Each task returns one row per linked variant
(the smallest variant that it is connected with); star contraction joins those to components.

Words are runs outside ASCII white space, A-Z lower-cased. A document of fewer words than the width is one shingle;
documents without words are linked with nothing. Repeated rows are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.llm.banding import banding, components
from busline.llm.common import slices, stored, text_key

#: ``SHARE`` in hundredths: sets are linked from 100 * intersection >= SHARE * union on.
WIDTH, SHARE, RECALL = 5, 85, 1 - 1e-6
#: Registers, factor between steps of their scale, and rate of the exponential hashes.
REGISTERS, BASE, RATE = 128, 1.02, 20.0
#: A pair goes unverified when the threshold is less likely than the best similarity by this difference of logarithms
#: (six standard deviations).
RULED_OUT = 18.0
#: A block holds about so many shingles and variants.
BLOCK_SHINGLES, BLOCK_ROWS = 500_000, 1024

_draw = np.random.default_rng(11)
_FACTOR = _draw.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASK = _draw.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# --- sets and registers ---------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    split = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() if t else [] for t in texts]
    coded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    flat = each[np.asarray(coded.indices)] if len(each) else np.zeros(0, np.uint64)

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(parts[0]), len(parts), np.uint64)
        for part in parts:
            h = _mixed(h ^ part) + np.uint64(0x9E3779B97F4A7C15)
        return h

    windows = joined([flat[k:len(flat) - width + 1 + k] for k in range(width)]) if len(flat) >= width else flat[:0]
    at = 0
    for words in split:
        n = len(words)
        if n >= width:
            found = np.sort(windows[at:at + n - width + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        else:
            yield joined([flat[k:k + 1] for k in range(at, at + n)]) if n else flat[:0]
        at += n


def sketch(found: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a set of hashes; 0 everywhere for the empty set."""
    if not len(found):
        return np.zeros(REGISTERS, np.uint16)
    high, low = (found >> np.uint64(32)).astype(np.uint32), np.full(REGISTERS, 2**32 - 1, np.uint32)
    for first in range(0, len(high), 2048):
        low = np.minimum(low, ((high[first:first + 2048, None] ^ _MASK) * _FACTOR).min(axis=0))
    least = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, 2**16 - 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_hashes(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(bands, dtype=np.uint64)
    for column in registers[:bands * rows].reshape(bands, rows).T:
        h = _mixed(h ^ column.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    return h.view(np.int64)


# --- likelihood -----------------------------------------------------------------------------------


def _apart(x: np.ndarray) -> np.ndarray:
    """Probability that a register is above the other one's, where ``x`` is the share of elements that can make it so."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likelihood(similarity: np.ndarray, u: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Logarithm of the likelihood of similarities; ``u`` is the first set's share of both sizes together."""
    up, down = _apart(np.maximum(u - (1 - u) * similarity, 1e-12)), _apart(np.maximum(1 - u - u * similarity, 1e-12))
    return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))


def estimate(size: int, sizes: np.ndarray, above: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(most likely similarity, its log likelihood less that of the threshold) of one set with others.

    The logarithm is concave in the similarity, so a section search finds the maximum.
    """
    u = size / (size + sizes)
    counts = above, below, REGISTERS - above - below
    most = np.minimum(u / (1 - u), (1 - u) / u)
    low, high = np.zeros(len(u)), most.copy()
    for _ in range(20):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rising = likelihood(a, u, *counts) < likelihood(b, u, *counts)
        low, high = np.where(rising, a, low), np.where(rising, high, b)
    best = (low + high) / 2
    return best, likelihood(best, u, *counts) - likelihood(np.minimum(SHARE / 100, most), u, *counts)


def possible(registers: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the registers leave it open that the sets reach the threshold."""
    above, below = (registers > others).sum(axis=1), (registers < others).sum(axis=1)
    best, lead = estimate(size, sizes, above, below)
    return (best >= SHARE / 100) | (lead <= RULED_OUT)


# --- verification ---------------------------------------------------------------------------------


def _connected(cell: pa.Table) -> pa.Table:
    """(set_key, root) of the variants that have links in a block or between two; the smallest connected key is the root."""
    cell = cell.sort_by("set_key")
    keys = cell.column("set_key").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in cell.column("found").to_pylist()]
    registers = np.array([np.frombuffer(r, np.uint16) for r in cell.column("registers").to_pylist()])
    bands = np.array(cell.column("bands").to_pylist(), np.int64)[:, :cell.column("band")[0].as_py()]
    block = np.asarray(cell.column("block"))
    across = cell.column("i")[0].as_py() != cell.column("j")[0].as_py()
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(keys))
    for n in range(len(keys) - 1):
        open_ = (label[n + 1:] != label[n]) & (100 * np.minimum(sizes[n + 1:], sizes[n]) >= SHARE * np.maximum(sizes[n + 1:], sizes[n]))
        if across:
            open_ &= block[n + 1:] != block[n]
        others = np.flatnonzero(open_) + n + 1
        if len(others):  # pairs that agree in an earlier band were looked at there
            others = others[~(bands[others] == bands[n]).any(axis=1)]
        if len(others):
            others = others[possible(registers[n], sizes[n], registers[others], sizes[others])]
        for m in others:
            if label[m] == label[n]:
                continue
            common = len(np.intersect1d(sets[n], sets[m], assume_unique=True))
            if 100 * common >= SHARE * (sizes[n] + sizes[m] - common):
                a, b = sorted((label[n], label[m]))
                label[label == b] = a
    some = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"set_key": pa.array([keys[n] for n in some], pa.binary()), "root": pa.array([keys[label[n]] for n in some], pa.binary())})


def _sketched(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """(id, key, set_key, n_shingles, registers, bands) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(2)):
                keys, sizes, registers, hashes = [], [], [], []
                for found in shingles(texts, width):
                    own = sketch(found)
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    sizes.append(len(found))
                    registers.append(own.tobytes())
                    hashes.append(band_hashes(own, bands, rows))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(registers, pa.binary()),
                     pa.array(hashes, pa.list_(pa.int64()))], names=["id", "key", "set_key", "n_shingles", "registers", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("key"), "text").mapInArrow(
        run, "id long, key binary, set_key binary, n_shingles long, registers binary, bands array<long>")


def link(docs: DataFrame, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """One row per document (doc_id, text): doc_id, text_key, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id that links reach, itself included (null if none of them has one); ``kept`` says
    whether the document's own id is that. Documents without words (null, empty or blank texts) stand alone. An
    empty table gives no rows; other columns do not matter.
    """
    bands, rows = banding(SHARE / 100, recall, REGISTERS)
    sketched = stored(_sketched(docs, bands, rows, width), "sketches")
    variants = stored(sketched.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"),
        F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.first("bands").alias("bands")), "variants")
    member = variants.select("set_key", "n", F.posexplode("bands").alias("band", "bucket"))
    buckets = (member.groupBy("band", "bucket").agg(
                   F.count("*").alias("members"), F.sum("n").alias("weight"),
                   F.bit_xor(F.xxhash64("set_key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "set_key")).alias("y"))
               .filter("members > 1")
               # buckets with the same members: the one of the first band stays
               .groupBy("members", "weight", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b"))
               .select("b.band", "b.bucket", F.greatest(F.ceil(F.col("weight") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK_ROWS))
                       .cast("int").alias("blocks")))
    dealt = stored(member.drop("n").join(buckets, ["band", "bucket"]), "members")

    # full sets of the variants that share a bucket, from one document each
    wanted = dealt.select("set_key").distinct().join(variants, "set_key").select("set_key", "first.id", "first.key", "registers", "bands")
    source = docs.select(F.col("doc_id").cast("long").alias("id_"), text_key().alias("key_"), "text")
    texts = (source.join(wanted, F.col("id_").eqNullSafe(F.col("id")) & (F.col("key_") == F.col("key")))
             .select("set_key", "registers", "bands", "text").dropDuplicates(["set_key"]))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in slices(batch.column(3)):
                part = batch.slice(first, len(some))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([s.tobytes() for s in shingles(some, width)], pa.binary())],
                                                 names=["set_key", "registers", "bands", "found"])

    full = texts.mapInArrow(sets, "set_key binary, registers binary, bands array<long>, found binary")
    block = F.pmod(F.xxhash64("set_key", "bucket"), F.col("blocks")).cast("int")
    met = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select("set_key", "band", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = cells.join(full, "set_key").groupBy("band", "bucket", "i", "j").applyInArrow(_connected, "set_key binary, root binary")

    roots = components(stored(found, "connected"), "set_key", "root").select("node", "root")
    classes = variants.select("set_key", "least").join(roots, F.col("set_key") == F.col("node"), "left").select(
        "set_key", "least", F.coalesce("root", "set_key").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.select("set_key", "root").join(least, "root").select("set_key", "component_id")
    own = sketched.select("id", "key", "set_key", "n_shingles")
    alone = own.filter("n_shingles = 0").withColumn("component_id", F.col("id"))
    out = own.filter("n_shingles > 0").join(named, "set_key").unionByName(alone)
    return out.select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), "n_shingles", "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The kept documents, all columns. Rows that agree in id and text stay once; documents without words all stay."""
    kept = link(docs, **options).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), (F.col("n_shingles") > 0).alias("worded"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id_"), text_key().alias("key_"))
    met = rows.join(kept.distinct(), F.col("id_").eqNullSafe(F.col("id")) & (F.col("key_") == F.col("key")))
    once = met.filter("worded").dropDuplicates(["id_", "key_"])
    return once.unionByName(met.filter("NOT worded")).select("row.*")
