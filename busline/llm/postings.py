"""Benchmark decontamination over a distributed positional inverted index.

``build`` cuts the documents into segments and stores, per segment and term, the sorted positions of the term
(delta-coded), next to one directory row per segment with its documents. ``phrase_matches`` and ``proximity_matches``
look up a table of phrases: corpus-wide term counts order each phrase's terms from the rarest; a phrase is sent only to
segments that hold its rarest term, and there the position lists, moved by each word's offset, are intersected in
that order. ``decontaminate`` marks the documents that hold windows of benchmark items.

Words: A-Z are lower-cased; a word is a run of ASCII letters, digits and characters outside ASCII. Null texts have no
words. Repeated rows are documents of their own; document ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busline.llm.common import beside, slices, stored, text_key

SEGMENT_CHARS = 6_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INDEX = T.StructType([T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()),
                       T.StructField("count", T.LongType()), T.StructField("positions", T.BinaryType()),
                       T.StructField("doc_ids", T.ArrayType(T.LongType())),
                       T.StructField("text_keys", T.ArrayType(T.BinaryType()))])


def words(text: str | Column) -> Column:
    """The words of a text, as an array; empty for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(
        F.translate(F.coalesce(column, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


# --- the index ------------------------------------------------------------------------------------


def _word_bytes() -> bytes:
    """Byte table that lower-cases letters, keeps word bytes and turns all others to spaces."""
    table = bytearray(b" " * 256)
    for b in range(256):
        if b >= 128 or chr(b).isdigit() or chr(b).islower():
            table[b] = b
        elif chr(b).isupper():
            table[b] = b + 32
    return bytes(table)


def _pack(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Variable-length integers (seven bits a byte) of ascending lists, coded as differences; one binary per list."""
    step = values.astype(np.int64)
    step[1:] -= values[:-1]
    starts = np.append(0, ends[:-1])
    step[starts] = values[starts]
    width = 1 + sum((step >= 1 << (7 * k)).astype(np.int64) for k in range(1, 5))
    last = np.cumsum(width)
    out = np.zeros(int(last[-1]) if len(last) else 0, np.uint8)
    for k in range(5):
        some = width > k
        if some.any():
            out[(last - width)[some] + k] = ((step[some] >> (7 * k)) & 127) | np.where(width[some] > k + 1, 128, 0)
    offsets = np.append(0, last[ends - 1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.append(0, ends[:-1] + 1)
    within = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * within), starts))


def _segment(number: int, texts: list[str | None], doc_ids: pa.Array, text_keys: pa.Array) -> pa.RecordBatch:
    """Index rows of one segment. A position is a word's number in the segment; one is left out between documents."""
    table = _word_bytes()
    split = [t.encode().translate(table).split() if t else [] for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    tokens = pa.array([w for part in split for w in part], pa.binary()).dictionary_encode()
    codes = np.asarray(tokens.indices)
    positions = np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(codes, kind="stable")
    counts = np.bincount(codes, minlength=len(tokens.dictionary))
    lists = [] if not len(codes) else [_pack(positions[order], np.cumsum(counts))]
    starts = np.cumsum(lengths + 1) - lengths - 1
    directory = _pack(np.append(starts, starts[-1] + lengths[-1] + 1), np.array([len(starts) + 1]))
    terms = len(tokens.dictionary)
    whole = pa.array([0, len(doc_ids)], pa.int32())
    named = [pa.ListArray.from_arrays(whole, a).cast(pa.list_(a.type)) for a in (doc_ids, text_keys)]
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(terms + 1, number, np.int64)),
        pa.concat_arrays([tokens.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]),
        pa.array(np.append(counts, len(lengths)).astype(np.int64)),
        pa.concat_arrays([*lists, directory]),
        *[pa.concat_arrays([pa.nulls(terms, a.type), a]) for a in named],
    ], names=_INDEX.names)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of ``docs``: (segment, term, count, positions, doc_ids, text_keys).

    A row with a null term is the directory of its segment: where each document starts, its id and its text's key.
    Narrow: a task indexes its own rows, one segment of bounded size at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, texts in slices(batch.column(1), SEGMENT_CHARS):
                part = batch.slice(first, len(texts))
                yield _segment(number, texts, part.column(0), part.column(2))
                number += 1

    return stored(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("body"), text_key(text).alias("text_key")).mapInArrow(run, _INDEX), "index")


def directory(index: DataFrame) -> DataFrame:
    """(segment, place, doc_id, text_key, n_words) of every indexed document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, packed, ids, keys in zip(*(c.to_pylist() for c in batch.columns[:2]), *batch.columns[2:], strict=True):
                starts = _unpack(packed)
                count = len(starts) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(count, segment, np.int64)), pa.array(np.arange(count, dtype=np.int32)),
                    ids.values, keys.values, pa.array(np.diff(starts) - 1)], names=["segment", "place", "doc_id", "text_key", "n_words"])

    rows = index.filter(F.col("term").isNull()).select("segment", "positions", "doc_ids", "text_keys")
    return rows.mapInArrow(run, "segment long, place int, doc_id long, text_key binary, n_words long")


# --- look-ups -------------------------------------------------------------------------------------


def _within(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[place] == wanted


def exact_spans(lists: Callable[[str], np.ndarray], phrase: list[str], order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) positions of a phrase: intersect the lists moved by each word's offset, the rarest term first."""
    offsets: dict[str, list[int]] = {}
    for n, word in enumerate(phrase):
        offsets.setdefault(word, []).append(n)
    starts = None
    for term in order:
        found = lists(term)
        for n in offsets[term]:
            starts = found - n if starts is None else starts[_within(found, starts + n)] if len(found) else starts[:0]
            if not len(starts):
                return starts, starts
    return starts, starts + len(phrase) - 1


def near_spans(lists: Callable[[str], np.ndarray], phrase: list[str], order: list[str], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) positions of the shortest spans of at most ``reach`` words with every term, in any order."""
    found = [lists(t) for t in order]
    if not all(len(f) for f in found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    anchor = found[0]
    starts = []
    for f in found:  # a span starts with a term, not further than its reach before the rarest one
        after = np.searchsorted(anchor, f)
        ok = after < len(anchor)
        starts.append(f[ok][anchor[after[ok]] - f[ok] < reach])
    first = np.unique(np.concatenate(starts))
    last = first.copy()
    for f in found:
        after = np.searchsorted(f, first)
        last = np.maximum(last, np.where(after < len(f), f[np.minimum(after, len(f) - 1)], np.iinfo(np.int64).max))
    ok = last - first < reach
    first, last = first[ok], last[ok]
    shortest = np.append(last[1:] != last[:-1], True) if len(last) else ok[:0]
    return first[shortest], last[shortest]


def _matches(index: DataFrame, phrases: DataFrame, find: Callable) -> DataFrame:
    """(segment, phrase, first[], last[]) of the phrases found; ``phrases`` has distinct ``phrase`` arrays."""
    phrases = phrases.select("phrase").distinct().filter(F.size("phrase") > 0)
    terms = phrases.select("phrase", F.explode(F.array_distinct("phrase")).alias("term"))
    postings = index.join(terms.select("term").distinct(), "term", "left_semi")
    counted = postings.groupBy("term").agg(F.sum("count").alias("n"))
    # a phrase with a term that no document has is gone after the inner join and the size test
    ordered = (terms.join(counted, "term").groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("rare"))
               .filter(F.size("rare") == F.size(F.array_distinct("phrase")))
               .select("phrase", F.col("rare.term").alias("order")))
    sent = (postings.select("segment", "term").join(ordered.withColumn("term", F.col("order")[0]), "term")
            .select(F.col("segment").alias("within"), "phrase", "order"))

    def run(have: pa.Table, ask: pa.Table) -> pa.Table:
        out: dict[str, list] = {"segment": [], "phrase": [], "first": [], "last": []}
        if have.num_rows and ask.num_rows:
            packed = dict(zip(have.column("term").to_pylist(), have.column("positions"), strict=True))
            lists: dict[str, np.ndarray] = {}

            def positions(term: str) -> np.ndarray:
                if term not in lists:
                    lists[term] = _unpack(packed[term].as_py()) if term in packed else np.zeros(0, np.int64)
                return lists[term]

            for segment, phrase, order in zip(*(ask.column(c).to_pylist() for c in ("within", "phrase", "order")), strict=True):
                first, last = find(positions, phrase, order)
                if len(first):
                    for name, value in (("segment", segment), ("phrase", phrase), ("first", first), ("last", last)):
                        out[name].append(value)
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return postings.select("segment", "term", "positions").groupBy("segment").cogroup(sent.groupBy("within")).applyInArrow(
        run, "segment long, phrase array<string>, first array<long>, last array<long>")


def _in_documents(index: DataFrame, found: DataFrame) -> DataFrame:
    """(segment, place, doc_id, n_words, phrase, first[], last[]): matches by document, word numbers from 0."""
    def run(have: pa.Table, hits: pa.Table) -> pa.Table:
        names = ["segment", "place", "doc_id", "n_words", "phrase", "first", "last"]
        rows: list[list] = [[] for _ in names]
        if have.num_rows and hits.num_rows:
            segment = have.column("segment")[0].as_py()
            starts = _unpack(have.column("positions")[0].as_py())
            ids = have.column("doc_ids")[0].values
            for phrase, first, last in zip(hits.column("phrase").to_pylist(), hits.column("first"), hits.column("last"), strict=True):
                first, last = np.asarray(first.values), np.asarray(last.values)
                place = np.searchsorted(starts, first, "right") - 1
                inside = last < starts[place + 1] - 1  # not across two documents
                for p in np.unique(place[inside]).tolist():
                    mine = inside & (place == p)
                    for column, value in zip(rows, (segment, p, ids[p].as_py(), starts[p + 1] - starts[p] - 1, phrase,
                                                    first[mine] - starts[p], last[mine] - starts[p]), strict=True):
                        column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=names)

    listed = index.filter(F.col("term").isNull()).select("segment", "positions", "doc_ids")
    return listed.groupBy("segment").cogroup(found.groupBy("segment")).applyInArrow(
        run, "segment long, place int, doc_id long, n_words long, phrase array<string>, first array<long>, last array<long>")


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Documents with the words of ``phrases.phrase`` next to each other, in order, and where (word numbers from 0)."""
    return _in_documents(index, _matches(index, phrases, exact_spans))


def proximity_matches(index: DataFrame, phrases: DataFrame, reach: int) -> DataFrame:
    """Documents with all words of a phrase, in any order, within ``reach`` words of each other; shortest spans."""
    return _in_documents(index, _matches(index, phrases, lambda lists, phrase, order: near_spans(lists, phrase, order, reach)))


# --- decontamination ------------------------------------------------------------------------------


def windows(items: DataFrame, width: int = 13, key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, phrase): every ``width`` consecutive words of an item; one shorter phrase for an item of fewer words."""
    split = items.select(key, F.inline(F.array(F.struct(words(text).alias("w")))))
    last = F.greatest(F.size("w") - F.lit(width) + 1, F.lit(1))
    return split.filter(F.size("w") > 0).select(
        key, F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("w", i, width))).alias("phrase")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, items.

    ``n_hit`` counts the document's words inside any window of an item, ``items`` are the ids (as strings, sorted) of
    items with such a window; contaminated: n_hit > 0 and share * n_hit >= n_words. A null item id counts as no item
    but its windows hit.
    """
    index = build(docs)
    cut = windows(items, width)
    hits = stored(phrase_matches(index, cut), "matches")
    spans = (hits.select("segment", "place", F.explode(F.arrays_zip("first", "last")).alias("s"))
             .select("segment", "place", "s.*").distinct())
    # union length of spans that come in the order of their starts: each adds what lies behind the furthest end so far
    reached = F.expr("max(last) OVER (PARTITION BY segment, place ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    covered = (spans.withColumn("reached", F.coalesce(reached, F.lit(-1)))
               .groupBy("segment", "place")
               .agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.col("reached")))).alias("n_hit")))
    held = (hits.select("segment", "place", "phrase").join(cut, "phrase")
            .groupBy("segment", "place").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    found = covered.join(held, ["segment", "place"], "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)).cast("long"), F.array().cast("array<string>")
    items_of = F.coalesce("items", none)
    return directory(index).join(found, ["segment", "place"], "left").select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), items_of.alias("items"))


def keep_clean(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    return beside(lambda rows: _clean(rows, items, width, share), docs, "doc_id", "text")


def _clean(docs: DataFrame, items: DataFrame, width: int, share: int) -> DataFrame:
    found = decontaminate(docs, items, width, share).filter("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    marked = docs.withColumn("_own", text_key())
    return marked.join(found, marked.doc_id.cast("long").eqNullSafe(found["_id"]) & (marked["_own"] == found["_key"]), "left_anti").select(*docs.columns)
