"""SentencePiece encoding and decoding by vectorised merge rounds.

A byte-pair model merges, again and again, the adjacent pair of symbols whose joined piece has the highest
score, the leftmost first. Here all new words of a slice of texts are encoded together: their symbols lie in
one flat array; each round finds every word's best pair by a segmented minimum, merges it wherever it occurs
in the word (leftmost first, without overlap) and compacts the arrays; a word leaves when no pair remains.

Merging all occurrences at once equals merging one by one unless a merge creates a pair that is at least as
good as the rest. Pieces for which the vocabulary allows this are known in advance (``risky``); for them the
new neighbours are looked up, and a round stops in a word after the first merge that creates such a pair.

Texts fall into words where no piece of the vocabulary spans the boundary: before a space that follows another
character, and around characters that no piece joins to their neighbour.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from busline.llm.common import extended, slices, without

SPACE = "▁"
#: Words whose ids a task remembers before it starts anew.
REMEMBERED = 400_000
NEVER = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Vocabulary:
    """Tables derived from a model file; their size depends on the vocabulary only."""

    surfaces: list[bytes]     # what each id decodes to; the first piece of a text loses its leading space
    control: np.ndarray       # ids that decode to nothing
    begin: int
    end: int
    space: int                # id of the single space
    runs: dict[int, int]      # id of the piece of n spaces
    byte_ids: np.ndarray      # ids of the 256 byte pieces
    pair_keys: np.ndarray     # sorted left * 2^20 + right
    pair_piece: np.ndarray    # what the pair merges to
    rank: np.ndarray          # by piece: 0 is merged first; equal scores have equal ranks
    risky: np.ndarray         # by rank: a merge may create a pair that is at least as good
    chars: np.ndarray         # symbol by code point, or -1
    extra: np.ndarray         # code points of the symbols after the pieces: parts of pieces, but no pieces
    joints: np.ndarray        # sorted left * 2^21 + right: neighbouring characters within some piece

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a byte-pair model with byte fallback and without text normalisation."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(count)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(count)]
        byte_ids = np.zeros(256, np.int32)
        surfaces, joints = [], set()
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                surfaces.append(b"")
            else:
                surfaces.append(" ⁇ ".encode() if model.is_unknown(i) else piece.replace(SPACE, " ").encode())
            if not special[i]:
                joints.update((ord(a) << 21) + ord(b) for a, b in zip(piece, piece[1:], strict=False))
        if any(re.search(f"[^{SPACE}]{SPACE}|{SPACE}{SPACE}[^{SPACE}]", p) for p in ids):
            raise ValueError("this vocabulary has pieces that span words")
        order = {s: n for n, s in enumerate(sorted({model.get_score(i) for i in ids.values()}, reverse=True))}
        rank = np.full(count, NEVER, np.int32)
        for i in ids.values():
            rank[i] = order[model.get_score(i)]
        risky = np.zeros(len(order), bool)
        for piece, i in ids.items():
            for k in range(2, len(piece)):
                for part in (piece[:k], piece[-k:]):
                    if part in ids and rank[ids[part]] >= rank[i]:
                        risky[rank[ids[part]]] = True
        extra = sorted({c for p in ids for c in p} - set(ids))
        symbols = ids | {c: count + n for n, c in enumerate(extra)}
        pairs = {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                left, right = symbols.get(piece[:k]), symbols.get(piece[k:])
                if left is not None and right is not None:
                    pairs[(left << 20) + right] = i
        keys = np.array(sorted(pairs), np.int64)
        chars = np.full(0x110000, -1, np.int32)
        for symbol, i in symbols.items():
            if len(symbol) == 1:
                chars[ord(symbol)] = i
        runs = {len(p): i for p, i in ids.items() if set(p) == {SPACE}}
        if {int(rank[i]) for i in runs.values()} != {len(order) - 1}:
            raise ValueError("runs of spaces must be merged last")
        return cls(surfaces, np.array([model.is_control(i) for i in range(count)]), model.bos_id(), model.eos_id(),
                   ids[SPACE], runs, byte_ids, keys, np.array([pairs[int(k)] for k in keys], np.int32), rank, risky,
                   chars, np.array([ord(c) for c in extra], np.int64), np.array(sorted(joints), np.int64))

    # --- encoding -----------------------------------------------------------------------------

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of neighbouring symbols; NEVER where they do not merge."""
        ranks, merged = np.full(len(left), NEVER, np.int32), np.full(len(left), -1, np.int32)
        at = np.flatnonzero(same & (left >= 0) & (right >= 0))
        keys = (left[at].astype(np.int64) << 20) + right[at]
        place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = self.pair_keys[place] == keys
        at, pieces = at[found], self.pair_piece[place[found]]
        ranks[at], merged[at] = self.rank[pieces], pieces
        return ranks, merged

    def _until_better(self, symbol: np.ndarray, word: np.ndarray, hit: np.ndarray, ranks: np.ndarray,
                      merged: np.ndarray) -> np.ndarray:
        """Which of the merges to make: in each word, up to the first that creates a pair at least as good."""
        risk = np.flatnonzero(self.risky[ranks[hit]])
        if not len(risk):
            return np.ones(len(hit), bool)
        at = hit[risk]
        piece, rank = merged[at], ranks[at]
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbol) - 1)
        chained = np.append(False, hit[1:] == hit[:-1] + 2)[risk]
        left = np.where(chained & (word[before] == word[at]), piece, symbol[before])
        better = self._pair_ranks(left, piece, (before < at) & (word[before] == word[at]))[0] <= rank
        better |= self._pair_ranks(piece, symbol[after], (after == at + 2) & (word[after] == word[at]))[0] <= rank
        if not better.any():
            return np.ones(len(hit), bool)
        stop = np.zeros(len(hit), np.int64)
        stop[risk] = better
        passed = np.cumsum(stop) - stop
        first = np.append(True, word[hit[1:]] != word[hit[:-1]])
        return passed == passed[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]

    def _merge(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over flat arrays: symbols and, ascending, the words they belong to."""
        done_symbols, done_words = [], []
        same = np.append(word[1:] == word[:-1], False)
        ranks, merged = self._pair_ranks(symbol, np.append(symbol[1:], -1), same)
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(ranks, starts)
            finished = np.repeat(best == NEVER, lengths)
            if finished.any():
                done_symbols.append(symbol[finished])
                done_words.append(word[finished])
                left = ~finished
                symbol, word, ranks, merged = symbol[left], word[left], ranks[left], merged[left]
                lengths, best = lengths[best != NEVER], best[best != NEVER]
                if not len(symbol):
                    break
            hit = np.flatnonzero(ranks == np.repeat(best, lengths))
            # within a run of overlapping hits every second one is merged, from the left
            fresh = np.append(True, np.diff(hit) != 1)
            offset = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[offset % 2 == 0]
            hit = hit[self._until_better(symbol, word, hit, ranks, merged)]
            symbol[hit] = merged[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep)[hit] - 1
            symbol, word, ranks, merged = symbol[keep], word[keep], ranks[keep], merged[keep]
            changed = np.zeros(len(symbol), bool)
            changed[moved] = changed[np.maximum(moved - 1, 0)] = True
            stale = np.flatnonzero(changed)
            after = np.minimum(stale + 1, len(symbol) - 1)
            ranks[stale], merged[stale] = self._pair_ranks(symbol[stale], symbol[after],
                                                           (word[stale] == word[after]) & (after > stale))
        if not done_symbols:
            return symbol, word
        symbol, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbol[order], word[order]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word; a word holds no space but one at its start."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        # parts that no piece joins are words of their own
        joint = (points[:-1] << 21) + points[1:]
        place = np.minimum(np.searchsorted(self.joints, joint), len(self.joints) - 1)
        cut = (owner[1:] != owner[:-1]) | (self.joints[place] != joint)
        part = np.append(0, np.cumsum(cut)) if len(points) else np.zeros(0, np.int64)
        symbol = self.chars[points]
        part_owner = owner[np.flatnonzero(np.append(True, cut))] if len(points) else owner
        count = len(self.rank)
        symbol, part = self._merge(np.where(symbol < 0, -1 - points, symbol), part)
        owner = part_owner[part]
        odd = np.flatnonzero((symbol < 0) | (symbol >= count))
        ids = symbol
        if len(odd):
            # characters outside the vocabulary become the bytes of their UTF-8 form
            value = symbol[odd]
            known = np.where(value >= 0, self.extra[np.clip(value - count, 0, max(0, len(self.extra) - 1))]
                             if len(self.extra) else 0, -1 - value)
            spelt = [chr(c).encode("utf-8", "surrogatepass") for c in known.tolist()]
            width = np.ones(len(symbol), np.int64)
            width[odd] = [len(b) for b in spelt]
            ids, owner = np.repeat(symbol, width), np.repeat(owner, width)
            first = np.cumsum(width)[odd] - width[odd]
            target = np.concatenate([np.arange(f, f + len(b)) for f, b in zip(first.tolist(), spelt, strict=True)])
            ids[target] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        packed = ids.astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _with_spaces(self, lead: int, ids: bytes) -> bytes:
        """Put ``lead`` more spaces before the ids of a word that starts with one.

        Pairs of spaces all have the same score, so the leftmost pair that makes a piece is merged first.
        """
        if ids[:4] == np.array([self.space], "<u4").tobytes():  # it stayed alone, so it joins the run before it
            lead, ids = lead + 1, ids[4:]
        widths: list[int] = []
        for _ in range(lead):
            width = 1
            while widths and widths[-1] + width in self.runs:
                width += widths.pop()
            widths.append(width)
        return np.array([self.runs[w] for w in widths], "<u4").tobytes() + ids

    def encoder(self):
        """A function from texts to ids as packed little-endian 32-bit integers, with a bounded memory of words."""
        words = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        memory: dict[str, bytes] = {}
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))

        def encode(texts: list[str | None]) -> list[bytes]:
            split = [words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
            present = set().union(*split)
            if len(memory) + len(present) > REMEMBERED:
                memory.clear()
            new = list(present.difference(memory))
            lead = [len(w) - len(w.lstrip(SPACE)) - 1 if w.startswith(SPACE * 2) else 0 for w in new]
            coded = self.encode_words([w[n:] for w, n in zip(new, lead, strict=True)]) if new else []
            for w, n, ids in zip(new, lead, coded, strict=True):
                memory[w] = self._with_spaces(n, ids) if n else ids
            return [b"".join([begin, *map(memory.__getitem__, part), end]) for part in split]

        return encode

    # --- decoding -----------------------------------------------------------------------------

    def decode_ids(self, packed: bytes | None) -> str | None:
        """Text of packed ids. Bytes that form no character become U+FFFD, one for each."""
        if packed is None:
            return None
        ids = np.frombuffer(packed, "<u4")
        hidden = self.control[ids]
        parts = []
        edges = np.flatnonzero(np.append(True, hidden[1:] != hidden[:-1])) if len(ids) else []
        bounds = [*edges, len(ids)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if hidden[a]:
                continue
            joined = b"".join(map(self.surfaces.__getitem__, ids[a:b].tolist()))
            if not parts and ids[a] not in self.byte_ids and joined.startswith(b" ") and not self._unknown(ids[a]):
                joined = joined[1:]
            parts.append(joined.decode("utf-8", "one_each"))
        return "".join(parts)

    def _unknown(self, i: int) -> bool:
        return self.surfaces[i] == b" \xe2\x81\x87 "


def _one_each(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """Add ``ids``: the text's token ids with begin and end, packed as little-endian unsigned 32-bit integers.

    Null and empty texts give the begin and end ids alone. Rows, order and other columns stay; an input column
    named ``ids`` is replaced. Narrow: no shuffle, and a task holds one slice of texts at a time.
    """
    docs = without(docs, "ids")
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))  # bounded by the vocabulary
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Vocabulary(**shared.value).encoder()
        for batch in batches:
            for first, texts in slices(batch.column(at)):
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(coder(texts), pa.binary())],
                                                 [*part.schema.names, "ids"])

    return docs.mapInArrow(run, extended(docs.schema, T.StructField("ids", T.BinaryType())))


def decode(coded: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the text that packed ids stand for; null ids give null. Rows and other columns stay."""
    coded = without(coded, "decoded")
    shared = coded.sparkSession.sparkContext.broadcast(vars(vocabulary))
    at = coded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.register_error("one_each", _one_each)
        read = Vocabulary(**shared.value).decode_ids
        for batch in batches:
            for first, packed in slices(batch.column(at), 8_000_000):
                part = batch.slice(first, len(packed))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([read(p) for p in packed], pa.string())],
                                                 [*part.schema.names, "decoded"])

    return coded.mapInArrow(run, extended(coded.schema, T.StructField("decoded", T.StringType())))
