"""Secret scanning with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: every match must hold certain literal
strings, hence their trigrams. Texts are indexed in segments: sorted (trigram, text) postings. A rule's query unites
and intersects postings, and only the candidate texts are scanned with the expression. A rule without mandatory
trigrams is scanned over all texts.

The index of a segment lives as long as the segment's batch: every rule set is known before the pass, so storing
the postings and joining candidates back to their texts would only add a shuffle of all texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from busline.llm.common import extended, slices, without

#: Strings a part of an expression may stand for before only its trigrams are kept.
STRINGS = 64
SEGMENT_TEXTS = 4096

Query = tuple  # ("all",) | ("tri", code) | ("and", [...]) | ("or", [...])
ALL: Query = ("all",)


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans, leftmost first; ``least`` is the fewest characters of group ``group`` in a span that counts.

    ``quick`` yields (start, end) of the same spans where matching the pattern itself could take quadratic time.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    quick: Callable[[str], Iterator[tuple[int, int]]] | None = None

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def finder(self) -> Callable[[str], Iterator[tuple[int, int]]]:
        """A function from a text to (start, end) of the spans that count."""
        if self.quick:
            return self.quick
        pattern = self.compiled()
        return lambda text: (m.span() for m in pattern.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least)


#: What follows a scheme, in runs that end where the next part begins, and the characters of a scheme.
LOGIN = re.compile(r"://[A-Za-z0-9._%+-]++:[^\x00-\x20@/]{3,}+@", re.ASCII)
NO_LETTER = "0123456789+.-"
SCHEME = "abcdefghijklmnopqrstuvwxyz" + NO_LETTER


def logins(text: str) -> Iterator[tuple[int, int]]:
    """Spans of ``url_login`` from each ``://`` outwards. No part holds a slash, so each character is looked at a few times."""
    last = 0
    for m in LOGIN.finditer(text):
        head = text[last:m.start()]
        scheme = head[len(head.rstrip(SCHEME)):].lstrip(NO_LETTER)
        if len(scheme) >= 2:
            yield m.start() - len(scheme), m.end()
        last = m.end()


#: The first three are the base rules, in the order that breaks ties; fixed values.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}", least=24),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{16,}=*", any_case=True),
    Rule("url_login", r"[a-z][a-z0-9+.-]+://[A-Za-z0-9._%+-]+:[^\x00-\x20@/]{3,}@", quick=logins),
]
BASE = ("assign", "access", "hex")


# --- from an expression to trigrams -----------------------------------------------------------------


def _both(kind: str, parts: list[Query]) -> Query:
    """Conjunction or disjunction, simplified."""
    if kind == "or" and ALL in parts:
        return ALL
    flat: list[Query] = []
    for part in parts:
        if part != ALL and part not in flat:
            flat.append(part)
    return ALL if not flat else flat[0] if len(flat) == 1 else (kind, flat)


def _of_strings(strings: set[str]) -> Query:
    """What a text must hold if it holds one of the strings."""
    folded = sorted({s.encode().lower() for s in strings})
    return _both("or", [_both("and", [("tri", int.from_bytes(s[i:i + 3], "big")) for i in range(len(s) - 2)]) for s in folded])


def _strings_of(op, value) -> set[str] | None:
    """The strings one element stands for, if few."""
    if op is C.LITERAL:
        return {chr(value)}
    if op is C.IN and value and value[0][0] is not C.NEGATE:
        chars: set[str] = set()
        for kind, item in value:
            if kind is C.LITERAL:
                chars.add(chr(item))
            elif kind is C.RANGE and item[1] - item[0] < STRINGS:
                chars |= {chr(c) for c in range(item[0], item[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    return None


def _sequence(tree) -> tuple[set[str] | None, Query]:
    """(the strings the sequence stands for, or None; the query that any match satisfies)."""
    exact: set[str] = {""}
    whole, must = True, []

    def cut() -> None:
        nonlocal exact, whole
        must.append(_of_strings(exact))
        exact, whole = {""}, False

    for op, value in tree:
        strings, query = _strings_of(op, value), ALL
        if op is C.SUBPATTERN:
            strings, query = _sequence(value[3])
        elif op is C.BRANCH:
            ways = [_sequence(way) for way in value[1]]
            if all(s is not None for s, _ in ways):
                strings = set().union(*(s for s, _ in ways))
            query = _both("or", [q for _, q in ways])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = value
            inside, needed = _sequence(inner)
            if inside is not None and most == 1:
                strings = inside | ({""} if least == 0 else set())
            elif inside is not None and least == most and len(inside) == 1:
                strings = {next(iter(inside)) * least}
            query = needed if least else ALL
        elif op is C.AT:
            strings = {""}
        if strings is not None and len(exact) * len(strings) <= STRINGS:
            exact = {a + b for a in exact for b in strings}
        else:
            cut()
            must.append(query if strings is None else _of_strings(strings))
    query = _both("and", [*must, _of_strings(exact)])
    return (exact if whole else None), query


def query_of(rule: Rule) -> Query:
    """Trigram query of a rule; ``ALL`` if it has no mandatory trigram."""
    return _sequence(P.parse(rule.pattern, re.ASCII))[1]


# --- the index of a segment -------------------------------------------------------------------------


def segment_index(texts: list[bytes]) -> np.ndarray:
    """Sorted distinct postings of lower-cased texts: trigram * SEGMENT_TEXTS + place of the text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts).lower(), np.uint8).astype(np.int64)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    keys = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * SEGMENT_TEXTS + owner[:-2])[owner[:-2] == owner[2:]]
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def candidates(index: np.ndarray, query: Query, count: int) -> np.ndarray:
    """Places of the texts that satisfy the query, ascending."""
    if query == ALL:
        return np.arange(count)
    kind, value = query
    if kind == "tri":
        a, b = np.searchsorted(index, [value * SEGMENT_TEXTS, (value + 1) * SEGMENT_TEXTS])
        return index[a:b] - value * SEGMENT_TEXTS
    found = None
    for part in value:
        more = candidates(index, part, count)
        if found is None:
            found = more
        else:
            found = np.intersect1d(found, more, True) if kind == "and" else np.union1d(found, more)
        if kind == "and" and not len(found):
            break
    return found


def scan(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Add ``secrets``: array of (kind, start, end), code points, end exclusive, by start, then the rules' order.

    Spans of one rule do not overlap; spans of different rules may. Null and empty texts have none. Rows and other
    columns stay; an input column named ``secrets`` is replaced. Narrow: no shuffle.
    """
    docs = without(docs, "secrets")
    at = docs.columns.index(text)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                         T.StructField("end", T.IntegerType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    plan = [(n, rule, query_of(rule)) for n, rule in enumerate(rules)]

    def found(texts: list[str | None]) -> list[list[tuple]]:
        spans: list[list[tuple]] = [[] for _ in texts]
        index = segment_index([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        for n, rule, query in plan:
            finder = rule.finder()
            for place in candidates(index, query, len(texts)).tolist():
                spans[place] += [(start, n, end, rule.kind) for start, end in finder(texts[place] or "")]
        return spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(at)):
                for more in range(0, len(texts), SEGMENT_TEXTS):
                    some = texts[more:more + SEGMENT_TEXTS]
                    part = batch.slice(first + more, len(some))
                    rows = [[{"kind": k, "start": s, "end": e} for s, _, e, k in sorted(spans)] for spans in found(some)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], [*part.schema.names, "secrets"])

    return docs.mapInArrow(run, extended(docs.schema, T.StructField("secrets", T.ArrayType(span))))
