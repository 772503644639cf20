"""Repair of the turn structure of conversations by a run-length dynamic programme.

A conversation is a text of symbols, one per row: the class of its role and its fault. The cheapest edits that make the roles
fit ``(s?(ua)+)?`` are a shortest path over four states (start, after system, after user, after assistant), and a row is
a 4 x 4 transition in min-plus algebra, insertions before it included. Conversations are cut into chunks of rows:

1. equal consecutive symbols of a chunk collapse to runs; a run is advanced by cached binary powers of its transition,
   so a chunk is summed up as one 4 x 4 matrix;
2. the matrices stream backwards through each conversation and give every chunk the costs that follow it;
3. chunks, dealt anew, unroll their choices for each state they may be entered in;
4. the chunks' exits stream forwards and pick the state that each one is entered in.

Only steps 2 and 4 see a conversation in order, and they see a row per chunk. Nothing is held but a state of four numbers.
The digest of a repaired conversation streams over its sorted rows too: it is one SHA-256, which has to be taken in order.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from busline.llm.common import numbered, stored

#: Costs of the edits (fixed values); a row without a fault is kept for nothing.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation that one step unrolls together.
CHUNK = 4096
SPACE = " \t\n\x0b\x0c\r"
NEVER = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
#: State before a new row of the class: the state after it.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
#: Role that an inserted or rewritten row takes in a state, by the class it has.
WANTED = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
#: Symbols: class of the role, then fault (none, truncated, to be deleted).
CLASSES, FAULTS = "suao", "-tx"
SYMBOLS = {chr(65 + 3 * c + f): (CLASSES[c], FAULTS[f]) for c in range(4) for f in range(3)}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Costs of closing a conversation in each state.
CLOSE = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


# --- min-plus transitions -------------------------------------------------------------------------


def times(a: Matrix, b: Matrix) -> Matrix:
    columns = tuple(zip(*b, strict=True))
    return tuple(tuple(min(map(int.__add__, row, column)) for column in columns) for row in a)


def onto(a: Matrix, v: Vector) -> Vector:
    return tuple(min(map(int.__add__, row, v)) for row in a)


IDENTITY: Matrix = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))
#: Insertions before a row: none, one or two.
INSERTIONS: Matrix = ((0, NEVER, INSERT, 2 * INSERT), (NEVER, 0, INSERT, 2 * INSERT), (NEVER, NEVER, 0, INSERT), (NEVER, NEVER, INSERT, 0))


def edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the row itself, by the edit's letter."""
    kind, fault = SYMBOLS[symbol]
    out = [("D", DELETE, state)]
    if fault != "x":
        more = TRUNCATED if fault == "t" else 0
        if state in MOVES[kind]:
            out.append(("K", more, MOVES[kind][state]))
        out.append(("R", REROLE + more, MOVES[WANTED[state]][state]))
    return out


@functools.cache
def transition(symbol: str) -> Matrix:
    own = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in edits(symbol, state):
            own[state][after] = min(own[state][after], cost)
    return times(INSERTIONS, tuple(map(tuple, own)))


@functools.cache
def power(symbol: str, k: int) -> Matrix:
    """The transition of 2**k rows of one symbol."""
    return times(half := power(symbol, k - 1), half) if k else transition(symbol)


def summed(symbols: str) -> Matrix:
    """The transition of a text of symbols, run by run."""
    out = IDENTITY
    for symbol, run in itertools.groupby(symbols):
        for k, bit in enumerate(reversed(bin(sum(1 for _ in run))[2:])):
            if bit == "1":
                out = times(out, power(symbol, k))
    return tuple(tuple(min(x, NEVER) for x in row) for row in out)


# --- choices --------------------------------------------------------------------------------------


@functools.lru_cache(1 << 16)
def back(symbol: str, after: Vector) -> tuple[Vector, int]:
    """Costs to go before a row, less their least, and that least; those after it have the least 0.

    Differences of costs are bounded, so few vectors occur and a long run walks through a short cycle of them.
    """
    before = onto(transition(symbol), after)
    least = min(before)
    return tuple(x - least for x in before), least


@functools.lru_cache(1 << 16)
def choice(symbol: str, after: Vector, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits that consume a row in a state, and the next state."""
    done = ""
    costs = onto(transition(symbol), after)
    while True:
        options = [(edit, after[then]) for edit, cost, then in edits(symbol, state) if cost + after[then] == costs[state]]
        turn = MOVES[WANTED[state]][state]
        if INSERT + costs[turn] == costs[state] and not (options and options[0][0] == "D"):
            done, state = done + "I", turn
            continue
        edit = options[0][0]
        return done + edit, next(then for e, _, then in edits(symbol, state) if e == edit)


def unroll(symbols: str, end: Vector, last: bool, entries: range) -> list[tuple[str, int]]:
    """(edits, state after them) of a chunk for each state it may be entered in; ``end`` has the costs after it."""
    least = min(end)
    at = [tuple(x - least for x in end)]
    for symbol in reversed(symbols):
        at.append(back(symbol, at[-1])[0])
    at.reverse()
    out = []
    for state in entries:
        parts = []
        for symbol, after in zip(symbols, at[1:], strict=True):
            edit, state = choice(symbol, after, state)
            parts.append(edit)
        while last and CLOSE[state]:
            parts.append("I")
            state = MOVES[WANTED[state]][state]
        out.append(("".join(parts), state))
    return out


def placed(symbols: str, entry: int, audit: str) -> Iterator[tuple[int, list[str], str | None]]:
    """(offset of the row, roles inserted before it, new role: empty if kept, null if deleted) where anything stays."""
    state, offset, before = entry, 0, []
    for edit in audit:
        if edit == "I":
            before.append(NAMES[WANTED[state]])
            state = MOVES[WANTED[state]][state]
            continue
        role = None
        if edit == "K":
            role, state = "", MOVES[SYMBOLS[symbols[offset]][0]][state]
        elif edit == "R":
            role, state = NAMES[WANTED[state]], MOVES[WANTED[state]][state]
        if before or role is not None:
            yield offset, before, role
        offset, before = offset + 1, []
    if before:
        yield offset, before, None


# --- Spark ----------------------------------------------------------------------------------------


def lines_of(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Stored rows (c, turn, role, text, blank, cut, same, number) in the order of each conversation.

    A null role or text is one space. Rows with the same turn (null first) are ordered by ``same``, the digest of role and text.
    """
    role, text = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    bare = F.rtrim(text, F.lit(SPACE))
    same = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    read = rows.select(F.col(key).alias("c"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text"), (bare == "").alias("blank"),
                       (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), same.alias("same"))
    return numbered(read, ["c"], ["turn", "same"]).drop("total")


def marked(lines: DataFrame) -> DataFrame:
    """(c, number, turn, initial, fault) of every row; the first fault counts. Long texts stay behind."""
    narrow = lines.select("c", "number", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "cut", "same")
    # the first of equal rows, by its place: no key of this join stands twice
    firsts = narrow.groupBy("c", "same").agg(F.min("number").alias("number_")).select(F.col("c").alias("c_"), "number_")
    joined = narrow.join(firsts, F.col("c").eqNullSafe(F.col("c_")) & (F.col("number") == F.col("number_")), "left")
    fault = (F.when(F.col("blank"), "blank").when(F.col("number_").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("none"))
    return joined.select("c", "number", "turn", "initial", fault.alias("fault"))


def _streamed(rows: DataFrame, schema: str, step) -> DataFrame:
    """``step`` takes an iterator of batches of tuples, and yields lists of tuples of ``schema``."""
    fields = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = to_arrow_schema(fields)
        for out in step(zip(*[c.to_pylist() for c in b.columns], strict=True) for b in batches):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), made, strict=True)], schema=made)

    return rows.mapInArrow(run, fields)


def _ordered(rows: DataFrame, *order: Column | str) -> DataFrame:
    return rows.repartition("c").sortWithinPartitions("c", *order)


def plan(faults: DataFrame) -> DataFrame:
    """Stored chunks (c, chunk, symbols, entry, audit, illegal, cost) of all conversations; the cost stands in chunk 0."""
    kind = F.when(F.col("initial").isin(*CLASSES[:3]), F.instr(F.lit(CLASSES), F.col("initial"))).otherwise(4) - 1
    fault = F.when(F.col("fault") == "none", 0).when(F.col("fault") == "truncated", 1).otherwise(2)
    symbol = F.char((F.lit(65) + kind * 3 + fault).cast("long"))
    in_order = F.array_sort(F.collect_list(F.struct("number", symbol.alias("symbol"))))
    # a chunk has a bounded number of rows
    chunks = faults.groupBy("c", F.call_function("div", F.col("number"), F.lit(CHUNK)).alias("chunk")).agg(
        F.array_join(F.transform(in_order, lambda x: x["symbol"]), "").alias("symbols"))
    of = chunks.schema["c"].dataType.simpleString()

    def sums(batches):
        known = functools.lru_cache(1 << 14)(summed)
        for batch in batches:
            yield [(c, chunk, symbols, [x for row in (known if len(symbols) < 64 else summed)(symbols) for x in row]) for c, chunk, symbols in batch]

    def backwards(batches):
        now, end, follows = (), CLOSE, ""
        for batch in batches:
            out = []
            for c, chunk, symbols, flat in batch:
                if now != (c,):
                    now, end, follows = (c,), CLOSE, ""
                seen = symbols + follows
                illegal = sum((SYMBOLS[a][0], SYMBOLS[b][0]) not in LEGAL for a, b in itertools.pairwise(seen))
                before = onto(tuple(tuple(flat[k:k + 4]) for k in range(0, 16, 4)), end)
                out.append((c, chunk, symbols, list(end), int(not follows), illegal, before[START]))
                end, follows = before, symbols[0]
            yield out

    def unrolled(batches):
        known = functools.lru_cache(1 << 14)(unroll)
        for batch in batches:
            out = []
            for c, chunk, symbols, end, last, illegal, cost in batch:
                made = (known if len(symbols) < 64 else unroll)(symbols, tuple(end), bool(last), range(4 if chunk else 1))
                out.append((c, chunk, symbols, [a for a, _ in made], [s for _, s in made], illegal, None if chunk else cost))
            yield out

    def forwards(batches):
        now, state = (), START
        for batch in batches:
            out = []
            for c, chunk, symbols, audits, exits, illegal, cost in batch:
                if now != (c,):
                    now, state = (c,), START
                out.append((c, chunk, symbols, state, audits[state], illegal, cost))
                state = exits[state]
            yield out

    head = f"c {of}, chunk long, symbols string"
    made = _streamed(chunks, f"{head}, flat array<long>", sums)
    made = _streamed(_ordered(made, F.desc("chunk")), f"{head}, end array<long>, last int, illegal long, cost long", backwards)
    made = _streamed(made.repartition("c", "chunk"), f"{head}, audits array<string>, exits array<int>, illegal long, cost long", unrolled)
    return stored(_streamed(_ordered(made, "chunk"), f"{head}, entry int, audit string, illegal long, cost long", forwards), "plan")


def repaired(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows that stay or come in: c, number (of the row they stand at), sub, role, text, edit."""
    def kept(batches):
        for batch in batches:
            yield [(c, chunk * CHUNK + offset, before, role) for c, chunk, symbols, entry, audit in batch
                   for offset, before, role in placed(symbols, entry, audit)]

    of = chunks.schema["c"].dataType.simpleString()
    places = _streamed(chunks.select("c", "chunk", "symbols", "entry", "audit"), f"c_ {of}, number_ long, before array<string>, to string", kept)
    same = F.col("c").eqNullSafe(F.col("c_")) & (F.col("number") == F.col("number_"))
    met = places.join(lines.select("c", "number", "role", "text"), same, "left")

    def row(role: Column, text: Column, edit: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"), edit.alias("edit"))

    inserted = F.transform("before", lambda r: row(r, F.lit(""), F.lit("I")))
    own = F.when(F.col("to") == "", row(F.col("role"), F.col("text"), F.lit("K"))).when(
        F.col("to").isNotNull(), row(F.col("to"), F.col("text"), F.lit("R")))
    out = F.array_compact(F.concat(inserted, F.array(own)))
    return met.select(F.col("c_").alias("c"), F.col("number_").alias("number"), F.posexplode(out).alias("sub", "row")).select("c", "number", "sub", "row.*")


def digests(rows: DataFrame) -> DataFrame:
    """(c, sha256) of the ``role:text`` lines of each conversation, joined by newlines; the lines stream by, none is kept."""
    of = rows.schema["c"].dataType.simpleString()

    def run(batches):
        now, digest = (), None
        for batch in batches:
            out = []
            for c, role, text in batch:
                if now != (c,):
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (c,), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield out
        if now:
            yield [(*now, digest.hexdigest())]

    return _streamed(_ordered(rows, "number", "sub").select("c", "role", "text"), f"c {of}, sha256 string", run)


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(audit, repaired rows) of all conversations.

    Audit: ``key``, gaps (turns that are missing between the least and the largest, nulls left out), blank, duplicate,
    truncated, illegal (adjacent initials other than su, ua, au), cost, audit (the letters of the cheapest edits in order,
    ties ASCII-least), repaired_sha256 (of the ``role:text`` lines, joined by newlines). Repaired rows: ``key``, place, role, text, edit
    (K, R or I), where place orders them. A null key is a conversation of its own; a null role or text is one space,
    which is blank. Rows that share a turn come in the order of their digests; repeated rows are duplicates. A conversation
    without a row that stays has no repaired row. An empty table gives empty results. Other columns do not matter.
    """
    lines = lines_of(rows, key, turn, role, text)
    faults = stored(marked(lines), "faults")
    chunks = plan(faults)
    fixed = repaired(lines, chunks)
    turns = F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = faults.groupBy("c").agg(F.coalesce(turns.cast("long"), F.lit(0)).alias("gaps"), *[
        F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    # letters of a chunk are joined in order: a value as long as the audit itself
    edits_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "")
    plans = chunks.groupBy("c").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"), edits_of.alias("audit"))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256"]
    parts = [counts, plans, digests(fixed)]
    united = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    audit = united.groupBy("c").agg(*[F.max(n).alias(n) for n in names]).select(
        F.col("c").alias(key), *names[:-1], F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    place = F.struct("number", "sub").alias("place")
    return audit, fixed.select(F.col("c").alias(key), place, "role", "text", "edit")
