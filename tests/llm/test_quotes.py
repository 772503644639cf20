import random
import re

import pytest

from busline.llm import quotes

SCHEMA = "conv_id long, turn int, role string, text string, parent string"


def linked(spark, rows):
    return quotes.link(spark.createDataFrame(rows, SCHEMA).repartition(3))


def test_nested_quotes_link_and_order(spark):
    rows = [(1, 0, "a", "Hello there.\nHow are you?", None), (1, 1, "b", "On Monday, A wrote:\n> How  ARE you?\n\nFine.", None),
            (1, 2, "c", ">> How are you?\n> Fine.\nGood", None), (1, 3, "d", "> nobody said this\nok", None), (1, 4, "e", "> good\n\nyes", None),
            (1, 5, "f", ">Hello there.\n>How are you?\nback to the start", None), (2, 0, "g", "> Fine.", None)]
    got = linked(spark, rows).orderBy("conv_id", "root", "depth", "turn").collect()
    assert [(r.conv_id, r.turn, r.parent, r.root, r.depth) for r in got] == [
        (1, 0, None, 0, 0), (1, 1, 0, 0, 1), (1, 5, 0, 0, 1), (1, 2, 1, 0, 2), (1, 4, 2, 0, 3), (1, 3, None, 3, 0), (2, 0, None, 0, 0)]
    assert [r.text for r in got] == ["Hello there.\nHow are you?", "Fine.", "back to the start", "Good", "yes", "ok", ""]
    assert [r.n_quotes for r in got] == [0, 1, 1, 2, 1, 1, 1]


def test_quotes_of_later_messages_do_not_link(spark):
    got = linked(spark, [(1, 0, "a", "> later", None), (1, 1, "b", "later", None)]).collect()
    assert all(r.parent is None for r in got)


def test_nulls_repeats_and_a_long_chain(spark):
    rows = [(None, 1, "a", "> x", None), (1, None, "a", "x", None), (1, 0, "a", None, None), (3, 0, "a", "start 0", None), (3, 0, "a", "start 0", None)]
    rows += [(3, i, "b", f"> start {i - 1}\nstart {i}", None) for i in range(1, 40)] + [(3, 39, "b", "again", None)]
    got = linked(spark, rows).collect()
    assert len(got) == len(rows)
    assert {r.turn: r.depth for r in got if r.conv_id == 3} == {i: i for i in range(40)}
    assert [r.text for r in got if r.conv_id == 1 and r.turn == 0] == [None]
    assert quotes.link(spark.createDataFrame([], SCHEMA)).count() == 0


def plain(rows):
    """(conv_id, turn, parent, n_linked) by crediting every quoted piece to every earlier holder."""
    tidy = lambda s: re.sub(r"\s+", " ", s.lower()).strip(" ")
    cut = lambda s: list(dict.fromkeys(u for u in map(tidy, [s, *re.split(r"\n\s*\n", s), *s.split("\n")]) if u))
    units, quoted = {}, {}
    for conv, turn, _, text, _ in rows:
        own, passages, before = [], [], 0
        for line in text.split("\n"):
            marks = re.match(r"\s*(?:>\s?)+", line)
            level, line = (marks[0].count(">"), line[marks.end():]) if marks else (0, line)
            if level and level == before:
                passages[-1][1].append(line)
            elif level:
                passages.append((level, [line]))
            else:
                own.append(line)
            before = level
        units.setdefault((conv, turn), set()).update(cut("\n".join(own).strip("\n \t\r")))
        quoted.setdefault((conv, turn), []).extend((level, p) for level, lines in passages for p in cut("\n".join(lines)))
    out = set()
    for (conv, turn), pieces in quoted.items():
        best = []
        for (c, source), own in units.items():
            for level in {level for level, _ in pieces}:
                linked = [len(p) for at, p in pieces if at == level and p in own]
                if c == conv and source < turn and linked:
                    best.append((level, -sum(linked), source, len(linked)))
        out |= {(conv, turn, min(best)[2], min(best)[3])} if best else set()
    return out


def test_parent_is_the_message_quoted_most_of(spark):
    rows = [(1, 0, "a", "Best regards from Bern\nx", None), (1, 1, "a", "Best regards from Bern\nC\nD", None), (1, 2, "a", "> Best regards from Bern\n> C", None)]
    got = {r.turn: r for r in linked(spark, rows).collect()}
    assert (got[2].parent, got[2].root, got[2].depth, got[2].n_linked) == (1, 1, 1, 2)


def test_quotes_are_cut_at_blank_lines(spark):
    rows = [(1, 0, "a", "one two\nthree\n\nfour", None), (1, 1, "a", "> one\n> two three\n>\n> nobody said", None)]
    assert [(r.turn, r.parent, r.n_linked) for r in linked(spark, rows).orderBy("turn").collect()] == [(0, None, 0), (1, 0, 1)]


@pytest.mark.parametrize("few", [0, 2, quotes.FEW])
def test_parents_equal_plain_crediting(spark, few):
    rng = random.Random(3)
    lines = ["hello", "hello all", "best regards", "-- sent from afar", "ok", *(f"line {i} {'x' * (i % 7)}" for i in range(25))]
    rows = []
    for turn in range(90):
        pick = lambda: [rng.choice(lines[:5] if rng.random() < 0.6 else lines) for _ in range(rng.randint(1, 5))]
        text = [*pick(), *([""] * rng.randint(0, 1)), *pick()]
        for _ in range(rng.randint(0, 3)):
            mark = rng.choice([">", "> ", ">> ", ">>"])
            text += [mark + s for s in (*pick(), *([""] * rng.randint(0, 1)), *pick())] + rng.choice([[], ["", "well"]])
        rows.append((turn % 2, turn // 2, "a", "\n".join(text), None))
    got = quotes.parents(spark.createDataFrame(rows, SCHEMA).repartition(3), few).collect()
    want = plain(rows)
    assert len(want) > 60 and len(got) == len(want)
    assert {(r.conv_id, r.turn, r.parent, r.n_linked) for r in got} == want


def test_query_columns_equal_plain_python(spark, tmp_path):
    from busline.llm.queries import QUERIES

    rng = random.Random(11)
    lines = ["hello", "Best  Regards", "see you", *(f"line {i}" for i in range(12))]
    rows = []
    for turn in range(40):
        text = [rng.choice(lines) for _ in range(rng.randint(1, 3))]
        if turn % 4:
            text += ["A wrote:", *(f"> {rng.choice(lines)}" for _ in range(rng.randint(1, 3))), "> ", *(f">> {rng.choice(lines)}" for _ in range(turn % 3)), "well"]
        rows.append((turn % 2, turn // 2, "a", "\n".join(text), None))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    up = {(c, t): (p, n) for c, t, p, n in plain(rows)}
    want = []
    for conv, turn, role, text, _ in rows:
        root, depth = turn, 0
        while (conv, root) in up:
            root, depth = up[conv, root][0], depth + 1
        own = "\n".join(s for s in text.split("\n") if not s.startswith(">") and s != "A wrote:")
        passages = re.findall(r"(?:^> .*\n?)+|(?:^>> .*\n?)+", text, re.M)
        parent, n = up.get((conv, turn), (None, 0))
        want.append((conv, turn, role, own, parent, root, depth, len(passages), n))
    got = QUERIES["op3_quotation_links"](spark, str(tmp_path))
    got = got.select("conv_id", "turn", "role", "text", "parent", "root", "depth", "n_quotes", "n_linked").collect()
    assert len(up) > 20 and sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_query_covers_all_messages(spark):
    from busline.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = QUERIES["op3_quotation_links"](spark, folder)
    assert got.count() == spark.read.parquet(f"{folder}/conversations.parquet").count()
