import random

from cases import SCHEMA, documents, odd_texts, of, prose

from busline.llm import winnow


def brute(texts, least=50):
    """Every run of lines with enough words that occurs earlier, without overlap, loses its lines."""
    lines = [[(i, s.strip(" \t\n\x0b\f\r")) for i, s in enumerate((t or "").split("\n"))] for t in texts]
    lines = [[(i, s) for i, s in d if s] for d in lines]
    order, gone = {}, [set() for _ in texts]
    runs = []
    for d, held in enumerate(lines):
        for a in range(len(held)):
            for b in range(a, min(len(held), a + least)):
                if sum(len(s.split()) for _, s in held[a:b + 1]) >= least:
                    runs.append((tuple(s for _, s in held[a:b + 1]), d, held[a][0], held[b][0]))
    for body, d, first, last in sorted(runs, key=lambda r: r[1:]):
        if body not in order:
            order[body] = (d, last)
        elif order[body][0] != d or first > order[body][1]:
            gone[d] |= set(range(first, last + 1))
    return [None if t is None else "\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(texts)]


def test_later_runs_go(spark):
    rng = random.Random(9)
    passage, short = prose(rng, 55), prose(rng, 10)
    run = "\n".join(prose(rng, 12) for _ in range(6))
    texts = [*odd_texts(rng), passage, f"{short}\n{passage}\nend {short}", f"start\n\n{run}\n{short}", f"{short}\n  {run}\n\n{short}", short, short,
             "\n".join(run.split("\n")[1:6]), "\n".join(run.split("\n")[:4]), ("la li\n" * 200).strip(), f"{passage}\n{run}\n{passage}", run.replace("\n", "\r\n")]
    docs = documents(spark, texts).withColumnRenamed("lang", "n_removed")
    got = of(winnow.dedup_lines(docs))
    assert [got[i].text for i in range(len(texts))] == brute(texts)


def test_repeated_rows_null_ids_and_empty_table(spark):
    passage = prose(random.Random(1), 60)
    rows = [(None, passage, None, None, None), (2, passage, None, None, None), (2, passage, None, None, None), (3, "x\n" + passage, None, None, None)]
    got = sorted((r.doc_id or 99, r.text) for r in winnow.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(2, passage), (2, passage), (3, "x"), (99, "")]
    assert winnow.dedup_lines(documents(spark, [])).count() == 0
