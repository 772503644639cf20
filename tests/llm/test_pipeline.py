import random

from cases import SCHEMA, prose

from busline.llm.queries import ORACLES, QUERIES


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)

    def clean():
        return "\n".join("The " + prose(rng, 12) + " of " + prose(rng, 3) + "." for _ in range(6))

    passage, item = "The " + prose(rng, 60) + ".", prose(rng, 20)
    base = clean().replace("\n", " ")  # one line, so that line dedup leaves the near copy alone
    near = base.replace(base.split()[7], "changed", 1)
    texts = [clean() for _ in range(20)] + [base, base, near, f"{clean()}\n{passage}", f"{clean()}\n{passage}", f"{clean()}\nThe {item}.", "too short", None,
                                            " ".join(w + "&&&" for w in prose(rng, 100).split())]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if n + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["quality rules"]) == set(range(26))
    lines = seen["line dedup"]
    assert 21 not in lines and passage in lines[23].text and passage not in lines[24].text and lines[24].n_chars == len(lines[24].text)
    assert set(lines) - set(seen["near duplicates"]) == {22} & set(lines)
    assert set(seen["near duplicates"]) - set(seen["decontamination"]) == {25}
    assert set(range(21)) <= set(seen["tokenisation"])
    final = seen["tokenisation"]
    assert all(final[d].decoded == seen["decontamination"][d].text for d in final)
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in ran} == {d: r.n_tokens for d, r in final.items()}


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(ORACLES) <= set(QUERIES)
