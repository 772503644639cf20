import collections
import random
import zlib

import numpy as np
from cases import documents, of

from busline.llm import jumphash


def plain(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_scalar_form():
    keys = [0, 1, -1, 2**63 - 1, -2**63, *(random.Random(2).randrange(-2**63, 2**63) for _ in range(500))]
    for shards in (1, 2, 24, 25, 1000):
        assert jumphash.jump(np.array(keys), shards).tolist() == [plain(k % 2**64, shards) for k in keys]


def test_assignment(spark):
    rng = random.Random(3)
    texts = [None, "", "é", *("".join(rng.choice("abc é") for _ in range(rng.randint(0, 50))) for _ in range(400))]
    got = of(jumphash.assign(documents(spark, texts).withColumnRenamed("lang", "shard"), 5))
    slots = collections.defaultdict(list)
    for i, text in enumerate(texts):
        r, body = got[i], (text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key")
        assert r.shard == plain(i, 5) and r.grown_shard == plain(i, 6) and r.grown_shard in (r.shard, 5)
        slots[r.shard].append((r.slot, i))
    for held in slots.values():
        assert [s for s, _ in sorted(held)] == list(range(len(held))) and sorted(held) == sorted(held, key=lambda x: x[1])


def test_null_and_repeated_keys_and_files(spark, tmp_path):
    rows = [(None, "a")] * 30 + [(7, "b")] * 30 + [(i, "c") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jumphash.assign(docs, 3).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 100 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    jumphash.write_shards(docs, 3, f"{tmp_path}/shards", files=2)
    assert spark.read.parquet(f"{tmp_path}/shards").groupBy("shard").count().count() == len(slots)
    assert jumphash.assign(documents(spark, []), 3).count() == 0
