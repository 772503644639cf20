import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from cases import documents, odd_texts, of, prose

from busline.llm import pieces
from busline.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def test_rounds_equal_the_library(spark, vocabulary, library):
    rng = random.Random(5)
    texts = odd_texts(rng) + ["  two  spaces ", "▁a", " " * 40 + "x" + " " * 17 + "日", "<s></s><0x41>", "a\n\n b", "aab" * 900, "\x00\t"]
    for letters in ("ab ", "the ing\n", "日本文字 ", "== --//", "0123 .,", "▁ ax", "éèçêüß e"):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    docs = documents(spark, texts).withColumnRenamed("lang", "ids")  # a clashing column is replaced
    coded = of(pieces.decode(pieces.encode(docs, vocabulary), vocabulary))
    assert len(coded) == len(texts)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(coded[i].ids, "<u4").tolist() == want, repr(text[:60])
        assert coded[i].decoded == library.decode(want)


def test_decoding_any_ids(vocabulary, library):
    pieces.codecs.register_error("one_each", pieces._one_each)
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, 28705, 259, 260, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))]
        ids = [i for i in ids if i not in (1, 2)]  # begin and end stand at the ends of a text
        packed = np.array([1, *ids, 2], "<u4").tobytes()
        assert vocabulary.decode_ids(packed) == library.decode([1, *ids, 2]), ids
    assert vocabulary.decode_ids(None) is None


def test_query_digests(spark, tmp_path, library):
    from busline.llm.queries import QUERIES

    texts = [None, "Ein Text.\nZwei  Zeilen", prose(random.Random(1), 50)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = of(QUERIES["op5_sentencepiece"](spark, str(tmp_path)))
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_empty_table(spark, vocabulary):
    assert pieces.encode(documents(spark, []), vocabulary).count() == 0
