import collections
import random
import re

from cases import documents, odd_texts, of, prose

from busline.llm import pii

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def right(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in text.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits),
            "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, text or "") if right(kind, m.group())]
    return sorted(found)


def card(rng):
    while True:
        number = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if luhn(number):
            return number


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(7)
    odd = ["a@b.c_d@e.f", "a@@b.co a@b@c.de x.@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.2.3", "1" * 30000, "1 " * 9000, "a@b" + ".c" * 9000, "+1 (234) 567-8901 x",
           "++1 2 3 4 5 6 7 8 9 0 1-", "4111 1111-1111 1111 ", "日本 me@example.com ü 10.0.0.1", "a" * 50000 + "@b", "x@y.z" * 400]
    letters = "ab@.+ -()0123456789_%"
    texts = [*odd_texts(rng), *odd, *("".join(rng.choice(letters) for _ in range(120)) for _ in range(150))]
    texts += [f"{prose(rng, 5)} {card(rng)} {prose(rng, 3)}" for _ in range(10)]
    docs = documents(spark, texts).withColumnRenamed("lang", "spans")
    found = pii.candidates(docs)
    got = of(pii.select(found, pii.fit(found)))
    names = [k for k, _ in BASE]
    for i, text in enumerate(texts):
        assert [(s.start, names.index(s.kind), s.end) for s in got[i].spans if s.base] == brute(text), repr((text or "")[:60])
        assert [(s.start, names.index(s.kind), s.end) for s in got[i].spans] == sorted((s.start, names.index(s.kind), s.end) for s in got[i].spans)


def test_trees_add_cards_that_stand_together(spark):
    rng = random.Random(1)
    texts = [f"{prose(rng, 6)} {card(rng)} {prose(rng, 6)}" for _ in range(60)]
    texts += [f"{prose(rng, 6)} {rng.randrange(10**rng.randint(2, 15))} {prose(rng, 6)}" for _ in range(60)]
    two = f"pay {card(rng)} {card(rng)} now"
    docs = documents(spark, [*texts, two, prose(rng, 30)])
    found = pii.candidates(docs)
    got = of(pii.select(found, pii.fit(found)))
    assert [(s.kind, s.base) for s in got[len(texts)].spans] == [("card", False)] * 2
    assert got[len(texts) + 1].spans == []
    masked = of(pii.redact(docs))
    assert masked[len(texts)].text == "pay [card] [card] now" and masked[len(texts) + 1].text == docs.filter(f"doc_id = {len(texts) + 1}").first().text
    kinds = collections.Counter(s.kind for r in masked.values() for s in r.spans)
    assert set(kinds) == {"card"}


def test_further_candidates_are_labelled_and_calibrated(spark):
    rng = random.Random(5)
    number = lambda: f"+1 {rng.randint(200, 999)} {rng.randint(200, 999)} {rng.randint(1000, 9999)}"
    texts = [f"{prose(rng, rng.randint(1, 9))} {number()} x@y.com" for _ in range(80)]
    texts += [f"{prose(rng, rng.randint(1, 9))} {number()} 222 333 4444 555" for _ in range(80)]  # part of no phone number
    found = pii.candidates(documents(spark, texts))
    model = pii.fit(found)
    assert model.calibrated == [False, False, True, True]  # digits that are no card are wrong spans of cards
    got = of(pii.select(found, model))
    assert all([(s.kind, s.base) for s in got[i].spans] == ([("phone", True), ("email", True)] if i < 80 else []) for i in range(160))


def test_nothing_to_learn_from(spark):
    docs = documents(spark, ["me@example.com", None, ""])
    assert [len(r.spans) for _, r in sorted(of(pii.redact(docs)).items())] == [1, 0, 0]
    assert pii.redact(documents(spark, [])).count() == 0
