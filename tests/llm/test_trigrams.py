import random
import re
import time

from cases import documents, odd_texts, of, prose

from busline.llm import trigrams
from busline.llm.trigrams import ALL, Rule


def test_queries_hold_for_every_match():
    assert trigrams.query_of(Rule("h", "[0-9a-f]+")) == ALL
    assert trigrams.query_of(Rule("a", "ab")) == ALL
    assert trigrams.query_of(Rule("a", "(abc|d)e*")) == ALL
    for rule, texts in ((Rule("k", "AKIA[A-Z]+"), ["x AKIAB"]), (Rule("t", "(foo|bar)x?baz", any_case=True), ["FOObaz", "barXbaz"]),
                        (Rule("r", "(?:abc){2}[0-9]"), ["abcabc1"]), (Rule("o", "api_?key"), ["apikey", "api_key"]),
                        (Rule("n", "(a[bc]d)+?e"), ["abdacde"])):
        query = trigrams.query_of(rule)
        assert query != ALL
        for text in texts:
            assert rule.compiled().search(text)
            index = trigrams.segment_index([b"nothing here", text.encode(), "é".encode()])
            assert 1 in trigrams.candidates(index, query, 3).tolist()
        assert trigrams.candidates(trigrams.segment_index([b"nothing here"]), query, 1).tolist() == []


def test_scan_equals_plain_search(spark):
    rng = random.Random(8)
    key = "AKIA" + "Z" * 18
    texts = [*odd_texts(rng), f"Password: hunter22 {key}", "token=abc", 'api_key = "a1b2c3d4"; APIKEY:zzzzzz', "0123456789abcdef" * 3,
             prose(rng, 50) + " é secret:'q/w+e=r.t'", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "tokenſ = secretvalue", "password=password=secret"]
    docs = documents(spark, texts).withColumnRenamed("lang", "secrets")
    got = of(trigrams.scan(docs))
    for i, text in enumerate(texts):
        want = sorted((m.start(), n, m.end(), r.kind) for n, r in enumerate(trigrams.RULES)
                      for m in re.finditer(r.pattern, text or "", re.A | (re.I if r.any_case else 0)) if len(m.group(r.group)) >= r.least)
        assert [(s.start, s.end, s.kind) for s in got[i].secrets] == [(a, b, k) for a, _, b, k in want]
    assert trigrams.scan(documents(spark, [])).count() == 0


def test_logins_of_any_length(spark):
    texts = [f"clone {'s' * 40}+https://{'u' * 150}:{'t.K-' * 400}@host/x", f"a://u:{'p' * 5000}@h b1://{'u' * 101}:abc@h 1+z://u:abc@ +a://u:abc@"]
    got = of(trigrams.scan(documents(spark, texts)))
    for i, text in enumerate(texts):
        spans = [text[s.start:s.end] for s in got[i].secrets if s.kind == "url_login"]
        assert spans == ([text[6:text.index("@") + 1]] if i == 0 else [f"b1://{'u' * 101}:abc@"])


def test_logins_equal_their_pattern_in_linear_time():
    rng = random.Random(9)
    rule = next(r for r in trigrams.RULES if r.kind == "url_login")
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "b", "1", "+", "é", "A", "://", "://", ":", "@", "/", " ", "abc"]) for _ in range(rng.randint(1, 24)))
        assert list(trigrams.logins(text)) == [m.span() for m in rule.compiled().finditer(text)]
    start = time.process_time()
    for part in ("3fa9c", "a", "a://", "aa://u:", "aa://b", "ab://u:abc@"):
        list(rule.finder()("x://" + part * 300_000))
    assert time.process_time() - start < 20
