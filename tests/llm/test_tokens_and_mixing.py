import base64
import random

import pytest

from wachbuch.llm import mixing, tokens


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(f"{tokens.FOLDER}/{tokens.DEFAULT}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_another_library_and_round_trip(reference):
    v, rnd = tokens.vocabulary(), random.Random(1)
    texts = ["", " ", "Straße  in\r\nBremen", "a" * 20_000, "<|endoftext|>", "'s 't 漢字 é́ 🚓‍", "\x00\x1b"] + ["".join(rnd.choice("aabcdeé ß漢\n1. ") for _ in range(rnd.randrange(80))) for _ in range(300)]
    for t in texts:
        assert v.encode(t) == reference.encode_ordinary(t)
        assert v.decode(v.encode(t)) == t


def test_null_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "Haus", 7), (3, "Haus", 7)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, len(r.ids)) for r in tokens.encode(df).collect())
    assert got == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert tokens.encode(df.where("false")).count() == 0
    assert {r.text for r in tokens.decode(tokens.encode(df)).collect()} == {"", "Haus"}


def test_shares_are_met_within_the_repeats(spark):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(k, rnd.choice("aaaab"), rnd.randrange(5, 60)) for k in range(3000)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("c", 0.0, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.shares(docs, targets).collect()}
    assert abs(got["a"].actual_share - 0.5) < 0.01 and got["b"].repeats <= 3 and got["a"].repeats == 1
    p = mixing.positions(docs, targets).collect()
    assert all(0 <= r.position <= 1 for r in p) and len({(r.doc_id, r.copy_no) for r in p}) == len(p)
    # more than there is: capped, and the shares that are reached are told
    much = {r.source: r for r in mixing.shares(docs, targets, total=10**9).collect()}
    assert much["b"].repeats == 3 and much["a"].actual_share > 0.5
    # early positions follow the schedule: the larger share is not front-loaded beyond its tilt
    first = [r for r in p if r.position < 0.5]
    assert 0.3 < sum(r.tokens for r in first if r.source == "a") / sum(r.tokens for r in first) < 0.8


def test_mixing_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "a", None, 2)], "doc_id long, source string, text string, tokens int")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    s = mixing.sized(docs)
    assert s.count() == 0 and mixing.positions(s, targets).count() == 0
    assert [r.tokens for r in mixing.shares(s, targets).collect()] == [0]
