import json
import os
import random

import pytest
from pyspark.sql import functions as F

from geoweft.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.TOKENIZER_DIR, bpe.VOCABULARY + ".json")), reason="no tokenizer files")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(bpe.TOKENIZER_DIR, bpe.VOCABULARY + ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def texts():
    rng = random.Random(6)
    yield from ["", " ", "\n\n", "don't we'll  x   ", "<|endoftext|> a", "日本語のテキスト🙂", "a" * 9000, " " * 9000 + "x", "ab" * 6000, "\n" * 5000 + "  hi", "1" * 9001, "'" * 5000 + "s", "x" * 5000 + "'ll", "　" * 5000 + "a", "é" * 6000]
    for _ in range(120):
        yield "".join(rng.choice("abcdehnrst   \n'1.,!é漢🙂") for _ in range(rng.randint(1, 2500)))


def test_equals_library_whole_and_in_pieces(library):
    rng = random.Random(1)
    encoder = bpe.load()
    for t in texts():
        want = library(t)
        assert encoder.encode(t) == want
        pieces, got, at = bpe.Encoder(encoder.v), [], 0
        while at < len(t):
            n = rng.randint(1, 200)
            got += pieces.feed(t[at : at + n])
            at += n
        assert got + pieces.feed("", True) == want


def test_memory_is_bounded_and_every_token_is_its_own_encoding():
    v = bpe.load().v
    t = bpe.Transducer(v)
    for _ in range(200):
        t.feed(b"ab" * 500)
        assert len(t.window) <= 16 * v.longest
        assert len(t.window) <= v.lookahead + 5 * v.longest
    for b, i in list(v.id_of.items())[::7]:
        t = bpe.Transducer(v)
        t._advance(b)
        assert t.finish() == [i]


def naive(rules, text):
    """Merges by the rules in order, each from left to right."""
    parts = list(text)
    for a, b in rules:
        i = 0
        while i + 1 < len(parts):
            if (parts[i], parts[i + 1]) == (a, b):
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


def small_vocabulary(tmp_path, rules):
    tokens = sorted({c for r in rules for c in "".join(r)}) + [a + b for a, b in rules]
    path = tmp_path / f"v{abs(hash(tuple(rules)))}.json"
    path.write_text(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(r) for r in rules]}}))
    return bpe.Vocabulary(str(path))


def merge_lists():
    # a chain: what follows decides how all the letters before it pair up
    yield [(c, d) for c, d in zip("fedcb", "gfedc", strict=True)]
    yield [("a", "a"), ("aa", "aa"), ("aaaa", "aaaa"), ("aaaa", "b"), ("aa", "b"), ("a", "b")]
    rng = random.Random(12)
    for _ in range(60):
        tokens, rules = list("abc"), []
        for _ in range(rng.randint(2, 14)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if "".join(pair) not in tokens:
                rules.append(pair)
                tokens.append("".join(pair))
        # as in a trained merge list, every token is its own encoding
        while bad := [r for r in rules if naive(rules, "".join(r)) != ["".join(r)]]:
            lost = "".join(bad[-1])
            rules = [r for r in rules if lost not in ("".join(r), *r)]
        if rules:
            yield rules


def test_lookahead_is_sufficient_and_bounds_the_window(tmp_path):
    rng, reached = random.Random(3), 0
    for rules in merge_lists():
        v = small_vocabulary(tmp_path, rules)
        letters = sorted({c for r in rules for c in "".join(r)})
        for _ in range(40):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
            borders = []
            for more in ["", *["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(12)]]:
                at, ends = 0, set()
                for t in naive(rules, text + more):
                    at += len(t)
                    ends.add(at)
                borders.append(ends)
            moved = [e for ends in borders for e in ends ^ borders[0] if e < len(text)]
            assert all(len(text) - e < v.lookahead or len(text) - e <= 0 for e in moved), (rules, text)
            reached = max(reached, max((len(text) - e for e in moved), default=0))
            t, got = bpe.Transducer(v), []
            for c in text:
                got += t.feed(c.encode())
                assert len(t.window) <= v.lookahead + v.longest + 1
            assert [v.bytes_of[i].decode() for i in got + t.finish()] == naive(rules, text)
    assert reached > 2


def test_round_trip_and_frames(spark):
    long = "wörd 漢字 🙂 " * 20_000
    df = spark.createDataFrame([(1, "Hello  world", 0), (2, None, 0), (3, "", 0), (4, long, 0), (4, long, 0)], "doc_id long, text string, ids int")
    out = bpe.encoded_corpus(df)
    rows = out.withColumn("back", bpe.decoded(F.col("ids"))).collect()
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")] and len(rows) == 5
    assert {r.doc_id: r.back for r in rows} == {1: "Hello  world", 2: "", 3: "", 4: long}
    assert [r.ids for r in rows if r.doc_id in (2, 3)] == [[], []]
    assert [r[0] for r in df.select(bpe.token_count(F.col("text"))).collect()] == [len(r.ids) for r in rows]
    assert bpe.encoded_corpus(df.where("false")).count() == 0


def test_decoder_waits_for_whole_characters():
    v = bpe.load().v
    ids = [v.id_of[bytes([b])] for b in "漢🙂".encode()]
    d = bpe.Decoder(v)
    assert [d.feed([i]) for i in ids] == ["", "", "漢", "", "", "", "🙂"]
