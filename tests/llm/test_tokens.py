"""Problems 4 and 6 against two tokenizer libraries and exact round trips."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from gavelspark.llm import bpe
from gavelspark.llm.encoding import encode_texts
from gavelspark.llm.queries import vocabulary
from gavelspark.llm.token_budget import token_budget

JSON, RANKS, MULTI = (vocabulary(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))
pytestmark = pytest.mark.skipif(not os.path.exists(JSON), reason="no vocabulary here")
HARD = ["", " ", "\n\n  x", "a" * 3000, "  lead", "it's we'll I'D '", "<|endoftext|> x", "é漢字🧪👨‍💻 ​﻿\x1c\x85", "tab\t\tx  \r\n", "1234567890 ½²", "aaaaaaaab aaaaab"]


def texts():
    rng = random.Random(1)
    pools = ["abcdefgh '\t\n ", "aaaa  ", "0123456789 .,", "é汉字ñ𝒳   \x85\x1c​", "'s're'll't's x", "إلا العربية", "हिन्दी"]
    return HARD + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60))) for _ in range(3000)]


def test_ids_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(JSON)
    reference.encode_special_tokens = True
    expected = [x.ids for x in reference.encode_batch(texts(), add_special_tokens=False)]
    for path in (JSON, RANKS):
        encoder, lattice = bpe.Encoder(path), bpe.CountLattice.of_merges(path)
        for text, ids in zip(texts(), expected):
            assert encoder.encode(text) == ids
            assert encoder.decode(ids) == text
            assert lattice.count_text(text) == len(ids)


def test_ranks_of_another_vocabulary():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    reference = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(MULTI)
    for text in texts()[:1500]:
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_unigram_lattice_equals_enumeration():
    rng = random.Random(2)
    names = [b"a", b"b", b"ab", b"ba", b"aba", b"bb", b"c"]
    scores = [-1.5, -1.7, -2.0, -2.2, -3.1, -2.9, -1.0]
    lattice = bpe.CountLattice(names, scores=scores)

    def best(s):
        if not s:
            return 0.0, 0
        options = []
        for n, w in zip(names, scores):
            if s.startswith(n):
                score, count = best(s[len(n) :])
                options.append((score + w, count - 1))
        return max(options)

    for _ in range(200):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        assert lattice.count(word) == -best(word.encode())[1]
    assert lattice.count("z") == 1 and math.isfinite(min(scores))


def test_trie():
    entries = {b"a": 1, b"ab": 2, b"\xff\x00": 3, b"b": 4}
    trie = bpe.DoubleArrayTrie(entries)
    assert list(trie.starts(b"abx", 0)) == [(1, 1), (2, 2)]
    assert list(trie.starts(b"\xff\x00", 0)) == [(2, 3)]
    assert list(trie.starts(b"x", 0)) == []


def test_encode_texts(spark):
    rows = [(1, "hello world", "x", "y"), (1, "hello world", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y"), (None, " ", "x", "y"), (4, "word " * 200_000, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, keys string")
    got = encode_texts(df, "doc_id", "text", JSON)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    encoder = bpe.Encoder(JSON)
    assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == sorted((str(d), encoder.encode(t)) for d, t, *_ in rows)
    assert encode_texts(df.where("false"), "doc_id", "text", JSON).count() == 0


def test_token_budget(spark):
    rows = [
        (1, "s", "C++", "d", "2024-01-02", "ab cd", ["x y", None, ""]),
        (1, "s", "C++", "d", "2024-01-01", "ab cd", ["x y", None, ""]),
        (2, None, "cpp", None, "2024-01-01", None, None),
        (3, None, "cobol", None, None, "one", []),
        (None, "s", None, "d", None, "a", ["b"]),
        (None, "s", None, "d", None, "a", ["b"]),
    ]
    df = spark.createDataFrame(rows, "list_id long, source string, language string, domain string, ingested_at string, query string, candidates array<string>")
    names = spark.createDataFrame([("C++", "cpp"), ("C++", "cpp"), ("cpp", "cpp")], "spelling string, canonical string")
    lattice = bpe.CountLattice.of_merges(JSON)
    got = {(r.source, r.language, r.domain): (r.lists, r.query_tokens, r.candidate_tokens, r.tokens) for r in token_budget(df.withColumn("alone", F.lit(1)), names, lattice).collect()}
    ab, xy = lattice.count_text("ab cd"), lattice.count_text("x y")
    assert got == {("s", "cpp", "d"): (1, ab, xy, ab + xy), (None, "cpp", None): (1, 0, 0, 0), (None, "cobol", None): (1, 1, 0, 1), ("s", None, "d"): (2, 2, 2, 4)}
    assert token_budget(df.where("false"), names, lattice).count() == 0
