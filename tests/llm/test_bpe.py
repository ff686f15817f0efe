import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from loomgraph.llm import bpe
from loomgraph.llm.shared import table

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids(codec, word):
    (_, found), = codec.tokens([word])
    return found.tolist()


def windowed(codec, word):
    return np.frombuffer(codec.long_word(word), np.uint16).tolist()


@pytest.mark.parametrize(("alphabet", "n"), [("ab", 300), ("acgt", 500), ("a", 1000), ("abcdefghij", 700), (" ", 400), ("éü漢", 200), ("the", 900)])
def test_long_words(codec, library, alphabet, n):
    rng = random.Random(n)
    word = "".join(rng.choice(alphabet) for _ in range(n)).encode()
    expected = library._encode_single_piece(word)
    assert ids(codec, word) == expected and windowed(codec, word) == expected


@pytest.mark.parametrize("part", ["a", "ab", "abc", "=-", "lorem", "abcdefghijklmnopqrstuvwxyz" * 3, " ", "漢字", "x" * 61 + "y", "-" * 67 + "="])
def test_repetitions(codec, library, part, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOWS", 7)
    for n in (193, 1000, 4001):
        word = (part.encode() * n)[:n]
        assert windowed(codec, word) == library._encode_single_piece(word)


def test_windows_out_of_step(codec, library, monkeypatch):
    """Steps that no token's length divides, and no room for a common token."""
    monkeypatch.setattr(bpe, "WINDOW", 40)
    for stride in (39, 37, 31, 7):
        monkeypatch.setattr(bpe, "STRIDE", stride)
        for word in (b"-" * 500, b"=" * 377, b"ab" * 200, bytes(random.Random(stride).choices(b"acgt", k=400))):
            assert windowed(codec, word) == library._encode_single_piece(word)


def test_very_long_texts(spark, library):
    """One letter run of 5 MB, one of random letters, and unspaced Chinese of 1 MB in one text and in thirty."""
    rng = random.Random(9)
    han = "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动"
    texts = ["a" * 5_000_000, "".join(rng.choices("acdeghinorst", k=400_000)), "".join(rng.choices(han, k=350_000))] + ["".join(rng.choices(han, k=11_000)) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in bpe.digests(rows).collect():
        expected = library.encode_ordinary(texts[r["id"]])
        assert r["n_tokens"] == len(expected)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["id"]].encode()).hexdigest()


def test_op2_query(spark, library, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    got = bpe.op2_bpe(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        expected = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(expected), hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_short_words(codec, library):
    rng = random.Random(1)
    for _ in range(60):
        word = "".join(rng.choice("abcdeñß漢🙂 ") for _ in range(rng.randint(1, 12))).encode()
        assert ids(codec, word) == library._encode_single_piece(word)


TEXTS = [None, "", " ", "\n\n  x", "don't STOP 1234567", "<|endoftext|>", "漢字 🙂 á", "the cat " * 500, "a" * 3000, "\x1c\x85  q"]


def test_texts(spark, library):
    rows = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 7, "x")], "doc_id long, text string, ids int, id string")
    for r in bpe.digests(rows).collect():
        expected = library.encode_ordinary(TEXTS[r["id"]] or "")
        assert r["n_tokens"] == len(expected)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["id"]] or "").encode()).hexdigest()
    coded = bpe.encode(rows)
    assert sorted((r["id"], r["ids"]) for r in coded.collect()) == sorted((i, library.encode_ordinary(TEXTS[i] or "")) for i in [*range(len(TEXTS)), 3])
    assert {r["id"]: bytes(r["bytes"]) for r in bpe.decode(coded).collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert bpe.digests(rows.limit(0)).count() == 0


def test_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.range(1).select("id", F.array(F.lit(60_000)).alias("ids"))).collect()


def test_known_words_and_runs_do_not_change_results(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = ["alpha beta gammarays", "", "beta gammarays deltoid", "alpha deltoid"] * 3
    for piece in (1, 10, 25, 1000):
        monkeypatch.setattr(bpe, "PIECE", piece)
        out = [[] for _ in texts]
        for i, found in bpe.coded(texts, pattern, codec):
            out[i] += found.tolist()
        assert out == [library.encode_ordinary(t) for t in texts]
