"""Byte-level BPE against tiktoken, round trips, token counts against a plain dynamic program."""

import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenledger.llm import byte_bpe, token_counts
from tokenledger.llm.byte_bpe import Pieces, StreamDecoder, Transducer, decode_ids, encode_texts, read_ranks
from tokenledger.llm.token_counts import MARK, UnigramCounter, count_tokens, read_pieces

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = read_ranks(PATH)
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [None, "", " ", "a", "Hello  world\n\n x", "<|endoftext|>", "naïve 漢字 🎉🎉 é́", "a" * 30_000, "0123456789" * 50, "don't we'll", "\x00\x07", "x" + " " * 500 + "y"]


@pytest.fixture(scope="module")
def transducer():
    return Transducer(RANKS)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="abcdeft hin", max_size=60), st.binary(max_size=20).map(lambda b: b.decode("latin-1"))))
def test_pieces(transducer, text):
    import regex

    for piece in regex.findall(public_tokenizers.PATTERN, text):
        ids = transducer.encode(piece.encode())
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == ENCODING.encode_ordinary(piece)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_STATES", 5)
    monkeypatch.setattr(byte_bpe, "MOST_PAIRS", 3)
    monkeypatch.setattr(byte_bpe, "MOST_PIECES", 2)
    pieces = Pieces(Transducer(RANKS))
    for p in [" hello", " transducers", " hello", "ation", " unbelievable", " hello", "zzzzzzzz"]:
        ids = pieces[p]
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == ENCODING.encode_ordinary(p)


def test_texts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id int, text string, n_tokens string")
    rows = decode_ids(encode_texts(df, PATH, public_tokenizers.PATTERN), PATH).orderBy("doc_id").collect()
    for r, t in zip(rows, TEXTS):
        ids = ENCODING.encode_ordinary(t or "")
        assert r["n_tokens"] == len(ids)
        assert bytes(r["token_ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert r["decoded"] == (t or "")
    assert encode_texts(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_digests(spark):
    df = encode_texts(spark.createDataFrame([("né",)], "text string"), PATH, public_tokenizers.PATTERN)
    ids = ENCODING.encode_ordinary("né")
    assert df.select(F.sha2("token_ids", 256)).first()[0] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_streams_hold_back_incomplete_characters():
    tokens = {i: bytes([i]) for i in range(256)}
    d = StreamDecoder(tokens)
    assert [d.feed([b]) for b in "aé🎉".encode()] == ["a", "", "é", "", "", "", "🎉"]
    assert d.finish() == ""
    d = StreamDecoder(tokens)
    assert d.feed([0xC3]) + d.feed([0x41]) + d.feed([0xE2]) + d.finish() == "�A�"


PIECES = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def plain_count(word, pieces, byte_score):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = None
        for start in range(end - 1, -1, -1):
            s = pieces.get(word[start:end])
            if s is not None and (found is None or best[start][0] + s >= found[0]):
                found = best[start][0] + s, best[start][1] + 1
        if word[end - 1] not in pieces:
            n = len(word[end - 1].encode())
            spelled = best[end - 1][0] + n * byte_score, best[end - 1][1] + n
            if found is None or spelled[0] > found[0]:
                found = spelled
        best.append(found)
    return best[-1][1]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text(alphabet="thein▁ghé漢🎉", max_size=12), max_size=20))
def test_counts_share_prefixes(words):
    counter = UnigramCounter(PIECES)
    assert counter.counts(words) == {w: plain_count(w, PIECES, counter.byte_score) for w in words}


def long_count(word, counter):
    """plain_count() for long words: pieces are at most so many characters."""
    longest = max(map(len, PIECES))
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = None
        for start in range(end - 1, max(-1, end - longest - 1), -1):
            s = PIECES.get(word[start:end])
            if s is not None and (found is None or best[start][0] + s >= found[0]):
                found = best[start][0] + s, best[start][1] + 1
        if word[end - 1] not in PIECES:
            n = len(word[end - 1].encode())
            spelled = best[end - 1][0] + n * counter.byte_score, best[end - 1][1] + n
            if found is None or spelled[0] > found[0]:
                found = spelled
        best.append(found)
    return best[-1][1]


@pytest.mark.parametrize("most", [24_000_000, 100])
def test_token_counts(spark, monkeypatch, most):
    """Whole texts, long ones and long words included, repeated rows and helper names; small caches change nothing."""
    monkeypatch.setattr(token_counts, "MOST_KEPT", most)
    texts = [*TEXTS, "the cat " * 20_000, TEXTS[4]]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, n_tokens string").withColumn("both", F.lit(7))
    rows = count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    counter = UnigramCounter(PIECES)
    cost = {w: long_count(MARK + w, counter) for t in texts for w in (t or "").split()}
    assert [r["n_tokens"] for r in rows] == [sum(cost[w] for w in (t or "").split()) for t in texts]
    assert all(r["both"] == 7 for r in rows)
    assert count_tokens(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_one_pass_encodes_and_decodes(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*TEXTS, "ab é " * 50_000])], "doc_id int, text string, decoded string").withColumn("both", F.lit(7))
    out = encode_texts(df, PATH, public_tokenizers.PATTERN, decode=True)
    assert out._jdf.queryExecution().executedPlan().toString().count("InArrow") == 1
    assert encode_texts(df, PATH, public_tokenizers.PATTERN, keep_text=False).columns == ["doc_id", "decoded", "both", "n_tokens", "token_ids"]
    assert out.columns == ["doc_id", "text", "both", "n_tokens", "token_ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") and r["both"] == 7 and r["n_tokens"] * 4 == len(r["token_ids"]) for r in out.collect())
