import os
import random

import pytest

from tracksmith.llm.tokens import TOKENIZERS, boundaries, cut_into_pieces, decode_corpus, encode_corpus, encoder, is_sure

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


def texts():
    rng = random.Random(4)
    words = ["don't", "WE'LL", "naïve", "日本語", "x1", "42", "  ", "\n\n", "\t", "...", "<|endoftext|>", "é", "🙂", " \r\n ", "they've", "_a_b"]
    mixed = lambda n: "".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(n))
    return [None, "", " ", "\n", "hello world", mixed(5), mixed(400), mixed(3000), "a" * 900, " " * 700, "ab " * 500, "a" * 350 + " b c d " * 60 + "e" * 400, "\n" * 333 + "x"]


@pytest.mark.parametrize("chunk,overlap", [(32_768, 2048), (100, 40), (64, 30)])
def test_ids_and_round_trip(spark, chunk, overlap):
    all_texts = texts()
    df = spark.createDataFrame([(i, t, [1], "x") for i, t in enumerate(all_texts)], "doc long, body string, ids array<int>, id string")
    ids = encode_corpus(df, "doc", "body", chunk=chunk, overlap=overlap)
    plain = encoder(TOKENIZERS, "byte_bpe_50k")
    got = {r["doc"]: r["ids"] for r in ids.collect()}
    assert got == {i: plain.encode_ordinary(t) if t else [] for i, t in enumerate(all_texts)}
    assert {r["doc"]: r["text"] for r in decode_corpus(ids, "doc", "ids").collect()} == {i: t or "" for i, t in enumerate(all_texts)}


def test_same_ids_as_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    plain = encoder(TOKENIZERS, "byte_bpe_50k")
    for t in texts():
        if t:
            assert other.encode(t, add_special_tokens=False).ids == plain.encode_ordinary(t)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc long, body string")
    assert encode_corpus(df, "doc", "body").collect() == []


def test_rows_without_id_and_very_long_text(spark):
    long = ("the quick brown fox, 42 times\n" * 40_000) + "日本語" * 5_000
    df = spark.createDataFrame([(1, long), (None, "x"), (2, "y")], "doc long, body string")
    got = {r["doc"]: r["ids"] for r in encode_corpus(df, "doc", "body").collect()}
    assert got == {1: encoder(TOKENIZERS, "byte_bpe_50k").encode_ordinary(long), 2: encoder(TOKENIZERS, "byte_bpe_50k").encode_ordinary("y")}


def test_a_long_word_at_one_edge_leaves_the_other_pieces_alone(spark):
    plain = encoder(TOKENIZERS, "byte_bpe_50k")
    words = "some words, 12 of them\n" * 20_000
    text = words[:30_000] + "x" * 5_000 + words[30_000:]
    df = spark.createDataFrame([(1, text)], "id long, t string")
    pieces = sorted((r["piece"], r["t"]) for r in cut_into_pieces(df, 32_768, 2_048).collect())
    assert "".join(t for _, t in pieces) == text
    assert len(pieces) == -(-len(text) // 32_768) - 1 and max(len(t) for _, t in pieces) < 3 * 32_768
    assert [i for _, t in pieces for i in plain.encode_ordinary(t)] == plain.encode_ordinary(text)


def test_sure_boundaries_are_boundaries_of_every_reading():
    rng = random.Random(6)
    signs = ["a", "é", "s", "'", "'s", "ll", "1", "²", " ", "  ", "\n", "!", "...", "\u0301", "日", "🙂", "\x1c", "\xa0", "_"]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(60))
        sure = [b for b in range(1, len(text)) if is_sure(text, b)]
        for start in range(0, 30):
            seen = {start + b for b in boundaries(text[start:])}
            assert {b for b in sure if b > start} <= seen
