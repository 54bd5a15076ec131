import bisect
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqlake.llm import packing

from .edge import ROWS, docs, empty

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Hello world's it's I'm   x\ty\r\nz", "naïve ΣΑΣ ΟΔΟΣ.", "été İstanbul ß ẞ", "a1b2 3.14 <|endoftext|> x", "hello <|endoftext|> x", "ab<|endoftext|>cd.<|startoftext|><|endoftext|", "<|ENDOFTEXT|>", "²³½ x²", " hi yo", "___a_b", "日本語 テスト", "A.B,c!!", "\x1cx\x85y", "", " ", "don't 'tis", "ª º µ ŉ ǅ ǰ", "é"]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.sampled_from(ODD), st.text(max_size=40), st.text("aBé.,!' \n1İ", max_size=40)))
def test_words_encode_as_whole_texts_do(whole, text):
    assert np.frombuffer(packing._encoder(VOCABULARY).encode(text), "<u4").tolist() == whole(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_bins_hold_their_pieces(sizes):
    bins, offsets = packing.pack_sizes(np.array(sizes, np.int64), 64)
    held = {}
    for b, o, s in sorted(zip(bins, offsets, sizes, strict=True)):
        assert o == held.get(b, 0)
        held[b] = o + s
    assert all(v <= 64 for v in held.values())


def test_rule_against_plain_search():
    rng = np.random.RandomState(4)
    sizes = rng.randint(1, 30, 300)
    gaps, used = {}, 0
    for size in -np.sort(-sizes):
        best = None
        fits = sorted(g for g in gaps if gaps[g] and g >= size)
        for gap in fits or [30]:
            after = dict(gaps)
            if fits:
                after[gap] = after.get(gap, 0) - 1
            if gap > size:
                after[gap - size] = after.get(gap - size, 0) + 1
            cost = sum(v * v for v in after.values())
            if best is None or cost < best[0]:
                best = cost, gap, after
        used += not fits
        gaps = best[2]
    assert packing.pack_sizes(sizes, 30)[0].max() + 1 == used


def check(rows, expected):
    """Pieces are whole, and sequences full without gaps."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(str(r["id"]), []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def cut(ids):
    ids = [*ids, 0]
    return [(k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]


@pytest.mark.parametrize("shard", [2000, 4])
def test_edge_rows(spark, monkeypatch, whole, shard):
    monkeypatch.setattr(packing, "SHARD_PIECES", shard)
    expected = {}
    for doc_id, text, *_ in ROWS:
        expected.setdefault(str(doc_id), []).extend(cut(whole(text or "")))
    check(packing.pack(packing.token_pieces(docs(spark), VOCABULARY)).collect(), expected)


def best_fit_decreasing(sizes):
    gaps, used = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, size)
        used += at == len(gaps)
        gap = gaps.pop(at) if at < len(gaps) else 2048
        bisect.insort(gaps, gap - size)
    return used


def test_the_vocabulary_itself_decides_on_special_tokens(whole):
    assert whole("hello <|endoftext|> x") == [3306, 49407, 343]
    assert np.frombuffer(packing._encoder(VOCABULARY).encode("hello <|endoftext|> x"), "<u4").tolist() == [3306, 49407, 343]


def test_long_text_is_split_into_parts(whole, monkeypatch):
    text = " ".join(f"word{i % 977} <|endoftext|>\nÉté." for i in range(3000))
    monkeypatch.setattr(packing, "PART_CHARS", 100)
    assert np.frombuffer(packing._encoder(VOCABULARY).encode(text), "<u4").tolist() == whole(text)


def test_equal_packing_in_any_order(spark):
    rows = [(i % 50, i // 50, 1 + (i * 37) % 2047) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, piece int, length long").coalesce(1)
    packed = [sorted(map(tuple, packing.pack(df).collect())) for df in (frame, frame.orderBy(F.rand(3)).coalesce(1))]
    assert packed[0] == packed[1]


def test_few_sequences(spark):
    pieces = packing.token_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), VOCABULARY, with_ids=True)
    rows = packing.pack(pieces).collect()
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= best_fit_decreasing([r["length"] for r in rows]) == -(-total // 2048)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)


def test_empty_table(spark):
    assert packing.pack(packing.token_pieces(empty(spark), VOCABULARY)).count() == 0
