"""BPE by rank arrays against the tokenizers library."""

import random

import public_tokenizers
import pytest

from factorlake.llm import bpe, pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = pieces.tokenizer(PATH)
START, END = "<|startoftext|>", "<|endoftext|>"
PARTS = [END, START, START.upper(), "<|", "|>", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\x85", "　", "​", "\x1c", "a", "Word", "'s", "'LL", "don't", "É", "ß", "日本", "ж", "12", "²", ".", ",", "...", "!", "(", "Σ", "ς", "İ", "ﬁ", "Ġ", "́", "é", "😀", "٣", "﻿", "endoftext", "ͅ", "ᾳ", "\x00", "\x7f", "~", "ǆ", "ა", "Ა", " ", "×", "÷", "ÿ", "Ÿ", "º"]


def ids(text):
    raw = bpe.codec(PATH).encode(text)
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def same(texts):
    for t, e in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(t) == e.ids, repr(t)
        assert bpe.codec(PATH).decode(e.ids) == LIBRARY.decode(e.ids, skip_special_tokens=False)


def test_awkward_parts():
    rng = random.Random(1)
    same(["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 15))) for _ in range(20_000)])


def test_any_characters():
    rng = random.Random(2)
    ranges = [(0x20, 0x3000), (0xE000, 0x1FFFF), (0x20, 0x7F), (0xC0, 0x100)]
    same(["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(12)) for _ in range(20_000)])


def test_long_words_merge_alike_by_scans_and_by_heap():
    rng = random.Random(3)
    merges = bpe.codec(PATH).merges
    words = ["".join(rng.choice("abcdeth") for _ in range(rng.randint(1, 300))) for _ in range(300)] + ["a" * 300, "ab" * 150, "hello" * 40]
    for w in words:
        assert merges.scanned(merges.symbols(w)) == merges.heaped(merges.symbols(w)) == ids(w)
    same([*words, "a" * 20_000, "".join(rng.choice("abcdeth") for _ in range(20_000))])


def test_words_are_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    rng = random.Random(4)
    same([" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(100)) for _ in range(50)])


def test_rows(spark):
    rows = [(1, f"Hello  {END}World's {START}", "x"), (None, "no id", None), (3, None, "y"), (4, "", ""), (5, " \n\xa0", ""), (1, f"Hello  {END}World's {START}", "x"), (6, "long words " * 30_000 + "x" * 50_000, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # a column named as the result's
    encoded = bpe.encode(docs, PATH)
    want = sorted(((i, LIBRARY.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == want
    decoded = bpe.decode(encoded, PATH).collect()
    assert sorted(((r.doc_id, r.decoded) for r in decoded), key=str) == sorted(((i, LIBRARY.decode(w, skip_special_tokens=False)) for i, w in want), key=str)
    assert bpe.decode(bpe.encode(docs.where("false"), PATH), PATH).count() == 0
    odd = spark.createDataFrame([(1, [320, None, -1, 10**9, 49407]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(odd, PATH).collect()} == {1: LIBRARY.decode([320, 49407], skip_special_tokens=False), 2: "", 3: ""}


def test_other_files_are_refused(spark):
    with pytest.raises(ValueError, match="no BPE of the kind"):
        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
