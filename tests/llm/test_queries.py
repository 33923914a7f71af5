"""Every query's contract columns against brute force, on a folder of awkward tables."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_operators import BASE, ITEMS, LINE, RNG, TOKENIZER, brute_components, brute_lines, brute_score, brute_spans, brute_topk, edited, lower, sentence, shingles
from test_prefix_trie import as_rows, awkward, brute_order, brute_trie
from test_runs import brute_collapsed, brute_runs

from factorlake.llm import pieces, queries, runs, secret_scan

END = "<|endoftext|>"


def documents():
    out = [(1, BASE), (2, edited(BASE, 5)), (3, BASE.upper()), (4, None), (5, ""), (6, f"a\n\n{END}b  {END}\n\n"), (7, "café 日本 secret:" + "x" * 15 + " 0123456789abcdef01 AKIA" + "Q" * 18)]
    out += [(10 + k, f"{sentence(20)}\n\t{LINE if k % 2 else LINE.upper()}\n\n{sentence(3)}") for k in range(7)]
    out += [(30, f"{sentence(10)} {ITEMS[0][1]} {sentence(9)}"), (31, "token = 'ghp_" + "a1" * 20 + "'\npassword: hunter2"), (32, "\xa0\xa0 \x1c x\x85\n"), (33, sentence(3000))]
    out += [(100 + k, sentence(30)) for k in range(60)] + [(200 + k, " ".join(w + "###" for w in sentence(30).split())) for k in range(60)]
    return [(i, t, "en", "s", len(t or "")) for i, t in out]


DOCS = documents()
#: Ids without a first conversation of their five, and short ones, that lose all their turns, among them.
CONVERSATIONS = [r for r in awkward(4) if r[0] is None or r[0] >= 0 and r[0] % 10 not in (5,)] + [(305 + k, 0, "user", "alone") for k in range(1, 5)]
BY_ID = {i: t or "" for i, t, *_ in DOCS}
VECTORS = [(i, [float(x) for x in RNG.normal(size=8)]) for i in range(70)] + [(80, None), (81, [1.0, None]), (20, [0.5] * 8), (5, [2.0**26] + [0.0] * 7)]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in BY_ID if i >= 100], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(CONVERSATIONS, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return lambda name: queries.queries()[name](spark, at).collect()


def by_id(rows):
    assert len(rows) == len(DOCS)
    return {r.doc_id: r for r in rows}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ids_of(text):
    return pieces.tokenizer(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_topk(run):
    assert collections.Counter((r.query_id, r.rank, r.vec_id, r.score) for r in run("op1_topk_search")) == brute_topk(VECTORS)


def test_ngram_join(run):
    want = brute_components([(i, t) for i, t, *_ in DOCS])
    assert {i: (r.n_shingles, r.component_id) for i, r in by_id(run("op2_ngram_join")).items()} == {i: (len(shingles(t)), want[i]) for i, t in BY_ID.items()}


def test_secrets(run):
    kinds = [r["kind"] for r in secret_scan.RULES]
    for i, r in by_id(run("op3_secret_scan")).items():
        spans = brute_spans(BY_ID[i])
        text = lambda some: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in some)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert r.base_sha256 == sha(text([x for x in spans if x[1] < 3])) and r.spans == text(spans)


def test_counts(run):
    for i, r in by_id(run("op4_token_counts")).items():
        n = len(ids_of(BY_ID[i]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(BY_ID[i].encode()), n, n > 512)


def test_shards(run):
    rows = by_id(run("op5_sharding"))
    shards = collections.defaultdict(list)
    for i, r in rows.items():
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(BY_ID[i].encode()) + 8, zlib.crc32(BY_ID[i].encode()), "rows", None)
        shards[r.shard].append(r.slot)
    assert set(shards) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_packing(run):
    batches = collections.defaultdict(list)
    for i, r in by_id(run("op6_packing")).items():
        assert r.length == len(lower(BY_ID[i]).encode().split()) <= r.padded_length
        batches[r.bucket, r.batch].append(r)
    for group in batches.values():
        assert sorted(r.slot for r in group) == list(range(len(group))) and sum(r.padded_length for r in group) <= 65_536


def test_lines(run):
    (want,) = [{i: t for (i, t), _ in brute_lines([(i, t) for i, t, *_ in DOCS]).items()}]
    for i, r in by_id(run("op7_line_dedup")).items():
        assert (r.n_lines, r.kept_sha256) == (BY_ID[i].count("\n") + 1, sha(want[i]))
        assert r.n_dropped == (0 if want[i] == BY_ID[i] else BY_ID[i].count("\n") - want[i].count("\n"))
    assert sum(want[i] != BY_ID[i] for i in want) == 6


def test_leaks(run):
    short = [(i, t) for i, t in BY_ID.items() if len(t) < 10_000]
    want = {(i, k): s for i, t in short for k, x in ITEMS if (s := brute_score(x, t)) >= 0.4}
    assert {(r.doc_id, r.item_id): r.score for r in run("op8_decontaminate")} == pytest.approx(want) and (30, 0) in want


def test_records(run):
    at = 0
    for i, r in sorted(by_id(run("op9_binary_records")).items()):
        ids = [*ids_of(BY_ID[i]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_quality(run):
    right = []
    for i, r in by_id(run("op10_quality")).items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if i >= 100 and r.held_out:
            right.append(r.predicted == int(i < 200))
    assert np.mean(right) > 0.95


def planted(i, text):
    """The words that the query finds runs in."""
    words = runs.WORDS.findall(text)
    h, n = zlib.crc32(str(i).encode()), len(words)
    if h % 10 or not n:
        return words
    a = (h // 10) % n
    p = 1 + (n - a) // (3 + (h // 10) % 8)
    return words[:a] + [words[a + (k - a) % p] for k in range(a, n)]


def test_runs(run):
    some = 0
    for i, r in by_id(run("op11_periodic_runs")).items():
        words = planted(i, BY_ID[i])
        found = brute_runs(words)
        s, n, q = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), s, n, q, found and 1000 * n // q or None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found)) and r.collapsed_sha256 == sha(brute_collapsed(words, found))
        some += bool(found)
    assert some > 3


def test_trie(run):
    given, convs = brute_order(CONVERSATIONS), {}
    for c, turns in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = turns if c % 5 == 0 else given.get(c - c % 5, [])[:h] + turns[h:]
    assert any(not t for t in convs.values())
    assert as_rows(run("op12_prefix_trie")) == brute_trie(convs)


def test_bpe(run):
    library = pieces.tokenizer(public_tokenizers.path(queries.WORD_TOKENIZER))
    for i, r in by_id(run("op13_bpe")).items():
        ids = library.encode(BY_ID[i], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


FUZZ = [END, "<|", "|>", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\x85", " ", "　", "​", "\x1c", "a", "word", "'s", "'ll", "don't", "é", "ß", "日本", "ж", "12", "²", ".", ",", "...", "!", "(", "#$%", "&", "|", "Ġ", "́", "😀", "٣", "﻿", "endoftext"]


def test_fuzzed_texts_give_the_library_s_tokens(spark, tmp_path):
    """Runs of white space before and after added tokens among them, through the queries."""
    rng = np.random.default_rng(11)
    texts = []
    while len(texts) < 100_000:
        some = rng.choice(len(FUZZ), rng.integers(3, len(FUZZ)), replace=False)
        texts += ["".join(FUZZ[k] for k in rng.choice(some, rng.integers(1, 25))) for _ in range(500)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    want = [e.ids for e in pieces.tokenizer(TOKENIZER).encode_batch_fast(texts, add_special_tokens=False)]
    counted = {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, str(tmp_path)).collect()}
    assert counted == {i: len(w) for i, w in enumerate(want)}
    crcs = {r.doc_id: r.ids_crc32 for r in queries.op9_binary_records(spark, str(tmp_path)).collect()}
    assert crcs == {i: zlib.crc32(np.array([*w, 2], "<u4").tobytes()) for i, w in enumerate(want)}
