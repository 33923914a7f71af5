"""The trie of conversations against brute force."""

import collections
import hashlib
import random

import pytest

from factorlake.llm import prefix_trie


def brute_order(rows):
    """conv_id -> its turns as (role, text)."""
    convs = collections.defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            convs[c].append((n is not None, n or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}


def brute_trie(convs):
    """Rows of the result from conv_id -> turns."""
    members = collections.defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, out = collections.Counter(n[:-1] for n in members if n), set()
    leaves, saved = collections.Counter(), collections.Counter()
    for n, own in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(own) - 1) * (len(n[-1][1].encode()) if n else 0)
    for n, own in members.items():
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(n))
        out.add((own[0], len(n), members[n[:-1]][0] if n else None, len(own), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def as_rows(found):
    rows = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found]
    assert len(rows) == len(set(rows))
    return set(rows)


def awkward(seed=3):
    """Prefixes shared at every depth, exact copies, ties, repeated rows, nulls, and one long conversation with a twin."""
    rng, rows = random.Random(seed), []
    pool = [[(rng.choice(["user", "assistant", None]), rng.choice(["hé", "ho", "", None, "日本"])) for _ in range(12)] for _ in range(4)]
    for c in range(-20, 120):
        base = rng.choice(pool)
        turns = base[: rng.randint(0, 12)] + [("user", f"own {rng.randint(0, 3)}")] * rng.randint(0, 3)
        rows += [(c, k * 3 if c % 7 else None if k == 0 else k // 2, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "nobody's"), (7, 0, "user", "twice"), (7, 0, "user", "twice")]
    rows += [(c, k, "user", f"line {k}") for c in (500, 501) for k in range(90 - 20 * (c % 2))]
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string"


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    if small:  # conversations in many parts, ids in many ranges
        monkeypatch.setattr(prefix_trie, "PART_ROWS", 8)
        monkeypatch.setattr(prefix_trie, "ENDS", 16)
    rows = awkward()
    turns = prefix_trie.ordered(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    convs = brute_order(rows)
    assert as_rows(prefix_trie.trie(turns).collect()) == brute_trie(convs)
    # conversations without turns end at the root
    known = spark.createDataFrame([(c,) for c in [*convs, 1000, 1001]], "conv_id bigint")
    assert as_rows(prefix_trie.trie(turns, known).collect()) == brute_trie({**convs, 1000: [], 1001: []})


def test_no_turns_and_no_conversations(spark):
    none = prefix_trie.ordered(spark.createDataFrame([], SCHEMA))
    assert prefix_trie.trie(none).count() == 0
    known = spark.createDataFrame([(4,), (3,)], "conv_id bigint")
    assert as_rows(prefix_trie.trie(none, known).collect()) == brute_trie({3: [], 4: []})
