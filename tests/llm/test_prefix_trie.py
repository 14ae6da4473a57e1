"""Conversation trie against a dictionary of prefixes."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ringweave.llm import prefix_trie
from tests.llm.conftest import rows_of

TURNS = "conv_id long, turn long, role string, text string, depth string, k1 string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]  # SQL remainders have the sign of c
        for d in range(len(built) + 1):
            members[tuple(built[:d])].add(c)
        ends[tuple(built)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], sha(p)) for p, m in members.items()
    )


def conversations(seed, n=400):
    """Few different turns, so that prefixes are shared at every depth; a long copied one and a long one of its own."""
    r = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue
        rows += [(c, t, "user" if t % 2 else "bot", "ab" * int(r.integers(3)), "x", "y") for t in range(r.integers(1, 9))]
    for c in (3 * n, 3 * n + 1, 3 * n + 7):
        rows += [(c, t, "user", f"long {t}", "x", "y") for t in range(300)]
    rows += [(4 * n, t, "bot", f"own {t}", "x", "y") for t in range(500)]
    rows += [(5 * n + i, 0, "user", "the same", "x", "y") for i in range(200)]
    return rows


@pytest.mark.parametrize("nodes", [200_000, 60, 1])
def test_trie_equals_brute_force(spark, monkeypatch, nodes):
    """One shard, some, and one a path: spines of all lengths merge."""
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", nodes)
    rows = conversations(1, 400 if nodes > 1 else 60)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert sorted(rows_of(prefix_trie.trie(df)), key=str) == sorted(brute(rows), key=str)


def test_odd_conversations(spark):
    rows = [
        (None, 1, "user", "nobody's"), (None, None, None, None), (7, None, None, None), (7, None, None, None), (7, 1, "", ""), (7, 1, "user", None),
        (-5, 2, "user", "b"), (-5, 2, "bot", "a"), (-5, 2, "bot", "a"), (0, 0, "x", "日本 😀"), (0, 1, "x" * 9, "long " * 50_000), (1, 0, "x", "日本 😀"), (1, 1, "x" * 9, "long " * 50_000),
        (5_000_000_000, 0, "", "a"), (5_000_000_000, 1, "a", ""), (5_000_000_001, 0, "a", ""), (5_000_000_001, 1, "", "a"), (103, 0, "u", "only"), (102, 0, "u", "only"), (101, 0, "u", "only"),
    ]
    rows = [(*r, "x", "y") for r in rows]
    df = spark.createDataFrame(rows, TURNS)
    assert sorted(rows_of(prefix_trie.trie(df)), key=str) == sorted(brute(rows), key=str)
    assert rows_of(prefix_trie.trie(df.limit(0))) == [] == rows_of(prefix_trie.trie(df.where("conv_id is null")))


def test_one_conversation(spark):
    rows = [(9, t, "u", str(t), "", "") for t in range(8)]
    assert sorted(rows_of(prefix_trie.trie(spark.createDataFrame(rows, TURNS))), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("block", [2, 7, 256])
def test_findclose(block):
    r = np.random.default_rng(block)
    for _ in range(30):
        bits, depth = [1], 1
        while depth:
            up = int(r.random() < 0.5) if len(bits) < 600 else 0
            bits.append(up)
            depth += 1 if up else -1
        bits = np.array(bits)
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.flatnonzero(bits)
        assert prefix_trie.Parentheses(bits, block).findclose(opens).tolist() == [want[i] for i in opens]
