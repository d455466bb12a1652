from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from parley.llm import prefix_trie

from .conftest import syllables

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """The trie of rows (conv_id, turn, role, text), node by node."""
    def words(text):
        return len([w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w])

    def order(t):
        role, text = t[2] or "", t[3] or ""
        return (t[1] is not None, t[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())

    convs = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        path = convs.get(head, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, d == len(path)))
    out = []
    for node, own in members.items():
        under = [(m, o) for m, o in members.items() if m[: len(node)] == node]
        parents = {m[:-1] for m in members if m}
        up = min(c for c, _ in members[node[:-1]]) if node else None
        saved = sum((len(o) - 1) * words(m[-1][1]) for m, o in under if m)
        ends = ",".join(str(c) for c, ended in sorted(own) if ended)
        children = sum(1 for m in members if m and m[:-1] == node)
        out.append((min(own)[0], len(node), up, len(own), children, sum(m not in parents for m, _ in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def make(spark, tmp_path):
    def write(rows, clash=False):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *(F.lit("clash").alias(c) for c in ("k", "words", "part", "spot", "x", "path", "n", "at", "edge")))
        df.write.parquet(str(tmp_path / f"t{clash}"))
        return spark.read.parquet(str(tmp_path / f"t{clash}"))

    return write


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def random_rows(seed, convs, longest, texts):
    rng = random.Random(seed)
    return [(c, t, rng.choice("ua"), rng.choice(texts)) for c in rng.sample(range(-30, 4 * convs), convs) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("block", [2, 3, 64])
def test_trie_is_what_brute_force_says_whatever_the_blocks_and_ranges(spark, make, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "CHUNK", 5)
    rows = random_rows(block, 60, 7, ["a", "b c", "d  e\tf"])
    rows += [(c, t, "u", f"same {t}") for c in range(300, 330) for t in range(9)]  # a group of copies
    rows += [(400, t, "u", f"long {t}") for t in range(140)] + [(401, t, "u", f"long {t}") for t in range(120)]  # ends on the way
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(prefix_trie.nodes(make(rows))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nulls_empty_and_long_texts_ties_and_repeated_rows(make):
    rng = random.Random(5)
    rows = [
        (None, 0, "user", "lost"),
        (1, None, "user", "first of all"),
        (1, 0, None, None),
        (1, 0, None, None),
        (1, 0, "user", ""),
        (2, 5, "user", syllables(rng, 3000)),
        (2, 5, "assistant", "tie"),
        (3, 1, "a", "b"),
        (3, 2, "", "ab"),
        (21, 1, "a", "b"),  # its head is absent, so it is turnless or short
        (22, 0, "user", "only"),
    ]
    got = found(prefix_trie.nodes(make(rows)))
    assert got == brute(rows)
    assert found(prefix_trie.nodes(make(rows, clash=True))) == got


def test_no_conversation_has_no_node(make):
    df = prefix_trie.nodes(make([(None, 1, "user", "x")]))
    assert df.columns == list(COLUMNS) and not df.collect()
