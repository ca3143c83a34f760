"""The shingle set join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import set_join
from keyloom.llm.set_join import Rule

SCHEMA = "doc_id long, text string, component_id string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_set(text, words):
    found = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]
    if not found:
        return frozenset()
    return frozenset(" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def slow_join(rows, rule):
    sets = [slow_set(t, rule.words) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and rule.of * same >= rule.part * (len(sets[i]) + len(sets[j]) - same):
                parent[find(i)] = find(j)
    least = {}
    for i, (row, *_) in enumerate(rows):
        if row is not None:
            least[find(i)] = min(row, least.get(find(i), row))
    return sorted((str(row), len(s), str(least.get(find(i)) if s else row)) for i, ((row, *_), s) in enumerate(zip(rows, sets, strict=True)))


def got(spark_rows):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in spark_rows.collect())


def texts(seed, n=90):
    """Groups of near copies around the threshold, chains of them, shared passages, copies in other spellings, odd rows."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(40)] for _ in range(3)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.choice((3, 5, 12, 40, 90)))] + rng.choice([[], rng.choice(passages)])
        for _ in range(rng.choice((1, 1, 2, 6, 14))):
            out.append(" ".join(base))
            for _ in range(rng.randrange(3)):  # the next copy differs from this one
                base = list(base)
                base[rng.randrange(len(base))] = word()
    rows = [(i, t) for i, t in enumerate(out)]
    rng.shuffle(rows)
    first = rows[0][1]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, first.upper()), (1004, first.replace(" ", "\n\t")), (1005, "one"), (1006, "ONE"), (1007, "one two")]
    rows += [(None, first), (None, "alone in the world today"), (1005, "one"), (1008, "ünï   x y z"), (1009, "ÜNÏ   x y z")]
    return [(i, t, "x", "y") for i, t in rows]


@pytest.mark.parametrize("seed, rule", [(1, Rule(4, 85)), (2, Rule(5, 80))])
def test_join_equals_all_pairs(spark, frame, seed, rule):
    rows = texts(seed)
    assert got(set_join.near_duplicates(frame(rows, SCHEMA), rule=rule)) == slow_join(rows, rule)


@pytest.mark.parametrize("tokens, group", [(1, 3), (3, 3), (2, 6)])
def test_frequent_tokens_and_blocks_lose_nothing(spark, frame, monkeypatch, tokens, group):
    for name, value in (("MOST_TOKENS", tokens), ("GROUP", group), ("LARGE", 2), ("PIVOT_ROWS", 2), ("STAR", 2), ("LOCAL", 1), ("TOTAL", 2), ("PAIRS", 5)):
        monkeypatch.setattr(set_join, name, value)
    # pivots that are linked with nothing leave all pairs to the tokens and their combinations
    monkeypatch.setattr(set_join, "pivot_pairs", lambda met, rule, salted: met.select(F.col("sid").alias("a"), F.col("pivot").alias("b")).where("false"))
    rule = Rule(4, 85)
    rows = texts(7, 70)
    assert got(set_join.near_duplicates(frame(rows, SCHEMA), rule=rule)) == slow_join(rows, rule)


def test_salted_pivots_lose_nothing(spark, frame, monkeypatch):
    for name, value in (("PIVOT_ROWS", 2), ("STAR", 2), ("LOCAL", 1), ("TOTAL", 2)):
        monkeypatch.setattr(set_join, name, value)
    rows = texts(9, 60)
    assert got(set_join.near_duplicates(frame(rows, SCHEMA))) == slow_join(rows, Rule(4, 85))


def test_near_copies_are_not_compared_all_with_all(spark, frame, monkeypatch):
    # without pivots: before, all 1770 pairs of the copies were verified
    monkeypatch.setattr(set_join, "pivot_pairs", lambda met, rule, salted: met.select(F.col("sid").alias("a"), F.col("pivot").alias("b")).where("false"))
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        mine = list(base)
        for _ in range(rng.randrange(1, 4)):
            mine[rng.randrange(len(mine))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(mine), "x", "y"))
    asked, verified = [], set_join.verified
    monkeypatch.setattr(set_join, "verified", lambda pairs, *rest: asked.append(pairs.distinct().count()) or verified(pairs, *rest))
    assert got(set_join.near_duplicates(frame(rows, SCHEMA))) == slow_join(rows, Rule(4, 85))
    assert 0 < sum(asked) < 60 * 59 // 4


@pytest.mark.parametrize("closest", [1, 2])
def test_candidates_left_out_at_first_are_found_later(spark, frame, monkeypatch, closest):
    for name, value in (("CLOSEST", closest), ("MORE", 2), ("LARGE", 1), ("GROUP", 6), ("PAIRS", 5)):
        monkeypatch.setattr(set_join, name, value)
    monkeypatch.setattr(set_join, "pivot_pairs", lambda met, rule, salted: met.select(F.col("sid").alias("a"), F.col("pivot").alias("b")).where("false"))
    rows = texts(11, 70)
    assert got(set_join.near_duplicates(frame(rows, SCHEMA))) == slow_join(rows, Rule(4, 85))


def test_no_rows_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(set_join.near_duplicates(empty)) == []
    silent = spark.createDataFrame([(2, None), (1, " ")], "doc_id long, text string")
    assert got(set_join.near_duplicates(silent)) == [("1", 0, "1"), ("2", 0, "2")]


def test_very_long_texts(spark, frame, monkeypatch):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(120_000))
    rows = [(1, long), (2, long + " and more"), (3, long[: len(long) // 2]), (4, "a" * 600_000), (5, "b " * 300_000)]
    assert got(set_join.near_duplicates(frame(rows, "doc_id long, text string"))) == slow_join(rows, Rule(4, 85))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \n\té", max_size=40), max_size=6), st.integers(1, 5))
def test_shingles_do_not_depend_on_pieces(found, words):
    whole = [x.tolist() for x in set_join.shingles(found, words)]
    held = set_join.CHUNK
    try:
        set_join.CHUNK = 5
        assert [x.tolist() for x in set_join.shingles(found, words)] == whole
    finally:
        set_join.CHUNK = held
    for text, hashes in zip(found, whole, strict=True):
        assert len(set(hashes)) == len(slow_set(text, words))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**63)), st.sets(st.integers(0, 2**63)))
def test_parities_never_exceed_the_difference(one, other):
    x, y = (set_join.parities(np.array(sorted(s), np.uint64)) for s in (one, other))
    size = min(len(x), len(y))
    assert (set_join.folded(x, size) ^ set_join.folded(y, size)).bit_count() <= len(one ^ other)


def test_prefixes_hold_the_first_shared_tokens():
    rng = random.Random(5)
    rule = Rule(4, 85)
    for _ in range(500):
        base = rng.sample(range(1000), rng.randrange(3, 60))
        other = [x for x in base if rng.random() > 0.06] or base
        if rule.of * len(other) < rule.part * len(base):
            continue
        shared = sorted(set(base) & set(other))
        for k in (1, 2, 3):
            for tokens in (sorted(base), sorted(other)):
                assert set(shared[:k]) <= set(tokens[: rule.prefix(len(tokens), k)])
