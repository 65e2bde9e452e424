"""Components against brute force over all pairs, and hot groups."""

from __future__ import annotations

import random
import re

import pytest

from cutline.llm import near_dedup as near

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for k in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w).upper() if k == 2 else "  ".join(w))
    chain = [rng.choice(vocab) for _ in range(60)]
    for k in range(12):  # neighbours are alike, ends are not
        rows.append(" ".join(chain[k : k + 50]))
    rows += ["a b c", "A  b\tC", "a b d", "é É", "", "   ", "x " * 50]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[o]) for i, o in enumerate(order)]


@pytest.mark.parametrize("width", [4, 5])
def test_equals_brute_force(spark, width):
    rows = corpus(width)
    got = near.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), near.NearConfig(width=width)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_block_path_finds_what_centres_miss(spark):
    """Only one wide bucket and small blocks: links come from block comparison."""
    rows = corpus(9)
    cfg = near.NearConfig(width=4, bands=40, rows=2, block_shingles=200)
    got = near.near_components(spark.createDataFrame(rows, "doc_id long, text string"), cfg).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4)


def test_edges(spark):
    rows = [(7, "one two three four five", "x"), (3, "One two THREE four five", "y"), (3, "One two THREE four five", "y"), (9, None, "z"), (None, "one two three four five", "n"), (None, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_components(df, near.NearConfig(width=4)).collect()), key=str)
    assert got == sorted([(False, 7, 2, 3, False), (False, 3, 2, 3, True), (False, 3, 2, 3, True), (False, 9, 0, 9, True), (True, 0, 2, 3, False), (True, 0, 0, None, True)], key=str)
    kept = near.near_dedup(df, near.NearConfig(width=4))
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [3, 9]
    assert near.near_components(df.limit(0)).count() == 0
    assert near.near_dedup(df.limit(0)).count() == 0


def test_thresholds_fall_with_the_miss_probability():
    loose, tight = near.least_matches(near.NearConfig(miss=1e-2)), near.least_matches(near.NearConfig(miss=1e-6))
    assert all(a[1] >= b[1] for a, b in zip(loose, tight, strict=True))
    assert all(m <= 0.8 * n for n, m in loose)


def test_null_and_repeated_ids_keep_their_own_texts(spark):
    """One row of each component, never one of each id."""
    base = [f"w{k}" for k in range(60)]
    text = lambda k: " ".join(f"{k}{w}" for w in base)
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c") + " end"), (5, text("d")), (5, text("e")), (7, text("e") + " end"), (3, text("f")), (9, text("f") + " end"), (9, text("g")), (9, text("g")), (None, text("h") + " end"), (4, text("h")), (None, ""), (None, None), (None, None), (8, ""), (8, "")]
    kept = [(r["doc_id"], r["text"]) for r in near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    nulls = [t for d, t in kept if d is None]
    assert sorted((d, t) for d, t in kept if d is not None) == sorted([(5, text("d")), (5, text("e")), (3, text("f")), (9, text("g")), (4, text("h")), (8, "")])
    assert sum((t or "").startswith("c") for t in nulls) == 1
    assert sorted(str(t) for t in nulls if not (t or "").startswith("c")) == sorted([text("a"), text("b"), "", "None", "None"])
