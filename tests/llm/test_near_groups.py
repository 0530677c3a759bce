"""Near duplicates: repeated doc_ids, and what leaves a tile of a large group."""

import itertools
import random

import numpy as np
import pytest

from paperfold.llm import near_dedup


def reach(rows, size=2, percent=80):
    """doc_id -> smallest doc_id reachable, over the texts of all rows."""
    nodes = sorted({d for d, _ in rows})
    root = {d: d for d in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    for (a, s), (b, t) in itertools.combinations([(d, shingles(t)) for d, t in rows], 2):
        common = len(s & t)
        if common and 100 * common >= percent * (len(s) + len(t) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in nodes}


@pytest.mark.parametrize("first", [1, 5])
def test_repeated_doc_ids_lose_no_link(spark, first):
    one, two = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    rows = [(first, one), (first, two), (2, two + " tail"), (3, one + " end"), (7, "other words here"), (first, one), (8, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).collect()
    assert len(got) == len(rows)
    want = reach(rows)
    assert all(r.component_id == want[r.doc_id] for r in got)


def test_repeated_doc_ids_against_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    bases = [rng.choices(words, k=25) for _ in range(8)]
    rows = []
    for k in range(90):
        text = list(rng.choice(bases))
        text[rng.randrange(25)] = rng.choice(words)
        rows.append((rng.randrange(50), " ".join(text)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).collect()
    want = reach(rows)
    assert {r.doc_id: r.component_id for r in got} == want


def members(texts):
    looks = near_dedup.least_matches(ends=near_dedup.LONG_LOOKS)
    sets = [near_dedup.shingle_hashes(near_dedup.word_hashes(t), 2) for t in texts]
    functions = near_dedup.hash_functions(near_dedup.LONG)
    sigs = [near_dedup.signature(s, *functions).astype(np.uint8).tobytes() for s in sets]
    return looks, [(0, k, k, -1, sigs[k], sets[k].tobytes(), [77] * near_dedup.BANDS) for k in range(len(texts))]


def test_a_tile_gives_fewer_links_than_members():
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(250):  # pairs lie on both sides of the threshold
        text = list(base)
        for at in rng.sample(range(100), rng.randint(1, 7)):
            text[at] = f"x{k}.{at}"
        texts.append(" ".join(text))
    looks, rows = members(texts)
    links = near_dedup._joined((77, 0, 0), rows, looks, 80)
    want = reach(list(enumerate(texts)))
    assert len(links) < len(texts)
    root = {k: k for k in range(len(texts))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {k: find(k) for k in root} == want
    assert near_dedup._joined((77, 0, 0), rows[:1], looks, 80) == []


def test_alike_counts_exactly():
    rng = np.random.RandomState(0)
    for _ in range(300):
        a, b = (np.unique(rng.randint(0, 30, rng.randint(1, 25)).astype(np.uint64)) for _ in range(2))
        common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert near_dedup._alike(a, b, 80) == (100 * common >= 80 * union)
