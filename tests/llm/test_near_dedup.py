"""Near duplicates against all pairs, the guarantee of the multi-index join, and components."""

import random
import re

import numpy as np
import pytest

from inkweave.llm import near_dedup
from inkweave.llm.components import components


def shingles(text, n):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def all_pairs(rows, n, percent=80):
    """Component of each id by comparing every pair; rows with one id are one node."""
    keyed = [(i, shingles(t, n)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in keyed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(keyed):
        for j, t in keyed[:k]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def check(found, rows, n):
    component = all_pairs(rows, n)
    expected = []
    for i, t in rows:
        s = shingles(t, n)
        own = None if i is None else component[i] if s else i
        expected.append((str(i), len(s), str(own), own is None or own == i))
    assert sorted((str(r.id), r.n_shingles, str(r.component_id), r.kept) for r in found) == sorted(expected)


@pytest.mark.parametrize("n", [2, 5])
def test_odd_rows(docs_of, odd_rows, n):
    check(near_dedup.near_duplicates(docs_of(odd_rows), shingle=n).collect(), odd_rows, n)


def test_chain_without_a_common_hub(docs_of, monkeypatch):
    """Neighbours in a chain are linked, its ends are not; blocks of a few classes still meet."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 250)
    rng = random.Random(8)
    words = [f"w{rng.random()}" for _ in range(400)]
    rows = [(100 - k, " ".join(words[k * 12 : k * 12 + 120])) for k in range(16)]
    rows += [(200 + k, " ".join(words[:100] + [f"x{k}{j}" for j in range(8)])) for k in range(6)]
    check(near_dedup.near_duplicates(docs_of(rows), shingle=2).collect(), rows, 2)


def test_empty_table(docs_of):
    assert near_dedup.near_duplicates(docs_of([])).collect() == []


def test_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 2**16, (200, near_dedup.VALUES), dtype=np.uint16)
    two = one.copy()
    for row in two:
        row[rng.choice(near_dedup.VALUES, near_dedup.DISTANCE, replace=False)] ^= 1
    assert (near_dedup.lookup_keys(one) == near_dedup.lookup_keys(two)).any(axis=1).all()
    assert not (near_dedup.lookup_keys(one) == near_dedup.lookup_keys(one[::-1])).any(axis=1).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = {i: 0 for i in range(31)} | {100: 100, 101: 100}
    assert {r.node: r.component for r in found} == expected and len(found) == len(expected)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_words_that_polynomial_hashes_confuse(docs_of):
    signs = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join(x[s] for s in signs) for x in ("ab", "ba"))
    rows = [(1, f"x {one}"), (2, f"x {other}"), (3, f"X {one}"), (4, one), (5, other)]
    for n in (2, 5):
        check(near_dedup.near_duplicates(docs_of(rows), shingle=n).collect(), rows, n)
