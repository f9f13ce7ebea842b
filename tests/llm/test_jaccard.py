import numpy as np
import pytest
from tests_words import words_of

from voucherlens.llm import jaccard
from voucherlens.llm.jaccard import lowest, near_duplicates


def brute(rows):
    """(doc_id, n, component, links) of every row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links = {i: set() for i in range(len(rows))}
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None, len(links[i])))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr)


def test_against_all_pairs(table, corpus):
    assert found(table(corpus)) == brute(corpus)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, None)], [(3, "a b c"), (2, "A B C"), (9, "a b d")]])
def test_small_tables(table, rows):
    assert found(table(rows)) == brute(rows)


def test_a_large_group_takes_several_blocks(table):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(600):
        copy = list(base)
        for k in rng.integers(0, 80, rng.integers(0, 3)):
            copy[k] = f"x{i}{k}"
        rows.append((i, " ".join(copy)))
    assert found(table(rows)) == brute(rows)


def test_the_screen_lets_all_linked_pairs_pass():
    """The bound on shared lowest shingles, for all sizes and the worst places of the rest."""
    for small in range(1, 120):
        for large in range(small, int(small / 0.75) + 1):
            shared = -(-75 * (small + large) // 175)  # the least overlap of linked sets
            for n in (small, large):
                # Shingles that only this set has come first in the worst case.
                assert lowest(n) - (n - shared) >= 9 * n // 80 + 1 or lowest(n) - (n - shared) >= shared
                both = min(lowest(small) - (small - shared), lowest(large) - (large - shared), shared)
                assert both >= min(9 * n // 80 + 1, shared)


def test_a_task_sends_a_common_shingle_once():
    sets = {k: np.unique(np.array([5, 6, 7, 1000 + k, 2000 + k], np.uint64)) for k in range(1, 50)}
    sent = [r for batch in jaccard._pack(sets, 4) for r in batch.to_pylist() if r["shingles"]]
    assert sum(len(r["shingles"]) // 4 for r in sent) == 3
