import hashlib
import random

import pytest

from voucherlens.llm.fingerprints import MAXIMUM, MINIMUM, as_text, boundaries, chunk_set, edited, fingerprint, likeness
import numpy as np


def prose(n, seed=3):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_chunks_cover_the_text_within_their_bounds():
    raw = prose(3000).encode()
    cuts = boundaries(np.frombuffer(raw, np.uint8))
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == len(raw) and sizes[:-1].min() >= MINIMUM and sizes.max() <= MAXIMUM


def test_chunks_survive_a_shift():
    text = prose(3000)
    assert likeness(chunk_set(text.encode()), chunk_set(("new words first " + text).encode())) > 0.97
    assert likeness(chunk_set(text.encode()), chunk_set(prose(3000, 4).encode())) < 0.05


def test_likeness_of_empty_texts():
    assert likeness({}, {}) == 1.0 and likeness({}, {1: 2}) == 0.0 and likeness({1: 2}, {}) == 0.0


@pytest.mark.parametrize("ranges", [1, 2, 40])
def test_against_the_whole_order(table, corpus, ranges):
    found = fingerprint(table(corpus), ranges=ranges).collect()
    order = sorted(corpus, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1] or ""))
    expected = []
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        new = edited(text, following)
        ours, theirs = chunk_set(text.encode()), chunk_set(new.encode())
        expected.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), as_text(ours), as_text(theirs),
                         likeness(ours, theirs), likeness(ours, chunk_set(following.encode()))))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_one_document_follows_itself_and_an_empty_table_is_empty(table):
    only = fingerprint(table([(1, "abcd")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in only] == [(1, 1.0)]
    assert fingerprint(table([])).collect() == []
