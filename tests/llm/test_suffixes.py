import hashlib

import numpy as np
import pyarrow as pa
import pytest

from voucherlens.llm import suffixes
from voucherlens.llm.suffixes import LENGTH, Runs, cut_repeats
from voucherlens.llm.text import flat

LAST = 2**63 - 1


def brute(rows):
    """(id, bytes, kept digest, spans) by comparing all strings of all documents."""
    first = {}
    raws = [((d if d is not None else LAST), (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - LENGTH + 1):
            key = raw[i : i + LENGTH]
            first[key] = min(first.get(key, LAST), d)
    out = []
    for (doc, _), (d, raw) in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw) + 2, bool)
        for i in range(len(raw) - LENGTH + 1):
            if first[raw[i : i + LENGTH]] < d:
                gone[1 + i : 1 + i + LENGTH] = True
        begins, ends = np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(gone[:-1] & ~gone[1:])
        kept = bytes(x for x, g in zip(raw, gone[1:]) if not g)
        out.append((doc, len(raw), hashlib.sha256(kept).hexdigest(), begins.tolist(), ends.tolist()))
    return sorted(out, key=repr)


def found(df):
    return sorted(
        ((r["doc_id"], r["n_bytes"], hashlib.sha256(r["kept"]).hexdigest(), r["span_start"], r["span_end"])
         for r in cut_repeats(df).collect()),
        key=repr,
    )


def test_against_all_strings(table, corpus):
    assert found(table(corpus)) == brute(corpus)


@pytest.mark.parametrize("rows", [
    [], [(1, None), (2, "")],
    [(1, "x" * 50), (2, "y" + "x" * 50), (3, "x" * 49), (2, "x" * 60), (None, "x" * 55), (None, "x" * 55)],
])
def test_small_tables(table, rows):
    assert found(table(rows)) == brute(rows)


def test_every_window_lies_in_one_run():
    texts = ["abc" * 40, "", "x" * 49, "y" * 50, "the quick brown fox " * 9, "ü" * 80]
    data, at = flat(pa.array(texts))
    runs = Runs(data, at)
    start, _, _ = runs.windows(np.arange(len(runs.first)))
    expected = [int(a) + i for a, n in zip(at, np.diff(at)) for i in range(n - LENGTH + 1)]
    assert sorted(start.tolist()) == expected


@pytest.mark.parametrize("hot_in_task, hot", [(64, 4096), (1, 4096), (64, 1), (0, 0)])
def test_hot_anchors_take_another_way_to_the_same_result(monkeypatch, corpus, hot_in_task, hot):
    """All rounds in this process, over two tasks, with other limits."""
    monkeypatch.setattr(suffixes, "HOT_IN_TASK", hot_in_task)
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = [(d, t) for d, t in corpus if d is not None and len(t or "") < 4000]
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    half = len(rows) // 2
    tasks = [pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[a:b], pa.int64()), "text": texts[a:b]})
             for a, b in ((0, half), (half, len(rows)))]
    sent = [b for t in tasks for b in suffixes._find_runs(1)(iter([t]))]
    runs = pa.Table.from_batches(list(suffixes._rank_runs(iter(sent)))).to_pylist()
    wanted = {s: [sorted({r["run"] for r in runs if r["doc_id"] == d and r["status"] == s}) for d in ids] for s in (1, 2, 3)}
    if (hot_in_task, hot) == (0, 0):
        assert not any(wanted[2]) and any(wanted[3])

    def with_runs(task, a, b, more=None):
        columns = {"doc_id": task.column("doc_id"), "text": task.column("text")}
        for name, status in (("whole", 1), ("part", 2), ("scattered", 3)):
            columns[name] = pa.array(wanted[status][a:b], pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict(columns | (more or {}))

    spans = ((0, half), (half, len(rows)))
    sent = [x for t, (a, b) in zip(tasks, spans) for x in suffixes._find_windows(1)(iter([with_runs(t, a, b)]))]
    told = {}
    for batch in suffixes._rank_windows(iter(sent)):
        for r in batch.to_pylist():
            told.setdefault(r["doc_id"], []).append(r["windows"])
    out = []
    for t, (a, b) in zip(tasks, spans):
        windows = pa.array([told.get(d) for d in ids[a:b]], pa.list_(pa.large_binary()))
        for batch in suffixes._cut(iter([with_runs(t, a, b, {"windows": windows})])):
            out += [(r["doc_id"], r["n_bytes"], hashlib.sha256(r["kept"]).hexdigest(), r["span_start"], r["span_end"])
                    for r in batch.to_pylist()]
    assert sorted(out, key=repr) == brute(rows)


def test_many_different_runs_of_one_anchor_are_told_apart():
    """Texts of random letters round one common string share no passage, however many they are."""
    rng = np.random.default_rng(3)
    # Of many strings that whose rank is lowest, so that it is the anchor round itself.
    words = rng.integers(97, 123, (4000, 16), np.uint8)
    ranks = suffixes.mix(suffixes.doubled(words.ravel())[16])[::16] >> np.uint64(32)
    held, common = [], words[ranks.argmin()].tobytes()
    for part in range(20):
        letters = rng.integers(97, 123, (5000, 84 + len(common)), np.uint8)
        letters[:, 42 : 42 + len(common)] = np.frombuffer(common, np.uint8)
        runs = suffixes.Runs(letters.ravel(), np.arange(5001) * letters.shape[1])
        held.append((runs.seed, runs.unit, runs.run, 5000 * part + runs.doc))
    columns = list(map(np.concatenate, zip(*held)))
    sent = [b for b in suffixes._pack_runs(*columns, 8) if b.num_rows]
    assert not any((b.column("status").to_numpy(zero_copy_only=False) == suffixes.FULL).any() for b in sent)
    # One anchor holds most of them, and names that travel differ too.
    anchor, run = columns[0] & np.uint64(0xFFFFFFFFFFFF), columns[2]
    values, counts = np.unique(anchor, return_counts=True)
    assert counts.max() > 20_000
    most = run[anchor == values[counts.argmax()]]
    assert len(np.unique(most)) == len(most)


def sent_windows(texts):
    """Bytes of windows that two tasks would send in round 2, and the statuses of their runs."""
    tasks = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "text": [x]}) for i, x in enumerate(texts)]
    sent = [b for t in tasks for b in suffixes._find_runs(1)(iter([t]))]
    runs = [r for b in suffixes._rank_runs(iter(sent)) for r in b.to_pylist()]
    return [(r["doc_id"], r["status"]) for r in runs]


def test_runs_that_share_no_more_than_their_anchor_send_no_windows():
    """Short phrases repeat without any passage of 50 bytes; only runs with 17 equal bytes at a side go on."""
    rng = np.random.default_rng(11)
    phrase = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    common = [phrase(24) for _ in range(40)]
    texts = ["".join(phrase(60) + c for c in common) for _ in range(4)]
    assert sent_windows(texts) == []
    # A passage of exactly 50 bytes is still found, wherever its anchor lies in it.
    passages = [phrase(50) for _ in range(60)]
    texts = ["".join(phrase(40) + p for p in passages) for _ in range(3)]
    assert len({d for d, s in sent_windows(texts) if s in (suffixes.PART, suffixes.SCATTERED)}) == 3


@pytest.mark.parametrize("length", [49, 50, 51, 67, 84, 120])
def test_passages_of_any_length_between_other_text(table, length):
    rng = np.random.default_rng(length)
    phrase = lambda n: bytes(rng.integers(97, 101, n, np.uint8)).decode()
    passages = [phrase(length) for _ in range(30)]
    rows = [(d, "".join(phrase(int(rng.integers(0, 60))) + p for p in passages)) for d in range(4)]
    assert found(table(rows)) == brute(rows)
