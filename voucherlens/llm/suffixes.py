"""Passages that repeat across documents, by sparse distributed prefix doubling.

A byte is removed if it is covered by a string of ``LENGTH`` bytes that also
starts in a document with a smaller id. Positions are ranked by their first 1,
2, 4, ... bytes, the rank at twice a length from two ranks at the length, and
ranks that are unique are dropped as soon as they are met. Ranks are 64-bit
hashes, so positions keep their rank wherever they are; of a run's rank 40 bits
travel beside 24 of its anchor's, of a window's 48 beside 32 of its anchor's.

Ranking every position would send 16 times the text per round. Positions are
thinned first in a way that loses none: of all 16-byte ranks in a window of
``LENGTH`` bytes the lowest is its anchor, and equal windows have equal anchors.
Consecutive windows with one anchor form a run, about one for 17 bytes.

1. Runs are dealt and sorted by anchor (length 16), then by the rank of the whole
   run (up to 84 bytes). An anchor of one run alone is unique and dropped. A run
   that a smaller id has in full is removed in full. A window reaches ``SIDE`` bytes
   or more past its anchor on one side, so a run of which no other run of its anchor
   has the bytes on either side (16 bits of their rank) shares no window. Where runs
   of an anchor differ and share a side, the smallest holder of each is ranked on:
2. the single windows of these runs (length 50) are dealt and sorted; a window
   that a smaller id has is removed.
3. Documents meet the results of both rounds and are cut.

Each task sends one entry for equal runs, and for an anchor with very many
different runs (a line in a third of all documents, say) only a note that it is
hot; windows of hot anchors are dealt by their own rank, not by anchor, so no
task gets all of them. Texts are shuffled once in each of rounds 2 and 3.

NULL and empty texts have no bytes. NULL ids come after all others and are equal
to each other. Repeated ids are no smaller than each other, so rows of one id do
not cut each other. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voucherlens.llm.components import release_shuffles
from voucherlens.llm.text import U64, byte_table, mix, signed, slices, table
from voucherlens.session import written

LENGTH = 50
SEED = 16
SPAN = LENGTH - SEED + 1
#: Bytes that every window has before its anchor, or after it.
SIDE = (LENGTH - SEED) // 2

#: Runs and windows that a task packs before it sends them on.
PACK = 1 << 20
#: Different runs of one anchor that a task, and all tasks, send on one by one.
HOT_IN_TASK, HOT = 64, 4096
LAST_ID, NOTE = 2**63 - 1, -(2**63)
FULL, PART, SCATTERED = 1, 2, 3

_SENT = pa.schema([
    ("bucket", pa.int32()), ("doc_id", pa.int64()), ("run", pa.int64()), ("status", pa.int8()), ("packed", pa.large_binary()),
])
_RUNS = pa.schema([("doc_id", pa.int64()), ("run", pa.int64()), ("status", pa.int8())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("windows", pa.large_binary())])
_CUT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.large_binary()),
    ("span_start", pa.list_(pa.int64())), ("span_end", pa.list_(pa.int64())),
])
_ENTRY = np.dtype([("run", "<u8"), ("doc", "<i8")])
_RUN_ENTRY = np.dtype([("run", "<u8"), ("doc", "<i8"), ("left", "<u2"), ("right", "<u2")])
_RUN = np.dtype([("anchor", "<u4"), ("windows", "<u2"), ("doc", "<i8")])

#: The part of a run's name that is its anchor's.
ANCHOR = U64(0xFFFFFF)

_BYTES = byte_table(37, fold_case=False)
_STEP = 0xA24BAED4963EE407


def doubled(data: np.ndarray) -> dict[int, np.ndarray]:
    """Ranks of all positions at lengths 2, 16 and 32, each from two of half the length."""
    ranks, rank, size = {}, _BYTES[data], 1
    while size < 32:
        factor = U64(pow(_STEP, size, 1 << 64))
        rank = rank[: max(len(rank) - size, 0)] + rank[size:] * factor
        size *= 2
        if size in (2, 16, 32):
            ranks[size] = rank
    return ranks


class Runs:
    """Runs of consecutive windows of ``LENGTH`` bytes that share their anchor."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        ranks = doubled(data)
        count = max(len(data) - LENGTH + 1, 0)
        power = lambda n: U64(pow(_STEP, n, 1 << 64))
        self.window = ranks[32][:count] + ranks[16][32 : 32 + count] * power(32) + ranks[2][48 : 48 + count] * power(48)
        seed = mix(ranks[16])
        low = (seed & U64(0xFFFFFFFF00000000)) | np.arange(len(seed), dtype=U64)
        size = 1
        while size < 32:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        anchor = (np.minimum(low[:count], low[SPAN - 32 : SPAN - 32 + count]) & U64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(count + 1, np.int64)
        whole = np.diff(at) >= LENGTH
        np.add.at(inside, at[:-1][whole], 1)
        np.add.at(inside, at[1:][whole] - LENGTH + 1, -1)
        windows = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        anchor = anchor[windows]
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
        self.first = windows[new]
        self.last = windows[np.r_[new[1:], len(anchor)] - 1] if len(anchor) else new
        anchor = anchor[new]
        self.doc = np.searchsorted(at, self.first, "right") - 1
        self.seed = seed[anchor]
        ends = mix(self.window[self.first]) + self.window[self.last]
        shape = ((self.last - self.first) * LENGTH + anchor - self.first).astype(U64)
        unit = mix(mix(ends) + shape)
        # A run's name: 40 bits of its own rank, and 24 of its anchor's.
        self.unit, self.anchor = unit, self.seed >> U64(16) & U64(0xFFFFFFFF)
        self.run = (unit & ~ANCHOR) | (self.anchor & ANCHOR)
        # The bytes at each side of the anchor, with most of it; 0 where no window has so many there.
        self.left, self.right = np.zeros((2, len(anchor)), np.uint16)
        left, right = anchor - self.first >= SIDE, self.last + LENGTH - anchor - SEED >= SIDE
        self.left[left] = _side(ranks[32][anchor[left] - SIDE])
        self.right[right] = _side(ranks[32][anchor[right] + SEED + SIDE - 32])

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of every window of the chosen runs, its run, and its name."""
        size = self.last[chosen] - self.first[chosen] + 1
        run = np.repeat(chosen, size)
        at = np.repeat(self.first[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return at, run, window_names(self.anchor[run], self.window[at])


def window_names(anchor: np.ndarray, window: np.ndarray) -> np.ndarray:
    """From half of the anchor's rank and 48 bits of the window's, which travel with a run."""
    return mix(anchor * U64(_STEP) + (window & U64(0xFFFFFFFFFFFF)))


def _side(rank: np.ndarray) -> np.ndarray:
    """16 bits of a rank, never 0."""
    return (mix(rank) % U64(0xFFFF) + U64(1)).astype(np.uint16)


def _shared(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether another row of the group has the same side; 0 is none."""
    _, at, count = np.unique(group.astype(U64) << U64(16) | side.astype(U64), return_inverse=True, return_counts=True)
    return (side > 0) & (count[at] > 1)


def _smallest(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For rows sorted by group and document, the first document of each row's group."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.repeat(doc[first], np.diff(np.r_[first, len(group)]))


def _sent(**columns) -> pa.RecordBatch:
    count = len(columns["bucket"])
    columns["bucket"] = np.asarray(columns["bucket"]).astype(np.int32)
    return table(_SENT, **{f.name: pa.nulls(count, f.type) for f in _SENT} | columns)


def _answer(doc: np.ndarray, run: np.ndarray, status: np.ndarray, buckets: int) -> pa.RecordBatch:
    spread = mix(run + doc.astype(U64)) % U64(buckets)
    return _sent(bucket=spread, doc_id=doc, run=signed(run), status=status.astype(np.int8))


def _by_bucket(bucket: np.ndarray, entries: np.ndarray, buckets: int) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(at))
    return _sent(bucket=full, packed=[entries[order[at[b] : at[b + 1]]].tobytes() for b in full])


def _pack_runs(
    seed: np.ndarray, unit: np.ndarray, run: np.ndarray, doc: np.ndarray, buckets: int,
    left: np.ndarray | int = 1, right: np.ndarray | int = 1,
) -> Iterator[pa.RecordBatch]:
    """Runs by the bucket of their anchor; what equal runs and hot anchors of a task show.

    Within a task runs are told apart by all 64 bits of their rank. Without their
    sides all different runs of an anchor are ranked on.
    """
    anchor = seed & U64(0xFFFFFFFFFFFF)
    order = np.lexsort((doc, unit, anchor))
    anchor, unit, run, doc = anchor[order], unit[order], run[order], doc[order]
    left, right = (np.broadcast_to(side, len(order))[order] for side in (left, right))
    new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
    new_run = new_anchor | np.r_[True, unit[1:] != unit[:-1]]
    later = doc > _smallest(np.cumsum(new_run), doc)
    yield _answer(doc[later], run[later], np.full(later.sum(), FULL), buckets)
    anchor, run, doc, new_anchor = anchor[new_run], run[new_run], doc[new_run], new_anchor[new_run]
    group = np.cumsum(new_anchor) - 1
    hot = np.bincount(group)[group] > HOT_IN_TASK
    yield _answer(doc[hot], run[hot], np.full(hot.sum(), SCATTERED), buckets)
    note = hot & new_anchor
    sent = ~hot | note
    entries = np.zeros(sent.sum(), _RUN_ENTRY)
    entries["run"] = np.where(note, run & ANCHOR, run)[sent]
    entries["doc"] = np.where(note, NOTE, doc)[sent]
    entries["left"], entries["right"] = left[new_run][sent], right[new_run][sent]
    yield _by_bucket((anchor[sent] & U64(0xFFFF)) * U64(buckets) >> U64(16), entries, buckets)


def _find_runs(buckets: int):
    def packed(held: list) -> Iterator[pa.RecordBatch]:
        seed, unit, run, doc, left, right = map(np.concatenate, zip(*held))
        return _pack_runs(seed, unit, run, doc, buckets, left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, data, at in slices(batches):
            runs = Runs(data, at)
            held.append((runs.seed, runs.unit, runs.run, rows.column("doc_id").to_numpy()[runs.doc], runs.left, runs.right))
            size += len(runs.seed)
            if size >= PACK:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    return run


def _packed(rows: pa.RecordBatch) -> Iterator[tuple[int, memoryview]]:
    for bucket, packed in zip(rows.column("bucket").to_pylist(), rows.column("packed")):
        if packed.is_valid:
            yield bucket, packed.as_buffer()


def _rank_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which runs a smaller id has in full, and which are to be ranked on by window."""
    parts = []
    for rows in batches:
        plain = rows.filter(rows.column("run").is_valid())
        if plain.num_rows:
            yield table(_RUNS, **{n: plain.column(n) for n in _RUNS.names})
        parts += [(bucket, np.frombuffer(packed, _RUN_ENTRY)) for bucket, packed in _packed(rows)]
    if not parts:
        return
    entries = np.concatenate([e for _, e in parts])
    bucket = np.repeat(np.array([b for b, _ in parts], U64), [len(e) for _, e in parts])
    anchor, run, doc = bucket << U64(32) | entries["run"] & ANCHOR, entries["run"], entries["doc"]
    order = np.lexsort((doc, run, anchor))
    anchor, run, doc, left, right = anchor[order], run[order], doc[order], entries["left"][order], entries["right"][order]
    note = doc == NOTE
    hot = np.isin(anchor, anchor[note])
    anchor, run, doc, hot, left, right = (x[~note] for x in (anchor, run, doc, hot, left, right))
    if not len(run):
        return
    new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
    new_run = new_anchor | np.r_[True, run[1:] != run[:-1]]
    later = doc > _smallest(np.cumsum(new_run), doc)
    group = np.cumsum(new_anchor) - 1
    different = np.bincount(group, new_run)[group]
    ranked = np.zeros(len(run), bool)
    ranked[new_run] = _shared(group[new_run], left[new_run]) | _shared(group[new_run], right[new_run])
    status = np.where(hot, SCATTERED, np.where(ranked, np.where(different > HOT, SCATTERED, PART), 0))
    status = np.where(later, FULL, np.where(new_run, status, 0))
    found = status > 0
    yield table(_RUNS, doc_id=doc[found], run=signed(run[found]), status=status[found].astype(np.int8))


def _chosen(runs: Runs, wanted: list[np.ndarray]) -> np.ndarray:
    """Whether each run is among those wanted of its document."""
    names = np.concatenate(wanted) if wanted else np.zeros(0, U64)
    of = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
    return np.isin(mix(runs.run + mix(runs.doc.astype(U64))), mix(names + mix(of.astype(U64))))


def _names(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x or (), np.int64).view(U64) for x in column.to_pylist()]


def _find_windows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches):
            runs, ids = Runs(data, at), rows.column("doc_id").to_numpy()
            # Windows of ordinary anchors travel by run: 6 bytes each.
            part = np.flatnonzero(_chosen(runs, _names(rows.column("part"))))
            if len(part):
                bucket = (runs.seed[part] & U64(0xFFFF)) * U64(buckets) >> U64(16)
                order = np.argsort(bucket, kind="stable")
                part, bounds = part[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(bounds))
                packed = []
                for b in full:
                    own = part[bounds[b] : bounds[b + 1]]
                    head = np.zeros(len(own), _RUN)
                    head["anchor"] = runs.anchor[own]
                    head["windows"], head["doc"] = runs.last[own] - runs.first[own] + 1, ids[runs.doc[own]]
                    ranks = runs.window[runs.windows(own)[0]].view(np.uint8).reshape(-1, 8)[:, :6]
                    packed.append(len(own).to_bytes(8, "little") + head.tobytes() + ranks.tobytes())
                yield _sent(bucket=full, packed=packed, status=np.full(len(full), PART, np.int8))
            hot = np.flatnonzero(_chosen(runs, _names(rows.column("scattered"))))
            if len(hot):
                _, of, names = runs.windows(hot)
                entries = np.zeros(len(names), _ENTRY)
                entries["run"], entries["doc"] = names, ids[runs.doc[of]]
                entries = np.unique(entries)
                # A document is kept for each name: its smallest, and those it is smaller than.
                later = entries["doc"] > _smallest(entries["run"], entries["doc"])
                yield from _tell(entries["doc"][later], entries["run"][later], buckets)
                entries = entries[~later]
                yield _by_bucket((entries["run"] >> U64(48)) * U64(buckets) >> U64(16), entries, buckets)

    return run


def _tell(doc: np.ndarray, names: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(doc, kind="stable")
    doc, names = doc[order], names[order]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    past = np.r_[first[1:], len(doc)]
    yield _sent(
        bucket=doc[first] % buckets, doc_id=doc[first], status=np.full(len(first), FULL, np.int8),
        packed=[names[a:b].tobytes() for a, b in zip(first.tolist(), past.tolist())],
    )


def _unpacked(packed: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Names and documents of windows that travelled by run."""
    raw = np.frombuffer(packed, np.uint8)
    count = int(raw[:8].view(np.int64)[0])
    head = raw[8 : 8 + count * _RUN.itemsize].view(_RUN)
    ranks = np.zeros((int(head["windows"].sum()), 8), np.uint8)
    ranks[:, :6] = raw[8 + count * _RUN.itemsize :].reshape(-1, 6)
    anchor = np.repeat(head["anchor"].astype(U64), head["windows"])
    return window_names(anchor, ranks.view(U64).ravel()), np.repeat(head["doc"], head["windows"])


def _rank_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document the names of its windows that a smaller id has."""
    names, docs = [], []
    for rows in batches:
        told = rows.filter(rows.column("doc_id").is_valid())
        if told.num_rows:
            yield table(_FOUND, doc_id=told.column("doc_id"), windows=told.column("packed").cast(pa.large_binary()))
        rest = rows.filter(rows.column("doc_id").is_null())
        for status, packed in zip(rest.column("status").to_pylist(), rest.column("packed")):
            if status == PART:
                name, doc = _unpacked(packed.as_buffer())
            else:
                entries = np.frombuffer(packed.as_buffer(), _ENTRY)
                name, doc = entries["run"], entries["doc"]
            names.append(name)
            docs.append(doc)
    if not names:
        return
    name, doc = np.concatenate(names), np.concatenate(docs)
    order = np.lexsort((doc, name))
    name, doc = name[order], doc[order]
    later = doc > _smallest(name, doc)
    for batch in _tell(doc[later], name[later], 1):
        yield table(_FOUND, doc_id=batch.column("doc_id"), windows=batch.column("packed"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, at in slices(batches):
        runs = Runs(data, at)
        cover = np.zeros(len(data) + 1, np.int64)
        full = _chosen(runs, _names(rows.column("whole")))
        np.add.at(cover, runs.first[full], 1)
        np.add.at(cover, runs.last[full] + LENGTH, -1)
        asked = [np.r_[a, b] for a, b in zip(_names(rows.column("part")), _names(rows.column("scattered")))]
        start, of, names = runs.windows(np.flatnonzero(_chosen(runs, asked)))
        found = [np.frombuffer(b"".join(x or ()), U64) for x in rows.column("windows").to_pylist()]
        doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
        known = mix((np.concatenate(found) if found else np.zeros(0, U64)) + mix(doc.astype(U64)))
        start = start[np.isin(mix(names + mix(runs.doc[of].astype(U64))), known)]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + LENGTH, -1)
        gone = np.cumsum(cover[:-1]) > 0
        kept, begins, ends = [], [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            own = np.r_[False, gone[a:b], False]
            begins.append(np.flatnonzero(own[1:] & ~own[:-1]))
            ends.append(np.flatnonzero(own[:-1] & ~own[1:]))
            kept.append(data[a:b][~gone[a:b]].tobytes())
        yield table(
            _CUT, doc_id=rows.column("doc_id"), n_bytes=np.diff(at), kept=kept, span_start=begins, span_end=ends
        )


def cut_repeats(documents: DataFrame) -> DataFrame:
    """Per document: n_bytes, the kept bytes, and the removed spans as byte ranges."""
    spark = documents.sparkSession
    buckets = min(1 << 15, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), "text")
    sent = "bucket int, doc_id long, run long, status tinyint, packed binary"

    runs = docs.mapInArrow(_find_runs(buckets), sent).repartition(buckets, "bucket")
    runs = runs.mapInArrow(_rank_runs, "doc_id long, run long, status tinyint")
    of_status = lambda status, name: F.collect_set(F.when(F.col("status") == status, F.col("run"))).alias(name)
    first = written(runs.groupBy("doc_id").agg(
        of_status(FULL, "whole"), of_status(PART, "part"), of_status(SCATTERED, "scattered")
    ), "repeat-runs")
    del runs
    release_shuffles(spark)

    asked = first.select("doc_id", "part", "scattered").where("size(part) + size(scattered) > 0")
    windows = docs.join(asked.hint("merge"), "doc_id").mapInArrow(_find_windows(buckets), sent)
    windows = windows.repartition(buckets, "bucket").mapInArrow(_rank_windows, "doc_id long, windows binary")
    second = written(windows, "repeat-windows")
    del windows
    release_shuffles(spark)

    second = second.groupBy("doc_id").agg(F.collect_list("windows").alias("windows"))
    joined = docs.join(first.hint("merge"), "doc_id", "left").join(second.hint("merge"), "doc_id", "left")
    cut = joined.select("doc_id", "text", "whole", "part", "scattered", "windows").mapInArrow(
        _cut, "doc_id long, n_bytes long, kept binary, span_start array<long>, span_end array<long>"
    )
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))
