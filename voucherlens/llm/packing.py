"""Packing: shortest-pack-first over the histogram of piece lengths.

1. Documents become token ids and one end id, cut into pieces of at most
   ``capacity`` ids; only the last piece of a document is shorter.
2. The histogram of piece lengths has at most ``capacity`` bins, whatever the
   corpus. Lengths are placed longest first, each into the pack with most room
   (the shortest), or into a new pack when none has room. A packing pattern is
   a list of lengths with the number of sequences that use it, so the driver's
   work depends on the bins alone.
3. Patterns give every length ranges of ranks. Pieces get a rank within their
   length from counts of (length, slot) cells, so a length that holds a third
   of all pieces is ranked by many tasks, and look their sequence up by it.

Texts are split at ASCII white space before they are encoded, since the
tokenizer's normalizer and pre-tokenizer never look across it; the ids of words
seen before are remembered in flat arrays of bounded size.

NULL and empty texts are one piece with the end id alone. Repeated documents
and ids are packed as often as they occur. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voucherlens.llm.text import SPACE, U64, slices, table, word_hashes, words as find_words
from voucherlens.session import written

CAPACITY = 4096
END_ID = 2
#: Parts of words whose ids a Python worker remembers, and the longest in bytes.
REMEMBERED = 1_000_000
REMEMBERED_BYTES = 48
SLICE_BYTES = 1 << 19
# Fixed byte classes: ASCII letters, and ASCII characters that are neither letter,
# digit, control character nor white space.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
END_MARKS = np.zeros(256, bool)
END_MARKS[0x21:0x7F] = True
END_MARKS[0x30:0x3A] = False
END_MARKS &= ~LETTERS

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
])
_PACKED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _runs(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``begin``, one after the other."""
    past = np.cumsum(size)
    total = int(past[-1]) if len(past) else 0
    return flat[np.repeat(begin - past + size, size) + np.arange(total)]


class Ids(NamedTuple):
    """Token ids by hash, as flat arrays: sorted keys, where the ids of each begin, how many, and the ids."""

    keys: np.ndarray = np.zeros(0, U64)
    begin: np.ndarray = np.zeros(0, np.int64)
    size: np.ndarray = np.zeros(0, np.int64)
    flat: np.ndarray = np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are here, and where those are."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = self.keys[at] == keys
        return here, at[here]

    def chosen(self, at: np.ndarray, keys: np.ndarray) -> Ids:
        size = self.size[at]
        return Ids(keys, np.cumsum(size) - size, size, _runs(self.flat, self.begin[at], size))

    def joined(self, other: Ids) -> Ids:
        keys = np.r_[self.keys, other.keys]
        order = np.argsort(keys, kind="stable")
        begin = np.r_[self.begin, other.begin + len(self.flat)]
        size = np.r_[self.size, other.size]
        return Ids(keys[order], begin[order], size[order], np.r_[self.flat, other.flat])


class Encoder:
    """Token ids of texts, by a tokenizer that drops white space and folds case.

    A word is its stem and the marks at its end. The distinct stems and marks of
    a slice are looked up by a hash that ignores the case of A-Z, and those not
    known yet are encoded. What is known goes by age: when the newer half is
    full it becomes the older one, and the older one is forgotten.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        # Spark's tasks fill the cores already; threads of a task would only add memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_file(path)
        self._half = remembered // 2
        self._newer = self._older = Ids()

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        strings = [t.decode() for t in texts]
        return [e.ids for e in self._tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> Ids:
        found = self._encode(parts)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        return Ids(keys, np.cumsum(size) - size, size, flat)

    def _look_up(self, keys: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> Ids:
        """Ids of the parts with these sorted, distinct hashes."""
        here, at = self._newer.find(keys)
        found = self._newer.chosen(at, keys[here])
        rest = np.flatnonzero(~here)
        here, at = self._older.find(keys[rest])
        older = self._older.chosen(at, keys[rest[here]])
        new = rest[~here]
        parts = [raw[a:b].lower() for a, b in zip(start[new].tolist(), end[new].tolist())]
        learned = self._learn(keys[new], parts)
        short = np.flatnonzero(end[new] - start[new] <= REMEMBERED_BYTES)
        self._newer = self._newer.joined(older).joined(learned.chosen(short, learned.keys[short]))
        if len(self._newer.keys) > self._half:
            self._newer, self._older = Ids(), self._newer
        return found.joined(older).joined(learned)

    def encode(self, data: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
        """Ids of every text of a slice, as unsigned 32-bit numbers."""
        start, end = _parts(data, at)
        distinct, first, place = np.unique(
            word_hashes(data, start, end), return_index=True, return_inverse=True
        )
        raw = data.tobytes()
        known = self._look_up(distinct, raw, start[first], end[first])
        size = known.size[place]
        ids = _runs(known.flat, known.begin[place], size)
        past = np.r_[0, np.cumsum(size)][np.searchsorted(start, at)].tolist()
        special = b"<|" in raw
        for a, b, i, j in zip(at[:-1].tolist(), at[1:].tolist(), past, past[1:]):
            # The tokenizer takes its special strings as they are written.
            if special and b"<|" in raw[a:b]:
                yield np.array(self._encode([raw[a:b]])[0], "<u4").tobytes()
            else:
                yield ids[i:j].tobytes()


def _parts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of all words begin and end: a word without the marks at its end, and these marks.

    ASCII marks up to the end are one token run if a letter stands before them;
    any other word is one part.
    """
    start, end, _ = find_words(data, at, SPACE)
    if not len(start):
        return start, end
    inner = np.where(END_MARKS[data], 0, np.arange(1, len(data) + 1))
    stem = np.maximum(np.maximum.accumulate(inner)[end - 1], start)
    last, before = data[stem - 1], data[stem - 2]
    latin = (stem - start > 1) & (before == 0xC3) & (last >= 0x9F) & (last != 0xB7)
    stem = np.where((stem > start) & (LETTERS[last] | latin), stem, end)
    start, end = np.column_stack([start, stem]).ravel(), np.column_stack([stem, end]).ravel()
    return start[end > start], end[end > start]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so that its cache serves many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, with the CRC-32 of their ids."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for rows, data, at in slices(batches, limit=SLICE_BYTES):
            out = []
            for doc, ids in zip(rows.column("doc_id").to_pylist(), tokens.encode(data, at), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    out.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            columns = dict(zip(_PIECES.names, zip(*out), strict=True)) if out else {}
            if columns:
                yield table(_PIECES, **columns)

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns, as (length, how often) runs, with the number of their sequences."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    heap: list[int] = []
    done = []

    def put(count: int, runs: list[tuple[int, int]], left: int) -> None:
        if count and left:
            if left not in room:
                room[left] = []
                heapq.heappush(heap, -left)
            room[left].append((count, runs))
        elif count:
            done.append((runs, count))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            left = -heap[0] if heap else 0
            if left < length:
                # Nothing has room: fill new packs with this length.
                each = capacity // length
                put(todo // each, [(length, each)], capacity - each * length)
                todo %= each
                if todo:
                    put(1, [(length, todo)], capacity - todo * length)
                todo = 0
                continue
            count, runs = room[left].pop()
            if not room[left]:
                del room[left]
                heapq.heappop(heap)
            used = min(count, todo)
            last, often = runs[-1]
            new = [*runs[:-1], (length, often + 1)] if last == length else [*runs, (length, 1)]
            put(used, new, left - length)
            put(count - used, runs, left)
            todo -= used
    return done + [(runs, count) for packs in room.values() for count, runs in packs]


class Placement:
    """Where the piece of a given length and rank goes."""

    def __init__(self, patterns: list[tuple[list[tuple[int, int]], int]]) -> None:
        rows, taken, first = [], {}, 0
        for runs, count in patterns:
            offset = 0
            for length, often in runs:
                rank = taken.get(length, 0)
                rows.append((length, rank, often, first, offset))
                taken[length] = rank + often * count
                offset += often * length
            first += count
        self._rows = np.array(sorted(rows) or [(0, 0, 1, 0, 0)], np.int64)
        self._key = self._rows[:, 0] << 48 | self._rows[:, 1]

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self._key, length << 48 | rank, "right") - 1
        _, start, often, first, offset = self._rows[at].T
        copy, place = np.divmod(rank - start, often)
        return first + copy, offset + place * length


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for a stored table of pieces."""
    spark = found.sparkSession
    slots = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = found.withColumn("slot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slots)))
    cells = written(dealt.groupBy("length", "slot").agg(F.count("*").alias("cell")), "packing-cells")
    bins = cells.groupBy("length").agg(F.sum("cell").alias("count")).collect()
    placement = spark.sparkContext.broadcast(
        Placement(pack_histogram({r["length"]: r["count"] for r in bins}, capacity))
    )
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("length", "slot", F.coalesce(F.sum("cell").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "slot").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("in_cell", F.row_number().over(within) - 1).join(first, ["length", "slot"])
    ranked = ranked.select(*_PIECES.names, (F.col("first") + F.col("in_cell")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sequence, offset = placement.value(
                rows.column("length").to_numpy(), rows.column("rank").to_numpy()
            )
            columns = {n: rows.column(n) for n in _PIECES.names}
            yield table(_PACKED, **columns, sequence_id=sequence, offset=offset)

    return ranked.mapInArrow(
        run,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long",
    )


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    return place(written(pieces(documents, tokenizer, capacity), "pieces"), capacity)
