"""Text columns as flat byte arrays, and word and shingle hashes over them.

All kernels run inside Spark tasks, on slices of an Arrow batch of a few MB, so
a task's memory does not depend on its partition. A single longer text is one
slice. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD1342543DE82EF95)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))

# Fixed byte classes: words of shingle operators end at ASCII white space, words
# of decontamination hold digits, letters and all bytes beyond ASCII.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(seed: int, *, fold_case: bool) -> np.ndarray:
    """A random number for each byte; A-Z count as a-z if case is folded."""
    table = mix(np.arange(1, 257, dtype=U64) * ODD + U64(seed))
    if fold_case:
        table[0x41:0x5B] = table[0x61:0x7B]
    return table


_WORD_BYTES = byte_table(11, fold_case=True)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(size, SLICE_BYTES + 1), base, U64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    tables = _powers[0][:size], _powers[1][:size]
    if size > 8 * SLICE_BYTES:  # do not keep what one very long text needed
        _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
    return tables


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows whose texts have ``limit`` bytes together, or one longer text."""
    for batch in batches:
        data, at = flat(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield (
                batch.slice(first, last - first),
                data[at[first] : at[last]],
                at[first : last + 1] - at[first],
            )
            first = last


def words(
    data: np.ndarray, at: np.ndarray, separators: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    edges = at[(at > 0) & (at < len(data))]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    begins[edges] |= inside[edges + 1]
    ends[edges - 1] |= inside[edges]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, at)


def byte_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of any run of bytes follows, and the factors of their beginnings."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_WORD_BYTES[data] * power[:-1], out=sums[1:])
    return sums, inverse


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every word, with A-Z as a-z."""
    sums, inverse = byte_sums(data)
    return mix((sums[end] - sums[start]) * inverse[start])


def chain(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, whether or not it stays in one text."""
    count = max(len(hashes) - size + 1, 0)
    runs = hashes[:count] + U64(size)
    for k in range(1, size):
        runs = mix(runs) * ODD + hashes[k : k + count]
    return mix(runs)


def shingle_sets(
    data: np.ndarray, at: np.ndarray, size: int, separators: np.ndarray = SPACE
) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text of fewer words than ``size`` has its whole sequence as one shingle,
    a text without words has none.
    """
    start, end, before = words(data, at, separators)
    hashes = word_hashes(data, start, end)
    runs = chain(hashes, size)
    sets = []
    for first, last in zip(before[:-1].tolist(), before[1:].tolist()):
        if last - first >= size:
            sets.append(np.unique(runs[first : last - size + 1]))
        elif last > first:
            sets.append(chain(hashes[first:last], last - first))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, U64).view(np.int64)


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
        for f, c in ((f, columns[f.name]) for f in schema)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
