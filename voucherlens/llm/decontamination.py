"""Benchmark decontamination: a prefix-filtered set join with exact windows.

A benchmark item is a sequence of windows of ``window`` consecutive words (one
shorter window if the item is shorter). A document is contaminated by a window
it holds word for word, that is with containment 1, so the necessary prefix of
a window's shingle set is one shingle: its rarest. Steps:

1. windows of all items, made distinct;
2. document frequency of the windows' shingles over the whole corpus;
3. documents are joined to windows on each window's rarest shingle; a match
   fixes where the window would begin, so matches whose window would leave the
   document are dropped (length and positional bounds), and the rest are
   compared word by word.

Windows come in blocks of at most ``BLOCK`` (about 200 bytes each), and one
block at a time is broadcast; a larger benchmark takes more passes. Documents
are only scanned, never shuffled, with one block.

NULL and empty texts, and texts without words, have no words, no windows and no
hits. An empty benchmark or corpus gives no hits or no rows. Repeated documents
each get a row. Repeated items, and items with equal windows, are all reported.
Rows of the benchmark with a NULL item id are left out. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voucherlens.llm.text import NOT_ALNUM, U64, chain, signed, slices, table, word_hashes, words
from voucherlens.session import written

WINDOW = 13
SHINGLE = 5
BLOCK = 500_000

_WINDOWS = pa.schema([("item_id", pa.int64()), ("words", pa.large_binary())])
_COUNTS = pa.schema([("shingle", pa.int64()), ("docs", pa.int64())])
_HITS = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
    ("hits", pa.large_binary()), ("items", pa.list_(pa.int64())),
])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, words): the word hashes of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in slices(batches):
            start, end, before = words(data, at, NOT_ALNUM)
            hashes = word_hashes(data, start, end)
            ids, found = [], []
            for item, first, last in zip(
                rows.column("item_id").to_pylist(), before[:-1].tolist(), before[1:].tolist()
            ):
                size = min(window, last - first)
                if size:
                    own = {hashes[i : i + size].tobytes() for i in range(first, last - size + 1)}
                    ids += [item] * len(own)
                    found += own
            yield table(_WINDOWS, item_id=ids, words=found)

    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
    return rows.mapInArrow(run, "item_id long, words binary").distinct()


class Block:
    """Some windows, grouped by size, and the items that hold them."""

    def __init__(self, rows: pa.Table) -> None:
        blobs, items = rows.column("words").to_pylist(), rows.column("item_id").to_numpy()
        distinct = {b: i for i, b in enumerate(dict.fromkeys(blobs))}
        owner = np.array([distinct[b] for b in blobs], np.int64)
        order = np.argsort(owner, kind="stable")
        self.items = items[order]
        self.items_at = np.searchsorted(owner[order], np.arange(len(distinct) + 1))
        self.size = np.array([len(b) // 8 for b in distinct], np.int64)
        self.words = np.zeros((len(distinct), WINDOW if not len(self.size) else self.size.max()), U64)
        for i, b in enumerate(distinct):
            self.words[i, : len(b) // 8] = np.frombuffer(b, U64)
        # Every shingle of every window: (length, hash, window, offset).
        self.lengths = np.minimum(self.size, SHINGLE)
        parts = []
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == size)
            k = min(size, SHINGLE)
            for offset in range(size - k + 1):
                runs = chain_rows(self.words[own, offset : offset + k])
                parts.append((runs, own, np.full(len(own), offset)))
        join = lambda i, kind: np.concatenate([p[i] for p in parts]).astype(kind) if parts else np.zeros(0, kind)
        self.shingle, self.of, self.offset = join(0, U64), join(1, np.int64), join(2, np.int64)

    def shingles(self) -> np.ndarray:
        return np.unique(self.shingle)

    def keep_rarest(self, shingles: np.ndarray, docs: np.ndarray) -> None:
        """Of each window keep its rarest shingle; windows that cannot occur go."""
        if not len(self.shingle):
            return
        place = np.searchsorted(shingles, self.shingle)
        place = np.minimum(place, max(len(shingles) - 1, 0))
        known = shingles[place] == self.shingle if len(shingles) else np.zeros(len(place), bool)
        count = np.where(known, docs[place] if len(docs) else 0, 0)
        order = np.lexsort((self.shingle, count, self.of))
        first = np.r_[True, self.of[order][1:] != self.of[order][:-1]]
        kept = order[first]
        kept = kept[count[kept] > 0]
        kept = kept[np.argsort(self.shingle[kept], kind="stable")]
        self.shingle, self.of, self.offset = self.shingle[kept], self.of[kept], self.offset[kept]


def chain_rows(matrix: np.ndarray) -> np.ndarray:
    """:func:`chain` of every row of a matrix of word hashes."""
    size = matrix.shape[1]
    flat = np.ascontiguousarray(matrix).reshape(-1)
    return chain(flat, size)[::size] if len(flat) else np.zeros(0, U64)


def _matches(block: Block, hashes: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, index into ``keys``) of document shingles among sorted ``keys``."""
    for k in np.unique(block.lengths).tolist():
        runs = chain(hashes, k)
        place = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
        at = np.flatnonzero(keys[place] == runs)
        yield at, place[at]


def _count_shingles(docs: DataFrame, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents each shingle of the block occurs; bounded by the block."""
    keys = block.shingles()
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        keys, total = block.shingles(), None
        total = np.zeros(len(keys), np.int64)
        for _, data, at in slices(batches):
            start, end, before = words(data, at, NOT_ALNUM)
            hashes = word_hashes(data, start, end)
            for position, key in _matches(block, hashes, keys):
                doc = np.searchsorted(before, position, "right") - 1
                pairs = np.unique(doc * len(keys) + key)
                np.add.at(total, pairs % len(keys), 1)
        found = np.flatnonzero(total)
        yield table(_COUNTS, shingle=signed(keys[found]), docs=total[found])

    counts = docs.select("text").mapInArrow(run, "shingle long, docs long")
    rows = counts.groupBy("shingle").agg(F.sum("docs").alias("docs")).toArrow()
    shared.unpersist()
    found = rows.column("shingle").to_numpy().view(U64)
    order = np.argsort(found)
    return found[order], rows.column("docs").to_numpy()[order]


def _spans(block: Block, hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first word, past last word, window) of every occurring window."""
    found = []
    if len(block.shingle) and len(hashes):
        keys, first = np.unique(block.shingle, return_index=True)
        past = np.r_[first[1:], len(block.shingle)]
        for position, key in _matches(block, hashes, keys):
            repeat = past[key] - first[key]
            row = np.repeat(first[key] - np.r_[0, np.cumsum(repeat)[:-1]], repeat) + np.arange(repeat.sum())
            position, window = np.repeat(position, repeat), block.of[row]
            begin = position - block.offset[row]
            doc = np.searchsorted(before, position, "right") - 1
            size = block.size[window]
            inside = (begin >= before[doc]) & (begin + size <= before[doc + 1])
            begin, doc, size, window = begin[inside], doc[inside], size[inside], window[inside]
            same = np.ones(len(begin), bool)
            for i in range(block.words.shape[1]):
                open_ = np.flatnonzero(same & (size > i))
                same[open_] = hashes[begin[open_] + i] == block.words[window[open_], i]
            found.append((doc[same], begin[same], begin[same] + size[same], window[same]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))


def _hits(docs: DataFrame, block: Block) -> DataFrame:
    """For every document: its number of words, hit words and occurring items."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for rows, data, at in slices(batches):
            start, end, before = words(data, at, NOT_ALNUM)
            doc, begin, past, window = _spans(block, word_hashes(data, start, end), before)
            cover = np.zeros(len(start) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, past, -1)
            hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            hit_at = np.searchsorted(hit, before)
            order = np.argsort(doc, kind="stable")
            doc_at = np.searchsorted(doc[order], np.arange(rows.num_rows + 1))
            hits, items = [], []
            for i in range(rows.num_rows):
                hits.append((hit[hit_at[i] : hit_at[i + 1]] - before[i]).tobytes())
                own = np.unique(window[order[doc_at[i] : doc_at[i + 1]]])
                items.append(sorted({x for w in own for x in block.items[block.items_at[w] : block.items_at[w + 1]].tolist()}))
            yield table(
                _HITS, doc_id=rows.column("doc_id"), text_hash=rows.column("text_hash"),
                n_words=np.diff(before), hits=hits, items=items,
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(
        run, "doc_id long, text_hash long, n_words long, hits binary, items array<long>"
    )


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items (ids whose windows occur)."""
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    windows = written(item_windows(benchmark, window), "benchmark-windows")
    blocks = max(1, -(-windows.count() // block))
    parts = []
    for i in range(blocks):
        chosen = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == i)
        own = Block(chosen.toArrow())
        own.keep_rarest(*_count_shingles(docs, own))
        parts.append(_hits(docs, own))
    if blocks == 1:
        return parts[0].select("doc_id", "n_words", (F.length("hits") / 8).cast("long").alias("n_hit"), "items")
    return _merged(parts)


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Hits of all blocks together, one row for each row of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("doc_id", "n_words", "copies", "items")),
                 pa.array([len(np.unique(np.frombuffer(b"".join(h), np.int64))) for h in rows.column("hits").to_pylist()], pa.int64())],
                ["doc_id", "n_words", "copies", "items", "n_hit"],
            )

    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    merged = rows.groupBy("doc_id", "text_hash", "n_words").agg(
        (F.count("*") / len(parts)).cast("long").alias("copies"),
        F.collect_set("hits").alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    merged = merged.mapInArrow(
        run, "doc_id long, n_words long, copies long, items array<long>, n_hit long"
    )
    one_each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return merged.select("doc_id", "n_words", "n_hit", "items", one_each.alias("copy")).drop("copy")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> F.Column:
    """At least one hit, and hit words are a twentieth of all words or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def digest(result: DataFrame) -> DataFrame:
    """The items as a count and a digest of their ids, sorted as strings."""
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )
