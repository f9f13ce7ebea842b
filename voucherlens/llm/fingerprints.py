"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes of a text. A chunk ends where the hash
meets a mask; the mask is normalised: a chunk shorter than ``NORMAL`` bytes must
meet a stricter mask than a longer one, so chunk lengths gather around
``NORMAL``. Boundaries depend on the preceding 32 bytes alone, so text that
moves keeps its chunks. A fingerprint is the set of chunk digests with their
lengths; the likeness of A to B is the share of A's bytes whose chunks B holds.

The edited text of a document needs the text of the next one in descending
doc_id. Documents are dealt by id ranges of equal counts, in one shuffle of
the texts; the first document of each range also goes to the range before it.

NULL and empty texts have an empty fingerprint, whose likeness is 1 to another
empty one and 0 to any other. NULL ids come after all others. Repeated ids are
ordered by text and each keep a row. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from voucherlens.llm.text import U64, byte_table, table

MINIMUM, NORMAL, MAXIMUM = 16, 48, 192
#: Bits of the gear hash that must be zero, below and above ``NORMAL`` bytes.
STRICT, LOOSE = 7, 4

_GEAR = (byte_table(23, fold_case=False) >> U64(32)).astype(np.uint32)
_ROWS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def gear(data: np.ndarray) -> np.ndarray:
    """sum of GEAR[b] << distance over the last 32 bytes, by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Where chunks end."""
    # Only the top bits see all 32 bytes.
    top = gear(data) >> np.uint32(32 - STRICT)
    ends = np.flatnonzero((top >> np.uint32(STRICT - LOOSE)) == 0) + 1
    strict = (top[ends - 1] == 0).tolist()
    cuts, last, size = [], 0, len(data)
    for end, meets in zip(ends.tolist(), strict):
        while end - last > MAXIMUM:
            last += MAXIMUM
            cuts.append(last)
        length = end - last
        if length >= MINIMUM and (meets or length >= NORMAL):
            cuts.append(end)
            last = end
    while size - last > MAXIMUM:
        last += MAXIMUM
        cuts.append(last)
    if last < size:
        cuts.append(size)
    return cuts


def chunk_set(raw: bytes) -> dict[int, int]:
    """Digest and length of every distinct chunk."""
    chunks, last = {}, 0
    for end in boundaries(np.frombuffer(raw, np.uint8)) if raw else []:
        part = raw[last:end]
        # 40 bits of digest; the length tells chunks apart too.
        chunks[xxhash.xxh3_64_intdigest(part) >> 24] = end - last
        last = end
    return chunks


def as_text(chunks: dict[int, int]) -> str:
    return " ".join(f"{digest:010x}:{length}" for digest, length in sorted(chunks.items()))


def likeness(ours: dict[int, int], theirs: dict[int, int]) -> float:
    """Share of our bytes, by distinct chunk, that lie in chunks of theirs."""
    if not ours:
        return float(not theirs)
    total = sum(ours.values())
    return sum(n for d, n in ours.items() if theirs.get(d) == n) / total


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as many code points of another's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_ranges(documents: DataFrame, ranges: int) -> DataFrame:
    """Documents in descending order of id, dealt to one partition for each range.

    Range bounds are ids that occur, so a document knows by its id alone that it
    is the first of its range and belongs, as ``extra``, behind the range before
    too. The very first document also goes behind the last one.
    """
    # The complement reverses the order of ids without overflow.
    place = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    docs = documents.select(place.alias("place"), F.col("doc_id").cast("long"), "text")
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = docs.agg(
        F.min("place").alias("first"), F.percentile_approx("place", shares, 50 * ranges).alias("cuts")
    ).first()
    cuts = np.array(sorted(set(found["cuts"] or []) - {found["first"]}), np.int64)
    count, first = len(cuts) + 1, found["first"]
    schema = pa.schema([
        ("part", pa.int32()), ("extra", pa.bool_()), ("place", pa.int64()),
        ("doc_id", pa.int64()), ("text", pa.string()),
    ])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = rows.column("place").to_numpy()
            part = np.searchsorted(cuts, at, "right")
            begins = np.flatnonzero((part > 0) & (cuts[part - 1] == at)) if len(cuts) else np.zeros(0, np.int64)
            opens = np.flatnonzero(at == first)
            for chosen, to, extra in (
                (None, part, False), (begins, part[begins] - 1, True),
                (opens, np.full(len(opens), count - 1), True),
            ):
                own = rows if chosen is None else rows.take(pa.array(chosen))
                if own.num_rows:
                    yield table(
                        schema, part=to.astype(np.int32), extra=np.full(own.num_rows, extra),
                        **{c: own.column(c) for c in ("place", "doc_id", "text")},
                    )

    dealt = docs.mapInArrow(deal, "part int, extra boolean, place long, doc_id long, text string")
    return dealt.repartitionById(count, "part").sortWithinPartitions("part", "extra", "place", "text")


def fingerprint(documents: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    spark = documents.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, False
        for batch in batches:
            out = []
            for extra, doc, text in zip(*(batch.column(c).to_pylist() for c in ("extra", "doc_id", "text"))):
                if done:
                    break
                text = text or ""
                chunks = chunk_set(text.encode())
                if held is not None:
                    out.append(_row(*held, text, chunks))
                held, done = (doc, text, chunks), extra
            if out:
                yield table(_ROWS, **dict(zip(_ROWS.names, zip(*out), strict=True)))

    return in_ranges(documents, ranges).select("extra", "doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


def _row(doc: int | None, text: str, ours: dict[int, int], following: str, theirs: dict[int, int]) -> tuple:
    raw = edited(text, following).encode()
    changed = chunk_set(raw)
    return (
        doc, len(text), hashlib.sha256(raw).hexdigest(), as_text(ours), as_text(changed),
        likeness(ours, changed), likeness(ours, theirs),
    )
