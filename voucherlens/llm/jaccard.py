"""Near-duplicate documents by a grouped prefix join over word shingles.

Two documents link when their sets of five-word shingles have a Jaccard
similarity of 3/4 or more. Equal sets are one set throughout. Steps:

1. Screen. In one scan every document gives its set's size and hash, and the
   lowest two fifths of its shingles. These are dealt as packed arrays, and
   counted: a set can link only if at least 9/80 of its size of them occur in
   other sets (see ``screened``). A shingle that repeats within a task leaves it
   once, so a shingle of a third of all documents costs one entry for each task.
2. Prefixes. For the sets left, shingles are ordered by rarity; a set's prefix
   is its rarest quarter. Linked sets share a prefix shingle, which occurs in
   two sets at least, so shingles of one set are only counted.
3. Groups. Sets with identical prefix and size are one group. Groups that share
   a prefix shingle are candidates; each shingle connects its groups through
   the smallest of them.
4. Verification. Members of connected groups are expanded and compared exactly,
   two bounded blocks in a task. Links leave a task as a spanning forest with
   the number of links of each set, so a large group of near copies is never
   written out as pairs. Work grows with the square of a connected candidate
   group over the size of a block.

Words end at ASCII white space and A-Z count as a-z. Sets hold 64-bit hashes of
shingles. A document of fewer than five words has its whole sequence as its one
shingle; one without words, or with a NULL or empty text, links with nothing.
Repeated rows are equal texts, so they link, and each keeps a row. Rows with a
NULL id link like others; a component's id is its smallest id that is not NULL.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voucherlens.llm.components import bloom, candidate_edges, components, in_blocks, may_hold, spanning
from voucherlens.llm.text import U64, mix, shingle_sets, signed, slices, table
from voucherlens.session import written

SHINGLE = 5
#: Similarity in hundredths.
SIMILAR = 75
#: Shingles that a task packs before it sends them on (12 bytes each).
PACK = 1 << 21
NO_ID = -(2**63)

_SCREEN = pa.schema([
    ("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()),
    ("credit", pa.int64()), ("shingles", pa.large_binary()), ("owners", pa.large_binary()),
])
_COUNTED = pa.schema([*list(_SCREEN)[1:5]])
_SETS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("shingles", pa.large_binary())])
_TOKENS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("shingle", pa.int64())])
_LINKS = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def set_key(shingles: np.ndarray) -> int:
    """Hash of a set; 0 is kept for no set."""
    sums = np.array([mix(shingles).sum(dtype=U64), mix(shingles ^ U64(0x5555)).sum(dtype=U64)], U64)
    sums = mix(sums + U64(len(shingles)))
    return int(mix(sums[:1] ^ (sums[1:] >> U64(1)))[0] | U64(1))


def lowest(n: int) -> int:
    """How many of a set's lowest shingles the screen looks at: over 2n/5."""
    return 2 * n // 5 + 1


def screened(n: Column) -> Column:
    """How many of them must occur in other sets: over 9n/80.

    Linked sets A and B share c >= 3/4 of the larger. The k lowest shared ones
    lie within the lowest n - c + k of each, so with 2n/5 looked at, k is over
    2n/5 - n/4 = 3n/20 of the smaller set, which has 3/4 of the larger's size.
    """
    return F.floor(n * 9 / 80) + 1


def _pack(sets: dict[int, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Screened shingles of some sets by bucket, and what they already show."""
    keys = np.fromiter(sets, np.uint64, len(sets))
    low = [s[: lowest(len(s))] for s in sets.values()]
    shingle, owner = np.concatenate(low), np.repeat(np.arange(len(low)), [len(s) for s in low])
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    same = shingle[1:] == shingle[:-1]
    repeats = np.r_[False, same] | np.r_[same, False]
    credit = np.bincount(owner[repeats], minlength=len(low))
    known = np.flatnonzero(credit)
    if len(known):
        yield _rows(bucket=keys[known] % U64(buckets), key=signed(keys[known]), credit=credit[known])
    # One entry for a shingle of several sets here, without an owner.
    first = np.r_[True, ~same]
    shingle, entry = shingle[first], np.where(repeats[first], U64(0), keys[owner[first]])
    bucket = ((shingle & U64(0xFFFF)) * U64(buckets) >> U64(16)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    rest = (shingle[order] >> U64(16)).astype(np.uint32)
    entry, at = entry[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(at))
    yield _rows(
        bucket=full,
        shingles=[rest[at[b] : at[b + 1]].tobytes() for b in full],
        owners=[entry[at[b] : at[b + 1]].tobytes() for b in full],
    )


def _rows(**columns) -> pa.RecordBatch:
    count = len(columns["bucket"])
    columns["bucket"] = np.asarray(columns["bucket"]).astype(np.int32)
    return table(_SCREEN, **{f.name: pa.nulls(count, f.type) for f in _SCREEN} | columns)


def _screen_map(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for rows, data, at in slices(batches):
            sets = shingle_sets(data, at, SHINGLE)
            keys = [set_key(s) if len(s) else 0 for s in sets]
            key = np.array(keys, U64)
            yield _rows(
                bucket=key % U64(buckets), doc_id=rows.column("doc_id"), key=signed(key),
                n=np.array([len(s) for s in sets], np.int64),
            )
            for k, s in zip(keys, sets, strict=True):
                if k and k not in held:
                    held[k] = s
                    size += len(s)
            if size >= PACK:
                yield from _pack(held, buckets)
                held, size = {}, 0
        if held:
            yield from _pack(held, buckets)

    return run


def _screen_reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as they are; a credit for each shingle a set shares with others."""
    shingle, owner = [], []
    for rows in batches:
        packed = rows.column("shingles").is_valid().to_numpy(zero_copy_only=False)
        plain = rows.filter(pa.array(~packed))
        if plain.num_rows:
            yield table(_COUNTED, **{n: plain.column(n) for n in _COUNTED.names})
        for i in np.flatnonzero(packed).tolist():
            rest = np.frombuffer(rows.column("shingles")[i].as_buffer(), np.uint32).astype(U64)
            shingle.append(rest | U64(rows.column("bucket")[i].as_py()) << U64(32))
            owner.append(np.frombuffer(rows.column("owners")[i].as_buffer(), U64))
    if not shingle:
        return
    shingle, owner = np.concatenate(shingle), np.concatenate(owner)
    order = np.lexsort((owner, shingle))
    shingle, owner = shingle[order], owner[order]
    distinct = np.r_[True, (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])]
    shingle, owner = shingle[distinct], owner[distinct]
    new = np.r_[True, shingle[1:] != shingle[:-1]]
    run = np.cumsum(new) - 1
    sets = np.bincount(run, 1 + (owner == 0))
    credited = owner[(sets[run] >= 2) & (owner != 0)]
    keys, credit = np.unique(credited, return_counts=True)
    if len(keys):
        none = pa.nulls(len(keys), pa.int64())
        yield table(_COUNTED, doc_id=none, n=none, key=signed(keys), credit=credit)


def _verify(rows: pa.Table) -> pa.Table:
    """Links between the sets of two blocks, or within one, as a spanning forest."""
    rows = rows.combine_chunks()
    key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    copies, block = rows.column("copies").to_numpy(), rows.column("block").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), U64) for x in rows.column("shingles")]
    one_block = rows.column("left_block")[0].as_py() == rows.column("right_block")[0].as_py()
    shared = np.zeros((len(sets), len(sets)), np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[place] >= 2
    owner, place = owner[often], (np.cumsum(count >= 2) - 1)[place[often]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = 8192
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, (first, first + width))
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:b], place[a:b] - first] = 1
        shared += (held @ held.T).astype(np.int64)
    union = n[:, None] + n[None, :] - shared
    linked = 100 * shared >= SIMILAR * union
    np.fill_diagonal(linked, False)
    if not one_block:
        linked &= block[:, None] != block[None, :]
    root = spanning(linked)
    links = linked @ copies
    found = np.flatnonzero(links)
    return pa.Table.from_batches([table(_LINKS, key=key[found], other=key[root[found]], links=links[found])])


def screen(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document with the size and key of its set; sets, with whether they may link."""
    buckets = min(1 << 16, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = docs.mapInArrow(
        _screen_map(buckets),
        "bucket int, doc_id long, n long, key long, credit long, shingles binary, owners binary",
    )
    counted = sent.repartition(buckets, "bucket").mapInArrow(
        _screen_reduce, "doc_id long, n long, key long, credit long"
    )
    counted = written(counted, "screened")
    documents = counted.where("n is not null").select("doc_id", "n", "key")
    sets = counted.where("key != 0").groupBy("key").agg(
        F.max("n").alias("n"), F.count("n").alias("copies"), F.sum("credit").alias("credit"),
        F.min(F.when(F.col("n").isNotNull(), F.coalesce("doc_id", F.lit(NO_ID)))).alias("first_id"),
        F.min("doc_id").alias("smallest_id"),
    )
    passed = F.coalesce("credit", F.lit(0)) >= screened(F.col("n"))
    return documents, written(sets.select("key", "n", "copies", "first_id", "smallest_id", passed.alias("passed")), "sets")


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingles of the wanted sets, from the document that comes first with each."""
    filled = docs.sparkSession.sparkContext.broadcast(bloom(wanted, "first_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> Iterator[pa.RecordBatch]:
            for rows in batches:
                yield rows.filter(pa.array(may_hold(filled.value, rows.column("doc_id").to_numpy())))

        for rows, data, at in slices(kept()):
            sets = shingle_sets(data, at, SHINGLE)
            keys = np.array([set_key(s) if len(s) else 0 for s in sets], U64)
            yield table(
                _SETS, doc_id=rows.column("doc_id"), key=signed(keys),
                n=[len(s) for s in sets], shingles=[s.tobytes() for s in sets],
            )

    named = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    found = named.mapInArrow(run, "doc_id long, key long, n long, shingles binary")
    first = wanted.select("key", "copies", F.col("first_id").alias("doc_id"))
    return written(found.join(first, ["key", "doc_id"]).dropDuplicates(["key"]).drop("doc_id"), "whole-sets")


def _prefixes(sets: DataFrame) -> DataFrame:
    """(key, n, group, shingle): shingles of the prefix that other sets have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                own = np.frombuffer(rows.column("shingles")[i].as_buffer(), np.int64)
                size = len(own)
                yield table(_TOKENS, key=np.full(size, rows.column("key")[i].as_py()), n=np.full(size, size), shingle=own)

    tokens = sets.select("key", "shingles").mapInArrow(run, "key long, n long, shingle long")
    counts = tokens.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1")
    shared = tokens.join(written(counts, "shingle-counts"), "shingle")
    of_set = Window.partitionBy("key")
    ranked = shared.withColumns({
        "alone": F.col("n") - F.count("*").over(of_set),
        "rank": F.row_number().over(of_set.orderBy("sets", "shingle")),
    })
    # The prefix has n - c + 1 shingles, where c is the least overlap of a linked set.
    length = F.col("n") - F.ceil(F.col("n") * SIMILAR / 100) + 1
    prefix = ranked.where(F.col("rank") <= length - F.col("alone"))
    content = [F.bit_xor(F.xxhash64(F.lit(i), "shingle")).over(of_set) for i in (1, 2)]
    group = F.when(F.col("alone") == 0, F.xxhash64("n", *content)).otherwise(F.col("key"))
    return prefix.select("key", "n", group.alias("group"), "shingle")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document."""
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    by_document, sets = screen(docs)
    wanted = sets.where("passed")
    whole = _whole_sets(docs, wanted)
    prefixes = written(_prefixes(whole), "prefixes")
    near = components(candidate_edges(prefixes.select("group", "shingle").distinct(), "shingle", "group"))
    members = prefixes.select("key", "n", "group").distinct().join(near, F.col("group") == F.col("node"), "left")
    members = members.select("key", F.coalesce("component", "group").alias("component"), F.col("n").alias("weight"))
    blocks = in_blocks(written(members, "members"))
    found = whole.join(blocks, "key").groupBy("component", "left_block", "right_block").applyInArrow(
        _verify, "key long, other long, links long"
    )
    found = written(found, "links")
    classes = components(found.select(F.col("key").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    of_set = sets.join(classes.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    of_set = written(of_set.select(
        "key", F.coalesce("component", "key").alias("class"), "smallest_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    ), "classes")
    ids = of_set.groupBy("class").agg(F.min("smallest_id").alias("component_id"))
    of_set = written(of_set.join(ids, "class").select("key", "component_id", "n_links"), "classes")
    joined = by_document.join(of_set, "key", "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("key") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
