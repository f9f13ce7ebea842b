"""Trie of conversation prefixes, with totals of every subtree.

A node of depth d is a distinct sequence of d first turns (role and text).

1. Turns become digests, numbered within conversations by one range sort; a
   conversation that spans partitions is joined up by offsets, one a partition.
2. Van Emde Boas recursion over depth, all tries of a level side by side: a range
   of depths is cut in half, and the prefix at the cut is named by the name above
   it and the digest of the turns between. With that name the upper trie and the
   lower forest no longer depend on each other, so both halves are cut at the next
   level at once. Ranges of ``BLOCK`` depths are built directly, turn after turn.
   Depth d takes log2(d / BLOCK) levels.
3. Rows of equal (depth, name) are a node; they are combined before their shuffle.
   The smallest member owns a node, and every conversation owns a run of depths
   down to its last turn.
4. Totals are grafted upward by the same cuts: what a lower half owns is added to
   the upper half, which gives every owned node the total below it on its
   conversation. What a conversation owns in all then counts for the nodes above
   that others own.

A conversation that holds a third of all turns is spread by its blocks, a node
that a third of all conversations pass by combining them, a node with very many
children by slices, and the list of conversations ending at one node is sorted by
ranges and hashed as a stream.

NULL roles and texts are empty. Turns are ordered by number, NULL first, then by
digest; repeated turns each count. A NULL conversation id names no conversation,
so its turns are left out. An empty table gives an empty result. Digests have 128
bits of SHA-256. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from voucherlens.llm.text import table
from voucherlens.session import written

#: Depths that are built directly.
BLOCK = 64
#: Slices of one conversation, and of the children of one node, in joins.
SLICES = 16
ROOT = bytes(16)
NODE = ["depth", "high", "low"]

_NUMBERED = pa.schema([
    ("part", pa.int32()), ("conv_id", pa.int64()), ("local", pa.int64()), ("digest", pa.binary()), ("chars", pa.int64()),
])
_ROWS = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("high", pa.int64()), ("low", pa.int64()),
    ("parent_high", pa.int64()), ("parent_low", pa.int64()), ("chars", pa.int64()), ("member", pa.int64()), ("ends", pa.int64()),
])
_CHUNKS = pa.schema([
    ("depth", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("first", pa.int64()), ("ids", pa.large_string()),
])
_ENDS = pa.schema([("depth", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("ends_sha256", pa.string())])


def _short_sha(value: Column) -> Column:
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def _child_name(name: bytes, digest: bytes) -> bytes:
    return hashlib.sha256(name + digest).digest()[:16]


# --- numbering ---------------------------------------------------------------


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of turns among those of their conversation in a sorted partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for rows in batches:
        conv = rows.column("conv_id").to_numpy()
        if not len(conv):
            continue
        change = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        local = np.arange(len(conv)) - np.repeat(change, np.diff(np.r_[change, len(conv)]))
        if conv[0] == last:
            local[: change[1] if len(change) > 1 else len(conv)] += seen
        last, seen = conv[-1], local[-1] + 1
        yield table(
            _NUMBERED, part=np.full(len(conv), part, np.int32), conv_id=conv, local=local,
            digest=rows.column("digest").cast(pa.binary()), chars=rows.column("chars").to_numpy(),
        )


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, place, digest, chars), places from 1; and (conv_id, n)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), "turn", _short_sha(said).alias("digest"), F.length(text).cast("long").alias("chars")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    local = written(dealt.mapInArrow(_number, "part int, conv_id long, local long, digest binary, chars long"), "local-turns")
    pieces = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    # A conversation has at most one piece in a partition, so these windows are short.
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = written(pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "turn-pieces")
    # Only the first conversation of a partition can go on from an earlier one.
    moved = pieces.where("before > 0").select("conv_id", "part", "before")
    turns = local.join(F.broadcast(moved), ["conv_id", "part"], "left")
    place = F.col("local") + F.coalesce("before", F.lit(0)) + 1
    return turns.select("conv_id", place.alias("place"), "digest", "chars"), pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))


# --- blocks of turns ---------------------------------------------------------


def _block_of(depth: str) -> Column:
    """The block whose rows hold a node; the root belongs to the first."""
    return F.expr(f"CAST(greatest({depth} - 1, 0) DIV {BLOCK} AS LONG)")


def _slices_of(n: str) -> Column:
    return F.sequence(F.lit(0), F.least(F.shiftright(n, 6), F.lit(SLICES - 1)).cast("int"))


def blocks_of(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, block, turns): up to ``BLOCK`` turns in order.

    A full block has a next one, be it empty, so the last one is never full.
    """
    placed = turns.select("conv_id", _block_of("place").alias("block"), F.struct("place", "digest", "chars").alias("said"))
    none = F.lit(None).cast(placed.schema["said"].dataType)
    last = lengths.select("conv_id", F.expr(f"CAST(length DIV {BLOCK} AS LONG)").alias("block"), none.alias("said"))
    listed = placed.unionByName(last).groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    return written(listed.select("conv_id", "block", F.transform("turns", lambda t: F.struct(t["digest"], t["chars"])).alias("turns")), "turn-blocks")


def plain_turns(conversations: DataFrame) -> DataFrame:
    """The blocks of conversations as they are."""
    turns, sizes = numbered_turns(conversations)
    return blocks_of(turns, sizes.withColumnRenamed("n", "length"))


def rebuilt_turns(conversations: DataFrame, heads: int = 6, family: int = 100) -> DataFrame:
    """Blocks of conversations whose first turns come from the first of their family.

    Of conversation c the first h turns are those of c - c % family (fewer if it
    has fewer), then c's own after its first h; h = crc32(c in decimal) % heads.
    """
    turns, sizes = numbered_turns(conversations)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    sizes = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("root"))
    roots = sizes.select(F.col("conv_id").alias("root"), F.col("n").alias("root_n"))
    head = F.least("h", F.coalesce("root_n", F.lit(0))).alias("head")
    convs = sizes.join(roots, "root", "left").select("conv_id", "n", "h", "root", head)
    convs = written(convs.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    first = turns.where(F.col("place") < heads).withColumnRenamed("conv_id", "root")
    taken = convs.select("conv_id", "root", "head").join(first, "root").where("place <= head")
    # Own turns look their shift up in slices, more than one for a long conversation only.
    shift = convs.where("n > h").select("conv_id", "h", "head", F.explode(_slices_of("n")).alias("slice"))
    sliced = turns.withColumn("slice", (F.shiftright("place", 6) % SLICES).cast("int"))
    own = sliced.join(shift, ["conv_id", "slice"]).where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("head"))
    wanted = ["conv_id", "place", "digest", "chars"]
    return blocks_of(taken.select(*wanted).unionByName(own.select(*wanted)), convs.select("conv_id", "length"))


# --- names -------------------------------------------------------------------


def _levels(rows: DataFrame, column: str) -> int:
    most = rows.agg(F.max(column)).first()[0]
    return int(most or 0).bit_length()


def cut_names(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, start): the name of the prefix before every block but the first.

    Going up, digests of ranges twice as long; going down, each range is cut in
    half and the lower half's prefix named.
    """
    levels = _levels(blocks, "block")
    joined = F.aggregate("turns", F.lit(b""), lambda acc, t: F.concat(acc, t["digest"]))
    ranges = blocks.where(F.size("turns") == BLOCK).select("conv_id", F.col("block").alias("at"), _short_sha(joined).alias("digest"))
    cuts = []
    for _ in range(levels):
        half = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("digest")))
        pairs = ranges.groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(half(0).alias("left"), half(1).alias("right"))
        pairs = written(pairs, "range-digests")
        cuts.append(pairs.where(F.col("left").isNotNull()).select("conv_id", "at", "left"))
        ranges = pairs.where("left IS NOT NULL AND right IS NOT NULL").select(
            "conv_id", "at", _short_sha(F.concat("left", "right")).alias("digest")
        )
    long = blocks.where("block > 0").select("conv_id").distinct()
    starts = long.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(ROOT).alias("start"))
    for pairs in reversed(cuts):
        cut = starts.join(pairs, ["conv_id", "at"], "left")
        upper = F.struct((F.col("at") * 2).alias("at"), F.col("start"))
        lower = F.struct((F.col("at") * 2 + 1).alias("at"), _short_sha(F.concat("start", "left")).alias("start"))
        halves = F.when(F.col("left").isNotNull(), F.array(upper, lower)).otherwise(F.array(upper))
        starts = written(cut.select("conv_id", F.explode(halves).alias("half")).select("conv_id", "half.*"), "range-names")
    return starts.where("at > 0").select("conv_id", F.col("at").alias("block"), "start")


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that each block passes, named turn after turn."""
    for rows in batches:
        numbers, names = [], []
        columns = [rows.column(c).to_pylist() for c in ("conv_id", "block", "turns", "start", "next")]
        for conv, block, turns, name, following in zip(*columns):
            depth = block * BLOCK
            if block == 0:
                numbers.append((conv, 0, 0, 1, int(not turns)))
                names += name, name
            elif not turns:  # it ends where the block before it does
                numbers.append((conv, depth, 0, 0, 1))
                names += name, name
            for i, turn in enumerate(turns, 1):
                child = following if i == BLOCK else _child_name(name, turn["digest"])
                numbers.append((conv, depth + i, turn["chars"], 1, int(i == len(turns) < BLOCK)))
                names += child, name
                name = child
        if numbers:
            conv, depth, chars, member, ends = np.array(numbers, np.int64).T
            high, low, parent_high, parent_low = np.frombuffer(b"".join(names), ">i8").astype(np.int64).reshape(-1, 4).T
            yield table(
                _ROWS, conv_id=conv, depth=depth, high=high, low=low, parent_high=parent_high, parent_low=parent_low,
                chars=chars, member=member, ends=ends,
            )


def node_rows(blocks: DataFrame) -> DataFrame:
    """One row for each conversation and each node it passes."""
    starts = cut_names(blocks)
    following = starts.select("conv_id", (F.col("block") - 1).alias("block"), F.col("start").alias("next"))
    named = blocks.join(starts, ["conv_id", "block"], "left").join(following, ["conv_id", "block"], "left")
    named = named.select("conv_id", "block", "turns", F.coalesce("start", F.lit(ROOT)).alias("start"), "next")
    return written(named.mapInArrow(
        _node_rows,
        "conv_id long, depth long, high long, low long, parent_high long, parent_low long, chars long, member long, ends long",
    ), "trie-rows")


# --- totals ------------------------------------------------------------------


def _totals_after(owned: DataFrame) -> DataFrame:
    """(conv_id, block, after_leaves, after_saved): sums over the later blocks of a conversation."""
    sums = ["leaves", "saved"]
    ranges = [written(owned.groupBy("conv_id", F.col("block").alias("at")).agg(*[F.sum(c).alias(c) for c in sums]), "range-totals")]
    for _ in range(_levels(ranges[0], "at")):
        lower = [F.sum(F.when(F.col("at") % 2 == 1, F.col(c)).otherwise(0)).alias(f"lower_{c}") for c in sums]
        pairs = ranges[-1].groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(*[F.sum(c).alias(c) for c in sums], *lower)
        ranges.append(written(pairs, "range-totals"))
    after = ranges[-1].select("conv_id", "at", *[F.lit(0).cast("long").alias(f"after_{c}") for c in sums])
    for below, above in zip(reversed(ranges[:-1]), reversed(ranges[1:])):
        known = after.join(above.select("conv_id", "at", *[f"lower_{c}" for c in sums]), ["conv_id", "at"])
        known = known.withColumnRenamed("at", "above")
        halves = below.select("conv_id", "at", F.shiftright("at", 1).alias("above")).join(known, ["conv_id", "above"])
        graft = lambda c: F.col(f"after_{c}") + F.when(F.col("at") % 2 == 0, F.col(f"lower_{c}")).otherwise(0)
        after = written(halves.select("conv_id", "at", *[graft(c).alias(f"after_{c}") for c in sums]), "grafted-totals")
    return after.withColumnRenamed("at", "block")


def subtree_totals(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, high, low, n_leaves, saved_tokens) of every node."""
    owned = nodes.select(*NODE, "conv_id", "leaves", "saved", _block_of("depth").alias("block"))
    down = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc())
    below = owned.join(_totals_after(owned), ["conv_id", "block"]).select(
        *NODE, *[(F.sum(c).over(down) + F.col(f"after_{c}")).alias(c) for c in ("leaves", "saved")]
    )
    whole = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    reached = whole.where("top > 0").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(top - 2, 0) DIV {BLOCK}"))).alias("block")
    )
    passed = rows.where("member = 1").select("conv_id", *NODE, _block_of("depth").alias("block"))
    above = passed.join(reached, ["conv_id", "block"]).where("depth < top").select(*NODE, "leaves", "saved")
    return below.unionByName(above).groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _parents(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id) of the nodes whose parent another conversation owns."""
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth"))
    tops = nodes.join(tops, ["conv_id", "depth"]).where("depth > 0").select(
        "conv_id", "depth", (F.col("depth") - 1).alias("_depth"), F.col("parent_high").alias("_high"),
        F.col("parent_low").alias("_low"), F.pmod(F.xxhash64("conv_id"), F.lit(SLICES)).cast("int").alias("slice"),
    )
    tops = written(tops, "owned-tops")
    key = ["_depth", "_high", "_low"]
    parents = nodes.select(*[F.col(n).alias(k) for n, k in zip(NODE, key)], F.col("conv_id").alias("parent_conv_id"))
    parents = tops.select(*key).distinct().join(parents, key)
    parents = parents.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return tops.join(parents, [*key, "slice"]).select("conv_id", "depth", "parent_conv_id")


# --- conversations that end at a node ----------------------------------------


def _runs(rows: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], int, int]]:
    """Nodes of a sorted batch, and where their rows begin and end."""
    columns = [rows.column(c).to_numpy() for c in NODE]
    change = np.zeros(rows.num_rows, bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(change)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), rows.num_rows]):
        yield tuple(int(c[a]) for c in columns), a, b


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        conv, out = rows.column("conv_id").to_pylist(), []
        for node, a, b in _runs(rows):
            out.append((*node, conv[a], ",".join(map(str, conv[a:b]))))
        if out:
            yield table(_CHUNKS, **dict(zip(_CHUNKS.names, zip(*out))))


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the chunks of each node as they come, joined by commas."""
    node, state, out = None, None, []
    for rows in batches:
        ids = rows.column("ids").to_pylist()
        for found, a, b in _runs(rows):
            if found != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = found, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(ids[a:b]).encode())
        if out:
            yield table(_ENDS, **dict(zip(_ENDS.names, zip(*out))))
            out = []
    if node is not None:
        yield table(_ENDS, **dict(zip(_ENDS.names, zip((*node, state.hexdigest())))))


def ends(rows: DataFrame) -> DataFrame:
    """(depth, high, low, ends_sha256) of nodes at which conversations end."""
    ended = rows.where("ends = 1").select(*NODE, "conv_id")
    order = [*NODE, "conv_id"]
    chunks = ended.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _chunks, "depth long, high long, low long, first long, ids string"
    )
    chunks = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return chunks.mapInArrow(_hash_chunks, "depth long, high long, low long, ends_sha256 string")


def trie(blocks: DataFrame) -> DataFrame:
    """One row for each node of the trie over blocks of turns."""
    rows = node_rows(blocks)
    nodes = rows.groupBy(*NODE).agg(
        F.min(F.when(F.col("member") == 1, F.col("conv_id"))).alias("conv_id"),
        F.sum("member").alias("n_convs"),
        F.max(F.when(F.col("member") == 1, F.col("chars"))).alias("chars"),
        *[F.max(F.when(F.col("member") == 1, F.col(c))).alias(c) for c in ("parent_high", "parent_low")],
    )
    nodes = written(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("parent_high").alias("high"), F.col("parent_low").alias("low")
    ).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    nodes = written(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "counted-nodes")
    found = nodes.join(subtree_totals(rows, nodes), NODE).join(ends(rows), NODE, "left")
    found = found.join(_parents(nodes), ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    none = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return found.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        none.alias("ends_sha256"),
    )
