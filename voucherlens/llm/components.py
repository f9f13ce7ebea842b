"""Connected components, and exact checks of all pairs within candidate groups.

Both keep their tables in the shared folder between steps, so a lost executor
costs the tasks it ran and nothing else. Keys are 64-bit.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from voucherlens.llm.text import U64, mix, signed, table
from voucherlens.session import written

#: Members of a block, and their weight together; a task checks two blocks.
BLOCK_MEMBERS = 256
BLOCK_WEIGHT = 2_000_000

BLOOM_BITS = 26
PROBES = 4


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of rounds whose results are stored.

    It does so when nothing refers to a round's plan, so callers drop it first.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes that are not it.

    ``edges`` has ``a`` and ``b``. Every node hooks to its smallest smaller
    neighbour, pointers are followed to the roots, edges move to the roots, and
    so on until none is left. A round leaves at most half of the nodes, and
    pointers double in reach with each step. A node with very many edges is
    combined before its shuffle in one step, and in the other is a join that
    Spark can split.
    """
    live = written(_ordered(edges), "edges")
    found = None
    while not live.isEmpty():
        parent = written(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "roots")
        moved = True
        while moved:
            above = parent.select(F.col("node").alias("via"), F.col("root").alias("next"))
            step = parent.join(above, F.col("root") == F.col("via"), "left")
            parent = written(
                step.select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                "roots",
            )
            moved = not parent.where("moved").isEmpty()
        parent = parent.select("node", "root")
        live = written(_ordered(_moved(_moved(live, parent, "a"), parent, "b")), "edges")
        found = parent if found is None else _moved(found, parent, "root").unionByName(parent)
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return found.select("node", F.col("root").alias("component"))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _moved(rows: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """Each key of a column replaced by its root, if it has one."""
    to = parent.select(F.col("node").alias("moved_from"), F.col("root").alias("moved_to"))
    joined = rows.join(to, F.col(column) == F.col("moved_from"), "left")
    return joined.withColumn(column, F.coalesce("moved_to", column)).drop("moved_from", "moved_to")


def candidate_edges(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Edges (a, b) that connect all members of a key through its smallest.

    A key with very many members gives one edge for each, never its pairs.
    """
    leaders = rows.groupBy(key).agg(F.min(member).alias("a"), F.max(member).alias("last"))
    leaders = written(leaders.where(F.col("a") != F.col("last")).select(key, "a"), "leaders")
    return rows.join(leaders, key).select("a", F.col(member).alias("b")).where("a != b").distinct()


def in_blocks(members: DataFrame) -> DataFrame:
    """Members of a candidate group, once for each pair of blocks they are checked in.

    ``members`` has ``key``, ``component`` and ``weight``. A group is dealt into
    blocks by key, and every two blocks of it (a block with itself included)
    meet in one task, so memory is bounded however large the group is. Groups
    of one member are left out.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("w") / BLOCK_WEIGHT)).cast("int")
    sizes = written(sizes.where("n > 1").select("component", blocks.alias("blocks")), "group-sizes")
    dealt = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("key", "component", "block", other.alias("other"))
    return dealt.select(
        "key", "component", "block",
        F.least("block", "other").alias("left_block"), F.greatest("block", "other").alias("right_block"),
    )


def spanning(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the smallest index each row is connected to."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _positions(keys: np.ndarray) -> np.ndarray:
    h = mix(keys.view(U64) + U64(5))
    first, step = h & U64(0xFFFFFFFF), (h >> U64(32)) | U64(1)
    probes = first[None, :] + step[None, :] * np.arange(PROBES, dtype=U64)[:, None]
    return (mix(probes) >> U64(64 - BLOOM_BITS)).astype(np.int64)


def bloom(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of fixed size (8 MB), built by the tasks and joined word by word.

    It only spares the shuffle of rows that a later join would drop: when it is
    crowded more rows pass, never fewer.
    """
    schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = np.unique(_positions(rows.column(0).to_numpy()).ravel())
            word, first = np.unique(at >> 6, return_index=True)
            bits = U64(1) << (at & 63).astype(U64)
            joined = np.bitwise_or.reduceat(bits, first) if len(at) else bits
            yield table(schema, word=word, bits=signed(joined))

    words = keys.select(F.col(column).cast("long")).mapInArrow(run, "word long, bits long")
    rows = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(1 << (BLOOM_BITS - 6), U64)
    filled[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(U64)
    return filled


def may_hold(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _positions(np.ascontiguousarray(keys))
    return ((filled[at >> 6] >> (at & 63).astype(U64)) & U64(1)).all(axis=0)
