"""Find keys that hold too many rows for one task, and join around them.

A random sample of the key columns tells which keys are hot: it is as large as it
must be for a key of ``min_rows`` rows to occur ``HITS`` times, so it is a small
part of a large table and all of a small one. Its counts combine within tasks
before they are merged, so no task merges more than its share of the keys,
whatever the number of tasks. The sample only decides how rows are dealt; no row
is left out of any result because of it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from voucherlens.columns import COUPON, RECEIVED
from voucherlens.session import written

# A limit below this share of the rows is not accepted, so that the driver's list
# of hot keys has at most this many entries, however large the table. A key just
# below it holds 1e7 of 1e12 rows: about a GB, which one task can take.
MAX_HOT_KEYS = 100_000
# Occurrences in the sample that a key of the limit's size is expected to have.
# From half of them on it counts as hot: a key of the limit's size is missed with
# a probability of about 1e-5, one of twice its size never.
HITS = 64

# Keys in which a missing value is a value like others.
NULLABLE = {COUPON, RECEIVED}


def key_hash(keys: Iterable[str]) -> Column:
    """Hash of a key that is the same for int and bigint columns."""
    return F.xxhash64(*[F.col(k).cast("string") for k in keys])


@dataclass(frozen=True)
class HotRule:
    """A key is hot when it holds over ``min_rows`` rows, a task's worth, and over ``share`` of them."""

    share: float = 1 / MAX_HOT_KEYS
    min_rows: int = 1_000_000

    def __post_init__(self) -> None:
        if self.share < 1 / MAX_HOT_KEYS:
            raise ValueError(f"share must be at least 1/{MAX_HOT_KEYS}, so that the list of hot keys stays small")

    def sampled(self) -> float:
        """The part of all rows that is looked at."""
        return min(1.0, HITS / self.min_rows)

    def limit(self, rows: int) -> int:
        return max(self.min_rows, ceil(rows * self.share))


@dataclass(frozen=True)
class HotKeys:
    """Hashes of hot keys, grouped by the number of slices each is split into."""

    keys: tuple[str, ...]
    by_slices: dict[int, list[int]] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.by_slices)

    def contains(self) -> Column:
        """Whether a row's key is hot."""
        hashes = [h for group in self.by_slices.values() for h in group]
        return key_hash(self.keys).isin(hashes) if hashes else F.lit(False)

    def slices(self) -> Column:
        """Number of slices of a row's key; 1 unless it is hot."""
        count = F.lit(1)
        for slices, hashes in self.by_slices.items():
            count = F.when(key_hash(self.keys).isin(hashes), slices).otherwise(count)
        return count


def find_hot_keys(
    df: DataFrame, key_sets: dict[str, list[str]], rule: HotRule = HotRule()
) -> dict[str, HotKeys]:
    """Hot keys of every key set, in one pass over the key columns."""
    part = rule.sampled()
    hashes = [F.struct(F.lit(name).alias("name"), key_hash(keys).alias("item")) for name, keys in key_sets.items()]
    sample = df if part == 1 else df.where(F.rand(17) < part)
    keys = sample.select(F.explode(F.array(*hashes)).alias("key"))
    counts = written(keys.groupBy("key.name", "key.item").agg(F.count("*").alias("n")), "key-sample")
    # Every set has counted every row of the sample once. Only hot keys leave the executors.
    limits = {r["name"]: rule.limit(int(r["rows"] / part)) for r in counts.groupBy("name").agg(F.sum("n").alias("rows")).collect()}
    is_hot = F.lit(False)
    for name, limit in limits.items():
        is_hot = is_hot | ((F.col("name") == name) & (F.col("n") > limit * part * (1 if part == 1 else 0.5)))
    by_slices: dict[str, dict[int, list[int]]] = {name: {} for name in key_sets}
    for row in counts.where(is_hot).collect():
        pieces = max(2, ceil(row["n"] / part / limits[row["name"]]))
        by_slices[row["name"]].setdefault(1 << (pieces - 1).bit_length(), []).append(row["item"])
    return {name: HotKeys(tuple(keys), by_slices[name]) for name, keys in key_sets.items()}


def attach(left: DataFrame, right: DataFrame, hot: HotKeys) -> DataFrame:
    """Left join to a table with one row per key, splitting hot keys.

    The rows of a hot key are dealt into slices by a hash of the whole row, and
    its single right-hand row is repeated once per slice. ``left`` should hold
    no large group of identical rows, since those share a slice.
    """
    if not hot:
        return _left_join(left, right, list(hot.keys))
    sliced = left.withColumn(
        "slice", F.pmod(F.xxhash64(*left.columns), hot.slices()).cast("int")
    )
    repeated = right.withColumn("slice", F.explode(F.sequence(F.lit(0), hot.slices() - 1)))
    return _left_join(sliced, repeated, [*hot.keys, "slice"]).drop("slice")


def _left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that keeps the left key columns; missing coupons and days match each other."""
    if not NULLABLE & set(keys):
        return left.join(right, keys, "left")
    renamed = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        ours, theirs = left[key], renamed[f"right_{key}"]
        equal = ours.eqNullSafe(theirs) if key in NULLABLE else ours == theirs
        condition = condition & equal
    return left.join(renamed, condition, "left").drop(*[f"right_{k}" for k in keys])
