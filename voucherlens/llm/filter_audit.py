"""How five text filters overlap, by part of the corpus, in every order of applying them.

Four filters look at a text alone; the fifth, ``E``, fails a text that a document
with a smaller id has too.

1. Counting-Bloom prepass. Every text adds one to ``PROBES`` cells, chosen by its
   hash; the sketches of all tasks are merged by adding their cells. A text one of
   whose cells counts one is guaranteed unique. Only the places of cells that
   count two or more are sent on, as bits, so what is broadcast is at most
   ``2 ** MAX_CELL_BITS`` bits (32 MB). The number of cells grows with the number
   of texts up to there; a more crowded sketch lets more unique texts through,
   which costs their shuffle and changes no result.
2. One scan computes the other filters and keeps the text of possible repeats only.
   Possible repeats are shuffled for the smallest id of each full text; texts that
   very many documents share are combined before the shuffle.
3. A row is now its id, part and mask of failed filters. Rows of one id are combined,
   labels joined, and counts by (part, mask, labels) are all that is kept: at most 32
   masks a part. Every figure of every order is a sum of these.

NULL texts are empty, NULL parts the empty part. A NULL id comes after all others:
such a row fails ``E`` if a row with an id has its text, and rows with equal ids do
not fail each other. A repeated row counts as often as it occurs. Several labels of
one id count as 1 if any is 1; labels without an id are not used. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import ceil, factorial, log2

from pyspark.sql import Column, DataFrame, functions as F

from voucherlens.session import written

# Fixed values of the contract.
FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
LEAST_WORDS = 50
DISTINCT_PERCENT, CAPITAL_PERCENT = 65, 5
WORD_GAP = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"

#: Cells of a text that it has to itself on average, cells that it adds to, and bounds of their number.
CELLS_PER_TEXT, PROBES = 16, 2
MIN_CELL_BITS, MAX_CELL_BITS = 16, 28


def _bit(name: str, fails: Column) -> Column:
    return F.when(fails, BIT[name]).otherwise(0)


def own_mask(text: Column, words: Column) -> Column:
    """The failed filters among those that look at a text alone."""
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return (
        _bit("A", count < LEAST_WORDS)
        + _bit("B", 100 * distinct.cast("long") < DISTINCT_PERCENT * count.cast("long"))
        + _bit("C", 100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"))
        + _bit("D", text.rlike(MARKS))
    ).cast("int")


def _cells(digest: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(digest, F.lit(k)), 64 - bits) for k in range(PROBES)]


def cell_bits(texts: int) -> int:
    return min(MAX_CELL_BITS, max(MIN_CELL_BITS, ceil(log2(max(texts, 1) * CELLS_PER_TEXT))))


def crowded_cells(digests: DataFrame, digest: str, bits: int) -> DataFrame:
    """(word, bits): the cells that count two or more, 64 in a word."""
    cells = digests.select(F.explode(F.array(*_cells(F.col(digest), bits))).alias("cell"))
    counted = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    place = F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")
    words = counted.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(place).alias("bits"))
    return written(words, "crowded-cells")


def _with_possible(rows: DataFrame, digest: str, words: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``possible``: whether all cells of a text count two or more."""
    for k, cell in enumerate(_cells(F.col(digest), bits)):
        rows = rows.withColumn(f"_cell_{k}", cell)
    for k in range(PROBES):
        side = words.select(F.col("word").alias(f"_word_{k}"), F.col("bits").alias(f"_bits_{k}"))
        rows = rows.join(F.broadcast(side), F.shiftright(f"_cell_{k}", 6) == F.col(f"_word_{k}"), "left")
    held = [F.expr(f"coalesce(shiftrightunsigned(_bits_{k}, CAST(_cell_{k} & 63 AS INT)) & 1, 0) = 1") for k in range(PROBES)]
    possible = held[0]
    for one in held[1:]:
        possible = possible & one
    return rows.withColumn("possible", possible)


def failed_masks(documents: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): rows of equal id and part by the filters they fail."""
    texts = documents.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    bits = cell_bits(documents.count())
    words = crowded_cells(texts.select(F.xxhash64("text").alias("digest")), "digest", bits)
    split = F.array_remove(F.split("text", WORD_GAP), "")
    rows = texts.withColumn("mask", own_mask(F.col("text"), split)).withColumn("digest", F.xxhash64("text"))
    rows = _with_possible(rows, "digest", words, bits)
    kept = F.when(F.col("possible"), F.col("text")).alias("text")
    rows = written(rows.select("doc_id", "part", "mask", kept), "filter-flags")

    alone = rows.where(F.col("text").isNull()).select("doc_id", "part", "mask", F.lit(1).cast("long").alias("n"))
    repeats = rows.where(F.col("text").isNotNull())
    first = repeats.groupBy(F.col("text").alias("first_text")).agg(F.min("doc_id").alias("first_id"))
    # One row for each id and text, so that no key of the join has many rows.
    repeats = repeats.groupBy("doc_id", "part", "mask", "text").agg(F.count("*").alias("n"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text") == F.col("first_text"))
    found = repeats.join(first.withColumn("is_first", F.lit(True)), is_first, "left")
    mask = F.when(F.col("is_first"), F.col("mask")).otherwise(F.col("mask") + BIT["E"]).alias("mask")
    both = alone.unionByName(found.select("doc_id", "part", mask, "n"))
    return both.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive counts of documents, and of those with each label."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(
        one("quality").alias("is_good"), one("toxic").alias("is_toxic")
    )
    joined = masks.join(known, F.col("doc_id") == F.col("label_id"), "left")
    weighted = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), weighted("is_good").alias("good"), weighted("is_toxic").alias("toxic")
    )


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, filter's bit, mask of the filters before it) of all orders."""
    return [
        ("".join(order), i + 1, BIT[name], sum(BIT[b] for b in order[:i]))
        for order in permutations(FILTERS)
        for i, name in enumerate(order)
    ]


def interactions(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step, from counts by mask."""
    others = lambda name: [b for n, b in BIT.items() if n != name]
    # What a step does depends on its filter and the set of those before it: 80 pairs.
    pairs = [
        (BIT[name], sum(before)) for name in FILTERS for size in range(len(FILTERS)) for before in combinations(others(name), size)
    ]
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(p).alias("before")) for f, p in pairs]))
    rows = counts.select("*", pair.alias("pair")).select("*", "pair.filter", "pair.before")
    reached = F.col("mask").bitwiseAND(F.col("before")) == 0
    fails = F.col("mask").bitwiseAND(F.col("filter")) != 0
    total = lambda where, column="n": F.sum(F.when(where, F.col(column)).otherwise(0))
    done = rows.groupBy("part", "filter", "before").agg(
        total(reached & ~fails).alias("kept"),
        total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"),
        total(F.col("mask") == F.col("filter")).alias("unique_fails"),
        total(reached & fails, "good").alias("good_lost"),
        total(reached & fails, "toxic").alias("toxic_lost"),
    )
    # A set of k filters comes before a fifth in k! orders, followed by the others in (4 - k)!.
    size = F.bit_count("before")
    orders = F.lit(0)
    for k in range(len(FILTERS)):
        orders = F.when(size == k, factorial(k) * factorial(len(FILTERS) - 1 - k)).otherwise(orders)
    shapley = done.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    spark = counts.sparkSession
    order = spark.createDataFrame(steps(), "filter_order string, step int, filter int, before int")
    return (
        done.join(shapley, ["part", "filter"])
        .join(F.broadcast(order), ["filter", "before"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def audit(documents: DataFrame, labels: DataFrame, *, part: str = "source") -> DataFrame:
    """The whole report: parts times 120 orders times 5 steps."""
    return interactions(written(mask_counts(failed_masks(documents, part), labels), "mask-counts"))
