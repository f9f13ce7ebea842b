"""Exact order statistics for groups of any size: AUC and quantiles.

Both avoid sorting a whole group in one task. A double of any size or sign is cut
into digits that keep its order: sign, exponent and ``TOP_BITS`` bits of the
mantissa, then ``NEXT_BITS`` more. Scaling by a power of two and taking the floor
are exact for doubles, so equal values share all digits. Sums over digits are
then compared only among the siblings of one node, whose number is bounded, and
values that agree in both digits differ in the last 21 bits of the mantissa only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voucherlens.columns import COUPON, LABEL
from voucherlens.session import written

TOP_BITS, NEXT_BITS = 10, 21
#: Exponents are kept within these, so that their power of two is a double.
LEAST_EXPONENT, MOST_EXPONENT = -1000.0, 1023.0
DIGITS = ["digit_1", "digit_2"]


def _with_digits(df: DataFrame, value: Column) -> DataFrame:
    """Two leading digits of ``value``, which is neither NULL nor NaN."""
    size = F.abs(value)
    # The logarithm may miss by one near a power of two; it does not fall as the value grows.
    power = F.floor(F.greatest(F.least(F.log2(F.when(size > 0, size)), F.lit(MOST_EXPONENT)), F.lit(LEAST_EXPONENT)))
    power = F.coalesce(power, F.lit(0))
    scaled = value * F.pow(F.lit(2.0), TOP_BITS - F.col("power"))
    most = float(4 << TOP_BITS)  # reached by infinities only
    df = df.withColumn("power", power).withColumn("rest", F.greatest(F.least(scaled, F.lit(most)), F.lit(-most)))
    top = F.floor("rest")
    side = F.signum(value).cast("bigint") * (F.col("power") + 2000) * (8 << TOP_BITS)
    df = df.withColumn("digit_1", side + top)
    return df.withColumn("digit_2", F.floor((F.col("rest") - top) * float(1 << NEXT_BITS))).drop("power", "rest")


def _before(keys: list[str], order: str) -> Window:
    return (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def auc(
    scored: DataFrame, group: list[str], *, score: str = "score", label: str = LABEL
) -> DataFrame:
    """Area under the ROC curve per group; one-class groups are dropped.

    Equal to counting, over all pairs of a positive and a negative row, those
    ranked rightly, with ties as one half. Rows with equal score are combined
    first; pairs are then counted at the digit where their scores first
    differ, from the last digit to the first. Scores may be any doubles, raw
    margins as well as probabilities. Rows without a score (NULL or NaN) and
    rows whose label is neither 0 nor 1 are left out.
    """
    value = F.col(score).cast("double")
    known = scored.where(value.isNotNull() & ~F.isnan(value) & F.col(label).isin(0, 1))
    counts = known.groupBy(*group, value.alias("score")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("n_pos"),
        F.count(F.when(F.col(label) == 0, 1)).alias("n_neg"),
    )
    # Pair counts are doubles: products of row counts can pass the long range.
    n_pos, n_neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    nodes = _with_digits(counts, F.col("score")).withColumn("right", n_pos * n_neg * 0.5)
    path = [*DIGITS, "score"]
    for depth in reversed(range(len(path))):
        parent = [*group, *path[:depth]]
        lower = F.coalesce(F.sum("n_neg").over(_before(parent, path[depth])), F.lit(0))
        nodes = (
            nodes.withColumn("right", F.col("right") + n_pos * lower)
            .groupBy(*parent)
            .agg(
                F.sum("n_pos").alias("n_pos"),
                F.sum("n_neg").alias("n_neg"),
                F.sum("right").alias("right"),
            )
        )
    both = nodes.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    return both.select(*group, (F.col("right") / (n_pos * n_neg)).alias("auc"), "n_pos", "n_neg")


def coupon_auc(scored: DataFrame, *, score: str = "score", label: str = LABEL) -> DataFrame:
    """AUC per coupon."""
    return auc(scored, [COUPON], score=score, label=label)


def mean_coupon_auc(scored: DataFrame, *, score: str = "score", label: str = LABEL) -> DataFrame:
    """Unweighted mean of the coupon AUCs: the main quality number."""
    return coupon_auc(scored, score=score, label=label).agg(
        F.avg("auc").alias("mean_auc"), F.count("*").alias("coupons")
    )


def pooled_auc(scored: DataFrame, *, score: str = "score", label: str = LABEL) -> DataFrame:
    """AUC over all rows as one group."""
    return auc(scored, [], score=score, label=label)


def column_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of several columns: (column, share, value).

    All columns go down from the first digit to the value together: at each step
    the nodes that hold the wanted ranks are kept, so the broadcast side has at
    most two rows for each column and quantile. The table is read once; distinct
    values with their counts are written and read by all steps. NULL and NaN are
    left out; a column without values has none.
    """
    spark = df.sparkSession
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    values = df.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.*")
    values = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = values.groupBy("column", "value").agg(F.count("*").alias("n"))
    nodes = written(_with_digits(counts, F.col("value")), "value-counts")
    rows = {r["column"]: r["n"] for r in nodes.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    weights = [(c, float(q), r, w) for c, n in rows.items() for q in shares for r, w in _ranks(q, n).items()]
    ranks = sorted({(c, r, 0) for c, _, r, _ in weights})
    wanted = spark.createDataFrame(ranks, "column string, rank bigint, before bigint")
    path = ["column"]
    for step in [*DIGITS, "value"]:
        inside = nodes.join(F.broadcast(wanted.select(*path).distinct()), path)
        sums = inside.groupBy(*path, step).agg(F.sum("n").alias("n")).join(F.broadcast(wanted), path)
        lower = F.coalesce(F.sum("n").over(_before(["column", "rank"], step)), F.lit(0))
        start = F.col("before") + lower
        found = sums.withColumn("start", start).where("start <= rank AND rank < start + n")
        wanted = written(found.select(*path, "rank", F.col("start").alias("before"), step), "wanted-ranks")
        path.append(step)
    weighted = spark.createDataFrame(weights, "column string, share double, rank bigint, weight double")
    return (
        wanted.select("column", "rank", "value")
        .join(F.broadcast(weighted), ["column", "rank"])
        .groupBy("column", "share")
        .agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
    )


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Exact quantiles of one column over all rows: (share, value), NULL without values."""
    all_ = df.sparkSession.createDataFrame([(float(q),) for q in shares], "share double")
    return all_.join(column_quantiles(df, [column], shares).drop("column"), "share", "left")


def _ranks(share: float, rows: int) -> dict[int, float]:
    """Zero-based ranks around a quantile and their weights."""
    position = share * (rows - 1)
    floor = int(position)
    part = position - floor
    return {floor: 1.0} if part == 0 else {floor: 1.0 - part, floor + 1: part}
