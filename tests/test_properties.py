"""Random tables against brute force, and hot-key plans against ordinary ones."""

from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import log_of, plan_of, random_rows, rows_of
from voucherlens import session
from voucherlens.columns import (
    COUPON_FEATURES, MERCHANT_FEATURES, PAIR_FEATURES, RECEIPT_FEATURES, RECEIVED, USER_FEATURES,
)
from voucherlens.operators import history as hist
from voucherlens.operators.hot_keys import HotKeys, HotRule, attach, find_hot_keys
from voucherlens.operators.ranking import auc, pooled_auc, quantiles
from voucherlens.operators.receipts import receipt_features
from voucherlens.operators.scaling import fit_standard, min_max, standardise
from voucherlens.operators.summary import describe
from voucherlens.plans.datasets import FeatureOptions, assemble, attach_receipts, copied_out
from voucherlens.session import discard, release, written

SPLIT = HotRule(min_rows=15)


def brute_receipts(rows):
    """The receipt features by plain loops over raw rows."""
    keys = [(r[0], str(r[2]), int(r[5][6:])) for r in rows]
    found = {}
    for u, c, d in set(keys):
        same = [k[2] for k in keys if k[:2] == (u, c)]
        days = {k for k in same}
        before = [d - x for x in days if x < d]
        after = [x - d for x in days if x > d]
        found[u, c, d] = (
            sum(k[0] == u for k in keys), len(same), int(len(same) > 1),
            -1 if len(same) == 1 else int(d == max(days)),
            -1 if len(same) == 1 else int(d == min(days)),
            sum(k[0] == u and k[2] == d for k in keys), keys.count((u, c, d)),
            min(before, default=-1), min(after, default=-1),
        )
    return found


def received(rows):
    return [r for r in rows if r[5] != "null"]


@pytest.mark.parametrize("rule", [HotRule(), SPLIT], ids=["ordinary", "hot"])
@pytest.mark.parametrize("seed", [1, 2])
def test_receipts_against_brute_force(spark, rule, seed):
    rows = received(random_rows(seed))
    table = receipt_features(log_of(spark, rows), rule=rule).collect()
    found = {(r.User_id, r.Coupon_id, r.Date_received.day): tuple(r)[3:] for r in table}
    assert len(found) == len(table)
    assert found == brute_receipts(rows)


def test_missing_coupon_is_one_group(spark):
    rows = received(random_rows(3, 120))
    rows += [(1, 1, "null", "0.9", 1, "20160516", "null")] * 3
    log = log_of(spark, rows)
    assert rows_of(receipt_features(log)) == rows_of(receipt_features(log, rule=SPLIT))
    history = log_of(spark, random_rows(4, 120))
    assert rows_of(assemble(history, log)) == rows_of(assemble(history, log, rule=SPLIT))


def test_assembly_is_the_same_with_hot_keys(spark):
    rows = random_rows(5)
    history, scored = log_of(spark, rows), log_of(spark, received(rows))
    options = FeatureOptions(user_coupon=True, coupon_count=True, mean_discount=True)
    hot = find_hot_keys(scored, {"user": ["User_id"], "receipt": ["User_id", "Coupon_id", RECEIVED]},
                        SPLIT)
    assert hot["user"] and hot["user"].by_slices
    plain = assemble(history, scored, options)
    split = assemble(history, scored, options, SPLIT)

    def rounded(df):
        return sorted(
            (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()),
            key=repr,
        )

    assert plain.columns == split.columns
    assert rounded(plain) == rounded(split)


def test_assembly_shape(spark):
    rows = random_rows(6)
    scored = received(rows)
    table = assemble(log_of(spark, rows), log_of(spark, scored)).toPandas()
    assert len(table) == len(set(map(str, scored)))
    features = [*COUPON_FEATURES, *USER_FEATURES, *MERCHANT_FEATURES, *PAIR_FEATURES,
                *RECEIPT_FEATURES]
    assert list(table.columns[8:]) == features and len(features) == 51
    assert not table[features].isna().any().any()
    rates = [c for c in features if c.endswith("_rate") and c != "c_discount_rate"]
    assert ((table[rates] >= 0) & (table[rates] <= 1)).all().all()


def test_distance_null_and_zero_stay_two_rows(spark):
    rows = [(1, 1, "a", "0.9", d, "20160515", "null") for d in ("null", 0, 0)]
    table = assemble(log_of(spark, rows), log_of(spark, rows)).collect()
    assert sorted((r.Distance is None, r.c_distance, r.t_total_coupon_count) for r in table) == [
        (False, 0, 3), (True, 0, 3)]


def test_history_against_brute_force(spark):
    rows = random_rows(7)
    pairs = hist.pair_history(log_of(spark, rows))
    users = {r.User_id: r for r in hist.user_features(pairs).collect()}
    distances, merchants, bought = defaultdict(list), defaultdict(set), Counter()
    for u, m, _, _, d, rec, buy in rows:
        if buy != "null":
            bought[u] += 1
            merchants[u].add(m)
            if rec != "null" and d != "null":
                distances[u].append(int(d))
    for u, row in users.items():
        assert row.u_buy_count == bought[u]
        assert row.u_merchant_count == len(merchants[u])
        assert row.u_median_distance == (np.median(distances[u]) if distances[u] else 0)
        assert row.u_mean_distance == pytest.approx(np.mean(distances[u]) if distances[u] else 0)
    totals = Counter()
    for r in hist.pair_features(pairs).collect():
        totals[r.User_id] += r.um_buy_count
    assert dict(totals) == {u: r.u_buy_count for u, r in users.items()}


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("kind", ["ties", "dense", "tiny", "wide", "constant", "margins", "powers", "extreme"])
def test_auc_against_pair_counting(spark, kind):
    rng = np.random.default_rng(8)
    scores = {
        "ties": rng.integers(0, 7, 300) / 7.0,
        "dense": 0.5 + rng.random(300) * 1e-9,
        "tiny": rng.random(300) * 1e-14,
        "wide": rng.normal(0, 40, 300),
        "constant": np.full(300, 0.25),
        "margins": rng.normal(0, 1, 300) * 10.0 ** rng.integers(-30, 30, 300),
        # Just below, at and above powers of two, of both signs.
        "powers": np.nextafter(2.0 ** rng.integers(-60, 60, 300), rng.choice([-np.inf, 0, np.inf], 300)) * rng.choice([-1, 1], 300),
        "extreme": rng.choice([0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 1.7e308, -1.7e308, 2.2e-308, 1e-310, 1.0], 300),
    }[kind]
    groups = rng.choice(["a", "b", "c"], 300, p=[0.8, 0.15, 0.05])
    labels = rng.integers(0, 2, 300)
    rows = [(str(g), int(y), float(s)) for g, y, s in zip(groups, labels, scores)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    found = {r.g: r.auc for r in auc(df, ["g"]).collect()}
    for g in "abc":
        assert found.get(g) == pytest.approx(brute_auc([r[1:] for r in rows if r[0] == g]))
    (whole,) = pooled_auc(df).collect()
    assert whole.auc == pytest.approx(brute_auc([r[1:] for r in rows]))


def test_auc_of_nothing(spark):
    df = spark.createDataFrame([("a", 1, 0.5)], "g string, label int, score double")
    assert auc(df, ["g"]).collect() == [] and pooled_auc(df.where("false")).collect() == []


def test_auc_leaves_out_what_has_no_score_or_class(spark):
    nan = float("nan")
    rows = [(1, 0.9), (0, 0.2), (0, 0.95), (1, 0.3)]
    odd = [(1, nan), (0, None), (None, 0.5), (-1, 0.99), (2, 0.1)]
    df = spark.createDataFrame(rows + odd, "label int, score double")
    (found,) = pooled_auc(df).collect()
    assert (found.auc, found.n_pos, found.n_neg) == (0.5, 2, 2)
    assert pooled_auc(spark.createDataFrame(odd, "label int, score double")).collect() == []


def test_many_columns_in_one_descent(spark):
    rng = np.random.default_rng(12)
    columns = {f"v{i}": rng.normal(0, 10.0 ** rng.integers(-5, 5), 97) for i in range(7)}
    columns["gaps"] = np.where(rng.random(97) < 0.4, np.nan, rng.integers(-3, 3, 97))
    rows = [tuple(None if k % 5 == 0 and name == "v0" else float(v[k]) for name, v in columns.items()) + (None,) for k in range(97)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "none"]))
    found = {r.column: r for r in describe(df, [*columns, "none"]).collect()}
    assert found["none"].n == 0 and found["none"].p50 is None
    for name, values in columns.items():
        known = np.array([v for k, v in enumerate(values) if not np.isnan(v) and not (name == "v0" and k % 5 == 0)])
        row = found[name]
        assert row.n == len(known) and (row.min, row.max) == (known.min(), known.max())
        assert (row.mean, row.std) == (pytest.approx(known.mean()), pytest.approx(known.std(ddof=1)))
        assert [row.p25, row.p50, row.p75] == pytest.approx(np.quantile(known, [0.25, 0.5, 0.75]), abs=1e-18)


def test_describe_reads_its_table_twice_whatever_the_columns(spark, tmp_path):
    columns = [f"v{i}" for i in range(9)]
    spark.range(20).select(*[(F.col("id") * i).alias(c) for i, c in enumerate(columns)]).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = plan_of(stored.select(*[F.col(c) for c in columns]))
    assert plan.count("Scan parquet") == 1
    # What is left of the table in the answer is its written counts of distinct values.
    answer = plan_of(describe(stored, columns))
    assert str(tmp_path / "t") not in answer and answer.count("Scan parquet") <= 1


def test_written_tables_go_when_they_are_released(spark):
    kept = written(spark.range(3), "kept")
    gone = written(spark.range(4), "gone")
    where = gone.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert Path(where).exists()
    discard(gone)
    assert not Path(where).exists() and kept.count() == 3
    other = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    held = session._written[spark.sparkContext.applicationId]
    mine, held[:] = [p for p in held if p in other or other.endswith(p)], [p for p in held if not other.endswith(p)]
    assert len(mine) == 1
    rest, session._written[spark.sparkContext.applicationId] = list(held), mine
    release(spark)  # only what is named goes
    session._written[spark.sparkContext.applicationId] = rest
    assert not Path(other).exists()


@pytest.mark.parametrize("kind", ["uniform", "skewed", "equal", "integers"])
def test_quantiles_against_numpy(spark, kind):
    rng = np.random.default_rng(9)
    values = {
        "uniform": rng.random(501),
        "skewed": np.concatenate([rng.random(300) * 1e-12, [5.0] * 150, [1e6]]),
        "equal": np.full(10, 3.5),
        "integers": rng.integers(1, 40, 200).astype(float),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {r.share: r.value for r in quantiles(df, "v", shares).collect()}
    for q in shares:
        assert found[q] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-18)


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    scaled = standardise(df, fit_standard(df, ["a", "b"]))
    assert rows_of(scaled) == [(-1.0, 0.0), (1.0, 0.0)]
    assert rows_of(min_max(min_max(df, "a"), "b")) == [(0.0, 0.0), (1.0, 0.0)]


def test_attach_keeps_every_row(spark):
    rows = [(1, i) for i in range(200)] + [(k, k) for k in range(2, 30)]
    left = spark.createDataFrame(rows, "k bigint, v bigint")
    right = spark.createDataFrame([(k, k * 10) for k in range(1, 20)], "k bigint, w bigint")
    hot = find_hot_keys(left, {"k": ["k"]}, HotRule(min_rows=20))["k"]
    assert list(hot.by_slices) == [16]
    assert rows_of(attach(left, right, hot)) == rows_of(left.join(right, "k", "left"))
    assert not HotKeys(("k",))


def test_hot_keys_of_nothing(spark):
    empty = spark.createDataFrame([], "k bigint")
    assert not find_hot_keys(empty, {"k": ["k"]})["k"]


def test_two_tables_keep_copies(spark):
    test = received(random_rows(10, 150))
    train = received(random_rows(11, 150)) + test[:30]
    for rule in (HotRule(), SPLIT):
        ours, theirs = attach_receipts(log_of(spark, train), log_of(spark, test), rule=rule)
        assert (ours.count(), theirs.count()) == (len(train), len(test))
        brute = brute_receipts(test)
        for r in [*ours.collect(), *theirs.collect()]:
            key = (r.User_id, r.Coupon_id, r.Date_received.day)
            assert tuple(r)[-9:] == brute.get(key, (0,) * 9)


def test_copied_out_in_chunks(spark):
    df = spark.createDataFrame([("a", 7), ("b", 1), ("c", 3)], "k string, copies bigint")
    assert Counter(r.k for r in copied_out(df, chunk=3).collect()) == {"a": 7, "b": 1, "c": 3}
