"""DuckDB twins of the registered queries, in a different shape."""

from __future__ import annotations

from checks import oracle_features as O

LOG = O.LOG
SPREAD = (
    "(User_id * 7919 + Merchant_id * 31 + CAST(substr(received_text, 7, 2) AS BIGINT) * 17) % 997"
)
SCORE = f"(({O.RATE}) * 0.5 + CAST({SPREAD} AS DOUBLE) / CAST(1994 AS DOUBLE))"


def _scored(number: int) -> str:
    """CTEs d and s: one table with label and score."""
    return (
        f"d AS ({O.dataset_window(number)}),"
        f" s AS (SELECT *, {O.label()} AS label, {SCORE} AS score FROM d)"
    )


# Every pair of a positive and a negative row, counted one by one.
PAIRS = (
    "pairs AS (SELECT {keys} AVG(CASE WHEN p.score > n.score THEN 1.0"
    " WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS auc,"
    " COUNT(DISTINCT p.rid) AS n_pos, COUNT(DISTINCT n.rid) AS n_neg"
    " FROM r p JOIN r n ON p.label = 1 AND n.label = 0 {on} {group})"
)
NUMBERED = "r AS (SELECT *, row_number() OVER () AS rid FROM s)"
PER_COUPON = PAIRS.format(
    keys="p.coupon_text AS Coupon_id,", on="AND p.coupon_text = n.coupon_text",
    group="GROUP BY p.coupon_text",
)
POOLED = PAIRS.format(keys="", on="", group="")

KEYS = "User_id, coupon_text AS Coupon_id, received_text AS Date_received"
HISTORY_2 = f"WITH {LOG}, f AS ({O.history_window(2)}), {O.history_ctes('f')}"


def _one_hot(value: str, pairs: list[tuple[str, int]]) -> str:
    return ", ".join(
        f"CASE WHEN {value} = {k} THEN 1 ELSE CAST(0 AS BIGINT) END AS {name}" for name, k in pairs
    )


def _histogram_rows(sides: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, COUNT(*) AS n_rows, CAST({7 if name != 'dataset3' else 6} AS BIGINT) AS n_columns"
        f" FROM ({sql})"
        for name, sql in sides
    )


DISTANCE_NAMES = [(f"c_dis_{k}", k) for k in range(11)]
TEXT_ORDER_NAMES = [
    (f"c_dis_{i}", k) for i, k in enumerate([0, 1, 10, 2, 3, 4, 5, 6, 7, 8, 9])
]
WEEKDAY_NAMES = [(f"c_weekday_{k}", k) for k in range(1, 8)]
MONTHDAY_NAMES = [(f"c_monthday_{k}", k) for k in range(1, 32)]

PREDICTORS = [
    *O.COUPON, *O.HISTORY_NAMES,
    *[n for n in O.T_COLUMNS.split(", ") if not n.startswith("t_day_gap")],
]


def oracle_sql() -> dict[str, str]:
    queries = {
        "log_typed": f"WITH {LOG} SELECT {O.RAW_TRAIN} FROM log",
        "rejects": (
            f"WITH {LOG} SELECT CASE User_id % 50 WHEN 7 THEN 'Merchant_id,Discount_rate' WHEN 8 THEN 'Distance'"
            " WHEN 9 THEN 'Date_received' ELSE 'accepted' END AS reason, COUNT(*) AS n FROM log GROUP BY 1"
        ),
        "coupon_features": f"WITH {LOG} SELECT {O.RAW_TRAIN}, {O.coupon_list()} FROM train",
        "label_15d": (
            f"WITH {LOG} SELECT User_id, received_text AS Date_received, bought_text AS Date,"
            f" {O.label()} AS label FROM train"
        ),
        "label_lt15": (
            f"WITH {LOG} SELECT User_id, received_text AS Date_received, bought_text AS Date,"
            f" {O.label('< 15')} AS label FROM train"
        ),
        "label_binary": (
            f"WITH {LOG} SELECT User_id, greatest({O.label()}, 0) AS label,"
            " CASE WHEN received_text = 'null' THEN 0 ELSE CAST(1 AS BIGINT) END AS has_receipt FROM train"
        ),
        "one_hot": (
            f"WITH {LOG} SELECT User_id, distance_text AS Distance, received_text AS Date_received,"
            f" {_one_hot('Distance', DISTANCE_NAMES)},"
            f" {_one_hot('isodow(Date_received)', WEEKDAY_NAMES)} FROM train"
        ).replace("CASE WHEN Distance", "CASE WHEN train.Distance")
        .replace("isodow(Date_received)", "isodow(train.Date_received)"),
        "one_hot_text_order": (
            f"WITH {LOG} SELECT User_id, distance_text AS Distance,"
            f" {_one_hot('train.Distance', TEXT_ORDER_NAMES)} FROM train"
        ),
        "one_hot_month_day": (
            f"WITH {LOG} SELECT User_id, received_text AS Date_received,"
            f" {_one_hot('day(train.Date_received)', MONTHDAY_NAMES)} FROM train"
        ),
        "feature_window_1_overlap": (
            f"WITH {LOG}, f AS ({O.history_window(1, unused_end='20160514')})"
            f" SELECT {O.RAW_TRAIN} FROM f"
        ),
        "user_features": f"{HISTORY_2} SELECT * EXCLUDE (u_mean_discount) FROM uf",
        "merchant_features": f"{HISTORY_2} SELECT * EXCLUDE (m_mean_discount) FROM mf",
        "user_merchant_features": f"{HISTORY_2} SELECT * FROM um",
        "user_mean_discount": f"{HISTORY_2} SELECT User_id, u_mean_discount FROM uf",
        "merchant_mean_discount": f"{HISTORY_2} SELECT Merchant_id, m_mean_discount FROM mf",
        "merchant_coupon_count": (
            f"WITH {LOG}, f AS ({O.history_window(2)}) SELECT m.Merchant_id,"
            " CAST(COALESCE(n, 0) AS BIGINT) AS m_merchant_coupon_count"
            " FROM (SELECT DISTINCT Merchant_id FROM f) m LEFT JOIN (SELECT Merchant_id, COUNT(*) AS n"
            " FROM (SELECT DISTINCT Merchant_id, coupon_text FROM f WHERE coupon_text <> 'null')"
            " GROUP BY ALL) USING (Merchant_id)"
        ),
        "user_coupon_features": (
            f"WITH {LOG}, f AS ({O.history_window(2)}), {_user_coupon('f')}"
            " SELECT User_id, coupon_text AS Coupon_id, * EXCLUDE (User_id, coupon_text) FROM uc"
        ),
        "pair_overview": (
            f"WITH {LOG} SELECT User_id, Merchant_id, COALESCE(b.n, 0) AS um_redeemed_count,"
            " a.n AS um_total_count"
            " FROM (SELECT User_id, Merchant_id, COUNT(*) AS n FROM train GROUP BY ALL) a"
            " LEFT JOIN (SELECT User_id, Merchant_id, COUNT(*) AS n FROM train WHERE bought_text <> 'null'"
            " AND received_text <> 'null' GROUP BY ALL) b USING (User_id, Merchant_id)"
        ),
        "receipt_features": (
            f"WITH {LOG}, d AS ({O.dataset_window(2)}), {O.receipt_cte('d')}"
            f" SELECT {KEYS}, {O.T_COLUMNS} FROM ot"
        ),
        "receipt_gaps": (
            f"WITH {LOG}, {O.receipt_cte('test')}"
            f" SELECT {KEYS}, t_day_gap_before, t_day_gap_after FROM ot"
        ),
        "receipt_days": (
            f"WITH {LOG}, d AS ({O.dataset_window(2)}), g AS (SELECT User_id, coupon_text,"
            " received_text, COUNT(*) AS n FROM d GROUP BY ALL)"
            " SELECT User_id, coupon_text AS Coupon_id, CAST(SUM(n) AS BIGINT) AS receive_number,"
            " string_agg(received_text, ':' ORDER BY received_text) AS days,"
            " string_agg(CAST(n AS VARCHAR), ':' ORDER BY received_text) AS copies,"
            " MAX(received_text) AS t_max_coupon_time, MIN(received_text) AS t_min_coupon_time"
            " FROM g GROUP BY ALL HAVING SUM(n) > 1"
        ),
        "receipt_features_two_tables": (
            f"WITH {LOG}, d AS ({O.dataset_window(2)}), {O.receipt_cte('test')}"
            + " UNION ALL ".join(
                f" SELECT {O.RAW_TEST}, '{part}' AS part, "
                + ", ".join(f"COALESCE({n}, 0) AS {n}" for n in O.T_COLUMNS.split(", "))
                + f" FROM {source} LEFT JOIN ot USING (User_id, coupon_text, received_text)"
                for part, source in (("train", "d"), ("test", "test"))
            )
        ),
        "coupon_count": (
            f"WITH {LOG}, d AS ({O.dataset_window(2)}) SELECT coupon_text AS Coupon_id,"
            " COUNT(*) AS c_coupon_count FROM d GROUP BY ALL"
        ),
        "dataset1_features_earlier": _earlier_dataset(),
        "dataset2_features_optional": _optional_dataset(),
        "predictors_without_day_gaps": (
            f"WITH {LOG}, {O.assembled_ctes(2)},"
            f" filled AS (SELECT {O.coupon_list()}, {O.wide_list()} FROM wide)"
            + " UNION ALL ".join(
                f" SELECT '{n}' AS predictor, ROUND(AVG({n}), 6) AS mean FROM filled"
                for n in PREDICTORS
            )
        ),
        "datasets_union": _union_report(),
        "table_sizes": f"WITH {LOG} " + _histogram_rows(
            [
                ("dataset1", O.dataset_window(1)), ("history1", O.history_window(1)),
                ("dataset2", O.dataset_window(2)), ("history2", O.history_window(2)),
                ("dataset3", O.dataset_window(3)), ("history3", O.history_window(3)),
            ]
        ),
        "label_histogram": (
            f"WITH {LOG} SELECT {O.label()} AS label, COUNT(*) AS n FROM train GROUP BY 1"
        ),
        "label_values": f"WITH {LOG} SELECT DISTINCT {O.label()} AS label FROM train",
        "auc_per_coupon": (
            f"WITH {LOG}, {_scored(2)}, {NUMBERED}, {PER_COUPON}"
            " SELECT Coupon_id, ROUND(auc, 6) AS auc, n_pos, n_neg FROM pairs"
        ),
        "auc_mean": (
            f"WITH {LOG}, {_scored(2)}, {NUMBERED}, {PER_COUPON}"
            " SELECT ROUND(AVG(auc), 6) AS mean_auc, COUNT(*) AS coupons FROM pairs"
        ),
        "auc_min_max_scaled": (
            f"WITH {LOG}, {_scored(2)}, {NUMBERED}, {PER_COUPON}"
            " SELECT ROUND(AVG(auc), 6) AS mean_auc, COUNT(*) AS coupons FROM pairs"
        ),
        "auc_pooled": (
            f"WITH {LOG}, {_scored(2)}, ranked AS (SELECT label,"
            " RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS r"
            " FROM s) SELECT ROUND((SUM(CASE WHEN label = 1 THEN r ELSE 0 END) - np * (np + 1) / 2.0)"
            " / (np * nn), 6) AS auc, np AS n_pos, nn AS n_neg"
            " FROM ranked, (SELECT COUNT(*) FILTER (label = 1) AS np,"
            " COUNT(*) FILTER (label <> 1) AS nn FROM s) GROUP BY np, nn"
        ),
        "auc_pooled_margin": (
            f"WITH {LOG}, {_scored(2)}, t AS (SELECT label, (score - CAST(0.7 AS DOUBLE))"
            " * pow(CAST(2 AS DOUBLE), User_id % 40 * 20 - 400) AS score FROM s), ranked AS (SELECT label,"
            " RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS r"
            " FROM t) SELECT ROUND((SUM(CASE WHEN label = 1 THEN r ELSE 0 END) - np * (np + 1) / 2.0)"
            " / (np * nn), 6) AS auc, np AS n_pos, nn AS n_neg"
            " FROM ranked, (SELECT COUNT(*) FILTER (label = 1) AS np,"
            " COUNT(*) FILTER (label <> 1) AS nn FROM s) GROUP BY np, nn"
        ),
        "accuracy_report": (
            f"WITH {LOG}, {_scored(2)} SELECT ROUND(AVG(CASE WHEN (score > 0.7) = (label = 1)"
            " THEN 1.0 ELSE 0.0 END), 6) AS accuracy, COUNT(*) AS n FROM s"
        ),
        "zscore": _zscore(),
        "minmax": (
            f"WITH {LOG}, {_scored(2)} SELECT {KEYS}, ROUND((score - lo) / (hi - lo), 6) AS score,"
            " CAST(0 AS DOUBLE) AS constant"
            " FROM s, (SELECT MIN(score) AS lo, MAX(score) AS hi FROM s)"
        ),
        "score_summary": (
            f"WITH {LOG}, {_scored(3).replace(O.label(), '0')}"
            + " UNION ALL ".join(
                f" SELECT '{c}' AS \"column\", COUNT({c}) AS n, ROUND(AVG({c}), 6) AS mean,"
                f" ROUND(STDDEV_SAMP({c}), 6) AS std, MIN({c})::DOUBLE AS min,"
                f" ROUND(QUANTILE_CONT({c}, 0.25), 6) AS p25, ROUND(QUANTILE_CONT({c}, 0.5), 6) AS p50,"
                f" ROUND(QUANTILE_CONT({c}, 0.75), 6) AS p75, MAX({c})::DOUBLE AS max FROM s"
                for c in ("User_id", "score")
            )
        ).replace("MIN(score)::DOUBLE", "ROUND(MIN(score), 6)").replace(
            "MAX(score)::DOUBLE", "ROUND(MAX(score), 6)"
        ),
        "predictor_summary": (
            f"WITH {LOG}, {O.assembled_ctes(2)},"
            f" filled AS (SELECT {O.coupon_list()}, {O.wide_list()} FROM wide)"
            + " UNION ALL ".join(
                f" SELECT '{n}' AS \"column\", COUNT({n}) AS n, ROUND(AVG({n}), 4) AS mean,"
                f" ROUND(STDDEV_SAMP({n}), 4) AS std, ROUND(MIN({n})::DOUBLE, 4) AS min,"
                f" ROUND(QUANTILE_CONT({n}::DOUBLE, 0.25), 4) AS p25, ROUND(QUANTILE_CONT({n}::DOUBLE, 0.5), 4) AS p50,"
                f" ROUND(QUANTILE_CONT({n}::DOUBLE, 0.75), 4) AS p75, ROUND(MAX({n})::DOUBLE, 4) AS max FROM filled"
                for n in [*PREDICTORS, "t_day_gap_before", "t_day_gap_after"]
            )
        ),
        "received_only": (
            f"WITH {LOG}, d AS ({O.dataset_window(2)}), u AS ("
            f" SELECT CAST(0 AS BIGINT) AS is_valid, {O.label()} AS label FROM train UNION ALL"
            f" SELECT CAST(1 AS BIGINT) AS is_valid, {O.label()} AS label FROM d)"
            " SELECT is_valid, label, COUNT(*) AS n FROM u WHERE label <> -1 GROUP BY is_valid, label"
        ),
        "gbt_scored_rows": (
            f"WITH {LOG}, d AS (SELECT DISTINCT * FROM ({O.dataset_window(2)}))"
            f" SELECT {KEYS}, {O.label()} AS label, CAST(1 AS BIGINT) AS in_range FROM d"
        ),
        "logistic_grid_settings": (
            "SELECT a AS alpha, l AS l1_ratio, CAST(1 AS BIGINT) AS has_auc"
            " FROM (SELECT UNNEST([0.001::DOUBLE, 0.01, 0.1]) AS a), (SELECT UNNEST([0.001::DOUBLE, 0.01, 0.1]) AS l)"
        ),
        "importance_features": (
            "SELECT UNNEST([" + ", ".join(f"'{n}'" for n in [*PREDICTORS, "t_day_gap_before", "t_day_gap_after"])
            + "]) AS feature, CAST(1 AS BIGINT) AS is_share, CAST(1 AS DOUBLE) AS total"
        ),
        "kfold_rounds": (
            f"WITH {LOG}, d AS (SELECT DISTINCT * FROM ({O.dataset_window(1)})),"
            f" l AS (SELECT (User_id + Merchant_id) % 3 AS part, greatest({O.label()}, 0) AS label FROM d)"
            " SELECT r.round, f.fold, CASE WHEN part = f.fold THEN 1 ELSE CAST(0 AS BIGINT) END AS held_out,"
            " COUNT(*) FILTER (label = 1) AS n_pos, COUNT(*) FILTER (label = 0) AS n_neg"
            " FROM l, (SELECT UNNEST(range(1, 5)) AS round) r, (SELECT UNNEST(range(0, 3)) AS fold) f GROUP BY ALL"
        ),
        "submission_rows": (
            f"WITH {LOG}, d AS (SELECT DISTINCT * FROM ({O.dataset_window(3)}))"
            f" SELECT {KEYS}, CAST(1 AS BIGINT) AS in_range FROM d"
        ),
        "column_mean_compare": (
            f"WITH {LOG}"
            + " UNION ALL ".join(
                f" SELECT '{side}' AS side, ROUND(AVG({O.RATE}), 6) AS mean, COUNT(*) AS n"
                f" FROM ({O.dataset_window(n)})"
                for side, n in (("left", 1), ("right", 2))
            )
        ),
        "submission_sorted": (
            f"WITH {LOG}, {_scored(3).replace(O.label(), '0')}"
            f" SELECT {KEYS}, ROUND((score - lo) / (hi - lo), 6) AS score"
            " FROM s, (SELECT MIN(score) AS lo, MAX(score) AS hi FROM s)"
        ),
        "submission_head": (
            f"WITH {LOG}, {_scored(3).replace(O.label(), '0')}"
            f" SELECT {KEYS}, ROUND(score, 6) AS score FROM s"
            " ORDER BY coupon_text, ROUND(s.score, 6), User_id, received_text LIMIT 5"
        ),
    }
    for number in (1, 2, 3):
        raw = O.RAW_TEST if number == 3 else O.RAW_TRAIN
        queries[f"dataset_window_{number}"] = (
            f"WITH {LOG}, d AS ({O.dataset_window(number)}) SELECT {raw} FROM d"
        )
        queries[f"feature_window_{number}"] = (
            f"WITH {LOG}, f AS ({O.history_window(number)}) SELECT {O.RAW_TRAIN} FROM f"
        )
        queries[f"dataset{number}_features"] = O.dataset(number)
    same = {
        "csv_round_trip": "log_typed", "receipt_features_split": "receipt_features", "receipt_features_bucketed": "receipt_features",
        "dataset2_features_split": "dataset2_features", "user_features_daily": "user_features",
        "user_merchant_features_daily": "user_merchant_features",
        "dataset1_features_earlier_daily": "dataset1_features_earlier",
        **{f"dataset{n}_features_daily": f"dataset{n}_features" for n in (1, 2, 3)},
    }
    return {**queries, **{name: queries[twin] for name, twin in same.items()}}


def _user_coupon(source: str) -> str:
    def part(alias: str, column: str, where: str) -> str:
        return (
            f" LEFT JOIN (SELECT User_id, coupon_text, COUNT(*) AS {column} FROM {source}"
            f" WHERE {where} GROUP BY ALL) {alias} USING (User_id, coupon_text)"
        )

    return (
        "uc AS (SELECT User_id, coupon_text, n AS uc_count,"
        " CAST(COALESCE(b, 0) AS BIGINT) AS uc_coupon_buy_count,"
        " CAST(COALESCE(u, 0) AS BIGINT) AS uc_coupon_nosale_count,"
        " ROUND(COALESCE(b, 0)::DOUBLE / n, 6) AS uc_buy_rate,"
        " ROUND(COALESCE(b, 0)::DOUBLE / n, 6) AS uc_no_buy_rate,"
        " ROUND(COALESCE(u, 0)::DOUBLE / n, 6) AS uc_nosale_rate"
        f" FROM (SELECT DISTINCT User_id, coupon_text FROM {source} WHERE coupon_text <> 'null') k"
        + part("x", "n", "coupon_text <> 'null'")
        + part("y", "b", "coupon_text <> 'null' AND bought_text <> 'null'")
        + part("z", "u", "coupon_text <> 'null' AND received_text <> 'null' AND bought_text = 'null'")
        + ")"
    )


def _earlier_dataset() -> str:
    coupon = O.coupon_list(
        ["c_discount_rate", "c_is_manjian", "c_man", "c_jian", "c_distance", "c_weektype"]
    )
    inner = (
        f"SELECT *, {coupon}, {_one_hot('Distance', DISTANCE_NAMES)},"
        f" {_one_hot('isodow(Date_received)', WEEKDAY_NAMES)},"
        f" {O.label('< 15')} AS label FROM wide"
    )
    names = [
        "c_discount_rate", "c_is_manjian", "c_man", "c_jian", "c_distance", "c_weektype",
        *[n for n, _ in DISTANCE_NAMES + WEEKDAY_NAMES],
    ]
    return (
        f"WITH {LOG}, {O.assembled_ctes(1, unused_end='20160514')}, n AS ({inner})"
        f" SELECT User_id, Merchant_id, coupon_text AS Coupon_id, rate_text AS Discount_rate,"
        f" distance_text AS Distance, received_text AS Date_received, bought_text AS Date, label,"
        f" isodow(n.Date_received) AS weekday, {', '.join(names)}, {O.wide_list()} FROM n"
    )


def _optional_dataset() -> str:
    uc = ["uc_count", "uc_coupon_buy_count", "uc_coupon_nosale_count", "uc_buy_rate",
          "uc_no_buy_rate", "uc_nosale_rate"]
    filled = ["u_mean_discount", "m_mean_discount", "m_merchant_coupon_count", *uc]
    return (
        f"WITH {LOG}, {O.assembled_ctes(2)}, {_user_coupon('f')},"
        " cc AS (SELECT coupon_text, COUNT(*) AS c_coupon_count FROM d GROUP BY ALL),"
        " mc AS (SELECT Merchant_id, COUNT(DISTINCT coupon_text) AS m_merchant_coupon_count"
        " FROM f WHERE coupon_text <> 'null' GROUP BY ALL)"
        " SELECT User_id, Merchant_id, coupon_text AS Coupon_id, distance_text AS Distance,"
        " received_text AS Date_received, bought_text AS Date, c_coupon_count,"
        + ", ".join(f" COALESCE({n}, 0) AS {n}" for n in filled)
        + " FROM wide LEFT JOIN uc USING (User_id, coupon_text) LEFT JOIN cc USING (coupon_text)"
        " LEFT JOIN mc USING (Merchant_id)"
    )


def _union_report() -> str:
    parts = []
    for number, valid in ((1, 0), (2, 1)):
        key = "User_id, coupon_text"
        parts.append(
            f" SELECT CAST({valid} AS BIGINT) AS is_valid, greatest({O.label()}, 0) AS label, n"
            f" FROM (SELECT DISTINCT * FROM ({O.dataset_window(number)}))"
            f" JOIN (SELECT {key}, COUNT(*) AS n FROM ({O.dataset_window(number)}) GROUP BY ALL)"
            f" USING ({key})"
        )
    return (
        f"WITH {LOG}, u AS ({' UNION ALL '.join(parts)})"
        " SELECT is_valid, label, COUNT(*) AS n, CAST(SUM(n) AS BIGINT) AS same_coupons"
        " FROM u GROUP BY is_valid, label"
    )


def _zscore() -> str:
    names = ["c_discount_rate", "c_man", "c_jian", "c_distance", "c_weekday", "c_monthday"]
    raw = {**O.COUPON, "c_discount_rate": O.RATE}
    values = ", ".join(f"{raw[n]} AS {n}" for n in names)
    stats = ", ".join(
        f"AVG({n}) AS a_{n}, COALESCE(NULLIF(STDDEV_POP({n}), 0), 1) AS d_{n}" for n in names
    )
    scaled = ", ".join(f"ROUND(({n} - a_{n}) / d_{n}, 6) AS {n}" for n in names)
    return (
        f"WITH {LOG}, v AS (SELECT *, {values} FROM ({O.dataset_window(2)})),"
        f" st AS (SELECT {stats} FROM v)"
        f" SELECT {KEYS.replace('User_id', 'User_id, Merchant_id')}, {scaled} FROM v, st"
    )
