"""DuckDB twins of the feature queries.

They are written as the long form: one sub-select per feature joined to the
distinct keys, and self-joins for the receipt features.
"""

from __future__ import annotations

LOG = """
raw AS (
  SELECT User_id, Merchant_id,
    CASE WHEN nocoupon THEN 'null' ELSE CAST(cid AS VARCHAR(20)) END AS Coupon_id,
    CASE WHEN nocoupon THEN 'null' WHEN cid % 4 = 0 THEN '0.9' WHEN cid % 4 = 1 THEN '200:20'
         WHEN cid % 4 = 2 THEN '30:5' ELSE '0.85' END AS Discount_rate,
    CASE WHEN dist = 11 THEN 'null' ELSE CAST(dist AS VARCHAR(20)) END AS Distance,
    CASE WHEN nocoupon THEN 'null' ELSE strftime(rec, '%Y%m%d') END AS Date_received,
    CASE WHEN unused THEN 'null' ELSE strftime(use_d, '%Y%m%d') END AS Date
  FROM (
    SELECT o_custkey AS User_id, l_suppkey % 20 AS Merchant_id,
      (l_suppkey % 20) * 2 + l_linenumber % 2 AS cid,
      (o_custkey * 7 + l_suppkey * 3) % 12 AS dist,
      l_discount = 0 AS nocoupon,
      l_returnflag = 'R' AND l_discount <> 0 AS unused,
      DATE '2016-01-01' + CAST(o_orderkey % 212 AS INT) AS rec,
      DATE '2016-01-01' + CAST(o_orderkey % 212 + l_partkey % 45 - 5 AS INT) AS use_d
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x),
log AS (
  SELECT User_id, Merchant_id, Coupon_id AS coupon_text, Discount_rate AS rate_text,
    Distance AS distance_text, Date_received AS received_text, Date AS bought_text,
    CAST(NULLIF(Coupon_id, 'null') AS VARCHAR) AS Coupon_id,
    NULLIF(Discount_rate, 'null') AS Discount_rate,
    CAST(NULLIF(Distance, 'null') AS INTEGER) AS Distance,
    CAST(strptime(NULLIF(Date_received, 'null'), '%Y%m%d') AS DATE) AS Date_received,
    CAST(strptime(NULLIF(Date, 'null'), '%Y%m%d') AS DATE) AS Date
  FROM raw),
train AS (SELECT * FROM log WHERE received_text = 'null' OR received_text <= '20160630'),
test AS (SELECT * FROM log WHERE received_text BETWEEN '20160701' AND '20160730')
"""

RAW_TRAIN = (
    "User_id, Merchant_id, coupon_text AS Coupon_id, rate_text AS Discount_rate, "
    "distance_text AS Distance, received_text AS Date_received, bought_text AS Date"
)
RAW_TEST = RAW_TRAIN.removesuffix(", bought_text AS Date")

DATASETS = {1: ("20160414", "20160514"), 2: ("20160515", "20160615")}
HISTORIES = {
    1: ("20160101", "20160413"), 2: ("20160201", "20160514"), 3: ("20160315", "20160630"),
}


def label(bound: str = "<= 15") -> str:
    return (
        "CASE WHEN received_text = 'null' THEN -1"
        f" WHEN bought_text <> 'null' AND Date - Date_received {bound} THEN 1 ELSE CAST(0 AS BIGINT) END"
    )


RATE = (
    "CASE WHEN rate_text = 'null' THEN 1.0::DOUBLE WHEN rate_text LIKE '%:%' THEN"
    " 1 - CAST(split_part(rate_text, ':', 2) AS DOUBLE)"
    " / CAST(split_part(rate_text, ':', 1) AS DOUBLE)"
    " ELSE CAST(rate_text AS DOUBLE) END"
)

COUPON = {
    "c_discount_rate": f"ROUND({RATE}, 6)",
    "c_is_manjian": "CAST(len(string_split(rate_text, ':')) > 1 AS BIGINT)",
    "c_man": "CASE WHEN rate_text LIKE '%:%' THEN CAST(split_part(rate_text, ':', 1) AS BIGINT) ELSE 0 END",
    "c_jian": "CASE WHEN rate_text LIKE '%:%' THEN CAST(split_part(rate_text, ':', 2) AS BIGINT) ELSE 0 END",
    "c_distance": "CAST(CASE WHEN distance_text = 'null' THEN '0' ELSE distance_text END AS BIGINT)",
    "c_weekday": "COALESCE(CAST(isodow(Date_received) AS BIGINT), 0)",
    "c_weektype": "CASE WHEN isodow(Date_received) >= 6 THEN 1 ELSE CAST(0 AS BIGINT) END",
    "c_monthday": "COALESCE(CAST(substr(NULLIF(received_text, 'null'), 7, 2) AS BIGINT), 0)",
}


def coupon_list(names: list[str] | None = None) -> str:
    return ", ".join(f"{COUPON[n]} AS {n}" for n in names or COUPON)


def history_window(number: int, *, unused_end: str | None = None) -> str:
    first, last = HISTORIES[number]
    return (
        f"SELECT * FROM train WHERE (bought_text >= '{first}' AND bought_text <= '{last}')"
        f" OR (bought_text = 'null' AND received_text >= '{first}'"
        f" AND received_text <= '{unused_end or last}')"
    )


def dataset_window(number: int) -> str:
    if number == 3:
        return "SELECT * EXCLUDE (bought_text, Date) FROM test"
    first, last = DATASETS[number]
    return f"SELECT * FROM train WHERE received_text BETWEEN '{first}' AND '{last}'"


def _side(name: str, key: str, p: str, source: str) -> str:
    """CTE ``name``: one joined sub-select per feature of a user or merchant."""
    def part(alias: str, what: str, where: str) -> str:
        return (
            f" LEFT JOIN (SELECT {key}, {what} FROM {source} WHERE {where} GROUP BY {key})"
            f" {alias} USING ({key})"
        )

    redeemed = "bought_text <> 'null' AND received_text <> 'null'"
    merchants = (
        f" LEFT JOIN (SELECT {key}, COUNT(*) AS merchants FROM (SELECT DISTINCT {key}, Merchant_id"
        f" FROM {source} WHERE bought_text <> 'null') GROUP BY {key}) d USING ({key})"
        if p == "u_" else ""
    )
    merchant_column = (
        "CAST(COALESCE(merchants, 0) AS BIGINT) AS u_merchant_count," if p == "u_" else ""
    )
    return f"""{name} AS (
  SELECT {key},
    CAST(COALESCE(buys, 0) AS BIGINT) AS {p}buy_count,
    CAST(COALESCE(used, 0) AS BIGINT) AS {p}coupon_buy_count,
    CAST(COALESCE(got, 0) AS BIGINT) AS {p}coupon_count,
    ROUND(COALESCE(used::DOUBLE / NULLIF(buys, 0), 0), 6) AS {p}coupon_buy_rate,
    ROUND(COALESCE(used::DOUBLE / NULLIF(got, 0), 0), 6) AS {p}coupon_use_rate,
    ROUND(COALESCE(dist_mean, 0), 6) AS {p}mean_distance,
    COALESCE(dist_max, 0)::DOUBLE AS {p}max_distance,
    COALESCE(dist_min, 0)::DOUBLE AS {p}min_distance,
    ROUND(COALESCE(dist_mid, 0), 6) AS {p}median_distance,
    {merchant_column}
    ROUND(COALESCE(gap_mean, 0), 6) AS {p}date_gap_mean,
    COALESCE(gap_min, 0)::DOUBLE AS {p}date_gap_min,
    COALESCE(gap_max, 0)::DOUBLE AS {p}date_gap_max,
    ROUND(COALESCE(rate_mean, 0), 6) AS {p}mean_discount
  FROM (SELECT DISTINCT {key} FROM {source}) k
  {part('a', 'COUNT(*) AS buys', "bought_text <> 'null'")}
  {part('b', 'COUNT(*) AS used', redeemed)}
  {part('c', 'COUNT(*) AS got', "received_text <> 'null'")}
  {part('e', 'AVG(Distance) AS dist_mean, MAX(Distance) AS dist_max, MIN(Distance) AS dist_min, MEDIAN(Distance) AS dist_mid', redeemed)}
  {part('g', 'AVG(Date - Date_received) AS gap_mean, MIN(Date - Date_received) AS gap_min, MAX(Date - Date_received) AS gap_max', redeemed)}
  {part('h', f'AVG({RATE}) AS rate_mean', redeemed)}
  {merchants})"""


def history_ctes(source: str) -> str:
    """CTEs uf, mf and um over a history window."""
    def part(alias: str, column: str, where: str) -> str:
        return (
            f" LEFT JOIN (SELECT User_id, Merchant_id, COUNT(*) AS {column} FROM {source}"
            f" WHERE {where} GROUP BY ALL) {alias} USING (User_id, Merchant_id)"
        )

    def share(a: str, b: str) -> str:
        return f"ROUND(COALESCE(COALESCE({a}, 0)::DOUBLE / NULLIF({b}, 0), 0), 6)"

    redeemed = "bought_text <> 'null' AND received_text <> 'null'"
    return f"""{_side('uf', 'User_id', 'u_', source)},
{_side('mf', 'Merchant_id', 'm_', source)},
um AS (
  SELECT User_id, Merchant_id,
    CAST(COALESCE(buys, 0) AS BIGINT) AS um_buy_count,
    CAST(COALESCE(used, 0) AS BIGINT) AS um_buy_with_coupon_count,
    CAST(COALESCE(got, 0) AS BIGINT) AS um_coupon_count,
    CAST(n AS BIGINT) AS um_count,
    CAST(COALESCE(plain, 0) AS BIGINT) AS um_common_buy_count,
    {share('buys', 'n')} AS um_buy_rate,
    {share('used', 'buys')} AS um_buy_with_coupon_rate,
    {share('used', 'got')} AS um_coupon_transfer_rate,
    {share('plain', 'buys')} AS um_common_buy_rate
  FROM (SELECT DISTINCT User_id, Merchant_id FROM {source}) k
  {part('a', 'buys', "bought_text <> 'null'")}
  {part('b', 'used', redeemed)}
  {part('c', 'got', "received_text <> 'null'")}
  {part('d', 'n', 'TRUE')}
  {part('e', 'plain', "bought_text <> 'null' AND coupon_text = 'null'")})"""


def receipt_cte(source: str) -> str:
    """CTE ot: receipt features from self-joins, one row per key."""
    key = "User_id, coupon_text, received_text"
    return f"""ot AS (
  SELECT r.User_id, r.coupon_text, r.received_text,
    t1.n AS t_total_coupon_count,
    t2.n AS t_same_coupon_count,
    CASE WHEN t2.n > 1 THEN 1 ELSE CAST(0 AS BIGINT) END AS t_same_coupon_morethan1,
    CASE WHEN t2.n = 1 THEN -1 WHEN r.received_text = t2.last THEN 1 ELSE CAST(0 AS BIGINT) END
      AS t_user_receive_same_coupon_lastone,
    CASE WHEN t2.n = 1 THEN -1 WHEN r.received_text = t2.first THEN 1 ELSE CAST(0 AS BIGINT) END
      AS t_user_receive_same_coupon_firstone,
    t5.n AS t_day_received_all_coupon_num,
    t6.n AS t_day_received_same_coupon_num,
    COALESCE(g.before, -1) AS t_day_gap_before,
    COALESCE(g.after, -1) AS t_day_gap_after
  FROM (SELECT DISTINCT {key} FROM {source}) r
  JOIN (SELECT User_id, COUNT(*) AS n FROM {source} GROUP BY ALL) t1 USING (User_id)
  JOIN (SELECT User_id, coupon_text, COUNT(*) AS n, MAX(received_text) AS last,
          MIN(received_text) AS first FROM {source} GROUP BY ALL) t2 USING (User_id, coupon_text)
  JOIN (SELECT User_id, received_text, COUNT(*) AS n FROM {source} GROUP BY ALL) t5
    USING (User_id, received_text)
  JOIN (SELECT {key}, COUNT(*) AS n FROM {source} GROUP BY ALL) t6 USING ({key})
  JOIN (SELECT a.User_id, a.coupon_text, a.received_text,
          MIN(CASE WHEN a.Date_received > b.Date_received
              THEN a.Date_received - b.Date_received END) AS before,
          MIN(CASE WHEN b.Date_received > a.Date_received
              THEN b.Date_received - a.Date_received END) AS after
        FROM {source} a JOIN {source} b USING (User_id, coupon_text) GROUP BY ALL) g
    USING ({key}))"""


T_COLUMNS = (
    "t_total_coupon_count, t_same_coupon_count, t_same_coupon_morethan1, "
    "t_user_receive_same_coupon_lastone, t_user_receive_same_coupon_firstone, "
    "t_day_received_all_coupon_num, t_day_received_same_coupon_num, "
    "t_day_gap_before, t_day_gap_after"
)


def assembled_ctes(number: int, *, unused_end: str | None = None) -> str:
    """CTEs up to ``wide{number}``: distinct joined rows, before the fill."""
    return f"""f AS ({history_window(number, unused_end=unused_end)}),
d AS ({dataset_window(number)}),
{history_ctes('f')},
{receipt_cte('d')},
wide AS (
  SELECT DISTINCT d.*, uf.* EXCLUDE (User_id), mf.* EXCLUDE (Merchant_id),
    um.* EXCLUDE (User_id, Merchant_id), ot.* EXCLUDE (User_id, coupon_text, received_text)
  FROM d LEFT JOIN uf USING (User_id) LEFT JOIN mf USING (Merchant_id)
    LEFT JOIN um USING (User_id, Merchant_id)
    LEFT JOIN ot USING (User_id, coupon_text, received_text))"""


U_NAMES = [
    "buy_count", "coupon_buy_count", "coupon_count", "coupon_buy_rate", "coupon_use_rate",
    "mean_distance", "max_distance", "min_distance", "median_distance",
    "date_gap_mean", "date_gap_min", "date_gap_max",
]
UM_NAMES = [
    "um_buy_count", "um_buy_with_coupon_count", "um_coupon_count", "um_count",
    "um_common_buy_count", "um_buy_rate", "um_buy_with_coupon_rate",
    "um_coupon_transfer_rate", "um_common_buy_rate",
]
HISTORY_NAMES = [
    *[f"u_{n}" for n in U_NAMES], "u_merchant_count", *[f"m_{n}" for n in U_NAMES], *UM_NAMES,
]


def wide_list(*extra: str) -> str:
    names = [*HISTORY_NAMES, *extra]
    return ", ".join(f"COALESCE({n}, 0) AS {n}" for n in names) + ", " + T_COLUMNS


def dataset(number: int) -> str:
    raw = RAW_TEST if number == 3 else f"{RAW_TRAIN}, {label()} AS label"
    return (
        f"WITH {LOG}, {assembled_ctes(number)}"
        f" SELECT {raw}, {coupon_list()}, {wide_list()} FROM wide"
    )
