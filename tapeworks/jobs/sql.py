"""DuckDB SQL for the registered queries, built on the same tape of `events`."""

from __future__ import annotations

from tapeworks.schema import BAR_COLUMNS, FEATURES, MOMENTUM_WINDOWS, RAW_COLUMNS, RETURN_WINDOWS, SLOPE_WINDOWS, VOL_WINDOWS

#: Digits at which the queries give what sums over windows add up to: two less than the features have, as the last ones
#: hang on the order in which an engine adds. A small part of a digit keeps them off ties, which engines round differently.
SHOWN = {f"realized_vol_{w}s": 10 for w in VOL_WINDOWS} | {f"cvd_slope_{w}s": 8 for w in SLOPE_WINDOWS}

RAW = """
WITH raw AS (
  SELECT event_id AS trade_id, epoch_us(ts) // 1000 AS timestamp_ms, value AS price, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'BUY' WHEN event_type = 'error' THEN 'ERR' ELSE 'SELL' END AS side, user_id
  FROM events),
judged AS (
  SELECT *, side = 'SELL' AS is_buyer_maker,
         CASE WHEN timestamp_ms IS NULL OR price IS NULL OR quantity IS NULL OR trade_id IS NULL THEN 'missing_field' WHEN quantity <= 0 THEN 'zero_qty'
              WHEN price <= 0 THEN 'zero_price' WHEN side NOT IN ('BUY', 'SELL') THEN 'invalid_side' END AS reason
  FROM raw),
trades AS (SELECT * FROM judged WHERE reason IS NULL)"""
#: As `tape.spoiled` has it.
SPOILED = RAW.replace("value AS price", "CASE WHEN event_id % 97 = 5 THEN NULL WHEN event_id % 89 = 7 THEN 0.0 ELSE value END AS price").replace(
    "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity", "CASE WHEN event_id % 83 = 11 THEN NULL ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS quantity"
)
#: As `tape.sliced` has it.
SLICED = "sliced AS (SELECT event_id, CAST(floor((epoch_us(ts) // 1000 - (SELECT min(epoch_us(ts) // 1000) FROM events)) * 10 / (SELECT max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) + 1 FROM events)) AS INTEGER) AS slice FROM events)"
TRADE = "timestamp_ms, price, quantity, is_buyer_maker, side, trade_id"


def _bars(by: str = "") -> str:
    return f"""{RAW},
grouped AS (
  SELECT {by} CAST(floor(timestamp_ms / 900000.0) * 900 AS BIGINT) AS timestamp_s,
         sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0.0::DOUBLE END) AS b, sum(CASE WHEN side = 'BUY' THEN 0.0::DOUBLE ELSE quantity END) AS s,
         count(*) FILTER (side = 'BUY') AS buy_trades, count(*) FILTER (side <> 'BUY') AS sell_trades, count(*) AS total_trades,
         first(price ORDER BY timestamp_ms, trade_id) AS price_open, max(price) AS price_high, min(price) AS price_low,
         last(price ORDER BY timestamp_ms, trade_id) AS price_close, sum(price * quantity) AS pv, sum(quantity) AS v
  FROM trades GROUP BY ALL),
bars AS (
  SELECT {by} timestamp_s, strftime(make_timestamp(timestamp_s * 1000000), '%Y-%m-%d %H:%M:%S') AS timestamp_utc,
         round(b, 6) + 0.0 AS buy_vol, round(s, 6) + 0.0 AS sell_vol, round(b - s, 6) + 0.0 AS net_delta,
         round(sum(b - s) OVER ({'PARTITION BY ' + by.rstrip(', ') if by else ''} ORDER BY timestamp_s ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS cvd_cumulative,
         buy_trades, sell_trades, total_trades, price_open, price_high, price_low, price_close,
         round(CASE WHEN v > 0 THEN pv / v ELSE price_open END, 2) + 0.0 AS vwap, round(b + s, 6) + 0.0 AS total_volume,
         row_number() OVER ({'PARTITION BY ' + by.rstrip(', ') if by else ''} ORDER BY timestamp_s) - 1 AS idx
  FROM grouped)"""


BARS = _bars()


def _frame(a: int, b: int = 1) -> str:
    return f"(ORDER BY idx ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"


def _warm(w: int, x: str, digits: int | None) -> str:
    x = f"CASE WHEN idx >= {w} THEN {x} ELSE 0 END"
    return x if digits is None else f"round({x}, {digits}) + 0.0"


def _features() -> str:
    f = {"abs_returns": "round(abs(raw_return), 10) + 0.0"}
    for w in RETURN_WINDOWS:
        f[f"return_{w}s"] = _warm(w, f"sum(returns) OVER {_frame(w)}", 10)
        f[f"volume_{w}s"] = _warm(w, f"sum(total_volume) OVER {_frame(w)}", 8)
        f[f"intensity_{w}s"] = f"CAST({_warm(w, f'sum(total_trades) OVER {_frame(w)}', None)} AS BIGINT)"
        f[f"cvd_delta_{w}s"] = _warm(w, f"cvd - lag(cvd, {w}) OVER o", 8)
    for w in VOL_WINDOWS:
        f[f"realized_vol_{w}s"] = _warm(w, f"stddev_pop(returns) OVER {_frame(w)}", 12)
    for w in SLOPE_WINDOWS:
        f[f"cvd_slope_{w}s"] = _warm(w, f"regr_slope(cvd, CAST(idx AS DOUBLE)) OVER {_frame(w)}", 10)
    f["cvd_price_divergence_30s"] = f"CAST({_warm(30, 'sign(cvd - lag(cvd, 30) OVER o) - sign(price_close - lag(price_close, 30) OVER o)', None)} AS INTEGER)"
    f["trade_intensity_zscore"] = "round((total_trades - mean) / CASE WHEN var > 1e-15 THEN sqrt(abs(var)) ELSE 1.0 END, 6) + 0.0"
    for w in MOMENTUM_WINDOWS:
        f[f"net_delta_mom_{w}s"] = _warm(w, f"sum(net_delta) OVER {_frame(w)}", 8)
    late, early = f"sum(total_volume) OVER {_frame(30)}", f"sum(total_volume) OVER {_frame(60, 31)}"
    f["vroc_30s"] = _warm(60, f"CASE WHEN {early} > 1e-15 THEN ({late} - {early}) / {early} ELSE 0 END", 8)
    path = f"sum(step) OVER {_frame(29)}"
    f["efficiency_ratio_30s"] = _warm(30, f"CASE WHEN {path} > 1e-15 THEN abs(lag(price_close, 1) OVER o - lag(price_close, 30) OVER o) / {path} ELSE 0 END", 8)
    f["vol_imbalance"] = "round(CASE WHEN buy_vol + sell_vol > 1e-15 THEN (buy_vol - sell_vol) / (buy_vol + sell_vol) ELSE 0 END, 8) + 0.0"
    f["price_vwap_dist"] = "round(CASE WHEN vwap > 1e-15 THEN (price_close - vwap) / vwap ELSE 0 END, 8) + 0.0"
    rest = [c for c in FEATURES if c not in ("returns", "cvd")]
    return f"""{BARS},
f1 AS (
  SELECT *, CASE WHEN idx > 0 AND lag(price_close) OVER o > 0 AND price_close > 0 THEN ln(price_close / lag(price_close) OVER o) ELSE 0 END AS raw_return,
         abs(price_close - lag(price_close) OVER o) AS step, round(sum(net_delta) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING), 8) + 0.0 AS cvd,
         CAST(sum(total_trades) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS DOUBLE) / (idx + 1) AS mean,
         CAST(sum(total_trades * total_trades) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS DOUBLE) / (idx + 1) AS square
  FROM bars WINDOW o AS (ORDER BY idx)),
f2 AS (SELECT *, round(raw_return, 10) + 0.0 AS returns, square - mean * mean AS var FROM f1),
feats AS MATERIALIZED (
  SELECT {', '.join(BAR_COLUMNS)}, idx, returns, cvd, {', '.join(f'{f[c]} AS {c}' for c in rest)} FROM f2 WINDOW o AS (ORDER BY idx))"""


FEATS = _features()
_AS_DOUBLE = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)
BOUNDS = f"""{FEATS},
long AS (UNPIVOT (SELECT {_AS_DOUBLE} FROM feats) ON {', '.join(FEATURES)} INTO NAME feature VALUE v),
placed AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY feature) AS n FROM long),
bounds AS MATERIALIZED (
  SELECT feature, max(v) FILTER (k = greatest(0, CAST(floor(n * 0.01::DOUBLE) AS BIGINT))) AS lower,
         max(v) FILTER (k = least(n - 1, CAST(floor(n * 0.99::DOUBLE) AS BIGINT))) AS upper
  FROM placed GROUP BY feature)"""


def _clip(c: str) -> str:
    kind = "BIGINT" if c.startswith("intensity") else "INTEGER" if c.startswith("cvd_price") else "DOUBLE"
    lo, hi = (f"(SELECT {x} FROM bounds WHERE feature = '{c}')" for x in ("lower", "upper"))
    return f"CAST(least(greatest({c}, {lo}), {hi}) AS {kind}) AS {c}"


MATRIX = f"{BOUNDS},\nmatrix AS MATERIALIZED (SELECT {', '.join(BAR_COLUMNS)}, idx, {', '.join(map(_clip, FEATURES))} FROM feats)"
NUMERIC = [c for c in [*BAR_COLUMNS, *FEATURES] if c not in ("timestamp_s", "timestamp_utc")]
LONG = f"""{MATRIX},
mlong AS MATERIALIZED (UNPIVOT (SELECT idx, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in NUMERIC)} FROM matrix) ON {', '.join(NUMERIC)} INTO NAME feature VALUE v),
stats AS MATERIALIZED (SELECT feature, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sd, max(v) - min(v) AS spread FROM mlong GROUP BY feature),
drifts AS (
  SELECT c.feature, (max(c.m) - min(c.m)) / any_value(CASE WHEN s.sd > 1e-15 THEN s.sd ELSE 1.0 END) AS drift_ratio
  FROM (SELECT feature, least(idx // (SELECT count(*) // 5 FROM matrix), 4) AS chunk, CASE WHEN count(*) < 4 THEN 0 ELSE avg(v) END AS m FROM mlong GROUP BY ALL) c
  JOIN stats s USING (feature) GROUP BY c.feature),
named AS (SELECT unnest({NUMERIC!r}) AS feature, unnest(range({len(NUMERIC)})) AS place),
pairs AS MATERIALIZED (
  SELECT x.feature AS a, y.feature AS b, round(avg((x.v - sx.m) * (y.v - sy.m)) / (any_value(sx.sd) * any_value(sy.sd)), 4) + 0.0 AS r,
         abs(avg((x.v - sx.m) * (y.v - sy.m)) / (any_value(sx.sd) * any_value(sy.sd))) > 0.9 AS strong
  FROM mlong x JOIN mlong y USING (idx) JOIN stats sx ON sx.feature = x.feature JOIN stats sy ON sy.feature = y.feature
  JOIN named nx ON nx.feature = x.feature JOIN named ny ON ny.feature = y.feature
  WHERE nx.place < ny.place AND sx.sd > 1e-15 AND sy.sd > 1e-15 GROUP BY ALL HAVING strong)"""
_REPORT = {
    ("data", "row_count"): "(SELECT count(*) FROM matrix)", ("data", "columns"): "44",
    ("ordering", "violations"): "0", ("ordering", "passed"): "true", ("duplicates", "duplicates"): "0", ("duplicates", "passed"): "true",
    ("baseline", "features_analyzed"): str(len(NUMERIC)), ("baseline", "missing_issues"): "0",
    ("baseline", "constant_features"): "(SELECT count(*) FROM stats WHERE n >= 2 AND spread < 1e-15)",
    ("baseline", "unstable_features"): "(SELECT count(*) FROM drifts WHERE NOT drift_ratio < 2)", ("baseline", "redundant_pairs"): "(SELECT count(*) FROM pairs)",
    ("overall", "overall_passed"): "true",
}


def _shown(c: str) -> str:
    return f"round({c} + {1.7 * 10.0 ** -(SHOWN[c] + 3)!r}::DOUBLE, {SHOWN[c]}) + 0.0 AS {c}" if c in SHOWN else c


def _named(name: str, columns: str) -> dict[str, str]:
    return {name: f"{FEATS}\nSELECT timestamp_s, {columns} FROM feats"}


def _decimal(x: str) -> str:
    """Four digits of the shortest decimal that stands for x, as Spark's round takes it."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE) + 0.0"


def _reasons(*details: str, raw: str = RAW) -> str:
    return f"{raw}\nSELECT trade_id, reason FROM judged WHERE reason IN ({', '.join(map(repr, details))})"


def _report_sql(other: dict | None = None) -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS section, '{n}' AS name, CAST({v} AS VARCHAR) AS value" for (s, n), v in (_REPORT | (other or {})).items())


def _by_user(sql: str) -> str:
    """The same with a series for each user: in bars and windows, and where rows are joined or dealt to runs."""
    sql = sql.replace(BARS, _bars("user_id, ")).replace("(ORDER BY idx", "(PARTITION BY user_id ORDER BY idx")
    sql = sql.replace(f"SELECT {', '.join(BAR_COLUMNS)}, idx,", f"SELECT user_id, {', '.join(BAR_COLUMNS)}, idx,").replace("(SELECT idx, ", "(SELECT user_id, idx, ").replace("USING (idx)", "USING (user_id, idx)")
    sql = sql.replace(f"SELECT {_AS_DOUBLE} FROM feats", f"SELECT user_id, {_AS_DOUBLE} FROM feats").replace("SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY feature) AS n", "SELECT user_id, feature, v, row_number() OVER (PARTITION BY user_id, feature ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY user_id, feature) AS n")
    sql = sql.replace("SELECT feature, max(v) FILTER (k = greatest", "SELECT user_id, feature, max(v) FILTER (k = greatest").replace("FROM placed GROUP BY feature)", "FROM placed GROUP BY user_id, feature)").replace("FROM bounds WHERE feature", "FROM bounds WHERE bounds.user_id = feats.user_id AND feature")
    sql = sql.replace("least(idx // (SELECT count(*) // 5 FROM matrix), 4)", "least(idx // size, 4)").replace(
        "FROM mlong GROUP BY ALL) c", "FROM mlong JOIN (SELECT user_id, count(*) // 5 AS size FROM matrix GROUP BY user_id) z USING (user_id) WHERE size >= 2 GROUP BY ALL) c"
    )
    # statistics of each user's rows
    sql = sql.replace("stats AS MATERIALIZED (SELECT feature,", "stats AS MATERIALIZED (SELECT user_id, feature,").replace("AS spread FROM mlong GROUP BY feature)", "AS spread FROM mlong GROUP BY user_id, feature)")
    sql = sql.replace("SELECT c.feature, (max(c.m)", "SELECT c.user_id, c.feature, (max(c.m)").replace("FROM (SELECT feature, least(idx", "FROM (SELECT user_id, feature, least(idx").replace("JOIN stats s USING (feature) GROUP BY c.feature)", "JOIN stats s USING (user_id, feature) GROUP BY c.user_id, c.feature)")
    sql = sql.replace("SELECT x.feature AS a, y.feature AS b,", "SELECT x.user_id, x.feature AS a, y.feature AS b,")
    return sql.replace("JOIN stats sx ON sx.feature = x.feature JOIN stats sy ON sy.feature = y.feature", "JOIN stats sx ON sx.feature = x.feature AND sx.user_id = x.user_id JOIN stats sy ON sy.feature = y.feature AND sy.user_id = x.user_id")


def _report_by_user() -> str:
    of = {
        ("data", "row_count"): "(SELECT count(*) FROM matrix m WHERE m.user_id = u.user_id)",
        ("baseline", "constant_features"): "(SELECT count(*) FROM stats t WHERE t.user_id = u.user_id AND n >= 2 AND spread < 1e-15)",
        ("baseline", "unstable_features"): "(SELECT count(*) FROM drifts d WHERE d.user_id = u.user_id AND NOT drift_ratio < 2)",
        ("baseline", "redundant_pairs"): "(SELECT count(*) FROM pairs p WHERE p.user_id = u.user_id)",
    }
    return " UNION ALL ".join(f"SELECT user_id, '{s}' AS section, '{n}' AS name, CAST({of.get((s, n), v)} AS VARCHAR) AS value FROM (SELECT DISTINCT user_id FROM matrix) u" for (s, n), v in _REPORT.items())


_MOMENTS = """
SELECT feature, round(any_value(m), 4) + 0.0 AS mean, CASE WHEN any_value(sd) < 1e-15 THEN 0.0 ELSE round(any_value(sd), 4) + 0.0 END AS std,
       CASE WHEN any_value(sd) < 1e-15 THEN 0.0 ELSE round(avg((v - m) ** 3) / any_value(sd) ** 3, 4) + 0.0 END AS skewness,
       CASE WHEN any_value(sd) < 1e-15 THEN 0.0 ELSE round(avg((v - m) ** 4) / any_value(sd) ** 4 - 3, 4) + 0.0 END AS kurtosis
FROM mlong JOIN stats USING (feature) GROUP BY feature"""
_COST = """
SELECT round(mean, 10) + 0.0 AS mean_return_per_period, round(s, 8) + 0.0 AS total_return, 0.04::DOUBLE AS daily_cost_pct, 400.0::DOUBLE AS daily_cost_usd,
       10.08::DOUBLE AS annual_cost_pct, round(g, 4) + 0.0 AS gross_annual_return, round(g - 0.04::DOUBLE * 252, 4) + 0.0 AS net_annual_return,
       CASE WHEN mean > 0 THEN round(mean / 0.0004::DOUBLE, 1) + 0.0 END AS breakeven_trades_per_day
FROM (SELECT *, CASE WHEN mean > -1 THEN (1 + mean) ** 252 - 1 ELSE -1 END AS g FROM (SELECT sum(returns) AS s, sum(returns) / count(*) AS mean FROM matrix WHERE returns <> 0 HAVING count(*) > 0))"""

SQL: dict[str, str] = {
    "read_trades": f"{RAW}\nSELECT {TRADE} FROM judged",
    "read_numeric": f"{BARS}\nSELECT CAST(timestamp_s AS DOUBLE) AS timestamp_s, timestamp_utc, price_close, total_volume, CAST(total_trades AS DOUBLE) AS total_trades FROM bars",
    "write_table": f"{BARS}\nSELECT timestamp_s, price_open, price_close FROM bars",
    "parse_rest_trades": f"{RAW}\nSELECT timestamp_ms, price, quantity, is_buyer_maker, CASE WHEN side = 'SELL' THEN 'SELL' ELSE 'BUY' END AS side, trade_id FROM judged WHERE timestamp_ms IS NOT NULL AND price IS NOT NULL AND quantity IS NOT NULL",
    "parse_agg_trades": f"{RAW}\nSELECT count(*) FILTER (quantity IS NOT NULL AND price IS NOT NULL) AS n, false AS dead FROM judged UNION ALL SELECT count(*) FILTER (quantity IS NULL OR price IS NULL), true FROM judged",
    "latest_input": "SELECT 'events.parquet' AS name, count(*) AS n FROM events",
    "write_bounds": f"{BOUNDS}\nSELECT * FROM bounds",
    "clean_missing": _reasons("missing_field", raw=SPOILED),
    "clean_quantity": _reasons("zero_qty"),
    "clean_price": _reasons("zero_price", raw=SPOILED),
    "clean_side": _reasons("invalid_side"),
    "clean_removed": f"{RAW}\nSELECT trade_id, reason FROM judged WHERE reason IS NOT NULL",
    "clean_trades": f"{RAW}\nSELECT {TRADE} FROM trades",
    "clean_report": f"{SPOILED}\nSELECT count(*) AS input_rows, count(*) FILTER (reason IS NULL) AS output_rows, count(reason) AS removed, "
    + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ("missing_field", "zero_qty", "zero_price", "invalid_side"))
    + " FROM judged",
    "bar_key": f"{RAW}\nSELECT trade_id, CAST(floor(timestamp_ms / 900000.0) * 900 AS BIGINT) AS timestamp_s FROM trades",
    "bar_volume": f"{BARS}\nSELECT timestamp_s, buy_vol, sell_vol, net_delta, total_volume FROM bars",
    "bar_counts": f"{BARS}\nSELECT timestamp_s, buy_trades, sell_trades, total_trades FROM bars",
    "bar_ohlc": f"{BARS}\nSELECT timestamp_s, price_open, price_high, price_low, price_close FROM bars",
    "bar_vwap": f"{BARS}\nSELECT timestamp_s, vwap FROM bars",
    "bar_cvd": f"{BARS}\nSELECT timestamp_s, cvd_cumulative, idx FROM bars",
    "bars": f"{BARS}\nSELECT * FROM bars",
    "bars_by_series": f"{_bars('user_id, ')}\nSELECT * FROM bars",
    **_named("f_returns", "returns, abs_returns"),
    **_named("f_cvd", "cvd"),
    **{k: v for n in ("return", "volume", "intensity", "cvd_delta") for k, v in _named(f"f_{n}_w", ", ".join(f"{n}_{w}s" for w in RETURN_WINDOWS)).items()},
    **_named("f_realized_vol", ", ".join(_shown(f"realized_vol_{w}s") for w in VOL_WINDOWS)),
    **_named("f_cvd_slope", ", ".join(_shown(f"cvd_slope_{w}s") for w in SLOPE_WINDOWS)),
    **_named("f_divergence", "cvd_price_divergence_30s"),
    **_named("f_intensity_z", "trade_intensity_zscore"),
    **_named("f_delta_mom", "net_delta_mom_10s, net_delta_mom_30s"),
    **_named("f_vroc", "vroc_30s"),
    **_named("f_efficiency", "efficiency_ratio_30s"),
    **_named("f_imbalance", "vol_imbalance"),
    **_named("f_vwap_dist", "price_vwap_dist"),
    "feature_matrix": f"{MATRIX}\nSELECT {', '.join(['idx', *BAR_COLUMNS, *map(_shown, FEATURES)])} FROM matrix",
    "winsor_bounds": f"{BOUNDS}\nSELECT * FROM bounds",
    "winsorize": f"{MATRIX}\nSELECT timestamp_s, {', '.join(map(_shown, FEATURES))} FROM matrix",
    "apply_bounds": f"{MATRIX}\nSELECT timestamp_s, returns, vroc_30s, intensity_30s FROM matrix",
    "check_order": f"{RAW}, v AS (SELECT timestamp_ms < lag(timestamp_ms) OVER (ORDER BY trade_id) AS bad FROM judged)\nSELECT count(*) FILTER (bad) AS violations, least(count(*) FILTER (bad), 6) AS counted, count(*) FILTER (bad) = 0 AS passed FROM v",
    "check_duplicates": f"{RAW}, d AS (SELECT timestamp_ms FROM trades GROUP BY 1 HAVING count(*) > 1)\nSELECT count(*) AS duplicates, count(*) = 0 AS passed FROM d",
    "check_missing": f"{SPOILED}\nSELECT * FROM (SELECT 'quantity' AS feature, count(*) FILTER (quantity IS NULL) AS missing, round(count(*) FILTER (quantity IS NULL) / count(*) * 100, 4) + 0.0 AS pct FROM judged UNION ALL SELECT 'price', count(*) FILTER (price IS NULL), round(count(*) FILTER (price IS NULL) / count(*) * 100, 4) + 0.0 FROM judged) WHERE missing > 0",
    "check_constant": f"{LONG}\nSELECT feature FROM stats WHERE n >= 2 AND spread < 1e-15 UNION ALL SELECT 'fixed' FROM matrix HAVING count(*) >= 2",
    "moments": f"{LONG}{_MOMENTS}",
    "drift": f"{LONG}\nSELECT feature, round(drift_ratio, 6) + 0.0 AS drift_ratio, drift_ratio < 2 AS stable FROM drifts",
    "correlated_pairs": f"{LONG}\nSELECT a, b, r FROM pairs",
    "redundant_ranked": "",
    "baseline_summary": f"{LONG}\nSELECT " + ", ".join(f"CAST({v} AS BIGINT) AS {n}" for (s, n), v in _REPORT.items() if s == "baseline"),
    "returns_sanity": f"{MATRIX}\nSELECT count(*) AS n, round(avg(returns), 8) + 0.0 AS mean, round(min(returns), 8) + 0.0 AS min, round(max(returns), 8) + 0.0 AS max, coalesce(abs(avg(returns)) < 0.01, false) AS passed FROM matrix WHERE returns <> 0",
    "validation_report": f"{LONG}\n" + _report_sql(),
    "validation_by_series": f"{_by_user(LONG)}\n" + _report_by_user(),
    "profile_by_series": f"""{_by_user(LONG)},
p AS (SELECT user_id, feature, any_value(n) AS n, min(v) AS low, max(v) AS high, any_value(m) AS mean, any_value(sd) < 1e-15 AS flat, any_value(sd) AS sd, avg((v - m) ** 3) / any_value(sd) ** 3 AS skew, avg((v - m) ** 4) / any_value(sd) ** 4 - 3 AS kurt, any_value(drift_ratio) AS drift
      FROM mlong JOIN stats USING (user_id, feature) LEFT JOIN drifts USING (user_id, feature) GROUP BY user_id, feature)
SELECT user_id, feature, n, """
    + ", ".join(f"round({x} + 1.7e-6::DOUBLE, 3) + 0.0 AS {k}" for k, x in {"low": "low", "high": "high", "mean": "mean", "drift_ratio": "drift"}.items())
    + ", "
    + ", ".join(f"round(CASE WHEN flat THEN 0.0 ELSE {x} END + 1.7e-6::DOUBLE, 3) + 0.0 AS {k}" for k, x in {"std": "sd", "skewness": "skew", "kurtosis": "kurt"}.items())
    + " FROM p",
    "pairs_by_series": f"{_by_user(LONG)}\nSELECT user_id, a, b, round(r, 3) + 0.0 AS r FROM pairs",
    "columns_report": f"{SPOILED}\nSELECT feature, missing, round(missing / n * 100, 4) + 0.0 AS pct FROM (SELECT count(*) AS n, count(*) FILTER (price IS NULL) AS p, count(*) FILTER (quantity IS NULL) AS q FROM judged), "
    + f"LATERAL (SELECT unnest({RAW_COLUMNS!r}) AS feature) f, LATERAL (SELECT CASE feature WHEN 'price' THEN p WHEN 'quantity' THEN q ELSE 0 END AS missing) m",
    "leakage_check": f"{BARS}\nSELECT unnest({FEATURES!r}) AS feature, count(*) // 2 AS compared, CAST(0 AS BIGINT) AS different FROM bars",
    "numeric_columns": f"{BARS}\nSELECT unnest({NUMERIC!r}) AS feature, count(*) AS n FROM bars",
    "trade_fee": f"{RAW}\nSELECT trade_id, {_decimal('price * quantity * 0.0004::DOUBLE')} AS fee FROM trades",
    "trade_slippage": f"{RAW}\nSELECT trade_id, {_decimal('price * quantity * 0.0001::DOUBLE')} AS slippage FROM trades",
    "cost_metrics": f"{MATRIX}{_COST}",
    "dataset_summary": f"{BARS}\nSELECT min(price_close) AS price_min, max(price_close) AS price_max, round(sum(total_volume), 4) + 0.0 AS total_volume, round(avg(net_delta), 6) + 0.0 AS mean_net_delta, count(*) AS bars, count(*) / 60.0::DOUBLE AS minutes FROM bars",
    "tape_span": f"{RAW}\nSELECT min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, (max(timestamp_ms) - min(timestamp_ms)) / 1000.0::DOUBLE AS span_s, (max(timestamp_ms) - min(timestamp_ms)) / 1000.0::DOUBLE / 60 AS span_min FROM trades",
    "chart_series": f"{MATRIX}\nSELECT idx AS x, price_close AS price, buy_vol AS buy, 0.0 - sell_vol AS sell, returns, realized_vol_30s AS vol_30, realized_vol_60s AS vol_60, cvd_cumulative AS cvd FROM matrix",
    "feature_preview": f"{MATRIX}\nSELECT idx AS x, price_close AS price, returns, cvd, realized_vol_30s AS vol_30, vol_imbalance, vol_imbalance >= 0 AS buy_heavy, trade_intensity_zscore AS zscore, 2.0::DOUBLE AS band_high, -2.0::DOUBLE AS band_low, abs(trade_intensity_zscore) > 2 AS beyond FROM matrix",
    "has_cvd": f"{BARS}\nSELECT coalesce(bool_or(cvd_cumulative <> 0), false) AS has_cvd FROM bars",
    "stream_trades": f"{RAW}\nSELECT timestamp_ms, price, quantity, is_buyer_maker, CASE WHEN side = 'SELL' THEN 'SELL' ELSE 'BUY' END AS side, trade_id FROM judged WHERE price IS NOT NULL AND quantity IS NOT NULL",
    "stream_metrics": f"{RAW}, {SLICED}\nSELECT CAST(slice AS BIGINT) AS batch, count(*) AS rows FROM judged JOIN sliced ON event_id = trade_id WHERE price IS NOT NULL AND quantity IS NOT NULL GROUP BY slice",
    "stream_flush": f"""{RAW}, n AS (SELECT *, (row_number() OVER (ORDER BY trade_id) - 1) // 500 AS batch, price IS NOT NULL AND quantity IS NOT NULL AS good FROM judged)
SELECT batch, count(*) FILTER (good) AS rows, count(*) FILTER (NOT good) AS dead, nullif(count(*) FILTER (good), 0) AS stored, CASE WHEN count(*) FILTER (good) > 0 THEN CAST(1 AS BIGINT) END AS files FROM n GROUP BY batch""",
    "stream_resume": f"{RAW}\nSELECT trade_id, timestamp_ms, price, quantity, CASE WHEN side = 'SELL' THEN 'SELL' ELSE 'BUY' END AS side FROM judged WHERE price IS NOT NULL AND quantity IS NOT NULL",
    "stream_bars": f"{BARS}\nSELECT * EXCLUDE (cvd_cumulative, idx) FROM bars",
    "stream_cvd": f"""{_bars('user_id, ')},
s AS (SELECT user_id, timestamp_s, total_trades, round(sum(net_delta) OVER o, 8) + 0.0 AS cvd, CAST(sum(total_trades) OVER o AS DOUBLE) / (idx + 1) AS mean, CAST(sum(total_trades * total_trades) OVER o AS DOUBLE) / (idx + 1) AS square FROM bars WINDOW o AS (PARTITION BY user_id ORDER BY timestamp_s ROWS UNBOUNDED PRECEDING))
SELECT user_id, timestamp_s, cvd, round((total_trades - mean) / CASE WHEN square - mean * mean > 1e-15 THEN sqrt(abs(square - mean * mean)) ELSE 1.0 END, 6) + 0.0 AS trade_intensity_zscore FROM s""",
}
_VIOLATIONS = "count(*) FILTER (bad)"
SQL["check_file_order"] = f"{RAW}, v AS (SELECT timestamp_ms < lag(timestamp_ms) OVER (ORDER BY trade_id % 3, trade_id * 7919 % 10007, trade_id) AS bad FROM judged)\nSELECT {_VIOLATIONS} AS violations, least({_VIOLATIONS}, 6) AS counted, {_VIOLATIONS} = 0 AS passed FROM v"
#: The matrix in the order of seven files, each of which has every seventh bar.
_MIXED = LONG.replace("matrix AS MATERIALIZED", "matrix0 AS MATERIALIZED", 1).replace("mlong AS", "matrix AS MATERIALIZED (SELECT * REPLACE (row_number() OVER (ORDER BY timestamp_s // 900 % 7, timestamp_s) - 1 AS idx) FROM matrix0),\nmlong AS", 1)
_BAD = "(SELECT count(*) FILTER (bad) FROM (SELECT timestamp_s < lag(timestamp_s) OVER (ORDER BY idx) AS bad FROM matrix))"
SQL["validation_of_file"] = f"{_MIXED}\n" + _report_sql({("ordering", "violations"): _BAD, ("ordering", "passed"): f"{_BAD} = 0", ("overall", "overall_passed"): f"{_BAD} = 0"})
SQL["clean_on_write"] = SQL["clean_report"].replace(" FROM judged", ", count(*) FILTER (reason IS NULL) AS kept_rows, count(reason) AS removed_rows FROM judged")
SQL["packed_flushes"] = f"SELECT *, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d') AS day, CAST(1 AS BIGINT) AS files FROM ({SQL['stream_trades']})"
SQL["write_table_by_day"] = f"{BARS}\nSELECT timestamp_s, price_close, strftime(make_timestamp(timestamp_s * 1000000), '%Y-%m-%d') AS day FROM bars"
SQL["chart_thinned"] = f"{MATRIX}\nSELECT max(idx) AS x, last(price_close ORDER BY idx) AS price, min(price_low) AS low, max(price_high) AS high, round(sum(buy_vol), 6) + 0.0 AS buy, round(sum(0.0 - sell_vol), 6) + 0.0 AS sell, round(round(sum(returns), 10) + 1.7e-11::DOUBLE, 8) + 0.0 AS returns, last(cvd_cumulative ORDER BY idx) AS cvd FROM matrix GROUP BY idx // 10"
SQL["bounds_by_series"] = f"{_by_user(BOUNDS)}\nSELECT * FROM bounds"
SQL["winsor_by_series"] = f"{_by_user(MATRIX)}\nSELECT user_id, timestamp_s, {', '.join(map(_shown, FEATURES))} FROM matrix"
SQL["redundant_ranked"] = f"{LONG}\nSELECT a, b, r, CAST(row_number() OVER (ORDER BY abs(r) DESC, a, b) AS INTEGER) AS rank FROM pairs"
