"""The registry of queries, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(value: Column) -> Column:
    """Six digits; adding zero turns -0.0 into 0.0."""
    return F.round(value, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def timed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def R(expr: str, name: str) -> str:  # noqa: N802
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0) AS {name}"


def T(expr: str, name: str) -> str:  # noqa: N802
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name}"


def erf(x: str) -> str:
    """The error function in SQL, by its series of positive terms."""
    term = f"exp(n * ln(2 * ({x}) * ({x})) + ln(abs({x})) - ((n + 1) * ln(2) + lgamma(n + 1.5) - 0.5 * ln(pi())))"
    return f"CASE WHEN ({x}) = 0 THEN 0.0 WHEN abs({x}) > 6 THEN sign({x}) ELSE sign({x}) * 2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 200), lambda n: {term})) END"


CANDLES = """candles AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS open_time, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
         min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume, count(*) AS trades
  FROM events WHERE value > 0 GROUP BY 1, 2)"""
GRID = CANDLES + """, bounds AS (SELECT symbol, min(open_time) AS lo, max(open_time) AS hi FROM candles GROUP BY symbol),
hours AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS open_time FROM bounds),
grid AS (SELECT h.symbol, h.open_time, c.open, c.high, c.low, c.close, c.volume, c.trades
  FROM hours h LEFT JOIN candles c ON c.symbol = h.symbol AND c.open_time = h.open_time)"""
RETURNS = GRID + """, ret AS (SELECT *, ln(close) - lag(ln(close)) OVER w AS ret FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY open_time))"""


def frame(n: int, last: int = 0) -> str:
    end = "CURRENT ROW" if last == 0 else f"{last} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {n} PRECEDING AND {end})"


def guarded(value: str, expr: str, n: int) -> str:
    w = frame(n - 1)
    return f"CASE WHEN count({value}) OVER {w} = {n} THEN {expr.format(w=w)} END"


_LAGS = ", ".join(f"lag(ret, {k - 1}) OVER w AS ret_lag{k}" if k > 1 else "ret AS ret_lag1" for k in range(1, 7))
FEATURES = RETURNS + f""", price AS (SELECT *, {_LAGS}, {guarded("ret", "sqrt(sum(ret * ret) OVER {w})", 6)} AS rv_6,
  {guarded("ret", "sqrt(sum(ret * ret) OVER {w})", 24)} AS rv_24, ln(1 + volume) - lag(ln(1 + volume)) OVER w AS volume_change,
  ln(lead(close) OVER w / close) AS target FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY open_time))"""
PRICE_COLUMNS = [*(f"ret_lag{k}" for k in range(1, 7)), "rv_6", "rv_24", "volume_change"]

NEWS = """raw_news AS (SELECT doc_id, text AS title, lang, source, (doc_id * 433) % 2592000 AS raw, ((n_chars % 201) - 100) / 100.0 AS score FROM documents),
news AS (SELECT doc_id, title, lang, source, CAST(score AS DOUBLE) AS score,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * (CASE WHEN doc_id % 17 = 0 THEN raw - raw % 86400
    WHEN source IN ('src5', 'src9') AND doc_id % 2 = 0 THEN raw - raw % 86400 + 18000 ELSE raw END) AS published,
  'https://www.' || source || '.example.com/' || CAST(doc_id % 700 AS VARCHAR) AS url,
  CASE WHEN score < -0.33 THEN 'negative' WHEN score > 0.33 THEN 'positive' ELSE 'neutral' END AS label FROM raw_news)"""
_EDGE = r"(?:^|$|[^\p{L}\p{N}_])"
TAGGED = NEWS + f""", tagged AS (SELECT *, regexp_matches(title, '{_EDGE}(?:that|und|les){_EDGE}', 'i') AS tag_a,
  regexp_matches(title, '{_EDGE}(?:from|des|que){_EDGE}', 'i') AS tag_b FROM news)"""
HOURLY = NEWS + """, hourly AS (SELECT date_trunc('hour', published) AS hour, count(*) AS n, avg(score) AS sent_mean,
  avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0.0 END) AS neg_share FROM news GROUP BY 1)"""
PREDICTIONS = FEATURES + """, cond AS (SELECT symbol, open_time, target AS y_true, ret_lag1,
    coalesce(avg(ret_lag1) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS mean,
    avg(ret_lag1) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS mean6,
    target IS NOT NULL AND rv_6 IS NOT NULL AND volume_change IS NOT NULL AS valid FROM price),
pred AS (SELECT symbol, open_time, y_true, m.model, CASE m.model WHEN 'zero' THEN 0.0 WHEN 'mean' THEN mean WHEN 'last' THEN ret_lag1 ELSE mean6 END AS y_pred
  FROM cond CROSS JOIN (VALUES ('zero'), ('mean'), ('last'), ('mean6')) m(model) WHERE valid)"""


def sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
