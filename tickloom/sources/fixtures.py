"""Market tables derived from the ``events`` and ``nation`` tables.

The SQL is common to Spark and DuckDB, so that results can be compared on the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START_MS = 1704067200000

VIEWS = {
    "fx_books": """
SELECT timestamp_ms, market_id, concat('M', CAST(market_id AS VARCHAR(10))) AS symbol,
  CASE WHEN r % 41 = 0 THEN NULL ELSE m - m*s/20000e0 END AS best_bid,
  m + m*s/20000e0 AS best_ask,
  CASE WHEN r % 41 = 0 THEN NULL ELSE m END AS mid,
  CASE WHEN r % 41 = 0 OR r % 29 = 0 THEN NULL ELSE s END AS spread_bps,
  20e0 + r % 90 AS best_bid_size_usd, 25e0 + r % 70 AS best_ask_size_usd,
  50e0 + 20e0*market_id + r % 100 AS two_sided_depth_5bps_usd,
  150e0 + 40e0*market_id + r % 300 AS two_sided_depth_10bps_usd,
  400e0 + 90e0*market_id + r % 700 AS two_sided_depth_25bps_usd,
  r % 31 = 0 AS is_stale,
  CASE WHEN r % 53 = 0 THEN NULL ELSE r % 41 <> 0 END AS is_usable,
  r % 31 = 0 AS is_inactive,
  CASE WHEN r % 17 = 0 THEN NULL ELSE (r * 37) % 9000 END AS book_update_age_ms,
  CASE WHEN r % 3 = 0 THEN NULL ELSE 0.0001e0 * (r % 7) END AS funding_rate,
  CASE WHEN r % 5 = 0 THEN NULL ELSE 0.00005e0 * (r % 9) END AS current_funding_rate,
  1000e0 + r % 500 AS open_interest,
  CASE WHEN r % 4 = 0 THEN NULL ELSE 100000e0 + r % 1000 END AS daily_quote_token_volume
FROM (SELECT 1704067200000 + event_id*1000 AS timestamp_ms, CAST(user_id % 5 + 5*k AS INT) AS market_id,
        event_id*7 + k*3 AS r, 100e0 + (event_id % 240)/240e0 + value/200e0 AS m,
        1e0 + (event_id % 11) + 0.5e0*k AS s
      FROM events CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) kk
                  CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 AS d) dd
      WHERE d = 0 OR event_id % 50 = 0) x
""",
    "fx_trades": """
SELECT timestamp_ms, market_id, concat('M', CAST(market_id AS VARCHAR(10))) AS symbol, trade_id,
  p + CASE WHEN is_maker_ask THEN 0.12e0 ELSE -0.12e0 END AS price,
  10e0 + value*3e0 AS usd_amount, is_maker_ask, type
FROM (SELECT 1704067200000 + event_id*1000 + 400 + 2500*d AS timestamp_ms, CAST(user_id % 5 + 5*k AS INT) AS market_id,
        event_id AS trade_id, value, 100e0 + (event_id % 240)/240e0 + value/200e0 AS p, event_id % 2 = 0 AS is_maker_ask,
        CASE WHEN event_type = 'error' AND event_id % 10 = 3 THEN 'liquidation' ELSE 'trade' END AS type
      FROM events CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) kk
                  CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 AS d) dd
      WHERE event_type IN ('purchase', 'error') AND (d = 0 OR event_id % 10 = 0)) x
""",
    "fx_markouts": """
SELECT timestamp_ms, market_id, symbol, trade_id, h AS horizon_s,
  ((trade_id*(h + 3) + market_id) % 41 - 17)/4e0 AS maker_markout_bps
FROM fx_trades CROSS JOIN (SELECT 1 AS h UNION ALL SELECT 5 AS h UNION ALL SELECT 30 AS h UNION ALL SELECT 60 AS h) hh
WHERE type = 'trade' AND (trade_id + h) % 9 <> 0
""",
    "fx_lifecycle": """
SELECT CAST(n_nationkey AS BIGINT) AS market_id,
  1704067200000 + CASE WHEN n_nationkey = 3 THEN 120000 ELSE 0 END AS first_active_at_ms,
  CASE WHEN n_nationkey = 7 THEN 1704067200000 + 600000 ELSE NULL END AS removed_at_ms
FROM nation WHERE n_nationkey < 9
""",
    "fx_level_updates": """
SELECT timestamp_ms, market_id, nonce,
  CASE WHEN nonce % 211 = 0 THEN NULL WHEN nonce % 97 = 0 THEN prev - 1 ELSE prev END AS begin_nonce,
  kind, CASE WHEN blank THEN NULL WHEN tick < 0 THEN 'bid' ELSE 'ask' END AS side,
  CASE WHEN blank THEN NULL ELSE 100e0 + tick*0.05e0 END AS price,
  CASE WHEN blank THEN NULL ELSE CAST((nonce + 3*k) % 7 AS DOUBLE) END AS size
FROM (SELECT *, (nonce*13 + k*4) % 21 - 10 AS tick, nonce % 90 = 0 AS blank,
        CASE WHEN nonce <> first_nonce AND nonce % 30 <> 0 THEN 'delta' WHEN nonce = first_nonce AND market_id = 4 THEN 'delta' ELSE 'snapshot' END AS kind
      FROM (SELECT 1704067200000 + event_id*1000 AS timestamp_ms, CAST(user_id % 5 AS INT) AS market_id, event_id AS nonce,
              lag(event_id) OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS prev, min(event_id) OVER (PARTITION BY user_id % 5) AS first_nonce
            FROM events) x
      CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k) kk) y
WHERE k = 0 OR (NOT blank AND (kind = 'snapshot' OR k <= nonce % 3))
""",
    "fx_messages": """
SELECT event_id, concat('{"type":"', CASE WHEN event_id % 19 = 0 THEN 'subscribed' ELSE 'update' END, '/trade","channel":"', CASE WHEN event_id % 23 = 0 THEN 'trade' ELSE concat('trade:', CAST(user_id % 5 AS VARCHAR(10))) END, '"', CASE
    WHEN event_id % 3 = 0 THEN concat(',"trades":[', one, ',7,', CASE WHEN event_id % 6 = 0 THEN bad ELSE one END, '],"liquidation_trades":', one)
    WHEN event_id % 3 = 1 THEN concat(',"liquidation_trades":', CASE WHEN event_id % 29 = 0 THEN bad ELSE one END)
    ELSE ',"trades":"none"' END, '}') AS trade_message,
  concat('{"type":"update/market_stats","channel":"market_stats:all","timestamp":', CAST(1704067200000 + event_id AS VARCHAR(20)), ',"market_stats":', CASE
    WHEN event_id % 3 = 0 THEN stats WHEN event_id % 3 = 1 THEN concat('{"', CAST(event_id AS VARCHAR(20)), '":', stats, ',"x":{"symbol":"no market"}}') ELSE concat('[', stats, ',3]') END, '}') AS stats_message,
  concat('{"type":"', CASE WHEN event_id % 11 = 0 THEN 'subscribed' ELSE 'update' END, '/order_book","channel":"order_book:', CAST(user_id % 5 AS VARCHAR(10)), '","timestamp":', CAST(1704067200000 + event_id AS VARCHAR(20)),
    ',"order_book":{"nonce":', CAST(event_id AS VARCHAR(20)), CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(',"begin_nonce":', CAST(event_id - 1 AS VARCHAR(20))) END, CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(',"bids":[{"price":"99.5","size":"', CAST(event_id % 4 AS VARCHAR(10)), '"}],"asks":[{"price":"100.5","size":"2"},{"price":"101","size":"0"}]') END, '}}') AS book_message
FROM (SELECT *, concat('{"trade_id":', CAST(event_id AS VARCHAR(20)), ',"market_id":', CAST(user_id % 7 AS VARCHAR(10)), ',"timestamp":', CAST(1704067200000 + event_id AS VARCHAR(20)), ',"price":"', CAST(100 + event_id % 9 AS VARCHAR(10)), '.5","size":"2"',
      CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"usd_amount":"7.25"' END, ',"is_maker_ask":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, CASE WHEN event_id % 5 = 0 THEN ',"type":"liquidation"' ELSE '' END, '}') AS one,
    concat('{"trade_id":', CAST(event_id AS VARCHAR(20)), ',"price":"', CASE WHEN event_id % 2 = 0 THEN 'abc' ELSE '' END, '"}') AS bad,
    concat('{"market_id":', CAST(user_id % 5 AS VARCHAR(10)), ',"symbol":"M', CAST(user_id % 5 AS VARCHAR(10)), '","mark_price":"', CAST(100 + event_id % 9 AS VARCHAR(10)), '.25","index_price":"","daily_price_change":-1.5}') AS stats
  FROM events) x
""",
    "fx_fills": """
SELECT event_id AS fill_id, 1704067200000 + event_id*1000 + 500 AS timestamp_ms, CAST(user_id % 5 AS INT) AS market_id,
  CASE WHEN (event_id*7) % 13 < 6 THEN 'ask' ELSE 'bid' END AS side,
  CAST(1 + event_id % 3 AS DOUBLE) / 10e0 AS qty_base, 100e0 + (event_id % 240)/240e0 + value/200e0 AS price
FROM events WHERE event_type = 'purchase'
""",
}


class Market:
    """The tables of one folder, as DataFrames that are made when first asked for."""

    start_ms = START_MS

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str, **frames: DataFrame) -> DataFrame:
        text = VIEWS[name].replace("{", "{{").replace("}", "}}")
        for frame in frames:
            text = text.replace(f"FROM {frame}", f"FROM {{{frame}}}")
        return self.spark.sql(text, **frames)

    @cached_property
    def end_ms(self) -> int:
        """End of the window: the last event."""
        return START_MS + 1000 * (self.table("events").agg(F.max("event_id")).first()[0] or 0)

    @cached_property
    def books(self) -> DataFrame:
        return self._view("fx_books", events=self.table("events"))

    @cached_property
    def trades(self) -> DataFrame:
        return self._view("fx_trades", events=self.table("events"))

    @cached_property
    def markouts(self) -> DataFrame:
        return self._view("fx_markouts", fx_trades=self.trades)

    @cached_property
    def lifecycle(self) -> DataFrame:
        return self._view("fx_lifecycle", nation=self.table("nation"))

    @cached_property
    def updates(self) -> DataFrame:
        return self._view("fx_level_updates", events=self.table("events"))

    @cached_property
    def messages(self) -> DataFrame:
        return self._view("fx_messages", events=self.table("events"))

    @cached_property
    def fills(self) -> DataFrame:
        return self._view("fx_fills", events=self.table("events"))
