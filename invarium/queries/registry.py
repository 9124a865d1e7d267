"""Registry of queries and their DuckDB SQL over the driver's tables."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Calls as ``sources.tables.event_calls`` derives them.
CALLS = """
calls AS (
  SELECT event_id::VARCHAR AS func_call_id, event_id, event_type AS function, user_id % 4 AS process_id, user_id % 16 AS thread_id,
         epoch_us(ts) * 1000 AS start_ns, epoch_us(ts) * 1000 + round(value * 60)::BIGINT * 1000000000 AS end_ns,
         datediff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS step, user_id AS obj_id, props AS args_json, value,
         CASE datediff('day', DATE '2024-01-01', ts::DATE) % 3 WHEN 0 THEN 'init' WHEN 1 THEN 'training' ELSE 'evaluation' END AS stage
  FROM events
)"""

#: Values of the user's level over time, its states and changes.
LEVELS = """
lv AS (
  SELECT user_id % 4 AS process_id, user_id::VARCHAR AS var_name, 'level' AS attr, floor(value / 100)::BIGINT::VARCHAR AS value_json,
         epoch_us(ts) * 1000 AS time_ns, event_id AS record_no
  FROM events
), lw AS (
  SELECT *, CASE WHEN lag(value_json) OVER w IS DISTINCT FROM value_json OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS changed
  FROM lv WINDOW w AS (PARTITION BY process_id, var_name ORDER BY time_ns, record_no)
), li AS (
  SELECT *, sum(changed) OVER (PARTITION BY process_id, var_name ORDER BY time_ns, record_no ROWS UNBOUNDED PRECEDING)::BIGINT AS state_no FROM lw
), ls AS (
  SELECT process_id, var_name, attr, state_no, min(value_json) AS value_json, min(time_ns) AS start_ns, count(*)::BIGINT AS n_records
  FROM li GROUP BY ALL
), states AS (
  SELECT *, coalesce(lead(start_ns) OVER (PARTITION BY process_id, var_name ORDER BY state_no), (SELECT max(time_ns) FROM lv)) AS end_ns FROM ls
), changes AS (
  SELECT process_id, var_name, attr, state_no, start_ns AS change_ns, lag(value_json) OVER w AS old_json, value_json AS new_json
  FROM states WINDOW w AS (PARTITION BY process_id, var_name ORDER BY state_no)
  QUALIFY state_no > 1
)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name; ``sql`` is the same query for DuckDB."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add
