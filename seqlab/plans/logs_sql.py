"""DuckDB oracles of :mod:`seqlab.plans.logs`, written directly over
``events`` (the generated log files hold exactly the events' information)."""

from __future__ import annotations

from seqlab.functions.codes import DIRECTION_CODES, FEATURE_COLS, MODE_CODES, SPEED_CODES
from seqlab.plans.logs import DEMO_ADDRESSES, LOG_FILE_ROWS, LOG_FILES


def _names(d):
    return "[" + ", ".join(f"'{k}'" for k in d) + "]"


_ADDR = "[" + ", ".join(f"'{a}'" for a in DEMO_ADDRESSES) + "]"


def _province(addr):
    return (f"CASE WHEN {addr} <> 'None' THEN substr({addr}, 3, CASE WHEN substr({addr}, 3, 2) IN ('黑龙', '内蒙') "
            f"THEN 3 ELSE 2 END) END")


def _city(addr):
    return (f"CASE WHEN {addr} <> 'None' THEN substr({addr}, 3 + CASE WHEN substr({addr}, 3, 2) IN ('黑龙', '内蒙') "
            f"THEN 3 ELSE 2 END) END")


_FILES = f"(SELECT greatest({LOG_FILES}, CAST(ceil(count(*) / {LOG_FILE_ROWS}.0) AS BIGINT)) FROM events)"

LOG_SESSIONS = f"""WITH lines AS (
  SELECT user_id % {_FILES} AS file, user_id, 1 AS k0, ts, event_id, event_type,
         CASE WHEN event_type = 'signup' THEN 'header' WHEN event_type = 'error' THEN 'off' ELSE 'on' END AS kind
  FROM events
  UNION ALL
  SELECT DISTINCT user_id % {_FILES}, user_id, 0, CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT), NULL, 'header'
  FROM events),
sc AS (
  SELECT *,
    SUM(CASE WHEN kind <> 'on' THEN 1 ELSE 0 END) OVER w - CASE WHEN kind <> 'on' THEN 1 ELSE 0 END AS run,
    SUM(CASE WHEN kind = 'off' THEN 1 ELSE 0 END) OVER w - CASE WHEN kind = 'off' THEN 1 ELSE 0 END AS off_grp,
    LAST_VALUE(CASE WHEN kind = 'header' THEN user_id END IGNORE NULLS) OVER w AS hdr_user,
    CASE WHEN kind = 'on' AND COALESCE(LAG(kind) OVER (PARTITION BY file ORDER BY user_id, k0, ts, event_id), '') <> 'on'
         THEN 1 ELSE 0 END AS start
  FROM lines
  WINDOW w AS (PARTITION BY file ORDER BY user_id, k0, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sq AS (
  SELECT *, SUM(start) OVER (PARTITION BY file ORDER BY user_id, k0, ts, event_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seq
  FROM sc),
runs AS (
  SELECT file, off_grp, run,
         COUNT(*) FILTER (WHERE kind = 'on') AS n_on,
         MIN(ts) FILTER (WHERE kind = 'on') AS start_ts,
         MAX(ts) FILTER (WHERE kind = 'on') AS end_ts,
         arg_min(seq, ts) FILTER (WHERE kind = 'on') AS seq,
         arg_min(hdr_user, ts) FILTER (WHERE kind = 'on') AS hdr_user,
         arg_min(event_type, ts) FILTER (WHERE kind = 'on') AS event_type,
         arg_min(event_id, ts) FILTER (WHERE kind = 'on') AS first_id,
         MAX(CASE WHEN kind = 'off' THEN 1 ELSE 0 END) AS has_off
  FROM sq GROUP BY file, off_grp, run),
grp AS (
  SELECT *, MAX(has_off) OVER (PARTITION BY file, off_grp) AS closed,
         ROW_NUMBER() OVER (PARTITION BY file, off_grp ORDER BY CASE WHEN n_on > 0 THEN 0 ELSE 1 END, run DESC) AS rk
  FROM runs),
s AS (SELECT *, {_ADDR}[hdr_user % 5 + 1] AS addr FROM grp WHERE closed = 1 AND n_on > 0 AND rk = 1)
SELECT CAST(hdr_user AS VARCHAR) AS "user",
  CAST(file AS VARCHAR) || '-' || CAST(seq AS VARCHAR) AS session_id,
  CAST(n_on AS INTEGER) AS n_on,
  strftime(start_ts, '%Y-%m-%d %H:%M') AS start, strftime(end_ts, '%Y-%m-%d %H:%M') AS "end",
  {_names(SPEED_CODES)}[first_id % 6 + 1] AS speed,
  {_names(DIRECTION_CODES)}[(first_id // 6) % 3 + 1] AS direction,
  {_names(MODE_CODES)}[(first_id // 18) % 5 + 1] AS mode,
  event_type AS raw6, CAST(22 + first_id % 8 AS VARCHAR) AS temp,
  {_province('addr')} AS province, {_city('addr')} AS city
FROM s"""

LOG_ETL = f"""WITH ls AS ({LOG_SESSIONS}),
g AS (SELECT *, CAST(COUNT(*) OVER (PARTITION BY "user") AS INTEGER) AS n_sessions FROM ls WHERE n_on > 1),
w0 AS (SELECT {_ADDR}[user_id % 5 + 1] AS addr, ts, value, event_id FROM events WHERE event_type = 'view'),
w AS (SELECT {_city('addr')} AS w_city, strftime(ts, '%Y-%m-%d') AS w_date, strftime(ts, '%H:%M:%S') AS w_time,
             CAST(CAST(floor(value) AS BIGINT) % 15 + 15 AS VARCHAR) AS w_temp, CAST(event_id AS VARCHAR) AS w4,
             'w5' AS w5, 'w6' AS w6, 'w7' AS w7,
             strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS weather_ts
      FROM w0 WHERE addr <> 'None'),
j AS (
  SELECT g.*, w.w_date, w.w_time, w.w_temp, w.w4, w.w5, w.w6, w.w7,
    ROW_NUMBER() OVER (PARTITION BY g.session_id ORDER BY
      abs(epoch_us(w.weather_ts) - epoch_us(strptime(g.start, '%Y-%m-%d %H:%M'))), w.weather_ts,
      w.w_date, w.w_time, w.w_temp, w.w4, w.w5, w.w6, w.w7) AS rk
  FROM g LEFT JOIN w ON g.city = w.w_city AND substr(g.start, 1, 10) = w.w_date
  WHERE g.n_sessions > 3)
SELECT * EXCLUDE (rk) FROM j WHERE rk = 1"""


def _code(col, d):
    return f"CAST(list_position({_names(d)}, {col}) - 1 AS INTEGER)"


LOG_DATASET = f"""WITH e AS ({LOG_ETL}),
f AS (
  SELECT "user", session_id,
    temp AS temp1, LEAD(temp, 1) OVER w AS temp2, LEAD(temp, 2) OVER w AS temp3,
    speed AS speed1, LEAD(speed, 1) OVER w AS speed2, LEAD(speed, 2) OVER w AS speed3,
    direction AS direction1, LEAD(direction, 1) OVER w AS direction2, LEAD(direction, 2) OVER w AS direction3,
    mode AS mode1, LEAD(mode, 1) OVER w AS mode2, LEAD(mode, 2) OVER w AS mode3,
    LEAD(w_temp, 3) OVER w AS weather, LEAD(speed, 3) OVER w AS t_speed, LEAD(direction, 3) OVER w AS t_direction,
    LEAD(mode, 3) OVER w AS t_mode, LEAD(temp, 3) OVER w AS t_temp, LEAD(1, 3) OVER w AS full_
  FROM e WINDOW w AS (PARTITION BY "user" ORDER BY session_id)),
k AS (
  SELECT * FROM f WHERE full_ IS NOT NULL
    AND CAST(temp1 AS INTEGER) BETWEEN 24 AND 28 AND CAST(temp2 AS INTEGER) BETWEEN 24 AND 28
    AND CAST(temp3 AS INTEGER) BETWEEN 24 AND 28 AND CAST(t_temp AS INTEGER) BETWEEN 24 AND 28
    AND weather IS NOT NULL AND trim(weather) <> ''),
c AS (
  SELECT "user", session_id,
    CAST(temp1 AS INTEGER) - 24 AS temp1, CAST(temp2 AS INTEGER) - 24 AS temp2, CAST(temp3 AS INTEGER) - 24 AS temp3,
    {_code('speed1', SPEED_CODES)} AS speed1, {_code('speed2', SPEED_CODES)} AS speed2,
    {_code('speed3', SPEED_CODES)} AS speed3,
    {_code('direction1', DIRECTION_CODES)} AS direction1, {_code('direction2', DIRECTION_CODES)} AS direction2,
    {_code('direction3', DIRECTION_CODES)} AS direction3,
    {_code('mode1', MODE_CODES)} AS mode1, {_code('mode2', MODE_CODES)} AS mode2, {_code('mode3', MODE_CODES)} AS mode3,
    CAST(weather AS INTEGER) AS weather,
    (CAST(t_temp AS INTEGER) - 24) * 90 + {_code('t_speed', SPEED_CODES)} * 15
      + {_code('t_direction', DIRECTION_CODES)} * 5 + {_code('t_mode', MODE_CODES)} AS label
  FROM k)
SELECT "user", session_id,
  concat_ws(',', {', '.join(f'CAST({c} AS VARCHAR)' for c in FEATURE_COLS)}) || '#' || CAST(label AS VARCHAR) AS line
FROM c"""

ORACLES = {
    "log_sessions": LOG_SESSIONS,
    "log_etl": LOG_ETL,
    "log_dataset": LOG_DATASET,
}
