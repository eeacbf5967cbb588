"""DuckDB oracles of :mod:`seqlab.plans.events` (plain windows per user)."""

from __future__ import annotations

_EVENT_SCAN = """
ev AS (
  SELECT user_id, ts, event_id, event_type, value,
         CASE WHEN event_type = 'signup' THEN 'header' WHEN event_type = 'error' THEN 'off' ELSE 'on' END AS kind
  FROM events),
sc AS (
  SELECT *,
    SUM(CASE WHEN kind <> 'on' THEN 1 ELSE 0 END) OVER w - CASE WHEN kind <> 'on' THEN 1 ELSE 0 END AS run,
    SUM(CASE WHEN kind = 'off' THEN 1 ELSE 0 END) OVER w - CASE WHEN kind = 'off' THEN 1 ELSE 0 END AS off_grp,
    LAST_VALUE(CASE WHEN kind = 'header' THEN event_id END IGNORE NULLS) OVER w AS signup_id,
    CASE WHEN kind = 'on' AND COALESCE(LAG(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') <> 'on'
         THEN 1 ELSE 0 END AS start
  FROM ev
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sq AS (
  SELECT *, SUM(start) OVER (PARTITION BY user_id ORDER BY ts, event_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seq
  FROM sc),
runs AS (
  SELECT user_id, off_grp, run,
         COUNT(*) FILTER (WHERE kind = 'on') AS n_on,
         MIN(ts) FILTER (WHERE kind = 'on') AS start_ts,
         MAX(ts) FILTER (WHERE kind = 'on') AS end_ts,
         arg_min(seq, ts) FILTER (WHERE kind = 'on') AS seq,
         arg_min(signup_id, ts) FILTER (WHERE kind = 'on') AS signup_id,
         arg_min(event_type, ts) FILTER (WHERE kind = 'on') AS event_type,
         arg_min(value, ts) FILTER (WHERE kind = 'on') AS value,
         MAX(CASE WHEN kind = 'off' THEN 1 ELSE 0 END) AS has_off
  FROM sq GROUP BY user_id, off_grp, run)"""

_SESSION_COLS = """user_id, CAST(user_id AS VARCHAR) || '-' || CAST(seq AS VARCHAR) AS session_id,
  CAST(seq AS INTEGER) AS seq, CAST(n_on AS INTEGER) AS n_on, start_ts, end_ts, signup_id, event_type, value"""

SESSIONS_CARRY = f"""WITH {_EVENT_SCAN},
grp AS (
  SELECT *, MAX(has_off) OVER (PARTITION BY user_id, off_grp) AS closed,
         ROW_NUMBER() OVER (PARTITION BY user_id, off_grp ORDER BY CASE WHEN n_on > 0 THEN 0 ELSE 1 END, run DESC) AS rk
  FROM runs)
SELECT {_SESSION_COLS} FROM grp WHERE closed = 1 AND n_on > 0 AND rk = 1"""

SESSIONS_CLEAN = f"""WITH {_EVENT_SCAN}
SELECT {_SESSION_COLS} FROM runs WHERE n_on > 0 AND has_off = 1"""

MIN_EVENTS = f"SELECT * FROM ({SESSIONS_CARRY}) s WHERE n_on > 1"

MIN_GROUP = f"""SELECT * FROM (
  SELECT *, CAST(COUNT(*) OVER (PARTITION BY user_id) AS INTEGER) AS n_sessions FROM ({MIN_EVENTS}) m) g
WHERE n_sessions > 3"""

SESSION_FEATURES = f"""WITH g AS (SELECT * EXCLUDE (n_sessions) FROM ({MIN_GROUP}) x),
f AS (
  SELECT user_id, session_id,
    n_on AS n_on1, LEAD(n_on, 1) OVER w AS n_on2, LEAD(n_on, 2) OVER w AS n_on3,
    event_type AS event_type1, LEAD(event_type, 1) OVER w AS event_type2, LEAD(event_type, 2) OVER w AS event_type3,
    value AS value1, LEAD(value, 1) OVER w AS value2, LEAD(value, 2) OVER w AS value3,
    LEAD(event_type, 3) OVER w AS next_event_type, LEAD(value, 3) OVER w AS next_value,
    LEAD(n_on, 3) OVER w AS next_n_on, LEAD(1, 3) OVER w AS full_
  FROM g WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT * EXCLUDE (full_) FROM f WHERE full_ IS NOT NULL"""

SLIDING_FEATURES = """SELECT * EXCLUDE (full_) FROM (
  SELECT user_id, event_id, value AS value1, LEAD(value, 1) OVER w AS value2, LEAD(value, 2) OVER w AS value3,
         LEAD(value, 3) OVER w AS target, LEAD(1, 3) OVER w AS full_
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) t
WHERE full_ IS NOT NULL"""

SLIDING_LEXICAL = """SELECT * EXCLUDE (full_) FROM (
  SELECT user_id, event_id, value AS value1, LEAD(value, 1) OVER w AS value2, LEAD(value, 2) OVER w AS value3,
         LEAD(value, 3) OVER w AS target, LEAD(1, 3) OVER w AS full_
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY CAST(event_id AS VARCHAR))) t
WHERE full_ IS NOT NULL"""

ORACLES: dict[str, str] = {
    "sessionize": SESSIONS_CARRY,
    "sessionize_clean": SESSIONS_CLEAN,
    "min_events": MIN_EVENTS,
    "min_group": MIN_GROUP,
    "session_features": SESSION_FEATURES,
    "sliding_features": SLIDING_FEATURES,
    "sliding_lexical": SLIDING_LEXICAL,
}

_NEAREST_BASE = """WITH p AS (SELECT event_id, user_id, ts, value, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, CAST(ts AS DATE) AS view_day, ts AS view_ts, event_id AS view_id, value AS view_value
      FROM events WHERE event_type = 'view'),
c AS (SELECT p.*, v.view_ts, v.view_id, v.view_value, abs(epoch_us(p.ts) - epoch_us(v.view_ts)) AS gap,
             ROW_NUMBER() OVER (PARTITION BY p.event_id
                                ORDER BY abs(epoch_us(p.ts) - epoch_us(v.view_ts)), v.view_ts, v.view_id, v.view_value) AS rk
      FROM p LEFT JOIN v ON p.user_id = v.user_id AND p.day = v.view_day)"""

NEAREST = _NEAREST_BASE + """
SELECT event_id, user_id, ts, value, day, view_ts, view_id, view_value FROM c WHERE rk = 1"""

NEAREST_GAP = _NEAREST_BASE + """
SELECT event_id, user_id, ts, value, day,
       CASE WHEN gap <= 3600000000 THEN view_ts END AS view_ts,
       CASE WHEN gap <= 3600000000 THEN view_id END AS view_id,
       CASE WHEN gap <= 3600000000 THEN view_value END AS view_value
FROM c WHERE rk = 1"""

GROUP_SORTED = f"""SELECT user_id, session_id, start_ts,
  CAST(ROW_NUMBER() OVER (ORDER BY CAST(user_id AS VARCHAR) || ' ' || strftime(start_ts, '%Y-%m-%d %H:%M:%S.%f')) AS BIGINT) AS pos
FROM ({SESSIONS_CARRY}) s"""

PERIOD_FILTER = """SELECT * FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1996-11-01'"""

ORACLES.update({
    "nearest_join": NEAREST,
    "nearest_join_scan": NEAREST,
    "nearest_join_gap": NEAREST_GAP,
    "nearest_join_gap_scan": NEAREST_GAP,
    "group_sorted": GROUP_SORTED,
    "period_filter": PERIOD_FILTER,
})
