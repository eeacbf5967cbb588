"""DuckDB oracles of :mod:`seqlab.plans.appliance`."""

from __future__ import annotations

from seqlab.functions.codes import DIRECTION_CODES, FEATURE_COLS, MODE_CODES, NOMINAL_FEATURES, SPEED_CODES


def _names(d):
    return "[" + ", ".join(f"'{k}'" for k in d) + "]"


WINDOWS = f"""WITH app AS (
  SELECT user_id, ts, event_id,
         CAST(22 + event_id % 8 AS INTEGER) AS t_,
         {_names(SPEED_CODES)}[event_id % 6 + 1] AS s_,
         {_names(DIRECTION_CODES)}[(event_id // 6) % 3 + 1] AS d_,
         {_names(MODE_CODES)}[(event_id // 18) % 5 + 1] AS m_,
         CASE WHEN event_type <> 'click' THEN CAST(floor(value) AS INTEGER) END AS w_
  FROM events),
win AS (
  SELECT user_id, event_id,
    t_ AS temp1, LEAD(t_, 1) OVER w AS temp2, LEAD(t_, 2) OVER w AS temp3,
    s_ AS speed1, LEAD(s_, 1) OVER w AS speed2, LEAD(s_, 2) OVER w AS speed3,
    d_ AS direction1, LEAD(d_, 1) OVER w AS direction2, LEAD(d_, 2) OVER w AS direction3,
    m_ AS mode1, LEAD(m_, 1) OVER w AS mode2, LEAD(m_, 2) OVER w AS mode3,
    LEAD(w_, 3) OVER w AS weather, LEAD(s_, 3) OVER w AS speed, LEAD(d_, 3) OVER w AS direction,
    LEAD(m_, 3) OVER w AS mode, LEAD(t_, 3) OVER w AS temp, LEAD(1, 3) OVER w AS full_
  FROM app WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT * EXCLUDE (full_) FROM win WHERE full_ IS NOT NULL"""

RANGE_FILTER = f"""SELECT * FROM ({WINDOWS}) x
WHERE temp1 BETWEEN 24 AND 28 AND temp2 BETWEEN 24 AND 28 AND temp3 BETWEEN 24 AND 28
  AND temp BETWEEN 24 AND 28 AND weather IS NOT NULL"""


def _code(col, d):
    return f"CAST(list_position({_names(d)}, {col}) - 1 AS INTEGER) AS {col}"


ENCODE = f"""SELECT user_id, event_id,
  CAST(temp1 - 24 AS INTEGER) AS temp1, CAST(temp2 - 24 AS INTEGER) AS temp2, CAST(temp3 - 24 AS INTEGER) AS temp3,
  {_code('speed1', SPEED_CODES)}, {_code('speed2', SPEED_CODES)}, {_code('speed3', SPEED_CODES)},
  {_code('direction1', DIRECTION_CODES)}, {_code('direction2', DIRECTION_CODES)}, {_code('direction3', DIRECTION_CODES)},
  {_code('mode1', MODE_CODES)}, {_code('mode2', MODE_CODES)}, {_code('mode3', MODE_CODES)},
  weather, {_code('speed', SPEED_CODES)}, {_code('direction', DIRECTION_CODES)}, {_code('mode', MODE_CODES)},
  CAST(temp - 24 AS INTEGER) AS temp
FROM ({RANGE_FILTER}) r"""

LABELLED = f"SELECT *, CAST(temp * 90 + speed * 15 + direction * 5 + mode AS INTEGER) AS label FROM ({ENCODE}) e"

COMBINE = f"""SELECT event_id, temp, speed, direction, mode, label,
  CAST((label // 90) % 5 AS INTEGER) AS temp_back, CAST((label // 15) % 6 AS INTEGER) AS speed_back,
  CAST((label // 5) % 3 AS INTEGER) AS direction_back, CAST(label % 5 AS INTEGER) AS mode_back
FROM ({LABELLED}) l"""

SPLIT = f"""SELECT event_id, label,
  CAST((label // 90) % 5 AS INTEGER) AS temp, CAST((label // 15) % 6 AS INTEGER) AS speed,
  CAST((label // 5) % 3 AS INTEGER) AS direction, CAST(label % 5 AS INTEGER) AS mode
FROM ({LABELLED}) l"""

TARGET = f"SELECT user_id, event_id, {', '.join(FEATURE_COLS)}, temp AS label FROM ({ENCODE}) e"

INDEX = f"""SELECT label, CAST(DENSE_RANK() OVER (ORDER BY label) - 1 AS INTEGER) AS label_index
FROM (SELECT DISTINCT label FROM ({LABELLED}) l) d"""

DICTIONARY = f"""SELECT label_index, label, txt AS label_text,
  CAST(label_index AS VARCHAR) || ':{{' || txt || '}}' AS line
FROM (SELECT label_index, label,
        CAST((label // 90) % 5 AS VARCHAR) || ',' || CAST(label % 5 AS VARCHAR) || ','
        || CAST((label // 5) % 3 AS VARCHAR) || ',' || CAST((label // 15) % 6 AS VARCHAR) AS txt
      FROM ({INDEX}) i) t"""

CLASS_COUNT = f"SELECT CAST(COUNT(DISTINCT label) AS BIGINT) AS n_classes FROM ({LABELLED}) l"

FORMAT_DATASET = f"""SELECT l.event_id,
  concat_ws(',', {', '.join(f'CAST(l.{c} AS VARCHAR)' for c in FEATURE_COLS)}) || '#' || CAST(i.label_index AS VARCHAR) AS line
FROM ({LABELLED}) l JOIN ({INDEX}) i ON l.label = i.label"""

FORMAT_LIBSVM = f"""SELECT event_id,
  CAST(label AS VARCHAR) || {' || '.join(f"' {i + 1}:' || CAST({c} AS VARCHAR)" for i, c in enumerate(FEATURE_COLS))} AS line
FROM ({LABELLED}) l"""

CATEGORY_INDEX = """SELECT event_type, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, event_type) - 1 AS INTEGER) AS event_type_idx, n
FROM (SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type) g"""


def _one_hot(drop_last: bool) -> str:
    size = "k.n_cat - 1" if drop_last else "k.n_cat"
    return f"""WITH idx AS ({CATEGORY_INDEX}),
k AS (SELECT COUNT(*) AS n_cat FROM idx)
SELECT e.event_id, e.event_type,
  [CAST(CASE WHEN i = idx.event_type_idx THEN 1 ELSE 0 END AS DOUBLE) FOR i IN range({size})] AS onehot
FROM events e JOIN idx ON e.event_type = idx.event_type CROSS JOIN k"""


def _indexed(source: str, cols) -> tuple[str, str, list[str]]:
    """CTEs giving every column's category index (frequency desc, then text)
    and its number of categories, joined to the rows of ``source``."""
    ctes, joins, vecs = [f"src AS ({source})"], [], []
    for c in cols:
        ctes.append(f"""i_{c} AS (SELECT v, ROW_NUMBER() OVER (ORDER BY n DESC, CAST(v AS VARCHAR)) - 1 AS ix,
                 COUNT(*) OVER () AS k
          FROM (SELECT {c} AS v, COUNT(*) AS n FROM src GROUP BY {c}) g)""")
        joins.append(f"JOIN i_{c} ON src.{c} = i_{c}.v")
        vecs.append(f"[CAST(CASE WHEN j = i_{c}.ix THEN 1 ELSE 0 END AS DOUBLE) FOR j IN range(i_{c}.k)]")
    return ",\n".join(ctes), " ".join(joins), vecs


def _one_hot_dataset() -> str:
    ctes, joins, vecs = _indexed(ENCODE, FEATURE_COLS)
    tail = "[CAST(src.speed AS DOUBLE), CAST(src.direction AS DOUBLE), CAST(src.mode AS DOUBLE), CAST(src.temp AS DOUBLE)]"
    return f"""WITH {ctes}
SELECT src.event_id, list_concat({', '.join(vecs)}, {tail}) AS "values"
FROM src {joins}"""


def _assemble_row() -> str:
    nominal = list(NOMINAL_FEATURES)
    ctes, joins, vecs = _indexed(ENCODE, nominal)
    numeric = "[" + ", ".join(f"CAST(src.{c} AS DOUBLE)" for c in
                              ["temp1", "temp2", "temp3", "speed1", "speed2", "speed3", "weather"]) + "]"
    return f"""WITH {ctes}
SELECT src.event_id, list_concat({numeric}, {', '.join(vecs)}) AS features, src.temp AS label
FROM src {joins}"""


SPLIT_HASH = "SELECT event_id, (event_id * 7919 + 104729) % 100 < 70 AS is_train FROM events"

PARSE_ADDRESS = """WITH rec AS (
  SELECT c.c_custkey, c.c_name,
         CASE WHEN c.c_custkey % 10 = 0 THEN 'None' ELSE 'CN' || n.n_name || c.c_mktsegment END AS address
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
p AS (SELECT *, CASE WHEN substr(address, 3, 2) IN ('AL', 'AR') THEN 3 ELSE 2 END AS plen FROM rec)
SELECT c_custkey, substr(c_name, 4) AS "user", address,
  CASE WHEN address <> 'None' THEN substr(address, 3, plen) END AS province,
  CASE WHEN address <> 'None' THEN substr(address, 3 + plen) END AS city
FROM p"""

ORACLES = {
    "range_filter": RANGE_FILTER,
    "encode_categories": ENCODE,
    "combine_labels": COMBINE,
    "split_label": SPLIT,
    "target_label": TARGET,
    "index_labels": INDEX,
    "label_dictionary": DICTIONARY,
    "class_count": CLASS_COUNT,
    "format_dataset": FORMAT_DATASET,
    "format_libsvm": FORMAT_LIBSVM,
    "category_index": CATEGORY_INDEX,
    "one_hot": _one_hot(False),
    "one_hot_drop_last": _one_hot(True),
    "one_hot_dataset": _one_hot_dataset(),
    "assemble_row": _assemble_row(),
    "split_hash": SPLIT_HASH,
    "parse_address": PARSE_ADDRESS,
}
