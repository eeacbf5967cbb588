"""DuckDB oracles of :mod:`seqlab.plans.models`: what SQL can state of a
trained model (split sizes, classes, trees) and of rules that must agree with it."""

from __future__ import annotations

from seqlab.functions.codes import FEATURE_COLS
from seqlab.plans.appliance_sql import DICTIONARY, FORMAT_LIBSVM, INDEX, LABELLED

_TRAIN = "(event_id * 7919 + 104729) % 100 < 70"


def _report(algorithm: str, dataset: str, classes: str, trees: str, train: str, rows: str, label: str = "label") -> str:
    return f"""SELECT '{algorithm}' AS algorithm, '{dataset}' AS dataset, CAST({classes} AS INTEGER) AS n_classes,
  CAST({trees} AS INTEGER) AS n_trees, COUNT(*) FILTER ({train}) AS n_train, COUNT(*) FILTER (NOT ({train})) AS n_test,
  CAST((SELECT SUM(c) - MAX(c) FROM (SELECT {label} AS y, COUNT(*) AS c FROM ({rows}) t WHERE {train} GROUP BY y)) AS BIGINT) AS majority_misses,
  TRUE AS misses_fewer
FROM ({rows}) l"""


def _events(algorithm: str, label: str = "label", dataset: str = "events:combined", trees: str = "NULL") -> str:
    return _report(algorithm, dataset, f"COUNT(DISTINCT {label})", trees, _TRAIN, LABELLED, label)


_STUMP = FEATURE_COLS[:12]
_VALUES = f"[{', '.join(f'CAST({c} AS DOUBLE)' for c in _STUMP)}]"


def _stump(rows: str) -> str:
    """CTEs up to ``best`` (f, threshold, n_left, n_right, gain) and ``side`` (is_left, cls) of the first
    gini split of ``rows`` (event_id, x, y)."""
    return f"""base AS ({rows}),
e AS (SELECT y, unnest(x) AS v, unnest(range(12)) AS f FROM base),
cnt AS (SELECT f, v, y, COUNT(*) AS c FROM e GROUP BY f, v, y),
cand AS (SELECT f, v, LEAD(v) OVER (PARTITION BY f ORDER BY v) AS v2 FROM (SELECT DISTINCT f, v FROM cnt)),
tot AS (SELECT y, COUNT(*) AS t FROM base GROUP BY y),
allr AS (SELECT SUM(t) AS n, SUM(t * t) AS tt FROM tot),
lft AS (SELECT k.f, k.v, k.v2, cnt.y, SUM(cnt.c) AS c FROM cand k JOIN cnt ON cnt.f = k.f AND cnt.v <= k.v WHERE k.v2 IS NOT NULL GROUP BY ALL),
gains AS (SELECT f, (v + v2) / 2 AS threshold, SUM(c) AS nl, SUM(c * c) AS sl, SUM(c * t) AS ct
          FROM lft JOIN tot ON tot.y = lft.y GROUP BY f, v, v2),
best AS (SELECT f, threshold, nl AS n_left, n - nl AS n_right,
           (sl::DOUBLE / nl::DOUBLE + (tt - 2 * ct + sl)::DOUBLE / (n - nl)::DOUBLE) / n::DOUBLE - tt::DOUBLE / n::DOUBLE / n::DOUBLE AS gain
         FROM gains, allr ORDER BY round(gain, 12) DESC, f, threshold LIMIT 1),
side AS (SELECT is_left, y AS cls, c FROM (SELECT x[f + 1] <= threshold AS is_left, y, COUNT(*) AS c FROM base, best GROUP BY ALL)
         QUALIFY row_number() OVER (PARTITION BY is_left ORDER BY c DESC, y) = 1)"""


_TEMP_ROWS = f"SELECT event_id, {_VALUES} AS x, temp AS y FROM ({LABELLED}) l"
_COMBINED_ROWS = f"SELECT l.event_id, {_VALUES} AS x, i.label_index AS y FROM ({LABELLED}) l JOIN ({INDEX}) i ON l.label = i.label"
# thresholds lie between neighbouring codes, so they end in .5
_LEAVES = "(SELECT is_left, cls, CASE WHEN is_left THEN 1 ELSE 2 END AS leaf FROM side)"
_ROWS = "CASE WHEN is_left THEN n_left ELSE n_right END"

ORACLES = {
    "tree_first_split": f"""WITH {_stump(f"SELECT * FROM ({_TEMP_ROWS}) a WHERE {_TRAIN}")},
hold AS (SELECT x[f + 1] <= threshold AS is_left, y FROM ({_TEMP_ROWS}) a, best WHERE NOT ({_TRAIN}))
SELECT [{', '.join(f"'{c}'" for c in _STUMP)}][f + 1] AS feature, threshold, round(gain, 9) AS gain,
  CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right,
  (SELECT CAST(cls AS INTEGER) FROM side WHERE is_left) AS left_class, (SELECT CAST(cls AS INTEGER) FROM side WHERE NOT is_left) AS right_class,
  (SELECT COUNT(*) FROM hold) AS n_test,
  (SELECT COUNT(*) FROM hold JOIN side ON side.is_left = hold.is_left WHERE cls <> y) AS n_wrong, TRUE AS same_as_tree
FROM best""",
    "tree_rules": f"""WITH {_stump(_COMBINED_ROWS)}
SELECT 1 AS tree, leaf, CAST(f AS VARCHAR) || CASE WHEN is_left THEN '|1|' ELSE '|2|' END || CAST(threshold AS VARCHAR) || ':#' || d.label_text AS line,
  CAST({_ROWS} AS BIGINT) AS n_rows
FROM best, {_LEAVES} l JOIN ({DICTIONARY}) d ON d.label_index = l.cls""",
    "tree_rules_text": f"""WITH {_stump(_TEMP_ROWS)}
SELECT 1 AS tree, leaf, CAST(f AS VARCHAR) || CASE WHEN is_left THEN '|1|' ELSE '|2|' END || CAST(threshold AS VARCHAR) || ':#' || CAST(cls AS VARCHAR) AS line,
  'feature ' || CAST(f AS VARCHAR) || CASE WHEN is_left THEN ' <= ' ELSE ' > ' END || CAST(threshold AS VARCHAR) || ' -> Predict: ' || CAST(cls AS VARCHAR) AS text,
  CAST({_ROWS} AS BIGINT) AS n_rows
FROM best, {_LEAVES} l""",
    "rules_partition": f"""SELECT algorithm, tree, n AS n_rows, n AS n_one_rule, n AS n_like_tree, CAST(0 AS BIGINT) AS n_without_label
FROM (SELECT COUNT(*) AS n FROM ({LABELLED}) l), (VALUES ('tree', 1), ('forest', 1), ('forest', 2), ('forest', 3), ('forest', 4), ('forest', 5)) v(algorithm, tree)
WHERE n > 0""",
    "model_text_nodes": f"""SELECT algorithm, tree, CAST(0 AS BIGINT) AS node_differences, CAST(0 AS BIGINT) AS rule_differences
FROM (SELECT COUNT(*) AS n FROM ({LABELLED}) l), (VALUES ('tree', 1), ('forest', 1), ('forest', 2), ('forest', 3), ('forest', 4), ('forest', 5)) v(algorithm, tree)
WHERE n > 0""",
    "tree_documents": f"""SELECT algorithm, tree, CAST(1 AS BIGINT) AS n_documents, CAST(0 AS BIGINT) AS node_differences
FROM (SELECT COUNT(*) AS n FROM ({LABELLED}) l), (VALUES ('tree', 1), ('forest', 1), ('forest', 2), ('forest', 3), ('forest', 4), ('forest', 5)) v(algorithm, tree)
WHERE n > 0""",
    "logistic_optimum": f"""SELECT CAST(SUM(c) AS BIGINT) AS n_rows, CAST(SUM(c) - MAX(c) AS BIGINT) AS majority_misses, TRUE AS gradient_is_small, TRUE AS misses_fewer
FROM (SELECT temp, COUNT(*) AS c FROM ({LABELLED}) l GROUP BY temp)""",
    "train_tree": _events("tree"),
    "train_forest": _events("forest", trees="20"),
    "train_logistic": _events("logistic"),
    "train_logistic_onehot": _events("logistic", "temp", "events:onehot"),
    "train_gbt": _events("gbt", "temp", "events:temp"),
    "train_forest_libsvm": _report("forest", "libsvm", "450", "5", "substr(md5(line), 1, 1) < 'b'", FORMAT_LIBSVM, "split_part(line, ' ', 1)"),
    "score_rules": f"""SELECT l.event_id, CAST(i.label_index AS DOUBLE) AS label, 5 AS n_trees, TRUE AS agrees
FROM ({LABELLED}) l JOIN ({INDEX}) i ON l.label = i.label""",
}
