"""Registry of the queries the driver runs (name -> callable(spark, data_dir))
and of their DuckDB oracles (name -> SQL)."""

from __future__ import annotations

from seqlab.plans import appliance, appliance_sql, docs, events, events_sql, files, logs, logs_sql, models, models_sql, streams

QUERIES = {
    "sessionize": events.q_sessionize,
    "sessionize_clean": events.q_sessionize_clean,
    "min_events": events.q_min_events,
    "min_group": events.q_min_group,
    "session_features": events.q_session_features,
    "sliding_features": events.q_sliding_features,
    "sliding_lexical": events.q_sliding_lexical,
    "nearest_join": events.q_nearest_join,
    "nearest_join_scan": events.q_nearest_join_scan,
    "nearest_join_gap": events.q_nearest_join_gap,
    "nearest_join_gap_scan": events.q_nearest_join_gap_scan,
    "group_sorted": events.q_group_sorted,
    "period_filter": events.q_period_filter,
}
QUERIES.update({name: getattr(appliance, f"q_{name}") for name in appliance_sql.ORACLES})
QUERIES.update(docs.QUERIES)
QUERIES.update(models.QUERIES)
QUERIES.update(logs.QUERIES)
QUERIES.update(streams.QUERIES)
QUERIES.update(files.QUERIES)

ORACLES = {**events_sql.ORACLES, **appliance_sql.ORACLES, **docs.ORACLES, **logs_sql.ORACLES, **models_sql.ORACLES,
           **streams.ORACLES, **files.ORACLES}
