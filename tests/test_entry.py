"""Driver contract: entry smoke, registry and oracle coverage."""

import re

import __spark_entry__ as entry

ROWS_ONLY = set()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "session_id" in df.columns


def test_every_query_has_an_oracle_or_is_rows_only():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    # the training-data queries (op<N>_..., pipeline) have tests of their own
    own = {q for q in set(qs) - set(sql) if q != "pipeline" and not re.match(r"op\d+_", q)}
    assert own == ROWS_ONLY
