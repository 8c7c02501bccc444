"""Every registered general query against its SQL, and the contract of the entry."""

import pytest
from helpers import DATA, rows_of, sql_rows

from chronica.plans import core_queries, decision_queries, event_queries, graph_queries, record_queries, retrieval_queries, source_queries

MODULES = (core_queries, event_queries, graph_queries, record_queries, decision_queries, retrieval_queries, source_queries)
QUERIES = {k: q for m in MODULES for k, q in m.queries().items()}
SQL = {k: q for m in MODULES for k, q in m.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        assert rows_of(df) == sql_rows(SQL[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_subpackage():
    import re
    from pathlib import Path

    root = Path(core_queries.__file__).parents[1]
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] != "llm":
            assert not re.search(r"chronica\.llm|from \.+llm", path.read_text()), path
