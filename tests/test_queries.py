"""Every query against its SQL on the smallest tables."""

import __spark_entry__
import pytest
from conftest import compare

from tempolin.oracle import ORACLE_SQL
from tempolin.queries import QUERIES

WITHOUT_SQL = sorted(set(QUERIES) - set(ORACLE_SQL))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    mine, other = compare(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])
    assert sum(mine.values()) > 0
    assert mine == other


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_refit_of_a_unit_that_is_alike_under_both_gains(spark, tmp_path):
    """Its coefficient is 0 from the first round on; the other parameters still take all eight rounds."""
    import duckdb

    con = duckdb.connect()
    # days 0 to 4 again as days 5 to 9: bursts of purchases, and a signup
    con.execute(f"""copy (select row_number() over () - 1 as event_id, timestamp '2024-01-01' + to_days(cast(d + k as int)) + to_hours(cast(h as int)) + to_minutes(cast(m as int)) as ts, 0::bigint as user_id, what as event_type, 1.5e0 as value, '' as props
      from (values (0, 10, 2, 'purchase'), (0, 11, 5, 'purchase'), (0, 12, 3, 'purchase'), (2, 9, 4, 'purchase'), (2, 10, 1, 'purchase'), (4, 14, 1, 'purchase'), (1, 8, 1, 'signup')) t(d, h, n, what), range(n) r(m), unnest([0, 5]) again(k))
      to '{tmp_path}/events.parquet'""")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    for name in ("history_refit_gains", "history_refit_kernels"):
        cursor = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in cursor.description]
        theirs = cursor.fetchall()
        mine = [tuple(r[n] for n in names) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert len(mine) == len(theirs) == 1 and mine[0] == pytest.approx(theirs[0], rel=0, abs=2e-9)


def test_contract_names_every_query():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_need_the_llm_subpackage():
    import ast
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "tempolin"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
