"""What queries send through the driver."""

import duckdb
import pytest
from conftest import normal

from tempolin.oracle import ORACLE_SQL
from tempolin.queries import QUERIES


def broadcast_bins(frame):
    """Broadcasts of the final plan whose rows come of an explode that nothing adds up: Spark takes their size for that of what was exploded."""
    lines = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[k + 1 :]:
                if depth(below) <= depth(line) or any(s in below for s in ("Aggregate", "Exchange", "Join", "InArrow")):
                    break
                if "Generate explode" in below:
                    found.append(below.strip())
    return found


@pytest.fixture(scope="module")
def month(tmp_path_factory):
    """Events of four sessions over thirty days."""
    folder = tmp_path_factory.mktemp("month")
    duckdb.execute(f"""copy (select k as event_id, timestamp '2024-01-01' + to_seconds(cast(hash(k) % 2592000 as bigint)) as ts, cast(hash(k + 1000000) % 120 as bigint) as user_id,
        ['click', 'view', 'purchase', 'signup', 'error'][1 + cast(hash(k + 2000000) % 5 as int)] as event_type, cast(hash(k + 3000000) % 1000 as double) / 7 as value, '' as props
      from range(12000) r(k) union all select 99999 + u, timestamp '2024-01-30 23:00:00', u * 30, 'view', 1e0, '' from range(4) s(u)) to '{folder}/events.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", ["shift_test", "offset_scores", "penalty_errors"])
def test_no_exploded_rows_are_broadcast(spark, month, name):
    made = QUERIES[name](spark, month)
    rows = made.collect()
    assert broadcast_bins(made) == []
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{month}/events.parquet')")
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(normal(r[n]) for n in names) for r in rows), key=key) == sorted((tuple(map(normal, r)) for r in cursor.fetchall()), key=key)
