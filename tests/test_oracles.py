"""Each registered query of the catalog against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from matchlake import plans
from matchlake.operators import checkpoints
from matchlake.plans import proxies as V

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, bool) or getattr(getattr(v, "dtype", None), "kind", "") == "b":
        return str(bool(v))
    return repr(round(float(v), 9)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["vote_winner", "vote_distances", "status", "promotions"])
def test_readings_round_as_sql_does(spark, tmp_path, name):
    """Shares whose fourth place is a five: some lie above it in doubles, some below."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    values = [5.85, 17.15, 40.55, 50.05, 50.15, 50.25, 50.55, 50.65, 40.45, 12.0, float("nan"), -40.55, 250.0, None]
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, '2024-01-01 10:00:00', ?, 'view', ?, '')", [(40 * k + j - 400, 100 * (k % 14) + j, v) for k, v in enumerate(values * 3) for j in range(4)])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for t in TABLES:
        if t != "events":
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = plans.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(plans.SQL[name]).df()
    assert len(want) and rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_low_confidence_keeps_and_moves_little(spark):
    """Kept files hold no titles, and a record's line items are shuffled to it once, without what titles don't show."""
    folder = checkpoints.shared_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
    before = size()
    n = plans.QUERIES["low_confidence"](spark, SF).count()
    assert n > 500 and size() - before < 100 * n
    plan = V.titles(spark, SF).select("id", "title")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(video") == 1 and "p_type" not in plan and "l_returnflag" not in plan
