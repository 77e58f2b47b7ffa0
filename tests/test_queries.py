"""Named queries against their DuckDB counterparts on the smallest tables."""

import os

import duckdb
import pytest

from riskloom.oracles import ORACLE_SQL
from riskloom.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["netlog_records", "top_risky_addresses", "entity_features", "graph_edges", "chain_scans", "chain_lateral", "dga_domain_scores", "risk_profiles", "session_windows", "parse_syslog_5424", "text_statistics"]


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, sf_dir, duck, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


def test_every_counterpart_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 30
