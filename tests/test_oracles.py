"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import duckdb
import pytest

from vellum import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = catalog.oracle_sql()
FIRES = {"pii_email", "pii_phone", "pii_phone_label", "page_numbers", "repeated_lines", "unit_ug", "unit_confusions", "change_log"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    if name in FIRES:
        assert rows
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
