import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() >= 1


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("p")))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from collections import Counter
    from pathlib import Path

    if not Path(SF).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    told = con.sql(entry.oracle_sql()[name])
    assert sorted(told.columns) == columns
    places = [told.columns.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect()) == Counter(tuple(plain(r[i]) for i in places) for r in told.fetchall())
