"""Every registered query of the library against its SQL in DuckDB, and the entry point."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from logfathom.queries import ORACLES, QUERIES


def rows(df: pd.DataFrame) -> tuple[list[str], list[tuple[str, ...]]]:
    """Columns by name and rows as sorted text, nulls alike, numbers to nine digits."""

    def cell(x) -> str:
        if not hasattr(x, "__len__") and pd.isna(x):
            return "null"
        return str(x) if isinstance(x, (str, bool, pd.Timestamp)) or hasattr(x, "__len__") else f"{float(x):.9g}"

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["event_type", "hour", "n", "total", "users"]
