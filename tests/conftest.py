"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from phonoflow.session import build_session

    s = build_session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": "/tmp/phonoflow-warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SMALL


@pytest.fixture(scope="session")
def duck(sf: str):
    """DuckDB with the small tables as views."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(pdf) -> list[str]:
    """Rows as sorted strings, columns by name, missing values alike."""
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(map(repr, pdf.where(pdf.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="session")
def same_rows():
    """Whether a DataFrame and a pandas frame hold the same columns and rows."""

    def check(df, pdf) -> None:
        got = df.toPandas()
        assert sorted(got.columns) == sorted(pdf.columns)
        assert rows_of(got) == rows_of(pdf)

    return check
