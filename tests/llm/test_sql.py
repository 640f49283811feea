"""Every SQL text of the training-data queries against its query, over whole small tables."""

import duckdb
import pandas as pd
import pytest

from marlstone.llm import registry
from tests.conftest import DATA

TABLES = ("documents", "conversations", "pages", "embeddings", "benchmark")


def _shown(value):
    """Whole numbers alike, whether or not a column with nulls turned them into doubles."""
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, DATA).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    sides = [x[columns].astype(object).where(x[columns].notna(), None).map(_shown).sort_values(columns).reset_index(drop=True) for x in (got, want)]
    pd.testing.assert_frame_equal(*sides)
