"""The driver contract: queries equal their SQL, and the library stands without its optional part."""

import datetime
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from textloom.plans import queries

ROOT = Path(__file__).resolve().parents[2]


def _rows(frame):
    columns = sorted(frame.columns)

    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return round(v, 9)
        if isinstance(v, (datetime.datetime, pd.Timestamp)):
            return str(v)
        return v.item() if hasattr(v, "item") else v

    return columns, sorted(repr([plain(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got) > 0
        return
    con = duckdb.connect()
    for table in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    assert _rows(got) == _rows(con.execute(queries.ORACLE_SQL[name]).df())


def test_import_without_the_optional_part(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("textloom.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "translate_rebuild_txt" in e.queries() and not any(k.startswith("op") for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
