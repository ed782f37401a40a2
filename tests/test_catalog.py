"""Registered queries against their SQL on the smallest tables, and the registry without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphmill.functions.stemming import STEMMERS, stem_column
from glyphmill.operators import catalog

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", catalog.ORACLE)
def test_same_rows_as_sql(spark, sql, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(sql.execute(catalog.ORACLE[name]).df())


def test_excerpts_run(spark):
    assert catalog.QUERIES["highlighted_excerpts"](spark, SF).count() > 0


def test_stemmed_vocabulary(spark, sql):
    """Every word of every language, null among them, with the stem that the plain function gives."""
    found = {(r.lang, r.word): r.stem for r in catalog.QUERIES["stemmed_vocabulary"](spark, SF).toLocalIterator()}
    words = sql.execute(f"SELECT DISTINCT lang, unnest({catalog._TOKENS}) AS word FROM documents").fetchall()
    assert found == {(lang, word): STEMMERS[lang](word) if lang in STEMMERS else None for lang, word in words}


def test_stems_by_language_column(spark):
    rows = spark.createDataFrame([(["houses"], "en"), (["häuser"], "de"), (["x"], "xx"), (["x"], None), (None, "en"), ([], "en")], "t array<string>, l string")
    assert [r.s for r in rows.select(stem_column(F.col("t"), F.col("l")).alias("s")).collect()] == [["hous"], ["haus"], None, None, None, []]


def test_flagship(spark):
    assert 0 < catalog.flagship(spark, SF).count() <= catalog.TOP


def test_entry_without_the_optional_part(tmp_path):
    for name in ("__spark_entry__.py", "glyphmill"):
        (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, tmp_path / name)
    shutil.rmtree(tmp_path / "glyphmill/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'term_query' in q and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
