"""The driver contract: names, column agreement and the flagship query."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["b1_clean_codes", "c3_nearest_visit", "d3_describe", "e4_running_slope", "e9_max_future", "h2_stratified_split", "j1_auroc", "j10_c_index", "k7_search_hybrid"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_counts(spark):
    rows = entry.entry(spark).collect()
    assert (sum(r["eligible_visits"] for r in rows), sum(r["n_yes"] for r in rows), sum(r["n_no"] for r in rows), sum(r["n_unknown"] for r in rows)) == (545, 133, 376, 36)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    key = lambda r: tuple((v is None, str(v)) for v in r)
    mine = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    other = sorted(con.sql(f"SELECT {', '.join(cols)} FROM rel").fetchall(), key=key)
    assert len(mine) == len(other)
    for a, b in zip(mine, other):
        assert all(x == pytest.approx(y, abs=2e-6) if isinstance(x, float) else x == y for x, y in zip(a, b))


@pytest.mark.parametrize("missing", ["sentencepiece", "visitframe.llm"])
def test_other_queries_stay_without_the_text_part(missing):
    code = f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; n = e.queries(); assert len(n) > 200 and not any(k.startswith('op') for k in n)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)
