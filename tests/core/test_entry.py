import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


def test_entry_runs(spark):
    import __spark_entry__ as e

    r = e.entry(spark).collect()
    assert len(r) == 1 and 0 < r[0].f1 < 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_parts(tmp_path):
    """The rest imports when the llm folders and the pipeline are gone."""
    for p in ROOT.rglob("*.py"):
        r = p.relative_to(ROOT)
        if "llm" not in r.parts and r.name != "corpus_pipeline.py":
            (tmp_path / r).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / r).write_text(p.read_text())
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, m, op = out.stdout.split()
    assert int(n) > 150 and int(m) > 120 and op == "False"


@pytest.mark.parametrize("name", ["MT1", "EV2", "WN1", "AGG3", "FIL8", "CF5", "TL9", "SNK4", "AG5", "ST2"])
def test_headline_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = e.queries()[name](spark, folder)
    cols = sorted(df.columns)
    rel = con.sql(e.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in cols]
    norm = lambda v: round(float(v), 4) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "as_tuple") else str(v)
    assert sorted(str([norm(r[c]) for c in cols]) for r in df.collect()) == sorted(str([norm(r[i]) for i in at]) for r in rel.fetchall())


def test_recorded_folders_are_discarded(spark):
    import os

    from aerotally.plans.storage import discard, materialise, recorded

    with recorded() as outer:
        kept = materialise(spark.range(3).toDF("a"), "test")
        with recorded() as inner:
            materialise(spark.range(2).toDF("a"), "test")
    materialise(spark.range(1).toDF("a"), "test")
    assert len(outer) == 2 and outer[1:] == inner and all(os.path.isdir(p.removeprefix("file:")) for p in outer)
    discard(spark, [*inner, *inner])
    assert not os.path.exists(inner[0].removeprefix("file:")) and kept.count() == 3
