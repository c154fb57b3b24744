"""The driver's contract, with and without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from tickloom import sources
from tickloom.config import CandleConfig
from tickloom.operators import candles as C
from tickloom.plans import oracles, queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_of_the_engine_has_sql():
    assert queries.QUERIES.keys() == oracles.ORACLES.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_imports_without_the_optional_parts(tmp_path):
    shutil.copytree(f"{ROOT}/tickloom", tmp_path / "tickloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 30"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, timeout=120).returncode
    assert run() == 0
    # a module that is there but lacks something it needs is an error, not an absence
    (tmp_path / "corpus_pipeline.py").write_text("import not_a_module")
    assert run() != 0


def test_nothing_else_imports_the_optional_parts():
    for folder, _, files in os.walk(f"{ROOT}/tickloom"):
        if f"{os.sep}llm" not in folder:
            for file in files:
                if file.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, file)).read()


def test_outputs(spark):
    ticks = sources.demo_ticks(spark)
    assert sources.printed(ticks.filter("key = 'TS-1'")).orderBy("line").first().line.startswith("TS-1:1.0:1.0:")
    candles = C.build_candles(ticks, CandleConfig(keys=("TS-1",)))
    listed = {r.key: r.candles for r in sources.candles_by_key(candles).collect()}
    assert [c.close_time for c in listed["TS-1"]] == sorted(c.close_time for c in listed["TS-1"])
    assert sources.json_lines(candles).first().line.startswith('{"key":')
    assert sources.with_event_time(ticks).schema["ts"].dataType.typeName() == "timestamp"


def test_plan_reads_only_needed_columns(spark, tmp_path):
    """The candle scan prunes columns, and nothing in the chain needs a cross join."""
    spark.createDataFrame([(1, "a", 1.0, "wide")], "event_id long, event_type string, value double, props string").selectExpr("*", "timestamp_ntz'2024-01-01' ts").write.parquet(f"{tmp_path}/events.parquet")
    ticks = sources.event_ticks(spark, str(tmp_path))
    plan = C.build_candles(ticks, queries.QUARTERLY, reuse=False)._jdf.queryExecution().toString()
    assert "props" not in plan.split("== Physical Plan ==")[1] and "Cartesian" not in plan and "NestedLoop" not in plan
