import importlib
import os

ENTRY = importlib.import_module("__spark_entry__")


def test_entry_smoke(spark):
    df = ENTRY.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields][:2] == ["seller_id", "month"]


def test_every_oracle_has_a_query():
    q, o = ENTRY.queries(), ENTRY.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 40


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lag_features_single_window_shuffle(spark):
    from seriesspark.plans.catalog import QUERIES
    plan = _plan(QUERIES["lag_features"](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    top = plan.split("Subquery")[0]
    assert len([x for x in top.split("\n") if "Exchange hashpartitioning(unique_id" in x]) == 1


def test_delivered_filter_pushed_to_scan(spark):
    from seriesspark.plans.catalog import QUERIES
    df = QUERIES["seller_monthly_panel"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan


def test_small_queries_match_oracle(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ["seller_monthly_panel", "monthly_series", "naive_intervals", "cv_metrics", "hier_summing"]:
        s = ENTRY.queries()[name](spark, sf).toPandas()
        o = con.execute(ENTRY.oracle_sql()[name]).df()
        assert sorted(s.columns) == sorted(o.columns), name
        cols = sorted(s.columns)
        norm = lambda v: round(v, 6) if isinstance(v, float) else str(v)
        rows = lambda df: sorted(tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None))
        assert rows(s) == rows(o), name


def test_no_cartesian_or_nested_loop_joins(spark):
    """No registered query plans a cross join (model-training queries excluded: they fit eagerly)."""
    bad = []
    for name, fn in ENTRY.queries().items():
        if name in ENTRY.HEAVY or name in ENTRY.LLM_QUERIES:
            continue
        plan = _plan(fn(spark, "/root/testdata/sf0.001"))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert bad == []


def _scans(plan, prefix):
    """Scans of a table, known by its column prefix, in the executed plan: without and within subqueries that ran."""
    outer = inner = 0
    skip = None
    for line in plan.split("\n"):
        if line.startswith("+- == Initial Plan"):
            break
        indent = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and indent <= skip[0]:
            skip = None
        if skip is None and line.lstrip(" :+-").startswith(("Subquery", "ReusedSubquery")):
            skip = (indent, "Reused" in line)
        if f"FileScan parquet [{prefix}" in line and not (skip and skip[1]):
            outer, inner = (outer + 1, inner) if skip is None else (outer, inner + 1)
    return outer, inner


def test_facts_are_read_once_and_once_for_bounds(spark):
    for name in ("seller_monthly_panel", "lag_features"):
        df = ENTRY.queries()[name](spark, "/root/testdata/sf0.001")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ReusedSubquery" in plan
        assert _scans(plan, "l_")[0] == 1, name


def test_the_package_reaches_workers_from_another_folder(tmp_path):
    """A driver in another folder: workers have the package from the shipped archive alone."""
    import subprocess
    import sys
    from pathlib import Path
    root = Path(ENTRY.__file__).resolve().parent
    code = ("import importlib.util as u; s = u.spec_from_file_location('e', %r); e = u.module_from_spec(s); s.loader.exec_module(e)\n"
            "from pyspark.sql import SparkSession\n"
            "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
            ".config('spark.checkpoint.dir', %r).config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
            "print('ROWS', e.queries()['forecast_table_fn'](spark, '/root/testdata/sf0.001').count())\n"
            "def where(batches):\n"
            "    import pandas, seriesspark\n"
            "    for _ in batches: pass\n"
            "    yield pandas.DataFrame({'f': [seriesspark.__file__]})\n"
            "print('FROM', spark.range(1).coalesce(1).mapInPandas(where, 'f string').first()[0])\n") % (str(root / "__spark_entry__.py"), str(tmp_path / "ck"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env=env)
    assert "ROWS" in run.stdout, run.stderr[-2000:]
    assert "seriesspark.zip" in run.stdout.split("FROM")[1], run.stdout
