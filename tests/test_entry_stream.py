from __spark_entry__ import entry, oracle_sql, queries
from reviewlab.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry(spark)
    rows = df.collect()
    assert df.columns == ["model", "accuracy", "f1_score"] and len(rows) == 1


def test_oracle_keys_are_registered():
    assert set(oracle_sql()) <= set(queries())


def test_stream_equals_batch(spark):
    stream = {r["doc_id"]: (r["score"], r["prediction"]) for r in REGISTRY["stream_score"](spark, SF).collect()}
    batch = {r["doc_id"]: (r["score"], r["prediction"]) for r in REGISTRY["nb_predict"](spark, SF).collect()}
    assert stream == batch


def test_imports_without_the_llm_subpackage(tmp_path):
    """The registered queries of the rest stay when the llm folders and corpus_pipeline.py are gone."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "reviewlab", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "reviewlab")
    for name in os.listdir(f"{root}/reviewlab"):
        if name != "llm":
            os.symlink(f"{root}/reviewlab/{name}", tmp_path / "reviewlab" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'nb_evaluate' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
