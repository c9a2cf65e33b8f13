import shutil

import numpy as np
import pytest

import __spark_entry__ as entry
from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_their_effect(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "source_mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    at, ids = docs, []
    for name, stage in P.STAGES[:-1]:
        at = Q.cut(stage(spark, at, SF))
        assert at.columns == columns, name
        ids.append({r.doc_id for r in at.select("doc_id").collect()})
    assert ids[1] <= ids[0] and ids[2] == ids[1] and ids[3] <= ids[2]
    packed = P.STAGES[-1][1](spark, at, SF).collect()
    assert {p.doc_id for p in packed} == ids[3]


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op2_quality", "op4_toxicity", "op6_language_id"])
def test_held_out_accuracy(spark, name):
    sf = "/root/testdata/sf0.01"
    got = Q.QUERIES[name](spark, sf).toPandas()
    if name == "op6_language_id":
        truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").dropna().toPandas()
        m = got.merge(truth, on="doc_id")
        held = m[m.held_out]
        assert (held.lang == held.lang_pred).mean() > 0.98
        return
    truth = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = got.merge(truth, on="doc_id")
    held = m[m.held_out]
    assert np.mean(held.predicted == held["quality" if "quality" in name else "toxic"]) > 0.9


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)], ids=["all gone", "pipeline left"])
def test_the_rest_does_without_this_part(tmp_path, left):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "repo"
    gone = [x for x in ("llm", "corpus_pipeline.py") if x not in left]
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q), sorted(q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_lineage.py", "tests/test_api.py", "tests/test_cli.py", "-k", "not formats"], cwd=copy, check=True, env=env)


def test_a_broken_part_shows(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    os.remove(copy / "tidemark" / "llm" / "mixing.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env=env, capture_output=True).returncode
