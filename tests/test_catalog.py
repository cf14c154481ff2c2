"""A sample of the named queries against their SQL; tools/check_oracles.py runs them all."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import plain
from winnow.plans import training
from winnow.settings import DEFAULTS

SF = "/root/testdata/sf0.001"
SAMPLE = ["ag_03_noisy_rules", "ag_06_project_rollup", "ag_11_outcome_vs_human", "det_01_rule_scan", "jn_10_register_rules",
          "sc_24_redact_secrets", "src_01_sarif", "ss_02_decision_state", "wn_11_reviewer_pair", "wn_06_quarantine"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem orders part customer supplier events documents labels conversations").split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(plain(v) for v in r)) for r in cur.fetchall())
    assert sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["rule_id", "total_seen", "total_false_positive", "historical_fp_rate", "recommended_action"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_stands_alone(tmp_path):
    """Without the separable folders, with and without the pipeline's file, all other queries are registered."""
    root = Path(entry.__file__).parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and set(e.oracle_sql()) <= set(q); print(*sorted(q))"
    names = []
    for _ in range(2):
        run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert run.returncode == 0, run.stderr
        names.append(run.stdout.split())
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names[0] == names[1] and not [n for n in names[0] if n.startswith("op") or n == "pipeline"]


@pytest.mark.parametrize("name", ["ml_05_train_and_gate", "ml_08_batch_scoring"])
def test_the_forest_is_the_documented_one(spark, name, monkeypatch):
    seen = []

    def attempt(f, s, fb, registry=None, cfg=DEFAULTS):
        seen.append((cfg.trees, cfg.tree_depth))
        raise InterruptedError

    monkeypatch.setattr(training, "train_and_gate", attempt)
    with pytest.raises(InterruptedError):
        entry.queries()[name](spark, SF)
    assert seen == [(100, 10)]
