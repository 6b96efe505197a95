"""Registered queries against their SQL, on the smallest tables."""

import os
import pathlib
import subprocess
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent.parent / "tools"))

import __spark_entry__ as spark_entry  # noqa: E402
import check  # noqa: E402
from cohort.plans import catalogue  # noqa: E402

QUICK = {"a1_class_distribution", "a2_split_by_class", "a5_channel_moments", "d1_deidentify",
         "d3_change_report", "d9_audit_events", "g7_largest", "j3_within_label_pairs",
         "m10_roc", "p3_validate_rejects", "sp3_split_counts", "st6_sessions", "t2_early_stop",
         "w3_resample", "w6_mixup"}
NAMES = sorted(catalogue.ORACLE if os.environ.get("COHORT_ALL") else QUICK)


@pytest.fixture(scope="module")
def db(small):
    return check.connect(small)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, small, db, name):
    frame = spark_entry.queries()[name](spark, small)
    assert check.compare(frame, db, spark_entry.oracle_sql()[name]) is None


def test_entry_runs(spark, small):
    assert spark_entry.entry(spark).count() > 0


def test_every_query_without_sql_is_known():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == {"w6_mixup_beta", "w11_image_prints"}


def test_queries_run_from_any_folder(small, tmp_path):
    """Python workers must not need the package on their path."""
    entry = pathlib.Path(spark_entry.__file__).resolve()
    script = tmp_path / "elsewhere.py"
    script.write_text(f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", {str(entry)!r})
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("sp5_unclustered_split", "m2_accuracy", "w7_base_transform"):
    assert module.queries()[name](spark, {small!r}).collect()
""")
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=environment,
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
