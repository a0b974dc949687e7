"""The shared folder on masters other than a plain local one."""

import os
from types import SimpleNamespace

import pytest

from caselight.plans import load_catalog
from caselight.sources import staging


def _session(spark, master, folder=None):
    """The session as it looks on another master."""
    conf = {"spark.sql.warehouse.dir": spark.conf.get("spark.sql.warehouse.dir")} | ({"spark.checkpoint.dir": folder} if folder else {})
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, defaultParallelism=4)
    named = SimpleNamespace(get=lambda key, default=None: conf.get(key, default))
    return SimpleNamespace(sparkContext=context, conf=named, range=spark.range, read=spark.read, _jvm=spark._jvm, _jsc=spark._jsc)


def test_a_cluster_may_name_a_mounted_folder(spark, tmp_path):
    for folder in (f"file://{tmp_path}/shared/", f"{tmp_path}/plain"):
        assert staging.work_dir(_session(spark, "spark://host:7077", folder)) == folder.rstrip("/")


def test_a_cluster_without_a_named_folder_uses_the_warehouse(spark, tmp_path):
    found = staging.work_dir(_session(spark, "local-cluster[3,4,1024]"))
    assert found == spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/caselight-work"


def test_a_folder_the_driver_cannot_see_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "_shared", lambda *_: False)
    with pytest.raises(ValueError, match="does not see"):
        staging.work_dir(_session(spark, "spark://host:7077", f"file://{tmp_path}/own"))


def test_a_query_that_stages_runs_on_another_master(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(staging, "_SHARED", set())
    names = ["almond azure", "almond azures", "plum", None]
    spark.createDataFrame(list(enumerate(names, 5)), "p_partkey long, p_name string").selectExpr("*", "'b' AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    assert load_catalog()["j2_duplicate_drugs"](spark, str(tmp_path)).count()
    assert staging._SHARED


def test_a_local_session_without_a_named_folder_keeps_one_of_its_own(spark):
    own = _session(spark, "local[2]")
    own.sparkContext.applicationId = "app-own"  # its settings cannot be changed, as those of a real session cannot
    found = staging.work_dir(own)
    assert found == staging.work_dir(own) and os.path.isdir(found)
