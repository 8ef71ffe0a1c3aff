from conftest import AS_OF, RUN_TS
from tallyward.plans.catalogue import QUERIES
from tallyward.plans.workspace import Workspace
from tallyward.session import shared_folder, size_shuffles


def test_tables_are_written_once(spark, sf_dir):
    ws = Workspace(spark, sf_dir, AS_OF, RUN_TS)
    first, second = ws.claims().inputFiles(), ws.claims().inputFiles()
    assert first and sorted(first) == sorted(second)
    assert all(ws.root in f for f in first)


def test_a_workspace_removes_its_own_folder_and_databases(spark, sf_dir, tmp_path):
    root = tmp_path / "own"
    ws = Workspace(spark, sf_dir, AS_OF, RUN_TS, root=str(root))
    QUERIES["load_warehouse"](ws).collect()
    databases = list(ws.databases)
    assert root.exists() and spark.catalog.databaseExists(databases[0])
    ws.close()
    assert not root.exists() and tmp_path.exists() and not any(map(spark.catalog.databaseExists, databases))


def test_without_a_named_folder_the_warehouse_is_shared(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named.rstrip("/")


def test_shuffles_only_grow(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    try:
        size_shuffles(spark, 1000)
        assert spark.conf.get(name, None) == before
        size_shuffles(spark, 100 * 1024**3)
        assert spark.conf.get(name) == "400"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
