"""Checkpoint folder, settings, and the command line from load to report."""

from datetime import date

import pytest

from tillscope import session
from tillscope.__main__ import main
from tillscope.catalog import OPERATORS, run


class FakeContext:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, master, configured=None):
        self.sparkContext = FakeContext(master)
        self.conf = {"spark.sql.warehouse.dir": "hdfs:///warehouse/"}  # has get()
        if configured:
            self.conf["spark.checkpoint.dir"] = configured


def test_the_configured_folder_wins():
    fake = FakeSession("yarn", "hdfs:///shared")
    session._ensure_checkpoint_dir(fake)
    assert fake.sparkContext.folder == "hdfs:///shared"


@pytest.mark.parametrize("master", ["local", "local[4]"])
def test_without_a_folder_a_local_session_uses_the_warehouse(master):
    fake = FakeSession(master)
    session._ensure_checkpoint_dir(fake)
    assert fake.sparkContext.folder == "hdfs:///warehouse/_checkpoints"


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_has_to_name_a_shared_folder(master):
    """The warehouse may be a folder of the driver's machine."""
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session._ensure_checkpoint_dir(FakeSession(master))


def test_durable_rows_have_no_lineage(spark):
    frame = session.durable(spark.range(10).selectExpr("id * 2 AS twice"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "Scan ExistingRDD" in plan
    assert sorted(r.twice for r in frame.collect()) == list(range(0, 20, 2))


def test_command_line(spark, tmp_path, capsys):
    root, out = str(tmp_path / "tables"), str(tmp_path / "reports")
    main(["load", root, "--customers", "40", "--orders", "300"])
    assert "--- TOTAL ---" in capsys.readouterr().out
    main(["run", root, "a3_segment_revenue", "c2_category_tree", "--as-of", "2024-01-01"])
    printed = capsys.readouterr().out
    assert "Electronics > Laptops" in printed and "Bronze" in printed
    main(["run", root, "a1_order_details", "--as-of", "2024-01-01", "--out", out])
    assert spark.read.parquet(f"{out}/a1_order_details").count() > 100
    main(["list"])
    assert set(capsys.readouterr().out.split()) == set(OPERATORS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_operator_runs_on_the_canonical_tables(standard, name):
    frame = run(standard, name, as_of=date(2024, 1, 1), ordered=True)
    assert len(frame.columns) == len(set(frame.columns))
    empty_on_purpose = {"a2_customers_without_orders", "q_violations"}
    assert (frame.count() == 0) == (name in empty_on_purpose)
