"""Staging, sizing and the life of a workspace."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from helpers import rows_of

from ledgerloom import session
from ledgerloom.operators import graph_build, graph_checks
from ledgerloom.plans import registry
from ledgerloom.plans.workspace import BAD_LINES, FILES, FILES_EACH, TABLES, Workspace, _dealt, open_workspace
from ledgerloom.session import names
from ledgerloom.sources import jsonl, tpch
from ledgerloom.sources.catalog import Collections

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")
def test_a_changed_table_gives_a_new_answer(spark, tmp_path):
    folder = str(tmp_path / "tables")
    shutil.copytree(FOLDER, folder)
    ask = registry.bound("products_by_billing")
    before = ask(spark, folder).count()
    first = open_workspace(spark, folder)
    assert open_workspace(spark, folder) is first
    staged = os.path.join(session.staging_dir(spark), f"ledgerloom-{spark.sparkContext.applicationId}", first.owner)
    assert os.path.isdir(staged.removeprefix("file:"))
    few = spark.read.parquet(f"{FOLDER}/lineitem.parquet").filter(F.col("l_partkey") <= 19)
    os.chmod(folder, 0o755)
    shutil.rmtree(f"{folder}/lineitem.parquet", ignore_errors=True)
    if os.path.exists(f"{folder}/lineitem.parquet"):
        os.remove(f"{folder}/lineitem.parquet")
    few.write.parquet(f"{folder}/lineitem.parquet")
    assert ask(spark, folder).count() <= 20 < before
    assert not os.path.exists(staged)


def test_shuffles_start_with_partitions_that_are_sorted_in_memory():
    # 0.7 GB of files were 12 partitions, each of which took 0.6 GB of memory to sort.
    assert session.shuffle_partitions(700 << 20, 12) >= 40
    assert session.shuffle_partitions(0, 12) == 12


def test_settings_and_sizing(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        session.tune(spark, 0)
        assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == "4.0"
        assert spark.conf.get(name, None) is None or int(spark.conf.get(name)) > 0
        session.tune(spark, 1000 * session.SHUFFLE_PARTITION_BYTES)
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.unset(name)


class _Cluster:
    """What ``staging_dir`` asks of a session, on a cluster."""

    def __init__(self, folder):
        settings = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": "yarn", "getConf": lambda _: settings})()


@pytest.mark.parametrize("folder", [None, "file:///tmp/here"])
def test_a_cluster_needs_a_shared_folder(folder):
    with pytest.raises(RuntimeError):
        session.staging_dir(_Cluster(folder))
    assert session.staging_dir(_Cluster("hdfs:///shared")) == "hdfs:///shared"


def test_owners_release_their_own(spark):
    kept = session.stage(spark.range(3), "a", owner="one")
    gone = session.stage(spark.range(3), "b", owner="two")
    session.release(spark, "two")
    assert kept.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        gone.count()
    session.release(spark, "one")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")
def test_lines_are_written_compressed_and_for_the_collection_asked_for_only(spark):
    workspace = Workspace(spark, FOLDER)
    for name in ("plants", "sales_order_items"):
        path = workspace.jsonl(name)
        source = jsonl.Source(spark, path, name, FILES)
        assert source.files == FILES_EACH
        assert all(n.endswith(".gz") for n in names(spark, path) if n.startswith("part-"))
        assert source.first_line() not in [line for _, line in BAD_LINES.get(name, ())]
        good = jsonl.read_collection(spark, path, name, FILES)
        assert good.count() == workspace.tables[name].count()
    assert names(spark, os.path.dirname(path)) == ["plants", "sales_order_items"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")
def test_the_stored_graph_serves_as_the_graph(spark):
    workspace = Workspace(spark, FOLDER)
    stored = workspace.stored
    assert workspace.graph.nodes is stored.nodes and workspace.graph.edges is stored.edges


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")
def test_queries_on_the_graph_write_no_graph(spark):
    workspace = Workspace(spark, FOLDER)
    root = os.path.join(session.staging_dir(spark), f"ledgerloom-{spark.sparkContext.applicationId}", workspace.owner)
    assert registry.REGISTRY["node_edges"](workspace).count() == 2 * workspace.graph.edges.count()
    registry.REGISTRY["path_payment_to_customer"](workspace).count()
    assert {n.partition("-")[0] for n in names(spark, root)} == {"lines", "billed", "delivered"}
    registry.REGISTRY["graph_sink"](workspace).count()
    assert {n.partition("-")[0] for n in names(spark, root)} == {"lines", "billed", "delivered", "sink"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")
def test_a_graph_with_repeating_rows_is_the_same_graph(spark):
    workspace = Workspace(spark, FOLDER)
    for several, once in zip(graph_build.repeating(workspace.tables), workspace.graph, strict=True):
        assert rows_of(several.distinct()) == rows_of(once)
    assert rows_of(workspace.absent) == rows_of(graph_checks.absent_ends(*workspace.graph))


@pytest.fixture
def odd_orders(spark, tmp_path):
    """A folder of the tables whose orders and lines hold every row twice, and some without a key."""
    folder = str(tmp_path / "odd")
    for name in TABLES:
        rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        if name in ("lineitem", "orders"):
            key = "l_orderkey" if name == "lineitem" else "o_orderkey"
            rows = rows.filter(F.col(key) < 200).withColumn(key, F.when(F.col(key) % 7 != 0, F.col(key)))
            rows = rows.unionByName(rows)
        rows.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")
def test_known_keys_make_rows_distinct_without_a_shuffle(spark, odd_orders):
    tables = Workspace(spark, odd_orders).tables
    plain = Collections(spark, {name: tables[name] for name in tables})
    assert tables.keyed("sales_order_items", "billing_document_items") and not plain.keyed("sales_order_items")
    assert not tables.keyed("sales_order_headers")
    for build in (graph_build.build_nodes, graph_build.build_edges, graph_build.billed_for):
        assert rows_of(build(tables)) == rows_of(build(plain))
    for rows in (graph_build.nodes_of_type(tables, "SalesOrderItem"), graph_build.edges_of_type(tables, "ORDER_HAS_ITEM")):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    ends = graph_build.build_edges(plain).select("edge_type", "source_id", "target_id").dropna().distinct()
    assert rows_of(graph_build.build_links(tables)) == rows_of(ends)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")
def test_items_cut_to_six_characters_are_no_known_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tpch, "ITEM_WIDTH", 2)  # 99 and fewer: ten lines of an order are too many
    folder = str(tmp_path / "long")
    for name in TABLES:
        rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        if name == "lineitem":
            rows = rows.withColumn("l_orderkey", F.col("l_orderkey") % 10)
        rows.write.parquet(f"{folder}/{name}.parquet")
    assert not tpch.order_to_cash(spark, folder).keyed("sales_order_items")


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in str(blocks.mkString(" ")).split() if name.startswith("shuffle_")}


def _left_behind(spark, before):
    """Shuffle files that are more than ``before``; they go soon, but not at once."""
    end = time.time() + 10
    while (left := _shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    return left


def test_staging_leaves_no_shuffle_files(spark):
    # The shuffle of the numbered lines, larger than the tables, lay beside all that came after.
    before = _shuffle_files(spark)
    rows = session.stage(spark.range(5000).groupBy(F.col("id") % 7).count(), "grouped", owner="freed")
    assert not _left_behind(spark, before) and spark.conf.get(session.FREE_SHUFFLES) == "false"
    assert len(rows.collect()) == 7
    session.release(spark, "freed")


def test_freed_shuffles_end_with_the_last_who_wanted_them(spark):
    with session.freed_shuffles(spark):
        with session.freed_shuffles(spark):
            assert spark.conf.get(session.FREE_SHUFFLES) == "true"
        assert spark.conf.get(session.FREE_SHUFFLES) == "true"
    assert spark.conf.get(session.FREE_SHUFFLES) == "false"


def test_types_are_dealt_to_parts_no_larger_than_the_largest():
    assert _dealt({"a": 3, "b": 10, "c": 6, "d": 5, "e": 0}) == [["b"], ["c"], ["d", "a", "e"]]
    assert _dealt({"a": 0, "b": 0}) == [["a", "b"]]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")
def test_the_stored_graph_is_written_part_by_part(spark, monkeypatch):
    # Sorted in one go, the shuffles of all types lay on the disk at once.
    workspace, ranges = Workspace(spark, FOLDER), []
    deal = type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda rows, *a: ranges.append(a) or deal(rows, *a))
    before = _shuffle_files(spark)
    stored = workspace.write_graph("parts")
    assert len(ranges) > 4 and not _left_behind(spark, before)
    for written, built in zip(stored, workspace._built, strict=True):
        assert rows_of(written) == rows_of(built)
