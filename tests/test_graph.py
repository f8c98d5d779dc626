"""Graph queries against brute force on a small random graph."""

import random

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from ledgerloom.operators import graph_build, graph_checks, graph_query
from ledgerloom.sources import graph_store
from ledgerloom.sources.graph_store import (
    EDGE_SCHEMA,
    NODE_SCHEMA,
    Graph,
    GraphIntegrityError,
    counts,
    read_graph,
    vacuum,
    versions,
    write_graph,
)

TYPES = list(graph_build.NODE_KINDS)


@pytest.fixture(scope="module")
def small(spark):
    """25 nodes, edges that may be loops, run in parallel or lead to ids without a node."""
    pick = random.Random(3)
    nodes = [(f"n{i:02}", TYPES[i % 12], f"label {i}", f'{{"i":"{i}"}}') for i in range(25)]
    ids = [n[0] for n in nodes] + ["ghost1", "ghost2"]
    edges = [
        (f"e{i:02}", pick.choice(ids), pick.choice(ids), list(graph_build.EDGE_ENDS)[i % 12], "{}") for i in range(30)
    ] + [("loop", "n01", "n01", "ORDER_HAS_ITEM", "{}")]
    graph = Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA))
    return nodes, edges, graph


def walk(nodes, edges, seed, depth):
    """Ids of nodes and edges of the subgraph around one seed."""
    if seed not in {n[0] for n in nodes}:
        return set(), set()
    distance = {seed: 0}
    for step in range(1, depth + 1):
        for e, s, t, *_ in edges:
            for a, b in ((s, t), (t, s)):
                if distance.get(a) == step - 1:
                    distance.setdefault(b, step)
    near = {n for n, d in distance.items() if d < depth}
    return (
        {n for n in distance if n in {x[0] for x in nodes}},
        {e[0] for e in edges if e[1] in near or e[2] in near},
    )


@pytest.mark.parametrize("depth,asked", [(1, True), (1, False), (2, True), (3, True), (5, True)])
def test_subgraph(spark, small, depth, asked):
    nodes, edges, graph = small
    wanted = ["n00", "n01", "n07", "ghost1", "nowhere", "n07"] if asked else [n[0] for n in nodes]
    seeds = spark.createDataFrame([(s,) for s in wanted], "seed_id string") if asked else None
    got_nodes = rows_of(graph_query.subgraph_nodes(*graph, seeds, depth), "seed_id", "node_id")
    got_edges = rows_of(graph_query.subgraph_edges(*graph, seeds, depth), "seed_id", "edge_id")
    expected = {s: walk(nodes, edges, s, depth) for s in set(wanted)}
    assert got_nodes == sorted((s, n) for s, (found, _) in expected.items() for n in found)
    assert got_edges == sorted((s, e) for s, (_, found) in expected.items() for e in found)


def test_hubs_are_dealt_to_parts(spark, monkeypatch):
    """Many seeds around one hub: their product is far larger than either side."""
    monkeypatch.setattr(graph_query, "PART_ROWS", 500)
    nodes = [(f"n{i}", "Plant", "x", "{}") for i in range(80)] + [("hub", "Customer", "x", "{}")]
    edges = [(f"h{i}", *(("hub", f"n{i}") if i % 2 else (f"n{i}", "hub")), "CUSTOMER_PLACED_ORDER", "{}") for i in range(80)]
    edges += [("loop", "hub", "hub", "ORDER_HAS_ITEM", "{}")] + [(f"e{i}", f"n{i}", f"n{i + 1}", "ORDER_HAS_ITEM", "{}") for i in range(20)]
    graph = Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA))
    asked = [f"n{i}" for i in range(60)]
    seeds = spark.createDataFrame([(s,) for s in asked], "seed_id string")
    for depth in (2, 3):
        got = rows_of(graph_query.subgraph_nodes(*graph, seeds, depth), "seed_id", "node_id")
        assert got == sorted((s, n) for s in asked for n in walk(nodes, edges, s, depth)[0])
    frontier = seeds.selectExpr("seed_id", "'hub' as node_id")
    (size,) = graph_query.hop_sizes(graph.edges, frontier).collect()
    assert (size["seeds"], size["degree"], size["rows"]) == (60, 81, 4860)
    plan = graph_query._step(graph.edges, frontier, None)._jdf.queryExecution().toString()
    assert "part" in plan and graph_query._step(graph.edges, frontier, None).count() == 4860
    with pytest.raises(ValueError, match="4860|rows"):
        graph_query.subgraph_nodes(*graph, seeds, 2, most_rows=1000)


def test_depths_that_are_refused(spark, small):
    graph = small[2]
    seeds = spark.createDataFrame([("n01",)], "seed_id string")
    for ask in (graph_query.subgraph_nodes, graph_query.subgraph_edges):
        for wrong in ((seeds, 0), (None, 0), (None, 2)):
            with pytest.raises(ValueError):
                ask(*graph, *wrong)


def test_neighbourhood(spark, small):
    nodes, edges, graph = small
    known = {n[0] for n in nodes}
    expected = [(s, "outgoing", t, e) for e, s, t, *_ in edges if s in known]
    expected += [(t, "incoming", s, e) for e, s, t, *_ in edges if t in known]
    got = graph_query.incident_edges(*graph)
    assert rows_of(got, "node_id", "direction", "neighbor_id", "edge_id") == sorted(expected)
    pairs = {(r[0], r[2]) for r in expected if r[2] in known}
    assert rows_of(graph_query.neighbors(*graph), "node_id", "neighbor_id") == sorted(pairs)
    some = spark.createDataFrame([("n01",), ("ghost1",)], "node_id string")
    assert {r[0] for r in rows_of(graph_query.incident_edges(*graph, some))} == {"n01"}
    assert ("n01", "n01") in rows_of(graph_query.neighbors(*graph, some), "node_id", "neighbor_id")
    related = rows_of(graph_query.related_counts(*graph))
    ends = graph_build.EDGE_ENDS
    typed = {(s, ends[k][1], t) for _, s, t, k, _ in edges if {s, t} <= known}
    typed |= {(t, ends[k][0], s) for _, s, t, k, _ in edges if {s, t} <= known}
    assert sorted(related) == sorted((n, k, sum(x[:2] == (n, k) for x in typed)) for n, k in {x[:2] for x in typed})
    assert rows_of(graph_query.lookup(graph.nodes, some), "node_id") == [("n01",)]


def test_counts_samples_and_overview(small):
    nodes, edges, graph = small
    by_type = dict(rows_of(graph_query.type_counts(graph.nodes, "node_type")))
    assert sum(by_type.values()) == 25 and by_type["Customer"] == 3
    overview = {(r["kind"], r["type"]): r["count"] for r in graph_query.overview(*graph).collect()}
    assert overview["node", "TOTAL"] == 25 and overview["edge", "TOTAL"] == 31
    assert sum(v for (kind, t), v in overview.items() if kind == "edge" and t != "TOTAL") == 31
    first = [r["node_id"] for r in graph_query.sample_nodes(graph.nodes).collect()]
    assert first == [n[0] for n in sorted(nodes, key=lambda n: (n[1], n[0]))][:5]
    first = [r["edge_id"] for r in graph_query.sample_edges(graph.edges, 3).collect()]
    assert first == [e[0] for e in sorted(edges, key=lambda e: (e[3], e[0]))][:3]
    assert rows_of(counts(graph)) == [("graph_edges", 31), ("graph_nodes", 25)]


def test_merge_last_batch_wins(spark):
    first = spark.createDataFrame([("a", "old"), ("b", "old")], "node_id string, label string")
    second = spark.createDataFrame([("b", "new"), ("c", None)], "node_id string, label string")
    got = rows_of(graph_query.merge([first, second], "node_id"), "node_id", "label", "batch")
    assert got == [("a", "old", 0), ("b", "new", 1), ("c", None, 1)]
    with pytest.raises(ValueError):
        graph_query.merge([], "node_id")


def test_highlight(spark, small):
    refs = spark.createDataFrame([("n03",), ("n03",), ("zzz",)], "ref_id string")
    got = graph_query.highlight(small[2].nodes, "node_id", refs)
    assert got.count() == 25 and rows_of(got.filter("highlighted"), "node_id") == [("n03",)]


def test_pages(small):
    nodes, edges, graph = small
    ids = sorted(n[0] for n in nodes)
    page = graph_query.node_page(graph.nodes, limit=4, after_id=ids[2]).collect()
    assert [r["node_id"] for r in page] == ids[3:7] and {r["total"] for r in page} == {25}
    assert [r["node_id"] for r in graph_query.node_page(graph.nodes, limit=4).collect()] == ids[:4]
    assert graph_query.node_page(graph.nodes, after_id=ids[-1]).collect() == []
    assert graph_query.node_page(graph.nodes, "Customer").count() == 3
    page = graph_query.edge_page(graph.edges, source_type="DeliveryItem", target_type="Plant").collect()
    assert {r["edge_type"] for r in page} == {"DELIVERY_ITEM_FROM_PLANT"}
    source = edges[0][1]
    found = graph_query.filter_edges(graph.edges, source_id=source)
    assert rows_of(found, "edge_id") == sorted((e[0],) for e in edges if e[1] == source)
    for bad in ({"limit": 0}, {"limit": 1001}):
        with pytest.raises(ValueError):
            graph_query.node_page(graph.nodes, **bad)
    with pytest.raises(ValueError):
        graph_query.edge_page(graph.edges, edge_type="UNKNOWN")


def test_typed_path(spark):
    nodes = [("c", "Customer"), ("o", "SalesOrder"), ("i", "SalesOrderItem"), ("x", "Payment"), ("j", "JournalEntry"),
             ("b", "BillingDocument")]
    edges = [("c", "o", "CUSTOMER_PLACED_ORDER"), ("o", "i", "ORDER_HAS_ITEM"), ("i", "p", "ITEM_FOR_PRODUCT"),
             ("gone", "o", "CUSTOMER_PLACED_ORDER"), ("x", "j", "PAYMENT_CLEARS_JOURNAL_ENTRY"),
             ("b", "j", "BILLING_DOCUMENT_POSTED_TO_JOURNAL_ENTRY")]
    graph = (
        spark.createDataFrame([(n, t, n, "{}") for n, t in nodes], NODE_SCHEMA),
        spark.createDataFrame([(f"e{i}", s, t, k, "{}") for i, (s, t, k) in enumerate(edges)], EDGE_SCHEMA),
    )
    path = ["CUSTOMER_PLACED_ORDER", "ORDER_HAS_ITEM", "ITEM_FOR_PRODUCT"]
    assert rows_of(graph_query.typed_path(*graph, path)) == [("c", "o", "i", "p")]
    back = ["PAYMENT_CLEARS_JOURNAL_ENTRY", "BILLING_DOCUMENT_POSTED_TO_JOURNAL_ENTRY"]
    assert rows_of(graph_query.typed_path(*graph, back)) == [("x", "j", "b")]
    assert rows_of(graph_query.typed_path(*graph, back[::-1])) == [("b", "j", "x")]
    with pytest.raises(ValueError):
        graph_query.typed_path(*graph, ["CUSTOMER_PLACED_ORDER", "ITEM_FOR_PRODUCT"])
    with pytest.raises(ValueError):
        graph_query.typed_path(*graph, [])


def test_checks(spark, small):
    rows = [("a", "T", "1", None), ("a", "T", "2", None), ("b", "T", "1", None), (None, "T", "1", None)]
    df = spark.createDataFrame(rows, NODE_SCHEMA)
    assert rows_of(graph_checks.id_report(df, "node_id", "node_type")) == [("T", 4, 2, 1, 1)]
    assert rows_of(graph_checks.duplicate_ids(df, "node_id")) == [("a", 2)]
    assert graph_checks.missing_ids(df, "node_id").count() == 1
    assert rows_of(graph_checks.keep_first(df, "node_id"), "node_id", "label") == [("a", "1"), ("b", "1")]
    many = spark.createDataFrame([(f"i{k % 500}", "T", str(k // 500), None) for k in range(1500)] + [("z", "T", None, None)], NODE_SCHEMA)
    kept = rows_of(graph_checks.keep_first(many, "node_id"), "node_id", "label")
    assert kept == sorted([(f"i{k}", "0") for k in range(500)] + [("z", None)])
    nodes, edges, graph = small
    known = {n[0] for n in nodes}
    expected = [(e[0], end, e[i]) for e in edges for i, end in ((1, "source"), (2, "target")) if e[i] not in known]
    assert rows_of(graph_checks.dangling_edges(*graph), "edge_id", "end", "missing_id") == sorted(expected)


def test_paths_are_counted_and_dead_ends_pruned(spark):
    """A hub with many items of which few go on, and parallel edges."""
    pick = random.Random(2)
    nodes = [(f"c{i}", "Customer", "x", "{}") for i in range(4)]
    edges = [(f"c{pick.randrange(6)}", f"o{i % 9}", "CUSTOMER_PLACED_ORDER") for i in range(20)]
    edges += [("o1", f"i{i}", "ORDER_HAS_ITEM") for i in range(200)] + [("o2", "i1", "ORDER_HAS_ITEM")] * 3
    edges += [(f"i{i}", f"p{i % 2}", "ITEM_FOR_PRODUCT") for i in range(5)] + [("i1", None, "ITEM_FOR_PRODUCT")]
    graph = Graph(
        spark.createDataFrame(nodes, NODE_SCHEMA),
        spark.createDataFrame([(f"e{i}", s, t, k, "{}") for i, (s, t, k) in enumerate(edges)], EDGE_SCHEMA),
    )
    kinds = ["CUSTOMER_PLACED_ORDER", "ORDER_HAS_ITEM", "ITEM_FOR_PRODUCT"]
    steps = [[(s, t) for s, t, k in edges if k == kind] for kind in kinds]
    known = {n[0] for n in nodes}
    paths = [(a, b, c, d) for a, b in steps[0] if a in known for x, c in steps[1] if x == b for y, d in steps[2] if y == c]
    listed = rows_of(graph_query.typed_path(*graph, kinds))
    full = [p for p in paths if p[3] is not None]
    assert sorted(x for x in map(tuple, listed) if x[3] is not None) == sorted(full)
    counted = {(r["step"], r["node_id"]): int(r["paths"]) for r in graph_query.path_counts(*graph, kinds).collect()}
    expected = {}
    for p in paths:
        for step, node in enumerate(p):
            expected[step, node] = expected.get((step, node), 0) + 1
    assert counted == expected and sum(n for (step, _), n in counted.items() if step == 0) == len(paths)
    alive = graph_query._onwards(graph_query._hops(graph.edges, kinds)[1:])
    assert rows_of(alive[1], "node_2") == [(f"i{i}",) for i in range(5)]


def test_store(spark, small, tmp_path):
    graph = small[2]
    written = write_graph(graph, str(tmp_path / "g"))
    assert rows_of(written.nodes) == rows_of(graph.nodes) and rows_of(written.edges) == rows_of(graph.edges)
    assert (tmp_path / "g" / "versions" / versions(spark, str(tmp_path / "g"))[0] / "edges" / "edge_type=ORDER_HAS_ITEM").is_dir()
    assert rows_of(read_graph(spark, str(tmp_path / "g")).nodes) == rows_of(graph.nodes)
    assert rows_of(counts(written)) == rows_of(counts(graph))
    assert sorted(r[0] for r in written.absent.collect()) == sorted(
        {x for e in small[1] for x in e[1:3]} - {n[0] for n in small[0]}
    )
    twice = Graph(graph.nodes.unionByName(graph.nodes), graph.edges)
    with pytest.raises(GraphIntegrityError):
        write_graph(twice, str(tmp_path / "h"))
    with pytest.raises(FileNotFoundError):
        read_graph(spark, str(tmp_path / "h"))
    assert write_graph(twice, str(tmp_path / "h"), strict=False).nodes.count() == 25


STEPS = ("_write", "_violations", "_describe", "touch", "delete")


@pytest.mark.parametrize("step", STEPS)
def test_a_writer_that_dies_leaves_a_whole_graph(spark, small, tmp_path, monkeypatch, step):
    """Stops the third write before or in each of its steps."""
    graph, path = small[2], str(tmp_path / "g")
    write_graph(graph, path)
    opened = write_graph(Graph(graph.nodes.limit(20), graph.edges), path)
    calls = []

    def die(*_, **__):
        calls.append(1)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(graph_store, step, die)
        with pytest.raises(KeyboardInterrupt):
            write_graph(Graph(graph.nodes.limit(10), graph.edges), path)
    assert calls
    now = 10 if step == "delete" else 20  # the new version is current before old ones go
    assert read_graph(spark, path).nodes.count() == now and opened.nodes.count() == 20
    lost = vacuum(spark, path)
    assert len(lost) == (0 if step in ("_write", "delete") else 1) and read_graph(spark, path).nodes.count() == now
    assert write_graph(graph, path).nodes.count() == 25 and len(versions(spark, path)) == 2


def test_readers_stay_on_their_version(spark, small, tmp_path):
    graph, path = small[2], str(tmp_path / "g")
    first = write_graph(graph, path)
    second = write_graph(Graph(graph.nodes.limit(5), graph.edges.limit(3)), path)
    assert first.nodes.count() == 25 and second.nodes.count() == 5
    old, new = versions(spark, path)
    assert read_graph(spark, path, old).nodes.count() == 25 and read_graph(spark, path).nodes.count() == 5
    with pytest.raises(FileNotFoundError):
        read_graph(spark, path, "000000000009-x")


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """A stored graph of three node types in many files."""
    nodes = spark.range(6000).selectExpr(
        "concat(case id % 3 when 0 then 'customer_' when 1 then 'salesorder_' else 'plant_' end, lpad(id, 6, '0')) as node_id",
        "case id % 3 when 0 then 'Customer' when 1 then 'SalesOrder' else 'Plant' end as node_type",
        "concat('n', id) as label", "'{}' as metadata_json",
    )
    edges = spark.range(4000).selectExpr(
        "concat('e', lpad(id, 6, '0')) as edge_id", "concat('customer_', lpad(id * 3 % 6000, 6, '0')) as source_id",
        "concat('salesorder_', lpad(id * 3 % 5999 + 1, 6, '0')) as target_id", "'CUSTOMER_PLACED_ORDER' as edge_type", "'{}' as metadata_json",
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    stored = write_graph(Graph(nodes, edges), str(tmp_path_factory.mktemp("large") / "g"))
    for k, v in before.items():
        spark.conf.set(k, v)
    return Graph(nodes, edges), stored


def files_of(df):
    return len(df.inputFiles())


def test_pages_read_the_files_they_lie_in(large):
    graph, stored = large
    assert stored.files.filter("kind = 'nodes'").count() >= 40
    for kind in (None, "SalesOrder"):
        ids = sorted(r[0] for r in graph.nodes.filter("true" if kind is None else f"node_type = '{kind}'").select("node_id").collect())
        for after in (None, "", ids[0], ids[777], "plant_003", ids[-3], ids[-1], "zzz"):
            page = graph_query.stored_node_page(stored, kind, 50, after)
            expected = [i for i in ids if after is None or i > after][:50]
            got = page.collect()
            assert [r["node_id"] for r in got] == expected and {r["total"] for r in got} <= {len(ids)}
            assert files_of(page) <= 4
    page = graph_query.stored_edge_page(stored, 10, "e001", edge_type="CUSTOMER_PLACED_ORDER")
    assert [r["edge_id"] for r in page.collect()] == [f"e{i:06}" for i in range(1000, 1010)] and files_of(page) <= 3
    assert graph_query.stored_edge_page(stored, target_type="Plant").collect() == []
    page = graph_query.stored_edge_page(stored, source_id="customer_000003")
    assert rows_of(page, "edge_id") == rows_of(graph_query.filter_edges(graph.edges, source_id="customer_000003"), "edge_id")
    for bad in ({"limit": 0}, {"edge_type": "UNKNOWN"}):
        with pytest.raises(ValueError):
            graph_query.stored_edge_page(stored, **bad)


def test_a_few_ids_read_few_files(spark, large):
    graph, stored = large
    ids = spark.createDataFrame([("customer_000003",), ("plant_000002",), ("nowhere",), (None,)], "node_id string")
    found = graph_query.stored_lookup(stored, ids)
    assert rows_of(found, "node_id") == [("customer_000003",), ("plant_000002",)] and files_of(found) <= 3
    both = [f(g, *rest) for f, g, *rest in ((graph_query.stored_incident_edges, stored, ids),)]
    assert rows_of(both[0], "node_id", "edge_id") == rows_of(graph_query.incident_edges(*graph, ids), "node_id", "edge_id")
    assert rows_of(graph_query.stored_neighbors(stored, ids)) == rows_of(graph_query.neighbors(*graph, ids))
    many = graph.nodes.select("node_id").limit(500)
    assert graph_query.stored_lookup(stored, many).count() == 500
    assert rows_of(graph_query.stored_incident_edges(stored, many), "node_id", "edge_id") == rows_of(
        graph_query.incident_edges(*graph, many), "node_id", "edge_id"
    )


def test_absent_ids_can_be_kept(small):
    graph = small[2]
    absent = graph_checks.absent_ends(*graph)
    for ask in (graph_query.incident_edges, graph_query.neighbors, graph_query.related_counts):
        assert rows_of(ask(*graph, absent=absent)) == rows_of(ask(*graph))
    for ask in (graph_query.subgraph_nodes, graph_query.subgraph_edges):
        assert rows_of(ask(*graph, None, 1, absent)) == rows_of(ask(*graph, None, 1))


def test_payments_of_one_document_share_a_node(make_tables):
    rows = [
        {"accountingdocument": "x", "accountingdocumentitem": i, "amountintransactioncurrency": a}
        for i, a in (("1", "5"), ("2", "5"), ("3", "6"))
    ]
    payments = graph_build.nodes_of_type(make_tables(payments_accounts_receivable=rows), "Payment")
    assert rows_of(graph_checks.duplicate_ids(payments, "node_id")) == [("payment_x", 2)]


def test_a_failed_check_keeps_the_old_graph(spark, small, tmp_path):
    graph, path = small[2], str(tmp_path / "kept")
    write_graph(graph, path)
    twice = Graph(graph.nodes.unionByName(graph.nodes.limit(1)), graph.edges.limit(2))
    with pytest.raises(GraphIntegrityError):
        write_graph(twice, path)
    assert read_graph(spark, path).nodes.count() == 25
    assert [p.name for p in tmp_path.iterdir()] == ["kept"] and vacuum(spark, path) == []


def test_types_of_seeds_change_the_work_but_no_row(spark, monkeypatch):
    """A graph whose edges lead where their types say; some ids have no node."""
    pick = random.Random(5)
    ids = {t: [f"{t}_{i}" for i in range(4)] for t in TYPES}
    nodes = [(n, t, f"label {n}", "{}") for t in TYPES for n in ids[t][:3]]
    edges = []
    for k, (name, (source, target)) in enumerate(graph_build.EDGE_ENDS.items()):
        edges += [(f"e{k}_{i}", pick.choice(ids[source]), pick.choice(ids[target]), name, "{}") for i in range(6)]
    graph = Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA))
    kinds = ["Payment", "Plant"]
    seeds = graph.nodes.filter(graph.nodes.node_type.isin(kinds)).selectExpr("node_id AS seed_id")
    chosen = seeds.withColumnRenamed("seed_id", "node_id")
    for depth in (1, 2, 3):
        for operator in (graph_query.subgraph_nodes, graph_query.subgraph_edges):
            assert rows_of(operator(*graph, seeds, depth, types=kinds)) == rows_of(operator(*graph, seeds, depth))
    for operator in (graph_query.incident_edges, graph_query.neighbors, graph_query.related_counts):
        assert rows_of(operator(*graph, chosen, types=kinds)) == rows_of(operator(*graph, chosen))
    read = graph_query._adjacency(graph.edges, types=["Payment"])
    assert {r.node_id for r in read.collect()} <= set(ids["Payment"])


def test_a_staged_graph_is_not_staged_again(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_store, "stage", lambda *_, **__: pytest.fail("staged again"))
    written = write_graph(small[2], str(tmp_path / "g"), staged=True)
    assert rows_of(written.nodes) == rows_of(small[2].nodes) and rows_of(written.edges) == rows_of(small[2].edges)


def test_columns_about_nodes_go_with_their_neighbours(spark, small):
    graph = small[2]
    about = spark.createDataFrame([("n01", 1.5), ("n01", 2.5), ("n02", None), ("nobody", 3.0)], "node_id string, days double")
    found = graph_query.neighbors(*graph, about=about)
    assert rows_of(found) == rows_of(graph_query.neighbors(*graph).join(about, "node_id", "left").select(found.columns))


def test_dangling_ends_with_kept_absent_ids(small):
    graph = small[2]
    absent = graph_checks.absent_ends(*graph)
    for ask in (graph_checks.dangling_counts, graph_checks.dangling_edges):
        assert rows_of(ask(*graph, absent)) == rows_of(ask(*graph))


def test_absent_ids_around_some_types(small):
    nodes, edges = graph_query.around(*small[2], ["SalesOrder"])
    assert {r[0] for r in nodes.select("node_type").distinct().collect()} == {"SalesOrder", "Customer", "SalesOrderItem"}
    assert {r[0] for r in edges.select("edge_type").distinct().collect()} == {"CUSTOMER_PLACED_ORDER", "ORDER_HAS_ITEM"}


def test_an_expected_size_spares_counting(spark, small, tmp_path):
    written = write_graph(small[2], str(tmp_path / "g"), staged=True, expected=100)
    assert rows_of(written.nodes) == rows_of(small[2].nodes) and rows_of(written.edges) == rows_of(small[2].edges)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_links_are_the_edges_that_subgraphs_follow(spark, depth):
    ids = {t: [f"{t}{i}" for i in range(3)] for t in TYPES}
    pick = random.Random(depth)
    nodes = [(i, t, i, "{}") for t, all_ids in ids.items() for i in all_ids]
    edges = [
        (f"{name}{i}", pick.choice(ids[ends[0]]), pick.choice(ids[ends[1]]), name, "{}")
        for name, ends in graph_build.EDGE_ENDS.items()
        for i in range(3)
    ]
    graph = Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA))
    seeds = graph.nodes.filter("node_type = 'Payment'").selectExpr("node_id AS seed_id")
    links = graph_query.links(graph.edges, ["Payment"], depth)
    assert links.columns == ["edge_type", "source_id", "target_id"] and links.count() < len(edges)
    found = graph_query.subgraph_nodes(graph.nodes, links, seeds, depth, types=["Payment"])
    assert rows_of(found) == rows_of(graph_query.subgraph_nodes(*graph, seeds, depth))


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_edges_of_deep_subgraphs_by_types_are_those_without(spark, messy_flow):
    _, tables = messy_flow
    graph = graph_build.build_nodes(tables), graph_build.build_edges(tables)
    for kind in ("Payment", "Plant", "SalesOrder"):
        seeds = graph[0].filter(F.col("node_type") == kind).select(F.col("node_id").alias("seed_id"))
        for depth in (2, 3):
            found = graph_query.subgraph_edges(*graph, seeds, depth, types=[kind])
            assert rows_of(found) == rows_of(graph_query.subgraph_edges(*graph, seeds, depth))


def test_neighborhoods_of_all_nodes_by_single_links(spark, messy_flow):
    _, tables = messy_flow
    nodes, links = graph_build.build_nodes(tables), graph_build.build_links(tables)
    found = graph_query.subgraph_nodes(nodes, links, None, 1, single=True)
    assert rows_of(found) == rows_of(graph_query.subgraph_nodes(nodes, graph_build.build_edges(tables), None, 1))


def test_loops_repeated_edges_and_repeated_nodes(spark):
    labels = [("a", "one"), ("a", "two"), ("b", "b"), (None, "none")]
    ends = [("a", "b"), ("b", "a"), ("a", "b"), ("a", "a"), ("b", None), ("b", "ghost")]
    nodes = spark.createDataFrame([(node, "Plant", label, "{}") for node, label in labels], NODE_SCHEMA)
    edges = [(f"e{i}", source, target, "ORDER_HAS_ITEM", "{}") for i, (source, target) in enumerate(ends)]
    edges = spark.createDataFrame(edges, EDGE_SCHEMA)
    found = graph_query.subgraph_nodes(nodes, edges, None, 1).select("seed_id", "node_id", "label")
    want = [("a", "a", "one"), ("a", "a", "two"), ("a", "b", "b"), ("b", "a", "one"), ("b", "a", "two"), ("b", "b", "b")]
    assert sorted(map(tuple, found.collect())) == want


def test_overview_passes_each_row_on_once(spark, messy_flow):
    _, tables = messy_flow
    rows, edges = graph_build.build_nodes(tables), graph_build.build_edges(tables)
    # The rows of a type are counted before they are expanded to the totals.
    plan = _plan(graph_query.overview(rows, edges))
    first, second = plan.index("Expand"), plan.rindex("Expand")
    assert all("partial_count" in part for part in (plan[first:second], plan[second:])) and "partial_sum" in plan[:first]
    counted = {(r.kind, r.type): r["count"] for r in graph_query.overview(rows, edges).collect()}
    assert counted["node", "TOTAL"] == rows.count()


def test_single_links_are_counted_without_distinct_pairs(messy_flow):
    tables = messy_flow[1]
    nodes, edges, links = graph_build.build_nodes(tables), graph_build.build_edges(tables), graph_build.build_links(tables)
    found = graph_query.related_counts(nodes, links, single=True)
    assert rows_of(found) == rows_of(graph_query.related_counts(nodes, edges)) != []
    absent = graph_checks.absent_ends(nodes, edges)
    plans = [_plan(graph_query.related_counts(nodes, links, absent=absent, single=s)) for s in (True, False)]
    assert plans[0].count("Exchange hashpartitioning") < plans[1].count("Exchange hashpartitioning")
