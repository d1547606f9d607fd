"""What grows with the input: profiles instead of nodes, repairs that do what is asked for, the build from tables."""

import hashlib
import json
from collections import Counter

import pytest

from grafwerk import propose, queries
from grafwerk.graph import Graph, compared, difference
from grafwerk.operators import metrics, profiles, search, shape_rules, shapes, subset, superset
from grafwerk.sources import relational
from grafwerk.sources.relational import SUBCLASS, TYPE, graph_from_tables


def orders(spark, copies):
    """Orders of three kinds, the third untyped, each with a customer and a part of its own."""
    triples = [("cls:Order_F", SUBCLASS, "cls:Order")]
    for i in range(copies):
        for kind in range(3):
            o = f"o:{kind}:{i}"
            triples += [(o, "kg:customer", f"c:{i}"), (f"c:{i}", TYPE, "cls:Customer")] + [(o, "kg:part", f"p:{i}")] * (kind > 0) + [(o, TYPE, "cls:Order_F")] * (kind < 2)
    return Graph.from_triples(spark, triples, {c: c for c in ("cls:Order", "cls:Order_F", "cls:Customer")}).settled()


@pytest.fixture(scope="module")
def two_sizes(spark):
    return orders(spark, 25), orders(spark, 75)


def test_search_tables_dont_grow_with_nodes(two_sizes):
    """mine_widenings, mine_dominant, mine_stability, mine_admitted, mine_pca_scores, candidate_cids, mine_near_misses"""
    rows = [[t.count() for t in queries._scores(g)] for g in two_sizes]
    assert rows[0] == rows[1] and max(rows[0]) < 200
    scores = [{(r["body"], r["head"]): r["confidence"] for r in queries._scores(g)[0].collect()} for g in two_sizes]
    assert scores[0] == scores[1]
    support = queries._scores(two_sizes[1])[0].where("body = 'd_kg:customer' AND head = 'c_cls:Order'").first()
    assert (support["size"], support["support"], support["denominator"]) == (225, 150, 150)


def test_shape_tables_dont_grow_with_nodes(two_sizes):
    """shape_typing, shape_exceptions, shape_reduced_cover, shape_rule_counts"""
    rows = [[t.count() for t in queries._bodies(g)[1:]] for g in two_sizes]
    assert rows[0] == rows[1] and max(rows[0]) < 50
    found = shape_rules.exceptions(*queries._bodies(two_sizes[1])).where("body = 'd_kg:part'").orderBy("rank")
    assert [r["n"] for r in found.collect()] == sorted(f"o:2:{i}" for i in range(75))[:10]


def test_counts_over_nodes_read_profiles(two_sizes, monkeypatch):
    """mine_negated_exclusion, metric_property_coverage"""
    cfg = queries.MINING
    for g in two_sizes:
        assert search.profiled(g, cfg).known.count() == 5  # three kinds of orders, customers, parts
        monkeypatch.setattr(profiles, "tagged", None)  # the graph's edges are gathered once
        assert shapes.negated_exclusions(g, cfg).count() == 0 and shapes.requirements(g, cfg).count()
        monkeypatch.undo()
    rows = {(r["cls"], r["label"]): (r["carriers"], r["instances"]) for r in metrics.property_coverage(two_sizes[0]).collect()}
    assert rows == {("cls:Order_F", "kg:customer"): (50, 50), ("cls:Order_F", "kg:part"): (25, 50)}


def test_profiles_in_sets_and_with_nulls(spark):
    edges = spark.createDataFrame([("a", TYPE, "X"), ("a", "p", "b"), ("c", "p", "b"), ("d", TYPE, None), (None, "p", "b"), ("it's\\", "q'\\", "b")], "src string, label string, dst string")
    graph = Graph.of(edges)
    both = [Counter((r["n"] is None, tuple(sorted(r["tags"])), r["weight"]) for r in profiles.profiles(graph, [TYPE], [SUBCLASS], most=most).known.collect()) for most in (1, profiles.BIT_TAGS)]
    assert both[0] == both[1] and both[0][(True, ("d_p",), 1)] == 1 and both[0][(False, ("t",), 1)] == 1 and both[0][(False, ("d_q'\\",), 1)] == 1


def test_paths_by_tasks_of_few_edges(spark, two_sizes, monkeypatch):
    """shape_forward_paths"""
    graph = Graph.from_triples(spark, [e for i in range(30) for e in ((f"a{i}", "p", f"b{i % 3}"), (f"b{i % 3}", "q", "c"))]).settled()
    cfg = search.SearchConfig(min_support=20, max_path=2, type_predicate=TYPE, subclass_predicate=SUBCLASS)
    plain = shape_rules.path_extensions(graph, search.SearchConfig(min_support=3, max_path=2, type_predicate=TYPE, subclass_predicate=SUBCLASS))
    monkeypatch.setattr(shape_rules, "TASK_EDGES", 4)
    dealt = shape_rules.path_extensions(graph, search.SearchConfig(min_support=3, max_path=2, type_predicate=TYPE, subclass_predicate=SUBCLASS))
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect())) == sorted(("p_p\x02q", f"a{i}") for i in range(30))
    assert shape_rules.path_extensions(graph, cfg).count() == 0  # q has too few starts


def test_hash_reads_packed_pieces(spark, monkeypatch):
    """content_hash"""
    triples = sorted({(f"nä{i:04}", 'p"\\', f"m{i % 7}") for i in range(3000)})
    graph, pieces = Graph.from_triples(spark, triples, {"m1": "ü"}).settled(), []
    frame, stream = type(graph.edges), type(graph.edges).toLocalIterator

    def counted(self, *args, **more):
        for row in stream(self, *args, **more):
            pieces.append(row)
            yield row

    monkeypatch.setattr(frame, "toLocalIterator", counted)
    assert graph.content_hash() == hashlib.sha256(json.dumps(list(map(list, triples))).encode()).hexdigest()[:16]
    assert len(pieces) < 100
    whole = json.dumps({"edges": list(map(list, triples)), "values": [["m1", "ü"]]}, ensure_ascii=False)
    assert graph.content_hash(values=True) == hashlib.sha256(whole.encode()).hexdigest()[:16]
    empty = Graph.from_triples(spark, [])
    assert empty.content_hash() == hashlib.sha256(b"[]").hexdigest()[:16]


def test_impact_runs_each_rule_once(spark, small_dir, monkeypatch):
    """impact_measured"""
    asked = []
    monkeypatch.setattr(propose, "measure_impact", lambda g, c: asked.append(c.cid) or {"witnesses": 1, "subset_deletions": 2, "superset_additions": 3})
    assert {tuple(r) for r in queries.QUERIES["impact_measured"](spark, small_dir).collect()} == {("rng.part", 1, 2, 3), ("req.doc_label", 1, 2, 3)}
    assert asked == ["rng.part", "req.doc_label"]


def test_repairs_leave_out_what_isnt_asked_for(spark, small_dir, monkeypatch):
    """subset_all_deleted_nodes, subset_all_changelog_counts, subset_remaining_edges, diff_added, superset_cascade"""
    graph = graph_from_tables(spark, small_dir)
    monkeypatch.setattr(subset, "round_log", None)  # log and attestations aren't made
    for module in (subset, superset):
        monkeypatch.setattr(module, "compared", None)
    result = subset.subset_repair(graph, queries.RULES)
    counts = {(r["round"], r["op"], r["constraint"]): r["n"] for r in result.changes().groupBy("round", "op", "constraint").count().withColumnRenamed("count", "n").collect()}
    added = superset.superset_repair(graph, queries.ADDITIONS, prune=False)
    monkeypatch.undo()
    assert sum(n for (_, op, _), n in counts.items() if op == "remove_node") == result.deleted().count() == result.log.where("op = 'remove_node'").count()
    rows = lambda df: sorted(map(tuple, df.select("src", "label", "dst").collect()))
    for after in (subset.subset_repair(graph, queries.DELETIONS).graph, added.graph):
        short, long = difference(graph, after), compared(graph, after)
        assert rows(short[0]) == rows(long[0]) and rows(short[1]) == rows(long[1]) and (rows(short[0]) or rows(short[1]))
    assert all(added.attestations.values()) and all(result.attestations.values())


def test_compared_metrics_are_those_asked_for(spark, small_dir, monkeypatch):
    """metric_compare"""
    monkeypatch.setattr(metrics, "property_coverage", None)
    assert {r["metric"] for r in queries.QUERIES["metric_compare"](spark, small_dir).collect()} == {"nodes", "edges"}


def test_stored_graph_isnt_stored_again(spark, small_dir):
    graph = graph_from_tables(spark, small_dir)
    assert graph.settled() is graph
    assert graph.remove_nodes(graph.with_value("cls:Order")).settled() is not graph


def test_build_from_odd_tables(spark, tmp_path, small_dir):
    """Nulls, equal rows, keys that are texts, and classes that meet: the same as the SQL."""
    odd = {
        "orders": "SELECT * FROM VALUES (1L, 1L, 'F'), (1L, 1L, 'F'), (2L, NULL, 'F'), (3L, 2L, NULL), (NULL, 2L, 'O') t(o_orderkey, o_custkey, o_orderstatus)",
        "lineitem": "SELECT * FROM VALUES (1L, 5L, 7L), (1L, 5L, 7L), (1L, NULL, 7L), (9L, 6L, NULL) t(l_orderkey, l_partkey, l_suppkey)",
        "customer": "SELECT * FROM VALUES (1, 3L, 1.0D, 'Customer'), (25, 3L, -1.0D, 'Order_F'), (2, 4L, 0.0D, NULL) t(c_custkey, c_nationkey, c_acctbal, c_mktsegment)",
        "part": "SELECT * FROM VALUES ('x', 'Order_F', 5), ('y', NULL, 5), ('z', 'Small', 1) t(p_partkey, p_type, p_size)",
    }
    for table in relational.TABLES:
        frame = spark.sql(odd[table]) if table in odd else spark.read.parquet(f"{small_dir}/{table}.parquet")
        frame.write.parquet(f"{tmp_path}/{table}.parquet")
    graph, sql = graph_from_tables(spark, str(tmp_path)), relational.EDGE_SQL
    for table in relational.TABLES:
        spark.read.parquet(f"{tmp_path}/{table}.parquet").createOrReplaceTempView(f"odd_{table}")
        sql = sql.replace(f"FROM {table}", f"FROM odd_{table}")
    edges = spark.sql(sql)
    edges.createOrReplaceTempView("odd_edges")
    rows = lambda df, *columns: Counter(tuple(r) for r in df.select(*columns).collect())
    assert rows(graph.edges, "src", "label", "dst") == rows(edges, "src", "label", "dst")
    assert rows(graph.nodes, "node", "value") == rows(spark.sql(relational.NODE_SQL.replace("FROM edges", "FROM odd_edges")), "node", "value")
