"""Registered graph queries against plain versions over the smallest tables."""

import hashlib
import json
from collections import Counter

import pytest

from grafwerk import queries
from grafwerk.graph import Graph
from grafwerk.operators import subset
from grafwerk.plans.local import LocalGraph
from grafwerk.sources.relational import SUBCLASS, TYPE, graph_from_tables


@pytest.fixture(scope="module")
def tables(spark, small_dir):
    graph = graph_from_tables(spark, small_dir).settled()
    edges = {tuple(r) for r in graph.edges.collect()}
    return edges, {r["node"]: r["value"] for r in graph.nodes.collect()}


def test_content_hash_of_all_edges(spark, small_dir, tables):
    want = hashlib.sha256(json.dumps(sorted(map(list, tables[0]))).encode()).hexdigest()[:16]
    assert queries.QUERIES["content_hash"](spark, small_dir).first()[0] == want


def test_curie_of_all_nodes(spark, small_dir, tables):
    found = {r["iri"]: r["curie"] for r in queries.QUERIES["curie_abbreviate_nodes"](spark, small_dir).collect()}
    iris = {"http://g.org/" + n.replace(":", "/") for n in tables[1]}
    assert found == {i: "ord:" + i[15:] if i.startswith("http://g.org/o/") else "g:" + i[13:] for i in iris}


def plain_deletion(edges, values, rules):
    """(deleted nodes, edges left, (round, op, rule) counts) of rounds over plain sets."""
    edges, values, log, gone, number = set(edges), dict(values), Counter(), set(), 0
    while True:
        number += 1
        local, by = LocalGraph(edges, values), {}
        for rule in rules:
            for n in local.node(rule.phi) - local.node(rule.psi):
                by.setdefault(n, rule.cid)
        if not by:
            return gone, edges, log
        for src, _, dst in (lost := [e for e in edges if e[0] in by or e[2] in by]):
            log[number, "remove_edge", by[src] if dst not in by or (src in by and src <= dst) else by[dst]] += 1
        log.update((number, "remove_node", cid) for cid in by.values())
        edges -= set(lost)
        values = {n: v for n, v in values.items() if n not in by}
        gone |= set(by)


def test_deletion_by_all_rules(spark, small_dir, tables):
    gone, left, log = plain_deletion(*tables, subset.eligible(queries.RULES))
    assert len({cid for _, _, cid in log}) > 2 and gone
    run = lambda name: queries.QUERIES[name](spark, small_dir)
    assert {r["n"] for r in run("subset_all_deleted_nodes").collect()} == gone
    assert {tuple(r) for r in run("subset_all_remaining_edges").collect()} == left
    assert {(r["round"], r["op"], r["constraint"]): r["n"] for r in run("subset_all_changelog_counts").collect()} == log
    assert {tuple(r) for r in run("subset_all_diff_removed").collect()} == tables[0] - left


def test_deletion_cascade_of_the_table_rules(spark):
    """A class that goes takes an order along, which was the class of a part."""
    triples = [
        ("x", "kg:supplier", "cls:Order"), ("o:1", TYPE, "cls:Order"), ("o:1", "kg:customer", "c:1"), ("c:1", TYPE, "cls:Customer"),
        ("o:1", SUBCLASS, "cls:Part"), ("p:9", TYPE, "o:1"), ("o:6", "kg:part", "p:9"),
    ]
    graph = Graph.from_triples(spark, triples, {c: c for c in ("cls:Customer", "cls:Order", "cls:Part")}).settled()
    edges, values = {tuple(r) for r in graph.edges.collect()}, {r["node"]: r["value"] for r in graph.nodes.collect()}
    gone, left, log = plain_deletion(edges, values, subset.eligible(queries.RULES))
    result = subset.subset_repair(graph, queries.RULES)
    assert {r["n"] for r in result.deleted().collect()} == gone and {tuple(r) for r in result.graph.edges.collect()} == left
    assert Counter((r.round, r.op, r.constraint) for r in result.log.collect()) == log
    assert {number for number, *_ in log} == {1, 2, 3} and gone == {"cls:Order", "o:1", "p:9"}
