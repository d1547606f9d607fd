"""Loading, validation, repairs, metrics, mining and the control plane on small graphs."""

import json
import random

import pytest

from grafwerk import api, catalogue, cli
from grafwerk.candidates import ACCEPTED, Candidate, CandidateFile
from grafwerk.graph import Graph
from grafwerk.operators import search, shape_rules, superset
from grafwerk.plans.local import LocalGraph
from grafwerk.rules import Constraint, ConstraintSet, rule_set
from grafwerk.synth import generate

TYPE, SUB = "wdt:P31", "wdt:P279"
MINI = """# a city, a country and some faults
<wd:Q515> <wdt:P279> <wd:Q2221906> .
<wd:Q6256> <wdt:P279> <wd:Q2221906> .
<wd:good> <wdt:P31> <wd:Q515> .
<wd:good> <wdt:P17> <wd:land> .
<wd:good> <wdt:P131> <wd:area> .
<wd:land> <wdt:P31> <wd:Q6256> .
<wd:untyped> <wdt:P17> <wd:land> .
<wd:untyped> <wdt:P131> <wd:area> .
<wd:lonely> <wdt:P31> <wd:Q515> .
<wd:lonely> <wdt:P131> <wd:area> .
<wd:odd> <wdt:P31> <wd:Q515> .
<wd:odd> <wdt:P17> <wd:noland> .
<wd:land> <wdt:P47> <wd:other> .
<wd:land> <rdfs:label> "Land \\"x\\""@en .
<wd:land> <rdfs:label> "Later" .
"""


@pytest.fixture(scope="module")
def mini(spark):
    return api.from_lines(spark, MINI.splitlines()).settled()


@pytest.fixture(scope="module")
def rules():
    return catalogue.get("geography", "wikidata")


def names(df):
    return sorted(r[0] for r in df.collect())


def test_loading(spark, mini):
    values = {r["node"]: r["value"] for r in mini.nodes.where("value IS NOT NULL").collect()}
    assert values["wd:land#label"] == "Later" and values["wd:Q515"] == "wd:Q515"
    assert mini.stats().first().asDict() == {"nodes": 12, "edges": 14, "labels": 6, "valued_nodes": 4}
    with pytest.raises(Exception, match="not a triple"):
        api.from_lines(spark, ["<a> <b>"]).edges.collect()
    with pytest.raises(Exception, match="not a triple"):
        api.from_lines(spark, ['"a" <b> <c> .']).edges.collect()


def test_ntriples_round_trip(spark, mini, tmp_path):
    api.write_ntriples(mini, str(tmp_path / "out"), files=1)
    again = api.read_ntriples(spark, str(tmp_path / "out"))
    assert again.content_hash(values=True) == mini.content_hash(values=True)


def test_validation(mini, rules):
    found = {v.constraint.cid: v.witnesses for v in api.validate(mini, rules).violations}
    assert found["geo.wd.dom.country"] == ("wd:untyped",)
    assert found["geo.wd.rng.country"] == ("wd:noland",)
    assert found["geo.wd.type.city"] == ("wd:untyped",)
    assert found["geo.wd.req.city_country"] == ("wd:lonely",)
    assert found["geo.wd.sym.border"] == ("wd:land",) and found["geo.wd.func.country"] == ()


def test_subset_repair(mini, rules):
    result = api.subset_repair(mini, rules)
    assert names(result.deleted()) == ["wd:noland", "wd:untyped"] and all(result.attestations.values())
    log = [(r.op, r.node or f"{r.src} {r.label} {r.dst}", r.constraint) for r in api.records(result.log)]
    assert log == [
        ("remove_edge", "wd:odd wdt:P17 wd:noland", "geo.wd.rng.country"), ("remove_node", "wd:noland", "geo.wd.rng.country"),
        ("remove_edge", "wd:untyped wdt:P131 wd:area", "geo.wd.dom.country"), ("remove_edge", "wd:untyped wdt:P17 wd:land", "geo.wd.dom.country"), ("remove_node", "wd:untyped", "geo.wd.dom.country"),
    ]
    assert api.subset_repair(mini, rules, "incremental").graph.content_hash() == result.graph.content_hash()


def test_deletion_cascade(spark):
    """Deleting a witness can make another one."""
    graph = Graph.from_triples(spark, [("a", "p", "b"), ("b", "p", "c")], {}).settled()
    chain = rule_set("chain", [Constraint("has.p", "< up(p) >", "< down(p) >")])
    result = api.subset_repair(graph, chain)
    assert result.rounds == 3 and names(result.graph.nodes.select("node")) == ["a"]


def test_superset_repair(mini, rules):
    result = api.superset_repair(mini, rules)
    added = sorted(tuple(r) for r in result.added_edges().collect())
    assert ("wd:lonely", "wdt:P17", "fresh:geo.wd.req.city_country:0") in added and ("wd:untyped", TYPE, "wd:Q515") in added
    assert ("wd:untyped", TYPE, "wd:Q2221906") not in added  # pruned: a city is a place
    assert result.pruned_edges == 1 and all(result.attestations.values())
    assert api.superset_repair(mini, rules, prune=False).pruning == "off"


def plain_prune(result, rules):
    """All added edges of an unpruned repair, tried one by one."""
    edges = {tuple(r) for r in result.graph.edges.collect()}
    values = {r["node"]: r["value"] for r in result.graph.nodes.collect()}
    log = sorted((r.round, r.constraint, r.src, r.label, r.dst) for r in api.records(result.log) if r.op == "add_edge")
    for *_, src, label, dst in log:
        local = LocalGraph(edges - {(src, label, dst)}, values)
        if not any(local.node(c.phi) - local.node(c.psi) for c in rules):
            edges.remove((src, label, dst))
    return edges


def pruned_as_plain(graph, rules, how="grouped"):
    want = plain_prune(api.superset_repair(graph, rules, prune=False), rules)
    result = api.superset_repair(graph, rules)
    assert result.pruning == how and all(result.attestations.values())
    assert {tuple(r) for r in result.graph.edges.collect()} == want
    assert want >= {tuple(r) for r in result.added_edges().collect()}
    return result


def test_prune_reason_is_pruned(spark):
    """The type of a fresh node goes with the edge that asked for it, and so does the node."""
    graph = Graph.from_triples(spark, [("w", "x", "v")], {}).settled()
    rules = rule_set("cascade", [
        Constraint("A", "< down(x) >", "< down(y) >"),
        Constraint("C", "< down(x) >", '< down(y) . [val("named")] >'),
        Constraint("R", "< up(y) >", f'< down({TYPE}) . [val("T")] >'),
    ])
    result = pruned_as_plain(graph, rules)
    assert {tuple(r) for r in result.added_edges().collect()} == {("w", "y", "named"), ("named", TYPE, "T")}
    assert names(result.graph.nodes.select("node")) == ["T", "named", "v", "w"] and result.pruned_edges == 2


def test_prune_beyond_the_old_limits(spark):
    """6,000 nodes with two added types each, of which one is redundant."""
    triples = [("City", SUB, "Geo"), *[(f"x{i}", "near", f"x{i + 1}") for i in range(6000)], *[(f"x{i}", "mayor", "m") for i in range(6000)]]
    graph = Graph.from_triples(spark, triples, {"City": "City", "Geo": "Geo"}).settled()
    typed = lambda c: f'< down({TYPE}) . down({SUB})* . [val("{c}")] >'
    rules = rule_set("large", [Constraint("a", "< down(near) >", typed("Geo")), Constraint("b", "< down(mayor) >", typed("City"))])
    result = api.superset_repair(graph, rules)
    assert result.pruned_edges == 6000 and result.pruning == "grouped" and all(result.attestations.values())
    assert {tuple(r) for r in result.added_edges().collect()} == {(f"x{i}", TYPE, "City") for i in range(6000)}


@pytest.mark.parametrize("seed", range(4))
def test_prune_random(spark, seed):
    rng = random.Random(seed)
    triples = {(f"n{rng.randrange(9)}", rng.choice("pqr"), f"n{rng.randrange(9)}") for _ in range(9)}
    graph = Graph.from_triples(spark, sorted(triples), {}).settled()
    sides = ["< down(p) >", "< up(p) >", "< down(q) >", "< up(q) >", "< down(r) >", "< up(r) >", '< down(s) . [val("S")] >', "< up(s) >", "< down(p) > & < down(q) >", '< down(t) . [val("U")] > | < down(t) >']
    found = []
    while len(found) < 7:
        a, b = rng.choice(sides[:9]), rng.choice(sides)
        if a != b:
            found.append(Constraint(f"c{len(found)}", a, b))
    rules = rule_set("random", found)
    if api.superset_repair(graph, rules, prune=False).consistent_after:
        pruned_as_plain(graph, rules)


def test_prune_beyond_first_hops(spark):
    graph = Graph.from_triples(spark, [("w", "x", "v")], {}).settled()
    rules = rule_set("deep", [Constraint("A", "< down(x) >", "< down(y) >"), Constraint("B", "< down(x) >", "< down(y) . down(z) >")])
    assert pruned_as_plain(graph, rules, "replayed").pruned_edges == 1


def plain_additions(edges, values, rules):
    """(edges, (round, rule, edge) in order) of an addition repair over plain sets, by the rules' plans."""
    edges, values, log, number = set(edges), dict(values), [], 0
    while True:
        number += 1
        local = LocalGraph(edges, values)
        due = sorted((c.cid, n, c) for c in rules for n in local.node(c.phi) - local.node(c.psi))
        new = False
        for cid, n, c in due:
            for step in superset.plan(c).steps:
                at = lambda x, n=n: n if x == superset.WITNESS else x
                if step.op == "add_node" and at(step.node) not in values:
                    values[at(step.node)], new = step.value, True
                edge = (at(step.src), step.label, at(step.dst))
                if step.op == "add_edge" and edge not in edges:
                    edges.add(edge)
                    log.append((number, cid, edge))
                    new = True
        if not new:
            return edges, log


@pytest.mark.parametrize("seed", range(4))
def test_superset_against_plain_rounds(spark, seed):
    rng = random.Random(seed)
    triples = sorted({(f"n{rng.randrange(8)}", rng.choice("pqr"), f"n{rng.randrange(8)}") for _ in range(8)})
    graph = Graph.from_triples(spark, triples, {}).settled()
    sides = ["< down(p) >", "< up(p) >", "< down(q) >", "< up(q) >", "< down(r) >", "< up(r) >", '< down(s) . [val("S")] >', "< up(s) >", "< down(p) . down(r) >", "< up(q) . [val(\"U\")] >"]
    rules = rule_set("random", [Constraint(f"c{i}", *rng.sample(sides, 2)) for i in range(5)])
    values = {n: None for s, _, d in triples for n in (s, d)}
    edges, log = plain_additions(triples, values, rules)
    result = api.superset_repair(graph, rules, prune=False)
    assert {tuple(r) for r in result.graph.edges.collect()} == edges
    assert [(r.round, r.constraint, (r.src, r.label, r.dst)) for r in api.records(result.log) if r.op == "add_edge"] == log


def test_superset_cascade_goes_on_to_the_fixpoint(spark):
    """A mark is passed along a chain: one addition a round, far more rounds than rules."""
    triples = [(f"x{i}", "next", f"x{i + 1}") for i in range(12)] + [("x0", "mark", "M")]
    graph = Graph.from_triples(spark, triples, {"M": "M"}).settled()
    rules = rule_set("chain", [Constraint("pass", '< up(next) . down(mark) >', '< down(mark) . [val("M")] >')])
    result = api.superset_repair(graph, rules, prune=False)
    assert result.consistent_after and result.rounds == 13 and result.added_edges().count() == 12
    assert result.pool == {"graph_values": 1, "named_constants": 1, "fresh_used": 0, "fresh_bound": 2} and result.pruned_nodes == 0
    with pytest.raises(RuntimeError, match="no fixpoint after 5 rounds"):
        api.superset_repair(graph, rules, prune=False, max_rounds=5)


def test_log_numbers_of_a_hub(spark):
    """The log is in order although the hub's edges are dealt over tasks."""
    triples = [(f"a{i:03}", "p", "hub") for i in range(300)] + [("hub", "q", f"b{i:03}") for i in range(300)] + [("z", "p", "y")]
    graph = Graph.from_triples(spark, triples, {}).settled()
    result = api.subset_repair(graph, rule_set("hub", [Constraint("no.hub", "< up(p) > & < down(q) >", "< down(none) >")]))
    log = api.records(result.log)
    assert [r.seq for r in result.log.orderBy("seq").select("seq").collect()] == list(range(1, 602))
    assert [(r.src, r.dst) for r in log[:300]] == [(f"a{i:03}", "hub") for i in range(300)]
    assert [r.dst for r in log[300:600]] == [f"b{i:03}" for i in range(300)] and log[-1].node == "hub"


def test_no_plan(spark):
    graph = Graph.from_triples(spark, [("a", "p", "b")], {}).settled()
    with pytest.raises(api.NoSupersetPlan):
        api.superset_repair(graph, rule_set("x", [Constraint("alt", "< down(p) >", "< down(q) + down(r) >")]))
    with pytest.raises(api.NoSupersetPlan):
        api.superset_repair(graph, rule_set("x", [Constraint("val", "< down(p) >", 'val("c")')]))


def test_caps(mini, rules):
    assert not api.check_cap(mini, rules, "subset", 0.1).allowed and api.check_cap(mini, rules, "subset", 2 / 12).allowed
    assert api.check_cap(mini, rules, "superset").to_dict()["status"] == "ok"


def test_metrics(mini, rules):
    found = api.compute_metrics(mini, rules)
    assert (found.type_edges, found.classes, found.singleton_classes, found.witness_nodes) == (4, 2, 1, 4)
    assert found.property_coverage == pytest.approx((2 + 2) / (3 + 3))
    assert api.compare_metrics(found, found)[0]["relative"] == 0
    assert len(api.metric_names()) == 20


def test_diff_and_bundle(spark, mini, rules, tmp_path):
    result = api.subset_repair(mini, rules)
    files = api.write_bundle(tmp_path / "b", {"x": 1}, result.graph, mini, rules)
    assert files == ["changes.nt.diff", "constraints.used.json", "repaired.nt", "report.json"]
    read = lambda n: spark.read.text(str(tmp_path / "b" / n)).withColumnRenamed("value", "line")
    back = names(api.reverse(read("repaired.nt"), read("changes.nt.diff")))
    from grafwerk.sources.ntriples import to_lines

    assert back == names(to_lines(mini).select("line"))
    one, two = (api.zip_bundle(tmp_path / "b", tmp_path / f"{i}.zip").read_bytes() for i in (1, 2))
    assert one == two


def test_neighbourhood(mini):
    near = api.neighbourhood(mini, "wd:good", 1)
    assert names(near.nodes.select("node")) == ["wd:Q515", "wd:area", "wd:good", "wd:land"] and not near.truncated
    assert api.neighbourhood(mini, "wd:good", 1, 2).truncated
    with pytest.raises(KeyError):
        api.neighbourhood(mini, "nobody")


def test_slices_nest(spark):
    import pyspark.sql.functions as F

    edges = spark.createDataFrame([(f"n{i}", "p", f"n{j}") for i in range(6) for j in (i + 1, i + 2)], "src string, label string, dst string").withColumn("is_literal", F.lit(False))
    small, large = (set(map(tuple, api.sorted_slice(edges, ["n0"], k).collect())) for k in (4, 9))
    assert len(small) == 4 and len(large) == 9 and small < large


def test_generator(spark):
    made = generate(spark, 600, seed=3)
    made.certify()
    assert made.truth.count() == 16


def test_search(spark):
    """Everything holds: one rule for each head, the most general one."""
    triples = [("City", SUB, "Geo"), *[(f"x{i}", "cap", f"c{i}") for i in range(6)], *[(f"x{i}", TYPE, "City") for i in range(6)]]
    graph = Graph.from_triples(spark, triples, {"City": "City", "Geo": "Geo"}).settled()
    cfg = search.SearchConfig(max_antecedent=1)
    found = {(r["body"], r["head"]) for r in search.search(graph, cfg).rules.collect()}
    tau = lambda c: search.tau_text(cfg, c)
    assert found == {("c_Geo", tau("City")), ("c_City", tau("Geo")), ("c_City", "< down(cap) >")}


def test_silent_nodes_do_not_count(spark):
    triples = [*[(f"x{i}", "cap", f"c{i}") for i in range(12)], *[(f"x{i}", TYPE, "City") for i in range(9)]]
    graph = Graph.from_triples(spark, triples, {"City": "City"}).settled()
    row = search.search(graph, search.SearchConfig(max_antecedent=1)).rules.where("body = 'd_cap' AND head LIKE '%City%'").first()
    assert (row["support"], row["denominator"], row["size"], row["confidence"]) == (9, 9, 12, 1.0)


def candidate_file(graph=None):
    source = {"dataset": "d", "content_hash": graph.content_hash()} if graph else {}
    return CandidateFile(source=source, candidates=[Candidate("a", "k", "ptime_core", "superset", "< down(p) >", "< down(q) >"), Candidate("b", "k", "ptime_core", "superset", "not T", "T")])


def test_gate(spark):
    graph = Graph.from_triples(spark, [("x", "p", "y")], {}).settled()
    file = candidate_file(graph)
    code = lambda f, *a, **k: pytest.raises(api.GateError, api.reviewed_rules, f, *a, **k).value.code
    assert code(file) == "E-UNSEALED"
    api.set_status(file, "a", ACCEPTED)
    api.set_status(file, "b", "rejected")
    api.seal(file, "someone", "2026-01-01T00:00:00Z")
    assert [c.cid for c in api.reviewed_rules(file, graph)] == ["a"]
    assert code(file, Graph.from_triples(spark, [("x", "p", "z")], {})) == "E-DRIFT"
    file.candidates[0].consequent = "T"
    assert code(file) == "E-SEAL"
    assert file.refused == ["b"]
    again = api.merge(file, candidate_file(graph))
    assert len(again.candidates) == 2 and CandidateFile.from_dict(json.loads(again.dumps())).dumps() == again.dumps()


def test_merge_keeps_decisions(spark):
    entry = lambda cid, **k: Candidate(cid, "k", "ptime_core", "superset", f"< down({cid}) >", "< down(q) >", **k)
    old = CandidateFile(candidates=[entry("a", gloss="old"), entry("b"), entry("c")], refused=["gone"], toolkit_version="1", parameters={"x": 1})
    for cid, status in (("a", ACCEPTED), ("b", "rejected"), ("c", "weakened")):
        api.set_status(old, cid, status)
    assert old.refused == ["b", "gone"]
    api.seal(old, "someone", "2026-01-01T00:00:00Z")
    fresh = CandidateFile(candidates=[entry("a", gloss="new"), entry("b"), entry("d"), entry("gone")], parameters={"x": 2})
    fresh.review["review_order"] = ["d", "gone", "a"]
    same = api.merge(old, CandidateFile(candidates=[entry("a"), entry("gone")]))
    assert same.sealed and api.seal_holds(same)  # nothing new, so nothing to decide
    both = api.merge(old, fresh)
    assert [(c.cid, c.status) for c in both.candidates] == [("a", ACCEPTED), ("b", "rejected"), ("c", "weakened"), ("d", "pending")]
    assert both.by_cid("a").gloss == "old" and not both.sealed and both.review["seal"] is None
    assert both.review["review_order"] == ["d", "a", "b", "c"] and both.refused == ["b", "gone"] and both.parameters == {"x": 2} and both.toolkit_version == "1"
    api.set_status(both, "b", "pending")
    assert both.refused == ["gone"]
    with pytest.raises(ValueError):
        api.set_status(both, "a", "unknown")
    with pytest.raises(KeyError):
        api.set_status(both, "nobody", ACCEPTED)


@pytest.fixture(scope="module")
def places(spark):
    """Cities with a country and an area; two of twenty lack the type, one lacks the country."""
    triples = [("City", SUB, "Place"), ("Land", SUB, "Place"), ("land", TYPE, "Land")]
    for i in range(20):
        triples += [(f"c{i:02}", "area", "north")] + ([(f"c{i:02}", "country", "land")] if i else []) + ([(f"c{i:02}", TYPE, "City")] if i < 18 else [])
    return Graph.from_triples(spark, triples, {c: c for c in ("City", "Land", "Place")}).settled()


def test_shape_rules(spark, places):
    cfg = search.SearchConfig(min_support=5, type_predicate=TYPE, subclass_predicate=SUB)
    result = api.shape_rules(places, "d", "k", cfg, reduce_cover=False)
    by = {c.cid: (c, f) for c, f in zip(result.rules, result.report)}
    assert set(by) == {"d.k.dom.area.mined", "d.k.dom.country.mined", "d.k.typ.d_area_d_country.mined", "d.k.req.City.area.mined", "d.k.req.City.country.mined"}
    rule, facts = by["d.k.dom.area.mined"]
    assert (facts["class"], facts["support"], facts["body_size"], facts["standard_conf"], facts["pca_conf"], facts["exceptions"]) == ("City", 18, 20, 0.9, 1.0, ["c18", "c19"])
    assert facts["runner_up_classes"] == ["Place"] and rule.direction == "subset" and rule.provenance == "mined"
    assert by["d.k.req.City.country.mined"][1]["exceptions"] == ["c00"] and by["d.k.req.City.country.mined"][1]["low_trust"]
    assert api.validates_clean(result)
    covered = api.shape_rules(places, "d", "k", cfg)
    assert covered.covered == {"d.k.dom.country.mined": "d.k.dom.area.mined", "d.k.typ.d_area_d_country.mined": "d.k.dom.area.mined"}
    deep = {r.key for r in shape_rules.path_extensions(places, search.SearchConfig(max_path=3, min_support=5, type_predicate=SUB, subclass_predicate="")).collect()}
    assert deep == {"p_country\x02" + TYPE}
    with pytest.raises(shape_rules.OutOfFragment):
        shape_rules.in_fragment(Constraint("x", "not T", "T"))


def test_impact_and_glosses(spark, places):
    cfg = search.SearchConfig(min_support=5, type_predicate=TYPE, subclass_predicate=SUB)
    file = api.derive(places, "d", "k", cfg, generator="shape", labels={"City": "city"})
    area = next(c for c in file.candidates if c.kind == "existential_domain")
    assert area.gloss == "anything with an outgoing area edge should be city" and area.witness_sample == ["c18", "c19"]
    assert area.impact == {"witnesses": 2, "subset_deletions": None, "superset_additions": None, "measured": False}
    want = {"witnesses": 2, "subset_deletions": 2, "superset_additions": 2, "measured": True}
    assert api.fill_impact(places, area) == want == area.impact
    stuck = api.measure_impact(places, Constraint("v", "< down(area) >", 'val("City")', direction="superset"))
    assert stuck["superset_additions"] is None and stuck["superset_note"].startswith("NoSupersetPlan")
    with pytest.raises(ValueError):
        api.derive(places, "d", "k", cfg, generator="other")


def test_rule_origins():
    rules = [c for s in catalogue.registry().values() for c in s]
    assert sum(c.provenance == "compiled" for c in rules) == 11 and sum(c.provenance == "derived" for c in rules) == 5
    city = next(c for c in rules if c.cid == "geo.wd.type.city")
    assert city.params == {"threshold": "0.98", "reference": "clean-wikidata-city-slice"} and all(c.note for c in rules)
    assert next(c for c in catalogue.get("anatomy", "wikidata", 2) if c.cid == "ana.wd.dom.partof.v2").params["baseline_cid"] == "ana.wd.dom.partof"


def test_command_line(spark, tmp_path, rules):
    path = tmp_path / "mini.nt"
    path.write_text(MINI)
    report = tmp_path / "report.json"
    base = ["--in", str(path), "--domain", "geography", "--report", str(report)]
    assert cli.main(["check", *base], spark) == cli.VIOLATIONS
    assert json.loads(report.read_text())["result"]["total_witnesses"] == 5
    assert cli.main(["repair", *base, "--mode", "subset", "--max-deletion-fraction", "0.01"], spark) == cli.CAPPED
    assert cli.main(["repair", *base, "--mode", "subset", "--bundle", str(tmp_path / "bundle"), "--zip"], spark) == cli.OK
    assert (tmp_path / "bundle.zip").exists()
    assert cli.main(["check", "--in", str(path)], spark) == cli.USAGE
    file = tmp_path / "c.json"
    candidate_file().write(file)
    assert cli.main(["repair", "--in", str(path), "--constraints", str(file), "--mode", "superset"], spark) == cli.REFUSED
    derived = ["derive", "--in", str(path), "--out", str(tmp_path / "shapes.json"), "--generator", "shape", "--min-support", "2", "--type-predicate", "wdt:P31"]
    assert cli.main(derived, spark) == cli.OK and CandidateFile.read(tmp_path / "shapes.json").parameters["generator"] == "shape"
    answers = iter(["a fine", "r"])
    assert cli.main(["review", str(file), "--reviewer", "someone"], spark, lambda _: next(answers)) == cli.OK
    assert CandidateFile.read(file).sealed


def test_rule_files(tmp_path):
    assert sum(len(s) for s in catalogue.registry().values()) == 32 and catalogue.compile_all(2)
    paths = catalogue.export_json(tmp_path)
    assert len(paths) == 9 and len(ConstraintSet.from_file(paths[0])) == len(catalogue.registry()[tuple(paths[0].stem.split("_"))])


def test_streaming(spark, tmp_path, mini, rules):
    from grafwerk.streaming.incremental import watch

    spark.createDataFrame([("wd:new", "wdt:P17", "wd:land")], "src string, label string, dst string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src string, label string, dst string").parquet(str(tmp_path / "in"))
    seen = {}
    watch(stream, mini, rules, lambda n, counts: seen.update({r["cid"]: r["witnesses"] for r in counts.collect()}), str(tmp_path / "cp")).awaitTermination()
    assert seen["geo.wd.dom.country"] == 2 and "geo.wd.sym.border" not in seen
    # a restarted stream knows what came before
    spark.createDataFrame([("wd:newer", "wdt:P17", "wd:land")], "src string, label string, dst string").write.mode("append").parquet(str(tmp_path / "in"))
    watch(stream, mini, rules, lambda n, counts: seen.update({"batch": n} | {r["cid"]: r["witnesses"] for r in counts.collect()}), str(tmp_path / "cp")).awaitTermination()
    assert seen["batch"] == 1 and seen["geo.wd.dom.country"] == 3


def test_run_record(spark, mini, rules, tmp_path):
    with api.RunContext(tmp_path / "runs.jsonl", api.graph_meta(mini, "mini"), rules, "check") as run, run.phase("check"):
        pass
    record = json.loads((tmp_path / "runs.jsonl").read_text())
    assert not api.check_record(record) and record["slice"]["E"] == 14
    assert api.timing_summary(spark, str(tmp_path / "runs.jsonl")).count() == 1
