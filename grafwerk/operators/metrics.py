"""Quality metrics of a graph, and their comparison before and after a repair."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.graph import Graph, small_table
from grafwerk.operators.validate import witnesses
from grafwerk.plans import ast
from grafwerk.plans.compile import Compiler
from grafwerk.rules import ConstraintSet

#: The two halves of the default typing predicates, and the least instances of a
#: class that counts for coverage.
INSTANCE_OF = ("a", "rdf:type", "wdt:P31")
SUBCLASS_OF = ("rdfs:subClassOf", "wdt:P279")
MIN_INSTANCES = 2

VOCABULARIES = ("instance_of", "subclass_of")


def split_type_predicates(predicates: Iterable[str] | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(instance-of, subclass-of); predicates of one's own have no subclass half."""
    if predicates is None:
        return INSTANCE_OF, SUBCLASS_OF
    own = sorted(set(predicates))
    if set(own) <= {*INSTANCE_OF, *SUBCLASS_OF}:
        return tuple(p for p in own if p in INSTANCE_OF), tuple(p for p in own if p in SUBCLASS_OF)
    return tuple(own), ()


def type_edges(graph: Graph, instance_of: Iterable[str] = INSTANCE_OF) -> DataFrame:
    """Distinct (node, cls)."""
    return graph.edges.where(F.col("label").isin(*instance_of)).select(F.col("src").alias("node"), F.col("dst").alias("cls")).distinct()


def ancestors(graph: Graph, subclass_of: Iterable[str] = SUBCLASS_OF) -> DataFrame:
    """(cls, sup): proper ancestors by way of subclass edges, cycles included."""
    path: ast.Path | None = None
    for label in subclass_of:
        path = ast.Down(label) if path is None else ast.Alt(path, ast.Down(label))
    if path is None:
        return small_table(graph.spark, [], "cls string, sup string")
    pairs = Compiler(graph).pairs(ast.Star(path)).where("x <> y")
    return pairs.select(F.col("x").alias("cls"), F.col("y").alias("sup"))


def redundant_types(graph: Graph, instance_of: Iterable[str] = INSTANCE_OF, subclass_of: Iterable[str] = SUBCLASS_OF) -> DataFrame:
    """(node, cls): type edges that another type of the node implies."""
    types, up = type_edges(graph, instance_of), ancestors(graph, subclass_of)
    implied = types.withColumnRenamed("cls", "low").join(up.withColumnRenamed("cls", "low"), "low").select("node", F.col("sup").alias("cls"))
    return types.join(implied, ["node", "cls"], "left_semi")


def class_sizes(graph: Graph, instance_of: Iterable[str] = INSTANCE_OF) -> DataFrame:
    """(cls, instances): direct instances."""
    return type_edges(graph, instance_of).groupBy("cls").agg(F.count("*").alias("instances"))


def property_coverage(graph: Graph, instance_of: Iterable[str] = INSTANCE_OF, subclass_of: Iterable[str] = SUBCLASS_OF, min_instances: int = MIN_INSTANCES) -> DataFrame:
    """(cls, label, carriers, instances) of every label that some instance carries."""
    from grafwerk.operators.profiles import profiles  # which reads this module

    own = profiles(graph, instance_of, subclass_of)
    types = own.types()
    sizes = types.groupBy("cls").agg(F.sum("weight").alias("instances")).where(F.col("instances") >= min_instances)
    carried = own.endpoints().where("role = 'domain'").select("label", "n")
    return types.join(sizes, "cls").join(carried, "n").groupBy("cls", "label").agg(F.sum("weight").alias("carriers"), F.first("instances").alias("instances"))


def satisfaction(graph: Graph, rules: ConstraintSet) -> DataFrame:
    """(cid, antecedent, witnesses, satisfaction) of core rules; null where nothing is in scope."""
    compiler, own = Compiler(graph), rules.core()
    found = witnesses(graph, own).groupBy("cid").agg(F.count("*").alias("witnesses"))
    scope = None
    for r in own:
        part = compiler.node(r.phi).agg(F.count("*").alias("antecedent")).select(F.lit(r.cid).alias("cid"), "antecedent")
        scope = part if scope is None else scope.unionByName(part)
    if scope is None:
        return small_table(graph.spark, [], "cid string, antecedent long, witnesses long, satisfaction double")
    joined = scope.join(found, "cid", "left").select("cid", "antecedent", F.coalesce("witnesses", F.lit(0)).alias("witnesses"))
    return joined.withColumn("satisfaction", F.when(F.col("antecedent") > 0, (F.col("antecedent") - F.col("witnesses")) / F.col("antecedent")))


@dataclass(frozen=True)
class GraphMetrics:
    nodes: int
    edges: int
    labels: int
    data_values: int
    type_edges: int
    typed_nodes: int
    typed_fraction: float | None
    classes: int
    singleton_classes: int
    singleton_fraction: float | None
    subclass_edges: int
    redundant_type_edges: int
    redundant_fraction: float | None
    mean_types: float | None
    coverage_pairs: int
    property_coverage: float | None
    witnesses: int | None
    witness_nodes: int | None
    witness_fraction: float | None
    satisfaction_mean: float | None
    instance_of: tuple[str, ...]
    subclass_of: tuple[str, ...]

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in vars(self).items()}


def metric_names() -> tuple[str, ...]:
    return tuple(f for f in GraphMetrics.__dataclass_fields__ if f not in VOCABULARIES)


def metrics_row(graph: Graph, rules: ConstraintSet | None = None, instance_of: Iterable[str] = INSTANCE_OF, subclass_of: Iterable[str] = SUBCLASS_OF, min_instances: int = MIN_INSTANCES, names: Iterable[str] | None = None) -> DataFrame:
    """All metrics, or those of ``names``, as one row: single-row aggregations side by side."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    names = metric_names() if names is None else tuple(names)
    shares = {n: of for n, of in (("typed_fraction", ("typed_nodes", "nodes")), ("singleton_fraction", ("singleton_classes", "classes")), ("redundant_fraction", ("redundant_type_edges", "type_edges")), ("mean_types", ("type_edges", "typed_nodes")), ("witness_fraction", ("witness_nodes", "nodes"))) if n in names}
    wanted = {*names} | {x for of in shares.values() for x in of}
    types = type_edges(graph, instance_of)
    parts = {
        ("nodes", "edges", "labels", "data_values"): lambda: graph.stats().withColumnRenamed("valued_nodes", "data_values"),
        ("type_edges", "typed_nodes"): lambda: types.agg(F.count("*").alias("type_edges"), F.countDistinct("node").alias("typed_nodes")),
        ("classes", "singleton_classes"): lambda: class_sizes(graph, instance_of).agg(F.count("*").alias("classes"), F.coalesce(F.sum((F.col("instances") == 1).cast("long")), F.lit(0)).alias("singleton_classes")),
        ("subclass_edges",): lambda: graph.edges.where(F.col("label").isin(*subclass_of) if subclass_of else F.lit(False)).agg(F.count("*").alias("subclass_edges")),
        ("redundant_type_edges",): lambda: redundant_types(graph, instance_of, subclass_of).agg(F.count("*").alias("redundant_type_edges")),
        ("coverage_pairs", "property_coverage"): lambda: property_coverage(graph, instance_of, subclass_of, min_instances).agg(F.count("*").alias("coverage_pairs"), (F.sum("carriers") / F.sum("instances")).alias("property_coverage")),
    }
    if rules is None:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("witnesses", "long"), ("witness_nodes", "long"), ("satisfaction_mean", "double"))]
        parts[("witnesses", "witness_nodes", "satisfaction_mean")] = lambda: graph.spark.range(1).select(*none)
    else:
        parts[("witnesses", "witness_nodes")] = lambda: witnesses(graph, rules).agg(F.count("*").alias("witnesses"), F.countDistinct("n").alias("witness_nodes"))
        parts[("satisfaction_mean",)] = lambda: satisfaction(graph, rules).agg(F.avg("satisfaction").alias("satisfaction_mean"))
    row = None
    for columns, part in parts.items():
        if wanted & {*columns}:
            row = part() if row is None else row.crossJoin(part())  # single rows
    return row.withColumns({n: share(*of) for n, of in shares.items()}).select(*names)


def compute_metrics(graph: Graph, rules: ConstraintSet | None = None, instance_of: Iterable[str] = INSTANCE_OF, subclass_of: Iterable[str] = SUBCLASS_OF, min_instances: int = MIN_INSTANCES, names: Iterable[str] | None = None) -> GraphMetrics:
    """All metrics; with ``names`` those only, and None for the others."""
    row = metrics_row(graph, rules, instance_of, subclass_of, min_instances, names).first()
    return GraphMetrics(**(dict.fromkeys(metric_names()) | row.asDict()), instance_of=tuple(instance_of), subclass_of=tuple(subclass_of))


def compare_metrics(before: GraphMetrics, after: GraphMetrics) -> list[dict]:
    """metric, before, after, absolute, relative; null-safe, and only within one vocabulary."""
    if any(getattr(before, v) != getattr(after, v) for v in VOCABULARIES):
        raise ValueError("metrics of different typing vocabularies can't be compared")
    rows = []
    for name in metric_names():
        a, b = getattr(before, name), getattr(after, name)
        gap = None if a is None or b is None else b - a
        rows.append({"metric": name, "before": a, "after": b, "absolute": gap, "relative": gap / a if gap is not None and a else None})
    return rows


def metrics_block(before: Graph, after: Graph, rules: ConstraintSet) -> dict:
    """The part of a repair's report about metrics."""
    a, b = compute_metrics(before, rules), compute_metrics(after, rules)
    return {"before": a.to_dict(), "after": b.to_dict(), "changes": compare_metrics(a, b)}
