"""Rule mining by shapes: domains and ranges, requirements, prevalence; one aggregation of profiles a shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.graph import Graph
from grafwerk.operators.metrics import ancestors
from grafwerk.operators.search import SearchConfig, profiled

#: The least share of typed endpoints, the share of incomparable types that flags a rule,
#: and the predicates that the prevalence miner pairs.
TYPED_SHARE, CONTAMINATION, TOP_PREDICATES = 0.5, 0.2, 10

#: Typing pairs known by their type predicate.
KNOWN_VOCABULARIES = (("wdt:P31", "wdt:P279"), ("rdf:type", "rdfs:subClassOf"), ("a", "rdfs:subClassOf"))


def _nodes() -> Column:
    """The nodes that rows of profiles stand for."""
    return F.sum("weight")


def class_scores(graph: Graph, cfg: SearchConfig) -> DataFrame:
    """(role, label, cls, support, typed, body, pca) of classes that clear all floors."""
    own = profiled(graph, cfg)
    ends = own.endpoints()
    sizes = ends.groupBy("role", "label").agg(_nodes().alias("body"))
    judged = ends.join(own.has_type(), "n", "left_semi").groupBy("role", "label").agg(_nodes().alias("typed"))
    support = ends.join(own.typed().select("n", "cls"), "n").groupBy("role", "label", "cls").agg(_nodes().alias("support"))
    found = support.join(judged, ["role", "label"]).join(sizes, ["role", "label"]).withColumn("pca", F.col("support") / F.col("typed"))
    return found.where((F.col("typed") >= TYPED_SHARE * F.col("body")) & (F.col("support") >= cfg.min_support) & (F.col("pca") >= cfg.min_confidence))


def best_classes(graph: Graph, cfg: SearchConfig) -> DataFrame:
    """(role, label, cls, support, pca): the most specific class that clears, by depth, support, id."""
    scores, up = class_scores(graph, cfg), ancestors(graph, [cfg.subclass_predicate])
    lower = scores.select("role", "label", F.col("cls").alias("low")).join(up.withColumnRenamed("cls", "low"), "low").select("role", "label", F.col("sup").alias("cls")).distinct()
    specific = scores.join(lower, ["role", "label", "cls"], "left_anti").withColumn("own", F.lit(1))
    any_specific = specific.select("role", "label").distinct()
    kept = specific.unionByName(scores.join(any_specific, ["role", "label"], "left_anti").withColumn("own", F.lit(0)))
    depth = up.groupBy("cls").agg(F.count("*").alias("depth"))
    order = Window.partitionBy("role", "label").orderBy(F.desc(F.coalesce("depth", F.lit(0))), F.desc("support"), "cls")
    ranked = kept.join(depth, "cls", "left").withColumn("rank", F.row_number().over(order))
    return ranked.where("rank = 1").select("role", "label", "cls", "support", "pca")


def contamination(graph: Graph, cfg: SearchConfig) -> DataFrame:
    """(role, label, cls, foreign, body, ratio, flagged): endpoints with a type that is neither above nor
    below the chosen class."""
    best, up = best_classes(graph, cfg), ancestors(graph, [cfg.subclass_predicate])
    same = best.select("cls").distinct().select("cls", F.col("cls").alias("other"))
    near = same.unionByName(up.select("cls", F.col("sup").alias("other"))).unionByName(up.select(F.col("sup").alias("cls"), F.col("cls").alias("other"))).distinct()
    own = profiled(graph, cfg)
    types = own.types().select("n", F.col("cls").alias("other")).where("other IS NOT NULL")
    ends = own.endpoints().join(best.select("role", "label", "cls"), ["role", "label"])
    foreign = ends.join(types, "n").join(near, ["cls", "other"], "left_anti").select("role", "label", "n", "weight").distinct().groupBy("role", "label").agg(_nodes().alias("foreign"))
    sizes = ends.groupBy("role", "label", "cls").agg(_nodes().alias("body"))
    found = sizes.join(foreign, ["role", "label"], "left").select("role", "label", "cls", F.coalesce("foreign", F.lit(0)).alias("foreign"), "body")
    return found.withColumn("ratio", F.col("foreign") / F.col("body")).withColumn("flagged", F.col("ratio") >= CONTAMINATION)


def requirements(graph: Graph, cfg: SearchConfig) -> DataFrame:
    """(cls, label, support, members, confidence): labels that nearly all nodes of a class carry."""
    own = profiled(graph, cfg)
    direct = own.types().groupBy("cls").agg(_nodes().alias("direct")).where(F.col("direct") >= cfg.min_support).select("cls")
    typed = own.typed().join(direct, "cls", "left_semi")
    sizes = typed.groupBy("cls").agg(_nodes().alias("members"))
    carried = own.endpoints().where("role = 'domain'").select("label", "n")
    found = typed.join(carried, "n").groupBy("cls", "label").agg(_nodes().alias("support")).join(sizes, "cls")
    found = found.withColumn("confidence", F.col("support") / F.col("members"))
    return found.where((F.col("support") >= cfg.min_support) & (F.col("confidence") >= cfg.min_confidence))


def prevalence(graph: Graph, cfg: SearchConfig) -> DataFrame:
    """(role, label, cls, population, hits, prevalence): closed world, direct classes only."""
    own = profiled(graph, cfg)
    ends, types = own.endpoints(), own.types().select("n", "cls")
    sizes = ends.groupBy("role", "label").agg(_nodes().alias("population")).where(F.col("population") >= cfg.min_support)
    found = ends.join(types, "n").groupBy("role", "label", "cls").agg(_nodes().alias("hits")).join(sizes, ["role", "label"])
    return found.withColumn("prevalence", F.col("hits") / F.col("population")).where(F.col("prevalence") >= cfg.min_confidence)


def pca_horn(graph: Graph, cfg: SearchConfig) -> DataFrame:
    """(role, label, cls, support, judged, confidence): as prevalence, judged on typed nodes."""
    own = profiled(graph, cfg)
    types = own.types().select("n", "cls")
    ends = own.endpoints().join(own.has_type(), "n", "left_semi")
    sizes = ends.groupBy("role", "label").agg(_nodes().alias("judged"))
    found = ends.join(types, "n").groupBy("role", "label", "cls").agg(_nodes().alias("support")).join(sizes, ["role", "label"])
    found = found.withColumn("confidence", F.col("support") / F.col("judged"))
    return found.where((F.col("support") >= cfg.min_support) & (F.col("confidence") >= cfg.min_confidence))


def negated_exclusions(graph: Graph, cfg: SearchConfig) -> DataFrame:
    """(label, without, cls, support, judged, confidence): domains that clear only among nodes that lack
    another label.  Such rules need negation, so they are reported and never repaired."""
    own = profiled(graph, cfg)
    types, carried = own.types().select("n", "cls"), own.endpoints().where("role = 'domain'")
    ends = carried.select("label", "n", "weight").join(own.has_type(), "n", "left_semi")
    judged = ends.groupBy("label").agg(_nodes().alias("all"))
    hits = ends.join(types, "n").groupBy("label", "cls").agg(_nodes().alias("all_hits"))
    both = ends.join(carried.select(F.col("label").alias("without"), "n"), "n").where("label <> without")
    lost = both.groupBy("label", "without").agg(_nodes().alias("lost"))
    lost_hits = both.join(types, "n").groupBy("label", "without", "cls").agg(_nodes().alias("lost_hits"))
    found = hits.join(judged, "label").join(lost, "label").join(lost_hits, ["label", "without", "cls"], "left")
    found = found.withColumns({"support": F.col("all_hits") - F.coalesce("lost_hits", F.lit(0)), "judged": F.col("all") - F.col("lost")}).where("judged > 0")
    found = found.withColumn("confidence", F.col("support") / F.col("judged"))
    cleared = F.col("all_hits") / F.col("all") >= cfg.min_confidence
    return found.where(~cleared & (F.col("support") >= cfg.min_support) & (F.col("confidence") >= cfg.min_confidence)).select("label", "without", "cls", "support", "judged", "confidence")


@dataclass(frozen=True)
class Vocabulary:
    type_predicate: str
    subclass_predicate: str


def detect_vocabulary(graph: Graph) -> Vocabulary | None:
    """The typing pair of a graph: a known one by its type predicate, else the label that most often
    ends in nodes of high in-degree, and the one that most often connects two of them."""
    labels = {r[0] for r in graph.labels().collect()}
    for pair in KNOWN_VOCABULARIES:
        if pair[0] in labels:
            return Vocabulary(*pair)
    degree = graph.edges.groupBy(F.col("dst").alias("n")).agg(F.count("*").alias("d"))
    cut_at = degree.agg(F.percentile_approx("d", 0.9, 10_000).alias("d"))
    hubs = degree.join(F.broadcast(cut_at.withColumnRenamed("d", "least")), F.col("d") >= F.col("least")).select("n")
    into = graph.edges.join(hubs.select(F.col("n").alias("dst")), "dst", "left_semi")
    among = into.join(hubs.select(F.col("n").alias("src")), "src", "left_semi")
    totals = graph.label_counts()
    share = lambda part: part.groupBy("label").agg(F.count("*").alias("k")).join(totals, "label").withColumn("share", F.col("k") / F.col("edges")).orderBy(F.desc("share"), F.desc("k"), "label").limit(2).collect()
    types, subs = share(into.join(hubs.select(F.col("n").alias("src")), "src", "left_anti")), share(among)
    if not types:
        return None
    below = next((r["label"] for r in subs if r["label"] != types[0]["label"]), "")
    return Vocabulary(types[0]["label"], below)
