"""A generator of graphs with known violations, certified against the validator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafwerk.catalogue import synthetic_rules
from grafwerk.graph import Graph
from grafwerk.operators.validate import witnesses

TYPE, SUBCLASS = "rdf:type", "rdfs:subClassOf"


@dataclass(frozen=True)
class Profile:
    """depth: classes below City that instances are typed with; rate: violations of each kind for each city;
    hubs: share of countries and places that is picked from."""

    depth: int = 4
    rate: float = 0.02
    hubs: float = 1.0


@dataclass(frozen=True)
class SyntheticGraph:
    graph: Graph
    #: (cid, n): the witnesses that were put in.
    truth: DataFrame

    def certify(self) -> None:
        """Raises unless the validator finds exactly the truth."""
        found = witnesses(self.graph, synthetic_rules()).select("cid", "n")
        extra, missing = found.exceptAll(self.truth).limit(3).collect(), self.truth.exceptAll(found).limit(3).collect()
        if extra or missing:
            raise AssertionError(f"witnesses differ from the truth: extra {extra}, missing {missing}")


def generate(spark: SparkSession, edges: int, seed: int = 0, profile: Profile = Profile()) -> SyntheticGraph:
    cities = max(1, edges // 3)
    countries, places, faults = max(2, cities // 10), max(2, cities // 5), max(1, int(cities * profile.rate))
    leaf = f"syn:City/{profile.depth - 1}" if profile.depth > 1 else "syn:City"
    spine = [(f"syn:City/{i}", SUBCLASS, f"syn:City/{i - 1}" if i > 1 else "syn:City") for i in range(1, profile.depth)]
    spine += [(c, SUBCLASS, "syn:Place") for c in ("syn:City", "syn:Country", "syn:Spot")]

    def pick(prefix: str, size: int, salt: int) -> Column:
        return F.concat(F.lit(prefix), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(max(1, int(size * profile.hubs)))).cast("string"))

    def some(rows: int, src: Column, label: str, dst: Column) -> DataFrame:
        return spark.range(rows).select(src.alias("src"), F.lit(label).alias("label"), dst.alias("dst"))

    at = lambda prefix: F.concat(F.lit(prefix), F.col("id").cast("string"))
    country, place = pick("syn:c/", countries, 1), pick("syn:p/", places, 2)
    parts = [
        spark.createDataFrame(spine, "src string, label string, dst string"),
        some(countries, at("syn:c/"), TYPE, F.lit("syn:Country")),
        some(cities, at("syn:x/"), TYPE, F.lit(leaf)), some(cities, at("syn:x/"), "syn:country", country), some(cities, at("syn:x/"), "syn:locatedIn", place),
        some(faults, at("syn:bad/dom/"), "syn:country", country),
        some(faults, at("syn:bad/from/"), TYPE, F.lit("syn:Spot")), some(faults, at("syn:bad/from/"), "syn:country", at("syn:bad/rng/")),
        some(faults, at("syn:bad/type/"), TYPE, F.lit("syn:Spot")), some(faults, at("syn:bad/type/"), "syn:country", country), some(faults, at("syn:bad/type/"), "syn:locatedIn", place),
        some(faults, at("syn:bad/req/"), TYPE, F.lit(leaf)), some(faults, at("syn:bad/req/"), "syn:locatedIn", place),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    classes = every.where(F.col("label").isin(TYPE, SUBCLASS)).select(F.col("dst").alias("node"), F.col("dst").alias("value")).distinct()
    kinds = (("syn.dom.country", "dom"), ("syn.rng.country", "rng"), ("syn.type.city", "type"), ("syn.req.city_country", "req"))
    truth = None
    for cid, kind in kinds:
        part = spark.range(faults).select(F.lit(cid).alias("cid"), at(f"syn:bad/{kind}/").alias("n"))
        truth = part if truth is None else truth.unionByName(part)
    isolated = spark.range(places).select(at("syn:p/").alias("node"))
    return SyntheticGraph(Graph.of(every, classes, isolated), truth)
