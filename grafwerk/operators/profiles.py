"""Nodes by what they have: their classes and the labels of their edges.

Counts over nodes only depend on how many nodes have which of these.  A pass over the edges gathers each node's tags,
nodes with the same tags are one profile with a weight, and all that follows counts profiles.  There are never more
profiles than nodes, and in graphs from tables there are a few dozen.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.graph import Graph, cut, small_table
from grafwerk.operators.metrics import ancestors

#: Kinds of tags: direct classes, outgoing and incoming labels.
CLASS, DOWN, UP = "t_", "d_", "u_"
#: The tag of a class that is null: of such a node is known that it has a type.
NO_CLASS = "t"
#: Tags that are held as bits of numbers, which need no sort; a larger vocabulary is gathered in sets.
BIT_TAGS, BITS = 1008, 63


def count(df: DataFrame) -> Column:
    """The nodes that rows stand for: their weights, if they have any."""
    return F.sum("weight") if "weight" in df.columns else F.count("*")


def tagged(graph: Graph, instance_of: Iterable[str], subclass_of: Iterable[str]) -> DataFrame:
    """(n, tag) of direct classes, and of the ends of all edges but typing ones; not distinct."""
    edges = graph.edges.where(~F.col("label").isin(*instance_of, *subclass_of))
    parts = [
        graph.edges.where(F.col("label").isin(*instance_of)).select(F.col("src").alias("n"), _class_tag().alias("tag")),
        edges.select(F.col("src").alias("n"), F.concat(F.lit(DOWN), "label").alias("tag")),
        edges.select(F.col("dst").alias("n"), F.concat(F.lit(UP), "label").alias("tag")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _class_tag() -> Column:
    return F.coalesce(F.concat(F.lit(CLASS), "dst"), F.lit(NO_CLASS))


def vocabulary(graph: Graph, instance_of: Iterable[str], subclass_of: Iterable[str], most: int = BIT_TAGS) -> list[str] | None:
    """All tags, if there are at most ``most``."""
    classes = graph.edges.where(F.col("label").isin(*instance_of)).select(_class_tag().alias("tag")).distinct()
    labels = graph.edges.where(~F.col("label").isin(*instance_of, *subclass_of)).select("label").distinct()
    found = classes.unionByName(labels.select(F.explode(F.array(F.concat(F.lit(DOWN), "label"), F.concat(F.lit(UP), "label"))).alias("tag")))
    rows = found.limit(most + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= most else None


@dataclass(frozen=True, eq=False)
class Profiles:
    graph: Graph
    #: (n, weight, tags, mark): n is the profile's own id, null for the node that is null, which no join finds.
    known: DataFrame
    #: (node, n), if kept.
    nodes: DataFrame | None
    subclass_of: tuple[str, ...]

    def having(self, kind: str, name: str) -> DataFrame:
        """(n, weight, ``name``): tags of a kind, without it."""
        one = self.known.select("n", "weight", F.explode("tags").alias("tag")).where(F.col("tag").startswith(kind))
        return one.select("n", "weight", F.substring("tag", len(kind) + 1, 1 << 30).alias(name))

    def types(self) -> DataFrame:
        """(n, weight, cls): direct classes."""
        one = self.known.select("n", "weight", F.explode("tags").alias("tag")).where(F.col("tag").startswith(NO_CLASS))
        return one.select("n", "weight", F.when(F.col("tag") != NO_CLASS, F.substring("tag", len(CLASS) + 1, 1 << 30)).alias("cls"))

    def typed(self) -> DataFrame:
        """(n, weight, cls): classes and all above them."""
        types, up = self.types(), ancestors(self.graph, self.subclass_of)
        return types.unionByName(types.join(up, "cls").select("n", "weight", F.col("sup").alias("cls"))).distinct()

    def has_type(self) -> DataFrame:
        return self.types().select("n").distinct()

    def steps(self) -> DataFrame:
        """(key, n, weight): outgoing (d_) and incoming (u_) labels."""
        one = self.known.select("n", "weight", F.explode("tags").alias("key"))
        return one.where(F.col("key").startswith(DOWN) | F.col("key").startswith(UP)).select("key", "n", "weight")

    def endpoints(self) -> DataFrame:
        """(role, label, n, weight)."""
        return self.steps().select(F.when(F.col("key").startswith(DOWN), "domain").otherwise("range").alias("role"), F.substring("key", 3, 1 << 30).alias("label"), "n", "weight")

    def classes(self) -> DataFrame:
        """(key, n, weight): class tests by the classes' values (c_)."""
        values = self.graph.nodes.where("value IS NOT NULL").select(F.col("node").alias("cls"), "value")
        return self.typed().join(values, "cls").select(F.concat(F.lit("c_"), "value").alias("key"), "n", "weight").distinct()


def grouped(graph: Graph, rows: DataFrame, tags: list[str] | None, subclass_of: Iterable[str], mark: Column | None = None, keep: bool = False) -> Profiles:
    """Profiles of (n, tag); tags: all there are, or None for any number.  mark: a property of n that nodes of a profile
    share.  keep: the nodes of each profile are kept, too."""
    if tags is not None:
        table = small_table(graph.spark, [(t, i // BITS, 1 << (i % BITS)) for i, t in enumerate(tags)], "tag string, word int, bit long")
        words = range(-(-len(tags) // BITS))
        coded = rows.join(F.broadcast(table), "tag")  # a row a tag
        one = coded.groupBy("n").agg(*[F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words] or [F.count("*").alias("w0")])
        own = one.select(F.col("n").alias("node"), F.array(*[f"w{w}" for w in words] or ["w0"]).alias("profile"))
        spelled = F.expr(f"filter(array({', '.join(_quoted(t) for t in tags)}), (t, i) -> (shiftright(profile[CAST(i DIV {BITS} AS INT)], i % {BITS}) & 1L) = 1L)") if tags else F.array().cast("array<string>")
    else:
        own = rows.groupBy(F.col("n").alias("node")).agg(F.sort_array(F.collect_set("tag")).alias("profile"))
        spelled = F.col("profile")
    own = own.withColumns({"mark": F.lit(False) if mark is None else mark, "none": F.col("node").isNull()})
    own = cut(own, "own-profiles") if keep else own
    found = own.groupBy("profile", "mark", "none").agg(F.count("*").alias("weight"))
    place = F.when(~F.col("none"), F.monotonically_increasing_id().cast("string"))
    known = cut(found.select(place.alias("n"), "profile", "mark", "none", "weight", spelled.alias("tags")), "profiles")
    nodes = own.join(known.select("profile", "none", F.col("mark").alias("own"), "n"), ["profile", "none"]).where("mark <=> own").select("node", "n") if keep else None
    return Profiles(graph, known.select("n", "weight", "tags", "mark"), nodes, tuple(subclass_of))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def profiles(graph: Graph, instance_of: Iterable[str], subclass_of: Iterable[str], mark: Column | None = None, keep: bool = False, most: int = BIT_TAGS) -> Profiles:
    """The profiles of a graph, made once for it."""
    key = ("profiles", tuple(instance_of), tuple(subclass_of), str(mark), most)
    made = graph.memo.get(key)
    if made is None or (keep and made.nodes is None):
        made = graph.memo[key] = grouped(graph, tagged(graph, instance_of, subclass_of), vocabulary(graph, instance_of, subclass_of, most), subclass_of, mark, keep)
    return made
