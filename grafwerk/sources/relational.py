"""A graph over relational tables, by a fixed mapping in portable SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafwerk.graph import Graph, small_table, shared_dir

TYPE, SUBCLASS = "rdf:type", "rdfs:subClassOf"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def _id(prefix: str, column: str) -> str:
    return f"'{prefix}:' || CAST({column} AS STRING)"


def _edge(src: str, label: str, dst: str, source: str) -> str:
    return f"SELECT DISTINCT {src} AS src, '{label}' AS label, {dst} AS dst FROM {source}"


_ORDER, _CUSTOMER, _SUPPLIER, _PART, _NATION, _DOCUMENT = (
    _id("o", "o_orderkey"), _id("c", "c_custkey"), _id("s", "s_suppkey"), _id("p", "p_partkey"), _id("n", "n_nationkey"), _id("d", "doc_id"),
)

#: (source, label, target, table and condition); distinct.
EDGES = (
    (_ORDER, "kg:customer", _id("c", "o_custkey"), "orders"),
    (_id("o", "l_orderkey"), "kg:part", _id("p", "l_partkey"), "lineitem"),
    (_id("o", "l_orderkey"), "kg:supplier", _id("s", "l_suppkey"), "lineitem"),
    (_CUSTOMER, "kg:nation", _id("n", "c_nationkey"), "customer"),
    (_SUPPLIER, "kg:nation", _id("n", "s_nationkey"), "supplier"),
    (_NATION, "kg:region", _id("r", "n_regionkey"), "nation"),
    (_DOCUMENT, "kg:lang", _id("lang", "lang"), "documents WHERE lang IS NOT NULL"),
    (_DOCUMENT, "kg:label", _id("q", "quality"), "labels WHERE quality IS NOT NULL"),
    (_id("u", "user_id"), "kg:did", _id("ev", "event_type"), "events"),
    (_ORDER, TYPE, "'cls:Order_' || o_orderstatus", "orders WHERE o_orderkey % 50 <> 0"),
    (_CUSTOMER, TYPE, "'cls:' || c_mktsegment", "customer WHERE c_acctbal >= 0"),
    (_CUSTOMER, TYPE, "'cls:Customer'", "customer WHERE c_custkey % 25 = 0"),
    (_CUSTOMER, "kg:segment", "'seg:' || c_mktsegment", "customer"),
    (_id("r", "r_regionkey"), TYPE, "'cls:FirstRegion'", "region WHERE r_regionkey = 0"),
    (_SUPPLIER, TYPE, "'cls:Supplier'", "supplier WHERE s_acctbal >= 0"),
    (_PART, TYPE, "'cls:' || p_type", "part WHERE p_size > 2"),
    (_NATION, TYPE, "'cls:Nation'", "nation"),
    (_DOCUMENT, TYPE, "'cls:Document'", "documents"),
    ("'cls:Order_' || o_orderstatus", SUBCLASS, "'cls:Order'", "orders"),
    ("'cls:' || c_mktsegment", SUBCLASS, "'cls:Customer'", "customer"),
    ("'cls:' || p_type", SUBCLASS, "'cls:Part'", "part"),
)

#: (class, class above it) of the mapping itself.
CLASSES = (("cls:Customer", "cls:Party"), ("cls:Supplier", "cls:Party"), ("cls:Party", "cls:Entity"), ("cls:Part", "cls:Entity"), ("cls:Order", "cls:Entity"), ("cls:Nation", "cls:Entity"))

EDGE_SQL = "\nUNION ALL ".join([
    *[_edge(*e) for e in EDGES],
    *[f"SELECT '{a}' AS src, '{SUBCLASS}' AS label, '{b}' AS dst" for a, b in CLASSES],
])

#: nodes(node, value): classes that are objects of typing edges carry their own id.
NODE_SQL = f"""SELECT node, max(value) AS value FROM (
    SELECT src AS node, CAST(NULL AS STRING) AS value FROM edges
    UNION ALL SELECT dst, CASE WHEN label IN ('{TYPE}', '{SUBCLASS}') THEN dst END FROM edges) ends GROUP BY node"""

#: For databases: the two tables as common table expressions.
TABLE_SQL = (("edges", EDGE_SQL), ("nodes", NODE_SQL))

_saved: dict[tuple[str, str], str] = {}

#: Labels that an edge's task may have open at once, so that rows need no sort by label before they are written.
OPEN_LABELS = 64


@dataclass(frozen=True)
class _End:
    """One end of the edges of a table: a constant, or a prefix and a column."""

    table: str
    condition: str
    prefix: str
    column: str | None
    #: Whether typing edges lead into it.
    valued: bool = False

    @classmethod
    def of(cls, spelled: str, source: str, valued: bool = False) -> _End:
        table, _, condition = source.partition(" WHERE ")
        found = re.fullmatch(r"'([^']*)'(?: \|\| (?:CAST\()?(\w+)(?: AS STRING\))?)?", spelled)
        return cls(table, condition, found[1], found[2], valued)

    def rows(self, tables: dict[str, DataFrame]) -> DataFrame:
        return tables[self.table].where(self.condition) if self.condition else tables[self.table]

    def key(self, tables: dict[str, DataFrame]) -> tuple[str, str]:
        """(kind, expression) of what stands for the end until rows are distinct: a number or a text that is as distinct as
        the end itself; any other kind of column as the end spells it."""
        if self.column is None:
            return "none", "CAST(NULL AS STRING)"
        kind = dict(tables[self.table].dtypes)[self.column]
        if kind in ("tinyint", "smallint", "int", "bigint"):
            return "number", f"CAST({self.column} AS BIGINT)"
        return "text", self.column if kind == "string" else f"CAST({self.column} AS STRING)"

    def spell(self, key: str) -> F.Column:
        return F.lit(self.prefix) if self.column is None else F.concat(F.lit(self.prefix), F.col(key).cast("string"))


def _edge_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """What EDGE_SQL says, made distinct by the tables' own keys, which are shorter than the nodes' names.  Edges of a table's
    rows are dealt by their source, so that those of a node are in one file."""
    parts = []
    for src, label, dst, source in EDGES:
        a, b = _End.of(src, source), _End.of(dst, source)
        keys = a.rows(tables).selectExpr(f"{a.key(tables)[1]} AS a", f"{b.key(tables)[1]} AS b")
        keys = keys.repartition("a").distinct() if "CAST(" in src else keys.distinct()
        parts.append(keys.select(a.spell("a").alias("src"), F.lit(label).alias("label"), b.spell("b").alias("dst")))
    spark = parts[0].sparkSession
    parts.append(small_table(spark, [(a, SUBCLASS, b) for a, b in CLASSES], "src string, label string, dst string"))
    return reduce(DataFrame.unionByName, parts)


def _node_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """What NODE_SQL says.  Names of nodes before the first colon are kinds; a kind whose nodes come from one prefix and
    have no value is made distinct by the tables' keys."""
    ends: dict[str, list[_End]] = {}
    for src, label, dst, source in EDGES:
        for end in (_End.of(src, source), _End.of(dst, source, label in (TYPE, SUBCLASS))):
            ends.setdefault(end.prefix.partition(":")[0], []).append(end)
    parts, spark = [], next(iter(tables.values())).sparkSession
    named = [(b, b) for _, b in CLASSES] + [(a, None) for a, _ in CLASSES]
    lone = small_table(spark, named, "node string, value string")
    for own in ends.values():
        own = [e for e in dict.fromkeys(own) if not e.condition or replace(e, condition="") not in own]
        kinds = {e.key(tables)[0] for e in own}
        if len({e.prefix for e in own}) == 1 and len(kinds) == 1 and kinds <= {"number", "text"} and not any(e.valued for e in own):
            keys = reduce(DataFrame.unionByName, [e.rows(tables).selectExpr(f"{e.key(tables)[1]} AS k") for e in own])
            parts.append(keys.where("k IS NOT NULL").distinct().select(own[0].spell("k").alias("node"), F.lit(None).cast("string").alias("value")))
            lacking = reduce(DataFrame.unionByName, [e.rows(tables).where(f"{e.column} IS NULL").selectExpr("CAST(NULL AS STRING) AS node", "CAST(NULL AS STRING) AS value").limit(1) for e in own])
            lone = lone.unionByName(lacking)
        else:
            for e in own:
                node = e.rows(tables).selectExpr(f"{e.key(tables)[1]} AS k").distinct().select(e.spell("k").alias("node"))
                lone = lone.unionByName(node.withColumn("value", F.col("node") if e.valued else F.lit(None).cast("string")))
    return reduce(DataFrame.unionByName, [*parts, lone.groupBy("node").agg(F.max("value").alias("value"))])


def graph_from_tables(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph, built once for an application and saved by label in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}-{abs(hash(sf_dir)):x}"
    if key not in _saved:
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
        held = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", OPEN_LABELS)
        try:
            _edge_rows(tables).write.mode("overwrite").partitionBy("label").parquet(f"{path}/edges")
        finally:
            spark.conf.unset("spark.sql.maxConcurrentOutputFileWriters") if held is None else spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", held)
        _node_rows(tables).write.mode("overwrite").parquet(f"{path}/nodes")
        _saved[key] = path
    return Graph.load(spark, _saved[key])
