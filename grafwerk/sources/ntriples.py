"""N-Triples: lines to a graph, and back.

A line is ``s p o .``: IRIs in angle brackets or bare CURIEs, blank nodes, and literals as objects.
The order of lines matters in two places, so every line carries a number: of several literals for one
(subject, local name of the predicate) the last line wins, and a class gets its own id as value
only if nothing gave it one before.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafwerk.graph import EDGES, NODES, Graph

#: Predicates whose objects are classes.
TYPE_PREDICATES = ("rdf:type", "rdfs:subClassOf", "wdt:P31", "wdt:P279", "a")
FULL_TYPE_PREDICATES = ("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#subClassOf")

_LITERAL = r'"(?:[^"\\]|\\.)*"(?:\^\^\S+?|@[A-Za-z0-9-]+?)?'
_TERM = rf"(?:<[^<>\s]*>|_:\S+?|{_LITERAL}|(?!\.(?:\s|$))[^\s\"<>]+?)"
#: One line: three terms, and the full stop.
LINE = rf"^\s*({_TERM})\s+({_TERM})\s+({_TERM})\s*\.?\s*$"
NOTHING = r"^\s*(?:#.*)?$"


class NTriplesError(ValueError):
    """A line is no triple."""


def local_name(iri: Column) -> Column:
    """What follows the last of ``#``, ``/`` and ``:``."""
    return F.regexp_extract(iri, r"([^#/:]*)$", 1)


def _resource(term: Column) -> Column:
    return F.when(term.startswith("<"), F.regexp_replace(term, "^<|>$", "")).when(term.startswith("_:"), F.concat(F.lit("bnode:"), F.substring(term, 3, 1 << 30))).otherwise(term)


#: Escapes of literals.
ESCAPES = (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'))


def _unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for written, meant in ESCAPES:
        text = F.replace(text, F.lit(written), F.lit(meant))
    return F.replace(text, F.lit("\x00"), F.lit("\\"))


def escape_literal(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for written, meant in ESCAPES:
        text = F.replace(text, F.lit(meant), F.lit(written))
    return F.concat(F.lit('"'), text, F.lit('"'))


def parse(lines: DataFrame, strict: bool = True) -> DataFrame:
    """lines: (value, line_no).  (line_no, s, p, o, literal); ``strict`` raises at lines that are
    no triple, otherwise they are skipped."""
    kept = lines.select("line_no", "value").where(~F.col("value").rlike(NOTHING))
    good = F.col("value").rlike(LINE) & ~F.col("value").rlike(r'^\s*(?:"|\S+\s+")')  # only objects are literals
    if strict:
        bad = F.raise_error(F.concat(F.lit("not a triple: "), F.col("value")))
        skipped = F.col("value").rlike(NOTHING)  # filters may run after this
        kept = kept.withColumn("value", F.when(good | skipped, F.col("value")).otherwise(bad))
    else:
        kept = kept.where(good)
    found = kept.select("line_no", *[F.regexp_extract("value", LINE, i).alias(c) for i, c in enumerate("spo", 1)])
    literal = F.when(F.col("o").startswith('"'), _unescape(F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1)))
    return found.select("line_no", _resource(F.col("s")).alias("s"), _resource(F.col("p")).alias("p"), F.when(literal.isNull(), _resource(F.col("o"))).alias("o"), literal.alias("literal"))


def build(triples: DataFrame, type_predicates: Iterable[str] = TYPE_PREDICATES) -> Graph:
    """triples: (line_no, s, p, o, literal)."""
    value_node = F.concat(F.col("s"), F.lit("#"), local_name(F.col("p")))
    dst = F.coalesce("o", value_node)
    edges = triples.select(F.col("s").alias("src"), F.col("p").alias("label"), dst.alias("dst"))
    # a node's values in line order: literals replace, a class's own id only fills a gap
    given = triples.where("literal IS NOT NULL").select(value_node.alias("node"), "line_no", F.col("literal").alias("value"), F.lit(True).alias("literal"))
    own = triples.where(F.col("literal").isNull() & F.col("p").isin(*type_predicates)).select(F.col("o").alias("node"), "line_no", F.col("o").alias("value"), F.lit(False).alias("literal"))
    events = given.unionByName(own)
    last_literal = F.max_by("value", F.when(F.col("literal"), F.col("line_no")))
    values = events.groupBy("node").agg(F.coalesce(last_literal, F.first("value")).alias("value"))
    return Graph.of(edges, values)


def read_ntriples(spark: SparkSession, path: str, type_predicates: Iterable[str] = TYPE_PREDICATES) -> Graph:
    return build(parse(read_lines(spark, path)), type_predicates)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no): numbers follow files by name and lines by place."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    numbered = text.withColumn("row", F.monotonically_increasing_id())  # increasing within a split
    order = F.struct("file", "start", "row")
    return numbered.select("value", order.alias("line_no"))


def from_lines(spark: SparkSession, lines: Iterable[str], type_predicates: Iterable[str] = TYPE_PREDICATES) -> Graph:
    rows = [(line, i) for i, line in enumerate(lines)]
    return build(parse(spark.createDataFrame(rows, "value string, line_no long")), type_predicates)


def to_lines(graph: Graph) -> DataFrame:
    """(src, label, dst, line): objects whose value isn't their id are written as literals."""
    values = graph.nodes.select(F.col("node").alias("dst"), "value")
    joined = graph.edges.join(values, "dst", "left")
    return joined.select("src", "label", "dst", line(F.col("src"), F.col("label"), F.col("dst"), F.col("value")).alias("line"))


def line(src: Column, label: Column, dst: Column, value: Column) -> Column:
    wrap = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    end = F.when(value.isNotNull() & (value != dst), escape_literal(value)).otherwise(wrap(dst))
    return F.concat(wrap(src), F.lit(" "), wrap(label), F.lit(" "), end, F.lit(" ."))


def write_ntriples(graph: Graph, path: str, files: int | None = None) -> None:
    """Sorted lines as text files; ``files=1`` for a single one.  Isolated nodes are lost."""
    out = to_lines(graph).orderBy("src", "label", "dst").select("line")
    (out if files is None else out.coalesce(files)).write.mode("overwrite").text(path)


def empty(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
