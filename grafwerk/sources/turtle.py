"""Facts that a Turtle file states on one line each, allow-lists, and cached responses."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafwerk.sources.ntriples import parse, read_lines


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, s, p, o, literal) of the lines that are a whole fact; other lines are skipped."""
    lines = read_lines(spark, path).where(F.rtrim("value").endswith(".") & ~F.col("value").startswith("@"))
    return parse(lines, strict=False)


def zip_lines(path: str | Path, member: str) -> Iterator[str]:
    """Lines of one file in an archive, without unpacking it."""
    with zipfile.ZipFile(path) as archive, archive.open(member) as lines:
        for line in lines:
            yield line.decode("utf-8").rstrip("\n")


@dataclass(frozen=True)
class AllowList:
    allowlist_id: str
    source: str
    predicates: frozenset[str]
    deny_predicates: frozenset[str]
    prefixes: tuple[tuple[str, str], ...]
    content_hash: str

    @classmethod
    def read(cls, path: str | Path) -> AllowList:
        raw = Path(path).read_text(encoding="utf-8")
        data = json.loads(raw)
        prefixes = tuple(sorted(data["prefixes"].items(), key=lambda x: (-len(x[1]), x[0])))  # the longest first
        return cls(data["allowlist_id"], data["source"], frozenset(data["predicates"]), frozenset(data.get("deny_predicates", ())), prefixes, hashlib.sha256(raw.encode()).hexdigest()[:16])

    def abbreviate(self, term: Column) -> Column:
        """A full IRI as prefix and local name, by the longest namespace; other terms unchanged."""
        out = F
        for prefix, space in self.prefixes:
            out = out.when(term.startswith(space), F.concat(F.lit(prefix + ":"), F.substring(term, len(space) + 1, 1 << 30)))
        full = term.startswith("http://") | term.startswith("https://")
        return F.when(full, out.otherwise(term)).otherwise(term) if self.prefixes else term

    def filter(self, triples: DataFrame) -> DataFrame:
        """Abbreviated triples (s, p, o, ...) whose predicate is allowed."""
        short = triples.withColumns({c: self.abbreviate(F.col(c)) for c in ("s", "p", "o") if c in triples.columns})
        return short.where(F.col("p").isin(*sorted(self.predicates)))

    def denied(self, edges: DataFrame) -> DataFrame:
        return edges.where(F.col("label").isin(*sorted(self.deny_predicates))) if self.deny_predicates else edges.where(F.lit(False))


@dataclass(frozen=True)
class RawCache:
    """A folder of responses, each an N-Triples file beside a JSON file about its query."""

    folder: Path

    def store(self, query: str, body: str, **about: object) -> str:
        name = hashlib.sha256(query.encode()).hexdigest()[:16]
        self.folder.mkdir(parents=True, exist_ok=True)
        (self.folder / f"{name}.nt").write_text(body, encoding="utf-8")
        (self.folder / f"{name}.json").write_text(json.dumps({"query": query, **about}, sort_keys=True), encoding="utf-8")
        return name

    def query_hashes(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.nt"))

    def generation_hash(self) -> str:
        return hashlib.sha256("|".join(self.query_hashes()).encode()).hexdigest()[:16]

    def triples(self, spark: SparkSession) -> DataFrame:
        return parse(read_lines(spark, f"{self.folder}/*.nt"))


def construct_query(subjects: Iterable[str], predicates: Iterable[str], prefixes: dict[str, str]) -> str:
    """SPARQL for all statements of these subjects with these predicates."""
    head = "".join(f"PREFIX {k}: <{v}>\n" for k, v in sorted(prefixes.items()))
    return f"{head}CONSTRUCT {{ ?s ?p ?o }} WHERE {{ VALUES ?s {{ {' '.join(sorted(subjects))} }} VALUES ?p {{ {' '.join(sorted(predicates))} }} ?s ?p ?o }}"


def looks_foreign(text: str) -> str | None:
    """What another serialisation a text seems to be, by its first line."""
    first = next((x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")), "")
    for mark, name in (("@prefix", "Turtle"), ("PREFIX", "Turtle"), ("<?xml", "RDF/XML"), ("<rdf:", "RDF/XML"), ("{", "JSON"), ("[", "JSON")):
        if first.startswith(mark):
            return name
    return None
