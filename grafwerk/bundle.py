"""Output bundles: the repaired graph, a reversible diff, the rules and the report."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafwerk.graph import Graph, difference
from grafwerk.rules import ConstraintSet
from grafwerk.sources.ntriples import line, to_lines

REPAIRED, DIFF, RULES, REPORT = "repaired.nt", "changes.nt.diff", "constraints.used.json", "report.json"


def diff_lines(before: Graph, after: Graph) -> DataFrame:
    """(line): "- " and "+ " statements in edge order, spelled as in the graph files."""
    removed, added = difference(before, after)

    def spelled(edges: DataFrame, graph: Graph, sign: str) -> DataFrame:
        values = graph.nodes.select(F.col("node").alias("dst"), "value")
        text = F.concat(F.lit(sign + " "), line(F.col("src"), F.col("label"), F.col("dst"), F.col("value")))
        return edges.join(values, "dst", "left").select("src", "label", "dst", F.lit(sign).alias("sign"), text.alias("line"))

    return spelled(removed, before, "-").unionByName(spelled(added, after, "+")).orderBy("src", "label", "dst", "sign").select("line")


def parse_diff(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, added) statements (line) of a diff."""
    side = lambda sign: lines.where(F.col("line").startswith(sign + " ")).select(F.substring("line", 3, 1 << 30).alias("line"))
    return side("-"), side("+")


def reverse(repaired: DataFrame, diff: DataFrame) -> DataFrame:
    """The statements before a repair, from those after it and the diff."""
    removed, added = parse_diff(diff)
    return repaired.join(added, "line", "left_anti").unionByName(removed).distinct().orderBy("line")


def _write_lines(df: DataFrame, path: Path) -> None:
    """One file, written line by line: a bundle is a download, not a table."""
    with path.open("w", encoding="utf-8") as out:
        for row in df.toLocalIterator():
            out.write(row[0] + "\n")


def write_bundle(folder: str | Path, report: dict, repaired: Graph | None = None, original: Graph | None = None, rules: ConstraintSet | None = None) -> list[str]:
    """Without a graph (a repair that the cap refused), the report and the rules alone."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    if repaired is not None:
        _write_lines(to_lines(repaired).orderBy("src", "label", "dst").select("line"), folder / REPAIRED)
        if original is not None:
            _write_lines(diff_lines(original, repaired), folder / DIFF)
    if rules is not None:
        rules.to_file(folder / RULES)
    (folder / REPORT).write_text(json.dumps(report, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return sorted(p.name for p in folder.iterdir() if p.name in (REPAIRED, DIFF, RULES, REPORT))


def zip_bundle(folder: str | Path, archive: str | Path | None = None) -> Path:
    """The same bytes for the same files."""
    folder = Path(folder)
    archive = Path(archive or folder.with_suffix(".zip"))
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(p for p in folder.iterdir() if p.is_file()):
            entry = zipfile.ZipInfo(path.name, (1980, 1, 1, 0, 0, 0))
            entry.compress_type, entry.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            out.writestr(entry, path.read_bytes())
    return archive
