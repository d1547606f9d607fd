"""Connectors to SPARQL endpoints and downloads, and the loops that fetch a slice through them.

These run on the driver: an endpoint allows few requests, one after the other.  ``send`` can be
replaced, which is how the tests run without a network.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafwerk.sources.turtle import AllowList, RawCache, construct_query


def _send(request: urllib.request.Request, timeout: float) -> bytes:
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


@dataclass
class Fetcher:
    """One request at a time, at least ``pause`` seconds apart; tries again on errors."""

    agent: str = "grafwerk (offline by default)"
    pause: float = 1.0
    timeout: float = 60.0
    tries: int = 3
    send: Callable[[urllib.request.Request, float], bytes] = _send
    _last: float = field(default=0.0, repr=False)

    def _get(self, url: str, accept: str) -> bytes:
        for attempt in range(self.tries):
            time.sleep(max(0.0, self._last + self.pause * (attempt + 1) - time.monotonic()))
            self._last = time.monotonic()
            try:
                return self.send(urllib.request.Request(url, headers={"User-Agent": self.agent, "Accept": accept}), self.timeout)
            except OSError:
                if attempt + 1 == self.tries:
                    raise
        raise ValueError("tries must be positive")

    def construct(self, endpoint: str, query: str) -> str:
        return self._get(f"{endpoint}?{urllib.parse.urlencode({'query': query})}", "application/n-triples").decode("utf-8")

    def ask(self, endpoint: str, query: str) -> bool:
        answer = self._get(f"{endpoint}?{urllib.parse.urlencode({'query': query})}", "application/sparql-results+json")
        return bool(json.loads(answer)["boolean"])

    def download(self, url: str, path: str | Path) -> Path:
        path = Path(path)
        path.write_bytes(self._get(url, "*/*"))
        return path


def queried_subjects(cache: RawCache) -> set[str]:
    """Subjects that cached responses were asked for."""
    found: set[str] = set()
    for name in cache.query_hashes():
        found.update(json.loads((cache.folder / f"{name}.json").read_text(encoding="utf-8")).get("subjects", ()))
    return found


def extract(spark: SparkSession, fetcher: Fetcher, endpoint: str, cache: RawCache, allowed: AllowList, seeds: Iterable[str], predicates: Iterable[str] | None = None, rounds: int | None = 2, batch: int = 50, most: int | None = None) -> DataFrame:
    """Fetch statements about the seeds and, round by round, about what they lead to; with the typing
    predicates and ``rounds`` None, the typing closure.

    A round asks for its whole frontier, or for its first ``most`` by name where such a limit is given; what
    is left comes first in the next round.  Returns all cached triples (line_no, s, p, o, literal), abbreviated and allowed.
    """
    wanted = sorted(predicates if predicates is not None else allowed.predicates)
    prefixes = dict(allowed.prefixes)
    asked = queried_subjects(cache)
    waiting = sorted(set(seeds) - asked)
    turn = 0
    while waiting and (rounds is None or turn < rounds):
        turn += 1
        now, waiting = waiting[:most], waiting[len(waiting) if most is None else most :]
        for at in range(0, len(now), batch):
            part = now[at : at + batch]
            query = construct_query(part, wanted, prefixes)
            cache.store(query, fetcher.construct(endpoint, query), subjects=part)
        asked |= set(now)
        ends = allowed.filter(cache.triples(spark)).where("literal IS NULL").select("o").distinct()
        known = spark.createDataFrame([(s,) for s in sorted(asked.union(waiting))], "o string")
        waiting += [row[0] for row in ends.join(known, "o", "left_anti").orderBy("o").toLocalIterator()]  # what the network is asked for next
    return allowed.filter(cache.triples(spark)).where(F.col("p").isin(*wanted))
