"""Turtle facts, allow-lists, caches and fetch loops without a network."""

import json
import zipfile

import pytest

from grafwerk.sources.fetch import Fetcher, extract, queried_subjects
from grafwerk.sources.turtle import AllowList, RawCache, looks_foreign, read_facts, zip_lines


@pytest.fixture
def allowed(tmp_path):
    path = tmp_path / "allow.json"
    path.write_text(json.dumps({"allowlist_id": "x", "source": "s", "predicates": ["p:a", "p:b"], "deny_predicates": ["p:c"], "prefixes": {"p": "http://p/", "long": "http://p/long/"}}))
    return AllowList.read(path)


def test_facts_skip_other_lines(spark, tmp_path):
    (tmp_path / "f.ttl").write_text('@prefix a: <b> .\n<s> <p> <o> .\n<s> <p> "x" ;\n  <q> <r> .\n<s> <q> "lit"@en .\n')
    got = sorted((r["s"], r["p"], r["o"] or r["literal"]) for r in read_facts(spark, str(tmp_path / "f.ttl")).collect())
    assert got == [("s", "p", "o"), ("s", "q", "lit")]


def test_zip_member(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.nt", "one\ntwo\n")
    assert list(zip_lines(tmp_path / "a.zip", "in.nt")) == ["one", "two"]


def test_allow_list(spark, allowed):
    rows = [("http://p/x", "http://p/a", "http://p/long/y"), ("http://p/x", "http://p/c", "o"), ("k:1", "p:b", "http://other/z")]
    got = sorted(tuple(r) for r in allowed.filter(spark.createDataFrame(rows, "s string, p string, o string")).collect())
    assert got == [("k:1", "p:b", "http://other/z"), ("p:x", "p:a", "long:y")]


def test_extraction(spark, allowed, tmp_path):
    """Two rounds: the seed, then what it leads to."""
    asked = []

    def send(request, timeout):
        asked.append(request.full_url)
        return b"<http://p/s> <http://p/a> <http://p/t> .\n" if len(asked) == 1 else b"<http://p/t> <http://p/b> <http://p/u> .\n<http://p/t> <http://p/c> <http://p/v> .\n"

    cache = RawCache(tmp_path / "cache")
    found = extract(spark, Fetcher(pause=0, send=send), "http://end/sparql", cache, allowed, ["p:s"])
    assert sorted((r["s"], r["p"], r["o"]) for r in found.collect()) == [("p:s", "p:a", "p:t"), ("p:t", "p:b", "p:u")]
    assert len(asked) == 2 and queried_subjects(cache) == {"p:s", "p:t"} and len(cache.generation_hash()) == 16


def test_fetcher_tries_again():
    calls = []

    def send(request, timeout):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return b'{"boolean": true}'

    assert Fetcher(pause=0, send=send).ask("http://end", "ASK {}") and len(calls) == 3


def test_foreign_formats():
    assert looks_foreign("# c\n@prefix x: <y> .") == "Turtle" and looks_foreign("<a> <b> <c> .") is None and looks_foreign("{}") == "JSON"
