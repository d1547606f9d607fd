"""The pipeline's stages against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grafwerk.llm import decontam, jaccard, linededup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = {k: [f"{k}{''.join(rng.choice('aeioubcdfg') for _ in range(5))}" for _ in range(300)] for k in ("le", "un")}
    item = " ".join(rng.choice(words["le"]) for _ in range(30))
    docs = []
    for i in range(60):
        own = [rng.choice(words["le" if i % 2 else "un"]) for _ in range(80)]
        text = " ".join(own) + ("\none line that many documents hold" if i % 3 == 0 else "")
        docs.append((i, text + (" " + item if i in (7, 8) else ""), "le" if i % 2 else "un", f"s{i % 4}", len(text)))
    docs += [(100 + i, docs[i][1] + " end", docs[i][2], "s0", 0) for i in range(5)] + [(200, "12 34", None, "s0", 5), (201, None, None, "s0", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, [(1, item)]


def test_stages(spark, folder):
    path, docs, items = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns = frame.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_duplicates", "decontaminate", "pack"]
    one = corpus_pipeline.language(spark, frame, path)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {d[0] for d in docs} - {200, 201}
    two = corpus_pipeline.line_dedup(spark, one, path).cache()
    want = linededup.brute_force([(r.doc_id, r.text) for r in one.collect()])
    assert two.columns == columns and {r.doc_id: r.h for r in two.withColumn("h", F.sha2("text", 256)).collect()} == {k: v[2] for k, v in want.items()}
    three = corpus_pipeline.near_duplicates(spark, two, path)
    groups = jaccard.brute_force([(r.doc_id, r.text) for r in two.collect()], 5, (80, 100))
    assert three.columns == columns and {r.doc_id for r in three.collect()} == {v[1] for v in groups.values()}
    four = corpus_pipeline.decontaminate(spark, three, path)
    clean = {r.doc_id for r in three.collect() if not decontam.brute_force(r.text, items)}
    assert four.columns == columns and {r.doc_id for r in four.collect()} == clean and not clean & {7, 8}
    packed = corpus_pipeline.pack(spark, four, path)
    assert {r.doc_id for r in packed.collect()} == clean


def test_near_duplicates_by_row(spark):
    """Ids may be repeated or null: a text without a copy stays, and one row of each group."""
    x, y, z = (" ".join(f"{k}{i}" for i in range(40)) for k in "xyz")
    rows = [(3, x), (5, x), (5, y), (7, z), (7, z), (None, z), (None, x + " end"), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(3, x), (5, y), (7, z), (9, None), (9, None)]))
    nameless = spark.createDataFrame([(None, y)] * 3, "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, nameless, "").count() == 1


@pytest.mark.parametrize("most,join", [(1_000_000, "BroadcastHashJoin"), (2, "SortMergeJoin")])
def test_near_duplicates_shuffles_no_texts(spark, monkeypatch, most, join):
    """Removed rows are broadcast whatever Spark's own limit, up to a bound; beyond it the result is the same."""
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(20)]
    rows = [(i, t) for i, t in enumerate(texts + [t + " end" for t in texts[:4]] + [None, ""])]
    plans, write = [], corpus_pipeline.store

    def watched(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(corpus_pipeline, "store", watched)
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_REMOVED", most, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.doc_id for r in kept) == [*range(20), 24, 25]
    assert len(plans) == 1 and join in plans[0]


def test_run(spark, folder):
    """The whole against plain stages: languages by their words, then plain lines, groups and passages."""
    path, docs, items = folder
    kept = [(d[0], d[1]) for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    lines, texts = linededup.brute_force(kept), dict(kept)
    keepers: dict[str, list[int]] = {}
    for doc, text in kept:
        for line in set(text.split("\n")):
            keepers.setdefault(line.strip().lower(), []).append(doc)
    gone = {k: max(v) for k, v in keepers.items() if len(k) >= 20 and len(v) >= 3}
    after = [(d, "\n".join(x for x in t.split("\n") if gone.get(x.strip().lower(), d) == d)) for d, t in kept]
    assert all(lines[d][1] == len(texts[d].split("\n")) - len(t.split("\n")) for d, t in after if t)
    groups = jaccard.brute_force(after, 5, (80, 100))
    first = [(d, t) for d, t in after if groups[d][1] == d]
    want = {d for d, t in first if not decontam.brute_force(t, items)}
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in packed} == want
    assert sum(r.n_tokens for r in packed) == sum(len(t.split()) for d, t in first if d in want)


CLASHES = ("row", "rest", "n_lines", "n_dropped", "lang_pred", "score", "rejected", "contaminated", "items", "edits", "component_id")


def test_stages_on_odd_tables(spark, folder):
    """Empty tables, columns with names that operators use, repeated rows and null ids."""
    path, docs, _ = folder
    frame = spark.createDataFrame([*docs[:6], docs[0], (None, docs[1][1], "le", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = frame.withColumns({c: F.lit("mine") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, odd.limit(0), path)
        assert empty.count() == 0
        if name != "pack":
            got = stage(spark, odd, path)
            assert got.columns == odd.columns == empty.columns
            assert {tuple(r) for r in got.select(*CLASHES).distinct().collect()} <= {("mine",) * len(CLASHES)}
            if name == "line_dedup":
                assert got.count() == 8
    assert corpus_pipeline.near_duplicates(spark, odd, path).count() == 6
