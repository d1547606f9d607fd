"""Quality rules as a short-circuit cascade, in built-in SQL functions only.

Every document gets the statistics of its whole text.  The rules are predicates over these statistics or over
the text itself that reject a document; those over the text read it again, so they cost work in proportion to
its length.  On a bounded sample (different texts with the smallest hashes, each for as many documents as hold it),
each rule's work is added up and the rejections of all rules are counted together; the next rule is always the
one that rejects most of what the rules before it leave, per work.  Rules run in this order inside one ``CASE``,
so a rule is evaluated only for documents that no earlier rule, and no base rule, has rejected.  Work is counted,
not timed, so the order is the same in every run.  It decides how much work is done, never which documents are
kept: a document is kept if no rule rejects it.

Defined cases: null text has no words; further columns pass through, whatever their names (those that this adds are
replaced); repeated rows stay, with equal results; very long texts are read whole; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.llm.common import SPACE_CLASS, WORD_PATTERN

#: Texts of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 512
#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the text and the statistics of :func:`with_stats`, ``work`` is SQL for what it costs."""

    name: str
    rejects: str
    work: str = "1"


#: Work per character of a text that a regular expression reads once, in comparisons of numbers.
READING = "0.25 * length(text)"

#: Base rules decide ``base_failed``.
BASE_RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
)
#: The method's own rules.
RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_text_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("few_letters", "2 * length(regexp_replace(text, '[^\\\\p{L}]+', '')) < word_chars", READING),
    Rule("many_digits", "10 * length(regexp_replace(text, '[^0-9]+', '')) > 3 * word_chars", READING),
    Rule("capitals", "10 * length(regexp_replace(text, '[^\\\\p{Lu}]+', '')) > 6 * word_chars", READING),
    Rule("bullets", "10 * regexp_count(text, '(^|\\n)[ \\t]*[-*•]') > 9 * n_text_lines", READING),
)


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once for all its uses in ``use``."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the text, the first included.

    Windows are hashed (64 bits); only documents with an equal pair go on to sort
    (hash, position) and to add up the union of the repeated windows.
    """
    n = F.size(words)
    windows = F.greatest(n - 2, F.lit(0))
    hashes = F.transform(
        F.arrays_zip(F.slice(words, 1, windows).alias("a"), F.slice(words, 2, windows).alias("b"), F.slice(words, 3, windows).alias("c")),
        lambda w: F.xxhash64(w["a"], w["b"], w["c"]),
    )

    def covered(h: Column) -> Column:
        at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda x, j: x["h"] == F.get(s, j)["h"]
            repeated = F.filter(s, lambda x, j: ((j > 0) & same(x, j - 1)) | ((j < last) & same(x, j + 1)))
            return F.sort_array(F.transform(repeated, lambda x: x["i"]))

        def union(p: Column) -> Column:
            return F.aggregate(
                p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")),
                lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["end"])).alias("n"), x.alias("end")),
            )["n"]

        return _let(_let(at, positions), union)

    return F.when(n < 4, F.lit(0)).otherwise(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_text_lines", "n_repeat_words")


def with_stats(docs: DataFrame) -> DataFrame:
    """(row, text, the STATS as long): the columns as a struct, and the statistics of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(F.col("text"), SPACE_CLASS + "+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD_PATTERN))
    parts = docs.select(F.struct("*").alias("row"), text.alias("text")).withColumns({"words": words, "lines": lines})
    stats = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.regexp_replace("text", SPACE_CLASS + "+", "")),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_text_lines": F.size("lines"),
        "n_repeat_words": repeat_words(F.col("words")),
    }
    return parts.select("row", "text", *[stats[n].cast("long").alias(n) for n in STATS])


def cascade_order(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, int, float]]:
    """(rule, rejections that are new, work), in the order of the cascade."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(text.alias("text")).withColumn("hash", F.xxhash64("text"))
    few = F.pmod("hash", F.lit(1 << 30)) < int(min(1.0, 4 * sample_rows / max(1, docs.count())) * (1 << 30))  # about four times as many as are taken
    some = hashed.where(few).groupBy("hash").agg(F.min("text").alias("text"), F.count("*").alias("copies")).orderBy(F.pmod("hash", F.lit(1 << 30)), "hash").limit(sample_rows)
    sample = with_stats(some.select("text", "copies")).where(~any_rejects(BASE_RULES)).withColumn("copies", F.col("row.copies"))
    hit = F.concat(F.lit(""), *[F.when(F.expr(f"coalesce({r.rejects}, false)"), "1").otherwise("0") for r in rules])
    rows = sample.groupBy(hit.alias("hit")).agg(F.sum("copies").alias("n"), *[F.sum(F.expr(f"copies * cast({r.work} AS double)")).alias(f"w{i}") for i, r in enumerate(rules)]).collect()
    work = [sum(row[f"w{i}"] for row in rows) + 1 for i in range(len(rules))]
    left, order = [(row["hit"], row["n"]) for row in rows], []
    todo = list(range(len(rules)))
    while todo:
        gains = {i: sum(n for hit, n in left if hit[i] == "1") for i in todo}
        best = min(todo, key=lambda i: (-gains[i] / work[i], work[i], rules[i].name))
        order.append((rules[best], gains[best], work[best]))
        left = [(hit, n) for hit, n in left if hit[best] != "1"]
        todo.remove(best)
    return order


def any_rejects(rules: Sequence[Rule]) -> Column:
    """True if a rule rejects; later rules aren't evaluated once one has."""
    case = F
    for rule in rules:
        case = case.when(F.expr(f"coalesce({rule.rejects}, false)"), F.lit(True))
    return case.otherwise(F.lit(False)) if rules else F.lit(False)


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns, the statistics, base_failed and kept (boolean)."""
    docs = docs.drop(*STATS, "base_failed", "kept")
    order = [rule for rule, _, _ in cascade_order(docs, rules, sample_rows)]
    judged = with_stats(docs).withColumn("base_failed", any_rejects(BASE_RULES)).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~any_rejects(order)))
    return judged.select("row.*", *STATS, "base_failed", "kept")


def brute_force(text: str | None) -> tuple[int, int, int, int, int]:
    """Plain Python for tests: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
