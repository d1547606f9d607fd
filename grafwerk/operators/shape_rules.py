"""The shape generator: typing, requirement, domain and range rules from a graph's profile.

Bodies are one long table (body, n) of profiles of nodes: steps and forward paths with enough nodes, and conjunctions
of them.  All bodies are scored against all classes by one aggregated join.  Exceptions are named by one ranked join of
the profiles that lack a class with their nodes; the driver holds the rules only.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.graph import Graph, cut, small_table
from grafwerk.operators import shapes
from grafwerk.operators.metrics import ancestors
from grafwerk.operators.profiles import BIT_TAGS, Profiles, count, grouped, profiles, tagged, vocabulary
from grafwerk.operators.search import AND, SearchConfig, atom_text, lattice, tau_text
from grafwerk.plans import ast
from grafwerk.plans.parser import parse_node
from grafwerk.rules import CORE, SUBSET, SUPERSET, Constraint, ConstraintSet

#: The direction in which a kind of rule is repaired unless asked otherwise.
DIRECTIONS = {"existential_domain": SUBSET, "existential_range": SUBSET, "typing_existence": SUPERSET, "requires_statement": SUPERSET, "weakening": SUPERSET}
#: Roles in ids, and nodes listed as exceptions.
ROLES = {"existential_domain": "dom", "existential_range": "rng", "typing_existence": "typ", "requires_statement": "req"}
EXCEPTIONS = 10

#: Edges that a task joins when paths are made longer.
TASK_EDGES = 1_000_000

#: Between the labels of a forward path's key.
THEN = "\x02"


def path_extensions(graph: Graph, cfg: SearchConfig) -> DataFrame:
    """(key, n): starts of forward paths of 2 to ``max_path`` steps; a path is only made longer while enough
    nodes start it.  A key is p_ and the labels."""
    if cfg.max_path < 2:
        return small_table(graph.spark, [], "key string, n string")
    edges = graph.edges.where(~F.col("label").isin(cfg.type_predicate, cfg.subclass_predicate))
    starts = cut(edges.select(F.col("label").alias("chain"), "src").distinct(), "starts")
    sizes = starts.groupBy("chain").agg(F.count("src").alias("size")).where(F.col("size") >= cfg.min_support)
    labels = sorted(r["chain"] for r in sizes.collect())  # the vocabulary
    edges, tails = edges.where(F.col("label").isin(*labels)), starts.where(F.col("chain").isin(*labels))
    # so many tasks that each has a bounded number of edges, whatever their bytes; not for the last few
    tasks = edges.count() // TASK_EDGES
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks > 1 else df
    # grown at the front; keys are the same as if grown at the back
    found = []
    for _ in range(2, cfg.max_path + 1):
        ahead = edges.select(F.col("label").alias("head"), F.col("src").alias("start"), F.col("dst").alias("src"))
        longer = dealt(ahead, "src").join(dealt(tails, "src"), "src")
        longer = dealt(longer.select(F.concat("head", F.lit(THEN), "chain").alias("chain"), F.col("start").alias("src")), "chain", "src").distinct()
        longer = cut(longer, "longer")
        enough = longer.groupBy("chain").agg(F.count("*").alias("size")).where(F.col("size") >= cfg.min_support).select("chain")
        tails = longer.join(F.broadcast(enough), "chain", "left_semi")  # a row a chain
        found.append(tails.select(F.concat(F.lit("p_"), "chain").alias("key"), F.col("src").alias("n")))
    out = small_table(graph.spark, [], "key string, n string")
    for part in found:
        out = out.unionByName(part)
    return out


def text_of(key: str, cfg: SearchConfig) -> str:
    if key.startswith("p_"):
        return "< " + " . ".join(f"down({label})" for label in key[2:].split(THEN)) + " >"
    return atom_text(key, cfg)


#: The kind of tags of paths.
PATH = "p_"


def profiled(graph: Graph, cfg: SearchConfig) -> Profiles:
    """The profiles of the nodes by classes, steps and forward paths, with the nodes of each."""
    typing = [cfg.type_predicate], [cfg.subclass_predicate]
    if cfg.max_path < 2:
        return profiles(graph, *typing, keep=True)
    paths = path_extensions(graph, cfg).select("n", F.col("key").alias("tag"))
    tags, own = vocabulary(graph, *typing), [r[0] for r in paths.select("tag").distinct().limit(BIT_TAGS + 1).collect()]
    every = sorted({*tags, *own}) if tags is not None and len(tags) + len(own) <= BIT_TAGS else None
    return grouped(graph, tagged(graph, *typing).unionByName(paths), every, typing[1], keep=True)


def bodies(own: Profiles, cfg: SearchConfig) -> DataFrame:
    """(body, atoms, n, weight) of single steps, and of conjunctions of steps and paths; n are profiles."""
    paths = own.having(PATH, "key").select(F.concat(F.lit(PATH), "key").alias("key"), "n", "weight")
    return lattice(own.steps().unionByName(paths), cfg).where(~((F.col("atoms") == 1) & F.col("body").startswith(PATH))).select("body", "atoms", "n", "weight")


def best_classes(own: Profiles, members: DataFrame, cfg: SearchConfig) -> DataFrame:
    """(body, cls, support, size, standard, pca, runners_up): for each body the most specific class that clears all
    floors, by depth, support and id, and up to five others in the same order."""
    typed, has = own.typed().select("n", "cls"), own.has_type()
    sizes = members.groupBy("body").agg(count(members).alias("size"))
    judged = members.join(has, "n", "left_semi").groupBy("body").agg(count(members).alias("typed"))
    support = members.join(typed, "n").groupBy("body", "cls").agg(count(members).alias("support"))
    scores = support.join(judged, "body").join(sizes, "body").withColumns({"pca": F.col("support") / F.col("typed"), "standard": F.col("support") / F.col("size")})
    cleared = cut(scores.where((F.col("typed") >= shapes.TYPED_SHARE * F.col("size")) & (F.col("support") >= cfg.min_support) & (F.col("pca") >= cfg.min_confidence)), "cleared")
    up = ancestors(own.graph, own.subclass_of)
    below = cleared.select("body", F.col("cls").alias("low")).join(up.withColumnRenamed("cls", "low"), "low").select("body", F.col("sup").alias("cls"), F.lit(True).alias("above")).distinct()
    depth = up.groupBy("cls").agg(F.count("*").alias("depth"))
    # a class above another that clears is no choice, unless all are (classes in a cycle)
    order = [F.coalesce("above", F.lit(False)), F.desc(F.coalesce("depth", F.lit(0))), F.desc("support"), "cls"]
    ranked = cleared.join(below, ["body", "cls"], "left").join(depth, "cls", "left").withColumn("rank", F.row_number().over(Window.partitionBy("body").orderBy(*order)))
    others = ranked.where("rank BETWEEN 2 AND 6").groupBy("body").agg(F.sort_array(F.collect_list(F.struct("rank", "cls"))).alias("others"))
    best = ranked.where("rank = 1").join(others, "body", "left")
    return best.select("body", "cls", "support", "size", "standard", "pca", F.coalesce(F.col("others.cls"), F.array().cast("array<string>")).alias("runners_up"))


def first_nodes(own: Profiles, lacking: DataFrame, keys: list[str], limit: int = EXCEPTIONS) -> DataFrame:
    """(*keys, rank, n): the first nodes of the profiles of each key.  lacking: (*keys, n), n a profile."""
    few = lacking.select("n").distinct().withColumnRenamed("n", "own")
    nodes = own.nodes.withColumnRenamed("n", "own")
    within = nodes.join(F.broadcast(few), nodes["own"].eqNullSafe(few["own"]), "left_semi")
    order = F.asc_nulls_last("node")
    first = within.withColumn("place", F.row_number().over(Window.partitionBy("own").orderBy(order))).where(F.col("place") <= limit)
    named = lacking.join(first, F.col("n").eqNullSafe(F.col("own"))).select(*keys, "node")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("rank") <= limit)
    return ranked.select(*keys, "rank", F.col("node").alias("n"))


def exceptions(own: Profiles, members: DataFrame, chosen: DataFrame, limit: int = EXCEPTIONS) -> DataFrame:
    """(body, cls, rank, n): the first nodes of each body that aren't in its class."""
    lacking = members.join(chosen.select("body", "cls"), "body").join(own.typed().select("n", "cls"), ["n", "cls"], "left_anti")
    return first_nodes(own, cut(lacking.select("body", "cls", "n"), "lacking"), ["body", "cls"], limit)


def reduced_cover(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(rule, covered_by): each rule whose nodes all lie in those of another rule with the same consequent, with the largest
    such rule; of equal ones the smaller id stands.  members: (rule, n), with a weight if n are profiles; groups:
    (rule, consequent)."""
    sizes = groups.join(members.groupBy("rule").agg(count(members).alias("size")), "rule")
    known = members.join(groups, "rule")
    weight = ["weight"] if "weight" in members.columns else []
    a, b = known.select("consequent", "n", F.col("rule").alias("covered_by")), known.select("consequent", "n", "rule", *weight)
    shared = a.join(b, ["consequent", "n"]).where("covered_by <> rule").groupBy("rule", "covered_by").agg(count(b).alias("both"))
    of = lambda x, size: sizes.select(F.col("rule").alias(x), F.col("size").alias(size))
    within = shared.join(of("rule", "own"), "rule").join(of("covered_by", "other"), "covered_by").where("both = own AND (other > own OR covered_by < rule)")
    return within.groupBy("rule").agg(F.min(F.struct((-F.col("other")).alias("size"), "covered_by")).alias("m")).select("rule", "m.covered_by")


@dataclass(frozen=True)
class ShapeResult:
    rules: ConstraintSet
    #: One record a rule, in the order of ids.
    report: list[dict]
    #: Rules by kind.
    stats: dict[str, int]
    config: SearchConfig
    #: Redundant rules with the rule that covers them.
    covered: dict[str, str] = field(default_factory=dict)


class OutOfFragment(ValueError):
    """A rule that isn't made of positive existence tests."""


def in_fragment(rule: Constraint) -> Constraint:
    """The rule, if both of its sides parse as positive expressions."""
    for side in (rule.antecedent, rule.consequent):
        try:
            parse_node(side)
        except ValueError as wrong:
            raise OutOfFragment(f"{rule.cid}: {wrong}") from wrong
    return rule


def local(term: str) -> str:
    return term.split(":", 1)[-1] if ":" in term else term


def _key(body: str) -> str:
    one = lambda k: k[:2] + "_".join(map(local, k[2:].split(THEN)))
    atoms = body.split(AND)
    return "_".join(map(one, atoms)) if len(atoms) > 1 else local(body[2:])


def shape_rules(graph: Graph, domain: str, kg: str, cfg: SearchConfig, directions: dict[str, str] | None = None, reduce_cover: bool = True) -> ShapeResult:
    """All rules of the shapes; rules that the reduced cover drops are named in ``covered``."""
    directions = DIRECTIONS | (directions or {})
    own = profiled(graph, cfg)
    members = cut(bodies(own, cfg), "bodies")
    best = cut(best_classes(own, members, cfg), "best")
    required = cut(shapes.requirements(graph, cfg), "required")
    foreign = {(r["role"], r["label"]): r for r in shapes.contamination(graph, cfg).collect()}  # two rows a label
    listed: dict[tuple, list[str]] = {}
    for r in exceptions(own, members, best).collect():
        listed.setdefault((r["body"], r["cls"]), []).append((r["rank"], r["n"]))
    carried = own.endpoints().where("role = 'domain'").select("label", "n")
    needed = required.select("cls", "label").join(own.typed(), "cls").join(carried, ["label", "n"], "left_anti").select("cls", "label", "n")
    for r in first_nodes(own, cut(needed, "needed"), ["cls", "label"]).collect():
        listed.setdefault((r["cls"], r["label"]), []).append((r["rank"], r["n"]))

    rules, report, keys = [], [], {}

    def add(kind: str, key: str, antecedent: str, consequent: str, gloss: str, group: str, of: tuple, **facts) -> None:
        cid = f"{domain}.{kg}.{ROLES[kind]}.{key}.mined"
        rules.append(in_fragment(Constraint(cid, antecedent, consequent, domain, kg, kind, CORE, "mined", directions[kind], gloss, {"miner": "profile_v1"})))
        record = {"cid": cid, "kind": kind, "human_gloss": gloss, "contamination": False, "contamination_class": None, "low_trust": False, "runner_up_classes": []}
        report.append(record | facts | {"exceptions": [n for _, n in sorted(listed.get(of, []))]})
        keys[cid] = (group, of)

    for r in best.orderBy("body").collect():  # a row a body
        atoms, head = r["body"].split(AND), tau_text(cfg, r["cls"])
        text = " & ".join(text_of(k, cfg) for k in atoms)
        facts = {"class": r["cls"], "support": r["support"], "body_size": r["size"], "standard_conf": round(r["standard"], 4), "pca_conf": round(r["pca"], 4), "runner_up_classes": list(r["runners_up"])}
        if len(atoms) > 1:
            add("typing_existence", _key(r["body"]), text, head, f"nodes matching {' and '.join(text_of(k, cfg) for k in atoms)} are typed {r['cls']}", f"class:{r['cls']}", (r["body"], r["cls"]), predicate=text, **facts)
            continue
        label, is_domain = atoms[0][2:], atoms[0].startswith("d_")
        seen = foreign.get(("domain" if is_domain else "range", label))
        gloss = f"nodes with an outgoing {label} edge are typed {r['cls']}" if is_domain else f"nodes that are the target of {label} are typed {r['cls']}"
        add("existential_domain" if is_domain else "existential_range", local(label), text, head, gloss, f"class:{r['cls']}", (r["body"], r["cls"]), predicate=label, **(facts | {"contamination": bool(seen and seen["flagged"])}))
    for r in required.orderBy("cls", "label").collect():
        share = round(r["confidence"], 4)
        add("requires_statement", f"{local(r['cls'])}.{local(r['label'])}", tau_text(cfg, r["cls"]), f"< down({r['label']}) >", f"instances of {r['cls']} have an outgoing {r['label']} edge", f"pred:{r['label']}", (r["cls"], r["label"]),
            predicate=r["label"], support=r["support"], body_size=r["members"], standard_conf=share, pca_conf=share, low_trust=True, low_trust_reason="missing-edge ambiguity; prefer schema declaration", **{"class": r["cls"]})
    covered = _covered(graph, members, own.typed(), keys) if reduce_cover and rules else {}
    order = sorted(range(len(rules)), key=lambda i: rules[i].cid)
    kept = [i for i in order if rules[i].cid not in covered]
    stats: dict[str, int] = {}
    for i in kept:
        stats[rules[i].kind] = stats.get(rules[i].kind, 0) + 1
    return ShapeResult(ConstraintSet(f"{domain}@{kg}.mined", [rules[i] for i in kept]), [report[i] for i in kept], stats | {"total": len(kept), "covered": len(covered)}, cfg, covered)


def _covered(graph: Graph, members: DataFrame, typed: DataFrame, keys: dict[str, tuple]) -> dict[str, str]:
    rows = [(cid, group, of[0], of[1]) for cid, (group, of) in keys.items()]
    table = small_table(graph.spark, rows, "rule string, consequent string, one string, two string")
    groups = table.select("rule", "consequent")
    by_body = table.where("consequent LIKE 'class:%'").join(members, F.col("one") == F.col("body")).select("rule", "n", "weight")
    by_class = table.where("consequent LIKE 'pred:%'").join(typed, F.col("one") == F.col("cls")).select("rule", "n", "weight")
    return {r["rule"]: r["covered_by"] for r in reduced_cover(by_body.unionByName(by_class), groups).collect()}


def detected(graph: Graph, cfg: SearchConfig) -> SearchConfig:
    """The configuration with the graph's own typing pair."""
    found = shapes.detect_vocabulary(graph)
    if found is None:
        raise ValueError("no typing vocabulary found")
    return replace(cfg, type_predicate=found.type_predicate, subclass_predicate=found.subclass_predicate)


def validates_clean(result: ShapeResult) -> bool:
    """Whether all rules survive writing and reading, and parse."""
    again = ConstraintSet.from_dict(result.rules.to_dict())
    return [in_fragment(c) for c in again] == list(result.rules) and all(isinstance(c.phi, ast.Node) for c in again)
