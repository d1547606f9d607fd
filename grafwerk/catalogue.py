"""Built-in rules."""

from __future__ import annotations

from pathlib import Path

from grafwerk.rules import BOUNDARY, CORE, REPORT, SUBSET, SUPERSET, Constraint, ConstraintSet

#: Typing pairs by source.
VOCABULARY = {"wikidata": ("wdt:P31", "wdt:P279"), "dbpedia": ("rdf:type", "rdfs:subClassOf"), "yago": ("rdf:type", "rdfs:subClassOf")}

#: Fixed values: (cid, kind, antecedent, consequent, direction) by domain and source.  A side is an
#: expression, or "tau C" for the class test of C.
RULES_V1 = {
    ("geography", "wikidata"): (
        ("geo.wd.dom.country", "existential_domain", "< down(wdt:P17) >", "tau wd:Q2221906", SUBSET),
        ("geo.wd.rng.country", "existential_range", "< up(wdt:P17) >", "tau wd:Q6256", SUBSET),
        ("geo.wd.type.city", "typing_existence", "< down(wdt:P17) > & < down(wdt:P131) >", "tau wd:Q515", SUPERSET),
        ("geo.wd.req.city_country", "requires_statement", "tau wd:Q515", "< down(wdt:P17) >", SUPERSET),
        ("geo.wd.sym.border", "symmetric", "< down(wdt:P47) >", "< up(wdt:P47) >", REPORT),
        ("geo.wd.inv.capital", "inverse", "< down(wdt:P36) >", "< up(wdt:P1376) >", REPORT),
        ("geo.wd.func.country", "functional", "< down(wdt:P17) >", "T", REPORT),
    ),
    ("geography", "dbpedia"): (
        ("geo.db.dom.country", "existential_domain", "< down(dbo:country) >", "tau dbo:Place", SUBSET),
        ("geo.db.rng.country", "existential_range", "< up(dbo:country) >", "tau dbo:Country", SUBSET),
        ("geo.db.type.settlement", "typing_existence", "< down(dbo:country) > & < down(dbo:location) >", "tau dbo:Settlement", SUPERSET),
        ("geo.db.sym.border", "symmetric", "< down(dbo:neighboringMunicipality) >", "< up(dbo:neighboringMunicipality) >", REPORT),
    ),
    ("geography", "yago"): (
        ("geo.yg.dom.containment", "existential_domain", "< down(schema:containedInPlace) >", "tau schema:Place", SUBSET),
        ("geo.yg.rng.containment", "existential_range", "< up(schema:containedInPlace) >", "tau schema:Place", SUBSET),
        ("geo.yg.req.country", "requires_statement", "tau schema:City", "< down(schema:containedInPlace) >", SUPERSET),
    ),
    ("taxa", "wikidata"): (
        ("tax.wd.inherit.taxon", "typing_inheritance", "tau wd:Q16521", '< down(wdt:P31) . [val("wd:Q16521")] >', SUPERSET),
        ("tax.wd.dom.parent", "existential_domain", "< down(wdt:P171) >", "tau wd:Q16521", SUBSET),
        ("tax.wd.rng.parent", "existential_range", "< up(wdt:P171) >", "tau wd:Q16521", SUBSET),
        ("tax.wd.req.rank", "requires_statement", "tau wd:Q16521", "< down(wdt:P105) >", SUPERSET),
        ("tax.wd.func.parent", "functional", "< down(wdt:P171) >", "T", REPORT),
    ),
    ("taxa", "dbpedia"): (
        ("tax.db.dom.genus", "existential_domain", "< down(dbo:genus) >", "tau dbo:Species", SUBSET),
        ("tax.db.type.species", "typing_existence", "< down(dbo:genus) > & < down(dbo:family) >", "tau dbo:Species", SUPERSET),
    ),
    ("taxa", "yago"): (
        ("tax.yg.inherit.taxon", "typing_inheritance", "tau schema:Taxon", '< down(rdf:type) . [val("schema:Taxon")] >', SUPERSET),
    ),
    ("anatomy", "wikidata"): (
        ("ana.wd.dom.partof", "existential_domain", "< down(wdt:P361) >", "tau wd:Q4936952", SUBSET),
        ("ana.wd.rng.partof", "existential_range", "< up(wdt:P361) >", "tau wd:Q4936952", SUBSET),
        ("ana.wd.inv.part_haspart", "inverse", "< down(wdt:P361) >", "< up(wdt:P527) >", REPORT),
    ),
    ("disease", "wikidata"): (
        ("dis.wd.dom.symptom", "existential_domain", "< down(wdt:P780) >", "tau wd:Q12136", SUBSET),
        ("dis.wd.req.cause_or_symptom", "requires_statement", "tau wd:Q12136", "< down(wdt:P780) > | < down(wdt:P828) >", SUPERSET),
        ("dis.wd.safety.treatedby", "safety_edge", "< down(wdt:P2176) >", "T", REPORT),
    ),
    ("medication", "wikidata"): (
        ("med.wd.dom.treats", "existential_domain", "< down(wdt:P2175) >", "tau wd:Q12140", SUBSET),
        ("med.wd.rng.treats", "existential_range", "< up(wdt:P2175) >", "tau wd:Q12136", SUBSET),
        ("med.wd.req.route", "requires_statement", "tau wd:Q12140", "< down(wdt:P636) >", SUPERSET),
        ("med.wd.safety.interaction", "safety_edge", "< down(wdt:P769) >", "< up(wdt:P769) >", REPORT),
    ),
}

#: Classes of classes that widen a class test in version 2.
META_CLASSES = {
    "wd:Q4936952": ("wd:Q112826905", "wd:Q103812529", "wd:Q104027169", "wd:Q103914748", "wd:Q113147985", "wd:Q139550381", "wd:Q103843042"),
    "wd:Q12136": ("wd:Q112193867",),
    "wd:Q12140": ("wd:Q113145171", "wd:Q119892838", "wd:Q59199015"),
}

#: Rules of version 2; "tau+ C" is the widened class test.
RULES_V2 = {
    ("anatomy", "wikidata"): (
        ("ana.wd.dom.partof.v2", "existential_domain", "< down(wdt:P361) . [tau+ wd:Q4936952] >", "tau+ wd:Q4936952", SUBSET),
        ("ana.wd.rng.partof.v2", "existential_range", "< up(wdt:P361) . [tau+ wd:Q4936952] >", "tau+ wd:Q4936952", SUBSET),
    ),
    ("disease", "wikidata"): (
        ("dis.wd.dom.symptom.v2", "existential_domain", "< down(wdt:P780) >", "tau+ wd:Q12136", SUBSET),
        ("dis.wd.req.cause_or_symptom.v2", "requires_statement", "tau+ wd:Q12136", "< down(wdt:P780) > | < down(wdt:P828) >", SUPERSET),
    ),
    ("medication", "wikidata"): (
        ("med.wd.dom.treats.v2", "existential_domain", "< down(wdt:P2175) >", "tau+ wd:Q12140", SUBSET),
        ("med.wd.rng.treats.v2", "existential_range", "< up(wdt:P2175) >", "tau+ wd:Q12136", SUBSET),
        ("med.wd.req.route.v2", "requires_statement", "tau+ wd:Q12140", "< down(wdt:P636) >", SUPERSET),
    ),
}


def tau(kg: str, value: str) -> str:
    """The class test of ``value`` in a source's typing pair."""
    of, below = VOCABULARY[kg]
    return f'< down({of}) . down({below})* . [val("{value}")] >'


def widened(kg: str, value: str) -> str:
    return " | ".join([tau(kg, value), *(f'< down({VOCABULARY[kg][0]}) . [val("{c}")] >' for c in META_CLASSES[value])])


def _side(kg: str, text: str) -> str:
    if text.startswith("tau "):
        return tau(kg, text[4:])
    if "tau+ " in text:
        before, _, rest = text.partition("tau+ ")
        value, end = (rest.split("]")[0], "]" + rest.split("]", 1)[1]) if "]" in rest else (rest, "")
        return before + widened(kg, value) + end
    return text


#: Where rules come from, if not given by the source; a rule of version 2 as its model of version 1.
COMPILED = (
    "geo.wd.dom.country", "geo.wd.rng.country", "tax.wd.inherit.taxon", "tax.wd.dom.parent", "tax.wd.rng.parent", "tax.yg.inherit.taxon",
    "ana.wd.dom.partof", "ana.wd.rng.partof", "dis.wd.dom.symptom", "med.wd.dom.treats", "med.wd.rng.treats",
)
#: Derived rules with the slice that they were derived from, at this threshold.
THRESHOLD = "0.98"
DERIVED_FROM = {
    "geo.wd.type.city": "clean-wikidata-city-slice",
    "geo.db.type.settlement": "clean-dbpedia-place-slice",
    "tax.db.type.species": "clean-dbpedia-species-slice",
    "dis.wd.req.cause_or_symptom": "clean-wikidata-disease-slice",
    "med.wd.req.route": "clean-wikidata-med-slice",
}
#: What a rule of a kind says.
NOTES = {
    "existential_domain": "Whatever has the edge is of the class.",
    "existential_range": "Whatever the edge ends in is of the class.",
    "typing_existence": "Whatever has these edges is of the class.",
    "typing_inheritance": "Members of a class below are typed as the class itself.",
    "requires_statement": "Members of the class have the edge.",
    "symmetric": "The edge goes both ways; only reported.",
    "inverse": "The edge has an inverse; only reported.",
    "functional": "There is one value at most; only reported.",
    "safety_edge": "The edge concerns safety; only reported, in aggregate.",
}


def _origin(cid: str, kind: str, version: int) -> dict:
    model = cid.removesuffix(".v2")
    params = {"baseline_cid": model} if version > 1 else {}
    if kind == "safety_edge":
        params["reporting"] = "aggregate_only"
    if model in DERIVED_FROM:
        return {"provenance": "derived", "params": params | {"threshold": THRESHOLD, "reference": DERIVED_FROM[model]}}
    return {"provenance": "compiled" if model in COMPILED else "given", "params": params}


def _rules(domain: str, kg: str, rows: tuple, version: int) -> list[Constraint]:
    return [
        Constraint(cid, _side(kg, phi), _side(kg, psi), domain, kg, kind, BOUNDARY if direction == REPORT else CORE, direction=direction, note=NOTES.get(kind, ""), version=version, **_origin(cid, kind, version))
        for cid, kind, phi, psi, direction in rows
    ]


def registry(version: int = 1) -> dict[tuple[str, str], ConstraintSet]:
    """All built-in sets; version 2 replaces some and keeps their boundary rules."""
    found = {key: ConstraintSet(f"{key[0]}@{key[1]}", _rules(*key, rows, 1)) for key, rows in RULES_V1.items()}
    if version >= 2:
        for key, rows in RULES_V2.items():
            found[key] = ConstraintSet(f"{key[0]}@{key[1]}.v2", [*_rules(*key, rows, 2), *found[key].boundary()])
    return found


def get(domain: str, kg: str, version: int = 1) -> ConstraintSet:
    try:
        return registry(version)[domain, kg]
    except KeyError:
        raise KeyError(f"no built-in rules for {domain}/{kg}") from None


def compile_all(version: int = 1) -> int:
    """Parses every built-in rule; the number of rules."""
    return sum(len(s.compile_all()) for s in registry(version).values())


def export_json(folder: str | Path) -> list[Path]:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for (domain, kg), rules in sorted(registry().items()):
        out.append(folder / f"{domain}_{kg}.json")
        rules.to_file(out[-1])
    return out


def synthetic_rules() -> ConstraintSet:
    """Four rules for the generated graphs."""
    of, below = "rdf:type", "rdfs:subClassOf"
    cls = lambda c: f'< down({of}) . down({below})* . [val("{c}")] >'
    rows = (
        ("syn.dom.country", "existential_domain", "< down(syn:country) >", cls("syn:Place"), SUBSET),
        ("syn.rng.country", "existential_range", "< up(syn:country) >", cls("syn:Country"), SUBSET),
        ("syn.type.city", "typing_existence", "< down(syn:country) > & < down(syn:locatedIn) >", cls("syn:City"), SUPERSET),
        ("syn.req.city_country", "requires_statement", cls("syn:City"), "< down(syn:country) >", SUPERSET),
    )
    return ConstraintSet("synthetic", [Constraint(cid, phi, psi, "synthetic", "synthetic", kind, direction=d) for cid, kind, phi, psi, d in rows]).compile_all()
