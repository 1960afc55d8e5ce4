"""Merging defaults, configuration, profile and query; checking and compiling the result."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from claimloom.functions import canonical, timestamps
from claimloom.operators import predicates
from claimloom.operators.predicates import PlanError
from claimloom.operators.walk import CYCLES, Options

TOP = {"profile", "@context", "about", "bounds", "walk", "filter", "return", "name"}
DEFAULTS = {"bounds": {"seed_limit": 2, "fanout_limit": 4, "max_claims": 16, "path_limit": 8}, "walk": {"direction": "outgoing"}, "return": {"claims": True, "paths": True, "evidence": False, "explain": False}}
RESERVED = ("meta", "path", "bound", "fn")
CAPS = ("seed_limit", "fanout_limit", "max_claims", "path_limit", "max_depth")
FIELD_KINDS = {name: kind for name, (kind, _) in predicates.FIELDS.items()} | {"lineage": "object", "ext": "object"}


def _invalid(message: str) -> PlanError:
    return PlanError("invalid", message)


def check_shape(value: dict) -> dict:
    """value, if it has only the known parts, in their forms."""

    def keys(part, allowed: set[str], what: str) -> None:
        if not isinstance(part, dict) or part.keys() - allowed:
            raise _invalid(what)

    keys(value, TOP, "unknown part of a query")
    for landing in value.get("about", []):
        keys(landing, {"from", "to", "match"}, "about")
        if not landing.get("from") or ("to" in landing and not landing["to"]):
            raise _invalid("about needs anchors")
    keys(value.get("bounds", {}), set(value.get("bounds", {})), "bounds")
    keys(value.get("walk", {}), {"direction", "predicates", "drop_predicates"}, "walk")
    keys(value.get("filter", {}), {"predicates", "drop_predicates"}, "filter")
    keys(value.get("return", {}), set(DEFAULTS["return"]), "return")
    for phase in ("walk", "filter"):
        for p in value.get(phase, {}).get("predicates", []):
            if isinstance(p, list):
                if len(p) != 3:
                    raise _invalid("a triple has three parts")
            elif "where" in p:
                keys(p, {"name", "where"}, "named triple")
            else:
                keys(p, {"name", "init", "bind", "let", "next", "keep"}, "program")
                if "keep" not in p:
                    raise _invalid("a program keeps something")
    return value


def _recurse(under: dict, over: dict) -> dict:
    out = dict(under)
    for k, v in over.items():
        out[k] = _recurse(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _predicates(under: list, phase: dict) -> list:
    """Inherited predicates without the dropped, with named ones replaced where they stand, and new ones after."""
    if phase.get("predicates") == []:
        return []
    dropped = set(phase.get("drop_predicates", []))
    out = [p for p in under if not (isinstance(p, dict) and p.get("name") in dropped)]
    places = {p["name"]: i for i, p in enumerate(out) if isinstance(p, dict) and "name" in p}
    for p in phase.get("predicates", []):
        name = p.get("name") if isinstance(p, dict) else None
        if name in places:
            out[places[name]] = p
        else:
            out.append(p)
    return out


def merge(*layers: dict) -> dict:
    """Layers from the most general to the query: objects recurse, other values replace, predicates merge by phase."""
    out: dict = {}
    for layer in layers:
        phases = {k: _predicates(out.get(k, {}).get("predicates", []), layer[k]) for k in ("walk", "filter") if k in layer}
        out = _recurse(out, {k: {a: b for a, b in v.items() if a not in ("predicates", "drop_predicates")} if k in phases else v for k, v in layer.items()})
        for k, found in phases.items():
            out[k] = out.get(k, {}) | {"predicates": found}
    return out


@dataclass
class Plan:
    query: dict
    blocks: list[dict]
    options: Options
    seed_limit: int
    returns: dict
    as_of: str | None
    programs: dict = field(default_factory=dict)
    notices: list[str] = field(default_factory=list)

    def digest(self) -> str:
        return canonical.digest({"query": self.query, "as_of": self.as_of}, "plan")


def expand(context: dict, text: str) -> str:
    """A compact identifier in full; a prefix that isn't declared is an error, other texts stay."""
    prefix, colon, rest = text.partition(":")
    if not colon or rest.startswith("//") or prefix in RESERVED:
        return text
    if prefix in context:
        return context[prefix] + rest
    if prefix.replace("_", "").replace("-", "").isalnum() and prefix[:1].isalpha() and len(prefix) < 20:
        raise _invalid(f"unknown prefix {prefix!r}")
    return text


def substitute(value, bounds: dict):
    """bound:name replaced by that bound, in lists too."""
    if isinstance(value, list):
        return [substitute(v, bounds) for v in value]
    if isinstance(value, str) and value.startswith("bound:"):
        if value[6:] not in bounds:
            raise _invalid(f"missing {value}")
        return bounds[value[6:]]
    return value


def _cap(bounds: dict, name: str) -> int | None:
    v = bounds.get(name)
    if v is None:
        if name == "max_depth":
            raise _invalid("max_depth is required")
        return None
    if isinstance(v, bool) or not isinstance(v, (int, Decimal)):
        raise _invalid(name)
    if v < 0 or v != int(v):
        raise PlanError("range", name)
    return int(v)


def check_triple(name: str, op: str, value, capabilities: frozenset[str]) -> None:
    """Static types: operators that exist, operands that the field's type allows."""
    if op not in predicates.OPERATORS:
        raise _invalid(f"unknown operator {op!r}")
    if op in predicates.ONTOLOGY and "ontology" not in capabilities:
        raise PlanError("unsupported", "prepared ontology required")
    path = name.startswith("path.meta:")
    bare = name.removeprefix("path.").removeprefix("meta:")
    if not name.startswith(("meta:", "path.meta:")) or (not bare.startswith("ext:") and bare not in FIELD_KINDS):
        raise _invalid(f"unknown field {name!r}")
    kind = "dynamic" if bare.startswith("ext:") else FIELD_KINDS[bare]
    operand = predicates.operand_kind(value)
    if op == "exists":
        if operand != "boolean":
            raise _invalid("exists takes a boolean")
        return
    if op in predicates.ONTOLOGY:
        if operand != "string" or bare not in predicates.IDENTIFIERS or op.startswith("contains") != path:
            raise _invalid(f"{op} on {name}")
        return
    if op in ("in", "not_in", "contains_any"):
        if operand != "list" or (op == "contains_any") != path:
            raise _invalid(f"{op} on {name}")
        kinds = {predicates.operand_kind(v) for v in value} - {"null"}
        if len(kinds) > 1:
            raise _invalid("mixed list")
        operands = kinds
    elif op == "contains":
        if operand == "list" or (not path and operand != "string"):
            raise _invalid("contains")
        operands = {operand}
    else:
        if path or operand == "list":
            raise _invalid(f"{op} on {name}")
        operands = {operand}
    if op in predicates.ORDERINGS and operands & {"null", "boolean"}:
        raise _invalid("ordering")
    want = {"number": "number", "string": "string", "timestamp": "string", "grounding": "string"}.get(kind)
    if want and operands - {want, "null"}:
        raise _invalid(f"{name} compared with {', '.join(operands)}")


def compile_query(query: dict, profile: dict | None = None, config: dict | None = None, capabilities: frozenset[str] = frozenset(), captured: str | None = None) -> Plan:
    """A checked plan.  capabilities: any of lexical, ontology, programs.

    captured: the time that a query without one of its own is as of; it is
    part of the plan, and so of its digest.
    """
    notices = []
    config = {k: v for k, v in (config or {}).get("defaults", {}).items()}
    check_shape(query)
    if "profile" in query:
        name = query["profile"]
        if name.startswith("/") or ".." in name.split("/") or "\\" in name:
            raise _invalid("profile name")
        if profile is None or profile.get("name", name) != name:
            raise _invalid("another profile was selected")
    if profile is not None:
        check_shape(profile)
        if "profile" in profile:
            raise PlanError("unsupported", "profiles don't chain")
        if "about" in profile:
            notices.append("ignored_profile_about")
    layer = {k: v for k, v in (profile or {}).items() if k not in ("about", "name")}
    merged = merge(DEFAULTS, config, layer, query)
    context = merged.get("@context", {})
    if any(p in RESERVED for p in context):
        raise _invalid("reserved prefix")
    bounds = merged["bounds"]
    caps = {name: _cap(bounds, name) for name in CAPS}
    blocks = []
    for landing in merged.get("about") or [_no_about()]:
        match = landing.get("match", "approximate")
        if match == "approximate" and "lexical" not in capabilities:
            raise PlanError("unsupported", "approximate landing")
        if match not in ("exact", "approximate"):
            raise _invalid("match")
        blocks.append({"match": match} | {side: [_anchor(context, a) for a in landing[side]] for side in ("from", "to") if side in landing})
    direction = merged["walk"].get("direction", "outgoing")
    if direction not in ("outgoing", "incoming", "both"):
        raise _invalid("direction")
    cycle = bounds.get("cycle_policy", CYCLES[0])
    if cycle not in CYCLES:
        raise _invalid("cycle policy")
    programs: dict = {"walk": [], "filter": []}
    triples: dict = {"walk": [], "filter": []}
    for phase in ("walk", "filter"):
        for p in merged.get(phase, {}).get("predicates", []):
            if isinstance(p, dict) and "keep" in p:
                if "programs" not in capabilities:
                    raise PlanError("unsupported", "custom predicate")
                programs[phase].append(p | {"bind": {k: (v if not v.startswith("bound:") else substitute(v, bounds)) for k, v in p.get("bind", {}).items()}})
                continue
            name, op, value = p if isinstance(p, list) else p["where"]
            value = substitute(value, bounds)
            bare = name.removeprefix("path.").removeprefix("meta:")
            if bare in ("relation", "subject_id", "object_id") or bare.endswith("_type"):
                value = [expand(context, v) if isinstance(v, str) else v for v in value] if isinstance(value, list) else expand(context, value) if isinstance(value, str) else value
            check_triple(name, op, value, capabilities)
            triples[phase].append((name, op, value))
    as_of = bounds.get("as_of", captured)
    if as_of is not None:
        as_of = timestamps.text(timestamps.parse(as_of))
    options = Options(caps["max_depth"], direction, caps["fanout_limit"], caps["max_claims"], caps["path_limit"], cycle, triples["walk"], triples["filter"])
    normal = {k: merged.get(k) for k in ("about", "bounds", "walk", "filter", "return")} | {"about": blocks}
    return Plan(normal, blocks, options, caps["seed_limit"], merged["return"], as_of, programs, notices)


def _no_about():
    raise _invalid("about is required")


def _anchor(context: dict, anchor) -> str:
    if not isinstance(anchor, str):
        raise _invalid("anchor")
    prefix = anchor.partition(":")[0]
    return expand(context, anchor) if prefix in context else anchor
