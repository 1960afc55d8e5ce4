"""The predicate algebra: value, null and missing are three different things.

A lane is a field of a row as columns: its value, whether the field is present
(a present null is not missing), and whether it is null.  ``test`` gives a
boolean column that is never null.  Operands whose type can't be compared with
the field's are errors: for fixed fields when the plan is made, for fields of
open metadata when a row is reached.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.sources.star import TIERS

OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "in", "not_in", "contains", "contains_any", "exists", "isa", "not_isa", "subproperty_of", "not_subproperty_of", "contains_isa", "contains_subproperty_of")
ORDERINGS = (">", ">=", "<", "<=")
#: Operators that ask an ontology -> which of its closures.
ONTOLOGY = {"isa": "class", "not_isa": "class", "contains_isa": "class", "subproperty_of": "property", "not_subproperty_of": "property", "contains_subproperty_of": "property"}
#: Fields that name a class or property.
IDENTIFIERS = ("subject_id", "object_id", "relation", "relation_type", "subject_type", "object_type")


class PlanError(ValueError):
    """A query that can't be run; ``kind`` is invalid, unsupported, range, limit or denied."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass
class Lane:
    kind: str  # number, string, timestamp, grounding, boolean, dynamic
    value: Column
    present: Column
    null: Column

    @staticmethod
    def of(kind: str, value: Column) -> Lane:
        """A fixed field: SQL null is an absent value."""
        return Lane(kind, value, value.isNotNull(), F.lit(False))

    @staticmethod
    def json(document: Column, key: str) -> Lane:
        """A field of a VARIANT object, by its exact key."""
        quoted = key.replace("\\", "\\\\").replace("'", "\\'")
        got = F.variant_get(document, f"$['{quoted}']", "variant")
        null = F.coalesce(F.is_variant_null(got), F.lit(False))
        return Lane("dynamic", got, got.isNotNull(), null)


@dataclass
class ListLane:
    """An ordered list of elements (structs of v, present, null), as a path gives it."""

    kind: str
    elements: Column

    @staticmethod
    def over(steps: Column, lane) -> ListLane:
        """lane(step) for each step."""
        first: list[str] = []

        def one(step: Column) -> Column:
            got = lane(step)
            first.append(got.kind)
            return F.struct(got.value.alias("v"), got.present.alias("present"), got.null.alias("null"))

        return ListLane(kind="", elements=F.transform(steps, one)).named(first)

    def named(self, kinds: list[str]) -> ListLane:
        self.kind = kinds[0]
        return self


def operand_kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, Decimal)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (list, tuple)):
        return "list"
    raise PlanError("invalid", f"operand {value!r}")


def _literal(kind: str, value) -> Column:
    """value as a literal comparable with a lane of that kind."""
    own = operand_kind(value)
    if kind == "grounding":
        if value not in TIERS:
            raise PlanError("invalid", f"grounding {value!r}")
        return F.lit(TIERS.index(value))
    if kind == "timestamp":
        if own != "string":
            raise PlanError("invalid", "incompatible predicate types")
        return F.lit(value).cast("timestamp")
    if own != kind or kind in ("null", "list"):
        raise PlanError("invalid", "incompatible predicate types")
    return F.lit(value if kind != "number" else Decimal(value))


def _mismatch() -> Column:
    return F.raise_error(F.lit("incompatible predicate types")).cast("boolean")


def _equal(kind: str, v: Column, null: Column, value) -> Column:
    """v = value where present; null equals null alone; a type mismatch raises."""
    if value is None:
        return null
    if kind != "dynamic":
        return F.when(null, F.lit(False)).otherwise(F.coalesce(v == _literal(kind, value), F.lit(False)))
    return F.when(null, F.lit(False)).otherwise(_dynamic(v, value, lambda a, b: a == b))


#: How open metadata is read for an operand's type.
_AS = {"number": "decimal(38,18)", "string": "string", "boolean": "boolean"}


def _dynamic(v: Column, value, compare) -> Column:
    own = operand_kind(value)
    if own not in _AS:
        raise PlanError("invalid", "incompatible predicate types")
    shape = F.schema_of_variant(v)
    fits = {"number": shape.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL.*|DOUBLE|FLOAT)$"), "string": shape == "STRING", "boolean": shape == "BOOLEAN"}[own]
    return F.when(fits, compare(F.try_variant_get(v, "$", _AS[own]), _literal(own, value))).otherwise(_mismatch())


def _check_list(values) -> None:
    kinds = {operand_kind(v) for v in values} - {"null"}
    if len(kinds) > 1 or "list" in kinds:
        raise PlanError("invalid", "mixed list")


def test(op: str, lane: Lane | ListLane, value) -> Column:
    """The outcome of ``lane op value`` as a boolean column."""
    if op not in OPERATORS:
        raise PlanError("invalid", f"unknown operator {op!r}")
    if op in ONTOLOGY:
        raise PlanError("unsupported", "an ontology is asked by a join (see below), not by an expression")
    if op == "exists":
        if not isinstance(value, bool):
            raise PlanError("invalid", "exists takes a boolean")
        present = F.lit(True) if isinstance(lane, ListLane) else lane.present
        return present == F.lit(value)
    if isinstance(lane, ListLane):
        return _test_list(op, lane, value)
    if op == "=":
        out = _equal(lane.kind, lane.value, lane.null, value)
    elif op == "!=":
        out = ~_equal(lane.kind, lane.value, lane.null, value)
    elif op in ORDERINGS:
        if operand_kind(value) in ("null", "boolean", "list") or lane.kind == "boolean":
            raise PlanError("invalid", "ordering needs numbers, strings, times or groundings")
        compare = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[op]
        ordered = _dynamic(lane.value, value, compare) if lane.kind == "dynamic" else compare(lane.value, _literal(lane.kind, value))
        out = F.when(lane.null, F.raise_error(F.lit("null ordering")).cast("boolean")).otherwise(ordered)
    elif op in ("in", "not_in"):
        if operand_kind(value) != "list":
            raise PlanError("invalid", "membership takes a list")
        _check_list(value)
        hit = F.lit(False)
        for item in value:  # every element is compared, also after a hit
            hit = hit | _equal(lane.kind, lane.value, lane.null, item)
        out = hit if op == "in" else ~hit
    elif op == "contains":
        if operand_kind(value) != "string" or lane.kind not in ("string", "dynamic"):
            raise PlanError("invalid", "contains takes strings, or a list and a scalar")
        found = _dynamic(lane.value, value, lambda a, b: F.contains(a, b)) if lane.kind == "dynamic" else F.contains(lane.value, F.lit(value))
        out = F.when(lane.null, _mismatch()).otherwise(found)
    else:
        raise PlanError("invalid", "contains_any takes lists")
    return F.when(lane.present, F.coalesce(out, F.lit(False))).otherwise(F.lit(False))


def _test_list(op: str, lane: ListLane, value) -> Column:
    def has(item) -> Column:
        hits = F.transform(lane.elements, lambda e: F.when(e["present"], _equal(lane.kind, e["v"], e["null"], item)).otherwise(F.lit(False)))
        return F.aggregate(hits, F.lit(False), lambda a, b: a | b)

    if op == "contains":
        if operand_kind(value) == "list":
            raise PlanError("invalid", "contains takes a scalar")
        return has(value)
    if op == "contains_any":
        if operand_kind(value) != "list":
            raise PlanError("invalid", "contains_any takes lists")
        _check_list(value)
        out = F.lit(False)
        for item in value:
            out = out | has(item)
        return out
    raise PlanError("invalid", f"a list can't be the left of {op}")


#: Fixed fields of a claim: name -> (kind, column of a step).
FIELDS = {
    "claim_id": ("string", "claim_id"),
    "subject_id": ("string", "subject_id"),
    "object_id": ("string", "object_id"),
    "relation": ("string", "relation"),
    "confidence": ("number", "confidence"),
    "depth": ("number", "depth"),
    "transaction_time": ("timestamp", "transaction_time"),
    "grounding_level": ("grounding", "grounding"),
    "lifecycle_state": ("string", "lifecycle_state"),
    "relation_type": ("string", "relation_type"),
    "subject_type": ("string", "subject_type"),
    "object_type": ("string", "object_type"),
    "claim_type": ("string", "claim_type"),
}


def field(name: str, row) -> Lane:
    """The lane of ``claim_id``, ``ext:key`` and so on of a row; row maps a column name to a Column."""
    if name.startswith("ext:"):
        return Lane.json(row("ext"), name[4:])
    if name not in FIELDS:
        raise PlanError("invalid", f"unknown field {name!r}")
    kind, column = FIELDS[name]
    return Lane.of(kind, row(column))


def column_of(name: str) -> str:
    """The column of an identifier field, of a claim or a path."""
    bare = name.removeprefix("path.").removeprefix("meta:")
    if bare not in IDENTIFIERS:
        raise PlanError("invalid", f"{name!r} names no class or property")
    return FIELDS[bare][1]


def below(ontology: dict[str, DataFrame], op: str, target: str) -> DataFrame:
    """(term): the target and what the closure (term, ancestor) that op asks puts below it."""
    kind = ONTOLOGY[op]
    if kind not in ontology:
        raise PlanError("unsupported", "prepared ontology required")
    terms = ontology[kind].where(F.col("ancestor") == target).select("term")
    return terms.unionByName(terms.sparkSession.createDataFrame([(target,)], "term string")).distinct()


def conjunction(parts: list[Column]) -> Column:
    """Parts tested in order; a later one isn't evaluated for rows that an earlier one fails."""
    out = F.lit(True)
    for p in reversed(parts):
        out = F.when(p, out).otherwise(F.lit(False))
    return out
