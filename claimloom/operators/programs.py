"""Custom predicates: small programs with state along a path, compiled to columns.

``{init, bind, let, next, keep}``: bind names fields or bounds, let names
expressions in dependency order, next gives the state that children start from
(computed from the old state), and keep decides.  Expressions are literals,
names, ``state.name``, arithmetic, comparisons, ``&& || !``, ``if a {b} else
{c}`` as ``a ? b : c``, parentheses and calls of min, max, abs and exists.
Nothing is evaluated as Python.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators import predicates
from claimloom.operators.predicates import PlanError

_TOKEN = re.compile(r'\s*(?:(\d+(?:\.\d+)?)|("(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(&&|\|\||==|!=|>=|<=|[-+*/%<>!?:().,]))')
#: Binary operators from the loosest to the tightest.
_LEVELS = (("||",), ("&&",), ("==", "!="), (">", ">=", "<", "<="), ("+", "-"), ("*", "/", "%"))
NUMBER = "decimal(38,12)"
#: What one program may take: operations (those of a let counting wherever it is used), nesting, calls, bytes of its first state.
LIMITS = {"operations": 100_000, "depth": 32, "calls": 1024, "state": 64 * 1024}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PlanError("invalid", f"expression at {text[at:]!r}")
        kind = next(i for i in range(1, 5) if m[i] is not None)
        out.append((("number", "string", "name", "op")[kind - 1], m[kind]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.left, self.at = tokens(text), 0

    def peek(self) -> str | None:
        return self.left[self.at][1] if self.at < len(self.left) else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.left) or (want is not None and self.left[self.at][1] != want):
            raise PlanError("invalid", f"expected {want or 'more'}")
        self.at += 1
        return self.left[self.at - 1]

    def whole(self):
        out = self.choice()
        if self.peek() is not None:
            raise PlanError("invalid", f"unexpected {self.peek()!r}")
        return out

    def choice(self):
        test = self.binary(0)
        if self.peek() != "?":
            return test
        self.take()
        yes = self.choice()
        self.take(":")
        return ("?", test, yes, self.choice())

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.unary()
        out = self.binary(level + 1)
        while self.peek() in _LEVELS[level] and self.left[self.at][0] == "op":
            op = self.take()[1]
            out = (op, out, self.binary(level + 1))
        return out

    def unary(self):
        if self.peek() in ("!", "-") and self.left[self.at][0] == "op":
            return ("not" if self.take()[1] == "!" else "neg", self.unary())
        kind, text = self.take()
        if kind == "number":
            return ("lit", Decimal(text))
        if kind == "string":
            import json

            return ("lit", json.loads(text))
        if text == "(":
            out = self.choice()
            self.take(")")
            return out
        if kind != "name":
            raise PlanError("invalid", f"unexpected {text!r}")
        if text in ("true", "false"):
            return ("lit", text == "true")
        if self.peek() == "(":
            self.take()
            args = []
            while self.peek() != ")":
                args.append(self.choice())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return ("call", text, args)
        while self.peek() == ".":
            self.take()
            text += "." + self.take()[1]
        return ("name", text)


def parse(text: str):
    return _Parser(text).whole()


def names(tree) -> set[str]:
    if tree[0] == "name":
        return {tree[1]}
    parts = tree[2] if tree[0] == "call" else tree[1:] if tree[0] != "lit" else ()
    return set().union(*(names(t) for t in parts if isinstance(t, tuple)))


def measure(tree, lets: dict[str, tuple[int, int]] | None = None, at: int = 1) -> tuple[int, int, int]:
    """(operations, depth, calls) of an expression; lets: (operations, calls) of the names that stand for expressions."""
    if at > LIMITS["depth"]:
        raise PlanError("limit", "depth of a program")
    if tree[0] == "lit":
        return 1, 1, 0
    if tree[0] == "name":
        operations, calls = (lets or {}).get(tree[1], (1, 0))
        return operations, 1, calls
    parts = [measure(t, lets, at + 1) for t in (tree[2] if tree[0] == "call" else tree[1:])]
    return 1 + sum(p[0] for p in parts), 1 + max((p[1] for p in parts), default=0), (tree[0] == "call") + sum(p[2] for p in parts)


def column(tree, scope: dict[str, Column]) -> Column:
    kind = tree[0]
    if kind == "lit":
        return F.lit(tree[1]).cast(NUMBER) if isinstance(tree[1], Decimal) else F.lit(tree[1])
    if kind == "name":
        if tree[1] not in scope:
            raise PlanError("invalid", f"unknown name {tree[1]!r}")
        return scope[tree[1]]
    args = [column(t, scope) for t in (tree[2] if kind == "call" else tree[1:])]
    if kind == "call":
        calls = {"min": F.least, "max": F.greatest, "abs": F.abs, "exists": lambda c: c.isNotNull()}
        if tree[1] not in calls:
            raise PlanError("unsupported", f"function {tree[1]!r}")
        return calls[tree[1]](*args)
    one = {"not": lambda a: ~a, "neg": lambda a: -a}
    two = {
        "||": lambda a, b: a | b,
        "&&": lambda a, b: a & b,
        "==": lambda a, b: a == b,
        "!=": lambda a, b: a != b,
        ">": lambda a, b: a > b,
        ">=": lambda a, b: a >= b,
        "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b,
        "+": lambda a, b: (a + b).cast(NUMBER),
        "-": lambda a, b: (a - b).cast(NUMBER),
        "*": lambda a, b: (a * b).cast(NUMBER),
        "/": lambda a, b: (a / b).cast(NUMBER),
        "%": lambda a, b: (a % b).cast(NUMBER),
    }
    if kind == "?":
        return F.when(args[0], args[1]).otherwise(args[2])
    return one[kind](*args) if kind in one else two[kind](*args)


class Program:
    """A compiled program; its state is columns named after ``label``."""

    def __init__(self, spec: dict, label: str):
        self.label, self.init = label, spec.get("init", {})
        self.bind, self.keep = spec.get("bind", {}), parse(spec["keep"])
        self.next = {k: parse(v) for k, v in spec.get("next", {}).items()}
        if self.next.keys() - self.init.keys():
            raise PlanError("invalid", "next sets state that init doesn't")
        lets = {k: parse(v) for k, v in spec.get("let", {}).items()}
        self.lets: dict = {}
        while lets:
            ready = [k for k, t in lets.items() if not names(t) & lets.keys()]
            if not ready:
                raise PlanError("invalid", "lets depend on each other")
            for k in ready:
                self.lets[k] = lets.pop(k)
        self.columns = [f"{label}_{k}" for k in self.init]
        self._check_limits()

    def _check_limits(self) -> None:
        """Refuse a program that is too large, before any of it is made into columns."""
        held: dict[str, tuple[int, int]] = {}
        used = {"operations": 0, "depth": 0, "calls": 0, "state": sum(len(str(k).encode()) + len(str(v).encode()) for k, v in self.init.items())}
        for name, tree in [*self.lets.items(), *self.next.items(), ("", self.keep)]:
            operations, depth, calls = measure(tree, held)
            if name in self.lets:
                held[name] = (operations, calls)
            used |= {"operations": used["operations"] + operations, "depth": max(used["depth"], depth), "calls": used["calls"] + calls}
        for what, most in LIMITS.items():
            if used[what] > most:
                raise PlanError("limit", f"{what} of a program")

    def _literal(self, value) -> Column:
        return F.lit(value).cast(NUMBER) if isinstance(value, (int, Decimal)) and not isinstance(value, bool) else F.lit(value)

    def state(self):
        """A function that gives paths their first state, for walk."""
        return (lambda df: df.withColumns({f"{self.label}_{k}": self._literal(v) for k, v in self.init.items()}) if self.init else df), None, None

    def _scope(self, row, state) -> dict[str, Column]:
        scope = {f"state.{k}": state(k) for k in self.init}
        for name, source in self.bind.items():
            if isinstance(source, str) and source.startswith("meta:"):
                lane = predicates.field(source[5:], row)
                scope[name] = lane.value.cast(NUMBER) if lane.kind == "number" else F.try_variant_get(lane.value, "$", "decimal(38,12)") if lane.kind == "dynamic" else lane.value
            else:
                scope[name] = self._literal(source)
        for name, tree in self.lets.items():
            scope[name] = column(tree, scope)
        return scope

    def step(self, found: DataFrame) -> tuple[DataFrame, Column]:
        """Candidates with their next state, and whether they are kept."""
        scope = self._scope(lambda n: F.col("c_" + n), lambda k: F.col(f"{self.label}_{k}"))
        keep = F.coalesce(column(self.keep, scope), F.lit(False))
        flag = f"_keep_{self.label}"
        found = found.withColumn(flag, keep)
        new = {f"{self.label}_{k}": column(t, scope).cast(found.schema[f"{self.label}_{k}"].dataType) for k, t in self.next.items()}
        return (found.withColumns(new) if new else found), F.col(flag)

    def over_paths(self, paths: DataFrame) -> DataFrame:
        """Paths of which some claim is kept, each claim from a fresh state."""
        def kept(step: Column) -> Column:
            return F.coalesce(column(self.keep, self._scope(lambda n: step[n], lambda k: self._literal(self.init[k]))), F.lit(False))

        return paths.where(F.exists("steps", kept))
