"""Raw ``expr:`` conditions: a subset of the Common Expression Language as columns.

An expression that cannot be worked out for a row (a value is absent, a type does not fit) is
null there, ``&&`` and ``||`` pass over a null that the other side decides, and the condition as
a whole counts null as false. A fault that is already clear from the types (a number field
is a double, so adding an integer to it has no meaning) makes the condition false with a warning.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, functions as F

from tidewell.functions import text as tx
from tidewell.functions.values import duration, parse_date

_TOKEN = re.compile(
    r"""\s*(?:(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>0x[0-9a-fA-F]+|\d+)u?|(?P<str>r?"(?:\\.|[^"\\])*"|r?'(?:\\.|[^'\\])*')
    |(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%!<>?:.,()\[\]{}]))""",
    re.X,
)
MAX_NODES = 2_000


class ExpressionError(ValueError):
    pass


@dataclass
class Value:
    """A typed column: kind is one of int double string bool timestamp duration list null dyn."""

    kind: str
    build: Callable[[], Column]
    constant: Any = None
    items: list[Value] | None = None


@dataclass
class Scope:
    """What names stand for: ``lead.x`` and ``company.x`` give (kind, column builder) or None."""

    lead: Callable[[str], tuple[str, Callable[[], Column]] | None]
    company: Callable[[str], tuple[str, Callable[[], Column]] | None]
    detector: Callable[[str], Callable[[], Column] | None]
    settings: dict[str, Any] = field(default_factory=dict)
    lead_visible: bool = True
    unicode: bool = True


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected character {source[at:].strip()[0]!r}")
        kind = m.lastgroup
        out.append((kind, m.group(kind)))
        at = m.end()
    return [*out, ("end", "")]


def _unquote(s: str) -> str:
    if s[0] == "r":
        return s[2:-1]
    known = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'", "`": "`", "?": "?", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
    return re.sub(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}|.)", lambda m: known.get(m[1]) or chr(int(m[1][1:], 16)), s[1:-1])


class Parser:
    """Precedence climbing straight to typed columns."""

    LEVELS = (("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-"), ("*", "/", "%"))

    def __init__(self, source: str, scope: Scope):
        self.t, self.at, self.scope, self.nodes = tokens(source), 0, scope, 0
        self.locals: list[dict[str, Value]] = []
        self.warnings: list[str] = []

    # -- tokens
    def peek(self) -> str:
        return self.t[self.at][1] if self.t[self.at][0] in ("op", "name") else ""

    def next(self) -> tuple[str, str]:
        self.at += 1
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise ExpressionError("the expression is too long")
        return self.t[self.at - 1]

    def take(self, op: str) -> None:
        if self.peek() != op:
            raise ExpressionError(f"expected {op!r} before {self.t[self.at][1]!r}")
        self.next()

    # -- grammar
    def whole(self) -> Value:
        v = self.ternary()
        if self.t[self.at][0] != "end":
            raise ExpressionError(f"unexpected {self.t[self.at][1]!r}")
        return v

    def ternary(self) -> Value:
        c = self.binary(0)
        if self.peek() != "?":
            return c
        self.next()
        a = self.ternary()
        self.take(":")
        b = self.ternary()
        kind = a.kind if a.kind == b.kind else "dyn"
        if kind == "dyn":
            return self.fault("the two results differ in type")
        return Value(kind, lambda: F.when(_bool(c).build(), a.build()).when(~_bool(c).build(), b.build()))

    def binary(self, level: int) -> Value:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in self.LEVELS[level]:
            op = self.next()[1]
            left = self.apply(op, left, self.binary(level + 1))
        return left

    def unary(self) -> Value:
        if self.peek() == "!":
            self.next()
            v = _bool(self.unary())
            return Value("bool", lambda: ~v.build())
        if self.peek() == "-":
            self.next()
            v = self.unary()
            if v.kind not in ("int", "double"):
                return self.fault("- needs a number")
            return Value(v.kind, lambda: -v.build(), -v.constant if v.constant is not None else None)
        return self.member(self.primary())

    def primary(self) -> Value:
        kind, s = self.next()
        if kind == "int":
            n = int(s, 0)
            return Value("int", lambda: F.lit(n).cast("long"), n)
        if kind == "float":
            return Value("double", lambda: F.lit(float(s)), float(s))
        if kind == "str":
            c = _unquote(s)
            return Value("string", lambda: F.lit(c), c)
        if s == "(":
            v = self.ternary()
            self.take(")")
            return v
        if s == "[":
            return self.listing()
        if kind == "name":
            return self.name(s)
        raise ExpressionError(f"unexpected {s!r}")

    def listing(self) -> Value:
        items = []
        while self.peek() != "]":
            items.append(self.ternary())
            if self.peek() == ",":
                self.next()
        self.take("]")
        return _list(items)

    def name(self, s: str) -> Value:
        if s in ("true", "false"):
            return Value("bool", lambda: F.lit(s == "true"), s == "true")
        if s == "null":
            return Value("null", lambda: F.lit(None), None)
        for frame in reversed(self.locals):
            if s in frame:
                return frame[s]
        if s in ("lead", "company", "detector", "settings"):
            if s == "lead" and not self.scope.lead_visible:
                raise ExpressionError("a company-level condition has no lead")
            return self.entry(s)
        if s == "status":
            if not self.scope.lead_visible:
                raise ExpressionError("a company-level condition has no status")
            return Value("string", lambda: F.col("status"))
        if self.peek() == "(":
            return self.call(s)
        raise ExpressionError(f"undeclared name {s!r}")

    def entry(self, base: str) -> Value:
        """``base.x`` or ``base["x"]``."""
        op = self.peek()
        if op == ".":
            self.next()
            key = self.next()[1]
        elif op == "[":
            self.next()
            kind, raw = self.next()
            if kind != "str":
                raise ExpressionError(f"{base}[...] needs a literal name")
            key = _unquote(raw)
            self.take("]")
        else:
            return Value("map:" + base, lambda: F.lit(None))
        return self.value_of(base, key)

    def value_of(self, base: str, key: str) -> Value:
        if base == "settings":
            if key not in self.scope.settings:
                raise ExpressionError(f"setting {key} is not declared under settings")
            return _constant(self.scope.settings[key])
        if base == "detector":
            d = self.scope.detector(key)
            if d is None:
                raise ExpressionError(f"detector {key} is not declared under detectors")
            return Value("bool", d)
        found = (self.scope.lead if base == "lead" else self.scope.company)(key)
        if found is None:
            raise ExpressionError(f"{base}.{key} is not known")
        kind, build = found
        return Value({"number": "double", "date": "timestamp", "bool": "bool"}.get(kind, "string"), build)

    def member(self, v: Value) -> Value:
        while self.peek() in (".", "["):
            if self.next()[1] == "[":
                i = self.ternary()
                self.take("]")
                if v.kind != "list" or i.kind != "int":
                    v = self.fault("[ ] needs a list and an integer")
                else:
                    inner, at = v, i
                    v = Value(_element(inner), lambda inner=inner, at=at: F.when(at.build() >= 0, F.try_element_at(inner.build(), (at.build() + 1).cast("int"))))
            else:
                v = self.method(v, self.next()[1])
        return v

    def args(self) -> list[Value]:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.ternary())
            if self.peek() == ",":
                self.next()
        self.take(")")
        return out

    def method(self, v: Value, name: str) -> Value:
        if name in ("all", "exists", "exists_one", "filter", "map"):
            return self.macro(v, name)
        a = self.args()
        if name == "size" and v.kind in ("string", "list"):
            return Value("int", lambda: (F.length(v.build()) if v.kind == "string" else F.size(v.build())).cast("long"))
        tests = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith, "matches": F.rlike}
        if name in tests and len(a) == 1:
            if v.kind != "string" or a[0].kind != "string":
                return self.fault(f"{name} needs text")
            return Value("bool", lambda: tests[name](v.build(), a[0].build()))
        if name in _DATE_PARTS:
            if v.kind != "timestamp":
                return self.fault(f"{name} needs a time")
            return Value("int", lambda: _DATE_PARTS[name](v.build()).cast("long"))
        raise ExpressionError(f"unknown function {name}")

    def macro(self, v: Value, name: str) -> Value:
        self.take("(")
        var = self.next()[1]
        self.take(",")
        kind, holder = _element(v), {}
        self.locals.append({var: Value(kind, lambda: holder["x"])})
        body = self.ternary()
        self.locals.pop()
        self.take(")")
        if v.kind != "list":
            return self.fault(f"{name} needs a list")

        def over(x: Column) -> Column:
            holder["x"] = x
            return body.build()

        if name == "all":
            return Value("bool", lambda: F.forall(v.build(), over))
        if name == "exists":
            return Value("bool", lambda: F.exists(v.build(), over))
        if name == "exists_one":
            return Value("bool", lambda: F.size(F.filter(v.build(), over)) == 1)
        if name == "filter":
            return Value("list", lambda: F.filter(v.build(), over), items=[Value(kind, lambda: F.lit(None))])
        return Value("list", lambda: F.transform(v.build(), over), items=[Value(body.kind, lambda: F.lit(None))])

    def call(self, name: str) -> Value:
        if name == "has":
            return self.has()
        a = self.args()
        u = self.scope.unicode
        if name in ("textEq", "textContains", "ordEq") and len(a) == 2:
            norm = tx.norm_ordered if name == "ordEq" else tx.norm_text
            test = F.contains if name == "textContains" else (lambda x, y: x == y)
            return Value("bool", lambda: test(norm(a[0].build(), u), norm(a[1].build(), u)))
        if name in ("textIn", "ordIn") and len(a) == 2:
            norm = tx.norm_ordered if name == "ordIn" else tx.norm_text
            return Value("bool", lambda: F.array_contains(F.transform(a[1].build(), lambda x: norm(x, u)), norm(a[0].build(), u)))
        if name == "ordRank" and len(a) == 2:
            return Value("int", lambda: (F.array_position(F.transform(a[1].build(), lambda x: tx.norm_ordered(x, u)), tx.norm_ordered(a[0].build(), u)) - 1).cast("long"))
        if len(a) != 1:
            raise ExpressionError(f"unknown function {name}")
        return self.convert(name, a[0])

    def has(self) -> Value:
        self.take("(")
        base = self.next()[1]
        if base not in ("lead", "company") or self.peek() not in (".", "["):
            raise ExpressionError("has() tests lead.x or company.x")
        if base == "lead" and not self.scope.lead_visible:
            raise ExpressionError("a company-level condition has no lead")
        v = self.entry(base)
        self.take(")")
        return Value("bool", lambda: v.build().isNotNull())

    def convert(self, name: str, v: Value) -> Value:
        if name == "size" and v.kind in ("string", "list"):
            return Value("int", lambda: (F.length(v.build()) if v.kind == "string" else F.size(v.build())).cast("long"))
        if name == "dyn":
            return v
        if name == "type":
            return Value("string", lambda: F.when(v.build().isNotNull(), F.lit(v.kind)))
        casts = {
            "int": ("int", lambda c: c.cast("long") if v.kind in ("double", "int") else F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("long"))),
            "double": ("double", lambda c: c.try_cast("double")),
            "string": ("string", lambda c: tx.format_number(c) if v.kind == "double" else c.cast("string")),
            "bool": ("bool", lambda c: F.when(c.isin("true", "TRUE", "True", "t", "1"), True).when(c.isin("false", "FALSE", "False", "f", "0"), False)),
        }
        if name in casts:
            kind, cast = casts[name]
            return v if v.kind == kind else Value(kind, lambda: cast(v.build()))
        if name == "timestamp" and v.kind == "string":
            if v.constant is not None:
                try:
                    when = parse_date(v.constant)
                except ValueError:
                    return self.fault("timestamp() cannot read the text")
                return Value("timestamp", lambda: F.lit(when))
            return Value("timestamp", lambda: F.try_to_timestamp(v.build()))
        if name == "duration" and v.constant is not None:
            try:
                span = duration(v.constant)
            except ValueError:
                return self.fault("duration() cannot read the text")
            return Value("duration", lambda: F.lit(span))
        raise ExpressionError(f"unknown function {name}")

    # -- operators
    def apply(self, op: str, a: Value, b: Value) -> Value:
        if op in ("&&", "||"):
            x, y = _bool(a), _bool(b)
            return Value("bool", lambda: x.build() & y.build() if op == "&&" else x.build() | y.build())
        if op == "in":
            return self.membership(a, b)
        if op in ("==", "!=", "<", "<=", ">", ">="):
            return self.compare(op, a, b)
        if a.kind == b.kind and a.kind in ("int", "double") and not (op == "%" and a.kind == "double"):
            return Value(a.kind, lambda: _ARITHMETIC[op](a.build(), b.build(), a.kind))
        if op == "+" and a.kind == b.kind == "string":
            return Value("string", lambda: F.concat(a.build(), b.build()))
        if op in "+-" and (a.kind, b.kind) in (("timestamp", "duration"), ("duration", "duration")):
            return Value(a.kind, lambda: a.build() + b.build() if op == "+" else a.build() - b.build())
        if op == "-" and a.kind == b.kind == "timestamp":
            return Value("duration", lambda: a.build() - b.build())
        return self.fault(f"{a.kind} {op} {b.kind} has no meaning")

    def compare(self, op: str, a: Value, b: Value) -> Value:
        numbers = {"int", "double"}
        if "null" in (a.kind, b.kind):
            return Value("bool", lambda: F.lit(op == "!=") & (a if b.kind == "null" else b).build().isNotNull())
        if a.kind != b.kind and not {a.kind, b.kind} <= numbers:
            if op in ("==", "!="):
                return Value("bool", lambda: F.when(a.build().isNotNull() & b.build().isNotNull(), F.lit(op == "!=")))
            return self.fault(f"{a.kind} {op} {b.kind} has no meaning")
        tests = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
        return Value("bool", lambda: tests[op](a.build(), b.build()))

    def membership(self, a: Value, b: Value) -> Value:
        if b.kind.startswith("map:"):
            if a.constant is None:
                raise ExpressionError("in needs a literal name on its left")
            try:
                v = self.value_of(b.kind[4:], a.constant)
            except ExpressionError:
                return Value("bool", lambda: F.lit(False))
            return Value("bool", lambda: v.build().isNotNull())
        if b.kind != "list":
            return self.fault("in needs a list")
        if b.items is not None and all(x.constant is not None for x in b.items):
            same = [x.constant for x in b.items if x.kind == a.kind or {x.kind, a.kind} <= {"int", "double"}]
            return Value("bool", lambda: a.build().isin(*same) if same else F.when(a.build().isNotNull(), F.lit(False)))
        return Value("bool", lambda: F.array_contains(b.build(), a.build()))

    def fault(self, why: str) -> Value:
        self.warnings.append(why)
        return Value("bool", lambda: F.lit(None).cast("boolean"))


_DATE_PARTS = {
    "getFullYear": F.year,
    "getMonth": lambda c: F.month(c) - 1,
    "getDate": F.dayofmonth,
    "getDayOfMonth": lambda c: F.dayofmonth(c) - 1,
    "getDayOfWeek": lambda c: F.dayofweek(c) - 1,
    "getDayOfYear": lambda c: F.dayofyear(c) - 1,
    "getHours": F.hour,
    "getMinutes": F.minute,
    "getSeconds": F.second,
    "getMilliseconds": lambda c: F.floor(F.unix_micros(c) / 1000) % 1000,
}

_ARITHMETIC = {
    "+": lambda x, y, k: F.try_add(x, y),
    "-": lambda x, y, k: F.try_subtract(x, y),
    "*": lambda x, y, k: F.try_multiply(x, y),
    "/": lambda x, y, k: x / F.nullif(y, F.lit(0.0)) if k == "double" else F.when(y != 0, F.call_function("div", x, F.nullif(y, F.lit(0).cast("long")))),
    "%": lambda x, y, k: x % F.nullif(y, F.lit(0).cast("long")),
}


def _bool(v: Value) -> Value:
    if v.kind == "bool":
        return v
    return Value("bool", lambda: F.lit(None).cast("boolean"))


def _list(items: list[Value]) -> Value:
    return Value("list", lambda: F.array(*(x.build() for x in items)), items=items)


def _element(v: Value) -> str:
    kinds = {x.kind for x in v.items or []}
    return kinds.pop() if len(kinds) == 1 else "dyn"


def _constant(c: Any) -> Value:
    if isinstance(c, list):
        return _list([_constant(x) for x in c])
    kind = "bool" if isinstance(c, bool) else "double" if isinstance(c, float) else "string"
    return Value(kind, lambda: F.lit(c), c)


def compile_expression(source: str, scope: Scope) -> tuple[Callable[[], Column], list[str]]:
    """A builder of the condition's column (null where it cannot be worked out), and warnings."""
    p = Parser(source, scope)
    v = p.whole()
    if v.kind not in ("bool", "dyn"):
        raise ExpressionError(f"the condition must be true or false, but gives {v.kind}")
    return v.build, p.warnings
