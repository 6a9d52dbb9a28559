"""Formulas to columns.

A value is a column and, where it can fail, a column of its error code; an error passes through every function
that does not ask for it. [@Col], or a bare column name, is the row's value; [Col] or Table[Col] is the whole
column, which aggregate functions take. In a row formula, aggregates are computed in one pass and joined back as a
single row.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.parser import FormulaError, parse


@dataclass
class Val:
    """col with its error code, or null; kind is num, str, bool, date, any, array, range, lambda or blank."""

    col: Column | None
    err: Column | None = None
    kind: str = "any"
    body: object = None
    literal: object = None


def first_error(*errs: Column | None) -> Column | None:
    known = [e for e in errs if e is not None]
    return F.coalesce(*known) if len(known) > 1 else known[0] if known else None


def num(v: Val) -> Column:
    """As a double: true is 1, a blank 0, unreadable text null."""
    if v.kind == "num":
        return v.col
    if v.kind == "bool":
        return v.col.cast("int").cast("double")
    if v.kind == "blank":
        return F.lit(0.0)
    if v.kind == "str":
        return F.coalesce(v.col.try_cast("double"), F.when(F.trim(v.col) == "", 0.0))
    return v.col.try_cast("double")


def text(v: Val) -> Column:
    """As text: whole numbers without a point, a blank empty."""
    if v.kind in ("str",):
        return F.coalesce(v.col, F.lit(""))
    if v.kind == "bool":
        return F.upper(v.col.cast("string"))
    if v.kind == "blank":
        return F.lit("")
    if v.kind == "num":
        whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
        return F.coalesce(F.when(whole, v.col.cast("decimal(20,0)").cast("string")).otherwise(v.col.cast("string")), F.lit(""))
    return F.coalesce(v.col.cast("string"), F.lit(""))


def truth(v: Val) -> Column:
    if v.kind == "bool":
        return v.col
    if v.kind == "str":
        return F.when(F.lower(v.col) == "true", True).when(F.lower(v.col) == "false", False)
    return num(v) != 0


def bad(test: Column, code: str) -> Column:
    return F.when(test, F.lit(code))


@dataclass
class Function:
    build: Callable
    catches: bool = False
    lazy: bool = False

    def takes(self, number: int) -> bool:
        """Whether it has a use for so many arguments."""
        places = [p for p in inspect.signature(self.build).parameters.values() if p.name != "env"][1:]
        most = float("inf") if any(p.kind == p.VAR_POSITIONAL for p in places) else len(places)
        return sum(p.kind == p.POSITIONAL_OR_KEYWORD and p.default is p.empty for p in places) <= number <= most


#: NAME -> function; filled by the modules of this package and by register().
REGISTRY: dict[str, Function] = {}


def fn(*names: str, catches: bool = False, lazy: bool = False):
    """Register build(ctx, *args) under names; it returns a Val, or None args for ones left out."""

    def put(build):
        for n in names:
            REGISTRY[n] = Function(build, catches, lazy)
        return build

    return put


def register(name: str, build: Callable[..., Column]) -> None:
    """Add a function of plain columns: build(*columns) -> Column."""
    REGISTRY[name.upper()] = Function(lambda ctx, *args: Val(build(*[a.col for a in args])))


@dataclass
class Context:
    schema: T.StructType
    names: dict[str, Val] = field(default_factory=dict)
    row_mode: bool = True
    aggregates: list[Column] = field(default_factory=list)
    row_refs: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)

    def agg(self, c: Column) -> Column:
        """An aggregate's value at this place."""
        if not self.row_mode:
            return c
        self.aggregates.append(c)
        return F.col(f"__agg_{len(self.aggregates) - 1}")

    def kind_of(self, name: str) -> str:
        t = self.schema[name].dataType
        if isinstance(t, T.BooleanType):
            return "bool"
        if isinstance(t, T.NumericType):
            return "num"
        if isinstance(t, T.StringType):
            return "str"
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "date"
        return "array" if isinstance(t, T.ArrayType) else "any"

    def column(self, name: str) -> Val:
        kind = self.kind_of(name)
        c = F.col(f"`{name}`")
        self.row_refs.append(name)
        return Val(c.cast("double") if kind == "num" else c, kind=kind)

    # ---- walking ----

    def walk(self, node: tuple, env: dict | None = None) -> Val:
        env = env or {}
        kind = node[0]
        if kind == "num":
            return Val(F.lit(float(node[1])), kind="num", literal=node[1])
        if kind == "str":
            return Val(F.lit(node[1]), kind="str", literal=node[1])
        if kind == "bool":
            return Val(F.lit(node[1]), kind="bool", literal=node[1])
        if kind == "err":
            return Val(F.lit(None).cast("double"), F.lit(node[1]), "num")
        if kind == "blank":
            return Val(F.lit(None), kind="blank")
        if kind == "name":
            low = node[1]
            for scope in (env, self.names):
                if low in scope:
                    return scope[low]
            if low in self.schema.fieldNames():
                return self.column(low)
            return Val(F.lit(None).cast("double"), F.lit("#NAME?"), "num")
        if kind == "row":
            if node[1] not in self.schema.fieldNames():
                return Val(F.lit(None).cast("double"), F.lit("#REF!"), "num")
            return self.column(node[1])
        if kind == "range":
            if node[2].upper() == "#HEADERS":
                return Val(F.array(*[F.lit(c) for c in self.schema.fieldNames()]), kind="array")
            if node[2] not in self.schema.fieldNames():
                return Val(F.lit(None).cast("double"), F.lit("#REF!"), "num")
            c = F.col(f"`{node[2]}`")
            return Val(c, kind="range", body=self.kind_of(node[2]))
        if kind == "array":
            cells = [[self.walk(x, env) for x in row] for row in node[1]]
            strings = any(x.kind == "str" for r in cells for x in r)
            flat = [F.array(*[text(x) if strings else num(x) for x in row]) for row in cells]
            if len(flat) == 1:
                return Val(flat[0], kind="array", body="str" if strings else "num")
            if all(len(r) == 1 for r in cells):
                return Val(F.flatten(F.array(*flat)), kind="array", body="str" if strings else "num")
            return Val(F.array(*flat), kind="matrix", body="str" if strings else "num")
        if kind == "pre":
            v = self.walk(node[2], env)
            if node[1] == "@":
                return Val(F.get(v.col, 0), v.err, "any") if v.kind == "array" else v
            x = num(v)
            return Val(-x if node[1] == "-" else x, first_error(v.err, bad(x.isNull(), "#VALUE!")), "num", literal=-v.literal if node[1] == "-" and isinstance(v.literal, (int, float)) else v.literal)
        if kind == "post":
            v = self.walk(node[2], env)
            return v if node[1] == "#" else Val(num(v) / 100, v.err, "num")
        if kind == "bin":
            return self.binary(node[1], self.walk(node[2], env), self.walk(node[3], env))
        if kind == "call":
            return self.call(node[1], node[2], env)
        if kind == "apply":
            f = self.walk(node[1], env)
            return self.apply(f, [self.walk(a, env) for a in node[2]])
        raise FormulaError(f"unknown node {kind}")

    def binary(self, op: str, a: Val, b: Val) -> Val:
        err = first_error(a.err, b.err)
        if op == "&":
            return Val(F.concat(text(a), text(b)), err, "str")
        if op in ("=", "<>", "<", "<=", ">", ">="):
            if "str" in (a.kind, b.kind):
                x, y = (text(a), text(b)) if a.kind == b.kind or "blank" in (a.kind, b.kind) else (None, None)
                if x is None:  # text is above numbers and below truth values
                    rank = {"str": 1, "bool": 2}
                    x, y = F.lit(rank.get(a.kind, 0)), F.lit(rank.get(b.kind, 0))
            elif "date" in (a.kind, b.kind) and a.kind == b.kind:
                x, y = a.col, b.col
            else:
                x, y = num(a), num(b)
            c = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            return Val(c, err, "bool")
        if a.kind == "date" and op in "+-":
            days = F.date_add(F.to_date(a.col), (num(b) if op == "+" else -num(b)).cast("int"))
            return Val(F.datediff(F.to_date(a.col), F.to_date(b.col)).cast("double"), err, "num") if b.kind == "date" else Val(days, err, "date")
        x, y = num(a), num(b)
        err = first_error(err, bad(x.isNull() & F.lit(a.kind == "str"), "#VALUE!"), bad(y.isNull() & F.lit(b.kind == "str"), "#VALUE!"))
        if op == "/":
            return Val(F.try_divide(x, y), first_error(err, bad(y == 0, "#DIV/0!")), "num")
        if op == "^":
            r = F.pow(x, y)
            return Val(F.when(~F.isnan(r) & (F.abs(r) < float("inf")), r), first_error(err, bad(F.isnan(r) | (F.abs(r) == float("inf")), "#NUM!")), "num")
        return Val({"+": x + y, "-": x - y, "*": x * y}[op], err, "num")

    def call(self, name: str, args: list, env: dict) -> Val:
        if name == "LET":
            env = dict(env)
            for k in range(0, len(args) - 1, 2):
                env[args[k][1]] = self.walk(args[k + 1], env)
            return self.walk(args[-1], env)
        if name == "LAMBDA":
            return Val(None, kind="lambda", body=([a[1] for a in args[:-1]], args[-1], dict(env)))
        for scope in (env, self.names):
            if (f := next((v for k, v in scope.items() if k.upper() == name and v.kind == "lambda"), None)) is not None:
                return self.apply(f, [self.walk(a, env) for a in args])
        f = REGISTRY.get(name) or REGISTRY.get(name.removeprefix("_XLFN."))
        if f is None:
            return Val(F.lit(None).cast("double"), F.lit("#NAME?"), "num")
        if f.lazy:
            return f.build(self, *args, env=env) if f.takes(len(args)) else Val(F.lit(None).cast("double"), F.lit("#VALUE!"), "num")
        values = [self.walk(a, env) for a in args]
        if not f.takes(len(values)):
            return Val(F.lit(None).cast("double"), F.lit("#VALUE!"), "num")
        out = f.build(self, *values)
        if not f.catches:
            out.err = first_error(*[v.err for v in values], out.err)
        return out

    def apply(self, f: Val, args: list[Val]) -> Val:
        if f.kind != "lambda":
            return Val(F.lit(None).cast("double"), F.lit("#VALUE!"), "num")
        names, body, env = f.body
        bound = dict(env)
        for k, n in enumerate(names):
            bound[n] = args[k] if k < len(args) else Val(F.lit(None), kind="blank", body="omitted")
        return self.walk(body, bound)

    def function(self, f: Val, kinds: str = "num") -> Callable[..., Column]:
        """A lambda value as a function of columns, for higher-order expressions."""
        return lambda *cols: self.apply(f, [Val(c, kind=kinds) for c in cols]).col


def _load() -> None:
    from tessella.functions import arrays, datetimes, distributions, engineering, financial, information, lookup, mathematics, statistics, texts  # noqa: F401


def compile_formula(formula: str, schema: T.StructType, names: dict[str, str] | None = None, row_mode: bool = True) -> tuple[Val, Context]:
    _load()
    ctx = Context(schema, row_mode=row_mode)
    for k, v in (names or {}).items():
        ctx.names[k] = ctx.walk(parse(v))
    return ctx.walk(parse(formula)), ctx


def value_or_null(v: Val) -> Column:
    return v.col if v.err is None else F.when(v.err.isNull(), v.col)


def with_formula(df: DataFrame, target: str, formula: str, names: dict[str, str] | None = None, errors: str | None = None) -> DataFrame:
    """df with the formula's value per row, null where it is an error; errors names a column for the code."""
    v, ctx = compile_formula(formula, df.schema, names)
    out = df
    if ctx.aggregates:
        one = df.agg(*[a.alias(f"__agg_{i}") for i, a in enumerate(ctx.aggregates)])
        out = df.crossJoin(F.broadcast(one))  # one row
    more = {target: value_or_null(v)} | ({errors: v.err if v.err is not None else F.lit(None).cast("string")} if errors else {})
    return out.withColumns(more).drop(*[f"__agg_{i}" for i in range(len(ctx.aggregates))])


def aggregate_formulas(df: DataFrame, formulas: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """One row, or one per group, with the value of each formula over whole columns."""
    cols = []
    for name, text_ in formulas.items():
        v, _ = compile_formula(text_, df.schema, row_mode=False)
        cols.append(value_or_null(v).alias(name))
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def sheet(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """df with columns of formulas that may use each other, in any order; those on a cycle are null (#REF!)."""
    import graphlib
    import re

    uses = {k: {n for n in formulas if n != k and re.search(rf"(?<![\w\]]){re.escape(n)}(?!\w)", f)} | ({k} if re.search(rf"(?<!\w){re.escape(k)}(?!\w)", f) and k not in df.columns else set()) for k, f in formulas.items()}
    lost: set[str] = set()
    while True:
        live = {k: u - {k} for k, u in uses.items() if k not in lost}
        selfish = {k for k, u in uses.items() if k in u and k not in lost}
        lost |= selfish
        try:
            order = list(graphlib.TopologicalSorter({k: u - lost for k, u in live.items() if k not in lost}).static_order())
            break
        except graphlib.CycleError as e:
            lost |= set(e.args[1])
    for k in lost:
        df = df.withColumn(k, F.lit(None).cast("double"))
    for k in order:
        df = with_formula(df, k, formulas[k])
    return df
