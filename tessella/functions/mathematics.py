"""Mathematical functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.compiler import Context, Val, bad, first_error, fn, num, text

INF = float("inf")


def number(c: Column, err: Column | None = None) -> Val:
    return Val(c.cast("double"), err, "num")


def cells(v: Val) -> Column:
    """An array of doubles of a scalar or array; unreadable items are null."""
    if v.kind in ("array", "matrix"):
        c = F.flatten(v.col) if v.kind == "matrix" else v.col
        return F.transform(c, lambda x: x.try_cast("double"))
    return F.array(num(v))


def all_cells(args: tuple[Val, ...]) -> Column:
    """Every number of the arguments, nulls left out."""
    return F.filter(F.flatten(F.array(*[cells(a) for a in args])) if len(args) > 1 else cells(args[0]), lambda x: x.isNotNull())


def range_col(v: Val) -> Column:
    """A whole column's cells as doubles inside an aggregate; truth values count only where they are numbers."""
    return F.lit(None).cast("double") if v.body == "bool" else v.col.try_cast("double")


def fold(values: Column, start: float, step) -> Column:
    return F.aggregate(values, F.lit(float(start)), step)


def aggregate(ctx: Context, args: tuple[Val, ...], over_column, over_array):
    """over_column(column) inside an aggregate for one whole column, else over_array(array of numbers)."""
    ranges = [a for a in args if a.kind == "range"]
    if not ranges:
        return over_array(all_cells(args))
    if len(args) == 1:
        return ctx.agg(over_column(range_col(args[0])))
    return None


def summing(name: str, over_column, over_array, join):
    """Functions whose parts over several arguments are joined."""

    @fn(name)
    def build(ctx, *args):
        parts = [ctx.agg(over_column(range_col(a))) if a.kind == "range" else over_array(all_cells((a,))) for a in args]
        out = parts[0]
        for p in parts[1:]:
            out = join(out, p)
        return number(out)

    return build


summing("SUM", lambda c: F.coalesce(F.sum(c), F.lit(0.0)), lambda a: fold(a, 0, lambda s, x: s + x), lambda p, q: p + q)
summing("SUMSQ", lambda c: F.coalesce(F.sum(c * c), F.lit(0.0)), lambda a: fold(a, 0, lambda s, x: s + x * x), lambda p, q: p + q)
summing("PRODUCT", lambda c: F.coalesce(F.product(c), F.lit(1.0)), lambda a: fold(a, 1, lambda s, x: s * x), lambda p, q: p * q)
summing("MIN", lambda c: F.coalesce(F.min(c), F.lit(0.0)), lambda a: F.coalesce(F.array_min(a), F.lit(0.0)), F.least)
summing("MAX", lambda c: F.coalesce(F.max(c), F.lit(0.0)), lambda a: F.coalesce(F.array_max(a), F.lit(0.0)), F.greatest)
summing("COUNT", lambda c: F.count(c), lambda a: F.size(a), lambda p, q: p + q)


@fn("AVERAGE", "AVG")
def average(ctx, *args):
    total = [ctx.agg(F.coalesce(F.sum(range_col(a)), F.lit(0.0))) if a.kind == "range" else fold(all_cells((a,)), 0, lambda s, x: s + x) for a in args]
    n = [ctx.agg(F.count(range_col(a))) if a.kind == "range" else F.size(all_cells((a,))) for a in args]
    s, k = sum(total[1:], total[0]), sum(n[1:], n[0])
    return number(F.try_divide(s, k), bad(k == 0, "#DIV/0!"))


@fn("COUNTA")
def counta(ctx, *args):
    parts = []
    for a in args:
        if a.kind == "range":
            parts.append(ctx.agg(F.count_if(a.col.isNotNull() & (a.col.cast("string") != ""))))
        elif a.kind in ("array", "matrix"):
            parts.append(F.size(F.filter(a.col, lambda x: x.isNotNull() & (x.cast("string") != ""))))
        else:
            parts.append(F.when(a.col.isNotNull() & (a.col.cast("string") != ""), 1).otherwise(0))
    return number(sum(parts[1:], parts[0]))


@fn("COUNTBLANK")
def countblank(ctx, a):
    return number(ctx.agg(F.count_if(a.col.isNull() | (a.col.cast("string") == ""))))


def _to_multiple(name: str, whole):
    """The multiple of a step, 1 if left out, that whole(x / step) names; a negative step turns the direction."""

    @fn(name)
    def build(ctx, a, step=None):
        x = num(a)
        if step is None:
            return number(whole(x), bad(x.isNull(), "#VALUE!"))
        s = num(step)
        wrong = (x > 0) & (s < 0)
        return number(F.when(~wrong, F.when(s == 0, 0.0).otherwise(whole(F.try_divide(x, s)) * s)), first_error(bad(x.isNull() | s.isNull(), "#VALUE!"), bad(wrong, "#NUM!")))


_to_multiple("FLOOR", F.floor)
_to_multiple("CEILING", F.ceil)


def simple(name: str, f, domain=None, code: str = "#NUM!"):
    """A function of one number; domain(x) says where it is defined."""

    @fn(name)
    def build(ctx, a):
        x = num(a)
        err = bad(x.isNull(), "#VALUE!")
        if domain is None:
            return number(f(x), err)
        return number(F.when(domain(x), f(x)), first_error(err, bad(~domain(x), code)))

    return build


for _name, _f in {
    "ABS": F.abs, "INT": F.floor, "EXP": F.exp, "RADIANS": F.radians, "DEGREES": F.degrees, "SIN": F.sin, "COS": F.cos, "TAN": F.tan,
    "ATAN": F.atan, "SINH": F.sinh, "COSH": F.cosh, "TANH": F.tanh, "ASINH": F.asinh, "SIGN": F.signum, "SEC": lambda x: 1 / F.cos(x), "SECH": lambda x: 1 / F.cosh(x),
    "EVEN": lambda x: F.signum(x) * 2 * F.ceil(F.abs(x) / 2), "ODD": lambda x: F.when(x == 0, 1.0).otherwise(F.signum(x) * (2 * F.ceil((F.abs(x) - 1) / 2) + 1)),
}.items():
    simple(_name, _f)
simple("SQRT", F.sqrt, lambda x: x >= 0)
simple("LN", F.log, lambda x: x > 0)
simple("LOG10", F.log10, lambda x: x > 0)
simple("ASIN", F.asin, lambda x: F.abs(x) <= 1)
simple("ACOS", F.acos, lambda x: F.abs(x) <= 1)
simple("ACOSH", F.acosh, lambda x: x >= 1)
simple("ATANH", F.atanh, lambda x: F.abs(x) < 1)
for _name, _f in {"CSC": F.sin, "COT": F.tan, "CSCH": F.sinh, "COTH": F.tanh}.items():
    simple(_name, lambda x, f=_f: F.try_divide(F.lit(1.0), f(x)), lambda x: x != 0, "#DIV/0!")
simple("SQRTPI", lambda x: F.sqrt(x * math.pi), lambda x: x >= 0)
simple("FACT", lambda x: F.aggregate(F.sequence(F.lit(0), F.floor(x).cast("int")), F.lit(1.0), lambda s, i: s * F.when(i == 0, 1.0).otherwise(i.cast("double"))), lambda x: (x >= 0) & (x <= 170))
simple("FACTDOUBLE", lambda x: F.aggregate(F.filter(F.sequence(F.lit(0), F.floor(x).cast("int")), lambda i: (i > 0) & (i % 2 == F.floor(x).cast("int") % 2)), F.lit(1.0), lambda s, i: s * i), lambda x: (x >= 0) & (x <= 300))


@fn("PI")
def pi(ctx):
    return number(F.lit(math.pi))


@fn("ROUND")
def round_(ctx, a, n=None):
    x, p = num(a), F.pow(F.lit(10.0), F.floor(num(n))) if n is not None else F.lit(1.0)
    if n is None or isinstance(n.literal, (int, float)):
        return number(F.round(x, int(n.literal) if n is not None else 0), bad(x.isNull(), "#VALUE!"))
    return number(F.signum(x) * F.floor(F.abs(x) * p + 0.5) / p, bad(x.isNull(), "#VALUE!"))


def _toward(names, inner):
    @fn(*names)
    def build(ctx, a, n=None):
        x, p = num(a), F.pow(F.lit(10.0), F.floor(num(n)) if n is not None else F.lit(0.0))
        return number(F.signum(x) * inner(F.abs(x) * p) / p, bad(x.isNull(), "#VALUE!"))


_toward(("TRUNC", "ROUNDDOWN"), F.floor)
_toward(("ROUNDUP",), F.ceil)


@fn("POWER")
def power(ctx, a, b):
    return ctx.binary("^", a, b)


@fn("MOD")
def mod(ctx, a, b):
    x, y = num(a), num(b)
    return number(x - F.floor(F.try_divide(x, y)) * y, bad(y == 0, "#DIV/0!"))


@fn("QUOTIENT")
def quotient(ctx, a, b):
    q = F.try_divide(num(a), num(b))
    return number(F.signum(q) * F.floor(F.abs(q)), bad(num(b) == 0, "#NUM!"))


@fn("LOG")
def log(ctx, a, base=None):
    x, b = num(a), num(base) if base is not None else F.lit(10.0)
    ok = (x > 0) & (b > 0) & (b != 1)
    return number(F.when(ok, F.log(x) / F.log(b)), bad(~ok, "#NUM!"))


@fn("MROUND")
def mround(ctx, a, m):
    x, y = num(a), num(m)
    return number(F.when(y == 0, 0.0).otherwise(F.floor(F.try_divide(x, y) + 0.5) * y), bad(x * y < 0, "#NUM!"))


@fn("ATAN2")
def atan2(ctx, a, b):
    x, y = num(a), num(b)
    return number(F.atan2(y, x), bad((x == 0) & (y == 0), "#DIV/0!"))


def choose(n: Column, k: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.least(k, n - k), F.lit(0)).cast("int")), F.lit(1.0), lambda s, i: F.when(i == 0, s).otherwise(s * (n - F.least(k, n - k) + i) / i))


@fn("COMBIN")
def combin(ctx, a, b):
    n, k = F.floor(num(a)), F.floor(num(b))
    ok = (n >= 0) & (k >= 0) & (k <= n)
    return number(F.when(ok, F.round(choose(n, k))), bad(~ok, "#NUM!"))


@fn("PERMUT")
def permut(ctx, a, b):
    n, k = F.floor(num(a)), F.floor(num(b))
    ok = (n >= 0) & (k >= 0) & (k <= n)
    return number(F.when(ok, F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(1.0), lambda s, i: F.when(i == 0, s).otherwise(s * (n - i + 1)))), bad(~ok, "#NUM!"))


@fn("MULTINOMIAL")
def multinomial(ctx, *args):
    a = all_cells(args)
    fact = lambda x: F.aggregate(F.sequence(F.lit(0), F.floor(x).cast("int")), F.lit(1.0), lambda s, i: F.when(i == 0, s).otherwise(s * i))
    return number(fact(fold(a, 0, lambda s, x: s + x)) / fold(F.transform(a, fact), 1, lambda s, x: s * x))


@fn("SERIESSUM")
def seriessum(ctx, x, n, m, c):
    a = cells(c)
    terms = F.transform(a, lambda v, i: v * F.pow(num(x), num(n) + i * num(m)))
    return number(fold(terms, 0, lambda s, v: s + v))


def _pairs(name, column, item):
    @fn(name)
    def build(ctx, a, b):
        if a.kind == "range":
            return number(ctx.agg(F.coalesce(F.sum(column(range_col(a), range_col(b))), F.lit(0.0))))
        return number(fold(F.zip_with(cells(a), cells(b), item), 0, lambda s, x: s + F.coalesce(x, F.lit(0.0))))


_pairs("SUMX2MY2", lambda x, y: x * x - y * y, lambda x, y: x * x - y * y)
_pairs("SUMX2PY2", lambda x, y: x * x + y * y, lambda x, y: x * x + y * y)
_pairs("SUMXMY2", lambda x, y: (x - y) * (x - y), lambda x, y: (x - y) * (x - y))


@fn("SUMPRODUCT")
def sumproduct(ctx, *args):
    if args[0].kind == "range":
        c = F.coalesce(range_col(args[0]), F.lit(0.0))
        for a in args[1:]:
            c = c * F.coalesce(range_col(a), F.lit(0.0))
        return number(ctx.agg(F.coalesce(F.sum(c), F.lit(0.0))))
    a = cells(args[0])
    for b in args[1:]:
        a = F.zip_with(a, cells(b), lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
    return number(fold(a, 0, lambda s, x: s + F.coalesce(x, F.lit(0.0))))


def _gcd_udf(lcm: bool):
    @F.pandas_udf(T.DoubleType())
    def run(lists: pd.Series) -> pd.Series:
        f = math.lcm if lcm else math.gcd
        return lists.map(lambda xs: None if xs is None or any(x < 0 for x in xs) else float(f(*[int(x) for x in xs])))

    return run


def _integers(name, lcm):
    @fn(name)
    def build(ctx, *args):
        a = ctx.agg(F.collect_set(range_col(args[0]))) if args[0].kind == "range" else all_cells(args)
        v = _gcd_udf(lcm)(a)
        return number(v, bad(v.isNull(), "#NUM!"))


_integers("GCD", False)
_integers("LCM", True)


@fn("RAND")
def rand(ctx):
    return number(F.rand())


@fn("RANDBETWEEN")
def randbetween(ctx, a, b):
    lo, hi = F.ceil(num(a)), F.floor(num(b))
    return number(F.floor(F.rand() * (hi - lo + 1)) + lo, bad(hi < lo, "#NUM!"))


@fn("BASE")
def base(ctx, a, radix, least=None):
    x, r = F.floor(num(a)).cast("long"), int(radix.literal)
    c = F.conv(x.cast("string"), 10, r)
    return Val(c if least is None else F.when(F.length(c) >= num(least), c).otherwise(F.lpad(c, int(least.literal), "0")), bad(num(a) < 0, "#NUM!"), "str")


@fn("DECIMAL")
def decimal(ctx, a, radix):
    r = int(radix.literal)
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:r]
    ok = F.lower(text(a)).rlike(f"^[{digits}]+$")
    return number(F.when(ok, F.conv(text(a), r, 10)), bad(~ok, "#NUM!"))


#: The numerals of ROMAN and ARABIC.
NUMERALS = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


@fn("ROMAN")
def roman(ctx, a, form=None):
    n = F.floor(num(a)).cast("int")
    out, rest = F.lit(""), n
    for v, s in NUMERALS:
        out = F.concat(out, F.repeat(F.lit(s), F.floor(rest / v).cast("int")))
        rest = rest % v
    ok = (n >= 0) & (n <= 3999)
    return Val(F.when(ok, out), bad(~ok, "#VALUE!"), "str")


@fn("ARABIC")
def arabic(ctx, a):
    t = F.upper(F.trim(text(a)))
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    body = F.regexp_replace(t, "^-", "")
    value = F.create_map(*[x for v, s in NUMERALS if len(s) == 1 for x in (F.lit(s), F.lit(float(v)))])
    vals = F.transform(F.split(body, ""), lambda c: F.coalesce(value[c], F.lit(0.0)))
    total = fold(F.transform(vals, lambda v, i: F.when(v < F.coalesce(F.get(vals, i + 1), F.lit(0.0)), -v).otherwise(v)), 0, lambda s, x: s + x)
    ok = body.rlike("^[IVXLCDM]*$")
    return number(F.when(ok, sign * total), bad(~ok, "#VALUE!"))
