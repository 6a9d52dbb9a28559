"""Statistics over whole columns or arrays, conditional aggregates and database functions."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.arrays import array, flat
from tessella.functions.compiler import Val, bad, first_error, fn, num
from tessella.functions.mathematics import aggregate, all_cells, cells, fold, number, range_col
from tessella.operators.joins import wildcard_pattern


def mean(a: Column) -> Column:
    return F.try_divide(fold(a, 0, lambda s, x: s + x), F.size(a))


def moment(a: Column, k: int) -> Column:
    m = mean(a)
    return fold(F.transform(a, lambda x: F.pow(x - m, F.lit(float(k)))), 0, lambda s, x: s + x)


def sorted_at(a: Column, p: Column) -> Column:
    """Linear interpolation in a sorted array at the place p * (n - 1)."""
    at = p * (F.size(a) - 1)
    lo = F.floor(at).cast("int")
    x, y = F.get(a, lo), F.get(a, F.least(lo + 1, F.size(a) - 1))
    return x + (y - x) * (at - lo)


def stat(names, over_column, over_array, least: int = 1, code: str = "#DIV/0!"):
    """A statistic of all numbers; fewer than least of them are an error."""

    @fn(*names)
    def build(ctx, *args):
        v = aggregate(ctx, args, over_column, over_array)
        n = aggregate(ctx, args, F.count, F.size)
        return number(F.when(n >= least, v), bad(n < least, code))


stat(("MEDIAN",), F.median, lambda a: sorted_at(F.sort_array(a), F.lit(0.5)), 1, "#NUM!")
stat(("STDEV.S", "STDEV"), F.stddev_samp, lambda a: F.sqrt(F.try_divide(moment(a, 2), F.size(a) - 1)), 2)
stat(("STDEV.P", "STDEVP"), F.stddev_pop, lambda a: F.sqrt(F.try_divide(moment(a, 2), F.size(a))))
stat(("VAR.S", "VAR"), F.var_samp, lambda a: F.try_divide(moment(a, 2), F.size(a) - 1), 2)
stat(("VAR.P", "VARP"), F.var_pop, lambda a: F.try_divide(moment(a, 2), F.size(a)))
stat(("DEVSQ",), lambda c: F.var_pop(c) * F.count(c), lambda a: moment(a, 2), 1, "#NUM!")
stat(("GEOMEAN",), lambda c: F.when(F.min(c) > 0, F.exp(F.avg(F.log(c)))), lambda a: F.when(F.array_min(a) > 0, F.exp(mean(F.transform(a, lambda x: F.log(x))))), 1, "#NUM!")
stat(("HARMEAN",), lambda c: F.when(F.min(c) > 0, F.count(c) / F.sum(1 / c)), lambda a: F.when(F.array_min(a) > 0, F.size(a) / fold(F.transform(a, lambda x: 1 / x), 0, lambda s, x: s + x)), 1, "#NUM!")


def _skew(n, g):
    return g * F.sqrt(n * (n - 1)) / (n - 2)


def _kurt(n, k):
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6)


stat(("SKEW",), lambda c: _skew(F.count(c), F.skewness(c)), lambda a: _skew(F.size(a), moment(a, 3) / F.size(a) / F.pow(moment(a, 2) / F.size(a), F.lit(1.5))), 3)
stat(("KURT",), lambda c: _kurt(F.count(c), F.kurtosis(c)), lambda a: _kurt(F.size(a), moment(a, 4) / F.size(a) / F.pow(moment(a, 2) / F.size(a), F.lit(2.0)) - 3), 4)


def values(ctx, a: Val) -> Column:
    """A column's numbers as an array inside an aggregate; for statistics that need them side by side."""
    return ctx.agg(F.collect_list(range_col(a))) if a.kind == "range" else all_cells((a,))


@fn("AVEDEV")
def avedev(ctx, *args):
    a = values(ctx, args[0]) if len(args) == 1 else all_cells(args)
    m = mean(a)
    return number(mean(F.transform(a, lambda x: F.abs(x - m))), bad(F.size(a) == 0, "#NUM!"))


def _counts(ctx, args) -> Column:
    """(value, number, first place) of each distinct number."""
    a = values(ctx, args[0]) if len(args) == 1 else all_cells(args)
    return F.transform(F.array_distinct(a), lambda x: F.struct(F.size(F.filter(a, lambda y: y == x)).alias("n"), (-F.array_position(a, x)).alias("p"), x.alias("x")))


@fn("MODE.SNGL", "MODE")
def mode(ctx, *args):
    top = F.array_max(_counts(ctx, args))
    return number(F.when(top["n"] > 1, top["x"]), bad(F.coalesce(top["n"], F.lit(0)) < 2, "#N/A"))


@fn("MODE.MULT")
def mode_mult(ctx, *args):
    c = _counts(ctx, args)
    top = F.array_max(F.transform(c, lambda s: s["n"]))
    return array(F.transform(F.filter(c, lambda s: s["n"] == top), lambda s: s["x"]), err=bad(top < 2, "#N/A"))


def _kth(name, ascending):
    @fn(name)
    def build(ctx, a, k):
        s = F.sort_array(values(ctx, a), ascending)
        at = num(k).cast("int")
        return number(F.get(s, at - 1), bad((at < 1) | (at > F.size(s)), "#NUM!"))


_kth("LARGE", False)
_kth("SMALL", True)


@fn("RANK.EQ", "RANK")
def rank(ctx, a, all_, order=None):
    up = order is not None and order.literal not in (0, None, False)
    s = values(ctx, all_)
    ahead = F.size(F.filter(s, (lambda x: x < num(a)) if up else (lambda x: x > num(a))))
    return number(ahead + 1, bad(~F.array_contains(s, num(a)), "#N/A"))


@fn("PERCENTILE.INC", "PERCENTILE")
def percentile(ctx, a, p):
    q = num(p)
    ok = (q >= 0) & (q <= 1)
    if a.kind == "range":
        return number(F.when(ok, ctx.agg(F.percentile(range_col(a), q))), bad(~ok, "#NUM!"))
    return number(F.when(ok, sorted_at(F.sort_array(all_cells((a,))), q)), bad(~ok, "#NUM!"))


@fn("QUARTILE.INC", "QUARTILE")
def quartile(ctx, a, q):
    return percentile(ctx, a, Val(num(q) / 4, kind="num"))


def two(names, over_column, over_array, least: int = 2):
    @fn(*names)
    def build(ctx, a, b):
        if a.kind == "range":
            x, y = range_col(a), range_col(b)
            both = x.isNotNull() & y.isNotNull()
            n = ctx.agg(F.count_if(both))
            return number(F.when(n >= least, ctx.agg(over_column(F.when(both, x), F.when(both, y)))), bad(n < least, "#DIV/0!"))
        x, y = cells(a), cells(b)
        return number(over_array(x, y), bad(F.size(x) < least, "#DIV/0!"))


def _cross(x, y):
    mx, my = mean(x), mean(y)
    return fold(F.zip_with(x, y, lambda p, q: (p - mx) * (q - my)), 0, lambda s, v: s + v)


two(("CORREL", "PEARSON"), F.corr, lambda x, y: _cross(x, y) / F.sqrt(moment(x, 2) * moment(y, 2)))
two(("COVARIANCE.S",), F.covar_samp, lambda x, y: _cross(x, y) / (F.size(x) - 1))
two(("COVARIANCE.P", "COVAR"), F.covar_pop, lambda x, y: _cross(x, y) / F.size(x), 1)
two(("SLOPE",), F.regr_slope, lambda y, x: _cross(x, y) / moment(x, 2))
two(("INTERCEPT",), F.regr_intercept, lambda y, x: mean(y) - _cross(x, y) / moment(x, 2) * mean(x))
two(("RSQ",), F.regr_r2, lambda y, x: F.pow(_cross(x, y) / F.sqrt(moment(x, 2) * moment(y, 2)), F.lit(2.0)))
two(("STEYX",), lambda y, x: F.sqrt((F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), F.lit(2.0)) / F.regr_sxx(y, x)) / (F.regr_count(y, x) - 2)), lambda y, x: F.sqrt((moment(y, 2) - F.pow(_cross(x, y), F.lit(2.0)) / moment(x, 2)) / (F.size(x) - 2)), 3)


def _line(ctx, ys: Val, xs: Val | None, log: bool = False) -> tuple[Column, Column]:
    """Slope and intercept."""
    if ys.kind == "range":
        y, x = range_col(ys), range_col(xs)
        y = F.log(y) if log else y
        return ctx.agg(F.regr_slope(y, x)), ctx.agg(F.regr_intercept(y, x))
    y = cells(ys)
    y = F.transform(y, lambda v: F.log(v)) if log else y
    x = cells(xs) if xs is not None and xs.kind != "blank" else F.transform(y, lambda _, i: (i + 1).cast("double"))
    m = _cross(x, y) / moment(x, 2)
    return m, mean(y) - m * mean(x)


@fn("FORECAST.LINEAR", "FORECAST")
def forecast(ctx, a, ys, xs):
    m, b = _line(ctx, ys, xs)
    return number(b + m * num(a))


@fn("TREND")
def trend(ctx, ys, xs=None, new=None):
    m, b = _line(ctx, ys, xs)
    return array(F.transform(cells(new if new is not None else xs), lambda x: b + m * x))


@fn("GROWTH")
def growth(ctx, ys, xs=None, new=None):
    m, b = _line(ctx, ys, xs, True)
    return array(F.transform(cells(new if new is not None else xs), lambda x: F.exp(b + m * x)))


@fn("LINEST")
def linest(ctx, ys, xs=None, *rest):
    return array(F.array(*_line(ctx, ys, xs)))


@fn("LOGEST")
def logest(ctx, ys, xs=None, *rest):
    return array(F.array(*[F.exp(v) for v in _line(ctx, ys, xs, True)]))


@fn("TRIMMEAN")
def trimmean(ctx, a, p):
    s = F.sort_array(values(ctx, a))
    cut = F.floor(F.size(s) * num(p) / 2).cast("int")
    return number(mean(F.slice(s, cut + 1, F.size(s) - 2 * cut)), bad((num(p) < 0) | (num(p) >= 1), "#NUM!"))


@fn("PROB")
def prob(ctx, xs, ps, lo, hi=None):
    z = F.zip_with(cells(xs), cells(ps), lambda x, p: F.when((x >= num(lo)) & (x <= num(hi if hi is not None else lo)), p).otherwise(0.0))
    total = fold(cells(ps), 0, lambda s, x: s + x)
    return number(fold(z, 0, lambda s, x: s + x), bad(F.abs(total - 1) > 1e-9, "#NUM!"))


@fn("FREQUENCY")
def frequency(ctx, data, bins):
    edges = F.sort_array(cells(bins))
    edge = lambda i: F.get(edges, i)
    d = values(ctx, data)
    return array(F.transform(F.sequence(F.lit(0), F.size(edges)), lambda i: F.size(F.filter(d, lambda x: ((i == 0) | (x > edge(i - 1))) & ((i == F.size(edges)) | (x <= edge(i))))).cast("double")))


# ---- criteria ----


def criterion(c: Column, kind: object, v: Val) -> Column:
    """The test that a criterion such as ">=5", "<>x" or "ab*" stands for."""
    x = v.literal
    if not isinstance(x, str):
        return c.try_cast("double") == num(v)
    op, body = re.match(r"(>=|<=|<>|>|<|=)?(.*)", x, re.S).groups()
    try:
        value: object = float(body)
    except ValueError:
        value = None
    if value is not None and op not in (None, "=", "<>"):
        d = c.try_cast("double")
        return {">": d > value, "<": d < value, ">=": d >= value, "<=": d <= value}[op]
    if value is not None:
        same = F.coalesce(c.try_cast("double") == value, F.lit(False))
        return ~same if op == "<>" else same
    if op in (">", "<", ">=", "<="):
        t = F.lower(c.cast("string"))
        return {">": t > body.lower(), "<": t < body.lower(), ">=": t >= body.lower(), "<=": t <= body.lower()}[op]
    if body == "":
        blank = c.isNull() | (c.cast("string") == "")
        return ~blank if op == "<>" else blank
    same = F.coalesce(F.lower(c.cast("string")).rlike(wildcard_pattern(body.lower())) if any(k in body for k in "*?~") else F.lower(c.cast("string")) == body.lower(), F.lit(False))
    return ~same if op == "<>" else same


def _tests(pairs) -> Column:
    tests = [criterion(r.col, r.body, v) for r, v in zip(pairs[::2], pairs[1::2], strict=True)]
    return functools.reduce(lambda a, b: a & b, tests)


def _array_tests(pairs) -> Column:
    """A truth value for each place of the first array, whether all arrays meet their criteria there."""
    arrays = [flat(r) for r in pairs[::2]]
    places = F.sequence(F.lit(0), F.greatest(F.size(arrays[0]) - 1, F.lit(0)))
    at = lambda i: functools.reduce(lambda p, q: p & q, [F.coalesce(criterion(F.get(x, i), r.body, v), F.lit(False)) for x, r, v in zip(arrays, pairs[::2], pairs[1::2], strict=True)])
    return F.transform(F.slice(places, 1, F.size(arrays[0])), at)


def _met(out: Val, pairs) -> Column:
    """The numbers of an array at the places where the pairs' arrays meet their criteria."""
    both = F.arrays_zip(_array_tests(pairs).alias("t"), cells(out).alias("x"))
    return F.transform(F.filter(both, lambda s: s["t"] & s["x"].isNotNull()), lambda s: s["x"])


@fn("COUNTIF", "COUNTIFS")
def countif(ctx, *pairs):
    if pairs[0].kind != "range":
        return number(F.size(F.filter(_array_tests(pairs), lambda x: x)))
    return number(ctx.agg(F.count_if(_tests(pairs))))


def _ifs(name, f, over, empty, last: bool = False):
    """f over a column or over an array of the numbers that meet all criteria; last: the numbers are the third argument."""

    def value(ctx, out, pairs):
        c = ctx.agg(f(F.when(_tests(pairs), range_col(out)))) if out.kind == "range" else over(_met(out, pairs))
        return number(c, bad(c.isNull(), "#DIV/0!")) if empty is None else number(F.coalesce(c, F.lit(empty)))

    if last:
        fn(name)(lambda ctx, r, v, out=None: value(ctx, out or r, (r, v)))
    else:
        fn(name)(lambda ctx, out, r, v, *pairs: value(ctx, out, (r, v, *pairs)))


_total = lambda a: fold(a, 0, lambda s, x: s + x)
_ifs("SUMIF", F.sum, _total, 0.0, True)
_ifs("AVERAGEIF", F.avg, mean, None, True)
_ifs("SUMIFS", F.sum, _total, 0.0)
_ifs("AVERAGEIFS", F.avg, mean, None)
_ifs("MAXIFS", F.max, F.array_max, 0.0)
_ifs("MINIFS", F.min, F.array_min, 0.0)


# ---- database functions: (table, column, criteria rows); the table is the rows themselves or a matrix whose first
# row names columns, the criteria are such a matrix ----


def _literal(x: tuple) -> object:
    return None if x[0] == "blank" else -x[2][1] if x[0] == "pre" else x[1]


def database(names, f, over, empty=None, single: bool = False):
    """f over a column's cells or over an array of a matrix's numbers; single: there must be one cell."""

    @fn(*names, lazy=True)
    def build(ctx, db, field_, criteria, env=None):
        rows = [[_literal(x) for x in r] for r in criteria[1]]
        table = ctx.walk(db, env) if db[0] != "range" else None
        if table is not None and table.kind == "array":  # of one column
            table = Val(F.transform(table.col, lambda x: F.array(x)), kind="matrix", body=table.body)
        inner = table is not None and table.kind == "matrix"
        if inner:
            heads = F.transform(F.get(table.col, 0), lambda x: F.lower(x.cast("string")))
            place = lambda h: F.array_position(heads, F.lit(str(h).lower())).cast("int") - 1
        keep = lambda cell: functools.reduce(lambda a, b: a | b, [functools.reduce(lambda a, b: a & b, [F.coalesce(criterion(cell(h), None, Val(F.lit(float(v)) if isinstance(v, (int, float)) else F.lit(v), kind="num" if isinstance(v, (int, float)) else "str", literal=v)), F.lit(False)) for h, v in zip(rows[0], r, strict=True) if v not in (None, "")], F.lit(True)) for r in rows[1:]])
        wanted = _literal(field_) if field_[0] in ("num", "str", "pre") else field_[2] if field_[0] == "range" else field_[1]
        if inner:
            at = F.lit(int(wanted) - 1) if isinstance(wanted, (int, float)) else place(wanted)
            lost = (at < 0) | (at >= F.size(heads))
            found = F.filter(F.slice(table.col, 2, F.greatest(F.size(table.col) - 1, F.lit(0))), lambda r: keep(lambda h: F.get(r, place(h))))
            items = F.filter(F.transform(found, lambda r: F.get(r, at)), lambda x: x.isNotNull() & (x.cast("string") != ""))
            numbers = F.filter(F.transform(items, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
            n, c = F.size(found), over(items if names == ("DCOUNTA",) else numbers)
        else:
            names_ = ctx.schema.fieldNames()
            name = names_[int(wanted) - 1] if isinstance(wanted, (int, float)) and 1 <= wanted <= len(names_) else wanted
            if name not in names_:
                return number(F.lit(None), F.lit("#VALUE!"))
            lost = F.lit(False)
            cell = F.when(keep(lambda h: F.col(f"`{h}`")), F.col(f"`{name}`"))
            n, c = ctx.agg(F.count_if(keep(lambda h: F.col(f"`{h}`")))), ctx.agg(f(cell))
        if single:
            return number(F.when(n == 1, c), first_error(bad(lost | (n == 0), "#VALUE!"), bad(n > 1, "#NUM!")))
        if empty is None:
            return number(c, first_error(bad(lost, "#VALUE!"), bad(c.isNull(), "#DIV/0!")))
        return number(F.coalesce(c, F.lit(float(empty))), bad(lost, "#VALUE!"))


_d = lambda f: lambda c: f(c.try_cast("double"))
_spread = lambda least, root: lambda a: F.when(F.size(a) > least, (F.sqrt if root else lambda x: x)(moment(a, 2) / (F.size(a) - least)))
database(("DSUM",), _d(F.sum), _total, 0)
database(("DAVERAGE",), _d(F.avg), mean)
database(("DCOUNT",), _d(F.count), F.size, 0)
database(("DCOUNTA",), lambda c: F.count_if(c.isNotNull() & (c.cast("string") != "")), F.size, 0)
database(("DMAX",), _d(F.max), F.array_max, 0)
database(("DMIN",), _d(F.min), F.array_min, 0)
database(("DPRODUCT",), _d(F.product), lambda a: fold(a, 1, lambda s, x: s * x), 1)
database(("DSTDEV",), _d(F.stddev_samp), _spread(1, True))
database(("DSTDEVP",), _d(F.stddev_pop), _spread(0, True))
database(("DVAR",), _d(F.var_samp), _spread(1, False))
database(("DVARP",), _d(F.var_pop), _spread(0, False))
database(("DGET",), _d(F.max), lambda a: F.get(a, 0), single=True)
