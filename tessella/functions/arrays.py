"""Array shapes and higher-order functions; a matrix is an array of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.compiler import Val, bad, fn, num
from tessella.functions.mathematics import all_cells, cells, fold, number


def array(c: Column, body: object = "num", err: Column | None = None) -> Val:
    return Val(c, err, "array", body)


def matrix(c: Column, body: object = "num", err: Column | None = None) -> Val:
    return Val(c, err, "matrix", body)


def rows_of(v: Val) -> Column:
    """As a matrix: an array is one row."""
    return v.col if v.kind == "matrix" else F.array(v.col) if v.kind == "array" else F.array(F.array(v.col))


def flat(v: Val) -> Column:
    return F.flatten(v.col) if v.kind == "matrix" else v.col if v.kind == "array" else F.array(v.col)


def transposed(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(F.get(m, 0)) - 1, F.lit(0))), lambda j: F.transform(m, lambda r: F.get(r, j)))


@fn("TRANSPOSE")
def transpose(ctx, a):
    return matrix(transposed(rows_of(a)), a.body)


@fn("TOROW", "TOCOL")
def torow(ctx, a, *rest):
    return array(flat(a), a.body)


@fn("WRAPROWS")
def wraprows(ctx, a, n, pad=None):
    k, x = num(n).cast("int"), flat(a)
    starts = F.sequence(F.lit(0), F.ceil(F.size(x) / k).cast("int") - 1)
    filler = pad.col if pad is not None else F.lit(None)
    return matrix(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when(i * k + j < F.size(x), F.get(x, i * k + j)).otherwise(filler))), a.body)


@fn("WRAPCOLS")
def wrapcols(ctx, a, n, pad=None):
    return matrix(transposed(wraprows(ctx, a, n, pad).col), a.body)


@fn("TAKE")
def take(ctx, a, n, m=None):
    k = num(n).cast("int")
    cut = lambda x, k: F.when(k >= 0, F.slice(x, F.lit(1), k)).otherwise(F.slice(x, F.greatest(F.size(x) + k, F.lit(0)) + 1, F.least(-k, F.size(x))))
    if a.kind == "matrix":
        out = cut(a.col, k)
        return matrix(out if m is None else F.transform(out, lambda r: cut(r, num(m).cast("int"))), a.body)
    return array(cut(flat(a), k), a.body)


@fn("DROP")
def drop(ctx, a, n, m=None):
    cut = lambda x, k: F.when(k >= 0, F.slice(x, F.least(k, F.size(x)) + 1, F.greatest(F.size(x) - k, F.lit(0)))).otherwise(F.slice(x, F.lit(1), F.greatest(F.size(x) + k, F.lit(0))))
    k = num(n).cast("int")
    if a.kind == "matrix":
        out = cut(a.col, k)
        return matrix(out if m is None else F.transform(out, lambda r: cut(r, num(m).cast("int"))), a.body)
    return array(cut(flat(a), k), a.body)


def _at(x: Column, i: Column) -> Column:
    return F.when(i > 0, F.get(x, i - 1)).otherwise(F.get(x, F.size(x) + i))


@fn("CHOOSEROWS")
def chooserows(ctx, a, *ns):
    pick = [_at(rows_of(a) if a.kind == "matrix" else flat(a), num(n).cast("int")) for n in ns]
    return Val(F.array(*pick), None, a.kind, a.body)


@fn("CHOOSECOLS")
def choosecols(ctx, a, *ns):
    return matrix(F.transform(rows_of(a), lambda r: F.array(*[_at(r, num(n).cast("int")) for n in ns])), a.body)


@fn("EXPAND")
def expand(ctx, a, n, m=None, pad=None):
    m0, h, w = rows_of(a), num(n).cast("int"), num(m).cast("int") if m is not None and m.kind != "blank" else F.size(F.get(rows_of(a), 0))
    filler = pad.col if pad is not None else F.lit(None)
    return matrix(F.transform(F.sequence(F.lit(0), h - 1), lambda i: F.transform(F.sequence(F.lit(0), w - 1), lambda j: F.when((i < F.size(m0)) & (j < F.size(F.get(m0, 0))), F.get(F.get(m0, i), j)).otherwise(filler))), a.body)


@fn("HSTACK")
def hstack(ctx, *args):
    out = rows_of(args[0])
    for a in args[1:]:
        out = F.zip_with(out, rows_of(a), lambda x, y: F.concat(x, y))
    return matrix(out, args[0].body)


@fn("VSTACK")
def vstack(ctx, *args):
    return matrix(F.concat(*[rows_of(a) for a in args]), args[0].body)


@fn("SEQUENCE")
def sequence(ctx, n, m=None, start=None, step=None):
    s, d = num(start) if start is not None and start.kind != "blank" else F.lit(1.0), num(step) if step is not None else F.lit(1.0)
    one = lambda k, first: F.transform(F.sequence(F.lit(0), k - 1), lambda i: first + i * d)
    if m is None or m.kind == "blank":
        return array(one(num(n).cast("int"), s))
    w = num(m).cast("int")
    return matrix(F.transform(F.sequence(F.lit(0), num(n).cast("int") - 1), lambda r: F.transform(F.sequence(F.lit(0), w - 1), lambda i: s + (r * w + i) * d)))


@fn("RANDARRAY")
def randarray(ctx, n=None, m=None, lo=None, hi=None, whole=None):
    a, b = num(lo) if lo is not None else F.lit(0.0), num(hi) if hi is not None else F.lit(1.0)
    seed, k = F.rand(), num(n).cast("int") if n is not None else F.lit(1)
    unit = lambda *at: F.pmod(F.xxhash64(seed, *at), F.lit(1 << 30)) / float(1 << 30)
    if whole is not None and whole.literal:
        value = lambda *at: F.floor(a + (b - a + 1) * unit(*at)).cast("double")
    else:
        value = lambda *at: a + (b - a) * unit(*at)
    if m is None or m.kind == "blank":
        return array(F.transform(F.sequence(F.lit(1), k), lambda i: value(i)))
    return matrix(F.transform(F.sequence(F.lit(1), k), lambda i: F.transform(F.sequence(F.lit(1), num(m).cast("int")), lambda j: value(i, j))))


@fn("MUNIT")
def munit(ctx, n):
    k = num(n).cast("int")
    return matrix(F.transform(F.sequence(F.lit(1), k), lambda i: F.transform(F.sequence(F.lit(1), k), lambda j: F.when(i == j, 1.0).otherwise(0.0))))


@fn("MMULT")
def mmult(ctx, a, b):
    left, right = rows_of(a), rows_of(b)
    if b.kind == "array":  # a row, or a column if that is what fits
        right = F.when(F.size(F.get(left, 0)) == F.size(b.col), F.transform(b.col, lambda x: F.array(x))).otherwise(right)
    t = transposed(right)
    dot = lambda r, c: F.aggregate(F.zip_with(r, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return matrix(F.transform(left, lambda r: F.transform(t, lambda c: dot(r, c))), err=bad(F.size(F.get(left, 0)) != F.size(right), "#VALUE!"))


@F.pandas_udf(T.DoubleType())
def _det(m: pd.Series) -> pd.Series:
    return m.map(lambda x: None if x is None else float(np.linalg.det(np.array([list(r) for r in x], float))))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _inv(m: pd.Series) -> pd.Series:
    def one(x):
        try:
            a = np.array([list(r) for r in x], float)
            return None if abs(np.linalg.det(a)) < 1e-14 else np.linalg.inv(a).tolist()
        except (np.linalg.LinAlgError, ValueError, TypeError):
            return None

    return m.map(one)


@fn("MDETERM")
def mdeterm(ctx, a):
    return number(_det(rows_of(a)))


@fn("MINVERSE")
def minverse(ctx, a):
    c = _inv(rows_of(a))
    return matrix(c, err=bad(c.isNull(), "#NUM!"))


@fn("MAP")
def map_(ctx, *args):
    f = ctx.function(args[-1], "str" if args[0].body == "str" else "num")
    if len(args) == 2:
        return Val(F.transform(args[0].col, (lambda r: F.transform(r, lambda x: f(x))) if args[0].kind == "matrix" else (lambda x: f(x))), None, args[0].kind, "num")
    return array(F.zip_with(flat(args[0]), flat(args[1]), lambda x, y: f(x, y)))


@fn("REDUCE")
def reduce(ctx, start, a, f):
    g = ctx.function(f)
    return number(F.aggregate(cells(a), num(start), lambda s, x: g(s, x)))


@fn("SCAN")
def scan(ctx, start, a, f):
    g = ctx.function(f)
    last = lambda s: F.coalesce(F.get(s, F.size(s) - 1), num(start))
    return array(F.aggregate(cells(a), F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(g(last(s), x)))))


@fn("BYROW")
def byrow(ctx, a, f):
    return array(F.transform(rows_of(a), lambda r: ctx.apply(f, [Val(r, kind="array", body="num")]).col))


@fn("BYCOL")
def bycol(ctx, a, f):
    return array(F.transform(transposed(rows_of(a)), lambda r: ctx.apply(f, [Val(r, kind="array", body="num")]).col))


@fn("MAKEARRAY")
def makearray(ctx, n, m, f):
    g = ctx.function(f)
    return matrix(F.transform(F.sequence(F.lit(1), num(n).cast("int")), lambda i: F.transform(F.sequence(F.lit(1), num(m).cast("int")), lambda j: g(i.cast("double"), j.cast("double")))))


@fn("SORT")
def sort(ctx, a, index=None, order=None):
    if a.kind == "range":
        a = array(ctx.agg(F.collect_list(a.col)), a.body)
    return array(F.sort_array(flat(a), not (order is not None and order.literal == -1)), a.body)


@fn("SORTBY")
def sortby(ctx, a, by, order=None):
    z = F.sort_array(F.zip_with(flat(by), flat(a), lambda k, v: F.struct(k.alias("k"), v.alias("v"))), not (order is not None and order.literal == -1))
    return array(F.transform(z, lambda s: s["v"]), a.body)


@fn("UNIQUE")
def unique(ctx, a, *rest):
    if a.kind == "range":
        return array(F.array_sort(ctx.agg(F.collect_set(a.col))), a.body)
    return Val(F.array_distinct(a.col), None, a.kind, a.body)


@fn("FILTER")
def filter_(ctx, a, mask, empty=None):
    z = F.zip_with(flat(a) if a.kind != "matrix" else a.col, flat(mask), lambda v, m: F.struct(v.alias("v"), m.cast("boolean").alias("m")))
    out = F.transform(F.filter(z, lambda s: s["m"]), lambda s: s["v"])
    return Val(out, bad(F.size(out) == 0, "#N/A") if empty is None else None, a.kind, a.body)


@fn("ROWS")
def rows(ctx, a):
    return number(ctx.agg(F.count("*")) if a.kind == "range" else F.size(rows_of(a)))


@fn("COLUMNS")
def columns(ctx, a):
    return number(F.lit(1) if a.kind == "range" else F.size(F.get(rows_of(a), 0)))


def total(a: Val) -> Column:
    return fold(all_cells((a,)), 0, lambda s, x: s + x)
