"""Lookups in arrays; lookups between tables are joins (operators.joins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.arrays import flat, rows_of, transposed
from tessella.functions.compiler import Val, bad, fn, num, text
from tessella.functions.mathematics import number
from tessella.operators.joins import wildcard_pattern


def _key(needle: Val, hay: Val) -> Column:
    return F.lower(text(needle)) if hay.body == "str" or needle.kind == "str" else num(needle)


def _keys(hay: Column, hay_val: Val, needle: Val) -> Column:
    return F.transform(hay, lambda x: F.lower(x.cast("string"))) if hay_val.body == "str" or needle.kind == "str" else F.transform(hay, lambda x: x.try_cast("double"))


def position(needle: Val, keys: Column, hay: Val, mode: int, last: bool = False) -> Column:
    """1-based place of needle: mode 0 equal, -1 or the next smaller, 1 or the next larger, 2 wildcards; null if none."""
    ks, k = _keys(keys, hay, needle), _key(needle, hay)
    at = F.transform(ks, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    pick = F.array_max if last else F.array_min
    if mode == 2:
        pattern = F.lit(wildcard_pattern(needle.literal)) if isinstance(needle.literal, str) else k
        return pick(F.transform(F.filter(at, lambda s: F.regexp_like(s["x"], pattern)), lambda s: s["i"]))
    same = pick(F.transform(F.filter(at, lambda s: s["x"] == k), lambda s: s["i"]))
    if mode == 0:
        return same
    side = F.filter(at, (lambda s: s["x"] < k) if mode < 0 else (lambda s: s["x"] > k))
    near = (F.array_max if mode < 0 else F.array_min)(F.transform(side, lambda s: s["x"]))
    return F.coalesce(same, pick(F.transform(F.filter(at, lambda s: s["x"] == near), lambda s: s["i"])))


def _found(values: Column, at: Column, hay: Val, missing: Val | None = None) -> Val:
    out = F.get(values, at - 1)
    if missing is not None and missing.kind != "blank":
        return Val(F.coalesce(out, missing.col.cast("string") if hay.body == "str" else missing.col), None, "str" if hay.body == "str" else "num")
    return Val(out, bad(at.isNull(), "#N/A"), "str" if hay.body == "str" else "num")


@fn("VLOOKUP")
def vlookup(ctx, needle, table, index, near=None):
    cols = transposed(rows_of(table))
    mode = 0 if near is not None and near.literal in (False, 0) else -1
    return _found(F.get(cols, num(index).cast("int") - 1), position(needle, F.get(cols, 0), table, mode, last=mode < 0), table)


@fn("HLOOKUP")
def hlookup(ctx, needle, table, index, near=None):
    rows = rows_of(table)
    mode = 0 if near is not None and near.literal in (False, 0) else -1
    return _found(F.get(rows, num(index).cast("int") - 1), position(needle, F.get(rows, 0), table, mode, last=mode < 0), table)


@fn("LOOKUP")
def lookup(ctx, needle, keys, values=None):
    return _found(flat(values if values is not None else keys), position(needle, flat(keys), keys, -1, last=True), values if values is not None else keys)


@fn("MATCH")
def match(ctx, needle, keys, mode=None):
    k = {1: -1, 0: 0, -1: 1}[int(mode.literal) if mode is not None else 1]
    wild = k == 0 and isinstance(needle.literal, str) and any(c in needle.literal for c in "*?~")
    at = position(needle, flat(keys), keys, 2 if wild else k, last=k != 0)
    return number(at, bad(at.isNull(), "#N/A"))


@fn("XMATCH")
def xmatch(ctx, needle, keys, mode=None, search=None):
    at = position(needle, flat(keys), keys, int(mode.literal) if mode is not None and mode.kind != "blank" else 0, search is not None and search.literal == -1)
    return number(at, bad(at.isNull(), "#N/A"))


@fn("XLOOKUP", catches=True)
def xlookup(ctx, needle, keys, values, missing=None, mode=None, search=None):
    at = position(needle, flat(keys), keys, int(mode.literal) if mode is not None and mode.kind != "blank" else 0, search is not None and search.literal == -1)
    return _found(flat(values), at, values, missing)


@fn("INDEX")
def index(ctx, a, r, c=None):
    i = num(r).cast("int")
    kind = "str" if a.body == "str" else "num"
    if a.kind == "matrix":
        out = F.get(F.get(a.col, i - 1), num(c).cast("int") - 1) if c is not None else F.get(a.col, i - 1)
        return Val(out, bad(out.isNull(), "#REF!"), kind if c is not None else "array", a.body)
    j = i if c is None else F.greatest(i, num(c).cast("int"))
    out = F.get(flat(a), j - 1)
    return Val(out, bad(j > F.size(flat(a)), "#REF!"), kind)


@fn("CHOOSE")
def choose(ctx, n, *args):
    from tessella.functions.information import as_kind, merged

    kind = merged(*args)
    i = F.floor(num(n)).cast("int")
    return Val(F.get(F.array(*[as_kind(a, kind) for a in args]), i - 1), bad((i < 1) | (i > len(args)), "#VALUE!"), kind)


@fn("ADDRESS")
def address(ctx, r, c, absolute=None, a1=None, sheet=None):
    k = int(absolute.literal) if absolute is not None and absolute.literal is not None else 1
    n = num(c).cast("int")
    one = lambda x: F.char((x % 26 + 65).cast("int"))
    letters = F.when(n <= 26, one(n - 1)).when(n <= 702, F.concat(one(F.floor((n - 27) / 26)), one((n - 1) % 26))).otherwise(F.concat(one(F.floor((n - 703) / 676)), one(F.floor((n - 27) / 26) % 26), one((n - 1) % 26)))
    out = F.concat(F.lit("$" if k in (1, 3) else ""), letters, F.lit("$" if k in (1, 2) else ""), num(r).cast("int").cast("string"))
    if a1 is not None and a1.literal is False:
        out = F.concat(F.lit("R"), num(r).cast("int").cast("string"), F.lit("C"), n.cast("string"))
    return Val(F.concat(text(sheet), F.lit("!"), out) if sheet is not None else out, None, "str")


@fn("COLUMN")
def column(ctx, a=None):
    names = ctx.schema.fieldNames()
    return number(F.lit(names.index(ctx.row_refs[-1]) + 1 if a is not None and ctx.row_refs else 1))


@fn("ROW")
def row(ctx, a=None):
    return number(F.lit(1))


@fn("OFFSET", "INDIRECT", catches=True)
def dynamic(ctx, *args):
    """References made at run time have no place in a plan: #REF!."""
    return Val(F.lit(None).cast("double"), F.lit("#REF!"), "num")
