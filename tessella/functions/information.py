"""Logical and information functions."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tessella.functions.compiler import Val, bad, first_error, fn, num, text, truth
from tessella.functions.mathematics import number


def boolean(c, err=None) -> Val:
    return Val(c, err, "bool")


def _clear(v: Val):
    return F.lit(True) if v.err is None else v.err.isNull()


def merged(*vs: Val) -> str:
    kinds = {v.kind for v in vs if v.kind != "blank"}
    return kinds.pop() if len(kinds) == 1 else "str" if "str" in kinds else "num" if kinds <= {"num", "bool"} else "any"


def as_kind(v: Val, kind: str):
    return text(v) if kind == "str" else num(v) if kind == "num" else v.col


def _err(v: Val):
    return F.lit(None).cast("string") if v.err is None else v.err


@fn("IF", catches=True)
def if_(ctx, test, then=None, other=None):
    then = then or Val(F.lit(True), kind="bool")
    other = other or Val(F.lit(False), kind="bool")
    kind, t = merged(then, other), truth(test)
    picked = F.when(t, _err(then)).otherwise(_err(other))
    return Val(F.when(t, as_kind(then, kind)).otherwise(as_kind(other, kind)), first_error(test.err, picked), kind)


def _many(name, join):
    @fn(name)
    def build(ctx, *args):
        parts = []
        for a in args:
            if a.kind == "range":
                parts.append(ctx.agg((F.bool_and if name == "AND" else F.bool_or)(truth(Val(a.col, kind=a.body)))))
            elif a.kind == "array":
                parts.append((F.forall if name == "AND" else F.exists)(a.col, lambda x: x.cast("boolean")))
            else:
                parts.append(truth(a))
        return boolean(functools.reduce(join, parts))


_many("AND", lambda a, b: a & b)
_many("OR", lambda a, b: a | b)


@fn("XOR")
def xor(ctx, *args):
    return boolean(sum((F.coalesce(truth(a), F.lit(False)).cast("int") for a in args), F.lit(0)) % 2 == 1)


@fn("NOT")
def not_(ctx, a):
    return boolean(~truth(a))


@fn("TRUE")
def true(ctx):
    return boolean(F.lit(True))


@fn("FALSE")
def false(ctx):
    return boolean(F.lit(False))


@fn("IFERROR", catches=True)
def iferror(ctx, a, other):
    kind = merged(a, other)
    return Val(F.when(_clear(a), as_kind(a, kind)).otherwise(as_kind(other, kind)), None if other.err is None else F.when(~_clear(a), other.err), kind)


@fn("IFNA", catches=True)
def ifna(ctx, a, other):
    kind, na = merged(a, other), _err(a).eqNullSafe("#N/A")
    return Val(F.when(na, as_kind(other, kind)).otherwise(as_kind(a, kind)), F.when(na, _err(other)).otherwise(_err(a)), kind)


@fn("IFS", catches=True)
def ifs(ctx, *args):
    pairs = list(zip(args[::2], args[1::2], strict=True))
    kind = merged(*[v for _, v in pairs])
    out, err, none = F, F, F.lit(True)
    for t, v in pairs:
        out, err = out.when(truth(t), as_kind(v, kind)), err.when(truth(t), _err(v))
        none = none & ~F.coalesce(truth(t), F.lit(False))
    return Val(out, first_error(err, bad(none, "#N/A")), kind)


@fn("SWITCH", catches=True)
def switch(ctx, a, *args):
    pairs = list(zip(args[: len(args) // 2 * 2 : 2], args[1::2], strict=True))
    default = args[-1] if len(args) % 2 else None
    kind = merged(*[v for _, v in pairs], *([default] if default else []))
    out, none = F, F.lit(True)
    for t, v in pairs:
        same = ctx.binary("=", a, t).col
        out, none = out.when(same, as_kind(v, kind)), none & ~F.coalesce(same, F.lit(False))
    return Val(out.otherwise(as_kind(default, kind)) if default else out, first_error(a.err, None if default else bad(none, "#N/A")), kind)


@fn("ISERROR", catches=True)
def iserror(ctx, a):
    return boolean(~_clear(a))


@fn("ISERR", catches=True)
def iserr(ctx, a):
    return boolean(~_clear(a) & ~_err(a).eqNullSafe("#N/A"))


@fn("ISNA", catches=True)
def isna(ctx, a):
    return boolean(_err(a).eqNullSafe("#N/A"))


@fn("ISNUMBER", catches=True)
def isnumber(ctx, a):
    return boolean(_clear(a) & a.col.isNotNull() if a.kind == "num" else F.lit(False))


@fn("ISTEXT", catches=True)
def istext(ctx, a):
    return boolean(_clear(a) & a.col.isNotNull() if a.kind == "str" else F.lit(False))


@fn("ISLOGICAL", catches=True)
def islogical(ctx, a):
    return boolean(_clear(a) & a.col.isNotNull() if a.kind == "bool" else F.lit(False))


@fn("ISNONTEXT", catches=True)
def isnontext(ctx, a):
    return boolean(F.lit(True) if a.kind != "str" else a.col.isNull())


@fn("ISBLANK", catches=True)
def isblank(ctx, a):
    return boolean(F.lit(True) if a.kind == "blank" else a.col.isNull() & _clear(a))


@fn("ISEVEN")
def iseven(ctx, a):
    return boolean(F.floor(F.abs(num(a))) % 2 == 0, bad(num(a).isNull(), "#VALUE!"))


@fn("ISODD")
def isodd(ctx, a):
    return boolean(F.floor(F.abs(num(a))) % 2 == 1, bad(num(a).isNull(), "#VALUE!"))


@fn("ISOMITTED", catches=True)
def isomitted(ctx, a):
    return boolean(F.lit(a.kind == "blank"))


@fn("ISFORMULA", "ISREF", catches=True)
def isref(ctx, a):
    return boolean(F.lit(a.kind == "range"))


@fn("N")
def n_(ctx, a):
    return number(F.lit(0.0) if a.kind == "str" else F.unix_date(F.to_date(a.col)) + 25569 if a.kind == "date" else F.coalesce(num(a), F.lit(0.0)))


@fn("NA")
def na(ctx):
    return number(F.lit(None), F.lit("#N/A"))


@fn("TYPE", catches=True)
def type_(ctx, a):
    code = {"num": 1, "date": 1, "blank": 1, "str": 2, "bool": 4, "array": 64, "matrix": 64, "range": 64}.get(a.kind, 1)
    return number(F.when(_clear(a), F.lit(code)).otherwise(16))


#: Numbers of the error codes.
ERROR_NUMBERS = {"#NULL!": 1, "#DIV/0!": 2, "#VALUE!": 3, "#REF!": 4, "#NAME?": 5, "#NUM!": 6, "#N/A": 7}


@fn("ERROR.TYPE", catches=True)
def error_type(ctx, a):
    number_of = F.create_map(*[x for k, v in ERROR_NUMBERS.items() for x in (F.lit(k), F.lit(v))])
    return number(number_of[_err(a)], bad(_clear(a), "#N/A"))


@fn("SHEET", "SHEETS")
def sheet(ctx, *args):
    return number(F.lit(1))


@fn("INFO")
def info(ctx, what):
    known = {"numfile": "1", "osversion": "spark", "recalc": "Automatic", "release": "1", "system": "spark", "directory": "/"}
    v = known.get(str(what.literal).lower())
    return Val(F.lit(v), None if v else F.lit("#VALUE!"), "str")


@fn("WEBSERVICE", "FILTERXML", "CUBEKPIMEMBER", "CUBEMEMBER", "CUBEMEMBERPROPERTY", "CUBERANKEDMEMBER", "CUBESET", "CUBESETCOUNT", "CUBEVALUE", "CELL", "AREAS", "GETPIVOTDATA", "IMAGE", "RTD", catches=True)
def unavailable(ctx, *args):
    """Functions of a spreadsheet's host, which an engine does not have: #NAME?."""
    return Val(F.lit(None).cast("string"), F.lit("#NAME?"), "str")


@fn("FORMULATEXT", catches=True, lazy=True)
def formulatext(ctx, node, env=None):
    return Val(F.lit(_said(node)), None, "str")


def _said(n: tuple) -> str:
    kind = n[0]
    if kind == "str":
        return '"' + n[1].replace('"', '""') + '"'
    if kind == "row":
        return f"[@{n[1]}]"
    if kind == "range":
        return f"{n[1] or ''}[{n[2]}]"
    if kind == "call":
        return f"{n[1]}({','.join(_said(a) for a in n[2])})"
    if kind == "bin":
        return f"{_said(n[2])}{n[1]}{_said(n[3])}"
    if kind == "pre":
        return n[1] + _said(n[2])
    if kind == "post":
        return _said(n[2]) + n[1]
    if kind == "array":
        return "{" + ";".join(",".join(_said(x) for x in r) for r in n[1]) + "}"
    return "" if kind == "blank" else str(n[1]).upper() if kind == "bool" else str(n[1])
