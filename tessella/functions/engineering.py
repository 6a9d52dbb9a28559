"""Engineering functions: number bases, bits, error and Bessel functions, complex numbers, units."""

from __future__ import annotations

import cmath
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.compiler import Val, bad, fn, num, text
from tessella.functions.distributions import plain
from tessella.functions.mathematics import number

BASES = {"BIN": 2, "OCT": 8, "HEX": 16, "DEC": 10}


def _from(t, b: int):
    """A number of at most ten digits in two's complement."""
    full = b**10
    x = F.conv(t, b, 10).cast("double")
    return F.when(x >= full / 2, x - full).otherwise(x)


def _bases(a: str, z: str):
    @fn(f"{a}2{z}")
    def build(ctx, v, places=None):
        p, q = BASES[a], BASES[z]
        if p == 10:
            x, wrong = F.floor(num(v)), num(v).isNull()
        else:
            digits = "0123456789abcdef"[:p]
            wrong = ~F.lower(text(v)).rlike(f"^[{digits}]{{1,10}}$")
            x = F.when(~wrong, _from(text(v), p))
        if q == 10:
            return number(x, bad(wrong, "#NUM!"))
        full = q**10
        wrong = wrong | (x >= full / 2) | (x < -full / 2)
        out = F.conv(F.when(x < 0, x + full).otherwise(x).cast("decimal(20,0)").cast("string"), 10, q)
        if places is not None:
            k = num(places).cast("int")
            wrong, out = wrong | ((x >= 0) & (F.length(out) > k)), F.when(x < 0, out).otherwise(F.lpad(out, int(places.literal), "0"))
        return Val(F.when(~wrong, out), bad(wrong, "#NUM!"), "str")


for _a in BASES:
    for _z in BASES:
        if _a != _z:
            _bases(_a, _z)


def _bits(name, f):
    @fn(name)
    def build(ctx, a, b):
        x, y = num(a).cast("long"), num(b).cast("long")
        wrong = (num(a) < 0) | (num(a) >= 2**48) | ((num(b) < 0) | (num(b) >= 2**48) if name in ("BITAND", "BITOR", "BITXOR") else F.abs(num(b)) > 53)
        return number(f(x, y), bad(wrong, "#NUM!"))


_bits("BITAND", lambda x, y: x.bitwiseAND(y))
_bits("BITOR", lambda x, y: x.bitwiseOR(y))
_bits("BITXOR", lambda x, y: x.bitwiseXOR(y))
_bits("BITLSHIFT", lambda x, y: F.floor(x * F.pow(F.lit(2.0), y.cast("double"))))
_bits("BITRSHIFT", lambda x, y: F.floor(x / F.pow(F.lit(2.0), y.cast("double"))))


@fn("DELTA")
def delta(ctx, a, b=None):
    return number((num(a) == (num(b) if b is not None else F.lit(0.0))).cast("double"))


@fn("GESTEP")
def gestep(ctx, a, b=None):
    return number((num(a) >= (num(b) if b is not None else F.lit(0.0))).cast("double"))


plain("ERF")(lambda a, b=None: math.erf(a) if b is None else math.erf(b) - math.erf(a))
plain("ERF.PRECISE")(math.erf)
plain("ERFC", "ERFC.PRECISE")(math.erfc)


def _integral(f, hi: float, n: int = 2000) -> float:
    """Simpson's rule from 0 to hi."""
    x = np.linspace(0, hi, n + 1)
    y = f(x)
    return float(hi / n / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))


def bessel_j(x, n):
    k = math.floor(n)
    if k < 0:
        raise ValueError
    return _integral(lambda t: np.cos(k * t - x * np.sin(t)), math.pi) / math.pi


def bessel_i(x, n):
    k = math.floor(n)
    if k < 0:
        raise ValueError
    return _integral(lambda t: np.exp(x * np.cos(t)) * np.cos(k * t), math.pi) / math.pi


def bessel_k(x, n):
    k = math.floor(n)
    if k < 0 or x <= 0:
        raise ValueError
    top = math.acosh(1 + 750 / x)
    return _integral(lambda t: np.exp(-x * np.cosh(t)) * np.cosh(k * t), min(top, 40.0), 8000)


def bessel_y(x, n):
    k = math.floor(n)
    if k < 0 or x <= 0:
        raise ValueError
    first = _integral(lambda t: np.sin(x * np.sin(t) - k * t), math.pi, 4000)
    top = math.asinh(750 / x)
    second = _integral(lambda t: (np.exp(k * t - x * np.sinh(t)) + (-1) ** k * np.exp(-k * t - x * np.sinh(t))), min(top, 40.0), 20000)
    return (first - second) / math.pi


for _n, _f in (("BESSELJ", bessel_j), ("BESSELI", bessel_i), ("BESSELK", bessel_k), ("BESSELY", bessel_y)):
    plain(_n)(_f)


# ---- complex numbers, as text ----

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def parse_complex(t: object) -> complex:
    s = str(t).replace(" ", "")
    if m := re.fullmatch(rf"({_NUMBER})", s):
        return complex(float(m[1]), 0)
    if m := re.fullmatch(rf"({_NUMBER})?((?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|[+-])?[ij]", s):
        real, imag = m[1], m[2]
        if imag is None:
            real, imag = None, real or "1"
        return complex(float(real or 0), float(imag + "1" if imag in ("+", "-") else imag))
    raise ValueError(s)


def say_complex(z: complex) -> str:
    one = lambda x: f"{x:.15g}"
    if z.imag == 0:
        return one(z.real)
    part = "" if z.imag == 1 else "-" if z.imag == -1 else one(z.imag)
    return (one(z.real) if z.real else "") + ("+" if z.real and z.imag > 0 else "") + part + "i"


def _complex(names, f, kind: str = "string"):
    @F.pandas_udf(T.StringType() if kind == "string" else T.DoubleType())
    def run(*cols: pd.Series) -> pd.Series:
        out = []
        for args in zip(*cols, strict=True):
            try:
                z = f(*[parse_complex(a) for a in args])
                out.append(say_complex(complex(z)) if kind == "string" else float(z))
            except (ValueError, ZeroDivisionError, OverflowError, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object if kind == "string" else "Float64")

    @fn(*names)
    def build(ctx, *args):
        c = run(*[text(a) for a in args])
        return Val(c, bad(c.isNull(), "#NUM!"), "str" if kind == "string" else "num")


for _names, _f in {
    ("IMCONJUGATE",): lambda z: z.conjugate(), ("IMEXP",): cmath.exp, ("IMLN",): cmath.log, ("IMLOG10",): cmath.log10, ("IMLOG2",): lambda z: cmath.log(z) / math.log(2), ("IMSQRT",): cmath.sqrt,
    ("IMSUB",): lambda a, b: a - b, ("IMDIV",): lambda a, b: a / b, ("IMSUM",): lambda *a: sum(a), ("IMPRODUCT",): lambda *a: math.prod(a), ("IMPOWER",): lambda a, b: a**b,
    ("IMCOS",): cmath.cos, ("IMSIN",): cmath.sin, ("IMTAN",): cmath.tan, ("IMCOSH",): cmath.cosh, ("IMSINH",): cmath.sinh, ("IMSEC",): lambda z: 1 / cmath.cos(z), ("IMCSC",): lambda z: 1 / cmath.sin(z),
    ("IMSECH",): lambda z: 1 / cmath.cosh(z), ("IMCSCH",): lambda z: 1 / cmath.sinh(z), ("IMCOT",): lambda z: cmath.cos(z) / cmath.sin(z),
}.items():
    _complex(_names, _f)
for _names, _f in {("IMREAL",): lambda z: z.real, ("IMAGINARY",): lambda z: z.imag, ("IMABS",): abs, ("IMARGUMENT",): cmath.phase}.items():
    _complex(_names, _f, "double")


@F.pandas_udf(T.StringType())
def _say(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([say_complex(complex(x, y)) for x, y in zip(a, b, strict=True)])


@fn("COMPLEX")
def complex_(ctx, a, b, suffix=None):
    c = _say(num(a), num(b))
    return Val(c if suffix is None else F.replace(c, F.lit("i"), text(suffix)), None, "str")


#: Units of CONVERT in terms of a base unit of their kind.
UNITS = {
    "mass": {"g": 1.0, "sg": 14593.902937206, "lbm": 453.59237, "u": 1.66053906660e-24, "ozm": 28.349523125, "grain": 0.06479891, "cwt": 45359.237, "stone": 6350.29318, "ton": 907184.74, "uk_ton": 1016046.9088},
    "length": {"m": 1.0, "mi": 1609.344, "Nmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10, "ell": 1.143, "ly": 9460730472580800.0, "pc": 3.0856775814913673e16, "Pica": 0.0254 / 72, "pica": 0.0254 / 6, "survey_mi": 1609.3472186944},
    "time": {"sec": 1.0, "s": 1.0, "mn": 60.0, "min": 60.0, "hr": 3600.0, "day": 86400.0, "d": 86400.0, "yr": 31557600.0},
    "pressure": {"Pa": 1.0, "p": 1.0, "atm": 101325.0, "at": 101325.0, "mmHg": 133.322, "psi": 6894.757293168, "Torr": 101325 / 760},
    "force": {"N": 1.0, "dyn": 1e-5, "dy": 1e-5, "lbf": 4.4482216152605, "pond": 0.00980665},
    "energy": {"J": 1.0, "e": 1e-7, "c": 4.184, "cal": 4.1868, "eV": 1.602176634e-19, "ev": 1.602176634e-19, "HPh": 2684519.537696173, "hh": 2684519.537696173, "Wh": 3600.0, "wh": 3600.0, "flb": 1.3558179483314, "BTU": 1055.05585262, "btu": 1055.05585262},
    "power": {"W": 1.0, "w": 1.0, "HP": 745.69987158227, "h": 745.69987158227, "PS": 735.49875},
    "magnetism": {"T": 1.0, "ga": 1e-4},
    "volume": {"l": 1.0, "L": 1.0, "lt": 1.0, "tsp": 0.00492892159375, "tbs": 0.01478676478125, "oz": 0.0295735295625, "cup": 0.2365882365, "pt": 0.473176473, "us_pt": 0.473176473, "uk_pt": 0.56826125, "qt": 0.946352946, "gal": 3.785411784, "uk_gal": 4.54609, "m3": 1000.0, "ft3": 28.316846592, "in3": 0.016387064, "barrel": 158.987294928},
    "area": {"m2": 1.0, "ha": 10000.0, "ft2": 0.09290304, "in2": 0.00064516, "yd2": 0.83612736, "mi2": 2589988.110336, "us_acre": 4046.8726098742, "uk_acre": 4046.8564224, "ar": 100.0, "Morgen": 2500.0},
    "information": {"bit": 1.0, "byte": 8.0},
    "speed": {"m/s": 1.0, "m/sec": 1.0, "m/h": 1 / 3600, "m/hr": 1 / 3600, "mph": 0.44704, "kn": 1852 / 3600, "admkn": 1853.184 / 3600},
}
#: Decimal and binary prefixes.
PREFIXES = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "e": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24}
BINARY = {"Ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40, "Pi": 2.0**50, "Ei": 2.0**60}
PREFIXABLE = {"g", "u", "m", "ang", "ly", "pc", "sec", "s", "Pa", "p", "atm", "at", "mmHg", "N", "dyn", "dy", "J", "e", "c", "cal", "eV", "ev", "Wh", "wh", "W", "w", "T", "ga", "l", "L", "lt", "m3", "m2", "ar", "bit", "byte", "m/s", "m/sec", "m/h", "m/hr"}
TEMPERATURES = {"C": (1.0, 273.15), "cel": (1.0, 273.15), "F": (5 / 9, 459.67 * 5 / 9), "fah": (5 / 9, 459.67 * 5 / 9), "K": (1.0, 0.0), "kel": (1.0, 0.0), "Rank": (5 / 9, 0.0), "Reau": (1.25, 273.15)}


def unit(name: str) -> tuple[str, float] | None:
    for kind, units in UNITS.items():
        if name in units:
            return kind, units[name]
    for prefix, factor in sorted({**PREFIXES, **BINARY}.items(), key=lambda p: -len(p[0])):
        rest = name.removeprefix(prefix)
        if rest != name and rest in PREFIXABLE and (prefix not in BINARY or rest in ("bit", "byte")):
            kind, scale = unit(rest)
            return kind, scale * factor ** (2 if rest.endswith("2") else 3 if rest.endswith("3") else 1)
    return None


@fn("CONVERT")
def convert(ctx, a, old, new):
    x, p, q = num(a), str(old.literal), str(new.literal)
    if p in TEMPERATURES and q in TEMPERATURES:
        (m, b), (n, c) = TEMPERATURES[p], TEMPERATURES[q]
        return number((x * m + b - c) / n)
    u, v = unit(p), unit(q)
    if not u or not v or u[0] != v[0]:
        return number(F.lit(None), F.lit("#N/A"))
    return number(x * (u[1] / v[1]))

