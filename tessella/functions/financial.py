"""Financial functions: closed forms as columns, solvers and schedules by pandas functions."""

from __future__ import annotations

import calendar
import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.compiler import Val, bad, fn, num
from tessella.functions.datetimes import date, day, year_fraction
from tessella.functions.distributions import plain, rows
from tessella.functions.mathematics import cells, fold, number
from tessella.functions.statistics import values


def opt(v: Val | None, default: float) -> Column:
    return num(v) if v is not None and v.kind != "blank" else F.lit(float(default))


def annuity(r: Column, n: Column, when: Column) -> Column:
    """What 1 a period is worth at the end."""
    return F.when(r == 0, n).otherwise((F.pow(1 + r, n) - 1) / F.nullif(r, F.lit(0.0)) * (1 + r * when))


def pmt(r: Column, n: Column, pv: Column, fv: Column, when: Column) -> Column:
    return -(pv * F.pow(1 + r, n) + fv) / annuity(r, n, when)


def future(r: Column, n: Column, p: Column, pv: Column, when: Column) -> Column:
    return -(pv * F.pow(1 + r, n) + p * annuity(r, n, when))


@fn("PMT")
def pmt_(ctx, r, n, pv, fv=None, when=None):
    return number(pmt(num(r), num(n), num(pv), opt(fv, 0), opt(when, 0)), bad(num(n) == 0, "#NUM!"))


@fn("FV")
def fv_(ctx, r, n, p, pv=None, when=None):
    return number(future(num(r), num(n), num(p), opt(pv, 0), opt(when, 0)))


@fn("PV")
def pv_(ctx, r, n, p, fv=None, when=None):
    return number(-(opt(fv, 0) + num(p) * annuity(num(r), num(n), opt(when, 0))) / F.pow(1 + num(r), num(n)))


@fn("NPER")
def nper(ctx, r, p, pv, fv=None, when=None):
    i, f = num(r), opt(fv, 0)
    a = num(p) * (1 + i * opt(when, 0)) / F.nullif(i, F.lit(0.0))
    return number(F.when(i == 0, -(num(pv) + f) / num(p)).otherwise(F.log((a - f) / (a + num(pv))) / F.log(1 + i)))


def interest(r, k, n, pv, fv, when):
    p = pmt(r, n, pv, fv, when)
    owed = future(r, k - 1, p, pv, when)
    return F.when((when == 1) & (k == 1), 0.0).otherwise(owed * r / F.when(when == 1, 1 + r).otherwise(1.0))


@fn("IPMT")
def ipmt(ctx, r, k, n, pv, fv=None, when=None):
    return number(interest(num(r), num(k), num(n), num(pv), opt(fv, 0), opt(when, 0)), bad((num(k) < 1) | (num(k) > num(n)), "#NUM!"))


@fn("PPMT")
def ppmt(ctx, r, k, n, pv, fv=None, when=None):
    a = (num(r), num(n), num(pv), opt(fv, 0), opt(when, 0))
    return number(pmt(*a) - interest(num(r), num(k), num(n), num(pv), opt(fv, 0), opt(when, 0)), bad((num(k) < 1) | (num(k) > num(n)), "#NUM!"))


def _cumulative(name, principal):
    @fn(name)
    def build(ctx, r, n, pv, start, end, when):
        zero = F.lit(0.0)
        each = lambda k: (pmt(num(r), num(n), num(pv), zero, num(when)) if principal else zero) + (-1 if principal else 1) * interest(num(r), k.cast("double"), num(n), num(pv), zero, num(when))
        return number(fold(F.transform(F.sequence(num(start).cast("int"), num(end).cast("int")), each), 0, lambda s, x: s + x), bad((num(start) < 1) | (num(end) < num(start)), "#NUM!"))


_cumulative("CUMIPMT", False)
_cumulative("CUMPRINC", True)


@fn("ISPMT")
def ispmt(ctx, r, k, n, pv):
    return number(num(pv) * num(r) * (num(k) / num(n) - 1))


@fn("EFFECT")
def effect(ctx, r, n):
    k = F.floor(num(n))
    return number(F.pow(1 + num(r) / k, k) - 1, bad((num(r) <= 0) | (k < 1), "#NUM!"))


@fn("NOMINAL")
def nominal(ctx, r, n):
    k = F.floor(num(n))
    return number(k * (F.pow(1 + num(r), 1 / k) - 1), bad((num(r) <= 0) | (k < 1), "#NUM!"))


@fn("RRI")
def rri(ctx, n, pv, fv):
    return number(F.pow(num(fv) / num(pv), 1 / num(n)) - 1, bad(num(n) <= 0, "#NUM!"))


@fn("PDURATION")
def pduration(ctx, r, pv, fv):
    return number(F.log(num(fv) / num(pv)) / F.log(1 + num(r)), bad((num(r) <= 0) | (num(pv) <= 0) | (num(fv) <= 0), "#NUM!"))


@fn("SLN")
def sln(ctx, cost, salvage, life):
    return number(F.try_divide(num(cost) - num(salvage), num(life)), bad(num(life) == 0, "#DIV/0!"))


@fn("SYD")
def syd(ctx, cost, salvage, life, k):
    return number((num(cost) - num(salvage)) * (num(life) - num(k) + 1) * 2 / (num(life) * (num(life) + 1)), bad((num(k) < 1) | (num(k) > num(life)), "#NUM!"))


@plain("DB")
def db(cost, salvage, life, period, month=12.0):
    rate = round(1 - (salvage / cost) ** (1 / life), 3)
    total, out = 0.0, 0.0
    for k in range(1, int(period) + 1):
        out = cost * rate * month / 12 if k == 1 else (cost - total) * rate * (12 - month) / 12 if k == int(life) + 1 else (cost - total) * rate
        total += out
    return out


@plain("DDB")
def ddb(cost, salvage, life, period, factor=2.0):
    if not 1 <= period <= life:
        raise ValueError
    total, out = 0.0, 0.0
    for _ in range(int(period)):
        out = max(0.0, min((cost - total) * factor / life, cost - salvage - total))
        total += out
    return out


@plain("VDB")
def vdb(cost, salvage, life, start, end, factor=2.0, no_switch=0.0):
    if start > end or end > life:
        raise ValueError
    book, out = cost, 0.0
    for k in range(math.ceil(end)):
        d = book * factor / life
        if not no_switch:
            d = max(d, (book - salvage) / (life - k))
        d = max(0.0, min(d, book - salvage))
        out += d * max(0.0, min(end, k + 1) - max(start, k))
        book -= d
    return out


def newton(f, x: float, tries: int = 100) -> float:
    for _ in range(tries):
        y, h = f(x), 1e-7 * max(1.0, abs(x))
        slope = (f(x + h) - f(x - h)) / (2 * h)
        if slope == 0 or not math.isfinite(slope):
            raise ValueError
        nxt = x - y / slope
        if abs(nxt - x) < 1e-12 * max(1.0, abs(nxt)):
            return nxt
        x = max(nxt, -0.999999)
    raise ValueError


@plain("RATE")
def rate(n, p, pv, fv=0.0, when=0.0, guess=0.1):
    def f(r):
        if abs(r) < 1e-12:
            return pv + p * n + fv
        g = (1 + r) ** n
        return pv * g + p * (1 + r * when) * (g - 1) / r + fv

    return newton(f, guess)


@fn("NPV")
def npv(ctx, r, *flows):
    a = F.flatten(F.array(*[values(ctx, f) if f.kind == "range" else cells(f) for f in flows]))
    return number(fold(F.transform(a, lambda v, i: v / F.pow(1 + num(r), i + 1)), 0, lambda s, x: s + x))


@F.pandas_udf(T.DoubleType())
def _irr(flows: pd.Series, guess: pd.Series) -> pd.Series:
    def one(c, g):
        try:
            a = np.array(c, float)
            k = np.arange(len(a))
            return newton(lambda r: float((a / (1 + r) ** k).sum()), g)
        except (ValueError, OverflowError, TypeError):
            return None

    return pd.Series([one(c, g) for c, g in zip(flows, guess, strict=True)], dtype="Float64")


@fn("IRR")
def irr(ctx, flows, guess=None):
    c = _irr(values(ctx, flows), opt(guess, 0.1))
    return number(c, bad(c.isNull(), "#NUM!"))


def _days(v: Val) -> Column:
    """Dates of an array as days."""
    return F.transform(v.col, lambda d: F.unix_date(d.cast("date")).cast("double") if v.body == "str" else d.try_cast("double"))


@F.pandas_udf(T.DoubleType())
def _xirr(flows: pd.Series, days: pd.Series, guess: pd.Series) -> pd.Series:
    def one(c, d, g):
        try:
            a, t = np.array(c, float), np.array(d, float)
            return newton(lambda r: float((a / (1 + r) ** ((t - t[0]) / 365)).sum()), g)
        except (ValueError, OverflowError, TypeError, IndexError):
            return None

    return pd.Series([one(*x) for x in zip(flows, days, guess, strict=True)], dtype="Float64")


@fn("XIRR")
def xirr(ctx, flows, dates, guess=None):
    c = _xirr(cells(flows), _days(dates), opt(guess, 0.1))
    return number(c, bad(c.isNull(), "#NUM!"))


@fn("XNPV")
def xnpv(ctx, r, flows, dates):
    d = _days(dates)
    z = F.zip_with(cells(flows), d, lambda c, t: c / F.pow(1 + num(r), (t - F.get(d, 0)) / 365))
    return number(fold(z, 0, lambda s, x: s + x))


@fn("MIRR")
def mirr(ctx, flows, finance, reinvest):
    a = cells(flows)
    n = F.size(a)
    gain = fold(F.transform(a, lambda v, i: F.when(v > 0, v * F.pow(1 + num(reinvest), n - 1 - i)).otherwise(0.0)), 0, lambda s, x: s + x)
    cost = fold(F.transform(a, lambda v, i: F.when(v < 0, v / F.pow(1 + num(finance), i)).otherwise(0.0)), 0, lambda s, x: s + x)
    return number(F.pow(-gain / cost, 1 / (n - 1)) - 1, bad((gain == 0) | (cost == 0), "#DIV/0!"))


@fn("DOLLARDE")
def dollarde(ctx, x, base):
    b = F.floor(num(base))
    p = F.pow(F.lit(10.0), F.ceil(F.log10(b)))
    whole = F.signum(num(x)) * F.floor(F.abs(num(x)))
    return number(whole + (num(x) - whole) * p / b, bad(b < 1, "#DIV/0!"))


@fn("DOLLARFR")
def dollarfr(ctx, x, base):
    b = F.floor(num(base))
    p = F.pow(F.lit(10.0), F.ceil(F.log10(b)))
    whole = F.signum(num(x)) * F.floor(F.abs(num(x)))
    return number(whole + (num(x) - whole) * b / p, bad(b < 1, "#DIV/0!"))


def _basis(v: Val | None) -> int:
    return int(v.literal) if v is not None and v.literal is not None else 0


def _yf(a: Val, b: Val, basis: Val | None) -> Column:
    return year_fraction(day(a), day(b), _basis(basis))


@fn("ACCRINTM")
def accrintm(ctx, issue, settle, r, par=None, basis=None):
    return number(opt(par, 1000) * num(r) * _yf(issue, settle, basis))


@fn("ACCRINT")
def accrint(ctx, issue, first, settle, r, par, freq, basis=None, *rest):
    return number(num(par) * num(r) * _yf(issue, settle, basis))


@fn("DISC")
def disc(ctx, settle, mature, price, redeem, basis=None):
    return number((num(redeem) - num(price)) / num(redeem) / _yf(settle, mature, basis))


@fn("INTRATE")
def intrate(ctx, settle, mature, invest, redeem, basis=None):
    return number((num(redeem) - num(invest)) / num(invest) / _yf(settle, mature, basis))


@fn("RECEIVED")
def received(ctx, settle, mature, invest, discount, basis=None):
    return number(num(invest) / (1 - num(discount) * _yf(settle, mature, basis)))


@fn("PRICEDISC")
def pricedisc(ctx, settle, mature, discount, redeem, basis=None):
    return number(num(redeem) - num(discount) * num(redeem) * _yf(settle, mature, basis))


@fn("YIELDDISC")
def yielddisc(ctx, settle, mature, price, redeem, basis=None):
    return number((num(redeem) / num(price) - 1) / _yf(settle, mature, basis))


@fn("PRICEMAT")
def pricemat(ctx, settle, mature, issue, r, y, basis=None):
    im, sm, is_ = _yf(issue, mature, basis), _yf(settle, mature, basis), _yf(issue, settle, basis)
    return number((100 + im * num(r) * 100) / (1 + sm * num(y)) - is_ * num(r) * 100)


@fn("YIELDMAT")
def yieldmat(ctx, settle, mature, issue, r, price, basis=None):
    im, sm, is_ = _yf(issue, mature, basis), _yf(settle, mature, basis), _yf(issue, settle, basis)
    paid = num(price) / 100 + is_ * num(r)
    return number(((1 + im * num(r)) / paid - 1) / sm)


def _bill(a: Val, b: Val) -> Column:
    return F.datediff(day(b), day(a)).cast("double")


@fn("TBILLEQ")
def tbilleq(ctx, settle, mature, discount):
    return number(365 * num(discount) / (360 - num(discount) * _bill(settle, mature)))


@fn("TBILLPRICE")
def tbillprice(ctx, settle, mature, discount):
    return number(100 * (1 - num(discount) * _bill(settle, mature) / 360))


@fn("TBILLYIELD")
def tbillyield(ctx, settle, mature, price):
    return number((100 - num(price)) / num(price) * 360 / _bill(settle, mature))


# ---- coupons ----


def _coupons(settle: Val, mature: Val, freq: Val) -> tuple[Column, Column, Column]:
    """Coupon dates before and after settlement and how many are to come."""
    s, m, step = day(settle), day(mature), (12 / num(freq)).cast("int")
    left = F.months_between(m, s)
    n = F.ceil(left / step).cast("int")
    n = F.when(F.add_months(m, -(n - 1) * step) <= s, n - 1).otherwise(n)
    return F.add_months(m, -n * step), F.add_months(m, -(n - 1) * step), n


@fn("COUPNUM")
def coupnum(ctx, settle, mature, freq, basis=None):
    return number(_coupons(settle, mature, freq)[2])


@fn("COUPNCD")
def coupncd(ctx, settle, mature, freq, basis=None):
    return date(_coupons(settle, mature, freq)[1])


@fn("COUPPCD")
def couppcd(ctx, settle, mature, freq, basis=None):
    return date(_coupons(settle, mature, freq)[0])


def _span(a: Column, b: Column, basis: int) -> Column:
    return year_fraction(a, b, basis) * 360 if basis in (0, 4) else F.datediff(b, a).cast("double")


@fn("COUPDAYBS")
def coupdaybs(ctx, settle, mature, freq, basis=None):
    return number(_span(_coupons(settle, mature, freq)[0], day(settle), _basis(basis)))


@fn("COUPDAYS")
def coupdays(ctx, settle, mature, freq, basis=None):
    a, b, _ = _coupons(settle, mature, freq)
    k = _basis(basis)
    return number(F.datediff(b, a) if k == 1 else (365 if k == 3 else 360) / num(freq))


@fn("COUPDAYSNC")
def coupdaysnc(ctx, settle, mature, freq, basis=None):
    return number(_span(day(settle), _coupons(settle, mature, freq)[1], _basis(basis)))


def _months(d: dt.date, n: int) -> dt.date:
    k = d.year * 12 + d.month - 1 + n
    y, m = divmod(k, 12)
    return dt.date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def _frac(a: dt.date, b: dt.date, basis: int) -> float:
    """Days between two dates by a basis."""
    if basis in (0, 4):
        d1, d2 = min(a.day, 30), b.day
        d2 = min(d2, 30) if basis == 4 or d1 == 30 else d2
        return (b.year - a.year) * 360 + (b.month - a.month) * 30 + d2 - d1
    return (b - a).days


def _schedule(s: float, m: float, freq: float, basis: float) -> tuple[float, float, int]:
    """Days accrued and days in the coupon period as a share, and coupons to come."""
    settle, mature = (dt.date(1970, 1, 1) + dt.timedelta(int(x)) for x in (s, m))
    if settle >= mature:
        raise ValueError
    step, n = int(12 / freq), 0
    while _months(mature, -n * step) > settle:
        n += 1
    before, after = _months(mature, -n * step), _months(mature, -(n - 1) * step)
    period = (after - before).days if basis == 1 else (365 if basis == 3 else 360) / freq
    return _frac(before, settle, int(basis)) / period, _frac(settle, after, int(basis)) / period, n


def bond_price(s, m, r, y, redeem, freq, basis=0.0):
    done, to_next, n = _schedule(s, m, freq, basis)
    c, g = 100 * r / freq, 1 + y / freq
    if n == 1:
        return (redeem + c) / (1 + to_next * y / freq) - c * done
    return redeem / g ** (n - 1 + to_next) + sum(c / g ** (k + to_next) for k in range(n)) - c * done


def bond_duration(s, m, r, y, freq, basis=0.0):
    _, to_next, n = _schedule(s, m, freq, basis)
    c, g = 100 * r / freq, 1 + y / freq
    flows = [(k + to_next, c + (100 if k == n - 1 else 0)) for k in range(n)]
    worth = sum(v / g**t for t, v in flows)
    return sum(t * v / g**t for t, v in flows) / worth / freq


def bond(name, f):
    @fn(name)
    def build(ctx, settle, mature, *rest):
        c = rows(f)(F.unix_date(day(settle)).cast("double"), F.unix_date(day(mature)).cast("double"), *[num(a) for a in rest])
        return number(c, bad(c.isNull(), "#NUM!"))


bond("PRICE", bond_price)
bond("YIELD", lambda s, m, r, p, redeem, freq, basis=0.0: newton(lambda y: bond_price(s, m, r, y, redeem, freq, basis) - p, r or 0.05))
bond("DURATION", bond_duration)
bond("MDURATION", lambda s, m, r, y, freq, basis=0.0: bond_duration(s, m, r, y, freq, basis) / (1 + y / freq))


def _quasi(at: dt.date, step: int, basis: float, way: int) -> float:
    """Days of the coupon period of step months that begins or ends at a date."""
    if basis == 1:
        return abs((_months(at, way * step) - at).days)
    return (365 if basis == 3 else 360) * step / 12


def odd_last_price(s, m, last, r, y, redeem, freq, basis=0.0):
    settle, mature, before = (dt.date(1970, 1, 1) + dt.timedelta(int(x)) for x in (s, m, last))
    period = _quasi(before, int(12 / freq), basis, 1)
    a, d, left = (_frac(p, q, int(basis)) / period for p, q in ((before, settle), (before, mature), (settle, mature)))
    return (redeem + 100 * r / freq * d) / (1 + left * y / freq) - 100 * r / freq * a


def odd_first_price(s, m, issue, first, r, y, redeem, freq, basis=0.0):
    settle, mature, iss, fst = (dt.date(1970, 1, 1) + dt.timedelta(int(x)) for x in (s, m, issue, first))
    step = int(12 / freq)
    period, n = _quasi(fst, step, basis, -1), 0
    while _months(mature, -n * step) > fst:
        n += 1
    odd, done, left = (_frac(p, q, int(basis)) / period for p, q in ((iss, fst), (iss, settle), (settle, fst)))
    if odd > 1 + 1e-9:
        raise ValueError
    g, c = 1 + y / freq, 100 * r / freq
    return redeem / g ** (n + left) + c * odd / g**left + sum(c / g ** (k + left) for k in range(1, n + 1)) - c * done


def odd(name, f, dates):
    @fn(name)
    def build(ctx, *args):
        days = [F.unix_date(day(a)).cast("double") for a in args[:dates]]
        c = rows(f)(*days, *[num(a) for a in args[dates:]])
        return number(c, bad(c.isNull(), "#NUM!"))


odd("ODDLPRICE", odd_last_price, 3)
odd("ODDLYIELD", lambda s, m, last, r, p, redeem, freq, basis=0.0: newton(lambda y: odd_last_price(s, m, last, r, y, redeem, freq, basis) - p, r or 0.05), 3)
odd("ODDFPRICE", odd_first_price, 4)
odd("ODDFYIELD", lambda s, m, i, f, r, p, redeem, freq, basis=0.0: newton(lambda y: odd_first_price(s, m, i, f, r, y, redeem, freq, basis) - p, r or 0.05), 4)


@fn("AMORLINC")
def amorlinc(ctx, cost, bought, first, salvage, k, r, basis=None):
    whole = num(cost) * num(r)
    part = whole * _yf(bought, first, basis)
    left = num(cost) - num(salvage) - part - whole * (num(k) - 1)
    return number(F.when(num(k) == 0, part).otherwise(F.greatest(F.lit(0.0), F.least(whole, left))))


@fn("AMORDEGRC")
def amordegrc(ctx, cost, bought, first, salvage, k, r, basis=None):
    def run(cost, share, salvage, period, rate):
        life = 1 / rate
        rate *= 1.5 if life <= 4 else 2.0 if life <= 6 else 2.5  # fixed values: the degressive coefficients
        d = round(cost * rate * share)
        book, out = cost - d, float(d)
        for _ in range(int(period)):
            out = float(round(book * rate))
            if book - out < salvage:
                return max(0.0, book - salvage) if book > salvage else 0.0
            book -= out
        return out

    c = rows(run)(num(cost), _yf(bought, first, basis), num(salvage), num(k), num(r))
    return number(c, bad(c.isNull(), "#NUM!"))
