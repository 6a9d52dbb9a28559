"""Date and time functions. Numbers are day serials from 1899-12-30; text is read as a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.compiler import Val, bad, fn, num, text
from tessella.functions.mathematics import number



def epoch() -> Column:
    return F.to_date(F.lit("1899-12-30"))


def stamp(v: Val) -> Column:
    """As a timestamp."""
    if v.kind == "date":
        return v.col.cast("timestamp")
    if v.kind == "str":
        return v.col.try_cast("timestamp")
    return F.timestamp_seconds(F.round((num(v) - 25569) * 86400))


def day(v: Val) -> Column:
    return F.to_date(stamp(v))


def date(c: Column, err: Column | None = None) -> Val:
    return Val(c, err, "date")


def serial(c: Column) -> Column:
    return F.datediff(c, epoch()).cast("double")


@fn("TODAY")
def today(ctx):
    return date(F.current_date())


@fn("NOW")
def now(ctx):
    return date(F.current_timestamp())


for _name, _f in {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "ISOWEEKNUM": F.weekofyear}.items():

    def _part(f):
        def build(ctx, a):
            x = f(stamp(a))
            return number(x, bad(x.isNull(), "#VALUE!"))

        return build

    fn(_name)(_part(_f))


@fn("DATE")
def date_(ctx, y, m, d):
    start = F.add_months(F.make_date(num(y).cast("int"), F.lit(1), F.lit(1)), num(m).cast("int") - 1)
    return date(F.date_add(start, num(d).cast("int") - 1))


@fn("TIME")
def time_(ctx, h, m, s):
    return number(((F.floor(num(h)) % 24) * 3600 + (F.floor(num(m)) % 60) * 60 + F.floor(num(s)) % 60) / 86400)


@fn("DATEVALUE")
def datevalue(ctx, a):
    d = day(a)
    return number(serial(d), bad(d.isNull(), "#VALUE!"))


@fn("TIMEVALUE")
def timevalue(ctx, a):
    t = F.coalesce(F.try_to_timestamp(text(a), F.lit("H:mm:ss")), F.try_to_timestamp(text(a), F.lit("H:mm")), F.try_to_timestamp(F.upper(text(a)), F.lit("h:mm a")), stamp(a))
    return number((F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 86400, bad(t.isNull(), "#VALUE!"))


@fn("WEEKDAY")
def weekday(ctx, a, kind=None):
    k = int(kind.literal) if kind is not None else 1
    monday = F.weekday(day(a))  # 0 to 6 from Monday
    if k == 1 or k == 17:
        return number((monday + 1) % 7 + 1)
    if k == 3:
        return number(monday)
    if k == 2 or k == 11:
        return number(monday + 1)
    if 12 <= k <= 16:
        return number(F.pmod(monday - (k - 11), F.lit(7)) + 1)
    return number(F.lit(None).cast("double"), F.lit("#NUM!"))


@fn("WEEKNUM")
def weeknum(ctx, a, kind=None):
    k = int(kind.literal) if kind is not None else 1
    if k == 21:
        return number(F.weekofyear(day(a)))
    first = F.trunc(day(a), "year")
    shift = F.pmod(F.weekday(first) + 1, F.lit(7)) if k in (1, 17) else F.pmod(F.weekday(first) - (0 if k == 2 else k - 11), F.lit(7))
    return number(F.floor((F.dayofyear(day(a)) - 1 + shift) / 7) + 1)


@fn("DAYS")
def days(ctx, end, start):
    return number(F.datediff(day(end), day(start)))


def days360(a: Column, b: Column, european: bool = False) -> Column:
    """30/360 days; the American rule by default."""
    d1, d2 = F.dayofmonth(a), F.dayofmonth(b)
    if european:
        x, y = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
    else:
        x = F.when(d1 == 31, 30).otherwise(d1)
        y = F.when((d2 == 31) & (x >= 30), 30).otherwise(d2)
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + (y - x)


@fn("DAYS360")
def days360_(ctx, a, b, method=None):
    return number(days360(day(a), day(b), method is not None and bool(method.literal)))


@fn("EDATE")
def edate(ctx, a, n):
    return date(F.add_months(day(a), num(n).cast("int")))


@fn("EOMONTH")
def eomonth(ctx, a, n):
    return date(F.last_day(F.add_months(day(a), num(n).cast("int"))))


def year_fraction(a: Column, b: Column, basis: int) -> Column:
    a, b = F.least(a, b), F.greatest(a, b)
    if basis == 0:
        return days360(a, b) / 360
    if basis == 4:
        return days360(a, b, True) / 360
    d = F.datediff(b, a)
    if basis == 2:
        return d / 360
    if basis == 3:
        return d / 365
    years = F.year(b) - F.year(a) + 1
    span = F.datediff(F.make_date(F.year(b) + 1, F.lit(1), F.lit(1)), F.make_date(F.year(a), F.lit(1), F.lit(1)))
    return d / (span / years)


@fn("YEARFRAC")
def yearfrac(ctx, a, b, basis=None):
    k = int(basis.literal) if basis is not None else 0
    return number(year_fraction(day(a), day(b), k)) if 0 <= k <= 4 else number(F.lit(None).cast("double"), F.lit("#NUM!"))


@fn("DATEDIF")
def datedif(ctx, a, b, unit):
    x, y, u = day(a), day(b), str(unit.literal).upper()
    months = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x) - F.when(F.dayofmonth(y) < F.dayofmonth(x), 1).otherwise(0)
    out = {
        "D": F.datediff(y, x), "M": months, "Y": F.floor(months / 12), "YM": months % 12,
        "MD": F.datediff(y, F.add_months(x, months.cast("int"))), "YD": F.datediff(y, F.add_months(x, (F.floor(months / 12) * 12).cast("int"))),
    }.get(u)
    if out is None:
        return number(F.lit(None).cast("double"), F.lit("#NUM!"))
    return number(out, bad(y < x, "#NUM!"))


#: Weekend codes to days off, Monday first.
WEEKENDS = {1: "0000011", 2: "1000001", 3: "1100000", 4: "0110000", 5: "0011000", 6: "0001100", 7: "0000110", 11: "0000001", 12: "1000000", 13: "0100000", 14: "0010000", 15: "0001000", 16: "0000100", 17: "0000010"}


def _mask(v: Val | None) -> str:
    if v is None or v.kind == "blank":
        return WEEKENDS[1]
    return v.literal if isinstance(v.literal, str) else WEEKENDS[int(v.literal)]


def _works(mask: str, holidays: Val | None):
    free = F.transform(holidays.col, lambda h: h.try_cast("date")) if holidays is not None and holidays.kind == "array" else None

    def test(d: Column) -> Column:
        on = F.substring(F.lit(mask), (F.weekday(d) + 1).cast("int"), F.lit(1)) == "0"
        return on & ~F.coalesce(F.array_contains(free, d), F.lit(False)) if free is not None else on

    return test


def _networkdays(a: Val, b: Val, mask: str, holidays: Val | None) -> Val:
    x, y = day(a), day(b)
    inside = F.filter(F.sequence(F.least(x, y), F.greatest(x, y)), _works(mask, holidays))
    return number(F.size(inside) * F.when(x <= y, 1).otherwise(-1))


@fn("NETWORKDAYS")
def networkdays(ctx, a, b, holidays=None):
    return _networkdays(a, b, WEEKENDS[1], holidays)


@fn("NETWORKDAYS.INTL")
def networkdays_intl(ctx, a, b, weekend=None, holidays=None):
    return _networkdays(a, b, _mask(weekend), holidays)


def _workday(a: Val, n: Val, mask: str, holidays: Val | None) -> Val:
    x, k = day(a), num(n).cast("int")
    most = F.abs(k) * 7 + 400
    ahead = F.filter(F.sequence(F.date_add(x, 1), F.date_add(x, most)), _works(mask, holidays))
    back = F.filter(F.sequence(F.date_sub(x, 1), F.date_sub(x, most)), _works(mask, holidays))
    return date(F.when(k > 0, F.get(ahead, k - 1)).when(k < 0, F.get(back, -k - 1)).otherwise(x))


@fn("WORKDAY")
def workday(ctx, a, n, holidays=None):
    return _workday(a, n, WEEKENDS[1], holidays)


@fn("WORKDAY.INTL")
def workday_intl(ctx, a, n, weekend=None, holidays=None):
    return _workday(a, n, _mask(weekend), holidays)
