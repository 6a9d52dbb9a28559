"""Text functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.compiler import Val, bad, first_error, fn, num, text, truth
from tessella.functions.mathematics import number


def string(c, err=None) -> Val:
    return Val(c, err, "str")


def _one(name, f):
    @fn(name)
    def build(ctx, a):
        return string(f(text(a)))


_one("UPPER", F.upper)
_one("LOWER", F.lower)
_one("TRIM", lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
_one("CLEAN", lambda t: F.regexp_replace(t, r"[\x00-\x1F]", ""))
_one("PHONETIC", lambda t: t)
_one("ENCODEURL", lambda t: F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")))


@fn("LEN")
def len_(ctx, a):
    return number(F.length(text(a)))


@fn("CONCAT", "CONCATENATE")
def concat(ctx, *args):
    parts = [F.array_join(F.transform(a.col, lambda x: F.coalesce(x.cast("string"), F.lit(""))), "") if a.kind == "array" else text(a) for a in args]
    return string(F.concat(*parts))


@fn("LEFT")
def left(ctx, a, n=None):
    k = num(n) if n is not None else F.lit(1.0)
    return string(F.substring(text(a), 1, F.greatest(k, F.lit(0.0)).cast("int")), bad(k < 0, "#VALUE!"))


@fn("RIGHT")
def right(ctx, a, n=None):
    k = num(n) if n is not None else F.lit(1.0)
    return string(F.right(text(a), k.cast("int")), bad(k < 0, "#VALUE!"))


@fn("MID")
def mid(ctx, a, start, n):
    s, k = num(start), num(n)
    return string(F.substring(text(a), F.greatest(s, F.lit(1.0)).cast("int"), F.greatest(k, F.lit(0.0)).cast("int")), bad((s < 1) | (k < 0), "#VALUE!"))


@fn("FIND")
def find(ctx, needle, hay, start=None):
    at = F.position(text(needle), text(hay), (num(start) if start is not None else F.lit(1.0)).cast("int"))
    return number(at, bad(at == 0, "#VALUE!"))


@fn("SEARCH")
def search(ctx, needle, hay, start=None):
    from tessella.operators.joins import wildcard_pattern

    if isinstance(needle.literal, str) and any(c in needle.literal for c in "*?~"):
        pattern = wildcard_pattern(needle.literal).replace("^", "", 1).removesuffix("$")
        at = F.regexp_instr(text(hay), F.lit(pattern))
    else:
        at = F.position(F.lower(text(needle)), F.lower(text(hay)), (num(start) if start is not None else F.lit(1.0)).cast("int"))
    return number(at, bad(at == 0, "#VALUE!"))


@fn("SUBSTITUTE")
def substitute(ctx, a, old, new, nth=None):
    if nth is None:
        return string(F.when(text(old) == "", text(a)).otherwise(F.replace(text(a), text(old), text(new))))
    parts, k = F.split(text(a), F.concat(F.lit("\\Q"), text(old), F.lit("\\E"))), num(nth).cast("int")
    swap = F.concat(_join(F.slice(parts, F.lit(1), k), text(old)), text(new), _join(F.slice(parts, k + 1, F.greatest(F.size(parts) - k, F.lit(0))), text(old)))
    return string(F.when(F.size(parts) > k, swap).otherwise(text(a)))


def _join(parts, by):
    return F.aggregate(parts, F.lit(None).cast("string"), lambda s, x: F.when(s.isNull(), x).otherwise(F.concat(s, by, x)), lambda s: F.coalesce(s, F.lit("")))


@fn("REPLACE")
def replace(ctx, a, start, n, new):
    s, k, t = num(start).cast("int"), num(n).cast("int"), text(a)
    return string(F.concat(F.substring(t, F.lit(1), s - 1), text(new), F.substring(t, s + k, F.length(t))), bad((s < 1) | (k < 0), "#VALUE!"))


@fn("REPT")
def rept(ctx, a, n):
    return string(F.repeat(text(a), F.greatest(num(n), F.lit(0.0)).cast("int")), bad(num(n) < 0, "#VALUE!"))


@fn("EXACT")
def exact(ctx, a, b):
    return Val(text(a) == text(b), None, "bool")


@fn("PROPER")
def proper(ctx, a):
    words = F.regexp_extract_all(F.lower(text(a)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return string(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), ""))


@F.pandas_udf(T.StringType())
def _chr(codes: pd.Series) -> pd.Series:
    return codes.map(lambda x: chr(int(x)) if x == x and x is not None and 1 <= x <= 0x10FFFF and not 0xD800 <= x <= 0xDFFF else None)


@fn("CHAR", "UNICHAR")
def char(ctx, a):
    c = _chr(num(a))
    return string(c, bad(c.isNull(), "#VALUE!"))


@fn("CODE", "UNICODE")
def code(ctx, a):
    return number(F.ascii(text(a)), bad(text(a) == "", "#VALUE!"))


@fn("T")
def t_(ctx, a):
    return string(a.col if a.kind == "str" else F.lit(""))


@fn("TEXTJOIN")
def textjoin(ctx, by, skip, *args):
    if args[0].kind == "range":
        c = args[0].col.cast("string")
        c = F.when(truth(skip), F.nullif(c, F.lit(""))).otherwise(F.coalesce(c, F.lit("")))
        return string(F.coalesce(ctx.agg(F.listagg(c, text(by))), F.lit("")))
    items = F.flatten(F.array(*[F.transform(a.col, lambda x: F.coalesce(x.cast("string"), F.lit(""))) if a.kind == "array" else F.array(text(a)) for a in args]))
    out = _join(F.when(truth(skip), F.filter(items, lambda x: x != "")).otherwise(items), text(by))
    return string(out, bad(F.length(out) > 32767, "#VALUE!"))


@fn("TEXTSPLIT")
def textsplit(ctx, a, by, rows=None):
    quoted = lambda v: F.concat(F.lit("\\Q"), text(v), F.lit("\\E"))
    if rows is None:
        return Val(F.split(text(a), quoted(by)), None, "array", "str")
    return Val(F.transform(F.split(text(a), quoted(rows)), lambda r: F.split(r, quoted(by))), None, "matrix", "str")


@fn("TEXTBEFORE")
def textbefore(ctx, a, by, nth=None):
    k = num(nth).cast("int") if nth is not None else F.lit(1)
    n = F.size(F.split(text(a), F.concat(F.lit("\\Q"), text(by), F.lit("\\E")))) - 1
    keep = F.when(k < 0, n + k + 1).otherwise(k)
    parts = F.split(text(a), F.concat(F.lit("\\Q"), text(by), F.lit("\\E")))
    return string(_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0))), text(by)), bad((keep < 1) | (keep > n), "#N/A"))


@fn("TEXTAFTER")
def textafter(ctx, a, by, nth=None):
    k = num(nth).cast("int") if nth is not None else F.lit(1)
    parts = F.split(text(a), F.concat(F.lit("\\Q"), text(by), F.lit("\\E")))
    n = F.size(parts) - 1
    skip = F.when(k < 0, n + k + 1).otherwise(k)
    return string(_join(F.slice(parts, F.greatest(skip, F.lit(0)) + 1, F.greatest(n + 1 - skip, F.lit(0))), text(by)), bad((skip < 1) | (skip > n), "#N/A"))


@fn("REGEX.TEST", "REGEXTEST")
def regex_test(ctx, a, pattern):
    return Val(F.regexp_like(text(a), text(pattern)), None, "bool")


@fn("REGEX.EXTRACT", "REGEXEXTRACT")
def regex_extract(ctx, a, pattern, group=None):
    hit = F.regexp_like(text(a), text(pattern))
    return string(F.when(hit, F.regexp_extract(text(a), pattern.literal, int(group.literal) if group is not None else 0)), bad(~hit, "#N/A"))


@fn("REGEX.REPLACE", "REGEXREPLACE")
def regex_replace(ctx, a, pattern, new):
    return string(F.regexp_replace(text(a), text(pattern), text(new)))


def _plain_number(t):
    stripped = F.regexp_replace(t, r"[$€£¥,\s]", "")
    percent = stripped.endswith("%")
    x = F.regexp_replace(stripped, "%$", "").try_cast("double")
    return F.when(percent, x / 100).otherwise(x)


@fn("VALUE")
def value(ctx, a):
    x = num(a) if a.kind != "str" else _plain_number(a.col)
    return number(x, bad(x.isNull(), "#VALUE!"))


@fn("NUMBERVALUE")
def numbervalue(ctx, a, point=None, group=None):
    t = F.replace(text(a), text(group) if group is not None else F.lit(","), F.lit(""))
    t = F.replace(t, text(point) if point is not None else F.lit("."), F.lit("."))
    x = _plain_number(t)
    return number(x, bad(x.isNull(), "#VALUE!"))


def _fixed(x, n: int, commas: bool = True):
    r = F.round(x, n)
    if commas:
        return F.format_number(r, max(n, 0))
    return F.replace(F.format_number(r, max(n, 0)), F.lit(","), F.lit(""))


@fn("FIXED")
def fixed(ctx, a, n=None, plain=None):
    k = int(n.literal) if n is not None else 2
    return string(_fixed(num(a), k) if plain is None else F.when(truth(plain), _fixed(num(a), k, False)).otherwise(_fixed(num(a), k)))


@fn("DOLLAR")
def dollar(ctx, a, n=None):
    k = int(n.literal) if n is not None else 2
    return string(F.concat(F.when(num(a) < 0, F.lit("-$")).otherwise(F.lit("$")), _fixed(F.abs(num(a)), k)))


@fn("TEXT")
def text_(ctx, a, mask):
    m = str(mask.literal)
    if a.kind == "date" or any(c in m.lower() for c in ("yy", "dd", "hh", "ss")):
        out, i = "", 0
        while i < len(m):  # mm is the month, MM the minute
            c, n = m[i], 1
            while i + n < len(m) and m[i + n] == c:
                n += 1
            out += {"m": "M", "M": "m", "d": "d", "y": "y", "h": "H", "H": "H", "s": "s"}.get(c, c) * n
            i += n
        return string(F.date_format(a.col.cast("timestamp"), out))
    percent = m.endswith("%")
    body = m.rstrip("%")
    digits = len(body.split(".")[1]) if "." in body else 0
    x = num(a) * (100 if percent else 1)
    return string(F.concat(_fixed(x, digits, "," in body), F.lit("%" if percent else "")))


def _width(to_full: bool):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            if not to_full:
                return "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else " " if c == "　" else next((h for h in _HALF.get(c, [])), c) for c in t)
            return unicodedata.normalize("NFKC", t).translate(_FULL)

        return s.map(one)

    return run


_FULL = {c: c + 0xFEE0 for c in range(0x21, 0x7F)} | {0x20: 0x3000}
_HALF: dict[str, list[str]] = {}
for _c in range(0xFF61, 0xFFA0):
    _HALF.setdefault(unicodedata.normalize("NFKC", chr(_c)), []).append(chr(_c))


@fn("ASC")
def asc(ctx, a):
    return string(_width(False)(text(a)))


@fn("JIS", "DBCS")
def jis(ctx, a):
    return string(_width(True)(text(a)))


#: Thai digits and places of BAHTTEXT.
THAI_DIGITS = ["ศูนย์", "หนึ่ง", "สอง", "สาม", "สี่", "ห้า", "หก", "เจ็ด", "แปด", "เก้า"]
THAI_PLACES = ["", "สิบ", "ร้อย", "พัน", "หมื่น", "แสน"]


def _thai(n: int) -> str:
    if n >= 1_000_000:
        return _thai(n // 1_000_000) + "ล้าน" + (_thai(n % 1_000_000) if n % 1_000_000 else "")
    digits = [int(d) for d in str(n)]
    out = ""
    for k, d in enumerate(digits):
        place = len(digits) - 1 - k
        if d:
            word = "เอ็ด" if place == 0 and d == 1 and len(digits) > 1 else "" if place == 1 and d == 1 else "ยี่" if place == 1 and d == 2 else THAI_DIGITS[d]
            out += word + THAI_PLACES[place]
    return out or THAI_DIGITS[0]


@F.pandas_udf(T.StringType())
def _baht(x: pd.Series) -> pd.Series:
    def one(v):
        if v != v or v is None:
            return None
        satang = round(abs(v) * 100)
        whole, part = divmod(satang, 100)
        said = (_thai(whole) + "บาท" if whole or not part else "") + (_thai(part) + "สตางค์" if part else "ถ้วน")
        return ("ลบ" if v < 0 else "") + said

    return x.map(one)


@fn("BAHTTEXT")
def bahttext(ctx, a):
    return string(_baht(num(a)))


@fn("VALUETOTEXT")
def valuetotext(ctx, a, strict=None):
    if strict is not None and strict.literal == 1 and a.kind == "str":
        return string(F.concat(F.lit('"'), text(a), F.lit('"')))
    return string(text(a))


@fn("ARRAYTOTEXT")
def arraytotext(ctx, a, strict=None):
    flat = F.flatten(a.col) if a.kind == "matrix" else a.col if a.kind == "array" else F.array(a.col)
    return string(F.array_join(F.transform(flat, lambda x: text(Val(x, kind="num" if a.body == "num" or a.kind == "num" else "str"))), ", "))


@fn("HYPERLINK")
def hyperlink(ctx, link, name=None):
    return string(text(name if name is not None else link), first_error(link.err))
