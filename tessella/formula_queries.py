"""Queries of the formula language, by category, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalog import query, table
from tessella.functions import compiler
from tessella.functions.compiler import aggregate_formulas, sheet, with_formula


def _add(df, formulas: dict[str, str], keep: list[str], rounded: int | None = None):
    for name, text in formulas.items():
        df = with_formula(df, name, text)
    kinds = dict(df.dtypes)
    return df.select(*keep, *[F.round(n, rounded).alias(n) if rounded is not None and kinds[n] == "double" else F.col(n) for n in formulas])


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS charge, round(l_quantity - floor(l_quantity / 7) * 7, 7) AS m,
       round(power(l_discount + 1, 2), 7) AS p, floor(l_extendedprice) AS whole, round(sign(l_quantity - 25) * ceil(abs(l_quantity - 25) / 2) * 2, 7) AS e FROM lineitem""")
def formula_math(spark, sf_dir):
    f = {"charge": "[@l_extendedprice]*(1-[@l_discount])*(1+[@l_tax])", "m": "MOD([@l_quantity],7)", "p": "([@l_discount]+1)^2", "whole": "INT([@l_extendedprice])", "e": "EVEN([@l_quantity]-25)"}
    return _add(table(spark, sf_dir, "lineitem"), f, ["l_orderkey", "l_linenumber"], 7)


@query("""SELECT p_partkey, upper(left(p_name, 3)) AS head, length(p_name)::DOUBLE AS n, replace(p_brand, '#', '-') AS brand, instr(p_type, ' ')::DOUBLE AS gap, p_brand || ':' || p_size AS tag FROM part WHERE instr(p_type, ' ') > 0
       UNION ALL SELECT p_partkey, upper(left(p_name, 3)), length(p_name), replace(p_brand, '#', '-'), NULL, p_brand || ':' || p_size FROM part WHERE instr(p_type, ' ') = 0""")
def formula_text(spark, sf_dir):
    f = {"head": "UPPER(LEFT([@p_name],3))", "n": "LEN([@p_name])", "brand": 'SUBSTITUTE([@p_brand],"#","-")', "gap": 'FIND(" ",[@p_type])', "tag": '[@p_brand]&":"&[@p_size]'}
    return _add(table(spark, sf_dir, "part"), f, ["p_partkey"])


@query("""SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, isodow(o_orderdate)::DOUBLE AS wd, last_day(o_orderdate::DATE)::VARCHAR AS eom, datediff('day', o_orderdate::DATE, DATE '2000-01-01')::DOUBLE AS age, weekofyear(o_orderdate)::DOUBLE AS wk FROM orders""")
def formula_dates(spark, sf_dir):
    f = {"y": "YEAR([@o_orderdate])", "m": "MONTH([@o_orderdate])", "wd": "WEEKDAY([@o_orderdate],2)", "eom": "EOMONTH([@o_orderdate],0)", "age": "DAYS(DATE(2000,1,1),[@o_orderdate])", "wk": "ISOWEEKNUM([@o_orderdate])"}
    return _add(table(spark, sf_dir, "orders"), f, ["o_orderkey"]).withColumn("eom", F.col("eom").cast("string"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, o_orderstatus = 'F' OR o_totalprice < 1000 AS flag,
       CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS said, CASE WHEN o_custkey % 2 = 0 THEN round(o_totalprice / 2, 4) ELSE -1 END AS half FROM orders""")
def formula_logic(spark, sf_dir):
    f = {"size": 'IFS([@o_totalprice]>300000,"big",[@o_totalprice]>100000,"mid",TRUE,"small")', "flag": 'OR([@o_orderstatus]="F",[@o_totalprice]<1000)', "said": 'SWITCH([@o_orderstatus],"F","done","O","open","other")', "half": "IFERROR([@o_totalprice]/IF(MOD([@o_custkey],2)=0,2,0),-1)"}
    return _add(table(spark, sf_dir, "orders"), f, ["o_orderkey"], 4)


@query("""SELECT round(sum(l_quantity), 4) AS total, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_discount), 8) AS vp, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90,
       round(median(l_quantity), 4) AS med, round(corr(l_quantity, l_extendedprice), 8) AS r, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(skewness(l_quantity), 6) AS skew, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS returned,
       round(sum(l_quantity) FILTER (l_discount >= 0.05), 4) AS cut, round(max(l_tax) FILTER (l_returnflag = 'A'), 4) AS top FROM lineitem""")
def formula_statistics(spark, sf_dir):
    f = {"total": "SUM([l_quantity])", "mean": "AVERAGE([l_extendedprice])", "sd": "STDEV.S([l_quantity])", "vp": "VAR.P([l_discount])", "p90": "PERCENTILE.INC([l_extendedprice],0.9)", "med": "MEDIAN([l_quantity])", "r": "CORREL([l_quantity],[l_extendedprice])",
         "slope": "SLOPE([l_extendedprice],[l_quantity])", "skew": "SKEW([l_quantity])", "returned": 'COUNTIF([l_returnflag],"R")', "cut": 'SUMIF([l_discount],">=0.05",[l_quantity])', "top": 'MAXIFS([l_tax],[l_returnflag],"A")'}
    out = aggregate_formulas(table(spark, sf_dir, "lineitem"), f)
    places = {"sd": 6, "vp": 8, "r": 8, "slope": 6, "skew": 6}
    return out.select(*[F.round(n, places.get(n, 4)).alias(n) for n in f])


@query("""SELECT l_returnflag, round(sum(l_quantity) / count(*), 6) AS per_row, round(exp(avg(ln(l_quantity))), 6) AS geo, round(count(*) / sum(1 / l_quantity), 6) AS har FROM lineitem GROUP BY 1""")
def formula_by_group(spark, sf_dir):
    f = {"per_row": "SUM([l_quantity])/COUNT([l_quantity])", "geo": "GEOMEAN([l_quantity])", "har": "HARMEAN([l_quantity])"}
    out = aggregate_formulas(table(spark, sf_dir, "lineitem"), f, by=["l_returnflag"])
    return out.select("l_returnflag", *[F.round(n, 6).alias(n) for n in f])


@query("SELECT o_orderkey, round(o_totalprice / (SELECT sum(o_totalprice) FROM orders) * 1e6, 4) AS share, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above FROM orders")
def formula_share_of_total(spark, sf_dir):
    return _add(table(spark, sf_dir, "orders"), {"share": "[@o_totalprice]/SUM([o_totalprice])*1000000", "above": "[@o_totalprice]>AVERAGE([o_totalprice])"}, ["o_orderkey"], 4)


@query("""SELECT c_custkey, round(-(c_acctbal * power(1 + 0.05 / 12, 60)) / ((power(1 + 0.05 / 12, 60) - 1) / (0.05 / 12)), 4) AS pay, round(-(c_acctbal * power(1.03, 10)), 4) AS fv, round((c_acctbal - 100) / 5, 4) AS sln, round(power(2.0, 1.0 / (c_nationkey + 1)) - 1, 8) AS rri FROM customer""")
def formula_finance(spark, sf_dir):
    f = {"pay": "PMT(0.05/12,60,[@c_acctbal])", "fv": "FV(0.03,10,0,[@c_acctbal])", "sln": "SLN([@c_acctbal],100,5)", "rri": "RRI([@c_nationkey]+1,1,2)"}
    out = _add(table(spark, sf_dir, "customer"), f, ["c_custkey"])
    return out.select("c_custkey", *[F.round(n, 8 if n == "rri" else 4).alias(n) for n in f])


@query("SELECT p_partkey, upper(to_hex(p_size)) AS hex, to_binary(p_size) AS bin, (p_size & 12)::DOUBLE AS low, round(p_retailprice * 0.45359237, 6) AS kg, round((p_size - 32) * 5.0 / 9, 6) AS c FROM part")
def formula_engineering(spark, sf_dir):
    f = {"hex": "DEC2HEX([@p_size])", "bin": "DEC2BIN([@p_size])", "low": "BITAND([@p_size],12)", "kg": 'CONVERT([@p_retailprice],"lbm","kg")', "c": 'CONVERT([@p_size],"F","C")'}
    return _add(table(spark, sf_dir, "part"), f, ["p_partkey"], 6)


@query("""SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, round(list_max(embedding)::DOUBLE, 4) AS top, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 4) AS squares FROM embeddings""")
def formula_arrays(spark, sf_dir):
    f = {"total": "SUM(embedding)", "top": "MAX(embedding)", "squares": "REDUCE(0,MAP(embedding,LAMBDA(x,x*x)),LAMBDA(a,b,a+b))"}
    return _add(table(spark, sf_dir, "embeddings"), f, ["vec_id"], 4)


@query("""SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' ELSE 'none' END AS letter, ((n_nationkey % 5 + 1) * 10.0)::DOUBLE AS tens, (CASE WHEN n_nationkey >= 20 THEN 3.0 WHEN n_nationkey >= 10 THEN 2.0 ELSE 1.0 END)::DOUBLE AS band FROM nation""")
def formula_lookup(spark, sf_dir):
    f = {"letter": 'XLOOKUP([@n_regionkey],{0,1,2,3},{"a","b","c","d"},"none")', "tens": "INDEX({10,20,30,40,50},MOD([@n_nationkey],5)+1)", "band": "LOOKUP([@n_nationkey],{0,10,20},{1,2,3})"}
    return _add(table(spark, sf_dir, "nation"), f, ["n_nationkey"])


@query("""SELECT round(sum(o_totalprice) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000 OR o_orderstatus = 'P'), 2) AS dsum, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000 OR o_orderstatus = 'P')::DOUBLE AS dcount FROM orders""")
def formula_database(spark, sf_dir):
    criteria = '{"o_orderstatus","o_totalprice";"F",">200000";"P",""}'
    out = aggregate_formulas(table(spark, sf_dir, "orders"), {"dsum": f'DSUM([o_orderkey],"o_totalprice",{criteria})', "dcount": f'DCOUNT([o_orderkey],"o_totalprice",{criteria})'})
    return out.withColumn("dsum", F.round("dsum", 2))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 7) AS net, round(l_extendedprice * (1 - l_discount) * l_tax, 7) AS duty, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS gross FROM lineitem")
def formula_sheet(spark, sf_dir):
    out = sheet(table(spark, sf_dir, "lineitem"), {"gross": "net+duty", "duty": "net*[@l_tax]", "net": "[@l_extendedprice]*(1-[@l_discount])"})
    return out.select("l_orderkey", "l_linenumber", *[F.round(n, 7).alias(n) for n in ("net", "duty", "gross")])


@query("""SELECT event_id, round(0.5 + z / 3000 * (1 + exp(-z * z / 2) + list_sum(list_transform(range(1, 1000), lambda i: (CASE WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(z * i / 1000) * (z * i / 1000) / 2)))) / sqrt(2 * pi()), 9) AS z,
       round(1 - abs(z) / sqrt(10 + z * z) * (1 + c / 2 + 3 * c * c / 8 + 5 * power(c, 3) / 16 + 35 * power(c, 4) / 128), 9) AS t, round(exp(-v / 2) * (1 + v / 2), 9) AS chi,
       round(list_sum(list_transform(range(0, event_id % 5 + 1), lambda k: factorial(5) / (factorial(k::INTEGER) * factorial((5 - k)::INTEGER)) * power(0.3, k) * power(0.7, 5 - k))), 9) AS b
       FROM (SELECT event_id, (value - 50) / 20 AS z, abs(value) AS v, 10 / (10 + power((value - 50) / 20, 2)) AS c FROM events)""")
def formula_distributions(spark, sf_dir):
    f = {"z": "NORM.S.DIST(([@value]-50)/20,TRUE)", "t": "T.DIST.2T(ABS([@value]-50)/20,10)", "chi": "CHISQ.DIST.RT(ABS([@value]),4)", "b": "BINOM.DIST(MOD([@event_id],5),5,0.3,TRUE)"}
    return _add(table(spark, sf_dir, "events"), f, ["event_id"], 9)


@query("""SELECT c_custkey, round(list_reduce(list_prepend(0.01, list_transform(range(0, 60), lambda i: 0.0)), lambda r, x: r - (loan * r - 200 * (1 - power(1 + r, -48))) / (loan - 200 * 48 * power(1 + r, -49))), 8) AS rate,
       round(100 / power(1 + y / 2, 19.5) + list_sum(list_transform(range(1, 21), lambda k: 2.875 / power(1 + y / 2, k - 0.5))) - 2.875 / 2, 8) AS price FROM (SELECT c_custkey, 8000 + abs(c_acctbal) / 100 AS loan, 0.05 + c_nationkey / 1000 AS y FROM customer)""")
def formula_solvers(spark, sf_dir):
    f = {"rate": "RATE(48,-200,8000+ABS([@c_acctbal])/100)", "price": "PRICE(DATE(2008,2,15),DATE(2017,11,15),0.0575,0.05+[@c_nationkey]/1000,100,2,0)"}
    return _add(table(spark, sf_dir, "customer"), f, ["c_custkey"], 8)


def _table_of(spark, sf_dir, name: str, formulas: dict[str, str], keep: list[str], rounded: int = 8):
    """Several formulas per row in one plan."""
    df = table(spark, sf_dir, name)
    out = {n: compiler.compile_formula(text, df.schema)[0] for n, text in formulas.items()}
    cols = [F.round(compiler.value_or_null(v), rounded).alias(n) if v.kind == "num" else compiler.value_or_null(v).alias(n) for n, v in out.items()]
    return df.select(*keep, *cols)


def _columns_of(spark, sf_dir, name: str, formulas: dict[str, str], by: list[str], rounded: int = 6):
    out = aggregate_formulas(table(spark, sf_dir, name), formulas, by=by)
    return out.select(*by, *[F.round(n, rounded).alias(n) for n in formulas])


@query("""SELECT p_partkey, round(sin(x), 8) AS f_sin, round(cos(x), 8) AS f_cos, round(tan(x), 8) AS f_tan, round(asin(u), 8) AS f_asin, round(acos(u), 8) AS f_acos, round(atan(x), 8) AS f_atan, round(atan2(u, x), 8) AS f_atan2,
       round(sinh(u), 8) AS f_sinh, round(cosh(u), 8) AS f_cosh, round(tanh(x), 8) AS f_tanh, round(asinh(x), 8) AS f_asinh, round(acosh(x + 1), 8) AS f_acosh, round(atanh(u), 8) AS f_atanh, round(radians(x), 8) AS f_radians, round(degrees(x), 8) AS f_degrees,
       round(pi() * x, 8) AS f_pi, round(sqrt(pi() * x), 8) AS f_sqrtpi, round(1 / cos(x), 8) AS f_sec, round(1 / sin(x), 8) AS f_csc, round(1 / tan(x), 8) AS f_cot, round(1 / cosh(u), 8) AS f_sech, round(1 / sinh(u), 8) AS f_csch, round(1 / tanh(u), 8) AS f_coth
       FROM (SELECT p_partkey, p_size / 10 AS x, p_size / 60 AS u FROM part)""")
def formula_trigonometry(spark, sf_dir):
    x, u = "([@p_size]/10)", "([@p_size]/60)"
    f = {"sin": f"SIN({x})", "cos": f"COS({x})", "tan": f"TAN({x})", "asin": f"ASIN({u})", "acos": f"ACOS({u})", "atan": f"ATAN({x})", "atan2": f"ATAN2({x},{u})", "sinh": f"SINH({u})", "cosh": f"COSH({u})", "tanh": f"TANH({x})", "asinh": f"ASINH({x})", "acosh": f"ACOSH({x}+1)", "atanh": f"ATANH({u})",
         "radians": f"RADIANS({x})", "degrees": f"DEGREES({x})", "pi": f"PI()*{x}", "sqrtpi": f"SQRTPI({x})", "sec": f"SEC({x})", "csc": f"CSC({x})", "cot": f"COT({x})", "sech": f"SECH({u})", "csch": f"CSCH({u})", "coth": f"COTH({u})"}
    return _table_of(spark, sf_dir, "part", {f"f_{k}": v for k, v in f.items()}, ["p_partkey"])


@query("""SELECT p_partkey, abs(25 - n)::DOUBLE AS f_abs, round(v, 1) AS f_round, trunc(v / 7) AS f_trunc, ceil(v / 7) AS f_roundup, floor(v / 7) AS f_rounddown, round(round(n / 3.0) * 3, 8) AS f_mround, sign(n - 25)::DOUBLE AS f_sign, round(floor(v / 0.5) * 0.5, 8) AS f_floor,
       round(ceil(v / 0.5) * 0.5, 8) AS f_ceiling, (2 * ceil(n / 2.0))::DOUBLE AS f_even, (2 * ceil((n - 1) / 2.0) + 1)::DOUBLE AS f_odd, (n // 7)::DOUBLE AS f_quotient, round(power(n, 1.5), 8) AS f_power, round(sqrt(v), 8) AS f_sqrt, round(exp(n / 10), 6) AS f_exp,
       round(ln(v), 8) AS f_ln, round(log2(v), 8) AS f_log, round(log10(v), 8) AS f_log10, gcd(n, 12)::DOUBLE AS f_gcd, lcm(n, 12)::DOUBLE AS f_lcm, factorial(n % 10)::DOUBLE AS f_fact, (n * (n - 1) / 2)::DOUBLE AS f_combin, (n * (n - 1))::DOUBLE AS f_permut,
       (n + 2.0 * n + 3)::DOUBLE AS f_sum, (n * n + 4.0)::DOUBLE AS f_sumsq, (n * 6.0)::DOUBLE AS f_product, greatest(n, 20)::DOUBLE AS f_max, least(n, 20)::DOUBLE AS f_min, (4.0 * n + 10)::DOUBLE AS f_sumproduct, ((n + 1) * (n + 2) / 2)::DOUBLE AS f_multinomial,
       round(1 + 2 * (n / 10) + 3 * power(n / 10, 2), 6) AS f_seriessum, (n * n - 3)::DOUBLE AS f_sumx2my2, (n * n + 13)::DOUBLE AS f_sumx2py2, ((n - 2) * (n - 2))::DOUBLE AS f_sumxmy2, upper(to_hex(n)) AS f_base, n::DOUBLE AS f_decimal
       FROM (SELECT p_partkey, p_size AS n, p_retailprice AS v FROM part WHERE p_size > 1)""")
def formula_rounding(spark, sf_dir):
    n, v = "[@p_size]", "[@p_retailprice]"
    f = {"abs": f"ABS(25-{n})", "round": f"ROUND({v},1)", "trunc": f"TRUNC({v}/7)", "roundup": f"ROUNDUP({v}/7,0)", "rounddown": f"ROUNDDOWN({v}/7,0)", "mround": f"MROUND({n},3)", "sign": f"SIGN({n}-25)", "floor": f"FLOOR({v},0.5)", "ceiling": f"CEILING({v},0.5)", "even": f"EVEN({n})", "odd": f"ODD({n})",
         "quotient": f"QUOTIENT({n},7)", "power": f"POWER({n},1.5)", "sqrt": f"SQRT({v})", "exp": f"ROUND(EXP({n}/10),6)", "ln": f"LN({v})", "log": f"LOG({v},2)", "log10": f"LOG10({v})", "gcd": f"GCD({n},12)", "lcm": f"LCM({n},12)", "fact": f"FACT(MOD({n},10))", "combin": f"COMBIN({n},2)", "permut": f"PERMUT({n},2)",
         "sum": f"SUM({n},2*{n},3)", "sumsq": f"SUMSQ({n},2)", "product": f"PRODUCT({n},6)", "max": f"MAX({n},20)", "min": f"MIN({n},20)", "sumproduct": f"SUMPRODUCT(EXPAND({{4}},1,1),HSTACK({n}))+10", "multinomial": f"MULTINOMIAL({n},2)", "seriessum": f"ROUND(SERIESSUM({n}/10,0,1,{{1,2,3}}),6)",
         "sumx2my2": f"SUMX2MY2(HSTACK({n},1),HSTACK(2,0))", "sumx2py2": f"SUMX2PY2(HSTACK({n},2),HSTACK(3,0))", "sumxmy2": f"SUMXMY2(HSTACK({n},1),HSTACK(2,1))", "base": f"BASE({n},16)", "decimal": f"DECIMAL(BASE({n},7),7)"}
    df = _table_of(spark, sf_dir, "part", {f"f_{k}": x for k, x in f.items()}, ["p_partkey", "p_size"])
    return df.where("p_size > 1").drop("p_size")


@query("""SELECT p_partkey, lower(p_brand) AS f_lower, right(p_name, 4) AS f_right, substr(p_name, 3, 5) AS f_mid, repeat(left(p_brand, 1), 3) AS f_rept, substr(p_brand, 1, 1) || '**' || substr(p_brand, 4) AS f_replace, p_brand = upper(p_brand) AS f_exact,
       instr(lower(p_name), 'a')::DOUBLE AS f_search, p_name || '/' || p_size AS f_concat, p_name || '/' || p_size AS f_concatenate, p_name || ',' || p_brand AS f_textjoin, chr(64 + p_size % 26) AS f_char, ascii(p_name)::DOUBLE AS f_code, ascii(p_name)::DOUBLE AS f_unicode, chr(945 + p_size % 20) AS f_unichar,
       trim(p_name) AS f_trim, (p_size + 0.5)::DOUBLE AS f_value, p_size::DOUBLE AS f_numbervalue, regexp_matches(p_brand, '[0-9]') AS f_regex_test, regexp_replace(p_brand, '[0-9]', '#', 'g') AS f_regex_replace, split_part(p_name || '-' || p_size, '-', 1) AS f_textbefore, p_size::VARCHAR AS f_textafter,
       p_name AS f_t, length(p_name)::DOUBLE AS f_len, p_size || '%' AS f_text, p_name AS f_clean, replace(p_name, ' ', '%20') AS f_encodeurl, p_size::VARCHAR AS f_valuetotext FROM part WHERE instr(lower(p_name), 'a') > 0 AND NOT contains(p_name, '-')""")
def formula_text_more(spark, sf_dir):
    n, b, z = "[@p_name]", "[@p_brand]", "[@p_size]"
    f = {"lower": f"LOWER({b})", "right": f"RIGHT({n},4)", "mid": f"MID({n},3,5)", "rept": f"REPT(LEFT({b},1),3)", "replace": f'REPLACE({b},2,2,"**")', "exact": f"EXACT({b},UPPER({b}))", "search": f'SEARCH("A",{n})', "concat": f'CONCAT({n},"/",{z})', "concatenate": f'CONCATENATE({n},"/",{z})',
         "textjoin": f'TEXTJOIN(",",TRUE,{n},{b})', "char": f"CHAR(64+MOD({z},26))", "code": f"CODE({n})", "unicode": f"UNICODE({n})", "unichar": f"UNICHAR(945+MOD({z},20))", "trim": f"TRIM({n})", "value": f'VALUE({z}&".5")', "numbervalue": f'NUMBERVALUE({z}&",0",",",".")', "regex_test": f'REGEX.TEST({b},"[0-9]")',
         "regex_replace": f'REGEX.REPLACE({b},"[0-9]","#")', "textbefore": f'TEXTBEFORE({n}&"-"&{z},"-")', "textafter": f'TEXTAFTER({n}&"-"&{z},"-")', "t": f"T({n})", "len": f"LEN({n})", "text": f'TEXT({z}/100,"0%")', "clean": f"CLEAN({n})", "encodeurl": f"ENCODEURL({n})", "valuetotext": f"VALUETOTEXT({z})"}
    out = _table_of(spark, sf_dir, "part", {f"f_{k}": v for k, v in f.items()}, ["p_partkey", "p_name"])
    return out.where("instr(lower(p_name), 'a') > 0 and not contains(p_name, '-')").drop("p_name")


@query("""SELECT event_id, day(ts)::DOUBLE AS f_day, hour(ts)::DOUBLE AS f_hour, minute(ts)::DOUBLE AS f_minute, second(ts)::DOUBLE AS f_second, (ts::DATE + INTERVAL 1 MONTH)::DATE::VARCHAR AS f_edate, make_date(year(ts), month(ts), 1)::VARCHAR AS f_date,
       datediff('day', ts::DATE, DATE '2030-01-01')::DOUBLE AS f_datedif, datesub('year', ts::DATE, DATE '2030-01-01')::DOUBLE AS f_datedif_y, datesub('month', ts::DATE, DATE '2030-01-01')::DOUBLE AS f_datedif_m, ((2030 - year(ts)) * 360 + (1 - month(ts)) * 30 + 1 - least(day(ts), 30))::DOUBLE AS f_days360,
       round(((2030 - year(ts)) * 360 + (1 - month(ts)) * 30 + 1 - least(day(ts), 30)) / 360, 8) AS f_yearfrac, (dayofweek(ts) + 1)::DOUBLE AS f_weekday, (SELECT count(*) FROM range(0, 14) t(k) WHERE isodow(ts::DATE + k::INTEGER) <= 5)::DOUBLE AS f_networkdays,
       (SELECT count(*) FROM range(0, 14) t(k) WHERE isodow(ts::DATE + k::INTEGER) <> 7)::DOUBLE AS f_networkdays_intl, 0.5::DOUBLE AS f_time FROM events""")
def formula_dates_more(spark, sf_dir):
    d, e = "[@ts]", "DATE(2030,1,1)"
    f = {"day": f"DAY({d})", "hour": f"HOUR({d})", "minute": f"MINUTE({d})", "second": f"SECOND({d})", "edate": f"EDATE({d},1)", "date": f"DATE(YEAR({d}),MONTH({d}),1)", "datedif": f'DATEDIF({d},{e},"D")', "datedif_y": f'DATEDIF({d},{e},"Y")', "datedif_m": f'DATEDIF({d},{e},"M")', "days360": f"DAYS360({d},{e})",
         "yearfrac": f"YEARFRAC({d},{e},0)", "weekday": f"WEEKDAY({d})", "networkdays": f"NETWORKDAYS({d},EDATE({d},0)+13)", "networkdays_intl": f'NETWORKDAYS.INTL({d},EDATE({d},0)+13,"0000001")', "time": "TIME(12,0,0)"}
    out = _table_of(spark, sf_dir, "events", {f"f_{k}": v for k, v in f.items()}, ["event_id"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("f_edate", "f_date")})


@query("""WITH l AS (SELECT *, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)
       SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS f_stdevp, round(stddev_samp(l_quantity), 6) AS f_stdev, round(var_samp(l_quantity), 6) AS f_vars, round(var_pop(l_quantity), 6) AS f_varp, round(kurtosis(l_quantity), 6) AS f_kurt, round(covar_pop(l_quantity, l_discount), 6) AS f_covp,
       round(covar_samp(l_quantity, l_discount), 6) AS f_covs, round(regr_r2(l_extendedprice, l_quantity), 6) AS f_rsq, round(regr_intercept(l_extendedprice, l_quantity), 4) AS f_intercept, round(corr(l_quantity, l_tax), 6) AS f_pearson,
       count(*) FILTER (l_quantity > 25 AND l_discount < 0.05)::DOUBLE AS f_countifs, round(avg(l_extendedprice) FILTER (l_quantity > 25), 4) AS f_averageif, round(avg(l_extendedprice) FILTER (l_quantity > 25 AND l_linestatus = 'F'), 4) AS f_averageifs,
       round(min(l_extendedprice) FILTER (l_quantity > 25), 4) AS f_minifs, round(max(l_extendedprice) FILTER (l_quantity > 25), 4) AS f_maxifs, round(sum(l_extendedprice) FILTER (l_quantity > 25 AND l_discount >= 0.05), 2) AS f_sumifs, round(var_pop(l_quantity) * count(*), 4) AS f_devsq,
       min(l_quantity) AS f_min, max(l_quantity) AS f_max, count(*)::DOUBLE AS f_count, count(*)::DOUBLE AS f_counta, 0::DOUBLE AS f_countblank, round(quantile_cont(l_extendedprice, 0.75), 4) AS f_quartile, round(quantile_cont(l_extendedprice, 0.1), 4) AS f_percentile, round(avg(l_quantity), 6) AS f_avg,
       round(sqrt((regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 4) AS f_steyx, round(regr_intercept(l_extendedprice, l_quantity) + 30 * regr_slope(l_extendedprice, l_quantity), 4) AS f_forecast,
       round(sum(l_quantity * l_quantity), 2) AS f_sumsq FROM l GROUP BY 1""")
def formula_statistics_more(spark, sf_dir):
    q, x = "[l_quantity]", "[l_extendedprice]"
    f = {"stdevp": f"STDEV.P({q})", "stdev": f"STDEV({q})", "vars": f"VAR.S({q})", "varp": f"VARP({q})", "kurt": f"KURT({q})", "covp": f"COVARIANCE.P({q},[l_discount])", "covs": f"COVARIANCE.S({q},[l_discount])", "rsq": f"RSQ({x},{q})", "intercept": f"ROUND(INTERCEPT({x},{q}),4)", "pearson": f"PEARSON({q},[l_tax])",
         "countifs": f'COUNTIFS({q},">25",[l_discount],"<0.05")', "averageif": f'ROUND(AVERAGEIF({q},">25",{x}),4)', "averageifs": f'ROUND(AVERAGEIFS({x},{q},">25",[l_linestatus],"F"),4)', "minifs": f'MINIFS({x},{q},">25")', "maxifs": f'MAXIFS({x},{q},">25")', "sumifs": f'ROUND(SUMIFS({x},{q},">25",[l_discount],">=0.05"),2)',
         "devsq": f"ROUND(DEVSQ({q}),4)", "min": f"MIN({q})", "max": f"MAX({q})", "count": f"COUNT({q})", "counta": "COUNTA([l_linestatus])", "countblank": "COUNTBLANK([l_linestatus])", "quartile": f"ROUND(QUARTILE.INC({x},3),4)", "percentile": f"ROUND(PERCENTILE({x},0.1),4)", "avg": f"AVG({q})", "steyx": f"ROUND(STEYX({x},{q}),4)",
         "forecast": f"ROUND(FORECAST.LINEAR(30,{x},{q}),4)", "sumsq": f"ROUND(SUMSQ({q}),2)"}
    return _columns_of(spark, sf_dir, "lineitem", {f"f_{k}": v for k, v in f.items()}, ["l_returnflag"])


@query("""SELECT c_mktsegment, round(avg(c_acctbal) FILTER (c_nationkey > 5), 6) AS f_daverage, count(*) FILTER (c_nationkey > 5)::DOUBLE AS f_dcounta, round(max(c_acctbal) FILTER (c_nationkey > 5), 6) AS f_dmax, round(min(c_acctbal) FILTER (c_nationkey > 5), 6) AS f_dmin,
       round(stddev_samp(c_acctbal) FILTER (c_nationkey > 5), 6) AS f_dstdev, round(stddev_pop(c_acctbal) FILTER (c_nationkey > 5), 6) AS f_dstdevp, round(var_samp(c_acctbal) FILTER (c_nationkey > 5), 4) AS f_dvar, round(var_pop(c_acctbal) FILTER (c_nationkey > 5), 4) AS f_dvarp,
       round(sum(c_acctbal) FILTER (c_nationkey > 5), 4) AS f_dsum, max(c_acctbal) FILTER (c_custkey = 7) AS f_dget, (CASE WHEN count(*) FILTER (c_custkey = 7) = 0 THEN 1 ELSE 7 END)::DOUBLE AS f_dproduct FROM customer GROUP BY 1""")
def formula_database_more(spark, sf_dir):
    f = {n.lower(): f'{n}([c_custkey],"c_acctbal",{{"c_nationkey";">5"}})' for n in ("DAVERAGE", "DCOUNTA", "DMAX", "DMIN", "DSTDEV", "DSTDEVP", "DVAR", "DVARP", "DSUM")}
    f |= {"dvar": f"ROUND({f['dvar']},4)", "dvarp": f"ROUND({f['dvarp']},4)", "dsum": f"ROUND({f['dsum']},4)", "dget": 'DGET([c_custkey],"c_acctbal",{"c_custkey";7})', "dproduct": 'DPRODUCT([c_custkey],"c_custkey",{"c_custkey";7})'}
    return _columns_of(spark, sf_dir, "customer", {f"f_{k}": v for k, v in f.items()}, ["c_mktsegment"])


@query("""SELECT n_nationkey, TRUE AS f_isnumber, TRUE AS f_istext, n_nationkey % 2 = 0 AS f_iseven, n_nationkey % 2 = 1 AS f_isodd, FALSE AS f_isblank, TRUE AS f_islogical, n_nationkey = 0 AS f_iserror, n_regionkey > 3 AS f_isna, n_nationkey = 0 AS f_iserr, 2.0::DOUBLE AS f_type,
       (n_nationkey > 3)::INT::DOUBLE AS f_n, n_nationkey > 3 AND n_regionkey < 3 AS f_and, NOT n_nationkey > 3 AS f_not, (n_nationkey > 3) <> (n_regionkey < 3) AS f_xor, CASE WHEN n_regionkey > 3 THEN -1 ELSE n_regionkey END::DOUBLE AS f_ifna, CASE WHEN n_nationkey = 0 THEN 2 END::DOUBLE AS f_error_type,
       (CASE n_regionkey WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN 9 ELSE -1 END)::DOUBLE AS f_vlookup, (n_nationkey % 3 + 4)::DOUBLE AS f_hlookup, (n_nationkey % 3 + 1)::DOUBLE AS f_match, (CASE WHEN n_nationkey < 10 THEN 1 WHEN n_nationkey < 20 THEN 2 ELSE 3 END)::DOUBLE AS f_xmatch,
       (n_nationkey % 3 * 10 + 10)::DOUBLE AS f_choose, '$' || chr(65 + n_nationkey) || '$' || (n_regionkey + 1) AS f_address, 1.0::DOUBLE AS f_rows, 3.0::DOUBLE AS f_columns, CASE WHEN n_nationkey > 12 THEN 'hi' ELSE 'lo' END AS f_if, TRUE AS f_true, FALSE AS f_false FROM nation""")
def formula_information(spark, sf_dir):
    n, r = "[@n_nationkey]", "[@n_regionkey]"
    f = {"isnumber": f"ISNUMBER({n})", "istext": "ISTEXT([@n_name])", "iseven": f"ISEVEN({n})", "isodd": f"ISODD({n})", "isblank": f"ISBLANK({n})", "islogical": f"ISLOGICAL({n}>1)", "iserror": f"ISERROR(1/{n})", "isna": f"ISNA(IF({r}>3,NA(),1))", "iserr": f"ISERR(1/{n})", "type": "TYPE([@n_name])", "n": f"N({n}>3)",
         "and": f"AND({n}>3,{r}<3)", "not": f"NOT({n}>3)", "xor": f"XOR({n}>3,{r}<3)", "ifna": f"IFNA(IF({r}>3,NA(),{r}),-1)", "error_type": f"IFNA(ERROR.TYPE(1/{n}),\"\")", "vlookup": f"IFERROR(VLOOKUP({r},{{0,7;1,8;2,9}},2,FALSE),-1)", "hlookup": f"HLOOKUP(MOD({n},3),{{0,1,2;4,5,6}},2,FALSE)", "match": f"MATCH(MOD({n},3),{{0,1,2}},0)",
         "xmatch": f"XMATCH({n},{{0,10,20}},-1)", "choose": f"CHOOSE(MOD({n},3)+1,10,20,30)", "address": f"ADDRESS({r}+1,{n}+1)", "rows": f"ROWS(HSTACK({n},1,2))", "columns": f"COLUMNS(HSTACK({n},1,2))", "if": f'IF({n}>12,"hi","lo")', "true": "TRUE()", "false": "FALSE()"}
    f["error_type"] = f"IF({n}=0,ERROR.TYPE(1/{n}),NA())"
    return _table_of(spark, sf_dir, "nation", {f"f_{k}": v for k, v in f.items()}, ["n_nationkey"])


@query("""SELECT vec_id, round(list_min(e), 4) AS f_min, round(list_sort(e)[1], 4) AS f_sort, len(list_distinct(e))::DOUBLE AS f_unique, round(list_sum(e[1:3]), 4) AS f_take, round(list_sum(e[4:]), 4) AS f_drop, round(list_sum(list_transform(e, lambda x: x * x)), 4) AS f_sumsq,
       round(list_sum(list_transform(range(1, len(e) + 1), lambda i: i * e[i])), 4) AS f_sumproduct, round(list_avg(e), 6) AS f_average, round(list_median(e), 6) AS f_median, round(list_sum(list_filter(e, lambda x: x > 0)), 4) AS f_filter, round(list_reverse_sort(e)[2], 6) AS f_large, round(list_sort(e)[2], 6) AS f_small,
       round(list_stddev_pop(e), 6) AS f_stdevp, round(list_var_samp(e), 6) AS f_vars, len(list_filter(e, lambda x: x > 0))::DOUBLE AS f_countif, round(list_sum(list_filter(e, lambda x: x > 0)), 4) AS f_sumif, round(list_max(list_filter(e, lambda x: x < 0)), 6) AS f_maxifs, round(2 * list_sum(e), 4) AS f_vstack,
       round(list_sum(e) + 3, 4) AS f_hstack, round(list_sum(list_transform(e, lambda x: abs(x - list_avg(e)))) / len(e), 6) AS f_avedev, round(quantile_p, 6) AS f_percentile, round(list_kurtosis(e), 4) AS f_kurt, round(list_skewness(e), 4) AS f_skew, (len(e) * (len(e) + 1) / 2)::DOUBLE AS f_sequence, round(list_sum(e), 4) AS f_transpose,
       round(list_sum(e), 4) AS f_byrow, round(list_sum(e), 4) AS f_let FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_aggregate(embedding::DOUBLE[], 'quantile_cont', 0.25) AS quantile_p FROM embeddings)""")
def formula_arrays_more(spark, sf_dir):
    e = "embedding"
    f = {"min": f"ROUND(MIN({e}),4)", "sort": f"ROUND(INDEX(SORT({e}),1),4)", "unique": f"COUNT(UNIQUE({e}))", "take": f"ROUND(SUM(TAKE({e},3)),4)", "drop": f"ROUND(SUM(DROP({e},3)),4)", "sumsq": f"ROUND(SUMSQ({e}),4)", "sumproduct": f"ROUND(SUMPRODUCT({e},SEQUENCE(COUNT({e}))),4)", "average": f"AVERAGE({e})",
         "median": f"MEDIAN({e})", "filter": f"ROUND(SUM(FILTER({e},MAP({e},LAMBDA(x,IF(x>0,1,0))))),4)", "large": f"LARGE({e},2)", "small": f"SMALL({e},2)", "stdevp": f"STDEV.P({e})", "vars": f"VAR.S({e})", "countif": f'COUNTIF({e},">0")', "sumif": f'ROUND(SUMIF({e},">0"),4)', "maxifs": f'MAXIFS({e},{e},"<0")',
         "vstack": f"ROUND(SUM(VSTACK({e},{e})),4)", "hstack": f"ROUND(SUM(HSTACK({e},3)),4)", "avedev": f"AVEDEV({e})", "percentile": f"PERCENTILE.INC({e},0.25)", "kurt": f"ROUND(KURT({e}),4)", "skew": f"ROUND(SKEW({e}),4)", "sequence": f"SUM(SEQUENCE(COUNT({e})))", "transpose": f"ROUND(SUM(TRANSPOSE({e})),4)",
         "byrow": f"ROUND(SUM(BYROW({e},LAMBDA(r,SUM(r)))),4)", "let": f"ROUND(LET(x,SUM({e}),y,x*2,y-x),4)"}
    return _table_of(spark, sf_dir, "embeddings", {f"f_{k}": v for k, v in f.items()}, ["vec_id"], 6)


@query("""SELECT p_partkey, n::DOUBLE AS f_bin2dec, oct AS f_dec2oct, lpad(to_binary(n), 8, '0') AS f_hex2bin, upper(to_hex(n)) AS f_bin2hex, oct AS f_bin2oct, n::DOUBLE AS f_oct2dec, to_binary(n) AS f_oct2bin, upper(to_hex(n)) AS f_oct2hex, n::DOUBLE AS f_hex2dec, oct AS f_hex2oct, (n | 5)::DOUBLE AS f_bitor, xor(n, 5)::DOUBLE AS f_bitxor,
       (n << 3)::DOUBLE AS f_bitlshift, (n >> 2)::DOUBLE AS f_bitrshift, (n = 7)::INT::DOUBLE AS f_delta, (n >= 20)::INT::DOUBLE AS f_gestep, round(n::DOUBLE * 0.3048, 8) AS f_convert FROM
       (SELECT p_partkey, p_size AS n, CASE WHEN p_size >= 8 THEN (p_size // 8)::VARCHAR ELSE '' END || (p_size % 8) AS oct FROM part WHERE p_size > 0 AND p_size < 64)""")
def formula_engineering_more(spark, sf_dir):
    n = "[@p_size]"
    f = {"bin2dec": f"BIN2DEC(DEC2BIN({n}))", "dec2oct": f"DEC2OCT({n})", "hex2bin": f"HEX2BIN(DEC2HEX({n}),8)", "bin2hex": f"BIN2HEX(DEC2BIN({n}))", "bin2oct": f"BIN2OCT(DEC2BIN({n}))", "oct2dec": f"OCT2DEC(DEC2OCT({n}))", "oct2bin": f"OCT2BIN(DEC2OCT({n}))", "oct2hex": f"OCT2HEX(DEC2OCT({n}))",
         "hex2dec": f"HEX2DEC(DEC2HEX({n}))", "hex2oct": f"HEX2OCT(DEC2HEX({n}))", "bitor": f"BITOR({n},5)", "bitxor": f"BITXOR({n},5)", "bitlshift": f"BITLSHIFT({n},3)", "bitrshift": f"BITRSHIFT({n},2)", "delta": f"DELTA({n},7)", "gestep": f"GESTEP({n},20)", "convert": f'CONVERT({n},"ft","m")'}
    return _table_of(spark, sf_dir, "part", {f"f_{k}": v for k, v in f.items()}, ["p_partkey", "p_size"]).where("p_size > 0 and p_size < 64").drop("p_size")


@query("""SELECT n_nationkey, n AS f_imreal, -3.0::DOUBLE AS f_imaginary, round(sqrt(n * n + 9), 8) AS f_imabs, 3.0::DOUBLE AS f_imconjugate, n + 2 AS f_imsum, n - 2 AS f_imsub, 2 * n + 3 AS f_improduct, round((2 * n - 3) / 5, 8) AS f_imdiv, n * n - 9 AS f_impower, round(atan2(-3, n), 8) AS f_imargument,
       round(exp(n / 10) * cos(-0.3), 6) AS f_imexp, round(ln(sqrt(n * n + 9)), 8) AS f_imln, round(log10(sqrt(n * n + 9)), 8) AS f_imlog10, round(log2(sqrt(n * n + 9)), 8) AS f_imlog2, round(sin(n / 10) * cosh(0.3), 8) AS f_imsin, round(cos(n / 10) * cosh(0.3), 8) AS f_imcos, round(sinh(n / 10) * cos(0.3), 6) AS f_imsinh,
       round(cosh(n / 10) * cos(0.3), 6) AS f_imcosh, round(sin(n / 5) / (cos(n / 5) + cosh(0.6)), 8) AS f_imtan, round(sqrt((sqrt(n * n + 9) + n) / 2), 8) AS f_imsqrt, round(2 * cos(n / 10) * cosh(0.3) / (cos(n / 5) + cosh(0.6)), 8) AS f_imsec, round(2 * sin(n / 10) * cosh(0.3) / (cosh(0.6) - cos(n / 5)), 8) AS f_imcsc,
       round(2 * cosh(n / 10) * cos(0.3) / (cosh(n / 5) + cos(0.6)), 8) AS f_imsech, round(2 * sinh(n / 10) * cos(0.3) / (cosh(n / 5) - cos(0.6)), 8) AS f_imcsch, round(sin(n / 5) / (cosh(0.6) - cos(n / 5)), 8) AS f_imcot FROM (SELECT n_nationkey, (n_nationkey + 1)::DOUBLE AS n FROM nation)""")
def formula_complex(spark, sf_dir):
    n = "([@n_nationkey]+1)"
    z, w = f"COMPLEX({n},-3)", f"COMPLEX({n}/10,-0.3)"
    f = {"imreal": f"IMREAL({z})", "imaginary": f"IMAGINARY({z})", "imabs": f"IMABS({z})", "imconjugate": f"IMAGINARY(IMCONJUGATE({z}))", "imsum": f'IMREAL(IMSUM({z},"2+i"))', "imsub": f'IMREAL(IMSUB({z},"2+i"))', "improduct": f'IMREAL(IMPRODUCT({z},"2+i"))', "imdiv": f'IMREAL(IMDIV({z},"2+i"))',
         "impower": f"ROUND(IMREAL(IMPOWER({z},2)),6)", "imargument": f"IMARGUMENT({z})", "imexp": f"ROUND(IMREAL(IMEXP({w})),6)", "imln": f"IMREAL(IMLN({z}))", "imlog10": f"IMREAL(IMLOG10({z}))", "imlog2": f"IMREAL(IMLOG2({z}))", "imsinh": f"ROUND(IMREAL(IMSINH({w})),6)", "imcosh": f"ROUND(IMREAL(IMCOSH({w})),6)",
         "imsqrt": f"IMREAL(IMSQRT({z}))", **{x: f"IMREAL({x.upper()}({w}))" for x in ("imsin", "imcos", "imtan", "imsec", "imcsc", "imsech", "imcsch", "imcot")}}
    return _table_of(spark, sf_dir, "nation", {f"f_{k}": v for k, v in f.items()}, ["n_nationkey"])


@query("""SELECT c_custkey, round(-a * (1 - power(1.01, -24)) / 0.01, 4) AS f_pv, round(ln(1 + a * 0.01 / 500) / ln(1.01), 6) AS f_nper, round(-a * 0.01, 4) AS f_ipmt, round(-(a * 0.01 / (1 - power(1.01, -24)) - a * 0.01), 4) AS f_ppmt, round(a / 1.1 + 2 * a / 1.21, 4) AS f_npv,
       round((a - 100) * (5 - 2 + 1) / 15, 4) AS f_syd, round(power(1 + k / 1200, 12) - 1, 8) AS f_effect, round((power(1 + k / 100, 1 / 12) - 1) * 12, 8) AS f_nominal, round(ln(2) / ln(1 + k / 100), 6) AS f_pduration, round(a * 0.0096, 6) * -1 AS f_ispmt, round(100 * (1 - k / 100 * 62 / 360), 6) AS f_tbillprice,
       round((100 - 90 - k / 10) / (90 + k / 10) * 360 / 62, 6) AS f_tbillyield, round(365 * k / 100 / (360 - k / 100 * 62), 8) AS f_tbilleq, round((100 - 90 - k / 10) / 100 * 4, 6) AS f_disc, round((100 - 90 - k / 10) / (90 + k / 10) * 4, 6) AS f_intrate, round(a / (1 - k / 100 / 4), 4) AS f_received,
       round(100 - 100 * k / 100 / 4, 6) AS f_pricedisc, round((100 - 90 - k / 10) / (90 + k / 10) * 4, 6) AS f_yielddisc, round(a * k / 400, 6) AS f_accrintm, round(1 + k / 16, 8) AS f_dollarde, round(1 + k * 0.16 / 100, 8) AS f_dollarfr, round(a * 0.4, 4) AS f_ddb FROM (SELECT c_custkey, abs(c_acctbal) + 200 AS a, c_nationkey % 15 + 1 AS k FROM customer)""")
def formula_finance_more(spark, sf_dir):
    a, k, s, m = "(ABS([@c_acctbal])+200)", "(MOD([@c_nationkey],15)+1)", "DATE(2008,1,15)", "DATE(2008,4,15)"
    ts, tm = "DATE(2008,3,31)", "DATE(2008,6,1)"
    f = {"pv": f"ROUND(PV(0.01,24,{a}),4)", "nper": f"ROUND(-NPER(0.01,500,{a}),6)", "ipmt": f"ROUND(IPMT(0.01,1,24,{a}),4)", "ppmt": f"ROUND(PPMT(0.01,1,24,{a}),4)", "npv": f"ROUND(NPV(0.1,HSTACK({a},2*{a})),4)", "syd": f"ROUND(SYD({a},100,5,2),4)", "effect": f"EFFECT({k}/100,12)", "nominal": f"NOMINAL({k}/100,12)",
         "pduration": f"ROUND(PDURATION({k}/100,1,2),6)", "ispmt": f"ROUND(ISPMT(0.01,1,25,{a}),6)", "tbillprice": f"ROUND(TBILLPRICE({ts},{tm},{k}/100),6)", "tbillyield": f"ROUND(TBILLYIELD({ts},{tm},90+{k}/10),6)", "tbilleq": f"TBILLEQ({ts},{tm},{k}/100)", "disc": f"ROUND(DISC({s},{m},90+{k}/10,100,0),6)",
         "intrate": f"ROUND(INTRATE({s},{m},90+{k}/10,100,0),6)", "received": f"ROUND(RECEIVED({s},{m},{a},{k}/100,0),4)", "pricedisc": f"ROUND(PRICEDISC({s},{m},{k}/100,100,0),6)", "yielddisc": f"ROUND(YIELDDISC({s},{m},90+{k}/10,100,0),6)", "accrintm": f"ROUND(ACCRINTM({s},{m},{k}/100,{a},0),6)",
         "dollarde": f"DOLLARDE(1+{k}/100,16)", "dollarfr": f"DOLLARFR(1+{k}/100,16)", "ddb": f"ROUND(DDB({a},0,5,1),4)"}
    return _table_of(spark, sf_dir, "customer", {f"f_{k_}": v for k_, v in f.items()}, ["c_custkey"])


@query("""SELECT p_partkey, round(1 - exp(-0.2 * x), 8) AS f_expon, round(1 - exp(-power(x / 3, 2)), 8) AS f_weibull, round(exp(-x * x / 2) / sqrt(2 * pi()), 8) AS f_norm, round(gamma(x + 1), 4) AS f_gamma, round(lgamma(x + 1), 8) AS f_gammaln, round(1 - exp(-x / 2), 8) AS f_chisq, round(exp(-x / 2) * (1 + x / 2), 8) AS f_chisq_rt,
       round(-2 * ln(1 - u), 6) AS f_chisq_inv, round(-2 * ln(u), 6) AS f_chisq_inv_rt, round(0.5 + x / (2 * sqrt(2 + x * x)), 8) AS f_t, round(0.5 - x / (2 * sqrt(2 + x * x)), 8) AS f_t_rt, round(1 - x / sqrt(2 + x * x), 8) AS f_t2, round((2 * u - 1) * sqrt(2 / (4 * u * (1 - u))), 6) AS f_t_inv,
       round(sqrt(2 * (1 - u) * (1 - u) / (1 - (1 - u) * (1 - u))), 6) AS f_t_inv_2t, round(1 - power(1 + 2 * x / 10, -5), 8) AS f_f, round(power(1 + 2 * x / 10, -5), 8) AS f_f_rt, round((power(1 - u, -1 / 5) - 1) * 5, 6) AS f_f_inv, round((power(u, -1 / 5) - 1) * 5, 6) AS f_f_inv_rt, round(1 - power(1 - u, 3) * (1 + 3 * u), 8) AS f_beta,
       round(sqrt(u), 6) AS f_beta_inv, round(1 - exp(-x / 2) * (1 + x / 2), 8) AS f_gamma_dist, round(-3 * ln(1 - u), 6) AS f_gamma_inv, round(factorial(8) / (factorial(k) * factorial(8 - k)) * power(0.3, k) * power(0.7, 8 - k), 8) AS f_binom, round(exp(-3) * power(3, k) / factorial(k), 8) AS f_poisson,
       round((factorial(8) / (factorial(k) * factorial(8 - k))) * (factorial(12) / (factorial(8 - k) * factorial(4 + k))) / 125970, 8) AS f_hypgeom, round((k + 1) * (k + 2) / 2 * power(0.25, 3) * power(0.75, k), 8) AS f_negbinom
       FROM (SELECT p_partkey, p_size / 10 AS x, p_size % 50 / 51 + 0.005 AS u, p_size % 9 AS k FROM part)""")
def formula_closed_distributions(spark, sf_dir):
    x, u, k = "([@p_size]/10)", "(MOD([@p_size],50)/51+0.005)", "MOD([@p_size],9)"
    f = {"expon": f"EXPON.DIST({x},0.2,TRUE)", "weibull": f"WEIBULL.DIST({x},2,3,TRUE)", "norm": f"NORM.DIST({x},0,1,FALSE)", "gamma": f"ROUND(GAMMA({x}+1),4)", "gammaln": f"GAMMALN({x}+1)", "chisq": f"CHISQ.DIST({x},2,TRUE)", "chisq_rt": f"CHISQ.DIST.RT({x},4)", "chisq_inv": f"ROUND(CHISQ.INV({u},2),6)",
         "chisq_inv_rt": f"ROUND(CHISQ.INV.RT({u},2),6)", "t": f"T.DIST({x},2,TRUE)", "t_rt": f"T.DIST.RT({x},2)", "t2": f"T.DIST.2T({x},2)", "t_inv": f"ROUND(T.INV({u},2),6)", "t_inv_2t": f"ROUND(T.INV.2T({u},2),6)", "f": f"F.DIST({x},2,10,TRUE)", "f_rt": f"F.DIST.RT({x},2,10)", "f_inv": f"ROUND(F.INV({u},2,10),6)",
         "f_inv_rt": f"ROUND(F.INV.RT({u},2,10),6)", "beta": f"BETA.DIST({u},2,3,TRUE)", "beta_inv": f"ROUND(BETA.INV({u},2,1),6)", "gamma_dist": f"GAMMA.DIST({x},2,2,TRUE)", "gamma_inv": f"ROUND(GAMMA.INV({u},1,3),6)", "binom": f"BINOM.DIST({k},8,0.3,FALSE)", "poisson": f"POISSON.DIST({k},3,FALSE)",
         "hypgeom": f"HYPGEOM.DIST({k},8,8,20,FALSE)", "negbinom": f"NEGBINOM.DIST({k},3,0.25,FALSE)"}
    return _table_of(spark, sf_dir, "part", {f"f_{k_}": v for k_, v in f.items()}, ["p_partkey"])
