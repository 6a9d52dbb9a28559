"""Probability distributions: closed forms as columns, the rest by vectorised pandas functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.compiler import Val, bad, fn, num, truth
from tessella.functions.mathematics import cells, number
from tessella.functions.statistics import mean, moment, values


def _kinds(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first row of each set of equal arguments, and the number of each row's set."""
    code = np.zeros(len(cols[0]), np.int64)
    for c in cols:
        k, u = pd.factorize(c.view(np.int64))
        if len(u) > 1:
            code = pd.factorize(code * len(u) + k)[0]
    first = np.zeros(code.max() + 1 if len(code) else 0, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return first, code


def columns(f):
    """A pandas function of doubles from f(arrays) -> array; equal arguments are met once, what fails is null."""

    @F.pandas_udf(T.DoubleType())
    def run(*cols: pd.Series) -> pd.Series:
        first, code = _kinds(args := [np.ascontiguousarray(c.to_numpy(dtype=float)) for c in cols])
        args = [a[first] for a in args]
        known = ~np.isnan(args).any(axis=0)
        out = np.full(len(first), np.nan)
        with np.errstate(all="ignore"):
            out[known] = f(*[a[known] for a in args])
        failed = ~np.isfinite(out)
        out[failed] = 0
        return pd.Series(pd.arrays.FloatingArray(out[code], failed[code]))

    return run


def rows(f):
    """A pandas function of doubles from f(row values) -> float; what fails is null."""

    def each(*cols: np.ndarray) -> np.ndarray:
        out = np.full(len(cols[0]), np.nan)
        for i, args in enumerate(zip(*[c.tolist() for c in cols], strict=True)):
            try:
                v = f(*args)
                out[i] = v if v is not None else math.nan
            except (ValueError, OverflowError, ZeroDivisionError):
                pass
        return out

    return columns(each)


def plain(*names: str, by=rows):
    """Register f(numbers) -> number under names; by columns, f takes and returns arrays."""

    def put(f):
        @fn(*names)
        def build(ctx, *args):
            c = by(f)(*[num(a) if a.kind != "bool" else a.col.cast("double") for a in args])
            return number(c, bad(c.isNull(), "#NUM!"))

        return f

    return put


# ---- kernels ----


_lgamma, _erfc = (lambda x, f=np.frompyfunc(f, 1, 1): f(x).astype(float) for f in (math.lgamma, math.erfc))


def log_gamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(np.where(x > 0, x, np.nan))


def times_log(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a * log(x), 0 where a is."""
    return np.where(a == 0, 0.0, a * np.log(np.where(a == 0, 1.0, x)))


def _series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 / a + x / (a (a + 1)) + ... until the terms no longer count; rows that are done leave the work."""
    out, at, k = np.empty(len(a)), np.arange(len(a)), a.copy()
    term, total = 1 / a, 1 / a
    while len(at):
        k += 1
        term = term * (x / k)
        total = total + term
        live = np.abs(term) > np.abs(total) * 1e-15
        if 2 * np.count_nonzero(live) <= len(at):
            out[at] = total
            at, k, x, term, total = (v[live] for v in (at, k, x, term, total))
    return out


def _fraction(d: np.ndarray, c: np.ndarray, step, *args: np.ndarray) -> np.ndarray:
    """A continued fraction by Lentz's method: step(i, *args) gives the pairs of its i-th terms (numerator, denominator)."""
    d = 1 / np.where(d == 0, 1e-300, d)
    out, at, h = np.empty(len(d)), np.arange(len(d)), d
    live = np.ones(len(d), bool)
    for i in range(1, 500):
        now = h
        for an, b in step(i, *args):
            d = an * d + b
            c = b + an / c
            d, c = 1 / np.where(d == 0, 1e-300, d), np.where(c == 0, 1e-300, c)
            now = now * (d * c)
        h = np.where(live, now, h)
        live = live & (np.abs(d * c - 1) >= 1e-15)
        if 2 * np.count_nonzero(live) <= len(at):
            out[at] = h
            at, h, d, c, *args = (v[live] for v in (at, h, d, c, *args))
            live = np.ones(len(at), bool)
            if not len(at):
                break
    out[at] = h
    return out


def gamma_p(a: np.ndarray, x: np.ndarray, front: np.ndarray | None = None) -> np.ndarray:
    """The regularised lower incomplete gamma function; front is log_gamma(a)."""
    a, x = np.broadcast_arrays(a, x)
    front = np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - (log_gamma(a) if front is None else front))
    out = np.where(x <= 0, 0.0, np.nan)
    low = (x > 0) & (a > 0) & (x < a + 1)
    out[low] = _series(a[low], x[low]) * front[low]
    up = (x > 0) & (a > 0) & ~low
    b = x[up] + 1 - a[up]
    out[up] = 1 - front[up] * _fraction(b, np.full(len(b), 1e300), lambda i, a, b: [(-i * (i - a), b + 2 * i)], a[up], b)
    return out


def _beta_terms(m: int, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> list[tuple[np.ndarray, float]]:
    n = a + 2 * m
    return [(m * (b - m) * x / ((n - 1) * n), 1.0), (-(a + m) * (a + b + m) * x / (n * (n + 1)), 1.0)]


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray, front: np.ndarray | None = None) -> np.ndarray:
    """The regularised incomplete beta function; front is log_beta(a, b)."""
    a, b, x = np.broadcast_arrays(a, b, x)
    front = log_beta(a, b) if front is None else front
    out = np.where((x <= 0) | (x >= 1), (x >= 1).astype(float), np.nan)
    inside = np.flatnonzero((x > 0) & (x < 1) & (a > 0) & (b > 0))
    a, b, x, front = a[inside], b[inside], x[inside], front[inside]
    turned = x > (a + 1) / (a + b + 2)
    front = np.exp(a * np.log(x) + b * np.log1p(-x) - front)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    part = front / a * _fraction(1 - (a + b) * x / (a + 1), np.ones(len(a)), _beta_terms, a, b, x)
    out[inside] = np.where(turned, 1 - part, part)
    return out


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def solve(g, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The root in [lo, hi] of a growing g(x, rows' places), by Chandrupatla's method; an infinite hi is looked for.

    Inverse quadratic steps where they are safe and halves elsewhere, always between values of both signs.
    """
    out, at = np.full(len(lo), np.nan), np.arange(len(lo))
    x1, x2 = lo.astype(float), np.where(np.isinf(hi), 1.0, hi)
    f1 = g(x1, at)
    out[f1 >= 0] = x1[f1 >= 0]
    at, x1, x2, f1 = (v[f1 < 0] for v in (at, x1, x2, f1))
    f2 = g(x2, at)
    while len(far := np.flatnonzero((f2 < 0) & (x2 < 1e300))):
        x1[far], f1[far] = x2[far], f2[far]
        x2[far] *= 2
        f2[far] = g(x2[far], at[far])
    x3, f3, t = x2, f2, np.full(len(at), 0.5)
    at, x1, x2, x3, f1, f2, f3, t = (v[f2 >= 0] for v in (at, x1, x2, x3, f1, f2, f3, t))
    for _ in range(1000):
        near = np.abs(f1) < np.abs(f2)
        best, least = np.where(near, x1, x2), np.where(near, f1, f2)
        room = 0.5 * (1e-15 * np.abs(best) + 1e-300) / np.abs(x2 - x1)
        out[at] = best
        live = (least != 0) & (room < 0.5)
        at, x1, x2, x3, f1, f2, f3, t, room = (v[live] for v in (at, x1, x2, x3, f1, f2, f3, t, room))
        if not len(at):
            break
        x = x1 + np.clip(t, room, 1 - room) * (x2 - x1)
        f = g(x, at)
        same = (f < 0) == (f1 < 0)
        x3, f3 = np.where(same, x1, x2), np.where(same, f1, f2)
        x2, f2 = np.where(same, x2, x1), np.where(same, f2, f1)
        x1, f1 = x, f
        xi, phi = (x1 - x2) / (x3 - x2), (f1 - f2) / (f3 - f2)
        safe = (phi * phi < xi) & ((1 - phi) * (1 - phi) < 1 - xi)
        step = f1 / (f2 - f1) * f3 / (f2 - f3) + (x3 - x1) / (x2 - x1) * f1 / (f3 - f1) * f2 / (f3 - f2)
        t = np.where(safe, step, 0.5)
    return out


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_inv(p: np.ndarray) -> np.ndarray:
    tail = np.minimum(p, 1 - p)
    s = solve(lambda s, at: tail[at] - 0.5 * _erfc(s / math.sqrt(2)), np.zeros(len(p)), np.full(len(p), 40.0))
    return needed(np.where(p < 0.5, -s, s), 0 < p, p < 1)


def t_upper(t: np.ndarray, n: np.ndarray, front: np.ndarray | None = None) -> np.ndarray:
    """The share above t >= 0; near 0, where n / (n + t^2) says little of t, by the share between."""
    s = t * t
    near = s < 1
    i = beta_i(np.where(near, 0.5, n / 2), np.where(near, n / 2, 0.5), np.where(near, s, n) / (n + s), front) / 2
    return np.where(near, 0.5 - i, i)


def t_cdf(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    half = t_upper(t, n)
    return np.where(t > 0, 1 - half, half)


def f_cdf(x: np.ndarray, m: np.ndarray, n: np.ndarray, front: np.ndarray | None = None) -> np.ndarray:
    return np.where(x > 0, beta_i(m / 2, n / 2, m * x / (m * x + n), front), 0.0)


def need(*tests: bool) -> None:
    if not all(tests):
        raise ValueError


def needed(out: np.ndarray, *tests: np.ndarray) -> np.ndarray:
    """out where all tests hold, elsewhere nan."""
    return np.where(np.logical_and.reduce(np.broadcast_arrays(*tests)), out, np.nan)


plain("GAMMALN")(lambda x: math.lgamma(x) if x > 0 else math.nan)
plain("GAMMA")(math.gamma)
plain("NORM.S.INV", "NORMSINV", by=columns)(normal_inv)
plain("NORM.INV", by=columns)(lambda p, m, s: needed(m + s * normal_inv(p), s > 0))
plain("LOGNORM.INV", by=columns)(lambda p, m, s: needed(np.exp(m + s * normal_inv(p)), s > 0))


@fn("NORMSDIST")
def normsdist(ctx, z):
    return number(rows(normal_cdf)(num(z)))


@fn("NORM.S.DIST")
def norm_s_dist(ctx, z, cumulative=None):
    pdf = F.exp(-num(z) * num(z) / 2) / math.sqrt(2 * math.pi)
    return number(F.when(truth(cumulative), rows(normal_cdf)(num(z))).otherwise(pdf) if cumulative is not None else rows(normal_cdf)(num(z)))


@fn("NORM.DIST")
def norm_dist(ctx, x, m, s, cumulative):
    z = Val((num(x) - num(m)) / num(s), kind="num")
    out = norm_s_dist(ctx, z, cumulative).col
    return number(F.when(truth(cumulative), out).otherwise(out / num(s)), bad(num(s) <= 0, "#NUM!"))


@fn("LOGNORM.DIST")
def lognorm_dist(ctx, x, m, s, cumulative):
    z = Val((F.log(num(x)) - num(m)) / num(s), kind="num")
    out = norm_s_dist(ctx, z, cumulative).col
    return number(F.when(truth(cumulative), out).otherwise(out / (num(s) * num(x))), bad((num(s) <= 0) | (num(x) <= 0), "#NUM!"))


@fn("EXPON.DIST")
def expon_dist(ctx, x, rate, cumulative):
    e = F.exp(-num(rate) * num(x))
    return number(F.when(truth(cumulative), 1 - e).otherwise(num(rate) * e), bad((num(x) < 0) | (num(rate) <= 0), "#NUM!"))


@fn("WEIBULL.DIST")
def weibull_dist(ctx, x, a, b, cumulative):
    r = num(x) / num(b)
    e = F.exp(-F.pow(r, num(a)))
    return number(F.when(truth(cumulative), 1 - e).otherwise(num(a) / num(b) * F.pow(r, num(a) - 1) * e), bad((num(x) < 0) | (num(a) <= 0) | (num(b) <= 0), "#NUM!"))


@plain("GAMMA.DIST", by=columns)
def gamma_dist(x, a, b, cum):
    density = np.exp(times_log(a - 1, x) - x / b - a * np.log(b) - log_gamma(a))
    return needed(np.where(cum != 0, gamma_p(a, x / b), density), x >= 0, a > 0, b > 0)


@plain("GAMMA.INV", by=columns)
def gamma_inv(p, a, b):
    p, a, b = np.broadcast_arrays(p, a, b)
    front = log_gamma(a)
    x = solve(lambda x, at: gamma_p(a[at], x, front[at]) - p[at], np.zeros(len(p)), np.full(len(p), np.inf))
    return needed(x * b, a > 0, b > 0, p >= 0, p < 1)


@plain("BETA.DIST", by=columns)
def beta_dist(x, a, b, cum, lo=0.0, hi=1.0):
    z = (x - lo) / (hi - lo)
    density = np.exp(times_log(a - 1, z) + times_log(b - 1, 1 - z) - log_beta(a, b)) / (hi - lo)
    return needed(np.where(cum != 0, beta_i(a, b, z), density), a > 0, b > 0, lo <= x, x <= hi, lo < hi)


@plain("BETA.INV", by=columns)
def beta_inv(p, a, b, lo=0.0, hi=1.0):
    front = log_beta(a, b)
    x = solve(lambda x, at: beta_i(a[at], b[at], x, front[at]) - p[at], np.zeros(len(p)), np.ones(len(p)))
    return needed(lo + (hi - lo) * x, a > 0, b > 0, p >= 0, p <= 1)


@plain("CHISQ.DIST", by=columns)
def chisq_dist(x, n, cum):
    return needed(gamma_dist(x, n / 2, 2.0, cum), n >= 1)


plain("CHISQ.DIST.RT", "CHIDIST", by=columns)(lambda x, n: 1 - gamma_p(n / 2, x / 2))
plain("CHISQ.INV", by=columns)(lambda p, n: gamma_inv(p, n / 2, 2.0))
plain("CHISQ.INV.RT", "CHIINV", by=columns)(lambda p, n: gamma_inv(1 - p, n / 2, 2.0))


@plain("T.DIST", by=columns)
def t_dist(t, n, cum):
    density = np.exp(log_gamma((n + 1) / 2) - log_gamma(n / 2)) / np.sqrt(n * math.pi) * (1 + t * t / n) ** (-(n + 1) / 2)
    return needed(np.where(cum != 0, t_cdf(t, n), density), n >= 1)


def t_inv(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    tail, front = np.minimum(p, 1 - p), log_beta(n / 2, np.full(len(n), 0.5))
    t = solve(lambda t, at: tail[at] - t_upper(t, n[at], front[at]), np.zeros(len(p)), np.full(len(p), np.inf))
    return needed(np.where(p < 0.5, -t, t), 0 < p, p < 1, n >= 1)


plain("T.DIST.2T", by=columns)(lambda t, n: needed(2 * (1 - t_cdf(t, n)), t >= 0))
plain("T.DIST.RT", by=columns)(lambda t, n: 1 - t_cdf(t, n))
plain("T.INV", by=columns)(t_inv)
plain("T.INV.2T", "TINV", by=columns)(lambda p, n: t_inv(1 - p / 2, n))


@plain("F.DIST", by=columns)
def f_dist(x, m, n, cum):
    density = np.exp(m / 2 * np.log(m / n) + times_log(m / 2 - 1, x) - (m + n) / 2 * np.log1p(m * x / n) - log_beta(m / 2, n / 2))
    return needed(np.where(cum != 0, f_cdf(x, m, n), density), x >= 0, m >= 1, n >= 1)


def f_inv(p: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    front = log_beta(m / 2, n / 2)
    x = solve(lambda x, at: f_cdf(x, m[at], n[at], front[at]) - p[at], np.zeros(len(p)), np.full(len(p), np.inf))
    return needed(x, p >= 0, p < 1)


plain("F.DIST.RT", by=columns)(lambda x, m, n: 1 - f_cdf(x, m, n))
plain("F.INV", by=columns)(f_inv)
plain("F.INV.RT", by=columns)(lambda p, m, n: f_inv(1 - p, m, n))


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def binom(k: int, n: int, p: float) -> float:
    if p in (0.0, 1.0):
        return float(k == n * p)
    return math.exp(log_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p))


@plain("BINOM.DIST")
def binom_dist(k, n, p, cum):
    k, n = math.floor(k), math.floor(n)
    need(0 <= k <= n, 0 <= p <= 1)
    return sum(binom(i, n, p) for i in range(k + 1)) if cum else binom(k, n, p)


@plain("BINOM.INV")
def binom_inv(n, p, alpha):
    need(n >= 0, 0 <= p <= 1, 0 <= alpha <= 1)
    total = 0.0
    for k in range(int(n) + 1):
        total += binom(k, int(n), p)
        if total >= alpha:
            return float(k)
    return float(int(n))


@plain("BINOM.DIST.RANGE")
def binom_range(n, p, lo, hi=None):
    hi = lo if hi is None else hi
    need(0 <= lo <= hi <= n)
    return sum(binom(k, int(n), p) for k in range(int(lo), int(hi) + 1))


@plain("POISSON.DIST")
def poisson_dist(k, m, cum):
    k = math.floor(k)
    need(k >= 0, m >= 0)
    pmf = lambda i: math.exp(i * math.log(m) - m - math.lgamma(i + 1)) if m else float(i == 0)
    return sum(pmf(i) for i in range(k + 1)) if cum else pmf(k)


@plain("HYPGEOM.DIST")
def hypgeom_dist(k, n, big_k, big_n, cum):
    k, n, big_k, big_n = (math.floor(v) for v in (k, n, big_k, big_n))
    need(0 <= k <= min(n, big_k), n <= big_n, big_k <= big_n)
    pmf = lambda i: math.exp(log_choose(big_k, i) + log_choose(big_n - big_k, n - i) - log_choose(big_n, n)) if n - i <= big_n - big_k else 0.0
    return sum(pmf(i) for i in range(k + 1)) if cum else pmf(k)


@plain("NEGBINOM.DIST")
def negbinom_dist(f, s, p, cum):
    f, s = math.floor(f), math.floor(s)
    need(f >= 0, s >= 1, 0 < p < 1)
    pmf = lambda i: math.exp(log_choose(i + s - 1, s - 1) + s * math.log(p) + i * math.log1p(-p))
    return sum(pmf(i) for i in range(f + 1)) if cum else pmf(f)


plain("CONFIDENCE.NORM", "CONFIDENCE", by=columns)(lambda a, s, n: needed(normal_inv(1 - a / 2) * s / np.sqrt(n), 0 < a, a < 1, s > 0, n >= 1))
plain("CONFIDENCE.T", by=columns)(lambda a, s, n: needed(t_inv(1 - a / 2, n - 1) * s / np.sqrt(n), 0 < a, a < 1, s > 0, n > 1))


def _column(ctx, a: Val) -> Column:
    return values(ctx, a)


@fn("Z.TEST", "ZTEST")
def z_test(ctx, a, mu, sigma=None):
    x = _column(ctx, a)
    n = F.size(x)
    s = num(sigma) if sigma is not None else F.sqrt(moment(x, 2) / (n - 1))
    return number(rows(lambda z: 1 - normal_cdf(z))((mean(x) - num(mu)) / (s / F.sqrt(n))))


@fn("T.TEST", "TTEST")
def t_test(ctx, a, b, tails, kind):
    x, y, k = _column(ctx, a), _column(ctx, b), int(kind.literal)
    n, m = F.size(x).cast("double"), F.size(y).cast("double")
    vx, vy = moment(x, 2) / (n - 1), moment(y, 2) / (m - 1)
    if k == 1:
        d = F.zip_with(x, y, lambda p, q: p - q)
        t, df = mean(d) / F.sqrt(moment(d, 2) / (n - 1) / n), n - 1
    elif k == 2:
        pooled = (moment(x, 2) + moment(y, 2)) / (n + m - 2)
        t, df = (mean(x) - mean(y)) / F.sqrt(pooled * (1 / n + 1 / m)), n + m - 2
    else:
        se = vx / n + vy / m
        t, df = (mean(x) - mean(y)) / F.sqrt(se), se * se / (vx * vx / (n * n * (n - 1)) + vy * vy / (m * m * (m - 1)))
    return number(columns(lambda t, n: 1 - t_cdf(np.abs(t), n))(t, df) * num(tails))


@fn("F.TEST", "FTEST")
def f_test(ctx, a, b):
    x, y = _column(ctx, a), _column(ctx, b)
    n, m = F.size(x) - 1.0, F.size(y) - 1.0

    def two_sided(v, n, m):
        p = f_cdf(v, n, m)
        return 2 * np.minimum(p, 1 - p)

    return number(columns(two_sided)((moment(x, 2) / n) / (moment(y, 2) / m), n, m))


@fn("CHISQ.TEST", "CHITEST")
def chisq_test(ctx, a, b):
    o, e = cells(a), cells(b)
    x = F.aggregate(F.zip_with(o, e, lambda p, q: (p - q) * (p - q) / q), F.lit(0.0), lambda s, v: s + v)
    r = F.size(a.col) if a.kind == "matrix" else F.lit(1)
    df = F.when(r > 1, (r - 1) * (F.size(o) / r - 1)).otherwise(F.size(o) - 1)
    return number(columns(lambda x, n: 1 - gamma_p(n / 2, x / 2))(x, df.cast("double")))
