"""Student's t as column expressions: tail probabilities and critical values.

The two-sided tail of t with v degrees of freedom is the regularised incomplete beta function
I(v / (v + t^2); v / 2, 1 / 2), taken as a continued fraction whose state an aggregate over a short
sequence carries along. All of it is built-in arithmetic, so it runs where the row is.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fraction needs at most about 50 steps for any t and from 1 to 1e9 degrees of freedom; a Newton search from 0 far fewer.
FRACTION_STEPS, NEWTON_STEPS = 80, 64
EXACT = 1e-16
#: Steps by which an argument is raised before its series is used.
RAISED = 16


def _let(then: Callable[..., Column], **values: Column) -> Column:
    """``then`` of values that are each computed once per row, however often it uses them."""
    bound = F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), lambda s: then(*[s[n] for n in values]))
    return F.element_at(bound, 1)


def _log_gamma_ratio(a: Column) -> Column:
    """log of gamma(a + 1/2) / gamma(a): its series at ``a + RAISED``, brought down by the recurrence."""
    down = reduce(lambda p, j: p * ((a + float(j)) / (a + (j + 0.5))), range(RAISED), F.lit(1.0))

    def series(inverse: Column, square: Column) -> Column:
        return inverse * (-1 / 8 + square * (1 / 192 + square * (-1 / 640 + square * (17 / 14336))))

    x = a + float(RAISED)
    return F.log(down) + 0.5 * F.log(x) + _let(series, inverse=1.0 / x, square=1.0 / (x * x))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, two of its terms per step, until it no longer changes.

    ``a``, ``b`` and ``x`` are bound values: every step uses them.
    """
    def state(c: Column, d: Column, h: Column, done: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"), done.alias("done"))

    def next_state(s: Column, m: Column) -> Column:
        def second(odd: Column, c1: Column, d1: Column, h: Column) -> Column:
            return _let(lambda c2, d2: state(c2, d2, h * c2 * d2, F.coalesce(F.abs(c2 * d2 - 1.0) <= EXACT, F.lit(True))),
                        c2=1.0 + F.try_divide(odd, c1), d2=F.try_divide(F.lit(1.0), 1.0 + odd * d1))

        def first(even: Column, odd: Column) -> Column:
            return _let(lambda c1, d1: second(odd, c1, d1, s["h"] * c1 * d1),
                        c1=1.0 + F.try_divide(even, s["c"]), d1=F.try_divide(F.lit(1.0), 1.0 + even * s["d"]))

        twice = a + 2.0 * m
        return _let(first, even=m * (b - m) * x / ((twice - 1.0) * twice), odd=-(a + m) * (a + b + m) * x / (twice * (twice + 1.0)))

    steps = F.sequence(F.lit(1), F.lit(FRACTION_STEPS))
    return _let(lambda first: F.aggregate(
        steps, state(F.lit(1.0), first, first, F.lit(False)),
        lambda s, m: F.when(s["done"], s).otherwise(next_state(s, m)), lambda s: s["h"]),
        first=F.try_divide(F.lit(1.0), 1.0 - (a + b) * x / (a + 1.0)))


def t_two_sided(t: Column, freedom: Column) -> Column:
    """Probability of a t at least as far from 0; NULL without both numbers or a degree of freedom."""
    v = F.when(freedom > 0, freedom.cast("double"))
    return _let(_tail, a=v / 2.0, ratio=t * t / v, log_gamma=_let(_log_gamma_ratio, a=v / 2.0))


def _tail(a: Column, ratio: Column, log_gamma: Column) -> Column:
    rest = 1.0 / (1.0 + ratio)

    def joined(far: Column, below: Column, fraction: Column) -> Column:
        whole = F.exp(log_gamma - a * F.log1p(ratio)) * F.sqrt(ratio * rest) / math.sqrt(math.pi) * fraction / below
        return F.when(far, whole).otherwise(1.0 - whole)

    def by_side(far: Column) -> Column:
        below, above = F.when(far, a).otherwise(0.5), F.when(far, 0.5).otherwise(a)
        fraction = _let(_beta_fraction, a=below, b=above, x=F.when(far, rest).otherwise(ratio * rest))
        return joined(far, below, fraction)

    # The fraction of the tail converges fast from here on, that of its complement before.
    return _let(by_side, far=rest < (a + 1.0) / (a + 2.5))


def f_upper(f: Column, freedom: Column) -> Column:
    """Probability of a larger F with 1 and ``freedom`` degrees of freedom, the square of a t."""
    return t_two_sided(F.sqrt(f), freedom)


def t_critical(level: float, freedom: Column) -> Column:
    """The t that ``level`` of the distribution lies within, e.g. 0.95 for a 95 % band.

    The two-sided tail falls and is convex, so Newton steps from 0 never pass the root; they stop where t no longer grows.
    """
    if not 0 < level < 1:
        raise ValueError("a level lies between 0 and 1")

    def search(v: Column, log_gamma: Column) -> Column:
        def state(t: Column, done: Column) -> Column:
            return F.struct(t.alias("t"), done.alias("done"))

        def step(t: Column) -> Column:
            def further(ratio: Column) -> Column:
                slope = 2.0 * F.exp(log_gamma - 0.5 * F.log(v * math.pi) - (v + 1.0) / 2.0 * F.log1p(ratio))
                return t + (_let(_tail, a=v / 2.0, ratio=ratio, log_gamma=log_gamma) - (1 - level)) / slope

            return _let(lambda moved: F.when(moved > t * (1 + 1e-15), state(moved, F.lit(False))).otherwise(state(t, F.lit(True))),
                        moved=_let(further, ratio=t * t / v))

        start = state(F.when(v.isNotNull(), F.lit(0.0)), v.isNull())
        return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start,
                           lambda s, _: F.when(s["done"], s).otherwise(_let(step, t=s["t"])), lambda s: s["t"])

    v = F.when(freedom > 0, freedom.cast("double"))
    return _let(search, v=v, log_gamma=_let(_log_gamma_ratio, a=v / 2.0))
