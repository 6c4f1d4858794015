"""Label arithmetic: probabilities, targets, results, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
K = math.log(10) / 400
TARGET_CLAMP = 2000
WIDE_BAND = 200
MATE_LIMIT = 49000 - 64
EVAL_CLAMP = 15000
I16 = 32767


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, limit: float = TARGET_CLAMP) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), x))


def target(eval_cp: Column, wdl: Column, *, lam: float) -> Column:
    """lam parts of the evaluation's probability and 1 - lam of the result; double, cast at the sink."""
    return lam * sigmoid(K * clamp(eval_cp)) + (1 - lam) * wdl


def wdl_of(result: Column, white: Column) -> Column:
    """For the mover.  Any result but a draw or '1-0' counts as black's win, '*' included."""
    return F.when(result == "1/2-1/2", 0.5).when((result == "1-0") == white, 1.0).otherwise(0.0)


def result_of(eval_cp: Column, white: Column) -> Column:
    """Result of a cut game from its last evaluation (mover's view); the band's edge is a draw."""
    return F.when(F.abs(eval_cp) <= WIDE_BAND, "1/2-1/2").when((eval_cp > 0) == white, "1-0").otherwise("0-1")


def gap(static: Column, search: Column) -> Column:
    return F.abs(sigmoid(K * search) - sigmoid(K * static))


def signed_error(static: Column, search: Column) -> Column:
    return sigmoid(K * search) - sigmoid(K * static)


def quantised(w: Column, scale: int) -> Column:
    return F.greatest(F.lit(-I16 - 1), F.least(F.lit(I16), F.rint(w * scale))).cast("int")


def saturated(w: Column, scale: int) -> Column:
    x = F.rint(w * scale)
    return (x >= I16) | (x <= -I16 - 1)


def screlu(x: Column) -> Column:
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return y * y


def cosine_rate(epoch: Column, epochs: Column, first: float, last: float = 1e-5) -> Column:
    return last + 0.5 * (first - last) * (1 + F.cos(math.pi * epoch / epochs))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def rescaled(alpha: float):
    """(inner, outer) scaling of weights: divided by alpha, and multiplied by its square, which leaves a squared activation as it is."""
    return lambda x: x / alpha, lambda x: x * (alpha * alpha)


def depth_verdict(reference: Column, shallow: Column, middle: Column) -> Column:
    """Whether deeper labels are worth it: the reference has settled, the shallow label leaves room, the middle one halves it."""
    return F.when(reference <= 0.99, "NOT CONVERGED").when(1 - shallow < 0.05, "NOT ALIVE").when(1 - middle <= 0.5 * (1 - shallow), "JUSTIFIED").otherwise("ALIVE BUT NOT JUSTIFIED")
