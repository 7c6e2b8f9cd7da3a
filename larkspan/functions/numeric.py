"""Element-wise arithmetic with NumPy's IEEE 754 results, as native columns.

Spark raises or returns null where NumPy gives inf or NaN, and holds NaN for the
largest number; the helpers below keep null as null and give NumPy's result for
everything else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Operand = Column | float | int | str
NAN, INF = float("nan"), float("inf")


def col(x: Operand) -> Column:
    """A column by name, a literal by number."""
    return F.col(x) if isinstance(x, str) else F.lit(float(x)) if isinstance(x, (int, float)) else x


def add(a: Operand, b: Operand) -> Column:
    return col(a) + col(b)


def subtract(a: Operand, b: Operand) -> Column:
    return col(a) - col(b)


def multiply(a: Operand, b: Operand) -> Column:
    return col(a) * col(b)


def divide(a: Operand, b: Operand) -> Column:
    """a / b with inf, -inf and NaN for a zero divisor; the sign of a zero counts."""
    a, b = col(a).cast("double"), col(b).cast("double")
    negative = F.atan2(F.lit(0.0), b) > 1  # true of -0.0 too
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when((a > 0) == negative, F.lit(-INF)).otherwise(F.lit(INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / b)


def power(a: Operand, b: Operand) -> Column:
    return F.pow(col(a), col(b))


def _log(x: Operand, base: str, pole: float) -> Column:
    x = col(x).cast("double")
    f = {"ln": F.ln, "log2": F.log2, "log1p": F.log1p}[base]
    return F.when(F.isnan(x) | (x < pole), F.when(x.isNotNull(), F.lit(NAN))).when(x == pole, F.lit(-INF)).otherwise(f(x))


def log(x: Operand) -> Column:
    return _log(x, "ln", 0.0)


def log2(x: Operand) -> Column:
    return _log(x, "log2", 0.0)


def log1p(x: Operand) -> Column:
    return _log(x, "log1p", -1.0)


def exp(x: Operand) -> Column:
    return F.exp(col(x))


def sin(x: Operand) -> Column:
    return F.sin(col(x))


def cos(x: Operand) -> Column:
    return F.cos(col(x))


def arcsin(x: Operand) -> Column:
    return F.asin(col(x))


def sqrt(x: Operand) -> Column:
    return F.sqrt(col(x))


def absolute(x: Operand) -> Column:
    return F.abs(col(x))


def modulus(a: Operand, n: int) -> Column:
    """The remainder that is never negative."""
    return F.pmod(col(a), F.lit(n))


def rounded(x: Operand, digits: int) -> Column:
    """round(x * 10^digits) / 10^digits in doubles, halves away from zero, as C and DuckDB round.

    For results of billions of rows: F.round goes through a decimal for each.
    """
    x = col(x).cast("double")
    scale = float(10**digits)
    y = x * scale
    near = F.rint(y)
    whole = F.when(F.abs(y - near) == 0.5, y + F.signum(y) * 0.5).otherwise(near)
    return F.when(F.abs(y) < INF, whole / scale).otherwise(x)


# The approximation 7.1.26 of the error function by Abramowitz and Stegun, absolute error below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


# W. J. Cody's rational Chebyshev approximations of the error function (1969), full double precision.
# Numerators and denominators from the highest power down, of x^2 up to 15/32, of x up to 4, of 1/x^2 beyond.
ERF_CENTRE = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
ERF_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERF_TAIL = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
ERF_CENTRE_END, ERF_MIDDLE_END, ROOT_OF_PI = 0.46875, 4.0, 1.7724538509055160273


def _ratio(parts: tuple, x: Column) -> Column:
    """The quotient of two polynomials by Horner's rule."""

    def value(terms):
        out = F.lit(terms[0])
        for t in terms[1:]:
            out = out * x + t
        return out

    return value(parts[0]) / value(parts[1])


def erf(x: Operand, method: str = "exact") -> Column:
    """The error function as native columns: "exact" to full double precision, "fast" as one polynomial."""
    x = col(x).cast("double")
    a = F.abs(x)
    if method == "fast":
        t = 1.0 / (1.0 + ERF_P * a)
        k = [F.lit(v) for v in ERF_A]
        y = 1.0 - ((((k[4] * t + k[3]) * t + k[2]) * t + k[1]) * t + k[0]) * t * F.exp(-x * x)
        return F.when(x < 0, -y).otherwise(y)
    middle = 1.0 - F.exp(-a * a) * _ratio(ERF_MIDDLE, a)
    z = 1.0 / (a * a)
    tail = 1.0 - F.exp(-a * a) / a * (1.0 / ROOT_OF_PI - z * _ratio(ERF_TAIL, z))
    far = F.when(a <= ERF_MIDDLE_END, middle).otherwise(tail)
    return F.when(a <= ERF_CENTRE_END, x * _ratio(ERF_CENTRE, x * x)).when(x < 0, -far).otherwise(far)


def greater(x: Operand, t: Operand) -> Column:
    """x > t; false where either is NaN."""
    return _compare(col(x), col(t), lambda a, b: a > b)


def greater_equal(x: Operand, t: Operand) -> Column:
    return _compare(col(x), col(t), lambda a, b: a >= b)


def less(x: Operand, t: Operand) -> Column:
    return _compare(col(x), col(t), lambda a, b: a < b)


def equal(x: Operand, t: Operand) -> Column:
    return _compare(col(x), col(t), lambda a, b: a == b)


def _compare(a: Column, b: Column, op) -> Column:
    nan = lambda c: F.coalesce(F.isnan(c.cast("double")), F.lit(False))
    return op(a, b) & ~nan(a) & ~nan(b)


def mask(x: Column, condition: Column, value) -> Column:
    """value where the condition is true, x elsewhere; a value of None is null."""
    return F.when(condition, F.lit(value)).otherwise(x)
