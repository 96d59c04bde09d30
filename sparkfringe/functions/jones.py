"""Complex and 2x2 Jones algebra as Spark columns.

Spark has no complex type: a complex number is ``struct<re:double,im:double>`` and a set of
correlations an array of 1 (scalar), 2 (diagonal) or 4 (row-major matrix) of them. :class:`Jones` builds plain
arithmetic over the fields, so products stay inside generated code; no function here makes a lambda.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CPLX = "struct<re:double,im:double>"
JONES = f"array<{CPLX}>"


@dataclass(frozen=True)
class Cx:
    """A complex number of two columns."""

    re: Column
    im: Column

    @staticmethod
    def of(column: Column) -> Cx:
        return Cx(column["re"], column["im"])

    @staticmethod
    def lit(re: float, im: float = 0.0) -> Cx:
        return Cx(F.lit(float(re)), F.lit(float(im)))

    def __add__(self, other: Cx) -> Cx:
        return Cx(self.re + other.re, self.im + other.im)

    def __sub__(self, other: Cx) -> Cx:
        return Cx(self.re - other.re, self.im - other.im)

    def __mul__(self, other: Cx | Column) -> Cx:
        if isinstance(other, Cx):
            return Cx(self.re * other.re - self.im * other.im, self.re * other.im + self.im * other.re)
        return Cx(self.re * other, self.im * other)

    def __truediv__(self, other: Cx) -> Cx:
        size = other.abs2()
        top = self * other.conj()
        return Cx(top.re / size, top.im / size)

    def conj(self) -> Cx:
        return Cx(self.re, -self.im)

    def abs2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.hypot(self.re, self.im)

    def phase(self) -> Column:
        return F.atan2(self.im, self.re)

    def is_zero(self) -> Column:
        return (self.re == 0) & (self.im == 0)

    def is_finite(self) -> Column:
        """Both parts are finite; a null is not."""
        return _finite(self.re) & _finite(self.im)

    def where(self, condition: Column, other: Cx) -> Cx:
        return Cx(F.when(condition, self.re).otherwise(other.re), F.when(condition, self.im).otherwise(other.im))

    def column(self) -> Column:
        return F.struct(self.re.alias("re"), self.im.alias("im"))


def _finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def polar(size: Column | float, angle: Column) -> Cx:
    size = size if isinstance(size, Column) else F.lit(float(size))
    return Cx(size * F.cos(angle), size * F.sin(angle))


@dataclass(frozen=True)
class Jones:
    """1, 2 or 4 complex columns."""

    parts: tuple[Cx, ...]

    def __post_init__(self) -> None:
        if len(self.parts) not in (1, 2, 4):
            raise ValueError(f"1, 2 or 4 correlations are supported, not {len(self.parts)}")

    @staticmethod
    def of(column: Column, n_corr: int) -> Jones:
        return Jones(tuple(Cx.of(column[k]) for k in range(n_corr)))

    @staticmethod
    def identity(n_corr: int) -> Jones:
        return Jones(tuple(Cx.lit(x) for x in {1: (1,), 2: (1, 1), 4: (1, 0, 0, 1)}[n_corr]))

    @staticmethod
    def zero(n_corr: int) -> Jones:
        return Jones((Cx.lit(0),) * n_corr)

    @property
    def n_corr(self) -> int:
        return len(self.parts)

    def _each(self, other: Jones, f) -> Jones:
        return Jones(tuple(f(a, b) for a, b in zip(self.parts, other.parts, strict=True)))

    def __add__(self, other: Jones) -> Jones:
        return self._each(other, lambda a, b: a + b)

    def __sub__(self, other: Jones) -> Jones:
        return self._each(other, lambda a, b: a - b)

    def elementwise(self, other: Jones) -> Jones:
        return self._each(other, lambda a, b: a * b)

    def __matmul__(self, other: Jones) -> Jones:
        """The matrix product; element by element for diagonal and scalar values."""
        if self.n_corr != 4:
            return self.elementwise(other)
        a, b, c, d = self.parts
        e, f, g, h = other.parts
        return Jones((a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h))

    def scale(self, weights: Sequence[Column] | Column) -> Jones:
        many = weights if isinstance(weights, (list, tuple)) else [weights] * self.n_corr
        return Jones(tuple(p * w for p, w in zip(self.parts, many, strict=True)))

    def conj(self) -> Jones:
        return Jones(tuple(p.conj() for p in self.parts))

    def herm(self) -> Jones:
        """The conjugate transpose."""
        if self.n_corr != 4:
            return self.conj()
        a, b, c, d = (p.conj() for p in self.parts)
        return Jones((a, c, b, d))

    def det(self) -> Cx:
        if self.n_corr == 4:
            a, b, c, d = self.parts
            return a * d - b * c
        return self.parts[0] if self.n_corr == 1 else self.parts[0] * self.parts[1]

    def inverse(self, least: float = 1e-6, det: Cx | None = None) -> Jones:
        """The inverse; all zero where the determinant is smaller than ``least``. ``det`` may be given as a column."""
        det = det or self.det()
        singular = det.abs() < least
        if self.n_corr == 4:
            a, b, c, d = self.parts
            zero = Cx.lit(0)
            made = (d, zero - b, zero - c, a)
        else:
            made = {1: (Cx.lit(1),), 2: self.parts[::-1]}[self.n_corr]
        one = Cx.lit(1).where(singular, det)
        return Jones(tuple(Cx.lit(0).where(singular, x / one) for x in made))

    def where(self, condition: Column, other: Jones) -> Jones:
        return self._each(other, lambda a, b: a.where(condition, b))

    def kron_t(self, other: Jones) -> list[Cx]:
        """The 16 row-major elements of A (x) B^T, for which vec(A X B) = (A (x) B^T) vec(X)."""
        a, b = self.parts, other.parts
        return [a[2 * (r // 2) + c // 2] * b[2 * (c % 2) + r % 2] for r in range(4) for c in range(4)]

    def column(self) -> Column:
        return F.array(*[p.column() for p in self.parts])


def inv_abs2(x: Cx) -> Column:
    """1 / |x|^2, 0 for x = 0."""
    return F.when(x.is_zero(), 0.0).otherwise(1 / x.abs2())


def abs_ratio(a: Cx, b: Cx) -> Column:
    """|a| / |b|, 0 for b = 0."""
    return F.when(b.is_zero(), 0.0).otherwise(a.abs() / b.abs())


def rotation(angle: Column, circular: bool, n_corr: int = 4, other_angle: Column | None = None) -> Jones:
    """The feed rotation: diag(e^-ia, e^ib) for circular feeds, [[cos a, sin a], [-sin b, cos b]] for linear ones."""
    second = angle if other_angle is None else other_angle
    zero = Cx.lit(0)
    if circular:
        ends = (polar(1, -angle), polar(1, second))
        return Jones((ends[0], zero, zero, ends[1])) if n_corr == 4 else Jones(ends[:n_corr])
    if n_corr != 4:
        raise ValueError("rotating linear feeds needs four correlations")
    real = lambda x: Cx(x, F.lit(0.0))
    return Jones((real(F.cos(angle)), real(F.sin(angle)), real(-F.sin(second)), real(F.cos(second))))


def corrected_weights(gain_p: Jones, gain_q: Jones, weights: Sequence[Column]) -> list[Column]:
    """Weights of corrected data: w_i' = sum_k |K_ki|^2 w_k with K = G_p (x) conj(G_q)."""
    if gain_p.n_corr != 4:
        return [p.abs2() * q.abs2() * w for p, q, w in zip(gain_p.parts, gain_q.parts, weights, strict=True)]
    p, q = ([x.abs2() for x in g.parts] for g in (gain_p, gain_q))
    k = lambda r, c: p[2 * (r // 2) + c // 2] * q[2 * (r % 2) + c % 2] * weights[r]
    return [k(0, c) + k(1, c) + k(2, c) + k(3, c) for c in range(4)]


def baseline_id(ant1: Column, ant2: Column, n_ant: int) -> Column:
    """A number for each pair of antennas with ant1 <= ant2, own pairs included."""
    return F.floor(ant1 * (2 * n_ant - ant1 - 1) / 2).cast("int") + ant2


#: How a gain is taken apart into real numbers that can be interpolated, and put together again.
TO_REAL = {
    "amplitude": lambda x: x.abs(),
    "cos": lambda x: F.cos(x.phase()),
    "sin": lambda x: F.sin(x.phase()),
}


def to_interpolable(gain: Cx) -> dict[str, Column]:
    return {name: f(gain) for name, f in TO_REAL.items()}


def from_interpolable(amplitude: Column, cos: Column, sin: Column) -> Cx:
    return polar(amplitude, F.atan2(sin, cos))
