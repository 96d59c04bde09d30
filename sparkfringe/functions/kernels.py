"""NumPy kernels of the solver: Jones algebra on arrays, gain types, and one Gauss-Newton solver for all of them.

A chunk is flat: one entry per row and channel, with its antennas and interval numbers, so intervals
and antennas are plain indices. A term says how its gains follow from its unknowns and what their
derivatives are; the solver forms residuals, derivatives of the model with respect to the unknowns of
either antenna, normal equations per interval, antenna and direction, solves and updates them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

LIGHT = 299792458.0
TWO_PI = 2 * np.pi


def as_matrix(x: np.ndarray) -> np.ndarray:
    """(..., 4) to (..., 2, 2); fewer correlations stay diagonal or scalar."""
    return x.reshape(*x.shape[:-1], 2, 2) if x.shape[-1] == 4 else x


def as_vector(x: np.ndarray, n_corr: int) -> np.ndarray:
    return x.reshape(*x.shape[:-2], 4) if n_corr == 4 else x


def mul(a: np.ndarray, b: np.ndarray, full: bool) -> np.ndarray:
    if not full:
        return a * b
    return a[..., :, :1] * b[..., :1, :] + a[..., :, 1:] * b[..., 1:, :]  # a loop over so small matrices is slower


def herm(a: np.ndarray, full: bool) -> np.ndarray:
    return np.conj(np.swapaxes(a, -1, -2)) if full else np.conj(a)


def identity(shape: tuple[int, ...], n_corr: int) -> np.ndarray:
    if n_corr == 4:
        return np.broadcast_to(np.eye(2, dtype=complex), (*shape, 2, 2)).copy()
    return np.ones((*shape, n_corr), complex)


@dataclass
class Band:
    """What frequency-dependent terms need to know of a chunk."""

    low: float
    high: float

    @property
    def centre(self) -> float:
        return (self.low + self.high) / 2

    @property
    def width(self) -> float:
        return (self.high - self.low) or 1.0

    @property
    def tilt(self) -> float:
        return float(np.log(self.low / self.high))


class Kind:
    """A gain type. ``unknowns`` per interval, antenna and direction; complex or real."""

    real = True
    residual = "plain"  # or "phase": data take the model's amplitude; "amplitude": data take its phase
    referenced = False
    solvable = True
    numbness = 1e9
    bilinear = False  # gains are the unknowns themselves, so that intervals can be solved for all antennas together
    corrs: tuple[int, ...] = (1, 2, 4)

    def __init__(self, n_corr: int, band: Band):
        if n_corr not in self.corrs:
            raise ValueError(f"{type(self).__name__} needs {' or '.join(map(str, self.corrs))} correlations")
        self.n_corr, self.band, self.full = n_corr, band, n_corr == 4

    def count(self) -> int:
        raise NotImplementedError

    def start(self, shape: tuple[int, ...]) -> np.ndarray:
        return np.zeros((*shape, self.count()))

    def gains(self, x: np.ndarray, freq: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def slopes(self, x: np.ndarray, freq: np.ndarray) -> list[np.ndarray]:
        """The derivative of the gains by each unknown."""
        raise NotImplementedError

    def step(self, loop: int, dependent: bool) -> float:
        return 0.5

    def refer(self, x: np.ndarray, ref: int) -> np.ndarray:
        """Unknowns relative to a reference antenna (axis 2)."""
        return x

    def stored(self, x: np.ndarray) -> np.ndarray:
        """Parameters in their own units."""
        return x

    def loaded(self, p: np.ndarray) -> np.ndarray:
        return p

    def shared(self) -> list[list[int]]:
        """Unknowns that are one in scalar mode."""
        return [[k] for k in range(self.count())]


class Complex(Kind):
    real = False
    numbness = 1e-6
    bilinear = True

    def elements(self) -> list[int]:
        return list(range(self.n_corr))

    def count(self) -> int:
        return len(self.elements())

    def start(self, shape):
        one = as_vector(identity(shape, self.n_corr), self.n_corr)
        return one[..., self.elements()]

    def gains(self, x, freq):
        out = np.zeros((*x.shape[:-1], self.n_corr), complex)
        out[..., self.elements()] = x
        return as_matrix(out)

    def slopes(self, x, freq):
        out = []
        for e in self.elements():
            one = np.zeros(self.n_corr, complex)
            one[e] = 1
            out.append(np.broadcast_to(as_matrix(one), (*x.shape[:-1], *as_matrix(one).shape)))
        return out

    def step(self, loop, dependent):
        return 0.5 if dependent or loop % 2 == 0 else 1.0


class DiagComplex(Complex):
    referenced = True

    def elements(self):
        return [0, 3] if self.n_corr == 4 else list(range(self.n_corr))

    def refer(self, x, ref):
        one = x[:, :, ref : ref + 1]
        size = np.abs(one)
        return x * np.where(size > 0, np.conj(one) / np.where(size > 0, size, 1), 1)


class Leakage(Complex):
    """Ones on the diagonal, unknowns off it."""

    corrs = (4,)

    def elements(self):
        return [1, 2]

    def start(self, shape):
        return np.zeros((*shape, 2), complex)

    def gains(self, x, freq):
        return super().gains(x, freq) + np.eye(2)


class _Diagonal(Kind):
    """exp(i sum_k c_k(nu) p_k) on the diagonal, with parameters of their own for either correlation."""

    residual = "phase"
    referenced = True
    names: tuple[str, ...] = ()

    def ends(self) -> list[int]:
        return [0, 3] if self.n_corr == 4 else list(range(self.n_corr))

    def count(self):
        return len(self.names) * len(self.ends())

    def coefficients(self, freq: np.ndarray) -> list[np.ndarray]:
        b = self.band
        known = {
            "offset": np.ones_like(freq),
            "delay": TWO_PI * (freq / b.centre - 1),
            "tec": TWO_PI * (b.width / freq + b.tilt),
        }
        return [known[n] for n in self.names]

    def units(self) -> np.ndarray:
        known = {"offset": 1.0, "delay": 1 / self.band.centre, "tec": self.band.width}
        return np.array([known[n] for n in self.names])

    def phases(self, x, freq):
        c = self.coefficients(freq)
        k = len(self.names)
        return [sum(c[j] * x[..., e * k + j] for j in range(k)) for e in range(len(self.ends()))]

    def _on(self, values: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((*values[0].shape, self.n_corr), complex)
        for e, v in zip(self.ends(), values, strict=True):
            out[..., e] = v
        return as_matrix(out)

    def gains(self, x, freq):
        return self._on([np.exp(1j * p) for p in self.phases(x, freq)])

    def slopes(self, x, freq):
        c, phases, out = self.coefficients(freq), self.phases(x, freq), []
        for e in range(len(self.ends())):
            for j in range(len(self.names)):
                values = [np.zeros(phases[0].shape, complex) for _ in self.ends()]
                values[e] = 1j * c[j] * np.exp(1j * phases[e])
                out.append(self._on(values))
        return out

    def refer(self, x, ref):
        return x - x[:, :, ref : ref + 1]

    def stored(self, x):
        k, out = len(self.names), np.array(x)
        for e in range(len(self.ends())):
            own = out[..., e * k : (e + 1) * k]
            own *= self.units()
            if "tec" in self.names and "offset" in self.names:  # the offset at frequency 0
                at = {n: own[..., j] for j, n in enumerate(self.names)}
                own[..., self.names.index("offset")] += TWO_PI * at["tec"] * self.band.tilt / self.band.width - TWO_PI * at.get("delay", 0.0) * self.band.centre
        return out

    def loaded(self, p):
        k, out = len(self.names), np.array(p, float)
        for e in range(len(self.ends())):
            own = out[..., e * k : (e + 1) * k]
            if "tec" in self.names and "offset" in self.names:
                at = {n: own[..., j] for j, n in enumerate(self.names)}
                own[..., self.names.index("offset")] -= TWO_PI * at["tec"] * self.band.tilt / self.band.width - TWO_PI * at.get("delay", 0.0) * self.band.centre
            own /= self.units()
        return out

    def shared(self):
        k = len(self.names)
        return [[e * k + j for e in range(len(self.ends()))] for j in range(k)]


class Phase(_Diagonal):
    names = ("offset",)


class Delay(_Diagonal):
    names = ("delay",)


class DelayAndOffset(_Diagonal):
    names = ("offset", "delay")


class DelayAndTec(_Diagonal):
    names = ("tec", "delay")


class DelayTecAndOffset(_Diagonal):
    names = ("offset", "tec", "delay")


class TecAndOffset(_Diagonal):
    names = ("offset", "tec")


class Amplitude(_Diagonal):
    residual = "amplitude"
    referenced = False
    names = ("amplitude",)
    numbness = 1e-6
    bilinear = True

    def start(self, shape):
        return np.ones((*shape, self.count()))

    def units(self):
        return np.ones(1)

    def gains(self, x, freq):
        return self._on([x[..., e].astype(complex) for e in range(len(self.ends()))])

    def slopes(self, x, freq):
        out = []
        for e in range(len(self.ends())):
            values = [np.zeros(x.shape[:-1], complex) for _ in self.ends()]
            values[e] = np.ones(x.shape[:-1], complex)
            out.append(self._on(values))
        return out

    def refer(self, x, ref):
        return x


class Rotation(Kind):
    corrs = (4,)

    def count(self):
        return 1

    def factor(self, freq: np.ndarray) -> np.ndarray:
        return np.ones_like(freq)

    def gains(self, x, freq):
        a = x[..., 0] * self.factor(freq)
        return as_matrix(np.stack([np.cos(a), -np.sin(a), np.sin(a), np.cos(a)], -1).astype(complex))

    def slopes(self, x, freq):
        f = self.factor(freq)
        a = x[..., 0] * f
        return [as_matrix((f[..., None] * np.stack([-np.sin(a), -np.cos(a), np.cos(a), -np.sin(a)], -1)).astype(complex))]


class RotationMeasure(Rotation):
    def factor(self, freq):
        return (LIGHT / freq) ** 2


class CrosshandPhase(Kind):
    corrs = (4,)

    def count(self):
        return 1

    def gains(self, x, freq):
        one = np.ones(x.shape[:-1], complex)
        return as_matrix(np.stack([np.exp(1j * x[..., 0]), 0 * one, 0 * one, one], -1))

    def slopes(self, x, freq):
        zero = np.zeros(x.shape[:-1], complex)
        return [as_matrix(np.stack([1j * np.exp(1j * x[..., 0]), zero, zero, zero], -1))]

    def step(self, loop, dependent):
        return 1.0


class CrosshandPhaseNullV(CrosshandPhase):
    """The phase that takes Stokes V out of the data; it doesn't look at the model."""

    def step(self, loop, dependent):
        return 0.5


class ParallacticAngle(Kind):
    """Feed rotation by given angles, of either receptor."""

    solvable = False
    circular = False

    def count(self):
        return 2

    def gains(self, x, freq):
        a, b = x[..., 0], x[..., 1]
        if self.circular:
            ends = np.stack([np.exp(-1j * a), np.exp(1j * b)], -1)
            if not self.full:
                return ends[..., : self.n_corr]
            zero = np.zeros_like(ends[..., 0])
            return as_matrix(np.stack([ends[..., 0], zero, zero, ends[..., 1]], -1))
        return as_matrix(np.stack([np.cos(a), np.sin(a), -np.sin(b), np.cos(b)], -1).astype(complex))


class FeedFlip(Kind):
    solvable = False
    corrs = (4,)

    def count(self):
        return 0

    def gains(self, x, freq):
        return np.broadcast_to(np.array([[0, 1], [1, 0]], complex), (*x.shape[:-1], 2, 2))


KINDS: dict[str, type[Kind]] = {
    "complex": Complex, "diag_complex": DiagComplex, "amplitude": Amplitude, "phase": Phase, "delay": Delay,
    "delay_and_offset": DelayAndOffset, "delay_and_tec": DelayAndTec, "delay_tec_and_offset": DelayTecAndOffset,
    "tec_and_offset": TecAndOffset, "rotation": Rotation, "rotation_measure": RotationMeasure,
    "crosshand_phase": CrosshandPhase, "crosshand_phase_null_v": CrosshandPhaseNullV, "leakage": Leakage,
    "parallactic_angle": ParallacticAngle, "feed_flip": FeedFlip,
}


@dataclass
class Chunk:
    """Flat arrays of a chunk: ``data`` (n, corr), ``model`` (n, dir, corr) and so on."""

    ant1: np.ndarray
    ant2: np.ndarray
    freq: np.ndarray
    data: np.ndarray
    model: np.ndarray
    weight: np.ndarray
    flag: np.ndarray
    n_ant: int

    @property
    def n_corr(self) -> int:
        return self.data.shape[-1]


@dataclass
class TermState:
    """A term in a chunk: its type, the interval of every entry, unknowns and flags (t, f, ant, dir)."""

    kind: Kind
    t: np.ndarray
    f: np.ndarray
    dependent: bool = False
    iterations: int = 25
    per_array: bool = False
    scalar: bool = False
    estimate: bool = True
    pinned: tuple[int, ...] = ()
    x: np.ndarray = field(default=None)  # type: ignore[assignment]
    flags: np.ndarray = field(default=None)  # type: ignore[assignment]
    jhj: np.ndarray = field(default=None)  # type: ignore[assignment]
    loops: int = 0
    converged: float = 0.0
    whole: tuple[int, int, int, int] | None = None  # the shape, where a chunk is only a part of its rows

    def shape(self, chunk: Chunk) -> tuple[int, int, int, int]:
        if self.whole:
            return self.whole
        n_dir = chunk.model.shape[1] if self.dependent else 1
        return (int(self.t.max(initial=-1)) + 1, int(self.f.max(initial=-1)) + 1, chunk.n_ant, n_dir)

    def at(self, ant: np.ndarray, direction: int) -> tuple:
        return self.t, self.f, ant, direction if self.dependent else 0

    def gain(self, chunk: Chunk, ant: np.ndarray, direction: int) -> np.ndarray:
        return self.kind.gains(self.x[self.at(ant, direction)], chunk.freq)


def covered(chunk: Chunk, term: TermState, flagged: bool = False) -> np.ndarray:
    """Intervals and antennas with data that aren't hard flagged, or with any data."""
    good, fine = np.zeros(term.shape(chunk)[:3], bool), (chunk.flag != 1) | flagged
    for ant in (chunk.ant1, chunk.ant2):
        good[term.t[fine], term.f[fine], ant[fine]] = True
    return good


def prepare(term: TermState, shape: tuple[int, int, int, int], good: np.ndarray) -> None:
    """Unknowns at their start, and flags: antennas and intervals all of whose data are flagged."""
    if term.x is None:
        term.x = term.kind.start(shape)
    term.flags = np.repeat(np.where(good, 0, 1)[..., None], shape[3], 3).astype(np.int8)
    term.x[term.flags == 1] = term.kind.start((1,))[0]


def start(chunk: Chunk, term: TermState) -> None:
    prepare(term, term.shape(chunk), covered(chunk, term))


def model_visibilities(chunk: Chunk, chain: list[TermState], directions=None) -> np.ndarray:
    """The corrupted model, summed over directions."""
    full, out = chunk.n_corr == 4, 0
    for d in range(chunk.model.shape[1]) if directions is None else directions:
        v = as_matrix(chunk.model[:, d])
        for term in reversed(chain):
            v = mul(mul(term.gain(chunk, chunk.ant1, d), v, full), herm(term.gain(chunk, chunk.ant2, d), full), full)
        out = out + v
    return as_vector(out, chunk.n_corr)


def chi_sums(chunk: Chunk, chain: list[TermState]) -> tuple[float, int]:
    """Weighted squares of residuals, and how many values they are of."""
    good = chunk.flag == 0
    if not good.any():
        return 0.0, 0
    r = (chunk.data - model_visibilities(chunk, chain))[good]
    return float((chunk.weight[good] * np.abs(r) ** 2).sum()), int(good.sum()) * chunk.n_corr


def chi_squared(chunk: Chunk, chain: list[TermState]) -> float:
    total, n = chi_sums(chunk, chain)
    return total / n if n else float("nan")


def _product(chunk: Chunk, terms: list[TermState], ant: np.ndarray, d: int) -> np.ndarray:
    full = chunk.n_corr == 4
    out = identity((len(ant),), chunk.n_corr)
    for term in terms:
        out = mul(out, term.gain(chunk, ant, d), full)
    return out


def normal_equations(chunk: Chunk, chain: list[TermState], active: int) -> tuple[np.ndarray, np.ndarray]:
    """jhj (cells, k, k) and jhr (cells, k) of the active term, over its (t, f, ant, dir)."""
    term, n_corr = chain[active], chunk.n_corr
    full, kind, shape = n_corr == 4, term.kind, term.shape(chunk)
    k, cells = kind.count(), int(np.prod(shape))
    dtype = float if kind.real else complex
    jhj, jhr = np.zeros((cells, k, k), dtype), np.zeros((cells, k), dtype)
    good = chunk.flag == 0
    w = np.where(good[:, None], chunk.weight, 0.0)
    if kind.referenced or kind.residual != "plain":  # diagonal terms look at parallel hands only
        w = w * np.array([1, 0, 0, 1]) if full else w
    if isinstance(kind, CrosshandPhaseNullV):
        return _null_v(chunk, chain, active, good, jhj, jhr)
    v = model_visibilities(chunk, chain)
    d = chunk.data
    size_v, size_d = np.abs(v), np.abs(d)
    if kind.residual == "phase":
        d = d * np.divide(size_v, size_d, out=np.zeros_like(size_v), where=size_d > 0)
        w = w * np.divide(1.0, size_v**2, out=np.zeros_like(size_v), where=size_v > 0)
    elif kind.residual == "amplitude":
        d = v * np.divide(size_d, size_v, out=np.zeros_like(size_v), where=size_v > 0)
    r = d - v
    joint: list[np.ndarray] = []
    for one, other, rest in ((chunk.ant1, chunk.ant2, r), (chunk.ant2, chunk.ant1, as_vector(herm(as_matrix(r), full), n_corr))):
        turned = one is chunk.ant2
        weights = w[:, [0, 2, 1, 3]] if turned and full else w
        slopes = {}
        for direction in range(chunk.model.shape[1]):
            inner = as_matrix(chunk.model[:, direction])
            inner = herm(inner, full) if turned else inner
            for t in reversed(chain[active + 1 :]):
                inner = mul(mul(t.gain(chunk, one, direction), inner, full), herm(t.gain(chunk, other, direction), full), full)
            right = mul(inner, herm(mul(_product(chunk, chain[:active], other, direction), term.gain(chunk, other, direction), full), full), full)
            left = _product(chunk, chain[:active], one, direction)
            own = [as_vector(mul(mul(left, s, full), right, full), n_corr) for s in kind.slopes(term.x[term.at(one, direction)], chunk.freq)]
            key = direction if term.dependent else 0
            slopes[key] = own if key not in slopes else [a + b for a, b in zip(slopes[key], own, strict=True)]
        if term.per_array and kind.real and not term.dependent:  # both antennas of a baseline move together
            if not turned:
                joint = slopes[0]
                continue
            own = [a + as_vector(herm(as_matrix(b), full), n_corr) for a, b in zip(joint, slopes[0], strict=True)]
            slopes, weights, rest = {0: own}, w, r
        for key, own in slopes.items():
            at = np.ravel_multi_index((term.t, term.f, one, np.full(len(one), key)), shape)
            j = np.stack(own, 1)  # (rows, unknowns, correlations)
            weighted = np.conj(j) * weights[:, None, :]
            _add(at, (jhr, (weighted @ rest[:, :, None])[..., 0]), (jhj, weighted @ np.swapaxes(j, 1, 2)))
    return jhj, jhr


#: Bytes of the coefficients between antennas beyond which each antenna is solved for by itself.
TOGETHER = 1 << 24


class Together:
    """The normal equations of a single term that is alike in all directions, with the coefficients between the antennas of an interval.

    A residual r = D - P X Q^H, with X the summed model, has the derivatives Y = X Q^H by the unknowns of P and
    Z = P X by the conjugate ones of Q. Rows are the last axis, in the order of intervals and baselines, whose sums are all that's needed.
    Of matrices, the gains come out of the sums, so that those of X and D over the rows are formed once, before the iterations.
    """

    def __init__(self, chunk: Chunk, term: TermState):
        self.term, n_corr, full = term, chunk.n_corr, chunk.n_corr == 4
        self.kind, self.shape = self.term.kind, self.term.shape(chunk)
        good = np.flatnonzero(chunk.flag == 0)
        t, f, p, q = self.term.t[good], self.term.f[good], chunk.ant1[good], chunk.ant2[good]
        baseline = np.ravel_multi_index((t, f, p, q), (*self.shape[:3], self.shape[2]))
        order = np.argsort(baseline, kind="stable")
        rows, baseline = good[order], baseline[order]
        self.first = np.flatnonzero(np.concatenate([[True], baseline[1:] != baseline[:-1]])) if len(rows) else np.empty(0, int)
        cell, self.one, self.other = np.unravel_index(baseline[self.first], (self.shape[0] * self.shape[1], self.shape[2], self.shape[2]))
        self.cell, self.rows_p, self.rows_q = cell, baseline // self.shape[2], baseline // self.shape[2] ** 2 * self.shape[2] + q[order]
        ends = [0, 3] if full and not (self.kind.residual == "plain" and not self.kind.referenced) else list(range(n_corr))
        self.matrix = len(ends) == 4
        self.x, self.d, self.w = (np.ascontiguousarray(x[:, ends].T) for x in (chunk.model[rows].sum(1), chunk.data[rows], chunk.weight[rows]))
        if self.matrix:
            self.x, self.d, self.w = (x.reshape(2, 2, -1) for x in (self.x, self.d, self.w))
            self.fixed = np.eye(2, dtype=complex).ravel() if isinstance(self.kind, Leakage) else np.zeros(4, complex)
            self.xd, self.xx = self._moments()
            del self.x, self.d, self.w

    def __call__(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """jhj and jhr as of :func:`normal_equations`, and the sums (t and f, ant, unknown, ant, unknown) that multiply the conjugate
        unknowns of the other antenna."""
        k, (_, _, n_ant, _) = self.kind.count(), self.shape
        cells, dtype = self.shape[0] * self.shape[1], float if self.kind.real else complex
        jhj, jhr = np.zeros((cells, n_ant, k, k), dtype), np.zeros((cells, n_ant, k), dtype)
        cross = np.zeros((cells, n_ant, k, n_ant, k), dtype)
        if len(self.first):
            g = self.term.x.reshape(cells * n_ant, k).T
            sums = self._of_matrices(g) if self.matrix else self._of_ends(g)
            left_r, right_r, left_j, right_j, both = (x if np.iscomplexobj(cross) else x.real for x in sums)
            at, to = (self.cell, self.one), (self.cell, self.other)
            for where, r, j in ((at, left_r, left_j), (to, right_r, right_j)):
                np.add.at(jhr, where, r)
                np.add.at(jhj, where, j)
            cross[self.cell, self.one, :, self.other] += both  # a baseline has one entry
            cross[self.cell, self.other, :, self.one] += np.swapaxes(both, 1, 2)
        return jhj.reshape(-1, k, k), jhr.reshape(-1, k), cross

    def _summed(self, values: np.ndarray) -> np.ndarray:
        return np.moveaxis(np.add.reduceat(values, self.first, axis=-1), -1, 0)

    def _of_ends(self, g: np.ndarray) -> tuple[np.ndarray, ...]:
        p, q = g[:, self.rows_p], g[:, self.rows_q]
        y, z = self.x * np.conj(q), p * self.x
        v = p * y
        r = self.d - v
        if self.kind.residual == "amplitude":
            size = np.abs(v)
            r = v * np.divide(np.abs(self.d), size, out=np.zeros_like(size), where=size > 0) - v
        wy, wz = self.w * np.conj(y), self.w * z
        diagonal = lambda x: self._summed(x)[:, :, None] * np.eye(len(g))
        return self._summed(wy * r), self._summed(wz * np.conj(r)), diagonal(wy * y), diagonal(wz * np.conj(z)), diagonal(wy * z)

    def _moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums over a baseline's rows of w_ij conj(x_bc) d_ij as (i, j, b, c, baseline), and of w_ij conj(x_bc) x_de."""
        n = len(self.first)
        xd, xx = np.zeros((2, 2, 2, 2, n), complex), np.zeros((2, 2, 2, 2, 2, 2, n), complex)
        if not n:
            return xd, xx
        places = [(b, c) for b in range(2) for c in range(2)]
        sums = lambda values: np.add.reduceat(values, self.first, axis=-1)
        wd = self.w * self.d
        for m, (b, c) in enumerate(places):
            own = np.conj(self.x[b, c])
            xd[:, :, b, c] = sums(own * wd)
            for d, e in places[m:]:
                xx[:, :, b, c, d, e] = sums(self.w * (own * self.x[d, e]))
                xx[:, :, d, e, b, c] = np.conj(xx[:, :, b, c, d, e])
        return xd, xx

    def _of_matrices(self, g: np.ndarray) -> tuple[np.ndarray, ...]:
        known, n_ant = self.kind.elements(), self.shape[2]
        whole = np.repeat(self.fixed[:, None], g.shape[1], 1)
        whole[known] = g
        p, q = (whole[:, self.cell * n_ant + ant].reshape(2, 2, -1) for ant in (self.one, self.other))
        cp, cq = np.conj(p), np.conj(q)
        one = self.xx * q[None, :, None, :, None, None]
        one = one[:, :, :, 0] + one[:, :, :, 1]  # conj(y_bj) x_de by w_ij: (i, j, b, d, e)
        yy = one[..., 0, :] * cq[None, :, None, None, 0] + one[..., 1, :] * cq[None, :, None, None, 1]  # conj(y_bj) y_dj
        yz = one[:, :, :, 0] * p[:, 0, None, None, None] + one[:, :, :, 1] * p[:, 1, None, None, None]  # conj(y_bj) z_ie
        two = self.xx * cp[:, None, :, None, None, None]
        two = two[:, :, 0] + two[:, :, 1]  # conj(z_ic) x_de: (i, j, c, d, e)
        zz = two[:, :, :, 0] * p[:, 0, None, None, None] + two[:, :, :, 1] * p[:, 1, None, None, None]  # conj(z_ic) z_ie
        yd = (self.xd * q[None, :, None, :]).sum(3)
        zd = (self.xd * cp[:, None, :, None]).sum(2)
        left_r = (yd - (yy * p[:, None, None, :]).sum(3)).sum(1)  # (i, b)
        right_r = np.conj((zd - (zz * cq[None, :, None, :]).sum(3)).sum(0))  # (j, c)
        left_j, right_j = yy.sum(1), np.conj(zz.sum(0))  # (i, b, d) and (j, c, e)
        n, k = len(self.first), len(known)
        own = [divmod(e, 2) for e in known]
        out_j = [np.zeros((n, k, k), complex) for _ in range(3)]
        for a, (i, b) in enumerate(own):
            for c, (j, d) in enumerate(own):
                if i == j:
                    out_j[0][:, a, c], out_j[1][:, a, c] = left_j[i, b, d], right_j[i, b, d]
                out_j[2][:, a, c] = yz[i, j, b, d]
        return left_r.reshape(4, n)[known].T, right_r.reshape(4, n)[known].T, *out_j


def equations(chunk: Chunk, chain: list[TermState], active: int) -> Callable[[], tuple[np.ndarray, ...]]:
    """What tells the normal equations of the active term at its present unknowns: with the coefficients between antennas for a term
    that is the whole chain. Terms of longer chains take turns, and an exact solution of one is out of date after the next turn."""
    term, shape = chain[active], chain[active].shape(chunk)
    alone = len(chain) > 1 or not term.kind.bilinear or term.dependent or term.per_array or term.scalar
    if alone or shape[0] * shape[1] * (shape[2] * term.kind.count()) ** 2 * 16 > TOGETHER:
        return lambda: normal_equations(chunk, chain, active)
    return Together(chunk, term)


def _solved_together(jhj: np.ndarray, jhr: np.ndarray, cross: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """Updates (cells, ant, unknown) of all antennas at once, H u + C conj(u) = r; those that don't move are held."""
    cells, n_ant, k = jhr.shape
    n = n_ant * k
    held = np.repeat(~moving, k, 1)
    h = np.zeros((cells, n_ant, k, n_ant, k), jhj.dtype)
    ants = np.arange(n_ant)
    h[:, ants, :, ants] = np.swapaxes(jhj, 0, 1)
    h, c, r = h.reshape(cells, n, n), cross.reshape(cells, n, n), jhr.reshape(cells, n)
    if np.iscomplexobj(h):
        m = np.block([[h.real + c.real, c.imag - h.imag], [h.imag + c.imag, h.real - c.real]])
        r, held = np.concatenate([r.real, r.imag], 1), np.concatenate([held, held], 1)
    else:
        m = h + c
    m = np.where(held[:, :, None] | held[:, None, :], 0.0, m)
    size = np.trace(m, axis1=1, axis2=2) / np.maximum(1, (~held).sum(1))
    m[:, np.arange(m.shape[1]), np.arange(m.shape[1])] += np.where(held, 1.0, 1e-10 * size[:, None] + (size <= 1e-12)[:, None])
    u = np.linalg.solve(m, np.where(held, 0.0, r)[..., None])[..., 0]
    return (u[:, :n] + 1j * u[:, n:] if np.iscomplexobj(h) else u).reshape(cells, n_ant, k)


def _add(at: np.ndarray, *sums: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds rows of values to the cells ``at`` of totals."""
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    cells = at[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    for total, values in sums:
        values = values if np.iscomplexobj(total) else values.real
        total[cells[first]] += np.add.reduceat(values[order], first, axis=0)


def _null_v(chunk, chain, active, good, jhj, jhr):
    """Stokes V of the data without the chain up to the active term, and its slope by the phase."""
    term = chain[active]
    p, q = (_invert(_product(chunk, chain[: active + 1], ant, 0)) for ant in (chunk.ant1, chunk.ant2))
    c = as_vector(p @ as_matrix(chunk.data) @ herm(q, True), 4)
    v = 0.5j * (c[:, 2] - c[:, 1])
    slope = -0.5 * (c[:, 1] + c[:, 2])
    for ant in (chunk.ant1, chunk.ant2):
        at = np.ravel_multi_index((term.t, term.f, ant, np.zeros(len(ant), int)), term.shape(chunk))
        jhr[:, 0] += np.bincount(at, np.where(good, -(np.conj(slope) * v).real, 0), len(jhr))
        jhj[:, 0, 0] += np.bincount(at, np.where(good, np.abs(slope) ** 2, 0), len(jhr))
    return jhj, jhr


def _invert(g: np.ndarray) -> np.ndarray:
    """Inverse matrices, 0 where singular."""
    det = g[..., 0, 0] * g[..., 1, 1] - g[..., 0, 1] * g[..., 1, 0]
    bad = np.abs(det) < 1e-6
    made = np.stack([g[..., 1, 1], -g[..., 0, 1], -g[..., 1, 0], g[..., 0, 0]], -1).reshape(g.shape)
    return np.where(bad[..., None, None], 0, made / np.where(bad, 1, det)[..., None, None])


def _solved(jhj: np.ndarray, jhr: np.ndarray) -> np.ndarray:
    """Updates; 0 where nothing is known. A ridge far below the diagonal keeps near-singular systems tame."""
    size = np.trace(jhj, axis1=1, axis2=2).real / max(1, jhj.shape[1])
    ok = size > 1e-12
    safe = jhj + (1e-9 * size + ~ok)[:, None, None] * np.eye(jhj.shape[1])
    out = np.linalg.solve(safe, jhr[..., None])[..., 0]
    out[~ok] = 0
    return out


def _collapse(term: TermState, shape, jhj: np.ndarray, jhr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One solution for all antennas, or for all correlations."""
    if term.per_array:
        for m in (jhj, jhr):
            view = m.reshape(*shape, *m.shape[1:])
            view[:] = view.sum(2, keepdims=True)
    if term.scalar:
        same = np.zeros((jhr.shape[1], jhr.shape[1]))
        for group in term.kind.shared():
            same[np.ix_(group, group)] = 1
        # The sums over correlations stand in each of them, so that all get the same update.
        jhr = jhr @ same
        n = same.sum(1).max()
        jhj = same @ jhj @ same / n if n == 1 else _spread(same @ jhj @ same, term.kind.shared())
    return jhj, jhr


def _spread(jhj: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    out = np.zeros_like(jhj)
    for e in range(len(groups[0])):
        for g in groups:
            for h in groups:
                out[:, g[e], h[e]] = jhj[:, g[0], h[0]]
    return out


#: The square of an update beside that of the gains up to which it may be one of all antennas together.
NEAR = 0.1


class Iteration:
    """Gauss-Newton iterations of one term: what they need to know besides the sums over the data."""

    def __init__(self, term: TermState, shape: tuple[int, int, int, int], freqs: tuple[float, float, float], stop_fraction: float = 0.99, criterion: float = 1e-6):
        self.term, self.shape, self.freqs, self.stop_fraction, self.criterion = term, shape, freqs, stop_fraction, criterion
        self.start_value = term.kind.start((1,))[0]
        self.before = self.look()
        self.moved, self.trend = np.zeros(shape), np.zeros(shape)
        self.reach, self.fresh = np.full(shape[:2], NEAR), np.zeros(shape[:2], bool)
        term.loops, term.converged = 0, 0.0

    def look(self) -> np.ndarray:
        """The gains at the ends and the middle of the band."""
        x = self.term.x
        return np.stack([self.term.kind.gains(x, np.full(x.shape[:-1], f)) for f in self.freqs], -1)

    def _near(self, update: np.ndarray, jhj: np.ndarray, jhr: np.ndarray, cross: np.ndarray) -> np.ndarray:
        """The update of all antennas of an interval together, where it is small beside the gains and smaller than the one before.
        Elsewhere the damped one of single antennas, which finds the way from afar, and for good once the other has grown."""
        t, f, n_ant, _ = self.shape
        k, x = jhr.shape[-1], self.term.x.reshape(t * f, n_ant, -1)
        moving = (self.term.flags != 1).reshape(t * f, n_ant) & (np.trace(jhj, axis1=1, axis2=2).real.reshape(t * f, n_ant) > 1e-12)
        whole = _solved_together(jhj.reshape(t * f, n_ant, k, k), jhr.reshape(t * f, n_ant, k), cross, moving)
        size = np.maximum((np.abs(x) ** 2).sum((1, 2)), moving.sum(1))
        part = ((np.abs(whole) ** 2).sum((1, 2)) / np.maximum(size, 1)).reshape(t, f)
        grown = (self.reach < NEAR) & (part > np.maximum(self.reach, 1e-20))
        take = (self.reach > 0) & (part < NEAR) & ~grown
        self.fresh = take & (self.reach == NEAR)
        self.reach = np.where(grown, 0.0, np.where(take, part, self.reach))
        return np.where(take[..., None, None, None], whole.reshape(update.shape), update)

    def step(self, jhj: np.ndarray, jhr: np.ndarray, cross: np.ndarray | None = None) -> bool:
        """Moves the unknowns by the normal equations; tells whether enough of them have come to rest."""
        term, kind, shape, loop = self.term, self.term.kind, self.shape, self.term.loops
        jhj, jhr = _collapse(term, shape, jhj, jhr)
        update = kind.step(loop, term.dependent) * _solved(jhj, jhr).reshape(term.x.shape)
        if term.dependent:
            update[:, :, :, list(term.pinned)] = 0
        if cross is not None and loop:  # the first step is always the damped one
            update = self._near(update, jhj, jhr, cross)
        term.x = np.where((term.flags == 1)[..., None], term.x, term.x + update)
        term.jhj, term.loops = jhj.reshape(*shape, kind.count(), kind.count()), loop + 1
        now = self.look()
        axes = tuple(range(4, now.ndim))
        size, change = (np.abs(self.before) ** 2).sum(axes), (np.abs(now - self.before) ** 2).sum(axes)
        hard = term.flags == 1
        dead = ~hard & (size == 0)
        term.flags[dead] = 1
        done = np.zeros(shape, bool)
        if loop >= 2:
            older = self.trend.copy()
            self.trend = np.where(hard | dead | self.fresh[..., None, None], self.trend, self.trend + change - self.moved)
            with np.errstate(divide="ignore", invalid="ignore"):
                done = ~hard & ~dead & (change / size < self.criterion**2)
            calm = ~hard & ~dead & ~done & (self.trend < older) & (older < kind.numbness)
            wild = ~hard & ~dead & ~done & (self.trend > older) & (older > kind.numbness)
            term.flags[wild] = np.where(term.flags[wild] != 0, 1, -1)
            term.flags[done | calm] = 0
        self.moved = np.where(hard, self.moved, change)
        term.x[term.flags == 1] = self.start_value
        left = (term.flags != 1).sum()
        term.converged = float(done.sum() / left) if left else 0.0
        if term.converged >= self.stop_fraction:
            return True
        self.before = self.look()
        return False

    def finish(self, reference: int = 0) -> None:
        term, kind = self.term, self.term.kind
        term.flags[self.trend > max(1e-6, kind.numbness if kind.numbness > 1 else 0)] = 1
        term.flags[term.flags == -1] = 0
        if kind.referenced and not term.per_array:
            term.x = kind.refer(term.x, reference)
        term.x[term.flags == 1] = self.start_value


def flag_data(chunk: Chunk, term: TermState) -> None:
    """Data of flagged gains, of terms that are alike in all directions."""
    if not term.dependent:
        bad = (term.flags[term.at(chunk.ant1, 0)] == 1) | (term.flags[term.at(chunk.ant2, 0)] == 1)
        chunk.flag = np.where(bad, 1, chunk.flag).astype(np.int8)


def ends_of(freq: np.ndarray) -> tuple[float, float, float]:
    return (float(freq.min()), float(freq.mean()), float(freq.max())) if len(freq) else (1.0, 1.0, 1.0)


def solve_term(chunk: Chunk, chain: list[TermState], active: int, stop_fraction: float = 0.99, criterion: float = 1e-6, reference: int = 0, propagate: bool = True) -> None:
    """Gauss-Newton iterations of one term with the others fixed."""
    term = chain[active]
    kind, shape = term.kind, term.shape(chunk)
    run = Iteration(term, shape, ends_of(chunk.freq), stop_fraction, criterion)
    if not kind.solvable or not term.iterations:
        if kind.solvable:
            term.jhj = normal_equations(chunk, chain, active)[0].reshape(*shape, kind.count(), kind.count())
        return
    sums = equations(chunk, chain, active)
    for _ in range(term.iterations):
        if run.step(*sums()):
            break
    run.finish(reference)
    if propagate:
        flag_data(chunk, term)


def estimated(kind: Kind, term: TermState) -> bool:
    return bool({"delay", "tec"} & set(getattr(kind, "names", ()))) and term.estimate


def coherent(chunk: Chunk, term: TermState, channels: np.ndarray, reference: int = 0) -> np.ndarray:
    """Sums of data over the model on baselines to the reference antenna: (ends, t, f, ant, channel)."""
    fine = (chunk.flag == 0) & (chunk.ant1 != chunk.ant2) & ((chunk.ant1 == reference) | (chunk.ant2 == reference))
    chan, shape = np.searchsorted(channels, chunk.freq), term.shape(chunk)
    with_model = chunk.data * np.conj(chunk.model.sum(1))
    ends = term.kind.ends()
    total = np.zeros((len(ends), *shape[:3], len(channels)), complex)
    first = chunk.ant1[fine] == reference
    at = (term.t[fine], term.f[fine], np.where(first, chunk.ant2[fine], chunk.ant1[fine]), chan[fine])
    for e, corr in enumerate(ends):
        value = with_model[fine, corr]
        np.add.at(total[e], at, np.where(first, np.conj(value), value))
    return total


#: Dispersions times channels that are tried together, which bounds how many turns over the band are looked for; at least 8 are.
TRIALS = 1 << 16


def guess(term: TermState, channels: np.ndarray, total: np.ndarray) -> None:
    """First guesses of delays and dispersions: the peak of the coherent sum over frequency, over dispersions and the delays of a
    Fourier transform padded eightfold (a plain transform where channels aren't evenly spaced)."""
    kind = term.kind
    names = kind.names
    if len(channels) < 2:
        return
    k, by = len(names), dict(zip(names, kind.coefficients(channels), strict=True))
    gaps = np.diff(channels)
    spacing, n = gaps.min() / kind.band.centre, 8 * len(channels)
    even = np.allclose(gaps, gaps[0], rtol=1e-6)
    delays = np.fft.fftfreq(n) / spacing if "delay" in by else np.zeros(1)
    tecs = np.zeros(1)
    if "tec" in by:
        turn = TWO_PI / (np.ptp(by["tec"]) or 1.0)
        most = np.pi / (np.abs(np.diff(by["tec"])).max() or 1.0) / turn  # half a turn from one channel to the next
        wraps = int(max(8, min(most, TRIALS / len(channels) / 20)))
        tecs = turn * np.linspace(-wraps, wraps, 20 * wraps + 1)
    wave_t = np.exp(-1j * np.outer(tecs, by.get("tec", np.zeros(len(channels)))))

    def along(values: np.ndarray) -> np.ndarray:
        if "delay" not in by:
            return np.abs(values.sum(-1, keepdims=True))
        if even:
            return np.abs(np.fft.fft(values, n, axis=-1))
        return np.concatenate([np.abs(values @ np.exp(-1j * np.outer(by["delay"], part))) for part in np.array_split(delays, 8)], axis=-1)

    for e, t, f, a in np.argwhere(np.abs(total).sum(-1) > 0):
        own, best = total[e, t, f, a], (-1.0, 0, 0)
        for at in range(0, len(tecs), 256):
            peak = along(own * wave_t[at : at + 256])
            i, j = np.unravel_index(peak.argmax(), peak.shape)
            best = max(best, (float(peak[i, j]), int(at + i), int(j)))
        _, i, j = best
        found = {"delay": delays[j], "tec": tecs[i]}
        left = (own * wave_t[i] * np.exp(-1j * delays[j] * by.get("delay", np.zeros(len(channels))))).sum()
        found["offset"] = float(np.angle(left))
        for m, name in enumerate(names):
            term.x[t, f, a, :, e * k + m] = found[name]
    term.x[term.flags == 1] = kind.start((1,))[0]


def estimate(chunk: Chunk, term: TermState, reference: int = 0) -> None:
    if estimated(term.kind, term):
        channels = np.unique(chunk.freq)
        guess(term, channels, coherent(chunk, term, channels, reference))


def robust(chunk: Chunk, chain: list[TermState], state: dict) -> None:
    """Student-t weights from the present residuals."""
    from ..operators.weights import START_DOF, degrees_of_freedom

    good = chunk.flag == 0
    if not good.any():
        return
    size = np.abs(chunk.data - model_visibilities(chunk, chain)) ** 2
    etas = lambda icov, dof: np.where(good, (dof + chunk.n_corr) / (dof + (size * icov).sum(1)), 0.0)
    if not state:
        state.update(dof=START_DOF, eta=etas(chunk.weight[good].mean(0), START_DOF))
    total = (state["eta"][good, None] * size[good]).mean(0)
    icov = np.divide(1.0, total, out=np.zeros_like(total), where=total > 0)
    own = state["eta"][good]
    state["dof"] = degrees_of_freedom(float((np.log(own) - own).mean()), state["dof"], chunk.n_corr)
    state["eta"] = etas(icov, state["dof"])
    chunk.weight = state["eta"][:, None] * icov


def solve(chunk: Chunk, chain: list[TermState], recipe: tuple[int, ...], use_robust: bool = False, reference: int = 0, **options) -> dict:
    """Goes through the chain by the recipe of iterations; returns chi-squared before and after."""
    for term in chain:
        loaded = term.x is not None
        start(chunk, term)
        if not loaded and any(recipe):
            estimate(chunk, term, reference)
    before, state = chi_squared(chunk, chain), {}
    rounds = len(recipe) // len(chain)
    for k in range(rounds):
        for active, term in enumerate(chain):
            term.iterations = recipe[k * len(chain) + active]
            solve_term(chunk, chain, active, reference=reference, **options)
        if use_robust and k < rounds - 1:
            robust(chunk, chain, state)
    return {"pre": before, "post": chi_squared(chunk, chain)}
