"""Options: units, recipes, dataclasses with their rules, YAML and command line."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields, make_dataclass

# Units.
TIME_UNITS = {"s": 1.0}
FREQ_UNITS = {"Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9}
#: Correlation codes of measurement sets.
CORRELATIONS = {5: "RR", 6: "RL", 7: "LR", 8: "LL", 9: "XX", 10: "XY", 11: "YX", 12: "YY"}


def _measured(value, units: dict[str, float]) -> int | float:
    """A bare whole number counts slots or channels (int); one with a unit is a length (float)."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return value
    m = re.fullmatch(r"\s*([0-9.]+(?:[eE][+-]?[0-9]+)?)\s*([A-Za-z]*)\s*", str(value))
    if not m or m[2] and m[2] not in units:
        raise ValueError(f"{value!r} is no number with one of the units {', '.join(units)}")
    return float(m[1]) * units[m[2]] if m[2] else int(float(m[1]))


def as_time(value) -> int | float:
    return _measured(value, TIME_UNITS)


def as_freq(value) -> int | float:
    return _measured(value, FREQ_UNITS)


@dataclass(frozen=True)
class Recipe:
    """Per direction, the model columns (or sky models) with the sign they are added with; None is the identity.

    ``dd`` marks sky models whose clusters become directions of their own (``name@tag,tag``).
    """

    directions: list[list[tuple[int, str, tuple[str, ...]]]]

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(name for d in self.directions for _, name, _ in d if not _is_sky(name)))

    @property
    def sky_models(self) -> list[str]:
        return list(dict.fromkeys(name for d in self.directions for _, name, _ in d if _is_sky(name)))

    @property
    def is_identity(self) -> bool:
        return not any(self.directions)


def _is_sky(name: str) -> bool:
    return name.endswith((".html", ".txt", ".lsm"))


def parse_recipe(text: str | None) -> Recipe:
    """``:`` starts a direction, ``+`` adds, ``~`` subtracts; a leading ``~`` subtracts from nothing."""
    if not text:
        return Recipe([[]])
    out = []
    for part in re.split(r":(?!//)", re.sub(r"\s", "", text)):
        pieces = re.split(r"([+~])", part)
        terms, sign = [], 1
        if not part or pieces[-1] == "":
            raise ValueError(f"a model is missing in {text!r}")
        for k, piece in enumerate(pieces):
            if piece in ("+", "~"):
                sign = 1 if piece == "+" else -1
            elif piece:
                name, _, tags = piece.partition("@")
                terms.append((sign, name, tuple(t for t in tags.split(",") if t)))
                sign = 1
            elif k:
                raise ValueError(f"two operations stand together in {text!r}")
        if sum(bool(t[2]) for t in terms) > 1:
            raise ValueError("only one model of a direction can have directions of its own")
        out.append(terms)
    return Recipe(out)


class ConfigError(ValueError):
    pass


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise ConfigError(message)


@dataclass
class InputOptions:
    path: str = ""
    data_column: str = "data"
    weight_column: str = ""
    sigma_column: str = ""
    time_chunk: int | float | str = 0
    freq_chunk: int | float | str = 0
    group_by: tuple[str, ...] = ("scan", "field", "ddid")
    select_fields: tuple[int, ...] = ()
    select_ddids: tuple[int, ...] = ()
    select_corr: tuple[int, ...] = ()
    select_uv_range: tuple[float, float] = (0.0, 0.0)
    is_bda: bool = False

    def __post_init__(self) -> None:
        self.time_chunk, self.freq_chunk = as_time(self.time_chunk), as_freq(self.freq_chunk)
        _check(not self.weight_column or not self.sigma_column, "give a weight column or a sigma column")
        _check({"field", "ddid"} <= set(self.group_by) <= {"scan", "field", "ddid"}, "rows are grouped by field and ddid, and scan or not")
        _check(len(self.select_uv_range) == 2, "a uv range has two ends")
        _check(not self.is_bda or bool(self.weight_column), "averaged data need a weight column")


@dataclass
class ModelOptions:
    recipe: str = ""
    beam: str = ""
    beam_l_axis: tuple[float, ...] = ()
    beam_m_axis: tuple[float, ...] = ()
    invert_uvw: bool = True
    apply_p_jones: bool = False


@dataclass
class OutputOptions:
    path: str = ""
    products: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    flags: bool = True
    net_gains: tuple[tuple[str, ...], ...] = ()
    compute_baseline_corrections: bool = False
    apply_baseline_corrections: bool = False
    subtract_directions: tuple[int, ...] = ()
    apply_p_jones_inv: bool = False

    # The products.
    PRODUCTS = ("residual", "corrected_residual", "corrected_data", "corrected_weight", "weight", "model_data")

    def __post_init__(self) -> None:
        _check(set(self.products) <= set(self.PRODUCTS), f"products are {', '.join(self.PRODUCTS)}")
        _check(len(self.products) == len(self.columns), "each product needs a column")
        _check(self.compute_baseline_corrections or not self.apply_baseline_corrections, "baseline corrections must be computed to be applied")


@dataclass
class MadOptions:
    enable: bool = False
    whitening: str = "disabled"
    threshold_bl: float = 10.0
    threshold_global: float = 12.0
    max_deviation: float = 0.0
    use_off_diagonals: bool = False

    def __post_init__(self) -> None:
        _check(self.whitening in ("disabled", "native", "robust"), "whitening is disabled, native or robust")


@dataclass
class SolverOptions:
    terms: tuple[str, ...] = ("G",)
    iter_recipe: tuple[int, ...] = (25,)
    robust: bool = False
    propagate_flags: bool = True
    convergence_fraction: float = 0.99
    convergence_criteria: float = 1e-6
    reference_antenna: int = 0

    def __post_init__(self) -> None:
        _check(len(set(self.terms)) == len(self.terms), "terms need names of their own")
        _check(len(self.iter_recipe) % len(self.terms) == 0, "the iteration recipe must go through all terms")
        _check(0 < self.convergence_fraction <= 1, "the convergence fraction is above 0 and at most 1")


TERM_TYPES = (
    "complex", "diag_complex", "amplitude", "phase", "delay", "delay_and_offset", "delay_and_tec", "delay_tec_and_offset",
    "tec_and_offset", "rotation", "rotation_measure", "crosshand_phase", "crosshand_phase_null_v", "leakage",
    "parallactic_angle", "feed_flip",
)
PER_ARRAY = ("crosshand_phase", "crosshand_phase_null_v")
NO_SCALAR = ("complex", "leakage", "rotation", "rotation_measure", "crosshand_phase", "crosshand_phase_null_v")


@dataclass
class TermOptions:
    name: str = "G"
    type: str = "complex"
    direction_dependent: bool = False
    time_interval: int | float | str = 1
    freq_interval: int | float | str = 1
    solve_per: str = "antenna"
    scalar: bool = False
    pinned_directions: tuple[int, ...] = ()
    respect_scan_boundaries: bool = True
    initial_estimate: bool = True
    load_from: str = ""
    interp_method: str = "2dlinear"

    def __post_init__(self) -> None:
        self.time_interval, self.freq_interval = as_time(self.time_interval), as_freq(self.freq_interval)
        _check(self.type in TERM_TYPES, f"there is no term type {self.type}")
        _check(self.solve_per in ("antenna", "array"), "terms are solved per antenna or array")
        _check(self.type not in PER_ARRAY or self.solve_per == "array", f"{self.type} must be solved per array")
        _check(not self.scalar or self.type not in NO_SCALAR, f"{self.type} has no scalar mode")
        _check(self.interp_method in ("2dlinear", "2dspline"), "interpolation is 2dlinear or 2dspline")
        if self.type == "parallactic_angle":
            self.time_interval, self.freq_interval = 1, 0


SECTIONS = {"input_ms": InputOptions, "input_model": ModelOptions, "output": OutputOptions, "mad_flags": MadOptions, "solver": SolverOptions}


@dataclass
class Config:
    input_ms: InputOptions = field(default_factory=InputOptions)
    input_model: ModelOptions = field(default_factory=ModelOptions)
    output: OutputOptions = field(default_factory=OutputOptions)
    mad_flags: MadOptions = field(default_factory=MadOptions)
    solver: SolverOptions = field(default_factory=SolverOptions)
    terms: dict[str, TermOptions] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in self.solver.terms:
            self.terms.setdefault(name, TermOptions(name))
        _check(self.mad_flags.whitening != "robust" or self.solver.robust, "robust whitening needs the robust solver")
        _check(set(self.terms) == set(self.solver.terms), "a section doesn't belong to a term of solver.terms")
        for net in self.output.net_gains:
            _check(set(net) <= set(self.solver.terms), "net gains are products of terms")

    def chain(self) -> list[TermOptions]:
        return [self.terms[n] for n in self.solver.terms]


def load(*sources: str | dict, arguments: list[str] | None = None) -> Config:
    """YAML files or dicts, then ``section.option=value`` arguments; later ones win."""
    import yaml

    merged: dict[str, dict] = {}
    for source in sources:
        if isinstance(source, str):
            with open(source) as f:
                source = yaml.safe_load(f) or {}
        for section, options in source.items():
            merged.setdefault(section, {}).update(options or {})
    for argument in arguments or ():
        path, equals, value = argument.partition("=")
        section, dot, option = path.partition(".")
        _check(bool(equals and dot), f"{argument!r} isn't section.option=value")
        merged.setdefault(section, {})[option] = yaml.safe_load(value)
    made = {}
    for name, kind in SECTIONS.items():
        made[name] = _section(kind, name, merged.pop(name, {}))
    terms = {n: _section(TermOptions, n, {"name": n} | merged.pop(n, {})) for n in made["solver"].terms}
    _check(not merged, f"unknown sections: {', '.join(merged)}")
    return Config(**made, terms=terms)


def _section(kind, name: str, options: dict):
    known = {f.name for f in fields(kind)}
    _check(set(options) <= known, f"unknown options of {name}: {', '.join(sorted(set(options) - known))}")
    return kind(**{k: _tuples(v) for k, v in options.items()})


def _tuples(value):
    return tuple(_tuples(v) for v in value) if isinstance(value, list) else value


def blank(terms: tuple[str, ...] = ("G",)) -> str:
    """A YAML text of all options at their defaults."""
    import yaml

    config = Config(solver=SolverOptions(terms=terms, iter_recipe=(25,) * len(terms)))
    plain = {k: asdict(getattr(config, k)) for k in SECTIONS} | {n: asdict(t) for n, t in config.terms.items()}
    lists = lambda v: [lists(x) for x in v] if isinstance(v, tuple) else {k: lists(x) for k, x in v.items()} if isinstance(v, dict) else v
    return yaml.safe_dump(lists(plain), sort_keys=False)


def help_text() -> str:
    """Every option with its default."""
    lines = []
    for name, kind in {**SECTIONS, "<term>": TermOptions}.items():
        lines.append(name)
        lines += [f"  {name}.{f.name} = {f.default!r}" for f in fields(kind)]
    return "\n".join(lines)


def final_config(config: Config) -> list[str]:
    """Lines of all sections for a log."""
    out = []
    for name in SECTIONS:
        out += [f"{name}.{k} = {v!r}" for k, v in asdict(getattr(config, name)).items()]
    for name, term in config.terms.items():
        out += [f"{name}.{k} = {v!r}" for k, v in asdict(term).items()]
    return out


def schema_of(kind) -> type:
    """The options of a section as a class of optional fields, for external runners."""
    return make_dataclass(f"{kind.__name__}Schema", [(f.name, object, field(default=None)) for f in fields(kind)])
