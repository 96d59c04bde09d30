"""Reading and writing measurement tables, gains, backups and sky models."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser
from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning
from ..plans.config import CORRELATIONS
from ..plans.schemas import CHUNK, KEYS, SOURCES, SUB_TABLES


def read_sub_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The small tables beside the main one."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SUB_TABLES.items()}


def read_main(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """The main table, (scan, field, ddid)-partitioned on disk; only ``columns`` are read if given."""
    vis = spark.read.parquet(f"{path}/MAIN")
    missing = set(columns) - set(vis.columns)
    if missing:
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    return vis.select(*columns) if columns else vis


def correlation_names(tables: dict[str, DataFrame], ddid: int) -> list[str]:
    """The correlations of a data description, four, two or one."""
    row = tables["DATA_DESCRIPTION"].where(F.col("ddid") == ddid).join(tables["POLARIZATION"], "pol").select("corr_type").first()
    codes = list(row["corr_type"])
    unknown = [c for c in codes if c not in CORRELATIONS]
    if unknown:
        raise KeyError(f"correlation codes {unknown}")
    if len(codes) not in (1, 2, 4):
        raise ValueError("1, 2 or 4 correlations are supported")
    return [CORRELATIONS[c] for c in codes]


def with_axes(vis: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Frequency and width of each channel, the band's ends, and the field's name."""
    chans = binning.channels(tables["SPECTRAL_WINDOW"], tables["DATA_DESCRIPTION"])
    band = chans.groupBy("ddid").agg(F.min("freq").alias("min_freq"), F.max("freq").alias("max_freq"))
    names = tables["FIELD"].select("field", F.col("name").alias("field_name"))
    out = vis.drop("freq", "width").join(chans.join(band, "ddid"), ["ddid", "chan"])
    return out.join(names, "field", "left").fillna("UNKNOWN", ["field_name"])


def write_main(vis: DataFrame, path: str, mode: str = "errorifexists") -> None:
    vis.write.mode(mode).partitionBy(*KEYS).parquet(f"{path}/MAIN")


def one_set_of_names(tables: dict[str, DataFrame], vis: DataFrame) -> list[str]:
    """The correlations of all data descriptions that ``vis`` has; rows of unlike ones can't be calibrated as one table."""
    sets = {tuple(correlation_names(tables, r.ddid)) for r in vis.select("ddid").distinct().collect()}
    if len(sets) != 1:
        raise ValueError(f"correlations differ between data descriptions: {sorted(sets)}; choose some with select_ddids")
    return list(sets.pop())


def write_products(vis: DataFrame, path: str, products: dict[str, str], original: DataFrame | None = None, flags: bool = True) -> None:
    """A new version of the main table with products under the columns they are wanted in.

    Tables are replaced by versions, never in place, so a reader of the old one isn't disturbed. With
    ``original``, its other columns are kept, joined by row and channel.
    """
    on = [*KEYS, "row_id", "chan"]
    own = vis.select(*on, *[F.col(p).alias(c) for p, c in products.items()], *[c for c in ("flag", "flag_row") if flags and c in vis.columns])
    if original is not None:
        own = original.drop(*[c for c in own.columns if c not in on]).join(own, on)
    write_main(own, path)


def write_gains(gains: DataFrame, path: str, max_rows: int = 5_000_000) -> None:
    gains.write.option("maxRecordsPerFile", max_rows).partitionBy("term").parquet(path)


def read_gains(spark: SparkSession, path: str, term: str | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found if term is None else found.where(F.col("term") == term)


def backup(vis: DataFrame, column: str, path: str, label: str = "backup", rows_per_file: int = 2_000_000) -> str:
    """One column with its keys, in a folder of its own; returns the folder."""
    to = f"{path}/{label}-{column}"
    vis.select(*KEYS, "row_id", "chan", F.col(column).alias("value")).write.option("maxRecordsPerFile", rows_per_file).partitionBy(*KEYS).parquet(to)
    return to


def restore(vis: DataFrame, stored: DataFrame, column: str) -> DataFrame:
    """A backed-up column in place of ``column`` (or as a new one); rows without a backup keep theirs."""
    on = [*KEYS, "row_id", "chan"]
    out = vis.join(stored.select(*on, F.col("value").alias("_value")), on, "left")
    old = F.col(column) if column in vis.columns else F.lit(None)
    return out.withColumn(column, F.coalesce("_value", old)).drop("_value")


class _Rows(HTMLParser):
    """The text of a page's table cells and preformatted lines."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def _angle(text: str, hours: bool) -> float:
    """Radians of ``h:m:s``, ``d.m.s`` or plain degrees."""
    sign = -1 if text.strip().startswith("-") else 1
    pieces = re.fullmatch(r"\s*[-+]?(\d+)\.(\d+)\.(\d+(?:\.\d+)?)\s*", text)
    parts = [float(x) for x in (pieces.groups() if pieces else re.findall(r"[\d.]+", text.replace("°", " ").replace("'", " ")))]
    if len(parts) == 1:
        return sign * parts[0] * pi / 180
    whole = parts[0] + parts[1] / 60 + (parts[2] / 3600 if len(parts) > 2 else 0)
    return sign * whole * (15 if hours else 1) * pi / 180


def parse_sky_model(text: str, name: str, tags: Sequence[str] = ()) -> list[tuple]:
    """Rows of SOURCES from an HTML table or a text with a header line.

    A source with one of ``tags`` is in the cluster that its tag ``cluster=...`` names, or else in one of its own name; all others
    are in ``DIE``. A source without a reference frequency has that of the first source; where that has none, spectra are flat.
    """
    if "<t" in text.lower():
        reader = _Rows()
        reader.feed(text)
        lines = [r for r in reader.rows if r]
    else:
        lines = [x.lstrip("#").split() for x in text.splitlines() if x.strip()]
    if not lines:
        return []
    head = [x.lower() for x in lines[0]]
    sources = [dict(zip(head, line, strict=False)) for line in lines[1:]]
    number = lambda row, key, other=0.0: float(row[key]) if row.get(key) not in (None, "", "-") else other
    default = number(sources[0], "freq0") if sources else 0.0
    out = []
    for k, row in enumerate(sources):
        own = dict(t.lstrip("+").partition("=")[::2] for t in row.get("tags", "").replace(";", ",").split(","))
        tagged = not set(tags).isdisjoint(own)
        cluster = own.get("cluster") or row.get("name") or f"source{k}" if tagged else "DIE"
        out.append((
            name, cluster, "gauss" if number(row, "emaj") else "point", _angle(row["ra"], ":" in row["ra"]), _angle(row["dec"], False),
            number(row, "i"), number(row, "q"), number(row, "u"), number(row, "v"), number(row, "spi") if default else 0.0,
            number(row, "freq0", default) if default else 1e9, number(row, "emaj"), number(row, "emin"), number(row, "pa"),
        ))
    return out


def read_sky_models(spark: SparkSession, models: dict[str, Sequence[str]]) -> DataFrame:
    """SOURCES of sky model files with their tags. Files are read through Spark, so any of its stores serves."""
    rows = []
    for path, tags in models.items():
        text = "\n".join(r.value for r in spark.read.text(path).collect())
        rows += parse_sky_model(text, path, tags)
    return spark.createDataFrame(rows, SOURCES)


def beam_grid(spark: SparkSession, paths: dict[int, tuple[str, str]], chunk: int = 2880) -> DataFrame:
    """(corr, m, l, chan, re, im) of FITS cubes of real and imaginary parts, one pair per correlation."""
    import numpy as np

    out = None
    for corr, pair in paths.items():
        parts = []
        for path in pair:
            content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
            header, data = _fits(bytes(content), chunk)
            parts.append((header, data))
        shape = parts[0][1].shape
        at = np.indices(shape).reshape(3, -1)
        table = {"corr": np.full(at.shape[1], corr), "chan": at[0], "m": at[1], "l": at[2], "re": parts[0][1].ravel(), "im": parts[1][1].ravel()}
        import pandas as pd

        own = spark.createDataFrame(pd.DataFrame(table))
        out = own if out is None else out.unionByName(own)
    return out


def _fits(content: bytes, block: int):
    """Header and data of a FITS primary image."""
    import numpy as np

    header, at = {}, 0
    while True:
        cards = [content[at + k : at + k + 80].decode("ascii") for k in range(0, block, 80)]
        at += block
        for card in cards:
            if card[8:10] == "= ":
                header[card[:8].strip()] = card[10:].split("/")[0].strip().strip("'").strip()
        if any(c[:8].strip() == "END" for c in cards):
            break
    shape = [int(header[f"NAXIS{k}"]) for k in range(int(header["NAXIS"]), 0, -1)]
    kind = {-32: ">f4", -64: ">f8", 16: ">i2", 32: ">i4"}[int(header["BITPIX"])]
    data = np.frombuffer(content, kind, int(np.prod(shape)), at).astype(float).reshape(shape)
    return header, data


#: What tells gains of a term apart.
GAIN_AXES = (*CHUNK, "t_bin", "f_bin", "gain_time", "gain_freq", "ant", "dir")


def plot_data(gains: DataFrame, transform: str = "amplitude", corr: int = 0, axis: str = "gain_time", by: Sequence[str] = ("ant",), mean_over: Sequence[str] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """What a gain plot shows: (by, axis, value), flagged gains as null; with ``mean_over``, (by, the axes left, axis, value),
    averaged over those axes alone."""
    from ..functions.jones import Cx

    x = Cx.of(F.col("g")[corr])
    forms = {"raw": x.re, "amplitude": x.abs(), "phase": x.phase(), "real": x.re, "imag": x.im}
    value = F.when(F.col("gain_flag") != 1, forms[transform])
    rows = gains
    if low is not None:
        rows = rows.where(F.col(axis) >= low)
    if high is not None:
        rows = rows.where(F.col(axis) <= high)
    rows = rows.withColumn("value", value)
    if not mean_over:
        return rows.select(*by, axis, "value")
    kept = [c for c in GAIN_AXES if c in rows.columns and c not in (*by, axis, *mean_over)]
    return rows.groupBy(*by, *kept, axis).agg(F.avg("value").alias("value"))


def write_plots(data: DataFrame, path: str, by: Sequence[str], axis: str) -> DataFrame:
    """One SVG line plot per group, as rows (by, svg); a text table because no drawing library is at hand."""
    import pandas as pd

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.schema.fields if f.name in by)

    def draw(own: pd.DataFrame) -> pd.DataFrame:
        good = own.dropna(subset=["value"]).sort_values(axis)
        head = {k: [own[k].iloc[0]] for k in by}
        if not len(good):
            return pd.DataFrame(head | {"svg": ["<svg xmlns='http://www.w3.org/2000/svg'/>"]})
        x, y = good[axis].to_numpy(float), good["value"].to_numpy(float)
        scaled = lambda v: (v - v.min()) / ((v.max() - v.min()) or 1.0)
        points = " ".join(f"{20 + 560 * a:.1f},{280 - 260 * b:.1f}" for a, b in zip(scaled(x), scaled(y), strict=True))
        text = ", ".join(f"{k}={own[k].iloc[0]}" for k in by)
        svg = f"<svg xmlns='http://www.w3.org/2000/svg' width='600' height='300'><title>{text}</title><polyline fill='none' stroke='black' points='{points}'/></svg>"
        return pd.DataFrame(head | {"svg": [svg]})

    made = data.groupBy(*by).applyInPandas(draw, f"{kinds}, svg string")
    made.write.mode("overwrite").parquet(path)
    return made
