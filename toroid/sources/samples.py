"""Where samples come from: CSV or Parquet files, or a synthetic table that any cluster makes alike."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toroid import config as C
from toroid.functions import physics as P
from toroid.functions.numbers import MISSING, is_number, to_number
from toroid.operators.normalise import case_sensitive, column_mapping, renamed


def _headers(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(files, column names) for each different header line of the CSV files under a path."""
    files = spark.read.text(path).inputFiles()
    if len(files) <= 1:
        return [(files or [path], _csv_names(spark, files or path))]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    first = lines.where("start = 0 and trim(value) <> ''").groupBy("file").agg(F.min_by("value", "at").alias("line"))
    groups = first.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    found = [(r["files"], _csv_names(spark, r["files"][0])) for r in sorted(groups, key=lambda r: r["files"])]
    for own, names in found:
        if sorted(names) != sorted(found[0][1]):
            raise ValueError(f"{own[0]} has the columns {names}, but {found[0][0][0]} has {found[0][1]}.")
    return found


def _csv_names(spark: SparkSession, files: list[str] | str) -> list[str]:
    with case_sensitive(spark):
        return spark.read.csv(files, header=True, inferSchema=False).columns


def _csv_rows(spark: SparkSession, files: list[str], names: list[str], out: list[str]) -> DataFrame:
    """Rows of files with one header, by position, in the order of `out` (columns c0, c1, ...); missing-value tokens are null.

    A row with fewer fields than the header ends in nulls; one with more is an error as soon as it is read
    (but for a bare comma at the end, which loses nothing).
    """
    own = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} string" for c in [*own, "surplus"])
    df = spark.read.csv(files, header=True, enforceSchema=True, schema=schema, nullValue="\0")  # so that a quoted empty surplus field is one, too
    said = F.concat(F.lit(f"a row has more fields than the {len(names)} columns of its header: "), F.concat_ws(",", *own, "surplus"))
    checked = F.when(F.col("surplus").isNotNull(), F.raise_error(said))
    return df.select(*[checked.when(~F.col(own[names.index(c)]).isin(*MISSING), F.col(own[names.index(c)])).alias(f"c{i}") for i, c in enumerate(out)])


def surplus_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, fields): the rows of CSV files that have more fields than their header, for a report instead of an error."""
    out = spark.createDataFrame([], "file string, fields array<string>")
    for files, names in _headers(spark, path):
        own = [f"c{i}" for i in range(len(names))]
        df = spark.read.csv(files, header=True, enforceSchema=True, schema=", ".join(f"{c} string" for c in [*own, "surplus"]), nullValue="\0")
        out = out.unionByName(df.where("surplus is not null").select(F.col("_metadata.file_path").alias("file"), F.array(*own, "surplus").alias("fields")))
    return out


def _read(spark: SparkSession, path: str, kind: str | None) -> tuple[DataFrame, list[str]]:
    """Rows of a path and the names of its columns, which the rows of CSV files carry only by position."""
    kind = kind or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if kind == "parquet":
        with case_sensitive(spark):
            names = spark.read.parquet(path).columns
        return spark.read.parquet(path), names
    found = _headers(spark, path)
    names = found[0][1]
    rows = [_csv_rows(spark, files, own, names) for files, own in found]
    out = rows[0]
    for other in rows[1:]:
        out = out.unionByName(other)
    return out, names


def read_raw(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A file's rows as they are, for the audit: raw names (one that differs from another only in case gets an ending), and
    columns of a CSV file as doubles where every value is a number (one pass)."""
    rows, names = _read(spark, path, kind)
    df = rows.toDF(*renamed(names, {}))
    text = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    if not text:
        return df
    found = df.agg(*[F.struct(F.bool_and(is_number(F.col(f"`{c}`"))).alias("all"), F.count(F.col(f"`{c}`")).alias("n")).alias(f"t{i}") for i, c in enumerate(text)]).first()
    numbers = {c for i, c in enumerate(text) if found[i]["n"] and found[i]["all"]}
    return df.select(*[to_number(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) if c in numbers else F.col(f"`{c}`") for c in df.columns])


def read_samples(spark: SparkSession, path: str, kind: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """A file's rows under canonical column names, and the mapping used. kind: csv or parquet (by the path's end if None).

    CSV columns are text with missing-value tokens as null; numbers are made of them by coercion, not by inference. The header of every
    file of a folder is read: columns may stand in another order, but must be the same. CSV names that
    differ only in case are told apart; a Parquet file with such names can be read only in a session with
    spark.sql.caseSensitive set.
    """
    rows, names = _read(spark, path, kind)
    mapping = column_mapping(names)
    return rows.toDF(*renamed(names, mapping)), mapping


def resolve_source(path: str | None, allow_synthetic: bool) -> tuple[str | None, str]:
    """(path, kind): a path was given, or synthetic data were allowed; neither is an error that names both ways."""
    if path is not None:
        return path, "provided_path"
    if allow_synthetic:
        return None, "synthetic_generated"
    raise ValueError("Nothing to train on: name a table (dataset_path, --dataset-path), or ask for made-up samples (allow_synthetic, --allow-synthetic).")


def uniform(row: Column, name: str, low: float, high: float, seed: int = C.SEED) -> Column:
    """A number in [low, high) for each row and name; the same on any cluster, unlike rand()."""
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), row.cast("string"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return F.lit(low) + unit * F.lit(high - low)


def normal(row: Column, name: str, seed: int = C.SEED) -> Column:
    """A standard normal number (Box-Muller)."""
    u, v = uniform(row, f"{name}/1", 0.0, 1.0, seed), uniform(row, f"{name}/2", 0.0, 1.0, seed)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


# Ranges of the synthetic columns (logarithms to base 10 where so named).
RANGES = {
    "log10_density": (19.3, 20.5), "temperature_keV": (4.0, 28.0), "confinement_time_s": (0.15, 5.5), "fuel_purity": (0.72, 0.995), "energy_input_MJ": (12.0, 220.0), "log10_pressure": (4.8, 6.6),
    "Ip_MA": (4.5, 18.0), "Bt_T": (2.2, 7.2), "R_m": (1.8, 6.5), "aspect": (0.24, 0.38), "kappa": (1.45, 2.2), "Pin_MW": (6.0, 130.0), "M_amu": (2.35, 2.65),
}


def synthetic_shots(spark: SparkSession, n_rows: int, seed: int = C.SEED) -> DataFrame:
    """n_rows samples, six to a shot, made row by row from hashes, so the table is the same however it is partitioned."""
    if n_rows <= 0:
        raise ValueError(f"cannot make {n_rows} rows: n_rows has to be above zero")
    row = F.col("id")
    draw = {name: uniform(row, name, *limits, seed) for name, limits in RANGES.items()}
    df = spark.range(n_rows).withColumns({
        C.SHOT: F.floor(row / C.ROWS_PER_SYNTHETIC_SHOT), "fuel_density_m3": F.pow(F.lit(10.0), draw["log10_density"]), "pressure_Pa": F.pow(F.lit(10.0), draw["log10_pressure"]),
        **{c: draw[c] for c in ("temperature_keV", "confinement_time_s", "fuel_purity", "energy_input_MJ", "Ip_MA", "Bt_T", "R_m", "kappa", "Pin_MW", "M_amu")}, "_aspect": draw["aspect"],
    })
    df = df.withColumns({"a_m": F.col("R_m") * F.col("_aspect"), "ne_20": F.col("fuel_density_m3") / F.lit(1e20)})
    df = df.withColumn("tau_E_ipb98_s", P.ipb98_confinement(*(F.col(c) for c in ("Ip_MA", "Bt_T", "R_m", "a_m", "kappa", "ne_20", "M_amu", "Pin_MW"))))
    lawson = P.lawson_ratio(P.triple_product(F.col("fuel_density_m3"), F.col("temperature_keV"), F.col("confinement_time_s")))
    # The generating law of the yield and of the power output.
    signal = (
        F.lit(12.5) + 1.6 * F.log1p(lawson * 10.0) + 0.35 * F.log1p("energy_input_MJ") + 0.25 * F.log1p(F.col("pressure_Pa") / 1e5) + 0.40 * F.log1p(F.col("tau_E_ipb98_s") * 10.0)
        + 2.5 * (F.col("fuel_purity") - 0.75) + 0.55 * normal(row, "yield", seed)
    )
    df = df.withColumn(C.TARGET, F.expm1(F.greatest(signal, F.lit(4.0))))
    df = df.withColumn("power_output_MW", F.greatest(F.lit(0.05), F.col(C.TARGET) * 2.5e-7 + 0.2 * normal(row, "power", seed)))
    return df.select(C.SHOT, *C.BASE_FEATURES, "tau_E_ipb98_s", "power_output_MW", C.TARGET)
