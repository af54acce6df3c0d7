"""Text and binary sinks: QDP, plain columns, spectra for fitting, raw counts with their header."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xspec_rows(spectrum: DataFrame, df: float) -> DataFrame:
    """A spectrum as bins for fitting: f_lo, f_hi, flux, flux_err (power and error times the width)."""
    w = F.lit(float(df))
    return spectrum.select((F.col("freq") - w / 2).alias("f_lo"), (F.col("freq") + w / 2).alias("f_hi"), (F.col("power") * w).alias("flux"), (F.col("power_err") * w).alias("flux_err"))


def text_lines(df: DataFrame, columns: Sequence[str], sep: str = " ") -> Column:
    """Columns of a row as one line."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NO")) for c in columns])


def write_ascii(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], header: bool = True) -> None:
    """Columns as text files in a folder, in order within and across the files; a header stands in a file of its own."""
    df.orderBy(*order).select(text_lines(df, columns).alias("value")).write.mode("overwrite").text(path)
    if header:
        Path(path, "_header").write_text("# " + " ".join(columns) + "\n")


def qdp_header(errors: dict[int, int]) -> list[str]:
    """READ lines of a QDP file: {column: 1 for symmetric, 2 for two-sided errors}."""
    kinds = {1: "READ SERR", 2: "READ TERR"}
    return [f"{kinds[k]} " + " ".join(str(c) for c, n in sorted(errors.items()) if n == k) for k in (1, 2) if k in errors.values()]


def write_qdp(df: DataFrame, path: str, columns: Sequence[tuple[str, str | tuple[str, str] | None]], order: Sequence[str]) -> None:
    """QDP text: READ lines, then rows of each column followed by its errors. Rows are streamed through the driver in order."""
    errors = {i + 1: 1 if isinstance(e, str) else 2 for i, (_, e) in enumerate(columns) if e}
    names = [n for c, e in columns for n in (c, *((e,) if isinstance(e, str) else e or ()))]
    with open(path, "w") as out:
        out.writelines(line + "\n" for line in qdp_header(errors))
        for row in df.orderBy(*order).select(*names).toLocalIterator():
            out.write(" ".join("NO" if v is None else repr(v) if isinstance(v, float) else str(v) for v in row) + "\n")


def write_binary(bins: DataFrame, path: str, n_bins: int, block: int = 10**8) -> int:
    """Counts (bin, counts) as raw float32 in blocks of bins, the last padded to a multiple of 4; returns the bins written."""
    total = n_bins + (-n_bins) % 4
    with open(path, "wb") as out:
        for lo in range(0, total, block):
            x = np.zeros(min(block, total - lo), np.float32)
            for r in bins.where((F.col("bin") >= lo) & (F.col("bin") < lo + len(x))).select("bin", "counts").toLocalIterator():
                x[r[0] - lo] = r[1]
            x.tofile(out)
    return total


def write_inf(path: str, info: dict[str, object]) -> None:
    """Text header beside raw counts: one line for each entry."""
    Path(path).write_text("".join(f" {k:<38} =  {v}\n" for k, v in info.items()))


def columns_from_ascii(spark, path: str, schema: str) -> DataFrame:
    """Columns of numbers separated by blanks; lines that begin with # are left out."""
    return spark.read.option("sep", " ").option("comment", "#").schema(schema).csv(path)
