"""File names, formats and kinds of products."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that name a product's kind, compressions, and formats by extension.
KINDS, COMPRESSED = ("ev", "lc", "pds", "cpds", "calib"), ("gz", "bz2", "xz", "zip")
FORMATS = {"parquet": "parquet", "evt": "fits", "fits": "fits", "ds": "fits", "pha": "fits", "csv": "csv", "txt": "text", "qdp": "qdp", "json": "json"}


def extension(name: str) -> str:
    """Extension with a compression's, if any: '.evt.gz'."""
    m = re.search(rf"(\.[^./]+?(?:\.(?:{'|'.join(COMPRESSED)}))?)$", name)
    return m.group(1) if m else ""


def split_extension(name: str) -> tuple[str, str]:
    """Root and extension."""
    e = extension(name)
    return (name[: len(name) - len(e)], e) if e else (name, "")


def format_of(name: str) -> str:
    """Format by extension; an unknown one is an error."""
    e = extension(name).lstrip(".").split(".")[0]
    if e not in FORMATS:
        raise ValueError(f"unknown format of {name}")
    return FORMATS[e]


def product_root(name: str) -> str:
    """Name without extension and endings of products, however many."""
    return re.sub(rf"(_(?:{'|'.join(KINDS)}))+$", "", split_extension(name)[0])


def product_root_column(c: Column) -> Column:
    """The same as a column."""
    return F.regexp_replace(F.regexp_replace(c, rf"\.[^./]+?(\.({'|'.join(COMPRESSED)}))?$", ""), rf"(_({'|'.join(KINDS)}))+$", "")


def common_name(a: str, b: str, default: str = "common") -> str:
    """What two names of equal length share by position, without separators at the ends; else the default."""
    a, b = a.rsplit("/", 1)[-1], b.rsplit("/", 1)[-1]
    if len(a) != len(b):
        return default
    out = re.sub(r"_{2,}", "_", "".join(x for x, y in zip(a, b) if x == y)).strip("_-")
    return out or default


def kind_of_columns(names: Iterable[str]) -> str:
    """Kind of a product by its columns: powercolor, cpds, pds, folding, lc, gti or events."""
    have = set(names)
    if "hue" in have:
        return "powercolor"
    if "power" in have:
        return "cpds" if have & {"pds1", "im", "cospectrum"} else "pds"
    if "stat" in have:
        return "folding"
    if "counts" in have:
        return "lc"
    if {"start", "stop"} <= have:
        return "gti"
    if have & {"t", "time"}:
        return "events"
    raise ValueError("not a known product")
