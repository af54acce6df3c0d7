"""Reader and writer of binary tables in FITS files, as a Python data source of Spark."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

BLOCK, CARD = 2880, 80
#: Column codes of binary tables, with NumPy's big-endian types and Spark's.
CODES = {"L": ("u1", BooleanType()), "B": ("u1", ShortType()), "I": (">i2", ShortType()), "J": (">i4", IntegerType()), "K": (">i8", LongType()), "E": (">f4", FloatType()), "D": (">f8", DoubleType()), "A": ("S", StringType())}


def read_header(f) -> dict[str, object] | None:
    """Keywords of the header at the file's position; null at its end."""
    cards: dict[str, object] = {}
    while True:
        raw = f.read(BLOCK)
        if len(raw) < BLOCK:
            return None
        for i in range(0, BLOCK, CARD):
            card = raw[i : i + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards
            if card[8:10] == "= ":
                cards[key] = _value(card[10:])


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        end = text.replace("''", "\0\0").find("'", 1)
        return text[1:end].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, float):
        try:
            return kind(text.replace("D", "E"))
        except ValueError:
            pass
    return text or None


def high_precision(header: dict[str, object], key: str) -> float | None:
    """A keyword, or the sum of its parts with I and F added (a name of eight letters loses its last first)."""
    if key in header:
        return float(header[key])
    short = key[:7]
    if short + "I" in header and short + "F" in header:
        return float(header[short + "I"]) + float(header[short + "F"])
    return None


def tables(path: str) -> Iterator[tuple[dict[str, object], int]]:
    """Headers of a file's binary tables and where their rows begin."""
    with open(path, "rb") as f:
        while (h := read_header(f)) is not None:
            at = f.tell()
            size = abs(int(h.get("BITPIX", 8))) // 8
            n = 1 if int(h.get("NAXIS", 0)) else 0
            for i in range(1, int(h.get("NAXIS", 0)) + 1):
                n *= int(h[f"NAXIS{i}"])
            size = size * (n + int(h.get("PCOUNT", 0)))
            if h.get("XTENSION") == "BINTABLE":
                yield h, at
            f.seek(at + -(-size // BLOCK) * BLOCK)


def layout(header: dict[str, object]) -> tuple[np.dtype, StructType]:
    """NumPy and Spark types of a table's scalar columns; other columns are skipped over."""
    names, formats, fields = [], [], []
    for i in range(1, int(header["TFIELDS"]) + 1):
        form = str(header[f"TFORM{i}"])
        digits = "".join(c for c in form if c.isdigit())
        code, repeat = form[len(digits) : len(digits) + 1], int(digits or 1)
        name = str(header.get(f"TTYPE{i}", f"COL{i}")).lower()
        if code == "A":
            formats.append(f"S{repeat}")
            fields.append(StructField(name, StringType()))
        elif code in CODES and repeat == 1:
            formats.append(CODES[code][0])
            fields.append(StructField(name, CODES[code][1]))
        else:
            width = {"X": -(-repeat // 8), "P": 8 * repeat, "Q": 16 * repeat}.get(code) or np.dtype(CODES[code][0]).itemsize * repeat
            formats.append(f"V{width}")
        names.append(name)
    return np.dtype({"names": names, "formats": formats}), StructType(fields)


class _Rows(InputPartition):
    def __init__(self, path: str, at: int, first: int, n: int):
        self.path, self.at, self.first, self.n = path, at, first, n


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], extension: str, rows_each: int):
        self.paths, self.extension, self.rows_each = paths, extension, rows_each

    def partitions(self):
        out = []
        for path in self.paths:
            for h, at in tables(path):
                if str(h.get("EXTNAME", "")).upper() == self.extension:
                    n = int(h["NAXIS2"])
                    out += [_Rows(path, at, i, min(self.rows_each, n - i)) for i in range(0, n, self.rows_each)]
        return out

    def read(self, partition):
        h = next(h for h, at in tables(partition.path) if at == partition.at)
        kind, schema = layout(h)
        with open(partition.path, "rb") as f:
            f.seek(partition.at + partition.first * int(h["NAXIS1"]))
            rows = np.frombuffer(f.read(partition.n * int(h["NAXIS1"])), kind)
        arrays = []
        for field in schema:
            x = rows[field.name]
            if field.dataType == StringType():
                arrays.append(pa.array([v.decode("ascii", "replace").rstrip() for v in x]))
            elif field.dataType == BooleanType():
                arrays.append(pa.array([{84: True, 70: False}.get(int(v)) for v in x], pa.bool_()))
            else:
                arrays.append(pa.array(x.astype(x.dtype.newbyteorder("=")).astype("i2" if field.dataType == ShortType() else x.dtype.newbyteorder("="))))
        yield pa.RecordBatch.from_arrays(arrays, schema.names)


class FitsTable(DataSource):
    """``spark.read.format("fits_table").option("extension", "EVENTS").load(path)``: rows in ranges of rows_each."""

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def _paths(self) -> list[str]:
        p = Path(self.options["path"])
        return sorted(str(x) for x in p.iterdir() if x.is_file()) if p.is_dir() else [str(p)]

    def schema(self):
        want = self.options.get("extension", "EVENTS").upper()
        for path in self._paths():
            for h, _ in tables(path):
                if str(h.get("EXTNAME", "")).upper() == want:
                    return layout(h)[1]
        raise ValueError(f"no table {want}")

    def reader(self, schema):
        return _Reader(self._paths(), self.options.get("extension", "EVENTS").upper(), int(self.options.get("rows_each", 1_000_000)))


def write_table(path: str, extension: str, columns: dict[str, np.ndarray], keywords: dict[str, object] | None = None, append: bool = False) -> None:
    """Write NumPy columns as a binary table, for small files and tests."""
    back = {"i2": "I", "i4": "J", "i8": "K", "f4": "E", "f8": "D"}
    kinds = {k: np.asarray(v).dtype.newbyteorder(">") for k, v in columns.items()}
    rows = np.zeros(len(next(iter(columns.values()))), np.dtype([(k, t) for k, t in kinds.items()]))
    for k, v in columns.items():
        rows[k] = v

    def card(k, v):
        text = f"'{v}'" if isinstance(v, str) else ("T" if v else "F") if isinstance(v, bool) else repr(v)
        return f"{k:<8}= {text:>20}".ljust(CARD).encode()

    def block(cards):
        raw = b"".join(cards) + b"END".ljust(CARD)
        return raw + b" " * (-len(raw) % BLOCK)

    head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": rows.dtype.itemsize, "NAXIS2": len(rows), "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(columns), "EXTNAME": extension}
    for i, (k, t) in enumerate(kinds.items(), 1):
        head |= {f"TTYPE{i}": k.upper(), f"TFORM{i}": back[t.str[1:]]}
    raw = rows.tobytes()
    with open(path, "ab" if append else "wb") as f:
        if not append:
            f.write(block([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0)]))
        f.write(block([card(k, v) for k, v in {**head, **(keywords or {})}.items()]) + raw + b"\0" * (-len(raw) % BLOCK))
