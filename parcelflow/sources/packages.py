"""Parcels that come as GeoParquet or packed in zip archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Unpacked files, and bytes of them, that a task holds before they go on.
MOST_HELD, MOST_BYTES_HELD = 1000, 4 << 20
ENTRY = "path string, name string, content binary, error string"


def read_geo_parquet(spark: SparkSession, path: str, attributes: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """(attributes, geometry, geometry_hex): the shapes as well-known binary and as its lower-case hex digits.

    Only the named columns are read; one that the files lack is null, and so
    is a number that is NaN. Coordinates have to be degrees, longitude first:
    nothing is projected. A row without a shape stays, with null.
    """
    raw = spark.read.parquet(path)
    types = {f.name: f.dataType for f in raw.schema}

    def known(c: str) -> Column:
        if c not in types:
            return F.lit(None).cast("string").alias(c)
        col = F.col(f"`{c}`")
        return (F.when(~F.isnan(col), col) if isinstance(types[c], DoubleType | FloatType) else col).alias(c)

    shape = F.col(f"`{geometry}`")
    return raw.select(*map(known, attributes), shape.alias("geometry"), F.lower(F.hex(shape)).alias("geometry_hex"))


def _parts(b: bytes, at: int = 0) -> tuple[list[list[np.ndarray]], int]:
    """The polygons in well-known binary from ``at``, each as its rings (the outer one first), x and y in turn, and where they end."""
    order = "<" if b[at] else ">"
    number = lambda i: int(np.frombuffer(b, f"{order}u4", 1, i)[0])
    kind, at = number(at + 1), at + 5
    # Height and measure are said by thousands or by the highest bits; then a reference system may follow.
    base, at = kind & 0x0FFFFFFF, at + (4 if kind & 0x20000000 else 0)
    wide = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + (0, 1, 1, 2)[base // 1000]
    n, at, rings = number(at), at + 4, []
    if base % 1000 == 6:
        for _ in range(n):
            more, at = _parts(b, at)
            rings += more
    elif base % 1000 == 3:
        own = []
        for _ in range(n):
            k = number(at)
            corners = np.frombuffer(b, f"{order}f8", k * wide, at + 4).reshape(k, wide)
            own.append(corners[:, :2].astype("f8").ravel())
            at += 4 + 8 * k * wide
        rings += [own] if own else []
    return rings, at


def _readable(b: bytes | None) -> list[list[np.ndarray]] | None:
    try:
        return None if b is None else _parts(bytes(b))[0]
    except (ValueError, IndexError):
        return None


def wkb_rings(shape: Column) -> Column:
    """The outer rings of polygons and multipolygons in well-known binary, each as (lat, lon) corners; see ``wkb_parts``."""
    return F.transform(wkb_parts(shape), lambda p: F.get(p, F.lit(0)))


def wkb_parts(shape: Column) -> Column:
    """The polygons in well-known binary, each as all its rings of (lat, lon) corners: the outer one, then its holes.

    Other shapes have none; null or broken bytes give null.
    """

    @F.arrow_udf("array<array<array<double>>>")
    def flat(shapes: pa.Array) -> pa.Array:
        read = map(_readable, shapes.to_pylist())
        return pa.array(([[r.tolist() for r in p] for p in s] if s is not None else None for s in read), pa.list_(pa.list_(pa.list_(pa.float64()))))

    corner = lambda r: lambda i: F.struct(F.get(r, 2 * i + 1).alias("lat"), F.get(r, 2 * i).alias("lon"))
    corners = lambda r: F.transform(F.sequence(F.lit(0), (F.size(r) / 2).cast("int") - 1), corner(r))
    ring = lambda r: F.when(F.size(r) > 0, corners(r)).otherwise(F.array().cast("array<struct<lat:double,lon:double>>"))
    return F.transform(flat(shape), lambda p: F.transform(p, ring))


def wkb_polygon(ring: Column) -> Column:
    """A polygon of one ring of (lat, lon) corners as well-known binary; null for null."""

    @F.pandas_udf("binary")
    def packed(rings: pd.Series) -> pd.Series:
        head = lambda r: b"\1" + np.array([3, 1, len(r) // 2], "<u4").tobytes()
        return rings.map(lambda r: None if r is None else head(r) + np.asarray(r, "<f8").tobytes())

    return packed(F.flatten(F.transform(ring, lambda c: F.array(c["lon"], c["lat"]))))


def wkb_multipolygon(parts: Column) -> Column:
    """Polygons, each of an outer ring and its holes of (lat, lon) corners, as a multipolygon in well-known binary; null for null.

    Rings are closed by their first corner where they don't say it again.
    """

    @F.arrow_udf("binary")
    def packed(shapes: pa.Array) -> pa.Array:
        def number(*n: int) -> bytes:
            return np.array(n, "<u4").tobytes()

        def ring(r: list[float]) -> bytes:
            corners = np.asarray(r, "<f8").reshape(-1, 2)
            if len(corners) and (corners[0] != corners[-1]).any():
                corners = np.vstack([corners, corners[:1]])
            return number(len(corners)) + corners.tobytes()

        def polygon(p: list) -> bytes:
            return b"\1" + number(3, len(p)) + b"".join(map(ring, p))

        return pa.array((None if s is None else b"\1" + number(6, len(s)) + b"".join(map(polygon, s)) for s in shapes.to_pylist()), pa.binary())

    return packed(F.transform(parts, lambda p: F.transform(p, lambda r: F.flatten(F.transform(r, lambda c: F.array(c["lon"], c["lat"]))))))


def unzipped(archives: DataFrame) -> DataFrame:
    """(path, name, content, error) of each file in archives (path, content).

    Folders are left out of names, and of two files of one name in an archive
    the later one stays. What is no archive, or an entry that cannot be
    unpacked, gives a row with its error and no content; null gives no row.
    An archive is in one task. Its files are read one at a time and go on
    together: many small ones, or ``MOST_BYTES_HELD`` and the one that exceeds it.
    """

    def entries(path: str, content: bytes) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            yield path, None, None, str(e)
            return
        last = {i.filename.rsplit("/", 1)[-1]: i for i in archive.infolist() if not i.is_dir()}
        for name, info in last.items():
            try:
                yield path, name, archive.read(info), None
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
                yield path, name, None, str(e)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["path", "name", "content", "error"], dtype=object)
        held, size = [], 0
        for row in (e for b in batches for r in b.itertuples() if r.content is not None for e in entries(r.path, r.content)):
            held.append(row)
            size += len(row[2] or b"")
            if len(held) >= MOST_HELD or size >= MOST_BYTES_HELD:
                yield frame(held)
                held, size = [], 0
        if held:
            yield frame(held)

    return archives.select("path", "content").mapInPandas(unpack, ENTRY)


def read_zipped(spark: SparkSession, path: str) -> DataFrame:
    """The files in the zip archives at ``path``, as ``unzipped`` gives them; an archive has to be smaller than 2 GB."""
    return unzipped(spark.read.format("binaryFile").load(path))


def zipped(names: Column, texts: Column) -> Column:
    """An archive of the texts of an array under the names of another; null for null."""

    @F.pandas_udf("binary")
    def pack(names: pd.Series, texts: pd.Series) -> pd.Series:
        def one(n, t):
            if n is None or t is None:
                return None
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for name, text in zip(n, t, strict=True):
                    archive.writestr(name, text)
            return out.getvalue()

        return pd.Series([one(n, t) for n, t in zip(names, texts, strict=True)], dtype=object)

    return pack(names, texts)
