"""Delimited, fixed-width, JSON-lines and GeoJSON files, and data embedded in pages, as typed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_positional(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "|") -> DataFrame:
    """Headerless lines by position, all text: a last empty field is dropped, missing and blank fields are null."""
    parts = F.split("value", f"\\Q{sep}\\E", -1)
    field = lambda i: F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit(""))
    return spark.read.text(path).where(F.trim("value") != "").select(*(field(i).alias(c) for i, c in enumerate(columns)))


@dataclass(frozen=True)
class Field:
    """Characters ``start`` to ``end``, end exclusive, as a type."""

    name: str
    start: int
    end: int
    type: str = "string"


def read_fixed_width(spark: SparkSession, path: str, fields: Sequence[Field], length: int) -> DataFrame:
    """Records of just ``length`` characters; others are dropped. Values that are not of the type are null."""
    cut = lambda f: F.nullif(F.trim(F.substring("value", f.start + 1, f.end - f.start)), F.lit("")).try_cast(f.type).alias(f.name)
    return spark.read.text(path).where(F.length("value") == length).select(*map(cut, fields))


def delimiter_of(header: str) -> str:
    """The more frequent of ``;`` and ``,``; ``;`` if equal."""
    return "," if header.count(",") > header.count(";") else ";"


def read_upload(spark: SparkSession, path: str, names: Mapping[str, str], key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of a CSV file with a header: known columns under their canonical names, rows without a key apart.

    Only the header's line reaches the driver. Unknown columns are ignored
    and not read; quotes may hold the delimiter and doubled quotes.
    """
    head = spark.read.text(path).first()
    if head is None:
        raise ValueError("the file has no header")
    sep = delimiter_of(head[0])
    raw = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=False)
    known = {c: names[c.strip().lower()] for c in raw.columns if c.strip().lower() in names}
    if key not in known.values():
        raise ValueError(f"no column stands for {key}")
    rows = raw.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(n) for c, n in known.items()))
    return rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())


def read_features(spark: SparkSession, path: str, attributes: str, lines: bool = False) -> DataFrame:
    """(attributes, ring) of the polygons of GeoJSON collections: the outer ring as (lat, lon) corners.

    ``attributes`` is the schema of the properties; polygons of several parts give a row each.
    Files hold one collection or several, one after another; ``lines`` says that each
    is a line of its own, so that a file can be read in pieces.
    """
    return _rings(_features(spark, path, attributes, lines))


def read_shapes(spark: SparkSession, path: str, attributes: str, lines: bool = False) -> DataFrame:
    """(attributes, parts) of the polygons of GeoJSON collections, one row a feature: each part as all its rings of (lat, lon) corners, the outer one first, then holes.

    Files are those of ``read_features``.
    """
    return _parts(_features(spark, path, attributes, lines)).select("f.properties.*", "parts")


def _features(spark: SparkSession, path: str, attributes: str, lines: bool) -> DataFrame:
    if lines:
        return spark.read.schema(_collection(attributes)).json(path).select(F.explode("features").alias("f"))
    # A JSON reader of whole files stops after the first collection. No string holds a line break,
    # so a bracket that opens in a new line after one that closes, with no comma, begins the next collection.
    each = F.explode(F.split(F.regexp_replace("value", "^\ufeff", ""), r"(?<=\})\s*\n\s*(?=\{)")).alias("j")
    return spark.read.text(path, wholetext=True).select(each).select(F.explode(F.from_json("j", _collection(attributes))["features"]).alias("f"))


def features_in(df: DataFrame, text: Column, attributes: str) -> DataFrame:
    """``df`` with the polygons of the GeoJSON collection in each row's text, as ``read_features`` gives them; rows without any go."""
    return _rings(df.select("*", F.explode(F.from_json(text, _collection(attributes))["features"]).alias("f")))


def _collection(attributes: str) -> str:
    return f"features array<struct<properties:struct<{attributes}>,geometry:struct<type:string,coordinates:string>>>"


def _parts(rows: DataFrame) -> DataFrame:
    """``rows`` with the polygons of the feature ``f`` in ``parts``; without those that have none."""
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    one = F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    kind = F.col("f.geometry.type")
    corner = lambda c: F.struct(F.get(c, F.lit(1)).alias("lat"), F.get(c, F.lit(0)).alias("lon"))
    shape = F.when(kind == "MultiPolygon", many).when(kind == "Polygon", one)
    return rows.withColumn("parts", F.transform(shape, lambda p: F.transform(p, lambda r: F.transform(r, corner)))).where("parts is not null")


def geojson_shape(parts: Column) -> Column:
    """Polygons with holes as the (type, coordinates) of a GeoJSON geometry; rings have to end where they begin."""
    return F.struct(F.lit("MultiPolygon").alias("type"), F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.array(c["lon"], c["lat"])))).alias("coordinates"))


def _rings(rows: DataFrame) -> DataFrame:
    f = rows.select(*(c for c in rows.columns if c != "f"), "f.properties.*", F.col("f.geometry.type").alias("_type"), F.col("f.geometry.coordinates").alias("_c"))
    many = F.from_json("_c", "array<array<array<array<double>>>>")
    one = F.array(F.from_json("_c", "array<array<array<double>>>"))
    parts = f.withColumn("_part", F.explode(F.when(F.col("_type") == "MultiPolygon", many).when(F.col("_type") == "Polygon", one)))
    ring = F.transform(F.get("_part", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon")))
    return parts.withColumn("ring", ring).drop("_type", "_c", "_part")


def as_features(df: DataFrame, lat: str, lon: str, most: int) -> DataFrame:
    """One row (collection, truncated): a GeoJSON collection of at most ``most`` points, in the order of the rest of the row."""
    rest = [c for c in df.columns if c not in (lat, lon)]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    one = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties"))
    some = df.orderBy(*rest).limit(most + 1).select(one.alias("f")).agg(F.collect_list("f").alias("f"))
    return some.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.slice("f", 1, most).alias("features"))).alias("collection"), (F.size("f") > most).alias("truncated"))


def embedded_json(html: Column, marker: str) -> Column:
    """The JSON object after ``marker`` in a page, by counting braces outside strings; null if none ends.

    Strings are blanked to equal length first, so only structural braces are counted.
    """
    # Each step's value is bound once: the page would be searched again for every place that the next steps name it.
    def cut(after: Column) -> Column:
        start = F.instr(after, "{")
        return F.when(start > 0, F.substring(after, start, F.length(after)))

    def closed(body: Column) -> Column:
        # Each string becomes as many blanks: a string's pieces are replaced one character at a time.
        plain = F.regexp_replace(body, r'(?s)\\.', "__")
        parts = F.transform(F.split(plain, '"', -1), lambda x, i: F.when(i % 2 == 1, F.repeat(F.lit("_"), F.length(x))).otherwise(x))
        # Pieces that end in a brace: as many steps as braces, not as characters.
        pieces = F.split(F.array_join(parts, "_"), r"(?<=[{}])", -1)
        zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

        def step(a: Column, x: Column) -> Column:
            at, depth = a["at"] + F.length(x), a["depth"] + F.when(F.endswith(x, F.lit("{")), 1).when(F.endswith(x, F.lit("}")), -1).otherwise(0)
            return F.struct(depth.alias("depth"), at.alias("at"), F.when((a["end"] == 0) & F.endswith(x, F.lit("}")) & (depth == 0), at).otherwise(a["end"]).alias("end"))

        return bound(F.aggregate(pieces, zero, step, lambda a: a["end"]), lambda end: F.when(end > 0, F.substring(body, F.lit(1), end)))

    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    found = bound(html, lambda h: F.when(F.instr(h, marker) > 0, F.substring_index(h, marker, -1)))
    return bound(bound(found, cut), closed)
