"""Tables: CSV with a mark at its beginning, JSON, polygons, configurations; and their writers."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from terrachron.functions.nulls import clean
from terrachron.sources.sheets import read_sheet


def read_table(spark: SparkSession, path: str, *, encoding: str = "UTF-8", sep: str | None = None, sheet: int | str | None = None) -> DataFrame:
    """A CSV or TXT table or a sheet of a workbook (the first one, if not named) as texts, by its suffix; a byte-order mark is taken off the first name. Parquet and ORC keep their types."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc"):
        return clean(getattr(spark.read, kind)(path))
    if kind == "xlsx":
        return read_sheet(spark, path, 0 if sheet is None else sheet)
    if kind == "xls":
        raise ValueError(f"{path} is a workbook of the older binary kind: save it as xlsx or CSV")
    if kind not in ("csv", "txt"):
        raise ValueError(f"no reader for {path}")
    df = spark.read.csv(path, header=True, inferSchema=False, encoding=encoding, sep=sep or ",")
    return df.toDF(*(n.removeprefix("﻿") for n in df.columns))


def read_polygons(spark: SparkSession, path: str) -> list[list[tuple[float, float]]]:
    """The rings of all polygons of a GeoJSON file (a domain's outline: a driver-side list)."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    rings: list[list[tuple[float, float]]] = []

    def walk(node: dict) -> None:
        for child in node.get("features", []) + node.get("geometries", []):
            walk(child)
        if "geometry" in node and node["geometry"]:
            walk(node["geometry"])
        if node.get("type") == "Polygon":
            rings.extend([(float(p[0]), float(p[1])) for p in ring] for ring in node["coordinates"])
        if node.get("type") == "MultiPolygon":
            rings.extend([(float(p[0]), float(p[1])) for p in ring] for polygon in node["coordinates"] for ring in polygon)

    walk(json.loads(text))
    return rings


def read_scalar(spark: SparkSession, path: str, name: str) -> object:
    """One field of a JSON summary."""
    row = spark.read.json(path, multiLine=True).first()
    if row is None or name not in row.asDict():
        raise KeyError(name)
    return row[name]


def write_table(df: DataFrame, path: str, *, by: list[str] | None = None, compression: str = "zstd") -> None:
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one file with names."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(value: dict, path: str, spark: SparkSession | None = None) -> None:
    """A summary as a JSON file, on the file system that the path names."""
    text = json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n"
    if "://" not in path and not path.startswith("file:"):
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")
        return
    spark = spark or SparkSession.active()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_json(path: str, spark: SparkSession | None = None) -> dict:
    """A summary that ``write_json`` wrote."""
    if "://" not in path and not path.startswith("file:"):
        return json.loads(Path(path).read_text(encoding="utf-8"))
    spark = spark or SparkSession.active()
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
