"""Project configuration: a YAML file of sections, with paths relative to the project's root, and its tables."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from terrachron.sources.tables import read_json, write_json


@dataclass(frozen=True)
class ProjectConfig:
    data: dict[str, Any]
    root: Path

    def section(self, name: str) -> dict[str, Any]:
        return dict(self.data.get(name) or {})

    def resolve(self, path: str) -> str:
        return path if "://" in path or Path(path).is_absolute() else str(self.root / path)

    @property
    def outputs(self) -> str:
        return self.resolve(str(self.data.get("outputs", "outputs")))

    def write(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Store a table among the outputs and read it back."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.outputs}/{name}")
        return self.read(df.sparkSession, name)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.outputs}/{name}")

    def note(self, name: str, value: dict[str, Any]) -> dict[str, Any]:
        write_json(value, f"{self.outputs}/{name}.json")
        return value

    def noted(self, name: str) -> dict[str, Any]:
        return read_json(f"{self.outputs}/{name}.json")


def load_config(path: str | Path) -> ProjectConfig:
    file = Path(path).resolve()
    data = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
    if not isinstance(data, dict):
        raise ValueError("a configuration is a mapping of sections")
    root = Path(str((data.get("project") or {}).get("root", ".")))
    return ProjectConfig(data, root if root.is_absolute() else (file.parent / root).resolve())
