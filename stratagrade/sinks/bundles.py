"""Bundles of any size: folders of JSON lines that tasks write, published by one rename.

A bundle is a folder with a manifest, which names where each part's lines are.  A new
version is written beside the old one; only when all of it is there, the manifest is
replaced, in one rename.  Readers follow the manifest, so they see the old version or the new one,
whole, and a run that fails leaves the old one as it was.  The version before stays until
the next is published, for readers that have begun with it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import messages as say
from ..sources.places import Place

MANIFEST = "manifest.json"


class BundleFolder:
    """A version in the making; used in a with statement.

    An error inside, a kill of the process too, leaves the published version as it was.
    """

    def __init__(self, folder, overwrite: bool = False):
        self.folder = Place(folder)
        if (self.folder / MANIFEST).exists() and not overwrite:
            raise FileExistsError(say.OUTPUT_EXISTS.format(paths=self.folder / MANIFEST))
        self.version = f"version-{uuid.uuid4().hex}"
        self.stage = self.folder / self.version
        self.parts: dict[str, dict] = {}

    def write(self, name: str, rows: DataFrame) -> int:
        """One part; returns how many rows it has, as the write itself counts them."""
        return self._write(rows, {name: F.lit(True)}, name)[name]

    def write_by(self, column: str, rows: DataFrame, names: tuple[str, ...]) -> dict[str, int]:
        """A part for each of the `names` in a column, all in one pass; rows with other values
        are refused when the bundle is closed."""
        return self._write(rows, {n: F.col(column) == n for n in names}, f"by-{column}", column)

    def _write(self, rows: DataFrame, wanted: dict, at: str, column: str | None = None) -> dict[str, int]:
        seen = Observation()
        counts = [F.count_if(w).alias(n) for n, w in wanted.items()]
        watched = rows.observe(seen, F.count("*").alias("__all"), *counts)
        writer = watched.write.partitionBy(column) if column else watched.write
        body = [f for f in rows.schema.fields if f.name != column]
        lines = len(body) == 1 and isinstance(body[0].dataType, T.StringType)  # texts are lines as they are
        (writer.text if lines else writer.json)((self.stage / at).uri)
        found = seen.get
        if found["__all"] != sum(found[n] for n in wanted):
            raise ValueError(f"{column} has values other than {', '.join(wanted)}")
        schema = "value string" if lines else T.StructType(body).simpleString()
        for n in wanted:
            self.parts[n] = {"path": f"{self.version}/{at}" + (f"/{column}={n}" if column else ""), "rows": found[n], "schema": json.loads(T.StructType(body).json()) if not lines else schema}
        return {n: found[n] for n in wanted}

    def keep(self, name: str, rows: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
        """An intermediate table, gone when the bundle is published: `rows` as they are read
        back, and what the write has counted on its way."""
        seen = Observation()
        path = (self.stage / "work" / name).uri
        (rows.observe(seen, *[c.alias(n) for n, c in counts.items()]) if counts else rows).write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path), seen.get if counts else {}

    def write_json(self, name: str, data) -> None:
        """A small report, kept beside the parts."""
        (self.stage / f"{name}.json").write([json.dumps(data, ensure_ascii=False, indent=2), "\n"])
        self.parts[name] = {"path": f"{self.version}/{name}.json", "rows": None}

    def __enter__(self) -> BundleFolder:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.stage.delete()
            return
        (self.stage / "work").delete()
        old = _manifest(self.folder)
        manifest = {"version": self.version, "previous": old and old["version"], "parts": self.parts}
        place = self.folder / MANIFEST
        fresh = place.beside()
        fresh.write([json.dumps(manifest, ensure_ascii=False, indent=2), "\n"])
        fresh.replace(place)
        if old and old["previous"]:
            (self.folder / old["previous"]).delete()


def _manifest(folder: Place) -> dict | None:
    place = folder / MANIFEST
    return json.loads(place.read_text()) if place.exists() else None


def read_manifest(folder) -> dict:
    """What is published."""
    found = _manifest(Place(folder))
    if found is None:
        raise FileNotFoundError(say.NOT_FOUND.format(what="Bundle", path=Place(folder) / MANIFEST))
    return found


def read_part(spark: SparkSession, folder, name: str) -> DataFrame:
    """The rows of a part; lines of text come as `value`."""
    part = read_manifest(folder)["parts"][name]
    schema = part["schema"] if isinstance(part["schema"], str) else T.StructType.fromJson(part["schema"])
    if not part["rows"]:
        return spark.createDataFrame([], schema)
    uri = (Place(folder) / part["path"]).uri
    return spark.read.text(uri) if isinstance(schema, str) else spark.read.schema(schema).json(uri)


def read_lines(spark: SparkSession, folder, name: str) -> DataFrame:
    """The lines of a part as `value`, JSON or any other text."""
    part = read_manifest(folder)["parts"][name]
    return spark.read.text((Place(folder) / part["path"]).uri) if part["rows"] else spark.createDataFrame([], "value string")


def read_report(folder, name: str):
    return json.loads((Place(folder) / read_manifest(folder)["parts"][name]["path"]).read_text())
