"""Several tables published as one: a reader sees all tables of one version or of the one before, never some of each.

Tables are written to a folder of their own version; a manifest that names them is moved to its place last, and that move is the publication. Readers take the newest manifest and follow it. What a failed or
killed publication leaves has no manifest, so nobody reads it, and retire() clears it away.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_PREFIX, _SUFFIX = "manifest-", ".json"


class Folder:
    """The store that a folder lies in, by Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path())) if self.fs.exists(self.path()) else []

    def has(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def write(self, name: str, text: str) -> None:
        """A whole text under a name that isn't taken yet: written beside it and moved."""
        staged = f".{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(staged), False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.has(name) or not self.fs.rename(self.path(staged), self.path(name)):
            self.delete(staged)
            raise FileExistsError(name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions, the newest last."""
    return [int(n[len(_PREFIX) : -len(_SUFFIX)]) for n in Folder(spark, root).names() if n.startswith(_PREFIX) and n.endswith(_SUFFIX)]


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> int:
    """Write the tables and publish them as the next version, whose number is given back. If two publish at once, the later one fails and nothing of it is seen."""
    folder, version, own = Folder(spark, root), max(versions(spark, root), default=0) + 1, f"tables-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder.root}/{own}/{name}")
    listed = {name: json.loads(df.schema.json()) for name, df in tables.items()}
    folder.write(f"{_PREFIX}{version:010}{_SUFFIX}", json.dumps({"folder": own, "tables": listed}))
    return version


def open_bundle(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, of the newest if none is given; empty where nothing is published."""
    known = versions(spark, root)
    if not known and version is None:
        return {}
    manifest = json.loads(Folder(spark, root).read(f"{_PREFIX}{known[-1] if version is None else version:010}{_SUFFIX}"))
    return {name: spark.read.schema(StructType.fromJson(schema)).parquet(f"{root.rstrip('/')}/{manifest['folder']}/{name}") for name, schema in manifest["tables"].items()}


def retire(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all versions but the newest `keep`, their manifests first, and tables that no manifest names. Not while somebody publishes."""
    folder, known = Folder(spark, root), versions(spark, root)
    for v in known[: max(0, len(known) - keep)]:
        folder.delete(f"{_PREFIX}{v:010}{_SUFFIX}")
    named = {json.loads(folder.read(f"{_PREFIX}{v:010}{_SUFFIX}"))["folder"] for v in versions(spark, root)}
    for name in folder.names():
        if name.startswith("tables-") and name not in named:
            folder.delete(name)
