"""Stored tables whose versions are lists of folders, committed one after the other.

A version is a small text file that names, for each part of the table, the folders that
hold it. Folders are written once and never changed, so a new version only names what is
new and keeps what is not; a reader has one version from start to end. A version's file
appears whole or not at all, and only if no other writer took its number: a writer that
lost looks at what has come and tries again.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The part of a table that is not divided.
WHOLE = ""


def part_name(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


class Conflict(Exception):
    """Another writer has committed a version in the meantime."""


@dataclass(frozen=True)
class Version:
    """``parts``: folders of each part, below the root. ``marks``: what a writer notes down."""

    number: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """A table below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _name(self, number: int) -> str:
        return f"versions/{number:012d}.json"

    def latest(self) -> Version:
        folder = self._path("versions")
        if not self._files.exists(folder):
            return Version()
        names = [x.getPath().getName() for x in self._files.listStatus(folder)]
        known = [int(x.removesuffix(".json")) for x in names if x.endswith(".json")]
        return self.at(max(known)) if known else Version()

    def at(self, number: int) -> Version:
        if not number:
            return Version()
        stream = self._files.open(self._path(self._name(number)))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, **json.loads(text))

    def commit(self, base: Version, parts: dict[str, list[str]], **marks: int) -> Version:
        """The version after ``base``; raises Conflict if there is one already."""
        new = Version(base.number + 1, parts, {**base.marks, **marks})
        text = json.dumps({"parts": new.parts, "marks": new.marks})
        self._files.mkdirs(self._path("versions"))
        draft, final = f"versions/.{uuid.uuid4().hex}", self._name(new.number)
        out = self._files.create(self._path(draft), False)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        try:
            if not self._published(draft, final):
                raise Conflict(f"version {new.number} of {self.root} is taken")
        finally:
            self._files.delete(self._path(draft), False)
        return new

    def _published(self, draft: str, final: str) -> bool:
        """Give the draft its name unless that is taken, in one step."""
        where = urlparse(str(self._files.makeQualified(self._path(final)).toUri().toString()))
        if where.scheme == "file":
            # Renaming replaces here; a link doesn't.
            try:
                os.link(where.path.replace(final, draft), where.path)
            except FileExistsError:
                return False
            return True
        return bool(self._files.rename(self._path(draft), self._path(final)))

    def write(
        self, df: DataFrame, by: str | None = None, prefix: str = WHOLE
    ) -> dict[str, list[str]]:
        """Store ``df`` in a folder of its own, divided by the column ``by``; gives the parts,
        whose names begin with ``prefix``."""
        folder = f"data/{uuid.uuid4().hex}"
        if by is None:
            df.write.parquet(f"{self.root}/{folder}")
            return {prefix: [folder]}
        # The column stays in the files: a part is read without its folder's name.
        df.withColumn("part", part_name(F.col(by))).write.partitionBy("part").parquet(
            f"{self.root}/{folder}"
        )
        names = [x.getPath().getName() for x in self._files.listStatus(self._path(folder))]
        found = [x for x in names if x.startswith("part=")]
        return {prefix + unquote(x.removeprefix("part=")): [f"{folder}/{x}"] for x in sorted(found)}

    def read(
        self, version: Version | None = None, parts: list[str] | None = None
    ) -> DataFrame:
        """The rows of a version, or of some of its parts; other folders are not listed."""
        version = version or self.latest()
        chosen = version.parts if parts is None else {x: version.parts.get(x, []) for x in parts}
        return self.read_folders([x for folders in chosen.values() for x in folders])

    def read_folders(self, folders: list[str], schema: StructType | None = None) -> DataFrame:
        schema = schema or self.schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{x}" for x in folders))

    def append(self, df: DataFrame) -> Version:
        """Add rows; two writers may do so at once."""
        added = self.write(df.select(*self.schema.names))[WHOLE]
        while True:
            base = self.latest()
            parts = {**base.parts, WHOLE: base.parts.get(WHOLE, []) + added}
            try:
                return self.commit(base, parts)
            except Conflict:
                continue


def folders_since(table: VersionedTable, number: int, now: Version) -> list[str]:
    """What has been added after version ``number``, of a table that is only added to."""
    known = set(table.at(number).parts.get(WHOLE, []))
    return [x for x in now.parts.get(WHOLE, []) if x not in known]


def insert_ignore(table: VersionedTable, new: DataFrame, key: str) -> Version:
    """Add the rows whose key the table lacks; of equal new keys the smallest row.

    Any number of writers may do so at once: each key gets in once. A writer that comes
    second checks its rows again, but only against the folders that have come meanwhile.
    """
    columns = table.schema.names
    least = F.min(F.struct(*columns)).alias("row")
    rows = new.select(*columns).groupBy(key).agg(least).select("row.*")
    base = Version()
    while True:
        now = table.latest()
        came = folders_since(table, base.number, now)
        absent = rows.join(table.read_folders(came).select(key), key, "left_anti")
        added = table.write(absent)[WHOLE]
        rows, base = table.read_folders(added), now
        try:
            return table.commit(now, {**now.parts, WHOLE: now.parts.get(WHOLE, []) + added})
        except Conflict:
            continue


def refresh_parts(table: VersionedTable, rows: DataFrame, by: str, where: Column) -> Version:
    """Replace the parts that ``where`` names, a condition on the column ``by`` alone.

    Parts without rows now go; the folders of all others are taken over as they are.
    """
    written = table.write(rows.filter(where).select(*table.schema.names), by)
    spark = table.spark
    while True:
        base = table.latest()
        kind = table.schema[by].dataType
        listed = spark.createDataFrame([(x,) for x in base.parts], "part string")
        chosen = listed.select("part", F.col("part").try_cast(kind).alias(by)).filter(where)
        replaced = {row["part"] for row in chosen.collect()}
        parts = {x: folders for x, folders in base.parts.items() if x not in replaced}
        try:
            return table.commit(base, {**parts, **written})
        except Conflict:
            continue
