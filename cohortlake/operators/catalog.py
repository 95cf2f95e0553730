"""Versioned snapshots: upserts, private attributes as rows, logs and compaction.

A version of a table is a small file that lists the Parquet files it is made of. Appending writes new
files and a new list; an update rewrites only the files that hold a changed row. The list is put in
place by a rename, so readers always see a whole version. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from ..functions.tags import is_private


def to_eav(instances: DataFrame) -> DataFrame:
    """(sop_instance_uid, group_id, element_id, atom_index, value) of odd-group attributes."""
    odd = F.map_filter("attributes", lambda k, v: is_private(k) | k.isin("0099,0010", "0099,1001"))
    tags = instances.select("sop_instance_uid", F.explode(odd).alias("tag", "values"))
    atoms = tags.select("sop_instance_uid", "tag", F.posexplode(F.split("values", r"\\")).alias("atom_index", "value"))
    return atoms.select("sop_instance_uid", F.substring("tag", 1, 4).alias("group_id"), F.substring("tag", 6, 4).alias("element_id"), "atom_index", "value")


def from_eav(eav: DataFrame) -> DataFrame:
    """(sop_instance_uid, attributes): atoms joined by a backslash in order."""
    ordered = eav.groupBy("sop_instance_uid", "group_id", "element_id").agg(F.array_sort(F.collect_list(F.struct("atom_index", "value"))).alias("atoms"))
    value = F.array_join(F.transform("atoms", lambda a: a.value), "\\")
    entries = ordered.select("sop_instance_uid", F.struct(F.concat_ws(",", "group_id", "element_id"), value).alias("e"))
    return entries.groupBy("sop_instance_uid").agg(F.map_from_entries(F.collect_list("e")).alias("attributes"))


def attributes_to_json(attributes: Column) -> Column:
    """An attribute map as one JSON object, in the map's order."""
    return F.to_json(attributes)


def attributes_from_json(text: Column) -> Column:
    """The attribute map of a JSON object; null where the text is none."""
    return F.from_json(text, "map<string,string>")


def replace_eav(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows but for the elements that come anew, and the new rows."""
    keys = ["sop_instance_uid", "group_id", "element_id"]
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], gone: DataFrame | None = None) -> DataFrame:
    """The next snapshot with a column ``change``: kept, updated or inserted.

    One full outer join on the keys; keys in ``gone`` leave unless they come anew.
    """
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in values), F.lit(True).alias("_was"))
    n = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values), F.lit(True).alias("_is"))
    met = o.join(n, keys, "full_outer")
    pick = [F.when(F.col("_is"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c) for c in values]
    change = F.when(F.col("_was") & F.col("_is"), "updated").when(F.col("_is"), "inserted").otherwise("kept")
    out = met.select(*keys, *pick, change.alias("change"))
    if gone is None:
        return out
    left = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
    return out.join(left, keys, "left").filter("_gone is null or change <> 'kept'").drop("_gone")


def update_attributes(instances: DataFrame, changed: DataFrame) -> DataFrame:
    """New attribute maps where there are any."""
    new = changed.select("sop_instance_uid", F.col("attributes").alias("_new"))
    return instances.join(new, "sop_instance_uid", "left").withColumn("attributes", F.coalesce("_new", "attributes")).select(instances.columns)


def new_frames(frames: DataFrame, stored: DataFrame) -> DataFrame:
    """Frames whose pixels aren't stored yet, one row per hash: that of the smallest uid."""
    hashed = frames.withColumn("pixel_hash", F.sha2("pixels", 256))
    first = hashed.groupBy("pixel_hash").agg(F.min("sop_instance_uid").alias("sop_instance_uid"))
    return hashed.join(first, ["pixel_hash", "sop_instance_uid"], "left_semi").join(stored.select("pixel_hash").distinct(), "pixel_hash", "left_anti")


def live_frames(frames: DataFrame, instances: DataFrame) -> DataFrame:
    """Frames that an instance still points to: what compaction keeps."""
    return frames.join(instances.select("sop_instance_uid").distinct(), "sop_instance_uid", "left_semi")


def is_intact() -> Column:
    """Whether a frame's pixels still have their hash."""
    return F.sha2("pixels", 256) == F.col("pixel_hash")


def intact(frames: DataFrame) -> DataFrame:
    return frames.filter(is_intact())


class Catalog:
    """Tables under one folder that Spark can read and write; no file is opened but by Spark and its file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self, name: str) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names(f"{self.folder}/{name}/versions") if n.startswith("v") and n.endswith(".json"))

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def _listed(self, name: str, version: int | None = None) -> dict:
        found = self.versions(name)
        if not found:
            raise FileNotFoundError(f"no table {name} in {self.folder}")
        return json.loads(self.spark.read.text(f"{self.folder}/{name}/versions/v{version or found[-1]}.json", wholetext=True).first()[0])

    def _frame(self, name: str, schema: dict, files: list[str]) -> DataFrame:
        kind = StructType.fromJson(schema)
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.folder}/{name}/data/{f}" for f in files))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        listed = self._listed(name, version)
        return self._frame(name, listed["schema"], listed["files"])

    def _written(self, name: str, df: DataFrame) -> tuple[int, list[str]]:
        """(version to be, its new files)"""
        version = (self.versions(name) or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/data/{version}")
        return version, [f"{version}/{n}" for n in sorted(self._names(f"{self.folder}/{name}/data/{version}")) if n.endswith(".parquet")]

    def _commit(self, name: str, version: int, schema: dict, files: list[str], tags: list[str]) -> int:
        target = f"{self.folder}/{name}/versions/v{version}.json"
        fs, at = self._fs(f"{target}.new")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps({"schema": schema, "files": files, "tags": tags}).encode()))
        out.close()
        if not fs.rename(at, self._fs(target)[1]):
            raise OSError(f"version {version} of {name} exists already")
        return version

    def write(self, name: str, df: DataFrame) -> int:
        """A version made of new files only."""
        version, files = self._written(name, df)
        return self._commit(name, version, df.schema.jsonValue(), files, [])

    def append(self, name: str, df: DataFrame, tag: str | None = None) -> int:
        """The files of the last version and new ones; rows under a tag that is there already are left out."""
        if not self.exists(name):
            version, files = self._written(name, df)
            return self._commit(name, version, df.schema.jsonValue(), files, [tag] if tag else [])
        old = self._listed(name)
        if tag in old["tags"]:
            return self.versions(name)[-1]
        version, files = self._written(name, df.select(*(f["name"] for f in old["schema"]["fields"])))
        return self._commit(name, version, old["schema"], old["files"] + files, old["tags"] + ([tag] if tag else []))

    def update(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Rewrite the files that hold a key of ``keys`` (one column, named as in the table) by ``change``.

        Files without such a key stay as they are; the driver gets the names of the others.
        """
        old, (key,) = self._listed(name), keys.columns
        rows = self._frame(name, old["schema"], old["files"])
        if not old["files"]:
            return self.versions(name)[-1]
        hit = rows.select(key, F.col("_metadata.file_path").alias("_file")).join(keys.distinct(), key, "left_semi").select("_file").distinct().collect()
        touched = {"/".join(r["_file"].split("/")[-2:]) for r in hit}
        if not touched:
            return self.versions(name)[-1]
        changed = change(self._frame(name, old["schema"], sorted(touched)))
        version, files = self._written(name, changed.select(*(f["name"] for f in old["schema"]["fields"])))
        return self._commit(name, version, old["schema"], [f for f in old["files"] if f not in touched] + files, old["tags"])

    def drop(self, name: str) -> None:
        fs, at = self._fs(f"{self.folder}/{name}")
        fs.delete(at, True)

    def vacuum(self, name: str, keep: int = 1) -> list[int]:
        """Delete all but the last versions, and the files that none of those has; returns the versions that went."""
        found = self.versions(name)
        gone, kept = found[:-keep], found[-keep:]
        live = {f for v in kept for f in self._listed(name, v)["files"]}
        for version in gone:
            for f in {*self._listed(name, version)["files"]} - live:
                fs, at = self._fs(f"{self.folder}/{name}/data/{f}")
                fs.delete(at, False)
        for version in gone:
            fs, at = self._fs(f"{self.folder}/{name}/versions/v{version}.json")
            fs.delete(at, False)
        return gone

    def compact(self) -> int:
        """Rewrite the frames that are still live; returns the new version."""
        return self.write("frames", live_frames(self.read("frames"), self.read("instances")))
