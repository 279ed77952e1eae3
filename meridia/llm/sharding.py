"""Size-tiered shards of a table with a versioned manifest; DataFrame and file-system calls only.

Appends write small immutable Parquet shards. Shards of similar size (a tier is a power of
`growth` in bytes) are merged, once `fanout` of them have gathered, into files of about
`target` bytes, without a shuffle: the reader packs small files into tasks of that size. A version
is a file ``v<number>`` that names its list files, each of which names up to `per_list` shards: an append adds
one list file, a merge rewrites only those that name merged shards. The version file is written aside and renamed without overwriting, so a
reader sees a version whole or not at all and of two racing writers one fails and can retry. `vacuum` removes what
no kept version names, and after a time of grace whatever failed writers have left.

The rename must be atomic in the store (HDFS, local and most shared file systems).

Defined results: rows are kept as they are, nulls, texts of any length, repeated rows and all columns, whatever their names,
included; an empty append commits a version without new shards; a store without a version reads as an empty frame; shards of equal size
merge in the order of their paths.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .store import hadoop_path


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, *, target: int = 128 << 20, fanout: int = 4, growth: int = 4, least: int = 1 << 20, per_list: int = 1000):
        self.spark, self.root, self.per_list = spark, root.rstrip("/"), per_list
        self.target, self.fanout, self.growth, self.least = target, fanout, growth, least

    # ---- manifest

    def _path(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}"

    def versions(self) -> list[int]:
        fs, p = hadoop_path(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def _read(self, path: str):
        fs, p = hadoop_path(self.spark, path)
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, path: str, value) -> None:
        fs, p = hadoop_path(self.spark, path)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, lists: [name]} of a version, by default the latest."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "lists": []}
        return self._read(self._path(known[-1] if version is None else version))

    def _list(self, name: str) -> list[dict]:
        return self._read(f"{self.root}/manifest/{name}")

    def shards(self, manifest: dict) -> list[dict]:
        """[{path, bytes}] of a version."""
        return [s for name in manifest["lists"] for s in self._list(name)]

    def _listed(self, shards: list[dict]) -> list[str]:
        names = []
        for a in range(0, len(shards), self.per_list):
            names.append(f"l-{uuid.uuid4().hex}")
            self._write(f"{self.root}/manifest/{names[-1]}", shards[a : a + self.per_list])
        return names

    def _commit(self, before: dict, lists: list[str], schema: str) -> int:
        version = before["version"] + 1
        tmp = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        self._write(tmp, {"version": version, "schema": schema, "lists": lists})
        fs, p = hadoop_path(self.spark, tmp)
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(p, jvm.org.apache.hadoop.fs.Path(self._path(version)), none)  # fails if the version exists
        except Exception:
            fs.delete(p, False)
            raise
        return version

    def _written(self, folder: str) -> list[dict]:
        fs, p = hadoop_path(self.spark, folder)
        found = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)]
        return [{"path": f"{folder}/{n}", "bytes": b} for n, b in sorted(found) if n.endswith(".parquet")]

    # ---- operations

    def append(self, df: DataFrame) -> int:
        """Write the rows as new shards, one per task, and commit."""
        before = self.manifest()
        schema = df.schema.json()
        if before["schema"] not in (None, schema):
            raise ValueError("the schema differs from that of the table")
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        lists = before["lists"]
        if len(lists) > 1000:  # many small lists become few full ones
            lists = self._listed(self.shards(before))
        return self._commit(before, [*lists, *self._listed(self._written(folder))], schema)

    def tier(self, size: int) -> int:
        """0 below `least` bytes, one more for each factor of `growth`."""
        return 0 if size < self.least else 1 + int(math.log(size / self.least, self.growth))

    def due(self, shards: list[dict]) -> list[dict]:
        """The shards of the lowest tier that has gathered `fanout` of them below the target size, or none."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target * 3 // 4:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        ready = [t for t in sorted(tiers) if len(tiers[t]) >= self.fanout]
        return sorted(tiers[ready[0]], key=lambda s: s["path"]) if ready else []

    def compact(self) -> int:
        """Merge tiers until none is due; returns the latest version."""
        before = self.manifest()
        seen = None
        while (run := self.due(self.shards(before))) and len(run) != seen:
            merged = self._merge(run, before["schema"])
            seen = len(merged)  # the reader may not pack further (its own limits): then stop
            gone, lists, rest = {s["path"] for s in run}, [], []
            for name in before["lists"]:
                held = self._list(name)
                left = [s for s in held if s["path"] not in gone]
                if len(left) == len(held):
                    lists.append(name)
                rest += [] if len(left) == len(held) else left
            self._commit(before, [*lists, *self._listed(rest + merged)], before["schema"])
            before = self.manifest()
        return before["version"]

    def _merge(self, run: list[dict], schema: str) -> list[dict]:
        session = self.spark.newSession()  # settings of its own: those of the caller's session are left alone
        for k, v in (("spark.sql.files.maxPartitionBytes", self.target), ("spark.sql.files.minPartitionNum", 1), ("spark.sql.files.openCostInBytes", 0)):
            session.conf.set(k, str(v))
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        session.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[s["path"] for s in run]).write.parquet(folder)
        return self._written(folder)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m["schema"])) if m["schema"] else StructType()
        shards = self.shards(m)
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s["path"] for s in shards])

    def vacuum(self, keep: int = 1, grace: float = 86400.0) -> int:
        """Forget all but the last `keep` versions and delete the shards that none of these names: at once those that a
        forgotten version names, after `grace` seconds those that no version ever did (of failed or racing writers, of which
        some may still be at work). Returns how many went."""
        if keep < 1:
            raise ValueError("at least one version must be kept")
        known = self.versions()
        old, kept = known[:-keep], [self.manifest(v) for v in known[-keep:]]
        live = {s["path"] for m in kept for s in self.shards(m)}
        gone = [self.manifest(v) for v in old]
        named = {s["path"] for name in {n for m in gone for n in m["lists"]} for s in self._list(name)}
        lists = {n for m in kept for n in m["lists"]}
        jvm, n = self.spark._jvm, 0
        fs, data = hadoop_path(self.spark, f"{self.root}/data")
        for path in [*(named - live), *(f"{self.root}/manifest/{x}" for x in {n for m in gone for n in m["lists"]} - lists), *(self._path(v) for v in old)]:
            n += fs.delete(jvm.org.apache.hadoop.fs.Path(path), False) and path in named
        before = (time.time() - grace) * 1000
        if fs.exists(data):
            for folder in fs.listStatus(data):
                found = list(fs.listStatus(folder.getPath()))
                ours = [s for s in found if f"{self.root}/data/{folder.getPath().getName()}/{s.getPath().getName()}" in live]
                dead = [s for s in found if s not in ours and s.getModificationTime() < before]
                if not ours and len(dead) == len(found) and folder.getModificationTime() < before:
                    n += sum(s.getPath().getName().endswith(".parquet") for s in dead)
                    fs.delete(folder.getPath(), True)
                else:
                    for s in dead:
                        n += fs.delete(s.getPath(), True) and s.getPath().getName().endswith(".parquet")
        manifest = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        for s in fs.listStatus(manifest) if fs.exists(manifest) else ():
            name = s.getPath().getName()
            if (name.startswith(".") or (name.startswith("l-") and name not in lists)) and s.getModificationTime() < before:
                fs.delete(s.getPath(), False)
        return n
