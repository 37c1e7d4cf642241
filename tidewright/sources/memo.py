"""A keyed memo that lasts: values of keys are computed once and kept for later runs.

A store is a folder of Parquet parts and of versions. A version is one small file that names the parts
which belong to it; parts hold rows by bucket of the key's hash and never change. A run reads the
newest version, computes what is missing, writes it as a new part and then puts the next version in
place by a rename, which the file system does whole or not at all. A run that is lost before leaves a
part that no version names. Where another run was faster, the next free version is taken, with its parts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a part; a store whose version names more parts than `PARTS` is put together in one.
BUCKETS, PARTS = 64, 16


class Memo:
    """A store at a path that driver and executors share. key: name of its column; values: name and type of the others."""

    def __init__(self, spark: SparkSession, path: str, key: str, values: str, *, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T.StructType([T.StructField(key, T.StringType()), *T.StructType.fromDDL(values).fields])

    def _path(self, name: str):
        own = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return own, own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> tuple[int, list[str]]:
        """The newest version's number (0: none yet) and its parts."""
        folder, system = self._path("versions")
        if not system.exists(folder):
            return 0, []
        numbers = [int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit()]
        if not numbers:
            return 0, []
        return max(numbers), json.loads(self.spark.read.text(f"{self.path}/versions/{max(numbers)}", wholetext=True).first().value)

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """key and values of the newest version (or of some parts)."""
        own = self.version()[1] if parts is None else parts
        if not own:
            return self.spark.createDataFrame([], self.schema).withColumn("_bucket", F.lit(0))
        whole = T.StructType([*self.schema.fields, T.StructField("_part", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/parts").parquet(*[f"{self.path}/parts/_part={p}" for p in own]).drop("_part")

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _publish(self, parts_of: Callable[[list[str]], list[str]]) -> None:
        """Puts the next version in place; tried again on the newer one where another run was faster."""
        while True:
            now, parts = self.version()
            draft, system = self._path(f"drafts/{uuid.uuid4().hex}")
            system.mkdirs(draft.getParent())
            system.mkdirs(self._path("versions")[0])
            out = system.create(draft, False)
            out.write(bytearray(json.dumps(parts_of(parts)).encode()))
            out.close()
            final = self._path(f"versions/{now + 1}")[0]
            if not system.exists(final) and system.rename(draft, final):
                return
            system.delete(draft, False)

    def add(self, rows: DataFrame) -> None:
        """Rows of new keys as one part of the next version."""
        part = uuid.uuid4().hex
        rows.select(F.col(self.key).cast("string").alias(self.key), *self.schema.names[1:], self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/parts/_part={part}")
        self._publish(lambda parts: [*parts, part])
        if len(self.version()[1]) > PARTS:
            self.compact()

    def compact(self) -> None:
        """All parts of the newest version as one; parts that came meanwhile stay beside it."""
        old = self.version()[1]
        part = uuid.uuid4().hex
        self.read(old).dropDuplicates([self.key]).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/parts/_part={part}")
        self._publish(lambda parts: [part, *[p for p in parts if p not in old]])

    def values(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows with the values of their key (text); those of keys that the store lacks are computed once each and added.

        compute: from one row of each missing key to key and values. Null keys have no values.
        """
        keyed = rows.withColumn("_bucket", self._bucket())
        known = self.read()
        missing = keyed.filter(F.col(self.key).isNotNull()).join(known.select(self.key, "_bucket"), [self.key, "_bucket"], "left_anti").drop("_bucket").dropDuplicates([self.key])
        fresh = compute(missing)
        part_before = self.version()[0]
        if not missing.isEmpty():
            self.add(fresh)
        return keyed.join(self.read() if self.version()[0] != part_before else known, [self.key, "_bucket"], "left").drop("_bucket")
