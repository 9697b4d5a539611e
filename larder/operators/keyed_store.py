"""Tables of keyed parts with copy-on-write loads and real deletion.

A table is a folder of Parquet parts and a list of manifests. A part is named by
the caller's layout, a function of the row's key (a dataset and a range of its
row numbers, a hash of an external id), so a key always lies in one part. The
newest manifest with a success mark says which folder holds each part; Spark
sets that mark last, so a load is published by one step or not at all, a reader
sees whole loads only, and what a killed load left behind belongs to no
manifest. One writer a table at a time.

* ``replace`` writes parts anew; the others keep their files.
* ``merge`` inserts or updates by key: only parts that hold a row the load
  changes are read and rewritten, so an equal second load rewrites nothing.
* ``drop`` publishes a manifest without some parts, then deletes their folders;
  run again after a failure, it ends in the same state.

The manifest has one row a part and is read by the driver; its size follows the
layout's number of parts, not the number of rows.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from larder.functions.aggregates import arg_max

PART = "_part"
_NO_PART = "(none)"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self, path: str) -> list[str]:
        fs, target = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []

    def _exists(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    def _delete(self, path: str) -> None:
        fs, target = self._fs(path)
        fs.delete(target, True)

    # --- manifests

    def version(self) -> int:
        """Number of the newest published manifest; 0 for a new table."""
        numbers = sorted((int(n.split("=")[1]) for n in self._names(f"{self.path}/manifests") if n.startswith("version=")), reverse=True)
        return next((n for n in numbers if self._exists(f"{self.path}/manifests/version={n}/_SUCCESS")), 0)

    def manifest(self) -> tuple[dict[str, str], str | None, set[str]]:
        """(folder of each part, the rows' schema, marks of the loads that are in)."""
        n = self.version()
        if not n:
            return {}, None, set()
        rows = self.spark.read.parquet(f"{self.path}/manifests/version={n}").collect()  # one row a part, load mark or schema
        return ({r["name"]: r["value"] for r in rows if r["kind"] == "part"}, next(r["value"] for r in rows if r["kind"] == "schema"),
                {r["name"] for r in rows if r["kind"] == "load"})

    def _publish(self, parts: dict[str, str], schema: str, loads: set[str]) -> None:
        rows = [("schema", "", schema), *(("part", k, v) for k, v in parts.items()), *(("load", k, "") for k in loads)]
        # A version without a mark is what a killed load left: it is written over.
        self.spark.createDataFrame(rows, "kind string, name string, value string").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifests/version={self.version() + 1}")

    # --- rows

    def read(self, parts: list[str] | None = None, with_part: bool = False) -> DataFrame:
        """All rows, or those of some parts; files of other parts are not listed."""
        known, schema, _ = self.manifest()
        if schema is None:
            raise ValueError(f"no table at {self.path}")
        fields = StructType.fromJson(_parsed(schema))
        wanted = [known[p] for p in (known if parts is None else parts) if p in known]
        full = StructType([*fields.fields, StructField("batch", StringType()), StructField(PART, StringType())])
        if wanted:
            df = self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{w}" for w in wanted])
        else:
            df = self.spark.createDataFrame([], full)
        return df.select(*[f"`{f}`" for f in fields.names], *([PART] if with_part else []))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows (with their part) as a new batch; folder of each part written."""
        batch = f"batch={uuid.uuid4().hex}"
        rows.write.partitionBy(PART).parquet(f"{self.path}/data/{batch}")
        return {unquote(n.split("=", 1)[1]): f"{batch}/{n}" for n in self._names(f"{self.path}/data/{batch}") if n.startswith(f"{PART}=")}

    @staticmethod
    def _parted(rows: DataFrame, part: Column) -> DataFrame:
        text = part.cast("string")
        return rows.withColumn(PART, F.when(F.length(text) > 0, text).otherwise(F.lit(_NO_PART)))

    def replace(self, rows: DataFrame, part: Column, load: str | None = None) -> list[str]:
        """Rows take the place of all rows of their parts; returns the parts written.

        A ``load`` mark that is published already makes this a no-op, so a replay changes nothing.
        """
        parts, schema, loads = self.manifest()
        if load is not None and load in loads:
            return []
        written = self._write(self._parted(rows, part))
        self._publish(parts | written, schema or rows.schema.json(), loads | ({load} if load is not None else set()))
        return sorted(written)

    def merge(self, incoming: DataFrame, keys: list[str], order: str, part: Column, stamp: str | None = None) -> list[str]:
        """Insert or update by key, the last incoming row of a key (by ``order``) winning; returns the parts rewritten.

        ``stamp``: a boolean column of the table, true for rows that a load brought.
        """
        known, schema, loads = self.manifest()
        if schema is None:
            raise ValueError(f"no table at {self.path}")
        columns = StructType.fromJson(_parsed(schema)).names
        other = [c for c in incoming.columns if c not in keys]
        latest = incoming.groupBy(*keys).agg(arg_max(F.struct(*other), [F.col(order)]).alias("_new")) if other else incoming.distinct()
        latest = latest.select(*keys, *[F.col(f"_new.{c}").alias(c) for c in other])
        if stamp:
            latest = latest.withColumn(stamp, F.lit(True))
        latest = self._parted(latest.select(*columns), part)
        touched = [r[PART] for r in latest.select(PART).distinct().collect()]  # parts, not rows
        old = self.read(touched, with_part=True)
        changed = [r[PART] for r in latest.subtract(old).select(PART).distinct().collect()]
        if not changed:
            return []
        here = F.col(PART).isin(changed)
        kept = old.where(here).join(latest.where(here).select(*keys), keys, "left_anti").select(*columns, PART)
        written = self._write(kept.unionByName(latest.where(here)))
        self._publish(known | written, schema, loads)
        return sorted(changed)

    def drop(self, gone: list[str]) -> list[str]:
        """Remove whole parts; returns those that were there. What no manifest names is deleted with them."""
        parts, schema, loads = self.manifest()
        if schema is None:
            return []
        hit = sorted(set(gone) & set(parts))
        if hit:
            self._publish({k: v for k, v in parts.items() if k not in hit}, schema, loads)
        self.clean()
        return hit

    def clean(self) -> None:
        """Delete folders and manifests that the newest manifest does not need (no reader may be on an older one)."""
        parts, _, _ = self.manifest()
        used = set(parts.values())
        for batch in self._names(f"{self.path}/data"):
            folders = [n for n in self._names(f"{self.path}/data/{batch}") if n.startswith(f"{PART}=")]
            if not any(f"{batch}/{n}" in used for n in folders):
                self._delete(f"{self.path}/data/{batch}")
                continue
            for n in folders:
                if f"{batch}/{n}" not in used:
                    self._delete(f"{self.path}/data/{batch}/{n}")
        newest = self.version()
        for n in self._names(f"{self.path}/manifests"):
            if n != f"version={newest}":
                self._delete(f"{self.path}/manifests/{n}")


def _parsed(schema: str) -> dict:
    return json.loads(schema)


def delete_everywhere(tables: dict[str, KeyedTable], gone: list[str]) -> dict[str, list[str]]:
    """Drop a dataset's parts from child tables first and from the last table named, the catalogue, at the end.

    As long as the catalogue still names the dataset the deletion can be asked for again, and
    steps done before are no-ops then.
    """
    return {name: table.drop(gone) for name, table in tables.items()}
