"""Tables made of folders, with a small pointer that says which of them count.

A writer puts new folders aside and then writes the next version of the pointer: one
small file that names all folders of the table.  Two slots are written in turn, so the
newest whole version can be read whatever happens while the next one is written; folders
that no pointer names are never read.  One writer at a time per table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

_POINTER = "version long, entries long, entry string"


class Versions:
    """The pointer of the table at ``path``; an entry is a dict with at least ``folder``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._opened = spark, path.rstrip("/"), False

    def _slot(self, version: int) -> str:
        return f"{self.path}/pointer/slot={version % 2}"

    def _open(self) -> None:
        """Both slots exist, so that they can be read."""
        for version in () if self._opened else (0, 1):
            none = self.spark.range(0).selectExpr("0L AS version", "0L AS entries", "'' AS entry")
            none.write.mode("ignore").json(self._slot(version))
        self._opened = True

    def read(self) -> tuple[int, list[dict]]:
        """Newest whole version and its entries; 0 and none for a new table."""
        self._open()
        rows = self.spark.read.schema(_POINTER).json([self._slot(0), self._slot(1)]).collect()
        found: dict[int, list] = {}
        for row in rows:
            found.setdefault(row["version"], []).append(row)
        whole = [v for v, r in found.items() if v is not None and len(r) == max(1, r[0]["entries"])]
        if not whole:
            return 0, []
        newest = max(whole)
        return newest, [json.loads(r["entry"]) for r in found[newest] if r["entry"]]

    def publish(self, entries: list[dict], version: int | None = None) -> int:
        """Make ``entries`` the table, in the place of ``version``, the newest if not given."""
        now = self.read()[0] if version is None else version
        rows = [(now + 1, len(entries), json.dumps(e)) for e in entries] or [(now + 1, 0, None)]
        self.spark.createDataFrame(rows, _POINTER).coalesce(1).write.mode("overwrite").json(self._slot(now + 1))
        return now + 1

    def new_folder(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def at(self, folder: str) -> str:
        return f"{self.path}/{folder}"


def publish(rows: DataFrame, path: str) -> bool:
    """Replace the table at ``path`` by ``rows`` as a whole, if there are any.

    Rows are computed once, into a folder aside; readers see the old table until the
    pointer is written.  Without rows, and after a failure, the old table stays."""
    table = Versions(rows.sparkSession, path)
    version, _ = table.read()
    folder = table.new_folder()
    rows.write.parquet(table.at(folder))
    if rows.sparkSession.read.schema(rows.schema).parquet(table.at(folder)).isEmpty():
        return False
    table.publish([{"folder": folder, "schema": rows.schema.json()}], version)
    return True


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version; a table that was never published is an error."""
    table = Versions(spark, path)
    _, entries = table.read()
    if not entries:
        raise FileNotFoundError(f"nothing has been published at {path}")
    schema = StructType.fromJson(json.loads(entries[0]["schema"]))
    return spark.read.schema(schema).parquet(*[table.at(e["folder"]) for e in entries])


class BatchTable(Versions):
    """A table to which batches of several runs add folders, merged as they grow many.

    A batch that runs again replaces its own folder.  ``FAN`` folders of a level become
    one of the next, so there are about ``FAN`` times log(batches) of them.  The last
    batch of each run is never merged, since it may still be repeated."""

    FAN = 8

    def settled(self, run: str, batch: int) -> list[dict]:
        """Entries that a batch may see: all but its own earlier attempts."""
        return [e for e in self.read()[1] if e["run"] != run or e["batch"] < batch]

    def add(self, run: str, batch: int, entry: dict) -> None:
        version, entries = self.read()
        kept = [e for e in entries if e["run"] != run or e["batch"] < batch]
        self.publish([*kept, {**entry, "run": run, "batch": batch, "level": 0}], version)

    def merge(self, combine) -> None:
        """``combine(entries) -> entry`` writes one folder for several and describes it."""
        while True:
            version, entries = self.read()
            last = {}
            for e in entries:
                last[e["run"]] = max(last.get(e["run"], -1), e["batch"])
            levels: dict[int, list] = {}
            for e in entries:
                if e["level"] or e["batch"] < last[e["run"]]:
                    levels.setdefault(e["level"], []).append(e)
            full = [(k, x) for k, x in sorted(levels.items()) if len(x) >= self.FAN]
            if not full:
                return
            level, merged = full[0]
            # Its batches are final for every run, so no run owns it.
            one = {**combine(merged), "run": "", "batch": -1, "level": level + 1}
            self.publish([e for e in entries if e not in merged] + [one], version)


class BucketIndex(BatchTable):
    """Rows found by a hash of their key: a look-up reads only the buckets that it asks for.

    Buckets are folders of one file each; the pointer knows which exist, so nothing is
    listed.  Take so many buckets that one is a few megabytes."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int = 32):
        super().__init__(spark, path)
        self.schema, self.key, self.buckets = schema, key, buckets

    def bucket(self, *key) -> Column:
        return F.pmod(F.xxhash64(*(key or self.key)), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, *key) -> list[int]:
        """Buckets in which ``rows`` may have matches; at most all of them."""
        return sorted(r[0] for r in rows.select(self.bucket(*key)).distinct().collect())

    def paths(self, buckets: list[int], entries: list[dict]) -> list[str]:
        asked = set(buckets)
        return [self.at(f"{e['folder']}/bucket={b}") for e in entries for b in e["buckets"] if b in asked]

    def find(self, buckets: list[int], run: str, batch: int) -> DataFrame:
        return self._rows(self.paths(buckets, self.settled(run, batch)))

    def _rows(self, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame) -> dict:
        folder = self.new_folder()
        dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(self.at(folder))
        written = self.spark.read.schema(StructType([StructField("bucket", IntegerType())])).parquet(self.at(folder))
        return {"folder": folder, "buckets": sorted(r[0] for r in written.select("bucket").distinct().collect())}

    def append(self, rows: DataFrame, run: str, batch: int) -> None:
        """Add the rows of a batch, then merge folders that have grown many."""
        self.add(run, batch, self._write(rows))
        self.merge(lambda entries: self._write(self._rows(self.paths(list(range(self.buckets)), entries))))
