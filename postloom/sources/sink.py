"""A keyed table in Parquet that batches are merged into: each batch once, touching only its own buckets, all or nothing.

Rows live in buckets by a hash of the columns in `by`. A commit is one small file that names the folder of every bucket and
the last batch of every stream; it is written under another name and renamed, so that readers see the table before a batch
or after it. Folders are never written twice. What a batch that died has written is in no commit and is cleared later.
Writers of one table at a time: a rename onto a commit that is there fails, and the later batch with it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postloom.operators import writes

BUCKETS = 64


class KeyedTable:
    """The table below a path. keys: the columns of a row's key; by: those that its bucket depends on (the keys, or for
    tables that are replaced by group, the group's); version: the newer row of a key has the larger."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: Sequence[str], by: Sequence[str] | None = None, version: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.by, self.version, self.buckets = spark, path.rstrip("/"), list(keys), list(by or keys), version, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        self._fs, self._at = at.getFileSystem(spark._jsc.hadoopConfiguration()), at

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def commits(self) -> list[int]:
        if not self._fs.exists(self._at):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._at) if f.getPath().getName().isdigit())

    def state(self, commit: int | None = None) -> dict:
        """The folder of each bucket and the last batch of each stream, as of a commit (the last one, if None)."""
        known = self.commits()
        if not known:
            return {"folders": {}, "batches": {}}
        stream = self._fs.open(self._path(f"{self.path}/commits/{known[-1] if commit is None else commit}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def rows(self, commit: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table as of a commit; only some buckets, if given."""
        folders = [f for b, f in self.state(commit)["folders"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """rows with their bucket, a bucket's in one task: keys are compared there and written from there, in one shuffle."""
        return rows.withColumn("bucket_", self._bucket()).repartition("bucket_")

    def merge(self, batch: DataFrame, change: Callable[[DataFrame], DataFrame], source: str, number: int, touched: DataFrame | None = None) -> bool:
        """Rewrites the buckets that batch (or touched) has rows for as change(their rows), which may have been dealt to
        their buckets, and commits; False, with nothing done, where this batch of the source, or a later one, has been committed."""
        state, last = self.state(), (self.commits() or [0])[-1]
        if state["batches"].get(source, -1) >= number:
            return False
        found = (batch if touched is None else touched).select(self._bucket().alias("b")).distinct()
        hit = {r["b"] for r in found.collect()}  # self.buckets at most
        folder = f"data/{last + 1}-{uuid.uuid4().hex}"
        if hit:
            new = change(self.rows(buckets=hit))
            new = new if "bucket_" in new.columns else self._dealt(new)
            new.select(*self.schema.names, "bucket_").write.option("compression", "zstd").partitionBy("bucket_").parquet(f"{self.path}/{folder}")
            made = {int(p.getPath().getName().split("=")[1]) for p in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if p.getPath().getName().startswith("bucket_=")}
            state["folders"] = {b: f for b, f in state["folders"].items() if int(b) not in hit} | {str(b): f"{folder}/bucket_={b}" for b in made}
        state["batches"][source] = number
        self._commit(last + 1, state)
        return True

    def _commit(self, number: int, state: dict) -> None:
        draft, final = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.path}/commits/{number}")
        self._fs.mkdirs(self._at)
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{self.path} has a commit {number} of another writer")

    def upsert(self, batch: DataFrame, source: str, number: int, deleted: str | None = None) -> bool:
        """Inserts the batch's rows or puts them in the place of those of equal keys; of rows of one key the newest stays.
        Keys whose newest row has true in `deleted` go."""
        names = self.schema.names
        marked = batch.withColumn("gone_", F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)).select(*names, "gone_")

        def change(old: DataFrame) -> DataFrame:
            both = writes.upsert(old.withColumn("gone_", F.lit(False)), marked, ["bucket_", *self.keys], self.version or self.keys[0], self._dealt)
            return both.where("NOT gone_").drop("gone_")

        return self.merge(marked, change, source, number)

    def replace(self, batch: DataFrame, groups: DataFrame, source: str, number: int) -> bool:
        """Puts the batch's rows in the place of all rows of some groups (rows of the columns in `by`), so that a group
        without rows in the batch goes; rows of other groups in the batch are refused by leaving them out."""
        own = groups.select(*self.by).dropna()
        blank = [F.col(c.name) if c.name in self.by else F.lit(None).cast(c.dataType).alias(c.name) for c in self.schema]

        def change(old: DataFrame) -> DataFrame:
            rows = old.withColumn("from_", F.lit(0)).unionByName(batch.select(*self.schema.names, F.lit(1).alias("from_")))
            rows = self._dealt(rows.unionByName(own.select(*blank, F.lit(2).alias("from_"))))
            last = F.max("from_").over(Window.partitionBy("bucket_", *self.by))  # 2 in groups that are replaced
            return rows.withColumn("last_", last).where("from_ = 0 AND last_ < 2 OR from_ = 1 AND last_ = 2").drop("from_", "last_")

        return self.merge(batch, change, source, number, own)

    def follow(self, stream: DataFrame, source: str, checkpoint: str, deleted: str | None = None, **trigger) -> StreamingQuery:
        """Upserts a stream batch by batch. A batch that is run again after a failure changes nothing."""

        def put(batch: DataFrame, number: int) -> None:
            self.upsert(batch, source, number, deleted)

        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def clear(self, keep: int = 2) -> int:
        """Deletes the folders and commits that none of the last `keep` commits needs, and says how many folders went."""
        known = self.commits()
        last = known[-keep:]
        used = {f.split("/")[1] for c in last for f in self.state(c)["folders"].values()}
        gone = 0
        data = self._path(f"{self.path}/data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f.getPath().getName() not in used:
                self._fs.delete(f.getPath(), True)
                gone += 1
        for c in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/commits/{c}"), False)
        return gone
