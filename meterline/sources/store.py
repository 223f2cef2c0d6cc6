"""A folder of facts with a list of its live parts, so that days are dropped, replaced and merged without rewriting the rest.

``data/batch=<id>/local_day=<day>/`` holds rows with their fingerprint and a Bloom filter on it; ``live/v=<n>/`` is one text
file that names the live (batch, day) folders. Readers take the highest n. Every change first writes its data, then the next
list; that list is one file moved into place, so a job that dies in between leaves the former state and only unlisted folders,
which ``vacuum`` deletes. One writer at a time: of two that make the same version the second fails.

Defined cases: rows without a time lie in the folder of the first day and never expire; an empty change adds no version.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.functions import timeparse as P
from meterline.operators import imports as M
from meterline.operators import maintain as A
from meterline.schema import MISSING_DAY

HEADER = "batch/local_day"


@dataclass(frozen=True)
class FactStore:
    spark: SparkSession
    root: str
    schema: T.StructType

    # --- the list ---------------------------------------------------------------------------

    def create(self) -> FactStore:
        self._write_list(0, [])
        return self

    def version(self) -> int:
        return self.spark.read.schema("value string, v int").text(f"{self.root}/live").agg(F.max("v")).first()[0]

    def live(self) -> list[tuple[str, str]]:
        """(batch, day) of the live folders: as many as days times the batches not merged yet."""
        rows = self.spark.read.text(f"{self.root}/live/v={self.version()}").collect()
        return sorted(tuple(r.value.split("/")) for r in rows if r.value != HEADER)

    def _write_list(self, version: int, folders: list[tuple[str, str]]) -> None:
        lines = [(HEADER,), *[(f"{b}/{d}",) for b, d in sorted(folders)]]
        self.spark.createDataFrame(lines, "value string").coalesce(1).write.mode("error").text(f"{self.root}/live/v={version}")

    def _swap(self, gone: set[tuple[str, str]], new: list[tuple[str, str]]) -> None:
        if gone or new:
            at = self.version()
            self._write_list(at + 1, [f for f in self.live() if f not in gone] + new)

    # --- rows -------------------------------------------------------------------------------

    def _stored(self) -> T.StructType:
        texts = [T.StructField(n, T.StringType()) for n in ("fingerprint", "batch", "local_day")]
        return T.StructType([*self.schema, *texts])

    def _read(self, folders: list[tuple[str, str]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self._stored())
        paths = [f"{self.root}/data/batch={b}/local_day={d}" for b, d in folders]
        return self.spark.read.schema(self._stored()).option("basePath", f"{self.root}/data").parquet(*paths)

    def read(self) -> DataFrame:
        """Live rows with ``fingerprint`` and ``local_day``; filters on the day, those of the range filters too, prune folders."""
        return self._read(self.live()).drop("batch")

    def _write(self, rows: DataFrame) -> list[tuple[str, str]]:
        """Rows that carry a fingerprint, as a new batch that is not live yet."""
        batch = uuid.uuid4().hex
        path = f"{self.root}/data/batch={batch}"
        (rows.select(*self.schema.names, "fingerprint", P.local_day(F.col("ts")).alias("local_day"))
         .hint("rebalance", "local_day").write.option("parquet.bloom.filter.enabled#fingerprint", "true")
         .partitionBy("local_day").parquet(path))
        written = self.spark.read.schema(self._stored()).parquet(path).select("local_day").distinct()
        return [(batch, r.local_day) for r in written.collect()]

    def append(self, facts: DataFrame) -> None:
        self._swap(set(), self._write(M.with_fingerprint(facts)))

    def find(self, fingerprint: str) -> DataFrame:
        """Rows of one fingerprint: row groups whose Bloom filter lacks it are not read."""
        return self.read().where(F.col("fingerprint") == fingerprint)

    # --- changes ----------------------------------------------------------------------------

    def merge(self, imported: DataFrame, now: Column, retention_days: int = 0, order: list | None = None, salt: str = "") -> None:
        """Add the rows of an import that are not stored yet; compares stored fingerprints of the days it touches only.

        Equal fingerprints have equal times, so no other day can hold them. The days are listed by the driver: calendar days.
        """
        fresh = M.admitted(imported, now, salt).where(~F.col("refused") & M.inside_retention(now, retention_days))
        self._swap(set(), self._write(M.import_antijoin(self.known(fresh), fresh, order or ["id"])))

    def known(self, fresh: DataFrame) -> DataFrame:
        days = {r.day for r in fresh.select(P.local_day(F.col("ts")).alias("day")).distinct().collect()}
        return self._read([f for f in self.live() if f[1] in days]).select("fingerprint")

    def expire(self, now: Column, days: int) -> None:
        """Drop whole days older than the retention from the list; only the day the edge falls in is written anew."""
        if days <= 0:
            return
        edge = self.spark.range(1).select(P.local_day(now - F.expr(f"INTERVAL {days} DAYS"))).first()[0]
        live = self.live()
        cut = [f for f in live if f[1] == edge]
        kept = self._write(A.prune_retention(self._read(cut), now, days)[0]) if cut else []
        self._swap({f for f in live if f[1] <= edge and f[1] != MISSING_DAY}, kept)

    def compact(self, most: int = 1) -> None:
        """Write each day that lies in more than ``most`` batches as one batch; other days stay as they are."""
        live = self.live()
        days = [d for _, d in live]
        many = [f for f in live if days.count(f[1]) > most]
        if many:
            self._swap(set(many), self._write(self._read(many)))

    def vacuum(self) -> int:
        """Delete folders that are not live and older lists, once no reader uses them; returns how many day folders went."""
        live, at = set(self.live()), self.version()
        data = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        fs = data.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [(b, d) for b in fs.listStatus(data) for d in fs.listStatus(b.getPath()) if "=" in d.getPath().getName()]
        gone = [d.getPath() for b, d in found if (b.getPath().getName()[6:], d.getPath().getName()[10:]) not in live]
        for path in gone:
            fs.delete(path, True)
        for v in fs.listStatus(data.getParent().suffix("/live")):
            if v.getPath().getName() != f"v={at}":
                fs.delete(v.getPath(), True)
        return len(gone)
