"""Token counts as delta-maintained rollups.

A ledger keeps, below one folder, a Parquet directory of signed rows for each committed batch: an insert adds a
document's count, a delete takes the counted one back, a revision does both. Totals by source, language and tokenizer
version are additive, so each batch also writes its own totals delta; the totals are the sum of the deltas, and no
earlier row is read to get them. A batch is written aside and renamed into place, and a batch id that is in place
is left alone: repeating a batch, or one that broke off, changes nothing. Rows lie in buckets by the hash of their
(doc_id, version), and a batch reads only the buckets that its changes touch. compact() writes what is counted now, the
totals and the ids of the batches they come from as one snapshot, renamed into place; batches that it covers are then
removed and stay known.

Changes have (op, doc_id, source, lang, version, n_tokens), op insert, delete or revise. The ledger decides what is in
effect: an insert of a counted (doc_id, version) acts as a revision, a revision of an uncounted one as an insert, a
delete of an uncounted one as nothing.

Defined results: null source and lang are groups of their own; null counts are 0; null doc_ids are one document id like
any other; of rows of a batch that repeat a (doc_id, version) the last by (op, n_tokens, source, lang) counts; an empty
batch commits and changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("doc_id", "version")
GROUP = ("source", "lang", "version")
_ROWS = "doc_id long, source string, lang string, version string, n_tokens long, sign int, bucket int"
_TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"


class Ledger:
    """buckets: folders of a batch's rows; a property of the ledger, never to be changed."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, part: str) -> list[str]:
        at = self._path(f"{self.folder}/{part}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The latest snapshot and the ids of the batches that it covers."""
        if not (names := self._names("snapshots")):
            return None, set()
        at = f"{self.folder}/snapshots/{names[-1]}"
        return at, {r["id"] for r in self.spark.read.schema("id string").parquet(f"{at}/ids").collect()}

    def committed(self) -> list[str]:
        """Ids of the batches in place, those that a snapshot covers included."""
        return sorted({*self._names("batches"), *self._snapshot()[1]})

    def _read(self, part: str, schema: str) -> DataFrame:
        snapshot, covered = self._snapshot()
        places = [f"{self.folder}/batches/{x}" for x in self._names("batches") if x not in covered] + [snapshot] * bool(snapshot)
        if not places:
            return self.spark.createDataFrame([], schema)
        # each batch is a partitioned table of its own; compact() bounds their number
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{x}/{part}") for x in places])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def counted(self, buckets: list[int] | None = None) -> DataFrame:
        """What is counted now, in all or some buckets: the rows whose signs don't cancel."""
        rows = self._read("rows", _ROWS)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        net = rows.groupBy(*KEY, "source", "lang", "n_tokens").agg(F.sum("sign").alias("n"))
        return net.where("n > 0").drop("n")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens: the sum of all deltas; groups without a document go."""
        deltas = self._read("totals", _TOTALS)
        summed = deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was in place already."""
        place = self._path(f"{self.folder}/batches/{batch}")
        if batch in self.committed():
            return False
        last = Window.partitionBy(*KEY).orderBy(*[F.col(c).desc_nulls_last() for c in ("op", "n_tokens", "source", "lang")])
        new = changes.select("op", F.col("doc_id").cast("long"), "source", "lang", "version", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        new = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
        added = new.where("op <> 'delete'").select(*KEY, "source", "lang", "n_tokens", F.lit(1).alias("sign"))
        if self.committed():
            touched = [r[0] for r in new.select(self._bucket()).distinct().collect()]  # self.buckets rows at most
            c, n = self.counted(touched).alias("c"), new.select(*KEY).alias("n")
            same = [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in KEY]
            gone = c.join(n, same, "left_semi").select(*KEY, "source", "lang", "n_tokens", F.lit(-1).alias("sign"))
            added = added.unionByName(gone)
        aside = f"{self.folder}/aside/{batch}"
        self._fs.delete(self._path(aside), True)
        self._write(added, f"{aside}/rows")
        rows = self.spark.read.schema(_ROWS).parquet(f"{aside}/rows")
        delta = rows.groupBy(*GROUP).agg(
            F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")
        )
        delta.write.parquet(f"{aside}/totals")
        self._fs.mkdirs(self._path(f"{self.folder}/batches"))
        if not self._fs.rename(self._path(aside), place):
            raise OSError(f"batch {batch} could not be put in place")
        return True


    def _write(self, rows: DataFrame, to: str) -> None:
        rows = rows.select("doc_id", "source", "lang", "version", "n_tokens", "sign", self._bucket().alias("bucket"))
        rows.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(to)

    def compact(self) -> None:
        """Put all committed batches into one snapshot; repeating it, or one that broke off, changes nothing."""
        ids = self.committed()
        if not ids or not self._names("batches"):
            return
        k = len(self._names("snapshots")) and int(self._names("snapshots")[-1]) + 1
        aside = f"{self.folder}/aside/snapshot"
        self._fs.delete(self._path(aside), True)
        self._write(self.counted().withColumn("sign", F.lit(1)), f"{aside}/rows")
        self.totals().write.parquet(f"{aside}/totals")
        self.spark.createDataFrame([(x,) for x in ids], "id string").write.parquet(f"{aside}/ids")
        self._fs.mkdirs(self._path(f"{self.folder}/snapshots"))
        if not self._fs.rename(self._path(aside), self._path(f"{self.folder}/snapshots/{k:012d}")):
            raise OSError("the snapshot could not be put in place")
        for x in ids:
            self._fs.delete(self._path(f"{self.folder}/batches/{x}"), True)
        for x in self._names("snapshots")[:-1]:
            self._fs.delete(self._path(f"{self.folder}/snapshots/{x}"), True)


def history(ledger: Ledger, counts: DataFrame) -> None:
    """The life of a table of counts(doc_id, source, lang, version, n_tokens, copy): all documents come in, the copies
    of earlier texts are taken out again, and what stays is recounted with an end token. The first batch is sent twice, and
    the ledger is compacted after it."""
    every = counts.select("doc_id", "source", "lang", "version", "n_tokens", "copy")
    ledger.commit("0-insert", every.select(F.lit("insert").alias("op"), "*").drop("copy"))
    ledger.commit("0-insert", every.select(F.lit("insert").alias("op"), "*").drop("copy"))
    ledger.compact()
    ledger.commit("1-delete", every.where("copy").select(F.lit("delete").alias("op"), "*").drop("copy"))
    revised = every.where("not copy").withColumn("n_tokens", F.col("n_tokens") + 1)
    ledger.commit("2-revise", revised.select(F.lit("revise").alias("op"), "*").drop("copy"))
