"""Lines that many documents share are dropped, with DataFrame functions only.

What is known of the lines so far lies in sorted runs in a folder: a run has a 128-bit hash of
each line key and in how many documents it was found, in buckets by the hash and sorted inside
them.  A new batch

1. gets its own counts (a key counts once in a document),
2. is merge-anti-joined with every run, which leaves out the keys that some run has in
   ``min_docs`` documents already: nothing more needs to be known of them,
3. is added as a run of level 0.

Runs are read bucket by bucket in their order, so the anti-joins neither shuffle nor sort them.
When a level has ``fanout`` runs they are merged into one of the next level.  A run's name tells
which batches it holds, so a batch that is added twice (after a lost driver) counts once, and runs
that were merged but not yet deleted are passed over.

Last, the totals of the runs tell the common keys, these are joined to the lines, and each document
gets the positions of the lines it loses.  The hot lines of a join side are split by Spark, and
their counts are summed before they are shuffled.

Nulls: a null text is empty, which is one empty line; a null doc_id is an id like any other.
Repeated rows are documents of their own in the counts, and lose the same lines.  A key of fewer
than ``min_chars`` code points, so at least the empty key, is never dropped.  Empty tables give
empty results.  Columns that bear a result's name are replaced; any others are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, CLEAN_SHUFFLES, settings, work_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How many runs of a level are merged into one of the next.
FANOUT = 3
#: In how many batches ``drop_common_lines`` adds one table.
BATCHES = 6
#: Settings under which runs are read: a bucket of one file is known to be sorted, buckets are always
#: used, and the rows of a union are shuffled by key (Spark 4.1's union of bucketed columnar scans says
#: that it is dealt by key, but is not, and sums over it would be wrong).
READING = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.unionOutputPartitioning": "false",
}


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(docs: DataFrame, text: str = "text", min_chars: int = 1, keep: list[Column] | None = None) -> DataFrame:
    """A row for each line with a key long enough: ``keep``, at (from 0), h1, h2, first (of its key in the document)."""
    lines = F.split(ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), "\n")

    def hashed(line: Column, i: Column) -> Column:
        key = F.btrim(line, F.lit(BLANKS))
        long_enough = F.length(key) >= max(1, min_chars)
        return F.struct(F.when(long_enough, F.xxhash64(key)).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), i.alias("at"))

    out = docs.select(*(keep or []), F.sort_array(F.filter(F.transform(lines, hashed), lambda x: x["h1"].isNotNull())).alias("_k"))
    out = out.select(*[c for c in out.columns if c != "_k"], F.posexplode("_k").alias("_p", "_x"), "_k")
    before = F.get("_k", F.col("_p") - 1)
    same = F.coalesce((before["h1"] == F.col("_x")["h1"]) & (before["h2"] == F.col("_x")["h2"]), F.lit(False))
    names = [c for c in out.columns if c not in ("_k", "_p", "_x")]
    return out.select(*names, "_x.at", "_x.h1", "_x.h2", (~same).alias("first"))


class LineRuns:
    """The levelled runs of one folder; open it again to go on."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int = 10, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.min_docs, self.fanout = spark, path.rstrip("/"), min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[tuple[int, int, int, int], str] = {}
        for run in self._stored():
            self._open(run)
        if self.tables:  # a folder keeps the buckets that it began with
            self.buckets = next(iter(self.tables))[3]

    def _stored(self) -> list[tuple[int, int, int, int]]:
        """(level, first batch, last batch, buckets) of the finished runs, without those that a higher level holds."""
        glob = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-*/_SUCCESS")
        found = glob.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
        runs = [tuple(map(int, f.getPath().getParent().getName().split("-")[1:])) for f in found or []]
        return sorted(r for r in runs if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in runs))

    def _folder(self, run: tuple[int, int, int, int]) -> str:
        return f"{self.path}/run-" + "-".join(map(str, run))

    def _open(self, run: tuple[int, int, int, int]) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) "
            f"INTO {run[3]} BUCKETS LOCATION '{self._folder(run)}'"
        )
        self.tables[run] = name

    def _store(self, counts: DataFrame, run: tuple[int, int, int, int]) -> None:
        """Written by bucket, one sorted file for each."""
        name = f"line_run_{uuid.uuid4().hex}"
        with settings(self.spark, READING | {CLEAN_SHUFFLES: "true"}):
            writer = counts.select("h1", "h2", "n").write.mode("overwrite").format("parquet").option("path", self._folder(run))
            writer.bucketBy(run[3], "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.tables[run] = name

    def known(self) -> list[DataFrame]:
        return [self.spark.table(t) for t in self.tables.values()]

    def add(self, lines: DataFrame, batch: int) -> None:
        """Counts the ``first`` lines (h1, h2) of batch number ``batch``, if no run has it yet."""
        if any(first <= batch <= last for _, first, last, _ in self.tables):
            return
        counts = lines.where("first").repartition(self.buckets, "h1", "h2") if self._uneven() else lines.where("first")
        counts = counts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        for run in self.known():
            counts = counts.join(run.where(F.col("n") >= self.min_docs), ["h1", "h2"], "left_anti")
        self._store(counts, (0, batch, batch, self.buckets))
        self._compact()

    def _uneven(self) -> bool:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets

    def _compact(self) -> None:
        level = 0
        while len(full := sorted(r for r in self.tables if r[0] == level)) >= self.fanout:
            self._store(self._sums([self.spark.table(self.tables[r]) for r in full]), (level + 1, full[0][1], full[-1][2], self.buckets))
            for r in full:
                self._drop(r)
            level += 1

    @staticmethod
    def _sums(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for r in runs[1:]:
            both = both.unionByName(r)
        return both.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def _drop(self, run: tuple[int, int, int, int]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(run))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def common(self) -> DataFrame:
        """h1, h2 of the keys that all batches together have in ``min_docs`` documents, written to the shared folder."""
        if not self.tables:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        with settings(self.spark, READING):
            return written(self._sums(self.known()).where(F.col("n") >= self.min_docs).select("h1", "h2"), "common-lines")

    def close(self) -> None:
        """Forgets the tables; the runs stay in the folder."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()

    def delete(self) -> None:
        for run in list(self.tables):
            self._drop(run)


def drop_common_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1,
    batches: int = BATCHES, fanout: int = FANOUT, path: str | None = None,
) -> DataFrame:
    """``docs`` without the text, with n_lines, n_dropped and kept (the lines left, joined by line feeds).

    ``path``: a folder whose runs hold earlier tables' lines too; none by default.  The table is
    dealt into ``batches`` by a digest of its rows, and each is added in turn.
    """
    spark = docs.sparkSession
    results = ("n_lines", "n_dropped", "kept")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = [F.xxhash64(F.col(f"`{doc_id}`"), whole).alias("_d1"), F.xxhash64(F.lit(1), F.col(f"`{doc_id}`"), whole).alias("_d2")]
    lines = line_keys(docs, text, min_chars, own).withColumn("batch", F.pmod("_d2", F.lit(batches)).cast("int"))
    lines = _by_batch(lines)
    runs = LineRuns(spark, path or work_dir(spark, "line-runs"), min_docs, fanout)
    done = max((last for _, _, last, _ in runs.tables), default=-1) + 1 if path else 0
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b), done + b)
    common = runs.common()
    runs.close() if path else runs.delete()
    lost = lines.join(common, ["h1", "h2"], "left_semi").groupBy("_d1", "_d2").agg(F.sort_array(F.collect_set("at")).alias("_at"))
    named = {c: f"_in_{c}" for c in docs.columns}
    told = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in named.items()])
    whole = F.coalesce(F.col(f"`{named[text]}`"), F.lit(""))
    key = F.col(f"`{named[doc_id]}`")
    told = told.withColumns({"_d1": F.xxhash64(key, whole), "_d2": F.xxhash64(F.lit(1), key, whole)}).join(lost, ["_d1", "_d2"], "left")
    # What is left between two lost lines is a slice, so the cost is that of the lines, not of lines times losses.
    told = told.withColumn("_all", F.split(whole, "\n")).withColumn("_ends", F.concat(F.array(F.lit(-1)), F.coalesce("_at", F.array().cast("array<int>")), F.array(F.size("_all"))))
    between = F.transform(
        F.sequence(F.lit(0), F.size("_ends") - 2),
        lambda i: F.slice("_all", F.get("_ends", i) + 2, F.get("_ends", i + 1) - F.get("_ends", i) - 1),
    )
    kept = F.when(F.col("_at").isNull(), whole).otherwise(F.array_join(F.flatten(between), "\n"))
    return told.select(
        *[F.col(x).alias(c) for c, x in named.items() if c not in (*results, text)],
        F.size("_all").cast("long").alias("n_lines"),
        F.coalesce(F.size("_at"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def _by_batch(lines: DataFrame) -> DataFrame:
    """``lines`` written once in a folder for each batch, so that a batch reads its own rows only."""
    spark = lines.sparkSession
    path = work_dir(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    return spark.read.schema(lines.schema).parquet(path)
