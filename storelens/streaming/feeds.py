"""STR-05: product feeds that arrive in pieces, applied as a log of changed cards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from storelens.operators.changes import apply_feed

c = F.col
STILL = ("unchanged", "kept")


class CatalogLog:
    """A catalog in a folder: snapshots of all cards, and per feed the cards it changed.

    ``staged/epoch=<n>`` holds the feed rows of a micro-batch until newer feeds are applied. A feed is whole when its end row has come and
    as many rows as that states; only then it is compared with the cards, so a product that
    has not arrived yet is never taken for a missing one. ``log/feed=<id>`` holds the changed cards,
    ``outcomes/feed=<id>`` the products per outcome. After ``compact`` feeds ``snapshot/feed=<id>`` holds all cards again.

    Everything is written under names that follow from epochs and feed ids, the log last, so a batch
    that runs again after a failure ends in the same tables. A whole feed replaces older ones that
    never became whole.
    """

    def __init__(self, spark: SparkSession, folder: str, compact: int = 8):
        self.spark, self.folder, self.compact = spark, folder.rstrip("/"), compact

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _done(self, kind: str) -> list[int]:
        """Feed ids or epochs whose folder of that kind was written to the end."""
        fs, path = self._fs(f"{self.folder}/{kind}")
        if not fs.exists(path):
            return []
        names = [s.getPath().toString() for s in fs.listStatus(path)]
        whole = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{n}/_SUCCESS"))]
        return sorted(int(n.rsplit("=", 1)[1]) for n in whole)

    def _read(self, kind: str, numbers: list[int], name: str) -> DataFrame | None:
        """Those folders as one table with their number as column ``name``."""
        parts = [self.spark.read.parquet(f"{self.folder}/{kind}/{name}={n}").withColumn(name, F.lit(n).cast("bigint")) for n in numbers]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def create(self, cards: DataFrame) -> None:
        cards.write.mode("overwrite").parquet(f"{self.folder}/snapshot/feed=-1")

    def cards(self) -> DataFrame:
        """The current cards: the last snapshot, and over it the last change of each card."""
        base = self._done("snapshot")[-1]
        later = [f for f in self._done("log") if f > base]
        cards = self._read("snapshot", [base], "feed")
        if not later:
            return cards.drop("feed")
        rows = cards.unionByName(self._read("log", later, "feed").drop("outcome"))
        names = [x for x in rows.columns if x not in ("id", "feed")]
        return rows.groupBy("id").agg(F.max_by(F.struct(*names), "feed").alias("r")).select("id", "r.*").select(*[x for x in rows.columns if x != "feed"])

    def changes(self) -> DataFrame | None:
        """Every changed card with its outcome and feed."""
        return self._read("log", self._done("log"), "feed")

    def outcomes(self) -> DataFrame | None:
        return self._read("outcomes", self._done("log"), "feed")

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Stage a micro-batch of feed rows (feed, end_rows and the columns of ``apply_feed``) and apply the newest feed that is whole.

        An end row has the feed's number of products in ``end_rows``, which is null in product rows. A feed's rows may
        come in any order and, with equal values, more than once.
        """
        batch.write.mode("overwrite").parquet(f"{self.folder}/staged/epoch={epoch}")
        applied = self._done("log")
        every = self._read("staged", [e for e in self._done("staged") if e <= epoch], "epoch")
        staged = every.filter(c("feed") > F.lit(applied[-1] if applied else -1)).drop("epoch")
        sizes = staged.groupBy("feed", "id").agg(F.max("end_rows").alias("end_rows")).groupBy("feed").agg(F.max("end_rows").alias("want"), F.count("id").alias("got"))
        newest = sizes.filter("got = want").agg(F.max("feed")).first()[0]
        if newest is None:
            return
        feed = staged.filter((c("feed") == newest) & c("end_rows").isNull()).drop("feed", "end_rows").dropDuplicates(["id"])
        cards = self.cards()
        full = f"{self.folder}/full/feed={newest}"
        apply_feed(cards, feed).write.mode("overwrite").parquet(full)
        out = self.spark.read.parquet(full)
        out.groupBy("outcome").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/outcomes/feed={newest}")
        out.filter(~c("outcome").isin(*STILL)).write.mode("overwrite").parquet(f"{self.folder}/log/feed={newest}")
        since = [f for f in self._done("log") if f > self._done("snapshot")[-1]]
        if len(since) >= self.compact:
            out.drop("outcome").write.mode("overwrite").parquet(f"{self.folder}/snapshot/feed={newest}")
        past = every.groupBy("epoch").agg(F.max("feed").alias("last")).filter((c("last") <= newest) & (c("epoch") < epoch)).collect()  # a row per open batch
        for path in [full, *[f"{self.folder}/staged/epoch={r['epoch']}" for r in past]]:
            fs, p = self._fs(path)
            fs.delete(p, True)


def catalog_writer(folder: str, compact: int = 8) -> Callable[[DataFrame, int], None]:
    """STR-05: a foreachBatch function that stages each batch and applies feeds that became whole."""
    return lambda batch, epoch: CatalogLog(batch.sparkSession, folder, compact).apply(batch, epoch)


def stream_catalog_changes(feed: DataFrame, folder: str, checkpoint: str, compact: int = 8):
    """STR-05: starts the feed stream over the catalog log in ``folder``; returns the streaming query."""
    return (feed.writeStream.foreachBatch(catalog_writer(folder, compact)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
