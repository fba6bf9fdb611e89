"""The state of scrapers as a log of batches and snapshots.

A batch of events is one commit: its rows are numbered on from the last batch,
written, and then named by a manifest, the only thing that a reader looks at;
a batch that failed half-way is in none. After ``fan`` batches the tail is
merged into a segment, ``fan`` segments of a level into one of the next, and
the state that follows from all events is written as a snapshot, so that
reading the state means the snapshot and at most ``fan`` batches, and the files
stay few however many runs are recorded. A batch carries a token; one that was
committed before changes nothing. Two writers cannot both write the same
manifest: the second one gets ``ConcurrentWrite``.

Kinds of events: ``register`` (name, target_url, schema_fields), ``version``
(a new strategy; its number is allotted), ``deploy`` (makes ``version`` current,
or the newest one if it is null), ``rollback`` (the same, with an audit trail),
``run`` (health and report) and ``repair``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stage import stage

EVENT = (
    "kind string, scraper_id bigint, at double, name string, target_url string, schema_fields array<string>, version int, old_version int, strategy string, reason string, confidence double, "
    "health_score double, status string, records_expected bigint, records_received bigint, signals array<string>, report string, candidate_count int, selected string, plan string, action string"
)
LOGGED = f"seq bigint, refused boolean, {EVENT}"
STATE = "scraper_id bigint, last_seq bigint, registered struct<seq:bigint,name:string,target_url:string,schema_fields:array<string>>, current struct<seq:bigint,version:int>, health struct<seq:bigint,health_score:double,status:string>, max_version int, n_runs bigint"


class ConcurrentWrite(RuntimeError):
    """Another writer committed first."""


def _summed(rows: DataFrame) -> DataFrame:
    """STATE of events; the state of states is merged by ``_merged``."""
    of = lambda kinds, *names: F.max_by(F.struct("seq", *names), F.when(F.col("kind").isin(*kinds) & ~F.col("refused"), F.col("seq")))
    return rows.groupBy("scraper_id").agg(
        F.max("seq").alias("last_seq"), of(["register"], "name", "target_url", "schema_fields").alias("registered"), of(["deploy", "rollback"], "version").alias("current"),
        of(["run"], "health_score", "status").alias("health"), F.max(F.when(F.col("kind") == "version", F.col("version"))).alias("max_version"), F.count_if(F.col("kind") == "run").alias("n_runs"),
    )


def _merged(states: DataFrame) -> DataFrame:
    last = lambda c: F.max_by(c, F.col(f"{c}.seq")).alias(c)
    return states.groupBy("scraper_id").agg(F.max("last_seq").alias("last_seq"), last("registered"), last("current"), last("health"), F.max("max_version").alias("max_version"), F.sum("n_runs").alias("n_runs"))


class StateLog:
    def __init__(self, spark: SparkSession, root: str, fan: int = 8) -> None:
        self.spark, self.root, self.fan = spark, root.rstrip("/"), fan

    # ---- manifests

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def manifest(self) -> dict:
        fs, folder = self._fs(f"{self.root}/manifests")
        names = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()] if fs.exists(folder) else []
        if not names:
            return {"number": 0, "next": 1, "tail": [], "segments": [], "snapshot": None, "tokens": None}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{max(names)}", wholetext=True).first()[0])

    def _commit(self, held: dict, old: dict) -> None:
        fs, path = self._fs(f"{self.root}/manifests/{held['number']}")
        try:
            out = fs.create(path, False)
        except Exception as error:
            raise ConcurrentWrite(f"manifest {held['number']} is there already") from error
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        # what no reader of the manifest before this one looks at any more
        if (stale := old["number"] - 1) > 0:
            self._drop(f"{self.root}/manifests/{stale}")
        for path in old.get("gone", []):
            self._drop(path)

    def _drop(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    # ---- writing

    def append(self, token: str, events: DataFrame, order: list[str]) -> bool:
        """Commit a batch; false if its token was committed before.

        ``events`` has ``kind``, ``scraper_id`` and what else of EVENT it needs
        (other columns are left out, missing ones are null). Sequence numbers
        follow ``order``, ties in any order. Versions are numbered within the
        scraper; a ``deploy`` or ``rollback`` to a version that is not there at
        its place in the log is kept as ``refused`` and has no effect.
        """
        old = self.manifest()
        if token in [t["token"] for t in old["tail"]] or old["tokens"] and not self.spark.read.parquet(old["tokens"]).where(F.col("token") == token).isEmpty():
            return False
        path = f"{self.root}/batches/{uuid.uuid4().hex}"
        rows = self._numbered(self._fitted(events, order), len(order), old["next"])
        self._resolved(rows, old).write.parquet(path)
        count = self.spark.read.parquet(path).count()
        held = old | {"number": old["number"] + 1, "next": old["next"] + count, "tail": [*old["tail"], {"token": token, "path": path}], "gone": []}
        self._commit(self._compacted(held) if len(held["tail"]) >= self.fan else held, old)
        return True

    def _fitted(self, events: DataFrame, order: list[str]) -> DataFrame:
        there = {c.lower() for c in events.columns}
        fields = [(f.name, f.dataType) for f in self.spark.createDataFrame([], EVENT).schema]
        own = [(F.col(n) if n in there else F.lit(None)).cast(t).alias(n) for n, t in fields]
        return events.select(*own, *[F.col(c).alias(f"_o{n}") for n, c in enumerate(order)])

    def _numbered(self, rows: DataFrame, n: int, first: int) -> DataFrame:
        """Append ``seq`` from ``first`` on, in order, without gaps and without bringing the batch to one task."""
        by = [f"_o{k}" for k in range(n)]
        parts = stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
        # a row per partition
        sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
        return parts.join(starts, "_part").withColumn("seq", F.col("_start") + F.col("_row") + first).drop("_part", "_row", "_start", *by)

    def _resolved(self, rows: DataFrame, old: dict) -> DataFrame:
        """Version numbers and what deployments refer to, from the state before and the batch's own rows before."""
        known = self._state(old).select("scraper_id", F.col("max_version").alias("_max"))
        joined = rows.join(known, "scraper_id", "left")
        so_far = Window.partitionBy("scraper_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        newest = F.coalesce("_max", F.lit(0)) + F.count_if(F.col("kind") == "version").over(so_far)
        joined = joined.withColumn("_newest", newest.cast("int"))
        moves = F.col("kind").isin("deploy", "rollback")
        wanted = F.when(F.col("kind") == "version", F.col("_newest")).when(moves, F.coalesce("version", "_newest")).otherwise(F.col("version"))
        refused: Column = moves & ~F.coalesce(wanted.between(1, F.col("_newest")), F.lit(False))
        fields = [c.strip().split(" ")[0] for c in LOGGED.replace("array<string>", "array").split(",")]
        return joined.withColumns({"refused": F.coalesce(refused, F.lit(False)), "version": wanted}).select(*fields)

    def _compacted(self, held: dict) -> dict:
        gone = [t["path"] for t in held["tail"]]
        snapshot, tokens = (f"{self.root}/{kind}/{uuid.uuid4().hex}" for kind in ("snapshots", "tokens"))
        self._state(held).write.parquet(snapshot)
        names = self.spark.createDataFrame([(t["token"],) for t in held["tail"]], "token string")
        (names.unionByName(self.spark.read.parquet(held["tokens"])) if held["tokens"] else names).coalesce(1).sortWithinPartitions("token").write.parquet(tokens)
        segments = [*held["segments"], {"level": 0, "path": self._joined(gone)}]
        level = 0
        while len(own := [s["path"] for s in segments if s["level"] == level]) >= self.fan:
            segments = [s for s in segments if s["level"] != level] + [{"level": level + 1, "path": self._joined(own)}]
            gone += own
            level += 1
        gone += [p for p in (held["snapshot"], held["tokens"]) if p]
        return held | {"tail": [], "segments": segments, "snapshot": snapshot, "tokens": tokens, "gone": gone}

    def _joined(self, paths: list[str]) -> str:
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        # sorted by scraper, so that a history is read from few row groups
        self.spark.read.schema(LOGGED).parquet(*paths).repartitionByRange("scraper_id", "seq").sortWithinPartitions("scraper_id", "seq").write.parquet(path)
        return path

    # ---- reading

    def _state(self, held: dict) -> DataFrame:
        tail = _summed(self._rows([t["path"] for t in held["tail"]]))
        return _merged(self.spark.read.schema(STATE).parquet(held["snapshot"]).unionByName(tail)) if held["snapshot"] else tail

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(LOGGED).parquet(*paths) if paths else self.spark.createDataFrame([], LOGGED)

    def state(self) -> DataFrame:
        """One row per scraper: name, target_url, schema_fields, current_version (null: none deployed), health_score, status, max_version, n_runs."""
        rows = self._state(self.manifest())
        return rows.select(
            "scraper_id", "last_seq", "registered.name", "registered.target_url", "registered.schema_fields", F.col("current.version").alias("current_version"),
            F.coalesce("health.health_score", F.lit(0.0)).alias("health_score"), F.coalesce("health.status", F.lit("unknown")).alias("status"), F.coalesce("max_version", F.lit(0)).alias("max_version"), "n_runs",
        )

    def events(self, *kinds: str) -> DataFrame:
        """All events of the given kinds, with their sequence numbers."""
        held = self.manifest()
        rows = self._rows([s["path"] for s in held["segments"]] + [t["path"] for t in held["tail"]])
        return rows.where(F.col("kind").isin(*kinds)) if kinds else rows

    def strategies(self) -> DataFrame:
        """scraper_id, version, strategy and reason of all versions, with the sequence number from which they are valid."""
        return self.events("version").select("scraper_id", "version", "strategy", "reason", "confidence", "seq", "at")

    def active(self) -> DataFrame:
        """scraper_id, current_version, max_version and the strategy that is current."""
        current = self.state().where("current_version IS NOT NULL").select("scraper_id", "current_version", "max_version")
        own = self.strategies().select("scraper_id", F.col("version").alias("current_version"), "strategy")
        return current.join(own, ["scraper_id", "current_version"])
