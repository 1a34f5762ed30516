"""Vector store in a shared folder: additions and changes as delta files, snapshots by manifest.

    <path>/data/<id>/            Parquet, never changed after it is written
    <path>/manifests/<version>   the data folders of a snapshot, one per line

A manifest is created whole and exclusively after its data is written, so readers see one
snapshot while a write is under way and of two concurrent writers one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the store beside the user's: hash of the embedded text, version of the row, whether it was taken out.
CONTENT, VERSION, REMOVED = "__content", "__version", "__removed"


class Conflict(RuntimeError):
    """Another writer has made this version."""


class VectorStore:
    """Rows (keys, text, ..., embedding), one per key; text may be null (embedded as empty)."""

    def __init__(self, spark: SparkSession, path: str, keys=("doc_id", "chunk_no"), text: str = "text", embedding: str = "embedding"):
        self.spark, self.path, self.keys, self.text, self.embedding = spark, path.rstrip("/"), list(keys), text, embedding

    # ------------------------------------------------------------ manifests
    def _at(self, name: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._at("manifests")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []

    def folders(self, version: int) -> list[str]:
        text = self.spark.read.text(f"{self.path}/manifests/{version:08d}", wholetext=True).first()
        return [x for x in text[0].split("\n") if x] if text else []

    def _publish(self, version: int, folders: list[str]) -> int:
        fs, at = self._at(f"manifests/{version:08d}")
        data = bytearray("\n".join(folders).encode())
        try:
            out = fs.create(at, False)  # fails if it exists
        except Exception as e:
            if fs.exists(at):
                raise Conflict(f"version {version} exists") from e
            raise
        out.write(data)
        out.close()
        return version

    # ------------------------------------------------------------- reading
    def snapshot(self, version: int | None = None) -> DataFrame | None:
        """Rows of a version (the latest by default), with the version each was written in; None for an empty store.

        After a compaction there is one folder and nothing to merge; else the latest row of each key is taken.
        """
        known = self.versions()
        if not known:
            return None
        folders = self.folders(known[-1] if version is None else version)
        rows = self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in folders])
        if len(folders) > 1:
            last = rows.groupBy(*self.keys).agg(F.max(VERSION).alias("__last"))
            same = [rows[k].eqNullSafe(last[k]) for k in self.keys]
            rows = rows.join(last, [*same, rows[VERSION] == last["__last"]], "left_semi")
        return rows.where(~F.col(REMOVED)).drop(REMOVED)

    # ------------------------------------------------------------- writing
    def upsert(self, rows: DataFrame, embed: Callable[[DataFrame], DataFrame], remove_missing: bool = False) -> dict:
        """Adds rows that are new or whose columns changed; embed(rows) adds the embedding and sees only rows whose text is new.

        Of several rows of one key the one of least content stays.  remove_missing also takes out keys that
        rows lack.  Without a change no version is made.  Returns {version, embedded, moved, removed}.
        """
        cols = rows.columns
        content = F.sha2(F.coalesce(F.col(self.text), F.lit("")).cast("binary"), 256)
        state = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).cast("binary"), 256)
        src = rows.withColumn(CONTENT, content).withColumn("__state", state)
        src = src.groupBy(*self.keys).agg(F.min_by(F.struct(*[c for c in src.columns if c not in self.keys]), "__state").alias("r")).select(*self.keys, "r.*")
        old = self.snapshot()
        version = (self.versions() or [0])[-1] + 1
        folder = uuid.uuid4().hex
        if old is None:
            new, moved, gone = src, None, None
        else:
            held = old.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)], F.col(CONTENT).alias("__had"), F.col(self.embedding).alias("__vector"),
                              F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).cast("binary"), 256).alias("__was"))
            same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)]
            both = src.join(held, same, "left").where(F.col("__was").isNull() | (F.col("__was") != F.col("__state")))
            new = both.where(F.col("__had").isNull() | (F.col("__had") != F.col(CONTENT))).select(*cols, CONTENT)
            # other columns changed: the vector stays
            moved = both.where(F.col("__had") == F.col(CONTENT)).select(*cols, F.col("__vector").alias(self.embedding), CONTENT)
            gone = old.join(src.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)]), same, "left_anti") if remove_missing else None
        out = embed(new.select(*cols, CONTENT)).select(*cols, self.embedding, CONTENT).withColumn("__kind", F.lit("embedded"))
        if moved is not None:
            out = out.unionByName(moved.withColumn("__kind", F.lit("moved")))
        if gone is not None:
            out = out.unionByName(gone.select(*cols, self.embedding, CONTENT).withColumn("__kind", F.lit("removed")))
        at = f"{self.path}/data/{folder}"
        out.withColumn(VERSION, F.lit(version).cast("long")).withColumn(REMOVED, F.col("__kind") == "removed").write.parquet(at)
        done = {r["__kind"]: r["n"] for r in self.spark.read.parquet(at).groupBy("__kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts = {k: done.get(k, 0) for k in ("embedded", "moved", "removed")}
        if not sum(counts.values()) and old is not None:
            return {"version": version - 1, **counts}
        before = [] if old is None else self.folders(version - 1)
        return {"version": self._publish(version, [*before, folder]), **counts}

    def compact(self) -> int:
        """The latest snapshot in one folder, as a new version; older versions stay readable."""
        rows, known, folder = self.snapshot(), self.versions(), uuid.uuid4().hex
        if rows is None or len(self.folders(known[-1])) == 1:
            return known[-1] if known else 0
        rows.withColumn(REMOVED, F.lit(False)).write.parquet(f"{self.path}/data/{folder}")
        return self._publish(known[-1] + 1, [folder])
