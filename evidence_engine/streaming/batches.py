"""Batches that go on where they stopped: records of a batch of files are appended once, then its files move to an archive.

A batch's journal holds a row per file (source, digest, destination), and states as empty files. A state moves on by renaming its file, which
only one caller can do and which can't be done from another state: prepared, records_appended, files_moving, complete. Each file of the
batch has a state of its own in the same way, open or moved, so that a try which stopped between a move and its note is told from one that
stopped before. Digests are taken by Spark; renames, one per file of a batch, by the driver. Records carry the batch's id and their number
in ``batch_id`` and ``batch_row``; row 0 is the batch's marker, which must stand in the ledger once before its files may move.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store

PREPARED, APPENDED, MOVING, COMPLETE = STATES = ("prepared", "records_appended", "files_moving", "complete")
_ID = re.compile(r"[0-9A-Za-z._-]+")
_FILES = "number long, source string, sha256 string, destination string"


class BatchError(Exception):
    """A batch can't take the step that was asked for."""


def _digests(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """SHA-256 of files, by the path that the store gives them."""
    d = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("sha256"))
    return {r["path"]: r["sha256"] for r in d.collect()}


def _plain(path: str) -> str:
    return re.sub("^file:/+", "/", path)


class Batch:
    """A batch of files below ``inbox``, whose journal lies in a folder named by its id, and whose files end below ``archive``."""

    def __init__(self, spark: SparkSession, journal: str, batch_id: str, *, inbox: str, archive: str, ledger: str):
        if not _ID.fullmatch(batch_id) or set(batch_id) == {"."}:
            raise BatchError(f"not a batch's id: {batch_id}")
        self.spark, self.id, self.ledger = spark, batch_id, ledger.rstrip("/")
        self.home, self.inbox, self.archive = f"{journal.rstrip('/')}/{batch_id}", inbox.rstrip("/"), archive.rstrip("/")
        self.store = Store(spark, journal)

    def state(self) -> str | None:
        names = self.store.names(f"{self.home}/state")
        return names[0] if names else None

    def _advance(self, to: str, *froms: str) -> None:
        """Compare and set: another caller who was first makes the rename fail."""
        now = self.state()
        if now == to:
            return
        if now not in froms or not self.store.move(f"{self.home}/state/{now}", f"{self.home}/state/{to}"):
            raise BatchError(f"batch {self.id} is {self.state()}, not {' or '.join(froms)}")

    def files(self) -> list:
        return sorted(self.spark.read.schema(_FILES).parquet(f"{self.home}/files").collect())

    def _held(self, number: int) -> str:
        return f"{self.home}/moves/{number}"

    def moved(self, number: int) -> bool:
        return self.store.exists(f"{self._held(number)}.moved")

    def prepare(self, sources: list[str]) -> None:
        """Notes the files and their digests. A batch that is there already is resumed, not made again."""
        if self.state() is not None:
            raise BatchError(f"batch {self.id} is there; resume it")
        if not sources:
            raise BatchError("a batch takes one file at least")
        for s in sources:
            if not s.startswith(self.inbox + "/") or "/../" in s or not self.store.exists(s):
                raise BatchError(f"no file of the inbox: {s}")
        hashes = _digests(self.spark, sources)
        rows = [(k, s, hashes[_plain(s)], f"{self.archive}/{self.id}/{s[len(self.inbox) + 1 :]}") for k, s in enumerate(sorted(set(sources)))]
        self.spark.createDataFrame(rows, _FILES).coalesce(1).write.mode("overwrite").parquet(f"{self.home}/files")
        for k, *_ in rows:
            self.store.write(f"{self._held(k)}.open", "")
        self.store.write(f"{self.home}/state/{PREPARED}", "")

    def marker_count(self) -> int:
        """How often the ledger holds the batch's marker."""
        if not self.store.names(self.ledger):
            return 0
        rows = self.spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(self.ledger)
        if "batch_row" not in rows.columns:
            return 0
        return rows.where((F.col("batch_id") == self.id) & (F.col("batch_row") == 0)).count()

    def append(self, rows: DataFrame) -> None:
        """Appends the records, unless the ledger holds them. rows is numbered in its own order (monotonically increasing, 0 first)."""
        if self.state() != PREPARED:
            raise BatchError(f"records can't be appended to a batch that is {self.state()}")
        if self.marker_count() == 0:
            marker = self.spark.range(1).select(F.lit(self.id).alias("batch_id"), F.lit(0).cast("long").alias("batch_row"))
            numbered = rows.select(F.lit(self.id).alias("batch_id"), (F.monotonically_increasing_id() + 1).alias("batch_row"), *rows.columns)
            numbered.unionByName(marker, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.ledger}/batch={self.id}")
        self.mark_appended()

    def mark_appended(self) -> None:
        if (n := self.marker_count()) != 1:
            raise BatchError(f"the ledger holds the marker of batch {self.id} {n} times")
        self._advance(APPENDED, PREPARED)

    def move(self, number: int) -> None:
        """Moves one file to the archive and notes it; what a broken try has moved is only noted."""
        if self.state() not in (APPENDED, MOVING):
            raise BatchError(f"files of a batch that is {self.state()} can't move")
        if self.moved(number):
            return
        row = next((r for r in self.files() if r["number"] == number), None)
        if row is None:
            raise BatchError(f"no file {number} in batch {self.id}")
        self._advance(MOVING, APPENDED)
        if self.store.exists(row["source"]):
            if not self.store.move(row["source"], row["destination"]):
                raise BatchError(f"{row['source']} can't move to {row['destination']}")
        if not self.store.exists(row["destination"]):
            raise BatchError(f"{row['source']} is gone and isn't in the archive")
        if _digests(self.spark, [row["destination"]])[_plain(row["destination"])] != row["sha256"]:
            raise BatchError(f"{row['destination']} has another digest than its source had")
        self.store.move(f"{self._held(number)}.open", f"{self._held(number)}.moved")

    def issues(self) -> list[str]:
        """What keeps the batch from being complete; digests of all its files in one Spark job."""
        out = [] if (n := self.marker_count()) == 1 else [f"marker {n} times"]
        files = self.files()
        there = [r for r in files if self.store.exists(r["destination"])]
        now = _digests(self.spark, [r["destination"] for r in there]) if there else {}
        for r in files:
            if not self.moved(r["number"]):
                out.append(f"{r['number']} not moved")
            elif self.store.exists(r["source"]) or _plain(r["destination"]) not in now:
                out.append(f"{r['number']} not where the journal has it")
            elif now[_plain(r["destination"])] != r["sha256"]:
                out.append(f"{r['number']} changed")
        return out

    def finalize(self) -> None:
        if found := self.issues():
            raise BatchError("; ".join(found))
        self._advance(COMPLETE, MOVING)

    def verify(self) -> None:
        """Raises unless the batch is complete and all of it still holds."""
        if self.state() != COMPLETE:
            raise BatchError(f"batch {self.id} is {self.state()}")
        if found := self.issues():
            raise BatchError("; ".join(found))

    def run(self, sources: list[str], read) -> str:
        """Takes the batch from wherever it is to its end: ``appended`` if it was new, ``resumed`` or ``skipped`` if not. read(paths): its records."""
        was = self.state()
        if was is None:
            self.prepare(sources)
        if self.state() == PREPARED:
            self.append(read([r["source"] for r in self.files()]))
        if self.state() in (APPENDED, MOVING):
            for r in self.files():
                self.move(r["number"])
            self.finalize()
        self.verify()
        return "appended" if was is None else "skipped" if was == COMPLETE else "resumed"
