"""An index of the keys that a growing ledger holds: sorted key files by hash bucket, with a Bloom filter for each bucket and part.

A ledger is a folder with one entry (a folder or file of Parquet) per write. Each part of the index covers entries of it by name, so a ledger
that was written otherwise, or a write whose part is missing, is found by comparing names and indexed before anything is looked up.
A lookup asks the filters first; what no filter knows is new, and the rest is joined with the key files of the buckets that
filters named alone (their row groups are sorted by bucket, so the others aren't read).

A bucket's filter takes about 1.5 bytes a key in one task; the number of buckets is a parameter. Parts are merged once there are ``PARTS``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import kept
from ..sources.store import Store

BUCKETS = 256
BITS, PROBES = 12, 8
PARTS = 64

_FILTER = "bucket int, part string, n long, bits binary"


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each hash in a filter of so many bits, by double hashing."""
    h = hashes.view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(size)).astype(np.int64)


def _filter(table: pa.Table) -> pa.Table:
    """The filter of one bucket's keys in a part."""
    h = table.column("h").to_numpy()
    size = max(64, BITS * len(h))
    bits = np.zeros(-(-size // 8) * 8, bool)
    for k in range(0, len(h), 1 << 20):
        bits[_places(h[k : k + (1 << 20)], size).ravel()] = True
    first = table.slice(0, 1)
    return pa.table({"bucket": first.column("bucket"), "part": first.column("part"), "n": pa.array([len(h)], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _perhaps(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The keys that a filter of their bucket may know."""
    h = keys.column("h").to_numpy()
    hit = np.zeros(len(h), bool)
    for n, packed in zip(filters.column("n").to_pylist(), filters.column("bits").to_pylist(), strict=True):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        for k in range(0, len(h), 1 << 20):
            hit[k : k + (1 << 20)] |= bits[_places(h[k : k + (1 << 20)], max(64, BITS * n))].all(axis=1)
    return keys.filter(pa.array(hit)).select(["key", "bucket"])


class KeyIndex:
    """The index of one ledger, in its hidden folder ``_keys``; key is a text column, or what ``sign`` makes of rows where it is null or missing."""

    def __init__(self, spark: SparkSession, ledger: str, key: str = "signature", *, sign: Column | None = None, buckets: int = BUCKETS):
        self.spark, self.ledger, self.key, self.sign, self.buckets = spark, ledger.rstrip("/"), key, sign, buckets
        self.home = f"{self.ledger}/_keys"
        self.store = Store(spark, self.ledger)

    def _parts(self) -> list[str]:
        return self.store.names(f"{self.home}/entries")

    def covered(self) -> set[str]:
        """The names of the ledger's entries whose keys the index holds."""
        return {n for p in self._parts() for n in (self.store.read(f"{self.home}/entries/{p}") or "").split("\n") if n}

    def _keys(self, names: list[str]) -> DataFrame:
        rows = self.spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(*[f"{self.ledger}/{n}" for n in names])
        own = rows[self.key].cast("string") if self.key in rows.columns else F.lit(None).cast("string")
        return rows.select(F.coalesce(own, self.sign if self.sign is not None else F.lit(None)).alias("key"))

    def _write(self, keys: DataFrame, part: str, names: list[str]) -> None:
        """A part: key files, then filters, then the names it covers, which make it count."""
        h = F.xxhash64("key")
        keys = keys.where("key IS NOT NULL").distinct().select("key", F.pmod(h, F.lit(self.buckets)).cast("int").alias("bucket"), h.alias("h"))
        keys.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.mode("overwrite").parquet(f"{self.home}/keys/{part}")
        stored = self.spark.read.parquet(f"{self.home}/keys/{part}").select("bucket", "h", F.lit(part).alias("part"))
        stored.groupBy("bucket").applyInArrow(_filter, _FILTER).write.mode("overwrite").parquet(f"{self.home}/filters/{part}")
        self.store.write(f"{self.home}/entries/{part}", "\n".join(names))

    def catch_up(self, without: str | None = None) -> list[str]:
        """Indexes the ledger's entries that no part covers, and returns their names."""
        names = [n for n in self.store.names(self.ledger) if n != without and n not in self.covered()]
        if names:
            self._write(self._keys(names), uuid.uuid4().hex, names)
        if len(self._parts()) > PARTS:
            self.merge()
        return names

    def merge(self) -> None:
        """One part in place of all. A break leaves both, which hold the same keys."""
        old, names = self._parts(), sorted(self.covered())
        self._write(self.spark.read.parquet(*[f"{self.home}/keys/{p}" for p in old]).select("key"), uuid.uuid4().hex, names)
        for p in old:
            for kind in ("entries", "filters", "keys"):
                self.store.delete(f"{self.home}/{kind}/{p}")

    def known(self, keys: DataFrame) -> DataFrame:
        """The keys (column key) of those given that the index holds."""
        parts = self._parts()
        none = keys.select(F.col("key")).limit(0)
        if not parts:
            return none
        h = F.xxhash64("key")
        keyed = keys.select("key", F.pmod(h, F.lit(self.buckets)).cast("int").alias("bucket"), h.alias("h"))
        filters = self.spark.read.schema(_FILTER).parquet(*[f"{self.home}/filters/{p}" for p in parts])
        perhaps = kept(keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_perhaps, "key string, bucket int"))
        touched = [r["bucket"] for r in perhaps.select("bucket").distinct().collect()]  # as many as there are buckets, at most
        if not touched:
            return none
        held = self.spark.read.parquet(*[f"{self.home}/keys/{p}" for p in parts]).where(F.col("bucket").isin(touched)).select("bucket", "key")
        return perhaps.join(held, ["bucket", "key"], "left_semi").select("key")


def append_fresh(rows: DataFrame, index: KeyIndex, entry: str) -> None:
    """Writes the rows whose key the ledger doesn't hold, one of each key, as the entry of that name, which replaces what a broken try left. An entry
    that the index covers was complete, so a second try leaves it."""
    if entry in index.covered():
        return
    index.catch_up(without=entry)
    if index.sign is not None:
        rows = rows.withColumn(index.key, F.coalesce(F.col(index.key), index.sign))
    named = rows.withColumn("__key", F.col(index.key).cast("string"))
    known = index.known(named.select(F.col("__key").alias("key")).where("key IS NOT NULL").distinct()).withColumnRenamed("key", "__key")
    fresh = named.join(known, "__key", "left_anti")
    # rows without a key can't be told apart, and all stay
    one = fresh.where("__key IS NOT NULL").dropDuplicates(["__key"]).unionByName(fresh.where("__key IS NULL")).select(*rows.columns)
    one.write.mode("overwrite").parquet(f"{index.ledger}/{entry}")
    index.catch_up()


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All rows of a ledger, whatever wrote them."""
    return spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(ledger)
