"""SimHash near-duplicates: 64-bit fingerprints, links within a few bits, and the classes that links connect.

A fingerprint takes the XXH64 (seed 42) of each 3-word shingle of the text with A-Z lower-cased; a bit is 1 if set in
over half of the hashes. Two fingerprints within ``radius`` bits agree on at least ``b - radius`` of b blocks of bits, so
every choice of that many blocks (or any subset of their bits) gives a bucket key, and each link falls into a common
bucket of at least one table. Buckets hold distinct fingerprints only; one that is still large is cut into chunks, and
each pair of chunks becomes a task of its own, so that neither a group of copies nor of near copies meets in one task.

A bucket is compared bit-sliced: plane i holds bit i of all its fingerprints, 64 to a word. XOR with a query's bit gives
the lanes that differ; carry-save counters of two bits plus an overflow add one plane to all 64 distances at
a time, and a word whose lanes have all overflowed is abandoned. A bucket returns a star per local component, not pairs.
Stars are joined by alternating large-star and small-star rounds on tables written to the shared folder.

Defined cases: null and blank texts have fingerprint zero, linked like any other; repeated rows get equal results; a row
with a null doc_id has a class, whose id is the smallest doc_id that is not null (null if there is none). Very long texts are read
whole, their hashes some at a time; an empty table gives no rows; other columns, whatever their names, don't enter the classes. Ids
are cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Mean size of a bucket that the number of key bits aims at; any number gives the same links.
BUCKET = 1024
#: Fingerprints of a bucket that one task compares with as many others.
CHUNK = 4096
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint, as a signed 64-bit integer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII blanks alone
    if not found:
        return 0
    parts = map(b" ".join, zip(*(found[k:] for k in range(shingle)))) if len(found) >= shingle else iter([b" ".join(found)])
    n = max(1, len(found) - shingle + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), parts), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 14):
        counts += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp of each row of docs."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": np.array([fingerprint_of(t) for t in pdf["text"]], np.int64)})

    # a plan node of its own: Spark can't run a Python function over a column that a lambda computes in the same projection
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return own.mapInPandas(rows, "doc_id long, fp long")


def masks(n: int, radius: int = RADIUS, bucket: int = BUCKET) -> list[int]:
    """Bit masks, one per table, such that any two fingerprints within radius agree under one of them at least.

    More fingerprints take longer keys, from more blocks, so that buckets keep their mean size."""
    wanted = max(0, int(np.log2(max(1, n / bucket))))
    blocks = next((b for b in range(radius + 1, radius + 4) if BITS * (b - radius) // b >= wanted), radius + 3)
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        bits = [i for b in chosen for i in range(cuts[b], cuts[b + 1])][:wanted]
        out.append(sum(1 << i for i in bits))
    return list(dict.fromkeys(out))  # few fingerprints take no key bits, and one table


def _planes(prints: np.ndarray) -> np.ndarray:
    """Plane i, word w: bit i of fingerprints 64 w to 64 w + 63."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((-(-len(prints) // 64) * 64, BITS), np.uint8)
    lanes[: len(prints)] = bits
    return np.packbits(np.ascontiguousarray(lanes.T), axis=1, bitorder="little").view(np.uint64)


def close_lanes(queries: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each query a row of words, with the bits of the prints within radius (3 at most) set."""
    if radius > 3:
        raise ValueError("the counters hold distances to 3")
    planes, width = _planes(prints), -(-len(prints) // 64)
    out = np.zeros((len(queries), width), np.uint64)
    lanes = np.full(width, _ALL)
    if len(prints) % 64:
        lanes[-1] = np.uint64((1 << (len(prints) % 64)) - 1)
    for start in range(0, len(queries), 256):
        q = queries[start : start + 256]
        row, word = (x.ravel() for x in np.indices((len(q), width)))
        ones, twos, over = (np.zeros(len(row), np.uint64) for _ in range(3))
        for i in range(BITS):
            bit = (np.uint64(0) - ((q >> np.uint64(i)) & np.uint64(1)))[row]
            differ = planes[i][word] ^ bit
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if i % 8 == 7:
                live = (over | ~lanes[word]) != _ALL
                if not live.all():
                    row, word, ones, twos, over = (x[live] for x in (row, word, ones, twos, over))
                    if not len(row):
                        break
        if len(row):
            far = over
            if radius < 3:
                far = far | (twos & ones)
            if radius < 2:
                far = far | twos
            if radius < 1:
                far = far | ones
            out[start + row, word] = ~far & lanes[word]
    return out


def local_stars(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Members and the smallest fingerprint of their component, for each member that is not it; prints are distinct."""
    prints = np.sort(prints)
    near = close_lanes(prints.view(np.uint64), prints.view(np.uint64), radius)
    bits = lambda words: np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
    seen = np.zeros(near.shape[1], np.uint64)
    one = lambda k: (k >> 6, np.uint64(1) << np.uint64(k & 63))
    linked = np.flatnonzero(np.bitwise_count(near).sum(axis=1) > 1)
    members, roots = [], []
    for k in linked:
        w, b = one(int(k))
        if seen[w] & b:
            continue
        found, edge = near[k].copy(), bits(near[k])
        while len(edge):
            more = np.bitwise_or.reduce(near[edge], axis=0) & ~found
            found |= more
            edge = bits(more)
        seen |= found
        own = bits(found)
        members.append(prints[own[1:]])
        roots.append(np.full(len(own) - 1, prints[own[0]]))
    if not members:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(members), np.concatenate(roots)


def _bucket_links(pdf: pd.DataFrame) -> pd.DataFrame:
    members, roots = local_stars(pdf["fp"].to_numpy(np.int64).copy())
    return pd.DataFrame({"u": members, "v": roots})


def links(prints: DataFrame, n: int, *, radius: int = RADIUS) -> DataFrame:
    """u, v: edges that connect exactly the distinct fingerprints (column fp) which links within radius connect."""
    keyed = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long")).alias("key")) for t, m in enumerate(masks(n, radius))])
    rows = prints.select("fp", F.explode(keyed).alias("k")).select("fp", "k.t", "k.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("m")).where("m > 1")
    rows = rows.join(sizes, ["t", "key"])
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    rows = rows.select("t", "key", "fp", chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("c"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("t", "key", F.least("c", "other").alias("lo"), F.greatest("c", "other").alias("hi"), "fp")
    return rows.groupBy("t", "key", "lo", "hi").applyInPandas(_bucket_links, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for each node of an edge (u, v) that is not the root itself."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.join(low, "u")
        if large:
            out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        return stored(out.where("u <> v").distinct())

    def shape(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = stored(edges.where("u <> v"))
    was = None
    while (now := shape(edges)) != was:
        was = now
        edges = star(star(edges, True), False)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (fingerprint as a signed long) and component_id for each row of docs."""
    rows = stored(fingerprints(docs, id_col=id_col, text_col=text_col))
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(prints.select("fp"), prints.count(), radius=radius))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def first_of_class(docs: DataFrame, classes: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id is the component_id of classes (doc_id, component_id), or null; of rows that repeat id and text one."""
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    left = docs.join(gone, id_col, "left_anti")
    again = classes.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(id_col))
    if again.isEmpty():  # as a rule; texts need no shuffle then
        return left
    return left.join(again, id_col, "left_anti").unionByName(left.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col]))


def one_per_class(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their class, one of rows that repeat it with its text; rows without a doc_id stay."""
    classes = stored(simhash_classes(docs, id_col=id_col, text_col=text_col, radius=radius))
    return first_of_class(docs, classes, id_col=id_col, text_col=text_col)
