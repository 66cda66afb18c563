"""Near copies beyond SimHash: texts within SimHash's radius, or with a similarity of 0.8 or more over 5-word shingles.

SimHash alone misses most texts that differ by a few words: one changed word in a text of 65 moves 5 bits or more. So candidates
also come from MinHash: ``BANDS`` keys of ``ROWS`` minima each, of which two texts of similarity j share one with probability
1 - (1 - j**ROWS)**BANDS, 0.99993 at 0.8 and more above. Every such candidate is verified by its exact Jaccard similarity.

Nodes are distinct shingle sets, so exact copies cost nothing. Bands often hold the same members; one bucket of each
member set is compared. Buckets are cut into chunks of so many sets, or shingles where sets are large, and each returns a star per local component.
Sets are computed again for members of buckets alone, so those of other texts are never written.

Chunks of one bucket don't all meet in pairs, as only links between classes count: first each chunk is compared within itself, then one set of each
class that its bucket holds with the largest class's (near copies mostly join here), and at last only the sets outside the largest class with
all others. Where a bucket is one group of near copies, however many, its work grows with its size.

Defined cases are those of SimHash: a text of fewer words than a shingle is one shingle; texts without words are copies of one
another; rows without a doc_id stay, and link others like any row; very long texts are read whole; an empty table gives no rows; other
columns, whatever their names, don't enter the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .simhash import components, fingerprint_of, first_of_class
from .simhash import links as simhash_links

SHINGLE = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
BANDS, ROWS = 24, 5
SEED = 43
#: Sets of a bucket, and shingles in them, that one task compares at a time, about; a larger set is compared alone.
CHUNK, SHINGLES = 1024, 1 << 21
_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None]
_TIMES = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles, never empty."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    parts = map(b" ".join, zip(*(found[k:] for k in range(SHINGLE)))) if len(found) >= SHINGLE else iter([b" ".join(found)])
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), np.uint64))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), seed=SEED) - (1 << 63)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        least = np.minimum(least, ((shingles[None, k : k + 4096] ^ _XOR) * _TIMES).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), seed=b) for b, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingle_set(t) for t in pdf["text"]]
        prints = np.array([fingerprint_of(t) for t in pdf["text"]], np.int64)
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": prints, "node": np.array([node_of(x) for x in sets], np.int64), "size": [len(x) for x in sets], "keys": [band_keys(x) for x in sets]})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingle_set(t) for t in pdf["text"]]
        yield pd.DataFrame({"node": np.array([node_of(x) for x in sets], np.int64), "shingles": [x.view(np.int64) for x in sets]})


def local_stars(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members and the first node of their component of similar sets, for each member that is not it. A set is compared only with those whose size
    lets them be similar."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    nodes, sets = nodes[order], [sets[k] for k in order]
    sizes = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    held = np.zeros(int(flat.max()) + 1, np.int64)
    free = np.ones(len(sets), bool)
    members, roots = [], []
    for k in range(len(sets)):
        if not free[k]:
            continue
        free[k], edge, own = False, [k], [k]
        while edge and free.any():
            i = edge.pop()
            lo = int(np.searchsorted(sizes, -(-OVER * sizes[i] // UNDER)))
            hi = int(np.searchsorted(sizes, UNDER * sizes[i] // OVER, "right"))
            if not free[lo:hi].any():
                continue
            mine = flat[starts[i] : starts[i + 1]]
            held[mine] = 1
            common = np.add.reduceat(held[flat[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo])
            held[mine] = 0
            near = lo + np.flatnonzero(free[lo:hi] & ((OVER + UNDER) * common >= OVER * (sizes[lo:hi] + sizes[i])))
            free[near] = False
            edge += near.tolist()
            own += near.tolist()
        if len(own) > 1:
            mine = nodes[own]
            root = mine.min()
            members += mine[mine != root].tolist()
            roots += [root] * (len(own) - 1)
    return np.array(members, np.int64), np.array(roots, np.int64)


def _bucket_links(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("node").sort_values("node")
    members, roots = local_stars(pdf["node"].to_numpy(np.int64), list(pdf["shingles"]))
    return pd.DataFrame({"u": members, "v": roots})


def _compared(rows: DataFrame, sets: DataFrame, *group: str) -> DataFrame:
    """u, v: stars of the similar sets among the nodes of each group."""
    return rows.select(*group, "node").join(sets, "node").groupBy(*group).applyInPandas(_bucket_links, "u long, v long").distinct()


def _classed(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with root, the class of their node so far."""
    return rows.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _chunk(rows: DataFrame, of: Column, chunks: Column) -> DataFrame:
    return rows.withColumn("c", F.pmod(F.xxhash64(of), chunks).cast("int"))


def across(rows: DataFrame, sets: DataFrame, edges: DataFrame) -> DataFrame:
    """u, v: edges that join what links between chunks join. rows: key, node, size, chunks and c of buckets of several chunks; edges: those known."""
    classed = stored(_classed(rows, edges))
    reps = classed.groupBy("key", "root").agg(F.min("node").alias("node"), F.count("*").alias("n"), F.max("size").alias("size"))
    large = reps.groupBy("key").agg(F.max_by("node", "n").alias("first"), F.count("*").alias("classes"), F.max("size").alias("most"))
    several = reps.join(large.where("classes > 1"), "key")
    parts = F.ceil(F.greatest(F.col("classes") / CHUNK, F.col("classes") * F.col("most") / SHINGLES)).cast("int")
    several = _chunk(several, F.col("node"), parts)
    leaders = several.select("key", "c", F.col("first").alias("node")).distinct()  # one for each part
    found = stored(_compared(several.select("key", "c", "node").unionAll(leaders), sets, "key", "c"))
    edges = stored(edges.unionAll(found))
    classed = stored(_classed(rows, edges))
    per = classed.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = per.groupBy("key").agg(F.max_by("root", "n").alias("largest"), F.count("*").alias("classes")).where("classes > 1")
    left = classed.join(most.select("key", "largest"), "key")
    rest = left.where("root <> largest").select("key", "node", F.col("c").alias("r"))
    parts = left.select("key", "c").distinct().join(rest.select("key", "r").distinct(), "key")  # chunks, not sets
    both = parts.join(rest, ["key", "r"]).select("key", "r", "c", "node").unionAll(parts.join(left.select("key", "c", "node"), ["key", "c"]).select("key", "r", "c", "node"))
    return found.unionAll(_compared(both, sets, "key", "r", "c"))


def links(docs: DataFrame, nodes: DataFrame, known: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """u, v: edges that, with those known, connect the nodes (columns node, first, size and keys) which verified candidates connect."""
    rows = nodes.select("node", "size", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum("size").alias("all"), F.bit_xor(F.xxhash64("node")).alias("x")).where("m > 1")
    once = sizes.groupBy("m", "x").agg(F.min("key").alias("key"), F.min("all").alias("all")).select("key", "m", "all")
    rows = rows.join(once, "key").withColumn("chunks", F.ceil(F.greatest(F.col("m") / CHUNK, F.col("all") / SHINGLES)).cast("int"))
    rows = stored(_chunk(rows, F.col("node"), F.col("chunks")).select("key", "node", "size", "chunks", "c"))
    wanted = nodes.join(rows.select("node").distinct(), "node", "left_semi")
    own = _own(docs, id_col, text_col)
    texts = own.join(wanted.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").unionAll(own.where("doc_id IS NULL"))
    sets = stored(texts.mapInPandas(_sets, "node long, shingles array<long>").dropDuplicates(["node"]))
    edges = stored(_compared(rows, sets, "key", "c"))
    several = rows.where("chunks > 1")
    if several.isEmpty():
        return edges
    return edges.unionAll(across(several, sets, edges if known is None else edges.unionAll(known)))


def near_copy_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id, the smallest doc_id of its class, for each row of docs."""
    rows = stored(_own(docs, id_col, text_col).mapInPandas(_sketches, "doc_id long, fp long, node long, size int, keys array<long>"))
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    prints = stored(rows.select("fp").distinct())
    close = stored(components(simhash_links(prints, prints.count())))
    pairs = rows.select("fp", "node").distinct().join(close.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "node")
    lowest = pairs.groupBy("root").agg(F.min("node").alias("v"))
    edges = stored(pairs.join(lowest, "root").where("node <> v").select(F.col("node").alias("u"), "v"))
    roots = components(edges.unionAll(links(docs, nodes, edges, id_col=id_col, text_col=text_col)))
    rooted = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "node").join(rooted.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def one_per_class(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their class, one of rows that repeat it with its text; rows without a doc_id stay."""
    classes = stored(near_copy_classes(docs, id_col=id_col, text_col=text_col))
    return first_of_class(docs, classes, id_col=id_col, text_col=text_col)
