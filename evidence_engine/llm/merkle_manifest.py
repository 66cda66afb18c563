"""A Merkle manifest of a dataset: one hash tree per group, one over the groups' roots, and a proof for each row.

Leaves of a group are numbered in order, and every 8 consecutive nodes become the SHA-256 of their digests (hexadecimal text) until one
remains, the subroot; the subroots of all groups give the root in the same way. Leaf numbers come from a range partition: rows count
within their partition, and the partitions' sizes before it are added. Then 4096 consecutive nodes, four levels of the tree, are one
task's group, however many rows the dataset has, and the next four levels take the 1/4096 that are left.

A parent keeps a copy of its hash state before each child slot (midstates). Folding a leaf up the tree resumes the state that stands before
its slot and adds only the replacement and the siblings to its right; what is left of it is never hashed again. Blocks hold the states of their own
levels; of the levels above, all leaves of a block share one path, whose states are built once per block.

Defined cases: a null field is ``-`` in a leaf, an empty one is not null; a null group is one group and comes first; rows with a null
id come first in their group, and rows that share an id are ordered by their leaf, so repeated rows have leaves of their own; long texts are hashed by
Spark; an empty table gives no rows; a group of one row has its leaf as its subroot; other columns, whatever their names, don't enter.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

FAN = 8
#: Levels that a task builds at once, over FAN**DEEP nodes; any number gives the same tree.
DEEP = 4

_PATH = "array<struct<left: array<string>, right: array<string>>>"
_LEVEL = pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields in order: ``-`` for a null, else the bytes' count, a colon and the value."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def height(n: int) -> int:
    """Levels above n nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


class Tree:
    """Some levels over consecutive nodes: digests (as bytes of hexadecimal text), and the hash states before each child slot."""

    def __init__(self, nodes: list[bytes], levels: int):
        self.levels, self.states = [nodes], []
        for _ in range(levels):
            below, up, states = self.levels[-1], [], []
            for k in range(0, len(below), FAN):
                state = hashlib.sha256()
                for x in below[k : k + FAN]:
                    states.append(state.copy())
                    state.update(x)
                up.append(state.hexdigest().encode())
            self.levels.append(up)
            self.states.append(states)
        self.lefts = [[b"".join(row[k - k % FAN : k]) for k in range(len(row))] for row in self.levels[:levels]]
        self.rights = [[b"".join(row[k + 1 : k - k % FAN + FAN]) for k in range(len(row))] for row in self.levels[:levels]]

    def fold(self, k: int, value: bytes) -> bytes:
        """The top digest with node k replaced."""
        for states, rights in zip(self.states, self.rights, strict=True):
            state = states[k].copy()
            state.update(value)
            state.update(rights[k])
            value, k = state.hexdigest().encode(), k // FAN
        return value

    def siblings(self, k: int) -> list[tuple[bytes, bytes]]:
        out = []
        for lefts, rights in zip(self.lefts, self.rights, strict=True):
            out.append((lefts[k], rights[k]))
            k //= FAN
        return out


class Path:
    """The levels above a block, as (left, right) siblings: the state before the slot of each level is built once, and resumed for each leaf."""

    def __init__(self, levels: list[tuple[bytes, bytes]]):
        self.states = [(hashlib.sha256(left), right) for left, right in levels]
        self.told = b"".join(left + right for left, right in levels)

    def fold(self, value: bytes) -> bytes:
        for before, right in self.states:
            state = before.copy()
            state.update(value)
            state.update(right)
            value = state.hexdigest().encode()
        return value


def _apart(b: bytes) -> list[str]:
    return [b[k : k + 64].decode() for k in range(0, len(b), 64)]


def _joined(levels: list[dict]) -> list[tuple[bytes, bytes]]:
    return [("".join(x["left"]).encode(), "".join(x["right"]).encode()) for x in levels]


def ranked(df: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """df with n (rows of its group) and at (its place there, by order), and the table of groups with their n."""
    placed = stored(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    runs = placed.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # as many rows as there are partitions and groups: a partition holds a stretch of the order
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select("*", before.alias("__before"), F.sum("__n").over(W.partitionBy(*group)).alias("n")))
    groups = runs.select(*group, "n").distinct()
    own = runs.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__{g}") for g in group], "__first", "__before", "n")
    on = F.col("__part") == F.col("__p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return placed.join(own, on).select(*df.columns, "n", (F.col("__before") + F.col("__at") - F.col("__first")).alias("at")), groups


def _blocks(nodes: DataFrame, deep: int):
    return nodes.groupBy("g", F.floor(F.col("at") / FAN**deep).alias("block"))


def _tree(table: pa.Table, deep: int) -> tuple[list[int], Tree]:
    """The rows of a block in order, and its tree."""
    at, n = table.column("at").to_pylist(), table.column("n")[0].as_py()
    order = sorted(range(len(at)), key=at.__getitem__)
    hashes = table.column("hash").to_pylist()
    return order, Tree([hashes[k].encode() for k in order], min(deep, height(n)))


def _reduced(deep: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, tree = _tree(table, deep)
        (top,) = tree.levels[-1]
        n = -(-table.column("n")[0].as_py() // FAN**deep)
        return pa.table({"g": [key[0].as_py()], "at": [key[1].as_py()], "n": [n], "hash": [top.decode()]})

    return run


def _grown(nodes: DataFrame, deep: int) -> list[DataFrame]:
    """The nodes (g, at, n, hash), and those some levels above, and so on, to one of each g."""
    out = [nodes]
    while len(out) == 1 or (out[-1].agg(F.max("n")).first()[0] or 1) > 1:
        out.append(stored(_blocks(out[-1].select("g", "at", "n", "hash"), deep).applyInArrow(_reduced(deep), "g long, at long, n long, hash string")))
    return out


def _paths_of(deep: int):
    def run(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        order, tree = _tree(nodes, deep)
        (up,) = above.to_pylist()
        paths = [[{"left": _apart(x), "right": _apart(y)} for x, y in tree.siblings(k)] + up["path"] for k in range(len(order))]
        g, block = key[0].as_py(), key[1].as_py()
        own = {"g": [g] * len(order), "at": [block * FAN**deep + k for k in range(len(order))], "path": pa.array(paths, pa.list_(_LEVEL))}
        return pa.table(own | {"subroot": pa.array([up["subroot"]] * len(order), pa.string()), "root": pa.array([up["root"]] * len(order), pa.string())})

    return run


def _paths(levels: list[DataFrame], top: DataFrame, deep: int) -> DataFrame:
    """g, at, path, subroot, root of each node of the first level, from the path, subroot and root of those of the last."""
    out = top
    for nodes in reversed(levels[:-1]):
        keyed = out.groupBy("g", F.col("at").alias("block"))
        out = stored(_blocks(nodes, deep).cogroup(keyed).applyInArrow(_paths_of(deep), f"g long, at long, path {_PATH}, subroot string, root string"))
    return out


def _leaf_rows(deep: int, proofs: bool):
    def run(key: tuple, leaves: pa.Table, above: pa.Table) -> pa.Table:
        order, tree = _tree(leaves, deep)
        (up,) = above.to_pylist()
        path = Path(_joined(up["path"]))
        ids, replaced = leaves.column("id"), leaves.column("replaced").to_pylist()
        told, folded, siblings = [], [], []
        for k, row in enumerate(order):
            own = tree.siblings(k)
            told.append(hashlib.sha256(b"".join(left + right for left, right in own) + path.told).hexdigest())
            value = replaced[row].encode() if replaced[row] is not None else tree.levels[0][k]
            folded.append(path.fold(tree.fold(k, value)).decode())
            if proofs:
                siblings.append([{"left": _apart(x), "right": _apart(y)} for x, y in own] + up["path"])
        out = {"id": ids.take(pa.array(order)), "leaf": [x.decode() for x in tree.levels[0]], "subroot": [up["subroot"]] * len(order), "root": [up["root"]] * len(order), "proof_sha256": told, "folded_root": folded}
        if proofs:
            out["proof"] = pa.array(siblings, pa.list_(_LEVEL))
        return pa.table(out)

    return run


def manifest(docs: DataFrame, leaf: Column, *, replaced: Column | None = None, id_col: str = "doc_id", group_col: str = "lang", proofs: bool = False, deep: int = DEEP) -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root, proof_sha256 (of all siblings on its way to the root), folded_root and verified.

    folded_root is recomputed from the siblings and the leaf, or the digest ``replaced`` where it isn't null; proofs adds the siblings themselves, by level."""
    other = F.lit(None).cast("string") if replaced is None else replaced
    leaves = stored(docs.select(docs[id_col].alias("id"), docs[group_col].alias("group"), leaf.alias("hash"), other.alias("replaced")))
    numbered, groups = ranked(leaves, ["group"], ["id", "hash"])
    places, _ = ranked(groups.select("group"), [], ["group"])
    places = stored(places.select(F.col("group").alias("__group"), F.col("at").alias("g"), F.col("n").alias("groups")))
    numbered = stored(numbered.join(places, F.col("group").eqNullSafe(F.col("__group"))).select("g", "at", "n", "hash", "id", "replaced"))
    levels = _grown(numbered, deep)
    tops = levels[-1].join(places.select("g", "groups"), "g")
    roots = stored(tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("at"), F.col("groups").alias("n"), "hash"))
    upper = _grown(roots, deep)
    root = upper[-1].select("g", "at", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    above = _paths(upper, root, deep).select(F.col("at").alias("g"), F.lit(0).cast("long").alias("at"), "path", "root")
    above = above.join(levels[-1].select("g", F.col("hash").alias("subroot")), "g").select("g", "at", "path", "subroot", "root")
    above = _paths(levels[1:], above, deep)
    kind = numbered.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (f", proof {_PATH}" if proofs else "")
    out = _blocks(numbered, deep).cogroup(above.groupBy("g", F.col("at").alias("block"))).applyInArrow(_leaf_rows(deep, proofs), schema)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
