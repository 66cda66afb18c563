"""Conversation repair, substring dedup and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from evidence_engine.llm import conversation_repair, merkle_manifest, queries, substring_dedup
from pyspark.sql import functions as F

from .helpers import edge_rows, frame, prose, words

WHITE = " \t\n\x0b\x0c\r"


# conversation repair


def cheapest(turns):
    """(cost, audit, repaired) of (role, text, fault) turns, by Dijkstra over (place, initials so far)."""
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, out = heapq.heappop(queue)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(turns) and last in ("", "a"):
            return cost, audit, list(out)
        new = [x for x in moves[last] if x in "ua"]
        name = {"u": "user", "a": "assistant"}
        for x in new:
            heapq.heappush(queue, (cost + 2, audit + "I", i, x, (*out, (name[x], ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if role and role[0] in moves[last]:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[0], (*out, (role, text))))
                for x in new:
                    heapq.heappush(queue, (cost + 2 + more, audit + "R", i + 1, x, (*out, (name[x], text))))
    raise AssertionError("no way")


def brute_repair(rows):
    """The report of each conversation of (conv_id, turn, role, text) after damage."""
    chats = {}
    for conv, turn, role, text in rows:
        own = chats.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        by = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if by == 1 else "".join(x for x in text if x not in ".!?") if by == 2 else text
        role = "user" if by == 4 else role
        own += [(turn is not None, turn or 0, role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
    out = {}
    for conv, own in chats.items():
        own.sort()
        seen, turns = set(), []
        for _, _, role, text in own:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            turns.append((role, text, fault))
        n = Counter(x[2] for x in turns)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        known = [t for has, t, _, _ in own if has]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, repaired = cheapest(turns)
        told = "\n".join(f"{a}:{b}" for a, b in repaired)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest())
    return out


def run_reports(df):
    damaged = conversation_repair.damaged(df)
    out = conversation_repair.repair_reports(conversation_repair.repair_edits(damaged, here=damaged["here"]))
    return {r["conv_id"]: tuple(r)[1:] for r in out.collect()}


def test_repair_against_dijkstra(spark):
    rng, rows = random.Random(1), []
    says = ["Yes.", "No!", "what", "", " \t", "Is it?", "it is.  ", "É 中。", None]
    for conv in range(150):
        for k in range(rng.randint(1, 14)):
            turn = None if rng.random() < 0.05 else k if rng.random() < 0.9 else rng.randint(0, 20)
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(says)))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, 1, "assistant", "Ho."), (-5, None, None, None)]
    rows += [(1000, k, "human" if k % 2 else "gpt", f"text {k}.") for k in range(60)]  # no role is known
    schema = "conv_id long, turn long, role string, text string, step long, edit string, fault string, seq int, here string"
    df = spark.createDataFrame([(*r, 1, "e", "f", 2, "h") for r in rows], schema).repartition(5)
    assert run_reports(df) == brute_repair(rows)
    assert run_reports(df.limit(0)) == {}


def test_repair_of_the_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.001").collect()}
    assert got == brute_repair(rows) and len(got) > 10


def test_repair_edits_rebuild_the_conversation(spark):
    rows = [(1, 0, "system", "Rules."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Cut"), (1, 3, "assistant", ""), (2, 0, "user", "One.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = [r for r in conversation_repair.repair_edits(df).collect() if r["step"] is not None]
    told = {c: "".join(r["edit"] for r in sorted(out, key=lambda r: r["step"]) if r["conv_id"] == c) for c in (1, 2)}
    assert told == {1: "KIKDD", 2: "D"} or told[2] in ("D", "KI")
    first = [(r["edit"], r["role"], r["text"], r["fault"], r["cost"]) for r in out if r["conv_id"] == 1]
    want = cheapest([("system", "Rules.", None), ("assistant", "Hello.", None), ("user", "Cut", "truncated"), ("assistant", "", "blank")])
    assert "".join(x[0] for x in first) == want[1] and sum(x[4] for x in first) == want[0]
    assert [x[1:3] for x in first if x[0] != "D"] == want[2]


def test_repair_memory_is_bounded_by_the_unresolved_end():
    rng = random.Random(2)
    own, n = conversation_repair.Repair(), 0
    for k in range(20_000):
        role = ("user", "assistant")[k % 2] if rng.random() < 0.8 else rng.choice(["user", "assistant", "system", "tool"])
        n += len(own.push(role[0], rng.choice([None, None, "truncated", "blank"]), k))
        assert len(own.turns) < 400
    assert own.most < 400 and n > 19_000
    stuck = conversation_repair.Repair()  # a shift costs the same everywhere: the end stays open, ties stay quick
    for k in range(20_000):
        assert not stuck.push("x", None, k)
    edits = stuck.end()
    assert [e[3] for e in edits if e[3] is not None] == list(range(20_000)) and sum(e[2] for e in edits) == 40_000
    wholly = conversation_repair.Repair()
    for k in range(2001):
        wholly.push("x", None, k)
    assert "".join(e[0] for e in wholly.end()) == "D" + "R" * 2000


def test_repair_of_one_long_conversation(spark):
    rng = random.Random(3)
    rows = [(7, k, rng.choice(["user", "assistant"]), f"text {k // 3}{rng.choice(['.', ''])}") for k in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert run_reports(df) == brute_repair(rows)


# substring dedup


def brute_substrings(rows, window=35):
    found, at = [], defaultdict(int)
    for i, t in rows:
        w = [x for x in "".join(" " if c in WHITE else c for c in (t or "")).split(" ") if x]
        found.append((i, w))
        for k in range(len(w) - window + 1):
            at[tuple(w[k : k + window])] += 1
    out = []
    for i, w in found:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if at[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def passages():
    """Passages of 30 to 200 words at all offsets, copies, and a text that repeats itself."""
    rng, rows = random.Random(4), []
    shared = [words(n, 100 + n) for n in (34, 35, 36, 50, 53, 200)]
    for i in range(100, 160):
        w = words(rng.randint(0, 40), i)
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 20)
            w += p[a:] + words(rng.randint(0, 30), i + rng.randint(1000, 9000))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(200, " ".join(["same"] * 100)), (201, " ".join(words(20, 7) * 5)), (202, prose(300, 8)), (203, prose(300, 8)), (204, prose(300, 8) + " end"), (205, prose(34, 9)), (206, prose(34, 9)), (207, prose(35, 9)), (208, prose(35, 9))]
    return rows


def run_substrings(df):
    out = substring_dedup.substring_dedup(df)
    return sorted(((r["doc_id"], r["kept_words"], r["kept_removed"], r["kept_text"]) for r in out.collect()), key=repr)


def test_substring_dedup_against_brute_force(spark):
    rows = edge_rows() + passages() + [(None, prose(60, 11)), (None, prose(60, 11)), (9, prose(60, 11))]
    df = frame(spark, rows).repartition(4)
    assert run_substrings(df) == brute_substrings(rows)
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0
    assert {"key", "old"} - set(substring_dedup.substring_dedup(df).columns) == {"old"}


def test_substring_dedup_with_small_chunks_buckets_and_pieces(spark, monkeypatch):
    """The result doesn't depend on how documents are cut and gathered. The operator's functions run here as plain Python."""
    rows = passages()
    hits, found = defaultdict(list), defaultdict(set)
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 300)
    plain = substring_dedup.hashed_documents
    monkeypatch.setattr(substring_dedup, "hashed_documents", lambda c, lanes=1: plain(c, lanes, size=700))
    batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], ["id", "th", "text"])

    def exchange(batches, widths):
        groups = defaultdict(list)
        for t in batches:
            for r in pa.Table.from_batches([t]).to_pylist():
                groups[r["key"]].append(r)
        schema = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
        chunks = defaultdict(list)
        for g in groups.values():
            for r in substring_dedup._resolver(widths)(pa.Table.from_pylist(g, schema)).to_pylist():
                chunks[r["chunk"]].append(r)
        return [pa.Table.from_pylist(g, schema) for g in chunks.values()]

    for t in exchange(substring_dedup._probes(3)([batch]), (4,)):
        for r in substring_dedup._marked_blocks(t).to_pylist():
            hits[r["id"]].append(r["marks"])
    marked = pa.record_batch([*(batch.column(k) for k in range(3)), pa.array([hits[i] for i, _ in rows], pa.list_(pa.binary()))], ["id", "th", "text", "blocks"])
    for t in exchange(substring_dedup._windows(3)([marked]), (8, 4)):
        for r in substring_dedup._repeats(t).to_pylist():
            found[r["id"]] |= set(range(r["start"], r["end"]))
    want = {i: n for i, _, n, _ in brute_substrings(rows)}
    assert {i: len(found[i]) for i, _ in rows} == want


def test_word_hashes_of_two_lanes_tell_words_apart():
    text = "a ab ba  abc\tacb é è\n" + " ".join(f"w{k}" for k in range(5000))
    data = np.frombuffer(text.encode(), np.uint8)
    _, (x, y) = substring_dedup.word_hashes(data, np.array([0, len(data)]), 2)
    assert len(x) == len(text.split()) and len(set(x.tolist())) == len(set(y.tolist())) == len(set(text.split()))


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_root(nodes, k=None):
    """The root of digests, and the siblings of node k on its way, level by level, left to right."""
    way = []
    while len(nodes) > 1:
        if k is not None:
            a = k - k % 8
            way.append((nodes[a:k], nodes[k + 1 : a + 8]))
            k //= 8
        nodes = [sha(*nodes[a : a + 8]) for a in range(0, len(nodes), 8)]
    return nodes[0], way


def brute_manifest(rows):
    """(id, group, leaf, replaced) -> rows of the manifest."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    tops = [brute_root([r[2] for r in groups[g]])[0] for g in order]
    out = []
    for j, g in enumerate(order):
        for k, (i, _, leaf, replaced) in enumerate(groups[g]):
            root, above = brute_root(tops, j)
            way = brute_root([r[2] for r in groups[g]], k)[1] + above
            value = replaced or leaf
            for left, right in way:
                value = sha(*left, value, *right)
            out.append((i, leaf, tops[j], root, sha(*(x for left, right in way for x in left + right)), value, value == root))
    return sorted(out, key=repr)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def py_leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


@pytest.mark.parametrize("deep", [4, 1])
def test_manifest_against_brute_force(spark, deep):
    """deep 1: many stages of one level."""
    rng, rows = random.Random(5), []
    langs = [None, "", "é", "en", "a", "b", "Z", *[f"l{k}" for k in range(10)]]
    for k, (i, t) in enumerate([*edge_rows()[:9], *[(rng.choice([j, j, 7, None]), prose(5, j)) for j in range(300)]]):
        rows.append((i, rng.choice(["x", None, ""]), "en" if k % 3 else rng.choice(langs), rng.choice([3, None]), t))
    df = spark.createDataFrame([(*r, 1, 2, "h") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g long, at long, hash string").repartition(6)
    changed = F.when(F.col("doc_id") % 3 == 0, merkle_manifest.leaf_hash(*map(F.col, FIELDS[:4]), F.upper("text")))
    got = merkle_manifest.manifest(df, merkle_manifest.leaf_hash(*map(F.col, FIELDS)), replaced=changed, proofs=True, deep=deep).collect()
    want = brute_manifest([(r[0], r[2], py_leaf(*r), py_leaf(*r[:4], None if r[4] is None else r[4].upper()) if r[0] is not None and r[0] % 3 == 0 else None) for r in rows])
    names = ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == want
    for r in got[::40]:  # the siblings that come with it rebuild the root from the leaf
        value = r["leaf"]
        for x in r["proof"]:
            value = sha(*x["left"], value, *x["right"])
        assert value == r["root"]
    assert merkle_manifest.manifest(df.limit(0), merkle_manifest.leaf_hash(F.col("text"))).count() == 0


def test_manifest_of_one_row(spark):
    df = spark.createDataFrame([(1, "en", "text")], "doc_id long, lang string, text string")
    (r,) = merkle_manifest.manifest(df, merkle_manifest.leaf_hash(F.col("text"))).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == py_leaf("text") and r["verified"] and r["proof_sha256"] == sha()


def test_tree_states_resume_before_each_slot():
    nodes = [sha(str(k)).encode() for k in range(77)]
    tree = merkle_manifest.Tree(nodes, merkle_manifest.height(77))
    for k in (0, 7, 8, 63, 64, 76):
        assert tree.fold(k, nodes[k]) == tree.levels[-1][0] != tree.fold(k, sha("other").encode())
        changed = [*nodes]
        changed[k] = sha("other").encode()
        assert tree.fold(k, changed[k]).decode() == brute_root([x.decode() for x in changed])[0]


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_substring_dedup", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    from pathlib import Path

    import duckdb

    con = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cursor.fetchall())
