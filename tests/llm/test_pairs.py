from __future__ import annotations

import random
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from evidence_engine.llm import decontamination, near_copies, packing, simhash
from evidence_engine.llm.queries import tokenizer_path

from .helpers import edge_rows, frame, prose, words


# -- SimHash ------------------------------------------------------------------------------------------------------


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius=3):
    prints = sorted(set(prints))
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {p: find(p) for p in prints}


def test_simhash_against_brute_force(spark):
    rng = random.Random(1)
    rows = edge_rows()
    for g in range(6):  # near copies: a long text with one word changed
        base = words(400, 500 + g)
        for k in range(12):
            own = list(base)
            own[rng.randrange(len(own))] = f"other{k}"
            rows.append((100 + 20 * g + k, " ".join(own)))
    rows += [(300, "One two THREE four"), (301, "one TWO three four"), (302, "word"), (303, "a b")]
    got = simhash.simhash_classes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = [(i, brute_print(t)) for i, t in rows]
    roots = brute_components([p for _, p in want])
    ids = {}
    for i, p in want:
        if i is not None:
            ids[roots[p]] = min(i, ids.get(roots[p], i))
    expected = Counter((i, p, ids.get(roots[p])) for i, p in want)
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == expected
    assert max(Counter(r["component_id"] for r in got).values()) > 3
    left = simhash.one_per_class(frame(spark, rows))
    assert {r["doc_id"] for r in left.collect()} - {None} == set(ids.values()) and "key" in left.columns


def test_links_connect_what_brute_force_connects(spark, monkeypatch):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(400):
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
            p ^= 1 << b
        prints.append(p)
    signed = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in set(prints)]
    monkeypatch.setattr(simhash, "CHUNK", 64)  # large buckets are cut
    monkeypatch.setattr(simhash, "BUCKET", 8)
    df = spark.createDataFrame(signed, "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, len(signed))).collect()}
    want = brute_components(prints)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    mine = {p[0] % (1 << 64): roots.get(p[0], p[0]) % (1 << 64) for p in signed}
    assert groups(mine) == groups(want)


def test_masks_cover_the_radius():
    rng = random.Random(3)
    for n in (1, 1_000, 10**6, 10**8, 10**11):
        ms = simhash.masks(n)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 3):
                y ^= 1 << b
            assert any(x & m == y & m for m in ms)


def test_bit_sliced_comparison_against_popcount():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    b = np.concatenate([a[:50] ^ np.uint64(5), a[50:90] ^ np.uint64(0xF), rng.integers(0, 1 << 63, 41).astype(np.uint64)])
    for radius in (0, 1, 2, 3):
        got = np.unpackbits(simhash.close_lanes(a, b, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(b)].astype(bool)
        assert np.array_equal(got, np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(200)], "u long, v long")
    assert {(r["node"], r["root"]) for r in simhash.components(path).collect()} == {(k, 0) for k in range(1, 201)}
    assert simhash.simhash_classes(frame(spark, [])).count() == 0


# -- packing ------------------------------------------------------------------------------------------------------


def exact_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_is_exact_and_tight(spark):
    rows = edge_rows() + [(100 + i, prose(20 + 37 * i % 900, i)) for i in range(60)] + [(200, "It's 3.14, isn't it? É ﬁ <|endoftext|>x Don't  \r\n U.S.A., (ok)."), (201, "İstanbul ΣΑΣ straße. Á é, ǅ")]
    out = packing.pack(frame(spark, rows), tokenizer_path(), with_ids=True)
    got = out.collect()
    want = Counter()
    for i, t in rows:
        ids = exact_ids(t)
        for k in range(0, len(ids), 4096):
            part = struct.pack(f"<{len(ids[k : k + 4096])}I", *ids[k : k + 4096])
            want[i, k // 4096, k, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in places.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == -(-sum(r["length"] for r in got) // 4096)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(out).collect()}
    assert whole == {s: b"".join(x[2] for x in sorted(p)) for s, p in places.items()}


def test_packing_empty(spark):
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_letters_that_take_the_short_way_get_the_tokenizer_s_ids():
    own = packing.WordIds(tokenizer_path())
    assert own.by_word
    texts = [x + t for k in range(1, 0x250) for x in [chr(k)] for t in ("", "a" + x + ",", " 's" + x)]
    texts += ["a<|endoftext|>b", "don't it's x's 'll", "e\u0301a \u0301", "x\x1cy\x85z\xa0w", "12a-b ###x", "中文 テ"]
    for t in texts:
        ids = own.tokenizer.encode(t, add_special_tokens=False).ids
        assert own.of(t) == struct.pack(f"<{len(ids)}I", *ids), t


def test_packing_with_a_tokenizer_of_another_form(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    assert not packing.WordIds(path).by_word
    plain = Tokenizer.from_file(path)
    for row in packing.pack(frame(spark, [(1, "Two  words\n"), (2, None), (3, " it's ÉÉ")]), path, with_ids=True).collect():
        text = {1: "Two  words\n", 2: "", 3: " it's ÉÉ"}[row["doc_id"]]
        ids = [*plain.encode(text, add_special_tokens=False).ids, 1]
        assert bytes(row["ids"]) == struct.pack(f"<{len(ids)}I", *ids)


def test_word_memory_turns_over():
    small = packing.WordIds(tokenizer_path(), most=40)
    for k in range(30):
        t = prose(25, k) + ". " + prose(5, k) + ","
        assert small.of(t) + struct.pack("<I", 1) == struct.pack(f"<{len(exact_ids(t))}I", *exact_ids(t))


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_all_pieces_and_finds_small_optima(seed):
    rng = random.Random(seed)
    size = 30
    lengths = [rng.randint(1, size) for _ in range(9)]
    counts = np.bincount(lengths, minlength=size + 1)
    patterns, _, proved, _ = packing.plan(counts, size)
    assert proved
    used = Counter()
    for held, many in patterns:
        assert sum(held) <= size
        for x in held:
            used[x] += many
    assert used == Counter(lengths)

    def best(left, bins):  # exhaustive
        if not left:
            return len(bins)
        x, out = left[0], len(lengths)
        for k in sorted(set(bins)):
            if k >= x:
                rest = list(bins)
                rest.remove(k)
                out = min(out, best(left[1:], [*rest, k - x]))
        if len(bins) + 1 < out:
            out = min(out, best(left[1:], [*bins, size - x]))
        return out

    assert sum(m for _, m in patterns) == best(sorted(lengths, reverse=True), [])


def test_plan_beats_best_fit_decreasing():
    counts = np.bincount([6, 6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 3, 2, 2, 2] * 20 + [7, 3] * 9, minlength=21)
    total = int((counts * np.arange(21)).sum())
    found = packing.plan(counts, 20)
    assert found.sequences == sum(m for _, m in found.patterns) == -(-total // 20) and found.proved


@pytest.mark.parametrize(("bins", "optimal"), [(10, True), (20, True), (60, False)])
def test_plan_at_full_size_where_best_fit_decreasing_fails(bins, optimal):
    """Triples that fill a sequence exactly, which best-fit decreasing misses."""
    rng = random.Random(bins)
    counts = np.zeros(4097, np.int64)
    for _ in range(bins):
        a, b = rng.randrange(1400, 2000), rng.randrange(900, 1300)
        for x in (a, b, 4096 - a - b):
            counts[x] += 1
    found = packing.plan(counts)
    used = Counter()
    for held, many in found.patterns:
        assert sum(held) <= 4096
        used.update({x: many * held.count(x) for x in set(held)})
    assert used == Counter({x: int(k) for x, k in enumerate(counts) if k})
    assert bins <= found.sequences < sum(m for _, m in packing.best_fit_decreasing(counts, 4096))
    assert packing.lower_bound(counts, 4096) == bins and found.proved == (found.sequences == bins)
    assert found.sequences == bins or not optimal


def test_fillings_are_all_undominated_ones():
    rng = random.Random(4)
    for _ in range(60):
        room = rng.randint(4, 14)
        counts = np.bincount([rng.randint(1, 9) for _ in range(rng.randint(1, 8))], minlength=20)
        have = [x for x in range(1, 20) for _ in range(counts[x])]
        feasible = {tuple(sorted(c, reverse=True)) for r in range(len(have) + 1) for c in combinations(have, r) if sum(c) <= room}

        def beaten(fill):
            """By the definition: some group of its pieces can give way to one piece that is left and at least as long."""
            for r in range(len(fill) + 1):
                for group in combinations(range(len(fill)), r):
                    s = sum(fill[k] for k in group)
                    for x in range(1, 20):
                        better = x > s or (x == s and r > 1)
                        if better and counts[x] > fill.count(x) and sum(fill) - s + x <= room:
                            return True
            return False

        got = list(packing.fillings(counts, room, room))
        assert len(got) == len(set(got)) and set(got) == {f for f in feasible if not beaten(f)}, (counts, room)
        assert [room - sum(f) for f in got] == sorted(room - sum(f) for f in got)


# -- decontamination ----------------------------------------------------------------------------------------------


def edited(rng, base, k):
    own = list(base)
    for _ in range(k):
        i = rng.randrange(len(own))
        kind = rng.choice("sid")
        if kind == "s":
            own[i] = f"zz{rng.randrange(999)}"
        elif kind == "i":
            own.insert(i, f"yy{rng.randrange(999)}")
        else:
            del own[i]
    return own


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(9)
    items = [(k, words(15 + 5 * (k % 9), 7000 + k)) for k in range(30)]
    rows, near = [(9000 + i, t) for i, t in enumerate(t for _, t in edge_rows() if t is not None)], []
    for d in range(300):
        k, item = rng.choice(items)
        allowed = decontamination.allowed_edits(len(item), 0.8)
        text = words(rng.randrange(40), d) + edited(rng, item, rng.randrange(allowed + 3)) + words(rng.randrange(40), d + 5000)
        rows.append((d, ", ".join(text).title()))
        if brute_distance(item, text) <= allowed:
            near.append((d, k, brute_distance(item, text)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(98, ""), (99, None), (None, "x y"), (0, " ".join(items[0][1]))], "item_id long, text string")
    docs = frame(spark, [*rows, (None, " ".join(items[0][1])), (4000, None), rows[-1]])
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontamination.benchmark_matches(docs, bench).collect()}
    found = sum((d, k) in got for d, k, _ in near)
    assert len(near) > 150 and found / len(near) >= 0.97, (found, len(near))
    assert all(got[d, k] == e for d, k, e in near if (d, k) in got and e == 0)
    by = dict(items)
    texts = dict(rows)
    for (d, k), e in got.items():
        assert brute_distance(by[k], decontamination.item_words(texts[d])) <= e <= decontamination.allowed_edits(len(by[k]), 0.8)
    left = [r["doc_id"] for r in decontamination.decontaminated(docs, bench).collect()]
    holds = {d for d, _ in got}  # the document without an id holds an item too
    assert sorted(left) == sorted(d for d, _ in [*rows, (4000, 0), rows[-1]] if d not in holds)


def test_decontamination_goes_by_text_not_id(spark):
    item = " ".join(words(20, 5))
    rows = [(1, "clean " + prose(9, 1)), (1, "x " + item), (None, item), (2, None), (2, "")]
    left = decontamination.decontaminated(frame(spark, rows), spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, [rows[0], rows[3], rows[4]]))


def test_decontamination_in_passes_and_empty(spark):
    bench = spark.createDataFrame([(k, prose(20, 100 + k)) for k in range(12)], "item_id long, text string")
    docs = frame(spark, [(k, prose(5, k) + " " + prose(20, 100 + k)) for k in range(12)])
    one = {(r[0], r[1]) for r in decontamination.benchmark_matches(docs, bench).select("doc_id", "item_id").collect()}
    many = {(r[0], r[1]) for r in decontamination.benchmark_matches(docs, bench, items_per_pass=3).select("doc_id", "item_id").collect()}
    assert one == many == {(k, k) for k in range(12)}
    assert decontamination.benchmark_matches(frame(spark, []), bench).count() == 0
    assert decontamination.benchmark_matches(docs, bench.where("item_id < 0")).count() == 0


def test_embedding_bounds():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, (5, 20))
    symbols, steps = rng.integers(0, 1 << 64, 52, np.uint64), rng.integers(0, 1 << 64, 60, np.uint64) | np.uint64(1)
    e = decontamination.embed(np.vstack([x, x]), symbols, steps)
    assert e.shape == (10, 60) and np.array_equal(e[:5], e[5:])
    bits = (symbols[None, :] * steps[:, None]) >> np.uint64(63)
    for row, out in zip(x.tolist(), e.tolist()):  # the walk, symbol by symbol
        at = 0
        for j in range(60):
            symbol = row[at] if at < 20 else -1
            assert out[j] == symbol
            at = min(20, at + int(bits[j, symbol]))


@pytest.mark.parametrize("n", [100, 101, 300, 301, 500])
def test_decontamination_recall_on_long_items(n):
    """At the most edits allowed, where the number of coordinates changes, and beyond."""
    rng, k = random.Random(n), decontamination.allowed_edits(n, 0.8)
    items = [(i, words(n, 1000 * i + n)) for i in range(4)]
    own = decontamination.Items([(i, " ".join(w)) for i, w in items], 0.8)
    wanted = [rng.choice(items) for _ in range(25)]
    texts = [" ".join(words(30, t) + edited(rng, w, k) + words(30, t + 99)) for t, (_, w) in enumerate(wanted)]
    got = {(d, i) for d, i, _ in own.matches(texts)}
    assert sum((d, i) in got for d, (i, _) in enumerate(wanted)) >= 24


def test_decontamination_memory_does_not_grow_with_vocabulary_times_sizes():
    import tracemalloc

    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(18_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 200)))) for i in range(3_000)]
    texts = [" ".join(rng.choices(vocabulary, k=300)) + " " + items[d][1] for d in range(60)]
    tracemalloc.start()
    got = decontamination.Items(items, 0.8).matches(texts)
    assert {(d, i) for d, i, _ in got} >= {(d, d) for d in range(60)}
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


# -- the pipeline -------------------------------------------------------------------------------------------------


def test_pipeline_against_its_stages(spark, tmp_path):
    import corpus_pipeline

    passage = "\n".join(prose(60, 40 + k) for k in range(2))
    item = prose(30, 77)
    rows = [(i, ". ".join(prose(15, 300 + 10 * i + k) for k in range(3))) for i in range(40)]
    rows += [(50, rows[3][1]), (51, rows[4][1] + "\n" + passage), (52, rows[5][1] + " again\n" + passage), (53, prose(20, 1) + " " + item + " " + prose(20, 2)), (54, None), (55, prose(20, 8) + " scumzo idiotzu scumzo")]
    rows += [(100 + i, prose(40, 600 + i) + (" scumzo idiotzu" if i % 5 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        if name == "line_dedup":
            lines = {r["doc_id"]: r for r in at.collect()}
    kept = {r["doc_id"]: r for r in at.collect()}
    # line dedup leaves document 50, a copy, empty; so is 54, and one of the two stays
    assert kept[50]["text"] == "" and not {53, 54, 55} & set(kept) and 51 in kept and set(range(40)) <= set(kept)
    # line dedup takes the passage from document 52; one word more than document 5 remains, a similarity over 0.8
    assert passage.split("\n")[0] not in lines[52]["text"] and lines[52]["n_chars"] == len(lines[52]["text"])
    assert brute_similarity(lines[5]["text"], lines[52]["text"]) >= 0.8 and 52 not in kept
    assert sum(100 + i in kept for i in range(120)) == 96 and not any(100 + i in kept for i in range(0, 120, 5))
    assert passage in kept[51]["text"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(kept) and all(r["length"] == len(exact_ids(kept[r["doc_id"]]["text"])) for r in out)


def test_pipeline_takes_edge_rows_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, __toxicity string, __kept_text string, __kept_lines int, fp long, node long, length int"
    long = " ".join(prose(200, 7000 + k) for k in range(100))
    rows = [(*r, "en", None, None, "t", "old", 7, 1, 2, 3) for r in [(None, None), (None, "no id but a line of text"), (1, None), (2, ""), (3, " \t"), (4, long), (5, prose(40, 2)), (5, prose(40, 2)), (6, prose(50, 3))]]
    rows += [(100 + i, prose(40, 600 + i) + (" scumzo idiotzu" if i % 5 == 0 else ""), "en", "s", 1, "t", "old", 7, 1, 2, 3) for i in range(60)]
    for name, some in (("full", rows), ("empty", [])):
        d = tmp_path / name
        spark.createDataFrame(some, kind).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(100 + i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        spark.createDataFrame([(0, prose(30, 77)), (1, None)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        at = docs = spark.read.parquet(str(d / "documents.parquet"))
        for stage, f in corpus_pipeline.STAGES[:-1]:
            at = f(spark, at, str(d))
            assert at.columns == docs.columns, stage
        kept = at.collect()
        assert {(r["__toxicity"], r["__kept_text"], r["__kept_lines"]) for r in kept} <= {("t", "old", 7)}
        ids = [r["doc_id"] for r in kept]
        if some:
            assert ids.count(5) == 1 and {4, 6} <= set(ids) and ids.count(None) >= 1 and any(r["text"] == long for r in kept)
        else:
            assert not ids
        out = corpus_pipeline.run(spark, str(d)).collect()
        assert sorted({str(r["doc_id"]) for r in out}) == sorted({str(i) for i in ids})


# -- Near copies ----------------------------------------------------------------------------------------------------


def brute_similarity(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_of_ordinary_length(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, prose(rng.randint(50, 90), 5000 + i)) for i in range(60)]
    for i in range(60):
        w = rows[i][1].split()
        for k in range(1 + i % 3):
            w[rng.randrange(len(w))] = f"changed{k}"
        rows.append((100 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "two words"), (303, "Two  words"), (304, "two other")]
    rows += edge_rows()[:2] + [(400, rows[0][1].upper()), (None, rows[1][1])]
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    own = [(i, t) for i, t in rows if i is not None]
    prints = {i: brute_print(t) for i, t in own}
    far = 0
    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            bits = (prints[i] ^ prints[j]).bit_count()
            similar = brute_similarity(a, b) >= 0.8
            far += similar and bits > simhash.RADIUS
            if similar or bits <= simhash.RADIUS:
                a_, b_ = find(i), find(j)
                parent[max(a_, b_)] = min(a_, b_)
    want = sorted(i for i in parent if find(i) == i)
    assert far >= 20  # SimHash alone leaves these
    for chunk, most in ((near_copies.CHUNK, near_copies.SHINGLES), (1, near_copies.SHINGLES), (near_copies.CHUNK, 100)):
        monkeypatch.setattr(near_copies, "CHUNK", chunk)
        monkeypatch.setattr(near_copies, "SHINGLES", most)
        left = near_copies.one_per_class(frame(spark, rows)).collect()
        assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == want
        assert sum(r["doc_id"] is None for r in left) == 3


def test_a_hot_bucket_takes_no_pairs_of_chunks(spark, monkeypatch):
    """400 near copies in 50 chunks: the sets that are compared after the first pass grow with the group, not with its square."""
    base = words(60, 77)
    rows = []
    for i in range(400):
        w = list(base)
        w[i % 60] = f"other{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(60, 9000 + i)) for i in range(20)]
    monkeypatch.setattr(near_copies, "CHUNK", 8)
    compared = []
    plain = near_copies._compared
    monkeypatch.setattr(near_copies, "_compared", lambda rows, sets, *group: compared.append((group, rows.count())) or plain(rows, sets, *group))
    left = sorted(r["doc_id"] for r in near_copies.one_per_class(frame(spark, rows)).collect())
    assert left == [0, *range(1000, 1020)]
    first = sum(n for g, n in compared if g == ("key", "c"))
    assert sum(n for g, n in compared if g == ("key", "r", "c")) <= first and first < 24 * 400 * 3, compared


def test_rows_that_repeat_id_and_text_leave_one(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (1, prose(30, 4)), (2, "One two three four five six"), (None, "x"), (None, "x")]
    for own in (simhash, near_copies):
        left = [(r["doc_id"], r["text"]) for r in own.one_per_class(frame(spark, rows)).collect()]
        assert sorted(map(str, left)) == sorted(map(str, [rows[0], rows[2], rows[4], rows[5]]))


def test_near_copy_stars_follow_paths():
    sets = [np.arange(k, k + 90, dtype=np.int64) for k in (0, 9, 18, 200)]
    members, roots = near_copies.local_stars(np.array([1, 2, 3, 4]), sets)
    assert sorted(zip(members, roots)) == [(2, 1), (3, 1)]  # 0 and 18 are similar to 9 only
