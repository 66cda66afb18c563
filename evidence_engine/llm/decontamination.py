"""Benchmark decontamination: documents that hold a benchmark item up to a few word edits.

An item of n words is held where some stretch of a document is within ``k = floor((1 - similarity) * n)`` word edits of it.
Windows of the item's size are embedded by CGK random walks (a shared random bit per step and symbol decides whether the
walk advances), which turns edit distance into Hamming distance; sampled coordinates of several
embeddings are the keys of LSH tables, whose number gives the target recall; every collision is verified by exact edit distance.

Embeddings have no tables of random bits: a step's bit for a symbol is the top bit of the symbol's random number times the
step's, so the items of a pass take memory in proportion to their words. Coordinates per key fall with the size of an item
(``coordinates``), so that the recall of 8 x 12 keys stays above 0.95 at the most edits allowed up to 800 words.

Embedding each window of a corpus is out of reach, so two gates that lose nothing come first: k edits leave one of any
k + 1 words of the item untouched, so windows start only where one of its k + 1 rarest words lies; and a window around it must
hold n - k positions with words of the item. Documents never move: items travel to them in bounded blocks, and only
verified pairs come back.

Defined cases: words are letters and digits, lower-cased; items without a word match nothing; null texts hold nothing; very long
texts are read whole, some seed hits at a time; repeated item or document rows give one pair; matches leave out rows with a
null id on either side, but such a document that holds an item is removed like any other; a pair reports its smallest distance;
empty tables give no pairs; other columns, whatever their names, don't enter. Ids are cast to long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

SIMILARITY = 0.8
#: CGK embeddings, LSH tables for each, and coordinates in a key.
EMBEDDINGS, TABLES = 8, 12
#: Items, and characters of them, that one pass over the documents takes along; more items take more passes.
ITEMS_PER_PASS, CHARS_PER_PASS = 10_000, 10_000_000
#: Slots, as a power of two, that tell most words that an item doesn't hold.
SLOT_BITS = 22
#: Seed hits, or window positions, that a worker holds at a time.
BLOCK = 1_000_000
#: Characters of text that a worker turns into arrays at a time.
CHUNK_CHARS = 4_000_000
_WORDS = re.compile(r"\w+")


def item_words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def allowed_edits(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def coordinates(n: int) -> int:
    """Symbols of an embedding in a key, for items of n words."""
    return 3 if n <= 100 else 2 if n <= 300 else 1


def embed(windows: np.ndarray, symbols: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """CGK embeddings, 3 n symbols each, of windows of n symbols. Step j advances at a symbol where the top bit of
    symbols[symbol] * steps[j] is set. The last entry of symbols is that of the padding, -1."""
    count, n = windows.shape
    padded = np.column_stack([windows, np.full(count, -1)])
    at, rows = np.zeros(count, np.int64), np.arange(count)
    out = np.empty((count, 3 * n), np.int64)
    for j in range(3 * n):
        symbol = padded[rows, at]
        out[:, j] = symbol
        at = np.minimum(n, at + ((symbols[symbol] * steps[j]) >> np.uint64(63)).astype(np.int64))
    return out


def edit_distance_within(item: np.ndarray, region: np.ndarray) -> int:
    """The least word edits between item and any stretch of region."""
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, x in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (region != x), row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min())


def spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of many numbers from first on: the number of the run, and the number, of each."""
    rows = np.repeat(np.arange(len(many)), many)
    return rows, np.repeat(first, many) + np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)


class Items:
    """The items of one pass: vocabulary, seeds, and LSH tables by item size."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, seed: int = 7):
        found = [(i, w) for i, t in items if (w := item_words(t))]
        self.ids = [i for i, _ in found]
        df = Counter(x for _, w in found for x in set(w))
        self.vocabulary = {x: k for k, x in enumerate(sorted(df))}
        self.other = len(self.vocabulary)  # any word that no item holds
        self.words = [np.array([self.vocabulary[x] for x in w]) for _, w in found]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.array([allowed_edits(n, similarity) for n in self.size], np.int64)
        seeds = []
        for k, (_, w) in enumerate(found):
            rare = sorted(range(len(w)), key=lambda j: (df[w[j]], -len(w[j]), j))[: self.edits[k] + 1]
            seeds += [(self.vocabulary[w[j]], k, j) for j in rare]
        seeds = np.array(sorted(seeds), np.int64).reshape(-1, 3)
        self.seed_item, self.seed_at = seeds[:, 1], seeds[:, 2]
        self.seed_first = np.searchsorted(seeds[:, 0], np.arange(self.other + 2))
        self.pairs = np.sort(np.concatenate([np.unique(w) + k * (self.other + 1) for k, w in enumerate(self.words)] or [np.empty(0, np.int64)]))
        self.maybe = np.zeros(1 << SLOT_BITS, bool)
        self.maybe[self.slot(self.pairs)] = True
        self.longest = int((self.size + 2 * self.edits).max(initial=0))
        self.seed, self.tables = seed, {}
        self.symbols = np.random.default_rng(seed).integers(0, 1 << 64, self.other + 2, np.uint64)

    @staticmethod
    def slot(pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def lsh(self, n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
        """The items of n words, and for each table: the walk's steps, coordinates, multipliers, and the items' keys in order with their items."""
        if n not in self.tables:
            mine = np.flatnonzero(self.size == n)
            stacked = np.stack([self.words[k] for k in mine])
            tables = []
            for e in range(EMBEDDINGS):
                rng = np.random.default_rng((self.seed, n, e))
                steps = rng.integers(0, 1 << 64, 3 * n, np.uint64) | np.uint64(1)
                embedded = embed(stacked, self.symbols, steps)
                for _ in range(TABLES):
                    at = rng.integers(0, 2 * n, coordinates(n))  # later symbols are mostly padding
                    by = rng.integers(1, 1 << 62, coordinates(n)) | 1
                    keys = (embedded[:, at] * by).sum(axis=1)
                    order = np.argsort(keys, kind="stable")
                    tables.append((steps, at, by, keys[order], order))
            self.tables[n] = mine, tables
        return self.tables[n]

    def collide(self, stream: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and items of n words that share a key in some table."""
        mine, tables = self.lsh(n)
        windows = stream[starts[:, None] + np.arange(n)]
        found, last = np.empty(0, np.int64), None
        for steps, at, by, keys, order in tables:
            if steps is not last:
                embedded, last = embed(windows, self.symbols, steps), steps
            own = (embedded[:, at] * by).sum(axis=1)
            low, high = (np.searchsorted(keys, own, side) for side in ("left", "right"))
            rows, hits = spread(low, high - low)
            found = np.union1d(found, rows * len(mine) + order[hits])
        return starts[found // len(mine)], mine[found % len(mine)]

    def near_seeds(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and the starts where both gates let them lie, one pair once."""
        first, many = self.seed_first[stream], self.seed_first[stream + 1] - self.seed_first[stream]
        where = np.flatnonzero((many > 0) & (stream != self.other))
        first, many = first[where], many[where]
        items, starts = [], []
        cuts = np.searchsorted(np.cumsum(many), np.arange(BLOCK, int(many.sum()) + BLOCK, BLOCK))
        for a, b in zip([0, *cuts + 1], [*cuts + 1, len(where)]):
            rows, hit = spread(first[a:b], many[a:b])
            start, item = where[a:b][rows] - self.seed_at[hit], self.seed_item[hit]
            both = np.unique((start + len(stream)) * len(self.ids) + item)
            start, item = both // len(self.ids) - len(stream), both % len(self.ids)
            rows = max(1, BLOCK // max(1, self.longest))
            for c in range(0, len(item), rows):
                i, s = item[c : c + rows], start[c : c + rows] - self.edits[item[c : c + rows]]
                span = (self.size + 2 * self.edits)[i]
                offsets = np.arange(int(span.max()))
                word = stream[np.clip(s[:, None] + offsets, 0, len(stream) - 1)]
                key = np.where(offsets < span[:, None], word, self.other) + i[:, None] * (self.other + 1)
                ok = np.flatnonzero(self.maybe[self.slot(key)].sum(axis=1) >= (self.size - self.edits)[i])  # may let more pass
                key = key[ok]
                held = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
                ok = ok[held.sum(axis=1) >= (self.size - self.edits)[i[ok]]]
                items.append(i[ok])
                starts.append(start[c : c + rows][ok])
        if not items:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(items), np.concatenate(starts)

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """Number of text, number of item and edit distance of each verified pair."""
        if not self.longest:
            return []
        gap, parts, begin, at = np.full(self.longest, self.other), [], [], self.longest
        parts.append(gap)
        for t in texts:
            found = np.fromiter(map(self.vocabulary.get, item_words(t), repeat(self.other)), np.int64)
            begin.append(at)
            parts += [found, gap]
            at += len(found) + len(gap)
        stream, begin = np.concatenate(parts), np.array(begin)
        item, start = self.near_seeds(stream)
        best: dict[tuple[int, int], int] = {}
        for n in np.unique(self.size[item]).tolist():
            k = allowed = int(self.edits[item[self.size[item] == n][0]])
            around = np.unique(start[self.size[item] == n][:, None] + np.arange(-k, k + 1))
            around = around[(around >= 0) & (around + n <= len(stream))]
            rows = max(1, BLOCK // (3 * n))
            for a in range(0, len(around), rows):
                s, i = self.collide(stream, n, around[a : a + rows])
                text = np.searchsorted(begin, s + n - 1, side="right") - 1  # a window's last word lies in its text or the gap behind
                for x in np.unique(i).tolist():
                    for d in np.unique(text[i == x]).tolist():
                        own = np.sort(s[(i == x) & (text == d)])
                        for part in np.split(own, np.flatnonzero(np.diff(own) > n) + 1):
                            low = max(int(part[0]) - k, 0)
                            distance = edit_distance_within(self.words[x], stream[low : int(part[-1]) + n + k])
                            if distance <= allowed:
                                best[d, x] = min(distance, best.get((d, x), distance))
        return [(d, x, e) for (d, x), e in sorted(best.items())]


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", items_per_pass: int = ITEMS_PER_PASS, with_text_keys: bool = False) -> DataFrame:
    """doc_id, item_id, n_words (of the item), distance (word edits) and similarity of each pair found; key1 and key2, hashes of the text, if with_text_keys."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text].alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    n, length = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(1, -(-n // items_per_pass), -(-length // CHARS_PER_PASS))
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id IS NOT NULL")
    keys = [f"key{k}" for k in (1, 2) if with_text_keys]
    own = own.select("*", *[F.xxhash64(F.lit(k + 1), F.col("text")).alias(key) for k, key in enumerate(keys)])
    out = None
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else items
        given = sorted((r[0], r[1]) for r in block.collect())  # items_per_pass items of CHARS_PER_PASS characters, about

        def found(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            known = Items(given, similarity)
            for pdf in batches:
                ids, texts, rows = pdf["doc_id"].tolist(), pdf["text"].tolist(), []
                more = list(zip(*[pdf[k].tolist() for k in keys])) or [()] * len(ids)
                for a, b in chunks([len(t or "") for t in texts], CHUNK_CHARS):
                    rows += [(ids[a + d], known.ids[x], int(known.size[x]), e, 1 - e / int(known.size[x]), *more[a + d]) for d, x, e in known.matches(texts[a:b])]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "distance", "similarity", *keys])

        part = own.mapInPandas(found, "doc_id long, item_id long, n_words long, distance long, similarity double" + "".join(f", {k} long" for k in keys))
        out = part if out is None else out.unionAll(part)
    return out.groupBy("doc_id", "item_id", *keys).agg(F.max("n_words").alias("n_words"), F.min("distance").alias("distance"), F.max("similarity").alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that hold no item. Texts decide, by two hashes of 64 bits; ids may be null or shared."""
    texts = docs.select(docs[text_col].alias("text")).withColumn("__row", F.monotonically_increasing_id())
    found = benchmark_matches(texts, benchmark, id_col="__row", with_text_keys=True, **how)
    keys = [F.xxhash64(F.lit(k), docs[text_col]) for k in (1, 2)]
    gone = found.select("key1", "key2").distinct()
    return docs.join(gone, (keys[0] == gone["key1"]) & (keys[1] == gone["key2"]), "left_anti")
