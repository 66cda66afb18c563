"""Substring dedup: word passages that stand in two places or more, found from fixed-block anchors.

Every ``BLOCK`` = 18 words from a document's start are a reference block. Any 35 consecutive words hold a whole block, so a passage that stands
twice has a block of its own at each place, and that block's words also stand elsewhere. Reference blocks are therefore the index,
and every rolling window of 18 words of all documents probes it. A block that another window equals is a hit; hits are extended to
both sides over all 35-word windows that hold them, and windows whose words start somewhere else too are joined to maximal exact repeats.

Words are hashed by Arrow batch: a rolling polynomial of bytes gives words, one of words gives windows. A task gathers some documents (a
chunk), keeps one of equal hashes, and sends it to the bucket that a hash's first bits name. So a passage that a third of all documents hold
reaches a bucket once per chunk, and a bucket holds about ``BUCKET`` bytes of text whatever the corpus. A bucket answers each chunk with the
blocks or windows that another chunk has as well; neither positions nor pairs of places ever meet in one group. Blocks are compared by
32 bits besides their bucket's, which may only add candidates; windows by 96 bits, from two independent polynomials.

Defined cases: a null text has no word; texts under 35 words keep all words; very long texts are hashed piece by piece; rows with a null
doc_id and rows that share one are documents like others, each judged by its own text, and repeated rows repeat each other; an empty table
gives no rows; other columns pass through, and those made have a prefix that the caller chooses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, stored, words

WINDOW = 35
#: Words of a reference block: each window of WINDOW words holds a whole one.
BLOCK = (WINDOW + 1) // 2
#: Bytes of text whose windows a bucket holds on average, at most; words of a chunk; bytes that are hashed at a time.
BUCKET, CHUNK_WORDS, PIECE = 1 << 21, 1 << 20, 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_EXCHANGE = "key long, chunk long, kind int, a binary, b binary"


_grown: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of them at least."""
    if base not in _grown or len(_grown[base][0]) < n:
        out = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(1 << max(16, (n - 1).bit_length()), x, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _grown[base] = (out[0], out[1])
    return _grown[base]


def _sums(x: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _powers(base, len(x))[0][: len(x)], out=out[1:])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, cuts: np.ndarray, lanes: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of UTF-8 bytes, cut into documents at cuts (first and last included): how many words lie before each cut, and the words' hashes."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    wide = data.astype(np.uint64) + np.uint64(1)
    out = []
    for base in _BASES[:lanes]:
        c = _sums(wide, base)
        out.append(_mixed((c[e] - c[s]) * _powers(base, len(data))[1][s] + (e - s).astype(np.uint64)))
    return np.searchsorted(s, cuts), out


def window_hashes(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """The hash of each window of so many words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c = _sums(hashes, base)
    return _mixed((c[width:] - c[:-width]) * _powers(base, n)[1][:n])


def _pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Parts of one text, cut at white space."""
    at, blanks = 0, np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    while at < len(data):
        k = np.searchsorted(blanks, at + size)
        end = int(blanks[k]) if k < len(blanks) else len(data)
        yield data[at:end]
        at = end


def hashed_documents(column: pa.Array, lanes: int = 1, size: int = PIECE) -> Iterator[tuple[int, int, bool, list[np.ndarray]]]:
    """(row, word offset, whether it is the last, hashes of its words per lane) of each part of each text; parts of a text overlap by WINDOW - 1 words."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        if offsets[to] - offsets[row] <= size:
            cuts, found = word_hashes(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], lanes)
            for k in range(to - row):
                yield row + k, 0, True, [h[cuts[k] : cuts[k + 1]] for h in found]
        else:  # a text longer than a piece, alone
            at, tail = 0, [np.empty(0, np.uint64)] * lanes
            for part in _pieces(data[offsets[row] : offsets[to]], size):
                _, found = word_hashes(part, np.array([0, len(part)]), lanes)
                whole = [np.concatenate([t, h]) for t, h in zip(tail, found, strict=True)]
                keep = min(WINDOW - 1, len(whole[0]))
                yield row, at, False, whole
                at, tail = at + len(whole[0]) - keep, [h[len(h) - keep :] for h in whole]
            yield row, at, True, tail
        row = to


def _packed(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, which compress where the high ones are equal."""
    if not len(x):
        return b""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _rows(found: list[tuple]) -> pa.RecordBatch:
    key, chunk, kind, a, b = zip(*found, strict=True)
    return pa.record_batch([pa.array(key, pa.int64()), pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["key", "chunk", "kind", "a", "b"])


#: Kinds of exchanged rows: hashes that a chunk sends to a bucket, what a bucket or the chunk itself has found, and the chunk's documents.
_SENT, _FOUND, _DOCS = 0, 1, 2


class _Chunks:
    """Numbers the chunks of a task; the same input gives the same numbers."""

    def __init__(self):
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 32
        self.clear()

    def clear(self) -> None:
        self.docs, self.hashes, self.marks, self.size = [], [], [], 0

    def close(self) -> int:
        self.clear()
        self.next += 1
        return self.next - 1


def _sent(chunk: int, bits: int, top: np.ndarray, hashes: list[np.ndarray], refs: np.ndarray, chosen: np.ndarray, delta: bool) -> list[tuple]:
    """Rows that carry sorted hashes to their buckets; chosen says which of them want an answer, for the number in refs."""
    bucket = top >> np.uint64(64 - bits) if bits else np.zeros(len(top), np.uint64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    out = []
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = [np.diff(h[x:y], prepend=h.dtype.type(0)) if delta else h[x:y] for h in hashes]
        wants = np.flatnonzero(chosen[x:y]).astype(np.uint32)
        out.append((int(bucket[x]), chunk, _SENT, b"".join(_packed(h) for h in own), _packed(np.concatenate([wants, refs[x:y][wants].astype(np.uint32)]))))
    return out


def _probes(bits: int):
    """Blocks and rolling windows of all documents, chunk by chunk; parts are (id, hash of the text, word offset, first block)."""

    def flushed(c: _Chunks) -> list[tuple]:
        h = np.concatenate(c.hashes)
        block = np.concatenate(c.marks)  # the number of the window's block, or -1
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(h)))
        block = block[order]
        again = block[np.repeat(n, n) > 1]
        u, own = h[first], block[first]
        short = ((u >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out = _sent(c.next, bits, u, [short], own, (n == 1) & (own >= 0), True)
        key = -1 - c.next
        out.append((key, c.next, _FOUND, _packed(again[again >= 0].astype(np.uint32)), b""))
        out.append((key, c.next, _DOCS, np.array(c.docs, np.int64).tobytes(), b""))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, blocks = _Chunks(), 0
        for batch in batches:
            ids, marks = batch.column("id").to_pylist(), batch.column("th").to_pylist()
            for row, at, last, (h,) in hashed_documents(batch.column("text")):
                if at == 0 and last and len(h) < WINDOW:
                    continue
                w = window_hashes(h, BLOCK, _BASES[0])
                if not last:  # the rest comes with the next part
                    w = w[: max(0, len(h) - WINDOW + 1)]
                if not len(w):
                    continue
                place = at + np.arange(len(w))
                mine = np.where(place % BLOCK == 0, place // BLOCK - at // BLOCK + blocks, -1)
                c.docs.append((ids[row], marks[row], at // BLOCK, blocks))
                blocks += len(w) // BLOCK + 2
                c.hashes.append(w)
                c.marks.append(mine)
                c.size += len(w)
                if c.size >= CHUNK_WORDS:
                    yield _rows(flushed(c))
                    c.close()
                    blocks = 0
        if c.size:
            yield _rows(flushed(c))

    return run


def _repeated(columns: list[np.ndarray]) -> np.ndarray:
    """Which rows stand in the columns twice or more."""
    order = np.lexsort(columns[::-1])
    same = np.logical_and.reduce([(c := x[order])[1:] == c[:-1] for x in columns])
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    out = np.empty(len(order), bool)
    out[order] = hit
    return out


def _resolver(widths: tuple[int, ...]):
    """What a bucket tells each chunk: the numbers of those hashes that another chunk has sent too."""

    def run(table: pa.Table) -> pa.Table:
        kind = np.array(table.column("kind"))
        rest = table.filter(pa.array(kind != _SENT))
        if len(rest) == len(table):
            return table
        chunks, sent, wanted = (table.column(c).to_pylist() for c in ("chunk", "a", "b"))
        parts = []
        for a in sent:
            n, at, own = len(a) // sum(widths), 0, []
            for width in widths:
                own.append(_unpacked(a[at : at + n * width], {4: np.uint32, 8: np.uint64}[width]))
                at += n * width
            parts.append([np.cumsum(own[0], dtype=np.uint32)] if len(own) == 1 else own)
        hit, before, out = _repeated([np.concatenate(x) for x in zip(*parts, strict=True)]), 0, []
        for chunk, mine, b in zip(chunks, parts, wanted, strict=True):
            at, refs = _unpacked(b, np.uint32).reshape(2, -1)
            if len(refs := refs[hit[before + at]]):
                out.append((-1 - chunk, chunk, _FOUND, _packed(refs), b""))
            before += len(mine[0])
        return pa.Table.from_batches([_rows(out)] if out else [], table.schema)

    return run


def _answers(table: pa.Table) -> tuple[np.ndarray, bytes]:
    """The sorted numbers found for a chunk, and its documents."""
    kind, a = table.column("kind").to_pylist(), table.column("a").to_pylist()
    found = [_unpacked(x, np.uint32) for k, x in zip(kind, a, strict=True) if k == _FOUND and x]
    docs = next((x for k, x in zip(kind, a, strict=True) if k == _DOCS), b"")
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32), docs


_MARKED = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("marks", pa.binary())])


def _marked_blocks(table: pa.Table) -> pa.Table:
    """id, th and the numbers of hit blocks of each part of a document that has any."""
    found, docs = _answers(table)
    parts = np.frombuffer(docs, np.int64).reshape(-1, 4)
    at = np.searchsorted(found, np.append(parts[:, 3], 1 << 32))
    rows = [(int(p[0]), int(p[1]), (found[x:y].astype(np.int64) - p[3] + p[2]).tobytes()) for p, x, y in zip(parts, at[:-1], at[1:], strict=True) if y > x]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else ([], [], []), _MARKED, strict=True)], schema=_MARKED)


def _windows(bits: int):
    """The windows around hit blocks, chunk by chunk; runs are (id, hash of the text, first word, first number)."""

    def flushed(c: _Chunks) -> list[tuple]:
        x, y = (np.concatenate(h) for h in zip(*c.hashes, strict=True))
        number = np.arange(len(x))
        order = np.lexsort((y, x))
        x, y, number = x[order], y[order], number[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(x)))
        out = _sent(c.next, bits, x[first], [x[first], y[first]], number[first], n == 1, False)
        key = -1 - c.next
        out.append((key, c.next, _FOUND, _packed(number[np.repeat(n, n) > 1].astype(np.uint32)), b""))
        out.append((key, c.next, _DOCS, np.array(c.docs, np.int64).tobytes(), b""))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _Chunks()
        for batch in batches:
            ids, own, blocks = (batch.column(n).to_pylist() for n in ("id", "th", "blocks"))
            for row, at, _, lanes in hashed_documents(batch.column("text"), lanes=2):
                n = len(lanes[0]) - WINDOW + 1
                if n <= 0:
                    continue
                places = BLOCK * np.frombuffer(b"".join(blocks[row]), np.int64) - at
                places = places[(places >= 0) & (places < n + BLOCK - 1)]
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.maximum(0, places - (WINDOW - BLOCK)), 1)
                np.add.at(edge, np.minimum(n, places + 1), -1)
                near = np.cumsum(edge[:-1]) > 0
                if not near.any():
                    continue
                x, y = (window_hashes(h, WINDOW, b)[near] for h, b in zip(lanes, _BASES, strict=True))
                step = np.diff(near.astype(np.int8), prepend=np.int8(0))
                starts = np.flatnonzero(step == 1)
                before = np.cumsum(near)[starts] - 1
                c.docs += [(ids[row], own[row], int(s) + at, int(b) + c.size) for s, b in zip(starts, before, strict=True)]
                c.hashes.append((x, (y >> np.uint64(32)).astype(np.uint32)))
                c.size += len(x)
                if c.size >= CHUNK_WORDS:
                    yield _rows(flushed(c))
                    c.close()
        if c.size:
            yield _rows(flushed(c))

    return run


_REPEATS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _repeats(table: pa.Table) -> pa.Table:
    """id, th, start, end of each stretch of repeated windows of a chunk."""
    found, docs = _answers(table)
    runs = np.frombuffer(docs, np.int64).reshape(-1, 4)
    run = np.searchsorted(runs[:, 3], found, "right") - 1
    place = runs[run, 2] + found - runs[run, 3]
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (place[1:] - place[:-1] > 1)]) if len(found) else np.empty(0, bool)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(found)) - 1 if len(a) else a
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((runs[run[a], 0], runs[run[a], 1], place[a], place[z] + WINDOW), _REPEATS, strict=True)], schema=_REPEATS)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th and text: rows of the same id and th have the same text."""
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(docs[id_col].isNull(), docs[text_col]).alias("th"), docs[text_col].alias("text"))


def _exchanged(rows: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    return rows.groupBy("key").applyInArrow(_resolver(widths), _EXCHANGE)


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (as in _keyed) and spans, the maximal stretches (start, end in words) of repeated windows, of each document that has any.

    Spans are by start, and so by end; two may overlap. A piece of a very long text ends a span."""
    own = _keyed(docs, id_col, text_col)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size // BUCKET)).bit_length()
    hits = stored(_exchanged(own.mapInArrow(_probes(bits), _EXCHANGE), (4,)).groupBy("chunk").applyInArrow(_marked_blocks, "id long, th long, marks binary"))
    blocks = hits.groupBy("id", "th").agg(F.collect_set("marks").alias("blocks"))
    # one order, so that a task which runs again numbers its chunks alike
    near = own.join(blocks, ["id", "th"]).sortWithinPartitions("id", "th").select("id", "th", "text", "blocks")
    found = _exchanged(near.mapInArrow(_windows(bits), _EXCHANGE), (8, 4)).groupBy("chunk").applyInArrow(_repeats, "id long, th long, start int, end int")
    return stored(found.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")))


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: str = "kept") -> DataFrame:
    """All rows and columns of docs, with {prefix}_words, {prefix}_removed (counts), {prefix}_spans (what is removed, in words) and {prefix}_text
    (words left, joined by a space), which replace columns of these names."""
    mine = {f"{prefix}_words", f"{prefix}_removed", f"{prefix}_spans", f"{prefix}_text"}
    found = repeats(docs, id_col=id_col, text_col=text_col).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "spans")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[id_col].cast("long"), F.lit(0).cast("long")).alias("__i"), F.xxhash64(docs[id_col].isNull(), docs[text_col]).alias("__t"))
    joined = row.join(found.hint("shuffle_hash"), (F.col("__i") == F.col("__id")) & (F.col("__t") == F.col("__th")), "left")
    joined = joined.select("row", words(F.col("row")[text_col]).alias("words"), F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"))
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["end"])
    end = lambda i: F.coalesce(F.get("spans", i)["start"], F.size("words"))
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: let(F.struct(start(i).alias("a"), end(i).alias("b")), lambda r: F.slice("words", r["a"] + 1, F.greatest(F.lit(0), r["b"] - r["a"])))))
    joined = joined.select("row", "words", "spans", F.when(F.size("spans") == 0, F.col("words")).otherwise(left).alias("left"))
    return joined.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in mine],
        F.size("words").cast("long").alias(f"{prefix}_words"), (F.size("words") - F.size("left")).cast("long").alias(f"{prefix}_removed"), F.col("spans").alias(f"{prefix}_spans"),
        F.array_join("left", " ").alias(f"{prefix}_text"),
    )
