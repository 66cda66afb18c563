"""Best-fit packing of tokenized documents into sequences of at most ``max_tokens``.

Documents are tokenized where they lie; only those longer than a sequence are cut. What packing needs of all pieces is
how many there are of each length: at most ``max_tokens`` counts, whatever the size of the corpus. Bin completion plans
on these counts: around the largest piece left it enumerates all undominated fillings that waste no more than the
incumbent (best-fit decreasing at first) leaves to a better plan, applies one as often as the counts allow or less often, and
goes on with the rest. The search ends when the incumbent meets a lower bound, when no filling is left (both prove the plan),
or after ``MAX_NODES`` nodes or ``MAX_STEPS`` steps within them (``proved`` is false then). The plan is a short list of patterns with repetitions. Each piece
then finds its place by its rank among the pieces of its length, counted in salted groups, so that neither a common length nor
the plan gathers pieces in one task.

Defined cases: null text is the empty text, which is one piece holding only the end id; rows that repeat a doc_id are
packed as documents of their own; a null doc_id is kept, and an id is cast to long; a very long text is cut into as many
pieces as it needs; equal lengths are told apart by (doc_id, piece, crc); an empty table gives no rows; other columns of docs,
whatever their names, don't enter.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, shuffle_partitions, stored

MAX_TOKENS = 4096
END_ID = 1
#: Words whose ids one Python worker remembers; half of them go at a time.
CACHE_WORDS = 400_000
#: Bytes of text whose words are looked up at once.
GROUP_BYTES = 2_000_000
#: Nodes of the search, and steps of enumeration in all nodes; beyond them the incumbent stands, and the plan says that it
#: isn't proved.
MAX_NODES, MAX_STEPS = 10_000, 300_000

# The parts of a tokenizer file that make it one that works word by word.
WORD_END = "</w>"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            _BYTES,
        ],
    },
    "post_processor": None,
}
#: For parts that are lower-cased, composed, and either letters or marks alone.
LEAN = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _BYTES]}
#: Letters of Latin-1 and Latin Extended-A whose small form is one letter, then ASCII marks other than the apostrophe.
LATIN_WORD = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-įĲ-ſ]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: What a part of such a word looks like.
PART = re.compile(r"[a-zß-öø-įĲ-ſ]+|[!-&(-/:-@\[-`{-~]+").fullmatch


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def gathered(flat: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat holds units of these sizes, one after the other: the units by order, one after the other, and where each ends."""
    many = size[order]
    ends = np.cumsum(many)
    start = np.cumsum(size) - size
    return flat[np.arange(int(many.sum())) + np.repeat(start[order] - (ends - many), many)], ends


class WordIds:
    """Token ids of texts, remembered by word where the tokenizer allows it.

    A tokenizer of the form ``BY_WORD`` drops white space and never joins words across it, so a text's ids are its words'
    ids in order. It lower-cases, and cuts letters from the marks behind them; a word of Latin letters and marks is so
    made of at most two parts, each a unit that merges work on alone. Arrow finds the distinct words of a group of texts and
    their parts. New parts are encoded many at a time, as one text of parts with blanks between, by the same model without
    the steps that change nothing in them; each part ends with the one id that ends a word. All other words go through
    the whole tokenizer. For a tokenizer of another form whole texts do."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        self.tokenizer, self.most = _tokenizer(path), most
        form = json.loads(self.tokenizer.to_str())
        vocabulary = form["model"]["vocab"] if form["model"]["type"] == "BPE" else {}
        self.by_word = {k: form[k] for k in BY_WORD} == BY_WORD and form["model"]["end_of_word_suffix"] == WORD_END
        if self.by_word:
            lean = form | {"normalizer": None, "added_tokens": [], "pre_tokenizer": LEAN}
            self.lean = type(self.tokenizer).from_str(json.dumps(lean))
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[k for x, k in vocabulary.items() if x.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.held = 0  # characters of known words

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        if not parts:
            return []
        ids = np.array(self.lean.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(parts):
            return self._whole(parts)
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def _ids(self, words: list[str]) -> list[bytes]:
        new = [x for x in words if x not in self.known]
        self.held += sum(map(len, new))
        if len(self.known) + len(new) > self.most // 2 or self.held > 8 * self.most:  # the old half of the memory goes
            self.old, self.known, self.held = self.known, {"": b""}, 0
            new = [x for x in words if x]
        known, old = self.known, self.old
        known.update({x: old[x] for x in new if x in old})
        parts = [x for x in new if x not in known and PART(x)]
        known.update(zip(parts, self._parts(parts)))
        others = [x for x in new if x not in known]
        known.update(zip(others, self._whole(others)))
        return [known[x] for x in words]

    def of_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings that aren't null), one after the other, and where each text's end."""
        if not self.by_word:
            found = self._whole(texts.to_pylist())
            return np.frombuffer(b"".join(found), "<u4"), np.cumsum([len(x) // 4 for x in found], dtype=np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        found = pc.extract_regex(coded.dictionary, LATIN_WORD)
        first = pc.coalesce(pc.utf8_lower(pc.struct_field(found, "letters")), coded.dictionary)
        units = pa.concat_arrays([first, pc.coalesce(pc.struct_field(found, "marks"), "")]).dictionary_encode()
        packed = self._ids(units.dictionary.to_pylist())
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        parts = units.indices.to_numpy().reshape(2, -1).T.ravel()  # two of each distinct word
        flat, ends = gathered(np.frombuffer(b"".join(packed), "<u4"), size, parts)
        ids, ends = gathered(flat, np.diff(ends[1::2], prepend=0), coded.indices.to_numpy())
        last = lists.offsets.to_numpy()
        return ids, np.concatenate([[0], ends])[last[1:] - last[0]]

    def of(self, text: str | None) -> bytes:
        """The packed ids of a text."""
        return self.of_all(pa.array([text or ""]))[0].tobytes()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, *, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its ids (packed 32-bit little-endian) if with_ids."""
    end, names = struct.pack("<I", end_id), ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer_path)
        for batch in batches:
            texts, docs_of = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in chunks(pc.binary_length(texts).to_pylist(), GROUP_BYTES):
                ids, ends = known.of_all(texts.slice(a, b - a))
                out, at = [], 0
                for doc, last in zip(docs_of[a:b], ends.tolist(), strict=True):
                    packed, at = ids[at:last].tobytes() + end, last
                    for k in range(0, len(packed), 4 * max_tokens):
                        part = packed[k : k + 4 * max_tokens]
                        out.append((doc, k // (4 * max_tokens), k // 4, len(part) // 4, zlib.crc32(part), part))
                columns = list(zip(*out))[: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).mapInArrow(cut, kind)


def _reach(lengths: list[int], counts: np.ndarray, room: int) -> list[int]:
    """Bit sets of sums to room: item k has those of the lengths from k on (longest first), within their counts."""
    full, sums = (1 << (room + 1)) - 1, [1]
    for x in reversed(lengths):
        now, left, step = sums[-1], min(int(counts[x]), room // x), 1
        while left:
            k = min(step, left)
            now |= (now << (k * x)) & full
            left, step = left - k, 2 * step
        sums.append(now)
    return sums[::-1]


def _above(sums: int, spare: int) -> int:
    """Each sum of a bit set plus 1 to spare."""
    wide, reach = sums << 1, 1
    while reach < spare:
        k = min(reach, spare - reach)
        wide |= wide << k
        reach += k
    return wide if spare else 0


class Work:
    """Steps that a search may still take."""

    def __init__(self, steps: int):
        self.left = steps


def fillings(counts: np.ndarray, room: int, waste: int, work: Work | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of a room that leave at most waste of it, by lengths available in counts (index is
    length), least waste first and longer pieces before shorter ones; fewer if the work runs out.

    A filling is dominated where one more piece fits, or where a piece that it leaves could take the place of several of
    its pieces or of a shorter one. A branch ends at a sum out of reach, and at the first pieces that are dominated."""
    work = work or Work(1 << 62)
    lengths = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    reach = _reach(lengths, counts, room)
    work.left -= len(lengths)
    open_from = [0]  # bit sets of the lengths from an index on
    for x in reversed(lengths):
        open_from.append(open_from[-1] | 1 << x)
    open_from.reverse()
    for aim in range(room, max(0, room - waste) - 1, -1):
        if not (reach[0] >> aim) & 1:
            continue
        spare = room - aim
        # index of the next length, room left, pieces, sums of one or more and of two or more, and longer lengths with pieces left
        stack: list[tuple[int, int, tuple[int, ...], int, int, int]] = [(0, aim, (), 0, 0, 0)]
        while stack and work.left > 0:
            at, left, fill, one, more, free = stack.pop()
            work.left -= 1
            if (more | _above(one | more, spare)) & free:
                continue
            if not left:
                if not (more | _above(1 | one | more, spare)) & (free | open_from[at]):
                    yield fill
                continue
            x = lengths[at]
            most = min(int(counts[x]), left // x)
            pushed = []
            for k in range(most + 1):
                if k:
                    more |= (one | more) << x
                    one |= 1 << x
                if (reach[at + 1] >> (left - k * x)) & 1:
                    pushed.append((at + 1, left - k * x, fill + (x,) * k, one, more, free | (1 << x if counts[x] > k else 0)))
            stack += pushed  # the last one pushed, most of the longest, comes first


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Sequences that any plan needs: by tokens, and by pieces that can't share a sequence with those above a limit."""
    at = np.arange(size + 1)
    n, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * at)])  # of lengths below
    k = np.arange(size // 2 + 1)
    large, half = n[size + 1] - n[size - k + 1], size // 2 + 1
    middle, middle_tokens = n[size - k + 1] - n[half], tokens[size - k + 1] - tokens[half]
    rest = tokens[half] - tokens[k] - (middle * size - middle_tokens)
    return int((large + middle + np.maximum(0, -(-rest // size))).max())


Pattern = tuple[tuple[int, ...], int]


def best_fit_decreasing(counts: np.ndarray, size: int) -> list[Pattern]:
    """Longest pieces first, each into the fullest sequence that still takes it; equal sequences are filled together."""
    bins: dict[int, list[list]] = {}  # room left -> [pieces, how many sequences]
    for x in range(size, 0, -1):
        n = int(counts[x])
        while n:
            room = next((r for r in range(x, size) if bins.get(r)), None)
            if room is None:
                per = size // x
                for k, many in ((per, n // per), (n % per, 1)):
                    if k and many:
                        bins.setdefault(size - k * x, []).append([(x,) * k, many])
                break
            held, many = bins[room][-1]
            k = min(n, many)
            bins[room][-1][1] -= k
            if not bins[room][-1][1]:
                bins[room].pop()
            bins.setdefault(room - x, []).append([(*held, x), k])
            n -= k
    return [(held, many) for group in bins.values() for held, many in group]


class Plan(NamedTuple):
    patterns: list[Pattern]  # lengths, and how many sequences take them
    sequences: int
    proved: bool  # no plan has fewer sequences
    nodes: int  # of the search


def plan(counts: np.ndarray, size: int = MAX_TOKENS, *, max_nodes: int = MAX_NODES, max_steps: int = MAX_STEPS) -> Plan:
    """Patterns of lengths and how many sequences take each, using up counts (index is length, to size).

    The fewest sequences where proved; the search is exhaustive unless it meets max_nodes or max_steps."""
    counts = np.asarray(counts, np.int64).copy()
    whole = int(counts[size])
    counts[size] = 0
    head: list[Pattern] = [((size,), whole)] if whole else []
    total = int((counts * np.arange(size + 1)).sum())
    if not total:
        return Plan(head, whole, True, 0)
    least = lower_bound(counts, size)
    best = best_fit_decreasing(counts, size)
    most = sum(m for _, m in best)
    nodes, used, rest, work = 0, 0, total, Work(max_steps)
    seen: dict[bytes, int] = {}  # a digest of what was left, and the fewest sequences used before it

    def steps() -> Iterator[Pattern]:
        """The fillings around the longest piece left, each as often as the counts allow, then less often."""
        first = int(np.flatnonzero(counts)[-1])
        others = counts.copy()
        others[first] -= 1
        for fill in fillings(others, size - first, (most - 1 - used) * size - rest, work):
            held = (first, *fill)
            lengths, k = np.unique(held, return_counts=True)
            for many in range(int((counts[lengths] // k).min()), 0, -1):
                yield held, many

    def options() -> Iterator[Pattern]:
        """steps(), some at a time: a level of the search that waits for those below holds few of them and no sums."""
        done, some = 0, 4
        while found := list(islice(steps(), done, done + some)):
            yield from found
            done, some = done + some, 4 * some

    # Depth first. A level holds the fillings not yet tried; what is used so far, in sequences and in waste, bounds it.
    path: list[Pattern] = []
    levels = [options()]
    while levels and most > least and nodes < max_nodes and work.left > 0:
        step = next(levels[-1], None)
        if step is None:
            levels.pop()
            if path:
                held, many = path.pop()
                for x in held:
                    counts[x] += many
                used, rest = used - many, rest + many * sum(held)
            continue
        held, many = step
        nodes += 1
        if used + many + math.ceil((rest - many * sum(held)) / size) >= most:
            continue  # its waste leaves no plan better than the incumbent
        for x in held:
            counts[x] -= many
        path.append(step)
        used, rest = used + many, rest - many * sum(held)
        key = hashlib.blake2b(counts.tobytes(), digest_size=16).digest()
        if not rest:
            best, most = list(path), used
            levels.append(iter(()))
        elif seen.get(key, most) <= used or used + lower_bound(counts, size) >= most:
            levels.append(iter(()))
        else:
            seen[key] = used
            levels.append(options())
    return Plan(head + best, whole + most, most <= least or (not levels and work.left > 0), nodes)


def places(patterns: list[Pattern]) -> pd.DataFrame:
    """The plan by length: ranks from first_rank on take sequences from first_sequence on, times of them, at offset."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for held, many in patterns:
        at = 0
        for x in held:
            rank = taken.get(x, 0)
            rows.append((x, rank, base, at))
            taken[x] = rank + many
            at += x
        base += many
    return pd.DataFrame(rows, columns=["length", "first_rank", "first_sequence", "offset"], dtype="int64").sort_values(["length", "first_rank"], kind="stable").reset_index(drop=True)


def ranked(rows: DataFrame, salts: int) -> DataFrame:
    """rows with rank: a number from 0, without gaps, among the rows of equal length."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    per = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return rows.withColumn("own", F.row_number().over(own)).join(per, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)


def pack(docs: DataFrame, tokenizer_path: str, *, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset; proved says whether no packing has fewer sequences."""
    found = pieces(docs, tokenizer_path, max_tokens=max_tokens, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids)
    found = stored(found)
    counts = np.zeros(max_tokens + 1, np.int64)
    for length, n in found.groupBy("length").agg(F.count("*")).collect():  # max_tokens rows at most
        counts[length] = n
    best = plan(counts, max_tokens)
    table = places(best.patterns)
    key = (table["length"].to_numpy() << 44) + table["first_rank"].to_numpy()  # ranks stay below 2 ** 44
    rank0, sequence0, offset = (table[c].to_numpy() for c in ("first_rank", "first_sequence", "offset"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = np.searchsorted(key, (pdf["length"].to_numpy() << 44) + pdf["rank"].to_numpy(), side="right") - 1
            yield pdf.drop(columns=["rank"]).astype({"doc_id": "Int64"}).assign(sequence_id=sequence0[k] + pdf["rank"].to_numpy() - rank0[k], offset=offset[k])

    columns = [c for c in found.columns]
    kind = ", ".join(f"{c} {t}" for c, t in found.dtypes) + ", sequence_id long, offset long"
    return ranked(found, shuffle_partitions(docs.sparkSession)).select(*columns, "rank").mapInPandas(placed, kind).withColumn("proved", F.lit(best.proved))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (packed 32-bit little-endian) of each sequence, from pack(..., with_ids=True)."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate(F.transform("parts", lambda p: p["ids"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return parts.select("sequence_id", joined.alias("ids"))
