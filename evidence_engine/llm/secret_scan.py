"""Secret scans: three base patterns, and strings whose sliding-window entropy is too high for words.

A candidate string is a run of token characters. Each character class (hexadecimal, alphanumeric, base64) slides a
window of its own over the stretches of its characters; the window's Shannon entropy follows from counts that change by
one character in and one out, for the stretches of many texts at a time. Windows above the class's limit are merged to
spans, unless an allow-list suppresses them: whole candidates of known forms, windows with the mix of characters that numbers, words and
names have, and examples. Base spans are never suppressed.

Offsets are code points, ends exclusive. The time of a text grows with its length, also where it is one run or holds many spans.
Defined cases: null and empty texts have no span; very long texts are scanned whole; rows are scanned one by one, so repeated rows
get equal results; a null doc_id is kept, and an id is cast to long; an empty table gives no rows; other columns of docs,
whatever their names, don't enter. Spans of one start come in the order of the kinds.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
MIN_ASSIGN, MIN_ACCESS = 12, 18

#: name, characters, window, least entropy in bits, least share of digits and of letters in a window
CLASSES = (
    ("hex", "0123456789abcdefABCDEF", 20, 2.8, 0.2, 0.1),
    ("alnum", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 20, 3.5, 0.15, 0.2),
    ("base64", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-", 24, 3.8, 0.1, 0.2),
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
_MIXED = re.compile(r"[0-9A-Z]")  # no class admits a window of small letters alone
#: Whole candidates that are known to be harmless: identifiers, dates and versions in words, one repeated unit.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"(.{1,4})\1{3,}.{0,3}"),
    re.compile(r"[0-9_=+/-]+"),
    re.compile(r"[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{1,8}(?:[-_/][A-Za-z0-9]{1,8})*"),
)

#: What a hot stretch itself may hold to be an example; the rest of its candidate doesn't matter.
_EXAMPLE = re.compile(r"(?i:example|sample|placeholder|changeme|xxxx)")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


#: Windows that one run of counts covers; longer runs are cut, so that a batch takes few steps.
STRETCH = 256
#: Characters of candidates that are scanned at a time.
TOGETHER = 1 << 21
_LOGS = np.concatenate([[0.0], np.arange(1, 256) * np.log2(np.arange(1, 256))])


def window_entropies(codes: np.ndarray, starts: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Shannon entropy in bits of the windows of some runs of codes (below 128): run k has windows[k] of them, from starts[k] on. Results come run by run.

    Each run holds its counts of characters. A step moves the windows of all runs on by one: one character goes out and one comes in, and
    the sum of k log k over the counts k changes by these two counts alone; entropy is log2(window) less that sum over window."""
    pieces = -(-windows // STRETCH)
    run = np.repeat(np.arange(len(windows)), pieces)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, size = starts[run] + nth * STRETCH, np.minimum(STRETCH, windows[run] - nth * STRETCH)
    place = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    begin, size, place = begin[order], size[order], place[order]
    counts, total = np.zeros((len(run), 128), np.uint8), np.zeros(len(run))
    out, rows = np.empty(int(size.sum())), np.arange(len(run))

    def moved(n: int, at: np.ndarray, by: int) -> None:
        was = counts[rows[:n], at]
        counts[rows[:n], at] = was + by if by > 0 else was - 1
        total[:n] += _LOGS[was + by if by > 0 else was - 1] - _LOGS[was]

    for k in range(window):
        moved(len(run), codes[begin + k], 1)
    out[place] = total
    alive = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "left")  # runs with more windows than so many
    for t in range(1, int(size.max(initial=0))):
        n = int(alive[t - 1])
        moved(n, codes[begin[:n] + t - 1], -1)
        moved(n, codes[begin[:n] + t + window - 1], 1)
        out[place[:n] + t] = total[:n]
    return math.log2(window) - out / window


def _held(which: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """How many of the width places from each of at on are set."""
    total = np.concatenate([[0], np.cumsum(which)])
    return total[at + width] - total[at]


def _like_words(codes: np.ndarray, at: np.ndarray, window: int, digits: float, letters: float, mixed: bool) -> np.ndarray:
    """The allow-list's rule on the mix of characters: windows that have too few letters, or too few digits (mixed: and neither a digit with
    two letters of each case nor many changes of case, as names in camel case don't) are numbers, words or names."""
    digit, lower, upper = ((codes >= a) & (codes <= b) for a, b in (b"09", b"az", b"AZ"))
    n_digits, n_lower, n_upper = (_held(x, at, window) for x in (digit, lower, upper))
    many = n_digits >= digits * window
    if mixed:
        changes = np.concatenate([(lower[:-1] & upper[1:]) | (upper[:-1] & lower[1:]), [False]])
        many |= (n_digits > 0) & (n_lower >= 2) & (n_upper >= 2)
        many |= (np.minimum(n_lower, n_upper) >= 0.35 * window) & (_held(changes, at, window - 1) >= 6)
    return ~many | (n_lower + n_upper < letters * window)


def _hot(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, least: float, digits: float, letters: float, mixed: bool) -> np.ndarray:
    """Starts of the windows of the runs whose entropy reaches the limit and that the allow-list doesn't know."""
    fit = ends - starts >= window
    starts, windows = starts[fit], (ends - starts)[fit] - window + 1
    if not len(starts):
        return np.empty(0, np.int64)
    at = np.repeat(starts - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
    at = at[window_entropies(codes, starts, windows, window) >= least - 1e-9]
    return at[~_like_words(codes, at, window, digits, letters, mixed)]


def hot_windows(run: str, window: int, least: float, digits: float, letters: float, *, mixed: bool = False) -> np.ndarray:
    """Starts of the windows of one run that become part of a span."""
    return _hot(np.frombuffer(run.encode(), np.uint8), np.array([0]), np.array([len(run)]), window, least, digits, letters, mixed)


def _members(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_MEMBERS = {name: _members(chars) for name, chars, *_ in CLASSES}


def _stretches(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[False], which, [False]]).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _hot_stretches(candidates: list[str]) -> list[tuple[int, int, int]]:
    """(candidate, start, end) of the merged hot windows of any class, over all candidates at once."""
    codes = np.frombuffer("\0".join([*candidates, ""]).encode(), np.uint8)  # windows never cross the zeros
    first = np.cumsum([0, *(len(c) + 1 for c in candidates)])
    edges = np.zeros(len(codes) + 1, np.int64)
    for name, _, window, least, digits, letters in CLASSES:
        starts = _hot(codes, *_stretches(_MEMBERS[name][codes]), window, least, digits, letters, name != "hex")  # hex is of one case as a rule
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + window, -1)
    a, b = _stretches(np.cumsum(edges) > 0)
    of = np.searchsorted(first, a, "right") - 1
    return list(zip(of.tolist(), (a - first[of]).tolist(), (b - first[of]).tolist(), strict=True))


def entropy_spans_of(texts: list[str]) -> list[list[Span]]:
    """Of each text, the merged stretches of hot windows that are no examples. Candidates of all texts are scanned together."""
    out: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, int, str]] = []
    size = 0

    def scanned() -> None:
        nonlocal size
        for k, x, y in _hot_stretches([w for _, _, w in held]):
            row, at, whole = held[k]
            if not _EXAMPLE.search(whole, x, y):
                out[row].append(("entropy", at + x, at + y))
        held.clear()
        size = 0

    for row, text in enumerate(texts):
        for m in _CANDIDATE.finditer(text):
            whole = m.group()
            if _MIXED.search(whole) and not any(p.fullmatch(whole) for p in ALLOWED):
                held.append((row, m.start(), whole))
                size += len(whole)
                if size >= TOGETHER:
                    scanned()
    if held:
        scanned()
    return out


def entropy_spans(text: str) -> list[Span]:
    return entropy_spans_of([text])[0]


def scans(texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the base spans, and the spans that entropy adds where no base span covers them; each by start, then kind."""
    texts, out = [t or "" for t in texts], []
    for text, hot in zip(texts, entropy_spans_of(texts), strict=True):
        base = sorted(base_spans(text), key=lambda s: (s[1], KINDS.index(s[0])))
        starts, reach = [s[1] for s in base], list(accumulate((s[2] for s in base), max))  # reach: the furthest end of a span so far
        at = lambda s: bisect_right(starts, s[1])  # noqa: B023, E731
        out.append((base, [s for s in hot if not at(s) or reach[at(s) - 1] < s[2]]))
    return out


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    return scans([text])[0]


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end; by start, then kind) for each row of docs."""
    order = (*KINDS, "entropy")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for base, more in scans(pdf["text"].tolist()):
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(base + more, key=lambda s: (s[1], order.index(s[0])))])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "spans": found})

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return own.mapInPandas(rows, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")
