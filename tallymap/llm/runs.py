"""Periodic runs of words, found in an enhanced suffix array, and texts without their repeats.

A run is a stretch of words with smallest period q, at least ``SHORTEST`` words and ``TIMES`` periods long, that no
neighbouring word extends. The words of a text get a suffix array, its inverse and the longest common prefixes (LCP).
Behind the last two periods of a run the word differs (or the text ends), so the suffixes that begin there have a common
prefix of exactly q words: they lie in different children of one LCP interval of depth q. So for each interval all
suffixes but those of its largest child are taken, and the inverse suffix array tells whether the suffix ``depth`` words on or
back lies in the interval too. Such a pair is a square that can't be rotated to the right; it is rotated to the left as
far as words agree, which gives the whole run. A suffix is in a smaller child at most log2(n) times, so there are
O(n log n) looks. Intervals are ranges of the arrays; there are no tree nodes.

Texts are worked on by themselves, so there is no shuffle and no group. Many texts share one array: the first key of the order
is the text, so suffixes of different texts have no common prefix. A run has eight words that occur twice in its text; texts
without are known to have no run before their intervals are built.

A null text is taken as empty: no words, no runs, an empty collapsed text. Repeated rows are each worked on for themselves, a
null doc_id stays null, an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymap.llm.tables import map_rows, slices, whole_text, words

#: Words of a run at least, and how often its period fits at least.
SHORTEST = 24
TIMES = 3
#: Words of a run that occur twice in its text (fewer for short runs or few periods).
TWICE = 8
#: Rotations that are tried on all squares at once; longer runs are then followed one by one.
STEPS = 16


class SuffixArray:
    """Order of the suffixes of several word sequences, which are laid end to end in ``word``."""

    def __init__(self, word: np.ndarray, sizes: np.ndarray):
        self.word = word
        last = np.cumsum(sizes)
        #: Per position: number of its text, and where that begins and ends.
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.begin = np.repeat(last - sizes, sizes)
        self.end = np.repeat(last, sizes)

    def sort(self, most: int | None = None) -> np.ndarray:
        """Order the suffixes by their first ``most`` words (all, if None) by doubling; returns the positions that share these."""
        n = len(self.word)
        key = self.text * (int(self.word.max(initial=0)) + 1) + self.word
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        first = np.ones(n, dtype=bool)
        first[1:] = key[1:] != key[:-1]
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[self.order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        #: Ranks by the first 1, 2, 4, ... words.
        self.ranks = [self.rank.astype(np.int32 if n < 2**31 else np.int64)]
        slot = np.flatnonzero(~(first & np.append(first[1:], True)))
        k = 1
        while len(slot) and (most is None or k < most):
            at = self.order[slot]
            ahead = np.minimum(at + k, n - 1)
            second = np.where(at + k < self.end[at], self.rank[ahead] + 1, 0)
            key = self.rank[at] * (n + 1) + second
            way = np.argsort(key, kind="stable")
            at, key = at[way], key[way]
            self.order[slot] = at
            first = np.ones(len(slot), dtype=bool)
            first[1:] = key[1:] != key[:-1]
            self.rank[at] = slot[np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))]
            self.ranks.append(self.rank.astype(self.ranks[0].dtype))
            slot = slot[~(first & np.append(first[1:], True))]
            k *= 2
        return self.order[slot]

    def common_prefixes(self) -> np.ndarray:
        """Common words of each suffix with the one before it in the order, from the ranks of doubling."""
        n = len(self.word)
        lcp = np.zeros(n, dtype=np.int64)
        at = np.flatnonzero(self.ranks[0][self.order[1:]] == self.ranks[0][self.order[:-1]]) + 1
        a, b = self.order[at - 1], self.order[at]
        room = np.minimum(self.end[a] - a, self.end[b] - b)
        common = np.zeros(len(at), dtype=np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            inside = common < room
            x, y = np.where(inside, a + common, 0), np.where(inside, b + common, 0)
            common += np.where(inside & (rank[x] == rank[y]), 1 << level, 0)
        lcp[at] = common
        return lcp


def lcp_intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last place and depth of each LCP interval above 0, and per place the interval whose children part there (or -1)."""
    n = len(lcp)
    left, right, depth = [], [], []
    owner = [-1] * n
    depths, ids = [0], [-1]
    for j, d in enumerate([*lcp.tolist()[1:], 0], start=1):
        l = j - 1
        while depths[-1] > d:
            depths.pop()
            i = ids.pop()
            right[i], l = j - 1, left[i]
        if d > depths[-1]:
            depths.append(d)
            ids.append(len(left))
            left.append(l)
            right.append(0)
            depth.append(d)
        if j < n:
            owner[j] = ids[-1]
    return (*(np.array(x, dtype=np.int64) for x in (left, right, depth)), np.array(owner, dtype=np.int64))


def _smaller_children(left, right, owner, wanted) -> tuple[np.ndarray, np.ndarray]:
    """Interval and place of every suffix that isn't in the largest child of a wanted interval."""
    parts = np.flatnonzero(owner >= 0)
    interval = np.concatenate([np.arange(len(left)), owner[parts]])
    start = np.concatenate([left, parts])
    keep = wanted[interval]
    interval, start = interval[keep], start[keep]
    way = np.lexsort((start, interval))
    interval, start = interval[way], start[way]
    new = np.append(interval[1:] != interval[:-1], True)
    stop = np.where(new, right[interval] + 1, np.append(start[1:], 0))
    size = stop - start
    largest_first = np.lexsort((-size, interval))
    largest = largest_first[np.concatenate([[True], new[:-1]])] if len(interval) else largest_first
    small = np.ones(len(interval), dtype=bool)
    small[largest] = False
    interval, start, size = interval[small], start[small], size[small]
    before = np.cumsum(size) - size
    return np.repeat(interval, size), np.arange(int(size.sum())) + np.repeat(start - before, size)


def branching_squares(array: SuffixArray, shortest: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of squares that can't be rotated to the right, of intervals large enough for a run."""
    left, right, depth, owner = lcp_intervals(array.common_prefixes())
    # A run's interval has the suffixes one, two, ... periods before its end.
    wanted = right - left + 1 >= np.maximum(times, shortest // np.maximum(depth, 1))
    interval, place = _smaller_children(left, right, owner, wanted)
    i, step, low, high = array.order[place], depth[interval], left[interval], right[interval]
    n, rank, word = len(array.word), array.rank, array.word

    def differs(x, y):
        """Whether the words at x and y differ; y may lie behind the text."""
        return (y >= array.end[i]) | (word[np.minimum(x, n - 1)] != word[np.minimum(y, n - 1)])

    def inside(x):
        r = rank[np.clip(x, 0, n - 1)]
        return (x >= array.begin[i]) & (x < array.end[i]) & (low <= r) & (r <= high)

    on = inside(i + step) & differs(i + step, i + 2 * step)
    back = inside(i - step) & differs(i, i + step)
    square = np.concatenate([i[on], (i - step)[back]])
    period = np.concatenate([step[on], step[back]])
    found = np.unique(np.stack([square, period]), axis=1)
    return found[0], found[1]


def _rotated(word: np.ndarray, start: int, period: int, begin: int) -> int:
    """Start of the run that a square belongs to, looked for in growing steps to the left."""
    step = STEPS
    while start > begin:
        low = max(begin, start - step)
        same = word[low:start] == word[low + period : start + period]
        if not same.all():
            return low + int(np.flatnonzero(~same)[-1]) + 1
        start, step = low, step * 2
    return start


def array_runs(array: SuffixArray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs, by text, start and period."""
    square, period = branching_squares(array, shortest, times)
    end = square + 2 * period
    needed = end - np.maximum(shortest, times * period)
    begin = array.begin[square]
    alive = needed >= begin
    for t in range(1, STEPS + 1):
        at = square - t
        same = array.word[np.maximum(at, 0)] == array.word[np.maximum(at + period, 0)]
        alive &= (at < needed) | same
    found: dict[tuple[int, int], int] = {}
    for k in np.flatnonzero(alive).tolist():
        start = _rotated(array.word, int(square[k]), int(period[k]), int(begin[k]))
        if start <= needed[k]:
            key = (start, int(end[k]))
            # a multiple of the period has the same run
            found[key] = min(found.get(key, int(period[k])), int(period[k]))
    rows = [(int(array.text[s]), s - int(array.begin[s]), e - s, p) for (s, e), p in found.items()]
    return sorted(rows, key=lambda r: (r[0], r[1], r[3]))


def runs_of(texts: list[list[bytes]], shortest: int = SHORTEST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of words."""
    known: dict[bytes, int] = {}
    ids = [np.fromiter((known.setdefault(w, len(known)) for w in t), dtype=np.int64, count=len(t)) for t in texts]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    chosen = [k for k, t in enumerate(ids) if len(t) >= shortest]
    if chosen:
        array = SuffixArray(np.concatenate([ids[k] for k in chosen]), np.array([len(ids[k]) for k in chosen]))
        # all but one period of a run occurs twice; doubling sorts by powers of two
        twice = array.sort(min(TWICE, 1 << (shortest - shortest // times).bit_length() - 1))
        chosen = [chosen[k] for k in np.unique(array.text[twice]).tolist()]
    if chosen:
        array = SuffixArray(np.concatenate([ids[k] for k in chosen]), np.array([len(ids[k]) for k in chosen]))
        array.sort()
        for text, *run in array_runs(array, shortest, times):
            out[chosen[text]].append(tuple(run))
    return out


def collapse(text: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run has behind its first period, joined by a space."""
    if not runs:
        return b" ".join(text)
    dropped = np.zeros(len(text), dtype=bool)
    for start, length, period in runs:
        dropped[start + period : start + length] = True
    return b" ".join(text[i] for i in np.flatnonzero(~dropped).tolist())


def find_runs(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (array of start, length, period by start, then period) and the text collapsed to one period each."""

    def rows(batch):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, last in slices(texts):
            split = [t.split() for t in texts[first:last]]  # of bytes: at the same six characters
            for doc, text, found in zip(ids[first:last], split, runs_of(split, shortest, times), strict=True):
                yield doc, [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], collapse(text, found).decode("utf-8", "replace")

    return map_rows(
        docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text")),
        rows,
        "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string",
    )


def with_tails(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the documents, chosen by the crc32 of doc_id, get a periodic tail made from their own words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = ((h - h % 10) / 10).cast("long")

    def tailed(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        # whole periods, cut to the words there are; no look-up in the words for each word
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")

    w = words(F.col("text"))
    chosen = (h % 10 == 0) & (F.size(w) > 0)
    return docs.select("doc_id", whole_text().alias("text")).select(
        "doc_id", F.when(chosen, tailed(w)).otherwise(F.col("text")).alias("text")
    )


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document: number of runs, the one of the greatest exponent, and digests of all runs and of the rest."""

    def higher(a: Column, b: Column) -> Column:
        ratio = b["length"] * a["period"] - a["length"] * b["period"]
        return F.coalesce(
            F.nullif(F.signum(ratio), F.lit(0.0)), F.nullif(F.signum(a["start"] - b["start"]), F.lit(0.0)), F.signum(a["period"] - b["period"])
        ).cast("int")

    best = F.get(F.array_sort("runs", higher), F.lit(0))
    line = F.transform(
        "runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    )
    listed = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return find_runs(docs).withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(best.length * 1000) div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
