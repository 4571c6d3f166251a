"""Language-model scores from a log-frequency Bloom filter.

Tokens are words in lower case (A-Z only) and one end per text. Training documents are those whose
crc32(doc_id as text) modulo 7 isn't 2.

The filter holds the counts c of single words and of pairs of neighbours (a text begins behind an end) as levels
1 + floor(log2 c): an n-gram is entered once for each level up to its own, and looked up level by level until one is
missing. It is built in segments by ranges of the hash, each from all counts of its range, and broadcast
to the workers. BITS bits and PROBES places for each entry let 2 % of absent entries seem present, at every size of the
corpus: a filter above BROADCAST_BYTES is broadcast in slices of segments, one after the other, and each slice gives the
levels of the n-grams in its ranges. With c(.) read from the filter, N tokens and V different ones in training,

    P(w) = (c(w) + 1) / (N + V + 1),    P(w | v) = (c(v w) + M P(w)) / (c(v) + M).

The base score needs exact counts of words. Tokens with more than a small share of all are counted first; there are at
most 2 FREQUENT of these, they are broadcast, and no hot word is shuffled. For all others a task sorts its chunk's tokens
and sends, for each range of hashes, its different tokens with the documents they are in. A range's task adds up the
counts and answers with what its tokens contribute to each document: one shuffle counts and scores.

A null text is taken as empty: it has one token, the end. Repeated rows count each. Without training tokens all counts
are 0. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymap.llm.tables import crc_mod, map_rows, mix, parts, slices, whole_text, word_hashes
from tallymap.session import write_stage

#: A token is frequent from this share of all tokens on.
FREQUENT = 40_000
BITS = 8
PROBES = 5
#: Bytes of the filter that are broadcast at once. Scores don't depend on it.
BROADCAST_BYTES = 1 << 27
#: Weight of the single word's probability, in counts.
M = 8.0
#: Bytes of token hashes that are looked up at once in a slice, and texts that are scored at once.
PROBED_BYTES = 1 << 20
SCORED_ROWS = 200
#: Text of a chunk; it also has at most 65,535 documents.
CHUNK_BYTES = 6 << 20

_END = np.uint64(0x632BE59BD9B4E019)
_ONE = np.uint64(0xA24BAED4963EE407)
_TWO = np.uint64(0x9FB21C651E98DF25)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and where each text's begin (one entry more than texts)."""
    hashes, owners = [], []
    for a, b in slices(texts):
        words, first = word_hashes(texts[a:b], lower=True)
        n = b - a
        ends = first[1:] + np.arange(n)  # each end moves what is behind it
        all_tokens = np.empty(len(words) + n, dtype=np.uint64)
        at_end = np.zeros(len(all_tokens), dtype=bool)
        at_end[ends] = True
        all_tokens[at_end] = _END
        all_tokens[~at_end] = words
        hashes.append(all_tokens)
        owners.append(np.diff(first) + 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(owners))])


def _pairs(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; a text's first token has an end before it."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = _END
    return mix(before * _TWO + tokens)


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(48)) * np.uint64(ranges) >> np.uint64(16)).astype(np.int64)


def _chunks(texts: list[bytes]):
    for a, b in slices(texts, CHUNK_BYTES):
        for c in range(a, b, 65_535):
            yield c, min(b, c + 65_535)


def _encoded(column) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in column.to_pylist()]


def _given(docs: DataFrame) -> DataFrame:
    doc, text = F.col("doc_id").cast("long"), whole_text()
    return docs.select(doc.alias("doc_id"), (crc_mod(doc, 7) == 2).alias("held_out"), F.xxhash64(text).alias("hash"), text.alias("text"))


def frequent_tokens(given: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (in order) and training counts of the frequent tokens, and the number of training tokens.

    A token with 1 / FREQUENT of all tokens has that share of some task's, so tasks put out only such tokens.
    """

    def shares(batches):
        seen: dict[int, int] = {}
        total = 0
        for batch in batches:
            texts = _encoded(batch.column(3))
            for a, b in _chunks(texts):
                tokens = np.sort(_tokens(texts[a:b])[0])
                first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
                n = np.diff(np.append(first, len(tokens)))
                # a task's frequent token is frequent in a chunk, so what isn't in any chunk can go
                often = n >= len(tokens) / (2 * FREQUENT)
                for k, v in zip(tokens[first[often]].astype(np.int64).tolist(), n[often].tolist(), strict=True):
                    seen[k] = seen.get(k, 0) + v
                total += len(tokens)
        often = {k: v for k, v in seen.items() if v >= total / (2 * FREQUENT)}
        if total:
            # packed by ranges of hashes, so that a task puts out as many rows however many tokens it has
            tokens = np.fromiter(often, dtype=np.int64, count=len(often)).astype(np.uint64)
            numbers = np.fromiter(often.values(), dtype=np.int64, count=len(often))
            own = _range(tokens, ranges)
            yield pa.RecordBatch.from_pydict({
                "range": pa.array(range(ranges), pa.int32()), "total": pa.array([total] * ranges, pa.int64()),
                "tokens": pa.array([tokens[own == r].tobytes() for r in range(ranges)], pa.binary()),
                "numbers": pa.array([numbers[own == r].tobytes() for r in range(ranges)], pa.binary()),
            })

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        every, counts = _added([np.frombuffer(x, np.uint64) for x in rows["tokens"]], [np.frombuffer(x, np.int64) for x in rows["numbers"]])
        often = counts >= rows["total"].sum() / (2 * FREQUENT)
        return pd.DataFrame({"token": every[often].astype(np.int64)})

    ranges = parts(given.sparkSession)
    put = given.mapInArrow(shares, "range int, total long, tokens binary, numbers binary")
    chosen = put.groupBy("range").applyInPandas(added, "token long").toPandas()["token"]
    chosen = np.sort(chosen.to_numpy(np.int64).astype(np.uint64))
    wanted = given.sparkSession.sparkContext.broadcast(chosen)

    def exact(batches):
        counts, total = np.zeros(len(wanted.value) + 1, dtype=np.int64), 0
        for batch in batches:
            train = [not h for h in batch.column(1).to_pylist()]
            texts = [t for t, used in zip(_encoded(batch.column(3)), train, strict=True) if used]
            for a, b in _chunks(texts):
                tokens = _tokens(texts[a:b])[0]
                total += len(tokens)
                counts += np.bincount(_places(tokens, wanted.value), minlength=len(counts))
        # the last is the number of tokens; packed in as many pieces as there are ranges
        counts[-1] = total
        pieces = np.array_split(counts, ranges)
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array(range(ranges), pa.int32()), "counts": pa.array([x.tobytes() for x in pieces], pa.binary())}
        )

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in rows["counts"])
        return pd.DataFrame({"piece": [int(rows["piece"].iloc[0])], "counts": [total.tobytes() if len(total) else b""]})

    found = given.mapInArrow(exact, "piece int, counts binary").groupBy("piece").applyInPandas(summed, "piece int, counts binary")
    found = found.toPandas().sort_values("piece")
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in found["counts"])])
    if not len(counts):
        counts = np.zeros(len(chosen) + 1, dtype=np.int64)
    return chosen, counts[:-1], int(counts[-1])


def _places(tokens: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Place of each token in ``chosen``, or its length."""
    if not len(chosen):
        return np.zeros(len(tokens), dtype=np.int64)
    at = np.minimum(np.searchsorted(chosen, tokens), len(chosen) - 1)
    return np.where(chosen[at] == tokens, at, len(chosen))


_ROW = "kind int, range int, chunk long, a binary, b binary, c binary, d binary"
#: Kinds of rows: tokens of a chunk in a range, pairs of a chunk in a range, sums of a chunk's documents, a segment.
_TOKENS, _PAIRS, _SUMS, _SEGMENT = range(4)


def _by_range(given: DataFrame, chosen: np.ndarray, counts: np.ndarray, ranges: int) -> DataFrame:
    held = given.sparkSession.sparkContext.broadcast((chosen, counts))
    schema = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in "abcd")])

    def put(kind, of_range, chunk, *arrays):
        values = [kind, of_range, chunk, *(x.tobytes() for x in arrays), *[None] * (4 - len(arrays))]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        chosen, counts = held.value
        logs = np.append(np.log10(counts + 1.0), 0.0)
        seen = np.append(counts > 0, False)
        for batch in batches:
            texts = _encoded(batch.column(3))
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = np.array(batch.column(1).to_pylist(), dtype=bool)
            for a, b in _chunks(texts):
                tokens, first = _tokens(texts[a:b])
                doc = np.repeat(np.arange(b - a), np.diff(first)).astype(np.uint16)
                place = _places(tokens, chosen)
                n = b - a
                known = np.array([i is not None for i in ids[a:b]])
                about = np.stack([np.array([i or 0 for i in ids[a:b]]), known, out[a:b], np.array(hashes[a:b]), np.diff(first)]).astype(np.int64)
                sums = np.bincount(doc, weights=logs[place], minlength=n)
                yield put(_SUMS, (number // 7) % ranges, number, about, sums, np.bincount(doc, weights=seen[place], minlength=n).astype(np.int64))

                rest = np.flatnonzero(place == len(chosen))
                order = rest[np.argsort(tokens[rest], kind="stable")]
                h, d = tokens[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(h))).astype(np.uint32)
                h, d = h[new], d[new]
                head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                cuts = np.searchsorted(_range(h[head], ranges), np.arange(ranges + 1))
                ends = np.append(head, len(h))
                train = ~out[a:b]
                for r in range(ranges):
                    i, j = cuts[r], cuts[r + 1]
                    if i < j:
                        s, e = ends[i], ends[j]
                        docs_in = np.diff(ends[i : j + 1]).astype(np.uint32)
                        used = train[d[s:e]]
                        mark = (d[s:e].astype(np.uint32) << np.uint32(1)) | used
                        yield put(_TOKENS, r, number, h[head[i:j]], docs_in, mark.astype(np.uint32), times[s:e])

                learned = np.sort(_pairs(tokens, first)[train[doc]])
                new = np.flatnonzero(np.concatenate([[True], learned[1:] != learned[:-1]])) if len(learned) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(learned))).astype(np.uint32)
                learned = learned[new]
                cuts = np.searchsorted(_range(learned, ranges), np.arange(ranges + 1))
                for r in range(ranges):
                    i, j = cuts[r], cuts[r + 1]
                    if i < j:
                        yield put(_PAIRS, r, number, learned[i:j], times[i:j])
                number += 1

    return given.mapInArrow(run, _ROW)


def _added(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes in order and their summed counts."""
    if not sum(len(h) for h in hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every, number = np.concatenate(hashes), np.concatenate(counts).astype(np.int64)
    order = np.argsort(every)
    every, number = every[order], number[order]
    new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[new], np.add.reduceat(number, new)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), and 0 for none."""
    return np.frexp(counts.astype(np.float64))[1]


def _spots(keys: np.ndarray, level: int, salt: np.uint64, bits):
    """The places of an entry in its segment, one array after the other."""
    value = mix(keys * salt + np.uint64(level))
    step = mix(value + salt) | np.uint64(1)
    for _ in range(PROBES):
        yield value % bits
        value = value + step


def fill_segment(entries: list[tuple[np.ndarray, np.ndarray, np.uint64]], bits_each: float) -> np.ndarray:
    """A segment (bytes) with the levels of each (keys, counts, salt)."""
    all_levels = [levels(counts) for _, counts, _ in entries]
    bits = max(64, math.ceil(bits_each * sum(int(x.sum()) for x in all_levels)))
    bits = -(-bits // 8) * 8
    flags = np.zeros(bits, dtype=bool)
    for (keys, _, salt), own in zip(entries, all_levels, strict=True):
        for level in range(1, int(own.max(initial=0)) + 1):
            for spot in _spots(keys[own >= level], level, salt, np.uint64(bits)):
                flags[spot.astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


def middle(found: np.ndarray) -> np.ndarray:
    """Estimated counts: the middle of the level found, on a logarithmic scale."""
    low = np.exp2(np.maximum(found.astype(np.int64) - 1, 0))
    return np.where(found > 0, np.sqrt(low * np.maximum(2 * low - 1, 1)), 0.0)


class LogFilter:
    """Segments behind each other, of all ranges or of some that follow ``first``; levels are read by probing one after the other."""

    def __init__(self, segments: list[bytes], first: int = 0, ranges: int | None = None):
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        self.first, self.ranges = first, ranges or len(segments)
        self.start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.bits = (sizes * 8).astype(np.uint64)
        self.data = np.frombuffer(b"".join(segments), dtype=np.uint8)

    def counts(self, keys: np.ndarray, salt: np.uint64) -> np.ndarray:
        return middle(self.levels(keys, salt))

    def levels_of_all(self, keys: np.ndarray, salt: np.uint64) -> np.ndarray:
        """As ``levels``, for keys of which many may be of other ranges or repeat: each key of these ranges is looked up once."""
        found = np.zeros(len(keys), dtype=np.uint8)
        of_range = _range(keys, self.ranges) - self.first
        own = np.flatnonzero((of_range >= 0) & (of_range < len(self.start)))
        different, place = np.unique(keys[own], return_inverse=True)
        found[own] = self.levels(different, salt)[place]
        return found

    def levels(self, keys: np.ndarray, salt: np.uint64) -> np.ndarray:
        """The level found for each key; 0 for those of other ranges."""
        found = np.zeros(len(keys), dtype=np.uint8)
        of_range = _range(keys, self.ranges) - self.first
        left = np.flatnonzero((of_range >= 0) & (of_range < len(self.start)))
        level = 1
        while len(left):
            own = keys[left]
            segment = of_range[left]
            start, bits = self.start[segment], self.bits[segment]
            there = np.arange(len(left))
            value = mix(own * salt + np.uint64(level))
            step = mix(value + salt) | np.uint64(1)
            for _ in range(PROBES):
                spot = (value % bits[there]).astype(np.int64)
                hit = (self.data[start[there] + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1
                keep = hit.astype(bool)
                there, value, step = there[keep], (value + step)[keep], step[keep]
            left = left[there]
            found[left] = level
            level += 1
            if level > 64:
                break
        return found


def _reduce(chosen_held, ranges: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(_SUMS, 0, r.chunk, r.a, r.b, r.c, None) for r in rows[rows["kind"] == _SUMS].itertuples()]
        of_range = int(rows["range"].iloc[0])
        tokens = []
        for r in rows[rows["kind"] == _TOKENS].itertuples():
            h, docs_in = np.frombuffer(r.a, np.uint64), np.frombuffer(r.b, np.uint32)
            mark, times = np.frombuffer(r.c, np.uint32), np.frombuffer(r.d, np.uint32)
            first = np.cumsum(docs_in, dtype=np.int64) - docs_in
            tokens.append((r.chunk, h, docs_in, mark, times, np.add.reduceat(times.astype(np.int64) * (mark & 1), first)))
        every, counts = _added([t[1] for t in tokens], [t[5] for t in tokens])
        logs = np.log10(counts + 1.0)
        for chunk, h, docs_in, mark, times, _ in tokens:
            at = np.repeat(np.searchsorted(every, h), docs_in)
            doc = (mark >> 1).astype(np.int64)
            n = int(doc.max()) + 1
            sums = np.bincount(doc, weights=times * logs[at], minlength=n)
            seen = np.bincount(doc, weights=times * (counts[at] > 0), minlength=n).astype(np.int64)
            some = np.flatnonzero(np.bincount(doc, minlength=n)).astype(np.uint16)
            out.append((_TOKENS, 0, chunk, some.tobytes(), sums[some].tobytes(), seen[some].tobytes(), None))
        pairs = rows[rows["kind"] == _PAIRS]
        both = _added([np.frombuffer(x, np.uint64) for x in pairs["a"]], [np.frombuffer(x, np.uint32) for x in pairs["b"]])
        chosen, chosen_counts = chosen_held.value
        own = _range(chosen, ranges) == of_range
        # frequent tokens of this range have no rows of their own
        entries = [(every[counts > 0], counts[counts > 0], _ONE), (chosen[own], chosen_counts[own], _ONE), (*both, _TWO)]
        segment = fill_segment(entries, BITS)
        out.append((_SEGMENT, of_range, int((counts > 0).sum()), segment.tobytes(), None, None, None))
        return pd.DataFrame(out, columns=["kind", "range", "chunk", "a", "b", "c", "d"])

    return run


def _documents(rows: pd.DataFrame) -> pd.DataFrame:
    """Sum up what a chunk's documents got from all ranges."""
    head = rows[rows["kind"] == _SUMS].iloc[0]
    ids, known, out, hashes, n_tokens = np.frombuffer(head["a"], np.int64).reshape(5, -1)
    sums, seen = np.frombuffer(head["b"], np.float64).copy(), np.frombuffer(head["c"], np.int64).copy()
    for r in rows[rows["kind"] == _TOKENS].sort_values("a").itertuples():
        docs = np.frombuffer(r.a, np.uint16)
        sums[docs] += np.frombuffer(r.b, np.float64)
        seen[docs] += np.frombuffer(r.c, np.int64)
    return pd.DataFrame(
        {"doc_id": pd.array(np.where(known, ids, 0), dtype="Int64").copy(), "held_out": out.astype(bool), "hash": hashes, "n_tokens": n_tokens, "n_known": seen, "logs": sums}
    ).assign(doc_id=lambda x: x["doc_id"].mask(known == 0))


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    given = _given(docs)
    chosen, counts, n = frequent_tokens(given)
    # an n-gram has at most as many entries as occurrences: a range has half of BROADCAST_BYTES at most, on average
    ranges = max(parts(spark), -(-4 * n * BITS // (8 * BROADCAST_BYTES)))
    held = spark.sparkContext.broadcast((chosen, counts))
    rows = _by_range(given, chosen, counts, ranges)
    reduced = write_stage(rows.groupBy("range").applyInPandas(_reduce(held, ranges), _ROW), "by-range")

    segments = reduced.where(F.col("kind") == _SEGMENT)
    known = segments.select("range", "chunk", F.length("a").alias("bytes")).toPandas().set_index("range")
    v = int(known["chunk"].sum()) + int((counts > 0).sum())
    cuts = filter_slices([int(known["bytes"].get(r, 8)) for r in range(ranges)])

    def one_slice(first: int, last: int) -> LogFilter:
        own = segments.where(F.col("range").between(first, last - 1)).select("range", "a").toPandas().set_index("range")["a"]
        return LogFilter([bytes(own.get(r, bytes(8))) for r in range(first, last)], first, ranges)

    exact = reduced.where(F.col("kind") != _SEGMENT).groupBy("chunk").applyInPandas(
        _documents, "doc_id long, held_out boolean, hash long, n_tokens long, n_known long, logs double"
    )
    exact = write_stage(exact, "exact-sums")

    def of_texts(single: np.ndarray, both: np.ndarray, ends: float, first: np.ndarray) -> list[float]:
        """Scores from the counts of each token and of its pair with the one before it."""
        before = np.empty_like(single)
        before[1:] = single[:-1]
        before[first[:-1]] = ends
        p = (np.minimum(both, before) + M * (single + 1) / (n + v + 1)) / (before + M)
        return np.add.reduceat(np.log10(p), first[:-1]).tolist()

    if len(cuts) == 1:
        scored = _scored_at_once(given, one_slice(0, ranges), of_texts)
        exact = exact.dropDuplicates(["doc_id", "hash"])
    else:
        scored = _scored_by_slices(given, [(one_slice, *cut) for cut in cuts], of_texts)
    joined = scored.join(exact, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("hash")))
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def filter_slices(sizes: list[int]) -> list[tuple[int, int]]:
    """(first, last) of runs of ranges whose segments hold BROADCAST_BYTES at most, one range at least."""
    cuts, first = [], 0
    for r in range(1, len(sizes) + 1):
        if r == len(sizes) or sum(sizes[first : r + 1]) > BROADCAST_BYTES:
            cuts.append((first, r))
            first = r
    return cuts


def _scored_at_once(given: DataFrame, log_filter: LogFilter, of_texts) -> DataFrame:
    """d, h and score of every row, by the whole filter."""
    held = given.sparkSession.sparkContext.broadcast(log_filter)
    del log_filter

    def score(batch):
        model = held.value
        texts = _encoded(batch.column(2))
        ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(texts):
            tokens, first = _tokens(texts[a:b])
            order = np.argsort(tokens)
            new = np.concatenate([[True], tokens[order][1:] != tokens[order][:-1]])
            place = np.empty(len(tokens), dtype=np.int64)
            place[order] = np.cumsum(new) - 1
            single = model.counts(tokens[order][new], _ONE)
            ends = float(model.counts(np.array([_END]), _ONE)[0])
            scores = of_texts(single[place], model.counts(_pairs(tokens, first), _TWO), ends, first)
            yield from zip(ids[a:b], hashes[a:b], scores, strict=True)

    # written at once, so that the workers can let go of the filter
    scored = write_stage(map_rows(given.select("doc_id", "hash", "text"), score, "d long, h long, score double"), "scores")
    held.unpersist()
    return scored


def _scored_by_slices(given: DataFrame, cuts: list[tuple], of_texts) -> DataFrame:
    """d, h and score of every different (d, h). The tokens are written once; each slice of the filter marks the tokens and pairs
    that it has and gives their levels, and those of all slices are put together for each text."""
    spark = given.sparkSession

    def hashed(batch):
        texts = _encoded(batch.column(2))
        ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(texts):
            tokens, first = _tokens(texts[a:b])
            for i in range(a, b):
                yield ids[i], hashes[i], tokens[first[i - a] : first[i - a + 1]].tobytes()

    tokens = write_stage(map_rows(given.select("doc_id", "hash", "text"), hashed, "d long, h long, tokens binary"), "tokens")
    found, ends = [], 0.0
    for k, (one_slice, *cut) in enumerate(cuts):
        model = one_slice(*cut)
        ends = max(ends, float(model.counts(np.array([_END]), _ONE)[0]))
        held = spark.sparkContext.broadcast(model)
        del model

        def probe(batch, held=held):
            ids, hashes, every = (batch.column(i).to_pylist() for i in range(3))
            for a, b in slices(every, PROBED_BYTES):  # many short texts are looked up at once
                own, first = np.frombuffer(b"".join(every[a:b]), np.uint64), np.cumsum([0] + [len(x) // 8 for x in every[a:b]])
                single, both = held.value.levels_of_all(own, _ONE), held.value.levels_of_all(_pairs(own, first), _TWO)
                for i, x, y in zip(range(a, b), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    levels = np.concatenate([single[x:y], both[x:y]])
                    there = levels > 0
                    yield ids[i], hashes[i], y - x, np.packbits(there).tobytes(), levels[there].tobytes()

        part = write_stage(map_rows(tokens, probe, "d long, h long, n long, mark binary, levels binary"), f"levels-{k}")
        held.destroy()
        found.append(part.select("d", "h", "n", F.lit(k).alias("k"), F.struct("mark", "levels").alias("own")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # rows with one id and text have equal levels
    own = [F.max(F.when(F.col("k") == k, F.col("own"))).alias(f"own{k}") for k in range(len(found))]
    every = every.groupBy("d", "h", "n").agg(*own)

    def score(batch):
        rows = list(zip(*(column.to_pylist() for column in batch.columns), strict=True))
        for at in range(0, len(rows), SCORED_ROWS):
            some = rows[at : at + SCORED_ROWS]
            singles, pairs = [], []
            for _, _, n, *own in some:
                levels = np.zeros(2 * n, dtype=np.uint8)
                for x in own:
                    marked = np.unpackbits(np.frombuffer(x["mark"], np.uint8), count=2 * n).astype(bool)
                    levels[marked] = np.frombuffer(x["levels"], np.uint8)
                singles.append(levels[:n])
                pairs.append(levels[n:])
            first = np.cumsum([0] + [len(x) for x in singles])
            scores = of_texts(middle(np.concatenate(singles)), middle(np.concatenate(pairs)), ends, first)
            yield from ((d, h, score) for (d, h, *_), score in zip(some, scores, strict=True))

    return map_rows(every, score, "d long, h long, score double")
