"""Near duplicates by improved consistent weighted sampling over weighted word shingles.

A document is a weighted set of shingles of five words (all its words, if fewer), with weight

    (1 + ln(occurrences in the document)) * idf,   idf = min(1, ln(1 + N / df) / ln(1 + COMMON))

so a shingle counts fully unless it stands in more than one of COMMON documents; the weight falls
from there to half. (An idf that tells rare from very rare would make the words in which copies
differ heavier than those they share, and break up large groups of copies.) The shingles that are
not fully weighted are at most COMMON times the mean number of shingles of a document; only these
are counted exactly and broadcast.

1. Rows with equal text are folded by digest.
2. Each text gets SAMPLES consistent weighted samples: for shingle S and sample k, with r and c from
   Gamma(2, 1) and b uniform, all from a hash of (S, k), t = floor(ln w / r + b), ln y = r (t - b),
   ln a = ln c - ln y - r; the sample is (S, t) of the smallest a. Two texts agree in a sample
   with the probability of their weighted Jaccard similarity.
3. BANDS bands of ROWS samples each are the keys of buckets. A bucket isn't turned into pairs: classes
   are those of single linkage, for which a maximum spanning tree of similarities is enough. So
   each bucket gives the tree over the agreement of its members' samples and each member's NEAREST
   best neighbours: a number of pairs in proportion to its members. Buckets above MEMBERS are dealt to
   blocks of about that size.
4. Each proposed pair, once, is verified by weighted Jaccard similarity of the whole texts. Samples are
   noisy, so in a large group other copies may agree with a member better than its true link does.
   Hence further turns over the buckets that still hold several classes: every member is compared with
   the most linked member of each of the HUBS most linked other classes of its bucket and, in the first of these
   turns, every member outside the largest class of its block with the best ones of other classes, in
   blocks dealt anew. Pairs are verified once only, their number grows with the members. When a turn adds no link, what the
   turns have left out is verified: in buckets that still hold several classes, all pairs of members of different classes
   that agree in enough samples. This is done where two blocks meet, and only links that connect classes come out, so no
   pair becomes a row. So no pair of a bucket is lost to MEMBERS, HUBS or NEAREST.
5. Classes are the connected components of verified pairs, by alternating large and small stars.

A null text has no copy: each such row is its own class. Texts without words are empty sets:
equal ones are one class, others are apart. Repeated rows are copies of each other. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymap.llm.tables import map_rows, mix, slices, word_hashes
from tallymap.session import write_stage

SHINGLE = 5
SIMILAR = 0.8
SAMPLES = 64
ROWS = 5
BANDS = 24
#: A shingle in more than one of so many documents weighs less.
COMMON = 3
#: Members of a block; larger buckets are dealt to several.
MEMBERS = 2_000
#: Classes of a bucket whose most linked member is compared with every member of other classes.
HUBS = 4
#: Best neighbours of a member that are verified, besides the tree.
NEAREST = 3
#: Pairs that agree in a smaller share of samples are not verified: at similarity 0.8 the share has
#: mean 0.8 and standard deviation 0.05, so this is four deviations below.
AGREE = 0.6
#: Pairs a task puts out at once.
PAIRS = 100_000
#: Bytes of text of a block, where texts are compared in place, and members compared with one at once.
BLOCK_BYTES = 4 << 20
NEAR_AT_ONCE = 64
#: Counters for finding common shingles, as a power of two.
COUNTER_BITS = 20

_KEY_BITS = 44


def _shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text: owner, 44-bit key, occurrences, in order of both."""
    hashes, first = word_hashes(texts)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(hashes)) - first[owner]
    starts = np.flatnonzero((place <= count[owner] - SHINGLE) | ((place == 0) & (count[owner] < SHINGLE)))
    own = owner[starts]
    end = first[own + 1]
    padded = np.append(hashes, np.zeros(SHINGLE, dtype=np.uint64))
    key = np.zeros(len(starts), dtype=np.uint64)
    for k in range(SHINGLE):
        part = padded[starts + k]
        part = np.where(starts + k < end, part, np.uint64(0))
        key = mix(key + part + np.uint64(2 * k + 1))
    joint = np.sort((own.astype(np.uint64) << np.uint64(_KEY_BITS)) | (key >> np.uint64(64 - _KEY_BITS)))
    new = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]])) if len(joint) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(joint)))
    joint = joint[new]
    return (joint >> np.uint64(_KEY_BITS)).astype(np.int64), joint & np.uint64((1 << _KEY_BITS) - 1), times


def _texts(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in column.to_pylist()]


def common_shingles(texts: DataFrame, common: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the shingles in more than one of ``common`` texts, and their idf.

    A counter that such a shingle falls on reaches that share of some task's documents, so tasks
    put out only counters that reach half of it; those whose sum may reach the share over all tasks are
    counted by key in a second pass. Either list is bounded by the mean number of shingles.
    """
    width = 1 << COUNTER_BITS

    def count(batches):
        counts, docs = np.zeros(width, dtype=np.int64), 0
        for batch in batches:
            all_texts = _texts(batch.column(0))
            for a, b in slices(all_texts):
                _, key, _ = _shingles(all_texts[a:b])
                counts += np.bincount((key >> np.uint64(_KEY_BITS - COUNTER_BITS)).astype(np.int64), minlength=width)
            docs += len(all_texts)
        if docs:
            full = np.flatnonzero(counts >= docs / (2 * common))
            yield pa.RecordBatch.from_pydict(
                {"counter": pa.array([-1, *full.tolist()], pa.int64()), "n": pa.array([docs, *counts[full].tolist()], pa.int64())}
            )

    sums = texts.select("text").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    sums = write_stage(sums, "shingle-counters")
    n = (sums.where("counter = -1").first() or {"n": 0})["n"]
    counters = sums.where((F.col("counter") >= 0) & (F.col("n") >= n / (2 * common))).toPandas()["counter"].to_numpy(np.int64)
    if not len(counters):
        return np.zeros(0, np.uint64), np.zeros(0)
    wanted = texts.sparkSession.sparkContext.broadcast(counters)

    def exact(batches):
        marked = np.zeros(width, dtype=bool)
        marked[wanted.value] = True
        total: dict[int, int] = {}
        for batch in batches:
            all_texts = _texts(batch.column(0))
            for a, b in slices(all_texts):
                _, key, _ = _shingles(all_texts[a:b])
                key = key[marked[(key >> np.uint64(_KEY_BITS - COUNTER_BITS)).astype(np.int64)]]
                for k, v in zip(*(x.tolist() for x in np.unique(key, return_counts=True)), strict=True):
                    total[k] = total.get(k, 0) + v
        yield pa.RecordBatch.from_pydict({"key": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    found = texts.select("text").mapInArrow(exact, "key long, n long").groupBy("key").agg(F.sum("n").alias("df"))
    found = found.where(F.col("df") > n / common).toPandas().sort_values("key")
    idf = np.log1p(n / found["df"].to_numpy(float)) / np.log1p(common)
    return found["key"].to_numpy(np.int64).astype(np.uint64), np.minimum(1.0, idf)


def _weights(key: np.ndarray, times: np.ndarray, idf: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    weight = 1 + np.log(times)
    if len(idf[0]) and len(key):
        at = np.minimum(np.searchsorted(idf[0], key), len(idf[0]) - 1)
        weight = np.where(idf[0][at] == key, weight * idf[1][at], weight)
    return weight


@functools.cache
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """65,536 evenly spread quantiles of Gamma(2, 1), and their logarithms."""
    share = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(share), np.full_like(share, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        under = 1 - (1 + middle) * np.exp(-middle) < share
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return low.astype(np.float32), np.log(low).astype(np.float32)


@functools.cache
def _bands() -> np.ndarray:
    """Samples of each band, by a fixed drawing."""
    draw = np.random.default_rng(20_240_229)
    return np.array([np.sort(draw.choice(SAMPLES, ROWS, replace=False)) for _ in range(BANDS)])


def signatures(texts: list[bytes], idf: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """SAMPLES 32-bit samples of each text, and whether it has a shingle at all."""
    owner, key, times = _shingles(texts)
    out = np.zeros((len(texts), SAMPLES), dtype=np.uint32)
    some = np.zeros(len(texts), dtype=bool)
    some[owner] = True
    if not len(owner):
        return out, some
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    weight = _weights(key, times, idf)
    odd = np.flatnonzero(weight != 1.0)
    log_weight = np.log(weight[odd]).astype(np.float32)
    gamma, log_gamma = _gamma()
    low = key & np.uint64(0xFFFFFFFF)
    for k in range(SAMPLES):
        value = mix(key + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF))
        r = gamma[(value & np.uint64(0xFFFF)).astype(np.int32)]
        log_c = log_gamma[((value >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int32)]
        b = ((value >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536) + np.float32(1 / 131072)
        log_a = log_c - r * (1 - b)  # weight 1: t = 0
        sample = low
        if len(odd):
            t = np.floor(log_weight / r[odd] + b[odd])
            log_a[odd] = log_c[odd] - r[odd] * (t - b[odd]) - r[odd]
            sample = low.copy()
            sample[odd] = (low[odd] + (t.astype(np.int64) * 0x9E3779B1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
        rank = ((log_a + np.float32(40)) * np.float32(1 << 26)).astype(np.uint64)
        least = np.minimum.reduceat((rank << np.uint64(32)) | sample, starts)
        out[owner[starts], k] = (least & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out, some


def band_keys(sample: np.ndarray) -> np.ndarray:
    """Bucket keys of each signature, one for each band."""
    keys = np.empty((len(sample), BANDS), dtype=np.uint64)
    for band, chosen in enumerate(_bands()):
        key = np.full(len(sample), band + 1, dtype=np.uint64)
        for k in chosen:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sample[:, k].astype(np.uint64))
        keys[:, band] = key
    return keys


def similarity(pairs: list[tuple[bytes, bytes]], idf: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    flat = [t for pair in pairs for t in pair]
    out = np.zeros(len(pairs))
    for a, b in _even_slices(flat):
        owner, key, times = _shingles(flat[a:b])
        weight = _weights(key, times, idf)
        joint = ((owner >> 1).astype(np.uint64) << np.uint64(_KEY_BITS)) | key
        order = np.argsort(joint, kind="stable")
        joint, weight, pair = joint[order], weight[order], owner[order] >> 1
        n = (b - a) // 2
        total = np.bincount(pair, weights=weight, minlength=n)
        twice = np.flatnonzero(joint[1:] == joint[:-1])
        both = np.bincount(pair[twice], weights=np.minimum(weight[twice], weight[twice + 1]), minlength=n)
        out[a // 2 : b // 2] = both / np.maximum(total - both, 1e-12)
    return out


def _even_slices(flat: list[bytes]):
    """Slices that keep pairs together."""
    pairs = [flat[i] + flat[i + 1] for i in range(0, len(flat), 2)]
    for a, b in slices(pairs):
        yield 2 * a, 2 * b


def proposals(sample: np.ndarray) -> np.ndarray:
    """Pairs (row numbers) of the maximum spanning tree over agreement, and of best neighbours."""
    m = len(sample)
    least = AGREE * sample.shape[1]
    if m == 2:
        return np.array([[0, 1]]) if (sample[0] == sample[1]).sum() >= least else np.zeros((0, 2), np.int64)
    best = np.full(m, -1, dtype=np.int32)  # agreement with the tree so far
    via = np.zeros(m, dtype=np.int64)
    outside = np.ones(m, dtype=bool)
    pairs = []
    at = 0
    for _ in range(m):
        outside[at] = False
        agree = (sample == sample[at]).sum(axis=1, dtype=np.int32)
        agree[at] = -1
        near = np.argpartition(agree, -min(NEAREST, m - 1))[-min(NEAREST, m - 1) :]
        pairs += [(min(at, j), max(at, j)) for j in near[agree[near] >= least].tolist()]
        better = outside & (agree > best)
        best[better], via[better] = agree[better], at
        rest = np.where(outside, best, -2)
        nxt = int(rest.argmax())
        if rest[nxt] >= least:
            pairs.append((min(nxt, int(via[nxt])), max(nxt, int(via[nxt]))))
        at = nxt
    return np.unique(np.array(pairs, dtype=np.int64).reshape(-1, 2), axis=0)


def next_best(sample: np.ndarray, classes: np.ndarray, most: int) -> np.ndarray:
    """Pairs (row numbers) of each member outside the largest class with the ``most`` members of other classes it agrees with best."""
    names, number, size = np.unique(classes, return_inverse=True, return_counts=True)
    least, pairs = AGREE * sample.shape[1], []
    if len(names) < 2:
        return np.zeros((0, 2), np.int64)
    for i in np.flatnonzero(number != size.argmax()).tolist():
        agree = np.where(number == number[i], -1, (sample == sample[i]).sum(axis=1, dtype=np.int32))
        k = min(most, len(sample))
        near = np.argpartition(agree, -k)[-k:]
        pairs += [(min(i, j), max(i, j)) for j in near[agree[near] >= least].tolist()]
    return np.unique(np.array(pairs, dtype=np.int64).reshape(-1, 2), axis=0)


def sample_texts(docs: DataFrame, idf: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, tid (digest of the text; null without a text), sample, keys (null without a word)."""
    held = docs.sparkSession.sparkContext.broadcast(idf)

    def rows(batch):
        ids, tids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = _texts(batch.column(2))
        for a, b in slices(texts):
            sample, some = signatures(texts[a:b], held.value)
            keys = band_keys(sample).astype(np.int64)
            for i in range(a, b):
                if tids[i] is None or not some[i - a]:
                    yield ids[i], tids[i], None, None
                else:
                    yield ids[i], tids[i], sample[i - a].tobytes(), keys[i - a].tolist()

    text = F.col("text").cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("tid"), text.alias("text"))
    return map_rows(given, rows, "doc_id long, tid binary, sample binary, keys array<long>")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bucket_members(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of texts with equal samples, and the others' buckets with several members: key, tid, n (its members).
    ``texts``: tid, sample, keys, each tid once."""
    # texts with equal samples: all are linked with one, which alone goes on
    head = texts.groupBy("sample").agg(F.min("tid").alias("head"), F.count("*").alias("n"))
    equal = texts.join(head.where("n > 1"), "sample").where("tid <> head").select(F.col("head").alias("a"), F.col("tid").alias("b"))
    heads = texts.join(head.select(F.col("head").alias("tid")), "tid", "left_semi")
    spread = heads.select("tid", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return equal, spread.join(shared, "key").select("key", "tid", "n")


def _pairs_in_groups(given: DataFrame, keys: list[str], pick, named: str | None = None) -> DataFrame:
    """Pairs (a, b) that ``pick`` gives as frames for the samples and rows of each group of ``keys``, with their column ``named``
    (a long). Groups stand behind each other in a task, one data frame for many of them."""

    def framed(a: list, b: list, of: list) -> pd.DataFrame:
        pairs = pd.DataFrame({"a": a, "b": b}, dtype=object)
        return pairs.assign(**{named: np.array(of, dtype=np.int64)}) if named else pairs

    def propose_all(batches):
        rest = None
        for frame in batches:
            if rest is not None:
                frame = pd.concat([rest, frame], ignore_index=True)
            ends = np.flatnonzero(np.any([np.diff(frame[k].to_numpy()) != 0 for k in keys], axis=0)) + 1
            cut = int(ends[-1]) if len(ends) else 0
            rest = frame.iloc[cut:].reset_index(drop=True)
            yield from whole(frame.iloc[:cut], ends)
        if rest is not None:
            yield from whole(rest, np.zeros(0, np.int64))

    def whole(frame: pd.DataFrame, ends: np.ndarray):
        if not len(frame):
            return
        tid = frame["tid"].to_numpy()
        sample = np.frombuffer(b"".join(frame["sample"]), dtype=np.uint32).reshape(len(frame), -1)
        a, b, of, first = [], [], [], 0
        for last in [*ends[ends < len(frame)].tolist(), len(frame)]:
            if last - first > 1:
                for pairs in pick(sample[first:last], frame.iloc[first:last]):
                    a += tid[first + pairs[:, 0]].tolist()
                    b += tid[first + pairs[:, 1]].tolist()
                    of += [frame[named].iloc[first]] * len(pairs) if named else []
                    if len(a) > PAIRS:
                        yield framed(a, b, of)
                        a, b, of = [], [], []
            first = last
        yield framed(a, b, of)

    ordered = given.repartition(*keys).sortWithinPartitions(*keys, "tid")
    return ordered.mapInPandas(propose_all, "a binary, b binary" + (f", {named} long" if named else ""))


def block_pairs(members: DataFrame, texts: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) proposed inside buckets: in turn 0 the tree and best neighbours, later (with ``class``) the best
    neighbours of other classes. Larger buckets are dealt to blocks of about MEMBERS, anew each turn; pairs across the blocks
    are left to ``class_links``."""
    block = F.pmod(F.xxhash64("tid", "key", F.lit(turn)), F.ceil(F.col("n") / MEMBERS))
    given = members.withColumn("block", block).join(texts.select("tid", "sample"), "tid")

    def pick(sample: np.ndarray, rows: pd.DataFrame):
        yield next_best(sample, rows["class"].to_numpy(), NEAREST) if turn else proposals(sample)

    return _pairs_in_groups(given.select("key", "block", "tid", "sample", *(["class"] if turn else [])), ["key", "block"], pick)


def _class_blocks(members: DataFrame, texts: DataFrame, size: str | None = None) -> DataFrame:
    """Members of the buckets with several classes, dealt so that two members of different classes meet in one group of key, b0
    and b1. ``members``: key, tid, class; other columns of ``texts`` than ``size`` (bytes of a text) pass.

    One member of such a pair stands outside the bucket's largest class: blocks of about MEMBERS (and BLOCK_BYTES) of these
    meet blocks of all, each two blocks in a group of their own, so no group grows with the bucket."""
    given = members.select("key", "tid", "class").join(texts, "tid")
    weigh = F.lit(0) if size is None else F.col(size)
    sizes = given.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum(weigh).alias("bytes"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "class", "bytes")).alias("largest"), F.sum("n").alias("all"), F.sum("bytes").alias("bytes"))

    def blocks(n: Column, held: Column) -> Column:
        return F.greatest(F.ceil(n / MEMBERS), F.ceil(held / BLOCK_BYTES), F.lit(1))

    counts = [blocks(F.col("all"), F.col("bytes")), blocks(F.col("all") - F.col("largest.n"), F.col("bytes") - F.col("largest.bytes"))]
    sizes = sizes.where(F.col("largest.n") < F.col("all")).select("key", F.col("largest.class").alias("largest"), *(n.alias(f"n{i}") for i, n in enumerate(counts)))
    kept = [c for c in given.columns if c not in ("key", size)]
    given = given.join(sizes, "key")

    def dealt(rows: DataFrame, outside: bool) -> DataFrame:
        own, other = (1, 0) if outside else (0, 1)
        at = {f"b{own}": F.pmod(F.xxhash64("tid", "key"), F.col(f"n{own}")), f"b{other}": F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{other}") - 1))}
        rows = rows.select("key", *kept, F.lit(outside).alias("outside"), *(c.cast("long").alias(n) if n == f"b{own}" else c.alias(n) for n, c in at.items()))
        return rows.select("key", "b0", "b1", *kept, "outside")

    return dealt(given, False).unionByName(dealt(given.where(F.col("class") != F.col("largest")), True))


def _agreeing(sample: np.ndarray, rows: pd.DataFrame):
    """Each member (row number) outside the largest class with the members of other classes that agree in AGREE of its samples."""
    outside = rows["outside"].to_numpy(bool)
    _, number = np.unique(rows["class"].to_numpy(), return_inverse=True)
    others = np.flatnonzero(~outside)
    given, of = sample[others], number[others]
    for i in np.flatnonzero(outside).tolist():
        same = given == sample[i]
        near = np.flatnonzero((same.sum(axis=1, dtype=np.int32) >= AGREE * sample.shape[1]) & (of != number[i]))
        if len(near):
            yield i, others[near], same[near]


def class_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs (a, b) of members of a bucket that stand in different classes and agree in AGREE of their samples.
    ``members``: key, tid, class. Their number grows with the square of a bucket; ``class_links`` decides them in place."""

    def pick(sample: np.ndarray, rows: pd.DataFrame):
        for i, near, _ in _agreeing(sample, rows):
            yield np.column_stack([np.full(len(near), i, dtype=np.int64), near])

    return _pairs_in_groups(_class_blocks(members, texts.select("tid", "sample")), ["key", "b0", "b1"], pick)


def _first_meetings(sample: np.ndarray, rows: pd.DataFrame):
    """``_agreeing``, each pair only in the bucket of the first band that both share."""
    band = int(np.flatnonzero(band_keys(sample[:1])[0].astype(np.int64) == rows["key"].iloc[0])[0])
    for i, near, same in _agreeing(sample, rows):
        first = same[:, _bands()].all(axis=2).argmax(axis=1) == band
        if first.any():
            yield i, near[first]


def _links(rows: pd.DataFrame, meetings, idf: tuple[np.ndarray, np.ndarray], similar: float) -> np.ndarray:
    """Pairs (row numbers) that are similar and connect classes not yet connected by those before: fewer than there are rows."""
    texts = _texts(pa.array(rows["text"], pa.string()))
    parts = []
    for a, b in slices(texts):
        owner, key, times = _shingles(texts[a:b])
        weight, ends = _weights(key, times, idf), np.searchsorted(owner, np.arange(b - a + 1))
        parts += [(key[x:y], weight[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    total = np.array([w.sum() for _, w in parts])
    _, number = np.unique(rows["class"].to_numpy(), return_inverse=True)
    pairs = []
    for i, near in meetings:
        key, weight = parts[i]
        near = near[number[near] != number[i]]
        for at in range(0, len(near), NEAR_AT_ONCE):
            some = near[at : at + NEAR_AT_ONCE]
            some = some[number[some] != number[i]]
            if not len(some):
                continue
            their, heavy = (np.concatenate([parts[j][k] for j in some.tolist()]) for k in (0, 1))
            place = np.minimum(np.searchsorted(key, their), len(key) - 1)
            both = np.where(key[place] == their, np.minimum(weight[place], heavy), 0.0)
            first = np.cumsum([0] + [len(parts[j][0]) for j in some[:-1].tolist()])
            both = np.add.reduceat(both, first)
            share = both / np.maximum(total[some] + total[i] - both, 1e-12)
            for j in some[share >= similar - 1e-9].tolist():  # sums in another order differ in their last places
                if number[j] != number[i] and similarity([(texts[i], texts[j])], idf)[0] >= similar:
                    pairs.append((i, j))
                    number[number == number[j]] = number[i]
    return np.array(pairs, dtype=np.int64).reshape(-1, 2)


def class_links(docs: DataFrame, sampled: DataFrame, members: DataFrame, texts: DataFrame, idf: tuple[np.ndarray, np.ndarray], similar: float) -> DataFrame:
    """Links (a, b) of members of a bucket that stand in different classes: what connects all pairs that ``class_pairs`` gives and
    that are similar. Such pairs are verified where two blocks meet, on the members' whole texts, and each in one bucket;
    only links that connect classes not yet connected come out. Texts go only to the blocks in which they have a pair."""
    held = docs.sparkSession.sparkContext.broadcast(idf)
    keys = ["key", "b0", "b1"]
    blocks = _class_blocks(members, texts.select("tid", "sample"))

    def paired(sample: np.ndarray, rows: pd.DataFrame):
        has = np.zeros(len(rows), dtype=bool)
        for i, near in _first_meetings(sample, rows):
            has[i] = has[near] = True
        yield np.column_stack([np.flatnonzero(has)] * 2)

    def linked(sample: np.ndarray, rows: pd.DataFrame):
        yield _links(rows, _first_meetings(sample, rows), held.value, similar)

    # here a and b are the same member, and the key that of its bucket
    meeting = write_stage(_pairs_in_groups(blocks, keys, paired, "key").select("key", F.col("a").alias("tid")).distinct(), "meeting")
    some = candidate_texts(docs, sampled, meeting.select("tid"))
    some = some.select("tid", "text", F.octet_length("text").alias("bytes")).join(texts.select("tid", "sample"), "tid")
    blocks = _class_blocks(meeting.join(members, ["key", "tid"]), some, "bytes")
    return _pairs_in_groups(blocks, keys, linked)


def hub_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member of a bucket with the member of most links of each of the bucket's HUBS most linked
    other classes. ``members``: key, tid, class, degree."""
    hub = members.where("degree > 0").groupBy("key", "class").agg(F.max(F.struct("degree", "tid")).alias("hub"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("hub.degree"), "hub.tid"))
    hubs = hub.withColumn("place", place).where(F.col("place") <= HUBS).select("key", F.col("class").alias("other"), F.col("hub.tid").alias("b"))
    return members.join(hubs, "key").where("class <> other").select(F.col("tid").alias("a"), "b")


def linked_classes(docs: DataFrame, sampled: DataFrame, texts: DataFrame, idf: tuple[np.ndarray, np.ndarray], similar: float) -> DataFrame:
    """node and the least node of its class, for texts with a link. ``texts``: tid, sample, keys, each tid once.

    Proposal and verification are repeated over the buckets that still hold several classes, until a turn adds no link; a last
    turn verifies all their pairs of different classes. It can't be followed by another: classes only grow, so pairs of
    different classes after it are among those it has tried."""
    equal, members = bucket_members(texts)
    members = write_stage(members, "bucket-members")
    tried = write_stage(_ordered(block_pairs(members, texts, 0).unionByName(equal)), "proposed")
    links = write_stage(verified_pairs(docs, sampled, tried, idf, similar).select("a", "b"), "verified")
    found, turn, last = components(links), 0, False
    while True:
        turn += 1
        degree = links.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("degree"))
        known = members.join(found.toDF("tid", "class"), "tid", "left").join(degree, "tid", "left")
        known = known.withColumn("class", F.coalesce("class", "tid")).fillna(0, ["degree"])
        several = known.groupBy("key").agg(F.min("class").alias("one"), F.max("class").alias("last")).where("one <> last").select("key")
        left = write_stage(known.join(several, "key", "left_semi"), "unsettled")
        if last:
            more = write_stage(class_links(docs, sampled, left, texts, idf, similar), "verified")
            return found if more.isEmpty() else components(more.unionByName(found.toDF("a", "b")))
        pairs = hub_pairs(left) if turn > 1 else hub_pairs(left).unionByName(block_pairs(left, texts, turn))
        new = write_stage(_ordered(pairs).join(tried, ["a", "b"], "left_anti"), "proposed")
        more = None if new.isEmpty() else write_stage(verified_pairs(docs, sampled, new, idf, similar).select("a", "b"), "verified")
        if more is not None and not more.isEmpty():
            tried, links = tried.unionByName(new), links.unionByName(more)
            found = components(more.unionByName(found.toDF("a", "b")))
        else:
            last = True


def candidate_texts(docs: DataFrame, sampled: DataFrame, wanted: DataFrame) -> DataFrame:
    """tid and text of the wanted tids, each once."""
    # one row for each text: that with the least doc_id
    row = sampled.where("tid is not null").groupBy("tid").agg(F.min("doc_id").alias("doc_id")).join(wanted.distinct(), "tid", "left_semi")
    # written, so that its size is known: where it is small it goes to the texts, which then need no shuffle
    row = write_stage(row, "candidates")
    text = F.col("text").cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("d"), text.alias("text")).withColumn("t", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = row.join(given, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t"))).select("tid", "text")
    return write_stage(texts.dropDuplicates(["tid"]), "candidate-texts")


def verified_pairs(docs: DataFrame, sampled: DataFrame, pairs: DataFrame, idf: tuple[np.ndarray, np.ndarray], similar: float) -> DataFrame:
    """The pairs whose whole texts have at least this weighted Jaccard similarity."""
    held = docs.sparkSession.sparkContext.broadcast(idf)
    texts = candidate_texts(docs, sampled, pairs.select(F.col("a").alias("tid")).unionByName(pairs.select(F.col("b").alias("tid"))))
    left, right = texts.toDF("a", "left"), texts.toDF("b", "right")

    def rows(batch):
        pair = list(zip(_texts(batch.column(2)), _texts(batch.column(3)), strict=True))
        for a, b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), similarity(pair, held.value).tolist(), strict=True):
            if s >= similar:
                yield a, b, s

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return map_rows(joined, rows, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """node and the least node of its connected component, for nodes that have a link.

    Alternates large stars (a node's larger neighbours go to its least) and small stars (its smaller
    ones and itself do) until nothing changes; every round is written, and no node's links are
    gathered in one row.
    """
    edges = write_stage(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now every edge goes from a node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = write_stage(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.toDF("node", "least")
        before = now


def _classes(docs: DataFrame, similar: float) -> DataFrame:
    """doc_id, tid, class_id, class_size and kept of every row."""
    texts = docs.where("text is not null").select(F.col("text").cast("string").alias("text"))
    idf = common_shingles(texts)
    sampled = write_stage(sample_texts(docs, idf), "samples")
    once = sampled.where("sample is not null").dropDuplicates(["tid"]).select("tid", "sample", "keys")
    found = linked_classes(docs, sampled, write_stage(once, "sampled-texts"), idf, similar)
    known = sampled.where("tid is not null").select("doc_id", "tid").join(found.toDF("tid", "least"), "tid", "left")
    known = known.select("doc_id", "tid", F.coalesce("least", "tid").alias("class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid"))
    sizes = known.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), first.alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tid") == F.col("first.tid"))
    grouped = known.join(sizes, "class").select("doc_id", "tid", "class_id", "class_size", kept.alias("kept"))
    alone = sampled.where("tid is null").select(
        "doc_id", "tid", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")
    )
    return grouped.unionByName(alone)


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), class_size and kept, which holds for the row that
    stands for its class: that with the least doc_id, of several the least digest (rows equal in both: each)."""
    return _classes(docs, similar).select("doc_id", "class_id", "class_size", "kept")


def keep_one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each class, with all its columns. Rows without a text stay."""
    names = docs.columns
    kept = _classes(docs, similar).where("kept AND tid IS NOT NULL").select(F.col("doc_id").alias("_kept"), F.col("tid").alias("_tid")).distinct()
    digest = F.unhex(F.md5(F.col("text").cast("string").cast("binary")))
    given = docs.where("text is not null").select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("_id"), digest.alias("_digest"))
    one = given.join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_digest") == F.col("_tid"))).dropDuplicates(["_id", "_digest"])
    return one.select(*(F.col("doc")[n].alias(n) for n in names)).unionByName(docs.where("text is null"))
