"""Main text of web pages: a suffix array per host says what is boilerplate, markup what is chrome.

A page is cut into blocks of tokens, each in a zone: *main* (inside article or main), *chrome* (menus, headers,
footers, sidebars, notices, adverts, forms, comments of readers, by element, role or class) or *open* (neither).
Pages of a host are concatenated, a separate mark after each; the suffix array, sorted to a depth of RUN tokens, brings
equal substrings of that length together, and those found in two or more pages cover the tokens they span. Longer
repeats are chains of such. In open blocks covered runs are boilerplate and removed, unique runs are kept.

In the main zone a block whose tokens are all covered is boilerplate too and removed, unless the article is a copy: where
more than COPIED of a page's main tokens are covered, another page has the same article, which is what is wanted of
both, so all of it is kept. Blocks of the article that are covered in part stay whole. Where a page has a main zone, its open
blocks are not part of the article. (With the suffix array alone, copied articles were lost and unique menus and adverts were kept.)

Every page goes through the suffix array of its host. The different pages of a host are dealt by the digest of their tokens to
parts of about GROUP_BYTES, one for most hosts. A part has a suffix array; where a host has several parts, each gives the hash of its
windows of RUN tokens once, and ranges of these hashes tell which stand in two parts, so in two different streams. The same
tokens are covered as by one suffix array over the whole host, no group grows with it, and copies of a page are one stream.
A page has its text whole, however long.

A null html is taken as empty and gives the empty text, as does a page without main text. Without a host in the url, the url's
text up to the first slash is the host; a null url is a host of its own. Repeated rows count as one page for the suffix
array if all their tokens are equal, and each gets its row. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymap.llm.tables import map_rows, mix, parts, slices, word_hashes
from tallymap.session import write_stage

#: Tokens of a repeated substring, at least.
RUN = 8
#: Share of a page's main tokens that repeat, from which on its article is taken for a copy.
COPIED = 0.5
#: Characters of the token streams of a part, on average.
GROUP_BYTES = 8 << 20

#: Elements whose content isn't text. Fixed values.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "xmp", "noembed", "noframes")
#: Elements that hold no main text. Fixed values.
CHROME = ("nav", "header", "footer", "aside", "form", "dialog", "menu", "select", "button", "head")
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form")
#: Classes and ids that mark chrome, whole. Fixed values.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disclaimer disqus dropdown footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notification pagination pager popup promo promotion recommended related reply replies respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: Elements that begin and end a block. Fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: What may stand beside a mark in a class name of several parts: "share-bar" is chrome, "has-sidebar" or "comments-open" is not.
PLACES = frozenset("area bar block box buttons container form inner item items links list panel section slot wrap wrapper".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: MARKED is chrome by its class or id only, outside main: an article in it is main all the same.
MAIN, CHROMED, OPEN, MARKED = 0, 1, 2, 3

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>"
    r"|</?([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)>)",
    re.S,
)
#: A tag that the page's end cuts off.
_CUT = re.compile(r"<(?:/?[a-zA-Z]|!)[^>]*\Z")
#: An attribute's name and value; the value is one token, so that nothing in it is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_END_RAW = {name: re.compile(rf"</{name}\b[^>]*>|\Z", re.I) for name in RAW}
#: A paragraph ends where one of these begins.
_ENDS_P = BLOCKS - {"br"}


def _attributes(attributes: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return found


def _hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden") == "true"


def _marked(given: dict[str, str]) -> bool:
    """Whether a class or the id is a mark, or begins with marks and goes on with places."""
    for token in f"{given.get('class', '')} {given.get('id', '')}".split():
        if token in MARKS:
            return True
        head, *rest = re.split(r"[-_]+", token)
        if head in MARKS and rest and all(x in MARKS or x in PLACES for x in rest):
            return True
    return False


def blocks(page: str) -> list[tuple[int, list[str]]]:
    """(zone, words) of each block of a page, in page order."""
    found: list[tuple[int, list[str]]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone before each
    zone, at = OPEN, 0

    def close() -> None:
        if pieces:
            words = html.unescape("".join(pieces)).split()
            pieces.clear()
            if words:
                found.append((zone, words))

    while True:
        m = _TAG.search(page, at)
        if m is None:
            pieces.append(_CUT.sub("", page[at:]))
            break
        pieces.append(page[at : m.start()])
        at = m.end()
        name = (m[1] or "").lower()
        if not name:
            continue
        if page[m.start() + 1] == "/":
            if name in BLOCKS:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if zone != stack[k][1]:
                        close()
                    zone = stack[k][1]
                    del stack[k:]
                    break
            continue
        if name in RAW:
            at = _END_RAW[name].search(page, at).end()
            continue
        if name in BLOCKS:
            close()
        if name in _ENDS_P and stack:  # an open paragraph, with what is open inside it, ends here
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    zone = stack[k][1]
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        before, attributes = zone, m[2] or m[3] or ""
        if name in VOID or attributes.endswith("/"):
            continue
        if zone != CHROMED and name not in ("html", "body"):
            given = _attributes(attributes)
            role = given.get("role", "")
            if name in CHROME or role in ROLES or _hidden(given):
                zone = CHROMED
            elif name in ("article", "main") or role == "main":
                zone = MAIN
            elif _marked(given):
                zone = CHROMED if zone == MAIN else MARKED
        if zone != before and pieces:
            zone, now = before, zone
            close()
            zone = now
        stack.append((name, before))
    close()
    return [(CHROMED if zone == MARKED else zone, words) for zone, words in found]


def repeated(streams: list, run: int = RUN) -> list[np.ndarray]:
    """For each stream, which tokens lie in a substring of ``run`` tokens that another stream has too.

    The suffixes of the concatenated streams are ranked by their first 1, 2, 4, ... tokens until the depth is
    reached; suffixes of one rank then share a substring of that length. Tokens are numbers from 0 on.
    """
    streams = [np.asarray(s, dtype=np.int64) for s in streams]
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    n = int(lengths.sum()) + len(streams)
    owner = np.repeat(np.arange(len(streams)), lengths + 1)
    last = np.cumsum(lengths + 1) - 1
    text = np.empty(n, dtype=np.int64)
    inside = np.ones(n, dtype=bool)
    inside[last] = False
    tokens = np.concatenate(streams)
    text[inside] = tokens
    text[last] = int(tokens.max(initial=-1)) + 1 + np.arange(len(streams))  # each end is a token of its own
    rank, depth = text, 1
    while depth < run:
        step = min(depth, run - depth)
        behind = np.zeros(n, dtype=np.int64)
        behind[: max(0, n - step)] = rank[step:] + 1
        joint = rank * (int(behind.max()) + 1) + behind  # both are below the number of tokens and streams: a number of 64 bits
        order = np.argsort(joint)
        following = np.empty(n, dtype=np.int64)
        following[order] = np.cumsum(np.diff(joint[order], prepend=-1) != 0)
        rank, depth = following, depth + step
    order = np.argsort(rank * len(streams) + owner)
    same = np.diff(rank[order]) == 0
    other = np.diff(owner[order]) != 0
    group = np.concatenate([[0], np.cumsum(~same)])
    shared = np.zeros(group[-1] + 1, dtype=bool)
    shared[group[1:][same & other]] = True
    starts = np.zeros(n + 1, dtype=np.int64)
    hit = order[shared[group]]
    starts[hit] += 1  # each start stands once
    starts[np.minimum(hit + run, n)] -= np.where(hit + run < n, 1, 0)
    covered = np.cumsum(starts[:n]) > 0
    return [covered[e - k : e] for e, k in zip(last.tolist(), lengths.tolist(), strict=True)]


def extract(pages: list[str], run: int = RUN) -> list[str]:
    """Main text of each of some pages of one host."""
    cut = [blocks(page) for page in pages]
    numbers: dict[str, int] = {}
    streams = [[numbers.setdefault(w, len(numbers)) for _, words in page for w in words] for page in cut]
    once: dict[tuple, int] = {}
    place = [once.setdefault(tuple(s), len(once)) for s in streams]  # equal pages are one
    covers = repeated([list(s) for s in once], run) if len(once) > 1 else [np.zeros(len(s), bool) for s in once]
    return [_text(page, covers[i]) for page, i in zip(cut, place, strict=True)]


def _text(page: list[tuple[int, list[str]]], covered: np.ndarray) -> str:
    """Main text of a page of blocks; ``covered`` tells which of its tokens are repeated."""
    ends = np.cumsum([len(words) for _, words in page], dtype=np.int64)
    own = [covered[e - len(words) : e] for e, (_, words) in zip(ends.tolist(), page, strict=True)]
    main = [x for (zone, _), x in zip(page, own, strict=True) if zone == MAIN]
    copied = sum(int(x.sum()) for x in main) > COPIED * sum(len(x) for x in main)
    lines = []
    for (zone, words), gone in zip(page, own, strict=True):
        if zone == MAIN and (copied or not gone.all()):
            lines.append(" ".join(words))
        elif zone == OPEN and not main and not gone.all():
            lines.append(" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x))
    return "\n".join(lines)


def packed(page: list[tuple[int, list[str]]]) -> str:
    """The blocks as text: a line for each, its zone before its words. Words hold no white space."""
    return "\n".join(f"{zone}{' '.join(words)}" for zone, words in page)


def unpacked(page: str) -> list[tuple[int, list[str]]]:
    return [(int(line[0]), line[1:].split(" ")) for line in page.split("\n")] if page else []


def stream_of(page: list[tuple[int, list[str]]]) -> str:
    """All tokens of a page, in order."""
    return " ".join(w for _, words in page for w in words)


def windows(tokens: np.ndarray, ends: np.ndarray, host: str, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hash of host and tokens of each window of ``run`` tokens, and where it starts. ``tokens``: those of streams that end at ``ends``."""
    seed = int.from_bytes(hashlib.blake2b(host.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    n = max(0, len(tokens) - run + 1)
    value = np.full(n, seed, dtype=np.uint64)
    for k in range(run):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n])
    starts = np.flatnonzero(np.arange(n) + run <= np.repeat(ends, np.diff(ends, prepend=0))[:n])
    return value[starts], starts


def _tokens(streams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all streams, and where each stream ends. Tokens hold no white space."""
    given = [s.encode("utf-8", "surrogatepass") for s in streams]
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in slices(given):
        words, at = word_hashes(given[a:b])
        hashes.append(words)
        counts.append(np.diff(at))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def _cover(starts: np.ndarray, n: int, run: int) -> np.ndarray:
    """Which of ``n`` tokens lie in a window that begins at one of ``starts``, each of them once."""
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + run] -= 1
    return np.cumsum(edge[:n]) > 0


def _given(pages: DataFrame) -> DataFrame:
    """page_id, url, host and html of the pages."""
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@]*@)?([^/?#:]*)", 1))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )


def _digest(stream: str) -> int:
    return int.from_bytes(hashlib.blake2b(stream.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def judged(given: DataFrame) -> DataFrame:
    """page_id, url and host of every page, with the digests of its tokens (digest) and of its blocks (form), and the characters
    of its tokens (size)."""

    def rows(batch):
        for page_id, url, host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cut = blocks(page)
            stream = stream_of(cut)
            yield page_id, url, host, _digest(stream), _digest(packed(cut)), len(stream)

    return map_rows(given, rows, "page_id long, url string, host string, digest long, form long, size long")


def streams(given: DataFrame) -> DataFrame:
    """host, digest, form and page (its blocks, packed) of the pages, each different page of a host once for a task."""

    def run(batches):
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            out = []
            for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cut = blocks(page)
                text = packed(cut)
                form = _digest(text)
                if (host, form) not in seen:
                    seen.add((host, form))
                    out.append((host, _digest(stream_of(cut)), form, zlib.compress(text.encode("utf-8", "surrogatepass"))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))],
                names=["host", "digest", "form", "page"],
            )

    return given.select("host", "html").mapInArrow(run, "host string, digest long, form long, page binary")


_PART = ["host", "part"]
#: Bits of a window's short hash beyond those that tell the windows of a host from each other.
SPARE_BITS = 6


def _different(rows: pd.DataFrame) -> tuple[list[int], list[str], list[int], list[str]]:
    """Forms and packed blocks of the different pages of a part, the number of each one's stream, and the different streams."""
    rows = rows.drop_duplicates("form")
    cut = [zlib.decompress(page).decode("utf-8", "surrogatepass") for page in rows["page"]]
    once: dict[int, int] = {}
    place = [once.setdefault(int(digest), len(once)) for digest in rows["digest"]]  # equal streams are one
    first = {i: page for i, page in zip(reversed(place), reversed(cut), strict=True)}
    given = [" ".join([line[1:] for line in first[i].split("\n")]) for i in range(len(once))]
    return [int(x) for x in rows["form"]], cut, place, given


def _texts_of_part(run: int):
    """The text of each different page of a part, with the ids and urls of the pages that have it. ``about``: the pages, and the
    part's windows that stand in the host's other parts too."""

    def texts(rows: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"text": [], "ids": [], "urls": []})
        host = rows["host"].iloc[0]
        forms, cut, place, given = _different(rows)
        tokens, ends = _tokens(given)
        _, numbers = np.unique(tokens, return_inverse=True)
        covers = repeated(np.split(numbers, ends[:-1]), run)
        marked = about["windows"].notna()
        if marked.any():
            known = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in about["windows"][marked]]))
            value, starts = windows(tokens, ends, host, run)
            at = np.minimum(np.searchsorted(known, value), len(known) - 1)
            elsewhere = np.split(_cover(starts[known[at] == value], len(tokens), run), ends[:-1])
            covers = [a | b for a, b in zip(covers, elsewhere, strict=True)]
        having: dict[int, tuple[list, list]] = {form: ([], []) for form in forms}
        own = about[~marked]
        for form, page_id, url in zip(own["form"], own["page_id"], own["url"], strict=True):
            having[int(form)][0].append(page_id)
            having[int(form)][1].append(url)
        return pd.DataFrame({
            "text": [_text(unpacked(page), covers[i]) for page, i in zip(cut, place, strict=True)],
            "ids": [having[form][0] for form in forms], "urls": [having[form][1] for form in forms],
        })

    return texts


def _part_windows(rows: pd.DataFrame, run: int) -> np.ndarray:
    """The different windows of a part, in order."""
    host = rows["host"].iloc[0]
    return np.unique(windows(*_tokens(_different(rows)[3]), host, run)[0])


def _gaps(numbers: np.ndarray) -> bytes:
    """Different 64-bit numbers in order, as gaps of seven bits a byte; a byte of 128 and more is followed by another."""
    gap = np.diff(numbers, prepend=np.zeros(1, np.uint64))
    n = np.ones(len(gap), dtype=np.int64)
    for k in range(7, 64, 7):
        n += gap >> np.uint64(k) > 0
    first = np.cumsum(n) - n
    out = np.empty(int(n.sum()), dtype=np.uint8)
    for k in range(int(n.max(initial=0))):
        some = np.flatnonzero(n > k)
        out[first[some] + k] = ((gap[some] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(n[some] > k + 1, np.uint64(128), np.uint64(0))
    return out.tobytes()


def _numbers(gaps: bytes) -> np.ndarray:
    data = np.frombuffer(gaps, np.uint8)
    first = np.flatnonzero(np.concatenate([[True], data[:-1] < 128]))
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
    return np.cumsum(np.add.reduceat((data & np.uint8(127)).astype(np.uint64) << (7 * place).astype(np.uint64), first), dtype=np.uint64)


def _by_ranges(value: np.ndarray, ranges: int):
    """(range, first, last) of the values, which are in order."""
    cuts = np.searchsorted((value >> np.uint64(48)) * np.uint64(ranges) >> np.uint64(16), np.arange(ranges + 1))
    return [(k, i, j) for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]


def _in_several(rows: pd.DataFrame, given: list[np.ndarray]):
    """Of the numbers of each part of a host (each once), those that another part has too."""
    _, place, n = np.unique(np.concatenate(given), return_inverse=True, return_counts=True)
    several, at = (n > 1)[place], 0
    for r, own in zip(rows.itertuples(), given, strict=True):
        hit = several[at : at + len(own)]
        at += len(own)
        if hit.any():
            yield r.host, r.part, own[hit]


def _shared_windows(dealt: DataFrame, ranges: int, run: int) -> DataFrame:
    """host, part and windows that stand in another part of the host too. A part gives short hashes of its windows, then whole
    ones of those whose short hash another part has. ``dealt``: host, part, bits (of a short hash), digest, form, page."""

    def short(rows: pd.DataFrame) -> pd.DataFrame:
        value, bits = _part_windows(rows, run), int(rows["bits"].iloc[0])
        host, part = rows["host"].iloc[0], int(rows["part"].iloc[0])
        out = [(k, host, part, _gaps(np.unique(value[i:j] >> np.uint64(64 - bits)))) for k, i, j in _by_ranges(value, ranges)]
        return pd.DataFrame(out, columns=["range", *_PART, "hashes"])

    def meeting(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.groupby("host", sort=False):
            out += [(host, part, _gaps(hit)) for host, part, hit in _in_several(own, [_numbers(x) for x in own["hashes"]])]
        return pd.DataFrame(out, columns=[*_PART, "hashes"])

    def whole(rows: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(met):
            value, bits = _part_windows(rows, run), int(rows["bits"].iloc[0])
            value = value[np.isin(value >> np.uint64(64 - bits), np.concatenate([_numbers(x) for x in met["hashes"]]))]
            host, part = rows["host"].iloc[0], int(rows["part"].iloc[0])
            out = [(k, host, part, value[i:j].tobytes()) for k, i, j in _by_ranges(value, ranges)]
        return pd.DataFrame(out, columns=["range", *_PART, "windows"])

    def shared(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(host, part, hit.tobytes()) for host, part, hit in _in_several(rows, [np.frombuffer(x, np.uint64) for x in rows["windows"]])]
        return pd.DataFrame(out, columns=[*_PART, "windows"])

    sent = dealt.groupBy(*_PART).applyInPandas(short, "range int, host string, part long, hashes binary")
    met = sent.groupBy("range").applyInPandas(meeting, "host string, part long, hashes binary")
    asked = dealt.groupBy(*_PART).cogroup(met.groupBy(*_PART)).applyInPandas(whole, "range int, host string, part long, windows binary")
    return asked.groupBy("range").applyInPandas(shared, "host string, part long, windows binary")


def main_texts(pages: DataFrame, run: int = RUN) -> DataFrame:
    """page_id, url and text of every page."""
    spark, given = pages.sparkSession, _given(pages)
    known = write_stage(judged(given), "judged-pages")
    once = known.groupBy("host", "digest").agg(F.max("size").alias("size"))
    sizes = once.groupBy("host").agg((F.sum("size") + 1).alias("size")).withColumn("parts", F.ceil(F.col("size") / GROUP_BYTES))
    # a host has fewer windows than an eighth of its characters, or not many more
    bits = F.least(F.lit(64), F.greatest(F.lit(16), F.ceil(F.log2(F.col("size") / 8)) + SPARE_BITS)).cast("int")
    large = write_stage(sizes.where("parts > 1").select("host", "parts", bits.alias("bits")), "large-hosts")
    n_parts = large.agg(F.sum("parts")).first()[0] or 0

    # ids as text: pandas would make numbers with nulls into floating ones
    keys = known.select("host", "digest", "form", F.col("page_id").cast("string").alias("page_id"), "url")
    no_windows = F.lit(None).cast("binary").alias("windows")
    alone = F.lit(0).cast("long").alias("part")
    dealt = streams(given.join(large, "host", "left_anti")).select("host", alone, "digest", "form", "page")
    about = keys.join(large, "host", "left_anti").select("host", alone, "form", "page_id", "url", no_windows)

    def texts(dealt: DataFrame, about: DataFrame) -> DataFrame:
        made = dealt.groupBy(*_PART).cogroup(about.groupBy(*_PART)).applyInPandas(_texts_of_part(run), "text string, ids array<string>, urls array<string>")
        each = made.select("text", F.explode(F.arrays_zip("ids", "urls")).alias("page"))
        return each.select(F.col("page.ids").cast("long").alias("page_id"), F.col("page.urls").alias("url"), "text")

    found = texts(dealt, about)
    if not n_parts:
        return found
    part = F.pmod("digest", "parts").alias("part")
    dealt = streams(given.join(large, "host", "left_semi")).join(large, "host").select("host", part, "bits", "digest", "form", "page")
    shared = _shared_windows(dealt, max(parts(spark), -(-n_parts // 4)), run)
    nothing = {"form": F.lit(0).cast("long"), "page_id": F.lit(None).cast("string"), "url": F.lit(None).cast("string")}
    about = keys.join(large, "host").select("host", part, "form", "page_id", "url", no_windows)
    return found.unionByName(texts(dealt, about.unionByName(shared.withColumns(nothing))))


def page_texts(pages: DataFrame) -> DataFrame:
    return main_texts(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
