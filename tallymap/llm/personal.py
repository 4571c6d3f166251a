"""Personal data: four fixed kinds, and spans that a semi-Markov conditional random field adds.

Base kinds (email, ip, card, phone) are found by pattern. Beyond them, a text is cut into segments: spans of one of the
four types, and single characters of none. Candidate spans are bounded (``GROUPS`` groups of digits, ``LABELS`` labels
of a name) and scored as a whole: number of digits, lengths of their groups, separators, check digit, ranges, what
stands before and behind, cue words. The score of a segmentation is the sum over its spans plus one weight for each pair of
types that touch; a dynamic program over the ends of candidates finds the best one, and in training the sum over all. What
is no span scores 0, so stretches without candidates split a text exactly, and the work grows with the candidates.

The weights are learned here: base spans are the labels, as they stand and in a disguise (the plus sign off, the at sign
spelled, other separators), and numbers of the corpus that are no base span, and decoys (dates, versions, amounts) made
from their digits, are not. At most ``PER_KIND`` pieces of text of each kind, those with the lowest hash, are learned from;
they come to the driver, which fits the weights. Scanning is distributed and reads every whole text; there is no shuffle of texts.

A span that overlaps a base span isn't added. A null text is taken as empty and has no spans; repeated rows are scanned each for
itself, a null doc_id stays null, an empty table gives an empty result; without base spans in the corpus nothing is
learned and nothing added. Other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymap.llm.tables import map_rows, whole_text

KINDS = ("email", "ip", "card", "phone")

#: Pieces of text of each kind, and of none, that the weights are learned from, at most.
PER_KIND = 400
#: Characters of text kept on both sides of a piece, and looked at for cue words.
AROUND = 40
#: Groups of digits of a candidate, and labels of a name, at most.
GROUPS = 8
LABELS = 6
#: Turns of the fit over all pieces, clusters of candidates looked at in one step, and the weight of the squared weights.
TURNS = 8
FEW = 40
PENALTY = 0.5
#: Groups that the pieces of a kind are dealt to before they meet.
SALTS = 64

# ---- base kinds -------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Whole runs of digits: a match can't begin inside one, and long runs aren't tried from each digit.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _only_digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def _emails(text: str) -> list[tuple[int, int, str]]:
    """As the pattern finds them, from the at signs: a long run without one isn't tried from each of its characters."""
    spans, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = domain.end()
                spans.append((start, last, "email"))
        at = text.find("@", max(at + 1, last))
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by kind and start, in code points."""
    spans = _emails(text)
    spans += [(*m.span(), "ip") for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _only_digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((*m.span(), "card"))
    if "+" in text:
        spans += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return spans


# ---- candidates and their features ------------------------------------------------------

#: Between two groups of digits of one number.
_BETWEEN = re.compile(r"[\x20 ().\[\]/‑–+-]{1,4}\Z")
#: In place of the at sign and of the dot of a name.
_AT = r"(?:@|\s?[\[({<]\s?(?:at|AT)\s?[\])}>]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
SPELLED = re.compile(rf"{_AT}(?=[A-Za-z0-9-])")
_NEXT_LABEL = re.compile(rf"({_DOT})([A-Za-z0-9-]+)")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DOTS_BEFORE = re.compile(rf"([A-Za-z0-9_%+-]+)({_DOT})\Z")
_WORD = re.compile(r"[A-Za-z0-9_%+-]+")
_WORD_BEFORE = re.compile(r"[A-Za-z0-9_%+-]+\Z")

#: Words that tell what a number is. Fixed values.
CUES = {
    "phone": ("phone", "tel", "telephone", "mobile", "call", "fax", "whatsapp", "sms", "telefon", "handy", "portable", "movil"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta", "amex"),
    "ip": ("ip", "host", "server", "address", "ping", "addr", "gateway"),
    "email": ("mail", "email", "contact", "write", "courriel", "correo"),
    "other": ("version", "isbn", "date", "order", "page", "year", "total", "price", "section", "id", "number"),
}
_CUE = {word: kind for kind, words in CUES.items() for word in words}
_LETTERS = re.compile(r"[A-Za-z]+")


def _side(c: str) -> str:
    if not c:
        return "none"
    if c.isalnum():
        return "digit" if c.isdigit() else "letter"
    return "space" if c.isspace() else c if c in ".-+/:,()@" else "mark"


def _around(text: str, start: int, end: int) -> list[str]:
    before, after = text[max(0, start - AROUND) : start], text[end : end + 2]
    found = ["before=" + _side(before[-1:]), "after=" + _side(after[:1])]
    if before[-1:] and not before[-1].isalnum() and before[-2:-1].isdigit():
        found.append("goes_on_before=" + _side(before[-1]))
    if after and not after[0].isalnum() and after[1:].isdigit():
        found.append("goes_on_behind=" + _side(after[0]))
    found += sorted({"cue=" + _CUE[w] for w in map(str.lower, _LETTERS.findall(before)[-4:]) if w in _CUE})
    return found


def _number_features(groups: list[str], between: list[str], lead: str) -> list[str]:
    n = sum(map(len, groups))
    marks = "".join(sorted({"_" if c.isspace() else c for b in between for c in b}))
    return [
        f"digits={n}", "shape=" + "-".join(str(len(g)) for g in groups), "marks=" + marks, "lead=" + lead,
        "groups=" + str(len(groups)), "alike=" + str(len(set(between)) <= 1), f"marks={marks}&lead={lead}",
    ]


def _numbers(text: str) -> list[tuple[int, int, str, list[str]]]:
    """Candidates made of groups of digits. Groups are whole runs of digits, so none is cut."""
    runs = [m.span() for m in DIGITS.finditer(text)]
    out = []
    for i, (start, _) in enumerate(runs):
        groups, between, n = [], [], 0
        for j in range(i, min(i + GROUPS, len(runs))):
            if j > i:
                gap = text[runs[j - 1][1] : runs[j][0]] if runs[j][0] - runs[j - 1][1] <= 4 else ""
                if not _BETWEEN.match(gap):
                    break
                between.append(gap)
            n += runs[j][1] - runs[j][0]
            if n > 19:
                break
            groups.append(text[runs[j][0] : runs[j][1]])
            end = runs[j][1]
            octets = len(groups) == 4 and all(len(g) <= 3 for g in groups) and "." in between[0]
            if n < 7 and not octets:
                continue
            leads = [(start, "0" if groups[0][0] == "0" else "digit")]
            for sign in ("(", "+", "+("):
                if start >= len(sign) and text[start - len(sign) : start] == sign:
                    leads.append((start - len(sign), sign))
            for at, lead in leads:
                features = None
                if 7 <= n <= 15:
                    features = _number_features(groups, between, lead) + _around(text, at, end)
                    out.append((at, end, "phone", features))
                if octets and lead in ("digit", "0"):
                    own = _number_features(groups, between, lead)[2:] + _around(text, at, end)
                    out.append((at, end, "ip", [*own, "octets=" + str(all(map(_octet, groups)))]))
                if n >= 13 and lead in ("digit", "0"):
                    digits = "".join(groups)
                    own = features or _number_features(groups, between, lead) + _around(text, at, end)
                    out.append((at, end, "card", [*own, "check=" + str(luhn(digits)), f"check={luhn(digits)}&digits={n}"]))
    return out


def _names(text: str) -> list[tuple[int, int, str, list[str]]]:
    """Candidates around an at sign, or what stands for it, with dots or what stands for them."""
    out = []
    for m in SPELLED.finditer(text):
        starts, at = [], m.start()
        word = _WORD_BEFORE.search(text, max(0, at - 64), at)
        while word and len(starts) < LABELS:
            starts.append((word.start(), len(starts)))
            more = _DOTS_BEFORE.search(text, max(0, word.start() - 64), word.start())
            word = more and _WORD.match(text, more.start())
        label = _LABEL.match(text, m.end())
        ends, place = [], label.end()
        while len(ends) < LABELS and (more := _NEXT_LABEL.match(text, place)):
            place = more.end()
            ends.append((place, more[1].strip(), more[2]))
        mark = m[0].strip().lower()
        for start, dots in starts:
            for k, (end, dot, label) in enumerate(ends):
                dot = dot.lower()
                features = [
                    "at=" + mark, "dot=" + dot, f"at={mark}&dot={dot}", f"names={min(dots, 3)}", f"labels={k + 1}",
                    f"last={min(len(label), 8)}", "last_letters=" + str(label.isalpha()), *_around(text, start, end),
                ]
                out.append((start, end, "email", features))
    return out


def candidates(text: str) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, type, features) of all spans that may be personal data, by end and start."""
    return sorted(_numbers(text) + _names(text), key=lambda c: (c[1], c[0], c[2]))


# ---- segmentations ----------------------------------------------------------------------


def _sum_logs(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def _clusters(found: list) -> list[tuple[int, int]]:
    """Ranges of candidates (by end) that neither overlap nor touch those of other ranges."""
    reach = [c[0] for c in found]
    for i in range(len(found) - 2, -1, -1):
        reach[i] = min(reach[i], reach[i + 1])
    cuts = [i for i in range(1, len(found)) if reach[i] > found[i - 1][1]]
    return list(zip([0, *cuts], [*cuts, len(found)], strict=True)) if found else []


def best_segments(found: list, scores: list[float], touch: dict[tuple[str, str], float]) -> list[int]:
    """Candidates of the best segmentation; of equal ones that with fewer and earlier spans."""
    chosen = []
    for first, stop in _clusters(found):
        part = found[first:stop]
        ends = [c[1] for c in part]
        own, back = [], []  # best that ends with a candidate, and the candidate that touches it before (or -1)
        whole, last = [0.0], [-1]  # best with the first i candidates, and the last of it
        for i, (start, _, kind, _) in enumerate(part):
            at = bisect.bisect_left(ends, start)
            best, link = whole[at], -1
            while at < i and ends[at] == start:
                joined = own[at] + touch.get((part[at][2], kind), 0.0)
                if joined > best:
                    best, link = joined, at
                at += 1
            own.append(scores[first + i] + best)
            back.append(link)
            better = own[i] > whole[i]
            whole.append(own[i] if better else whole[i])
            last.append(i if better else last[i])
        k = last[-1]
        while k >= 0:
            chosen.append(first + k)
            k = back[k] if back[k] >= 0 else last[bisect.bisect_left(ends, part[k][0])]
    return sorted(chosen)


def marginals(found: list, scores: list[float], touch: dict[tuple[str, str], float]) -> tuple[float, list[float], dict[tuple[str, str], float]]:
    """Log of the sum over all segmentations, and the share of each candidate and of each pair of types that touch."""
    n = len(found)
    ends, starts = [c[1] for c in found], [c[0] for c in found]
    inside = [0.0] * n  # segmentations of the text up to the end of a candidate that end with it
    upto = [0.0] * (n + 1)
    links = [[j for j in range(i) if ends[j] == starts[i]] for i in range(n)]
    for i in range(n):
        free = upto[bisect.bisect_left(ends, starts[i])]
        parts = [free] + [inside[j] + touch.get((found[j][2], found[i][2]), 0.0) for j in links[i]]
        inside[i] = scores[i] + _sum_logs(parts)
        upto[i + 1] = _sum_logs([upto[i], inside[i]])
    total = upto[n]
    share = [0.0] * n
    reached = [0.0] * (n + 1)  # probability that the free state after i candidates is passed
    reached[n] = 1.0
    touched: dict[tuple[str, str], float] = {}
    for i in range(n - 1, -1, -1):
        # candidates that touch a later one got their share from it already
        p = reached[i + 1] * math.exp(inside[i] - upto[i + 1])
        reached[i] += reached[i + 1] - p
        share[i] += p
        free = upto[bisect.bisect_left(ends, starts[i])]
        rest = inside[i] - scores[i]
        reached[bisect.bisect_left(ends, starts[i])] += share[i] * math.exp(free - rest)
        for j in links[i]:
            pair = (found[j][2], found[i][2])
            p = share[i] * math.exp(inside[j] + touch.get(pair, 0.0) - rest)
            share[j] += p
            touched[pair] = touched.get(pair, 0.0) + p
    return total, share, touched


@dataclass(frozen=True)
class Model:
    """Weight of each (type, feature), and of each pair of types that touch."""

    weights: dict[tuple[str, str], float]
    touch: dict[tuple[str, str], float]

    def score(self, candidate) -> float:
        kind, get = candidate[2], self.weights.get
        return get((kind, ""), 0.0) + sum(get((kind, f), 0.0) for f in candidate[3])


def added_spans(text: str, base: list[tuple[int, int, str]], model: Model) -> list[tuple[int, int, str]]:
    """Spans of the best segmentation beside the base spans."""
    if not model.weights:
        return []
    taken = sorted((s, e) for s, e, _ in base)
    ends = []  # furthest end so far
    for _, e in taken:
        ends.append(max(e, ends[-1]) if ends else e)

    def free(c) -> bool:
        i = bisect.bisect_left(taken, (c[1], -1))
        return i == 0 or ends[i - 1] <= c[0]

    found = [c for c in candidates(text) if free(c)]
    best = best_segments(found, [model.score(c) for c in found], model.touch)
    return [found[i][:3] for i in best]


# ---- learning ---------------------------------------------------------------------------


def _draw(text: str, n: int) -> int:
    return int.from_bytes(hashlib.sha256(text.encode("utf-8", "replace")).digest()[:6], "little") % n


def disguised(span: str, kind: str) -> str:
    """The same data written another way, chosen by its own digest."""
    way = _draw(span, 6)
    digits = _only_digits(span)
    if kind == "email":
        at = (" at ", " (at) ", "[at]", "(at)", " [at] ", "@")[way]
        dot = (" dot ", " (dot) ", "[dot]", ".", " [dot] ", "[.]")[way]
        name, _, domain = span.partition("@")
        return name + at + domain.replace(".", dot)
    if kind == "ip":
        return span.replace(".", ("[.]", "(.)", " . ", "[.]", "(.)", ".")[way])
    if kind == "card":
        mark = (" ", ".", "–", "/", "‑", ".")[way]
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own = digits[-10:] if len(digits) >= 10 else digits
    a, b, c = own[: len(own) - 7], own[-7:-4], own[-4:]
    return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits[:-10] or '1'} {a} {b} {c}", f"{a}/{b}-{c}")[way]


def decoy(digits: str) -> str:
    """A number that is no personal data, made of some digits."""
    d = (digits * 3 + "1234567890123456789")[:19]
    year, month, day = f"{1900 + int(d[:3]) % 130}", f"{1 + int(d[3:5]) % 12:02d}", f"{1 + int(d[5:7]) % 28:02d}"
    wrong = str((int(d[15]) + 1 + luhn(d[:15] + d[15])) % 10)
    bad = d[:15] + (wrong if not luhn(d[:15] + wrong) else str((int(wrong) + 1) % 10))
    ways = (
        f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{d[0]}.{d[1:3]}.{d[3]}", f"{d[:3]}.{d[3:9]}",
        f"{1 + int(d[0])} {d[1:4]} {d[4:7]}", d[:7], d[:9], d[:10], d[:12], bad, " ".join(bad[i : i + 4] for i in range(0, 16, 4)),
        f"{year}-{1 + int(year)}", f"{year}{month}{day}", f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", f"{300 + int(d[:2])}.{d[2:4]}.{d[4:6]}.{d[6:8]}",
        f"{year}-{month}-{day} {d[7]}", f"{d[0]}.{d[1]}.{d[2]}", f"{d[:2]} {d[2:4]} {d[4:6]} {d[6:8]} {d[8:10]} {d[10:12]} {d[12]}",
    )
    return ways[_draw(digits, len(ways))]


def pieces(text: str, around: int = AROUND) -> list[tuple[str, str, int, int]]:
    """(kind, text around, start and end in it) of the base spans, and of numbers that are none (kind ``none``)."""
    base = base_spans(text)
    taken = sorted((s, e) for s, e, _ in base)
    out = [(kind, text[max(0, s - around) : e + around], min(s, around), min(s, around) + e - s) for s, e, kind in base if e - s <= 100]
    for m in DIGITS.finditer(text):
        s, e = m.span()
        i = bisect.bisect_right(taken, (s, math.inf))
        near = (i > 0 and taken[i - 1][1] + 5 > s) or (i < len(taken) and taken[i][0] - 5 < e)
        if not near and 4 <= e - s <= 100:
            out.append(("none", text[max(0, s - around) : e + around], min(s, around), min(s, around) + e - s))
    return out


def training_pieces(docs: DataFrame, per_kind: int = PER_KIND) -> list[tuple[str, str, int, int]]:
    """The different pieces of each kind with the lowest hash, at most ``per_kind`` of a kind. A task gives no more than that
    either, and these meet in ``SALTS`` groups of a kind before they meet in one."""
    schema = "kind string, h long, piece string, start int, stop int"

    def lowest(rows):
        by_kind: dict[str, list] = {}
        for row in rows:
            by_kind.setdefault(row[0], []).append(row)
        return {row for group in by_kind.values() for row in heapq.nsmallest(per_kind, group, key=lambda r: r[1:])}

    def run(batches):
        best: set[tuple] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                best.update((kind, _draw(f"{kind} {start} {piece}", 1 << 48), piece, start, stop) for kind, piece, start, stop in pieces(text))
                if len(best) > 4 * per_kind * (len(KINDS) + 1):
                    best = lowest(best)
        best = lowest(best)
        if best:
            yield pa.RecordBatch.from_pylist([dict(zip(("kind", "h", "piece", "start", "stop"), r, strict=True)) for r in sorted(best)], schema=arrow)

    arrow = pa.schema([("kind", pa.string()), ("h", pa.int64()), ("piece", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
    found = docs.select(whole_text().alias("text")).mapInArrow(run, schema).distinct()
    order = ["h", "piece", "start", "stop"]
    for group in (["kind", F.col("h") % SALTS], ["kind"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        found = found.withColumn("place", place).where(F.col("place") <= per_kind).drop("place")
    return sorted((r["kind"], r["piece"], r["start"], r["stop"]) for r in found.collect())


def examples(found: list[tuple[str, str, int, int]]) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with their spans: pieces as they stand, disguised, and with decoys."""
    out = []

    def add(piece: str, start: int, end: int, middle: str, kind: str | None) -> None:
        at = start + len(middle)
        spans = base_spans(piece[:start]) + ([(start, at, kind)] if kind else [])
        spans += [(s + at, e + at, k) for s, e, k in base_spans(piece[end:])]
        out.append((piece[:start] + middle + piece[end:], spans))

    for kind, piece, start, end in found:
        span = piece[start:end]
        add(piece, start, end, span, None if kind == "none" else kind)
        if kind != "none":
            add(piece, start, end, disguised(span, kind), kind)
        if kind == "email":
            add(piece, start, end, span.replace("@", " at "), None)  # a place, not an address
        add(piece, start, end, decoy(_only_digits(span) or str(_draw(span, 10**9))), None)
    return out


def fit(texts: list[tuple[str, list[tuple[int, int, str]]]], turns: int = TURNS, penalty: float = PENALTY) -> Model:
    """Weights of the greatest likelihood of the spans, less a penalty on their squares, by gradient steps on a few texts each."""
    names: dict[tuple[str, str], int] = {}
    touches = {(a, b): i for i, (a, b) in enumerate((a, b) for a in KINDS for b in KINDS)}
    tasks = []
    for text, spans in texts:
        found = candidates(text)
        given = {i for i, c in enumerate(found) if c[:3] in spans}
        if len(given) < len(spans):
            continue
        columns = [[names.setdefault((c[2], f), len(names)) for f in ("", *c[3])] for c in found]
        for first, stop in _clusters(found):
            tasks.append((found[first:stop], columns[first:stop], {k - first for k in given if first <= k < stop}))
    if not names:
        return Model({}, {})
    n = len(names)
    w, square, speed, step = np.zeros(n + len(touches)), np.zeros(n + len(touches)), np.zeros(n + len(touches)), 0
    draw = np.random.default_rng(1)
    for turn in range(turns):
        order = draw.permutation(len(tasks))
        for few in np.array_split(order, max(1, len(tasks) // FEW)):
            gradient = (penalty * len(few) / len(tasks)) * w
            touch = {pair: w[n + i] for pair, i in touches.items()}
            for t in few.tolist():
                found, columns, given = tasks[t]
                _, share, touched = marginals(found, [float(w[c].sum()) for c in columns], touch)
                for k, p in enumerate(share):
                    if abs(p - (k in given)) > 1e-6:
                        np.add.at(gradient, columns[k], p - (k in given))
                for pair, p in touched.items():
                    gradient[n + touches[pair]] += p
                own = [found[k] for k in sorted(given)]
                for a, b in zip(own, own[1:], strict=False):
                    if a[1] == b[0]:
                        gradient[n + touches[a[2], b[2]]] -= 1
            step += 1
            speed = 0.9 * speed + 0.1 * gradient
            square = 0.99 * square + 0.01 * gradient**2
            w -= 0.1 * (1 - turn / turns) * (speed / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model({name: float(w[i]) for name, i in names.items()}, {pair: float(w[n + i]) for pair, i in touches.items()})


def train(docs: DataFrame, per_kind: int = PER_KIND) -> Model:
    found = training_pieces(docs, per_kind)
    if all(kind == "none" for kind, *_ in found):
        return Model({}, {})
    return fit(examples(found))


# ---- scan -------------------------------------------------------------------------------


def find(text: str, model: Model) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and added spans, each by kind and start."""
    base = base_spans(text)
    return base, sorted(added_spans(text, base, model), key=lambda s: (KINDS.index(s[2]), s[0]))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and its spans: array of kind, start, end (code points, end exclusive), found text and whether it is a base one."""

    def rows(batch):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base, added = find(text, model)
            spans = [(KINDS.index(k), s, e, True) for s, e, k in base] + [(KINDS.index(k), s, e, False) for s, e, k in added]
            yield doc, [{"kind": KINDS[k], "start": s, "end": e, "found": text[s:e], "base": b} for k, s, e, b in sorted(spans)]

    return map_rows(
        docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")),
        rows,
        "doc_id long, spans array<struct<kind:string,start:long,end:long,found:string,base:boolean>>",
    )


def personal_report(docs: DataFrame) -> DataFrame:
    """One row per document: base spans by kind, their digest, and all spans as text."""

    def listed(spans):
        piece = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(piece, ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: (s["kind"] == kind) & s["base"])).cast("long").alias(f"n_{kind}")

    base = listed(F.filter("spans", lambda s: s["base"]))
    return scan(docs, train(docs)).select(
        "doc_id",
        *(count(kind) for kind in KINDS),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
