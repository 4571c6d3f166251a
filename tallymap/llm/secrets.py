"""Secret scan: three fixed kinds, and strings that a primed zstandard compressor finds new.

Base kinds are found by pattern. Beyond them, a long mixed string that follows a sensitive
word is a candidate. Its novelty is the number of bytes it adds to the compressed size of the
text around it, per character, with a compressor primed with identifiers of common code. Words
and identifiers cost little there, keys cost nearly their entropy. That is at most the bits of a
symbol in the key's alphabet (4 in hex, 5 in base32, else 6), so those at or above ``NOVELTY`` of it are
reported as kind ``novel``, however long.

Everything happens within a document, so there is no shuffle and no group. A null text is
taken as empty and has no spans; repeated rows are scanned each for itself; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymap.llm.tables import map_rows

KINDS = ("assign", "access", "hex", "novel")

#: Bits added per bit of the candidate's alphabet from which it is reported: 0.7 bytes of the 0.75 that base64 has.
NOVELTY = 0.7 / 0.75
#: Characters of text on each side that count as surrounding code.
AROUND = 200
#: A candidate begins at most this many characters behind the sensitive word.
REACH = 48

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A run of 24 hex digits has eight of them at every third character.
EACH_THIRD = re.compile(r"[0-9a-f]{8}")

#: Words that make what follows them sensitive, in lower case. Fixed values.
SENSITIVE = (
    "passphrase", "password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "private_key",
    "auth", "bearer", "credential", "signature", "session_id", "cookie",
)
CONTEXT = re.compile("|".join(SENSITIVE))
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Alphabets in which a key has fewer than 6 bits a character.
ALPHABETS = ((re.compile(r"(?:[0-9A-F]+|[0-9a-f]+)"), 4), (re.compile(r"[A-Z2-7]+=*"), 5))

#: Identifiers of common code that the compressor knows beforehand. Fixed values.
IDENTIFIERS = (
    "abstract account action address append application argument array assert async attribute auth author await "
    "base64 begin binary boolean branch buffer build button bytes cache callback catch channel character class client "
    "close collection column command comment commit compare component config connection const constructor container "
    "content context continue control cookie count create credential current cursor database datetime debug decode "
    "default define delete description device dictionary directory disable display document domain double download "
    "element email enable encode encoding endpoint environment error event example exception execute expire export "
    "extension false field filter final float format frame function generate getattr global group handler hash header "
    "height hidden history host html identifier image implement import include index initialize input insert instance "
    "integer interface internal iterator javascript json key keyword label language length library license listener "
    "load local location logger login manager match memory message metadata method model module namespace network "
    "notification number object offset operation option output override package page parameter parent password path "
    "pattern permission platform plugin pointer position prefix private process production profile project property "
    "protected protocol provider public query queue random range reader record redirect reference refresh register "
    "release remote remove render replace repository request require resource response result return role route "
    "sample schedule schema scope script search secret section select self sender sequence serialize server service "
    "session setting signature size socket source static status storage stream string struct style submit success "
    "super switch system table target template test text thread throw timeout timestamp title token trace transaction "
    "transform true type undefined union update upload url user username utils valid value variable vector version "
    "view virtual visible void volume while widget width window worker write access_key_id api_key client_id "
    "client_secret content_type created_at file_name is_active max_length private_key public_key refresh_token "
    "request_id secret_access_key session_id updated_at user_id ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "abcdefghijklmnopqrstuvwxyz 0123456789 00000000 11111111 12345678 deadbeef xxxxxxxx"
)


class Novelty:
    """Bytes that a string adds to the compressed text around it."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._pack = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)

    def bytes_added(self, before: str, found: str, after: str) -> int:
        around = len(self._pack.compress((before + after).encode("utf-8", "replace")))
        return len(self._pack.compress((before + found + after).encode("utf-8", "replace"))) - around


_shared: list[Novelty] = []


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, in code points."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if EACH_THIRD.search(text[2::3]):
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return spans


def alphabet_bits(found: str) -> int:
    """Bits of a character in the smallest alphabet that holds the string."""
    return next((bits for pattern, bits in ALPHABETS if pattern.fullmatch(found)), 6)


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: float = NOVELTY) -> list[tuple[int, int, str]]:
    """Candidates in sensitive context, apart from base spans, whose novelty is high enough."""
    low = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)
    reach = [m.end() for m in CONTEXT.finditer(low)]
    spans, done = [], 0
    for at in reach:
        for m in CANDIDATE.finditer(text, max(at, done), at + REACH + 16):
            start = m.start()
            end = CANDIDATE.match(text, start).end()  # it may run on beyond the window
            done = max(done, end)
            found = text[start:end]
            if any(s < end and start < e for s, e, _ in base):
                continue
            if not re.search("[0-9]", found) or not re.search("[A-Za-z]", found):
                continue
            if not _shared:
                _shared.append(Novelty())
            added = _shared[0].bytes_added(text[max(0, start - AROUND) : start], found, text[end : end + AROUND])
            if 8 * added >= novelty * alphabet_bits(found) * len(found):
                spans.append((start, end, "novel"))
    return spans


def find(text: str, novelty: float = NOVELTY) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then by kind in the order of ``KINDS``."""
    spans = base_spans(text)
    low = text.lower()
    if any(word in low for word in SENSITIVE):
        spans += novel_spans(text, spans, novelty)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan_secrets(docs: DataFrame, novelty: float = NOVELTY) -> DataFrame:
    """doc_id and its spans: array of kind, start, end (code points, end exclusive) and the found text."""

    def rows(batch):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield doc, [{"kind": k, "start": s, "end": e, "found": text[s:e]} for s, e, k in find(text, novelty)]

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return map_rows(
        docs.select(F.col("doc_id").cast("long"), text.alias("text")),
        rows,
        "doc_id long, spans array<struct<kind:string,start:long,end:long,found:string>>",
    )


def redact_secrets(docs: DataFrame, novelty: float = NOVELTY, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced; overlapping spans become one mark. Nothing is dropped;
    a null text stays null. n_chars, where the table has it, is that of the new text."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    parts, last = [], 0
                    for start, end, _ in find(text, novelty):
                        if start >= last:
                            parts += [text[last:start], mark]
                        last = max(last, end)
                    text = "".join([*parts, text[last:]]) if parts else text
                out.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    done = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        kind = schema["n_chars"].dataType
        changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
        done = done.withColumn("n_chars", changed)
    return done



def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, and all spans as text."""

    def listed(spans):
        piece = F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        )
        return F.array_join(piece, ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = listed(F.filter("spans", lambda s: s["kind"] != "novel"))
    return scan_secrets(docs).select(
        "doc_id",
        *(count(kind) for kind in KINDS[:3]),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count("novel"),
    )
