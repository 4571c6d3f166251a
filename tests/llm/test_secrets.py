import hashlib
import random
import re

from tallymap.llm import secrets

from .helpers import odd_documents, odd_rows


def plain_base(text):
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            spans.append((*m.span(), "assign"))
    spans += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_base_spans_are_those_of_the_patterns():
    draw = random.Random(5)
    pieces = ["token", "SECRET", "api_key", "apikey", "passwd", " ", "=", ":", "'", '"', "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "x", "é", "\n", "deadbeef"]
    for _ in range(3000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 30)))
        base = [s for s in secrets.find(text) if s[2] != "novel"]
        assert sorted(base, key=lambda s: (s[0], secrets.KINDS.index(s[2]))) == plain_base(text)


def test_new_strings_in_sensitive_context_are_found_and_words_are_not():
    key = "Zx81Kq0vPw7LmT3uYb6Nc2Rd"
    found = secrets.find(f"the bearer {key} was sent")
    assert [(s, e, k) for s, e, k in found] == [(11, 11 + len(key), "novel")]
    assert secrets.find(f"the number {key} was sent") == []
    assert secrets.find("the bearer identifier_parameter_request0 was sent") == []
    long = "Q9" + "abcd" * 50_000
    assert all(k != "novel" for _, _, k in secrets.find("token " + long))  # it repeats itself


def test_report_and_odd_rows(spark):
    rows = secrets.secret_report(odd_documents(spark)).collect()
    assert len(rows) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in rows}
    empty = hashlib.sha256(b"").hexdigest()
    assert by_id[2]["base_sha256"] == by_id[3]["base_sha256"] == empty and by_id[2]["spans"] == ""
    eight = by_id[8]
    assert (eight["n_assign"], eight["n_access"], eight["n_hex"], eight["spans"]) == (1, 0, 0, "assign:0:19")
    assert eight["base_sha256"] == hashlib.sha256(b"assign:0:19").hexdigest()
    assert secrets.secret_report(odd_documents(spark, empty=True)).count() == 0


def test_redaction_keeps_rows_and_columns(spark):
    docs = odd_documents(spark)
    done = secrets.redact_secrets(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    by_id = {r["doc_id"]: r for r in done.collect()}
    assert by_id[8]["text"] == "[SECRET] and token: abc" and by_id[8]["n_chars"] == 23
    assert by_id[2]["text"] is None and by_id[2]["n_chars"] is None and by_id[5]["n_chars"] == len(by_id[5]["text"])


def test_long_keys_of_small_alphabets_are_novel():
    draw = random.Random(7)
    prose = "the quick brown fox jumps over the lazy dog while rain falls on the quiet town and nobody looks up at all "
    for letters in ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        for length in (64, 128, 256, 1000):
            found = 0
            for _ in range(50):
                key = "".join(draw.choice(letters) for _ in range(length))
                found += any(k == "novel" for _, _, k in secrets.find(f"{prose * 2}bearer {key} {prose * 2}"))
            assert found >= 48, (letters, length, found)
