"""Token ids of whole texts with a tokenizer file, faster through a store of pieces already seen.

Both kinds of tokenizer cut a text at white space before anything else, so the ids of a text
are those of its pieces one after the other, a piece being white space with the run behind
it. Pieces recur, so a worker keeps the ids of those it has seen; new ones go to the
tokenizer in one batch. Texts with white space other than blank and newline, and texts that
may hold special tokens, go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from tallymap.llm.tables import SLICE_BYTES

_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD = re.compile(r"[^\S \n]")
_ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: A word that cutting and normalizing leave as it is, up to its case: the byte-pair model alone gives its ids.
_WORD = re.compile(f" ?[{_LETTERS}]+")
#: A word with marks behind it: a tokenizer cuts behind letters, so its ids are those of both parts.
_MARKED = re.compile(f"( ?[{_LETTERS}]+)([!-&(-/:-@\\[-`{{-~]+)")
#: A longer piece isn't kept.
_LONGEST = 64

_open: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, without special tokens.

    Pieces are kept in two generations of ``most`` each: when the younger is full it becomes
    the older, and what is used again moves over.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Whether white space has a part in the ids.
        self.model = self.tokenizer.model
        # byte-level models write a byte as a character: visible ones as themselves, the others from 256 on
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.shown = {b: chr(b) if b in visible else chr(next(hidden)) for b in range(256)}
        self.spaced = self._whole([" a"]) != self._whole(["a"])
        #: Whether letters are told apart by case.
        self.cased = self._whole(["A"]) != self._whole(["a"])

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    @staticmethod
    def _simple(text: str) -> bool:
        if "<|" in text:
            return False
        if text.isascii():
            return not any(c in text for c in _ODD_ASCII)
        return not _ODD.search(text)

    def _stored(self, piece: str) -> bool:
        if piece in self.young:
            return True
        if piece in self.old:
            self.young[piece] = self.old[piece]
            return True
        return False

    def _word(self, word: str) -> bytes:
        shown = word.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _encode(self, pieces: list[str]) -> None:
        rest = []
        for p in pieces:
            if not self._stored(p):
                if _WORD.fullmatch(p) and (self.cased or p.islower()):
                    self.young[p] = self._word(p)
                else:
                    rest.append(p)
        if rest:
            self.young.update(zip(rest, self._whole(rest), strict=True))

    def _parts(self, piece: str) -> list[str]:
        """Parts whose ids make up those of the piece: a word in one case, and the marks behind it."""
        marked = _MARKED.fullmatch(piece)
        parts = list(marked.groups()) if marked else [piece]
        if not self.cased and _WORD.fullmatch(parts[0]):
            parts[0] = parts[0].lower()
        return parts

    def _pieces(self, text: str) -> bytes:
        pieces = _PIECE.findall(text) if self.spaced else text.split()
        new = {p: self._parts(p) for p in set(pieces) if not self._stored(p)}
        self._encode(list({part for parts in new.values() for part in parts}))
        young = self.young
        for p, parts in new.items():
            if len(parts) > 1 or parts[0] != p:
                young[p] = b"".join([young[part] for part in parts])
        ids = b"".join(map(young.__getitem__, pieces))
        for p in new:
            if len(p) > _LONGEST:
                young.pop(p, None)
                for part in new[p]:
                    young.pop(part, None)
        if len(young) > self.most:
            self.old, self.young = young, {}
        return ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self._simple(text):
            return self._whole([text])[0]
        if len(text) <= SLICE_BYTES:
            return self._pieces(text)
        out, at = [], 0
        while at < len(text):  # cut where a run of white space begins
            end = min(len(text), at + SLICE_BYTES)
            cut = re.compile(r"(?<=[^ \n])(?=[ \n])").search(text, end)
            end = cut.start() if end < len(text) and cut else len(text)
            out.append(self._pieces(text[at:end]))
            at = end
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it stays for later tasks."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
