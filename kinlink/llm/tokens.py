"""Token ids of whole texts as little-endian unsigned 32-bit bytes, by the tokenizers library.

A text is cut where its tokenizer always cuts, each piece is encoded by the library once and kept, and the
pieces' ids are joined; a piece of letters alone is put straight to the library's model. Pieces are cut only at one
space or line end between two plain Latin characters, where word-level and byte-level BPE pre-tokenizers always begin
a new word; all other text stays in larger pieces. A text that spells one of the vocabulary's added tokens goes to the
library whole, which cuts it there.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

PLAIN = "!-~¡-ɏ"
PLAIN_WORD = re.compile(f"[{PLAIN}]+")
TAILED = re.compile(r"( ?[^\W\d_]+)([!-/:-@\[-^`{-~]+)")
PLAIN_BYTES = bytes([10, *range(32, 127), *range(161, 256)])
KEEP = 1 << 19


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters for bytes: printable Latin-1 characters stand for themselves, the others for 256 and on in their order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


BYTES = _byte_letters()
SPACE = BYTES[32]


def vocabulary(name_or_path: str) -> str:
    """A tokenizer file: a path, or the name of one of the public tokenizers."""
    if os.path.exists(name_or_path):
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class Known(dict):
    """The ids of pieces as bytes, had from the library when first asked for."""

    def __init__(self, tokenizer, spaces_stay: bool, keep: int):
        super().__init__()
        self.tokenizer, self.model, self.spaces_stay, self.keep = tokenizer, tokenizer.model, spaces_stay, keep
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            plain = piece if self.spaces_stay else piece.lower()
            word = plain[1:] if plain[:1] == " " and self.spaces_stay else plain
            if word.isalpha() and PLAIN_WORD.fullmatch(word):  # one pre-token, so the library's model can have it alone
                letters = plain.replace(" ", SPACE) if plain.isascii() else plain.encode().decode("latin-1").translate(BYTES)
                found = [t.id for t in self.model.tokenize(letters)]
                ids = struct.pack(f"<{len(found)}I", *found)
            elif m := TAILED.fullmatch(piece):
                ids = self[m[1]] + self[m[2]]  # a word and the marks behind it are encoded apart in any case
            else:
                found = self.tokenizer.encode(piece, add_special_tokens=False).ids
                ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= 64:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class TextEncoder:
    """encode(texts) gives each text's ids' bytes, with end_id appended. It keeps the ids of the pieces used last, keep to 2 * keep of them: memory for time."""

    def __init__(self, name_or_path: str, end_id: int | None = 2, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        path = vocabulary(name_or_path)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        rules = json.dumps({k: given[k] for k in ("normalizer", "pre_tokenizer")})
        self.added = re.compile("|".join(re.escape(t["content"]) for t in given["added_tokens"]) or r"(?!)", re.IGNORECASE)
        self.spaces_stay = '"ByteLevel"' in rules and "\\\\s+" not in json.dumps(json.loads(rules).get("normalizer"))
        cut = f"(?<=[{PLAIN}])(?= [{PLAIN}])" if self.spaces_stay else f"(?<=[{PLAIN}])[ \n](?=[{PLAIN}])"
        self.cut = re.compile(cut)
        starts = {"" if t["normalized"] else t["content"][:2] for t in given["added_tokens"]}
        self.mark = starts.pop() if len(starts) == 1 else ""  # what every added token begins with, sought before the rest
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        self.known = Known(self.tokenizer, self.spaces_stay, keep)

    def _is_plain(self, text: str) -> bool:
        """Whether a text has plain characters of Latin-1, spaces and line ends only, these single and inside where they stay."""
        try:
            if text.encode("latin-1").translate(None, PLAIN_BYTES):
                return False
        except UnicodeEncodeError:
            return False
        blanks = ("  ", " \n", "\n ", "\n\n")
        return not self.spaces_stay or not (text[0] in " \n" or text[-1] in " \n" or any(b in text for b in blanks))

    def pieces(self, text: str) -> list[str]:
        if not self._is_plain(text):
            return self.cut.split(text)
        if self.spaces_stay:
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [(self._whole(t) if self.mark in t and self.added.search(t) else b"".join(map(self.known.__getitem__, self.pieces(t)))) + self.end if t else self.end for t in texts]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[tuple, TextEncoder] = {}


def encoder(name_or_path: str, end_id: int | None = 2, keep: int = KEEP) -> TextEncoder:
    """One encoder a Python worker, which serves many tasks."""
    key = (name_or_path, end_id, keep)
    if key not in _encoders:
        _encoders[key] = TextEncoder(name_or_path, end_id, keep)
    return _encoders[key]
