"""Vocabulary files of byte-pair encodings, read for merging one pre-token at a time."""

from __future__ import annotations

import json

import regex
from tokenizers import Tokenizer


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A vocabulary file's text, sent to tasks as it is; its size is the file's."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.text = f.read()
        spec = json.loads(self.text)
        self.strings: list[str] = list(spec["model"]["vocab"])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix: str = spec["model"].get("end_of_word_suffix") or ""

    def open(self) -> None:
        """Once per task: the merging model and what finds special strings, which count as one token each."""
        self.tokenizer = Tokenizer.from_str(self.text)
        self.model = self.tokenizer.model
        letters = byte_letters()
        self.letters = [letters[b] for b in range(256)]
        self.find_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    def merged(self, piece: str) -> list[int]:
        """The ids of one pre-token, by the file's merges."""
        # printable ASCII other than the space is written as it is
        plain = piece.isascii() and piece.isprintable() and " " not in piece
        return [t.id for t in self.model.tokenize(piece if plain else "".join(map(self.letters.__getitem__, piece.encode())))]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("text", "strings", "special", "suffix")}
