"""Token counts by the whole-token shortcut (operator 10).

Before any text is read, the driver proves which vocabulary strings encode
alone as one token, by merging each. A pre-token that is such a string counts
as one at sight; only the rest go through the merges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.llm.base import Remembered, Sent, table, texts
from offermill.llm.vocabulary import Vocabulary

#: Entries of each memory of counts that a task keeps.
REMEMBERED = 250_000
#: The pre-tokens of byte-level vocabularies of this family (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter(Sent):
    """Counts the tokens of whole texts as the vocabulary's library does."""

    made = ("vocabulary", "whole")

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.vocabulary.open()
        back = {c: b for b, c in enumerate(self.vocabulary.letters)}
        self.whole: set[str] = set()
        for s in self.vocabulary.strings:
            if s not in self.vocabulary.special and len(self.vocabulary.model.tokenize(s)) == 1:
                try:
                    self.whole.add(bytes(map(back.__getitem__, s)).decode())
                except UnicodeDecodeError:
                    pass  # a part of a character: no pre-token is that

    def start(self) -> None:
        """Once per task: the patterns and the memories."""
        self.vocabulary.open()
        self.find, self.two_spaces = regex.compile(PRE_TOKEN).findall, re.compile(r"\s\s").search
        self.first, self.later = Remembered(self.pieces, REMEMBERED), Remembered(lambda s: self.pieces(" " + s), REMEMBERED)

    def pieces(self, text: str) -> int:
        """Tokens of a text without special strings: whole tokens at sight, merges for the rest."""
        whole, merged = self.whole, self.vocabulary.merged
        return sum(1 if p in whole else len(merged(p)) for p in self.find(text))

    def count(self, text: str) -> int:
        parts = self.vocabulary.find_special.split(text) if "<" in text else [text]
        return len(parts) - 1 + sum(map(self.part, parts))

    def part(self, text: str) -> int:
        """Where no two white-space characters meet, each space begins a pre-token and each line end is one.

        Then the words between spaces can be counted apart, and remembered.
        """
        if self.two_spaces(text):
            return self.pieces(text)
        lines = text.split("\n")
        n, later = (len(lines) - 1) * self.first["\n"], self.later.__getitem__
        for line in lines:
            words = line.split(" ")
            n += self.first[words[0]] + sum(map(later, words[1:]))
        return n


@lru_cache(4)
def counter_of(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every text.

    A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids
    are counted as they come; an empty table gives an empty one. Special
    strings inside a text count as one token each, as the library has it.
    What is sent to the tasks is the vocabulary, whose size the file bounds.
    """
    counter = docs.sparkSession.sparkContext.broadcast(counter_of(path or public_tokenizers.path("byte_bpe_50k.json")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter.value
        own.start()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": [own.count(t) for t in b["text"]]})

    rows = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
