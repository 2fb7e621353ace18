"""Secret scans by one combined deterministic automaton (operator 3).

All rules are compiled into one minimal automaton; a text is read once, byte
by byte, and only where the automaton accepts are spans worked out: the
rule's own backward automaton gives the possible beginnings of a match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermill.llm.automaton import Automaton, compile_rules
from offermill.llm.base import in_small_batches, table, texts


class Rule(NamedTuple):
    """A match is the head and then as many characters as follow of the value's class, `at_once` or more.

    A match whose value has fewer than `least` is no secret, but ends there all the same.
    It goes on to the next match of `tail`, if there is one and no two hyphens in a row come before it.
    """

    kind: str
    head: str
    value: str
    least: int = 1
    ignore_case: bool = False
    at_once: int = 1
    tail: str = ""

    @property
    def pattern(self) -> str:
        return f"{self.head}{self.value}{{{self.at_once},}}"


#: The base rules, in order. Short runs of hexadecimal digits are common in words, so for these
#: the automaton itself counts to 8; shorter runs are never long enough.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24, False, 8),
)
#: Public formats of well-known keys. A private key reaches to its last line; where that is missing, as far as its characters do.
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 30),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 30),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("stripe", "[sr]k_live_", "[A-Za-z0-9]", 16),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY[A-Z ]*-----", r"[A-Za-z0-9+/=\x09-\x0D\\]", 0, False, 0, "-----END [A-Z ]*PRIVATE KEY[A-Z ]*-----"),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    """Finds the spans of all rules in one pass over a text's bytes."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        patterns = [(r.pattern, r.ignore_case) for r in rules] + [(r.tail, r.ignore_case) for r in rules if r.tail]
        self.tails = {k: len(rules) + i for i, k in enumerate(k for k, r in enumerate(rules) if r.tail)}
        self.all = compile_rules(patterns, search=True)
        self.back: list[Automaton] = [compile_rules([p], search=False, backwards=True) for p in patterns]
        self.heads = [compile_rules([(r.head, r.ignore_case)], search=False) if r.head else None for r in rules]

    def accepted(self, data: bytes) -> list[tuple[int, int]]:
        """(byte place after, rules' bits) wherever the automaton accepts: the one pass."""
        moves, floor, state, found = self.all.moves, self.all.floor, 0, []
        for i, c in enumerate(data.translate(self.all.classes)):
            state = moves[state + c]
            if state >= floor:
                found.append((i + 1, self.all.accepts[state // self.all.width]))
        return found

    def begins(self, rule: int, data: bytes, end: int, least: int) -> int:
        """The first place from `least` on where a match that ends at `end` can begin; -1: none."""
        own, state, found = self.back[rule], 0, -1
        for i in range(end - 1, least - 1, -1):
            state = own.moves[state + own.classes[data[i]]]
            if state == own.dead:
                break
            if state >= own.floor:
                found = i
        return found

    def value_begins(self, rule: int, data: bytes, begin: int) -> int:
        """Where the longest head ends that begins there."""
        own, state, found = self.heads[rule], 0, begin
        if own:
            for i in range(begin, len(data)):
                state = own.moves[state + own.classes[data[i]]]
                if state == own.dead:
                    break
                if state >= own.floor:
                    found = i + 1
        return found

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(begin, rule, end): of each rule the leftmost longest matches, none over another of the same rule."""
        spans = []
        accepted = self.accepted(data)
        for k, rule in enumerate(self.rules) if accepted else ():
            heads = [(b, e, self.value_begins(k, data, b)) for b, e in self._matches(k, data, accepted)]
            tails = self._matches(self.tails[k], data, accepted) if rule.tail and heads else []
            for b, e, value in heads:
                if e - value >= rule.least:
                    first = next((t for t in tails if t[0] >= value), None)
                    spans.append((b, k, first[1] if first and data.find(b"--", value, first[0]) < 0 else e))
        return sorted(spans)

    def _matches(self, pattern: int, data: bytes, accepted: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(begin, end) of the leftmost longest matches of a pattern, from where the automaton accepted."""
        found, last = [], 0
        ends = [e for e, bits in accepted if bits >> pattern & 1]
        for e, after in zip(ends, [*ends[1:], -1]):
            # a match that goes on ends later
            if after != e + 1 and (b := self.begins(pattern, data, e, last)) >= 0:
                last = e
                found.append((b, e))
        return found

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, begin, end) in code points, by begin and then as the rules are listed."""
        data = text.encode()
        found = self.byte_spans(data)
        if len(data) == len(text):
            return [(self.rules[k].kind, b, e) for b, k, e in found]
        place, at, done = {}, 0, 0
        for p in sorted({p for b, _, e in found for p in (b, e)}):
            at += len(data[done:p].decode())
            place[p], done = at, p
        return [(self.rules[k].kind, place[b], place[e]) for b, k, e in found]


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (kind, begin, end) in code points, of every text.

    Null and empty texts have no spans; repeated rows and null ids are
    scanned as they come; an empty table gives an empty one.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # its size is the rules'

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [scanner.value.spans(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": [[{"kind": k, "begin": x, "end": y} for k, x, y in f] for f in found]})

    return texts(docs, id_col, text_col).mapInPandas(scan, "doc_id long, spans array<struct<kind string, begin int, end int>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The documents with each secret, and overlapping ones together, replaced by the mark; all columns stay.

    Null texts stay null.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            out, at = [], 0
            for _, b, e in scanner.value.spans(text):
                if e > at:
                    if b >= at:
                        out += text[at:b], mark
                    at = e
            return "".join([*out, text[at:]]) if at else text

        return column.map(one)

    return in_small_batches(docs).withColumn(text_col, clean(F.col(text_col)))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE_RULES)))
    return secret_spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
