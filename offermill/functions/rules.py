"""Ordered rule tables: the first rule that holds decides."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first (pattern, label) whose pattern occurs, in any case of letters."""
    chain = reduce(lambda c, r: c.when(text.rlike(f"(?iu){r[0]}"), r[1]), rules[1:], F.when(text.rlike(f"(?iu){rules[0][0]}"), rules[0][1]))
    return chain.otherwise(F.lit(otherwise))


def first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The code of the first (code, condition) that holds; null if none does. An unknown condition does not hold."""
    return F.coalesce(*(F.when(c, F.lit(code)) for code, c in checks))


def score(parts: Sequence[tuple[float, Column]]) -> Column:
    """The sum of the points whose condition holds."""
    return reduce(lambda a, b: a + b, (F.when(c, F.lit(p)).otherwise(F.lit(0)) for p, c in parts))


class Rule(NamedTuple):
    """What a text must hold (`pattern`) and must not (`veto`) to be of a kind; expressions of Java, in any case of letters.

    `cases` are rules for what the pattern found, tried in order before the
    rule's own values. A rule without a product has its cases alone: where none
    of them holds, the rules after it are tried. A product may name attributes
    in braces. `scope` must occur in the category that came with the text;
    a case takes the kind and the confidence of its rule unless it has its own.
    """

    pattern: str
    product: str | None = None
    kind: str | None = None
    confidence: float | None = None
    veto: str | None = None
    scope: str | None = None
    cases: tuple["Rule", ...] = ()


def _leaves(rules: Sequence[Rule], kind: str | None, confidence: float) -> Iterator[tuple[str | None, str, float]]:
    for r in rules:
        own = r.kind or kind, r.confidence if r.confidence is not None else confidence
        yield from _leaves(r.cases, *own)
        if r.product is not None:
            yield own[0], r.product, own[1]


def _number(text: Column, scope: Column, rules: Sequence[Rule], numbers: Iterator[int]) -> Column:
    """The place among all leaves of the one that decides; null if none does."""
    found = []
    for r in rules:
        inner = [_number(text, scope, r.cases, numbers)] if r.cases else []
        inner += [F.lit(next(numbers))] if r.product is not None else []
        holds = text.rlike(f"(?iu){r.pattern}")
        holds = holds & ~text.rlike(f"(?iu){r.veto}") if r.veto else holds
        holds = holds & F.coalesce(scope.rlike(f"(?iu){r.scope}"), F.lit(False)) if r.scope else holds
        if inner:
            found.append(F.when(holds, F.coalesce(*inner)))
    return F.coalesce(*found, F.lit(None).cast("int")) if found else F.lit(None).cast("int")


def decided(text: Column, rules: Sequence[Rule], scope: Column | None = None, attributes: Mapping[str, Column] | None = None, confidence: float = 0.9) -> Column:
    """What an ordered list of rules says of a text: a struct of rule (its leaf's place, from 1), kind, product and confidence; null if nothing holds.

    Each rule is tested at most once a row and none after the one that decides,
    whatever their number; the values come from one literal table, so the
    expression grows with the rules' patterns alone. A null text holds nothing.
    Attributes that are null or not given leave their braces empty.
    """
    leaves = list(_leaves(rules, None, confidence))
    if not leaves:
        return F.lit(None).cast("struct<rule:int,kind:string,product:string,confidence:double>")
    place = _number(text, scope if scope is not None else F.lit(None).cast("string"), rules, iter(range(1, len(leaves) + 1)))
    table = F.array(*(F.struct(F.lit(k).cast("string").alias("kind"), F.lit(p).alias("product"), F.lit(float(c)).alias("confidence")) for k, p, c in leaves))

    def said(i: Column) -> Column:
        leaf = F.element_at(table, i)
        product = reduce(lambda c, a: F.replace(c, F.lit("{" + a[0] + "}"), F.coalesce(a[1].cast("string"), F.lit(""))), (attributes or {}).items(), leaf["product"])
        product = F.trim(F.regexp_replace(F.regexp_replace(product, r"\{\w+\}", ""), r"\s+", " "))
        return F.when(i.isNotNull(), F.struct(i.alias("rule"), leaf["kind"].alias("kind"), product.alias("product"), leaf["confidence"].alias("confidence")))

    return F.transform(F.array(place), said)[0]  # a variable holds the place, so that the list is gone through once
