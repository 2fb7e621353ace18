"""Text expressions: cleaning, folding, whole-word tests and similarity of word sets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters that folding writes otherwise.
FOLD_FROM, FOLD_TO = "äöüàáâãåçèéêëìíîïñòóôõùúûýÿ", "aouaaaaaceeeeiiiinoooouuuyy"
#: A word boundary that counts ASCII letters, digits and _ only, as in ECMAScript.
ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def clean(c: Column) -> Column:
    """No-break spaces and runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def fold(c: Column, keep: str = "a-z0-9") -> Column:
    """Lower case, without marks, ß as ss, and one space for whatever else is not kept."""
    plain = F.replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(plain, f"[^{keep}]+", " "))


@F.pandas_udf(StringType())
def fold_any(c: pd.Series) -> pd.Series:
    """As fold, for marks of all scripts, by compatibility decomposition."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        s = unicodedata.normalize("NFKD", s.lower()).replace("ß", "ss")
        s = "".join(x if x.isascii() and x.isalnum() else " " for x in s if not unicodedata.combining(x))
        return " ".join(s.split())

    return c.map(one)


def slug(c: Column, longest: int = 140) -> Column:
    """The folded text with hyphens for spaces, cut to `longest` characters without one at the end."""
    return F.regexp_replace(F.substring(F.replace(fold(c), F.lit(" "), F.lit("-")), 1, longest), "-+$", "")


def has_term(folded: Column, term: Column | str) -> Column:
    """Whether a folded text holds a folded term as whole words."""
    term = F.lit(term) if isinstance(term, str) else term
    return F.instr(F.concat(F.lit(" "), folded, F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" "))) > 0


def has_any(folded: Column, terms: Column) -> Column:
    """Whether any of an array of terms is in it; false for none."""
    return F.exists(F.coalesce(terms, F.array().cast("array<string>")), lambda t: has_term(folded, t))


def has_all(folded: Column, terms: Column) -> Column:
    """Whether all of an array of terms are in it; true for none."""
    return F.forall(F.coalesce(terms, F.array().cast("array<string>")), lambda t: has_term(folded, t))


def tokens(folded: Column) -> Column:
    """Distinct words in order; an empty text has none."""
    return F.array_distinct(F.filter(F.split(folded, " "), lambda w: w != ""))


def token_similarity(a: Column, b: Column, discount: float = 0.94) -> Column:
    """The greater of the word sets' Jaccard similarity and `discount` times their containment."""
    both = F.size(F.array_intersect(a, b))
    jaccard = both / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    contained = both / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))
    return F.greatest(jaccard, F.lit(discount) * contained)


def without_repeated_prefix(c: Column, least: int = 2, most: int = 8) -> Column:
    """A text that begins with the same `least` to `most` words twice loses the second of the two; the least such number counts."""
    words = F.split(c, " ")
    out = c
    for k in range(most, least - 1, -1):
        twice = (F.size(words) >= 2 * k) & (F.lower(F.array_join(F.slice(words, 1, k), " ")) == F.lower(F.array_join(F.slice(words, k + 1, k), " ")))
        rest = F.concat(F.slice(words, 1, k), F.slice(words, F.lit(2 * k + 1), F.greatest(F.size(words) - 2 * k, F.lit(0))))
        out = F.when(twice, F.array_join(rest, " ")).otherwise(out)
    return out


def without_repeated_half(c: Column, least: int = 4) -> Column:
    """A text of `least` words or more whose second half repeats the first (an odd word at the end aside) is its first half."""
    words = F.split(c, " ")
    half = F.floor(F.size(words) / 2).cast("int")
    first, second = F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, half), " ")
    return F.when((F.size(words) >= least) & (F.lower(first) == F.lower(second)), first).otherwise(c)
