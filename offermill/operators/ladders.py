"""Price ladders: every form of a price in a text with its kind and place, and the price that counts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermill.functions.money import PRICE, german_number


class Form(NamedTuple):
    """A way to write a price: its kind, an expression of Java, and the groups of the price and of the one before."""

    kind: str
    pattern: str
    price: int = 1
    regular: int | None = None


_EURO = r"(\d+[.,]\d{2})"
#: The forms of prices, the one that counts most first.
FORMS = (
    Form("app", rf"(?i)App-?Preis(?:\s+von)?\s*{_EURO}\s*€"),
    Form("fixed", rf"(?i)(?:Festpreis von|Aktionspreis|Angebotspreis|Aktueller Artikelpreis:?)\s*{_EURO}\s*€"),
    Form("only", rf"(?i)\bnur\s*{_EURO}\b"),
    Form("line", rf"(?m)^{_EURO}\s*€$"),
    Form("reduced", rf"(?i)(?:statt|UVP)\s*{_EURO}[^\d]{{0,12}}{_EURO}", 2, 1),
    Form("euro", rf"{_EURO}\s*€"),
)


def price_forms(df: DataFrame, key: str, text: str, forms: Sequence[Form] = FORMS) -> DataFrame:
    """Every price in the texts: key, kind, rank, begins and ends (characters, from 0, end exclusive), price and regular.

    Where forms overlap, the one of the lower rank stays, and what overlaps
    only a form that went itself stays too. Each form is looked for in the
    whole text, from left to right. Equal texts of a key are read once; null
    and empty texts have no prices, and prices of more than ten digits before
    the comma are null. Only lengths and the matched strings leave the row of
    a text, so that what is shuffled grows with the prices, not with the texts.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def scanned(rank: int, form: Form) -> Column:
        group = lambda g: F.regexp_extract_all(body, F.lit(form.pattern), F.lit(g))
        gaps = F.transform(F.split(body, form.pattern, -1), F.char_length)
        both = F.arrays_zip(gaps.alias("gap"), group(0).alias("hit"), group(form.price).alias("price"), *([group(form.regular).alias("regular")] if form.regular else []))
        regular = lambda m: german_number(m["regular"]) if form.regular else F.lit(None)
        return F.transform(both, lambda m, i: F.struct(
            F.lit(rank).alias("rank"), i.alias("i"), m["gap"].alias("gap"), F.char_length(m["hit"]).alias("width"),
            german_number(m["price"]).cast(PRICE).alias("price"), regular(m).cast(PRICE).alias("regular"),
        ))

    found = [scanned(rank, f) for rank, f in enumerate(forms)]
    rows = df.select(F.col(key).alias("key"), F.md5(body).alias("_text"), F.explode(F.flatten(F.array(*found))).alias("m")).where("m.width is not null")
    rows = rows.select("key", "_text", "m.*").dropDuplicates(["key", "_text", "rank", "i"])
    before = Window.partitionBy("key", "_text", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ends", F.sum(F.col("gap") + F.col("width")).over(before)).withColumn("begins", F.col("ends") - F.col("width"))
    place = "over (partition by key, _text order by begins, rank)"
    rows = rows.withColumn("_stays", F.col("rank") == 0)
    for rank in range(1, len(forms)):  # what stays of the ranks before never overlaps itself: its neighbours are enough
        before, after = F.expr(f"lag(if(_stays, ends, null)) ignore nulls {place}"), F.expr(f"lead(if(_stays, begins, null)) ignore nulls {place}")
        free = F.coalesce(before <= F.col("begins"), F.lit(True)) & F.coalesce(after >= F.col("ends"), F.lit(True))
        rows = rows.withColumn("_stays", F.when(F.col("rank") == rank, free).otherwise(F.col("_stays")))
    kind = F.element_at(F.array(*(F.lit(f.kind) for f in forms)), F.col("rank") + 1)
    return rows.where("_stays").select(F.col("key").alias(key), kind.alias("kind"), "rank", F.col("begins").cast("long").alias("begins"), F.col("ends").cast("long").alias("ends"), "price", "regular")


def counted_price(found: DataFrame, key: str, least: Column | None = None, most: Column | None = None) -> DataFrame:
    """The price that counts of each key: of the lowest rank, then the first in the text.

    Prices that are not above `least` and below `most` (0.05 and 500 unless
    given) do not count. `app` says that it holds in the app only; regular is
    a greater price before it, of the same form or else of any. `prices` is
    the number of all forms.
    """
    low, high = least if least is not None else F.lit(0.05), most if most is not None else F.lit(500)
    fits = (F.col("price") > low) & (F.col("price") < high)
    best = F.min(F.when(fits, F.struct("rank", "begins", "kind", "price", "regular")))
    rows = found.groupBy(key).agg(best.alias("b"), F.max("regular").alias("before"), F.count("*").alias("prices")).where("b is not null")
    regular = F.coalesce(F.when(F.col("b.regular") > F.col("b.price"), F.col("b.regular")), F.when(F.col("before") > F.col("b.price"), F.col("before")))
    return rows.select(key, F.col("b.kind").alias("kind"), F.col("b.price").alias("price"), regular.alias("regular"), (F.col("b.kind") == "app").alias("app"), "prices")
