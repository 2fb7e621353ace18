"""Validity rules with reasons, repairs, and the report of what they did."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from offermill.functions.rules import first_reason


def with_reason(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """The rows with `reason`, the code of the first rule that they break; null for valid rows."""
    return df.withColumn("reason", first_reason(checks))


def offer_checks(name: Column, store: Column, price: Column, unit: Column, most: float = 150, most_unit: float = 800) -> list[tuple[str, Column]]:
    """The rules of a valid offer, in order."""
    return [
        ("missing_name", name.isNull() | (F.length(F.trim(name)) < 3)),
        ("name_too_long", F.length(name) > 140),
        ("name_without_letters", ~name.rlike(r"\p{L}{3,}")),
        ("missing_store", store.isNull() | (store == "")),
        ("invalid_price", price.isNull() | (price <= 0.05)),
        ("price_too_high", price > most),
        ("invalid_unit_price", unit.isNotNull() & (unit <= 0)),
        ("unit_price_too_high", unit > most_unit),
    ]


def funnel(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows for each reason, `kept` for none: they add up to all rows."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def swapped_repair(price: Column, unit: Column, amount: Column) -> tuple[Column, Column, Column]:
    """Where the unit price is really the amount, the price was the unit price: (price, unit, repaired)."""
    swapped = (F.abs(unit - amount) <= F.greatest(F.lit(0.015), 0.06 * amount)) & (price > 0.3) & (amount > 0)
    swapped = F.coalesce(swapped, F.lit(False))
    return F.when(swapped, price * amount).otherwise(price), F.when(swapped, price).otherwise(unit), swapped


def derived_unit(price: Column, unit: Column, label: Column, amount: Column, amount_label: Column) -> Column:
    """The unit price from the size where none is given, it is per package, or it is off by over 8 %."""
    own = F.round(price / F.nullif(amount, F.lit(0)), 3)
    off = (F.abs(unit - own) > 0.08 * own) & (label == amount_label)
    return F.when(own.isNotNull() & (unit.isNull() | (label == "€/Packung") | F.coalesce(off, F.lit(False))), own).otherwise(unit)


#: Texts of pages that are no product names; names that say nothing; and beginnings that are prices or amounts.
PAGE_TEXT = r"alle\s+(?:dm|rossmann)[- ]?märkte|online verfügbar|markt auswählen|filiale auswählen|filiale wählen|mehr anzeigen|mehr erfahren|weitere informationen|verfügbarkeit prüfen|bedingungen der coupons|hilfe von ki|datenschutz|fußnoten|rechtliche hinweise|newsletter|öffnungszeiten|zum prospekt|prospekt öffnen|preise anzeigen"
PAGE_TEXT_LATER = r"alle cookies|cookies akzeptieren|alle ablehnen|auflistung mit \d+ elementen|zum ende der liste|alle dm-märkte|alle rossmann-märkte|dm-markt wählen|markt wählen|markt auswählen|diese woche|aktuelle filiale|zum inhalt springen|filiale finden|geschäftskunden|prospekt|newsletter"
PAGE_TEXT_LAST = r"cookie|markt wählen|filiale wählen|filiale finden|zum inhalt|auflistung mit|newsletter|geschäftskunden|services in ihrer filiale|aktuelle filiale|prospekt|mehr anzeigen|zurücksetzen filter|günstigster preis der letzten 30 tage|preis vorwoche$"
GENERIC = r"^(?:bio|aktion|knaller|superknüller|filiale|angebot|angebote|grundpreis|image|packung|stück)$"
_E = r"(?![0-9a-z_])"
_LETTERS = "[A-Za-zÄÖÜäöüß]{3}"


def _says(name: Column, pattern: str) -> Column:
    return name.rlike(f"(?iu){pattern}")


def sanitize_checks(name: Column, key: Column, price: Column, unit: Column, store: Column, market: Column) -> list[tuple[str, Column]]:
    """The first pass, in order: what is no name, has no key, price, unit price or place. A null name or number breaks its rule."""
    n = F.coalesce(name, F.lit(""))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return [
        ("name_length", (F.length(n) < 3) | (F.length(n) > 140)),
        ("name_no_letters", ~n.rlike(_LETTERS)),
        ("navigation_or_ui", _says(n, PAGE_TEXT)),
        ("generic_name", _says(n, GENERIC)),
        ("price_as_name", _says(n, rf"^(?:Angebotspreis|Aktionspreis|App-Preis|Couponpreis|Preis){_E}")),
        ("number_as_name", _says(n, r"^\(?\s*\d+[.,]\d+")),
        ("quantity_as_name", _says(n, r"^(?:je\s+)?\d+(?:[.,]\d+)?\s*(?:kg|g|l|ml|st(?:ück)?\.?|er[- ]?pack|packg\.?|pckg\.?|schale)") | _says(n, r"^je\s+.*(?:packg\.?|pckg\.?|packung|schale|becher|stück|st\.?)$")),
        ("baseprice_as_name", _says(n, r"^\(?\s*(?:pro|je)\s+(?:stück|kg|l)\s*=") | _says(n, r"€\s*/\s*(?:1\s*)?(?:kg|l|st)")),
        ("missing_key", F.trim(F.coalesce(key, F.lit(""))) == ""),
        ("invalid_price", ~F.coalesce((price > 0.05) & (price < 300), F.lit(False))),
        ("invalid_unit", ~F.coalesce((unit > 0) & (unit < 2000), F.lit(False))),
        ("missing_store", empty(store) | empty(market)),
    ]


def second_checks(name: Column, raw_name: Column, price: Column, unit: Column, produce: Column) -> list[tuple[str, Column]]:
    """The second pass, in order; produce says whether it is fruit or vegetables."""
    n = F.coalesce(name, F.lit(""))
    offers = F.size(F.regexp_extract_all(F.coalesce(raw_name, F.lit("")), F.lit("(?i)(angebotspreis)"), 1))
    return [
        ("name", (F.length(n) < 3) | (F.length(n) > 120)),
        ("quantity_or_discount", _says(n, r"^(?:\d+%\s*(?:billiger|günstiger)|je\s+\d|\d+[.,]\d+\s*(?:kg|g|l|ml)|pro\s+(?:stück|kg|l))")),
        ("ui", _says(n, PAGE_TEXT_LATER)),
        ("concatenated_offer", _says(n, "Angebotspreis|Aktionspreis") | (offers > 1)),
        ("letters", ~n.rlike(_LETTERS)),
        ("price", ~F.coalesce((price > 0.05) & (price <= 150), F.lit(False))),
        ("unit", ~F.coalesce(unit > 0, F.lit(False))),
        ("produce_unit", produce & (unit > 80)),
        ("unit_high", unit > 600),
    ]


def scope_checks(name: Column, price: Column, unit: Column, relevant: Column, outside: Column) -> list[tuple[str, Column]]:
    """The third pass, in order; relevant and outside say what the shop sells and what it leaves out."""
    n = F.coalesce(name, F.lit(""))
    return [
        ("name", (F.length(n) < 3) | (F.length(n) > 150)),
        ("ui", _says(n, PAGE_TEXT_LAST)),
        ("markdown", _says(n, r"https?:|\]\(|!\[|###|Image\s*\d")),
        ("outside_scope", outside),
        ("not_relevant", ~F.coalesce(relevant, F.lit(False))),
        ("price", ~F.coalesce((price > 0.05) & (price <= 150), F.lit(False))),
        ("unit", ~F.coalesce((unit > 0) & (unit <= 800), F.lit(False))),
        ("letters", ~n.rlike(_LETTERS)),
    ]


def examples(df: DataFrame, order: list[Column], most: int = 50, reason: str = "reason") -> DataFrame:
    """The first so many rejected rows, for a report; the cap is the feature."""
    return df.where(F.col(reason).isNotNull()).orderBy(*order).limit(most)


def without_markdown(c: Column) -> Column:
    """Text without images, links, addresses, emphasis, leading numbers and offer words."""
    out = c
    for pattern, put in (
        (r"(?i)!\[Image\s*\d*:?\s*", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?i)\]\(https?://[^)]+\)!?", " "), (r"(?i)https?://\S+", " "),
        (r"\*\*|__|`", " "), (r"^\s*\d{6,}\s+", ""), (r"(?i)^Image\s*\d*:?\s*", ""), (r"(?iu)^(?:AKTION|KNÜLLER|SUPERKNÜLLER|Angebot)\s+", ""), (r"[\]})>*!]+\s*$", ""), (r"[\s ]+", " "),
    ):
        out = F.regexp_replace(out, pattern, put)
    return F.trim(out)


def repaired(df: DataFrame) -> DataFrame:
    """Offers (name, size, price, unit, unit_label) mended, with the number of repairs.

    Names lose markup and what they say twice; where the unit price is the
    amount, both numbers change places; and the unit price is worked out from
    the size where it is missing, of a package or off by over 8 %.
    """
    from offermill.functions.money import quantity, unit_label
    from offermill.functions.text import without_repeated_half, without_repeated_prefix

    rows = df.withColumns({"_name": without_repeated_prefix(without_repeated_half(without_markdown(F.coalesce("name", F.lit(""))))), "_amount": quantity(F.col("size")).cast("double"), "_label": unit_label(F.col("size"))})
    known = F.col("unit_label") == F.col("_label")
    price, unit, swapped = swapped_repair(F.col("price"), F.col("unit"), F.when(known, F.col("_amount")))
    rows = rows.withColumns({"_price": F.round(price, 2), "_unit": F.round(unit, 3), "_swapped": swapped})
    own = F.round(F.col("_price") / F.nullif(F.col("_amount"), F.lit(0.0)), 3)
    wrong = F.col("_unit").isNull() | (F.col("_unit") <= 0) | F.coalesce(F.col("unit_label") == "€/Packung", F.lit(True)) | F.coalesce(known & (F.abs(F.col("_unit") - own) / F.greatest(own, F.lit(0.01)) > 0.08), F.lit(False))
    rows = rows.withColumn("_derive", (own > 0) & wrong)
    derive = F.coalesce("_derive", F.lit(False))
    count = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    repairs = count(~F.col("_name").eqNullSafe(F.col("name"))) + count(F.col("_swapped")) + count(derive)
    rows = rows.withColumns({"_u": F.when(derive, own).otherwise(F.col("_unit")), "_l": F.when(derive, F.col("_label")).otherwise(F.col("unit_label")), "repairs": repairs})
    return rows.select(*(c for c in df.columns if c not in ("name", "price", "unit", "unit_label")), F.col("_name").alias("name"), F.col("_price").alias("price"), F.col("_u").alias("unit"), F.col("_l").alias("unit_label"), "repairs")


def store_repairs(df: DataFrame, cents_store: str, base_store: str, small_keys: list[str]) -> DataFrame:
    """Errors of certain shops' readers mended: price and unit of offers (store, key, size, price, unit).

    cents_store gives some prices in cents, and some discounts as prices, where
    the unit has the price; base_store gives the price of a kilogram for small
    packages of some keys.
    """
    from offermill.functions.money import quantity, unit_label

    p = F.when((F.col("store") == cents_store) & (F.col("price") == F.floor("price")) & F.col("price").between(100, 9999), F.round(F.col("price") / 100, 2)).otherwise(F.col("price"))
    rows = df.withColumns({"_p": p, "_q": quantity(F.col("size")).cast("double"), "_l": unit_label(F.col("size"))})
    discount = (F.col("store") == cents_store) & (F.col("_q") < 1) & (F.col("_p") < 0.30) & F.col("unit").between(0.5, 20)
    rows = rows.withColumn("_p", F.when(discount, F.round("unit", 2)).otherwise(F.col("_p")))
    rows = rows.withColumn("_u", F.coalesce(F.when((F.col("_q") > 0) & (F.col("_p") > 0), F.round(F.col("_p") / F.col("_q"), 3)), F.col("unit")))
    per_kilo = (F.col("store") == base_store) & F.col("key").isin(small_keys) & (F.col("_l") == "€/kg") & (F.col("_q") <= 0.5) & (F.col("_u") > 50) & F.col("_p").between(8, 40)
    rows = rows.withColumn("_p2", F.when(per_kilo, F.round(F.col("_p") * F.col("_q"), 2)).otherwise(F.col("_p")))
    return rows.select(*(c for c in df.columns if c not in ("price", "unit")), F.col("_p2").alias("price"), F.when(per_kilo, F.round(F.col("_p2") / F.col("_q"), 3)).otherwise(F.col("_u")).alias("unit"))


def size_score(size: Column) -> Column:
    """How plausible a size is among several of one name and price: one whole unit, no multiple, no mere package."""
    s = F.trim(F.coalesce(size, F.lit("")))
    return F.when(_says(s, r"^1(?:[.,]0+)?\s*(?:kg|l)$"), 20).otherwise(0) + F.when(~s.rlike("[x×]"), 5).otherwise(0) + F.when(~_says(s, "^packung$"), 3).otherwise(0) - F.when(_says(s, r"^(?:0[.,]75|0[.,]5)\s*l$"), 1).otherwise(0)


def observed_passes(df: DataFrame, passes: list[tuple[str, Callable[[DataFrame], DataFrame], list[tuple[str, Column]]]]) -> tuple[DataFrame, dict[str, Observation]]:
    """The rows that all passes leave, and what each of them counts while these are written or read.

    A pass is its name, a repair that adds `repaired` (how many of a row's
    values it changed), and the checks that reject. After the one job that
    takes all rows, each observation has before, after, rejected, repaired and
    the count of each reason: the numbers are those of that very run.
    """
    found = {}
    for name, repair, checks in passes:
        marked = with_reason(repair(df), checks)
        found[name] = Observation(name)
        good = F.col("reason").isNull()
        by_reason = [F.count_if(F.col("reason").eqNullSafe(r)).alias(r) for r in dict.fromkeys(r for r, _ in checks)]
        marked = marked.observe(found[name], F.count("*").alias("before"), F.count_if(good).alias("after"), F.count_if(~good).alias("rejected"), F.coalesce(F.sum("repaired"), F.lit(0)).cast("long").alias("repaired"), *by_reason)
        df = marked.where(good).drop("reason", "repaired")
    return df, found
