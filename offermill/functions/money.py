"""Numbers, prices, sizes and unit prices in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE, UNIT, HISTORY = "decimal(12,2)", "decimal(14,3)", "decimal(14,4)"
_NUMBER = r"(\d+(?:[.,]\d+)?)"
#: A size with an optional multiple: groups are the multiple, the number and the unit. The unit must end there.
SIZE = rf"(?i)(?:(\d+)\s*[x×]\s*)?{_NUMBER}\s*(kg|g|ml|cl|l|stück|stk|st)(?![a-zäöüß])"


def locale_number(c: Column) -> Column:
    """The number of a text in which the last of ',' and '.' is the decimal sign; null if there is none."""
    s = F.regexp_replace(c, r"[^0-9.,-]", "")
    comma, point = F.instr(F.reverse(s), ","), F.instr(F.reverse(s), ".")
    german = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    english = F.replace(s, F.lit(","), F.lit(""))
    return F.when((comma > 0) & ((point == 0) | (comma < point)), german).otherwise(english).try_cast("decimal(18,4)")


def german_number(c: Column) -> Column:
    """The number of a text in which a comma, if there is one, is the decimal sign."""
    return F.when(F.instr(c, ",") > 0, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(c).try_cast("decimal(18,4)")


def repaired_decimals(c: Column) -> Column:
    """"1. 99" as "1.99"."""
    return F.regexp_replace(c, r"(\d)\s*([.,])\s+(\d{2})(?!\d)", "$1$2$3")


def _part(c: Column, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, SIZE, i), F.lit(""))


def quantity(size: Column) -> Column:
    """The amount of a size in kg, l or pieces; ranges like "200-250 g" are none."""
    n = F.replace(_part(size, 2), F.lit(","), F.lit(".")).try_cast("decimal(18,4)")
    times = F.coalesce(_part(size, 1).try_cast("decimal(18,4)"), F.lit(1).cast("decimal(18,4)"))
    unit = F.lower(_part(size, 3))
    scale = F.when(unit.isin("g", "ml"), F.lit(1000)).when(unit == "cl", F.lit(100)).otherwise(F.lit(1))
    return F.when(~size.rlike(r"\d\s*[-–]\s*\d"), (n * times / scale).cast("decimal(18,6)"))


def larger_quantity(size: Column) -> Column:
    """The amount of a size in kg, l or pieces; of a range like "200-250 g" the larger end, as the lowest unit price is meant."""
    one = F.regexp_replace(size, r"(\d+(?:[.,]\d+)?)\s*[-–]\s*(\d+(?:[.,]\d+)?)", "$2")
    two = F.regexp_replace(size, r"(\d+(?:[.,]\d+)?)\s*[-–]\s*(\d+(?:[.,]\d+)?)", "$1")
    return F.greatest(quantity(one), quantity(two))


def unit_label(size: Column) -> Column:
    unit = F.lower(_part(size, 3))
    return F.when(unit.isin("g", "kg"), "€/kg").when(unit.isin("ml", "cl", "l"), "€/l").when(unit.isNotNull(), "€/Stk.")


def unit_price(price: Column, amount: Column) -> Column:
    return F.when(amount > 0, F.round(price / amount, 3).cast(UNIT))


def base_price(text: Column) -> Column:
    """A price for a unit as written, such as "1 kg = 2,49" or "100 g 0,99"; the least of a range."""
    per = r"(?i)(?:(\d+)\s*)?(kg|g|ml|l|stück|stk)\s*(?:=|:)?\s*(?:€\s*)?(\d+[.,]\d{2})(?:\s*[-–/]\s*(\d+[.,]\d{2}))?"
    part = lambda i: F.nullif(F.regexp_extract(text, per, i), F.lit(""))
    unit = F.lower(part(2))
    amount = F.coalesce(part(1).try_cast("decimal(10,2)"), F.lit(1))
    factor = F.when(unit.isin("g", "ml"), F.lit(1000)).otherwise(F.lit(1)) / amount
    return (F.least(german_number(part(3)), german_number(part(4))) * factor).cast(UNIT)


def price_metric(unit: Column, price: Column) -> Column:
    """The unit price where there is one above zero, else the price."""
    return F.coalesce(F.when(unit > 0, unit), price)


def saving_percent(price: Column, regular: Column) -> Column:
    return F.when((regular > 0) & (price < regular), F.round((1 - price / regular) * 100).cast("int"))


def cents(c: Column) -> Column:
    return (c / 100).cast(PRICE)
