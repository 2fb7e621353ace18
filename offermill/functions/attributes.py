"""What names and sizes say about a product: the attributes that decide whether two are alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attributes that are read out of a text, by the pattern's first group.
READ = {
    "diaperSize": r"(?iu)(?:gr(?:öße|\.)?\s*|size\s*)([0-9]{1,2})(?![0-9a-z_])",
    "weightMinKg": r"(?iu)(?<![0-9a-z_])(\d{1,2})\s*[-–]\s*\d{1,2}\s*kg(?![0-9a-z_])",
    "weightMaxKg": r"(?iu)(?<![0-9a-z_])\d{1,2}\s*[-–]\s*(\d{1,2})\s*kg(?![0-9a-z_])",
    "fatContent": r"(?iu)(?<![0-9a-z_])([013][,.]\d)\s*%",
    "washLoads": r"(?iu)(?<![0-9a-z_])(\d{1,3})\s*(?:wl|waschladungen?)(?![0-9a-z_])",
    "packageCount": r"(?iu)(?<![0-9a-z_])(\d{1,4})\s*(?:stück|st\.?)(?![0-9a-z_])",
}
#: Attributes named by the first pattern that occurs.
NAMED = {
    "babyStage": (("(?<![0-9a-z_])pre(?![0-9a-z_])", "PRE"), *((f"(?:folgemilch|milchnahrung|anfangsmilch)\\s*{k}(?![0-9a-z_])", k) for k in "123")),
    "animal": (("(?<![0-9a-z_])katzen?(?![0-9a-z_])|katzenfutter|(?<![0-9a-z_])cat(?![0-9a-z_])", "Katze"), ("(?<![0-9a-z_])hunde?(?![0-9a-z_])|hundefutter|(?<![0-9a-z_])dog(?![0-9a-z_])", "Hund")),
    "feedForm": (("nassfutter|menü|(?<![0-9a-z_])pat[eé]", "Nass"), ("trockenfutter|kroketten", "Trocken")),
    "diaperForm": (("schwimmwindel", "Schwimmwindel"), ("(?<![0-9a-z_])pants(?![0-9a-z_])|windelhose", "Pants"), ("(?<![0-9a-z_])windeln?(?![0-9a-z_])", "Windeln")),
    "detergentForm": (("caps|pods", "Caps"), ("pulver", "Pulver"), ("gel|flüssig|fluessig", "Flüssig")),
    "processing": (("(?<![0-9a-z_])h-?milch(?![0-9a-z_])|haltbar", "haltbar"), ("frisch(?:e|er|es)?\\s+(?:voll)?milch|frischmilch", "frisch")),
}
#: Fixed value: what marks organic goods.
ORGANIC = r"(?iu)(?<![0-9a-z_])bio(?![0-9a-z_])|bioland|naturland|demeter|öko[- ]?"


def attributes(name: Column, size: Column) -> dict[str, Column]:
    """Each attribute as text, null where the name and size don't say it; decimal commas become points."""
    text = F.concat_ws(" ", name, size)
    out = {a: F.replace(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit(","), F.lit(".")) for a, p in READ.items()}
    return out | {a: F.coalesce(*(F.when(text.rlike(f"(?iu){p}"), F.lit(v)) for p, v in rules)) for a, rules in NAMED.items()}


def organic(name: Column, *more: Column) -> Column:
    """Whether a name, or a flag of the record, says organic."""
    said = F.coalesce(name.rlike(ORGANIC), F.lit(False))
    for flag in more:
        said = said | F.coalesce(flag, F.lit(False))
    return said


def variant_signature(folded: Column) -> Column:
    """Fat content, size number and weight range of a folded name (that keeps % and -), '|' between them: what keeps variants apart."""
    part = lambda p, i: F.regexp_extract(F.coalesce(folded, F.lit("")), p, i)
    fat = F.replace(part(r"(?<![0-9a-z_])(\d{1,2}(?:[,.]\d+)?)\s*%", 1), F.lit(","), F.lit("."))
    return F.concat_ws("|", fat, part(r"(?<![0-9a-z_])(?:groesse|gr)\s*([0-9]{1,2})(?![0-9a-z_])", 1), part(r"(?<![0-9a-z_])\d{1,2}\s*-\s*\d{1,2}\s*kg(?![0-9a-z_])", 0))


#: What a name says beside the product, in folded names; in this order.
NOISE = (r"marke", "produktname", "angebot|aktion|wochenangebot|dauerhaft gunstig", "verschiedene sorten|versch sorten", r"\d+[,.]?\d*\s*(?:eur|euro)", r"1\s*kg\s*=\s*\d+[,.]?\d*")


def without_noise(folded: Column, brand: Column) -> Column:
    """A folded name without offer words and, if anything else is left, without the words of the (folded) brand."""
    out = folded
    for p in NOISE:
        out = F.regexp_replace(out, rf"(?<![0-9a-z_])(?:{p})(?![0-9a-z_])", " ")
    out = F.trim(F.regexp_replace(out, " +", " "))
    rest = F.array_join(F.filter(F.split(out, " "), lambda w: ~F.array_contains(F.split(F.coalesce(brand, F.lit("")), " "), w)), " ")
    return F.when((F.coalesce(brand, F.lit("")) != "") & (rest != ""), rest).otherwise(out)
