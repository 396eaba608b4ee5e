"""Free-text amounts, units and pH as Catalyst expressions.

Everything here is a Column of built-in functions: no Python runs per row.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# SI prefixes that occur before mol, g and l, as powers of ten.
PREFIXES = {"": 0, "m": -3, "u": -6, "n": -9, "p": -12, "k": 3, "d": -1, "c": -2}
# Spelled-out parts of unit names and their symbols.
WORDS = (
    (r"milli", "m"),
    (r"micro", "u"),
    (r"nano", "n"),
    (r"pico", "p"),
    (r"kilo", "k"),
    (r"deci(?=l)", "d"),
    (r"lit(?:re|er)s?", "l"),
    (r"grams?", "g"),
    (r"moles?|mols", "mol"),
    (r"molar", "m"),
)

#: Powers of ten of one litre for each denominator.
_LITRES = {"l": 0, "dl": -1, "cl": -2, "ml": -3, "ul": -6, "nl": -9, "100ml": -1, "m3": 3, "dm3": 0, "cm3": -3}


def unit_table() -> dict[str, tuple[str, int]]:
    """Normalised unit -> (kind, power of ten to the unit of the kind), built by rule.

    Kinds and their units: molar in nmol/L, mass in ug/mL, volume in uL/L.
    """
    out: dict[str, tuple[str, int]] = {}
    for prefix, power in PREFIXES.items():
        if prefix not in ("k", "d", "c"):
            out[prefix + "m"] = ("molar", power + 9)
    for (prefix, power), (per, litres) in product(PREFIXES.items(), _LITRES.items()):
        if prefix not in ("d", "c"):
            out[f"{prefix}mol/{per}"] = ("molar", power - litres + 9)
            out[f"{prefix}g/{per}"] = ("mass", power - litres + 3)
        if prefix not in ("k", "p"):
            out[f"{prefix}l/{per}"] = ("volume", power - litres + 6)
    return out | {"%w/v": ("mass", 4), "%v/v": ("volume", 4)}


def once(value: Column) -> Column:
    """The same value, marked so that a filter behind the projection is not pushed into it.

    A pushed filter would copy the whole expression, and two copies outgrow the size limit of a compiled method.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


# Words that may stand before a number without changing it.
_LEAD = r"^(?:(?:approx(?:imately)?|ca|circa|about|around|roughly|final(?: concentration)?|diluted to|adjusted to|conc|c)(?![a-z])[.:]?\s*[=:]?\s*|[~≈=]\s*)+"
_NUMBER = r"[-+]?(?:\d++(?:[.,]\d++)?+|[.,]\d++)(?:\s*+[x×*·]\s*+10\s*+\^?\s*+[-+−]?\d++|e[-+−]?\d++)?+"
_TO = r"(?:-|–|—|−|to(?![a-z])|\.\.+)"
_RANGE = rf"^{_NUMBER}(?:\s*|\s*[a-zµμ%][a-zµμ%/ ]*\s){_TO}\s*{_NUMBER}(?![a-z0-9])"
# A unit beside the first of two numbers.
_UNIT_WORD = (
    r"(?:(?:milli|micro|nano|pico|kilo|[munpkµμ])?(?:molar|moles?|mols?|grams?|lit(?:re|er)s?|[mgl])"
    r"(?:\s*(?:/|per)\s*(?:100\s*)?(?:milli|micro|deci|[munpdcµμ])?(?:lit(?:re|er)s?|l|m\^?3)|\s*[mudµμ]?l\s*-1)?"
    r"|(?:%|per\s?cent|pct)(?:\s*\(?\s*(?:w|v|m|wt|vol|weight|mass)\s*/\s*v(?:ol(?:ume)?)?\s*\)?)?)"
)
_TOLERANCE = r"(?:\+\s*/\s*[-−–]|±|\+[-−])"
_TEMPERATURE = r"(?:-?\d+(?:[.,]\d+)?\s*(?:°|º|deg(?:rees)?\.?)?\s*(?:c|k|celsius|kelvin)|rt|room temperature)"
# A percentage is a tolerance of its own only before a unit that it does not belong to.
_TOLERANCE_FIRST = rf"^\(?{_TOLERANCE}\s*{_NUMBER}\)?(?:\s*%(?=\s*[a-zµμ])(?!\s*(?:w|v|m|wt|vol(?:ume)?|weight|mass)\s*/|\s*(?:vol|by)\b))?\s*"
_TOLERANCE_LAST = rf"\s*\(?\s*{_TOLERANCE}\s*{_NUMBER}\s*{_UNIT_WORD}?\s*\)?$"
_TEMPERATURE_LAST = rf"(?:^|\s+|\s*[(@,]\s*)(?:(?:at|@)\s*)?{_TEMPERATURE}\s*\)?[.;]?$"


def plain(text: Column) -> Column:
    """Lower case, one blank between words, no outer white space, leading words such as 'approx.' gone."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    return F.regexp_replace(flat, _LEAD, "")


def number(text: Column) -> Column:
    """The leading number of a plain text as DECIMAL(38,12); null for none and for ranges.

    A decimal comma, 2e3, 2 x 10^3, 2*10^3 and a missing leading zero are understood.
    """
    found = F.regexp_extract(text, rf"^({_NUMBER})(?![0-9])", 1)
    found = F.regexp_replace(found, r"\s*[x×*·]\s*10\s*\^?\s*", "e")
    found = F.replace(F.replace(found, F.lit(","), F.lit(".")), F.lit("−"), F.lit("-"))
    value = found.try_cast("decimal(38,12)")
    return F.when(F.rlike(text, F.lit(_RANGE)), F.lit(None)).otherwise(value)


def after_number(text: Column) -> Column:
    """What follows the leading number."""
    return F.trim(F.regexp_replace(text, rf"^{_NUMBER}", ""))


def without_additions(rest: Column) -> Column:
    """What follows the leading number, without an added tolerance or temperature; most texts hold neither and are passed by."""
    out = F.regexp_replace(F.regexp_replace(rest, rf"(?i){_TEMPERATURE_LAST}", ""), rf"(?i){_TOLERANCE_FIRST}", "")
    return F.when(rest.rlike(r"(?i)\d|\brt\b|temperature"), F.trim(F.regexp_replace(out, rf"(?i){_TOLERANCE_LAST}", ""))).otherwise(rest)


def unit(text: Column) -> Column:
    """Normalised spelling of a unit text, to be looked up in ``unit_table``."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.translate(out, "µμ−", "uu-")
    out = F.regexp_replace(out, r"\(?\b(?:final|in total|total|end)\b(?: concentration)?\)?", " ")
    for word, symbol in WORDS:
        out = F.regexp_replace(out, word, symbol)
    out = F.regexp_replace(out, r"\bpercent\b|\bper cent\b|\bpct\b", "%")
    out = F.regexp_replace(out, r"\bper\b", "/")
    out = F.regexp_replace(out, r"\b(?:wt|weight|mass)\s*/\s*vol(?:ume)?\b|\bm/v\b", "w/v")
    out = F.regexp_replace(out, r"\bvol(?:ume)?\s*/\s*vol(?:ume)?\b", "v/v")
    out = F.regexp_replace(out, r"\bvol\s*%|%\s*(?:by\s*)?vol\b", "%v/v")
    out = F.regexp_replace(out, r"[()\s^]+", " ")
    out = F.regexp_replace(F.trim(out), r"^(w/v|v/v)\s*%$", "%$1")
    out = F.regexp_replace(out, r"(?<=[a-z]) ?\*? ?(l|ml|dl|ul|m|dm|cm) ?-([13])$", "/$1-$2")
    out = F.regexp_replace(out, r"-1$", "")
    out = F.regexp_replace(out, r"/(m|dm|cm) ?-?3$", "/$13")
    return F.regexp_replace(out, r"\s+", "")


def unit_code(unit_text: Column) -> Column:
    """``kind@power`` of a normalised unit, null for an unknown one."""
    return F.element_at(_map({k: f"{kind}@{power}" for k, (kind, power) in unit_table().items()}), unit_text)


def code_kind(code: Column) -> Column:
    return F.substring_index(code, "@", 1)


def scaled(value: Column, code: Column) -> Column:
    """A number in the unit of its kind, as BIGINT rounded half up."""
    factor = F.concat(F.lit("1e"), F.substring_index(code, "@", -1)).try_cast("decimal(24,12)")
    return F.round(value.cast("decimal(26,12)") * factor, 0).try_cast("long")


def read_amounts(df: DataFrame, value: str, units: str) -> DataFrame:
    """Adds the reading of a stated amount: ``number``, ``unit`` (normalised), ``kind``, ``value``, ``status``.

    The unit may stand behind the number, in the units field, or in both; the text behind the number wins where
    it names a known unit by itself, else both together are read (``0.2 w/v`` with ``%``). An added tolerance or
    temperature is ignored. Status is ``stated``, ``unitless`` (a number, no unit at all), ``foreign`` (a unit of
    another kind) or ``none`` (no single number).
    Each step is a projection of its own, so that no step is compiled twice.
    """
    text, field = F.col("_text"), F.trim(F.coalesce(F.col(units), F.lit("")))
    field = F.when(F.lower(field).isin("n/a", "na", "-", "none", "unknown", "?"), F.lit("")).otherwise(field)
    bare = F.col("_rest") == ""
    return (
        df.withColumn("_text", plain(F.col(value)))
        .withColumns({"number": number(text), "_rest": after_number(text), "_field": field})
        .withColumns({"_rest": without_additions(F.col("_rest")), "_field": without_additions(F.col("_field"))})
        .withColumns({"_own": unit(F.when(bare, F.col("_field")).otherwise(F.col("_rest"))), "_both": unit(F.concat_ws(" ", "_rest", "_field"))})
        .withColumn("_code", F.coalesce(unit_code(F.col("_own")), F.when(~bare, unit_code(F.col("_both")))))
        .withColumns({"unit": F.col("_own"), "kind": code_kind(F.col("_code")), "value": scaled(F.col("number"), F.col("_code"))})
        .withColumn(
            "status",
            F.when(F.col("number").isNull(), "none")
            .when(F.col("value").isNotNull(), "stated")
            .when(bare & (F.col("_field") == ""), "unitless")
            .otherwise("foreign"),
        )
        .drop("_text", "_rest", "_field", "_own", "_both")
        .withColumnRenamed("_code", "unit_code")
    )


_HEDGE = r"(?:(?:approx\.?|ca\.?|about|~|≈)\s*)?"
_UNIT_TEXT = r"[a-zµμ%][a-zµμ%/ ().]*(?:100\s*ml|l\s*-1|m\s*\^?3)?[a-zµμ%/ ().]*"
_WITH_TOLERANCE = rf"{_HEDGE}(?:{_NUMBER}\s*(?:{_UNIT_WORD}\s*)?{_TOLERANCE}\s*)?{_NUMBER}\s*{_UNIT_TEXT}(?:{_TOLERANCE}\s*{_NUMBER})?"
#: An amount at the end of a name: ``NaCl, 5 mM``, ``NaCl - 5 mM`` or ``NaCl 5 mM``.
NAME_AMOUNT = rf"(?i)[\s,–-]({_WITH_TOLERANCE})$"
#: ``NaCl (5 mM)``
NAME_BRACKET = rf"(?i)\(({_WITH_TOLERANCE})\)$"
# Names that end in a number, which is then no end of a range.
_NUMBERED = r"(?<!\b(?:peg|peo|tween|span|brij|polysorbate|pluronic|poloxamer|ficoll|dextran)\s)"
_DASH = r"[-–—−]"
_LOWER = rf"(?i)(?:^|[\s,(~≈=:]){_NUMBERED}"
#: ``NaCl 5-10 mM``, ``NaCl (5 to 10 mM)``, ``NaCl 5 mM - 10 mM``: a range that ends a name.
NAME_RANGE = rf"{_LOWER}{_NUMBER}(?:{_DASH}\s*|\s+{_DASH}(?!\s)|\s*to\s*|\s*\.\.+\s*|\s*{_UNIT_WORD}\s*{_TO}\s*){_NUMBER}\s*{_UNIT_TEXT}$"
#: ``NaCl 5 - 10 mM``; a higher number before the dash, as in ``C12E 8 - 0.1 %``, belongs to the name.
NAME_RANGE_SPACED = rf"{_LOWER}(\d++(?:[.,]\d++)?+)\s+{_DASH}\s+(\d++(?:[.,]\d++)?+)\s*{_UNIT_TEXT}$"


def amount_in_name(name: Column) -> Column:
    """The amount that ends a name, with its tolerance, or '' where it ends with none or with a range."""
    flat = F.trim(F.regexp_replace(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), rf"(?i)(?<=[^\d\s,(@])(?:{_TEMPERATURE_LAST})", ""))
    inner = F.regexp_extract(flat, NAME_BRACKET, 1)
    low, high = (F.replace(F.regexp_extract(flat, NAME_RANGE_SPACED, i), F.lit(","), F.lit(".")).try_cast("double") for i in (1, 2))
    span = flat.rlike(NAME_RANGE) | F.coalesce(low < high, F.lit(False))
    return F.when(flat.rlike(r"\d\D.*\d") & span, "").when(inner != "", inner).otherwise(F.regexp_extract(flat, NAME_AMOUNT, 1))


_H_ION = r"\[\s*h\s*\+\s*\]|\bh\s*\+|\bh3o\s*\+"
# What may follow a pH without changing it (tolerance, temperature).
_PH_TAIL = r"^(?:\s*(?:\+/-|±|\+-)\s*\d+(?:[.,]\d+)?)?\s*(?:[(@]?\s*(?:at\s*)?(?:-?\d+(?:[.,]\d+)?\s*(?:°|º|deg(?:rees)?\.?)?\s*(?:c|k|celsius|kelvin)|rt|room temperature)\s*\)?)?[.;]?\s*$"


def read_ph(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the pH in hundredths (BIGINT) of a pH field; null for ranges, words and blanks.

    A hydrogen ion concentration (``[H+] = 3e-8 M``, ``30 nM H+``) gives its pH; tolerance and temperature are
    ignored.
    """
    # after the number: an SI prefix and M or mol/L
    prefix = F.regexp_extract(F.translate(after_number(F.col("_ion")), "µμ", "uu"), r"^([munp]?)(?:m|mol(?:ar)?(?:\s*/\s*l|\s*l\s*-1)?)(?![a-z])", 1)
    known = after_number(F.col("_ion")).rlike(r"^[munpµμ]?m")
    power = F.when(known, F.element_at(_map({k: float(PREFIXES[k]) for k in ("", "m", "u", "n", "p")}), prefix))
    digits = F.regexp_replace(F.regexp_extract("_ion", rf"^({_NUMBER})", 1), r"\s*[x×*·]\s*10\s*\^?\s*", "e")
    digits = F.replace(F.replace(digits, F.lit(","), F.lit(".")), F.lit("−"), F.lit("-"))
    value, level = F.col("_value"), F.col("_level")
    return (
        df.withColumn("_flat", F.trim(F.regexp_replace(F.lower(F.col(text)), r"(?U)\s+", " ")))
        .withColumn("_ion", F.when(F.col("_flat").rlike(_H_ION), plain(F.trim(F.regexp_replace(F.regexp_replace("_flat", _H_ION, " "), r"^\s*[=:]\s*", "")))))
        .withColumn("_direct", F.when(F.col("_ion").isNull(), plain(F.regexp_replace(plain(F.col("_flat")), r"^ph\s*(?:of|was|is)?\s*[=:]?\s*", ""))))
        .withColumn("_level", F.when(~F.col("_ion").rlike(_RANGE), digits).try_cast("double"))
        .withColumn("_power", power)
        .withColumns({"_value": number(F.col("_direct")), "_tail": after_number(F.col("_direct"))})
        .withColumn("_level", level * F.pow(F.lit(10.0), F.col("_power")))
        .withColumn(
            out,
            F.when(F.col("_ion").isNotNull(), F.when(level > 0, F.round(-F.log10(level) * 100, 0).cast("long")))
            .when(F.col("_tail").rlike(_PH_TAIL) & value.between(-2, 16), F.round(value * 100, 0).try_cast("long")),
        )
        .drop("_flat", "_ion", "_direct", "_level", "_power", "_value", "_tail")
    )


#: A pH named in running text: the word, at most six words of the same sentence, a number.
PH_IN_TEXT = r"(?i)\bpH\b(?:\s*[=:]\s*|(?:\s+(?!\d)[^\s.;]+){0,6}?\s+)(\d+(?:[.,]\d+)?)(?!\d)(?!\s*(?:-|–|to)\s*\d)"


def read_ph_in_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the pH in hundredths that a running text states; null where it states none."""
    found = F.replace(F.regexp_extract(F.col(text), PH_IN_TEXT, 1), F.lit(","), F.lit("."))
    value = F.col("_stated")
    return df.withColumn("_stated", found.try_cast("decimal(20,6)")).withColumn(out, F.when(value <= 14, F.round(value * 100, 0).try_cast("long"))).drop("_stated")
