"""Normalisation and display of text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywatch.constants import FATF_COUNTRIES, FEATURE_LABELS, HIGH_RISK_MCC, NO_FLAGS
from tallywatch.functions.numbers import NUMBER_PATTERN


def lookup(entries: dict[str, str], key: Column) -> Column:
    """The name behind a code, null when the code is unknown.

    The dictionaries are fixed and tiny, so they travel as a literal in the plan and the
    lookup costs no join.
    """
    quoted = ", ".join(f"'{code}', '{name}'" for code, name in entries.items())
    return F.try_element_at(F.expr(f"map({quoted})"), key)


def normalise_mcc(value: Column) -> Column:
    """A numeric code without fraction and leading zeros; other text is only trimmed."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.coalesce(number.try_cast("bigint").cast("string"), text)


def normalise_country(value: Column) -> Column:
    return F.upper(F.trim(F.coalesce(value, F.lit(""))))


def mcc_name(code: Column) -> Column:
    return lookup(HIGH_RISK_MCC, code)


def fatf_name(country: Column) -> Column:
    return lookup(FATF_COUNTRIES, country)


def is_high_risk_mcc(code: Column) -> Column:
    return F.coalesce(code.isin(*HIGH_RISK_MCC), F.lit(False))


def is_fatf(country: Column) -> Column:
    return F.coalesce(country.isin(*FATF_COUNTRIES), F.lit(False))


def currency(amount: Column) -> Column:
    """``$1,234.50``; an absent amount reads ``N/A``."""
    infinity = F.lit(float("inf"))
    return (
        F.when(amount.isNull(), "N/A")
        .when(F.isnan(amount), "$nan")
        .when(amount == infinity, "$inf")
        .when(amount == -infinity, "$-inf")
        .otherwise(F.concat(F.lit("$"), F.format_number(amount, 2)))
    )


def currency_text(value: Column) -> Column:
    """Currency text of an unparsed field: text that is no number stays as it is."""
    number = F.when(F.trim(value).rlike(NUMBER_PATTERN), F.trim(value).try_cast("double"))
    return F.when(value.isNotNull() & number.isNull(), value).otherwise(currency(number))


def full_name(first: Column, last: Column) -> Column:
    """First and last name joined, null when both are blank."""
    joined = F.trim(F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(last, F.lit(""))))
    return F.nullif(joined, F.lit(""))


def counterparty(first: Column, last: Column, merchant: Column, account: Column) -> Column:
    """``First Last (Merchant)``, or the best of name, merchant and account."""
    name = full_name(first, last)
    shop = F.nullif(F.nullif(merchant, F.lit("")), F.lit("Unknown"))
    return F.coalesce(
        F.when(name.isNotNull() & shop.isNotNull(), F.concat(name, F.lit(" ("), shop, F.lit(")"))),
        name,
        shop,
        F.nullif(account, F.lit("")),
        F.lit("Unknown"),
    )


def flag_count(flags_text: Column) -> Column:
    bars = F.length(flags_text) - F.length(F.replace(flags_text, F.lit("|"), F.lit("")))
    return F.when(flags_text == NO_FLAGS, F.lit(0)).otherwise(bars + 1).cast("int")


def shortened(text: Column, width: int = 60) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def masked_card(card: Column) -> Column:
    shown = F.coalesce(F.nullif(card, F.lit("")), F.lit("XXXX-XXXX-XXXX-XXXX"))
    tail = F.when(F.length(shown) >= 4, F.right(shown, F.lit(4))).otherwise("****")
    return F.concat(F.substring(shown, 1, 4), F.lit("XXXXXXXX"), tail)


def feature_label(feature: Column) -> Column:
    plain = F.initcap(F.replace(feature, F.lit("_"), F.lit(" ")))
    return F.coalesce(lookup(FEATURE_LABELS, feature), plain)


def risk_level(score: Column, high: int, medium: int) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")
