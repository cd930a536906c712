"""The canonical transaction schema and the aliases that resolve to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywatch.functions.numbers import parse_number, parse_timestamp

CANONICAL = T.StructType(
    [
        T.StructField("txn_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("sender_account", T.StringType()),
        T.StructField("receiver_account", T.StringType()),
        T.StructField("sender_country", T.StringType()),
        T.StructField("receiver_country", T.StringType()),
        T.StructField("mcc", T.StringType()),
        T.StructField("merchant_name", T.StringType()),
        T.StructField("card_number", T.StringType()),
        T.StructField("sender_first_name", T.StringType()),
        T.StructField("sender_last_name", T.StringType()),
        T.StructField("receiver_first_name", T.StringType()),
        T.StructField("receiver_last_name", T.StringType()),
        T.StructField("payment_format", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("reference", T.StringType()),
        T.StructField("sender_address_line", T.StringType()),
        T.StructField("sender_address_city", T.StringType()),
        T.StructField("sender_address_state", T.StringType()),
        T.StructField("sender_address_postal", T.StringType()),
        T.StructField("card_product_type", T.StringType()),
        T.StructField("currency", T.StringType()),
    ]
)

# Accepted source headers per canonical column, first existing one wins.
SHEET_ALIASES = {
    "ts": ("Transaction Date", "Date"),
    "amount": ("Transaction Amount", "Amount"),
    "sender_account": ("Sender Account", "Originator Account"),
    "receiver_account": ("Receiver Account", "Beneficiary Account"),
    "sender_country": ("SENDER ADDRESS COUNTRY", "Sender Country"),
    "receiver_country": ("RECEIVER ADDRESS COUNTRY", "Receiver Country (Legacy)", "Receiver Country"),
    "mcc": ("Merchant Category Code", "MCC"),
    "merchant_name": ("Merchant Name",),
    "card_number": ("CARD NUMBER", "Card Number"),
    "sender_first_name": ("SENDER FIRST NAME", "Sender First Name"),
    "sender_last_name": ("SENDER LAST NAME", "Sender Last Name"),
    "receiver_first_name": ("Receiver First Name", "RECEIVER FIRST NAME"),
    "receiver_last_name": ("Receiver Last Name", "RECEIVER LAST NAME"),
    "reference": ("transaction_reference_number", "Transaction Reference"),
    "sender_address_line": ("SENDER ADDRESS LINE",),
    "sender_address_city": ("SENDER ADDRESS CITY",),
    "sender_address_state": ("SENDER ADDRESS STATE",),
    "sender_address_postal": ("SENDER ADDRESS POSTAL",),
    "card_product_type": ("CARD PRODUCT TYPE",),
    "currency": ("Transaction Currency Code",),
}
BATCH_ALIASES = {
    **SHEET_ALIASES,
    "ts": ("Timestamp", "Transaction Date", "Date", "timestamp"),
    "amount": ("Transaction Amount", "Amount", "Amount Paid", "amount_usd"),
    "sender_account": ("Account", "Sender Account", "From Account", "sender_account"),
    "receiver_account": ("Account.1", "Receiver Account", "To Account", "receiver_account"),
    "sender_country": ("SENDER ADDRESS COUNTRY", "Sender Country", "From Bank"),
    "receiver_country": ("RECEIVER ADDRESS COUNTRY", "Receiver Country (Legacy)", "Receiver Country", "To Bank"),
    "payment_format": ("Payment Format", "payment_format", "Payment Type"),
    "label": ("Is Laundering", "is_laundering", "label"),
}
FEATURE_ALIASES = {
    **BATCH_ALIASES,
    "amount": ("Amount Paid", "Transaction Amount", "Amount", "amount", "amount_usd"),
    "sender_country": ("From Bank", "Sender Bank", "sender_country"),
    "receiver_country": ("To Bank", "Receiver Bank", "receiver_country"),
}
ALIASES = {"v2": SHEET_ALIASES, "v3": BATCH_ALIASES, "features": FEATURE_ALIASES}


def resolve_aliases(columns: list[str], profile: str = "v3") -> dict[str, str]:
    """Canonical name -> source column, for every canonical column the source offers.

    A column that already bears its canonical name is taken when no alias is present.
    """
    present = set(columns)
    chosen = {}
    for name in CANONICAL.fieldNames():
        for candidate in (*ALIASES[profile].get(name, ()), name):
            if candidate in present:
                chosen[name] = candidate
                break
    return chosen


def canonicalise(df: DataFrame, profile: str = "v3", keep: tuple[str, ...] = ()) -> DataFrame:
    """Bring any compatible table to canonical names and types in one projection.

    Columns the source does not have stay absent, so that rules and features depending on
    them are left out of the plan. The row id must be given by the source as ``txn_id``. Columns in
    ``keep`` pass through as they are.
    """
    chosen = resolve_aliases(df.columns, profile)
    if "txn_id" not in chosen:
        raise ValueError("the source needs a unique txn_id column, see sources.files.with_row_ids")
    typed = (_typed(df, chosen[f.name], f).alias(f.name) for f in CANONICAL.fields if f.name in chosen)
    return df.select(*keep, *typed)


def _typed(df: DataFrame, source: str, field: T.StructField) -> Column:
    column = F.col(f"`{source}`")
    dtype = df.schema[source].dataType
    if field.name == "label":
        return F.coalesce(parse_number(column, dtype).try_cast("int"), F.lit(0))
    if isinstance(field.dataType, T.DoubleType):
        return parse_number(column, dtype)
    if isinstance(field.dataType, T.TimestampType):
        return parse_timestamp(column, dtype)
    return column.cast(field.dataType)


def has(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def optional(df: DataFrame, name: str) -> Column:
    """The column, or a typed null where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(CANONICAL[name].dataType)


def reference_text(df: DataFrame) -> Column:
    """The source's reference of a row; rows without one are named after their id."""
    fallback = F.concat(F.lit("Row-"), F.col("txn_id").cast("string"))
    return F.coalesce(optional(df, "reference"), fallback)
