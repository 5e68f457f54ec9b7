"""Redaction of personal data and secrets in text and nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word edges spelled out: what \b means differs between JVM versions.
_START, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# Patterns and their replacements, applied in this order.
TEXT_RULES = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    (_START + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + _END, "[REDACTED_IP]"),
    (_START + r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}" + _END, "[REDACTED_GITHUB_TOKEN]"),
    (r"\bAIza[0-9A-Za-z\-_]{30,}\b", "[REDACTED_FIREBASE_API_KEY]"),
]

# Key names whose value is always hidden.
SENSITIVE_KEYS = [
    "password",
    "passwd",
    "secret",
    "token",
    "api_key",
    "apikey",
    "authorization",
    "auth",
    "email",
    "ip",
    "ip_address",
    "private_key",
    "client_secret",
]
HIDDEN = "[REDACTED]"


def scrub_text(text: Column) -> Column:
    for pattern, label in TEXT_RULES:
        text = F.regexp_replace(text, pattern, label)
    return text


def scrub_value(value: Column, dtype: T.DataType) -> Column:
    """Column with strings scrubbed at any depth and sensitive keys hidden."""
    if isinstance(dtype, T.StringType):
        return scrub_text(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: scrub_value(item, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [
            (F.lit(HIDDEN) if f.name.lower() in SENSITIVE_KEYS else scrub_value(value[f.name], f.dataType)).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):

        def entry(key: Column, item: Column) -> Column:
            cleaned = scrub_value(item, dtype.valueType)
            if isinstance(dtype.valueType, T.StringType):
                hidden = F.lit(HIDDEN)
            else:
                hidden = F.lit(None)
            return F.when(F.lower(key).isin(SENSITIVE_KEYS), hidden).otherwise(cleaned)

        return F.transform_values(value, entry)
    return value


def scrub_record(df: DataFrame) -> DataFrame:
    """Scrub every column by its schema; top-level sensitive columns are hidden whole."""
    return df.select(
        *[
            (F.lit(HIDDEN) if f.name.lower() in SENSITIVE_KEYS else scrub_value(F.col(f.name), f.dataType)).alias(f.name)
            for f in df.schema.fields
        ]
    )
