"""URL filters: host and path rules, then a list of URLs behind a blocked Bloom filter.

Canonical form of a URL: no scheme, lower-case host without ``www.``, ``m.`` or port, path
without its final slash or ``.html``, no query or fragment. The list is hashed into a Bloom
filter of 64-bit blocks: one hash picks the block, six bits in it are set. A URL whose bits are
all set may be listed; only those go on to an exact join with the list, which removes false
positives. The filter has at most ``MAX_BLOCKS`` blocks (16 MB), so it may be broadcast; beyond
that it lets more URLs through to the join and the result stays exact.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are never
listed. Repeated URLs and page ids are judged row by row; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 20
BITS_PER_URL = 16
PROBES = 6
#: (verdict, host, path) of the default rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host and path without spelling variants; null without a host."""
    bare = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(\.html|/)$", "")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def mask_of(url: Column) -> Column:
    """The bits of a URL in its block."""
    second = F.xxhash64(F.lit(7), url)
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * i).bitwiseAND(63).cast("int")))
    return mask


def bloom(listed: DataFrame, url: str = "url_key") -> tuple[DataFrame, int]:
    """(block, bits) rows of the filter of distinct listed URLs and the number of its blocks."""
    n = listed.count()
    blocks = 1
    while blocks < min(MAX_BLOCKS, n * BITS_PER_URL / 64):
        blocks *= 2
    bits = listed.groupBy(F.pmod(F.xxhash64(url), F.lit(blocks)).alias("_block")).agg(F.bit_or(mask_of(F.col(url))).alias("_bits"))
    return bits, blocks


def is_listed(df: DataFrame, listed: DataFrame, url: str = "url_key") -> DataFrame:
    """``df`` with a boolean ``listed``: the filter passes candidates, an exact join decides."""
    keys = listed.select(F.col(listed.columns[0]).alias("_listed")).where("_listed is not null").distinct()
    bits, blocks = bloom(keys, "_listed")
    probed = df.withColumn("_block", F.pmod(F.xxhash64(url), F.lit(blocks))).join(F.broadcast(bits), "_block", "left")
    mask = mask_of(F.col(url))
    maybe = F.coalesce(F.col(url).isNotNull() & (F.col("_bits").bitwiseAND(mask) == mask), F.lit(False))
    probed = probed.withColumn("_maybe", maybe).drop("_block", "_bits")
    missed = probed.where(~F.col("_maybe")).withColumn("listed", F.lit(False))
    hits = probed.where("_maybe").join(keys, F.col(url) == F.col("_listed"), "left").withColumn("listed", F.col("_listed").isNotNull()).drop("_listed")
    return missed.unionByName(hits).drop("_maybe")


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Add host, path, url_key, rule, listed and verdict; ``listed`` has canonical URLs in its first column."""
    host, path = F.col("host"), F.col("path")
    rule, verdict = rule_of(host, path, rules)
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    parts = parts.withColumns({"url_key": canonical(host, path), "rule": rule, "_ruled": verdict})
    out = is_listed(parts, listed)
    return out.withColumn("verdict", F.coalesce("_ruled", F.when(F.col("listed"), "block").otherwise("allow"))).drop("_ruled")


def listed_from(pages: DataFrame, url: str = "url", labels: tuple[str, ...] = ("spam-farm", "cheap-pills")) -> DataFrame:
    """Canonical URLs of pages on hosts that carry one of the given names as a label."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    named = F.lit(False)
    for label in labels:
        named = named | F.concat(F.lit("."), host, F.lit(".")).contains(f".{label}.")
    return pages.where(named).select(canonical(host, path).alias("url_key")).distinct()
