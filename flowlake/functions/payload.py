"""Byte-level columns: payload vectors and link/network header fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(data: Column, index: int) -> Column:
    """Unsigned byte at a zero-based position."""
    return F.conv(F.hex(F.substring(data, index + 1, 1)), 16, 10).cast("int")


def uint_at(data: Column, index: int, width: int) -> Column:
    return F.conv(F.hex(F.substring(data, index + 1, width)), 16, 10).cast("long")


def payload_vector(payload: Column, size: int = 1024) -> Column:
    """First ``size`` bytes scaled to 0..1, zero-padded: a fixed-length model input.

    Arrow batches and NumPy: unpacking bytes one element at a time in a column
    lambda is far slower than one buffer view per batch.
    """

    @F.pandas_udf("array<float>")
    def unpack(values: pd.Series) -> pd.Series:
        out = np.zeros((len(values), size), dtype=np.float32)
        for row, data in enumerate(values):
            if data is not None:
                head = np.frombuffer(data[:size], dtype=np.uint8)
                out[row, : len(head)] = head
        return pd.Series(list(out / np.float32(255.0)))

    return unpack(payload)


def _dotted(data: Column, start: int) -> Column:
    return F.concat_ws(".", *[byte_at(data, start + i).cast("string") for i in range(4)])


def _compressed_v6(data: Column, start: int) -> Column:
    """Canonical IPv6 text: lower case, no leading zeros, first longest zero run shortened.

    One-element ``transform`` calls stand in for local variables: an expression
    used several times would otherwise be copied into the plan each time.
    """
    groups = F.regexp_extract_all(F.lower(F.hex(F.substring(data, start + 1, 16))), F.lit("(....)"))
    bare = F.transform(groups, lambda g: F.regexp_replace(g, "^0{1,3}", ""))
    text = F.concat(F.lit(":"), F.array_join(bare, ":"), F.lit(":"))

    def shorten(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit("(?<=:)((?:0:){2,})"))
        longest = F.concat(F.lit(":"), F.coalesce(F.get(F.reverse(F.array_sort(runs)), F.lit(0)), F.lit("")))
        return F.get(F.transform(F.array(longest), lambda z: cut(t, z)), F.lit(0))

    def cut(t: Column, zeros: Column) -> Column:
        at = F.instr(t, zeros)
        shorter = F.concat(F.substring(t, F.lit(1), at - 1), F.lit("::"), F.substring(t, at + F.length(zeros), F.lit(64)))
        return F.when(zeros != ":", shorter).otherwise(t)

    short = F.get(F.transform(F.array(text), shorten), F.lit(0))
    return F.regexp_replace(F.regexp_replace(short, "^:(?!:)", ""), "(?<!:):$", "")


def header_fields(frame: Column) -> Column:
    """Struct of addresses, ports and protocol decoded from an Ethernet frame.

    Frames shorter than a link header are NULL; a known link type with a short
    network header keeps "unknown" addresses.
    """
    size = F.octet_length(frame)
    ether = uint_at(frame, 12, 2)
    proto = byte_at(frame, 23)
    v4 = (ether == 0x0800) & (size >= 34)
    v6 = (ether == 0x86DD) & (size >= 54)
    ported = v4 & (size >= 42) & proto.isin(6, 17)
    unknown = F.lit("unknown")
    name = (
        F.when(ported & (proto == 6), "TCP")
        .when(ported & (proto == 17), "UDP")
        .when(v4, F.concat(F.lit("IPv4/"), proto.cast("string")))
        .when(v6, "IPv6")
        .otherwise(unknown)
    )
    fields = F.struct(
        F.when(v4, _dotted(frame, 26)).when(v6, _compressed_v6(frame, 22)).otherwise(unknown).alias("src_ip"),
        F.when(v4, _dotted(frame, 30)).when(v6, _compressed_v6(frame, 38)).otherwise(unknown).alias("dst_ip"),
        F.when(ported, uint_at(frame, 34, 2).cast("int")).alias("src_port"),
        F.when(ported, uint_at(frame, 36, 2).cast("int")).alias("dst_port"),
        name.alias("protocol"),
        size.cast("long").alias("packet_size"),
    )
    return F.when(size >= 14, fields)
