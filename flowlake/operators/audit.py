"""Hash-chained audit logs: building and verifying."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.operators.sequence import MAX_GROUP_ROWS, POSITION, Stage, ordered

GENESIS = "0" * 64


def canonical_record(ts: Column, event: Column, fields_json: Column, prev_hash: Column) -> Column:
    """The record as compact JSON with sorted keys: event, fields, prev_hash, ts."""

    def quoted(text: Column) -> Column:
        # to_json of a one-element array escapes the text; the brackets are cut off.
        body = F.to_json(F.array(text))
        return F.substring(body, 2, F.length(body) - 2)

    return F.concat(
        F.lit('{"event":'), quoted(event), F.lit(',"fields":'), fields_json,
        F.lit(',"prev_hash":'), quoted(prev_hash), F.lit(',"ts":'), quoted(ts), F.lit("}"),
    )


def _compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def canonical_json(text: Column | str) -> Column:
    """JSON text with keys sorted at every depth, compact separators and non-ASCII characters kept; null if it is no JSON."""

    def one(value):
        try:
            return None if value is None else _compact(json.loads(value))
        except ValueError:
            return None

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    batch.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "string")(text)


def audit_record(line: Column | str) -> Column:
    """Hashes of a log line and the canonical JSON of what its own hash covers; nulls where the line is no object."""

    def one(value):
        try:
            record = json.loads(value)
        except (TypeError, ValueError):
            record = None
        if not isinstance(record, dict):
            return None, None, None
        texts = [record.get(k) if isinstance(record.get(k), str) else None for k in ("prev_hash", "hash")]
        return *texts, _compact({k: record.get(k) for k in ("ts", "event", "fields", "prev_hash")})

    def batch(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in lines], columns=["prev_hash", "hash", "payload"])

    batch.__annotations__ = {"lines": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(batch, "prev_hash string, hash string, payload string")(line)


def scan_audit_lines(spark: SparkSession, path: str, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """(log_id, line_no, line) of JSON-lines logs, one log per file; blank lines count but are left out.

    Lines are numbered by their place in the file, whatever splits the file is read in.
    """
    text = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row")
    )
    numbered = ordered(text, ["log_id"], ["_split", "_row"], [], max_group_rows)
    return numbered.where(F.btrim("value") != "").select("log_id", F.col(POSITION).alias("line_no"), F.col("value").alias("line"))


def record_hash(ts: Column, event: Column, fields_json: Column, prev_hash: Column) -> Column:
    return F.sha2(F.concat(prev_hash, canonical_record(ts, event, fields_json, prev_hash)), 256)


def chain_breaks(
    log: DataFrame, keys: Sequence[str] = ("log_id",), line: str = "line_no", max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Per line: does it name its predecessor's hash, and is its own hash right?

    A log is a table of (ts, event, fields, prev_hash, hash), ``fields`` as canonical JSON (see
    ``canonical_json``), or of whole JSON lines in a column ``line``, which are brought into
    canonical form. Every line carries the previous hash, so its digest is checked on its own,
    in parallel, and only a one-row look-back ties neighbours together. The predecessor's hash
    is its recomputed one. A line that is no JSON object breaks the chain.
    """
    if "line" in log.columns:
        found = log.withColumn("_record", audit_record("line"))
        parts = {c: F.col(f"_record.{c}") for c in ("prev_hash", "hash")}
        checked = found.withColumns({**parts, "_digest": F.sha2(F.concat("_record.prev_hash", "_record.payload"), 256)}).drop("_record")
    else:
        expected = record_hash(F.col("ts"), F.col("event"), F.col("fields"), F.col("prev_hash"))
        checked = log.withColumn("_digest", F.when(F.col("prev_hash").isNotNull(), expected))
    look_back = Stage(lambda w: {"_prior": F.lag("_digest").over(w)}, 1)
    out = ordered(checked, list(keys), [line], [look_back], max_group_rows)
    before = F.when(F.col(POSITION) == 1, F.lit(GENESIS)).otherwise(F.col("_prior"))
    return out.withColumns(
        {
            "chain_ok": F.coalesce(F.col("prev_hash") == before, F.lit(False)),
            "hash_ok": F.coalesce(F.col("hash") == F.col("_digest"), F.lit(False)),
        }
    ).drop("_digest", "_prior", POSITION)


def chain_verify(
    log: DataFrame, keys: Sequence[str] = ("log_id",), line: str = "line_no", max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """One row per log: ok, or the first line that breaks the chain and why."""
    lines = chain_breaks(log, keys, line, max_group_rows)
    bad = ~F.col("chain_ok") | ~F.col("hash_ok")
    text = F.when(~F.col("chain_ok"), F.concat(F.lit("hash chain break at line "), F.col(line).cast("string"))).otherwise(
        F.concat(F.lit("hash mismatch at line "), F.col(line).cast("string"))
    )
    return lines.groupBy(*keys).agg(
        (F.count_if(bad) == 0).alias("ok"),
        F.coalesce(F.min_by(F.when(bad, text), F.when(bad, F.col(line))), F.lit("ok")).alias("message"),
        F.count(F.lit(1)).alias("n_lines"),
    )
