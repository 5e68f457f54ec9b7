"""Payload inspectors as column expressions, and the registry that runs them.

Rules are about bytes. ``byte_text`` turns a payload (string or binary) into
text with one character per byte, once per row; every inspector works on that
view. Whole payloads are searched, never a prefix.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Personal-data patterns.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?<![A-Za-z0-9_])[0-9]{10}(?![A-Za-z0-9_])"

# Medical marker, keyword weights and alert bound.
MEDICAL_MARKER = "DICM"
MEDICAL_KEYWORDS = {
    "PatientName": 10,
    "PatientID": 10,
    "PatientBirthDate": 8,
    "PatientSex": 2,
    "StudyDate": 5,
    "InstitutionName": 7,
    "ReferringPhysicianName": 9,
    "Modality": 1,
}

# Shell command fragments.
SHELL_FRAGMENTS = ["sh", "wget", "curl", "/bin/bash", "cat /etc/passwd"]

# Decoy targets in order of precedence.
DECOYS = [
    ("/admin/db_config.php", "Database Credentials Trap"),
    ("/wp-config.php", "Wordpress Config Trap"),
    ("/.env", "Environment Variable Trap"),
    ("/server-status", "Server Info Trap"),
    ("/id_rsa", "SSH Key Trap"),
    ("SELECT password FROM users", "SQL Injection Honey-Query"),
]

# Key-exchange byte signatures.
PQC_SIGNATURES = [
    (b"\x06\x0b\x2b\x06\x01\x04\x01\x02\x32\x03\x01\x01", "Kyber512"),
    (b"\x06\x0b\x2b\x06\x01\x04\x01\x02\x32\x03\x02\x01", "Kyber768"),
    (b"\x06\x0b\x2b\x06\x01\x04\x01\x02\x32\x03\x03\x01", "Kyber1024"),
    (b"\x06\x0b\x2b\x06\x01\x04\x01\x02\x32\x03\x05\x01", "Dilithium2"),
    (b"\x06\x0b\x2b\x06\x01\x04\x01\x02\x32\x03\x06\x01", "Dilithium3"),
    (b"x25519_kyber768", "Hybrid-Kyber-TLS"),
    (b"p256_kyber768", "Hybrid-Kyber-TLS"),
    (b"dilithium", "Dilithium-General"),
    (b"falcon", "Falcon-General"),
]

# Drill marker.
DRILL_MARKER = "RedTeam-XSS-Probe"

# Threat substrings and harmless request starts of the two scorers.
PATTERNS_A = [
    "/etc/passwd",
    "/etc/shadow",
    "cmd.exe",
    "/bin/sh",
    "/bin/bash",
    "${jndi:",
    "UNION SELECT",
    "SELECT * FROM",
    "<script>",
    "javascript:",
    "onerror=",
    "curl http",
    "wget http",
    "powershell",
]
SAFE_STARTS_A = ["GET /", "POST /", "PUT /", "HEAD /"]
PATTERNS_B = [
    "/etc/passwd",
    "cmd.exe",
    "/bin/sh",
    "SELECT * FROM",
    "UNION SELECT",
    "<script>",
    "onerror=",
    "javascript:",
    "curl http",
    "wget http",
]
SAFE_STARTS_B = ["GET /", "POST /"]
RISKY_CHARS_B = ["'", '"', ";", "<", ">", "../"]

RESULT = "struct<alert:string,info:string,threat_level:string,score:int,details:string>"


def byte_text(payload: Column) -> Column:
    """Payload bytes as text, one character per byte (Latin-1)."""
    return F.decode(payload.cast("binary"), "ISO-8859-1")


def _has(text: Column, part: str | bytes) -> Column:
    return text.contains(part if isinstance(part, str) else part.decode("latin-1"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _result(alert=None, info=None, level=None, score=None, details=None) -> Column:
    def text(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    return F.struct(
        text(alert).alias("alert"),
        text(info).alias("info"),
        text(level).alias("threat_level"),
        (score if score is not None else F.lit(None)).cast("int").alias("score"),
        text(details).alias("details"),
    )


def pii(text: Column) -> Column:
    # An address needs an @, a far cheaper test than the pattern.
    emails = F.when(text.contains("@"), F.regexp_count(text, F.lit(EMAIL))).otherwise(0)
    phones = F.regexp_count(text, F.lit(PHONE))

    def report(n: Column) -> Column:
        parts = F.array_compact(
            F.array(
                F.when(n["emails"] > 0, F.concat(F.lit("Emails found: "), n["emails"].cast("string"))),
                F.when(n["phones"] > 0, F.concat(F.lit("Phones found: "), n["phones"].cast("string"))),
            )
        )
        return F.when(F.size(parts) > 0, _result(alert="GDPR_PII_LEAK", details=F.array_join(parts, ", ")))

    return _once(F.struct(emails.alias("emails"), phones.alias("phones")), report)


def phi(text: Column) -> Column:
    score = sum((F.when(_has(text, k), w).otherwise(0) for k, w in MEDICAL_KEYWORDS.items()), F.lit(0))
    leaks = F.array_compact(F.array(*[F.when(_has(text, k), k) for k in MEDICAL_KEYWORDS]))
    listed = F.concat(F.lit("Cleartext PHI found: ['"), F.array_join(leaks, "', '"), F.lit("']"))
    level = F.when(score > 15, "CRITICAL").otherwise("WARNING")
    return F.when(
        _has(text, MEDICAL_MARKER),
        F.when(score > 0, _result(alert="PHI_LEAK", level=level, score=score, details=listed)).otherwise(
            _result(info="DICOM stream detected (Anonymized/Metadata only)")
        ),
    )


def shell_commands(text: Column) -> Column:
    hits = F.array_compact(F.array(*[F.when(_has(text, c), c) for c in SHELL_FRAGMENTS]))
    return _once(
        hits, lambda h: F.when(F.size(h) > 0, _result(alert="HONEYPOT_TRIGGER", details=F.array_join(h, ", ")))
    )


def decoy_paths(text: Column) -> Column:
    out = F.lit(None).cast(RESULT)
    for path, trap in reversed(DECOYS):
        found = _result(alert="HONEYPOT_TRAP", level="CRITICAL", details=f"{trap}: {path}")
        out = F.when(_has(text, path), found).otherwise(out)
    return out


def pqc(text: Column) -> Column:
    names = F.array_compact(F.array(*[F.when(_has(text, sig), name) for sig, name in PQC_SIGNATURES]))

    def report(n: Column) -> Column:
        listed = F.array_join(F.array_sort(F.array_distinct(n)), ", ")
        return F.when(F.size(n) > 0, _result(alert="PQC_HANDSHAKE_DETECTED", level="INFO", details=listed))

    return _once(names, report)


def non_printable(text: Column) -> Column:
    """Bytes outside the printable range 32..126."""
    return F.length(text) - F.length(F.regexp_replace(text, r"[^\x20-\x7e]+", ""))


def high_entropy(text: Column, minimum: int = 128, share: float = 0.4) -> Column:
    size = F.length(text)
    hot = F.when(size > minimum, non_printable(text) / size > share)
    return F.when(hot, _result(alert="HIGH_ENTROPY_TRAFFIC", details="Potential encrypted exfiltration detected"))


def drill_marker(text: Column) -> Column:
    return F.when(_has(text, DRILL_MARKER), _result(info="Red Team Drill Detected (Defense is active)"))


Inspector = Callable[[Column], Column]

BUILT_IN: dict[str, Inspector] = {
    "pii": pii,
    "phi": phi,
    "shell_commands": shell_commands,
    "decoy_paths": decoy_paths,
    "pqc": pqc,
    "high_entropy": high_entropy,
    "drill_marker": drill_marker,
}


def python_inspector(check: Callable[[bytes], dict | None]) -> Inspector:
    """Inspector from a Python function of the payload bytes, for rules columns cannot express.

    The function returns a mapping with any of alert, info, threat_level, score
    and details, or None. A failure on one payload counts as no finding.
    """
    fields = ["alert", "info", "threat_level", "score", "details"]

    @F.pandas_udf(RESULT.replace("score:int", "score:double"))
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                found = check(text.encode("latin-1")) if text is not None else None
            except Exception:
                found = None
            rows.append([(found or {}).get(f) for f in fields])
        out = pd.DataFrame(rows, columns=fields)
        return out.assign(score=pd.to_numeric(out["score"], errors="coerce"))

    def build(text: Column) -> Column:
        found = run(text)
        some = F.coalesce(*[found[f].cast("string") for f in fields]).isNotNull()
        return F.when(some, found.cast(RESULT))

    return build


class InspectorRegistry:
    """Named inspectors, each a function from the byte text to a nullable result struct.

    ``python_inspector`` wraps rules that need Python. ``skip_failing`` drops inspectors whose expression cannot be
    built, so that one of them does not stop the others.
    """

    def __init__(self, inspectors: dict[str, Inspector] | None = None):
        self._inspectors = dict(BUILT_IN if inspectors is None else inspectors)

    def register(self, name: str, inspector: Inspector) -> None:
        self._inspectors[name] = inspector

    def names(self) -> list[str]:
        return list(self._inspectors)

    def results(self, text: Column, skip_failing: bool = True) -> Column:
        entries = []
        for name, build in self._inspectors.items():
            try:
                found = build(text)
            except Exception:
                if not skip_failing:
                    raise
                continue
            entries.append(F.struct(F.lit(name).alias("inspector"), found.cast(RESULT).alias("result")))
        if not entries:
            return F.array().cast(f"array<struct<inspector:string,result:{RESULT}>>")
        return F.filter(F.array(*entries), lambda e: e["result"].isNotNull())

    def run(self, df: DataFrame, payload: str = "payload", skip_failing: bool = True) -> DataFrame:
        """Add ``findings``: the non-empty results of all inspectors."""
        with_text = df.withColumn("_text", byte_text(F.col(payload)))
        return with_text.withColumn("findings", self.results(F.col("_text"), skip_failing)).drop("_text")


def findings(inspected: DataFrame, *keys: str) -> DataFrame:
    """One row per payload and inspector that found something.

    The outer explode keeps the optimizer from deriving a non-empty filter,
    which would run all inspectors a second time below the generator.
    """
    rows = inspected.select(*keys, F.explode_outer("findings").alias("f")).filter("f IS NOT NULL")
    return rows.select(*keys, "f.inspector", "f.result.*")


def inspector_hits(inspected: DataFrame) -> DataFrame:
    return findings(inspected).groupBy("inspector").agg(F.count(F.lit(1)).alias("hits"))


def _starts(text: Column, starts: list[str]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | text.startswith(s)
    return out


def _views(payload: Column) -> Column:
    """Byte text and its lower-case form. Only ASCII patterns are looked up in the latter."""
    text = byte_text(payload)
    return F.struct(text.alias("text"), F.lower(text).alias("low"))


def _threats(low: Column, patterns: list[str]) -> Column:
    return sum((low.contains(p.lower()).cast("int") for p in patterns), F.lit(0))


def signature_score_a(base: Column, payload: Column) -> Column:
    """Base score plus a capped boost for known threats; plain requests are held near zero.

    The plain-request test looks for the patterns as written in the lower-cased
    payload, so patterns with capitals never match there.
    """

    def score(v: Column) -> Column:
        clean = _starts(v["text"], SAFE_STARTS_A)
        for p in PATTERNS_A:
            clean = clean & ~v["low"].contains(p)
        total = base + F.least(_threats(v["low"], PATTERNS_A) * F.lit(0.35), F.lit(0.6))
        held = _once(total, lambda t: F.when(clean & (t < 0.8), F.least(t, F.lit(0.05))).otherwise(t))
        bounded = F.greatest(F.lit(0.0), F.least(held, F.lit(1.0)))
        return F.when(F.coalesce(F.length(v["text"]), F.lit(0)) == 0, 0.0).otherwise(bounded)

    return _once(_views(payload), score)


def signature_score_b(base: Column, payload: Column) -> Column:
    """Variant with a larger, uncapped boost and a stricter notion of a plain request."""

    def score(v: Column) -> Column:
        clean = _starts(v["text"], SAFE_STARTS_B)
        for c in RISKY_CHARS_B:
            clean = clean & ~v["text"].contains(c)
        total = base + _threats(v["low"], PATTERNS_B) * F.lit(0.5)
        held = _once(total, lambda t: F.when(clean & (t < 1.0), F.least(t, F.lit(0.1))).otherwise(t))
        return F.least(F.greatest(held, F.lit(0.0)), F.lit(1.0))

    return _once(_views(payload), score)


def request_verdict(score: Column, results: Column, threshold: float = 0.5) -> Column:
    """BLOCK when the score is high or any inspector raised an alert or a threat level."""
    raised = F.exists(
        results,
        lambda f: f["result"]["alert"].isNotNull()
        | F.coalesce(f["result"]["threat_level"].isin("WARNING", "CRITICAL"), F.lit(False)),
    )
    return F.when((score > threshold) | raised, "BLOCK").otherwise("VERIFIED")


def verdict_rollup(scored: DataFrame, verdict: str = "verdict", score: str = "score") -> DataFrame:
    return scored.agg(
        F.count_if(F.col(verdict) != "BLOCK").alias("verified"),
        F.count_if((F.col(score) > 0.3) & (F.col(score) <= 0.5)).alias("warnings"),
        F.count_if(F.col(verdict) == "BLOCK").alias("blocked"),
    )
