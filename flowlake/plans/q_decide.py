"""Registered queries: blocklist, joins, inspectors, routing, enforcement, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.functions import encode
from flowlake.operators import behaviour, blocklist, decide, inspect, retention, sampling
from flowlake.plans import fixtures as fx
from flowlake.plans.q_clean import DECISIONS_SQL
from flowlake.plans.q_traffic import HISTORY_SQL
from flowlake.plans.registry import register

AS_OF = f"TIMESTAMP '{fx.AS_OF_TEXT}'"

# ----------------------------------------------------------------------- joins

LIVE_SQL = f"""
, live AS (SELECT ip_address, arg_max(risk_level, (created_at, source)) AS block_risk FROM v_blocklist
    WHERE is_active AND (expires_at IS NULL OR expires_at >= {AS_OF}) GROUP BY ip_address)"""
MATCH_SQL = LIVE_SQL + """
, matched AS (SELECT p.*, coalesce(s.ip_address, d.ip_address) AS blocked_ip,
    CASE WHEN s.ip_address IS NOT NULL THEN 'src' WHEN d.ip_address IS NOT NULL THEN 'dst' END AS blocked_side,
    coalesce(s.block_risk, d.block_risk) AS block_risk
  FROM v_packets p LEFT JOIN live s ON p.src_ip = s.ip_address LEFT JOIN live d ON p.dst_ip = d.ip_address)"""


def _matched(spark, sf):
    return blocklist.blocklist_match(fx.v_packets(spark, sf), fx.v_blocklist(spark, sf), fx.as_of())


@register("j1_blocklist_match", fx.with_views("v_packets", "v_blocklist", body="") + MATCH_SQL + " SELECT packet_id, blocked_ip, blocked_side, block_risk FROM matched")
def j1(spark, sf):
    return _matched(spark, sf).select("packet_id", "blocked_ip", "blocked_side", "block_risk")


@register(
    "j2_trusted_suppression",
    fx.with_views("v_flows", "v_trusted", body="SELECT * FROM v_flows WHERE src_ip NOT IN (SELECT ip FROM v_trusted) AND dst_ip NOT IN (SELECT ip FROM v_trusted)"),
)
def j2(spark, sf):
    return blocklist.trusted_suppression(fx.v_flows(spark, sf), fx.v_trusted(spark, sf))


@register(
    "j3_packet_drop",
    fx.with_views("v_packets", "v_blocklist", body="SELECT packet_id, src_ip FROM v_packets WHERE src_ip NOT IN (SELECT ip_address FROM v_blocklist WHERE is_active)"),
)
def j3(spark, sf):
    active = fx.v_blocklist(spark, sf).filter("is_active")
    return blocklist.packet_drop(fx.v_packets(spark, sf), active).select("packet_id", "src_ip")


_HITS_SQL = """
, hits AS (SELECT blocked_ip AS ip_address, count(*) AS hits, max(ts) AS last_hit FROM matched WHERE blocked_ip IS NOT NULL GROUP BY 1)"""


@register("g7_hit_counts", fx.with_views("v_packets", "v_blocklist", body="") + MATCH_SQL + _HITS_SQL + " SELECT * FROM hits")
def g7(spark, sf):
    return blocklist.hit_counts(_matched(spark, sf))


@register(
    "j4_hit_count_merge",
    fx.with_views("v_packets", "v_blocklist", body="") + MATCH_SQL + _HITS_SQL + """
SELECT b.ip_address, b.source, b.hit_count + coalesce(h.hits, 0) AS hit_count, greatest(h.last_hit, b.last_seen) AS last_seen
FROM v_blocklist b LEFT JOIN hits h USING (ip_address)""",
)
def j4(spark, sf):
    out = blocklist.hit_count_merge(fx.v_blocklist(spark, sf), blocklist.hit_counts(_matched(spark, sf)))
    return out.select("ip_address", "source", "hit_count", "last_seen")


# ------------------------------------------------------------ blocklist upkeep


@register(
    "g6_blocklist_stats",
    fx.with_views(
        "v_blocklist",
        body=f"""SELECT count(*) AS total_entries, count(*) FILTER (WHERE is_active) AS active_entries,
  count(*) FILTER (WHERE NOT is_active AND expires_at < {AS_OF}) AS expired_entries FROM v_blocklist""",
    ),
)
def g6(spark, sf):
    return blocklist.stats(fx.v_blocklist(spark, sf), fx.as_of())


@register(
    "o1_list_blocklist",
    fx.with_views("v_blocklist", body="SELECT * FROM v_blocklist WHERE is_active AND risk_level = 'high' AND source = 'prediction' ORDER BY created_at DESC, ip_address, source LIMIT 100"),
)
def o1(spark, sf):
    return blocklist.listing(fx.v_blocklist(spark, sf), True, "high", "prediction", 100)


@register(
    "o2_recent_blocks",
    fx.with_views("v_blocklist", body="SELECT ip_address, reason, risk_level, source, created_at, hit_count FROM v_blocklist WHERE is_active ORDER BY created_at DESC, ip_address, source LIMIT 15"),
)
def o2(spark, sf):
    return blocklist.recent_blocks(fx.v_blocklist(spark, sf))


def _incoming(spark, sf):
    """Insertions derived from packets: many per source, some invalid."""
    p = fx.v_packets(spark, sf)
    return p.select(
        F.when(F.col("packet_id") % 37 == 0, "not-an-ip").otherwise(F.col("src_ip")).alias("ip_address"),
        F.concat(F.lit("seen "), F.col("protocol")).alias("reason"),
        F.when(F.col("packet_id") % 2 == 0, "prediction").otherwise("manual").alias("source"),
        F.when(F.col("packet_id") % 41 == 0, "extreme").when(F.col("packet_size") > 200, "high").otherwise("medium").alias("risk_level"),
        F.when(F.col("packet_id") % 3 == 0, 24).cast("int").alias("ttl_hours"),
        F.lit(None).cast("string").alias("metadata"),
        F.col("packet_id").alias("seq"),
    )


UPSERT_SQL = f"""
, incoming AS (SELECT src_ip AS ip_address, 'seen ' || protocol AS reason, CASE WHEN packet_id % 2 = 0 THEN 'prediction' ELSE 'manual' END AS source,
    CASE WHEN packet_size > 200 THEN 'high' ELSE 'medium' END AS risk_level, {AS_OF} AS created_at,
    CASE WHEN packet_id % 3 = 0 THEN {AS_OF} + INTERVAL 24 HOUR END AS expires_at, true AS is_active,
    CAST(0 AS BIGINT) AS hit_count, packet_id AS seq FROM v_packets WHERE packet_id % 37 <> 0 AND packet_id % 41 <> 0)
, upserted AS (SELECT * EXCLUDE (seq) FROM (SELECT * FROM incoming UNION ALL
    SELECT ip_address, reason, source, risk_level, created_at, expires_at, is_active, hit_count, -1 FROM v_blocklist)
  QUALIFY row_number() OVER (PARTITION BY ip_address, source ORDER BY seq DESC) = 1)"""


@register("r1_blocklist_upsert", fx.with_views("v_packets", "v_blocklist", body="") + UPSERT_SQL + " SELECT * FROM upserted")
def r1(spark, sf):
    out = blocklist.upsert(fx.v_blocklist(spark, sf), _incoming(spark, sf), fx.as_of())
    return out.drop("enforcement_action", "last_seen", "metadata")


@register(
    "r2_blocklist_deactivate",
    fx.with_views("v_blocklist", "v_trusted", body="""SELECT ip_address, source,
  is_active AND NOT (source = 'prediction' AND ip_address IN (SELECT ip FROM v_trusted)) AS is_active FROM v_blocklist"""),
)
def r2(spark, sf):
    removals = fx.v_trusted(spark, sf).select(F.col("ip").alias("ip_address"), F.lit("prediction").alias("source"))
    return blocklist.deactivate(fx.v_blocklist(spark, sf), removals).select("ip_address", "source", "is_active")


@register(
    "r3_blocklist_expire",
    fx.with_views("v_blocklist", body=f"SELECT ip_address, source, is_active AND NOT coalesce(expires_at < {AS_OF}, false) AS is_active FROM v_blocklist"),
)
def r3(spark, sf):
    return blocklist.expire(fx.v_blocklist(spark, sf), fx.as_of()).select("ip_address", "source", "is_active")


@register("r3_expired_count", fx.with_views("v_blocklist", body=f"SELECT count(*) FILTER (WHERE is_active AND expires_at < {AS_OF}) AS cleaned FROM v_blocklist"))
def r3_count(spark, sf):
    return blocklist.expired_count(fx.v_blocklist(spark, sf), fx.as_of())


@register("r4_retention_purge", fx.with_views("v_packets", body=f"SELECT packet_id, ts, src_ip FROM v_packets WHERE ts >= {AS_OF} - INTERVAL 24 HOUR"))
def r4(spark, sf):
    return retention.purge(fx.v_packets(spark, sf), "ts", fx.as_of(), 24).select("packet_id", "ts", "src_ip")


@register(
    "r4_purge_proof",
    fx.with_views(
        "v_packets", "v_flows", "v_blocklist",
        body=f"""SELECT * FROM (
  SELECT 'flows' AS table_name, 'timestamp' AS timestamp_column, 24 AS age_threshold_hours, count(*) AS rows_before,
    count(*) FILTER (WHERE "timestamp" < {AS_OF} - INTERVAL 24 HOUR) AS records_deleted, sha256('flowstimestamp24{fx.AS_OF_TEXT}') AS deletion_hash FROM v_flows
  UNION ALL SELECT 'packets', 'ts', 24, count(*), count(*) FILTER (WHERE ts < {AS_OF} - INTERVAL 24 HOUR), sha256('packetsts24{fx.AS_OF_TEXT}') FROM v_packets
  UNION ALL SELECT 'threat_indicators', 'created_at', 24, count(*), count(*) FILTER (WHERE created_at < {AS_OF} - INTERVAL 24 HOUR), sha256('threat_indicatorscreated_at24{fx.AS_OF_TEXT}') FROM v_blocklist
  UNION ALL SELECT 'audit_log', 'ts', 2160, count(*), count(*) FILTER (WHERE ts < {AS_OF} - INTERVAL 2160 HOUR), sha256('audit_logts2160{fx.AS_OF_TEXT}') FROM v_packets
) WHERE records_deleted > 0""",
    ),
)
def r4_proof(spark, sf):
    packets = fx.v_packets(spark, sf)
    tables = {
        "flows": (fx.v_flows(spark, sf), "timestamp"),
        "packets": (packets, "ts"),
        "threat_indicators": (fx.v_blocklist(spark, sf), "created_at"),
        "audit_log": (packets, "ts"),
    }
    return retention.purge_proof(tables, fx.as_of(), 24)


@register(
    "r5_retention_check",
    fx.with_views("v_packets", body=f"SELECT count(*) FILTER (WHERE ts < {AS_OF} - INTERVAL 24 HOUR) AS old_rows, count(*) FILTER (WHERE ts < {AS_OF} - INTERVAL 24 HOUR) = 0 AS passed FROM v_packets"),
)
def r5(spark, sf):
    return retention.retention_check(fx.v_packets(spark, sf), "ts", fx.as_of())


@register(
    "r6_trust_add",
    fx.with_views("v_trusted", "v_packets", body="SELECT ip FROM v_trusted UNION SELECT src_ip FROM v_packets WHERE packet_size > 300"),
)
def r6(spark, sf):
    reported = fx.v_packets(spark, sf).filter("packet_size > 300").select(F.col("src_ip").alias("ip"), F.lit("reported").alias("reason"))
    return blocklist.trust_add(fx.v_trusted(spark, sf), reported, fx.as_of()).select("ip")


# ------------------------------------------------------------------ inspectors

_BIN = "CAST(encode(payload) AS BLOB)"
EMAIL_SQL = r"len(regexp_extract_all(payload, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'))"
PHONE_SQL = r"len(regexp_extract_all(payload, '\b[0-9]{10}\b'))"
NON_PRINTABLE_SQL = r"(strlen(payload) - length(regexp_replace(payload, '[^\x20-\x7e]', '', 'g')))"


def _payloads(spark, sf):
    return fx.v_payloads(spark, sf)


def _text():
    return inspect.byte_text(F.col("payload"))


@register(
    "i1_pii_inspector",
    fx.with_views(
        "v_payloads",
        body=f"""SELECT id, kind, 'GDPR_PII_LEAK' AS alert, concat_ws(', ', CASE WHEN e > 0 THEN 'Emails found: ' || e END,
  CASE WHEN p > 0 THEN 'Phones found: ' || p END) AS details
FROM (SELECT *, {EMAIL_SQL} AS e, {PHONE_SQL} AS p FROM v_payloads) WHERE e > 0 OR p > 0""",
    ),
)
def i1(spark, sf):
    found = _payloads(spark, sf).select("id", "kind", inspect.pii(_text()).alias("r"))
    return found.filter("r IS NOT NULL").select("id", "kind", "r.alert", "r.details")


def _medical(spark, sf):
    """Documents with a medical header in front, keywords by document number."""
    d = _payloads(spark, sf)
    words = F.concat_ws(
        " ",
        *[F.when(F.col("id") % (i + 2) == 0, F.lit(k)) for i, k in enumerate(inspect.MEDICAL_KEYWORDS)],
    )
    head = F.when(F.col("id") % 3 == 0, F.lit("DICM ")).otherwise("")
    return d.withColumn("payload", F.concat(head, words, F.lit(" "), F.col("payload")))


_PHI_SCORE = " + ".join(
    f"CASE WHEN id % {i + 2} = 0 THEN {w} ELSE 0 END" for i, w in enumerate(inspect.MEDICAL_KEYWORDS.values())
)


@register(
    "i2_phi_inspector",
    fx.with_views(
        "v_payloads",
        body=f"""SELECT id, kind, CASE WHEN s > 0 THEN 'PHI_LEAK' END AS alert,
  CASE WHEN s > 15 THEN 'CRITICAL' WHEN s > 0 THEN 'WARNING' END AS threat_level, CASE WHEN s > 0 THEN s END AS score
FROM (SELECT id, kind, {_PHI_SCORE} AS s FROM v_payloads WHERE id % 3 = 0 OR contains(payload, 'DICM'))""",
    ),
)
def i2(spark, sf):
    found = _medical(spark, sf).select("id", "kind", inspect.phi(_text()).alias("r"))
    return found.filter("r IS NOT NULL").select("id", "kind", "r.alert", "r.threat_level", "r.score")


@register(
    "i3_shell_command_trap",
    fx.with_views(
        "v_payloads",
        body="""SELECT id, kind, array_to_string(list_filter(['sh', 'wget', 'curl', '/bin/bash', 'cat /etc/passwd'], lambda c: contains(payload, c)), ', ') AS commands
FROM v_payloads WHERE contains(payload, 'sh') OR contains(payload, 'wget') OR contains(payload, 'curl')
  OR contains(payload, '/bin/bash') OR contains(payload, 'cat /etc/passwd')""",
    ),
)
def i3(spark, sf):
    found = _payloads(spark, sf).select("id", "kind", inspect.shell_commands(_text()).alias("r"))
    return found.filter("r IS NOT NULL").select("id", "kind", F.col("r.details").alias("commands"))


def _requests(spark, sf):
    """Request lines in front of the payloads, some aimed at decoys or carrying threats."""
    paths = [p for p, _ in inspect.DECOYS] + ["/index.html", "/a?q=<script>", "/../etc/passwd", "/x UNION SELECT 1"]
    table = F.array(*[F.lit(p) for p in paths])
    path = F.element_at(table, (F.col("id") % len(paths) + 1).cast("int"))
    verb = F.when(F.col("id") % 2 == 0, "GET ").otherwise("POST ")
    rest = F.when(F.col("id") % 4 < 2, "").otherwise(F.col("payload"))
    return _payloads(spark, sf).withColumn("payload", F.concat(verb, path, F.lit(" HTTP/1.1 "), rest))


REQUESTS_SQL = (
    ", req AS (SELECT id, kind, CASE WHEN id % 2 = 0 THEN 'GET ' ELSE 'POST ' END || ["
    + ", ".join("'" + p + "'" for p in [p for p, _ in inspect.DECOYS] + ["/index.html", "/a?q=<script>", "/../etc/passwd", "/x UNION SELECT 1"])
    + "][id % 10 + 1] || ' HTTP/1.1 ' || CASE WHEN id % 4 < 2 THEN '' ELSE payload END AS payload FROM v_payloads)"
)
_DECOY_CASE = "CASE " + " ".join(f"WHEN contains(payload, '{p}') THEN '{t}: {p}'" for p, t in inspect.DECOYS) + " END"


@register("i4_decoy_path_trap", fx.with_views("v_payloads", body="") + REQUESTS_SQL + f" SELECT id, kind, {_DECOY_CASE} AS details FROM req WHERE {_DECOY_CASE} IS NOT NULL")
def i4(spark, sf):
    found = _requests(spark, sf).select("id", "kind", inspect.decoy_paths(_text()).alias("r"))
    return found.filter("r IS NOT NULL").select("id", "kind", "r.details")


def _handshakes(spark, sf):
    """Payload bytes with key-exchange signatures appended by number."""
    n = len(inspect.PQC_SIGNATURES)
    tail = F.lit(b"")
    for i, (sig, _) in enumerate(inspect.PQC_SIGNATURES):
        tail = F.concat(tail, F.when(F.col("id") % (n + i) == 0, F.lit(sig)).otherwise(F.lit(b"")))
    return _payloads(spark, sf).withColumn("payload", F.concat(F.col("payload").cast("binary"), tail))


_PQC_LIST = "[" + ", ".join(
    f"CASE WHEN id % {len(inspect.PQC_SIGNATURES) + i} = 0" + (f" OR contains(payload, '{sig.decode()}')" if sig.isascii() and sig.isalnum() else "") + f" THEN '{name}' END"
    for i, (sig, name) in enumerate(inspect.PQC_SIGNATURES)
) + "]"


@register(
    "i5_pqc_inspector",
    fx.with_views(
        "v_payloads",
        body=f"""SELECT id, kind, array_to_string(names, ', ') AS algorithms FROM (
  SELECT id, kind, list_sort(list_distinct(list_filter({_PQC_LIST}, lambda x: x IS NOT NULL))) AS names FROM v_payloads) WHERE len(names) > 0""",
    ),
)
def i5(spark, sf):
    found = _handshakes(spark, sf).select("id", "kind", inspect.pqc(_text()).alias("r"))
    return found.filter("r IS NOT NULL").select("id", "kind", F.col("r.details").alias("algorithms"))


@register(
    "i6_high_entropy",
    fx.with_views(
        "v_payloads",
        body=f"""SELECT id, kind, strlen(payload) AS n_bytes, {NON_PRINTABLE_SQL} AS non_printable,
  strlen(payload) > 128 AND {NON_PRINTABLE_SQL} / CAST(strlen(payload) AS DOUBLE) > 0.4 AS high_entropy FROM v_payloads""",
    ),
)
def i6(spark, sf):
    text = F.col("text")
    return _payloads(spark, sf).withColumn("text", _text()).select(
        "id", "kind", F.length(text).alias("n_bytes"), inspect.non_printable(text).alias("non_printable"),
        inspect.high_entropy(text).isNotNull().alias("high_entropy"),
    )


@register(
    "i7_drill_marker",
    fx.with_views("v_payloads", body="SELECT id, kind FROM v_payloads WHERE id % 9 = 0 OR contains(payload, 'RedTeam-XSS-Probe')"),
)
def i7(spark, sf):
    marked = F.concat(F.col("payload"), F.when(F.col("id") % 9 == 0, "<b>RedTeam-XSS-Probe</b>").otherwise(""))
    found = _payloads(spark, sf).withColumn("payload", marked).filter(inspect.drill_marker(_text()).isNotNull())
    return found.select("id", "kind")


FINDINGS_SQL = f"""
, found AS (
  SELECT id, kind, 'pii' AS inspector FROM v_payloads WHERE {EMAIL_SQL} > 0 OR {PHONE_SQL} > 0
  UNION ALL SELECT id, kind, 'phi' FROM v_payloads WHERE contains(payload, 'DICM')
  UNION ALL SELECT id, kind, 'shell_commands' FROM v_payloads WHERE contains(payload, 'sh') OR contains(payload, 'wget')
    OR contains(payload, 'curl') OR contains(payload, '/bin/bash') OR contains(payload, 'cat /etc/passwd')
  UNION ALL SELECT id, kind, 'decoy_paths' FROM v_payloads WHERE {_DECOY_CASE} IS NOT NULL
  UNION ALL SELECT id, kind, 'pqc' FROM v_payloads WHERE contains(payload, 'x25519_kyber768') OR contains(payload, 'p256_kyber768')
    OR contains(payload, 'dilithium') OR contains(payload, 'falcon')
  UNION ALL SELECT id, kind, 'high_entropy' FROM v_payloads WHERE strlen(payload) > 128
    AND {NON_PRINTABLE_SQL} / CAST(strlen(payload) AS DOUBLE) > 0.4
  UNION ALL SELECT id, kind, 'drill_marker' FROM v_payloads WHERE contains(payload, 'RedTeam-XSS-Probe'))"""


@register("i8_run_inspectors", fx.with_views("v_payloads", body="") + FINDINGS_SQL + " SELECT id, kind, inspector FROM found")
def i8(spark, sf):
    inspected = inspect.InspectorRegistry().run(_payloads(spark, sf))
    return inspect.findings(inspected, "id", "kind").select("id", "kind", "inspector")


@register("g19_inspector_hits", fx.with_views("v_payloads", body="") + FINDINGS_SQL + " SELECT inspector, count(*) AS hits FROM found GROUP BY inspector")
def g19(spark, sf):
    return inspect.inspector_hits(inspect.InspectorRegistry().run(_payloads(spark, sf)))


def _count_sql(patterns) -> str:
    return " + ".join(f"CAST(contains(low, '{p.lower()}') AS INTEGER)" for p in patterns)


def _base():
    return F.col("id") % 100 / 100.0


SCORE_A_SQL = f"""
, low_a AS (SELECT *, CAST(id % 100 AS DOUBLE) / 100.0 AS base, translate(payload, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM req)
, tot_a AS (SELECT *, base + least(({_count_sql(inspect.PATTERNS_A)}) * CAST(0.35 AS DOUBLE), CAST(0.6 AS DOUBLE)) AS total,
    (starts_with(payload, 'GET /') OR starts_with(payload, 'POST /') OR starts_with(payload, 'PUT /') OR starts_with(payload, 'HEAD /'))
    AND NOT ({" OR ".join(f"contains(low, '{p}')" for p in inspect.PATTERNS_A)}) AS clean FROM low_a)
, score_a AS (SELECT id, kind, payload, greatest(0.0, least(CASE WHEN clean AND total < 0.8 THEN least(total, CAST(0.05 AS DOUBLE)) ELSE total END, 1.0)) AS score FROM tot_a)"""


@register("i9_signature_score_a", fx.with_views("v_payloads", body="") + REQUESTS_SQL + SCORE_A_SQL + " SELECT id, kind, round(score, 6) AS score FROM score_a")
def i9(spark, sf):
    score = inspect.signature_score_a(_base(), F.col("payload"))
    return _requests(spark, sf).select("id", "kind", F.round(score, 6).alias("score"))


_RISKY = " OR ".join("contains(payload, '" + c.replace("'", "''") + "')" for c in inspect.RISKY_CHARS_B)
SCORE_B_SQL = f"""
, low_b AS (SELECT *, CAST(id % 100 AS DOUBLE) / 100.0 AS base, translate(payload, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM req)
, tot_b AS (SELECT *, base + ({_count_sql(inspect.PATTERNS_B)}) * CAST(0.5 AS DOUBLE) AS total,
    (starts_with(payload, 'GET /') OR starts_with(payload, 'POST /')) AND NOT ({_RISKY}) AS clean FROM low_b)
SELECT id, kind, round(least(greatest(CASE WHEN clean AND total < 1.0 THEN least(total, CAST(0.1 AS DOUBLE)) ELSE total END, 0.0), 1.0), 6) AS score FROM tot_b"""


@register("i10_signature_score_b", fx.with_views("v_payloads", body="") + REQUESTS_SQL + SCORE_B_SQL)
def i10(spark, sf):
    score = inspect.signature_score_b(_base(), F.col("payload"))
    return _requests(spark, sf).select("id", "kind", F.round(score, 6).alias("score"))


VERDICT_SQL = """
, v AS (SELECT a.id, a.kind, a.score, CASE WHEN a.score > 0.5 OR f.id IS NOT NULL THEN 'BLOCK' ELSE 'VERIFIED' END AS verdict
  FROM score_a a LEFT JOIN (SELECT DISTINCT id, kind FROM found WHERE inspector IN ('pii', 'shell_commands', 'decoy_paths', 'pqc', 'high_entropy')) f
    ON a.id = f.id AND a.kind = f.kind)"""


def _verdicts(spark, sf):
    inspected = inspect.InspectorRegistry().run(_requests(spark, sf))
    scored = inspected.withColumn("score", inspect.signature_score_a(_base(), F.col("payload")))
    return scored.withColumn("verdict", inspect.request_verdict(F.col("score"), F.col("findings")))


_FOUND_REQ = FINDINGS_SQL.replace("v_payloads", "req")


@register("i11_request_verdict", fx.with_views("v_payloads", body="") + REQUESTS_SQL + SCORE_A_SQL + _FOUND_REQ + VERDICT_SQL + " SELECT id, kind, verdict FROM v")
def i11(spark, sf):
    return _verdicts(spark, sf).select("id", "kind", "verdict")


@register(
    "g20_verdict_rollup",
    fx.with_views("v_payloads", body="") + REQUESTS_SQL + SCORE_A_SQL + _FOUND_REQ + VERDICT_SQL + """
SELECT count(*) FILTER (WHERE verdict <> 'BLOCK') AS verified, count(*) FILTER (WHERE score > 0.3 AND score <= 0.5) AS warnings,
  count(*) FILTER (WHERE verdict = 'BLOCK') AS blocked FROM v""",
)
def g20(spark, sf):
    return inspect.verdict_rollup(_verdicts(spark, sf))


# ------------------------------------------------------------------- decisions


def _features(spark, sf):
    startup = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return behaviour.router_features(fx.v_scores(spark, sf), startup)


@register(
    "e1_router_features",
    fx.with_views("v_scores", body="") + HISTORY_SQL + """
SELECT packet_id, if_score, ip_score_delta, 1 AS ip_seen_before, ip_flow_count, CAST(hour(ts) AS INTEGER) AS hour_of_day,
  CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(hour(ts) < 6 AS INTEGER) AS is_night,
  CAST(hour(ts) >= 8 AND hour(ts) < 18 AND isodow(ts) <= 5 AS INTEGER) AS is_business_hours,
  CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') < 120000000 AS INTEGER) AS in_boot_window,
  interval_raw, CASE WHEN mean_interval > 0 THEN interval_raw - mean_interval ELSE 0.0 END AS interval_delta,
  is_burst, is_slow, is_periodic, CASE protocol WHEN 'TCP' THEN 1 WHEN 'UDP' THEN 2 ELSE 3 END AS protocol,
  dst_port, CAST(payload_available AS INTEGER) AS payload_available FROM history""",
)
def e1(spark, sf):
    from flowlake.schemas import ROUTER_FEATURES

    out = _features(spark, sf).withColumn("ip_score_delta", F.round("ip_score_delta", 10))
    return out.select("packet_id", *ROUTER_FEATURES)


# Score thresholds inside the range the fixture's scores cover.
CLEAR, CRITICAL = -0.3, -0.8
ROUTES_SQL = HISTORY_SQL + """
, r0 AS (SELECT *, CASE WHEN pos > 20 AND mean_score > -0.3 AND if_score > -0.3 THEN 'pass' WHEN if_score > -0.3 THEN 'if_only'
    WHEN if_score <= -0.8 THEN 'escalate' WHEN payload_available THEN 'escalate' ELSE 'if_only' END AS p0,
  CASE WHEN pos > 20 AND mean_score > -0.3 AND if_score > -0.3 THEN 0.75 WHEN if_score > -0.3 THEN 0.8
    WHEN if_score <= -0.8 THEN 0.9 WHEN payload_available THEN 0.65 ELSE 0.6 END AS c0 FROM history)
, routes AS (SELECT *, CASE WHEN p0 = 'escalate' AND NOT payload_available THEN 'if_only' ELSE p0 END AS path,
    CASE WHEN p0 = 'escalate' AND NOT payload_available THEN c0 * 0.8 ELSE c0 END AS confidence FROM r0)"""


def _route_columns(spark, sf):
    h = behaviour.source_history(fx.v_scores(spark, sf))
    route = decide.route_rules(
        F.col("if_score"), F.col("mean_score"), F.col("ip_flow_count"), F.col("payload_available"), CLEAR, CRITICAL
    )
    return h.withColumn("r", route)


@register("e2_route_rules", fx.with_views("v_scores", body="") + ROUTES_SQL + " SELECT packet_id, p0 AS path, CAST(c0 AS DOUBLE) AS confidence FROM routes")
def e2(spark, sf):
    return _route_columns(spark, sf).select("packet_id", "r.path", "r.confidence")


@register("e3_route_downgrade", fx.with_views("v_scores", body="") + ROUTES_SQL + " SELECT packet_id, path, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM routes")
def e3(spark, sf):
    down = decide.route_downgrade(F.col("r"), F.col("payload_available"))
    return _route_columns(spark, sf).select("packet_id", down.alias("d")).select("packet_id", "d.path", F.round("d.confidence", 6).alias("confidence"))


# A payload score by number, a base prediction by score.
_MERGE_SQL = ROUTES_SQL + """
, s AS (SELECT *, CASE WHEN path = 'escalate' THEN CAST(packet_id % 10 AS DOUBLE) / 10 END AS ps,
    CASE WHEN if_score < -0.25 THEN -1 ELSE 1 END AS p FROM routes)
, merged AS (SELECT *, CASE WHEN path = 'pass' OR (path = 'escalate' AND ps < 0.3) THEN 1 WHEN path = 'escalate' AND ps >= 0.65 THEN -1 ELSE p END AS prediction,
    path = 'pass' OR (path = 'escalate' AND ps < 0.3) AS skip_enforcement FROM s)"""


def _merged(spark, sf):
    down = decide.route_downgrade(F.col("r"), F.col("payload_available"))
    routed = _route_columns(spark, sf).withColumn("path", down["path"])
    scored = routed.withColumns(
        {
            "payload_score": F.when(F.col("path") == "escalate", (F.col("packet_id") % 10) / 10.0),
            "prediction": F.when(F.col("if_score") < -0.25, -1).otherwise(1),
        }
    )
    return decide.verdict_merge(scored)


@register("e5_verdict_merge", fx.with_views("v_scores", body="") + _MERGE_SQL + " SELECT packet_id, prediction, skip_enforcement FROM merged")
def e5(spark, sf):
    return _merged(spark, sf).select("packet_id", "prediction", "skip_enforcement")


ACTIONS_SQL = LIVE_SQL + _MERGE_SQL + """
, a0 AS (SELECT m.*, s.ip_address AS s_ip, d.ip_address AS d_ip,
    CASE WHEN abs(if_score) >= 0.9 THEN 'critical' WHEN abs(if_score) >= 0.7 THEN 'high' WHEN abs(if_score) >= 0.35 THEN 'medium' ELSE 'low' END AS risk_level
  FROM merged m LEFT JOIN live s ON m.src_ip = s.ip_address LEFT JOIN live d ON m.dst_ip = d.ip_address
  WHERE NOT skip_enforcement AND src_ip NOT IN (SELECT ip FROM v_trusted) AND dst_ip NOT IN (SELECT ip FROM v_trusted))
, actions AS (SELECT *, CASE WHEN s_ip IS NOT NULL THEN 'Source IP ' || src_ip || ' is blacklisted'
    WHEN d_ip IS NOT NULL THEN 'Destination IP ' || dst_ip || ' is blacklisted'
    WHEN risk_level IN ('high', 'critical') THEN 'High-risk anomaly: size (score: ' || sc || ', risk: ' || risk_level || ')'
    ELSE 'Anomaly detected: size (score: ' || sc || ')' END AS action_reason
  FROM (SELECT *, '-0.500' AS sc FROM a0) WHERE prediction = -1 OR s_ip IS NOT NULL OR d_ip IS NOT NULL)"""


def _actions(spark, sf):
    flows = _merged(spark, sf).withColumns(
        {
            "anomaly_score": F.lit(-0.5),
            "risk_level": encode.risk_level(F.col("if_score")),
            "explanation": F.lit("size"),
            "bytes_in": F.col("packet_size"),
            "bytes_out": F.lit(0).cast("long"),
        }
    )
    return decide.enforcement(flows, fx.v_blocklist(spark, sf), fx.v_trusted(spark, sf), fx.as_of())


_ACTION_VIEWS = fx.with_views("v_scores", "v_blocklist", "v_trusted", body="")


@register("e6_enforcement_decision", _ACTION_VIEWS + ACTIONS_SQL + " SELECT packet_id, src_ip, risk_level, action_reason FROM actions")
def e6(spark, sf):
    return _actions(spark, sf).select("packet_id", "src_ip", "risk_level", "action_reason")


@register(
    "e7_enforcement_to_blocklist",
    _ACTION_VIEWS + ACTIONS_SQL + """
, best AS (SELECT src_ip AS ip_address, 'prediction: ' || action_reason AS reason, 'prediction' AS source, risk_level FROM actions
    QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC, packet_id DESC) = 1)
SELECT ip_address, reason, source, risk_level, true AS is_active FROM best
UNION ALL SELECT ip_address, reason, source, risk_level, is_active FROM v_blocklist
  WHERE NOT (source = 'prediction' AND ip_address IN (SELECT ip_address FROM best))""",
)
def e7(spark, sf):
    incoming = decide.to_blocklist(_actions(spark, sf), ["ts", "packet_id"])
    out = blocklist.upsert(fx.v_blocklist(spark, sf), incoming, fx.as_of())
    return out.select("ip_address", "reason", "source", "risk_level", "is_active")


@register(
    "m9_router_label",
    fx.with_views("v_scores", body="") + _MERGE_SQL + """
SELECT label, count(*) AS n FROM (SELECT CASE WHEN ps IS NULL THEN 1 WHEN p = 1 AND ps < 0.65 THEN 0
  WHEN (p = -1) = (ps >= 0.65) THEN 1 ELSE 2 END AS label FROM s) GROUP BY label""",
)
def m9(spark, sf):
    merged = _merged(spark, sf)
    verdict = F.when(F.col("if_score") < -0.25, -1).otherwise(1)
    labelled = merged.select(decide.router_label(verdict, F.col("payload_score")).alias("label"))
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register(
    "m11_rule_label_bootstrap",
    fx.with_views("v_scores", body="") + HISTORY_SQL + """
SELECT packet_id, CASE WHEN ip_flow_count > 20 AND if_score - mean_score > -0.2 AND if_score > -0.2 THEN 0 WHEN if_score > -0.2 THEN 1
  WHEN if_score <= -0.7 THEN 2 WHEN payload_available THEN 2 ELSE 1 END AS label FROM history""",
)
def m11(spark, sf):
    f = _features(spark, sf)
    return f.select("packet_id", decide.rule_label(f).alias("label"))


# ----------------------------------------------------- explanations and samples

_STATS = {"packet_size": (150.0, 40.0), "dst_port": (1000.0, 900.0), "src_port": (40000.0, 100.0), "constant": (1.0, 0.0)}
_Z = {
    "packet_size": "(packet_size - 150.0) / 40.0",
    "dst_port": "(dst_port - 1000.0) / 900.0",
    "src_port": "(src_port - 40000.0) / 100.0",
    "constant": "0.0",
}
_Z_LIST = ", ".join(f"{{'r': -abs(CAST({z} AS DOUBLE)), 'i': {i}, 'n': '{n}', 'z': CAST({z} AS DOUBLE)}}" for i, (n, z) in enumerate(_Z.items()))


@register(
    "o3_topk_explanation",
    fx.with_views(
        "v_packets",
        body=f"""SELECT packet_id, array_to_string(list_transform(list_slice(list_sort([{_Z_LIST}]), 1, 3),
  lambda e: e.n || ' (' || CASE WHEN e.z >= 0 THEN '+' ELSE '' END || printf('%.1f', e.z) || 'σ)'), ', ') AS explanation FROM v_packets""",
    ),
)
def o3(spark, sf):
    values = {**{c: F.col(c) for c in ("packet_size", "dst_port", "src_port")}, "constant": F.lit(7)}
    return fx.v_packets(spark, sf).select("packet_id", decide.top_deviations(values, _STATS).alias("explanation"))


@register(
    "o4_sample_cap",
    "SELECT event_id FROM events ORDER BY md5('42|' || event_id) LIMIT 500",
)
def o4(spark, sf):
    return sampling.sample_cap(fx.table(spark, sf, "events"), 500, ["event_id"]).select("event_id")


@register(
    "o5_train_test_split",
    """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || event_id)) <= ceil(round(count(*) OVER () * 0.2, 9)) THEN 'test' ELSE 'train' END AS split FROM events""",
)
def o5(spark, sf):
    return sampling.train_test_split(fx.table(spark, sf, "events"), ["event_id"]).select("event_id", "split")


@register(
    "o5_stratified_split",
    """SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id)) <=
  ceil(round(count(*) OVER (PARTITION BY event_type) * 0.2, 9)) THEN 'test' ELSE 'train' END AS split FROM events""",
)
def o5_stratified(spark, sf):
    out = sampling.train_test_split(fx.table(spark, sf, "events"), ["event_id"], strata=["event_type"])
    return out.select("event_id", "split")


@register(
    "x1_python_inspector",
    fx.with_views("v_payloads", body="SELECT id, kind, strlen(payload) AS score FROM v_payloads WHERE strlen(payload) % 2 = 0 AND NOT contains(payload, '@')"),
)
def x1_python(spark, sf):
    """A Python rule that fails on some payloads: those count as clean."""

    def even_length(payload: bytes):
        if b"@" in payload:
            raise ValueError("cannot judge")
        return {"info": "even", "score": len(payload)} if len(payload) % 2 == 0 else None

    registry = inspect.InspectorRegistry({"even_length": inspect.python_inspector(even_length)})
    return inspect.findings(registry.run(_payloads(spark, sf)), "id", "kind").select("id", "kind", "score")


@register(
    "x1_inspector_registry",
    fx.with_views("v_payloads", body="SELECT id, kind, 'long_payload' AS inspector FROM v_payloads WHERE strlen(payload) > 1000"),
)
def x1(spark, sf):
    """A user inspector next to one that fails to build."""
    registry = inspect.InspectorRegistry({})

    def broken(payload):
        raise RuntimeError("inspector bug")

    registry.register("broken", broken)
    registry.register(
        "long_payload", lambda t: F.when(F.length(t) > 1000, inspect._result(info="long", details="over 1000 bytes"))
    )
    return inspect.findings(registry.run(_payloads(spark, sf)), "id", "kind").select("id", "kind", "inspector")
