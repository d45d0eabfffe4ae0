"""DuckDB SQL equal to each registered query (the correctness oracle).

The driver tables are views named after the tables; the domain views of
``trafficscore.plans.views`` are re-derived here as CTEs with the same
rules.  Used by the driver's check and by ``tests/test_oracle.py``.
"""

from __future__ import annotations

from trafficscore.plans import catalog as C
from trafficscore.plans import views as V

ACCESS_LOG = """access_log AS (
  SELECT event_id AS request_id, ts AS "timestamp",
         '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS client_ip,
         CAST(1024 + event_id % 60000 AS VARCHAR) AS src_port,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
         CASE WHEN event_type IN ('view', 'click') THEN '/sensitive-data'
              WHEN event_type = 'error' THEN '/static/x' ELSE '/' END AS path,
         value AS http_body_length, '' AS user_agent, '' AS referer
  FROM events)"""

ACCESS = """access AS (SELECT * FROM access_log WHERE NOT coalesce(starts_with(path, '/static'), false))"""


def _rfm_cte(name: str, src: str, now: str, key: str = "client_ip", monetary: str | None = "http_body_length",
             where: str = "") -> str:
    mon = f",\n         coalesce(sum({monetary}), 0) AS monetary" if monetary else ""
    return f"""{name} AS (
  SELECT {key},
         (epoch_us(TIMESTAMP '{now}') - epoch_us(max("timestamp"))) / 1e6 / 86400 AS recency_days,
         CAST(count("timestamp") AS BIGINT) AS frequency{mon}
  FROM {src} WHERE {key} IS NOT NULL {where} GROUP BY {key})"""


def _avg_pct(v: str) -> str:
    return (f"(rank() OVER (ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {v}) + 1) / 2.0::DOUBLE)"
            f" / count({v}) OVER () * 100")


def _verdict(r="recency_days", f="frequency", m="monetary", kw=None) -> str:
    kw = kw or C.VERDICT_KW
    return (f"CASE WHEN {r} < {kw['max_recency_days']} AND {f} > {kw['freq_pct']} "
            f"THEN coalesce({m} < {kw['low_monetary']} OR {m} > {kw['high_monetary']}, false) "
            f"WHEN {f} <= {kw['freq_pct']} THEN false ELSE true END")


LOOKUP = f"""lookup AS (
  SELECT client_ip, recency_days, {_avg_pct('frequency')} AS frequency, monetary FROM rfm_all
  QUALIFY count(*) OVER (PARTITION BY client_ip) = 1)"""

_OCTET = "CAST(split_part(client_ip, '.', 4) AS INTEGER)"


def _limiter(src: str, window_s: int, where: str = "") -> str:
    """Recursive fold of the anchored limiter (row by row per client)."""
    w = window_s * 1_000_000
    return f"""numbered AS (
  SELECT request_id, client_ip, epoch_us("timestamp") AS us,
         row_number() OVER (PARTITION BY client_ip ORDER BY "timestamp", request_id) AS rn
  FROM {src} WHERE "timestamp" IS NOT NULL {where}),
fold AS (
  SELECT request_id, client_ip, rn, us, us AS ws, CAST(1 AS BIGINT) AS cnt FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.request_id, n.client_ip, n.rn, n.us,
         CASE WHEN n.us - f.ws > {w} THEN n.us ELSE f.ws END,
         CASE WHEN n.us - f.ws > {w} THEN CAST(1 AS BIGINT) ELSE f.cnt + 1 END
  FROM fold f JOIN numbered n ON n.client_ip = f.client_ip AND n.rn = f.rn + 1)"""


def _with(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


SQL: dict[str, str] = {}

SQL["compute_rfm"] = _with(ACCESS_LOG, ACCESS, _rfm_cte("r", "access", V.EVENTS_NOW)) + """
SELECT client_ip, round(recency_days, 9) AS recency_days, frequency, round(monetary, 4) AS monetary FROM r"""

SQL["compute_rfm_no_monetary"] = _with(ACCESS_LOG, ACCESS, _rfm_cte("r", "access", V.EVENTS_NOW, monetary=None)) + """
SELECT client_ip, round(recency_days, 9) AS recency_days, frequency FROM r"""

SQL["customer_rfm"] = _with(
    """activity AS (SELECT o_custkey AS client_id, o_orderdate AS "timestamp",
       CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents FROM orders)""",
    _rfm_cte("r", "activity", V.ORDERS_NOW, key="client_id", monetary="amount_cents")) + """
SELECT client_id, round(recency_days, 9) AS recency_days, frequency, CAST(monetary AS BIGINT) AS monetary FROM r"""

_ck = C.CLASSIFY_KW
SQL["classify_clients"] = _with(ACCESS_LOG, ACCESS, _rfm_cte("r", "access", V.EVENTS_NOW)) + f"""
SELECT client_ip,
  CASE WHEN recency_days < {_ck['low_recency']} AND frequency > {_ck['high_frequency']} THEN
         CASE WHEN monetary < {_ck['low_monetary']} THEN 'DDoS - Flood Attack'
              WHEN monetary > {_ck['high_monetary']} THEN 'DDoS - Amplification Attack'
              ELSE 'Suspicious - Needs Monitoring' END
       WHEN frequency <= {_ck['high_frequency']} THEN 'Legitimate User'
       ELSE 'Uncertain - Possibly Legit or Slow-Rate Attack' END AS label
FROM r"""

SQL["exclude_static"] = _with(ACCESS_LOG, ACCESS) + "SELECT request_id, client_ip, path FROM access"

SQL["average_percentile"] = _with(ACCESS_LOG, ACCESS, _rfm_cte("r", "access", V.EVENTS_NOW)) + f"""
SELECT client_ip, frequency, round({_avg_pct('frequency')}, 9) AS frequency_pct FROM r"""

SQL["suspicion_verdict"] = _with(ACCESS_LOG, ACCESS, _rfm_cte("rfm_all", "access", V.EVENTS_NOW), LOOKUP) + f"""
SELECT client_ip, {_verdict()} AS suspicious FROM lookup"""

SQL["lookup_rfm"] = _with(
    ACCESS_LOG, ACCESS, _rfm_cte("rfm_one", "access", V.EVENTS_NOW),
    f"""rfm_all AS (SELECT * FROM rfm_one WHERE {_OCTET} % 11 <> 0
                UNION ALL SELECT * FROM rfm_one WHERE {_OCTET} % 11 <> 0 AND {_OCTET} % 7 = 0)""",
    LOOKUP) + """
SELECT q.request_id, q.client_ip,
       round(coalesce(l.recency_days, -1), 9) AS recency_days,
       round(coalesce(l.frequency, -1), 9) AS frequency,
       round(coalesce(l.monetary, -1), 4) AS monetary
FROM access_log q LEFT JOIN lookup l ON q.client_ip = l.client_ip
WHERE q.path IN ('/sensitive-data', '/sensitive-data/')"""

SQL["lookup_bucketed"] = SQL["lookup_rfm"]

SQL["lookup_point"] = _with(ACCESS_LOG, ACCESS, _rfm_cte("rfm_all", "access", V.EVENTS_NOW), LOOKUP) + f"""
, one AS (SELECT count(*) AS n, any_value(recency_days) AS r, any_value(frequency) AS f, any_value(monetary) AS m
          FROM lookup WHERE client_ip = '{C.POINT_IP}'),
vals AS (SELECT CASE WHEN n = 1 THEN r ELSE -1 END AS recency_days, CASE WHEN n = 1 THEN f ELSE -1 END AS frequency,
                CASE WHEN n = 1 THEN m ELSE -1 END AS monetary FROM one)
SELECT '{C.POINT_IP}' AS client_ip, round(recency_days, 9) AS recency_days, round(frequency, 9) AS frequency,
       round(monetary, 4) AS monetary, {_verdict()} AS suspicious FROM vals"""

SQL["rate_limit"] = _with(ACCESS_LOG, _limiter("access_log", C.LIMIT_WINDOW_S), recursive=True) + f"""
SELECT request_id, client_ip, make_timestamp(ws) AS window_start, cnt AS request_count,
       cnt > {C.LIMIT_N} AS over_limit FROM fold"""

SQL["rate_limit_subnet"] = "WITH RECURSIVE " + ACCESS_LOG + f""",
subnets AS (SELECT request_id, "timestamp", regexp_extract(client_ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1) || '.0/24' AS client_ip
            FROM access_log),
{_limiter("subnets", C.SUBNET_WINDOW_S)}
SELECT request_id, client_ip AS subnet, make_timestamp(ws) AS window_start, cnt AS request_count,
       cnt > {C.SUBNET_N} AS over_limit FROM fold"""

_unknown = _verdict("-1", "-1", "-1")
SQL["decide_requests"] = _with(
    ACCESS_LOG, ACCESS, _rfm_cte("rfm_all", "access", V.EVENTS_NOW), LOOKUP,
    _limiter("access_log", C.LIMIT_WINDOW_S, where="AND path IN ('/sensitive-data', '/sensitive-data/')"),
    recursive=True) + f"""
, judged AS (
  SELECT f.request_id, f.client_ip, f.cnt AS request_count, f.cnt > {C.LIMIT_N} AS over_limit,
         CASE WHEN f.cnt <= {C.LIMIT_N} THEN false
              WHEN f.client_ip = '127.0.0.1' THEN true
              WHEN l.client_ip IS NULL THEN {_unknown}
              ELSE {_verdict('l.recency_days', 'l.frequency', 'l.monetary')} END AS suspicious
  FROM fold f LEFT JOIN lookup l ON f.client_ip = l.client_ip)
SELECT request_id, client_ip, request_count, over_limit, suspicious,
       CASE WHEN over_limit AND suspicious THEN 'challenge' ELSE 'allow' END AS decision
FROM judged"""


# a third of the clients is verified, and clients of last number 5, 15, ... are the loopback address
LOCAL_LOG = f"""access_local AS (
  SELECT * REPLACE (CASE WHEN {_OCTET} % 10 = 5 THEN '127.0.0.1' ELSE client_ip END AS client_ip) FROM access_log),
unverified AS (SELECT * FROM access_local WHERE NOT ({_OCTET} % 3 = 0 AND client_ip <> '127.0.0.1'))"""
SQL["decide_unverified"] = _with(
    ACCESS_LOG, ACCESS, _rfm_cte("rfm_all", "access", V.EVENTS_NOW), LOOKUP, LOCAL_LOG,
    _limiter("unverified", C.LIMIT_WINDOW_S, where="AND path IN ('/sensitive-data', '/sensitive-data/')"),
    recursive=True) + SQL["decide_requests"][SQL["decide_requests"].index("\n, judged AS"):]

# ---- text logs ---------------------------------------------------------------

ACCESS_TEXT = """access_text AS (
  SELECT request_id,
         CASE WHEN request_id % 101 = 0 THEN 'invalid-timestamp'
              WHEN request_id % 2 = 0 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f')
              ELSE strftime("timestamp", '%Y-%m-%d %H:%M:%S') END AS "timestamp",
         client_ip,
         CASE WHEN request_id % 107 = 0 THEN NULL ELSE src_port END AS src_port,
         method, path,
         CASE WHEN request_id % 103 = 0 THEN NULL
              WHEN request_id % 41 = 0 THEN CAST(request_id % 1000 AS VARCHAR) || '.25'
              ELSE CAST(CAST(round(http_body_length * 100) AS BIGINT) AS VARCHAR) END AS http_body_length,
         CASE WHEN request_id % 109 = 0 THEN NULL ELSE 'agent/1' END AS user_agent,
         CAST(NULL AS VARCHAR) AS referer
  FROM access_log)"""

SQL["conform_access_log"] = _with(ACCESS_LOG, ACCESS_TEXT) + """
SELECT request_id, TRY_CAST("timestamp" AS TIMESTAMP) AS "timestamp", coalesce(src_port, 'N/A') AS src_port,
       coalesce(TRY_CAST(http_body_length AS DOUBLE), 0) AS http_body_length,
       coalesce(user_agent, '') AS user_agent, coalesce(referer, '') AS referer
FROM access_text"""

SQL["parse_timestamp"] = """
SELECT event_id, TRY_CAST(CASE WHEN event_id % 101 = 0 THEN 'not-a-time'
                               WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
                               WHEN event_id % 4 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                               WHEN event_id % 4 = 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                               ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS TIMESTAMP) AS parsed
FROM events"""


def _flags_sql(m: str) -> str:
    bits = (("U", 32), ("A", 16), ("P", 8), ("R", 4), ("S", 2), ("F", 1))
    return "(" + " || ".join(f"CASE WHEN ({m} & {b}) != 0 THEN '{c}' ELSE '-' END" for c, b in bits) + ")"


PACKET_LINES = f"""pk AS (
  SELECT event_id, ts, user_id, value,
         CASE WHEN event_type = 'error' THEN 17 WHEN event_type = 'signup' THEN 1 ELSE 6 END AS proto
  FROM events),
pk2 AS (
  SELECT event_id, proto,
         concat_ws(chr(9), CASE WHEN event_id % {V.BAD_TIME_MOD} = 0 THEN 'no-time'
                                ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END,
                   CASE WHEN event_id % {V.EMPTY_IP_MOD} = 0 THEN ''
                        ELSE '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) END,
                   '{V.PACKET_DST}', CAST(proto AS VARCHAR),
                   CAST(CASE WHEN proto IN (6, 17) THEN 1024 + event_id % 60000 ELSE 0 END AS VARCHAR),
                   CAST(CASE WHEN proto = 6 THEN 80 WHEN proto = 17 THEN 53 ELSE 0 END AS VARCHAR),
                   CASE WHEN event_id % {V.NEGATIVE_MOD} = 0 THEN '-1' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)
                        WHEN event_id % {V.DECIMAL_MOD} = 0 THEN CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || '.75'
                        WHEN event_id % {V.NO_NUMBER_MOD} = 0 THEN 'n/a'
                        ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END) AS seven,
         CASE WHEN proto = 6 THEN {_flags_sql('(event_id % 64)')} ELSE '-' END AS flags
  FROM pk),
packet_lines AS (
  SELECT event_id AS line_id,
         CASE WHEN event_id % {V.COMMENT_MOD} = 0 THEN '# marker ' || CAST(event_id AS VARCHAR)
              WHEN event_id % {V.MALFORMED_MOD} = 0 THEN seven
              ELSE seven || chr(9) || flags END AS value
  FROM pk2),
stripped AS (
  SELECT line_id, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS line FROM packet_lines),
classified AS (
  SELECT line_id, line, string_split(line, chr(9)) AS parts,
         CASE WHEN line = '' OR starts_with(line, '#') OR starts_with(line, 'Timestamp') THEN 'skip'
              WHEN len(string_split(line, chr(9))) != 8 THEN 'malformed'
              WHEN string_split(line, chr(9))[1] = '' OR string_split(line, chr(9))[2] = ''
                   OR string_split(line, chr(9))[7] = '' THEN 'missing'
              ELSE 'ok' END AS kind
  FROM stripped),
ok AS (SELECT * FROM classified WHERE kind = 'ok'),
slim AS (SELECT line_id, parts[1] AS "timestamp", parts[2] AS src_ip, parts[7] AS pkt_len FROM ok),
clean AS (
  SELECT line_id, TRY_CAST("timestamp" AS TIMESTAMP) AS "timestamp", src_ip,
         CAST(trunc(TRY_CAST(pkt_len AS DOUBLE)) AS BIGINT) AS pkt_len
  FROM slim
  WHERE src_ip IS NOT NULL AND trunc(TRY_CAST(pkt_len AS DOUBLE)) >= 0 AND TRY_CAST("timestamp" AS TIMESTAMP) IS NOT NULL),
packets AS (
  SELECT line_id, TRY_CAST(parts[1] AS TIMESTAMP) AS "timestamp", parts[2] AS src_ip, parts[3] AS dst_ip,
         TRY_CAST(parts[4] AS INTEGER) AS proto, TRY_CAST(parts[5] AS INTEGER) AS src_port,
         TRY_CAST(parts[6] AS INTEGER) AS dst_port, CAST(trunc(TRY_CAST(parts[7] AS DOUBLE)) AS BIGINT) AS length, parts[8] AS flags
  FROM ok)"""

SQL["packet_tsv_parse"] = _with(PACKET_LINES) + """
SELECT line_id, "timestamp", src_ip, dst_ip, proto, src_port, dst_port, length, flags FROM packets"""

SQL["packet_rejects"] = _with(PACKET_LINES) + """
SELECT line_id, kind AS reason, CAST(len(parts) AS INTEGER) AS n_fields
FROM classified WHERE kind IN ('malformed', 'missing')"""

SQL["slim_packets"] = _with(PACKET_LINES) + "SELECT line_id, \"timestamp\", src_ip, pkt_len FROM slim"

SQL["clean_packets"] = _with(PACKET_LINES) + "SELECT line_id, \"timestamp\", src_ip, pkt_len FROM clean"

SQL["filter_since"] = _with(PACKET_LINES) + f"""
SELECT line_id, "timestamp", src_ip, pkt_len FROM clean WHERE "timestamp" > TIMESTAMP '{C.HWM}'"""

SQL["filter_destination"] = _with(PACKET_LINES) + f"""
SELECT line_id, src_ip, dst_ip, dst_port, length FROM packets WHERE dst_ip = '{V.PACKET_DST}' AND dst_port = 80"""

SQL["union_logs"] = _with(ACCESS_LOG, ACCESS, PACKET_LINES) + """
SELECT request_id AS record_id, 'access' AS source, "timestamp", client_ip,
       round(http_body_length, 4) AS http_body_length, path, CAST(NULL AS BIGINT) AS pkt_len FROM access
UNION ALL
SELECT line_id, 'packet', "timestamp", src_ip, NULL, NULL, pkt_len FROM clean"""

# ---- scalar functions -------------------------------------------------------

SQL["tcp_flags_string"] = f"""
SELECT event_id, event_id % 256 AS mask, {_flags_sql('(event_id % 256)')} AS flags FROM events"""

SQL["ipv4_to_string"] = """
SELECT event_id, ip AS ip_int,
       concat_ws('.', CAST((ip >> 24) & 255 AS VARCHAR), CAST((ip >> 16) & 255 AS VARCHAR),
                 CAST((ip >> 8) & 255 AS VARCHAR), CAST(ip & 255 AS VARCHAR)) AS ip
FROM (SELECT event_id, (user_id * 2654435761 + event_id) % 4294967296 AS ip FROM events)"""

SQL["format_packet_ts"] = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text FROM events"

SQL["normalize_flow_fields"] = f"""
SELECT packet_id, proto,
       CASE WHEN proto IN (6, 17) THEN src_port ELSE 0 END AS src_port,
       CASE WHEN proto IN (6, 17) THEN dst_port ELSE 0 END AS dst_port,
       CASE WHEN proto = 6 THEN {_flags_sql('flag_mask')} ELSE '-' END AS flags
FROM (SELECT event_id AS packet_id,
             CASE WHEN event_type = 'error' THEN 17 WHEN event_type = 'signup' THEN 1 ELSE 6 END AS proto,
             CAST(1024 + event_id % 60000 AS INTEGER) AS src_port, 443 AS dst_port,
             CAST(event_id % 64 AS INTEGER) AS flag_mask
      FROM events)"""

SQL["ipv4_flow_fields"] = SQL["normalize_flow_fields"].replace("FROM events)", """FROM events
      WHERE event_id % 13 <> 0 AND event_id % 17 <> 0)""")

SQL["parse_timestamp_strict"] = SQL["parse_timestamp"] + " WHERE event_id % 101 <> 0"

# ---- packet-path RFM, ranks, scores -------------------------------------------

SQL["traffic_totals"] = _with(PACKET_LINES) + """
SELECT src_ip, CAST(count(*) AS BIGINT) AS packets, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes
FROM packets GROUP BY src_ip"""


def _raw_cte(name="raw", now=V.EVENTS_NOW, where=""):
    return f"""{name} AS (
  SELECT src_ip, max("timestamp") AS last_seen, CAST(count(*) AS BIGINT) AS frequency_raw,
         CAST(sum(pkt_len) AS BIGINT) AS monetary_raw,
         CAST(epoch(TIMESTAMP '{now}') AS BIGINT) - CAST(floor(epoch_us(max("timestamp")) / 1000000) AS BIGINT)
           AS recency_raw
  FROM clean WHERE true {where} GROUP BY src_ip)"""


SQL["rfm_raw_packets"] = _with(PACKET_LINES, _raw_cte()) + """
SELECT src_ip, last_seen, frequency_raw, monetary_raw, recency_raw FROM raw"""

_PR = """round(percent_rank() OVER (ORDER BY recency_raw), 9) AS r_rank,
       round(percent_rank() OVER (ORDER BY frequency_raw), 9) AS f_rank,
       round(percent_rank() OVER (ORDER BY monetary_raw), 9) AS m_rank"""

SQL["percent_ranks"] = _with(PACKET_LINES, _raw_cte()) + f"SELECT src_ip, {_PR} FROM raw"
SQL["percent_ranks_histogram"] = SQL["percent_ranks"]


def _scored(src="raw", last_updated=V.EVENTS_NOW, name="scored"):
    return f"""{name}_ranked AS (
  SELECT src_ip, percent_rank() OVER (ORDER BY recency_raw) AS r_rank,
         percent_rank() OVER (ORDER BY frequency_raw) AS f_rank,
         percent_rank() OVER (ORDER BY monetary_raw) AS m_rank FROM {src}),
{name}_s AS (
  SELECT src_ip,
         least(5, CAST(ceil((1.0::DOUBLE - r_rank) * 5.0::DOUBLE) AS INTEGER)) AS r_score,
         least(5, CAST(ceil(f_rank * 5.0::DOUBLE) AS INTEGER)) AS f_score,
         least(5, CAST(ceil(m_rank * 5.0::DOUBLE) AS INTEGER)) AS m_score FROM {name}_ranked),
{name} AS (
  SELECT src_ip, r_score, f_score, m_score, CAST(r_score * 100 + f_score * 10 + m_score AS FLOAT) AS composite_score,
         '{last_updated}' AS last_updated FROM {name}_s)"""


SQL["score_rfm"] = _with(PACKET_LINES, _raw_cte(), _scored()) + "SELECT * FROM scored"
SQL["flag_by_composite"] = _with(PACKET_LINES, _raw_cte(), _scored()) + \
    "SELECT * FROM scored WHERE composite_score > 400.0"
SQL["incremental_scores"] = _with(PACKET_LINES, _raw_cte(where=f"""AND "timestamp" > TIMESTAMP '{C.HWM}'"""),
                                  _scored()) + "SELECT * FROM scored"
SQL["merge_scores"] = _with(
    PACKET_LINES,
    _raw_cte("raw_old", now=C.HWM, where=f"""AND "timestamp" <= TIMESTAMP '{C.HWM}'"""),
    _scored("raw_old", last_updated=C.HWM, name="old"),
    _raw_cte("raw_new", where=f"""AND "timestamp" > TIMESTAMP '{C.HWM}' AND CAST(split_part(src_ip, '.', 4) AS INTEGER) % 5 <> 0"""),
    _scored("raw_new", name="new")) + """
SELECT * FROM old WHERE src_ip NOT IN (SELECT src_ip FROM new)
UNION ALL SELECT * FROM new"""

# ---- streaming forms: same results as their batch twins -------------------------
SQL["stream_packet_tsv"] = SQL["slim_packets"]
SQL["stream_packet_tail"] = _with(PACKET_LINES) + """
SELECT "timestamp", src_ip, pkt_len, count(*) AS n FROM slim WHERE line_id % 3 > 0 GROUP BY 1, 2, 3"""
SQL["stream_rfm_raw"] = SQL["stream_rfm_upsert"] = SQL["compute_rfm"]

# ---- logs written to files, read back, and jobs over them ---------------------
SQL["read_access_log_mixed"] = _with(ACCESS_LOG) + """
SELECT request_id, "timestamp", client_ip, CASE WHEN request_id % 3 = 1 THEN 0 ELSE http_body_length END AS http_body_length,
       CASE WHEN request_id % 3 = 2 THEN NULL ELSE path END AS path FROM access_log"""
SQL["read_packet_csv_mixed"] = _with(PACKET_LINES) + """
SELECT "timestamp", src_ip, pkt_len, count(*) AS n FROM clean GROUP BY 1, 2, 3"""
SQL["refresh_rfm_job"] = SQL["compute_rfm"]
SQL["run_incremental_job"] = SQL["run_merged_job"] = SQL["score_rfm"]
SQL["stream_rate_limit"] = SQL["stream_rate_limit_arrival"] = SQL["rate_limit"]
SQL["rate_limit_slices"] = f"""
SELECT subnet, count(*) AS requests, true AS sliced, CAST(sum(CAST(over_limit AS INTEGER)) AS BIGINT) AS "over"
FROM ({SQL["rate_limit_subnet"]}) GROUP BY subnet"""
SQL["stream_decide"] = SQL["decide_requests"]
