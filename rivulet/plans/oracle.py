"""DuckDB SQL for every registered query, over the driver's base tables.

The fixture derivations are inlined as CTEs (same rules as ``plans.fixtures``).
Column names and types match the Spark results.
"""

from __future__ import annotations

from rivulet.plans import catalog as C

# ISO-8601 stamps, stated apart from the code under test: basic forms are rewritten to
# extended ones, then one pattern reads date, time, fraction and (ignored) offset.
REWRITES = [
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})", r"\1-\2-\3"),
    (r"^([0-9]{4}-[0-9]{2}-[0-9]{2}.)([0-9]{2})([0-9]{2})([0-9]{2})", r"\1\2:\3:\4"),
    (r"^([0-9]{4}-[0-9]{2}-[0-9]{2}.)([0-9]{2})([0-9]{2})([^:0-9]|$)", r"\1\2:\3\4"),
]
STAMP = (r"^([0-9]{4})-([0-9]{2})-([0-9]{2})"
         r"(?:.([01][0-9]|2[0-3])(?::([0-5][0-9])(?::([0-5][0-9]))?)?(?:[.,]([0-9]{1,6})[0-9]*)?"
         r"(?:[+-](?:[01][0-9]|2[0-3])(?::[0-5][0-9](?::[0-5][0-9])?|[0-5][0-9](?:[0-5][0-9])?)?"
         r"(?:[.,][0-9]+)?)?)?$")

CTE = {
    "f1_comments": """SELECT CAST(doc_id AS VARCHAR) AS comment_id, source AS subreddit,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('u', doc_id % 97) END AS author,
  CASE WHEN doc_id % 50 = 3 THEN '' ELSE text END AS body,
  TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '37' SECOND AS arrival_ts
FROM documents""",
    "f1_messages": """SELECT comment_id, subreddit, arrival_ts,
  coalesce(author, '[deleted]') AS author_id, body AS text,
  CASE WHEN CAST(comment_id AS BIGINT) % 40 = 5 THEN '2024-01-01T00:00:00'
       WHEN CAST(comment_id AS BIGINT) % 40 = 6 THEN 'not-a-dateZ'
       ELSE '2024-01-01T00:00:00.000001Z' END AS timestamp
FROM f1_comments""",
    "f1b_checkpoints": """SELECT source AS stream_id,
  CAST(max(doc_id) FILTER (WHERE doc_id % 3 = 0) AS VARCHAR) AS last_comment_id
FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY source""",
    "f2_errors": """SELECT concat('u', user_id) AS stream_id, event_id AS seq, ts,
  CASE event_id % 11 WHEN 0 THEN 'ConnectionError' WHEN 1 THEN 'TimeoutError'
    WHEN 2 THEN 'TooManyRequests' WHEN 3 THEN 'RequestException' WHEN 4 THEN 'SuspiciousActivity'
    WHEN 5 THEN 'ResponseException' WHEN 6 THEN 'RateLimitError' WHEN 7 THEN 'NotFound'
    WHEN 8 THEN 'Forbidden' WHEN 9 THEN 'ValueError' ELSE 'KeyError' END AS error_type,
  props AS error_message
FROM events""",
    "f2b_errors_dense": """SELECT event_type AS stream_id, event_id AS seq, ts,
  'TimeoutError' AS error_type, props AS error_message FROM events""",
    "f2c_clears": """SELECT concat('u', user_id) AS stream_id,
  min(ts) + INTERVAL 10 DAY AS clear_ts FROM events GROUP BY user_id""",
    "f3_checkpoint_log": """SELECT concat('u', user_id) AS stream_id, event_id AS seq,
  ts AS updated_at,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS last_comment_id,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'bad'
       WHEN event_id % 13 = 0 THEN '2024-01-05T10:00:00+02:00'
       ELSE '2024-01-05T10:00:00Z' END AS last_processed_at
FROM events""",
    "f3_checkpoint_table": """SELECT concat('u', user_id) AS id, concat('u', user_id) AS stream_id,
  'old' AS last_comment_id, TIMESTAMP '2023-12-31 00:00:00' AS last_processed_at,
  TIMESTAMP '2023-12-31 00:00:00' AS updated_at
FROM (SELECT DISTINCT user_id + 75 AS user_id FROM events)""",
    "f4_requests": """SELECT concat('st', event_id) AS id,
  CASE WHEN event_id % 37 <> 0 THEN concat('c', user_id, CASE WHEN event_id % 2 = 0 THEN 'x'
    ELSE '' END) END AS subreddit, ts AS requested_at, concat('i', event_id % 3) AS instance_id,
  CASE WHEN event_id % 5 <> 0 THEN props END AS config
FROM events""",
    "f4_streams": """SELECT concat('s', k) AS id, concat('c', k) AS subreddit,
  CASE k % 6 WHEN 0 THEN 'inactive' WHEN 1 THEN 'starting' WHEN 2 THEN 'active'
    WHEN 3 THEN 'paused' WHEN 4 THEN 'stopped' ELSE 'error' END AS status,
  CASE WHEN k % 4 = 0 THEN '{bad' WHEN k % 7 = 0 THEN '' WHEN k % 9 <> 0
    THEN '{"limit": 100}' END AS config
FROM (SELECT DISTINCT user_id AS k FROM events)""",
    "f4_checkpoints": """SELECT id, id AS stream_id, 'x' AS last_comment_id,
  TIMESTAMP '2023-12-31 00:00:00' AS last_processed_at,
  TIMESTAMP '2023-12-31 00:00:00' AS updated_at
FROM (SELECT DISTINCT concat('s', user_id) AS id FROM events
      UNION ALL SELECT DISTINCT concat('ghost', user_id) FROM events)""",
    "f4_leases": """SELECT DISTINCT concat('c', user_id) AS subreddit,
  concat('i', length(concat('s', user_id))) AS instance_id FROM events""",
    "f4_status_log": """SELECT concat('u', user_id) AS stream_id, event_id AS seq, ts,
  CASE WHEN event_id % 997 = 0 THEN 'deleted' WHEN event_type = 'signup' THEN 'starting'
    WHEN event_type = 'purchase' THEN 'stopped' WHEN event_type = 'error' THEN 'error'
    ELSE 'active' END AS status,
  CASE WHEN event_id % 2 = 0 THEN concat('i', event_id % 3) ELSE NULL END AS instance_id
FROM events""",
    "f4_delete_ids": """SELECT DISTINCT concat('s', user_id * 3) AS id FROM events
UNION ALL SELECT DISTINCT concat('ghost', user_id) FROM events""",
    "f5_attempts": """SELECT concat('b', user_id % 5) AS stream_id, event_id AS attempt_id, ts,
  CASE WHEN value > 30 THEN CASE event_id % 4 WHEN 0 THEN 'ConnectionError'
    WHEN 1 THEN 'TooManyRequests' WHEN 2 THEN 'RateLimitError' ELSE 'TimeoutError' END END
    AS error_type
FROM events""",
    "f6_lease_log": """SELECT event_type AS subreddit, concat('i', user_id % 3) AS instance_id,
  event_id AS seq, ts,
  CASE WHEN event_id % 50 = 0 THEN 'release' WHEN event_id % 3 = 0 THEN 'acquire'
    ELSE 'refresh' END AS action
FROM events""",
}

DEPS = {"f1_messages": ["f1_comments"]}


def _with(names: list[str], extra: list[tuple[str, str]], body: str) -> str:
    seen: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in seen:
            seen.append(n)
    for n in names:
        add(n)
    parts = [f"{n} AS (\n{CTE[n]}\n)" for n in seen] + [f"{n} AS (\n{t}\n)" for n, t in extra]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _ts(text: str) -> str:
    return f"TIMESTAMP '{text}'"


def parse_naive_utc(x: str) -> str:
    """O10 in SQL: same grammar and canonical text as the Spark expression."""
    s = f"regexp_replace({x}, 'Z+$', '')"
    for pattern, repl in REWRITES:
        s = f"regexp_replace({s}, '{pattern}', '{repl}')"
    p = STAMP
    g = [f"regexp_extract({s}, '{p}', {i})" for i in range(1, 8)]
    part = [f"nullif({e}, '')" for e in g]
    canonical = (f"concat({g[0]}, '-', {g[1]}, '-', {g[2]}, ' ', coalesce({part[3]}, '00'), ':', "
                 f"coalesce({part[4]}, '00'), ':', coalesce({part[5]}, '00'), '.', "
                 f"rpad(coalesce({part[6]}, ''), 6, '0'))")
    return f"(CASE WHEN regexp_full_match({s}, '{p}') THEN TRY_CAST({canonical} AS TIMESTAMP) END)"


def validated(src: str) -> str:
    return VALIDATED.replace("FROM f1_messages", f"FROM {src}")


VALIDATED = (f"""SELECT *,
  subreddit IS NULL OR length(subreddit) = 0 OR length(subreddit) > 255 AS bad_subreddit,
  author_id IS NULL OR length(author_id) = 0 OR length(author_id) > 255 AS bad_author,
  text IS NULL OR length(text) < 1 AS bad_text,
  timestamp IS NULL OR NOT ends_with(timestamp, 'Z') OR {parse_naive_utc('timestamp')} IS NULL
    AS bad_timestamp
FROM f1_messages""")

REASONS = ("concat_ws('; ', CASE WHEN bad_subreddit THEN 'invalid subreddit' END, "
           "CASE WHEN bad_author THEN 'invalid author_id' END, "
           "CASE WHEN bad_text THEN 'invalid text' END, "
           "CASE WHEN bad_timestamp THEN 'invalid timestamp' END)")


def _uuid(expr: str) -> str:
    h = f"sha256({expr})"
    return (f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), "
            f"substr({h}, 17, 4), substr({h}, 21, 12))")


CLASSIFY = """
  coalesce(error_type IN ('ConnectionError', 'TimeoutError', 'TooManyRequests', 'RequestException',
    'SuspiciousActivity', 'ResponseException'), false) AS is_retryable,
  coalesce(error_type IN ('TooManyRequests', 'RateLimitError'), false) AS needs_backoff,
  CAST(CASE error_type WHEN 'TooManyRequests' THEN 60 WHEN 'RateLimitError' THEN 30 ELSE 5 END
    AS INTEGER) AS backoff_seconds,
  CASE WHEN error_type IN ('NotFound', 'BadRequest', 'Forbidden', 'InvalidCredentials', 'ValueError')
         THEN 'abandon'
       WHEN error_type IN ('TooManyRequests', 'RateLimitError') THEN 'backoff'
       WHEN error_type IN ('ConnectionError', 'TimeoutError', 'TooManyRequests', 'RequestException',
         'SuspiciousActivity', 'ResponseException') THEN 'immediate'
       ELSE 'unhandled' END AS action,
  CAST(coalesce(error_type IN ('ConnectionError', 'TimeoutError', 'TooManyRequests',
    'RequestException', 'SuspiciousActivity', 'ResponseException'), false) AS INTEGER)
    AS is_recoverable"""


def _keep_last(src: str) -> str:
    return _with([src], [], f"""SELECT stream_id, seq, ts, error_type, position FROM (
  SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts DESC, seq DESC) AS position
  FROM {src}) WHERE position <= 100""")


def _lists_cte(src: str, where: str = "") -> list[tuple[str, str]]:
    return [
        ("_lag", f"""SELECT *, lag(ts) OVER (PARTITION BY stream_id ORDER BY ts, seq) AS prev_ts
FROM {src} {where}"""),
        ("_tagged", """SELECT *, CAST(sum(CASE WHEN prev_ts IS NULL
    OR ts > prev_ts + INTERVAL 24 HOUR THEN 1 ELSE 0 END)
  OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS list_no
FROM _lag"""),
        ("_lists", """SELECT stream_id, list_no, min(ts) AS list_start, max(ts) AS last_push,
  max(ts) + INTERVAL 24 HOUR AS expires_at, count(*) AS n_pushed,
  least(count(*), 100) AS n_kept
FROM _tagged GROUP BY stream_id, list_no"""),
    ]


# Lock calls in order, one at a time: the live holder, since and until when, lease number.
LEASE_SQL = """WITH RECURSIVE r AS (
  SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY ts, seq) AS rn
  FROM (__F6__) __WHERE__),
 c AS (
  SELECT subreddit, 0::BIGINT AS rn, NULL::VARCHAR AS instance_id, NULL::BIGINT AS seq,
    NULL::TIMESTAMP AS ts, NULL::VARCHAR AS action, false AS granted, false AS live,
    NULL::VARCHAR AS holder, NULL::TIMESTAMP AS since, NULL::TIMESTAMP AS until,
    0::BIGINT AS lease_no, NULL::VARCHAR AS met, NULL::TIMESTAMP AS met_since,
    NULL::TIMESTAMP AS met_until
  FROM (SELECT DISTINCT subreddit FROM r)
  UNION ALL
  SELECT r.subreddit, r.rn, r.instance_id, r.seq, r.ts, r.action, x.ok, x.live,
    CASE WHEN x.ok AND r.action = 'acquire' THEN r.instance_id ELSE p.holder END,
    CASE WHEN x.ok AND r.action = 'acquire' THEN r.ts ELSE p.since END,
    CASE WHEN x.ok AND r.action = 'release' THEN r.ts
         WHEN x.ok THEN r.ts + INTERVAL 3600 SECOND ELSE p.until END,
    CASE WHEN x.ok AND r.action = 'acquire' THEN p.lease_no + 1 ELSE p.lease_no END,
    CASE WHEN x.live THEN p.holder END, CASE WHEN x.live THEN p.since END,
    CASE WHEN x.live THEN p.until END
  FROM c p JOIN r ON r.subreddit = p.subreddit AND r.rn = p.rn + 1,
  LATERAL (SELECT coalesce(r.ts < p.until, false) AS live,
    CASE WHEN r.action = 'acquire' THEN NOT coalesce(r.ts < p.until, false)
         ELSE coalesce(r.ts < p.until, false) AND p.holder = r.instance_id END AS ok) x
 ),
 calls AS (SELECT * FROM c WHERE rn > 0),
 leases AS (SELECT subreddit, lease_no,
    max(CASE WHEN action = 'acquire' THEN instance_id END) AS instance_id,
    min(ts) AS held_from,
    least(max(CASE WHEN action <> 'release' THEN ts END) + INTERVAL 3600 SECOND,
          max(CASE WHEN action = 'release' THEN ts END)) AS held_until, count(*) AS n_calls
  FROM calls WHERE granted GROUP BY subreddit, lease_no)
""".replace("__F6__", CTE["f6_lease_log"])


def _lease(body: str, where: str = "") -> str:
    return LEASE_SQL.replace("__WHERE__", where) + body


CIRCUIT_SQL = f"""WITH RECURSIVE f5_attempts AS ({CTE['f5_attempts']}),
 r AS (
  SELECT stream_id, attempt_id AS event_id, ts, error_type IS NOT NULL AS failed,
    CASE error_type WHEN 'TooManyRequests' THEN 60 WHEN 'RateLimitError' THEN 30 ELSE 5 END AS sug,
    row_number() OVER (PARTITION BY stream_id ORDER BY ts, attempt_id) AS rn
  FROM f5_attempts),
 f AS (
  SELECT stream_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 'closed'::VARCHAR AS state,
    0::BIGINT AS fc, 0::BIGINT AS sc, 10::BIGINT AS backoff, NULL::TIMESTAMP AS lf,
    true AS admitted
  FROM (SELECT DISTINCT stream_id FROM r)
  UNION ALL
  SELECT p.stream_id, r.rn, r.event_id,
   CASE WHEN NOT x.adm THEN 'open'
        WHEN r.failed THEN CASE WHEN x.st = 'half_open' OR p.fc + 1 >= 5 THEN 'open'
                                ELSE 'closed' END
        WHEN x.st = 'half_open' THEN CASE WHEN x.sc + 1 >= 2 THEN 'closed' ELSE 'half_open' END
        ELSE x.st END,
   CASE WHEN NOT x.adm THEN p.fc WHEN r.failed THEN p.fc + 1 ELSE 0 END,
   CASE WHEN NOT x.adm THEN p.sc WHEN r.failed THEN 0
        WHEN x.st = 'half_open' THEN x.sc + 1 ELSE x.sc END,
   CASE WHEN NOT x.adm THEN p.backoff
        WHEN r.failed AND (x.st = 'half_open' OR p.fc + 1 >= 5)
          THEN least(greatest(p.backoff * 2, r.sug), 3600)
        WHEN NOT r.failed AND x.st = 'half_open' AND x.sc + 1 >= 2 THEN 10
        ELSE p.backoff END,
   CASE WHEN x.adm AND r.failed THEN r.ts ELSE p.lf END,
   x.adm
  FROM f p JOIN r ON r.stream_id = p.stream_id AND r.rn = p.rn + 1,
  LATERAL (SELECT
    NOT (p.state = 'open' AND p.lf IS NOT NULL
         AND epoch_us(r.ts) - epoch_us(p.lf) < p.backoff::BIGINT * 1000000) AS adm,
    CASE WHEN p.state = 'open' AND (p.lf IS NULL
         OR epoch_us(r.ts) - epoch_us(p.lf) >= p.backoff::BIGINT * 1000000)
         THEN 'half_open' ELSE p.state END AS st,
    CASE WHEN p.state = 'open' AND (p.lf IS NULL
         OR epoch_us(r.ts) - epoch_us(p.lf) >= p.backoff::BIGINT * 1000000)
         THEN 0 ELSE p.sc END AS sc) x
 )
SELECT stream_id, event_id AS attempt_id, state, admitted, fc AS failure_count,
  backoff AS backoff_seconds
FROM f WHERE rn > 0"""


def oracle_sql() -> dict[str, str]:
    now, as_of = _ts(C.NOW), _ts(C.ERRORS_AS_OF)
    merged = ("_merged", """SELECT stream_id,
  arg_max(last_comment_id, (updated_at, seq)) FILTER (WHERE last_comment_id IS NOT NULL)
    AS last_comment_id,
  arg_max(last_processed_at, (updated_at, seq)) FILTER (WHERE last_processed_at IS NOT NULL)
    AS last_processed_at,
  max(updated_at) FILTER (WHERE last_comment_id IS NOT NULL OR last_processed_at IS NOT NULL)
    AS updated_at
FROM f3_checkpoint_log GROUP BY stream_id
HAVING max(updated_at) FILTER (WHERE last_comment_id IS NOT NULL
                                OR last_processed_at IS NOT NULL) IS NOT NULL""")
    flushed = ("_flushed", f"""SELECT stream_id AS id, stream_id, last_comment_id,
  CASE WHEN last_processed_at IS NULL OR last_processed_at = '' THEN NULL
       ELSE {parse_naive_utc('last_processed_at')} END AS last_processed_at,
  {now} AS updated_at
FROM _merged
WHERE last_processed_at IS NULL OR last_processed_at = ''
   OR {parse_naive_utc('last_processed_at')} IS NOT NULL""")
    winners = ("_win", """SELECT subreddit, arg_min(id, (requested_at, id)) AS id,
  min(requested_at) AS requested_at,
  arg_min(struct_pack(v := instance_id), (requested_at, id)).v AS instance_id,
  arg_min(struct_pack(v := config), (requested_at, id)).v AS config
FROM f4_requests WHERE subreddit IS NOT NULL GROUP BY subreddit""")
    created = ("_created", """SELECT w.id, w.subreddit, 'starting' AS status,
  w.instance_id, coalesce(w.config, '{}') AS config,
  w.requested_at AS created_at, w.requested_at AS updated_at
FROM _win w WHERE w.subreddit NOT IN (SELECT subreddit FROM f4_streams)""")
    cleared = """SELECT e.* FROM f2_errors e
LEFT JOIN (SELECT stream_id, max(clear_ts) AS clear_ts FROM f2c_clears GROUP BY stream_id) c
  ON e.stream_id = c.stream_id
WHERE c.clear_ts IS NULL OR e.ts > c.clear_ts"""

    def live_count(src):
        return _with([src], _lists_cte(src, f"WHERE ts <= {as_of}"), f"""SELECT s.stream_id,
  coalesce(l.n_kept, 0) AS error_count
FROM (SELECT DISTINCT stream_id FROM {src}) s
LEFT JOIN (SELECT * FROM _lists WHERE expires_at >= {as_of}) l ON s.stream_id = l.stream_id""")

    def live_recent(names, src, extra=()):
        return _with(names, [*extra, *_lists_cte(src, f"WHERE ts <= {as_of}")], f"""SELECT
  stream_id, seq, ts, error_type, error_message, position FROM (
  SELECT t.*, row_number() OVER (PARTITION BY t.stream_id ORDER BY t.ts DESC, t.seq DESC)
    AS position
  FROM _tagged t JOIN _lists l ON t.stream_id = l.stream_id AND t.list_no = l.list_no
  WHERE l.expires_at >= {as_of})
WHERE position <= 10""")

    ingest_ctes = [
        ("_reg", """SELECT DISTINCT source AS id, source AS subreddit FROM documents
WHERE source <> 'src19'"""),
        ("_c", "SELECT f.*, r.id AS stream_id FROM f1_comments f JOIN _reg r ON f.subreddit = r.subreddit"),
        ("_sp", f"""SELECT c.* FROM _c c
LEFT JOIN (SELECT stream_id AS ck FROM f1b_checkpoints WHERE last_comment_id IS NOT NULL) k
  ON c.stream_id = k.ck
WHERE k.ck IS NOT NULL OR c.arrival_ts >= {_ts(C.SESSION_START)}"""),
        ("_sk", """SELECT * FROM _sp WHERE NOT EXISTS (SELECT 1 FROM f1b_checkpoints k
  WHERE k.last_comment_id IS NOT NULL AND k.stream_id = _sp.stream_id
    AND k.last_comment_id = _sp.comment_id)"""),
        ("_m", """SELECT stream_id, comment_id, subreddit, arrival_ts,
  coalesce(author, '[deleted]') AS author_id, body AS text,
  strftime(arrival_ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp FROM _sk"""),
        ("_v", validated("_m")),
        ("_good", """SELECT * FROM _v
WHERE NOT (bad_subreddit OR bad_author OR bad_text OR bad_timestamp)"""),
    ]
    cut = "TIMESTAMP '2024-01-16 00:00:00'"
    now0, now1 = "TIMESTAMP '2024-02-01 00:00:00'", "TIMESTAMP '2024-02-01 01:00:00'"

    def _merge(where):
        return merged[1].replace("FROM f3_checkpoint_log GROUP BY",
                                 f"FROM f3_checkpoint_log {where} GROUP BY")

    def _flush(src, now_lit, where=""):
        return (flushed[1].replace("FROM _merged", f"FROM {src}")
                .replace(now, now_lit).replace("WHERE last_processed_at IS NULL OR",
                                               f"WHERE {where} (last_processed_at IS NULL OR")
                + (")" if where else "")) if where else \
            flushed[1].replace("FROM _merged", f"FROM {src}").replace(now, now_lit)

    def _upsert(t, u, now_lit):
        return f"""SELECT
  CASE WHEN t.stream_id IS NOT NULL THEN t.id ELSE coalesce(u.id, u.stream_id) END AS id,
  coalesce(t.stream_id, u.stream_id) AS stream_id,
  CASE WHEN u.stream_id IS NOT NULL THEN u.last_comment_id ELSE t.last_comment_id END
    AS last_comment_id,
  CASE WHEN u.stream_id IS NOT NULL THEN u.last_processed_at ELSE t.last_processed_at END
    AS last_processed_at,
  CASE WHEN u.stream_id IS NOT NULL THEN {now_lit} ELSE t.updated_at END AS updated_at
FROM {t} t FULL OUTER JOIN {u} u ON t.stream_id = u.stream_id"""

    flush_ctes = [
        ("_m0", _merge(f"WHERE updated_at < {cut}")),
        ("_f0", _flush("_m0", now0)),
        ("_t0", _upsert("f3_checkpoint_table", "_f0", now0)),
        ("_m1", _merge("")),
        ("_f1", _flush("_m1", now1, "stream_id IN (SELECT stream_id FROM f3_checkpoint_log "
                                    f"WHERE updated_at >= {cut}) AND")),
        ("_t1", _upsert("_t0", "_f1", now1)),
    ]

    q = {
        "messages_valid": _with(["f1_messages"], [("v", VALIDATED)], """SELECT comment_id,
  subreddit, author_id, text, timestamp FROM v
WHERE NOT (bad_subreddit OR bad_author OR bad_text OR bad_timestamp)"""),
        "messages_quarantine": _with(["f1_messages"], [("v", VALIDATED)], f"""SELECT
  {_uuid("concat_ws('|', subreddit, comment_id)")} AS id, subreddit AS stream_id, comment_id,
  'CommentProcessingError' AS error_type, {REASONS} AS error_message, 0 AS retry_count,
  1 AS is_recoverable, arrival_ts AS timestamp
FROM v WHERE bad_subreddit OR bad_author OR bad_text OR bad_timestamp"""),
        "encode_roundtrip": _with(["f1_messages"], [("v", VALIDATED)], """SELECT comment_id,
  subreddit, author_id, text, timestamp FROM v
WHERE NOT (bad_subreddit OR bad_author OR bad_text OR bad_timestamp)"""),
        "error_classified": _with(["f2_errors"], [], f"""SELECT stream_id, seq, error_type,
{CLASSIFY}
FROM f2_errors"""),
        "errors_append": _with(["f2_errors"], [("c", f"SELECT *, {CLASSIFY} FROM f2_errors")],
                               f"""SELECT {_uuid("concat_ws('|', stream_id, seq)")} AS id,
  stream_id, error_type, error_message, 0 AS retry_count, is_recoverable, ts AS timestamp
FROM c"""),
        "errors_keep_last": _keep_last("f2_errors"),
        "errors_keep_last_dense": _keep_last("f2b_errors_dense"),
        "error_lists": _with(["f2_errors"], _lists_cte("f2_errors"), "SELECT * FROM _lists"),
        "error_lists_dense": _with(["f2b_errors_dense"], _lists_cte("f2b_errors_dense"),
                                   "SELECT * FROM _lists"),
        "error_count_live": live_count("f2_errors"),
        "error_count_dense": live_count("f2b_errors_dense"),
        "errors_recent": live_recent(["f2_errors"], "f2_errors"),
        "errors_recent_dense": live_recent(["f2b_errors_dense"], "f2b_errors_dense"),
        "errors_recent_cleared": live_recent(
            ["f2_errors", "f2c_clears"], "_left", [("_left", cleared)]),
        "errors_after_clear": _with(["f2_errors", "f2c_clears"], [], cleared),
        "checkpoint_every": """SELECT stream_id, CAST(seq AS VARCHAR) AS last_comment_id,
  ts AS last_processed_at, n_processed FROM (
  SELECT event_type AS stream_id, event_id AS seq, ts,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n_processed
  FROM events)
WHERE n_processed % 100 = 0""",
        "checkpoint_merge": _with(["f3_checkpoint_log"], [merged], "SELECT * FROM _merged"),
        "checkpoint_flush": _with(["f3_checkpoint_log"], [merged, flushed],
                                  "SELECT * FROM _flushed"),
        "checkpoint_upsert": _with(["f3_checkpoint_log", "f3_checkpoint_table"],
                                   [merged, flushed], f"""SELECT
  CASE WHEN t.stream_id IS NOT NULL THEN t.id ELSE coalesce(u.id, u.stream_id) END AS id,
  coalesce(t.stream_id, u.stream_id) AS stream_id,
  CASE WHEN u.stream_id IS NOT NULL THEN u.last_comment_id ELSE t.last_comment_id END
    AS last_comment_id,
  CASE WHEN u.stream_id IS NOT NULL THEN u.last_processed_at ELSE t.last_processed_at END
    AS last_processed_at,
  CASE WHEN u.stream_id IS NOT NULL THEN {now} ELSE t.updated_at END AS updated_at,
  CASE WHEN u.stream_id IS NOT NULL AND t.stream_id IS NOT NULL THEN 'updated'
       WHEN u.stream_id IS NOT NULL THEN 'inserted' ELSE 'unchanged' END AS change
FROM f3_checkpoint_table t FULL OUTER JOIN _flushed u ON t.stream_id = u.stream_id"""),
        "start_position": _with(["f1_comments", "f1b_checkpoints"], [], f"""SELECT c.comment_id,
  c.subreddit, c.arrival_ts, k.stream_id IS NOT NULL AS replay
FROM f1_comments c
LEFT JOIN (SELECT stream_id FROM f1b_checkpoints WHERE last_comment_id IS NOT NULL) k
  ON c.subreddit = k.stream_id
WHERE k.stream_id IS NOT NULL OR c.arrival_ts >= {_ts(C.SESSION_START)}"""),
        "skip_processed": _with(["f1_comments", "f1b_checkpoints"], [], """SELECT c.comment_id,
  c.subreddit, c.arrival_ts FROM f1_comments c
WHERE NOT EXISTS (SELECT 1 FROM f1b_checkpoints k WHERE k.last_comment_id IS NOT NULL
  AND k.stream_id = c.subreddit AND k.last_comment_id = c.comment_id)"""),
        "streams_create": _with(["f4_requests", "f4_streams"], [winners, created],
                                "SELECT * FROM _created"),
        "streams_conflicts": _with(["f4_requests", "f4_streams"], [winners, created], """SELECT
  r.id, r.subreddit, h.holder_id FROM f4_requests r
JOIN (SELECT subreddit, id AS holder_id FROM f4_streams
      UNION ALL SELECT subreddit, id FROM _created) h ON r.subreddit = h.subreddit
WHERE r.id <> h.holder_id"""),
        "streams_lookup": _with(["f4_requests", "f4_streams"], [], """SELECT r.id, r.subreddit,
  s.id AS stream_id, s.status AS stream_status
FROM f4_requests r LEFT JOIN f4_streams s ON r.subreddit = s.subreddit"""),
        "streams_list": _with(["f4_streams"], [("_cfg", """SELECT id, subreddit, status,
  CASE WHEN config IS NULL OR config = '' THEN config WHEN json_valid(config) THEN config
       ELSE '{}' END AS config FROM f4_streams""")], """SELECT id, subreddit, status, config,
  CASE WHEN config <> '' THEN TRY_CAST(json_extract_string(nullif(config, ''), '$.limit')
    AS BIGINT) END AS config_limit FROM _cfg"""),
        "streams_current": _with(["f4_status_log"], [], """SELECT stream_id,
  arg_max(status, (ts, seq)) AS status,
  arg_max(instance_id, (ts, seq)) FILTER (WHERE instance_id IS NOT NULL) AS instance_id,
  max(ts) AS updated_at
FROM f4_status_log GROUP BY stream_id
HAVING max(CASE WHEN status = 'deleted' THEN 1 ELSE 0 END) = 0"""),
        "streams_delete": _with(["f4_streams", "f4_delete_ids"], [], """SELECT * FROM f4_streams
WHERE id NOT IN (SELECT id FROM f4_delete_ids)"""),
        "streams_delete_checkpoints": _with(["f4_streams", "f4_delete_ids", "f4_checkpoints"], [],
                                            """SELECT * FROM f4_checkpoints
WHERE stream_id NOT IN (SELECT id FROM f4_delete_ids WHERE id IN (SELECT id FROM f4_streams))"""),
        "streams_delete_leases": _with(["f4_streams", "f4_delete_ids", "f4_leases"], [],
                                       """SELECT * FROM f4_leases WHERE subreddit NOT IN (
  SELECT subreddit FROM f4_streams WHERE id IN (SELECT id FROM f4_delete_ids))"""),
        "streams_sweep_remaining": _with(["f4_streams", "f4_checkpoints", "f4_leases"], [
            ("_dead", """SELECT * FROM f4_streams
WHERE status IN ('stopped', 'error', 'inactive')""")], """SELECT 'stream' AS kind, id
FROM f4_streams WHERE id NOT IN (SELECT id FROM _dead)
UNION ALL SELECT 'checkpoint', stream_id FROM f4_checkpoints
WHERE stream_id NOT IN (SELECT id FROM _dead)
UNION ALL SELECT 'lease', subreddit FROM f4_leases
WHERE subreddit NOT IN (SELECT subreddit FROM _dead)"""),
        "streams_sweep": _with(["f4_streams"], [], """SELECT * FROM f4_streams
WHERE status IN ('stopped', 'error', 'inactive')"""),
        "failure_streaks": _with(["f5_attempts"], [
            ("_s", """SELECT *, CAST(sum(CASE WHEN error_type IS NULL THEN 1 ELSE 0 END)
  OVER (PARTITION BY stream_id ORDER BY ts, attempt_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
  AS streak_no FROM f5_attempts"""),
            ("_f", """SELECT *, row_number() OVER (PARTITION BY stream_id, streak_no
  ORDER BY ts, attempt_id) AS pos FROM _s WHERE error_type IS NOT NULL""")], """SELECT
  stream_id, streak_no, arg_min(attempt_id, (ts, attempt_id)) AS first_attempt_id,
  arg_max(attempt_id, (ts, attempt_id)) AS last_attempt_id, min(ts) AS first_ts,
  max(ts) AS last_ts, count(*) AS n_failures,
  max(CASE WHEN pos = 5 THEN attempt_id END) AS threshold_attempt_id,
  count(*) >= 5 AS reached_threshold
FROM _f GROUP BY stream_id, streak_no"""),
        "circuit_timeline": CIRCUIT_SQL,
        "lease_calls": _lease("""SELECT subreddit, seq, granted,
  CASE WHEN granted THEN lease_no END AS lease_no FROM calls"""),
        "lease_intervals": _lease("SELECT * FROM leases"),
        "lease_conflicts": _lease("""SELECT subreddit, instance_id, seq, ts, action,
  met AS holder_instance, met_since AS held_since, met_until AS held_until
FROM calls WHERE met <> instance_id"""),
        "lease_holders": _lease(f"""SELECT * FROM leases
WHERE held_from <= {_ts(C.LEASE_AS_OF)} AND {_ts(C.LEASE_AS_OF)} < held_until""",
                                f"WHERE ts <= {_ts(C.LEASE_AS_OF)}"),
    }
    q["ingest_stream"] = _with(["f1_comments", "f1b_checkpoints"], ingest_ctes, """SELECT
  stream_id, comment_id, subreddit, author_id, text, timestamp FROM _good""")
    q["table_lookup"], q["table_skip"] = q["streams_lookup"], q["skip_processed"]
    q["table_errors"] = q["errors_append"]
    q["table_upsert"] = f"SELECT * EXCLUDE (change) FROM ({q['checkpoint_upsert']})"
    q["table_create"] = _with(["f4_requests", "f4_streams"], [winners, created], """SELECT
  id, subreddit, status, config FROM f4_streams
UNION ALL SELECT id, subreddit, status, config FROM _created""")
    q["table_sweep"] = f"SELECT * FROM ({q['streams_sweep_remaining']}) WHERE kind <> 'lease'"
    q["ingest_published"] = q["ingest_stream"]
    q["ingest_errors"] = _with(["f1_comments", "f1b_checkpoints"], ingest_ctes, f"""SELECT
  {_uuid("concat_ws('|', stream_id, comment_id)")} AS id, stream_id,
  'CommentProcessingError' AS error_type, {REASONS} AS error_message, 0 AS retry_count,
  1 AS is_recoverable, arrival_ts AS timestamp
FROM _v WHERE bad_subreddit OR bad_author OR bad_text OR bad_timestamp""")
    q["checkpoint_stream"] = """SELECT stream_id, seq, ts AS updated_at,
  last_comment_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS last_processed_at FROM (
  SELECT event_type AS stream_id, event_id::VARCHAR AS last_comment_id, ts,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id::VARCHAR) AS seq FROM events)
WHERE seq % 10 = 0"""
    q["avro_roundtrip"] = q["encode_roundtrip"]
    q["avro_quarantine"] = _with(["f1_messages"], [("v", VALIDATED)], """SELECT comment_id,
  CASE comment_id::BIGINT % 5 WHEN 0 THEN 'text cut off' WHEN 1 THEN 'bytes after the record'
    WHEN 2 THEN 'negative length' WHEN 3 THEN 'text is not UTF-8' END AS reason,
  comment_id::BIGINT % 5 < 4 AS dropped
FROM v WHERE NOT (bad_subreddit OR bad_author OR bad_text OR bad_timestamp)""")
    every = ("_every", """SELECT stream_id, seq, updated_at, last_comment_id,
  strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS last_processed_at FROM (
  SELECT stream_id, comment_id AS last_comment_id, arrival_ts AS updated_at,
    row_number() OVER (PARTITION BY stream_id ORDER BY arrival_ts, comment_id) AS seq
  FROM _good)
WHERE seq % 10 = 0""")
    q["ingest_checkpoints"] = _with(["f1_comments", "f1b_checkpoints"], [*ingest_ctes, every],
                                    "SELECT * FROM _every")
    q["ingest_flush"] = _with(["f1_comments", "f1b_checkpoints"], [*ingest_ctes, every], """SELECT
  stream_id AS id, stream_id, arg_max(last_comment_id, seq) AS last_comment_id,
  max(updated_at) AS last_processed_at, TIMESTAMP '2024-02-01 00:00:00' AS updated_at
FROM _every GROUP BY stream_id""")
    q["circuit_stream"] = CIRCUIT_SQL
    q["error_lists_stream"] = _with(["f2_errors"], _lists_cte("f2_errors"), """SELECT stream_id,
  list_start, last_push, expires_at, n_pushed, n_kept FROM _lists
WHERE expires_at < (SELECT max(ts) - INTERVAL 1 HOUR FROM f2_errors)""")
    mark = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM {})"
    q["live_lists_stream"] = _with(["f2_errors"], _lists_cte(
        "f2_errors", f"WHERE ts <= {mark.format('f2_errors')}"), f"""SELECT stream_id,
  any_value(n_kept) AS error_count, string_agg(seq, ',' ORDER BY position) AS recent FROM (
  SELECT t.stream_id, l.n_kept, t.seq, row_number() OVER (
    PARTITION BY t.stream_id ORDER BY t.ts DESC, t.seq DESC) AS position
  FROM _tagged t JOIN _lists l ON t.stream_id = l.stream_id AND t.list_no = l.list_no
  WHERE l.expires_at >= {mark.format('f2_errors')})
WHERE position <= 10 GROUP BY stream_id""")
    q["lease_stream"] = _lease(f"""SELECT l.*, EXISTS (SELECT 1 FROM calls c
    WHERE c.granted AND c.action = 'release' AND c.subreddit = l.subreddit
      AND c.lease_no = l.lease_no)
  OR l.lease_no < max(l.lease_no) OVER (PARTITION BY l.subreddit)
  OR l.held_until <= {mark.format('calls')} AS ended
FROM leases l""")
    q["error_count_at"] = _with(["f2_errors"], _lists_cte("f2_errors"), """SELECT
  concat('u', i.user_id + 1) AS stream_id, i.event_id AS id, i.ts AS at,
  CASE WHEN i.ts <= max(t.ts) + INTERVAL 24 HOUR THEN least(100, count(*) FILTER (
    WHERE t.list_no = (SELECT max(l.list_no) FROM _lists l
      WHERE l.stream_id = concat('u', i.user_id + 1) AND l.list_start <= i.ts))) ELSE 0 END
    AS error_count
FROM events i LEFT JOIN _tagged t ON t.stream_id = concat('u', i.user_id + 1) AND t.ts <= i.ts
GROUP BY i.user_id, i.event_id, i.ts""")
    # What a channel's lease is at an instant: that of its last granted call until then.
    q["lease_holders_at"] = _lease("""SELECT subreddit, id, moment AS at,
  CASE WHEN moment < until THEN holder END AS instance_id,
  CASE WHEN moment < until THEN since END AS held_since,
  CASE WHEN moment < until THEN until END AS held_until
FROM (SELECT i.event_type AS subreddit, i.event_id AS id, i.ts + INTERVAL 30 MINUTE AS moment,
    arg_max(holder, rn) AS holder, arg_max(since, rn) AS since, arg_max(until, rn) AS until
  FROM events i LEFT JOIN c ON c.subreddit = i.event_type AND c.rn > 0
    AND c.ts <= i.ts + INTERVAL 30 MINUTE AND c.until IS NOT NULL
  GROUP BY ALL)""")
    q["flush_stream"] = _with(["f3_checkpoint_log", "f3_checkpoint_table"], flush_ctes,
                              "SELECT * FROM _t1")
    return q
