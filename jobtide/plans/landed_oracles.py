"""DuckDB SQL for the queries over landed files, from the tables the files are written from."""

from __future__ import annotations

from . import bindings as B
from .landed import AUDIT_DAYS, CATEGORIES, FILE_ROWS, SINCE, TODAY, TURNS
from .oracles import BATCH, decided, merged

RAW = f"WITH {B.RAW_SQL}"
P = f"WITH {B.POSTINGS_SQL}"
H = f"WITH {B.HISTORY_SQL}"


def feed(source: str, kept: str, precision: str, **given: str) -> str:
    """All columns of a raw posting; those not given are null."""
    kinds = {"posted_at": "TIMESTAMP", "remote_hint": "BOOLEAN"}
    names = ["company", "title", "location", "apply_url", "description", "term_default", "posted_at", "remote_hint", "source_id", "sponsorship", "degrees"]
    columns = ", ".join(f"CAST({given.get(c, 'NULL')} AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c in names)
    return f"SELECT *, CASE WHEN posted_at IS NULL THEN 'unknown' ELSE {precision} END AS posted_precision FROM (SELECT '{source}' AS source, {columns} FROM raw WHERE {kept})"


CATEGORY = f"CASE WHEN seq % 9 = 0 THEN '' ELSE {B.listed(CATEGORIES, 'seq // 7')} END"
OPEN, FITS = "seq % 4 <> 1 AND seq % 10 <> 3", f"{CATEGORY} IN ('', 'Software', 'AI/ML/Data', 'Quant')"
LINKED = "title <> '' AND apply_url <> ''"
IN_TABLE = f"company <> '' AND {LINKED} AND seq // {FILE_ROWS} % 3 <> 1"

LISTINGS = feed(
    "listings", f"{OPEN} AND {FITS}", "CASE WHEN epoch_us(posted_at) % 86400000000 = 0 THEN 'date' ELSE 'instant' END", company="company", title="title", location="location",
    apply_url="apply_url", term_default="'new-grad'", posted_at="posted_at", source_id="seq", sponsorship="sponsorship", degrees="array_to_string(degrees, ',')",
)
BOARD_A = feed(
    "ats", LINKED, "'instant'", company="CASE WHEN seq % 3 <> 0 AND company <> '' THEN company ELSE 'Acme' END", title="title", location="location", apply_url="apply_url",
    description="ltrim(description || ' & more') || chr(10) || 'End'", posted_at="posted_at + INTERVAL 4 HOUR", source_id="seq",
)
BOARD_B = feed(
    "ats", LINKED, "'instant'", company="'Acme'", title="title", location="location", apply_url="apply_url", description="description", posted_at="posted_at",
    remote_hint="CASE seq % 3 WHEN 0 THEN true WHEN 1 THEN false END", source_id="CASE WHEN seq % 5 <> 0 THEN 'b' || seq END",
)
BOARD_C = feed(
    "ats", f"{LINKED} AND seq % 8 <> 0", "'instant'", company="'Acme'", title="title", location="location", apply_url="apply_url", description="description", posted_at="posted_at",
    remote_hint="remote_hint", source_id="'c' || seq",
)
TABLES = feed(
    "swe", IN_TABLE, "'age_derived'", company="company", title="replace(title, '|', '/')", location="nullif(location, '')", apply_url="apply_url",
    posted_at=f"CASE WHEN seq % 11 <> 0 THEN TIMESTAMP '{B.NOW}' - to_days(CAST(seq % 30 AS INT)) END",
)

LISTINGS_KEPT, BOARD_C_KEPT = f"{OPEN} AND {FITS}", f"{LINKED} AND seq % 8 <> 0"
#: Files are written by chunk, in folders named by it; a file's place follows the order of those names.
PLACED = f"""named AS (SELECT chunk, row_number() OVER (ORDER BY 'chunk=' || chunk || '/') - 1 AS file FROM (SELECT DISTINCT seq // {FILE_ROWS} AS chunk FROM raw)),
placed AS (SELECT raw.*, file, row_number() OVER (PARTITION BY chunk ORDER BY seq) - 1 AS position FROM raw JOIN named ON seq // {FILE_ROWS} = chunk)"""


def placed(kept: str) -> str:
    return f"SELECT * FROM placed WHERE {kept}"


_DECIDED = decided("2001-08-03 20:00:00", False).removeprefix(f"{P}, ")
_PLAIN = {
    "raw_fetched": "SELECT count(*) FROM gated", "filtered_out": "SELECT count(*) FROM gated WHERE NOT keep", "suppressed_by_baseline": "SELECT count(*) FROM gated WHERE seq % 10 = 1",
    "accepted": "SELECT count(*) FROM batch", "new": "SELECT count(*) FROM merged", "url_upgrades": "SELECT CAST(sum(url_upgrades) AS BIGINT) FROM merged",
    "deduped_out": "SELECT (SELECT count(*) FROM batch) - (SELECT count(*) FROM merged)", "backlog_unapplied": "SELECT count(*) FROM p WHERE status = 'notified' AND tier IN (1, 2)",
    "baseline_size": "SELECT count(*) FROM p WHERE tier = 1", "expired": "SELECT count(*) FROM p WHERE status = 'expired' AND seq % 50 >= 10", "retired": "SELECT count(*) FROM p WHERE status = 'expired' AND seq % 50 < 10",
}
_HELD = {"sent": "decision = 'interrupt'", "suppressed_rate_cap": "starts_with(decision_reason, 'rate cap')", "suppressed_quiet_hours": "starts_with(decision_reason, 'quiet hours')", "suppressed_backpressure": "contains(decision_reason, 'backpressure')"}
_ROWS = [
    *[f"SELECT '{k}' AS field, NULL::VARCHAR AS source, NULL::VARCHAR AS name, ({v}) AS n" for k, v in _PLAIN.items()], "SELECT 'tiers', NULL, CAST(tier AS VARCHAR), count(*) FROM p GROUP BY tier",
    "SELECT 'scorer', NULL, CASE seq % 5 WHEN 0 THEN 'llm' WHEN 1 THEN 'cached' ELSE 'heuristic' END AS k, count(*) FROM p GROUP BY k", "SELECT 'links', NULL, link_status, count(*) FROM p GROUP BY link_status",
    *[f"SELECT 'notifications', NULL, '{k}', count(*) FILTER ({v}) FROM decided" for k, v in _HELD.items()], "SELECT 'links_by_source', source, link_status, count(*) FROM p GROUP BY source, link_status",
]
#: The counts of the run report.
REPORT = f"{BATCH}, {merged('1')}, {B.POSTINGS_SQL}, {_DECIDED}, counts AS ({' UNION ALL '.join(_ROWS)})"

#: Events by the fifth of their time in which they landed.
BY_TIME = f"e AS (SELECT *, CAST(floor(CAST(epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events) AS DOUBLE) * {TURNS} / ((SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM events) + 1)) AS INT) AS turn FROM events)"

ORACLES: dict[str, str] = {
    "s01_read_listings": f"{RAW} {LISTINGS}",
    "s02_read_board_a": f"{RAW} {BOARD_A}",
    "s03_read_board_b": f"{RAW} {BOARD_B}",
    "s04_read_board_c": f"{RAW} {BOARD_C}",
    "s05_s06_read_pipe_tables": f"{RAW} {TABLES}",
    "s07_target_companies": "SELECT DISTINCT lower(replace(s_name, '#', ' ')) AS company_norm FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 2 = 0",
    "s12_listings_quality": f"""{RAW}, c AS (SELECT seq // {FILE_ROWS} AS chunk, count(*) AS records, count(*) FILTER (NOT ({OPEN})) AS inactive, count(*) FILTER ({OPEN} AND NOT ({FITS})) AS off_category,
  count(*) FILTER ({OPEN} AND {FITS}) AS kept FROM raw GROUP BY 1) SELECT *, kept = 0 AS warned FROM c""",
    "s12_tables_quality": f"{RAW} SELECT seq // {FILE_ROWS} AS chunk, count(*) FILTER ({IN_TABLE}) AS kept, count(*) FILTER ({IN_TABLE}) = 0 AS warned FROM raw GROUP BY 1",
    "s13_u01_union_sources": f"""{RAW} SELECT * FROM (SELECT 0 AS source_order, 'listings' AS source, count(*) AS n, count(*) AS places FROM ({LISTINGS})
UNION ALL SELECT 1, 'swe', count(*), count(*) FROM ({TABLES}) UNION ALL SELECT 3, 'ats', count(*), count(*) FROM ({BOARD_A} UNION ALL {BOARD_B} UNION ALL {BOARD_C})) WHERE n > 0""",
    "s13_u01_places": f"""{RAW}, {PLACED} SELECT 0 AS source_order, 0 AS feed, file, position, title, apply_url FROM ({placed(LISTINGS_KEPT)})
UNION ALL SELECT 1, 0, file, position + 4, replace(title, '|', '/'), apply_url FROM ({placed(IN_TABLE)})
UNION ALL SELECT 3, 0, file, position, title, apply_url FROM ({placed(BOARD_C_KEPT)}) UNION ALL SELECT 3, 1, file, position, title, apply_url FROM ({placed(LINKED)})""",
    "s14_s15_export_restore": f"""{P} SELECT id, company, title, term, location, remote, apply_url, source, first_seen_at, posted_at, posted_precision, tier, score, status, link_status, 'heuristic' AS tier_source,
  array_to_string(disqualifiers, ',') AS disqualifiers FROM p""",
    "s14_changed_parts": f"""{P}, a AS (SELECT substr(id, 1, 2) AS part, id < '8' AND score = 7 AND status <> 'applied' AS hit FROM p)
SELECT part, CASE WHEN part = 'a0' THEN 'new' WHEN part = 'ff' THEN 'gone' ELSE 'changed' END AS change FROM a GROUP BY part HAVING part IN ('a0', 'ff') OR bool_or(hit)""",
    "s16_baseline": f"{P} SELECT DISTINCT id FROM p WHERE tier = 1",
    "s17_archive_replay": f"{RAW} SELECT seq, source, length(substr(repeat(description, 40), 1, 2000)) AS chars FROM raw WHERE seq % 2 = 1",
    "s17_r04_prune_raw": f"""{RAW}, c AS (SELECT 'r' || ((seq % 5) * 3) % 5 AS run_id, seq % 5 AS hour, count(*) AS n FROM raw GROUP BY ALL)
SELECT 'before' AS at, run_id, n FROM c UNION ALL SELECT 'after', run_id, n FROM c WHERE hour IN (SELECT hour FROM c ORDER BY hour DESC LIMIT 3)""",
    "s18_reports": f"""{H}, r AS (SELECT *, max(duration_s) OVER (PARTITION BY started_at) AS d FROM h)
SELECT 'r' || CAST(epoch(started_at) AS BIGINT) AS run_id, started_at, d AS duration_s, source, raw_fetched, new FROM r WHERE started_at >= TIMESTAMP '{SINCE}'""",
    "s19_r03_audit": f"{H} SELECT 'r' || CAST(epoch(started_at) AS BIGINT) AS run_id, CAST(sum(new) AS BIGINT) AS n FROM h WHERE CAST(started_at AS DATE) >= DATE '{TODAY}' - {AUDIT_DAYS} GROUP BY started_at",
    "s19_r03_prune_audit": f"""{H}, d AS (SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, count(DISTINCT started_at) AS n FROM h GROUP BY 1)
SELECT 'gone' AS state, day, NULL AS records FROM d WHERE day < CAST(DATE '{TODAY}' - {AUDIT_DAYS} AS VARCHAR) UNION ALL SELECT 'left', day, n FROM d WHERE day >= CAST(DATE '{TODAY}' - {AUDIT_DAYS} AS VARCHAR)""",
    "j17_rewrite_ids": f"""{BATCH}, m AS (SELECT DISTINCT id, CASE WHEN location_norm = 'nyc' THEN sha256(company_norm || '|' || title_norm || '|new-york|' || term)[1:16] ELSE id END AS fresh FROM batch),
t(held_in, least) AS (VALUES ('postings', '0'), ('sightings', '1'), ('baseline', '2'), ('ledger', '3'), ('cache', '0'))
SELECT held_in, fresh AS id FROM m JOIN t ON substr(id, 16, 1) >= least""",
    "a07_run_report": f"""{REPORT} SELECT * FROM counts""",
    "a07_report_sources": f"""{BATCH} SELECT source, count(*) AS raw_fetched, count(*) FILTER (keep) AS fetched, count(*) FILTER (NOT keep) AS filtered_out, count(*) FILTER (seq % 10 = 1) AS baselined,
  count(*) FILTER (keep) AS term_unknown, (SELECT count(DISTINCT source) FROM gated WHERE keep) AS warnings FROM gated GROUP BY source""",
    "t05_digest_totals": f"""{REPORT}, f AS (SELECT count(*) FILTER (status = 'notified' AND tier IN (1, 2)) AS backlog, count(*) FILTER (shown) AS new, count(*) FILTER (shown AND link_status IN ('dead', 'redirected_to_index')) AS dead_links
  FROM (SELECT *, first_seen_at + INTERVAL 1 DAY >= TIMESTAMP '{B.NOW}' - INTERVAL 24 HOUR AND status NOT IN ('expired', 'skipped') AS shown FROM p))
SELECT backlog, new, dead_links, {", ".join(f"(SELECT n FROM counts WHERE name = 'suppressed_{k}') AS suppressed_{k}" for k in ("rate_cap", "quiet_hours", "backpressure"))} FROM f""",
    "s20_review": f"{P} SELECT id, company, title, term, tier, score, location, apply_url, array_to_string(disqualifiers, '|') AS disqualifiers FROM p",
    "x01_x05_stream_ingest": f"""{BATCH}, {merged(f'seq % {TURNS}')} SELECT id, company, title, term, location, remote, apply_url, source, source_id, source_url, posted_at, posted_precision,
  'new' AS status, 'unchecked' AS link_status FROM merged""",
    "x02_stream_first_seen": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events",
    "x02_first_seen_within": f"""WITH {BY_TIME}, last AS (SELECT CAST(user_id AS VARCHAR) AS id, turn, max(ts) AS seen_at FROM e GROUP BY ALL),
marks AS (SELECT turn, max(max(seen_at)) OVER (ORDER BY turn) - INTERVAL 48 HOUR AS mark FROM last GROUP BY turn),
before AS (SELECT last.*, (SELECT max(mark) FROM marks WHERE marks.turn < last.turn) AS mark FROM last),
told AS (SELECT id, list({{'turn': turn, 'seen_at': seen_at, 'mark': mark, 'kept': true, 'held': seen_at}} ORDER BY turn) AS l FROM before GROUP BY id),
steps AS (SELECT id, unnest(range(1, len(l) + 1)) AS k, l FROM told),
kept AS (SELECT id, list_reduce(l[:k], lambda a, x: {{'turn': x.turn, 'seen_at': x.seen_at, 'mark': x.mark, 'kept': a.held + INTERVAL 48 HOUR <= x.mark,
  'held': CASE WHEN a.held + INTERVAL 48 HOUR <= x.mark THEN x.seen_at ELSE a.held END}}) AS r FROM steps)
SELECT id, r.seen_at AS seen_at FROM kept WHERE r.kept""",
    "x03_push_counts": """WITH w AS (SELECT to_timestamp((epoch(ts)::BIGINT // 600 - k) * 600)::TIMESTAMP AS window_start FROM (SELECT date_trunc('second', ts) AS ts FROM events), range(6) t(k))
SELECT window_start, count(*) AS n FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY window_start""",
    "x04_stream_expiry": f"""WITH {B.HISTORY_SQL}, runs AS (SELECT source, started_at AS run_at FROM h WHERE NOT not_modified),
shown AS (SELECT DISTINCT event_type AS source, CAST(user_id AS VARCHAR) AS id, to_timestamp(floor(epoch(ts) / 21600) * 21600)::TIMESTAMP AS run_at FROM events),
s AS (SELECT shown.* FROM shown JOIN runs USING (source, run_at)),
n AS (SELECT *, lead(run_at) OVER (PARTITION BY source, id ORDER BY run_at) AS again FROM s),
m AS (SELECT *, (SELECT min(r.run_at) FROM runs r WHERE r.source = n.source AND r.run_at > n.run_at) AS missed FROM n),
d AS (SELECT *, (SELECT min(r.run_at) FROM runs r WHERE r.source = m.source AND r.run_at >= m.missed + INTERVAL 48 HOUR) AS due FROM m)
SELECT source, id, min(due) AS expired_at FROM d WHERE (again IS NULL OR due < again) AND due <= (SELECT max(started_at) FROM h) - INTERVAL 6 HOUR GROUP BY ALL""",
}
