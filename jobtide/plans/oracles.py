"""DuckDB SQL for the registered queries, built from the same fixed values."""

from __future__ import annotations

from .. import rules as R
from . import bindings as B

NOW = f"TIMESTAMP '{B.NOW}'"
CUT = f"TIMESTAMP '{B.CUTOVER}'"
q = B.text


def words(phrases: list[str]) -> str:
    return q("|".join(rf"\b{p}\b" for p in phrases))


def basic(x: str) -> str:
    return f"trim(regexp_replace(replace(lower(strip_accents(coalesce({x}, ''))), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def sub(x: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def case(x: str, table: dict, other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items()) + f" ELSE {other} END"


def dates_out(x: str) -> str:
    for p in (R.SEASON_YEAR, R.BARE_YEAR, R.REQUISITION):
        x = sub(x, p)
    return x


def held(values: list[str]) -> str:
    return f"[{', '.join(map(q, values))}]"


def tokens(x: str, dropped: list[str]) -> str:
    return f"list_filter(string_split_regex({x}, ' +'), lambda t: NOT list_contains({held(['', *dropped])}, t))"


PAREN = r"[(\[{]([^)\]}]*)[)\]}]"


def _title_dim() -> str:
    text = "t1"
    text = dates_out(sub(basic(text), R.CLASS_OF))
    for p in R.TITLE_PHRASES_DROPPED:
        text = sub(text, p)
    for p, to in R.TITLE_REWRITES:
        text = sub(text, p, to)
    mark = R.LEVEL_MARK
    inner = f"list_transform(regexp_extract_all(title, {q(PAREN)}, 1), lambda p: CASE WHEN len({tokens(dates_out(basic('p')), [*R.TITLE_NOISE, *R.SEASONS, *R.PAREN_NOISE])}) = 0 THEN ' ' ELSE ' ' || p || ' ' END)"
    return f"""
ta AS (SELECT DISTINCT title FROM raw),
tb AS (SELECT title, string_split_regex(title, {q(PAREN)}) AS o, {inner} AS i FROM ta),
tc AS (SELECT title, array_to_string(list_transform(range(1, len(o) + 1), lambda k: o[k] || coalesce(i[k], '')), '') AS t1 FROM tb),
td AS (SELECT title, array_to_string({tokens(text, [*R.TITLE_NOISE, *R.SEASONS])}, ' ') AS t2 FROM tc),
te AS (SELECT title, t2, trim({sub('t2', rf'(?:\s+{mark})+$', '')}) AS stem, regexp_extract(t2, {q(rf'\s+({mark})$')}, 1) AS mark FROM td),
tf AS (SELECT title, string_split(stem, ' ') AS w, CASE WHEN regexp_extract(mark, '([0-9]+)$', 1) <> '' THEN CAST(regexp_extract(mark, '([0-9]+)$', 1) AS INT)
    ELSE {case("regexp_extract(mark, '([a-z]+)$', 1)", R.LEVEL_WORDS, 'NULL')} END AS level FROM te),
tdim AS (SELECT title, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: k = 1 OR w[k] <> w[k - 1]), lambda k: w[k]), ' ')
    || CASE WHEN level > 1 THEN ' l' || level ELSE '' END AS title_norm FROM tf)"""


def _company_dim() -> str:
    name = f"regexp_replace(regexp_replace({basic('company')}, '^the ', ''), {q('((^| )(' + '|'.join(R.LEGAL_SUFFIXES) + '))+$')}, '')"
    return f"cdim AS (SELECT company, {case('n', R.COMPANY_ALIASES, 'n')} AS company_norm FROM (SELECT company, {name} AS n FROM (SELECT DISTINCT company FROM raw)))"


def _primary(x: str) -> str:
    parts = f"list_filter(list_transform(string_split_regex(trim(coalesce({x}, '')), {q(R.SEVERAL_PLACES)}), lambda s: trim(s)), lambda s: s <> '')"
    return f"(SELECT coalesce(CASE WHEN regexp_full_match(a[2], '[[:alpha:]]{{1,3}}') THEN a[1] || ' ' || a[2] ELSE a[1] END, '') FROM (SELECT {parts} AS a))"


def _remote(x: str, hint: str) -> str:
    return f"coalesce({hint}, NOT contains({basic(x)}, 'hybrid') AND ({' OR '.join(f'contains({basic(x)}, {q(m)})' for m in R.REMOTE_MARKERS)}))"


def _location_dim() -> str:
    states = "p0"
    for name in sorted(R.STATE_NAMES, key=len, reverse=True):
        states = sub(states, rf"\b{name}\b", R.STATE_NAMES[name])
    tail = rf"\s*\b({'|'.join(sorted(R.COUNTRIES, key=len, reverse=True))})\s*$"
    aliases = [(a, m) for m, names in R.METROS.items() for a in names]
    rows = ", ".join(f"({q(a)}, {q(m)}, {q(' '.join(R.METRO_STATES.get(m, [])))}, {len(a)}, {i})" for i, (a, m) in enumerate(aliases))
    marked = " OR ".join(f"contains(core, {q(m)})" for m in R.REMOTE_MARKERS)
    return f"""
la AS (SELECT DISTINCT location, remote_hint FROM raw),
lb AS (SELECT *, {basic('prim')} AS p0 FROM (SELECT *, {_primary('location')} AS prim FROM la)),
lc AS (SELECT *, {states} AS primary_ FROM lb),
ld AS (SELECT *, trim(regexp_replace(primary_, {q(tail)}, '')) AS core, {case(f"regexp_extract(primary_, {q(tail)}, 1)", R.COUNTRIES, 'NULL')} AS country FROM lc),
le AS (SELECT *, CASE WHEN list_contains({held(R.STATES)}, regexp_extract(core, '\\b([a-z]{{2}})$', 1)) THEN regexp_extract(core, '\\b([a-z]{{2}})$', 1) END AS state FROM ld),
al(alias, metro, states, n, i) AS (VALUES {rows}),
lf AS (SELECT location, remote_hint, metro, row_number() OVER (PARTITION BY location, remote_hint ORDER BY no, n DESC, i) AS rn
  FROM (SELECT location, remote_hint, state, 0 AS no, primary_ AS t FROM le UNION ALL SELECT location, remote_hint, state, 1, core FROM le) c
  JOIN al ON contains(' ' || t || ' ', ' ' || alias || ' ') WHERE state IS NULL OR states = '' OR list_contains(string_split(states, ' '), state)),
ldim AS (SELECT le.location, le.remote_hint, CASE
    WHEN {basic('le.location')} = '' OR primary_ = '' OR list_contains({held(R.PLACELESS)}, p0) THEN 'unknown' WHEN core = '' THEN coalesce(country, 'unknown')
    WHEN metro IS NOT NULL THEN metro WHEN state IS NOT NULL THEN 'us-' || state WHEN {_remote('le.location', 'le.remote_hint')} OR {marked} THEN 'remote'
    WHEN regexp_matches(core, {q(R.PLACEHOLDER)}) THEN 'unknown' ELSE replace(core, ' ', '-') || coalesce('-' || country, '') END AS location_norm
  FROM le LEFT JOIN lf ON le.location IS NOT DISTINCT FROM lf.location AND le.remote_hint IS NOT DISTINCT FROM lf.remote_hint AND lf.rn = 1)"""


def _term_in(x: str) -> str:
    def first(pattern: str, season: int, year: int) -> str:
        s, y = f"regexp_extract_all({x}, {q(pattern)}, {season})", f"regexp_extract_all({x}, {q(pattern)}, {year})"
        terms = {f"{name}{full % 100}": term for (name, full), term in R.TERM_OF_SEASON.items()}
        return f"list_filter(list_transform(range(1, len({s}) + 1), lambda k: {case(f'{s}[k] || {y}[k]', terms, 'NULL')}), lambda v: v IS NOT NULL)[1]"

    grad = " OR ".join(f"contains({x}, {q(m)})" for m in R.NEW_GRAD_MARKERS)
    grad += f" OR regexp_matches({x}, '\\bclass of (?:20)?27\\b') OR (starts_with({x}, 'graduate ') AND NOT regexp_matches({x}, '^graduate research\\b') AND NOT regexp_matches({x}, '\\b(intern|internship|co op|coop)\\b'))"
    return f"coalesce({first(R.SEASON_YEAR, 1, 2)}, {first(R.YEAR_SEASON, 2, 1)}, CASE WHEN {grad} THEN 'new-grad' END)"


TERM_DIM = f"""
ua AS (SELECT DISTINCT title, description, term_default FROM raw),
ub AS (SELECT *, {basic('title')} AS tb, {basic('description')} AS db FROM ua),
udim AS (SELECT title, description, term_default, coalesce({_term_in('tb')}, {_term_in('db')}, CASE WHEN list_contains({held(R.TERMS)}, lower(trim(term_default))) THEN lower(trim(term_default)) END, 'unknown') AS term FROM ub)"""


def _level_case() -> str:
    has = lambda p: f"regexp_matches(tb, {words(p)})"
    rest = f"regexp_replace(tb, {words(R.ALLOWED_TITLES)}, ' ', 'g')"
    body = " OR ".join(f"contains(lower(description), {q(p)})" for p in R.EARLY_BODY)
    return f"""CASE WHEN tb = '' THEN 'empty-title' WHEN {has(R.NON_ENGINEERING)} AND NOT ({has(R.EARLY)} AND {has(R.ENGINEERING)}) THEN 'non-engineering-function'
    WHEN {has(R.EARLY)} THEN 'early-career' WHEN {has(R.ALLOWED_TITLES)} THEN CASE WHEN regexp_matches({rest}, {words(R.PLAINLY_SENIOR)}) THEN 'senior-level' ELSE 'allowlist-title' END
    WHEN {has(R.SENIOR)} THEN 'senior-level' WHEN NOT {has(R.ENGINEERING)} THEN 'not-engineering' WHEN years >= {R.MAX_YEARS} THEN 'experience-required'
    WHEN source <> 'ats' THEN 'engineering-unleveled' WHEN {body} THEN 'early-career-body' ELSE 'unleveled-no-early-signal' END"""


def _field_case() -> str:
    out = f"CASE WHEN tb = '' THEN 'discipline-empty-title' WHEN regexp_matches(tb, {words(R.AUDIENCE)}) THEN 'discipline-audience-facing' WHEN regexp_matches(hb, {words(R.TECHNICAL)}) THEN 'discipline-technical' "
    groups = lambda x: " ".join(f"WHEN regexp_matches({x}, {words(p)}) THEN 'discipline-{g}'" for g, p in R.NON_TECHNICAL.items())
    return out + groups("hb") + f" WHEN regexp_matches(tb, {words(R.TECHNICAL)}) THEN 'discipline-technical' " + groups("tb") + f" WHEN regexp_matches(tb, {words(R.WEAK)}) THEN 'discipline-weak-signal' ELSE 'discipline-not-technical' END"


YEARS = f"list_min(list_filter(list_transform(regexp_extract_all(coalesce(description, ''), {q('(?i)' + R.YEARS)}, 1), lambda y: CAST(y AS INT)), lambda y: y > 0 AND y <= 30))"
HEAD = f"trim(string_split_regex(title, {q(R.ROLE_HEAD_END)})[1])"
GATES = f"""
ga AS (SELECT *, {basic('title')} AS tb, {basic(HEAD)} AS h0, {YEARS} AS years FROM raw),
gb AS (SELECT *, CASE WHEN h0 = '' THEN tb ELSE h0 END AS hb FROM ga),
gc AS (SELECT *, {_level_case()} AS level_reason, {_field_case()} AS f0 FROM gb),
gd AS (SELECT *, level_reason IN ('early-career', 'allowlist-title', 'engineering-unleveled', 'early-career-body') AS passed FROM gc),
gated AS (SELECT *, CASE WHEN passed THEN f0 END AS field_reason, passed AND f0 IN ('discipline-technical', 'discipline-weak-signal') AS keep, CASE WHEN passed THEN f0 ELSE level_reason END AS reason FROM gd)"""


def normalized(source: str, name: str) -> str:
    key = "company_norm || '|' || title_norm || '|' || location_norm || '|' || term"
    return f"""
{name}_a AS (SELECT r.*, title_norm, company_norm, location_norm, u.term AS term FROM {source} r JOIN tdim USING (title) JOIN cdim USING (company)
  JOIN ldim ON r.location IS NOT DISTINCT FROM ldim.location AND r.remote_hint IS NOT DISTINCT FROM ldim.remote_hint
  JOIN udim u ON r.title IS NOT DISTINCT FROM u.title AND r.description IS NOT DISTINCT FROM u.description AND r.term_default IS NOT DISTINCT FROM u.term_default),
{name} AS (SELECT * EXCLUDE (company, title, location, apply_url, remote_hint), {key} AS dedupe_key, sha256({key})[1:16] AS id, trim(company) AS company, trim(title) AS title,
  CASE WHEN trim(location) = '' THEN 'Unknown' ELSE trim(location) END AS location, {_remote('location', 'remote_hint')} AS remote, trim(apply_url) AS apply_url,
  nullif(trim(apply_url), '') AS source_url FROM {name}_a)"""


DIMS = ",".join([_title_dim(), _company_dim(), _location_dim(), TERM_DIM])
BATCH = f"WITH {B.RAW_SQL}, {GATES}, {DIMS}, {normalized('(SELECT * FROM gated WHERE keep)', 'batch')}"
BASELINE = f"base AS (SELECT DISTINCT id FROM batch WHERE posted_at < {CUT} AND id[1] IN ('0', '1', '2', '3', '4'))"
CUTOVER = f"""{BATCH}, {BASELINE}, flags AS (
  SELECT b.*, base.id IS NOT NULL AS known, coalesce(bool_or(base.id IS NOT NULL AND coalesce(posted_at > {CUT}, false)) OVER (PARTITION BY b.id ORDER BY source_order, seq ROWS UNBOUNDED PRECEDING), false) AS promoted
  FROM batch b LEFT JOIN base ON b.id = base.id)"""
P, H, L = f"WITH {B.POSTINGS_SQL}", f"WITH {B.HISTORY_SQL}", f"WITH {B.LINKS_SQL}"
LIVE = "status NOT IN ('expired', 'skipped')"
LOCAL = lambda x: f"timezone('{R.READER_ZONE}', timezone('UTC', {x}))"
DAY = f"CASE WHEN posted_precision = 'date' THEN CAST(coalesce(posted_at, first_seen_at) AS DATE) ELSE CAST({LOCAL('coalesce(posted_at, first_seen_at)')} AS DATE) END"


def age(now: str) -> str:
    hours = f"CAST(floor((epoch_us({now}) - epoch_us(coalesce(posted_at, first_seen_at))) / 3600000000) AS BIGINT)"
    text = f"CASE WHEN {hours} < 1 THEN 'just posted' WHEN {hours} < 24 THEN {hours} || 'h old' ELSE CAST(floor({hours} / 24) AS BIGINT) || 'd old' END"
    return f"CASE WHEN posted_at IS NOT NULL AND posted_precision <> 'instant' THEN '~' ELSE '' END || {text}"


def fresh(now: str) -> str:
    return f"coalesce(posted_at IS NOT NULL AND CASE WHEN posted_precision = 'instant' THEN epoch_us({now}) - epoch_us(posted_at) <= 172800000000 ELSE {DAY} >= CAST({LOCAL(now)} AS DATE) - 1 END, false)"


TERM_RANK = case("term", {t: i for i, t in enumerate(R.TERM_ORDER)}, "9")
RANK = {"date": f"{DAY} DESC, tier, score DESC, id DESC", "score": f"score DESC, {DAY} DESC, tier, id DESC"}


def ranked(mode: str) -> str:
    return f"{P} SELECT term, place, id FROM (SELECT *, row_number() OVER (PARTITION BY {TERM_RANK} ORDER BY {RANK[mode]}) AS place FROM p WHERE {LIVE}) WHERE place <= 10"


def ranked_all(mode: str) -> str:
    return f"{P} SELECT term, row_number() OVER (PARTITION BY {TERM_RANK} ORDER BY {RANK[mode]}) AS place, id FROM p WHERE {LIVE}"


def signals(now: str) -> str:
    """Rows (id, n, signal, points, words) of all postings ``p``."""
    term = case("term", R.TERM_POINTS, "10")
    label, points = "NULL", "NULL"
    for pattern, n, name in reversed(R.DISCIPLINES):
        label = f"CASE WHEN regexp_matches(title_norm, {q(pattern)}) THEN {q(name)} ELSE {label} END"
        points = f"CASE WHEN regexp_matches(title_norm, {q(pattern)}) THEN {n} ELSE {points} END"
    metro = case("location_norm", R.METRO_POINTS, "NULL")
    days = f"floor((epoch_us({now}) - epoch_us(posted_at)) / 86400000000)"
    target = f"company_norm IN ({', '.join(map(q, B.TARGETS))})"
    return f"""sig AS (
  SELECT id, 0 AS n, 'term:' || term AS signal, {term} AS points, 'term ' || term || ' +' || {term} AS words FROM p
  UNION ALL SELECT id, 1, 'discipline:' || {label}, {points}, {label} || ' +' || {points} FROM p WHERE {label} IS NOT NULL
  UNION ALL SELECT id, 2, 'target-company', 20, 'target company +20' FROM p WHERE {target}
  UNION ALL SELECT id, 3, 'metro:' || location_norm, {metro}, location_norm || ' +' || {metro} FROM p WHERE {metro} IS NOT NULL
  UNION ALL SELECT id, 4, 'remote', 4, 'remote +4' FROM p WHERE remote
  UNION ALL SELECT id, 5, CASE WHEN {days} <= 2 THEN 'recency:<2d' WHEN {days} <= 7 THEN 'recency:<1w' ELSE 'recency:stale' END,
    CASE WHEN {days} <= 2 THEN 8 WHEN {days} <= 7 THEN 4 ELSE -8 END, CASE WHEN {days} <= 2 THEN 'posted <2d +8' WHEN {days} <= 7 THEN 'posted <1w +4' ELSE 'posted >45d -8' END
    FROM p WHERE {days} <= 7 OR {days} > 45
  UNION ALL SELECT id, 6, 'term-not-wanted', -40, term || ' not wanted -40' FROM p WHERE term = 'summer-2027'),
scored AS (SELECT p.*, {target} AS is_target, greatest(0, least(100, t.s)) AS heuristic_score, t.words AS heuristic_trace FROM p
  JOIN (SELECT id, sum(points) AS s, string_agg(words, '; ' ORDER BY n) AS words FROM sig GROUP BY id) t USING (id))"""


TIER = lambda s: f"CASE WHEN len(disqualifiers) > 0 THEN 3 WHEN {s} >= {R.TIER1} AND is_target THEN 1 WHEN term = 'new-grad' AND is_target AND {s} >= {R.TIER1_NEW_GRAD} THEN 1 WHEN {s} >= {R.TIER2} THEN 2 ELSE 3 END"
SCORED = f"{P}, {signals(NOW)}"
DECISIONS = """d0 AS (SELECT id, seq * 2 + o AS row_no, lower(trim(['Applied', 'skipped ', '', 'maybe', 'Interviewing', 'rejected'][CAST((seq // 4 + 2 * o) % 6 AS BIGINT) + 1])) AS word
    FROM p, (VALUES (0), (1)) v(o) WHERE seq % 4 = 0),
d1 AS (SELECT id, row_no, CASE word WHEN 'applied' THEN 'applied' WHEN 'interviewing' THEN 'applied' WHEN 'skipped' THEN 'skipped' WHEN 'rejected' THEN 'skipped' END AS st FROM d0),
dec AS (SELECT id, arg_max(st, row_no) AS st FROM d1 WHERE st IS NOT NULL GROUP BY id)"""


def decided(at: str, quiet: bool) -> str:
    return f"""{P}, ctx AS (SELECT (SELECT count(*) FROM p WHERE status = 'notified' AND tier = 1 AND seq * 3 <= 60) AS sent, (SELECT count(*) FROM p WHERE status = 'notified' AND tier IN (1, 2)) AS backlog),
o AS (SELECT p.*, sent, backlog, seq % 50 = 0 AS base, status IN ('notified', 'applied', 'skipped', 'expired') AS done, len(disqualifiers) > 0 OR tier = 3 AS low FROM p, ctx),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, seq, id) AS rk FROM o WHERE NOT base AND NOT done AND NOT low AND tier = 1),
decided AS (SELECT o.*, CASE WHEN base OR done THEN 'skip' WHEN low OR tier = 2 THEN 'digest' WHEN {str(quiet).lower()} THEN 'silent' WHEN rk <= greatest(0, 3 - sent) THEN 'interrupt' ELSE 'digest' END AS decision,
  CASE WHEN base THEN 'baseline: seen before cutover' WHEN done THEN 'already ' || status WHEN low THEN 'tier 3'
    WHEN tier = 2 THEN CASE WHEN backlog > 15 THEN 'tier 2 digest-only; backpressure (' || backlog || ' unapplied > 15)' ELSE 'tier 2 digest-only' END
    WHEN {str(quiet).lower()} THEN 'quiet hours: tier 1 downgraded' WHEN rk <= greatest(0, 3 - sent) THEN 'tier 1' ELSE 'rate cap: 3/hour already sent' END AS decision_reason
  FROM o LEFT JOIN r USING (id))"""


PRIORITY = "CASE decision WHEN 'interrupt' THEN 5 WHEN 'silent' THEN 2 ELSE 3 END AS priority"


def _path(x: str) -> str:
    return f"regexp_extract(coalesce({x}, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _host(x: str) -> str:
    return f"lower(regexp_extract(coalesce({x}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


_QUERY = "regexp_extract(final_url, '^[^?#]*\\?([^#]*)', 1)"
_HAS = (
    f"(regexp_matches({_path('final_url')}, {q(R.UUID)}) OR regexp_matches({_path('final_url')}, '/[0-9]{{5,}}') OR lower(regexp_extract({_path('final_url')}, {q(R.JOB_PATH)}, 1)) NOT IN ('', 'search', 'all', 'list') "
    f"OR list_has_any(list_transform(list_filter(string_split({_QUERY}, '&'), lambda s: regexp_matches(s, '^[^=]+=.')), lambda s: lower(string_split(s, '=')[1])), {held(R.ID_PARAMS)}))"
)
_BOARD = "(" + " OR ".join(f"ends_with({_host('final_url')}, {q(h)}) OR contains({_host('final_url')}, {q('.' + h)})" for h in R.BOARD_HOSTS) + ")"
_INDEX = f"(NOT {_HAS} AND (regexp_matches(CASE WHEN {_path('final_url')} = '' THEN '/' ELSE {_path('final_url')} END, {q(R.INDEX_PATH)}) OR ({_BOARD} AND len(list_filter(string_split({_path('final_url')}, '/'), lambda s: s <> '')) <= 1)))"
_KEY = f"array_to_string(string_split({_host('final_url')}, '.')[-2:], '.')"
_BLOCKED = "(" + " OR ".join(f"{_host('final_url')} = {q(h)} OR ends_with({_host('final_url')}, {q('.' + h)})" for h in R.BLOCKED_HOSTS) + ")"
_VERDICT = f"CASE WHEN http_status IN (404, 410, 451) THEN 'dead' WHEN http_status IN (401, 403, 429) THEN 'blocked' WHEN http_status >= 400 THEN 'unreachable' WHEN {_INDEX} THEN 'redirected_to_index' ELSE 'ok' END"
FORMULA = lambda x: f"CASE WHEN regexp_matches(coalesce({x}, ''), '^[=+\\-@\\t\\r]') THEN '''' || {x} ELSE coalesce({x}, '') END"
TRAIL = "OVER (PARTITION BY source ORDER BY started_at ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
HOURS = f"""{P}, hr AS (SELECT hour({LOCAL('posted_at')}) AS hour, epoch_us(posted_at) % 86400000000 = 0 AS mid, isodow({LOCAL('posted_at')}) < 6 AS wd FROM p WHERE source IN ('ats', 'listings') AND posted_at IS NOT NULL)"""

RANK_OF = lambda x: f"CASE {x} WHEN 'ats' THEN 100 ELSE 50 END"


def merged(odd: str) -> str:
    """The merge of a batch: rows where ``odd`` is 0 are the state, those where it is 1 the batch; links by a fold."""
    order = "ORDER BY odd, source_order, seq"
    fold = (
        "list_reduce(l, lambda acc, x: CASE WHEN acc.url = '' OR (x.url <> '' AND (x.source = acc.source OR "
        + RANK_OF("x.source") + " > " + RANK_OF("acc.source")
        + ")) THEN {'url': x.url, 'source': x.source, 'odd': x.odd, 'steps': acc.steps + CASE WHEN x.odd = 1 AND x.url <> '' AND x.url <> acc.url THEN 1 ELSE 0 END} ELSE acc END)"
    )
    first = lambda c: f"list({c} {order})[1] AS {c}"
    return f"""seqs AS (SELECT *, {odd} AS odd FROM batch),
grp AS (SELECT id, {first('company')}, {first('title')}, {first('term')}, {first('title_norm')}, {first('company_norm')}, {first('location_norm')}, {first('posted_precision')},
  list(location {order})[-1] AS location, list(remote {order})[-1] AS remote, (list(source_id {order}) FILTER (source_id IS NOT NULL))[-1] AS source_id,
  (list(source_url {order}) FILTER (source_url IS NOT NULL))[1] AS source_url, (list(posted_at {order}) FILTER (posted_at IS NOT NULL))[1] AS posted_at,
  min(odd) = 1 AS is_new, list({{'url': apply_url, 'source': source, 'odd': odd, 'steps': 0}} {order}) AS l FROM seqs GROUP BY id),
merged AS (SELECT * EXCLUDE (l, f), f.url AS apply_url, f.source AS source, f.steps AS url_upgrades FROM (SELECT *, {fold} AS f FROM grp))"""


FLAGSHIP = f"""{BATCH}, {merged('1')}, dq AS (SELECT id, list(disqualifiers ORDER BY source_order, seq)[1] AS disqualifiers FROM (SELECT batch.id, source_order, seq,
  list_filter([CASE WHEN regexp_matches(t, {q('(?i)' + R.CLEARANCE)}) AND regexp_matches(t, {q('(?i)' + R.ALREADY_HELD)}) AND NOT regexp_matches(t, {q('(?i)' + R.OBTAINABLE)}) THEN 'clearance' END,
  CASE WHEN regexp_matches(t, {q('(?i)' + R.US_PERSON)}) OR coalesce(sponsorship, '') = 'U.S. Citizenship is Required' THEN 'citizenship' END,
  CASE WHEN regexp_matches(t, {q('(?i)' + R.NO_SPONSORSHIP)}) OR coalesce(sponsorship, '') = 'Does Not Offer Sponsorship' THEN 'no-sponsorship' END,
  CASE WHEN degrees IS NOT NULL THEN CASE WHEN degrees = ['PhD'] THEN 'phd-required' WHEN NOT list_contains(degrees, 'Bachelor''s') THEN 'masters-required' END
    WHEN regexp_matches(t, {q('(?i)' + R.PHD)}) THEN 'phd-required' WHEN regexp_matches(t, {q('(?i)' + R.MASTERS)}) AND NOT regexp_matches(t, {q('(?i)' + R.BACHELORS)}) THEN 'masters-required' END,
  CASE WHEN term = 'summer-2027' THEN 'summer-only' END], lambda x: x IS NOT NULL) AS disqualifiers
  FROM (SELECT batch.*, raw.title || chr(10) || raw.description AS t FROM batch JOIN raw USING (seq)) batch) GROUP BY id),
p AS (SELECT merged.*, {NOW} AS first_seen_at, coalesce(dq.disqualifiers, []) AS disqualifiers FROM merged LEFT JOIN dq USING (id)), {signals(NOW)},
ranked AS (SELECT *, CAST(heuristic_score AS INT) AS score, {TIER('heuristic_score')} AS tier FROM scored)
SELECT * FROM (SELECT term, row_number() OVER (PARTITION BY {TERM_RANK} ORDER BY {RANK['date']}) AS place, id, company, title, location_norm, tier, score, heuristic_trace FROM ranked) WHERE place <= 20"""

def health(runs: str) -> str:
    """Verdicts over the runs of a table: the last 20 of a source, and of these those of eight days."""
    entry = "{'at': started_at, 'b': CASE WHEN NOT not_modified AND responding > 0 THEN responding END, 'r': CASE WHEN NOT not_modified AND raw_fetched > 0 THEN raw_fetched END, 's': CASE WHEN dated > 0 THEN midnight / dated END}"
    of = lambda k: f"list_filter(list_transform(list_filter(l, lambda x: x.at >= started_at - INTERVAL 8 DAY), lambda x: CAST(x.{k} AS DOUBLE)), lambda v: v IS NOT NULL)"
    return f"""{H}, l AS (SELECT *, coalesce(list({entry}) {TRAIL}, []) AS l,
  max(started_at) FILTER (NOT not_modified AND raw_fetched > 0) OVER (PARTITION BY source ORDER BY started_at RANGE BETWEEN INTERVAL 8 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS la FROM {runs}),
a AS (SELECT *, coalesce(responding, raw_fetched) AS measured, responding IS NOT NULL AS b, list_aggregate({of('b')}, 'median') AS mb, len({of('b')}) AS nb, list_aggregate({of('r')}, 'median') AS mr, len({of('r')}) AS nr,
  list_aggregate({of('s')}, 'median') AS ms, len({of('s')}) AS ns FROM l),
c AS (SELECT *, CASE WHEN NOT not_modified AND CASE WHEN b THEN nb ELSE nr END >= 3 THEN CASE WHEN b THEN mb ELSE mr END END AS median,
  CASE WHEN dated >= 30 AND midnight IS NOT NULL AND ns >= 3 THEN ms END AS mm FROM a),
d AS (SELECT *, coalesce(median IS NOT NULL AND (measured = 0 OR measured / median < 0.5), false) AS vd, coalesce(not_modified AND epoch(started_at) - epoch(la) >= 604800, false) AS st, coalesce(abs(midnight / dated - mm) >= 0.25, false) AS pd FROM c)"""


HEALTH = health("h")
VERDICTS = "SELECT source, started_at, measured, median, round(measured / median, 9) AS ratio, vd AS volume_drop, st AS stale_304, round(mm, 9) AS midnight_median, pd AS precision_drift, NOT (vd OR st OR pd) AS ok FROM d"
UNIT = "CASE WHEN b THEN 'boards responding' ELSE 'raw postings' END"
even = lambda x: f"CAST(round_even({x}, 0) AS BIGINT)"

_SOURCED = f"""{P}, s AS (SELECT *, ['llm', 'cached', 'heuristic', 'llm'][CAST(seq % 4 AS INT) + 1] AS tier_source FROM p)"""

ORACLES: dict[str, str] = {
    "ranked_postings": FLAGSHIP,
    "j10_cache_scores": f"""{_SOURCED} SELECT id AS posting_id, 1 AS score, 'old' AS rationale, tier_source, {NOW} AS scored_at, 'm1' AS model FROM s WHERE seq % 5 = 0
UNION ALL SELECT id, score, 'because ' || seq, tier_source, {NOW} + INTERVAL 1 HOUR, 'm2' FROM s WHERE seq % 5 <> 0 AND tier_source = 'llm'""",
    "c04_scorer_counts": f"{_SOURCED} SELECT tier_source, count(*) AS n FROM s GROUP BY tier_source",
    "c05_suppression_counts": f"""{decided('2001-08-03 20:00:00', False)} SELECT count(*) FILTER (starts_with(decision_reason, 'rate cap')) AS rate_cap, count(*) FILTER (starts_with(decision_reason, 'quiet hours')) AS quiet_hours,
  count(*) FILTER (contains(decision_reason, 'backpressure')) AS backpressure FROM decided""",
    "t06_off_cycle": f"{P} SELECT count(*) FILTER (term IN ({', '.join(q(t) for t in R.TERM_ORDER[:3])})) AS off_cycle FROM p",
    "t07_stable_sample": f"""{P}, g AS (SELECT count(*) || ':' || coalesce(bit_xor(CAST('0x' || substr(md5(id), 1, 15) AS BIGINT)), 0) AS digest FROM p)
SELECT id, title FROM p, g ORDER BY md5(digest || ':' || id), id LIMIT 20""",
    "j02_upsert_postings": f"""{BATCH}, {merged('seq % 2')} SELECT id, company, title, term, location, remote, apply_url, source, source_id, source_url, posted_at, posted_precision,
  'new' AS status, 'unchecked' AS link_status, is_new, url_upgrades FROM merged""",
    "a07_run_totals": f"""{BATCH}, {merged('1')} SELECT (SELECT count(*) FROM gated) AS raw_fetched, (SELECT count(*) FROM gated WHERE NOT keep) AS filtered_out, 0 AS suppressed_by_baseline,
  (SELECT count(*) FROM batch) AS accepted, (SELECT count(*) FROM merged) AS new, (SELECT CAST(sum(url_upgrades) AS BIGINT) FROM merged) AS url_upgrades, (SELECT count(*) FROM batch) - (SELECT count(*) FROM merged) AS deduped_out""",
    "j17_rekey": f"""{BATCH}, m AS (SELECT DISTINCT id AS old, sha256(company_norm || '|' || title_norm || '|new-york|' || term)[1:16] AS new FROM batch WHERE location_norm IN ('nyc', 'sf-bay'))
SELECT old, new, count(*) OVER (PARTITION BY new) > 1 AS collides FROM m""",
    "j03_seen": f"{P} SELECT seq, id, dedupe_key FROM (SELECT seq, id, company_norm || '|' || title_norm || '|' || term AS dedupe_key FROM p) b WHERE id IN (SELECT id FROM p WHERE tier = 1) OR dedupe_key IN (SELECT company_norm || '|' || title_norm || '|' || term FROM p WHERE tier = 1 AND status = 'applied' AND company_norm <> 'meta')",
    "j09_collapse_to_baseline": f"{P} SELECT DISTINCT id, {NOW} AS seeded_at FROM p",
    "j14_unknown_words": f"{P}, {DECISIONS} SELECT d0.row_no, d0.id, d0.word FROM d0 WHERE word NOT IN ('', 'applied', 'interviewing', 'skipped', 'rejected')",
    "c06_record_notifications": f"""{decided('2001-08-03 08:00:00', True)} SELECT id AS posting_id, tier, last_seen_at AS sent_at FROM p WHERE status = 'notified'
UNION ALL SELECT id, tier, TIMESTAMP '2001-08-03 08:00:00' FROM decided WHERE decision IN ('interrupt', 'silent')""",
    "c07_notifications_since": f"""{P}, s AS (SELECT tier FROM p WHERE status = 'notified' AND last_seen_at >= {NOW} - INTERVAL 400 DAY)
SELECT 'all' AS tier, count(*) AS n FROM s UNION ALL SELECT '1', count(*) FILTER (tier = 1) FROM s""",
    "t08_sample_exclusions": f"WITH {B.RAW_SQL}, {GATES} SELECT seq, reason AS filter_reason FROM gated WHERE NOT keep AND reason = 'senior-level' ORDER BY md5('0:' || seq), seq LIMIT 20",
    "n01_basic_text": f"SELECT doc_id, md5({basic('text')}) AS basic_md5 FROM documents",
    "n02_normalize_company": f"WITH {B.RAW_SQL}, {_company_dim()} SELECT company, company_norm, count(*) AS n FROM raw JOIN cdim USING (company) GROUP BY ALL",
    "n04_normalize_title": f"WITH {B.RAW_SQL}, {_title_dim()} SELECT title, title_norm, count(*) AS n FROM raw JOIN tdim USING (title) GROUP BY ALL",
    "n09_normalize_location": f"WITH {B.RAW_SQL}, {_location_dim()} SELECT raw.location, raw.remote_hint, location_norm, count(*) AS n FROM raw JOIN ldim ON raw.location IS NOT DISTINCT FROM ldim.location AND raw.remote_hint IS NOT DISTINCT FROM ldim.remote_hint GROUP BY ALL",
    "n10_infer_term": f"WITH {B.RAW_SQL}, {TERM_DIM} SELECT seq, term FROM raw JOIN udim u ON raw.title IS NOT DISTINCT FROM u.title AND raw.description IS NOT DISTINCT FROM u.description AND raw.term_default IS NOT DISTINCT FROM u.term_default",
    "n12_normalize_postings": f"WITH {B.RAW_SQL}, {DIMS}, {normalized('raw', 'b')} SELECT seq, id, dedupe_key, term, location, remote, source_url FROM b",
    "n13_n14_head_and_years": f"WITH {B.RAW_SQL} SELECT seq, {HEAD} AS head, {YEARS} AS years FROM raw",
    "n15_n16_day_and_age": f"{P} SELECT seq, posted_precision, {DAY} AS day, {age(NOW)} AS age, {fresh(NOW)} AS fresh FROM p",
    "s08_s09_timestamps": f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) WHEN 2 THEN date_trunc('second', ts) END AS parsed,
  CASE WHEN event_id % 6 < 5 THEN {NOW} - to_seconds((event_id % 40) * [3600, 86400, 604800, 2592000, 31536000][CAST(event_id % 6 AS BIGINT) + 1]) END AS posted_at FROM events""",
    "n17_n21_links": f"""{L} SELECT id, {_HAS} AS has_id, {_INDEX} AS is_index, {_BLOCKED} AS blocked_host, {_VERDICT} AS verdict,
  CASE {_VERDICT} WHEN 'blocked' THEN 'HTTP ' || http_status || ' - bot protection, verdict unknown' WHEN 'dead' THEN 'HTTP ' || http_status WHEN 'unreachable' THEN 'HTTP ' || http_status
    WHEN 'redirected_to_index' THEN CASE WHEN final_url <> url THEN 'redirected to a board index' ELSE 'URL carries no requisition id' END END AS note, {_KEY} AS host_key FROM links""",
    "n22_n23_mirror_rows": f"""{P} SELECT {FORMULA('id')} AS id, {FORMULA('company')} AS company, {FORMULA('title')} AS title, term, CAST(tier AS VARCHAR) AS tier,
  {FORMULA("location || CASE WHEN remote THEN ' / remote' ELSE '' END")} AS location, coalesce(CASE WHEN posted_at IS NOT NULL THEN strftime({DAY}, '%Y-%m-%d') END, '') AS posted_date, apply_url FROM p""",
    "n24_redact_secrets": "SELECT conv_id, turn, md5(replace(replace(text, 'and therhean is the is esndha', '[redacted]'), 'therhean is the is', '[redacted]')) AS clean_md5 FROM conversations",
    "n26_parse_applied_on": "SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 < 3 OR (o_orderkey % 5 = 4 AND day(o_orderdate) > 12) THEN CAST(o_orderdate AS DATE) END AS applied_on FROM orders",
    "n28_parse_model_reply": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(greatest(0, least(100, trunc(value))) AS INT) END AS score, CASE WHEN event_id % 3 = 0 THEN 'fits (a; b)' END AS rationale FROM events",
    "f01_f04_gates": f"WITH {B.RAW_SQL}, {GATES} SELECT seq, level_reason, field_reason, keep, reason FROM gated",
    "a01_gate_reason_counts": f"WITH {B.RAW_SQL}, {GATES} SELECT 'level' AS gate, source, level_reason AS reason, count(*) AS n FROM gated GROUP BY ALL UNION ALL SELECT 'field', source, field_reason, count(*) FROM gated WHERE field_reason IS NOT NULL GROUP BY ALL",
    "f05_clearance_finding": f"""WITH {B.RAW_SQL}, c AS (SELECT seq, title || chr(10) || description AS t FROM raw),
m AS (SELECT seq, t, regexp_matches(t, {q('(?i)' + R.CLEARANCE)}) AS hit, regexp_matches(t, {q('(?i)' + R.OBTAINABLE)}) AS may, regexp_matches(t, {q('(?i)' + R.ALREADY_HELD)}) AS held FROM c)
SELECT seq, hit AND held AND NOT may AS must_hold, hit AND may AS may_obtain FROM m""",
    "f06_disqualifiers": f"""WITH {B.RAW_SQL}, {TERM_DIM}, c AS (SELECT raw.*, u.term, raw.title || chr(10) || raw.description AS t FROM raw JOIN udim u ON raw.title IS NOT DISTINCT FROM u.title AND raw.description IS NOT DISTINCT FROM u.description AND raw.term_default IS NOT DISTINCT FROM u.term_default)
SELECT seq, array_to_string(list_filter([
  CASE WHEN regexp_matches(t, {q('(?i)' + R.CLEARANCE)}) AND regexp_matches(t, {q('(?i)' + R.ALREADY_HELD)}) AND NOT regexp_matches(t, {q('(?i)' + R.OBTAINABLE)}) THEN 'clearance' END,
  CASE WHEN regexp_matches(t, {q('(?i)' + R.US_PERSON)}) OR coalesce(sponsorship, '') = 'U.S. Citizenship is Required' THEN 'citizenship' END,
  CASE WHEN regexp_matches(t, {q('(?i)' + R.NO_SPONSORSHIP)}) OR coalesce(sponsorship, '') = 'Does Not Offer Sponsorship' THEN 'no-sponsorship' END,
  CASE WHEN degrees IS NOT NULL THEN CASE WHEN degrees = ['PhD'] THEN 'phd-required' WHEN NOT list_contains(degrees, 'Bachelor''s') THEN 'masters-required' END
    WHEN regexp_matches(t, {q('(?i)' + R.PHD)}) THEN 'phd-required' WHEN regexp_matches(t, {q('(?i)' + R.MASTERS)}) AND NOT regexp_matches(t, {q('(?i)' + R.BACHELORS)}) THEN 'masters-required' END,
  CASE WHEN term = 'summer-2027' THEN 'summer-only' END], lambda x: x IS NOT NULL), ',') AS disqualifiers FROM c""",
    "j01_apply_cutover": f"{CUTOVER} SELECT seq, NOT known OR promoted AS accepted FROM flags",
    "j03_u02_seen_ids": f"{P} SELECT DISTINCT id FROM p WHERE (source = 'ats' OR tier = 1) AND id NOT IN (SELECT id FROM p WHERE status = 'expired')",
    "j04_j05_sightings": f"""{P}, s AS (SELECT id, 'r0' AS run, CAST(seq % 3 AS INT) AS m, CASE WHEN seq % 3 > 0 THEN last_seen_at END AS f FROM p WHERE seq % 4 <> 0),
seen AS (SELECT id FROM p WHERE seq % 5 < 2 AND source IN ('ats', 'listings')), a AS (SELECT coalesce(s.id, seen.id) AS id, CASE WHEN seen.id IS NOT NULL THEN 'r1' ELSE run END AS run,
  CASE WHEN seen.id IS NOT NULL THEN 0 ELSE m END AS m, CASE WHEN seen.id IS NULL THEN f END AS f FROM s FULL JOIN seen ON s.id = seen.id),
miss AS (SELECT id FROM p WHERE status NOT IN ('applied', 'expired') AND source IN ('ats', 'listings') AND id NOT IN (SELECT id FROM seen))
SELECT coalesce(a.id, miss.id) AS id, run AS last_seen_run, coalesce(m, 0) + CASE WHEN miss.id IS NOT NULL THEN 1 ELSE 0 END AS missed_runs,
  CASE WHEN miss.id IS NOT NULL THEN coalesce(f, {NOW}) ELSE f END AS first_missed_at FROM a FULL JOIN miss ON a.id = miss.id""",
    "j06_expire_stale": f"""{P}, x AS (SELECT *, seq % 3 > 0 AND last_seen_at <= {NOW} - INTERVAL 48 HOUR AND status NOT IN ('applied', 'expired') AS gone FROM p)
SELECT id, CASE WHEN gone THEN 'expired' ELSE status END AS status, gone AS just_expired FROM x""",
    "j07_retire_expired": f"{P} SELECT id, CASE WHEN status = 'expired' AND last_seen_at < {NOW} - INTERVAL 90 DAY THEN 'baseline' ELSE 'postings' END AS held_in FROM p",
    "j08_seed_baseline": f"{P} SELECT DISTINCT id FROM p WHERE (tier = 1 OR status = 'applied') AND id NOT IN (SELECT id FROM p WHERE term = 'new-grad')",
    "j11_first_raw_by_id": f"{BATCH} SELECT id, arg_min(title, (source_order, seq)) AS title, arg_min(source, (source_order, seq)) AS source, list(posted_at ORDER BY source_order, seq)[1] AS posted_at FROM batch GROUP BY id",
    "j12_apply_triage": f"{P} SELECT id, CASE WHEN status = 'new' THEN 100 - score ELSE score END AS score, CASE WHEN status = 'new' THEN 2 ELSE tier END AS tier FROM p",
    "j13_apply_link_results": f"""{P}, v AS (SELECT *, ['ok', 'dead', 'blocked', 'redirected_to_index'][CAST(seq % 4 AS BIGINT) + 1] AS vd FROM p)
SELECT id, CASE WHEN seq % 2 = 0 THEN vd ELSE link_status END AS link_status, CASE WHEN seq % 2 = 0 THEN apply_url END AS final_url,
  CASE WHEN seq % 2 = 0 AND vd IN ('dead', 'redirected_to_index') THEN 'expired' ELSE status END AS status FROM v""",
    "j14_j15_decisions": f"{P}, {DECISIONS} SELECT p.id, coalesce(st, status) AS status, CASE WHEN st = 'applied' AND status <> 'applied' THEN {NOW} END AS applied_at FROM p LEFT JOIN dec USING (id)",
    "j16_mirror_plan": f"""{P}, u AS (SELECT max(seq // 10 + 2) AS used FROM p WHERE seq % 10 = 0)
SELECT id, 'update' AS op, seq // 10 + 2 AS position FROM p WHERE seq % 10 = 0
UNION ALL SELECT id, 'append', used + row_number() OVER (ORDER BY id) FROM p, u WHERE seq % 10 <> 0 AND {LIVE}""",
    "a02_a03_exclusions": f"""WITH {B.RAW_SQL}, {GATES}, {DIMS}, {normalized('(SELECT * FROM gated WHERE NOT keep)', 'd')}, f AS (SELECT id, arg_min(reason, (source_order, seq)) AS filter_reason FROM d GROUP BY id)
SELECT filter_reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM f), 9) AS share FROM f GROUP BY 1""",
    "a04_a05_suppressions": f"""{CUTOVER}, s AS (SELECT id, title, source, CASE WHEN source = 'ats' THEN 2 ELSE 1 END AS w FROM flags WHERE known AND NOT promoted), t AS (SELECT id, title, sum(w) AS hits FROM s GROUP BY ALL)
SELECT id AS baseline_id, count(*) AS n_titles, CAST(sum(hits) AS BIGINT) AS hits, string_agg(title, ' | ' ORDER BY title) AS titles, count(*) > 1 AS collapsed FROM t GROUP BY id""",
    "r01_prune": f"{P} SELECT id FROM p WHERE first_seen_at >= {NOW} - INTERVAL 14 DAY UNION ALL SELECT id FROM p WHERE tier = 2 AND last_seen_at >= {NOW} - INTERVAL 30 DAY",
    "w10_keep_recent_runs": f"{H}, r AS (SELECT strftime(started_at, '%Y%m%d') AS run_id, source FROM h) SELECT run_id, source, count(*) AS n FROM r WHERE run_id IN (SELECT DISTINCT run_id FROM r ORDER BY run_id DESC LIMIT 3) GROUP BY ALL",
    "c01_signals": f"{SCORED} SELECT id, signal, points FROM sig",
    "c02_c03_score_and_tier": f"{SCORED} SELECT id, CAST(heuristic_score AS INT) AS heuristic_score, heuristic_trace, {TIER('heuristic_score')} AS tier FROM scored",
    "c04_score_postings": f"""{SCORED}, s AS (SELECT *, CASE WHEN len(disqualifiers) > 0 THEN 'disqualified' WHEN seq % 5 = 0 THEN 'cached' WHEN heuristic_score < {R.MODEL_FLOOR} THEN 'heuristic' WHEN seq % 6 = 0 THEN 'llm' ELSE 'heuristic-fallback' END AS src, score AS given FROM scored),
t AS (SELECT *, CAST(CASE src WHEN 'disqualified' THEN 0 WHEN 'cached' THEN given WHEN 'llm' THEN least(100, given) ELSE heuristic_score END AS INT) AS sc FROM s)
SELECT id, sc AS score, {TIER('sc')} AS tier, src AS tier_source, CASE src WHEN 'disqualified' THEN 'disqualified: ' || array_to_string(disqualifiers, ', ') WHEN 'cached' THEN 'seen before' WHEN 'llm' THEN 'ok'
  WHEN 'heuristic' THEN heuristic_trace || ' (below LLM floor)' ELSE heuristic_trace || ' [scorer unavailable]' END AS score_rationale FROM t""",
    "f12_model_candidates": f"{SCORED} SELECT id, CAST(heuristic_score AS INT) AS heuristic_score FROM scored WHERE len(disqualifiers) = 0 AND heuristic_score >= {R.MODEL_FLOOR} AND seq % 5 <> 0",
    "n27_build_prompts": f"{SCORED} SELECT id, md5('R:me|T:all|P:Company: ' || company || chr(10) || 'Title: ' || title || chr(10) || 'Location: ' || location || chr(10) || title_norm || '|H:' || heuristic_trace) AS prompt_md5 FROM scored",
    "c05_w08_decide_notifications": f"{decided('2001-08-03 20:00:00', False)} SELECT id, decision, decision_reason, {PRIORITY} FROM decided",
    "c05_quiet_hours": f"{decided('2001-08-03 08:00:00', True)} SELECT decision, decision_reason, {PRIORITY}, count(*) AS n FROM decided GROUP BY ALL",
    "n25_payloads": f"""{decided('2001-08-03 08:00:00', True)} SELECT id, regexp_replace(company || ' - ' || title, '[^\\x00-\\x7F]', '?', 'g') AS title, term || ' · ' || location || ' · ' || {age(NOW)} || chr(10) || 'ok' AS body, {PRIORITY},
  {case('term', R.TERM_TAGS, 'NULL')} AS tag, apply_url AS action_url FROM decided WHERE decision IN ('interrupt', 'silent')""",
    "f11_c08_quiet_and_digest": f"""WITH e AS (SELECT event_id, {LOCAL('ts')} AS lo, {LOCAL('ts - to_hours(event_id % 30)')} AS la FROM events)
SELECT event_id, hour(lo) >= 22 OR hour(lo) < 6 AS quiet, hour(lo) >= 7 AND CAST(la AS DATE) < CAST(lo AS DATE) AS due,
  timezone('UTC', timezone('{R.READER_ZONE}', date_trunc('day', lo) + CASE WHEN date_trunc('day', lo) + INTERVAL 7 HOUR >= lo THEN INTERVAL 7 HOUR ELSE INTERVAL 31 HOUR END)) AS next_digest FROM e""",
    "w07_rank_by_date": ranked("date"),
    "w07_rank_by_score": ranked("score"),
    "w07_rank_all_by_date": ranked_all("date"),
    "w07_rank_all_by_score": ranked_all("score"),
    "t01_recent": f"{P} SELECT id, first_seen_at FROM p WHERE status = 'new' AND tier = 2 ORDER BY first_seen_at DESC, id LIMIT 50",
    "t02_live_by_term": f"{P} SELECT id, term, tier, score FROM p WHERE {LIVE} AND term = 'new-grad'",
    "t03_fresh": f"{P} SELECT id, posted_precision <> 'instant' AS approximate FROM p WHERE {LIVE} AND {fresh(chr(39).join(['TIMESTAMP ', '2001-07-20 12:00:00', '']))}",
    "t04_index_rows": f"""{P}, l AS (SELECT *, count(*) OVER (PARTITION BY term) AS in_term FROM p WHERE {LIVE})
SELECT id, term, in_term, replace(company, '|', '\\|') AS company, replace(title, '|', '\\|') AS title, replace(location, '|', '\\|') || CASE WHEN remote THEN ' (remote)' ELSE '' END AS place,
  CASE WHEN posted_at IS NOT NULL THEN strftime({DAY}, '%Y-%m-%d') ELSE '-' END AS posted, {age(NOW)} AS age, CASE WHEN link_status IN ('dead', 'redirected_to_index') THEN 'dead' WHEN link_status = 'unreachable' THEN 'unverified' ELSE '' END AS badge, tier, score FROM l""",
    "t05_digest": f"""{P}, l AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, first_seen_at DESC, id) AS place, count(*) OVER (PARTITION BY tier) AS c FROM p WHERE {LIVE} AND first_seen_at >= TIMESTAMP '2001-07-19 12:00:00')
SELECT tier, place, id, score, greatest(0, c - 12) AS overflow FROM l WHERE place <= 12""",
    "t06_order_backlog": f"{P} SELECT id, {TERM_RANK} AS term_rank, CASE WHEN seq % 9 = 0 THEN 0 ELSE score END AS points FROM p",
    "f07_search_exclusions": f"{P} SELECT id, company, title FROM p WHERE contains(lower(title), 'engineer')",
    "f13_needing_link_check": f"{P} SELECT id FROM p WHERE link_status = 'unchecked' ORDER BY first_seen_at DESC, id LIMIT 100",
    "w11_host_waves": f"{L} SELECT id, {_KEY} AS host_key, CAST(ceil(row_number() OVER (PARTITION BY {_KEY} ORDER BY id) / 3) AS INT) AS wave FROM links",
    "a20_decision_stats": f"""{P}, {DECISIONS} SELECT count(*) FILTER (st IS NULL AND {LIVE}) AS undecided, count(*) FILTER (st = 'applied') AS applied, count(*) FILTER (st = 'applied') AS applied_week, 0 AS applied_undated, count(*) FILTER ({LIVE}) AS live FROM p LEFT JOIN dec USING (id)""",
    "a20_applied_by_term": f"{P}, {DECISIONS} SELECT term, count(*) AS n FROM p JOIN dec USING (id) WHERE st = 'applied' GROUP BY 1",
    "w02_w05_source_health": f"""{HEALTH}
SELECT source, started_at, measured, median, round(measured / median, 9) AS ratio, vd AS volume_drop, st AS stale_304, round(mm, 9) AS midnight_median, pd AS precision_drift, NOT (vd OR st OR pd) AS ok FROM d""",
    "w05_quiet_feeds": health("(SELECT * FROM h WHERE day(started_at) % 12 < 2 OR day(started_at) % 7 = 3)") + VERDICTS,
    "w05_messages": f"""{HEALTH} SELECT source, started_at, CASE
    WHEN vd AND measured = 0 THEN source || ': 0 ' || {UNIT} || ' (trailing median ' || {even('median')} || ') - source may be broken'
    WHEN vd THEN source || ': ' || measured || ' ' || {UNIT} || ', ' || {even('measured / median * 100')} || '% of trailing median ' || {even('median')}
    WHEN st THEN source || ': only 304s for ' || {even('(epoch_us(started_at) - epoch_us(la)) / 86400000000.0')} || ' days - upstream frozen or an ETag is pinned'
    ELSE source || ': ' || {even('midnight / dated * 100')} || '% of timestamps are midnight UTC, against a trailing median of ' || {even('mm * 100')}
      || '% - the feed''s timestamp format may have changed, which would silently reclassify posted_at precision' END AS message FROM d WHERE vd OR st OR pd""",
    "a06_source_counters": f"""WITH {B.RAW_SQL}, {GATES}, {TERM_DIM}, g AS (SELECT gated.*, u.term FROM gated JOIN udim u ON gated.title IS NOT DISTINCT FROM u.title AND gated.description IS NOT DISTINCT FROM u.description AND gated.term_default IS NOT DISTINCT FROM u.term_default),
c AS (SELECT source, count(*) AS raw_fetched, count(*) FILTER (keep) AS fetched, count(*) FILTER (NOT keep) AS filtered_out, count(*) FILTER (keep AND seq % 10 = 0) AS new, count(*) FILTER (keep AND seq % 10 = 1) AS baselined,
  count(*) FILTER (keep AND posted_at IS NOT NULL) AS dated, count(*) FILTER (keep AND epoch_us(posted_at) % 86400000000 = 0) AS midnight, count(*) FILTER (keep AND term = 'unknown') AS term_unknown FROM g GROUP BY 1)
SELECT *, round(midnight / nullif(dated, 0), 9) AS midnight_share, round(term_unknown / nullif(fetched, 0), 9) AS term_unknown_rate, coalesce(term_unknown / nullif(fetched, 0) > 0.1, false) AS term_warning FROM c""",
    "a08_link_status_counts": f"{P} SELECT link_status, source, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT link_status, NULL, count(*) FROM p GROUP BY 1",
    "a09_store_stats": f"""{P} SELECT count(*) AS total, count(*) FILTER (tier = 1) AS tier1, count(*) FILTER (tier = 2) AS tier2, count(*) FILTER (tier = 3) AS tier3, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'notified') AS notified,
  count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'expired') AS expired, count(*) FILTER (status = 'notified' AND tier IN (1, 2)) AS backlog, max(first_seen_at) AS last_new,
  count(*) FILTER (status = 'notified' AND first_seen_at >= {NOW} - INTERVAL 1 HOUR) AS pushes_last_hour, (SELECT count(DISTINCT date_trunc('hour', ts)) FROM events) AS runs FROM p""",
    "a11_daily_new": f"""{H}, d AS (SELECT CAST(started_at AS DATE) AS day, source, sum(new) AS s FROM h GROUP BY ALL), x AS (SELECT DISTINCT day FROM d), y AS (SELECT DISTINCT source FROM d)
SELECT x.day, y.source, CAST(coalesce(s, 0) AS BIGINT) AS new, CAST((SELECT sum(s) FROM d d2 WHERE d2.day = x.day) AS BIGINT) AS total FROM x CROSS JOIN y LEFT JOIN d ON d.day = x.day AND d.source = y.source""",
    "a12_median_daily_new": f"""{H}, d AS (SELECT CAST(started_at AS DATE) AS day, sum(new) AS s FROM h GROUP BY 1), m AS (SELECT CAST(quantile_cont(s, 0.5) AS DOUBLE) AS median, count(*) AS days FROM d WHERE day < DATE '2024-01-20')
SELECT median, days, CASE WHEN median < 10 THEN 'below range' WHEN median > 40 THEN 'above range' ELSE 'in range' END AS verdict FROM m""",
    "a13_tier1_precision": f"""{P}, c AS (SELECT count(*) FILTER (tier = 1 AND status = 'applied') AS applied, count(*) FILTER (tier = 1 AND status IN ('applied', 'skipped')) AS resolved FROM p)
SELECT applied, resolved, round(applied / nullif(resolved, 0), 9) AS precision, coalesce(applied / nullif(resolved, 0) < 0.3, false) AS low FROM c""",
    "a14_a16_tier_volume": f"{H} SELECT CAST(started_at AS DATE) AS day, '1' AS tier, CAST(sum(new) AS BIGINT) AS n FROM h GROUP BY ALL UNION ALL SELECT CAST(started_at AS DATE), '2', CAST(sum(raw_fetched) AS BIGINT) FROM h GROUP BY ALL",
    "a16_notification_totals": f"{H} SELECT 'sent' AS kind, CAST(sum(new) AS BIGINT) AS n FROM h UNION ALL SELECT 'digest', CAST(sum(dated) AS BIGINT) FROM h",
    "a15_signal_attribution": f"""{SCORED}, top AS (SELECT id FROM scored WHERE {TIER('heuristic_score')} = 1)
SELECT signal, count(*) AS n, round(count(*) / (SELECT count(*) FROM top), 9) AS share, round(avg(points), 9) AS mean_points FROM sig WHERE id IN (SELECT id FROM top) GROUP BY signal""",
    "a17_source_rollup": f"{H} SELECT source, count(*) AS runs, count(*) FILTER (not_modified) AS not_modified_runs, coalesce(quantile_cont(raw_fetched, 0.5) FILTER (NOT not_modified), 0.0) AS median_raw, CAST(sum(new) AS BIGINT) AS new FROM h GROUP BY 1",
    "a18_run_time_projection": f"{H} SELECT round(avg(duration_s), 6) AS mean_s, round(avg(duration_s) * 24, 6) AS minutes_month, avg(duration_s) * 24 > 1200 AS over_budget FROM h",
    "a19_posting_hours": f"""{HOURS} SELECT CAST(r AS INT) AS hour, count(hr.hour) AS n, round(count(hr.hour) / nullif((SELECT count(*) FROM hr WHERE NOT mid AND wd), 0), 9) AS share, (SELECT count(*) FROM hr WHERE mid) AS dropped
  FROM range(24) t(r) LEFT JOIN hr ON hr.hour = r AND NOT mid AND wd GROUP BY r""",
    "w06_best_windows": f"""{HOURS}, b AS (SELECT r AS hour, count(hr.hour) AS n FROM range(24) t(r) LEFT JOIN hr ON hr.hour = r AND NOT mid GROUP BY r)
SELECT CAST(s.hour AS INT) AS start, CAST(sum(b.n) AS BIGINT) AS n FROM b s JOIN b ON (b.hour - s.hour + 24) % 24 < 3 GROUP BY s.hour ORDER BY n DESC, start DESC LIMIT 5""",
    "a21_board_tally": f"""{L}, g AS (SELECT id, CASE WHEN id % 6 = 5 THEN 304 ELSE http_status END AS st, id % 3 AS rows_ FROM links),
t AS (SELECT id, CASE WHEN st = 304 THEN 'unchanged' WHEN st IN (403, 404, 410) THEN 'dead' WHEN st = 200 AND rows_ > 0 THEN 'live' WHEN st = 200 THEN 'empty' ELSE 'other' END AS outcome, st IN (200, 304) AS ok FROM g)
SELECT outcome, count(*) AS n, count(*) FILTER (ok) AS responding FROM t GROUP BY 1
UNION ALL SELECT 'roster-' || CAST(ok OR id % 2 = 0 AS VARCHAR), count(*), 0 FROM t WHERE outcome <> 'dead' GROUP BY 1""",
    "t09_recent_suppressions": f"""{CUTOVER} SELECT id AS baseline_id, title, source, count(*) AS times_seen FROM flags WHERE known AND NOT promoted GROUP BY ALL ORDER BY baseline_id, title, source LIMIT 25""",
}
