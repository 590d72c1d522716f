"""SQL of the core queries, for comparison on the same tables."""

from __future__ import annotations

from .queries import LATER_DAY, LOOKBACK_HOURS, MAX_ARTICLES, NOW, SAME_DAY, SCORING

_ISO = r"^(\d{4})(-?)(\d{2})(-?)(\d{2})(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(?:[+-]\d{2}(?::?\d{2})?|[Zz])?)?$"
_OFFSET = r"([+-])(\d{2}):?(\d{2})?$"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _blank(c: str) -> str:
    return rf"coalesce(NOT regexp_matches({c}, '[^\s]'), true)"


def _iso(c: str) -> str:
    s = _strip(c)
    g = lambda i: f"regexp_extract({s}, '{_ISO}', {i})"
    n = lambda i: f"coalesce(try_cast(nullif({g(i)}, '') AS INT), 0)"
    two = lambda i: f"CASE WHEN {g(i)} = '' THEN '00' ELSE {g(i)} END"
    micros = f"rpad(substr(CASE WHEN {g(9)} = '' THEN '0' ELSE {g(9)} END, 1, 6), 6, '0')"
    local = f"try_cast({g(1)} || '-' || {g(3)} || '-' || {g(5)} || ' ' || {two(6)} || ':' || {two(7)} || ':' || {two(8)} || '.' || {micros} AS TIMESTAMP)"
    o = lambda i: f"regexp_extract(substr({s}, 9), '{_OFFSET}', {i})"
    m = lambda i: f"coalesce(try_cast(nullif({o(i)}, '') AS INT), 0)"
    sign = f"(CASE WHEN {o(1)} = '-' THEN -1 ELSE 1 END)"
    return f"CASE WHEN regexp_matches({s}, '{_ISO}') AND {g(2)} = {g(4)} AND {n(6)} <= 23 THEN {local} - to_minutes({sign} * ({m(2)} * 60 + {m(3)})) END"


_T = f"""
t AS (SELECT *, coalesce({_iso('published_at')}, {_iso('updated_at')}) AS ts,
  NOT ({_blank('published_at')} AND {_blank('updated_at')}) AS dated FROM article)
"""
_STATUS = f"""CASE WHEN NOT dated THEN 'missing' WHEN ts IS NULL THEN 'invalid'
  WHEN ts < TIMESTAMP '{NOW}' - to_hours({LOOKBACK_HOURS}) THEN 'too_old'
  WHEN ts > TIMESTAMP '{NOW}' + to_minutes(15) THEN 'future' ELSE 'kept' END"""

_URL = r"^(?i)(https?)://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\[\]\s]+)(?::(\d{0,5}))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$".replace("^(?i)", "(?i)^")
_TRACKING = "'_hsenc','_hsmi','dclid','fbclid','gclid','mc_cid','mc_eid','msclkid','oly_anon_id','oly_enc_id','rb_clickid','s_cid','vero_conv','vero_id'"


def _canonical(c: str) -> str:
    s = _strip(c)
    g = lambda i: f"regexp_extract({s}, '{_URL}', {i})"
    scheme, host, port = f"lower({g(1)})", rf"regexp_replace(lower({g(2)}), '\.+$', '')", g(3)
    number = f"CAST(nullif({port}, '') AS INT)"
    show = f"CASE WHEN {port} = '' OR ({scheme} = 'http' AND {number} = 80) OR ({scheme} = 'https' AND {number} = 443) THEN '' ELSE ':' || {number} END"
    path = f"CASE WHEN rtrim({g(4)}, '/') = '' THEN '/' ELSE rtrim({g(4)}, '/') END"
    items = f"list_filter(string_split({g(5)}, '&'), lambda x: x <> '' AND NOT (starts_with(lower(string_split(x, '=')[1]), 'utm_') OR lower(string_split(x, '=')[1]) IN ({_TRACKING})))"
    ordered = f"list_transform(list_sort(list_transform({items}, lambda x: {{'l': lower(string_split(x, '=')[1]), 'k': string_split(x, '=')[1], 'x': x}})), lambda p: p.x)"
    query = f"array_to_string({ordered}, '&')"
    return f"CASE WHEN regexp_matches({s}, '{_URL}') AND {host} <> '' AND coalesce({number}, 0) <= 65535 THEN {scheme} || '://' || {host} || {show} || {path} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"


def _quality(order: str = "article_id") -> str:
    some = lambda c: f"(NOT {_blank(c)}) DESC"
    length = f"least(coalesce(length({_strip('summary')}), 0), 4000) DESC"
    return ", ".join([some("published_at"), some("updated_at"), some("summary"), length, some("author"), "coalesce(source_priority, 0) DESC", order])


_DEDUP = f"""
u AS (SELECT *, {_canonical('url')} AS canon FROM {{base}}),
w AS (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY {_quality()}) AS rn, min(article_id) OVER (PARTITION BY canon) AS first_id FROM u),
dd AS (SELECT *, CASE WHEN canon IS NULL THEN 'invalid_url' WHEN rn = 1 THEN 'kept' ELSE 'duplicate' END AS dedup_status, CASE WHEN canon IS NOT NULL THEN first_id END AS group_ordinal FROM w)
"""


def _fold(c: str) -> str:
    return f"replace(replace(lower({c}), 'ß', 'ss'), 'ς', 'σ')"


def _has(text: str, k: str) -> str:
    return rf"regexp_matches({text}, '(^|[^\p{{L}}\p{{N}}_]){k}($|[^\p{{L}}\p{{N}}_])')"


_AGE = f"greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts), 0)"
_POINTS = "CASE WHEN ts IS NULL THEN 0 " + " ".join(f"WHEN {_AGE} <= {h * 3600}000000 THEN {p}" for h, p in SCORING.bands) + " ELSE 0 END"


def _scores(base: str) -> str:
    high = [f"CASE WHEN {_has('title_f', k)} THEN {SCORING.in_title} WHEN {_has('support', k)} THEN {SCORING.in_support} ELSE 0 END" for k in SCORING.high_keywords]
    low = [f"CASE WHEN {_has('title_f || chr(32) || support', k)} THEN 1 ELSE 0 END" for k in SCORING.low_keywords]
    why = [f"CASE WHEN {_has('title_f', k)} THEN 'High-priority keyword in title ''{k}'': +{SCORING.in_title}' WHEN {_has('support', k)} THEN 'High-priority keyword in summary/tags ''{k}'': +{SCORING.in_support}' END" for k in SCORING.high_keywords]
    why_low = [f"CASE WHEN {_has('title_f || chr(32) || support', k)} THEN 'Low-priority keyword ''{k}'': -{SCORING.low}' END" for k in SCORING.low_keywords]
    hours = "CASE fresh " + " ".join(f"WHEN {p} THEN {h}" for h, p in SCORING.bands) + " END"
    return f"""
b AS (SELECT x.*, c.weight AS category_weight, {_fold("coalesce(title, '')")} AS title_f,
  {_fold("coalesce(summary, '') || ' ' || coalesce(array_to_string(source_tags, ' '), '')")} AS support FROM {base} x JOIN category_profile c ON c.category_id = x.category),
s0 AS (SELECT *, {' + '.join(high)} AS hp, {' + '.join(f"(CASE WHEN {h.split('THEN')[0].replace('CASE WHEN', '').strip()} OR {h.split('WHEN')[2].split('THEN')[0].strip()} THEN 1 ELSE 0 END)" for h in high)} AS high_hits,
  {' + '.join(low)} AS low_hits, {_POINTS} AS fresh FROM b),
s AS (SELECT *, CAST(greatest(coalesce(source_priority, 0) * 2 + category_weight * 2 + fresh + least(hp, {SCORING.high_cap}) - least(low_hits * {SCORING.low}, {SCORING.low_cap}), 0) AS INT) AS score,
  concat_ws('; ', 'Source priority ' || coalesce(source_priority, 0) || ': +' || coalesce(source_priority, 0) * 2, 'Category weight ' || category_weight || ': +' || category_weight * 2,
    CASE WHEN fresh > 0 THEN 'Published within ' || {hours} || ' hours: +' || fresh END, {', '.join(why)},
    CASE WHEN hp > {SCORING.high_cap} THEN 'High-priority keyword bonus capped: ' || hp || ' -> {SCORING.high_cap}' END, {', '.join(why_low)},
    CASE WHEN low_hits * {SCORING.low} > {SCORING.low_cap} THEN 'Low-priority keyword penalty capped: ' || low_hits * {SCORING.low} || ' -> {SCORING.low_cap}' END) AS reasons
  FROM s0)
"""


_RANK = f"""
WITH {_T}, k AS (SELECT * FROM t WHERE {_STATUS} = 'kept'), {_DEDUP.replace('{base}', 'k')},
q AS (SELECT * FROM dd WHERE dedup_status = 'kept'), {_scores('q')},
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, ts DESC NULLS LAST, coalesce(source_priority, 0) DESC, {_fold('title')}, url, article_id) AS rank_index FROM s)
"""


def _pick(fill: bool) -> str:
    return f"""{_RANK},
n AS (SELECT r.*, row_number() OVER (PARTITION BY category ORDER BY rank_index) <= p.daily_quota AS within_quota
      FROM r JOIN category_profile p ON p.category_id = r.category WHERE p.daily_quota > 0),
z AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY within_quota DESC, rank_index) AS pick FROM n {'' if fill else 'WHERE within_quota'}) WHERE pick <= {MAX_ARTICLES})
"""


_ENR = """
e AS (SELECT *, lower(trim(status)) AS st, nullif(lower(trim(content_origin)), '') AS og FROM enrichment_record),
eo AS (SELECT *, CASE WHEN og IN ('feed','web','curated','summary','none','unknown') THEN og WHEN og IS NOT NULL THEN 'unknown'
  WHEN st = 'extracted' THEN CASE WHEN http_status IS NULL THEN 'feed' ELSE 'web' END WHEN st = 'summary_fallback' THEN 'summary' WHEN st = 'fetch_failed' THEN 'none' ELSE 'unknown' END AS origin FROM e)
"""

_HIST = """
l AS (SELECT id, priority AS ord, enabled, row_number() OVER (ORDER BY priority, id) - 1 AS seat, count(*) OVER () AS n FROM feed_source WHERE enabled),
h AS (SELECT substr(started_at, 1, 10) AS date, 'editions/' || lpad(CAST(batch_no AS VARCHAR), 6, '0') AS path, list_sort(list(DISTINCT source_id)) AS ids FROM source_report GROUP BY substr(started_at, 1, 10), batch_no),
x AS (SELECT date, path, unnest(ids) AS lesson_id, generate_subscripts(ids, 1) - 1 AS pos FROM h)
"""


def _chosen(day: str, count: int) -> str:
    return f"""WITH {_HIST},
today AS (SELECT x.lesson_id AS id, row_number() OVER (ORDER BY pos) - 1 AS pick, count(*) OVER () AS known FROM x JOIN l ON l.id = x.lesson_id WHERE path = (SELECT max(path) FROM h WHERE date = '{day}')),
prev AS (SELECT arg_max(lesson_id, date || path || lpad(CAST(pos AS VARCHAR), 6, '0')) AS id FROM x WHERE date < '{day}' AND lesson_id IN (SELECT id FROM l)),
start AS (SELECT coalesce((SELECT (seat + 1) % n FROM l WHERE id = (SELECT id FROM prev)), 0) AS s),
turn AS (SELECT id, (seat - s + n) % n AS pick, (SELECT id FROM prev) IS NOT NULL AND (s = 0 OR s + {count} > n) AS cycle_reset FROM l, start WHERE (seat - s + n) % n < {count}),
c AS (SELECT id, CAST(pick AS INT) AS pick, (SELECT id FROM prev) AS previous, true AS reused, false AS cycle_reset FROM today WHERE known >= {count} AND pick < {count}
  UNION ALL SELECT id, CAST(pick AS INT), (SELECT id FROM prev), false, cycle_reset FROM turn WHERE NOT EXISTS (SELECT 1 FROM today WHERE known >= {count}))
"""


def _checks(relation: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, coalesce({n}, 0) = 0 AS passed, CAST(coalesce({n}, 0) AS BIGINT) AS failing FROM {relation}" for n in names)


_ONCE = """r1 AS (SELECT DISTINCT * FROM enrichment_record),
st AS (SELECT count(*) AS requested, count(*) FILTER (WHERE lower(trim(status)) = 'extracted') AS extracted, count(*) FILTER (WHERE lower(trim(status)) = 'summary_fallback') AS summary_fallback,
  count(*) FILTER (WHERE lower(trim(status)) = 'fetch_failed') AS fetch_failed FROM r1)"""

ORACLES: dict[str, str] = {
    "time_window_status": f"WITH {_T} SELECT article_id, {_STATUS} AS time_status FROM t",
    "time_window_counts": f"WITH {_T}, c AS (SELECT {_STATUS} AS s FROM t) SELECT "
    + ", ".join(f"count(*) FILTER (WHERE s = '{x}') AS {x}" for x in ("kept", "missing", "invalid", "too_old", "future"))
    + ", count(*) AS total FROM c",
    "iso_instants": f"WITH i AS (SELECT article_id, {_iso('published_at')} AS ts FROM article) SELECT article_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS published_utc FROM i",
    "freshness_bands": f"WITH {_T} SELECT article_id, CASE WHEN ts IS NULL THEN -1 ELSE CAST({_AGE} // 1000000 AS BIGINT) END AS age_seconds, {_POINTS} AS points FROM t",
    "url_canonical": f"SELECT article_id, {_canonical('url')} AS canonical_url FROM article",
    "url_dedup_best": f"WITH {_DEDUP.replace('{base}', 'article')} SELECT article_id, dedup_status, coalesce(group_ordinal, -1) AS group_ordinal FROM dd",
    "url_dedup_kept": f"WITH {_DEDUP.replace('{base}', 'article')} SELECT article_id, canon AS canonical_url FROM dd WHERE dedup_status = 'kept'",
    "dedup_summary": f"""WITH {_DEDUP.replace('{base}', 'article')} SELECT count(*) AS total, count(*) FILTER (WHERE dedup_status = 'kept') AS unique_count,
      count(*) FILTER (WHERE dedup_status = 'duplicate') AS duplicate_count, count(*) FILTER (WHERE dedup_status = 'invalid_url') AS invalid_count,
      count(DISTINCT canon) FILTER (WHERE dedup_status = 'duplicate') AS duplicate_groups FROM dd""",
    "category_join_weight": "SELECT article_id, weight AS category_weight FROM article JOIN category_profile ON category_id = category",
    "keyword_score": f"WITH {_T}, {_scores('t')} SELECT article_id, score, CAST(high_hits AS INT) AS high_hits, CAST(low_hits AS INT) AS low_hits FROM s",
    "score_reasons": f"WITH {_T}, {_scores('t')} SELECT article_id, reasons FROM s",
    "ranking_order": f"{_RANK} SELECT article_id, score, rank_index FROM r",
    "quota_select": f"{_pick(True)} SELECT article_id, category, rank_index, within_quota FROM z",
    "quota_select_nofill": f"{_pick(False)} SELECT article_id, category, rank_index FROM z",
    "selection_counts_zero_fill": f"{_pick(True)} SELECT c.category_id AS category, count(z.article_id) AS selected_count FROM category_profile c LEFT JOIN z ON z.category = c.category_id GROUP BY 1",
    "deferred_except": f"{_pick(True)} SELECT article_id FROM r EXCEPT SELECT article_id FROM z",
    "union_sections": "SELECT article_id AS item_id, title, 0 AS section, 'news' AS section_name FROM article UNION ALL SELECT p_partkey, p_name, 1, 'lessons' FROM part",
    "status_counts": """SELECT count(*) AS source_count, count(*) FILTER (WHERE lower(trim(status)) <> 'failed') AS fetched_count, count(*) FILTER (WHERE lower(trim(status)) = 'success') AS success_count,
      count(*) FILTER (WHERE lower(trim(status)) = 'warning') AS warning_count, count(*) FILTER (WHERE lower(trim(status)) = 'failed') AS failed_count, CAST(coalesce(sum(article_count), 0) AS BIGINT) AS article_count FROM source_report""",
    "enrichment_counts": f"""WITH {_ENR} SELECT count(*) AS requested_count, count(*) FILTER (WHERE st = 'extracted') AS extracted_count, count(*) FILTER (WHERE st = 'summary_fallback') AS fallback_count,
      count(*) FILTER (WHERE st = 'fetch_failed') AS failed_count, coalesce(count(*) FILTER (WHERE st = 'extracted') / count(*), 0.0) AS extraction_rate FROM eo""",
    "origin_counts": f"WITH {_ENR}, o(origin) AS (VALUES ('feed'), ('web'), ('curated'), ('summary'), ('none'), ('unknown')) SELECT o.origin, count(eo.origin) AS n FROM o LEFT JOIN eo ON eo.origin = o.origin GROUP BY 1",
    "enrichment_problems": f"WITH {_ENR} SELECT st AS status, count(*) AS n FROM eo WHERE coalesce(st <> 'extracted', true) GROUP BY 1",
    "group_sorted_list": "SELECT category, count(*) AS source_count, string_agg(name, '|' ORDER BY priority DESC, name) AS sources FROM feed_source WHERE enabled GROUP BY 1",
    "duplicate_keys": "SELECT external_id, count(*) AS n FROM article WHERE external_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "unknown_category_anti": "SELECT id, category FROM feed_source f WHERE NOT EXISTS (SELECT 1 FROM category_profile c WHERE c.category_id = f.category AND c.weight >= 10)",
    "source_violations": r"""WITH s AS (SELECT * REPLACE (priority + 2 AS priority) FROM feed_source), v AS (
      SELECT id, CASE WHEN NOT regexp_matches(id, '^[a-z0-9_]+$') THEN 'id' END AS violation FROM s
      UNION ALL SELECT id, CASE WHEN trim(coalesce(name, '')) = '' THEN 'name' END FROM s
      UNION ALL SELECT id, CASE WHEN NOT ((provider = 'feed' AND format IN ('rss', 'atom')) OR (provider = 'html_index' AND format = 'html')) THEN 'provider_format' END FROM s
      UNION ALL SELECT id, CASE WHEN NOT regexp_matches(url, '^https?://[^/?#\s]+') THEN 'url' END FROM s
      UNION ALL SELECT id, CASE WHEN trim(coalesce(category, '')) = '' THEN 'category' END FROM s
      UNION ALL SELECT id, CASE WHEN priority NOT BETWEEN 1 AND 10 THEN 'priority' END FROM s
      UNION ALL SELECT id, CASE WHEN trim(coalesce(cadence, '')) = '' THEN 'cadence' END FROM s
      UNION ALL SELECT id, CASE WHEN enabled IS NULL OR official IS NULL THEN 'flags' END FROM s)
      SELECT id, violation FROM v WHERE violation IS NOT NULL""",
    "reconcile_checks": f"""WITH {_ENR}, c AS (SELECT count(*) FILTER (WHERE NOT coalesce(st IN ('extracted', 'summary_fallback', 'fetch_failed'), false)) AS a,
      count(*) FILTER (WHERE (st = 'extracted' AND origin NOT IN ('feed', 'web', 'curated')) OR (st = 'summary_fallback' AND origin <> 'summary') OR (st = 'fetch_failed' AND origin <> 'none')) AS b,
      count(*) FILTER (WHERE word_count < 0) AS w FROM eo)
      SELECT 'status_known' AS check_name, a = 0 AS passed, a AS failing FROM c UNION ALL SELECT 'origin_allowed', b = 0, b FROM c UNION ALL SELECT 'word_count_not_negative', w = 0, w FROM c""",
    "report_article_mismatch": """SELECT category, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n FROM (SELECT category, count(*) AS n FROM article GROUP BY 1) a
      FULL JOIN (SELECT category, count(*) AS n FROM source_report GROUP BY 1) b USING (category) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    "asof_previous": "WITH p AS (SELECT user_id, ts, event_id AS pid FROM events WHERE event_type = 'purchase') SELECT e.event_id, coalesce(p.pid, -1) AS previous_purchase FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts",
    "history_previous_lesson": f"""WITH h AS (SELECT substr(started_at, 1, 10) AS date, list_sort(list(DISTINCT source_id)) AS ids FROM source_report GROUP BY 1),
      x AS (SELECT date, unnest(ids) AS lesson_id, generate_subscripts(ids, 1) AS pos FROM h WHERE date < '{NOW[:10]}')
      SELECT date, lesson_id FROM x WHERE lesson_id IN (SELECT id FROM feed_source WHERE enabled) ORDER BY date DESC, pos DESC LIMIT 1""",
    "rotation_next": """WITH l AS (SELECT id, row_number() OVER (ORDER BY priority, id) - 1 AS pos, count(*) OVER () AS n FROM feed_source WHERE enabled),
      p AS (SELECT *, coalesce((max(CASE WHEN id = 'willow_wire' THEN pos END) OVER () + 1) % n, 0) AS start, max(CASE WHEN id = 'willow_wire' THEN pos END) OVER () IS NOT NULL AS seen FROM l)
      SELECT id, CAST((pos - start + n) % n AS INT) AS pick, seen AND (start = 0 OR start + 7 > n) AS cycle_reset FROM p WHERE (pos - start + n) % n < 7""",
    "edition_upsert": """WITH o AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderkey AS k FROM orders),
      u AS (SELECT date, min(k) AS article_count, 'old' AS version, 1 AS p FROM o GROUP BY 1 UNION ALL SELECT date, max(k), 'new', 0 FROM o WHERE date >= '1996-01-01' GROUP BY 1)
      SELECT date, article_count, version FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY p) AS r FROM u) WHERE r = 1""",
    "redact_public": "SELECT article_id, title, '' AS content_html, '' AS content_text, 'not_requested' AS content_status FROM article",
    "word_count": r"SELECT doc_id, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\s\x{1c}-\x{1f}\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+'), lambda x: x <> '')), 0) AS INT) AS words FROM documents",
    "truncate_ellipsis": r"SELECT article_id, CASE WHEN length(summary) > 80 THEN regexp_replace(substr(summary, 1, 79), '\s+$', '') || '…' ELSE summary END AS short FROM article",
    "local_date_label": "SELECT article_id, strftime(CAST(replace(replace(fetched_at, 'T', ' '), 'Z', '') AS TIMESTAMP) + INTERVAL 7 HOUR, '%Y-%m-%d') AS local_date, strftime(CAST(replace(replace(fetched_at, 'T', ' '), 'Z', '') AS TIMESTAMP) + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M') || ' Asia/Ho_Chi_Minh' AS label FROM article",
    "text_escapes": r"""SELECT article_id, regexp_replace(title, '([\\\[\]*_`#])', '\\\1', 'g') AS md,
      replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html,
      coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug,
      trim(regexp_replace(title, '[\s\x{a0}]+', ' ', 'g')) AS plain FROM article""",
    "category_labels": "SELECT array_to_string(list_transform(string_split(replace(category, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label, count(*) AS n FROM article GROUP BY 1",
    "props_json_extract": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "tag_membership": "SELECT article_id, list_contains(source_tags, 'compiler') AS has_compiler, CAST(len(list_filter(source_tags, lambda t: starts_with(t, 'c'))) AS INT) AS c_tags, array_to_string(source_tags, ' ') AS tags FROM article",
    "lessons_reused": f"{_chosen(SAME_DAY, 5)} SELECT * FROM c",
    "lessons_wrapped": f"{_chosen(LATER_DAY, 20)} SELECT * FROM c",
    "lesson_ids_in_order": f"WITH {_HIST} SELECT path, CAST(pos AS INT) AS pos, lesson_id, ord AS \"order\" FROM x JOIN l ON l.id = x.lesson_id",
    "ranked_lessons": f"{_chosen(LATER_DAY, 20)} SELECT 'learning:' || c.id AS external_id, f.url, c.pick, f.priority * 2 AS score FROM c JOIN feed_source f ON f.id = c.id",
    "previous_lesson_each_day": f"""WITH {_HIST}, k AS (SELECT date, arg_max(lesson_id, path || lpad(CAST(pos AS VARCHAR), 6, '0')) AS lesson_id FROM x WHERE lesson_id IN (SELECT id FROM l) GROUP BY 1)
      SELECT DISTINCT h.date, (SELECT arg_max(lesson_id, k.date) FROM k WHERE k.date < h.date) AS previous FROM h""",
    "uncurated_lessons": 'SELECT id, priority AS "order" FROM feed_source WHERE enabled AND NOT official',
    "coverage_counts": """SELECT count(*) AS lesson_count, count(*) FILTER (WHERE enabled) AS enabled_count, count(*) FILTER (WHERE enabled AND official) AS curated_count, CAST(coalesce(sum(priority * 3) FILTER (WHERE enabled), 0) AS BIGINT) AS enabled_minutes,
      CAST(coalesce(sum(priority * 3) FILTER (WHERE enabled AND official), 0) AS BIGINT) AS curated_minutes, arg_min(id, lpad(CAST(priority AS VARCHAR), 3, '0') || id) FILTER (WHERE enabled AND NOT official) AS next_uncurated,
      count(*) FILTER (WHERE enabled AND official) / count(*) FILTER (WHERE enabled) AS coverage_rate FROM feed_source""",
    "report_index": "SELECT id, CAST(row_number() OVER (ORDER BY name, id) AS INT) AS index FROM feed_source",
    "counter_checks": f"""WITH {_ENR}, {_ONCE}, dv AS (SELECT count(*) AS requested, count(*) FILTER (WHERE st = 'extracted') AS extracted, count(*) FILTER (WHERE st = 'summary_fallback') AS summary_fallback, count(*) FILTER (WHERE st = 'fetch_failed') AS fetch_failed,
        count(*) FILTER (WHERE NOT coalesce(st IN ('extracted', 'summary_fallback', 'fetch_failed'), false)) AS bad_status, count(*) FILTER (WHERE origin = 'unknown') AS bad_origin,
        count(*) FILTER (WHERE (st = 'extracted' AND origin NOT IN ('feed', 'web', 'curated')) OR (st = 'summary_fallback' AND origin <> 'summary') OR (st = 'fetch_failed' AND origin <> 'none')) AS bad_pair FROM eo),
      v AS (SELECT abs(st.requested - st.extracted - st.summary_fallback - st.fetch_failed) AS counters_add_up, abs(st.requested - dv.requested) AS requested_as_stated, abs(st.extracted - dv.extracted) AS extracted_as_stated,
        abs(st.summary_fallback - dv.summary_fallback) AS summary_fallback_as_stated, abs(st.fetch_failed - dv.fetch_failed) AS fetch_failed_as_stated, bad_status AS status_known, bad_origin AS origin_known, bad_pair AS origin_allowed FROM st, dv)
      {_checks('v', ['counters_add_up', 'requested_as_stated', 'extracted_as_stated', 'summary_fallback_as_stated', 'fetch_failed_as_stated', 'status_known', 'origin_known', 'origin_allowed'])}""",
    "lesson_content_checks": f"""WITH {_ENR}, m AS (SELECT title, bool_or(coalesce(list_contains(source_tags, 'compiler'), false)) AS cur FROM article WHERE title IS NOT NULL GROUP BY 1),
      j AS (SELECT eo.*, m.cur FROM eo JOIN m ON m.title = eo.title),
      v AS (SELECT count(*) FILTER (WHERE cur AND NOT coalesce(st = 'extracted', false)) AS curated_extracted, count(*) FILTER (WHERE cur AND origin <> 'curated') AS curated_origin, count(*) FILTER (WHERE NOT cur AND origin = 'curated') AS others_not_curated,
        count(*) FILTER (WHERE NOT cur AND st = 'fetch_failed') AS others_not_failed FROM j),
      w AS (SELECT (SELECT count(*) FROM (SELECT title FROM enrichment_record EXCEPT SELECT title FROM article)) AS records_have_articles, (SELECT count(*) FROM (SELECT title FROM article EXCEPT SELECT title FROM enrichment_record)) AS articles_have_records)
      {_checks('v', ['curated_extracted', 'curated_origin', 'others_not_curated', 'others_not_failed'])} UNION ALL {_checks('w', ['records_have_articles', 'articles_have_records'])}""",
    "titles_on_one_side": "SELECT title, 'left' AS side FROM (SELECT title FROM enrichment_record EXCEPT SELECT title FROM article) UNION ALL SELECT title, 'right' FROM (SELECT title FROM article EXCEPT SELECT title FROM enrichment_record)",
    "lesson_id_checks": f"""WITH a AS (SELECT row_number() OVER (ORDER BY id) AS n, id FROM feed_source), b AS (SELECT row_number() OVER (ORDER BY CAST(priority AS VARCHAR) || id) AS n, id FROM feed_source WHERE enabled),
      v AS (SELECT (SELECT count(*) FROM a FULL JOIN b USING (n) WHERE a.id IS DISTINCT FROM b.id) AS ids_as_stated, count(id) - count(DISTINCT id) AS ids_unique, count(*) FILTER (WHERE trim(coalesce(id, '')) = '') AS ids_given,
        count(*) FILTER (WHERE NOT official AND category <> 'technical_learning') AS category_of_lessons, abs(count(*) - 50) AS lessons_expected FROM feed_source WHERE enabled)
      {_checks('v', ['ids_as_stated', 'ids_unique', 'ids_given', 'category_of_lessons', 'lessons_expected'])}""",
    "counts_as_archived": """WITH a AS (SELECT source_id, count(*) AS n, sum(word_count) AS w, min(http_status) AS m FROM enrichment_record GROUP BY 1), b AS (SELECT source_id, count(*) AS n, sum(word_count) AS w, min(http_status) AS m FROM (SELECT DISTINCT * FROM enrichment_record) GROUP BY 1)
      SELECT coalesce(a.source_id, b.source_id) AS source_id FROM a FULL JOIN b ON a.source_id = b.source_id WHERE (a.n, a.w, a.m) IS DISTINCT FROM (b.n, b.w, b.m)""",
    "copy_checks": f"""WITH g AS (SELECT '/' || source || '/' || doc_id AS path, sha256(text) AS digest FROM documents), w AS (SELECT min(digest) AS d FROM g WHERE ends_with(path, '/100')),
      v AS (SELECT count(*) FILTER (WHERE NOT coalesce(digest = d, false)) AS copies_equal, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS copy_found FROM g, w WHERE ends_with(path, '7') OR ends_with(path, '9')) {_checks('v', ['copies_equal', 'copy_found'])}""",
    "content_digests": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "latest_report": f"WITH {_HIST} SELECT path || '/ranked_articles.json' AS path, date FROM h ORDER BY path DESC LIMIT 1",
    "nested_ids": r"""WITH e AS (SELECT group_id, list_concat([kept_article.external_id], list_transform(coalesce(duplicate_articles, []), lambda m: m.external_id), list_transform(coalesce(duplicate_articles, []), lambda m: m.category), [kept_article.category]) AS ids FROM duplicate_group),
      t AS (SELECT group_id, list_filter(list_transform(ids, lambda i: regexp_replace(i, '^\s+|\s+$', '', 'g')), lambda i: i IS NOT NULL AND i <> '') AS ids FROM e)
      SELECT group_id, coalesce(array_to_string(list_filter(ids, lambda i, k: list_position(ids, i) = k), '|'), '') AS ids FROM t""",
    "ranking_summary": f"{_RANK} SELECT count(*) AS ranked_count, max(score) AS top_score FROM r",
    "public_checks": f"""WITH v AS (SELECT greatest(count(*) - 1000, 0) AS article_count_within_limit, count(*) FILTER (WHERE NOT {_blank('content_html')} OR NOT {_blank('content_text')}) AS no_content,
      count(*) FILTER (WHERE coalesce(content_status <> 'not_requested', false)) AS status_reset, count(url) - count(DISTINCT url) AS urls_unique FROM article) {_checks('v', ['article_count_within_limit', 'no_content', 'status_reset', 'urls_unique'])}""",
    "text_forms": r"""SELECT article_id, nullif(trim(regexp_replace(author, '[\s\x{a0}]+', ' ', 'g')), '') AS author, regexp_replace(regexp_replace(summary, '[ \t\f\x0b]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS inline,
      CAST(length(title) AS VARCHAR) || ' letter' || CASE WHEN length(title) = 1 THEN '' ELSE 's' END AS letters,
      CASE WHEN regexp_matches(url, '(?i)^\s*https?://[^/?#\s]+') THEN regexp_extract(trim(url), '^([^/]+//[^/?#]+)', 1) || '/' END AS origin,
      coalesce(nullif(regexp_replace(regexp_replace(lower(category), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug, replace(url, ')', '%29') AS link,
      regexp_replace(replace(replace(summary, '\', '\\'), '|', '\|'), '\r\n?|\n', ' ', 'g') AS cell FROM article""",
    "media_types": "SELECT DISTINCT record_id, nullif(lower(coalesce(content_type, '')), '') AS kind, nullif(lower(trim(content_type)), '') AS plain FROM enrichment_record",
}
