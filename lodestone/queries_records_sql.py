"""DuckDB SQL of the queries in queries_records."""

from __future__ import annotations

from lodestone.functions import html
from lodestone.plans import canonical as C
from lodestone.queries_records import CUTOFF_DAY, DAYS, HUB, MAX_EVENTS, REMOVALS, VERSIONS
from lodestone.streaming.events import MOVES

_A = f"WITH {C.SQL_ARTIFACTS}"
_P = f"WITH RECURSIVE {C.SQL_PASSAGES}"
_EDGES = """e AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INTEGER, round(l_extendedprice * 100)::BIGINT) AS id, 'S' || l_suppkey AS source_id, 'P' || l_partkey AS target_id, CASE WHEN l_linestatus = 'O' THEN 'mentions' ELSE 'duplicate_of' END AS kind,
  CASE l_returnflag WHEN 'A' THEN 'user_confirmed' WHEN 'R' THEN 'observed' ELSE 'inferred' END AS origin, CASE WHEN l_returnflag NOT IN ('A', 'R') THEN l_discount * 10 END AS confidence, l_shipdate AS created_at FROM lineitem)"""
_DOMINATED = f"""WITH {_EDGES}, k AS (SELECT *, first_value(id) OVER (PARTITION BY source_id, target_id, kind ORDER BY CASE origin WHEN 'user_confirmed' THEN 3 WHEN 'observed' THEN 2 ELSE 1 END DESC, coalesce(confidence, 0) DESC, created_at, id) AS kept_id FROM e),
d AS (SELECT id, kept_id FROM k WHERE origin = 'inferred' AND id <> kept_id)"""
_UPSERT = f"""{_A}, s AS (SELECT artifact_id, root, content_hash FROM artifacts WHERE root <> 'src5'),
i AS (SELECT artifact_id, CASE WHEN title LIKE '%.txt' THEN 'sha256:' || sha256(text || chr(10) || 'more') ELSE content_hash END AS content_hash FROM artifacts WHERE root <> 'src3')"""
_MARKS = """p AS (SELECT page_id, url, html, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages),
st AS (SELECT url, host AS folder, min(title) AS title FROM p WHERE url LIKE 'http:%' GROUP BY ALL),
ic AS (SELECT page_id AS ordinal, regexp_replace(url, '^https:', 'http:') AS url, CASE WHEN contains(url, '/de/') THEN 'other' ELSE host END AS folder, CASE WHEN contains(url, 'utm_') THEN title || '!' ELSE title END AS title FROM p)"""
_REQ = f"""{_P}, rq AS (SELECT passage_id, CASE WHEN root = 'src2' THEN 'sha256:old' ELSE content_hash END AS content_hash, sha256(passage_text) AS text_hash FROM passages),
cu AS (SELECT passage_id, content_hash, sha256(passage_text) AS text_hash FROM passages WHERE enabled)"""
_GONE = f"g AS (SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING min(o_orderdate) < TIMESTAMP '{CUTOFF_DAY}')"
_OBS = """ob AS (SELECT ts::DATE || '/' || (user_id % 97) AS batch, ts, event_id, CASE event_type WHEN 'view' THEN 'created' WHEN 'error' THEN 'removed' WHEN 'signup' THEN 'renamed' ELSE 'modified' END AS kind, 'u' || user_id AS u FROM events),
fl AS (SELECT batch, count(*) AS n FROM ob GROUP BY 1),
mv AS (SELECT batch, ts, event_id, 0 AS sub, u AS path, CASE WHEN kind IN ('removed', 'renamed') THEN 'removed' ELSE 'changed' END AS state FROM ob UNION ALL SELECT batch, ts, event_id, 1, u || '-new', 'changed' FROM ob WHERE kind = 'renamed'),
la AS (SELECT batch, path, state FROM (SELECT *, row_number() OVER (PARTITION BY batch, path ORDER BY ts DESC, event_id DESC, sub DESC) AS r FROM mv) WHERE r = 1)"""
_TAGS = "|".join(sorted(html.ALLOWED, key=len, reverse=True))


def _sanitized() -> str:
    """CTEs up to s(page_id, html, x): the pieces of each page, read one after the other with what is left out."""
    names = lambda tags: "(" + ", ".join(f"'{t}'" for t in tags) + ")"
    return f"""WITH RECURSIVE
pc AS (SELECT page_id, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM (SELECT page_id, string_split(html, '<') AS l FROM pages)),
pf AS (SELECT *, lower(regexp_extract(x, '^/?([a-zA-Z][a-zA-Z0-9-]*)(\\s[^>]*)?/?>', 1)) AS name, starts_with(x, '/') AS closing, regexp_replace(x, '^[^>]*>', '') AS rest, regexp_extract(x, '^/?[a-zA-Z][a-zA-Z0-9-]*([^>]*)>', 1) AS after FROM pc),
st AS (
  SELECT page_id, i, x AS given, '' AS hidden FROM pf WHERE i = 0
  UNION ALL
  SELECT p.page_id, p.i,
    CASE WHEN hidden = '!--' THEN CASE WHEN contains(x, '-->') THEN substr(x, strpos(x, '-->') + 3) ELSE '' END
      WHEN hidden <> '' THEN CASE WHEN closing AND name = hidden AND trim(after) = '' THEN rest ELSE '' END
      WHEN starts_with(x, '!--') THEN ' ' || CASE WHEN contains(substr(x, 4), '-->') THEN substr(x, 3 + strpos(substr(x, 4), '-->') + 3) ELSE '' END
      WHEN name = '' THEN '<' || x
      WHEN name IN {names(html.DANGEROUS)} AND NOT closing AND after <> '/' THEN ' '
      WHEN name IN {names(html.ALLOWED)} AND NOT (closing AND name IN ('br', 'hr')) THEN CASE WHEN closing THEN '</' ELSE '<' END || name || '>' || rest
      ELSE rest END,
    CASE WHEN hidden = '!--' THEN CASE WHEN contains(x, '-->') THEN '' ELSE hidden END
      WHEN hidden <> '' THEN CASE WHEN closing AND name = hidden AND trim(after) = '' THEN '' ELSE hidden END
      WHEN starts_with(x, '!--') THEN CASE WHEN contains(substr(x, 4), '-->') THEN '' ELSE '!--' END
      WHEN name IN {names(html.DANGEROUS)} AND NOT closing AND after <> '/' THEN name ELSE '' END
  FROM st JOIN pf p ON p.page_id = st.page_id AND p.i = st.i + 1),
s AS (SELECT p.page_id, p.html, j.x FROM pages p LEFT JOIN (SELECT page_id, trim(regexp_replace(string_agg(given, '' ORDER BY i), '[\\t\\r\\n ]+', ' ', 'g')) AS x FROM st GROUP BY page_id) j USING (page_id))"""


def _untrusted(x: str) -> str:
    needles = " OR ".join(f"contains(lower({x}), '{n}')" for n in html.NEEDLES)
    return f"({needles} OR len(list_filter(regexp_extract_all({x}, '<[^>]*>'), lambda t: NOT regexp_matches(t, '(?i)^<\\s*/?\\s*(?:{_TAGS})\\s*/?\\s*>$') OR regexp_matches(t, '^<\\s*/\\s*(?:br|hr)\\s*/?\\s*>$'))) > 0 OR regexp_matches({x}, '<[^>]*$'))"


_MEDIA = lambda x: "CASE lower(regexp_extract(" + x + ", '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in html.MEDIA_TYPES) + " ELSE 'none' END"
_GEO = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount::FLOAT AS x, l_tax::FLOAT AS y, (l_quantity / 100)::FLOAT AS w, (l_quantity / 200)::FLOAT AS h, CASE WHEN l_linenumber BETWEEN 5 AND 8 THEN 400 + l_suppkey ELSE 800 + l_partkey END AS ow, CASE WHEN l_linenumber BETWEEN 5 AND 8 THEN 800 + l_partkey ELSE 400 + l_suppkey END AS oh, round(l_discount * 10000)::INTEGER AS c FROM lineitem),
s AS (SELECT *, least(round(greatest(0, least(1, x::DOUBLE)) * ow)::BIGINT, ow - 1) AS px, least(round(greatest(0, least(1, (1::FLOAT - y - h)::DOUBLE)) * oh)::BIGINT, oh - 1) AS py, round(greatest(0, least(1, (x + w)::DOUBLE)) * ow)::BIGINT AS pr, round(greatest(0, least(1, (1::FLOAT - y)::DOUBLE)) * oh)::BIGINT AS pb FROM r),
b AS (SELECT *, least(greatest(pr, px + 1), ow) - px AS pw, least(greatest(pb, py + 1), oh) - py AS ph FROM s)"""
_FOLD = "CASE " + " ".join(f"WHEN acc.s = '{a}' AND x.e = '{b}' THEN {{'s': '{c}', 'i': acc.i, 'e': ''}}" for (a, b), c in MOVES.items()) + " ELSE {'s': acc.s, 'i': acc.i + 1, 'e': ''} END"

ORACLES = {
    "rel_dedupe": f"WITH {_EDGES} SELECT source_id, target_id, kind, origin, arg_min(id, (created_at, id)) AS id FROM e GROUP BY ALL",
    "rel_degree": f"WITH {_EDGES} SELECT node, count(*) AS degree, count(*) >= 10000 AS \"full\" FROM (SELECT source_id AS node FROM e UNION ALL SELECT target_id FROM e) GROUP BY node",
    "rel_listing": f"WITH {_EDGES}, l AS (SELECT * FROM e WHERE source_id = '{HUB}' OR target_id = '{HUB}' ORDER BY created_at, id LIMIT 100) SELECT id, source_id, target_id, kind, origin, s_name AS source_name, p_name AS target_name FROM l LEFT JOIN supplier ON 'S' || s_suppkey = source_id LEFT JOIN part ON 'P' || p_partkey = target_id",
    "rel_compaction": f"{_DOMINATED} SELECT * FROM d ORDER BY id LIMIT {REMOVALS}",
    "rel_validation": f"WITH {_EDGES} SELECT concat_ws(';', CASE WHEN source_id = target_id THEN 'self_edge' END, CASE WHEN origin = 'inferred' AND confidence IS NULL THEN 'no_confidence' END, CASE WHEN confidence < 0 OR confidence > 0.75::DOUBLE THEN 'confidence_out_of_range' END) AS problems, count(*) AS n FROM e GROUP BY 1",
    "version_history": f"""WITH v AS (SELECT o_custkey AS artifact, o_orderkey AS version, o_orderdate AS created_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 AS current FROM orders),
h AS (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY current DESC, created_at DESC, version DESC) AS position, count(*) OVER (PARTITION BY artifact) > {VERSIONS} AS more FROM v),
f AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_passage FROM lineitem GROUP BY 1)
SELECT artifact, version, position, current, more, first_passage FROM h LEFT JOIN f ON l_orderkey = version WHERE position <= {VERSIONS}""",
    "reconcile_missing": f"{_UPSERT} SELECT artifact_id, root, 'missing' AS state FROM s WHERE artifact_id NOT IN (SELECT artifact_id FROM i)",
    "bookmark_listing": f"WITH {_MARKS} SELECT ordinal, sha256(title || chr(10) || url || chr(10) || folder) AS passage_hash, sha256(folder || chr(31) || title || chr(31) || url || chr(31) || chr(31)) AS entry_hash FROM ic",
    "bookmark_parse": "WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\">[^<]*</a>', 1) AS us, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS ts FROM pages) SELECT page_id AS source, (i - 1)::INTEGER AS ordinal, 'Menu' AS folder_path, ts[i] AS title, 'http://h' || us[i] AS url, NULL::VARCHAR AS failure_code FROM l, unnest(range(1, len(us) + 1)) AS t(i)",
    "evidence_verify": f"{_REQ} SELECT passage_id FROM rq SEMI JOIN cu USING (passage_id, content_hash, text_hash)",
    "evidence_stale": f"{_REQ} SELECT passage_id, 'stale' AS status FROM rq ANTI JOIN cu USING (passage_id, content_hash, text_hash)",
    "purge_before": f"WITH {_GONE} SELECT 'artifacts' AS relation, count(*) AS n FROM g UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c FROM g) UNION ALL SELECT 'lineitem', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c FROM g)",
    "retention_cutoff": f"SELECT o_orderstatus, count(*) AS expired FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) - INTERVAL {DAYS} DAY FROM orders) GROUP BY 1",
    "library_stats": f"{_P} SELECT * FROM (SELECT count(*) AS artifacts, count(*) FILTER (enabled) AS active, coalesce(sum(byte_size), 0)::BIGINT AS bytes, count(DISTINCT root) AS roots FROM artifacts), (SELECT count(*) AS passages, sum(strlen(passage_text))::BIGINT AS passage_bytes FROM passages)",
    "storage_by_root": f"{_A} SELECT root, sum(byte_size)::BIGINT AS bytes, count(DISTINCT content_hash) AS contents FROM artifacts GROUP BY root",
    "storage_rollup": f"{_P}, c AS (SELECT 'canonical' AS class, sum(byte_size)::BIGINT AS bytes FROM artifacts UNION ALL SELECT 'derived', sum(strlen(passage_text))::BIGINT FROM passages UNION ALL SELECT 'disposable', sum(strlen(html))::BIGINT FROM pages) SELECT * FROM c UNION ALL SELECT 'total', sum(bytes)::BIGINT FROM c",
    "portable_digest": f"""{_A}, h AS (SELECT artifact_id AS i, sha256(artifact_id || chr(0) || title || chr(0) || content_hash) AS h FROM artifacts),
{", ".join(f"h{k} AS (SELECT i // 1000 AS i, sha256(string_agg(h, '|' ORDER BY i)) AS h FROM {'h' if k == 1 else f'h{k - 1}'} GROUP BY 1)" for k in (1, 2, 3, 4))}
SELECT sha256(string_agg(h, '|' ORDER BY i)) AS digest FROM h4""",
    "inspect_source": f"{_P} SELECT artifact_id, count(*) AS passages, sha256(string_agg(sha256(passage_text), ',' ORDER BY ordinal)) AS digest FROM passages WHERE enabled GROUP BY artifact_id",
    "html_sanitize": f"{_sanitized()} SELECT page_id, sha256(x) AS digest, length(x)::INTEGER AS n FROM s",
    "html_untrusted": f"{_sanitized()} SELECT page_id, {_untrusted('html')} AS raw_untrusted, {_untrusted('x')} AS clean_untrusted FROM s",
    "url_validation": "SELECT page_id, CASE WHEN contains(url, '/de/') THEN 'executable' WHEN contains(url, '/fr/') AND contains(replace(url, '://', '//'), ':') THEN 'invalid_scheme' WHEN contains(url, '/fr/') THEN 'no_scheme' WHEN contains(url, '/es/') THEN 'invalid_scheme' ELSE 'ok' END AS verdict FROM pages",
    "media_types": f"SELECT {_MEDIA(chr(117) + 'rl || ' + chr(39) + '.MD' + chr(39))} AS with_md, {_MEDIA('url')} AS plain, count(*) AS n FROM pages GROUP BY ALL",
    "text_checks": "SELECT doc_id, CASE WHEN strlen(text) > 2097152 THEN 'too_large' WHEN regexp_matches(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F]') THEN 'control_characters' ELSE 'ok' END AS verdict, CASE WHEN length(p) <= 31 THEN p ELSE left(p, 12) || '…' || right(p, 18) END AS path FROM (SELECT doc_id, text, '/corpus/' || source || '/' || lang || '/document-' || doc_id || '.md' AS p FROM documents)",
    "ocr_geometry": f"WITH {_GEO} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, px AS x, py AS y, pw AS width, ph AS height, (pw * greatest(c, 1) + 500) // 1000 AS scaled_width, CASE WHEN c >= 800 THEN 'confirmed' ELSE 'low_confidence' END AS confirmation FROM b",
    "ocr_counts": f"WITH {_GEO} SELECT CASE WHEN c >= 800 THEN 'confirmed' ELSE 'low_confidence' END AS confirmation, count(*) AS regions, count(DISTINCT l_partkey) AS images FROM b GROUP BY 1",
    "image_projection": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 4 AS t, 10 + l_suppkey AS x, 20 AS y, 30 AS w, 40 AS h, 800 + l_partkey AS iw, 2000 AS ih FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(100.0::DOUBLE * CASE t WHEN 0 THEN x WHEN 1 THEN ih - y - h WHEN 2 THEN iw - x - w ELSE y END / CASE WHEN t % 2 = 1 THEN ih ELSE iw END, 6) AS "left", round(100.0::DOUBLE * CASE t WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN ih - y - h ELSE iw - x - w END / CASE WHEN t % 2 = 1 THEN iw ELSE ih END, 6) AS top,
  round(100.0::DOUBLE * CASE WHEN t % 2 = 1 THEN h ELSE w END / CASE WHEN t % 2 = 1 THEN ih ELSE iw END, 6) AS width, round(100.0::DOUBLE * CASE WHEN t % 2 = 1 THEN w ELSE h END / CASE WHEN t % 2 = 1 THEN iw ELSE ih END, 6) AS height FROM r""",
    "running_offsets": "WITH w AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS line FROM conversations) SELECT conv_id, turn, s AS char_start, s + n AS char_end, line FROM w",
    "event_coalesce": f"WITH {_OBS} SELECT batch, path, state FROM la JOIN fl USING (batch) WHERE n <= {MAX_EVENTS}",
    "event_plans": f"WITH {_OBS}, c AS (SELECT batch, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'removed') AS removed FROM la GROUP BY 1) SELECT batch, n AS events_received, n > {MAX_EVENTS} AS full_rescan, CASE WHEN n > {MAX_EVENTS} THEN 0 ELSE changed END AS changed, CASE WHEN n > {MAX_EVENTS} THEN 0 ELSE removed END AS removed FROM fl JOIN c USING (batch)",
    "replay_filter": "SELECT event_id, CASE WHEN coalesce(round(value * 100)::BIGINT > max(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 'accept' ELSE 'replay' END AS decision FROM events",
    "late_rejection": "WITH n AS (SELECT event_id, epoch_us(ts) AS at_us, max(epoch_us(ts)) OVER (PARTITION BY user_id) AS now_us FROM events) SELECT event_id, CASE WHEN at_us + 10 * 86400000000 <= now_us THEN 'session_expired' WHEN now_us - at_us > 2 * 86400000000 THEN 'capture_time_invalid' ELSE 'ok' END AS verdict FROM n",
    "lifecycle_fold": f"""WITH x AS (SELECT user_id || '/' || ts::DATE AS capture, list({{'s': '', 'i': 0, 'e': CASE event_type WHEN 'view' THEN 'accept' WHEN 'click' THEN 'revoke' WHEN 'error' THEN 'repair' WHEN 'signup' THEN 'expire' ELSE 'delete' END}} ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
f AS (SELECT capture, list_reduce(l, lambda acc, x: {_FOLD}, {{'s': 'requested', 'i': 0, 'e': ''}}) AS r FROM x) SELECT capture, r.s AS state, r.i::BIGINT AS illegal FROM f""",
    "job_claim_order": "SELECT o_custkey AS queue, 5 - left(o_orderpriority, 1)::INTEGER AS priority, o_orderkey AS sequence, row_number() OVER (PARTITION BY o_custkey ORDER BY 5 - left(o_orderpriority, 1)::INTEGER DESC, o_orderkey) AS claim FROM orders",
    "job_listing": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 100",
    "job_states": "SELECT o_custkey AS queue, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) AS n FROM orders GROUP BY 1",
    "capture_fields": "SELECT event_type, CASE WHEN event_type = 'view' AND event_id % 10 = 0 THEN 'not_an_object' WHEN event_type = 'signup' THEN 'unknown_field' WHEN event_type = 'error' OR props IS NULL THEN 'missing_field' ELSE 'ok' END AS verdict, count(*) AS n FROM events GROUP BY ALL",
    "rate_limit": """WITH RECURSIVE o AS (SELECT user_id AS key, epoch_us(ts) AS at_us, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT key, at_us, seq, r, [at_us] AS held, 'accept' AS decision FROM o WHERE r = 1 UNION ALL
  SELECT key, at_us, seq, r, CASE WHEN len(live) < 4 THEN list_append(live, at_us) ELSE live END, CASE WHEN len(live) < 4 THEN 'accept' ELSE 'rate_limited' END
  FROM (SELECT o.key, o.at_us, o.seq, o.r, list_filter(w.held, lambda x: x + 86400000000 > o.at_us) AS live FROM w JOIN o ON o.key = w.key AND o.r = w.r + 1))
SELECT key, at_us, seq, decision FROM w""",
    "performance_corpus": "SELECT lpad(i::VARCHAR, 6, '0') || CASE WHEN (i + 20260824) % 5 = 0 THEN '.txt' ELSE '.md' END AS path, sha256('# Artifact ' || i || chr(10) || 'performance-' || lpad(i::VARCHAR, 6, '0') || chr(10) || 'body' || chr(10)) AS digest FROM range(10000) t(i)",
    "path_order": f"{_A} SELECT source_uri, row_number() OVER (PARTITION BY root ORDER BY string_split(source_uri, '/')) AS position FROM artifacts",
}
