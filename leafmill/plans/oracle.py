"""SQL of the core queries for DuckDB, written apart from the Spark plans."""

from __future__ import annotations

from leafmill.functions.text import PAGE_WORDS, WS
from leafmill.operators.recommend import GRID
from leafmill.plans.queries import GRAPH_QUERY, NOW, PHRASE

_WORDS = ", ".join(f"'{w}'" for w in PAGE_WORDS)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _squash(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '{WS}+', ' ', 'g')"


def _node_key(x: str) -> str:
    return f"replace(lower({_squash(f'coalesce({x}, {chr(39)*2})')}), 'ß', 'ss')"


def _word_set(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+|\\p{{Nd}}+'), lambda w: length(w) > 1))"


#: One row for each page, the best attempt.
PAGES = """p AS (SELECT doc_id, page, source, text, status, error, confidence, lines FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE status WHEN 'done' THEN 2 WHEN 'error' THEN 1 ELSE 0 END DESC,
    coalesce(length(text), -1) DESC, source DESC NULLS LAST, text DESC NULLS LAST, status DESC NULLS LAST, error DESC NULLS LAST, confidence DESC NULLS LAST) AS rn FROM page_results) WHERE rn = 1)"""

SHOWN = "CASE WHEN status = 'error' THEN 'Error: ' || coalesce(nullif(error, ''), 'could not read this page') ELSE coalesce(text, '') END"

NAMES = "names AS (SELECT job_id AS doc_id, max(filename) AS filename FROM jobs GROUP BY 1)"


def _banded() -> str:
    base = f"lower({_squash('line')})"
    return f"""{PAGES},
l0 AS (SELECT doc_id, page, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM p),
l1 AS (SELECT *, {_strip('line')} = '' AS blank FROM l0),
l2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, blank ORDER BY i) AS r, count(*) OVER (PARTITION BY doc_id, page, blank) AS n FROM l1),
l3 AS (SELECT *, CASE WHEN blank THEN NULL WHEN r <= least(3, n // 2) THEN 'top' WHEN r > n - least(3, n // 2) THEN 'bottom' END AS band, {base} AS base,
  regexp_extract_all({base}, '[\\p{{L}}\\p{{N}}_]+') AS w FROM l2),
l AS (SELECT doc_id, page, i, line, blank, band, CASE WHEN band IS NULL THEN NULL
  WHEN len(list_filter(w, lambda t: NOT (t IN ({_WORDS}) OR regexp_full_match(t, '\\p{{Nd}}+')))) = 0
   AND (len(list_filter(w, lambda t: t IN ({_WORDS}))) > 0 OR len(list_filter(w, lambda t: regexp_full_match(t, '\\p{{Nd}}+'))) <= 1)
  THEN regexp_replace(base, '\\p{{Nd}}+', '#', 'g') ELSE base END AS key FROM l3)"""


def _running(frac: float) -> str:
    return f"""size AS (SELECT doc_id, count(DISTINCT page) AS n_all FROM p GROUP BY 1),
k AS (SELECT l.doc_id, band, key, count(DISTINCT page) AS pages FROM l JOIN size USING (doc_id) WHERE band IS NOT NULL AND key <> '' GROUP BY l.doc_id, band, key, n_all
  HAVING n_all >= 3 AND count(DISTINCT page) >= greatest(2, ceil({frac}::DOUBLE * n_all)))"""


def _stripped(frac: float) -> str:
    return f"""WITH {_banded()}, {_running(frac)},
m AS (SELECT l.*, k.key IS NOT NULL AS run FROM l LEFT JOIN k ON l.doc_id = k.doc_id AND l.band = k.band AND l.key = k.key),
t AS (SELECT DISTINCT doc_id FROM k),
g AS (SELECT m.doc_id, m.page, t.doc_id IS NOT NULL AS touched, bool_or(NOT blank) AS filled, bool_or(NOT blank AND NOT run) AS remains,
  string_agg(line, chr(10) ORDER BY i) AS whole, coalesce(string_agg(CASE WHEN NOT run THEN line END, chr(10) ORDER BY i), '') AS part,
  string_agg(i::VARCHAR, ',' ORDER BY i) AS all_i, coalesce(string_agg(CASE WHEN NOT run THEN i::VARCHAR END, ',' ORDER BY i), '') AS part_i
  FROM m LEFT JOIN t USING (doc_id) GROUP BY m.doc_id, m.page, t.doc_id)
SELECT doc_id, page, CASE WHEN NOT touched THEN whole WHEN filled AND NOT remains THEN trim(whole, chr(10)) ELSE regexp_replace(trim(part, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') END AS text,
  CASE WHEN NOT touched OR (filled AND NOT remains) THEN all_i ELSE part_i END AS kept FROM g"""


def _blocks(title: str, body: str) -> str:
    return f"""WITH {PAGES}, {NAMES}
SELECT doc_id, 0 AS page, {title} AS block FROM (SELECT DISTINCT doc_id FROM p) LEFT JOIN names USING (doc_id)
UNION ALL SELECT doc_id, page, {body} AS block FROM (SELECT doc_id, page, {SHOWN} AS shown FROM p)"""


def _rows(shift: str, floor: float) -> str:
    return f"""WITH RECURSIVE b AS (SELECT l_orderkey AS page, (l_partkey * 7 % 400)::DOUBLE AS y0, (l_suppkey * 13 % 101)::DOUBLE AS x, (4 + l_linenumber % 5 * 6)::DOUBLE AS h,
  l_linestatus || '-' || l_linenumber AS text, 1.0::DOUBLE - l_discount AS confidence FROM lineitem),
c AS (SELECT *, y0 {shift} AS y FROM b),
t AS (SELECT page, greatest(coalesce(median(h) FILTER (WHERE h > 0), 12.0) * 0.6::DOUBLE, {floor}::DOUBLE) AS tol FROM c GROUP BY 1),
o AS (SELECT c.*, tol, row_number() OVER (PARTITION BY page ORDER BY y, x, text, confidence) AS n FROM c JOIN t USING (page)),
r AS (SELECT page, n, y AS anchor, 0 AS row_no, x, y, text, confidence FROM o WHERE n = 1
  UNION ALL SELECT o.page, o.n, CASE WHEN abs(o.y - r.anchor) > o.tol THEN o.y ELSE r.anchor END, r.row_no + CASE WHEN abs(o.y - r.anchor) > o.tol THEN 1 ELSE 0 END, o.x, o.y, o.text, o.confidence
  FROM r JOIN o ON o.page = r.page AND o.n = r.n + 1)
SELECT page, row_no, (row_number() OVER (PARTITION BY page ORDER BY row_no, x, y, text, confidence) - 1)::INT AS pos, text FROM r"""


_SWEEP = f"""s AS (SELECT l_orderkey // 8 AS page_id, list_value({", ".join(f"'{g[0]}'" for g in GRID)})[l_linenumber % 4 + 1] AS config, p_name AS text, 1.0::DOUBLE - l_discount * 4 AS confidence
  FROM lineitem JOIN part ON l_partkey = p_partkey),
st AS (SELECT page_id, config, avg(confidence) AS mean_conf, count(*) FILTER (WHERE confidence >= 0.8::DOUBLE) AS n_conf, coalesce(sum(length(trim(text))) FILTER (WHERE confidence >= 0.8::DOUBLE), 0)::BIGINT AS mass FROM s GROUP BY 1, 2),
w AS (SELECT DISTINCT page_id, config, unnest(regexp_extract_all(lower(text), '[0-9a-z\\x{{900}}-\\x{{97f}}]+')) AS word FROM s WHERE confidence >= 0.8::DOUBLE),
w2 AS (SELECT *, count(*) OVER (PARTITION BY page_id, word) >= 2 AS shared FROM w),
ag AS (SELECT page_id, config, count(*) FILTER (WHERE shared) / count(*)::DOUBLE AS agree FROM w2 GROUP BY 1, 2),
sc AS (SELECT page_id, config, mean_conf, n_conf, mass, coalesce(agree, 0) AS agree,
  0.3::DOUBLE * coalesce(mean_conf / nullif(max(mean_conf) OVER pg, 0), 0) + 0.3::DOUBLE * coalesce(n_conf / nullif(max(n_conf) OVER pg, 0)::DOUBLE, 0)
  + 0.2::DOUBLE * coalesce(mass / nullif(max(mass) OVER pg, 0)::DOUBLE, 0) + 0.2::DOUBLE * coalesce(agree, 0) AS score
  FROM st LEFT JOIN ag USING (page_id, config) WINDOW pg AS (PARTITION BY page_id))"""

_GRAPH = f"""t AS (SELECT doc_id, seq, any_value(page) AS page, any_value(subject) AS subject, any_value(predicate) AS predicate, any_value(object) AS object FROM kg_triples GROUP BY 1, 2),
me AS (SELECT doc_id, seq, 0 AS role, subject AS name, page FROM t UNION ALL SELECT doc_id, seq, 1, object, page FROM t),
mk AS (SELECT *, {_node_key('name')} AS key FROM me),
n0 AS (SELECT doc_id, key, min(seq * 2 + role) AS first, arg_min({_strip('name')}, seq * 2 + role) AS name, 'OTHER' AS type, list_sort(list(DISTINCT page) FILTER (WHERE page IS NOT NULL)) AS pages FROM mk WHERE key <> '' GROUP BY 1, 2),
nd AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS node_id, key, name, type, coalesce(pages, []) AS pages FROM n0),
ed AS (SELECT t.doc_id, t.seq, t.page, a.node_id AS subject_id, b.node_id AS object_id, {_strip("coalesce(t.predicate, '')")} AS predicate, a.name AS subject, b.name AS object
  FROM t JOIN nd a ON a.doc_id = t.doc_id AND a.key = {_node_key('t.subject')} JOIN nd b ON b.doc_id = t.doc_id AND b.key = {_node_key('t.object')} WHERE a.node_id <> b.node_id),
ad AS (SELECT doc_id, subject_id AS node_id, object_id AS other_id, seq FROM ed UNION ALL SELECT doc_id, object_id, subject_id, seq FROM ed),
dg AS (SELECT nd.*, coalesce(d.degree, 0)::INT AS degree FROM nd LEFT JOIN (SELECT doc_id, node_id, count(*) AS degree FROM ad GROUP BY 1, 2) d USING (doc_id, node_id))"""


def _search() -> str:
    levels = []
    for d in (1, 2):
        before = " UNION ALL ".join(f"SELECT doc_id, node_id FROM v{i}" for i in range(d))
        levels.append(f"""c{d} AS (SELECT ad.doc_id, ad.other_id AS node_id, v.pos AS ppos, ad.seq, v.src, list_append(v.chain, ad.seq::BIGINT) AS chain FROM v{d - 1} v JOIN ad USING (doc_id, node_id)
  WHERE NOT EXISTS (SELECT 1 FROM ({before}) x WHERE x.doc_id = ad.doc_id AND x.node_id = ad.other_id)),
f{d} AS (SELECT * FROM c{d} QUALIFY row_number() OVER (PARTITION BY doc_id, node_id ORDER BY ppos, seq) = 1),
v{d} AS (SELECT doc_id, node_id, {d} AS dist, src, row_number() OVER (PARTITION BY doc_id ORDER BY ppos, seq) + {d} * 1000000000000 AS pos, chain FROM f{d})""")
    q = _word_set("'" + GRAPH_QUERY + "'")
    return f"""{_GRAPH},
se AS (SELECT doc_id, node_id, len(list_intersect(ws, qs))::DOUBLE / nullif(len(list_distinct(list_concat(ws, qs))), 0) * CASE WHEN len(ws) = 0 THEN 0 ELSE 1 END AS sem FROM (SELECT doc_id, node_id, {_word_set('name')} AS ws, {q} AS qs FROM nd)),
sd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sem DESC, node_id) AS rank FROM se WHERE sem > 0 QUALIFY rank <= 6),
v0 AS (SELECT doc_id, node_id, 0 AS dist, node_id AS src, rank AS pos, []::BIGINT[] AS chain FROM sd), {", ".join(levels)},
re AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2),
rk AS (SELECT re.*, coalesce(se.sem, 0) AS sem, 0.6::DOUBLE * coalesce(se.sem, 0) + 0.4::DOUBLE * sd.sem * pow(0.55::DOUBLE, dist) AS score FROM re LEFT JOIN se ON se.doc_id = re.doc_id AND se.node_id = re.node_id JOIN sd ON sd.doc_id = re.doc_id AND sd.node_id = re.src),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, dist, pos) AS rank FROM rk QUALIFY rank <= 10),
fa AS (SELECT doc_id, node_id, list(seq ORDER BY seq) AS facts FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, node_id ORDER BY seq) AS r FROM ad) WHERE r <= 6 GROUP BY 1, 2),
pp AS (SELECT x.doc_id, x.node_id, list_sort(list(DISTINCT ed.page) FILTER (WHERE ed.page IS NOT NULL)) AS path_pages FROM (SELECT doc_id, node_id, unnest(chain) AS seq FROM top) x JOIN ed ON ed.doc_id = x.doc_id AND ed.seq = x.seq GROUP BY 1, 2)"""


def _unquoted(x: str) -> str:
    """A JSON value, or the one within a string that itself is JSON."""
    one = lambda y: f"(CASE WHEN json_type({y}) = 'VARCHAR' AND regexp_matches({y}->>'$', '^\\s*[\\[{{\"]') AND json_valid({y}->>'$') THEN ({y}->>'$')::JSON ELSE {y} END)"
    return one(x)


def _items(x: str) -> str:
    """Elements of a container as a list of (place, key, val): an array, an object keyed by number, or one bare element."""
    return f"""(CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN []
  WHEN json_type({x}) = 'ARRAY' THEN list_transform(json_extract({x}, '$[*]'), lambda el, nr: {{'place': nr, 'key': NULL::VARCHAR, 'val': el}})
  WHEN json_type({x}) = 'OBJECT' AND len(json_keys({x})) > 0 AND len(list_filter(json_keys({x}), lambda ky: NOT regexp_full_match(ky, '\\s*[0-9]{{1,9}}\\s*'))) = 0
    THEN list_transform(json_keys({x}), lambda ky, nr: {{'place': nr, 'key': ky, 'val': json_extract({x}, '$."' || ky || '"')}})
  ELSE [{{'place': 1::BIGINT, 'key': NULL::VARCHAR, 'val': {x}}}] END)"""


def _object(x: str) -> str:
    return f"(CASE WHEN json_type({x}) = 'OBJECT' THEN {x} END)"


def _int(x: str) -> str:
    return f"TRY_CAST({x} AS BIGINT)"


#: Jobs, pages, lines and alternatives of lines of the dumps.
_DUMPS = f"""d0 AS (SELECT DISTINCT dump_id, body FROM job_dumps WHERE json_valid(body)),
d1 AS (SELECT dump_id, body::JSON AS v, dump_id || CASE WHEN row_number() OVER w > 1 THEN '~' || row_number() OVER w ELSE '' END AS root FROM d0 WINDOW w AS (PARTITION BY dump_id ORDER BY body)),
d2 AS (SELECT dump_id, root, unnest({_items('u')}) AS e FROM (SELECT *, {_unquoted('v')} AS u FROM d1)),
j0 AS (SELECT dump_id, root AS parent_key, root || '/job:' || coalesce(trim(e.key), e.place::VARCHAR) AS job_key, coalesce({_int('e.key')}, e.place)::INT AS ordinal, {_unquoted('e.val')} AS o FROM d2),
j AS (SELECT *, coalesce({_object("(o->'payload'->'job')")}, {_object("(o->'job')")}, o) AS v FROM j0 WHERE json_type(o) = 'OBJECT'),
p0 AS (SELECT dump_id, job_key AS parent_key, unnest({_items('c')}) AS e FROM (SELECT *, {_unquoted("(v->'pages')")} AS c FROM j)),
p1 AS (SELECT *, {_unquoted('e.val')} AS o FROM p0 WHERE json_type(e.val) <> 'NULL'),
pg AS (SELECT *, parent_key || '/page:' || coalesce(trim(e.key), e.place::VARCHAR) AS page_key, coalesce({_object("(o->'result')")}, o) AS v,
  coalesce({_int("(o->>'page')")}, {_int("(o->'result'->>'page')")}, {_int('e.key')}, e.place)::INT AS ordinal FROM p1),
l0 AS (SELECT dump_id, ordinal AS page_no, page_key AS parent_key, CASE WHEN (v->'lines') IS NULL OR json_type((v->'lines')) = 'NULL'
  THEN CASE WHEN json_type((v->'blocks')) = 'ARRAY' THEN to_json(flatten(list_transform(json_extract(v, '$.blocks[*]'), lambda b: CASE WHEN json_type((b->'lines')) = 'ARRAY' THEN json_extract(b, '$.lines[*]') ELSE [] END))) END
  ELSE {_unquoted("(v->'lines')")} END AS c FROM pg WHERE json_type(v) = 'OBJECT'),
l1 AS (SELECT dump_id, page_no, parent_key, unnest({_items('c')}) AS e FROM l0),
ln AS (SELECT dump_id, page_no, parent_key, parent_key || '/line:' || coalesce(trim(e.key), e.place::VARCHAR) AS line_key, coalesce({_int('e.key')}, e.place)::INT AS ordinal, e.val AS v FROM l1 WHERE json_type(e.val) <> 'NULL'),
al AS (SELECT dump_id, page_no, ordinal AS line_no, line_key AS parent_key, unnest({_items("(v->'alternatives')")}) AS e FROM ln WHERE json_type(v) = 'OBJECT')"""


def oracle_sql() -> dict[str, str]:
    layer = "length(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]', '', 'g'))"
    safe = "regexp_replace(coalesce(@, ''), '[\\x{00}-\\x{08}\\x{0b}\\x{0c}\\x{0e}-\\x{1f}]', '', 'g')"
    return {
        "p3_found": f"WITH {_DUMPS} SELECT DISTINCT dump_id, page_no, ordinal AS line_no FROM ln",
        "p3_jobs": f"""WITH {_DUMPS} SELECT dump_id, job_key, parent_key, ordinal, (v->>'error') AS error, (v->>'filename') AS filename, (v->>'job_id') AS job_id, {_int("coalesce((v->'meta'->>'version'), (o->'meta'->>'version'))")} AS meta_version,
{_int("(v->>'processed_pages')")} AS processed_pages, (v->>'status') AS status, {_int("(v->>'total_pages')")} AS total_pages FROM j""",
        "p3_pages": f"""WITH {_DUMPS} SELECT dump_id, page_key, parent_key, ordinal, (v->>'confidence') AS confidence, (v->>'error') AS error, coalesce((o->>'page'), (v->>'page')) AS page, (v->>'source') AS source, (v->>'status') AS status, (v->>'text') AS text FROM pg""",
        "p3_lines": f"""WITH {_DUMPS} SELECT dump_id, page_no, line_key, parent_key, ordinal, TRY_CAST(CASE WHEN json_type(v) = 'OBJECT' THEN (v->>'confidence') END AS DOUBLE) AS confidence, CASE WHEN json_type(v) = 'OBJECT' THEN (v->>'text') ELSE (v->>'$') END AS text FROM ln""",
        "p3_alternatives": f"""WITH {_DUMPS} SELECT dump_id, page_no, line_no, parent_key || '/pages_lines_alternatives:' || coalesce(trim(e.key), e.place::VARCHAR) AS pages_lines_alternatives_key, parent_key, coalesce({_int('e.key')}, e.place)::INT AS ordinal,
TRY_CAST((e.val->>'confidence') AS DOUBLE) AS confidence, (e.val->>'text') AS text FROM al WHERE json_type(e.val) <> 'NULL'""",
        "q_best_pages": f"WITH {PAGES} SELECT doc_id, page, source, text, status, error, confidence FROM p",
        "q_text_layer": f"WITH {PAGES} SELECT doc_id, page, {layer} AS letters, {layer} >= 50 AS has_text FROM p",
        "q_page_route": f"""WITH {PAGES}, j AS (SELECT job_id AS doc_id, bool_or(force_ocr) AS force_ocr, bool_or(online) AS online, bool_or(handwriting) AS handwriting FROM jobs GROUP BY 1),
h AS (SELECT doc_id, page, CASE WHEN source = 'text' THEN {layer} >= 50 ELSE false END AS has_text FROM p)
SELECT doc_id, page, has_text, CASE WHEN has_text AND NOT coalesce(force_ocr, false) THEN 'text' WHEN coalesce(online, false) THEN 'online' WHEN coalesce(handwriting, false) THEN 'handwriting' ELSE 'ocr' END AS route FROM h LEFT JOIN j USING (doc_id)""",
        "q_header_keys": f"WITH {_banded()}, {_running(0.5)} SELECT doc_id, band, key, pages FROM k",
        "q_strip_headers": _stripped(0.7),
        "q_strip_headers_low": _stripped(0.3),
        "q_line_confidence": f"""WITH {PAGES}, c AS (SELECT doc_id, page, lines, list_filter(list_transform(lines, lambda x: x.confidence), lambda y: y IS NOT NULL) AS k FROM p)
SELECT doc_id, page, round(list_avg(k), 6) AS mean_confidence, coalesce(len(lines), 0)::INT AS n_lines, coalesce(len(list_filter(k, lambda y: y < 0.85::DOUBLE)), 0)::INT AS n_low,
coalesce(len(list_filter(k, lambda y: y >= 0.8::DOUBLE)), 0)::INT AS n_confident, coalesce(list_sum(list_transform(list_filter(lines, lambda x: x.confidence >= 0.8::DOUBLE), lambda x: length({_strip("coalesce(x.text, '')")}))), 0)::INT AS mass FROM c""",
        "q_page_labels": f"""WITH {PAGES} SELECT doc_id, page, CASE WHEN status = 'error' THEN 'Error' WHEN source = 'text' THEN 'Text layer' WHEN source = 'handwriting' THEN 'Handwriting' WHEN source = 'online' THEN 'Online'
WHEN source = 'ocr' THEN CASE WHEN confidence IS NOT NULL THEN 'OCR · ' || floor(confidence * 100 + 0.5)::BIGINT || '%' ELSE 'OCR' END END AS badge, {SHOWN} AS shown, coalesce(status = 'done' AND confidence < 0.85::DOUBLE, false) AS low FROM p""",
        "q_search": f"""WITH {PAGES}, l AS (SELECT doc_id, page, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS line FROM p)
SELECT doc_id, page, sum((length(line) - length(replace(line, '{PHRASE}', ''))) // {len(PHRASE)})::BIGINT AS matches FROM l GROUP BY 1, 2 HAVING matches > 0""",
        "q_export_txt": _blocks("'===== ' || coalesce(filename, '') || ' =====' || chr(10)", "'--- Page ' || page || ' ---' || chr(10) || shown || chr(10)"),
        "q_export_copy": _blocks("'===== ' || coalesce(filename, '') || ' ====='", "'--- Page ' || page || ' ---' || chr(10) || shown"),
        "q_export_md": _blocks("'# ' || coalesce(filename, '') || chr(10)", "'## Page ' || page || chr(10) || chr(10) || coalesce(nullif(shown, ''), '_(no text)_') || chr(10)"),
        "q_export_json": f"WITH {PAGES} SELECT doc_id, page, to_json({{'page': page, 'source': source, 'status': status, 'confidence': confidence, 'text': text}})::VARCHAR AS json FROM p",
        "q_outline": f"""WITH {PAGES}, {NAMES}, x AS (SELECT doc_id, page, source, confidence, {safe.replace('@', 'text')} AS t FROM p), b AS (SELECT *, {_strip('t')} = '' AS blank FROM x)
SELECT doc_id, 0 AS page, 0 AS seq, 'h1' AS kind, {safe.replace('@', "coalesce(nullif(filename, ''), 'Document')")} AS text FROM (SELECT DISTINCT doc_id FROM p) LEFT JOIN names USING (doc_id)
UNION ALL SELECT doc_id, page, 0, 'h2', 'Page ' || page || CASE WHEN source = 'ocr' THEN CASE WHEN confidence IS NOT NULL AND isfinite(confidence) THEN ' — OCR (' || round_even(confidence * 100, 0)::BIGINT || '%)' ELSE ' — OCR' END WHEN source = 'text' THEN ' — Text layer' ELSE '' END FROM b
UNION ALL SELECT doc_id, page, unnest(range(len(string_split(t, chr(10)))))::INT + 1, 'p', unnest(string_split(t, chr(10))) FROM b WHERE NOT blank
UNION ALL SELECT doc_id, page, 1, 'empty', '(no text on this page)' FROM b WHERE blank""",
        "q_reading_order": _rows("", 6),
        "q_reading_order_handwriting": _rows("+ h / 2", 8),
        "q_settings_scores": f"WITH {_SWEEP} SELECT page_id, config, round(mean_conf, 6) AS mean_conf, n_conf, mass, round(agree, 6) AS agree, round(score, 6) AS score FROM sc",
        "q_settings_choice": f"""WITH {_SWEEP}, e AS (SELECT config, avg(score) AS c, round(avg(mean_conf), 3) AS mean_conf, round(avg(n_conf), 1) AS confident_lines FROM sc GROUP BY 1),
d AS (SELECT (SELECT max(c) FROM e WHERE config <> 'max_gray') - (SELECT c FROM e WHERE config = 'max_gray') AS m, (SELECT config FROM e WHERE config <> 'max_gray' ORDER BY c DESC, list_position(['max_gray', 'max_gray_raw', 'max_binarize', 'fast_gray'], config) LIMIT 1) AS b)
SELECT config, round(c, 3) AS composite, mean_conf, confident_lines, CASE WHEN m >= 0.08::DOUBLE THEN 'decisive' WHEN m >= 0.03::DOUBLE THEN 'marginal' ELSE 'inconclusive' END AS decision,
config = CASE WHEN m >= 0.03::DOUBLE THEN b ELSE 'max_gray' END AS recommended FROM e, d""",
        "q_suggest": f"""WITH {_SWEEP}, e AS (SELECT config, avg(score) AS c, round(avg(mean_conf), 3) AS mean_conf, round(avg(n_conf), 1) AS confident_lines FROM sc GROUP BY 1),
d AS (SELECT (SELECT max(c) FROM e WHERE config <> 'max_gray') - (SELECT c FROM e WHERE config = 'max_gray') AS m, (SELECT config FROM e WHERE config <> 'max_gray' ORDER BY c DESC, list_position(['max_gray', 'max_gray_raw', 'max_binarize', 'fast_gray'], config) LIMIT 1) AS b),
ch AS (SELECT config, round(c, 3) AS composite, mean_conf, confident_lines, CASE WHEN m >= 0.08::DOUBLE THEN 'decisive' WHEN m >= 0.03::DOUBLE THEN 'marginal' ELSE 'inconclusive' END AS decision,
config = CASE WHEN m >= 0.03::DOUBLE THEN b ELSE 'max_gray' END AS recommended FROM e, d),
o AS (SELECT *, list_position(['max_gray', 'max_gray_raw', 'max_binarize', 'fast_gray'], config) AS o FROM ch)
SELECT max(decision) AS decision, CASE WHEN max(config) FILTER (WHERE recommended) = 'fast_gray' THEN 'fast' ELSE 'max' END AS mode, 'en' AS lang, max(config) FILTER (WHERE recommended) <> 'max_gray_raw' AS preprocess,
max(config) FILTER (WHERE recommended) = 'max_binarize' AS binarize, round(max(composite) FILTER (WHERE recommended) - max(composite) FILTER (WHERE config = 'max_gray'), 3) AS margin,
string_agg(config || '=' || composite, ' ' ORDER BY composite DESC, o) AS evidence, CASE WHEN max(decision) = 'inconclusive' THEN 'No other settings clearly beat the default on the sampled pages; the default is recommended.'
ELSE 'On the sampled pages, ' || CASE max(config) FILTER (WHERE recommended) WHEN 'max_binarize' THEN 'binarisation on' WHEN 'max_gray_raw' THEN 'preprocessing off' WHEN 'fast_gray' THEN 'faster mode' ELSE 'the default settings' END || CASE max(decision) WHEN 'decisive' THEN ' clearly' ELSE ' slightly' END || ' outscored the default. Verify against the original.' END AS rationale FROM o""",
        "q_sampled_pages": f"""WITH {PAGES}, h AS (SELECT doc_id, page, CASE WHEN source = 'text' THEN {layer} >= 50 ELSE false END AS has_text, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM p),
b AS (SELECT *, coalesce(sum(CASE WHEN has_text THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h WHERE i <= 9)
SELECT doc_id, page FROM b WHERE before < 2 AND NOT has_text""",
        "q_born_digital": f"""WITH {PAGES}, h AS (SELECT doc_id, CASE WHEN source = 'text' THEN {layer} >= 50 ELSE false END AS has_text FROM p)
SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE has_text) AS text_pages, count(*) FILTER (WHERE has_text) < count(*) AS needs_ocr FROM h GROUP BY 1""",
        "q_graph_json": f"""WITH {_GRAPH} SELECT doc_id, 'entity' AS kind, node_id::BIGINT AS ord, to_json({{'name': name, 'type': type, 'pages': pages, 'degree': degree}})::VARCHAR AS json FROM dg
UNION ALL SELECT doc_id, 'triple', seq, to_json({{'subject': subject, 'predicate': predicate, 'object': object, 'page': page}})::VARCHAR FROM ed""",
        "q_graph_nodes": f"WITH {_GRAPH} SELECT doc_id, node_id, name, type, array_to_string(pages, ',') AS pages, degree FROM dg",
        "q_graph_edges": f"WITH {_GRAPH} SELECT doc_id, seq, page, subject_id, object_id, predicate, subject, object FROM ed",
        "q_graph_texts": f"""WITH {_GRAPH}, i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, node_id ORDER BY seq) AS r FROM ad),
f AS (SELECT i.doc_id, i.node_id, string_agg(subject || ' ' || predicate || ' ' || object, '. ' ORDER BY i.seq) AS t FROM i JOIN ed ON ed.doc_id = i.doc_id AND ed.seq = i.seq WHERE r <= 3 GROUP BY 1, 2)
SELECT doc_id, node_id, concat_ws('. ', name || ' (' || type || ')', t) AS text FROM nd LEFT JOIN f USING (doc_id, node_id)""",
        "q_graph_strongest": f"""WITH {_GRAPH}, top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY degree DESC, node_id) AS r FROM dg QUALIFY r <= 120),
k AS (SELECT ed.doc_id, count(*) AS edges FROM ed JOIN top a ON a.doc_id = ed.doc_id AND a.node_id = subject_id JOIN top b ON b.doc_id = ed.doc_id AND b.node_id = object_id GROUP BY 1)
SELECT doc_id, count(*) AS nodes, min(degree) AS least_degree, sum(node_id)::BIGINT AS ids, coalesce(any_value(edges), 0) AS edges FROM top LEFT JOIN k USING (doc_id) GROUP BY 1""",
        "q_graph_summary": f"WITH {_GRAPH} SELECT doc_id, count(*) AS num_nodes, coalesce((SELECT count(*) FROM ed WHERE ed.doc_id = nd.doc_id), 0) AS num_edges FROM nd GROUP BY 1",
        "q_graph_search": f"""WITH {_search()} SELECT top.doc_id, rank, name, type, round(score, 4) AS score, round(sem, 4) AS similarity, dist AS hops, array_to_string(pages, ',') AS pages, array_to_string(chain, ',') AS chain,
coalesce(array_to_string(path_pages, ','), '') AS path_pages, coalesce(array_to_string(facts, ','), '') AS facts FROM top JOIN nd USING (doc_id, node_id) LEFT JOIN pp USING (doc_id, node_id) LEFT JOIN fa USING (doc_id, node_id)""",
        "q_graph_search_support": f"""WITH {_search()}, u AS (SELECT doc_id, unnest(chain) AS seq FROM top UNION SELECT doc_id, unnest(facts) FROM top JOIN fa USING (doc_id, node_id))
SELECT ed.doc_id, ed.seq, subject, predicate, object, page FROM ed JOIN u ON u.doc_id = ed.doc_id AND u.seq = ed.seq""",
        "q_vector_seeds": """WITH v AS (SELECT node_id, max(vec) AS vec FROM kg_vectors WHERE vec IS NOT NULL GROUP BY 1), q AS (SELECT arg_min(vec, node_id) AS q FROM v),
s AS (SELECT node_id, round((CASE WHEN list_sum(list_transform(vec, lambda x: x::DOUBLE * x)) = 0 THEN 0 ELSE list_cosine_similarity(vec::DOUBLE[], q::DOUBLE[]) END + 1) / 2, 6) AS sem FROM v, q)
SELECT node_id, sem FROM s WHERE sem > 0 ORDER BY sem DESC, node_id LIMIT 50""",
        "q_job_state": """WITH e AS (SELECT *, TRY_CAST(payload->>'$.processed' AS INT) AS pr, TRY_CAST(payload->>'$.total' AS INT) AS tt, CASE WHEN type IN ('done', 'error', 'cancelled') THEN type WHEN type = 'progress' THEN 'processing' END AS known FROM job_events),
g AS (SELECT job_id, coalesce(arg_max(known, (seq, ts)) FILTER (WHERE known IS NOT NULL), 'pending') AS status, coalesce(max(pr) FILTER (WHERE type = 'progress'), 0) AS processed, coalesce(max(tt), 0) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY 1)
SELECT *, CASE WHEN total > 0 THEN least(100, floor(100.0::DOUBLE * processed / total + 0.5)::INT) ELSE 0 END AS percent FROM g""",
        "q_job_pages": "SELECT job_id, page, max(seq) AS seq, arg_max(type, (seq, type)) AS type FROM job_events WHERE page IS NOT NULL GROUP BY 1, 2",
        "q_job_frames": """WITH e AS (SELECT job_id, seq, any_value(type) AS type, any_value(page) AS page, any_value(payload) AS payload FROM job_events GROUP BY 1, 2),
x AS (SELECT *, min(CASE WHEN type IN ('done', 'error', 'cancelled') THEN seq END) OVER (PARTITION BY job_id) AS last FROM e)
SELECT job_id, seq, 'data: {"type":"' || type || '","page":' || coalesce(page::VARCHAR, 'null') || ',"payload":' || coalesce(payload, 'null') || '}' || chr(10) || chr(10) AS frame FROM x WHERE last IS NULL OR seq <= last""",
        "q_export_documents": f"""WITH {PAGES}, n AS (SELECT job_id AS doc_id, max(filename) AS filename, max(status) AS status, max(total_pages) AS total_pages FROM jobs GROUP BY 1)
SELECT p.doc_id, to_json({{'filename': any_value(n.filename), 'job_id': p.doc_id, 'status': any_value(n.status), 'total_pages': any_value(n.total_pages),
 'pages': list({{'page': page, 'source': source, 'status': p.status, 'confidence': confidence, 'text': text}} ORDER BY page)}})::VARCHAR AS json FROM p LEFT JOIN n ON n.doc_id = p.doc_id GROUP BY p.doc_id""",
        "q_graph_documents": f"""WITH {_GRAPH}, f AS (SELECT job_id AS doc_id, max(filename) AS filename FROM jobs GROUP BY 1),
en AS (SELECT doc_id, count(*) AS n, to_json(list({{'name': name, 'type': type, 'pages': pages, 'degree': degree}} ORDER BY node_id))::VARCHAR AS j FROM dg GROUP BY 1),
tr AS (SELECT doc_id, count(*) AS n, to_json(list({{'subject': subject, 'predicate': predicate, 'object': object, 'page': page}} ORDER BY seq))::VARCHAR AS j FROM ed GROUP BY 1)
SELECT en.doc_id, filename, en.n AS num_nodes, coalesce(tr.n, 0) AS num_edges, 'none' AS embed_model, en.j AS entities, coalesce(tr.j, '[]') AS triples FROM en LEFT JOIN tr USING (doc_id) LEFT JOIN f USING (doc_id)""",
        "q_search_total": f"""WITH {PAGES}, l AS (SELECT doc_id, page, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS line FROM p), m AS (SELECT doc_id, page, sum((length(line) - length(replace(line, '{PHRASE}', ''))) // {len(PHRASE)})::BIGINT AS k FROM l GROUP BY 1, 2)
SELECT doc_id, sum(k)::BIGINT AS matches, count(*) AS pages FROM m WHERE k > 0 GROUP BY 1""",
        "q_graph_seeds": f"""WITH n AS (SELECT DISTINCT doc_id, node_id, name FROM kg_nodes), v AS (SELECT node_id, max(vec) AS vec FROM kg_vectors WHERE vec IS NOT NULL GROUP BY 1), q AS (SELECT arg_min(vec, node_id)::DOUBLE[] AS q FROM v),
j AS (SELECT n.*, vec::DOUBLE[] AS vec FROM n LEFT JOIN v USING (node_id)), m AS (SELECT doc_id, CASE WHEN bool_and(vec IS NOT NULL AND len(vec) = len(q)) THEN 'vector' ELSE 'lexical' END AS mode FROM j, q GROUP BY 1),
s AS (SELECT doc_id, node_id, mode, round(CASE WHEN mode = 'vector' THEN (CASE WHEN list_sum(list_transform(vec, lambda x: x * x)) = 0 THEN 0 ELSE list_cosine_similarity(vec, q) END + 1) / 2
 WHEN len(ws) = 0 OR len(qs) = 0 THEN 0 ELSE len(list_intersect(ws, qs))::DOUBLE / len(list_distinct(list_concat(ws, qs))) END, 6) AS sem FROM (SELECT *, {_word_set('name')} AS ws, {_word_set("'" + GRAPH_QUERY + "'")} AS qs FROM j JOIN m USING (doc_id), q))
SELECT doc_id, mode, node_id, sem, row_number() OVER (PARTITION BY doc_id ORDER BY sem DESC, node_id)::INT AS rank FROM s WHERE sem > 0 QUALIFY rank <= 6""",
        "q_jobs_evicted": f"""WITH g AS (SELECT job_id, arg_max(type, (seq, ts)) FILTER (WHERE type IN ('done', 'error', 'cancelled', 'progress')) AS status, max(ts) AS last_ts FROM job_events GROUP BY 1),
d AS (SELECT *, epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_ts) AS age FROM g WHERE status IN ('done', 'error', 'cancelled')),
f AS (SELECT *, row_number() OVER (ORDER BY last_ts DESC, job_id DESC) AS r FROM d WHERE age <= 172800000000)
SELECT job_id, 'ttl' AS reason FROM d WHERE age > 172800000000 UNION ALL SELECT job_id, 'lru' FROM f WHERE r > 50""",
        "q_payload_triples": f"""WITH t AS (SELECT doc_id, seq, {_strip("coalesce(any_value(subject), '')")} AS subject, {_strip("coalesce(any_value(predicate), '')")} AS predicate, {_strip("coalesce(any_value(object), '')")} AS object FROM kg_triples GROUP BY doc_id, seq)
SELECT * FROM t WHERE subject <> '' AND predicate <> '' AND object <> ''""",
        "q_filenames": """SELECT DISTINCT job_id, coalesce(regexp_matches(filename, '(?i)\\.pdf$'), false) AS is_pdf, coalesce(nullif(regexp_replace(filename, '(?i)\\.pdf$', ''), ''), 'extraction') AS base,
CASE WHEN lower(trim(coalesce(lang, ''))) IN ('hi', 'hin', 'hindi', 'mr', 'marathi', 'sa') THEN 'hi' WHEN lower(trim(coalesce(lang, ''))) IN ('ne', 'nep', 'nepali', 'devanagari') THEN 'ne' ELSE 'en' END AS model,
CASE WHEN regexp_matches(lower(coalesce(error, '')), 'encrypt|password|needs_pass') THEN 'encrypted' WHEN regexp_matches(lower(coalesce(error, '')), 'corrupt|cannot open|damaged') THEN 'corrupt' ELSE 'other' END AS failure,
CASE WHEN length(filename) > 12 THEN substring(filename, 1, 12) || '…' ELSE filename END AS short, greatest(36, least(600, total_pages)) AS clamped, coalesce(preprocess, false) AS truthy, coalesce(nullif(regexp_replace(trim(online_model), '^models/', ''), ''), 'none') AS online_model FROM jobs""",
    }
