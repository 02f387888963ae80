"""The queries of ``parts`` in DuckDB's SQL. What a function makes of a derived input is stated
as the expected value wherever that is short enough, and worked out in SQL elsewhere."""

from __future__ import annotations

from . import oracles as o
from .oracles import CARDS, CLAUSES, LINES, MARKERS, PARAGRAPHS, REFS, SCAN, SCORES, SENTENCES, _clean, _collapse, _strip, _with


def _paper(k: str) -> str:
    return f"(lpad(CAST({k} % 8 + 20 AS VARCHAR), 2, '0') || lpad(CAST({k} % 12 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST({k} % 99991 AS VARCHAR), 5, '0'))"


PAPERS = f"""
pp AS (SELECT {_paper("o_orderkey")} AS p, min(o_orderkey) AS k FROM orders GROUP BY 1),
pm AS (SELECT *, '20' || substr(p, 1, 2) || '_new/20' || substr(p, 1, 2) || '-' || substr(p, 3, 2) AS m, replace(p, '.', '') AS b FROM pp)"""

_ENTRY = rf"""(regexp_matches(s, '^\[\d{{1,4}}\]\s+.+$') AND (regexp_matches(regexp_extract(s, '^\[\d{{1,4}}\]\s+(.+)$', 1), '(?i){o._VENUE}')
  OR (regexp_matches(regexp_extract(s, '^\[\d{{1,4}}\]\s+(.+)$', 1), '\b(19|20)\d\d\b') AND regexp_matches(substr(regexp_extract(s, '^\[\d{{1,4}}\]\s+(.+)$', 1), 1, 160), ',| and '))))"""
HTML_LINES = """
mh AS (SELECT doc_id, line_no, CASE WHEN line_no % 9 = 3 AND doc_id % 3 = 0 THEN '<TABLE class=''x''><tr>' WHEN line_no % 9 = 6 AND doc_id % 3 = 0 THEN '</tr></table>'
  WHEN line_no % 9 = 7 AND doc_id % 4 = 0 THEN '<table><tr><td>[3]</td></tr></table>' ELSE line END AS line FROM ml)"""
_HTML_STATE = rf"""
h0 AS (SELECT *, regexp_matches(s, '(?i)<table\b') AS opens, regexp_matches(s, '(?i)</table>') AS shuts, NOT fence AND fences % 2 = 0 AND NOT {_ENTRY} AS live FROM co),
h1 AS (SELECT *, CASE WHEN live AND opens THEN CASE WHEN NOT shuts THEN true END WHEN live AND shuts THEN false END AS turn FROM h0),
hi AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_html FROM h1),
ki AS ("""
HTML_SCAN = (
    SCAN.replace("FROM ml)", "FROM mh)").replace("\nki AS (", _HTML_STATE).replace("WHEN length(s) - length(replace(s, '|', '')) >= 2", "WHEN opens OR in_html THEN 'table_html'\n    WHEN length(s) - length(replace(s, '|', '')) >= 2")
    .replace("END AS k0 FROM co", "END AS k0 FROM hi").replace("SELECT doc_id, line_no, s, fences, section,", "SELECT doc_id, line_no, s, fences, section, opens,")
)


def _claims(largest: int = 15) -> str:
    """Citations that are in the reference map and have a card, grouped by clause, clauses of a
    sentence merged, repeats gone. cv: all groups; cc: the claims."""
    return rf"""
cr AS (SELECT doc_id, paragraph_id, section, sentence_no, no, scope, clause, unnest(indices) AS citation_index, unnest(range(len(indices))) AS ra FROM cl WHERE clause <> '' AND NOT starts_with(indices[1], 'source:')),
cj AS (SELECT cr.*, rm.paper_id FROM cr JOIN rm USING (doc_id, citation_index) JOIN ca USING (paper_id)),
g0 AS (SELECT doc_id, paragraph_id, section, sentence_no, no, scope, clause, list(struct_pack(i := citation_index, p := paper_id) ORDER BY ra) AS grp FROM cj GROUP BY ALL),
g1 AS (SELECT *, trim(regexp_replace(lower(clause), '[^a-z0-9]+', ' ', 'g')) AS key, row_number() OVER (PARTITION BY doc_id, paragraph_id, sentence_no ORDER BY no) AS k FROM g0),
gf AS (
  SELECT doc_id, paragraph_id, section, sentence_no, k, [struct_pack(clause := clause, scope := scope, key := key, grp := grp)] AS acc FROM g1 WHERE k = 1
  UNION ALL
  SELECT doc_id, paragraph_id, section, sentence_no, k, CASE WHEN hit > 0 THEN list_transform(acc, lambda x, j: CASE WHEN j = hit THEN struct_pack(clause := x.clause, scope := x.scope, key := x.key, grp := list_concat(x.grp, list_filter(grp, lambda y: NOT list_contains(x.grp, y)))) ELSE x END)
    ELSE list_append(acc, struct_pack(clause := clause, scope := scope, key := key, grp := grp)) END
  FROM (
    SELECT e.*, f.acc, coalesce(list_position(list_transform(f.acc, lambda x: x.scope = e.scope AND x.key <> '' AND e.key <> '' AND (x.key = e.key
      OR (length(x.key) <= length(e.key) AND length(x.key) >= 40 AND contains(e.key, x.key)) OR (length(e.key) < length(x.key) AND length(e.key) >= 40 AND contains(x.key, e.key)))), true), 0) AS hit
    FROM gf f JOIN g1 e ON e.doc_id = f.doc_id AND e.paragraph_id = f.paragraph_id AND e.sentence_no = f.sentence_no AND e.k = f.k + 1
  )
),
gx AS (SELECT doc_id, paragraph_id, section, sentence_no, unnest(acc) AS x, unnest(range(len(acc))) AS no FROM (SELECT *, max(k) OVER (PARTITION BY doc_id, paragraph_id, sentence_no) AS last FROM gf) WHERE k = last),
cv AS (SELECT doc_id, paragraph_id, section, sentence_no, no, x.clause AS clause, x.scope AS scope, x.key AS key, x.grp AS grp, len(x.grp) AS group_size FROM gx WHERE regexp_matches(x.clause, '\pL')),
ck AS (SELECT * FROM cv WHERE group_size <= {largest} QUALIFY row_number() OVER (PARTITION BY doc_id, section, key, grp ORDER BY paragraph_id, sentence_no, no) = 1),
ct AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_id, sentence_no, no) AS position, CASE WHEN group_size = 1 THEN 'single' ELSE 'group' END AS mode, lower(section || ' ' || clause) AS t FROM ck),
cc AS (SELECT *, doc_id || '-C' || lpad(CAST(position AS VARCHAR), CAST(greatest(4, length(CAST(position AS VARCHAR))) AS INT), '0') AS claim_id, {o._KIND} AS claim_type FROM ct)"""


_BASE = (LINES, SCAN, PARAGRAPHS, SENTENCES, MARKERS, CLAUSES, CARDS, REFS)
_BIN = "CASE WHEN group_size <= 4 THEN CAST(group_size AS VARCHAR) WHEN group_size <= 8 THEN '5-8' WHEN group_size <= 15 THEN '9-15' ELSE '16+' END"


def _on_claims(body: str, largest: int = 15) -> str:
    return _with(*_BASE, _claims(largest), recursive=True) + body


def _joined(body: str, largest: int = 15) -> str:
    """More common tables and the query after those of the claims."""
    return _with(*_BASE, _claims(largest), recursive=True).rstrip() + "," + body


_DIMENSIONS = " UNION ALL ".join(f"SELECT doc_id, side, '{n}' AS dimension, {v} AS value FROM si" for n, v in {"claim_scope": "scope", "claim_type": "claim_type", "citation_mode": "mode", "citation_group_size": _BIN, "section": "section"}.items())
_SIDES = "\nsi AS (SELECT *, 'all' AS side FROM cc UNION ALL SELECT *, 'selected' AS side FROM cc WHERE position % 3 = 1),\nhg AS (SELECT doc_id, side, dimension, value, count(*) AS claims FROM (" + _DIMENSIONS + ") GROUP BY ALL)"


def _map(name: str, where: str) -> str:
    return f"{name} AS (SELECT doc_id, string_agg(value || '=' || claims, ';' ORDER BY value) AS v FROM hg WHERE {where} GROUP BY ALL)"


_REUSE = """
pu AS (SELECT doc_id, paper_id, count(*) AS num_selected_claim_contexts, count(DISTINCT section) AS num_sections_used FROM (SELECT doc_id, section, unnest(list_transform(grp, lambda m: m.p)) AS paper_id FROM cc WHERE position % 3 = 1) GROUP BY ALL),
pk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY num_selected_claim_contexts DESC, paper_id) AS rank FROM pu)"""

_SUMMARY = (
    _SIDES + ",\n" + ",\n".join([
        _map("bm1", "side = 'all' AND dimension = 'claim_scope'"), _map("bm2", "side = 'selected' AND dimension = 'claim_scope'"), _map("bm3", "side = 'all' AND dimension = 'claim_type'"), _map("bm4", "side = 'selected' AND dimension = 'claim_type'"),
        _map("bm5", "side = 'selected' AND dimension = 'citation_group_size'"), _map("bm6", "side = 'selected' AND dimension = 'section'"),
    ]) + "," + _REUSE + f""",
bm7 AS (SELECT doc_id, string_agg(value || '=' || n, ';' ORDER BY value) AS v FROM (SELECT doc_id, {_BIN} AS value, count(*) AS n FROM cv GROUP BY ALL) GROUP BY ALL),
bm8 AS (SELECT doc_id, string_agg(value || '=' || n, ';' ORDER BY value) AS v, CAST(sum(n) AS BIGINT) AS papers FROM (SELECT doc_id, ['metadata_and_abstract', 'metadata_only', 'abstract_only', 'title_only'][tier_rank + 1] AS value, count(*) AS n FROM pu JOIN ca USING (paper_id) GROUP BY ALL) GROUP BY ALL),
bm9 AS (SELECT doc_id, string_agg(paper_id || ':' || num_selected_claim_contexts || ':' || num_sections_used, ';' ORDER BY rank) AS v FROM pk WHERE rank <= 3 GROUP BY ALL),
a1 AS (SELECT doc_id, count(*) AS n, count(*) FILTER (mode = 'single') AS s, count(*) FILTER (mode = 'group') AS g FROM cc GROUP BY ALL),
a2 AS (SELECT doc_id, count(*) AS n, count(*) FILTER (mode = 'single') AS s, count(*) FILTER (mode = 'group') AS g, count(*) FILTER (scope = 'clause') AS c, count(*) FILTER (scope = 'sentence_fallback') AS f, count(*) FILTER (claim_type = 'other') AS x FROM cc WHERE position % 3 = 1 GROUP BY ALL),
a3 AS (SELECT doc_id, round(avg(CAST(group_size >= 5 AS INT)), 4) AS l, round(avg(CAST(group_size > 15 AS INT)), 4) AS ov, round(avg(group_size), 4) AS me, max(group_size) AS mx, round(avg(CAST(group_size = 1 AS INT)), 4) AS si, count(*) FILTER (group_size > 15) AS sk FROM cv GROUP BY ALL)
SELECT a1.doc_id, a1.n AS total_cited_claim_candidates, a1.s AS total_single_citation_claims, a1.g AS total_multi_citation_claims, l AS large_citation_group_ratio_all, ov AS oversized_citation_group_ratio_all, me AS avg_citation_group_size_all, mx AS max_citation_group_size_observed,
  si AS single_citation_claim_ratio_all, sk AS oversized_citation_group_claims_skipped, a2.n AS selected_claims, a2.s AS selected_single_citation_claims, a2.g AS selected_multi_citation_claims, a2.c AS num_clause_scope_claims, a2.f AS num_sentence_fallback_claims, a2.x AS selected_other_claims,
  bm8.papers AS num_unique_selected_papers, round(a1.g / a1.n, 4) AS multi_citation_claim_ratio_all, round(a2.g / a2.n, 4) AS multi_citation_claim_ratio_selected, round(a2.x / a2.n, 4) AS selected_other_claim_ratio, bm1.v AS claim_scope_distribution_all, bm2.v AS claim_scope_distribution_selected,
  bm3.v AS claim_type_distribution_all, bm4.v AS claim_type_distribution_selected, bm5.v AS citation_group_size_distribution_selected, bm6.v AS contexts_per_section_selected, bm7.v AS citation_group_size_distribution_all, bm8.v AS evidence_tier_counts_selected_papers, bm9.v AS top_reused
FROM a1 JOIN a2 USING (doc_id) JOIN a3 USING (doc_id) """ + " ".join(f"JOIN bm{i} USING (doc_id)" for i in range(1, 10))
)

_SPLIT = r"\[\s*\d+\s*\]\s*(?:-{1,2}|[–—])\s*\[\s*\d+\s*\]"
_SYNTAX = rf"""
y1 AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(sentence, '{_SPLIT}'))) AS BIGINT) AS sp FROM sn GROUP BY ALL),
y2 AS (SELECT doc_id, count(*) FILTER (starts_with(marker, '[')) AS nb, count(*) FILTER (starts_with(marker, '[') AND contains(marker, ';')) AS se, count(*) FILTER (NOT starts_with(marker, '[')) AS un FROM mk GROUP BY ALL),
sy AS (SELECT doc_id, sp, coalesce(nb, 0) AS nb, coalesce(se, 0) AS se, coalesce(un, 0) AS un FROM y1 LEFT JOIN y2 USING (doc_id))"""

_REPORT = rf"""{_SYNTAX},
sk AS (SELECT doc_id, count(*) FILTER (kind = 'table' AND hit) || ',' || count(*) FILTER ((kind = 'code' OR (kind = 'fence' AND fences % 2 = 0)) AND hit) || ',' || count(*) FILTER (kind = 'caption' AND hit) || ',' || count(*) FILTER (kind = 'reference_entry') AS v
  FROM (SELECT *, regexp_matches({o._join_ranges("s")}, '{o._MARK}') AS hit FROM sc) GROUP BY ALL),
xs AS (SELECT doc_id, section, unnest(indices) AS i FROM ev),
b1 AS (SELECT doc_id, count(DISTINCT section) AS n FROM pa GROUP BY ALL),
b2 AS (SELECT doc_id, count(*) AS n, count(DISTINCT section) AS c FROM ev GROUP BY ALL),
r1 AS (SELECT doc_id, string_agg(b || '=' || n, ';' ORDER BY b) AS v FROM (SELECT doc_id, {_BIN} AS b, count(*) AS n FROM ev GROUP BY ALL) GROUP BY ALL),
r2 AS (SELECT doc_id, string_agg(section || '=' || n, ';' ORDER BY section) AS v, string_agg(section || '=' || m, ';' ORDER BY section) AS w FROM (SELECT doc_id, section, count(*) AS n, CAST(sum(group_size) AS BIGINT) AS m FROM ev GROUP BY ALL) GROUP BY ALL),
r3 AS (SELECT doc_id, string_agg(section || '=' || n, ';' ORDER BY section) AS v FROM (SELECT doc_id, section, count(DISTINCT i) AS n FROM xs GROUP BY ALL) GROUP BY ALL),
r4 AS (SELECT doc_id, string_agg(i || ':' || n || ':' || s, ';' ORDER BY k) AS v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, starts_with(i, 'source:'), TRY_CAST(i AS BIGINT), i) AS k FROM (SELECT doc_id, i, count(*) AS n, count(DISTINCT section) AS s FROM xs GROUP BY ALL)) WHERE k <= 20 GROUP BY ALL),
r5 AS (SELECT doc_id, string_agg(array_to_string(indices, ',') || ':' || n || ':' || s, ';' ORDER BY k) AS v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, len(indices) DESC, indices) AS k FROM (SELECT doc_id, indices, count(*) AS n, count(DISTINCT section) AS s FROM ev GROUP BY ALL HAVING count(*) > 1)) WHERE k <= 10 GROUP BY ALL),
r6 AS (SELECT doc_id, string_agg(section || ':' || array_to_string(indices, ',') || ':' || group_size, ';' ORDER BY k) AS v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY group_size DESC, section, indices) AS k FROM ev) WHERE k <= 10 GROUP BY ALL)
SELECT b1.doc_id, coalesce(b2.n, 0) AS total_cited_claims, round(coalesce(b2.c, 0) / b1.n, 4) AS section_citation_coverage_ratio, coalesce(r1.v, '') AS sizes, coalesce(r2.v, '') AS claims_per_section, coalesce(r2.w, '') AS mentions_per_section, coalesce(r3.v, '') AS unique_per_section,
  coalesce(r4.v, '') AS reused, coalesce(r5.v, '') AS repeated, coalesce(r6.v, '') AS largest, coalesce(sk.v, '') AS skipped, coalesce(sp || ',' || nb || ',' || se || ',' || un, '') AS syntax
FROM b1 LEFT JOIN b2 USING (doc_id) LEFT JOIN r1 USING (doc_id) LEFT JOIN r2 USING (doc_id) LEFT JOIN r3 USING (doc_id) LEFT JOIN r4 USING (doc_id) LEFT JOIN r5 USING (doc_id) LEFT JOIN r6 USING (doc_id) LEFT JOIN sk USING (doc_id) LEFT JOIN sy USING (doc_id)"""

_VIOLATIONS = """
WITH l AS (SELECT l_orderkey AS doc_id, l_orderkey * 7 + l_linenumber AS k, l_partkey FROM lineitem),
c AS (SELECT *, k % 4 AS size, CASE WHEN k % 13 = 0 THEN 'many' WHEN k % 4 = 1 THEN 'single' ELSE 'group' END AS mode FROM l),
own AS (SELECT doc_id, CAST(k AS VARCHAR) AS claim_id, unnest(list_filter([CASE WHEN k % 11 = 0 THEN 'scope' END, CASE WHEN k % 13 = 0 THEN 'mode' END, CASE WHEN k % 17 = 0 THEN 'marker' END, CASE WHEN k % 19 = 0 AND k % 17 <> 0 THEN 'evaluable' END, CASE WHEN k % 23 = 0 THEN 'original' END,
  CASE WHEN size = 0 THEN 'empty_group' END, CASE WHEN k % 31 = 0 THEN 'size' END, CASE WHEN size > 2 THEN 'oversized' END, CASE WHEN k % 29 = 0 AND size > 0 THEN 'evidence_id' END, CASE WHEN k % 5 = 4 THEN 'insufficient' END], lambda x: x IS NOT NULL)) AS rule FROM c),
used AS (SELECT DISTINCT doc_id, (l_partkey + i * 5) % 50 AS p FROM c, range(0, 3) t(i) WHERE i < size),
bank AS (SELECT doc_id, CAST(p AS VARCHAR) AS p FROM used WHERE p % 10 <> 3 UNION ALL SELECT DISTINCT doc_id, 'unused' FROM l WHERE doc_id % 6 = 0)
SELECT doc_id, rule, claim_id FROM own
UNION ALL SELECT doc_id, 'records', '-' FROM c GROUP BY doc_id HAVING count(*) > 4
UNION ALL SELECT doc_id, 'multi_quota', '-' FROM c GROUP BY doc_id HAVING count(*) FILTER (mode = 'group') > 2
UNION ALL SELECT doc_id, 'not_in_bank', CAST(p AS VARCHAR) FROM used WHERE p % 10 = 3
UNION ALL SELECT doc_id, 'unused_paper', 'unused' FROM bank WHERE p = 'unused'
UNION ALL SELECT doc_id, 'paper_budget', '-' FROM bank GROUP BY doc_id HAVING count(*) > 5"""

_JUDGED = """
WITH names(family, f, i, criterion) AS (VALUES """ + ", ".join(f"('{f}', {n}, {i}, '{c}')" for n, (f, cs) in enumerate({
    "BSC": ["Claim-Level Citation Support", "Reference Faithfulness and Attribution Accuracy", "Multi-Reference Synthesis Coverage and Quality", "Citation Distribution Balance and Non-Redundancy"],
    "MAR": ["Citation and Reference Presentation Integrity", "Figure/Table Quality and Textual Integration", "Layout and Formatting Professionalism", "Manuscript Component Completeness"],
    "TSQ": o._TSQ, "HDQ": o._HDQ,
}.items()) for i, c in enumerate(cs)) + """),
r AS (SELECT o_orderkey, o_custkey % 10 AS way, family, f <= 1 AS strict, criterion, (o_orderkey // 4 + 5 * i) % 10 AS v, (o_orderkey // 4) % 10 AS v0 FROM orders JOIN names ON f = o_orderkey % 4),
s AS (SELECT *, CASE WHEN way >= 8 THEN 'no_response' WHEN way IN (6, 7) AND strict THEN 'unparsed' WHEN way = 4 AND family = 'MAR' THEN 'missing_group' WHEN way = 3 AND family = 'BSC' THEN 'unparsed'
    WHEN way = 3 AND v0 NOT IN (0, 1, 5, 6) THEN CASE WHEN strict THEN 'unparsed' ELSE 'nothing' END WHEN way IN (6, 7) THEN 'nothing' ELSE 'read' END AS st FROM r),
t AS (SELECT *, CASE WHEN st = 'read' THEN CASE WHEN strict THEN [1, 1, 2, 3, 3, 5, 5, 4, 1, 1] ELSE [1, 1, 2, 3, 4, 5, 5, 4, 3, 3] END[v + 1] WHEN st = 'nothing' THEN 3 ELSE -1 END AS score,
  CASE WHEN st = 'read' THEN ['out_of_range', '', 'rounded', '', 'rounded', '', 'out_of_range', '', 'invalid', 'missing'][v + 1] WHEN st = 'nothing' THEN 'missing' ELSE st END AS warning FROM s)
SELECT family, criterion, CASE WHEN st IN ('read', 'nothing') THEN CASE WHEN warning IN ('invalid', 'missing') THEN 'defaulted' ELSE 'ok' END ELSE st END AS status, score, warning, CASE WHEN st = 'read' THEN 'a {b} "c"' ELSE '' END AS rationale, count(*) AS n FROM t GROUP BY ALL"""

_PAPER_HEADS = rf"""
WITH d AS (SELECT doc_id, doc_id % 4 AS h, (doc_id // 4) % 3 AS t, regexp_replace(coalesce(text, ''), '[#\n\r]', ' ', 'g') AS body FROM documents),
x AS (SELECT doc_id, t, CASE WHEN t = 1 THEN '### Third <b>one</b>' || CASE h WHEN 0 THEN '' WHEN 1 THEN chr(10) || '**Abstract**: ' || body WHEN 2 THEN chr(10) || 'A B S T R A C T' || chr(10) || '| a | b |' || chr(10) || '![f](x.png)' || chr(10) || body ELSE chr(10) || 'No marker here.' || chr(10) || body END
  WHEN h = 0 THEN body WHEN h = 2 THEN '| a | b |' || chr(10) || '![f](x.png)' || chr(10) || body ELSE '' END AS raw FROM d),
y AS (SELECT doc_id, t, regexp_replace(regexp_replace(raw, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '<[^>]+>', ' ', 'g') AS c FROM x),
z AS (SELECT doc_id, t, array_to_string(list_filter(list_transform(string_split(c, chr(10)), lambda l: {_strip("l")}), lambda l: length(l) - length(replace(l, '|', '')) < 2), chr(10)) AS c FROM y),
w AS (SELECT doc_id, t, {_strip("substr(" + _collapse(r"regexp_replace(regexp_replace(c, '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '[`*_{}]', '', 'g')") + ", 1, 200)")} AS a FROM z)
SELECT doc_id, CASE t WHEN 0 THEN 'A *study* of things' WHEN 1 THEN 'Third one' ELSE '1 Introduction' END AS title, CASE WHEN length(a) >= 30 THEN a ELSE '' END AS abstract FROM w"""

_EVIDENCE = rf"""
ev0 AS (SELECT d.doc_id AS k, k.doc_id IS NOT NULL AS known, k.doc_id IS NOT NULL AND d.doc_id % 10 <> 9 AS meta, substr(text, 1, 300) AS first, lang FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) k ON k.doc_id = d.doc_id),
ev1 AS (SELECT *, CASE WHEN meta AND k % 3 <> 0 THEN 'Title ' || k WHEN k % 6 = 0 THEN 'Parsed ' || k END AS title, CASE WHEN k % 6 = 0 THEN 'An abstract of ' || k WHEN meta AND k % 4 = 0 THEN nullif({_clean("first", 900)}, '') END AS a0 FROM ev0),
ev2 AS (SELECT *, CASE WHEN meta AND a0 IS NOT NULL THEN 0 WHEN meta THEN 1 WHEN a0 IS NOT NULL THEN 2 WHEN title IS NOT NULL THEN 3 ELSE 4 END AS tier_rank FROM ev1)"""

ALL: dict[str, str] = {
    "ref_map_scan": f"SELECT o_orderkey, i AS citation_index, {_paper('o_orderkey')} AS paper_id FROM orders, (VALUES ('1'), ('2'), ('x')) u(i) WHERE o_orderkey % 5 <> 0",
    "metadata_lookup": _with(PAPERS) + """SELECT paper_id, path FROM (SELECT p AS paper_id, CASE WHEN k % 7 = 0 THEN p || '.json' WHEN k % 5 = 0 THEN p || '_processed.json' WHEN k % 4 = 0 THEN 'a_' || p || '.json' WHEN k % 3 = 0 THEN 'sub/c_' || p || '.json'
  WHEN k % 2 = 0 THEN m || '/d_' || p || '_processed.json' WHEN k % 11 <> 0 THEN m || '/e_' || b || '_processed.json' END AS path FROM pm) WHERE path IS NOT NULL""",
    "parsed_lookup": _with(PAPERS) + """SELECT paper_id, path FROM (SELECT p AS paper_id, CASE WHEN k % 9 = 0 THEN '/home/' || p || '.md' WHEN k % 8 = 0 THEN '/dirs/' || p || '/b.md' WHEN k % 7 = 0 THEN m || '/s_' || p || '/auto/s_' || p || '.md' WHEN k % 5 = 0 THEN m || '/' || p || '/' || p || '/auto/' || p || '.md'
  WHEN k % 4 = 0 THEN m || '/v' || p || 'b/v' || p || 'b/auto/v' || p || 'b.md' WHEN k % 3 = 0 THEN m || '/w' || p || '/other/auto/x.md' WHEN k % 2 = 0 THEN m || '/x' || p || '/auto/y.md' END AS path FROM pm) WHERE path IS NOT NULL""",
    "page_order": r"""
WITH n AS (SELECT DISTINCT l_orderkey, ['p' || l_partkey || '.png', l_suppkey || '_x.png', 'cover.png'][l_linenumber % 3 + 1] AS name FROM lineitem)
SELECT l_orderkey, name, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(TRY_CAST(regexp_extract(name, '(\d+)', 1) AS BIGINT), 1000000000), name) AS natural_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY name) AS plain_no FROM n""",
    "sample_pairs": _with(SCORES) + "SELECT DISTINCT method, topic_id FROM so WHERE method IN ('AF', 'NO', 'ZZ') AND topic_id IN (SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') FROM nation)",
    "topic_discovery": "SELECT DISTINCT 'm' || (c_custkey % 6) AS method, lpad(CAST(c_custkey % 40 AS VARCHAR), 3, '0') AS topic_id FROM customer WHERE c_custkey % 5 = 0 UNION SELECT NULL, NULL WHERE false",
    "published_means": _with(SCORES) + "SELECT 'General' AS Category, method AS \"Method\", " + ", ".join(f"round(avg(m) FILTER (family = '{f}'), 6) AS {f}_Avg" for f in ("BSC", "TSQ", "HDQ", "MAR")) + ", round(avg(m), 6) AS Total_Avg FROM (SELECT method, family, criterion, round(avg(score), 2) AS m FROM so GROUP BY ALL) GROUP BY ALL",
    "json_sink": "SELECT CASE WHEN c_nationkey = 3 THEN -c_custkey ELSE c_custkey END AS c_custkey, 'm' AS method, CAST(c_nationkey AS VARCHAR) AS topic_id FROM customer",
    "jsonl_sink": "SELECT lpad(CAST(s_suppkey % 10 AS VARCHAR), 3, '0') AS topic_id, v AS value, count(*) AS n FROM (SELECT s_suppkey, unnest(['{\"k\":' || s_suppkey || '}', '{\"é\":1}']) AS v FROM supplier) GROUP BY ALL",
    "csv_upsert": "SELECT lpad(CAST(s_suppkey % 7 AS VARCHAR), 3, '0') AS topic_id, CAST(s_suppkey % 3 AS VARCHAR) AS method, 'off' AS api_mode, coalesce(max(s_suppkey) FILTER (s_suppkey % 4 = 0), max(s_suppkey)) AS score FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY ALL",
    "run_log": "SELECT n_name AS step, n_nationkey % 2 = 0 AS ok, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM nation",
    "html_tables": _with(LINES, HTML_LINES, HTML_SCAN) + "SELECT doc_id, kind, count(*) AS n, CAST(sum(line_no) AS BIGINT) AS at, CAST(max(b) AS BIGINT) AS breaks FROM (SELECT *, sum(CASE WHEN kind IN ('fence', 'reference_entry', 'table', 'heading', 'references', 'blank') OR (kind = 'table_html' AND opens) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM sc) GROUP BY ALL",
    "section_frames": r"SELECT p_partkey, regexp_matches(lower(['1 Introduction to ' || p_name, 'CONCLUSION', 'Conclusions on ' || p_name, p_name, 'Reintroduction'][p_partkey % 5 + 1]), '\b(introduction|conclusion)\b') AS frame FROM part",
    "abstract_lines": "SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 3 THEN trim(p_name) END AS said, p_partkey % 11 IN (4, 5, 6, 7) AS stops FROM part",
    "paper_heads": _PAPER_HEADS,
    "shortened_items": f"""
WITH i AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:3]) AS x, unnest(range(3)) AS n FROM documents), c AS (SELECT doc_id, n, {_clean("x", 60)} AS y FROM i WHERE x IS NOT NULL),
j AS (SELECT doc_id, count(*) AS n, string_agg(y, '|' ORDER BY n) AS items FROM c WHERE y <> '' GROUP BY ALL)
SELECT doc_id, coalesce(n, 0) AS n, coalesce(items, '') AS items FROM documents LEFT JOIN j USING (doc_id)""",
    "bare_citations": "SELECT k AS o_orderkey, number FROM (SELECT o_orderkey AS k, CASE o_orderkey % 11 WHEN 0 THEN CAST(o_orderkey % 90 + 1 AS VARCHAR) WHEN 6 THEN '7' WHEN 10 THEN '8' END AS number FROM orders WHERE (o_orderkey // 11) % 3 < 2) WHERE number IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)",
    "marked_targets": """
WITH r AS (SELECT DISTINCT (l_orderkey * 7 + l_linenumber) % 9 + 1 AS n, l_partkey % 8 + 1 AS t FROM lineitem)
SELECT n, CAST(t AS VARCHAR) AS target, 'One ' || CASE WHEN t = 2 THEN '[CITE_THIS]' ELSE '[CITE_OTHER]' END || ' and two ' || CASE WHEN t = 3 AND n = 3 THEN '[CITE_THIS]' WHEN t = 3 OR t = n THEN '[CITE_THIS, CITE_OTHER]' ELSE '[CITE_OTHER]' END
  || ' and more ' || CASE WHEN t BETWEEN 4 AND 6 THEN '[CITE_THIS, CITE_OTHER]' ELSE '[CITE_OTHER]' END || ' end.' AS marked, 'One and two and more end.  [CITE_THIS].' AS clause FROM r""",
    "evidence_cards": _with(_EVIDENCE) + f"""SELECT CAST(k AS VARCHAR) AS paper_id, title, nullif({_clean("a0", 900)}, '') AS abstract, CASE WHEN meta THEN 'Tasks' END AS task_category, CASE WHEN meta THEN 'M' || k END AS method_name, CASE WHEN meta THEN lang END AS limitations,
  CASE WHEN meta THEN concat_ws(',', nullif({_clean("first", 180)}, ''), 'second') END AS innovations, CASE WHEN meta THEN 'one dataset' END AS datasets, CASE WHEN meta THEN 'dataset=D; metric=F1; value=' || (k % 7) END AS main_results,
  ['metadata_and_abstract', 'metadata_only', 'abstract_only', 'title_only', 'insufficient'][tier_rank + 1] AS evidence_tier, tier_rank FROM ev2""",
    "evidence_misses": _with(_EVIDENCE) + "SELECT count(*) AS papers, count(*) FILTER (NOT known) AS without_metadata, count(*) FILTER (known AND NOT meta) AS unreadable_metadata, count(*) FILTER (a0 IS NULL) AS without_abstract, count(*) FILTER (title IS NULL) AS without_title, count(*) FILTER (tier_rank = 4) AS without_evidence FROM ev2",
    "usable_citations": _with(CARDS, REFS) + "SELECT doc_id, count(*) AS n, min(paper_id) AS least FROM rm JOIN ca USING (paper_id) WHERE tier_rank <= 1 GROUP BY ALL",
    "claim_contexts": _on_claims("SELECT doc_id, claim_id, mode AS citation_mode, section AS section_title, scope AS citation_scope, claim_type, group_size AS citation_group_size, paragraph_id, sentence_no, position, array_to_string(list_transform(grp, lambda m: m.i || ':' || m.p), ',') AS members FROM cc"),
    "type_scope_hist": _on_claims("SELECT claim_type, scope AS citation_scope, mode AS citation_mode, count(*) AS claims, CAST(sum(group_size) AS BIGINT) AS members FROM cc GROUP BY ALL"),
    "small_claim_groups": _on_claims("SELECT v.group_size AS citation_group_size, seen, coalesce(kept, 0) AS kept FROM (SELECT group_size, count(*) AS seen FROM cv GROUP BY ALL) v LEFT JOIN (SELECT group_size, count(*) AS kept FROM cc GROUP BY ALL) c USING (group_size)", 2),
    "evidence_bank_ids": _joined("""
us AS (SELECT DISTINCT doc_id, unnest(list_transform(grp, lambda m: m.p)) AS paper_id FROM cc),
ii AS (SELECT doc_id, paper_id, string_agg(citation_index, ',' ORDER BY CAST(citation_index AS INT)) AS citation_indices FROM rm GROUP BY ALL)
SELECT doc_id, paper_id, 'E' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY paper_id) AS VARCHAR), 3, '0') AS evidence_ref_id, citation_indices FROM us JOIN ii USING (doc_id, paper_id)"""),
    "claim_records": _joined("""
so AS (SELECT * FROM cc WHERE position <= 4),
us AS (SELECT DISTINCT doc_id, unnest(list_transform(grp, lambda m: m.p)) AS paper_id FROM so),
nu AS (SELECT doc_id, paper_id, 'E' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY paper_id) AS VARCHAR), 3, '0') AS e FROM us),
me AS (SELECT doc_id, claim_id, unnest(list_transform(grp, lambda m: m.p)) AS paper_id, unnest(range(len(grp))) AS n FROM so)
SELECT doc_id, claim_id, string_agg(e, ',' ORDER BY n) AS evidence_ref_ids, 'citation_group,citation_group_size,citation_mode,citation_scope,claim_id,claim_type,doc_id,marked_sentence,original_sentence_with_citations,paragraph_id,position,section_title,sentence_no' AS fields FROM me JOIN nu USING (doc_id, paper_id) GROUP BY ALL"""),
    "balance_histograms": _joined(_SIDES + "\nSELECT * FROM hg"),
    "selected_reuse": _joined(_REUSE + "\nSELECT * FROM pk WHERE rank <= 5"),
    "balance_summary": _joined(_SUMMARY),
    "syntax_counts": _with(LINES, SCAN, PARAGRAPHS, SENTENCES, MARKERS).rstrip() + "," + _SYNTAX + "\nSELECT doc_id, sp AS separated_range_events, nb AS numeric_bracket_events, se AS semicolon_group_events, un AS unicode_source_citation_events FROM sy",
    "distribution_report": _with(LINES, SCAN, PARAGRAPHS, SENTENCES, MARKERS, CLAUSES, o.EVENTS, recursive=True).rstrip() + "," + _REPORT,
    "violations": _VIOLATIONS,
    "json_objects": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '{"a": ' || o_orderkey || '}' WHEN 1 THEN '{"a": {"b": "}{"}, "c": "\\"}", "d": ' || o_orderkey || '}' WHEN 4 THEN '{}' END AS found, CAST(o_orderkey AS VARCHAR) AS inside FROM orders""",
    "response_shapes": "SELECT o_orderkey, ['a' || o_orderkey, 'b' || o_orderkey, 'c' || o_orderkey || chr(10) || 'd', 'e' || o_orderkey || chr(10) || 'f', 'plain ' || o_orderkey][o_orderkey % 5 + 1] AS said FROM orders",
    "data_urls": "SELECT page_id, 'data:image/' || ['png', 'jpeg', 'webp'][page_id % 3 + 1] || ';base64,' || base64(encode(coalesce(html, ''))) AS url FROM pages",
    "judge_prompts": "SELECT n_nationkey, n_nationkey % 2 = 0 AS has_rubric, CASE WHEN n_nationkey % 3 <> 0 THEN n_name ELSE '' END AS topic, 4 AS criteria FROM nation",
    "judged_scores": _JUDGED,
    "audit_counts": _with(LINES).rstrip() + "," + rf"""
hd AS (SELECT *, regexp_extract(line, '^\s*#{{1,6}}\s+(.+?)\s*$', 1) AS head, regexp_matches(line, '^\s*#{{1,6}}\s+.+?\s*$') AS is_head FROM ml),
cu AS (SELECT *, min(CASE WHEN is_head AND regexp_matches(head, '(?i)^(\d+(\.\d+)*\s+)?(references|bibliography)\b') THEN line_no END) OVER (PARTITION BY doc_id) AS cut FROM hd),
bd AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (cut IS NULL OR line_no < cut), '') AS body, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no >= cut), '') AS refs,
  count(*) FILTER ((cut IS NULL OR line_no < cut) AND is_head AND NOT regexp_matches(head, '(?i)^(abstract|keywords?|references|bibliography)\b')) AS substantive_headings,
  count(*) FILTER ((cut IS NULL OR line_no < cut) AND regexp_matches(line, '^\s*\|?\s*:?-{{3,}}:?\s*(\|\s*:?-{{3,}}:?\s*)+\|?\s*$')) AS table_rules FROM cu GROUP BY doc_id),
cn AS (SELECT *, lower(body) AS low, len(regexp_extract_all(body, '(?i)\btable\s+(\d+|[ivxlcdm]+)\b')) AS table_mentions, len(regexp_extract_all(body, '(?i)\bfig(ure)?\.?\s*(\d+|[ivxlcdm]+)\b')) AS figure_mentions FROM bd)
SELECT doc_id, length(body) AS body_chars, length(refs) AS reference_chars, substantive_headings, table_rules, table_mentions, figure_mentions, table_rules + table_mentions + figure_mentions AS aids,
  len(regexp_extract_all(low, '\bbuilding upon\b')) + len(regexp_extract_all(low, '\bpreceding section\b')) + len(regexp_extract_all(low, '\bsets? the stage\b')) + len(regexp_extract_all(low, '\bmoving forward\b')) AS transitions,
  """ + " + ".join(f"CAST(regexp_matches(low, '{p}') AS INT)" for p in (
        r"\b(scopus|web of science|semantic scholar|google scholar|ieee xplore|acm digital library|pubmed)\b", r"\b(search quer(y|ies)|search string|search terms?|retrieval keywords?)\b", r"\b(prisma|screening flow|records? screened|papers? screened|after deduplication|duplicates? removed)\b",
        r"\b(inclusion criteria|exclusion criteria|eligibility criteria|inclusion and exclusion)\b", r"\b(search cutoff|retrieval cutoff|cutoff date|search conducted|last searched)\b",
    )) + " AS methodology,\n  CASE WHEN length(body) > 0 THEN round(length(refs) / length(body), 4) END AS reference_ratio FROM cn",
}
