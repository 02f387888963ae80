"""The queries in DuckDB's SQL, written against the same tables and not derived from the
Spark plans. Common tables are put together from named parts."""

from __future__ import annotations

_MARK = r"\[(?:\s*\d+\s*(?:[-–—]\s*\d+)?\s*)(?:[,;]\s*\d+\s*(?:[-–—]\s*\d+)?\s*)*\]|【\s*\d+\s*†[^】]*】"
_BRACKET = r"\[(?:\s*\d+\s*(?:[-–—]\s*\d+)?\s*)(?:[,;]\s*\d+\s*(?:[-–—]\s*\d+)?\s*)*\]"
_SOURCE = r"【\s*\d+\s*†[^】]*】"
_VENUE = r"\b(arXiv|Proceedings|Conference|Journal|Transactions|Findings|Workshop|URL|doi|preprint|ICLR|NeurIPS|ACL|EMNLP|AAAI|CVPR|ICML|SIGDIAL|UAI)\b"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _join_ranges(x: str) -> str:
    return rf"regexp_replace({x}, '\[\s*(\d+)\s*\]\s*(?:-{{1,2}}|[–—])\s*\[\s*(\d+)\s*\]', '[\1-\2]', 'g')"


def _unmark(x: str) -> str:
    return f"regexp_replace(regexp_replace({_join_ranges(x)}, '{_BRACKET}', ' ', 'g'), '{_SOURCE}', ' ', 'g')"


def _clean(x: str, n: int) -> str:
    c = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
    return rf"(SELECT CASE WHEN length(zz) <= {n} THEN zz ELSE regexp_replace(substr(zz, 1, {n - 3}), '\s+$', '') || '...' END FROM (SELECT {c} AS zz))"


def _expand(x: str) -> str:
    """The ordered distinct numbers of the inside of a bracket, as a list of texts."""
    part = "trim(p)"
    low, high = rf"CAST(regexp_extract({part}, '^(\d+)', 1) AS BIGINT)", rf"CAST(regexp_extract({part}, '(\d+)$', 1) AS BIGINT)"
    each = rf"CASE WHEN regexp_matches({part}, '^\d+$') THEN [CAST(CAST({part} AS BIGINT) AS VARCHAR)] WHEN regexp_matches({part}, '^\d+\s*[-–—]\s*\d+$') AND {low} <= {high} AND {high} - {low} <= 500 THEN list_transform(range({low}, {high} + 1), lambda v: CAST(v AS VARCHAR)) ELSE [] END"
    flat = f"flatten(list_transform(string_split_regex({x}, '[,;]'), lambda p: {each}))"
    return f"(SELECT list_filter(l, lambda y, i: list_position(l, y) = i) FROM (SELECT {flat} AS l))"


LINES = """
raw AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
ml AS (
  SELECT doc_id, line_no, CASE
    WHEN line_no = 60 THEN 'References' WHEN line_no > 60 THEN '[' || (line_no - 60) || '] Doe, J. and Roe, A., Journal of Tests, 2021.'
    WHEN line_no % 11 = 0 THEN '# Section ' || (line_no // 11) WHEN line_no % 11 = 4 THEN ''
    WHEN line_no % 11 = 6 AND doc_id % 5 = 0 THEN 'Table ' || line_no || ': ' || line
    WHEN line_no % 11 = 8 AND doc_id % 7 = 0 THEN '| a | [' || (line_no % 40 + 1) || '] |'
    WHEN line_no % 11 = 9 AND doc_id % 13 = 0 THEN '```'
    WHEN (doc_id * 31 + line_no * 7) % 6 = 0 THEN line || ' [' || ((doc_id + line_no * 3) % 40 + 1) || '].'
    WHEN (doc_id * 31 + line_no * 7) % 6 = 1 THEN line || ' [' || ((doc_id + line_no * 3) % 40 + 1) || ', ' || ((doc_id * 7 + line_no) % 40 + 1) || '-' || ((doc_id * 7 + line_no) % 40 + 3) || '].'
    WHEN (doc_id * 31 + line_no * 7) % 6 = 2 THEN line || ' [' || ((doc_id + line_no * 3) % 40 + 1) || ']-[' || ((doc_id + line_no * 3) % 40 + 4) || '].'
    WHEN (doc_id * 31 + line_no * 7) % 6 = 3 THEN line || ' 【' || ((doc_id + line_no * 3) % 40 + 1) || '†src】.'
    ELSE line END AS line FROM raw
)"""

# the derived manuscripts hold no HTML tables; their state is covered by fixtures
SCAN = rf"""
st AS (SELECT doc_id, line_no, {_strip("line")} AS s FROM ml),
fe AS (SELECT *, starts_with(s, '```') OR starts_with(s, '~~~') AS fence FROM st),
co AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM fe),
ki AS (
  SELECT *, CASE WHEN fence THEN 'fence' WHEN fences % 2 = 1 THEN 'code'
    WHEN regexp_matches(s, '^\[\d{{1,4}}\]\s+.+$') AND (regexp_matches(regexp_extract(s, '^\[\d{{1,4}}\]\s+(.+)$', 1), '(?i){_VENUE}')
      OR (regexp_matches(regexp_extract(s, '^\[\d{{1,4}}\]\s+(.+)$', 1), '\b(19|20)\d\d\b') AND regexp_matches(substr(regexp_extract(s, '^\[\d{{1,4}}\]\s+(.+)$', 1), 1, 160), ',| and '))) THEN 'reference_entry'
    WHEN length(s) - length(replace(s, '|', '')) >= 2 OR regexp_matches(s, '^\|?\s*:?-{{3,}}:?\s*(\|\s*:?-{{3,}}:?\s*)+\|?$') THEN 'table'
    WHEN regexp_matches(s, '(?i)^(figure|fig\.|table)\s+\d+\b') THEN 'caption'
    WHEN regexp_matches(s, '^#{{1,6}}\s+.+?\s*#*\s*$') THEN 'heading'
    WHEN regexp_matches(s, '(?i)^(references|bibliography)$') THEN 'references' END AS k0 FROM co
),
na AS (SELECT *, CASE WHEN k0 = 'references' THEN 'References' WHEN k0 = 'heading' THEN {_clean(r"regexp_extract(s, '^#{1,6}\s+(.+?)\s*#*\s*$', 1)", 180)} END AS title FROM ki),
se AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(title, '(?i)^(references|bibliography)$') THEN 'References' ELSE nullif(title, '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'Untitled') AS section FROM na),
sc AS (SELECT doc_id, line_no, s, fences, section, coalesce(k0, CASE WHEN section = 'References' THEN 'closed' WHEN s = '' THEN 'blank' ELSE 'text' END) AS kind FROM se)"""

PARAGRAPHS = """
br AS (SELECT *, sum(CASE WHEN kind IN ('fence', 'reference_entry', 'table', 'heading', 'references', 'blank') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM sc),
pg AS (SELECT doc_id, b, string_agg(s, ' ' ORDER BY line_no) AS paragraph, arg_min(section, line_no) AS section FROM br WHERE kind = 'text' GROUP BY doc_id, b),
pa AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS paragraph_id, section, paragraph FROM pg)"""


def _sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({_collapse(x)}, '([.!?。！？])\s+([A-Z0-9\[【])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '')"


SENTENCES = rf"""
s0 AS (SELECT doc_id, paragraph_id, section, unnest(l) AS s, unnest(range(len(l))) AS n FROM (SELECT *, {_sentences("paragraph")} AS l FROM pa)),
s1 AS (SELECT *, regexp_replace(regexp_replace({_unmark("s")}, '\b\d{{1,3}}\b', ' ', 'g'), '[\s.,;:!?()\[\]{{}}\-–—]+', '', 'g') = '' AS lone FROM s0),
s2 AS (SELECT *, sum(CASE WHEN lone THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, paragraph_id ORDER BY n) AS g FROM s1),
sn AS (SELECT doc_id, paragraph_id, section, g - 1 AS sentence_no, string_agg(s, ' ' ORDER BY n) AS sentence FROM s2 WHERE g > 0 GROUP BY ALL)"""

MARKERS = rf"""
m0 AS (SELECT *, {_join_ranges("sentence")} AS whole FROM sn),
m1 AS (SELECT *, regexp_extract_all(whole, '{_MARK}') AS found, string_split_regex(whole, '{_MARK}') AS pieces FROM m0),
m2 AS (SELECT *, unnest(range(len(found))) AS no FROM m1),
m3 AS (SELECT doc_id, paragraph_id, section, sentence_no, no, whole, found[no + 1] AS marker,
  list_sum(list_transform(pieces[1:no + 1], lambda v: length(v))) + coalesce(list_sum(list_transform(found[1:no], lambda v: length(v))), 0) AS begins FROM m2),
m4 AS (SELECT *, CASE WHEN starts_with(marker, '【') THEN ['source:' || CAST(regexp_extract(marker, '(\d+)', 1) AS BIGINT)] ELSE {_expand("substr(marker, 2, length(marker) - 2)")} END AS indices,
  substr(whole, 1, CAST(begins AS BIGINT)) AS before, substr(whole, CAST(begins AS BIGINT) + length(marker) + 1) AS after FROM m3),
mk AS (SELECT * FROM m4 WHERE len(indices) > 0)"""

_CONNECT = r"\b(however|therefore|consequently|whereas|while|although|but|by contrast|conversely|furthermore|moreover|nevertheless|in contrast)\b"
CLAUSES = rf"""
c0 AS (SELECT *, CASE WHEN regexp_matches(before, '(?i){_CONNECT}') THEN regexp_extract(before, '(?is)^.*({_CONNECT}.*)$', 1)
    WHEN regexp_matches(before, '[;:—–]') THEN regexp_extract(before, '(?s)^.*[;:—–](.*)$', 1)
    WHEN length(before) > 300 AND contains(before, ',') AND length({_clean(_unmark("regexp_extract(before, '(?s)^.*,(.*)$', 1)"), 700)}) >= 40 THEN regexp_extract(before, '(?s)^.*,(.*)$', 1)
    ELSE before END AS part FROM mk),
c1 AS (SELECT *, {_clean(_unmark("part"), 700)} AS c, {_clean(_unmark("before || ' ' || after"), 500)} AS w FROM c0),
cl AS (SELECT doc_id, paragraph_id, section, sentence_no, no, indices, CASE WHEN length(c) < 40 THEN 'sentence_fallback' ELSE 'clause' END AS scope,
  CASE WHEN length(c) < 40 THEN w WHEN length(c) > 500 THEN {_clean("c", 500)} ELSE c END AS clause FROM c1)"""

EVENTS = rf"""
e0 AS (SELECT *, trim(regexp_replace(lower(clause), '[^a-z0-9]+', ' ', 'g')) AS key, row_number() OVER (PARTITION BY doc_id, paragraph_id, sentence_no ORDER BY no) AS k
  FROM cl WHERE regexp_matches(clause, '\pL')),
fold AS (
  SELECT doc_id, paragraph_id, section, sentence_no, k, [struct_pack(clause := clause, scope := scope, key := key, indices := indices)] AS acc FROM e0 WHERE k = 1
  UNION ALL
  SELECT doc_id, paragraph_id, section, sentence_no, k, CASE WHEN hit > 0 THEN list_transform(acc, lambda x, j: CASE WHEN j = hit THEN struct_pack(clause := x.clause, scope := x.scope, key := x.key, indices := list_concat(x.indices, list_filter(indices, lambda y: NOT list_contains(x.indices, y)))) ELSE x END)
    ELSE list_append(acc, struct_pack(clause := clause, scope := scope, key := key, indices := indices)) END
  FROM (
    SELECT e.*, f.acc, coalesce(list_position(list_transform(f.acc, lambda x: x.scope = e.scope AND x.key <> '' AND e.key <> '' AND (x.key = e.key
      OR (length(x.key) <= length(e.key) AND length(x.key) >= 40 AND contains(e.key, x.key)) OR (length(e.key) < length(x.key) AND length(e.key) >= 40 AND contains(x.key, e.key)))), true), 0) AS hit
    FROM fold f JOIN e0 e ON e.doc_id = f.doc_id AND e.paragraph_id = f.paragraph_id AND e.sentence_no = f.sentence_no AND e.k = f.k + 1
  )
),
e1 AS (SELECT doc_id, paragraph_id, section, sentence_no, unnest(acc) AS x, unnest(range(len(acc))) AS no FROM (SELECT *, max(k) OVER (PARTITION BY doc_id, paragraph_id, sentence_no) AS last FROM fold) WHERE k = last),
ev AS (
  SELECT doc_id, section, x.clause AS clause, x.scope AS scope, x.indices AS indices, len(x.indices) AS group_size FROM e1
  QUALIFY row_number() OVER (PARTITION BY doc_id, section, x.key, x.indices ORDER BY paragraph_id, sentence_no, no) = 1
)"""

BULK = """
fi AS (SELECT l_orderkey, l_partkey, min(ROW(l_linenumber, l_partkey, l_suppkey)) AS spot FROM lineitem GROUP BY ALL),
ev AS (SELECT l_orderkey AS claim_id, o_orderpriority AS section, list(CAST(l_partkey AS VARCHAR) ORDER BY spot) AS indices, count(*) AS group_size FROM fi JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
ix AS (SELECT claim_id, section, unnest(indices) AS citation_index FROM ev),
us AS (SELECT citation_index, count(*) AS num_claims, count(DISTINCT section) AS num_sections FROM ix GROUP BY ALL)"""

CARDS = """
ca AS (SELECT CAST(d.doc_id AS VARCHAR) AS paper_id, CASE WHEN k.doc_id IS NOT NULL AND n_chars >= 400 THEN 0 WHEN k.doc_id IS NOT NULL THEN 1 WHEN n_chars >= 400 THEN 2 ELSE 3 END AS tier_rank
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) k ON k.doc_id = d.doc_id)"""
REFS = "rm AS (SELECT doc_id, CAST(k AS VARCHAR) AS citation_index, CAST((k * 7 + doc_id) % 200 AS VARCHAR) AS paper_id FROM documents, range(1, 46) t(k) WHERE (k + doc_id) % 3 <> 0)"
IDS = r"""
ri AS (SELECT o_orderkey, lpad(CAST(o_custkey % 2800 AS VARCHAR), 4, '0') AS m, lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS t FROM orders),
id AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE m || '.' || t END AS paper_id FROM ri)"""
SCORES = """
so AS (SELECT l_returnflag || l_linestatus AS method, lpad(CAST(l_suppkey % 30 + 1 AS VARCHAR), 3, '0') AS topic_id, ['BSC', 'TSQ', 'HDQ', 'MAR'][l_linenumber % 4 + 1] AS family, CAST(l_partkey % 4 AS VARCHAR) AS criterion, CAST(l_quantity AS INT) % 5 + 1 AS score
  FROM lineitem),
cm AS (SELECT method, family, criterion, avg(score) AS mean FROM so GROUP BY ALL),
fm AS (SELECT method, avg(mean) FILTER (family = 'BSC') AS b, avg(mean) FILTER (family = 'TSQ') AS t, avg(mean) FILTER (family = 'HDQ') AS h, avg(mean) FILTER (family = 'MAR') AS m, avg(mean) AS total, count(DISTINCT family) AS n FROM cm GROUP BY ALL)"""
FLAGS = """
au AS (SELECT o_orderkey AS doc_id, o_orderkey * 7 % 9000 AS w, o_custkey * 13 % 30 AS h, o_orderkey % 4 AS a, o_custkey % 7 AS tr, o_custkey * 11 % 5000 AS r, o_orderkey * 3 % 6000 AS b, o_custkey % 5 = 0 AS corpus, o_orderkey % 6 AS me FROM orders),
fl AS (SELECT doc_id, w < 4000 AND h < 10 AND a = 0 AS thin_overview, r > b AND r > 0 AND w < 4000 AND a = 0 AS reference_dominated_without_aids, w < 7000 AND h < 16 AND a < 2 AS limited_depth,
  w >= 7000 AND h >= 16 AND a = 0 AS broad_without_aids, w >= 7000 AND h >= 20 AND tr >= 4 AS formulaic_transition, corpus AND me < 3 AS unreproducible_corpus FROM au)"""

_TSQ = ["Research-Space Coverage", "Taxonomy Clarity and Boundary Control", "Survey Organization and Functional Coherence", "Synthesis Insight and Gap Analysis"]
_HDQ = ["Multi-Level Goal Alignment", "Paragraph Argument Progression", "Atomic Claim Specificity and Technical Concreteness", "Local Synthesis and Non-Enumerative Writing"]


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n"


_ALL_SCAN = (LINES, SCAN)
_ALL_PARA = (*_ALL_SCAN, PARAGRAPHS)
_ALL_SENT = (*_ALL_PARA, SENTENCES)
_ALL_MARK = (*_ALL_SENT, MARKERS)
_ALL_EVENT = (*_ALL_MARK, CLAUSES, EVENTS)

_DISTRIBUTION = """
bo AS (SELECT doc_id, count(DISTINCT section) AS total_body_sections FROM pa GROUP BY ALL),
co2 AS (SELECT doc_id, count(DISTINCT section) AS cited, count(*) AS claims, count(*) FILTER (group_size = 1) AS singles, count(*) FILTER (group_size > 1) AS multis, avg(group_size) AS mean, max(group_size) AS largest,
  count(*) FILTER (group_size >= 5) AS large, count(*) FILTER (group_size > 15) AS over FROM ev GROUP BY ALL),
us AS (SELECT doc_id, i, count(*) AS n FROM (SELECT doc_id, unnest(indices) AS i FROM ev) GROUP BY ALL),
ur AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS k FROM us),
ut AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS uniq, max(n) AS top, sum(n) FILTER (k <= 5) AS five FROM ur GROUP BY ALL),
rg AS (SELECT doc_id, count(*) AS groups, sum(n) AS claims FROM (SELECT doc_id, indices, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)
SELECT bo.doc_id, total_body_sections, coalesce(cited, 0) AS sections_with_citations, round(coalesce(cited, 0) / total_body_sections, 4) AS section_citation_coverage_ratio,
  coalesce(co2.claims, 0) AS total_cited_claims, coalesce(singles, 0) AS single_citation_claims, coalesce(multis, 0) AS multi_citation_claims,
  coalesce(total, 0) AS total_citation_mentions, coalesce(uniq, 0) AS num_unique_citation_indices, coalesce(round(top / total, 4), 0) AS top_1_citation_mention_share, coalesce(round(five / total, 4), 0) AS top_5_citation_mention_share,
  coalesce(groups, 0) AS num_repeated_exact_citation_groups, coalesce(round(large / co2.claims, 4), 0) AS large_citation_group_ratio, coalesce(round(over / co2.claims, 4), 0) AS oversized_citation_group_ratio,
  coalesce(round(mean, 4), 0) AS avg_citation_group_size, coalesce(largest, 0) AS max_citation_group_size, coalesce(round(singles / co2.claims, 4), 0) AS single_citation_claim_ratio,
  coalesce(round(multis / co2.claims, 4), 0) AS multi_citation_claim_ratio, coalesce(round(rg.claims / co2.claims, 4), 0) AS repeated_exact_group_claim_ratio
FROM bo LEFT JOIN co2 USING (doc_id) LEFT JOIN ut USING (doc_id) LEFT JOIN rg USING (doc_id)"""

_WORDS = "['method', 'benchmark', 'latency', 'limitation', 'taxonomy', 'accuracy', 'attack', 'corpus', 'story', 'introduction']"
_TYPES = [
    ("security_or_robustness", "prompt injection|attack|poisoning|adversarial|vulnerability|robustness|jailbreak|security|defense|threat|malicious"),
    ("efficiency_or_deployment", "latency|cost|token|compression|quantization|pruning|edge|deployment|throughput|memory|cache|serving|efficient|efficiency"),
    ("taxonomy_or_synthesis", "taxonomy|categorize|paradigm|classify|survey|line of work|trend|convergence|trade[- ]?off|comparison|shared limitation|family|families|direction|research area|landscape"),
    ("result_finding", "outperform|achieve|accuracy|success rate|result|performance|improve|gain|score|win rate|pass rate"),
    ("benchmark_role", "benchmark|dataset|evaluation|leaderboard"),
    ("limitation", "limitation|challenge|fail|failure|struggle|brittle|weakness|risk|degrade|error|hallucination"),
    ("method_description", "framework|method|model|architecture|pipeline|mechanism|approach|module|agent|retrieval|planning|tool|function calling|orchestration|fine[- ]?tuning"),
    ("dataset_or_task", "dataset|task|corpus|benchmark"),
]
_GROUP = "['taxonomy_or_synthesis', 'method_description', 'security_or_robustness', 'efficiency_or_deployment', 'benchmark_role', 'result_finding', 'limitation', 'dataset_or_task', 'background', 'other']"
_SINGLE = "['method_description', 'result_finding', 'benchmark_role', 'security_or_robustness', 'efficiency_or_deployment', 'limitation', 'dataset_or_task', 'taxonomy_or_synthesis', 'background', 'other']"
_KIND = "CASE " + " ".join(rf"WHEN regexp_matches(t, '\b({w})\b') THEN '{n}'" for n, w in _TYPES) + r" WHEN regexp_matches(lower(section), '\b(introduction|background)\b') THEN 'background' ELSE 'other' END"
_RAW = "CASE WHEN k % 5 = 0 THEN 'score ' || (k % 13) WHEN k % 5 = 1 THEN (k % 6) || '.5' WHEN k % 5 = 2 THEN 'n/a' ELSE CAST(k % 9 - 1 AS VARCHAR) END"
_PAGES = """list_sort(list_distinct(list_concat(range(0, 10), range(n - 5, n), list_transform(range(0, 35), lambda i: 10 + CAST(CASE WHEN abs(i * (n - 16) / 34.0 - floor(i * (n - 16) / 34.0) - 0.5) < 1e-12
  THEN CASE WHEN floor(i * (n - 16) / 34.0) % 2 = 0 THEN floor(i * (n - 16) / 34.0) ELSE ceil(i * (n - 16) / 34.0) END ELSE round(i * (n - 16) / 34.0) END AS BIGINT)))))"""

ALL: dict[str, str] = {
    "citation_distribution": _with(*_ALL_EVENT, recursive=True).rstrip() + "," + _DISTRIBUTION,
    "norm_ids": _with(IDS) + "SELECT o_orderkey, paper_id, 2000 + CAST(substr(paper_id, 1, 2) AS INT) AS year, substr(paper_id, 3, 2) AS month FROM id",
    "year_filter": _with(IDS) + "SELECT o_orderkey % 50 AS sample, count(*) FILTER (CAST(substr(paper_id, 1, 2) AS INT) BETWEEN 20 AND 26) AS kept, count(*) FILTER (paper_id IS NULL) AS invalid_arxiv_id, count(*) FILTER (CAST(substr(paper_id, 1, 2) AS INT) NOT BETWEEN 20 AND 26) AS outside_year_range FROM id GROUP BY ALL",
    "sentence_split": f"SELECT doc_id, unnest(range(len(l))) AS no, unnest(l) AS sentence FROM (SELECT doc_id, {_sentences('text')} AS l FROM documents)",
    "clean_text": f"SELECT page_id, length(c) AS n_chars, CASE WHEN length(c) <= 300 THEN c ELSE regexp_replace(substr(c, 1, 297), '\\s+$', '') || '...' END AS cleaned FROM (SELECT page_id, {_clean('html', 10**9)} AS c FROM pages)",
    "citation_extract": _with(*_ALL_MARK) + "SELECT doc_id, paragraph_id, sentence_no, no, array_to_string(indices, ',') AS indices FROM mk",
    "attached_clauses": _with(*_ALL_MARK, CLAUSES) + "SELECT doc_id, paragraph_id, sentence_no, no, scope, clause FROM cl",
    "citation_expand": rf"""
WITH r AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, l_linenumber AS n FROM lineitem),
x AS (SELECT a || ', ' || b || '-' || (b + n - 2) || '; ' || a AS raw, list_concat([a], CASE WHEN n >= 2 THEN range(b, b + n - 1) ELSE [] END) AS l FROM r)
SELECT DISTINCT raw, array_to_string(list_filter(l, lambda y, i: list_position(l, y) = i), ',') AS indices FROM x""",
    "line_scan": _with(*_ALL_SCAN) + "SELECT doc_id, line_no, kind, section FROM sc",
    "paragraphs": _with(*_ALL_PARA) + "SELECT * FROM pa",
    "attach_citations": _with(*_ALL_SENT) + "SELECT doc_id, paragraph_id, sentence_no, sentence FROM sn",
    "attach_counts": _with(*_ALL_SENT) + "SELECT doc_id, count(*) FILTER (lone AND g > 0) AS attached, count(*) FILTER (lone AND g = 0) AS skipped FROM s2 GROUP BY ALL",
    "claim_type": f"""
WITH p AS (SELECT p_partkey, 'Part ' || {_WORDS}[p_partkey % 10 + 1] AS section, lower('Part ' || {_WORDS}[p_partkey % 10 + 1] || ' ' || lower(p_name) || ' ' || {_WORDS}[p_partkey % 7 + 1]) AS t FROM part),
k AS (SELECT p_partkey, {_KIND} AS claim_type FROM p)
SELECT p_partkey, claim_type, list_position({_GROUP}, claim_type) - 1 AS group_priority, list_position({_SINGLE}, claim_type) - 1 AS single_priority FROM k""",
    "group_bins": _with(BULK) + "SELECT CASE WHEN group_size <= 4 THEN CAST(group_size AS VARCHAR) WHEN group_size <= 8 THEN '5-8' WHEN group_size <= 15 THEN '9-15' ELSE '16+' END AS size_bin, count(*) AS claims FROM ev GROUP BY ALL",
    "section_stats": _with(BULK) + "SELECT section, count(DISTINCT claim_id) AS cited_claims, count(*) AS citation_mentions, count(DISTINCT citation_index) AS unique_citations FROM ix GROUP BY ALL",
    "section_coverage": _with(*_ALL_EVENT, recursive=True) + "SELECT p.doc_id, p.n AS total_body_sections, coalesce(e.n, 0) AS sections_with_citations, round(coalesce(e.n, 0) / p.n, 4) AS section_citation_coverage_ratio FROM (SELECT doc_id, count(DISTINCT section) AS n FROM pa GROUP BY ALL) p LEFT JOIN (SELECT doc_id, count(DISTINCT section) AS n FROM ev GROUP BY ALL) e USING (doc_id)",
    "citation_reuse_topk": _with(BULK) + "SELECT *, row_number() OVER (ORDER BY num_claims DESC, CAST(citation_index AS BIGINT)) AS rank FROM us ORDER BY rank LIMIT 20",
    "top_share": _with(BULK) + "SELECT CAST(sum(num_claims) AS BIGINT) AS total_citation_mentions, count(*) AS num_unique_citation_indices, round(max(num_claims) / sum(num_claims), 4) AS top_1_citation_mention_share, round(sum(num_claims) FILTER (k <= 5) / sum(num_claims), 4) AS top_5_citation_mention_share FROM (SELECT *, row_number() OVER (ORDER BY num_claims DESC) AS k FROM us)",
    "repeated_groups": _with(BULK) + "SELECT array_to_string(indices, ',') AS indices, count(*) AS num_occurrences, count(DISTINCT section) AS num_sections FROM ev GROUP BY ev.indices HAVING count(*) > 1",
    "group_balance": _with(BULK) + "SELECT round(avg(CAST(group_size >= 5 AS INT)), 4) AS large_citation_group_ratio, round(avg(CAST(group_size > 10 AS INT)), 4) AS oversized_citation_group_ratio, round(avg(group_size), 4) AS avg_citation_group_size, max(group_size) AS max_citation_group_size, round(avg(CAST(group_size = 1 AS INT)), 4) AS single_citation_claim_ratio FROM ev",
    "largest_groups": _with(*_ALL_EVENT, recursive=True) + "SELECT doc_id, count(*) AS n, max(group_size) AS largest, CAST(sum(group_size) AS BIGINT) AS mentions FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY group_size DESC) AS k FROM ev) WHERE k <= 10 GROUP BY ALL",
    "skipped_lines": _with(*_ALL_SCAN) + f"""SELECT doc_id, count(*) FILTER (kind = 'table' AND hit) AS "table", count(*) FILTER ((kind = 'code' OR (kind = 'fence' AND fences % 2 = 0)) AND hit) AS code,
  count(*) FILTER (kind = 'caption' AND hit) AS caption, count(*) FILTER (kind = 'reference_entry') AS reference_entry FROM (SELECT *, regexp_matches({_join_ranges("s")}, '{_MARK}') AS hit FROM sc) GROUP BY ALL""",
    "resolve_citations": _with(*_ALL_MARK, REFS) + "SELECT m.doc_id, m.citation_index, paragraph_id, sentence_no, no, paper_id FROM (SELECT doc_id, paragraph_id, sentence_no, no, unnest(indices) AS citation_index FROM mk) m JOIN rm USING (doc_id, citation_index)",
    "evidence_tiers": _with(CARDS) + "SELECT paper_id, tier_rank, ['metadata_and_abstract', 'metadata_only', 'abstract_only', 'title_only'][tier_rank + 1] AS tier FROM ca",
    "claim_tiers": _with(CARDS) + """, c AS (
  SELECT l_orderkey AS claim_id, count(*) FILTER (tier_rank = 0) AS metadata_and_abstract, count(*) FILTER (tier_rank = 1) AS metadata_only, count(*) FILTER (tier_rank = 2) AS abstract_only, count(*) FILTER (tier_rank = 3) AS title_only,
    count(*) FILTER (tier_rank IS NULL) AS missing, count(*) FILTER (tier_rank = 4) AS insufficient, count(*) AS num_papers, max(tier_rank) AS worst
  FROM lineitem LEFT JOIN ca ON ca.paper_id = CAST(l_partkey % 1200 AS VARCHAR) GROUP BY ALL
), t AS (SELECT *, CASE WHEN missing + insufficient > 0 THEN 4 WHEN worst = 0 THEN 0 WHEN metadata_only > 0 THEN 1 WHEN abstract_only > 0 THEN 2 ELSE 3 END AS tier_rank FROM c)
SELECT * EXCLUDE (worst), ['all_metadata_and_abstract', 'mixed_with_metadata_only', 'mixed_with_abstract_only', 'title_only_or_weak', 'has_missing_or_insufficient'][tier_rank + 1] AS tier FROM t""",
    "paper_inverse_index": _with(REFS) + "SELECT doc_id, paper_id, string_agg(citation_index, ',' ORDER BY CAST(citation_index AS INT)) AS citation_indices FROM rm GROUP BY ALL",
    "claim_dedup": _with(*_ALL_EVENT, recursive=True) + "SELECT doc_id, section, array_to_string(indices, ',') AS indices, clause, scope FROM ev",
    "audit_flags": _with(FLAGS) + "SELECT * FROM fl",
    "score_caps": _with(FLAGS) + ", ru AS (SELECT doc_id, unnest(list_filter([CASE WHEN thin_overview OR reference_dominated_without_aids THEN 'thin' WHEN limited_depth THEN 'limited' END, CASE WHEN unreproducible_corpus THEN 'unreproducible' END, CASE WHEN broad_without_aids THEN 'broad' END, CASE WHEN formulaic_transition THEN 'formulaic' END], lambda x: x IS NOT NULL)) AS rule FROM fl), cp(rule, family, criterion, cap) AS (VALUES "
    + ", ".join(
        [f"('thin', 'TSQ', '{c}', 3), ('limited', 'TSQ', '{c}', 4), ('broad', 'TSQ', '{c}', 4)" for c in _TSQ]
        + [f"('thin', 'HDQ', '{c}', 4), ('limited', 'HDQ', '{c}', 4)" for c in _HDQ]
        + [f"('unreproducible', 'TSQ', '{c}', 4)" for c in _TSQ[:2]]
        + [f"('broad', 'HDQ', '{_HDQ[3]}', 4)", f"('formulaic', 'TSQ', '{_TSQ[2]}', 4)", f"('formulaic', 'HDQ', '{_HDQ[1]}', 4)"]
    )
    + "), lo AS (SELECT doc_id, family, criterion, min(cap) AS cap FROM ru JOIN cp USING (rule) GROUP BY ALL) SELECT family, criterion, cap, count(*) AS n FROM lo GROUP BY ALL",
    "score_coerce": rf"""
WITH r AS (SELECT ['BSC', 'TSQ', 'HDQ', 'MAR'][l_linenumber % 4 + 1] AS family, l_orderkey * 7 + l_linenumber AS k FROM lineitem),
t AS (SELECT family, {_RAW} AS raw, k % 2 = 0 AS is_text FROM r),
v AS (SELECT *, TRY_CAST(regexp_extract(raw, '(-?\d+(\.\d+)?)', 1) AS DOUBLE) AS num FROM t),
s AS (SELECT family, raw, is_text, CASE WHEN family IN ('BSC', 'MAR') THEN
    CASE WHEN regexp_matches(raw, '^-?\d+$') THEN CAST(raw AS INT) WHEN NOT is_text AND regexp_matches(raw, '^-?\d+\.\d+$') THEN CAST(trunc(num) AS INT) ELSE 1 END
  ELSE CASE WHEN num IS NULL THEN 3 WHEN num - floor(num) = 0.5 THEN CAST(floor(num) + (CAST(floor(num) AS INT) % 2) AS INT) ELSE CAST(round(num) AS INT) END END AS x FROM v)
SELECT family, raw, is_text, greatest(1, least(5, x)) AS score, count(*) AS n FROM s GROUP BY ALL""",
    "family_means": _with(SCORES) + "SELECT fm.method, round(b, 6) AS BSC_Avg, round(t, 6) AS TSQ_Avg, round(h, 6) AS HDQ_Avg, round(m, 6) AS MAR_Avg, CASE WHEN n = 4 THEN round(total, 6) END AS Total_Avg, topics FROM fm JOIN (SELECT method, count(DISTINCT topic_id) AS topics FROM so GROUP BY ALL) c USING (method)",
    "subtotals": _with(SCORES) + "SELECT method, topic_id, family, CAST(sum(s) AS BIGINT) AS raw_20 FROM (SELECT method, topic_id, family, criterion, max(score) AS s FROM so GROUP BY ALL) GROUP BY ALL",
    "matched_subset": _with(SCORES, "go AS (SELECT * FROM so WHERE NOT (method = 'AF' AND topic_id IN ('003', '017')))") + "SELECT method, topic_id, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM go WHERE topic_id IN (SELECT topic_id FROM go GROUP BY ALL HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM go)) GROUP BY ALL",
    "rank_systems": _with(SCORES) + "SELECT method, CASE WHEN method = 'NO' THEN 'Reference' ELSE 'General' END AS Category, round(total, 6) AS Total_Avg, CASE WHEN method <> 'NO' THEN rank() OVER (PARTITION BY method = 'NO' ORDER BY round(total, 6) DESC) END AS rank FROM fm",
    "score_upsert": """
WITH r AS (SELECT CAST(o_custkey % 97 AS VARCHAR) AS method, lpad(CAST(o_orderkey % 30 AS VARCHAR), 3, '0') AS topic_id, 'off' AS api_mode, o_orderkey AS k FROM orders WHERE o_orderkey % 11 <> 0),
o AS (SELECT method, topic_id, api_mode, max(k) AS score FROM r WHERE k % 2 = 0 GROUP BY ALL), n AS (SELECT method, topic_id, api_mode, max(k) AS score FROM r WHERE k % 2 = 1 GROUP BY ALL)
SELECT method, topic_id, api_mode, coalesce(n.score, o.score) AS score FROM o FULL JOIN n USING (method, topic_id, api_mode)""",
    "page_sample": f"SELECT c_custkey, CASE WHEN n <= 50 THEN array_to_string(range(0, n), ',') ELSE array_to_string({_PAGES}, ',') END AS pages FROM (SELECT c_custkey, c_custkey % 400 AS n FROM customer)",
    "first_pages": "SELECT l_orderkey, page_no FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY page_no) AS k FROM (SELECT DISTINCT l_orderkey, l_partkey * 10 + l_linenumber AS page_no FROM lineitem)) WHERE k <= 3",
    "input_anti_join": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "topic_titles": "SELECT lpad(CAST(s_nationkey * 2 AS VARCHAR), 3, '0') AS topic_id, s_suppkey, coalesce(n_name, 'Topic ' || lpad(CAST(s_nationkey * 2 AS VARCHAR), 3, '0')) AS topic FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey * 2",
    "batch_summary": "SELECT CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'error' END AS status, count(*) AS samples FROM orders GROUP BY ALL",
    "windowed_events": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
