"""DuckDB SQL equivalent to the registered queries."""

from __future__ import annotations

from tessera.functions.tables import LAYER_TERMS, ROLE_DEPENDENCIES, ROLE_NAMES, SEGMENT_ROLES, STOPWORDS

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens(source: str, name: str = "tok") -> str:
    """CTEs that cut the column text of ``source`` (id, text) into tokens (id, t)."""
    return f"""
{name}_words AS (SELECT id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) AS w FROM {source}),
{name}_cut AS (SELECT id, w, string_split(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' ') AS parts FROM {name}_words),
{name}_all AS (SELECT id, lower(w) AS t FROM {name}_cut UNION ALL SELECT id, lower(p) AS t FROM (SELECT id, unnest(parts) AS p FROM {name}_cut WHERE len(parts) > 1)),
{name} AS (SELECT id, t FROM {name}_all WHERE length(t) > 1 AND t NOT IN ({STOP}))"""


DOCS = "docs AS (SELECT doc_id AS id, coalesce(text, '') AS text, source FROM documents)"


def bm25(docs: str, queries: str = "q", k: int = 10, prefix: str = "bm") -> str:
    """CTEs of the ranked rows ``<prefix>`` (query_id, id, score, rank)."""
    return f"""
{tokens(docs, prefix + '_tok')},
{prefix}_dl AS (SELECT d.id, count(t.t) AS dl FROM {docs} d LEFT JOIN {prefix}_tok t ON d.id = t.id GROUP BY d.id),
{prefix}_stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM {prefix}_dl),
{prefix}_tf AS (SELECT t AS term, id, count(*) AS tf FROM {prefix}_tok GROUP BY t, id),
{prefix}_df AS (SELECT term, count(*) AS df FROM {prefix}_tf GROUP BY term),
{tokens(f'(SELECT query_id AS id, text FROM {queries})', prefix + '_q')},
{prefix}_terms AS (SELECT DISTINCT id AS query_id, t AS term FROM {prefix}_q),
{prefix}_scored AS (
  SELECT q.query_id, f.id, round(sum(ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) * (f.tf * 2.5) / (f.tf + 1.5 * (0.25 + 0.75 * l.dl / greatest(s.avgdl, 1.0)))), 9) AS score
  FROM {prefix}_terms q JOIN {prefix}_tf f ON q.term = f.term JOIN {prefix}_df d ON d.term = f.term JOIN {prefix}_dl l ON l.id = f.id CROSS JOIN {prefix}_stats s
  GROUP BY q.query_id, f.id),
{prefix} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {prefix}_scored WHERE score > 0) WHERE rank <= {k})"""


Q = "q AS (SELECT item_id AS query_id, text FROM benchmark)"
DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"


def vectors(k: int, where: str, name: str = "vec") -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round({DOT}, 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({DOT}, 9) DESC, v.vec_id) AS rank
  FROM embeddings q CROSS JOIN embeddings v WHERE {where}) WHERE rank <= {k})"""


EDGES = """
edges AS (
  SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"""
FILE_EDGES = "edges AS (SELECT DISTINCT 'f' || l_orderkey AS src, 'f' || l_partkey AS dst FROM lineitem)"
SEEDS = "seeds AS (SELECT n_nationkey AS query_id, 'n' || n_nationkey AS file FROM nation)"

ROLE_CASE = " ".join(f"WHEN x IN ({', '.join(repr(n) for n in names)}) THEN '{role}'" for role, names in SEGMENT_ROLES.items())
PATHS = "paths AS (SELECT page_id AS id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', '') AS path FROM pages)"
PARENT = "regexp_replace(regexp_replace({0}, '[^/]*$', ''), '/$', '')"
NAME = "regexp_extract({0}, '[^/]*$')"
SUFFIX = """CASE
  WHEN (CASE WHEN regexp_matches({0}, '^.+\\.[^.]*$') THEN regexp_extract({0}, '^(.+)\\.[^.]*$', 1) ELSE {0} END) IN ('index', 'mod', 'lib', 'main')
    THEN (CASE WHEN regexp_matches({0}, '^.+\\.[^.]*$') THEN regexp_extract({0}, '^(.+)\\.[^.]*$', 1) ELSE {0} END)
  WHEN regexp_matches({0}, '\\.([A-Za-z0-9-]+)\\.tsx?$') THEN '.' || regexp_extract({0}, '\\.([A-Za-z0-9-]+\\.tsx?)$', 1)
  WHEN regexp_matches({0}, '^.+\\.[^.]*$') THEN '.' || regexp_extract({0}, '\\.([^.]*)$', 1)
  ELSE {0} END"""

BY_DEPS = " ".join("WHEN len(list_filter(deps, lambda d: " + " OR ".join(f"starts_with(d, '{p}')" for p in ps) + f")) > 0 THEN '{role}'" for role, ps in ROLE_DEPENDENCIES.items())
BY_NAME = " ".join("WHEN " + " OR ".join(f"contains(lower(name || ' ' || dir), '{p}')" for p in ps) + f" THEN '{role}'" for role, ps in ROLE_NAMES.items())
PART_ROLES = f"""
packages AS (
  SELECT p_partkey, (['services/api', 'web-ui', 'Common-types', 'infra', 'Mobile', 'sql', 'docs', 'lambda'])[p_partkey % 8 + 1] AS name, 'x/' || lower(p_name) AS dir,
         CASE p_size % 5 WHEN 0 THEN ['zod', 'react-dom'] WHEN 1 THEN ['express'] WHEN 2 THEN CAST([] AS VARCHAR[]) WHEN 3 THEN ['@nestjs/core', 'expo'] ELSE ['vue-router', 'left-pad'] END AS deps,
         (['unknown', NULL, 'backend', 'docs'])[p_partkey % 4 + 1] AS role FROM part),
guessed AS (SELECT *, CASE {BY_DEPS} END AS by_deps, CASE {BY_NAME} ELSE 'unknown' END AS by_name FROM packages),
roles AS (SELECT *, coalesce(by_deps, by_name) AS inferred, coalesce(nullif(role, 'unknown'), by_deps, by_name) AS resolved FROM guessed)"""

LAYERS = "layer_terms(role, term) AS (VALUES " + ", ".join(f"('{r}', '{t}')" for r, ts in LAYER_TERMS.items() for t in ts) + ")"


def layers(queries: str = "q") -> str:
    """CTEs of mult (query_id, role, hits, mult)."""
    return f"""
{LAYERS},
{tokens(f'(SELECT query_id AS id, text FROM {queries})', 'lq')},
lwords AS (SELECT DISTINCT id AS query_id, t AS token FROM lq),
lhits AS (SELECT w.query_id, l.role, count(DISTINCT l.term) AS hits FROM lwords w JOIN layer_terms l ON w.token = l.term OR (strlen(l.term) >= 4 AND starts_with(w.token, l.term)) GROUP BY ALL),
lall AS (SELECT q.query_id, r.role, coalesce(h.hits, 0) AS hits FROM (SELECT DISTINCT query_id FROM {queries}) q CROSS JOIN (SELECT DISTINCT role FROM layer_terms) r LEFT JOIN lhits h ON h.query_id = q.query_id AND h.role = r.role),
mult AS (SELECT query_id, role, hits, CASE WHEN hits > 0 THEN 1 + 0.6 * hits / max(hits) OVER (PARTITION BY query_id) ELSE 1.0 END AS mult FROM lall)"""


def symbols(queries: str = "q", name: str = "sym") -> str:
    """CTEs of ``name`` (query_id, file, score, exact) over parts."""
    return f"""
{tokens('(SELECT p_partkey AS id, p_name AS text FROM part)', name + '_n')},
{tokens(f'(SELECT query_id AS id, text FROM {queries})', name + '_q')},
{name}_qt AS (SELECT DISTINCT id AS query_id, t FROM {name}_q),
{name}_hits AS (SELECT q.query_id, n.id, count(*) AS n FROM {name}_n n JOIN {name}_qt q ON n.t = q.t GROUP BY ALL),
{name}_exact AS (SELECT q.query_id, p.p_partkey AS id FROM {queries} q JOIN part p ON length(p.p_name) >= 3 AND contains(lower(q.text), lower(p.p_name))
  AND regexp_matches(lower(q.text), '(^|[^A-Za-z0-9_$])' || regexp_escape(lower(p.p_name)) || '([^A-Za-z0-9_$]|$)')),
{name}_each AS (SELECT coalesce(h.query_id, e.query_id) AS query_id, coalesce(h.id, e.id) AS id, coalesce(h.n, 0) + CASE WHEN e.id IS NOT NULL THEN 2 ELSE 0 END AS score, e.id IS NOT NULL AS exact
  FROM {name}_hits h FULL JOIN {name}_exact e ON h.query_id = e.query_id AND h.id = e.id),
{name} AS (SELECT query_id, 'f' || id AS file, max(score) AS score, bool_or(exact) AS exact FROM {name}_each GROUP BY ALL)"""


FUSED = f"""
{vectors(80, 'q.vec_id IN (SELECT item_id FROM benchmark)')},
by_vector AS (SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM (SELECT query_id, 'f' || id AS file, rank FROM vec) GROUP BY query_id, file),
{bm25('docs', 'q', 80)},
by_words AS (SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM (SELECT query_id, 'f' || id AS file, rank FROM bm) GROUP BY query_id, file),
{symbols()},
by_name AS (SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) AS rank FROM sym),
fused AS (SELECT query_id, file, round(sum(1 / (60.0 + rank)), 9) AS score FROM (SELECT * FROM by_vector UNION ALL SELECT * FROM by_words UNION ALL SELECT * FROM by_name) GROUP BY query_id, file)"""

PKG_ROLE = "CASE WHEN contains(lower(source || ' packages/' || source), 'packages/') THEN 'shared' ELSE 'unknown' END"
WEIGHTED = f"""
{layers()},
fpkg AS (SELECT 'f' || id AS file, {PKG_ROLE} AS role FROM docs),
weighted AS (SELECT f.query_id, f.file, round(f.score * coalesce(m.mult, 1.0), 9) AS score FROM fused f LEFT JOIN fpkg p ON p.file = f.file LEFT JOIN mult m ON m.query_id = f.query_id AND m.role = p.role)"""

MANIFEST = f"""
WITH {DOCS}, {Q}, {FUSED}, {WEIGHTED}, {FILE_EDGES},
best AS (SELECT query_id, file FROM (SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) AS k FROM weighted) WHERE k <= 8),
forced AS (SELECT query_id, file FROM (SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) AS k FROM sym WHERE exact) WHERE k <= 5),
start AS (SELECT * FROM best UNION SELECT * FROM forced),
ways AS (SELECT src AS a, dst AS b, 0 AS way FROM edges UNION ALL SELECT dst, src, 1 FROM edges),
hop1 AS (SELECT s.query_id, w.b AS file, min(w.way) AS way FROM start s JOIN ways w ON s.file = w.a WHERE NOT EXISTS (SELECT 1 FROM start x WHERE x.query_id = s.query_id AND x.file = w.b) GROUP BY ALL),
hop2 AS (SELECT s.query_id, w.b AS file, min(w.way) AS way FROM hop1 s JOIN ways w ON s.file = w.a
  WHERE NOT EXISTS (SELECT 1 FROM start x WHERE x.query_id = s.query_id AND x.file = w.b) AND NOT EXISTS (SELECT 1 FROM hop1 x WHERE x.query_id = s.query_id AND x.file = w.b) GROUP BY ALL),
cand AS (SELECT query_id, file, 'query-match' AS reason FROM start
  UNION ALL SELECT query_id, file, CASE WHEN way = 0 THEN 'imported-by-seed' ELSE 'imports-seed' END FROM hop1
  UNION ALL SELECT query_id, file, CASE WHEN way = 0 THEN 'imported-by-seed' ELSE 'imports-seed' END FROM hop2),
near AS (SELECT s.query_id, w.b AS file, count(DISTINCT w.a) AS n FROM start s JOIN ways w ON s.file = w.a WHERE w.a <> w.b GROUP BY ALL),
scored AS (SELECT c.query_id, c.file, c.reason, round(coalesce(w.score, 0.0) + 0.4 * coalesce(n.n, 0) + CASE WHEN x.file IS NOT NULL THEN 3.0 ELSE 0.0 END, 9) AS score
  FROM cand c LEFT JOIN weighted w ON w.query_id = c.query_id AND w.file = c.file LEFT JOIN near n ON n.query_id = c.query_id AND n.file = c.file LEFT JOIN sym x ON x.query_id = c.query_id AND x.file = c.file AND x.exact),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, reason = 'query-match' ORDER BY score DESC, file) AS k FROM scored) WHERE reason = 'query-match' OR k <= 10),
lines AS (SELECT 'f' || id AS file, source AS pkg, len(string_split(text, chr(10))) AS n FROM docs),
chunk AS (SELECT vec_id AS id, 'f' || vec_id AS file, 'sym' || label AS name, vec_id % 7 + 1 AS start_line FROM embeddings),
attached AS (SELECT query_id, file, least(6, count(*)) AS n FROM (SELECT DISTINCT v.query_id, c.file, c.name, c.start_line FROM vec v JOIN chunk c ON c.id = v.id WHERE v.rank <= 40) GROUP BY ALL)
SELECT k.query_id, k.file, coalesce(l.pkg, 'root') AS pkg, round(k.score, 6) AS score, k.reason, coalesce(l.n <= 50, false) AS whole_file, coalesce(a.n, 0) AS n_symbols
FROM kept k LEFT JOIN lines l ON l.file = k.file LEFT JOIN attached a ON a.query_id = k.query_id AND a.file = k.file
"""

RANKED_DOCS = f"{DOCS}, {Q}, {bm25('docs', 'q', 10)}"

SQL: dict[str, str] = {
    "tokens_per_doc": f"WITH {DOCS}, {tokens('docs')} SELECT d.id AS doc_id, count(t.t) AS n_tokens, count(DISTINCT t.t) AS n_terms FROM docs d LEFT JOIN tok t ON d.id = t.id GROUP BY d.id",
    "term_df": f"WITH {DOCS}, {tokens('docs')} SELECT t AS term, count(DISTINCT id) AS df FROM tok GROUP BY t",
    "doc_stats": f"WITH {DOCS}, {tokens('docs')}, s AS (SELECT d.id, count(t.t) AS dl FROM docs d LEFT JOIN tok t ON d.id = t.id GROUP BY d.id) SELECT count(*) AS n_docs, round(avg(dl), 6) AS avgdl FROM s",
    "bm25_single": f"WITH {DOCS}, q AS (SELECT 0 AS query_id, string_agg(text, ' ') AS text FROM benchmark), {bm25('docs', 'q', 10)} SELECT id AS doc_id, round(score, 6) AS score, rank FROM bm",
    "bm25_batch": f"WITH {RANKED_DOCS} SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM bm",
    "bm25_after_delete": f"WITH {DOCS}, {Q}, left_docs AS (SELECT * FROM docs WHERE source <> 'src3'), {bm25('left_docs', 'q', 10)} SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM bm",
    "vector_topk": f"WITH {vectors(10, 'q.vec_id = 0')} SELECT id, round(score, 6) AS score, rank FROM vec",
    "vector_batch": f"WITH {vectors(10, 'q.vec_id % 20 = 0')} SELECT query_id, id, round(score, 6) AS score, rank FROM vec",
    "vector_bulk": f"WITH {vectors(10, 'q.vec_id % 20 = 0')} SELECT query_id, id, round(score, 6) AS score, rank FROM vec",
    "first_per_group_rank": f"WITH {vectors(80, 'q.vec_id % 20 = 0')} SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM vec JOIN embeddings e ON e.vec_id = vec.id GROUP BY query_id, label",
    "symbol_match": f"WITH {Q.replace('benchmark', '''(SELECT p_partkey AS item_id, 'where is ' || p_name || ' and the old ' || p_type AS text FROM part WHERE p_partkey % 20 = 0)''')}, {symbols()} SELECT query_id, file, score, exact FROM sym",
    "rrf_fusion": f"WITH {DOCS}, {Q}, {FUSED} SELECT query_id, file, round(score, 6) AS score FROM fused",
    "weighted_fusion": f"WITH {DOCS}, {Q}, {FUSED}, {WEIGHTED} SELECT query_id, file, round(score, 6) AS score FROM weighted",
    "layer_multipliers": f"WITH q(query_id, text) AS (VALUES (1, 'add a database migration'), (2, 'renderScreen navigation and routes'), (3, 'nothing here'), (4, 'typed helpers in pages, serverless apiKey')), {layers()} SELECT query_id, role, hits, round(mult, 6) AS mult FROM mult",
    "path_roles": f"WITH {PATHS}, s AS (SELECT id, path, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM paths), r AS (SELECT id, path, list_filter(list_transform(list_reverse(parts[1:len(parts) - 1]), lambda x: CASE {ROLE_CASE.replace('x IN', 'lower(x) IN')} END), lambda x: x IS NOT NULL) AS roles FROM s) SELECT id AS page_id, path, coalesce(roles[1], 'unknown') AS role FROM r",
    "package_owner": f"WITH {PATHS}, dirs AS (SELECT id, path, {PARENT.format('path')} AS dir FROM paths), pk AS (SELECT DISTINCT dir AS dir FROM dirs UNION SELECT DISTINCT regexp_extract(path, '^[^/]*') FROM paths UNION SELECT ''), m AS (SELECT d.id, d.path, p.dir AS owner, row_number() OVER (PARTITION BY d.id ORDER BY length(p.dir) DESC) AS k FROM dirs d JOIN pk p ON p.dir = '' OR d.dir = p.dir OR starts_with(d.dir, p.dir || '/')) SELECT id AS page_id, path, 'pkg:' || owner AS pkg FROM m WHERE k = 1",
    "reverse_pairs": f"WITH {EDGES} SELECT dst AS file, src AS importer FROM edges",
    "union_graphs": f"WITH {EDGES}, {FILE_EDGES.replace('edges AS', 'file_edges AS')} SELECT src, count(*) AS n, min(dst) AS least FROM (SELECT * FROM edges UNION ALL SELECT * FROM file_edges) GROUP BY src",
    "delete_refusals": f"WITH {EDGES}, pairs AS (SELECT DISTINCT dst AS file, src AS importer FROM edges JOIN supplier ON dst = 's' || s_suppkey WHERE src <> dst), k AS (SELECT *, CAST(substr(importer, 2) AS INT) AS part FROM pairs) SELECT file, importer, CASE WHEN part % 3 = 0 THEN 3 END AS line FROM k WHERE part % 3 <> 0 OR contains('import s' || part % 7, file)",
    "inferred_roles": f"WITH {PART_ROLES} SELECT p_partkey, by_deps, by_name, inferred, resolved FROM roles",
    "top_suffixes": f"WITH {PATHS}, n AS (SELECT {PARENT.format('path')} AS dir, {NAME.format('path')} AS name FROM paths), h AS (SELECT dir, {SUFFIX.format('name')} AS suffix, count(*) AS n FROM n GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, suffix) AS k FROM h) SELECT dir, string_agg(suffix || '×' || n, ', ' ORDER BY k) AS top FROM k WHERE k <= 5 GROUP BY dir",
    "architecture": f"WITH {PATHS}, n AS (SELECT {PARENT.format('path')} AS dir, {NAME.format('path')} AS name FROM paths), h AS (SELECT dir, {SUFFIX.format('name')} AS suffix, count(*) AS n FROM n GROUP BY ALL), own AS (SELECT dir, CAST(sum(n) AS BIGINT) AS files, count(*) AS n_kinds FROM h GROUP BY dir), ch AS (SELECT dir AS child, {PARENT.format('dir')} AS dir, suffix FROM h WHERE dir <> ''), m AS (SELECT dir, count(DISTINCT child) AS module_count FROM ch GROUP BY dir HAVING count(DISTINCT child) >= 2), k AS (SELECT dir, suffix, count(*) AS n FROM ch GROUP BY ALL), t AS (SELECT dir, module_count FROM k JOIN m USING (dir) WHERE n >= ceil(module_count / 2.0) GROUP BY ALL HAVING count(*) >= 2) SELECT dir, coalesce(files, 0) AS files, CAST(coalesce(n_kinds, 0) AS INT) AS n_kinds, coalesce(module_count, 0) AS module_count FROM own FULL JOIN t USING (dir)",
    "enclosing_anchor": "WITH p AS (SELECT o_orderkey AS file, CAST(o_orderkey % 20 AS INT) AS line FROM orders), nodes AS (SELECT l_orderkey AS file, l_orderkey || '#' || l_linenumber AS node_id, l_linenumber AS ord, l_linenumber * 2 AS s, l_linenumber * 2 + CAST(trunc(l_quantity) AS INT) AS e FROM lineitem), held AS (SELECT file, node_id, ord, s, e, e - s AS span FROM nodes UNION ALL SELECT a.file, a.node_id, a.ord, b.s - 2, b.s - 1, a.e - a.s FROM nodes a JOIN nodes b USING (node_id)), best AS (SELECT p.file, p.line, arg_min(node_id, (span, ord)) AS node_id FROM (SELECT DISTINCT * FROM p) p JOIN held h ON h.file = p.file AND h.s <= p.line AND p.line <= h.e GROUP BY ALL) SELECT p.file, p.line, node_id FROM p LEFT JOIN best USING (file, line)",
    "decode_ranges": "WITH i AS (SELECT CAST(l_linenumber AS INT) AS a, CAST(l_suppkey % 9 AS INT) AS b, CAST(l_partkey % 11 AS INT) AS c, CAST(l_orderkey % 13 AS INT) AS d, 2 + l_orderkey % 3 AS size FROM lineitem) SELECT CASE WHEN size > 2 THEN a + 1 END AS start_line, CASE size WHEN 3 THEN a + 1 WHEN 4 THEN c + 1 END AS end_line, CASE WHEN size > 2 THEN b END AS start_char, CASE size WHEN 3 THEN c WHEN 4 THEN d END AS end_char, count(*) AS n FROM i GROUP BY ALL",
    "leading_comments": "WITH r AS (SELECT l_orderkey AS file, l_linenumber AS line, max(l_returnflag) <> 'R' AS c FROM lineitem GROUP BY ALL), above AS (SELECT n.file, n.line, max(o.line) AS stop FROM r n LEFT JOIN (SELECT a.file, a.line FROM r a WHERE NOT c UNION ALL SELECT a.file, a.line - 1 FROM r a LEFT JOIN r b ON b.file = a.file AND b.line = a.line - 1 WHERE b.file IS NULL) o ON o.file = n.file AND o.line < n.line WHERE NOT n.c GROUP BY ALL) SELECT n.file, n.line AS node_ord, coalesce(stop, 0) + 1 AS start_line, n.line - 1 AS end_line FROM above n JOIN r ON r.file = n.file AND r.line = n.line - 1 AND r.c",
    "one_per_line": "SELECT l_suppkey AS file, l_linenumber AS line, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY ALL",
    "fnv1a_hash": "SELECT c_custkey, lower(lpad(to_hex(CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all(hex(encode(c_name)), '..'), lambda p: CAST(('0x' || p) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS UBIGINT)), 16, '0')) AS hash FROM customer",
    "reverse_edges": f"WITH {EDGES} SELECT dst AS file, count(DISTINCT src) AS n_importers, string_agg(DISTINCT src, ',' ORDER BY src) AS importers FROM edges GROUP BY dst",
    "transitive_closure": f"WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), c(start, file, hop) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT c.start, e.src, c.hop + 1 FROM c JOIN e ON e.dst = c.file WHERE c.hop < 10) SELECT start, file, min(hop) AS hop FROM c WHERE start <> file GROUP BY ALL",
    "expand_hops": f"WITH {EDGES}, {SEEDS}, w AS (SELECT src AS a, dst AS b, 0 AS way FROM edges UNION ALL SELECT dst, src, 1 FROM edges), h1 AS (SELECT s.query_id, w.b AS file, min(way) AS way FROM seeds s JOIN w ON s.file = w.a WHERE w.b <> s.file GROUP BY ALL), h2 AS (SELECT h.query_id, w.b AS file, min(w.way) AS way FROM h1 h JOIN w ON h.file = w.a WHERE w.b <> 'n' || h.query_id AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.query_id = h.query_id AND x.file = w.b) GROUP BY ALL) SELECT query_id, file, hop, CASE WHEN way = 0 THEN 'imported-by-seed' ELSE 'imports-seed' END AS reason FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2)",
    "seed_adjacency": f"WITH {EDGES}, seeds AS (SELECT n_regionkey AS query_id, 'n' || n_nationkey AS file FROM nation), w AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges) SELECT s.query_id, w.b AS file, count(DISTINCT w.a) AS n FROM seeds s JOIN w ON s.file = w.a WHERE w.a <> w.b GROUP BY ALL",
    "graph_overlay": f"WITH {EDGES} SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM edges WHERE NOT starts_with(src, 's') UNION ALL SELECT 's' || s_suppkey, 'n' || (s_nationkey + 1) % 25 FROM supplier WHERE s_suppkey % 3 <> 0) GROUP BY ALL",
    "blast_radius": f"WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), c(file) AS (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT e.src FROM c JOIN e ON e.dst = c.file) SELECT DISTINCT file FROM c",
    "definition_owner_edges": "WITH occ AS (SELECT l_orderkey AS doc, l_partkey AS symbol, l_linenumber = 1 AS is_def FROM lineitem), o AS (SELECT symbol, min(doc) AS dst FROM occ WHERE is_def GROUP BY symbol) SELECT DISTINCT 'd' || occ.doc AS src, 'd' || o.dst AS dst FROM occ JOIN o ON o.symbol = occ.symbol WHERE NOT occ.is_def AND occ.doc <> o.dst",
    "manifest": MANIFEST,
    "find_symbols_exact": "WITH s AS (SELECT *, lower(p_name) = (SELECT min(lower(p_name)) FROM part) AS exact FROM part) SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, exact, total FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR)) AS k FROM s WHERE exact) WHERE k <= 200",
    "find_symbols_substring": "SELECT id, name, exact, total FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, lower(p_name) = 'blue' AS exact, count(*) OVER () AS total, row_number() OVER (ORDER BY lower(p_name) = 'blue' DESC, CAST(p_partkey AS VARCHAR)) AS k FROM part WHERE contains(lower(p_name), 'blue')) WHERE k <= 200",
    "resolve_first_candidate": f"WITH {PATHS}, f AS (SELECT DISTINCT path FROM paths), d AS (SELECT id, {PARENT.format('path')} AS dir, regexp_replace({NAME.format('path')}, '\\.html$', '') AS name FROM paths), c AS (SELECT id, 1 AS pos, dir || '/' || name AS path FROM d UNION ALL SELECT id, 2, dir || '/' || name || '.html' FROM d UNION ALL SELECT id, 3, {PARENT.format('dir')} || '/en/' || name FROM d), m AS (SELECT c.id, c.path, row_number() OVER (PARTITION BY c.id ORDER BY pos) AS k FROM c JOIN f ON f.path = c.path) SELECT 'p' || id AS src, path AS dst FROM m WHERE k = 1",
    "longest_prefix_owner": f"WITH {PATHS}, n AS (SELECT DISTINCT path AS name FROM paths), pre AS (SELECT DISTINCT regexp_extract(path, '^[^/]*') AS prefix FROM paths UNION SELECT DISTINCT {PARENT.format('path')} FROM paths WHERE id % 2 = 0), m AS (SELECT n.name, p.prefix, row_number() OVER (PARTITION BY n.name ORDER BY length(p.prefix) DESC) AS k FROM n JOIN pre p ON n.name = p.prefix OR starts_with(n.name, p.prefix || '/')) SELECT name, prefix FROM m WHERE k = 1",
    "line_slice": "WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents), s AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM l) SELECT doc_id, array_to_string(p[2:4], chr(10)) AS slice FROM s",
    "word_scan": "WITH l AS (SELECT 'f' || doc_id AS path, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents) SELECT path, line FROM l WHERE regexp_matches(t, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)') ORDER BY path, line LIMIT 8",
    "innermost_interval": "WITH nodes AS (SELECT l_orderkey AS file, l_orderkey || '#' || l_linenumber AS node_id, l_linenumber AS ord, l_linenumber * 2 AS s, l_linenumber * 2 + CAST(trunc(l_quantity) AS INT) AS e FROM lineitem), pts AS (SELECT o_orderkey AS file, CAST(o_orderkey % 20 AS INT) AS line FROM orders), m AS (SELECT p.file, p.line, n.node_id, row_number() OVER (PARTITION BY p.file, p.line ORDER BY e - s, ord DESC) AS k FROM pts p JOIN nodes n ON n.file = p.file AND s <= p.line AND p.line <= e) SELECT p.file, p.line, m.node_id FROM pts p LEFT JOIN m ON m.file = p.file AND m.line = p.line AND m.k = 1",
    "containment": "WITH nodes AS (SELECT l_orderkey AS file, l_linenumber AS ord, l_linenumber * 2 AS s, l_linenumber * 2 + CAST(trunc(l_quantity) AS INT) AS e FROM lineitem) SELECT file, ord FROM nodes a WHERE NOT EXISTS (SELECT 1 FROM nodes b WHERE b.file = a.file AND b.ord <> a.ord AND b.s >= a.s AND b.e <= a.e)",
    "dedupe_ids": "SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '~' || (k - 1) END AS unique_id FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS k FROM part)",
    "elide_outermost": "WITH r AS (SELECT l_orderkey AS file, CAST(l_linenumber * 7 AS INT) AS s, CAST(l_linenumber * 7 + trunc(l_quantity) AS INT) AS e FROM lineitem), w AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE s < e) SELECT file, s AS start, e AS \"end\" FROM w WHERE reach IS NULL OR s >= reach",
    "suffix_histogram": f"WITH {PATHS}, n AS (SELECT {PARENT.format('path')} AS dir, {NAME.format('path')} AS name FROM paths) SELECT dir, {SUFFIX.format('name')} AS suffix, count(*) AS n FROM n GROUP BY ALL",
    "dir_templates": "WITH f AS (SELECT p_brand || '/' || regexp_replace(p_type, '[^A-Za-z]+', '-', 'g') AS dir, 'x.' || p_size % 6 || '.ts' AS name FROM part), h AS (SELECT dir, regexp_extract(dir, '^[^/]*') AS parent, '.' || regexp_extract(name, '^x\\.(.*)$', 1) AS suffix FROM f), c AS (SELECT parent, count(DISTINCT dir) AS module_count FROM h GROUP BY parent), k AS (SELECT h.parent, h.suffix, count(DISTINCT h.dir) AS n FROM h GROUP BY ALL), t AS (SELECT k.parent AS dir, c.module_count, string_agg(k.suffix, ',' ORDER BY k.suffix) AS template, count(*) AS n FROM k JOIN c ON c.parent = k.parent WHERE k.n >= ceil(c.module_count / 2.0) AND c.module_count >= 2 GROUP BY ALL) SELECT dir, module_count, template FROM t WHERE n >= 2",
    "fingerprint_diff": "WITH old AS (SELECT 'c' || c_custkey AS path, md5(c_name || c_mktsegment) AS hash FROM customer WHERE c_custkey % 10 <> 1), new AS (SELECT 'c' || c_custkey AS path, md5(CASE WHEN c_custkey % 10 = 2 THEN upper(c_name) || '!' ELSE c_name END || c_mktsegment) AS hash FROM customer WHERE c_custkey % 10 <> 3) SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'missing' ELSE 'changed' END AS state FROM old FULL JOIN new ON old.path = new.path WHERE old.path IS NULL OR new.path IS NULL OR old.hash <> new.hash",
    "multiset_new": "WITH r AS (SELECT 'f' || l_suppkey AS file, l_linenumber AS code, l_shipmode AS message, l_orderkey % 2 AS side, l_orderkey AS ord FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)), b AS (SELECT file, code, message, count(*) AS n FROM r WHERE side = 0 GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY file, code, message ORDER BY ord) AS k FROM r WHERE side = 1) SELECT a.file, a.code, a.message, a.ord FROM a LEFT JOIN b USING (file, code, message) WHERE a.k > coalesce(b.n, 0)",
    "line_receipt": "WITH x AS (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents), y AS (SELECT id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM x), b AS (SELECT id, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM y), a AS (SELECT id, CASE WHEN (pos + id) % 5 = 0 THEN line || ' (edited)' ELSE line END AS line, pos FROM b WHERE (pos + id) % 7 <> 0), bn AS (SELECT *, row_number() OVER (PARTITION BY id, line ORDER BY pos) AS k FROM b), an AS (SELECT *, row_number() OVER (PARTITION BY id, line ORDER BY pos) AS k FROM a), d AS (SELECT bn.id, '-' AS sign, bn.pos, bn.line FROM bn LEFT JOIN an USING (id, line, k) WHERE an.id IS NULL UNION ALL SELECT an.id, '+', an.pos, an.line FROM an LEFT JOIN bn USING (id, line, k) WHERE bn.id IS NULL), n AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY sign DESC, pos) AS k, sign, rtrim(line, ' ') AS line FROM d) SELECT id, k, sign, CASE WHEN length(line) > 120 THEN line[1:120] || '…' ELSE line END AS line FROM n WHERE k <= 6",
    "diag_anchor": "WITH ops AS (SELECT l_orderkey AS file, l_linenumber AS idx, l_linenumber * 2 AS s, l_linenumber * 2 + CAST(trunc(l_quantity) AS INT) AS e FROM lineitem), d AS (SELECT o_orderkey AS file, CAST(o_orderkey % 30 AS INT) AS line FROM orders) SELECT d.file, d.line, arg_max(ops.idx, ops.s) AS op_index FROM d LEFT JOIN ops ON ops.file = d.file AND ops.s <= d.line AND d.line <= ops.e GROUP BY ALL",
    "edit_order": "WITH o AS (SELECT l_orderkey AS batch, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, l_returnflag <> 'R' AS st, 'f' || l_suppkey % 3 AS file, CAST(trunc(l_quantity) AS INT) AS start_line FROM lineitem), g AS (SELECT *, sum(CASE WHEN st AND coalesce(pst, false) THEN 0 ELSE 1 END) OVER (PARTITION BY batch ORDER BY idx) AS run FROM (SELECT *, lag(st) OVER (PARTITION BY batch ORDER BY idx) AS pst FROM o)) SELECT batch, idx, row_number() OVER (PARTITION BY batch ORDER BY run, CASE WHEN st THEN file END NULLS FIRST, CASE WHEN st THEN -start_line END NULLS FIRST, idx) AS position FROM g",
    "unique_occurrence": "SELECT doc_id, CAST((length(coalesce(text, '')) - length(replace(coalesce(text, ''), needle, ''))) // length(needle) AS BIGINT) AS n FROM (SELECT doc_id, text, split_part(coalesce(text, ''), ' ', 1) || ' ' AS needle FROM documents)",
    "eval_mrr": f"WITH {RANKED_DOCS}, rel AS (SELECT q.query_id, d.id FROM q JOIN docs d ON contains(d.text, q.text)), cases AS (SELECT r.query_id, min(bm.rank) AS rank FROM rel r LEFT JOIN bm ON bm.query_id = r.query_id AND bm.id = r.id GROUP BY r.query_id) SELECT count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM cases",
    "hits_by_language": f"WITH {DOCS}, {Q}, english AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents WHERE lang = 'en'), {bm25('docs', 'q', 5, 'multi')}, {bm25('english', 'q', 5, 'single')}, rel AS (SELECT q.query_id, d.doc_id AS id, d.lang FROM q JOIN documents d ON contains(coalesce(d.text, ''), q.text)), ranked AS (SELECT 'multi' AS arm, query_id, id FROM multi UNION ALL SELECT 'single', query_id, id FROM single), cases AS (SELECT DISTINCT r.lang, r.query_id, a.arm FROM rel r, (VALUES ('multi'), ('single')) a(arm)), hit AS (SELECT DISTINCT r.lang, k.arm, r.query_id FROM rel r JOIN ranked k ON k.query_id = r.query_id AND k.id = r.id) SELECT c.lang, c.arm, count(h.arm) AS hits, count(*) AS n FROM cases c LEFT JOIN hit h ON h.lang = c.lang AND h.arm = c.arm AND h.query_id = c.query_id GROUP BY c.lang, c.arm",
    "jaccard_overlap": f"WITH {vectors(20, 'q.vec_id % 20 = 0')}, a AS (SELECT query_id, id FROM vec), b AS (SELECT e.vec_id AS query_id, o.vec_id AS id FROM embeddings e JOIN embeddings o ON o.label = e.label WHERE e.vec_id % 20 = 0), j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.id IS NOT NULL AND b.id IS NOT NULL AS shared FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id) SELECT query_id, round(avg(CASE WHEN shared THEN 1.0 ELSE 0.0 END), 6) AS jaccard FROM j GROUP BY query_id",
    "bench_medians": "WITH m AS (SELECT event_type AS task, CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'tool' END AS arm, median(value) AS median_value, count(*) AS n FROM events GROUP BY ALL) SELECT m.task, m.arm, round(m.median_value, 6) AS median_value, m.n, round(100 * (m.median_value - b.median_value) / b.median_value, 4) AS percent FROM m JOIN m b ON b.task = m.task AND b.arm = 'baseline'",
    "read_before_edit": "SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn, role) AS sequence, coalesce(min(CASE WHEN role = 'user' THEN turn END) < min(CASE WHEN role = 'assistant' THEN turn END), false) AS asked_first, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS n_answers FROM conversations GROUP BY conv_id",
}
