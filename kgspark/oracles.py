"""DuckDB SQL that gives the same rows as the queries of the same names."""

_NODES = """nodes AS (
    SELECT 'region_' || r_regionkey AS node_id, 'community' AS label, 4 AS level, r_name AS name, 'region' AS schema_type, NULL AS brand, NULL AS ptype, NULL AS segment, NULL AS priority FROM region
    UNION ALL SELECT 'nation_' || n_nationkey, 'entity', 2, n_name, 'nation', NULL, NULL, NULL, NULL FROM nation
    UNION ALL SELECT 'customer_' || c_custkey, 'entity', 2, c_name, 'customer', NULL, NULL, c_mktsegment, NULL FROM customer
    UNION ALL SELECT 'supplier_' || s_suppkey, 'entity', 2, s_name, 'supplier', NULL, NULL, NULL, NULL FROM supplier
    UNION ALL SELECT 'part_' || p_partkey, 'entity', 2, p_name, 'part', p_brand, p_type, NULL, NULL FROM part
    UNION ALL SELECT 'order_' || o_orderkey, 'entity', 2, 'order ' || o_orderkey, NULL, NULL, NULL, NULL, o_orderpriority FROM orders
    UNION ALL SELECT DISTINCT 'segment_' || c_mktsegment, 'attribute', 1, c_mktsegment, NULL, NULL, NULL, NULL, NULL FROM customer
    UNION ALL SELECT DISTINCT 'brand_' || p_brand, 'keyword', 3, p_brand, NULL, NULL, NULL, NULL, NULL FROM part)"""
_K = "* CAST(288230376151711744 AS BIGINT)"
_EDGES = f"""edges AS (
    SELECT 1 {_K} + n_nationkey AS edge_id, 'nation_' || n_nationkey AS src, 'region_' || n_regionkey AS dst, 'part_of' AS relation FROM nation
    UNION ALL SELECT 2 {_K} + c_custkey, 'customer_' || c_custkey, 'nation_' || c_nationkey, 'located_in' FROM customer
    UNION ALL SELECT 3 {_K} + s_suppkey, 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'located_in' FROM supplier
    UNION ALL SELECT 4 {_K} + o_orderkey, 'order_' || o_orderkey, 'customer_' || o_custkey, 'placed_by' FROM orders
    UNION ALL SELECT CAST('0x' || substr(md5(concat_ws('|', 5, l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15) AS BIGINT), 'order_' || l_orderkey, 'part_' || l_partkey, 'contains' FROM lineitem
    UNION ALL SELECT CAST('0x' || substr(md5(concat_ws('|', 6, l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15) AS BIGINT), 'part_' || l_partkey, 'supplier_' || l_suppkey, 'supplied_by' FROM lineitem
    UNION ALL SELECT 7 {_K} + c_custkey, 'customer_' || c_custkey, 'segment_' || c_mktsegment, 'has_attribute' FROM customer
    UNION ALL SELECT 8 {_K} + p_partkey, 'part_' || p_partkey, 'brand_' || p_brand, 'represented_by' FROM part)"""
_BOTH = f"{_NODES}, {_EDGES}"
_SUPPLIES = """supplies AS (
    SELECT CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15) AS BIGINT) AS edge_id, 'supplier_' || l_suppkey AS src, 'part_' || l_partkey AS dst, 'supplies' AS relation, 'order_' || l_orderkey AS chunk FROM lineitem)"""
_VEC = "v AS (SELECT vec_id, 'vec_' || vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"


def _norm(x: str) -> str:
    return f"translate(regexp_replace(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), '\\s+', ' ', 'g'), '.,!?:;\"''()[]{{}}', '')"


_HEADS = f"""heads AS (
    SELECT 'part_' || p_partkey AS dup, 'part_' || min(p_partkey) OVER (PARTITION BY {_norm('p_name')}) AS canon FROM part),
mapping AS (SELECT dup, canon FROM heads WHERE dup <> canon)"""
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) > 2))"
_REWRITE = """e AS (
    SELECT edges.*, coalesce(ms.canon, src) AS s2, coalesce(md.canon, dst) AS d2
    FROM edges LEFT JOIN mapping ms ON src = ms.dup LEFT JOIN mapping md ON dst = md.dup),
kept AS (SELECT *, s2 <> src OR d2 <> dst AS changed FROM e WHERE (s2 = src AND d2 = dst) OR s2 <> d2 OR src = dst),
same AS (SELECT edge_id, s2 AS src, relation, d2 AS dst FROM kept WHERE NOT changed),
moved AS (SELECT min(edge_id) AS edge_id, s2 AS src, relation, d2 AS dst FROM kept WHERE changed GROUP BY ALL),
rewritten AS (
    SELECT * FROM same UNION ALL
    SELECT m.* FROM moved m WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.src = m.src AND s.dst = m.dst AND s.relation = m.relation))"""
_SIMILAR = f"""{_VEC}, pairs AS (
    SELECT a.node_id AS a, b.node_id AS b, list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec))) AS sim
    FROM v a, v b WHERE a.node_id < b.node_id)"""


def _topk(where: str, k: int) -> str:
    return f"""WITH {_VEC}, scored AS (
        SELECT q.vec_id AS qid, i.vec_id AS id, list_inner_product(q.vec, i.vec) AS s FROM v q, v i WHERE q.vec_id % 100 = 0 AND {where}),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS INTEGER) AS rank FROM scored)
        SELECT qid, id, rank, round(s, 6) AS score FROM ranked WHERE rank <= {k}"""


ORACLES: dict[str, str] = {
    "src1_node_table": f"WITH {_NODES} SELECT node_id, label, level, name, schema_type FROM nodes",
    "snk1_triples": f"""WITH {_BOTH} SELECT edge_id, s.label AS start_label, s.name AS start_name, relation, t.label AS end_label, t.name AS end_name
        FROM edges JOIN nodes s ON src = s.node_id JOIN nodes t ON dst = t.node_id""",
    "prj1_chunks": "SELECT substr(sha256(trim(text, ' ')), 1, 8) || '_' || doc_id || '_0' AS chunk_id, doc_id, 0 AS pos, length(text) AS chars FROM documents",
    "prj1_split_chunks": """WITH s AS (SELECT doc_id, text, unnest(generate_series(1, greatest(1, length(text) - 200), 800)) AS a FROM documents)
        SELECT doc_id, CAST((a - 1) // 800 AS INTEGER) AS pos, length(substr(text, a, 1000)) AS chars, sha256(substr(text, a, 1000)) AS sha FROM s""",
    "prj3_valid_triples": """WITH t AS (SELECT event_id, list_concat(list_concat(string_split(event_type, '_'), [CAST(user_id AS VARCHAR), 'x']), list_transform(range(event_id % 3), lambda i: 'y')) AS a FROM events)
        SELECT event_id, array_to_string(a[1:3], ',') AS triple FROM t WHERE len(a) >= 3""",
    "prj14_index_text": f"WITH {_NODES} SELECT node_id, coalesce(nullif(name, ''), 'none') || ',none' AS text FROM nodes",
    "prj16_describe_node": f"""WITH {_NODES} SELECT node_id, name || CASE
        WHEN schema_type = 'part' THEN ' (brand: ' || brand || ', type: ' || ptype || ')'
        WHEN segment IS NOT NULL THEN ' (segment: ' || segment || ')' WHEN priority IS NOT NULL THEN ' (priority: ' || priority || ')' ELSE '' END || ' [' || label || ']' AS description FROM nodes""",
    "prj23_community_text": """WITH m AS (SELECT 'region_' || n_regionkey AS community, list_sort(list(n_name)) AS a FROM nation GROUP BY ALL)
        SELECT community, array_to_string(a[1:3], ', ') || CASE WHEN len(a) > 3 THEN ' and ' || (len(a) - 3) || ' more' ELSE '' END AS text FROM m""",
    "flt2_type_filter": f"WITH {_NODES} SELECT node_id, schema_type FROM nodes WHERE schema_type IN ('part', 'nation') OR (schema_type IS NULL AND label = 'entity')",
    "flt8_main_entities": f"WITH {_NODES} SELECT schema_type, count(*) AS n FROM nodes WHERE label = 'entity' GROUP BY 1",
    "join1_edge_ends": f"""WITH {_BOTH} SELECT relation, s.label AS src_label, t.label AS dst_label, count(*) AS n, min(s.name) AS first_src, max(t.name) AS last_dst
        FROM edges JOIN nodes s ON src = s.node_id JOIN nodes t ON dst = t.node_id GROUP BY 1, 2, 3""",
    "join2_chunk_fetch": "SELECT doc_id AS chunk_id, quality, length(text) AS chars FROM labels JOIN documents USING (doc_id)",
    "join3_missing_content": """SELECT c.conv_id AS chunk_id, coalesce(text, '[Missing content for chunk ' || c.conv_id || ']') AS text
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN documents d ON c.conv_id = d.doc_id""",
    "join4_relation_match": f"""WITH {_BOTH} SELECT edge_id, src, relation, dst FROM edges WHERE relation IN ('located_in', 'placed_by')
        AND (src IN (SELECT node_id FROM nodes WHERE segment = 'BUILDING') OR dst IN (SELECT node_id FROM nodes WHERE segment = 'BUILDING'))""",
    "join5_one_hop": f"WITH {_EDGES} SELECT edge_id, src, relation, dst FROM edges WHERE src LIKE 'nation%' OR dst LIKE 'nation%' ORDER BY edge_id LIMIT 20",
    "join6_neighbors": f"""WITH {_EDGES}, pairs AS (SELECT DISTINCT src AS start, dst AS other FROM edges WHERE src LIKE 'supplier%'),
        first AS (SELECT src, dst, arg_min(relation, edge_id) AS relation FROM edges GROUP BY 1, 2)
        SELECT start, src, relation, dst FROM pairs JOIN first ON (src = start AND dst = other) OR (src = other AND dst = start)""",
    "join7_sim_pairs": f"WITH {_SIMILAR} SELECT a, b, round(sim, 6) AS sim FROM pairs WHERE sim >= 0.30",
    "join8_identifier": f"""WITH {_NODES}, n AS (SELECT node_id, name || ' (chunk id: c1) [entity]' AS identifier FROM nodes WHERE label = 'entity')
        SELECT identifier, min(node_id) AS node_id FROM n GROUP BY 1""",
    "join9_cache_check": """WITH c AS (SELECT DISTINCT o_custkey AS id FROM orders), n AS (SELECT DISTINCT c_custkey AS id FROM customer),
        s AS (SELECT (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM c)) AS missing, (SELECT count(*) FROM c WHERE id NOT IN (SELECT id FROM n)) AS extra, (SELECT count(*) FROM n) AS current)
        SELECT *, missing > 0 OR extra > 0.1 * current AS stale FROM s""",
    "join14_comm_members": f"""WITH {_NODES}, named AS (SELECT name, max(node_id) AS node_id FROM nodes GROUP BY 1)
        SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS community, node_id FROM nation JOIN named ON n_name = name""",
    "join16_keyword_links": """WITH k AS (SELECT DISTINCT p_brand AS keyword, lower(right(p_brand, 2)) AS a FROM part), c AS (SELECT 's' || s_suppkey AS community, lower(s_name) AS b FROM supplier)
        SELECT keyword, community FROM k, c WHERE contains(b, a) OR contains(a, b)""",
    "join17_last_source": f"WITH {_SUPPLIES} SELECT dst, arg_max(src, edge_id) AS src FROM supplies GROUP BY 1",
    "join20_edge_exists": f"""WITH {_SUPPLIES}, p AS (SELECT 'supplier_' || (p_partkey % 50 + 1) AS src, 'part_' || p_partkey AS dst, CASE WHEN p_partkey % 2 = 0 THEN 'supplies' END AS relation FROM part)
        SELECT src, dst, relation FROM p WHERE EXISTS (SELECT 1 FROM supplies s WHERE s.src = p.src AND s.dst = p.dst AND (p.relation IS NULL OR p.relation = s.relation))""",
    "agg1_head_relation": f"WITH {_EDGES} SELECT src, relation, count(*) AS n, arg_min(dst, edge_id) AS first_tail, arg_max(dst, edge_id) AS last_tail FROM edges GROUP BY 1, 2",
    "agg3_exact_heads": f"""WITH n AS (SELECT p_partkey, {_norm('p_name')} AS norm FROM part)
        SELECT 'part_' || p_partkey AS node_id, norm, min(p_partkey) OVER w AS canonical, count(*) OVER w AS size FROM n WINDOW w AS (PARTITION BY norm)""",
    "agg4_degree": f"""WITH {_EDGES}, ends AS (SELECT src AS node_id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges)
        SELECT node_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM ends GROUP BY 1""",
    "agg5_token_count": r"SELECT source, CAST(sum(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS BIGINT) AS tokens FROM documents GROUP BY 1",
    "agg11_label_relation_top10": f"""WITH {_BOTH}, r AS (SELECT 'relation' AS kind, relation AS name, count(*) AS n FROM edges GROUP BY 2 ORDER BY n DESC, name LIMIT 10)
        SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT * FROM r""",
    "agg12_cluster_profile": f"""WITH g AS (SELECT count(*) AS size FROM part GROUP BY {_norm('p_name')}),
        c AS (SELECT count(*) AS clusters, CAST(sum(size) AS BIGINT) AS candidates, CAST(sum(size - 1) AS BIGINT) AS merged, count(*) FILTER (WHERE size = 1) AS single, max(size) AS max_size, min(size) AS min_size, avg(size) AS a, quantile_cont(size, 0.5) AS m FROM g)
        SELECT clusters, candidates, merged, single, max_size, min_size, round(a, 6) AS mean_size, round(CAST(m AS DOUBLE), 6) AS median_size, round(merged / candidates, 6) AS dedup_rate, round(single / clusters, 6) AS single_share,
            concat_ws('; ', CASE WHEN single / clusters > 0.7 THEN 'mostly single' END, CASE WHEN merged / candidates < 0.05 THEN 'merges little' END, CASE WHEN merged / candidates > 0.5 THEN 'merges much' END) AS notes FROM c""",
    "agg14_merge_frequency": f"WITH {_HEADS} SELECT node_id, count(*) AS n FROM (SELECT dup AS node_id FROM mapping UNION ALL SELECT canon FROM mapping) GROUP BY 1",
    "agg16_accuracy": "SELECT count(*) AS n, round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels",
    "agg19_edge_chunks": f"WITH {_SUPPLIES}, d AS (SELECT DISTINCT src, dst, chunk FROM supplies) SELECT src, dst, count(*) AS n_chunks, string_agg(chunk, ',' ORDER BY chunk) AS chunks FROM d GROUP BY 1, 2",
    "agg20_contexts": r"""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
        c AS (SELECT doc_id, regexp_replace(trim(text, ' '), '\s+', ' ', 'g') AS x FROM documents)
        SELECT conv_id AS item, string_agg('- ' || CASE WHEN x IS NULL THEN '[Missing content for chunk ' || turn || ']' WHEN length(x) > 5000 THEN substr(x, 1, 5000) || '…' ELSE x END, chr(10) ORDER BY turn) AS context
        FROM t LEFT JOIN c ON turn = doc_id WHERE rn <= 10 GROUP BY 1""",
    "win1_first_seen": f"WITH {_SUPPLIES} SELECT min(edge_id) AS edge_id, src, dst FROM supplies GROUP BY src, dst, relation",
    "win2_batches": """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)
        SELECT p_brand, p_partkey, CAST(n // 30 AS INTEGER) AS batch, CAST(n % 30 + 1 AS INTEGER) AS local FROM r""",
    "win3_overflow": """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)
        SELECT p_brand, p_partkey, n >= 50 AS is_overflow, CAST(CASE WHEN n >= 50 THEN 0 ELSE n // 8 END AS INTEGER) AS batch FROM r""",
    "win4_top_keywords": f"""WITH {_VEC}, pos AS (SELECT label, unnest(generate_series(1, 64)) AS p, vec FROM v), mp AS (SELECT label, p, avg(vec[p]) AS x FROM pos GROUP BY 1, 2),
        mean AS (SELECT label, list(x ORDER BY p) AS m FROM mp GROUP BY 1),
        deg AS (SELECT node_id, count(*) AS d FROM (SELECT node_id FROM v UNION ALL SELECT 'vec_' || (vec_id % 7) FROM v) GROUP BY 1),
        s AS (SELECT v.label AS community, v.node_id, 0.3 * d / max(d) OVER (PARTITION BY v.label) + 0.7 * list_inner_product(vec, m) / (sqrt(list_inner_product(vec, vec)) * sqrt(list_inner_product(m, m))) AS score
            FROM v JOIN mean ON v.label = mean.label JOIN deg ON v.node_id = deg.node_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY community ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM s)
        SELECT community, node_id, rank FROM r WHERE rank <= 5""",
    "win5_norm_degree": f"""WITH {_BOTH}, ends AS (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT node_id, count(*) AS n FROM ends GROUP BY 1)
        SELECT node_id, round(n / max(n) OVER (PARTITION BY label), 6) AS share FROM d JOIN nodes USING (node_id)""",
    "win7_best_rep": f"""WITH {_SUPPLIES}, {_HEADS}, deg AS (SELECT dst AS node_id, count(*) AS i FROM supplies GROUP BY 1),
        members AS (SELECT canon AS grp, dup AS node_id FROM mapping UNION SELECT canon, canon FROM mapping),
        s AS (SELECT grp, node_id, 50 * coalesce(i, 0) + 10 * length(p_name) - 0.1 * p_partkey AS score FROM members JOIN part ON node_id = 'part_' || p_partkey LEFT JOIN deg USING (node_id)),
        best AS (SELECT grp, first(node_id ORDER BY score DESC, node_id DESC) AS canon FROM s GROUP BY 1)
        SELECT node_id AS dup, canon FROM s JOIN best USING (grp) WHERE node_id <> canon""",
    "top1_keyword_rerank": r"""WITH q AS (SELECT DISTINCT item_id AS qid, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM benchmark),
        d AS (SELECT doc_id AS pos, lower(text) AS low FROM documents), words AS (SELECT DISTINCT w FROM q),
        hit AS (SELECT pos, w FROM d, words WHERE contains(low, w)),
        s AS (SELECT qid, pos, count(*) AS score FROM q JOIN hit USING (w) GROUP BY 1, 2),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS INTEGER) AS rank FROM s) SELECT qid, pos, score, rank FROM r WHERE rank <= 5""",
    "set1_distinct_triples": f"WITH {_EDGES} SELECT relation, count(*) AS n FROM (SELECT DISTINCT src, relation, dst FROM edges) GROUP BY 1",
    "set2_ordered_distinct": f"WITH {_SUPPLIES} SELECT src, relation, dst, min(edge_id) AS pos FROM supplies GROUP BY 1, 2, 3",
    "set4_exact_attrs": f"WITH {_SUPPLIES} SELECT min(edge_id) AS edge_id, src, dst FROM supplies GROUP BY src, relation, dst",
    "set5_chunk_union": "SELECT doc_id FROM labels UNION SELECT conv_id FROM conversations",
    "set10_difference": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "set11_relations": f"WITH {_EDGES} SELECT DISTINCT relation FROM edges",
    "str1_normalize": "SELECT p_partkey, " + _norm("'  ' || p_name || ' (' || p_brand || ').  X'") + " AS norm FROM part",
    "str2_identifier_parse": f"WITH {_NODES} SELECT node_id, name, 'c9' AS chunk_id, label, true AS exact FROM nodes WHERE label = 'entity'",
    "str9_tokens": f"SELECT doc_id, len({_WORDS}) AS n_tokens FROM documents",
    "str10_snippet": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM documents",
    "str12_id_number": f"WITH {_NODES} SELECT node_id, CAST(split_part(node_id, '_', 2) AS BIGINT) AS number FROM nodes WHERE label = 'entity'",
    "jsn9_canonical": """SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '","type":"' || p_type || '"}' AS json FROM part""",
    "hsh1_cache_key": "SELECT source, substr(sha256(string_agg(md5(text), ',' ORDER BY md5(text))), 1, 16) AS key FROM documents GROUP BY 1",
    "vec13_topk": _topk("true", 10),
    "vec19_filtered_topk": _topk("i.label IN (1, 2)", 5),
    "vec20_cosine": f"""WITH {_VEC} SELECT q.vec_id AS qid, i.vec_id, round(greatest(0.0, list_inner_product(q.vec, i.vec) / (sqrt(list_inner_product(q.vec, q.vec)) * sqrt(list_inner_product(i.vec, i.vec)))), 6) AS sim
        FROM v q, v i WHERE q.vec_id % 100 = 0""",
    "vec27_centroid": f"WITH {_VEC}, p AS (SELECT label, unnest(generate_series(1, 64)) AS i, vec FROM v) SELECT label, i - 1 AS pos, round(avg(vec[i]), 6) AS x FROM p GROUP BY 1, 2",
    "grf1_neighbors": f"WITH {_EDGES} SELECT DISTINCT src, dst FROM edges",
    "grf2_3hop": f"""WITH RECURSIVE {_EDGES}, arcs AS (SELECT DISTINCT src, dst FROM edges), reach AS (
            SELECT node AS start, node AS node_id, 0 AS depth FROM (SELECT 'customer_' || c_custkey AS node FROM customer UNION ALL SELECT 'supplier_' || s_suppkey FROM supplier)
            UNION SELECT start, dst, depth + 1 FROM reach JOIN arcs ON src = node_id WHERE depth < 3)
        SELECT start, node_id, min(depth) AS depth FROM reach GROUP BY 1, 2""",
    "grf5_paths": f"""WITH {_BOTH}, first AS (SELECT src, dst, arg_min(relation, edge_id) AS relation FROM edges GROUP BY 1, 2),
        hit AS (SELECT node_id FROM nodes WHERE contains(lower(name), 'asia') OR contains(lower(name), 'europe')),
        one AS (SELECT * FROM first WHERE src LIKE 'customer%'), two AS (SELECT a.src AS s0, a.relation AS r0, b.src AS s1, b.relation AS r1, b.dst AS d1 FROM one a JOIN first b ON a.dst = b.src WHERE b.dst <> a.src AND b.dst IN (SELECT node_id FROM hit))
        SELECT src, relation, dst FROM one WHERE dst IN (SELECT node_id FROM hit) UNION SELECT s0, r0, s1 FROM two UNION SELECT s1, r1, d1 FROM two""",
    "grf6_components": f"""WITH RECURSIVE {_SIMILAR}, arcs AS (SELECT a, b FROM pairs WHERE sim >= 0.30 UNION SELECT b, a FROM pairs WHERE sim >= 0.30),
        reach AS (SELECT a AS node, a AS other FROM arcs UNION SELECT node, b FROM reach JOIN arcs ON other = a)
        SELECT node, min(other) AS component FROM reach GROUP BY 1""",
    "grf8_chain": "SELECT p_partkey AS dup, max(p_partkey) OVER (PARTITION BY p_name) AS canon FROM part QUALIFY dup <> canon",
    "grf13_jaccard": """SELECT 'supplier_' || least_.k AS a, 'supplier_' || other.k AS b, round(1 / (1 + 1e-9), 6) AS jaccard
        FROM (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) least_ JOIN (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) other ON least_.n = other.n AND 'supplier_' || least_.k < 'supplier_' || other.k""",
    "grf15_triple_strings": f"""WITH {_BOTH}, first AS (SELECT src, dst, arg_min(relation, edge_id) AS relation FROM edges GROUP BY 1, 2),
        t AS (SELECT DISTINCT src AS node_id, a.name || ' ' || relation || ' ' || b.name AS triple FROM first JOIN nodes a ON src = a.node_id JOIN nodes b ON dst = b.node_id)
        SELECT node_id, count(*) AS n, min(triple) AS first FROM t GROUP BY 1""",
    "grf17_integrity": f"""WITH {_BOTH}, n AS (SELECT * FROM nodes WHERE label <> 'keyword'), e AS (SELECT * FROM edges WHERE relation NOT IN ('contains', 'placed_by')),
        i AS (SELECT 'orphans' AS issue, node_id AS id FROM n WHERE node_id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)
            UNION SELECT 'dangling_edges', CAST(edge_id AS VARCHAR) FROM e WHERE src NOT IN (SELECT node_id FROM n) OR dst NOT IN (SELECT node_id FROM n))
        SELECT issue, count(*) AS n FROM i GROUP BY 1""",
    "grf20_isolated": f"""WITH {_BOTH}, e AS (SELECT * FROM edges WHERE relation IN ('placed_by', 'supplied_by'))
        SELECT label, count(*) AS n FROM nodes WHERE node_id IN (SELECT src FROM e UNION SELECT dst FROM e) GROUP BY 1""",
    "ded7_final_edges": f"""WITH {_SUPPLIES}, f AS (SELECT min(edge_id) AS edge_id, src, dst, relation, arg_min(chunk, edge_id) AS chunk FROM supplies GROUP BY src, dst, relation),
        k AS (SELECT 'part_' || p_partkey AS dst, p_partkey AS num, {_norm('p_name')} AS norm FROM part),
        e AS (SELECT f.*, num, norm FROM f JOIN k USING (dst))
        SELECT min(edge_id) AS edge_id, src, arg_min(dst, num) AS dst, count(*) - 1 AS n_merged, count(DISTINCT chunk) AS n_chunks FROM e GROUP BY src, norm""",
    "ded16_exact_heads": f"WITH {_HEADS} SELECT dup, canon FROM mapping",
    "ded18_reassign": f"WITH {_EDGES}, {_HEADS}, {_REWRITE} SELECT edge_id, src, relation, dst FROM rewritten",
    "ded36_apply": f"""WITH {_EDGES}, {_HEADS}, {_REWRITE}, alias AS (
            SELECT canon AS src, '等同于' AS relation, dup AS dst FROM mapping WHERE dup IN (SELECT src FROM edges UNION SELECT dst FROM edges)),
        a AS (SELECT src, relation, dst FROM rewritten UNION ALL SELECT * FROM alias)
        SELECT relation, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM a GROUP BY 1""",
    "ded24_alias_merge": f"""WITH {_NODES}, {_HEADS} SELECT label, CASE WHEN node_id IN (SELECT dup FROM mapping) THEN 'alias' WHEN node_id IN (SELECT canon FROM mapping) THEN 'representative' ELSE 'none' END AS role, count(*) AS n
        FROM nodes GROUP BY 1, 2""",
    "viz1_graph": f"""WITH {_BOTH}, a AS (SELECT src AS node_id, count(*) AS n FROM edges WHERE relation = 'has_attribute' GROUP BY 1),
        f AS (SELECT name, arg_min(coalesce(schema_type, label), node_id) AS category, arg_min(coalesce(n, 0), node_id) AS n FROM nodes LEFT JOIN a USING (node_id) GROUP BY 1)
        SELECT name, category, least(40, greatest(15, n * 3 + 15)) AS size FROM f ORDER BY name LIMIT 500""",
    "ret18_inverted_index": f"WITH t AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents) SELECT word, count(*) AS n, min(doc_id) AS first FROM t GROUP BY 1",
    "ret13_keyword_search": f"""WITH q AS (SELECT item_id AS qid, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM (SELECT item_id, list_sort({_WORDS}) AS w FROM benchmark)),
        t AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents), p AS (SELECT word, doc_id FROM t QUALIFY row_number() OVER (PARTITION BY word ORDER BY doc_id) <= 50),
        hit AS (SELECT qid, doc_id, min(pos) AS pos FROM q JOIN p USING (word) GROUP BY 1, 2), per AS (SELECT qid, pos, count(*) AS n FROM hit GROUP BY 1, 2),
        b AS (SELECT qid, pos, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per)
        SELECT qid, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM hit JOIN b USING (qid, pos) WHERE before <= 200 GROUP BY 1""",
    "ret12_community_path": f"""WITH {_VEC}, p AS (SELECT label, unnest(generate_series(1, 64)) AS j, vec FROM v), c AS (SELECT label, j, avg(vec[j]) AS x FROM p GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY j) AS vec FROM c GROUP BY 1),
        r AS (SELECT q.vec_id AS qid, m.label, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.vec, m.vec) DESC, m.label) AS INTEGER) AS rank FROM v q, m WHERE q.vec_id % 100 = 0)
        SELECT qid, node_id, rank FROM r JOIN v USING (label) WHERE rank <= 2""",
    "ret1_batch_retrieval": f"""WITH {_VEC}, scored AS (SELECT q.vec_id AS qid, i.vec_id AS vid, i.node_id AS id, i.label, list_inner_product(q.vec, i.vec) AS s FROM v q, v i WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS INTEGER) AS rank FROM scored WHERE s > 0.05)
        SELECT qid, rank, id, 'in_class' AS relation, 'class_' || r.label AS dst, coalesce(length(text), 0) AS chars FROM r LEFT JOIN documents ON doc_id = vid WHERE rank <= 20""",
    "agt4_agent_loop": "SELECT CAST(n_nationkey AS BIGINT) AS qid, 'In which region is ' || n_name || '?' AS question, r_name AS answer, 2 AS steps FROM nation JOIN region ON n_regionkey = r_regionkey",
}
