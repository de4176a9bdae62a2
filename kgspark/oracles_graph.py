"""DuckDB SQL for the queries of queries_graph."""

from kgspark.oracles import _BOTH, _EDGES, _HEADS, _NODES, _REWRITE, _SUPPLIES, _VEC, _norm

_CHAIN = """chain AS (SELECT * FROM (SELECT p_name, p_partkey AS k, 'part_' || p_partkey AS dup, lead(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS nk FROM part) WHERE nk IS NOT NULL)"""
_ARCS = """arcs AS (SELECT vec_id * 10 + k AS edge_id, 'vec_' || vec_id AS src, 'vec_' || ((vec_id * k + 1) % (SELECT count(*) FROM embeddings)) AS dst, 'r' || (k % 3) AS relation FROM embeddings, (SELECT unnest(generate_series(2, 9)) AS k))"""
_COS = "list_inner_product(q.vec, i.vec) / (sqrt(list_inner_product(q.vec, q.vec)) * sqrt(list_inner_product(i.vec, i.vec)))"
_Q = "q AS (SELECT vec_id AS qid, vec FROM v WHERE vec_id % 100 = 0)"
_MEMBERS = """r AS (SELECT p_brand AS grp, p_partkey AS pos, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part),
    b AS (SELECT *, i // 8 AS batch, i % 8 + 1 AS l, count(*) OVER (PARTITION BY grp, i // 8) AS n FROM r),
    c AS (SELECT grp, pos, batch, n, CAST(batch * 8 + CASE WHEN l % 2 = 1 THEN 0 ELSE l // 2 END AS INTEGER) AS first,
        CAST(batch * 8 + CASE WHEN n < 4 THEN (CASE WHEN l % 2 = 1 THEN 0 ELSE l // 2 END) WHEN l <= 2 THEN 0 ELSE l - 2 END AS INTEGER) AS cluster FROM b)"""


def _ranked(scored: str, key: str, tie: str, k: int, more: str = "") -> str:
    return f"""{scored} ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY s DESC, {tie}) AS INTEGER) AS rank FROM scored)
        SELECT * EXCLUDE (s), round(s, 5) AS score FROM ranked WHERE rank <= {k} {more}"""


ORACLES: dict[str, str] = {
    "grf3_neighbour_triples": """WITH e AS (SELECT 1 * CAST(288230376151711744 AS BIGINT) + n_nationkey AS edge_id, n_nationkey AS n FROM nation
            UNION ALL SELECT 2 * CAST(288230376151711744 AS BIGINT) + c_custkey, c_nationkey FROM customer UNION ALL SELECT 3 * CAST(288230376151711744 AS BIGINT) + s_suppkey, s_nationkey FROM supplier),
        own AS (SELECT n, count(*) AS n_own, min(edge_id) AS first FROM e GROUP BY 1),
        region AS (SELECT n_regionkey, count(*) AS members, min(n_nationkey) AS least FROM nation GROUP BY 1)
        SELECT 'nation_' || n_nationkey AS start, n_own + members - 1 AS n, 1 * CAST(288230376151711744 AS BIGINT) + least AS first FROM nation JOIN own ON n = n_nationkey JOIN region USING (n_regionkey)""",
    "grf10_combined_mappings": f"""WITH RECURSIVE {_CHAIN}, heads AS (SELECT p_partkey AS k, {_norm('p_name')} AS norm, min(p_partkey) OVER (PARTITION BY {_norm('p_name')}) AS least FROM part),
        m AS (SELECT k, nk AS t FROM chain WHERE k % 2 = 0 UNION ALL SELECT k, least FROM heads WHERE k <> least AND k NOT IN (SELECT k FROM chain WHERE k % 2 = 0)),
        walk AS (SELECT k, t, 0 AS step FROM m UNION ALL SELECT walk.k, m.t, step + 1 FROM walk JOIN m ON walk.t = m.k WHERE step < 60),
        cyc AS (SELECT DISTINCT k FROM walk WHERE step = 60), fin AS (SELECT k, arg_max(t, step) AS t FROM walk WHERE k NOT IN (SELECT k FROM cyc) GROUP BY 1),
        ring AS (SELECT DISTINCT k, t FROM walk WHERE k IN (SELECT k FROM cyc) AND step >= 10), best AS (SELECT k, max('part_' || t) AS canon FROM ring GROUP BY 1)
        SELECT 'part_' || k AS dup, 'part_' || t AS canon FROM fin WHERE k <> t UNION ALL SELECT 'part_' || k, canon FROM best WHERE 'part_' || k <> canon""",
    "grf11_frequent_roots": """WITH m AS (SELECT p_name, 'part_' || p_partkey AS node, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_name) AS n FROM part),
        root AS (SELECT p_name, CASE WHEN max(n) = 2 THEN max(node) FILTER (WHERE i = 2) ELSE min(node) FILTER (WHERE i > 1 AND i < n) END AS canon FROM m WHERE n > 1 GROUP BY 1)
        SELECT node AS dup, canon FROM m JOIN root USING (p_name) WHERE node <> canon""",
    "grf12_paths_to_root": """SELECT 'part_' || p_partkey AS dup, 'part_' || max(p_partkey) OVER w AS root, count(*) OVER w - row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS steps, false AS cyclic FROM part
        WINDOW w AS (PARTITION BY p_name) QUALIFY p_partkey <> max(p_partkey) OVER w""",
    "grf16_triple_texts": """WITH t AS (SELECT 'nation_' || n_nationkey AS node_id, n_name || ' part_of ' || r_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey
            UNION SELECT 'customer_' || c_custkey, c_name || ' located_in ' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'supplier_' || s_suppkey, s_name || ' located_in ' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT node_id, string_agg(x, '; ' ORDER BY x) AS text FROM t GROUP BY 1""",
    "grf18_alias_integrity": """WITH p AS (SELECT p_partkey AS k FROM part), a AS (SELECT k FROM p WHERE k % 2 = 0), e AS (SELECT k AS s, k - 1 AS t FROM a WHERE k > 1 UNION ALL SELECT k, k - 2 FROM a WHERE k % 10 = 0 AND k > 1),
        i AS (SELECT 'orphans' AS issue, CAST(k AS VARCHAR) AS id FROM p WHERE k NOT IN (SELECT s FROM e UNION SELECT t FROM e)
            UNION SELECT 'dangling_edges', s || '-' || t FROM e WHERE s NOT IN (SELECT k FROM p) OR t NOT IN (SELECT k FROM p)
            UNION SELECT 'invalid_alias_nodes', CAST(a.k AS VARCHAR) FROM a LEFT JOIN e ON a.k = e.s GROUP BY a.k HAVING count(e.s) <> 1
            UNION SELECT 'alias_chains', CAST(s AS VARCHAR) FROM e WHERE s IN (SELECT k FROM a) AND t IN (SELECT k FROM a))
        SELECT issue, count(*) AS n FROM i GROUP BY 1""",
    "grf19_alias_targets": "SELECT 'part_' || p_partkey AS node_id, CASE WHEN p_partkey % 6 = 0 THEN 'part_' || (p_partkey + 1) ELSE 'part_' || p_partkey END AS main FROM part",
    "grf21_node_context": f"""WITH {_BOTH}, e AS (SELECT * FROM edges WHERE relation IN ('part_of', 'located_in')),
        l AS (SELECT src AS node_id, 0 AS side, row_number() OVER (PARTITION BY src ORDER BY edge_id) AS rn, '-> ' || relation || ' ' || name AS line FROM e JOIN nodes ON dst = node_id
            UNION ALL SELECT dst, 1, row_number() OVER (PARTITION BY dst ORDER BY edge_id), '<- ' || relation || ' ' || name FROM e JOIN nodes ON src = node_id)
        SELECT node_id, string_agg(line, chr(10) ORDER BY side, rn) AS context FROM l WHERE rn <= 3 AND (node_id LIKE 'nation%' OR node_id LIKE 'region%') GROUP BY 1""",
    "grf22_chunk_context": """SELECT 'part_' || p_partkey AS node_id, md5(substr(coalesce(d.text, o.text), 1, 500)) AS context FROM part LEFT JOIN documents d ON d.doc_id = p_partkey JOIN documents o ON o.doc_id = 1""",
    "set3_exact_triples": f"WITH {_EDGES}, f AS (SELECT src, dst, relation, min(edge_id) AS edge_id FROM edges GROUP BY 1, 2, 3) SELECT relation, count(*) AS n, CAST(sum(edge_id % 1000) AS BIGINT) AS ids FROM f GROUP BY 1",
    "agg2_keyword_candidates": """SELECT 'region_' || n_regionkey AS community, 'kw_' || n_nationkey AS keyword, CAST(n_nationkey AS BIGINT) AS pos, lower(n_name) || ' (from ' || n_name || ')' AS description,
        CASE WHEN n_nationkey % 2 = 0 THEN '- about ' || n_name ELSE '- [Missing content for chunk c' || n_nationkey || ']' END AS context FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) > 1)""",
    "ded13_keyword_mapping": """WITH r AS (SELECT vec_id, vec_id % 20 AS c, vec_id % 5 AS g FROM embeddings) SELECT 'vec_' || vec_id AS dup, 'vec_' || min(vec_id) OVER (PARTITION BY c, g) AS canon FROM r QUALIFY dup <> canon""",
    "ded9_interchange": f"""WITH {_SUPPLIES}, e AS (SELECT DISTINCT src, dst FROM supplies), m AS (SELECT src, p_name, count(*) AS n FROM e JOIN part ON dst = 'part_' || p_partkey GROUP BY 1, 2)
        SELECT s_name AS head, count(*) FILTER (WHERE n > 1) AS clusters, CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS members, CAST(count(*) AS INTEGER) AS kept, CAST(sum(n) AS INTEGER) AS tails
        FROM m JOIN supplier ON src = 'supplier_' || s_suppkey GROUP BY 1 HAVING count(*) FILTER (WHERE n > 1) > 0""",
    "win8_last_member": "SELECT n_name AS dup, max(n_name) OVER (PARTITION BY n_regionkey) AS canon FROM nation QUALIFY dup <> canon",
    "agg10_interchange_stats": "WITH r AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) SELECT count(*) AS groups, 2 * count(*) AS clusters, CAST(sum(n) AS BIGINT) AS members, count(DISTINCT n_regionkey % 3) AS relations, count(DISTINCT n_regionkey % 2) AS labels FROM r",
    "ded17_merged_heads": f"""WITH {_EDGES}, {_HEADS}, {_REWRITE} SELECT relation AS what, count(*) AS n FROM rewritten GROUP BY 1
        UNION ALL SELECT 'parts', (SELECT count(*) FROM part) - (SELECT count(*) FROM mapping)""",
    "ded21_judged_pairs": f"""SELECT 'part_' || b.p_partkey AS dup, 'part_' || a.p_partkey AS canon, 'semantic' AS method, 1.0 AS confidence, 'same name' AS rationale
        FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE {_norm('a.p_name')} = {_norm('b.p_name')} AND {_norm('a.p_name')} <> ''""",
    "ded23_alias_conflicts": """SELECT 'nation_' || n_nationkey AS dup, 'nation_' || CASE n_nationkey % 8 WHEN 1 THEN n_nationkey - 1 WHEN 5 THEN n_nationkey - 1 WHEN 2 THEN n_nationkey - 2 WHEN 6 THEN n_nationkey - 2 ELSE n_nationkey - 3 END AS canon,
        CASE WHEN n_nationkey % 4 = 2 OR n_nationkey % 8 = 3 THEN 'graph' ELSE 'cascade' END AS kind FROM nation WHERE n_nationkey % 4 <> 0 AND (n_nationkey % 4 <> 1 OR n_nationkey + 1 IN (SELECT n_nationkey FROM nation))
        UNION ALL SELECT 'nation_' || n_nationkey, 'nation_' || (n_nationkey + 1), 'none' FROM nation WHERE n_nationkey % 4 = 1 AND n_nationkey + 1 NOT IN (SELECT n_nationkey FROM nation)""",
    "ded35_applied_interchange": f"""WITH {_EDGES}, {_HEADS}, {_REWRITE} SELECT relation, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM rewritten GROUP BY 1""",
    "ded39_applied_without_aliases": f"""WITH {_BOTH}, {_HEADS}, {_REWRITE} SELECT label, count(*) AS n FROM nodes WHERE node_id IN (SELECT src FROM rewritten UNION SELECT dst FROM rewritten) GROUP BY 1""",
    "agg6_edge_run_summary": f"""WITH {_SUPPLIES}, f AS (SELECT DISTINCT src, dst FROM supplies), e AS (SELECT src, dst, p_partkey AS k, {_norm('p_name')} AS norm, min(p_partkey) OVER (PARTITION BY src, {_norm('p_name')}) AS keeper FROM f JOIN part ON dst = 'part_' || p_partkey)
        SELECT (SELECT count(*) FROM supplies) AS total, count(DISTINCT src) AS groups, count(DISTINCT CASE WHEN k <> keeper THEN src || '|' || keeper END) AS merges, count(*) FILTER (WHERE k <> keeper) AS merged_edges, count(DISTINCT src || '|' || keeper) AS final FROM e""",
    "clu16_model_clusters": f"WITH {_MEMBERS} SELECT grp, pos, first AS cluster FROM c",
    "clu18_checked_clusters": f"WITH {_MEMBERS} SELECT grp, pos, cluster, n >= 4 AS changed FROM c",
    "ded10_group_flags": f"WITH {_MEMBERS} SELECT grp, count(DISTINCT cluster) AS clusters, NOT bool_or(n >= 4) AS ok FROM c GROUP BY 1",
    "src21_cluster_results": "SELECT CAST(s_nationkey AS VARCHAR) AS grp, s_suppkey AS pos, CAST(dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3) - 1 AS INTEGER) AS cluster FROM supplier",
    "clu9_super_nodes": """WITH m AS (SELECT n_nationkey AS k, n_name, n_regionkey AS c, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation QUALIFY n >= 2),
        w AS (SELECT * FROM m WHERE k % 5 = 0)
        SELECT DISTINCT 'node' AS what, 'comm_' || c AS a, 'Community_' || c AS name, 'Community of ' || n || ' members' AS b FROM m
        UNION ALL SELECT 'node', 'kw_comm_' || c || '_nation_' || k, n_name, '' FROM w
        UNION ALL SELECT 'member_of', 'nation_' || k, '', 'comm_' || c FROM m UNION ALL SELECT 'represented_by', 'nation_' || k, '', 'kw_comm_' || c || '_nation_' || k FROM w
        UNION ALL SELECT 'keyword_of', 'kw_comm_' || c || '_nation_' || k, '', 'comm_' || c FROM w UNION ALL SELECT 'kw_filter_by', 'nation_' || k, '', 'comm_' || c FROM w""",
    "clu11_naming_prompts": """WITH g AS (SELECT n_regionkey AS id, list_sort(list(n_name))[1:3] AS m, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) >= 2)
        SELECT CAST(id // 2 AS BIGINT) AS call_id, '[' || string_agg('{"id":' || id || ',"center":"' || r_name || '","members":["' || array_to_string(m, '","') || '"],"size":' || n || '}', ',' ORDER BY id) || ']' AS prompt FROM g JOIN region ON id = r_regionkey GROUP BY 1""",
    "top2_triple_rerank": _ranked(f"""WITH {_VEC}, {_Q}, {_ARCS}, scored AS (SELECT qid, edge_id, greatest(0.0, {_COS} + CASE WHEN relation = 'r0' THEN 0.1 ELSE 0.0 END) AS s FROM arcs JOIN v i ON dst = i.node_id, q WHERE s > 0.15),""", "qid", "edge_id", 10),
    "top7_chunk_rerank": f"""WITH {_VEC}, {_Q}, h AS (SELECT qid, i.node_id AS chunk_id, list_inner_product(q.vec, i.vec) AS x, {_COS} AS c FROM v i, q QUALIFY row_number() OVER (PARTITION BY qid ORDER BY x DESC, chunk_id) <= 10),
        {_ranked("scored AS (SELECT qid, chunk_id, (x + greatest(0.0, c)) / 2 AS s FROM h),", "qid", "chunk_id", 4)}""",
    "top8_smart_neighbours": f"""WITH {_VEC}, {_Q}, {_ARCS}, st AS (SELECT qid, i.node_id FROM v i, q QUALIFY row_number() OVER (PARTITION BY qid ORDER BY list_inner_product(q.vec, i.vec) DESC, i.node_id) <= 3),
        nb AS (SELECT DISTINCT qid, st.node_id, dst AS neighbour FROM st JOIN arcs ON src = st.node_id),
        {_ranked(f"scored AS (SELECT nb.qid, nb.node_id, neighbour, greatest(0.0, {_COS}) AS s FROM nb JOIN v i ON neighbour = i.node_id JOIN q USING (qid)),", "qid, node_id", "neighbour", 5, "AND s > 0.1")}""",
    "top3_candidate_nodes": f"""WITH {_VEC}, {_Q}, h AS (SELECT qid, i.node_id, list_inner_product(q.vec, i.vec) AS s FROM v i, q QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, i.node_id) <= 4),
        w AS (SELECT qid, i.node_id, greatest(0.0, {_COS}) AS s FROM v i, q WHERE i.vec_id % 50 = 7 AND (qid, i.node_id) NOT IN (SELECT (qid, node_id) FROM h)),
        {_ranked("scored AS (SELECT * FROM h UNION ALL SELECT * FROM w WHERE s > 0.05),", "qid", "node_id", 6, "AND s > 0.05")}""",
    "ret3_typed_search": f"""WITH {_VEC}, {_Q}, {_ranked("scored AS (SELECT qid, i.node_id, list_inner_product(q.vec, i.vec) / sqrt(list_inner_product(i.vec, i.vec)) AS s FROM v i, q WHERE label IN (1, 3)),", "qid", "node_id", 5)}""",
    "ret9_triple_path": f"""WITH {_VEC}, {_Q}, {_ARCS}, top AS (SELECT qid, edge_id, src, dst FROM arcs JOIN v i ON dst = i.node_id, q QUALIFY row_number() OVER (PARTITION BY qid ORDER BY list_inner_product(q.vec, i.vec) DESC, edge_id) <= 10),
        n AS (SELECT qid, src AS node FROM top UNION SELECT qid, dst FROM top), near AS (SELECT DISTINCT qid, edge_id, dst FROM arcs JOIN n ON src = node OR dst = node),
        scored AS (SELECT near.qid, edge_id, {_COS} AS s FROM near JOIN v i ON dst = i.node_id JOIN q USING (qid) WHERE s >= 0.1)
        SELECT qid, edge_id, round(s, 5) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, edge_id) <= 10""",
    "ret5_hybrid": f"""WITH {_VEC}, {_Q}, {_ARCS}, pairs AS (SELECT qid, q.vec AS qv, edge_id, src, dst, {_COS} AS c, list_inner_product(q.vec, i.vec) / (sqrt(list_inner_product(q.vec, q.vec)) * sqrt(list_inner_product(i.vec, i.vec))) AS x FROM arcs JOIN v i ON dst = i.node_id, q),
        hit AS (SELECT qid, i.node_id FROM v i, q WHERE label = 2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {_COS} DESC, i.node_id) <= 5),
        one AS (SELECT DISTINCT p.qid, edge_id, c FROM pairs p JOIN hit h ON p.qid = h.qid AND (src = h.node_id OR dst = h.node_id)), one5 AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c DESC, edge_id) <= 5),
        direct AS (SELECT qid, src, dst FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY x DESC, edge_id) <= 5), e1 AS (SELECT qid, src AS node FROM direct UNION SELECT qid, dst FROM direct),
        around AS (SELECT * FROM e1 UNION SELECT qid, arcs.dst FROM e1 JOIN arcs ON arcs.src = node),
        two AS (SELECT DISTINCT p.qid, edge_id, c FROM pairs p JOIN around a ON p.qid = a.qid AND (src = node OR dst = node) WHERE c >= 0.1), two5 AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c DESC, edge_id) <= 5),
        u AS (SELECT qid, edge_id, string_agg(p, '+' ORDER BY p) AS path FROM (SELECT qid, edge_id, 'typed' AS p FROM one5 UNION ALL SELECT qid, edge_id, 'triples' FROM two5) GROUP BY 1, 2)
        SELECT path, count(*) AS n FROM u GROUP BY 1""",
    "ret14_substring_nodes": f"""WITH {_NODES} SELECT r_regionkey AS qid, node_id FROM region, nodes WHERE schema_type IN ('nation', 'region', 'part') AND (contains(lower(name), lower(substr(r_name, 1, 2))) OR contains(lower(name), 'xyz'))""",
    "ret17_strategies": f"""WITH {_VEC}, {_Q}, s0 AS (SELECT qid, i.node_id, label, list_inner_product(q.vec, i.vec) AS s FROM v i, q),
        a AS (SELECT qid, node_id, s, 'nodes' AS w FROM s0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, node_id) <= 10), b AS (SELECT qid, node_id, s, 'typed' AS w FROM s0 WHERE label IN (1, 2) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, node_id) <= 5),
        {_ranked("scored AS (SELECT qid, node_id, max(s) AS s, string_agg(w, '+' ORDER BY w) AS \"by\" FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2),", "qid", "node_id", 12)}""",
    "vec15_relation_search": f"""WITH {_VEC}, {_Q}, {_ARCS}, p AS (SELECT relation, unnest(generate_series(1, 64)) AS j, vec FROM arcs JOIN v ON dst = node_id), c AS (SELECT relation, j, avg(vec[j]) AS x FROM p GROUP BY 1, 2),
        m AS (SELECT relation AS id, list(x ORDER BY j) AS vec FROM c GROUP BY 1), {_ranked("scored AS (SELECT qid, id, list_inner_product(q.vec, m.vec) AS s FROM m, q),", "qid", "id", 2)}""",
    "vec31_table_vectors": f"WITH {_VEC} SELECT node_id, 64 AS dim, round(sqrt(list_inner_product(vec, vec)), 4) AS norm FROM labels JOIN v ON vec_id = doc_id",
    "vec28_trimmed_cache": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 100",
    "vec2_embedded_names": """WITH t AS (SELECT CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '[Error x]' ELSE p_name END AS t FROM part) SELECT t, count(DISTINCT t) AS vectors, CASE WHEN t IN ('', '[Error x]') THEN 0.0 ELSE 1.0 END AS norm FROM t GROUP BY 1""",
    "viz4_sub_query_star": "SELECT 'question_' || n_regionkey AS source, 'sub_' || n_regionkey || '_' || n_nationkey AS target FROM nation",
    "viz5_retrieved_chart": "SELECT n_regionkey AS qid, n_name AS source, 'in' AS relation, 'r' || n_regionkey AS target FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 12 < 10",
    "viz6_reasoning_flow": "SELECT item_id % 5 AS qid, CAST(item_id // 5 + 1 AS INTEGER) AS step, CASE WHEN item_id % 2 = 0 THEN 'search' ELSE 'unknown' END AS type, substr(text, 1, 50) AS question, item_id AS triples, CAST(0 AS BIGINT) AS chunks, 0.5 AS seconds FROM benchmark",
    "viz3_chart_by_shape": """SELECT name, CAST(15 AS BIGINT) AS size, CAST(15 AS BIGINT) AS size_of_list FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier) ORDER BY name LIMIT 500""",
    "ded42_workflow": f"""WITH {_HEADS}, r AS (SELECT 'part_' || p_partkey AS node, CASE WHEN 'part_' || p_partkey IN (SELECT dup FROM mapping) THEN 'alias' WHEN 'part_' || p_partkey IN (SELECT canon FROM mapping) THEN 'representative' ELSE 'none' END AS role FROM part) SELECT role, count(*) AS n FROM r GROUP BY 1""",
}
