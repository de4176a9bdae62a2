"""DuckDB SQL for the queries of queries_rows."""

from kgspark.oracles import _BOTH, _HEADS, _NODES, _SUPPLIES, _VEC, _norm

_PLACES = """'part_of', 'located_in'"""
_PART = "'part_' || p_partkey"
_KEY = "try_cast(split_part(node_id, '_', 2) AS BIGINT)"



def _detected() -> str:
    """(doc_id, lang, chars, found): the language with most evidence in each document."""
    from kgspark.functions.language import LETTERS, PROFILES, SCRIPTS

    parts = []
    for lang, profile in PROFILES.items():
        n = f"2.0 * (length(low) - length(translate(low, '{LETTERS[lang]}', '')))" if lang in LETTERS else "0.0"
        words = ", ".join(f"'{w}'" for w in profile.split())
        parts.append(f"{{'p': {n} + len(list_filter(w, lambda x: x IN ({words}))), 'l': '{lang}'}}")
    parts += [f"{{'p': 3.0 * len(regexp_extract_all(low, '{script}')), 'l': '{lang}'}}" for lang, script in SCRIPTS.items()]
    return f"""t AS (SELECT doc_id, lang, lower(text) AS low, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM documents),
        s AS (SELECT doc_id, lang, length(low) AS chars, list_sort([{', '.join(parts)}], 'DESC')[1] AS best FROM t),
        f AS (SELECT doc_id, lang, chars, CASE WHEN best.p > 0 THEN best.l ELSE 'unknown' END AS found FROM s)"""


ORACLES: dict[str, str] = {
    "lng1_detect": f"WITH {_detected()} SELECT lang, count(*) AS n, count(*) FILTER (WHERE lang = found) AS right FROM f GROUP BY 1",
    "agg17_detector_accuracy": f"""WITH {_detected()} SELECT CASE WHEN chars > 100 THEN 'long' ELSE 'short' END AS length, count(*) AS n, count(*) FILTER (WHERE lang = found) AS right,
        round(avg(CASE WHEN lang = found THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM f GROUP BY 1""",
    "src1_json_round_trip": f"""WITH {_BOTH} SELECT s.label AS src_label, s.name AS src_name, relation, t.label AS dst_label, t.name AS dst_name
        FROM edges JOIN nodes s ON src = s.node_id JOIN nodes t ON dst = t.node_id WHERE relation IN ({_PLACES})""",
    "src2_graphml_round_trip": f"WITH {_NODES} SELECT node_id, label, level, name, NULL::VARCHAR AS schema_type FROM nodes WHERE schema_type IN ('region', 'nation', 'customer', 'supplier')",
    "src2_graphml_edges": f"WITH {_BOTH} SELECT src, dst, relation FROM edges WHERE relation IN ({_PLACES})",
    "src3_parquet_round_trip": f"WITH {_BOTH} SELECT relation, count(*) AS n, min(edge_id) AS first, count(DISTINCT src) AS sources FROM edges GROUP BY 1",
    "src4_corpus_scan": "SELECT source AS title, count(*) AS n, min(md5(text)) AS first, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "src6_chunk_mapping": f"SELECT {_PART} AS chunk_id, p_name AS text FROM part",
    "src9_questions": "SELECT md5(text) AS question, CAST(item_id AS VARCHAR) AS answer FROM benchmark",
    "snk6_chunk_upsert": f"SELECT {_PART} AS chunk_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS text FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 0",
    "snk7_evolved_ontology": "SELECT 'node' AS kind, p_type AS type_name FROM part UNION SELECT 'attribute', p_brand FROM part",
    "snk8_review_export": f"""WITH {_HEADS}, m AS (SELECT dup, canon, (CAST(split_part(dup, '_', 2) AS BIGINT) % 100) / 100.0 AS confidence FROM mapping)
        SELECT * FROM m WHERE confidence BETWEEN 0.7 AND 0.9""",
    "snk9_alias_export": f"""WITH {_HEADS} SELECT canon AS representative, c.p_name AS representative_name, dup AS alias, d.p_name AS alias_name, (d.p_partkey % 100) / 100.0 AS confidence, 'exact' AS method
        FROM mapping JOIN part c ON canon = 'part_' || c.p_partkey JOIN part d ON dup = 'part_' || d.p_partkey""",
    "snk10_answer_cache": """SELECT CAST(n_nationkey AS VARCHAR) AS call_id, CASE WHEN n_regionkey < 2 THEN 'old ' ELSE 'new ' END || n_name AS response,
        (SELECT count(*) FROM nation WHERE n_regionkey >= 2) AS made FROM nation""",
    "snk12_embedding_cache": f"WITH {_VEC} SELECT CAST(label AS INTEGER) AS label, count(*) AS n, round(sum(vec[1]), 5) AS x FROM v GROUP BY 1",
    "snk15_index_cache": r"WITH t AS (SELECT p_partkey, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '\s+'), lambda x: length(x) > 2))) AS word FROM part) SELECT word, count(*) AS n FROM t GROUP BY 1",
    "snk18_cleared_caches": "SELECT 2 AS gone, true AS missing, CAST(0 AS BIGINT) AS lost",
    "snk21_datasets": """SELECT lower(n_name) AS name, CASE WHEN n_regionkey = 1 THEN 'ready' ELSE 'needs_construction' END AS status, true AS can_delete FROM nation
        UNION ALL SELECT 'demo', 'needs_construction', false""",
    "src23_restored_answers": "SELECT n_regionkey AS cluster_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS member, member AS representative FROM nation",
    "prj2_clean_text": r"""WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '[^\p{L}\p{N}\s.,;:!?()''"\-]', '', 'g'), ' ') AS k FROM documents)
        SELECT doc_id, md5(CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN '[EMPTY_TEXT]' WHEN k = '' THEN '[EMPTY_AFTER_CLEANING]' ELSE k END) AS clean FROM t""",
    "prj5_extraction_graph": """WITH n AS (SELECT n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT n_name AS src_name, 'country' AS src_schema_type, 'lies in' AS relation, r_name AS dst_name, 'region' AS dst_schema_type, 'c' || k AS chunks FROM n
        UNION ALL SELECT n_name, 'country', 'has_attribute', 'key: ' || k, NULL, 'c' || k FROM n""",
    "prj10_built_graph": """SELECT p_brand AS brand, count(DISTINCT p_name) AS n FROM part WHERE p_brand <> 'Brand#13' GROUP BY 1
        UNION ALL SELECT 'failed', count(*) FROM part WHERE p_brand = 'Brand#13' UNION ALL SELECT 'chunks', count(*) FROM part""",
    "flt1_levels": f"WITH {_NODES} SELECT node_id, level, label FROM nodes WHERE label IN ('keyword', 'community')",
    "flt3_score_threshold": f"""WITH {_VEC}, s AS (SELECT q.vec_id AS qid, i.vec_id AS id, list_inner_product(q.vec, i.vec) AS s FROM v q, v i WHERE q.vec_id % 100 = 0),
        r AS (SELECT * FROM s WHERE s > 0.2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 50)
        SELECT qid, count(*) AS n, round(min(s), 5) AS least FROM r GROUP BY 1""",
    "flt4_valid_text": "SELECT p_partkey FROM part WHERE p_partkey % 5 = 4 AND p_name <> ''",
    "flt5_shown_triples": f"""WITH {_BOTH}, t AS (SELECT node_id, name || CASE WHEN segment IS NOT NULL THEN ' [segment: ' || segment || ']' ELSE '' END AS t FROM nodes)
        SELECT edge_id, '(' || a.t || ', ' || relation || ', ' || b.t || ')' AS text FROM edges JOIN t a ON src = a.node_id JOIN t b ON dst = b.node_id WHERE relation IN ('part_of', 'has_attribute')""",
    "prj27_scored_triples": f"""WITH {_BOTH} SELECT edge_id, '(' || a.name || ', part_of, ' || b.name || ') [score: ' || printf('%.3f', (edge_id % 7) / 10.0) || ']' AS text
        FROM edges JOIN nodes a ON src = a.node_id JOIN nodes b ON dst = b.node_id WHERE relation = 'part_of'""",
    "flt7_alias_nodes": f"SELECT {_PART} AS node_id, p_partkey % 3 = 0 AS is_alias FROM part",
    "prj13_node_text": f"""WITH {_NODES}, n AS (SELECT node_id, CASE WHEN {_KEY} % 4 <> 0 THEN name END AS a, CASE WHEN {_KEY} % 2 = 0 THEN 'about ' || label END AS b FROM nodes)
        SELECT node_id, coalesce(nullif(a, ''), node_id) AS name, coalesce(nullif(trim(concat_ws(' ', a, b)), ''), '[Node: ' || node_id || ']') AS text, CASE WHEN b IS NULL THEN a ELSE concat_ws(' - ', a, b) END AS short FROM n""",
    "prj15_node_properties": f"""WITH {_NODES}, n AS (SELECT node_id, name, concat_ws(', ', 'brand: ' || brand, 'priority: ' || priority, 'segment: ' || segment, 'type: ' || ptype) AS e FROM nodes)
        SELECT node_id, '[' || e || ']' AS properties, name || CASE WHEN e <> '' THEN ' (' || e || ')' ELSE '' END AS described FROM n""",
    "prj20_chunk_ids": f"WITH {_SUPPLIES}, x AS (SELECT DISTINCT dst, chunk FROM supplies) SELECT dst, string_agg(chunk, ',' ORDER BY chunk) AS chunk_ids FROM x GROUP BY 1",
    "prj24_level_report": f"WITH {_NODES} SELECT level, string_agg(name, chr(10) ORDER BY node_id) AS text FROM nodes WHERE schema_type IN ('region', 'nation') OR label IN ('keyword', 'attribute') GROUP BY 1",
    "prj25_subgraph_text": f"""WITH {_BOTH}, n AS (SELECT * FROM nodes WHERE schema_type IN ('region', 'nation')),
        a AS (SELECT string_agg('- ' || name || ' [' || label || ']', chr(10) ORDER BY node_id) AS t FROM n),
        b AS (SELECT string_agg('- ' || s.name || ' -[' || relation || ']-> ' || t.name, chr(10) ORDER BY edge_id) AS t FROM edges JOIN n s ON src = s.node_id JOIN n t ON dst = t.node_id WHERE relation = 'part_of')
        SELECT 'Nodes:' || chr(10) || a.t || chr(10) || 'Edges:' || chr(10) || b.t AS text FROM a, b""",
    "join18_preloaded_clusters": """WITH r AS (SELECT s_nationkey AS grp, s_suppkey AS pos, CASE WHEN s_nationkey % 3 <> 0 AND s_suppkey % 5 <> 0 THEN s_suppkey % 2 END AS c FROM supplier),
        m AS (SELECT *, max(c) OVER (PARTITION BY grp) + 1 AS nxt FROM r)
        SELECT grp, pos, CAST(CASE WHEN nxt IS NULL THEN 0 WHEN c IS NOT NULL THEN c ELSE nxt + row_number() OVER (PARTITION BY grp, c IS NULL ORDER BY pos) - 1 END AS INTEGER) AS cluster FROM m""",
    "join21_similar_edge": f"""WITH {_SUPPLIES}, f AS (SELECT src, dst, min(edge_id) AS edge_id FROM supplies GROUP BY 1, 2),
        p AS (SELECT 'supplier_' || (p_partkey % 50 + 1) AS src, {_PART} AS dst FROM part) SELECT src, dst, coalesce(edge_id, CAST(-1 AS BIGINT)) AS edge_id FROM p LEFT JOIN f USING (src, dst)""",
    "join22_prompt_response": "SELECT n_nationkey AS call_id, CASE WHEN n_nationkey % 2 = 0 THEN reverse(n_name) END AS response, CASE WHEN n_nationkey % 2 = 1 THEN 'no recorded answer' END AS error FROM nation",
    "agg8_run_stats": f"""WITH {_HEADS}, m AS (SELECT count(*) AS merges, count(*) FILTER (WHERE CAST(split_part(dup, '_', 2) AS BIGINT) % 2 = 0) AS exact, count(DISTINCT canon) AS representatives FROM mapping), c AS (SELECT count(*) AS candidates FROM part)
        SELECT candidates, merges, exact, merges - exact AS semantic, representatives, candidates - merges AS main, round(100.0 * merges / candidates, 5) AS reduction_rate FROM m, c""",
    "agg13_before_after": f"""WITH g AS (SELECT count(*) AS size FROM part GROUP BY {_norm('p_name')}), c AS (SELECT CAST(sum(size) AS BIGINT) AS total, CAST(sum(size - 1) AS BIGINT) AS merged FROM g)
        SELECT total, merged, total - merged AS kept, round((total - merged) / total, 6) AS kept_share FROM c""",
    "agg15_merged_values": f"""WITH {_SUPPLIES}, d AS (SELECT src, list_sort(list(DISTINCT dst)) AS t FROM supplies GROUP BY 1)
        SELECT src, CASE WHEN len(t) = 1 THEN t[1] ELSE '[' || array_to_string(t, ', ') || ']' END AS tails FROM d""",
    "agg18_graph_stats": f"WITH {_BOTH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, least(500, (SELECT count(*) FROM nodes)) AS shown_nodes, least(1000, (SELECT count(*) FROM edges)) AS shown_edges",
    "top10_chart_links": f"""WITH {_BOTH} SELECT a.name AS source, b.name AS target, relation FROM edges JOIN nodes a ON src = a.node_id JOIN nodes b ON dst = b.node_id ORDER BY edge_id LIMIT 1000""",
    "set13_united": "SELECT l_suppkey % 10 AS qid, l_partkey AS part, max(CAST(l_quantity AS DOUBLE)) AS score FROM lineitem GROUP BY 1, 2",
    "str4_triple_strings": """SELECT p_partkey, p_name || ' [brand: ' || p_brand || ', type: ' || p_type || ']' AS head, 'is' AS relation, 'thing, really' AS tail,
        CASE WHEN p_partkey % 2 = 0 THEN round((p_partkey % 100) / 100.0, 2) END AS score FROM part""",
    "str7_cleaned_answers": """SELECT n_nationkey, '{"name": "' || n_name || '"}' AS clean FROM nation""",
    "str8_keyword_score": "SELECT doc_id, CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'and') AS INTEGER) + CAST(contains(lower(text), 'ch') AS INTEGER) + CAST(contains(lower(text), 'xyzzy') AS INTEGER) AS score FROM documents",
    "str11_dataset_names": r"""SELECT p_partkey, replace(rtrim(regexp_replace('a/b ' || p_name || '.json (' || p_brand || ') -x  ', '[^\p{L}\p{N} _-]', '', 'g'), ' '), ' ', '_') AS name FROM part""",
    "str13_answers_and_queries": """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name || chr(10) || 'yes' END AS answer, CASE WHEN n_nationkey % 3 = 1 THEN 'where is ' || n_name || '?' END AS query FROM nation""",
    "str14_rationale_flags": """SELECT n_nationkey, n_nationkey % 4 IN (0, 2) AND n_nationkey % 8 < 4 AS flag, CASE n_nationkey % 4 WHEN 0 THEN '3,2' WHEN 1 THEN '4' WHEN 2 THEN '1,2' ELSE '' END AS numbers FROM nation""",
    "jsn3_cluster_answers": """WITH n AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1), g AS (
            SELECT n_regionkey, 0 AS cluster, '10,11' AS members FROM n UNION ALL SELECT n_regionkey, 1, '12' FROM n
            UNION ALL SELECT n_regionkey, i - 1, CAST(9 + i AS VARCHAR) FROM (SELECT n_regionkey, unnest(generate_series(3, n - 1)) AS i, n FROM n WHERE n > 3)
            )
        SELECT n_regionkey, CAST(cluster AS INTEGER) AS cluster, CASE WHEN cluster >= 2 THEN CAST(11 + cluster AS VARCHAR) ELSE members END AS members FROM g""",
    "jsn6_coreference_answers": """SELECT n_nationkey, n_nationkey % 4 = 0 AS is_coreferent, CASE n_nationkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 0.0 END AS confidence, CASE WHEN n_nationkey % 4 = 0 THEN n_name END AS representative FROM nation""",
    "jsn8_decompositions": """SELECT CAST(n_nationkey AS BIGINT) AS qid, pos, CASE WHEN n_nationkey % 2 = 1 THEN 'Where is ' || n_name || '?' WHEN pos = 0 THEN 'a Where is ' || n_name || '?' ELSE 'b' END AS sub_question,
        CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS types FROM nation, (SELECT 0 AS pos UNION ALL SELECT 1) WHERE pos = 0 OR n_nationkey % 2 = 0""",
    "hsh2_prompt_hash": "SELECT item_id, sha256(text) AS hash FROM benchmark",
    "val3_group_issues": """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'error: no head_node' WHEN 1 THEN 'error: no label' WHEN 2 THEN 'warning: cluster of one' WHEN 3 THEN 'error: no dedup_results' ELSE 'error: no relation' END AS issues FROM nation""",
    "val5_member_issues": """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'error: no label; warning: no chunk id' WHEN 2 THEN 'warning: no chunk id' ELSE 'error: empty name' END AS issues FROM nation""",
    "vec24_dim_transform": f"""WITH {_VEC}, e AS (SELECT vec_id, unnest(generate_series(0, 63)) AS i, vec FROM v), j AS (SELECT unnest([0, 1, 2, 3]) AS j)
        SELECT vec_id, CAST(j AS INTEGER) AS pos, round(sum(vec[i + 1] * ((i * 3 + j) % 5 - 2)), 5) AS x FROM e, j GROUP BY 1, 2""",
    "evl1_judged_answers": """SELECT CAST(n_nationkey AS BIGINT) AS qid, n_nationkey % 2 = 0 AS correct, length(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'wrong' END) > 5 AS by_model FROM nation""",
}
