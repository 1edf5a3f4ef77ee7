"""Relational operators as SQL that either engine runs on the shared views.

The number at each entry is the operator's row of the inventory. Every top-k has a total order, clearance is
filtered before ranking, and floating results are rounded to six digits.
"""

from __future__ import annotations

CLEARANCE = 2

SQL: dict[str, str] = {
    # Projections, filters, predicates
    "p1_exact_lookup": "SELECT id, doc_identifier, title FROM records WHERE doc_identifier IN ('DOC-7', 'DOC-42', 'DOC-100000') AND clearance <= 3",
    "p2_clearance_filter": f"SELECT id, doc_identifier, clearance FROM records WHERE clearance <= {CLEARANCE}",
    "p3_clearance_set": "SELECT id, clearance, package FROM records WHERE clearance IN (0, 1)",
    "p4_key_range": "SELECT id, doc_identifier FROM records WHERE doc_identifier >= 'DOC-1' AND doc_identifier < 'DOC-2'",
    "p5_like_search": "SELECT id, title FROM records WHERE lower(title) LIKE '%the%' AND clearance <= 2",
    "p6_nocase_equality": "SELECT id, name, kind FROM entities WHERE lower(name) = lower('europe') OR lower(name) = lower('CUSTOMER#000000007')",
    "p7_reverse_containment": "SELECT e.id, e.name, q.item_id FROM (SELECT c_custkey AS item_id, concat('orders from ', lower(r_name), ' by ', lower(c_name)) AS question FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) q JOIN entities e ON length(e.norm) >= 3 AND e.kind = 'region' AND position(e.norm IN q.question) > 0",
    "p9_domain_scope": "SELECT id, domain, package FROM records WHERE CASE WHEN domain = 'en' THEN package IN ('src0', 'src1') WHEN domain = 'de' THEN lower(content) LIKE '%der%' ELSE FALSE END",
    "p11_query_relations": "SELECT src, dst, relation FROM relations WHERE relation = 'SUPPLIES' AND clearance <= 1",
    "p12_allow_list": "SELECT id, name, kind FROM entities WHERE kind IN ('region', 'nation', 'supplier') AND clearance <= 2",
    "p13_confidence_floor": "SELECT vec_id, score FROM (SELECT vec_id, round(1e0 / (60 + vec_id % 50), 6) AS score FROM embeddings) t WHERE score >= 0.012",
    "p14_projection": "SELECT id, substring(content, 1, 500) AS snippet, CASE WHEN position('the' IN content) > 0 THEN 'has' ELSE 'none' END AS mark, replace(topic_id, '/', ' > ') AS path, concat(package, ':', doc_identifier) AS label FROM records",
    "p15_noisy_paths": "SELECT page_id, url FROM pages WHERE NOT (url LIKE '%spam%' OR url LIKE '%.git/%' OR url LIKE '%node_modules%')",
    # Joins
    "j1_postings_join": "SELECT r.id, r.title, t.n FROM records r JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) t ON r.id = t.doc_id WHERE r.clearance <= 2",
    "j2_neighbours": "SELECT r.src, e.name AS neighbour, r.relation, 'out' AS direction FROM relations r JOIN entities e ON e.id = r.dst WHERE r.src LIKE 'supplier:%' AND e.clearance <= 2 UNION ALL SELECT r.dst, e.name, r.relation, 'in' FROM relations r JOIN entities e ON e.id = r.src WHERE r.dst LIKE 'nation:%' AND e.clearance <= 2",
    "j3_named_relations": "SELECT a.name AS source_name, r.relation, b.name AS target_name FROM relations r JOIN entities a ON a.id = r.src JOIN entities b ON b.id = r.dst WHERE r.clearance <= 1 AND r.relation <> 'SUPPLIES'",
    "j4_docs_of_entities": "SELECT d.id, d.doc_identifier FROM graph_docs d WHERE EXISTS (SELECT 1 FROM doc_entities x WHERE x.doc_id = d.id AND x.entity_id LIKE 'part:%') AND d.clearance <= 2",
    "j5_entity_doc_counts": "SELECT e.id, e.name, count(x.doc_id) AS n_docs FROM entities e LEFT JOIN doc_entities x ON x.entity_id = e.id WHERE e.kind IN ('customer', 'region') GROUP BY e.id, e.name",
    "j6_topic_family": "SELECT a.child AS topic_id, a.parent, b.child AS sibling FROM topic_edges a JOIN topic_edges b ON a.parent = b.parent AND a.child <> b.child WHERE a.is_primary = 1 AND b.is_primary = 1 AND a.child LIKE 'n%'",
    "j7_scalar_lookups": "SELECT n.topic_id, n.name, coalesce(k.children, 0) AS children, f.first_child FROM topic_nodes n LEFT JOIN (SELECT parent, count(*) AS children FROM topic_edges GROUP BY parent) k ON k.parent = n.topic_id LEFT JOIN (SELECT parent, min(child) AS first_child FROM topic_edges GROUP BY parent) f ON f.parent = n.topic_id WHERE n.depth <= 1",
    "j8_topics_with_records": "SELECT n.topic_id, n.name, coalesce(r.n, 0) AS n_records, coalesce(r.low, -1) AS low FROM topic_nodes n LEFT JOIN (SELECT topic_id, count(*) AS n, min(clearance) AS low FROM topic_records GROUP BY topic_id) r ON r.topic_id = n.topic_id",
    "j9_bridges_with_topics": "SELECT b.source_id, s.name AS source_name, b.target_id, t.name AS target_name, b.similarity FROM (SELECT concat('topic:c', c_custkey) AS source_id, concat('topic:n', c_nationkey) AS target_id, round(c_custkey % 100 / 1e2, 6) AS similarity FROM customer) b LEFT JOIN topic_nodes s ON s.topic_id = replace(b.source_id, 'topic:', '') LEFT JOIN topic_nodes t ON t.topic_id = replace(b.target_id, 'topic:', '') WHERE b.similarity >= 0.65",
    # Documents from before 2001 are gone, with the supplies that only they hold; every other relation stays.
    "j11_orphans": "WITH left_docs AS (SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= DATE '2001-01-01'), held AS (SELECT src, dst FROM relations WHERE relation <> 'SUPPLIES' UNION ALL SELECT concat('supplier:', l_suppkey), concat('part:', l_partkey) FROM lineitem JOIN left_docs ON left_docs.id = l_orderkey) SELECT e.id, e.name, e.kind FROM entities e LEFT JOIN (SELECT src AS id FROM held UNION SELECT dst FROM held UNION SELECT entity_id FROM doc_entities JOIN left_docs ON left_docs.id = doc_id) k ON k.id = e.id WHERE k.id IS NULL",
    "j15_alarm_topics": "SELECT a.id AS record_id, n.topic_id FROM (SELECT o_orderkey AS id, concat('ALM-', o_custkey, ' link down') AS title FROM orders) a JOIN topic_nodes n ON n.topic_id = concat('c', substring(split_part(a.title, ' ', 1), 5))",
    "j18_cooccurrence": "SELECT a.entity_id AS customer_id, b.entity_id AS part_id, count(*) AS n FROM doc_entities a JOIN doc_entities b ON a.doc_id = b.doc_id WHERE a.entity_id LIKE 'customer:%' AND b.entity_id LIKE 'part:%' GROUP BY a.entity_id, b.entity_id HAVING count(*) >= 2",
    "j19_two_hop_bridge": "SELECT DISTINCT a.src AS start_id, a.dst AS via_id, b.dst AS end_id FROM relations a JOIN relations b ON a.dst = b.src WHERE a.src LIKE 'customer:%' AND b.relation = 'IN_REGION'",
    "j20_snapshot_diff": "SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS state FROM (SELECT doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0) o FULL OUTER JOIN (SELECT doc_id AS path, md5(CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.h <> n.h",
    # Aggregations
    "a1_totals": "SELECT (SELECT count(*) FROM graph_docs) AS docs, (SELECT count(*) FROM entities) AS entities_n, (SELECT count(*) FROM relations) AS relations_n",
    "a2_kinds": "SELECT kind, count(*) AS n FROM entities GROUP BY kind",
    "a3_corpus_stats": "SELECT count(*) AS n, round(avg(length(content)), 6) AS mean_length, CAST(max(length(content)) AS BIGINT) AS max_length FROM records",
    "a4_topic_clearance": "SELECT topic_id, min(clearance) AS clearance FROM topic_records GROUP BY topic_id",
    "a5_topic_theme": "SELECT topic_id, console, n FROM (SELECT topic_id, console, count(*) AS n, row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, console) AS rk FROM topic_records GROUP BY topic_id, console) t WHERE rk = 1",
    "a6_best_uri": "SELECT topic_id, max(coalesce(nullif(CASE WHEN record_kind = 'native' THEN concat('archive://a#', id) ELSE '' END, ''), concat('record://', id))) AS uri FROM topic_records GROUP BY topic_id",
    "a7_distinct_docs": "SELECT entity_id, count(DISTINCT doc_id) AS n_docs FROM doc_entities WHERE entity_id LIKE 'part:%' GROUP BY entity_id",
    "a8_first_record": "SELECT topic_id, min(id) AS id FROM topic_records GROUP BY topic_id",
    "a9_edge_histogram": "SELECT relation, clearance, count(*) AS n FROM relations GROUP BY relation, clearance",
    "a10_degree": "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM relations UNION ALL SELECT dst FROM relations) t GROUP BY node",
    "a13_mentions": "SELECT entity_id, CAST(sum(n) AS BIGINT) AS mentions, min(doc_id) AS first_doc FROM doc_entities GROUP BY entity_id",
    "a14_dossier": "SELECT x.entity_id, count(DISTINCT d.id) AS docs, round(sum(d.amount), 2) AS amount, min(d.created) AS first_date, max(d.created) AS last_date FROM doc_entities x JOIN graph_docs d ON d.id = x.doc_id WHERE x.entity_id LIKE 'customer:%' AND d.clearance <= 2 GROUP BY x.entity_id",
    "a15_max_amount": "SELECT l_orderkey AS doc_id, round(max(l_extendedprice), 2) AS max_amount FROM lineitem GROUP BY l_orderkey",
    "a16_directory_stats": "SELECT split_part(split_part(url, '://', 2), '/', 1) AS directory, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY split_part(split_part(url, '://', 2), '/', 1)",
    "a17_format_report": "SELECT split_part(url, ':', 1) AS format, count(*) AS n, CAST(sum(CASE WHEN html IS NULL OR html = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_n FROM pages GROUP BY split_part(url, ':', 1)",
    "a20_token_estimate": "SELECT id, CAST(floor((length(trim(content)) + 3) / 4) AS BIGINT) AS tokens FROM records",
    "a23_coverage": "SELECT label, count(DISTINCT vec_id % 13) AS chapters FROM embeddings GROUP BY label",
    # Windows
    "w1_rank_in_leg": "SELECT id, domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY length(content) DESC, id) AS BIGINT) AS rk FROM records WHERE clearance <= 2",
    "w2_siblings": "SELECT topic_id, parent, lag(topic_id) OVER (PARTITION BY parent ORDER BY topic_id) AS previous, lead(topic_id) OVER (PARTITION BY parent ORDER BY topic_id) AS following FROM (SELECT child AS topic_id, parent FROM topic_edges WHERE is_primary = 1 AND parent IS NOT NULL) t",
    "w3_next_topic": "SELECT src, dst FROM (SELECT child AS src, lead(child) OVER (PARTITION BY parent ORDER BY child) AS dst FROM topic_edges WHERE is_primary = 1 AND parent IS NOT NULL) t WHERE dst IS NOT NULL",
    "w4_shared_chain": "SELECT part, src, dst FROM (SELECT l_partkey AS part, l_orderkey AS src, lead(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS dst, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rk FROM lineitem) t WHERE rk <= 3 AND dst IS NOT NULL",
    "w5_one_per_document": "SELECT id, topic_id, record_kind FROM (SELECT id, topic_id, record_kind, row_number() OVER (PARTITION BY topic_id ORDER BY CASE WHEN record_kind = 'native' THEN 0 ELSE 1 END, id) AS rk FROM topic_records) t WHERE rk = 1",
    "w6_fold": "SELECT topic_id, CAST(sum(CASE WHEN record_kind = 'composite' THEN 1 ELSE 0 END) AS BIGINT) AS collapsed, min(CASE WHEN record_kind = 'native' THEN id END) AS native_id FROM topic_records GROUP BY topic_id HAVING min(CASE WHEN record_kind = 'native' THEN id END) IS NOT NULL",
    "w8_chunk_titles": "SELECT conv_id, turn, concat('[', row_number() OVER (PARTITION BY conv_id ORDER BY turn), '/', count(*) OVER (PARTITION BY conv_id), '] ', role) AS title FROM conversations",
    "w9_running_cap": "SELECT p_partkey, p_size, CAST(running AS BIGINT) AS running FROM (SELECT p_partkey, p_size, p_brand, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS running FROM part) t WHERE running <= 300",
    "w10_top_k_per_group": "SELECT s_id, p_id, qty FROM (SELECT l_suppkey AS s_id, l_partkey AS p_id, round(sum(l_quantity), 2) AS qty, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS rk FROM lineitem GROUP BY l_suppkey, l_partkey) t WHERE rk <= 5",
    "w12_capped_neighbours": "SELECT src, dst, relation FROM (SELECT src, dst, relation, row_number() OVER (PARTITION BY src, relation ORDER BY dst) AS in_kind, row_number() OVER (PARTITION BY src ORDER BY relation, dst) AS overall FROM relations) t WHERE in_kind <= 8 AND overall <= 24",
    # Sorting and limits
    "l1_ranked_page": "SELECT id, n FROM (SELECT id, CAST(length(content) AS BIGINT) AS n FROM records WHERE clearance <= 2) t ORDER BY n DESC, id LIMIT 25",
    "l6_nearest_numbers": "SELECT id, doc_identifier, distance FROM (SELECT id, doc_identifier, abs(id - 500) AS distance FROM graph_docs WHERE clearance <= 2) t ORDER BY distance, id LIMIT 10",
    "l7_find": "SELECT topic_id, name, how FROM (SELECT topic_id, name, depth, CASE WHEN lower(name) = 'asia' THEN 0 WHEN lower(name) LIKE 'asia%' THEN 1 WHEN lower(name) LIKE '%asia%' OR lower(name) LIKE '%a%' THEN 2 END AS how FROM topic_nodes) t WHERE how IS NOT NULL ORDER BY how, depth, name, topic_id LIMIT 200",
    "l8_candidates": "SELECT directory, files, chars FROM (SELECT split_part(split_part(url, '://', 2), '/', 1) AS directory, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY split_part(split_part(url, '://', 2), '/', 1)) t ORDER BY files DESC, chars DESC, directory LIMIT 20",
    "l9_relation_priority": "SELECT src, dst, relation, CASE relation WHEN 'SUPPLIES' THEN 0 WHEN 'IN_NATION' THEN 1 ELSE 2 END AS priority FROM relations WHERE clearance = 0",
    "l11_payload_caps": "SELECT doc_id, entity_id FROM (SELECT doc_id, entity_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, entity_id) AS rk FROM doc_entities) t WHERE rk <= 3",
    "l12_paging": "SELECT id, substring(content, 1001, 1000) AS page FROM records WHERE length(content) > 1000",
    # Set operations
    "u1_distinct_union": "SELECT dst AS node FROM relations WHERE src LIKE 'supplier:%' UNION SELECT src FROM relations WHERE dst LIKE 'nation:%'",
    "u3_both_directions": "SELECT src AS a, dst AS b, 'out' AS direction FROM relations WHERE relation = 'IN_REGION' UNION ALL SELECT dst, src, 'in' FROM relations WHERE relation = 'IN_REGION'",
    "u5_union_dedupe": "SELECT id, origin FROM (SELECT id, origin, row_number() OVER (PARTITION BY id ORDER BY origin) AS rk FROM (SELECT doc_id AS id, 0 AS origin FROM labels UNION ALL SELECT id, 1 FROM records) t) t2 WHERE rk = 1",
    "u7_difference": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    # Lifecycle
    "d1_upsert": "SELECT doc_identifier, title, version FROM (SELECT doc_identifier, title, version, row_number() OVER (PARTITION BY doc_identifier ORDER BY version DESC) AS rk FROM (SELECT doc_identifier, title, 1 AS version FROM records UNION ALL SELECT doc_identifier, concat(title, ' (new)'), 2 FROM records WHERE id % 9 = 0) t) t2 WHERE rk = 1",
    "d2_delete": "SELECT id, doc_identifier FROM records r WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.id)",
    "d3_purge_prefix": "SELECT count(*) AS deleted, (SELECT count(*) FROM records) - count(*) AS kept FROM records WHERE lower(topic_id) LIKE '%src1%' OR lower(doc_identifier) LIKE 'doc-1%'",
    "d5_resolve_entities": "SELECT m.norm, m.kind, c.clearance FROM (SELECT norm, kind FROM (SELECT norm, kind, row_number() OVER (PARTITION BY norm ORDER BY seq) AS rk FROM (SELECT lower(n_name) AS norm, 'nation' AS kind, n_nationkey AS seq FROM nation UNION ALL SELECT lower(n_name), 'country', 100 + n_nationkey FROM nation UNION ALL SELECT lower(r_name), 'area', 200 + r_regionkey FROM region) t) t2 WHERE rk = 1) m JOIN (SELECT norm, max(c) AS clearance FROM (SELECT lower(n_name) AS norm, n_nationkey % 4 AS c FROM nation UNION ALL SELECT lower(n_name), n_nationkey % 3 FROM nation UNION ALL SELECT lower(r_name), r_regionkey % 4 FROM region) t GROUP BY norm) c ON c.norm = m.norm",
    "d9_prune_topics": "WITH gone AS (SELECT n.topic_id FROM topic_nodes n LEFT JOIN (SELECT DISTINCT topic_id FROM topic_records WHERE id % 2 = 0) r ON r.topic_id = n.topic_id WHERE n.depth = 2 AND r.topic_id IS NULL), nations AS (SELECT n.topic_id FROM topic_nodes n WHERE n.depth = 1 AND NOT EXISTS (SELECT 1 FROM topic_edges e LEFT JOIN gone g ON g.topic_id = e.child WHERE e.parent = n.topic_id AND g.topic_id IS NULL)) SELECT topic_id FROM gone UNION ALL SELECT topic_id FROM nations",
    "d10_ingest_modes": "SELECT path, CASE WHEN old_n IS NULL THEN 'new' WHEN new_n = old_n THEN 'skip' WHEN new_n >= 1.5 * old_n THEN 'grow' ELSE 'changed' END AS decision FROM (SELECT a.doc_id AS path, a.n AS new_n, b.n AS old_n FROM (SELECT doc_id, n_chars AS n FROM documents) a LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars * 2 WHEN doc_id % 5 = 1 THEN CAST(floor(n_chars / 2) AS BIGINT) ELSE n_chars END AS n FROM documents WHERE doc_id % 3 <> 0) b ON a.doc_id = b.doc_id) t",
    "d14_relocate": "SELECT id, replace(topic_id, 'en/', 'english/') AS topic_id FROM records WHERE topic_id LIKE 'en/%'",
    "d16_merge_graphs": "SELECT kind, norm, max(clearance) AS clearance, CAST(sum(n) AS BIGINT) AS n FROM (SELECT kind, norm, clearance, 1 AS n FROM entities UNION ALL SELECT kind, norm, 3 - clearance, 1 FROM entities WHERE kind <> 'part') t GROUP BY kind, norm",
    # Graph reads
    "g6_statistics": "SELECT kind, count(*) AS n, CAST(sum(CASE WHEN clearance <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS visible FROM entities GROUP BY kind",
    "g10_entity_layer": "SELECT DISTINCT r.src, r.dst, r.relation FROM relations r JOIN entities a ON a.id = r.src JOIN entities b ON b.id = r.dst WHERE a.kind IN ('supplier', 'nation', 'region') AND b.kind IN ('nation', 'region') AND a.clearance <= 2 AND b.clearance <= 2 AND r.clearance <= 2",
}
