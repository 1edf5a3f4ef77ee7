"""The record, entity and topic tables, built from the driver's tables by one SQL text for either engine.

Records come from ``documents``; the entity graph from the keys of the star schema; the topic tree from
region, nation, customer and order. Clearance is key % 4, from 0 (public) to 3 (restricted).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

VIEWS = {
    "records": """
      SELECT doc_id AS id, concat('DOC-', doc_id) AS doc_identifier, substring(text, 1, 60) AS title, text AS content,
             CAST(doc_id % 4 AS INT) AS clearance, lang AS domain, source AS package, concat(lang, '/', source) AS topic_id
      FROM documents""",
    "entities": """
      SELECT concat('region:', r_regionkey) AS id, r_name AS name, lower(r_name) AS norm, 'region' AS kind, CAST(r_regionkey % 4 AS INT) AS clearance FROM region
      UNION ALL SELECT concat('nation:', n_nationkey), n_name, lower(n_name), 'nation', CAST(n_nationkey % 4 AS INT) FROM nation
      UNION ALL SELECT concat('customer:', c_custkey), c_name, lower(c_name), 'customer', CAST(c_custkey % 4 AS INT) FROM customer
      UNION ALL SELECT concat('supplier:', s_suppkey), s_name, lower(s_name), 'supplier', CAST(s_suppkey % 4 AS INT) FROM supplier
      UNION ALL SELECT concat('part:', p_partkey), p_name, lower(p_name), 'part', CAST(p_partkey % 4 AS INT) FROM part""",
    "relations": """
      SELECT concat('nation:', n_nationkey) AS src, concat('region:', n_regionkey) AS dst, 'IN_REGION' AS relation, CAST(n_nationkey % 4 AS INT) AS clearance, CAST(NULL AS BIGINT) AS doc_id FROM nation
      UNION ALL SELECT concat('customer:', c_custkey), concat('nation:', c_nationkey), 'IN_NATION', CAST(c_custkey % 4 AS INT), CAST(NULL AS BIGINT) FROM customer
      UNION ALL SELECT concat('supplier:', s_suppkey), concat('nation:', s_nationkey), 'IN_NATION', CAST(s_suppkey % 4 AS INT), CAST(NULL AS BIGINT) FROM supplier
      UNION ALL SELECT DISTINCT concat('supplier:', l_suppkey), concat('part:', l_partkey), 'SUPPLIES', CAST(l_partkey % 4 AS INT), CAST(NULL AS BIGINT) FROM lineitem""",
    "doc_entities": """
      SELECT o_orderkey AS doc_id, concat('customer:', o_custkey) AS entity_id, CAST(1 AS BIGINT) AS n FROM orders
      UNION ALL SELECT l_orderkey, concat('part:', l_partkey), count(*) FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "graph_docs": """
      SELECT o_orderkey AS id, concat('INC-', lpad(CAST(o_orderkey AS STRING), 6, '0')) AS doc_identifier, o_orderdate AS created, o_totalprice AS amount,
             CAST(o_orderkey % 4 AS INT) AS clearance, o_orderpriority AS corpus FROM orders""",
    "topic_nodes": """
      SELECT concat('r', r_regionkey) AS topic_id, r_name AS name, 0 AS depth, 'star' AS package FROM region
      UNION ALL SELECT concat('n', n_nationkey), n_name, 1, 'star' FROM nation
      UNION ALL SELECT concat('c', c_custkey), c_name, 2, 'star' FROM customer""",
    "topic_edges": """
      SELECT concat('r', r_regionkey) AS child, CAST(NULL AS STRING) AS parent, 1 AS is_primary FROM region
      UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 1 FROM nation
      UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), 1 FROM customer
      UNION ALL SELECT concat('c', c_custkey), concat('n', (c_nationkey + 1) % 25), 0 FROM customer WHERE c_custkey % 10 = 0""",
    "topic_records": """
      SELECT o_orderkey AS id, concat('c', o_custkey) AS topic_id, CAST(o_orderkey % 4 AS INT) AS clearance, o_orderpriority AS console,
             CASE WHEN o_orderkey % 5 = 0 THEN 'native' ELSE 'composite' END AS record_kind FROM orders""",
}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temp views over the Parquet tables and the derived tables; nothing is read yet. A session that has those of a folder keeps them."""
    mark = f"siltstone_views_{hashlib.md5(sf_dir.encode()).hexdigest()}"
    if spark.catalog.tableExists(mark):
        return
    for old in spark.catalog.listTables():
        if old.name.startswith("siltstone_views_"):
            spark.catalog.dropTempView(old.name)
    spark.range(0).createOrReplaceTempView(mark)
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, body in VIEWS.items():
        spark.sql(body).createOrReplaceTempView(name)


def with_views(body: str) -> str:
    """The body with the derived tables that it names put before it, for an engine that has the base tables only."""
    import re

    def named(text: str) -> set[str]:
        return {v for v in VIEWS if re.search(rf"\b{v}\b", text)}

    used = [v for v in VIEWS if v in named(body)]
    ctes = ", ".join(f"{v} AS ({VIEWS[v].replace('AS STRING', 'AS VARCHAR')})" for v in used)
    body = body.strip().replace("AS STRING", "AS VARCHAR")
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes}, {body[4:]}"
    return f"WITH {ctes} {body}"
