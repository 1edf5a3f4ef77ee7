"""The entity graph, the topic tree, notes and bridges over the driver's tables.

Oracles are written for the tables at hand: three levels of topics, keys of the star schema; they do not follow the operators' steps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bridges, graphstore, layout, lifecycle, notes, structure, topology, tree, versions
from .. import workspace
from ..operators import graph as G
from . import views

LEVEL = 2


def _graph(spark, sf_dir):
    views.register(spark, sf_dir)
    t = spark.table
    return graphstore.Graph(
        t("graph_docs").select(F.col("id").alias("doc_id"), F.col("doc_identifier").alias("identifier"), F.col("corpus").alias("title"), "created", "clearance"),
        t("entities").select(F.col("id").alias("norm"), "name", "kind", "clearance"),
        t("doc_entities").select("doc_id", F.col("entity_id").alias("norm"), "n", F.lit("").alias("context")),
        t("relations").select(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "doc_id", "clearance"),
    )


def _topics(spark, sf_dir):
    views.register(spark, sf_dir)
    t = spark.table
    return t("topic_nodes"), t("topic_edges"), t("topic_records")


def g1_find_entities(spark, sf_dir):
    g = _graph(spark, sf_dir)
    asked = spark.sql("SELECT c_custkey AS question, CASE c_custkey % 5 WHEN 0 THEN concat('customer:', c_custkey) WHEN 1 THEN 'The Orient' WHEN 2 THEN concat(' CUSTOMER:', c_custkey, ' ') WHEN 3 THEN concat('about customer:', c_custkey, '!') ELSE concat('ustomer:', c_custkey) END AS name FROM customer")
    return graphstore.find_entities(g, asked, {"the orient": "region:2"})


def g2_neighbourhoods(spark, sf_dir):
    g = _graph(spark, sf_dir)
    nodes, _, _ = graphstore.neighbourhood(g, g.entities.where("kind = 'region'"), 2, LEVEL)
    return nodes


def g2_neighbourhood_edges(spark, sf_dir):
    g = _graph(spark, sf_dir)
    _, edges, _ = graphstore.neighbourhood(g, g.entities.where("kind = 'region'"), 2, LEVEL)
    return edges


def g2_neighbourhood_documents(spark, sf_dir):
    g = _graph(spark, sf_dir)
    _, _, docs = graphstore.neighbourhood(g, g.entities.where("kind = 'region'"), 2, LEVEL)
    return docs.select("doc_id", "identifier")


def g3_paths(spark, sf_dir):
    g = _graph(spark, sf_dir)
    found = graphstore.paths(g, g.entities.where("kind = 'region'"), g.entities.where("kind = 'customer'"), 2, 3)
    return found.select("norm", "level", F.array_join("steps", " > ").alias("steps"))


def g4_relations(spark, sf_dir):
    return graphstore.query_relations(_graph(spark, sf_dir), relation="IN_REGION", clearance=LEVEL).select("source_name", "relation", "target_name")


def g5_dossiers(spark, sf_dir):
    g = _graph(spark, sf_dir)
    extra = spark.sql("SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS day, o_custkey FROM orders")
    dates = extra.select("doc_id", F.col("day").cast("string").alias("norm"), F.lit(1).cast("long").alias("n"), F.lit("").alias("context"))
    sums = extra.select("doc_id", F.concat(F.lit("R$ "), (F.col("o_custkey") % 7).cast("string"), F.lit(",50")).alias("norm"), F.lit(1).cast("long").alias("n"), F.lit("").alias("context"))
    named = lambda t, kind: t.select("norm", F.col("norm").alias("name"), F.lit(kind).alias("kind"), F.lit(0).alias("clearance")).distinct()
    whole = graphstore.Graph(g.documents, g.entities.unionByName(named(dates, "date")).unionByName(named(sums, "monetary")), g.postings.unionByName(dates).unionByName(sums), g.relations)
    found = graphstore.dossiers(whole, g.entities.where("kind = 'customer'"), LEVEL)
    return found.select("norm", "n_documents", F.size(F.coalesce("dates", F.array())).cast("long").alias("n_dates"), F.get("dates", F.lit(0)).alias("first_date"), "total_amount", F.coalesce(F.size(F.col("connected")["part"]), F.lit(-1)).cast("long").alias("n_parts"))


def g6_graph_statistics(spark, sf_dir):
    return graphstore.statistics(_graph(spark, sf_dir))


def g7_enriched(spark, sf_dir):
    g = _graph(spark, sf_dir)
    counted = g.relations.withColumn("relation", F.when(F.col("relation") == "SUPPLIES", "MEASURED_BY_COUNTER").otherwise(F.col("relation")))
    return graphstore.enriched(graphstore.Graph(g.documents, g.entities, g.postings, counted), g.entities.where("kind = 'supplier'")).select("root", "relation", "direction", "norm", F.col("place").cast("long").alias("place"), "bucket")


def g17_ordered_paths(spark, sf_dir):
    g = _graph(spark, sf_dir)
    steps = spark.sql("SELECT c_custkey AS path, 0 AS step, concat('customer:', c_custkey) AS source, concat('region:', n_regionkey) AS target FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, 1, concat('nation:', c_nationkey), concat('customer:', c_custkey) FROM customer")
    return graphstore.ordered_path(g, steps)


def d4_index_again(spark, sf_dir):
    """A third of the orders come again with other mentions and relations."""
    g = _graph(spark, sf_dir)
    fresh = g.documents.where("doc_id % 3 = 0").withColumn("title", F.lit("again"))
    found = fresh.select("doc_id", F.concat(F.lit("new:"), F.col("doc_id") % 5).alias("norm"), F.lit("tag").alias("kind"), F.lit("New").alias("name"), F.lit(2).cast("long").alias("n"), F.lit("c").alias("context"), (F.col("doc_id") % 4).cast("int").alias("clearance"), F.col("doc_id").alias("seq"))
    edges = fresh.select(F.concat(F.lit("document:"), "doc_id").alias("source"), F.lit("new:0").alias("target"), F.lit("tagged").alias("relation"), "doc_id", F.lit(1).alias("clearance"), F.col("doc_id").alias("seq"))
    out = graphstore.index(g, fresh, found, edges)
    count = lambda t, what, extra: t.agg(F.count(F.lit(1)).alias("n"), extra.cast("long").alias("m")).select(F.lit(what).alias("what"), "n", "m")
    return count(out.documents, "documents", F.sum((F.col("title") == "again").cast("int"))).unionByName(count(out.entities, "entities", F.max(F.when(F.col("kind") == "tag", F.col("clearance"))))).unionByName(count(out.postings, "postings", F.sum(F.when(F.col("context") == "c", F.col("n"))))).unionByName(count(out.relations, "relations", F.sum(F.col("doc_id").isNotNull().cast("int"))))


def d7_delete_cascade(spark, sf_dir):
    g = _graph(spark, sf_dir)
    out = graphstore.delete_documents(g, g.documents.where("doc_id % 2 = 0").select("doc_id"), orphans=False)
    return out.postings.groupBy("norm").agg(F.sum("n").alias("n"))


def d8_orphan_sweep(spark, sf_dir):
    """Documents and supplies go; entities that nothing names any more go with them."""
    g = _graph(spark, sf_dir)
    left = graphstore.Graph(g.documents, g.entities, g.postings, g.relations.where("relation = 'IN_REGION'"))
    out = graphstore.delete_documents(left, g.documents.where("doc_id % 5 < 4"))
    return g.entities.join(out.entities, "norm", "left_anti").select("norm", "kind")


def d8_purge_identifiers(spark, sf_dir):
    out = graphstore.purge_prefix(_graph(spark, sf_dir), "inc-0000")
    return out.documents.select("doc_id", "identifier")


def d16_merge(spark, sf_dir):
    g = _graph(spark, sf_dir)
    other = graphstore.Graph(g.documents.where("doc_id % 2 = 0").withColumn("title", F.when(F.col("doc_id") % 4 == 0, F.lit("new"))), g.entities.withColumn("clearance", 3 - F.col("clearance")).withColumn("kind", F.lit("other")), g.postings.withColumn("n", F.col("n") + F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1)), g.relations.withColumn("clearance", F.lit(0)))
    out = graphstore.merge(g, other)
    docs = out.documents.select(F.lit("document").alias("what"), F.col("doc_id").cast("string").alias("key"), F.col("title").alias("value"))
    entities = out.entities.select(F.lit("entity"), "norm", F.concat_ws("/", "kind", F.col("clearance").cast("string")))
    postings = out.postings.groupBy("norm").agg(F.sum("n").cast("string").alias("v")).select(F.lit("posting"), "norm", "v")
    relations = out.relations.groupBy("relation").agg(F.count(F.lit(1)).cast("string").alias("v")).select(F.lit("relation"), "relation", "v")
    return docs.union(entities).union(postings).union(relations)


def p17_tree_visible(spark, sf_dir):
    nodes, edges, records = _topics(spark, sf_dir)
    return tree.visible(edges, tree.clearances(nodes, edges, records), 1)


def a12_tree_clearances(spark, sf_dir):
    nodes, edges, records = _topics(spark, sf_dir)
    return tree.clearances(nodes, edges, records)


def a5_themes(spark, sf_dir):
    return tree.themes(*_topics(spark, sf_dir))


def a11_tree_descendants(spark, sf_dir):
    _, edges, _ = _topics(spark, sf_dir)
    return tree.descendants(edges)


def j10_tree_paths(spark, sf_dir):
    nodes, edges, _ = _topics(spark, sf_dir)
    return tree.paths(nodes, edges)


def g9_tree_nodes(spark, sf_dir):
    nodes, edges, records = _topics(spark, sf_dir)
    shown, _ = tree.layer(nodes, edges, records, 3)
    return shown.select("topic_id", "theme", "n_desc")


def g9_tree_edges(spark, sf_dir):
    nodes, edges, records = _topics(spark, sf_dir)
    named = nodes.withColumn("name", F.when(F.col("depth") == 2, F.concat(F.lit("ALM-"), F.substring("topic_id", 2, 9).cast("int") % 20, F.lit(" x"))).otherwise(F.col("name")))
    _, found = tree.layer(named, edges, records, 3)
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def g13_tree_expand(spark, sf_dir):
    nodes, edges, _ = _topics(spark, sf_dir)
    return tree.expand(edges, nodes.where("depth = 0"), 1)


def g15_hierarchy(spark, sf_dir):
    nodes, edges, _ = _topics(spark, sf_dir)
    return tree.hierarchy(nodes, edges)


def g15_children(spark, sf_dir):
    nodes, edges, _ = _topics(spark, sf_dir)
    return tree.children(nodes, edges, nodes.where("depth < 2"))


def g15_catalog(spark, sf_dir):
    nodes, edges, _ = _topics(spark, sf_dir)
    return tree.catalog(nodes, edges)


def g12_find_topics(spark, sf_dir):
    nodes, _, _ = _topics(spark, sf_dir)
    asked = spark.sql("SELECT r_regionkey AS question, lower(substring(r_name, 1, 4)) AS text FROM region UNION ALL SELECT 100 + n_nationkey, upper(substring(n_name, 2, 2)) FROM nation")
    return tree.find(nodes, asked, 5)


def g12_meta(spark, sf_dir):
    nodes, edges, records = _topics(spark, sf_dir)
    shown, found = tree.layer(nodes, edges, records, 3)
    return found.groupBy(F.col("kind").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(shown.groupBy(F.concat(F.lit("theme "), "theme").alias("what")).agg(F.count(F.lit(1)).alias("n")))


def f35_layout(spark, sf_dir):
    """Positions have no SQL form; tests hold rings and gaps."""
    nodes, edges, _ = _topics(spark, sf_dir)
    return layout.radial(nodes, edges)


def d12_path_tree(spark, sf_dir):
    views.register(spark, sf_dir)
    nodes, edges = tree.prefixes(spark.table("pages"), F.expr("concat('a/b', page_id % 7, '/', page_id, '.html')"), "src")
    return nodes.select("topic_id", "name", F.col("depth").cast("long").alias("depth")).join(edges.select(F.col("child").alias("topic_id"), "parent"), "topic_id")


def d13_assign(spark, sf_dir):
    views.register(spark, sf_dir)
    records = spark.table("topic_records").select("id", F.lit("composite").alias("record_kind"), "topic_id")
    claims = records.select("id", (F.col("id") % 2).alias("priority"), F.concat(F.lit("a"), F.col("id") % 10).alias("topic_id")).unionByName(records.where("id % 3 = 0").select("id", F.lit(1).cast("long").alias("priority"), F.concat(F.lit("b"), F.col("id") % 10).alias("topic_id")))
    return tree.assign(records, claims).select("id", "topic_id", "record_kind")


def d9_purge(spark, sf_dir):
    """A nation's records go, and with them its customers' topics and the nation itself."""
    nodes, edges, records = _topics(spark, sf_dir)
    gone = spark.sql("SELECT concat('c', c_custkey) AS topic_id FROM customer WHERE c_nationkey = 3")
    file = F.when(F.col("__gone").isNotNull(), F.concat(F.lit("/d/x.md::part::"), F.col("id"))).otherwise(F.concat(F.lit("/d/y.md#"), F.col("id")))
    placed = records.join(gone.withColumn("__gone", F.lit(1)), "topic_id", "left").select("id", "topic_id", file.alias("doc_identifier"), F.lit(None).cast("string").alias("virtual_uri"))
    pairs = nodes.where("depth = 2").select(F.col("topic_id").alias("source_id"), F.lit("n0").alias("target_id"))
    out = lifecycle.purge_document(placed, nodes, edges, pairs, placed.select("id"), "/d/x.md")
    count = lambda name: out[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return count("records").unionByName(count("nodes")).unionByName(count("edges")).unionByName(count("bridges")).unionByName(count("vectors"))


def g11_note_links(spark, sf_dir):
    views.register(spark, sf_dir)
    made = spark.sql("SELECT concat('a/n', doc_id, '.md') AS path, concat('---\\ntype: ', CASE WHEN doc_id % 4 = 0 THEN 'adr' ELSE 'note' END, '\\nclearance: ', CASE doc_id % 5 WHEN 0 THEN 'restricted' ELSE 'internal' END, '\\n---\\n[x](../a/./n', doc_id + 1, '.md#top) ![i](n', doc_id + 2, '.md) [y](http://x/n1.md) `[z](n', doc_id + 3, '.md)` [w](file:///home/u/docs/wiki/a/n', doc_id + 4, '.md) [v](b/gone.md)') AS text FROM documents")
    return notes.edges(notes.parsed(made), 1)


def g12_ego(spark, sf_dir):
    views.register(spark, sf_dir)
    links = spark.table("relations").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    centres = spark.sql("SELECT concat('region:', r_regionkey) AS centre, 'entity' AS layer, concat('region:', r_regionkey) AS node FROM region")
    return notes.ego({"entity": links}, centres, 2, 20).select("centre", "node", F.col("level").cast("long").alias("level"), F.col("rank").cast("long").alias("rank"))


def j13_bridges(spark, sf_dir):
    views.register(spark, sf_dir)
    topics = spark.sql("SELECT doc_id AS topic_id, source AS package, text FROM documents")
    companions = spark.sql("SELECT DISTINCT a.source AS source_package, b.source AS target_package FROM (SELECT DISTINCT source FROM documents) a JOIN (SELECT DISTINCT source FROM documents) b ON a.source <> b.source")
    return bridges.nearest(topics, companions, 3, 0.5).select("source_id", "target_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _sources(spark):
    return spark.sql("SELECT DISTINCT a.source AS source_package, b.source AS target_package FROM (SELECT DISTINCT source FROM documents) a JOIN (SELECT DISTINCT source FROM documents) b ON a.source <> b.source")


def g16_refreshed_bridges(spark, sf_dir):
    """Bridges and terms of an earlier state, in which of ten documents one had another text, one was not there and one was of another source, brought up to date."""
    views.register(spark, sf_dir)
    now = spark.sql("SELECT doc_id AS topic_id, source AS package, text FROM documents")
    before = spark.sql("""SELECT doc_id AS topic_id, CASE WHEN doc_id % 10 = 5 THEN concat('src', doc_id % 3) ELSE source END AS package, CASE WHEN doc_id % 10 = 3 THEN reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7
      UNION ALL SELECT -1 - doc_id, source, text FROM documents WHERE doc_id % 10 = 1""")
    companions = _sources(spark)
    with workspace.Scratch(spark, "bridges") as scratch:
        held = scratch.put("terms", bridges.stored_terms(before))
        stored = scratch.put("bridges", bridges.among(held, companions, 3, 0.5))
        found = G.cut(bridges.refresh(stored, held, now, companions, 3, 0.5))
    return found.select("source_id", "target_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def g16_realtime_bridges(spark, sf_dir):
    """The benchmark's passages, which no index holds, with their nearest documents of each source."""
    views.register(spark, sf_dir)
    documents = spark.sql("SELECT doc_id AS topic_id, source AS package, text FROM documents")
    asked = spark.sql("SELECT item_id AS topic_id, 'benchmark' AS package, concat(text, ' unheard') AS text FROM benchmark")
    companions = spark.sql("SELECT DISTINCT 'benchmark' AS source_package, source AS target_package FROM documents")
    # Numbers of passages and documents overlap; passages are told apart by sign.
    asked = asked.withColumn("topic_id", -1 - F.col("topic_id"))
    with workspace.Scratch(spark, "bridges") as scratch:
        held = scratch.put("terms", bridges.stored_terms(documents))
        found = G.cut(bridges.realtime(asked, held, companions, 5, 0.3))
    return found.select((-1 - F.col("source_id")).alias("item_id"), "target_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _topology(spark, sf_dir):
    return topology.topology(_graph(spark, sf_dir), ("supplier", "part", "nation"), LEVEL, cap=425, core=18)


def g8_topology_nodes(spark, sf_dir):
    return _topology(spark, sf_dir)[0]


def g8_topology_edges(spark, sf_dir):
    return _topology(spark, sf_dir)[1]


def _structure(spark, sf_dir):
    """Three sources: src0 with a table of contents that lists half of its pages, all other documents in folders of their source, and src1 once more, which comes too late to claim any."""
    views.register(spark, sf_dir)
    records = spark.sql("SELECT doc_id AS id, concat('/', source, '/', lang, '/P', doc_id, '.html', CASE WHEN doc_id % 3 = 0 THEN '#part' ELSE '' END) AS uri FROM documents")
    listed = spark.sql("""SELECT concat('p', doc_id, '.html') AS page, concat('d', doc_id) AS topic, lang AS parent, concat('Page ', doc_id) AS name, doc_id AS place FROM documents WHERE source = 'src0' AND doc_id % 40 = 0
      UNION ALL SELECT DISTINCT NULL, lang, NULL, upper(lang), -1 FROM documents WHERE source = 'src0'""")
    return structure.apply(records, [structure.Source("guide", "/src0/", listed), structure.Source("files", "/"), structure.Source("late", "/src1/")])


def x2_structure_records(spark, sf_dir):
    return _structure(spark, sf_dir).records.select("id", "label", "topic_id", "record_kind", "review")


def x2_structure_nodes(spark, sf_dir):
    return _structure(spark, sf_dir).nodes.select("topic_id", "package", "name", F.col("depth").cast("long").alias("depth"))


def g12_fingerprints(spark, sf_dir):
    views.register(spark, sf_dir)
    out = None
    for name, columns in PRINTED.items():
        part = versions.fingerprint(spark.table(name).select(*columns), columns[0], 16).select(F.lit(name).alias("layer"), "bucket", "rows", F.col("print").cast("string").alias("print"))
        out = part if out is None else out.unionByName(part)
    return out


def g12_slice(spark, sf_dir):
    nodes, edges, records = _topics(spark, sf_dir)
    return versions.tree_slice(nodes, edges, records, 2, 2, budget=500).select("topic_id", F.col("level").cast("long").alias("level"))


#: Tables of the graph with the columns that their fingerprints cover; the first is the key.
PRINTED = {"records": ("id", "clearance", "content", "domain", "package", "title"), "entities": ("id", "kind", "name"), "relations": ("src", "dst", "relation"), "topic_nodes": ("topic_id", "depth", "name"), "topic_edges": ("child", "is_primary", "parent")}

QUERIES = {
    f.__name__: f
    for f in (
        g12_fingerprints, g12_slice,
        g1_find_entities, g2_neighbourhoods, g2_neighbourhood_edges, g2_neighbourhood_documents, g3_paths, g4_relations, g5_dossiers, g6_graph_statistics, g7_enriched, g17_ordered_paths, d4_index_again, d7_delete_cascade,
        d8_orphan_sweep, d8_purge_identifiers, d16_merge, p17_tree_visible, a12_tree_clearances, a5_themes, a11_tree_descendants, j10_tree_paths, g9_tree_nodes, g9_tree_edges, g13_tree_expand, g15_hierarchy, g15_children,
        g15_catalog, g12_find_topics, g12_meta, f35_layout, d12_path_tree, d13_assign, d9_purge, g11_note_links, g12_ego, j13_bridges,
        g16_refreshed_bridges, g16_realtime_bridges, g8_topology_nodes, g8_topology_edges, x2_structure_records, x2_structure_nodes,
    )
}

_V = views.with_views


def _peeled(body, rounds=12):
    """Peeling to 18 neighbours written out round by round, and a last row that the join below finds only when no node falls any more."""
    parts = ["""seen AS (SELECT id FROM entities WHERE clearance <= 2 AND kind IN ('supplier', 'part', 'nation')),
      every AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM relations WHERE clearance <= 2 AND src <> dst AND src IN (SELECT id FROM seen) AND dst IN (SELECT id FROM seen)),
      hubs AS (SELECT n FROM (SELECT a AS n FROM every UNION ALL SELECT b FROM every) GROUP BY n HAVING count(*) > 425),
      links AS (SELECT * FROM every WHERE a NOT IN (SELECT n FROM hubs) AND b NOT IN (SELECT n FROM hubs)), l0 AS (SELECT a AS n, b AS o FROM links UNION ALL SELECT b, a FROM links)"""]
    for i in range(1, rounds + 1):
        parts.append(f"k{i} AS MATERIALIZED (SELECT n FROM l{i - 1} GROUP BY n HAVING count(*) >= 18), l{i} AS MATERIALIZED (SELECT n, o FROM l{i - 1} WHERE n IN (SELECT n FROM k{i}) AND o IN (SELECT n FROM k{i}))")
    parts.append(f"core AS (SELECT n AS norm, count(*) AS degree FROM l{rounds} WHERE (SELECT min(c) FROM (SELECT count(*) AS c FROM l{rounds} GROUP BY n)) >= 18 GROUP BY n)")
    return f"WITH {', '.join(parts)} {body}"


def _prints(name):
    columns = PRINTED[name]
    cell = lambda c: f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    number = lambda text: f"CAST('0x' || md5({text})[1:15] AS BIGINT)"
    text = " || ".join(cell(c) for c in sorted(columns))
    key = "coalesce(CAST({} AS VARCHAR), '')".format(columns[0])
    return f"SELECT '{name}' AS layer, CAST({number(key)} % 16 AS INTEGER) AS bucket, count(*) AS rows, CAST(sum({number(text)}) AS VARCHAR) AS print FROM {name} GROUP BY ALL"


_NEAR = f"""e AS (SELECT * FROM entities WHERE clearance <= {LEVEL}), x AS (SELECT DISTINCT r.src, r.dst, r.relation FROM relations r JOIN e a ON a.id = r.src JOIN e b ON b.id = r.dst WHERE r.clearance <= {LEVEL}),
  l0 AS (SELECT id AS n FROM e WHERE kind = 'region'), l1 AS (SELECT DISTINCT src AS n FROM x JOIN l0 ON dst = n), l2 AS (SELECT DISTINCT src AS n FROM x JOIN l1 ON dst = n WHERE src NOT IN (SELECT n FROM l0)),
  near AS (SELECT n, 0 AS level FROM l0 UNION ALL SELECT n, 1 FROM l1 UNION ALL SELECT n, 2 FROM l2)"""
_TREE = """own AS (SELECT concat('c', o_custkey) AS topic_id, min(o_orderkey % 4) AS c FROM orders GROUP BY 1), nat AS (SELECT n_nationkey AS k, n_regionkey AS r, min(c) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN own ON topic_id = 'c' || c_custkey GROUP BY 1, 2),
  reg AS (SELECT r_regionkey AS k, min(c) AS c FROM region LEFT JOIN nat ON r = r_regionkey GROUP BY 1), lev AS (SELECT 'r' || k AS topic_id, coalesce(c, 3) AS clearance, NULL AS up FROM reg UNION ALL SELECT 'n' || nat.k, coalesce(nat.c, reg.c, 3), 'r' || nat.r FROM nat JOIN reg ON reg.k = nat.r
  UNION ALL SELECT 'c' || c_custkey, coalesce(own.c, nat.c, reg.c, 3), 'n' || c_nationkey FROM customer LEFT JOIN own ON topic_id = 'c' || c_custkey JOIN nat ON nat.k = c_nationkey JOIN reg ON reg.k = nat.r)"""
_THEME = """con AS (SELECT 'c' || o_custkey AS topic_id, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2), top AS (SELECT topic_id, arg_min(p, (-n, p)) AS theme FROM con GROUP BY 1)"""
_DESC = "kids AS (SELECT 'n' || c_nationkey AS topic_id, count(*) AS n FROM customer GROUP BY 1), grand AS (SELECT 'r' || n_regionkey AS topic_id, count(DISTINCT n_nationkey) + count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), d AS (SELECT * FROM kids UNION ALL SELECT * FROM grand)"
_EDGE_COUNTS = """k AS (SELECT 'CHILD_OF' AS kind, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'SECOND_PARENT', count(*) FROM customer WHERE c_custkey % 10 = 0
  UNION ALL SELECT 'NEXT_TOPIC', (SELECT count(*) - 1 FROM region) + (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey) t) + (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey) t))"""
ORACLES = {
    "g1_find_entities": """SELECT c_custkey AS question, CASE WHEN c_custkey % 5 = 1 THEN 'region:2' WHEN c_custkey % 5 IN (0, 2) THEN 'customer:' || c_custkey
        WHEN c_custkey % 5 = 3 THEN 'customer:' || c_custkey
        ELSE (SELECT 'customer:' || b.c_custkey FROM customer b LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) o ON o.o_custkey = b.c_custkey WHERE ('customer:' || b.c_custkey) LIKE ('%ustomer:' || a.c_custkey || '%') ORDER BY coalesce(o.n, 0) DESC, length(b.c_custkey::VARCHAR), 'customer:' || b.c_custkey LIMIT 1) END AS norm,
        CAST([2, 1, 2, 4, 3][c_custkey % 5 + 1] AS INTEGER) AS step FROM customer a""",
    "g2_neighbourhoods": _V(f"WITH {_NEAR} SELECT n AS norm, min(level) AS level FROM near GROUP BY n"),
    "g2_neighbourhood_edges": _V(f"WITH {_NEAR}, m AS (SELECT n, min(level) AS level FROM near GROUP BY n) SELECT src AS source, dst AS target, relation, least(a.level, b.level) AS level FROM x JOIN m a ON a.n = src JOIN m b ON b.n = dst WHERE least(a.level, b.level) < 2"),
    "g2_neighbourhood_documents": _V(f"WITH {_NEAR} SELECT id AS doc_id, doc_identifier AS identifier FROM graph_docs WHERE clearance <= {LEVEL} AND id IN (SELECT doc_id FROM doc_entities WHERE entity_id IN (SELECT n FROM near))"),
    "g3_paths": "SELECT 'customer:' || c_custkey AS norm, 2 AS level, 'region:' || n_regionkey || ' > IN_REGION (rev) > nation:' || n_nationkey || ' > IN_NATION (rev) > customer:' || c_custkey AS steps FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "g4_relations": _V(f"SELECT n_name AS source_name, 'IN_REGION' AS relation, r_name AS target_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 4 <= {LEVEL} AND r_regionkey % 4 <= {LEVEL}"),
    "g5_dossiers": f"""WITH o AS (SELECT * FROM orders WHERE o_orderkey % 4 <= {LEVEL} AND o_custkey % 4 >= 0), c AS (SELECT 'customer:' || c_custkey AS norm, c_custkey FROM customer),
      f AS (SELECT o_custkey, count(*) AS n, count(DISTINCT CAST(o_orderdate AS DATE)) AS d, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first FROM o GROUP BY 1), p AS (SELECT o_custkey, count(DISTINCT l_partkey) AS n FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 4 <= {LEVEL} GROUP BY 1)
      SELECT norm, coalesce(f.n, 0) AS n_documents, coalesce(f.d, 0) AS n_dates, first AS first_date, CASE WHEN f.n IS NULL THEN 0e0 ELSE c.c_custkey % 7 + 0.5e0 END AS total_amount, coalesce(p.n, -1) AS n_parts FROM c LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN p ON p.o_custkey = c_custkey""",
    "g6_graph_statistics": _V("SELECT 'documents' AS what, NULL AS kind, count(*) AS n FROM graph_docs UNION ALL SELECT 'relations', NULL, count(*) FROM relations UNION ALL SELECT 'entities', kind, count(*) FROM entities GROUP BY kind"),
    "g7_enriched": """WITH s AS (SELECT 'supplier:' || s_suppkey AS root, 'IN_NATION' AS relation, 'nation:' || n_nationkey AS norm, n_name AS name, 7 AS p FROM supplier JOIN nation ON n_nationkey = s_nationkey
        UNION ALL SELECT 'supplier:' || l_suppkey, 'MEASURED_BY_COUNTER', min('part:' || p_partkey), p_name, CASE WHEN regexp_matches(upper(p_name), 'RTR|AAD|ADEV|SCTP|THRESHOLD|DELAY|SUCCESS') THEN 5 ELSE 6 END FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, p_name),
      k AS (SELECT *, row_number() OVER (PARTITION BY root, relation ORDER BY p, name) AS c FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY p, name, relation) AS place FROM k WHERE relation = 'IN_NATION' OR c <= 8)
      SELECT root, relation, 'outgoing' AS direction, norm, place, CASE relation WHEN 'IN_NATION' THEN 'CAUSED_BY' ELSE relation END AS bucket FROM r WHERE place <= 24""",
    "g17_ordered_paths": "SELECT c_custkey AS path, 0 AS step, 'customer:' || c_custkey AS source, 'region:' || n_regionkey AS target, 'nation:' || n_nationkey AS via, 'IN_NATION' AS first_relation, 'IN_REGION' AS second_relation FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, 1, 'nation:' || c_nationkey, 'customer:' || c_custkey, NULL, 'IN_NATION (rev)', NULL FROM customer",
    "d4_index_again": _V("""WITH f AS (SELECT * FROM graph_docs WHERE id % 3 = 0), p AS (SELECT count(*) AS n FROM doc_entities WHERE doc_id % 3 <> 0) SELECT 'documents' AS what, (SELECT count(*) FROM graph_docs) AS n, (SELECT count(*) FROM f) AS m
      UNION ALL SELECT 'entities', (SELECT count(*) FROM entities) + (SELECT count(DISTINCT id % 5) FROM f), (SELECT max(id % 4) FROM f) UNION ALL SELECT 'postings', (SELECT n FROM p) + (SELECT count(*) FROM f), 2 * (SELECT count(*) FROM f)
      UNION ALL SELECT 'relations', (SELECT count(*) FROM relations) + (SELECT count(*) FROM f), (SELECT count(*) FROM f)"""),
    "d7_delete_cascade": _V("SELECT entity_id AS norm, CAST(sum(n) AS BIGINT) AS n FROM doc_entities WHERE doc_id % 2 = 1 GROUP BY entity_id"),
    "d8_orphan_sweep": _V("SELECT id AS norm, kind FROM entities WHERE kind = 'supplier' OR (kind = 'customer' AND id NOT IN (SELECT 'customer:' || o_custkey FROM orders WHERE o_orderkey % 5 = 4)) OR (kind = 'part' AND id NOT IN (SELECT 'part:' || l_partkey FROM lineitem WHERE l_orderkey % 5 = 4))"),
    "d8_purge_identifiers": "SELECT o_orderkey AS doc_id, 'INC-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS identifier FROM orders WHERE o_orderkey >= 100",
    "d16_merge": _V("""SELECT 'document' AS what, CAST(id AS VARCHAR) AS key, CASE WHEN id % 4 = 0 THEN 'new' ELSE corpus END AS value FROM graph_docs UNION ALL SELECT 'entity', id, kind || '/' || greatest(clearance, 3 - clearance) FROM entities
      UNION ALL SELECT 'posting', entity_id, CAST(CAST(sum(CASE WHEN doc_id % 2 = 0 THEN n + 1 ELSE n END) AS BIGINT) AS VARCHAR) FROM doc_entities GROUP BY entity_id UNION ALL SELECT 'relation', relation, CAST(count(*) AS VARCHAR) FROM relations GROUP BY relation"""),
    "g12_fingerprints": _V(" UNION ALL ".join(map(_prints, PRINTED))),
    "g12_slice": f"WITH {_TREE}, v AS (SELECT a.topic_id FROM lev a LEFT JOIN lev b ON b.topic_id = a.up LEFT JOIN lev c ON c.topic_id = b.up WHERE a.clearance <= 2 AND coalesce(b.clearance, 0) <= 2 AND coalesce(c.clearance, 0) <= 2), r AS (SELECT topic_id, CASE topic_id[1] WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END AS level FROM v) SELECT topic_id, CAST(level AS BIGINT) AS level FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY topic_id) AS place FROM r) WHERE place <= 500",
    "p17_tree_visible": f"WITH {_TREE} SELECT a.topic_id FROM lev a LEFT JOIN lev b ON b.topic_id = a.up LEFT JOIN lev c ON c.topic_id = b.up WHERE a.clearance <= 1 AND coalesce(b.clearance, 0) <= 1 AND coalesce(c.clearance, 0) <= 1",
    "a12_tree_clearances": f"WITH {_TREE} SELECT topic_id, CAST(clearance AS INTEGER) AS clearance FROM lev",
    "a5_themes": _V(f"WITH {_THEME} SELECT n.topic_id, coalesce(theme, '') AS theme FROM topic_nodes n LEFT JOIN top ON top.topic_id = n.topic_id"),
    "a11_tree_descendants": f"WITH {_DESC} SELECT topic_id, n AS n_desc FROM d",
    "j10_tree_paths": "SELECT 'r' || r_regionkey AS topic_id, r_name AS path, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, r_name || ' > ' || n_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'c' || c_custkey, r_name || ' > ' || n_name || ' > ' || c_name, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    "g9_tree_nodes": _V(f"WITH {_THEME}, {_DESC} SELECT n.topic_id, coalesce(theme, '') AS theme, coalesce(d.n, 0) AS n_desc FROM topic_nodes n LEFT JOIN top ON top.topic_id = n.topic_id LEFT JOIN d ON d.topic_id = n.topic_id"),
    "g9_tree_edges": f"WITH {_EDGE_COUNTS}, s AS (SELECT least(3, count(*) - 1) AS n FROM customer GROUP BY c_custkey % 20) SELECT kind, CAST(n AS BIGINT) AS n FROM k UNION ALL SELECT 'SHARED_ALARM', CAST(sum(n) AS BIGINT) FROM s",
    "g13_tree_expand": "SELECT 'r' || r_regionkey AS topic_id, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation",
    "g15_hierarchy": _V("WITH p AS (SELECT child AS topic_id, parent, coalesce(parent, 'star') AS g FROM topic_edges WHERE is_primary = 1), k AS (SELECT parent, count(*) AS n FROM topic_edges WHERE is_primary = 1 GROUP BY parent) SELECT topic_id, p.parent, lag(topic_id) OVER w AS previous, lead(topic_id) OVER w AS following, count(*) OVER (PARTITION BY g) AS n_siblings, coalesce(k.n, 0) AS n_children FROM p LEFT JOIN k ON k.parent = topic_id WINDOW w AS (PARTITION BY g ORDER BY topic_id)"),
    "g15_children": _V("SELECT e.parent, e.child AS topic_id, n.name, n.depth, (SELECT count(DISTINCT x.child) FROM topic_edges x WHERE x.parent = e.child) AS child_count FROM topic_edges e JOIN topic_nodes n ON n.topic_id = e.child WHERE e.is_primary = 1 AND e.parent IS NOT NULL"),
    "g15_catalog": f"WITH {_DESC} SELECT 'star' AS package, 'r' || r_regionkey AS topic_id, r_name AS name, coalesce(d.n, 0) AS topic_count FROM region LEFT JOIN d ON d.topic_id = 'r' || r_regionkey",
    "g12_find_topics": _V("""WITH a AS (SELECT r_regionkey AS question, lower(substring(r_name, 1, 4)) AS t FROM region UNION ALL SELECT 100 + n_nationkey, lower(substring(n_name, 2, 2)) FROM nation),
      h AS (SELECT question, topic_id, name, depth, CASE WHEN lower(name) = t THEN 0 WHEN lower(name) LIKE t || '%' THEN 1 ELSE 2 END AS how FROM a JOIN topic_nodes ON instr(lower(name), trim(t)) > 0),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY how, depth, name, topic_id) AS INTEGER) AS rank FROM h) SELECT question, topic_id, name, how, rank FROM r WHERE rank <= 5"""),
    "g12_meta": _V(f"WITH {_EDGE_COUNTS}, {_THEME} SELECT kind AS what, CAST(n AS BIGINT) AS n FROM k UNION ALL SELECT 'theme ' || coalesce(theme, ''), count(*) FROM topic_nodes t LEFT JOIN top ON top.topic_id = t.topic_id GROUP BY 1"),
    "d12_path_tree": "SELECT 'src:path:' AS topic_id, 'src' AS name, CAST(1 AS BIGINT) AS depth, NULL AS parent UNION ALL SELECT 'src:path:a', 'a', 2, 'src:path:' UNION ALL SELECT DISTINCT 'src:path:a/b' || page_id % 7, 'b' || page_id % 7, 3, 'src:path:a' FROM pages UNION ALL SELECT 'src:path:a/b' || page_id % 7 || '/' || page_id || '.html', page_id || '.html', 4, 'src:path:a/b' || page_id % 7 FROM (SELECT DISTINCT page_id FROM pages) p",
    "d13_assign": "WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN least('a' || o_orderkey % 10, 'b' || o_orderkey % 10) ELSE 'a' || o_orderkey % 10 END AS topic_id FROM orders) SELECT id, topic_id, CASE WHEN id = min(id) OVER (PARTITION BY topic_id) THEN 'native' ELSE 'composite' END AS record_kind FROM a",
    "d9_purge": _V("""WITH g AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_custkey IN (SELECT o_custkey FROM orders)), whole AS (SELECT count(*) = (SELECT count(*) FROM customer WHERE c_nationkey = 3) AND (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0 AND (c_nationkey + 1) % 25 = 3) = 0 AS w FROM g),
      t AS (SELECT count(*) AS n FROM g), o AS (SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g)), second AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 10 = 0 AND c_custkey IN (SELECT c_custkey FROM g))
      SELECT 'records' AS what, n FROM o UNION ALL SELECT 'vectors', n FROM o UNION ALL SELECT 'nodes', (SELECT count(*) FROM topic_nodes) - n - CASE WHEN w THEN 1 ELSE 0 END FROM t, whole
      UNION ALL SELECT 'edges', (SELECT count(*) FROM topic_edges) - t.n - second.n - CASE WHEN w THEN 1 ELSE 0 END FROM t, whole, second UNION ALL SELECT 'bridges', (SELECT count(*) FROM customer) - n FROM t"""),
    "g11_note_links": """WITH d AS (SELECT doc_id AS i, doc_id % 4 = 0 AS adr FROM documents WHERE doc_id % 5 <> 0), l AS (SELECT i, adr, i + 1 AS j FROM d UNION SELECT i, adr, i + 4 FROM d)
      SELECT DISTINCT 'a/n' || l.i || '.md' AS source, 'a/n' || d.i || '.md' AS target, CASE WHEN d.adr AND NOT l.adr THEN 'GOVERNED_BY' ELSE 'LINKS_TO' END AS kind FROM l JOIN d ON d.i = l.j""",
    "g12_ego": """WITH l AS (SELECT 'region:' || r_regionkey AS centre, 'region:' || r_regionkey AS node, 0 AS level FROM region UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, 1 FROM nation UNION ALL SELECT 'region:' || n_regionkey, 'customer:' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey
      UNION ALL SELECT 'region:' || n_regionkey, 'supplier:' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY level, node) AS rank FROM l) SELECT centre, node, level, rank FROM r WHERE rank <= 20""",
    "j13_bridges": rf"""WITH w AS (SELECT doc_id, source, trim(unnest(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\pL\pM\pN_\s\-]', ' ', 'g'), '\s+')), '-') AS t, unnest(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\pL\pM\pN_\s\-]', ' ', 'g'), '\s+')) AS raw FROM documents),
      c AS (SELECT doc_id, source, t, 1 + ln(count(*)) AS w FROM w WHERE length(raw) > 2 AND t NOT IN ({", ".join(f"'{x}'" for x in bridges.STOP_WORDS)}) GROUP BY ALL), v AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, source)) AS x FROM c),
      p AS (SELECT a.doc_id AS source_id, b.doc_id AS target_id, round(sum(a.x * b.x), 9) AS s FROM v a JOIN v b ON a.t = b.t AND a.source <> b.source GROUP BY 1, 2 HAVING round(sum(a.x * b.x), 9) >= 0.5),
      r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s DESC, target_id) AS rank FROM p) SELECT source_id, target_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 3""",
    "g16_realtime_bridges": rf"""WITH d AS (SELECT 'd' AS side, doc_id AS id, source, text FROM documents UNION ALL SELECT 'b', item_id, '', text || ' unheard' FROM benchmark),
      w AS (SELECT side, id, source, unnest(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\pL\pM\pN_\s\-]', ' ', 'g'), '\s+')) AS raw FROM d),
      c AS (SELECT side, id, source, trim(raw, '-') AS t, 1 + ln(count(*)) AS w FROM w WHERE length(raw) > 2 AND trim(raw, '-') NOT IN ({", ".join(f"'{x}'" for x in bridges.STOP_WORDS)}) GROUP BY ALL), v AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY side, id, source)) AS x FROM c),
      p AS (SELECT a.id AS item_id, b.id AS target_id, round(sum(a.x * b.x), 9) AS s FROM v a JOIN v b ON a.t = b.t AND a.side = 'b' AND b.side = 'd' GROUP BY 1, 2 HAVING round(sum(a.x * b.x), 9) >= 0.3),
      r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, target_id) AS rank FROM p) SELECT item_id, target_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 5""",
    "g8_topology_nodes": _V(_peeled("SELECT id AS norm, name, kind, degree FROM core JOIN entities ON id = core.norm")),
    "g8_topology_edges": _V(_peeled("SELECT DISTINCT src AS source, dst AS target, relation FROM relations r JOIN links ON least(src, dst) = a AND greatest(src, dst) = b JOIN core x ON x.norm = a JOIN core y ON y.norm = b WHERE r.clearance <= 2")),
    "x2_structure_records": """WITH u AS (SELECT doc_id AS id, source = 'src0' AS guide, source = 'src0' AND doc_id % 40 = 0 AS listed, '/' || lang || '/P' || doc_id || '.html' AS rest, source, lang, doc_id % 3 = 0 AS part FROM documents)
      SELECT id, CASE WHEN guide THEN 'guide' ELSE 'files' END AS label, CASE WHEN listed THEN 'guide:d' || id WHEN NOT guide THEN 'files:path:' || source || rest END AS topic_id,
        CASE WHEN listed OR NOT guide THEN 'native' ELSE 'composite' END AS record_kind, CASE WHEN guide AND NOT listed THEN 'page not listed' ELSE '' END AS review FROM u""",
    "x2_structure_nodes": """WITH f AS (SELECT * FROM documents WHERE source <> 'src0'), g AS (SELECT * FROM documents WHERE source = 'src0')
      SELECT 'files:path:' AS topic_id, 'files' AS package, 'files' AS name, 1 AS depth FROM f UNION SELECT 'files:path:' || source, 'files', source, 2 FROM f UNION SELECT 'files:path:' || source || '/' || lang, 'files', lang, 3 FROM f
      UNION SELECT 'files:path:' || source || '/' || lang || '/P' || doc_id || '.html', 'files', 'P' || doc_id || '.html', 4 FROM f
      UNION SELECT 'guide:' || lang, 'guide', upper(lang), 1 FROM g UNION SELECT 'guide:d' || doc_id, 'guide', 'Page ' || doc_id, 2 FROM g WHERE doc_id % 40 = 0""",
}
ORACLES["g16_refreshed_bridges"] = ORACLES["j13_bridges"]
