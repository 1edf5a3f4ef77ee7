"""Lookup, ranking, measures, duplicates and the life of records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle, lookup, measures, minhash, search
from ..operators import retrieval as R
from . import views

CLEARANCE = 2


def _records(spark, sf_dir):
    views.register(spark, sf_dir)
    return spark.table("records")


def _questions(spark):
    return spark.table("benchmark").select(F.col("item_id").alias("question"), "text")


def p8_match(spark, sf_dir):
    """For each passage: records that hold its first two words as a phrase and its fourth word, or its words three to five as a phrase."""
    records = _records(spark, sf_dir).where(F.col("clearance") <= CLEARANCE)
    words = _questions(spark).select("question", R.terms(F.col("text")).alias("w"))
    cut = lambda a, n: F.slice("w", a, n)
    clause = lambda branch, phrase, terms: F.struct(F.lit(branch).alias("branch"), F.lit(phrase).alias("phrase"), terms.alias("terms"))
    clauses = words.select("question", F.inline(F.array(clause(0, 0, cut(1, 2)), clause(0, 1, cut(4, 1)), clause(1, 0, cut(3, 3)))))
    return lookup.match(records, clauses).select("question", "id").distinct()


def r1_exact_lookup(spark, sf_dir):
    """Every record is asked for by its identifier; numbers of identifiers occur in no text, so each finds itself and nothing else."""
    records = _records(spark, sf_dir)
    asked = records.select(F.col("id").alias("question"), F.lower("doc_identifier").alias("raw"), F.col("doc_identifier").alias("norm"), F.lit("").alias("text"))
    found = lookup.exact_lookup(records, asked, CLEARANCE)
    return found.where("source = 'identifier'").select("question", "id", "score", F.col("rank").cast("long").alias("rank"))


def r2_neighbours(spark, sf_dir):
    views.register(spark, sf_dir)
    records = spark.sql("SELECT o_orderkey AS id, concat('REC-', o_orderkey) AS doc_identifier, concat('ALM-', 20000 + o_orderkey % 900, ' link') AS title, '' AS content, CAST(o_orderkey % 4 AS INT) AS clearance FROM orders")
    asked = spark.sql("SELECT c_custkey AS question, concat('ALM-', 20000 + c_custkey % 900) AS norm FROM customer")
    return lookup.number_neighbours(records, asked, CLEARANCE, 4).select("question", "identifier", "distance", F.col("rank").cast("long").alias("rank"))


def r2_commands(spark, sf_dir):
    views.register(spark, sf_dir)
    records = spark.sql("SELECT o_orderkey AS id, concat('REC-', o_orderkey) AS doc_identifier, concat('use DSP OPTM', chr(65 + CAST(o_orderkey % 26 AS INT)), 'X here') AS title, '' AS content, CAST(o_orderkey % 4 AS INT) AS clearance FROM orders")
    asked = spark.sql("SELECT c_custkey AS question, CASE WHEN c_custkey % 2 = 0 THEN concat('dsp  optm', chr(65 + CAST(c_custkey % 26 AS INT)), 'x') ELSE 'LST OPTMAX' END AS norm FROM customer")
    return lookup.similar_commands(records, asked, CLEARANCE, 3).select("question", "identifier", F.col("rank").cast("long").alias("rank"))


def r3_cascade(spark, sf_dir):
    """Every passage asks. SQL for the stages would be the operator again; tests hold it against plain Python."""
    return lookup.cascade(_records(spark, sf_dir), _questions(spark), CLEARANCE).select("question", "id", "score", "band", "overlap", F.col("stage").cast("long").alias("stage"), F.col("rank").cast("long").alias("rank"))


def r6_route(spark, sf_dir):
    """Each record's identifier and each passage as a question, by its route."""
    records = _records(spark, sf_dir).withColumn("doc_identifier", F.concat(F.lit("TCK-"), F.col("id") + 1000))
    asked = records.select(F.col("id").alias("question"), F.concat(F.lit("state of "), "doc_identifier").alias("text")).unionByName(_questions(spark).withColumn("question", -F.col("question") - 1))
    return lookup.route(records, asked, CLEARANCE).select("question", "route_type", "id", F.col("part").cast("long").alias("part"), F.col("rank").cast("long").alias("rank"))


_HITS = "SELECT o_custkey AS question, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, concat('t', o_orderkey % 3) AS topic_id, CASE WHEN o_orderkey % 4 = 0 THEN 'native' ELSE 'composite' END AS record_kind, CASE WHEN o_orderkey % 2 = 0 THEN 'alpha beta' ELSE 'alpha gamma delta' END AS content FROM orders"


def r8_one_per_document(spark, sf_dir):
    views.register(spark, sf_dir)
    out = lookup.one_per_document(spark.sql(_HITS), F.col("topic_id"), F.col("record_kind") == "native")
    return out.select("question", "id", F.col("rank").cast("long").alias("rank"))


def r8_fold(spark, sf_dir):
    views.register(spark, sf_dir)
    out = lookup.fold_duplicates(spark.sql(_HITS), 0.5)
    return out.select("question", "id", "collapsed", F.col("rank").cast("long").alias("rank"))


def u5_first_of(spark, sf_dir):
    views.register(spark, sf_dir)
    hits = spark.sql(_HITS).withColumn("score", F.lit(1.0))
    return lookup.first_of(hits.where("id % 2 = 0"), hits).select("question", "id", F.col("part").cast("long").alias("part"), F.col("rank").cast("long").alias("rank"))


SCOPES = {"english": {"domain": ["en"], "title": []}, "the": {"domain": [], "title": ["the"], "doc_identifier": ["doc-7"]}}


def p9_scopes(spark, sf_dir):
    records = _records(spark, sf_dir)
    one = lambda name: lookup.in_domain(records, SCOPES, name).groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("scope"), "n")
    return one("english").unionByName(one("The ")).unionByName(one("*"))


def f9_scores(spark, sf_dir):
    views.register(spark, sf_dir)
    t, b = F.col("vec_id") % 5, F.col("vec_id") % 9
    return spark.table("embeddings").select("vec_id", lookup.overlap_score(t, b, F.col("vec_id") * 10).cast("double").alias("overlap"), F.round(lookup.calibrated(t, b, F.lit(8)), 3).alias("score"))


def r4_search(spark, sf_dir):
    """Every twentieth record's vector and every passage of the same number ask in the mode for exact entities; legs and fusion have their own SQL."""
    records = _records(spark, sf_dir)
    vectors = spark.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = vectors.where("id % 20 = 0").select(F.col("id").alias("question"), F.col("v").alias("q"))
    return search.search(records, vectors, _questions(spark), asked, search.Mode(5, "exact_entity", "relational_audit"), CLEARANCE, 64).select("question", "id", "score", "confidence", "rank")


def f8_top_confidence(spark, sf_dir):
    views.register(spark, sf_dir)
    hits = spark.sql("SELECT vec_id % 50 AS question, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE vec_id / 1e4 END AS confidence, vec_id / 2e4 AS score FROM embeddings")
    return search.top_confidence(hits)


_EVIDENCE = "SELECT c.*, rank_ AS rank FROM (SELECT conv_id AS question, role AS title, CASE WHEN turn % 2 = 0 THEN 'Part' ELSE '' END AS heading, concat('p', turn) AS path, text, 0.25 AS score, 1 AS clearance, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank_ FROM conversations) c WHERE rank_ <= 3"


def r9_evidence(spark, sf_dir):
    views.register(spark, sf_dir)
    packed = search.evidence(spark.sql(_EVIDENCE), posture="scholarly")
    return packed.select("question", F.md5("context").alias("digest"), "tokens", "baseline_tokens", F.size("citations").cast("long").alias("n"), F.element_at("citations", 1)["footnote"].alias("footnote"))


def r11_two_level(spark, sf_dir):
    """Passages of conversations by two ranked lists, their conversations as chapters; lists are made from numbers."""
    views.register(spark, sf_dir)
    chunk = lambda m: spark.sql(f"SELECT vec_id % 30 AS question, vec_id AS id, row_number() OVER (PARTITION BY vec_id % 30 ORDER BY (vec_id * {m}) % 1009, vec_id) AS rank FROM embeddings").where("rank <= 20")
    upper = lambda m: spark.sql(f"SELECT q AS question, label AS id, row_number() OVER (PARTITION BY q ORDER BY (label * {m}) % 11, label) AS rank FROM (SELECT DISTINCT vec_id % 30 AS q, label FROM embeddings) t")
    parents = spark.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("parent"))
    _, chunks = search.two_level((upper(3), upper(7)), (chunk(17), chunk(29)), parents)
    return chunks.select("question", "id", "parent", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def f36_answers(spark, sf_dir):
    """Every passage is asked of its five nearest records by words; no SQL splits sentences the same way, so tests hold this."""
    records = _records(spark, sf_dir)
    hits = R.bm25(records, _questions(spark), 5, CLEARANCE).join(records.select("id", F.col("content").alias("text")), "id").withColumn("confidence", F.when(F.col("question") % 3 > 0, F.lit(0.9)).otherwise(F.lit(0.2)))
    return search.answers(_questions(spark), hits)


def f36_tables(spark, sf_dir):
    views.register(spark, sf_dir)
    rows = spark.sql("SELECT o_orderkey AS id, concat('a\n| x | y |\n', CASE o_orderkey % 3 WHEN 0 THEN '|---|---|\n| 1 | 2 |' WHEN 1 THEN '| 3 | 4 |' ELSE '' END, '\nb\n| alone |\nc') AS text FROM orders")
    return rows.select("id", F.array_join(search.tables(F.col("text")), "//").alias("found"))


def a20_word_tokens(spark, sf_dir):
    return _records(spark, sf_dir).select("id", search.word_tokens(F.col("content")).alias("tokens"))


def a21_latencies(spark, sf_dir):
    views.register(spark, sf_dir)
    out = measures.latencies(spark.table("events").withColumn("ms", F.col("value").cast("double")), "ms", "event_type", exact=True)
    return out.select("event_type", "n", *(F.round(c, 4).alias(c) for c in ("mean", "p50", "p95", "highest")))


def a22_quality(spark, sf_dir):
    views.register(spark, sf_dir)
    hits = spark.sql("SELECT vec_id % 40 AS question, vec_id AS id, row_number() OVER (PARTITION BY vec_id % 40 ORDER BY vec_id) AS rank FROM embeddings")
    return measures.quality(measures.ranks(hits, hits.join(spark.table("embeddings").where("label = 3").select(F.col("vec_id").alias("id")), "id", "left_semi").unionByName(hits.where("question = 1").select("question", F.lit(-1).cast("long").alias("id"), "rank")).select("question", "id")))


def a23_coverage_share(spark, sf_dir):
    views.register(spark, sf_dir)
    hits = spark.sql("SELECT vec_id % 40 AS question, label FROM embeddings WHERE vec_id % 3 = 0")
    return measures.coverage(hits, "label", spark.table("embeddings"))


def _texts(spark, sf_dir):
    views.register(spark, sf_dir)
    return spark.table("documents").select("doc_id", "text")


def a24_signatures(spark, sf_dir):
    """DuckDB has no CRC-32; tests hold signatures against Python's."""
    return minhash.signed(_texts(spark, sf_dir))


def j14_near_pairs(spark, sf_dir):
    _, pairs = minhash.near_pairs(_texts(spark, sf_dir))
    return pairs


def r16_first_kept(spark, sf_dir):
    return minhash.first_kept(_texts(spark, sf_dir))


_FILES = "SELECT concat('/d/f', doc_id, '.md') AS uri, md5(CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END) AS sha256, CASE WHEN doc_id % 13 = 0 THEN CAST(NULL AS STRING) ELSE 'text' END AS format, length(text) * CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS new_chars FROM documents"
_HELD = "SELECT doc_id * 2 + part AS id, concat('/d/f', doc_id, '.md', CASE part WHEN 0 THEN '::part::0001' ELSE '#x' END) AS doc_identifier, CASE part WHEN 0 THEN text ELSE '' END AS content, md5(text) AS source_sha256 FROM documents CROSS JOIN (SELECT 0 AS part UNION ALL SELECT 1) p WHERE doc_id % 3 > 0"


def d10_decisions(spark, sf_dir):
    views.register(spark, sf_dir)
    files, held = spark.sql(_FILES), spark.sql(_HELD)
    out = None
    for mode in lifecycle.MODES:
        own = lifecycle.decide(files, held, mode).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.sum("old_chars").cast("long").alias("old_chars")).withColumn("mode", F.lit(mode))
        out = own if out is None else out.unionByName(own)
    return out


def d10_ingest(spark, sf_dir):
    views.register(spark, sf_dir)
    held = spark.sql(_HELD)
    chunks = spark.sql("SELECT concat('/d/f', doc_id, '.md') AS uri, 1000000 + doc_id AS id, concat('/d/f', doc_id, '.md::part::0001') AS doc_identifier, 'new' AS content, 'h' AS source_sha256 FROM documents")
    records, _ = lifecycle.ingest(held, spark.sql(_FILES), chunks, "changed")
    return records.select("id", "doc_identifier", "source_sha256")


def d11_owned(spark, sf_dir):
    views.register(spark, sf_dir)
    return lifecycle.owned(spark.sql(_HELD), spark.sql("SELECT concat('/d/f', doc_id, '.md') AS uri FROM documents WHERE doc_id < 100 OR doc_id >= 0")).select("uri", "id")


def d3_purge(spark, sf_dir):
    records = _records(spark, sf_dir).withColumn("metadata", F.concat(F.lit('{"from": "'), "topic_id", F.lit('"}')))
    kept, purged = lifecycle.purge_prefix(records, "EN/SRC1")
    return kept.select("id", F.lit("kept").alias("state")).unionByName(purged.select("id", F.lit("purged").alias("state")))


def d14_relocations(spark, sf_dir):
    records = _records(spark, sf_dir).select("id", F.col("topic_id").alias("virtual_uri"), "doc_identifier")
    return lifecycle.relocate(records, "en/", "english/")


def d15_capped_sync(spark, sf_dir):
    views.register(spark, sf_dir)
    files = spark.table("documents").select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), "text")
    return lifecycle.capped_sync(files, 7, 500).select("source", "path", F.length("text").cast("long").alias("n"), "truncated")


def d15_remove(spark, sf_dir):
    records = _records(spark, sf_dir).withColumn("virtual_uri", F.concat(F.lit("/"), "topic_id", F.lit("/x")))
    return lifecycle.remove_source(records, "/en").select("id")


def d19_enrich(spark, sf_dir):
    records = _records(spark, sf_dir)
    texts = records.select("doc_identifier", F.when(F.col("id") % 2 == 0, F.concat("content", F.lit("+"))).otherwise(F.lit("x")).alias("text"))
    return lifecycle.enrich(records, texts).select("id", "enriched", F.length("content").cast("long").alias("n"))


def d19_batches(spark, sf_dir):
    views.register(spark, sf_dir)
    return lifecycle.row_batches(spark.table("orders"), "o_custkey", "o_orderkey")


def d19_commands(spark, sf_dir):
    views.register(spark, sf_dir)
    rows = spark.sql("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'DSP ALMAF' WHEN 1 THEN ' mod CELL' WHEN 2 THEN 'LST X1' ELSE '12' END AS command FROM customer")
    return rows.select("id", lifecycle.command_class(F.col("command")).alias("kind"))


def d21_planned(spark, sf_dir):
    records = _records(spark, sf_dir).select("doc_identifier", "title", "domain")
    wanted = records.where(~F.col("doc_identifier").endswith("3")).withColumn("title", F.when(F.col("doc_identifier").endswith("7"), F.lit("t")).otherwise(F.col("title"))).unionByName(records.select(F.concat("doc_identifier", F.lit("-new")).alias("doc_identifier"), "title", "domain"))
    return lifecycle.planned(records, wanted, "doc_identifier", "title", "domain")


def d23_sync(spark, sf_dir):
    views.register(spark, sf_dir)
    old = spark.sql("SELECT concat('f', doc_id) AS path, md5(text) AS sha256 FROM documents WHERE doc_id % 7 <> 0")
    files = spark.sql("SELECT concat('f', doc_id) AS path, CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END AS body FROM documents WHERE doc_id % 11 <> 0")
    return lifecycle.sync(old, files.select("path", F.md5("body").alias("sha256")))


def d26_pending(spark, sf_dir):
    from . import text_queries

    bills = text_queries._bills(spark, sf_dir)
    today = F.lit(text_queries.TODAY).cast("date")
    done = lifecycle.pending_actions(bills.where("doc_id % 2 = 0"), today).select("key")
    return lifecycle.pending_actions(bills, today, done).select("key", "action_type")


def p10_json(spark, sf_dir):
    views.register(spark, sf_dir)
    return spark.sql("SELECT event_id, coalesce(nullif(get_json_object(concat('{\"virtual_uri\": \"', CASE WHEN event_id % 2 = 0 THEN concat('u', event_id) ELSE '' END, '\", \"file_path\": \"f', event_id, '\"}'), '$.virtual_uri'), ''), concat('f', event_id)) AS uri FROM events")


def l10_documents_by_date(spark, sf_dir):
    views.register(spark, sf_dir)
    return spark.sql("SELECT id, created, CAST(row_number() OVER (ORDER BY created, id) AS BIGINT) AS place FROM (SELECT id, created FROM graph_docs ORDER BY created, id LIMIT 500)")


QUERIES = {
    f.__name__: f
    for f in (
        p8_match, r1_exact_lookup, r2_neighbours, r2_commands, r3_cascade, r6_route, r8_one_per_document, r8_fold, u5_first_of, p9_scopes, f9_scores, r4_search, f8_top_confidence, r9_evidence, r11_two_level, f36_answers, f36_tables,
        a20_word_tokens, a21_latencies, a22_quality, a23_coverage_share, a24_signatures, j14_near_pairs, r16_first_kept, d10_decisions, d10_ingest, d11_owned, d3_purge, d14_relocations, d15_capped_sync, d15_remove, d19_enrich,
        d19_batches, d19_commands, d21_planned, d23_sync, d26_pending, p10_json, l10_documents_by_date,
    )
}

_V = views.with_views
_NORM = "' ' || array_to_string(list_filter(string_split_regex(strip_accents(lower(coalesce({}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' '"
_W = "list_filter(string_split_regex(strip_accents(lower(coalesce({}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_FILE_ROWS = "f AS (SELECT doc_id, doc_id % 3 > 0 AS known, doc_id % 5 <> 0 AS same, doc_id % 13 = 0 AS odd, length(text) AS old, length(text) * CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS new FROM documents)"
ORACLES = {
    "p8_match": _V(f"""WITH r AS (SELECT id, {_NORM.format('title')} AS a, {_NORM.format('content')} AS b FROM records WHERE clearance <= {CLEARANCE}), q AS (SELECT item_id AS question, {_W.format('text')} AS w FROM benchmark),
      k AS (SELECT question, ' ' || w[1] || ' ' || w[2] || ' ' AS p, ' ' || w[4] || ' ' AS p2, ' ' || array_to_string(w[3:5], ' ') || ' ' AS p3, len(w) AS n FROM q)
      SELECT question, id FROM k, r WHERE (instr(a, p) > 0 OR instr(b, p) > 0) AND (instr(a, p2) > 0 OR instr(b, p2) > 0) OR instr(a, p3) > 0 OR instr(b, p3) > 0"""),
    "r1_exact_lookup": f"SELECT doc_id AS question, doc_id AS id, 0.99 AS score, CAST(1 AS BIGINT) AS rank FROM documents WHERE doc_id % 4 <= {CLEARANCE}",
    "r2_neighbours": f"""WITH k AS (SELECT DISTINCT 20000 + o_orderkey % 900 AS n FROM orders WHERE o_orderkey % 4 <= {CLEARANCE}), a AS (SELECT c_custkey AS question, 20000 + c_custkey % 900 AS m FROM customer),
      p AS (SELECT question, n, abs(n - m) AS distance, CASE WHEN n // 10 = m // 10 THEN 0 ELSE 1 END AS ring FROM a JOIN k ON n // 100 = m // 100 AND n <> m), c AS (SELECT question, count(*) FILTER (WHERE ring = 0) AS inner_n FROM p GROUP BY question),
      r AS (SELECT question, n, distance, row_number() OVER (PARTITION BY question ORDER BY distance, n) AS rank FROM p JOIN c USING (question) WHERE ring = 0 OR inner_n < 8) SELECT question, 'ALM-' || n AS identifier, distance, rank FROM r WHERE rank <= 4""",
    "r2_commands": f"""WITH k AS (SELECT DISTINCT 'DSP OPTM' || chr(CAST(65 + o_orderkey % 26 AS INT)) || 'X' AS c FROM orders WHERE o_orderkey % 4 <= {CLEARANCE}), a AS (SELECT c_custkey AS question, 'DSP OPTM' || chr(CAST(65 + c_custkey % 26 AS INT)) || 'X' AS own FROM customer WHERE c_custkey % 2 = 0),
      r AS (SELECT question, c AS identifier, row_number() OVER (PARTITION BY question ORDER BY c) AS rank FROM a JOIN k ON c <> own) SELECT * FROM r WHERE rank <= 3""",
    "r8_one_per_document": f"WITH h AS ({_HITS}), k AS (SELECT question, topic_id, min(rank) AS best, coalesce(min(rank) FILTER (WHERE record_kind = 'native'), min(rank)) AS chosen FROM h GROUP BY 1, 2) SELECT h.question, id, row_number() OVER (PARTITION BY h.question ORDER BY best) AS rank FROM k JOIN h ON h.question = k.question AND h.topic_id = k.topic_id AND h.rank = chosen",
    "r8_fold": f"""WITH h AS ({_HITS}), n AS (SELECT question, topic_id, min(rank) AS top FROM h WHERE record_kind = 'native' GROUP BY 1, 2), f AS (SELECT h.*, n.top, record_kind = 'composite' AND n.top IS NOT NULL AND id % 2 = 0 AS folded FROM h LEFT JOIN n USING (question, topic_id)),
      c AS (SELECT question, top, count(*) AS collapsed FROM f WHERE folded GROUP BY 1, 2) SELECT f.question, id, coalesce(collapsed, 0) AS collapsed, row_number() OVER (PARTITION BY f.question ORDER BY rank) AS rank FROM f LEFT JOIN c ON c.question = f.question AND c.top = f.rank WHERE NOT folded""",
    "u5_first_of": f"WITH h AS ({_HITS}) SELECT question, id, id % 2 AS part, row_number() OVER (PARTITION BY question ORDER BY id % 2, rank) AS rank FROM h",
    "p9_scopes": _V("SELECT 'english' AS scope, count(*) AS n FROM records WHERE domain = 'en' UNION ALL SELECT 'The ', count(*) FROM records WHERE instr(lower(title), 'the') > 0 OR instr(lower(doc_identifier), 'doc-7') > 0 UNION ALL SELECT '*', count(*) FROM records"),
    "f9_scores": "SELECT vec_id, 3.5e0 * (vec_id % 5) + 1.5e0 * (vec_id % 9) + CASE WHEN vec_id > 150 THEN 1 ELSE 0 END AS overlap, round(least(0.98e0, 0.48e0 + least(1e0, (vec_id % 9) / 8e0) * 0.36e0 + least(0.14e0, (vec_id % 5) * 0.05e0)), 3) AS score FROM embeddings",
    "f8_top_confidence": "SELECT vec_id % 50 AS question, max(CASE WHEN vec_id % 3 = 0 THEN vec_id / 2e4 ELSE vec_id / 1e4 END) AS confidence FROM embeddings GROUP BY 1",
    "r9_evidence": f"""WITH e AS ({_EVIDENCE}), c AS (SELECT question, '{search.POSTURE["scholarly"]}{search.GROUNDING["verbatim_footnotes"]}' || string_agg('[Citation ' || rank || ': ' || coalesce(title, 'Document') || CASE WHEN heading <> '' THEN ' (' || heading || ')' ELSE '' END || ']' || chr(10) || coalesce(text, ''), '{search.RULE}' ORDER BY rank) AS context, count(*) AS n,
        '[^1]: ' || coalesce(arg_min(title, rank), 'Document') || ' (' || arg_min(path, rank) || ')' AS footnote FROM e GROUP BY question) SELECT question, md5(context) AS digest, greatest(1, length(context) // 4) AS tokens, greatest(15000, 10 * greatest(1, length(context) // 4)) AS baseline_tokens, n, footnote FROM c""",
    "r11_two_level": """WITH c AS (SELECT vec_id % 30 AS q, vec_id AS id, label, row_number() OVER (PARTITION BY vec_id % 30 ORDER BY (vec_id * 17) % 1009, vec_id) AS a, row_number() OVER (PARTITION BY vec_id % 30 ORDER BY (vec_id * 29) % 1009, vec_id) AS b FROM embeddings),
      u AS (SELECT q, label, round(1e0 / (60 + row_number() OVER (PARTITION BY q ORDER BY (label * 3) % 11, label)) + 1e0 / (60 + row_number() OVER (PARTITION BY q ORDER BY (label * 7) % 11, label)), 6) AS s FROM (SELECT DISTINCT q, label FROM c) t),
      m AS (SELECT q AS question, id, label AS parent, round(0.6e0 * round(CASE WHEN a <= 20 THEN 1e0 / (60 + a) ELSE 0 END + CASE WHEN b <= 20 THEN 1e0 / (60 + b) ELSE 0 END, 6) + 0.4e0 * s, 9) AS score FROM c JOIN u USING (q, label) WHERE a <= 20 OR b <= 20),
      r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM m) SELECT question, id, parent, round(score, 6) AS score, rank FROM r WHERE rank <= 4""",
    "f36_tables": "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '| x | y |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' WHEN 1 THEN '| x | y |' || chr(10) || '| 3 | 4 |' ELSE '' END AS found FROM orders",
    "a20_word_tokens": r"SELECT doc_id AS id, CAST(floor(len(list_filter(string_split_regex(coalesce(text, ''), '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '')) * 1.33e0) AS BIGINT) AS tokens FROM documents",
    "a21_latencies": "SELECT event_type, count(value) AS n, round(avg(CAST(value AS DOUBLE)), 4) AS mean, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST(value AS DOUBLE), 0.95), 4) AS p95, round(max(CAST(value AS DOUBLE)), 4) AS highest FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "a22_quality": """WITH h AS (SELECT vec_id % 40 AS q, label, row_number() OVER (PARTITION BY vec_id % 40 ORDER BY vec_id) AS rank FROM embeddings), b AS (SELECT q, min(rank) FILTER (WHERE label = 3) AS r FROM h GROUP BY q HAVING min(rank) FILTER (WHERE label = 3) IS NOT NULL OR q = 1)
      SELECT count(*) AS questions, round(avg(CASE WHEN r <= 1 THEN 1e0 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN r <= 5 THEN 1e0 ELSE 0 END), 6) AS hit_at_5, round(avg(CASE WHEN r <= 10 THEN 1e0 ELSE 0 END), 6) AS hit_at_10, round(avg(CASE WHEN r <= 10 THEN 1e0 / r ELSE 0 END), 6) AS mrr_at_10 FROM b""",
    "a23_coverage_share": "SELECT vec_id % 40 AS question, count(DISTINCT label) AS covered, round(count(DISTINCT label) / CAST((SELECT count(DISTINCT label) FROM embeddings) AS DOUBLE), 6) AS share FROM embeddings WHERE vec_id % 3 = 0 GROUP BY 1",
    "d10_decisions": f"""WITH {_FILE_ROWS}, m AS (SELECT 'missing' AS mode, CASE WHEN odd THEN 'unsupported' WHEN known THEN 'exists' ELSE 'ingest' END AS decision, known, old FROM f UNION ALL SELECT 'changed', CASE WHEN odd THEN 'unsupported' WHEN known AND same THEN 'unchanged' ELSE 'ingest' END, known, old FROM f
      UNION ALL SELECT 'grow', CASE WHEN odd THEN 'unsupported' WHEN known AND new <= 1.5 * old THEN 'not larger' ELSE 'ingest' END, known, old FROM f UNION ALL SELECT 'replace', CASE WHEN odd THEN 'unsupported' ELSE 'ingest' END, known, old FROM f)
      SELECT decision, count(*) AS n, CAST(sum(CASE WHEN known THEN old ELSE 0 END) AS BIGINT) AS old_chars, mode FROM m GROUP BY decision, mode""",
    "d10_ingest": f"WITH {_FILE_ROWS}, t AS (SELECT *, NOT odd AND NOT (known AND same) AS taken FROM f) SELECT 1000000 + doc_id AS id, '/d/f' || doc_id || '.md::part::0001' AS doc_identifier, 'h' AS source_sha256 FROM t WHERE taken UNION ALL SELECT doc_id * 2 + p, '/d/f' || doc_id || '.md' || CASE p WHEN 0 THEN '::part::0001' ELSE '#x' END, md5(d.text) FROM t JOIN documents d USING (doc_id), (SELECT 0 AS p UNION ALL SELECT 1) x WHERE known AND NOT taken",
    "d11_owned": "SELECT '/d/f' || doc_id || '.md' AS uri, doc_id * 2 + p AS id FROM documents, (SELECT 0 AS p UNION ALL SELECT 1) x WHERE doc_id % 3 > 0",
    "d3_purge": "SELECT doc_id AS id, CASE WHEN instr(lower(lang || '/' || source), 'en/src1') > 0 THEN 'purged' ELSE 'kept' END AS state FROM documents",
    "d14_relocations": "SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'english/' || source ELSE lang || '/' || source END AS virtual_uri, 'DOC-' || doc_id AS doc_identifier FROM documents",
    "d15_capped_sync": "SELECT source, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, least(500, length(text)) AS n, length(text) > 500 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) d WHERE k <= 7",
    "d15_remove": "SELECT doc_id AS id FROM documents WHERE lang <> 'en'",
    "d19_enrich": "SELECT doc_id AS id, doc_id % 2 = 0 OR length(text) = 0 AS enriched, CASE WHEN doc_id % 2 = 0 THEN length(text) + 1 ELSE greatest(1, length(text)) END AS n FROM documents",
    "d19_batches": "SELECT o_custkey, CAST(k // 12 AS INTEGER) AS batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) t GROUP BY 1, 2",
    "d19_commands": "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 1 THEN 'remediation' WHEN 3 THEN NULL ELSE 'diagnostic' END AS kind FROM customer",
    "d21_planned": "SELECT 'DOC-' || doc_id AS doc_identifier, CASE WHEN doc_id % 10 = 3 THEN 'delete' ELSE 'update' END AS change FROM documents WHERE doc_id % 10 = 3 OR (doc_id % 10 = 7 AND substring(text, 1, 60) IS DISTINCT FROM 't') UNION ALL SELECT 'DOC-' || doc_id || '-new', 'insert' FROM documents",
    "d23_sync": "SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'deleted' ELSE 'modified' END AS state FROM documents WHERE (doc_id % 7 = 0) <> (doc_id % 11 = 0) OR (doc_id % 5 = 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0)",
    "d26_pending": """WITH b AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_orderdate AS DATE) AS due, datediff('day', DATE '1995-03-15', CAST(o_orderdate AS DATE)) AS days FROM orders WHERE o_orderkey % 2 = 1),
      a AS (SELECT k, CASE WHEN days < 0 THEN 'OVERDUE_BILL' ELSE 'BILL_DUE_SOON' END AS action_type, CAST(due AS VARCHAR) AS d FROM b WHERE days BETWEEN -14 AND 3 UNION ALL SELECT k, 'HIGH_VALUE_PAYMENT', 'none' FROM b WHERE price >= 1000 UNION ALL SELECT k, 'CRITICAL_NOTICE', 'none' FROM b WHERE k % 11 = 0)
      SELECT k || ':' || action_type || ':' || d AS key, action_type FROM a""",
    "p10_json": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'u' ELSE 'f' END || event_id AS uri FROM events",
    "l10_documents_by_date": _V("SELECT id, created, row_number() OVER (ORDER BY created, id) AS place FROM graph_docs ORDER BY created, id LIMIT 500"),
}
