"""Question analysis, text functions, extraction, chunking and file formats over the driver's tables.

Inputs that the tables lack (questions with identifiers, mails, invoices, notes) are put together from their columns by SQL text that either
engine runs; what the operators then find is known from the columns, so the oracles read those and not the operators' logic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import intent, scalar as S, text as T
from ..operators import chunking, extraction
from ..sources import parsing
from . import views

# (text, identifier, normalised, route, needs synthesis); {n} is a six-digit number.
QUESTIONS = (
    ("status of 0x{n}AB please", "hex", "0x{n}ab", "deterministic_direct", False),
    ("explain ALM-{n}", "telecom_alarm", "ALM-{n}", "compound_fused", True),
    ("alm-{n}", "telecom_alarm", "ALM-{n}", "deterministic_direct", False),
    ("why does DSP  OPT{n} fail", "mml_command", "DSP OPT{n}", "compound_fused", True),
    ("LST CELL_{n}", "mml_command", "LST CELL_{n}", "deterministic_direct", False),
    ("counter VS.NR.C{n} today", "telecom_kpi", "VS.NR.C{n}", "deterministic_direct", False),
    ("see RFC 9114 and {n}", "telco_spec", "RFC 9114", "deterministic_direct", False),
    ("3gpp ts 38.331 clause {n}", "telco_spec", "3gpp ts 38.331", "deterministic_direct", False),
    ("LOTE-{n}B expired", "lote", "{n}B", "deterministic_direct", False),
    ("Lista b1 for {n}?", "portaria_344_lista", "Lista B1", "compound_fused", True),
    ("crm-sp {n}", "crm", "CRM-SP {n}", "deterministic_direct", False),
    ("CID-10 E11.9 in {n}", "cid10", "E11.9", "deterministic_direct", False),
    ("person 123.456.789-09 and {n}", "cpf", "12345678909", "deterministic_direct", False),
    ("12.345.678/0001-95 owns {n}", "cnpj", "12345678000195", "deterministic_direct", False),
    ("MS 1.0235.1234.001-2 for {n}", "anvisa_ms", "1.0235.1234.001-2", "deterministic_direct", False),
    ("adr-40 relations of {n}", "wiki_adr", "ADR-40", "compound_fused", True),
    ("Acme ADR 7, {n}", "wiki_adr", "Acme ADR-07", "deterministic_direct", False),
    ("use Manage-big-vault{n}", "agent_skill", "manage-big-vault{n}", "deterministic_direct", False),
    ("INC-{n} state", "ticket", "INC-{n}", "deterministic_direct", False),
    ('say "clause {n}" now', "quoted_phrase", "clause {n}", "deterministic_direct", False),
    ("find Zx9kQ7mWt{n} here", "high_entropy_code", "Zx9kQ7mWt{n}", "deterministic_direct", False),
    ("who owns the graph of {n}", None, None, "relational_graph", True),
    ("executive overview of {n}", None, None, "macro_synthesis", True),
    ("how are things with {n}", None, None, "hybrid_needle", True),
    ("architecture", None, None, "hybrid_needle", False),
    ("pods in place {n}", None, None, "hybrid_needle", False),
)


def _sql_text(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("'", "''") + "'"


_TEMPLATES = " UNION ALL ".join(f"SELECT {i} AS t, {_sql_text(q)} AS q, {_sql_text(k)} AS id_type, {_sql_text(v)} AS v, {_sql_text(r)} AS route_type, {str(s).upper()} AS needs_synthesis" for i, (q, k, v, r, s) in enumerate(QUESTIONS))
_ASKED = f"SELECT c_custkey AS question, lpad(CAST(c_custkey AS STRING), 6, '0') AS n, t.* FROM customer JOIN ({_TEMPLATES}) t ON c_custkey % {len(QUESTIONS)} = t.t"


def _frame(spark, sf_dir, body):
    views.register(spark, sf_dir)
    return spark.sql(body)


def _spread(rows, key):
    """Rows dealt by a key. A star table's file may be a few MB in one row group, which Spark reads in one task, however long each row takes to work on."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def f5_classify(spark, sf_dir):
    asked = _spread(_frame(spark, sf_dir, _ASKED), "question").select("question", intent.classify(F.expr("replace(q, '{n}', n)")).alias("c"))
    return asked.select("question", "c.route_type", "c.needs_synthesis", F.col("c.extracted_identifier.id_type").alias("id_type"), F.col("c.extracted_identifier.normalized_value").alias("normalized_value"))


def f3_intents(spark, sf_dir):
    q = F.expr("replace(q, '{n}', n)")
    return _spread(_frame(spark, sf_dir, _ASKED), "question").select("question", intent.has_intent(q, intent.RELATIONAL).alias("relational"), intent.has_intent(q, intent.MACRO).alias("macro"), intent.is_guarded(q).alias("guarded"))


def f6_bands(spark, sf_dir):
    score = F.col("vec_id") % 101 / 100
    rows = _frame(spark, sf_dir, "SELECT vec_id FROM embeddings").select("vec_id", intent.confidence_band(score, F.col("vec_id") % 2 == 0, F.col("vec_id") % 3 > 0).alias("b"), intent.lexical_band(score).alias("lexical"), intent.fused_band(score).alias("fused"))
    return rows.select("vec_id", "b.level", F.col("b.score").alias("score"), "lexical", "fused")


_NAMES = "CASE vec_id % 7 WHEN 0 THEN 'Public' WHEN 1 THEN ' internal ' WHEN 2 THEN 'SECRET' WHEN 3 THEN '2' WHEN 4 THEN 'unheard' WHEN 5 THEN CAST(NULL AS STRING) ELSE 'max' END"


def f39_clearance(spark, sf_dir):
    return _frame(spark, sf_dir, f"SELECT vec_id, {_NAMES} AS name FROM embeddings").select("vec_id", intent.clearance_level(F.col("name")).alias("level"), F.size(intent.authorized_levels(F.col("name"))).cast("long").alias("n_levels"))


_MARKED = "SELECT doc_id, CASE WHEN length(text) > 1700 THEN concat(substring(text, 1, 900), '\nProcedure', substring(text, 901)) ELSE text END AS body FROM documents"


def f10_smart_trim(spark, sf_dir):
    return _frame(spark, sf_dir, _MARKED).select("doc_id", T.smart_trim(F.col("body")).alias("trimmed"))


def f24_clean_markup(spark, sf_dir):
    return _frame(spark, sf_dir, "SELECT page_id, html FROM pages").select("page_id", F.length(T.clean_markup(F.col("html"))).cast("long").alias("n"), F.md5(T.clean_markup(F.col("html"))).alias("digest"))


_SECTIONED = "SELECT doc_id, concat(substring(text, 1, 400), '\nDescription\n', substring(text, 401, 300), '\nProcedure\n', substring(text, 701, 200)) AS body FROM documents WHERE length(text) > 900"


def f25_sections(spark, sf_dir):
    found = _frame(spark, sf_dir, _SECTIONED).select("doc_id", T.sections(F.col("body")).alias("s"))
    return found.select("doc_id", F.col("s")["Description"].alias("description"), F.col("s")["Procedure"].alias("procedure"), F.size("s").cast("long").alias("n"))


_TABLED = "SELECT o_orderkey AS id, concat('before\n| Order | *Total* |\n', CASE WHEN o_orderkey % 2 = 0 THEN '| --- | :-: |\n' ELSE '' END, '| ', o_orderkey, ' | x |\nafter') AS body FROM orders"


def f25_table_headers(spark, sf_dir):
    return _frame(spark, sf_dir, _TABLED).select("id", F.array_join(T.table_headers(F.col("body")), "/").alias("headers"))


_PLACES = "SELECT page_id, url, concat('archive:///data/p', page_id % 9, '.zip!in.hwics#a%20b/', page_id, '.html') AS uri, concat('archive://v.zip#a/b', page_id, '.xlsx::sheet::S', page_id % 3) AS sheet_uri, concat('docs/n', page_id, '.md::part::', lpad(CAST(page_id % 100 AS STRING), 4, '0')) AS ident FROM pages"


def f28_addresses(spark, sf_dir):
    rows = _frame(spark, sf_dir, _PLACES)
    at, inner = T.parse_virtual_uri(F.col("uri")), T.split_inner(F.col("sheet_uri"))
    return rows.select("page_id", at["outer"].alias("outer_path"), at["inner"].alias("inner_path"), at["entry"].alias("entry"), inner["file"].alias("file"), inner["part"].alias("part"), T.document_key(F.lit(None).cast("string"), F.lit(""), F.col("ident"), F.col("page_id")).alias("doc_key"), T.best_uri(F.concat("url", F.lit("#x")), F.col("url")).alias("best"))


def f27_title_matches(spark, sf_dir):
    rows = _frame(spark, sf_dir, "SELECT a.c_custkey AS id, concat('ALM-', 20000 + a.c_custkey % 50, ' fault — page') AS title, concat('topic ALM-', 20000 + a.c_custkey % 25, ' text') AS topic FROM customer a")
    return rows.select("id", T.title_matches_topic(F.col("title"), F.col("topic")).alias("same"))


NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def f30_keyed_digests(spark, sf_dir):
    rows = _frame(spark, sf_dir, "SELECT doc_id, text FROM documents")
    return rows.select("doc_id", T.hmac_sha256("a fleet's salt", F.col("text")).alias("hmac"), T.uuid5(NAMESPACE, F.col("text")).alias("uuid"))


def f38_pseudonyms(spark, sf_dir):
    return _frame(spark, sf_dir, "SELECT c_custkey, c_name FROM customer").select("c_custkey", T.pseudonym(F.concat(F.lit(" "), "c_name", F.lit("\n")), "a fleet's salt").alias("pseudonym"))


# Orders as bills: amounts 1,234.56 in the local form, a due date, and for some a notice.
_BILLS = "SELECT o_orderkey AS doc_id, concat('Bill ', o_orderkey) AS title, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_orderdate AS DATE) AS due FROM orders"
TODAY = "1995-03-15"


def _bills(spark, sf_dir):
    rows = _spread(_frame(spark, sf_dir, _BILLS), "doc_id")
    local = F.translate(F.format_number("price", 2), ",.", ".,")
    notice = F.when(F.col("doc_id") % 11 == 0, F.lit(" INTIMAÇÃO judicial")).otherwise(F.lit(""))
    return rows.withColumn("content", F.concat(F.lit("Vencimento: "), F.date_format("due", "dd/MM/yyyy"), F.lit(", total R$ "), local, F.lit(" ref ADR-"), (F.col("doc_id") % 40).cast("string"), F.lit(" and 123.456.789-09 at 10.0.0.7:8080"), notice))


def f22_actions(spark, sf_dir):
    rows = _bills(spark, sf_dir)
    return rows.select("doc_id", F.inline(T.actions(F.col("title"), F.col("content"), F.lit(TODAY).cast("date")))).select("doc_id", "action_type", "severity", F.round("amount", 2).alias("amount"), F.col("due_date").cast("string").alias("due_date"))


def a15_amounts_in_text(spark, sf_dir):
    return _bills(spark, sf_dir).select("doc_id", F.round(T.max_amount(F.col("content")), 2).alias("max_amount"), F.size(T.due_dates(F.col("content"))).cast("long").alias("n_dates"))


def f18_mentions(spark, sf_dir):
    return extraction.mentions(_bills(spark, sf_dir), text_col="content").where("kind <> 'ip port'").select("doc_id", "kind", "norm", "n")


def f20_relations(spark, sf_dir):
    found = extraction.mentions(_bills(spark, sf_dir), text_col="content")
    return extraction.relations(found, extraction.BUSINESS_RELATIONS, (("cpf", "monetary", "owes"),)).select("doc_id", "source", "target", "relation")


TYPES = {"Invoice": ["fatura", "nota fiscal"], "Contract": ["contrato"], "Receipt": ["recibo de pagamento"]}
SENDERS = {"Água S.A.": ["agua", "saneamento básico"], "Telecom": ["telefonia"]}
TAGS = {"house": ["água", "luz"], "phone": ["telefonia"]}
_LETTERS = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Nota  Fiscal' WHEN 1 THEN 'Contrato de telefonia' ELSE 'papel' END AS title, CASE c_custkey % 3 WHEN 0 THEN 'Recibo de Pagamento da Água' WHEN 1 THEN 'sem nada' ELSE 'contrato, saneamento BÁSICO' END AS content FROM customer"


def f21_classified(spark, sf_dir):
    rows = _spread(_frame(spark, sf_dir, _LETTERS), "id").select("id", T.classified(F.col("title"), F.col("content"), TYPES, SENDERS, TAGS).alias("c"))
    return rows.select("id", "c.document_type", "c.correspondent", F.array_join("c.tags", ",").alias("tags"), "c.confidence")


KEYWORDS = {"fiscal_nfe": ["nfe", "fiscal"], "medical_clinical": ["clinic"], "legal_contracts": ["contract"], "engineering_manuals": ["manual"]}
_FOLDERS = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '/data/nfe' WHEN 1 THEN '/data/Clinic' WHEN 2 THEN '/x/manual' ELSE '/y' END AS dir, c_custkey % 30 AS n, c_custkey * 1000 AS bytes FROM customer"


def f23_directories(spark, sf_dir):
    rows = _frame(spark, sf_dir, _FOLDERS)
    formats = F.create_map(F.lit(".xml"), F.col("n"), F.lit(".md"), F.lit(1).cast("long"))
    kind = T.directory_class(F.col("dir"), F.array(F.lit("a.xml")), formats, KEYWORDS)
    return rows.select("id", kind.alias("domain"), T.directory_priority(F.col("n"), F.col("bytes"), formats, kind).alias("priority"))


def p16_watched(spark, sf_dir):
    rows = _frame(spark, sf_dir, "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'a/b.md' WHEN 1 THEN 'a/.git/b.md' WHEN 2 THEN '~$b.docx' WHEN 3 THEN 'a/B.PDF' WHEN 4 THEN 'node_modules/x.txt' ELSE 'a/b.exe' END AS path FROM events")
    return rows.where(T.watched(F.col("path"))).select("event_id", "path")


def f16_chunk_spans(spark, sf_dir):
    return chunking.chunk_spans(_frame(spark, sf_dir, "SELECT doc_id, text FROM documents")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "start", "stop")


def f17_coverage(spark, sf_dir):
    docs = _frame(spark, sf_dir, "SELECT doc_id, text FROM documents")
    lengths = docs.groupBy("doc_id").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("n"))
    missing = chunking.gaps(chunking.chunk_spans(docs, chunking.PROFILES["datacenter"]), lengths).groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("missed"))
    return lengths.join(missing, "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_chars"), F.coalesce("missed", F.lit(0)).alias("missed"))


_NOTES = "SELECT doc_id, concat('notes/n', doc_id, '.md') AS path, concat('---\ntitle: Note ', doc_id, '\nclearance: ', CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'secret' ELSE 'odd' END, '\ntags: [a, b]\n---\n# Head ', doc_id, '\n\n', replace(replace(text, '#', ' '), '`', ' ')) AS text FROM documents"


def f15_markdown_chunks(spark, sf_dir):
    found = chunking.markdown_chunks(_frame(spark, sf_dir, _NOTES))
    return found.groupBy("path").agg(F.min("doc_title").alias("doc_title"), F.max("clearance_level").cast("long").alias("clearance_level"), F.min("line_start").cast("long").alias("first_line"), F.max(F.size("tags")).cast("long").alias("n_tags"), (F.max("chunk_index") + 1 == F.count(F.lit(1))).alias("gapless"))


_MAIL = "concat('From: A <', role, '@x.org>\nTo: b@x.org, c@x.org\nSubject: INC-', 1000 + conv_id, ' turn ', turn, '\nMessage-ID: <', conv_id, '.', turn, '@x>\n', CASE WHEN turn > 0 THEN concat('In-Reply-To: <', conv_id, '.', turn - 1, '@x>\n') ELSE '' END, '\nsee ALM-', 20000 + turn, '\n> quoted\nend')"
_MAILS = f"SELECT concat('m/', conv_id, '-', turn, '.eml') AS path, {_MAIL} AS body FROM conversations"


def _bytes(frame):
    return frame.select("path", F.encode("body", "UTF-8").alias("content"))


def s20_mail_sections(spark, sf_dir):
    found = parsing.sections(_bytes(_frame(spark, sf_dir, _MAILS)))
    return found.select("path", "format", "title", F.col("section").cast("long").alias("section"), F.get("headings", F.lit(0)).alias("heading"), F.when(F.get("headings", F.lit(0)) == "Message Body", F.col("text")).alias("text"))


def s23_mail_messages(spark, sf_dir):
    found = parsing.messages(_bytes(_frame(spark, sf_dir, _MAILS)))
    return found.select("path", "message_id", "in_reply_to", "sender", F.array_join("recipients", ",").alias("recipients"), "subject", F.array_join("identifiers", ",").alias("identifiers"))


def d18_mail_edges(spark, sf_dir):
    return parsing.edges(_bytes(_frame(spark, sf_dir, _MAILS))).select("path", "source", "target", "relation")


_INVOICE = """SELECT concat('i/', o_orderkey, '.xml') AS path, concat('<nfeProc xmlns="http://www.portalfiscal.inf.br/nfe"><NFe><infNFe Id="NFe', lpad(CAST(o_orderkey AS STRING), 44, '0'), '"><ide><nNF>', o_orderkey, '</nNF><serie>2</serie></ide><emit><CNPJ>12345678000195</CNPJ><xNome>Seller</xNome></emit><dest><CPF>', lpad(CAST(o_custkey AS STRING), 11, '0'), '</CPF><xNome>Buyer</xNome></dest>', items, '<total><ICMSTot><vNF>', o_totalprice, '</vNF></ICMSTot></total></infNFe></NFe></nfeProc>') AS body FROM orders JOIN (
  SELECT l_orderkey, {join} AS items FROM (SELECT l_orderkey, l_linenumber, concat('<det nItem="', l_linenumber, '"><prod><cProd>P', l_partkey, '</cProd><qCom>', l_quantity, '</qCom><vProd>', l_extendedprice, '</vProd><rastro><nLote>L', l_suppkey, '</nLote></rastro></prod></det>') AS item FROM lineitem) x GROUP BY l_orderkey) l ON l_orderkey = o_orderkey"""


def _invoices(spark, sf_dir):
    return _bytes(_frame(spark, sf_dir, _INVOICE.format(join="array_join(transform(array_sort(collect_list(struct(l_linenumber, item))), x -> x.item), '')")))


def s22_invoice_items(spark, sf_dir):
    found = parsing.invoice_items(_invoices(spark, sf_dir))
    return found.select("path", F.col("invoice_key").alias("invoice_key"), F.col("item").cast("long").alias("item"), "code", F.round("quantity", 2).alias("quantity"), F.round("amount", 2).alias("amount"), "recipient_tax_id", F.array_join("batches", ",").alias("batches"))


_CSV = "SELECT concat('t/', c_custkey, '.csv') AS path, concat('name;city;cpf\n', c_name, ';Rio;', substring(lpad(CAST(c_custkey AS STRING), 9, '1'), 1, 3), '.', substring(lpad(CAST(c_custkey AS STRING), 9, '1'), 4, 3), '.', substring(lpad(CAST(c_custkey AS STRING), 9, '1'), 7, 3), '-00\nx;LOTE-AB', 1000 + c_custkey, ';\n;;\nplain;row;\n') AS body FROM customer"


def s24_table_rows(spark, sf_dir):
    found = parsing.table_rows(_bytes(_spread(_frame(spark, sf_dir, _CSV), "path")))
    return found.where("row < 4").select("path", F.col("row").cast("long").alias("row"), "primary_id")


def s12_csv_sections(spark, sf_dir):
    found = parsing.sections(_bytes(_spread(_frame(spark, sf_dir, _CSV), "path")))
    return found.select("path", "format", "kind", F.split("text", "\n")[0].alias("first"))


def s10_markdown_sections(spark, sf_dir):
    found = parsing.sections(_bytes(_frame(spark, sf_dir, "SELECT path, text AS body FROM (" + _NOTES + ") n")))
    return found.groupBy("path").agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("n"), F.max(F.get("headings", F.lit(0))).alias("heading"))


_XML = "SELECT concat('x/', n_nationkey, '.xml') AS path, concat('<nation key=\"', n_nationkey, '\"><name>', n_name, '</name><region><id>', n_regionkey, '</id></region></nation>') AS body FROM nation"


def s15_xml_sections(spark, sf_dir):
    found = parsing.sections(_bytes(_frame(spark, sf_dir, _XML)))
    return found.select("path", F.array_join("headings", " > ").alias("heading"), "text")


def s14_html_sections(spark, sf_dir):
    """Headings and texts of every page; no SQL reads HTML, so tests hold this on pages with known sections."""
    found = parsing.sections(_bytes(_frame(spark, sf_dir, "SELECT concat(page_id, '.html') AS path, coalesce(html, '') AS body FROM pages")))
    return found.select("path", "title", "section", "headings", "text")


def s9_formats(spark, sf_dir):
    rows = _frame(spark, sf_dir, "SELECT event_id, concat('f/', event_id, CASE event_id % 6 WHEN 0 THEN '.MD' WHEN 1 THEN '.docx' WHEN 2 THEN '.xls' WHEN 3 THEN '.log' WHEN 4 THEN '.bin' ELSE '.eml' END) AS path FROM events")
    return rows.select("event_id", parsing.format_of(F.col("path")).alias("format"))


def j16_entities_in_text(spark, sf_dir):
    rows = _frame(spark, sf_dir, "SELECT n_nationkey AS id, concat('Orders of ', n_name, ' and ', lower(n_name), 's in ', r_name, '.') AS text FROM nation JOIN region ON r_regionkey = n_regionkey")
    names = {r["n"]: [] for r in spark.sql("SELECT n_name AS n FROM nation UNION SELECT r_name FROM region").collect()}  # a dictionary of 30 names
    return extraction.entities_in_text(rows, names).groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        f3_intents, f5_classify, f6_bands, f39_clearance, f10_smart_trim, f24_clean_markup, f25_sections, f25_table_headers, f28_addresses, f27_title_matches, f30_keyed_digests, f38_pseudonyms,
        f22_actions, a15_amounts_in_text, f18_mentions, f20_relations, f21_classified, f23_directories, p16_watched, f16_chunk_spans, f17_coverage, f15_markdown_chunks,
        s20_mail_sections, s23_mail_messages, d18_mail_edges, s22_invoice_items, s24_table_rows, s12_csv_sections, s10_markdown_sections, s15_xml_sections, s14_html_sections, s9_formats, j16_entities_in_text,
    )
}

_V = views.with_views
_WHITE = "'" + S.WHITE + "'"
_PAD = lambda b: "".join(f"\\x{x:02X}" for x in b)
_SALT = b"a fleet's salt".ljust(64, b"\0")
_INNER, _OUTER = (_PAD(bytes(x ^ p for x in _SALT)) for p in (0x36, 0x5C))
_HMAC = f"sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || encode({{}}))))"
_LOCAL = "replace(replace(replace(format('{:,.2f}', price), ',', '_'), '.', ','), '_', '.')"
_BILL_ROWS = f"WITH b AS (SELECT doc_id, title, price, due, {_LOCAL} AS local, datediff('day', DATE '{TODAY}', due) AS days FROM ({_BILLS}) x)"
ORACLES = {
    "f5_classify": _V(f"SELECT question, route_type, needs_synthesis, id_type, replace(v, '{{n}}', n) AS normalized_value FROM ({_ASKED}) a"),
    "f3_intents": _V(f"SELECT question, t IN (15, 21) AS relational, t = 22 AS macro, t = 24 AS guarded FROM ({_ASKED}) a"),
    "f6_bands": """WITH s AS (SELECT vec_id, vec_id % 101 / 100 AS s, vec_id % 2 = 0 AND vec_id % 3 = 0 AS missing FROM embeddings)
      SELECT vec_id, CASE WHEN missing THEN 'LOW_EPISTEMIC_REFUSAL' WHEN s >= 0.85 THEN 'HIGH_VERIFIED' WHEN s >= 0.55 THEN 'MEDIUM_RELEVANT' WHEN s >= 0.35 THEN 'LOW_MARGINAL' ELSE 'LOW_EPISTEMIC_REFUSAL' END AS level,
        CASE WHEN missing THEN 0 ELSE s END AS score, CASE WHEN s >= 0.8 THEN 'HIGH_VERIFIED' WHEN s >= 0.55 THEN 'MEDIUM_RELEVANT' ELSE 'LOW_MARGINAL' END AS lexical, CASE WHEN s >= 0.75 THEN 'HIGH_VERIFIED' WHEN s >= 0.35 THEN 'MEDIUM_RELEVANT' ELSE 'LOW_MARGINAL' END AS fused FROM s""",
    "f39_clearance": "SELECT vec_id, CAST([0, 1, 3, 2, 3, 3, 3][vec_id % 7 + 1] AS INTEGER) AS level, CAST([1, 2, 4, 3, 1, 1, 4][vec_id % 7 + 1] AS BIGINT) AS n_levels FROM embeddings",
    "f10_smart_trim": f"SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN length(text) <= 1650 THEN text WHEN length(text) <= 1700 THEN substring(text, 1, 1650) ELSE rtrim(substring(text, 1, 750), {_WHITE}) || '{T.TRIM_NOTE}' || rtrim(substring(chr(10) || 'Procedure' || substring(text, 901), 1, 845), {_WHITE}) END AS trimmed FROM documents",
    "f24_clean_markup": rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g') AS h FROM pages),
      b AS (SELECT page_id, trim(regexp_replace(regexp_replace(h, '(?s)<[^>]+>', ' ', 'g'), '[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), {_WHITE}) AS t FROM a) SELECT page_id, length(t) AS n, md5(t) AS digest FROM b""",
    "f25_sections": f"SELECT doc_id, trim(substring(text, 401, 300), {_WHITE}) AS description, trim(substring(text, 701, 200), {_WHITE}) AS procedure, CAST(2 AS BIGINT) AS n FROM documents WHERE length(text) > 900",
    "f25_table_headers": "SELECT o_orderkey AS id, 'Order/Total' AS headers FROM orders",
    "f28_addresses": "SELECT page_id, '/data/p' || page_id % 9 || '.zip' AS outer_path, 'in.hwics' AS inner_path, 'a b/' || page_id || '.html' AS entry, 'a/b' || page_id || '.xlsx' AS file, 'S' || page_id % 3 AS part, 'docs/n' || page_id || '.md' AS doc_key, url || '#x' AS best FROM pages",
    "f27_title_matches": "SELECT c_custkey AS id, c_custkey % 50 = c_custkey % 25 AS same FROM customer",
    "f30_keyed_digests": f"""WITH s AS (SELECT doc_id, text, sha1('{_PAD(uuid.UUID(NAMESPACE).bytes)}'::BLOB || encode(text)) AS h FROM documents)
      SELECT doc_id, {_HMAC.format("text")} AS hmac, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab89ab89ab89ab', instr('0123456789abcdef', h[17:17]), 1) || h[18:20] || '-' || h[21:32] AS uuid FROM s""",
    "f38_pseudonyms": f"SELECT c_custkey, {_HMAC.format('c_name')} AS pseudonym FROM customer",
    "f22_actions": f"""{_BILL_ROWS}, a AS (
      SELECT doc_id, CASE WHEN days < 0 THEN 'OVERDUE_BILL' ELSE 'BILL_DUE_SOON' END AS action_type, CASE WHEN days < 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, price AS amount, CAST(due AS VARCHAR) AS due_date FROM b WHERE days BETWEEN -14 AND 3
      UNION ALL SELECT doc_id, 'HIGH_VALUE_PAYMENT', 'WARNING', price, NULL FROM b WHERE price >= 1000
      UNION ALL SELECT doc_id, 'CRITICAL_NOTICE', 'CRITICAL', NULL, NULL FROM b WHERE doc_id % 11 = 0) SELECT doc_id, action_type, severity, round(amount, 2) AS amount, due_date FROM a""",
    "a15_amounts_in_text": f"{_BILL_ROWS} SELECT doc_id, round(price, 2) AS max_amount, CAST(1 AS BIGINT) AS n_dates FROM b",
    "f18_mentions": f"""{_BILL_ROWS} SELECT doc_id, 'date' AS kind, CAST(due AS VARCHAR) AS norm, CAST(1 AS BIGINT) AS n FROM b UNION ALL SELECT doc_id, 'monetary', 'R$ ' || local, 1 FROM b
      UNION ALL SELECT doc_id, 'adr', 'ADR-' || lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0'), 1 FROM b UNION ALL SELECT doc_id, 'cpf', '123.456.789-09', 1 FROM b UNION ALL SELECT doc_id, 'ip', '10.0.0.7', 2 FROM b UNION ALL SELECT doc_id, 'port', '8080', 1 FROM b""",
    "f20_relations": f"""{_BILL_ROWS} SELECT doc_id, 'document:' || doc_id AS source, CAST(due AS VARCHAR) AS target, 'has_date' AS relation FROM b UNION ALL SELECT doc_id, 'document:' || doc_id, 'R$ ' || local, 'has_amount' FROM b
      UNION ALL SELECT doc_id, 'document:' || doc_id, '123.456.789-09', 'mentions_cpf' FROM b UNION ALL SELECT doc_id, '10.0.0.7', '8080', 'has_port' FROM b UNION ALL SELECT doc_id, '123.456.789-09', 'R$ ' || local, 'owes' FROM b""",
    "f21_classified": """WITH c AS (SELECT c_custkey AS id, c_custkey % 4 AS t, c_custkey % 3 AS b FROM customer),
      d AS (SELECT *, CASE WHEN t = 0 THEN 'Invoice' WHEN t = 1 THEN 'Contract' WHEN b = 2 THEN 'Contract' WHEN b = 0 THEN 'Receipt' END AS k, CASE WHEN t <= 1 THEN 0.95 WHEN b <> 1 THEN 0.8 END AS ks, CASE WHEN t = 1 THEN 'Telecom' WHEN b <> 1 THEN 'Água S.A.' END AS o, CASE WHEN t = 1 THEN 0.95 WHEN b <> 1 THEN 0.85 END AS os FROM c)
      SELECT id, k AS document_type, o AS correspondent, concat_ws(',', CASE WHEN b = 0 THEN 'house' END, CASE WHEN t = 1 THEN 'phone' END) AS tags, round(CAST(coalesce((ks + os) / 2, ks, os, 0.5) AS DOUBLE), 4) AS confidence FROM d""",
    "f23_directories": """WITH f AS (SELECT c_custkey AS id, c_custkey % 4 AS k, c_custkey % 30 AS n, c_custkey * 1000 AS bytes FROM customer), s AS (SELECT *, CASE WHEN n > 0 THEN 4.0 * n / (n + 1) + least(5.0, n * 1.5) ELSE 0 END AS x FROM f),
      d AS (SELECT *, CASE WHEN x + CASE k WHEN 0 THEN 6 ELSE 0 END >= CASE WHEN k IN (1, 2) THEN 6 ELSE 0 END AND x + CASE k WHEN 0 THEN 6 ELSE 0 END >= 2.5 THEN 'fiscal_nfe' WHEN k = 1 THEN 'medical_clinical' WHEN k = 2 THEN 'engineering_manuals' ELSE 'general_knowledge' END AS domain FROM s)
      SELECT id, domain, round(CASE WHEN n = 0 THEN 0e0 ELSE greatest(0, least(100, least(45, 15 * log10(n + 1) + least(20, n * 2.5)) + least(20, 3 * log10(greatest(10, bytes))) + 8 + CASE domain WHEN 'fiscal_nfe' THEN 20 WHEN 'medical_clinical' THEN 20 WHEN 'engineering_manuals' THEN 18 ELSE 8 END)) END, 2) AS priority FROM d""",
    "p16_watched": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'a/b.md' ELSE 'a/B.PDF' END AS path FROM events WHERE event_id % 6 IN (0, 3)",
    "f16_chunk_spans": """WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE length(text) > 0),
      s AS (SELECT doc_id, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS start, t, n, CAST(NULL AS BIGINT) AS stop FROM d
        UNION ALL SELECT doc_id, CASE WHEN stop IS NULL THEN chunk ELSE chunk + 1 END, CASE WHEN stop IS NULL THEN start ELSE greatest(stop - 150, start + 1) END, t, n,
          CASE WHEN stop IS NOT NULL THEN NULL WHEN start + 2000 >= n THEN n ELSE coalesce(
            CASE WHEN instr(w, chr(10) || chr(10)) > 0 THEN start + 2000 - instr(w, chr(10) || chr(10)) + 1 END, CASE WHEN instr(w, chr(10)) > 0 THEN start + 2000 - instr(w, chr(10)) + 1 END,
            CASE WHEN instr(translate(w, chr(9), ' '), ' ') > 0 THEN start + 2000 - instr(translate(w, chr(9), ' '), ' ') + 1 END, start + 2000) END
        FROM (SELECT *, reverse(substring(t, start + 1201, 800)) AS w FROM s) q WHERE stop IS NULL OR stop < n)
      SELECT doc_id, chunk, start, stop FROM s WHERE stop IS NOT NULL""",
    "f17_coverage": "SELECT doc_id, max(length(coalesce(text, ''))) AS n_chars, CAST(0 AS BIGINT) AS missed FROM documents GROUP BY doc_id",
    "f15_markdown_chunks": "SELECT 'notes/n' || doc_id || '.md' AS path, 'Note ' || doc_id AS doc_title, CAST([0, 3, 3][doc_id % 3 + 1] AS BIGINT) AS clearance_level, CAST(6 AS BIGINT) AS first_line, CAST(2 AS BIGINT) AS n_tags, TRUE AS gapless FROM documents WHERE text IS NOT NULL",
    "s20_mail_sections": """WITH m AS (SELECT 'm/' || conv_id || '-' || turn || '.eml' AS path, 'INC-' || (1000 + conv_id) || ' turn ' || turn AS title, 'see ALM-' || (20000 + turn) || chr(10) || 'end' AS body FROM conversations WHERE role IS NOT NULL)
      SELECT path, 'eml' AS format, title, CAST(0 AS BIGINT) AS section, 'Headers' AS heading, NULL AS text FROM m UNION ALL SELECT path, 'eml', title, 1, 'Message Body', body FROM m""",
    "s23_mail_messages": "SELECT 'm/' || conv_id || '-' || turn || '.eml' AS path, conv_id || '.' || turn || '@x' AS message_id, CASE WHEN turn > 0 THEN conv_id || '.' || (turn - 1) || '@x' END AS in_reply_to, role || '@x.org' AS sender, 'b@x.org,c@x.org' AS recipients, 'INC-' || (1000 + conv_id) || ' turn ' || turn AS subject, 'INC-' || (1000 + conv_id) || ',ALM-' || (20000 + turn) AS identifiers FROM conversations WHERE role IS NOT NULL",
    "d18_mail_edges": """WITH m AS (SELECT 'm/' || conv_id || '-' || turn || '.eml' AS path, conv_id || '.' || turn || '@x' AS id, CASE WHEN turn > 0 THEN conv_id || '.' || (turn - 1) || '@x' END AS up, role || '@x.org' AS sender, 'INC-' || (1000 + conv_id) AS inc, 'ALM-' || (20000 + turn) AS alm FROM conversations WHERE role IS NOT NULL)
      SELECT path, id AS source, up AS target, 'REPLIES_TO' AS relation FROM m WHERE up IS NOT NULL UNION ALL SELECT path, sender, 'b@x.org', 'EMAILED' FROM m UNION ALL SELECT path, sender, 'c@x.org', 'EMAILED' FROM m
      UNION ALL SELECT path, id, inc, 'MENTIONS_ENTITY' FROM m UNION ALL SELECT path, id, alm, 'MENTIONS_ENTITY' FROM m UNION ALL SELECT path, inc, alm, 'CORRELATED_WITH' FROM m""",
    "s22_invoice_items": "SELECT 'i/' || l_orderkey || '.xml' AS path, lpad(CAST(l_orderkey AS VARCHAR), 44, '0') AS invoice_key, CAST(l_linenumber AS BIGINT) AS item, 'P' || l_partkey AS code, round(CAST(l_quantity AS DOUBLE), 2) AS quantity, round(CAST(l_extendedprice AS DOUBLE), 2) AS amount, c[1:3] || '.' || c[4:6] || '.' || c[7:9] || '-' || c[10:11] AS recipient_tax_id, 'L' || l_suppkey AS batches FROM (SELECT *, lpad(CAST(o_custkey AS VARCHAR), 11, '0') AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey) x",
    "s24_table_rows": "WITH c AS (SELECT 't/' || c_custkey || '.csv' AS path, c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 9, '1') AS d FROM customer) SELECT path, CAST(1 AS BIGINT) AS row, d[1:3] || '.' || d[4:6] || '.' || d[7:9] || '-00' AS primary_id FROM c UNION ALL SELECT path, 2, 'LOTE-AB' || (1000 + k) FROM c",
    "s12_csv_sections": "WITH c AS (SELECT c_custkey, c_name, lpad(CAST(c_custkey AS VARCHAR), 9, '1') AS d FROM customer) SELECT 't/' || c_custkey || '.csv' AS path, 'csv' AS format, 'rows' AS kind, '2: name: ' || c_name || ' | city: Rio | cpf: ' || d[1:3] || '.' || d[4:6] || '.' || d[7:9] || '-00' AS first FROM c",
    "s10_markdown_sections": f"SELECT 'notes/n' || doc_id || '.md' AS path, 'Note ' || doc_id AS title, CAST(CASE WHEN trim(replace(replace(text, '#', ' '), '`', ' '), {_WHITE}) <> '' THEN 2 ELSE 1 END AS BIGINT) AS n, CASE WHEN trim(replace(replace(text, '#', ' '), '`', ' '), {_WHITE}) <> '' THEN 'Head ' || doc_id END AS heading FROM documents WHERE text IS NOT NULL",
    "s15_xml_sections": "SELECT 'x/' || n_nationkey || '.xml' AS path, 'nation' AS heading, '/nation [key=' || n_nationkey || ']' AS text FROM nation UNION ALL SELECT 'x/' || n_nationkey || '.xml', 'nation > name #1', '/nation/name: ' || n_name FROM nation UNION ALL SELECT 'x/' || n_nationkey || '.xml', 'nation > region #2', '/nation/region/id: ' || n_regionkey FROM nation",
    "s9_formats": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'markdown' WHEN 1 THEN 'docx' WHEN 2 THEN 'xls' WHEN 3 THEN 'text' WHEN 5 THEN 'eml' END AS format FROM events",
    "j16_entities_in_text": "SELECT n_nationkey AS id, n_name AS name, CAST(1 AS BIGINT) AS n FROM nation UNION ALL SELECT n_nationkey, r_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey",
}
