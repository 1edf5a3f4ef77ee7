"""Question analysis as columns: identifier grammars, intents, routes, confidence bands and clearance levels.

``classify`` gives a struct per question and runs no Python. Patterns use ``(?U)``, so that word boundaries,
digits and letters count as in Unicode. A decision record may be named after a product; that name is a parameter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalar as S

# Fixed values.
RESERVED = (
    "TAX IRPF DIRPF DARF DAS PIS COFINS CSLL ICMS ISS IOF INSS BACEN CDI SELIC IPCA IGPM TED PIX CVM DRE EBITDA ROI ROE "
    "CEO CFO COO CTO CIO CRO CMO CLO CHRO BOD VP SVP EVP "
    "LGPD GDPR HIPAA SOX PCI SEC DOJ OAB STF STJ TRF TST CLT LAW WAR ACT DOD DLP MAC RBAC SLA NDA MOU LOI "
    "API CPU GPU RAM SSD HDD NVME SQL NOSQL RAG LLM NLP OCR WAL BFS DFS HTTP HTTPS REST JSON YAML HTML CSS DNS TLS "
    "TCP UDP SSH BFF SDK CLI UI UX HNSW RRF ONNX AVX "
    "THE AND FOR NOT YES WHY HOW WHO WHAT WHEN QUE COM SEM POR PARA MAS SIM VER DOC PDF USA BRA"
).split()
CONCEPTS = (
    "ARCHITECTURE TOPOLOGY CONTAINER CLUSTER DEVICES FAILOVER REDUNDANCY POLICIES PROCEDURES METRICS TELEMETRY SECURITY GOVERNANCE ORCHESTRATION "
    "MONITORING BACKUP PIPELINE MIGRATION INGRESS ROUTER STORAGE VIRTUALIZATION CONSENSUS DISCOVERY SYNTHESIS RUNBOOK COMMISSIONING PREREQUISITES RECOVERY "
    "RESILIENCE INFRASTRUCTURE PROVISIONING REVERSE_PROXY TRAEFIK NOMAD ANSIBLE GITOPS OBSERVABILITY AUDIT SENSOR FLEET SELF_HEAL SELF_HEALING"
).split()
SYNTHESIS = (
    r"por\s+que|porque|por\s+quê|resuma|resumo|síntese|sintetize|sintetizar|explique|explicar|explicação|qual\s+a\s+razão|quais\s+as\s+razões|"
    r"analise|analisar|análise|comparar|compare|diferença\s+entre|conclusão|o\s+que\s+significa|descreva|descrever|visão\s+geral|panorama\s+geral|tese|macro\s+síntese|"
    r"como\s+funciona|como\s+configurar|como\s+são|quais\s+as\s+regras|quais\s+os\s+requisitos|o\s+que\s+é|"
    r"why|explain|explanation|summarize|summary|synthesis|synthesize|analyze|analysis|compare|comparison|difference\s+between|conclusion|what\s+does\s+.*mean|"
    r"describe|description|overview|macro\s+synthesis|thematic\s+synthesis|executive\s+overview|thesis|how\s+does|how\s+are|how\s+to|what\s+are|what\s+is\s+the\s+protocol"
)
RELATIONAL = (
    r"relacionamento|relacionamentos|relação|relações|conectado|conexão|conexões|ligação|ligações|grafo|hierarquia|proprietário|proprietários|participação|participações|"
    r"estrutura\s+societária|sócio|sócios|vínculo|vínculos|rede\s+de|entre\s+.*e\s+.*|relationship|relationships|relation|relations|connected\s+to|connections?\s+between|links?|"
    r"graph|hierarchy|owner|ownership|shareholders?|corporate\s+structure|partners?|network\s+of"
)
MACRO = (
    r"visão\s+geral|panorama\s+geral|tese|macro\s+síntese|estrutura\s+temática|análise\s+global|todo\s+o\s+documento|livro\s+completo|todos\s+os\s+capítulos|arco\s+narrativo|"
    r"evolução\s+temática|tema\s+central|ao\s+longo\s+da\s+obra|macro\s+synthesis|thematic\s+synthesis|executive\s+overview|thesis|overarching\s+theme|narrative\s+arc|central\s+theme|"
    r"philosophical\s+evolution|entire\s+document|whole\s+book|global\s+summary|across\s+all\s+chapters"
)
MIN_ENTROPY = 2.8
CLEARANCE = {"public": 0, "0": 0, "internal": 1, "1": 1, "confidential": 2, "2": 2, "restricted": 3, "top_secret": 3, "top-secret": 3, "secret": 3, "admin": 3, "max": 3, "3": 3}
PHARMACY, CLINIC, TELECOM, WIKI, SKILLS = "pharmacies_and_smb_retail", "boutique_medical_and_longevity_clinics", "telco_and_academic_libraries", "homelab_wiki", "agent_skills"


class Grammar(NamedTuple):
    """One kind of identifier. ``raw`` and ``value`` are groups of the pattern; ``form`` makes the normalised value of the latter."""

    kind: str
    pattern: str
    raw: int = 1
    value: int = 1
    form: str = "as is"
    confidence: float = 1.0
    domain: str | None = None
    entropy_of_raw: bool = False


#: In the order in which they are tried; the first that matches counts.
GRAMMARS = (
    Grammar("hex", r"\b(0x[0-9a-fA-F]{4,16})\b", form="lower", entropy_of_raw=True),
    Grammar("cnpj", r"\b(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})\b", form="digits", entropy_of_raw=True),
    Grammar("cpf", r"\b(\d{3}\.\d{3}\.\d{3}-\d{2})\b", form="digits", entropy_of_raw=True),
    Grammar("nfe_chave", r"\b(\d{44}|(?:\d{4}[\s-]){10}\d{4})\b", form="digits", domain=PHARMACY),
    Grammar("anvisa_ms", r"(?i)\b((?:MS[\s-]*)?(1\.\d{4}\.\d{4}\.\d{3}-\d))\b", value=2, domain=PHARMACY),
    Grammar("lote", r"(?i)\b(LOTE[-:\s]+([A-Z0-9][A-Z0-9\-]{3,20}))\b", value=2, form="upper", domain=PHARMACY),
    Grammar("portaria_344_lista", r"(?i)\b(Lista\s+(A1|A2|A3|B1|B2|C1|C2|C3|C4|C5))\b", value=2, form="list", confidence=0.98, domain=PHARMACY),
    Grammar("crm", r"(?i)\b(CRM[-/\s]*([A-Z]{2})[\s-]*(\d{4,7}))\b", value=2, form="crm", domain=CLINIC),
    Grammar("cid10", r"(?:(?i:\bCID[-\s]*10?:?\s*([A-TV-Z]\d{2}(?:\.\d)?)\b)|\b([A-TV-Z]\d{2}\.\d)(?!\.\d)\b)", raw=0, form="either", confidence=0.99, domain=CLINIC),
    Grammar("telecom_alarm", r"(?i)\b(ALM-\d{3,6})\b", form="upper", domain=TELECOM),
    Grammar("mml_command", r"\b((?:ADD|MOD|RMV|LST|DSP|SET|ACT|DEA|RST|PING|TRC)\s+[A-Z0-9_]{3,20}|NGPING|NGTRACEROUTE)\b", form="spaced upper", domain=TELECOM),
    Grammar("telecom_kpi", r"\b(VS\.[A-Za-z0-9_.]{5,40})\b", domain=TELECOM),
    Grammar("telco_spec", r"(?i)\b(3GPP\s+TS\s+\d{2}\.\d{3}(?:\s+v\d+\.\d+\.\d+)?|RFC\s*\d{3,5})\b", form="spaced", domain=TELECOM),
    Grammar("isbn", r"(?i)\b(ISBN(?:-1[03])?:?\s*((?:97[89][-\s]?)?\d{1,5}[-\s]?\d{1,7}[-\s]?\d{1,6}[-\s]?[\dX]))\b", value=2, form="isbn", domain=TELECOM),
    Grammar("wiki_adr", r"(?i)\bPRODUCT\s+ADR[-\s]?(\d{1,3})\b", form="named record", domain=WIKI),
    Grammar("wiki_adr", r"(?i)\b(ADR-\d{1,3})\b", form="record", domain=WIKI),
    Grammar("agent_skill", r"(?i)\b((?:manage|trigger|prowlarr|pihole|nomad|download)-[a-z0-9]+(?:-[a-z0-9]+)+)\b", form="lower", domain=SKILLS),
    Grammar("ticket", r"\b([A-Z]{2,6}-\d{2,8}(?:-[A-Z0-9]{1,8})?|[A-Z]{2,6}-[A-Z0-9]{4,12}(?:-[A-Z0-9]{2,12})?)\b", form="upper", entropy_of_raw=True),
    Grammar("quoted_phrase", r'"([^"]{2,160})"', raw=0, confidence=0.98),
)

IDENTIFIER = "struct<id_type:string,raw_value:string,normalized_value:string,confidence:double,entropy:double,domain:string>"


def _found(question: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(question, "(?U)" + pattern, group), F.lit(""))


def _identifier(question: Column, g: Grammar, product: str) -> Column:
    """The struct of one grammar's first match, or null."""
    pattern = g.pattern.replace("PRODUCT", product)
    found = lambda group: S.stripped(_found(question, pattern, group))
    raw, value = found(g.raw), found(g.value)
    spaced = lambda c: F.regexp_replace(c, r"(?U)\s+", " ")
    if g.form == "either":
        value = F.upper(F.coalesce(_found(question, pattern, 1), _found(question, pattern, 2)))
    elif g.form == "named record":
        number = F.regexp_replace(value, "^0+(?=.)", "")
        raw = value = F.concat(F.lit(f"{product} ADR-"), F.when(F.length(number) < 2, F.concat(F.lit("0"), number)).otherwise(number))
    elif g.form == "record":
        raw = value = F.upper(value)
    else:
        value = {
            "as is": lambda c: c,
            "lower": F.lower,
            "upper": F.upper,
            "digits": lambda c: F.regexp_replace(c, r"(?U)[^\d]", ""),
            "list": lambda c: F.concat(F.lit("Lista "), F.upper(c)),
            "crm": lambda c: F.concat(F.lit("CRM-"), F.upper(c), F.lit(" "), found(3)),
            "spaced": spaced,
            "spaced upper": lambda c: spaced(F.upper(c)),
            "isbn": lambda c: F.regexp_replace(F.upper(c), r"(?U)[^\dX]", ""),
        }[g.form](value)
    entropy = S.entropy(raw if g.entropy_of_raw else value)
    made = F.struct(F.lit(g.kind).alias("id_type"), raw.alias("raw_value"), value.alias("normalized_value"), F.lit(g.confidence).alias("confidence"), F.round(entropy, 6).alias("entropy"), F.lit(g.domain).cast("string").alias("domain"))
    return F.when(_found(question, pattern, 0).isNotNull(), made)


def _code(question: Column) -> Column:
    """The first token of letters and digits that looks drawn at random and is no known word."""
    known = lambda t: F.upper(t).isin(RESERVED + CONCEPTS)
    odd = lambda t: t.rlike(r"(?U)\d") & t.rlike(r"\p{L}") & ~known(t) & (S.entropy(t) >= MIN_ENTROPY)
    tokens = F.filter(F.regexp_extract_all(question, F.lit(r"(?U)\b[A-Za-z0-9_-]{4,20}\b"), F.lit(0)), odd)
    made = lambda t: F.struct(F.lit("high_entropy_code").alias("id_type"), t.alias("raw_value"), t.alias("normalized_value"), F.lit(0.9).alias("confidence"), F.round(S.entropy(t), 6).alias("entropy"), F.lit(None).cast("string").alias("domain"))
    return F.get(F.transform(tokens, made), F.lit(0))


def is_guarded(question: Column) -> Column:
    """A single word or acronym of the domain, which must not be taken for an identifier."""
    return F.upper(S.stripped(question)).isin(RESERVED + CONCEPTS)


def identifier(question: Column, product: str = "Acme") -> Column:
    """The identifier that a question names, as IDENTIFIER, or null."""
    body = S.stripped(question)
    return F.when(~is_guarded(question) & (body != ""), F.coalesce(*(_identifier(body, g, product) for g in GRAMMARS), _code(body)))


def has_intent(question: Column, words: str) -> Column:
    return S.stripped(question).rlike(rf"(?iU)\b({words})\b")


def classify(question: Column, product: str = "Acme") -> Column:
    """route_type, extracted_identifier, bypass_vector_search, safe_fail_on_missing_id, retrieval_mode, analytical_depth, graph_hops and needs_synthesis. Null and blank questions: a plain hybrid search."""
    open_ = ~is_guarded(question)
    synthesis, relational, macro = (open_ & has_intent(question, w) for w in (SYNTHESIS, RELATIONAL, MACRO))
    seen = F.struct(identifier(question, product).alias("found"), synthesis.alias("synthesis"), relational.alias("relational"), macro.alias("macro"), F.contains(S.stripped(question), F.lit("?")).alias("asked"))
    #: route, mode, depth, hops, synthesis
    table = {
        "fused synthesis": ("compound_fused", "exact_entity", "deep_synthesis", 0, True),
        "fused relations": ("compound_fused", "exact_entity", "relational_audit", 2, True),
        "direct": ("deterministic_direct", "high_precision", "flash_needle", 0, False),
        "macro": ("macro_synthesis", "high_precision", "deep_synthesis", 0, True),
        "relations": ("relational_graph", "exact_entity", "relational_audit", 2, True),
        "explained": ("hybrid_needle", "high_precision", "flash_needle", 0, True),
        "plain": ("hybrid_needle", "high_precision", "flash_needle", 0, False),
    }

    def case(x: Column) -> Column:
        given = x["found"].isNotNull()
        listed = F.coalesce(x["asked"] & (x["found"]["id_type"] == "portaria_344_lista"), F.lit(False))
        name = (
            F.when(given & (x["synthesis"] | x["macro"] | listed), F.lit("fused synthesis"))
            .when(given & x["relational"], F.lit("fused relations"))
            .when(given, F.lit("direct"))
            .when(x["macro"], F.lit("macro"))
            .when(x["relational"], F.lit("relations"))
            .when(x["synthesis"], F.lit("explained"))
            .otherwise(F.lit("plain"))
        )
        return F.struct(x["found"].alias("found"), name.alias("case"))

    def decision(x: Column) -> Column:
        pick = lambda place: F.element_at(F.create_map(*(F.lit(v) for key, row in table.items() for v in (key, row[place]))), x["case"])
        direct = x["case"] == "direct"
        return F.struct(pick(0).alias("route_type"), x["found"].alias("extracted_identifier"), direct.alias("bypass_vector_search"), direct.alias("safe_fail_on_missing_id"), pick(1).alias("retrieval_mode"), pick(2).alias("analytical_depth"), pick(3).alias("graph_hops"), pick(4).alias("needs_synthesis"))

    # Bound by lambdas, so that each step is computed once however often the next one names it.
    return F.get(F.transform(F.transform(F.array(seen), case), decision), F.lit(0))


def _band(score: Column, steps: tuple[tuple[float, str], ...], last: str) -> Column:
    name = F.lit(None).cast("string")
    for least, label in reversed(steps):
        name = F.when(score >= least, F.lit(label)).otherwise(F.coalesce(name, F.lit(last)))
    return name


def confidence_band(score: Column, direct: Column | bool = False, has_results: Column | bool = True) -> Column:
    """(score, label, level) of an answer; a direct lookup without results scores 0."""
    level = _band(score, ((0.85, "HIGH_VERIFIED"), (0.55, "MEDIUM_RELEVANT"), (0.35, "LOW_MARGINAL")), "LOW_EPISTEMIC_REFUSAL")
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    missing = ~as_col(has_results) & as_col(direct)
    own = F.struct(F.bround(score, 4).alias("score"), F.concat(level, F.lit(" ("), F.bround(score * 100, 0).cast("int").cast("string"), F.lit("%)")).alias("label"), level.alias("level"))
    refused = F.struct(F.lit(0.0).alias("score"), F.lit("LOW_EPISTEMIC_REFUSAL (0% - Not Found)").alias("label"), F.lit("LOW_EPISTEMIC_REFUSAL").alias("level"))
    return F.when(missing, refused).otherwise(own)


def lexical_band(score: Column) -> Column:
    """The band of a hit of the lexical fallback."""
    return _band(score, ((0.80, "HIGH_VERIFIED"), (0.55, "MEDIUM_RELEVANT")), "LOW_MARGINAL")


def fused_band(score: Column) -> Column:
    """The band of a fused hit."""
    return _band(score, ((0.75, "HIGH_VERIFIED"), (0.35, "MEDIUM_RELEVANT")), "LOW_MARGINAL")


def clearance_level(value: Column) -> Column:
    """A level from 0 (public) to 3 (restricted). Unknown names and numbers, and null, fail closed: 3."""
    known = F.create_map(*(F.lit(x) for pair in CLEARANCE.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower(S.stripped(value.cast("string")))), F.lit(3))


def authorized_levels(value: Column) -> Column:
    """All levels that a caller may see. Unlike a document's, a caller's unknown level fails closed at 0."""
    known = F.create_map(*(F.lit(x) for pair in CLEARANCE.items() for x in pair))
    return F.sequence(F.lit(0), F.coalesce(F.element_at(known, F.lower(S.stripped(value.cast("string")))), F.lit(0)))
