"""Lexical lookup for many questions at once: phrase and boolean matches, exact identifiers, a cascade of looser matches, and routes.

Records are (id, doc_identifier, title, content, clearance); questions are (question, text). Runs of terms are joined with phrases, and records are
thinned by a bitmap of what is looked for (``sieve``) before they are dealt. Clearance is filtered before ranking. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intent
from ..functions import scalar as S
from . import graph as G
from . import retrieval as R
from .sieve import sieve

# Fixed values.
STOP_WORDS = "the and for with from what are how why does que por como para uma dos das nos nas".split()
EXTRA_STOP_WORDS = "the and for with from what are how between root alarm relationship".split()
ALL_OF, LONGEST_OF, LONGEST, ANY_OF = 7, 8, 4, 10
EXACT_SCORE, MATCH_SCORE, RELATED_SCORE = 0.99, 0.94, 0.70
TITLE_HIT, BODY_HIT, LONG_TEXT, LONG_BONUS = 3.5, 1.5, 1500, 1.0
#: Terms of a phrase that it is looked up by, at the most.
HEAD = 4


def words_of(records: DataFrame) -> DataFrame:
    """(id, head, body): the terms of titles and bodies."""
    return records.select("id", R.terms(F.col("title")).alias("head"), R.terms(F.col("content")).alias("body"))


def match(records: DataFrame, clauses: DataFrame) -> DataFrame:
    """(question, branch, id) of records in which every phrase of a branch stands. clauses: (question, branch, phrase, terms), where ``phrase`` numbers a branch's phrases.

    A phrase is its terms in order without others between, in a title or a body. A branch is an AND of phrases; several branches of a question are its OR.
    A phrase is looked up as a whole, by its first HEAD terms, once for all questions that ask it: a frequent word in a phrase is never joined
    by itself, and runs of words that begin no phrase go where they are read. A phrase without terms matches nothing.
    """
    asked = G.cut(clauses.select("question", "branch", "phrase", F.array_join("terms", " ").alias("text"), F.size("terms").alias("size")).where("size > 0"))
    needs = clauses.groupBy("question", "branch").agg(F.countDistinct("phrase").alias("__phrases"))
    phrases = G.cut(asked.select("text", F.substring_index("text", " ", HEAD).alias("start"), "size").distinct())
    sizes = [r.n for r in phrases.select(F.least("size", F.lit(HEAD)).alias("n")).distinct().collect()]  # at most HEAD rows
    longest = phrases.agg(F.max("size")).first()[0] or 0
    passes = sieve(phrases.select("start").distinct(), "start")

    first = sieve(phrases.select(F.substring_index("start", " ", 1).alias("term")).distinct(), "term")
    if not sizes:
        return records.select("id").join(asked.select("question", "branch"), F.lit(False)).select("question", "branch", "id")
    piece = lambda n: F.when(F.size("words") - F.col("place") >= n, F.array_join(F.slice("words", F.col("place") + 1, F.lit(n)), " "))
    more = lambda n: F.array_join(F.slice("words", F.col("place") + 1, F.lit(longest)), " ") if n == HEAD < longest else F.lit(None).cast("string")
    # Runs of terms are put together only where one begins like a phrase; each has as many more terms as the longest phrase.
    fields = words_of(records).select("id", F.explode(F.array("head", "body")).alias("words"))
    begun = fields.select("id", "words", F.posexplode_outer("words").alias("place", "term")).where(F.col("term").isNotNull() & first(F.col("term")))
    stood = begun.select("id", F.inline(F.array(*(F.struct(piece(n).alias("start"), more(n).alias("more")) for n in sorted(sizes))))).select("id", "start", F.coalesce("more", "start").alias("run"))
    found = stood.where(F.col("start").isNotNull() & passes(F.col("start"))).distinct().join(phrases, "start").where(F.startswith(F.concat("run", F.lit(" ")), F.concat("text", F.lit(" "))))
    whole = found.select("text", "id").distinct()
    per_branch = asked.select("question", "branch", "phrase", "text").join(whole, "text").groupBy("question", "branch", "id").agg(F.countDistinct("phrase").alias("__n"))
    return per_branch.join(needs, ["question", "branch"]).where("__n = __phrases").select("question", "branch", "id")


def relevance(found: DataFrame, wanted: DataFrame, held: DataFrame, known: DataFrame) -> DataFrame:
    """found (question, id) with ``bm25`` for the question's terms in wanted (question, term): Okapi BM25, titles weighted. held: the records, ``counted``; known: the terms' ``frequencies``."""
    pairs = G.cut(found.select("question", "id").distinct())
    passes = sieve(pairs.select("id").distinct(), "id")
    asked = wanted.select("question", "term").distinct().join(known, "term")
    times = held.where(passes(F.col("id"))).select("id", "length", F.inline(F.arrays_zip("terms", "times"))).withColumnsRenamed({"terms": "term", "times": "tf"})
    part = R.rarity() * F.col("tf") * (R.K1 + 1) / (F.col("tf") + R.K1 * (1 - R.B + R.B * F.col("length") / F.col("mean")))
    scored = pairs.join(asked, "question").join(times, ["id", "term"]).groupBy("question", "id").agg(F.round(F.sum(part), 6).alias("bm25"))
    return found.join(scored, ["question", "id"], "left").fillna(0.0, ["bm25"])


def _best(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    ranked = W.partitionBy("question").orderBy(*order, F.col("id"))
    return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit)


def exact_lookup(records: DataFrame, wanted: DataFrame, clearance: int = 3, limit: int = 5) -> DataFrame:
    """(question, id, score, source, rank) for identifiers (question, raw, norm, text): records of that name, then records in which it stands.

    Of the latter, those that also hold another word of the question come first; within either, by BM25.
    """
    seen = records.where(F.col("clearance") <= clearance)
    keys = wanted.select("question", F.explode(F.array_distinct(F.array("raw", "norm"))).alias("doc_identifier"))
    named = seen.select("id", "doc_identifier").join(keys, "doc_identifier").select("question", "id").distinct().withColumn("stage", F.lit(0))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    words = F.array_distinct(F.filter(F.regexp_extract_all(low("text"), F.lit("[a-z0-9_-]{3,24}"), F.lit(0)), lambda w: ~w.isin(EXTRA_STOP_WORDS) & (w != low("raw")) & (w != low("norm"))))
    sides = wanted.select("question", F.slice(words, 1, 6).alias("extra"), F.posexplode(F.array_distinct(F.array("raw", "norm"))).alias("side", "name"))
    alone = sides.select("question", (F.col("side") * 100 + 99).alias("branch"), F.lit(0).alias("phrase"), R.terms(F.col("name")).alias("terms"))
    along = sides.select("question", "side", "name", F.posexplode("extra").alias("k", "word"))
    both = along.select("question", (F.col("side") * 100 + F.col("k")).alias("branch"), F.inline(F.array(F.struct(F.lit(0).alias("phrase"), R.terms(F.col("name")).alias("terms")), F.struct(F.lit(1).alias("phrase"), R.terms(F.col("word")).alias("terms")))))
    hits = match(seen, alone.unionByName(both)).select("question", "id", (F.floor(F.col("branch") / 100) * 2 + F.when(F.col("branch") % 100 == 99, 2).otherwise(1)).cast("int").alias("stage"))
    every = G.cut(named.unionByName(hits).groupBy("question", "id").agg(F.min("stage").alias("stage")))
    terms = sides.select("question", F.explode(F.concat(R.terms(F.col("name")), F.flatten(F.transform("extra", R.terms)))).alias("term"))
    # Records of the name itself come in the order of their ids, so that only the others are scored.
    within = every.where("stage > 0")
    terms = G.cut(terms.join(within.select("question").distinct(), "question", "left_semi").distinct())
    if terms.isEmpty():
        scored = within.withColumn("bm25", F.lit(0.0))
    else:
        names = G.cut(terms.select("term").distinct())
        held = R.counted(seen, names)
        scored = relevance(within, terms, held, R.frequencies(held, names)).select("question", "id", "stage", "bm25")
    ranked = _best(scored.unionByName(every.where("stage = 0").withColumn("bm25", F.lit(0.0))), limit, F.col("stage"), F.desc(F.when(F.col("stage") > 0, F.col("bm25"))))
    direct = F.col("stage") == 0
    return ranked.select("question", "id", F.when(direct, EXACT_SCORE).otherwise(MATCH_SCORE).alias("score"), F.when(direct, "identifier").otherwise("text").alias("source"), "rank")


def meaningful(text: Column) -> Column:
    """The words of a question that are looked for, each once, in order: no stop words, single characters or short numbers; without any, all of its words."""
    words = F.array_distinct(R.terms(text))
    kept = F.filter(words, lambda w: ~w.isin(STOP_WORDS) & (F.length(w) >= 2) & ~w.rlike("^[0-9]{1,2}$"))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(words, 1, 8))


def overlap_score(title_hits: Column, body_hits: Column, length: Column, boost: Column | float = 0.0) -> Column:
    """What the cascade sorts by."""
    return TITLE_HIT * title_hits + BODY_HIT * body_hits + boost + F.when(length > LONG_TEXT, F.lit(LONG_BONUS)).otherwise(F.lit(0.0))


def calibrated(title_hits: Column, body_hits: Column, n_words: Column) -> Column:
    """The confidence of a hit: from its share of the question's words, and the title's."""
    share = F.least(F.lit(1.0), body_hits / F.greatest(F.lit(1), n_words))
    return F.bround(F.least(F.lit(0.98), F.lit(0.48) + share * 0.36 + F.least(F.lit(0.14), title_hits * 0.05)), 4)


def holding_all(held: DataFrame, branches: DataFrame, known: DataFrame) -> DataFrame:
    """(question, stage, id) of records (id, held: their distinct terms) that hold all words of a branch (question, stage, all). known: the words' ``frequencies``.

    Terms that nothing asks for need not be among those held. A branch is looked up by its rarest word only, and the others are tested on what that gives, so frequent words are never joined.
    """
    words = branches.select("question", "stage", "all", F.explode("all").alias("term"))
    rarest = G.cut(words.join(known, "term").groupBy("question", "stage", "all").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size("all")))
    names = rarest.select("term").distinct()
    passes = sieve(names, "term")
    used = held.select("id", F.explode_outer("held").alias("term")).where(F.col("term").isNotNull() & passes(F.col("term")))
    near = G.cut(rarest.join(used, "term").select("question", "stage", "all", "id"))
    likely = sieve(near.select("id").distinct(), "id")
    return near.join(held.where(likely(F.col("id"))), "id").where(F.forall("all", lambda w: F.array_contains("held", w))).select("question", "stage", "id")


def cascade(records: DataFrame, questions: DataFrame, clearance: int = 3, limit: int = 5) -> DataFrame:
    """(question, id, score, band, overlap, stage, rank): records with all words of a question, then with its four longest, then with any.

    Each stage gives its max(5 * limit, 25) best by BM25, and a looser one is used only where the stricter ones gave fewer records than that.
    What is found is sorted by overlap, then BM25.
    """
    cap = max(5 * limit, 25)
    seen = records.where((F.col("clearance") <= clearance) & F.col("id").isNotNull())
    asked = G.cut(questions.select("question", meaningful(F.col("text")).alias("words")).where(F.size("words") > 0))
    terms = asked.select("question", F.explode("words").alias("term"))
    names = G.cut(terms.select("term").distinct())
    # Texts are cut into terms here only, once for all stages.
    counted = R.counted(seen, names)
    known = R.frequencies(counted, names)
    held = counted.select("id", F.col("terms").alias("held"))
    longest = F.transform(F.slice(F.array_sort(F.transform(F.slice("words", 1, LONGEST_OF), lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), 1, LONGEST), lambda x: x["w"])
    stages = F.array(
        F.struct(F.lit(0).alias("stage"), F.when(F.size("words") >= 2, F.slice("words", 1, ALL_OF)).alias("all")),
        F.struct(F.lit(1).alias("stage"), F.when(F.size("words") >= 4, longest).alias("all")),
    )
    strict = relevance(G.cut(holding_all(held, asked.select("question", F.inline(stages)).where("all is not null"), known)), terms, counted, known)
    best = W.partitionBy("question", "stage").orderBy(F.desc("bm25"), "id")
    strict = G.cut(strict.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= cap).select("question", "stage", "id"))
    sizes = strict.groupBy("question").agg(F.countDistinct(F.when(F.col("stage") == 0, F.col("id"))).alias("first"), F.countDistinct("id").alias("both"))
    second = strict.join(sizes, "question").where((F.col("stage") == 0) | (F.col("first") < cap)).select("question", "stage", "id")
    open_ = asked.join(sizes, "question", "left").where(F.coalesce(F.when(F.col("first") >= cap, F.col("first")).otherwise(F.col("both")), F.lit(0)) < cap)
    loose = R.lexical(counted, known, G.cut(open_.where("question is not null").select("question", F.explode(F.slice("words", 1, ANY_OF)).alias("term"))), cap).select("question", F.lit(2).alias("stage"), "id")
    chosen = G.cut(second.unionByName(loose).groupBy("question", "id").agg(F.min("stage").alias("stage")))
    scored = relevance(chosen, terms, counted, known)
    texts = seen.select("id", R.folded(F.col("title")).alias("__title"), R.folded(F.col("content")).alias("__body"), F.length(F.coalesce("content", F.lit(""))).alias("__length"))
    shown = sieve(chosen.select("id").distinct(), "id")
    # Texts are joined last, so that they are not dealt again with each question.
    joined = scored.select("question", "id", "stage", "bm25").join(asked, "question").join(texts.where(shown(F.col("id"))), "id")
    hits_in = lambda c: F.size(F.filter("words", lambda w: F.contains(F.col(c), w)))
    measured = joined.withColumn("__t", hits_in("__title")).withColumn("__b", hits_in("__body"))
    final = measured.select("question", "id", "stage", "bm25", F.round(overlap_score(F.col("__t"), F.col("__b"), F.col("__length")), 6).alias("overlap"), calibrated(F.col("__t"), F.col("__b"), F.size("words")).alias("score"))
    ranked = _best(final, limit, F.desc("overlap"), F.desc("bm25"))
    return ranked.select("question", "id", "score", intent.lexical_band(F.col("score")).alias("band"), "overlap", "stage", "rank")


def number_neighbours(records: DataFrame, wanted: DataFrame, clearance: int = 3, limit: int = 5) -> DataFrame:
    """(question, identifier, title, distance, rank) near a missing identifier (question, norm) of the form PREFIX-number: identifiers of that prefix in names and titles, by distance of the numbers.

    Alarms are looked for among those that share the number without its last digit, and where those are fewer than 2 * limit, without its
    last two. An identifier is compared once, however many questions miss it.
    """
    seen = records.where(F.col("clearance") <= clearance)
    stood = seen.select("title", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.concat_ws(" ", "doc_identifier", "title"), F.lit(r"(?i)\b([A-Z]{2,6}-\d+)\b"), F.lit(1)), F.upper))).alias("identifier"))
    known = stood.groupBy("identifier").agg(F.min("title").alias("title")).withColumn("prefix", F.split("identifier", "-")[0]).withColumn("digits", F.split("identifier", "-")[1])
    asked = wanted.select("question", F.upper("norm").alias("norm")).where(F.col("norm").rlike(r"^[A-Z]{2,6}-\d+")).select("question", "norm", F.split("norm", "-")[0].alias("prefix"), F.regexp_extract("norm", r"-(\d+)", 1).alias("of"))
    near = asked.drop("question").distinct().join(known, "prefix").where(F.regexp_extract("norm", r"^([A-Z]{2,6}-\d+)", 1) != F.col("identifier"))
    distance = F.abs(F.col("digits").cast("decimal(38,0)") - F.col("of").cast("decimal(38,0)")).cast("long")
    alarm, size = F.col("prefix") == "ALM", F.length("of")
    one, two = F.col("digits").startswith(F.substr("of", F.lit(1), size - 1)), F.col("digits").startswith(F.substr("of", F.lit(1), size - 2))
    ring = F.when(~alarm, 0).when((size >= 3) & one, 0).when((size >= 5) & two, 1)
    rows = near.withColumn("distance", distance).withColumn("ring", ring).where("ring is not null")
    by = lambda *keys: W.partitionBy("norm", *keys).orderBy("distance", "identifier")
    inner = F.sum((F.col("ring") == 0).cast("int")).over(W.partitionBy("norm"))
    # Whether the second ring counts depends on the question; the first rows of either ring hold the first rows of both.
    best = rows.withColumn("__inner", inner).withColumn("__r", F.row_number().over(by("ring"))).where(F.col("__r") <= limit).select("norm", "identifier", "title", "distance", "ring", "__inner")
    counts = best.select("norm", "__inner").distinct()
    first = asked.join(counts, "norm").groupBy("question").agg(F.sum("__inner").alias("__n"))
    kept = asked.select("question", "norm").join(best, "norm").join(first, "question").where((F.col("ring") == 0) | (F.col("__n") < 2 * limit))
    order = W.partitionBy("question").orderBy("distance", "identifier")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("question", "identifier", "title", "distance", "rank")


def similar_commands(records: DataFrame, wanted: DataFrame, clearance: int = 3, limit: int = 5) -> DataFrame:
    """(question, identifier, title, rank) of commands in titles with the verb and the first four characters of a missing command (question, norm). A command is looked up once, however many questions miss it."""
    seen = records.where(F.col("clearance") <= clearance)
    stood = seen.select("title", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(r"(?i)(?=\b([A-Z]{3}\s+[A-Z0-9_]{3,20})\b)"), F.lit(1)), lambda c: F.regexp_replace(F.upper(c), r"\s+", " ")))).alias("identifier"))
    known = stood.groupBy("identifier").agg(F.min("title").alias("title")).withColumn("stem", F.substring("identifier", 1, 8))
    asked = wanted.select("question", F.regexp_replace(F.upper("norm"), r"\s+", " ").alias("norm")).where(F.col("norm").rlike(r"^[A-Z]{3} [A-Z0-9_]+")).withColumn("stem", F.substring("norm", 1, 8))
    near = asked.drop("question").distinct().join(known, F.startswith(known["stem"], asked["stem"]) & (F.substring(known["stem"], 1, 4) == F.substring(asked["stem"], 1, 4))).where(F.col("norm") != F.col("identifier"))
    best = near.withColumn("__n", F.row_number().over(W.partitionBy("norm").orderBy("identifier"))).where(F.col("__n") <= limit).select("norm", "identifier", "title")
    order = W.partitionBy("question").orderBy("identifier")
    return asked.select("question", "norm").join(best, "norm").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("question", "identifier", "title", "rank")


def in_domain(records: DataFrame, scopes: dict[str, dict[str, list[str]]], domain: str | None) -> DataFrame:
    """Records of a domain's scope: ``scopes[domain]`` lists values of ``domain`` that count, and texts that count within identifiers, titles and addresses. No domain, ``all`` and ``*``: every record."""
    name = (domain or "").strip().lower()
    if name in ("", "all", "none", "*"):
        return records
    rules = scopes[name]
    within = lambda c, texts: F.greatest(F.lit(False), F.lit(False), *(F.coalesce(F.lower(c).contains(t), F.lit(False)) for t in texts))
    test = F.lower("domain").isin(rules.get("domain", [])) if "domain" in records.columns else F.lit(False)
    for column, texts in rules.items():
        if column != "domain" and column in records.columns:
            test = test | within(F.col(column), texts)
    return records.where(F.coalesce(test, F.lit(False)))


def one_per_document(hits: DataFrame, key: Column, whole: Column) -> DataFrame:
    """Ranked hits (question, rank, ...) with one for each document: its whole record if that is among them, else its best; each takes the best rank of its document."""
    keyed = hits.withColumn("__key", key).withColumn("__whole", whole.cast("int"))
    own = W.partitionBy("question", "__key")
    best = keyed.withColumn("__best", F.min("rank").over(own)).withColumn("__n", F.row_number().over(own.orderBy(F.desc("__whole"), "rank"))).where("__n = 1")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("question").orderBy("__best"))).drop("__key", "__whole", "__best", "__n")


def fold_duplicates(hits: DataFrame, least: float | None = None, chars: int = 6000) -> DataFrame:
    """Ranked hits (question, rank, topic_id, record_kind, content) without composites whose native record is among them; that gets their number as ``collapsed``.

    With ``least``, only composites whose words overlap the native's that much are folded.
    """
    native = hits.where("record_kind = 'native' and topic_id is not null").groupBy("question", "topic_id").agg(F.min_by(F.struct("rank", "content"), "rank").alias("__native"))
    joined = hits.join(native, ["question", "topic_id"], "left")
    close = F.lit(True) if least is None else S.overlap(F.col("content"), F.col("__native.content"), chars) >= least
    folds = F.coalesce((F.col("record_kind") == "composite") & F.col("__native").isNotNull() & close, F.lit(False))
    marked = joined.withColumn("__folds", folds).withColumn("__at", F.col("__native.rank"))
    counts = marked.where("__folds").groupBy("question", F.col("__at").alias("rank")).agg(F.count(F.lit(1)).alias("collapsed"))
    kept = marked.where("not __folds").drop("__native", "__folds", "__at").join(counts, ["question", "rank"], "left").fillna(0, ["collapsed"])
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("question").orderBy("rank")))


def first_of(*parts: DataFrame) -> DataFrame:
    """(question, id, score) lists as one: of records in several, the first list counts; the lists follow each other."""
    rows = None
    for n, part in enumerate(parts):
        own = part.select("question", "id", "score", F.lit(n).alias("part"), "rank")
        rows = own if rows is None else rows.unionByName(own)
    once = rows.withColumn("__n", F.row_number().over(W.partitionBy("question", "id").orderBy("part", "rank"))).where("__n = 1").drop("__n")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("question").orderBy("part", "rank", "id")))


def route(records: DataFrame, questions: DataFrame, clearance: int = 3, limit: int = 5, product: str = "Acme") -> DataFrame:
    """(question, route_type, id, score, part, rank): each question answered by its route.

    Direct: exact lookup, with nothing else where the identifier is missing. Fused: exact lookup, then the cascade. All others: the
    cascade. ``part`` tells which list a record comes from. Relations and vectors are other operators' (``graphstore``, ``search``).
    """
    routed = G.cut(questions.withColumn("c", intent.classify(F.col("text"), product))).select("question", "text", F.col("c.route_type").alias("route_type"), F.col("c.extracted_identifier").alias("found"))
    named = routed.where("found is not null").select("question", F.col("found.raw_value").alias("raw"), F.col("found.normalized_value").alias("norm"), "text")
    open_ = routed.where("route_type <> 'deterministic_direct'").select("question", "text")
    found = first_of(exact_lookup(records, named, clearance, limit), cascade(records, open_, clearance, limit)).where(F.col("rank") <= limit)
    return found.join(routed.select("question", "route_type"), "question").select("question", "route_type", "id", "score", "part", "rank")
