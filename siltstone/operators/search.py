"""Fused search with modes and depths, evidence packing, extractive answers, and two-level retrieval over chapters and chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import retrieval as R

# Fixed values.
WEIGHTS = {"high_precision": (1.0, 1.0), "exact_entity": (0.8, 1.6), "legal_discovery": (1.0, 1.0)}
LEAST_BY_MODE = {"legal_discovery": 10}
LEAST_BY_DEPTH = {"deep_synthesis": 10, "relational_audit": 7}
CHAPTER_WEIGHT, CHUNK_WEIGHT = 0.4, 0.6
BASELINE_TOKENS = 15_000
REFUSAL_BELOW = 0.35
RULE = "\n\n---\n\n"
GROUNDING = {"verbatim_footnotes": "### EVIDÊNCIAS AUDITADAS (VERBATIM)\n", "executive_abstract": "### SÍNTESE EXECUTIVA CONSOLIDADA\n"}
POSTURE = {"compliance_auditor": "### [COMPLIANCE AUDIT POSTURE: STATUTORY RISK & LIABILITY SCRUTINY]\n", "scholarly": "### [SCHOLARLY POSTURE: EPISTEMOLOGICAL & COMPARATIVE RIGOR]\n"}
WORD_TOKENS = 1.33
ANSWER_CHUNKS, ANSWER_SENTENCES = 3, 2


@dataclass(frozen=True)
class Mode:
    """How many records a search gives, and how its legs weigh."""

    limit: int = 5
    retrieval: str = "high_precision"
    depth: str = "flash_needle"
    floor: float = 0.0

    @property
    def k(self) -> int:
        return max(self.limit, LEAST_BY_MODE.get(self.retrieval, 0), LEAST_BY_DEPTH.get(self.depth, 0))

    @property
    def weights(self) -> tuple[float, float]:
        return WEIGHTS[self.retrieval]


def search(records: DataFrame, vectors: DataFrame, texts: DataFrame, queries: DataFrame, mode: Mode = Mode(), clearance: int = 3, dimension: int = S.CALIBRATED_DIMENSION) -> DataFrame:
    """(question, id, score, confidence, rank): records (id, title, content, clearance) by words of texts (question, text) and vectors (id, v) by queries (question, q), fused by reciprocal rank.

    Clearance holds on both legs, before ranking. Each leg gives twice as many candidates as are wanted. A floor on scores may leave
    fewer. A vector whose id is no record's is not found.
    """
    seen = records.where(F.col("clearance") <= clearance)
    allowed = vectors.join(seen.select("id"), "id", "left_semi")
    dense = R.cosine(allowed, queries, 2 * mode.k)
    sparse = R.bm25(seen, texts, 2 * mode.k, clearance)
    fused = R.fuse(dense, sparse, 2 * mode.k, *mode.weights)
    ranks = fused.join(dense.select("question", "id", F.col("rank").alias("dense_rank"), F.col("score").alias("cosine")), ["question", "id"], "left").join(sparse.select("question", "id", F.col("rank").alias("sparse_rank")), ["question", "id"], "left")
    kept = ranks.where(F.col("score") >= mode.floor).where(F.col("rank") <= mode.k)
    return kept.select("question", "id", "score", S.confidence(F.col("cosine"), F.col("dense_rank"), F.col("sparse_rank"), dimension).alias("confidence"), "rank")


def top_confidence(hits: DataFrame) -> DataFrame:
    """(question, confidence): the highest confidence of a question's hits, or score where none is set."""
    return hits.groupBy("question").agg(F.max(F.coalesce("confidence", "score")).alias("confidence"))


def evidence(hits: DataFrame, grounding: str = "verbatim_footnotes", posture: str = "neutral", baseline: int = BASELINE_TOKENS) -> DataFrame:
    """(question, context, citations, tokens, baseline_tokens, saved_percent) from ranked hits (question, rank, title, path, heading, text, score, clearance).

    ``executive_abstract`` takes the first three lines of each text. The context of a question is as long as its hits' texts, so hits are meant to be
    cut to a few by rank.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), S.stripped), lambda x: (x != "") & ~x.startswith("[Doc:"))
    n, title = F.col("rank").cast("string"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Document"))
    if grounding == "executive_abstract":
        body = F.when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, 3), " ")).otherwise(F.coalesce("text", F.lit("")))
        snippet = F.concat(F.lit("[Executive Abstract #"), n, F.lit(": "), title, F.lit("]\n"), body)
    else:
        tail = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit(" ("), "heading", F.lit(")"))).otherwise(F.lit(""))
        snippet = F.concat(F.lit("[Citation "), n, F.lit(": "), title, tail, F.lit("]\n"), F.coalesce("text", F.lit("")))
    cited = F.struct("rank", title.alias("title"), "path", "heading", F.bround("score", 4).alias("score"), F.concat(F.lit("[^"), n, F.lit("]: "), title, F.lit(" ("), F.coalesce("path", F.lit("")), F.lit(")")).alias("footnote"), "clearance")
    ordered = hits.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", snippet.alias("snippet"), cited.alias("citation")))).alias("own"))
    prefix = POSTURE.get(posture, "") + GROUNDING.get(grounding, "")
    context = F.concat(F.lit(prefix), F.array_join(F.transform("own", lambda x: x["snippet"]), RULE))
    packed = ordered.select("question", context.alias("context"), F.transform("own", lambda x: x["citation"]).alias("citations"))
    tokens = F.greatest(F.lit(1), F.floor(F.length("context") / 4)).cast("long")
    counted = packed.withColumn("tokens", tokens).withColumn("baseline_tokens", F.greatest(F.lit(baseline).cast("long"), F.col("tokens") * 10))
    return counted.withColumn("saved_percent", F.bround((1 - F.col("tokens") / F.col("baseline_tokens")) * 100, 1))


def is_portuguese(text: Column, markers: tuple[str, ...] = ("como", "para", "qual", "quais", "uma", "não", "que", "por", "os", "das", "dos")) -> Column:
    """An accented letter of the language, or one of its frequent words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    return F.coalesce(text.rlike("[áàâãéêíóôõúçÁÀÂÃÉÊÍÓÔÕÚÇ]"), F.lit(False)) | F.arrays_overlap(words, F.array(*map(F.lit, markers)))


def tables(text: Column) -> Column:
    """The Markdown tables of a text: runs of lines that begin with a bar, of two rows or more, the second or third a rule or all with three bars."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), S.stripped)
    row = lambda x: x.startswith("|") & (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(state: Column, line: Column) -> Column:
        grown = F.struct(state["done"].alias("done"), F.concat(state["open"], F.array(line)).alias("open"))
        closed = F.struct(F.when(F.size(state["open"]) > 0, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"), F.array().cast("array<string>").alias("open"))
        return F.when(row(line), grown).otherwise(closed)

    runs = F.aggregate(F.concat(lines, F.array(F.lit(""))), start, step, lambda s: s["done"])
    ruled = lambda x: x.rlike(r"^[|\s:-]*-[|\s:-]*$")
    barred = lambda x: x.endswith("|") & (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 3)
    good = lambda t: (F.size(t) >= 2) & (F.exists(F.slice(t, 2, 2), ruled) | F.forall(F.slice(t, 1, 3), barred))
    return F.transform(F.filter(runs, good), lambda t: F.array_join(t, "\n"))


def answers(questions: DataFrame, hits: DataFrame, floor: float = REFUSAL_BELOW) -> DataFrame:
    """(question, refused, answer, confidence) for questions (question, text) and ranked hits (question, rank, text, confidence).

    Below the floor the answer is a refusal. Else it is, of the three best texts, the first two sentences each that share a word with the question,
    each once, with its citation.
    """
    asked = questions.select("question", F.col("text").alias("asked"), F.array_distinct(R.terms(F.col("text"))).alias("words"))
    best = top_confidence(hits.withColumn("score", F.lit(0.0)))
    sentences = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), r"(?<=[.!?]) ")
    taken = hits.where(F.col("rank") <= ANSWER_CHUNKS).join(asked, "question").select("question", "rank", "words", F.posexplode(sentences).alias("place", "sentence"))
    shared = taken.where(F.arrays_overlap(R.terms(F.col("sentence")), F.filter("words", lambda w: F.length(w) > 3)))
    numbered = shared.withColumn("n", F.row_number().over(W.partitionBy("question", "rank").orderBy("place"))).where(F.col("n") <= ANSWER_SENTENCES)
    plain = S.stripped(F.regexp_replace("sentence", r"\[\d+\]", ""))
    once = numbered.withColumn("plain", plain).groupBy("question", "plain").agg(F.min(F.struct("rank", "place")).alias("at"))
    lines = once.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit("- "), "plain", F.lit(" ["), F.col("at.rank").cast("string"), F.lit("]")).alias("line")))).alias("own"))
    joined = asked.join(best, "question", "left").join(lines, "question", "left")
    refused = F.coalesce(F.col("confidence") < floor, F.lit(True))
    answer = F.when(refused, F.lit(None).cast("string")).otherwise(F.array_join(F.transform(F.coalesce("own", F.array()), lambda x: x["line"]), "\n"))
    return joined.select("question", refused.alias("refused"), answer.alias("answer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def word_tokens(text: Column) -> Column:
    """An estimate from words, cut to a whole number."""
    return F.floor(F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), "")) * WORD_TOKENS).cast("long")


def flat(chunks: DataFrame, dense: DataFrame, sparse: DataFrame, k: int = 5) -> DataFrame:
    """(question, id, score, rank, text, tokens) of fused hits on chunks (id, text)."""
    return R.fuse(dense, sparse, k).join(chunks.select("id", "text"), "id").withColumn("tokens", word_tokens(F.col("text")))


def two_level(chapters: tuple[DataFrame, DataFrame], chunks: tuple[DataFrame, DataFrame], parents: DataFrame, k_chapters: int = 3, k_chunks: int = 4) -> tuple[DataFrame, DataFrame]:
    """(chapter hits, chunk hits) from dense and sparse lists of both levels and parents (id, parent): a chunk scores 0.6 of its own fused score and 0.4 of its chapter's, whether or not that is among the best."""
    of = lambda pair, name: R.fuse(*pair, k=1_000_000).select("question", F.col("id").alias(name), "score")
    upper, lower = of(chapters, "parent"), of(chunks, "id")
    best = lambda rows, key, k: rows.withColumn("rank", F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)
    joined = lower.join(parents.select("id", "parent"), "id").join(upper.select("question", "parent", F.col("score").alias("above")), ["question", "parent"], "left")
    mixed = joined.select("question", "id", "parent", F.round(CHUNK_WEIGHT * F.col("score") + CHAPTER_WEIGHT * F.coalesce("above", F.lit(0.0)), 9).alias("score"))
    return best(upper, "parent", k_chapters), best(mixed, "id", k_chunks)


def layered_context(thesis: str | None, chapter_hits: DataFrame, chunk_hits: DataFrame, abstracts: DataFrame, texts: DataFrame) -> DataFrame:
    """(question, context, tokens, chapters): the thesis if there is one, abstracts (parent, title, summary) of the chapters, then texts (id, text) of the chunks."""
    upper = chapter_hits.join(abstracts, "parent").select("question", F.lit(1).alias("layer"), "rank", F.col("parent").cast("string").alias("chapter"), F.concat(F.lit("[Chapter "), F.col("parent").cast("string"), F.lit(": "), "title", F.lit("]\n"), "summary").alias("piece"), word_tokens(F.col("summary")).alias("n"))
    lower = chunk_hits.join(texts, "id").select("question", F.lit(0).alias("layer"), "rank", F.col("parent").cast("string").alias("chapter"), F.concat(F.lit("[Chunk "), F.col("id").cast("string"), F.lit("]\n"), "text").alias("piece"), word_tokens(F.col("text")).alias("n"))
    both = upper.unionByName(lower).groupBy("question").agg(F.array_sort(F.collect_list(F.struct((-F.col("layer")).alias("layer"), "rank", "piece"))).alias("own"), F.sum("n").alias("n"), F.array_sort(F.collect_set("chapter")).alias("chapters"))
    head = f"[Thesis]\n{thesis}\n" if thesis else ""
    extra = int(len(thesis.split()) * WORD_TOKENS) if thesis else 0
    return both.select("question", F.concat(F.lit(head), F.array_join(F.transform("own", lambda x: x["piece"]), "\n")).alias("context"), (F.col("n") + extra).alias("tokens"), "chapters")


def replace_part(table: DataFrame, fresh: DataFrame, part: str) -> DataFrame:
    """The table with the rows of the parts that ``fresh`` holds put in their place; other parts are as they were."""
    return table.join(fresh.select(part).distinct(), part, "left_anti").unionByName(fresh)
