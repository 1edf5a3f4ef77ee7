"""Scalar functions over columns. All are built-in expressions; none runs Python per row. Null texts count as empty unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CONFIDENCE_KNOTS = ((0.60, 0.0), (0.70, 0.35), (0.78, 0.75), (0.86, 0.95))
NO_LEXICAL_CAP = 0.74
KEYWORD_ONLY = 0.30
CALIBRATED_DIMENSION = 768
BOTH_LEGS, ONE_LEG, BOTH_LEGS_RANK = 0.60, 0.40, 10
CHARACTERS_PER_TOKEN = 4
DIGEST = r"[0-9a-fA-F]{32,128}"
CPF = r"(?<!\d)\d{3}\.\d{3}\.\d{3}-\d{2}(?!\d)|(?<!\d)\d{11}(?!\d)"
CNPJ = r"(?<!\d)\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}(?!\d)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PATH = r"""(?:^|[\s"'])(?:/home/[^\s"']+|/Users/[^\s"']+|/var/data/[^\s"']+|[A-Za-z]:\\[^\s"']+)"""

#: White space in the sense of Unicode, as trimmed from both ends of a text.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is named, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for a blank text.

    Characters are sorted and their runs summed in one pass, so the cost is that of the sort, not of
    characters times distinct characters.
    """
    body = stripped(text)
    n = F.length(body).cast("double")
    term = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(F.lit(0.0))
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

    def step(state: Column, char: Column) -> Column:
        same = state["last"] == char
        run = F.when(same, state["run"] + 1.0).otherwise(F.lit(1.0))
        return F.struct(char.alias("last"), run.alias("run"), (state["total"] + F.when(same, F.lit(0.0)).otherwise(term(state["run"]))).alias("total"))

    whole = F.aggregate(F.array_sort(F.split(body, "")), start, step, lambda state: state["total"] + term(state["run"]))
    return F.when(n > 0, F.log2(n) - whole / n).otherwise(F.lit(0.0))


def tokens(text: Column) -> Column:
    """Estimated tokens: 0 for an empty text, else at least 1."""
    rough = F.floor((F.length(stripped(text)) + (CHARACTERS_PER_TOKEN - 1)) / CHARACTERS_PER_TOKEN)
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), rough)).cast("long")


def confidence(dense_score: Column, dense_rank: Column, sparse_rank: Column, dimension: int = CALIBRATED_DIMENSION) -> Column:
    """Confidence of a fused hit from its cosine and from whether the lexical leg found it too; null scores and ranks: not found by that leg."""
    lexical = sparse_rank.isNotNull()
    if dimension == CALIBRATED_DIMENSION:
        found = F.when(dense_score <= CONFIDENCE_KNOTS[0][0], F.lit(CONFIDENCE_KNOTS[0][1]))
        for (x0, y0), (x1, y1) in zip(CONFIDENCE_KNOTS, CONFIDENCE_KNOTS[1:], strict=False):
            found = found.when(dense_score <= x1, y0 + (dense_score - x0) * (y1 - y0) / (x1 - x0))
        found = found.otherwise(F.lit(CONFIDENCE_KNOTS[-1][1]))
    else:
        near = (dense_rank > 0) & (dense_rank <= BOTH_LEGS_RANK) & (sparse_rank <= BOTH_LEGS_RANK)
        found = F.when(F.coalesce(near, F.lit(False)), F.lit(BOTH_LEGS)).otherwise(F.lit(ONE_LEG))
    capped = F.when(lexical, found).otherwise(F.least(found, F.lit(NO_LEXICAL_CAP)))
    missing = F.when(lexical, F.lit(KEYWORD_ONLY)).otherwise(F.lit(0.0))
    return F.bround(F.when(dense_score.isNull(), missing).otherwise(capped), 4)


def _grouped(raw: Column, length: int, pattern: str, form: str, other: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) == length, F.regexp_replace(digits, pattern, form)).otherwise(other)


def format_cpf(raw: Column) -> Column:
    return _grouped(raw, 11, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4", stripped(raw))


def format_cnpj(raw: Column) -> Column:
    return _grouped(raw, 14, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5", stripped(raw))


def format_registration(raw: Column) -> Column:
    """A 13-digit product registration that begins with 1, in groups; else null."""
    grouped = _grouped(raw, 13, r"^(\d)(\d{4})(\d{4})(\d{3})(\d)$", "$1.$2.$3.$4-$5", F.lit(None))
    return F.when(grouped.startswith("1"), grouped)


def overlap(left: Column, right: Column, limit: int | None = None) -> Column:
    """Words that two texts share, over the words of the one with more; 0 if either has none. ``limit`` reads the first characters only."""
    cut = (lambda c: F.substring(c, 1, limit)) if limit else (lambda c: c)
    words = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(cut(F.coalesce(c, F.lit("")))), "[^a-z0-9]+"), ""))
    a, b = words(left), words(right)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.when(F.least(F.size(a), F.size(b)) > 0, F.greatest(F.size(a), F.size(b)))), F.lit(0.0))


def scrub(text: Column) -> Column:
    """Replaces personal numbers, addresses and home paths by marks; hexadecimal digests stay. Null stays null."""
    out = text
    for pattern, name in ((CNPJ, "CNPJ"), (CPF, "CPF"), (EMAIL, "EMAIL"), (PATH, "PATH")):
        out = F.regexp_replace(out, pattern, f"[REDACTED_{name}]")
    return F.when(text.rlike(f"^{DIGEST}\\z"), text).otherwise(out)
