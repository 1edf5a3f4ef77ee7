"""Notes with front matter and links: the notes that a caller may see and the edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intent
from ..functions import text as T

# Fixed values.
LINK = r"(?<!!)\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"
GOVERNING = ("adr", "decision", "policy")
MAX_PARTS = 40


def front(text: Column, key: str) -> Column:
    """A plain value of a note's front matter, or null."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    return F.nullif(F.regexp_extract(head, rf"(?m)^{key}:\s*[\"']?(.*?)[\"']?\s*$", 1), F.lit(""))


def parsed(notes: DataFrame) -> DataFrame:
    """(path, text) to (path, title, kind, theme, clearance, hrefs). A clearance that is missing is public; one that is unknown fails closed. Links within code do not count."""
    text = F.col("text")
    body = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", " "), r"`[^`\n]*`", " ")
    given = F.coalesce(front(text, "clearance_level"), front(text, "clearance"))
    heading = F.nullif(F.regexp_extract(body, r"(?m)^#\s+(.*?)\s*$", 1), F.lit(""))
    return notes.select(
        "path",
        F.coalesce(front(text, "title"), heading, F.col("path")).alias("title"),
        F.lower(F.coalesce(front(text, "type"), F.lit("note"))).alias("kind"),
        F.coalesce(front(text, "domain"), front(text, "category"), F.lit("")).alias("theme"),
        F.when(given.isNull(), F.lit(0)).otherwise(intent.clearance_level(given)).alias("clearance"),
        F.regexp_extract_all(body, F.lit(LINK), F.lit(1)).alias("hrefs"),
    )


def normal_path(path: Column) -> Column:
    """Without ``.``, ``..`` and empty parts; ``..`` above the top stays."""
    start = F.array().cast("array<string>")
    up = lambda done: (F.size(done) > 0) & (F.element_at(done, -1) != "..")

    def step(done: Column, part: Column) -> Column:
        back = F.when(up(done), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def resolved(source: Column, href: Column, marker: str = "/docs/wiki/") -> Column:
    """The note that a link in a note names, relative to the notes' folder; null for addresses of other kinds."""
    outside = href.rlike(r"^(?:https?:|mailto:|#)")
    inner = F.when(href.startswith("file://"), F.when(href.contains(marker), F.substring_index(href, marker, -1))).otherwise(F.concat(F.regexp_replace(source, r"[^/]*$", ""), href))
    path = normal_path(T.unquoted(F.split(F.split(inner, "#")[0], r"\?")[0], 1))
    return F.when(~outside & path.endswith(".md"), path)


def edges(found: DataFrame, clearance: int = 3, marker: str = "/docs/wiki/") -> DataFrame:
    """(source, target, kind) between notes that a caller may see: GOVERNED_BY from a note to a decision, else LINKS_TO; each pair once, dead links left out."""
    seen = found.where(F.col("clearance") <= clearance)
    links = seen.select(F.col("path").alias("source"), F.col("kind").alias("own"), F.explode(F.array_distinct("hrefs")).alias("href")).withColumn("target", resolved(F.col("source"), F.col("href"), marker)).where("target is not null and target <> source")
    known = seen.select(F.col("path").alias("target"), F.col("kind").alias("other"))
    kind = F.when(F.col("other").isin(*GOVERNING) & ~F.col("own").isin(*GOVERNING), "GOVERNED_BY").otherwise("LINKS_TO")
    return links.join(known, "target").select("source", "target", kind.alias("kind")).distinct()


def ego(layers: dict[str, DataFrame], centre: DataFrame, depth: int = 2, limit: int = 50) -> DataFrame:
    """(centre, layer, node, level, rank): nodes around centres (centre, layer, node) within their layer's edges (source, target), nearest first, ``limit`` for each centre; ties by name."""
    from pyspark.sql import Window as W

    from . import graph as G

    out = None
    for name, links in layers.items():
        both = links.select(F.col("source").alias("node"), F.col("target").alias("next")).unionByName(links.select(F.col("target").alias("node"), F.col("source").alias("next"))).distinct()
        level = centre.where(F.col("layer") == name).select("centre", "node", F.lit(0).alias("level"))
        seen = level
        for n in range(1, depth + 1):
            fresh = level.join(both, "node").select("centre", F.col("next").alias("node")).distinct().join(seen.select("centre", "node"), ["centre", "node"], "left_anti")
            level = G.cut(fresh.withColumn("level", F.lit(n)))
            seen = seen.unionByName(level)
        own = seen.withColumn("layer", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("centre").orderBy("level", "layer", "node"))).where(F.col("rank") <= limit).select("centre", "layer", "node", "level", "rank")
