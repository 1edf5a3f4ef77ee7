"""Entities in texts: identifiers, amounts, dates, addresses, and names from dictionaries; and the relations between them.

Scanning needs places for the context of a mention, which built-in expressions do not give, so it runs in Python over Arrow
batches. Everything after that is joins and aggregates on the mentions.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# Fixed values.
CONTEXT = 40
PRIVATE_IP = r"(?:192\.168\.\d{1,3}\.\d{1,3}|100\.\d{1,3}\.\d{1,3}\.\d{1,3}|127\.0\.0\.1|10\.\d{1,3}\.\d{1,3}\.\d{1,3})"
#: Relations from a document to an entity of each kind, for notes and for business documents.
NOTE_RELATIONS = {"tag": "tagged", "wiki_link": "links_to", "adr": "references", "prj": "references", "service": "references", "ip": "mentions"}
BUSINESS_RELATIONS = {"correspondent": "issued_by", "document_type": "is_type", "tag": "tagged", "cpf": "mentions_cpf", "cnpj": "mentions_cnpj", "monetary": "has_amount", "date": "has_date"}
#: (source kind, target kind, relation) within one document.
NOTE_PAIRS = (("service", "ip", "runs_on"), ("service", "port", "uses_port"))
BUSINESS_PAIRS = (("correspondent", "cnpj", "has_cnpj"), ("cpf", "correspondent", "associated_with"), ("correspondent", "monetary", "billed_amount"))

MENTION = "kind string, norm string, name string, n long, first long, context string"
#: A mention: its kind, normalised name, name, start and end.
Found = tuple[str, str, str, int, int]
Scanner = Callable[[str], Iterator[Found]]

_CPF = re.compile(r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b")
_CNPJ = re.compile(r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b")
_MONEY = re.compile(r"(?:R\$\s*|BRL\s*)(\d{1,3}(?:\.\d{3})*,\d{2}|\d+,\d{2})\b")
_ISO = re.compile(r"\b(?P<y>\d{4})-(?P<m>0[1-9]|1[0-2])-(?P<d>0[1-9]|[12]\d|3[01])\b")
_LOCAL_DATE = re.compile(r"\b(?P<d>0[1-9]|[12]\d|3[01])/(?P<m>0[1-9]|1[0-2])/(?P<y>\d{4})\b")
_RECORD = re.compile(r"\b(ADR|PRJ)-(\d+)\b", re.I)
_IP_PORT = re.compile(rf"\b({PRIVATE_IP}):(\d{{2,5}})\b")
_IP = re.compile(rf"\b{PRIVATE_IP}\b")
_PORT = re.compile(r"(?:(?<=\s)|(?<![\s\S])|(?<=[(\[,])):(?P<a>[1-9]\d{1,4})\b|(?:\bport\s+|\bporta\s+)(?P<b>[1-9]\d{1,4})\b")
_NOTE_LINK = re.compile(r"\[([^\]]+)\]\(([^)]+\.md)\)")
_CLOCK_BEFORE, _CLOCK_AFTER = re.compile(r"\d{1,2}:$"), re.compile(r":\d{2}")


def numbers(text: str) -> Iterator[Found]:
    """Taxpayer numbers of persons and companies; those of one digit only are placeholders."""
    for kind, pattern in (("cpf", _CPF), ("cnpj", _CNPJ)):
        for hit in pattern.finditer(text):
            if len({c for c in hit[0] if c.isdigit()}) > 1:
                yield kind, hit[0], hit[0], *hit.span()


def money(text: str) -> Iterator[Found]:
    for hit in _MONEY.finditer(text):
        name = f"R$ {hit[1]}"
        yield "monetary", name, name, *hit.span()


def dates(text: str) -> Iterator[Found]:
    """Days that exist, named YYYY-MM-DD."""
    for pattern in (_ISO, _LOCAL_DATE):
        for hit in pattern.finditer(text):
            try:
                day = datetime.date(int(hit["y"]), int(hit["m"]), int(hit["d"]))
            except ValueError:
                continue
            yield "date", day.isoformat(), hit[0], *hit.span()


def decision_records(text: str) -> Iterator[Found]:
    for hit in _RECORD.finditer(text):
        yield hit[1].lower(), f"{hit[1].upper()}-{int(hit[2]):02d}", hit[0].upper(), *hit.span()


def addresses(text: str) -> Iterator[Found]:
    """Private IP addresses and ports; a pair of both is also one of kind ``ip port``. What is part of a clock time is no port."""
    for hit in _IP_PORT.finditer(text):
        if 1 <= int(hit[2]) <= 65535:
            yield "ip", hit[1], hit[1], *hit.span()
            yield "port", hit[2], hit[2], *hit.span()
            yield "ip port", f"{hit[1]} {hit[2]}", hit[0], *hit.span()
    for hit in _IP.finditer(text):
        if all(int(part) <= 255 for part in hit[0].split(".")):
            yield "ip", hit[0], hit[0], *hit.span()
    for hit in _PORT.finditer(text):
        port, (start, end) = hit["a"] or hit["b"], hit.span()
        clock = _CLOCK_BEFORE.search(text[max(0, start - 3) : start]) or _CLOCK_AFTER.match(text[end : end + 3])
        if int(port) <= 65535 and not clock:
            yield "port", port, port, start, end


def note_links(text: str) -> Iterator[Found]:
    """Links to other notes, by file name; each target once."""
    seen = set()
    for hit in _NOTE_LINK.finditer(text):
        name = hit[2].strip().rsplit("/", 1)[-1]
        if name not in seen:
            seen.add(name)
            yield "wiki_link", name.lower(), name, *hit.span()


def named(kind: str, names: Mapping[str, Sequence[str]], most: int | None = None, fold: bool = False) -> Scanner:
    """A scanner for the first place of any alias of each name, longer aliases first; ``most`` limits the characters read, ``fold`` names by the dictionary."""
    patterns = {name: re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(aliases, key=len, reverse=True))) + r")\b", re.I) for name, aliases in names.items() if aliases}
    ordered = {name: [re.compile(rf"\b{re.escape(a)}\b", re.I) for a in sorted(names[name], key=len, reverse=True)] for name in patterns}

    def scan(text: str) -> Iterator[Found]:
        body = text if most is None else text[:most]
        for name, any_alias in patterns.items():
            if any_alias.search(body):  # one pass decides for most texts; the longest alias then is looked for on its own
                hit = next(h for p in ordered[name] if (h := p.search(body)))
                yield kind, name.lower() if fold else name, name if fold else hit[0], *hit.span()

    return scan


SCANNERS: tuple[Scanner, ...] = (numbers, money, dates, decision_records, addresses, note_links)


def found_in(text: str, scanners: Sequence[Scanner]) -> list[tuple[str, str, str, int, int, str]]:
    """MENTION rows of a text: one per kind and normalised name, with the name and context of its first mention by scanner order."""
    rows: dict[tuple[str, str], list] = {}
    for scan in scanners:
        for kind, norm, name, start, end in scan(text):
            if (kind, norm) in rows:
                rows[kind, norm][3] += 1
            else:
                context = text[max(0, start - CONTEXT) : end + CONTEXT].replace("\n", " ").strip()
                rows[kind, norm] = [kind, norm, name, 1, start, context]
    return [tuple(row) for row in rows.values()]


def mentions(docs: DataFrame, scanners: Sequence[Scanner] = SCANNERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *MENTION). Null texts have none."""
    scanners = tuple(scanners)
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = [field.split(" ")[0] for field in MENTION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                owner, rows = [], []
                for n, text in enumerate(part.column(1)):
                    own = found_in(text.as_py() or "", scanners)
                    owner += [n] * len(own)
                    rows += own
                columns = list(zip(*rows, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, *names])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} {kind}, {MENTION}")


RELATION_COLUMNS = ("doc_id", "source", "target", "relation", "source_kind", "target_kind")


def relations(found: DataFrame, to_document: Mapping[str, str], pairs: Sequence[tuple[str, str, str]], id_col: str = "doc_id") -> DataFrame:
    """RELATION_COLUMNS from mentions: each document to its entities by kind, pairs of entities of one document by kinds, and addresses to their ports.

    Mentions are made once and dealt once, as a row for each document; an entity there meets the document's others in one array.
    """
    named_as = F.element_at(F.create_map(*(F.lit(x) for pair in to_document.items() for x in pair)), F.col("x.kind"))
    of = lambda source, target, relation, *kinds: F.struct(source.alias("source"), target.alias("target"), relation.alias("relation"), *(k.alias(n) for k, n in zip(kinds, ("source_kind", "target_kind"), strict=True)))
    document = of(F.concat(F.lit("document:"), F.col("doc_id").cast("string")), F.col("x.norm"), named_as, F.lit("document"), F.col("x.kind"))
    port = of(F.split("x.norm", " ")[0], F.split("x.norm", " ")[1], F.lit("has_port"), F.lit("ip"), F.lit("port"))
    some = lambda test, rows: F.when(test, rows).otherwise(F.array())
    parts = [some(F.col("x.kind").isin(*to_document), F.array(document)), some(F.col("x.kind") == "ip port", F.array(port))]
    is_of = lambda kind: lambda y: y["kind"] == kind
    related = lambda a, b, relation: lambda y: of(F.col("x.norm"), y["norm"], F.lit(relation), F.lit(a), F.lit(b))
    for a, b, relation in pairs:
        parts.append(some((F.col("x.kind") == a) & F.col("doc_id").isNotNull(), F.transform(F.filter("all", is_of(b)), related(a, b, relation))))
    whole = found.select(F.col(id_col).alias("doc_id"), "kind", "norm").groupBy("doc_id").agg(F.collect_set(F.struct("kind", "norm")).alias("all"))
    return whole.select("doc_id", "all", F.explode("all").alias("x")).select("doc_id", F.inline(F.concat(*parts))).select(*RELATION_COLUMNS).distinct()


def entities_in_text(texts: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """(id, text) to (id, name, matched, start, stop): names and aliases of a dictionary as whole words, longer phrases first; spans that touch a longer one's are left out.

    The dictionary is sent with the task, so it is meant to be small; MAX_PHRASES phrases at the most.
    """
    phrases = sorted(((alias.lower(), name) for name, aliases in names.items() for alias in {name, *aliases} if alias.strip()), key=lambda p: (-len(p[0]), p))
    if len(phrases) > MAX_PHRASES:
        raise ValueError(f"more than {MAX_PHRASES} phrases")
    patterns = [(name, re.compile(rf"\b{re.escape(phrase)}\b")) for phrase, name in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for n, text in enumerate(batch.column(1)):
                body, taken = (text.as_py() or "").lower(), []
                for name, pattern in patterns:
                    for hit in pattern.finditer(body):
                        a, b = hit.span()
                        if not any(x < b and a < y for x, y in taken):
                            taken.append((a, b))
                            owner.append(n)
                            rows.append((name, hit[0], a, b))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "name", "matched", "start", "stop"])

    ship(texts.sparkSession)
    return texts.select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, name string, matched string, start long, stop long")


MAX_PHRASES = 20_000
