"""Files as sections, messages, invoices and table rows: format handlers run over binary files in Arrow batches.

Each function takes (path, content) as ``files.scan`` and ``files.members`` give them. A file that can't be read is a row with
``error`` set, never a failure of the job. Null content counts as an empty file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import formats
from .formats import mail, packages, records
from .formats.base import DAMAGE, Unreadable

SECTIONS = "path string, format string, title string, section int, headings array<string>, text string, locator string, kind string, error string"
MESSAGES = "path string, message int, message_id string, in_reply_to string, refs array<string>, sender string, recipients array<string>, subject string, date string, body string, attachments array<string>, identifiers array<string>, error string"
ITEMS = "path string, invoice_key string, number string, series string, issued string, emitter string, emitter_tax_id string, recipient string, recipient_tax_id string, total double, item int, code string, product string, quantity double, amount double, batches array<string>, registration string, error string"
ROWS = "path string, row int, primary_id string, secondary_ids array<string>, text string, error string"
TOPICS = "path string, url string, title string, trail string, depth int, layer string, parent string, text string, error string"
SPECS = "path string, kind string, id string, name string, severity string, affected string, causes array<string>, steps array<string>, commands array<string>, entry string, error string"
EDGES = "path string, source string, target string, relation string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}


def _fields(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])


def _over(files: DataFrame, schema: str, read: Callable[[str, bytes], Iterator[tuple]], flush: int = 256) -> DataFrame:
    """Rows of ``read`` for each file; what is wrong with a file becomes a row with its path and error, where the schema has one."""
    fields = _fields(schema)
    has_error = fields.names[-1] == "error"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows += read(path or "", body.as_py() or b"")
                except (Unreadable, *DAMAGE) as error:
                    if has_error:
                        rows.append((path, *[None] * (len(fields) - 2), str(error)))
                if len(rows) >= flush:
                    yield made()
                    rows.clear()
        yield made()

    ship(files.sparkSession)
    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)


def sections(files: DataFrame) -> DataFrame:
    """Every section of every file, in order; columns SECTIONS. Warnings of a file are rows of kind ``warning``."""

    def read(path: str, body: bytes) -> Iterator[tuple]:
        kind, found = formats.parse(path.rsplit("!", 1)[-1], body)
        for n, s in enumerate(found.sections):
            yield path, kind, found.title, n, list(s.path), s.text, s.locator, s.kind, None
        for n, text in enumerate(found.warnings, len(found.sections)):
            yield path, kind, found.title, n, [], text, "", "warning", None

    return _over(files, SECTIONS, read)


def messages(files: DataFrame) -> DataFrame:
    """The messages of mailboxes (``.mbox``) and single mails; columns MESSAGES."""

    def read(path: str, body: bytes) -> Iterator[tuple]:
        for n, m in enumerate(mail.mailbox(body) if path.lower().endswith(".mbox") else [mail.message(body)], 1):
            yield path, n, m.message_id, m.in_reply_to, m.references, m.sender, m.recipients, m.subject, m.date, m.body, m.attachments, m.identifiers, None

    return _over(files, MESSAGES, read)


def invoice_items(files: DataFrame) -> DataFrame:
    """One row per item of each electronic invoice; columns ITEMS."""

    def read(path: str, body: bytes) -> Iterator[tuple]:
        v = records.invoice(body)
        for i in v.items:
            yield path, v.key, v.number, v.series, v.issued, v.emitter["name"], v.emitter["tax_id"], v.recipient["name"], v.recipient["tax_id"], v.totals["vNF"], i["item"], i["code"], i["product"], i["quantity"], i["amount"], [b["batch"] for b in i["batches"]], i["registration"] or None, None

    return _over(files, ITEMS, read)


def table_rows(files: DataFrame) -> DataFrame:
    """The rows of delimited tables with their identifiers; columns ROWS."""

    def read(path: str, body: bytes) -> Iterator[tuple]:
        for r in records.table_rows(path.rsplit("/", 1)[-1], body):
            yield path, r.index, r.primary, r.secondary, r.text, None

    return _over(files, ROWS, read)


def edges(files: DataFrame) -> DataFrame:
    """The graph edges of mails, mailboxes, invoices and delimited tables, chosen by the file's ending; other files give none."""

    def read(path: str, body: bytes) -> Iterator[tuple]:
        low = path.lower()
        if low.endswith(".mbox"):
            made = [e for m in mail.mailbox(body) for e in m.edges()]
        elif low.endswith(".eml"):
            made = mail.message(body).edges()
        elif low.endswith(".xml"):
            made = records.invoice(body).edges()
        elif low.endswith((".hdx", ".hwics")):
            made = packages.package(body).edges()
        else:
            made = [e for r in records.table_rows(path, body) for e in r.edges()] if low.endswith((".csv", ".tsv")) else []
        for source, target, relation in made:
            yield path, source, target, relation

    return _over(files, EDGES, read)


def package_topics(files: DataFrame) -> DataFrame:
    """The navigation topics of documentation packages; columns TOPICS."""

    def read(path: str, body: bytes) -> Iterator[tuple]:
        for t in packages.package(body, path.rsplit("/", 1)[-1]).topics:
            yield path, t.url, t.title, t.path, t.depth, t.layer, t.parent, t.text, None

    return _over(files, TOPICS, read)


def package_specs(files: DataFrame) -> DataFrame:
    """Alarms, commands and counters of documentation packages, and of workbooks (``.xlsx``) that list them; columns SPECS."""

    def read(path: str, body: bytes) -> Iterator[tuple]:
        if path.lower().endswith(".xlsx"):
            for w in packages.workbook_specs(body):
                yield path, w["kind"], w["id"], w["name"], w["severity"], w["object"], w["causes"], [w["procedure"]] if w["procedure"] else [], [], w["sheet"], None
            return
        found = packages.package(body, path.rsplit("/", 1)[-1])
        for a in found.alarms:
            yield path, "alarm", a["alarm_id"], a["name"], a["severity"], a["affected"], a["causes"], a["steps"], [*a["diagnostic"], *a["remediation"]], a["entry"], None
        for c in found.commands:
            yield path, "command", c["command"], c["description"], None, c["object"], [], [p[0] for p in c["parameters"]], [], c["entry"], None
        for c in found.counters:
            yield path, "counter", c["counter_id"], c["name"], c["unit"], c["formula"], [], [], [], c["entry"], None

    return _over(files, SPECS, read)


def format_of(path) -> "F.Column":
    """The handler's name for a path, as a column; null where none fits."""
    ending = F.regexp_extract(F.lower(path), r"(\.[a-z0-9]+)$", 1)
    chosen = F.lit(None).cast("string")
    for h in reversed(formats.handlers()):
        chosen = F.when(ending.isin(list(h.extensions)), F.lit(h.name)).otherwise(chosen)
    return chosen
