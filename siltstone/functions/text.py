"""Functions on document texts, paths and addresses as columns; built-in expressions only. Null texts count as empty unless stated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalar as S

# Fixed values.
TRIM_MARKERS = ("\nImpact on the System", "\nPossible Causes", "\nProcedure", "1. CLOSED-LOOP")
TRIM_NOTE = "\n... [Parameters condensed] ...\n"
SECTION_HEADINGS = ("Description", "Attribute", "Parameters", "Impact on the System", "Possible Causes", "Procedure", "Related Information")
MAX_TITLE = 240
DUE_DATE = r"(?:data\s+de\s+vencimento|vencimento(?:\s+em)?|vence(?:\s+em)?|pagar\s+at[eé]|venc\.?)\s*:?\s*(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})"
NOTICES = ("intimacao", "intimação", "notificacao judicial")
HIGH_VALUE, OVERDUE_DAYS, DUE_DAYS = 1000.0, 14, 3
PART_SUFFIX = r"::part::\d+$"
SHEET_MARK = "::sheet::"
RICH_FORMATS = (".pdf", ".docx", ".xml", ".hdx", ".epub", ".eml", ".md")
DOMAIN_BONUS = {"fiscal_nfe": 20.0, "medical_clinical": 20.0, "legal_contracts": 19.0, "engineering_manuals": 18.0, "general_knowledge": 8.0}
LEGAL_WORDS = ("contrat", "contract", "nda", "legal", "jurid")


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _trim_right(value: Column) -> Column:
    return F.rtrim(value, F.lit(S.WHITE))


def smart_trim(text: Column, most: int = 1650) -> Column:
    """A long text cut to its head and the part that begins with the first marker found after it; without one, to its first ``most`` characters.

    A marker counts where it first occurs after the head; markers are tried in order.
    """
    body, head = _text(text), min(750, most // 2)
    tail = most - head - 55
    places = [F.locate(marker, body, head + 1) - 1 for marker in TRIM_MARKERS]
    chosen = F.coalesce(*(F.when(at > head, at) for at in places))
    joined = F.concat(_trim_right(F.substring(body, 1, head)), F.lit(TRIM_NOTE), _trim_right(F.substring(body, chosen + 1, F.lit(tail))))
    return F.when(F.length(body) <= most, body).when(chosen.isNotNull(), joined).otherwise(F.substring(body, 1, most))


def clean_markup(text: Column) -> Column:
    """Without scripts, styles and tags; white space as single spaces."""
    body = F.regexp_replace(_text(text), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return S.stripped(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]+>", " "), r"(?U)\s+", " "))


def sections(text: Column, headings: Sequence[str] = SECTION_HEADINGS, most: int = 2500) -> Column:
    """Heading to body, as a map: a heading that stands at a line's start, its body up to the next heading found, cut at ``most``.

    Of a heading that occurs several times, the first after a fifth of the text (at most 380 characters) counts. A text without any
    is its own Description, cut at 2000 characters.
    """
    body = F.regexp_replace(_text(text), r"(?m)^Virtual URI:\s*archive://[^\n]+\n+", "")
    skipped = F.least(F.lit(380), F.floor(F.length(body) / 5).cast("int"))

    def place(heading: str) -> Column:
        line, start = F.locate(f"\n{heading}\n", body), F.lit(0)
        after = lambda mark: F.when(F.position(F.lit(mark), body, skipped + 1) > 0, F.position(F.lit(mark), body, skipped + 1) - 1)
        top = F.when(F.locate(f"{heading}\n", body) > 0, F.locate(f"{heading}\n", body) - 1)
        return F.coalesce(after(f"\n{heading}\n"), after(f"\n{heading}"), top)

    found = F.array_sort(F.filter(F.array(*(F.struct(place(h).alias("at"), F.lit(h).alias("name")) for h in headings)), lambda x: x["at"].isNotNull()))

    def cut(own: Column, x: Column, i: Column) -> Column:
        start = x["at"] + F.length(x["name"]) + 1
        end = F.coalesce(F.get(own, i + 1)["at"], F.length(body))
        return F.struct(x["name"].alias("key"), F.substring(S.stripped(F.substring(body, start + 1, F.greatest(F.lit(0), end - start))), 1, most).alias("value"))

    parts = S.bound(found, lambda own: F.filter(F.transform(own, lambda x, i: cut(own, x, i)), lambda x: x["value"] != ""))
    whole = F.create_map(F.lit("Description"), F.substring(S.stripped(body), 1, 2000))
    return F.when(F.size(parts) > 0, F.map_from_entries(parts)).when(S.stripped(body) != "", whole).otherwise(F.create_map().cast("map<string,string>"))


def table_headers(text: Column) -> Column:
    """The column names of the first table of a text whose rows are lines between bars, or null. A rule of dashes may follow the names."""
    lines = F.filter(F.transform(F.split(_text(text), r"\r\n|\r|\n"), S.stripped), lambda x: x != "")
    row = lambda x: F.coalesce(x.rlike(r"^\|.*\|$"), F.lit(False))
    head = S.bound(lines, lambda own: F.get(F.filter(own, lambda x, i: row(x) & row(F.get(own, i + 1))), F.lit(0)))
    cells = F.split(F.regexp_replace(head, r"^\|+|\|+$", ""), r"\|")
    names = F.array_distinct(F.filter(F.transform(cells, lambda c: S.stripped(F.regexp_replace(c, r"[*`_]", ""))), lambda c: c != ""))
    return F.when(head.isNotNull(), names)


def amounts(text: Column) -> Column:
    """Amounts in reais, as numbers, in the order in which they stand."""
    found = F.regexp_extract_all(_text(text), F.lit(r"(?U)(?:R\$\s*|BRL\s*)(\d{1,3}(?:\.\d{3})*,\d{2}|\d+,\d{2})\b"), F.lit(1))
    return F.transform(found, lambda x: F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).cast("double"))


def max_amount(text: Column) -> Column:
    return F.array_max(amounts(text))


def date_of(raw: Column) -> Column:
    """A date of the forms DD/MM/YYYY or YYYY-MM-DD; null for days that do not exist."""
    return F.when(raw.contains("/"), F.try_to_date(raw, "dd/MM/yyyy")).otherwise(F.try_to_date(raw, "yyyy-MM-dd"))


def due_dates(text: Column) -> Column:
    """The distinct dates that follow words for a due date."""
    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(_text(text), F.lit("(?iU)" + DUE_DATE), F.lit(1)), date_of)))


def actions(title: Column, content: Column, today: Column) -> Column:
    """What a document calls for, as (action_type, severity, message, amount, due_date) rows."""
    both = F.concat_ws("\n", _text(title), _text(content))
    amount, name = max_amount(both), _text(title)
    kind = "array<struct<action_type:string,severity:string,message:string,amount:double,due_date:date>>"

    def made(action: str, severity: str, message: Column, value: Column, due: Column) -> Column:
        return F.struct(F.lit(action).alias("action_type"), F.lit(severity).alias("severity"), message.alias("message"), value.cast("double").alias("amount"), due.cast("date").alias("due_date"))

    def of_date(due: Column) -> Column:
        days, day = F.datediff(due, today), F.date_format(due, "dd/MM/yyyy")
        late = F.concat(F.lit("Overdue payment: "), name, F.lit(" was due on "), day, F.lit(" ("), (-days).cast("string"), F.lit(" days ago)."))
        soon = F.concat(F.lit("Bill due soon: "), name, F.lit(" is due in "), days.cast("string"), F.lit(" days ("), day, F.lit(")."))
        return F.when((days < 0) & (days >= -OVERDUE_DAYS), made("OVERDUE_BILL", "CRITICAL", late, amount, due)).when((days >= 0) & (days <= DUE_DAYS), made("BILL_DUE_SOON", "WARNING", soon, amount, due))

    dated = F.array_compact(F.transform(due_dates(both), of_date))
    high = F.when(amount >= HIGH_VALUE, made("HIGH_VALUE_PAYMENT", "WARNING", F.concat(F.lit("High-value document detected: "), name, F.lit(" (R$ "), F.format_number(amount, 2), F.lit(").")), amount, F.lit(None)))
    low = F.lower(both)
    notice = low.contains(NOTICES[0]) | low.contains(NOTICES[1]) | low.contains(NOTICES[2])
    urgent = F.when(notice, made("CRITICAL_NOTICE", "CRITICAL", F.concat(F.lit("Urgent legal notice detected: "), name, F.lit(".")), F.lit(None), F.lit(None)))
    return F.concat(dated.cast(kind), F.array_compact(F.array(high, urgent)).cast(kind))


def folded(text: Column) -> Column:
    """Lower case without accents and other characters beyond ASCII; white space as single spaces."""
    accents = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
    plain = "aaaaaaeeeeiiiiooooouuuucnyy"
    body = F.translate(F.lower(_text(text)), accents, plain)
    return S.stripped(F.regexp_replace(F.regexp_replace(body, r"[^\x00-\x7F]", ""), r"\s+", " "))


def has_phrase(text: Column, phrase: str) -> Column:
    """Does a folded text hold a phrase between word ends? The phrase is folded as well."""
    import unicodedata

    plain = " ".join(unicodedata.normalize("NFKD", phrase).encode("ascii", "ignore").decode().lower().split())
    quoted = "".join("\\" + c if c in r"\.[]{}()*+-?^$|#" else c for c in plain)
    return text.rlike(rf"(?:^|[\s_\W]){quoted}(?:$|[\s_\W])")


def rule_match(title: Column, content: Column, rules: Mapping[str, Sequence[str]], in_title: float = 0.95, in_content: float = 0.80) -> Column:
    """(name, confidence) of the rule that fits: the first with a phrase in the title, else the first with one in the content, else null. Both texts are folded."""
    any_of = lambda text, phrases: F.greatest(F.lit(False), F.lit(False), *(has_phrase(text, p) for p in phrases))
    named = lambda name, score: F.struct(F.lit(name).alias("name"), F.lit(score).alias("confidence"))
    if not rules:
        return F.lit(None).cast("struct<name:string,confidence:double>")
    tests = [F.when(any_of(title, p), named(n, in_title)) for n, p in rules.items()] + [F.when(any_of(content, p), named(n, in_content)) for n, p in rules.items()]
    return F.coalesce(*tests)


def classified(title: Column, content: Column, types: Mapping[str, Sequence[str]], organisations: Mapping[str, Sequence[str]], tags: Mapping[str, Sequence[str]], most: int = 4000) -> Column:
    """Document type, correspondent, tags and mean confidence of a text by tables of phrases; organisations with longer phrases come first."""
    head, body = folded(title), folded(F.substring(_text(content), 1, most))
    kind = rule_match(head, body, types)
    ordered = dict(sorted(organisations.items(), key=lambda item: -max(map(len, item[1]))))
    sender = rule_match(head, body, ordered, in_content=0.85)
    both = F.concat_ws(" ", head, body)
    found = F.array_sort(F.array_compact(F.array(*(F.when(F.greatest(F.lit(False), *(has_phrase(both, p) for p in phrases)), F.lit(tag)) for tag, phrases in tags.items())))) if tags else F.array().cast("array<string>")
    scores = F.array_compact(F.array(kind["confidence"], sender["confidence"]))
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(F.lit(0.5))
    return F.struct(kind["name"].alias("document_type"), sender["name"].alias("correspondent"), found.alias("tags"), F.round(mean, 4).alias("confidence"))


# Names, paths and addresses.


def document_key(uri: Column, path: Column, identifier: Column, record: Column) -> Column:
    """What the chunks of one document share: the first address that is set, without its scheme and part number."""
    first = F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in (uri, path, identifier)))
    return F.coalesce(F.regexp_replace(F.regexp_replace(first, "^archive://", ""), PART_SUFFIX, ""), F.concat(F.lit("id:"), record.cast("string")))


def chunk_title(title: Column, path: Column, locator: Column, index: Column, total: Column) -> Column:
    """Title, the last two headings, the place and ``[i/n]`` of a chunk."""
    tail = F.slice(path, F.greatest(F.size(path) - 1, F.lit(1)), 2)
    named = F.concat(title, F.when(F.size(path) > 0, F.concat(F.lit(" — "), F.concat_ws(" > ", tail))).otherwise(F.lit("")), F.when(_text(locator) != "", F.concat(F.lit(" ("), locator, F.lit(")"))).otherwise(F.lit("")))
    return F.substring(F.concat(named, F.when(total > 1, F.concat(F.lit(" ["), (index + 1).cast("string"), F.lit("/"), total.cast("string"), F.lit("]"))).otherwise(F.lit(""))), 1, MAX_TITLE)


def best_uri(identifier: Column, uri: Column) -> Column:
    """The more specific of a record's identifier and its file's address."""
    return F.when((F.length(identifier) > F.length(uri)) & F.startswith(identifier, uri), identifier).otherwise(uri)


def split_inner(uri: Column) -> Column:
    """(file, part) inside an archive, from ``archive#file::sheet::part`` or ``archive#file#part``; null without ``#``."""
    inner = F.substr(uri, F.locate("#", uri) + 1)
    sheet, mark = F.locate(SHEET_MARK, inner), F.locate("#", inner)
    parts = (
        F.when(sheet > 0, F.struct(F.substr(inner, F.lit(1), sheet - 1).alias("file"), F.substr(inner, sheet + len(SHEET_MARK)).alias("part")))
        .when(mark > 0, F.struct(F.substr(inner, F.lit(1), mark - 1).alias("file"), F.substr(inner, mark + 1).alias("part")))
        .otherwise(F.struct(inner.alias("file"), F.lit(None).cast("string").alias("part")))
    )
    return F.when(F.locate("#", uri) > 0, parts)


def virtual_uri(archive: Column, entry: Column) -> Column:
    return F.concat(F.lit("archive://"), archive, F.lit("#"), F.ltrim(entry, F.lit("/")))


def unquoted(value: Column, times: int = 4) -> Column:
    """Percent signs decoded, again while any code is left, ``times`` at most; what is no code stays."""
    out = value
    for _ in range(times):
        plus = F.replace(out, F.lit("+"), F.lit("%2B"))  # a plus sign is no space in a path
        out = F.coalesce(F.try_url_decode(plus), out)
    return out


def parse_virtual_uri(uri: Column) -> Column:
    """(archive, outer, inner, entry) of an address; null where a scheme, ``#`` or either part is missing."""
    body = F.regexp_replace(uri, "^(?:archive|virtual)://", "")
    at = F.locate("#", body)
    archive, entry = unquoted(F.substr(body, F.lit(1), at - 1)), unquoted(F.substr(body, at + 1))
    bang = F.locate("!", archive)
    outer = F.when(bang > 0, F.substr(archive, F.lit(1), bang - 1)).otherwise(archive)
    inner = F.when(bang > 0, F.ltrim(F.substr(archive, bang + 1), F.lit("/")))
    made = F.struct(archive.alias("archive"), outer.alias("outer"), inner.alias("inner"), entry.alias("entry"))
    return F.when(uri.rlike("^(?:archive|virtual)://") & (at > 0) & (archive != "") & (entry != ""), made)


def title_matches_topic(title: Column, topic: Column, ignored: Sequence[str] = ()) -> Column:
    """A key of the title's head (capitals and digits, five digits or an alarm) stands in the topic's name, or the topic's words are in the title to 60 %."""
    low = F.lower(_text(topic))
    head = F.get(F.split(_text(title), " — "), F.lit(0))
    keys = F.filter(F.regexp_extract_all(head, F.lit(r"\b([A-Z][A-Z0-9_]{3,})\b"), F.lit(1)), lambda k: ~k.isin(list(ignored)) if ignored else F.lit(True))
    keys = F.concat(keys, F.regexp_extract_all(_text(title), F.lit(r"(\d{5,})"), F.lit(1)), F.regexp_extract_all(_text(title), F.lit(r"(ALM-\d+)"), F.lit(1)))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(_text(c)), F.lit("([a-z0-9]+)"), F.lit(1)))
    shared = F.size(F.array_intersect(words(title), words(topic)))
    return F.exists(keys, lambda k: F.contains(low, F.lower(k))) | ((F.size(words(topic)) > 0) & (shared >= 0.6 * F.size(words(topic))))


def console(path: Column, root: str, rules: Mapping[str, str]) -> Column:
    """The command family of a topic: the first rule that fits its first three levels, if one of the first two is a command root."""
    levels = F.transform(F.split(_text(path), " > "), S.stripped)
    head = F.concat_ws(" > ", F.slice(levels, 1, 3))
    chosen = F.coalesce(*(F.when(head.rlike(rule), F.lit(label)) for label, rule in rules.items()), F.lit(None).cast("string"))
    return F.when(F.exists(F.slice(levels, 1, 2), lambda p: p.rlike(root)), chosen)


# Digests.


def hmac_sha256(key: str, value: Column) -> Column:
    """HMAC-SHA256 in hexadecimal, from two native digests (RFC 2104). Null stays null."""
    import hashlib

    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def pseudonym(identifier: Column, salt: str) -> Column:
    return hmac_sha256(salt, S.stripped(identifier))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID of version 5 (RFC 9562). Null stays null."""
    import uuid

    digest = F.sha1(F.concat(F.lit(uuid.UUID(namespace).bytes), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    cut = lambda a, n: F.substring(digest, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def crc32(value: Column) -> Column:
    return F.crc32(F.encode(_text(value), "UTF-8"))


# Directories.


def directory_class(path: Column, files: Column, formats: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """The domain of a directory from keywords in its path (6 each) and file names (3.5 each time), and from the formats of its files (a map of counts).

    ``keywords`` names domains in the order in which equal scores count.
    """
    low, names = F.lower(path), F.lower(F.concat_ws(" ", files))
    times = lambda word: (F.length(names) - F.length(F.replace(names, F.lit(word), F.lit("")))) / len(word)
    count = lambda name: F.coalesce(F.element_at(formats, F.lit(name)), F.lit(0))
    total = F.greatest(F.lit(1), F.aggregate(F.map_values(formats), F.lit(0).cast("long"), lambda a, x: a + x))
    extra = {
        "fiscal_nfe": F.when(count(".xml") > 0, 4.0 * count(".xml") / total + F.least(F.lit(5.0), count(".xml") * 1.5)).otherwise(F.lit(0.0)),
        "engineering_manuals": F.when(count(".hdx") > 0, F.lit(10.0)).otherwise(F.lit(0.0)),
        "legal_contracts": F.when(((count(".docx") > 0) | (count(".pdf") > 0)) & F.greatest(F.lit(False), *(low.contains(w) | names.contains(w) for w in LEGAL_WORDS)), F.lit(5.0)).otherwise(F.lit(0.0)),
    }
    scores = []
    for place, (domain, words) in enumerate(keywords.items()):
        score = extra.get(domain, F.lit(0.0))
        for word in words:
            score = score + F.when(low.contains(word), F.lit(6.0)).otherwise(F.lit(0.0)) + 3.5 * times(word)
        scores.append(F.struct(F.round(score, 9).alias("score"), F.lit(-place).alias("order"), F.lit(domain).alias("domain")))
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] >= 2.5, best["domain"]).otherwise(F.lit("general_knowledge"))


def directory_priority(files: Column, size: Column, formats: Column, domain: Column) -> Column:
    """From 0 to 100: number of files (45 at most), their size (20), rich formats among them (15) and the domain (20)."""
    many = F.least(F.lit(45.0), 15.0 * F.log10(files + 1) + F.least(F.lit(20.0), files * 2.5))
    volume = F.least(F.lit(20.0), 3.0 * F.log10(F.greatest(F.lit(10), size).cast("double")))
    rich = F.least(F.lit(15.0), 4.0 * F.size(F.filter(F.map_keys(formats), lambda f: f.isin(*RICH_FORMATS))))
    bonus = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in DOMAIN_BONUS.items() for x in pair)), domain), F.lit(8.0))
    return F.when(files <= 0, F.lit(0.0)).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), many + volume + rich + bonus)), 2))


def watched(path: Column, extensions: Sequence[str] = (".md", ".txt", ".pdf", ".docx", ".xml", ".eml", ".csv")) -> Column:
    """May a file event's path be indexed: a known extension, and no part that is hidden, temporary or a tool's folder."""
    kinds = "|".join(e.lstrip(".") for e in extensions)
    return path.rlike(rf"(?i)\.({kinds})$") & ~path.rlike(r"(?i)(^|/)(\.[^/]+|~\$[^/]*|node_modules|__pycache__|[^/]*\.(tmp|swp|part))(/|$)")
