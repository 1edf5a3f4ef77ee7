"""Documentation packages: zipped help books with a profile, a navigation tree, book maps and pages; and workbooks of alarms, events and counters.

Values that a page does not give stay null; none is made up. A damaged part is left out with a warning.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from dataclasses import dataclass, field

from . import grid, office
from .base import MAX_RATIO, Unreadable, local, xml_root

# Fixed values.
CONTAINERS = (".hwics", ".hdx")
MARKUP = (".xml", ".html", ".htm", ".xhtml")
NAVIGATION = ("navi.xml", "resources/navi.xml", "toc.xml")
NODE_TAGS = frozenset("node topic item section nav category".split())
TITLES, ADDRESSES = ("title", "txt", "name", "label"), ("url", "href", "file")
MAX_MEMBER, MAX_TOTAL = 50 * 1024 * 1024, 2 * 1024 * 1024 * 1024
ALARM = re.compile(r"\b(ALM-\d{3,6})\b", re.I)
COMMAND = re.compile(r"\b((?:ADD|MOD|RMV|LST|DSP|SET|ACT|DEA|RST|PING|TRC)\s+[A-Z0-9_]{3,20})\b")
COUNTER = re.compile(r"\b(VS\.[A-Za-z0-9_.]{5,40})\b")
SEVERITY = re.compile(r"\b(Critical|Major|Minor|Warning)\b", re.I)
DIAGNOSTIC = ("DSP ", "LST ", "PING ", "TRC ")
CAUSES, STEPS = r"(?:Possible\s+Causes?|Root\s+Causes?|Causes?)", r"(?:Handling\s+Procedure|Remediation|Procedure|Troubleshooting\s+Steps?)"
HEADER_ROWS = 5


@dataclass
class Topic:
    url: str
    title: str
    path: str
    depth: int
    layer: str
    parent: str | None
    text: str = ""


@dataclass
class Package:
    title: str
    profile: dict[str, str] = field(default_factory=dict)
    images: list[dict[str, str]] = field(default_factory=list)
    topics: list[Topic] = field(default_factory=list)
    alarms: list[dict] = field(default_factory=list)
    commands: list[dict] = field(default_factory=list)
    counters: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def edges(self) -> list[tuple[str, str, str]]:
        out = []
        for a in self.alarms:
            out += [(a["alarm_id"], a["affected"], "AFFECTS_NE")] if a["affected"] else []
            out += [(a["alarm_id"], c, "CAUSED_BY") for c in a["causes"]]
            out += [(a["alarm_id"], c, "DIAGNOSED_BY_MML") for c in a["diagnostic"]]
            out += [(a["alarm_id"], c, "REMEDIATED_BY_MML") for c in a["remediation"]]
            out += [(a["alarm_id"], d, "HAS_DIAGRAM") for d in a["diagrams"]]
        return out


def plain(markup: str) -> str:
    import html

    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", markup)).split())


def tables(page: str) -> list[list[list[str]]]:
    """Each table of a page as rows of cells; empty rows and tables are left out. Tables within tables are read as part of the outer one's text."""
    out = []
    for body in re.findall(r"<table\b[^>]*>(.*?)</table>", page, re.I | re.S):
        rows = [[plain(c) for c in re.findall(r"<t[hd]\b[^>]*>(.*?)</t[hd]>", row, re.I | re.S)] for row in re.findall(r"<tr\b[^>]*>(.*?)</tr>", body, re.I | re.S)]
        rows = [row for row in rows if any(row)]
        out += [rows] if rows else []
    return out


def items_below(page: str, heading: str) -> list[str]:
    """The list items, or else the paragraphs, that follow a heading of the second to fourth level, up to the next."""
    for found in re.finditer(r"<h([2-4])\b[^>]*>(.*?)</h\1>", page, re.I | re.S):
        if re.search(heading, plain(found[2]), re.I):
            block = re.split(r"<h[2-4]\b", page[found.end() :], maxsplit=1, flags=re.I)[0]
            for tag in ("li", "p"):
                items = [t for t in map(plain, re.findall(rf"<{tag}\b[^>]*>(.*?)</{tag}>", block, re.I | re.S)) if t]
                if items:
                    return items
            return []
    return []


def diagrams(page: str, entry: str) -> list[str]:
    """Paths of the pictures of a page that are drawings."""
    out = []
    for tag in re.findall(r"<img\b[^>]*>", page, re.I):
        source = re.search(r"\bsrc=[\"']([^\"']+)[\"']", tag, re.I)
        where = source[1].strip() if source else ""
        drawn = re.search(r"\bclass=[\"'][^\"']*\bvsd\b", tag, re.I) or "figure/" in where.lower() or "images/" in where.lower()
        if where and drawn and not any(part in where for part in ("public_sys-resources/", "caution_", "note_")):
            out.append(posixpath.normpath(posixpath.join(posixpath.dirname(entry), where.replace("\\", "/"))).lstrip("/"))
    return list(dict.fromkeys(out))


def heading(page: str) -> str:
    named = re.search(r"<meta\s+name=[\"']DC\.Title[\"']\s+content=[\"']([^\"']+)[\"']", page, re.I)
    shown = re.search(r"<(h1|title)\b[^>]*>(.*?)</\1>", page, re.I | re.S)
    return plain(named[1]) if named else plain(shown[2]) if shown else ""


def facts(page: str) -> dict[str, str]:
    """Names and values from tables of a header over values, and from rows of a name and a value."""
    out: dict[str, str] = {}
    for rows in tables(page):
        if len(rows) == 2 and len(rows[0]) == len(rows[1]) >= 2:
            out |= {k.lower(): v for k, v in zip(*rows, strict=True) if k and v}
        for row in rows:
            if len(row) >= 2 and row[0] and row[1] and not (row[0].lower() == "name" and row[1].lower() in ("meaning", "description", "value", "type", "parameter meaning")):
                out.setdefault(row[0].lower(), row[1])
    return out


def alarms(page: str, entry: str, trail: str) -> list[dict]:
    """The alarms that a page is about: the one in its heading, path or table, or all of it if it is a page on alarms."""
    title, known = heading(page), facts(page)
    number = known.get("alarm id") or known.get("alarmid") or ""
    named = ALARM.search(title) or ALARM.search(trail)
    if named:
        about = [named[1].upper()]
    elif re.fullmatch(r"\d{3,6}", number):
        about = [f"ALM-{number}"]
    elif "alarm" in title.lower() or "alarm" in trail.lower():
        about = list(dict.fromkeys(m.upper() for m in ALARM.findall(page)))
    else:
        return []
    severity = known.get("alarm severity") or known.get("severity")
    if not severity and (found := SEVERITY.search(plain(page))):
        severity = found[1].capitalize()
    calls = list(dict.fromkeys(" ".join(m.upper().split()) for m in COMMAND.findall(page)))
    causes = items_below(page, CAUSES) or [c.strip() for c in known.get("possible causes", "").split(";") if c.strip()]
    return [
        {
            "alarm_id": key,
            "name": known.get("alarm name") or known.get("name") or re.sub(rf"\b{re.escape(key)}\b[:\-\s]*", "", title, flags=re.I).strip() or None,
            "severity": severity,
            "affected": known.get("affected ne") or known.get("network element"),
            "causes": causes,
            "steps": items_below(page, STEPS),
            "diagnostic": [c for c in calls if c.startswith(DIAGNOSTIC)],
            "remediation": [c for c in calls if not c.startswith(DIAGNOSTIC)],
            "diagrams": diagrams(page, entry),
            "entry": entry,
        }
        for key in about
    ]


def commands(page: str, entry: str, trail: str) -> list[dict]:
    """The command that a page describes, with its parameters (id, name, range, default, description)."""
    found = COMMAND.search(heading(page)) or COMMAND.search(trail)
    if not found:
        return []
    key = " ".join(found[1].upper().split())
    rows = [row for t in tables(page) if len(t) > 1 and any(word in cell.lower() for cell in t[0] for word in ("param", "range")) for row in t[1:] if len(row) >= 3]
    example = re.search(r"<(pre|code)\b[^>]*>(.*?)</\1>", page, re.I | re.S)
    text = re.search(r"<p\b[^>]*>(.*?)</p>", page, re.I | re.S)
    return [{"command": key, "verb": key.split(" ")[0], "object": key.split(" ", 1)[-1], "description": plain(text[1]) if text else None, "example": plain(example[2]) if example else None, "parameters": [(row + [""] * 5)[:5] for row in rows], "entry": entry}]


def counters(page: str, entry: str) -> list[dict]:
    """Performance counters: from tables with the counter in the first column, then those that only the text names."""
    out: dict[str, dict] = {}
    at = lambda row, n: row[n] if len(row) > n and row[n] else None
    for rows in tables(page):
        for row in rows[1:]:
            if row and (found := COUNTER.search(row[0])):
                out.setdefault(found[1], {"counter_id": found[1], "name": at(row, 1), "unit": at(row, 2), "formula": at(row, 3), "description": at(row, 4), "entry": entry})
    for found in COUNTER.finditer(page):
        out.setdefault(found[1], {"counter_id": found[1], "name": None, "unit": None, "formula": None, "description": None, "entry": entry})
    return list(out.values())


def members(data: bytes) -> dict[str, str]:
    """Texts of the markup of a package, or of the first container within it. Names that lead out of it and members beyond the guards are left out."""
    total, out = 0, {}
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        inner = next((i for i in archive.infolist() if i.filename.lower().endswith(CONTAINERS) and i.file_size <= MAX_TOTAL), None)
        if inner is not None:
            return members(archive.read(inner))
        for info in archive.infolist():
            name = posixpath.normpath(info.filename.replace("\\", "/")).lstrip("/")
            total += info.file_size
            if info.is_dir() or name.startswith("..") or not name.lower().endswith(MARKUP) or info.file_size > MAX_MEMBER or info.file_size > MAX_RATIO * max(1, info.compress_size):
                continue
            if total > MAX_TOTAL:
                raise Unreadable("package exceeds the guard for its size")
            out[name] = archive.read(info).decode("utf-8", errors="replace")
    return out


def named(texts: dict[str, str], *names: str) -> str | None:
    """The first member of a name, at the top or in any folder."""
    for wanted in names:
        for name in sorted(texts, key=lambda n: (n.count("/"), n)):
            if name.lower() == wanted.lower() or name.lower().endswith("/" + wanted.lower()):
                return name
    return None


def _first(node: ET.Element, names: tuple[str, ...]) -> str:
    return next((node.get(n).strip() for n in names if (node.get(n) or "").strip()), "")


def navigation(root: ET.Element, title: str, folder: str) -> list[Topic]:
    """Topics in order; layers: L2 for the root, L1 for the first level with topics below it, L0 for leaves, else L1."""
    out = [Topic("", title, title, 0, "L2", None)]
    stack = [(kid, title, 1, "") for kid in reversed(root)]
    while stack:
        node, trail, depth, parent = stack.pop()
        if local(node.tag).lower() not in NODE_TAGS:
            continue
        name = _first(node, TITLES) or "Topic"
        address = _first(node, ADDRESSES)
        url = posixpath.normpath(posixpath.join(folder, address)).lstrip("/") if address else f"#{len(out)}"
        path, below = f"{trail} > {name}", [k for k in node if local(k.tag).lower() in NODE_TAGS]
        out.append(Topic(url, name, path, depth, "L1" if below or depth == 1 else "L0", parent))
        stack += [(kid, path, depth + 1, url) for kid in reversed(below)]
    titles: dict[str, list[str]] = {}
    for topic in out[1:]:
        titles.setdefault(topic.parent or "", []).append(topic.title)
    for topic in out:
        topic.text = f"{topic.title}: {', '.join(titles[topic.url][:12])}" if topic.url in titles else topic.title
    return out


def bookmap(root: ET.Element, title: str) -> list[tuple[str, str, str | None]]:
    """(topic id, path, parent id) of a book map; a topic may stand in several places."""
    out, stack = [], [(kid, title, None) for kid in reversed(root)]
    while stack:
        node, trail, parent = stack.pop()
        if local(node.tag).lower() != "topic":
            continue
        name, key = _first(node, ("name", "txt", "title")), (node.get("id") or "").strip()
        path = f"{trail} > {name}" if name else trail
        if key:
            out.append((key, path, parent))
        stack += [(kid, path, key or parent) for kid in reversed(node)]
    return out


def package(data: bytes, name: str = "package") -> Package:
    try:
        texts = members(data)
    except zipfile.BadZipFile as error:
        raise Unreadable(f"not a package: {error}") from error
    out = Package(name)

    def root_of(member: str | None) -> ET.Element | None:
        if member is None:
            return None
        try:
            return xml_root(texts[member].encode())
        except (ET.ParseError, Unreadable) as error:
            out.warnings.append(f"{member}: {error}")
            return None

    profile = root_of(named(texts, "profile.xml"))
    if profile is not None:
        out.profile = {local(n.tag): n.text.strip() for n in profile if (n.text or "").strip()}
    where = named(texts, "images.xml")
    images = root_of(where)
    if images is not None:
        folder = posixpath.dirname(where)
        for node in images.iter():
            address = (node.get("url") or "").strip().replace("\\", "/")
            if local(node.tag).lower() == "image" and address:
                path = posixpath.normpath(address).lstrip("/")
                out.images.append({"path": path if not folder or path.startswith(folder + "/") else posixpath.join(folder, path), "text": (node.get("msg") or "").strip()})
    member = named(texts, *filter(None, (out.profile.get("navi"), *NAVIGATION)))
    tree = root_of(member)
    out.title = (_first(tree, ("title", "name")) if tree is not None else "") or out.profile.get("libName") or name
    if tree is not None:
        out.topics = navigation(tree, out.title, posixpath.dirname(member))
    trails = {t.url.split("#")[0]: t.path for t in out.topics if t.url}
    for member in sorted(texts):
        if "bookmap_" in member.lower() and (book := root_of(member)) is not None:
            for key, path, _ in bookmap(book, out.title):
                trails.setdefault(key, path)
    for entry in sorted(texts):
        if entry.lower().endswith(".xml"):
            continue
        page = texts[entry]
        if "<!ENTITY" in page.upper():
            out.warnings.append(f"{entry}: entities are refused")
            continue
        trail = trails.get(entry) or trails.get(posixpath.splitext(posixpath.basename(entry))[0], "")
        out.alarms += alarms(page, entry, trail)
        out.commands += commands(page, entry, trail)
        out.counters += counters(page, entry)
    return out


# Workbooks of alarms, events and counters.

_ROLES = {
    "id": r"alarm id|event id|measurement counter id|counter id|^id$",
    "name": r"alarm name|event name|counter name|measurement counter|^name$",
    "severity": r"severity|level",
    "unit": r"unit",
    "object": r"measured object|measurement object|object type|^object$",
    "causes": r"cause",
    "procedure": r"procedure|handling|suggestion",
    "description": r"description|meaning",
}


def workbook_specs(data: bytes) -> list[dict]:
    """Rows of sheets whose header, among the first five rows, names ids: (kind, id, name, severity, unit, object, causes, procedure, description).

    Numbers of three to eight digits get the prefix of their sheet's kind (ALM-, EVT-); other texts are no alarms and are left out. Causes are split at
    semicolons and line ends.
    """
    archive = office.opened(data, "xl/workbook.xml")
    out = []
    document = office.workbook_cells(archive)
    for sheet, cells in document:
        rows: dict[int, dict[int, str]] = {}
        for (r, c), text in cells.items():
            if text.strip():
                rows.setdefault(r, {})[c] = text.strip()
        for r in sorted(rows)[:HEADER_ROWS]:
            roles: dict[str, int] = {}
            for role, pattern in _ROLES.items():
                for c, text in sorted(rows[r].items()):
                    if c not in roles.values() and re.search(pattern, text.lower()):
                        roles.setdefault(role, c)
            if "id" in roles and len(roles) > 1:
                heads = " ".join(rows[r].values()).lower() + " " + sheet.lower()
                kind = "counter" if "counter" in heads else "event" if "event" in heads else "alarm"
                for n in (n for n in sorted(rows) if n > r):
                    value = lambda role: rows[n].get(roles[role]) if role in roles else None  # noqa: B023, E731
                    key = value("id") or ""
                    if kind != "counter":
                        found = re.fullmatch(r"(?:(?:ALM|EVT)-)?(\d{3,8})", key, re.I)
                        if not found:
                            continue
                        key = f"{'EVT' if kind == 'event' else 'ALM'}-{found[1]}"
                    if key:
                        causes = [c.strip() for c in re.split(r"[;\n]", value("causes") or "") if c.strip()]
                        out.append({"kind": kind, "id": key, "name": value("name"), "severity": value("severity"), "unit": value("unit"), "object": value("object"), "causes": causes, "procedure": value("procedure"), "description": value("description"), "sheet": sheet})
                break
    return out
