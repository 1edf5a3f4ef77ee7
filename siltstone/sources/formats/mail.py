"""E-mail messages and mailboxes, and the graph edges of a thread."""

from __future__ import annotations

import email
import email.policy
import email.utils
import html
import re
from dataclasses import dataclass, field
from email.message import EmailMessage

from .base import Document, Section, handler, title_of

# Fixed values.
NO_SUBJECT = "(No Subject)"
QUOTED = re.compile(r">|-----Original Message-----|On\s+.*wrote:$")
IDENTIFIERS = (
    re.compile(r"\b((?:INC|TCK)-\d{2,8}(?:-[A-Z0-9]{1,8})?)\b", re.I),
    re.compile(r"\b(ALM-\d{3,6})\b", re.I),
    re.compile(r"\b((?:ADD|MOD|RMV|LST|DSP|SET|ACT|DEA|RST|PING|TRC)\s+[A-Z0-9_]{3,20})\b"),
    re.compile(r"\b(LOTE[-:\s]+[A-Z0-9][A-Z0-9\-]{3,20})\b", re.I),
)
_ENVELOPE = re.compile(rb"(?:\r?\n|^)From [^\r\n]+\r?\n")


@dataclass
class Message:
    message_id: str
    in_reply_to: str | None
    references: list[str]
    sender: str
    recipients: list[str]
    subject: str
    date: str
    body: str
    attachments: list[str]
    identifiers: list[str] = field(default_factory=list)

    def edges(self) -> list[tuple[str, str, str]]:
        """(source, target, relation)."""
        out = [(self.message_id, self.in_reply_to, "REPLIES_TO")] if self.in_reply_to else []
        out += [(self.sender, to, "EMAILED") for to in self.recipients]
        out += [(self.message_id, i, "MENTIONS_ENTITY") for i in self.identifiers]
        tickets = [i for i in self.identifiers if i.startswith(("INC-", "TCK-"))]
        return out + [(t, i, "CORRELATED_WITH") for t in tickets for i in self.identifiers if i not in tickets]


def _bare(value: object) -> str:
    return str(value or "").strip().strip("<>").strip()


def _payload(node: EmailMessage) -> str:
    raw = node.get_payload(decode=True)
    if raw is None:
        return str(node.get_payload() or "") if not node.is_multipart() else ""
    try:
        return raw.decode(node.get_content_charset() or "utf-8", errors="replace")
    except LookupError:
        return raw.decode("utf-8", errors="replace")


def _plain(markup: str) -> str:
    body = re.sub(r"<(script|style)[^>]*>.*?</\1>", " ", markup, flags=re.I | re.S)
    return html.unescape(" ".join(re.sub(r"<[^>]+>", " ", body).split())).strip()


def _parts(message: EmailMessage) -> tuple[list[str], list[str], list[str]]:
    """(plain texts, HTML texts, attachment names)."""
    texts, pages, names = [], [], []
    for node in message.walk():
        if node.is_multipart():
            continue
        name, place = node.get_filename(), str(node.get("Content-Disposition", "")).lower()
        if name or "attachment" in place:
            names.append(name or "unnamed_attachment")
        elif node.get_content_type() == "text/html":
            pages.append(_payload(node))
        elif node.get_content_type() == "text/plain":
            texts.append(_payload(node))
    return texts, pages, names


def identifiers(text: str) -> list[str]:
    """Tickets, alarms, commands and batches in a text, each once, in upper case."""
    return list(dict.fromkeys(" ".join(found[1].upper().split()) for pattern in IDENTIFIERS for found in pattern.finditer(text)))


def message(data: bytes, number: int = 1) -> Message:
    mail = email.message_from_bytes(data, policy=email.policy.default)
    texts, pages, names = _parts(mail)
    body = "\n".join(t.strip() for t in (texts if any(t.strip() for t in texts) else map(_plain, pages)) if t.strip())
    subject = str(mail.get("Subject", NO_SUBJECT)).strip()
    sender = str(mail.get("From", ""))
    people = email.utils.getaddresses([str(mail.get("To", "")), str(mail.get("Cc", ""))])
    return Message(
        _bare(mail.get("Message-ID")) or f"msg-{number}@mailbox.local",
        _bare(mail.get("In-Reply-To")) or None,
        [bare for word in re.findall(r"<[^>]+>|[^\s]+", str(mail.get("References", ""))) if (bare := _bare(word))],
        email.utils.parseaddr(sender)[1] or sender.strip(),
        [address for _, address in people if address],
        subject,
        str(mail.get("Date", "")).strip(),
        body,
        names,
        identifiers(f"{subject}\n{body}"),
    )


def mailbox(data: bytes) -> list[Message]:
    """The messages of a mailbox file, split at its envelope lines."""
    pieces = [piece.strip() for piece in _ENVELOPE.split(data)]
    return [message(piece, n) for n, piece in enumerate((p for p in pieces if p), 1)]


@handler("eml", ".eml .msg")
def letter(name: str, data: bytes) -> Document:
    """Headers, the body without quoted lines, and the names of attachments. If only quotes are left, the whole body stays."""
    mail = email.message_from_bytes(data, policy=email.policy.default)
    texts, pages, names = _parts(mail)
    header = lambda key, default="": str(mail.get(key, default)).strip()
    subject = header("Subject", NO_SUBJECT)
    heads = [f"Subject: {subject}", f"From: {header('From', 'Unknown Sender')}", f"To: {header('To')}", f"Date: {header('Date')}"]
    heads += [f"{key}: <{bare}>" for key in ("Message-ID", "In-Reply-To") if (bare := _bare(mail.get(key)))]
    heads += [f"References: {header('References')}"] if header("References") else []
    body = next((t for t in [*texts, *map(_plain, pages)] if t.strip()), "")
    own = "\n".join(line for line in body.splitlines() if not QUOTED.match(line.strip())).strip()
    out = Document(subject if subject and subject != NO_SUBJECT else title_of(name))
    out.sections = [Section(("Headers",), "\n".join(heads), "email:headers"), Section(("Message Body",), own or body.strip() or "(Empty Message Body)", "email:body")]
    if names:
        out.sections.append(Section(("Attachments",), "Attachments:\n" + "\n".join(f"- {n}" for n in names), "email:attachments"))
    return out


@handler("mbox", ".mbox")
def letters(name: str, data: bytes) -> Document:
    """One section per message."""
    found = mailbox(data)
    return Document(title_of(name), [Section((m.subject or NO_SUBJECT,), f"From: {m.sender}\nTo: {', '.join(m.recipients)}\nDate: {m.date}\n\n{m.body}", f"message {n}") for n, m in enumerate(found, 1)])
