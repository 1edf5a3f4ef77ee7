"""Personal data: exact patterns, and a linear-chain conditional random field for what patterns can't tell.

The patterns find e-mail and IP addresses, payment cards and telephone numbers in whole texts. Each is
scanned in time linear in the text, without the backtracking that a long run of digits or letters causes.

The field labels tokens as part of a person's NAME or as a SECRET (a key, token or password). Its features
are word shapes, lengths and cue words of a token and its neighbours. Weights are trained on the driver by
gradient ascent on a small labelled table (``LABELLED``, with the names and codes drawn from ``NAMES`` and a
seed). Shapes decide which labels a token may have at all; tokens that may only be O split a text into
short segments, and those are decoded by Viterbi, many at a time, in numpy. The split is exact: the label
on either side of a segment is known.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

BASE = ("email", "ip", "card", "phone")
EXTRA = ("name", "secret")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_GROUPS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NO_DIGIT = re.compile("[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        local = text[floor:at]
        start = floor + len(local.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """In a run of numbers with dots, every four numbers are one match."""
    out = []
    for run in _GROUPS.finditer(text):
        if run.group().count(".") >= 3:
            parts = list(_PART.finditer(text, run.start(), run.end()))
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                if all(len(p.group().lstrip("0")) <= 3 and int(p.group().lstrip("0") or 0) <= 255 for p in four):
                    out.append((four[0].start(), four[3].end()))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NO_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    digits = _DIGIT.search(text) is not None
    return [emails(text) if "@" in text else [], ips(text) if digits else [], cards(text) if digits else [], phones(text) if digits and "+" in text else []]


# The conditional random field.

LABELS = ("O", "B-name", "I-name", "secret")
O, B_NAME, I_NAME, SECRET = range(4)
NONE, LOWER, CAPITAL, UPPER, DIGITS, MIXED, CODE, INITIAL, OTHER = range(9)
CUES = {
    1: "mr mrs ms dr prof herr frau monsieur madame mme señor señora",
    2: "name contact signed attn patient customer nom nombre",
    3: "token password passwd secret apikey api_key api-key key bearer",
    4: "= : := ->",
}
SIZES = {"shape": 9, "cue": 5, "length": 6, "cue-1": 5, "cue-2": 5, "shape-1": 9, "shape+1": 9, "stop-1": 2, "same": 2}
_NAME_SHAPES, _FORBIDDEN = (CAPITAL, INITIAL), -1e4
#: Labels that a shape may have.
ALLOWED = np.array([[True, s in _NAME_SHAPES, s in _NAME_SHAPES, s == CODE] for s in range(9)])
NAMES = "Anna Ben Carla David Elena Felix Greta Hugo Ines Jonas Karin Lucas Marta Nils Olga Paul Rosa Simon Tara Victor Berger Castillo Dubois Ekman Fischer Garcia Hansen Ibsen Jensen Keller Lambert Moreau Novak Ortega Peters Quinn Richter Santos Thomsen Weber"
#: The labelled table: N stands for a name of one to three words, S for a secret, U for a code that is none, W for a plain and C for a capitalised word, R for one that is the same all along the line.
LABELLED = (
    "Name: N W W", "Contact: N , W W W", "W W Mr. N W W", "W Dr. N W", "W Mrs. N , W", "Signed, N", "W W W Herr N W", "Frau N W W", "Madame N W W W", "W W señora N W", "patient N W W", "Customer: N C W",
    'token = "S" W W', "W password: S W", "W W secret = S", "api_key = 'S' W", "C W key: S", "bearer S W W", "W W token S W", 'W token = "S"',
    "C W W W. C W W", "C. C. C W W", "C W W, W W C W.", "C C C W", "W W. C W. C C W", "W C | W | C W", "C, W W W", "W W U W W", "C U W W", "W W W", "W U, W W", "Mr. W W W", "W key W W", "W = W W", "C W = U", "name W W W", "W contact W C W", "C | C | W", "W token W W", "W W C. C", "C W W W. U W",
    "C C C C C C C C C C C C", "C. C. C. C. C. C. C. C.", "W C. C, C C. C C. C C W", "C W. C C. C C C W", "W C C C C W", "R R R R R R R R R R", "W R R R R R R W", "R. R. R. R. R. R.", "W C C. C C W", "W. C C W",
)


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_SPACE, _OPENING, _CLOSING = _mask(" \t\n\x0b\x0c\r"), _mask("\"'([<{"), _mask("\"',.;:!?)]>}#$%&*")
_STOP = _mask(".!?;:|,")
_UP, _DIG = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789")
_LOW = _mask("abcdefghijklmnopqrstuvwxyz")
_LOW[128:] = True
_CODE = _UP | _DIG | _mask("abcdefghijklmnopqrstuvwxyz_-/+=")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _hash_word(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return H.Prefix(data).of(np.array([0]), np.array([len(data)]))[0]


@functools.cache
def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((int(_hash_word(w)), k) for k, ws in CUES.items() for w in ws.split())
    return np.array([p[0] for p in pairs], dtype=np.uint64), np.array([p[1] for p in pairs], dtype=np.int8)


class Tokens:
    """Tokens of a chunk: core start and end in bytes, shape, cue, length class, and the text they are in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        word = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        start = np.flatnonzero(word & (~np.concatenate([[False], word[:-1]]) | edge[:-1]))
        end = np.flatnonzero(word & (~np.concatenate([word[1:], [False]]) | edge[1:])) + 1
        self.stop = _STOP[data[end - 1]].astype(np.int8)
        for _ in range(6):  # quotes, brackets and signs around the core
            start += _OPENING[data[start]] & (start < end - 1)
            end -= _CLOSING[data[end - 1]] & (start < end - 1)
        self.start, self.end, self.doc = start, end, np.searchsorted(offsets, start, side="right") - 1
        n = end - start
        total = lambda mask: (s := np.concatenate([[0], np.cumsum(mask[data], dtype=np.int32)]))[end] - s[start]
        up, low, dig, code = total(_UP), total(_LOW), total(_DIG), total(_CODE)
        first = data[start]
        second = data[np.minimum(start + 1, len(data) - 1)]
        accent = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (n > 2)
        letters = up + low
        shape = np.full(len(n), OTHER, np.int8)
        shape[letters + dig == 0] = NONE
        shape[(low == n) & ~accent] = LOWER
        shape[(up == n) & (n > 1)] = UPPER
        shape[(up == n) & (n == 1)] = INITIAL
        shape[(low + 1 == n) & (up == 1) & _UP[first] | accent & (low == n)] = CAPITAL
        shape[(dig > 0) & (letters == 0)] = DIGITS
        shape[(dig > 0) & (letters > 0)] = MIXED
        shape[(dig >= 3) & (letters >= 3) & (code == n) & (n >= 16)] = CODE
        self.shape, self.length = shape, np.searchsorted([3, 6, 12, 20, 32], n, side="right").astype(np.int8)
        hashes, kinds = _cue_table()
        own = H.Prefix(_FOLD[data]).of(start, end)
        self.same = np.concatenate([[False], own[1:] == own[:-1]]).astype(np.int8) if len(own) else np.zeros(0, np.int8)
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        self.cue = np.where(hashes[at] == own, kinds[at], 0).astype(np.int8)

    def features(self, at: np.ndarray) -> dict[str, np.ndarray]:
        def near(values: np.ndarray, step: int, none: int) -> np.ndarray:
            to = at + step
            ok = (to >= 0) & (to < len(values))
            to = np.clip(to, 0, len(values) - 1)
            return np.where(ok & (self.doc[to] == self.doc[at]), values[to], none)

        return {"shape": self.shape[at], "cue": self.cue[at], "length": self.length[at], "cue-1": near(self.cue, -1, 0), "cue-2": near(self.cue, -2, 0), "shape-1": near(self.shape, -1, NONE), "shape+1": near(self.shape, 1, NONE), "stop-1": near(self.stop, -1, 1), "same": self.same[at]}


def emissions(weights: dict[str, np.ndarray], tokens: Tokens, at: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at), len(LABELS)))
    for name, values in tokens.features(at).items():
        out += weights[name][values]
    return np.where(ALLOWED[tokens.shape[at]], out, _FORBIDDEN)


def _transitions(free: np.ndarray) -> np.ndarray:
    out = free.copy()
    out[[O, SECRET], I_NAME] = _FORBIDDEN
    return out


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of segments (segments x steps x labels) that have O before and after them."""
    steps = emit.shape[1]
    score, back = trans[O] + emit[:, 0], []
    for t in range(1, steps):
        ways = score[:, :, None] + trans[None]
        back.append(ways.argmax(axis=1))
        score = ways.max(axis=1) + emit[:, t]
    best = (score + trans[:, O]).argmax(axis=1)
    path = [best]
    for ways in reversed(back):
        best = np.take_along_axis(ways, best[:, None], axis=1)[:, 0]
        path.append(best)
    return np.stack(path[::-1], axis=1)


def decode(weights: dict[str, np.ndarray], tokens: Tokens) -> np.ndarray:
    """A label for every token."""
    out = np.zeros(len(tokens.start), np.int8)
    open_ = np.flatnonzero(ALLOWED[tokens.shape][:, 1:].any(axis=1))
    if not len(open_):
        return out
    new = np.concatenate([[True], (np.diff(open_) > 1) | (np.diff(tokens.doc[open_]) > 0)])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(open_)]]))
    emit, trans = emissions(weights, tokens, open_), _transitions(weights["trans"])
    for n in np.unique(size):
        heads = first[size == n]
        rows = heads[:, None] + np.arange(n)
        out[open_[rows]] = viterbi(emit[rows], trans)
    return out


@functools.cache
def labelled_table(copies: int = 10, seed: int = 3) -> tuple[tuple[str, tuple[int, ...]], ...]:
    """The lines of LABELLED with drawn words: (text, label of each token)."""
    draw, names, out = np.random.default_rng(seed), NAMES.split(), []
    syllables = "an er on re in th st en le ou de ie os as ch ei".split()
    word = lambda: "".join(draw.choice(syllables, draw.integers(1, 5)))
    code = lambda n: "".join(draw.choice(list("0123456789abcdef"), n))
    for line in LABELLED * copies:
        text, labels, same = [], [], word().capitalize()
        for part in line.split():
            kind = re.fullmatch(r"(\W*)([NSUWCR])(\W*)", part)
            if not kind:
                text.append(part)
                labels.append(O)
                continue
            a, k, z = kind.groups()
            if k == "N":
                own = list(draw.choice(names, draw.integers(1, 4)))
                text += [*own[:-1], own[-1] + z]
                labels += [B_NAME, *[I_NAME] * (len(own) - 1)]
            else:
                text.append(a + {"S": lambda: code(draw.integers(16, 65)), "U": lambda: code(draw.integers(4, 40)), "W": word, "C": lambda: word().capitalize(), "R": lambda: same}[k]() + z)
                labels.append(SECRET if k == "S" else O)
        out.append((" ".join(text), tuple(labels)))
    return tuple(out)


@functools.cache
def _trained(steps: int = 200, rate: float = 0.1, penalty: float = 0.01) -> dict[str, np.ndarray]:
    """Weights by Adam on the penalised conditional log-likelihood; forward and backward sums run over all lines at once."""
    table = labelled_table()
    blob = "\n".join(t for t, _ in table).encode()
    lengths = [len(t.encode()) + 1 for t, _ in table]
    tokens = Tokens(np.frombuffer(blob, np.uint8), np.concatenate([[0], np.cumsum(lengths[:-1]), [len(blob)]]).astype(np.int64))
    gold = np.concatenate([y for _, y in table])
    counts = np.bincount(tokens.doc, minlength=len(table))
    width, first = counts.max(), np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.arange(len(gold))
    step = at - first[tokens.doc]
    feats = tokens.features(at)
    allowed = ALLOWED[tokens.shape]
    k = len(LABELS)
    w = {name: np.zeros((size, k)) for name, size in SIZES.items()} | {"trans": np.zeros((k, k))}
    m1, m2 = ({n: np.zeros_like(v) for n, v in w.items()} for _ in range(2))
    real = np.arange(width)[None] < counts[:, None]
    for i in range(1, steps + 1):
        emit = sum(w[n][v] for n, v in feats.items())
        grid = np.zeros((len(table), width, k))
        grid[~real] = [0, _FORBIDDEN, _FORBIDDEN, _FORBIDDEN]  # padding is O
        grid[tokens.doc, step] = np.where(allowed, emit, _FORBIDDEN)
        trans = _transitions(w["trans"])
        lse = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
        ahead, behind = np.zeros_like(grid), np.zeros_like(grid)
        ahead[:, 0] = grid[:, 0] + trans[O]
        behind[:, -1] = trans[:, O]
        for t in range(1, width):
            ahead[:, t] = grid[:, t] + lse(ahead[:, t - 1][:, :, None] + trans[None], 1)
            behind[:, -t - 1] = lse(trans[None] + (grid[:, -t] + behind[:, -t])[:, None, :], 2)
        whole = lse(ahead[:, -1] + trans[:, O], 1)
        p = np.exp(ahead + behind - whole[:, None, None])[tokens.doc, step]
        error = -p
        error[at, gold] += 1
        grad = {n: np.stack([np.bincount(v, error[:, j], SIZES[n]) for j in range(k)], axis=1) for n, v in feats.items()}
        pair = np.exp(ahead[:, :-1, :, None] + trans + (grid[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        both = real[:, 1:]
        grad["trans"] = -pair[both].sum(axis=0)
        same = tokens.doc[1:] == tokens.doc[:-1]
        np.add.at(grad["trans"], (gold[:-1][same], gold[1:][same]), 1)
        for n in w:
            g = grad[n] / len(table) - penalty * w[n] / len(table)
            m1[n] = 0.9 * m1[n] + 0.1 * g
            m2[n] = 0.99 * m2[n] + 0.01 * g * g
            w[n] = w[n] + rate * (m1[n] / (1 - 0.9**i)) / (np.sqrt(m2[n] / (1 - 0.99**i)) + 1e-8)
    return w


def train() -> dict[str, np.ndarray]:
    return _trained()


def found_spans(weights: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> dict[int, list[list[tuple[int, int]]]]:
    """For texts of a chunk in which the field labels anything: spans of each extra kind, in code points."""
    if not len(data):
        return {}
    tokens = Tokens(data, offsets)
    label = decode(weights, tokens)
    hit = np.flatnonzero(label)
    if not len(hit):
        return {}
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    out: dict[int, list[list[tuple[int, int]]]] = {}
    for i in hit.tolist():
        doc, kind = int(tokens.doc[i]), int(label[i])
        zero = points[offsets[doc]]
        a, b = int(points[tokens.start[i]] - zero), int(points[tokens.end[i]] - zero)
        own = out.setdefault(doc, [[], []])
        if kind == SECRET:
            own[1].append((a, b))
        elif kind == I_NAME and own[0]:
            own[0][-1] = (own[0][-1][0], b)
        else:
            own[0].append((a, b))
    return out


def joined(kinds: tuple[str, ...], spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(kinds, spans, strict=True) for a, b in own)


def _scan(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for row, data, offsets in H.chunks(texts):
                extra = found_spans(weights, data, offsets)
                counts, sums, everything = [], [], []
                for i in range(len(offsets) - 1):
                    base = base_spans(bytes(data[offsets[i] : offsets[i + 1]]).decode(errors="replace"))
                    known = joined(BASE, base)
                    counts.append([len(x) for x in base])
                    sums.append(hashlib.sha256(known.encode()).hexdigest())
                    more = joined(EXTRA, extra[i]) if i in extra else ""
                    everything.append(",".join(x for x in (known, more) if x))
                n = np.array(counts, dtype=np.int64).reshape(-1, len(BASE))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sums)), *(pa.array(n[:, j]) for j in range(len(BASE))), pa.array(sums), pa.array(everything)], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans; one row per input row. Null text: empty; bytes that are not UTF-8 read as U+FFFD."""
    C.ship(docs.sparkSession)
    source = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(_scan(train()), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    return find(C.table(spark, sf_dir, "documents"))


def _masked(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """The text with each span, or each run of spans that overlap, replaced by its first kind."""
    found = sorted((a, b, k) for k, own in enumerate(spans) for a, b in own)
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out += [text[at:a], f"<{(*BASE, *EXTRA)[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mask_texts(weights: dict[str, np.ndarray], place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            new = []
            for row, data, offsets in H.chunks(texts):
                extra = found_spans(weights, data, offsets)
                for i in range(len(offsets) - 1):
                    text = bytes(data[offsets[i] : offsets[i + 1]]).decode(errors="replace")
                    spans = [*base_spans(text), *extra.get(i, [[], []])]
                    new.append((_masked(text, spans) if any(spans) else text) if texts[row + i].is_valid else None)
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    return run


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span in ``text`` replaced by its kind, and ``n_chars``, where there is one, counted again."""
    C.ship(docs.sparkSession)
    out = docs.mapInArrow(_mask_texts(train(), docs.columns.index("text")), docs.schema)
    if "n_chars" in docs.columns:
        counted = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", counted)
    return out.select(*docs.columns)
