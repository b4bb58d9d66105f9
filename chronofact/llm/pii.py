"""Personal data: exact formats, and what gradient-boosted trees accept of spans that generous generators propose.

The formats (``base_spans``) always count. Beside them, generators propose overlapping spans of the same kinds: parts of
longer runs of digits, other separators, disguised or missing signs. Boosted trees judge each proposal by its format and
its surroundings; a threshold on their calibrated probability decides, and of overlapping accepted spans the surest stays.
The trees learn from a bounded sample of the corpus: its own formats, as they are and rewritten, spoiled or run together
with other numbers (so that what is personal is known), and what else the generators propose there.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm import text as T
from chronofact.llm.storage import tidy, tune

KINDS = ("email", "ip", "card", "phone")
#: Bound of the sample that the trees are fitted on: about so many distinct texts with a digit or an @, and so many
#: others; of each, at most so many proposals as they are, so many windows with a rewritten span, and in each of these
#: so many proposals that are not personal.
TRAIN_ROWS, TRAIN_OTHERS, OF_TEXT, WINDOWS, OF_WINDOW = 800, 400, 8, 8, 4
#: From this calibrated probability on, a proposal is accepted.
SURE = 0.9
#: Characters on either side that a proposal's features look at.
NEAR = 48
#: Bytes of texts and proposals that are handled at once.
PIECE, BLOCK = 1 << 20, 4096

_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_GROUP = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _groups(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _GROUP.finditer(text)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The exact formats, leftmost and without overlaps within a kind, by kind and start. Linear in the text: an address is
    looked for around its @, and numbers are put together from their groups of digits."""
    return _base(text, _groups(text))


def _base(text: str, groups: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _EMAIL_NAME:
            first -= 1
        host = _EMAIL_HOST.match(text, at + 1) if first < at else None
        done = host.end() if host else at + 1
        if host:
            out.append(("email", first, done))
        at = text.find("@", done)
    #: What stands between each group and the next, if that is one character.
    gaps = [text[b] if a - b == 1 else "" for (_, b), (a, _) in zip(groups, groups[1:])]
    i = 0
    while i + 3 < len(groups):
        if gaps[i] == gaps[i + 1] == gaps[i + 2] == ".":
            if all(_octet(text[a:b]) for a, b in groups[i : i + 4]):
                out.append(("ip", groups[i][0], groups[i + 3][1]))
            i += 3
        i += 1
    i = 0
    while i < len(groups):
        first, size = i, groups[i][1] - groups[i][0]
        while i < len(gaps) and gaps[i] in (" ", "-"):
            i += 1
            size += groups[i][1] - groups[i][0]
        if 16 <= size <= 19 and luhn("".join(text[a:b] for a, b in groups[first : i + 1])):
            out.append(("card", groups[first][0], groups[i][1]))
        i += 1
    at = text.find("+") if groups else -1
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
        at = text.find("+", m.end() if m else at + 1)
    return out


# Generators

#: What may stand between groups of digits of one number; dots are also written in words or brackets.
_BETWEEN = re.compile(r"[ \u00a0\u2009\u202f().\-\u2010\u2011\u2013/_\u00b7]{1,4}")
_DOT = re.compile(r"\.| ?[\[({] ?(?:\.|dot|DOT) ?[\])}] ?| (?:\.|dot|DOT) ")
_AT = re.compile(r" ?[@\uff20] ?| at | AT | ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?")
#: What every sign for @ has in it.
_ATS = ("@", "\uff20", *(a + b for a in ("at", "AT") for b in " )]}>"))
_LABEL = re.compile(r"[\w-]{1,63}")
_NAME_CHARS = re.compile(r"[\w.%+-]{1,64}\Z")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_SIX = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:){2,7}(?:[0-9A-Fa-f]{1,4})?(?![\w:])")


def _signs(text: str) -> Iterator[re.Match]:
    """Signs for @ in their order; only around what they have in common is looked for them."""
    places = set()
    for sign in _ATS:
        at = text.find(sign)
        while at >= 0:
            places.add(at)
            at = text.find(sign, at + 1)
    done = 0
    for at in sorted(places):
        for first in range(max(done, at - 3), at + 1):
            m = _AT.match(text, first)
            if m:
                yield m
                done = m.end()
                break


def proposals(text: str, groups: list[tuple[int, int]] | None = None) -> Iterator[tuple[str, int, int]]:
    """Spans that may be personal data, many of which overlap: far more than are."""
    for m in _signs(text):
        name = _NAME_CHARS.search(text, max(0, m.start() - 64), m.start())
        label = _LABEL.match(text, m.end()) if name else None
        for _ in range(5):
            dot = _DOT.match(text, label.end()) if label else None
            label = _LABEL.match(text, dot.end()) if dot else None
            if label:
                yield "email", name.start(), label.end()
    for m in _SIX.finditer(text) if _COLONS.search(text) else ():
        if m.end() - m.start() > 6:
            yield "ip", *m.span()
    groups = _groups(text) if groups is None else groups
    for i, (start, _) in enumerate(groups):
        if i + 3 < len(groups) and all(_DOT.fullmatch(text, groups[k][1], groups[k + 1][0]) for k in range(i, i + 3)):
            yield "ip", start, groups[i + 3][1]
        opened = start
        while opened and start - opened < 2 and text[opened - 1] in "+(":
            opened -= 1
        joined = i and _BETWEEN.fullmatch(text, groups[i - 1][1], start)
        phone = opened < start or not joined or text.startswith("00", start)
        digits = 0
        for j in range(i, len(groups)):
            if j > i and not _BETWEEN.fullmatch(text, groups[j - 1][1], groups[j][0]):
                break
            digits, end = digits + groups[j][1] - groups[j][0], groups[j][1]
            if digits > 19:
                break
            if digits >= 15:
                yield "card", start, end
            if 7 <= digits <= 15 and phone:
                yield "phone", opened, end
                if start - opened == 2:
                    yield "phone", start - 1, end


# Features

#: Words before a span that speak for a kind, and against all (fixed values).
_CUES = {
    "email": ("mail", "email", "e-mail", "contact", "kontakt", "correo", "courriel", "write", "address", "adresse"),
    "ip": ("ip", "host", "server", "address", "adresse", "login", "from", "gateway", "client"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta", "payment", "pan"),
    "phone": ("tel", "phone", "telephone", "telefon", "teléfono", "téléphone", "call", "fax", "mobile", "mobil", "cell", "whatsapp"),
}
_AGAINST = ("id", "order", "invoice", "version", "v", "ver", "release", "isbn", "issn", "doi", "token", "hash", "sha", "commit", "page", "date", "total", "price", "eur", "usd", "serial", "ref", "nr", "no", "section", "chapter")
_WORD = re.compile(r"[^\W\d_]+")
_DATE = re.compile(r"(?:19|20)\d\d[-./ ](?:0?[1-9]|1[0-2])[-./ ](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-./ ](?:0?[1-9]|1[0-2])[-./ ](?:19|20)\d\d")


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """A proposal's format and surroundings as numbers."""
    span = text[start:end]
    groups = _groups(span)
    sizes = [b - a for a, b in groups]
    digits = "".join(span[a:b] for a, b in groups)
    gaps = [span[b:a] for (_, b), (a, _) in zip(groups, groups[1:])]
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    last, first = before[-1:] or " ", after[:1] or " "
    words = [w.lower() for w in _WORD.findall(before)[-3:]]
    stripped = span.lstrip("+(")
    left, right = re.search(r"([0-9]+)([^0-9A-Za-z]{1,3})\Z", before), re.match(r"([^0-9A-Za-z]{1,3})([0-9]+)", after)
    octets = [span[a:b] for a, b in groups]
    return [
        len(span), len(digits), len(groups), sum(c.isalpha() for c in span), max(sizes, default=0), min(sizes, default=0),
        sizes[0] if sizes else 0, sizes[1] if len(sizes) > 1 else 0, sizes[-2] if len(sizes) > 1 else 0, sizes[-1] if sizes else 0,
        len(set(gaps)), sum(len(g) for g in gaps), span.count(" "), span.count("-"), span.count("."), span.count("(") + span.count(")"),
        luhn(digits) if len(digits) >= 12 else -1, bool(octets) and all(map(_octet, octets)), any(len(o) > 1 and o[0] == "0" for o in octets), len(set(digits)),
        span.startswith("+"), stripped.startswith("00"), span.startswith("("), span.count("(") == span.count(")"), span.count("@") + span.count("＠"), span.count(":"), bool(_DATE.search(span)),
        last.isalnum() or last in "_=", first.isalnum() or first in "_=", last in ".@-/:+,#$€£\"'", first in "@-/:%€£$\"'", first in ".," and after[1:2].isalnum(),
        len(left[2]) if left else 0, len(right[1]) if right else 0, bool(left) and left[2] in gaps, bool(right) and right[1] in gaps, len(left[1]) if left else 0, len(right[2]) if right else 0, len(set(sizes[:-1])) == 1 and sizes[-1] <= sizes[0],
        any(w in _CUES[kind] for w in words), any(w in _AGAINST for w in words), sum(c.isdigit() for c in before + after), bool(_WORD.fullmatch(span[-2:])) and len(_WORD.findall(span)[-1]),
    ]


# Boosted trees

#: Trees, their depth, bins of a feature, step, weight decay of a leaf, least weight of a leaf, folds of calibration.
TREES, DEPTH, BINS, STEP, DECAY, LEAST, FOLDS = 40, 4, 32, 0.25, 1.0, 2.0, 3


@dataclass
class Trees:
    """Trees of one depth: of each inner node its feature and border (values up to it go left), of each leaf its value."""

    feature: np.ndarray
    border: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, border, value in zip(self.feature, self.border, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > border[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss over binned features, a level at a time."""
    d, inner = x.shape[1], 2**DEPTH - 1
    borders = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(d)]
    bins = np.stack([np.searchsorted(b, x[:, k], "left") for k, b in enumerate(borders)], 1)
    share = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
    out = Trees(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)), float(np.log(share / (1 - share))))
    margin = np.full(len(y), out.start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            n, at = 2**level, node - (2**level - 1)
            best = np.full(n, 1e-6)
            for k in range(d):
                key = at * BINS + bins[:, k]
                sg, sh = (np.bincount(key, v, n * BINS).reshape(n, BINS).cumsum(1) for v in (g, h))
                rg, rh = sg[:, -1:] - sg, sh[:, -1:] - sh
                gain = sg**2 / (sh + DECAY) + rg**2 / (rh + DECAY) - sg[:, -1:] ** 2 / (sh[:, -1:] + DECAY)
                gain[(sh < LEAST / 4) | (rh < LEAST / 4)] = 0
                cut = gain[:, : max(1, len(borders[k]))].argmax(1)
                found = gain[np.arange(n), cut]
                for i in np.flatnonzero(found > best):
                    best[i] = found[i]
                    out.feature[t, n - 1 + i], out.border[t, n - 1 + i] = k, borders[k][cut[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.border[t, node])
        leaf = node - inner
        out.value[t] = -STEP * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + DECAY)
        margin = margin + out.value[t][leaf]
    return out


def calibrated(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, sure: float) -> float:
    """The least margin whose calibrated probability is ``sure`` or more; the calibration is the rising step function that
    fits held-out labels best (pools of adjacent violators). Infinite if none is."""
    blocks: list[list[float]] = []
    for m in np.unique(margin):
        own = margin == m
        blocks.append([float((weight * y)[own].sum()), float(weight[own].sum()), float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            hits, total, _ = blocks.pop()
            blocks[-1][0] += hits
            blocks[-1][1] += total
    return next((m for hits, total, m in blocks if hits >= sure * total), float("inf"))


@dataclass
class Model:
    """Trees and threshold of each kind; a kind without them accepts nothing."""

    trees: dict[str, Trees]
    least: dict[str, float]

    def added(self, text: str, base: list[tuple[str, int, int]], groups: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
        """Accepted proposals that overlap neither a base span nor a surer proposal."""
        taken: list[tuple[int, int]] = []
        for _, a, b in sorted(base, key=lambda s: s[1]):
            taken[-1:] = [(taken[-1][0], max(b, taken[-1][1]))] if taken and taken[-1][1] > a else [*taken[-1:], (a, b)]

        def free(a: int, b: int) -> bool:
            """``taken`` is sorted without overlaps: only the last that begins before ``b`` can reach over ``a``."""
            at = bisect_left(taken, (b, -1)) - 1
            return at < 0 or taken[at][1] <= a

        accepted: set[tuple[float, int, int, str]] = set()
        blocks: dict[str, list[tuple[int, int]]] = {kind: [] for kind in self.trees}

        def judge(kind: str) -> None:
            block = blocks[kind]
            if block:
                margin = self.trees[kind].margin(np.array([describe(text, kind, a, b) for a, b in block], np.float64))
                accepted.update((-float(m), a, -b, kind) for m, (a, b) in zip(margin, block, strict=True) if m >= self.least[kind])
                block.clear()

        for kind, a, b in proposals(text, groups):
            if kind in blocks and free(a, b):
                blocks[kind].append((a, b))
                if len(blocks[kind]) == BLOCK:
                    judge(kind)
        for kind in blocks:
            judge(kind)
        out = []
        for _, a, minus_b, kind in sorted(accepted):
            if free(a, -minus_b):
                insort(taken, (a, -minus_b))
                out.append((kind, a, -minus_b))
        return out


# Examples

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _card(rng: random.Random, right: bool) -> str:
    body = str(rng.randint(2, 9)) + _digits(rng, rng.choice([14, 14, 14, 14, 15, 17]))
    check = next(c for c in "0123456789" if luhn(body + c))
    return body + (check if right else str((int(check) + rng.randint(1, 9)) % 10))


def _cut(digits: str, by: str, size: int = 4) -> str:
    return by.join(digits[i : i + size] for i in range(0, len(digits), size))


def _personal(rng: random.Random, kind: str) -> str:
    """Something of the kind, as it is usually written."""
    name = "".join(rng.choices(_LETTERS, k=rng.randint(2, 9)))
    if kind == "email":
        return f"{name}{rng.choice(['', '.', '_', '+'])}{_digits(rng, rng.randint(1, 3))}@{rng.choice(['mail', 'post', 'web', name])}{rng.choice(['', '-x', '7'])}.{rng.choice(['example', 'host', 'corp'])}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'info'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        return _cut(_card(rng, True), rng.choice(["", "", " ", "-"]))
    area, rest = _digits(rng, 3), _digits(rng, 4)
    return rng.choice([f"+1 ({area}) 555-{rest}", f"+{rng.randint(20, 99)} {area} {_digits(rng, 3)} {rest}", f"+{rng.randint(20, 99)}{area}{_digits(rng, 3)}{rest}", f"+1-{area}-{_digits(rng, 3)}-{rest}", f"+1.{area}.{_digits(rng, 3)}.{rest}"])


def _disguised(rng: random.Random, kind: str, span: str) -> str | None:
    """The same, written in a way that its format doesn't know."""
    if kind == "email":
        at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", "."), ("＠", "."), ("{at}", "{dot}"), (" @ ", ".")])
        name, _, host = span.partition("@")
        return name + at + host.replace(".", dot)
    if kind == "ip":
        if rng.random() < 0.25:
            return ":".join(f"{rng.randrange(65536):x}" for _ in range(8)) if rng.random() < 0.5 else f"2001:db8::{rng.randrange(65536):x}:{rng.randrange(65536):x}"
        return span.replace(".", rng.choice(["[.]", "(.)", " . ", "[dot]", " dot "]))
    digits = "".join(c for c in span if c.isdigit())
    if kind == "card":
        return _cut(digits, rng.choice([".", " ", "_", "/", "  ", " - "]))
    if len(digits) < 8:
        return None
    code, area, mid, rest = digits[:-10] or "1", digits[-10:-7] or "20", digits[-7:-4], digits[-4:]
    return rng.choice([f"00{code} {area} {mid} {rest}", f"00{code}{area}{mid}{rest}", f"({area}) {mid}-{rest}", f"({area}){mid}-{rest}", f"{area}-{mid}-{rest}", f"+{code}/{area}/{mid}{rest}", f"+{code} {area} {mid} {rest}", f"(+{code}) {area} {mid} {rest}"])


def _spoiled(rng: random.Random, kind: str) -> str:
    """What looks like the kind and is not."""
    name, year = "".join(rng.choices(_LETTERS, k=5)), rng.randint(1950, 2035)
    if kind == "email":
        return rng.choice([f"@{name}", f"{name}@{name}", f"{name} @ {name}", f"{name} at {name}. {name.title()}", f"{name}@", f"{name} at {name}"])
    if kind == "ip":
        return rng.choice([".".join(str(rng.randint(0, 255) + 256 * (k == rng.randrange(4) or k == 2)) for k in range(4)), f"{rng.randint(1, 20)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}", f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}", ".".join(str(rng.randint(256, 999)) for _ in range(4))])
    if kind == "card":
        return rng.choice([_card(rng, False), _card(rng, False), _cut(_card(rng, False), rng.choice([" ", "-", "."])), "".join(rng.choices("0123456789abcdef", k=40)), f"{name}{_card(rng, True)}{name}", _digits(rng, rng.choice([12, 13, 14, 15]))])
    return rng.choice(
        [
            f"{year}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{year}", f"{year}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02} {rng.randint(0, 23):02}:{rng.randint(0, 59):02}", f"{year} - {year + 9}", f"{rng.randint(1, 999)}.{_digits(rng, 3)}.{_digits(rng, 3)}",
            _digits(rng, rng.randint(7, 12)), f"{rng.randint(1, 999)}.{_digits(rng, rng.randint(5, 9))}", f"978-{_digits(rng, 1)}-{_digits(rng, 4)}-{_digits(rng, 4)}-{_digits(rng, 1)}", f"{rng.randint(1, 99)} {rng.randint(1, 999)} {rng.randint(1, 9999)} {rng.randint(1, 99)}", f"+{rng.randint(1, 99)}", f"{name}-{_digits(rng, 4)}-{_digits(rng, 4)}",
        ]
    )


def _joined(rng: random.Random) -> tuple[str | None, str]:
    """A number to stand directly before or after a span, so that both run together, and its kind if it is personal."""
    kind = rng.choice([None, None, None, "ip", "card"])
    plain = [str(rng.randint(0, 9999)), _digits(rng, rng.randint(1, 6)), f"{rng.randint(0, 99)}.{rng.randint(0, 99)}", f"{_digits(rng, 4)} {_digits(rng, 4)}"]
    return kind, _personal(rng, kind) if kind else rng.choice(plain)


Example = tuple[str, bool, float, list[float]]


def examples(text: str) -> list[Example]:
    """``kind, personal, weight, features`` of proposals in the text and in windows of it where spans are rewritten.

    What the generators propose in the text as it is, and is no base span, is taken for not personal, with little weight.
    """
    rng = random.Random(zlib.crc32(text.encode()))
    base = base_spans(text)
    known, found, out = set(base), list(proposals(text)), []
    for p in rng.sample(found, min(len(found), OF_TEXT)):
        out.append((p[0], p in known, 1.0 if p in known else 0.3, describe(text, *p)))
    places = rng.sample(base, min(len(base), WINDOWS // 2))
    for _ in range(WINDOWS - len(places)):
        at = text.find(" ", rng.randrange(len(text)))
        places.append((rng.choice(KINDS), max(at, 0), -1))
    for kind, a, b in places:
        span, into = (text[a:b], "") if b >= 0 else (_personal(rng, kind), " ")
        before, after = text[max(0, a - 2 * NEAR) : a] + into, into + text[a if b < 0 else b :][: 2 * NEAR]
        way, first = rng.randrange(4), rng.random() < 0.5
        new = [span, span, _disguised(rng, kind, span) or span, _spoiled(rng, kind)][way]
        true, middle = [(kind, new)] if way < 3 else [(None, new)], new
        if way == 1:
            true = [_joined(rng), *true] if first else [*true, _joined(rng)]
            middle = " ".join(x for _, x in true)
        window, at, spans = before + middle + after, len(before), set()
        for of, x in true:
            spans |= {(of, at, at + len(x))} if of else set()
            at += len(x) + 1
        begin, end = len(before), len(before) + len(middle)
        exact = set(base_spans(window))
        near = [p for p in proposals(window) if p[1] < end and p[2] > begin and (p in spans or p not in exact)]
        rest = [p for p in near if p not in spans]
        for p in [p for p in near if p in spans] + rng.sample(rest, min(len(rest), OF_WINDOW)):
            out.append((p[0], p in spans, 1.0, describe(window, *p)))
    return out


def fit(rows: np.ndarray, sure: float = SURE) -> Model:
    """Trees for each kind, and its threshold from predictions of trees that haven't seen the fold. Columns: the kind's
    number, whether it is personal, weight, features; equal features share a fold."""
    model = Model({}, {})
    for number, kind in enumerate(KINDS):
        own = rows[rows[:, 0] == number]
        y, weight, x = own[:, 1], own[:, 2], np.ascontiguousarray(own[:, 3:])
        if not len(own) or y.min() == y.max():
            continue
        fold = np.array([zlib.crc32(r.tobytes()) % FOLDS for r in x])
        margin = np.zeros(len(own))
        for f in range(FOLDS):
            if (fold == f).any() and not (fold == f).all():
                margin[fold == f] = boost(x[fold != f], y[fold != f], weight[fold != f]).margin(x[fold == f])
        model.trees[kind], model.least[kind] = boost(x, y, weight), calibrated(np.round(margin, 2), y, weight, sure)
    return model


def train(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS, train_others: int = TRAIN_OTHERS) -> Model:
    """Fits the trees on a sample of distinct texts chosen by their hash: about ``train_rows`` that hold a digit or an @, and
    ``train_others`` of the rest. Copies of a text count once. Without texts, nothing is ever added to the base spans."""
    tune(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text <> ''").withColumn("some", F.col("text").rlike("[0-9@]"))
    sizes = {r["some"]: r["n"] for r in texts.groupBy("some").agg(F.count("*").alias("n")).collect()}
    part = {True: min(1.0, train_rows / max(1, sizes.get(True, 0))), False: min(1.0, train_others / max(1, sizes.get(False, 0)))}
    limit = F.when(F.col("some"), F.lit(min(2**63 - 1, int(part[True] * 2**63)))).otherwise(F.lit(min(2**63 - 1, int(part[False] * 2**63))))
    hashed = texts.withColumn("h", F.xxhash64("text")).where(F.col("h").bitwiseAND(F.lit(2**63 - 1)) <= limit)
    sample = hashed.groupBy("h").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [examples(t.as_py()) for t in b.column("text")]
            packed = [np.array([[KINDS.index(k), y, w, *x] for k, y, w, x in rows], "<f4").tobytes() for rows in found]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([len(r) for r in found], pa.int64()), pa.array(packed, pa.binary())], names=["h", "n", "rows"])

    found = sample.mapInArrow(tidy(run), "h long, n long, rows binary").where("n > 0").collect()  # bounded by the sample
    found.sort(key=lambda r: r["h"])  # whatever order they come in
    return fit(np.concatenate([np.frombuffer(r["rows"], "<f4").reshape(r["n"], -1) for r in found]).astype(np.float64) if found else np.zeros((0, 4)))


def written(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` by kind as listed, then start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (or run of overlapping ones) as the kind of its first in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def find_personal(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_redacted: bool = False) -> DataFrame:
    """Personal data in whole texts: one row for each row of ``df``.

    The id; ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, the base spans of each kind; ``base_sha256`` of these, written as
    ``kind:start:end`` (code points) by kind, then start, joined by commas; ``spans``, base and added ones, written
    likewise; ``n_added``; and, if asked for, ``redacted``. A null text is empty: no spans, hash of nothing. Repeated rows
    stay, ids may be null; other columns are not carried, so their names cannot clash.
    """
    spark = df.sparkSession
    tune(spark)
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # TREES trees of DEPTH levels for each kind
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", *["redacted"] * with_redacted]
    types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.string()]

    def one(text: str) -> tuple:
        groups = _groups(text)
        base = _base(text, groups)
        more = shared.value.added(text, base, groups)
        counts = [sum(s[0] == k for s in base) for k in KINDS]
        own = (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more))
        return (*own, redacted(text, base + more)) if with_redacted else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in T.pieces(batch, 1, PIECE):
                found = [one(t.as_py() or "") for t in b.column(1)]
                columns = list(zip(*found, strict=True)) if found else [()] * (len(names) - 1)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], names=names)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long" + ", redacted string" * with_redacted
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(tidy(run), schema)
