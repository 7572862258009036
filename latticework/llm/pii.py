"""Personal data: fixed patterns, and spans that a semi-Markov conditional random field adds."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import clear_of, map_frames, numbered, table

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity at most: an address has 254 characters. Of the others, ip_six is the longest, with 50.
LONGEST = 254

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The first digits of a run only: from any other digit of it the pattern fails in the same way.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, sorted."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x) < 4 and int(x or 0) < 256 for x in (y.lstrip("0") for y in m[0].split(".")))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
#: Some part of every shape that can be an entity.
_TRIGGER = re.compile(r"[0-9]{3}|@|\b[Dd][Oo][Tt]\b|::|[\[({<]\s?(?:at|AT)\s?[\])}>]|[\[({]\s?(?:dot|DOT|\.)\s?[\])}]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]")
#: Whole-span shapes: a candidate of more than one token must have one of them.
_SHAPES = [
    ("email_tagged", re.compile(r"[A-Za-z0-9._%+-]+\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?[A-Za-z0-9-]+(?:\s?(?:[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]|\.)\s?[A-Za-z0-9-]+)+")),
    ("email_spoken", re.compile(r"[A-Za-z0-9._%+-]+ (?:at|AT) [A-Za-z0-9-]+(?: (?:dot|DOT) [A-Za-z0-9-]+)+")),
    ("email_spaced", re.compile(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]{2,})+")),
    ("ip_tagged", re.compile(r"[0-9]{1,3}(?:\s?(?:[\[({]\s?(?:dot|\.)\s?[\])}]|\bdot\b)\s?[0-9]{1,3}){3}")),
    ("ip_six", re.compile(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,4}")),
    ("card_groups", re.compile(r"[0-9]{4}(?:[ ./_-]{1,3}[0-9]{4}){2,3}(?:[ ./_-]{1,3}[0-9]{1,3})?|3[0-9]{3}[ ./_-]{1,3}[0-9]{6}[ ./_-]{1,3}[0-9]{5}")),
    ("phone_area", re.compile(r"(?:1[ .-])?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}")),
    ("phone_00", re.compile(r"00[0-9]{1,3}(?:[ .()/-]{1,2}[0-9]{2,5}){2,5}")),
    ("phone_trunk", re.compile(r"0[0-9]{2,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,4}")),
    ("date", re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}")),
    ("number", re.compile(r"[0-9]+(?:[.,][0-9]+)*")),
]
_BEGUN = [(n, regex.compile(p.pattern).fullmatch) for n, p in _SHAPES]
_CLUES = {
    "email": {"email", "mail", "contact", "write", "reach"},
    "ip": {"ip", "host", "server", "address", "node", "client"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "pan", "debit"},
    "phone": {"phone", "tel", "call", "mobile", "cell", "fax", "ring", "telephone", "whatsapp"},
    "other": {"order", "invoice", "id", "no", "number", "serial", "version", "isbn", "ref", "part", "sku", "item"},
}
LABELS = (None, *KINDS)


def _clue(tokens, i: int) -> list[str]:
    near = {t[0].lower() for t in tokens[max(0, i - 3) : i]}
    return [f"clue:{k}" for k, words in _CLUES.items() if near & words]


def _features(text: str, tokens, i: int, j: int) -> list[str] | None:
    """Features of the whole segment of tokens i to j - 1; None if it can't be an entity."""
    start, end = tokens[i][1], tokens[j - 1][2]
    s = text[start:end]
    shape = next((n for n, p in _SHAPES if p.fullmatch(s)), None)
    if shape is None:
        if j - i > 1:
            return None
        return ["token", "word" if s.isalpha() else "mark"]
    digits = "".join(filter(str.isdigit, s))
    out = ["span", f"shape:{shape}", f"digits:{min(len(digits), 20)}", *_clue(tokens, i), *(f"{shape}&{c}" for c in _clue(tokens, i))]
    if len(digits) >= 12:
        out.append(f"luhn:{luhn(digits)}&{shape}")
    if (start and (text[start - 1].isalnum() or text[start - 1] in "+._-/")) or (end < len(text) and (text[end].isalnum() or text[end : end + 2].strip(".,;:!?)") and text[end] in "._-/" and text[end + 1 : end + 2].isalnum())):
        out.append("glued")
    if shape == "ip_tagged" and all(int(x) < 256 for x in re.findall("[0-9]+", s)):
        out.append("octets")
    return out


def _lattice(text: str, tokens) -> list[tuple[int, int, list[str]]]:
    out = []
    for i in range(len(tokens)):
        first = tokens[i][0]
        out.append((i, i + 1, _features(text, tokens, i, i + 1)))
        if not (first[0].isalnum() or first[0] == "("):
            continue
        begun = _BEGUN
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            begun = [x for x in begun if x[1](text, tokens[i][1], tokens[j - 1][2], partial=True)]
            if not begun:  # no longer segment has a shape
                break
            if j == i + 1:
                continue
            if tokens[j - 1][0][0].isalnum() or tokens[j - 1][0] in ")]}>":
                f = _features(text, tokens, i, j)
                if f:
                    out.append((i, j, f))
    return out


class SemiMarkov:
    """A semi-Markov field: a segmentation's score is the sum of its segments' scores.

    A segment of several tokens is an entity or a number; its label may be none. The
    forward recursion over segment ends gives the partition function, the same
    recursion with max the best segmentation.
    """

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, len(LABELS)))

    def _rows(self, lattice, grow: bool):
        out = []
        for i, j, f in lattice:
            if grow:
                for x in f:
                    self.index.setdefault(x, len(self.index))
            out.append((i, j, [self.index[x] for x in f if x in self.index]))
        return out

    def fit(self, cases, epochs: int = 25, rate: float = 0.2, decay: float = 1e-3) -> SemiMarkov:
        """cases: (text, tokens, {(first, last + 1): label}); gradient ascent on the conditional likelihood."""
        data = [(self._rows(_lattice(t, tok), True), len(tok), gold) for t, tok, gold in cases]
        self.w = np.zeros((len(self.index), len(LABELS)))
        total = np.full_like(self.w, 1e-6)
        for _ in range(epochs):
            for rows, n, gold in data:
                g = -decay * self.w
                s = np.array([self.w[f].sum(0) for _, _, f in rows])
                fwd, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                fwd[0] = back[n] = 0.0
                own = np.logaddexp.reduce(s, axis=1)
                for (i, j, _), x in zip(rows, own):  # sorted by start: all that end at i have been seen
                    fwd[j] = np.logaddexp(fwd[j], fwd[i] + x)
                for (i, j, _), x in zip(reversed(rows), own[::-1]):
                    back[i] = np.logaddexp(back[i], back[j] + x)
                for (i, j, f), x in zip(rows, s):
                    p = np.exp(x + fwd[i] + back[j] - fwd[n])
                    inside = any(a <= i and j <= b and (a, b) != (i, j) for a, b in gold) or any(a < j and i < b and (a, b) != (i, j) for a, b in gold)
                    y = np.zeros(len(LABELS))
                    if (i, j) in gold:
                        y[LABELS.index(gold[i, j])] = 1
                    elif j == i + 1 and not inside:
                        y[0] = 1
                    np.add.at(g, f, y - p)
                total += g * g
                self.w += rate * g / np.sqrt(total)
        return self

    def decode(self, text: str, tokens) -> list[tuple[int, int, int]]:
        """(start, kind's number, end) of the entities of the best segmentation."""
        n = len(tokens)
        best, came = np.full(n + 1, -np.inf), [None] * (n + 1)
        best[0] = 0.0
        plain = {self.index.get(x, -1) for x in ("shape:number", "shape:date", "token")}
        for i, j, f in self._rows(_lattice(text, tokens), False):
            s = self.w[f].sum(0)
            k = 0 if plain.intersection(f) else int(s.argmax())  # bare numbers, dates and words are never entities
            if best[i] + s[k] > best[j]:
                best[j], came[j] = best[i] + s[k], (i, k)
        out, j = [], n
        while j:
            i, k = came[j]
            if k:
                out.append((tokens[i][1], k - 1, tokens[j - 1][2]))
            j = i
        return out[::-1]


def _tokens(text: str, start: int = 0, end: int | None = None):
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def _with_check(digits: str) -> str:
    return next(digits + str(k) for k in range(10) if luhn(digits + str(k)))


def training_cases(n: int = 360, seed: int = 11):
    """Invented sentences with and without personal data in forms that the fixed patterns miss."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9)))
    hexa = lambda: "".join(rng.choice(list("0123456789abcdef"), 4))
    sep = lambda: pick(" ", "-", ".")

    def entity(kind):
        if kind == "email":
            a, b, c = word() + pick("", num(2), "." + word()), word(), pick("com", "org", "net", "example")
            return pick(f"{a} [at] {b} [dot] {c}", f"{a}(at){b}.{c}", f"{a} at {b} dot {c}", f"{a} @ {b}.{c}", f"{a} [at] {b}.{c}", f"{a} (at) {b} (dot) {c}")
        if kind == "ip":
            o = [str(x) for x in rng.integers(0, 256, 4)]
            return pick("[.]".join(o), " [dot] ".join(o), "(.)".join(o), ":".join(hexa() for _ in range(8)), f"{hexa()}:{hexa()}::{hexa()}")
        if kind == "card":
            d, s = _with_check(pick("4", "5", "6") + num(14)), pick(".", "/", " - ", "_")
            return s.join(d[i : i + 4] for i in range(0, 16, 4))
        s = sep()
        a = str(rng.integers(2, 10)) + num(2)
        return pick(f"({a}) {num(3)}-{num(4)}", f"{a}{s}{num(3)}{s}{num(4)}", f"0044 {num(3)} {num(3)} {num(4)}", f"00{rng.integers(30, 50)} {num(3)} {num(4)} {num(3)}", f"0{num(3)} {num(3)} {num(4)}")

    def other():
        return pick(num(3), num(4), num(16), num(8), f"{num(2)}.{num(2)}", f"20{num(2)}-0{rng.integers(1, 10)}-1{num(1)}", f"{num(3)},{num(3)}", f"dot {num(2)}", f"at {num(3)}", f"{num(4)}-{num(4)}", f"{num(3)} {num(3)}", f"the dot at {word()}", f"{num(4)}/{num(4)}/{num(4)}/{num(3)}1")

    clue = {k: sorted(v) for k, v in _CLUES.items()}
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.integers(1, 4)):
            text += " ".join(word() for _ in range(rng.integers(1, 5))) + " "
            kind = pick(None, None, *KINDS)
            if rng.random() < 0.5:
                text += pick(*clue[kind or "other"]) + pick(" ", ": ", " is ")
            s = entity(kind) if kind else other()
            if kind:
                gold.append((len(text), len(text) + len(s), kind))
            text += s + pick(" ", ". ", ", ")
        tok = _tokens(text)
        starts, ends = {t[1]: i for i, t in enumerate(tok)}, {t[2]: i + 1 for i, t in enumerate(tok)}
        yield text, tok, {(starts[a], ends[b]): k for a, b, k in gold}


@lru_cache(1)
def model() -> SemiMarkov:
    return SemiMarkov().fit(list(training_cases()))


def added_spans(text: str, base: list[tuple[int, int, int]], field: SemiMarkov) -> list[tuple[int, int, int]]:
    """Spans of the best segmentation around triggers that touch no fixed span."""
    windows: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - 80), min(len(text), m.end() + 80)
        if windows and a <= windows[-1][1]:
            windows[-1][1] = b
        else:
            windows.append([a, b])
    out = []
    for a, b in windows:
        least, most = max(0, a - LONGEST), min(len(text), b + LONGEST)
        while a > least and not text[a - 1].isspace():
            a -= 1
        while b < most and not text[b].isspace():
            b += 1
        tokens = _tokens(text, a, b)
        for i in range(0, len(tokens), 400):  # long windows in overlapping parts: an entity is whole in one of them
            part = tokens[max(0, i - 2 * LONGEST) : i + 400]
            out += field.decode(text, part)
    kept, last = [], -1
    for s in clear_of(sorted(set(out)), base):
        if s[0] >= last:
            kept.append(s)
            last = s[2]
    return kept


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row.

    The counts and the hash are of the fixed patterns; spans also holds what the
    field adds. Offsets are code points. A null or empty text has no spans. Texts are read whole, however long; numbers of any length are no address.
    Repeated rows give repeated rows, an empty table an empty one; of spans that overlap, the first stays; other columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        for b in batches:
            out = []
            for t in b["text"]:
                base = base_spans(t)
                more = added_spans(t, base, field.value) if _TRIGGER.search(t) else []
                n = [sum(k == i for _, k, _ in base) for i in range(4)]
                out.append((*n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(sorted([*base, *more])), len(more)))
            pdf = pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            pdf.insert(0, "doc_id", b["doc_id"].array)
            yield pdf

    return map_frames(numbered(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
