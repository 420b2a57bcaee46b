"""Personal data in free text found by a conditional random field and replaced by placeholders (problem 10).

Tokens are runs of letters, runs of digits, single marks and single ideographs, cut in numpy for
a whole batch of texts; their features are word, shape, affixes, script and the space before
them. The field is trained on the small labelled table of ``pii_labels`` and decodes all lines
of a batch side by side by Viterbi. What it finds is then checked exactly: an email, phone or
identity number must have the form of one and takes its bounds from that form, names lose titles
and possessive endings, and an address goes on over a line end.
"""

from __future__ import annotations

import functools
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.crf import OFFSETS, REACH, Crf
from tessera.llm.pii_labels import SURNAMES, labelled
from tessera.llm.sentences import _ODD as ODD
from tessera.llm.sentences import plain
from tessera.session import spread

KINDS = ["person", "email", "phone", "id_number", "address"]
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
_SPELT = r"(?:\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
# an @, at in brackets or capitals, or a plain at if the dots are spelt too
_LOCAL = r"(?<![\p{L}\p{N}])[A-Za-z0-9](?:[A-Za-z0-9+_-]|\.(?=[A-Za-z0-9]))*"
_END = r"[A-Za-z]{2,}(?![\p{Latin}\p{N}])"
EMAIL = regex.compile(rf"{_LOCAL}(?:\s?(?:@|[\[(]at[\])]|(?-i:\bAT\b))\s?[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}{_END}|\sat\s[A-Za-z0-9-]+(?:{_SPELT}[A-Za-z0-9-]+)*{_SPELT}{_END})", regex.I)
PHONE = regex.compile(r"(?<![\p{L}\p{N}.,-])(?:\+\d{1,3}(?:[ .-]\d(?=[ .-]\d\d))?|\(\+?\d{1,4}\)|（\d{1,4}）|\d{2,5})(?:[ ./-]?(?:\(\d{1,4}\)|\d{2,11})){0,6}(?!\d)|(?<=[\p{Han}\p{Hiragana}])(?:\+\d{1,3}(?:[ .-]\d(?=[ .-]\d\d))?|\(\d{1,4}\)|（\d{1,4}）|\d{2,5})(?:[ ./-]?(?:\(\d{1,4}\)|\d{2,11})){0,6}(?!\d)")
ID = regex.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{1,2}\d{6,8}[(（][0-9A-Z][)）]|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z](?![A-Za-z0-9])|[A-Z]\d{7,9}(?!\d)|\d{8}-?[A-Z](?![A-Za-z0-9])|\d{17}[\dX](?![\dA-Za-z])|\d{3}[- ]\d{2}[- ]\d{4}(?!\d)|[A-Z]{2}\d{6,9}(?!\d))", regex.I)
# Titles that are no part of a name.
PARTICLES = frozenset("de da do dos das del della di du des le la van von der den ten ter zu zum al el bin ibn ben d l y e".split())
_LOWER = regex.compile(r"(\p{Ll}[\p{L}\p{M}]*)[\s’'-]+")
TITLES = frozenset("mr mrs ms miss dr prof sir herr frau m mme mlle monsieur madame don doña sr sra srta señor señora dna attention".split())


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: 0 blank, 1 letter or mark, 2 digit, 3 a token by itself; 4 is added to 3 for signs."""
    out = np.full(0x110000, 4, np.uint8)
    for c in range(0x30000):
        ch = chr(c)
        k = unicodedata.category(ch)
        out[c] = 0 if ch.isspace() or k in ("Zs", "Cs") else 1 if k[0] in "LM" else 2 if k == "Nd" else 4
    for lo, hi in ((0xE00, 0xE80), (0x2E80, 0x2FE0), (0x3005, 0x3008), (0x3021, 0x302A), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x30000)):
        part = out[lo:hi]
        part[part == 1] = 3
    out[0xE50:0xE5A] = 2
    out[0x20000:0x30000] = 3
    return out


@functools.lru_cache(maxsize=1)
def _odd() -> np.ndarray:
    """Code points that :func:`plain` changes."""
    out = np.zeros(0x110000, bool)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out[at[[m.start() for m in ODD.finditer(text)]]] = True
    return out


_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


class Tokens:
    """Tokens of a batch of texts: start, end (in the joined text), text number, whether a line begins, and a key of the type."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(["", *texts, ""])
        self.codes = codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.base = np.cumsum([1] + [len(t) + 1 for t in texts])
        kind = _classes()[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] >= 3)
        at = np.flatnonzero(cut)
        stop = np.append(at[1:], len(codes))
        ink = kind[at] != 0
        self.start, self.end, kind = at[ink], stop[ink], kind[at[ink]]
        lines = np.cumsum(codes == 10)
        before = np.append(0, self.end[:-1])
        gap = np.where(lines[self.start] > lines[np.maximum(before - 1, 0)], 2, (self.start > before).astype(np.int64))
        if len(gap):
            gap[0] = 2
        self.newline = gap == 2
        self.text = np.searchsorted(self.base, self.start, side="right") - 1
        total = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(codes))[:-1], dtype=np.uint64)])
        h = (total[self.end] - total[self.start]) * _powers(_Q, len(codes))[self.start]
        digit = kind == 2
        size = np.minimum(self.end - self.start, 19)
        first = np.where(size > 1, codes[self.start], 0)
        h = np.where(digit, (size * 0x200000 + first).astype(np.uint64) * _P, h)
        h = (h ^ (h >> np.uint64(31))) * _P
        self.key = (h & ~np.uint64(7)) | gap.astype(np.uint64) | (digit.astype(np.uint64) << np.uint64(2))

    def word(self, i: int) -> str:
        """The type of a token as text: the space before it marked, digits folded to their number and first digit."""
        w = self.codes[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")
        gap = ("", " ", "\n")[int(self.key[i] & np.uint64(3))]
        return gap + (f"{min(len(w), 19)}#" + (w[0] if len(w) > 1 else "") if self.key[i] & np.uint64(4) else w)


@functools.lru_cache(maxsize=200_000)
def features(kind: str) -> tuple[str, ...]:
    """Features of a token type."""
    gap, w = (kind[0], kind[1:]) if kind[0] in " \n" else ("", kind)
    if "#" in w[1:3] and w[0].isdigit() and not w[0].isalpha():
        n = w.split("#")
        n[1] = str(unicodedata.digit(n[1], 0)) if n[1] else ""
        return ("b", "g" + gap, "d" + n[0], "D", "f" + n[1] + n[0], "gd" + gap + n[0])
    low = w.lower()
    shape = "".join("X" if c.isupper() else "x" if c.islower() else "h" if c.isalpha() else c for c in w[:6])
    short = regex.sub(r"(.)\1+", r"\1", shape)
    case = "U" if w.isupper() and len(w) > 1 else "I" if len(w) == 1 and w.isupper() else "T" if w[0].isupper() else "l" if w.islower() else "o"
    out = ["b", "g" + gap, "w" + low, "s" + short, "c" + case, "gc" + gap + case, "l" + str(min(len(w), 8))]
    if w.isalpha() and len(w) > 2:
        out += ["p" + low[:3], "e" + low[-3:], "e2" + low[-2:], "W" + w]
    if not w.isalnum():
        out.append("gp" + gap + w)
    if w in SURNAMES:
        out.append("surname")
    return tuple(out)


def label_names() -> list[str]:
    return ["O"] + [p + k for k in KINDS for p in ("B-", "I-")]


def _bans() -> tuple[np.ndarray, np.ndarray]:
    names = label_names()
    ban = np.zeros((len(names), len(names)), bool)
    for j, b in enumerate(names):
        if b[0] == "I":
            for i, a in enumerate(names):
                ban[i, j] = a[1:] != b[1:]
    return ban, np.array([x[0] == "I" for x in names])


def train(examples: int = 7000, epochs: int = 5) -> Crf:
    """The field fitted to the labelled table; the same for the same arguments."""
    crf = Crf(len(label_names()), *_bans())
    table = labelled(examples)
    toks = Tokens([plain(t)[0] for t, _ in table])
    key, first, kind, times = np.unique(toks.key, return_index=True, return_inverse=True, return_counts=True)
    feats = [list(features(toks.word(i))) for i in first]
    crf.learn_features(feats, times)
    docs = []
    for n, (_, spans) in enumerate(table):
        lo, hi = np.searchsorted(toks.text, [n, n + 1])
        y = np.zeros(hi - lo, np.int64)
        a, b = toks.start[lo:hi] - toks.base[n], toks.end[lo:hi] - toks.base[n]
        for x, z, label in spans:
            inside = np.flatnonzero((a < z) & (b > x))
            y[inside] = 2 + 2 * KINDS.index(label)
            y[inside[:1]] -= 1
            more = inside[1:][toks.newline[lo:hi][inside[1:]]]  # the part after a line end begins anew
            y[more] = 1 + 2 * KINDS.index(label)
        if hi > lo:
            docs.append((kind[lo:hi], y, np.flatnonzero(toks.newline[lo:hi])))
    crf.fit(crf.rows(feats), docs, epochs=epochs)
    crf.w = crf.w.astype(np.float32)
    return crf


def _trim_person(s: str, a: int, b: int) -> tuple[int, int] | None:
    while True:
        while a < b and not s[a].isalpha():
            a += 1
        m = regex.compile(r"(\p{L}+)\.?\s+").match(s, a, b)
        if m and m.group(1).lower() in TITLES and not (len(m.group(1)) == 1 and m.group(1) != "M"):
            if len(m.group(1)) == 1 and "." in m.group() and not regex.match(r"(?:L’assuré|assuré),?\s*$", s[max(0, a - 12) : a]):
                break
            a = m.end()
            continue
        break
    while (m := _LOWER.match(s, a, b)) and m.group(1) not in PARTICLES:  # a name begins with a capital or a particle
        a = m.end()
    t = regex.search(r"(?:’s|'s)?[\s,;:.)\]}–—-]*$", s[a:b])
    if t:
        b = a + t.start()
    if b < a + 2 or not any(c.isupper() or regex.match(r"\p{Han}", c) for c in s[a:b]):
        return None
    return a, b


class _Forms:
    """Matches of a pattern in the lines of one text, each line searched once."""

    def __init__(self, s: str):
        self.s = s
        self.seen: dict[tuple[int, int], tuple[list[int], list[tuple[int, int]]]] = {}

    def at(self, rx: regex.Pattern, a: int, b: int) -> tuple[int, int] | None:
        """The match that shares most with a place."""
        lo = self.s.rfind("\n", 0, a) + 1
        if (id(rx), lo) not in self.seen:
            hi = self.s.find("\n", lo)
            hits = [m.span() for m in rx.finditer(self.s, lo, len(self.s) if hi < 0 else hi)]
            self.seen[id(rx), lo] = [y for _, y in hits], hits
        ends, hits = self.seen[id(rx), lo]
        best, over = None, 0
        for i in range(bisect_right(ends, a), len(hits)):
            x, y = hits[i]
            if x >= b:
                break
            if min(b, y) - max(a, x) > over:
                best, over = hits[i], min(b, y) - max(a, x)
        return best


def check(s: str, a: int, b: int, kind: str, forms: _Forms) -> tuple[int, int] | None:
    """The exact bounds of what the field found, or None where it has not the form of its kind."""
    if kind == "email":
        return forms.at(EMAIL, a, b)
    if kind == "id_number":
        return forms.at(ID, a, b)
    if kind == "phone":
        hit = forms.at(PHONE, a, b)
        if hit and 7 <= sum(c.isdigit() for c in s[hit[0] : hit[1]]) <= 15:
            return hit
        return None
    if kind == "person":
        return _trim_person(s, a, b)
    while a < b and not s[a].isalnum():
        a += 1
    while b > a and not s[b - 1].isalnum():
        b -= 1
    return (a, b) if b - a > 5 and any(c.isdigit() for c in s[a:b]) else None


#: Types whose scores a worker keeps between batches; beyond that it starts anew.
KEPT_TYPES = 150_000


class _Scored:
    """Scores of the types seen by a worker."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.table = np.zeros((len(OFFSETS), 1, self.crf.n), np.float32)  # row 0 is padding

    def rows(self, toks: Tokens) -> np.ndarray:
        """Row of every token in ``table``."""
        key, first, inverse = np.unique(toks.key, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_TYPES:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            new = self.crf.scores(self.crf.rows([list(features(toks.word(i))) for i in first[fresh]]))
            place = np.arange(len(fresh)) + self.table.shape[1]
            self.table = np.concatenate([self.table, new], axis=1)
            keys, places = np.concatenate([self.keys, key[fresh]]), np.concatenate([self.place, place])
            order = np.argsort(keys)
            self.keys, self.place = keys[order], places[order]
            at = np.searchsorted(self.keys, key)
        return self.place[at][inverse]


def find(texts: list[str], crf: Crf) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the personal data of each text, from 0, end exclusive."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not any(texts):
        return out
    scored = crf.__dict__.get("scored") or crf.__dict__.setdefault("scored", _Scored(crf))
    whole = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    odd = np.unique(np.searchsorted(ends, np.flatnonzero(_odd()[whole]), side="right"))
    place: dict[int, list[int] | None] = {}
    texts = list(texts)
    for i in odd.tolist():
        texts[i], place[i] = plain(texts[i])
    toks = Tokens(texts)
    rows = scored.rows(toks)
    if not len(rows):
        return out
    # three tokens of padding stand between texts, so that no context crosses them
    flat = np.zeros(len(rows) + REACH * (len(texts) + 2), np.int64)
    at = np.arange(len(rows)) + REACH * (toks.text + 1)
    flat[at] = rows
    em = crf.emissions(scored.table, flat)[at - REACH]
    start = np.flatnonzero(toks.newline)
    y = crf.viterbi(em, start, np.diff(np.append(start, len(rows))))
    begin = np.flatnonzero(y % 2 == 1)
    cut = np.append(np.flatnonzero((y % 2 == 1) | (y == 0) | toks.newline), len(y))
    stop = cut[np.searchsorted(cut, begin, side="right")]
    names, rank = label_names(), {"email": 0, "id_number": 1, "phone": 2, "address": 3, "person": 4}
    raw: dict[int, list[tuple[int, int, str]]] = {}
    for b, e in zip(begin.tolist(), stop.tolist()):
        i = int(toks.text[b])
        base = int(toks.base[i])
        raw.setdefault(i, []).append((int(toks.start[b]) - base, int(toks.end[e - 1]) - base, names[y[b]][2:]))
    for i, spans in raw.items():
        s, forms, found = texts[i], _Forms(texts[i]), []
        for a, b, kind in spans:
            if kind == "address" and found and found[-1][2] == "address" and "\n" in s[found[-1][1] : a] and not s[found[-1][1] : a].strip(" ,\n"):
                a = found.pop()[0]
            hit = check(s, a, b, kind, forms)
            if hit:
                found.append((*hit, kind))
        ends_, kept = [], []
        for x in sorted(set(found), key=lambda x: (rank[x[2]], x[0])):
            k = bisect_right(ends_, x[0])
            if k == len(kept) or kept[k][0] >= x[1]:
                kept.insert(k, x)
                ends_.insert(k, x[1])
        at_ = place.get(i)
        out[i] = [(a, b, c) if at_ is None else (at_[a], at_[b - 1] + 1, c) for a, b, c in kept]
    return out


@functools.lru_cache(maxsize=1)
def trained() -> Crf:
    return train()


def detect(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, kind, start_pos, end_pos) of every piece of personal data, positions from 1 and inclusive.

    Null, empty and blank texts have none; repeated rows give their pieces again.
    """
    return _apply(df, id_col, text_col, False)


def redact(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, text) with every piece replaced by a placeholder such as [EMAIL]; null stays null, the rest of the text is untouched."""
    return _apply(df, id_col, text_col, True)


def _apply(df: DataFrame, id_col: str, text_col: str, replace: bool) -> DataFrame:
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(trained())
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        for pdf in batches:
            lo = 0
            size = pdf.text.str.len().fillna(0).cumsum().to_numpy()
            while lo < len(pdf):
                done = size[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(size, done + 1_000_000, side="right")))
                part = pdf.iloc[lo:hi]
                lo = hi
                texts = [t or "" for t in part.text]
                hits = find(texts, crf)
                if replace:
                    new = []
                    for t, h in zip(part.text, hits):
                        if not t:
                            new.append(t)
                            continue
                        cut, at = [], 0
                        for a, b, c in h:
                            cut += [t[at:a], f"[{c.upper()}]"]
                            at = b
                        new.append("".join([*cut, t[at:]]))
                    yield pd.DataFrame({"id": part.id, "text": pd.Series(new, index=part.index, dtype=object)})
                else:
                    flat = [(i, c, a + 1, b) for i, h in zip(part.id, hits) for a, b, c in h]
                    yield pd.DataFrame(flat, columns=["id", "kind", "start_pos", "end_pos"])

    schema = f"id {kind}, text string" if replace else f"id {kind}, kind string, start_pos long, end_pos long"
    return spread(rows).mapInPandas(run, schema)
