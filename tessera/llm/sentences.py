"""Sentence units across languages and scripts (problem 5).

Whether a full stop ends a sentence is decided document-centred: an abbreviation shows itself
where lower case or digits follow its stop, or by never occurring without one; a proper name
shows itself by a capital inside sentences, a sentence opener by a capital at line starts and
after ? and !. Occurrences in the same file come first, counts over the whole corpus are the
fallback, and the words known as abbreviations stand in only where neither says anything. Every
text gets the counts of the words it asks about by joins; nothing is gathered or thresholded. Scripts have their own terminators; Thai, which has none, ends sentences at
spaces between Thai letters. Quotations and brackets hold their inner stops.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import durable, spread

# Places of a word's counts: what follows its stop (lower case or a comma, a digit, a capital, anything else), no stop; as an opener, inside a sentence.
KINDS = {k: i for i, k in enumerate("lduonSM")}
# Abbreviations known without corpus evidence.
KNOWN = frozenset(
    "dr mr mrs ms prof st mt no nr vs vol fig tab approx incl ca bzw vgl usw z.b d.h u.a rd bd cf env p pp art núm aprox sr sra srta ej g г гг табл см др тыс млн млрд руб долл рис стр jan feb mar apr jun jul aug sept sep oct nov dec e.g i.e etc inc ltd co corp u.s a.m p.m s.a n.º क्र डॉ mme mlle".split()
)
# Abbreviations that may well end a sentence.
ENDING = frozenset("etc usw inc ltd co corp a.m p.m".split())
# German words before an ordinal number.
BEFORE_ORDINAL = frozenset("dem der den des die das am zum zur vom im beim bis ab seit und jedem diesem".split())
#: Longest word that is an abbreviation merely by never standing without a stop, and length from which a lower-case word before a stop is no abbreviation.
SHORT_WORD, SURE_WORD = 4, 6
OPEN = {"“": "”", "„": "“”", "«": "»", "(": ")", "（": "）", "「": "」", "『": "』", "[": "]", "【": "】", "《": "》", "‹": "›", "｢": "｣", "〈": "〉"}
CLOSERS = frozenset("”»)）」』]】》›｣〉\"")
_BRACKETS = frozenset("(（[【")
_ODD = regex.compile(r"[\p{Cf}\p{Cc}\p{Zs}！-～︀-️͏--[ \n！？（）：；，]]", regex.V1)
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F) if chr(c) not in "！？（），：；［］"}
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}'’\-]*(?:\.\p{L}[\p{L}\p{M}]*)*")
_MARK = regex.compile(r"[.!?…]+|[。！？।॥｡؟۔]+|(?<=\p{Thai}\p{M}*ๆ?) +(?=\p{L}|[“„«(「『（]|\d+年)|[“”„«»()（）「」『』\[\]【】《》‹›｢｣〈〉\"]")
_LAST = regex.compile(r"(?r)[\p{L}\p{M}\p{N}.'’\-]+")
_ASK = regex.compile(r"(?<![^\s\p{P}])([\p{L}\p{M}\p{N}'’\-][\p{L}\p{M}\p{N}.'’\-]*)\.[”»)）」』\]\"]*(?: [^\p{L}\p{N}\n]*|(?=[^\x00-\xff]))(?!\p{Ll})([\p{L}\p{N}][\p{L}\p{M}\p{N}'’\-]*)", regex.V1)
_FIRST = regex.compile(r"[\p{L}\p{N}]")
_YEAR = regex.compile(r"\s*\d+年")
_GOES_ON = regex.compile(r"\s*[,;:–—]")
_BLANK = regex.compile(r"\s*")
_AFTER = regex.compile(r"[,;:–—]|[.!?。！？।]")
_PAIRED = regex.compile(r"[“”„«»()（）「」『』\[\]【】《》‹›｢｣〈〉\"]")
_NEXT = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}'’\-]*")


def plain(text: str) -> tuple[str, list[int] | None]:
    """Text without invisible characters, spaces made one kind, wide letters narrow; and the place of each character (None: unchanged)."""
    if not _ODD.search(text):
        return text, None
    out, at = [], []
    for i, ch in enumerate(text):
        c = ord(ch)
        if ch == "\n" or ch in "\r\x0b\x0c\x85  ":
            out.append("\n")
        elif c in _WIDE:
            out.append(chr(_WIDE[c]))
        else:
            cat = unicodedata.category(ch)
            if cat == "Zs" or ch == "\t":
                out.append(" ")
            elif cat in ("Cf", "Cc") or 0xFE00 <= c <= 0xFE0F or c == 0x34F:
                continue
            else:
                out.append(ch)
        at.append(i)
    return "".join(out), at


def count_tokens(text: str, into: dict[str, list[int]]) -> None:
    """Adds what one text shows: of lower-case words what follows their stop, or no stop for words short enough to be
    taken for abbreviations by that; of capitalised words (key with ^) whether they open sentences or stand inside."""
    s, _ = plain(text)
    n = len(s)
    prev_end, prev, prev_dot = -9, "", False

    def add(word: str, kind: int) -> None:
        got = into.get(word)
        if got is None:
            got = into[word] = [0] * 7
        got[kind] += 1

    for m in _WORD.finditer(s):
        a, b = m.span()
        w = m.group()
        if w[0].isupper():
            gap = s[max(prev_end, 0) : a]
            if a == 0 or s[a - 1] == "\n" or "\n" in gap:
                add("^" + w, 5)
            elif gap == " " and prev.islower():
                add("^" + w, 6)
            elif gap[:1] in ("?", "!") or (prev_dot and gap == ". " and len(prev) > SURE_WORD and prev.islower()):
                add("^" + w, 5)
        dot = b < n and s[b] == "." and not (b + 1 < n and s[b + 1] == ".")
        if dot:
            f = s[b + 1 : b + 4].lstrip(" ")
            if f and s[b + 1] in " ,;:":
                c = "年" if _YEAR.match(s, b + 1) else f[0]
                add(w.lower(), 0 if c.islower() or c in ",;:" else 1 if c.isdigit() else 2 if c.isupper() else 3)
            elif not f or f[0] == "\n":
                add(w.lower(), 3)
        elif len(w) <= SHORT_WORD:
            add(w.lower(), 4)
        prev_end, prev, prev_dot = b, w, dot


def asked(text: str) -> set[str]:
    """Keys of the counts that cutting a text may ask about: words before stops, and what follows them as openers."""
    out = set()
    for m in _ASK.finditer(plain(text)[0]):
        w, f = m.groups()
        w = w.rstrip(".").lower()
        if "." not in w and len(w) > 1 and not w.isdigit():
            out.add(w)
            if f[0].isupper():
                out.add("^" + f)
    return out


_NONE = (0,) * 7


class Evidence:
    """Counts of the words of a file (``own``) in front of those of the corpus, by key; each seven numbers as in ``KINDS``."""

    def __init__(self, own: dict | None = None, corpus: dict | None = None):
        self.own, self.corpus = own or {}, corpus or {}

    def of(self, kind: str, word: str) -> int:
        """Occurrences; those of the file weigh four times, but a digit after a long word there may be the very case in question."""
        k = KINDS[kind]
        own = 0 if kind == "d" and len(word) > 4 else self.own.get(word, _NONE)[k]
        return 4 * own + self.corpus.get(word, _NONE)[k]

    def opener(self, word: str) -> bool | None:
        s, m = self.of("S", "^" + word), self.of("M", "^" + word)
        return None if s + m == 0 else s >= m and s > 0

    def abbreviation(self, word: str) -> bool:
        w = word.rstrip(".").lower()
        if not w or "." in w or len(w) == 1:
            return True
        follow = self.of("l", w) + self.of("d", w)
        rest = self.of("u", w) + self.of("o", w)
        if self.of("o", w) >= max(2, 0.01 * rest) and follow <= 0.02 * rest:  # ends lines and never goes on: an ordinary last word
            return False
        if follow >= 3 and follow >= 0.25 * (follow + rest):
            return True
        if not follow and self.of("n", w) > max(3, rest):  # mostly without a stop
            return False
        if w in KNOWN:
            return True
        return len(w) <= SHORT_WORD and w.isalpha() and follow + rest > 0 and self.of("n", w) == 0

    def continues(self, word: str) -> bool:
        w = word.rstrip(".").lower()
        follow = self.of("l", w) + self.of("d", w)
        return follow >= 0.3 * (follow + self.of("u", w) + self.of("o", w) + 1e-9) or (w in KNOWN and not self.of("u", w) + self.of("o", w))


def _pairs(s: str) -> dict[int, int]:
    """Opening place -> closing place of the quotations and brackets of a line; lone marks are left out."""
    stack: list[tuple[str, int]] = []
    out: dict[int, int] = {}
    for m in _PAIRED.finditer(s):
        ch, i = m.group(), m.start()
        if ch == '"':
            if stack and stack[-1][0] == '"':
                out[stack.pop()[1]] = i
            else:
                stack.append((ch, i))
        elif stack and any(ch in OPEN.get(x, "") for x, _ in stack):
            while ch not in OPEN.get(stack[-1][0], ""):
                stack.pop()
            out[stack.pop()[1]] = i
        elif ch in OPEN:
            stack.append((ch, i))
    return out


def _ends(s: str, mark: str, a: int, e: int, ev: Evidence, stop: int) -> bool:
    """Does the stop s[a:e] end a sentence, given that it stands outside quotations and brackets? ``stop`` is where the line's text ends."""
    if e >= stop:
        return True
    if mark[0] in "。！？।॥｡؟۔":
        return True
    nxt = _FIRST.search(s, e)
    f = nxt.group() if nxt else ""
    if not nxt:
        return True
    gap = s[e : nxt.start()]
    wide = not f.isdigit() and not f.isupper() and not f.islower() or bool(_YEAR.match(s, e))
    if not gap[:1].isspace() and not (gap[:1] in OPEN or (gap == "" and wide)):
        return False
    if _GOES_ON.match(s, e):
        return False
    if mark[0] in "!?":
        return not f.islower()
    if f.islower():
        return False
    if len(mark) > 1 or mark[0] == "…":
        return True
    w = _LAST.match(s, 0, a)
    word = w.group() if w else ""
    if not word:
        return True
    follower = m.group() if (m := _NEXT.match(s, nxt.start())) else ""
    if word.replace(".", "").replace(",", "").isdigit():
        if f.isdigit() and not wide:
            return len(word) >= 4
        if len(word) > 2:
            return True
        at = w.start()
        while at and s[at - 1] == " ":
            at -= 1
        if at and s[at - 1] == ".":
            return True
        last = _LAST.match(s, 0, at)
        return at > 0 and not (last and last.group() in BEFORE_ORDINAL)
    if not ev.abbreviation(word):
        return True
    if f.isdigit() and not wide:
        return False
    if wide or not f:
        return not ev.continues(word)
    opener = ev.opener(follower)
    if opener is not None:
        return opener
    low = word.rstrip(".").lower()
    return low in ENDING or not (low in KNOWN or "." in low or len(low) == 1 or ev.continues(word))


def split_line(s: str, ev: Evidence) -> list[tuple[int, int]]:
    """(start, end) of the units of one line, end exclusive, without outer blanks."""
    pairs = _pairs(s)
    closing = {c: o for o, c in pairs.items()}
    cuts: list[int] = []
    stop = len(s.rstrip())
    start, hold, inner = 0, -1, False  # hold: closing place of the outermost open pair; inner: a stop right before it
    i = 0

    def first() -> int:
        k = start
        while k < len(s) and s[k] == " ":
            k += 1
        return k

    def cut(at: int) -> None:
        nonlocal start
        if s[start:at].strip():
            cuts.append(at)
            start = at

    while m := _MARK.search(s, i):
        a, e = m.span()
        t = m.group()
        i = e
        if hold >= 0:
            if a == hold:
                o = closing[a]
                hold = -1
                if not inner:
                    continue
                inner = False
                on = _BLANK.match(s, e).end()
                lead = s[on : on + 1]
                if e >= stop:
                    cut(e)
                elif s[o] in _BRACKETS:
                    if o == first():
                        cut(e)
                elif _AFTER.match(lead) or lead.islower():
                    continue
                elif o == first():
                    cased = lead.isupper() or lead in OPEN or lead == '"' or lead in "¿¡"
                    if cased:
                        cut(e)
                else:
                    before = s[max(0, o - 40) : o].rstrip(" ")[-1:]
                    if before in ":：,，、" or lead.isupper() or lead in OPEN:
                        cut(e)
            elif t[0] in ".!?…。！？।॥｡؟۔":
                inner = _BLANK.match(s, e, hold).end() == hold
            continue
        if t[0] == " ":
            cut(a)
            continue
        if a in pairs:
            hold, inner = pairs[a], False
            continue
        if t[0] in ".!?…。！？।॥｡؟۔":
            while e < len(s) and s[e] in CLOSERS and e not in pairs:
                e += 1
            i = e
            if _ends(s, t, a, e, ev, stop):
                cut(e)
    cut(len(s))
    out, lo = [], 0
    for hi in cuts:
        x, y = lo, hi
        while x < y and s[x].isspace():
            x += 1
        while y > x and s[y - 1].isspace():
            y -= 1
        if y > x:
            out.append((x, y))
        lo = hi
    return out


def split_units(text: str | None, evidence: Evidence | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit in the stored text, from 0, end exclusive.

    Null, empty and blank texts have none. A line end ends a unit. Without evidence the text
    speaks for itself.
    """
    if not text or not text.strip():
        return []
    ev = evidence
    if ev is None:
        ev = Evidence()
        if "." in text:
            count_tokens(text, ev.own)
    s, at = plain(text)
    out = []
    lo = 0
    for line in s.split("\n"):
        for a, b in split_line(line, ev) if line.strip() else ():
            a, b = a + lo, b + lo
            out.append((a, b) if at is None else (at[a], at[b - 1] + 1))
        lo += len(line) + 1
    return out


def file_counts(texts: DataFrame) -> DataFrame:
    """(doc, word, c) with the seven counts of every word of every file of rows (doc, text); counted in each batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, words, rows = [], [], []
            for doc, group in pdf.groupby("doc", sort=False, dropna=False):
                c: dict[str, list[int]] = {}
                for t in group.text:
                    count_tokens(t, c)
                docs += [doc] * len(c)
                words += c
                rows += c.values()
            cols = np.array(rows, np.int64).reshape(-1, 7)
            yield pd.DataFrame({"doc": pd.Series(docs, dtype=object), "word": pd.Series(words, dtype=object)} | {k: cols[:, i] for k, i in _COLS.items()})

    part = spread(texts.where("text is not null")).mapInPandas(run, "doc string, word string, " + ", ".join(f"{k} long" for k in _COLS))
    return part.groupBy("doc", "word").agg(*[F.sum(k).alias(k) for k in _COLS])


_COLS = {f"c{i}": i for i in range(7)}


def with_evidence(texts: DataFrame, some: DataFrame) -> DataFrame:
    """Rows (id, doc, text, ...) of ``some`` with ``facts``: for every word they ask about its counts in their file and in all of ``texts`` (doc, text).

    The counts of a file are joined to what its texts ask, so a file of any size is never held by
    one task; a fact list is as long as its own text makes it. A null doc is a file of its own.
    """
    own = durable(file_counts(texts), "words")
    whole = own.groupBy("word").agg(*[F.sum(k).alias("a" + k) for k in _COLS])
    rows = durable(some.withColumn("row", F.xxhash64("id", "doc", "text")), "texts")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(r, d, w) for r, d, t in zip(pdf.row, pdf.doc, pdf.text) for w in asked(t)]
            yield pd.DataFrame(out, columns=["row", "doc", "word"])

    asks = durable(rows.select("row", "doc", "text").mapInPandas(ask, "row long, doc string, word string"), "asks")
    needed = asks.select("word").distinct()
    whole = whole.join(needed, "word", "left_semi")
    pack = lambda p: F.array(*[F.coalesce(p + k, F.lit(0)) for k in _COLS])
    facts = asks.withColumn("d", F.coalesce("doc", F.lit(""))).join(own.withColumn("d", F.coalesce("doc", F.lit(""))).drop("doc"), ["d", "word"], "left").join(whole, "word", "left")
    facts = facts.groupBy("row").agg(F.collect_list(F.struct("word", pack("").alias("own"), pack("a").alias("all"))).alias("facts"))
    return rows.join(facts, "row", "left")


def evidence_of(facts) -> Evidence:
    """Evidence from a fact list of :func:`with_evidence`."""
    facts = facts if facts is not None else []
    return Evidence({f["word"]: f["own"] for f in facts}, {f["word"]: f["all"] for f in facts})


def units(df: DataFrame, id_col: str, text_col: str = "text", doc_col: str | None = None) -> DataFrame:
    """(id, unit_no, start_pos, end_pos, unit) of every sentence unit, positions from 1 and inclusive.

    ``doc_col`` names the file of a row; without it every row is a file of its own. Repeated
    (id, text) rows count once. Rows with a null id or without text give no unit.
    """
    doc = F.col(doc_col).cast("string") if doc_col else F.col(id_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), doc.alias("doc"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    ready = with_evidence(rows.select("doc", "text"), rows.distinct())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, no, lo, hi, cut = [], [], [], [], []
            for i, t, facts in zip(pdf.id, pdf.text, pdf.facts):
                for k, (a, b) in enumerate(split_units(t, evidence_of(facts))):
                    ids.append(i)
                    no.append(k)
                    lo.append(a + 1)
                    hi.append(b)
                    cut.append(t[a:b])
            yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "unit_no": no, "start_pos": lo, "end_pos": hi, "unit": cut})

    kind = dict(rows.dtypes)["id"]
    return ready.select("id", "text", "facts").mapInPandas(run, f"id {kind}, unit_no int, start_pos long, end_pos long, unit string")
