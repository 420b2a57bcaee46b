"""Text of scanned pages repaired into continuous paragraphs (problem 2).

Running headers and page numbers are taken out, the lines become one stream, and the stream is
decoded by a shortest path over its words: a word may stand as it is, be a misreading of a known
word, be joined with the next across a line end (with or without a hyphen) or across a blank
inside a line, or be two known words run together. Two words are taken apart only if clean files
have them side by side, else every compound of two known words would be; halves parted by a blank
are put together only if one of them is unknown and the whole is known as it stands. What is
known comes from the counts of all words of files that are not scans; the words of the scans and
their joins are looked up in these counts by joins on distinct strings. Misreadings are found by
a join too: confusable characters are spelt alike in the key of a word, so a misread word and the
right one have the same key, and only words of equal key are aligned. Neither table is ever
gathered or broadcast. Paragraph boundaries are then chosen by dynamic programming over the lines.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sentences import plain
from tessera.session import durable, spread, width

# What is read in place of what, as a reader of print confuses them.
CONFUSED = [("c", "e"), ("l", "i"), ("f", "t"), ("@", "a"), ("ri", "n"), ("5", "s"), ("0", "o"), ("1", "l"), ("1", "i"), ("9", "g"), ("ii", "u"), ("ii", "ü"), ("rn", "m"), ("li", "h"), ("6", "é"), ("6", "b"), ("vv", "w"), ("cl", "d"), ("8", "b"), ("i", "l"), ("rl", "n"), ("|", "l"), ("$", "s"), ("€", "e"), ("q", "g"), ("u", "v"), ("tl", "d"), ("с", "е"), ("з", "э"), ("ш", "щ")]
_DIGITS = str.maketrans({"O": "0", "o": "0", "Z": "2", "z": "2", "S": "5", "s": "5", "l": "1", "I": "1", "|": "1", "B": "8", "g": "9", "b": "6"})
MARKS = "-‐‑¬\xad"
WORD = regex.compile(r"[[\p{L}\p{M}\p{N}@|$€]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]]+(?:['’][\p{L}\p{M}@0-9]+)*", regex.V1)
_LINE_END = regex.compile(rf"([[\p{{L}}\p{{M}}\p{{N}}@|$€]--[\p{{Han}}]]+)([{MARKS}]?)$", regex.V1)
_COMPOUND = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:-[\p{L}\p{M}\p{N}]+)+")
_NUMERAL = regex.compile(r"(?<![\p{L}\p{N}.,])[\dOZSBlI|]+(?:[.,][\dOZSBlI|]+)*(?![\p{L}\p{N}])")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
LEAST = 2
_rx = functools.lru_cache(maxsize=None)(regex.compile)
#: Price of an unknown word, of a misreading and of each confusion in it: one with six confusions or more costs more than an unknown word.
UNKNOWN, MISREAD, CONFUSION = 6.0, 2.5, 0.6
#: Longest line that can be a running header.
HEADER_WIDTH = 90
TORN = 4.5  # price of two words run together, or of one word parted by a blank: above a word with one confusion beside a known one, below an unknown word


def fold(word: str) -> str:
    """The form words are counted under: lower case, digits as 0."""
    return _rx(r"\d").sub("0", word.lower())


def _spellings() -> dict[str, str]:
    """What every confusable character is spelt as in a key; both sides of every pair of ``CONFUSED`` come out alike.

    Single characters that stand for each other share a letter; a character that is read as two
    is spelt as these two. As cl and tl are both read for d, c and t share a letter as well.
    """
    same = [[r, w] for w, r in CONFUSED if len(w) == len(r) == 1] + [["c", "t"]]
    group: dict[str, str] = {}

    def find(c: str) -> str:
        while group.get(c, c) != c:
            c = group[c]
        return c

    for x, y in same:
        x, y = sorted((find(x), find(y)))
        group[y] = x
    long = {find(r): w for w, r in CONFUSED if len(w) == 2}

    def spell(c: str) -> str:
        c = find(c)
        return "".join(map(spell, long[c])) if c in long else c

    return {c: spell(c) for w, r in CONFUSED for c in w + r}


_SPELT = str.maketrans(_spellings())
_BY_RIGHT: dict[str, list[str]] = {}
for _wrong, _right in CONFUSED:
    _BY_RIGHT.setdefault(_right, []).append(_wrong)
_SIGNS = frozenset("@|$€")


def key(word: str) -> str:
    """The same for a word and all its misreadings."""
    return word.translate(_SPELT)


def changes(word: str, right: str) -> int | None:
    """Least number of confusions by which ``right`` was read as ``word``, or None; digits and signs in words must all be confusions."""
    now = {0: 0}  # places in ``word`` -> confusions so far
    for ch in right:
        nxt: dict[int, int] = {}
        for i, k in now.items():
            if i < len(word) and word[i] == ch and not (ch.isdigit() or ch in _SIGNS) and nxt.get(i + 1, 99) > k:
                nxt[i + 1] = k
            for wrong in _BY_RIGHT.get(ch, ()):
                if word.startswith(wrong, i) and nxt.get(i + len(wrong), 99) > k + 1:
                    nxt[i + len(wrong)] = k + 1
        now = nxt
        if not now:
            return None
    return now.get(len(word))


_DIGIT = regex.compile(r"\d")
_SIGN = regex.compile(r"[\d@|$€]")
_TAIL = regex.compile(WORD.pattern + "$", regex.V1)
_HEAD = WORD


def halves(word: str) -> list[str]:
    """All ways to take a word of letters apart, with a blank between the halves."""
    return [f"{word[:k]} {word[k:]}" for k in range(1, len(word))] if word.isalpha() else []


def _side_by_side(line: str) -> Iterator[tuple[str, str]]:
    """Words of letters with nothing but blanks between them."""
    last = None
    for m in WORD.finditer(line):
        if last and m.group().isalpha() and last.group().isalpha() and line[last.end() : m.start()].isspace():
            yield last.group(), m.group()
        last = m


def _torn(a: str, b: str) -> bool:
    """Can two words on a line be one that a blank parts, by their case?"""
    return not b[0].isupper() or a.isupper() and b.isupper()


def page_of(locator: str | None) -> int | None:
    m = _rx(r"(?:page=|;p|\bp\.? ?)(\d+)").search(locator or "")
    return int(m.group(1)) if m else None


def _roman(s: str) -> int | None:
    if not s or any(c not in _ROMAN for c in s):
        return None
    v = [_ROMAN[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


@functools.lru_cache(maxsize=20_000)
def _letters(s: str) -> str:
    """Letters of a line without its period, misread letters folded."""
    s = _rx(r"\b[12][\dOo]\d\d(?:[HQ]\d)?\b").sub(" ", s).replace("5", "s").replace("1", "l").replace("0", "o").replace("8", "b").replace("@", "a")
    return _rx(r"[^\p{L}]").sub("", s).lower().translate(str.maketrans("cf", "et"))


def page_number(line: str, page: int | None, last: int | None = None) -> bool:
    """Is the whole line the number of its page, bare or dressed ('Page 3 of 9', '- 3 -', 'p. 3', 'iii')?"""
    s = line.strip()
    m = _rx(r"(?:[-–—\[(]\s*)?(?:(?:page|pag[ec]|seite|página|p[áa]g\.?|стр\.?|p\.|s\.|第)\s*)?(\d{1,4})(?:\s*(?:/|of|von|de|sur|из|\|)\s*\d{1,4}|\s*[|]\s*\p{L}+|\s*[-–—\])]|\.|\s*页|\s*ページ)?", regex.I).fullmatch(s)
    if m:
        return page is None and len(s) > len(m.group(1)) or m.group(1) == str(page)
    m = _rx(r"(?:[-–—\[(]\s*)?([ivxlc]{1,7})(?:\s*[-–—\])]|\.)?").fullmatch(s)
    return bool(m) and page is not None and _roman(m.group(1)) == page


def _near(a: str, b: str) -> bool:
    """Equal up to one edit in six letters."""
    if a == b:
        return True
    most = max(1, len(b) // 6)
    if abs(len(a) - len(b)) > most or not a:
        return False
    have = Counter(a)
    have.subtract(b)
    if sum(map(abs, have.values())) > 2 * most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


def header(line: str, title: str, doc_id: str, page: int | None, repeated: frozenset[str]) -> tuple[bool, bool]:
    """(is the running header of the file, has the number of the page beside it)."""
    s = line.strip()
    if not s or len(s) > HEADER_WIDTH or _rx(r"[.!?;]$").search(_rx(r"\bp\. ?\d+$").sub("", s)):
        return False, False
    number = False
    m = _rx(r"^(\d{1,4})(?:\s{2,}|\s*\|\s*|\s+(?=\p{Lu}))").search(s) or _rx(r"(?:\s{2,}|\s*\|\s*|,\s*p\. ?|,\s*S\. ?|\s+[-–]\s+)(\d{1,4})$").search(s)
    body = s
    if m and (page is None or m.group(1) == str(page)):
        body = s[: m.start()] + s[m.end() :]
        number = True
    z = _letters(body)
    if len(z) < 4:
        return False, False
    if z in repeated:
        return True, number
    name = _letters(title.split(" ")[0]) if title else ""
    whole = _letters(title)
    if whole and (_near(z, whole) or _near(z[-len(whole) :], whole)):
        return True, number
    spaced = bool(_rx(r"(?:\p{Lu}\s){3,}\s*\d{4}(?:[HQ]\d)?").fullmatch(body.strip()))
    if spaced:
        return True, number
    parts = doc_id.rsplit(".", 1)[0].split("_")
    if len(parts) >= 3 and _rx(r"\d{4}").search(s):
        period, kind = parts[1], _letters(parts[2])
        if period in body and (_near(z[-len(kind) :], kind) or (name and _near(z[: len(name)], name))):
            return True, number
    return False, False


def short_lines(text: str) -> list[str]:
    """Letters of the short lines of a text that could be headers."""
    out = []
    for line in text.split("\n"):
        s = line.strip()
        if 4 < len(s) <= HEADER_WIDTH and not _rx(r"[.!?;,:%)”»-]$").search(s) and _rx(r"\d").search(s) and not _rx(r"\d+\.\d").match(s):
            z = _letters(_rx(r"^\d{1,4}\s+|\s*(?:\||, p\.)?\s*\d{1,4}$").sub("", s))
            if len(z) >= 6:
                out.append(z)
    return out


def lines_of(text: str, title: str, doc_id: str, page: int | None, repeated: frozenset[str]) -> tuple[list[str], bool, bool]:
    """(lines of running text, header found, page number found)."""
    keep, head, number = [], False, False
    text = text.replace("\xad\n", "¬\n").replace("\xad ", "¬ ")
    for line in plain(text)[0].split("\n"):
        if not line.strip():
            keep.append("")
        elif page_number(line, page):
            number = True
        else:
            h, n = header(line, title, doc_id, page, repeated)
            head |= h
            number |= h and n
            if not h:
                keep.append(line.strip())
    return keep, head, number


def _breaks(lines: list[str]) -> list[tuple[int, str, str, str]]:
    """(line, last word, mark or '', first word of the next line) at every line end inside text."""
    out = []
    full = [i for i, x in enumerate(lines) if x]
    for i, j in zip(full, full[1:]):
        m = _LINE_END.search(lines[i])
        f = _rx(r"[\p{L}\p{M}\p{N}@|$€]+").match(lines[j])
        if m and f and (m.group(2) or f.group()[0].islower() or f.group()[0] in "@0159"):
            out.append((i, m.group(1), m.group(2), f.group()))
    return out


def strings(lines: list[str]) -> dict[str, bool]:
    """Everything of a text that has to be looked up, and whether its count is needed even if it is known: joins across line ends, and pieces of numbers."""
    out: dict[str, bool] = {}
    for line in lines:
        for w in WORD.findall(line):
            low = w.lower()
            if low not in out:
                out[low] = len(low) == 1 or not low.isalpha() and bool(_SIGN.search(low))
    for _, a, mark, b in _breaks(lines):
        out[(a + b).lower()] = True
        if mark:
            out[f"{a}-{b}".lower()] = True
    return out


def torn(lines: list[str], unknown: set[str]) -> set[str]:
    """Neighbours on a line, one of them unknown, as one word, to be looked up as they stand."""
    if not unknown:
        return set()
    return {(a + b).lower() for line in lines for a, b in _side_by_side(line) if _torn(a, b) and (a.lower() in unknown or b.lower() in unknown)}


class Lexicon:
    """What was looked up for one text: count of a string, its best reading, and the length of the first of two words run together."""

    def __init__(self, rows: list[tuple[str, int, str | None, int]], apart: dict[str, int] | None = None):
        self.apart = apart or {}
        self.n = {w: n for w, n, _, _ in rows}
        self.unknown = {w for w, n in self.n.items() if n < LEAST}
        self.best = {w: b for w, _, b, _ in rows if b}
        self.cost = {w: c for w, _, b, c in rows if b}

    def known(self, w: str) -> bool:
        return self.n.get(w.lower(), LEAST) >= LEAST

    def count(self, w: str) -> int:
        return self.n.get(w.lower(), LEAST)

    def price(self, w: str) -> tuple[float, str | None]:
        """Cost of a word and its reading where it is a confusion."""
        low = w.lower()
        if self.known(low):
            return 1.0, None
        if low in self.best:
            return MISREAD + CONFUSION * self.cost[low], self.best[low]
        shape = _rx(r"(?<=[\p{Ll}])[@0159](?=[\p{Ll}])|(?<=[\p{Ll}])@|@(?=\p{Ll})").sub(lambda m: {"@": "a", "0": "o", "1": "l", "5": "s", "9": "g"}[m.group()], w)
        if shape != w and not _rx(r"[\d@]").search(shape):
            return 4.0, shape.lower()
        return UNKNOWN, None


def _like(model: str, word: str) -> str:
    """``word`` in the case of ``model``."""
    if model.isupper() and len(model) > 2:
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


def decode(lines: list[str], lex: Lexicon) -> tuple[list[str], bool, bool]:
    """(repaired lines, a hyphen was taken out, a character was corrected) by the shortest path over the words."""
    words: list[tuple[int, int, int, str]] = []
    for i, line in enumerate(lines):
        words += [(i, *m.span(), m.group()) for m in WORD.finditer(line)]
    ends = {i: (a, mark, b) for i, a, mark, b in _breaks(lines)}
    n = len(words)
    line_blank = lambda k: lines[words[k][0]][words[k][2] : words[k + 1][1]].isspace()
    best = [0.0] + [1e9] * n
    came: list[tuple] = [()] * (n + 1)
    lows = [w.lower() for *_, w in words]
    odd = [low in lex.unknown for low in lows]
    for k in range(n):
        i, a, e, w = words[k]
        price, reading = lex.price(w) if odd[k] else (1.0, None)
        if best[k] + price < best[k + 1]:
            best[k + 1], came[k + 1] = best[k] + price, ("word", k, reading)
        if odd[k] and lows[k] in lex.apart and best[k] + TORN < best[k + 1]:
            best[k + 1], came[k + 1] = best[k] + TORN, ("split", k, lex.apart[lows[k]])
        if k + 1 < n and (odd[k] or odd[k + 1]) and words[k + 1][0] == i and w.isalpha() and words[k + 1][3].isalpha() and line_blank(k) and _torn(w, words[k + 1][3]):
            if lex.n.get(lows[k] + lows[k + 1], 0) > LEAST and best[k] + TORN < best[k + 2]:
                best[k + 2], came[k + 2] = best[k] + TORN, ("merge", k)
        if k + 1 < n and words[k + 1][0] > i and i in ends and ends[i][0] == w and words[k + 1][3].startswith(ends[i][2]):
            mark, nxt = ends[i][1], words[k + 1][3]
            joined = w + nxt
            cost, read = lex.price(joined)
            apart = price + lex.price(nxt)[0]
            if (joined.lower() not in lex.n) and nxt != ends[i][2]:
                joined = w + ends[i][2]
                cost, read = lex.price(joined)
            if mark:
                hyphenated = lex.count(f"{w}-{ends[i][2]}") if f"{w}-{ends[i][2]}".lower() in lex.n else 0
                own = lex.count(joined) if joined.lower() in lex.n else 0
                if hyphenated >= LEAST and hyphenated >= own and mark in "-‐‑":
                    continue
                if cost >= UNKNOWN:  # neither form is known: the mark and the halves decide
                    cost = 3.0 if mark in "¬\xad‐" or apart > 2.0 else 9.0
                total = best[k] + min(cost, 5.5)
                if mark in "¬\xad" or own >= LEAST:
                    total -= 1.0
            else:
                if cost >= UNKNOWN or apart <= 2.0:
                    continue
                total = best[k] + cost + 1.0
            if total < best[k + 2]:
                best[k + 2], came[k + 2] = total, ("join", k, read, mark)
    path, k = [], n
    while k:
        step = came[k]
        path.append(step)
        k = step[1]
    edits: dict[int, list[tuple[int, int, str]]] = {}
    hyphen = char = False
    moved: dict[int, tuple[int, str]] = {}
    for step in reversed(path):
        k = step[1]
        i, a, e, w = words[k]
        if step[0] == "word":
            if step[2]:
                char = True
                edits.setdefault(i, []).append((a, e, _like(w, step[2])))
            continue
        if step[0] == "split":
            edits.setdefault(i, []).append((a, e, f"{w[: step[2]]} {w[step[2] :]}"))
            continue
        j, a2, e2, w2 = words[k + 1]
        if step[0] == "merge":
            edits.setdefault(i, []).append((a, e2, w + w2))
            continue
        char |= bool(step[2])
        hyphen |= bool(step[3])
        whole, k2 = w + w2, lex.apart.get((w + w2).lower(), 0)
        if k2 not in (0, len(w)) and not lex.known(whole):  # at len(w) the line end itself parts the two words
            whole = f"{whole[:k2]} {whole[k2:]}"
        edits.setdefault(i, []).append((a, len(lines[i]), _like(w, step[2]) if step[2] else whole))
        moved[j] = (e2, "")
        edits.setdefault(j, []).append((a2, e2, ""))
    out = []
    for i, line in enumerate(lines):
        cut, at = [], 0
        for a, e, new in edits.get(i, []):
            if a < at:
                continue
            cut += [line[at:a], new]
            at = e
        fixed = "".join([*cut, line[at:]])
        number = _fix_numbers(fixed, lex)
        char |= number != fixed
        out.append(_rx(r"^[\s]+").sub("", number))
    return out, hyphen, char


def _fix_numbers(line: str, lex: Lexicon) -> str:
    def fix(m: regex.Match) -> str:
        s = m.group()
        if not any(c.isdigit() for c in s):
            before, after = line[: m.start()].rstrip(), line[m.end() :].lstrip()
            if not (len(s) == 1 and s in "lOZ" and (after[:1] == "%" or _rx(r"\b(?:Nr|No|no|núm|p|n\.º|табл)\.$").search(before))):
                return s
        elif s.isdigit() or all(c.isdigit() or c in ".," for c in s):
            return s
        whole = _rx(r"\W").sub("", s)
        if whole.isalnum() and lex.n.get(whole.lower(), 0) >= LEAST:
            return s
        return s.translate(_DIGITS)

    return _NUMERAL.sub(fix, line)


def paragraphs(lines: list[str]) -> list[str]:
    """Continuous paragraphs: breaks chosen by dynamic programming over scores of line ends and a price for each paragraph and each one-line paragraph."""
    full = [x for x in lines if x.strip()]
    if not full:
        return []
    wide = max(map(len, full))
    n = len(full)

    def gain(i: int) -> float:
        a, b = full[i], full[i + 1]
        stop = bool(_rx(r"[.!?。！？।][”»\")）」]*$").search(a))
        short = len(a) < 0.75 * wide
        title = lambda x: bool(_rx(r"\d+(?:\.\d+)+\s|#").match(x)) or (len(x) < 50 and not _rx(r"[.!?,;:。！？।%-]$").search(x) and x[:1].isupper() and x.count(" ") < 6)
        if title(a) and not b[:1].islower():
            return 2.5
        if title(b) and stop:
            return 2.5
        if stop and not b[:1].islower():
            return 1.6 if short else -0.4
        return -3.0

    best, came = [0.0] * (n + 1), [0] * (n + 1)
    top, at = -1e9, 0  # best of all beginnings two lines or more before e
    for e in range(1, n + 1):
        if e > 1 and best[e - 2] > top:
            top, at = best[e - 2], e - 2
        alone = best[e - 1] - 0.3
        came[e] = e - 1 if alone > top else at
        best[e] = max(alone, top) - 0.6 + (gain(e - 1) if e < n else 0.0)
    out, e = [], n
    while e:
        part = full[came[e] : e]
        text = [part[0]]
        for last, x in zip(part, part[1:]):
            wide_script = _rx(r"[\p{Han}\p{Hiragana}\p{Katakana}，。、]$").search(last) and _rx(r"[\p{Han}\p{Hiragana}\p{Katakana}，。、（“「]").match(x)
            kept = _rx(r"\p{L}-$").search(last) and x[:1].islower() and not _rx(r"(?:und|oder|et|y|and|or)\b").match(x)
            text.append(x if wide_script or kept or _rx(r"[,.;:!?]").match(x) else " " + x)
        out.append("".join(text))
        e = came[e]
    return out[::-1]


def lexicon(texts: DataFrame) -> DataFrame:
    """(word, n) of all words, hyphenated compounds and pairs of neighbours of clean texts.

    Each batch counts its pieces between blanks and takes only the different ones apart, before the shuffle.
    """

    def words(c: Counter) -> Counter:
        out: Counter = Counter()
        for piece, n in c.items():
            if piece.isalpha() and piece.isascii():
                out[piece] += n
                continue
            for w in WORD.findall(piece):
                out[w] += n
                if _DIGIT.search(w):
                    out[fold(w)] += n
            if "-" in piece:
                for w in _COMPOUND.findall(piece):
                    out[w] += n
        return out

    def pairs(c: Counter) -> Counter:
        out: Counter = Counter()
        for (a, b), n in c.items():
            x, y = _TAIL.search(a), _HEAD.match(b)
            if x and y and x.group().isalpha() and y.group().isalpha():
                out[f"{x.group()} {y.group()}"] += n
        return out

    def frame(one: Counter, two: Counter) -> pd.DataFrame:
        done = words(one)
        done.update(pairs(two))
        return pd.DataFrame({"word": list(done), "n": list(done.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one: Counter = Counter()
        two: Counter = Counter()
        for pdf in batches:
            for t in pdf.text:
                for line in plain(t)[0].lower().split("\n"):
                    found = line.split()
                    one.update(found)
                    two.update(zip(found, found[1:]))
            if len(one) + len(two) > 400_000:
                yield frame(one, two)
                one, two = Counter(), Counter()
        if one:
            yield frame(one, two)

    return spread(texts.select("text").where("text is not null")).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spell(column: str):
    """:func:`key` as a column expression."""
    single = {c: x for c, x in _spellings().items() if len(x) == 1 and x != c}
    out = F.translate(F.col(column), "".join(single), "".join(single.values()))
    for c, x in _spellings().items():
        if len(x) > 1:
            out = F.replace(out, F.lit(c), F.lit(x))
    return out


def _header_lines(scans: DataFrame) -> DataFrame:
    """(doc_id, repeated): letters of short lines that stand in three or more chunks and a twentieth of the chunks of a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, c, z) for d, c, t in zip(pdf.doc_id, pdf.chunk_id, pdf.text) for z in {*short_lines(t), ""}]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "z"])

    seen = scans.select("doc_id", "chunk_id", "text").mapInPandas(run, "doc_id string, chunk_id string, z string")
    counts = seen.groupBy("doc_id", "z").agg(F.count("*").alias("n"))
    total = counts.where("z = ''").select("doc_id", F.col("n").alias("total"))
    often = counts.where("z <> '' and n >= 3").join(total, "doc_id").where("n >= 0.05 * total")
    return often.groupBy("doc_id").agg(F.collect_list("z").alias("repeated"))


def repair(scans: DataFrame, clean: DataFrame) -> DataFrame:
    """(chunk_id, text, header, pageno, hyphen, char): repaired text and which noise was found.

    ``scans`` has chunk_id, doc_id, title, source_locator, text; ``clean`` has text. Null, empty
    and blank texts come back as '' without noise; repeated rows count once.
    """
    spark = scans.sparkSession
    n = width(spark)
    base = scans.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("chunk_id", "doc_id", "title", "source_locator", "text")]).distinct()
    base = durable(base, "scans")
    base = base.join(_header_lines(base), "doc_id", "left").withColumn("row", F.xxhash64("chunk_id", "text"))

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, c, d, ti, loc, t, rep in zip(pdf.row, pdf.chunk_id, pdf.doc_id, pdf.title, pdf.source_locator, pdf.text, pdf.repeated):
                lines, head, number = lines_of(t, ti, d, page_of(loc), frozenset(rep if rep is not None else ()))
                needs = strings(lines)
                out.append((row, c, lines, head, number, list(needs), list(needs.values())))
            yield pd.DataFrame(out, columns=["row", "chunk_id", "lines", "header", "pageno", "needs", "keep"])

    schema = "row long, chunk_id string, lines array<string>, header boolean, pageno boolean, needs array<string>, keep array<boolean>"
    ready = durable(base.repartition(n, "row").mapInPandas(prepare, schema), "scan")
    lex = durable(lexicon(clean), "lexicon")
    asked = ready.select(F.explode(F.arrays_zip("needs", "keep")).alias("x")).groupBy(F.col("x.needs").alias("word")).agg(F.max("x.keep").alias("asked"))
    known = asked.join(lex, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"), "asked")
    known = durable(known, "asked")

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, r) for w in pdf.word for r in halves(w)]
            yield pd.DataFrame(rows, columns=["word", "reading"])

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cost=pd.array([changes(w, r) for w, r in zip(pdf.word, pdf.reading)], dtype="Int32"))

    unknown = durable(known.where(F.col("n") < LEAST).select("word"), "unknown")
    sure = lex.where(F.col("n") > LEAST).select(F.col("word").alias("reading"), F.col("n").alias("rn"))
    pairs = spread(unknown).mapInPandas(apart, "word string, reading string").withColumn("cost", F.lit(0)).join(sure.where(F.instr("reading", " ") > 0), "reading")
    keyed = unknown.where(F.col("word").rlike(r"\p{L}")).withColumn("key", spell("word"))
    alike = keyed.join(sure.where(F.instr("reading", " ") == 0).withColumn("key", spell("reading")), "key").where("word <> reading").select("word", "reading", "rn")
    alike = alike.mapInPandas(align, "word string, reading string, rn long, cost int").where("cost > 0")
    found = pairs.select("word", "reading", "rn", "cost").unionByName(alike)
    two = F.col("reading").contains(" ")
    order = F.struct(-F.col("cost"), F.col("rn"), F.col("reading"))
    best = found.groupBy("word").agg(
        F.max_by(F.when(~two, F.struct("reading", "cost")), F.when(~two, order)).alias("b"), F.max_by(F.when(two, F.instr("reading", " ") - 1), F.when(two, order)).alias("apart")
    )
    facts = known.join(best, "word", "left").select("word", "n", "asked", F.col("b.reading").alias("best"), F.coalesce("b.cost", F.lit(0)).alias("cost"), F.coalesce("apart", F.lit(0)).alias("apart"))
    # a known word is what a text takes for granted, so only the others and those whose count decides go back to it
    each = ready.select("row", F.explode(F.arrays_zip("needs", "keep")).alias("x")).select("row", F.col("x.needs").alias("word"), F.col("x.keep").alias("keep"))
    joins = each.join(facts.where((F.col("n") < LEAST) | F.col("asked")).drop("asked"), "word").where((F.col("n") < LEAST) | F.col("keep")).drop("keep")
    own = joins.groupBy("row").agg(F.collect_list(F.struct("word", "n", "best", "cost", "apart")).alias("facts"))
    todo = durable(ready.drop("needs", "keep").join(own, "row", "left"), "looked-up")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, lines, facts in zip(pdf.row, pdf.lines, pdf.facts):
                unknown = {f["word"] for f in facts if f["n"] < LEAST} if facts is not None else set()
                out += [(row, w) for w in torn(list(lines), unknown)]
            yield pd.DataFrame(out, columns=["row", "word"])

    whole = todo.mapInPandas(ask, "row long, word string").join(lex, "word").where(F.col("n") > LEAST)
    whole = whole.groupBy("row").agg(F.collect_list(F.struct("word", "n")).alias("wholes"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c, lines, head, number, facts, wholes in zip(pdf.chunk_id, pdf.lines, pdf.header, pdf.pageno, pdf.facts, pdf.wholes):
                facts = facts if facts is not None else []
                more = [(f["word"], f["n"], None, 0) for f in wholes] if wholes is not None else []
                know = Lexicon(more + [(f["word"], f["n"], f["best"], f["cost"]) for f in facts], {f["word"]: f["apart"] for f in facts if f["apart"]})
                fixed, hyphen, char = decode(list(lines), know)
                out.append((c, "\n\n".join(paragraphs(fixed)), head, number, hyphen, char))
            yield pd.DataFrame(out, columns=["chunk_id", "text", "header", "pageno", "hyphen", "char"])

    return todo.join(whole, "row", "left").mapInPandas(solve, "chunk_id string, text string, header boolean, pageno boolean, hyphen boolean, char boolean")


def noise(repaired: DataFrame) -> DataFrame:
    """(chunk_id, noise), one row per kind found."""
    kinds = F.array(*[F.when(F.col(k), F.lit(k)) for k in ("hyphen", "char", "header", "pageno")])
    return repaired.select("chunk_id", F.explode(F.array_compact(kinds)).alias("noise")).distinct()
