"""Language of documents and of their segments (problem 1).

Kneser-Ney character models are fitted to plain sentences of every language and to a bounded
sample of labelled rows, at most ``SAMPLE`` per language taken by a hash of the key; since labels
may be wrong, sentences whose 4-grams are commoner under another label are left out first. The
models of the languages of one script share sorted hash arrays; a unit is scored by those of its
main script and gets the language of least cross-entropy per character. It is rejected where a
language that is to be rejected is nearer, or where the cross-entropy is above the limit, which
comes from plain sentences the models have not seen and widens for short units. The confidence is
a softmax of the cross-entropies whose scale is fitted to those sentences as well.
"""

from __future__ import annotations

import difflib
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.charlm import CharModels, keys
from tessera.llm.normalize import alike
from tessera.llm.plain_sentences import KNOWN, OTHER
from tessera.llm.sentences import plain
from tessera.session import durable, width

#: Labelled rows per language the models are fitted to.
SAMPLE = 500
#: Longest text of the sample, so that its size is bounded; such texts are used whole.
LONGEST = 4000
ORDER = 4
# Names of the languages as written in labels.
NAMES = {
    "en": "en eng english anglais englisch inglés 英语 英文 英語",
    "zh": "zh zho chi cmn chinese mandarin chinois chinesisch 中文 汉语 漢語 中国語 hans hant",
    "ja": "ja jpn jp japanese japonais japanisch 日语 日文 日本語",
    "de": "de deu ger german deutsch allemand alemán 德语 德文",
    "fr": "fr fra fre french français francais französisch francés 法语 法文",
    "es": "es spa spanish español espanol castellano spanisch espagnol 西班牙语",
    "pt": "pt por portuguese português portugues portugiesisch portugais 葡萄牙语",
    "ru": "ru rus russian русский russisch russe 俄语",
    "th": "th tha thai ไทย 泰语",
    "hi": "hi hin hindi हिन्दी हिंदी 印地语",
}
UNKNOWN = frozenset(["", "n/a", "na", "unknown", "und", "none", "null", "-", "?", "xx", "zxx", "mis", "unk", "undefined", "other", "unspecified", "nan", "tbd", "n.a."])
_BY_NAME = {n: code for code, names in NAMES.items() for n in names.split()}
_LONG = [n for n in _BY_NAME if len(n) > 4]
_JOIN = regex.compile(r"(?<=[^\s.!?。！？।:：”»)）」])[ ]*\n[ ]*(?=\S)")
_GLUED = regex.compile(r"(?<=\p{Ll}[.!?])(?=\p{Lu}\p{Ll})|(?<=[。！？।])(?=\S)|(?<=\p{Latin}[.!?]\s)(?=[\p{L}--\p{Latin}])", regex.V1)
_CODE = regex.compile(r"[A-Za-z0-9/+=_-]{40,}+|https?:\S+|\b[A-Z]{2,}+(?:-[A-Z0-9.]+)+\b")
_STOP = regex.compile(r"[.!?…。！？।][”»\"')）」\]]*$")


@functools.lru_cache(maxsize=10_000)
def label_codes(label: str | None) -> tuple[str, ...] | None:
    """Sorted codes a label names, or None where it names none (missing, unknown or unreadable)."""
    s = (label or "").strip().lower()
    if s in UNKNOWN:
        return None
    out = set()
    for part in regex.split(r"\s*(?:[+/,;&|]|\band\b|\bund\b)\s*", s):
        if part in UNKNOWN:
            continue
        head = regex.split(r"[-_ (]", part)[0]
        code = _BY_NAME.get(part) or _BY_NAME.get(head)
        if not code:
            near = difflib.get_close_matches(part, _LONG, 1, 0.8)
            code = _BY_NAME[near[0]] if near else None
        if not code:
            return None
        out.add(code)
    return tuple(sorted(out)) or None


def with_codes(rows: DataFrame, label: str = "label", out: str = "code") -> DataFrame:
    """``rows`` with the codes their label names, joined by '+', or null; every different label is read once."""

    @F.pandas_udf("string")
    def codes(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "+".join(label_codes(x) or ()) or None)

    kinds = rows.select(F.coalesce(F.col(label), F.lit("")).alias("_label")).distinct()
    kinds = durable(kinds.withColumn(out, codes("_label")), "labels")
    return rows.withColumn("_label", F.coalesce(F.col(label), F.lit(""))).join(kinds, "_label", "left").drop("_label")


# ends of units for language only: a cut more or less inside one language changes nothing, so abbreviations are not looked at
_CUT = regex.compile(r"(?:[.!?…]+[”»\"')）」\]]*(?:\s+(?!\p{Ll}|\d+(?!\d|年))|(?=\p{Lu}\p{Ll}))|[。！？।॥]+[”»\"')）」』\]]*|\n|(?<=\p{Thai}\p{M}*ๆ?) +(?=\p{L}|[“„«(「『（]|\d+年))")


def _segments(text: str) -> list[tuple[int, int]]:
    """Places of the units of a text; lines broken inside a sentence are joined for the cut."""
    joined = _JOIN.sub(lambda m: " " * len(m.group()), text) if "\n" in text else text
    out, at = [], 0
    for m in _CUT.finditer(joined):
        out.append((at, m.end()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if not text[a:b].isspace() and a < b]


_FOLD = str.maketrans({chr(a): chr(b) for a, b in alike().items()})
_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}][A-Za-z]|[A-Za-z][\p{Cyrillic}\p{Greek}]")
_MIXED = regex.compile(r"\w*(?:[a-z][\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][a-z])\w*", regex.I)


_LETTERS_ONLY = regex.compile(r"[^\p{L}\p{M}'’]+")
_NOT_ASCII_LETTER = regex.compile(r"[^a-z']+")


def _clean(s: str) -> str:
    """Lower-case letters of a unit, without codes and addresses; look-alike letters inside words of Latin letters are made Latin."""
    if "-" in s or "http" in s or max(map(len, s.split()), default=0) >= 40:
        s = _CODE.sub(" ", s)
    if s.isascii():
        return _NOT_ASCII_LETTER.sub(" ", s.lower()).strip()
    s = unicodedata.normalize("NFC", s)
    s = plain(_MIXED.sub(lambda m: m.group().translate(_FOLD), s) if _FOREIGN.search(s) else s)[0]
    return _LETTERS_ONLY.sub(" ", s.lower()).strip()


def _codes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all units, each between blanks and with 0 before it, and the unit of each position."""
    text = "".join(f"\0 {u} " for u in units)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return codes, np.cumsum(codes == 0) - 1


# First and last code points of letters by script; 1 Latin, 2 Cyrillic, 3 Thai, 4 Devanagari, 5 Han and kana, 6 other.
_SCRIPTS = [(0x41, 0x24F, 1), (0x1E00, 0x1EFF, 1), (0x400, 0x52F, 2), (0xE00, 0xE7F, 3), (0x900, 0x97F, 4), (0x3040, 0x30FF, 5), (0x3400, 0x9FFF, 5), (0xF900, 0xFAFF, 5)]
_LETTERS = np.full(0x110000, 6, np.uint8)
for _lo, _hi, _s in _SCRIPTS:
    _LETTERS[_lo : _hi + 1] = _s
_LETTERS[[0, 0x20, 0x27, 0x2019]] = 0


def scripts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Main script of each unit; an ideograph or kana weighs as much as 2.5 letters."""
    kind = _LETTERS[codes]
    share = np.stack([np.add.reduceat((kind == k) * (2.5 if k == 5 else 1.0), starts) for k in range(1, 7)], axis=1)
    return share.argmax(axis=1) + 1


def unmixed(units: list[tuple[str, str]], languages: list[str], rounds: int = 3, bits: int = 18) -> list[bool]:
    """Which labelled units belong to their label, by how often their 4-grams occur under each label.

    Unconditional frequencies are used because a minority of foreign text under a label hardly
    moves them, while it would teach a conditional model the foreign contexts in full.
    """
    codes, owner = _codes([u for _, u in units])
    h = (keys(codes, 4) >> np.uint64(64 - bits)).astype(np.int64)
    unit = owner[: len(h)]
    told = np.array([languages.index(c) for c, _ in units])
    now = told.copy()
    for _ in range(rounds):
        count = np.stack([np.bincount(h[now[unit] == j], minlength=1 << bits) for j in range(len(languages))]).astype(float) + 0.01
        score = np.log(count / count.sum(axis=1, keepdims=True))
        total = np.stack([np.bincount(unit, weights=score[j][h], minlength=len(units)) for j in range(len(languages))], axis=1)
        now = total.argmax(axis=1)
    return (now == told).tolist()


class Identifier:
    """Models by script with the limits of rejection and the scale of confidence."""

    def __init__(self) -> None:
        self.groups: dict[int, CharModels] = {}
        self.limit: dict[str, tuple[float, float]] = {}
        self.scale = (1.0, 0.5)

    def fit(self, rows: list[tuple[str, str]]) -> Identifier:
        """Models from (language, cleaned unit) rows."""
        by: dict[str, list[str]] = {}
        for c, u in rows:
            by.setdefault(c, []).append(u)
        script: dict[int, list[str]] = {}
        for c, us in sorted(by.items()):
            codes, _ = _codes(us)
            script.setdefault(int(np.bincount(scripts(codes, np.flatnonzero(codes == 0))).argmax()), []).append(c)
        for k, languages in script.items():
            self.groups[k] = CharModels(languages, ORDER).fit([_codes(by[c])[0] for c in languages])
        return self

    def entropy(self, units: list[str], most: int = 200_000) -> list[tuple[list[str], np.ndarray] | None]:
        """(languages, cross-entropy per character in nats) of each unit under the models of its script; None where no model is of it."""
        out: list[tuple[list[str], np.ndarray] | None] = [None] * len(units)
        if not units:
            return out
        codes, _ = _codes(units)
        kind = scripts(codes, np.flatnonzero(codes == 0))
        for k, models in self.groups.items():
            own = np.flatnonzero(kind == k).tolist()
            lo = 0
            while lo < len(own):
                hi, n = lo, 0
                while hi < len(own) and (n == 0 or n + len(units[own[hi]]) < most):
                    n += len(units[own[hi]]) + 3
                    hi += 1
                codes, _ = _codes([units[i] for i in own[lo:hi]])
                starts = np.flatnonzero(codes == 0)
                length = np.diff(np.append(starts, len(codes))) - 1
                h = -np.add.reduceat(models.score(codes), starts, axis=0) / length[:, None]
                for i, row in zip(own[lo:hi], h):
                    out[i] = models.languages, row
                lo = hi
        return out

    def confidence(self, h: np.ndarray, length: int) -> np.ndarray:
        """Probability of each language of a script."""
        t, power = self.scale
        x = np.minimum((h - h.min()) * t * length**power, 50.0)
        p = np.exp(-x)
        return p / p.sum()

    def judge(self, units: list[str]) -> list[tuple[str | None, float]]:
        """(language or None where rejected, confidence) of each cleaned unit."""
        out: list[tuple[str | None, float]] = []
        for u, hit in zip(units, self.entropy(units)):
            if hit is None or not u:
                out.append((None, 0.0))
                continue
            languages, h = hit
            best = int(h.argmin())
            lang = languages[best]
            mean, width_ = self.limit.get(lang, (np.inf, 0.0))
            if lang in OTHER or h[best] > mean + width_ / np.sqrt(len(u)):
                out.append((None, 0.0))
            else:
                out.append((lang, float(self.confidence(h, len(u))[best])))
        return out


def _plain_units(table: dict[str, str]) -> list[tuple[str, str]]:
    return [(c, _clean(line)) for c, text in table.items() for line in text.split("\n")]


def fit(sample: list[tuple[str, str]]) -> Identifier:
    """Models from (code, text) rows and the plain sentences; an empty sample leaves the plain sentences alone.

    Limits and the scale of confidence come from plain sentences, every fourth of which is held
    out in turn, so they are of another kind of text than the sample.
    """
    units: list[tuple[str, str]] = []
    for code, text in sample:
        for a, b in _segments(text):
            u = _clean(text[a:b])
            if len(u) >= 6:
                units.append((code, u))
    units = list(dict.fromkeys(units))
    languages = sorted({c for c, _ in units})
    rows = [x for x, ok in zip(units, unmixed(units, languages)) if ok] if units else []
    seed, other = _plain_units(KNOWN), _plain_units(OTHER)
    plain_rows = seed + other
    seen: dict[str, list[tuple[float, int]]] = {}
    checks: list[tuple[np.ndarray, int, int]] = []
    for fold in range(FOLDS):
        held = [x for i, x in enumerate(plain_rows) if i % FOLDS == fold]
        kept = [x for i, x in enumerate(plain_rows) if i % FOLDS != fold]
        part = Identifier().fit([x for i, x in enumerate(rows) if i % FOLDS == fold] + kept)
        pieces = [(c, p) for c, u in held for p in (u, u[: len(u) // 2], u[len(u) // 2 :], u[: len(u) // 4]) if len(p) > 3]
        for (c, u), hit in zip(pieces, part.entropy([u for _, u in pieces])):
            if hit is not None and c in hit[0]:
                j = hit[0].index(c)
                seen.setdefault(c, []).append((float(hit[1][j]), len(u)))
                checks.append((hit[1], j, len(u)))
    final = Identifier().fit(rows + plain_rows)
    for c, xs in seen.items():
        h, n = np.array([x for x, _ in xs]), np.array([k for _, k in xs])
        mean = float(np.average(h, weights=n))
        final.limit[c] = mean, float(np.quantile((h - mean) * np.sqrt(n), 0.995))
    best = np.inf
    for power in (0.5, 0.75, 1.0):
        for t in np.geomspace(0.2, 10.0, 25):
            trial = Identifier()
            trial.scale = (float(t), power)
            loss = -sum(np.log(max(1e-12, trial.confidence(h, n)[j])) for h, j, n in checks)
            if loss < best:
                best, final.scale = loss, trial.scale
    return final


#: Parts the plain sentences are held out in.
FOLDS = 4


def identify(text: str | None, ident: Identifier) -> list[tuple[int, int, str | None, float, bool]]:
    """(start, end, language, confidence, full sentence) of the units of one text."""
    if not text or not text.strip():
        return []
    places = _segments(text)
    clean = [_clean(text[a:b]) for a, b in places]
    verdict = ident.judge(clean)
    out = []
    for (a, b), u, (lang, conf) in zip(places, clean, verdict):
        out.append((a, b, lang, conf, _full(text[a:b], u, lang)))
    return out


def _full(unit: str, clean: str, lang: str | None) -> bool:
    """Is a unit a full sentence: it has a stop and more than one word (or two ideographs), or is Thai, which has no stops, and of some length?"""
    if lang == "th":
        return len(clean) >= THAI_SENTENCE
    return bool(_STOP.search(unit.rstrip())) and (" " in clean or lang in ("zh", "ja", "th") and len(clean) > 1)


#: Letters from which a Thai unit counts as a sentence; Thai has no mark for its end.
THAI_SENTENCE = 20
#: Confidence from which a full sentence adds its language to those of the text.
SURE = 0.97


def whole(units: list[tuple[int, int, str | None, float, bool]]) -> tuple[str | None, float]:
    """(codes joined by '+', confidence) of a text: the language with most text in full sentences and all others of which one sentence is sure."""
    for only_full in (True, False):
        size: dict[str, float] = {}
        sure: dict[str, float] = {}
        for a, b, lang, conf, full in units:
            if lang and (full or not only_full):
                size[lang] = size.get(lang, 0) + (b - a) * (2.5 if lang in ("zh", "ja") else 1)
                sure[lang] = max(sure.get(lang, 0.0), conf)
        if not size:
            continue
        top = sorted(size, key=lambda x: (-size[x], x))
        if not only_full:
            return top[0], sure[top[0]]
        pick = [top[0], *[x for x in top[1:] if sure[x] >= SURE]]
        return "+".join(sorted(pick)), min(sure[x] for x in pick)
    return None, 0.0


def labelled_sample(rows: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``per_language`` (code, text) rows of each single-language label, by hash of the key, among texts of at most ``LONGEST`` characters; all that is gathered is so bounded."""
    keyed = with_codes(rows.where("text is not null and trim(text) <> ''").where(F.char_length("text") <= LONGEST)).where(F.length("code") == 2)
    counts = {r.code: r["count"] for r in keyed.groupBy("code").count().collect()}
    if not counts:
        return []
    # the hash as a number from 0 to 1: the share may be as small as it likes, half as much again as needed is taken and cut exactly
    at = F.xxhash64("key", "text").cast("double") / float(1 << 64) + 0.5
    share = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(1.5 * per_language / n + 1e-15))])
    some = keyed.where(at < share[F.col("code")])
    rank = F.row_number().over(Window.partitionBy("code").orderBy(at, "key", "text"))
    picked = some.withColumn("r", rank).where(F.col("r") <= per_language).select("code", "text")
    return [(r.code, r.text) for r in picked.collect()]


def detect(rows: DataFrame, ident: Identifier) -> DataFrame:
    """(src, key, label, lang, confidence) of rows (src, key, text, label); lang is null where no language shows.

    Null, empty, blank and unreadable texts have a null lang; repeated rows count once.
    """
    return _run(rows, ident, False)


def segments(rows: DataFrame, ident: Identifier) -> DataFrame:
    """(src, key, start_pos, end_pos, lang, confidence) of every run of units of one language, positions from 1 and inclusive."""
    return _run(rows, ident, True)


#: Verdicts on cleaned units a worker keeps; beyond that it starts anew.
KEPT = 100_000


def _run(rows: DataFrame, ident: Identifier, parts: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(ident)
    data = rows.select("src", F.col("key").cast("string").alias("key"), "text", "label").distinct().repartition(width(rows.sparkSession))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        known: dict[str, tuple[str | None, float]] = {}
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                out = []
                texts = part.text.tolist()
                places = [_segments(t) if t and t.strip() else [] for t in texts]
                clean = [[_clean(t[a:b]) for a, b in own] for t, own in zip(texts, places)]
                if len(known) > KEPT:
                    known.clear()
                new = list(dict.fromkeys(u for own in clean for u in own if u not in known))
                known.update(zip(new, model.judge(new)))
                for src, key, label, t, own, us in zip(part.src, part.key, part.label, texts, places, clean):
                    units = [(a, b, *known[u], _full(t[a:b], u, known[u][0])) for (a, b), u in zip(own, us)]
                    if not parts:
                        out.append((src, key, label, *whole(units)))
                        continue
                    runs: list[list] = []
                    for a, b, lang, conf, _ in units:
                        if lang and runs and runs[-1][2] == lang:
                            runs[-1][1] = b
                            runs[-1][3] = min(runs[-1][3], conf)
                        elif lang:
                            runs.append([a, b, lang, conf])
                    out += [(src, key, a + 1, b, lang, conf) for a, b, lang, conf in runs]
                names = ["src", "key", "start_pos", "end_pos", "lang", "confidence"] if parts else ["src", "key", "label", "lang", "confidence"]
                yield pd.DataFrame(out, columns=names)

    schema = "src string, key string, start_pos long, end_pos long, lang string, confidence double" if parts else "src string, key string, label string, lang string, confidence double"
    return data.mapInPandas(run, schema)


def mislabelled(detected: DataFrame) -> DataFrame:
    """(src, key, lang) of the rows whose label is missing or names something else than the language found."""
    told = with_codes(durable(detected.where("lang is not null"), "detected"), out="told")
    return told.where("told is null or told <> lang").select("src", "key", "lang").distinct()
