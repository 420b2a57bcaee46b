"""One form for text that looks the same (problem 4).

The characters of a whole Arrow batch become one numpy array. Lookup-table gathers give every
character its expansion (width and presentation forms, decomposition, kinds of space, nothing
for invisible characters), expansion offsets place them, marks are put in canonical order and
composed with their base in vector rounds. No call is made per row. Case, accents, raised or
circled digits, fractions and squared words are kept. In the consistent form a letter of another
script that is printed like a Latin one becomes Latin only inside a word that has Latin letters
too, so text in Cyrillic or Greek stays what it is; the key of a look replaces it everywhere.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.codepoints import to_arrow, to_codes
from tessera.session import durable, spread

# Letters of other scripts printed like the Latin letter above them.
LATIN = "aceopxyisjhdqwAABBCCEEHHIIIJKKMMNOOPPSTTXXYYZZ"
ALIKE = "асеорхуіѕјһԁԛԝАΑВΒСϹЕΕНΗІΙӀЈКΚМΜΝОΟРΡЅТΤХΧΥҮΖΖ"
ALIKE_EXTRA = {"ο": "o", "ӏ": "l", "ν": "v", "ɡ": "g", "ı": "i", "ϲ": "c", "ϳ": "j", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "ү": "y", "ё": "ë", "Ё": "Ë"}
# The same of Cherokee, Armenian and Coptic letters.
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᎡ", "ABCDEGHJKLMPSTVWZR"))
OTHER_SCRIPTS = CHEROKEE | {"օ": "o", "Օ": "O", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Ս": "U", "Լ": "L", "ⲟ": "o", "Ⲟ": "O", "ⲥ": "c", "Ⲥ": "C"}
#: Compatibility forms that differ to the eye and therefore stay.
KEPT = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<font>", "<vertical>")
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]


def alike() -> dict[int, int]:
    return {ord(a): ord(b) for a, b in zip(ALIKE, LATIN)} | {ord(a): ord(b) for a, b in (ALIKE_EXTRA | OTHER_SCRIPTS).items()}


def _expand(c: int, letters: dict[int, int]) -> list[int]:
    """Full expansion of one character."""
    ch = chr(c)
    cat = unicodedata.category(ch)
    if c in (0x9, 0x1680) or cat == "Zs":
        return [0x20]
    if c in (0xA, 0xB, 0xC, 0x85, 0x2028, 0x2029):
        return [0xA]
    if cat in ("Cf", "Cc") or c in _INVISIBLE:
        return []
    if c in (0x2010, 0x2011):
        return [0x2D]
    if 0xAC00 <= c <= 0xD7A3:
        return [c]
    if c in letters:
        return _expand(letters[c], {})
    deco = unicodedata.decomposition(ch)
    if not deco:
        return [c]
    parts = deco.split()
    if parts[0].startswith("<"):
        if parts[0] in KEPT or c in (0x17F,) or (parts[1] == "0020" and len(parts) > 2):
            return [c]
        parts = parts[1:]
    return [y for x in parts for y in _expand(int(x, 16), letters)]


_INVISIBLE = frozenset(INVISIBLE)


@functools.lru_cache(maxsize=2)
def tables(fold_letters: bool = True) -> dict[str, np.ndarray]:
    """Lookup tables by code point, and the sorted table of composing pairs."""
    letters = alike() if fold_letters else {}
    n = 0x110000
    size = np.ones(n, np.uint8)
    start = np.zeros(n, np.int32)
    ccc = np.zeros(n, np.uint8)
    pool: list[int] = []
    pairs: dict[int, int] = {}
    for lo, hi in ((0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200)):
        for c in range(lo, hi):
            k = unicodedata.combining(chr(c))
            if k:
                ccc[c] = k
            e = _expand(c, letters)
            if e != [c]:
                size[c] = len(e)
                start[c] = len(pool)
                pool += e
            deco = unicodedata.decomposition(chr(c)).split()
            if len(deco) == 2 and not deco[0].startswith("<") and unicodedata.normalize("NFC", chr(c)) == chr(c):
                pairs[int(deco[0], 16) << 21 | int(deco[1], 16)] = c
    own = np.flatnonzero((size == 1) & (start == 0))
    changed = np.zeros(n, bool)
    changed[:] = True
    changed[own] = False
    first = pool[0] if pool else 0
    for c in np.flatnonzero((size == 1) & (start == 0)):  # the entry at pool position 0 is the only ambiguous one
        if _expand(int(c), letters) == [first] and c != first and c < 0x200:
            changed[c] = True
            break
    keys = np.array(sorted(pairs), np.int64)
    return {"size": size, "start": start, "ccc": ccc, "pool": np.array(pool, np.uint32), "changed": changed, "keys": keys, "made": np.array([pairs[k] for k in keys.tolist()], np.uint32)}


def _expanded(codes: np.ndarray, offsets: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = t["size"][codes].astype(np.int64)
    at = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    src = np.repeat(np.arange(len(codes)), size)
    within = np.arange(at[-1]) - at[src]
    old = codes[src]
    hit = t["changed"][old]
    out = old.copy()
    out[hit] = t["pool"][t["start"][old[hit]] + within[hit]]
    return out, at[offsets]


def _ordered(codes: np.ndarray, row: np.ndarray, ccc: np.ndarray) -> np.ndarray:
    """Marks after each base in the order of their class (stable)."""
    mark = ccc > 0
    if not (mark[1:] & mark[:-1]).any():
        return codes
    base = np.cumsum(~mark | np.append(True, row[1:] != row[:-1]))
    return codes[np.lexsort((np.arange(len(codes)), ccc, base))]


def _composed(codes: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Mask of characters that stay; ``codes`` is changed in place. Round k joins the k-th mark of every base."""
    ccc = t["ccc"][codes]
    keep = np.ones(len(codes), bool)
    n = len(codes)
    base = np.flatnonzero((ccc == 0) & np.append(ccc[1:] > 0, False) & np.append(row[1:] == row[:-1], False)) if n else np.zeros(0, np.int64)
    last = np.zeros(len(base), np.uint8)
    k = 1
    while len(base):
        at = base + k
        ok = (at < n) & (ccc[np.minimum(at, n - 1)] > 0) & (row[np.minimum(at, n - 1)] == row[base])
        base, last, at = base[ok], last[ok], at[ok]
        if not len(base):
            break
        key = codes[base].astype(np.int64) << 21 | codes[at].astype(np.int64)
        pos = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        joins = (t["keys"][pos] == key) & (last < ccc[at])
        codes[base[joins]] = t["made"][pos[joins]]
        keep[at[joins]] = False
        last = np.where(joins, last, ccc[at])
        k += 1
    lead = np.flatnonzero(keep[:-1] & keep[1:] & (row[1:] == row[:-1])) if n else np.zeros(0, np.int64)
    a, b = codes[lead].astype(np.int64), codes[lead + 1].astype(np.int64)
    lv = lead[(a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)]  # Hangul by rule
    codes[lv] = 0xAC00 + ((codes[lv] - 0x1100) * 21 + (codes[lv + 1] - 0x1161)) * 28
    keep[lv + 1] = False
    kept = np.flatnonzero(keep)
    if len(kept) > 1:
        a, b = codes[kept[:-1]].astype(np.int64), codes[kept[1:]].astype(np.int64)
        tail = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3) & (row[kept[:-1]] == row[kept[1:]])
        codes[kept[:-1][tail]] += (b[tail] - 0x11A7).astype(np.uint32)
        keep[kept[1:][tail]] = False
    return keep


@functools.lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: kind (0 no letter, 1 Latin, 2 printed like a Latin letter, 3 any other letter or mark), and the Latin letter of kind 2."""
    kind, to = np.zeros(0x30000, np.uint8), np.arange(0x30000, dtype=np.uint32)
    for c in range(0x30000):
        if unicodedata.category(chr(c))[0] in "LM":
            kind[c] = 1 if c < 0x250 or 0x1E00 <= c < 0x1F00 else 3
    for c, latin in alike().items():
        kind[c], to[c] = 2, latin
    for c in (0x131, 0x261):  # Latin letters themselves
        kind[c] = 1
    return kind, to


def _fold_mixed(codes: np.ndarray, row: np.ndarray) -> None:
    """Makes look-alike letters Latin, in place, in words with a Latin letter whose other letters are all look-alikes."""
    table, to = _letters()
    kind = table[np.minimum(codes, len(table) - 1)]
    if not (kind == 2).any():
        return
    first = (kind > 0) & np.append(True, (kind[:-1] == 0) | (row[1:] != row[:-1]))
    at = np.flatnonzero(kind > 0)
    word = np.cumsum(first)[at]
    n = int(word[-1]) + 1
    has = [np.bincount(word[kind[at] == k], minlength=n) > 0 for k in (1, 2)]
    strange = np.bincount(word[(kind[at] == 3) & (codes[at] >= 0x370)], minlength=n) > 0
    hit = at[(kind[at] == 2) & (has[0] & has[1] & ~strange)[word]]
    codes[hit] = to[codes[hit]]


def canonical(column: pa.Array, fold_letters: bool | None = None) -> pa.Array:
    """The consistent form of every text of a column; null stays null, blank text becomes ''.

    Letters printed like Latin ones are folded in mixed words (None), everywhere (True, the key of a look) or nowhere (False).
    """
    t = tables(bool(fold_letters))
    codes, offsets, valid = to_codes(column)
    codes, offsets = _expanded(codes, offsets, t)
    row = np.repeat(np.arange(len(valid)), np.diff(offsets))
    if fold_letters is None:
        _fold_mixed(codes, row)
    codes = _ordered(codes, row, t["ccc"][codes])
    keep = _composed(codes, row, t)
    blank = (codes == 0x20) | (codes == 0xA)
    ink = np.flatnonzero(keep & ~blank)
    first, last = np.full(len(valid), len(codes)), np.full(len(valid), -1)
    if len(ink):
        np.minimum.at(first, row[ink], ink)
        np.maximum.at(last, row[ink], ink)
    at = np.arange(len(codes))
    if len(codes):
        keep &= (at >= first[row]) & (at <= last[row])
    new = np.zeros(len(valid) + 1, np.int64)
    np.cumsum(np.bincount(row[keep], minlength=len(valid)), out=new[1:])
    return to_arrow(codes[keep], new, valid)


def normalize(df: DataFrame, text_col: str, out_col: str = "canonical", fold_letters: bool | None = None) -> DataFrame:
    """``df`` with ``out_col``, the consistent form of ``text_col`` (or, with ``fold_letters`` true, the key of its look).

    Null gives null, empty and blank text ''; a clash of ``out_col`` with a column of ``df`` is refused.
    """
    if out_col in df.columns:
        raise ValueError(f"{out_col} exists already")
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, canonical(b.column(at), fold_letters)], names=[*b.schema.names, out_col])

    schema = StructType([*df.schema.fields, StructField(out_col, StringType())])
    return df.mapInArrow(run, schema)


def lookalikes(rows: DataFrame) -> DataFrame:
    """(src, key_a, key_b) for rows (src, key, text) of one source that look the same but differ.

    Rows without visible text or key take part in no pair; equal texts are no pair; repeated rows
    count once. The spellings of a look are paired, one row each, and only pairs of spellings are
    expanded to their rows, so a look that is always spelt alike costs nothing however many rows have it.
    """
    plain = rows.select(F.col("src"), F.col("key").cast("string").alias("key"), F.col("text").cast("string").alias("text")).where("key is not null and text is not null")
    done = normalize(spread(plain), "text", "look", True).where("look <> ''")
    marks = durable(done.select("src", "key", F.sha2("look", 256).alias("look"), F.md5("text").alias("exact")).distinct(), "looks")
    several = marks.groupBy("src", "look").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select("src", "look")
    some = durable(marks.join(several, ["src", "look"], "left_semi"), "spellings")
    spelt = some.select("src", "look", "exact").distinct()
    pairs = spelt.withColumnRenamed("exact", "ea").join(spelt.withColumnRenamed("exact", "eb"), ["src", "look"]).where("ea < eb")
    a = some.select("src", "look", F.col("key").alias("one"), F.col("exact").alias("ea"))
    b = some.select("src", "look", F.col("key").alias("two"), F.col("exact").alias("eb"))
    out = pairs.join(a, ["src", "look", "ea"]).join(b, ["src", "look", "eb"]).where("one <> two")
    return out.select("src", F.least("one", "two").alias("key_a"), F.greatest("one", "two").alias("key_b")).distinct()
