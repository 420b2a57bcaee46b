"""Questions answered from facts: slots, gate, clarification, lookup and answer text.

Slots are found by longest synonym first without overlap, for many questions at once in a
pandas UDF; everything after is native. Answers are put together from fact values only.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.facts import lookup

#: struct of the slots of a question.
INTENT = "metrics array<string>, entities array<string>, periods array<struct<period_type: string, period: string>>, channel string, external string, route string, masked string"
# Cues of numeric and narrative questions.
NUMERIC_CUES = ["多少", "几", "how much", "how many", "what was", "what is", "cuál fue", "wie hoch", "quelle était", "いくら"]
NARRATIVE_CUES = ["为什么", "为何", "原因", "why", "explain", "pourquoi", "warum", "por qué", "なぜ"]


@functools.lru_cache(maxsize=64)
def _alternation(words: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) or r"(?!)")


def match_all(text: str, synonyms: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, code) of synonyms in a text: longer ones first, no overlaps, in order of appearance.

    One compiled alternation, longest word first, finds the candidates of every place; longer
    words take their place before shorter ones, wherever they stand.
    """
    low = text.lower()
    codes: dict[str, str] = {}
    for w, c in synonyms.items():
        codes.setdefault(w.lower(), c)
    form = _alternation(tuple(sorted(w for w in codes if w)))
    taken: list[tuple[int, int, str]] = []
    free = [(0, len(low))]
    while free:
        hits = []
        for a, b in free:
            at = a
            while m := form.search(low, at, b):
                hits.append((m.start() - m.end(), m.group(), m.start(), m.end(), (a, b)))
                at = m.start() + 1
        if not hits:
            break
        _, word, i, j, part = min(hits)
        taken.append((i, j, codes[word]))
        free.remove(part)
        free += [(part[0], i), (j, part[1])]
    return sorted(taken)


def find_periods(text: str, year: int, quarter: int) -> list[tuple[str, str]]:
    """(type, value) of the periods of a text in order: absolute ones, and relative words at a reference date."""
    out = []
    for m in re.finditer(r"(?:FY\s*)?((?:19|20)\d{2})\s*(?:年)?\s*(H[12]|Q[1-4])?(?!\d)", text, re.I):
        tail = (m.group(2) or "").upper()
        out.append((m.start(), {"": "FY", "H": "HY", "Q": "QUARTER"}[tail[:1]], m.group(1) + tail))
    for word, off in (("去年", -1), ("last year", -1), ("今年", 0), ("this year", 0), ("前年", -2)):
        for m in re.finditer(re.escape(word), text, re.I):
            out.append((m.start(), "FY", str(year + off)))
    for word, off in (("上季度", -1), ("last quarter", -1), ("本季度", 0), ("this quarter", 0)):
        for m in re.finditer(re.escape(word), text, re.I):
            t = year * 4 + quarter - 1 + off
            out.append((m.start(), "QUARTER", f"{t // 4}Q{t % 4 + 1}"))
    return list(dict.fromkeys((k, v) for _, k, v in sorted(out)))


def intent(question: Column, reference: Column, metrics: dict[str, str], entities: dict[str, str], channels: dict[str, str], external: dict[str, str]) -> Column:
    """The slots of each question; an entity outside the scope is masked before anything else is read. Null questions have empty slots."""

    @F.pandas_udf(INTENT)
    def run(q: pd.Series, ref: pd.Series) -> pd.DataFrame:
        rows = []
        when = pd.to_datetime(ref)
        for text, t in zip(q, when):
            text = text or ""
            out = match_all(text, external)
            masked = text
            for a, b, _ in out:
                masked = masked[:a] + " " * (b - a) + masked[b:]
            m = list(dict.fromkeys(c for *_, c in match_all(masked, metrics)))
            e = list(dict.fromkeys(c for *_, c in match_all(masked, entities)))
            c = match_all(masked, channels)
            year, quarter = (t.year, t.quarter) if not pd.isna(t) else (0, 1)
            p = find_periods(masked, year, quarter)
            low = text.lower()
            why = any(x in low for x in NARRATIVE_CUES)
            route = "composite" if m and why else "structured" if m or any(x in low for x in NUMERIC_CUES) else "narrative"
            rows.append((m, e, [{"period_type": k, "period": v} for k, v in p], c[0][2] if c else "TOTAL", out[0][2] if out else None, route, masked))
        return pd.DataFrame(rows, columns=["metrics", "entities", "periods", "channel", "external", "route", "masked"])

    return run(question, reference)


def clarify(i: Column, home: str, reference: Column) -> Column:
    """struct(action, entity, period_type, period): refuse, none, ask or assume with the defaults taken."""
    year = (F.year(reference) - 1).cast("string")
    entity = F.when(F.size(i["entities"]) == 0, F.lit(home)).otherwise(F.get(i["entities"], F.lit(0)))
    has = F.size(i["periods"]) > 0
    action = (
        F.when(i["external"].isNotNull(), "refuse")
        .when(i["route"] == "narrative", "none")
        .when(F.size(i["metrics"]) == 0, "ask")
        .when((F.size(i["entities"]) == 0) | ~has, "assume")
        .otherwise("none")
    )
    return F.struct(action.alias("action"), entity.alias("entity"), F.when(has, F.get(i["periods"], F.lit(0))["period_type"]).otherwise("FY").alias("period_type"), F.when(has, F.get(i["periods"], F.lit(0))["period"]).otherwise(year).alias("period"))


def general(c: Column) -> Column:
    """Numbers with six significant digits and no trailing zeros."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if pd.isna(x) else f"{x:g}")

    return run(c)


def answer(questions: DataFrame, facts: DataFrame, home: str) -> DataFrame:
    """(id, action, status, answer, source_doc_id) of (id, reference_date, i): composed of the fact found, or a plain refusal."""
    c = clarify(F.col("i"), home, F.col("reference_date"))
    q = questions.withColumn("c", c).select(
        "id", F.get("i.metrics", F.lit(0)).alias("metric_code"), "c.entity", "c.period_type", "c.period", F.col("i.channel").alias("channel"), "c.action"
    )
    got = lookup(q, facts)
    label = F.when(F.col("period_type") == "FY", F.concat(F.lit("FY"), "period")).otherwise(F.col("period"))
    what = F.concat_ws(" ", "entity", label, "metric_code")
    text = (
        F.when(F.col("action") == "refuse", "out of scope")
        .when(F.col("action") == "ask", "which metric?")
        .when((F.col("status") == "found") & F.col("value").isNotNull(), F.concat_ws(" ", what, F.lit("="), general(F.col("value")), F.col("unit")))
        .otherwise(F.concat(F.lit("not found: "), what))
    )
    return got.select("id", "action", F.when(F.col("action").isin("refuse", "ask"), "none").otherwise(F.col("status")).alias("status"), text.alias("answer"), F.when(F.col("status") == "found", F.col("source_doc_id")).alias("source_doc_id"))


def carry_forward(turns: DataFrame, key: str = "conv_id", memory: int = 8) -> DataFrame:
    """Turns (key, turn, entity, period, remembered[, route, external]) with both slots filled from the newest ``memory`` remembered turns; what was filled is remembered.

    Where ``route`` is given only structured and composite turns are filled, and turns that name
    a foreign party (``external``) never are.

    An exact fold: long conversations are read in order, the state is ``memory`` pairs.
    """
    kinds = dict(turns.dtypes)
    if "route" not in turns.columns and "external" not in turns.columns:
        # every turn is filled, so a slot once remembered stays: the last remembered value before a turn, as a native window
        w = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        kept = lambda c: F.coalesce(c, F.last(F.when(F.col("remembered"), F.col(c)), True).over(w)).alias(c)
        return turns.select(key, "turn", kept("entity"), kept("period"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn", ignore_index=True)
        seen: list[tuple] = []
        e_out, p_out = [], []
        for e, p, keep, may in zip(pdf.entity, pdf.period, pdf.remembered, pdf.may):
            none = lambda x: x is None or x != x
            fill = lambda x, k: x if not none(x) else next((s[k] for s in reversed(seen) if s[k] is not None), None) if may else None  # noqa: E731, B023
            e2, p2 = fill(e, 0), fill(p, 1)
            e_out.append(e2)
            p_out.append(p2)
            if keep:
                seen = [*seen, (e2, p2)][-memory:]
        return pd.DataFrame({key: pdf[key], "turn": pdf.turn, "entity": e_out, "period": p_out})

    may = F.lit(True)
    if "route" in turns.columns:
        may = may & F.col("route").isin("structured", "composite")
    if "external" in turns.columns:
        may = may & F.col("external").isNull()
    return turns.select(key, "turn", "entity", "period", "remembered", F.coalesce(may, F.lit(False)).alias("may")).groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, turn {kinds['turn']}, entity string, period string")


