"""Quantities stated in different units, brought to the common unit of their metric.

A hidden Markov model is run over each series (metric, entity, channel, period type) in time
order; the hidden state of a row is its unit. What a row says of its unit is a likelihood over
states: a full name leaves one, a bare sign or a missing scale leaves several at a price, no
statement leaves all. A state is paid for by how far the log value under it jumps from the
smooth level of the series, the running median of the medians of its periods, and every change
of state has a price. Viterbi decoding runs over many series at once in numpy.

Series above ``BLOCK`` rows are decoded in blocks: every block is reduced to the matrix of its
cheapest ways from state to state, the matrices are chained forwards and backwards, and each
block is then decoded between the costs that reach it from both sides, which gives the decoding
of the whole series without any task holding it.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import durable, width

#: Rows of a series decoded in one piece; longer series are decoded in blocks of about this size, with the same result.
BLOCK = 4096
TOLERANCE = 0.005
#: Price of a change of unit, of a jump per unit of the log value and its most, and of all units but the common one where a row says nothing.
SWITCH, JUMP, MOST_JUMP, UNUSUAL = 0.5, 1.0, 9.0, 0.01
#: Periods before and after that make the level of a period.
REACH = 3
CLOSED = 1e9
# Price of reading a statement in another way than the usual one.
NO_SCALE = {1e3: 6.8, 1e6: 6.8, 1e9: 6.8}
OTHER_SCALE = {"mil": {1e3: 1.0}, "th": {1e6: 6.8}}
OTHER_CURRENCY = {"$": {"HKD": 4.0, "SGD": 4.0}}
# Statements that leave several units open at no price, kind -> name -> (factor, offset).
OPEN_UNITS = {
    "temp": {"deg": [(1.0, 0.0), (5.0 / 9.0, -32.0)], "degrees": [(1.0, 0.0), (5.0 / 9.0, -32.0)], "°": [(1.0, 0.0), (5.0 / 9.0, -32.0)]},
    "area": {"sq": [(1.0, 0.0), (0.09290304, 0.0)], "square": [(1.0, 0.0), (0.09290304, 0.0)]},
    "mass": {"ton": [(1.0, 0.0), (1e3, 0.0)]},
}
OPEN_CURRENCIES = {"¥": ["CNY", "JPY"]}

# Names of currencies as written in sources.
CURRENCIES = {
    "USD": ["u.s. dollars", "us dollars", "us dollar", "us$", "usd", "美元", "$"],
    "HKD": ["hong kong dollars", "hk$", "hkd", "港元", "港币"],
    "SGD": ["singapore dollars", "sgd", "s$", "新加坡元", "新元"],
    "CNY": ["yuan", "cny", "rmb", "人民币元", "人民币", "cn¥"],
    "EUR": ["euros", "euro", "eur", "€", "欧元"],
    "GBP": ["pounds sterling", "gbp", "£", "英镑"],
    "JPY": ["japanese yen", "yen", "jpy", "jp¥", "日元", "円"],
    "INR": ["rupees", "inr", "rs.", "rs", "₹", "卢比"],
}
# Names of scales.
SCALES = {
    1e3: ["thousand", "thousands", "'000", "000", "k", "tsd.", "tsd", "th", "千"],
    1e4: ["万", "萬"],
    1e5: ["lakh", "lakhs"],
    1e6: ["million", "millions", "mn", "mm", "m", "mio.", "mio", "mil", "百万", "百萬"],
    1e7: ["crore", "crores", "cr", "千万"],
    1e8: ["亿", "億"],
    1e9: ["billion", "billions", "bn", "b", "mrd.", "mrd", "md", "mds", "十亿"],
}
# Kind -> (factor to the common unit, offset added first) -> names.
UNITS = {
    "ratio": {
        (1.0, 0.0): ["pct", "%", "percent", "pct.", "百分比", "per cent", "prozent", "percentage"],
        (100.0, 0.0): ["ratio", "fraction", "decimal fraction", "decimal"],
        (0.1, 0.0): ["per mille", "‰", "permille", "千分比"],
        (0.01, 0.0): ["bps", "bp", "basis points", "basis point", "基点"],
    },
    "people": {
        (1.0, 0.0): ["persons", "people", "fte heads", "人", "heads", "headcount", "fte", "person", "名"],
        (1e3, 0.0): ["thousand persons", "'000 people", "000 people", "千人", "thousand people", "thousand", "'000"],
        (1e4, 0.0): ["万人", "万名"],
    },
    "area": {
        (1.0, 0.0): ["sqm", "m2", "sq m", "square metres", "square meters", "平方米", "sq. m"],
        (0.09290304, 0.0): ["sqft", "sq ft", "ft2", "square feet", "平方英尺", "sq. ft"],
        (4046.8564224, 0.0): ["ac", "acres", "acre", "英亩"],
        (1e4, 0.0): ["hectare", "ha", "hectares", "公顷"],
    },
    "energy": {
        (1.0, 0.0): ["mwh", "megawatt hours", "兆瓦时"],
        (1e3, 0.0): ["gwh", "gigawatt hours", "吉瓦时"],
        (1e-3, 0.0): ["kwh", "kilowatt hours", "千瓦时"],
        (1e3 / 3600.0, 0.0): ["gj", "gigajoules", "吉焦"],
        (1e6 / 3600.0, 0.0): ["tj", "terajoules", "太焦"],
    },
    "mass": {
        (1.0, 0.0): ["tonne", "t", "tco2e", "metric tons", "吨", "tonnes", "tons", "metric ton"],
        (1e-3, 0.0): ["kg", "kgco2e", "公斤", "kilograms", "千克"],
        (1e3, 0.0): ["kt", "thousand tonnes", "ktco2e", "千吨"],
        (0.00045359237, 0.0): ["lb", "lbs", "pounds", "pound", "磅"],
    },
    "time": {
        (1.0, 0.0): ["days", "d", "天", "calendar days", "day", "日"],
        (7.0, 0.0): ["weeks", "wk", "周", "week", "wks"],
        (1 / 24.0, 0.0): ["hours", "h", "hrs", "小时", "hour", "hr"],
        (1 / 1440.0, 0.0): ["minutes", "min", "分钟", "minute", "mins"],
    },
    "temp": {
        (1.0, 0.0): ["degc", "deg c", "°c", "℃", "摄氏度", "celsius", "c"],
        (5.0 / 9.0, -32.0): ["degf", "deg f", "°f", "℉", "华氏度", "fahrenheit", "f"],
        (1.0, -273.15): ["kelvin", "k", "开尔文"],
    },
}
_NUMBER = re.compile(r"[-+(−]?\s*\d[\d.,\s'’]*\d|[-+(−]?\s*\d")


def _fold(s: str) -> str:
    s = unicodedata.normalize("NFKC", s).lower().replace("_", " ").replace("’", "'").replace("`", "'")
    return re.sub(r"\s+", " ", s).strip(" :;,()[]【】–—-")


_PLAIN = {kind: {_fold(n): u for u, names in table.items() for n in names} for kind, table in UNITS.items()}
_SCALE = {_fold(n): f for f, names in SCALES.items() for n in names} | {"'000": 1e3}
_CCY = sorted([*((_fold(n), c) for c, names in CURRENCIES.items() for n in names), *((n, "") for n in OPEN_CURRENCIES)], key=lambda x: -len(x[0]))


Claim = tuple[tuple[tuple[str, float, float], float], ...]


def parse_claim(text: str | None, kind: str) -> Claim | None:
    """The units a text may state, each (currency or '', scale or factor, offset) with the price of reading it so, or None where it states none."""
    s = _fold(text or "")
    if not s:
        return None
    if kind != "money":
        for name in (s, s.rstrip(".")):
            if name in OPEN_UNITS.get(kind, {}):
                return tuple((("", *u), 0.0) for u in OPEN_UNITS[kind][name])
            if hit := _PLAIN.get(kind, {}).get(name):
                return ((("", *hit), 0.0),)
        return None
    for name, ccy in _CCY:
        if (at := s.find(name)) < 0:
            continue
        rest = (s[:at] + " " + s[at + len(name) :]).strip(" .,-/()")
        factor, other = 1.0, dict(NO_SCALE) if not rest else {}
        for word in rest.split():
            f = _SCALE.get(word) or _SCALE.get(word.rstrip("."))
            if f is None:
                break
            other = {factor * x: c for x, c in OTHER_SCALE.get(word, {}).items()}
            factor *= f
        else:
            money = {c: 0.0 for c in OPEN_CURRENCIES.get(name, [ccy])} | OTHER_CURRENCY.get(name, {})
            return tuple(((c, f, 0.0), pc + pf) for c, pc in money.items() for f, pf in ({factor: 0.0} | other).items())
    return None


def parse_unit(text: str | None, kind: str) -> tuple[str, float, float] | None:
    """The usual reading of :func:`parse_claim`."""
    claim = parse_claim(text, kind)
    return claim[0][0] if claim else None


def parse_number(text: str | None) -> float | None:
    """The figure of a cell text; both 1,234.5 and 1.234,5 and 1 234,5 are read, brackets mean negative."""
    s = unicodedata.normalize("NFKC", text or "")
    m = _NUMBER.search(s.replace("'000", ""))
    if not m:
        return None
    t = re.sub(r"[\s'’]", "", m.group())
    negative = t[0] in "-−("
    t = t.lstrip("-+−(")
    dot, comma = t.rfind("."), t.rfind(",")
    if dot >= 0 and comma >= 0:
        t = t.replace(",", "") if dot > comma else t.replace(".", "").replace(",", ".")
    elif comma >= 0:
        t = t.replace(",", "") if t.count(",") > 1 or re.fullmatch(r"[1-9]\d{0,2},\d{3}", t) else t.replace(",", ".")
    elif t.count(".") > 1:
        t = t.replace(".", "")
    try:
        return -float(t) if negative else float(t)
    except ValueError:
        return None


def _from_label(label: str | None, kind: str) -> Claim | None:
    for sep in ("【", " – in ", " - in ", " — in ", " in ", "(", "（", "[", ", ", "，", " – ", ": ", "/"):
        if label and sep in label:
            hit = parse_claim(label.rsplit(sep, 1)[1].strip(" )）】]"), kind)
            if hit:
                return hit
    return None


def claim_of(unit: str | None, label: str | None, raw: str | None, kind: str) -> Claim | None:
    """What a row says of its unit, looked for in the unit field, the row label and the cell text in turn."""
    hit = parse_claim(unit, kind) or _from_label(label, kind)
    if hit or not raw:
        return hit
    s = unicodedata.normalize("NFKC", raw)
    keep = "'000" in s
    m = _NUMBER.search(s.replace("'000", "\0\0\0\0"))
    rest = (s[: m.start()] + " " + s[m.end() :]) if m else s
    return parse_claim(rest, kind) or (parse_claim(rest.replace("'000", "") + " '000", kind) if keep else None)


def stated_unit(unit: str | None, label: str | None, raw: str | None, kind: str) -> tuple[str, float, float] | None:
    """The usual reading of :func:`claim_of`."""
    claim = claim_of(unit, label, raw, kind)
    return claim[0][0] if claim else None


def states(kind: str) -> list[tuple[str, float, float]]:
    """The hidden states of a kind: every unit it may be stated in."""
    if kind == "money":
        return [(c, f, 0.0) for c in CURRENCIES for f in (1.0, 1e3, 1e4, 1e5, 1e6, 1e7, 1e8, 1e9)]
    return [("", f, o) for f, o in UNITS.get(kind, {(1.0, 0.0): []})]


@functools.lru_cache(maxsize=100_000)
def prices(kind: str, claim: str) -> np.ndarray:
    """Price of every state of a kind under a claim, written as 'state:price ...'; '' claims nothing, states that are not claimed are closed."""
    options = states(kind)
    if not claim:
        usual = options.index(("USD", 1e6, 0.0)) if kind == "money" else 0
        return np.where(np.arange(len(options)) == usual, 0.0, UNUSUAL)
    out = np.full(len(options), CLOSED)
    for part in claim.split():
        i, c = part.split(":")
        out[int(i)] = float(c)
    return out


def viterbi(cost: np.ndarray, start: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Best state of every row.

    cost: (rows, states); start: True where a new series begins; before and after: (series,
    states) costs that reach the first row and leave the last one. Series are decoded side by
    side: step k handles the k-th row of every series that has one. A change of state costs
    ``SWITCH`` whatever the states are, so a step takes one minimum.
    """
    n, s = cost.shape
    if not n:
        return np.zeros(0, np.int64)
    best, stay = np.zeros((n, s)), np.ones((n, s), bool)
    top = np.zeros(n, np.int64)
    heads = np.flatnonzero(start)
    length = np.diff(np.append(heads, n))
    best[heads] = cost[heads]
    if before is not None:
        best[heads] += np.minimum(before, before.min(axis=1, keepdims=True) + SWITCH)
    order = np.argsort(-length, kind="stable")
    h, ln = heads[order], length[order]
    for k in range(1, int(ln[0])):
        r = h[: np.searchsorted(-ln, -k, side="left")] + k
        last = best[r - 1]
        top[r - 1] = last.argmin(axis=1)
        switch = last.min(axis=1, keepdims=True) + SWITCH
        stay[r] = last <= switch
        best[r] = np.minimum(last, switch) + cost[r]
    out = np.zeros(n, dtype=np.int64)
    tails = heads + length - 1
    out[tails] = (best[tails] + (0 if after is None else after)).argmin(axis=1)
    for k in range(int(ln[0]) - 1, 0, -1):
        r = h[: np.searchsorted(-ln, -k, side="left")] + k
        out[r - 1] = np.where(stay[r, out[r]], out[r], top[r - 1])
    return out


def block_matrix(cost: np.ndarray) -> np.ndarray:
    """(states, states) cheapest cost of a block of rows, first row in state i, last row in state j."""
    s = cost.shape[1]
    m = np.where(np.eye(s, dtype=bool), cost[0][:, None], 1e12)
    for row in cost[1:]:
        m = np.minimum(m, m.min(axis=1, keepdims=True) + SWITCH) + row
    return m


def through(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Costs after a block for costs ``v`` before its first row, with the change of state before it."""
    return (np.minimum(v, v.min() + SWITCH)[:, None] + m).min(axis=0)


def back_through(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Costs from the row before a block on, for costs ``v`` from its last row on, with the change of state before it."""
    w = (m + v[None, :]).min(axis=1)
    return np.minimum(w, w.min() + SWITCH)


def _common(kind: str, value: np.ndarray, period: pd.Series, rates: dict[tuple[str, int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value in the common unit, factor) of every row under every state, and the log of it (a tenth of it for temperatures); nan where there is none."""
    options = states(kind)
    factor = np.tile([o[1] for o in options], (len(value), 1))
    if kind == "money":
        years, at = np.unique(pd.to_numeric(period.str[:4], errors="coerce").fillna(0).astype(int).to_numpy(), return_inverse=True)
        fx = np.array([[rates.get((o[0], int(y)), np.nan) for o in options] for y in years])
        factor = factor * (fx[at] if len(value) else 1.0) / 1e6
    common = (value[:, None] + np.array([o[2] for o in options])) * factor
    with np.errstate(divide="ignore", invalid="ignore"):
        level = common / 10.0 if kind == "temp" else np.log(np.abs(common))
    return common, factor, np.where(np.isfinite(level), level, np.nan)


def _costs(kind: str, claims: list[str], x: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Price of every state for every row: what the row says of it and the jump from the level."""
    said = np.stack([prices(kind, c) for c in claims]) if claims else np.zeros(x.shape)
    jump = np.minimum(np.abs(x - level[:, None]) * JUMP, MOST_JUMP)
    none = np.isnan(x)  # no rate of the year, or a figure of 0
    return said + np.where(none, MOST_JUMP, np.where(np.isnan(level)[:, None], 0.0, jump))


KEYS = ["metric_code", "entity", "channel", "period_type", "period"]
_READ = "fact_id long, " + ", ".join(f"{k} string" for k in KEYS) + ", kind string, figure double, claim string, usual double"
_OUT = "common_value double, unit_currency string, unit_factor double, unit_offset double, stated boolean"


def convert(facts: DataFrame, metrics: DataFrame, fx: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every fact with its key, decoded unit and value in the common unit of its metric, as a written table.

    ``stated`` tells whether the row itself says anything of its unit; where it does not, the
    unit is the one that fits the level of its series best. A value that is null and has no
    readable cell text, or money without a rate of its year, gives a null common_value. Facts
    of an unknown metric have stated = false and a null value. Repeated rows stay repeated,
    ties go to the first state, an empty table gives an empty result. metric_def and fx_rate
    are dimension tables of fixed size (21 and 112 rows here); the rates are gathered and
    sent to the executors, one number for every currency and year.
    """
    spark = facts.sparkSession
    rates = {(r.currency, r.fiscal_year): r.usd_per_unit for r in fx.select("currency", "fiscal_year", "usd_per_unit").where(F.col("currency").isin(*CURRENCIES)).collect()}
    kinds = metrics.groupBy("metric_code").agg(F.first("kind").alias("kind"))
    rows = facts.select("fact_id", *KEYS, F.col("value").cast("double"), *[F.col(c).cast("string") for c in ("unit", "raw_label", "raw_value")])
    rows = rows.join(kinds, "metric_code", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    names = [c.split()[0] for c in _READ.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for pdf in batches:
            said = []
            for key in zip(pdf.unit, pdf.raw_label, pdf.raw_value, pdf.kind):
                hit = seen.get(key)
                if hit is None:
                    claim = claim_of(*key)
                    index = {o: i for i, o in enumerate(states(key[3]))}
                    hit = " ".join(f"{index[u]}:{c:g}" for u, c in claim or () if u in index)
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[key] = hit
                said.append(hit)
            value = pdf.value.to_numpy(dtype=float, copy=True)
            for i in np.flatnonzero(np.isnan(value)):
                x = parse_number(pdf.raw_value.iat[i])
                value[i] = np.nan if x is None else x
            pdf["figure"], pdf["claim"], pdf["usual"] = value, said, np.nan
            for kind, g in pdf.groupby("kind", sort=False):
                some = g[g.claim != ""]
                if len(some):
                    x = _common(kind, some.figure.to_numpy(), some.period, rates)[2]
                    pdf.loc[some.index, "usual"] = x[np.arange(len(some)), [int(c.split(":", 1)[0]) for c in some.claim]]
            yield pdf[names]

    series = F.xxhash64(*KEYS[:4])
    ready = durable(rows.mapInPandas(read, _READ).withColumn("series", series), "facts")
    periods = ready.groupBy("series", "period").agg(F.count("*").alias("n"), F.percentile_approx(F.when(~F.isnan("usual"), F.col("usual")), 0.5, 1000).alias("middle"))
    near = Window.partitionBy("series").orderBy("period").rowsBetween(-REACH, REACH)
    around = F.array_sort(F.collect_list("middle").over(near))
    levels = durable(periods.select(
        "series", "period", F.try_element_at(around, F.greatest(F.lit(1), ((F.size(around) + 1) / 2).cast("int"))).alias("level"),
        F.sum("n").over(Window.partitionBy("series")).alias("total"), F.ceil(F.col("n") / block).cast("int").alias("cuts"),
    ), "levels")
    # rows of a period stand in the order of a hash, so that any number of cuts leaves the order as it is
    share = F.least((F.col("turn").cast("double") / float(1 << 63) + 1.0) / 2.0, F.lit(1.0 - 1e-12))
    spread = F.floor(share * F.col("cuts")).cast("int")
    placed = ready.join(levels, ready["series"].eqNullSafe(levels["series"]) & ready["period"].eqNullSafe(levels["period"]), "left").drop(levels["series"]).drop(levels["period"]).withColumn("turn", F.xxhash64(F.lit(1), "fact_id"))
    placed = placed.withColumn("long", F.coalesce(F.col("total") > block, F.lit(False))).withColumn("cut", F.when(F.col("long"), spread).otherwise(0))
    at = [*KEYS, "kind", "figure", "claim", "level", "series", "cut", "turn"]
    short = placed.where(~F.col("long")).select("fact_id", *at).repartition(width(spark), "series").sortWithinPartitions("kind", "series", "period", "turn", "fact_id")
    schema = "fact_id long, " + ", ".join(f"{k} string" for k in KEYS) + ", " + _OUT

    def decoded(g: pd.DataFrame, begins: np.ndarray, before=None, after=None) -> pd.DataFrame:
        kind = g.kind.iat[0]
        common, factor, x = _common(kind, g.figure.to_numpy(dtype=float), g.period, rates)
        state = viterbi(_costs(kind, g.claim.tolist(), x, g.level.to_numpy(dtype=float)), begins, before, after)
        row, options = np.arange(len(g)), states(kind)
        out = g[["fact_id", *KEYS]].copy()
        out["common_value"], out["unit_factor"] = common[row, state], factor[row, state]
        out["unit_currency"], out["unit_offset"] = [options[i][0] for i in state], [options[i][2] for i in state]
        out["stated"] = (g.claim != "").to_numpy()
        return out[[c.split()[0] for c in schema.split(", ")]]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by(batches, ["kind", "series"]):
            for _, g in pdf.groupby("kind", sort=False):
                sid = g.series.to_numpy()
                yield decoded(g, np.append(True, sid[1:] != sid[:-1]))

    out = short.mapInPandas(whole, schema)
    if not levels.where(F.col("total") > block).isEmpty():
        out = out.unionByName(_long(placed.where("long").select("fact_id", *at), decoded, rates, schema))
    return durable(out.withColumn("common_value", F.when(~F.isnan("common_value"), F.col("common_value"))), "converted")


def _by(batches: Iterator[pd.DataFrame], cols: list[str]) -> Iterator[pd.DataFrame]:
    """Batches put together so that no group of rows equal in ``cols`` is parted; the rows come in groups."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        same = np.logical_and.reduce([((c := pdf[k]) == c.iat[-1]).to_numpy() | (c.isna().to_numpy() & pd.isna(c.iat[-1])) for k in cols])
        first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        goes_on = held and all(pdf[k].iat[0] == held[-1][k].iat[-1] or (pd.isna(pdf[k].iat[0]) and pd.isna(held[-1][k].iat[-1])) for k in cols)
        if first or (held and not goes_on):
            ready = [*held, pdf.iloc[:first]] if first else held
            yield pd.concat(ready, ignore_index=True)
            held = [pdf.iloc[first:]]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def _long(rows: DataFrame, decoded, rates: dict, schema: str) -> DataFrame:
    """Rows of series above a block, decoded block by block between the costs from both sides."""
    spark = rows.sparkSession
    keys = ["series", "period", "cut"]
    blocks = durable(rows.repartition(width(spark), *keys).sortWithinPartitions("kind", *keys, "turn", "fact_id"), "blocks")
    # a written file may be read in several parts, so rows are put together again by block
    placed = blocks.repartition(width(spark), *keys).sortWithinPartitions("kind", *keys, "turn", "fact_id")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by(batches, ["kind", *keys]):
            for (kind, sid, cut), part in pdf.groupby(["kind", "series", "cut"], sort=False):
                for period, g in part.groupby("period", sort=False, dropna=False):
                    x = _common(kind, g.figure.to_numpy(dtype=float), g.period, rates)[2]
                    m = block_matrix(_costs(kind, g.claim.tolist(), x, g.level.to_numpy(dtype=float)))
                    yield pd.DataFrame({"series": [sid], "period": pd.Series([None if pd.isna(period) else period], dtype=object), "cut": [cut], "m": [m.ravel()]})

    made = durable(placed.mapInPandas(matrices, "series long, period string, cut int, m array<double>"), "matrices")

    def chain(step):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sid, v = None, None
            for pdf in batches:
                out = []
                for s, p, c, m in zip(pdf.series, pdf.period, pdf.cut, pdf.m):
                    k = math.isqrt(len(m))
                    if s != sid:
                        sid, v = s, np.zeros(k)
                    out.append((s, p, c, v))
                    v = step(v, np.asarray(m).reshape(k, k))
                    v = v - v.min()
                yield pd.DataFrame(out, columns=["series", "period", "cut", "v"])

        return run

    asc, desc = [F.col(k) for k in keys], [F.col("series"), F.col("period").desc(), F.col("cut").desc()]
    first = made.repartition(width(spark), "series").sortWithinPartitions(*asc).mapInPandas(chain(through), "series long, period string, cut int, v array<double>")
    last = made.repartition(width(spark), "series").sortWithinPartitions(*desc).mapInPandas(chain(back_through), "series long, period string, cut int, v array<double>")
    costs = first.withColumnRenamed("v", "before").join(last.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("v").alias("after")), F.col("series").eqNullSafe(F.col("_series")) & F.col("period").eqNullSafe(F.col("_period")) & (F.col("cut") == F.col("_cut")))
    costs = costs.select(*keys, "before", "after")
    # one row with the costs leads the rows of its block
    lead = costs.select(*[F.lit(None).cast(t).alias(c) if c not in keys else F.col(c) for c, t in placed.dtypes], "before", "after", F.lit(0).alias("row"))
    rest = blocks.select("*", F.lit(None).cast("array<double>").alias("before"), F.lit(None).cast("array<double>").alias("after"), F.lit(1).alias("row"))
    both = lead.unionByName(rest).repartition(width(spark), *keys).sortWithinPartitions(*keys, "row", "turn", "fact_id")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by(batches, keys):
            heads = np.flatnonzero(pdf.row.to_numpy() == 0)
            for lo, hi in zip(heads, [*heads[1:], len(pdf)]):
                g = pdf.iloc[lo + 1 : hi].reset_index(drop=True)
                yield decoded(g, np.append(True, np.zeros(len(g) - 1, bool)), np.asarray(pdf.before.iat[lo])[None], np.asarray(pdf.after.iat[lo])[None])

    return both.mapInPandas(solve, schema)


def agreeing_pairs(converted: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(fact_a, fact_b), fact_a smaller: stated in different units, same key, equal within ``tolerance`` of the larger.

    Rows of one key, unit and value are one class. Classes are joined by range: log values are
    cut into bands of the tolerance's width and a class meets only its own and the two
    neighbouring bands, so a hot key does not compare all its rows. Pairs of classes are then
    expanded to their members. ``converted`` is read three times and should be a written table.
    """
    span = -math.log(1.0 - tolerance) * 1.02
    v = F.col("common_value")
    exact = [F.xxhash64(*KEYS), F.xxhash64(F.lit(7), *KEYS), v, F.col("unit_factor"), F.col("unit_offset")]  # a key is its two hashes
    base = converted.where(F.col("stated") & v.isNotNull()).select("fact_id", *[c.alias(n) for c, n in zip(exact, "klvfo")])
    base = base.withColumn("c", F.xxhash64(*"klvfo"))
    x = F.col("v")
    classes = base.groupBy(*"cklvfo").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.log(F.greatest(F.abs(x), F.lit(1e-30))) / span)).withColumn("sign", F.signum(x).cast("int"))
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    a = classes.select("k", "l", "sign", near, *[F.col(n).alias(n + "a") for n in "cvfo"])
    b = classes.select("k", "l", "sign", "band", *[F.col(n).alias(n + "b") for n in "cvfo"])
    unlike = (F.abs(F.col("fa") - F.col("fb")) > 1e-9 * F.abs(F.col("fa"))) | (F.col("oa") != F.col("ob"))
    close = F.abs(F.col("va") - F.col("vb")) <= tolerance * F.greatest(F.abs("va"), F.abs("vb"))
    pairs = a.join(b, ["k", "l", "sign", "band"]).where((F.col("ca") < F.col("cb")) & unlike & close).select("k", "l", "ca", "cb")
    one = base.select("k", "l", F.col("c").alias("ca"), F.col("fact_id").alias("one"))
    two = base.select("k", "l", F.col("c").alias("cb"), F.col("fact_id").alias("two"))
    out = pairs.join(one, ["k", "l", "ca"]).join(two, ["k", "l", "cb"])
    return out.where("one <> two").select(F.least("one", "two").alias("fact_a"), F.greatest("one", "two").alias("fact_b")).distinct()
