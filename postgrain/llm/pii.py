"""Personal data in whole texts: base patterns, and boosted trees over further candidates, with DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns and checks and always stay. Generators of high recall propose
further, overlapping spans of the same kinds: numbers with any of the usual separators, bare runs of digits, addresses with
spelled-out signs, and parts of longer numbers: those between spaces, and groups of digits as phones and cards have them.
Their format and context become small whole-number features. There are no labelled spans, so the base rules teach with their
own marks hidden: a candidate is positive when a base span of its kind overlaps it, but no feature tells of its plus sign or
country code. Words before a number and the domain of a spelled-out address are weak labels; in half of the documents the
words are hidden. As features are few-valued, Spark counts the rows of each combination (a table bounded by the product of
the features' ranges), gradient boosting is fitted on these counts, and the trees become one SQL expression. Per kind, the
lowest score at which the candidates held back from the fit have a smoothed precision of ``PRECISION`` is the threshold;
candidates above it that touch no base span and no better candidate are added.

Positions count code points. Quantifiers are possessive where that changes no match, so that long runs need neither deep
recursion nor quadratic time. Nulls and empty texts have no spans. Texts are never cut. Rows are independent of each other;
repeated rows get equal answers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# What the base spans are.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

NUMBER = r"[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9])++"
DIGITS = r"(?<![0-9])[0-9]{7,19}+(?![0-9])"
SPELLED = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)"
    r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++"
)
# Parts of longer numbers: what stands between spaces, and groups of digits.
TIGHT = r"[+(]?[0-9](?:[().\-/]{0,2}[0-9])++"
GROUPED = (
    r"(?<![0-9])(?:[0-9]{4}(?:[\x20.\-/][0-9]{4}){3}|[0-9]{4}[\x20.\-/][0-9]{6}[\x20.\-/][0-9]{5}"
    r"|(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.\-/])[0-9]{3}[\x20.\-/][0-9]{4})(?![0-9])"
)
PREFIX = r"^[+](?:[0-9]{1,3}[\x20./\-]+(?=[(0-9]))?"  # of a phone: what makes it one for the base rule
# Least share of positives, (positives + 1) / (candidates + 2), above a threshold. Spans that no rule knows count against it.
PRECISION = 0.8
# Features of a candidate with the number of values each can have.
FEATURES = {"kind": 4, "generator": 5, "digits": 21, "marks": 7, "round": 2, "luhn": 2, "tail": 2, "topic": 5, "prev": 3, "next": 3}
SPAN = "kind int, start int, stop int"


def _matches(found: DataFrame, name: str, text: str, pattern: str, needs: str, least: int) -> DataFrame:
    """``found`` with the column ``name``: array of (start, stop, hit, prev, next), the matches of a pattern and their sides.

    Matches and the pieces between them come from the same leftmost search; lengths add up to positions. ``needs`` is a
    cheap condition without which there is no match. Matches of fewer than ``least`` characters, which no later check
    would let pass, move the position but are not kept: a text may have very many.
    """
    quoted = "'" + pattern.replace("\\", "\\\\") + "'"
    found = found.withColumn("__hits", F.expr(f"case when {needs} then regexp_extract_all({text}, {quoted}, 0) end"))
    found = found.withColumn("__gaps", F.expr(f"case when size(__hits) > 0 then split({text}, {quoted}, -1) end"))
    # Hits and gaps are read element by element, never by place: where Spark puts an expression in the place of a column,
    # as it does when it pushes a filter down, each look-up by place would search the whole text again.
    folded = F.expr(f"""
      case when size(__hits) > 0 then aggregate(
        zip_with(zip_with(__hits, __gaps, (h, g) -> named_struct('hit', h, 'gap', g)), slice(__gaps, 2, 1073741824),
          (x, after) -> named_struct('hit', x.hit, 'gap', x.gap, 'after', after)),
        named_struct('at', 0, 'out', cast(array() as array<struct<start: int, stop: int, hit: string, prev: string, next: string>>)),
        (a, x) -> named_struct(
          'at', a.at + length(x.gap) + coalesce(length(x.hit), 0),
          'out', case when coalesce(length(x.hit), 0) < {least} then a.out else array_append(a.out, named_struct(
            'start', a.at + length(x.gap), 'stop', a.at + length(x.gap) + length(x.hit), 'hit', x.hit,
            'prev', right(x.gap, 24), 'next', left(x.after, 1))) end),
        a -> a.out) end""")
    return found.withColumn(name, folded).drop("__hits", "__gaps")


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the check sum."""
    doubled = f"2 * int(substring({digits}, -i, 1))"
    return (
        f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + case when i % 2 = 1 then int(substring({digits}, -i, 1)) "
        f"else {doubled} - case when {doubled} > 9 then 9 else 0 end end) % 10 = 0"
    )


def _base(matches: str, kind: int) -> str:
    digits = "regexp_replace(x.hit, '[^0-9]', '')"
    check = {
        "email": "true",
        "ip": r"forall(split(x.hit, '\\.'), p -> length(ltrim('0', p)) < 4 and coalesce(try_cast(ltrim('0', p) as int), 0) < 256)",
        "card": f"case when length({digits}) between 12 and 19 then {_luhn(digits)} else false end",
        "phone": f"length({digits}) between 9 and 15",
    }[KINDS[kind]]
    return f"transform(filter(coalesce({matches}, array()), x -> {check}), x -> named_struct('kind', {kind}, 'start', x.start, 'stop', x.stop))"


def _candidates(matches: str, generator: int) -> str:
    bare = "regexp_replace(x.hit, '{}', '')".format(PREFIX.replace("\\", "\\\\"))
    digits, own = "regexp_replace(x.hit, '[^0-9]', '')", f"regexp_replace({bare}, '[^0-9]', '')"
    kind = "0" if generator == 2 else rf"case when x.hit rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then 1 when length({digits}) >= 12 and x.hit not like '+%' then 2 else 3 end"
    fits = "true" if generator == 2 else f"length({digits}) between 7 and 19"
    side = "case when {0} = '' or {0} rlike '[\\\\x20\\\\x09-\\\\x0D]' then 0 when {0} rlike '[\\\\p{{L}}\\\\p{{N}}]' then 1 else 2 end"
    fields = {
        "kind": kind,
        "generator": str(generator),
        "digits": f"least(length({own}), 20)",
        "marks": f"least(length({bare}) - length({own}), 6)",
        "round": r"int(x.hit rlike '[(\\[]')",
        "luhn": f"case when length({digits}) between 12 and 19 then int({_luhn(digits)}) else 0 end",
        "tail": r"int(x.hit rlike '(?:[.]|dot[)\\]])\\x20?[A-Za-z]{2,}$')" if generator == 2 else r"int(x.hit rlike '[0-9]{3}[-./\\x20][0-9]{4}$')",
        "topic": "case when x.prev rlike '(?i)phone|tel|call|fax|mobile' then 1 when x.prev rlike '(?i)card|visa|credit|pay' then 2 "
        "when x.prev rlike '(?i)mail|contact|write' then 3 when x.prev rlike '(?i)server|host|addr' then 4 else 0 end",
        "prev": side.format("right(x.prev, 1)"),
        "next": side.format("x.next"),
    }
    struct = ", ".join(f"'{k}', int({v})" for k, v in fields.items())
    return (
        f"transform(filter(coalesce({matches}, array()), x -> {fits}), "
        f"x -> named_struct('start', x.start, 'stop', x.stop, {struct}))"
    )


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` (array of kind, start, stop by start, then kind) and ``candidates`` (with features)."""
    digit = f"{text} rlike '[0-9]'"
    patterns = (
        (EMAIL, f"contains({text}, '@')", 5),
        (IP, f"{digit} and contains({text}, '.')", 7),
        (CARD, digit, 12),
        (PHONE, f"contains({text}, '+')", 10),
        (NUMBER, digit, 7),
        (DIGITS, digit, 7),
        (SPELLED, f"(contains({text}, '@') or {text} rlike '[\\\\[(]at[\\\\])]')", 5),
        (TIGHT, digit, 7),
        (GROUPED, digit, 12),
    )
    found = docs
    for k, (pattern, needs, least) in enumerate(patterns):
        found = _matches(found, f"__{k}", text, pattern, needs, least)
    base = ", ".join(_base(f"__{k}", k) for k in range(4))
    order = "array_sort({}, (a, b) -> case when a.start <> b.start then a.start - b.start else a.kind - b.kind end)"
    found = found.withColumn("base", F.expr(order.format(f"concat({base})")))
    # Generators may propose the same span; the first of the best keeps it.
    proposed = ", ".join(_candidates(f"__{4 + k}", k) for k in range(5))
    return found.withColumn("candidates", F.expr(f"concat({proposed})")).drop(*(f"__{k}" for k in range(9)))


@dataclass
class Trees:
    """Boosted trees of depth two: (feature, bound, (feature, bound, left, right) of both sides), and thresholds by kind."""

    start: float
    trees: list[tuple]
    thresholds: list[float]

    def score_sql(self, x: str) -> str:
        """SQL for the log-odds of candidate ``x``."""

        def leaf(side: tuple) -> str:
            feature, bound, low, high = side
            return f"case when {x}.{feature} <= {bound} then {low!r}D else {high!r}D end"

        parts = [f"case when {x}.{f} <= {b} then {leaf(low)} else {leaf(high)} end" for f, b, low, high in self.trees]
        return " + ".join([f"{self.start!r}D", *parts])

    def scores(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full(len(table["kind"]), self.start)
        for f, b, low, high in self.trees:
            sides = [np.where(table[g] <= c, lo, hi) for g, c, lo, hi in (low, high)]
            out += np.where(table[f] <= b, *sides)
        return out


def boost(table: dict[str, np.ndarray], rounds: int = 20, rate: float = 0.3, ridge: float = 1.0, precision: float = PRECISION) -> Trees:
    """Fit trees and thresholds on counted feature combinations: columns of FEATURES, fit (0 or 1), n and n_positive.

    A threshold is no lower than even odds. A kind whose candidates nowhere reach ``precision`` gets none, and none is added.
    """
    here = table["fit"] == 1
    x = {f: table[f][here] for f in FEATURES}
    n, y = table["n"][here].astype(float), table["n_positive"][here].astype(float)
    odds = np.log((y.sum() + 1) / (n.sum() - y.sum() + 1)) if len(n) else 0.0
    model = Trees(float(odds), [], [])
    score = np.full(len(n), odds)

    def split(rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[float, str, int]:
        best = (-1.0, "kind", 0)
        for f, size in FEATURES.items():
            g = np.cumsum(np.bincount(x[f][rows], gradient[rows], size))
            h = np.cumsum(np.bincount(x[f][rows], weight[rows], size))
            gain = g**2 / (h + ridge) + (g[-1] - g) ** 2 / (h[-1] - h + ridge)
            k = int(np.argmax(gain[:-1]))
            best = max(best, (float(gain[k]), f, k), key=lambda b: b[0])
        return best

    for _ in range(rounds if len(n) else 0):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - n * p, n * p * (1 - p)
        _, feature, bound = split(np.ones(len(n), dtype=bool), gradient, weight)
        sides, change = [], np.zeros(len(n))
        for rows in (x[feature] <= bound, x[feature] > bound):
            _, f, b = split(rows, gradient, weight)
            low, high = rows & (x[f] <= b), rows & (x[f] > b)
            values = [float(rate * gradient[r].sum() / (weight[r].sum() + ridge)) for r in (low, high)]
            change += np.where(low, values[0], 0) + np.where(high, values[1], 0)
            sides.append((f, b, *values))
        model.trees.append((feature, bound, *sides))
        score += change
    held = {f: table[f][~here] for f in [*FEATURES, "n", "n_positive"]}
    score = model.scores(held)
    for kind in range(len(KINDS)):
        rows = held["kind"] == kind
        order = np.argsort(-score[rows], kind="stable")
        level = score[rows][order]
        total, right = np.cumsum(held["n"][rows][order]), np.cumsum(held["n_positive"][rows][order])
        good = np.flatnonzero((right + 1 >= precision * (total + 2)) & (level >= 0) & (np.append(level[1:], -np.inf) < level))
        model.thresholds.append(float(level[good[-1]]) if len(good) else float("inf"))
    return model


def train(found: DataFrame, key: str = "doc_id") -> Trees:
    """Trees and thresholds from all candidates of ``found``; a third of the documents calibrates the thresholds."""
    # What the topic words say of numbers, and the domain of a spelled-out address of it.
    weak = "case c.kind when 0 then c.round = 1 and c.tail = 1 when 2 then c.topic = 2 and c.luhn = 1 when 3 then c.topic = 1 and c.digits between 7 and 15 else false end"
    positive = F.expr(f"{weak} or exists(base, b -> b.kind = c.kind and b.start < c.stop and c.start < b.stop)").cast("int")
    shown = F.when(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(2)) > 0, F.col("c.topic")).otherwise(0).alias("topic")
    fit = (F.pmod(F.xxhash64(key), F.lit(3)) > 0).cast("int").alias("fit")
    # An inner explode would have Spark test for candidates by a second search of the texts.
    rows = found.select(F.col(key), fit, "base", F.explode_outer("candidates").alias("c")).filter(F.col("c").isNotNull())
    rows = rows.select("fit", *(shown if f == "topic" else F.col(f"c.{f}") for f in FEATURES), positive.alias("y"))
    counted = rows.groupBy("fit", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_positive"))
    collected = counted.collect()  # bounded by the product of the features' ranges
    names = ["fit", *FEATURES, "n", "n_positive"]
    return boost({c: np.array([r[c] for r in collected], dtype=np.int64) for c in names})


def select(found: DataFrame, model: Trees) -> DataFrame:
    """``found`` with ``spans``: base spans and the chosen candidates, by start, then kind."""
    limits = "array({})".format(", ".join("cast('Infinity' as double)" if t == float("inf") else f"{t!r}D" for t in model.thresholds))
    scored = f"transform(candidates, c -> named_struct('kind', c.kind, 'start', c.start, 'stop', c.stop, 'score', {model.score_sql('c')}))"
    good = f"filter({scored}, c -> c.score >= {limits}[c.kind] and not exists(base, b -> b.start < c.stop and c.start < b.stop))"
    best = "array_sort(__good, (a, b) -> case when a.score <> b.score then case when a.score > b.score then -1 else 1 end when a.stop - a.start <> b.stop - b.start then (b.stop - b.start) - (a.stop - a.start) when a.start <> b.start then a.start - b.start else a.kind - b.kind end)"
    empty = "cast(array() as array<struct<kind: int, start: int, stop: int>>)"
    chosen = f"aggregate({best}, {empty}, (s, c) -> case when exists(s, b -> b.start < c.stop and c.start < b.stop) then s else array_append(s, named_struct('kind', c.kind, 'start', c.start, 'stop', c.stop)) end)"
    order = "array_sort(concat(base, {}), (a, b) -> case when a.start <> b.start then a.start - b.start else a.kind - b.kind end)"
    return found.withColumn("__good", F.expr(good)).withColumn("spans", F.expr(order.format(chosen))).drop("__good")


def listed(spans: str) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = "array({})".format(", ".join(f"'{k}'" for k in KINDS))
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.kind], s.start, s.stop)), ',')")


def redacted(text: str, spans: str) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are covered together."""
    names = "array({})".format(", ".join(f"'[{k.upper()}]'" for k in KINDS))
    return F.expr(f"""
      case when size({spans}) = 0 then {text} else aggregate({spans}, named_struct('at', 0, 'out', ''), (a, s) -> case
        when s.start >= a.at then named_struct('at', s.stop, 'out',
          concat(a.out, substring({text}, a.at + 1, s.start - a.at), {names}[s.kind]))
        else named_struct('at', greatest(a.at, s.stop), 'out', a.out) end,
        a -> concat(a.out, substring({text}, a.at + 1, length({text})))) end""")
