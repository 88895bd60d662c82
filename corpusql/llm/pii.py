"""Personal data by candidate spans and gradient-boosted trees, in DataFrame functions alone.

Generators are regexes; the places of their matches come from the lengths of what they match and of what lies between.
Four of them, with fixed validity rules, are the base, and their valid spans always stand. The others look for what the
base misses (written-out addresses, local phone numbers, identity numbers, account numbers, long numbers) and propose
freely, overlaps included. Every candidate gets format features (digits, separators, length, check sum, neighbours) and a
context feature (a cue word in the forty characters before it). Boosted trees of depth two are fitted to these and
become one CASE expression. Thresholds are calibrated by cross-fitting: the documents are dealt into two folds, each
scored by trees that the other one taught, and a family's threshold is the least of these scores that reaches PRECISION
over at least SUPPORT candidates. A family without one, as a rare kind's, selects by the labels' own rule (cue word and
check sum). Selected spans stand in order of their scores, the longer and then the earlier one first where these tie; one
that overlaps a base span or a span that stands is dropped, so only base spans may overlap each other.

Training labels are weak: base candidates by their validity rules, others by their cue word and check sum. Training
counts the candidates of all documents; the driver gets only counts of the distinct feature vectors, whose number is
bounded by the features' small ranges. Every text is scanned whole.

Null and empty texts have no spans. Repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import table

TREES, RATE, PRECISION, SUPPORT = 24, 0.3, 0.95, 20


@dataclass(frozen=True)
class Generator:
    """kind: name; family: whose trees and threshold apply; pattern: Java regex; needs: a cheap condition on texts."""

    kind: str
    family: int
    pattern: str
    needs: str
    base: bool = False


# A run's first match begins where the run does or where the last match ended, so the others need not be tried: with
# these guards and possessive repeats a text without blanks takes linear time.
_DIGITS = r"[0-9]{3}|[0-9]\.[0-9]"
# An account's last group may be short; after a blank it must hold a digit, so that it is no word.
_TAIL = r"(?:[A-Z0-9]{1,3}|\x20(?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})"
GENERATORS = (
    Generator("email", 0, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", base=True),
    Generator("ip", 1, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", base=True),
    Generator("card", 2, r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", base=True),
    Generator("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", base=True),
    Generator("mail_words", 0, r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]{1,64}){1,8}", r"[(\[]at[)\]]"),
    Generator("local_phone", 3, r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", _DIGITS),
    Generator("identity", 4, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]"),
    Generator("account", 5, rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20?[A-Z0-9]{{4}}){{3,7}}{_TAIL}?|(?:\x20?[A-Z0-9]{{4}}){{2}}{_TAIL})(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    Generator("number", 2, r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9A-Za-z])", r"[0-9](?:[\x20-]?[0-9]){11}"),
)
CUES = r"e-?mail|mail|phone|tel|call|mobile|card|visa|account|iban|bank|ssn|social|passport|identity|contact|reach"
FEATURES = ("family", "generator", "length", "digits", "marks", "luhn", "before", "after", "cue")


def matches(text: Column, g: Generator) -> Column:
    """array<struct<start, end, found>> in code points; where a match begins follows from the pieces between matches."""
    found = F.regexp_extract_all(text, F.lit(g.pattern), F.lit(0))
    pieces = F.split(text, g.pattern, -1)
    both = F.arrays_zip(pieces.alias("gap"), found.alias("found"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,found:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.when(x["found"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out")))

    spans = F.aggregate(both, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(g.needs), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,found:string>>"))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    places = F.split(F.reverse(digits), "")
    doubled = F.transform(F.filter(places, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.when(x.cast("int") >= 5, 1).otherwise(0)))
    return (F.length(digits) > 0) & (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0)


def valid(g: Generator, found: Column) -> Column:
    """The base rules."""
    if g.kind == "ip":
        short = F.transform(F.split(found, "\\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return ~F.exists(short, lambda p: (F.length(p) > 3) | (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") > 255))
    if g.kind == "card":
        return F.length(_digits(found)).between(16, 19) & luhn(_digits(found))
    if g.kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def _kind_of_char(text: Column, at: Column) -> Column:
    c = F.substring(text, at, F.lit(1))
    return F.when((at < 1) | (F.length(c) == 0) | c.rlike(r"\s"), 0).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(1)


def featured(text: Column, code: int, g: Generator, spans: Column) -> Column:
    """The candidates with their features, all small integers."""

    def one(x: Column) -> Column:
        found, begin = x["found"], x["start"].cast("int")
        n = F.length(_digits(found))
        before = F.substring(text, F.greatest(F.lit(1), begin - 39), F.least(F.lit(40), begin))
        values = {
            "family": F.lit(g.family),
            "generator": F.lit(code),
            "length": F.least(F.lit(40), F.length(found)),
            "digits": F.least(F.lit(20), n),
            "marks": F.least(F.lit(10), F.length(F.regexp_replace(found, "[A-Za-z0-9]", ""))),
            "luhn": luhn(_digits(found)).cast("int"),
            "before": _kind_of_char(text, begin),
            "after": _kind_of_char(text, x["end"].cast("int") + 1),
            "cue": F.lower(before).rlike(rf"\b(?:{CUES})").cast("int"),
        }
        sure = valid(g, found) if g.base else (values["cue"] == 1) & (F.lit(g.kind != "number") | (values["luhn"] == 1))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), sure.alias("sure"), *(v.cast("int").alias(k) for k, v in values.items()))

    return F.transform(spans, one)


class Trees:
    """Gradient boosting for the logistic loss on integer features, by distinct feature vectors and their counts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, count: np.ndarray, trees: int = TREES, rate: float = RATE):
        self.trees: list[tuple] = []
        self.thresholds: dict[int, float | None] = {}
        self.bias = float(np.log((count[y == 1].sum() + 1) / (count[y == 0].sum() + 1))) if len(x) else -10.0
        score = np.full(len(x), self.bias)
        for _ in range(trees if len(x) else 0):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, count * (y - p), count * p * (1 - p), 2, rate)
            self.trees.append(tree)
            score += self._apply(tree, x)

    def calibrate(self, x: np.ndarray, score: np.ndarray, y: np.ndarray, count: np.ndarray, precision: float = PRECISION) -> None:
        """Thresholds by family from scores that trees gave to candidates they had not seen."""
        for f in np.unique(x[:, 0]) if len(x) else []:
            own = x[:, 0] == f
            self.thresholds[int(f)] = self._threshold(score[own], y[own], count[own], precision)

    def scored(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((self._apply(tree, x) for tree in self.trees), np.zeros(len(x)))

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float):
        total = (g.sum(), h.sum() + 1)
        best = (1e-6, None, None)
        if depth and len(x):
            for f in range(x.shape[1]):
                for cut in np.unique(x[:, f])[:-1]:
                    left = x[:, f] <= cut
                    gl, hl = g[left].sum(), h[left].sum() + 1
                    gain = gl * gl / hl + (total[0] - gl) ** 2 / (total[1] - hl + 1) - total[0] ** 2 / total[1]
                    if gain > best[0]:
                        best = (gain, f, int(cut))
        if best[1] is None:
            return rate * float(total[0] / total[1])
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[left], g[left], h[left], depth - 1, rate), self._grow(x[~left], g[~left], h[~left], depth - 1, rate))

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._apply(low, x), self._apply(high, x))

    @staticmethod
    def _threshold(score: np.ndarray, y: np.ndarray, count: np.ndarray, precision: float) -> float | None:
        """The least score from which on the share of true candidates is ``precision``."""
        order = np.argsort(-score, kind="stable")
        score, good, every = score[order], np.cumsum((count * y)[order]), np.cumsum(count[order])
        last = np.append(score[1:] != score[:-1], True)
        fits = np.flatnonzero(last & (good >= precision * every) & (every >= SUPPORT))
        return float(score[fits[-1]]) if len(fits) else None

    def score(self, x: Column) -> Column:
        def value(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            return F.when(x[FEATURES[tree[0]]] <= tree[1], value(tree[2])).otherwise(value(tree[3]))

        score = F.lit(self.bias)
        for tree in self.trees:
            score = score + value(tree)
        return score

    def chosen(self, x: Column) -> Column:
        """Whether a candidate's ``score`` reaches its family's threshold; without one, whether its label is sure."""
        least = F.lit(None).cast("double")
        for family, t in self.thresholds.items():
            if t is not None:
                least = F.when(x["family"] == family, F.lit(t - 1e-9)).otherwise(least)
        return F.coalesce(x["score"] >= least, x["sure"])


def _candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A column for each generator's candidates."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("_text"))
    rows = rows.withColumns({f"_{g.kind}": matches(F.col("_text"), g) for g in GENERATORS})
    return rows.select(*keep, *(featured(F.col("_text"), i, g, F.col(f"_{g.kind}")).alias(g.kind) for i, g in enumerate(GENERATORS)))


def train(docs: DataFrame) -> Trees:
    """Trees fitted to the candidates of all documents, thresholds from the scores of either fold by the other's trees."""
    rows = _candidates(docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold")), ["fold"])
    every = rows.select("fold", F.explode(F.concat(*(g.kind for g in GENERATORS))).alias("x"))
    counts = every.groupBy(*(F.col(f"x.{k}").alias(k) for k in FEATURES), F.col("x.sure").cast("int").alias("sure"), "fold").count().collect()
    table = np.array(sorted(map(tuple, counts)), np.int64).reshape(-1, len(FEATURES) + 3)
    x, y, fold, count = table[:, : len(FEATURES)], table[:, -3].astype(float), table[:, -2], table[:, -1].astype(float)
    unseen = np.zeros(len(x))
    for k in range(2):
        unseen[fold == k] = Trees(x[fold != k], y[fold != k], count[fold != k]).scored(x[fold == k])
    trees = Trees(x, y, count)
    trees.calibrate(x, unseen, y, count)
    return trees


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _standing(spans: Column) -> Column:
    """Of spans (rank, start, end, ...) those that overlap none of lower rank that stands, by generator, then start."""
    none = F.filter(spans, lambda x: F.lit(False))
    kept = F.aggregate(F.array_sort(spans), none, lambda acc, x: F.when(F.exists(acc, lambda b: _overlap(b, x)), acc).otherwise(F.array_append(acc, x)))
    return F.array_sort(kept, lambda a, b: F.when(a["generator"] != b["generator"], a["generator"] - b["generator"]).otherwise((a["start"] - b["start"]).cast("int")))


def personal_spans(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and an array of (kind, start, end, base) in code points for every row, by kind as listed, then start."""
    rows = _candidates(docs, ["doc_id"])

    def named(g: Generator, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(g.kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(g.base).alias("base")))

    def ranked(g: Generator, code: int) -> Column:
        scored = F.transform(g.kind, lambda x: F.struct(x["family"].alias("family"), x["sure"].alias("sure"), x["start"].alias("start"), x["end"].alias("end"), trees.score(x).alias("score")))
        rank = lambda x: F.struct((-x["score"]).alias("worse"), (x["start"] - x["end"]).alias("shorter"))
        return F.transform(F.filter(scored, trees.chosen), lambda x: F.struct(rank(x).alias("rank"), x["start"].alias("start"), F.lit(code).alias("generator"), x["end"].alias("end"), F.lit(g.kind).alias("kind"), F.lit(False).alias("base")))

    base = F.concat(*(named(g, F.filter(g.kind, lambda x: x["sure"])) for g in GENERATORS if g.base))
    more = F.concat(*(ranked(g, i) for i, g in enumerate(GENERATORS) if not g.base))
    rows = rows.select("doc_id", base.alias("base"), more.alias("more"))
    rows = rows.select("doc_id", "base", F.filter("more", lambda x: ~F.exists("base", lambda b: _overlap(b, x))).alias("free"))
    free = F.when(F.size("free") > 1, _standing(F.col("free"))).otherwise(F.col("free"))
    plain = F.transform(free, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))
    return rows.select("doc_id", F.concat("base", plain).alias("spans"))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_spans(docs, train(docs))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("spans", lambda x: x["base"])

    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(g.kind) for g in GENERATORS if g.base]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
