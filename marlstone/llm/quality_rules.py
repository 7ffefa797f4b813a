"""Quality rules as a learned decision list, in Spark expressions.

Statistics of whole texts are columns of built-in functions. Rules are learned by sequential covering: a conjunction of
thresholds grows by the gain in purity over a growing part of the labelled documents, loses conditions while that helps
on a pruning part, and takes the documents it covers with it; the next rule is learned on the rest. The list becomes one
conditional expression, tried from the top, with a default at the end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged

SPACE = r"[\x20\x09-\x0D]+"
#: Labelled documents of each class that rules are learned from: those first in the order of a hash of doc_id.
FIT_ROWS = 8000
#: Quantiles tried as thresholds; conditions of a rule; rules; least purity on the pruning part; least cover there.
CUTS, CONDITIONS, RULES, PURITY, COVER = tuple(i / 20 for i in range(1, 20)), 3, 8, 0.9, 5


def _window_hashes(words: Column, k: int) -> Column:
    last = F.size(words) - k
    at = lambda i, j: F.get(words, i + j)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(at(i, j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def _repeat_words(windows: Column, k: int) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)

    def covered(rows: Column) -> Column:
        twin = lambda i: (F.get(rows, i)["h"] == F.get(rows, i - 1)["h"]) | (F.get(rows, i)["h"] == F.get(rows, i + 1)["h"])
        # get() is null beyond the ends, and null is no match
        hit = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(twin(i), F.get(rows, i)["h"] == F.get(rows, i + 1)["h"], F.get(rows, i)["h"] == F.get(rows, i - 1)["h"], F.lit(False))), lambda i: F.get(rows, i)["i"]))
        # each window adds its words up to the next one's start
        return F.aggregate(hit, F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(k), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])

    # most texts repeat nothing, which is seen without sorting
    return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0)).otherwise(F.element_at(F.transform(F.array(placed), covered), 1))


def text_statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...) of each row of `docs` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split("_text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), *carried)
    base = base.withColumn("_words", words).withColumn("_windows", _window_hashes(F.col("_words"), 5)).withColumn("_lines", lines)
    long = lambda c, name: c.cast("long").alias(name)
    return base.select(
        "doc_id",
        *carried,
        long(F.size("_words"), "n_words"),
        long(F.length(F.regexp_replace("_text", SPACE, "")), "word_chars"),
        long(F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")), "n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines")), "n_dup_lines"),
        long(_repeat_words(F.col("_windows"), 5), "n_repeat_words"),
        long(F.size("_lines"), "n_lines"),
        long(F.size(F.array_distinct("_words")), "n_distinct_words"),
        long(F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")), "n_upper"),
        long(F.length(F.regexp_replace("_text", r"[^!?]+", "")), "n_marks"),
        long(F.length(F.regexp_replace("_text", r"[^0-9]+", "")), "n_digits"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


#: What rules compare with thresholds; each is a share or a mean, so that a text's length alone decides nothing but n_words.
FEATURES: dict[str, Column] = {}


def features() -> dict[str, Column]:
    if not FEATURES:
        FEATURES.update(
            n_words=F.col("n_words").cast("double"),
            mean_word=_ratio("word_chars", "n_words"),
            symbols=_ratio("n_symbols", "n_words"),
            dup_lines=_ratio("n_dup_lines", "n_lines"),
            repeats=_ratio("n_repeat_words", "n_words"),
            distinct=_ratio("n_distinct_words", "n_words"),
            upper=_ratio("n_upper", "word_chars"),
            marks=_ratio("n_marks", "n_words"),
            digits=_ratio("n_digits", "word_chars"),
        )
    return FEATURES


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, value: Column | None = None) -> Column:
        """Over statistics, or over `value`."""
        value = features()[self.feature] if value is None else value
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, learned: bool = False) -> Column:
        """Over statistics, or over columns that are named as the features."""
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.holds(F.col(c.feature) if learned else None)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _counts(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """(bad, good) rows for which each test holds: one aggregate of bounded width."""
    cells = [F.count_if(t & (F.col("bad") == b)).alias(f"c{i}_{b}") for i, t in enumerate(tests) for b in (1, 0)]
    row = rows.agg(*cells).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(tests))]


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule | None:
    rule: tuple[Condition, ...] = ()
    (bad, good), = _counts(rows, [F.lit(True)])
    while len(rule) < CONDITIONS and bad and good:
        options = [Condition(f, above, c) for f, at in cuts.items() for c in at for above in (True, False)]
        scored = []
        held = Rule(rule).holds(learned=True)
        for option, (b, g) in zip(options, _counts(rows.where(held), [o.holds(F.col(o.feature)) for o in options]), strict=True):
            if b:
                gain = b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good)))
                scored.append((gain, str(option), option, b, g))
        best = max(scored, default=None, key=lambda x: (x[0], x[1]))
        if best is None or best[0] <= 0:
            break
        rule, bad, good = (*rule, best[2]), best[3], best[4]
    return Rule(rule) if rule else None


def _first_of_each(marked: DataFrame) -> DataFrame:
    """Of the written rows (doc_id, bad, place) those FIT_ROWS of each class whose hash, place, is smallest.

    Hashes are spread evenly, so a bound on them leaves little more than FIT_ROWS rows of a class to be ranked; it is
    widened until it leaves enough.
    """
    sizes = {row.bad: row.n for row in marked.groupBy("bad").agg(F.count("*").alias("n")).collect()}  # two rows at most
    slack = 2.0
    while True:
        bounds = {bad: -(1 << 63) + int(min(1.0, slack * FIT_ROWS / n) * ((1 << 64) - 1)) for bad, n in sizes.items()}
        under = F.lit(False)
        for bad, bound in bounds.items():
            under = under | ((F.col("bad") == bad) & (F.col("place") <= F.lit(min(bound, (1 << 63) - 1)).cast("long")))
        left = marked.where(under)
        found = {row.bad: row.n for row in left.groupBy("bad").agg(F.count("*").alias("n")).collect()}
        if all(found.get(bad, 0) >= min(n, FIT_ROWS) for bad, n in sizes.items()):
            break
        slack *= 2
    order = Window.partitionBy("bad").orderBy("place", "doc_id")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FIT_ROWS).select("doc_id", "bad")


def learn_rules(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules for bad documents, from docs (doc_id, text) and labels (doc_id, quality: 0 is bad, 1 is good).

    Learns from up to FIT_ROWS documents of each class, without those that fail the base; a third of them, by a hash,
    prunes and judges the rules. No
    labels, or labels of one class, give no rules. A doc_id with both labels counts as bad.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 0).cast("int").alias("bad"))
    chosen = staged(_first_of_each(staged(marked.withColumn("place", F.xxhash64("doc_id")), "rules-marked")), "rules-labels")
    fit = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # of at most 2 * FIT_ROWS rows
    # written first: a filter on the statistics would have them computed twice
    known = staged(text_statistics(fit, "bad").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3))), "rules-statistics")
    rows = staged(known.where(~base_failed()).select("bad", "fold", *(value.alias(name) for name, value in features().items())).coalesce(4), "rules-fit")
    grow, prune, rules = rows.where("fold > 0"), rows.where("fold = 0"), []
    cut_row = grow.agg(*(F.percentile(name, F.array(*map(F.lit, CUTS))).alias(name) for name in features())).first()
    cuts = {name: sorted({round(x, 6) for x in cut_row[name] or ()}) for name in features()}
    while len(rules) < RULES:
        rule = _grow(grow, cuts)
        if rule is None:
            break
        shorter = [Rule(rule.conditions[:i]) for i in range(1, len(rule.conditions) + 1)]
        worth = lambda bg: (bg[0] - bg[1]) / (bg[0] + bg[1]) if sum(bg) else -1.0
        judged = _counts(prune, [r.holds(learned=True) for r in shorter])
        best = max(range(len(shorter)), key=lambda i: (worth(judged[i]), -i))
        bad, good = judged[best]
        if bad < COVER or bad < PURITY * (bad + good):
            break
        rules.append(shorter[best])
        grow, prune = grow.where(~shorter[best].holds(learned=True)), prune.where(~shorter[best].holds(learned=True))
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, the number of the rule that decided from 1, null for the default): the list as conditional expressions."""
    kept, by = F.lit(True), F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        kept, by = F.when(rule.holds(), F.lit(False)).otherwise(kept), F.when(rule.holds(), F.lit(i)).otherwise(by)
    return kept, by


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) of each row.

    `docs` has doc_id long and text string, `labels` doc_id and quality. Words are runs without ASCII white space;
    word_chars counts their characters, n_symbols the characters ``#*$%&|<>``, n_dup_lines the lines with a word that
    equal an earlier one, n_repeat_words the words in 5-word windows that the text has twice or more. base_failed: fewer
    than 10 words, or more than a fifth of them repeated. kept is false then, or if a learned rule holds.

    Null, empty and white-space texts have zeros throughout and fail the base. Without usable labels the base decides.
    Repeated rows give repeated results, a null doc_id stays null, other columns are ignored, an empty table gives no rows.
    """
    statistics = text_statistics(docs)
    kept, by = verdict(learn_rules(docs, labels))
    return statistics.withColumn("base_failed", base_failed()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & kept).alias("kept"), F.when(~F.col("base_failed"), by).alias("rule")
    )
