"""Quality rules as a learned decision list; DataFrame expressions throughout.

Sequential covering: a rule for low-quality documents is grown condition by condition on two thirds
of the labelled rows (FOIL gain over thresholds at quantiles), cut back to the prefix that does best
on the last third, and kept if it is precise there; the documents it covers leave, and the next rule
is grown. The rules become one conditional expression, tried in order. The driver handles counts by
feature and threshold only, whose number is fixed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.stage import materialize
from docloom.llm.common import native_words

#: Thresholds of a feature: its quantiles among labelled rows.
QUANTILES = 32
MAX_RULES, MAX_CONDITIONS = 8, 4
#: Share of truly bad rows among those that a rule covers, of the pruning rows, or it is not kept.
PRECISION = 0.9
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_lines_share", "repeat_share", "upper_share", "mark_share", "distinct_share")

Condition = tuple[str, bool, float]  # feature, above (or at most), threshold


def _count(text: Column, signs: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, signs, ""))).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and FEATURES of every whole text (null: empty).

    Words in repeated windows are found without leaving the row: hashes of the windows are sorted
    with their places, equal neighbours are repeats, and the places left, sorted again, give what
    they cover. Only texts with a repeat pay for that. Windows count as equal if 64-bit hashes are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("_text"), native_words(F.col("text")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.trim(F.translate(line, "\t\x0b\f\r", "    ")) != "")
    df = df.withColumn("_lines", lines)
    df = df.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        _count(F.col("_text"), "#*$%&|<>").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").alias("_n_lines"),
        _count(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_upper"),
        _count(F.col("_text"), "!?.,;:").alias("_marks"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
        F.when(F.size("_words") > 3, F.transform(F.sequence(F.lit(1), F.size("_words") - 2), lambda i: F.xxhash64(
            F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2)))).alias("_windows"))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, k: F.get("_sorted", k)["h"] == x["h"]
    places = F.filter("_sorted", lambda x, k: F.coalesce(near(x, k - 1), F.lit(False)) | F.coalesce(near(x, k + 1), F.lit(False)))
    df = df.withColumn("_places", F.sort_array(F.transform(places, lambda x: x["i"]))).drop("_sorted", "_windows")
    covered = F.aggregate(F.transform("_places", lambda p, k: F.least(
        F.lit(3), F.coalesce(F.get("_places", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 6)
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "_n_lines").alias("dup_lines_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_upper", "word_chars").alias("upper_share"), share("_marks", "word_chars").alias("mark_share"),
        share("_distinct", "n_words").alias("distinct_share"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _holds(rule: list[Condition], value) -> Column:
    return reduce(lambda a, b: a & b, [value(f) > F.lit(t) if above else value(f) <= F.lit(t) for f, above, t in rule], F.lit(True))


class Learner:
    """Grows and prunes rules over a table of (bad, prune, bins, n): labelled rows by threshold."""

    def __init__(self, measured: DataFrame, labels: DataFrame):
        known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
        rows = measured.where(~base_failed()).join(known.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"))
        rows = materialize(rows.select(*FEATURES, (F.col("_quality") == 0).alias("bad"),
                                       (F.crc32(F.concat_ws(":", F.lit("prune"), "doc_id").cast("binary")) % 3 == 0).alias("prune")), "labelled")
        steps = [(i + 1) / (QUANTILES + 1) for i in range(QUANTILES)]
        # quantiles of all values, of those above zero (most are zero), and a value halfway to the least of these
        above = {f: F.when(F.col(f) > 0, F.col(f)) for f in FEATURES}
        found = rows.agg(*[F.percentile_approx(f, steps, 2000) for f in FEATURES],
                         *[F.percentile_approx(above[f], steps, 2000) for f in FEATURES],
                         *[F.min(above[f]) / 2 for f in FEATURES]).first()
        k = len(FEATURES)
        self.thresholds = {f: sorted({float(t) for t in [*(found[i] or []), *(found[k + i] or []), found[2 * k + i] or 0.0]})
                           for i, f in enumerate(FEATURES)}
        # a value's bin is the number of thresholds below it: bin <= j says value <= threshold j
        def below(f: str) -> Column:
            return F.size(F.filter(F.array(*map(F.lit, self.thresholds[f])).cast("array<double>"), lambda t: t < F.col(f)))

        bins = F.array(*map(below, FEATURES))
        self.rows = materialize(rows.select("bad", "prune", bins.alias("bins")).groupBy("bad", "prune", "bins").agg(
            F.count("*").alias("n")), "bins")

    def _bin(self, feature: str) -> Column:
        return F.get("bins", F.lit(FEATURES.index(feature)))

    def _covers(self, rule: list[Condition]) -> Column:
        at = {f: {t: j for j, t in enumerate(ts)} for f, ts in self.thresholds.items()}
        return reduce(lambda a, b: a & b, [self._bin(f) > at[f][t] if above else self._bin(f) <= at[f][t] for f, above, t in rule], F.lit(True))

    def _grow(self, left: DataFrame) -> list[Condition]:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            counts = left.where(~F.col("prune") & self._covers(rule)).select(
                "bad", "n", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin").agg(
                F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("all")).collect()
            table: dict[int, dict[int, tuple[int, int]]] = {}
            for r in counts:
                table.setdefault(r.feature, {})[r.bin] = (r.p, r["all"] - r.p)
            if not table:
                break
            total = [sum(x[i] for x in next(iter(table.values())).values()) for i in (0, 1)]
            if not total[0] or not total[1]:
                break
            best, base = None, math.log2(total[0] / sum(total))
            for k, feature in enumerate(FEATURES):
                low = [0, 0]
                for j, t in enumerate(self.thresholds[feature]):
                    low = [low[i] + table.get(k, {}).get(j, (0, 0))[i] for i in (0, 1)]
                    for above, (p, n) in ((False, low), (True, [total[0] - low[0], total[1] - low[1]])):
                        gain = p * (math.log2(p / (p + n)) - base) if p else 0.0
                        # of thresholds as good as one another, the one that covers least
                        tie = best and abs(gain - best[0]) <= 1e-9 and above and best[1][:2] == (feature, True)
                        if p and (not best or gain > best[0] + 1e-9 or tie):
                            best = (gain, (feature, above, t))
            if not best or best[0] <= 1e-9:
                break
            rule.append(best[1])
        return rule

    def _prune(self, left: DataFrame, rule: list[Condition]) -> list[Condition]:
        """The prefix with the best (p - n) / (p + n) on the pruning rows, if it is precise enough."""
        sums = []
        for k in range(1, len(rule) + 1):
            inside = self._covers(rule[:k])
            sums += [F.sum(F.when(inside & F.col("bad"), F.col("n")).otherwise(0)), F.sum(F.when(inside & ~F.col("bad"), F.col("n")).otherwise(0))]
        row = left.where("prune").agg(*sums).first() if sums else []
        worth = []
        for k in range(len(rule)):
            p, n = row[2 * k] or 0, row[2 * k + 1] or 0
            if p and p / (p + n) >= PRECISION:
                worth.append(((p - n) / (p + n), p, -k))
        return rule[:1 - max(worth)[2]] if worth else []

    def learn(self) -> list[list[Condition]]:
        rules: list[list[Condition]] = []
        left = self.rows
        while len(rules) < MAX_RULES:
            rule = self._prune(left, self._grow(left))
            if not rule:
                break
            rules.append(rule)
            left = left.where(~self._covers(rule))
        return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that holds, from 1; null where none does."""
    if not rules:
        return F.lit(None).cast("int")
    first, *rest = [(_holds(r, F.col), F.lit(i + 1)) for i, r in enumerate(rules)]
    return reduce(lambda c, r: c.when(*r), rest, F.when(*first))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the base counts, base_failed, kept, rule, rule_text) of every row.

    Null and empty texts have zero counts and fail; repeated rows are judged alike and come back
    repeated; a null id is judged but teaches nothing; without labels of both kinds there are no
    rules and the base alone decides. An empty table gives no rows; other columns are not looked at.
    """
    measured = materialize(measure(docs), "measured")
    rules = Learner(measured, labels).learn()
    written = [" and ".join(f"{f} {'>' if above else '<='} {t:g}" for f, above, t in r) for r in rules]
    number = verdict(rules)
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & number.isNull()).alias("kept"), number.alias("rule"),
        F.get(F.array(*map(F.lit, written)).cast("array<string>"), number - 1).alias("rule_text"))
