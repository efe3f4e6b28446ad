"""Quality rules: a decision list learned by sequential covering, over statistics that Spark expressions compute."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.llm.common import BLANKS, let, table
from stemmata.runtime import cut

#: Labelled rows that a list is learned from, at most: those of the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: Cut points tried for each feature.
CUTS = 24
#: Words in a window that counts as repeated.
WINDOW = 5
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("mean_word", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share")


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more. Windows are compared by a 64-bit hash of their words' hashes.

    Linear but for sorting, and the sort runs only where a window does repeat.
    """

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        same = lambda rows, k, j: F.coalesce(F.get(rows, k + j)["g"] == rows[k]["g"], F.lit(False))
        twice = let(ordered, lambda rows: F.filter(rows, lambda x, k: same(rows, k, -1) | same(rows, k, 1)))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        width = let(starts, lambda s: F.transform(s, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - p, F.lit(WINDOW)))))
        return F.aggregate(width, F.lit(0).cast("long"), lambda a, b: a + b)

    grams = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + j] for j in range(WINDOW)])),
    )
    count = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(count)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs as a struct column `row`, and the statistics of text_col as columns; a null text has no words."""
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).select("row", _words(text).alias("words"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_marks"),
        F.regexp_count(text, F.lit("\n")).cast("long").alias("n_breaks"),
    )


def features() -> dict[str, Column]:
    """Ratios that rules test, over the columns of with_statistics()."""
    per = lambda a, b: F.col(a) / F.greatest(b, F.lit(1))
    return {
        "mean_word": per("word_chars", F.col("n_words")),
        "symbol_share": per("n_symbols", F.col("n_words")),
        "upper_share": per("n_upper", F.col("word_chars")),
        "mark_share": per("n_marks", F.col("n_words")),
        "dup_line_share": per("n_dup_lines", F.col("n_breaks") + 1),
        "repeat_share": per("n_repeat_words", F.col("n_words")),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """feature >= cut if above, else feature < cut."""

    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x >= self.cut if self.above else x < self.cut


@dataclass(frozen=True)
class DecisionList:
    """Conjunctions in order; the first that holds rejects, and what none matches is kept."""

    rules: tuple[tuple[Test, ...], ...] = ()

    def kept(self) -> Column:
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(reduce(Column.__and__, [t.column() for t in rule]), F.lit(False)).otherwise(out)
        return out


class _Cells:
    """Labelled statistics: counts of (bins of every feature) by label, for growing or pruning."""

    def __init__(self, cells: list[tuple[tuple[int, ...], int, int]], cuts: dict[str, list[float]]):
        self.cells, self.cuts = cells, cuts

    def where(self, rule, negate: bool = False) -> _Cells:
        holds = lambda bins: all((bins[f] > k) == above for f, above, k in rule)
        return _Cells([c for c in self.cells if holds(c[0]) != negate], self.cuts)

    def counts(self) -> tuple[int, int]:
        return sum(c[1] for c in self.cells), sum(c[2] for c in self.cells)


def _grow(cells: _Cells, n_features: int, most: int = 3):
    """Adds the test of the highest FOIL gain until no negative is left, none gains or there are `most`. Positive: to be rejected."""
    rule: list[tuple[int, bool, int]] = []
    while len(rule) < most:
        p0, n0 = cells.counts()
        if not n0 or not p0:
            break
        best = (0.0, None)
        for f in range(n_features):
            by_bin: dict[int, list[int]] = {}
            for bins, p, n in cells.cells:
                x = by_bin.setdefault(bins[f], [0, 0])
                x[0] += p
                x[1] += n
            below_p = below_n = 0
            for k in sorted(by_bin)[:-1]:
                below_p, below_n = below_p + by_bin[k][0], below_n + by_bin[k][1]
                for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                    if p and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > best[0] + 1e-9:
                        best = (gain, (f, above, k))
        if best[1] is None:
            break
        rule.append(best[1])
        cells = cells.where([best[1]])
    return rule


def _prune(rule, cells: _Cells):
    """Drops final tests while that does not lower (p - n) / (p + n) on the pruning part."""

    def worth(part):
        p, n = cells.where(part).counts()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, least_precision: float = 0.95, least_rows: int = 5) -> DecisionList:
    """Sequential covering over label_col (1: keep, 0: reject): grow a conjunction on two thirds of the sample, prune it on the
    rest, take it if it rejects with least_precision on both parts, remove what it covers, go on while that works.

    The sample is the at most sample_rows labelled ids of smallest hash; ids or labels that are null and ids with more than one
    label are left out. Spark bins its statistics at quantiles and counts them; only those counts come to the driver.
    Without labels of both kinds the list is empty and keeps all.
    """
    known = labels.where(labels[id_col].isNotNull() & labels[label_col].isin(0, 1)).groupBy(labels[id_col].alias("__id")).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).where("lo = hi")
    known = known.select("__id", F.col("lo").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    seen = docs.join(F.broadcast(known), docs[id_col].eqNullSafe(F.col("__id"))).select(docs[id_col].alias("__id"), docs[text_col].alias("text"), "label")
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("row.__id")), F.lit(3)).alias("part")
    stats = with_statistics(seen).select(*[x.alias(c) for c, x in features().items()], F.col("row.label").alias("label"), part, base_failed().alias("failed"))
    # Documents that the base rules reject teach nothing: no list sees them. The filter waits for the statistics of the sample, else it
    # would be pushed below the join and need those of all documents.
    rows = cut(stats).where(~F.col("failed"))
    shares = [i / CUTS for i in range(1, CUTS)]
    cuts = {}
    found = rows.groupBy("label").agg(*[F.percentile_approx(c, shares, 1000).alias(c) for c in FEATURES]).collect()
    for c in FEATURES:
        cuts[c] = sorted({x for r in found for x in (r[c] or ())})
    bins = [reduce(lambda a, k: a + (F.col(c) >= k).cast("int"), cuts[c], F.lit(0)).alias(c) for c in FEATURES]  # noqa: B023
    counted = rows.select("part", "label", *bins).groupBy("part", *FEATURES).agg(F.sum(1 - F.col("label")).alias("p"), F.sum("label").alias("n")).collect()
    cells = [(r["part"], tuple(r[c] for c in FEATURES), r["p"], r["n"]) for r in counted]
    grow, check = (_Cells([c[1:] for c in cells if (c[0] > 0) == up], cuts) for up in (True, False))
    rules = []
    while True:
        rule = _prune(_grow(grow, len(FEATURES)), check)
        (p, n), (q, m) = grow.where(rule).counts(), check.where(rule).counts()
        if not rule or p < least_rows or not q or p < least_precision * (p + n) or q < least_precision * (q + m):
            break
        rules.append(tuple(Test(FEATURES[f], above, cuts[FEATURES[f]][k]) for f, above, k in rule))
        grow, check = grow.where(rule, negate=True), check.where(rule, negate=True)
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """(row, n_words, the base statistics, base_failed, kept) for each row of docs.

    A null or empty text has no words and fails. Repeated rows are judged each; an empty table gives an empty result. The row is
    carried as a struct, so its columns may have any name.
    """
    return with_statistics(docs, text_col).select("row", "n_words", *BASE, base_failed().alias("base_failed"), F.when(base_failed(), F.lit(False)).otherwise(rules.kept()).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps."""
    return judge(docs, rules, text_col).where("kept").select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of documents by rules learned from labels: one row a document; a null text has no words and fails the base rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels"))).select("row.doc_id", "n_words", *BASE, "base_failed", "kept")
