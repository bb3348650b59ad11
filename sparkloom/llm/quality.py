"""Weak supervision for document quality, with DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0) on a document.  How often each
rule is right is unknown; expectation-maximisation estimates it, with the share of
good documents, from how the rules agree, and the posterior probability of good
decides.  The votes of a document form one of at most 3^rules patterns, so EM runs
on a histogram of patterns whose size does not grow with the data, and each round
brings back two numbers a rule.

Text is measured once, inside whole rows: no word leaves its document, so nothing
but a narrow row of counts a document is ever shuffled or stored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.text import words_column
from sparkloom.plans import written

SYMBOLS = "[#*$%&|<>]"


def _repeat_words(words: Column) -> Column:
    """Words lying in a 3-word window that the text holds twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        at = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def twice(s: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
            hit = F.transform(s, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"]))
            hit = F.filter(hit, lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(i, i + 1, i + 2)))))

        found = F.transform(F.array(F.sort_array(at)), twice)[0]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(found)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    # One-element arrays bind a value once; without them it would be computed again for each use.
    return F.when(F.size(words) < 3, 0).otherwise(F.transform(F.transform(F.array(words), windows), covered)[0])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over every whole text: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, n_caps, n_stops, n_letters, n_run_marks (ASCII marks in runs of one kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def counts(r: Column) -> Column:
        w, ln = r["w"], r["ln"]
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(ln).cast("long").alias("n_lines"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        )

    t = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"),
        F.transform(F.array(F.struct(words_column(text).alias("w"), lines.alias("ln"))), counts)[0].alias("c"),
    )
    removed = lambda pattern: (F.char_length("text") - F.char_length(F.regexp_replace("text", pattern, ""))).cast("long")
    return t.select(
        "doc_id", "c.n_words", "c.word_chars", removed(SYMBOLS).alias("n_symbols"), "c.n_dup_lines", "c.n_repeat_words",
        "c.n_lines", "c.n_distinct", removed("[A-Z]+").alias("n_caps"), removed("[.!?]+").alias("n_stops"),
        removed("\\p{L}+").alias("n_letters"), removed("([!-/:-@\\[-`{-~])\\1+").alias("n_run_marks"),
    )


def default_rules() -> dict[str, Column]:
    """Rules over the columns of ``measure``: 1 good, -1 bad, 0 no opinion."""

    def rule(value: Column, good: Column, bad: Column) -> Column:
        return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)

    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    mean, symbols, caps = F.col("word_chars") / n, F.col("n_symbols") / n, F.col("n_caps") / chars
    lines, repeats = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / n
    letters, runs = F.col("n_letters") / chars, F.col("n_run_marks") / n
    distinct, stops = F.col("n_distinct") / n, F.col("n_stops") / n
    return {
        "length": rule(n, n.between(50, 100_000), n < 20),
        "word_length": rule(mean, mean.between(3, 10), ~mean.between(2, 14)),
        "symbols": rule(symbols, symbols <= 0.02, symbols > 0.1),
        "dup_lines": rule(lines, lines <= 0.1, lines > 0.3),
        "repeats": rule(repeats, repeats <= 0.1, repeats > 0.3),
        "capitals": rule(caps, caps <= 0.1, caps > 0.3),
        "variety": rule(distinct, distinct >= 0.3, (distinct < 0.15) & (n < 2000)),
        "letters": rule(letters, letters >= 0.93, letters < 0.9),
        "mark_runs": rule(runs, runs <= 0.02, runs > 0.2),
        "stops": rule(stops, stops.between(0.005, 0.5), (stops < 0.001) & (n >= 50)),
    }


class LabelModel:
    """Class balance and, for each rule, how likely each vote is for good and for bad documents."""

    def __init__(self, names: list[str], good: float, on_good: list[dict[int, float]], on_bad: list[dict[int, float]]):
        self.names, self.good, self.on_good, self.on_bad = names, good, on_good, on_bad

    @classmethod
    def prior(cls, names: list[str]) -> LabelModel:
        """Most documents are good; a rule rarely calls a good one bad, and knows only some kinds of bad ones."""
        return cls(names, 0.8, [{1: 0.8, -1: 0.003, 0: 0.197} for _ in names], [{1: 0.5, -1: 0.3, 0: 0.2} for _ in names])

    def posterior(self) -> Column:
        """Probability of good, over columns of votes named as the rules are."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for name, g, b in zip(self.names, self.on_good, self.on_bad, strict=True):
            vote = F.col(name)
            odds = odds + F.when(vote == 1, math.log(g[1] / b[1])).when(vote == -1, math.log(g[-1] / b[-1])).otherwise(math.log(g[0] / b[0]))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    @classmethod
    def fit(cls, patterns: DataFrame, names: list[str], rounds: int = 20, tolerance: float = 1e-4) -> LabelModel:
        """EM on the table (votes..., n) of distinct patterns; the prior on an empty table."""
        model = cls.prior(names)
        for _ in range(rounds):
            q, n = F.col("q"), F.col("n")
            sums = [F.sum(n).alias("all"), F.sum(q * n).alias("good")]
            for i, name in enumerate(names):
                for v in (1, -1, 0):
                    here = F.when(F.col(name) == v, n).otherwise(0)
                    sums += [F.sum(q * here).alias(f"g{i}_{v}"), F.sum((1 - q) * here).alias(f"b{i}_{v}")]
            row = patterns.withColumn("q", model.posterior()).agg(*sums).first()
            if not row["all"]:
                return model
            good, bad = row["good"], row["all"] - row["good"]
            # Smoothed by the prior, as if it were worth one document in a hundred.
            weight = 0.01 * row["all"] + 1
            start = cls.prior(names)

            def rates(kind: str, total: float, prior: list[dict[int, float]]) -> list[dict[int, float]]:
                return [{v: (row[f"{kind}{i}_{v}"] + weight * prior[i][v]) / (total + weight) for v in (1, -1, 0)} for i in range(len(names))]  # noqa: B023

            new = cls(names, (good + weight * start.good) / (row["all"] + weight), rates("g", good, start.on_good), rates("b", bad, start.on_bad))
            moved = max(abs(x[v] - y[v]) for old, at in ((model.on_good, new.on_good), (model.on_bad, new.on_bad)) for x, y in zip(old, at, strict=True) for v in (1, -1, 0))
            model = new
            if moved < tolerance:
                break
        return model


def quality_posteriors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Measures, votes, posterior ``quality``, ``base_failed`` and ``kept`` for every document.

    base_failed: under 50 words, or over half of the words in repeated 3-word
    windows; such rows are not kept whatever the posterior says.  Others are kept
    if the posterior reaches ``threshold``.  A null text has no words.  Null and
    repeated ids are kept, one row each; other columns are not read; an empty
    table gives an empty result.
    """
    measured = written(measure(docs, id_col, text_col), "quality-measures")
    rules = default_rules()
    names = list(rules)
    votes = measured.withColumns(rules)
    patterns = written(votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "quality-patterns")
    model = LabelModel.fit(patterns, names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = votes.withColumn("quality", model.posterior()).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
