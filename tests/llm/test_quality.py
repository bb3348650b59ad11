import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm.quality import LabelModel, default_rules, measure, quality_posteriors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(words) < 3000 else None
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), None if inside is None else len(inside)


def compare(docs):
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), "text").collect()
    want = {r["k"]: counted(r["text"]) for r in texts}
    rows = measure(docs.withColumn("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got[:4] == want[r["doc_id"]][:4] and (want[r["doc_id"]][4] is None or got[4] == want[r["doc_id"]][4])


def test_measures(docs, odd, make):
    compare(docs)
    compare(odd)
    compare(make(["a b c a b c", "a a a a", "x y", "l\nl\n\n l", "p q r s p q r t"]))


def test_em_finds_accuracies(spark):
    rng = np.random.default_rng(0)
    n, names = 20_000, ["a", "b", "c", "d", "e"]
    good = rng.random(n) < 0.7
    rates = [(0.9, 0.8), (0.8, 0.7), (0.95, 0.6), (0.7, 0.9), (0.85, 0.85)]  # right on good, right on bad
    votes = np.stack([np.where(rng.random(n) < 0.2, 0, np.where(good, np.where(rng.random(n) < g, 1, -1), np.where(rng.random(n) < b, -1, 1))) for g, b in rates], axis=1)
    df = spark.createDataFrame([tuple(map(int, v)) for v in votes], ", ".join(f"{x} int" for x in names))
    model = LabelModel.fit(df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), names, rounds=60)
    assert model.good == pytest.approx(0.7, abs=0.05)
    for i, (g, b) in enumerate(rates):
        assert model.on_good[i][1] == pytest.approx(0.8 * g, abs=0.05) and model.on_bad[i][-1] == pytest.approx(0.8 * b, abs=0.06)


def test_kept(spark, data, docs):
    rows = {r["doc_id"]: r for r in quality_posteriors(docs).collect()}
    assert len(rows) == docs.count()
    for r in rows.values():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert 0 <= r["quality"] <= 1 and not (r["kept"] and r["base_failed"])
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    fine = [rows[x["doc_id"]]["kept"] for x in labels if x["quality"] == 1 and not rows[x["doc_id"]]["base_failed"]]
    poor = [rows[x["doc_id"]]["kept"] for x in labels if x["quality"] == 0]
    assert np.mean(fine) > 0.95 and np.mean(poor) < 0.3


def test_odd(odd, none):
    assert quality_posteriors(odd).count() == odd.count() and quality_posteriors(none).count() == 0
    assert set(default_rules()) <= set(quality_posteriors(none).columns)
