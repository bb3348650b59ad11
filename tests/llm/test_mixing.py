from collections import Counter, defaultdict

import pytest

from sparkloom.llm.mixing import document_streams, mix_sources, mixed_documents, source_targets


def level(sizes, weights, cap):
    """Share, cut at the cap and share again until none is above."""
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, w = total - sum(fixed.values()), sum(weights[i] for i in free)
        shares = {i: left * weights[i] / w for i in free}
        over = [i for i in free if shares[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, shares.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 100, 1000], [5, 0, 7, 900, 3, 20, 20], [10], [0, 4]])
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes))]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    found = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = level(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))], 3)
    assert [found[n] for n in names] == pytest.approx(want)


def test_no_words_no_targets(spark):
    df = spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")
    assert [r["target"] for r in source_targets(df).collect()] == [0, 0]


def test_documents(docs):
    rows = mix_sources(docs, block_words=64).taken().collect()
    assert len(rows) == docs.count()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["idx"]] += r["taken"]
        target[r["idx"]] = r["target"]
    assert all(abs(taken[i] - target[i]) <= 1 for i in target)
    again = mix_sources(docs, block_words=64).taken().collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_schedule_is_even(make):
    rows = [(i, "w " * 50, "en", "abc"[i % 3]) for i in range(300)]
    mix = mix_sources(make(rows), block_words=50)
    slots = sorted({(r["position"], r["idx"]) for r in mix.pieces.select("position", "idx").collect() if r["position"] is not None})
    order = [i for _, i in slots]
    share = Counter(order)
    for n in range(40, len(order), 40):  # every beginning of the schedule has about its share of each source
        for i, c in share.items():
            assert abs(order[:n].count(i) - n * c / len(order)) <= 4
    pieces = mix.schedule().collect()
    assert all(0 <= p["from_word"] < 50 and p["from_word"] + p["n_words"] <= 50 for p in pieces)


def test_odd(odd, none):
    rows = mix_sources(odd).taken().collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert [r["taken"] for r in rows if r["size"] == 0] == [0] * sum(r["size"] == 0 for r in rows)
    assert mix_sources(none).taken().count() == 0 and mix_sources(none).schedule().count() == 0


def test_mixed_documents(make, odd, none):
    docs = make([(0, "a b c d", "en", "x"), (1, "e f g h", "en", "y"), (2, "i j k l", "en", "y")])
    taken = {r["doc_id"]: r["taken"] for r in mix_sources(docs).taken().collect()}
    out = mixed_documents(docs).collect()
    assert Counter(r["doc_id"] for r in out) == {i: -(-n // 4) for i, n in taken.items() if n}
    words = Counter()
    for r in out:
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"]) and "abcd"[: len(r["text"].split())] if r["doc_id"] == 0 else True
    assert dict(words) == {i: n for i, n in taken.items() if n}
    assert mixed_documents(odd).columns == odd.columns and mixed_documents(none).count() == 0


def test_rows_alike_are_spread_and_told_apart(spark):
    """A third of all rows alike: one row in the stream's windows, each with a place of its own after it."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.lit(1).alias("idx"), F.lit(7).cast("long").alias("size"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"))
    rows = rows.withColumn("shuffle", F.xxhash64("doc_id")).withColumn("tie", F.lit(5).cast("long"))
    for copies in (4096, 64):
        found = document_streams(rows, 16, copies).collect()
        assert sorted(r["start"] for r in found) == list(range(0, 21_000, 7)) and sum(r["doc_id"] is None for r in found) == 1000


def test_null_ids_fall_into_many_chunks(make):
    mix = mix_sources(make([(None, f"text number {i}", "en", "s") for i in range(500)]), chunks=64)
    assert len({r["shuffle"] % 64 for r in mix.documents.collect()}) > 50
