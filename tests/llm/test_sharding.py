import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from sparkloom.llm.sharding import minimax_cuts, shard_documents


def least_capacity(sizes, k):
    """By trying all ways to cut."""
    best = sum(sizes)
    for cuts in itertools.combinations(range(1, len(sizes)), min(k, len(sizes)) - 1):
        edges = [0, *cuts, len(sizes)]
        best = min(best, max(sum(sizes[a:b]) for a, b in itertools.pairwise(edges)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_least(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 30) for _ in range(9)]
    k = rng.randint(2, 4)
    units = spark.createDataFrame(list(enumerate(sizes)), "unit int, size long")
    row = minimax_cuts(units, k).first()
    rest = [s for u, s in enumerate(sizes) if u not in row["alone"]]
    assert row["capacity"] == least_capacity(rest, k - len(row["alone"]))
    edges = [*sorted(row["cuts"]), 1 << 30]
    held = Counter(sum(e <= u for e in edges) for u in range(9) if u not in row["alone"])
    assert len(held) + len(row["alone"]) <= k


def test_a_giant_gets_a_shard_of_its_own(spark):
    units = spark.createDataFrame([(0, 1000), *[(i, 10) for i in range(1, 13)]], "unit int, size long")
    row = minimax_cuts(units, 4).first()
    assert row["alone"] == [0] and row["capacity"] == 40 and len(row["cuts"]) == 2


def check(rows, texts, n_shards):
    for r in rows:
        assert r["grown_shard"] is None and r["law"] == "bytes" and 0 <= r["shard"] < n_shards
    slots, of = defaultdict(list), {}
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in rows:
        key = (r["size"], r["text_crc32"])
        assert of.setdefault(key, r["shard"]) == r["shard"]
    want = Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == want


def test_documents(spark, docs):
    rows = shard_documents(docs, 6).collect()
    check(rows, [r["text"] for r in docs.select("text").collect()], 6)
    held = Counter()
    for r in rows:
        held[r["shard"]] += r["size"]
    # Greedy filling at the least capacity: no two neighbours could be one shard of that capacity.
    largest = max(r["size"] for r in rows)
    assert len(held) == 6 and max(held.values()) <= sum(held.values()) / 6 + largest


def test_group_of_a_third(make):
    rows = shard_documents(make(["the same text again"] * 300 + [f"text number {i} of many" for i in range(600)]), 24).collect()
    check(rows, ["the same text again"] * 300 + [f"text number {i} of many" for i in range(600)], 24)
    others = Counter(r["shard"] for r in rows)
    shared = others.pop(next(r["shard"] for r in rows if r["size"] == 27))
    assert shared == 300 and len(others) == 23 and max(others.values()) <= 1.3 * 600 / 23


def test_odd(odd, none):
    check(shard_documents(odd).collect(), [r["text"] for r in odd.select("text").collect()], 24)
    assert shard_documents(none).count() == 0
