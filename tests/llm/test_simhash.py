import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sparkloom.llm.components import components
from sparkloom.llm.simhash import _flips, fingerprint, finer, keep_one_of_each, linked_within, links_of, matching, positions, simhash_components
from sparkloom.llm.text import words_of


def plain_fingerprint(text, n=3):
    words = words_of(text)
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_components(rows, bits=2):
    """{doc_id: (fingerprint, component)} by comparing all fingerprints."""
    fp = {i: plain_fingerprint(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= bits]
    top = roots(links, fp)
    least = {}
    for i in fp:
        least[top[i]] = min(i, least.get(top[i], i))
    return {i: (f"{fp[i]:016x}", least[top[i]]) for i in fp}


def test_fingerprint_of_spark_hash(spark):
    from pyspark.sql import functions as F

    word = "schöne neue welt"
    native = spark.range(1).select(F.xxhash64(F.lit(word)).alias("h")).first()["h"]
    assert fingerprint(words_of(word), 3) == native % (1 << 64) == xxhash.xxh64_intdigest(word.encode(), 42)


@pytest.mark.parametrize("text", ["", None, "One", "one TWO", "a b c d e f g a b c", "É é " * 200, "x " * 70_000])
def test_fingerprint(text):
    assert fingerprint(words_of(text), 3) == plain_fingerprint(text)


def test_documents(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_components(docs).collect()}
    assert found == plain_components(rows)


def test_near_copies_link_through_each_other(make):
    rng = random.Random(3)
    base = [f"word{rng.randrange(5000)}" for _ in range(400)]
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(400)] = f"other{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_components(make(texts)).collect()}
    assert found == plain_components(list(enumerate(texts)))
    assert len({c for _, c in found.values()}) < 120


@pytest.mark.parametrize("n", [2, 40, 4000])
def test_crowded_posting(n):
    """Both ways to find links inside a posting, against all pairs."""
    rng = np.random.default_rng(n)
    members = np.unique(np.uint64(0xABCDEF) | (rng.integers(0, 1 << 16, size=n, dtype=np.uint64) << np.uint64(40)))
    a, b = linked_within(members, 2, _flips(2))
    top = roots(list(zip(a.tolist(), b.tolist(), strict=True)), members.tolist())
    near = [(int(x), int(y)) for i, x in enumerate(members) for y in members[i + 1 :][np.bitwise_count(members[i + 1 :] ^ x) <= 2]]
    want = roots(near, members.tolist())
    groups = lambda t: sorted(map(tuple, _classes(t)))
    assert groups(top) == groups(want)


def test_every_pair_in_reach_meets():
    """Two fingerprints at d bits share a posting, and a finer one inside it."""
    rng = random.Random(0)
    for bits in (0, 1, 2, 3):
        for _ in range(300):
            x = 0
            for _ in range(bits):
                x |= 1 << rng.randrange(64)
            same = {i for i in range(8) if not x >> (8 * i) & 0xFF}
            met = [p for p in positions(bits) if same.issuperset(p)]
            assert met and all(any(same.issuperset(f) for f in finer(p, bits)) for p in met)
            assert matching(np.array([x], dtype=np.uint64), bits).tolist() == [0]
    assert matching(np.array([0x010101, 0x07, 0x03, 0], dtype=np.uint64), 2).tolist() == [2, 3]


@pytest.mark.parametrize("crowd", [4096, 8, 1])
def test_links_of_crowded_postings(spark, crowd):
    """Postings that are split give the components of all pairs."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, size=6, dtype=np.uint64)
    flips = np.array([1 << int(b) for b in rng.integers(0, 64, size=9)], dtype=np.uint64)
    members = np.unique(np.array([int(base[rng.integers(6)] ^ np.bitwise_xor.reduce(rng.choice(flips, size=rng.integers(1, 6), replace=False))) for _ in range(300)], dtype=np.uint64))
    df = spark.createDataFrame([(x,) for x in members.view(np.int64).tolist()], "fp long")
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links_of(df, 2, crowd).collect()]
    near = [(int(x), int(y)) for i, x in enumerate(members) for y in members[i + 1 :][np.bitwise_count(members[i + 1 :] ^ x) <= 2]]
    assert sorted(map(tuple, _classes(roots(found, members.tolist())))) == sorted(map(tuple, _classes(roots(near, members.tolist()))))


def _classes(top):
    out = defaultdict(list)
    for n, r in sorted(top.items()):
        out[r].append(n)
    return out.values()


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(500, x) for x in range(501, 560)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [x for x in links if x[0] != x[1]]
    assert found == roots(links, {n for x in links for n in x})
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_odd(odd, none, make):
    rows = simhash_components(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["fingerprint"], r["component_id"]))
    assert by[2] == by[3] == by[4] == {("0" * 16, 2)} and by[1] == by[9] and {c for _, c in by[1]} == {1}
    assert ("0" * 16, 2) in by[None]
    assert simhash_components(none).count() == 0
    only = simhash_components(make([(None, "a text", "en", "s")])).collect()
    assert [r["component_id"] for r in only] == [None]


def test_keep_one(odd, none, docs):
    kept = keep_one_of_each(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(1) == 1 and 9 not in ids and 3 not in ids and ids.count(2) == 1
    assert keep_one_of_each(none).count() == 0
    want = {c for _, c in plain_components([(r["doc_id"], r["text"]) for r in docs.collect()]).values()}
    assert {r["doc_id"] for r in keep_one_of_each(docs).collect()} == want
