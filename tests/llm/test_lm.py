import math
import pickle
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import lm
from sparkloom.llm.lm import START, discounts, pair_shard, score_documents, train
from sparkloom.llm.text import words_of


class Plain:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.pairs, self.counts = Counter(), Counter()
        for t in texts:
            words = ["<", *words_of(t), ">"]
            self.pairs.update(zip(words, words[1:], strict=False))
            self.counts.update(words[1:])
        self.before, self.after = Counter(b for _, b in self.pairs), defaultdict(list)
        for (a, _), n in self.pairs.items():
            self.after[a].append(n)
        of = lambda c: discounts(*(sum(v == i for v in c.values()) for i in range(1, 5)))
        self.dp, self.dw = of(self.pairs), of(self.before)
        self.v, self.n = len(self.counts), sum(self.counts.values())

    def low(self, w):
        spread = sum(self.dw[min(n, 3)] for n in self.before.values()) / (self.v + 1)
        n = self.before[w]
        return (max(n - self.dw[min(n, 3)], 0) + spread) / len(self.pairs) if self.pairs else 1.0

    def chance(self, a, w):
        after = self.after.get(a)
        if not after:
            return self.low(w)
        n = self.pairs[a, w]
        left = sum(self.dp[min(m, 3)] for m in after)
        return (max(n - self.dp[min(n, 3)], 0) + left * self.low(w)) / sum(after)

    def score(self, text):
        words = ["<", *words_of(text), ">"]
        tokens = words[1:]
        return (
            len(tokens), sum(self.counts[w] > 0 for w in tokens),
            sum(math.log10((self.counts[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in tokens),
            sum(math.log10(self.chance(a, w)) for a, w in zip(words, tokens, strict=False)),
        )


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_documents(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = Plain([t for i, t in rows if not held_out(i)])
    found = {r["doc_id"]: r for r in score_documents(docs).collect()}
    assert len(found) == len(rows)
    gain = 0.0
    for i, t in rows:
        r = found[i]
        tokens, known, base, score = model.score(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out(i), tokens, known, model.n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
        gain += (score - base) * held_out(i)
    assert gain > 0


def test_sums_to_one(make):
    docs = make(["a b a c", "a b b", "c a b", "d"])
    model, vocabulary = train(docs.select("text"), shard_bytes=4), ["a", "b", "c", "d"]
    plain = Plain([r["text"] for r in docs.collect()])
    for context in ("a", "b", "d", "unseen"):
        total = sum(plain.chance(context.encode(), w.encode()) for w in vocabulary) + plain.chance(context.encode(), ">") + plain.chance(context.encode(), b"never")
        assert total == pytest.approx(1)
    texts = [f"{c} {w}" for c in ("a", "unseen") for w in vocabulary]
    got = model.score(texts)["score"].to_numpy()
    assert got == pytest.approx(np.array([plain.score(t)[3] for t in texts]))


def test_shards_don_t_matter(docs):
    texts = [r["text"] for r in docs.limit(20).collect()]
    one, many = train(docs.select("text"), 1 << 30), train(docs.select("text"), 5_000)
    assert one.totals == many.totals and many.pair_shards > 32
    assert one.score(texts)["score"].to_numpy() == pytest.approx(many.score(texts)["score"].to_numpy())


def test_odd(odd, none, make):
    rows = score_documents(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in rows)
    empty = [r for r in rows if r["doc_id"] in (2, 3, 4)]
    assert len({(r["n_tokens"], r["score"]) for r in empty}) == 1 and empty[0]["n_tokens"] == 1
    assert score_documents(none).count() == 0
    only = next(i for i in range(100) if held_out(i))
    (r,) = score_documents(make([(only, "no training rows", "en", "s")])).collect()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def test_a_frequent_word_is_spread_as_shards_grow():
    rng = np.random.default_rng(0)
    a, b = np.full(200_000, START), rng.integers(0, 1 << 63, size=200_000, dtype=np.uint64)
    for shards in (16, 320, 3200, 32_000):
        held = np.bincount(pair_shard(a, b, shards), minlength=shards)
        assert held.max() < 30 * 200_000 / max(8, shards // 8)


def test_few_arrays_are_open(make, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(40)]
    model = train(make(texts), shard_bytes=400)
    want = model.score(texts)
    monkeypatch.setattr(lm, "MOST_OPEN", 5)
    model = pickle.loads(pickle.dumps(model))
    found = model.score(texts)
    assert len(model._open) <= 5 and found.equals(want) and model.pair_shards > 20
