import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkloom.llm.packing import MARKS, WordTokens, best_fit, crossover, default_tokenizer, evolve, improved, lower_bound, mutate, pack_documents, pack_lengths


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


TEXTS = [
    "Plain words, and more.", "it's don't we'll 's 'T x'", "a0b 10 0 00 1.5 2024-01-02", "é É café Ünïcödé é!! ́x", "<|endoftext|> <|ENDOFTEXT|> a<|endoftext|>b <|x",
    "***bold*** $5.00 &&& #tag @you (a) [b] {c}", "\x1c odd \x85 spaces　here  x", "日本語のテキスト 🙂🙂", "İstanbul ΣΑΣ ǅ", "", None, " \n\t ", "tail... end?! \"quoted\" `tick` ~x~ a_b c^d", "a´b x’s O’Neil word“ ”word",
]


def test_words_give_the_ids_of_texts(tokenizer, docs):
    texts = TEXTS + [r["text"] for r in docs.collect()]
    tokens = WordTokens(default_tokenizer(), most=500)
    for some in (texts, texts[::-1]):  # the second time from a table already filled, or emptied
        ids, counts = tokens.ids(pa.array(some, type=pa.string()))
        ends = np.cumsum(counts)
        want = tokenizer.encode_batch([t or "" for t in some], add_special_tokens=False)
        for t, a, b, e in zip(some, ends - counts, ends, want, strict=True):
            assert ids[a:b].tolist() == e.ids, t


def test_documents(tokenizer, docs):
    rows = pack_documents(docs, 300, keep_ids=True, shard_items=64).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces, places = defaultdict(dict), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["start"] == 300 * r["piece"]
        pieces[r["doc_id"]][r["piece"]] = r["ids"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        joined = b"".join(pieces[i][k] for k in range(len(pieces[i])))
        assert np.frombuffer(joined, dtype="<u4").tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert all(len(pieces[i][k]) == 1200 for k in range(len(pieces[i]) - 1))
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 300
    bound = lower_bound(np.array([r["length"] for r in rows]), 300)
    assert bound <= len(places) <= 1.01 * bound + 2


def valid(bins, n, lengths, capacity):
    assert sorted(i for b in bins for i in b) == list(range(n)) and all(sum(lengths[i] for i in b) <= capacity for b in bins)


def test_bound_and_best_fit():
    assert lower_bound(np.array([6, 6, 6]), 10) == 3 and lower_bound(np.array([5, 5, 5]), 10) == 2 and lower_bound(np.array([], dtype=int), 10) == 0
    assert lower_bound(np.array([7, 7, 4, 4]), 10) == 3
    for seed in range(5):
        rng = random.Random(seed)
        lengths = [rng.randint(1, 40) for _ in range(12)]
        bins = best_fit(list(range(12)), lengths, 40)
        valid(bins, 12, lengths, 40)
        assert lower_bound(np.array(lengths), 40) <= len(bins)


def test_evolution_beats_best_fit():
    """Triplets that fill bins exactly, which best-fit decreasing misses."""
    rng = np.random.default_rng(5)
    lengths = []
    for _ in range(40):
        a, b = int(rng.integers(30, 40)), int(rng.integers(25, 35))
        lengths += [a, b, 100 - a - b]
    start = best_fit(list(range(120)), lengths, 100)
    assert len(start) > 40
    found = evolve([start], lengths, 100, 40, 400, np.random.default_rng(1))
    valid(found[0], 120, lengths, 100)
    assert len(found[0]) < len(start)
    child = crossover(start, found[0], lengths, 100, rng)
    valid(child, 120, lengths, 100)
    valid(mutate(child, lengths, 100, rng), 120, lengths, 100)


def test_trades():
    """The best trade by comparing all, and found without comparing all."""
    for seed in range(200):
        rng = random.Random(seed)
        lengths = [rng.randint(1, 30) for _ in range(30)]
        bins, loose = best_fit(list(range(20)), lengths, 30), sorted(range(20, 30), key=lambda i: -lengths[i])
        want = [list(b) for b in bins]
        for b in want:
            room = 30 - sum(lengths[i] for i in b)
            trades = [(lengths[u] - lengths[v], -x, -y) for x, u in enumerate(loose) for y, v in enumerate(b) if 0 < lengths[u] - lengths[v] <= room]
            if trades:
                _, x, y = max(trades)
                loose[-x], b[-y] = b[-y], loose[-x]
        assert improved(list(range(20, 30)), lengths, 30, bins) == loose and bins == want

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            self.reads += 1
            return super().__getitem__(i)

    rng = random.Random(1)
    lengths = Counted(rng.randint(1000, 1600) for _ in range(4000))
    improved(list(range(2000, 4000)), lengths, 4096, [[i, i + 1] for i in range(0, 2000, 2)])
    assert lengths.reads < 20 * 4000  # all pairs are four million


def test_islands(spark):
    rng = np.random.default_rng(7)
    lengths = []
    for _ in range(60):
        a, b = int(rng.integers(300, 400)), int(rng.integers(250, 350))
        lengths += [a, b, 1000 - a - b]
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length int")
    rows = pack_lengths(items, 1000, shard_items=60, islands=2, epochs=2, generations=40).collect()
    assert sorted(r["uid"] for r in rows) == list(range(180))
    held = defaultdict(int)
    for r in rows:
        held[r["sequence_id"]] += lengths[r["uid"]]
    assert max(held.values()) <= 1000 and len(held) <= len(best_fit(list(range(180)), lengths, 1000))


def test_odd(odd, none):
    rows = pack_documents(odd).collect()
    assert len({(r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    firsts = [r["doc_id"] for r in rows if r["piece"] == 0]
    assert sorted(firsts, key=str) == sorted((r["doc_id"] for r in odd.select("doc_id").collect()), key=str)
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]
    assert pack_documents(none).count() == 0


def test_letters_before_marks(tokenizer):
    """Every letter of Unicode, in both cases of a word, before every mark."""
    letters = [c for c in map(chr, range(0x80, 0x30000)) if c.isalpha() and not 0x3400 <= ord(c) < 0xA000 and not 0xAC00 <= ord(c) < 0xD7A4 and ord(c) < 0x20000]
    words = [w for n, c in enumerate(letters) for w in (c + MARKS[n % len(MARKS)], "a" + c + MARKS[(n // 7) % len(MARKS)] + MARKS[n % 5])]
    words += [c + m for c in "İक़य़हয়়ড়ﬁשּǅ" for m in MARKS] + ["হয়.", "परे़.", "LİMİ.", "İ:"]
    tokens = WordTokens(default_tokenizer())
    ids, counts = tokens.ids(pa.array(words))
    ends = np.cumsum(counts)
    want = tokenizer.encode_batch(words, add_special_tokens=False)
    assert [w for w, a, b, e in zip(words, ends - counts, ends, want, strict=True) if ids[a:b].tolist() != e.ids] == []


@pytest.mark.parametrize("n", [5000, 20_000])
def test_short_texts_end(make, spark, n):
    """Where a shard of pieces would fit one sequence, levels still shrink."""
    docs = spark.range(n).selectExpr("id as doc_id", "cast(null as string) as text")
    rows = pack_documents(docs).collect()
    assert len(rows) == n and len({r["sequence_id"] for r in rows}) == -(-n // 4096)
    items = spark.range(n).selectExpr("id as uid", "cast(1 + id % 3 as int) as length")
    assert len({r["sequence_id"] for r in pack_lengths(items, 64, shard_items=256).collect()}) <= 1 + -(-2 * n // 64)
