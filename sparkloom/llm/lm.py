"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Counting: each task turns its documents into pairs of 64-bit word hashes, counts
equal pairs, and sends them to shards by the pair's first word and a class of its
second.  There are an eighth as many classes as shards, so a frequent word is spread
over more shards as they grow in number, and its copies are counted before they travel.  A shard adds up its pairs, stores them as a sorted array of pair hashes with
counts, and sends on what it knows of each word (occurrences, distinct words before
it, and as a context its total and its numbers of pairs seen once, twice and more).
A second set of shards adds these up and stores sorted arrays of word hashes.

Scoring: workers map the arrays into memory and look up the sorted, distinct pairs
and words of each batch; nothing of the model goes through the driver or a broadcast
but a dozen totals.

The model has order 2: with the words of these corpora four in five trigrams occur
once, and their hashes alone would take more room than the texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import arrays
from sparkloom.llm.text import fold, in_pieces, trim, words_of
from sparkloom.plans.stored import new_path

# No word holds white space, so these two cannot be words.
START, END = (np.uint64(xxhash.xxh64_intdigest(mark)) for mark in (b" start", b" end"))
WORD_FIELDS = ("count", "before", "total", "once", "twice", "more", "three", "four")
MOST_TASKS = 100_000
#: Arrays that a worker maps at once; each is a file and a range of its address space.
MOST_OPEN = 1024


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def pair_shard(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each pair."""
    classes = np.uint64(max(8, shards // 8))
    return (mixed(a, mixed(b, b) % classes) % np.uint64(shards)).astype(np.int64)


def pairs_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, tokens of each text) of all tokens with what stands before them; every text ends in END."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for t in texts:
        words = words_of(t)
        hashes.extend(map(digest, words))
        hashes.append(int(END))
        sizes.append(len(words) + 1)
    second, sizes = np.array(hashes, dtype=np.uint64), np.array(sizes, dtype=np.int64)
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[np.cumsum(sizes) - sizes] = START
    return first, second, sizes


def _summed(keys: tuple[np.ndarray, ...], values: dict[str, np.ndarray]) -> tuple[tuple[np.ndarray, ...], dict[str, np.ndarray]]:
    """Sorted distinct keys with added-up values."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return tuple(k[at] for k in keys), {n: np.add.reduceat(v[order], at) if len(at) else v[:0] for n, v in values.items()}


def _narrow(x: np.ndarray) -> bytes:
    """One byte for the width of an item, then the items."""
    most = int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], dtype=f"<u{raw[0]}").astype(np.int64)


def _joined(blobs: pd.Series, wide: bool) -> np.ndarray:
    return np.concatenate([_wide(x) if wide else np.frombuffer(x, dtype="<u8") for x in blobs])


_PAIR_ROWS = "shard int, first binary, runs binary, second binary, count binary"


def _counted(shards: int):
    def run(piece: pd.DataFrame) -> pd.DataFrame:
        a, b, _ = pairs_of(piece["text"].tolist())
        (a, b), n = _summed((a, b), {"n": np.ones(len(a), dtype=np.int64)})
        shard = pair_shard(a, b, shards)
        order = np.argsort(shard, kind="stable")
        rows = []
        for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            new = np.flatnonzero(np.concatenate(([True], a[at][1:] != a[at][:-1])))
            counts = np.diff(np.concatenate((new, [len(at)])))
            rows.append((int(shard[at[0]]), a[at][new].tobytes(), _narrow(counts), b[at].tobytes(), _narrow(n["n"][at])))
        return pd.DataFrame(rows, columns=["shard", "first", "runs", "second", "count"])

    return run


_WORD_ROWS = "shard int, word binary, " + ", ".join(f"{f} binary" for f in WORD_FIELDS)


def _pair_shard(folder: str, word_shards: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        a = np.concatenate([np.repeat(np.frombuffer(f, dtype="<u8"), _wide(r)) for f, r in zip(group["first"], group["runs"], strict=True)])
        (a, b), found = _summed((a, _joined(group["second"], False)), {"n": _joined(group["count"], True)})
        n, key = found["n"], mixed(a, b)
        order = np.argsort(key, kind="stable")
        shard = int(group["shard"].iloc[0])
        arrays.save(folder, f"pairs-{shard}", key[order])
        arrays.save(folder, f"counts-{shard}", np.frombuffer(_narrow(n[order]), dtype=np.uint8))
        trim()
        (firsts,), of_first = _summed((a,), {"total": n, **{f: (n == i).astype(np.int64) for f, i in (("once", 1), ("twice", 2), ("three", 3), ("four", 4))}, "more": (n > 2).astype(np.int64)})
        (seconds,), of_second = _summed((b,), {"count": n, "before": np.ones(len(b), dtype=np.int64)})
        word = np.union1d(firsts, seconds)
        facts = {f: np.zeros(len(word), dtype=np.int64) for f in WORD_FIELDS}
        for keys, some in ((firsts, of_first), (seconds, of_second)):
            place = np.searchsorted(word, keys)
            for f, v in some.items():
                facts[f][place] = v
        to = (mixed(word, word) % np.uint64(word_shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(to[order])) + 1)
        trim()
        return pd.DataFrame([(int(to[p[0]]), word[p].tobytes(), *(_narrow(facts[f][p]) for f in WORD_FIELDS)) for p in parts], columns=["shard", "word", *WORD_FIELDS])

    return run


_TOTALS = ("words", "tokens", *(f"pairs_{i}" for i in range(1, 5)), *(f"before_{i}" for i in range(1, 5)), "distinct", "before_more")


def _word_shard(folder: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        (word,), facts = _summed((_joined(group["word"], False),), {f: _joined(group[f], True) for f in WORD_FIELDS})
        shard = int(group["shard"].iloc[0])
        arrays.save(folder, f"words-{shard}", word)
        for f in ("count", "before", "total", "once", "twice", "more"):
            arrays.save(folder, f"{f}-{shard}", np.frombuffer(_narrow(facts[f]), dtype=np.uint8))
        before = facts["before"]
        return pd.DataFrame(
            [(
                int((facts["count"] > 0).sum()), int(facts["count"].sum()),
                *(int(facts[f].sum()) for f in ("once", "twice", "three", "four")), *(int((before == i).sum()) for i in range(1, 5)),
                int(before.sum()), int((before > 2).sum()),
            )],
            columns=list(_TOTALS),
        )

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """Discounts of counts 0, 1, 2 and above, from how many counts are 1, 2, 3 and 4; 0.5 of what cannot be estimated."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    ratios = ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    return (0.0, *(min(max(k - (k + 1) * y * more / few, 0.05), k - 0.05) if few and more else 0.5 * k for k, few, more in ratios))


class KneserNey:
    """A stored model: ``folder`` of sorted arrays, numbers of shards, and totals."""

    def __init__(self, folder: str, pair_shards: int, word_shards: int, totals: dict[str, int]):
        self.folder, self.pair_shards, self.word_shards, self.totals = folder, pair_shards, word_shards, totals
        self.of_pair = np.array(discounts(*(totals[f"pairs_{i}"] for i in range(1, 5))))
        self.of_word = np.array(discounts(*(totals[f"before_{i}"] for i in range(1, 5))))
        self._open: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def _array(self, name: str, narrow: bool) -> np.ndarray:
        """Sorted hashes, or numbers in the width that their first byte tells.

        Shards are looked up in order, so the array mapped first is let go when there are too many.
        """
        if name not in self._open:
            while len(self._open) >= MOST_OPEN:
                del self._open[next(iter(self._open))]
            try:
                found = arrays.load(self.folder, name, np.uint8 if narrow else "<u8")
            except FileNotFoundError:  # a shard to which nothing was sent
                found = np.empty(0, dtype=np.uint64)
            self._open[name] = found[1:].view(f"<u{found[0]}") if narrow and len(found) else found
        return self._open[name]

    def _look(self, sorted_name: str, shard: np.ndarray, keys: np.ndarray, fields: tuple[str, ...]) -> dict[str, np.ndarray]:
        """Values of distinct keys, 0 where they are unknown."""
        out = {f: np.zeros(len(keys), dtype=np.int64) for f in fields}
        order = np.lexsort((keys, shard))
        for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(keys) else []:
            s = int(shard[at[0]])
            known = self._array(f"{sorted_name}-{s}", False)
            if len(known):
                place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
                hit = known[place] == keys[at]
                for f in fields:
                    out[f][at[hit]] = self._array(f"{f}-{s}", True)[place[hit]]
        return out

    def words(self, words: np.ndarray) -> dict[str, np.ndarray]:
        fields = ("count", "before", "total", "once", "twice", "more")
        return self._look("words", (mixed(words, words) % np.uint64(self.word_shards)).astype(np.int64), words, fields)

    def pair_counts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._look("pairs", pair_shard(a, b, self.pair_shards), mixed(a, b), ("counts",))["counts"]

    def score(self, texts: list[str | None]) -> pd.DataFrame:
        """n_tokens, n_known, base_score and score of each text."""
        a, b, sizes = pairs_of(texts)
        t = self.totals
        vocabulary, n = t["words"], t["tokens"]
        word, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        facts, ia, ib = self.words(word), place[: len(a)], place[len(a) :]
        low = np.zeros(len(word))
        spread = (t["before_1"] * self.of_word[1] + t["before_2"] * self.of_word[2] + t["before_more"] * self.of_word[3]) / (vocabulary + 1)
        if t["distinct"]:
            low = (np.maximum(facts["before"] - self.of_word[np.minimum(facts["before"], 3)], 0) + spread) / t["distinct"]
        else:
            low += 1.0
        pair, of = np.unique(mixed(a, b), return_index=True)
        count = self.pair_counts(a[of], b[of])[np.searchsorted(pair, mixed(a, b))]
        context = {f: facts[f][ia] for f in ("total", "once", "twice", "more")}
        total = np.maximum(context["total"], 1)
        left = self.of_pair[1] * context["once"] + self.of_pair[2] * context["twice"] + self.of_pair[3] * context["more"]
        high = (np.maximum(count - self.of_pair[np.minimum(count, 3)], 0) + left * low[ib]) / total
        chance = np.where(context["total"] > 0, high, low[ib])
        seen = facts["count"][ib]
        base = np.log10((seen + 0.5) / (n + 0.5 * (vocabulary + 1)))
        at = np.cumsum(sizes) - sizes
        return pd.DataFrame({
            "n_tokens": sizes, "n_known": np.add.reduceat((seen > 0).astype(np.int64), at),
            "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(chance), at),
        })


def train(docs: DataFrame, shard_bytes: int = 8 << 20) -> KneserNey:
    """Count the texts of ``docs`` (text) in shards for about ``shard_bytes`` of text each, and store the model."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    pair_shards = max(12, -(-int(size) // shard_bytes))
    word_shards = max(12, pair_shards // 2)
    folder = new_path(docs.sparkSession, "kneser-ney")
    pairs = in_pieces(docs.select("text"), _counted(pair_shards), _PAIR_ROWS)
    # As many tasks as shards, however few partitions the session asks for.
    words = pairs.repartition(min(pair_shards, MOST_TASKS), "shard").groupBy("shard").applyInPandas(_pair_shard(folder, word_shards), _WORD_ROWS)
    totals = words.repartition(min(word_shards, MOST_TASKS), "shard").groupBy("shard").applyInPandas(_word_shard(folder), ", ".join(f"{f} long" for f in _TOTALS))
    found = totals.agg(*(F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in _TOTALS)).first().asDict()
    return KneserNey(folder, pair_shards, word_shards, found)


def score_documents(docs: DataFrame, held_out_of: int = 5, held_out_fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every document.

    The model learns from documents whose crc32(id as text) modulo ``held_out_of``
    isn't ``held_out_fold``; a null id counts as the empty text there.  ``score`` is
    the model's log10 probability of the words and the end; ``base_score`` that of
    add-half unigrams.  A null text is empty: just the end.  Repeated rows count and
    are scored each.  Without training rows both give every token probability 1.
    Other columns are not read; an empty table gives an empty result.
    """
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), held_out_of) == held_out_fold).alias("held_out"), F.col(text_col).alias("text")
    )
    model = train(read.filter(~F.col("held_out")).select("text"))

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        out = model.score(piece["text"].tolist())
        out.insert(0, "doc_id", piece["doc_id"].array)
        out.insert(1, "held_out", piece["held_out"].array)
        return out.assign(train_tokens=model.totals["tokens"], perplexity=10.0 ** (-out["score"] / out["n_tokens"]))

    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long, perplexity double"
    return in_pieces(read, run, columns).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
