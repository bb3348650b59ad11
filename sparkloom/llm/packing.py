"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Tokens: the tokeniser never joins across white space, nor a letter to the marks after
it, but for letters that it takes apart.  So the distinct words of a few megabytes of text, without their case and closing
marks, are tokenised once and kept in a bounded table, and the ids of the texts are
gathered from theirs.

Packing: pieces are dealt by hash to shards of about ``shard_items``, or of
``shard_bins`` sequences where that is more.  A shard starts
from best-fit decreasing.  Where that misses the lower bound (by total length and by
the pieces that cannot share a sequence), islands evolve the shard's packing as
tasks of their own: crossover injects the other parent's well-filled bins whole,
drops the bins that hold a piece twice, and best-fits what is displaced.  Between
epochs every island hands its elite to the next one.  Each shard's emptiest bin is
then given up, and the bins given up are pooled and packed again, until one shard
is left; so waste does not grow with the number of shards.
"""

from __future__ import annotations

import os
import zlib
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.text import slices
from sparkloom.plans import written

END_ID = 1
#: Closing ASCII marks that the tokeniser cuts from a letter before them; not the apostrophe, which may begin a suffix.
MARKS = ".,;:!?&*$%#|()-+=/\\\"<>[]{}@^_`~"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stands_alone(c: str) -> bool:
    """If marks after a letter are tokenised apart from it: not where its lower case is a letter and a combining mark."""
    return c.isalpha() and len(unicodedata.normalize("NFC", c.lower())) == 1


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that begin at ``start``, joined, and where each ends."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)], ends


class WordTokens:
    """Ids of texts by their words.

    Known words are kept in two generations of at most ``most``: when the younger is full
    it takes the elder's place, and words that are met again move to the new one.
    """

    _open: dict[str, WordTokens] = {}  # a worker serves many tasks

    def __init__(self, path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._encode = Tokenizer.from_file(path).encode_batch_fast
        self._young: dict[str, bytes] = {}
        self._elder: dict[str, bytes] = {}
        self._most = most
        self._mark = self._encode(["0"], add_special_tokens=False)[0].ids

    @classmethod
    def of(cls, path: str) -> WordTokens:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _tokenise(self, words: list[str], at_once: int = 100_000) -> Iterator[tuple[str, bytes]]:
        """Many words as one text, parted by a digit, which is always a token of its own."""
        plain = [w for w in words if "0" not in w]
        for i in range(0, len(plain), at_once):
            part = plain[i : i + at_once]
            ids = np.array(self._encode([" 0 ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut, raw = np.flatnonzero(ids == self._mark[0]), ids.tobytes()
            starts, ends = (4 * np.concatenate(([0], cut + 1))).tolist(), (4 * np.concatenate((cut, [len(ids)]))).tolist()
            yield from zip(part, (raw[a:b] for a, b in zip(starts, ends, strict=True)), strict=True)
        odd = [w for w in words if "0" in w]
        for w, e in zip(odd, self._encode(odd, add_special_tokens=False), strict=True):
            yield w, np.array(e.ids, dtype="<u4").tobytes()

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Joined ids of distinct words, and how many each has."""
        if len(self._young) > self._most:
            self._elder, self._young = self._young, {}
        young, elder = self._young, self._elder
        unknown = []
        for w in words:
            if w not in young:
                found = elder.get(w)
                if found is None:
                    unknown.append(w)
                else:
                    young[w] = found
        young.update(self._tokenise(unknown))
        values = [young[w] for w in words]
        return np.frombuffer(b"".join(values), dtype="<u4"), np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, joined, and how many each text has.  Nulls are empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary
        core = pc.utf8_rtrim(distinct, MARKS)
        # Special tokens are known by their exact text; marks are a run of their own only after a letter.
        last = pc.utf8_slice_codeunits(core, -1).dictionary_encode()
        alone = pa.array([stands_alone(c) for c in last.dictionary.to_pylist()], type=pa.bool_()).take(last.indices)
        apart = pc.and_(alone, pc.invert(pc.match_substring(distinct, "<|")))
        core = pc.if_else(apart, pc.ascii_lower(core), distinct)
        held, full = pc.binary_length(core).to_numpy(zero_copy_only=False), pc.binary_length(distinct).to_numpy(zero_copy_only=False)
        closing = [w.encode()[n:].decode() for w, n in zip(distinct.take(pa.array(np.flatnonzero(held != full))).to_pylist(), held[held != full].tolist(), strict=True)]
        tail = np.full(len(distinct), "", dtype=object)
        tail[held != full] = closing
        core, tail = core.dictionary_encode(), pa.array(tail, type=pa.string()).dictionary_encode()
        n_core = len(core.dictionary)
        flat, size = self._of_words(core.dictionary.to_pylist() + tail.dictionary.to_pylist())
        start = np.cumsum(size) - size
        # The ids of a distinct word are those of its core and then of its marks.
        pieces = np.stack((core.indices.to_numpy(zero_copy_only=False), n_core + tail.indices.to_numpy(zero_copy_only=False)), axis=1).ravel() if len(distinct) else np.empty(0, dtype=np.int64)
        flat, ends = _gathered(flat, start[pieces], size[pieces])
        size = size[pieces].reshape(-1, 2).sum(1)
        start = np.concatenate(([0], ends))[:-1:2] if len(ends) else ends
        index = words.indices.to_numpy(zero_copy_only=False)
        ids, ends = _gathered(flat, start[index], size[index])
        bounds = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(bounds)


def _tokenised(path: str, capacity: int, keep_ids: bool, schema: pa.Schema, at_once: int = 8 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = WordTokens.of(path), np.array([END_ID], dtype="<u4").tobytes()
        for piece in slices(batches, most=at_once):
            ids, counts = tokens.ids(piece["text"])
            raw, at, rows = memoryview(ids.tobytes()), 0, []
            for doc_id, n in zip(piece["doc_id"].to_pylist(), counts.tolist(), strict=True):
                own = raw[4 * at : 4 * (at + n)]
                at += n
                for number, first in enumerate(range(0, n + 1, capacity)):
                    cut, last = own[4 * first : 4 * (first + capacity)], first + capacity > n
                    crc = zlib.crc32(end, zlib.crc32(cut)) if last else zlib.crc32(cut)
                    rows.append((doc_id, number, first, len(cut) // 4 + last, crc, bytes(cut) + end * last if keep_ids else None))
            columns = list(zip(*rows, strict=True))[: len(schema)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by total length and by what cannot share a bin."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    n, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    for a in range(half + 1):
        alone = n[-1] - n[capacity - a]  # longer than capacity - a: nothing of length a or more fits beside
        large, large_sum = n[capacity - a] - n[half], total[capacity - a] - total[half]
        small_sum = total[half] - (total[a - 1] if a else 0)
        best = max(best, int(alone + large + max(0, -(-int(small_sum - (large * capacity - large_sum)) // capacity))))
    return best


def best_fit(items: list[int], lengths: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Put ``items``, longest first, each where it leaves least room; opens bins as needed."""
    bins = bins if bins is not None else []
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: (-lengths[i], i)):
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        insort(room, (left - lengths[i], k))
    return bins


def improved(items: list[int], lengths: list[int], capacity: int, bins: list[list[int]]) -> list[int]:
    """Fill bins up by trading a longer loose item for a shorter one inside; what is loose afterwards.

    The trade that fills a bin best is found by search in the sorted lengths of the loose.
    """
    loose = sorted(items, key=lambda i: -lengths[i])
    known = sorted((lengths[u], -x) for x, u in enumerate(loose))
    for b in bins:
        room = capacity - sum(lengths[i] for i in b)
        if not room or not known:
            continue
        best = (0, 0, 0)
        for y, v in enumerate(b):
            at = bisect_left(known, (lengths[v] + room, 1)) - 1
            if at >= 0 and known[at][0] > lengths[v]:
                best = max(best, (known[at][0] - lengths[v], known[at][1], -y))
        if best[0]:
            x, y = -best[1], -best[2]
            known.pop(bisect_left(known, (lengths[loose[x]], -x)))
            loose[x], b[y] = b[y], loose[x]
            insort(known, (lengths[loose[x]], -x))
    return loose


def _fills(bins: list[list[int]], lengths: list[int]) -> np.ndarray:
    return np.array([sum(lengths[i] for i in b) for b in bins], dtype=np.int64)


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> float:
    """Mean square filling: rises as bins vanish and as full bins get fuller."""
    return float(np.square(_fills(bins, lengths) / capacity).mean()) if bins else 1.0


def crossover(one: list[list[int]], other: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject well-filled bins of ``other`` into ``one``, drop bins with duplicates, best-fit the displaced."""
    fills = _fills(other, lengths)
    good = np.flatnonzero(fills >= np.quantile(fills, rng.uniform(0.3, 0.9)))
    injected = [other[k] for k in rng.choice(good, size=max(1, int(len(good) * rng.uniform(0.3, 1.0))), replace=False)]
    inside = {i for b in injected for i in b}
    kept = [b for b in one if inside.isdisjoint(b)]
    displaced = [i for b in one if not inside.isdisjoint(b) for i in b if i not in inside]
    bins = [list(b) for b in injected] + [list(b) for b in kept]
    return best_fit(improved(displaced, lengths, capacity, bins), lengths, capacity, bins)


def mutate(bins: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Dissolve the emptiest bin and a few others, and best-fit what they held."""
    gone = {int(np.argmin(_fills(bins, lengths))), *rng.choice(len(bins), size=min(len(bins), 2 + len(bins) // 20), replace=False).tolist()}
    items = [i for k in gone for i in bins[k]]
    kept = [list(b) for k, b in enumerate(bins) if k not in gone]
    return best_fit(improved(items, lengths, capacity, kept), lengths, capacity, kept)


def evolve(population: list[list[list[int]]], lengths: list[int], capacity: int, bound: int, generations: int, rng: np.random.Generator, size: int = 6) -> list[list[list[int]]]:
    """Steady-state evolution; ends early at the lower bound.  Best packings first."""
    rank = lambda p: (len(p), -fitness(p, lengths, capacity))
    population = sorted(population, key=rank)
    while len(population) < size:
        population.append(mutate(population[0], lengths, capacity, rng))
    for _ in range(generations):
        if len(population[0]) <= bound:
            break
        a, b = rng.choice(len(population), size=2, replace=False)
        child = crossover(population[a], population[b], lengths, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, lengths, capacity, rng)
        population = sorted([*population, child], key=rank)[:size]
    return population


def _to_bytes(bins: list[list[int]], n: int) -> bytes:
    out = np.empty(n, dtype="<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _from_bytes(raw: bytes) -> list[list[int]]:
    of = np.frombuffer(raw, dtype="<i4")
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)] if len(of) else []


def _seeded(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid")
        lengths = group["length"].to_numpy()
        bins = best_fit(list(range(len(lengths))), lengths.tolist(), capacity)
        return pd.DataFrame(
            [(group["shard"].iloc[0], group["uid"].to_numpy("<i8").tobytes(), lengths.astype("<i4").tobytes(), _to_bytes(bins, len(lengths)), len(bins), lower_bound(lengths, capacity))],
            columns=["shard", "uids", "lengths", "bins", "n_bins", "bound"],
        )

    return run


def _evolved(capacity: int, generations: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in range(len(batch)):
                row = batch.iloc[[r]].copy()
                lengths = np.frombuffer(row["lengths"].iloc[0], dtype="<i4").tolist()
                start = [_from_bytes(x) for x in row["elite"].iloc[0]]
                rng = np.random.default_rng([int(row["shard"].iloc[0]), int(row["island"].iloc[0]), epoch])
                found = evolve(start, lengths, capacity, int(row["bound"].iloc[0]), generations, rng)
                row["elite"] = [[_to_bytes(p, len(lengths)) for p in found[:2]]]
                row["n_bins"] = len(found[0])
                yield row

    return run


def _islands(missed: DataFrame, n_missed: int, capacity: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """Best packing found for each shard that missed its bound; islands are dealt evenly to up to 4096 tasks."""
    tasks = min(4096, islands * n_missed)
    schema = "shard int, uids binary, lengths binary, bound int, island int, elite array<binary>, n_bins int"
    now = missed.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elite", F.array("bins"))
    for epoch in range(epochs):
        dealt = now.select("shard", "uids", "lengths", "bound", "island", "elite", "n_bins").repartition(tasks, "shard", "island")
        now = written(dealt.mapInPandas(_evolved(capacity, generations, epoch), schema), "pack-islands")
        if epoch + 1 < epochs:  # the elite moves on round the ring
            sent = now.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.slice("elite", 1, 1).alias("guest"))
            now = now.join(sent, ["shard", "island"]).withColumn("elite", F.concat("elite", "guest")).drop("guest")
    best = now.groupBy("shard").agg(F.min_by(F.struct("uids", "lengths", F.col("elite")[0].alias("bins"), "n_bins"), F.struct("n_bins", "island")).alias("b"))
    return best.select("shard", "b.uids", "b.lengths", "b.bins")


def _placed(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                uids, lengths, of = (np.frombuffer(x, dtype=t) for x, t in ((r.uids, "<i8"), (r.lengths, "<i4"), (r.bins, "<i4")))
                order = np.argsort(of, kind="stable")
                sizes = lengths[order].astype(np.int64)
                before = np.cumsum(sizes) - sizes
                first = np.concatenate(([True], np.diff(of[order]) != 0)) if len(of) else np.empty(0, dtype=bool)
                offset = before - np.maximum.accumulate(np.where(first, before, 0))
                fills = np.bincount(of, weights=lengths)
                yield pd.DataFrame({"uid": uids[order], "length": sizes, "shard": r.shard, "bin": of[order], "offset": offset, "emptiest": of[order] == int(np.argmin(fills))})

    return run


def pack_lengths(items: DataFrame, capacity: int = 4096, shard_items: int = 4096, shard_bins: int = 32, islands: int = 3, epochs: int = 2, generations: int = 12) -> DataFrame:
    """(uid, sequence_id, offset) for items (uid long, length int from 1 to ``capacity``); uids are distinct.

    A shard has items for ``shard_bins`` bins or more, so giving one up leaves a small part
    for the next level.
    """
    done, level, left = [], 0, items.select("uid", "length")
    while True:
        n, total = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        shards = max(1, min(-(-n // shard_items), total // (capacity * shard_bins)))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).cast("int"))
        seeded = written(dealt.groupBy("shard").applyInPandas(_seeded(capacity), "shard int, uids binary, lengths binary, bins binary, n_bins int, bound int"), "pack-seeded")
        missed = seeded.filter("n_bins > bound")
        packed = seeded.filter("n_bins <= bound").select("shard", "uids", "lengths", "bins")
        if n_missed := missed.count():
            packed = packed.union(_islands(missed, n_missed, capacity, islands, epochs, generations))
        placed = packed.mapInPandas(_placed(capacity), "uid long, length long, shard int, bin int, offset long, emptiest boolean")
        numbered = F.lit(level << 56).bitwiseOR(F.shiftleft(F.col("shard").cast("long"), 20)).bitwiseOR(F.col("bin").cast("long"))
        if shards == 1:
            done.append(placed.select("uid", numbered.alias("sequence_id"), "offset"))
            return reduce(DataFrame.union, done)
        placed = written(placed, "pack-placed")
        done.append(placed.filter("not emptiest").select("uid", numbered.alias("sequence_id"), "offset"))
        left, level = placed.filter("emptiest").select("uid", F.col("length").cast("int").alias("length")), level + 1


def pack_documents(
    docs: DataFrame, capacity: int = 4096, tokenizer_file: str | None = None, keep_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text", **search: int,
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    A document is the ids of its text and an end id.  Only longer ones are cut, into
    pieces of ``capacity`` tokens and a rest.  Returns, a row a piece: doc_id, piece,
    start, length, ids_crc32, sequence_id and offset, and with ``keep_ids`` the ids
    (little-endian 32 bits).  A null or empty text is just the end id.  Null and
    repeated ids are kept, each row packed for itself.  Other columns are not read;
    an empty table gives an empty result.  Sequence numbers may differ between runs.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = _PIECES if keep_ids else pa.schema(list(_PIECES)[:-1])
    pieces = read.mapInArrow(
        _tokenised(tokenizer_file or default_tokenizer(), capacity, keep_ids, schema),
        "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids,
    )
    pieces = written(pieces.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    packed = pack_lengths(pieces.filter(F.col("length") < capacity).select("uid", F.col("length").cast("int").alias("length")), capacity, **search)
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    rest = pieces.join(packed, "uid")
    return full.unionByName(rest).drop("uid")
