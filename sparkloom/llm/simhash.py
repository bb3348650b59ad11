"""SimHash near-duplicates through an inverted index on positional bytes, with count filtering.

A fingerprint has eight bytes.  Two that differ in at most d bits differ in at most
d bytes, so they share at least 8 - d positional bytes: the guaranteed minimum of
matches.  Postings of a single byte would hold 1/256 of all fingerprints each, so a
posting is keyed by several: the bytes are dealt to d + 2 groups, of which two agree
in any pair that has the minimum, and each pair of groups is a key, four bytes for
d = 2.  Within a posting the shared positional bytes of each pair are tallied; pairs
that reach the minimum are verified bit by bit, and only a spanning forest of the
links leaves it.

A posting of more than ``crowd`` fingerprints is split: a pair inside that reaches
the minimum shares 8 - d bytes that include the posting's own, so its members meet
again under all such keys, and none of these holds more than 2^(8 d) fingerprints.
There, each member's neighbours at up to d bits are looked up.

Copies share a fingerprint and are gathered by hash aggregation before the index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import components
from sparkloom.llm.lookup import stored_keys, those_known
from sparkloom.llm.text import in_pieces, words_of
from sparkloom.plans import settled, written

BYTES = 8


def fingerprint(words: list[bytes], shingle: int, seed: int = 42) -> int:
    """Majority of the bits of XXH64 over all shingles; 0 for no words."""
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        a, b = starts[at : min(at + (1 << 16), n)].tolist(), ends[at + last : min(at + (1 << 16), n) + last].tolist()
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(piece: pd.DataFrame) -> pd.DataFrame:
        found = np.fromiter((fingerprint(words_of(t), shingle) for t in piece["text"]), dtype=np.uint64, count=len(piece))
        return pd.DataFrame({"doc_id": piece["doc_id"], "fp": found.view(np.int64)})

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def positions(bits: int) -> list[tuple[int, ...]]:
    """The byte positions of each posting: two of ``bits + 2`` groups."""
    groups = [tuple(g.tolist()) for g in np.array_split(np.arange(BYTES), bits + 2)]
    return [a + b for a, b in combinations(groups, 2)]


def finer(own: tuple[int, ...], bits: int) -> list[tuple[int, ...]]:
    """All choices of 8 - bits positions that include ``own``."""
    rest = [i for i in range(BYTES) if i not in own]
    return [own + more for more in combinations(rest, max(0, BYTES - bits - len(own)))]


def _keys(fp: Column, sets: list[tuple[int, ...]]) -> Column:
    """The postings of a fingerprint: each choice of positions with their bytes."""
    masks = [sum(0xFF << (8 * i) for i in kept) for kept in sets]
    return F.array(*[F.struct(F.lit(i).cast("short").alias("positions"), fp.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("bytes")) for i, m in enumerate(masks)])


def _flips(bits: int) -> np.ndarray:
    one = [1 << i for i in range(64)]
    return np.array([sum(c) for r in range(1, bits + 1) for c in combinations(one, r)], dtype=np.uint64)


def matching(x: np.ndarray, bits: int) -> np.ndarray:
    """Of the differences of pairs, those that share 8 - bits positional bytes or more and differ in ``bits`` bits or fewer."""
    tally = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
    found = np.flatnonzero(tally >= BYTES - bits)
    return found[np.bitwise_count(x[found]) <= bits]


def linked_within(members: np.ndarray, bits: int, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (member, root) of the links at up to ``bits`` bits among distinct fingerprints."""
    members = np.sort(members)
    root = np.arange(len(members))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    fixed = np.bitwise_or.reduce(members ^ members[0])
    inside = flips[(flips & ~fixed) == 0]  # bits on which all members agree need no flip
    if len(members) <= 2 * len(inside) + 2:
        pairs = ((i, j) for i in range(len(members)) for j in (i + 1 + matching(members[i + 1 :] ^ members[i], bits)).tolist())
    else:

        def looked_up() -> Iterator[tuple[int, int]]:
            for flip in inside:
                want = members ^ flip
                at = np.minimum(np.searchsorted(members, want), len(members) - 1)
                hit = np.flatnonzero((members[at] == want) & (at > np.arange(len(members))))
                yield from zip(hit.tolist(), at[hit].tolist(), strict=True)

        pairs = looked_up()
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    top = np.array([find(i) for i in range(len(members))], dtype=np.int64)
    joined = np.flatnonzero(top != np.arange(len(members)))
    return members[joined], members[top[joined]]


def _verified(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips = _flips(bits)
        for batch in batches:
            lists = [np.asarray(m, dtype=np.int64).view(np.uint64) for m in batch["members"]]
            pairs = np.array([m for m in lists if len(m) == 2], dtype=np.uint64).reshape(-1, 2)  # most postings
            near = matching(pairs[:, 0] ^ pairs[:, 1], bits)
            a, b = [pairs[near, 0]], [pairs[near, 1]]
            for members in lists:
                if len(members) > 2:
                    x, y = linked_within(members, bits, flips)
                    a.append(x)
                    b.append(y)
            yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    return run


def links_of(distinct: DataFrame, bits: int, crowd: int = 4096) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints (fp) at ``bits`` bits or fewer."""
    spark = distinct.sparkSession
    tasks = min(100_000, max(spark.sparkContext.defaultParallelism, distinct.count() // 250_000))
    sets = positions(bits)
    postings = distinct.repartition(tasks, "fp").select("fp", F.explode(_keys(F.col("fp"), sets)).alias("key")).select("fp", "key.positions", "key.bytes")
    crowded = written(postings.groupBy("positions", "bytes").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("positions", "bytes"), "simhash-crowded")
    gathered = []
    if crowded.limit(1).count():
        wider = [_keys(F.col("fp"), finer(own, bits)) for own in sets]
        many = postings.join(crowded, ["positions", "bytes"], "left_semi")
        many = many.select("fp", F.col("positions").alias("set"), F.explode(F.element_at(F.array(*wider), F.col("positions").cast("int") + 1)).alias("key"))
        gathered.append(many.groupBy("set", "key.positions", "key.bytes").agg(F.collect_list("fp").alias("members")).select("members"))
        postings = postings.join(crowded, ["positions", "bytes"], "left_anti")
    gathered.append(postings.groupBy("positions", "bytes").agg(F.collect_list("fp").alias("members")).select("members"))
    return reduce(DataFrame.union, [g.filter(F.size("members") > 1).mapInPandas(_verified(bits), "a long, b long") for g in gathered])


def with_component(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the least id of each row's component.

    ``rows`` has doc_id and fp, ``distinct`` fp, least (id) and n (rows), ``links`` a and b.
    """
    named = written(components(links), "simhash-components")
    joined = named.join(distinct, named["node"] == distinct["fp"]).select("node", "root", "least")
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    renamed = joined.join(roots, "root").select(F.col("node").alias("fp"), "component_id")
    by_fp = written(distinct.join(renamed, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "simhash-groups")
    # Fingerprints with over a thousandth of all rows, so fewer than a thousand, go to the rows; others meet them in a shuffle.
    total = by_fp.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = F.col("n") > max(1, total // 1000)
    frequent = F.broadcast(by_fp.filter(many).select("fp", "component_id"))
    found = rows.join(frequent, "fp").select("doc_id", "fp", "component_id")
    rest = rows.join(frequent, "fp", "left_anti").join(by_fp.filter(~many), "fp").select("doc_id", "fp", "component_id")
    return found.union(rest)


def simhash_components(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    A-Z is lowered; words are cut at ASCII white space; shingles have ``shingle``
    words, the whole sequence where there are fewer.  Texts that are null or have no
    words get fingerprint zero and are linked like any other.  Fingerprints link at
    ``bits`` or fewer differing bits (at most 3); component_id is the least id
    reachable.  Repeated rows stay; a null id is never a component's least id, and a
    component of null ids only has component_id null.  Other columns are not read;
    an empty table gives an empty result.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(in_pieces(read, _fingerprints(shingle), "doc_id long, fp long"), "simhash-rows")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    found = with_component(rows, distinct, links_of(distinct, bits))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def kept_of(docs: DataFrame, groups: Callable[[], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """The row of each component's least id, with all columns of ``docs``; of rows that repeat it, one.

    ``groups`` gives doc_id and component_id; what it stores for them is deleted.  Rows without an id stay, but for copies of the same text among them.  Only
    repeated rows are shuffled.
    """
    own = lambda: groups().filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    least = settled(own, "simhash-kept").select(F.col("doc_id").alias("key"), "n")
    named = docs.withColumn("__its_key", F.col(id_col).cast("long"))
    out = docs.filter(F.col(id_col).isNull()).dropDuplicates([text_col])
    for some, repeated in ((least.filter("n = 1"), False), (least.filter("n > 1"), True)):
        if n := some.count():
            kept = those_known(named, stored_keys(some.select("key"), n), "__its_key")
            out = out.union(kept.dropDuplicates([id_col]) if repeated else kept)
    return out


def keep_one_of_each(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document, that of the least id, of each component of fingerprints; see ``kept_of``."""
    return kept_of(docs, lambda: simhash_components(docs, shingle, bits, id_col, text_col), id_col, text_col)
