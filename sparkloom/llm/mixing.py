"""Mixing sources to target weights by a low-discrepancy schedule, DataFrame functions only.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, ... and share
all words; no target passes ``cap`` times its source's words, and what is cut off
is shared again by weight (a water level over the sources).

Schedule: every source's documents, shuffled by hash, form a stream of words cut
into blocks of ``block_words``.  A source needs K blocks, passes over its stream
counted; it owns K cells of a grid of 2^k cells, and slot n falls in the cell that
is n with its k bits reversed (van der Corput).  So every source gets exactly K
slots, evenly interleaved.  A slot's rank within its source names pass and block.

Ranks and word offsets come from two levels: counts by (source, chunk), then a
window within each; a source with a third of all rows is spread over ``chunks`` by the
hash of id and text.  Rows alike in both are one row with a count there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm.text import words_column
from sparkloom.plans import settled, written


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(idx, source, source_size, target) for a table (source, source_size) of distinct sources.

    Its windows run over one row a source.  Sources without words get target 0.
    """
    order = W.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("idx") - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("idx", F.row_number().over(order)).withColumn("weight", weight)
    t = t.withColumn("most", cap * F.col("source_size").cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = W.orderBy("ratio", "idx")
    up_to, after = by_ratio.rowsBetween(W.unboundedPreceding, 0), by_ratio.rowsBetween(0, W.unboundedFollowing)
    t = t.withColumn(
        "level",
        (F.sum("source_size").over(W.partitionBy()).cast("double") - (F.sum("most").over(up_to) - F.col("most"))) / F.sum("weight").over(after),
    )
    # The first source, by ratio, that its share doesn't fill sets the level for the rest.
    held = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "idx", "level"))
    t = t.withColumn("water", F.min(held).over(W.partitionBy())["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight"))
    return t.select("idx", "source", "source_size", target.alias("target"))


def _needs(targets: DataFrame, block_words: int, cap: int) -> DataFrame:
    """Adds words (target, rounded), n_blocks of one pass, slots (K) and first_cell."""
    size = F.col("source_size")
    words = F.least(F.round("target").cast("long"), cap * size)
    t = targets.withColumn("words", words).withColumn("n_blocks", F.ceil(size / F.lit(block_words)).cast("long"))
    passes = F.when(size > 0, F.floor(F.col("words") / F.greatest(size, F.lit(1)))).otherwise(0).cast("long")
    t = t.withColumn("slots", passes * F.col("n_blocks") + F.ceil((F.col("words") - passes * size) / F.lit(block_words)).cast("long"))
    before = F.sum("slots").over(W.orderBy("idx").rowsBetween(W.unboundedPreceding, 0)) - F.col("slots")
    return t.withColumn("first_cell", before)


def _bits_reversed(n: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(n), bits, "0")), 2, 10).cast("long") if bits else n


def schedule_slots(needs: DataFrame, block_words: int, chunks: int = 1024) -> DataFrame:
    """(position, idx, pass, block, used): the slots of the mix, in order of position.

    ``used`` is how many words of the block the mix takes: all, but for the last
    block of a stream and the last slot of a source.
    """
    spark = needs.sparkSession
    total = needs.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = max(0, int(total) - 1).bit_length()
    shift = max(0, bits - chunks.bit_length() + 1)
    grid = spark.range(0, 1 << bits if total else 0).withColumnRenamed("id", "position")
    grid = grid.withColumn("cell", _bits_reversed(F.col("position"), bits)).filter(F.col("cell") < int(total))
    grid = grid.withColumn("range", F.shiftright("cell", shift))
    owners = needs.filter("slots > 0").withColumn("range", F.explode(F.sequence(F.shiftright("first_cell", shift), F.shiftright(F.col("first_cell") + F.col("slots") - 1, shift))))
    owned = (F.col("cell") >= F.col("first_cell")) & (F.col("cell") < F.col("first_cell") + F.col("slots"))
    slots = grid.join(owners, "range").filter(owned).withColumn("chunk", F.shiftright("position", shift))
    before = slots.groupBy("idx", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("idx", "chunk", (F.sum("n").over(W.partitionBy("idx").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("idx", "chunk").orderBy("position"))
    slots = slots.withColumn("within", within).join(before, ["idx", "chunk"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    slots = slots.withColumn("pass", F.floor(F.col("rank") / F.col("n_blocks")).cast("long")).withColumn("block", F.col("rank") % F.col("n_blocks"))
    start = F.col("block") * block_words
    left = F.col("words") - F.col("pass") * F.col("source_size")
    used = F.least(start + block_words, F.col("source_size"), left) - start
    return slots.select("position", "idx", "pass", "block", used.alias("used"))


def document_streams(rows: DataFrame, chunks: int = 1024, copies: int = 4096) -> DataFrame:
    """Adds ``start``: the words before each row in its source's shuffled stream.

    ``rows`` has idx, size, doc_id, shuffle and tie; rows equal in all are
    interchangeable and follow each other.  They are counted before they are shuffled,
    and dealt out again in tasks of about ``copies``.
    """
    own = ["idx", "size", "doc_id", "shuffle", "tie"]
    rows = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).withColumn("chunk", F.pmod(F.col("shuffle"), F.lit(chunks)))
    before = rows.groupBy("idx", "chunk").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    before = before.select("idx", "chunk", (F.sum("words").over(W.partitionBy("idx").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).alias("before"))
    inside = W.partitionBy("idx", "chunk").orderBy("shuffle", "tie", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    words = F.col("size") * F.col("n")
    placed = rows.withColumn("start", F.sum(words).over(inside) - words).join(before, ["idx", "chunk"]).withColumn("start", F.col("before") + F.col("start"))
    placed = written(placed.select(*own, "n", "start"), "mix-places")
    few = placed.filter(F.col("n") <= copies).select(*own, "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth"))
    lot = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / copies))).alias("lot")
    many = placed.filter(F.col("n") > copies).select(*own, "start", "n", lot).repartition(F.col("shuffle"), F.col("lot"))
    last = F.least(F.col("n"), (F.col("lot") + 1) * copies) - 1
    many = many.select(*own, "start", F.explode(F.sequence(F.col("lot") * copies, last)).alias("nth"))
    return few.union(many).withColumn("start", F.col("start") + F.col("nth") * F.col("size")).drop("nth")


class Mix:
    """A mix: ``documents`` (one row a document), ``targets`` (one a source), ``pieces``.

    ``pieces`` has the schedule joined with the documents: position, pass, idx,
    block, doc_id, start (of the document in its stream), from_word and n_words;
    position is null for parts of documents that no slot takes.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, pieces: DataFrame):
        self.documents, self.targets, self.pieces = documents, targets, pieces

    def schedule(self) -> DataFrame:
        """Rows (position, pass, doc_id, from_word, n_words) of the mix."""
        return self.pieces.filter("position is not null and n_words > 0").select("position", "pass", "doc_id", "from_word", "n_words")

    def taken(self) -> DataFrame:
        """One row a document: doc_id, size, idx, start, tie, source_size, target, taken."""
        keys = ["doc_id", "size", "idx", "start", "tie"]
        some = self.pieces.groupBy(*keys).agg(F.sum("n_words").alias("taken"))
        none = self.documents.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
        return some.unionByName(none).join(self.targets.select("idx", "source_size", "target"), "idx")


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, block_words: int = 512, chunks: int = 1024,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
) -> Mix:
    """Mix ``docs`` by source; see the module docstring.

    A null text has size 0 and is never taken; a null source is a source of its
    own, last in order.  Null and repeated ids are kept, one row each, told apart
    by their place in the stream.  An empty table, or one without words, gives an
    empty schedule.  Nothing is random: reruns agree.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_column(text)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("shuffle"), F.xxhash64(text).alias("tie"),
    )
    rows = written(rows, "mix-rows")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    needs = written(_needs(targets, block_words, cap), "mix-targets")
    named = rows.join(needs.select("idx", F.col("source").alias("its")), F.col("source").eqNullSafe(F.col("its"))).drop("source", "its")
    documents = written(document_streams(named, chunks), "mix-streams")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    parts = documents.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    parts = parts.join(schedule_slots(needs, block_words, chunks), ["idx", "block"], "left")
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.coalesce("used", F.lit(0)))
    pieces = parts.withColumn("from_word", begin - F.col("start")).withColumn("n_words", F.greatest(end - begin, F.lit(0)))
    return Mix(documents, needs, pieces)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how: int) -> DataFrame:
    """``docs`` as a mix takes them: whole texts as often as they are passed over, then a rest of first words.

    All columns stay and n_chars is renewed.  Documents of which nothing is taken, those
    without words among them, are left out.  Rows alike in id and text share what is
    taken of them, rounded down.
    """
    def what_is_taken() -> DataFrame:
        mix = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
        taken = mix.taken().groupBy(F.col("doc_id").alias("__its_id"), F.col("tie").alias("__its_tie"), F.col("idx").alias("__its_idx"), F.col("size").alias("__its_size"))
        taken = taken.agg(F.floor(F.sum("taken") / F.count(F.lit(1))).cast("long").alias("__its_taken")).filter("__its_taken > 0")
        return taken.join(mix.targets.select(F.col("idx").alias("__its_idx"), F.col("source").alias("__its_source")), "__its_idx")

    taken = settled(what_is_taken, "mix-taken")
    same = docs[id_col].eqNullSafe(F.col("__its_id")) & (F.xxhash64(docs[text_col]) == F.col("__its_tie")) & docs[source_col].eqNullSafe(F.col("__its_source"))
    passes, rest = F.floor(F.col("__its_taken") / F.col("__its_size")), F.col("__its_taken") % F.col("__its_size")
    # One entry a copy: -1 for a whole text, else how many of its words.
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), passes.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    rows = docs.join(taken, same).withColumn("__its_words", F.explode(copies))
    some = F.array_join(F.slice(words_column(F.col(text_col)), F.lit(1), F.greatest(F.col("__its_words"), F.lit(0)).cast("int")), " ")
    rows = rows.withColumn(text_col, F.when(F.col("__its_words") < 0, F.col(text_col)).otherwise(some))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
