"""Language identification by compression with per-language dictionaries.

For each language a raw-content zstandard dictionary is filled from a bounded sample
of its labelled documents: words of their whole texts, counted in the executors, in
proportion to how often they occur and in random order, but for words of a single
document, so that a copy with a wrong label doesn't match as a whole.  A text's letters, cut into blocks so that its own history never outweighs
the dictionaries, are compressed with each of them to the end, and the language with
the smallest sum wins.  The margin to the runner-up tells how sure that is; narrow
margins are rejected.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm.text import fold, in_pieces, slices
from sparkloom.plans import written

UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case runs of letters, one space between."""
    return _NO_LETTERS.sub(" ", text.lower()).strip()


def dictionary(copies: dict[str, int], size: int) -> bytes:
    """Words with their numbers of copies, shuffled with a fixed seed; zstandard asks for eight bytes."""
    words = [w for w in sorted(copies) for _ in range(copies[w])]
    random.Random(1).shuffle(words)
    content = " ".join(words).encode("utf-8", "replace")[:size]
    return content.ljust(8) if content else content


class CompressionClassifier:
    """Dictionaries by language; compressors are made where they are used."""

    def __init__(self, content: dict[str, bytes], block: int = 2048, bytes_a_nat: float = 2.0):
        self.content, self.block, self.bytes_a_nat = content, block, bytes_a_nat
        self._ready: list[tuple[str, zstandard.ZstdCompressor]] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": []}

    def _compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        if not self._ready:
            # Matches of four bytes: the words of a language are short.
            how = zstandard.ZstdCompressionParameters(
                window_log=17, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=32,
                strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            for lang in sorted(self.content):
                raw = zstandard.ZstdCompressionDict(self.content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                raw.precompute_compress(compression_params=how)
                self._ready.append((lang, zstandard.ZstdCompressor(compression_params=how, dict_data=raw)))
        return self._ready

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): score between 0 and 1, margin as a share of the runner-up's size.

        A text that is null or has no letter gives ``und``, 0, 0; ties go to the language first in order.
        """
        if not self.content or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        raw = letters(text).encode("utf-8", "replace")
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self._compressors())
        best, lang = sizes[0]
        score = 1 / sum(math.exp(max(-700.0, (best - s) / self.bytes_a_nat)) for s, _ in sizes)
        return lang, score, (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0


#: A run of letters longer than this is no word.
LONGEST_WORD = 256


def _words(piece: pd.DataFrame) -> pd.DataFrame:
    """How often, and in how many documents of a piece, each word occurs, by language."""
    count: Counter = Counter()
    texts_of: Counter = Counter()
    for lang, text in zip(piece["lang"], piece["text"], strict=True):
        own = Counter(w for w in letters(text).split() if len(w) <= LONGEST_WORD)
        count.update({(lang, w): n for w, n in own.items()})
        texts_of.update((lang, w) for w in own)
    return pd.DataFrame([(lang, w, n, texts_of[lang, w]) for (lang, w), n in count.items()], columns=["lang", "word", "n", "texts"])


def learn(docs: DataFrame, docs_per_language: int = 400, dictionary_bytes: int = 112 * 1024, max_languages: int = 256) -> CompressionClassifier:
    """Fit on a sample of labelled rows (doc_id, text, lang), bounded by the numbers given.

    A language's sample are its distinct rows with the least hashes of id and text.  Of
    their words the driver gets about ``dictionary_bytes`` a language.  Rows without
    text or language are passed over.  More than ``max_languages`` languages are an
    error; one whose sampled texts have no letter is not learned.
    """
    rows = docs.filter("lang is not null and text is not null").select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    sizes = written(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "language-sizes")
    n_languages = sizes.limit(max_languages + 1).count()
    if n_languages > max_languages:
        raise ValueError(f"more than max_languages = {max_languages} languages")
    # The least hashes are the same whatever else is ranked: about four times as many as are wanted reach the window.
    chance = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    near = rows.select("lang", "h").join(F.broadcast(sizes), "lang").filter(chance * F.col("n") <= 4 * docs_per_language).select("lang", "h").distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    chosen = written(near.withColumn("rank", rank).filter(F.col("rank") <= docs_per_language).select("lang", "h"), "language-sample")
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])
    words = in_pieces(sample.select("lang", "text"), _words, "lang string, word string, n long, texts long")
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "language-words")
    size = F.col("n") * (F.octet_length("word") + 1)
    room = words.groupBy("lang").agg(F.coalesce(F.sum(F.when(F.col("texts") > 1, size)), F.lit(0)).alias("shared"), F.sum(size).alias("all"))
    # Words of two texts or more; all words where no two texts share any.
    some = words.join(F.broadcast(room), "lang").filter("texts > 1 or shared = 0")
    part = F.least(F.lit(1.0), F.lit(float(dictionary_bytes)) / F.when(F.col("shared") > 0, F.col("shared")).otherwise(F.col("all")))
    chance = (F.xxhash64("word").cast("double") + 2.0**63) / 2.0**64
    some = some.select("lang", "word", F.floor(F.col("n") * part + chance * (part < 1).cast("double")).cast("long").alias("copies")).filter("copies > 0")
    copies: dict[str, dict[str, int]] = defaultdict(dict)
    for r in some.collect():
        copies[r["lang"]][r["word"]] = r["copies"]
    return CompressionClassifier({lang: dictionary(found, dictionary_bytes) for lang, found in copies.items()})


def identify_languages(
    docs: DataFrame, held_out_of: int = 4, held_out_fold: int = 2, least_margin: float = 0.02, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", **bounds: int,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and rejected of every document.

    Learns from documents with a language whose crc32(id as text) modulo
    ``held_out_of`` isn't ``held_out_fold``; see ``learn`` for the sample's bounds and
    for what cannot be learned.
    ``rejected``: no letter, or a margin below ``least_margin``.  Null and repeated
    ids are kept, one row each; a null id counts as the empty text in the fold.  If
    no language can be learned, all are ``und``.  Other columns are not read.
    """
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), held_out_of) == held_out_fold).alias("held_out"),
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
    )
    model = learn(read.filter(~F.col("held_out")), **bounds)

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([model.classify(t) for t in piece["text"]], columns=["lang_pred", "score", "margin"])
        out.insert(0, "doc_id", piece["doc_id"].array)
        out.insert(1, "held_out", piece["held_out"].array)
        return out.assign(rejected=(out["lang_pred"] == UNKNOWN) | (out["margin"] < least_margin))

    schema = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"
    return in_pieces(read.drop("lang"), run, schema)


def keep_identified(docs: DataFrame, least_margin: float = 0.02, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is told by ``least_margin`` or more.

    Learns from all rows with a language.  Texts without a letter are rejected; if
    no language can be learned, nothing can be told and all others stay.
    """
    model = learn(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), **bounds)

    def kept(text: str | None) -> bool:
        if not model.content:
            return bool(text) and any(map(str.isalpha, text))
        lang, _, margin = model.classify(text)
        return lang != UNKNOWN and margin >= least_margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array([kept(t) for t in batch[text_col].to_pylist()], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
