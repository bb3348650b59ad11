import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sparkloom.llm.langid import UNKNOWN, CompressionClassifier, dictionary, identify_languages, keep_identified, learn, letters


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify_languages(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(rows) == len(lang) and all(r["held_out"] == (r in held) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    turned = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert {r["doc_id"]: r["lang_pred"] for r in identify_languages(turned).collect()} == {r["doc_id"]: r["lang_pred"] for r in rows}


def test_classifier():
    content = {"en": dictionary(Counter("the fox and the dog and the hen".split() * 3), 4096), "de": dictionary(Counter("der fuchs und der hund und die henne".split() * 3), 4096)}
    c = CompressionClassifier(content)
    assert c.classify("the hen and the fox and the dog")[0] == "en" and c.classify("der hund und die henne und der fuchs")[0] == "de"
    assert [c.classify(t)[0] for t in (None, "", " \n", "123 !!")] == [UNKNOWN] * 4
    assert letters("A1b-C  d_e!") == "a b c d e" and c.classify("the fox " * 50_000)[0] == "en"
    assert Counter(dictionary({"b": 3, "cd": 2}, 99).split()) == {b"b": 3, b"cd": 2} and dictionary({}, 9) == b"" and dictionary({"a": 1}, 99) == b"a       "


def test_one_id_for_all_rows_and_words_late_in_a_text(make):
    """Languages are learned from all of a text, and however ids repeat."""
    rng = random.Random(0)
    words = {x: [x + "".join(rng.choice("abcdefghij") for _ in range(11)) for _ in range(200)] for x in "xyz"}
    text = lambda x, n: " ".join(rng.choices(words[x], k=n))
    rows = [(7, text("x", 8), "xx", "s") for _ in range(3000)] + [(7, "same words here", "same", "s")] * 3000
    rows += [(1000 + i, text("z", 600) + " " + text("y", 60), "yy", "s") for i in range(12)] + [(2000 + i, text("z", 6), None, "s") for i in range(5)]
    model = learn(make(rows))
    assert set(model.content) == {"xx", "yy", "same"}
    assert {model.classify(text("x", 30))[0] for _ in range(20)} == {"xx"} and {model.classify(text("y", 30))[0] for _ in range(20)} == {"yy"}
    with pytest.raises(ValueError, match="max_languages"):
        learn(make(rows), max_languages=2)


def test_few_documents_fill_a_dictionary(make):
    rng = random.Random(1)
    words = ["w" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    model = learn(make([(i, " ".join(rng.choices(words, k=20_000)), "xx", "s") for i in range(3)]), dictionary_bytes=50_000)
    assert 45_000 < len(model.content["xx"]) <= 50_000


def plain_sizes(text, content):
    """Compressed sizes by a compressor made anew for each block."""
    out = {}
    raw = letters(text).encode()
    for lang, c in content.items():
        how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        raw_dict = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out[lang] = sum(len(zstandard.ZstdCompressor(compression_params=how, dict_data=raw_dict).compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048))
    return out


def test_query_takes_the_smallest(docs):
    """All rows of the query against plain compression with the dictionaries learned."""
    model = learn(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in identify_languages(docs).collect():
        if any(map(str.isalpha, text[r["doc_id"]] or "")):
            sizes = plain_sizes(text[r["doc_id"]], model.content)
            assert r["lang_pred"] == min(sizes, key=lambda x: (sizes[x], x))
        else:
            assert r["lang_pred"] == UNKNOWN


def test_odd(odd, none):
    rows = identify_languages(odd).collect()
    assert len(rows) == odd.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4)} == {UNKNOWN} and all(r["rejected"] for r in rows if r["doc_id"] in (2, 3, 4))
    assert identify_languages(none).count() == 0
    kept = keep_identified(odd)
    assert kept.columns == odd.columns and {2, 3, 4}.isdisjoint({r["doc_id"] for r in kept.collect()}) and keep_identified(none).count() == 0
    no_labels = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify_languages(no_labels).collect()} == {UNKNOWN} and keep_identified(no_labels).count() == odd.count() - 4
