import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm.toxicity import Lexicon, errors_allowed, features, logistic, score_documents, train


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain(word, weights):
    """Fewest errors, then largest weight, over all terms and, for beginnings, all beginnings of the word."""
    best = None
    for term, w in weights.items():
        letters = term.rstrip("*")
        d = min(distance(word[:n], letters) for n in range(len(word) + 1)) if term.endswith("*") else distance(word, letters)
        if d <= errors_allowed(letters) and (best is None or (-d, w) > best):
            best = (-d, w)
    return (best[1], -best[0]) if best else (0.0, 0)


def test_automaton_finds_what_distances_find():
    weights = {"idiot": 2.0, "worthless": 3.0, "pathetic": 2.5, "path*": 1.0, "disgusting": 2.2, "réeuxab*": 1.7, "abominations": 1.1}
    lexicon, rng, letters = Lexicon(weights), random.Random(0), "abcdeghilmnoprstuwxéy*"
    words = ["", "idiot", "idiots", "worthles", "worthlesss", "wrothless", "pathtic", "paths", "réeuxabc", "réeuxbcd", "xréeuxab", "abmnations", "abominaations"]
    for term in list(weights) * 60:
        word = list(term.rstrip("*"))
        for _ in range(rng.randrange(4)):
            at, what = rng.randrange(len(word) + 1), rng.randrange(3)
            word[at : at + (what != 0)] = [rng.choice(letters)] if what < 2 else []
        words.append("".join(word))
    for w in words:
        assert lexicon.match(w) == plain(w, weights), w


def test_quotation_and_clusters():
    lexicon = Lexicon({"moron": 2.0, "worthless": 3.0})
    assert features(None, lexicon) == features("", lexicon) == (0.0,) * 8
    shouted, quoted = features("you are a moron , a worthles moron", lexicon), features('he wrote "you are a moron" and left', lexicon)
    assert shouted[0] > 0 and shouted[1] > 0 and shouted[2] == 0 and shouted[3] > 0
    assert quoted[0] == 0 and quoted[2] > 0 and quoted[3] == 0


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert logistic(x, y) == pytest.approx([2, -1, 0.5], abs=0.25)


def planted(make):
    """Documents of which some hold terms, and labels for two in three."""
    rng = random.Random(1)
    bad, rows, labels = ["scoundrel", "villainous", "gruesomely"], [], []
    for i in range(900):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            term = list(rng.choice(bad))
            if i % 10 == 0:  # misspelled, in labelled documents too
                term[rng.randrange(1, len(term))] = rng.choice("aeiou")
            words[rng.randrange(60)] = "".join(term)
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(toxic)))
    return make(rows), labels


def test_held_out(spark, make):
    docs, labels = planted(make)
    df = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in score_documents(docs, df).collect()}
    assert len(out) == 900
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= out[i]["score"] <= 1 for i in out)
    right = np.mean([out[i]["predicted"] == t for i, t in held])
    assert right > 0.95 and all(out[i]["predicted"] == (out[i]["score"] >= 0.7) for i in out)
    # Held-out labels are not learned: turning them round changes nothing.
    turned = df.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in score_documents(docs, turned).collect()} == pytest.approx({i: r["score"] for i, r in out.items()})


def test_misspelled_copies_of_learned_terms(spark, make):
    """No training document holds a misspelled term; "knive" is a word of other documents."""
    rng, bad, rows, labels = random.Random(3), ["scamp", "oafs", "villainous", "knave"], [], []
    for i in range(600):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        for _ in range(3 if i % 5 == 0 else 0):
            words[rng.randrange(60)] = rng.choice(bad)
        if i % 5 == 1:
            words[0] = "knive"
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(i % 5 == 0)))
    model = train(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    for word in ("scmap", "scanp", "scmp", "sccamp", "ofas", "ofs", "vlilainous", "vilainous"):
        assert model.lexicon.match(word)[0] > 0 and model.lexicon.match(word)[1] == 1, word
    assert model.lexicon.match("knave")[1] == 0 < model.lexicon.match("knave")[0] and model.lexicon.match("knive") == (0.0, 0)
    other = [f"w{n}" for n in range(57)]
    assert model.score(" ".join(["scmap", *other, "vilainous", "ofas"])) >= 0.7 > 0.3 > model.score(" ".join(["knive", *other, "w57", "w58"]))


def test_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    rows = score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert score_documents(none, labels).count() == 0 and score_documents(odd, labels.limit(0)).count() == odd.count()
