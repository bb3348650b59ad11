"""Toxicity scores from a learned lexicon, matched with tolerance for misspelling, in context.

Lexicon: words, and word beginnings, that labelled toxic documents hold much more
often than others.  It is a trie, and a Levenshtein automaton is run over all of it at
once: a state is the set of trie nodes reached with the errors spent on each, and
states and steps are built when first needed, so a word costs a table look-up for
each of its letters until no term can match any more.  Whole words are kept beside
beginnings that are as good, for beginnings are too short to allow errors; two
neighbours swapped are one error, and a word gets no more errors than leave it rare in
other documents.

Context: each match looks at the words around it.  Quotation marks on both sides make
it quoted, further matches near it make it part of a cluster.  Weights of plain,
misspelled, quoted and clustered matches, and of their share of the text, are fitted
by logistic regression.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.text import fold, in_pieces
from sparkloom.plans import written

EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~“”„«»‘’¡¿…–—"
QUOTES = "\"“”„«»"
FEATURES = ("plain", "misspelled", "quoted", "clustered", "largest", "share", "matches", "length")


def plain_words(text: str | None) -> list[str]:
    """Words of a text, lower case, without marks at their ends."""
    return [w.lower().strip(EDGE) for w in (text or "").split()]


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 11 else 2


def most_errors(term: str) -> int:
    """Errors that a learned term may get: by the length of a whole word, and none for short beginnings."""
    return 0 if term.endswith("*") and len(term) < 7 else errors_allowed(term.rstrip("*"))


def swapped(letters: str) -> set[str]:
    """A word with two neighbouring letters changed over, in all ways."""
    return {letters[:i] + letters[i + 1] + letters[i] + letters[i + 2 :] for i in range(len(letters) - 1)} - {letters}


class Lexicon:
    """Terms with weights; a term ending in ``*`` matches every word that begins with it.

    ``allowed`` gives the errors of terms, ``errors_allowed`` those of others; with
    ``swaps`` two neighbours changed over in a whole word are one error.
    """

    def __init__(self, weights: dict[str, float], allowed: dict[str, int] | None = None, swaps: bool = False):
        self.weights, self.allowed, self.swaps = dict(sorted(weights.items())), allowed or {}, swaps
        self._build()

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "allowed": self.allowed, "swaps": self.swaps}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _build(self) -> None:
        self._next: list[dict[str, int]] = [{}]
        self._ends: list[list[tuple[str, float, int, int, bool]]] = [[]]
        self._most = [0]
        for term, weight in self.weights.items():
            letters, stem = term.rstrip("*"), term.endswith("*")
            allowed = self.allowed.get(term, errors_allowed(letters))
            self._enter(letters, (term, weight, allowed, 0, stem))
            for other in sorted(swapped(letters)) if self.swaps and allowed and not stem else ():
                self._enter(other, (term, weight, allowed - 1, 1, stem))
        self._states: list[tuple[tuple[int, int], ...]] = []
        self._number: dict[tuple[tuple[int, int], ...], int] = {}
        self._steps: list[dict[str, int]] = []
        self._whole: list[tuple[float, int]] = []
        self._stem: list[tuple[float, int]] = []
        self._start = self._state({0: 0})
        self._known: dict[str, tuple[float, int]] = {}

    def _enter(self, letters: str, end: tuple[str, float, int, int, bool]) -> None:
        """Put a term into the trie: its weight, errors left to spend, errors spent by its spelling, and if it is a beginning."""
        node, left = 0, end[2]
        self._most[0] = max(self._most[0], left)
        for c in letters:
            if c not in self._next[node]:
                self._next[node][c] = len(self._next)
                self._next.append({})
                self._ends.append([])
                self._most.append(0)
            node = self._next[node][c]
            self._most[node] = max(self._most[node], left)
        self._ends[node].append(end)

    def _state(self, reached: dict[int, int]) -> int:
        """The number of a set of (node, errors), after the letters that a word may leave out; -1 if it is empty."""
        todo = list(reached.items())
        while todo:
            node, spent = todo.pop()
            for child in self._next[node].values():
                if spent + 1 <= self._most[child] and spent + 1 < reached.get(child, 99):
                    reached[child] = spent + 1
                    todo.append((child, spent + 1))
        if not reached:
            return -1
        key = tuple(sorted(reached.items()))
        if key not in self._number:
            self._number[key] = len(self._states)
            self._states.append(key)
            self._steps.append({})
            hits = [(w, -e - spelt, stem) for node, e in key for _, w, left, spelt, stem in self._ends[node] if e <= left]
            self._whole.append(max(((w, e) for w, e, _ in hits), default=(0.0, 0), key=lambda h: (h[1], h[0])))
            self._stem.append(max(((w, e) for w, e, stem in hits if stem), default=(0.0, 0), key=lambda h: (h[1], h[0])))
        return self._number[key]

    def _step(self, state: int, c: str) -> int:
        found = self._steps[state].get(c)
        if found is None:
            reached: dict[int, int] = {}

            def reach(node: int, spent: int) -> None:
                if spent <= self._most[node] and spent < reached.get(node, 99):
                    reached[node] = spent

            for node, spent in self._states[state]:
                reach(node, spent + 1)  # a letter too many
                for letter, child in self._next[node].items():
                    reach(child, spent + (letter != c))
            found = self._steps[state][c] = self._state(reached)
            if len(self._states) > 200_000:  # a bound on memory; states are built again as needed
                self._build()
                return self._rebuilt(reached)
        return found

    def _rebuilt(self, reached: dict[int, int]) -> int:
        return self._state(dict(reached))

    def match(self, word: str) -> tuple[float, int]:
        """(weight, errors) of the best term for a word: fewest errors, then largest weight; (0, 0) for none."""
        found = self._known.get(word)
        if found is None:
            state, best = self._start, (0.0, -99)
            for c in word:
                state = self._step(state, c)
                if state < 0:
                    break
                stem = self._stem[state]
                if stem[0] and (stem[1], stem[0]) >= (best[1], best[0]):
                    best = stem
            if state >= 0 and self._whole[state][0] and (self._whole[state][1], self._whole[state][0]) >= (best[1], best[0]):
                best = self._whole[state]
            found = (best[0], -best[1]) if best[0] else (0.0, 0)
            if len(self._known) > 500_000:
                self._known.clear()
            self._known[word] = found
        return found


    def within(self, word: str) -> dict[str, int]:
        """All terms that match a word, and the fewest errors of each."""
        state, found = self._start, {}
        for n, c in enumerate(word, 1):
            state = self._step(state, c)
            if state < 0:
                break
            for node, e in self._states[state]:
                for term, _, left, spelt, stem in self._ends[node]:
                    if e <= left and (stem or n == len(word)):
                        found[term] = min(e + spelt, found.get(term, 99))
        return found


def features(text: str | None, lexicon: Lexicon, window: int = 8, garbled: bool = False) -> tuple[float, ...]:
    """The numbers of FEATURES for one text; ``garbled`` takes all its matches for misspelled ones."""
    words = plain_words(text)
    match = lexicon.match
    hits = [(i, *m) for i, m in enumerate(map(match, words)) if m[0]]
    if not hits:
        return (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, math.log1p(len(words)))
    raw = text.split()
    plain = misspelled = quoted = clustered = 0.0
    for n, (i, weight, errors) in enumerate(hits):
        before, after = raw[max(0, i - window) : i + 1], raw[i : i + window + 1]
        marked = any(w[:1] in QUOTES for w in before if w) and any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after if w.rstrip(".,;:!?"))
        near = (n and i - hits[n - 1][0] <= window) or (n + 1 < len(hits) and hits[n + 1][0] - i <= window)
        if marked:
            quoted += weight
        elif errors or garbled:
            misspelled += weight
        else:
            plain += weight
        clustered += weight * bool(near)
    return (
        math.log1p(plain), math.log1p(misspelled), math.log1p(quoted), math.log1p(clustered), max(h[1] for h in hits),
        math.log1p(1000 * len(hits) / len(words)), math.log1p(len(hits)), math.log1p(len(words)),
    )


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of logistic regression by Newton's method; the last is the constant, held but for a trace by no ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.lexicon, self.centre, self.scale, self.weights = lexicon, centre, scale, weights

    def score(self, text: str | None) -> float:
        x = (np.array(features(text, self.lexicon)) - self.centre) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))


def _counted(piece: pd.DataFrame) -> pd.DataFrame:
    """Toxic documents of a piece that hold each word and each beginning of four to ten letters."""
    count: Counter = Counter()
    for text in piece["text"]:
        words = set(plain_words(text))
        terms = {w for w in words if len(w) >= 3}
        terms.update(w[:n] + "*" for w in words for n in range(4, min(10, len(w)) + 1))
        count.update(terms)
    return pd.DataFrame(list(count.items()), columns=["term", "toxic"])


SURELY = 1.5


def rate(t: int, o: int, toxic: int, other: int) -> tuple[float, float]:
    """The log odds that a term's ``t`` of ``toxic`` and ``o`` of ``other`` documents surely have, and those they have."""
    odds = math.log((t + 0.5) / (toxic + 1)) - math.log((o + 0.5) / (other + 1))
    return odds - 2 * math.sqrt(1 / (t + 0.5) + 1 / (o + 0.5)), odds


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, other: int, surely: float = SURELY, most: int = 2000) -> dict[str, float]:
    """Weights, log odds of document shares, of terms whose odds are surely high; at most ``most``.

    A beginning is passed over if a shorter one is as good; a whole word never is, for
    only its length tells how many errors it allows.
    """
    rated = {term: r for term, t, o in counts if (r := rate(t, o, toxic, other))[0] > surely}
    kept: dict[str, float] = {}
    for term in sorted(rated, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t)):
        letters = term.rstrip("*")
        shorter = [letters[:n] + "*" for n in range(1, len(letters) + (not term.endswith("*")))]
        if not term.endswith("*") or all(rated[term][0] > rated[s][0] + 0.3 for s in shorter if s in kept):
            kept[term] = rated[term][1]
    return {t: kept[t] for t in sorted(kept, key=lambda t: (-rated[t][0], t))[:most]}


def choose_errors(terms: dict[str, float], candidates: dict[str, int], near: dict[tuple[str, int], int], toxic: int, other: int) -> dict[str, int]:
    """Errors that each term allows.

    A term gets the most of ``errors_allowed`` with which its odds stay high, and surely
    so: ``near`` counts the other documents whose nearest word is that many errors off.
    Beginnings under six letters get none.
    """
    out = {}
    for term in terms:
        allowed = most_errors(term)
        while allowed:
            low, odds = rate(candidates[term], sum(near.get((term, e), 0) for e in range(allowed + 1)), toxic, other)
            if low > SURELY and odds > 2 * SURELY:
                break
            allowed -= 1
        out[term] = allowed
    return out


def near_documents(docs: DataFrame, lexicon: Lexicon) -> dict[tuple[str, int], int]:
    """How many documents there are by each term and the errors of the nearest word they hold."""

    def neared(piece: pd.DataFrame) -> pd.DataFrame:
        count: Counter = Counter()
        known: dict[str, dict[str, int]] = {}
        for text in piece["text"]:
            least: dict[str, int] = {}
            for w in set(plain_words(text)):
                found = known.get(w)
                if found is None:
                    found = known[w] = lexicon.within(w)
                for term, e in found.items():
                    least[term] = min(e, least.get(term, 99))
            count.update(least.items())
        return pd.DataFrame([(t, e, n) for (t, e), n in count.items()], columns=["term", "errors", "other"])

    counted = in_pieces(docs, neared, "term string, errors int, other long")
    return {(r["term"], r["errors"]): r["other"] for r in counted.groupBy("term", "errors").agg(F.sum("other").alias("other")).collect()}


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """(text, toxic) of at most ``sample_docs`` distinct rows, stored: those with the least hashes of id and text among as many ids."""
    toxic = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    ids = toxic.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample_docs).drop("h")
    # Both sides that are broadcast have at most sample_docs rows of three numbers.
    rows = docs.join(F.broadcast(ids), "doc_id").withColumn("text_hash", F.xxhash64("text"))
    chosen = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text_hash").distinct().orderBy("h", "doc_id", "text_hash").limit(sample_docs).drop("h")
    chosen = written(chosen, "toxicity-chosen")
    return written(rows.join(F.broadcast(chosen), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("text", "toxic"), "toxicity-sample")


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 20_000, lexicon_terms: int = 2000, candidate_terms: int = 100_000) -> ToxicityModel:
    """Fit on at most ``sample_docs`` labelled documents, those with the least hashes.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic.  A document with several
    labels is toxic if one says so.  Words are counted in the executors; the driver gets
    counts of the ``candidate_terms`` that most of the toxic documents hold, of which
    ``lexicon_terms`` at most become the lexicon, and twice eight numbers a sampled document.
    """
    sample = labelled_sample(docs, labels, sample_docs)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    counted = in_pieces(sample.filter("toxic = 1").select("text"), _counted, "term string, toxic long")
    frequent = counted.groupBy("term").agg(F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= max(5, n_toxic // 400))
    candidates = {r["term"]: r["toxic"] for r in frequent.orderBy(F.desc("toxic"), "term").limit(candidate_terms).collect()}

    def others(piece: pd.DataFrame) -> pd.DataFrame:
        """Other documents of a piece that hold each candidate."""
        count: Counter = Counter()
        for text in piece["text"]:
            words = set(plain_words(text))
            terms = {w for w in words if w in candidates}
            terms.update(t for w in words for n in range(4, min(10, len(w)) + 1) if (t := w[:n] + "*") in candidates)
            count.update(terms)
        return pd.DataFrame(list(count.items()), columns=["term", "other"])

    counted = in_pieces(sample.filter("toxic = 0").select("text"), others, "term string, other long")
    other = {r["term"]: r["other"] for r in counted.groupBy("term").agg(F.sum("other").alias("other")).collect()}
    terms = choose_terms([(t, n, other.get(t, 0)) for t, n in candidates.items()], n_toxic, n_other, most=lexicon_terms)
    others_only = sample.filter("toxic = 0").select("text")
    # Errors only add to a term's other documents: what has too many among a few needs no look at all of them.
    near = {(t, 0): n for t, n in other.items()}
    for few in (others_only.limit(200), others_only):
        allowed = choose_errors(terms, candidates, near, n_toxic, n_other)
        near = near_documents(few, Lexicon({t: terms[t] for t, e in allowed.items() if e}, allowed, swaps=True))
        near |= {(t, 0): max(near.get((t, 0), 0), other.get(t, 0)) for t in terms}
        # More errors than were looked for stay ruled out.
        near |= {(t, e + 1): n_other for t, e in allowed.items()}
    lexicon = Lexicon(terms, choose_errors(terms, candidates, near, n_toxic, n_other), swaps=True)

    # Few training documents hold misspelled terms: each is also fitted as if its terms were, or they would weigh nothing.
    def measured(piece: pd.DataFrame) -> pd.DataFrame:
        rows = [(list(features(t, lexicon, garbled=g)), toxic) for t, toxic in zip(piece["text"], piece["toxic"], strict=True) for g in (False, True)]
        return pd.DataFrame(rows, columns=["x", "toxic"])

    rows = in_pieces(sample, measured, "x array<double>, toxic int").collect()
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    y = np.array([r["toxic"] for r in rows], dtype=np.float64)
    centre, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    scale[scale == 0] = 1.0
    if len(set(y.tolist())) < 2:
        return ToxicityModel(lexicon, centre, scale, np.append(np.zeros(len(FEATURES)), 30.0 if len(y) and y[0] else -30.0))
    return ToxicityModel(lexicon, centre, scale, logistic((x - centre) / scale, y))


def score_documents(
    docs: DataFrame, labels: DataFrame, held_out_of: int = 3, held_out_fold: int = 1, threshold: float = 0.7,
    id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000, lexicon_terms: int = 2000, candidate_terms: int = 100_000,
) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Labels are learned only from documents whose crc32(id as text) modulo
    ``held_out_of`` isn't ``held_out_fold``; a null id counts as the empty text there
    and has no label.  The model is bounded by ``sample_docs``, ``lexicon_terms`` and
    ``candidate_terms``, see ``train``; every document is scored.  A null text is scored as the empty one.  Repeated rows are
    scored each.  Without both kinds of labels every score is about 0, or 1 if all are
    toxic.  Other columns are not read; an empty table gives an empty result.
    """
    held_out = (fold(F.col("doc_id"), held_out_of) == held_out_fold).alias("held_out")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = train(read, labels.select("doc_id", "toxic", held_out).filter("not held_out").drop("held_out"), sample_docs, lexicon_terms, candidate_terms)

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        score = np.array([model.score(t) for t in piece["text"]], dtype=np.float64)
        return pd.DataFrame({"doc_id": piece["doc_id"].array, "held_out": piece["held_out"].array, "score": score, "predicted": (score >= threshold).astype("int32")})

    return in_pieces(read.select("doc_id", held_out, "text"), run, "doc_id long, held_out boolean, score double, predicted int")
