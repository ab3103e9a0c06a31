"""Toxicity by weak supervision.

Voters. Lexicon voters are words, and beginnings of words (once, or shared by several words), that labelled toxic rows have far more
often than others. Pattern voters look at shouting, stretched and masked words, words that address the reader, and how many lexicon
words a text has. A voter speaks or keeps silent; the last one speaks where no lexicon voter does.

Label model. A generative model of the hidden truth, the row's label and all voters: how often each speaks in toxic and in other
texts, and, for voters that speak together more than the truth explains, how often one speaks given that the other does. The
pairs are a tree, the one that holds the most mutual information given the truth, so the model is exact and each parameter is a share of
rows. The label is a voter whose reliability is estimated like any other; the labels only say where expectation-maximisation starts,
and choose the lexicon. A logistic classifier on the votes learns the posteriors.

Learning uses at most LABELLED labelled rows, chosen by a hash of the id; the driver receives their votes and at most
CANDIDATES candidate terms. Scoring reads every text whole, in one pass without a shuffle.

Edge cases. Null and empty texts have no words and are scored like any text without a voter; texts of any length are read whole.
Repeated rows are scored each. Without labels there are no lexicon voters, and the score is one constant below one half. Extra
columns pass through in `scored`, one named like the score gives way to it; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_way, in_small_batches, slices, stored
from .labelled import LABELLED, held_out, training

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings, terms that come to the driver as candidates, terms of the lexicon.
BEGINNINGS, CANDIDATES, LEXICON = (4, 5, 6, 7), 4000, 240
#: A term asks for so many different words of the text with its stem.
LEVELS = (1, 2, 4)
#: A term enters the lexicon if chance would bring less than about one in so many terms as far from the base rate.
TRIALS = 10_000
#: Least share of toxic rows among those that have a term of the lexicon.
PURE = 0.6
#: Nats of mutual information that a pair of voters must share, given the truth, to be a pair of the model; and the votes that each
#: share of rows begins with, so that none is 0 or 1.
TOGETHER, SMOOTH = 0.002, 0.5
#: Words that address the reader, in the languages of the texts.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
STRETCHED = re.compile(r"([^\W\d_])\1\1")
MASKED = re.compile(r"(?<=[^\W\d_])[*#$]+(?=[^\W\d_])")
CAPITALS = bytes(range(65, 91))
WORDS_KEPT = 300_000
ROUNDS, STEPS = 25, 500
PATTERNS = 9


def stems(word: str) -> list[str]:
    """The word itself, marked by a space, and its beginnings."""
    return [word + " ", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def terms(words: set[str]) -> list[str]:
    """All terms that a text with these words has: a stem and a level."""
    counts = Counter(s for w in words for s in stems(w))
    return [f"{s}*{n}" for s, c in counts.items() for n in LEVELS if c >= n]


@dataclass
class Model:
    terms: dict[str, int]
    weights: np.ndarray
    bias: float
    #: What the label model holds: the share of rows where each voter speaks, by truth and by what the voter before it in the tree
    #: does (truth x silent or speaking x voter), and that voter; -1 for none. The label is the last voter.
    rates: np.ndarray
    parent: np.ndarray


class Voters:
    """Votes of one text; which voters a word moves is remembered, for words in bounded number."""

    def __init__(self, lexicon: dict[str, int]):
        self.size, self.known = len(lexicon), {}
        #: the terms of each stem: level and place
        self.of: dict[str, list[tuple[int, int]]] = {}
        for term, i in lexicon.items():
            stem, _, level = term.rpartition("*")
            self.of.setdefault(stem, []).append((int(level), i))

    def __call__(self, text: str) -> np.ndarray:
        out = np.zeros(self.size + PATTERNS, np.uint8)
        own, known = set(WORD.findall(text.lower())), self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        counts: dict[str, int] = {}
        for w, got in zip(own, map(known.get, own), strict=True):
            if got is None:
                got = known[w] = (*(s for s in stems(w) if s in self.of), *(("",) if STRETCHED.search(w) else ()))
            for s in got:
                counts[s] = counts.get(s, 0) + 1
        for s, c in counts.items():
            for level, i in self.of.get(s, ()):  # "" stands for a stretched word
                out[i] = c >= level
        k = self.size
        hits = int(out[:k].sum())
        n, raw = len(text), text.encode("utf-8", "replace")
        capitals = len(raw) - len(raw.translate(None, CAPITALS))
        out[k:] = [hits >= 2, hits >= 4, text.count("!") * 50 > n > 0, "!!" in text or "?!" in text, capitals * 4 > n > 0, "" in counts, MASKED.search(text) is not None, len(own & YOU) >= 2, hits == 0]
        return out


def _counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, other): labelled rows of each kind that have the term. A task sums over its own share of the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            names = [*{**toxic, **other}]
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()), pa.array([other[t] for t in names], pa.int64())], names=["term", "toxic", "other"])
            toxic.clear()
            other.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                (toxic if y else other).update(terms(set(WORD.findall((text or "").lower()))))
                if len(toxic) + len(other) > 200_000:
                    yield flush()
        yield flush()

    return rows.select("text", "y").mapInArrow(run, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def lexicon(rows: DataFrame) -> dict[str, int]:
    """Terms that mark toxic rows, best first, at most LEXICON."""
    sizes = rows.groupBy("y").agg(F.count("*").alias("n")).collect()
    n = {r["y"]: r["n"] for r in sizes}
    yes, no = n.get(1, 0), n.get(0, 0)
    if not yes:
        return {}
    # how far the term's share of toxic rows is from the base rate, as a log likelihood ratio; chance alone brings some
    # of the many terms to the logarithm of their number, give or take a little
    base, n_term = yes / (yes + no), F.col("toxic") + F.col("other")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n_term * p))).otherwise(0.0)
    found = _counts(rows).where((F.col("toxic") >= 2) & (F.col("toxic") > PURE * n_term))
    found = found.withColumn("rank", part(F.col("toxic"), base) + part(F.col("other"), max(1 - base, 1e-9)))
    top = found.orderBy(F.desc("rank"), F.length("term"), "term").limit(CANDIDATES).collect()
    least = np.log(TRIALS)
    chosen, seen = [], set()
    for r in top:
        # longer beginnings of a word that are found in the same rows say nothing new
        same = (r["toxic"], r["other"], r["term"][: BEGINNINGS[0]])
        if r["rank"] >= least and same not in seen and len(chosen) < LEXICON:
            seen.add(same)
            chosen.append(r["term"])
    return {t: i for i, t in enumerate(chosen)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", limit: int = LABELLED) -> Model:
    return fit_rows(stored(training(docs, labels, label, key, text, limit), "toxicity-rows"))


def fit_rows(rows: DataFrame) -> Model:
    """Learns from rows of _id, text and y, in bounded number."""
    rows = in_small_batches(rows)
    chosen = lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(chosen)
        for whole in batches:
            for batch in slices(whole, "text"):
                votes = [np.packbits(voters(x or "")).tobytes() for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(votes, pa.binary()), batch.column("y")], names=["id", "votes", "y"])

    seen = rows.mapInArrow(run, "id long, votes binary, y int").collect()
    seen = sorted(seen, key=lambda r: (r["id"], bytes(r["votes"])))
    width = len(chosen) + PATTERNS
    votes = np.array([np.unpackbits(np.frombuffer(r["votes"], np.uint8))[:width] for r in seen], float).reshape(-1, width)
    return _learn(chosen, votes, np.array([r["y"] for r in seen], float))


def _tree(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """For each voter the one before it in the tree of pairs that share the most information given the truth, or -1."""
    shared = np.zeros((votes.shape[1],) * 2)
    for weight in (1 - posterior, posterior):
        total = weight.sum() + 4 * SMOOTH
        both = (votes * weight[:, None]).T @ votes
        one = np.diag(both)
        a, b = one[:, None], one[None, :]
        cells = {(1, 1): both, (1, 0): a - both, (0, 1): b - both, (0, 0): weight.sum() - a - b + both}
        for (i, j), n in cells.items():
            p = (n + SMOOTH) / total
            side = [(x + 2 * SMOOTH) / total if speaks else 1 - (x + 2 * SMOOTH) / total for x, speaks in ((a, i), (b, j))]
            shared += total / (len(votes) + 8 * SMOOTH) * p * np.log(p / (side[0] * side[1]))
    parent = np.full(len(shared), -1)
    np.fill_diagonal(shared, 0)
    # Prim's way: always the voter that shares the most with one of the tree; one that shares too little begins a tree of its own
    best, by = np.full(len(shared), -np.inf), np.full(len(shared), -1)
    out = np.ones(len(shared), bool)
    for _ in range(len(shared)):
        node = int(np.argmax(np.where(out, best, -np.inf))) if (best[out] > TOGETHER).any() else int(np.flatnonzero(out)[0])
        parent[node] = by[node] if best[node] > TOGETHER else -1
        out[node] = False
        more = out & (shared[node] > best)
        best[more], by[more] = shared[node][more], node
    return parent


def _rates(votes: np.ndarray, before: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Shares of rows, by truth, where each voter speaks given what the voter before it does; `before` is 0 where there is none."""
    out = []
    for weight in (1 - posterior, posterior):
        n1 = weight @ before
        k1 = weight @ (votes * before)
        # what voters do without regard to the one before smooths the shares given it
        alone = (weight @ votes + SMOOTH) / (weight.sum() + 2 * SMOOTH)
        out.append([(weight @ votes - k1 + 2 * SMOOTH * alone) / (weight.sum() - n1 + 2 * SMOOTH), (k1 + 2 * SMOOTH * alone) / (n1 + 2 * SMOOTH)])
    return np.clip(np.array(out), 1e-5, 1 - 1e-5)


def posteriors(votes: np.ndarray, parent: np.ndarray, rates: np.ndarray, prior: float) -> np.ndarray:
    """The chance that each row is toxic, given all votes."""
    before = np.where(parent >= 0, votes[:, parent], 0.0)
    likely = [np.where(before > 0, np.where(votes > 0, r[1], 1 - r[1]), np.where(votes > 0, r[0], 1 - r[0])) for r in rates]
    margin = np.log(prior / (1 - prior)) + (np.log(likely[1]) - np.log(likely[0])).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _learn(chosen: dict[str, int], votes: np.ndarray, y: np.ndarray) -> Model:
    n, width = votes.shape
    if not n or not y.any():
        return Model(chosen, np.zeros(width), -2.0, np.full((2, 2, width + 1), 0.5), np.full(width + 1, -1))
    posterior = np.clip(y, 0.05, 0.95)
    seen = np.column_stack([votes, y])
    parent = _tree(seen, posterior)
    rates = np.zeros((2, 2, width + 1))
    for _ in range(ROUNDS):
        rates = _rates(seen, np.where(parent >= 0, seen[:, parent], 0.0), posterior)
        prior = (posterior.sum() + 1) / (n + 2)
        posterior = posteriors(seen, parent, rates, prior)
    weights, bias = np.zeros(width), float(np.log((posterior.mean() + 1e-3) / (1 - posterior.mean() + 1e-3)))
    rate, velocity, slope = 1.0, np.zeros(width), 0.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(votes @ weights + bias, -30, 30)))
        d = (p - posterior) / n
        velocity = 0.9 * velocity - rate * (votes.T @ d + 1e-5 * weights)
        slope = 0.9 * slope - rate * d.sum()
        weights, bias = weights + velocity, bias + float(slope)
    return Model(chosen, weights, bias, rates, parent)


def scored(df: DataFrame, model: Model, text: str = "text", score: str = "score", keep_text: bool = True) -> DataFrame:
    """Adds the column `score`."""
    df = giving_way(df, [score], text)
    kept = [c for c in df.columns if keep_text or c != text]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(model.terms)
        for whole in batches:
            for batch in slices(whole, text):
                votes = np.array([voters(x or "") for x in batch.column(text).to_pylist()], float).reshape(batch.num_rows, -1)
                p = 1 / (1 + np.exp(-np.clip(votes @ model.weights + model.bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p, pa.float64())], names=schema.names)

    return in_small_batches(df).mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels), keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
