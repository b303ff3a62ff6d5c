"""Toxicity by weak supervision.

1. Features (whole words and word beginnings) are counted over a bounded sample of labelled
   documents in Spark, and the ones that tell most about the labels become lexicons.
2. Many voters look at each sampled document: lexicons by kind and strength, a fixed insult list,
   writing patterns, absence of any hit. Each votes toxic or clean, or abstains. The human label is one more voter.
3. A generative model of the votes is fitted by expectation maximisation: each voter's accuracy
   given the hidden class, and the voters' correlations given it, by which repeated evidence
   counts less.
4. A linear classifier on the features is trained on the posterior labels and scores every whole
   text in one pass.

The sample is bounded by ``most_labelled`` documents of each class (all are taken while there are
fewer); everything else covers all rows. Labels of held-out documents are never read, and neither
labels nor language, source or id enter a score.

Defined results: a null or empty text has the score of a text without features; a null label is no
label, and of contradicting labels toxic holds; without labelled documents of both classes the fixed
insult list alone decides (0.9 or 0.1); a null id counts as the empty string for the held-out
split; repeated rows get equal scores; an empty table gives no rows. Only named columns are read,
so other columns cannot clash.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ordering import pinned

# Common insults.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb trash scum loser losers pathetic worthless disgusting clown jerk "
    "fool imbecile garbage filth vermin hate ugly creep bastard".split()
)
PREFIXES = range(3, 9)
PATTERNS = ("shouting", "exclaiming", "masked", "stretched", "insult list")
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\b[a-z][*#@$]{2,}[a-z]\b")
_STRETCHED = re.compile(r"([a-z])\1{3}")
MEMO = 200_000


def features_of(token: str) -> list[str]:
    """Features of one white-space token: each word in it and its beginnings (marked by a star)."""
    found = []
    for word in _WORD.findall(token.lower()):
        found.append(word)
        found += [word[:n] + "*" for n in PREFIXES if n <= len(word)]
    return found


def patterns_of(text: str) -> list[bool]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    low = text.lower()
    loud = len(raw) > 20 and ((raw >= 65) & (raw <= 90)).mean() > 0.3
    return [
        bool(loud), "!!" in text, bool(_MASKED.search(low)), bool(_STRETCHED.search(low)),
        not INSULTS.isdisjoint(w.strip(".,;:!?*#$%&\"'()") for w in low.split()),
    ]


class Lookup:
    """Which of the chosen features a text has; tokens seen before are remembered, up to a bound."""

    def __init__(self, features: list[str]):
        self.index = {f: i for i, f in enumerate(features)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def of(self, text: str) -> set[int]:
        found: set[int] = set()
        if len(self.memo) > MEMO:
            self.memo.clear()
        for token in set(text.split()):
            hit = self.memo.get(token)
            if hit is None:
                hit = tuple(self.index[f] for f in features_of(token) if f in self.index)
                self.memo[token] = hit
            if hit:
                found.update(hit)
        return found


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray  # of the features, then of the patterns
    bias: float

    def scores(self, texts, lookup: Lookup) -> np.ndarray:
        out = np.empty(len(texts))
        known = len(self.features)
        for i, text in enumerate(texts):
            text = text or ""
            at = list(lookup.of(text)) + [known + j for j, on in enumerate(patterns_of(text)) if on]
            out[i] = self.bias + self.weights[at].sum()
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


# ---- the label model


def posterior(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 25) -> np.ndarray:
    """P(toxic) per document from votes (1 toxic, -1 clean, 0 abstain) and the label as one more voter.

    Tables P(vote | class) come from the posterior, smoothed. A voter's evidence is divided by one
    plus its absolute correlations with the other voters within the classes.
    """
    known = np.where(labels > 0, 1, -1)[:, None]
    cast = np.concatenate([known, votes], axis=1)
    q = np.where(labels > 0, 0.95, 0.05)
    for _ in range(rounds):
        w1, w0 = weight * q, weight * (1 - q)
        tables = np.empty((2, 3, cast.shape[1]))
        for v in (-1, 0, 1):
            tables[1, v + 1] = (w1[:, None] * (cast == v)).sum(axis=0) + 0.5
            tables[0, v + 1] = (w0[:, None] * (cast == v)).sum(axis=0) + 0.5
        tables /= tables.sum(axis=1, keepdims=True)
        # correlations of the votes about their class means, classes weighed alike
        spread = np.zeros((cast.shape[1],) * 2)
        for w in (w1, w0):
            w = w / max(w.sum(), 1e-9)
            centred = cast - (w[:, None] * cast).sum(axis=0)
            spread += (centred * w[:, None]).T @ centred
        sd = np.sqrt(np.maximum(np.diag(spread), 1e-12))
        shared = np.abs(spread / np.outer(sd, sd))
        np.fill_diagonal(shared, 0)
        shared[np.diag(spread) < 1e-9] = 0
        trust = 1.0 / (1.0 + shared.sum(axis=1))
        trust[0] = 1.0
        evidence = np.log(tables[1] / tables[0])
        odds = np.log(w1.sum() + 1) - np.log(w0.sum() + 1)
        total = odds + sum(trust[j] * evidence[cast[:, j] + 1, j] for j in range(cast.shape[1]))
        new = 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))
        if np.abs(new - q).max() < 1e-4:
            return new
        q = new
    return q


def voters(rows: list[set[int]], patterns: np.ndarray, features: list[str], odds: np.ndarray) -> np.ndarray:
    """Votes per document: lexicons by kind of feature and strength, patterns, and no hit at all."""
    kind = np.array([len(f) if f.endswith("*") else 0 for f in features], dtype=int)
    tiers = []
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        for part in np.array_split(own[np.argsort(-odds[own])], 3):
            if len(part):
                tiers.append(set(part.tolist()))
    votes = np.zeros((len(rows), len(tiers) + 1 + patterns.shape[1]), dtype=int)
    for i, own in enumerate(rows):
        for j, lexicon in enumerate(tiers):
            votes[i, j] = not own.isdisjoint(lexicon)
        votes[i, len(tiers)] = 0 if own else -1
    votes[:, len(tiers) + 1 :] = patterns
    return votes


def fit_linear(rows: list[set[int]], patterns: np.ndarray, q, weight, n_features: int, steps: int = 300):
    """Logistic regression with L2 on soft labels, by Adam over the sparse rows: (weights, bias)."""
    held = [sorted(r) + [n_features + j for j in np.flatnonzero(p)] for r, p in zip(rows, patterns)]
    column = np.concatenate([np.asarray(h, dtype=np.int64) for h in held]) if held else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    size = n_features + patterns.shape[1]
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    share = weight / weight.sum()
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[column], minlength=len(held)) + b
        slip = share * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - q)
        g = np.append(np.bincount(column, weights=slip[row], minlength=size) + 1e-5 * w, slip.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


# ---- Spark


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(
    docs: DataFrame,
    labels: DataFrame,
    most_labelled: int = 15000,
    most_features: int = 4096,
    least_seen: int = 3,
) -> Model:
    """A model from the labelled documents outside the held-out fifth."""
    usable = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    )
    sizes = {r.y: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model([], np.array([0.0] * (len(PATTERNS) - 1) + [2 * np.log(9.0)]), -float(np.log(9.0)))
    share = {y: min(1.0, most_labelled / n) for y, n in sizes.items()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    kept = F.when(F.col("y") == 1, F.lit(int(share[1] * 1_000_000))).otherwise(int(share[0] * 1_000_000))
    # About 2 * most_labelled ids at most, whatever the corpus.
    sample = docs.select("doc_id", "text").join(F.broadcast(pinned(usable.where(draw < kept))), "doc_id")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                own = {f for token in set((text or "").split()) for f in features_of(token)}
                seen[y].update(own)
            if len(seen[0]) + len(seen[1]) > 400_000:  # hand over, so that memory stays bounded
                yield _counts(seen)
                seen = (Counter(), Counter())
        yield _counts(seen)

    def _counts(seen):
        names = list(seen[0].keys() | seen[1].keys())
        return pd.DataFrame(
            {"feature": names, "n0": [seen[0][f] for f in names], "n1": [seen[1][f] for f in names]},
        ).astype({"feature": "object", "n0": "int64", "n1": "int64"})

    totals = sample.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    n = {r.y: max(1, r["n"]) for r in totals.collect()}
    n0, n1 = n.get(0, 1), n.get(1, 1)
    p1, p0 = (F.col("n1") + 0.5) / (n1 + 1), (F.col("n0") + 0.5) / (n0 + 1)
    # how far a feature moves the log odds, times how often it does
    gain = F.abs(F.col("n1") / n1 - F.col("n0") / n0) * F.abs(F.log(p1 / p0))
    features = (
        sample.mapInPandas(counted, "feature string, n0 long, n1 long")
        .groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(F.col("n0") + F.col("n1") >= least_seen)
        .select("feature", F.log(p1 / p0).alias("odds"), gain.alias("gain"))
        # only signs of toxicity: signs of cleanness would drown an insult in a long text
        .where(F.col("odds") >= 1.0)
        .orderBy(F.col("gain").desc(), "feature").limit(most_features).collect()
    )
    names = [r.feature for r in features]
    odds = np.array([r.odds for r in features])

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = Lookup(names)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "y": batch["y"], "at": [sorted(lookup.of(t)) for t in texts],
                    "patterns": [[int(x) for x in patterns_of(t)] for t in texts],
                }
            )

    # Bounded: the sample's rows, with at most most_features numbers each.
    rows = sample.mapInPandas(looked_up, "y int, at array<int>, patterns array<int>").collect()
    rows.sort(key=lambda r: (r.y, r["at"], r.patterns))  # the same model whatever the task order
    own = [set(r["at"]) for r in rows]
    patterns = np.array([r.patterns for r in rows], dtype=int).reshape(len(rows), len(PATTERNS))
    y = np.array([r.y for r in rows])
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    q = posterior(voters(own, patterns, names, odds), y, weight)
    w, b = fit_linear(own, patterns, q, weight, len(names))
    return Model(names, w, b)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = docs.select(
        F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id)) == 0).alias("held_out"),
        scored(model)(F.col(text)).alias("score"),
    )
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def scored(model: Model):
    """A vectorised function from text to score."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lookup = Lookup(model.features)
        for texts in batches:
            yield pd.Series(model.scores(texts, lookup))

    return run
