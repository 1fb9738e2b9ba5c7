"""Toxicity classifier (operator 5) trained by weak supervision.

Voters look at a document and fire or stay silent: fixed lexicons of insults
in four languages, fixed patterns (second-person abuse, threats, masked
words, shouting, ...) and word stems mined from labelled rows. A generative
label model (a plain class and one for each group of voters that fire
together, each voter's rate in each, and a forest of correlated voters whose
rates depend on each other) is fitted to the votes alone, by the voters'
covariances and by expectation-maximisation; firing and silence both
count. Labels name the toxic classes, weigh the
sample's two strata and let stems be mined; they enter neither the model's
likelihood nor a row's posterior. The posterior labels train a
logistic regression on presence features (lexicon words and mined stems), and
that linear classifier scores every whole text.

Fitting uses a bounded sample of labelled rows outside fold 0 (``TRAIN_DOCS``
of each class); mining counts stems on the executors and brings at most
``MINED`` of them to the driver. Scoring is one pass with an Aho-Corasick
automaton over the whole text of every row.

Null and empty texts have no feature and score the classifier's base rate.
Repeated rows get equal scores. Without labels of both classes, or if no class
of the label model is toxic, only the lexicons count: a text with a lexicon word scores 0.9, any other 0.1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stockflow.llm.common import class_sizes, fold, labelled_sample, materialize

TRAIN_DOCS, MINED, MINED_VOTERS = 4000, 400, 48
STEMS, FLUSH = (4, 5, 6, 7, 8), 300_000
#: A mined stem needs this log-likelihood ratio (chance gives it to about
#: one stem in a hundred thousand; one alone makes no class of the label model) and this ratio of its rates in the two classes.
LEAST_EVIDENCE, LEAST_LIFT = 20.0, 6.0
TOXIC = 0.5
#: Voters correlated by less than this (or four standard errors), or that fire together
#: in fewer rows, count as independent; classes of the label model beside the plain one.
LEAST_CORRELATION, LEAST_ROWS, MOST_CLASSES = 0.2, 4, 16

# voters' lexicons (whole words, lower case).
LEXICONS = {
    "stupidity": "idiot idiots idiotic stupid moron morons moronic imbecile dumb dumbass dimwit halfwit",
    "worthless": "worthless pathetic useless loser losers failure nobody",
    "disgust": "disgusting trash garbage scum filth filthy vermin parasite parasites",
    "ridicule": "clown clowns fool fools buffoon freak weirdo",
    "profane": "bastard bitch asshole jerk prick crap shit fuck fucking damn",
    "french": "imbécile connard connasse débile crétin ordure abruti salaud idiote stupide minable pathétique",
    "german": "dummkopf arschloch abschaum trottel versager vollidiot schwachkopf widerlich erbärmlich nutzlos",
    "spanish": "imbécil estúpido estúpida idiota basura escoria perdedor patético inútil payaso asqueroso",
}
# voters' patterns.
PATTERNS = {
    "you are": r"(?i)\byou(?:'re| are)\s+(?:an?|so|such|all|nothing)\b",
    "threat": r"(?i)\b(?:kill|hurt|destroy)\s+(?:you|yourself|them)\b",
    "go away": r"(?i)\b(?:shut up|get lost|go to hell|hate you)\b",
    "masked": r"\b[A-Za-z]+[*@#$]{2,}[A-Za-z]+\b",
    "leet": r"(?i)\b(?:1d10t|id10t|m0ron|l0ser|st[uv]p1d|tr4sh)\b",
    "shout": r"(?:\b[A-Z]{3,}\b[^a-z]{1,4}){4}",
    "bangs": r"!{3,}",
    "stretch": r"([A-Za-z])\1{3,}",
}
_WORD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: str | None) -> str:
    """Lower-case words with one space or more around each; anything else is a space."""
    return " " + (text or "").encode("utf-8", "replace").lower().translate(_WORD).decode("utf-8", "replace") + " "


class Matcher:
    """Which of many stems (' abc') and words (' abc ') occur in a text."""

    def __init__(self, keys: list[str]):
        self.automaton = ahocorasick.Automaton()
        for k, key in enumerate(keys):
            self.automaton.add_word(key, k)
        if keys:
            self.automaton.make_automaton()
        self.empty = not keys

    def __call__(self, text: str) -> list[int]:
        return [] if self.empty else sorted({k for _, k in self.automaton.iter(text)})


def _mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(stem, clean, toxic): in how many documents of a class a stem occurs, in parts."""
    counts: dict[str, list[int]] = {}

    def out() -> pd.DataFrame:
        f = pd.DataFrame([(k, *v) for k, v in counts.items()], columns=["stem", "clean", "toxic"])
        counts.clear()
        return f

    for b in batches:
        for text, y in zip(b["text"], b["y"]):
            words = set(normal(text).split())
            for s in {f" {w[:n]}" for w in words for n in STEMS if len(w) >= n} | {f" {w} " for w in words}:
                counts.setdefault(s, [0, 0])[y] += 1
            if len(counts) > FLUSH:
                yield out()
    yield out()


def mined_stems(sample: DataFrame, size: list[int]) -> list[str]:
    """At most ``MINED`` stems and words that mark toxic documents, best first."""
    n, t, c = sum(size), F.col("toxic"), F.col("clean")
    lift = (t + 0.5) / (size[1] + 1) / ((c + 0.5) / (size[0] + 1))
    part = lambda k, own: F.when(k > 0, k * F.log(k * n / ((t + c) * own))).otherwise(0.0)
    evidence = 2 * (part(t, size[1]) + part(c, size[0]))
    rows = (sample.mapInPandas(_mine, "stem string, clean long, toxic long").groupBy("stem")
            .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
            .filter((evidence >= LEAST_EVIDENCE) & (lift >= LEAST_LIFT))
            .orderBy(evidence.desc(), F.length("stem"), "stem").limit(MINED).collect())
    return [r["stem"] for r in rows]


def most_general(stems: list[str], limit: int) -> list[str]:
    """The first ``limit`` stems that neither extend nor shorten one already taken."""
    taken: list[str] = []
    for s in stems:
        if not any(s.startswith(t.rstrip()) or t.startswith(s.rstrip()) for t in taken):
            taken.append(s)
        if len(taken) == limit:
            break
    return taken


def voter_names(stems: list[str]) -> list[str]:
    return [*LEXICONS, *PATTERNS, *most_general(stems, MINED_VOTERS)]


def _observer(stems: list[str], keys: list[str]):
    """Votes and features of sampled documents, as bytes with one byte each."""
    mined = most_general(stems, MINED_VOTERS)

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [f" {w} " for ws in LEXICONS.values() for w in ws.split()] + mined
        group = [k for k, ws in enumerate(LEXICONS.values()) for _ in ws.split()]
        group += [len(LEXICONS) + len(PATTERNS) + k for k in range(len(mined))]
        votes, features = Matcher(own), Matcher(keys)
        patterns = [re.compile(p) for p in PATTERNS.values()]
        n = len(LEXICONS) + len(patterns) + len(mined)
        for b in batches:
            rows = []
            for i, text, y in zip(b["__id"], b["text"], b["y"]):
                t, v, f = normal(text), np.zeros(n, np.uint8), np.zeros(len(keys), np.uint8)
                v[[group[k] for k in votes(t)]] = 1
                for k, p in enumerate(patterns):
                    v[len(LEXICONS) + k] = p.search(text) is not None
                f[features(t)] = 1
                rows.append((i, y, v.tobytes(), f.tobytes()))
            yield pd.DataFrame(rows, columns=["id", "y", "votes", "features"])
    return observe


class LabelModel:
    """Generative model of voters that fire or stay silent, fitted to votes alone.

    Toxic texts are of several kinds (insults of one language never meet those
    of another), so the model has several classes: a plain one and one for
    each group of voters that fire together. A voter fires in class c at a rate
    that depends on c and, if it is correlated with another voter inside the
    classes, on that voter's vote too: a forest of at most one parent for
    each voter, whose conditional rates are the correlations. A copy of a voter
    thus adds nothing.

    Voters that are independent inside the plain class have no covariance there.
    While some have, the pair with the largest covariance and the voters
    correlated with both start a new class, and expectation-maximisation
    climbs the likelihood of all votes; ``likelihood`` holds it round by
    round once classes and forest are fixed.
    """

    def __init__(self, votes: np.ndarray, weight: np.ndarray, rounds: int = 40):
        v, w = votes.astype(float), weight * (len(votes) / weight.sum())
        self.mean = np.clip((w @ v + 0.5) / (w.sum() + 1), 1e-6, 1 - 1e-6)
        self.noise = max(LEAST_CORRELATION, 4 / np.sqrt(len(v)))
        self.correlation, self.parent = np.zeros((v.shape[1],) * 2), np.full(v.shape[1], -1)
        self.shares, self.rates = np.ones(1), np.repeat(self.mean[None, None], 2, axis=1)  # class, parent's vote, voter
        for _ in range(MOST_CLASSES):
            if not self._add_class(v, w):
                break
            for _ in range(15):
                self._step(v, w)
        for _ in range(3):  # a copy also distorts its class at first: look again once the forest allows for it
            self._correlate(v, w)
            for _ in range(10):
                self._step(v, w)
        self.likelihood = [self._step(v, w) for _ in range(rounds)]

    def _inside(self, v: np.ndarray, w: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Covariances and correlations of the voters over the rows of class ``c``."""
        share = self.classes(v)[c]
        own = share * (share > 0.5) * w
        mean = own @ v / max(own.sum(), 1e-9)
        cov = ((v - mean) * own[:, None]).T @ (v - mean) / max(own.sum(), 1e-9)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        met = (v * (share > 0.5)[:, None]).T @ v >= LEAST_ROWS  # pairs seen together often enough
        np.fill_diagonal(met, False)
        return np.where(met, cov, 0), np.where(met, cov / np.outer(sd, sd), 0)

    def _add_class(self, v: np.ndarray, w: np.ndarray) -> bool:
        """A new class for the plain class's most covariant voters, if any are."""
        calm = self.classes(v)[0]
        cov, corr = self._inside(v, w, 0)
        cov = np.where(corr > self.noise, cov, 0)
        if not cov.any():
            return False
        i, j = np.unravel_index(cov.argmax(), cov.shape)
        near = (corr[i] > self.noise) & (corr[j] > self.noise)
        near[[i, j]] = True
        own = calm * w * (v[:, near].sum(1) >= 2)
        rates = (own @ v + self.mean) / (own.sum() + 1)
        self.rates = np.concatenate([self.rates, np.repeat(rates[None, None], 2, axis=1)])
        share = own.sum() / w.sum()
        self.shares = np.append(self.shares, share)
        self.shares[0] = max(self.shares[0] - share, share)
        self.shares /= self.shares.sum()
        return True

    def _correlate(self, v: np.ndarray, w: np.ndarray) -> None:
        """What voters share beyond their class, the largest over the classes, and its forest."""
        corr = np.max([self._inside(v, w, c)[1] for c in range(len(self.shares))], axis=0)
        self.correlation = np.where(corr > self.noise, corr, 0)
        self.rates[:, 1] = self.rates[:, 0]
        self._grow_forest()

    def _grow_forest(self) -> None:
        """The heaviest forest of correlations, by Prim's algorithm."""
        self.parent[:] = -1
        left = set(range(len(self.parent)))
        while left:
            tree = [min(left)]
            left.discard(tree[0])
            while left:
                rest = sorted(left)
                part = self.correlation[np.ix_(tree, rest)]
                i, j = np.unravel_index(part.argmax(), part.shape)
                if not part[i, j]:
                    break
                self.parent[rest[j]] = tree[i]
                tree.append(rest[j])
                left.discard(rest[j])

    def _parents(self, v: np.ndarray) -> np.ndarray:
        return np.where(self.parent >= 0, v[:, self.parent], 0.0)

    def _joint(self, v: np.ndarray) -> np.ndarray:
        """Log-probability of each row of votes together with each class."""
        at, out = self._parents(v), np.empty((len(self.shares), len(v)))
        for c, own in enumerate(self.shares):
            fire, calm = np.log(self.rates[c]), np.log1p(-self.rates[c])
            out[c] = (np.log(own) + v @ fire[0] + (1 - v) @ calm[0]
                      + (v * at) @ (fire[1] - fire[0]) + ((1 - v) * at) @ (calm[1] - calm[0]))
        return out

    def _step(self, v: np.ndarray, w: np.ndarray) -> float:
        """One round. Returns the log-likelihood before it, with that of the rates and
        shares under their priors (a pseudo-count of one), which never falls."""
        joint, at = self._joint(v), self._parents(v)
        total = np.logaddexp.reduce(joint, axis=0)
        fit = float(w @ total + np.log(self.shares).sum() + (
            self.mean * np.log(self.rates) + (1 - self.mean) * np.log1p(-self.rates)).sum())
        own = np.exp(joint - total) * w
        with_parent, fired, all_fired, size = own @ at, own @ (v * at), own @ v, own.sum(1)
        self.rates[:, 1] = (fired + self.mean) / (with_parent + 1)
        self.rates[:, 0] = (all_fired - fired + self.mean) / (size[:, None] - with_parent + 1)
        self.shares = (size + 1) / (size + 1).sum()
        return fit

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """Probability of each class (rows) for each row of votes (columns)."""
        joint = self._joint(votes.astype(float))
        return np.exp(joint - np.logaddexp.reduce(joint, axis=0))

    def toxic_classes(self, votes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Which classes are toxic: those where most of the labels say so. This
        one bit for each class is all that the labels decide."""
        own = self.classes(votes) * weight
        return own @ (label == 1) > 0.5 * own.sum(1)

    def posterior(self, votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Probability that a row of votes is of one of the ``toxic`` classes."""
        return self.classes(votes)[toxic].sum(0)


def fit_logistic(x: np.ndarray, q: np.ndarray, weight: np.ndarray, ridge: float = 0.2, rounds: int = 12) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.column_stack([x.astype(np.float64), np.ones(len(x))])
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pen)
        w -= np.linalg.solve(h, x.T @ (weight * (p - q)) + pen * w)
    return w


class LinearScorer:
    """The trained classifier: feature keys, their weights and a bias."""

    def __init__(self, keys: list[str], weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias, self._match = keys, weights, bias, None

    def __getstate__(self):
        return {**self.__dict__, "_match": None}

    def score(self, text: str | None) -> float:
        if self._match is None:
            self._match = Matcher(self.keys)
        found = self._match(normal(text))
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[found].sum(), -30, 30))))


def lexicon_keys() -> list[str]:
    return [f" {w} " for ws in LEXICONS.values() for w in ws.split()]


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> LinearScorer:
    """Fit voters, label model and classifier on rows outside fold 0."""
    share = class_sizes(labels, "toxic")
    lex = list(dict.fromkeys(lexicon_keys()))
    plain = LinearScorer(lex, np.full(len(lex), 2 * np.log(9.0)), -np.log(9.0))
    if not (share.get(0) and share.get(1)):
        return plain
    sample = materialize(labelled_sample(docs, labels, "toxic", limit), "sample")
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not (size.get(0) and size.get(1)):
        return plain
    stems = mined_stems(sample, [size[0], size[1]])
    keys = list(dict.fromkeys([*lex, *stems]))
    seen = sample.mapInPandas(_observer(stems, keys), "id long, y int, votes binary, features binary").toPandas()
    seen = seen.sort_values("id", kind="stable")
    votes = np.frombuffer(b"".join(seen["votes"]), np.uint8).reshape(len(seen), -1)
    x = np.frombuffer(b"".join(seen["features"]), np.uint8).reshape(len(seen), -1)
    y = seen["y"].to_numpy()
    weight = np.where(y == 1, share[1] / size[1], share[0] / size[0])
    weight *= len(seen) / weight.sum()
    model = LabelModel(votes, weight)
    toxic = model.toxic_classes(votes, y, weight)
    if not toxic.any():
        return plain
    w = fit_logistic(x, model.posterior(votes, toxic), weight)
    return LinearScorer(keys, w[:-1], float(w[-1]))


def score_column(scorer: LinearScorer, text: Column) -> Column:
    """The score of each whole text, 0 to 1."""

    @F.pandas_udf(DoubleType())
    def toxicity_score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([scorer.score(t) for t in s], dtype="float64")

    return toxicity_score(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    return (docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"),
                        score_column(train(docs, labels), F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= TOXIC).cast("int")))


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts as 0, all columns as they were."""
    return docs.filter(score_column(train(docs, labels), F.col("text")) < TOXIC)
