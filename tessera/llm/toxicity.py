"""Toxicity by weak supervision.

Voters are lexicons of abusive words by kind, patterns (an insult said to someone, or shouted), many words and word
stems that the labelled sample suggests, and how densely all of these stand in a text. Each votes on a text or
abstains: the dense say ``toxic``, those that find a text too sparse say ``clean``. A word of a voter counts only if
it stands once in ``GAP`` words, since a long text holds any word by chance. A generative label model with the true
class hidden is fitted by expectation and maximisation over labelled and unlabelled texts: each voter's rates of
voting in either class (its accuracy), and, along a maximum spanning tree of the mutual information left between
voters given the class, its rates given the vote of the voter it depends on (their correlation). To abstain says
nothing, as most voters know one language or kind of abuse only, so there are voters for either class. Known labels choose the voters and are one more voter, whose rates are estimated like the others'. The
posterior of the class then labels the sample, and a linear classifier on counts of the voters' terms is trained on
these soft labels. Only the classifier scores the corpus, from the bytes of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.common import fold, table, trim
from tessera.llm.sample import labelled

ROWS, BYTES = 1500, 32 << 20
#: Documents without a label in the sample, at most.
UNLABELLED = 2000
#: Terms taken from the labelled sample, and how many of them vote in the label model.
TERMS, VOTERS = 400, 120
#: Lengths in bytes of the word stems that are tried.
STEMS = (4, 5, 6, 7, 8, 10)
#: Voters depend on each other if they share this part of their information given the class: what they share less of
#: is agreement on the class, which isn't known well when the dependencies are found.
DEPENDS = 0.6
#: Words in which a voter's term stands once at least if it votes.
GAP = 170
#: A text is dense beyond this quantile of the clean sample's share of terms, sparse below these of the toxic one's.
DENSE, SPARSE = 0.99, (0.05, 0.25, 0.5)

# Fixed word lists of the lexicon voters.
LEXICONS = {
    "insult": "idiot idiots moron morons imbecile fool dumb stupid dumbass jerk clown loser losers dunce halfwit simpleton idiota imbécil estúpido tonto imbécile crétin abruti débile trottel dummkopf blödmann depp",
    "contempt": "worthless pathetic disgusting scum trash garbage vermin filth filthy lowlife parasite useless despicable inútil basura asco escoria ordure déchet minable abschaum widerlich wertlos erbärmlich dreck",
    "profanity": "fuck fucking fucked shit shitty bullshit bitch bastard asshole crap damn dick cunt piss whore slut mierda puta cabrón pendejo merde putain connard salope enculé scheiße arschloch hurensohn wichser",
    "threat": "kill murder strangle stab shoot hang burn beat hurt destroy die matar morir tuer crever töten sterben umbringen",
    "hate": "hate hatred despise subhuman inferior racist nazi odio odiar haine haïr hass hassen untermensch",
}
#: Words that address someone.
ADDRESS = "you your youre u tu vous du dich ihr eres usted te ti"
_U = np.uint64


def _hashes(words: list[str]) -> np.ndarray:
    return tb.words(pa.array(words, pa.string()), tb.ALNUM).hashes()


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def terms(w: tb.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, hash) of every word, and of every stem of a longer word."""
    yield w.doc, w.hashes()
    length = w.end - w.start
    for k in STEMS:
        long = np.flatnonzero(length > k)
        yield w.doc[long], tb.mix(w.hash_of(w.start[long], w.start[long] + k) + _U(k))


class Counter:
    """Counts of chosen terms in texts."""

    def __init__(self, chosen: np.ndarray):
        self.chosen = chosen
        self.bits = 20
        self.slot = np.zeros(1 << self.bits, bool)
        self.slot[(chosen >> _U(64 - self.bits)).astype(np.int64)] = True
        self.order = np.argsort(chosen)
        self.sorted = chosen[self.order]

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Matrix of texts x terms, and the number of words of each text. Texts are lower-cased here."""
        w = tb.words(_lower(texts), tb.ALNUM)
        out = np.zeros((w.n, len(self.chosen)))
        for doc, h in terms(w):
            maybe = np.flatnonzero(self.slot[(h >> _U(64 - self.bits)).astype(np.int64)])
            at = np.searchsorted(self.sorted, h[maybe])
            at[at == len(self.sorted)] = 0
            hit = self.sorted[at] == h[maybe]
            np.add.at(out, (doc[maybe[hit]], self.order[at[hit]]), 1)
        return out, np.bincount(w.doc, minlength=w.n).astype(np.float64)


def _suggested(texts: pa.Array, y: np.ndarray) -> np.ndarray:
    """Terms by which the labelled sample differs most: the largest likelihood ratios of presence in toxic texts."""
    held = []
    for lo, hi in tb.pieces(texts, 1 << 22):
        w = tb.words(_lower(texts.slice(lo, hi - lo)), tb.ALNUM)
        for doc, h in terms(w):
            order = np.lexsort((h, doc))
            d, g = doc[order], h[order]
            first = np.ones(len(g), bool)
            first[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
            held.append((g[first], y[lo + d[first]]))
    h, label = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
    ids, inverse = np.unique(h, return_inverse=True)
    a, n = np.bincount(inverse, label), np.bincount(inverse)
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    b = n - a
    p1, p0, p = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1), (n + 0.5) / (n1 + n0 + 1)
    gain = a * np.log(p1 / p) + b * np.log(p0 / p) + (n1 - a) * np.log((1 - p1) / (1 - p)) + (n0 - b) * np.log((1 - p0) / (1 - p))
    gain[(p1 <= p0) | (n < 4)] = 0
    best = np.argsort(-gain, kind="stable")[:TERMS]
    return ids[best[gain[best] > np.log(len(ids))]]  # more than chance gives the best of so many terms


def _patterns(texts: pa.Array, insults: set[str]) -> np.ndarray:
    """Votes of the pattern voters: an insult within three words of an address, and an insult in capitals."""
    address = set(ADDRESS.split())
    out = np.zeros((len(texts), 2), bool)
    for i, text in enumerate(texts.to_pylist()):
        words = [x.strip(".,;:!?\"'()") for x in (text or "").split()]
        low = [x.lower() for x in words]
        for k, x in enumerate(low):
            if x in insults:
                out[i, 0] |= any(v in address for v in low[max(0, k - 3) : k + 4])
                out[i, 1] |= words[k].isupper()
    return out


class LabelModel:
    """Hidden class, voters that vote or abstain, each depending on the class and on one other voter at most."""

    def fit(self, votes: np.ndarray, clean: np.ndarray, prior: np.ndarray, known: np.ndarray, rounds: int = 40) -> np.ndarray:
        """Posterior of the class for each row, of which ``prior`` is the chance beforehand and ``known`` holds labels
        or -1. ``clean`` marks the voters that vote for class 0; this only says where the fit begins."""
        n, m = votes.shape
        v = votes.astype(np.float64)
        base = np.log(prior / (1 - prior))
        q = 1 / (1 + np.exp(-(base + np.where(votes[:, ~clean].any(axis=1), 2, -2))))
        # the dependencies come first: voters that echo each other would else be taken for the class
        self.parent = self._tree(v, q)
        for k in range(rounds):
            rate, logit = self._rates(v, q), base.copy()
            self.label_rates = np.array([[(w @ (known == y) + 1) / (w @ (known >= 0) + 2) for y in (0, 1)] for w in (1 - q, q)])
            for y in (0, 1):
                logit += np.where(known == y, np.log(self.label_rates[1, y] / self.label_rates[0, y]), 0.0)
            for j in range(m):
                given = votes[:, self.parent[j]].astype(int) if self.parent[j] >= 0 else 0
                logit += np.where(votes[:, j], np.log(rate[1, j][given] / rate[0, j][given]), 0.0)
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            if np.abs(new - q).max() < 1e-4 and k > 4:
                break
            q = new
        self.rates = rate
        return q

    def _rates(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """rate[class, voter, vote of its parent]."""
        out = np.zeros((2, v.shape[1], 2))
        for c, weight in ((0, 1 - q), (1, q)):
            alone = (weight @ v + 0.5) / (weight.sum() + 1)
            for j, up in enumerate(self.parent):
                if up < 0:
                    out[c, j] = alone[j]
                    continue
                for g in (0, 1):
                    w = weight * (v[:, up] == g)
                    out[c, j, g] = (w @ v[:, j] + 2 * alone[j]) / (w.sum() + 2)
        return np.clip(out, 1e-4, 1 - 1e-4)

    def _tree(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Maximum spanning tree of the voters' mutual information given the class (Prim)."""
        m = v.shape[1]
        info, entropy = np.zeros((m, m)), np.zeros(m)
        for weight in (1 - q, q):
            total = weight.sum() + 1e-9
            on = weight @ v / total
            both = (v * weight[:, None]).T @ v / total
            p = np.clip(on, 1e-12, 1 - 1e-12)
            entropy -= total / len(q) * (p * np.log(p) + (1 - p) * np.log(1 - p))
            for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)):
                pa_, pb = (on if a else 1 - on)[:, None], (on if b else 1 - on)[None, :]
                joint = {(1, 1): both, (1, 0): on[:, None] - both, (0, 1): on[None, :] - both, (0, 0): 1 - on[:, None] - on[None, :] + both}[a, b]
                joint = np.clip(joint, 1e-12, 1)
                info += total / len(q) * joint * np.log(joint / np.clip(pa_ * pb, 1e-12, 1))
        np.fill_diagonal(info, -1)
        parent = np.full(m, -1)
        if m > 1:
            inside, best, via = np.zeros(m, bool), np.full(m, -np.inf), np.zeros(m, int)
            inside[0] = True
            best, via = info[0].copy(), np.zeros(m, int)
            for _ in range(m - 1):
                j = int(np.argmax(np.where(inside, -np.inf, best)))
                inside[j] = True
                if best[j] > DEPENDS * min(entropy[j], entropy[via[j]]) + 0.002:
                    parent[j] = via[j]
                nearer = info[j] > best
                best[nearer], via[nearer] = info[j][nearer], j
        return parent


def _inputs(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of the linear classifier: how often each term occurs, and how densely all do."""
    total = counts.sum(axis=1)
    dense = np.log1p(200 * total / np.maximum(words, 1))
    return np.hstack([np.log1p(counts), np.log1p(total)[:, None], dense[:, None], np.log1p(words)[:, None]])


class Model:
    def __init__(self, counter: Counter, weights: np.ndarray, bias: float):
        self.counter, self.weights, self.bias = counter, weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi in tb.pieces(texts):
            logit = _inputs(*self.counter.counts(texts.slice(lo, hi - lo))) @ self.weights + self.bias
            out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
        return np.concatenate(out)


def _linear(x: np.ndarray, q: np.ndarray, weight: np.ndarray, penalty: float = 0.3, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels and weighted rows by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (weight * (q - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


class Voters:
    """The terms that voters are made of, and votes on texts."""

    def __init__(self, texts: pa.Array, y: np.ndarray):
        """Chosen by labelled texts: which terms are suggested, and where dense and sparse begin."""
        self.lexicons = [_hashes(words.split()) for words in LEXICONS.values()]
        self.fixed = np.unique(np.concatenate(self.lexicons))
        mined = _suggested(texts, y) if len(y) else np.zeros(0, _U)
        self.counter = Counter(np.concatenate([self.fixed, mined[~np.isin(mined, self.fixed)]]))
        counts, words = self.counts(texts)
        density = counts.sum(axis=1) / np.maximum(words, 1)
        self.dense = float(np.quantile(density[y == 0], DENSE)) if (y == 0).any() else np.inf
        self.sparse = np.quantile(density[y == 1], SPARSE) if (y == 1).any() else np.zeros(0)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.counter.counts(texts.slice(lo, hi - lo)) for lo, hi in tb.pieces(texts)]
        return np.vstack([np.zeros((0, len(self.counter.chosen))), *(c for c, _ in parts)]), np.concatenate([np.zeros(0), *(n for _, n in parts)])

    def votes(self, texts: pa.Array, counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Votes (rows x voters) and which of the voters vote for the clean class."""
        gaps = np.maximum(1, words / GAP)
        terms = range(len(self.fixed), min(len(self.fixed) + VOTERS, counts.shape[1]))
        found = [counts[:, np.isin(self.counter.chosen, h)].sum(axis=1) for h in self.lexicons] + [counts[:, j] for j in terms]
        density = counts.sum(axis=1) / np.maximum(words, 1)
        toxic = [c >= least * gaps for c in found for least in (1, 2)] + [density > self.dense]
        toxic += list(_patterns(texts, {x for k in ("insult", "contempt", "profanity") for x in LEXICONS[k].split()}).T)
        sparse = [density < c for c in self.sparse]
        return np.column_stack([*toxic, *sparse]), np.array([False] * len(toxic) + [True] * len(sparse))


def posterior(voters: Voters, texts: pa.Array, counts: np.ndarray, words: np.ndarray, known: np.ndarray, share: float) -> tuple[np.ndarray, LabelModel]:
    """The label model's posterior of each text. Of labelled rows the sample's share of toxic ones is the chance
    beforehand, of others ``share``."""
    votes, clean = voters.votes(texts, counts, words)
    some = votes.any(axis=0)
    mine = (known == 1).sum() / max(1, (known >= 0).sum())
    prior = np.clip(np.where(known >= 0, mine, share), 0.001, 0.999)
    model = LabelModel()
    return model.fit(votes[:, some], clean[some], prior, known), model


def train(texts: pa.Array, y: np.ndarray, share: float, hide: bool = False) -> Model:
    """Voters, label model and classifier of a sample with labels 0 and 1, or -1 where there is none; ``share`` is that
    of toxic texts among all labelled. ``hide`` keeps the labels from the label model: they then choose the voters only."""
    own = np.flatnonzero(y >= 0)
    voters = Voters(texts.take(pa.array(own)), y[own])
    if not len(own):  # nothing to learn from: each word of the lexicons counts alike
        return Model(voters.counter, np.concatenate([np.full(len(voters.counter.chosen), 2.0), np.zeros(3)]), -3.0)
    counts, words = voters.counts(texts)
    q, _ = posterior(voters, texts, counts, words, np.full(len(y), -1.0) if hide else y, share)
    mine = float(np.clip(y[own].mean(), 0.001, 0.999))
    weight = np.where(y == 1, share / mine, np.where(y == 0, (1 - share) / (1 - mine), 1.0))
    return Model(voters.counter, *_linear(_inputs(counts, words), q, weight))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Trained on rows of which crc32 of doc_id mod 5 is not 0, labelled ones and some without a label."""
    model = train(*labelled(docs, labels, "toxic", lambda i: fold(i, 5) != 0, ROWS, BYTES, UNLABELLED))
    trim()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to (doc_id, score), a row for each row; null and empty texts get the score of no terms."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: some hundred terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held.value.scores(b.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op1_toxicity(spark, sf_dir):
    """The toxicity of each whole text of ``documents``. A null or empty text gets the score of no terms; every row has a
    row, repeated ones equal scores, and a row without doc_id is in the held-out fold of the empty id's crc32."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
