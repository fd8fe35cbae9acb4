"""Toxicity scores by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

Voters look at the letters-only words of a whole text, lower-cased. Some are fixed: lists of insults for each language, insults written
with digits or stars, an insult near a word of address, shouted insults. Others are stems (words, and their first four to
six letters) mined from learning rows: those far more common in toxic rows, dealt over ``MINED_VOTERS`` voters so that each
votes on its own stems. One votes on texts with two stems or more, and one says clean of a text of some length in which no voter
finds anything. Every voter says toxic, or clean, or nothing.

The label model is a two-class latent variable model, fitted by expectation-maximisation to the votes of all documents (equal vote
patterns are counted first). Voters are not independent given the class: the pairs of voters that depend most on each other
within a class are chosen as its tree (the spanning forest of greatest mutual information, as Chow and Liu's), and each
pair gets parameters, by how much oftener both, one or neither votes toxic than independent voters would. They are fitted in
each step as the accuracies are, so votes and silence of voters that vote together count once. The voter for clean is in no pair: that it is
silent where another one speaks counts as evidence of its own. The known label of a learning row is one more voter, of given accuracy.
The fit starts from these labels alone; all other documents together then count as ``UNLABELLED`` times the learning rows do (without
any, fully). Posterior labels are the targets of a logistic regression on the stems' and voters' hits, fitted by Newton steps on a
bounded sample.

Bounds: ``SAMPLE`` learning rows (by hash of doc_id) for mining, ``SAMPLE`` of them and as many other documents for the regression,
``STEMS`` stems. Votes, counts and correlations cover every document, whatever its weight. Held-out labels are never used.

Defined results: null and empty texts get the score of a text without hits; a null doc_id is scored, not learnt from; labels that are
null are not used, several of a document count as toxic if any is; repeated rows get a row each; without learning rows the fixed
voters decide. Copies and most near copies count once in mining, so that they don't make their words into stems.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ngram_join import ngram_sets
from .quality import fold
from .work import Work, lean, slices, tree_sum

HELD_OUT, FOLDS, CUT = 1, 3, 0.7
SAMPLE, STEMS, MINED_VOTERS, LEAST_SUPPORT, LEAST_ODDS = 20_000, 600, 16, 4, 3.0
#: How often a learning row's label is taken to be right. Not estimated: the classes would drift from those of the labels to those of the votes.
LABEL_RIGHT = 0.99
#: Likelihood ratio statistic from which two voters may be a pair (a chance of 0.001), and the number of rows, as if independent, that each outcome of a pair starts from.
PAIR_LEAST, PAIR_ROWS = 10.83, 0.5
#: Weight in the label model of all documents without a known label, as a share of that of the learning rows.
UNLABELLED = 0.3
#: Words below which a text without hits isn't taken for clean.
LONG = 5

#: Common insults and threats by language.
LEXICONS = {
    "en_person": "idiot idiots moron morons imbecile loser losers clown clowns scum scumbag bastard bastards bitch asshole jerk dumbass retard creep coward freak",
    "en_trait": "stupid pathetic worthless disgusting dumb ugly filthy vile useless brainless disgrace trash garbage vermin",
    "en_obscene": "fuck fucking fucker shit shitty bullshit crap damn cunt dick whore slut",
    "en_threat": "kill die murder hang shoot hurt destroy exterminate",
    "de": "idiot idioten trottel arschloch dummkopf schwachkopf versager abschaum miststück scheisse scheiße hurensohn wichser drecksau depp blödmann",
    "fr": "idiot idiote imbécile connard connasse salaud salope crétin abruti débile minable ordure merde putain enculé",
    "es": "idiota imbécil estúpido estúpida pendejo cabrón puta puto mierda gilipollas basura asqueroso inútil payaso maldito",
}
_ADDRESS = frozenset("you your youre u du dich dein ihr tu toi ton vous votre tú te eres usted".split())
_INSULTS = frozenset(w for k, v in LEXICONS.items() if k != "en_threat" for w in v.split())
_SETS = {k: frozenset(v.split()) for k, v in LEXICONS.items()}
_WORD = re.compile(r"[^\W\d_]+")
_DISGUISED = re.compile(r"\b(?:[a-z]+[*@$!0134]+[a-z*@$!0134]+)", re.IGNORECASE)
_PLAIN_OF = str.maketrans("@$!0134", "asioiea")
FIXED_VOTERS = (*LEXICONS, "disguised", "addressed", "shouted", "several", "any_insult")


def stems_of(word: str) -> tuple[str, ...]:
    """The word itself (marked by an end sign) and its first six, five and four letters."""
    return (word + "$", *(word[:n] for n in (6, 5, 4) if len(word) >= n))


def fixed_hits(text: str, words: list[str], distinct: set[str]) -> list[int]:
    hits = [len(distinct & _SETS[k]) for k in LEXICONS]
    found = distinct & _INSULTS
    disguised = sum(m.group().lower().translate(_PLAIN_OF) in _INSULTS for m in _DISGUISED.finditer(text)) if any(c in text for c in "*@$!0134") else 0
    addressed = shouted = 0
    if found:
        at = [i for i, w in enumerate(words) if w in found]
        addressed = sum(not _ADDRESS.isdisjoint(words[max(0, i - 4) : i + 5]) for i in at)
        shouted = sum(w.upper() in text for w in found)
    return [*hits, disguised, addressed, shouted, max(0, len(found) - 2), len(found)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of a text's word triples: near copies mostly share it, other texts don't."""
    for b in slices(batches):
        texts = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
        hashes, first = ngram_sets(texts, 3)
        least = [int(hashes[s]) >> 1 if e > s else 0 for s, e in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), b.column("label"), b.column("text")], ["same", "label", "text"])


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in which each stem stands, by label."""
    count: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        names = list(count[0].keys() | count[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([count[1][x] for x in names], pa.int64()), pa.array([count[0][x] for x in names], pa.int64())], ["stem", "toxic", "clean"])

    for b in slices(batches):
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            count[label].update({s for w in set(_WORD.findall((text or "").lower())) if len(w) > 2 for s in stems_of(w)})
        if sum(map(len, count)) > 400_000:
            yield out()
            for c in count:
                c.clear()
    yield out()


def choose_stems(rows: list[tuple[str, int, int]], toxic: int, clean: int, most: int) -> list[str]:
    """The stems with the most support; a longer stem only where it isn't just a shorter one again."""
    least = max(LEAST_SUPPORT, toxic // 100)
    odds = {s: np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)) for s, t, c in rows if t >= least}
    support = {s: t for s, t, _ in rows}
    good = sorted((s for s, o in odds.items() if o >= LEAST_ODDS), key=lambda s: (-support[s], len(s), s))
    chosen: list[str] = []
    held: set[str] = set()
    for s in good:
        shorter = [s.rstrip("$")[:n] for n in (4, 5, 6)]
        if not any(x in held and x != s for x in shorter):
            chosen.append(s)
            held.add(s)
        if len(chosen) == most:
            break
    return chosen


_FEATURES = pa.schema([("doc_id", pa.int64()), ("votes", pa.binary()), ("hits", pa.binary())])


def _featurise(stems: list[str], voters: int):
    """Votes (one signed byte for each voter) and hits (16-bit numbers of features: stems, then fixed voters with a hit)."""
    number = {s: i for i, s in enumerate(stems)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            votes, hits = [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                words = _WORD.findall(text.lower())
                distinct = set(words)
                fixed = fixed_hits(text, words, distinct)
                heads = distinct | {w[:n] for n in (4, 5, 6) for w in distinct} if stems else set()
                found = sorted({number[s] for s in heads if s in number} | {number[w + "$"] for w in distinct if w + "$" in number}) if stems else []
                mined = np.zeros(voters, np.int8)
                for i in found:
                    mined[i % voters] = 1
                vote = [*(1 if h else 0 for h in fixed), *mined.tolist(), int(len(found) > 1), 0]
                if len(words) >= LONG and not any(vote):
                    vote[-1] = -1  # the only voter for clean
                votes.append(np.array(vote, np.int8).tobytes())
                hits.append(np.array([*found, *(len(stems) + k for k, h in enumerate(fixed) if h)], "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(votes, pa.binary()), pa.array(hits, pa.binary())], schema=_FEATURES)

    return run


def voter_tree(both: np.ndarray, single: np.ndarray, total: float) -> np.ndarray:
    """Pairs of voters, a forest: those of the greatest mutual information, from the numbers of a class's rows on which both vote toxic and on which each does."""
    n, gain = len(single), np.zeros((len(single), len(single)))
    own, other = single[:, None], single[None, :]
    for a, b, c in ((both, own, other), (own - both, own, total - other), (other - both, total - own, other), (total - own - other + both, total - own, total - other)):
        gain += np.where(a > 1e-9, 2 * a * np.log(np.maximum(a, 1e-9) * total / np.maximum(b * c, 1e-9)), 0)
    np.fill_diagonal(gain, 0)
    tree, pairs = np.arange(n), []
    for k in np.argsort(-gain, axis=None, kind="stable").tolist():
        i, j = divmod(k, n)
        if gain[i, j] < PAIR_LEAST:
            break
        if tree[i] != tree[j]:
            pairs.append((i, j))
            tree[tree == tree[j]] = tree[i]
    return np.array(pairs, int).reshape(-1, 2)


class LabelModel:
    """P(vote | class) of each voter, dependence of paired voters; the class prior is that of the learning rows."""

    def __init__(self, voters: int, prior: float) -> None:
        self.prior, self.fitted, self.unlabelled = prior, False, 1.0
        clean, toxic = [0.09, 0.9, 0.01], [0.01, 0.9, 0.09]  # votes -1, 0, 1
        self.table = np.array([[clean, toxic]] * voters)  # voter, class, vote
        #: By class: pairs, and for each, by toxic votes of the one and the other, the log of their number over that of independent voters.
        self.pairs, self.together = [np.zeros((0, 2), int)] * 2, [np.zeros((0, 2, 2))] * 2

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(toxic | votes, label), votes as rows of -1, 0, 1, labels 0, 1 or NaN."""
        evidence = np.log(self.prior / (1 - self.prior)) + np.where(np.isnan(label), 0, np.where(label == 1, 1, -1) * np.log(LABEL_RIGHT / (1 - LABEL_RIGHT)))
        for k, ratio in enumerate(np.log(self.table[:, 1] / self.table[:, 0]).T):
            evidence += (votes == k - 1) @ ratio
        toxic = (votes == 1).astype(int)
        for sign, pairs, together in zip((-1, 1), self.pairs, self.together, strict=True):
            evidence += sign * together[np.arange(len(pairs)), toxic[:, pairs[:, 0]], toxic[:, pairs[:, 1]]].sum(1)
        return 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))

    def sums(self, votes: np.ndarray, label: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected counts: by class (all; by voter and vote; toxic votes of two voters), flattened."""
        p = self.posterior(votes, label) if self.fitted else np.where(label == 1, LABEL_RIGHT, 1 - LABEL_RIGHT)
        toxic, count = (votes == 1).astype(np.float64), np.where(np.isnan(label), self.unlabelled * count, count)
        out = []
        for q in (count * (1 - p), count * p):
            out.append(np.array([q.sum()]))
            out.append(np.stack([q @ (votes == v) for v in (-1, 0, 1)], 1).ravel())
            out.append(((toxic * q[:, None]).T @ toxic).ravel())
        return np.concatenate(out)

    def update(self, sums: np.ndarray, pair: bool = False) -> None:
        n, classes = len(self.table), np.split(sums, 2)
        total, counts = [own[0] for own in classes], [own[1 : 1 + 3 * n].reshape(n, 3) for own in classes]
        both, single = [own[1 + 3 * n :].reshape(n, n) for own in classes], [c[:, 2] for c in counts]
        if pair:
            self.pairs = [voter_tree(both[c], single[c], total[c]) for c in (0, 1)]
        self.together, self.fitted = [], True
        for c in (0, 1):
            self.table[:, c] = (counts[c] + 1.0) / (counts[c] + 1.0).sum(1, keepdims=True)
            i, j = self.pairs[c].T
            one, other, joint = single[c][i], single[c][j], both[c][i, j]
            found = np.stack([np.stack([total[c] - one - other + joint, other - joint], 1), np.stack([one - joint, joint], 1)], 1)
            expected = found.sum(2, keepdims=True) * found.sum(1, keepdims=True) / max(total[c], 1e-9)
            self.together.append(np.log((np.maximum(found, 0) + PAIR_ROWS) / (np.maximum(expected, 0) + PAIR_ROWS)))
        # A toxic vote is never likelier in a clean document, nor a clean vote in a toxic one.
        toxic, clean = self.table[:, 1], self.table[:, 0]
        toxic[:, 2] = np.maximum(toxic[:, 2], clean[:, 2])
        clean[:, 0] = np.maximum(clean[:, 0], toxic[:, 0])
        self.table /= self.table.sum(2, keepdims=True)


def _votes(b: pa.RecordBatch) -> np.ndarray:
    data = b.column("votes").to_pylist()
    return np.frombuffer(b"".join(data), np.int8).reshape(len(data), -1).astype(np.float64)


def _expect(model: LabelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in slices(batches, 20_000):
            own = model.sums(_votes(b), b.column("label").to_numpy(zero_copy_only=False).astype(np.float64), b.column("n").to_numpy().astype(np.float64))
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def fit_label_model(patterns: DataFrame, voters: int, prior: float, work: Work, steps: int = 6) -> LabelModel:
    """Expectation-maximisation over counted vote patterns (votes, label, n): from labels alone, then a fit, the choice of pairs again, and a fit with these."""
    model = LabelModel(voters, prior)
    labelled = patterns.filter("label is not null")
    known, rows = patterns.agg(F.coalesce(F.sum(F.when(F.col("label").isNotNull(), F.col("n"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if known:
        model.unlabelled = min(1.0, UNLABELLED * known / max(1, rows - known))
    model.fitted = not known
    for step in range(-1 if known else 0, 2 * steps):
        sums = tree_sum((labelled if step < 0 else patterns).mapInArrow(lean(_expect(model)), "sums binary"), work, f"em{step + 1}-")
        if sums is None:
            continue
        model.update(sums, pair=step in (-1, steps - 1))
    return model


def fit_logistic(rows: list[np.ndarray], size: int, target: np.ndarray, ridge: float = 0.1, steps: int = 12) -> np.ndarray:
    """Weights and intercept of a logistic regression on 0/1 features, given as numbers of the features that are 1."""
    x = np.zeros((len(rows), size + 1), np.float32)
    x[:, size] = 1
    for i, own in enumerate(rows):
        x[i, own] = 1
    w = np.zeros(size + 1)
    penalty = np.full(size + 1, ridge)
    penalty[size] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30).astype(np.float64)))
        gradient = x.T @ (p - target).astype(np.float32) + penalty * w
        q = np.maximum(p * (1 - p), 1e-4).astype(np.float32)
        hessian = (x.T * q) @ x
        step = np.linalg.solve(hessian.astype(np.float64) + np.diag(penalty), gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return w


def _classify(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column("hits").to_pylist()
            own = np.frombuffer(b"".join(hits), "<u2")
            of = np.repeat(np.arange(len(hits)), [len(h) // 2 for h in hits])
            z = np.bincount(of, weights[own], len(hits)) + weights[-1] if len(hits) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample: int = SAMPLE, stems: int = STEMS, work: Work | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Reads doc_id and text, and doc_id and toxic of ``labels``."""
    work = work or Work(docs.sparkSession, "toxicity")
    docs = docs.select("doc_id", "text")
    order = F.xxhash64(F.col("doc_id"))
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")).orderBy(order, "doc_id").limit(sample)
    known = work.save(known, "known")  # at most ``sample`` rows of 12 bytes, so it may be broadcast
    learnt = docs.join(F.broadcast(known), "doc_id").mapInArrow(lean(_sketch), "same long, label int, text string").groupBy("same", "label").agg(F.max("text").alias("text"))
    learnt = work.save(learnt.select("text", "label"), "learnt")
    sizes = dict(learnt.groupBy("label").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    mined = learnt.mapInArrow(lean(_mine), "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    found = mined.filter((F.col("toxic") >= max(LEAST_SUPPORT, toxic // 100)) & (odds >= LEAST_ODDS)).orderBy(F.desc("toxic"), "stem").limit(20 * stems)
    chosen = choose_stems([tuple(r) for r in found.collect()], toxic, clean, stems)

    voters = len(FIXED_VOTERS) + MINED_VOTERS + 2
    features = work.save(docs.mapInArrow(lean(_featurise(chosen, MINED_VOTERS)), "doc_id long, votes binary, hits binary"), "features")
    anchored = features.join(F.broadcast(known), "doc_id", "left")
    patterns = work.save(anchored.groupBy("votes", F.col("label").cast("double").alias("label")).agg(F.count(F.lit(1)).alias("n")), "patterns")
    prior = (toxic + 1) / (toxic + clean + 2) if toxic + clean else 0.05
    model = fit_label_model(patterns, voters, min(0.5, prior), work)

    labelled = features.join(F.broadcast(known), "doc_id").orderBy(order, "doc_id", "votes", "hits").limit(2 * sample).select("votes", "hits", "label")
    others = features.orderBy(order, "doc_id").limit(sample).select("votes", "hits", F.lit(None).cast("int").alias("label"))
    table = labelled.unionByName(others).toArrow()
    held = [np.frombuffer(x, "<u2") for x in table.column("hits").to_pylist()]
    size = len(chosen) + len(FIXED_VOTERS)
    if len(held):
        votes = np.frombuffer(b"".join(table.column("votes").to_pylist()), np.int8).reshape(len(held), -1).astype(np.float64)
        label = np.array([np.nan if x is None else x for x in table.column("label").to_pylist()], float)
        weights = fit_logistic(held, size, model.posterior(votes, label))
    else:
        weights = np.append(np.full(size, 4.0), -3.0)
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    scored = features.select("doc_id", "hits").mapInArrow(lean(_classify(weights)), "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
