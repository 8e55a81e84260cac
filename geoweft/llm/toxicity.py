"""Toxicity by a linear-chain conditional random field over words.

Labels are given for documents only, so word labels come from a lexicon found by greedy cover: words
that occur almost only in toxic training documents, taken by how many toxic documents they newly
cover.  The field is trained on those word labels; forward-backward marginals give offending spans,
and a document's largest marginal and sum of marginals, calibrated on the training labels, its score.  The model is
fit on at most about ``PER_LABEL`` labelled documents of each label (chosen by a hash of doc_id).

Words are those of ``langid``: long chunks without blanks are read as their runs of letters.

Defined results: null, empty and wordless texts get the score of no toxic word; repeated rows are
scored alike; with no labelled rows every score is 0; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import materialize
from ._memory import task
from .crf import Crf, Scorer, clean, forget, places, scorer_for, split, train
from .langid import held_out, sample

#: Bound of the labelled sample, documents a label.
PER_LABEL = 1000
#: Letters of a lexicon stem, from and to.
STEM = (4, 9)
#: Words of a training sequence; whole texts are cut into such pieces.
PIECE = 200


def stems(words: set[str]) -> set[str]:
    """Prefixes of at least ``STEM[0]`` letters: words with a common stem count together."""
    return {w[:k] for w in words for k in range(min(STEM[0], len(w)), min(STEM[1], len(w)) + 1)}


def lexicon(docs: list[tuple[int, list[str]]], precision: float = 0.8, least: float = 0.005) -> set[str]:
    """Stems of toxic documents by greedy cover; a stem that clean documents have by chance must come twice."""
    counted = []
    for y, words in docs:
        n: Counter[str] = Counter()
        for w, k in Counter(words).items():
            for x in stems({w}):
                n[x] += k
        counted.append((y, {(x, k) for x, c in n.items() for k in (1, 2) if c >= k}))
    toxic, fine = [w for y, w in counted if y], Counter(x for y, w in counted if not y for x in w)
    df = Counter(x for w in toxic for x in w)
    ratio = len(toxic) / max(1, len(docs) - len(toxic))
    good = {x for x, n in df.items() if n >= 3 and n / (n + fine[x] * ratio) >= precision}
    left, out = [w & good for w in toxic], set()
    while left:
        gain = Counter(x for w in left for x in w)
        if not gain:
            break
        best, n = min(gain.items(), key=lambda g: (-g[1], fine[g[0]], -len(g[0][0]), g[0]))
        if n < max(3, least * len(toxic)):
            break
        out.add(best[0])
        left = [w for w in left if best not in w]
    # stems that go with the found ones: the cover needs one of them, the tagger all
    often = {x for x in good if x[1] == 1 and df[x] >= 0.1 * len(toxic)}
    shorter = {(x[:-1], 1) for x, _ in often if df[x[:-1], 1] == df[x, 1]}
    return out | {x for x, _ in often - shorter}


class Toxicity:
    """The field, the calibration of a document's marginals, and scoring."""

    def __init__(self, model: Crf, weights: np.ndarray):
        self.model, self.weights = model, weights

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(summary) @ self.weights, -60, 60)))


def _summary(n: int, doc: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Largest marginal, sum of the marginals of at least 0.2, and words of each of ``n`` texts."""
    largest = np.zeros(n)
    np.maximum.at(largest, doc, p)
    return np.stack([largest, np.bincount(doc, np.where(p >= 0.2, p, 0), n), np.bincount(doc, minlength=n)], axis=1)


def _inputs(summary: np.ndarray) -> np.ndarray:
    x = np.clip(summary[:, 0], 1e-4, 1 - 1e-4)
    return np.stack([np.log(x / (1 - x)), np.log1p(summary[:, 1]), summary[:, 1] / np.sqrt(1 + summary[:, 2]), np.ones(len(x))], axis=1)


def _calibrate(summary: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression on a document's marginals, with a weak prior, by damped Newton steps."""
    X, prior = _inputs(summary), np.array([0.5, 1.0, 1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = X @ w
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + np.eye(4), X.T @ (y - p) - (w - prior))
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
    return w


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Toxicity | None:
    """Learns from documents and labels that are not held out."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}  # two rows
    draw, grain = F.xxhash64(F.lit(13), "doc_id"), 1 << 30
    share = F.lit(0)
    for label, n in sizes.items():  # more ids than texts are wanted, for some have no text or the same
        share = F.when(F.col("toxic") == label, F.lit(min(grain, 2 * grain * per_label // n))).otherwise(share)
    ids = known.where(F.pmod(draw, F.lit(grain)) < share).orderBy(draw, "toxic").limit(8 * per_label)
    drawn = materialize(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "labelled")
    texts = sample(drawn, "toxic", per_label, 13)
    if len({t[0] for t in texts}) < 2:
        return None
    words = [[clean(c) for c in split(t)] for _, t in texts]
    y = np.array([t[0] for t in texts])
    bad = lexicon([(k, [x for x in w if x]) for k, w in zip(y, words)])
    tagged = [(w, np.array([int(bool(k) and not stems({x}).isdisjoint(bad)) for x in w], np.int64)) for k, w in zip(y, words)]
    model = train(["fine", "toxic"], [(w[i : i + PIECE], t[i : i + PIECE]) for w, t in tagged for i in range(0, len(w), PIECE)], prefix=STEM[1])
    summary = np.zeros((len(texts), 3))
    import pyarrow as pa

    for part, _, doc, letters, p in Scorer(model).marginals(pa.array([t for _, t in texts], pa.string())):
        summary[part] = _summary(len(part), doc, np.where(letters, p[:, 1], 0))
    return Toxicity(model, _calibrate(summary, y))


SCORED = "doc_id long, score double, spans array<struct<begin:int,end:int,p:double>>"


def score_toxicity(docs: DataFrame, model: Toxicity | None, span_at: float = 0.5) -> DataFrame:
    """doc_id, score, spans: character offsets of the words whose marginal reaches ``span_at``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch):
        import pyarrow as pa

        tox, n = sent.value, batch.num_rows
        scorer = scorer_for(tox.model if tox else None)
        summary, spans = np.zeros((n, 3)), [[] for _ in range(n)]
        for part, texts, doc, letters, p in scorer.marginals(batch.column(1)) if scorer else ():
            p = np.where(letters, p[:, 1], 0)
            summary[part] = own = _summary(len(part), doc, p)
            starts = np.searchsorted(doc, np.arange(len(part) + 1))
            for i in np.flatnonzero(own[:, 0] >= span_at):
                mine = p[starts[i] : starts[i + 1]]
                words = places(texts[i])
                if len(words) == len(mine):
                    spans[part[i]] = [{"begin": words[k][0], "end": words[k][1], "p": float(mine[k])} for k in np.flatnonzero(mine >= span_at)]
        found = tox.score(summary) if tox else summary[:, 0]
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    def run(batches):
        with task(forget):
            yield from map(score, batches)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)
