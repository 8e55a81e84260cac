"""Language identification of code-switched text by a linear-chain conditional random field.

Words are labelled by forward-backward over affix, character n-gram and lexicon features with learned
transitions; a document's language is the one with the largest mean word marginal.  The model is fit
on about ``PER_LANGUAGE`` labelled texts of each language (see ``sample``),
spliced into sequences that change language, so transitions are learned from switches.

Words are the chunks between blanks; a chunk of over ``crf.LONG`` characters that are not all letters is
read as its runs of letters, each a word.

Defined results: null text, or text without a letter, gives ``und`` with score 0; with no labelled
rows every document is ``und``; repeated rows are scored alike; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memory import task
from .crf import Crf, clean, forget, scorer_for, split, train

#: Bound of the labelled sample: documents a language, and bytes of a document that may be in it.
PER_LANGUAGE, LONGEST = 200, 100_000
#: Mean words before a spliced training sequence changes language.
RUN_WORDS = 40


def held_out(doc_id: str = "doc_id"):
    """Documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def splice(docs: list[tuple[int, list[str]]], seed: int = 3) -> list[tuple[list[str], np.ndarray]]:
    """Sequences of runs of words, each run from one document; every word of every document is used once."""
    rng = np.random.default_rng(seed)
    runs = []
    for state, words in docs:
        at = 0
        while at < len(words):
            n = int(rng.geometric(1 / RUN_WORDS))
            runs.append((state, words[at : at + n]))
            at += n
    out = []
    order = rng.permutation(len(runs))
    for s in range(0, len(order), 5):
        part = [runs[i] for i in order[s : s + 5]]
        out.append(([w for _, ws in part for w in ws], np.concatenate([np.full(len(ws), k) for k, ws in part])))
    return out


def sample(rows: DataFrame, label: str, each: int, seed: int) -> list:
    """(label, text) of about ``each`` distinct texts of every label, never more than twice as many in all.

    Texts are drawn by their hash among those of up to ``LONGEST`` bytes; repeated rows count once.
    """
    known = rows.select(F.col(label).alias("label"), "text", F.xxhash64(F.lit(seed), "text").alias("draw"))
    known = known.where(F.col("label").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST))
    sizes = {r[0]: r[1] for r in known.groupBy("label").agg(F.approx_count_distinct("draw")).collect()}  # one row a label
    if not sizes:
        return []
    grain = 1 << 30
    share = F.lit(0)
    for value, n in sorted(sizes.items()):
        share = F.when(F.col("label") == F.lit(value), F.lit(min(grain, grain * each // max(1, n)))).otherwise(share)
    drawn = known.where(F.pmod("draw", F.lit(grain)) < share).dropDuplicates(["label", "draw"])
    found = drawn.orderBy("draw", "label").limit(2 * each * len(sizes)).select("label", "text").collect()  # the bounded sample
    return sorted((r[0], r[1]) for r in found)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Crf | None:
    """Learns from text and non-null lang of the documents that are not held out."""
    rows = sample(docs.where(~held_out()), "lang", per_language, 11)
    if not rows:
        return None
    states = sorted({lang for lang, _ in rows})
    return train(states, splice([(states.index(lang), [w for w in map(clean, split(text)) if w]) for lang, text in rows]))


def _means(n: int, doc: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and mean marginals (0 without words), of each of ``n`` texts."""
    words = np.bincount(doc, minlength=n)
    sums = [np.bincount(doc, p[:, s], n) for s in range(p.shape[1])]
    return words, np.stack(sums, axis=1) / np.maximum(words, 1)[:, None]


def identify(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, lang_pred, score, n_words, switches (changes of the likeliest language between words)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batch):
        import pyarrow as pa

        n, scorer = batch.num_rows, scorer_for(sent.value)
        lang, score, count, switches = np.full(n, "und", object), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for part, _, doc, letters, p in scorer.marginals(batch.column(1)) if scorer else ():
            own, p = doc[letters], p[letters]
            words, mean = _means(len(part), own, p)
            best, top = mean.argmax(axis=1), p.argmax(axis=1)
            change = (own[1:] == own[:-1]) & (top[1:] != top[:-1])
            has = np.flatnonzero(words)
            lang[part[has]] = np.array(sent.value.states, object)[best[has]]
            score[part[has]] = np.clip(mean[has, best[has]], 0, 1)
            count[part] = words
            switches[part] = np.bincount(own[1:][change], minlength=len(part))
        columns = [batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(count), pa.array(switches)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "n_words", "switches"])

    def run(batches):
        with task(forget):
            yield from map(label, batches)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long, switches long")


def keep_identified(docs: DataFrame, model: Crf | None, least: float = 0.5) -> DataFrame:
    """``docs`` without those that have no letter or whose best language has a mean marginal under ``least``."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def keep(batch):
        import pyarrow as pa

        chosen, scorer = np.zeros(batch.num_rows, bool), scorer_for(sent.value)
        for part, _, doc, letters, p in scorer.marginals(batch.column(batch.schema.get_field_index("text"))) if scorer else ():
            chosen[part] = _means(len(part), doc[letters], p[letters])[1].max(axis=1) >= least
        return batch.filter(pa.array(chosen))

    def run(batches):
        with task(forget):
            yield from map(keep, batches)

    return docs.mapInArrow(run, schema)
