"""Linear-chain conditional random field over words, in numpy.

Sequences are laid out by position (all first words, then all second words, ...), longest first, so
forward-backward runs over whole batches of texts at once.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import groupby

import numpy as np

from ._memory import hold

#: Characters from the first to the last letter above which a chunk that is not all letters is read as its runs of letters.
LONG = 64


_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _K1
    x ^= x >> np.uint64(32)
    x *= _K2
    x ^= x >> np.uint64(29)
    return x


def _letter_hashes(text: str) -> np.ndarray:
    return _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + _K2)


def features(words: list[str], prefix: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features of non-empty words as 64-bit hashes, and the number of the word that has each.

    They are the word itself (its lexicon entry, at the front, in order), prefixes up to ``prefix`` letters,
    suffixes up to three, and character 2- and 3-grams with the word's ends marked.
    """
    n = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(n)
    start, place = end - n, np.arange(n.sum()) - np.repeat(end - n, n)
    h = _letter_hashes("".join(words))
    whole = np.add.reduceat(_mix(h + place.astype(np.uint64) * _K2), start) if len(words) else np.empty(0, np.uint64)
    codes, owner = [_mix(whole ^ np.uint64(1))], [np.arange(len(words))]
    for kind, longest in ((2, prefix), (3, 3)):
        run = np.full(len(words), kind, np.uint64)
        for k in range(longest):
            has = np.flatnonzero(n > k)
            run[has] = _mix(run[has] + h[start[has] + k if kind == 2 else end[has] - 1 - k])
            codes.append(run[has])
            owner.append(has)
    h = _letter_hashes("^" + "$^".join(words) + "$") if words else h
    word = np.repeat(np.arange(len(words)), n + 2)
    grams = h
    for size in (1, 2):
        grams = _mix(grams[:-1] * _K1 + h[size:])
        inside = np.flatnonzero(word[:-size] == word[size:])
        codes.append(grams[inside])
        owner.append(word[inside])
    return np.concatenate(codes), np.concatenate(owner)


def _letters(chunk: str) -> tuple[int, int]:
    """Where the first letter begins and the last ends."""
    a, b = 0, len(chunk)
    while a < b and not chunk[a].isalpha():
        a += 1
    while b > a and not chunk[b - 1].isalpha():
        b -= 1
    return a, b


def clean(chunk: str) -> str:
    """The chunk from its first to its last letter, lower-cased; empty if it has none."""
    if chunk.isalpha():
        return chunk.lower()
    a, b = _letters(chunk)
    return chunk[a:b].lower()


def places(text: str) -> list[tuple[int, int]]:
    """Begin and end of each word: chunks between blanks, long ones by runs of letters and their marks."""
    out = []
    for m in re.finditer(r"\S+", text):
        chunk, at = m[0], m.start()
        if len(chunk) > LONG and not chunk.isalpha():
            a, b = _letters(chunk)
            if b - a > LONG:
                at += a
                for inside, run in groupby(chunk[a:b], lambda c: c.isalpha() or unicodedata.category(c)[0] == "M"):
                    n = sum(1 for _ in run)
                    if inside:
                        out.append((at, at + n))
                    at += n
                continue
        out.append(m.span())
    return out


def split(text: str) -> list[str]:
    """The words of ``places``, lower-cased."""
    chunks = text.lower().split()
    if max(map(len, chunks), default=0) <= LONG:
        return chunks
    return [text[a:b].lower() for a, b in places(text)]


class Layout:
    """Where the words of texts of the given lengths lie in position-major order."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        ordered = lengths[self.order]
        steps = int(ordered[0]) if len(ordered) else 0
        self.active = np.searchsorted(-ordered, -np.arange(steps), side="left")
        self.start = np.concatenate([[0], np.cumsum(self.active)])
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        position = np.arange(len(self.doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.index = self.start[position] + rank[self.doc]


def forward_backward(layout: Layout, scores: np.ndarray, transitions: np.ndarray, expect: bool = False):
    """Marginals in text order, and the expected transition counts if asked for."""
    E = np.empty_like(scores)
    E[layout.index] = np.exp(scores - scores.max(axis=1, keepdims=True))
    A, s, active = np.exp(transitions), layout.start, layout.active
    alpha, scale = np.empty_like(E), np.ones(len(E))
    for t, n in enumerate(active):
        a = E[s[t] : s[t] + n]
        if t:
            a = (alpha[s[t - 1] : s[t - 1] + n] @ A) * a
        c = a.sum(axis=1)
        scale[s[t] : s[t] + n] = c
        alpha[s[t] : s[t] + n] = a / c[:, None]
    beta, counts, B = np.ones_like(E), np.zeros_like(A), A.T.copy()
    E /= scale[:, None]
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        e = E[s[t + 1] : s[t + 1] + n] * beta[s[t + 1] : s[t + 1] + n]
        beta[s[t] : s[t] + n] = e @ B
        if expect:
            counts += (alpha[s[t] : s[t] + n].T @ e) * A
    alpha *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    return alpha[layout.index], counts


class Crf:
    """Trained weights (a row of ``table`` for each of the sorted ``codes``) and the scores of words; picklable."""

    #: Leading bits of a hash that number the places where a search begins.
    BITS = 20

    def __init__(self, states: list[str], codes: np.ndarray, table: np.ndarray, transitions: np.ndarray, prefix: int = 3):
        self.states, self.codes, self.table, self.transitions, self.prefix = states, codes, table, transitions, prefix
        self.first = np.searchsorted(codes >> np.uint64(64 - self.BITS), np.arange((1 << self.BITS) + 1, dtype=np.uint64)).astype(np.int32)

    def rows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``codes`` are known, and their rows."""
        begin = (codes >> np.uint64(64 - self.BITS)).astype(np.int64)
        row, last = self.first[begin], self.first[begin + 1]
        left, known, found = np.flatnonzero(row < last), [], []
        row, last = row[left], last[left]
        while len(left):
            same = self.codes[row] == codes[left]
            known.append(left[same])
            found.append(row[same])
            row = row + 1
            go = ~same & (row < last)
            left, row, last = left[go], row[go], last[go]
        none = np.empty(0, np.int64)
        return np.concatenate([none, *known]), np.concatenate([none, *found])

    def word_scores(self, cleaned: list[str]) -> np.ndarray:
        """Sum of feature weights of each word; zero for words without letters."""
        out = np.zeros((len(cleaned), len(self.states)), np.float32)
        has = [i for i, w in enumerate(cleaned) if w]
        for at in range(0, len(has), 20_000):
            part = has[at : at + 20_000]
            codes, owner = features([cleaned[i] for i in part], self.prefix)
            known, row = self.rows(codes)
            for s in range(len(self.states)):
                out[part, s] = np.bincount(owner[known], self.table[row, s], len(part))
        return out


class Scorer:
    """Marginals of texts, with a bounded memory of word scores."""

    def __init__(self, model: Crf, entries: int = 200_000, batch_chars: int = 1_000_000):
        self.model, self.entries, self.batch_chars = model, entries, batch_chars
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}  # chunk to its row of scores
        self.scores = np.zeros((1024, len(self.model.states)), np.float32)
        self.letters = np.zeros(1024, bool)

    def _rows(self, chunks: list[str]) -> np.ndarray:
        first, known = len(self.known), self.known
        fresh = [c for c in set(chunks) if c not in known]
        if fresh:
            last = first + len(fresh)
            if last > len(self.letters):
                room = max(last, 2 * len(self.letters)) - len(self.letters)
                self.scores = np.concatenate([self.scores, np.zeros((room, self.scores.shape[1]), np.float32)])
                self.letters = np.concatenate([self.letters, np.zeros(room, bool)])
            known.update(zip(fresh, range(first, last)))
            cleaned = list(map(clean, fresh))
            self.scores[first:last] = self.model.word_scores(cleaned)
            self.letters[first:last] = np.fromiter(map(bool, cleaned), bool, len(cleaned))
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

    def marginals(self, texts):
        """Of an Arrow array of texts, in parts: (positions, the texts there, text number of each word, has letters, marginals).

        Texts of like length are taken together, so that a batch takes few steps; only a part of them is unpacked at once.
        """
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        order, at = np.argsort(-sizes, kind="stable"), 0
        while at < len(order) and sizes[order[at]]:
            end, total = at, 0
            while end < len(order) and sizes[order[end]] and (end == at or total + sizes[order[end]] <= self.batch_chars):
                total += sizes[order[end]]
                end += 1
            part, at = order[at:end], end
            own = texts.take(part).to_pylist()
            parts = [split(t) for t in own]
            lengths = np.array([len(c) for c in parts], np.int64)
            if not lengths.any():
                continue
            if not lengths.all():
                own = [t for t, n in zip(own, lengths) if n]
                part, lengths = part[lengths > 0], lengths[lengths > 0]
            rows = self._rows([c for chunks in parts for c in chunks])
            del parts
            layout = Layout(lengths)
            p, _ = forward_backward(layout, self.scores[rows], self.model.transitions.astype(np.float32))
            yield part, own, layout.doc, self.letters[rows], p
            if len(self.known) > self.entries:
                self.reset()


def train(states: list[str], sequences: list[tuple[list[str], np.ndarray]], updates: int = 150, rate: float = 0.3, l2: float = 1e-4, batch_words: int = 20_000, least: int = 2, prefix: int = 3, seed: int = 5) -> Crf:
    """Conditional likelihood by Adagrad; ``sequences`` are cleaned words with a state number each (-1: unknown, not learned from)."""
    vocabulary: dict[str, int] = {}
    coded = [(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words)), y) for words, y in sequences]
    numbers = np.array([i for w, i in vocabulary.items() if w], np.int64)
    found, owner = features([w for w in vocabulary if w], prefix)
    codes, back, seen = np.unique(found, return_inverse=True, return_counts=True)
    chosen = seen >= least
    chosen[back[: len(numbers)]] = True  # lexicon entries
    codes, new = codes[chosen], np.cumsum(chosen) - 1
    keep = np.flatnonzero(chosen[back])
    owner = numbers[owner[keep]]
    order = np.argsort(owner, kind="stable")
    flat, sizes = new[back[keep]][order], np.bincount(owner, minlength=len(vocabulary))
    first = np.cumsum(sizes) - sizes
    S = len(states)
    table, trans = np.zeros((len(codes), S)), np.zeros((S, S))
    g_table, g_trans = np.full_like(table, 1e-2), np.full_like(trans, 1e-2)
    rng = np.random.default_rng(seed)
    epochs = max(2, -(-updates * batch_words // max(1, sum(len(w) for w, _ in coded))))
    for _ in range(min(epochs, updates)):
        order = rng.permutation(len(coded))
        at = 0
        while at < len(order):
            part, total = [], 0
            while at < len(order) and total < batch_words:
                part.append(order[at])
                total += len(coded[order[at]][0])
                at += 1
            part = [i for i in part if len(coded[i][0])]
            if not part:
                continue
            lengths = np.array([len(coded[i][0]) for i in part])
            words, y = np.concatenate([coded[i][0] for i in part]), np.concatenate([coded[i][1] for i in part])
            unique, back = np.unique(words, return_inverse=True)
            n = sizes[unique]
            nz = np.repeat(first[unique] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            feats, owner = flat[nz], np.repeat(np.arange(len(unique)), n)
            scores = np.stack([np.bincount(owner, table[feats, s], len(unique)) for s in range(S)], axis=1)
            layout = Layout(lengths)
            p, expected = forward_backward(layout, scores[back], trans, True)
            hot = np.zeros_like(p)
            known = y >= 0
            hot[np.flatnonzero(known), y[known]] = 1
            hot[~known] = p[~known]
            diff = hot - p
            word_grad = np.stack([np.bincount(back, diff[:, s], len(unique)) for s in range(S)], axis=1)
            used, place = np.unique(feats, return_inverse=True)
            grad = np.stack([np.bincount(place, word_grad[owner, s], len(used)) for s in range(S)], axis=1) / len(part) - l2 * table[used]
            g_table[used] += grad * grad
            table[used] += rate * grad / np.sqrt(g_table[used])
            follows = (layout.doc[1:] == layout.doc[:-1]) & known[1:] & known[:-1]
            real = np.zeros_like(trans)
            np.add.at(real, (y[:-1][follows], y[1:][follows]), 1)
            t_grad = (real - expected) / len(part) - l2 * trans
            g_trans += t_grad * t_grad
            trans += rate * t_grad / np.sqrt(g_trans)
    return Crf(states, codes, table.astype(np.float32), trans, prefix)


_last: list[Scorer] = []


def scorer_for(model: Crf | None) -> Scorer | None:
    """The worker's scorer of this model."""
    if model is None:
        return None
    hold("words", _last.clear)
    if not _last or _last[0].model is not model:
        _last[:] = [Scorer(model)]
    return _last[0]


def forget() -> None:
    """Drop the word scores of this worker; for the end of a task."""
    for scorer in _last:
        scorer.reset()
