"""Benchmark decontamination: rare pairs of near words as seeds, then Smith-Waterman alignment of words.

The seeds of the test items are joined with the seeds of the documents on the documents' side: the index of
a block of items is broadcast (``BLOCK_ITEMS`` and ``BLOCK_BYTES`` bound it), and all blocks meet a
document in one reading of the corpus, one block in memory at a time; ``PASS_BLOCKS`` blocks need another
reading.  The score is the local alignment score (match 2, mismatch and gap -1) over the score of the whole
item, so substituted, inserted and dropped words lower it gradually.

No pair of a document and an item that reaches the threshold is lost.  For an item of n words let
T = 2 n threshold.  An alignment of M matches and e errors needs 2 M - e >= T.  Of the M - 1 gaps between
consecutive matches let A have no error and B one; the others have at least two, so e >= B + 2 (M - 1 - A - B)
and hence 2 A + B >= T - 2.  A gap of at most one error joins words at most two apart in the item and in the
document, so looking up every pair of words one or two apart finds it.  The alignment spans at most
M + e <= 3 n - T words.  An item is aligned wherever so many words hold pairs of weight T - 2 (2 for words
adjacent on both sides, else 1); where T <= 2 one word is enough to reach the threshold, so single words
are the seeds.

Of an item's seeds those that more than ``COMMON`` items hold are left out, the commonest first, as long as
half of the weight T - 2 is sure to stay: a gap begins at one word of the item, so a seed left out takes
at most its weight at each word where it begins, and the weight asked for falls by as much.  Which seeds
are left out therefore changes the work and never the result.

Words are runs of letters, marks and digits after lower-casing; characters of scripts written without blanks
are words of their own.

Defined results: null or empty texts and items without words match nothing; an item of one or two words
is found by any of its words at a threshold of a half; equal items and repeated documents are reported each;
a null doc_id or item_id is reported as null; an empty table on either side gives an empty result; extra
columns, whatever their names, are ignored here and passed on by ``drop_contaminated``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import materialize
from ._memory import slices, task

#: Bounds of a block of items: their number and their bytes of text.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8_000_000
#: Blocks (about 50 MB each) that one reading of the corpus takes.
PASS_BLOCKS = 32
BROADCAST_IDS = 2_000_000
#: Items above which a seed is common.
COMMON = 16
#: Seed hits expanded at once in a worker.
HITS = 2_000_000
#: Characters of documents that one block after the other is matched with.
GROUP_CHARS = 8_000_000
_SPACE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
# Beginnings of the Unicode names of characters written without blanks between words.
UNSPACED = ("CJK UNIFIED", "CJK COMPATIBILITY IDEOGRAPH", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR")
FOUND = "doc_id long, item_id long, score double, start_word int, end_word int, text_words int"


@lru_cache(maxsize=10_000)
def _spaced(char: str) -> str | None:
    """What stands for a character beyond ASCII: a blank, the character between blanks, or None for itself."""
    if unicodedata.name(char, "").startswith(UNSPACED):
        return f" {char} " if char.isalnum() else None
    return None if char.isalnum() or unicodedata.category(char)[0] == "M" else " "


def words(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if not text.isascii():
        changed = {ord(c): new for c in set(text) if c > "\x7f" and (new := _spaced(c))}
        text = text.translate(changed) if changed else text
    return text.encode("utf-8", "surrogatepass").translate(_SPACE).split()


class Items:
    """Items of one block over their own vocabulary, with the index of their seeds."""

    def __init__(self, rows: list[tuple[int | None, str]], threshold: float = 0.5):
        texts = [(i, words(t)) for i, t in rows]
        texts = [(i, w) for i, w in texts if w]
        self.ids = [i for i, _ in texts]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int32) for _, ws in texts]
        n = np.array([len(w) for w in self.words], np.int64)
        least = 2 * n * threshold
        self.need = least - 2 - 1e-9
        self.span = np.floor(3 * n - least + 1e-9).astype(np.int64)
        #: Whether an item has single words as seeds.
        self.single = self.need <= 0
        codes, owner, weight, begin = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, w in enumerate(self.words):
            for c, heavy in [(self.alone(w), 1)] if self.single[k] else [(self.pairs(w, 1), 2), (self.pairs(w, 2), 1)]:
                codes.append(c)
                owner.append(np.full(len(c), k))
                weight.append(np.full(len(c), heavy))
                begin.append(np.arange(len(c)))
        code, owner, weight, begin = map(np.concatenate, (codes, owner, weight, begin))
        keep = self._without_common(code, owner, weight, begin)
        code, owner, weight = code[keep], owner[keep], weight[keep]
        order = np.lexsort((-weight, owner, code))
        code, owner, weight = code[order], owner[order], weight[order]
        first = np.ones(len(code), bool)
        first[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        self.owner, self.weight = owner[first].astype(np.int32), weight[first].astype(np.int8)
        self.codes, self.start = np.unique(code[first], return_index=True)
        self.count = np.diff(np.append(self.start, len(self.owner)))

    def _without_common(self, code: np.ndarray, owner: np.ndarray, weight: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Which seeds stay; lowers ``need`` by the weight that the others may have had."""
        held = np.unique(np.stack([code, owner]), axis=1)
        values, holders = np.unique(held[0], return_counts=True)
        fan = holders[np.searchsorted(values, code)] if len(code) else code
        keep = np.ones(len(code), bool)
        often = np.flatnonzero((fan > COMMON) & ~self.single[owner])
        for k in np.unique(owner[often]):
            mine = often[owner[often] == k]
            spare, lost, gone = self.need[k] / 2, {}, 0
            for c in sorted(set(code[mine].tolist()), key=lambda c: (-holders[np.searchsorted(values, c)], c)):
                rows = mine[code[mine] == c]
                new = dict(lost)
                for i, w in zip(begin[rows].tolist(), weight[rows].tolist()):
                    new[i] = max(new.get(i, 0), w)
                if sum(new.values()) > spare:
                    break
                lost, gone = new, sum(new.values())
                keep[rows] = False
            self.need[k] -= gone
        return keep

    def encode(self, text: str | None) -> np.ndarray:
        ws = words(text)
        return np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int64, len(ws))

    def pairs(self, ids: np.ndarray, apart: int) -> np.ndarray:
        """A number for each pair of words ``apart`` places from each other; -1 where one is in no item."""
        a, b = ids[:-apart], ids[apart:]
        return np.where((a >= 0) & (b >= 0), a.astype(np.int64) * len(self.vocabulary) + b, -1)

    def alone(self, ids: np.ndarray) -> np.ndarray:
        """A number for each word, other than those of pairs."""
        return np.where(ids >= 0, len(self.vocabulary) ** 2 + ids.astype(np.int64), -1)

    def _hits(self, ids: np.ndarray):
        """(positions, rows of ``codes``, greatest weight) of the seeds in a document, by kind."""
        kinds = [(self.pairs(ids, 1), 2), (self.pairs(ids, 2), 1)]
        if self.single.any():
            kinds.append((self.alone(ids), 1))
        for codes, most in kinds:
            at = np.flatnonzero(codes >= 0)
            if len(at):
                row = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
                same = self.codes[row] == codes[at]
                if same.any():
                    yield at[same], row[same], most

    def _expand(self, at: np.ndarray, row: np.ndarray, most: int):
        """(item, position, weight) of each hit, in parts of about ``HITS``."""
        total = np.cumsum(self.count[row])
        cuts = np.unique(np.searchsorted(total, np.arange(HITS, total[-1], HITS)))
        for p, r in zip(np.split(at, cuts), np.split(row, cuts)):
            n = self.count[r]
            place = np.repeat(self.start[r] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield self.owner[place].astype(np.int64), np.repeat(p, n), np.minimum(self.weight[place], most).astype(np.int64)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
        """Items that can reach the threshold, and the windows of the document where they can."""
        found, total = list(self._hits(ids)), np.zeros(len(self.ids))
        for hit in found:
            for k, _, w in self._expand(*hit):
                total += np.bincount(k, w, len(total))
        enough = (total >= self.need) & (total > 0)
        if not enough.any():
            return []
        key, weight = [], []
        for hit in found:
            for k, p, w in self._expand(*hit):
                keep = enough[k]
                key.append(k[keep] * len(ids) + p[keep])
                weight.append(w[keep])
        key, weight = np.concatenate(key), np.concatenate(weight)
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        weight = np.maximum.reduceat(weight[order], first)
        item, place = np.divmod(key, len(ids))
        sums = np.concatenate([[0], np.cumsum(weight)])
        end = np.searchsorted(key, item * len(ids) + np.minimum(place + self.span[item], len(ids)))
        good = sums[end] - sums[:-1] >= self.need[item]  # as the first pair of an alignment
        item, place = item[good], place[good]
        low, high = np.maximum(place - self.span[item], 0), np.minimum(place + self.span[item] + 1, len(ids))
        out: list[tuple[int, list[tuple[int, int]]]] = []
        for k, a, b in zip(item.tolist(), low.tolist(), high.tolist()):
            if not out or out[-1][0] != k:
                out.append((k, [(a, b)]))
            elif a <= out[-1][1][-1][1]:
                out[-1][1][-1] = (out[-1][1][-1][0], b)
            else:
                out[-1][1].append((a, b))
        return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment (match 2, mismatch and gap -1): score, end in ``text``."""
    step = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(text == w, 2, -1), row[1:] - 1)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + step) - step
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _matches(items: Items, ids: np.ndarray, threshold: float):
    """(item, score, start, end) for each item aligned with the document."""
    for k, windows in items.candidates(ids):
        item, best = items.words[k], (0.0, 0, 0)
        for low, high in windows:
            score, end = align(item, ids[low:high])
            score /= 2 * len(item)
            if score > best[0]:
                best = (score, low, end)
        if best[0] >= threshold:
            score, low, end = best
            back = align(item[::-1], ids[low : low + end][::-1])[1]
            yield k, score, low + end - back, low + end


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each document and item whose alignment score reaches ``threshold``."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, sent = None, []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # a block of the benchmark
        block = Items(sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])), threshold)
        if block.ids:
            sent.append(sc.broadcast(block))
        if len(sent) == PASS_BLOCKS or b == blocks - 1:
            part = materialize(_search(pairs, sent, threshold), "contamination")
            found, sent = part if found is None else found.union(part), []
    return found


def _search(pairs: DataFrame, sent: list, threshold: float) -> DataFrame:
    def matched(block: Items, docs: list, texts: list):
        import pyarrow as pa

        cols: list[list] = [[], [], [], [], [], []]
        for doc, text in zip(docs, texts):
            ids = block.encode(text)
            for k, score, start, end in _matches(block, ids, threshold):
                for c, v in zip(cols, (doc, block.ids[k], score, start, end, len(ids))):
                    c.append(v)
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in FOUND.split(", ")])

    def search(batches):
        docs, texts, chars = [], [], 0
        with task():
            for batch in chain(slices(batches), [None]):
                if batch is not None:
                    docs += batch.column(0).to_pylist()
                    own = batch.column(1).to_pylist()
                    texts += own
                    chars += sum(len(t or "") for t in own)
                if docs and (batch is None or chars >= GROUP_CHARS):
                    for b in sent:
                        # of several blocks only one is held at a time
                        yield matched(b.value if len(sent) == 1 else b.load_from_path(b._path), docs, texts)
                    docs, texts, chars = [], [], 0

    return pairs.mapInArrow(search, FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = materialize(find_contamination(docs, benchmark, threshold).select("doc_id").distinct(), "contaminated-ids")
    few = bad.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"] == bad["doc_id"], "left_anti")
