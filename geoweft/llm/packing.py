"""Best-fit packing of token sequences by exact-complement hashing.

A packing depends only on how many pieces have each length, so the plan is made from the length
histogram (at most ``capacity`` rows, whatever the corpus size).  For the longest open piece the
planner looks up one, two or three lengths that fill the gap exactly under the remaining
availability counts, in an index of single, pair and triple sums; where nothing fits exactly
the longest piece that fits goes in (best fit) and the search repeats on the smaller gap.  A found
pattern is used as often as availability allows, so plan size is bounded by the number of lengths.

Defined results: a null text is the empty text and still takes its end id; ties and repeated rows
are separate pieces; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.store import materialize
from ._memory import slices, task

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows ranked by one task.
RANK_ROWS = 200_000


class Sums:
    """Index of the sums of one, two and three open lengths, by sum.

    ``pair[s]`` is the largest a of an a + b = s with a >= b, ``triple[s]`` the largest a of an a + (pair of
    s - a); 0 where there is none.  Lengths only run out, so sums only vanish: an entry of ``pair`` that no
    longer holds is lowered, and one of ``triple`` stays an upper bound.
    """

    def __init__(self, rem: np.ndarray):
        self.rem, size = rem, len(rem)
        self.pair, self.triple = np.zeros(size, np.int64), np.zeros(size, np.int64)
        lengths = np.flatnonzero(rem)
        for a in lengths:  # rising, so the largest stays
            self.pair[(a + lengths)[(lengths <= a) & (lengths + a < size)]] = a
        if len(lengths) and 2 * lengths[0] < size:
            self._lower_doubles(lengths)
        twos = np.flatnonzero(self.pair)
        for a in lengths:
            self.triple[(a + twos)[twos + a < size]] = a

    def _lower_doubles(self, lengths: np.ndarray) -> None:
        """A length of which there is one piece makes no pair with itself."""
        for a in lengths[(2 * lengths < len(self.rem)) & (self.rem[lengths] < 2)]:
            if self.pair[2 * a] == a:
                self.pair[2 * a] = self._largest(2 * a, a, self.rem)

    @staticmethod
    def _largest(gap: int, most: int, free: np.ndarray) -> int:
        """Largest open a <= most with a + b = gap and b <= a open too; 0 if there is none."""
        low = (gap + 1) // 2
        a = np.arange(low, most + 1)
        ok = (free[a] > 0) & (free[gap - a] > 0)
        if 2 * low == gap and len(ok):
            ok[0] = free[low] > 1
        hit = np.flatnonzero(ok)
        return int(a[hit[-1]]) if len(hit) else 0

    def two(self, gap: int, free: np.ndarray) -> tuple[int, int] | None:
        """Lengths a >= b with a + b = gap, open in ``free``, which holds no more than ``rem``."""
        for counts in (self.rem, free):
            a = int(self.pair[gap])
            if not a:
                return None
            b = gap - a
            if not (counts[a] and counts[b] and (a != b or counts[a] > 1)):
                a = self._largest(gap, a, counts)
                if counts is self.rem:
                    self.pair[gap] = a
        return (a, gap - a) if a else None

    def three(self, gap: int, free: np.ndarray) -> tuple[int, int, int] | None:
        """Lengths that sum up to gap, open in ``free``, the first as large as can be."""
        a = np.arange(1, int(self.triple[gap]) + 1)
        for x in a[(free[a] > 0) & (self.pair[gap - a] > 0)][::-1]:
            free[x] -= 1
            rest = self.two(int(gap - x), free)
            free[x] += 1
            if rest:
                return (int(x), *rest)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(how often, [(length, pieces of it)])]; every piece of ``counts`` is used exactly once."""
    rem = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        rem[length] += n
    top, out, sums = capacity, [], Sums(rem)
    while True:
        while top and not rem[top]:
            top -= 1
        if not top:
            return out
        use: Counter[int] = Counter()
        free = rem.copy()

        def take(length: int, n: int = 1) -> None:
            use[length] += n
            free[length] -= n

        take(top)
        gap = capacity - top
        while gap:
            if free[gap]:
                take(gap)
                break
            found = sums.two(gap, free) or sums.three(gap, free)
            if found:
                for x in found:
                    take(x)
                break
            fits = np.flatnonzero(free[1 : gap + 1])
            if not len(fits):
                break
            best = int(fits[-1]) + 1
            n = int(min(free[best], max(1, gap // best - 2)))  # the last gap is left to the exact search
            take(best, n)
            gap -= n * best
        times = min(int(rem[x] // n) for x, n in use.items())
        for x, n in use.items():
            rem[x] -= times * n
        out.append((times, sorted(use.items(), reverse=True)))


def schedule(patterns) -> dict[str, np.ndarray]:
    """Intervals of ranks within a length -> first sequence, copies in a sequence, offset."""
    taken: Counter[int] = Counter()
    rows, sequence = [], 0
    for times, parts in patterns:
        offset = 0
        for length, n in parts:
            rows.append((length, taken[length], n, sequence, offset))
            taken[length] += times * n
            offset += n * length
        sequence += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), cols))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with its end id, cut only if longer than ``capacity``."""

    def run(batches):
        import pyarrow as pa

        from .tokens import encoder

        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        with task(enc.memo.forget):
            for batch in slices(batches, 256):
                cols: list[list] = [[], [], [], [], []]
                for doc, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                    wide = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                    for k, s in enumerate(range(0, len(wide), capacity)):
                        cut = wide[s : s + capacity]
                        for c, v in zip(cols, (doc, k, s, len(cut), zlib.crc32(cut.tobytes()))):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = 4096, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset; lengths must lie in 1..capacity."""
    named = pieces.withColumn("_row", F.monotonically_increasing_id())
    kept = materialize(named, "pieces")  # row numbers are fixed from here on
    counts = {r[0]: r[1] for r in kept.groupBy(length).count().collect()}  # at most capacity rows
    if any(k is None or not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    table = schedule(plan(counts, capacity))
    salts = max(1, -(-sum(counts.values()) // RANK_ROWS))
    salted = kept.withColumn("_salt", F.col("_row") % salts)
    base = salted.groupBy(length, "_salt").count().withColumn("_base", F.sum("count").over(Window.partitionBy(length).orderBy("_salt")) - F.col("count")).select(F.col(length).alias("_l"), F.col("_salt").alias("_s"), "_base")
    ranked = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(length, "_salt").orderBy("_row")) - 1)
    ranked = ranked.join(base, (ranked[length] == base["_l"]) & (ranked["_salt"] == base["_s"])).withColumn("_rank", F.col("_base") + F.col("_rn"))
    starts = table["length"] << 44 | table["rank"]

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, rank = n.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(starts, n << 44 | rank, side="right") - 1
        q = rank - table["rank"][i]
        return pd.DataFrame({"sequence_id": table["sequence"][i] + q // table["copies"][i], "offset": table["offset"][i] + q % table["copies"][i] * n})

    placed = ranked.withColumn("_at", place(F.col(length), F.col("_rank")))
    return placed.select(*[F.col(c) for c in pieces.columns if c not in ("sequence_id", "offset")], "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)
