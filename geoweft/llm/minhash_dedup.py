"""Near-duplicate documents by word shingles: multi-index Hamming join over b-bit minhash signatures.

A signature is ``SYMBOLS`` minhashes of 16 bits.  Two sets of similarity J differ in each symbol with
probability 1 - J, so pairs at the threshold differ in more than ``RADIUS`` of 48 symbols about once
in 10^5.  Within that distance the join is exact: the signature is cut into ``CHUNKS`` chunks, by
pigeonhole one of them has at most floor(RADIUS / CHUNKS) = 1 error, and all one-error variants of a
chunk are enumerated by leaving out each of its symbols in turn.

Equal shingle sets are one class before anything is joined.  Buckets are resolved in rounds: each
class is first verified against one leader, then against the leaders of other components in its
buckets.  Documents of buckets that still hold several components are compared through their rarest
shingles (prefix filter with positions), in blocks of bounded size, which loses no link and does not
list the pairs of a group.  Pairs already in one component need no link.  All links are confirmed on
full shingle sets.

Defined results: null or empty text has no shingles and no links; fewer words than a shingle make
one shingle of all words; rows with equal doc_id are one node; a null doc_id takes no part
(component_id and kept null); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components as connected_components
from ..plans.store import materialize
from ._memory import slices, task

SYMBOLS, CHUNKS, RADIUS = 48, 12, 22
_WIDE = SYMBOLS // CHUNKS
#: Members of a bucket that one task compares with one another.
BLOCK = 1000
#: Ids (8 bytes each) up to which a list of ids is broadcast.
BROADCAST_IDS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHash()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, split at \x20 \x09-\x0d
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, ~np.uint64(0))
    for at in range(0, len(shingles), 8192):
        part = (shingles[at : at + 8192] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    least ^= least >> np.uint64(31)
    return ((least * _MIX) >> np.uint64(48)).astype("<u2")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, h and g (hash of the whole set), sig."""

    def sign(batch):
        import pyarrow as pa
        import xxhash

        n, h, g, sig = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, width)
            n.append(len(s))
            d = xxhash.xxh3_128_digest(s.tobytes())
            h.append(int.from_bytes(d[:8], "little", signed=True))
            g.append(int.from_bytes(d[8:], "little", signed=True))
            sig.append(signature(s).tobytes() if len(s) else None)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(sig, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "h", "g", "sig"])

    def run(batches):
        with task(_words.clear):
            yield from map(sign, slices(batches))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, h long, g long, sig binary")


def _matrix(sig) -> np.ndarray:
    return np.frombuffer(b"".join(sig), "<u2").reshape(-1, SYMBOLS)


def _keys(reps: DataFrame) -> DataFrame:
    """key, rep: every chunk of every signature with each of its symbols left out."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 2000):
            m = _matrix(batch.column(1).to_pylist()).astype(np.int64).reshape(-1, CHUNKS, _WIDE)
            keys = np.empty((len(m), CHUNKS, _WIDE), np.int64)
            for c in range(CHUNKS):
                for p in range(_WIDE):
                    k = np.full(len(m), c * _WIDE + p, np.int64)
                    for q in range(_WIDE):
                        if q != p:
                            k = k << 16 | m[:, c, q]
                    keys[:, c, p] = k
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _within(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose signatures and set sizes allow the similarity."""
    left = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    right = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    both = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series((_matrix(x) != _matrix(y)).sum(axis=1).astype(np.int32) if len(x) else np.empty(0, np.int32))

    return both.where(distance("sa", "sb") <= RADIUS).select("a", "b")


def _confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links u, v: the pairs whose full shingle sets reach the similarity."""
    pairs = materialize(pairs, "candidates")
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "candidate-ids")
    few = ids.count() <= BROADCAST_IDS

    def run(batches):
        import pyarrow as pa

        with task(_words.clear):
            for batch in slices(batches, 100):
                sets = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "words"])

    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    sets = own.mapInArrow(run, "id long, words binary")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")

    def alike(batches):
        import pyarrow as pa

        with task():
            for batch in batches:
                found = np.zeros(batch.num_rows, bool)
                for i, (p, q) in enumerate(zip(batch.column("wa"), batch.column("wb"))):
                    p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    at = np.searchsorted(q, p)
                    at[at == len(q)] = 0
                    common = int((q[at] == p).sum())
                    found[i] = 100 * common >= percent * (len(p) + len(q) - common)
                yield batch.select(["u", "v"]).filter(pa.array(found))

    links = both.select(F.col("a").alias("u"), F.col("b").alias("v"), "wa", "wb").mapInArrow(alike, "u long, v long")
    return materialize(links, "confirmed")


def _labelled(rows: DataFrame, parts: DataFrame, name: str, out: str) -> DataFrame:
    return rows.join(parts.select(F.col("node").alias(name), F.col("component").alias(out)), name, "left").withColumn(out, F.coalesce(out, name))


def _prefixes(open_: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """shingle, rep, comp, n, pos: the rarest shingles of each open document, in order of rarity.

    Sets of the similarity differ in so few shingles that one of the n - ceil(t n) + 1 rarest of each
    is common (prefix filter).  Shingles that no other open document has only take up positions.
    """
    ids = materialize(open_.select("rep").distinct(), "open-ids")
    few = ids.count() <= BROADCAST_IDS

    def run(batches):
        import pyarrow as pa

        with task(_words.clear):
            for batch in slices(batches, 200):
                sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
                keys = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(keys)], names=["shingle", "rep"])

    text = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(F.broadcast(ids) if few else ids, "rep", "left_semi")
    rows = materialize(text.mapInArrow(run, "shingle long, rep long"), "open-shingles")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    listed = rows.join(shared, "shingle").groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("df", "shingle"))).alias("l"))
    head = listed.join(open_, "rep").withColumn("own", F.greatest(F.col("n") - F.size("l"), F.lit(0)))
    head = head.withColumn("k", F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1 - F.col("own")).where("k > 0")
    head = head.select("rep", "comp", "n", "own", F.posexplode(F.slice("l", 1, F.col("k").cast("int"))).alias("at", "e"))
    return head.select("e.shingle", "rep", "comp", "n", (F.col("own") + F.col("at")).alias("pos"))


def _open_pairs(buckets: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of different components that may reach the similarity, among documents whose buckets hold several.

    Documents with a common prefix shingle are compared block by block; the positions of that shingle
    bound the common rest, and only pairs within the bound leave the task.
    """
    mixed = buckets.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    open_ = materialize(buckets.join(mixed, "key").select("rep", "comp").distinct().join(reps.select("rep", "n"), "rep"), "open")
    heads = materialize(_prefixes(open_, docs, width, percent), "prefixes")
    several = heads.groupBy("shingle").agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").drop("x", "y")
    rows = heads.join(several, "shingle").withColumn("s", F.ceil(F.col("c") / BLOCK)).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("s")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    rows = rows.select("shingle", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "rep", "comp", "n", F.col("pos").cast("long").alias("pos"))

    def compare(lo: int, hi: int, mine, rep, comp, n, pos) -> np.ndarray:
        first = np.flatnonzero(mine == lo)
        second = first if lo == hi else np.flatnonzero(mine == hi)
        found = []
        for part in np.array_split(first, max(1, len(first) // 256)):
            common = np.minimum((n - pos)[part][:, None], (n - pos)[second])
            ok = 100 * common >= percent * (n[part][:, None] + n[second] - common)
            ok &= comp[part][:, None] != comp[second]
            if lo == hi:
                ok &= rep[part][:, None] < rep[second]
            i, j = np.nonzero(ok)
            found.append(np.sort(np.stack([rep[part[i]], rep[second[j]]], axis=1), axis=1))
        return np.concatenate(found) if found else np.empty((0, 2), np.int64)

    def run(batches):
        """Groups follow one another in sorted batches; the last one of a batch may go on in the next."""
        import pyarrow as pa

        rest = None
        for batch in chain(batches, [None]):
            if batch is not None:
                m = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                rest = m if rest is None else np.concatenate([rest, m], axis=1)
            if rest is None or not rest.shape[1]:
                continue
            cuts = np.flatnonzero((rest[:3, 1:] != rest[:3, :-1]).any(axis=0)) + 1
            ends = [*cuts.tolist(), *([rest.shape[1]] if batch is None else [])]
            start, found = 0, [np.empty((0, 2), np.int64)]
            for end in ends:
                if end - start > 1:
                    g = rest[:, start:end]
                    found.append(compare(g[1, 0], g[2, 0], *g[3:]))
                start = end
            rest = rest[:, start:]
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.repartition("shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    known = materialize(signatures(docs, width), "signatures")
    sets = known.where("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("h", "g").agg(F.min("doc_id").alias("rep"))
    members = materialize(sets.join(classes, ["h", "g"]), "members")
    reps = materialize(members.where("doc_id = rep").select("rep", "sig", F.col("n_shingles").alias("n")), "representatives")

    keys = _keys(reps)
    leaders = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("lead")).where("c > 1").drop("c")
    buckets = materialize(keys.join(leaders, "key"), "buckets")
    pairs = buckets.where("rep <> lead")

    links = _confirm(_within(pairs.groupBy(F.col("rep").alias("b")).agg(F.min("lead").alias("a")), reps, percent), docs, width, percent)
    parts = materialize(connected_components(links), "components")
    across = _labelled(_labelled(pairs, parts, "rep", "comp"), parts, "lead", "other").where("comp <> other")
    links = links.union(_confirm(_within(across.select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), reps, percent), docs, width, percent))
    parts = materialize(connected_components(links), "components")
    rest = _open_pairs(_labelled(buckets.select("key", "rep"), parts, "rep", "comp"), reps, docs, width, percent)
    links = links.union(_confirm(rest, docs, width, percent))
    same = members.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    parts = materialize(connected_components(links.union(same)), "components")
    out = _labelled(known.select("doc_id", "n_shingles"), parts, "doc_id", "component_id")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose group has one of smaller doc_id; equal doc_ids stay or go together."""
    gone = materialize(near_duplicates(docs, width, percent).where("not kept").select("doc_id").distinct(), "dropped-ids")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["doc_id"], "left_anti")
