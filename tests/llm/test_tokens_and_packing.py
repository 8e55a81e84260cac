import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoweft.llm import packing, token_files
from geoweft.llm.tokens import ChunkEncoder
from tests.llm.helpers import awkward, vocabulary


@pytest.fixture(scope="module")
def encoder():
    return ChunkEncoder(vocabulary(), memo_entries=500)


def direct(encoder, text):
    return encoder.tok.encode(text or "", add_special_tokens=False).ids


def test_same_ids_as_the_library(encoder, spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    rng, odd = random.Random(1), "ab'stdlmvre019.,!|%éÉßçñÑİıſḰ  \t\r\x0b\x1c \n 日本ΣσςǅDZ×÷ªº½²"
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, "", "<|endoftext|> a", "a<|startoftext|>b"]
    for text, raw in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(raw, encoder.dtype).tolist() == direct(encoder, text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == direct(encoder, text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_uses_every_piece_once(counts):
    plan = packing.plan(counts, 64)
    used = {}
    for times, parts in plan:
        assert sum(length * n for length, n in parts) <= 64
        for length, n in parts:
            used[length] = used.get(length, 0) + times * n
    assert used == counts


def test_exact_complements_are_found():
    assert sum(t for t, _ in packing.plan({60: 3, 4: 3}, 64)) == 3
    assert sum(t for t, _ in packing.plan({50: 2, 9: 2, 5: 2}, 64)) == 2
    assert sum(t for t, _ in packing.plan({40: 1, 12: 1, 7: 1, 5: 1, 20: 1, 30: 1, 14: 1}, 64)) == 2


def checked(pieces, ids, capacity):
    for r in pieces.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    ordered = pieces.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id").length.cumsum()
    assert (ends - ordered.length == ordered.offset).all() and ends.max() <= capacity
    assert pieces.length.sum() == sum(len(v) for v in ids.values())
    return ordered.sequence_id.nunique()


def test_packing_of_documents(encoder, spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = {r.doc_id: np.array([*direct(encoder, r.text), 1], "<u4") for r in docs.collect()}
    out = packing.pack_documents(docs, vocabulary()).toPandas()
    n = checked(out, ids, 4096)
    assert n <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_packing_awkward(encoder, spark):
    docs = awkward(spark)
    out = packing.pack_documents(docs, vocabulary(), 64).toPandas()
    long = out[out.doc_id == 6].sort_values("piece")
    assert (long.length[:-1] == 64).all() and long.piece.tolist() == list(range(len(long)))
    assert out[out.doc_id == 3].length.tolist() == [1] and len(out[out.doc_id == 2]) == 2 and out.doc_id.isna().sum() == 1
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert packing.pack_documents(docs.where("false"), vocabulary()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 70)], "id int, length long"), 64)


def test_token_files(encoder, spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, path, vocabulary())
    start = 0
    for r in token_files.read_token_files(spark, path).orderBy("doc_id").collect():
        ids = np.array([*direct(encoder, docs.where(f"doc_id = {r.doc_id}").first().text), 1], "<u4") if r.doc_id < 5 else None
        assert r.start == start and (ids is None or (r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())))
        start += r.n_tokens


def test_token_files_awkward(spark, tmp_path):
    docs = awkward(spark)
    token_files.write_token_files(docs, f"{tmp_path}/a", vocabulary())
    out = token_files.read_token_files(spark, f"{tmp_path}/a").toPandas().sort_values("start")
    assert len(out) == docs.count() and out.doc_id.isna().tolist()[0] and (out.start.shift(-1).dropna() == (out.start + out.n_tokens)[:-1].values).all()
    token_files.write_token_files(docs.where("false"), f"{tmp_path}/e", vocabulary())
    assert token_files.read_token_files(spark, f"{tmp_path}/e").count() == 0


def test_sums_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        capacity = int(rng.integers(3, 30))
        rem = np.zeros(capacity + 1, np.int64)
        for x in rng.integers(1, capacity + 1, rng.integers(1, 8)):
            rem[x] += rng.integers(1, 3)
        sums, free = packing.Sums(rem), rem.copy()
        free[rng.integers(1, capacity + 1)] = 0
        bag = [x for x in range(1, capacity + 1) for _ in range(free[x])]
        for gap in range(1, capacity + 1):
            for found, size in ((sums.two(gap, free), 2), (sums.three(gap, free), 3)):
                assert (found is not None) == any(sum(c) == gap for c in itertools.combinations(bag, size))
                assert not found or sum(found) == gap and all(found.count(x) <= free[x] for x in found)
