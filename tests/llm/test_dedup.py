import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from geoweft.llm import embed_dedup, line_dedup, minhash_dedup
from tests.llm.helpers import awkward, components


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    links = []
    for i, s in sets.items():
        c = Counter(j for x in s for j in where[x] if j > i)
        links += [(i, j) for j, k in c.items() if 100 * k >= percent * (len(s) + len(sets[j]) - k)]
    return sets, components(sets, links)


@pytest.mark.parametrize("width", [4, 5])
def test_minhash_against_brute_force(spark, data, width):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sets, parts = brute([(r.doc_id, r.text) for r in docs.collect()], width)
    out = minhash_dedup.near_duplicates(docs, width).toPandas()
    assert dict(zip(out.doc_id, out.component_id)) == parts
    assert dict(zip(out.doc_id, out.n_shingles)) == {i: len(s) for i, s in sets.items()}
    assert (out.kept == (out.doc_id == out.component_id)).all()


def test_chains_and_edited_groups(spark):
    """Copies with random edits: some reach the similarity with the original only, some with none."""
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(300):
        words = list(base)
        for _ in range(int(rng.integers(0, 9))):
            words[int(rng.integers(0, 120))] = f"x{int(rng.integers(0, 3))}"
        rows.append((k, " ".join(words)))
    _, parts = brute(rows, 4)
    out = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).toPandas()
    assert dict(zip(out.doc_id, out.component_id)) == parts and len(set(parts.values())) > 10


def test_minhash_awkward(spark):
    docs = awkward(spark)
    out = minhash_dedup.near_duplicates(docs, 4).toPandas()
    got = {(r.doc_id): r.component_id for r in out.itertuples() if r.doc_id == r.doc_id}
    assert len(out) == docs.count() and got[2] == 1 and got[3] == 3 and got[4] == 4 and got[5] == 5
    assert out[out.doc_id.isna()].component_id.isna().all()
    kept = minhash_dedup.drop_near_duplicates(docs, 5)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert minhash_dedup.near_duplicates(docs.where("false"), 4).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 40))
    rows = []
    for i in range(900):
        c = centers[i % 12] if i % 3 else rng.standard_normal(40)
        v = c + rng.standard_normal(40) * (0.0, 0.05, 0.12, 0.2)[i % 4]
        rows.append((i, [float(x) for x in v * (1 + i % 5)], int(i % 3 // 2)))
    out = embed_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    parts = components(range(900), list(zip(*np.nonzero(near))))
    assert out.n_links.to_dict() == dict(enumerate(near.sum(axis=1))) and near.sum() > 1000
    assert out.component_id.to_dict() == parts


def test_embeddings_awkward(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, None], 1), (11, [1.0, 0.0], 2), (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r for r in embed_dedup.embedding_links(t).collect()}
    assert [out[i].n_links for i in (1, 2, 3)] == [3, 3, 3] and {out[i].component_id for i in (1, 2, 3)} == {1}
    assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in range(4, 13))
    assert out[None].n_links == 3 and len(out) == len(rows)
    assert embed_dedup.embedding_links(t.where("false")).count() == 0


def test_large_cells_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 20)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.array([1.0, 0, 0, 0]) + rng.standard_normal(4) * 0.1], 0) for i in range(150)]
    out = embed_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert out.n_links.sort_index().tolist() == ((x @ x.T >= 0.98).sum(axis=1) - 1).tolist()


def test_lines(spark):
    docs = awkward(spark)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs, "source", 3).where("doc_id is not null").collect()}
    assert out[8].text == "a\nshared line\nb" and out[8].removed_lines is None
    assert out[9].text == "c\n\n" and out[9].removed_lines == [0] and out[10].text == ""
    assert out[3].text is None and out[4].text == "" and out[1].n == 1 and out[1].rep == 1
    assert line_dedup.dedup_lines(docs, "source", 4).where("removed_lines is not null").count() == 0
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0
    assert line_dedup.dedup_lines(docs).count() == docs.count()
