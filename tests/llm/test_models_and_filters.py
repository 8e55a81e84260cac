import itertools
import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from geoweft.llm import crf, decontam, langid, sharding, toxicity, url_filter
from tests.llm.helpers import awkward


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 4])
    scores, trans = rng.standard_normal((8, 3)), rng.standard_normal((3, 3))
    p, counts = crf.forward_backward(crf.Layout(lengths), scores, trans, True)
    at, want = 0, np.zeros((3, 3))
    for n in lengths:
        z, marg = 0.0, np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = math.exp(sum(scores[at + i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            z += w
            for i, s in enumerate(path):
                marg[i, s] += w
        for path in itertools.product(range(3), repeat=int(n)):
            w = math.exp(sum(scores[at + i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            for a, b in zip(path, path[1:]):
                want[a, b] += w / z
        assert np.allclose(p[at : at + n], marg / z)
        at += n
    assert np.allclose(counts, want)


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = out[[held(i) for i in out.doc_id]]
    assert len(out) > 200 and (out.lang == out.lang_pred).mean() > 0.98 and out.score.between(0, 1).all()


def test_code_switching_is_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    en, fr = (docs.where(f"lang = '{x}' and length(text) > 600").first().text.split()[:60] for x in ("en", "fr"))
    mixed = spark.createDataFrame([(1, " ".join(en)), (2, " ".join(en + fr))], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(mixed, model).collect()}
    assert got[1].switches == 0 and 1 <= got[2].switches <= 5 and got[2].score < got[1].score


def test_chunks_without_blanks_are_read_to_their_end(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    en, fr = (["".join(c for c in w if c.isalpha()) for w in docs.where(f"lang = '{x}' and length(text) > 1200").first().text.split()[:150]] for x in ("en", "fr"))
    en, fr = [w for w in en if w], [w for w in fr if w]
    rows = [(1, " ".join(en[:20] + fr)), (2, ",".join(en[:20] + fr)), (3, "/".join(en[:20] + en))]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[3].lang_pred) == ("fr", "fr", "en")
    assert got[2].n_words == got[1].n_words == 20 + len(fr) and got[2].score == pytest.approx(got[1].score, abs=1e-5)


def test_toxic_word_late_in_a_chunk_without_blanks(spark):
    docs = [(i, f"plain words number {i % 7} are here" + (f" you {('fool', 'scoundrel')[i % 2]}, go" if i % 3 == 0 else "")) for i in range(300)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    text = "_".join(["plain", "words", "here"] * 10 + ["you", "fool", "go"])
    (got,) = toxicity.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), toxicity.fit(d, lab)).collect()
    assert got.score >= 0.7 and "fool" in [text[s.begin : s.end] for s in got.spans]


def test_words_of_long_chunks():
    run = "ab" * 40
    assert crf.split(f"A {run} x,{run}.Y 1{'!' * 99}don't") == ["a", run, "x", run, "y", f"1{'!' * 99}don't"]
    assert crf.clean(f"1{'!' * 99}don't") == "don't" and crf.split("7" * 99) == ["7" * 99] and crf.split("") == []
    assert crf.clean(f"{run}-c") == f"{run}-c"


def test_language_awkward(spark):
    docs = awkward(spark)
    out = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert len(out) == 11 and all(out[i].lang_pred == "und" and out[i].score == 0 for i in (3, 4, 5, 7))
    kept = langid.keep_identified(docs, langid.fit(docs))
    assert kept.columns == docs.columns and not {3, 4, 5, 7} & {r.doc_id for r in kept.collect()}
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit(nothing) is None and {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.where("false"), None).count() == 0


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    known = docs.join(F.broadcast(labels), "doc_id", "left_semi")
    out = toxicity.score_toxicity(known, model).join(labels, "doc_id").toPandas()
    out = out[[held(i) for i in out.doc_id]]
    bad, fine = out[out.toxic == 1], out[out.toxic == 0]
    assert (bad.score >= 0.7).mean() > 0.8 and (fine.score >= 0.7).mean() < 0.02
    assert out.score.between(0, 1).all()


def test_spans_point_at_words(spark):
    docs, labels = [], []
    for i in range(300):
        tox = i % 3 == 0
        docs.append((i, f"plain words number {i % 7} are here" + (f" you {('fool', 'scoundrel')[i % 2]}, go" if tox else "")))
        labels.append((i, int(tox)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_toxicity(d, toxicity.fit(d, lab)).collect()}
    assert all((out[i].score >= 0.7) == bool(t) for i, t in labels)
    spans = [docs[0][1][s.begin : s.end] for s in out[0].spans]
    assert "fool," in spans


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (2, None), (77, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.fit(docs, labels.where("false")) is None and {r.score for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}


def test_contamination(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)]
    docs = []
    for i, (_, text) in enumerate(items):
        w = text.split()
        filler = lambda n: " ".join(word() for _ in range(n))
        docs.append((3 * i, f"{filler(40)} {text.upper()}! {filler(30)}"))
        edited = [word() if k % 7 == 3 else v for k, v in enumerate(w)]
        docs.append((3 * i + 1, f"{filler(25)} {' '.join(edited[:12])} extra, {' '.join(edited[12:])} {filler(25)}"))
        docs.append((3 * i + 2, filler(100)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.find_contamination(d, b).collect()}
    assert set(got) == {(3 * i + k, i) for i in range(12) for k in (0, 1)}
    assert got[0, 0].score == 1.0 and (got[0, 0].start_word, got[0, 0].end_word) == (40, 70) and got[1, 0].score < 1
    assert sorted(r.doc_id for r in decontam.drop_contaminated(d, b).collect()) == [3 * i + 2 for i in range(12)]


def test_contamination_awkward(spark, monkeypatch):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, "two three four five six"), (2, None), (3, "!!"), (4, "omega"), (4, "omega"), (None, "shared line")], "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in decontam.find_contamination(docs, items).collect()}
    assert {(1, 1), (2, 1), (None, 1), (6, 4), (10, None)} <= whole
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 2)
    assert {(r.doc_id, r.item_id) for r in decontam.find_contamination(docs, items).collect()} == whole
    assert decontam.find_contamination(docs, items.where("false")).count() == 0
    assert decontam.find_contamination(docs.where("false"), items).count() == 0
    monkeypatch.setattr(decontam, "PASS_BLOCKS", 1)
    assert {(r.doc_id, r.item_id) for r in decontam.find_contamination(docs, items).collect()} == whole
    clashing = docs.withColumn("_bad", F.lit(1)).withColumn("item_id", F.lit(1))
    assert decontam.drop_contaminated(clashing, items).columns == clashing.columns


def test_words_of_other_scripts():
    assert decontam.words("\u00abÉtat\u00bb\u2014d\u2019art\u2026") == ["état".encode(), b"d", b"art"]
    assert decontam.words("\u4f60\u597d\uff0c\u4e16\u754c") == [c.encode() for c in "\u4f60\u597d\u4e16\u754c"]
    assert decontam.words("\u0939\u093f\u0928\u094d\u0926\u0940\u0964") == ["\u0939\u093f\u0928\u094d\u0926\u0940".encode()]


@pytest.mark.parametrize("common", [0, 2, 16])
def test_common_seeds_change_no_result(monkeypatch, common):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["which", "of", "the", "following", *(f"w{k}" for k in rng.integers(0, 40, 12))])) for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.3 else "z" for w in rows[i][1].split()) + " a b " + rows[-i][1] for i in range(1, 40)]
    monkeypatch.setattr(decontam, "COMMON", common)
    items = decontam.Items(rows)
    if common < 16:
        assert len(items.owner) < 60 * 28
    for t in texts:
        ids = items.encode(t)
        want = {k: decontam.align(w, ids)[0] / (2 * len(w)) for k, w in enumerate(items.words)}
        assert {k: s for k, s, _, _ in decontam._matches(items, ids, 0.5)} == {k: s for k, s in want.items() if s >= 0.5}


def test_edited_copies_of_the_benchmark_are_found():
    """Recall against alignment of everything, by the share of words replaced."""
    rng = np.random.default_rng(11)
    texts = [r.as_py() for r in pq.read_table("/root/testdata/sf0.01/benchmark.parquet")["text"]]
    items = decontam.Items(list(enumerate(texts)))
    for share in (0.1, 0.2, 0.3, 0.4):
        for i, w in enumerate(items.words):
            ids = np.where(rng.random(len(w)) < share, -1, w)
            want = {k for k, x in enumerate(items.words) if decontam.align(x, ids)[0] >= len(x)}
            assert {m[0] for m in decontam._matches(items, ids, 0.5)} == want


def test_contamination_finds_all_that_reach_the_threshold(spark):
    item = [f"i{k}" for k in range(24)]
    texts = {
        1: item[:13],  # fewer than half of the 3-grams are left
        2: [w if k % 3 < 2 else "z" for k, w in enumerate(item)],  # no 3-gram is left
        3: [x for w in item for x in (w, "z")],  # no two words stand together
        4: item[:11],
    }
    docs = [(i, " ".join(["a", *t, "b"])) for i, t in texts.items()] + [(100 + i, " ".join(item)) for i in range(50)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontam.find_contamination(d, b).collect()}
    assert set(got) == {1, 2, 3, *range(100, 150)}


def test_contamination_equals_alignment_of_everything():
    rng = np.random.default_rng(3)
    for t in range(300):
        some = lambda n: [f"w{i}" for i in rng.integers(0, 25, n)]
        texts, threshold = [some(rng.integers(1, 14)) for _ in range(3)], (0.5, 0.3, 0.7, 1.0)[t % 4]
        items = decontam.Items([(i, " ".join(w)) for i, w in enumerate(texts)], threshold)
        doc = some(10)
        for w in texts:
            cut = rng.random(len(w))
            doc += [x for v, u in zip(w, cut) for x in (("z", v) if u < 0.3 else () if u < 0.4 else ("z",) if u < 0.6 else (v,))] + some(5)
        ids = items.encode(" ".join(doc))
        want = {k: decontam.align(w, ids)[0] / (2 * len(w)) for k, w in enumerate(items.words)}
        assert {k: s for k, s, _, _ in decontam._matches(items, ids, threshold)} == {k: s for k, s in want.items() if s >= threshold}


def test_contamination_of_an_item_does_not_depend_on_its_block():
    item, other = " ".join(f"i{k}" for k in range(9)), "omega"
    for t in ("i0 z i2 z i4 z i6 z i8", "i0 i1 z i3 i4 z i6 i7 z", "i8 i7 i6 i5", item):
        found = []
        for rows in ([(1, item)], [(1, item), (2, other)], [(0, "i3 i1"), (1, item)]):
            items = decontam.Items(rows)
            k, ids = items.ids.index(1), items.encode(t)
            found.append(([w for i, w in items.candidates(ids) if i == k], [m[1:] for m in decontam._matches(items, ids, 0.5) if m[0] == k]))
        assert found[0] == found[1] == found[2]


def test_alignment_scores():
    a = np.array([1, 2, 3, 4, 5])
    assert decontam.align(a, np.array([9, 1, 2, 3, 4, 5, 9])) == (10, 6)
    assert decontam.align(a, np.array([1, 2, 9, 4, 5]))[0] == 7
    assert decontam.align(a, np.array([1, 2, 3, 8, 4, 5]))[0] == 9


def test_url_intervals(spark):
    e = [("domain", "bad.org", "add", "2024-01-01"), ("domain", "bad.org", "add", "2024-01-05"), ("domain", "bad.org", "remove", "2024-02-01"), ("domain", "bad.org", "add", "2024-03-01"), ("host", "x.com", "add", "2024-01-01"), ("host", "x.com", "remove", "2024-01-01"), ("prefix", "y.net/a/b", "add", "2024-01-01"), (None, "z", "add", "2024-01-01")]
    entries = spark.createDataFrame(e, "kind string, pattern string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    u = [(1, "http://www.BAD.org/p", "2024-01-31"), (2, "http://bad.org", "2024-02-01"), (3, "https://u:p@sub.bad.org:8080/", "2024-03-02"), (4, "http://notbad.org/", "2024-01-02"), (5, "http://x.com/", "2024-01-02"), (6, "http://y.net/a/b/c?q=1", "2024-01-02"), (7, "http://y.net/a/bc", "2024-01-02"), (8, None, "2024-01-02"), (9, "no url", "2024-01-02"), (10, "http://bad.org", None), (11, "http://bad.org", "2023-12-31"), (1, "http://www.BAD.org/p", "2024-01-31")]
    caps = spark.createDataFrame(u, "id int, url string, fetched string").withColumn("fetched", F.col("fetched").cast("timestamp")).withColumn("kind", F.lit("mine"))
    out = url_filter.filter_urls(caps, entries).collect()
    assert len(out) == 12 and {r.id for r in out if r.blocked} == {1, 3, 6} and {r.kind for r in out} == {"mine"}
    marks = spark.createDataFrame([("domain", "Bad.org.", "add", "2024-01-01"), ("prefix", "y.net/a/", "add", "2024-01-01")], "kind string, pattern string, action string, at string")
    dotted = spark.createDataFrame([(1, "http://w.bad.org./x"), (2, "http://y.net/a"), (3, "http://y.net./A/b"), (4, "http://y.net/ab")], "id int, url string").withColumn("fetched", F.to_timestamp(F.lit("2024-02-02")))
    assert {r.id for r in url_filter.filter_urls(dotted, marks.withColumn("at", F.col("at").cast("timestamp"))).collect() if r.blocked} == {1, 2, 3}
    assert url_filter.filter_urls(caps, entries.where("false")).where("blocked").count() == 0
    assert url_filter.filter_urls(caps.where("false"), entries).count() == 0


def test_shards(spark):
    d = spark.range(1003).repartition(7).withColumn("shard", F.lit("x"))
    out = sharding.shuffle_into_shards(d, 8).toPandas()
    n = out.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert set(n["count"]) <= {125, 126} and (n["nunique"] == n["count"]).all() and (n["max"] == n["count"] - 1).all() and (n["min"] == 0).all()
    assert sorted(out.id) == list(range(1003))
    assert sharding.shuffle_into_shards(d.where("false"), 8).count() == 0
    assert sharding.shuffle_into_shards(awkward(spark), 3).count() == 12
    names = ["p", "cuts", "part", "row", "body", "key", "rank", "base", "bucket", "count", "a.b"]
    named = spark.range(20).select("id", *[F.lit(1).alias(c) for c in names])
    out = sharding.shuffle_into_shards(named, 3)
    assert out.columns == ["id", *names, "shard", "slot"] and sorted(r.id for r in out.collect()) == list(range(20))


def test_communication_matrix():
    rows = [5, 0, 17, 3]
    m = np.array([sharding.communication_matrix(rows, 4, s) for s in range(400)])
    assert (m.sum(axis=2) == rows).all() and (m.sum(axis=1).max(axis=1) - m.sum(axis=1).min(axis=1) <= 1).all()
    assert m[:, 2].mean(axis=0) == pytest.approx(17 * np.array([7, 6, 6, 6]) / 25, abs=0.25)
    rng = np.random.default_rng(1)
    big = [sharding._hypergeometric(rng, 3_000_000_000, 9_000_000_000, 1_000_000) for _ in range(300)]
    assert np.mean(big) == pytest.approx(250_000, abs=100) and np.std(big) == pytest.approx(433, rel=0.2)
