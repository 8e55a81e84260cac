import re
from collections import Counter

import corpus_pipeline as P
from tests.llm.helpers import awkward
from tests.llm.test_dedup import brute


def norm(text):
    return " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "


def test_stages_against_brute_force(spark, data):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    first = P.language(spark, docs, data)
    assert first.columns == docs.columns
    kept = {r.doc_id: r for r in first.collect()}
    assert all(i in kept for i, r in rows.items() if len(r.text.split()) > 20)

    second = P.lines(spark, first, data)
    sites, seen, want = {}, Counter(), {}
    for i in sorted(kept):
        for line in kept[i].text.split("\n"):
            sites.setdefault(line, set()).add(kept[i].source)
    for i in sorted(kept):
        out = []
        for line in kept[i].text.split("\n"):
            if line and len(sites[line]) >= 10:
                seen[line] += 1
                if seen[line] > 1:
                    continue
            out.append(line)
        text = "\n".join(out)
        if text.strip(" ") or text == kept[i].text:
            want[i] = text
    assert {r.doc_id: r.text for r in second.collect()} == want

    third = P.near_duplicates(spark, second, data)
    _, parts = brute(list(want.items()), 5)
    assert {r.doc_id for r in third.collect()} == set(parts.values())

    fourth = P.benchmark(spark, third, data)
    items = [norm(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = {i for i in set(parts.values()) if not any(b in norm(want[i]) for b in items)}
    assert {r.doc_id for r in fourth.collect()} == clean

    last = P.packed(spark, fourth, data).toPandas()
    assert set(last.doc_id) == clean
    assert set(P.run(spark, data).toPandas().doc_id) == clean


def test_awkward_rows_go_through(spark, data):
    docs = awkward(spark)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == awkward(spark).columns
    assert P.STAGES[-1][1](spark, docs, data).count() > 0
    empty = awkward(spark).where("false")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, data)
    assert empty.count() == 0
