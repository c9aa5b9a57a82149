"""The pipeline and the queries with SQL twins."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tideline.llm import pii, quality
from tools.check_queries import compare, connect

SMALL = os.environ.get("TIDELINE_SMALLDATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["op2_shards", "op5_lines", "op9_nearest_codes"])
def test_matches_sql(spark, folder, name):
    con = connect(SMALL)
    status, _, _, detail = compare(spark, con, SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", detail


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SMALL).cache()
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    assert before > 100
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert entry.queries()["pipeline"](spark, SMALL).count() == packed.count()


def test_odd_documents(spark, odd, empty, folder):
    for docs in (odd, empty):
        for _, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, SMALL)
            assert out.columns == [c for c in docs.columns if c in out.columns] and out.count() <= docs.count()


def test_lines_stage_keeps_foreign_columns(spark, odd):
    docs = odd.withColumn("_lines", odd.doc_id)
    out = corpus_pipeline.lines(spark, docs, SMALL)
    assert out.columns == docs.columns and {r._removed for r in out.collect()} == {7}


def plain_stages(docs, field, taken):
    """Stages 10, 5, 7 and 8 on (id, text) in plain Python; ids and texts are distinct and not null."""
    left = {i: t for i, t in docs.items() if field.score([t])[0] >= 0.7}
    first, gone = {}, Counter()
    for i in sorted(left):
        lines = left[i].split("\n")
        for at in range(len(lines) - 2):
            if first.setdefault(tuple(lines[at:at + 3]), (i, at)) != (i, at):
                gone.update({(i, at + k): 1 for k in range(3)})
    cut = {i: "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone) for i, t in left.items()}
    left = {i: t for i, t in cut.items() if t or t == left[i]}

    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in left.items()}
    group = {i: i for i in left}
    for i in left:
        for j in left:
            a, b = sets[i], sets[j]
            if i < j and group[i] != group[j] and (a == b or len(a & b) / len(a | b) >= 0.8):
                x, y = sorted((group[i], group[j]))
                group = {k: x if g == y else g for k, g in group.items()}
    copies = {i: t for i, t in left.items() if group[i] == i}
    return left, copies, {i: pii.masked(t, taken(copies)) for i, t in copies.items()}


def test_rows_equal_plain_python(spark, folder):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")

    def taken(rows, known={}):
        if not known:
            frame = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
            known[0] = frozenset(pii.accepted_shapes(pii.annotated(frame)))
        return known[0]

    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(texts) == docs.count() and None not in texts.values()
    left, copies, want = plain_stages(texts, quality.train(docs, labels), taken)
    assert 0 < len(want) < len(left) < len(texts) and want != copies
    got = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, got, SMALL).cache()
    rows = got.select("doc_id", "text", "n_chars").collect()
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want) and all(r.n_chars == len(r.text) for r in rows)
    pieces = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert pieces == {i: len(t.encode()) for i, t in want.items()}
