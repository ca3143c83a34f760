"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from keyloom.llm.common import table

from test_corpus_operators import TERM, near_groups, slow_contamination, slow_removals

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    """Given documents, some odd ones, and a column whose name operators use as well."""
    given = [tuple(r) for r in table(spark, SF, "documents").limit(80).collect()]
    passage = table(spark, SF, "benchmark").first()["text"]
    odd = [
        (10_001, None, None, None, None),
        (10_002, "", "en", "src1", 0),
        (10_003, "12 34 !!", "en", "src1", 8),
        (10_004, given[0][1], given[0][2], "src2", given[0][4]),
        (10_005, f"thing the erly {passage} anin the", "en", "src3", 0),
        (10_006, "the thing erly " * 30_000, "en", "src4", 0),
        (None, "the anonthed erly thatnd of theanst in the areon withal", "en", None, 5),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    return spark.createDataFrame([(*r, "mine") for r in [*given, *odd, given[3]]], schema).repartition(3).cache()


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def has_word(text):
    return bool(text and text.split())


def test_language_keeps_what_it_knows(spark, docs):
    out = STAGES["language"](spark, docs, SF)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert kept.isdisjoint({10_001, 10_002, 10_003})
    assert kept >= {r["doc_id"] for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 10_000}


def test_lines_equal_brute_force(spark, docs):
    out = STAGES["lines"](spark, docs, SF)
    assert out.columns == docs.columns
    rows = rows_of(docs)
    once = list(dict.fromkeys(rows))  # rows that agree in id and text are one document
    want = {}
    for (i, text), gone in zip(once, slow_removals(once), strict=True):
        left = text if not gone else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in set(gone))
        want[i, text] = left if not gone or has_word(left) else None
    expected = Counter((i, want[i, t]) for i, t in rows if want[i, t] is not None or t is None)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] and r["doc_id"] == 11)


def test_near_duplicates_equal_brute_force(spark, docs):
    out = STAGES["near_duplicates"](spark, docs, SF)
    assert out.columns == docs.columns
    rows = [r for r in rows_of(docs) if has_word(r[1])]
    _, at = near_groups(rows, 5)
    first = {}
    for k, g in at.items():
        first.setdefault(g, k)
    want = Counter(rows[k] for k in first.values()) + Counter(r for r in rows_of(docs) if not has_word(r[1]))
    assert Counter(rows_of(out)) == want


def test_benchmark_equals_brute_force(spark, docs):
    out = STAGES["benchmark"](spark, docs, SF)
    assert out.columns == docs.columns
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    want = Counter(r for r in rows_of(docs) if not any(x[5] for x in slow_contamination([r], items)))
    assert Counter(rows_of(out)) == want
    assert 10_005 not in {r["doc_id"] for r in out.collect()}


def test_mix_takes_half_again_as_many_words(spark, docs):
    out = STAGES["mix"](spark, docs, SF)
    assert out.columns == [*docs.columns, "copy"]
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(words(out.collect()) - 1.5 * words(docs.collect())) < 0.25 * words(docs.collect())
    copies = Counter((r["doc_id"], r["text"]) for r in out.collect())
    have = Counter(rows_of(docs))
    assert all(copies[k] <= 2 * have[k] for k in copies)


@pytest.mark.parametrize("stage", list(STAGES))
def test_stages_of_no_documents(spark, docs, stage):
    out = STAGES[stage](spark, docs.limit(0), SF)
    assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns


def test_pipeline_runs_whole(spark):
    assert queries()["pipeline"] is corpus_pipeline.run
    given = {r["doc_id"] for r in table(spark, SF, "documents").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r["doc_id"] for r in out} <= given
    assert all(TERM.search(r["text"].lower()) for r in out)
