"""run() against the plain version of each stage, on documents with planted cases."""

import random

import pytest

import corpus_pipeline
from lodeplane.llm.queries import tokenizer_path

from .helpers import SCHEMA, prose
from .test_operators import brute_components, brute_counts, brute_hits

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    item = prose(rng, 14)
    good = [prose(rng, 80) for _ in range(30)]
    rows = list(enumerate(good))
    rows += [(100, good[0]), (101, good[1] + " tail"), (102, "too short"), (103, f"{prose(rng, 40)} {item} {prose(rng, 30)}"), (104, "again and again we go " * 30), (105, None), (106, prose(rng, 60) + " mail me: jo@site.org")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return tmp_path, rows, [(1, item)]


def test_run_equals_the_plain_stages(spark, folder):
    path, rows, items = folder
    kept = [(i, t) for i, t in rows if (c := brute_counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    least = brute_components(kept, 5)
    kept = [(i, t) for i, t in kept if least[i] == i]
    bad = {r[0] for r in brute_hits(kept, items) if r[4]}
    kept = [(i, t) for i, t in kept if i not in bad]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(path)).collect()}
    assert set(out) == {i for i, _ in kept}
    assert {100, 101, 102, 103, 104, 105}.isdisjoint(out) and 106 in out and "jo@site.org" not in out[106]["text"]
    lib = tokenizers.Tokenizer.from_file(tokenizer_path(corpus_pipeline.TOKENIZER))
    for i, t in kept:
        if i != 106:
            assert out[i]["text"] == t and out[i]["ids"] == lib.encode(t, add_special_tokens=False).ids and out[i]["n_tokens"] == len(out[i]["ids"])


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(folder[0])).columns == docs.columns
        assert stage(spark, docs.limit(0), str(folder[0])).count() == 0
