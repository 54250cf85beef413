"""The corpus pipeline, each stage against a plain version, on small and awkward tables."""

from collections import Counter

import pytest
import tiktoken
from public_tokenizers import PATTERN, path

import corpus_pipeline
from emberlake.llm.bpe import read_ranks
from tests.llm.test_corpus_operators import AWKWARD, SCHEMA, brute_classes, brute_lines, brute_targets, texts_of

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_stage_keeps_clean_documents(spark, docs):
    out = STAGE["language"](spark, docs, SF)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    lettered = {d for d, t in texts_of(docs).items() if t and any(map(str.isalpha, t))}
    assert kept <= lettered and len(kept) >= 0.99 * len(lettered)


def test_line_stage_equals_plain_version(spark, docs):
    out = STAGE["lines"](spark, docs, SF)
    want = {d: t for d, n, gone, t in brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()]) if gone < n}
    assert out.columns == docs.columns and texts_of(out) == want
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_near_stage_keeps_one_of_each_class(spark, docs):
    out = STAGE["near"](spark, docs, SF)
    classes = brute_classes(texts_of(docs))
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == set(classes.values())


def test_mix_stage_takes_targets(spark, docs):
    out = STAGE["mix"](spark, docs, SF)
    words = lambda rows: sum((Counter({r["source"]: len((r["text"] or "").split())}) for r in rows), Counter())
    have, took = words(docs.collect()), words(out.collect())
    assert out.columns == docs.columns
    for source, target in brute_targets(have).items():
        assert abs(took[source] - target) <= max(2, 0.01 * target)
    assert max(Counter(r["doc_id"] for r in out.collect()).values()) <= 3


def test_token_stage_equals_library(spark, docs):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(path(corpus_pipeline.RANK_FILE)), special_tokens={})
    texts = texts_of(docs)
    for r in STAGE["tokens"](spark, docs, SF).collect():
        assert r["round_trip"] and r["token_ids"] == library.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"])


@pytest.mark.parametrize("name", ["language", "lines", "near", "mix", "tokens"])
def test_stages_on_awkward_rows(spark, name):
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    out = STAGE[name](spark, docs, SF)
    rows = out.collect()
    if name != "tokens":
        assert out.columns == docs.columns
        given = {r["doc_id"]: r for r in docs.collect()}
        for r in rows:  # every other column is the document's own
            assert [r[c] for c in docs.columns if c != "text"] == [given[r["doc_id"]][c] for c in docs.columns if c != "text"]
    ids = sorted((r["doc_id"] for r in rows), key=repr)
    want = {
        "language": [1, 2, 6, 7, 7, None], "lines": [1, 2, 3, 4, 5, 6, 7, 7, None],
        "near": [1, 2, 3, 4, 5, 6, None], "tokens": [1, 2, 3, 4, 5, 6, 7, 7, None],
    }
    if name in want:
        assert ids == sorted(want[name], key=repr)
    else:
        assert 3 not in ids and 4 not in ids
    assert STAGE[name](spark, docs.where("false"), SF).count() == 0


def test_run_on_awkward_rows(spark, tmp_path):
    for rows, folder in ((AWKWARD, "some"), ([], "none")):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{folder}")
        assert "token_ids" in out.columns and out.where("not round_trip").count() == 0
