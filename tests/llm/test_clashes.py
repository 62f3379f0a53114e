"""Stages on tables whose further columns bear names that the operators work with, and texts full of secrets."""

import random
import re
import time

import pytest

import corpus_pipeline
from paymatch.llm import ngram_join, quality, secret_scan

NAMES = ("_words", "_lines", "_text", "doc", "row", "owner", "repo", "_kept", "kept0", "Kept1", "_stat_chars", "span", "hash", "blocks", "clean", "gaps", "at", "tail", "_label", "score", "cls", "rep", "n", "x", "_id")


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) + str(rng.randrange(50)) for _ in range(rng.randint(1, 60))), "en", f"s{i % 3}", None, *NAMES) for i in range(40)]
    rows += [(50, rows[3][1], *rows[3][2:]), (51, None, None, None, None, *NAMES), (52, "password = abcdefgh1", "en", "s", 20, *NAMES)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in NAMES))


def test_stages_keep_clashing_columns(spark, clashing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    for out in (quality.keep_good(clashing, labels, trees=2), ngram_join.keep_representatives(clashing), secret_scan.redact(clashing)):
        assert out.columns == clashing.columns
        assert all(tuple(r[5:]) == NAMES for r in out.collect())
    assert quality.classify(clashing, labels, trees=2).count() == clashing.count() == secret_scan.scan(clashing).count()


def test_stages_run_one_after_the_other(spark, clashing, tmp_path):
    labels = [(i, int(i % 2 == 0), 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "an item that is in no document at all of those given here")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = clashing
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == clashing.columns
        docs = corpus_pipeline.stage(out)
    assert docs.count() >= 0


def test_many_secrets_in_one_text(spark):
    rng = random.Random(9)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(20_000)]
    tokens = [f"Aa1{rng.randrange(10**20):020d}" for _ in range(5_000)]
    text = " ".join(f"{h} {tokens[i]}" if i < len(tokens) else h for i, h in enumerate(hexes))
    docs = spark.createDataFrame([(1, text, "en", "a"), (2, hexes[7], "en", "b"), (3, hexes[7], "en", "c")], "doc_id bigint, text string, lang string, source string")
    began = time.time()
    row = secret_scan.scan(docs).where("doc_id = 1").first()
    assert row.n_hex == 20_000 and row.spans.count(",") == 24_999 and row.n_live == 24_999 and row.n_example == 1 and row.n_repos == 3
    clean = secret_scan.redact(docs).where("doc_id = 1").first().text
    assert clean.count("[SECRET]") == 24_999 and re.sub(r"\[SECRET\]", "", clean).split() == [hexes[7]]
    assert time.time() - began < 120
