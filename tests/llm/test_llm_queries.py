"""Queries against their SQL, and those without SQL against brute force, on the smallest tables."""

import zlib

import pytest
from conftest import compare

from tempolin.llm.queries import LIMIT_TOKENS, ORACLE_SQL, QUERIES, tokenizer_path

NUMBERS = range(1, 14)


def test_one_query_a_number():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(NUMBERS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    mine, other = compare(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])
    assert mine == other


@pytest.mark.parametrize("name", ["op3_license_scan", "op4_quality_rules", "op11_filter_audit", "op13_lm_scoring"])
def test_query_matches_sql_on_more_rows(spark, sf_dir, name):
    """Verdicts near a limit differ on few rows: these are held against SQL on the next larger tables too."""
    import os

    larger = f"{os.path.dirname(sf_dir)}/sf0.01"
    if not os.path.isdir(larger):
        pytest.skip("no larger test tables here")
    mine, other = compare(spark, larger, QUERIES[name], ORACLE_SQL[name])
    assert mine == other


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_sharding(spark, sf_dir, documents):
    rows = QUERIES["op1_sharding"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(documents) and len(rows) == len(documents)
    for r in rows:
        data = documents[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    by_shard = [sorted(r.slot for r in rows if r.shard == k) for k in range(8)]
    assert all(slots == list(range(len(slots))) for slots in by_shard)
    assert max(map(len, by_shard)) - min(map(len, by_shard)) <= 1


def test_token_counts(spark, sf_dir, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = QUERIES["op5_token_counts"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        n = len(model.encode(documents[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(documents[r.doc_id].encode()), n, n > LIMIT_TOKENS)


def test_token_files(spark, sf_dir, documents):
    import struct

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = sorted(QUERIES["op7_token_files"](spark, sf_dir).collect())
    start, expected = 0, []
    for doc_id in sorted(documents):
        ids = [*tokenizer.encode(documents[doc_id], add_special_tokens=False).ids, 1]
        expected.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert [tuple(r) for r in rows] == expected


def test_toxicity_on_labels_that_were_not_fitted(spark):
    """Held-out accuracy on the middle tables: the fit sees half of the labels."""
    import os

    from tempolin.llm import toxicity

    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    scored = toxicity.score_toxicity(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    met = scored.join(labels.where("doc_id % 2 = 1").select("doc_id", labels["toxic"].alias("label")), "doc_id").collect()
    assert all(0 <= r.severity <= 2 for r in met)
    told = {}
    for lang in ("en", "fr", "de", "es"):
        toxic, clean = ([r for r in met if r.lang == lang and bool(r.label) == x] for x in (True, False))
        told[lang] = sum(r.toxic for r in toxic), len(toxic), sum(r.toxic for r in clean), len(clean)
    print(told)
    for caught, toxic, alarmed, clean in told.values():
        assert toxic >= 15 and clean > 80 and alarmed <= 0.02 * clean, told
    # what few labels teach: the half that is fitted has 16 toxic texts in Spanish, and 135 in English
    least = {"en": 0.9, "fr": 0.9, "de": 0.75, "es": 0.5}
    assert all(told[lang][0] >= share * told[lang][1] for lang, share in least.items()), told
