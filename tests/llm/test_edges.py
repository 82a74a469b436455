"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tempolin.llm import chat_format, decontamination, jaccard_join, license_scan, mixing, quality, sharding, token_counts, token_files, toxicity
from tempolin.llm.common import scratch_path
from tempolin.llm.queries import MIX_WEIGHTS, mix_domain, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, shard string, tokens string, doc string, items string, `count` int"


def frame(spark, rows):
    """Documents with columns that are called like the operators' own."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 7, "x", "x", "x", "x", 3) for i, t, lang, src in rows], SCHEMA)


def long_text(n=30_000):
    rng = random.Random(1)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


ODD = [
    (1, None, None, None),
    (2, "", "en", "src1"),
    (3, " \n\t ", "en", "src1"),
    (None, "no id here at all", "en", "src2"),
    (5, "same text twice " * 4, "en", "src0"),
    (5, "same text twice " * 4, "en", "src0"),
    (6, "same text twice " * 4, "xx", "other"),
    (7, "one", "fr", "src3"),
    (8, long_text(), "en", "src0"),
    (9, "Été \U0001f600 naïve café İstanbul ΣΑΣ", "fr", "src4"),
    (10, "<|endoftext|> a <s> b </s>", "en", "src5"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_permutation_and_its_inverse():
    for n in (1, 2, 7, 8, 1000):
        out = sharding.permute(np.arange(n), n, 3)
        assert sorted(out) == list(range(n))
        assert sharding.unpermute(out, n, 3).tolist() == list(range(n))
    assert sharding.permute(np.arange(50), 50, 1).tolist() != sharding.permute(np.arange(50), 50, 2).tolist()


def test_shards(spark, odd, none):
    rows = sharding.shard_rows(odd, n_shards=3).collect()
    assert sorted(r.row_number for r in rows) == list(range(len(ODD)))
    assert sorted((r.shard, r.slot) for r in rows) == sorted((k % 3, k // 3) for k in range(len(ODD)))
    again = sharding.shard_rows(odd.repartition(7), n_shards=3).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    for r in rows:
        assert sharding.locate(r.row_number, len(ODD), 3, 20240917) == (r.shard, r.slot)
        assert sharding.row_at(r.shard, r.slot, len(ODD), 3, 20240917) == r.row_number
    assert sharding.shard_rows(none).collect() == []


def test_a_row_repeated_very_often_is_expanded_in_pieces(spark):
    docs = spark.range(10_000).selectExpr("4 as doc_id", "'x' as text")
    rows = sharding.shard_rows(docs, n_shards=8).collect()
    assert sorted(r.row_number for r in rows) == list(range(10_000))


def brute_spans(words, items, window):
    hit, found = set(), set()
    for item_id, text in items:
        w = decontamination.words_of((text or "").encode())
        k = min(len(w), window)
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(item_id)
    return hit, found


@pytest.mark.parametrize("block_words", [60_000, 12])
def test_automaton_against_all_windows(spark, block_words):
    rng = random.Random(0)
    words = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(k, words(rng.choice([0, 1, 2, 4, 6, 9]))) for k in range(25)] + [(3, words(5)), (None, words(5)), (90, None)]
    docs = [(k, words(rng.randint(0, 60))) for k in range(40)] + [(40, None)]
    out = decontamination.find_spans(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4, block_words=block_words
    ).collect()
    texts = dict(docs)
    assert len(out) == len(docs)
    for r in out:
        w = decontamination.words_of((texts[r.doc.doc_id] or "").encode())
        hit, found = brute_spans(w, items, 4)
        assert r.n_words == len(w)
        assert {p for s in r.spans for p in range(s.start, s.end)} == hit
        assert r["items"] == sorted(str(i) for i in found if i is not None)


def test_spans_are_taken_out(spark, odd, none):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = frame(spark, [(1, "Keep this. Alpha, beta; GAMMA delta! And this one too, of course.", "en", "s"), (2, "alpha beta gamma delta", "en", "s"), (3, "clean", "en", "s")])
    out = {r.doc_id: r for r in decontamination.decontaminate(docs, items, window=4).collect()}
    assert set(out) == {1, 3} and out[1].text == "Keep this. ! And this one too, of course." and out[1].shard == "x"
    assert decontamination.decontaminate(docs, items, window=4, max_span=4).count() == 2
    kept = decontamination.decontaminate(odd, items.where("false"))
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert decontamination.decontaminate(none, items).count() == 0


def test_cleaning_in_blocks_is_the_same(spark, odd, monkeypatch):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    items = spark.createDataFrame([(k, words(rng.choice([2, 4, 7]))) for k in range(12)], "item_id long, text string")
    docs = frame(spark, [(k, words(rng.randint(0, 40)).replace("c", "C,"), "en", "s") for k in range(60)]).unionByName(odd)
    whole = decontamination.decontaminate(docs, items, window=5, max_span=2, max_coverage=0.6)
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 10)
    monkeypatch.setattr(decontamination, "BLOCK_DOCS", 7)
    monkeypatch.setattr(decontamination, "FILTER_WINDOWS", 9)
    monkeypatch.setattr(decontamination.find_spans, "__defaults__", tuple(10 if d == 60_000 else d for d in decontamination.find_spans.__defaults__))
    parts = decontamination.decontaminate(docs, items, window=5, max_span=2, max_coverage=0.6)
    got = sorted(map(str, whole.collect()))
    assert got == sorted(map(str, parts.collect())) and 0 < len(got) < docs.count()


def test_quality(spark, odd, none):
    rows = quality.judge(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc.doc_id: r for r in rows}
    assert (by_id[1].n_words, by_id[1].word_chars, by_id[1].base_failed, by_id[1].kept) == (0, 0, True, False)
    assert by_id[8].n_words == 30_000
    assert by_id[5].n_repeat_words == 12
    assert quality.judge(none).collect() == []
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc.doc_id for r in rows if r.kept}


def test_repeated_words_against_counting(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.judge(docs).collect():
        w = texts[r.doc.doc_id].split()
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
        assert r.n_repeat_words == len(covered)


def test_symbol_noise_is_far_from_its_language(spark, sf_dir):
    prose = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and n_chars > 900 and instr(text, '|') = 0").limit(40).collect()]
    noise = [(-1, " ".join(f"{w}$$$" for w in prose[0][1].split()), "en")]
    kept = {r.doc.doc_id: r.kept for r in quality.judge(spark.createDataFrame(prose + noise, "doc_id long, text string, lang string")).collect()}
    assert kept[-1] is False and sum(kept.values()) >= 30


@pytest.mark.parametrize("spoil", [lambda t: " ".join(f"{w}$$$" for w in t.split()), str.upper], ids=["symbols", "capitals"])
def test_a_hot_source_of_junk_moves_no_verdict(spark, sf_dir, spoil):
    """A third of the rows, and more of the characters, are one source's junk."""
    prose = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' and n_chars > 900 and text rlike '[a-z]'").orderBy("doc_id").limit(40).collect()]
    clean = [(k, t, "en", "src1") for k, t in enumerate(prose)]
    hot = [(1000 + k, spoil(prose[0]), "en", "src0") for k in range(len(prose) // 2)]
    verdicts = lambda rows: {r.doc.doc_id: r.kept for r in quality.judge(frame(spark, rows)).collect()}
    alone, mixed = verdicts(clean), verdicts(clean + hot)
    assert sum(alone.values()) >= 30
    assert {k: mixed[k] for k in alone} == alone
    assert not any(mixed[i] for i, *_ in hot)
    assert {r.doc_id for r in quality.filter_documents(frame(spark, clean + hot)).collect()} == {k for k, kept in mixed.items() if kept}


def test_verdicts_against_labels_with_table_junk(spark):
    """Labelled documents of all kinds on the middle tables, ' | ' tables among them."""
    import os

    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    labels = spark.read.parquet(f"{path}/labels.parquet").selectExpr("doc_id", "quality as label")
    docs = spark.read.parquet(f"{path}/documents.parquet").join(labels, "doc_id").selectExpr("*", "instr(text, ' | ') > 0 as has_table")
    rows = [r for r in quality.judge(docs, ("doc_id", "label", "has_table")).collect() if r.n_words >= quality.MIN_WORDS]
    good, tables = [r for r in rows if r.doc.label == 1], [r for r in rows if r.doc.label == 0 and r.doc.has_table]
    assert len(good) > 2000 and all(r.kept for r in good if not r.base_failed)
    assert len(tables) > 100 and sum(r.kept for r in tables) / len(tables) < 0.2


def test_licenses(spark, odd, none):
    notice = license_scan.TEMPLATES[1][1]
    filler = "word and more of it " * 30
    rows = [(1, filler + notice + filler, "en", "s"), (2, notice, "en", "s"), (3, "This work is licensed under the GNU General Public Licence, version 3.", "en", "s"), (4, filler, "en", "s"), (4, filler, "en", "s"), (2, notice, "en", "s")]
    found = license_scan.scan_licenses(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.template_id, r.n_found == r.n_shingles) for r in found) == [(1, "GPL-3.0", True), (2, "GPL-3.0", True), (2, "GPL-3.0", True)]
    many = license_scan.scan_licenses(frame(spark, rows), [(str(k), f"notice {k} of a long list of notices") for k in range(900)] + list(license_scan.TEMPLATES))
    assert many.count() == 3
    assert license_scan.scan_licenses(odd).collect() == [] and license_scan.scan_licenses(none).collect() == []
    assert license_scan.scan_licenses(odd, [("short", "two words"), ("empty", "")]).collect() == []


def test_every_notice_is_retrieved_wherever_it_stands(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(4)) for _ in range(n))
    rows = [(k * 100 + at, f"{words(at)} {t} {words(20)}", "en", "s") for k, (_, t) in enumerate(license_scan.TEMPLATES) for at in range(40)]
    assert license_scan.scan_licenses(frame(spark, rows)).count() == len(rows)


#: A list of its own, not the templates: what TESTDATA.md's license lines and license texts hold.
NOTICES = (
    "all rights reserved",
    "licensed under the apache license",
    "licensed under cc by-nc",
    "released under the mit license",
    "gnu general public license, version 3",
)
BODIES = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.',
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.",
    " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n *\n * This program is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n * GNU General Public License for more details.",
)


def test_scan_against_an_independent_list_of_notices(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: " ".join((r.text or "").lower().split()) for r in docs.collect()}
    expected = {(i, n) for i, t in texts.items() for n in NOTICES if n in t}
    assert {n for _, n in expected} >= {"all rights reserved"}
    found = {}
    for r in license_scan.scan_licenses(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.template_id)
    assert {i for i, _ in expected} <= set(found)
    for i in found:
        assert len(found[i]) >= len({n for k, n in expected if k == i})


def test_license_texts_are_found(spark):
    filler = "klmn onml lkmn " * 40
    rows = [(10 * k + at, filler[: 5 * at] + body + " " + filler, "en", "s") for k, body in enumerate(BODIES) for at in range(7)]
    found = license_scan.scan_licenses(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, *_ in rows)


def test_three_words_are_retrieved_next_to_any_others(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("klmnop") for _ in range(6))
    rows = [(k, f"{' '.join(word() for _ in range(k % 9))} All rights reserved. {' '.join(word() for _ in range(12))}", "en", "s") for k in range(4000)]
    found = license_scan.scan_licenses(frame(spark, rows), [("reserved", "All rights reserved.")])
    assert found.count() >= 3990


def test_no_shingle_of_a_window_can_be_outweighed_in_all_bands():
    assert license_scan.WINDOW - license_scan.SHINGLE + 1 == 2  # of two hashes the highest different bit decides
    assert all(len({c >> bit & 1 for c in license_scan._constants()}) == 2 for bit in range(64))


def test_token_counts_and_their_cache(spark, odd, none):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = scratch_path(spark, "cache")
    for _ in range(2):
        rows = token_counts.count_tokens(odd, path, cache).collect()
        expected = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t, _, _ in ODD)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == expected
        stored = spark.read.parquet(cache)
        assert stored.count() == len({t or "" for _, t, _, _ in ODD})  # the second run adds nothing
    assert token_counts.count_tokens(none, path, scratch_path(spark, "cache")).collect() == []
    other = token_counts.count_tokens(odd, tokenizer_path("byte_bpe_50k.json"), cache)
    assert other.count() == len(ODD) and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, width)
    assert len(data) == -(-1001 * width // 8)
    assert np.array_equal(token_files.unpack(data, width, 1001), ids)


def test_file_is_read_at_random(tmp_path):
    rng = np.random.default_rng(0)
    docs = [(None if k == 0 else k, rng.integers(0, 5000, n).astype(np.uint32)) for k, n in enumerate([3, 0, 9000, 1, 4096, 8192, 5])]
    with open(tmp_path / "f", "wb") as out:
        writer = token_files.Writer(out, token_files.width_for(5000))
        for doc_id, ids in docs:
            writer.add(doc_id, ids)
        writer.close()
    with pa.OSFile(str(tmp_path / "f")) as source:
        reader = token_files.Reader(source)
        assert reader.width == 13
        for (a, x), (b, y) in zip(docs, reader):
            assert a == b and np.array_equal(x, y)
        whole = np.concatenate([x for _, x in docs])
        assert np.array_equal(reader.document(2), docs[2][1])
        for start, end in ((0, 1), (4095, 4097), (100, 20000), (21296, 21297), (5, 5)):
            assert np.array_equal(reader.ids(start, end), whole[start:end])


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = token_files.encode_to_files(odd, path).collect()
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _, _ in ODD]
    key = lambda x: (x is not None, x or 0)
    expected = sorted(((key(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids))
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == expected
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(itertools.accumulate([0, *(r.n_tokens for r in ordered)]))[:-1]
    assert [key(r.doc_id) for r in ordered] == sorted(key(r.doc_id) for r in ordered)
    assert token_files.encode_to_files(none, path).collect() == []


def test_word_by_word_is_the_library():
    encoder = token_files.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    texts = ["don't, it's. O'Neill's", "a.b,c;d:e!f?g", "<|startoftext|>x <|endoftext|>", "İ. ΣΑΣ. é. ½. Ⅳ...", " a b .\x1cx", "", "x" * 500 + ".", "'s.'t,,;."]
    assert encoder.by_word
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    whole = token_files.WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    assert not whole.by_word
    assert whole.encode(["a  b"])[0].tolist() == whole.tokenizer.encode("a  b", add_special_tokens=False).ids


def test_added_tokens_in_capitals_are_text(spark):
    path = tokenizer_path("word_bpe_49k.json")
    encoder = token_files.WordEncoder(path)
    marks = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|StartOfText|>"]
    texts = [t for m in marks for t in (m, f"a {m} b", f"a{m}.B\nc", f"{m}{m.upper()} \u0130\u03a3 {m}")] + ["Plain text.", "", "<|end of text|>"]
    library = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in encoder.encode(texts)] == library
    rows = token_files.encode_to_files(frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]), path).collect()
    assert [(r.n_tokens, r.ids_crc32) for r in sorted(rows)] == [(len(i) + 1, zlib.crc32(np.array([*i, 1], "<u4").tobytes())) for i in library]


def test_random_texts_have_the_ids_of_the_library():
    encoder = token_files.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(11)
    parts = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|StartOfText|>", ".<|endoftext|>.", "the", "The", "THE", "it's", "IT'S", "'s", "''t", "x1", "42", "\u00e9", "\u00c9", "e\u0301", "E\u0301",
             "J\u030c", "j\u030c", "H\u0331", "T\u0308", "W\u030a", "\u0130", "\u03a3\u0391\u03a3", "\u00df", "\u1e9e", "\u00bd", "\u0661", "\u4e2d\u6587", "\U0001f600", "\u0301", "\u200d", "\x1c",
             "\u00a0", "\x85", "\t", "\n", " ", " ", " ", ".", ",", ";", ":", "!", "?", "...", "-", "_", "#", "\\", "\u00b5", "\u0149", "\ufb01", "\u212b", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    library = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for start in range(0, len(texts), 64):
        for text, ids, expected in zip(texts[start : start + 64], encoder.encode(texts[start : start + 64]), library[start : start + 64]):
            assert ids.tolist() == expected, text


@pytest.mark.parametrize("change", ["cased", "pattern", "normalized"])
def test_tokenizers_with_other_steps_get_texts_whole(tmp_path, change):
    import json

    with open(tokenizer_path("word_bpe_49k.json")) as file:
        settings = json.load(file)
    if change == "cased":
        settings["normalizer"]["normalizers"].pop()
    elif change == "pattern":
        settings["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}.]+|[^\s]"
    else:
        settings["added_tokens"][0]["normalized"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(settings))
    encoder = token_files.WordEncoder(str(path))
    assert not encoder.by_word
    for text in ("The end.of LINE. <|ENDOFTEXT|>", "A.b a.B"):
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def brute_components(rows, size, percent):
    sets = []
    for _, text, _, _ in rows:
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = [x for x in w.replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for k, (i, *_rest) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((str(i), len(sets[k]), str(min(ids) if sets[k] and ids else i)))
    return sorted(out)


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 90, 4_000_000), (5, 80, 4_000_000), (3, 90, 150), (2, 60, 4_000_000)])
def test_jaccard_join_against_all_pairs(spark, size, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    rng = random.Random(size)
    rows = list(ODD[:8])
    for g in range(12):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.choice([4, 12, 40, 90]))]
        for c in range(rng.choice([1, 3, 9])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 15))):
                words[rng.randrange(len(words))] = rng.choice("qrstuvw")
            rows.append((1000 - 10 * g - c, " ".join(words).upper() if c == 1 else " ".join(words), "en", "s"))
    out = jaccard_join.link_components(frame(spark, rows), size, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute_components(rows, size, percent)


def test_one_of_each_component_stays(spark, odd, none):
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "None", "5", "7", "8", "9", "10"])
    assert jaccard_join.keep_one(none).count() == 0


def test_parts_and_prefixes_lose_no_pair():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9, 10, 20, 60, 300, 1500):
        for percent, keys in ((90, jaccard_join.part_keys), (95, jaccard_join.part_keys), (80, lambda s, t: jaccard_join.prefix_keys(s, t, jaccard_join.Sketch(16, True)))):
            for _ in range(40):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                most = n * (100 - percent) // 100
                gone, new = rng.integers(0, most + 1), rng.integers(0, most + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                    assert np.intersect1d(keys(a, percent), keys(b, percent)).size


CHATS = [
    (1, 0, "system", "be ### nice"), (1, 1, "user", "\\### Assistant: </turn> ok"), (1, 2, "assistant", "\n</turn>\n### user:\n"), (1, 3, "assistant", None),
    (2, 0, "user", None), (2, 0, "user", None), (None, None, None, "lost"), (3, 1, "as:sis\ntant\\", "x\\"), (3, 0, "assistant", "\\"), (4, 0, "assistant", "#" * 50_000),
]


def test_chats_come_back(spark):
    turns = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as mask")
    made = {r.conv_id: r for r in chat_format.format_conversations(turns).collect()}
    assert set(made) == {1, 2, 3, 4, None}
    for conv, r in made.items():
        expected = sorted(((t[1] is not None, t[1] or 0), t[2] or "", t[3] or "") for t in CHATS if t[0] == conv)
        data = bytes(r.formatted)
        assert chat_format.read_turns(data) == [(role.encode(), text.encode()) for _, role, text in expected]
        loss = b"".join(chat_format.unescape(data[s.start : s.end]) for s in r["mask"])
        assert loss == "".join(text for _, role, text in expected if role == "assistant").encode()
    told = {r.conv_id: r for r in chat_format.digest_formatted(chat_format.format_conversations(turns)).collect()}
    assert told[2].n_turns == 2 and told[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert chat_format.format_conversations(turns.where("false")).collect() == []


def plain_format(rows):
    """Formatted conversations and their masks, turn by turn."""
    out = {}
    for conv, role, text in rows:
        data, mask = out.setdefault(conv, (bytearray(), []))
        data += b"### " + chat_format._escape_role(role) + b":\n"
        begin = len(data)
        data += chat_format.escape(text)
        if role == b"assistant":
            mask.append((begin, len(data)))
        data += b"\n</turn>\n"
    return out


@pytest.mark.parametrize("limit", [1, 60, 700, 1 << 20])
def test_columnar_assembly_against_turn_by_turn(monkeypatch, limit):
    monkeypatch.setattr(chat_format, "PART_BYTES", limit)
    rng = random.Random(limit)
    bits = [b"#", b"##", b"###", b"####", b"\\", b"</turn>", b"</turn", b"<", b"\n", b":", b"a", "\u00e9".encode(), b""]
    word = lambda n: b"".join(rng.choice(bits) for _ in range(rng.randrange(n)))
    rows = [(conv, rng.choice([b"assistant", b"user", word(4)]), word(12)) for conv in [None, *range(40)] for _ in range(rng.choice([1, 1, 2, 5, 30]))]
    schema = pa.schema([("conv_id", pa.int64()), ("role", pa.binary()), ("content", pa.binary())])
    table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    made = list(chat_format._format(iter(table.to_batches(max_chunksize=37))))
    got, parts = {}, {}
    for batch in made:
        for conv, part, data, mask in zip(*(batch.column(k).to_pylist() for k in range(4))):
            whole, spans = got.setdefault(conv, (bytearray(), []))
            assert part == parts.get(conv, -1) + 1
            parts[conv] = part
            spans += [(len(whole) + s["start"], len(whole) + s["end"]) for s in mask]
            whole += data
    assert got == plain_format(rows)
    digests = {r["conv_id"]: r for b in chat_format._digest(iter(made)) for r in b.to_pylist()}
    assert len(digests) == 41 and all(digests[c]["n_turns"] == sum(r[0] == c for r in rows) for c in digests)
    for conv, r in digests.items():
        assert r["turns_sha256"] == hashlib.sha256(b"".join(x + b"\n" + t + b"\n" for c, x, t in rows if c == conv)).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(b"".join(t for c, x, t in rows if c == conv and x == b"assistant")).hexdigest()


def test_assembly_of_many_segments():
    rng = random.Random(0)
    segments = [rng.choice([b"", b"### ", b"\n</turn>\n", bytes([rng.randrange(97, 120)]) * rng.randint(0, 9)]) for _ in range(1000)]
    counts = [10] * 99 + [0, 10]
    column, offsets = chat_format.assemble(segments, counts)
    assert b"".join(column.to_pylist()) == b"".join(segments) and column[99].as_py() == b""
    assert offsets[-1] == sum(map(len, segments))


def test_mixing_shares(spark, odd, none):
    rows = [(k, "w " * (1 + k % 7), ("en", "fr")[k % 2], f"src{k % 10}") for k in range(600)]
    docs = frame(spark, rows)
    light = mixing.light_rows(docs)
    total = light.agg({"tokens": "sum"}).first()[0]
    plan = mixing.plan_mix(light, 50, MIX_WEIGHTS, 2, 7)
    taken = mixing.take(light, plan, 7)
    got = taken.agg({"tokens": "sum"}).first()[0]
    assert total // 2 - 60 <= got <= total // 2 + 7 * 60
    assert sorted(map(tuple, taken.select("doc_id", "epoch").collect())) == sorted(map(tuple, mixing.take(light.repartition(9), plan, 7).select("doc_id", "epoch").collect()))
    assert mixing.mix(docs, 100, {}, 1).count() <= 600
    assert mixing.mix(docs, 0, {}).count() == 0
    out = mixing.mix(odd, 100, MIX_WEIGHTS)
    assert out.columns == odd.columns and out.count() > 0
    assert mixing.mix(none, 80, MIX_WEIGHTS).count() == 0


def water_fill(capacities, weights, budget):
    """Shares by repeated sharing out, as fractions."""
    from fractions import Fraction

    shares = {k: Fraction(0) for k in capacities}
    open_ = {k for k in capacities if capacities[k] > 0}
    left = Fraction(min(budget, sum(capacities.values())))
    while open_ and left > 0:
        each = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if capacities[k] - shares[k] <= each * weights[k]}
        if not full:
            for k in open_:
                shares[k] += each * weights[k]
            break
        for k in full:
            left -= capacities[k] - shares[k]
            shares[k] = Fraction(capacities[k])
        open_ -= full
    return shares


def test_shortages_go_to_siblings_first(spark):
    rng = random.Random(3)
    for _ in range(3):
        capacities = {f"k{i}": rng.choice([0, 5, 40, 300, 1000]) for i in range(7)}
        weights = {k: rng.randint(1, 5) for k in capacities}
        children = spark.createDataFrame([(k, capacities[k], weights[k]) for k in capacities], "c_x string, capacity long, weight long")
        for budget in (0, 10, 400, 10_000):
            parents = spark.createDataFrame([(budget,)], "budget long")
            got = {r.c_x: r.given for r in mixing.share(children, parents, [], "x").collect()}
            exact = water_fill(capacities, weights, budget)
            assert all(abs(got[k] - exact[k]) <= 1 for k in got)
            assert sum(got.values()) <= min(budget, sum(capacities.values()))


def test_weights_of_zero_and_large_totals(spark):
    """A node of weight 0 gets nothing, also where its siblings run short; 10 ** 17 tokens and weights in the millions are exact."""
    capacities = {"a": 10**17, "b": 3 * 10**16, "c": 10**17, "d": 7, None: 10**16}
    weights = {"a": 5_000_000, "b": 2_000_001, "c": 0, "d": 1, None: 999_999}
    children = spark.createDataFrame([(k, capacities[k], weights[k]) for k in capacities], "c_x string, capacity long, weight long")
    for budget in (1, 10**16, 10**17, 2 * 10**17):
        got = {r.c_x: r.given for r in mixing.share(children, spark.createDataFrame([(budget,)], "budget long"), [], "x").collect()}
        exact = water_fill({k: v for k, v in capacities.items() if weights[k]}, weights, budget)
        assert got["c"] == 0 and all(abs(got[k] - exact[k]) <= 1 for k in exact)
    with pytest.raises(ValueError):
        mixing.weight_of({"a": -1}, pa)
    docs = frame(spark, [(k, "w " * 5, "en", f"src{k % 2}") for k in range(40)])
    taken = mixing.mix(docs, 100, {"source": {"src0": 0}}, 3)
    assert {r.source for r in taken.select("source").distinct().collect()} == {"src1"} and taken.count() == 40


def test_a_leaf_in_slices_takes_the_same_prefix(spark):
    """The last epoch of a leaf is its documents in the order of their ranks, until the budget ends."""
    rows = [(k, "w " * (1 + k % 9), "en", "src0") for k in range(500)]
    light = mixing.light_rows(frame(spark, rows))
    taken = mixing.take(light, mixing.plan_mix(light, 37, {}, 1, 7), 7).collect()
    ranks = sorted((hashlib.md5(f"7:0:{i}".encode()).hexdigest(), i, len(t.split())) for i, t, _, _ in rows)
    budget, expected = sum(n for _, _, n in ranks) * 37 // 100, []
    for _, i, n in ranks:
        if budget <= 0:
            break
        expected.append(i)
        budget -= n
    assert sorted(r.doc_id for r in taken) == sorted(expected)


def test_a_shortage_stays_in_its_domain(spark):
    """src5 holds little of what it should get; src0, of the same domain and language, makes up for it."""
    rows = [(k, "w " * 10, "en", "src0") for k in range(50)] + [(100, "w " * 10, "en", "src5")] + [(200 + k, "w " * 10, "en", "src1") for k in range(50)]
    light = mixing.light_rows(frame(spark, rows), domain_of=mix_domain)
    leaves = light.groupBy(*mixing.LEVELS).agg({"tokens": "sum", "doc_id": "count"}).toDF(*mixing.LEVELS, "tokens", "docs")
    leaves = leaves.select(*mixing.LEVELS, "tokens", "docs")
    totals = {r["source"]: r for r in leaves.collect()}
    parents = spark.createDataFrame([(400,)], "budget long")
    given = {r["source"]: r.budget for r in mixing.budgets(leaves.withColumn("tokens", leaves.tokens.cast("long")), parents, {}, 1).collect()}
    assert given == {"src0": 190, "src5": 10, "src1": 200} and set(totals) == set(given)


def test_toxicity_edges(spark, odd, none):
    empty = toxicity.score_toxicity(odd, toxicity.OrdinalModel()).collect()
    assert len(empty) == len(ODD) and not any(r.toxic for r in empty)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (5, None, None), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score_toxicity(odd, model).count() == len(ODD)
    for labelled in (labels.where("false"), labels.where("toxic = 1")):
        toxicity.score_toxicity(odd, toxicity.train(odd, labelled)).collect()
    assert toxicity.score_toxicity(none, toxicity.train(none, labels)).collect() == []


def naive_severity(text, weights, thresholds):
    """Expected severity, and the probabilities of each grade or more, from the text alone."""
    import math
    import re

    data = (text or "").encode()
    found = set(re.findall(rb"[0-9a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in data)))
    begun = {b"^" + w.decode(errors="replace")[:n].encode() for w in found for n in (4, 5, 6, 7) if len(w.decode(errors="replace")) > n}
    score = math.fsum(weights.get(f, 0.0) for f in found | begun)
    chance = [1 / (1 + math.exp(min(60, max(-60, t - score)))) for t in thresholds]
    return sum(chance), chance


def test_toxicity_is_the_naive_score(spark, odd):
    """Ties, repeats, very long and empty texts, several languages: the operator against sums over the text."""
    weights = {b"same": 1.25, b"text": -0.5, "^naïv".encode(): 2.0, b"abcd": 3.0, b"^abcd": 0.5, b"one": 4.0, b"caf\xc3\xa9": -1.0, "été".encode(): 1.0, "Été".encode(): 0.5}
    model = toxicity.OrdinalModel(dict(weights), (0.5, 3.5))
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in toxicity.score_toxicity(odd, model).collect():
        severity, chance = naive_severity(texts[r.doc_id], weights, (0.5, 3.5))
        assert abs(r.severity - severity) < 1e-5
        assert r.grade == sum(c >= 0.5 for c in chance) and r.toxic == (r.grade > 0)


def test_ordinal_fit_orders_grades():
    rng = random.Random(0)
    docs, grades = [], []
    for _ in range(900):
        grade = rng.choice([0, 0, 1, 2])
        told = {1: {b"bad"}, 2: {b"bad", b"vile"}}.get(grade, set())
        docs.append(sorted({f"w{rng.randrange(60)}".encode() for _ in range(12)} | told))
        grades.append(grade)
    model = toxicity.fit_ordinal(docs[:600], np.array(grades[:600]), penalty=1e-3)
    assert model.thresholds[0] < model.thresholds[1]
    scores = np.array([sum(model.weights.get(w, 0.0) for w in d) for d in docs[600:]])
    severity = model.at_least(scores).sum(axis=1)
    means = [severity[np.array(grades[600:]) == g].mean() for g in range(3)]
    assert means[0] < 0.3 and means[0] < means[1] < means[2] and means[2] > 1.4


def test_threads_keep_their_scratch(spark):
    """A thread that cleans up deletes what it made, and nothing of another."""
    import os
    import threading

    from tempolin.llm import common

    common.clean(spark)
    mine = common.cut(spark.range(3), "mine")
    seen = {}

    def other():
        theirs = common.cut(spark.range(4), "theirs")
        kept = common.mark()
        common.cut(spark.range(5), "more")
        common.clean(spark, kept)
        seen["theirs"] = theirs.count()
        common.clean(spark)
        seen["gone"] = not os.path.exists(theirs._scratch.removeprefix("file:"))

    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    assert seen == {"theirs": 4, "gone": True} and mine.count() == 3
    common.clean(spark)
    assert not os.path.exists(mine._scratch.removeprefix("file:"))


def test_parts_of_a_stored_conversation(spark, monkeypatch):
    """A table of parts in any order is put in order, or refused."""
    rows = [(7, None, "user", "x" * 40), (7, 1, "assistant", "y" * 50), (7, 2, "user", "z"), (8, 0, "assistant", "w")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat_format.format_conversations(turns)
    expected = sorted(map(tuple, chat_format.digest_formatted(whole).collect()))
    cut = []
    for r in whole.collect():
        first = chat_format.read_turns(bytes(r.formatted))
        if len(first) == 1:
            cut.append((r.conv_id, 0, bytes(r.formatted), [tuple(m) for m in r.mask]))
            continue
        end = bytes(r.formatted).index(chat_format._TAIL) + len(chat_format._TAIL)
        cut.append((r.conv_id, 1, bytes(r.formatted)[end:], [(m.start - end, m.end - end) for m in r.mask if m.start >= end]))
        cut.append((r.conv_id, 0, bytes(r.formatted)[:end], [tuple(m) for m in r.mask if m.start < end]))
    stored = spark.createDataFrame(cut, "conv_id long, part int, formatted binary, mask array<struct<start: long, end: long>>").coalesce(1)
    assert sorted(map(tuple, chat_format.digest_formatted(stored, ordered=False).collect())) == expected
    with pytest.raises(Exception, match="one after the other"):
        chat_format.digest_formatted(stored).collect()


def test_scratch_is_cleaned(spark, odd):
    import os

    from tempolin.llm import common

    common.clean(spark)
    sharding.shard_rows(odd).collect()
    made = [p.removeprefix("file:") for p in common._made.paths]
    assert made and all(os.path.isdir(p) for p in made)
    common.clean(spark)
    assert not any(os.path.exists(p) for p in made)


@pytest.mark.parametrize("packed", [True, False])
def test_sketch_counts_up_to_its_limit(packed):
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    parts = [jaccard_join.Sketch(20, packed) for _ in range(2)]
    for k in range(5):
        parts[k % 2].add(hashes[k * 60 :])
    whole = jaccard_join.Sketch(20, packed, jaccard_join._added(parts[0].data, parts[1].data, packed))
    expected = np.minimum(np.minimum(np.arange(len(hashes)) // 60 + 1, 5), 3 if packed else 255)
    assert (whole.counts(hashes) >= expected).all() and (whole.counts(hashes) == expected).mean() > 0.95
    assert jaccard_join.Sketch.plan(0) == (16, True) and jaccard_join.Sketch.plan(10**8)[1] and not jaccard_join.Sketch.plan(10**10)[1]


def test_near_duplicates_that_share_single_shingles_are_no_candidates(spark, monkeypatch):
    """A sketch that tells nothing, as one of very many shingles does: documents in a chain of shared phrases stay apart."""
    monkeypatch.setattr(jaccard_join.Sketch, "plan", classmethod(lambda cls, total: (2, True)))
    links, real = [], jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda found: links.append(found.count()) or real(found))
    phrase = lambda k: " ".join(f"p{k}x{j}" for j in range(5))
    texts = [" ".join([phrase(k), *(f"w{k}x{j}" for j in range(12)), phrase(k + 1)]) for k in range(200)]
    texts.append(texts[7] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in jaccard_join.keep_one(docs, 5, 80).collect()}
    assert kept == set(range(200)) and links[0] == 1


def test_prefixes_of_linked_sets_share_enough_keys():
    rng = np.random.default_rng(5)
    sketch = jaccard_join.Sketch(16, True)
    for t in (50, 67, 80, 87):
        for size in (1, 2, 3, 4, 5, 9, 40, 200):
            for _ in range(20):
                common = rng.integers(0, 1 << 63, size, dtype=np.uint64)
                most = size * (100 - t) // t
                extra = int(rng.integers(0, most + 1))
                left, right = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n, dtype=np.uint64)])) for n in (extra, most - extra))
                shared = np.intersect1d(jaccard_join.prefix_keys(left, t, sketch), jaccard_join.prefix_keys(right, t, sketch))
                assert len(shared) >= jaccard_join.SHARED


def test_coarse_filter_of_texts_stays_fine_where_all_buckets_have_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(jaccard_join, "BUCKETS", 1)
    rows = spark.range(6400).select(F.xxhash64("id").alias("h"))
    taken = rows.limit(2).select(F.col("h").alias("k"))
    near = jaccard_join.bucketed(rows, "h", taken, "k", "left_semi").count()
    assert 2 <= near < 400
    assert jaccard_join.bucketed(rows, "h", taken, "k", "left_anti").count() == 6400 - near
