"""Each stage of the pipeline against brute force on its own input, and odd and empty tables."""

import hashlib
import itertools
import math
import zlib
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
import regex
from test_edges import ODD, brute_spans, frame, water_fill

from tempolin.llm import decontamination, quality
from tempolin.llm.queries import MIX_EPOCHS, MIX_PERCENT, MIX_SEED, MIX_WEIGHTS, tokenizer_path

STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows of the documents and of what each stage keeps, written and read again in between."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [[tuple(r) for r in docs.select(COLUMNS).collect()]]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append([tuple(r) for r in (docs.select(COLUMNS) if k < 4 else docs).collect()])
    return out


def distance(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
    return round(math.sqrt(max((kl(p, q) + kl(q, p)) / 2, 0.0)), 9)


def brute_kept(text, lang):
    """The quality rules, counted one character and one word at a time."""
    text = text or ""
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    if len(words) < 10 or 100 * len(again) > 20 * len(words):
        return False
    if len(words) < quality.MIN_WORDS or lang not in quality.REFERENCES:
        return True
    kinds = [0] * 7
    for c in text:
        kinds[0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in ".,;:!?'\"()-" else 4 if c > "\x7f" else 5 if c in "\t\n\x0b\x0c\r " else 6] += 1
    plain = [w for w in regex.split(r"[^\p{L}]+", text.lower()) if w]
    common = [plain.count(w) for w in quality.COMMON_WORDS[lang]]
    of_kinds, of_words = quality.REFERENCES[lang]
    return distance(kinds, of_kinds) <= quality.MAX_CLASS_DISTANCE and distance([*common, len(plain) - sum(common)], of_words) <= quality.MAX_WORD_DISTANCE


def test_quality_stage(stages):
    expected = [r for r in stages[0] if brute_kept(r[1], r[2])]
    assert Counter(stages[1]) == Counter(expected) and 0 < len(expected) < len(stages[0])


def test_near_duplicate_stage(stages):
    size, percent = corpus_pipeline.NEAR_SHINGLE, corpus_pipeline.NEAR_PERCENT
    rows = stages[1]
    sets = []
    for r in rows:
        w = [x for x in regex.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in r[1] or "")) if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root = [root[a] if x == root[b] else x for x in root]
    first = {}
    for k, r in enumerate(rows):
        first[root[k]] = min(first.get(root[k], r), r)
    assert Counter(stages[2]) == Counter(first.values()) and len(first) < len(rows)


def test_decontamination_stage(spark, sf_dir, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    expected = []
    for doc_id, text, lang, source, _ in stages[2]:
        data = (text or "").encode()
        words = decontamination.words_of(data)
        hit, _ = brute_spans(words, items, corpus_pipeline.WINDOW)
        if len(hit) > corpus_pipeline.MAX_COVERAGE * len(words):
            continue
        places = [m.span() for m in regex.finditer(rb"[0-9A-Za-z\x80-\xff]+", data)]
        out, at = b"", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                out += data[at : places[k][0]]
            at = places[k][1]
        clean = (out + data[at:]).decode() if hit else text
        expected.append((doc_id, clean, lang, source, len(clean)))
    assert Counter(stages[3]) == Counter(expected)
    assert sum(len(r[1]) for r in stages[3]) < sum(len(r[1]) for r in stages[2])


def exact_budgets(tokens):
    """Budgets of the leaves as fractions: one water filling a level of the tree."""
    def down(path, budget):
        depth = len(path)
        if depth == 3:
            return {path: budget}
        names = {leaf[depth] for leaf in tokens if leaf[:depth] == path}
        capacity = {n: sum(v for leaf, v in tokens.items() if leaf[: depth + 1] == (*path, n)) * MIX_EPOCHS for n in names}
        weights = {n: MIX_WEIGHTS[("domain", "language", "source")[depth]].get(n, 1) for n in names}
        shares = water_fill(capacity, weights, budget)
        return {leaf: b for n in names for leaf, b in down((*path, n), shares[n]).items()}

    return down((), Fraction(sum(tokens.values()) * MIX_PERCENT // 100))


def test_mixing_stage(stages):
    def leaf(r):
        number = int(regex.search(r"[0-9]+$", r[3]).group())
        return ("web" if number % 5 == 0 else "books" if number % 5 < 3 else "forums", r[2], r[3])

    count = lambda r: len([w for w in regex.split(r"[\x20\x09-\x0D]+", r[1] or "") if w])
    tokens, taken = Counter(), Counter(stages[4])
    for r in stages[3]:
        tokens[leaf(r)] += count(r)
    assert set(taken) <= set(stages[3])
    for name, budget in exact_budgets(dict(tokens)).items():
        rows = [r for r in stages[3] if leaf(r) == name]
        whole = int(budget) // tokens[name]
        ranks = sorted(rows, key=lambda r: hashlib.md5(f"{MIX_SEED}:{whole}:{r[0]}".encode()).hexdigest())
        extra = [taken[r] - whole for r in ranks]
        if set(extra) - {0, 1}:  # the budget is rounded across a whole epoch
            assert abs(budget - round(budget / tokens[name]) * tokens[name]) <= 3 and len(set(extra)) == 1
            continue
        assert extra == sorted(extra, reverse=True)  # a prefix of the last epoch's order
        rest, upto = budget - whole * tokens[name], sum(map(count, ranks[: sum(extra)]))
        last = count(ranks[sum(extra) - 1]) if any(extra) else 0
        assert upto - last - 3 < rest <= upto + 3


def test_token_stage(stages):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer, start, expected = Tokenizer.from_file(path), 0, []
    for r in sorted(stages[4], key=lambda r: (r[0], zlib.crc32(r[1].encode()), r[1].encode())):
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1]
        expected.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(stages[5]) == sorted(expected)


def test_run_is_the_stages(spark, sf_dir, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(stages[5])


def test_stages_are_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "token output"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, sf_dir, name):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns called like the operators' own."""
    rows = [*ODD, *ODD[8:9], (11, None, None, None)]
    odd, none = frame(spark, rows), frame(spark, [])
    out = STAGE[name](spark, odd, sf_dir)
    assert STAGE[name](spark, none, sf_dir).count() == 0
    if name == "token output":
        assert out.count() == odd.count()
        return
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    kept = Counter(r.doc_id for r in out.collect())
    expected = {
        "quality rules": Counter(i for i, text, lang, _ in rows if brute_kept(text, lang)), "near duplicates": {1: 1, 2: 1, 3: 1, 5: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, None: 1},
        "decontamination": {1: 1, 2: 1, 3: 1, 5: 2, 6: 1, 7: 1, 8: 2, 9: 1, 10: 1, 11: 1, None: 1}, "mixing": {},
    }[name]
    if name != "mixing":
        assert kept == expected


def test_run_on_odd_and_empty_tables(spark, sf_dir, tmp_path):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    good = "the old miller walked to the river and counted nine grey geese before noon on a cold day"
    rows = [*ODD, (20, good, "en", "src0"), (21, good, "en", "src0"), (22, good + " again", None, None), (None, good.replace("nine", "ten"), "en", "src1")]
    for name, docs, bench in (("odd", frame(spark, rows), items), ("none", frame(spark, []), items), ("clean", frame(spark, rows), items.where("false"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(out) == (name != "none")
        assert {r.doc_id for r in out} <= {8, 20, 22, None}
