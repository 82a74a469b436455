"""Filter audit, clustering and language-model scores: brute force, odd inputs, and the parts they are made of."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tempolin.llm import clustering, elias_fano, filter_audit, language_model, word_scan

SCHEMA = "doc_id long, text string, lang string, source string, part string, mask int, digest string, n long, row string, held string, block string, words string"


def frame(spark, rows):
    """Documents with columns that are called like the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", "x", 1, "x", 2, "x", "x", "x", "x") for i, t, lang in rows], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def long_text(n=40_000):
    rng = random.Random(5)
    return " ".join("".join(rng.choice("abcdefghÉ") for _ in range(rng.randint(1, 6))) for _ in range(n))


WORDS = " ".join(f"w{k}" for k in range(120))
ODD = [
    (1, None, None), (2, "", "en"), (3, " \n\t\x0b ", "en"), (None, "no id", "en"), (None, WORDS, "fr"), (5, WORDS, "en"), (5, WORDS, "en"), (5, WORDS, "de"),
    (4, WORDS, "en"), (9, WORDS + " x", "en"), (10, WORDS + " #", "en"), (11, "A" * 50 + " b", "fr"), (12, long_text(), "fr"), (13, "Été \U0001f600 naïve", None),
    (14, "same " * 200, "en"), (15, WORDS.upper(), "en"), (16, "a b c", "en"), (17, WORDS, ""), (7, "", None), (18, "x" * 3_000_000, "xx"),
]
LABELS = [(1, 1, 0), (5, 1, 1), (5, 0, 0), (4, None, 1), (9, 1, None), (None, 1, 1), (14, 0, 1), (99, 1, 1)]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# --- filter audit -------------------------------------------------------------------


def brute_audit(docs, labels):
    least, good, toxic = {}, {}, {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, q, x in labels:
        if i is not None:
            good[i], toxic[i] = max(good.get(i, 0), q or 0), max(toxic.get(i, 0), x or 0)
    rows = []
    for i, t, lang in docs:
        t, w = t or "", words(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in least and least[t] < i}
        rows.append((lang or "", {k for k, v in fails.items() if v}, good.get(i) == 1, toxic.get(i) == 1))
    out, orders = {}, list(itertools.permutations("ABCDE"))
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], Counter()
        for order in orders:
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [r for r in mine if f in r[1] and not r[1] & before]
                total[f] += len(removed)
                out[part, "".join(order), step] = [
                    sum(not r[1] & before and f not in r[1] for r in mine), len(removed), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(total[order[step - 1]])
    return out


def test_audit_is_brute_force(spark):
    rows = filter_audit.audit(frame(spark, ODD), labels_of(spark, LABELS)).collect()
    told = {(r["part"], r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(rows) == len(told) == 600 * len({lang or "" for _, _, lang in ODD})
    assert told == brute_audit(ODD, LABELS)


def test_audit_of_empty_tables(spark):
    assert filter_audit.audit(frame(spark, []), labels_of(spark, LABELS)).collect() == []
    assert filter_audit.audit(frame(spark, ODD[:3]), labels_of(spark, [])).count() == 600 * 2


def test_different_words_are_counted_by_their_bytes(monkeypatch):
    texts = [b"a b a c", b"", b"x", b"aa a aa  aaa", long_text(3_000).encode(), b"\x00 \x00\x00 \x00"]
    places = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts, ends, before = word_scan.word_places(data, places)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [w for t in texts for w in t.split()]
    expected = [len(set(t.split())) for t in texts]
    assert filter_audit.distinct_words(data, starts, ends, before).tolist() == expected
    # with one hash for all words, or one for two, the bytes decide
    for bits in (0, 1):
        monkeypatch.setattr(filter_audit, "hash_words", lambda d, s, e: (d[s].astype(np.uint64) & np.uint64(bits)) << np.uint64(40))
        assert filter_audit.distinct_words(data, starts, ends, before).tolist() == expected


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    text = long_text(2_000).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    s, e, _ = word_scan.word_places(data, np.array([0, len(text)]))
    whole = word_scan.hash_words(data, s, e)
    monkeypatch.setattr(word_scan, "_SPAN", 11)
    assert (word_scan.hash_words(data, s, e) == whole).all()
    by_word = {}
    for h, a, b in zip(whole.tolist(), s, e):
        assert by_word.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_sliced_columns():
    column = pa.array([b"one", b"", b"two words", b"three"], pa.binary()).slice(1, 2)
    data, places = word_scan.column_bytes(column)
    assert data.tobytes() == b"two words" and places.tolist() == [0, 0, 9]


# --- clustering ---------------------------------------------------------------------


def brute_lloyd(rows, k, rounds, size, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else old for n, old in enumerate(centres)]
    done = [(i, *near(v)[::-1]) for i, v in kept]
    by = Counter()
    for _, c, d in done:
        by[c] += d
    return Counter((i, c, d, by[c], sum(by.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in done)


VECTOR = "vec_id long, embedding array<float>, label int, x string, cluster string"


@pytest.mark.parametrize("scale_up", [1.0, 1e4, 3e5])
def test_clusters_are_brute_force(spark, scale_up):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=3) * scale_up]) for i in range(60)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (70, None), (71, [1.0, 2.0]), (72, [1.0, None, 2.0]), (73, [1.0, float("nan"), 0.0]), (74, [float("inf"), 0.0, 0.0]), (75, [])]
    rows += [(200 + k, rows[7][1]) for k in range(40)]
    docs = spark.createDataFrame([(i, v, 0, "x", "c") for i, v in rows], VECTOR).repartition(5)
    for k, rounds in ((4, 3), (200, 2), (1, 0)):
        told = Counter(map(tuple, clustering.with_inertia(clustering.lloyd(docs, k, rounds, 3, 256, "2")).collect()))
        assert told == brute_lloyd(rows, k, rounds, 3, 256, "2")


def test_clusters_of_an_empty_table(spark):
    assert clustering.with_inertia(clustering.lloyd(spark.createDataFrame([], VECTOR), 4, 2, 3, 256, "2")).collect() == []


def test_distances_beyond_64_bits():
    far = np.array([[1 << 40, 0], [-(1 << 31), 5]], dtype=np.int64)
    with pytest.raises(OverflowError):
        clustering.nearest(far, np.array([[-(1 << 40), 0]]))
    best, distance = clustering.nearest(far[1:], np.array([[1 << 31, 0], [0, 0], [0, 0]]))
    assert best.tolist() == [1] and distance.tolist() == [(1 << 62) + 25]


# --- language model -----------------------------------------------------------------


def brute_scores(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*words((t or "").translate(lower)), ""] for _, t, _ in docs]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _, _ in docs]
    one = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    two = Counter(p for t, h in zip(tokens, held) if not h for p in zip(t, t[1:]))
    n, m = sum(one.values()), language_model.STRENGTH
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (len(one) + 1))
    out = []
    for (i, _, _), t, h in zip(docs, tokens, held):
        score = math.log10(p(t[0]))
        for v, w in zip(t, t[1:]):
            if two[v, w]:
                score += round(math.log10((two[v, w] + m * p(w)) / (one[v] + m)) / language_model.STEP) * language_model.STEP
            else:
                score += math.log10(m / (one[v] + m)) + math.log10(p(w))
        out.append((i, h, len(t), sum(one[w] > 0 for w in t), n, sum(math.log10(p(w)) for w in t), score))
    return out


def check_scores(told, expected):
    key = lambda r: (r[0] is None, r[0] or 0, *map(float, r[1:5]), round(r[5], 3))
    told, expected = sorted(map(tuple, told), key=key), sorted(expected, key=key)
    assert [r[:5] for r in told] == [r[:5] for r in expected]
    for a, b in zip(told, expected):
        assert abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and abs(a[6] - b[6]) < 1e-6 * max(1, abs(b[6]))


@pytest.mark.parametrize("shard_tokens,block_bytes", [(1 << 20, 8 << 20), (300, 2_000)])
def test_scores_are_brute_force(spark, monkeypatch, shard_tokens, block_bytes):
    """Small shards deal frequent contexts out, small blocks cut texts; neither changes a score."""
    monkeypatch.setattr(language_model, "BLOCK_BYTES", block_bytes)
    docs = [r for r in ODD if r[0] not in (12, 18)] + [(20 + k, f"the cat {k % 7} the Dog sat the " * (k % 5), "en") for k in range(60)] + [(100, long_text(900), "fr"), (101, "y" * 5_000 + " z", "fr")]
    # the driver's blocks are cut in the workers: hand the bound over with the function
    body = language_model._blocks

    def bounded(batches):
        language_model.BLOCK_BYTES = block_bytes
        yield from body(batches)

    monkeypatch.setattr(language_model, "_blocks", bounded)
    table = frame(spark, docs).repartition(3)
    model, scored = language_model.learn_and_score(table, language_model.held_out(), shard_tokens=shard_tokens)
    told = scored.collect()
    assert scored.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    check_scores(told, brute_scores(docs))
    # the levels serve other texts too
    again = language_model.score(table.where("doc_id = 100 or doc_id = 27"), model).collect()
    first = {r.doc_id: r.score for r in told}
    assert sorted(r.doc_id for r in again) == [27, 100] and all(abs(r.score - first[r.doc_id]) < 1e-6 for r in again)


def test_scores_of_empty_tables(spark):
    assert language_model.learn_and_score(frame(spark, []), language_model.held_out())[1].collect() == []
    held = [(i, "some text", "en") for i in range(40) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = language_model.learn_and_score(frame(spark, held), language_model.held_out())[1].collect()
    assert len(rows) == len(held) and all((r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0) for r in rows)


def test_held_out_texts_are_better_predicted_than_by_words_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = language_model.learn_and_score(docs, language_model.held_out())[1].where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 1 << 63), (5, 3), (9_000, 1 << 63), (9_000, 9_500), (4_096, 10**6), (8_193, 10**9), (12_288, 5)])
def test_elias_fano(tmp_path, n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    elias_fano.write_arrays(str(tmp_path / "a" / "b"), {**elias_fano.nested("x", elias_fano.encode(values)), "y": np.arange(3)})
    read = elias_fano.map_arrays(str(tmp_path / "a" / "b"))
    sequence = elias_fano.sequence(read, "x")
    assert read["y"].tolist() == [0, 1, 2] and len(sequence) == n and (sequence.at(np.arange(n)) == values).all()
    asked = np.sort(np.concatenate([rng.integers(0, top + 2, 2_000, dtype=np.uint64), values[:50]]))
    place, found = sequence.successor(asked)
    assert (place == np.searchsorted(values, asked)).all()
    assert (found[place < n] == values[place[place < n]]).all()
    assert elias_fano.map_arrays(str(tmp_path / "none")) == {}


def test_packing():
    for values in ([], [0], [255, 256], [1 << 63, 0, 7], list(range(70_000))):
        assert language_model.unpack(language_model.pack(np.array(values, dtype=np.uint64))).tolist() == values
    assert language_model.unpack_bytes(language_model.pack_bytes(b"")) == b"" and language_model.unpack_bytes(language_model.pack_bytes(b"ab" * 900)) == b"ab" * 900


def test_words_with_one_hash_stay_apart(monkeypatch):
    """Grouping and lookup compare bytes, so hashes may be poor."""
    names = [b"b", b"a", b"b", b"cc", b"a", b"", b"d"]
    data, begins, ends = language_model._lines(b"".join(n + b"\n" for n in names))
    poor = lambda d, s, e: (e - s).astype(np.uint64)
    number, one = language_model.group_words(data, begins, ends, poor(data, begins, ends))
    assert len({(n, k) for n, k in zip(names, number.tolist())}) == 5 == len(one)
    monkeypatch.setattr(language_model, "hash_words", poor)
    import tempfile

    path = f"{tempfile.mkdtemp(prefix='tempolin-')}/level"
    language_model.build_words(path, data, begins, ends, np.array([1, 2, 3, 4, 5, 6, 0]))
    asked, b, e = language_model._lines(b"a\nzz\nb\n\ncc\nd\n")
    number, count = language_model.find_words(elias_fano.map_arrays(path), asked, b, e)
    assert count.tolist() == [7, 0, 4, 6, 4, 0] and (number >= 0).tolist() == [True, False, True, True, True, True]
