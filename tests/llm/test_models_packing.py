"""Quality, toxicity and packing: held-out accuracy, exact ids, window invariants, edge cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexshoal.llm import packing, quality, toxicity


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        level = rng.normal()
        keys = np.arange(4, dtype=np.uint32)
        rows.append((keys, np.array([level, rng.normal(), 1, 0], np.float32)))
        grades.append(int(np.searchsorted([-0.7, 0.6], level + 0.2 * rng.normal())))
    index, value = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows])
    model = quality.fit_ordinal(index, value, np.arange(601) * 4, np.array(grades, float), bits=4, steps=400)
    scores = np.array([v @ model.weights[k] for k, v in rows])
    assert (np.diff(model.thresholds) > 0).all() and list(model.grades) == [0, 1, 2]
    expected = model.expected(scores)
    assert np.corrcoef(expected, grades)[0, 1] > 0.85
    assert (model.tail(scores, 1) >= model.tail(scores, 2)).all()
    assert (model.tail(scores, 0) == 1).all() and (model.tail(scores, 3) == 0).all()


def test_quality_separates_junk(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(120):
        good = i % 3 > 0
        body = " ".join(rng.choice(["the", "house", "tree", "runs", "far"]) + ("" if good else "$$$") for _ in range(60))
        docs.append((i, body, "x"))
        if i < 80:
            labels.append((i, int(good)))
    docs += [(200, None, "x"), (201, "", "x"), (202, "ab", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, keep_ string")
    model = quality.fit(frame, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int"), "quality")
    got = {r["doc_id"]: r for r in quality.score(frame, model).collect()}
    assert len(got) == len(docs)
    assert all(got[i]["keep"] == (i % 3 > 0) for i in range(80, 120))
    none = quality.fit(frame, spark.createDataFrame([], "doc_id long, quality int"), "quality")
    assert all(r["keep"] for r in quality.score(frame, none).collect())
    same = quality.fit(frame, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"), "quality")
    assert {r["expected_grade"] for r in quality.score(frame, same).collect()} == {1.0}
    assert quality.score(frame.where("false"), model).count() == 0


def test_buckets_skip_row_ends():
    flat = np.frombuffer(b"abcdefghij" * 10, np.uint8)
    at = np.array([0, 3, 10, 10, 60, 100])
    bucket, first = quality.gram_buckets(flat, at)
    assert np.diff(first).tolist() == [0, 4, 0, 47, 37] and len(bucket) == first[-1]
    alone, _ = quality.gram_buckets(flat[10:60], np.array([0, 50]))
    assert (bucket[first[3] : first[4]] == alone).all()


def brute_segments(scores):
    """Maximal scoring subsequences by their recursive definition."""
    def best(lo, hi):
        top = None
        for a in range(lo, hi):
            total = 0
            for b in range(a + 1, hi + 1):
                total += scores[b - 1]
                if total > 0 and (top is None or total > top[0] + 1e-9 or (abs(total - top[0]) <= 1e-9 and b - a < top[2] - top[1])):
                    top = (total, a, b)
        if top is None:
            return []
        return [*best(lo, top[1]), top[1:], *best(top[2], hi)]

    return best(0, len(scores))


def test_segments_match_their_definition():
    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.choice([-3.1, -1.3, -0.7, 0.9, 1.7, 2.3]) + rng.random() * 0.01 for _ in range(rng.randrange(0, 14))]
        got = toxicity.segments(scores)
        assert [(a, b) for a, b, _ in got] == brute_segments(scores)
        best = toxicity.best_segments(np.array(scores), np.array([0, len(scores)]))
        assert best[0] == pytest.approx(max([s for _, _, s in got], default=0))


def test_toxicity_finds_passages(spark):
    rng = random.Random(3)
    bad, docs, labels = ["foulword", "nastyword", "vileword"], [], []
    for i in range(500):
        body = ["w" + chr(97 + rng.randrange(26)) + chr(97 + rng.randrange(12)) for _ in range(80)]
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(70)
            body[at : at + 4] = [rng.choice(bad).title() + "," for _ in range(4)]
        docs.append((i, " ".join(body), "x"))
        labels.append((i, int(toxic)))
    docs += [(900, None, "x"), (901, "", "x"), (902, "123 !!", "x"), (None, "fine", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score_ string")
    model = toxicity.fit(frame, spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int"))
    rows = toxicity.score(frame, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 500 and r["held"]:
            assert (r["score"] >= 0.3) == (r["doc_id"] % 5 == 0)
            assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in (900, 901, 902):
            assert r["score"] < 0.3 and r["segments"] == []
    hit = next(r for r in rows if r["doc_id"] == 5)
    found = hit["text"].encode()[hit["segments"][0]["start"] : hit["segments"][0]["end"]].decode()
    assert found.lower().count("word") == 4
    blank = toxicity.fit(frame, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(frame, blank).collect()} == {0.5}
    assert toxicity.score(frame.where("false"), model).count() == 0


ODD = ["", "  ", "İstanbul ΑΣ ΑΣ. don't x's 'Tis", "áb é ñ̃ ﬁ", "<|endoftext|> a<|startoftext|>b <|x|>", "日本語 テキスト 123 4a5b $$$ !!", "ÀÉÜß. ÿ, ×÷ ª º", "tab\tsep\r\nnew\x0bline\x85nel em\xa0nb", "ſt K Å", "x" * 3000, "|", "...a", "æÆ ø Ø Þþ ð"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_equals_the_tokenizer():
    for cached in (5, 1000):
        encoder = packing.WordEncoder(packing.tokenizer_path(), cached)
        for _ in range(2):
            ids, first = encoder.encode(pa.array(ODD))
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == reference_ids(ODD)


def test_least_squares():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.random((8, 5)), rng.random(8)
        x = packing.nonnegative_least_squares(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope < 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-5


def test_packing_places_every_id_once(spark):
    rng = random.Random(6)
    texts = [*ODD, None, *(" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([3, 40, 300, 900, 5000]))) for _ in range(150))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "again", "x"), (None, "no id", "x")], "doc_id long, text string, length string")
    rows = packing.pack(docs, packing.tokenizer_path(), block_pieces=40).collect()
    ids = {i: [*x, 2] for i, x in enumerate(reference_ids([t or "" for t in texts]))}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i in range(1, len(texts)):
        own = sorted(by_doc[i], key=lambda r: r["start"])
        got = [x for r in own for x in np.frombuffer(r["ids"], "<u4").tolist()]
        assert got == ids[i] and [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert {r["doc_tokens"] for r in own} == {len(ids[i])}
    assert len(by_doc[0]) == 2 and len(by_doc[None]) == 1
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) <= 4096
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) * 4096 <= total * 1.02 + 8 * 4096
    assert packing.pack(docs.where("false"), packing.tokenizer_path()).count() == 0


def test_toxicity_counts_all_documents_of_different_words(spark):
    common = [a + b for a in "bcdfghjk" for b in ("aa", "ee", "ii", "oo", "uu")]
    sets = [(i, {*common, "own" + chr(97 + i // 26) + chr(97 + i % 26), *(["foul"] if i % 3 == 0 else [])}) for i in range(200)]
    docs = [(i, " ".join(sorted(words))) for i, words in sets]
    docs += [(1000 + i, " ".join([*sorted(words, reverse=True), "baa"])) for i, words in sets]  # copies in another order
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame([(i, int(i % 1000 % 3 == 0)) for i, _ in docs], "doc_id long, toxic int"))
    used = {i % 1000 for i, _ in docs if zlib.crc32(str(i).encode()) % 4 != 2}
    counts = np.zeros((2, 1 << toxicity.BITS))
    for i, words in sets:
        if i in used:
            flat = np.frombuffer(" ".join(sorted(words)).encode(), np.uint8)
            digests = toxicity.words(flat, np.array([0, len(flat)]), toxicity.LETTER)[0]
            counts[int(i % 3 == 0), np.unique(toxicity.buckets(digests))] += 1
    assert model.scores == pytest.approx(toxicity.log_odds(counts[1], counts[0]) - toxicity.DRIFT, abs=1e-5)


def some_tokenizers():
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    cased = Tokenizer(models.WordLevel({"a": 0, "b": 1, "[UNK]": 2, "A": 3}, unk_token="[UNK]"))
    cased.pre_tokenizer = pre_tokenizers.Whitespace()
    bare = Tokenizer(models.BPE({c: i for i, c in enumerate("ab A")} | {"ab": 4, "b A": 5}, [("a", "b")]))
    pieces = Tokenizer(models.Unigram([("<unk>", 0.0), ("▁", -2.0), ("a", -3.0), ("b", -3.0), ("▁ab", -2.5), ("A", -4.0)], unk_id=0))
    pieces.pre_tokenizer = pre_tokenizers.Metaspace()
    lowered = Tokenizer(models.WordLevel({"a": 0, "a b": 1, "[UNK]": 2}, unk_token="[UNK]"))
    lowered.normalizer = normalizers.Lowercase()
    return {"cased": cased, "bare": bare, "pieces": pieces, "lowered": lowered}


@pytest.mark.parametrize("name", ["cased", "bare", "pieces", "lowered"])
def test_other_tokenizers_take_the_whole_path(tmp_path, name):
    tokenizer = some_tokenizers()[name]
    tokenizer.save(f"{tmp_path}/t.json")
    encoder = packing.WordEncoder(f"{tmp_path}/t.json")
    assert not encoder.by_words
    texts = ["A b a", "ab  AB\nab", "", "a b", "abA ba"]
    flat, first = encoder.encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_changed_part_turns_words_off():
    import json

    with open(packing.tokenizer_path(), encoding="utf-8") as file:
        parts = json.load(file)
    assert packing.goes_by_words(parts)
    for key, value in {"normalizer": None, "pre_tokenizer": None, "truncation": {"max_length": 8}, "padding": {"length": 8}}.items():
        assert not packing.goes_by_words(parts | {key: value})
    assert not packing.goes_by_words(parts | {"model": parts["model"] | {"ignore_merges": True}})
    assert not packing.goes_by_words(parts | {"added_tokens": [parts["added_tokens"][0] | {"content": "new york"}]})
    assert not packing.goes_by_words(parts | {"added_tokens": [parts["added_tokens"][0] | {"lstrip": True}]})


def slow_quality(texts, ratings, steps=120, rate=0.1, penalty=1e-4):
    """The ordinal model with a dictionary for each document and one sum at a time: expected grade and tail of every text."""

    def features(text):
        data = (text or "").encode()
        grams = [int.from_bytes(data[i : i + 4], "little") for i in range(len(data) - 3)]
        counts = collections.Counter((g * 0x9E3779B1 & 0xFFFFFFFF) >> 14 for g in grams)
        return {k: 100.0 * c / len(grams) for k, c in counts.items()}

    sigmoid = lambda x: 0.0 if x == -math.inf else 1.0 if x == math.inf else 1 / (1 + math.exp(-x))
    grades = sorted(set(ratings.values()))
    rows = [(features(texts[i]), grades.index(g)) for i, g in ratings.items()]
    n, k = len(rows), len(grades) - 1
    share = [sum(g <= j for _, g in rows) / n for j in range(k)]
    cut = [math.log(s / (1 - s)) for s in share]
    p = {f: 0.0 for x, _ in rows for f in x} | {("t", j): cut[0] if not j else math.log(max(cut[j] - cut[j - 1], 1e-3)) for j in range(k)}
    m, v = dict.fromkeys(p, 0.0), dict.fromkeys(p, 0.0)

    def edges():
        out = [p["t", 0]]
        for j in range(1, k):
            out.append(out[-1] + math.exp(p["t", j]))
        return [-math.inf, *out, math.inf]

    for t in range(1, steps + 1):
        gradient = {f: penalty * x if not isinstance(f, tuple) else 0.0 for f, x in p.items()}
        e, by_edge = edges(), [0.0] * (k + 2)
        for x, g in rows:
            s = sum(p[f] * c for f, c in x.items())
            high, low = sigmoid(e[g + 1] - s), sigmoid(e[g] - s)
            mass = max(high - low, 1e-9)
            by_edge[g + 1] -= high * (1 - high) / mass / n
            by_edge[g] += low * (1 - low) / mass / n
            for f, c in x.items():
                gradient[f] += c * (high * (1 - high) - low * (1 - low)) / mass / n
        for j in range(k):
            gradient["t", j] = sum(by_edge[j + 1 : k + 1]) * (1 if not j else math.exp(p["t", j]))
        for f, d in gradient.items():
            m[f], v[f] = 0.9 * m[f] + 0.1 * d, 0.999 * v[f] + 0.001 * d * d
            p[f] -= rate * (m[f] / (1 - 0.9**t)) / (math.sqrt(v[f] / (1 - 0.999**t)) + 1e-8)
    out = {}
    for i, text in texts.items():
        s = sum(p.get(f, 0.0) * c for f, c in features(text).items())
        above = [1 - sigmoid(x - s) for x in edges()[1:-1]]
        out[i] = (grades[0] + sum(a * (grades[j + 1] - grades[j]) for j, a in enumerate(above)), next((above[j] for j in range(k) if grades[j + 1] >= 1), 1.0))
    return out


@pytest.mark.parametrize("grades", [2, 3])
def test_quality_against_plain_sums(spark, tmp_path, grades):
    """The query on a small table, and the same model with three grades: what a slow version of it gives."""
    rng = random.Random(grades)
    texts = {i: " ".join(rng.choice(["fine", "words", "junk", "$$$", "é"][i % grades : i % grades + 3]) for _ in range(rng.randrange(1, 40))) for i in range(45)} | {50: None, 51: "", 52: "abc"}
    ratings = {i: i % grades for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, g, 0) for i, g in ratings.items()], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = quality.op6_quality(spark, str(tmp_path)).collect()
    want = slow_quality(texts, ratings)
    for r in rows:
        assert (r["expected_grade"], r["tail_probability"]) == pytest.approx(want[r["doc_id"]], abs=2e-3)


def slow_toxicity(texts, labels):
    """The whole model word by word: {doc: (score, number of significant segments)}."""

    def words_of(text):
        return [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())]  # bytes: only A-Z change

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    train = [(words_of(texts[i]), y) for i, y in labels if i in texts and y is not None and not held(i)]
    counts = collections.Counter()
    for own, y in {(frozenset(w), y) for w, y in train}:
        counts.update((w, y) for w in own)
    vocabulary = {w for w, _ in counts}
    total = {y: sum(c for (_, z), c in counts.items() if z == y) for y in (0, 1)}
    a0 = toxicity.PRIOR * (total[0] + total[1] + 0.01 * (1 << toxicity.BITS))
    score = {}
    for w in vocabulary:
        t, o = counts[w, 1], counts[w, 0]
        a = toxicity.PRIOR * (t + o + 0.01)
        delta = math.log((t + a) / (total[1] + a0 - t - a)) - math.log((o + a) / (total[0] + a0 - o - a))
        spread = toxicity.BOUND * math.sqrt(1 / (t + a) + 1 / (o + a))
        score[w] = math.copysign(max(abs(delta) - spread, 0), delta) - toxicity.DRIFT
    of = lambda own: [score.get(w, -toxicity.DRIFT) for w in own]
    mean = lambda r: sum(counts[w, 0] / total[0] * math.exp(r * score[w]) for w in vocabulary) - 1
    low, high = 1e-6, 64.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 0 else (low, middle)
    rate = high if any(score[w] > 0 and counts[w, 0] for w in vocabulary) else 1.0

    def best(s):
        """The best run (score, start, end) by its running sum."""
        top, at, run, start = 0.0, (0, 0), 0.0, 0
        for i, x in enumerate(s):
            if run <= 0:
                run, start = 0.0, i
            run += x
            if run > top:
                top, at = run, (start, i + 1)
        return top, *at

    def maximal(s):
        """The best run, and those of what lies on both sides of it."""
        top, a, b = best(s)
        return [] if top <= 0 else [*maximal(s[:a]), top, *maximal(s[b:])]

    clean = [w for w, y in train if not y and w]
    k = len(clean) / sum(len(w) * math.exp(-rate * best(of(w))[0]) for w in clean)

    def features(own):
        s = of(own)
        expected = lambda x: k * max(len(s), 1) * math.exp(-rate * x)
        top = best(s)[0]
        first = min(-math.log(max(-math.expm1(-expected(top)), 1e-300)), 40) if top > 0 else 0.0
        strong = [x for x in maximal(s) if expected(x) <= toxicity.SIGNIFICANT]
        return [1.0, first, min(sum(rate * x for x in strong) / 4, 40)], len(strong)

    x, y = np.array([features(w)[0] for w, _ in train]), np.array([y for _, y in train], float)
    weights = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ weights)))
        hessian = sum(q * (1 - q) * np.outer(r, r) for q, r in zip(p, x, strict=True)) + 1e-2 * np.eye(3)
        weights += np.linalg.solve(hessian, sum((z - q) * r for z, q, r in zip(y, p, x, strict=True)) - 1e-2 * weights)
    weights[1:] = np.maximum(weights[1:], 0)
    out = {}
    for i, text in texts.items():
        own, n = features(words_of(text))
        out[i] = (1 / (1 + math.exp(-float(np.dot(weights, own)))), n)
    return out


@pytest.mark.parametrize("common", [True, False])
def test_toxicity_against_word_by_word(spark, tmp_path, common):
    """The query on 200 rows: what a slow version of the whole model gives."""
    rng = random.Random(8)
    mild, vile = [f"word{chr(97 + i)}" for i in range(20)] + ["Été", "naïve"], ["vileA", "nastyB", "awfulÇ"]
    texts = {}
    for i in range(200):
        own = [rng.choice(mild) for _ in range(rng.randrange(5, 60))]
        if i % 4 == 0:
            at = rng.randrange(len(own))
            own[at:at] = [rng.choice(vile) for _ in range(rng.randrange(3, 9))]
        elif i % 9 == 0 and common:
            own.append(vile[i % 3])
        texts[i] = " ".join(own)
    texts |= {200: None, 201: "", 202: "!!! 123"}
    labels = [(i, int(i % 4 == 0)) for i in range(170)] + [(3, 0), (999, 1)]
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    want = slow_toxicity(texts, labels)
    assert len(rows) == len(texts) and max(n for _, n in want.values()) >= 1
    for r in rows:
        score, n = want[r["doc_id"]]
        assert r["score"] == pytest.approx(score, abs=2e-3) and r["n_segments"] == n
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3)
