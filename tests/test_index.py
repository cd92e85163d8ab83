"""Golden values, brute-force parity and round trips of the n-gram engine."""

import collections
import hashlib
import random
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from lexshoal import storage
from lexshoal.index import NgramIndex
from lexshoal.operators import corpus as corpora
from lexshoal.operators import lookup, ngrams, orders, prefix, smoothing, suffix
from lexshoal.operators.prefix import cumulative
from lexshoal.sources import binary, texts


def ids(text):
    return [ord(c) - ord("a") for c in text]


@pytest.fixture(scope="module")
def golden_a(spark):
    return NgramIndex.from_tokens(spark, ids("aabbccabccba"), vocab=3).persist()


@pytest.fixture(scope="module")
def golden_c(spark):
    return NgramIndex.sharded(*(NgramIndex.from_tokens(spark, ids(t), vocab=3) for t in ("abcab", "abcca"))).persist()


def test_suffix_table(golden_a):
    rows = golden_a.suffix_table().orderBy("rank").collect()
    assert [r["pos"] for r in rows] == [11, 0, 1, 6, 10, 2, 3, 7, 5, 9, 4, 8]
    assert golden_a.is_sorted()
    assert golden_a.suffix(4).first()["tokens"] == ids("ba")


def test_wrong_suffix_tables_are_found(spark, golden_a):
    right = [11, 0, 1, 6, 10, 2, 3, 7, 5, 9, 4, 8]
    for wrong in (right[1:] + right[:1], right[:-1], [11, 11, *right[2:]], [*right[:10], right[11], right[10]]):
        table = spark.createDataFrame([(0, i, p) for i, p in enumerate(wrong)], "shard int, rank long, pos long")
        assert not suffix.is_sorted(golden_a.corpus, table).first()["is_sorted"]


@pytest.mark.parametrize(
    ("text", "query", "found"),
    [("a", "b", []), ("a", "a", [0]), ("ab", "b", [1]), ("aa", "a", [1, 0]), ("zzzzzaazzzzz", "a", [5, 6]), ("zzzzabczzzzzabczzzzzz", "abc", [4, 12]), ("az", "mnomnomnomnomnomnomno", []), ("a", "", [])],
)
def test_positions(spark, text, query, found):
    index = NgramIndex.from_tokens(spark, [ord(c) for c in text])
    query = [ord(c) for c in query]
    assert index.positions(query) == found
    assert index.contains(query) == bool(found)
    assert index.count(query) == len(found)


def test_empty_corpus(spark):
    index = NgramIndex.from_tokens(spark, [], vocab=3)
    assert len(index) == 0
    assert not index.contains([1]) and index.count([1]) == 0 and index.positions([1]) == []
    assert index.count_next([]) == [0, 0, 0]
    assert index.is_sorted()
    assert index.get_smoothed_probs([1]) == pytest.approx([1 / 3] * 3)


def test_next_counts(golden_a):
    queries = ["", "a", "b", "c", "bc", "cc", "ba", "cba", "a"]
    want = [[4, 4, 4], [1, 2, 0], [1, 1, 2], [1, 1, 2], [0, 0, 2], [1, 1, 0], [0, 0, 0], [0, 0, 0], [1, 2, 0]]
    assert golden_a.batch_count_next([ids(q) for q in queries]) == want
    assert [golden_a.count(ids(q)) for q in ("bc", "ba")] == [2, 1]


def test_frequencies(golden_a, golden_c):
    assert golden_a.count_ngrams(1) == {4: 3} and golden_a.count_ngrams(2) == {1: 5, 2: 3} and golden_a.count_ngrams(4) == {1: 9}
    assert golden_a.count_ngrams(0) == {4: 3}
    assert golden_a.count_all_ngrams(4) == {n: golden_a.count_ngrams(n) for n in (1, 2, 3, 4)}
    assert golden_c.count_ngrams(1) == {1: 2, 2: 4} and golden_c.count_ngrams(2) == {1: 6, 2: 1}
    assert golden_c.count_ngrams(2, merge_shards=True) == {1: 2, 2: 2} | golden_c.count_ngrams(2, merge_shards=True)
    assert golden_c.count(ids("ba")) == 0 and golden_c.count_next(ids("ca")) == [0, 1, 0]


def test_smoothing(spark):
    index = NgramIndex.from_tokens(spark, ids("aabbccabccba"), vocab=3)
    want = {"": [1 / 3] * 3, "a": [0.277777778, 0.611111111, 0.111111111], "bc": [0.0625, 0.0625, 0.875], "cc": [0.375, 0.375, 0.25], "cba": [0.277777778, 0.611111111, 0.111111111]}
    got = index.batch_get_smoothed_probs([ids(q) for q in want])
    for g, w in zip(got, want.values(), strict=True):
        assert g == pytest.approx(w, abs=1e-8)
    index.estimate_deltas(3)
    assert index.model.known == pytest.approx({1: 1.0, 2: 5 / 11, 3: 0.8})
    assert index.get_smoothed_probs(ids("bc")) == pytest.approx([0.1, 0.1, 0.8], abs=1e-8)
    assert index.get_smoothed_probs(ids("cba")) == pytest.approx([0.282828283, 0.616161616, 0.101010101], abs=1e-8)


def test_smoothing_beyond_one(spark):
    index = NgramIndex.from_tokens(spark, ids("aaaaaaaabc"), vocab=3)
    assert index.batch_get_smoothed_probs([[], [1], [0]]) == [pytest.approx(x, abs=1e-7) for x in ([2.38, 0.21, 0.21], [1.19, 0.105, 0.605], [1.11, 0.08875, 0.02625])]
    assert sum(index.get_smoothed_probs([1], normalize=True)) == pytest.approx(1)


def test_sharded_smoothing(spark):
    index = NgramIndex.sharded(*(NgramIndex.from_tokens(spark, ids(t), vocab=3) for t in ("abcab", "abcca")))
    assert index.get_smoothed_probs(ids("ca")) == pytest.approx([0.033666667, 0.9415, 0.024833333], abs=1e-8)
    index.estimate_deltas(2)
    assert index.model.known == pytest.approx({1: 0.2, 2: 0.75})
    assert index.get_smoothed_probs(ids("c")) == pytest.approx([0.618666667, 0.149, 0.232333333], abs=1e-8)


def test_sampling(spark):
    one = NgramIndex.from_tokens(spark, ids("aaaa"), vocab=3)
    assert one.sample_unsmoothed([0], 3, 10, 2) == [[0] * 11] * 2
    index = NgramIndex.from_tokens(spark, ids("aabbccabccba"), vocab=3)
    a = index.sample_unsmoothed([], 2, 6, 8, seed=3)
    assert a == index.sample_unsmoothed([], 2, 6, 8, seed=3)
    seen = set(zip(ids("aabbccabccba"), ids("aabbccabccba")[1:], strict=False))
    assert all(len(s) == 6 and set(zip(s, s[1:], strict=False)) <= seen for s in a)
    smooth = index.sample_smoothed([0], 3, 4, 3)
    assert all(len(s) == 5 and s[0] == 0 for s in smooth)
    with pytest.raises(Exception, match="successors"):
        NgramIndex.from_tokens(spark, ids("ab"), vocab=3).sample_unsmoothed([1], 2, 1)
    with pytest.raises(ValueError, match="at least 1"):
        one.sample_unsmoothed([0], 0, 1)


def test_widths(spark):
    index = NgramIndex.from_tokens(spark, [1, 2, 65536 + 3])
    assert index.count([1, 70000, 2]) == 1 and index.contains([3])
    wide = NgramIndex.from_tokens(spark, [1, 2, 65536 + 3], vocab=1 << 17)
    assert wide.contains([65539]) and not wide.contains([3])
    with pytest.raises(Exception, match="width"):
        lookup.fitted(index.corpus, index.queries([[70000]]), strict=True).collect()


def brute(tokens, query):
    m = len(query)
    return [p for p in range(len(tokens) - m + 1) if m and tokens[p : p + m] == query]


def test_chunks_match_brute_force(spark):
    rng = random.Random(5)
    for vocab in (2, 5):
        tokens = [rng.randrange(vocab) for _ in range(120)]
        flat = spark.createDataFrame([(0, p, t) for p, t in enumerate(tokens)], "shard int, pos long, token long").repartition(3)
        index = NgramIndex(corpora.chunked(flat, longest=5, vocab=vocab, chunk=3), vocab)
        queries = [tokens[p : p + m] for m in (1, 2, 3) for p in (0, 50, 118)] + [[0, 1, 0], [1] * 4]
        frame = index.queries(queries)
        got = collections.defaultdict(list)
        for r in lookup.positions(index.corpus, frame).collect():
            got[r["query_id"]].append(r["pos"])
        assert [sorted(got[i]) for i in range(len(queries))] == [brute(tokens, q) for q in queries]
        suffixes = [r["pos"] for r in index.suffix_table().orderBy("rank").collect()]
        assert suffixes == sorted(range(len(tokens)), key=lambda p: tokens[p:])
        want = collections.Counter(collections.Counter(tuple(tokens[p : p + 3]) for p in range(len(tokens) - 2)).values())
        assert index.count_ngrams(3) == dict(want)
        long = collections.Counter(collections.Counter(tuple(tokens[p : p + 9]) for p in range(len(tokens) - 8)).values())
        assert index.count_ngrams(9) == dict(long)


def test_files(spark, tmp_path):
    tokens = [5, 1, 5, 1, 2, 65535, 5]
    index = NgramIndex.from_tokens(spark, tokens)
    index.save_tokens(str(tmp_path / "t.bin"))
    assert (tmp_path / "t.bin").stat().st_size == 2 * len(tokens)
    built = NgramIndex.build(spark, [(str(tmp_path / "t.bin"), str(tmp_path / "t.idx"))])
    assert (tmp_path / "t.idx").stat().st_size == 8 * len(tokens)
    assert built.positions([5]) == index.positions([5])
    for limit in (0, 1, 4, 99):
        assert len(NgramIndex.from_token_file(spark, str(tmp_path / "t.bin"), limit)) == min(limit, len(tokens))
    again = NgramIndex.from_files(spark, [(str(tmp_path / "t.bin"), str(tmp_path / "t.idx"))])
    assert again.is_sorted()
    index.save(str(tmp_path / "parquet"))
    assert NgramIndex.load(spark, str(tmp_path / "parquet")).count([5, 1]) == 2
    (tmp_path / "bad.idx").write_bytes((tmp_path / "t.idx").read_bytes()[::-1])
    with pytest.raises(Exception, match="sorted"):
        NgramIndex.from_files(spark, [(str(tmp_path / "t.bin"), str(tmp_path / "bad.idx"))])
    (tmp_path / "odd.bin").write_bytes(b"\1\0\2")
    assert len(NgramIndex.from_token_file(spark, str(tmp_path / "odd.bin"))) == 1
    with pytest.raises(Exception, match="multiple"):
        binary.read_tokens(spark, str(tmp_path / "odd.bin"), strict=True).collect()


def test_texts(spark, tmp_path):
    class Letters:
        eos_token_id, vocab_size = 0, 27

        def encode_batch(self, batch):
            return [[ord(c) - 96 for c in x] for x in batch]

    docs = spark.createDataFrame([(2, "cab"), (1, "ab"), (3, None)], "id long, text string")
    texts.tokenize_to_file(docs, Letters(), str(tmp_path / "x.bin"), ["id"], append_end=True)
    assert [r["token"] for r in binary.read_tokens(spark, str(tmp_path / "x.bin")).orderBy("pos").collect()] == [1, 2, 0, 3, 1, 2, 0, 0]
    both = texts.concatenated({"train": docs, "test": docs})
    assert both.count() == 6 and texts.vocab_size(Letters()) == 27
    with pytest.raises(ValueError, match="dataset"):
        texts.concatenated([docs])


def test_perplexity(spark):
    index = NgramIndex.from_tokens(spark, ids("aabbccabccba"), vocab=3)
    rows = spark.createDataFrame([(0, ids("ab"))], "seq long, tokens array<long>")
    want = (1 / (1 / 3 * 0.611111111)) ** 0.5
    assert index.perplexity(rows, 2).first()["perplexity"] == pytest.approx(want, rel=1e-6)


def test_streamed_counts(spark, tmp_path):
    from lexshoal.streaming.counts import streaming_ngram_counts

    docs = spark.createDataFrame([(1, "a b a b"), (2, "a b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = streaming_ngram_counts(source, 2).writeStream.outputMode("complete").format("memory").queryName("bigrams").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["g0"], r["g1"]): r["count"] for r in spark.table("bigrams").collect()} == {("a", "b"): 3, ("b", "a"): 1}


def test_events(spark):
    rows = spark.createDataFrame([(1, 3, "x"), (1, 1, "y"), (2, 1, "x"), (1, 2, "x")], "user long, at long, kind string")
    corpus = corpora.from_events(rows, "kind", "user", ["at"])
    got = {tuple(r["query"]): r["count"] for r in lookup.next_counts(corpus, spark.createDataFrame([(["x"],), (["y"],)], "query array<string>")).collect()}
    assert got == {("x",): 1, ("y",): 1}
    assert corpus.limit_tokens(1).size() == 2
    probs = smoothing.unigram_probs(corpus, 2).orderBy("token").collect()
    assert probs[0]["prob"] == pytest.approx(0.75)
    assert corpora.vocabulary(corpus).agg(F.sum("count")).first()[0] == 4


def test_raw_files_are_written_in_parallel(spark, tmp_path):
    rng = random.Random(8)
    values = [rng.randrange(1 << 16) for _ in range(5000)]
    rows = list(enumerate(values))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "pos long, token int").repartition(7)
    path = str(tmp_path / "tokens")
    binary.write_numbers(frame, "pos", "token", f"file://{path}", 16)
    assert [r["token"] for r in binary.read_tokens(spark, path, strict=True).orderBy("pos").collect()] == values
    binary.write_numbers(frame.where("pos < 3"), "pos", "token", path, 16)  # an older file is replaced
    assert binary.read_tokens(spark, path).count() == 3
    binary.write_numbers(frame.where("false"), "pos", "token", path, 16)
    assert binary.read_tokens(spark, path).count() == 0
    for wrong in (frame.where("pos <> 7"), frame.unionByName(frame.where("pos = 7")), frame.withColumn("pos", F.col("pos") + 1)):
        with pytest.raises(ValueError, match="numbered"):
            binary.write_numbers(wrong, "pos", "token", path, 16)


def _mounted(spark, folder):
    """A folder under a scheme that only Hadoop's file systems know."""
    name = f"raw{uuid.uuid4().hex}"  # Hadoop keeps the file system of a name as it is first opened
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{folder}")
    return f"viewfs://{name}/in"


@pytest.mark.parametrize("bits", [16, 32, 64])
def test_folders_of_raw_parts(spark, tmp_path, bits):
    rng = random.Random(bits)
    values = [rng.randrange(1 << min(bits, 62)) for _ in range(3001)]
    frame = spark.createDataFrame(list(enumerate(values)), "pos long, token long").repartition(5)
    binary.write_numbers(frame, "pos", "token", f"file://{tmp_path}/parts", bits, parts=True, part_bytes=1000)
    names = sorted(f.name for f in (tmp_path / "parts").iterdir())
    assert names[0] == "_SUCCESS" and names[1:] == [f"part-{a:020d}" for a in range(0, 3001, 8000 // bits)]
    raw = b"".join((tmp_path / "parts" / x).read_bytes() for x in names[1:])
    assert raw == b"".join(v.to_bytes(bits // 8, "little") for v in values)
    want = list(enumerate(values))
    for path in (str(tmp_path / "parts"), f"{_mounted(spark, tmp_path)}/parts"):
        got = binary.read_numbers(spark, path, bits, strict=True)
        assert sorted((r["pos"], r["value"]) for r in got.collect()) == want
        assert sorted((r["pos"], r["value"]) for r in binary.read_numbers(spark, path, bits, limit=700).collect()) == want[:700]
    with pytest.raises(ValueError, match="exists"):
        binary.write_numbers(frame, "pos", "token", str(tmp_path / "parts"), bits, parts=True)
    (tmp_path / "parts" / names[2]).unlink()
    with pytest.raises(ValueError, match="all numbers"):
        binary.read_numbers(spark, str(tmp_path / "parts"), bits, strict=True)
    (tmp_path / "parts" / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="whole folder"):
        binary.read_numbers(spark, str(tmp_path / "parts"), bits)
    binary.write_numbers(frame.where("false"), "pos", "token", str(tmp_path / "none"), bits, parts=True)
    assert binary.read_numbers(spark, str(tmp_path / "none"), bits, strict=True).count() == 0


def test_files_that_only_spark_can_open(spark, tmp_path):
    root = _mounted(spark, tmp_path)
    for name, n in (("many", 6000), ("prime", 61), ("none", 0)):
        values = [i * 7 % 65536 for i in range(n)]
        (tmp_path / name).write_bytes(b"".join(v.to_bytes(2, "little") for v in values))
        want = list(enumerate(values))
        small = binary.read_numbers(spark, f"{root}/{name}", 16, strict=True).collect()
        assert sorted((r["pos"], r["value"]) for r in small) == want
        by_records = binary._read_by_spark(spark, f"{root}/{name}", 16, None, True, part_bytes=100).collect()
        assert sorted((r["pos"], r["value"]) for r in by_records) == want
    (tmp_path / "odd").write_bytes(b"\1\0\2")
    assert [tuple(r) for r in binary.read_numbers(spark, f"{root}/odd", 16).collect()] == [(0, 1)]
    for part_bytes in (2, 100):
        with pytest.raises(ValueError, match="multiple"):
            binary._read_by_spark(spark, f"{root}/odd", 16, None, True, part_bytes=part_bytes)


def test_index_from_a_folder_of_parts(spark, tmp_path):
    index = NgramIndex.from_tokens(spark, [5, 1, 5, 1, 2, 65535], vocab=1 << 16)
    index.save_tokens(str(tmp_path / "t"), parts=True)
    index.save_suffixes(str(tmp_path / "s"), parts=True)
    root = _mounted(spark, tmp_path)
    again = NgramIndex.from_files(spark, [(f"{root}/t", f"{root}/s")])
    assert again.is_sorted() and again.count([5, 1]) == 2 and len(NgramIndex.from_token_file(spark, f"{root}/t", token_limit=4)) == 4


def test_rank_listing(golden_a):
    rows = golden_a.listing(3, 6, width=3).orderBy("rank").collect()
    assert [(r["rank"], r["pos"], r["tokens"]) for r in rows] == [(3, 6, ids("abc")), (4, 10, ids("ba")), (5, 2, ids("bbc"))]


def test_suffix_ranks_of_runs_in_shards(spark):
    """Ties go on for many rounds; shards are ranked apart."""
    shards_ = [[0] * 150, [1, 0] * 80 + [2], [3], list(range(40)) * 4]
    index = NgramIndex.sharded(*(NgramIndex.from_tokens(spark, s, vocab=50) for s in shards_))
    got = collections.defaultdict(list)
    for r in index.suffix_table().orderBy("shard", "rank").collect():
        assert r["rank"] == len(got[r["shard"]])
        got[r["shard"]].append(r["pos"])
    assert got == {i: sorted(range(len(s)), key=lambda p, s=s: s[p:]) for i, s in enumerate(shards_)}


def test_scratch_deletes_inner_tables(spark):
    before = len(storage._tables())
    with storage.scratch(spark, "kept"):
        inner = storage.materialize(spark.range(5), "inner")
        kept = storage.materialize(inner, "kept")
    assert kept.count() == 5 and len(storage._tables()) == before + 1
    with pytest.raises(Exception, match="(?i)not exist|no such file|FILE_NOT_EXIST|FAILED_READ_FILE"):
        spark.read.schema("id long").parquet(inner.inputFiles()[0]).count()


def test_probabilities_of_pairs(golden_a, spark):
    """Only the pairs that are asked for, and equal to the dense result."""
    dense = golden_a.batch_get_smoothed_probs([ids(q) for q in ("a", "bc", "", "cba")])
    asked = [(q, t) for q in ("a", "bc", "", "cba") for t in (0, 2)] + [("a", 0)]
    pairs = spark.createDataFrame([(ids(q), t) for q, t in asked], "query array<long>, token long")
    rows = smoothing.pair_probs(golden_a.model, pairs).collect()
    assert len(rows) == 8
    for r in rows:
        i = [ids(q) for q in ("a", "bc", "", "cba")].index(r["query"])
        assert r["prob"] == pytest.approx(dense[i][r["token"]], abs=1e-12)


def test_running_sums_by_key(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, rng.randrange(10)) for i in range(400)]
    frame = spark.createDataFrame(rows, "k int, o int, v long").repartition(5)
    got = {r["o"]: (r["before"], r["whole"]) for r in cumulative(frame, "k", "o", "v", "before", "whole").collect()}
    assert got == {o: (sum(w for a, p, w in rows if a == k and p < o), sum(w for a, _, w in rows if a == k)) for k, o, _ in rows}


def test_long_event_sequences_are_cut(spark):
    """One user with most events: chunks give what whole rows give."""
    rng = random.Random(6)
    rows = [(u, t, rng.choice("abc")) for u, n in ((1, 500), (2, 7), (3, 1)) for t in range(n)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "user long, at int, kind string")
    whole, cut = (corpora.from_events(frame, "kind", "user", ["at"], longest=4, whole=w) for w in (1000, 100))
    assert whole.reach is None and cut.reach == 3
    key = lambda r: (r["seq"], r["pos"])
    assert sorted(map(tuple, whole.flat().collect())) == sorted(map(tuple, cut.flat().collect()))
    for n in (1, 3, 4, 7):
        assert sorted(ngrams.ngrams(whole, n).collect(), key=key) == sorted(ngrams.ngrams(cut, n).collect(), key=key)
    small = corpora.chunked(cut.flat(), 4, chunk=16)
    assert sorted(ngrams.ngrams(whole, 4).collect(), key=key) == sorted(ngrams.ngrams(small, 4).collect(), key=key)


def test_terms_are_observed_successors(spark):
    """No row stands for a token that never follows a context, and none for the empty context."""
    rng = random.Random(12)
    tokens = [rng.randrange(400) for _ in range(1500)]
    index = NgramIndex.from_tokens(spark, tokens, vocab=400)
    contexts = [[t] for t in range(60)] + [tokens[p : p + 2] for p in range(20)] + [[]]
    terms, weights = smoothing.levels(index.model.estimate_deltas(1), index.queries(contexts).select("query").distinct())
    follows = lambda c: {tokens[p + len(c)] for p in range(len(tokens) - len(c)) if tokens[p : p + len(c)] == c}
    most = sum(len(follows(c[k:])) for c in contexts for k in range(len(c)))
    assert 0 < terms.count() <= most and weights.count() == len(contexts)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_smoothed_samples_are_quantiles_of_the_dense_distribution(spark, n, monkeypatch):
    """Each draw is the first token whose dense running sum goes beyond the same uniform number."""
    monkeypatch.setattr(prefix.in_blocks, "__defaults__", (3,))
    index = NgramIndex.from_tokens(spark, ids("aabbccabccbadbeecf"), vocab=8)
    drawn = index.sample_smoothed([0, 1], n, 3, num_samples=12, seed=4)
    context = lambda tokens, step: tokens[: 2 + step][max(0, 3 + step - n) :] if n > 1 else []
    asked = {tuple(context(t, step)) for t in drawn for step in range(3)}
    dense = dict(zip(asked, index.batch_get_smoothed_probs([list(q) for q in asked]), strict=True))
    for sample, tokens in enumerate(drawn):
        assert tokens[:2] == [0, 1] and len(tokens) == 5
        for step in range(3):
            probs = dense[tuple(context(tokens, step))]
            u = int(hashlib.md5(f"4:{sample}:{step}".encode()).hexdigest()[:8], 16) / 2**32 * sum(probs)
            assert tokens[2 + step] == next(t for t in range(8) if sum(probs[: t + 1]) > u)


def test_scopes_of_two_threads(spark):
    """A scope that ends, or a release, takes no table of another thread."""
    written, ended = threading.Event(), threading.Event()
    found = {}

    def other():
        with storage.scratch(spark, "kept"):
            table = storage.materialize(spark.range(7), "inner")
            written.set()
            assert ended.wait(60)
            found["kept"] = storage.materialize(table.where("id > 2"), "kept")
        found["rows"] = found["kept"].count()

    with storage.scratch(spark):
        thread = threading.Thread(target=other)
        thread.start()
        assert written.wait(60)
        storage.materialize(spark.range(3), "mine")
    storage.release(spark)
    ended.set()
    thread.join()
    assert found["rows"] == 4 and found["kept"].count() == 4
    assert storage._writes["n"] == 0


def test_two_queries_in_two_threads(spark):
    """Queries of many written steps run side by side in one session."""
    texts_ = {"a": "aabbccabccba" * 3, "b": "abracadabra" * 4}
    got = {}

    def run(name):
        index = NgramIndex.from_tokens(spark, ids(texts_[name]), vocab=20)
        got[name] = [r["pos"] for r in index.suffix_table().orderBy("rank").collect()]

    threads = [threading.Thread(target=run, args=(name,)) for name in texts_]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == {name: sorted(range(len(t)), key=lambda p, t=ids(t): t[p:]) for name, t in texts_.items()}


@pytest.mark.parametrize("merge", [False, True])
def test_all_orders_at_once(spark, merge):
    """Runs over many ranges, sequences shorter than the order, words, shards."""
    rng = random.Random(3)
    texts_ = [(i, i % 2, [rng.choice("ab") for _ in range(rng.choice([0, 1, 3, 40]))]) for i in range(60)] + [(100, 0, ["a"] * 500), (101, 1, ["a"] * 700)]
    rows = spark.createDataFrame(texts_, "seq long, shard int, tokens array<string>").repartition(7)
    corpus = corpora.from_sequences(rows, "tokens", "seq", "shard")
    cut = corpora.chunked(corpus.flat(), 3, chunk=16)
    want = collections.Counter()
    for n in range(1, 8):
        seen = collections.Counter((0 if merge else s, *t[p : p + n]) for _, s, t in texts_ for p in range(len(t) - n + 1))
        want.update((n, c) for c in seen.values())
    for each in (corpus, cut):
        assert {(r["n"], r["occurrences"]): r["num_ngrams"] for r in orders.count_all_ngrams(each, 7, merge).collect()} == want
    assert orders.count_all_ngrams(corpora.from_sequences(rows.where("false"), "tokens", "seq"), 3).count() == 0
    discounts = {r["order"]: r["delta"] for r in smoothing.deltas(corpus, 4, merge).collect()}
    for n in range(1, 5):
        once, twice = want[n, 1], want[n, 2]
        assert discounts[n] == pytest.approx(once / (once + 2 * twice) if once and twice else 1.0)


def test_byte_pairs_of_a_file(spark, tmp_path):
    """Ids on executors are the tokenizer's own, also from its shipped text; texts come back whole."""
    tokenizers = pytest.importorskip("tokenizers")
    letters = {c: i for i, c in enumerate("abc ")} | {"ab": 4, "<end>": 5}
    own = tokenizers.Tokenizer(tokenizers.models.BPE(letters, [("a", "b")]))
    own.save(str(tmp_path / "t.json"))
    rows = [(3, "abc ab"), (1, "cab"), (2, None), (5, ""), (4, "aab bb")]
    docs = spark.createDataFrame(rows, "id long, text string")
    ordered = [t or "" for _, t in sorted(rows)]
    for tokenizer in (texts.FileTokenizer(str(tmp_path / "t.json")), texts.FileTokenizer(str(tmp_path / "t.json"), "<end>", ship=True)):
        path = str(tmp_path / f"x{tokenizer.eos_token_id}.bin")
        texts.tokenize_to_file(docs, tokenizer, path, ["id"], append_end=True)
        want = [t for x in ordered for t in [*own.encode(x, add_special_tokens=False).ids, tokenizer.eos_token_id]]
        read = binary.read_tokens(spark, path, tokenizer.vocab_size, strict=True)
        assert [r["token"] for r in read.orderBy("pos").collect()] == want
        found = texts.detokenize(read, tokenizer).orderBy("number").collect()
        assert [r["text"].replace(" ", "") for r in found] == [x.replace(" ", "") for x in ordered]
    with pytest.raises(ValueError, match="no token"):
        texts.FileTokenizer(str(tmp_path / "t.json"), "<none>")


def test_texts_are_encoded_once(spark, tmp_path):
    """Each text goes to the tokenizer once, and no step has a row for each token but the file's reader; ranges, ties and gaps come back whole."""
    calls = spark.sparkContext.accumulator(0)

    class Letters:
        eos_token_id, vocab_size = 0, 27

        def encode_batch(self, batch):
            calls.add(len(batch))
            return [[ord(c) - 96 for c in x] for x in batch]

        def decode_batch(self, ids):
            return ["".join(chr(96 + i) for i in x) for x in ids]

    rows = [(i * 7 % 101, "abcdefgh"[: i % 9] * (900 if i == 50 else 1 + i % 3)) for i in range(101)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    texts.tokenize_to_file(docs, Letters(), str(tmp_path / "x.bin"), ["id"], append_end=True)
    assert calls.value == 101
    ordered = [x for _, x in sorted(rows)]
    want = [t for x in ordered for t in [*(ord(c) - 96 for c in x), 0]]
    for each in (900, 64 << 20):  # in byte ranges that cut texts, and in one
        runs = binary.read_runs(spark, str(tmp_path / "x.bin"), partition_bytes=each)
        assert [(r["number"], r["text"]) for r in texts.detokenize(runs, Letters()).orderBy("number").collect()] == list(enumerate(ordered))
        read = binary.read_numbers(spark, str(tmp_path / "x.bin"), 16, partition_bytes=each).withColumnRenamed("value", "token")
        assert [r["token"] for r in read.orderBy("pos").collect()] == want
        for mixed in (read, read.repartition(3), read.where("pos < 300")):
            found = texts.detokenize(mixed, Letters()).orderBy("number").collect()
            ends = mixed.where("token = 0").count()
            assert [(r["number"], r["text"]) for r in found] == list(enumerate(ordered[:ends]))


def test_runs_that_leave_gaps_are_an_error(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1, 2]), (3, [4])], "at long, values array<long>")
    with pytest.raises(ValueError, match="do not make up"):
        binary.write_runs(rows, "at", "values", str(tmp_path / "x"), 16)


def test_words_are_encoded_as_in_texts():
    """A byte-pair file that cuts at spaces gives the same ids by words; other files are taken by whole texts."""
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    tokenizer = texts.FileTokenizer(public.path("byte_bpe_50k.json"))
    batch = ["", " ", "a b", "a  b", " a b ", "a\n b", "a \n b", "it's we'll  've", "x\u00a0y \u3000z \x1c q", "caf\u00e9 12 3,4 ... (5)", "a <|endoftext|> b<|endoftext|> c", "\ta b\t c"]
    own = tokenizer._own()
    assert texts._by_words(own.to_str())
    assert tokenizer.encode_batch(batch) == [own.encode(x, add_special_tokens=False).ids for x in batch]
    assert all("".join(texts.words_of(x)) == x for x in batch)
    split = tokenizers.Tokenizer.from_str(own.to_str())
    split.normalizer = tokenizers.normalizers.NFC()
    assert not texts._by_words(split.to_str())


def test_orders_move_packed_digests():
    """A position costs 14 bytes of an order at most, an n-gram leaves a task once, and digests are told apart by all their bits."""
    rng = random.Random(1)
    ids_ = [[rng.randrange(1 << 60) for _ in range(30)] for _ in range(20)] + [[7] * 500]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 21), pa.array([len(x) for x in ids_], pa.int32()), pa.array(ids_, pa.list_(pa.int64()))], ["shard", "own", "ids"])
    dealt = pa.Table.from_batches(list(orders._deal(iter([batch]), range(1, 17), 4)))
    for n in range(1, 17):
        own = dealt.filter(pa.compute.equal(dealt.column("n"), n))
        assert sum(len(x) for c in ("low", "high", "counts") for x in own.column(c).to_pylist()) == 14 * (20 * (31 - n) + 1)
    bucket = {"n": pa.array([3, 3], pa.int32()), "bucket": pa.array([0, 0], pa.int32())}
    packed = {"low": np.array([5, 5, 9], np.uint64), "high": np.array([1, 2, 1], np.uint16), "counts": np.array([4, 1, 2], np.uint32)}
    group = pa.table(bucket | {c: pa.array([x.tobytes()] * 2, pa.binary()) for c, x in packed.items()})
    assert orders._merged(group).to_pylist() == [{"n": 3, "occurrences": c, "num": 1} for c in (2, 4, 8)]


def test_perplexity_by_passes(spark, monkeypatch):
    """Passes over shares of the tokens add up to what one pass finds, and none takes all steps."""
    from lexshoal import index as module

    rows = spark.createDataFrame([(0, ids("aabbcca")), (1, ids("c")), (2, [])], "seq long, tokens array<long>")
    found, sizes, own = [], [], smoothing.pair_probs

    def counted(model, pairs):
        sizes.append(pairs.count())
        return own(model, pairs)

    monkeypatch.setattr(smoothing, "pair_probs", counted)
    for most in (1 << 22, 3):
        monkeypatch.setattr(module, "PASS_TOKENS", most)
        index = NgramIndex.from_tokens(spark, ids("aabbccabccba"), vocab=3)
        found.append({r["seq"]: (r["tokens"], pytest.approx(r["perplexity"])) for r in index.perplexity(rows, 2).collect()})
    assert found[0] == found[1] and set(found[0]) == {0, 1}
    assert sizes[0] == 8 and len(sizes) == 4 and sum(sizes[1:]) == 8 and max(sizes[1:]) < 8
