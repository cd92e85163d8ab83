"""Lookups of any length: in the written suffix index and by pieces, against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lexshoal.index import NgramIndex
from lexshoal.operators import corpus as corpora
from lexshoal.operators import lookup, search, suffix
from lexshoal.plans import lookups


def brute(tokens, query):
    m = len(query)
    return [p for p in range(len(tokens) - m + 1) if m and tokens[p : p + m] == query]


def brute_range(tokens, query):
    ranks = [r for r, p in enumerate(sorted(range(len(tokens)), key=lambda p: tokens[p:])) if tokens[p : p + len(query)] == query]
    return (ranks[0], ranks[-1] + 1) if ranks and query else None


def long_queries(rng, tokens, lengths):
    """Pieces of the tokens, the same with another last token, and pieces that go beyond the end."""
    out = []
    for m in lengths:
        p = rng.randrange(max(1, len(tokens) - m))
        own = tokens[p : p + m]
        out += [own, own[:-1] + [own[-1] + 1], tokens[-m:], tokens[-m:] + [tokens[0]]]
    return out


LENGTHS = [1, 2, 15, 16, 17, 33, 200]


@pytest.fixture(scope="module")
def shards(spark):
    rng = random.Random(4)
    block = [rng.randrange(3) for _ in range(230)]
    return [[rng.randrange(3) for _ in range(700)] + block + [7] + block + block, [5] * 900 + [4], [6]]


@pytest.fixture(scope="module")
def small_parts():
    """Many chunks, blocks, fences and rounds with a few thousand tokens."""
    with pytest.MonkeyPatch.context() as patch:
        for name, value in {"CHUNK": 32, "BLOCK": 16, "GROUP": 4, "FENCES": 40, "PROBES": 7, "PART_ROWS": 8, "KEY": 5}.items():
            patch.setattr(search, name, value)
        yield


def corpus_of(spark, shards):
    return corpora.shards(*(corpora.from_tokens(spark, s, vocab=100) for s in shards))


@pytest.fixture(scope="module")
def index(spark, shards, small_parts):
    corpus = corpus_of(spark, shards)
    return search.build(corpus, suffix.suffix_ranks(corpus))


def batch(spark, shards):
    rng = random.Random(9)
    queries = [q for s in shards[:2] for q in long_queries(rng, s, LENGTHS)] + [[], [6], [6, 6], [8], [5] * 900, [5] * 901, [0]]
    return queries, spark.createDataFrame(list(enumerate(queries)), "query_id long, query array<long>")


def test_ranges_and_counts(spark, shards, index):
    queries, frame = batch(spark, shards)
    got = collections.defaultdict(dict)
    for r in search.ranges(index, frame).collect():
        got[r["query_id"]][r["shard"]] = (r["first"], r["end"])
    want = {i: {s: found for s, tokens in enumerate(shards) if (found := brute_range(tokens, q))} for i, q in enumerate(queries)}
    assert got == {i: w for i, w in want.items() if w}
    counts = {r["query_id"]: r["count"] for r in search.count(index, frame).collect()}
    assert counts == {i: sum(len(brute(s, q)) for s in shards) for i, q in enumerate(queries)}
    assert {r["query_id"]: r["contained"] for r in search.contains(index, frame).collect()} == {i: c > 0 for i, c in counts.items()}


def test_positions_and_next_tokens(spark, shards, index):
    queries, frame = batch(spark, shards)
    got = collections.defaultdict(list)
    for r in search.positions(index, frame).orderBy("query_id", "shard", "rank").collect():
        got[r["query_id"]].append((r["shard"], r["pos"]))
    for i, q in enumerate(queries):
        want = [(s, p) for s, tokens in enumerate(shards) for p in sorted(brute(tokens, q), key=lambda p, t=tokens: t[p:])]
        assert got[i] == want
    follows = collections.Counter({(r["query_id"], r["token"]): r["count"] for r in search.count_next(index, frame).collect()})
    want = collections.Counter()
    for i, q in enumerate(queries):
        for tokens in shards:
            want.update((i, tokens[p + len(q)]) for p in (range(len(tokens)) if not q else brute(tokens, q)) if p + len(q) < len(tokens))
    assert follows == want


def test_pages(spark, shards, index):
    """All occurrences in pages, each query's pages of bounded size and in order."""
    frame = spark.createDataFrame([(0, [5]), (1, [0]), (2, [6]), (3, [99])], "query_id long, query array<long>")
    found = search.ranges(index, frame)
    whole = [tuple(r) for r in search.in_ranges(index, found).orderBy("query_id", "shard", "rank").collect()]
    paged = []
    for after in range(0, 1000, 170):
        rows = [tuple(r) for r in search.page(index, found, after, 170).collect()]
        assert max(collections.Counter(r[0] for r in rows).values(), default=0) <= 170
        paged += rows
    assert sorted(paged) == whole and len(whole) == sum(len(brute(s, q)) for s in shards for q in ([5], [0], [6]))


def test_all_pages_at_once(spark, shards, index, monkeypatch):
    """The same pages as one table, numbered over shards; the query asks for no page of its own."""
    frame = spark.createDataFrame([(0, [5]), (1, [0]), (2, [6]), (3, [99])], "query_id long, query array<long>")
    found = search.ranges(index, frame)
    for size in (170, 1, 5000):
        got = sorted(tuple(r) for r in search.all_pages(index, found, size).collect())
        whole = search.in_ranges(index, found).orderBy("query_id", "shard", "rank").collect()
        want, seen = [], collections.Counter()
        for r in whole:
            want.append((r["query_id"], seen[r["query_id"]] // size, r["shard"], r["rank"], r["pos"]))
            seen[r["query_id"]] += 1
        assert got == sorted(want)


def test_paged_positions_takes_one_search(spark, tmp_path, monkeypatch):
    """Work does not grow with the number of pages: no page is asked for alone."""
    rows = [(i, ("view", "click", "view", "error")[i % 4]) for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(search, "page", lambda *_: pytest.fail("a page of its own"))
    got = lookups.paged_positions(spark, str(tmp_path)).collect()
    letters = [t for _, t in rows]
    ranked = [(r, p) for r, p in enumerate(sorted(range(len(letters)), key=lambda p: letters[p:])) if letters[p] == "view"]
    assert sorted(map(tuple, got)) == [(i // 1000, r, p) for i, (r, p) in enumerate(ranked)]


def test_a_saved_index_reads_little(spark, tmp_path, monkeypatch):
    """A query on a saved index of many parts reads under a tenth of its rows, all its rounds together."""
    rng = random.Random(1)
    tokens = [rng.randrange(50) for _ in range(60_000)]
    for name, value in {"CHUNK": 64, "BLOCK": 64, "PART_ROWS": 4, "FENCES": 1 << 16, "GROUP": 256, "PROBES": 31, "KEY": 16}.items():
        monkeypatch.setattr(search, name, value)
    corpus = corpora.from_tokens(spark, tokens, 50)
    search.build(corpus, suffix.suffix_ranks(corpus), f"{tmp_path}/index")
    opened = search.open_index(spark, f"{tmp_path}/index", 50)
    assert opened.ranks.select("part").distinct().count() > 100
    read, only = [], search._only_needed

    def counted(table, row, wanted):
        kept = only(table, row, wanted)
        read.append(kept.count())
        return kept

    monkeypatch.setattr(search, "_only_needed", counted)
    query = spark.createDataFrame([(0, tokens[777:790])], "query_id long, query array<long>")
    assert search.count(opened, query).first()["count"] == len(brute(tokens, tokens[777:790]))
    assert 0 < sum(read) < (opened.ranks.count() + opened.texts.count()) / 10
    plan = opened.ranks.where(F.col("part").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_empty_index(spark):
    corpus = corpora.from_tokens(spark, [], 10)
    index = search.build(corpus, suffix.suffix_ranks(corpus))
    frame = spark.createDataFrame([(0, [1]), (1, [])], "query_id long, query array<long>")
    assert {r["count"] for r in search.count(index, frame).collect()} == {0}
    assert search.count_next(index, frame).count() == 0


@pytest.mark.parametrize("longest", [2, 16, None])
def test_long_queries_by_pieces(spark, shards, longest):
    """Any tails, and none: the same answers."""
    rows = corpus_of(spark, shards)
    corpus = rows if longest is None else corpora.chunked(rows.flat(), longest, 100, chunk=20)
    queries = [q for s in shards[:2] for q in long_queries(random.Random(9), s, [2, 16, 17, 33, 200])] + [[], [6, 6], [5] * 900, [5] * 901]
    frame = spark.createDataFrame(list(enumerate(queries)), "query_id long, query array<long>")
    got = collections.defaultdict(list)
    for r in lookup.positions(corpus, frame).collect():
        got[r["query_id"]].append((r["shard"], r["pos"]))
    for i, q in enumerate(queries):
        assert sorted(got[i]) == [(s, p) for s, tokens in enumerate(shards) for p in brute(tokens, q)]
    assert {r["query_id"]: r["count"] for r in lookup.count(corpus, frame).collect()} == {i: len(got[i]) for i in range(len(queries))}
    follows = collections.Counter({(r["query_id"], r["token"]): r["count"] for r in lookup.count_next(corpus, frame).collect()})
    want = collections.Counter()
    for i, q in enumerate(queries):
        for tokens in shards:
            want.update((i, tokens[p + len(q)]) for p in (range(len(tokens)) if not q else brute(tokens, q)) if p + len(q) < len(tokens))
    assert follows == want


def test_token_files_answer_queries_of_any_length(spark, tmp_path):
    tokens = list(range(1, 60)) * 3
    NgramIndex.from_tokens(spark, tokens).save_tokens(str(tmp_path / "t.bin"))
    index = NgramIndex.from_token_file(spark, str(tmp_path / "t.bin"))
    assert index.count(tokens[:100]) == 2 and index.count(tokens) == 1 and index.count_next(tokens[:60])[2] == 2
    index.index_lookups()
    assert index.count(tokens[:100]) == 2 and index.count(tokens) == 1 and index.count_next(tokens[:60])[2] == 2
    assert index.positions(tokens[:118]) == [59, 0] and not index.contains(tokens + [1])
    index.save(f"{tmp_path}/saved")
    again = NgramIndex.load(spark, f"{tmp_path}/saved")
    assert again.has_lookups and again.positions(tokens[:118]) == [59, 0]


@pytest.mark.parametrize("kind", ["int", "string"])
def test_large_joins_leave_most_ngrams_where_they_lie(spark, monkeypatch, kind):
    """Many queries, of which long ones share beginnings: what passes the filter is joined, and little else passes."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 3)
    cast = str if kind == "string" else int
    rng = random.Random(6)
    seqs = [[cast(rng.randrange(9)) for _ in range(rng.choice([0, 1, 16, 17, 40, 90]))] for _ in range(40)]
    seqs += [seqs[-1][:], [cast(1)] * 60] + [[cast(2)] * 20 + [cast(k)] * 5 for k in range(9)]
    corpus = corpora.from_sequences(spark.createDataFrame(list(enumerate(seqs)), f"seq long, tokens array<{kind}>"), "tokens", "seq")
    queries = [s[p : p + m] for s in seqs if s for m in (1, 16, 24) for p in (0, len(s) // 2)]
    queries += [q[:-1] + [cast(8)] for q in queries[:40]] + [[], [cast(1)] * 61]
    frame = spark.createDataFrame(list(enumerate(queries)), f"query_id long, query array<{'string' if kind == 'string' else 'long'}>")
    want = {i: sum(len(brute(s, q)) for s in seqs) for i, q in enumerate(queries)}
    assert {r["query_id"]: r["count"] for r in lookup.count(corpus, frame).collect()} == want
    follows = collections.Counter({(r["query_id"], r["token"]): r["count"] for r in lookup.count_next(corpus, frame).collect()})
    assert follows == collections.Counter((i, s[p + len(q)]) for i, q in enumerate(queries) for s in seqs for p in (brute(s, q) if q else range(len(s))) if p + len(q) < len(s))
    rows = spark.range(100_000).select("id")
    passed = lookup._passing(rows, rows.where("id % 1000 = 7"), ["id"], "bigint")
    assert passed.where("id % 1000 = 7").count() == 100 and passed.count() < 200
