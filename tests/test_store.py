"""Indexes that grow by shards: equal to a full build, whoever else writes."""

import threading

import pytest
from pyspark.sql import functions as F

from lexshoal.index import NgramIndex
from lexshoal.operators import corpus as corpora
from lexshoal.operators import orders, search
from lexshoal.sources import store as stores
from lexshoal.sources.store import ShardStore

TEXTS = ["aabbccabccba", "abcab", "cccab" * 30]


def ids(text):
    return [ord(c) - ord("a") for c in text]


def corpus(spark, text):
    return corpora.from_tokens(spark, ids(text), vocab=3)


def answers(index, queries):
    frame = index.queries([ids(q) for q in queries])
    return sorted(map(tuple, search.positions(index._lookups, frame).collect())), sorted(map(tuple, search.count_next(index._lookups, frame).collect()))


def test_appended_shards_equal_a_full_build(spark, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/store")
    with pytest.raises(ValueError, match="no shards"):
        store.open()
    assert [store.append(corpus(spark, t), 3, 4) for t in TEXTS[:2]] == [0, 1]
    old = store.manifest()
    assert store.append(corpus(spark, TEXTS[2]), 3, 4) == 2
    assert store.append(corpus(spark, TEXTS[1]), 3, 4) == 1 and len(store.manifest()["shards"]) == 3  # known already
    assert store.manifest()["shards"][:2] == old["shards"]
    full = NgramIndex.sharded(*(NgramIndex(corpus(spark, t), 3) for t in TEXTS)).index_lookups()
    opened = store.open()
    queries = ["a", "ab", "ccc", "cab" + "cccab" * 9, "bb", "", "abcab"]
    assert answers(opened, queries) == answers(full, queries)
    rows = lambda t: sorted(map(tuple, t.collect()))
    assert rows(store.frequencies()) == rows(orders.count_all_ngrams(full.corpus, 4))
    assert rows(store.tokens()) == rows(corpora.vocabulary(full.corpus))
    assert opened.count_ngrams(2) == full.count_ngrams(2)
    store.check()
    with pytest.raises(ValueError, match="vocabulary"):
        store.append(corpora.from_tokens(spark, [1], 9), 9, 4)
    assert store.append(corpus(spark, TEXTS[1]), 3, 4, again=True) == 3


def test_writers_side_by_side(spark, tmp_path, monkeypatch):
    """Both have seen the same version; the second goes on from the first's. A broken version is passed over."""
    store = ShardStore(spark, f"{tmp_path}/store")
    store.append(corpus(spark, TEXTS[0]), 3, 2)
    meet, commit = threading.Barrier(2, timeout=120), ShardStore._commit
    first = threading.local()

    def together(self, manifest):
        if not getattr(first, "met", False):
            first.met = True
            meet.wait()
        return commit(self, manifest)

    monkeypatch.setattr(ShardStore, "_commit", together)
    numbers = []
    threads = [threading.Thread(target=lambda t=t: numbers.append(ShardStore(spark, f"{tmp_path}/store").append(corpus(spark, t), 3, 2))) for t in TEXTS[1:]]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    monkeypatch.setattr(ShardStore, "_commit", commit)
    assert sorted(numbers) == [1, 2] and store.tokens().agg(F.sum("count")).first()[0] == sum(map(len, TEXTS))
    number = store.manifest()["number"] + 1
    files, at = store._file(f"manifest/{number:08d}")
    files.create(at, False).close()
    assert len(store.manifest()["shards"]) == 3
    monkeypatch.setattr(stores, "STALE_MS", -1)
    assert store.append(corpus(spark, "cab"), 3, 2) == 3 and store.manifest()["number"] == number + 1
    spark.read.parquet(f"{tmp_path}/store/shards/{store.manifest()['shards'][0]['folder']}/corpus").withColumn("tokens", F.reverse("tokens")).write.parquet(f"{tmp_path}/turned")
    monkeypatch.setattr(store, "manifest", lambda: {"shards": [{**ShardStore.manifest(store)["shards"][0], "folder": "../../turned"}]})
    spark.read.parquet(f"{tmp_path}/turned").write.parquet(f"{tmp_path}/turned/corpus")
    with pytest.raises(ValueError, match="has changed"):
        store.check()
