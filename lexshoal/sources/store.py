"""Saved indexes that grow by shards.

A store is a folder: ``shards/<id>`` holds a shard's corpus, its suffix index and its frequencies of
n-grams; ``merged/<id>`` the frequencies and token counts of all shards, added; ``manifest/<number>``,
one small JSON file for each version, names the shards in their order with their sizes and fingerprints,
and the merged tables that belong to them.

``append`` writes the new shard and the merged tables first, from the last merged tables and the new
shard's alone, so its work follows the shard, not the store. The new version exists when its manifest
does: its file is created only if there is none of its number. If another writer was first, only the
merged tables are made again, on top of that version. What a failed append leaves is named by no
manifest. Readers take the last manifest that is whole and never see a part of an append.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshoal.index import NgramIndex
from lexshoal.operators import corpus as corpora
from lexshoal.operators import search, suffix
from lexshoal.operators.corpus import USUAL, Corpus, vocabulary
from lexshoal.operators.orders import count_all_ngrams
from lexshoal.storage import scratch


#: A manifest that is not whole after this time never will be.
STALE_MS = 3_600_000


def fingerprint(corpus: Corpus) -> int:
    """A number of a corpus' tokens and their places, whatever its chunks and partitions."""
    rows = corpus.flat().select(F.xxhash64("pos", "token").alias("h"))
    return rows.agg(F.coalesce(F.bit_xor("h"), F.lit(0))).first()[0]


class ShardStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _file(self, name: str) -> tuple:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _versions(self) -> list[int]:
        files, at = self._file("manifest")
        if not files.exists(at):
            return []
        names = [x.getPath().getName() for x in files.listStatus(at)]
        return sorted(int(n) for n in names if n.isdecimal())

    def manifest(self) -> dict:
        """The last whole version: number, vocab, orders, merged, shards."""
        for number in reversed(self._versions()):
            text = self.spark.read.text(f"{self.path}/manifest/{number:08d}", wholetext=True).first()
            try:
                return json.loads(text[0] if text else "")
            except ValueError:  # a writer has not ended, or never will
                continue
        return {"number": -1, "shards": []}

    def _broken(self, last: int) -> list[int]:
        """Versions after the last whole one, if they are older than an hour: none is being written for so long."""
        files, now = self._file("manifest")[0], self.spark.sparkContext._jvm.System.currentTimeMillis()
        age = lambda n: now - files.getFileStatus(self._file(f"manifest/{n:08d}")[1]).getModificationTime()
        return [n for n in self._versions() if n > last and age(n) > STALE_MS]

    def _commit(self, manifest: dict) -> bool:
        """Create the manifest's file, if there is none of its number."""
        files, at = self._file(f"manifest/{manifest['number']:08d}")
        try:
            out = files.create(at, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception):
                return False
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return True

    def append(self, corpus: Corpus, vocab: int, orders: int = USUAL, again: bool = False) -> int:
        """Add a corpus of one sequence as the last shard; its number.

        A corpus that is a shard already is not added again, unless ``again`` says so: an append can be
        repeated when it is not known whether it went through.
        """
        with scratch(self.spark):
            corpus = corpora.from_flat(corpus.flat().withColumns({"shard": F.lit(0), "seq": F.lit(0).cast("long")}), vocab)
            own = {"folder": uuid.uuid4().hex, "tokens": corpus.size(), "fingerprint": fingerprint(corpus), "kind": corpus.token_type}
            known = self.manifest()
            if not again and (at := self._shard_of(known, own)) is not None:
                return at
            folder = f"{self.path}/shards/{own['folder']}"
            index = search.build(corpus, suffix.suffix_ranks(corpus), f"{folder}/lookups")
            count_all_ngrams(corpus, orders).coalesce(1).write.parquet(f"{folder}/frequencies")
            vocabulary(index.corpus).write.parquet(f"{folder}/tokens")
            corpus.frame.write.parquet(f"{folder}/corpus")
            while True:
                known = self.manifest()
                if known["shards"] and (known["vocab"], known["orders"], known["shards"][0]["kind"]) != (vocab, orders, own["kind"]):
                    raise ValueError(f"the store has a vocabulary of {known['vocab']} and {known['orders']} orders")
                merged = uuid.uuid4().hex
                for table, keys, value in (("frequencies", ["n", "occurrences"], "num_ngrams"), ("tokens", ["token"], "count")):
                    parts = [f"{folder}/{table}", *([f"{self.path}/merged/{known['merged']}/{table}"] if known["shards"] else [])]
                    self.spark.read.parquet(*parts).groupBy(*keys).agg(F.sum(value).alias(value)).write.parquet(f"{self.path}/merged/{merged}/{table}")
                number = known["number"] + 1
                while number in self._broken(known["number"]):  # left by writers that died
                    number += 1
                if self._commit({"number": number, "vocab": vocab, "orders": orders, "merged": merged, "shards": [*known["shards"], own]}):
                    return len(known["shards"])

    @staticmethod
    def _shard_of(manifest: dict, own: dict) -> int | None:
        same = [i for i, s in enumerate(manifest["shards"]) if (s["tokens"], s["fingerprint"]) == (own["tokens"], own["fingerprint"])]
        return same[0] if same else None

    def _merged(self, table: str) -> DataFrame:
        manifest = self.manifest()
        if not manifest["shards"]:
            raise ValueError("no shards")
        return self.spark.read.parquet(f"{self.path}/merged/{manifest['merged']}/{table}")

    def frequencies(self) -> DataFrame:
        """(n, occurrences, num_ngrams) of all shards' n-grams, counted apart and added: reads no corpus."""
        return self._merged("frequencies")

    def tokens(self) -> DataFrame:
        """(token, count) over all shards."""
        return self._merged("tokens")

    def open(self) -> NgramIndex:
        """All shards as one index that answers lookups without a scan."""
        manifest = self.manifest()
        if not manifest["shards"]:
            raise ValueError("no shards")
        vocab, read = manifest["vocab"], self.spark.read.parquet
        folders = [f"{self.path}/shards/{s['folder']}" for s in manifest["shards"]]
        index = NgramIndex(corpora.shards(*(Corpus(read(f"{f}/corpus"), vocab, USUAL - 1) for f in folders)), vocab)
        parts = [search.open_index(self.spark, f"{f}/lookups", vocab) for f in folders]
        every = lambda name: reduce(DataFrame.unionByName, (getattr(p, name).withColumn("shard", F.lit(i)) for i, p in enumerate(parts)))
        index._lookups = search.SuffixIndex(self.path, *(every(name) for name in ("texts", "ranks", "fences", "tops", "sizes")), vocab)
        return index

    def check(self) -> None:
        """Raise if a shard's corpus is not what its manifest says."""
        for i, shard in enumerate(self.manifest()["shards"]):
            corpus = Corpus(self.spark.read.parquet(f"{self.path}/shards/{shard['folder']}/corpus"))
            if (corpus.size(), fingerprint(corpus)) != (shard["tokens"], shard["fingerprint"]):
                raise ValueError(f"shard {i} has changed")
