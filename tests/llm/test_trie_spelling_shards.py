"""The conversation trie, spelling variants and sharding: brute force, growth, edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexshoal.llm import sharding, spelling, trie

MASK = (1 << 64) - 1


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


# sharding


def brute_jump(key, shards):
    state = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16)
    b, j = -1, 0
    while j < shards:
        b = j
        state = (state * sharding.MULTIPLIER + 1) & MASK
        j = int((b + 1) * (float(1 << 31) / ((state >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 100, 100_000])
def test_jumps(spark, shards):
    keys = [None, *range(-5, 60), 2**62]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["s"] for r in rows.select("k", sharding.jump(F.col("k"), shards)["shard"].alias("s")).collect()}
    assert got == {k: brute_jump(k, shards) for k in keys}


def test_shards_grow_into_the_new_one_only(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"))
    for shards in (1, 7, 16):
        done = sharding.assign_shards(rows, "k", shards).collect()
        later = {r["k"]: r["shard"] for r in sharding.assign_shards(rows, "k", shards + 1).collect()}
        assert all(r["grown_shard"] == later[r["k"]] and later[r["k"]] in (r["shard"], shards) for r in done)
        moved = sum(r["shard"] != later[r["k"]] for r in done)
        assert abs(moved / len(done) - 1 / (shards + 1)) < 0.02
        sizes = collections.Counter(r["shard"] for r in done)
        assert set(sizes) == set(range(shards)) and max(sizes.values()) < 1.2 * len(done) / shards


DOCS = [(1, "a", "x", "mine"), (2, None, "x", "mine"), (3, "", "x", "mine"), (None, "é", "x", None), (None, "b", "x", None), (4, "same", "x", "m"), (4, "same", "x", "m")] + [(9, f"t{i % 3}", "x", "m") for i in range(300)]
SCHEMA = "doc_id long, text string, shard string, slot string"


def test_slots_and_clashing_names(spark):
    rows = sharding.shard_rows(spark.createDataFrame(DOCS, SCHEMA), "doc_id", 5).collect()
    assert len(rows) == len(DOCS)
    by = collections.defaultdict(list)
    for r in rows:
        assert r["shard"] == "x" and r["shard_"] == brute_jump(r["doc_id"], 5) and r["grown_shard"] == brute_jump(r["doc_id"], 6)
        by[r["shard_"]].append(r)
    for own in by.values():
        assert sorted(r["slot_"] for r in own) == list(range(len(own)))
        ids = [r["doc_id"] for r in sorted(own, key=lambda r: r["slot_"])]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([r[:2] for r in DOCS], "doc_id long, text string")
    rows = sharding.write_shards(docs, "doc_id", f"{tmp_path}/shards", 4).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows) == collections.Counter(r[:2] for r in DOCS)
    assert all(r["shard"] == brute_jump(r["doc_id"], 4) for r in rows)
    with pytest.raises(ValueError):
        sharding.write_shards(spark.createDataFrame(DOCS, SCHEMA), "doc_id", f"{tmp_path}/more")
    with pytest.raises(ValueError):
        sharding.jump(F.col("k"), 0)


def test_sharding_query(spark, tmp_path):
    write(spark, tmp_path, "documents", DOCS, SCHEMA)
    rows = sharding.op13_sharding(spark, str(tmp_path)).collect()
    assert [(n, t) for n, t in sharding.op13_sharding(spark, str(tmp_path)).dtypes] == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", brute_jump(i, 16), brute_jump(i, 17)) for i, t, *_ in DOCS)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in rows) == want


# trie


def brute_trie(convs):
    """{conversation (None for no id): list of (role, text)} to rows of nodes."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    low = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: ",".join(map(str, sorted(c for c in m if c is not None and len(convs[c]) == len(p)))) for p, m in members.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return collections.Counter((low[p], len(p), low[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def ordered(rows):
    convs = collections.defaultdict(list)
    digest = lambda r: hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        convs[r[0]].append((r[2] or "", r[3] or ""))
    return dict(convs)


def brute_rebuilt(rows):
    own, out = ordered(rows), {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        base = None if c is None else c - int(np.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def nodes(table):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert table.columns == names and all(t == "bigint" for n, t in table.dtypes if n != "ends_sha256")
    return collections.Counter(tuple(r) for r in table.collect())


TURNS = "conv_id long, turn long, role string, text string, key string, ends string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS)


@pytest.mark.parametrize("depth", [256, 3])
def test_trie(spark, depth):
    """With layers of 3 turns, most conversations go through several."""
    rng = random.Random(depth)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "é", None])) for c in [*range(-40, 60), *range(5000, 5040)] for t in range(rng.choice([1, 2, 3, 4, 6, 7, 12]))]
    rows += [(None, 0, "user", "a"), (None, None, None, None), (61, None, "user", "b"), (61, 3, "x", "y"), (61, 3, "x", "y"), (2**60, 0, "user", "a")]
    rows += [(c, t, "user", f"t{t}") for c in (700, 701, 1700) for t in range(20)]
    assert nodes(trie.prefix_trie(conversations(spark, rows), depth=depth)) == brute_trie(ordered(rows))


def test_trie_of_one_node_without_an_id(spark):
    rows = [(None, 0, "user", "only")]
    assert nodes(trie.prefix_trie(conversations(spark, rows))) == brute_trie(ordered(rows))
    assert trie.prefix_trie(conversations(spark, rows).where("false")).count() == 0


def test_trie_of_a_long_conversation(spark):
    """Copies of a conversation of several whole layers, and one that leaves it at the last turn."""
    turns = 3 * trie.DEPTH
    rows = [(c, t, "user", f"turn {t}" if (c, t) != (5, turns - 1) else "other") for c in (2, 3, 5, 4000) for t in range(turns)]
    rows += [(6, t, "user", f"turn {t}") for t in range(trie.DEPTH)]
    assert nodes(trie.prefix_trie(conversations(spark, rows))) == brute_trie(ordered(rows))


def test_trie_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "hello", "é", None])) for c in range(-12, 90) if c % 7 for t in range(rng.randrange(1, 12))]
    rows += [(None, 0, "user", "x"), (3, 4, "user", "same"), (3, 4, "user", "same")]
    write(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    assert nodes(trie.op11_prefix_trie(spark, str(tmp_path))) == brute_trie(brute_rebuilt(rows))


def test_trie_query_on_no_rows(spark, tmp_path):
    write(spark, tmp_path, "conversations", [], "conv_id long, turn long, role string, text string")
    assert trie.op11_prefix_trie(spark, str(tmp_path)).count() == 0


# spelling


def brute_words(docs, damage=199, min_chars=6, min_count=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_chars:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= min_count}


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words, ratio=5):
    near = {w: [v for v in words if brute_near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def forms(table):
    rows = table.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def some_words(rng, n, letters="abé", least=1, most=9):
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(least, most))): 5 ** rng.randrange(6) + rng.randrange(3) for _ in range(n)}


@pytest.mark.parametrize("hot", [100_000, 30])
def test_forms_of_dense_words(spark, monkeypatch, hot):
    """Words of few letters have many neighbours and runs of equal ones; with ``hot`` of 30 symbols most halves are dealt over shares."""
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "SYMBOLS", 2_000 if hot < 100 else 400_000)
    words = some_words(random.Random(hot), 350)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert forms(spelling.spelling_forms(table)) == brute_forms(words)


def test_forms_of_long_and_lone_words(spark):
    long = "ab" * 1500
    words = {long: 5, long + "a": 30, long[:700] + "x" + long[701:]: 200, "lonely": 7, "z" * 2000: 5, "z" * 2001: 25, "z" * 2002: 125}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert forms(spelling.spelling_forms(table)) == brute_forms(words)


def test_intervals_of_suffix_ranks():
    rng = random.Random(2)
    words = sorted(some_words(rng, 60, "abc", 1, 6))
    symbols = np.array([x for w in words for x in (*("abc".index(c) + 1 for c in w), 0)], np.int64)
    index = spelling.FmIndex(symbols, 4)
    for pattern in ["a", "ab", "ca", "bcb", "abca", "cccccc"]:
        low, high = np.zeros(1, np.int64), np.full(1, len(symbols))
        for c in reversed(pattern):
            low, high = index.extend(np.array(["abc".index(c) + 1]), low, high)
        assert max(high[0] - low[0], 0) == sum(w.startswith(pattern, i) for w in words for i in range(len(w)))


def test_spelling_query(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["Réponse", "reponse", "réponses", "TRÈSlong", "trèslong", "trèslon", "shortx", "xy", "naïveté÷", "window", "windows", "winddows"]
    docs = [(i, " ".join(rng.choices(vocabulary, range(1, len(vocabulary) + 1), k=400))) for i in range(40)] + [(None, "window " * 30), (50, None), (51, ""), (52, "x" * 30_000), (52, "windoze_windoze-windoze,windoze windoze")]
    write(spark, tmp_path, "documents", [(*d, "clash", 1) for d in docs], "doc_id long, text string, word string, n int")
    assert forms(spelling.op12_spelling_variants(spark, str(tmp_path))) == brute_forms(brute_words(docs))
    counted = spelling.count_words(spark.createDataFrame(docs, "doc_id long, text string"), damage=3).collect()
    assert {r["word"]: r["n"] for r in counted} == brute_words(docs, damage=3)


def test_spelling_query_on_no_rows(spark, tmp_path):
    write(spark, tmp_path, "documents", [], "doc_id long, text string")
    assert spelling.op12_spelling_variants(spark, str(tmp_path)).count() == 0
