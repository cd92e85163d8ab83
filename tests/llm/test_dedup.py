"""Near-dedup, suffix-array dedup and decontamination against brute force, and edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from lexshoal.llm import decontaminate, near, substrings
from lexshoal.llm.components import components
from lexshoal.llm.suffixes import common_prefixes, suffix_order


def prose(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def varied(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        if rng.random() < 0.5 and len(out) > 1:
            out.pop(at - 1)
        else:
            out.insert(at, f"n{rng.randrange(10**6)}")
    return out


def brute_components(docs, width, percent):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for i, text in docs:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(len(sets[i]), least.get(find(i))) for i in range(len(docs))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_copies_match_brute_force(spark, width):
    rng = random.Random(width)
    docs = []
    for _ in range(12):
        base = prose(rng, rng.choice([8, 40, 150]))
        for _ in range(rng.randrange(1, 9)):
            docs.append(" ".join(varied(rng, base, rng.choice([0, 1, 3, 6]))))
    docs += ["", None, "  \t", "one", "ONE", "two words", "Two\tWords", "a " * 3000, "a " * 3100]
    rng.shuffle(docs)
    rows = [*enumerate(docs), (3, docs[3]), (None, docs[4])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(frame, width).collect())
    want = collections.Counter((d, n, c, d == c) for (d, _), (n, c) in zip(rows, brute_components(rows, width, 80), strict=True))
    assert got == want
    kept = near.drop_near_duplicates(frame, width)
    groups = {c for _, c in brute_components(rows, width, 80)}
    assert kept.columns == frame.columns and kept.count() == len(groups)


def test_near_copies_in_poor_buckets(spark, monkeypatch):
    """Short texts of few common words share bands without being similar; buckets split by a second band lose no link."""
    rng = random.Random(5)
    words_ = ["a", "b", "c", "d", "e", "f"]
    rows = [(i, " ".join(rng.choice(words_) for _ in range(rng.choice([3, 8, 30])))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: (n, c) for (d, _), (n, c) in zip(rows, brute_components(rows, 2, 80), strict=True)}
    seen = []
    inner = near._by_second_band
    monkeypatch.setattr(near, "POOR_BLOCKS", 0)
    monkeypatch.setattr(near, "_by_second_band", lambda *a: seen.append(1) or inner(*a))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(frame, 2).collect()} == want
    assert seen


def test_only_texts_of_candidates_move(spark):
    """Of many long texts and few near copies, the shuffles move less than half of the texts' bytes."""
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(1200)) for _ in range(300)]
    texts += [f"{text} {i}" for i, text in enumerate(texts[:5])]
    context = spark.sparkContext._jsc.sc()

    def moved():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).collect()}
        after = moved()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {i: i - 300 if i >= 300 else i for i in range(305)}
    assert after - before < sum(map(len, texts)) / 2


def test_wanted_rows(spark):
    """Uids of several partitions; with few slots words share one, and no row is lost."""
    rng = random.Random(9)
    uids = [(part << 33) + row for part in (0, 1, 5, 4000) for row in range(300)]
    ids = [uid for uid in uids if rng.random() < 0.2]
    table = spark.createDataFrame([(uid, str(uid)) for uid in uids], "uid long, slot string")
    asked = spark.createDataFrame([(uid,) for uid in ids + ids[:9]], "uid long")
    rows = near.wanted(table, asked)
    assert rows.columns == table.columns and sorted(map(tuple, rows.collect())) == [(uid, str(uid)) for uid in ids]
    coarse = [r["uid"] for r in near.wanted(table, asked, slots=2).collect()]
    assert set(ids) <= set(coarse) <= set(uids) and len(coarse) == len(set(coarse))
    assert near.wanted(table, asked.limit(0)).count() == 0


def test_near_copies_of_nothing(spark):
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_keeps_similar_pairs():
    for n in (32, 64, 96, 128):
        assert near.least_matches(n, 0.8, 1e-6) < 0.8 * n
    a = np.arange(256, dtype=np.uint32).reshape(2, 128)
    b = a.copy()
    b[1] += 1
    assert near.survives(a, b, 0.8).tolist() == [True, False]
    pairs = near.spanning_pairs(np.array([1, 2, 1]), np.array([2, 3, 3]), np.array([1, 2, 1]), np.array([2, 3, 3]), np.array([5, 9, 7]))
    assert pairs.tolist() == [1, 2]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            top[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for node in top:
        groups[find(node)].add(node)
    assert set(got) == set(top)
    for group in groups.values():
        assert len({got[x] for x in group}) == 1 and got[next(iter(group))] in group
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_order_matches_sorting():
    rng = np.random.default_rng(1)
    for trial in range(150):
        depth, letters = int(rng.choice([3, 8, 10, 50])), int(rng.choice([1, 2, 3, 26]))
        segments = [rng.integers(97, 97 + letters, int(rng.integers(1, 30)) + depth - 1).astype(np.uint8) for _ in range(int(rng.integers(1, 12)))]
        if trial % 3 == 0:
            segments += segments[:1]
        text, sizes = np.concatenate(segments), np.array([len(x) for x in segments])
        first = np.cumsum(sizes) - sizes
        order = suffix_order(text, first, sizes - depth + 1, first + sizes, depth)
        assert sorted(order) == np.concatenate([np.arange(a, a + n - depth + 1) for a, n in zip(first, sizes, strict=True)]).tolist()
        strings = [text[p : p + depth].tobytes() for p in order]
        assert strings == sorted(strings)
        shared = common_prefixes(text, order, depth)
        for i in range(1, len(order)):
            a, b = strings[i - 1], strings[i]
            assert shared[i] == next((k for k in range(depth) if a[k] != b[k]), depth)


def brute_repeats(docs, depth=50):
    order = sorted({d for d, _ in docs}, key=lambda d: (d is not None, d or 0))
    rank = {d: i for i, d in enumerate(order)}
    owner = {}
    for d, t in docs:
        x = (t or "").encode()
        for p in range(len(x) - depth + 1):
            k = x[p : p + depth]
            owner[k] = min(owner.get(k, len(order)), rank[d])
    out = []
    for d, t in docs:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for p in range(len(x) - depth + 1):
            if owner[x[p : p + depth]] < rank[d]:
                gone[p : p + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_match_brute_force(spark):
    rng = random.Random(9)
    passages = [" ".join(prose(rng, rng.choice([5, 15, 60]))) for _ in range(6)] + ["ü" * 40, "x" * 300]
    docs = []
    for i in range(60):
        parts = [rng.choice([*passages, " ".join(prose(rng, 20)), f"{i} "]) for _ in range(rng.randrange(0, 6))]
        docs.append((i * 3, "".join(parts)))
    docs += [(1, docs[10][1]), (500, docs[10][1]), (500, docs[11][1]), (30, docs[10][1]), (600, None), (601, ""), (602, "short"), (None, passages[2]), (603, "x" * 5000), (604, "x" * 49), (605, passages[2])]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, ord string, sha string").repartition(3)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.repeated_substrings(frame).collect()), key=str)
    assert got == sorted(brute_repeats(docs), key=str)


def test_repeats_of_nothing(spark):
    assert substrings.repeated_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="depth"):
        substrings.repeated_substrings(spark.createDataFrame([], "doc_id long, text string"), depth=10)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute_leaks(docs, items):
    out = {}
    for i, text in docs:
        w = words(text)
        for j, item in items:
            q = words(item)
            if not q:
                continue
            k = min(5, len(q))
            want, own = collections.Counter(grams(q, k)), grams(w, k)
            n = len(q) - k + 1
            for s in range(max(1, len(own) - n + 1)):
                have = collections.Counter(own[s : s + n])
                both = sum((have & want).values())
                union = sum(have.values()) + sum(want.values()) - both
                if 100 * both >= 80 * union:
                    out[i, j] = max(out.get((i, j), 0), both / union)
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    items = [(j, " ".join(prose(rng, rng.choice([12, 40, 80])))) for j in range(12)]
    items += [(20, "Only three words"), (21, "again and again and again and again and again and again"), (22, None), (23, "..."), (0, items[0][1])]
    docs = []
    for i in range(80):
        body = prose(rng, rng.choice([0, 5, 60, 200]))
        if rng.random() < 0.7:
            own = words(rng.choice(items)[1]) or ["x"]
            kind = rng.random()
            if kind < 0.4:
                own = own[rng.randrange(3) :]
            elif kind < 0.6:
                own = own[: max(1, len(own) - rng.randrange(4))]
            elif kind < 0.8:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = own
        docs.append((i, " ".join(body).upper() if i % 5 == 0 else ", ".join(body)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, " ".join(words(items[1][1])[:-1])), (None, items[2][1]), (104, "only THREE words!"), (102, items[0][1])]
    docs_frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, hashes string, item string")
    items_frame = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, h string")
    want = brute_leaks(docs, items)
    rows = decontaminate.contaminated(docs_frame, items_frame).collect()
    assert {(r["doc"], r["item"]): pytest.approx(r["similarity"]) for r in rows} == want
    clean = decontaminate.drop_contaminated(docs_frame, items_frame)
    assert clean.columns == docs_frame.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    # the shuffled way gives the same
    before, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, 0
    try:
        assert {(r["doc"], r["item"]) for r in decontaminate.contaminated(docs_frame, items_frame).collect()} == set(want)
    finally:
        decontaminate.BROADCAST_ROWS = before


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.drop_contaminated(docs, items).count() == 1
    assert decontaminate.contaminated(docs.where("false"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_a_line_of_all_documents_between_differing_texts(spark, monkeypatch):
    """Frequent anchors are cut down, and blocks are dealt in two steps; the result stays that of brute force."""
    rng = random.Random(12)
    line = "All rights to these sixty bytes are reserved by nobody, see."
    docs = [(i, " ".join(prose(rng, 12)) + line + " ".join(prose(rng, 12)) + (docs_tail if i % 7 == 0 else "")) for i, docs_tail in enumerate(["another passage that only a seventh of all documents have, of eighty bytes...."] * 120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = sorted(brute_repeats(docs))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    plain = sorted(tuple(r[c] for c in columns) for r in substrings.repeated_substrings(frame).collect())
    assert plain == want
    for name, value in {"HOT_SEGMENTS": 3, "HOT_ANCHORS": 1 << 40, "WAYS": 4, "ANCHOR_BYTES": 2000, "REDEAL_BYTES": 3000}.items():
        monkeypatch.setattr(substrings, name, value)
    parts = []
    inner = substrings._sort_rows
    monkeypatch.setattr(substrings, "_sort_rows", lambda segments, cut, n: parts.append(inner(segments, cut, 50).groupBy("part").count().collect()) or inner(segments, cut, n))
    assert sorted(tuple(r[c] for c in columns) for r in substrings.repeated_substrings(frame).collect()) == want
    sizes = [r["count"] for r in parts[0]]
    assert len(sizes) == 50 and max(sizes) < 3 * sum(sizes) / 50  # no part holds the segments of a frequent anchor


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        substrings.repeated_substrings(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
