"""Registered queries against brute force over small tables: results are whole."""

import collections

import pytest

from lexshoal.plans import registry

DOCS = [(1, "en", "of the house of\tthe tree"), (2, "en", "of the of"), (3, "fr", "de la mer de  la"), (4, "fr", None), (5, "fr", ""), (6, "de", "once")]
WORDS_OF = {i: (text or "").split() for i, _, text in DOCS}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables in which no word is frequent."""
    folder = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(DOCS, "doc_id long, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_end_tokens_has_rare_words(spark, small):
    want = collections.Counter(w for words in WORDS_OF.values() for w in [*words, "</s>"])
    assert {r["token"]: r["count"] for r in registry.end_tokens(spark, small).collect()} == want


def brute_discount(n):
    seen = collections.Counter((lang, *WORDS_OF[i][p : p + n]) for i, lang, _ in DOCS for p in range(len(WORDS_OF[i]) - n + 1))
    once, twice = (sum(c == k for c in seen.values()) for k in (1, 2))
    return once / (once + 2 * twice) if once and twice else 1.0


def brute_probs(query):
    """The recursion of the module's description, for all words."""
    unigrams = collections.Counter(w for words in WORDS_OF.values() for w in words)
    found = {w: (c + 1e-9) / (sum(unigrams.values()) + 1e-9 * (1 << 20)) for w, c in unigrams.items()}
    for m in range(len(query) + 1):
        context, d = query[len(query) - m :], brute_discount(m + 1)
        after = collections.Counter(words[p + m] for words in WORDS_OF.values() for p in range(len(words) - m) if words[p : p + m] == context)
        if not after:
            continue
        total, kinds, once = sum(after.values()), len(after), sum(c == 1 for c in after.values())
        rest = d * kinds / total if d < 1 else once + d * (kinds - once) / total
        found = {w: max(after[w] - d, 0) / total + rest * p for w, p in found.items()}
    return found


def test_batch_smoothed_probs_has_rare_words(spark, small):
    got = collections.defaultdict(dict)
    for r in registry.batch_smoothed_probs(spark, small).collect():
        assert r["token"] not in got[r["query_id"]]
        got[r["query_id"]][r["token"]] = r["prob"]
    assert got == {i: pytest.approx(brute_probs(query), abs=1e-8) for i, query in enumerate(registry.PROBES)}


def test_batch_count_next_sharded_answers_all_queries(spark, small):
    want = collections.Counter()
    for i, query in enumerate(registry.WORDS):
        for words in WORDS_OF.values():
            want.update((i, words[p + len(query)]) for p in range(len(words) - len(query)) if words[p : p + len(query)] == query)
    rows = registry.batch_count_next_sharded(spark, small).collect()
    assert len(rows) == len(want) and {(r["query_id"], r["token"]): r["count"] for r in rows} == want
    assert {5, 6} <= {r["query_id"] for r in rows}


def test_suffix_ranks_with_long_repeats(spark, tmp_path):
    """Runs and copies of far more than 41 tokens are ranked by what follows them."""
    block = ["view", "click", "error"] * 20
    tokens = ["click"] * 70 + block + ["signup"] + ["click"] * 60 + block + ["purchase"]
    spark.createDataFrame([(i, i, 0, t) for i, t in enumerate(tokens)], "event_id long, ts long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(range(len(tokens)), key=lambda p: tokens[p:])
    assert want != sorted(range(len(tokens)), key=lambda p: tokens[p : p + 41])
    assert [r["pos"] for r in registry.suffix_ranks(spark, str(tmp_path)).orderBy("rank").collect()] == want
    ranges = {}
    for i, query in enumerate(registry.KINDS):
        ranks = [r for r, p in enumerate(want) if query and tokens[p : p + len(query)] == query]
        ranges |= {i: (ranks[0], ranks[-1] + 1)} if ranks else {}
    assert {r["query_id"]: (r["first_rank"], r["end_rank"]) for r in registry.rank_boundaries(spark, str(tmp_path)).collect()} == ranges
