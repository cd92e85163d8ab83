"""The queries' own columns against brute force on the test tables, and callers' columns of any name."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexshoal.llm import chat, decontaminate, lines, media, near, packing, quality, substrings, toxicity, warc
from lexshoal.llm.columns import free_names
from lexshoal.storage import read_table

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    values, ranks = np.asarray(scores)[order], np.empty(len(scores))
    for v in np.unique(values):
        same = values == v
        ranks[order[same]] = np.flatnonzero(same).mean() + 1
    labels = np.asarray(labels, bool)
    up, down = labels.sum(), (~labels).sum()
    return (ranks[labels].sum() - up * (up + 1) / 2) / (up * down)


@needs_tables
def test_packed_pieces_are_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    found = packing.op2_packing(spark, SMALL)
    assert found.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    rows = found.collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = {r["doc_id"]: r["text"] or "" for r in read_table(spark, SMALL, "documents").collect()}
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 4096
    assert sum(map(len, ids.values())) > 0.97 * 4096 * (len(by_sequence) - 1)


@needs_tables
def test_quality_of_the_labelled_documents(spark):
    found = quality.op6_quality(spark, SMALL)
    assert found.dtypes == [("doc_id", "bigint"), ("expected_grade", "double"), ("tail_probability", "double"), ("keep", "boolean")]
    rows = found.collect()
    assert len(rows) == read_table(spark, SMALL, "documents").count()
    for r in rows:
        assert 0 <= r["expected_grade"] <= 1 and 0 <= r["tail_probability"] <= 1 and r["keep"] == (r["tail_probability"] >= 0.5)
        assert r["expected_grade"] == pytest.approx(r["tail_probability"], abs=1e-6)  # of two grades the tail is the expectation
    docs, labels = (read_table(spark, LARGER, t) for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"), "quality")
    held = quality.score(docs, model).join(labels, "doc_id").where("doc_id % 2 = 1").collect()
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in held]) > 0.94
    assert auc([r["expected_grade"] for r in held], [r["quality"] == 1 for r in held]) > 0.94


def test_repeated_labels_and_bounds_of_the_quality_sample(spark):
    docs = spark.createDataFrame([(i, ("fine words here " if i % 2 else "$$$ ### @@@ ") * 20, None) for i in range(40)] + [(3, "x" * 200_000, None)], "doc_id long, text string, extra string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] * 3, "doc_id long, quality int")
    for options in ({}, {"train_rows": 20}, {"train_features": 300}, {"train_rows": 0}, {"train_features": 0}):
        model = quality.fit(docs, labels, "quality", **options)
        rows = quality.score(docs, model).collect()
        assert len(rows) == 41
        if options.get("train_rows", 1) and options.get("train_features", 1):
            assert all(r["keep"] == bool(r["doc_id"] % 2) for r in rows if len(r["text"]) < 1000)
        else:
            assert all(r["keep"] for r in rows)


@needs_tables
def test_toxicity_of_the_held_out_documents(spark):
    found = toxicity.op10_toxicity(spark, LARGER)
    assert found.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == read_table(spark, LARGER, "documents").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(rows[r["doc_id"]], r["toxic"]) for r in read_table(spark, LARGER, "labels").collect() if r["doc_id"] in rows and rows[r["doc_id"]]["held_out"]]
    assert auc([r["score"] for r, _ in held], [t == 1 for _, t in held]) > 0.91
    assert np.mean([r["predicted"] == t for r, t in held]) > 0.96


@needs_tables
def test_real_and_broken_pages_are_parsed(spark):
    pages = read_table(spark, SMALL, "pages")
    items = media.parse_sequences(pages)
    assert items.count() == pages.count() and items.where("size(items) > 0").count() > 0
    assert [(x["kind"], x["text"]) for x in media.parse_html("<p>a</p><![foo<b>tail")] == [("text", "a"), ("text", "<![foo<b>tail")]
    assert media.parse_html("one\ntwo <![x") == [{"position": 0, "kind": "text", "text": "one two <![x", "digest": None, "caption": None}]
    for html in ("<", "<!", "<![", "<![CDATA[x", "<!DOCTYPE", "<?", "&#xFFFFFFFF;", "</", "<a href='", "<!--", "<script><![x", "\x00<![\n", "<![if !IE]>a<![endif]>", "<![CDATA[a]]>b"):
        assert isinstance(media.parse_html(html), list)


OWN = [
    *lines._OUTPUTS, *quality.OUTPUTS, "own", "digest", "gone", "row", "key", "uid", "doc", "n", "component", "score", "segments", "item", "items", "hashes", "h", "id", "label", "grade",
    "text_digest", "start", "length", "piece", "ids", "sequence_id", "bin", "block", "ord", "m0", "sha", "part", "c0", "keys", "packed", "rep", "root", "first", "salt", "shares", "payload", "revisit", "__doc", "__row", "N_LINES_", "Key_", "conv", "chunk", "runs", "place", "window",
]


def with_own_columns(table):
    """The table with a column of each of these names that it does not have."""
    names = [x for i, x in enumerate(OWN) if x.lower() not in {y.lower() for y in [*table.columns, *OWN[:i]]}]
    return table.select("*", *(F.concat(F.lit("mine "), F.lit(x)).alias(x) for x in names))


def own_values(rows, names):
    return all(r[x] == f"mine {x}" for r in rows for x in names)


@pytest.mark.parametrize("op", range(1, 11))
def test_columns_of_any_name(spark, op):
    """Callers' columns come back as they were, or change nothing."""
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    docs = [(i, f"{passage} and a line of more than forty characters\nown line {i} of the document {'x y z ' * (i % 4)}") for i in range(12)] + [(20, None), (21, "")]
    plain = spark.createDataFrame(docs, "doc_id long, text string")
    frame = with_own_columns(plain)
    extra = [c for c in frame.columns if c not in plain.columns]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    bench = with_own_columns(spark.createDataFrame([(1, passage)], "item_id long, text string"))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    if op == 1:
        turns = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
        assert same(chat.format_chats(with_own_columns(turns)), chat.format_chats(turns))
    elif op == 2:
        count = lambda t: sorted((r["doc_id"] or -1, r["start"], r["length"]) for r in packing.pack(t, packing.tokenizer_path()).collect())
        assert count(frame) == count(plain)
    elif op == 3:
        rows = decontaminate.drop_contaminated(frame, bench)
        assert rows.columns == frame.columns and {r["doc_id"] for r in rows.collect()} == {20, 21} and own_values(rows.collect(), extra)
        assert decontaminate.contaminated(frame, bench).count() == 12
    elif op == 4:
        pages = with_own_columns(spark.createDataFrame([(1, "<img src='sha256:aa'>")], "page_id long, html string"))
        sequences = media.parse_sequences(pages)
        (items,) = free_names([c for c in pages.columns if c != "html"], "items")
        found = media.resolve_media(sequences, with_own_columns(spark.createDataFrame([("aa", 5)], "digest string, size int")), items=items)
        (row,) = found.collect()
        assert row["size"] == 5 and own_values([row], [c for c in pages.columns if c not in ("page_id", "html")]) and row["n_lines__"] == "mine n_lines"
        assert same(media.refer_to_texts(frame), media.refer_to_texts(plain))
        assert same(media.interleaved_pages(frame), media.interleaved_pages(plain))
    elif op == 5:
        assert same(substrings.repeated_substrings(frame), substrings.repeated_substrings(plain))
    elif op == 6:
        model = quality.fit(frame, labels, "quality")
        rows = quality.score(frame, model).collect()
        assert len(rows) == 14 and own_values(rows, extra) and all(isinstance(r["keep_"], bool) for r in rows)
        kept = quality.accepted(frame, model)
        assert kept.columns == frame.columns and own_values(kept.collect(), extra) and kept.count() == sum(r["keep_"] for r in rows)
    elif op == 7:
        rows = lines.drop_repeated_lines(frame)
        assert rows.columns == frame.columns and own_values(rows.collect(), extra)
        assert same(rows.select("doc_id", "text"), lines.drop_repeated_lines(plain))
        assert own_values(lines.dedup_lines(frame).collect(), extra)
    elif op == 8:
        pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string")
        read = lambda t: warc.read_bundles(warc.write_bundles(warc.mark_revisits(t)))
        assert same(read(with_own_columns(pages)).drop("frame", "frame_offset"), read(pages).drop("frame", "frame_offset"))
    elif op == 9:
        assert same(near.near_duplicates(frame), near.near_duplicates(plain))
        rows = near.drop_near_duplicates(frame)
        assert rows.columns == frame.columns and own_values(rows.collect(), extra) and same(rows.select("doc_id", "text"), near.drop_near_duplicates(plain))
    else:
        model = toxicity.fit(frame, labels)
        rows = toxicity.score(frame, model).collect()
        assert len(rows) == 14 and own_values(rows, extra) and all(0 <= r["score_"] <= 1 for r in rows)


def test_very_long_texts(spark):
    """Texts of a few million bytes go through the operators that cut, score and search them."""
    body = " ".join(f"word{i % 7919} number{i % 104729}" for i in range(120_000))
    passage = "a benchmark passage of fourteen different words that nobody else would ever write down"
    docs = spark.createDataFrame([(1, body + " " + passage), (2, "short text"), (3, "x" * 2_500_000)], "doc_id long, text string")
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert [(r["doc"], r["item"], r["start"]) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 9, 240_000)]
    pieces = packing.pack(docs, packing.tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()
    assert len(pieces) == 3 and all(r["n"] == r["whole"] for r in pieces)
    referred = media.refer_to_texts(docs)
    facts = {r["digest"]: r for r in media.describe_media(media.store_texts(docs, referred)).collect()}
    sizes = {r["doc"]: r["n_bytes"] for r in media.interleaved_pages(docs).collect()}
    assert all(facts[r["digest"]]["payload_bytes"] == -(-sizes[r["doc"]] // 64) * 64 for r in referred.collect())
    assert quality.score(docs, quality.fit(docs, labels, "quality")).count() == 3
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 3
    page = spark.createDataFrame([(1, "u", "p" * 3_000_000), (2, "u", "p" * 3_000_000)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_bundles(warc.write_bundles(warc.mark_revisits(page))).collect()}
    assert got[2]["payload_bytes"] == 3_000_000 > warc.FRAME_BYTES and (got[1]["record_type"], got[1]["refers_to"]) == ("revisit", 2)
