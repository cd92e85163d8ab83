"""The pipeline against a chain of brute-force stages."""

import random

import numpy as np
import pytest
from test_chat_lines_archives import brute_lines
from test_dedup import brute_components, brute_leaks
from test_models_packing import reference_ids

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = str(tmp_path_factory.mktemp("tables"))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(j, prose(30)) for j in range(6)]
    shared_line = "this line is long enough and stands in very many documents of the table"
    docs, labels = [], []
    bases = [prose(120) for _ in range(8)]
    for i in range(160):
        kind = i % 8
        text = prose(80)
        if kind == 0:
            text = " | ".join(word() + "$$$" for _ in range(60))
        elif kind == 1:
            text = bases[i % 5] + (" " + word() if i % 3 else "")
        elif kind == 2:
            text = prose(20) + " " + rng.choice(items)[1] + " " + prose(10)
        elif kind in (3, 4):
            text = prose(40) + "\n" + shared_line.upper() + "\n" + prose(20)
        elif kind == 5 and i % 3 == 0:
            text = ""
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        if i < 120:
            labels.append((i, int(kind != 0), 0))
    docs.append((500, None, "en", None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_stages_match_brute_force(spark, tables):
    folder, docs, items = tables
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    want = {d[0]: d[1] for d in docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = list(want.items())
        frame = corpus_pipeline.materialize(stage(spark, frame, folder), f"test-{name}")
        assert frame.columns == columns
        if name == "quality":
            want = {i: t for i, t in before if i == 500 or i % 8}
        elif name == "lines":
            kept = brute_lines(before)
            assert any(x[1] for x in kept.values())
            texts = {r["doc_id"]: r["text"] for r in frame.collect()}
            import hashlib

            for i, t in before:
                assert hashlib.sha256((texts[i] or "").encode()).hexdigest() == kept[i, t][2]
            want = texts
        elif name == "near_copies":
            groups = brute_components(before, 5, 80)
            want = {i: t for (i, t), (_, c) in zip(before, groups, strict=True) if c == i}
            assert len(want) < len(before)
        elif name == "leaks":
            gone = {i for i, _ in brute_leaks(before, items)}
            assert gone
            want = {i: t for i, t in before if i not in gone}
        assert {r["doc_id"]: r["text"] or "" for r in frame.collect()} == {i: t or "" for i, t in want.items()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, folder).collect()
    ids = {i: [*x, 2] for i, x in zip(want, reference_ids([t or "" for t in want.values()]), strict=True)}
    for i in ids:
        own = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in own for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids[i]
    assert {r["doc_id"] for r in pieces} == set(ids)
