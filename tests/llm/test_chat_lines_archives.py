"""Chat formatting, line dedup, media columns and archives: brute force, round trips and edge cases."""

import base64
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexshoal.llm import chat, lines, media, warc

TURNS = "conv_id long, turn long, role string, text string, segments string, runs string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS)


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nx", "<\\|", "<\\\\|im_sep|>", "<", "|im_end|>", "", None, "ab<|im_sep|>", "é\n<|", "\\"]
    rng = random.Random(1)
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None, "tool\n\\n<|x"]), rng.choice(nasty)))
    rows += [(100, 1, "user", "same"), (100, 1, "user", "same"), (101, None, "user", "b"), (101, 0, "assistant", "a"), (None, 0, "user", "q")]
    rows += [(102, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(700)]
    done = chat.format_chats(turns(spark, rows), chunk_turns=4)
    got = {r["conv_id"]: r for r in done.withColumn("turns", chat.parse_chats(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want = [(r[2] or "", r[3] or "") for r in own]
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == want
        assert got[conv]["loss"] == "".join(x for role, x in want if role == "assistant")
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
        runs = sum(1 for i, w in enumerate(want) if not i or w[0] != want[i - 1][0])
        assert got[conv]["formatted"].count(chat.OPEN) == runs


def test_chat_of_nothing(spark):
    assert chat.format_chats(turns(spark, []).where("false")).count() == 0


def brute_lines(docs, least=40, many=5):
    space = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(space).translate(low)
    where = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                where.setdefault(key(x), set()).add(i)
    keeper = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in where.items() if len(v) >= many}
    out = {}
    for i, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if key(x) not in keeper or keeper[key(x)] == i]
        out[i, t] = (len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(2)
    common = ["A" * 40, "  " + "É" + "b" * 39 + "\t", "x" * 39, "ß" * 50, "Long line that many documents have in common, number %d" % 7]
    docs = []
    for i in range(60):
        own = [rng.choice([*common, common[0].lower(), common[1].strip(), f"own line {i}", ""]) for _ in range(rng.randrange(0, 30))]
        docs.append((i, "\n".join(own)))
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, "\n".join([common[4]] * 500)), (None, "\n".join(common)), (5, docs[5][1])]
    frame = spark.createDataFrame([(*d, "x", 777) for d in docs], "doc_id long, text string, gone string, N_Lines_ long")
    done = lines.dedup_lines(frame).withColumn("sha", F.sha2(lines.keep_lines(F.col("text"), F.col("keep_bitmap")), 256))
    rows = done.collect()
    want = brute_lines(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_lines"], r["n_dropped"], r["sha"]) == want[r["doc_id"], r["text"]]
        assert len(r["keep_bitmap"]) == (-(-r["n_lines"] // 8) if r["n_dropped"] else 0)


def test_lines_of_nothing(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_media_round_trip(spark):
    texts = ["", None, "a", "b" * 64, "c" * 65, "é" * 1000, "<img src='x'>& \0", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    referred = media.refer_to_texts(docs).cache()
    stored = media.store_texts(docs, referred).cache()
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for t in texts})
    items = media.resolve_media(media.parse_sequences(media.interleaved_pages(docs)), media.describe_media(stored)).where("item.kind = 'media'")
    rows = {r["doc"]: r for r in items.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + bytes((-len(data)) % 64 or (0 if data else 64))
        assert rows[i]["payload_bytes"] == len(payload) and rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert rows[i]["tail_crc32"] == zlib.crc32(payload[-64:])
        assert rows[i]["media_bytes"] == len(media.encode_samples(payload)) and media.decode_samples(media.encode_samples(payload)) == payload
    assert rows[2]["feature"] == rows[7]["feature"] != rows[5]["feature"]
    with pytest.raises(ValueError, match="samples"):
        media.decode_samples(b"P5\n64 2\n255\nshort")


def test_pages_of_texts_interleave(spark):
    """Paragraphs, medium and caption keep their places, whatever the texts hold."""
    texts = ["a\nb", "one", "", None, " \n\t\n", "<p>x</p>\n&amp; &#0; &lt\n\n\u00a0y\u2003 z\x1c\x85\n</figure><![if\r\nlast <!-- ", "a\nb", "p\n" * 501]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = media.describe_media(media.store_texts(docs, media.refer_to_texts(docs).cache()))
    pages = media.interleaved_pages(docs)
    sequences = {r["doc"]: r["items"] for r in media.parse_sequences(pages).collect()}
    rows = {r["doc"]: r for r in media.resolve_media(media.fold_runs(media.parse_sequences(pages)), stored).collect()}
    digest = lambda runs: hashlib.sha256("\n".join(runs).encode()).hexdigest()
    for i, text in enumerate(texts):
        runs = [" ".join(x.split()) for x in (text or "").split("\n") if x.strip()]
        half, row = len(runs) // 2, rows[i]
        assert [x["text"] for x in sequences[i] if x["kind"] == "text"] == runs and [x["position"] for x in sequences[i]] == list(range(len(runs) + 1))
        assert (row["item"]["position"], row["n_runs"], row["n_bytes"]) == (half, len(runs), len((text or "").encode()))
        assert row["item"]["caption"] == f"{row['n_bytes']} bytes of {len(runs)} paragraphs"
        assert (row["runs_before"], row["runs_after"]) == ([digest(runs[:half])], [digest(runs[half:])])
        assert row["payload_sha256"] == row["item"]["digest"]
    mixed = spark.createDataFrame([(1, "<p>a<img src='sha256:x'>b<img src='sha256:y'>", "mine"), (2, None, "own")], "id long, html string, n_runs string")
    found = {r["id"]: r for r in media.fold_runs(media.parse_sequences(mixed)).collect()}
    assert (found[1]["n_runs"], found[1]["n_runs_"], [x["digest"] for x in found[1]["items"]]) == ("mine", 2, ["x", "y"])
    assert found[1]["runs_before"] == [digest("a"), digest("ab")] and found[1]["runs_after"] == [digest("b"), digest("")]
    assert (found[2]["n_runs_"], found[2]["items"], found[2]["runs_before"]) == (0, [], [])


def test_sequences_keep_order_and_captions(spark):
    html = "<p>one</p><img src='sha256:aa' alt='first'><figure><img src='sha256:bb'><figcaption>the &amp; second</figcaption></figure>two<script>no</script><p>three"
    items = media.parse_html(html)
    assert [(x["position"], x["kind"], x["text"] or x["digest"], x["caption"]) for x in items] == [(0, "text", "one", None), (1, "media", "aa", "first"), (2, "media", "bb", "the & second"), (3, "text", "two", None), (4, "text", "three", None)]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    store = spark.createDataFrame([("bb", 5)], "digest string, size int")
    rows = media.resolve_media(media.parse_sequences(pages), store).orderBy("item.position").collect()
    assert [(r["id"], r["item"]["position"], r["size"]) for r in rows] == [(1, 0, None), (1, 1, None), (1, 2, 5), (1, 3, None), (1, 4, None)]


def test_archives_round_trip(spark):
    rows = [(i, f"http://x/{i} é\n", "copy" if i % 3 == 0 else f"page {i} " * (i * 50)) for i in range(40)]
    rows += [(50, None, None), (51, "http://y", ""), (None, "http://z", "alone"), (7, "http://x/7 again", "page 7 " * 350)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    bundles = warc.write_bundles(warc.mark_revisits(pages), frame_bytes=2000, bundle_bytes=3000).cache()
    got = warc.read_bundles(bundles).collect()
    assert len(got) == len(rows)
    newest = {}
    for i, _, h in rows:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if i is None else i)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r["page_id"])
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        last = newest[html] == (-1 if r["page_id"] is None else r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), digest)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last else ("revisit", newest[html]))
    row = max(bundles.collect(), key=lambda x: len(x["index"]))
    assert len({x["frame"] for x in row["index"]}) > 1
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(bytes(row["bundle"]), read_across_frames=True).read()
    assert len(re.findall(rb"WARC/1.1\r\n", whole)) == len(row["index"])
    small = warc.mark_revisits(pages, min_bytes=10_000).where("revisit")
    assert small.count() == 0
    assert warc.read_bundles(warc.write_bundles(warc.mark_revisits(pages.where("false")))).count() == 0
