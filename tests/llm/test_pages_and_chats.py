"""WARC archives and chat formatting: round trips, odd rows, pushed-down predicates."""

import base64
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideline.llm import chat_format, shared, warc

PAGES = [
    (0, "https://a.example/é?x=1 2\n", "<html>" + "long text " * 30_000 + "</html>", 1),
    (1, None, None, 1),
    (2, "https://b.example/", "", 1),
    (3, "https://c.example/", "same WARC/1.1\r\n\r\nWARC/1.1 payload", 1),
    (4, "https://d.example/", "same WARC/1.1\r\n\r\nWARC/1.1 payload", 1),
    (4, "https://d.example/", "same WARC/1.1\r\n\r\nWARC/1.1 payload", 1),
    (3, "https://c.example/", "same WARC/1.1\r\n\r\nWARC/1.1 payload", 1),
    (None, "https://e.example/", "same WARC/1.1\r\n\r\nWARC/1.1 payload", 1),
    (None, "https://f.example/", "only without an id", 1),
    (-5, "https://g.example/", "größer ​ als ASCII \x00 \U0001f600", 1),
] + [(k, f"https://h.example/{k}", f"page {k % 40} " * (k % 60), 1) for k in range(10, 200)]
PAGE_SCHEMA = "page_id long, url string, html string, sha int"


@pytest.fixture(scope="module")
def archive(spark):
    folder = shared.run_folder(spark, "test-warc")
    warc.write_warc(spark.createDataFrame(PAGES, PAGE_SCHEMA).repartition(3), folder).count()
    return folder


def wanted(least_bytes=0):
    first = {}
    for i, _, html, _ in PAGES:
        b = (html or "").encode()
        first[b] = min(first.get(b, warc.NO_ID), warc.NO_ID if i is None else i)
    out = Counter()
    for i, _, html, _ in PAGES:
        b = (html or "").encode()
        again = len(b) >= least_bytes and (warc.NO_ID if i is None else i) > first[b]
        out[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None] += 1
    return out


def test_archives_give_back_every_page(spark, archive):
    assert Counter(tuple(r) for r in warc.read_pages(spark, archive).collect()) == wanted()
    bodies = warc.read_warc(spark, archive).where("record_type = 'response' AND target_uri LIKE 'https://g%'").collect()
    assert bodies[0].payload.decode() == PAGES[9][2] and bodies[0].http_headers["content-type"] == "text/html; charset=utf-8"


def test_least_bytes_keeps_small_payloads_as_responses(spark):
    folder = shared.run_folder(spark, "test-warc")
    warc.write_warc(spark.createDataFrame(PAGES, PAGE_SCHEMA), folder, least_bytes=100).count()
    assert Counter(tuple(r) for r in warc.read_pages(spark, folder).collect()) == wanted(100)


def test_ranges_own_the_records_that_begin_in_them(spark, archive):
    whole = warc.read_warc(spark, archive).select("record_id", "position", "file")
    small = warc.read_warc(spark, archive, range_bytes="700").select("record_id", "position", "file")
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, small.collect()))
    assert small.rdd.getNumPartitions() > 10


def test_plain_archives_and_predicates(spark, tmp_path):
    records = b""
    for k in range(50):
        body = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n" + f"body {k} \r\n\r\nWARC/1.1 not a record".encode()
        records += warc.record([("WARC-Type", "response" if k % 2 else "request"), ("WARC-Record-ID", f"<urn:k:{k}>"), ("WARC-Target-URI", f"http://x/{k % 5}"), ("Content-Type", "application/http")], body)
    (tmp_path / "a.warc").write_bytes(records)
    packed = b"".join(warc.member(records[a:z]) for a, z in [(0, len(records))])  # one member with all records is no archive of ours
    assert warc._member_head(packed)[1] == len(packed)
    for size in ("200", "100000"):
        df = warc.read_warc(spark, str(tmp_path), range_bytes=size)
        assert df.count() == 50
        rows = df.where("record_type = 'response' AND target_uri = 'http://x/1'").collect()
        assert sorted(r.record_id for r in rows) == sorted(f"<urn:k:{k}>" for k in range(50) if k % 2 and k % 5 == 1)
        assert all(r.payload.startswith(b"body") for r in rows)
        assert warc.read_warc(spark, str(tmp_path), payload="false").where("payload IS NOT NULL").count() == 0


def test_headers_alone_decide(tmp_path):
    reader = warc.WarcReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("content_length",), 3), warc.StringStartsWith(("target_uri",), "http://a")]))
    assert [f.attribute for f in left] == [("content_length",)]
    assert reader.keeps({"warc-type": "revisit", "warc-target-uri": "http://a/x"})
    assert not reader.keeps({"warc-type": "revisit"})


def test_broken_archives_say_where(tmp_path):
    data = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x:1>")], b"abc" * 100)
    (tmp_path / "a.warc").write_bytes(data[:-150])
    reader = warc.WarcReader({"path": str(tmp_path)})
    with pytest.raises(ValueError, match="cut off"):
        list(reader.read(reader.partitions()[0]))


def test_no_page(spark):
    folder = shared.run_folder(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([], PAGE_SCHEMA), folder).count()
    assert warc.read_pages(spark, folder).count() == 0


TURNS = [
    (1, 0, "user", "hello <|im_end|>"),
    (1, 1, "assistant", "<|im_start|>assistant\n<\\|x|>"),
    (1, 1, "assistant", "a tie"),
    (2, 5, "system\nodd role \\n", None),
    (2, 6, None, ""),
    (3, 0, "assistant", "very long " * 20_000),
    (None, 0, "user", "no id"),
    (None, None, "assistant", "no turn"),
] + [(4, k, ("user", "assistant")[k % 2], f"turn {k} <|{'|' * (k % 3)}") for k in range(100)]
TURN_SCHEMA = "conv_id long, turn long, role string, text string, start string, piece int"


def test_chats_come_back_from_the_output(spark):
    turns = spark.createDataFrame([(*t, "s", 1) for t in TURNS], TURN_SCHEMA).repartition(4)
    formatted = shared.stored(chat_format.format_chats(turns), "test-chats")
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.digests(formatted).collect()}
    want = {}
    for conv in {t[0] for t in TURNS}:
        rows = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        turns = [(r, x) for _, _, r, x in rows]
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        want[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat_format.chatml(turns)))
    assert got == want
    assert formatted.where("rewrites").count() == 0
    pieces = [r.piece for r in formatted.where("conv_id = 4").orderBy("start").collect()]
    assert "".join(pieces) == chat_format.chatml([(t[2], t[3]) for t in TURNS if t[0] == 4])
    assert chat_format.digests(chat_format.format_chats(spark.createDataFrame([], TURN_SCHEMA))).count() == 0


def test_escaping_is_reversible():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(["<", "|", "\\", "<|", "im_end", "|>", "a", "\n"]) for _ in range(rng.randint(0, 9)))
        assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
        assert chat_format.parse_piece(chat_format.chatml([(text, text)])) == (text, text)


def test_spans_of_black_boxes_and_rewriting():
    def closing(turns):
        return "<s>" + "".join(f"[{r}] {t.strip()}" for r, t in turns) + "</s>"

    watched = chat_format.Watched(closing)
    outputs = [watched.add("user", "one"), watched.add("assistant", "two")]
    final = closing([("user", "one"), ("assistant", "two")])
    assert [final[a:z] for _, _, a, z, _ in outputs] == ["one", "two"] and not any(o[4] for o in outputs)

    def forgetful(turns):
        return "".join(f"{r}:{t if k == len(turns) - 1 else t.split('#')[-1]};" for k, (r, t) in enumerate(turns))

    watched = chat_format.Watched(forgetful)
    assert [watched.add(r, t)[4] for r, t in [("a", "thought#said"), ("u", "next"), ("a", "more")]] == [False, True, False]


def test_templates_may_look_at_any_turn():
    """A system turn shown with every answer, strict alternation, and a rewrite 20 turns back."""
    turns = [("system", "be kind")] + [(("user", "assistant")[k % 2], f"text {k}") for k in range(60)]

    def whole(turns):
        lead = turns[0][1] if turns and turns[0][0] == "system" else "none"
        rest = turns[1:] if lead != "none" else turns
        if any(r != ("user", "assistant")[k % 2] for k, (r, _) in enumerate(rest)):
            raise ValueError("roles must alternate")
        return "".join(f"[{lead} {k} {r}] {t}\n" for k, (r, t) in enumerate(turns))

    watched = chat_format.Watched(whole)
    outputs = [watched.add(*t) for t in turns]
    assert "".join(o[0] for o in outputs) == whole(turns)
    assert [whole(turns)[o[2] : o[3]] for o in outputs[1:]] == [t for _, t in turns[1:]]  # the first text stands twice
    assert sum(o[4] for o in outputs) == 0

    def shortens(turns):
        return "".join(f"{r}:{'-' if len(turns) - k > 20 else t};" for k, (r, t) in enumerate(turns))

    watched = chat_format.Watched(shortens)
    assert [watched.add(*t)[4] for t in turns] == [k >= 20 for k in range(61)]


def test_a_payload_is_hashed_once(spark):
    bodies = [b"", b"a", b"abc", bytes(range(256))]
    coded = spark.createDataFrame([(b,) for b in bodies], "b binary").select("b", warc.payload_digest(F.col("b")).alias("d"))
    assert {bytes(r.b): r.d for r in coded.collect()} == {b: base64.b32encode(hashlib.sha1(b).digest()).decode() for b in bodies}
    assert coded._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1
