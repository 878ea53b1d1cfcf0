import gzip
import hashlib
import io

from vellumine.llm import warc_chunks as w

SCHEMA = "page_id long, url string, html string, digest int, path string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "p") for i, u, h in rows], SCHEMA)


def run(spark, rows, folder):
    made = w.archive(spark, pages(spark, rows), str(folder))
    out = w.records(w.chunk_table(made)).select(w._page_of("record_id").alias("p"), "payload_bytes", "payload_digest", "record_type", w._page_of("refers_to_id").alias("r"))
    return made, sorted((tuple(x) for x in out.collect()), key=repr)


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = max(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        again = len(b) >= 1000 and f is not None and f != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/é\r\nX: y", "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 90), (2, None, "x" * 1000), (3, "u", "x" * 1000), (None, "u", "x" * 1000), (4, "u", "x" * 999),
    (5, "u", "x" * 999), (6, "u", None), (7, "u", ""), (8, "u", "long é " * 300_000), (9, "u", "long é " * 300_000), (9, "u", "long é " * 300_000),
    (None, None, "n" * 2000), (None, None, "n" * 2000),
]


def test_round_trip(spark, tmp_path):
    made, got = run(spark, ROWS, tmp_path / "a")
    assert got == brute(ROWS)
    assert sum(r.n_records for r in made.collect()) == len(ROWS)


def test_chunks_hold_the_payload(spark, tmp_path):
    made, _ = run(spark, ROWS[:9], tmp_path / "a")
    rows = sorted(w.chunk_table(made).collect(), key=lambda r: (r.record_id, r.chunk_no))
    of = [r for r in rows if r.record_id.startswith("urn:page:8:")]
    whole = ROWS[8][2].encode()
    assert len(of) > 20 and b"".join(bytes(r.data) for r in of) == whole and max(len(r.data) for r in rows) == w.CHUNK_BYTES
    assert all(r.digest == hashlib.sha1(whole[: r.offset + len(r.data)]).hexdigest() for r in of)


def test_archives_are_gzip_members_of_warc_records(spark, tmp_path):
    made, _ = run(spark, ROWS[:3], tmp_path / "a")
    text = b"".join(gzip.decompress(open(r.path, "rb").read()) for r in made.collect())
    assert text.count(b"WARC-Type: ") == 3 and text.count(b"WARC-Type: revisit") == 1


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path / "a")[1] == []


def test_a_cut_archive_is_an_error():
    sink = io.BytesIO()
    record = w.Record(sink, "urn:x", "u", hashlib.sha1(b"abc" * 9000).hexdigest(), 27000, None)
    for _ in range(90):
        record.write(b"abc" * 100)
    record.close()
    rows = list(w.read_chunks(io.BytesIO(sink.getvalue())))
    assert b"".join(r[-2] for r in rows) == b"abc" * 9000
    try:
        list(w.read_chunks(io.BytesIO(sink.getvalue()[:-90])))
    except ValueError:
        return
    raise AssertionError


def test_a_payload_that_is_not_what_the_header_says_is_an_error():
    for digest, size, data in (("0" * 40, 3, b"abc"), (hashlib.sha1(b"ab").hexdigest(), 3, b"ab")):
        record = w.Record(io.BytesIO(), "urn:x", "u", digest, size, None)
        record.write(data)
        try:
            record.close()
        except ValueError:
            continue
        raise AssertionError


def test_the_writer_gets_chunks(spark):
    """No row that reaches Python holds more than a chunk."""
    rows = w.payload_chunks(w.pages_as_records(pages(spark, ROWS), w.shared_dir(spark))).collect()
    assert max(len(r.data) for r in rows) == w.CHUNK_BYTES and sum(r.last for r in rows) == len(ROWS)
    assert b"".join(bytes(r.data) for r in rows if r.record_id.startswith("urn:page:9:") and r.refers_to is None)[: 100] == ROWS[9][2].encode()[:100]
