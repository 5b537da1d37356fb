"""Operator 9: exact round trip of the records, and the query against brute force, with awkward urls and payloads."""

import base64
import hashlib

from classledger.llm import catalog, warc

LONG = "<p>" + "x" * 200_000
PAGES = [
    (1, "http://a/\r\nWARC-Payload-Digest: sha1:AAAA", "<p>one"), (2, "http://a/\r\nWARC-Refers-To: <urn:page:77>", "<p>two"),
    (3, "http://a/\\r\\n\\\\\n\r", "<p>one"), (4, None, None), (5, "", ""), (6, "u", "\r\n\r\n<p>\r\nWARC-Type: revisit\r\n\r\n"),
    (7, "u\r\n\r\n", "\r\n\r\n<p>\r\nWARC-Type: revisit\r\n\r\n"), (8, "é日", "é日本\x00"), (9, "long", LONG), (10, "long", LONG),
    (-11, "Content-Length: 5", "<p>one"), (12, "a", "once"), (12, "b", "once"), (None, "null id", "null"), (None, "null id", "null"),
] + [(100 + i, f"http://hot/{i}", "<p>hot") for i in range(60)]


def brute(rows):
    first = {}
    for i, _, h in rows:
        ids = first.setdefault(h or "", [])
        ids += [i] if i is not None else []
    out = []
    for i, _, h in rows:
        payload = (h or "").encode()
        least = min(first[h or ""], default=None)
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "response" if i == least else "revisit", None if i == least else least))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", 0, b"") for i, u, h in rows],
                                 "page_id long, url string, html string, digest string, copies int, payload binary").repartition(4)


def test_the_query_equals_brute_force(spark, tmp_path):
    frame(spark, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, catalog.op9_warc(spark, str(tmp_path)).collect()), key=str) == brute(PAGES)


def test_records_are_rebuilt_byte_for_byte(spark, tmp_path):
    warc.write_archive(frame(spark, PAGES), f"{tmp_path}/a")
    records = [(r.page_id, bytes(r.record)) for r in warc.original_records(spark, f"{tmp_path}/a").collect()]
    assert len(records) == len(PAGES) and spark.read.parquet(f"{tmp_path}/a/payloads").count() == len({h or "" for _, _, h in PAGES})
    urls = {}
    for page, record in records:
        head, _, body = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        assert len(fields) == len(lines) - 1 and body.endswith(b"\r\n\r\n") and len(body) == int(fields["Content-Length"]) + 4
        payload = body[:-4]
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            assert payload == b""
        url = fields.get("WARC-Target-URI")
        urls.setdefault(page, set()).add(None if url is None else url.replace("\\\\", "\0").replace("\\r", "\r").replace("\\n", "\n").replace("\0", "\\"))
    assert all(u in urls[i] for i, u, _ in PAGES)


def test_escaping_is_undone(spark):
    values = ["", "\\", "\\r", "\r", "\\\r", "\\\\r\n", "\r\n\\", "a\\nb\nc", "\\\\\\n"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", warc.escaped(df.v).alias("e"), warc.unescaped(warc.escaped(df.v)).alias("u")).collect()
    assert all(r.v == r.u and "\r" not in r.e and "\n" not in r.e for r in got)


def test_small_payloads_and_empty_tables(spark, tmp_path):
    warc.write_archive(frame(spark, PAGES), f"{tmp_path}/a", min_bytes=10)
    got = {r.page_id: r.record_type for r in warc.read_archive(spark, f"{tmp_path}/a").collect()}
    assert got[3] == got[101] == "response" and got[10] == "revisit"
    warc.write_archive(frame(spark, PAGES).limit(0), f"{tmp_path}/none")
    assert warc.read_archive(spark, f"{tmp_path}/none").count() == 0
    assert warc.original_records(spark, f"{tmp_path}/none").count() == 0
