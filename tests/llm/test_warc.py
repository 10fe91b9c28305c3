import base64
import gzip
import hashlib
from collections import defaultdict

import pyarrow.fs

from scenespark.llm import warc

SCHEMA = "page_id long, url string, html string, key string, size long, payload string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "p") for r in rows], SCHEMA)


def want(rows, min_bytes=0):
    same = defaultdict(list)
    for i, _, h in rows:
        same[h or ""].append(i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        head = min(same[h or ""])
        kind = "response" if len(p) < min_bytes or i == head else "revisit"
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), kind, None if kind == "response" else head))
    return sorted(out)


def got(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_round_trip(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(5000, "http://a.example/x", None), (5001, "http://a.example/x", ""), (5002, None, rows[0][2]), (5003, rows[1][1], rows[0][2]), (-7, "not a url\r\nX: y", "é" * 200_000), (5004, "http://[bad", "z")]
    assert got(warc.archive_round_trip(table(spark, rows))) == want(rows)


def test_small_payloads_are_responses(spark):
    rows = [(i, f"http://h{i % 3}.example/", "x" * (i % 4)) for i in range(40)]
    assert got(warc.archive_round_trip(table(spark, rows), min_bytes=2)) == want(rows, 2)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "http://a/", "q")] * 3 + [(None, "http://b/", "q"), (None, None, "r"), (None, None, "r")]
    out = warc.archive_round_trip(table(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in out) == [(0, "response", 0), (0, "revisit", 0), (0, "revisit", 1), (1, "response", 0), (1, "revisit", 1), (1, "revisit", 1)]
    assert warc.archive_round_trip(table(spark, rows).limit(0)).count() == 0


def test_index_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 7)
    rows = [(i, f"http://www.h{i % 11}.example.com/p/{i // 5}?q={i % 2}", f"<p>{i % 90}") for i in range(400)]
    root = f"file://{tmp_path}/w"
    captures = warc.write_archives(table(spark, rows), root)
    files = warc.build_index(captures, root, files=3)
    index = warc.Index(root, files)
    for i, url, html in rows[::7]:
        (c,) = index.find(warc.line_key(url, i))
        assert c["page"] == i
    assert {c["page"] for c in index.find("com,example,h3)", prefix=True)} == {i for i, u, _ in rows if "h3.example" in u}
    assert not list(index.find("com,example,h3)/nothing 1")) and not list(index.find("a")) and not list(index.find("zz"))
    fs, path = pyarrow.fs.FileSystem.from_uri(root)
    whole = b"".join(fs.open_input_file(f.path).read() for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".warc.gz"))
    assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == 400
    assert warc.surt("https://www.Blog.Example.com:8080/a?b#c") == "com,example,blog:8080)/a?b" and warc.surt(None) == "-"
