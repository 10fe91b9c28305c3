"""WARC archives and a two-level capture index.

Records are gzip members of *.warc.gz files. The index has one line a capture, sorted by the URL
with its host reversed (SURT) and the page id, in blocks compressed on their own; for each index file
a directory keeps the first key, place and size of each block. A look-up finds the index file by its
first key, searches its directory by bisection, reads the one block by range, searches that by
bisection, and reads the record by range.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import partial
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, join_hot, materialize, shared_dir

#: Captures in an index block.
LINES = 3000
_DATE = "2024-01-01T00:00:00Z"
_CAPTURE = "key string, page_id long, url string, digest string, size long, kind string, file string, at long, length long"


def surt(url: str | None) -> str:
    """The key of a URL: host reversed, in lower case, then port, path and query; '-' for none."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), f":{u.port}" if u.port else ""
    except ValueError:
        return _safe(url)
    host = host[4:] if host.startswith("www.") else host
    return _safe(f"{','.join(reversed(host.split('.')))}{port}){u.path or '/'}{'?' + u.query if u.query else ''}")


def _safe(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def line_key(url: str | None, page_id: int | None) -> str:
    """Sorts as (SURT, page id)."""
    return f"{surt(url)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def b32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(kind: str, page_id, url, digest: str, size: int, payload: bytes, refers=None, refers_url=None) -> bytes:
    """A gzip member with one record. A revisit keeps the HTTP head, whose Content-Length is that
    of the full payload, and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_safe(url or '')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers is None else refers}>", f"WARC-Refers-To-Target-URI: {_safe(refers_url or '')}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + gz.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, HTTP header fields and payload of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class Store:
    """Files below a URI that driver and executors share."""

    def __init__(self, root: str):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(root)
        self.open_files: OrderedDict = OrderedDict()

    def write(self, name: str, chunks: Iterator[bytes]) -> None:
        """Under another name first: a task that dies leaves nothing that is read, one that runs
        again puts the same bytes there."""
        self.fs.create_dir(self.root, recursive=True)
        draft = f"{self.root}/_{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        with self.fs.open_output_stream(draft) as f:
            for c in chunks:
                f.write(c)
        self.fs.move(draft, f"{self.root}/{name}")

    def read(self, name: str, at: int, length: int) -> bytes:
        f = self.open_files.pop(name, None) or self.fs.open_input_file(f"{self.root}/{name}")
        self.open_files[name] = f
        if len(self.open_files) > 32:
            self.open_files.popitem(last=False)[1].close()
        f.seek(at)
        return f.read(length)

    def size(self, name: str) -> int:
        return self.fs.get_file_info(f"{self.root}/{name}").size


def _write_records(batches: Iterator[pa.RecordBatch], root: str, kind: str) -> Iterator[pa.RecordBatch]:
    """Columns: page_id, url, sha1, size, payload or (refers, refers_url)."""
    name = f"{kind}-{TaskContext.get().partitionId():06d}.warc.gz"
    rows: list[tuple] = []

    def chunks() -> Iterator[bytes]:
        at = 0
        for whole in batches:
            for b in cut(whole, 4) if kind == "response" else [whole]:
                for page, url, sha1, size, x, *more in zip(*(c.to_pylist() for c in b.columns)):
                    digest = b32(sha1)
                    data = record(kind, page, url, digest, size, x) if kind == "response" else record(kind, page, url, digest, size, b"", x, more[0])
                    rows.append((line_key(url, page), page, url, digest, size, kind, name, at, len(data)))
                    at += len(data)
                    yield data

    first = next(out := chunks(), None)
    if first is None:
        return

    def again() -> Iterator[bytes]:
        yield first
        yield from out

    Store(root).write(name, again())
    yield pa.RecordBatch.from_arrays([pa.array(c) if i not in (1,) else pa.array(c, pa.int64()) for i, c in enumerate(map(list, zip(*rows)))], [f.split(" ")[0] for f in _CAPTURE.split(", ")]).cast(_ARROW)


_ARROW = pa.schema([(f.split(" ")[0], {"string": pa.string(), "long": pa.int64()}[f.split(" ")[1]]) for f in _CAPTURE.split(", ")])


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes a record a row of pages below root; returns the captures, a row a record.

    Payload: the html in UTF-8, null as empty. Of the rows with equal payloads of at least min_bytes the
    one with the smallest id (null ids last, then the smallest URL) is the response, others are
    revisits that refer to it, also rows that repeat an id; smaller payloads are all responses.
    Only one copy of a payload for each task and digest is shuffled. Other columns are ignored."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    p = p.select("page_id", "url", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"), "payload")
    who = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    large = p.where(F.col("size") >= min_bytes)
    heads = large.groupBy("sha1", "size").agg(F.min(who).alias("who"), F.first("payload").alias("payload")).select("who.page_id", "who.url", "sha1", "size", "payload")
    responses = heads if min_bytes <= 0 else heads.union(p.where(F.col("size") < min_bytes))
    first = materialize(responses.mapInArrow(partial(_write_records, root=root, kind="response"), _CAPTURE), "captures")
    copies = large.groupBy("page_id", "url", "sha1", "size").agg(F.count(F.lit(1)).alias("n"))
    target = first.where(F.col("size") >= min_bytes).select(F.col("digest").alias("__digest"), F.col("size").alias("__size"), F.col("page_id").alias("refers"), F.col("url").alias("refers_url"))
    copies = materialize(copies.select("*", _b32_udf()("sha1").alias("__digest"), F.col("size").alias("__size")), "copies")
    again = join_hot(copies, target, ["__digest", "__size"])
    own = F.col("page_id").eqNullSafe(F.col("refers")) & F.col("url").eqNullSafe(F.col("refers_url"))
    again = again.withColumn("n", F.col("n") - own.cast("int")).where("n > 0")
    again = again.select("page_id", "url", "sha1", "size", "refers", "refers_url", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")
    revisits = materialize(again.mapInArrow(partial(_write_records, root=root, kind="revisit"), _CAPTURE), "captures")
    return first.union(revisits)


def _b32_udf():
    @F.pandas_udf("string")
    def to_b32(s: pd.Series) -> pd.Series:
        return s.map(b32)

    return to_b32


def _write_index(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    name = f"cdx-{TaskContext.get().partitionId():06d}"
    directory: list[list] = []

    def blocks() -> Iterator[bytes]:
        at, lines = 0, []

        def block() -> bytes:
            nonlocal at
            data = zlib.compress("\n".join(lines).encode())
            directory.append([lines[0].split("\t")[0], at, len(data), len(lines)])
            at += len(data)
            lines.clear()
            return data

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                lines.append("\t".join((r.key, json.dumps({"page": None if pd.isna(r.page_id) else int(r.page_id), "url": r.url, "digest": r.digest, "kind": r.kind, "file": r.file, "at": int(r.at), "length": int(r.length)}))))
                if len(lines) == LINES:
                    yield block()
        if lines:
            yield block()

    store, out = Store(root), blocks()
    first = next(out, None)
    if first is None:
        return

    def every() -> Iterator[bytes]:
        yield first
        yield from out

    store.write(f"{name}.gz", every())
    keys = [json.dumps(d).encode() for d in directory]
    # directory: lines, the place of each line (8 bytes), their number (8 bytes)
    places = [0]
    for k in keys:
        places.append(places[-1] + len(k))
    store.write(f"{name}.dir", iter([b"".join(keys), b"".join(p.to_bytes(8, "little") for p in places), len(keys).to_bytes(8, "little")]))
    yield pd.DataFrame([{"name": name, "first": directory[0][0], "blocks": len(directory)}])


def build_index(captures: DataFrame, root: str, files: int | None = None) -> list[tuple[str, str]]:
    """Writes index files and their directories below root; returns (first key, name) of each, sorted:
    one entry an index file, as many as partitions."""
    spark = captures.sparkSession
    n = captures.count()
    files = files or max(min(spark.sparkContext.defaultParallelism, -(-n // LINES)), -(-n // 1_000_000), 1)
    ordered = captures.repartitionByRange(files, "key").sortWithinPartitions("key", "file", "at")
    made = ordered.mapInPandas(partial(_write_index, root=root), "name string, first string, blocks long")
    return sorted((r["first"], r["name"]) for r in made.collect())


class Index:
    """Looks keys up. Directories are searched in place: a handful of small range reads for a key
    that is not near the last one."""

    def __init__(self, root: str, files: list[tuple[str, str]]):
        self.store, self.firsts, self.names = Store(root), [f for f, _ in files], [n for _, n in files]
        self.counts: dict[str, tuple[int, int]] = {}
        self.entries: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()

    def _count(self, name: str) -> tuple[int, int]:
        if name not in self.counts:
            size = self.store.size(f"{name}.dir")
            n = int.from_bytes(self.store.read(f"{name}.dir", size - 8, 8), "little")
            self.counts[name] = n, size - 8 - 8 * (n + 1)
        return self.counts[name]

    def _entry(self, name: str, i: int) -> list:
        if (name, i) not in self.entries:
            _, at = self._count(name)
            lo, hi = (int.from_bytes(x, "little") for x in (lambda b: (b[:8], b[8:]))(self.store.read(f"{name}.dir", at + 8 * i, 16)))
            self.entries[name, i] = json.loads(self.store.read(f"{name}.dir", lo, hi - lo))
            if len(self.entries) > 10_000:
                self.entries.popitem(last=False)
        return self.entries[name, i]

    def _block(self, name: str, i: int) -> tuple[list[str], list[str]]:
        if (name, i) not in self.blocks:
            _, at, length, _ = self._entry(name, i)
            lines = zlib.decompress(self.store.read(f"{name}.gz", at, length)).decode().split("\n")
            self.blocks[name, i] = [x.split("\t", 1)[0] for x in lines], lines
            if len(self.blocks) > 8:
                self.blocks.popitem(last=False)
        return self.blocks[name, i]

    def find(self, key: str, prefix: bool = False) -> Iterator[dict]:
        """The captures with this key, or whose keys begin with it."""
        part = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while part < len(self.names):
            name = self.names[part]
            n, _ = self._count(name)
            i = max(bisect.bisect_left(range(n), key, key=lambda j: self._entry(name, j)[0]) - 1, 0)
            for b in range(i, n):
                if b > i and self._entry(name, b)[0] > key and not self._entry(name, b)[0].startswith(key):
                    return
                keys, lines = self._block(name, b)
                at = bisect.bisect_left(keys, key)
                while at < len(keys) and (keys[at].startswith(key) if prefix else keys[at] == key):
                    yield json.loads(lines[at].split("\t", 1)[1])
                    at += 1
                if at < len(keys):
                    return
            part += 1
            if part < len(self.names) and self.firsts[part] > key and not self.firsts[part].startswith(key):
                return

    def record(self, capture: dict) -> tuple[dict, dict, bytes]:
        return parse(self.store.read(capture["file"], capture["at"], capture["length"]))


def _read_back(batches: Iterator[pd.DataFrame], root: str, files: list, with_payload: bool) -> Iterator[pd.DataFrame]:
    index = Index(root, files)
    page_of = lambda s: int(s[10:-1]) if len(s) > 11 else None
    for pdf in batches:
        rows = []
        for key in pdf["key"]:
            for c in index.find(key):
                fields, http, payload = index.record(c)
                kind = fields["WARC-Type"]
                own = kind == "response"
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if own else fields["WARC-Payload-Digest"][5:]
                if own and fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError(f"{c['file']} at {c['at']}: the payload does not have its digest")
                rows.append((page_of(fields["WARC-Record-ID"]), c["url"], len(payload) if own else int(http["Content-Length"]), digest, kind, None if own else page_of(fields["WARC-Refers-To"]), payload if with_payload else None))
        out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        out["page_id"], out["refers_to"] = out["page_id"].astype("Int64"), out["refers_to"].astype("Int64")
        yield out if with_payload else out.drop(columns="payload")


def look_up(wanted: DataFrame, root: str, files: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", with_payload: bool = False) -> DataFrame:
    """Reads the records of the distinct (id, URL) of wanted back through the index. Keys go to tasks
    by range, so each task reads neighbouring blocks of few index files. How many tasks is given, as
    keys are small and what is read for them is not."""

    @F.pandas_udf("string")
    def key_of(url: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([line_key(u, None if pd.isna(p) else int(p)) for u, p in zip(url, page)], dtype=object)

    keys = wanted.select(key_of(F.col(url_col), F.col(id_col).cast("string")).alias("key")).distinct()
    tasks = max(wanted.sparkSession.sparkContext.defaultParallelism, 4 * len(files))
    keys = keys.repartitionByRange(tasks, "key").sortWithinPartitions("key")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return keys.mapInPandas(partial(_read_back, root=root, files=files, with_payload=with_payload), schema)


def archive_round_trip(pages: DataFrame, root: str | None = None, **columns) -> DataFrame:
    """Writes pages as WARC, indexes the archives and reads every record back; a row a record."""
    root = root or shared_dir(pages.sparkSession, "warc")
    captures = write_archives(pages, root, **columns)
    files = build_index(captures, root)
    names = {k: columns[k] for k in ("id_col", "url_col") if k in columns}
    return look_up(pages, root, files, **names)
