"""WARC archives with a two-level capture index.

Level one: captures sorted by reversed-host URL key, in zlib-compressed blocks of lines.  Level two: a sparse directory
with each block's first key, file, offset and length.  A look-up binary-searches the directory, reads one range of an
index file, and then one range of an archive for each capture.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, filesystem, maybe_broadcast, partitions

#: Payloads from this many bytes on are written once; equal ones revisit the response.
DEDUP_BYTES = 1000
LINES = 1024
DATE = "2024-01-01T00:00:00Z"


def surt_key(url: str | None) -> str:
    """Reversed-host key: https://www.a.org:80/x?y -> org,a,www:80)/x?y; no ://: the url itself; null: empty."""
    if url is None:
        return ""
    scheme, mark, rest = url.partition("://")
    if not mark:
        return url
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, port = (rest[:cut].rpartition("@")[2].lower().partition(":") + ("",))[::2][:2]
    return ",".join(reversed(host.split("."))) + (":" + port if port else "") + ")" + rest[cut:]


#: What each archive begins with.
INFO = "software: kinetrace\r\nformat: WARC File Format 1.1\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    """Of the record that others with this payload may refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def member(lines: list[str], body: bytes) -> bytes:
    """One gzip member holding a record."""
    data = "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def info_record(file: str) -> bytes:
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"file:{file}")
    return member(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {DATE}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields"], INFO.encode())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, place: str) -> bytes:
    """A response with its HTTP head and payload, or a revisit with the head alone.

    Responses that others may refer to are named by page and digest, all other records by ``place``, where they stand.
    """
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    # Percent-encode what would break a header line; the exact value travels as JSON.
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    named = refers_to is None and len(payload) >= DEDUP_BYTES
    own = record_id(page_id, digest) if named else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'place:{place}')}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {own}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{b32}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {json.dumps(page_id)}",
        f"X-Target: {json.dumps(url)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return member([*lines, "Content-Type: application/http; msgtype=response"], head + payload if refers_to is None else head)


def parse_record(data: bytes) -> dict:
    """Headers and payload of one gzip member; a response's digest and length are those of the payload as read."""
    data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    digest, kind = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(), fields["WARC-Type"]
    body = block.partition(b"\r\n\r\n")[2]
    if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(fields["X-Payload-Length"])):
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": json.loads(fields["X-Page-ID"]), "url": json.loads(fields["X-Target"]), "record_type": kind, "record_id": fields["WARC-Record-ID"],
        "payload_digest": digest, "payload_bytes": int(fields["X-Payload-Length"]), "payload": body if kind == "response" else None,
        "refers_to": int(fields["X-Refers-To-Page"]) if kind == "revisit" else None, "refers_to_record": fields.get("WARC-Refers-To"),
    }


_CAPTURE = "key string, page_id long, file string, offset long, length int"


def _write(folder: str):
    def run(batches):
        out, at, name = None, 0, ""
        for batch in batches:
            if out is None:
                # A name for each attempt: a repeated task never overwrites what an earlier one has reported.
                name = f"part-{uuid.uuid4().hex[:16]}.warc.gz"
                fs, path = filesystem(f"{folder}/{name}")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
                at = out.write(info_record(name))
            keys, ids, offsets, lengths = [], [], [], []
            for page_id, url, html, refers, digest in zip(*(batch.column(i) for i in range(5)), strict=True):
                url, page_id = url.as_py(), page_id.as_py()
                data = record(page_id, url, (html.as_py() or "").encode("utf-8", "surrogatepass"), refers.as_py(), digest.as_py(), f"{name}:{at}")
                out.write(data)
                keys.append(surt_key(url))
                ids.append(page_id)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int32())],
                names=["key", "page_id", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    return run


def _index(folder: str):
    """Sorted captures to compressed blocks of LINES lines; yields the directory."""

    def run(batches):
        out, at, name, held = None, 0, "", []

        def block():
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in held).encode(), 6)
            out.write(data)
            row = (held[0][0], held[-1][0], name, at, len(data), len(held))
            at += len(data)
            held.clear()
            return row

        rows = []
        for batch in batches:
            if out is None:
                name = f"captures-{uuid.uuid4().hex[:16]}.idx"
                fs, path = filesystem(f"{folder}/{name}")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                held.append(row)
                if len(held) == LINES:
                    rows.append(block())
        if out is not None:
            if held:
                rows.append(block())
            out.close()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)],
                    names=["first_key", "last_key", "file", "offset", "length", "lines"],
                )

    return run


_DIRECTORY = "first_key string, last_key string, file string, offset long, length int, lines int"


def read_range(folder: str, file: str, offset: int, length: int) -> bytes:
    fs, path = filesystem(f"{folder}/{file}")
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def _captures(folder: str):
    """Directory rows to the captures of their blocks."""

    def run(batches):
        for batch in batches:
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = [json.loads(x) for x in zlib.decompress(read_range(folder, file, offset, length)).decode().split("\n")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()), strict=True)],
                    names=["key", "page_id", "file", "offset", "length"],
                )

    return run


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _records(folder: str):
    """Captures sorted by (file, offset) to what their records hold, by range reads."""

    def run(batches):
        opened, f = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if file != opened:
                    if f is not None:
                        f.close()
                    fs, path = filesystem(f"{folder}/{file}")
                    opened, f = file, fs.open_input_file(path)
                got = parse_record(f.read_at(length, offset))
                rows.append((got["page_id"], got["payload_bytes"], got["payload_digest"], got["record_type"], got["refers_to"]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )
        if f is not None:
            f.close()

    return run


class Archive:
    """WARC files and their index in a folder of the shared directory."""

    def __init__(self, folder: str, directory: DataFrame):
        self.folder, self.directory = folder, directory

    def captures(self) -> DataFrame:
        parts = partitions(self.directory.sparkSession)
        return self.directory.select("file", "offset", "length").repartition(parts).mapInArrow(_captures(self.folder), _CAPTURE)

    def records(self) -> DataFrame:
        """page_id, payload_bytes, payload_digest, record_type, refers_to of every record.

        Captures come from the index and are dealt by archive and stretch of 8 MB, so reads of a task are in file order.
        """
        parts = partitions(self.directory.sparkSession)
        dealt = self.captures().select("file", "offset", "length").repartition(parts, "file", F.floor(F.col("offset") / (8 << 20)))
        return dealt.sortWithinPartitions("file", "offset").mapInArrow(_records(self.folder), _RECORD)

    def lookup(self, urls: list[str]) -> list[dict]:
        """The records of some urls: a binary search of the directory, a range of the index, a range of an archive each.

        Only directory blocks whose key range holds one of the keys come to the driver.
        """
        wanted = sorted({surt_key(u) for u in urls})
        if not wanted:
            return []
        hit = F.lit(False)
        for key in wanted:
            hit = hit | ((F.col("first_key") <= key) & (F.col("last_key") >= key))
        blocks = sorted(tuple(r) for r in self.directory.where(hit).select("first_key", "last_key", "file", "offset", "length").collect())
        firsts = [b[0] for b in blocks]
        out = []
        for key in wanted:
            at = max(0, bisect.bisect_left(firsts, key) - 1)
            while at < len(blocks) and blocks[at][0] <= key:
                if blocks[at][1] >= key:
                    lines = [json.loads(x) for x in zlib.decompress(read_range(self.folder, *blocks[at][2:])).decode().split("\n")]
                    low = bisect.bisect_left(lines, key, key=lambda x: x[0])
                    for k, _, file, offset, length in lines[low:]:
                        if k != key:
                            break
                        out.append(parse_record(read_range(self.folder, file, offset, length)))
                at += 1
        return out


def write_archive(pages: DataFrame, folder: str, work: Workspace, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    """Writes a record for each page, behind a warcinfo record in each file, and the two-level index.

    Of equal payloads of DEDUP_BYTES bytes or more, the page with the largest page_id is the response and others
    revisit it; rows that repeat that page_id are responses too.  Null html is an empty payload, a null url has the
    empty key, a null page_id is the smallest; payloads are written whole, however long; rows equal in page_id and payload
    share a record id; other columns are not read; an empty table gives an empty archive.  Digests are counted first (partial sums before the shuffle), and
    only digests that repeat are joined back: broadcast if few, else a join that splits large keys.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    long = rows.where(F.octet_length("html") >= DEDUP_BYTES)
    repeated = long.groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = work.write(repeated, "repeated")
    refers = F.when((F.octet_length("html") >= DEDUP_BYTES) & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    marked = rows.join(maybe_broadcast(repeated), F.col("digest") == F.col("d"), "left").select("page_id", "url", "html", refers.alias("refers_to"), "digest")
    captures = work.write(marked.mapInArrow(_write(folder), _CAPTURE), "captures")
    ordered = captures.repartitionByRange(partitions(pages.sparkSession), "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    directory = work.write(ordered.mapInArrow(_index(folder), _DIRECTORY), "directory")
    return Archive(folder, directory)
