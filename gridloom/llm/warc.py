"""A deterministic sharded WARC writer and its reader.

Records are sorted by page id, then payload digest, then url, and cut into shards by the running sum of their bytes, which
is exact: shards, files and bytes follow from the records alone, not from how the rows lie or how many tasks there are.
Each task writes its shards as gzip members, rolls to a new file once the compressed size reaches the limit, and
regenerates headers, digests, record ids and dates, so a second attempt writes the same bytes. Files get a temporary name
until they are whole; a manifest table, written last, names those that count. Files are opened by URI (file, hdfs, s3,
gs), in the shared folder.

Of equal payloads the one with the smallest page id is the response; the others are revisit records that refer to it.
Each revisiting page's reference is a narrow row that the sort puts right before the page. Rows that are alike are counted,
so one that stands in a third of the table is dealt over shards as a number of times, and an id that many rows share is
cut by digest and url.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, fresh_path, join_hot, running_sums, searched, written

FILE_LIMIT = 64 << 20
#: Bytes of a shard before compression, and shards at most: shards of large tables grow instead.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 50_000
#: What a record's headers count for.
HEAD_BYTES = 512
DATE = "2000-01-01T00:00:00Z"
LEVEL = 6
CRLF = b"\r\n"
MANIFEST = "file string, records long, bytes long, sha256 string, first_page long, last_page long"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(uri: str):
    """The file system and the path in it. A bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(kind: str, name: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    """A record as one gzip member, the same bytes for the same input."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id(name)), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    head = b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in lines) + CRLF
    return gzip.compress(head + block + CRLF + CRLF, LEVEL, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = "none" if page_id is None else str(page_id)
    uri = quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~-._")
    http = b"HTTP/1.1 200 OK" + CRLF + b"Content-Type: text/html; charset=utf-8" + CRLF + b"Content-Length: %d" % len(payload) + CRLF + CRLF
    headers = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("WARC-Page-Id", name)]
    if refers_to is None:
        return record("response", f"page:{name}:{digest}", http + payload, headers)
    more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(f"page:{refers_to}:{digest}")), ("WARC-Refers-To-Page-Id", str(refers_to))]
    return record("revisit", f"page:{name}:{digest}:revisit", http, headers + more)


class Shard:
    """The files of one task: written under a temporary name, renamed when whole."""

    def __init__(self, folder: str, number: int, limit: int):
        self.fs, self.folder = file_system(folder)
        self.number, self.limit, self.serial, self.out = number, limit, 0, None

    def add(self, page_id: int | None, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"pages-{self.number:06d}-{self.serial:05d}.warc.gz"
            self.temp = posixpath.join(self.folder, f".{self.name}.{uuid.uuid4().hex}.tmp")
            self.out = self.fs.open_output_stream(self.temp, compression=None)
            self.size, self.records, self.sha, self.first = 0, 0, hashlib.sha256(), page_id
            self.put(record("warcinfo", f"file:{self.name}", b"software: gridloom\r\nformat: WARC File Format 1.1\r\n", [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]))
        self.put(data)
        self.records, self.last = self.records + 1, page_id
        if self.size >= self.limit:
            yield self.close()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def ended(self) -> list[tuple]:
        return [self.close()] if self.out is not None else []

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temp, posixpath.join(self.folder, self.name))
        self.out, self.serial = None, self.serial + 1
        return self.name, self.records, self.size, self.sha.hexdigest(), self.first, self.last


def rows_batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def sort_key() -> Column:
    """Page id (nulls first), digest and url as one text that sorts like them; rows with equal keys are alike."""
    place = F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    url = F.when(F.col("url").isNull(), "-").otherwise(F.sha1(F.col("url").cast("binary")))
    return F.concat(F.when(F.col("page_id").isNull(), "-").otherwise(place), F.col("digest"), url)


def shards_of(slim: DataFrame, shard_bytes: int) -> tuple[DataFrame, int, int]:
    """The distinct rows in order, with how often each stands there and the shards that it begins and ends in.

    Written: k, page_id, digest, n, rows, before, first, last; and the bytes of a shard and the number of shards.
    """
    alike = slim.select(sort_key().alias("k"), "page_id", "digest", F.length("payload").cast("long").alias("n")).groupBy("k", "page_id", "digest", "n").agg(F.count("*").alias("rows"))
    cost = F.col("n") + HEAD_BYTES
    placed = running_sums(alike, [F.col("k")], {"before": F.col("rows") * cost}, "warc-keys")
    total = placed.agg(F.max(F.col("before") + F.col("rows") * cost)).first()[0] or 0
    size = max(shard_bytes, -(-total // MOST_SHARDS))
    last = F.floor((F.col("before") + (F.col("rows") - 1) * cost) / size).cast("int")
    return written(placed.select("*", F.floor(F.col("before") / size).cast("int").alias("first"), last.alias("last")), "warc-places"), size, -(-total // size)


def references(placed: DataFrame, least_bytes: int) -> DataFrame:
    """shard, page_id, digest, first of the pages that revisit another: one row for each shard, id and digest."""
    named = written(placed.filter(F.col("n") >= least_bytes).groupBy("digest", "page_id").agg(F.min("first").alias("low"), F.max("last").alias("high"), F.sum("rows").alias("rows")), "warc-named")
    firsts = named.groupBy("digest").agg(F.min("page_id").alias("of"), F.sum("rows").alias("rows"), F.count("*").alias("n")).filter("rows > 1 and of is not null")
    firsts = written(firsts, "warc-firsts")
    found = join_hot(named.select("digest", "page_id", "low", "high"), firsts.select("digest", "of"), "digest", firsts.select("digest", "n"))
    return found.filter(~F.col("page_id").eqNullSafe(F.col("of"))).select(F.explode(F.sequence("low", "high")).alias("shard"), "page_id", "digest", F.col("of").alias("first"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, file_limit: int = FILE_LIMIT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes a record per row and returns the manifest (also written as a table beside the files).

    A null or empty html is an empty payload; a null url is about:blank; a null id sorts first, is written as `none` and
    never serves as a reference; rows that repeat an id and a payload are alike (all responses, or all revisits); other
    columns are ignored; an empty table gives no files. Other layouts of the same rows give the same files.
    """
    spark = pages.sparkSession
    arrow_batches(spark, 128)
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha1("payload"))
    placed, size, shards = shards_of(slim, shard_bytes)
    starts = placed.groupBy("first").agg(F.min("k").alias("k")).orderBy("k").collect()  # a row for each shard
    refs = references(placed, least_bytes).select("shard", "page_id", F.lit(0).alias("kind"), "digest", F.lit("").alias("k"), "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.lit(1).cast("long").alias("times"))
    at = searched([r["k"] for r in starts[1:]], F.col("k"))
    shard = F.get(F.from_json(F.lit(str([r["first"] for r in starts])), "array<int>"), at)
    wide = slim.withColumn("k", sort_key()).select("*", shard.alias("shard"), F.lit(1).cast("long").alias("times"))
    spread = placed.filter("first <> last")  # at most a key for each shard
    if not spread.isEmpty():
        keys = F.broadcast(spread.select("k"))
        one = wide.join(keys, "k", "left_semi").groupBy("k").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "payload", "digest")])
        each = one.join(F.broadcast(spread.select("k", "n", "rows", "before", F.explode(F.sequence("first", "last")).alias("shard"))), "k")
        # Copy j of a row lies in the shard where its bytes begin.
        upto = lambda s: F.greatest(F.lit(0), F.least(F.col("rows"), F.ceil((s * F.lit(size) - F.col("before")) / (F.col("n") + HEAD_BYTES))))
        each = each.withColumn("times", (upto(F.col("shard").cast("long") + 1) - upto(F.col("shard").cast("long"))).cast("long"))
        wide = wide.join(keys, "k", "left_anti").unionByName(each.filter("times > 0").select(*wide.columns))
    wide = wide.select("shard", "page_id", F.lit(1).alias("kind"), "digest", "k", F.lit(None).cast("long").alias("first"), "url", "payload", "times")
    dealt = refs.unionByName(wide).repartitionById(max(1, shards), "shard").sortWithinPartitions("shard", "page_id", "kind", "digest", "k")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        shard, key, refs_now = None, object(), {}
        for batch in batches:
            rows = []
            for number, page_id, kind, hexed, first, url, payload, times in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard is None or number != shard.number:
                    rows += shard.ended() if shard else []
                    shard, key = Shard(folder, number, file_limit), object()
                if page_id != key:
                    key, refs_now = page_id, {}
                if kind == 0:
                    refs_now[hexed] = first
                else:
                    data = page_record(page_id, url, payload, base64.b32encode(bytes.fromhex(hexed)).decode(), refs_now.get(hexed))
                    for _ in range(times):
                        rows += shard.add(page_id, data)
            if rows:
                yield rows_batch(rows, names, types)
        if shard and (rows := shard.ended()):
            yield rows_batch(rows, names, types)

    manifest = dealt.select("shard", "page_id", "kind", "digest", "first", "url", "payload", "times").mapInArrow(run, MANIFEST)
    at = posixpath.join(folder, "manifest")
    manifest.write.parquet(at)
    return spark.read.schema(manifest.schema).parquet(at)


def remove_unfinished(folder: str) -> int:
    """Removes what attempts that failed have left under temporary names; to be called once no attempt runs any more."""
    from pyarrow import fs as pafs

    fs, path = file_system(folder)
    left = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.startswith(".") and f.base_name.endswith(".tmp")]
    for f in left:
        fs.delete_file(f)
    return len(left)


def read_records(stream, check: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an opened archive, one at a time."""
    un, data = zlib.decompressobj(31), b""
    raw = stream.read(1 << 20)
    while raw:
        data += un.decompress(raw)
        raw = un.unused_data if un.eof else stream.read(1 << 20)
        if un.eof:
            if not data.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            head, block = data.split(CRLF + CRLF, 1)
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(headers["Content-Length"])
            block, tail = block[:size], block[size:]
            if len(block) != size or tail != CRLF + CRLF or check and headers["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
                raise ValueError(f"broken record {headers['WARC-Record-ID']}")
            yield headers, block
            un, data, raw = zlib.decompressobj(31), b"", raw or stream.read(1 << 20)
    if data:
        raise ValueError("cut off")


def read_warc(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The pages of all files in the manifest, each response's payload checked against its digest."""
    names = [f.split()[0] for f in PAGE.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def page(headers: dict[str, str], block: bytes) -> tuple:
        http, payload = block.split(CRLF + CRLF, 1)
        size = next(int(line.split(b":")[1]) for line in http.split(CRLF) if line.startswith(b"Content-Length:"))
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if headers["WARC-Type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
            raise ValueError(f"broken payload {headers['WARC-Record-ID']}")
        number = lambda k: int(headers[k]) if headers.get(k, "none") != "none" else None
        return number("WARC-Page-Id"), size, digest, headers["WARC-Type"], number("WARC-Refers-To-Page-Id")

    def run(batches):
        fs, path = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(posixpath.join(path, name), compression=None) as stream:
                    for headers, block in read_records(stream):
                        if headers["WARC-Type"] != "warcinfo":
                            rows.append(page(headers, block))
                        if len(rows) >= 4096:
                            yield rows_batch(rows, names, types)
                            rows = []
                if rows:
                    yield rows_batch(rows, names, types)

    files = manifest.select("file").repartition(max(1, min(manifest.count(), 10_000)), "file")
    return files.mapInArrow(run, PAGE)


def archived(pages: DataFrame, least_bytes: int = 0, file_limit: int = FILE_LIMIT) -> DataFrame:
    """Writes the pages as WARC files in the shared folder and reads them back: one row per page. Cases as write_warc()."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_warc(pages.sparkSession, write_warc(pages, folder, least_bytes=least_bytes, file_limit=file_limit), folder)
