"""WARC archives: one gzip member per record, written from pages and read back one record after the other."""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargofile.llm.common import fresh, hot_join, slices, spread, stored

CHUNK = 1 << 16
MOST_HEADER = 1 << 20
FILE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
RECORDS = ("file string, position long, record_type string, record_id string, id string, target_uri string, date string, "
           "payload_bytes long, payload_digest string, declared_digest string, refers_to_record string, error string, "
           "payload binary")


def opened(path: str, write: bool = False):
    """A stream on path in any file system that Arrow knows (local, object stores, HDFS); folders are made as needed."""
    from pyarrow import fs

    system, own = fs.FileSystem.from_uri(path)
    if not write:
        return system.open_input_file(own)
    system.create_dir(own.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(own, compression=None)


def sha1_32(data: bytes) -> str:
    """SHA-1 as upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def head(first: str, fields: list[tuple[str, object]]) -> bytes:
    """A start line and named fields; line ends inside a value are written in percent notation, empty values left out."""
    lines = [first] + [f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in fields if v is not None]
    return ("\r\n".join(lines)).encode() + END


def record_id(page, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page}:{digest}").urn


def member(kind: str, page, url, payload: bytes, owner, date: str) -> bytes:
    """A response or, with an owner, a revisit that has the response's HTTP head but not its payload; as a gzip member."""
    digest = sha1_32(payload)
    block = head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=UTF-8"), ("Content-Length", len(payload))])
    block += b"" if kind == "revisit" else payload
    refers = f"<{record_id(owner, digest)}>" if kind == "revisit" else None
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id(page, digest)}>"), ("WARC-Date", date),
              ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_32(block)}"),
              ("WARC-Profile", PROFILE if refers else None), ("WARC-Refers-To", refers), ("X-Source-Row", page),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return gzipped(head("WARC/1.1", fields) + block + END)


def gzipped(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def warcinfo(date: str) -> bytes:
    block = b"software: cargofile\r\nformat: WARC File Format 1.1\r\n"
    return gzipped(head("WARC/1.1", [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date),
                                     ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]) + block + END)


def write_warc(pages: DataFrame, root: str | None = None, least: int = 0, file_bytes: int = FILE_BYTES, date: str | None = None,
               row: str = "page_id", uri: str = "url", payload: str = "html") -> str:
    """Writes a record per row into WARC files under root (a new shared folder if not given) and returns root.

    The payload is the text's UTF-8, empty where it is null. Of rows with equal payloads of at least `least` bytes those
    of the smallest id are responses and the others revisits of it; rows whose payload no id holds are responses. A row
    without id is written and may revisit. Rows that repeat the smallest id with its payload are all responses. Only the
    three columns named are used. An empty table gives an archive without files.

    Every task attempt writes files of its own, of about `file_bytes` at most, and names them when it has closed them;
    the names of the attempts that count become the table `files` under root in one commit, which alone decides what the
    archive holds. Files of lost attempts stay unread. Payloads are told apart by SHA-256. Decisions travel to the rows:
    digests that many rows share by broadcast, others by shuffle unless Spark finds their table small.
    """
    spark = pages.sparkSession
    root = root or fresh(spark, "warc")
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{row}`").alias("id"), F.col(f"`{uri}`").cast("string").alias("uri"), body.alias("body"))
    rows = rows.withColumn("key", F.sha2("body", 256))
    shared = rows.where(F.length("body") >= least).groupBy("key").agg(F.min("id").alias("owner"), F.count("*").alias("often"))
    shared = stored(spread(shared.where("often > 1 and owner is not null")), "warc-shared")
    told = hot_join(rows, shared, ["key"], "often", "left").select("id", "uri", "body", "owner")

    def written(batches):
        import pyarrow as pa

        out, path, done = None, None, []
        for batch in slices(batches):
            for id_, uri_, body_, owner in zip(*[batch.column(k).to_pylist() for k in ("id", "uri", "body", "owner")]):
                if out is None:
                    path, count, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = opened(path, write=True)
                    out.write(warcinfo(date))
                kind = "response" if owner is None or owner == id_ else "revisit"
                data = member(kind, id_, uri_, body_, owner, date)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64())], ["file", "records"])

    told.mapInArrow(written, "file string, records long").write.parquet(f"{root}/files")
    return root


class Broken(Exception):
    """A record that cannot be read."""


class Members:
    """The gzip members of a file in order; holds a chunk of the file and a chunk of what it unpacks to."""

    def __init__(self, stream):
        self.stream, self.raw, self.start = stream, b"", 0
        self.unpack = None

    def advance(self) -> bool:
        """Goes to the next member; False at the end of the file."""
        self.raw = self.raw or self.stream.read(CHUNK)
        self.start = self.stream.tell() - len(self.raw)
        self.unpack, self.ready = zlib.decompressobj(31), b""
        return bool(self.raw)

    def read(self, most: int = CHUNK) -> bytes:
        """The next bytes of the member, `most` at most; empty at its end."""
        while not self.ready and not self.unpack.eof:
            self.raw = self.raw or self.stream.read(CHUNK)
            if not self.raw:
                raise Broken("file ends inside a record")
            try:
                self.ready = self.unpack.decompress(self.raw, CHUNK)
            except zlib.error as error:
                raise Broken("not a gzip member") from error
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
        out, self.ready = self.ready[:most], self.ready[most:]
        return out

    def until(self, mark: bytes) -> bytes:
        """The bytes before the next mark, which is passed over."""
        got = b""
        while mark not in got:
            more = self.read()
            if not more or len(got) > MOST_HEADER:
                raise Broken("head without end")
            got += more
        got, rest = got.split(mark, 1)
        self.ready = rest + self.ready
        return got

    def recover(self) -> bool:
        """After a broken member: goes to the next place that looks like the start of one; False if there is none."""
        at, held = self.start + 1, b""
        self.stream.seek(at)
        while data := self.stream.read(CHUNK):
            held += data
            found = held.find(b"\x1f\x8b\x08")
            if found >= 0:
                self.stream.seek(at + found)
                self.raw = b""
                return True
            at, held = at + len(held) - 2, held[-2:]
        return False


def fields_of(data: bytes) -> dict[str, str]:
    """Named fields of a head by lower-case name; a line that starts blank continues the value before it."""
    out, name = {}, None
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def record(source: Members, keep: bool) -> dict:
    """The member's record: its block is cut by Content-Length and hashed as it comes; `error` tells what is wrong."""
    start = source.until(END)
    if not start.startswith(b"WARC/"):
        raise Broken("not a WARC record")
    fields = fields_of(start)
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Broken("no content length")
    left, whole, own, size, kept = int(length), hashlib.sha1(), hashlib.sha1(), 0, []
    http = fields.get("content-type", "").lower().startswith("application/http")
    in_head, seen = http, b""
    while left:
        data = source.read(min(left, CHUNK))
        if not data:
            raise Broken("block shorter than its length")
        left -= len(data)
        whole.update(data)
        if in_head:
            seen += data
            if END not in seen:
                if len(seen) > MOST_HEADER:
                    raise Broken("head without end")
                continue
            in_head, data = False, seen.split(END, 1)[1]
        own.update(data)
        size += len(data)
        if keep:
            kept.append(data)
    tail = b""
    while len(tail) <= len(END) and (data := source.read()):
        tail += data
    kind, error = fields.get("warc-type"), None
    digests = {k: base64.b32encode(h.digest()).decode() for k, h in (("block", whole), ("payload", own))}
    declared = {k: fields.get(f"warc-{k}-digest") for k in digests}
    wrong = [k for k, v in declared.items() if v and v.lower().startswith("sha1:") and v[5:].upper() != digests[k]
             and not (k == "payload" and kind == "revisit")]
    if tail != END:
        error = "no end after the block"
    elif in_head:
        error = "no HTTP head"
    elif wrong:
        error = f"{wrong[0]} digest differs"

    def bare(name):
        return fields[name].strip("<>") if name in fields else None

    declared_payload = (declared["payload"] or "")[5:].upper() or None
    return {"record_type": kind, "record_id": bare("warc-record-id"), "id": fields.get("x-source-row"),
            "target_uri": bare("warc-target-uri"), "date": fields.get("warc-date"),
            "payload_bytes": None if kind == "revisit" else size, "payload_digest": None if kind == "revisit" else digests["payload"],
            "declared_digest": declared_payload, "refers_to_record": bare("warc-refers-to"), "error": error,
            "payload": b"".join(kept) if keep and kind != "revisit" else None}


def records_of(path: str, keep: bool):
    """All records of a WARC file in order. What cannot be read gives one row with `error`; reading goes on behind it."""
    with opened(path) as stream:
        source, lost = Members(stream), False
        while source.advance():
            row = {"file": path, "position": source.start}
            try:
                row |= record(source, keep)
                lost = False
            except Broken as error:
                if not lost:
                    yield row | {"error": str(error)}
                lost = True
                if not source.recover():
                    return
                continue
            yield row


def warc_files(spark: SparkSession, root: str) -> DataFrame:
    """(file): the files of an archive that write_warc made."""
    return spark.read.schema("file string, records long").parquet(f"{root}/files").select("file")


def read_warc(files: DataFrame, payloads: bool = False) -> DataFrame:
    """A row (RECORDS) per record of the files named in column `file`, each file read in one pass by one task.

    A task holds a chunk of the file, of the block and, with payloads, the payload of a record at a time. Payload size and
    digest are taken from the bytes read (null for revisits, which hold none); `error` is null where length, end and all
    digests fit. Files come as their own rows, so their number, not that of the records, decides on the tasks.
    """
    spark = files.sparkSession
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def read(batches):
        import pyarrow as pa

        types = {"position": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], types.get(k, pa.string())) for k in names], names)

        for batch in batches:
            for path in batch.column("file").to_pylist():
                rows, held = [], 0
                for row in records_of(path, payloads):
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 300
                    if held > 8 << 20:
                        yield table(rows)
                        rows, held = [], 0
                yield table(rows)

    tasks = max(spark.sparkContext.defaultParallelism, files.count())
    return files.repartition(tasks).mapInArrow(read, RECORDS)


def resolved(records: DataFrame, id_type: str = "long") -> DataFrame:
    """(id, record_type, payload_bytes, payload_digest, refers_to): one row per response and revisit.

    A revisit gets size and digest from the response it refers to and refers_to is that one's id; they are null where the
    response is missing or its digest is not the one the revisit states. Records that could not be read raise.
    """
    rows = stored(spread(records.drop("payload")), "warc-records")
    bad = rows.where("error is not null").select("file", "position", "error").first()
    if bad:
        raise ValueError(f"{bad.file} at {bad.position}: {bad.error}")
    own = F.col("id").cast(id_type)
    plain = rows.where("record_type = 'response'").select(
        own.alias("id"), "record_type", "payload_bytes", "payload_digest", F.lit(None).cast(id_type).alias("refers_to"))
    visits = rows.where("record_type = 'revisit'").select(
        own.alias("id"), "record_type", "declared_digest", F.col("refers_to_record").alias("record_id"))
    often = visits.groupBy("record_id").agg(F.count("*").alias("often"))
    firsts = rows.where("record_type = 'response'").groupBy("record_id").agg(
        F.max(own).alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    met = hot_join(visits, often.join(firsts, "record_id", "left"), ["record_id"], "often")
    fits = F.col("declared_digest") == F.col("payload_digest")
    return plain.unionByName(met.select("id", "record_type", *[F.when(fits, F.col(c)).alias(c) for c in (
        "payload_bytes", "payload_digest", "refers_to")]))
