"""Web archives with individually compressed records and their own dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_folder, small_batches, tidy

#: Fixed values of the archive format: the mark of the leading skippable frame, the mark of a dictionary, the profile of revisits.
SKIPPABLE, DICTIONARY = b"\x5d\x2a\x4d\x18", b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive's dictionary is built from its own first records, so many bytes of them at most.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
#: A task begins a new archive beyond this size; a reader sends on rows beyond this.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 8 << 20
MIN_REVISIT_BYTES = 1000


def record_id(page_id) -> str:
    return f"<tag:fieldgrid,2025:page/{'' if page_id is None else page_id}>"


def page_of(record: str):
    found = record.rpartition("/")[2].rstrip(">")
    return int(found) if found else None


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, which tells the payload's length, and no payload."""
    uri = "".join(x if "\x20" < x < "\x7f" and x not in "<>" else "".join(f"%{b:02X}" for b in x.encode("utf-8", "surrogatepass")) for x in url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, date: str):
    def run(batches):
        import hashlib
        import io
        import uuid

        import pyarrow as pa
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        store, at = fs.FileSystem.from_uri(folder)
        part, n_file, held, held_bytes, codec, out, index = TaskContext.get().partitionId(), 0, [], 0, None, None, []

        def dictionary(samples):
            """From the held records; too few or too plain ones make none, and the leading frame stays empty."""
            try:
                return zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) >= 16 else None
            except zstandard.ZstdError:
                return None

        def put(data, page_id):
            frame = codec.compress(data)
            index.append((page_id, name, out.tell(), len(frame)))
            out.write(frame)

        def start():
            nonlocal codec, out, held, held_bytes
            made = dictionary([x for _, x in held])
            raw = made.as_bytes() if made else b""
            packed = zstandard.ZstdCompressor(level=9).compress(raw) if raw else b""
            lead = packed if raw and len(packed) < len(raw) else raw
            codec = zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=True) if made else zstandard.ZstdCompressor(level=3)
            out = io.BytesIO()
            out.write(SKIPPABLE + len(lead).to_bytes(4, "little") + lead)
            info = f"software: fieldgrid\r\nformat: WARC File Format 1.1\r\n".encode()
            out.write(codec.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <tag:fieldgrid,2025:info/" + name.encode() + b">\r\nWARC-Date: " + date.encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: " + str(len(info)).encode() + b"\r\n\r\n" + info + b"\r\n\r\n"))
            for page_id, data in held:
                put(data, page_id)
            held, held_bytes = [], 0

        def finish():
            """Under another name first, so that a lost attempt leaves no half archive; what one leaves, the index doesn't name."""
            nonlocal out, codec, n_file, index
            if held:
                start()
            if out is None:
                return None
            other = f"{at}/.attempt-{uuid.uuid4().hex}"
            with store.open_output_stream(other) as to:
                to.write(out.getbuffer())
            store.move(other, f"{at}/{name}")
            rows, index, out, codec = index, [], None, None
            n_file += 1
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["page_id", "file", "offset", "length"])

        attempt = uuid.uuid4().hex[:12]
        name = f"part-{part:05d}-{n_file:05d}-{attempt}.warc.zst"
        store.create_dir(at, recursive=True)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                payload = (html or "").encode()
                data = record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), refers_to, date)
                if out is None:
                    held.append((page_id, data))
                    held_bytes += len(data)
                    if held_bytes >= SAMPLE_BYTES:
                        start()
                else:
                    put(data, page_id)
                if out is not None and out.tell() >= ARCHIVE_BYTES:
                    yield finish()
                    name = f"part-{part:05d}-{n_file:05d}-{attempt}.warc.zst"
        if (rows := finish()) is not None:
            yield rows

    return tidy(run)


def records_of(archive):
    """(header fields, block) of each record of an archive, a file that is read as a stream."""
    import io

    import zstandard

    mark = archive.read(8)
    if mark[:4] != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    lead = archive.read(int.from_bytes(mark[4:], "little"))
    if lead and lead[:4] != DICTIONARY:
        lead = zstandard.ZstdDecompressor().decompress(lead)
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(lead)) if lead else zstandard.ZstdDecompressor()
    with io.BufferedReader(codec.stream_reader(archive, read_across_frames=True), 1 << 20) as stream:
        while line := stream.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError("not a record")
            fields = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.partition(b": ")
                fields[name.decode().lower()] = value.decode()
            block = stream.read(int(fields["content-length"]))
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut short")
            yield fields, block


def _read(folder: str, payloads: bool):
    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

        def out(rows):
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns[: 7 if payloads else 6], names=names[: 7 if payloads else 6])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{at}/{name}", compression=None) as archive:
                    for fields, block in records_of(archive):
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).partition(b":")[2])
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        again = "warc-refers-to" in fields
                        if not again and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError("a payload differs from its digest")
                        keep = payload if payloads and not again else None
                        rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, fields["warc-type"], page_of(fields["warc-refers-to"]) if again else None, keep))
                        held += len(keep or b"") + 200
                        if held > READ_BYTES:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return tidy(run)


def write_archives(pages: DataFrame, folder: str, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each page and returns the index: page_id, file, offset, length of the record's frame.

    An archive begins with a skippable frame that holds a Zstandard dictionary built from
    its own first records; each record is a frame of its own, so the index gives access to
    any. Of pages whose payloads are equal and have at least MIN_REVISIT_BYTES, those with
    the largest page_id are responses and the others revisit it; all else are responses.
    Digests are counted with partial sums, and only those of several pages are joined back.

    folder is a URI that all executors reach. Null html is an empty payload, a null url
    about:blank; null ids are responses and nothing refers to them. Repeated rows are
    records of their own. An empty table writes no archive.
    """
    small_batches(pages.sparkSession)
    long_ones = pages.where((F.octet_length("html") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull())
    again = long_ones.groupBy(F.sha1(F.col("html").cast("binary")).alias("digest")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = materialize(again, "payloads")
    digest = F.when(F.octet_length("html") >= MIN_REVISIT_BYTES, F.sha1(F.col("html").cast("binary")))
    joined = pages.select("page_id", "url", "html", digest.alias("digest")).join(again, "digest", "left")
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    return materialize(joined.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_write(folder, date), "page_id long, file string, offset long, length long"), "archive-index")


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, and with payloads the payload (null for revisits), of all records.

    Only archives that the index of write_archives names are read, each as a stream, so
    a task holds a record and READ_BYTES of rows. Payloads are held against their digests.
    """
    files = index.select("file").distinct()
    columns = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return files.repartition(max(1, files.count())).mapInArrow(_read(folder, payloads), columns)


def op10_warc(pages: DataFrame) -> DataFrame:
    folder = new_folder(pages.sparkSession, "archives")
    index = write_archives(pages.select("page_id", "url", "html"), folder)
    return read_archives(index, folder, payloads=False).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
r AS (SELECT *, sha1(payload) AS payload_digest, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY sha1(payload)) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN n >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND first <> page_id THEN first END AS refers_to
FROM r
"""
