"""WARC archives: written as one gzip stream each, normalised to one gzip member a record with a sidecar index, read by offsets."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import discard, saved, slices
from brindle.sources.shared import shared_base

#: Payloads of fewer bytes are never replaced by a revisit.
MIN_BYTES = 100
#: Compressed bytes after which a writer begins a new archive, and of an archive that one task reads back.
ARCHIVE_BYTES, SPAN_BYTES = 1 << 30, 16 << 20
#: A payload with at least this share of all rows counts as hot: at most as many can be, so their table is broadcast.
HOT_SHARE = 1000
LEVEL = 6
#: Bytes that are inflated, copied or read at a time, and the most that the head of a record may take.
PIECE, HEAD_BYTES = 1 << 20, 1 << 20
GZIP = 31  # zlib's window bits of a gzip member
SUFFIX, SIDECAR = ".warc.gz", ".cdxj"
INDEX = "offset long, length long, type string, id string, refers_to string, uri string, digest string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class TornArchive(ValueError):
    """An archive that ends within a record, or has something else where a record should begin."""


def payload_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(id, uri, payload, digest, refers_to)`` of every row: texts in UTF-8, SHA-256, and the id of the record that a revisit stands for.

    Of the rows with one payload of at least ``min_bytes`` bytes those with the smallest id are responses; the others refer to it (rows that repeat the
    smallest id are responses as well). Null payloads are empty. Rows without an id never are what others refer to.

    Ids and digests alone are grouped. The few payloads that may be hot are joined by a broadcast of at most ``HOT_SHARE`` rows, and rows that it
    serves are dealt by a key of their own in the other join, so no task gets all copies.
    """
    raw = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("uri"), raw.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max(F.length("payload")).alias("size"))
    groups = saved(groups.where(F.col("n") > 1).where((F.col("size") >= min_bytes) & F.col("first").isNotNull()).select("digest", "n", "first"))
    least = max(2, -(-pages.count() // HOT_SHARE))
    hot = groups.where(F.col("n") >= least).select(F.col("digest").alias("hot_digest"), F.col("first").alias("hot_first"))
    rest = groups.where(F.col("n") < least).select(F.col("digest").alias("rest_digest"), F.col("first").alias("rest_first"))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    rows = rows.withColumn("key", F.when(F.col("hot_digest").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.expr("uuid()"))))
    rows = rows.join(rest, F.col("key") == F.col("rest_digest"), "left")
    first = F.coalesce("hot_first", "rest_first")
    out = rows.select("id", "uri", "payload", "digest", F.when(first.isNotNull() & ~F.col("id").eqNullSafe(first), first).alias("refers_to"))
    out._brindle_path = groups._brindle_path  # what discard() deletes
    return out


def record(row_id: str | None, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record; of a revisit the payload is left out, and the HTTP head still tells its length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: <urn:page:{quote(row_id, safe='')}>"] if row_id is not None else []
    head += [f"WARC-Date: {date}"] + ([f"WARC-Target-URI: {quote(uri, safe=_URI)}"] if uri is not None else [])
    head += [f"WARC-Refers-To: <urn:page:{quote(refers_to, safe='')}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    if refers_to is None:
        block += payload
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Printable ASCII stays as it is in URIs; everything else is written as %XX.
_URI = "".join(map(chr, range(0x21, 0x7F)))


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = LEVEL, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write what ``payload_roles`` gives into ``folder``, a stream of gzip for each archive; ``(path, records, bytes)`` of each archive.

    Every task writes archives of its own under new names. Those of attempts that did not end are in no row of the result, which is a written
    table; ``sweep`` deletes them. Page ids are read back as texts.
    """

    def body(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        out = path = squeeze = None
        count = size = 0

        def ended():
            nonlocal out
            rest = squeeze.flush()
            out.write(rest)
            out.close()
            out = None
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size + len(rest)]})

        for b in slices(batches, "payload"):
            for row in b.to_pylist():
                if out is None:
                    path, count, size = f"{uuid.uuid4().hex}{SUFFIX}", 0, 0
                    out, squeeze = store.open_output_stream(f"{base}/{path}", compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                piece = squeeze.compress(record(row["id"], row["uri"], row["payload"], row["digest"], row["refers_to"], date))
                out.write(piece)
                count, size = count + 1, size + len(piece)
                if size >= archive_bytes:
                    yield ended()
        if out is not None:
            yield ended()

    _made(folder)
    texts = records.select(F.col("id").cast("string"), "uri", "payload", "digest", F.col("refers_to").cast("string"))
    return saved(texts.mapInArrow(body, "path string, records long, bytes long"))


class Inflated:
    """What a gzip stream holds, of one member or many, piece by piece."""

    def __init__(self, stream):
        self.stream, self.lib, self.ready, self.at, self.passed, self.raw, self.begun = stream, zlib.decompressobj(GZIP), b"", 0, 0, b"", False

    def _more(self) -> bool:
        """Inflate up to another ``PIECE`` bytes behind what is ready; False at the end of the stream."""
        while True:
            if self.lib.eof:
                rest = self.lib.unused_data or self.stream.read(PIECE)
                if not rest.strip(b"\0"):
                    return False  # the end, or the padding of a tape
                self.lib, self.raw = zlib.decompressobj(GZIP), rest
            raw = self.lib.unconsumed_tail or self.raw or self.stream.read(PIECE)
            self.raw = b""
            if not raw:
                if not self.begun:
                    return False  # an empty file
                raise TornArchive("the gzip stream is cut off")
            self.begun = True
            try:
                got = self.lib.decompress(raw, PIECE)
            except zlib.error as e:
                raise TornArchive(f"no gzip data: {e}") from None
            if got:
                self.passed += self.at
                self.ready, self.at = self.ready[self.at :] + got, 0
                return True

    @property
    def position(self) -> int:
        return self.passed + self.at

    def head(self) -> bytes | None:
        """Up to an empty line and with it; None at the end."""
        scanned = self.at
        while (end := self.ready.find(b"\r\n\r\n", scanned)) < 0:
            if len(self.ready) - self.at > HEAD_BYTES:
                raise TornArchive("a head without an end")
            known = len(self.ready) - self.at
            if not self._more():
                if known:
                    raise TornArchive("the archive ends within a head")
                return None
            scanned = max(0, known - 3)
        out = self.ready[self.at : end + 4]
        self.at = end + 4
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes."""
        while size:
            if self.at == len(self.ready) and not self._more():
                raise TornArchive("the archive ends within a record")
            out = self.ready[self.at : self.at + size]
            self.at += len(out)
            size -= len(out)
            yield out


def parsed(head: bytes) -> dict[str, str]:
    """Fields of a record's head by lower-case name; the first of repeated ones."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/\d+\.\d+", first):
        raise TornArchive(f"no record begins with {first[:40]!r}")
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    if not out.get("content-length", "").isascii() or not out.get("content-length", "").isdigit():
        raise TornArchive("a record without Content-Length")
    return out


def _sidecar_line(offset: int, length: int, head: dict[str, str]) -> dict:
    return {"offset": offset, "length": length, "type": head.get("warc-type"), "id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "digest": head.get("warc-payload-digest")}


def normalised(stream, out, lines, level: int = LEVEL) -> tuple[int, int, str | None]:
    """Inflate ``stream`` once, write every record as a gzip member of its own to ``out`` and a JSON line for each to ``lines``.

    Returns records, bytes written, and what is wrong with the archive, if anything: whole records before that place are kept. No
    record is held inflated as a whole.
    """
    source, count, size = Inflated(stream), 0, 0
    begin = 0
    try:
        while True:
            begin = source.position
            if (head := source.head()) is None:
                return count, size, None
            fields = parsed(head)
            squeeze = zlib.compressobj(level, zlib.DEFLATED, GZIP)
            member = [squeeze.compress(head)]
            member += map(squeeze.compress, source.pieces(int(fields["content-length"])))
            if b"".join(source.pieces(4)) != b"\r\n\r\n":
                raise TornArchive("no empty lines behind a record")
            member += [squeeze.compress(b"\r\n\r\n"), squeeze.flush()]
            for piece in member:
                out.write(piece)
            length = sum(map(len, member))
            lines.write(json.dumps(_sidecar_line(size, length, fields)).encode() + b"\n")
            count, size = count + 1, size + length
    except TornArchive as e:
        return count, size, f"{e} (record at inflated byte {begin})"


def normalise(archives: DataFrame, source: str, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite the archives of ``source`` named in ``archives(path)`` into ``folder``, each with its index beside it.

    Returns ``(source, path, records, bytes, error)``, a written table; ``error`` tells of an archive that is torn, of which the records before that place are
    kept. An archive is one stream and hence one task; names are new for every attempt.
    """

    def body(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, base), (target, top) = _store(source), _store(folder)
        for b in batches:
            for name in b.column("path").to_pylist():
                new = uuid.uuid4().hex
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream, target.open_output_stream(f"{top}/{new}{SUFFIX}", compression=None) as out, target.open_output_stream(f"{top}/{new}{SIDECAR}", compression=None) as lines:
                    count, size, wrong = normalised(stream, out, lines, level)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, new + SUFFIX, count, size)] + [pa.array([wrong], pa.string())], ["source", "path", "records", "bytes", "error"])

    _made(folder)
    n = max(1, archives.count())
    return saved(archives.select("path").repartition(n).mapInArrow(body, "source string, path string, records long, bytes long, error string"))


def _made(folder: str) -> None:
    store, base = _store(folder)
    store.create_dir(base, recursive=True)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """``(path)`` of the archives in a folder, as for ``normalise``."""
    from pyarrow import fs

    store, base = _store(folder)
    found = [(f.base_name,) for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(SUFFIX)]
    return spark.createDataFrame(found, "path string")


def sweep(made: DataFrame, folder: str) -> int:
    """Delete the files in ``folder`` that belong to no archive of ``made(path)``: what lost attempts have left."""
    from pyarrow import fs

    store, base = _store(folder)
    there = [f.base_name for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.endswith((SUFFIX, SIDECAR))]
    good = {r.path.removesuffix(SUFFIX) for r in made.select("path").toLocalIterator()}
    strays = [f for f in there if f.removesuffix(SUFFIX).removesuffix(SIDECAR) not in good]
    for f in strays:
        store.delete_file(f"{base}/{f}")
    return len(strays)


def delete_folder(folder: str) -> None:
    store, base = _store(folder)
    store.delete_dir(base)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of a folder as one table: ``path`` and the columns of ``INDEX``."""
    lines = spark.read.schema(INDEX).option("pathGlobFilter", f"*{SIDECAR}").json(folder)
    return lines.select(F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.cdxj$", SUFFIX).alias("path"), *[x.split()[0] for x in INDEX.split(", ")])


def _members(rows: list[dict], store, base: str) -> Iterator[tuple[dict, bytes]]:
    """Inflated records; neighbours in an archive are read at once, up to ``PIECE`` bytes."""
    i = 0
    while i < len(rows):
        first, j = rows[i], i + 1
        end = first["offset"] + first["length"]
        while j < len(rows) and rows[j]["path"] == first["path"] and rows[j]["offset"] == end and end + rows[j]["length"] - first["offset"] <= PIECE:
            end += rows[j]["length"]
            j += 1
        with store.open_input_file(f"{base}/{first['path']}") as f:
            raw = f.read_at(end - first["offset"], first["offset"])
        for r in rows[i:j]:
            at = r["offset"] - first["offset"]
            yield r, zlib.decompress(raw[at : at + r["length"]], GZIP)
        i = j


def _page(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else urn


def unpacked_record(raw: bytes) -> dict:
    """Head fields, payload and its digest. A response's digest is taken from its payload; a revisit has that of what it stands for."""
    end = raw.index(b"\r\n\r\n") + 4
    fields = parsed(raw[:end])
    block = raw[end : end + int(fields["content-length"])]
    cut = block.find(b"\r\n\r\n")
    http, payload = (block[:cut], block[cut + 4 :]) if cut >= 0 else (block, b"")
    told = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    out = {"id": _page(fields.get("warc-record-id")), "uri": fields.get("warc-target-uri"), "type": fields.get("warc-type"), "refers_to": _page(fields.get("warc-refers-to"))}
    if out["type"] == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        return out | {"payload": None, "payload_bytes": int(length[1]) if length else None, "digest": told, "intact": True}
    digest = hashlib.sha256(payload).hexdigest()
    return out | {"payload": payload, "payload_bytes": len(payload), "digest": digest, "intact": digest == told}


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of ``index(path, offset, length)`` out of the normalised archives of ``folder``, by offset.

    ``(path, offset, id, uri, type, refers_to, payload_bytes, digest, intact)`` and, if asked for, ``payload`` (null for revisits); ``intact`` is whether
    a response's payload has the digest that its head tells. Any part of an index will do, so records can be chosen, and an archive is read by as many
    tasks as it has spans of ``SPAN_BYTES``: the number of tasks follows the bytes to be read, not those of the index.
    """
    kinds = {"path": "string", "offset": "long", "id": "string", "uri": "string", "type": "string", "refers_to": "string", "payload_bytes": "long", "digest": "string", "intact": "boolean"}
    kinds |= {"payload": "binary"} if payloads else {}
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}

    def body(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for b in batches:
            rows, held = [], 0
            for place, raw in _members(b.to_pylist(), store, base):
                rows.append(place | unpacked_record(raw))
                held += len(raw)
                if held > 4 * PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[k]) for n, k in kinds.items()], list(kinds))
                    rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[k]) for n, k in kinds.items()], list(kinds))

    total = index.agg(F.sum("length")).first()[0] or 0
    spans = index.select("path", "offset", "length").repartition(1 + 2 * total // SPAN_BYTES, F.col("path"), F.expr(f"offset div {SPAN_BYTES}")).sortWithinPartitions("path", "offset")
    return spans.mapInArrow(body, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def new_folder(spark: SparkSession) -> str:
    """A folder for archives beside the tables between steps."""
    return f"{shared_base(spark)}/brindle-warc-{uuid.uuid4().hex}"


def through_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every row, written as monolithic archives, normalised and read back.

    A null payload is an empty one; a null id stays null, and is what nothing refers to; repeated rows are repeated records; other columns are ignored; an empty table gives
    an empty result. What was read is a written table, and the archives are deleted; keep them by calling the steps. Torn archives and payloads that
    do not have their digest are errors here.
    """
    spark = pages.sparkSession
    kind = pages.select(F.col(f"`{id_col}`")).dtypes[0][1]
    whole, parted = new_folder(spark), new_folder(spark)
    roles = payload_roles(pages, id_col, url_col, payload_col)
    wrote = write_archives(roles, whole)
    done = normalise(wrote, whole, parted)
    torn = done.where("error is not null").first()
    if torn:
        raise ValueError(f"{torn.source}: {torn.error}")
    sweep(done, parted)
    discard(roles, wrote, done)
    delete_folder(whole)
    back = read_records(read_index(spark, parted), parted, payloads=False)
    checked = F.when(F.col("intact"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ: "), F.coalesce("id", F.lit("no id")))))
    out = saved(back.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", checked.alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to")))
    delete_folder(parted)
    return out
