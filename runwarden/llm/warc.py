"""WARC archives of pages and reading them back by byte ranges.

The index comes first: sizes alone settle the archive, offset and length of every record, and it also has URL
and digest. The archives are then written by Spark's own text writer, one record per row with the
record's closing blank lines as line separator, so a lost task is written again and committed once. Reading
takes any selection of index rows, sorts it by place, joins near ranges into one read and cuts the records
out of it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from runwarden.llm.tables import slices
from runwarden.session import fresh_dir

# Fixed values of the format.
_END = "\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_SHARED_BYTES = 100
ARCHIVE_BYTES = 16 << 20
NEAR_BYTES = 1 << 16  # ranges with at most this gap are read at once
READ_BYTES = 8 << 20  # ranges are joined up to about this length


@dataclass(frozen=True)
class Archives:
    """The index of all records, and the files of the archives by number."""

    index: DataFrame
    files: DataFrame


def _header(kind: Column) -> Column:
    """The record header up to its blank line, of the columns page_id, url, digest, refers_to, payload_bytes."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def urn(number: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">"))

    # a line break in a URL would end its line
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x1f\x7f]", "")
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(_DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(""),
        F.when(revisit, line("WARC-Payload-Length", F.col("payload_bytes").cast("string"))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )


def _described(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.unhex(F.sha2(html, 256)).alias("digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
    )


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> Archives:
    """One record per row of ``pages`` (page_id, url, html); a null html is an empty payload, a null URL an empty one.

    Of equal payloads of at least 100 bytes the smallest page_id gives the response and the others revisit it;
    repeated rows of that page_id all are responses. Rows with a null page_id are written too, and never
    referred to unless all of a group are null (then all are responses). Archives hold about
    ``archive_bytes`` each, by a hash of the page; their number follows the bytes.
    """
    spark, page_kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    folder = fresh_dir(spark, "llm-warc")
    rows = _described(pages)
    total = rows.agg(F.sum(F.col("payload_bytes") + 512)).first()[0] or 0
    archives = max(1, -(-int(total) // archive_bytes))
    archive = F.pmod(F.xxhash64("page_id", "digest"), F.lit(archives)).cast("int").alias("archive")
    keyed = rows.select("page_id", "url", "digest", "payload_bytes", archive)
    shared = (
        keyed.where(F.col("payload_bytes") >= LEAST_SHARED_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first_id")
    )
    later = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(later, "revisit").otherwise("response")
    decided = keyed.join(shared, "digest", "left").select(
        *keyed.columns, kind.alias("record_type"), F.when(later, F.col("first_id")).alias("refers_to")
    )
    _placed(decided).write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")

    # What the index knows of a record and its page meet in the task that writes the archive, where the header is
    # made; pages are shuffled once. Repeated rows of one page come headers first and have equal payloads, so the
    # k-th header and the k-th payload belong together. Payloads are compressed on the way.
    told = ("url", "record_type", "refers_to", "payload_bytes")
    none = {c: F.lit(None).cast(index.schema[c].dataType) for c in told}
    lines = index.select("archive", "page_id", "digest", F.lit(0).alias("part"), *told).withColumn(
        "content", F.lit(None).cast("binary")
    )
    lines = lines.unionByName(
        rows.select(archive, "page_id", "digest", "html")
        .mapInArrow(_packed, f"archive int, page_id {page_kind}, digest binary, content binary")
        .withColumns({"part": F.lit(1), **none})
    )
    # partition k becomes file part-k
    lines = lines.repartitionById(archives, "archive").sortWithinPartitions(*_PLACE, "part", "url")
    header = F.when(F.col("part") == 0, _header(F.col("record_type")).cast("binary")).otherwise(F.col("content"))
    records = lines.select("record_type", header.alias("content")).mapInArrow(_records, "value string")
    records.write.option("lineSep", _END).text(f"{folder}/archives")
    return Archives(index, _files(spark, f"{folder}/archives"))


_PLACE = ("archive", "page_id", "digest")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Archive number and path of the files in the folder; their contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path")
    return listed.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("archive"), "path")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header and payload rows in order to whole records."""
    heads: deque[tuple[bytes, bool]] = deque()
    for batch in batches:
        out = []
        for kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind is not None:
                heads.append((content, kind == "response"))
                continue
            header, full = heads.popleft()
            out.append(header + zlib.decompress(content) if full else header)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 3):
            packed = [zlib.compress(html.encode(), 6) for html in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(packed, pa.binary())], ["archive", "page_id", "digest", "content"]
            )


def _placed(decided: DataFrame) -> DataFrame:
    body = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    header = F.octet_length(_header(F.col("record_type")))
    sized = decided.withColumn("length", (header + body + len(_END)).cast("long"))
    in_archive = (
        Window.partitionBy("archive")
        .orderBy("page_id", "digest", "url")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ends = F.sum("length").over(in_archive)
    return sized.withColumn("offset", (ends - F.col("length")).cast("long"))


_READ = (
    "page_id {id}, url string, record_type string, refers_to {id}, payload_digest string, payload_bytes long, "
    "payload string, intact boolean"
)


def read(
    selected: DataFrame, files: DataFrame, near_bytes: int = NEAR_BYTES, read_bytes: int = READ_BYTES
) -> DataFrame:
    """The records of some index rows (columns page_id, archive, offset, length), read from the archives' files.

    Columns page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for a revisit),
    intact (length and digest of a response are as its header says). Rows are sorted by place; ranges with a gap
    of at most ``near_bytes`` are read at once, up to ``read_bytes``. Repeated index rows give repeated records.
    """
    kind = selected.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str | None, object] = (None, None)
        for path, ranges in _coalesced(batches, near_bytes, read_bytes):
            if opened[0] != path:
                system, inner = fs.FileSystem.from_uri(path)
                opened = path, system.open_input_file(inner)
            start = ranges[0][0]
            data = opened[1].read_at(max(o + n for o, n in ranges) - start, start)
            rows = [_parsed(data[o - start : o - start + n]) for o, n in ranges]
            columns = list(zip(*rows, strict=True))
            kinds = (None, pa.string(), pa.string(), None, pa.string(), pa.int64(), pa.string(), pa.bool_())
            arrays = [
                pa.array(c, k) if k else pa.array(c, pa.string()).cast(of_id) for c, k in zip(columns, kinds, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [x.split()[0] for x in _READ.split(", ")]
    of_id = to_arrow_type(selected.schema["page_id"].dataType)
    places = selected.select("archive", "offset", "length").join(files, "archive")
    places = places.select("path", "offset", "length", F.floor(F.col("offset") / read_bytes).alias("block"))
    spread = places.repartition("path", "block").sortWithinPartitions("path", "offset")
    return spread.select("path", "offset", "length").mapInArrow(run, _READ.format(id=kind))


def _coalesced(
    batches: Iterator[pa.RecordBatch], near: int, most: int
) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Runs of near ranges of one archive."""
    path, ranges, end = None, [], 0
    for batch in batches:
        for where, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            near_enough = where == path and offset - end <= near and offset + length - ranges[0][0] <= most
            if ranges and not near_enough:
                yield path, ranges
                ranges = []
            if not ranges:
                path, end = where, 0
            ranges.append((offset, length))
            end = max(end, offset + length)
    if ranges:
        yield path, ranges


def _parsed(record: bytes) -> tuple:
    head, _, rest = record.partition(_END.encode())
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = fields["WARC-Record-ID"][len("<urn:page:") : -1] or None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "revisit":
        first = fields["WARC-Refers-To"][len("<urn:page:") : -1] or None
        size = int(fields["WARC-Payload-Length"])
        return number, fields["WARC-Target-URI"], "revisit", first, digest, size, None, rest == _END.encode()
    payload = rest[: int(fields["Content-Length"])]
    actual = hashlib.sha256(payload).hexdigest()
    intact = actual == digest and rest[len(payload) :] == _END.encode()
    return number, fields["WARC-Target-URI"], "response", None, actual, len(payload), payload.decode(), intact


def with_payload(records: DataFrame) -> DataFrame:
    """The records with the payload of the response put in for each revisit."""
    responses = records.where("record_type = 'response'")
    responses = responses.groupBy("payload_digest").agg(F.first("payload").alias("full"))
    return (
        records.join(responses, "payload_digest", "left")
        .withColumn("payload", F.coalesce("payload", "full"))
        .select(*records.columns)
    )
