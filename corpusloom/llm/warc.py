"""Operator 4: WARC archives, written and read back with boundary-chain verification.

Writing.  Records of equal payloads (SHA-1, at least `revisit_bytes` long) but the one
with the largest id become revisits.  Records are text whose last line break is the
writer's line separator, so Spark's own text writer makes the files, in any store that
Spark can write.  Only files of bounded size are written (`file_rows`, and tasks of
bounded input), so a reader task never holds more than one bounded file.

Reading.  A task cuts its file into chunks and emits a candidate at every record magic:
its offset, its successor (offset + header + declared length + closing line breaks) and
its header fields.  Payloads may hold text that looks like a record; such candidates are
only told apart by the chain of boundaries from the start of the file.  Candidates of a
chunk are first linked inside it: each gets the chunk's exit, the first successor beyond
it.  Pointer jumping over chunk entries then doubles the reach of every entry in each
round until all from the file's start are known; a candidate is kept if it lies on the
chain of a reached entry.  A file whose chain does not end at its last byte is reported
by `broken_files`, and `read_whole` fails on it.  A header may have any length.

Edge cases: null html is an empty payload; a null url or id is left out of the header and
comes back null; rows with equal ids and payloads at the group's largest id are all
responses; payloads with any bytes, WARC magic included, come back byte for byte; an
empty table writes no records and reads as an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.store import folder, save

#: Fixed values of the WARC/1.1 format.
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
DATE = "2024-01-01T00:00:00Z"

#: A broadcast of payload groups holds at most so many rows; beyond it the join shuffles.
BROADCAST_GROUPS = 200_000
CHUNK_BYTES = 1 << 20


def _header(*lines) -> object:
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(line, F.lit("")) for line in lines], F.lit("\r\n"))


def _field(name: str, value) -> object:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def record_types(pages: DataFrame, revisit_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, payload, bytes, digest, refers_to); refers_to is null for responses."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1(F.col("payload").cast("binary"))})
    groups = save(rows.where(F.col("bytes") >= revisit_bytes).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("top"), F.count("*").alias("k")).where("k > 1").select("d", "top"))
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    rows = rows.join(groups, F.col("digest") == F.col("d"), "left")
    return rows.select("page_id", "url", "payload", "bytes", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("top")), F.col("top")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = 1000, file_rows: int = 50_000, **columns: str) -> None:
    """Write one record for each row of pages below `path`."""
    rows = record_types(pages, revisit_bytes, **columns)
    visit = F.col("refers_to").isNotNull()
    body = F.when(visit, F.lit("")).otherwise(F.col("payload"))
    url = F.translate("url", "\r\n", "")  # a header is one line
    record = F.concat(
        _header(
            _field("WARC-Type", F.when(visit, "revisit").otherwise("response")),
            _field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
            _field("WARC-Date", F.lit(DATE)),
            _field("WARC-Target-URI", url),
            _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            _field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
            _field("WARC-Payload-Length", F.col("bytes").cast("string")),
            F.lit("Content-Type: text/html\r\n"),
            _field("Content-Length", F.octet_length(body).cast("string")),
        ),
        body,
        F.lit("\r\n\r"),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", file_rows).text(path)


_CAND = "file string, size long, chunk long, offset long, succ long, leave long, page_id long, url string, record_type string, declared string, refers_to long, payload_bytes long, length long, sha1 string"
_HEAD = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")


def _candidates(chunk_bytes: int, with_payload: bool):
    def parse(data: memoryview, raw: bytes, at: int) -> tuple | None:
        end = raw.find(b"\r\n\r\n", at + 8)
        if end < 0:
            return None
        head = {k.lower(): v for k, v in _HEAD.findall(raw[at + 10 : end + 2])}
        try:
            length = int(head[b"content-length"])
        except (KeyError, ValueError):
            return None
        start = end + 4
        succ = start + length + 4
        if length < 0 or succ > len(raw) or raw[succ - 4 : succ] != b"\r\n\r\n":
            return None
        number = lambda name: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d{1,19})>", head.get(name, b""))) else None
        text = lambda name: head[name].decode("utf-8", "replace") if name in head else None
        body = data[start : start + length]
        claimed = text(b"warc-payload-length")
        return (succ, number(b"warc-record-id"), text(b"warc-target-uri"), text(b"warc-type"), text(b"warc-payload-digest"), number(b"warc-refers-to"), int(claimed) if claimed and claimed.isdigit() else length, length, hashlib.sha1(body).hexdigest(), bytes(body) if with_payload else None)

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                data, found = memoryview(raw), []
                for m in MAGIC.finditer(raw):
                    at = m.start()
                    if (at == 0 or raw[at - 1 : at] == b"\n") and (got := parse(data, raw, at)):
                        found.append((at, *got))
                leave: dict[int, int] = {}
                for f in reversed(found):  # exits of a chunk, from its end to its start
                    leave[f[0]] = leave[f[1]] if f[1] // chunk_bytes == f[0] // chunk_bytes and f[1] in leave else f[1]
                rows = [(path, len(raw), f[0] // chunk_bytes, f[0], f[1], leave[f[0]], *f[2:10]) for f in found]
                names = [c.split()[0] for c in _CAND.split(", ")]
                kinds = {"string": pa.string(), "long": pa.int64()}
                types = [kinds[c.split()[1]] for c in _CAND.split(", ")]
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                if with_payload:
                    names, cols = [*names, "payload"], [*cols, pa.array([f[10] for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def candidates(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_payload: bool = False) -> DataFrame:
    """Every place of every file that parses as a record, with its successor and its chunk's exit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_candidates(chunk_bytes, with_payload), _CAND + ", payload binary" * with_payload)


def chain(cand: DataFrame) -> DataFrame:
    """The candidates that the boundary chain from their file's start reaches.

    Pointer jumping over chunk entries: a jump leads from an entry to the entry of a later
    chunk; marks spread along jumps while jumps double, so a file of k chunks needs about
    log2(k) rounds."""
    entry = cand.select("file", F.col("offset").alias("at"), F.col("leave").alias("to"))
    # only exits can be entries, beside the file's start
    entry = entry.join(entry.select("file", F.col("to").alias("at")).distinct(), ["file", "at"], "left_semi").unionByName(entry.where("at = 0")).distinct()
    jump, marked = save(entry), save(entry.where("at = 0").select("file", "at"))
    known = marked.count()
    while True:
        ahead = jump.join(marked, ["file", "at"]).select("file", F.col("to").alias("at"))
        marked = save(marked.unionByName(ahead.join(entry.select("file", "at"), ["file", "at"], "left_semi")).distinct())
        now = marked.count()
        if now == known:
            break
        known = now
        jump = save(jump.alias("j").join(jump.select("file", F.col("at").alias("mid"), F.col("to").alias("far")).alias("k"), (F.col("j.file") == F.col("k.file")) & (F.col("j.to") == F.col("k.mid")), "left").select("j.file", "j.at", F.coalesce("far", "to").alias("to")))
    # inside a chunk: the records between a reached entry and its exit, one after the other
    start = marked.select("file", F.col("at").alias("offset"), F.lit(True).alias("reached"))
    return _follow(cand.join(start, ["file", "offset"], "left"))


def _follow(cand: DataFrame) -> DataFrame:
    keep = [c for c in cand.columns if c != "reached"]

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["offset"].to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        at, succ = rows["offset"].to_numpy(), rows["succ"].to_numpy()
        on = rows["reached"].fill_null(False).to_numpy(zero_copy_only=False).copy()
        place = {int(o): i for i, o in enumerate(at)}
        for i in range(len(at)):
            if on[i] and int(succ[i]) in place:
                on[place[int(succ[i])]] = True
        return rows.filter(pa.array(on)).select(keep)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cand.schema.fields if f.name != "reached")
    return cand.groupBy("file", "chunk").applyInArrow(run, schema)


def read_warc(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_payload: bool = False) -> DataFrame:
    """The records of the archives below `path`, payloads too on request."""
    return chain(save(candidates(spark, path, chunk_bytes, with_payload)))


def broken_files(records: DataFrame, path: str | None = None) -> DataFrame:
    """Files whose chain of records stops before their last byte; with `path`, also files without any record."""
    ends = records.groupBy("file").agg(F.max("succ").alias("end"), F.first("size").alias("size"))
    if path is not None:
        files = records.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select(F.col("path").alias("file"), F.col("length").alias("size"))
        ends = files.join(ends.drop("size"), "file", "left").select("file", F.coalesce("end", F.lit(0)).alias("end"), "size")
    return ends.where("end < size")


def read_whole(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of `read_warc`; fails if the chain of a file ends early."""
    records = save(read_warc(spark, path, **options))
    broken = broken_files(records, path).limit(5).collect()
    if broken:
        raise ValueError(f"archives whose chain of records ends early: {[(r['file'], r['end'], r['size']) for r in broken]}")
    return records


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    digest = F.when(F.col("record_type") == "response", F.col("sha1")).otherwise(F.substring_index("declared", ":", -1))
    return read_whole(spark, path).select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM p LEFT JOIN g USING (d)
"""
