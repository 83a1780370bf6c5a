"""Web archives: pages written as segmented WARC records with chunked payloads, and put together again from the files.

Writing decides response or revisit by digest, cuts each response's block into segments of about `SEGMENT` bytes (a response record and
continuations that name it as their origin) and writes records as text files through Spark. Reading splits the files into records by their
content lengths, groups continuations by origin, orders them by segment number, verifies numbers, flags and total length, decodes the chunked
transfer framing and checks the payload digest.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import NO_ID, give_back, id_or_none, materialize, none_again

SEGMENT = 65_536
CHUNK = 16_384
REVISIT_FROM = 100
RECORDS_PER_FILE = 4_000
RECORD_END = "\r\n\r\n"
NAMESPACE = uuid.UUID("6f1b1a52-94e5-4d7c-8f4e-0d7a5c1f2b3d")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
READ_SCHEMA = (
    "record_id string, type string, target string, page_id long, origin string, segment long, total long, refers_to string, payload_digest string, block binary"
)


def new_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def payload_id(digest: str) -> str:
    """The id of the one response with a payload of REVISIT_FROM bytes or more, known to its revisits without looking it up."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, digest)}>"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing; cuts at characters so that every piece stays valid UTF-8."""
    out, at = [], 0
    while at < len(body):
        end = _character_end(body, at + size)
        out.append(b"%x\r\n%s\r\n" % (end - at, body[at:end]))
        at = end
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body of chunked framing, extensions and trailers read over. Raises ValueError when it is cut off or followed by other bytes."""
    out, at = [], 0
    while True:
        eol = data.index(b"\r\n", at)
        size = int(data[at:eol].split(b";")[0].strip(), 16)
        at = eol + 2
        if size == 0:
            while (eol := data.index(b"\r\n", at)) > at:
                at = eol + 2
            if eol + 2 != len(data):
                raise ValueError("bytes behind the last chunk")
            return b"".join(out)
        out.append(data[at : at + size])
        if len(out[-1]) != size or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        at += size + 2


def _character_end(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def _record(headers: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n{block.decode('utf-8', 'surrogatepass')}"


def response_records(page_id: int, url: str, payload: bytes, digest: str, segment: int = SEGMENT) -> list[str]:
    """A response whose HTTP block is cut into segments: the first record and its continuations."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = [0]
    while cuts[-1] < len(block):
        cuts.append(_character_end(block, cuts[-1] + segment))
    parts = [block[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    origin, out = payload_id(digest) if len(payload) >= REVISIT_FROM else new_id(), []
    for n, part in enumerate(parts, 1):
        headers = [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", origin if n == 1 else new_id()), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), ("X-Page-ID", page_id)]
        if n == 1:
            headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
        else:
            headers += [("WARC-Segment-Origin-ID", origin)]
        if len(parts) > 1:
            headers += [("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)]
        out.append(_record(headers, part))
    return out


def revisit_record(page_id: int, url: str, digest: str) -> str:
    headers = [
        ("WARC-Type", "revisit"), ("WARC-Record-ID", new_id()), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), ("X-Page-ID", page_id), ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", payload_id(digest)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of an archive file (plain or gzip, one member or many), by their content lengths, unpacked as they are read."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while version := stream.readline():
        if not version.startswith(b"WARC/1."):
            raise ValueError(f"no record begins with {version[:20]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[name.lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield {"head": head, "block": block}


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response block, its chunked framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else body


def decide(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload_digest and `again`, whether the row is written as a revisit; html is empty on those.

    Of the rows with one payload of REVISIT_FROM bytes or more the one with the smallest page_id is the response; a row without an id stands before all
    ids, so it is the response where there is one. Digests are counted with map-side
    combine, and the join back can be split where one payload is common. Rows that share that page_id too are gathered by address and count,
    and one with the smallest address responds; that path is planned only where there are such rows.
    """
    digest = F.sha2(F.col("html").cast("binary"), 256)
    rows = pages.withColumn("payload_digest", digest)
    slim = rows.where(F.octet_length("html") >= REVISIT_FROM).groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    low = F.min(F.struct("page_id", "n"))
    shared = slim.groupBy("payload_digest").agg(low["page_id"].alias("first"), low["n"].alias("ties"), F.sum("n").alias("all")).where("all > 1").drop("all")
    shared = materialize(shared, "payloads")
    joined = rows.join(shared, "payload_digest", "left")
    ties = shared.where("ties > 1")
    columns = ["page_id", "url", "payload_digest", "again", "html"]

    def marked(df: DataFrame, again) -> DataFrame:
        return df.withColumn("again", again).withColumn("html", F.when(F.col("again"), "").otherwise(F.col("html"))).select(*columns)

    if ties.isEmpty():
        return marked(joined, F.coalesce(F.col("first") != F.col("page_id"), F.lit(False)))
    tied = rows.join(ties.select("payload_digest", F.col("first").alias("page_id")), ["payload_digest", "page_id"])
    tied = tied.groupBy("payload_digest", "page_id", "url").agg(F.count("*").alias("n"), F.min("html").alias("html"))
    chosen = tied.groupBy("payload_digest").agg(F.min("url").alias("least"))
    copies = tied.join(chosen, "payload_digest").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    plain = joined.where("ties is null or ties = 1 or page_id != first")
    return marked(plain, F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))).unionByName(marked(copies, (F.col("url") != F.col("least")) | (F.col("copy") > 1)))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id") -> None:
    """Write one response or revisit per row of pages(page_id, url, html), in segments where it is long, to gzip text files below `path`.

    Null html is an empty payload, a null url an empty address, a null id the smallest long. Every row is a page of its own: rows that repeat an id, or
    all columns, are written and read back as often as they come. Other columns are not stored; an empty table makes archives without records."""
    rows = pages.select(
        id_or_none(id_col).alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                out = []
                for x in pdf.iloc[lo : lo + 256].itertuples(index=False):
                    if x.again:
                        out.append(revisit_record(x.page_id, x.url, x.payload_digest))
                    else:
                        out += response_records(x.page_id, x.url, x.html.encode("utf-8", "surrogatepass"), x.payload_digest)
                yield pd.DataFrame({"value": out})
        give_back()

    written = decide(rows).mapInPandas(records, "value string")
    written.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_records(spark, path: str) -> DataFrame:
    """All records of the archive files below `path`, one row each. Continuations have an origin; a damaged file fails the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for r in parse_records(content):
                    h = r["head"]
                    number = h.get("warc-segment-number")
                    total = h.get("warc-segment-total-length")
                    rows.append(
                        (
                            h["warc-record-id"], h["warc-type"], h.get("warc-target-uri", ""), int(h.get("x-page-id", NO_ID)), h.get("warc-segment-origin-id", h["warc-record-id"]), int(number or 0),
                            int(total or -1), h.get("warc-refers-to"), h.get("warc-payload-digest", "").rpartition(":")[2] or None, r["block"],
                        )
                    )
                    if len(rows) >= 1000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)
        give_back()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInPandas(run, READ_SCHEMA)


def reassemble(records: DataFrame) -> DataFrame:
    """(record_id, target, payload_digest, block): responses with their segments put together.

    Whole records pass by without a shuffle. Segments meet by origin: their numbers must run from 1 without gaps or repeats, one alone, the last,
    must give the total length, and the bytes must add up to it; anything else raises an error that names the origin."""
    whole = records.where("type = 'response' and segment = 0").select("record_id", "page_id", "target", "payload_digest", "block")
    pieces = records.where("type in ('response', 'continuation') and segment > 0")
    part = F.struct("segment", "total", "block")
    grouped = pieces.groupBy("origin").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max(F.when(F.col("segment") == 1, F.col("target"))).alias("target"),
        F.max(F.when(F.col("segment") == 1, F.col("payload_digest"))).alias("payload_digest"),
    )
    n = F.size("parts")
    numbers = F.transform("parts", lambda p: p["segment"]) == F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("long"))
    closed = F.exists(F.slice("parts", n, 1), lambda p: p["total"] >= 0) & (F.size(F.filter("parts", lambda p: p["total"] >= 0)) == 1)
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    sound = numbers & closed & (size == F.col("total"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"]))
    checked = F.when(sound, joined).otherwise(F.raise_error(F.concat(F.lit("segments do not make a record: "), F.col("origin"))).cast("binary"))
    return whole.unionByName(grouped.select(F.col("origin").alias("record_id"), "page_id", "target", "payload_digest", checked.alias("block")))


def responses(records: DataFrame) -> DataFrame:
    """(record_id, page_id, target, payload, payload_digest) of every response, its payload checked against the digest of its header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                payloads = [http_payload(b) for b in part["block"]]
                for name, p, d in zip(part["record_id"], payloads, part["payload_digest"], strict=True):
                    if hashlib.sha256(p).hexdigest() != d:
                        raise ValueError(f"wrong payload digest of {name}")
                yield pd.DataFrame({"record_id": part["record_id"], "page_id": part["page_id"], "target": part["target"], "payload": payloads, "payload_digest": part["payload_digest"]})
        give_back()

    return reassemble(records).mapInPandas(run, "record_id string, page_id long, target string, payload binary, payload_digest string")


def page_digests(records: DataFrame) -> DataFrame:
    """One row per page of an archive made by write_archives, from what the records say: payload size and digest of the full payload (a revisit takes them
    from the response it refers to), type, and the page referred to. No revisit is lost: one whose response is missing, or has another payload, raises an
    error that names it. An id that is null stays null, as page_id and as refers_to; no records give no rows."""
    found = responses(records).select("record_id", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    own = found.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = records.where("type = 'revisit'").select("page_id", F.col("refers_to").alias("record_id"), F.col("payload_digest").alias("told"))
    origin = found.select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    lost = F.raise_error(F.concat(F.lit("no response with its payload for a revisit of "), F.coalesce("record_id", F.lit("no record"))))
    digest = F.when(F.col("told") == F.col("payload_digest"), F.col("payload_digest")).otherwise(lost.cast("string"))
    seen = again.join(origin, "record_id", "left").withColumn("payload_digest", digest)
    revisits = seen.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return own.unionByName(revisits).withColumns({"page_id": none_again("page_id"), "refers_to": none_again("refers_to")})
