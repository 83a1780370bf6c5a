"""Ogg media columns: texts or other payloads stored as 8-bit samples in checksummed pages, and read back.

A file holds two logical streams: `audio`, the samples in packets of PACKET bytes behind one header packet, and `notes`, a small packet of
text. Pages of both are interleaved. Reading verifies each page's checksum and sequence number, joins packets from their lacing values across
pages, parts the streams by serial number and derives the time of each packet from granule positions (samples so far, at the header's rate): a page
tells the samples up to the end of its last packet, and the packets that end on it are counted back from there.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import give_back, id_or_none, none_again, text_or_empty

RATE = 8000
PACKET = 4000
UNIT = 64
AUDIO, NOTES = 0x41554449, 0x4E4F5445
MAGIC = b"PCM8\x01"
NO_GRANULE = (1 << 64) - 1
CONTINUED, FIRST, LAST = 1, 2, 4
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, start and final value zero: the reflected CRC of zlib over bytes
    with their bits reversed, its result reversed."""
    c = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_FLIP), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIII", b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    page = head + body
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one stream: packets with their end granules, laced into up to 255 segments a page; a packet may run over pages."""
    segments: list[tuple[int, bytes, int]] = []  # lacing value, bytes, granule if the packet ends here or -1
    for data, granule in packets:
        whole = len(data) // 255
        for i in range(whole):
            segments.append((255, data[255 * i : 255 * i + 255], -1))
        segments.append((len(data) - 255 * whole, data[255 * whole :], granule))
    out, at, inside = [], 0, False
    first = True
    while at < len(segments):
        # the header packet has the first page to itself
        take = next(i + 1 for i, s in enumerate(segments) if s[2] >= 0) if first else 255
        part = segments[at : at + take]
        ends = [g for _, _, g in part if g >= 0]
        flags = (CONTINUED if inside else 0) | (FIRST if first else 0) | (LAST if at + take >= len(segments) else 0)
        out.append(_page(serial, len(out), flags, ends[-1] if ends else NO_GRANULE, bytes(s[0] for s in part), b"".join(s[1] for s in part)))
        inside, first = part[-1][2] < 0, False
        at += take
    return out


def encode(samples: bytes, notes: bytes = b"") -> bytes:
    """An Ogg file of two interleaved streams."""
    packets = [(MAGIC + struct.pack("<IQ", RATE, len(samples)), 0)]
    for i in range(0, len(samples), PACKET):
        packets.append((samples[i : i + PACKET], min(len(samples), i + PACKET)))
    streams = [_pages(AUDIO, packets), _pages(NOTES, [(b"NOTE\x01", 0), (notes, 0)])]
    pages = []
    for i in range(max(map(len, streams))):
        pages += [s[i] for s in streams if i < len(s)]
    return b"".join(pages)


def decode(data: bytes) -> dict[int, list[tuple[bytes, int, int]]]:
    """Packets by serial number, each with the granule of the page it ends on and the number of packets that end behind it on that page.
    Raises ValueError for a damaged file."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(data):
        magic, version, flags, granule, serial, number, checksum = struct.unpack_from("<4sBBQIII", data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        count = data[at + 26]
        lacing = data[at + 27 : at + 27 + count]
        size = 27 + count + sum(lacing)
        page = data[at : at + size]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        s = streams.setdefault(serial, {"next": 0, "open": b"", "inside": False, "packets": [], "over": False})
        if number != s["next"] or bool(flags & CONTINUED) != s["inside"] or bool(flags & FIRST) != (number == 0) or s["over"]:
            raise ValueError(f"page {number} of stream {serial:#x} does not follow")
        s["next"] += 1
        s["over"] = bool(flags & LAST)
        behind = sum(value < 255 for value in lacing)
        if (granule == NO_GRANULE) != (behind == 0):
            raise ValueError(f"page {number} of stream {serial:#x} has no granule for its packets, or one without")
        cursor = 27 + count
        parts = [s["open"]]
        for value in lacing:
            parts.append(page[cursor : cursor + value])
            cursor += value
            s["inside"] = value == 255
            if not s["inside"]:
                behind -= 1
                s["packets"].append((b"".join(parts), granule, behind))
                parts = []
        s["open"] = b"".join(parts)
        at += size
    if any(not s["over"] or s["inside"] for s in streams.values()):
        raise ValueError("a stream is cut off")
    return {serial: s["packets"] for serial, s in streams.items()}


def packet_ends(packets: list[tuple[bytes, int, int]]) -> list[int]:
    """Where each packet of a sample stream ends, in samples: its page's granule less the samples of the packets that end behind it on the page."""
    ends = [0] * len(packets)
    for i in range(len(packets) - 1, -1, -1):
        data, granule, behind = packets[i]
        ends[i] = ends[i + 1] - len(packets[i + 1][0]) if behind else granule
    return ends


def timed_packets(data: bytes) -> tuple[list[tuple[bytes, float, float]], bytes]:
    """(packets with start and end in seconds, notes) of an Ogg file. Times come from the granules; they must agree with the running sum of the samples
    and with the total of the header, else ValueError."""
    streams = decode(data)
    header, *packets = streams[AUDIO]
    if not header[0].startswith(MAGIC):
        raise ValueError("no sample stream")
    rate, total = struct.unpack_from("<IQ", header[0], len(MAGIC))
    ends = packet_ends(packets)
    sums = np.cumsum([len(p) for p, _, _ in packets]).tolist()
    if ends != sums or (sums[-1] if sums else 0) != total:
        raise ValueError("granule positions and samples disagree")
    return [(p, (end - len(p)) / rate, end / rate) for (p, _, _), end in zip(packets, ends, strict=True)], streams[NOTES][1][0]


def samples_of(data: bytes) -> tuple[bytes, float, bytes]:
    """(samples, seconds, notes) of an Ogg file."""
    packets, notes = timed_packets(data)
    return b"".join(p for p, _, _ in packets), packets[-1][2] if packets else 0.0, notes


def features(samples: bytes, seconds: float, notes: bytes) -> str:
    """Duration, mean level, root mean square around the middle, zero crossings and spectral-like flux of the samples."""
    x = np.frombuffer(samples, dtype=np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int(np.square(x.astype(np.int32) - 128).sum(dtype=np.int64))
    above = x >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    flux = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    n = max(1, len(x))
    return f"seconds={seconds:.6f};mean={total / n:.6f};rms={math.sqrt(square / n):.6f};crossings={crossings};flux={flux / n:.6f};notes={notes.decode()}"


def payload(text: str) -> tuple[bytes, int]:
    """The text in UTF-8 filled with zero bytes to a positive multiple of UNIT, and its unfilled length."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def to_ogg(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as an Ogg file. Null texts count as empty; null ids and repeated rows stay; other columns are ignored."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                filled = [payload(t) for t in part["text"]]
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"], "n_bytes": [n for _, n in filled], "media": [encode(p, b"bytes=%d" % n) for p, n in filled]}
                )
        give_back()

    rows = docs.select(id_or_none(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(write, "doc_id long, n_bytes long, media binary").withColumn("doc_id", none_again())


def from_ogg(media: DataFrame) -> DataFrame:
    """What the stored bytes of to_ogg say, one row per row: digests and features of the samples read back. A damaged file fails the task."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n, data in zip(pdf["n_bytes"], pdf["media"], strict=True):
                samples, seconds, notes = samples_of(data)
                rows.append(
                    (
                        n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(data),
                        hashlib.sha256(data).hexdigest(), features(samples, seconds, notes),
                    )
                )
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")][1:])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out
        give_back()

    return media.withColumn("doc_id", id_or_none()).mapInPandas(read, schema).withColumn("doc_id", none_again())


def media_digests(docs: DataFrame) -> DataFrame:
    """Write every text as media and read the stored bytes back."""
    return from_ogg(to_ogg(docs))
