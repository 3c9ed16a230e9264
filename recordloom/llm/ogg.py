"""Media columns in Ogg: 8-bit samples in two logical streams, written as pages and read back.

Reading verifies each page's checksum and sequence number, reassembles packets
from lacing values (a value of 255 goes on, also into the stream's next page),
demultiplexes by serial number and derives each packet's time from the granule
positions, which count samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices

RATE = 8000
PACKET = 4000
UNIT = 64
#: Fixed values of the format.
CAPTURE, CONTINUED, FIRST, LAST, NO_GRANULE = b"OggS", 1, 2, 4, 0xFFFFFFFFFFFFFFFF
_PAGE = struct.Struct("<4sBBQIIIB")
#: The streams' serial numbers: even packets go to the first, odd ones to the second.
SERIALS = (0x52454331, 0x52454332)
_HEAD = struct.Struct("<8sBBII")
_REVERSED = bytes(int(f"{c:08b}"[::-1], 2) for c in range(256))


def checksum(page: bytes) -> int:
    """The format's CRC-32, most significant bit first from 0: zlib's on reversed bits."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


class _Writer:
    def __init__(self, serial: int, stream: int):
        self.serial, self.number, self.samples = serial, 1, 0
        self.lacing, self.body, self.granule, self.continued = b"", b"", NO_GRANULE, False
        head = _HEAD.pack(b"8bitPCM\0", 1, stream, RATE, PACKET)
        self.pages = [_page(FIRST, 0, serial, 0, bytes([len(head)]), head)]

    def flush(self, flags: int = 0) -> None:
        self.pages.append(_page(flags | CONTINUED * self.continued, self.granule, self.serial, self.number, self.lacing, self.body))
        self.number += 1
        self.lacing, self.body, self.granule = b"", b"", NO_GRANULE

    def packet(self, data: bytes) -> None:
        lacing = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        while lacing:
            if len(self.lacing) == 255:
                self.flush()
                self.continued = at > 0
            part = lacing[: 255 - len(self.lacing)]
            n = sum(part) if part[-1] < 255 else 255 * len(part)
            self.lacing += part
            self.body += data[at : at + n]
            at += n
            lacing = lacing[len(part) :]
        self.samples += len(data)
        self.granule = self.samples


def write(payload: bytes) -> bytes:
    """The payload as an Ogg file."""
    writers = [_Writer(serial, i) for i, serial in enumerate(SERIALS)]
    for k, at in enumerate(range(0, len(payload), PACKET)):
        writers[k % 2].packet(payload[at : at + PACKET])
    for w in writers:
        w.flush(LAST)
    heads = [w.pages[0] for w in writers]
    rest = [page for i in range(1, max(len(w.pages) for w in writers)) for w in writers for page in w.pages[i : i + 1]]
    return b"".join([*heads, *rest])


class Packet(NamedTuple):
    data: bytes
    #: Time in seconds at which the packet ends; None if no granule position tells.
    end: float | None


class Stream(NamedTuple):
    head: bytes
    packets: list[Packet]
    pages: int


def read(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of appearance. ValueError says what is wrong with a file."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) - at < _PAGE.size:
            raise ValueError("a page's head is cut off")
        capture, version, flags, granule, serial, number, crc, n = _PAGE.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise ValueError("no page starts here")
        lacing = media[at + _PAGE.size : at + _PAGE.size + n]
        body = at + _PAGE.size + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError("a page is cut off")
        if checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError("a page's checksum is wrong")
        s = streams.get(serial)
        if s is None:
            if not flags & FIRST:
                raise ValueError("a stream lacks its first page")
            s = streams[serial] = {"number": 0, "open": b"", "begun": False, "packets": [], "ended": False}
        if number != s["number"] or s["ended"] or bool(flags & CONTINUED) != s["begun"]:
            raise ValueError("a page is missing or out of order")
        done = 0
        for length in lacing:
            s["open"] += media[body : body + length]
            body += length
            s["begun"] = length == 255
            if not s["begun"]:
                s["packets"].append([s["open"], None])
                s["open"] = b""
                done += 1
        if done and granule != NO_GRANULE:
            # the position is that of the last packet that ends here; those before it end as many samples earlier as follow them
            samples = granule
            for packet in reversed(s["packets"][-done:]):
                packet[1] = samples / RATE
                samples -= len(packet[0])
        s["number"], s["ended"], at = number + 1, bool(flags & LAST), end
    if any(not s["ended"] or s["begun"] for s in streams.values()):
        raise ValueError("a stream lacks its last page")
    return {serial: Stream(s["packets"][0][0], [Packet(*p) for p in s["packets"][1:]], s["number"]) for serial, s in streams.items()}


def payload_of(streams: dict[int, Stream]) -> bytes:
    """The samples of both streams in the order of their packets."""
    a, b = (streams[serial].packets for serial in SERIALS)
    return b"".join(p.data for k in range(len(a)) for p in (*a[k : k + 1], *b[k : k + 1]))


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: the text's UTF-8 (null: empty), filled with zero bytes to a positive multiple of 64, as an Ogg file.

    A row for each row, in no order: repeated rows and null ids stay as they
    are, equal texts give equal media, an empty table stays empty.  No other
    columns come out, so none can clash.
    """

    def run(batches):
        for batch, data, at in slices(batches, "text"):
            raw = data.tobytes()
            media = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                media.append(write(raw[lo:hi] + bytes(UNIT - (hi - lo) if hi - lo < UNIT else -(hi - lo) % UNIT)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def feature(streams: dict[int, Stream]) -> str:
    """Counts, duration and signal figures of a file, as text."""
    samples = np.frombuffer(b"".join(p.data for s in streams.values() for p in s.packets), np.uint8).astype(np.int64) - 128
    seconds = max(p.end for s in streams.values() for p in s.packets)
    crossings = int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())
    pages, packets = sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values())
    return f"streams={len(streams)} pages={pages} packets={packets} seconds={seconds:.6f} mean={samples.mean():.4f} rms={np.sqrt((samples * samples).mean()):.4f} peak={np.abs(samples).max()} crossings={crossings}"


_READ = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("packet_ends", pa.list_(pa.float64())), ("error", pa.string())]


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media's other columns with what its files hold; columns of the new names are replaced.

    A damaged file gives its size, its hash and the error, and nulls for the
    rest; a null file gives nulls only.
    """
    names = [f for f in media.schema if f.name != media_col and f.name not in dict(_READ)]

    def one(data):
        if data is None:
            return (None,) * len(_READ)
        sha = hashlib.sha256(data).hexdigest()
        try:
            streams = read(data)
            if set(streams) != set(SERIALS):
                raise ValueError("other streams than ours")
            payload = payload_of(streams)
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), sha, feature(streams), [p.end for s in streams.values() for p in s.packets], None
        except ValueError as e:
            return None, None, None, len(data), sha, None, None, str(e)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(media_col))
            found = [*zip(*(one(x.as_py()) for x in column))] or [()] * len(_READ)
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in names]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, t) for c, (_, t) in zip(found, _READ))], names=[*(f.name for f in names), *dict(_READ)])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in names)
    return media.mapInArrow(run, fields + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packet_ends array<double>, error string")


def op3_ogg_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = read_media(write_media(docs))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
