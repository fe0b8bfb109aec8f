"""Media columns: byte payloads as 8-bit samples in Ogg, written, verified and read back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples a second, samples in a packet (79 lacing values, so packets run over pages), lacing values in a page, logical streams.
RATE, PACKET, LACING, STREAMS = 8000, 20_000, 64, 2
UNIT = 64
_HEAD = struct.Struct("<4sBBqIIIB")
_FIRST = struct.Struct("<5sBBIIQ")
_MAGIC = b"\x01pcm8"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 of Ogg (polynomial 0x04c11db7, most significant bit first, nothing inverted), by way of zlib's mirrored one."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def padded(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def _pages(serial: int, packets: list[bytes], samples: list[int]) -> Iterator[bytes]:
    """Pages of one logical stream; packets run over page ends. samples: granule position at the end of each packet."""
    lacing, body, last, granule, number, begun = [], bytearray(), False, -1, 0, False

    def page(flags: int) -> bytes:
        nonlocal number
        head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + bytes(lacing)
        number += 1
        whole = head + bytes(body)
        return whole[:22] + page_crc(whole).to_bytes(4, "little") + whole[26:]

    for k, packet in enumerate(packets):
        at, full = 0, False
        while not full:
            piece = packet[at : at + 255]
            lacing.append(len(piece))
            body += piece
            at += len(piece)
            full = len(piece) < 255
            if full:
                granule = samples[k]
            last = full and k == len(packets) - 1
            if len(lacing) == LACING or last or (full and k == 0):  # the header packet has a page of its own
                yield page((1 if begun else 0) | (2 if number == 0 else 0) | (4 if last else 0))
                lacing, body, granule, begun = [], bytearray(), -1, not full


def write(payload: bytes) -> bytes:
    """One Ogg file: packets of PACKET samples are dealt to STREAMS logical streams, whose pages alternate."""
    first = zlib.crc32(payload)
    streams = []
    for k in range(STREAMS):
        blocks = [payload[i : i + PACKET] for i in range(k * PACKET, len(payload), STREAMS * PACKET)]
        ends = np.cumsum([0, *map(len, blocks)]).tolist()
        header = _FIRST.pack(_MAGIC, STREAMS, k, RATE, PACKET, len(payload))
        streams.append(list(_pages((first + k) & 0xFFFFFFFF, [header, *blocks], ends)))
    out = [pages[0] for pages in streams]  # the first pages of all streams lead
    for i in range(1, max(map(len, streams))):
        out += [pages[i] for pages in streams if i < len(pages)]
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: whole packets, each with the granule position of the page it ends on if it is the last to end there, else None."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    part: bytearray | None = None
    next: int = 0


def demux(media: bytes) -> tuple[list[Stream], list[str]]:
    """The logical streams of any Ogg file, in order of their first pages, and what is wrong with it.

    Streams may be interleaved or chained (a serial number may come again after its end), packets may run over any number of pages. A page
    whose checksum fails is skipped up to the next one; where pages are missing or out of order the packets they cut are left out.
    """
    streams, running, errors, at = [], {}, [], 0
    while at < len(media):
        start = media.find(b"OggS", at)
        if start != at:
            errors.append(f"no page at byte {at}")
            if start < 0:
                break
            at = start
        end = at + 27 + media[at + 26] if len(media) >= at + 27 else len(media) + 1
        lacing = media[at + 27 : end]
        body, end = end, end + sum(lacing)
        if end > len(media) or media[at + 4]:
            errors.append(f"the page at byte {at} is cut off" if end > len(media) else f"version of the page at byte {at}")
            at += 4
            continue
        _, _, flags, granule, serial, number, crc, _ = _HEAD.unpack_from(media, at)
        if page_crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            errors.append(f"checksum of the page at byte {at}")
            at += 4
            continue
        at, s = end, running.get(serial)
        if flags & 2:
            if s and not s.ended:
                errors.append(f"stream {serial} begins again before its end")
            s = running[serial] = Stream(serial, next=number)
            streams.append(s)
        if s is None or s.ended:
            errors.append(f"a page of stream {serial} before its beginning or after its end")
            continue
        if number != s.next:
            errors.append(f"page order in stream {serial}")
            s.part = None
        lost = bool(flags & 1) and s.part is None
        if bool(flags & 1) != (s.part is not None) and number == s.next:
            errors.append(f"continuation in stream {serial}")
        part = s.part if flags & 1 and s.part is not None else bytearray()
        s.next, s.ended, s.pages, done = number + 1, bool(flags & 4), s.pages + 1, []
        for value in lacing:
            part += media[body : body + value]
            body += value
            if value < 255:
                if not lost:
                    done.append(bytes(part))
                part, lost = bytearray(), False
        s.part = part if lacing and lacing[-1] == 255 and not lost else None
        if (granule == -1) != all(x == 255 for x in lacing):
            errors.append(f"granule position of a page of stream {serial}")
        s.packets += done
        s.granules += [None] * (len(done) - 1) + [granule] if done else []
    errors += [f"stream {s.serial} doesn't end" for s in streams if not s.ended or s.part is not None]
    return streams, errors


def read(media: bytes) -> dict:
    """Verify and demultiplex an Ogg file made of 8-bit samples.

    Gives ``payload``, ``pages``, ``packets``, ``streams``, ``seconds`` (of the longest stream), ``times`` (start of
    each packet in seconds, in the order of the payload) and ``error`` ('' if every checksum, page number,
    lacing and granule position holds; else what is wrong, with an empty payload).
    """
    try:
        return _read(media)
    except (ValueError, struct.error, IndexError) as e:
        return {"payload": b"", "pages": 0, "packets": 0, "streams": 0, "seconds": 0.0, "times": [], "error": str(e) or type(e).__name__}


def _read(media: bytes) -> dict:
    streams, errors = demux(media)
    if errors or not streams:
        raise ValueError(errors[0] if errors else "no page")
    blocks, seconds, total = [], 0.0, -1
    for s in streams:
        magic, of, k, rate, size, total = _FIRST.unpack(s.packets[0])
        if magic != _MAGIC or of != len(streams):
            raise ValueError("not the header of a sample stream")
        ends = s.granules
        for i in range(len(ends) - 2, -1, -1):  # a page gives the position of its last packet; a sample is a byte, so the others lie before it
            if ends[i] is None:
                ends[i] = ends[i + 1] - len(s.packets[i + 1])
        for i, (packet, end) in enumerate(zip(s.packets[1:], ends[1:], strict=True)):
            if end - len(packet) != i * size:
                raise ValueError("granule positions and packet lengths differ")
            blocks.append((i * of + k, (end - len(packet)) / rate, packet))
        seconds = max(seconds, ends[-1] / rate)
    blocks.sort(key=lambda b: b[0])
    payload = b"".join(b[2] for b in blocks)
    if len(payload) != total:
        raise ValueError("packets are missing")
    pages = sum(s.pages for s in streams)
    return {"payload": payload, "pages": pages, "packets": len(blocks), "streams": len(streams), "seconds": seconds, "times": [b[1] for b in blocks], "error": ""}


def feature(payload: bytes) -> str:
    """Level, power, zero crossings and entropy of 8-bit samples around 128."""
    if not payload:
        return ""
    samples = np.frombuffer(payload, np.uint8)
    centred = samples.astype(np.float64) - 128
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    crossings = int(np.count_nonzero(np.diff(centred >= 0)))
    return f"mean={centred.mean():.4f};rms={np.sqrt((centred**2).mean()):.4f};peak={int(np.abs(centred).max())};crossings={crossings};entropy={-(share * np.log2(share)).sum():.4f}"


_PARTS = "payload binary, pages int, packets int, streams int, seconds double, last_time double, feature string, error string"


def _write(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: write(padded((t or "").encode())))


def _parse(media: pd.Series) -> pd.DataFrame:
    rows = [read(m) if m is not None else read(b"OggS") for m in media]
    for r in rows:
        r["last_time"] = r["times"][-1] if r["times"] else 0.0
        r["feature"] = feature(r["payload"])
    names = ["payload", "pages", "packets", "streams", "seconds", "last_time", "feature", "error"]
    return pd.DataFrame({k: [r[k] for r in rows] for k in names})


_STREAM = "serial long, pages int, ended boolean, packets array<binary>, granules array<long>"


def _demuxed(media: pd.Series) -> pd.DataFrame:
    rows = [demux(m) if m is not None else ([], ["no file"]) for m in media]
    return pd.DataFrame({
        "streams": [[{"serial": s.serial, "pages": s.pages, "ended": s.ended, "packets": s.packets, "granules": s.granules} for s in streams] for streams, _ in rows],
        "errors": [errors for _, errors in rows],
    })


def ogg_streams(media: Column) -> Column:
    """The logical streams of a column of any Ogg files: struct of streams (serial, pages, ended, packets, granules) and errors.

    Granules are null for packets that others follow on their page. A damaged file gives the packets that are whole; a null one none.
    """
    return F.pandas_udf(_demuxed, f"streams array<struct<{_STREAM.replace(' ', ': ')}>>, errors array<string>".replace(",: ", ", "))(media)


def ogg_of_text(text: Column) -> Column:
    """Ogg file (binary) of a text's UTF-8 bytes, zero-padded to a positive multiple of 64; a null text is empty.

    Any length will do, equal texts give equal files. Being a column expression, it leaves other columns and their names alone.
    """
    return F.pandas_udf(_write, "binary")(text)


def ogg_parts(media: Column) -> Column:
    """What a media column holds: struct of payload, pages, packets, streams, seconds, last_time, feature and error.

    A damaged or null file gives an empty payload and says why in ``error``.
    """
    return F.pandas_udf(_parse, _PARTS)(media)
