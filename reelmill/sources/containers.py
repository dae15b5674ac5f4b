"""Containers: HLV1 and BPV1 streams, Y4M, AVI, MP4/3GP sample tables, WAV. Each parser yields one row a packet, frame or sample."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary import FormatError, big, need, uint

# Fixed values of the HLV1 container.
HLV_MAGIC, HLV_PACKET_MAGIC, HLV_VERSIONS, HLV_AUDIO = b"HLV1", b"FRM1", (14, 15), {0: "none", 1: "pcm_u8", 2: "ima_adpcm"}
HLV_KINDS = {0: "K", 1: "P", 2: "R"}

HLV_HEADER = "version int, flags int, width int, height int, fps_num int, fps_den int, frame_count long, gop int, quality int, search_radius int, audio_codec string, audio_rate int, audio_channels int"
HLV_PACKET = "packet long, offset long, kind string, q_y int, q_uv int, q_shift int, bit_length long, payload_size long, video_bytes long, audio_bytes long, payload binary"


def hlv_header(data: bytes) -> tuple:
    need(len(data) > 0, "EOF", "empty file")
    need(len(data) >= 28, "IO", "short header")
    need(data[:4] == HLV_MAGIC and data[4] in HLV_VERSIONS and data[22] == 16 and data[27] == 0, "FORMAT", "not a known HLV1 header")
    width, height, num, den = (uint(data, at, 2) for at in (6, 8, 10, 12))
    codec, rate, channels = data[23], uint(data, 24, 2), data[26]
    need(width and height and num and den and not data[5] & ~1, "FORMAT", "zero size or rate, or unknown flags")
    need((codec in (1, 2) and rate and channels == 1) if data[5] & 1 else not (codec or rate or channels), "FORMAT", "audio fields")
    return (data[4], data[5], width, height, num, den, uint(data, 14, 4), uint(data, 18, 2), data[20], data[21], HLV_AUDIO[codec], rate, channels)


def hlv_headers(data: bytes) -> Iterator[tuple]:
    yield hlv_header(data)


def hlv_packets(data: bytes) -> Iterator[tuple]:
    """Packets to the end of the file; the bits of video fill the first bytes of a payload, audio the rest."""
    hlv_header(data)
    at, n = 28, 0
    while at < len(data):
        need(at + 20 <= len(data), "IO", "short packet header")
        need(data[at : at + 4] == HLV_PACKET_MAGIC, "FORMAT", f"no packet at {at}")
        kind, q_y, q_uv, shift = data[at + 4 : at + 8]
        bits, size, crc = (uint(data, at + k, 4) for k in (8, 12, 16))
        need(kind in HLV_KINDS and q_y and q_uv and shift <= 3 and bits <= 8 * size and size <= 1 << 30, "FORMAT", f"packet header at {at}")
        payload = data[at + 20 : at + 20 + size]
        need(len(payload) == size, "IO", "short payload")
        need(zlib.crc32(payload) == crc, "CRC", f"payload at {at + 20}")
        video = (bits + 7) // 8
        yield (n, at, HLV_KINDS[kind], q_y, q_uv, shift, bits, size, video, size - video, payload)
        at, n = at + 20 + size, n + 1


def write_hlv(header: dict, packets: list[dict]) -> bytes:
    """A whole file from fields named as the scans name them; frame_count is taken from the packets."""
    codec = {v: k for k, v in HLV_AUDIO.items()}[header.get("audio_codec", "none")]
    le = lambda v, n: int(v).to_bytes(n, "little")
    out = HLV_MAGIC + bytes([header.get("version", 15), 1 if codec else 0])
    out += b"".join(le(header[k], 2) for k in ("width", "height", "fps_num", "fps_den")) + le(len(packets), 4) + le(header.get("gop", 0), 2)
    out += bytes([header.get("quality", 0), header.get("search_radius", 0), 16, codec]) + le(header.get("audio_rate", 0), 2) + bytes([1 if codec else 0, 0])
    hlv_header(out)
    kinds = {v: k for k, v in HLV_KINDS.items()}
    for p in packets:
        payload = bytes(p["payload"])
        out += HLV_PACKET_MAGIC + bytes([kinds[p["kind"]], p["q_y"], p["q_uv"], p.get("q_shift", 0)]) + le(p.get("bit_length", 8 * len(payload)), 4) + le(len(payload), 4) + le(zlib.crc32(payload), 4) + payload
    return out


Y4M_FRAME = "frame long, width int, height int, fps_num int, fps_den int, y binary, u binary, v binary"


def y4m_frames(data: bytes) -> Iterator[tuple]:
    """8-bit 4:2:0 frames of even size."""
    end = data.find(b"\n", 0, 4096)
    need(data.startswith(b"YUV4MPEG2 ") and end > 0, "FORMAT", "no YUV4MPEG2 line")
    width = height = num = den = 0
    chroma = False
    for token in data[10:end].decode("ascii", "replace").split(" "):
        tag, value = token[:1], token[1:]
        if tag in ("W", "H"):
            need(value.isdigit(), "FORMAT", f"token {token}")
            width, height = (int(value), height) if tag == "W" else (width, int(value))
        elif tag == "F":
            parts = value.split(":")
            need(len(parts) == 2 and all(p.isdigit() for p in parts), "FORMAT", f"token {token}")
            num, den = map(int, parts)
        elif tag == "C":
            chroma = value.startswith("420")
    need(width and height and num and den and chroma and width % 2 == 0 and height % 2 == 0, "FORMAT", "size, rate or chroma")
    luma, at, n = width * height, end + 1, 0
    while at < len(data):
        end = data.find(b"\n", at, at + 4096)
        need(data.startswith(b"FRAME", at) and end > 0, "FORMAT", f"no FRAME at {at}")
        at = end + 1
        need(at + luma * 3 // 2 <= len(data), "IO", f"frame {n} is cut short")
        u = at + luma
        yield (n, width, height, num, den, data[at:u], data[u : u + luma // 4], data[u + luma // 4 : u + luma // 2])
        at, n = u + luma // 2, n + 1


def write_y4m(width: int, height: int, num: int, den: int, frames: list[tuple[bytes, bytes, bytes]]) -> bytes:
    return f"YUV4MPEG2 W{width} H{height} F{num}:{den} Ip A1:1 C420jpeg\n".encode() + b"".join(b"FRAME\n" + y + u + v for y, u, v in frames)


# Fixed values of the BPV1 container: first versions with audio, palettes at keyframes and two-bit modes; mode names.
BPV_MAGIC, BPV_AUDIO_FROM, BPV_PALETTE_FROM, BPV_FOUR_MODES_FROM = b"BPV1", 3, 4, 6
BPV_MODES = ("skip", "motion", "blockDictionary", "patternDictionary", "raw", "rawDirect")
BPV_FRAME = "frame long, version int, width int, height int, fps_num int, fps_den int, keyframe boolean, frame_bytes long, audio_bytes long, mode_bytes long, modes map<string,long>, payload binary"


def bpv_header(data: bytes) -> dict:
    need(data[:4] == BPV_MAGIC, "FORMAT", "not BPV1")
    version = uint(data, 4, 1)
    need(1 <= version <= 7, "FORMAT", f"version {version}")
    names = (("width", 2), ("height", 2), ("frames", 4), ("fps_num", 2), ("fps_den", 2), ("key_interval", 2), ("block_entries", 2), ("pattern_entries", 2), ("radius", 1), ("codec", 1))
    out, at = {"version": version}, 5
    for name, size in names:
        out[name] = uint(data, at, size)
        at += size
    rate = channels = 0
    rest = out["codec"]
    if version >= BPV_AUDIO_FROM:
        rate, channels, rest = uint(data, at, 2), uint(data, at + 2, 1), uint(data, at + 3, 1)
        at += 4
        need((out["codec"], rate, channels) == (0, 0, 0) or (out["codec"] in (1, 2) and rate and channels == 1), "RANGE", "audio format")
    else:
        out["codec"] = 0
    four = version >= BPV_FOUR_MODES_FROM
    need(rest == 0, "RANGE", "reserved byte")
    need(all(out[k] for k in ("width", "height", "frames", "fps_num", "fps_den", "key_interval", "block_entries")), "RANGE", "zero field")
    need((out["pattern_entries"] == 0 and out["radius"] <= 7) if four else out["pattern_entries"], "RANGE", "dictionary or radius")
    need(version < 7 or (out["width"] % 4 == 0 and out["height"] % 4 == 0), "RANGE", "size isn't whole blocks")
    palette = (16 if version == 1 else 64) * 48
    if version < BPV_PALETTE_FROM:
        need(at + palette <= len(data), "IO", "palette")
        at += palette
    return out | {"rate": rate, "start": at, "palette": palette, "mode_bits": 2 if four else 3}


def mode_list(packed: bytes, blocks: int, bits: int) -> np.ndarray:
    """The mode of each block from a map of `bits` bits a block, most significant bit first."""
    flat = np.unpackbits(np.frombuffer(packed, "u1"))[: blocks * bits].reshape(blocks, bits)
    return flat @ (1 << np.arange(bits)[::-1])


def mode_counts(packed: bytes, blocks: int, bits: int) -> list[int]:
    return np.bincount(mode_list(packed, blocks, bits), minlength=8).tolist()


def bpv_frames(data: bytes) -> Iterator[tuple]:
    """Frames with their mode histogram; a keyframe's palettes, where the version has them there, precede its mode map."""
    h = bpv_header(data)
    blocks = -(-h["width"] // 4) * -(-h["height"] // 4)
    want, at = -(-blocks * h["mode_bits"] // 8), h["start"]
    samples = -(-h["rate"] * h["fps_den"] // h["fps_num"]) if h["codec"] else 0
    need(h["codec"] != 2 or samples <= 4096, "RANGE", "audio block")
    most = {0: 0, 1: samples, 2: 6 + samples // 2}[h["codec"]]
    for n in range(h["frames"]):
        key, size, modes = uint(data, at, 1) != 0, uint(data, at + 1, 4), uint(data, at + 5, 4)
        audio = uint(data, at + 9, 4) if h["version"] >= BPV_AUDIO_FROM else 0
        at += 13 if h["version"] >= BPV_AUDIO_FROM else 9
        need(audio <= most, "RANGE", f"audio of frame {n}")
        need(at + size + audio <= len(data), "IO", f"frame {n} is cut short")
        need(modes == want and (n or key), "RANGE", f"mode map of frame {n}, or no keyframe first")
        skip = h["palette"] if key and h["version"] >= BPV_PALETTE_FROM else 0
        need(skip + modes <= size, "RANGE", f"mode map exceeds frame {n}")
        width = h["mode_bits"]
        count = mode_counts(data[at + skip : at + skip + modes], blocks, width)
        need(not any(count[4 if width == 2 else 6 :]), "RANGE", f"mode of frame {n}")
        yield (n, h["version"], h["width"], h["height"], h["fps_num"], h["fps_den"], key, size, audio, modes, {m: c for m, c in zip(BPV_MODES, count, strict=False) if c}, data[at : at + size])
        at += size + audio
    need(at == len(data), "RANGE", "data after the last frame")


AVI_HEADER = "microseconds_per_frame long, frames long, video_stream int, handler string, compression string, scale long, rate long, length long, width int, height int, audio_stream int, format_tag int, channels int, sample_rate long, block_align int, bits_per_sample int, samples_per_block int, movi_start long, movi_end long, fps_num long, fps_den long"
AVI_PACKET = "packet long, offset long, size long, kind string, stream int"


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, payload offset, size) of each chunk; odd sizes are padded."""
    while at + 8 <= end:
        size = uint(data, at + 4, 4)
        yield data[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


def avi_header(data: bytes) -> dict:
    """Of the first video and the first audio stream; the walk ends at the movie list."""
    need(len(data) >= 12, "IO", "short RIFF header")
    need(data[:4] == b"RIFF" and data[8:12] == b"AVI ", "FORMAT", "not AVI")
    end = 8 + uint(data, 4, 4)
    out: dict = {}
    for name, at, size in _chunks(data, 12, min(end, len(data) + 8)):
        need(at + size <= end, "FORMAT", "chunk exceeds the file")
        kind = data[at : at + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            number = 0
            for inner, p, n in _chunks(data, at + 4, at + size):
                need(p + n <= at + size, "FORMAT", "header chunk exceeds its list")
                if inner == b"avih":
                    need(n >= 20, "FORMAT", "avih")
                    out |= {"us": uint(data, p, 4), "main": uint(data, p + 16, 4)}
                elif inner == b"LIST" and data[p : p + 4] == b"strl":
                    _stream(data, p + 4, p + n, number, out)
                    number += 1
        elif kind == b"movi":
            out |= {"movi": at + 4, "movi_end": at + size}
            break
    need("video" in out and out.get("movi_end", 0) > out.get("movi", 0), "FORMAT", "no video stream or movie list")
    return out


def _stream(data: bytes, at: int, end: int, number: int, out: dict) -> None:
    head = form = None
    for name, p, n in _chunks(data, at, end):
        need(p + n <= end, "FORMAT", "stream chunk exceeds its list")
        if name == b"strh":
            need(n >= 48, "FORMAT", "strh")
            head = data[p : p + n]
        elif name == b"strf":
            form = data[p : p + n]
    if head and head[:4] == b"vids" and "video" not in out:
        need(form is not None and len(form) >= 20, "FORMAT", "video format")
        height = abs(int.from_bytes(form[8:12], "little", signed=True))
        width = uint(form, 4, 4)
        need(0 < width < 1 << 16 and 0 < height < 1 << 16, "RANGE", "video size")
        out["video"] = {"stream": number, "handler": head[4:8].decode("latin-1"), "compression": form[16:20].decode("latin-1"), "scale": uint(head, 20, 4), "rate": uint(head, 24, 4), "length": uint(head, 32, 4), "width": width, "height": height}
    elif head and head[:4] == b"auds" and "audio" not in out:
        need(form is not None and len(form) >= 16, "FORMAT", "audio format")
        block = uint(form, 18, 2) if len(form) >= 20 and uint(form, 16, 2) >= 2 else None
        out["audio"] = {"stream": number, "tag": uint(form, 0, 2), "channels": uint(form, 2, 2), "rate": uint(form, 4, 4), "align": uint(form, 12, 2), "bits": uint(form, 14, 2), "block": block}


def avi_rate(video: dict, us: int, frames: int = 0) -> tuple[int, int]:
    """Frames a second as a reduced fraction: rate * frames / (scale * length) where all are known, else 1e6 / microseconds."""
    num, den = (video["rate"] * (frames or 1), video["scale"] * (video["length"] if frames else 1)) if video["rate"] and video["scale"] else (1_000_000, us)
    need(num and den, "RANGE", "frame rate")
    g = gcd(num, den)
    return num // g, den // g


def avi_headers(data: bytes) -> Iterator[tuple]:
    h = avi_header(data)
    v, a = h["video"], h.get("audio", {})
    yield (h.get("us", 0), h.get("main", 0), v["stream"], v["handler"], v["compression"], v["scale"], v["rate"], v["length"], v["width"], v["height"],
           a.get("stream"), a.get("tag"), a.get("channels"), a.get("rate"), a.get("align"), a.get("bits"), a.get("block"), h["movi"], h["movi_end"], *avi_rate(v, h.get("us", 0)))


def avi_packets(data: bytes) -> Iterator[tuple]:
    """Video and audio chunks of the chosen streams; record lists are entered, empty and foreign chunks passed over."""
    h = avi_header(data)
    video, audio = h["video"]["stream"], h.get("audio", {}).get("stream")
    at, n = h["movi"], 0
    while at < h["movi_end"] and at + 8 <= len(data):
        name, size = data[at : at + 4], uint(data, at + 4, 4)
        if name == b"LIST" and data[at + 8 : at + 12] == b"rec ":
            at += 12
            continue
        try:
            stream = int(name[:2], 16)
        except ValueError:
            stream = -1
        kind = "V" if stream == video and name[2:] in (b"dc", b"db") else "A" if stream == audio and name[2:] == b"wb" else None
        if kind and size:
            need(at + 8 + size <= len(data), "IO", f"chunk at {at} is cut short")
            yield (n, at + 8, size, kind, stream)
            n += 1
        at += 8 + size + (size & 1)


def write_avi(width: int, height: int, num: int, den: int, packets: list[tuple[str, bytes]], code: bytes = b"MJPG", rate: int = 8000) -> bytes:
    """A file of (V or A, payload) packets in order, with 8-bit mono PCM as audio and an index."""
    le = lambda *v: b"".join(int(x).to_bytes(4, "little") for x in v)
    chunk = lambda name, data: name + le(len(data)) + data + b"\0" * (len(data) & 1)
    n = sum(k == "V" for k, _ in packets)
    most = max((len(d) for _, d in packets), default=0)
    main = chunk(b"avih", le(1_000_000 * den // num, 0, 0, 16, n, 0, 2, most, width, height) + bytes(16))
    video = chunk(b"strh", b"vids" + code + le(0, 0, 0, den, num, 0, n, most, 0, 0) + bytes(8)) + chunk(b"strf", le(40, width, height) + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + code + bytes(20))
    form = b"".join(int(v).to_bytes(k, "little") for v, k in ((1, 2), (1, 2), (rate, 4), (rate, 4), (1, 2), (8, 2)))
    sound = chunk(b"strh", b"auds" + bytes(4) + le(0, 0, 0, 1, rate, 0, 0, most, 0, 1) + bytes(8)) + chunk(b"strf", form)
    head = chunk(b"LIST", b"hdrl" + main + chunk(b"LIST", b"strl" + video) + chunk(b"LIST", b"strl" + sound))
    body, index = b"movi", b""
    for kind, data in packets:
        name = b"00dc" if kind == "V" else b"01wb"
        index += name + le(16 if kind == "V" else 0, len(body), len(data))
        body += chunk(name, data)
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", body) + chunk(b"idx1", index))


AVI_INDEX = "entry long, chunk string, flags long, offset long, size long"


def avi_index(data: bytes) -> Iterator[tuple]:
    """Entries of idx1, if there is one."""
    need(data[:4] == b"RIFF" and data[8:12] == b"AVI ", "FORMAT", "not AVI")
    for name, at, size in _chunks(data, 12, len(data)):
        if name == b"idx1":
            for i in range(min(size, len(data) - at) // 16):
                p = at + 16 * i
                yield (i, data[p : p + 4].decode("latin-1"), uint(data, p + 4, 4), uint(data, p + 8, 4), uint(data, p + 12, 4))


MP4_TABLE = "track int, handler string, format string, table string, entry long, a long, b long, c long"


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size, head = big(data, at, 4), 8
        if size == 1:
            size, head = big(data, at + 8, 8), 16
        elif size == 0:
            size = end - at
        need(size >= head and at + size <= end, "FORMAT", f"box at {at}")
        yield data[at + 4 : at + 8], at + head, at + size
        at += size


def _box(data: bytes, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    for want in path:
        for name, a, b in _boxes(data, at, end):
            if name == want:
                at, end = a, b
                break
        else:
            return None
    return at, end


def mp4_tables(data: bytes) -> Iterator[tuple]:
    """Sample tables of every track, a row an entry: stsz (size), chunk (offset), stsc (first chunk, samples, description), stts
    (count, delta) and mdhd (timescale, duration)."""
    moov = _box(data, 0, len(data), b"moov")
    need(moov, "FORMAT", "no moov box")
    track = 0
    for name, a, b in _boxes(data, *moov):
        if name != b"trak":
            continue
        stbl, hdlr, mdhd = (_box(data, a, b, *p) for p in ((b"mdia", b"minf", b"stbl"), (b"mdia", b"hdlr"), (b"mdia", b"mdhd")))
        need(stbl and hdlr and mdhd, "FORMAT", f"track {track} lacks a table")
        kind = data[hdlr[0] + 8 : hdlr[0] + 12].decode("latin-1")
        stsd = _box(data, *stbl, b"stsd")
        form = data[stsd[0] + 12 : stsd[0] + 16].decode("latin-1") if stsd else None
        wide = data[mdhd[0]] == 1
        at = mdhd[0] + (20 if wide else 12)
        yield (track, kind, form, "mdhd", 0, big(data, at, 4), big(data, at + 4, 8 if wide else 4), None)
        for box, label, width in ((b"stsz", "stsz", 4), (b"stco", "chunk", 4), (b"co64", "chunk", 8), (b"stsc", "stsc", 12), (b"stts", "stts", 8)):
            found = _box(data, *stbl, box)
            if not found:
                continue
            at, end = found
            fixed = big(data, at + 4, 4) if label == "stsz" else 0
            n = big(data, at + (8 if label == "stsz" else 4), 4)
            at += 12 if label == "stsz" else 8
            need(fixed or at + n * width <= end, "FORMAT", f"{label} exceeds its box")
            for i in range(n):
                p = at + i * width
                values = (fixed,) if fixed else (big(data, p, width),) if width in (4, 8) and label != "stts" else tuple(big(data, p + k, 4) for k in range(0, width, 4))
                yield (track, kind, form, label, i, *values, *[None] * (3 - len(values)))
        track += 1


WAV = "format_tag int, channels int, sample_rate long, block_align int, bits int, data_offset long, data_size long, data binary"


def wav(data: bytes) -> Iterator[tuple]:
    need(data[:4] == b"RIFF" and data[8:12] == b"WAVE", "FORMAT", "not WAVE")
    form = None
    for name, at, size in _chunks(data, 12, len(data)):
        if name == b"fmt ":
            need(size >= 16, "FORMAT", "fmt")
            form = (uint(data, at, 2), uint(data, at + 2, 2), uint(data, at + 4, 4), uint(data, at + 12, 2), uint(data, at + 14, 2))
        elif name == b"data":
            need(form is not None, "FORMAT", "data before fmt")
            yield (*form, at, min(size, len(data) - at), data[at : at + size])
            return
    raise FormatError("FORMAT: no data chunk")


FRAMED = "record long, offset long, seq int, size int, valid boolean, payload binary"


def write_framed(records: list[tuple[int, bytes]], magic: bytes = b"SWPB") -> bytes:
    """Records (seq, payload) one after the other."""
    le = lambda v, n: int(v).to_bytes(n, "little")
    return b"".join(magic + le(seq, 2) + le(len(p), 2) + le(zlib.crc32(p), 4) + p for seq, p in records)


def framed(data: bytes, magic: bytes = b"SWPB") -> Iterator[tuple]:
    """Records magic, seq u16, size u16, crc32, payload anywhere in noise. After a bad checksum the search goes on one byte later."""
    at = n = 0
    while (at := data.find(magic, at)) >= 0 and at + 12 <= len(data):
        seq, size, crc = uint(data, at + 4, 2), uint(data, at + 6, 2), uint(data, at + 8, 4)
        payload = data[at + 12 : at + 12 + size]
        valid = len(payload) == size and zlib.crc32(payload) == crc
        yield (n, at, seq, size, valid, payload)
        n, at = n + 1, at + (12 + size if valid else 1)


LISTING = "name string, size long"
LISTING_MAGIC = b"HLVL"


def listing(data: bytes) -> Iterator[tuple]:
    """Names and sizes of a directory listing: records magic, seq u32, size u32, name length u8, crc32 of both parts, name.

    Records come in order; a repeated one is passed over, a damaged one or one too early is looked past, since it is sent again. A
    record without a name ends the listing and gives their number; names come in case-folded order.
    """
    found: list[tuple] = []
    at = 0
    while (at := data.find(LISTING_MAGIC, at)) >= 0 and at + 17 <= len(data):
        seq, size, length, crc = uint(data, at + 4, 4), uint(data, at + 8, 4), data[at + 12], uint(data, at + 13, 4)
        name = data[at + 17 : at + 17 + length]
        if len(name) < length or zlib.crc32(name, zlib.crc32(data[at : at + 13])) != crc or seq > len(found):
            at += 1
            continue
        at += 17 + length
        if seq < len(found):
            continue
        if not length and size == len(found):
            yield from sorted(found, key=lambda f: f[0].casefold())
            return
        try:
            text = name.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if text and "\0" not in text:
            found.append((text, size))
    raise FormatError("EOF: the listing has no end")


def listing_bytes(files: list[tuple[str, int]]) -> bytes:
    """A whole listing of (name, size)."""
    out = b""
    for seq, (name, size) in enumerate([*files, ("", len(files))]):
        raw = name.encode()
        head = LISTING_MAGIC + seq.to_bytes(4, "little") + size.to_bytes(4, "little") + bytes([len(raw)])
        out += head + zlib.crc32(raw, zlib.crc32(head)).to_bytes(4, "little") + raw
    return out


# Four-character codes by which AVI files name each video codec.
DIVX3_CODES = ("DIV3", "MP43", "DIV4", "DIV5", "DIV6", "AP41", "COL1", "COL0", "MPG3", "DVX3", "3IV1", "3IVD")
MJPEG_CODES = ("MJPG",)


def avi_adapter(headers: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """Rows of an avi_headers() scan that a player of these codes takes: with audio ("none", "pcm_u8" or "ima_adpcm"), and whether the
    file is accepted. Audio in another format is left out; PCM must be 8-bit mono, ADPCM 4-bit mono with one sample in a block's head
    and two a byte after it, up to 48 kHz, or the file is refused. samples_per_block is 1 for PCM."""
    tag, align, block = F.col("format_tag"), F.col("block_align"), F.col("samples_per_block")
    kind = F.when(tag == 1, "pcm_u8").when(tag == 0x11, "ima_adpcm").otherwise("none")
    pcm = (F.col("bits_per_sample") == 8) & (align == 1)
    adpcm = (F.col("bits_per_sample") == 4) & (align > 4) & (block == 2 * (align - 4) + 1)
    good = (F.col("channels") == 1) & F.col("sample_rate").between(1, 48000) & F.when(tag == 1, pcm).otherwise(adpcm)
    out = headers.where(F.upper("compression").isin(*codes)).withColumn("audio", kind)
    out = out.withColumn("accepted", (F.col("audio") == "none") | F.coalesce(good, F.lit(False)))
    return out.withColumn("samples_per_block", F.when(F.col("audio") == "pcm_u8", 1).when(F.col("audio") == "ima_adpcm", block))
