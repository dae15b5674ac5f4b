"""Palette video (BPV1 versions 6 and 7): frames to RGB565 pixels, a group of frames a time.

State, the previous frame and the block dictionary, starts anew at each keyframe, so groups of frames decode in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from ..sources.binary import FormatError, need
from ..sources.containers import mode_list

#: Entries of the block dictionary unless the caller says otherwise.
ENTRIES = 256


class Decoder:
    """Decodes the payloads of one group in order. A block is its palette and sixteen colour numbers in it."""

    def __init__(self, version: int, width: int, height: int, entries: int = ENTRIES):
        if version not in (6, 7):
            raise FormatError(f"RANGE: version {version} isn't decoded")
        self.version, self.width, self.height, self.entries = version, width, height, entries
        self.across, self.down = -(-width // 4), -(-height // 4)
        self.blocks = self.pixels = None
        self.held: list[bytes] = []

    def frame(self, key: bool, data: bytes) -> np.ndarray:
        at, n = 0, self.across * self.down
        if key:
            self.palette = np.frombuffer(data[:3072], "u1").reshape(64, 16, 3).astype(np.uint16)
            need(len(data) >= 3072, "IO", "palette")
            at, self.blocks, self.pixels, self.held = 3072, None, None, []
            r, g, b = (self.palette[..., i] for i in range(3))
            self.colours = ((r & 0xF8) << 8 | (g & 0xFC) << 3 | b >> 3).astype(np.uint16)
        size = -(-n * 2 // 8)
        modes = mode_list(data[at : at + size], n, 2)
        at += size
        blocks, pixels = [b""] * n, np.zeros((4 * self.down, 4 * self.across), np.uint16)
        for k, mode in enumerate(modes.tolist()):
            x, y = 4 * (k % self.across), 4 * (k // self.across)
            if mode == 0:
                need(self.pixels is not None, "RANGE", "skip without a frame before")
                dx = dy = 0
            elif mode == 1:
                need(self.pixels is not None and at < len(data), "RANGE", "motion without a frame before")
                dx, dy = ((v ^ 8) - 8 for v in (data[at] >> 4, data[at] & 15))
                need(dx != -8 and dy != -8, "RANGE", "motion vector")
                at += 1
            if mode < 2:
                if self.version == 7:
                    need(0 <= x + dx <= self.width - 4 and 0 <= y + dy <= self.height - 4, "RANGE", "motion leaves the frame")
                    pixels[y : y + 4, x : x + 4] = self.pixels[y + dy : y + dy + 4, x + dx : x + dx + 4]
                else:
                    bx, by = k % self.across + dx, k // self.across + dy
                    need(0 <= bx < self.across and 0 <= by < self.down, "RANGE", "motion leaves the frame")
                    blocks[k] = self.blocks[by * self.across + bx]
            elif mode == 2:
                need(at + 2 <= len(data), "IO", "dictionary index")
                slot = data[at] | data[at + 1] << 8
                need(slot < len(self.held), "RANGE", "dictionary index")
                blocks[k], at = self.held[slot], at + 2
            else:
                blocks[k], at = self._raw(data, at)
                if blocks[k] not in self.held:
                    self.held = [*self.held[1 if len(self.held) >= self.entries else 0 :], blocks[k]]  # the oldest makes room
            if blocks[k]:
                pixels[y : y + 4, x : x + 4] = self.colours[blocks[k][0], list(blocks[k][1:])].reshape(4, 4)
        need(at == len(data), "RANGE", "bytes after the last block")
        self.blocks, self.pixels = blocks, pixels
        return pixels[: self.height, : self.width]

    def _raw(self, data: bytes, at: int) -> tuple[bytes, int]:
        """A block in full: one, two or up to four colours of a palette with a pattern of 0, 1 or 2 bits, or sixteen numbers."""
        need(at < len(data), "IO", "raw block")
        kind, palette = data[at] >> 6, data[at] & 63
        size = (2, 4, 7, 9)[kind]
        body = data[at + 1 : at + size]
        need(len(body) == size - 1, "IO", "raw block")
        nibbles = [v for b in body for v in (b >> 4, b & 15)]
        if kind == 3:
            need(5 <= len(set(nibbles)) <= 16, "RANGE", "direct block isn't canonical")
            return bytes([palette, *nibbles]), at + size
        bits, skip = (0, 1, 2)[kind], (1, 1, 2)[kind]
        local = mode_list(body[skip:], 16, bits).tolist() if bits else [0] * 16
        used = max(local) + 1
        need(set(local) == set(range(used)) and used in ((1,), (2,), (3, 4))[kind] and (kind != 2 or used == 4 or nibbles[3] == 0), "RANGE", "raw block isn't canonical")
        return bytes([palette, *(nibbles[v] for v in local)]), at + size


def decode(frames: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """file, frame, width, height, pixels (little-endian RGB565) from the frames of the BPV1 scan."""
    ship(frames.sparkSession)
    w = Window.partitionBy("file").orderBy("frame")
    groups = frames.withColumn("gop", F.sum(F.col("keyframe").cast("int")).over(w))
    cols = ["file", "gop", "frame", "version", "width", "height", "keyframe", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = decoder = None
        for batch in batches:
            out = []
            for file, gop, _, version, width, height, key, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, gop) != now:
                    now, decoder = (file, gop), Decoder(version, width, height, entries)
                out.append(decoder.frame(key, payload).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(4), batch.column(5), pa.array(out, pa.binary())], names=["file", "frame", "width", "height", "pixels"])

    return groups.select(*cols).repartition("file", "gop").sortWithinPartitions("file", "gop", "frame").mapInArrow(run, "file string, frame long, width int, height int, pixels binary")
