"""Ordered folds whose next decision depends on the last one.

Each fold is a plain class with one method, step(record) -> dict, so the same code serves batch (`fold`: one sorted pass over each key's
rows) and streaming (reelmill.streaming). A key is serial by nature; keys run in parallel. A task holds one Arrow batch and one
state at a time, whatever the length of a key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], make: Callable, schema: str) -> DataFrame:
    """keys, order and the columns that step() returns for each row. make() gives a new state when a key begins."""
    ship(df.sparkSession)
    kinds = df.select(*keys, *order).schema
    out_schema = df.sparkSession.createDataFrame([], schema).schema
    full = type(kinds)([*kinds.fields, *out_schema.fields])
    names, k = [f.name for f in full], len(keys)
    lead = k + len(order)
    at = [(c, (keys + order + columns).index(c)) for c in dict.fromkeys(order + columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        now = state = None
        types = [to_arrow_type(f.dataType) for f in out_schema.fields]
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            made = []
            for row in zip(*cols, strict=True):
                if state is None or row[:k] != now:
                    now, state = row[:k], make()
                made.append(state.step({c: row[i] for c, i in at}))
            arrays = [*batch.columns[:lead], *(pa.array([m[f.name] for m in made], t) for f, t in zip(out_schema.fields, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = df.select(*keys, *order, *[c for c in columns])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, full)


class GopPlanner:
    """Cuts before a row if its group is full, or long enough and the row's score reaches the threshold; where both hold, the
    reason is the scene. A null score is no scene."""

    def __init__(self, least: int, most: int, threshold: float, score: str = "score"):
        self.least, self.most, self.threshold, self.score = least, most, threshold, score
        self.length = self.group = 0

    def step(self, row: dict) -> dict:
        value = row[self.score]
        first = self.length == 0
        full = self.length >= self.most
        scene = self.length >= self.least and value is not None and value >= self.threshold
        if not first and (full or scene):
            self.group, self.length = self.group + 1, 0
        self.length += 1
        why = None if self.length > 1 else "initial" if first else "scene" if scene else "maximum"
        return {"gop": self.group, "reason": why}


class LeakyBucket:
    """Rate control with an integer quantizer. The excess goes into a buffer, which then leaks; the next quantizer follows the size
    ratio, damped more after a keyframe, and the buffer. It moves by one at least if the excess is over 8 % of the target.
    A null size is zero."""

    def __init__(self, target: float, window: float = 24.0, start: int = 32, most: int = 255, size: str = "size", key: str = "key"):
        self.target, self.window, self.q, self.most, self.size, self.key, self.buffer = target, window, start, most, size, key, 0.0

    def step(self, row: dict) -> dict:
        used, size = self.q, float(row[self.size] or 0)
        excess = size - self.target
        self.buffer = (self.buffer + excess) * (1 - 1 / self.window)
        gain = 0.06 if row[self.key] else 0.16
        pull = gain * math.log((size + 1) / (self.target + 1)) + 0.22 * (self.buffer / (self.target * self.window + 1))
        following = int(self.q * min(1.25, max(0.8, math.exp(pull))) + 0.5)
        if following == self.q and abs(excess) > 0.08 * self.target:
            following += 1 if excess > 0 else -1
        self.q = min(self.most, max(1, following))
        return {"q_used": used, "buffer": self.buffer, "q_next": self.q}


class WindowDebt:
    """Two-pass windows that repay their debt: half of it, at most a quarter of the nominal size, comes off the next target. The error
    is against the nominal size. A null size is zero."""

    def __init__(self, nominal: float, size: str = "size"):
        self.nominal, self.size, self.debt = nominal, size, 0.0

    def step(self, row: dict) -> dict:
        part = min(0.25 * self.nominal, max(-0.25 * self.nominal, 0.5 * self.debt))
        goal = min(1.5 * self.nominal, max(0.5 * self.nominal, self.nominal - part))
        excess = float(row[self.size] or 0) - self.nominal
        self.debt = min(2 * self.nominal, max(-2 * self.nominal, self.debt + excess))
        return {"target": goal, "error": excess / (self.nominal + 1), "debt": self.debt}


class SlewLimit:
    """Follows a signal, falling at most `down` and rising at most `up` a step."""

    def __init__(self, down: float = 0.90, up: float = 0.25, value: str = "value"):
        self.down, self.up, self.value, self.level = down, up, value, None

    def step(self, row: dict) -> dict:
        v = row[self.value]
        if v is not None:
            self.level = float(v) if self.level is None else min(self.level + self.up, max(self.level - self.down, float(v)))
        return {"smoothed": self.level}


class CatchUp:
    """Late-frame policy. A late predicted frame right before a keyframe isn't shown, and the keyframe is awaited; `patience` late
    predicted frames in a row lead to the same wait. While it lasts, predicted frames are skipped; the keyframe ends it. late_run
    is the count after the row; a late keyframe, a frame in time and a wait's begin before a keyframe set it to zero."""

    def __init__(self, patience: int = 3, late: str = "late", key: str = "key", key_next: str = "key_next"):
        self.patience, self.late, self.key, self.key_next, self.run, self.waiting = patience, late, key, key_next, 0, False

    def step(self, row: dict) -> dict:
        late, key = row[self.late], row[self.key]
        show = True
        if late and not key and row[self.key_next]:
            self.run, self.waiting, show = 0, True, False
        elif self.waiting:
            show = bool(key)
            if key:
                self.run, self.waiting = 0, False
        else:
            self.run = self.run + 1 if late and not key else 0
            self.waiting = self.run >= self.patience
        return {"action": "show" if show else "skip", "late_run": self.run}


class Reservoir:
    """Algorithm R with a xorshift64* generator: says whether a row is taken, and into which place. The last row taken into a
    place is the sample's."""

    MASK, MULTIPLIER = (1 << 64) - 1, 2685821657736338717

    def __init__(self, size: int, seed: int = 88172645463325252):
        self.size, self.state, self.seen = size, seed, 0

    def _next(self) -> int:
        x = self.state
        x ^= x >> 12
        x ^= (x << 25) & self.MASK
        x ^= x >> 27
        self.state = x
        return x * self.MULTIPLIER & self.MASK

    def step(self, row: dict) -> dict:
        place = self.seen if self.seen < self.size else self._next() % (self.seen + 1)
        self.seen += 1
        return {"place": place if place < self.size else None, "nth": self.seen}


class FifoDictionary:
    """A bounded dictionary of distinct entries that evicts the oldest: whether an entry is there, and its index from the oldest."""

    def __init__(self, most: int = 256, entry: str = "entry"):
        self.most, self.entry, self.held = most, entry, []

    def step(self, row: dict) -> dict:
        e = row[self.entry]
        if e in self.held:
            return {"hit": True, "slot": self.held.index(e)}
        self.held.append(e)
        if len(self.held) > self.most:
            self.held.pop(0)
        return {"hit": False, "slot": None}


class KeyInterval:
    """Adaptive keyframes: forced at the longest interval, refused under the shortest while motion is small, else by cost."""

    def __init__(self, least: int, most: int, calm: float, bias: float = 1.0):
        self.least, self.most, self.calm, self.bias, self.since = least, most, calm, bias, None

    def step(self, row: dict) -> dict:
        if self.since is None or self.since >= self.most:
            key = True
        elif self.since < self.least and row["mad"] < self.calm:
            key = False
        else:
            key = row["k_cost"] <= row["p_cost"] * self.bias
        self.since = 1 if key else self.since + 1
        return {"keyframe": key}
