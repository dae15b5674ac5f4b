"""Searches of an encoder's control, and the transfer of blocks over a lossy line.

Each is plain sequential code over a callable or a record, so that it serves a driver loop over costly trials as well as curves that
are already measured (`nearest_controls`: one task a key, which looks at a few points of its curve).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship


def nearest_control(n: int, rate: Callable[[int], float], target: float) -> tuple[int, int]:
    """(control, trials): of controls 0 .. n - 1, ordered by a rate that rises more or less, the one nearest the target.

    Halving finds where the target would stand; a trial that meets it exactly ends the search. Then the ends and two controls to
    either side of that place are tried, since curves bend. Equal distances go to the larger rate, then to the lower control.
    """
    seen: dict[int, float] = {}

    def at(i: int) -> float:
        if i not in seen:
            seen[i] = rate(i)
        return seen[i]

    low, high = 0, n - 1
    while low <= high:
        middle = (low + high) // 2
        if at(middle) == target:
            return middle, len(seen)
        low, high = (middle + 1, high) if at(middle) < target else (low, middle - 1)
    tried = {0, n - 1} | {i for i in range(low - 2, low + 2) if 0 <= i < n}
    return min(sorted(tried), key=lambda i: (abs(at(i) - target), -at(i))), len(seen)


def nearest_controls(curve: DataFrame, keys: list[str], control: str, rate: str, targets: list[float]) -> DataFrame:
    """keys, target, control, rate, trials: nearest_control() on each key's measured curve, in order of control. Rows with a null
    control or rate are left out; a key without any has no rows. A curve is as long as its control's range."""
    ship(curve.sparkSession)
    rows = curve.where(f"`{control}` IS NOT NULL AND `{rate}` IS NOT NULL").select(*keys, control, rate)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(control, kind="stable")
        values, made = part[rate].tolist(), []
        for t in targets:
            i, trials = nearest_control(len(values), values.__getitem__, t)
            made.append((*part[keys].iloc[0], t, part[control].iloc[i], values[i], trials))
        return pd.DataFrame(made, columns=[*keys, "target", control, rate, "trials"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "target double", f"`{control}` {kinds[control]}", f"`{rate}` {kinds[rate]}", "trials int"])
    return rows.groupBy(*keys).applyInPandas(run, schema)


def best_trial(trials: Iterable[tuple], target: float, floor: float) -> tuple:
    """Of (control, quality, size) the smallest whose quality reaches the floor, ties to the quality nearest the target, then to the
    first; if none does, the best quality."""
    trials = list(trials)
    good = [t for t in trials if t[1] >= floor]
    return min(good, key=lambda t: (t[2], abs(t[1] - target))) if good else max(trials, key=lambda t: t[1])


def weight_search(trial: Callable[[float], tuple[float, float]], target: float, tolerance: float, start: float, most: float, rounds: int, near: float = 0.01) -> tuple:
    """(weight, quality, size) of the smallest trial within tolerance of a target that falls as the weight rises.

    Weight 0 must reach the floor, or it is the answer. The weight then doubles until quality is at the floor or below, and the
    bracket is halved until its ends are `near` or the rounds are used. trial(weight) gives (quality, size) and is asked once a weight.
    """
    done: dict[float, tuple] = {}

    def at(weight: float) -> tuple:
        if weight not in done:
            done[weight] = (weight, *trial(weight))
        return done[weight]

    floor = target - tolerance
    low = at(0.0)
    if low[1] < floor:
        return low
    high = at(start)
    while high[1] > floor and high[0] < most:
        low, high = high, at(min(most, 2.0 * high[0]))
    left = rounds if high[1] <= floor else 0
    while left and abs(high[0] - low[0]) >= near:
        middle = at((low[0] + high[0]) / 2)
        low, high = (middle, high) if middle[1] >= floor else (low, middle)
        left -= 1
    return best_trial(done.values(), target, floor)


def quantizer_search(trial: Callable[[int, float], tuple[float, int]], target: float, first: int, most: int, trials: int, slack: float = 0.01, relaxed: tuple[float, ...] = (0.25, 0.0625)) -> tuple:
    """(q, quality, size, factor): the smallest packet whose quality reaches the target, found within `trials` quantizers.

    With one good and one bad quantizer the gap is halved; before that the next one follows the quality missed or spared, 20 dB for a
    factor of ten, by a step at least and a factor of four at most. If none is good, the best is tried again with the rate's weight
    relaxed, and then q = 1. trial(q, factor) gives (quality, size) with the weight times factor.
    """
    tested: dict[int, tuple] = {}
    good = bad = None
    q = min(max(first, 1), most)

    def rank(t: tuple) -> tuple:
        return (0, t[2], t[1]) if t[1] + slack >= target else (1, -t[1])

    for _ in range(trials):
        if q in tested:
            if good and bad and bad - good > 1:
                q = good + (bad - good) // 2
            elif good and good < most:
                q = good + 1
            elif bad and bad > 1:
                q = bad - 1
            if q in tested:
                break
        tested[q] = (q, *trial(q, 1.0), 1.0)
        quality = tested[q][1]
        if quality + slack >= target:
            good = max(good or q, q)
        else:
            bad = min(bad or q, q)
        if good and bad and bad - good > 1:
            q = good + (bad - good) // 2
        else:
            wanted = int(q * min(4.0, max(0.25, 10 ** ((quality - target) / 20))) + 0.5)
            q = min(most, max(1, wanted if wanted != q else q + (1 if quality >= target else -1)))
    best = min(tested.values(), key=rank)
    for factor in relaxed:
        if rank(best)[0]:
            best = min(best, (best[0], *trial(best[0], factor), factor), key=rank)
    if rank(best)[0] and 1 not in tested:
        best = min(best, (1, *trial(1, 1.0), 1.0), key=rank)
    return best


class TransferError(RuntimeError):
    pass


class GoBackN:
    """A sender with a sliding window: blocks 0 .. n - 1, `window` of them unacknowledged at most, sent `attempts` times at most.

    step() takes a response (kind ack, nak, wait or timeout; seq) and gives what is sent for it. An acknowledgement covers all blocks
    up to its own, a late one is ignored, a refusal sends its block and all after it again, a timeout sends the whole window again.
    """

    def __init__(self, blocks: int, window: int = 16, attempts: int = 5):
        self.blocks, self.window, self.attempts = blocks, min(window, 16), attempts
        self.next, self.acknowledged, self.tries = 0, -1, {}

    def _fill(self) -> list[int]:
        out = []
        while self.next < self.blocks and len(self.tries) < self.window:
            self.tries[self.next] = 1
            out.append(self.next)
            self.next += 1
        return out

    def _again(self, seq: int) -> list[int]:
        out = sorted(s for s in self.tries if s >= seq)
        if not out:
            raise TransferError(f"unknown block {seq} refused")
        for s in out:
            if self.tries[s] >= self.attempts:
                raise TransferError(f"block {s} failed {self.attempts} times")
            self.tries[s] += 1
        return out

    def step(self, row: dict | None = None) -> dict:
        """Without a response: the first window."""
        sent: list[int] = []
        kind = row["kind"] if row else "wait"
        if kind == "ack":
            if row["seq"] > self.acknowledged:
                if row["seq"] not in self.tries:
                    raise TransferError(f"unexpected acknowledgement of {row['seq']}")
                self.tries = {s: n for s, n in self.tries.items() if s > row["seq"]}
                self.acknowledged = row["seq"]
        elif kind == "nak":
            sent = self._again(row["seq"])
        elif kind == "timeout":
            sent = self._again(min(self.tries)) if self.tries else []
        return {"sent": sent + self._fill(), "in_flight": len(self.tries), "done": not self.tries and self.next == self.blocks}
