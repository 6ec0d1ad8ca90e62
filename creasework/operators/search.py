"""Search for settings: a tree-structured Parzen sampler, trials side by side, unpromising ones stopped early.

A setting is judged in steps (such as folds), each a job of its own. Trials are drawn in rounds of ``side_by_side``; a
round's trials run from as many threads, so Spark works on several at once. At each rung (1, eta, eta**2 .. steps) only the
best 1/eta of all that have come so far go on (successive halving); the others are told apart by their loss there. The
sampler takes the past trials that came furthest, splits them into the good and the rest, and draws the candidate that is
likeliest under the density of the good relative to that of the rest, each parameter by itself. Trials of the same round
don't know each other's losses, so results don't depend on which thread is faster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Number:
    """A number of [low, high]; whole, or drawn by its logarithm, if so said."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def inward(self, x: float) -> float:
        return math.log(x) if self.log else float(x)

    def outward(self, z: float):
        x = min(max(math.exp(z) if self.log else z, self.low), self.high)
        return int(round(x)) if self.whole else x

    @property
    def span(self) -> tuple[float, float]:
        return self.inward(self.low), self.inward(self.high)


@dataclass(frozen=True)
class Choice:
    """One of several values."""

    values: tuple


Space = dict[str, Number | Choice]


@dataclass
class Trial:
    setting: dict
    losses: list[float] = field(default_factory=list)

    @property
    def loss(self) -> float:
        return float(np.mean(self.losses)) if self.losses else math.inf


def drawn(space: Space, random: np.random.Generator) -> dict:
    """A setting at random."""
    return {n: p.values[int(random.integers(len(p.values)))] if isinstance(p, Choice) else p.outward(random.uniform(*p.span)) for n, p in space.items()}


class Density:
    """A Parzen density of one number: a normal at each past value, as wide as its neighbours are far, and one over the
    span that counts as much as ``wide`` values."""

    def __init__(self, values: list[float], span: tuple[float, float], wide: float = 1.0):
        low, high = span
        self.span, width = span, max(high - low, 1e-12)
        at = np.sort(np.array(values, float))
        steps = np.diff(at) if len(at) > 1 else np.full(1, width)
        gaps = np.maximum(np.concatenate((steps[:1], steps)), np.concatenate((steps, steps[-1:]))) if len(at) > 1 else np.full(len(at), width)
        self.centres = np.append(at, (low + high) / 2)
        self.widths = np.append(np.clip(gaps, width / min(100, len(at) + 1), width / 4), width)
        self.weights = np.append(np.ones(len(at)), wide) / (len(at) + wide)

        erf = np.vectorize(math.erf, otypes=[float])
        mass = 0.5 * (erf((high - self.centres) / self.widths / math.sqrt(2)) - erf((low - self.centres) / self.widths / math.sqrt(2)))
        self.heights = self.weights / (self.widths * np.maximum(mass, 1e-12))  # of normals that are cut at the ends of the span

    def draw(self, random: np.random.Generator, n: int) -> np.ndarray:
        which = random.choice(len(self.centres), size=n, p=self.weights)
        x = random.normal(self.centres[which], self.widths[which])
        for _ in range(20):
            out = (x < self.span[0]) | (x > self.span[1])
            if not out.any():
                break
            x[out] = random.normal(self.centres[which[out]], self.widths[which[out]])
        return np.clip(x, *self.span)

    def logs(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.centres) / self.widths
        return np.log(np.sum(np.exp(-0.5 * z * z) * self.heights, axis=1) + 1e-300)


def proposed(space: Space, past: list[Trial], random: np.random.Generator, candidates: int = 4) -> dict:
    """The next setting, from past trials in order of merit, of which the square root count as good. Few candidates keep
    the sampler near the good; many drive it to places that nobody has tried."""
    n = math.ceil(math.sqrt(len(past)))
    good, rest = past[:n], past[n:] or past
    out = {}
    for name, p in space.items():
        if isinstance(p, Choice):
            weights = [np.array([1.0 + sum(t.setting[name] == v for t in part) for v in p.values]) for part in (good, rest)]
            ratio = (weights[0] / weights[0].sum()) / (weights[1] / weights[1].sum())
            picks = random.choice(len(p.values), size=candidates, p=weights[0] / weights[0].sum())
            out[name] = p.values[int(picks[np.argmax(ratio[picks])])]
        else:
            of = [Density([p.inward(t.setting[name]) for t in part], p.span, wide) for part, wide in ((good, 0.25), (rest, 5.0))]
            x = of[0].draw(random, candidates)
            out[name] = p.outward(float(x[np.argmax(of[0].logs(x) - of[1].logs(x))]))
    return out


def by_merit(trials: list[Trial]) -> list[Trial]:
    """Those that came furthest first, then by loss."""
    return sorted(trials, key=lambda t: (-len(t.losses), t.loss))


def minimise(judge: Callable[[dict, int], float], space: Space, trials: int = 30, steps: int = 1, side_by_side: int = 4, eta: int = 3, at_random: int = 8, seed: int = 0) -> list[Trial]:
    """All trials, the best first. judge(setting, step) is the loss of a setting on one step."""
    random, past = np.random.default_rng(seed), []
    rungs = sorted({min(steps, eta**k) for k in range(steps.bit_length() + 1)})
    at_rung: dict[int, list[float]] = {r: [] for r in rungs}
    with ThreadPoolExecutor(side_by_side) as pool:
        while len(past) < trials:
            known = by_merit(past)
            now = [Trial(drawn(space, random) if len(past) + i < at_random else proposed(space, known, random)) for i in range(min(side_by_side, trials - len(past)))]
            going, done = now, 0
            for rung in rungs:
                jobs = [(t, pool.submit(judge, t.setting, s)) for t in going for s in range(done, rung)]
                for t, job in jobs:
                    t.losses.append(job.result())
                at_rung[rung] += [t.loss for t in going]
                keep = max(1, len(at_rung[rung]) // eta)
                bar = sorted(at_rung[rung])[keep - 1]
                going, done = [t for t in going if t.loss <= bar], rung
            past += now
    return by_merit(past)
