"""Assignment of observations to identities one by one: sticky tracks, match or mint with exclusions, verified matching.

A track keeps the identity it got first. A new track's observation is compared with the run's
observations so far: the identities among the nearest are candidates, except those seen in the very
same camera and frame and those whose span in the camera strictly holds the frame, as one body
can't be there twice. A candidate scores by its bank (the better of prototype and best exemplar); the
best is taken if it is over the bar and clear of the second, otherwise an identity is minted. With a
verifier the probability of a match decides instead of the score.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sightweave.functions.scoring import BIAS, W_COSINE, W_COUNT, W_GAP, W_QUALITY, W_RERANK
from sightweave.streaming.engine import ORDER

OUT = "det_id long, run_id string, cam string, track_id long, identity long, event string, score double"


def _sigmoid(z: float) -> float:
    """1 / (1 + exp(-z)) of any z; a gap of 70,000 frames would be beyond math.exp."""
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


@dataclass(frozen=True)
class AssignConfig:
    """Bars of the assignment; verified sets the two of the verifier."""

    bar: float = 0.85
    gap: float = 0.03
    nearest: int = 10
    bank: int = 20
    verified: bool = False
    accept: float = 0.55
    clear: float = 0.05


@dataclass
class Person:
    """What is known of an identity."""

    bank: deque
    spans: dict[str, list[list[int]]] = field(default_factory=dict)
    last: tuple[str, int] | None = None
    observations: int = 0

    def score(self, u: np.ndarray) -> float:
        rows = np.stack(self.bank)
        mean = rows.mean(0)
        n = np.linalg.norm(mean)
        best = float((rows @ u).max())
        return max(best, float(mean @ u) / n) if n > 0 else best

    def holds(self, cam: str, frame: int) -> bool:
        return any(s < frame < e for s, e in self.spans.get(cam, ()))

    def see(self, cam: str, frame: int, u: np.ndarray) -> None:
        spans = self.spans.setdefault(cam, [])
        if spans and frame <= spans[-1][1] + 1:
            spans[-1][0], spans[-1][1] = min(spans[-1][0], frame), max(spans[-1][1], frame)
        else:
            spans.append([frame, frame])
        self.bank.append(u)
        self.last, self.observations = (cam, frame), self.observations + 1


class Assigner:
    """State of one run: its observations so far, identities and tracks."""

    def __init__(self, cfg: AssignConfig, dim: int):
        self.cfg, self.people, self.tracks, self.counts = cfg, {}, {}, Counter()
        self.rows, self.seen = np.zeros((256, dim), np.float64), []  # of each row: camera, frame, identity

    def _candidates(self, cam: str, frame: int, u: np.ndarray) -> list[int]:
        n = len(self.seen)
        if not n:
            return []
        s = self.rows[:n] @ u
        near = np.argsort(-s, kind="stable")[: self.cfg.nearest] if n <= 4096 else (top := np.argpartition(-s, self.cfg.nearest)[: self.cfg.nearest])[np.argsort(-s[top], kind="stable")]
        found = [self.seen[i][2] for i in near if self.seen[i][:2] != (cam, frame)]
        return [g for g in dict.fromkeys(found) if not self.people[g].holds(cam, frame)]

    def _probability(self, g: int, cosine: float, cam: str, frame: int, quality: float) -> float:
        who = self.people[g]
        since = max(0, frame - who.last[1]) if who.last and who.last[0] == cam else 0
        return _sigmoid(BIAS + (W_COSINE + W_RERANK) * cosine + W_COUNT * math.log1p(who.observations) + W_GAP * since + W_QUALITY * quality)

    def _match(self, cam: str, frame: int, u: np.ndarray, quality: float) -> tuple[int | None, float | None]:
        c = self.cfg
        scored = {g: self.people[g].score(u) for g in self._candidates(cam, frame, u)}
        bar, gap = (c.accept, c.clear) if c.verified else (c.bar, c.gap)
        if c.verified:
            scored = {g: self._probability(g, s, cam, frame, quality) for g, s in scored.items()}
        ranked = sorted(((s, g) for g, s in scored.items()), reverse=True)
        if not ranked:
            return None, None
        best, g = ranked[0]
        second = ranked[1][0] if len(ranked) > 1 else -1.0
        return (g if best >= bar and best - second >= gap else None), best

    def observe(self, cam: str, track: int, frame: int, u: np.ndarray, quality: float) -> tuple[int, str, float | None]:
        """Identity, what happened (sticky, matched, minted) and the score of the best candidate."""
        key = (cam, track)
        g, event, score = self.tracks.get(key), "sticky", None
        if g is None:
            g, score = self._match(cam, frame, u, quality)
            event = "matched"
            if g is None:
                g, event = len(self.people) + 1, "minted"
                self.people[g] = Person(deque(maxlen=self.cfg.bank))
            self.tracks[key] = g
        self.people[g].see(cam, frame, u)
        if len(self.seen) == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[len(self.seen)] = u
        self.seen.append((cam, frame, g))
        self.counts[event] += 1
        return g, event, score


def assign(obs: DataFrame, cfg: AssignConfig = AssignConfig(), dim: int = 128) -> DataFrame:
    """Decisions on observations: det_id, run_id, cam, track_id, frame_index, ts, unit_vector, quality.

    Rows without a vector are left out. Each run is scanned in the order of time; a run is serial by
    nature and its task holds the vectors of the run, as every one of them may be the nearest. Runs
    are independent, tracks are told apart by camera, and ties go to the larger identity.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, state = None, None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.run_id != run:
                    run, state = r.run_id, Assigner(cfg, dim)
                out.append((r.det_id, r.run_id, r.cam, r.track_id, *state.observe(r.cam, r.track_id, r.frame_index, np.asarray(r.unit_vector, np.float64), r.quality)))
            yield pd.DataFrame(out, columns=["det_id", "run_id", "cam", "track_id", "identity", "event", "score"])

    rows = obs.filter("unit_vector is not null and track_id is not null")
    return rows.repartition("run_id").sortWithinPartitions("run_id", *ORDER).mapInPandas(scan, OUT)


def drop_unreferenced(banks: DataFrame, decisions: DataFrame, identity: str = "identity") -> DataFrame:
    """Rows of banks whose identity any track still has."""
    return banks.join(decisions.select(identity).distinct(), identity, "left_semi")
