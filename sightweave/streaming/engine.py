"""The live identity engine: decisions on a stream of observations, replayed in batch or run as a stream.

An observation of a new track gets a provisional (negative) id. After min_evidence usable vectors
the track is resolved on their quality-weighted mean: first against identities seen in its camera
at the same-camera bar, then against those of other cameras at the cross bar, with a margin and a
mutual check; else a new identity is minted. Later observations reinforce the identity's bank. An
identity is no candidate if another of its tracks was active in the camera just before, if its span
in the camera holds the track's first moment, or if the site makes the move impossible. State is
bounded by a time to live and by the number of identities kept.
"""

from __future__ import annotations

import pickle
from collections import Counter, OrderedDict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightweave.session import cut

OUT = "det_id long, run_id string, cam string, track_id long, identity long, event string, score double"


@dataclass(frozen=True)
class LiveConfig:
    """Bars and limits of the live engine; times in seconds."""

    min_evidence: int = 3
    same_bar: float = 0.70
    cross_bar: float = 0.60
    margin: float = 0.03
    bank: int = 20
    coactive_sec: float = 2.0
    span_gap_sec: float = 1.0
    ttl_sec: float = 300.0
    max_identities: int = 200
    quality_floor: float = 0.05


@dataclass
class Identity:
    bank: deque
    total: np.ndarray
    spans: dict[str, list[list[float]]] = field(default_factory=dict)
    tracks: dict[tuple[str, int], float] = field(default_factory=dict)
    last: tuple[str, float] = ("", 0.0)

    def score(self, u: np.ndarray) -> float:
        """The better of the prototype and the best exemplar."""
        n = np.linalg.norm(self.total)
        best = max(float(u @ b) for b in self.bank)
        return max(best, float(u @ self.total) / n) if n > 0 else best


@dataclass
class Track:
    provisional: int
    first: float
    seen: float
    total: np.ndarray | None = None
    count: int = 0
    identity: int | None = None


class Engine:
    """State of one run."""

    def __init__(self, cfg: LiveConfig, transit: dict[tuple[str, str], float | None] | None = None):
        self.cfg, self.transit = cfg, transit or {}
        # Both in the order in which they were last seen, so that sweeping starts with the oldest.
        self.identities: OrderedDict[int, Identity] = OrderedDict()
        self.tracks: OrderedDict[tuple[str, int], Track] = OrderedDict()
        self.next_id, self.next_provisional = 1, -1
        self.counts: Counter = Counter()

    def _allowed(self, who: Identity, cam: str, ts: float, key: tuple[str, int], first: float) -> bool:
        c = self.cfg
        if any(k != key and k[0] == cam and abs(ts - seen) <= c.coactive_sec for k, seen in who.tracks.items()):
            return False
        if any(s < first < e for s, e in who.spans.get(cam, ())):
            return False
        source, at = who.last
        if source == cam or (source, cam) not in self.transit:
            return True
        need = self.transit[source, cam]
        return need is not None and max(0.0, ts - at) >= need

    def _match(self, key: tuple[str, int], u: np.ndarray, ts: float, first: float) -> tuple[int | None, str, float | None]:
        cam, c = key[0], self.cfg
        able = {g: w for g, w in self.identities.items() if self._allowed(w, cam, ts, key, first)}
        self.counts["vetoed"] += len(self.identities) - len(able)
        scores = {g: w.score(u) for g, w in able.items()}
        same = max(((scores[g], g) for g, w in able.items() if cam in w.spans), default=None)
        if same and same[0] >= c.same_bar:
            return same[1], "reacquired", same[0]
        cross = sorted(((scores[g], g) for g, w in able.items() if set(w.spans) - {cam}), reverse=True)
        if cross and cross[0][0] >= c.cross_bar and cross[0][0] - (cross[1][0] if len(cross) > 1 else -1.0) >= c.margin:
            score, best = cross[0]
            # Mutual: no other identity that could be here may be closer to the candidate's bank than this track is.
            who = self.identities[best]
            others = ((w.total, np.linalg.norm(w.total)) for g, w in self.identities.items() if g != best and not any(s < ts < e for s, e in w.spans.get(cam, ())))
            if max((who.score(total / n) for total, n in others if n > 0), default=-1.0) <= score:
                return best, "linked", score
        return None, "minted", cross[0][0] if cross else None

    def _extend(self, who: Identity, key: tuple[str, int], start: float, ts: float) -> None:
        spans = who.spans.setdefault(key[0], [])
        if spans and start <= spans[-1][1] + self.cfg.span_gap_sec:
            spans[-1][0], spans[-1][1] = min(spans[-1][0], start), max(spans[-1][1], ts)
        else:
            spans.append([start, ts])
        who.tracks[key] = ts
        who.last = (key[0], ts)
        self.identities.move_to_end(self.tracks[key].identity)

    def _sweep(self, ts: float) -> None:
        c = self.cfg
        while self.tracks and ts - next(iter(self.tracks.values())).seen > c.ttl_sec:
            self.tracks.popitem(last=False)
        while self.identities and (ts - next(iter(self.identities.values())).last[1] > c.ttl_sec or len(self.identities) > c.max_identities):
            self.identities.popitem(last=False)

    def observe(self, cam: str, track_id: int, ts: float, u: np.ndarray | None, quality: float) -> tuple[int, str, float | None]:
        """Identity (or provisional id), what happened, and the score if there was one."""
        c, key = self.cfg, (cam, track_id)
        self._sweep(ts)
        t = self.tracks.get(key)
        if t is None or (t.identity is not None and t.identity not in self.identities):
            t = self.tracks[key] = Track(self.next_provisional, ts, ts)
            self.next_provisional -= 1
        t.seen = max(t.seen, ts)
        self.tracks.move_to_end(key)
        if u is None:  # no evidence: keeps the id, extends the span, doesn't count
            if t.identity is not None:
                self._extend(self.identities[t.identity], key, ts, ts)
            return (t.identity or t.provisional), "kept", None
        w = max(quality, c.quality_floor)
        if t.identity is None:
            t.total = w * u if t.total is None else t.total + w * u
            t.count += 1
            n = np.linalg.norm(t.total)
            if t.count < c.min_evidence or n == 0:
                return t.provisional, "pending", None
            mean = t.total / n
            found, event, score = self._match(key, mean, ts, t.first)
            if found is None:
                found, self.next_id = self.next_id, self.next_id + 1
                self.identities[found] = Identity(deque(maxlen=c.bank), np.zeros_like(mean))
            t.identity = found
            who = self.identities[found]
            who.bank.append(mean)
            who.total = who.total + t.total
            self._extend(who, key, t.first, ts)
            self.counts[event] += 1
            return found, event, score
        who = self.identities[t.identity]
        score = who.score(u)  # before the vector joins the bank
        who.bank.append(u)
        who.total = who.total + w * u
        self._extend(who, key, ts, ts)
        return t.identity, "reinforced", score


def _decide(engine: Engine, pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in pdf.itertuples(index=False):
        u = None if r.unit_vector is None else np.asarray(r.unit_vector, dtype=np.float64)
        out.append((r.det_id, r.run_id, r.cam, r.track_id, *engine.observe(r.cam, r.track_id, r.ts, u, r.quality)))
    return pd.DataFrame(out, columns=["det_id", "run_id", "cam", "track_id", "identity", "event", "score"])


ORDER = ["ts", "cam", "frame_index", "track_id", "det_id"]


def replay(obs: DataFrame, cfg: LiveConfig = LiveConfig(), transit: dict | None = None) -> DataFrame:
    """Decisions on stored observations: det_id, run_id, cam, track_id, frame_index, ts (seconds), unit_vector?, quality.

    Each run is scanned in the order of time with the engine's bounded state; a run is serial by
    nature, as every decision depends on the ones before it.
    """
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, engine = None, None
        for pdf in frames:
            for name, part in pdf.groupby("run_id", sort=False):
                if name != run:
                    run, engine = name, Engine(cfg, transit)
                yield _decide(engine, part)

    return obs.repartition("run_id").sortWithinPartitions("run_id", *ORDER).mapInPandas(scan, OUT)


def live(stream: DataFrame, cfg: LiveConfig = LiveConfig(), transit: dict | None = None, hold_sec: float = 0.0, idle_sec: float | None = None) -> DataFrame:
    """The same on a stream; the state of a run is kept in the state store between micro-batches.

    Rows are held back until hold_sec behind the newest of their run and then decided in the order of
    time, so rows that come out of order by less than that get the decisions of a replay. A row older
    than what is decided already changes nothing and is given out as late, without an identity. A run
    that sends nothing for idle_sec is finished: what it holds is decided and its state is removed
    (None: never, which a stream of finite micro-batches such as availableNow needs, as timeouts
    keep such a query running).
    The engine's own state is bounded by its time to live and number of identities, the rows held by
    hold_sec.
    """
    columns = ["det_id", "run_id", "cam", "track_id", "frame_index", "ts", "unit_vector", "quality"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        engine, held, done = pickle.loads(state.get[0]) if state.exists else (Engine(cfg, transit), pd.DataFrame(columns=columns), -np.inf)
        if state.hasTimedOut:
            ready, late = held.sort_values(ORDER, kind="stable"), held.iloc[:0]
            state.remove()
        else:
            parts = [p[columns] for p in frames]  # one micro-batch of one run, bounded by the source's options
            rows = pd.concat([*([held] if len(held) else []), *parts]).sort_values(ORDER, kind="stable") if parts else held
            late, rows = rows[rows["ts"] < done], rows[rows["ts"] >= done]
            upto = rows["ts"].max() - hold_sec if len(rows) else done
            ready, held = rows[rows["ts"] <= upto], rows[rows["ts"] > upto]
            done = max(done, ready["ts"].max()) if len(ready) else done
        if len(late):
            yield pd.DataFrame({**{c: late[c] for c in columns[:4]}, "identity": pd.array([None] * len(late), dtype="Int64"), "event": "late", "score": np.nan})
        if len(ready):
            yield _decide(engine, ready)
        if not state.hasTimedOut:
            state.update((pickle.dumps((engine, held, done)),))
            if idle_sec is not None:
                state.setTimeoutDuration(int(idle_sec * 1000))

    return stream.groupBy("run_id").applyInPandasWithState(step, OUT, "engine binary", "append", GroupStateTimeout.NoTimeout if idle_sec is None else GroupStateTimeout.ProcessingTimeTimeout)


@dataclass(frozen=True)
class Batch:
    """Frames of several cameras that are processed together, and what was left out."""

    frames: list[tuple[str, int, float]]
    stale: int
    replaced: int


class FreshBatcher:
    """Batches of the newest frame of each camera: a camera's older frame is replaced, a frame too old is dropped, cameras take turns."""

    def __init__(self, size: int, max_age: float):
        self.size, self.max_age = size, max_age
        self.slots: OrderedDict[str, tuple[int, float]] = OrderedDict()
        self.replaced = 0

    def put(self, cam: str, frame: int, ts: float) -> None:
        self.replaced += cam in self.slots
        self.slots[cam] = (frame, ts)  # keeps the camera's turn

    def take(self, now: float) -> Batch:
        frames, stale = [], 0
        while self.slots and len(frames) < self.size:
            cam, (frame, ts) = self.slots.popitem(last=False)
            if now - ts > self.max_age:
                stale += 1
            else:
                frames.append((cam, frame, ts))
        replaced, self.replaced = self.replaced, 0
        return Batch(frames, stale, replaced)


def reconnect_delays(attempts: int, step: float = 1.0, most: float = 10.0) -> list[float]:
    """Waits before the attempts to open a lost source again: growing by step, bounded."""
    return [min(most, step * (i + 1)) for i in range(attempts)]


def finalize(boxes: DataFrame, obs: DataFrame, cfg, dim: int = 128) -> tuple[DataFrame, DataFrame]:
    """When a run ends: its boxes with their final identities, and a row of figures of each run.

    The reconcile is run over all observations; boxes of tracks without an identity keep null.
    """
    from sightweave.operators.reconcile import reconcile, relabel

    ids = cut(reconcile(obs, cfg, dim))
    figures = ids.groupBy("run_id").agg(F.count(F.lit(1)).alias("tracklets"), F.countDistinct("identity").alias("identities"), F.count_if(F.col("state") == "suppressed").alias("suppressed"), F.sum("observations").alias("observations"))
    return relabel(boxes, ids), figures


def throttled(rows: DataFrame, frames: DataFrame, interval: int = 10, warmup: int = 3, cap: int = 0, ttl: int = 90) -> DataFrame:
    """det_id, due, vector_of: whether an observation is embedded anew, and the det_id whose vector it carries (null: none yet).

    rows: det_id, run_id, cam, track_id, frame_index, accepted (of the crop; null is no usable crop).
    A tick is a processed frame of the camera, with or without detections. A track is due at first,
    for its first warmup embeddings, and then at least interval ticks after the last, but never after
    cap of them (0: no cap). A due crop that isn't accepted is no embedding; the track keeps its last
    vector. A track unseen for more than ttl ticks is forgotten. Rows without a track are left out; a
    frame that only rows name is a tick too. Each task scans its tracks once with constant memory.
    """
    from pyspark.sql.window import Window

    key = ["run_id", "cam", "frame_index"]
    every = frames.select(*key).unionByName(rows.select(*key)).dropna().distinct()
    # Ticks by blocks of frames, so that no task numbers a whole camera.
    block = F.floor(F.col("frame_index") / 100_000)
    sizes = every.groupBy("run_id", "cam", block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("run_id", "cam").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("run_id", "cam", "block").orderBy("frame_index"))
    ticks = every.withColumn("block", block).withColumn("within", within).join(before, ["run_id", "cam", "block"]).select(*key, (F.col("before") + F.col("within")).alias("tick"))
    ready = rows.filter("track_id is not null").join(ticks, key).select("det_id", "run_id", "cam", "track_id", "tick", F.coalesce("accepted", F.lit(False)).alias("accepted"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, done, last, seen, vector = None, 0, 0, 0, None
        for pdf in batches:
            due, of = [], []
            for r in pdf.itertuples(index=False):
                if (r.run_id, r.cam, r.track_id) != key or r.tick - 1 - seen > ttl:
                    key, done, last, vector = (r.run_id, r.cam, r.track_id), 0, 0, None
                seen = r.tick
                wanted = done < warmup or r.tick - last >= interval
                now = bool(wanted and r.accepted and not (cap and done >= cap))
                if now:
                    done, last, vector = done + 1, r.tick, r.det_id
                due.append(now)
                of.append(vector)
            yield pd.DataFrame({"det_id": pdf["det_id"], "due": due, "vector_of": pd.array(of, dtype="Int64")})

    return ready.repartition("run_id", "cam", "track_id").sortWithinPartitions("run_id", "cam", "track_id", "tick", "det_id").mapInPandas(scan, "det_id long, due boolean, vector_of long")
