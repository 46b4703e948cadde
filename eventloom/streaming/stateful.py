"""Per-key stateful operators for streams, the online forms of ``operators.series``.

Each is a ``StatefulProcessor`` for ``transformWithStateInPandas``. The processors that need
a key's rows in order are ``Ordered``: with a span they hold rows in state by stretches of
event time, and a timer lets a stretch go once the watermark has passed its end. So files may
come out of order within the delay of the watermark, and a task handles one stretch of one
key, or of one group of keys, at a time. Without a span each micro-batch is sorted and handled at once, which is right
when files come in order. Rings and merges go through frames one by one.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventloom.operators.series import two_sided_steps

NUMBER, GROUP = "key_number", "key_group"
AT, MS = "event_at", "event_ms"  # event time, and in milliseconds for timers (names with a leading _ do not reach the processors)


def packed(pdf: pd.DataFrame) -> bytes:
    """A frame as Arrow bytes, for state."""
    import pyarrow as pa

    table = pa.Table.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(piece: bytes) -> pd.DataFrame:
    import pyarrow as pa

    with pa.ipc.open_stream(bytes(piece)) as r:
        return r.read_all().to_pandas()


def told_apart(by: list[str], rows: pd.DataFrame) -> list[str]:
    """The key columns without those that are null, which in a group are null throughout."""
    return [k for k in by if rows[k].notna().any()]


def emptied(by: list[str], groups: int, key: tuple, out: pd.DataFrame) -> pd.DataFrame:
    """The null keys of a group, which ``apply`` filled, as nulls again."""
    nulls = int(key[0]) // groups
    return out.assign(**{k: None for i, k in enumerate(by) if nulls >> i & 1 and k in out.columns})


class Ordered(StatefulProcessor):
    """Hands rows in order to ``segments``, with the state that the rows before have left, many keys at once.

    ``order`` makes the order of a key's rows total. With ``span`` (milliseconds) rows wait by
    stretches of that length; rows of a stretch that has been handled are late and dropped by
    the watermark. ``by`` names the keys that share a group (set by ``apply``); without, a
    group is a key.
    """

    state_schema: str
    by: list[str] | None = None
    groups: int | None = None

    def __init__(self, order: list[str], span: int | None = None) -> None:
        self.order, self.span = order, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "keys binary" if self.by else self.state_schema)
        if self.span:
            self.pending = handle.getMapState("pending", "stretch long", "pieces long")
            self.held = handle.getMapState("held", "stretch long, piece long", "rows binary")

    @classmethod
    def _columns(cls) -> dict[str, str]:
        return {n: "float64" if kind == "double" else "int64" for n, kind in (c.split() for c in cls.state_schema.split(", "))}

    def segments(self, rows: pd.DataFrame, at: np.ndarray, known: np.ndarray, state: list[np.ndarray]) -> tuple[pd.DataFrame, list[np.ndarray]]:
        """What rows sorted by key and order give, and the state after. Keys start at ``at``; ``state`` counts where ``known``."""
        raise NotImplementedError

    def advance(self, key: tuple, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
        """The same for the rows of one key."""
        before = [np.array([x], kind) for x, kind in zip(state or [0] * len(self._columns()), self._columns().values())]
        out, after = self.segments(rows, np.zeros(1, int), np.array([state is not None]), before)
        return out, tuple(np.asarray(x, kind)[0].item() for x, kind in zip(after, self._columns().values()))

    def _step(self, key: tuple, pieces: list[pd.DataFrame]) -> pd.DataFrame:
        if self.by:
            return emptied(self.by, self.groups, key, self._group(pd.concat(pieces)))
        rows = pd.concat(pieces).sort_values(self.order, ignore_index=True)
        out, state = self.advance(key, rows, tuple(self.state.get()) if self.state.exists() else None)
        if state is not None:
            self.state.update(state)
        return out

    def _group(self, rows: pd.DataFrame) -> pd.DataFrame:
        held = unpacked(self.state.get()[0]) if self.state.exists() else None
        n = 0 if held is None else len(held)
        # keys are numbered as they appear, those in state first
        by = told_apart(self.by, rows)
        names = pd.concat([held[by], rows[by]] if n else [rows[by]])
        number = names.groupby(by, sort=False).ngroup().to_numpy() if by else np.zeros(len(names), int)
        rows = rows.assign(**{NUMBER: number[n:]}).sort_values([NUMBER, *self.order], ignore_index=True)
        number = rows.pop(NUMBER).to_numpy()
        at = np.flatnonzero(np.diff(number, prepend=-1))
        number = number[at]
        known = number < n
        state = [held[f"state_{c}"].to_numpy()[np.where(known, number, 0)] if n else np.zeros(len(at), kind) for c, kind in self._columns().items()]
        out, after = self.segments(rows, at, known, state)
        now = pd.DataFrame({k: rows[k].to_numpy()[at] for k in self.by} | {f"state_{c}": np.asarray(x, kind) for (c, kind), x in zip(self._columns().items(), after)})
        rest = np.setdiff1d(np.arange(n), number[known])
        self.state.update((packed(pd.concat([held.iloc[rest], now], ignore_index=True) if len(rest) else now),))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.span:
            yield self._step(key, list(rows))
            return
        for pdf in rows:
            for stretch, part in pdf.groupby(pdf[MS] // self.span):
                at = (int(stretch),)
                n = int(self.pending.getValue(at)[0]) if self.pending.containsKey(at) else 0
                self.held.updateValue((*at, n), (packed(part),))
                self.pending.updateValue(at, (n + 1,))
                if n == 0:
                    self.handle.registerTimer((at[0] + 1) * self.span)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        for (stretch,) in sorted(tuple(k) for k in self.pending.keys()):
            if (stretch + 1) * self.span > until:
                break
            pieces = [(stretch, i) for i in range(int(self.pending.getValue((stretch,))[0]))]
            out = self._step(key, [unpacked(self.held.getValue(p)[0]) for p in pieces])
            for p in pieces:
                self.held.removeKey(p)
            self.pending.removeKey((stretch,))
            yield out

    def close(self) -> None:
        pass


def last_true(flags: np.ndarray) -> np.ndarray:
    """Index of the last true flag up to each place, -1 before the first."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def ends(at: np.ndarray, n: int) -> np.ndarray:
    """The last rows of keys that start at ``at``."""
    return np.append(at[1:], n) - 1


def owner(at: np.ndarray, n: int) -> np.ndarray:
    """The key each row belongs to."""
    return np.repeat(np.arange(len(at)), np.diff(np.append(at, n)))


def behind(a: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value of the row before; ``first`` before the first row of a key."""
    out = np.concatenate([a[:1], a[:-1]])
    out[at] = first
    return out


def passed(target: np.ndarray, v0: np.ndarray, v1: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> np.ndarray:
    """When straight lines from v0 to v1 pass their targets; flat ones at their end."""
    flat = np.abs(v1 - v0) <= 1e-12
    share = np.where(flat, 1.0, np.clip((target - v0) / np.where(flat, 1.0, v1 - v0), 0.0, 1.0))
    return t0 + share * np.maximum(t1 - t0, 0)


class CrossingEncoder(Ordered):
    """Send-on-delta per key; a true ``reset`` column value starts a new reference silently."""

    state_schema = "v0 double, k long, v double, t long"

    def __init__(self, keys, order, value, theta, reset=None, span=None):
        super().__init__(order, span)
        self.keys, self.value, self.theta, self.reset = keys, value, float(theta), reset

    def segments(self, rows, at, known, state):
        n = len(rows)
        v, t = rows[self.value].to_numpy(float), rows[self.order[0]].to_numpy("int64")
        start = rows[self.reset].to_numpy(bool, copy=True) if self.reset else np.zeros(n, bool)
        start[at] |= ~known
        v0, k, pv, pt = (np.where(known, x, y) for x, y in zip(state, (v[at], 0, v[at], t[at])))
        of = owner(at, n)
        since = last_true(start)
        ref = np.where(since < at[of], v0[of], v[since])
        u = (v - ref) / self.theta
        lo, hi = np.floor(u), np.ceil(u)
        before = (pv - v0) / self.theta
        plo, phi = behind(lo, at, np.floor(before)), behind(hi, at, np.ceil(before))
        # the interval [lo, hi] that holds u moves up: its lower end is the level, down: its upper end
        up, down = (lo > plo) | (hi > phi), (lo < plo) | (hi < phi)
        own = np.where(start, 0, np.where(up, lo, hi))
        moved = last_true(start | up | down)
        level = np.where(moved < at[of], k[of], own[moved])
        entering = behind(level, at, k)
        count = np.where(start, 0, level - entering).astype("int64")
        i = np.repeat(np.arange(n), np.abs(count))
        first = np.cumsum(np.abs(count)) - np.abs(count)
        ordinal = np.arange(len(i)) - first[i] + 1
        p = np.sign(count[i])
        target = ref[i] + (entering[i] + p * ordinal) * self.theta
        va, ta = behind(v, at, pv)[i], behind(t, at, pt)[i]
        out = {**{c: rows[c].to_numpy()[i] for c in (*self.keys, *self.order)}, "p": p, "ordinal": ordinal, "t_cross": passed(target, va, v[i], ta, t[i])}
        last = ends(at, n)
        return pd.DataFrame(out, index=range(len(i))), [ref[last], level[last], v[last], t[last]]


class TwoSidedEncoder(Ordered):
    """Send-on-delta with thresholds for rises and falls from columns that are constant per key."""

    state_schema = "v0 double, a long, b long, v double, t long"

    def __init__(self, keys, order, value, up, down, reset=None, span=None):
        super().__init__(order, span)
        self.keys, self.value, self.up, self.down, self.reset = keys, value, up, down, reset

    def segments(self, rows, at, known, state):
        v, t = rows[self.value].to_numpy(float), rows[self.order[0]].to_numpy("int64")
        up, down = rows[self.up].to_numpy(float)[at], rows[self.down].to_numpy(float)[at]
        start = rows[self.reset].to_numpy(bool, copy=True) if self.reset else np.zeros(len(v), bool)
        start[at] |= ~known
        last = ends(at, len(v))
        entries = zip(*(x.tolist() for x in state[:3]))
        steps = [two_sided_steps(v[i : j + 1], start[i : j + 1], u, w, e) for i, j, u, w, e in zip(at, last, up.tolist(), down.tolist(), entries)]
        n, refs = (np.concatenate([s[k] for s in steps]) for k in (0, 1))
        pv, pt = np.where(known, state[3], v[at]), np.where(known, state[4], t[at])
        i = np.repeat(np.arange(len(v)), np.abs(n))
        ordinal = np.arange(len(i)) - (np.cumsum(np.abs(n)) - np.abs(n))[i] + 1
        p = np.sign(n[i])
        of = owner(at, len(v))[i]
        target = refs[i] + np.where(p > 0, ordinal * up[of], -ordinal * down[of])
        va, ta = behind(v, at, pv)[i], behind(t, at, pt)[i]
        out = {**{c: rows[c].to_numpy()[i] for c in (*self.keys, *self.order)}, "p": p, "ordinal": ordinal, "t_cross": passed(target, va, v[i], ta, t[i])}
        return pd.DataFrame(out, index=range(len(i))), [*map(np.array, zip(*(s[2] for s in steps))), v[last], t[last]]


class MinimumGap(Ordered):
    """Greedy minimum-gap filter per key."""

    state_schema = "t double"

    def __init__(self, order, gap, columns, span=None):
        super().__init__(order, span)
        self.gap, self.columns = gap, columns

    def segments(self, rows, at, known, state):
        t = rows[self.order[0]].to_numpy().tolist()
        kept, last = [], state[0].copy()
        for k, (i, end) in enumerate(zip(at.tolist(), (ends(at, len(t)) + 1).tolist())):
            if known[k]:
                i = bisect_left(t, last[k] + self.gap, i, end)
            before = len(kept)
            while i < end:
                kept.append(i)
                i = bisect_left(t, t[i] + self.gap, i + 1, end) if self.gap > 0 else i + 1
            if len(kept) > before:
                last[k] = t[kept[-1]]
        return rows.iloc[kept][self.columns], [last]


class LowPass(Ordered):
    """Exponential smoothing on irregular times per key."""

    state_schema = "y double, t double"

    def __init__(self, order, value, tau, columns, span=None):
        super().__init__(order, span)
        self.value, self.tau, self.columns = value, float(tau), columns

    def segments(self, rows, at, known, state):
        t, x = rows[self.order[0]].to_numpy(), rows[self.value].to_numpy(float)
        y, pt = np.where(known, state[0], x[at]), np.where(known, state[1], t[at])
        share = np.minimum(1.0, np.maximum(t - behind(t.astype(float), at, pt), 0) / self.tau)
        a, b = 1.0 - share, share * x
        b[at] += a[at] * y
        place = np.arange(len(t)) - at[owner(at, len(t))]
        step, i = 1, np.flatnonzero(place)
        while len(i):  # maps y -> a y + b of one key are composed over twice the distance each round
            b[i], a[i] = b[i] + a[i] * b[i - step], a[i] * a[i - step]
            step *= 2
            i = i[place[i] >= step]
        last = ends(at, len(t))
        return rows[self.columns].assign(smooth=b), [b[last], t[last]]


class BinRing(StatefulProcessor):
    """The last n bin values per key in time order; a later value of a bin replaces it, a reset clears.

    ``order`` says which of two values of one bin in a micro-batch is the later (default: as the bins).
    """

    def __init__(self, keys, bin_col, value, n, reset=None, order=None):
        self.keys, self.bin_col, self.value, self.n, self.reset, self.order = keys, bin_col, value, n, reset, order or [bin_col]

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", "bin long, value double")

    def handleInputRows(self, key, rows, timerValues):
        # state is older than any row; frames come in no order, so each bin's newest row counts
        best = {int(b): ((), float(v)) for b, v in self.ring.get()} if self.ring.exists() else {}
        cleared = ()
        for pdf in rows:
            pdf = pdf.sort_values(self.order)
            if self.reset:
                at = pdf.loc[pdf[self.reset].astype(bool), self.order].tail(1)
                cleared = max([cleared, *at.itertuples(index=False, name=None)])
            new = pdf.drop_duplicates(self.bin_col, keep="last")
            for b, x, t in zip(new[self.bin_col], new[self.value], new[self.order].itertuples(index=False, name=None)):
                if t >= best.get(int(b), ((), 0.0))[0]:
                    best[int(b)] = (t, float(x))
            if not self.reset:  # a bin with n newer ones never comes back
                best = {b: best[b] for b in sorted(best)[-self.n :]}
        have = {b: best[b][1] for b in sorted(b for b, (t, _) in best.items() if t >= cleared)[-self.n :]}
        self.ring.put([(int(b), float(v)) for b, v in sorted(have.items())])
        yield pd.DataFrame([[*key, [v for _, v in sorted(have.items())]]], columns=[*self.keys, "ring"])

    def close(self) -> None:
        pass


class ChunkMerge(StatefulProcessor):
    """Overlapping chunks of steps: the newest chunk wins per step; steps before its start are dropped.

    Without ``step_ms`` every change of a step is handed out at once and all steps stay in
    state. With it step s lasts from ``origin_ms`` + s * ``step_ms`` for that long: a timer
    hands a step out once, when the watermark has passed its end, and its state goes. Keys of
    one group (``by``, set by ``apply``) share an entry and a timer a step.
    """

    by: list[str] | None = None
    groups: int | None = None

    def __init__(self, keys, step, chunk, value, step_ms=None, origin_ms=0):
        self.keys, self.step, self.chunk, self.value, self.step_ms, self.origin_ms = keys, step, chunk, value, step_ms, origin_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "step long", "rows binary" if self.by else "chunk long, value double")

    def _rows(self, key, steps: dict) -> pd.DataFrame:
        return pd.DataFrame([[*key, s, c, v] for s, (c, v) in steps.items()], columns=[*self.keys, self.step, "from_chunk", self.value])

    def _newest(self, pieces: list[pd.DataFrame]) -> pd.DataFrame:
        """The newest chunk per key and step, of equal ones the last."""
        pdf = pd.concat(pieces)
        return pdf.sort_values(self.chunk, kind="stable").drop_duplicates([*told_apart(self.by, pdf), self.step], keep="last")

    def _group(self, key, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        touched = None
        for pdf in rows:
            pdf = pdf.loc[pdf[self.step] >= pdf[self.chunk], [*self.by, self.step, self.chunk, self.value]]
            pdf = pdf.astype({self.step: "int64", self.chunk: "int64", self.value: "float64"})
            touched = self._newest([pdf] if touched is None else [touched, pdf])
        if touched is None:
            return
        for step, new in touched.groupby(self.step):
            at = (int(step),)
            held = self.steps.containsKey(at)
            if self.step_ms and not held:
                self.handle.registerTimer(self.origin_ms + (at[0] + 1) * self.step_ms)
            new = new.assign(**{NUMBER: 1})
            best = self._newest([unpacked(self.steps.getValue(at)[0]).assign(**{NUMBER: 0}), new]) if held else new
            self.steps.updateValue(at, (packed(best.drop(columns=NUMBER)),))
            if not self.step_ms:
                yield self._handed(key, best[best[NUMBER] == 1])

    def _handed(self, key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = emptied(self.by, self.groups, key, pdf)
        return pdf[[*self.by, self.step, self.chunk, self.value]].set_axis([*self.keys, self.step, "from_chunk", self.value], axis=1)

    def handleInputRows(self, key, rows, timerValues):
        if self.by:
            yield from self._group(key, rows)
            return
        touched = {}
        for pdf in rows:
            # the newest chunk of each step of a frame; the order of frames does not matter
            pdf = pdf[pdf[self.step] >= pdf[self.chunk]].sort_values(self.chunk).drop_duplicates(self.step, keep="last")
            for step, chunk, x in zip(pdf[self.step], pdf[self.chunk], pdf[self.value]):
                step, chunk, x = int(step), int(chunk), float(x)
                held = step not in touched and self.steps.containsKey((step,))
                if self.step_ms and not held and step not in touched:
                    self.handle.registerTimer(self.origin_ms + (step + 1) * self.step_ms)
                have = touched[step][0] if step in touched else self.steps.getValue((step,))[0] if held else chunk
                if have <= chunk:
                    touched[step] = (chunk, x)
        for step, to in touched.items():
            self.steps.updateValue((step,), to)
        if not self.step_ms:
            yield self._rows(key, touched)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        step = (expiredTimerInfo.getExpiryTimeInMs() - self.origin_ms) // self.step_ms - 1
        if self.steps.containsKey((step,)):
            to = self.steps.getValue((step,))
            yield self._handed(key, unpacked(to[0])) if self.by else self._rows(key, {step: tuple(to)})
            self.steps.removeKey((step,))

    def close(self) -> None:
        pass


class PreviousFrame(Ordered):
    """Hands every (frame, value) the value of exactly the frame before, across micro-batches."""

    state_schema = "frame long, value double"

    def __init__(self, keys, frame, value, span=None):
        super().__init__([frame], span)
        self.keys, self.frame, self.value = keys, frame, value

    def segments(self, rows, at, known, state):
        f, x = rows[self.frame].to_numpy("int64"), rows[self.value].to_numpy(float)
        pf, px = np.where(known, state[0], f[at]), np.where(known, state[1], math.nan)  # no frame precedes itself
        adjacent = behind(f, at, pf) == f - 1
        previous = np.where(adjacent, behind(x, at, px), np.nan)
        out = {**{c: rows[c].to_numpy() for c in self.keys}, self.frame: f, self.value: x, "previous": pd.Series(previous).astype(object).where(adjacent, None)}
        last = ends(at, len(f))
        return pd.DataFrame(out, index=range(len(f))), [f[last], x[last]]


def apply(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str = "Append", event_time: Column | None = None, delay: str | None = None, groups: int | None = None) -> DataFrame:
    """Runs a processor per key. ``event_time`` (a timestamp) with ``delay`` drives the timers of those that hold rows.

    Every key takes calls, state entries and timers of its own, so many keys of few rows are
    slow. With ``groups`` keys are dealt over so many groups by hash, and a group's keys are
    handled at once (``Ordered`` and ``ChunkMerge``). A stream keeps the number it starts with.
    """
    if groups:
        if not hasattr(processor, "by"):
            raise ValueError(f"{type(processor).__name__} takes no groups of keys")
        processor.by, processor.groups = list(keys), groups
        # a group's key column is null throughout or nowhere; whole numbers are filled, as pandas makes doubles of those with nulls
        nulls = sum((F.when(F.col(k).isNull(), F.lit(groups * 2**i)).otherwise(F.lit(0)) for i, k in enumerate(keys)), F.lit(0))
        df = df.withColumn(GROUP, F.pmod(F.xxhash64(*keys), F.lit(groups)) + nulls)
        whole = [k for k in keys if isinstance(df.schema[k].dataType, T.IntegralType)]
        df, keys = df.withColumns({k: F.coalesce(k, F.lit(0).cast(df.schema[k].dataType)) for k in whole}), [GROUP]
    if event_time is None:
        return df.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "None")
    marked = df.withColumn(AT, event_time).withColumn(MS, F.unix_millis(AT)).withWatermark(AT, delay)
    return marked.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "EventTime")
