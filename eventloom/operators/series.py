"""Keyed series: send-on-delta encoding, minimum-gap filter, smoothing, rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.rotation import clip
from eventloom.operators import chunked


def crossings(diff: Column, theta: float | Column) -> Column:
    """Whole thresholds contained in a positive change."""
    th = theta if isinstance(theta, Column) else F.lit(float(theta))
    return F.floor(F.greatest(diff, F.lit(0.0)) / th).cast("long")


def crossing_time(target: Column, prev: Column, cur: Column, t0: Column, t1: Column) -> Column:
    """When a straight line from prev to cur passes target; a flat step counts at its end."""
    den = cur - prev
    alpha = F.when(F.abs(den) > 1e-12, clip((target - prev) / den, 0, 1)).otherwise(F.lit(1.0))
    return t0 + alpha * F.greatest(t1 - t0, F.lit(0))


def level_steps(df: DataFrame, keys: list[str], order: list[str], value: str, theta: float, width,
                reset: Column | None = None, valid: str | None = None, q: str | None = None) -> DataFrame:
    """Send-on-delta state per row: level before, level after, previous sample.

    The reference value of a key moves by whole thresholds, so it is ``v0 + k * theta`` with
    an integer level k. With ``u = (v - v0) / theta`` a sample takes k to the nearest end of
    ``[floor(u), ceil(u)]``. While that interval stays the same k stays the same; when it
    moves up k enters at its lower end, when it moves down at its upper end. So k follows
    from the direction of the last change: lag and carry-forward instead of a recursion,
    and a long series splits into chunks.

    ``reset`` starts a new reference on that row. With ``valid``, invalid rows are skipped
    and the first valid row after them starts a new reference silently.
    """
    c = F.col
    by = [*keys, chunked.CHUNK]
    start = F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))
    d = chunked.with_chunk(df.withColumn("_v", c(value)), keys, order, width)
    if valid is not None:
        # a reset on invalid rows takes effect on the next valid row, which starts anew anyway
        d = chunked.prev_value(d, keys, order, {"_pv": c(valid)}, width)
        start = start | F.coalesce(c("_pv") == F.lit(False), F.lit(False))
        d = d.withColumn("_start", start).drop("_pv").where(valid)
    else:
        d = d.withColumn("_start", start)
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    wc = Window.partitionBy(*keys).orderBy(chunked.CHUNK)
    earlier = wc.rowsBetween(Window.unboundedPreceding, -1)
    pos = F.struct(*order)

    # first pass: previous sample and reference value, over the chunk borders
    own = F.struct("_v", c(order[0]).alias("_t"), *([c(q).alias("_q")] if q else []))
    edge = d.groupBy(*by).agg(F.max_by(own, pos).alias("_tail"), F.min_by("_v", pos).alias("_head"),
                              F.max_by(F.when(c("_start"), c("_v")), F.when(c("_start"), pos)).alias("_sv"))
    edge = edge.withColumn("_tail", F.lag("_tail").over(wc)).withColumn("_new", F.coalesce("_sv", F.when(c("_tail").isNull(), c("_head"))))
    edge = edge.select(*by, "_tail", F.coalesce(F.last("_new", ignorenulls=True).over(earlier), c("_head")).alias("_v0_in"))
    d = d.withColumns({"_near": F.lag(own).over(w), "_sv": F.last(F.when(c("_start"), c("_v")), ignorenulls=True).over(upto)})
    d = d.join(edge, by).withColumns({"_prev": F.coalesce("_near", "_tail"), "_v0": F.coalesce("_sv", "_v0_in")})
    d = d.withColumn("_start", c("_start") | c("_prev").isNull()).drop("_near", "_tail", "_sv", "_v0_in")
    u = (c("_v") - c("_v0")) / F.lit(float(theta))
    d = d.withColumns({"_lo": F.floor(u).cast("long"), "_hi": F.ceil(u).cast("long")})

    # second pass: direction of the last change of the interval
    def change(lo, hi, plo, phi):
        return F.when((lo > plo) | (hi > phi), 1).when((lo < plo) | (hi < phi), -1)

    d = d.withColumn("_pl", F.lag(F.struct("_lo", "_hi")).over(w))
    d = d.withColumn("_move", F.when(c("_start"), 0).otherwise(change(c("_lo"), c("_hi"), c("_pl._lo"), c("_pl._hi"))))
    edge = d.groupBy(*by).agg(
        F.max_by(F.struct("_lo", "_hi"), pos).alias("_tail"), F.min_by(F.struct("_lo", "_hi", "_start"), pos).alias("_h"),
        F.max_by("_move", F.when(c("_move").isNotNull(), pos)).alias("_last"))
    edge = edge.withColumn("_tail", F.lag("_tail").over(wc))
    edge = edge.withColumn("_border", F.when(c("_h._start"), 0).otherwise(change(c("_h._lo"), c("_h._hi"), c("_tail._lo"), c("_tail._hi"))))
    edge = edge.withColumn("_dir_in", F.last(F.coalesce("_last", "_border"), ignorenulls=True).over(earlier))
    d = d.join(edge.select(*by, "_tail", "_border", "_dir_in"), by)
    d = d.withColumn("_move", F.when(c("_pl").isNull(), c("_border")).otherwise(c("_move")))
    d = d.withColumn("_dir", F.coalesce(F.last("_move", ignorenulls=True).over(upto), c("_dir_in")))
    d = d.withColumn("level", F.when(c("_dir") < 0, c("_hi")).otherwise(c("_lo")))
    entering = F.when(c("_dir_in") < 0, c("_tail._hi")).otherwise(c("_tail._lo"))
    d = d.withColumn("_pk", F.coalesce(F.lag("level").over(w), entering))
    d = d.withColumns({"level_before": F.when(c("_start"), c("level")).otherwise(c("_pk")), "v_ref0": c("_v0"),
                       "v_prev": F.when(~c("_start"), c("_prev._v")), "t_prev": F.when(~c("_start"), c("_prev._t"))})
    extra = ["level", "level_before", "v_ref0", "v_prev", "t_prev"]
    if q:
        d = d.withColumn("interval_q", F.least(c("_prev._q"), c(q)))
        extra.append("interval_q")
    return d.select(*df.columns, *extra)


def encode_crossings(df: DataFrame, keys: list[str], order: list[str], value: str, theta: float, width, **state) -> DataFrame:
    """One row per threshold crossing, with its polarity, ordinal and interpolated time."""
    c = F.col
    s = level_steps(df, keys, order, value, theta, width, **state)
    n = c("level") - c("level_before")
    s = s.where(n != 0).withColumns({"p": F.signum(n.cast("double")).cast("int"), "_n": F.abs(n).cast("int")})
    s = s.withColumn("ordinal", F.explode(F.sequence(F.lit(1), c("_n"))))
    target = c("v_ref0") + (c("level_before") + c("p") * c("ordinal")) * F.lit(float(theta))
    t = crossing_time(target, c("v_prev"), c(value), c("t_prev"), c(order[0]))
    keep = ["interval_q"] if "interval_q" in s.columns else []
    return s.select(*keys, *order, "p", "ordinal", t.alias("t_cross"), *keep)


#: A change counts as whole from this share of a threshold below it on, so that ties do not hang on rounding.
NEAR = 1e-9


def two_sided_steps(v, start, up: float, down: float, state):
    """Thresholds crossed at each sample, upward less downward, and the reference before it.

    ``state`` = (v0, a, b): the reference is v0 + a * up - b * down. ``start`` marks samples
    that begin a new reference. Returns (n, reference, state after).
    """
    import math

    import numpy as np

    v0, a, b = state or (0.0, 0, 0)
    n, refs = [], []
    for x, new in zip(v.tolist(), start.tolist()):
        if new:
            v0, a, b = x, 0, 0
            n.append(0)
            refs.append(x)
            continue
        ref = v0 + a * up - b * down
        k = math.floor(max(x - ref, 0.0) / up + NEAR) or -math.floor(max(ref - x, 0.0) / down + NEAR)
        a, b = (a + k, b) if k > 0 else (a, b - k)
        n.append(k)
        refs.append(ref)
    return np.array(n, dtype="int64"), np.array(refs, dtype="float64"), (v0, a, b)


def transfer_pieces(v, before: float, up: float, down: float):
    """What a run of samples does to any reference that may enter it: rows (upper end, da, db).

    After the sample ``before`` the reference lies within one threshold of it. A sample shifts
    the references out of reach by whole thresholds, so the run as a whole is a piecewise
    shift by da * up - db * down; a sample only adds pieces where references part.
    """
    import numpy as np

    ends = np.array([before + down])
    starts = np.array([before - up])
    da, db = np.zeros(1, "int64"), np.zeros(1, "int64")
    low, high = starts[0], ends[0]  # of where references are by now
    for x in v.tolist():
        reach = x - up * (1 - NEAR), x + down * (1 - NEAR)
        if low > reach[0] and high < reach[1]:
            continue
        shift = da * up - db * down
        cuts = [x - up * (k - NEAR) for k in range(1, int((x - low) / up + NEAR) + 2)] + [x + down * (k - NEAR) for k in range(1, int((high - x) / down + NEAR) + 2)]
        for p in cuts:
            at = p - shift
            m = (starts < at) & (at < ends)
            if m.any():
                starts, ends = np.concatenate([starts, at[m]]), np.concatenate([np.where(m, at, ends), ends[m]])
                da, db, shift = (np.concatenate([c, c[m]]) for c in (da, db, shift))
        mid = (starts + ends) / 2 + shift
        da = da + np.floor(np.maximum(x - mid, 0) / up + NEAR).astype("int64")
        db = db + np.floor(np.maximum(mid - x, 0) / down + NEAR).astype("int64")
        by = np.argsort(starts)
        starts, ends, da, db = starts[by], ends[by], da[by], db[by]
        last = np.concatenate([(np.diff(da) != 0) | (np.diff(db) != 0), [True]])  # neighbours that move alike are one piece
        first = np.concatenate([[True], last[:-1]])
        starts, ends, da, db = starts[first], ends[last], da[last], db[last]
        shift = da * up - db * down
        low, high = (starts + shift).min(), (ends + shift).max()
    return ends, da, db


def two_sided_crossings(df: DataFrame, keys: list[str], order: list[str], value: str, up: str, down: str, width, reset: Column | None = None) -> DataFrame:
    """Send-on-delta with its own thresholds for rises and falls, given as columns that are constant per key.

    The reference moves by whole thresholds of either kind, ``v0 + a * up - b * down``, so
    no closed form is left; but a chunk of the series is a piecewise shift of the reference
    that enters it (``transfer_pieces``). Chunks are summed up by their pieces, one pass per
    key goes through the pieces, and every chunk is then replayed from its entry. A change
    within 1e-9 of a whole number of thresholds counts as whole. ``reset`` starts a new
    reference on that row. Keys, order, value and thresholds must not be NULL; a threshold
    must be above 0.

    One row per crossing: p (1 or -1), ordinal, interpolated t_cross.
    """
    t = order[0]
    c = F.col
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    d = chunked.with_chunk(df.select(*keys, *order, c(value).cast("double").alias("_v"), c(up).cast("double").alias("_up"), c(down).cast("double").alias("_down"),
                                     (F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))).alias("_reset")), keys, order, width)
    d = chunked.prev_value(d, keys, order, {"_pv": c("_v"), "_pt": c(t)}, width)
    d = d.withColumns({"_start": c("_reset") | c("_pv").isNull(), "_pv": F.coalesce("_pv", "_v"), "_pt": F.coalesce("_pt", c(t))}).drop("_reset")

    def summary(b):
        import numpy as np

        u, w = float(b["_up"][0]), float(b["_down"][0])
        starts = np.flatnonzero(b["_start"])
        if len(starts):  # what enters does not matter
            s = starts[-1]
            _, _, (v0, x, y) = two_sided_steps(b["_v"][s:], b["_start"][s:], u, w, None)
            ends, da, db, fixed = np.array([0.0]), np.array([x]), np.array([y]), v0
        else:
            ends, da, db = transfer_pieces(b["_v"], float(b["_pv"][0]), u, w)
            fixed = np.nan
        n = len(ends)
        return {"_seq": np.arange(n, dtype="int32"), "_end": ends, "_da": da.astype("int64"), "_db": db.astype("int64"), "_fixed": np.full(n, fixed), "_u": np.full(n, u), "_w": np.full(n, w)}

    def entries(b):
        import numpy as np

        ch = b[chunked.CHUNK]
        edges = [0, *(np.flatnonzero(ch[1:] != ch[:-1]) + 1).tolist(), len(ch)]
        u, w = float(b["_u"][0]), float(b["_w"][0])
        state, out = (0.0, 0, 0), []
        for i, j in zip(edges, edges[1:]):
            out.append(state)
            if not np.isnan(b["_fixed"][i]):
                state = (float(b["_fixed"][i]), int(b["_da"][i]), int(b["_db"][i]))
                continue
            v0, x, y = state
            k = min(i + int(np.searchsorted(b["_end"][i:j], v0 + x * u - y * w)), j - 1)
            state = (v0, x + int(b["_da"][k]), y + int(b["_db"][k]))
        return {chunked.CHUNK: ch[edges[:-1]], "_v0": np.array([o[0] for o in out]), "_a": np.array([o[1] for o in out], "int64"), "_b": np.array([o[2] for o in out], "int64")}

    def replay(b):
        u, w = float(b["_up"][0]), float(b["_down"][0])
        n, refs, _ = two_sided_steps(b["_v"], b["_start"], u, w, (float(b["_v0"][0]), int(b["_a"][0]), int(b["_b"][0])))
        on = n != 0
        return {**{k: b[k][on] for k in (*keys, *order, "_v", "_pv", "_pt", "_up", "_down")}, "_n": n[on], "_ref": refs[on]}

    moves = chunked.chunk_scan(
        d, keys, order, width, summary=summary, summary_schema="_end double, _da long, _db long, _fixed double, _u double, _w double", entries=entries,
        entry_schema="_v0 double, _a long, _b long", replay=replay,
        out_schema=", ".join(f"`{k}` {types[k]}" for k in (*keys, *order)) + f", _v double, _pv double, _pt {types[t]}, _up double, _down double, _n long, _ref double")
    m = moves.withColumn("p", F.signum(c("_n").cast("double")).cast("int")).withColumn("ordinal", F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int"))))
    target = c("_ref") + F.when(c("p") > 0, c("ordinal") * c("_up")).otherwise(-c("ordinal") * c("_down"))
    return m.select(*keys, *order, "p", "ordinal", crossing_time(target, c("_pv"), c("_v"), c("_pt"), c(t)).alias("t_cross"))


def refractory(df: DataFrame, keys: list[str], order: list[str], gap: float, width) -> DataFrame:
    """Keeps a row only if it lies at least ``gap`` after the last kept row of its key.

    A chunk's effect on the last kept time is a step function of it with few steps: only
    entries within one gap of the chunk matter, and their chains of kept rows soon merge.
    ``width`` should be many gaps. Only keys and order columns, which must not be NULL, pass
    through Python; other columns come back by a semi join.
    """
    t = order[0]
    names = [*keys, *order]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kind = "bigint" if types[t] in ("bigint", "int") else "double"

    def summary(b):
        import numpy as np

        ts = b[t]
        n = len(ts)
        nxt = np.searchsorted(ts, ts + gap, side="left").tolist()
        last = list(range(n))  # last row kept when row i is kept
        for i in range(n - 1, -1, -1):
            if nxt[i] < n:
                last[i] = last[nxt[i]]
        # the first kept row of the chunk can be any of its first gap, or the one after
        m = min(nxt[0], n - 1) + 1
        steps = [i for i in range(m) if i == m - 1 or last[i + 1] != last[i]]
        return {"_seq": np.arange(len(steps), dtype="int32"), "c_upto": ts[steps], "t_exit": ts[[last[i] for i in steps]]}

    def entries(b):
        import numpy as np

        chunks, states, known = [], [], []
        state = None
        ch, upto, ex = b[chunked.CHUNK].tolist(), b["c_upto"].tolist(), b["t_exit"].tolist()
        i, n = 0, len(ch)
        while i < n:
            j = i
            while j < n and ch[j] == ch[i]:
                j += 1
            chunks.append(ch[i])
            known.append(state is not None)
            states.append(0 if state is None else state)
            if state is None:
                state = ex[i]
            else:
                # an entry later than all candidates (a chunk within one gap of it) keeps nothing
                state = next((ex[r] for r in range(i, j) if upto[r] >= state + gap), state)
            i = j
        return {chunked.CHUNK: np.array(chunks), "_has": np.array(known), "_entry": np.array(states, dtype=b["t_exit"].dtype)}

    def replay(b):
        import numpy as np

        ts = b[t]
        n = len(ts)
        nxt = np.searchsorted(ts, ts + gap, side="left").tolist()
        i = int(np.searchsorted(ts, b["_entry"][0] + gap, side="left")) if b["_has"][0] else 0
        kept = []
        while i < n:
            kept.append(i)
            i = nxt[i]
        return {c: b[c][kept] for c in names}

    kept = chunked.chunk_scan(
        df.select(*names), keys, order, width, summary=summary, summary_schema=f"c_upto {kind}, t_exit {kind}", entries=entries,
        entry_schema=f"_has boolean, _entry {kind}", replay=replay, out_schema=", ".join(f"`{n}` {types[n]}" for n in names))
    if set(df.columns) <= set(names):
        return kept.select(*df.columns)
    return df.join(kept, names, "left_semi")


def affine_scan(df: DataFrame, keys: list[str], order: list[str], a: str, b: str, width, out: str) -> DataFrame:
    """y_t = a_t * y_(t-1) + b_t per key. Affine maps compose, so one pair per chunk carries the state.

    Keys, order columns, a and b must not be NULL; other columns are joined back.
    """
    names, chunk = [*keys, *order], [c for c in df.columns if c == chunked.CHUNK]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def fold(slopes, shifts, y):
        ys = []
        for x, z in zip(slopes.tolist(), shifts.tolist()):
            y = x * y + z
            ys.append(y)
        return ys

    def summary(blk):
        import numpy as np

        # entered with 0 the chunk ends at its shift; its slope is the product of slopes
        return {"_seq": np.zeros(1, dtype="int32"), "_pa": np.array([np.prod(blk[a])]), "_pb": np.array([fold(blk[a], blk[b], 0.0)[-1]])}

    def entries(blk):
        import numpy as np

        after = fold(blk["_pa"], blk["_pb"], 0.0)
        return {chunked.CHUNK: blk[chunked.CHUNK], "_entry": np.array([0.0, *after[:-1]])}

    def replay(blk):
        import numpy as np

        return {**{n: blk[n] for n in names}, out: np.array(fold(blk[a], blk[b], float(blk["_entry"][0])))}

    got = chunked.chunk_scan(
        df.select(*names, *chunk, a, b), keys, order, width, summary=summary, summary_schema="_pa double, _pb double", entries=entries, entry_schema="_entry double",
        replay=replay, out_schema=", ".join(f"`{n}` {types[n]}" for n in names) + f", {out} double")
    rest = [c for c in df.columns if c not in (a, b, *chunk)]
    return got if set(rest) <= set(names) else df.select(*rest).join(got, names)


def lowpass(df: DataFrame, keys: list[str], order: list[str], value: str, tau: float, width, rate: Column | None = None, out: str = "smooth") -> DataFrame:
    """Smoothing on irregular times: ``y += min(1, rate * dt / tau) * (x - y)``; the first sample seeds y."""
    c = F.col
    d = chunked.prev_value(chunked.with_chunk(df, keys, order, width), keys, order, {"_pt": c(order[0])}, width)
    r = F.lit(1.0) if rate is None else rate
    eps = F.when(c("_pt").isNull(), F.lit(1.0)).otherwise(F.least(r * F.greatest(c(order[0]) - c("_pt"), F.lit(0)) / F.lit(float(tau)), F.lit(1.0)))
    d = d.withColumn("_e", eps).withColumns({"_a": 1 - c("_e"), "_b": c("_e") * c(value)}).drop("_pt", "_e")
    return affine_scan(d, keys, order, "_a", "_b", width, out)


def bin_ring(sums: DataFrame, keys: list[str], bin_col: str, value: str, n: int) -> DataFrame:
    """The last n bins of each key in time order, as one array."""
    last = sums.groupBy(*keys, bin_col).agg(F.sum(value).alias(value))
    w = Window.partitionBy(*keys).orderBy(F.desc(bin_col))
    top = last.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(bin_col, value))), lambda s: s[value]).alias("ring"))
