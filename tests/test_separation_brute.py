"""The separation as a whole against a direct NumPy computation on a small moving scene."""

import numpy as np
import pandas as pd
import pytest

from eventloom.operators import separation as sep

H, W, T = 9, 11, 4
FX, CX, CY = 9.0, 5.0, 4.0
GAIN = -0.8


def scene():
    r = np.random.default_rng(21)
    depth = 1 + 0.02 * r.random((T, H, W))
    depth[:, 2:5, 3:6] += 0.6
    rgb = r.integers(20, 235, (H, W, 3))[None] + r.integers(-4, 5, (T, H, W, 3))
    rgb[2, 5:8, 6:10] += 15
    mv = r.normal(0, 0.05, (T, H, W, 2))
    mv[..., 0] += 0.6
    mv[2:, 2:5, 3:6, 0] += 2.0
    return depth, np.clip(rgb, 0, 255), mv


def dil(a, r):
    p = np.pad(a.astype(float), r, constant_values=-np.inf)
    return np.max([p[i:i + a.shape[0], j:j + a.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1)], axis=0)


def edge(z, r):
    dx, dy = np.zeros_like(z), np.zeros_like(z)
    dx[:, 1:] = abs(np.diff(z, axis=1))
    dy[1:] = abs(np.diff(z, axis=0))
    return dil(np.maximum(dx, dy) > 0.03 + 0.04 * np.clip(z, 0, 10), r) > 0


def bilinear(img, tx, ty):
    out = np.full(tx.shape, np.nan)
    for y, x in np.ndindex(tx.shape):
        x0, y0 = int(np.floor(tx[y, x])), int(np.floor(ty[y, x]))
        fx, fy = tx[y, x] - x0, ty[y, x] - y0
        s, ok = 0.0, True
        for dy, dx, w in ((0, 0, (1 - fx) * (1 - fy)), (0, 1, fx * (1 - fy)), (1, 0, (1 - fx) * fy), (1, 1, fx * fy)):
            if w > 0:
                ok &= 0 <= y0 + dy < H and 0 <= x0 + dx < W
                s += w * img[y0 + dy, x0 + dx] if ok else 0
        out[y, x] = s if ok else np.nan
    return out


def sig(v):
    return 1 / (1 + np.exp(-np.clip(v, -20, 20)))


def brute(causal):
    depth, rgb, mv = scene()
    yy, xx = np.mgrid[:H, :W].astype(float)
    glog = np.log1p(np.rint(rgb @ np.array([0.299, 0.587, 0.114])))
    ch = (rgb + 1.0) / (rgb + 1.0).sum(-1, keepdims=True)
    cols = {n: np.zeros((T, H, W)) for n in ("flow", "rel", "dep", "pho", "chr")}
    valid, reliable = np.zeros((T, H, W), bool), np.zeros((T, H, W), bool)
    for k in range(T - 1):
        z = depth[k]
        u = FX * ((xx - CX) * z / FX - 0.05) / z + CX
        v = yy
        ok = (u >= -1e-4) & (u <= W - 1 + 1e-4)
        ex, ey = np.where(ok, u - xx, 0), np.where(ok, v - yy, 0)
        pred = np.where(ok, z, 0)
        m = mv[min(k + 1, T - 1)] * GAIN
        fe = np.hypot(m[..., 0] - ex, m[..., 1] - ey)
        de = abs(bilinear(depth[k + 1], xx + ex, yy + ey) - pred) / np.maximum(pred, 0.05)
        dl = bilinear(glog[k + 1], xx + ex, yy + ey) - glog[k]
        base = ok & (np.nan_to_num(de, nan=9) < 0.03) & ~edge(z, 1)
        pe = abs(dl - (np.median(dl[base]) if base.any() else 0))
        ce = np.sqrt(sum((bilinear(ch[k + 1, ..., i], xx + ex, yy + ey) - ch[k, ..., i]) ** 2 for i in range(3)))
        ok = ok & np.isfinite(fe) & np.isfinite(de) & np.isfinite(pe) & np.isfinite(ce)
        valid[k], reliable[k] = ok, ok & ~edge(z, 2)
        for n, a in zip(cols, (fe, fe / (1 + np.hypot(ex, ey)), de, pe, ce)):
            cols[n][k] = np.where(ok, a, 0)
    f = dict(flow=0.35, rel=0.18, dep=0.015, pho=0.04, chr=0.015)
    if not causal:
        for a in (*cols.values(), valid, reliable):
            a[-1] = a[-2]
        q = lambda a, m, p: np.quantile(a[m], p)
        f["flow"] = max(0.35, q(cols["flow"], reliable, 0.95))
        f["rel"] = np.clip(2.5 * q(cols["rel"], reliable, 0.80), 0.18, 0.40)
        still = reliable & (cols["flow"] <= f["flow"]) & (cols["rel"] <= f["rel"])
        f["dep"] = max(0.015, q(cols["dep"], still, 0.95))
        calm = still & (cols["dep"] <= f["dep"])
        f["pho"], f["chr"] = max(0.04, q(cols["pho"], calm, 0.95)), max(0.015, q(cols["chr"], calm, 0.95))
    n = T - 1 if causal else T
    soft = dict(flow=(0.12, 0.25), rel=(0.04, 0.25), dep=(0.006, 0.35), pho=(0.02, 0.35), chr=(0.008, 0.35))
    cue = {k: sig((cols[k] - f[k]) / max(soft[k][0], soft[k][1] * f[k])) for k in cols}
    flow = np.maximum(cue["flow"], cue["rel"]) * reliable
    dep, pho, chro = cue["dep"] * valid, cue["pho"] * valid, cue["chr"] * valid
    for k in range(n):
        wide = dil(flow[k], 2)
        flow[k] = np.where(valid[k] & ~reliable[k], wide, flow[k])
        dep[k], chro[k] = dil(dep[k], 2) * valid[k], dil(chro[k], 1) * valid[k]
    per = np.zeros_like(flow)
    for k in range(n):
        near = [dil(flow[k - 1], 3)] if k > 0 else []
        if not causal and k + 1 < n:
            near.append(dil(flow[k + 1], 3))
        per[k] = np.sqrt(np.clip(flow[k] * (np.max(near, axis=0) if near else flow[k]), 0, 1))
    li = pho * (1 - np.maximum.reduce([dep, chro, 0.25 * per])) * valid
    dy = flow * (1 - 0.85 * li)
    stt = (1 - flow) * (1 - li) * valid
    un = np.maximum(li, 1 - np.maximum(dy, stt))
    out = {k: np.clip(a, 0, 1) for k, a in dict(q_motion=flow, q_static=stt, q_dynamic=dy, q_illumination=li, q_unknown=un).items()}
    if causal:
        for k, a in out.items():
            a[1:] = a[:-1].copy()
            a[0] = 1.0 if k == "q_static" else 0.0
    return out


@pytest.mark.parametrize("causal", [False, True])
def test_separation(spark, causal):
    depth, rgb, mv = scene()
    k, y, x = (a.ravel() for a in np.mgrid[:T, :H, :W])
    p = spark.createDataFrame(pd.DataFrame({
        "episode": 1, "camera": "c", "frame_index": k, "y": y.astype("int32"), "x": x.astype("int32"), "depth": depth.ravel(), "mvx": mv[..., 0].ravel(), "mvy": mv[..., 1].ravel(),
        "r": rgb[..., 0].ravel(), "g": rgb[..., 1].ravel(), "b": rgb[..., 2].ravel(), "seg": 0}))
    c = spark.createDataFrame([(1, "c", i, 0.05 * i, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, FX, FX, CX, CY) for i in range(T)],
                              "episode long, camera string, frame_index long, tx double, ty double, tz double, qw double, qx double, qy double, qz double, fx double, fy double, cx double, cy double")
    got = sep.separate(p, c, GAIN, W, H, causal=causal).toPandas()
    assert len(got) == T * H * W
    want = brute(causal)
    for name, a in want.items():
        g = np.zeros((T, H, W))
        g[got.frame_index, got.y, got.x] = got[name]
        np.testing.assert_allclose(g, a, atol=1e-9, err_msg=name)


@pytest.mark.parametrize("tile", [1, 4, 64])
def test_reads_across_tiles(spark, tile):
    """Reads at any distance over the borders of tiles, of holes, of nothing and from nowhere; other columns come through as they were."""
    from eventloom.operators import pixels as px

    r = np.random.default_rng(6)
    y, x = (a.ravel() for a in np.mgrid[:H, :W])
    img = r.normal(0, 1, (2, 2, H, W))  # run, value
    hole = r.random((2, H, W)) < 0.1
    pos = [np.where(r.random((2, H * W)) < 0.3, np.rint(d), d) for d in (r.normal(0, 4, (2, H * W)), r.normal(0, 4, (2, H * W)))]
    rows, nxt = [], []
    for k in range(2):
        rows += [(k, "c", 4, int(b), int(a), float(u) if i % 17 else None, float(v), 2**60 + i, None if i % 3 else f"s{i}") for i, (b, a, u, v) in enumerate(zip(y, x, pos[0][k], pos[1][k]))]
        nxt += [(k, "c", 5, int(b), int(a), float(img[k, 0, b, a]), float(img[k, 1, b, a])) for b, a in zip(y, x) if not hole[k, b, a]]
    d = spark.createDataFrame(rows, "episode long, camera string, frame_index long, y int, x int, dx double, dy double, big long, text string").repartition(3)
    n = spark.createDataFrame(nxt, "episode long, camera string, frame_index long, y int, x int, p double, q double")
    got = px.sample_forward(d, n, "dx", "dy", ["p", "q"], tile=tile)
    assert got.columns == [*d.columns, "fwd_p", "fwd_q"]
    out = {(g.episode, g.y, g.x): g for g in got.collect()}
    assert len(out) == len(rows)
    for row in rows:
        g = out[row[0], row[3], row[4]]
        assert (g.dx, g.dy, g.big, g.text) == row[5:]
        for i, v in enumerate((g.fwd_p, g.fwd_q)):
            want = np.nan if row[5] is None else bilinear(np.where(hole[row[0]], np.nan, img[row[0], i]), np.array([[row[4] + row[5]]]), np.array([[row[3] + row[6]]]))[0, 0]
            assert (v is None and np.isnan(want)) or v == pytest.approx(want, abs=1e-12)
