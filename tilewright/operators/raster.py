"""Rasters as pixel tables (img, y, x, values), and kernels on tiles as arrays where a stencil or a transform needs them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ramp(offset: Column, size: Column, overlap: int) -> Column:
    """Weight of a pixel that falls off linearly over the overlap at both ends of its tile, never to 0."""
    return F.least(F.lit(1.0), (F.least(offset, size - 1 - offset) + 1) / F.lit(float(overlap))) + 1e-3


def blend(pixels: DataFrame, by: list[str], value: str, weight: Column, eps: float = 1e-9) -> DataFrame:
    """Weighted mean where tiles overlap; a pixel that one tile shows keeps its value unchanged."""
    w = weight.cast("double")
    agg = pixels.groupBy(*by).agg(F.sum(F.col(value) * w).alias("_s"), F.sum(w).alias("_w"), F.count("*").alias("n_tiles"), F.max(value).alias("_v"))
    return agg.select(*by, F.when(F.col("n_tiles") == 1, F.col("_v").cast("double")).otherwise(F.col("_s") / F.greatest("_w", F.lit(eps))).alias("value"), "n_tiles")


def owners(pixels: DataFrame, by: list[str], tile: str, distance: Column) -> DataFrame:
    """The tile whose centre is nearest; the lower tile wins among equals."""
    return pixels.groupBy(*by).agg(F.min(F.struct(distance.alias("d"), F.col(tile).alias("t"))).alias("_o")).select(*by, F.col("_o.t").alias("owner"))


def integral(pixels: DataFrame, img: str, value: str) -> DataFrame:
    """Summed-area table: sums along rows, then of those along columns."""
    rows = Window.partitionBy(img, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    columns = Window.partitionBy(img, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("_r", F.sum(value).over(rows)).withColumn("area_sum", F.sum("_r").over(columns)).drop("_r")


def coarse(pixels: DataFrame, img: str, value: str, factor: int) -> DataFrame:
    return pixels.groupBy(img, F.floor(F.col("y") / factor).cast("long").alias("cy"), F.floor(F.col("x") / factor).cast("long").alias("cx")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def seam_ratio(pixels: DataFrame, img: str, value: str, period: int, offset: int) -> DataFrame:
    """Mean step across the columns at a tile's border over the mean step elsewhere."""
    w = Window.partitionBy(img, "y").orderBy("x")
    step = F.abs(F.col(value) - F.lag(value).over(w))
    at = F.pmod(F.col("x") - offset, F.lit(period)) == 0
    steps = pixels.select(img, step.alias("step"), at.alias("seam")).where("step is not null")
    return steps.groupBy(img).agg(F.avg(F.when(F.col("seam"), F.col("step"))).alias("seam_step"), F.avg(F.when(~F.col("seam"), F.col("step"))).alias("other_step")).withColumn("ratio", F.try_divide("seam_step", "other_step"))


def errors(pixels: DataFrame, img: str, a: str, b: str, data_range: float = 255.0) -> DataFrame:
    """mse, rmse, nrmse (by the range of a), psnr of two value columns; psnr is NULL where they are equal."""
    d = F.pow(F.col(a) - F.col(b), 2)
    got = pixels.groupBy(img).agg(F.avg(d).alias("mse"), (F.max(a) - F.min(a)).alias("_span"))
    return got.select(img, "mse", F.sqrt("mse").alias("rmse"), F.try_divide(F.sqrt("mse"), F.col("_span").cast("double")).alias("nrmse"), F.when(F.col("mse") > 0, 10 * F.log10(F.lit(data_range * data_range) / F.col("mse"))).alias("psnr"))


def laplacian_focus(pixels: DataFrame, img: str, value: str) -> DataFrame:
    """Variance of the four-neighbour Laplacian over inner pixels."""
    row, column = Window.partitionBy(img, "y").orderBy("x"), Window.partitionBy(img, "x").orderBy("y")
    lap = F.lag(value).over(row) + F.lead(value).over(row) + F.lag(value).over(column) + F.lead(value).over(column) - 4 * F.col(value)
    return pixels.select(img, lap.cast("double").alias("lap")).where("lap is not null").groupBy(img).agg(F.var_pop("lap").alias("focus"), F.count("lap").alias("n"))


def tiles(pixels: DataFrame, img: str, *values: str) -> DataFrame:
    """img, h, w and each value as one array in row order: a tile per row, for kernels that need their neighbours."""
    order = F.struct("y", "x", *values)
    got = pixels.groupBy(img).agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"), F.array_sort(F.collect_list(order)).alias("_p"))

    def column(v: str) -> Column:
        return F.transform("_p", lambda p: p[v].cast("double")).alias(v)

    return got.select(img, "h", "w", *map(column, values))


def _per_tile(df: DataFrame, img: str, columns: list[str], kernel, schema: str) -> DataFrame:
    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                h, w = int(r.h), int(r.w)
                arrays = [np.asarray(getattr(r, c), float) for c in columns]
                if all(len(a) == h * w for a in arrays):
                    rows += [(getattr(r, img), *x) for x in kernel(*[a.reshape(h, w) for a in arrays])]
            yield pd.DataFrame(rows, columns=[img, *[s.split()[0] for s in schema.split(", ")]])

    return df.mapInPandas(run, f"{img} {dict(df.dtypes)[img]}, {schema}")


def _window_mean(a: np.ndarray, k: int) -> np.ndarray:
    s = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def ssim(a: np.ndarray, b: np.ndarray, data_range: float = 255.0, k: int = 7) -> float:
    """Mean structural similarity over k x k windows, with sample variances."""
    k = min(k, *a.shape)
    ma, mb = _window_mean(a, k), _window_mean(b, k)
    n = k * k / max(1, k * k - 1)
    va, vb, cov = (n * (_window_mean(p, k) - q) for p, q in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def tile_ssim(df: DataFrame, img: str, a: str, b: str) -> DataFrame:
    return _per_tile(df, img, [a, b], lambda x, y: [(ssim(x, y),)], "ssim double")


def label(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a mask: labels from 1, by the place of their first pixel; 0 is background."""
    out = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = out.copy()
        for axis in (0, 1):
            for step in (1, -1):
                other = np.roll(out, step, axis)
                edge = [slice(None)] * 2
                edge[axis] = slice(0, 1) if step == 1 else slice(-1, None)
                other[tuple(edge)] = 0
                new = np.where(mask & (other > 0), np.minimum(new, other), new)
        if (new == out).all():
            return np.searchsorted(np.unique(new[new > 0]), new) * mask + mask.astype(int) * (new > 0) if mask.any() else out
        out = new


def tile_blobs(df: DataFrame, img: str, value: str, least: float, size: int) -> DataFrame:
    """blob, area, cy, cx of the connected parts over a level that have at least size pixels."""

    def kernel(a: np.ndarray) -> list[tuple]:
        lab = label(a >= least)
        out = []
        for k in range(1, int(lab.max(initial=0)) + 1):
            y, x = np.nonzero(lab == k)
            if len(y) >= size:
                out.append((k, len(y), float(y.mean()), float(x.mean())))
        return out

    return _per_tile(df, img, [value], kernel, "blob long, area long, cy double, cx double")


def period_score(a: np.ndarray, period: int) -> float:
    """Autocorrelation at the period, by FFT, as a part of that at 0: 1 for a pattern that repeats, 0 for none."""
    z = a - a.mean()
    power = np.abs(np.fft.fft2(z)) ** 2
    auto = np.fft.ifft2(power).real
    return float((auto[period % a.shape[0], 0] + auto[0, period % a.shape[1]]) / (2 * auto[0, 0])) if auto[0, 0] > 1e-9 else 0.0


def tile_period(df: DataFrame, img: str, value: str, period: int) -> DataFrame:
    return _per_tile(df, img, [value], lambda a: [(period_score(a, period),)], "score double")


def best_shift(a: np.ndarray, b: np.ndarray, least_overlap: float = 0.25) -> tuple[int, int, float]:
    """dy, dx of b against a with the best normalised correlation where they overlap enough; all shifts by FFT."""
    h, w = a.shape
    shape = (2 * h, 2 * w)
    spectrum = lambda m: np.fft.rfft2(m, shape)
    corr = lambda p, q: np.fft.irfft2(p * np.conj(q), shape)
    one = spectrum(np.ones_like(a))
    fa, fb, fa2, fb2 = spectrum(a), spectrum(b), spectrum(a * a), spectrum(b * b)
    n = np.maximum(np.rint(corr(one, one)), 1)
    sa, sb = corr(fa, one), corr(one, fb)
    cov = corr(fa, fb) - sa * sb / n
    va, vb = corr(fa2, one) - sa * sa / n, corr(one, fb2) - sb * sb / n
    ncc = np.where(n >= least_overlap * h * w, cov / np.sqrt(np.maximum(va * vb, 1e-9)), -1.0)
    y, x = np.unravel_index(int(np.argmax(np.round(ncc, 9))), ncc.shape)
    return int(y - shape[0] if y >= h else y), int(x - shape[1] if x >= w else x), float(ncc[y, x])


def tile_shift(df: DataFrame, img: str, a: str, b: str) -> DataFrame:
    return _per_tile(df, img, [a, b], lambda p, q: [best_shift(p, q)], "dy long, dx long, ncc double")


def _runs(ok: np.ndarray, axis: int) -> np.ndarray:
    """How many cells in a row are set from each one on, along an axis."""
    ok = np.moveaxis(ok, axis, 0)
    out = np.zeros((len(ok) + 1, *ok.shape[1:]), np.int64)
    for k in range(len(ok) - 1, -1, -1):
        out[k] = np.where(ok[k], out[k + 1] + 1, 0)
    return np.moveaxis(out[:-1], 0, axis)


def clean_rectangle(bad: np.ndarray, tile: int = 1, tissue: np.ndarray | None = None) -> tuple[int, int, int, int]:
    """y, x of the largest rectangle of whole tiles without a bad cell, and its height and width in tiles.

    Of equal areas the squarer is taken, then the lower one; of its places the one with the most tissue, then the first.
    One scan for each height: where columns are clean that far down, the longest run of such columns is the width.
    """
    down, best, runs = _runs(~bad, 0), (0, 0, 0, 0), None
    for ny in range(1, bad.shape[0] // tile + 1):
        across = _runs(down >= ny * tile, 1)
        nx = int(across.max(initial=0)) // tile
        if not nx:
            break
        if (rank := (ny * nx, -abs(ny - nx))) > best[:2]:
            best, runs = (*rank, ny, nx), across
    if runs is None:
        return 0, 0, 0, 0
    ny, nx = best[2:]
    h, w = ny * tile, nx * tile
    fits = runs[: bad.shape[0] - h + 1, : bad.shape[1] - w + 1] >= w
    total = np.pad((np.zeros_like(bad) if tissue is None else tissue).astype(np.int64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    inside = total[h:, w:] - total[:-h, w:] - total[h:, :-w] + total[:-h, :-w]
    y, x = np.unravel_index(int(np.argmax(np.where(fits, inside, -1))), fits.shape)
    return int(y), int(x), ny, nx


def tile_rectangle(df: DataFrame, img: str, value: str, below: float, tissue: str, most: float, tile: int) -> DataFrame:
    """Cells of a value under below are bad; tissue is what another value has under most."""
    return _per_tile(df, img, [value, tissue], lambda a, t: [clean_rectangle(a < below, tile, t < most)], "y long, x long, ny long, nx long")


def _box(a: np.ndarray, r: int, how) -> np.ndarray:
    p = np.pad(a, r, mode="edge")
    return how(np.stack([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1)]), 0)


def closing(mask: np.ndarray, r: int) -> np.ndarray:
    """Dilation, then erosion, with a square of 2 r + 1."""
    return _box(_box(mask, r, np.max), r, np.min)


def tile_closing(df: DataFrame, img: str, value: str, least: float, r: int) -> DataFrame:
    def kernel(a: np.ndarray) -> list[tuple]:
        mask = a >= least
        closed = closing(mask, r)
        return [(int(mask.sum()), int(closed.sum()), int(_box(closed, r, np.max).sum()))]

    return _per_tile(df, img, [value], kernel, "before long, closed long, widened long")


def fit_template(a: np.ndarray, t: np.ndarray) -> tuple[int, int, float]:
    """y, x and normalised correlation of the best place of t in a; the first among equals."""
    v = np.lib.stride_tricks.sliding_window_view(a, t.shape).reshape(-1, t.size)
    z = v - v.mean(1, keepdims=True)
    s = t.reshape(-1) - t.mean()
    ncc = np.round(z @ s / np.sqrt(np.maximum((z * z).sum(1) * (s * s).sum(), 1e-12)), 9)
    k = int(ncc.argmax())
    return k // (a.shape[1] - t.shape[1] + 1), k % (a.shape[1] - t.shape[1] + 1), float(ncc[k])


def tile_template(df: DataFrame, img: str, a: str, b: str, size: int) -> DataFrame:
    def kernel(p: np.ndarray, q: np.ndarray) -> list[tuple]:
        y, x = ((n - size) // 2 for n in q.shape)
        return [fit_template(p, q[y : y + size, x : x + size])]

    return _per_tile(df, img, [a, b], kernel, "y long, x long, ncc double")


def tile_holes(df: DataFrame, img: str, value: str, r: int) -> DataFrame:
    def kernel(a: np.ndarray) -> list[tuple]:
        depth = np.maximum(_box(a, r, np.mean) - a, 0)
        return [(float(np.percentile(depth[depth > 0], 75)) if (depth > 0).any() else 0.0, int((depth > 0).sum()))]

    return _per_tile(df, img, [value], kernel, "depth double, n long")


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur; borders repeat."""
    r = max(1, round(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        a = np.apply_along_axis(lambda line: np.convolve(np.pad(line, r, mode="edge"), k, "valid"), axis, a)
    return a


def tile_masked_scale(df: DataFrame, img: str, value: str, mask: str, least: float, factor: float, sigma: float) -> DataFrame:
    def kernel(a: np.ndarray, m: np.ndarray) -> list[tuple]:
        soft = gaussian((m >= least).astype(float), sigma)
        out = np.clip(a * (1 + (factor - 1) * soft), 0, 255)
        return [(float(out.mean()), int((out >= 255).sum()))]

    return _per_tile(df, img, [value, mask], kernel, "mean double, clipped long")


def equalise(a: np.ndarray, size: int, limit: float) -> np.ndarray:
    """Histogram equalisation of each block, no bin above limit times the mean one, mapped smoothly between blocks."""
    h, w = (n // size for n in a.shape)
    maps = np.empty((h, w, 256))
    for i in range(h):
        for j in range(w):
            n = np.bincount(a[i * size : (i + 1) * size, j * size : (j + 1) * size].astype(int).reshape(-1), minlength=256).astype(float)
            top = max(1.0, limit * size * size / 256)
            over = np.maximum(n - top, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(n, top) + over / 256) * 255 / (size * size)
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    fy, fx = np.clip((y + 0.5) / size - 0.5, 0, h - 1), np.clip((x + 0.5) / size - 0.5, 0, w - 1)
    y0, x0 = np.minimum(fy.astype(int), max(0, h - 2)), np.minimum(fx.astype(int), max(0, w - 2))
    y1, x1, v = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), a.astype(int)
    wy, wx = fy - y0, fx - x0
    return (maps[y0, x0, v] * (1 - wy) + maps[y1, x0, v] * wy) * (1 - wx) + (maps[y0, x1, v] * (1 - wy) + maps[y1, x1, v] * wy) * wx


def tile_equalised(df: DataFrame, img: str, value: str, size: int, limit: float) -> DataFrame:
    def kernel(a: np.ndarray) -> list[tuple]:
        out = equalise(a, size, limit)
        return [(float(out.mean()), float(out.std()))]

    return _per_tile(df, img, [value], kernel, "mean double, std double")


def ms_ssim(a: np.ndarray, b: np.ndarray, weights: tuple = (0.3, 0.4, 0.3), data_range: float = 255.0) -> float:
    """Structural similarity over halved sizes: contrast and structure at each, luminance at the last."""
    c1, c2, out = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2, 1.0
    for i, w in enumerate(weights):
        k = min(7, *a.shape)
        ma, mb = _window_mean(a, k), _window_mean(b, k)
        va, vb, cov = (_window_mean(p, k) - q for p, q in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
        part = float(((2 * cov + c2) / (va + vb + c2)).mean())
        if i == len(weights) - 1:
            part *= float(((2 * ma * mb + c1) / (ma * ma + mb * mb + c1)).mean())
        out *= max(part, 0.0) ** w
        a, b = (m[: m.shape[0] // 2 * 2, : m.shape[1] // 2 * 2].reshape(m.shape[0] // 2, 2, m.shape[1] // 2, 2).mean((1, 3)) for m in (a, b))
    return out


def tile_ms_ssim(df: DataFrame, img: str, a: str, b: str) -> DataFrame:
    return _per_tile(df, img, [a, b], lambda x, y: [(ms_ssim(x, y),)], "ms_ssim double")


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull of pixel squares, by a monotone chain over their corners."""
    corners = sorted({(y + dy, x + dx) for y, x in points.tolist() for dy in (0, 1) for dx in (0, 1)})

    def half(rows: list) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    h = half(corners) + half(corners[::-1])
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(h, h[1:] + h[:1]))) / 2


def tile_hulls(df: DataFrame, img: str, value: str, least: float, size: int) -> DataFrame:
    """blob, area, hull, solidity of the connected parts over a level."""

    def kernel(a: np.ndarray) -> list[tuple]:
        lab, out = label(a >= least), []
        for k in range(1, int(lab.max(initial=0)) + 1):
            p = np.argwhere(lab == k)
            if len(p) >= size:
                hull = hull_area(p)
                out.append((k, len(p), hull, len(p) / hull))
        return out

    return _per_tile(df, img, [value], kernel, "blob long, area long, hull double, solidity double")


def simplex(f, start: list[float], step: float = 0.25, rounds: int = 300, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """The least of f that a Nelder-Mead simplex finds from a start."""
    n = len(start)
    x = np.array([start, *(np.array(start) + step * np.eye(n))], float)
    y = np.array([f(p) for p in x])
    for _ in range(rounds):
        order = np.argsort(y, kind="stable")
        x, y = x[order], y[order]
        if y[-1] - y[0] < tolerance:
            break
        mid = x[:-1].mean(0)
        trial = lambda t: (mid + t * (x[-1] - mid),)  # noqa: B023, E731
        (r,) = trial(-1.0)
        fr = f(r)
        if fr < y[0]:
            (e,) = trial(-2.0)
            fe = f(e)
            x[-1], y[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < y[-2]:
            x[-1], y[-1] = r, fr
        else:
            (c,) = trial(-0.5 if fr < y[-1] else 0.5)
            fc = f(c)
            if fc < min(fr, y[-1]):
                x[-1], y[-1] = c, fc
            else:
                x[1:] = x[0] + 0.5 * (x[1:] - x[0])
                y[1:] = [f(p) for p in x[1:]]
    return x[y.argmin()], float(y.min())


def tile_fit(df: DataFrame, img: str, a: str, b: str) -> DataFrame:
    """gain and offset that bring a nearest to b (mean absolute difference), by simplex."""

    def kernel(p: np.ndarray, q: np.ndarray) -> list[tuple]:
        best, error = simplex(lambda t: float(np.abs(t[0] * p + t[1] * 100 - q).mean()), [1.0, 0.0])
        return [(float(best[0]), float(best[1] * 100), error)]

    return _per_tile(df, img, [a, b], kernel, "gain double, shift double, error double")
