"""Fire detection on tables of image pixels (fn, y, x, bands) with scanlines (fn, y, time).

A scene is cut into segments of rows; everything after that is local to a segment, so one shuffle by
(fn, segment) serves masks, tiles and the contextual test.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.schemas import SCENE
from emberline.sources import files


def nearest_pixel(df: DataFrame, lat: float, lon: float, lat_radius: float, lon_radius: float) -> DataFrame:
    """For each orbit the pixels of a box around a site with the least distance in latitude; ties all stay."""
    box = df.filter(F.col("lat").between(lat - lat_radius, lat + lat_radius) & F.col("lon360").between(lon - lon_radius, lon + lon_radius))
    return box.withColumn("__r", F.rank().over(Window.partitionBy("fn").orderBy(F.abs(F.col("lat") - lat)))).filter("__r = 1").drop("__r")


def scene_mask(px: DataFrame, conf: dict = SCENE, bands: tuple[str, ...] = ("b1", "b2", "b3", "b4", "b5")) -> DataFrame:
    """Bands are missing by day, beyond the latitudes, and at high angles."""
    out = (F.col("b1") > conf["b1_max"]) | (F.col("lat") > conf["lat_max"]) | (F.col("lat") < conf["lat_min"]) | (F.col("satza") > conf["satza_max"])
    return px.withColumns({b: F.when(F.coalesce(out, F.lit(False)), F.lit(None)).otherwise(F.col(b)) for b in bands})


def band_diffs(px: DataFrame) -> DataFrame:
    return px.withColumns({"b34": F.col("b3") - F.col("b4"), "b45": F.col("b4") - F.col("b5")})


def slot(at: Column, size: Column, parts: int) -> Column:
    """Which of ``parts`` nearly equal parts of 0..size a place is in; edges are rounded, halves to even."""
    edges = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.rint(i * size / parts))
    return F.size(F.filter(edges, lambda e: e <= at))


def edge(part: Column, size: Column, parts: int) -> Column:
    """First place of a part."""
    return F.rint(part * size / parts).cast("int")


def segment_orbits(px: DataFrame, segments: int = SCENE["segments"], min_valid: float = SCENE["min_valid"]) -> DataFrame:
    """``px`` with subset_no, its first row and its rows; segments with too few valid pixels are left out."""
    size = px.groupBy("fn").agg((F.max("y") + 1).alias("__n"))
    out = px.join(size, "fn")
    out = out.withColumn("subset_no", slot(F.col("y"), F.col("__n"), segments))
    first = edge(F.col("subset_no"), F.col("__n"), segments)
    out = out.withColumns({"row_min": first, "n_rows": edge(F.col("subset_no") + 1, F.col("__n"), segments) - first}).drop("__n")
    by = Window.partitionBy("fn", "subset_no")
    return out.withColumn("__v", F.count("b3").over(by) / F.count("*").over(by)).filter(F.col("__v") > min_valid).drop("__v")


def cloud_mask(px: DataFrame, conf: dict = SCENE) -> DataFrame:
    """cloud 1 where it is cold, or reflects in the middle infrared without being warm."""
    test = (F.col("b4") < conf["cold"]) | ((F.col("b34") > conf["cloud_b34"]) & (F.col("b3") < conf["cloud_b3"]))
    return px.withColumn("cloud", F.coalesce(test, F.lit(False)).cast("int"))


def buffer_mask(px: DataFrame) -> DataFrame:
    """cloud_buffered 1 within one pixel of a cloud of the same segment."""
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    near = px.filter("cloud = 1").select("fn", "subset_no", "y", "x", F.explode(step).alias("dy")).withColumn("dx", F.explode(step))
    near = near.select("fn", "subset_no", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), F.lit(1).alias("__c")).distinct()
    out = px.join(near, ["fn", "subset_no", "y", "x"], "left")
    return out.withColumn("cloud_buffered", F.coalesce("__c", F.lit(0))).drop("__c")


def potential_fires(px: DataFrame, conf: dict = SCENE, tiles: int = SCENE["tiles"]) -> DataFrame:
    """candidate 1 for pixels above their tile's percentile in b3 and in b34, clear, and warm against b4."""
    width = px.groupBy("fn").agg((F.max("x") + 1).alias("__w"))  # a row for each orbit
    tiled = px.join(width, "fn").withColumns(
        {"tile_r": slot(F.col("y") - F.col("row_min"), F.col("n_rows"), tiles), "tile_c": slot(F.col("x"), F.col("__w"), tiles)}
    )
    keys = ["fn", "subset_no", "tile_r", "tile_c"]
    cut = tiled.groupBy(*keys).agg(F.percentile("b3", F.lit(conf["percentile"])).alias("__p3"), F.percentile("b34", F.lit(conf["percentile"])).alias("__p34"))
    test = (F.col("b3") > F.col("__p3")) & (F.col("b34") > F.col("__p34")) & (F.col("cloud_buffered") == 0) & (F.col("b34") >= conf["min_b34"])
    return tiled.join(cut, keys).withColumn("candidate", F.coalesce(test, F.lit(False)).cast("int")).drop("__p3", "__p34", "__w")


#: Rows of pixels that the contextual test takes together, besides those around them.
CONTEXT_ROWS = 256
#: Smallest and largest reach of a window, and candidates whose windows are held at one time.
REACHES, CANDIDATES = (2, 7), 4096


def _sums(mask: np.ndarray, pad: int) -> np.ndarray:
    """Sums of ``mask`` over all rectangles from the first corner on, with a border of ``pad`` empty pixels."""
    return np.pad(np.pad(mask.astype(np.int64), pad).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))


def _within(sums: np.ndarray, y: np.ndarray, x: np.ndarray, reach: int) -> np.ndarray:
    """How much of the mask lies within ``reach`` of each padded place."""
    top, left, bottom, right = y - reach, x - reach, y + reach + 1, x + reach + 1
    return sums[bottom, right] - sums[top, right] - sums[bottom, left] + sums[top, left]


def contextual_test(b3: np.ndarray, b34: np.ndarray, candidate: np.ndarray, cloud: np.ndarray, conf: dict = SCENE) -> list[tuple[int, int, str]]:
    """(row, column, status) of every candidate: fire, not fire, or undetermined.

    The background is the window without the 3 x 3 pixels around the candidate; candidates, clouds and missing pixels are no background.
    The window grows from 5 x 5 to 15 x 15 until enough of it is background. Summed-area tables of the pixels that are there and of the
    usable ones give the shares of all windows of all candidates, and so the smallest that suffices; candidates of one window size are then tested together.
    """
    pad = REACHES[1]
    there = ~np.isnan(b3)
    usable = there & (candidate == 0) & (cloud == 0)
    ys, xs = np.nonzero(candidate == 1)
    status = np.full(len(ys), "undetermined", object)
    y, x = ys + pad, xs + pad
    possible, good = _sums(there, pad), _sums(usable, pad)
    reach = np.zeros(len(ys), int)
    for r in range(REACHES[1], REACHES[0] - 1, -1):
        have, most = (_within(t, y, x, r) - _within(t, y, x, 1) for t in (good, possible))
        reach[have / np.maximum(most, 1) > conf["background"]] = r
    wide = {k: np.pad(v, pad, constant_values=fill) for k, v, fill in (("b3", b3, np.nan), ("b34", b34, np.nan), ("usable", usable, False))}
    for r in np.unique(reach[reach > 0]):
        window = np.arange(-r, r + 1)
        outer = (np.maximum(np.abs(window[:, None]), np.abs(window[None, :])) > 1)[None]
        all_of = np.flatnonzero(reach == r)
        for of in np.split(all_of, range(CANDIDATES, len(all_of), CANDIDATES)):
            at = y[of, None, None] + window[None, :, None], x[of, None, None] + window[None, None, :]
            use = wide["usable"][at] & outer
            n = use.sum(axis=(1, 2))
            passed = np.ones(len(of), bool)
            for band, own in (("b34", b34), ("b3", b3)):
                v = np.where(use, wide[band][at], 0.0)
                mean = v.sum(axis=(1, 2)) / n
                spread = np.where(use, np.abs(v - mean[:, None, None]), 0.0).sum(axis=(1, 2)) / n
                least = mean + np.where(spread < 1, conf["factor"] + spread, conf["factor"] * spread)
                passed &= own[ys[of], xs[of]] >= least
            status[of] = np.where(passed, "fire", "not fire")
    return [(int(a), int(b), s) for a, b, s in zip(ys, xs, status)]


def contextual_fires(px: DataFrame, conf: dict = SCENE) -> DataFrame:
    """(fn, subset_no, y, x, status) of the candidates.

    A group is a strip of CONTEXT_ROWS rows of a segment with the rows around it that windows reach, so its size does not depend on the segment's.
    """
    kinds = {c: px.schema[c].dataType.simpleString() for c in ("fn", "y", "x")}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = pdf["y"].min(), pdf["x"].min()
        shape = pdf["y"].max() - y0 + 1, pdf["x"].max() - x0 + 1
        at = pdf["y"] - y0, pdf["x"] - x0

        def image(c: str, missing: float) -> np.ndarray:
            a = np.full(shape, missing)
            a[at] = pdf[c].to_numpy(float)
            return a

        first = pdf["strip"].iloc[0] * CONTEXT_ROWS
        found = contextual_test(image("b3", np.nan), image("b34", np.nan), image("candidate", 0), image("cloud_buffered", 0), conf)
        rows = [(pdf["fn"].iloc[0], pdf["subset_no"].iloc[0], y + y0, x + x0, s) for y, x, s in found if first <= y + y0 < first + CONTEXT_ROWS]
        return pd.DataFrame(rows, columns=["fn", "subset_no", "y", "x", "status"])

    strip = lambda y: F.floor(y / CONTEXT_ROWS)
    near = F.explode(F.array_distinct(F.array(*[strip(F.col("y") + d) for d in (-REACHES[1], 0, REACHES[1])]))).alias("strip")
    kept = px.select("fn", "subset_no", "y", "x", "b3", "b34", "candidate", "cloud_buffered", near)
    return kept.groupBy("fn", "subset_no", "strip").applyInPandas(run, f"fn {kinds['fn']}, subset_no int, y {kinds['y']}, x {kinds['x']}, status string")


def detect(px: DataFrame, conf: dict = SCENE, segments: int = SCENE["segments"], tiles: int = SCENE["tiles"]) -> DataFrame:
    """``px`` (with b34) with segments, masks, candidates and status."""
    masked = buffer_mask(cloud_mask(segment_orbits(px, segments, conf["min_valid"]), conf))
    found = potential_fires(masked, conf, tiles)
    return found.join(contextual_fires(found, conf), ["fn", "subset_no", "y", "x"], "left")


def extract_fires(detected: DataFrame, scanlines: DataFrame) -> DataFrame:
    """Pixels of confirmed fires with the date and time of their scanline."""
    return detected.filter("status = 'fire'").join(scanlines, ["fn", "y"])


def segment_summary(detected: DataFrame) -> DataFrame:
    """Pixels, candidates, clouds and outcomes of each segment."""
    return detected.groupBy("fn", "subset_no").agg(
        F.count("*").alias("total_pxl"), F.count("b3").alias("valid_pxl"), F.sum("candidate").alias("candidates"), F.sum("cloud_buffered").alias("clouds"),
        F.sum("cloud").alias("clouds_plain"), F.count_if(F.col("status") == "fire").alias("fires"), F.count_if(F.col("status") == "not fire").alias("not_fires"),
        F.count_if(F.col("status") == "undetermined").alias("undetermined"),
    )


def scanline_ok(scan: DataFrame, flags: list[str], references: list[str]) -> DataFrame:
    """Scanlines without a bad flag and without a negative reference reading."""
    good = F.lit(True)
    for c in flags:
        good = good & (F.coalesce(F.col(c), F.lit(0)) == 0)
    for c in references:
        good = good & (F.coalesce(F.col(c), F.lit(0.0)) >= 0)
    return scan.filter(good)


def process_orbits(px: DataFrame, per_orbit, schema: str) -> tuple[DataFrame, DataFrame]:
    """``per_orbit`` (pandas in, pandas out) on each orbit: the good rows, and (fn, error) of the orbits that failed.

    Each orbit is worked on once: what it gives, rows or an error, is written to the shared folder, and both results are read from there. A failed orbit
    leaves nothing but its error; an orbit that gives no row is in neither.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out = per_orbit(pdf).assign(__failed=None, __error=None)
        except Exception as e:  # a log of what failed is the result here
            out = pd.DataFrame({"__failed": [pdf["fn"].iloc[0]], "__error": [f"{type(e).__name__}: {e}"]})
        out = out.reindex(columns=[*names, "__failed", "__error"])
        return out.astype(object).where(out.notna(), None)

    kind = px.schema["fn"].dataType.simpleString()
    done = files.stored(px.groupBy("fn").applyInPandas(run, f"{schema}, __failed {kind}, __error string"), "orbits")
    return done.filter("__error IS NULL").drop("__failed", "__error"), done.filter("__error IS NOT NULL").select(F.col("__failed").alias("fn"), F.col("__error").alias("error"))


#: Seconds of lines that are put in order together.
STITCH_SECONDS = 64


def stitch_orbits(scan: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Scanlines (platform, fn, y, t in seconds, ok, value) of overlapping files as one series.

    In the overlap of a file with the next one, a bad line takes the nearest good line of the next file within ``tolerance``;
    the next file contributes what lies after the end of the file before it. ``used_fn`` names the file a line comes from. Of two lines as near the
    earlier one is taken, of good lines at one time the smaller value. Nearest lines are found in stretches of time, by the last good line before and
    the first one after a bad line.
    """
    by = Window.partitionBy("platform").orderBy("start", "fn")
    spans = scan.groupBy("platform", "fn").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    spans = spans.withColumns({"next_fn": F.lead("fn").over(by), "next_start": F.lead("start").over(by), "before": F.lag("end").over(by)})
    lines = scan.join(spans.select("platform", "fn", "next_fn", "next_start", "before"), ["platform", "fn"])  # one row a file
    lines = lines.filter(F.col("before").isNull() | (F.col("t") > F.col("before")))
    bad = ~F.col("ok") & F.col("next_start").isNotNull() & (F.col("t") >= F.col("next_start"))
    part = lambda t: F.floor(t / STITCH_SECONDS)
    wanted = lines.filter(bad).select("platform", "next_fn", part(F.col("t")).alias("part"), "t", F.lit(True).alias("wanted"), "fn", "y")
    good = scan.filter("ok").groupBy("platform", F.col("fn").alias("next_fn"), "t").agg(F.min("value").alias("value"))
    # a good line near the end of a stretch is in the next one too
    parts = F.array_distinct(F.array(part(F.col("t") - tolerance), part(F.col("t") + tolerance)))
    good = good.select("platform", "next_fn", F.explode(parts).alias("part"), "t", F.lit(False).alias("wanted"), F.struct("t", "value").alias("line"))
    order = Window.partitionBy("platform", "next_fn", "part").orderBy("t", "wanted")
    both = wanted.unionByName(good, allowMissingColumns=True).withColumns(
        {
            "b": F.last("line", True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "a": F.first("line", True).over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    gaps = {"gap_b": F.coalesce(F.col("t") - F.col("b.t"), F.lit(float("inf"))), "gap_a": F.coalesce(F.col("a.t") - F.col("t"), F.lit(float("inf")))}
    near = both.filter("wanted").withColumns(gaps).filter(F.least("gap_a", "gap_b") <= tolerance)
    value = F.when(F.col("gap_b") <= F.col("gap_a"), F.col("b.value")).otherwise(F.col("a.value"))
    best = near.select("platform", "fn", "y", F.struct("next_fn", value.alias("value2")).alias("new"))
    out = lines.join(best, ["platform", "fn", "y"], "left")
    return out.select(
        "platform", "fn", "y", "t", (F.col("ok") | F.col("new").isNotNull()).alias("ok"), F.coalesce("new.next_fn", "fn").alias("used_fn"),
        F.when(F.col("new").isNotNull(), F.col("new.value2")).otherwise(F.col("value")).alias("value"),
    )
