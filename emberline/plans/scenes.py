"""Queries on image pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators import scenes as I
from emberline.plans import sql as Q
from emberline.plans.registry import query
from emberline.sources import standins as V

_BASE = f"{Q.PIXELS}, p0 AS (SELECT orbit AS fn, y, x, b3, b4, b3 - b4 AS b34 FROM px)"


def _pixels(spark, d):
    px = V.pixels(spark, d).withColumnRenamed("orbit", "fn")
    return px.withColumn("b34", F.col("b3") - F.col("b4"))


@query(f"""WITH {Q.H}, m AS (SELECT *, b1 > 0.005 OR lat > 70 OR lat < -60 OR satza > 35 AS out FROM h) SELECT fn, lat, satza, CASE WHEN NOT out THEN b3 END AS b3, CASE WHEN NOT out THEN b4 END AS b4,
round(CASE WHEN NOT out THEN b3 - b4 END, 6) AS b34, round(CASE WHEN NOT out THEN b4 - b5 END, 6) AS b45 FROM m WHERE b3 > 0""")
def i01_i02_scene_mask(spark, d):
    """Masked bands and their differences."""
    df = I.band_diffs(I.scene_mask(V.hotspots(spark, d).filter("b3 > 0")))
    return df.select("fn", "lat", "satza", "b3", "b4", F.round("b34", 6).alias("b34"), F.round("b45", 6).alias("b45"))


_SEG = f"""{_BASE}, n AS (SELECT fn, max(y) + 1 AS n FROM p0 GROUP BY ALL),
sg AS (SELECT p0.*, CAST(y >= round_even(n / 2.0, 0) AS INT) AS subset_no, CASE WHEN y >= round_even(n / 2.0, 0) THEN CAST(round_even(n / 2.0, 0) AS INT) ELSE 0 END AS row_min,
  CASE WHEN y >= round_even(n / 2.0, 0) THEN n - CAST(round_even(n / 2.0, 0) AS INT) ELSE CAST(round_even(n / 2.0, 0) AS INT) END AS n_rows FROM p0 JOIN n USING (fn)),
cm AS (SELECT *, CAST(b4 < 265 OR (b34 > 5 AND b3 < 285) AS INT) AS cloud FROM sg),
bm AS (SELECT *, CAST(EXISTS (SELECT 1 FROM cm c WHERE c.cloud = 1 AND c.fn = a.fn AND c.subset_no = a.subset_no AND c.y BETWEEN a.y - 1 AND a.y + 1 AND c.x BETWEEN a.x - 1 AND a.x + 1) AS INT) AS cloud_buffered FROM cm a)"""


@query(f"WITH {_SEG} SELECT fn, subset_no, row_min, n_rows, count(*) AS n FROM sg GROUP BY ALL")
def i03_segment_orbits(spark, d):
    out = I.segment_orbits(_pixels(spark, d), 2)
    return out.groupBy("fn", "subset_no", "row_min", "n_rows").agg(F.count("*").alias("n"))


@query(f"WITH {_SEG} SELECT fn, subset_no, y, x, cloud, cloud_buffered FROM bm")
def i04_i05_cloud_masks(spark, d):
    """Clouds, and clouds with a border of one pixel."""
    return I.buffer_mask(I.cloud_mask(I.segment_orbits(_pixels(spark, d), 2))).select("fn", "subset_no", "y", "x", "cloud", "cloud_buffered")


_TILE = " + ".join(f"CAST({{at}} >= round_even({i} * {{n}} / 4.0, 0) AS INT)" for i in (1, 2, 3))
_PFP = f"""{_SEG}, tl AS (SELECT *, {_TILE.format(at='(y - row_min)', n='n_rows')} AS tr, {_TILE.format(at='x', n='64')} AS tc FROM bm),
pt AS (SELECT fn, subset_no, tr, tc, quantile_cont(b3, 0.9) AS p3, quantile_cont(b34, 0.9) AS p34 FROM tl GROUP BY ALL),
pf AS (SELECT tl.*, CAST(b3 > p3 AND b34 > p34 AND cloud_buffered = 0 AND b34 >= 3 AS INT) AS candidate FROM tl JOIN pt USING (fn, subset_no, tr, tc))"""


@query(f"WITH {_PFP} SELECT fn, subset_no, y, x FROM pf WHERE candidate = 1")
def i06_potential_fires(spark, d):
    masked = I.buffer_mask(I.cloud_mask(I.segment_orbits(_pixels(spark, d), 2)))
    return I.potential_fires(masked, tiles=4).filter("candidate = 1").select("fn", "subset_no", "y", "x")


_CTX = f"""{_PFP}, nb AS (SELECT a.fn, a.subset_no, a.y, a.x, a.b3 AS f3, a.b34 AS f34, greatest(abs(b.y - a.y), abs(b.x - a.x)) AS ring, b.b3, b.b34, (b.candidate = 0 AND b.cloud_buffered = 0) AS good
  FROM pf a JOIN pf b ON a.candidate = 1 AND a.fn = b.fn AND a.subset_no = b.subset_no AND b.y BETWEEN a.y - 7 AND a.y + 7 AND b.x BETWEEN a.x - 7 AND a.x + 7 AND NOT (abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1)),
sz AS (SELECT fn, subset_no, y, x, r, count(*) AS possible, count(*) FILTER (WHERE good) AS actual FROM nb, range(2, 8) w(r) WHERE ring <= r GROUP BY ALL),
sel AS (SELECT fn, subset_no, y, x, min(r) AS r FROM sz WHERE actual / possible > 0.65 GROUP BY ALL),
mn AS (SELECT fn, subset_no, y, x, r, avg(b3) AS m3, avg(b34) AS m34 FROM nb JOIN sel USING (fn, subset_no, y, x) WHERE good AND ring <= r GROUP BY ALL),
md AS (SELECT nb.fn, nb.subset_no, nb.y, nb.x, any_value(f3) AS f3, any_value(f34) AS f34, any_value(m3) AS m3, any_value(m34) AS m34, avg(abs(b3 - m3)) AS d3, avg(abs(b34 - m34)) AS d34 FROM nb JOIN mn USING (fn, subset_no, y, x) WHERE good AND ring <= r GROUP BY ALL),
st AS (SELECT fn, subset_no, y, x, CASE WHEN f34 >= m34 + CASE WHEN d34 < 1 THEN 4 + d34 ELSE 4 * d34 END AND f3 >= m3 + CASE WHEN d3 < 1 THEN 4 + d3 ELSE 4 * d3 END THEN 'fire' ELSE 'not fire' END AS status FROM md),
al AS (SELECT pf.*, CASE WHEN candidate = 1 THEN coalesce(status, 'undetermined') END AS status FROM pf LEFT JOIN st USING (fn, subset_no, y, x))"""


_CONF = I.SCENE


def _detected(spark, d):
    return I.detect(_pixels(spark, d), _CONF, 2, 4)


@query(f"WITH {_CTX} SELECT fn, subset_no, y, x, status FROM al WHERE candidate = 1")
def i07_contextual_fires(spark, d):
    return _detected(spark, d).filter("candidate = 1").select("fn", "subset_no", "y", "x", "status")


@query(f"WITH {_CTX} SELECT fn, y, x, b3, b4, y * 0.5::DOUBLE AS line_time FROM al WHERE status = 'not fire' AND b34 > 10")
def i08_extract_fires(spark, d):
    """Confirmed pixels with their scanline's time; here of the class that the stand-in pixels do hold."""
    found = _detected(spark, d).filter("b34 > 10").withColumn("status", F.when(F.col("status") == "not fire", "fire"))
    scan = _pixels(spark, d).select("fn", "y", (F.col("y") * 0.5).alias("line_time")).distinct()
    return I.extract_fires(found, scan).select("fn", "y", "x", "b3", "b4", "line_time")


@query(f"""WITH {_CTX} SELECT fn, subset_no, count(*) AS total_pxl, count(b3) AS valid_pxl, CAST(sum(candidate) AS BIGINT) AS candidates, CAST(sum(cloud_buffered) AS BIGINT) AS clouds, CAST(sum(cloud) AS BIGINT) AS clouds_plain,
count(*) FILTER (WHERE status = 'fire') AS fires, count(*) FILTER (WHERE status = 'not fire') AS not_fires, count(*) FILTER (WHERE status = 'undetermined') AS undetermined FROM al GROUP BY ALL""")
def d33_segment_summary(spark, d):
    return I.segment_summary(_detected(spark, d))


@query(f"WITH {Q.SENSOR} SELECT event_id FROM sen WHERE event_id % 7 <> 0 AND event_id % 11 - 1 >= 0")
def i09_scanline_ok(spark, d):
    s = V.sensor(spark, d).select("event_id", (F.col("event_id") % 7 == 0).cast("int").alias("flag"), (F.col("event_id") % 11 - 1).cast("double").alias("reading"))
    return I.scanline_ok(s, ["flag"], ["reading"]).select("event_id")


@query(f"WITH {_BASE} SELECT fn, CASE WHEN fn % 2 = 0 THEN max(b3) END AS warm, CASE WHEN fn % 2 = 1 THEN 'ValueError: no thermal band' END AS error FROM p0 GROUP BY fn")
def a09_process_orbits(spark, d):
    """Each orbit worked on alone; the orbits that fail are logged with their error."""
    px = _pixels(spark, d).withColumn("b4", F.when(F.col("fn") % 2 == 0, F.col("b4")))

    def one(pdf):
        if pdf["b4"].isna().all():
            raise ValueError("no thermal band")
        return pdf.groupby("fn", as_index=False).agg(warm=("b3", "max"))

    good, failed = I.process_orbits(px.select("fn", "b3", "b4"), one, "fn long, warm double")
    return good.unionByName(failed, allowMissingColumns=True)


_LINES = f"""{Q.SENSOR}, e0 AS (SELECT event_id % 3 AS platform, event_id, epoch_us(ts) / 1e6 AS t, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS block FROM sen),
e1 AS (SELECT *, unnest(list_distinct([block, CAST(floor((t + 7200) / 86400) AS BIGINT)])) AS fn FROM e0),
sl AS (SELECT platform, fn, event_id AS y, t, event_id % 10 <> 0 OR fn > block AS ok, CAST(event_id AS DOUBLE) AS value FROM e1),
sf AS (SELECT *, lead(fn) OVER w AS next_fn, lead(s) OVER w AS next_start, lag(e) OVER w AS before FROM (SELECT platform, fn, min(t) AS s, max(t) AS e FROM sl GROUP BY ALL) WINDOW w AS (PARTITION BY platform ORDER BY s, fn)),
sk AS (SELECT sl.*, next_fn, next_start FROM sl JOIN sf USING (platform, fn) WHERE before IS NULL OR t > before),
sb AS (SELECT k.platform, k.fn, k.y, arg_min(g.value, [abs(k.t - g.t), g.t, g.value]) AS value2 FROM sk k JOIN sl g ON g.platform = k.platform AND g.fn = k.next_fn AND g.ok AND g.t BETWEEN k.t - 1 AND k.t + 1
  WHERE NOT k.ok AND k.t >= k.next_start AND abs(k.t - g.t) <= 0.5 GROUP BY ALL)"""


@query(f"""WITH {_LINES} SELECT k.platform, k.fn, k.y, k.t, k.ok OR b.y IS NOT NULL AS ok, CASE WHEN b.y IS NOT NULL THEN k.next_fn ELSE k.fn END AS used_fn, coalesce(b.value2, k.value) AS value
FROM sk k LEFT JOIN sb b ON b.platform = k.platform AND b.fn = k.fn AND b.y = k.y""")
def c13_stitch_orbits(spark, d):
    """Overlapping files of scanlines as one series of each platform."""
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = V.sensor(spark, d).select((F.col("event_id") % 3).alias("platform"), "event_id", sec.alias("t"))
    block = F.floor(F.col("t") / 86400)
    both = e.withColumn("fn", F.explode(F.array_distinct(F.array(block, F.floor((F.col("t") + 7200) / 86400)))))
    ok = (F.col("event_id") % 10 != 0) | (F.col("fn") > block)
    lines = both.select("platform", "fn", F.col("event_id").alias("y"), "t", ok.alias("ok"), F.col("event_id").cast("double").alias("value"))
    return I.stitch_orbits(lines)
