"""Pixels, stains, patches, morphology and superpixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera import fixtures as X
from tessera.fixtures import HEIGHT as H
from tessera.fixtures import IRR, LAB, PX
from tessera.fixtures import WIDTH as Wd
from tessera.operators import flood as L
from tessera.operators import nuclei as C
from tessera.operators import raster as P
from tessera.operators import regions as R
from tessera.operators import stain as S
from tessera.operators import superpixel as U
from tessera.operators import tissue as T
from tessera.plans.scratch import shuffled

from . import query
from .graph import Q6, R6

_GRAY = "(r * 4899 + g * 9617 + b * 1868 + 8192) >> 14"


@query(f"WITH {PX} SELECT image_id, y, x, {_GRAY} AS v FROM px")
def gray(spark, sf):
    return X.pixels(spark, sf).select(*P.AT, P.gray().alias("v"))


@query(f"WITH {PX} SELECT image_id, y, x, 255 - ((b * 4899 + g * 9617 + r * 1868 + 8192) >> 14) AS v FROM px")
def gray_bgr_inverted(spark, sf):
    return X.pixels(spark, sf).select(*P.AT, P.gray_bgr_inverted().alias("v"))


def _resample_sql(h, w):
    return f"WITH {PX}, t AS (SELECT image_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx FROM (SELECT DISTINCT image_id FROM px) JOIN (SELECT unnest(range({h})) AS ty) ON TRUE JOIN (SELECT unnest(range({w})) AS tx) ON TRUE) SELECT t.image_id, ty AS y, tx AS x, r FROM t JOIN px ON px.image_id = t.image_id AND px.y = ty * {H} // {h} AND px.x = tx * {Wd} // {w}"


@query(_resample_sql(13, 53))
def downsample_nearest(spark, sf):
    return P.resample(X.pixels(spark, sf), H, Wd, H // 3, Wd // 3).select(*P.AT, "r")


@query(_resample_sql(100, 300))
def upsample_nearest(spark, sf):
    return P.resample(X.pixels(spark, sf), H, Wd, 100, 300).select(*P.AT, "r")


@query(f"WITH {PX}, p AS (SELECT image_id, quantile_cont(v, 0.9) AS p90 FROM (SELECT image_id, unnest([r, g, b]) AS v FROM px) GROUP BY 1) SELECT image_id, y, x, {', '.join(f'CAST(floor(greatest(0, least(255, {c} * 255.0 / p90))) AS INT) AS {c}' for c in 'rgb')} FROM px JOIN p USING (image_id)")
def brightness_standardize(spark, sf):
    return P.standardize_brightness(X.pixels(spark, sf))


_OD = "od AS (SELECT image_id, y, x, " + ", ".join(f"-ln(greatest({c}, 1) / 255.0) AS od_{c}" for c in "rgb") + " FROM px)"


@query(f"WITH {PX}, {_OD} SELECT image_id, y, x, {Q6('od_r', 'od_g', 'od_b')} FROM od")
def optical_density(spark, sf):
    return S.densities(X.pixels(spark, sf)).select(*P.AT, *R6("od_r", "od_g", "od_b"))


@query(f"WITH {PX}, {_OD} SELECT image_id, y, x FROM od WHERE greatest(od_r, od_g, od_b) > 0.7")
def od_filter(spark, sf):
    return S.dense_only(S.densities(X.pixels(spark, sf)), 0.7).select(*P.AT)


@query(f"WITH {PX}, {_OD} SELECT image_id, {', '.join(f'round(covar_samp(od_{a}, od_{b}), 6) AS {a}{b}' for a, b in ('rr', 'rg', 'rb', 'gg', 'gb', 'bb'))} FROM od WHERE greatest(od_r, od_g, od_b) > 0.15 GROUP BY 1")
def od_covariance(spark, sf):
    return S.od_covariance(S.dense_only(S.densities(X.pixels(spark, sf)))).select("image_id", *R6("rr", "rg", "rb", "gg", "gb", "bb"))


def _dot(a, b):
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


_V = ["od_r", "od_g", "od_b"]
_S0, _S1 = [[f"{x}::DOUBLE" for x in row] for row in S.DEFAULT_STAINS]
_DET = f"({_dot(_S0, _S0)} * {_dot(_S1, _S1)} - {_dot(_S0, _S1)} * {_dot(_S0, _S1)})"
_CON = f"con AS (SELECT image_id, y, x, greatest(({_dot(_S1, _S1)} * {_dot(_S0, _V)} - {_dot(_S0, _S1)} * {_dot(_S1, _V)}) / {_DET}, 0) AS c1, greatest(({_dot(_S0, _S0)} * {_dot(_S1, _V)} - {_dot(_S0, _S1)} * {_dot(_S0, _V)}) / {_DET}, 0) AS c2 FROM od)"


def _con(spark, sf):
    return S.concentrations(S.densities(X.pixels(spark, sf)), S.DEFAULT_STAINS)


@query(f"WITH {PX}, {_OD}, {_CON} SELECT image_id, y, x, {Q6('c1', 'c2')} FROM con")
def stain_concentration(spark, sf):
    return _con(spark, sf).select(*P.AT, *R6("c1", "c2"))


_MIX = lambda j: f"CAST(floor(least(255, 255 * exp(-(c1 * 1.9705 / m1 * {S.DEFAULT_STAINS[0][j]} + c2 * 1.0308 / m2 * {S.DEFAULT_STAINS[1][j]})))) AS INT)"


@query(f"WITH {PX}, {_OD}, {_CON}, m AS (SELECT image_id, quantile_cont(c1, 0.99) AS m1, quantile_cont(c2, 0.99) AS m2 FROM con GROUP BY 1) SELECT image_id, y, x, {', '.join(f'{_MIX(j)} AS {n}' for j, n in enumerate('rgb'))} FROM con JOIN m USING (image_id)")
def macenko_normalize(spark, sf):
    return S.render(_con(spark, sf))


@query()
def macenko_fit(spark, sf):
    return S.fit(X.pixels(spark, sf))


@query()
def macenko_image(spark, sf):
    return S.macenko(X.pixels(spark, sf))


@query()
def vahadane_image(spark, sf):
    return S.vahadane(X.pixels(spark, sf))


_LIN = lambda c: f"CASE WHEN {c} / 255.0 > 0.04045 THEN pow(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END"


@query(f"WITH {PX}, l AS (SELECT image_id, y, x, 0.212671::DOUBLE * ({_LIN('r')}) + 0.715160::DOUBLE * ({_LIN('g')}) + 0.072169::DOUBLE * ({_LIN('b')}) AS yy FROM px) SELECT image_id, y, x FROM l WHERE (116 * CASE WHEN yy > 0.008856 THEN pow(yy, 1.0::DOUBLE / 3) ELSE 7.787 * yy + 16.0::DOUBLE / 116 END - 16) / 100 < 0.5")
def not_white_mask(spark, sf):
    return X.pixels(spark, sf).filter(P.lightness() / 100 < 0.5).select(*P.AT)


_LOGS = [f"ln(greatest({c} / 255.0::DOUBLE, 1e-6)) / ln(1e-6)" for c in "rgb"]


@query(f"WITH {PX} SELECT image_id, y, x, {', '.join(f'round(greatest(0, {_dot(_LOGS, [f'({P.HED[i][j]}::DOUBLE)' for i in range(3)])}), 6) AS {n}' for j, n in enumerate('hed'))} FROM px")
def rgb_to_hed(spark, sf):
    return X.pixels(spark, sf).select(*P.AT, *P.hed()).select(*P.AT, *R6("h", "e", "d"))


@query(f"WITH {PX}, m AS (SELECT image_id, min(r) AS lo, max(r) AS hi FROM px GROUP BY 1) SELECT image_id, y, x, round(coalesce((r - lo) / nullif(hi - lo, 0), 0), 6) AS r FROM px JOIN m USING (image_id)")
def min_max_normalize(spark, sf):
    return P.min_max(X.pixels(spark, sf), "r").select(*P.AT, *R6("r"))


@query(f"WITH {PX} SELECT image_id, y, x, round((r / 255 - 0.485) / 0.229, 6) AS r, round((g / 255 - 0.456) / 0.224, 6) AS g, round((b / 255 - 0.406) / 0.225, 6) AS b FROM px")
def channel_normalize(spark, sf):
    return P.normalize_channels(X.pixels(spark, sf)).select(*P.AT, *R6("r", "g", "b"))


@query(f"WITH {PX} SELECT image_id, y, x, CASE WHEN g >= 128 THEN r ELSE 255 END AS r FROM px")
def apply_mask(spark, sf):
    return P.masked(X.pixels(spark, sf), F.col("g") >= 128, 255, ("r",))


_CH = "ch AS (SELECT image_id, unnest(['r', 'g', 'b']) AS channel, unnest([r, g, b]) AS v FROM px), cm AS (SELECT image_id, channel, avg(v) AS m, stddev_pop(v) AS s FROM ch GROUP BY ALL)"


@query(f"WITH {PX}, {_CH} SELECT image_id, channel, count(*) AS pixels, round(avg(v), 6) AS mean, round(any_value(s), 6) AS std, quantile_cont(v, 0.5) AS median, round(avg((v - m) ** 3) / nullif(any_value(s), 0) ** 3, 6) AS skew, round(avg(v::DOUBLE * v), 6) AS energy, {', '.join(f'round(count(*) FILTER (v // 32 = {k}) / count(*), 6) AS h{k}' for k in range(8))} FROM ch JOIN cm USING (image_id, channel) GROUP BY ALL")
def color_stats(spark, sf):
    return P.channel_stats(X.pixels(spark, sf)).select("image_id", "channel", "pixels", "median", *R6("mean", "std", "skew", "energy", *[f"h{k}" for k in range(8)]))


_PAD = "CASE WHEN p_size < 7 THEN 7 - p_size WHEN ((p_size - 7) % 4 + 4) % 4 = 0 THEN 0 ELSE 4 - ((p_size - 7) % 4 + 4) % 4 END"


@query(f"SELECT p_partkey, CAST(ceil({_PAD} / 2) AS BIGINT) AS before, CAST(floor({_PAD} / 2) AS BIGINT) AS after FROM part")
def pad_sizes(spark, sf):
    before, after = P.pad_sizes(F.col("p_size"), 7, 4)
    return X.table(spark, sf, "part").select("p_partkey", before.alias("before"), after.alias("after"))


@query(f"WITH {PX}, t AS (SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT DISTINCT image_id FROM px) JOIN (SELECT unnest(range({H + 10})) AS y) ON TRUE JOIN (SELECT unnest(range({Wd + 10})) AS x) ON TRUE) SELECT t.image_id, t.y, t.x, coalesce(r, 255) AS r FROM t LEFT JOIN px ON px.image_id = t.image_id AND px.y = t.y - 5 AND px.x = t.x - 5")
def constant_pad(spark, sf):
    return P.constant_pad(X.pixels(spark, sf), 5, 255, H, Wd, "r")


@query(f"WITH {PX}, t AS (SELECT CAST(unnest(range({Wd + 40})) AS INT) AS tx) SELECT image_id, y, tx AS x, r FROM t JOIN px ON px.x = least(((tx - 20) % 318 + 318) % 318, 318 - ((tx - 20) % 318 + 318) % 318)")
def reflect_pad(spark, sf):
    px = X.pixels(spark, sf)
    at = spark.range(Wd + 40).select(F.col("id").cast("int").alias("tx"), P.reflect_index(F.col("id").cast("int") - 20, Wd).alias("x"))
    return px.join(F.broadcast(at), "x").select("image_id", "y", F.col("tx").alias("x"), "r")


@query(f"WITH {PX} SELECT image_id, row, col, count(*) AS n, sum(r) AS total FROM px JOIN (SELECT unnest(range(4)) AS row) ON y BETWEEN row * 8 AND row * 8 + 15 JOIN (SELECT unnest(range(19)) AS col) ON x BETWEEN col * 8 AND col * 8 + 15 GROUP BY 1, 2, 3")
def grid_patches(spark, sf):
    return P.grid_patches(X.pixels(spark, sf), 16, 8, H, Wd).groupBy("image_id", "row", "col").agg(F.count("*").alias("n"), F.sum("r").alias("total"))


@query("SELECT s_suppkey, wy AS top, wx AS left_, wy + 164 AS bottom, wx + 164 AS right_ FROM supplier JOIN (SELECT unnest(range(0, 7)) * 164 AS wy) ON wy < ceil((300 + s_suppkey % 300) / 164) * 164 JOIN (SELECT unnest(range(0, 7)) * 164 AS wx) ON wx < ceil((400 + s_suppkey % 500) / 164) * 164")
def tile_windows(spark, sf):
    s = X.table(spark, sf, "supplier").withColumns({"h": 300 + F.col("s_suppkey") % 300, "w": 400 + F.col("s_suppkey") % 500})
    return P.windows(s, "h", "w").select("s_suppkey", "top", "left_", "bottom", "right_")


_INST = """pr AS (SELECT image_id, label, CAST(round_even(avg(x), 0) AS BIGINT) AS cx, CAST(round_even(avg(y), 0) AS BIGINT) AS cy, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM irr GROUP BY 1, 2),
 ce AS (SELECT image_id, label, px, py FROM (SELECT *, unnest(range(cx - (cx - x0) // 4 * 4, x1 + 1, 4)) AS px FROM pr) JOIN (SELECT image_id, label, unnest(range(cy - (cy - y0) // 4 * 4, y1 + 1, 4)) AS py FROM pr) USING (image_id, label)),
 ip AS (SELECT image_id, label, px, py, count(*) AS overlap FROM ce JOIN irr USING (image_id, label) WHERE x >= px - 4 AND x < px + 4 AND y >= py - 4 AND y < py + 4 GROUP BY 1, 2, 3, 4 HAVING count(*) > 16)"""


def _inst(spark, sf):
    lab = X.labels(X.pixels(spark, sf), dense=False)
    return P.instance_patches(R.region_props(lab), lab, 8, 4)


@query(f"WITH {PX}, {LAB}, {IRR}, {_INST} SELECT * FROM ip")
def instance_patches(spark, sf):
    return _inst(spark, sf)


@query(f"WITH {PX}, {LAB}, {IRR}, {_INST} SELECT image_id, round(avg(overlap / 64), 6) AS coverage, avg(overlap / 64) < 0.75 AS warns FROM ip GROUP BY 1")
def patch_overlap_filter(spark, sf):
    c = F.avg(F.col("overlap") / 64)
    return _inst(spark, sf).groupBy("image_id").agg(F.round(c, 6).alias("coverage"), (c < 0.75).alias("warns"))


@query(f"WITH {PX} SELECT image_id, y // 8 AS row, x // 8 AS col, round(avg(CAST(r >= 200 AS INT)), 6) AS fraction, avg(CAST(r >= 200 AS INT)) >= 0.1 AS is_valid FROM px GROUP BY 1, 2, 3")
def tissue_fraction(spark, sf):
    return P.tissue_fraction(P.grid_patches(X.pixels(spark, sf), 8, 8, H, Wd), F.col("r") >= 200).select("image_id", "row", "col", *R6("fraction"), "is_valid")


@query(f"WITH {PX}, {LAB}, {IRR}, {_INST}, e AS (SELECT image_id, label, px, py, avg(r) AS m, avg(g) AS k FROM ip JOIN px USING (image_id) WHERE px.x >= ip.px - 4 AND px.x < ip.px + 4 AND px.y >= ip.py - 4 AND px.y < ip.py + 4 GROUP BY 1, 2, 3, 4) SELECT image_id, label, round(avg(m), 9) AS f0, round(avg(k), 9) AS f1 FROM e GROUP BY 1, 2")
def patch_mean_embedding(spark, sf):
    # A patch's embedding is the mean of two channels here; any vector function of a patch takes its place.
    at = _inst(spark, sf).select("image_id", "label", "px", "py", F.explode(F.sequence(F.col("px") - 4, F.col("px") + 3)).alias("x")).withColumn("y", F.explode(F.sequence(F.col("py") - 4, F.col("py") + 3)))
    e = at.join(shuffled(X.pixels(spark, sf)), P.AT).groupBy("image_id", "label", "px", "py").agg(F.avg("r").alias("m"), F.avg("g").alias("k"))
    return e.groupBy("image_id", "label").agg(F.round(F.avg("m"), 9).alias("f0"), F.round(F.avg("k"), 9).alias("f1"))


@query(f"WITH t AS (SELECT vec_id AS image_id, p // 8 AS y, p % 8 AS x, embedding[p + 1] AS v FROM (SELECT *, unnest(range(64)) AS p FROM embeddings)), m AS (SELECT image_id, v, unnest([{', '.join(f'[{k}, {a}, {b}]' for k, (a, b) in enumerate([('y', 'x'), ('y', '7 - x'), ('7 - x', 'y'), ('7 - x', '7 - y'), ('7 - y', '7 - x'), ('7 - y', 'x'), ('x', '7 - y'), ('x', 'y')]))}]) AS t FROM t) SELECT image_id, CAST(t[1] AS INT) AS aug, CAST(t[2] AS INT) AS y, CAST(t[3] AS INT) AS x, v FROM m")
def augment_rot_flip(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "v"))
    return P.augment(e.select("image_id", F.floor(F.col("p") / 8).alias("y"), (F.col("p") % 8).alias("x"), "v"), 8)


_K = P.kernel(1.0)
_R = len(_K) // 2


@query(f"WITH {PX}, k AS (SELECT unnest(range({-_R}, {_R + 1})) AS o, unnest([{', '.join(f'{w!r}::DOUBLE' for w in _K)}]) AS w), t AS (SELECT image_id, y, x, r::DOUBLE AS v FROM px), a AS (SELECT c.image_id, c.y, c.x, sum(w * n.v) AS v FROM t c JOIN k ON TRUE JOIN t n ON n.image_id = c.image_id AND n.x = c.x AND n.y = greatest(0, least({H - 1}, c.y + o)) GROUP BY 1, 2, 3), b AS (SELECT c.image_id, c.y, c.x, sum(w * n.v) AS v FROM a c JOIN k ON TRUE JOIN a n ON n.image_id = c.image_id AND n.y = c.y AND n.x = greatest(0, least({Wd - 1}, c.x + o)) GROUP BY 1, 2, 3) SELECT image_id, y, x, round(v, 5) AS v FROM b")
def gaussian_blur(spark, sf):
    out = P.gaussian_blur(X.pixels(spark, sf).select(*P.AT, F.col("r").cast("double").alias("v")), 1.0, H, Wd)
    return out.select("image_id", F.col("y").cast("int"), F.col("x").cast("int"), F.round("v", 5).alias("v"))


_SOB = {"gx": [(-1, -1, -1), (0, -1, -2), (1, -1, -1), (-1, 1, 1), (0, 1, 2), (1, 1, 1)], "gy": [(-1, -1, -1), (-1, 0, -2), (-1, 1, -1), (1, -1, 1), (1, 0, 2), (1, 1, 1)]}


@query(f"WITH {PX}, n AS (SELECT image_id, y + dy AS y, x + dx AS x, dy, dx, r FROM px JOIN (SELECT unnest([-1, 0, 1]) AS dy) ON TRUE JOIN (SELECT unnest([-1, 0, 1]) AS dx) ON TRUE WHERE dy <> 0 OR dx <> 0) SELECT image_id, y, x, CAST(sum(-dx * (2 - abs(dy)) * r) AS BIGINT) AS gx, CAST(sum(-dy * (2 - abs(dx)) * r) AS BIGINT) AS gy FROM n WHERE y BETWEEN 1 AND {H - 2} AND x BETWEEN 1 AND {Wd - 2} GROUP BY 1, 2, 3")
def sobel(spark, sf):
    return P.sobel(X.pixels(spark, sf).select(*P.AT, F.col("r").alias("v")), H, Wd)


@query(f"WITH {PX}, s AS (SELECT greatest((ty + 0.5::DOUBLE) * {H} / 60 - 0.5, 0) AS sy, CAST(ty AS INT) AS ty FROM (SELECT unnest(range(60)) AS ty)), q AS (SELECT greatest((tx + 0.5::DOUBLE) * {Wd} / 100 - 0.5, 0) AS sx, CAST(tx AS INT) AS tx FROM (SELECT unnest(range(100)) AS tx)), c AS (SELECT ty, tx, least(floor(sy) + dy, {H - 1}) AS y, least(floor(sx) + dx, {Wd - 1}) AS x, CASE WHEN dy = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END * CASE WHEN dx = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END AS w FROM s JOIN q ON TRUE JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx) ON TRUE) SELECT image_id, ty AS y, tx AS x, round(sum(w * r), 6) AS v FROM c JOIN px USING (y, x) GROUP BY 1, 2, 3")
def resize_bilinear(spark, sf):
    return P.bilinear(X.pixels(spark, sf).select(*P.AT, F.col("r").alias("v")), H, Wd, 60, 100).select(*P.AT, *R6("v"))


@query(f"WITH {PX}, v AS (SELECT image_id, r AS t, count(*) AS n FROM px WHERE r > 0 GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER o AS n1, sum(n * t) OVER o AS s1, sum(n) OVER (PARTITION BY image_id) AS nn, sum(n * t) OVER (PARTITION BY image_id) AS ss FROM v WINDOW o AS (PARTITION BY image_id ORDER BY t)) SELECT image_id, coalesce(arg_max(t, round(n1 * (nn - n1) * (s1 / n1 - (ss - s1) / (nn - n1)) ** 2, 6)) FILTER (n1 < nn), 0) AS threshold FROM w GROUP BY 1")
def otsu_threshold(spark, sf):
    return P.otsu(X.pixels(spark, sf).select(*P.AT, F.col("r").alias("v")))


_BR = "br AS (SELECT image_id, y, x FROM px WHERE r >= 200)"
_DIL = f"di AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM br JOIN (SELECT unnest(range(-2, 3)) AS dy) ON TRUE JOIN (SELECT unnest(range(-2, 3)) AS dx) ON TRUE WHERE y + dy BETWEEN 0 AND {H - 1} AND x + dx BETWEEN 0 AND {Wd - 1})"


def _bright(spark, sf):
    return X.pixels(spark, sf).filter("r >= 200").select(*P.AT)


@query(f"WITH {PX}, {_BR}, {_DIL} SELECT image_id, y, x FROM di")
def dilate(spark, sf):
    return P.dilate(_bright(spark, sf), 5, H, Wd)


@query(f"WITH {PX}, {_BR}, {_DIL} SELECT image_id, c.y, c.x FROM (SELECT image_id, y, x FROM px) c WHERE NOT EXISTS (SELECT 1 FROM px o WHERE o.image_id = c.image_id AND abs(o.y - c.y) <= 2 AND abs(o.x - c.x) <= 2 AND (o.image_id, o.y, o.x) NOT IN (SELECT image_id, y, x FROM di))")
def closing(spark, sf):
    return P.erode(P.dilate(_bright(spark, sf), 5, H, Wd), 5, H, Wd, X.pixels(spark, sf))


@query(f"WITH {PX}, {LAB}, l0 AS (SELECT image_id, y, x, CASE WHEN r >= 128 THEN label ELSE 0 END AS label FROM lab) SELECT DISTINCT a.image_id, a.y, a.x, a.label FROM l0 a JOIN l0 b ON a.image_id = b.image_id AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1)) WHERE a.label <> b.label")
def boundary_pixels(spark, sf):
    lab = X.labels(X.pixels(spark, sf))
    return P.boundaries(lab.select(*P.AT, F.when(F.col("r") >= 128, F.col("label")).otherwise(0).alias("label")))


_CC = f"""WITH RECURSIVE {PX}, {_BR}, m AS (SELECT image_id, y * {Wd} + x AS id, y, x FROM br),
 e AS (SELECT a.image_id, a.id AS a, b.id AS b FROM m a JOIN m b ON a.image_id = b.image_id AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1))),
 r(image_id, id, c) AS (SELECT image_id, id, id FROM m UNION SELECT r.image_id, e.b, r.c FROM r JOIN e ON e.image_id = r.image_id AND e.a = r.id AND r.c < e.b),
 cc AS (SELECT image_id, id, min(c) AS component FROM r GROUP BY 1, 2)"""


@query(f"{_CC} SELECT image_id, CAST(id // {Wd} AS INT) AS y, CAST(id % {Wd} AS INT) AS x, component FROM cc")
def connected_components(spark, sf):
    return T.pixel_components(_bright(spark, sf), Wd).select("image_id", "y", "x", "component")


@query(f"{_CC.replace('r >= 200', 'r >= 150')}, s AS (SELECT image_id, component FROM cc GROUP BY 1, 2 HAVING count(*) >= 3) SELECT image_id, CAST(id // {Wd} AS INT) AS y, CAST(id % {Wd} AS INT) AS x, component FROM cc JOIN s USING (image_id, component)")
def remove_small_objects(spark, sf):
    return T.remove_small(X.pixels(spark, sf).filter("r >= 150").select(*P.AT), Wd, 3)


@query()
def tissue_mask(spark, sf):
    return T.gaussian_tissue_mask(X.pixels(spark, sf), H, Wd, sigma=1.0, min_size=10, kernel=5)


@query()
def hole_fill(spark, sf):
    return T.fill_holes(_bright(spark, sf), H, Wd)


@query()
def watershed(spark, sf):
    lab = X.labels(X.pixels(spark, sf), dense=False)
    return T.watershed(X.pixels(spark, sf).select(*P.AT, (-F.col("r")).alias("v")), lab.filter("r >= 220").select(*P.AT, "label"), H, Wd)


@query()
def watershed_tiles(spark, sf):
    """The same flood in tiles of 16 x 16 pixels."""
    lab = X.labels(X.pixels(spark, sf), dense=False)
    return L.watershed_tiles(X.pixels(spark, sf).select(*P.AT, (-F.col("r")).alias("v")), lab.filter("r >= 220").select(*P.AT, "label"), tile=16)


# Superpixels.


def _lab(spark, sf):
    return X.labels(X.pixels(spark, sf)).select(*P.AT, "label", "r", "g", "b")


_ST = "st AS (SELECT image_id, label, count(*) AS n, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb, " + ", ".join(f"count(*) FILTER ({c} // 64 = {k}) AS h{c}{k}" for c in "rgb" for k in range(4)) + ", sqrt((sum(r) / count(*)) ** 2 + (sum(g) / count(*)) ** 2 + (sum(b) / count(*)) ** 2) AS norm FROM lab GROUP BY 1, 2)"


@query(f"WITH {PX}, {LAB}, {_ST} SELECT image_id, label, n, CAST(sr AS BIGINT) AS sr, CAST(sg AS BIGINT) AS sg, CAST(sb AS BIGINT) AS sb, {', '.join(f'h{c}{k}' for c in 'rgb' for k in range(4))}, round(norm, 6) AS norm FROM st")
def superpixel_color_stats(spark, sf):
    return U.color_stats(_lab(spark, sf)).select("image_id", "label", "n", "sr", "sg", "sb", *[f"h{c}{k}" for c in "rgb" for k in range(4)], *R6("norm"))


_HL = lambda s, c: f"sqrt({' + '.join(f'{s}.h{c}{k} * {s}.h{c}{k}' for k in range(4))})"
_HV = lambda s, c, k: f"{s}.hr{k} / {_HL(s, 'r')}" + (f" / {_HL(s, c)}" if c != "r" else "")
_HD = "(" + " + ".join(f"sqrt({' + '.join(f'({_HV('a', c, k)} - {_HV('b', c, k)}) ** 2' for k in range(4))}) / 2" for c in "rgb") + ") / 3"
_CD = f"sqrt({' + '.join(f'(a.s{c} / a.n / a.norm - b.s{c} / b.n / b.norm) ** 2' for c in 'rgb')}) / 2"


@query(f"WITH {PX}, {LAB}, {_ST}, e AS (SELECT DISTINCT p.image_id, least(p.label, q.label) AS src, greatest(p.label, q.label) AS dst FROM (SELECT image_id, label, y + dy AS y, x + dx AS x FROM lab JOIN (VALUES (0, 1), (1, -1), (1, 0), (1, 1)) o(dy, dx) ON TRUE) p JOIN lab q USING (image_id, y, x) WHERE p.label <> q.label) SELECT e.image_id, src, dst, round(0.5 * ({_HD}) + 0.5 * ({_CD}), 6) AS w FROM e JOIN st a ON a.image_id = e.image_id AND a.label = src JOIN st b ON b.image_id = e.image_id AND b.label = dst")
def superpixel_rag_weights(spark, sf):
    return U.rag_weights(_lab(spark, sf)).select("image_id", "src", "dst", *R6("w"))


@query(f"WITH {PX}, {LAB}, s AS (SELECT image_id, label, avg(CAST(g >= 170 AS INT)) AS sh FROM lab GROUP BY 1, 2) SELECT image_id, label, CAST(row_number() OVER (PARTITION BY image_id ORDER BY label) AS INT) AS new_label FROM s WHERE sh >= 0.1")
def superpixel_tissue_filter(spark, sf):
    return U.tissue_filter(_lab(spark, sf), F.col("g") >= 170)


@query("SELECT p_partkey, CAST(least(floor(p_size * 1000 / 150), 200) AS BIGINT) AS n FROM part")
def superpixel_number(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", U.count_for(F.col("p_size"), F.lit(1000), 150, 200).alias("n"))


@query()
def slic_superpixels(spark, sf):
    return U.slic(X.pixels(spark, sf), H, Wd, 10)


_LIN = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN (({c} / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 ELSE {c} / 255.0::DOUBLE / 12.92 END"
_XYZ = ", ".join(f"({' + '.join(f'{w} * {c}l' for w, c in zip(row, 'rgb'))}) / {white} AS {n}" for n, row, white in zip("uvw", P.XYZ, P.WHITE))
_ROOT = ", ".join(f"CASE WHEN {n} > 0.008856 THEN {n} ** (1.0::DOUBLE / 3) ELSE 7.787 * {n} + 16.0::DOUBLE / 116 END AS {n}" for n in "uvw")


@query(f"WITH {PX}, a AS (SELECT image_id, y, x, {', '.join(f'{_LIN(c)} AS {c}l' for c in 'rgb')} FROM px), b AS (SELECT image_id, y, x, {_XYZ} FROM a), c AS (SELECT image_id, y, x, {_ROOT} FROM b) SELECT image_id, y, x, round(116 * v - 16, 6) AS l, round(500 * (u - v), 6) AS a, round(200 * (v - w), 6) AS b FROM c")
def rgb_to_lab(spark, sf):
    return X.pixels(spark, sf).select(*P.AT, *[F.round(c, 6).alias(n) for c, n in zip(P.cie_lab(), ("l", "a", "b"))])


@query()
def merged_superpixels(spark, sf):
    """The whole chain: superpixels of half the image's pixels, those with tissue, merged, both label maps."""
    px = X.pixels(spark, sf)
    return U.superpixels(px, H, Wd, size=60, tissue=px.filter("g >= 120").select(*P.AT), factor=2, thresh=0.12)


@query()
def merge_superpixels(spark, sf):
    return U.merge(_lab(spark, sf), thresh=0.12)


def _disks(spark, sf):
    """Maps of two touching disks a cell of 40 pixels, which the mosaic's red disturbs a little."""
    px = X.pixels(spark, sf).withColumn("cx", F.floor(F.col("x") / 20) * 20 + 10).withColumn("dx", (F.col("x") - F.col("cx")) / 10.0).withColumn("dy", (F.col("y") % 20 - 10) / 10.0)
    inside = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= 1
    return px.select(*P.AT, F.when(inside, 0.6 + F.col("r") / 1000).otherwise(0.1).alias("p"), F.when(inside, F.col("dx")).otherwise(0.0).alias("h"), F.when(inside, F.col("dy")).otherwise(0.0).alias("v"))


@query()
def nucleus_instances(spark, sf):
    return C.instances(_disks(spark, sf), H, Wd)


def decoded(windows):
    """The maps that the three channels of a window's inner square hold, in place of a network's."""
    inner = windows[:, 46:210, 46:210]
    return np.stack([inner[..., 0], 2 * inner[..., 1] - 1, 2 * inner[..., 2] - 1], -1)


@query()
def nuclei_extraction(spark, sf):
    """Size and place of the instances of images that hold the maps of `nucleus_instances` as colours."""
    maps = _disks(spark, sf)
    code = lambda c, lo, by: F.greatest(F.lit(0), F.least(F.lit(255), F.round((F.col(c) - lo) / by * 255))).cast("int")
    px = maps.select(*P.AT, code("p", 0, 1).alias("r"), code("h", -1, 2).alias("g"), code("v", -1, 2).alias("b"))
    found, places = C.extract(px, decoded, H, Wd, tile=64)
    return found.groupBy("image_id", "label").agg(F.count("*").alias("area")).join(shuffled(places), ["image_id", "label"])


_SOB21 = """k AS (SELECT k, s, coalesce(lag(c) OVER (ORDER BY k), 0) - CASE WHEN k = 20 THEN 0 ELSE c END AS d FROM (SELECT k, factorial(20)::DOUBLE / factorial(k::INT) / factorial(20 - k::INT) AS s, CASE WHEN k < 20 THEN factorial(19)::DOUBLE / factorial(k::INT) / factorial(19 - k::INT) END AS c FROM range(21) t(k)))"""


@query(f"WITH {PX}, {_SOB21}, a AS (SELECT image_id, t.y, px.x, sum(s * r) AS v FROM (SELECT y::INT AS y, k, CASE WHEN abs(y + k - 10) >= {H} THEN {2 * (H - 1)} - abs(y + k - 10) ELSE abs(y + k - 10) END AS sy, s FROM range({H}) t(y), k) t JOIN px ON px.y = sy GROUP BY 1, 2, 3), b AS (SELECT image_id, a.y, t.x, sum(d * v) AS v FROM (SELECT x::INT AS x, CASE WHEN abs(x + k - 10) >= {Wd} THEN {2 * (Wd - 1)} - abs(x + k - 10) ELSE abs(x + k - 10) END AS sx, d FROM range({Wd}) t(x), k) t JOIN a ON a.x = sx GROUP BY 1, 2, 3) SELECT image_id, y, x, round(v / 1e9, 3) AS gx FROM b")
def sobel_21(spark, sf):
    px = X.pixels(spark, sf).select(*P.AT, F.col("r").cast("double").alias("v"))
    return C.sobel(px, H, Wd, gaps=True)[0].select(*P.AT, F.round(F.col("v") / 1e9, 3).alias("gx"))
