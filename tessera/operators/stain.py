"""Stain separation and normalisation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.scratch import cut

from .raster import AT, lightness, optical_density

#: The stain profile used where no target was fitted, and its largest concentrations.
DEFAULT_STAINS = ((0.5626, 0.7201, 0.4062), (0.2159, 0.8012, 0.5581))
DEFAULT_MAX = (1.9705, 1.0308)
BETA, ALPHA = 0.15, 1.0


def densities(px: DataFrame) -> DataFrame:
    return px.select(*AT, *[optical_density(c).alias(f"od_{c}") for c in "rgb"])


def dense_only(od: DataFrame, beta: float = BETA) -> DataFrame:
    return od.filter(F.greatest("od_r", "od_g", "od_b") > beta)


def od_covariance(od: DataFrame) -> DataFrame:
    """The six entries of each image's sample covariance."""
    pairs = [(a, b) for i, a in enumerate("rgb") for b in "rgb"[i:]]
    return od.groupBy("image_id").agg(*[F.covar_samp(f"od_{a}", f"od_{b}").alias(f"{a}{b}") for a, b in pairs])


def concentrations(od: DataFrame, stains=None) -> DataFrame:
    """Least-squares amounts of two stains, negative ones 0. stains: a 2 x 3 profile, or None for columns s00..s12 of od."""
    s = [[F.lit(x) for x in row] for row in stains] if stains else [[F.col(f"s{i}{j}") for j in range(3)] for i in range(2)]
    v = [F.col(f"od_{c}") for c in "rgb"]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    aa, ab, bb, av, bv = dot(s[0], s[0]), dot(s[0], s[1]), dot(s[1], s[1]), dot(s[0], v), dot(s[1], v)
    det = aa * bb - ab * ab
    own = [c for c in od.columns if c not in ("c1", "c2")]
    return od.select(*own, F.greatest((bb * av - ab * bv) / det, F.lit(0.0)).alias("c1"), F.greatest((aa * bv - ab * av) / det, F.lit(0.0)).alias("c2"))


def quantiles(values: DataFrame, column: str, ps: dict[str, float], key: str = "image_id", bins: int = 4096) -> DataFrame:
    """key and one column a name of ps: exact percentiles by linear interpolation.

    Two passes: equal bins tell in which of them the wanted ranks lie, and only the distinct values of these bins are counted and ordered. So no task holds the values of an image.
    """
    some = cut(values.filter(F.col(column).isNotNull()).select(key, F.col(column).alias("v")), "values")
    ends = some.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).alias("bin")
    binned = some.join(ends, key).select(key, "v", at)
    upto = W.partitionBy(key).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    counts = binned.groupBy(key, "bin").agg(F.count("*").alias("c")).withColumn("end", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(W.partitionBy(key)))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f((F.col("n") - 1) * p).cast("long").alias("rank"), ((F.col("n") - 1) * p).alias("place")) for name, p in ps.items() for f in (F.floor, F.ceil)]))
    wanted = counts.select(key, "bin", "c", "end", ranks.alias("r")).filter((F.col("r.rank") < F.col("end")) & (F.col("r.rank") >= F.col("end") - F.col("c"))).select(key, "bin", (F.col("end") - F.col("c")).alias("before"), "r.*")
    inside = binned.join(wanted.select(key, "bin").distinct(), [key, "bin"]).groupBy(key, "bin", "v").agg(F.count("*").alias("c"))
    inside = inside.withColumn("end", F.sum("c").over(W.partitionBy(key, "bin").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    met = wanted.join(inside, [key, "bin"]).filter((F.col("rank") - F.col("before") < F.col("end")) & (F.col("rank") - F.col("before") >= F.col("end") - F.col("c")))
    # The two neighbours of a place, or one twice.
    low, high = F.min("v"), F.max("v")
    one = met.groupBy(key, "name").agg((low + (high - low) * (F.first("place") - F.floor(F.first("place")))).alias("q"))
    return one.groupBy(key).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in ps])


def _largest(conc: DataFrame) -> DataFrame:
    return quantiles(conc, "c1", {"m1": 0.99}).join(quantiles(conc, "c2", {"m2": 0.99}), "image_id")


def render(conc: DataFrame, target=DEFAULT_STAINS, scale=DEFAULT_MAX) -> DataFrame:
    """Pixels of the target stains; scale None leaves concentrations as they are."""
    c = [F.col("c1"), F.col("c2")]
    if scale:
        conc = conc.join(_largest(conc), "image_id")
        c = [F.coalesce(F.try_divide(F.col(f"c{k}") * scale[k - 1], F.col(f"m{k}")), F.lit(0.0)) for k in (1, 2)]
    return conc.select(*AT, *[F.floor(F.least(F.lit(255.0), 255 * F.exp(-(c[0] * target[0][j] + c[1] * target[1][j])))).cast("int").alias(n) for j, n in enumerate("rgb")])


_EIG = "image_id long, e00 double, e01 double, e02 double, e10 double, e11 double, e12 double"


def _plane(cov: DataFrame) -> DataFrame:
    """The two main directions of each image's covariance, first component positive; images side by side in a batch."""

    def run(batches: Iterator):
        import numpy as np
        import pandas as pd

        for p in batches:
            m = p[["rr", "rg", "rb", "rg", "gg", "gb", "rb", "gb", "bb"]].to_numpy().reshape(-1, 3, 3)
            v = np.linalg.eigh(np.nan_to_num(m))[1][:, :, [2, 1]].transpose(0, 2, 1)
            v = np.where(v[:, :, :1] < 0, -v, v).reshape(-1, 6)
            yield pd.concat([p[["image_id"]].reset_index(drop=True), pd.DataFrame(v, columns=["e00", "e01", "e02", "e10", "e11", "e12"])], axis=1)

    return cov.mapInPandas(run, _EIG)


def macenko_stains(px: DataFrame, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """image_id, s00..s12: stain vectors from the extreme angles in the plane of the two main directions."""
    od = dense_only(densities(px), beta)
    plane = _plane(od_covariance(od))
    dot = lambda e: sum((F.col(f"od_{c}") * F.col(f"e{e}{j}") for j, c in enumerate("rgb")), F.lit(0.0))
    angle = od.join(plane, "image_id").select("image_id", F.atan2(dot(1), dot(0)).alias("phi"))
    ends = quantiles(angle, "phi", {"lo": alpha / 100, "hi": 1 - alpha / 100}).join(plane, "image_id")
    vec = lambda phi: [F.cos(phi) * F.col(f"e0{j}") + F.sin(phi) * F.col(f"e1{j}") for j in range(3)]
    both = ends.select("image_id", F.array(*vec("lo")).alias("a"), F.array(*vec("hi")).alias("b"))
    first, second = F.when(F.col("a")[0] > F.col("b")[0], F.col("a")).otherwise(F.col("b")), F.when(F.col("a")[0] > F.col("b")[0], F.col("b")).otherwise(F.col("a"))
    both = both.select("image_id", first.alias("a"), second.alias("b"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return both.select("image_id", *[(F.col(c)[j] / norm(c)).alias(f"s{i}{j}") for i, c in enumerate("ab") for j in range(3)])


def macenko(px: DataFrame) -> DataFrame:
    """Every image in the default profile's stains."""
    return render(concentrations(densities(px).join(macenko_stains(px), "image_id")))


def fit(px: DataFrame) -> DataFrame:
    """A target profile: each image's stains and largest concentrations."""
    stains = macenko_stains(px)
    return stains.join(_largest(concentrations(densities(px).join(stains, "image_id"))), "image_id")


def lasso(od: DataFrame, penalty: float) -> DataFrame:
    """od(od_r, od_g, od_b, s00..s12) with c1, c2 >= 0 that minimise half the squared distance of od from c1 s0 + c2 s1, plus penalty (c1 + c2).

    Exact: the two stains' optimum where both weights are positive, else the better one of either stain alone.
    """
    dot = lambda a, b: sum((a(j) * b(j) for j in range(3)), F.lit(0.0))
    s = lambda i: lambda j: F.col(f"s{i}{j}")
    v = lambda j: F.col(f"od_{'rgb'[j]}")
    told = od.select("*", dot(s(0), s(0)).alias("_aa"), dot(s(0), s(1)).alias("_ab"), dot(s(1), s(1)).alias("_bb"), (dot(s(0), v) - penalty).alias("_p"), (dot(s(1), v) - penalty).alias("_q"))
    aa, ab, bb, p, q = (F.col(f"_{c}") for c in ("aa", "ab", "bb", "p", "q"))
    det = aa * bb - ab * ab
    both1, both2 = F.try_divide(bb * p - ab * q, det), F.try_divide(aa * q - ab * p, det)
    one1, one2 = F.greatest(F.try_divide(p, aa), F.lit(0.0)), F.greatest(F.try_divide(q, bb), F.lit(0.0))
    # What a stain alone saves is half the square of its weight times its length's square.
    first = one1 * one1 * aa >= one2 * one2 * bb
    inside = F.coalesce((det > 1e-12) & (both1 > 0) & (both2 > 0), F.lit(False))
    zero = F.lit(0.0)
    c1 = F.when(inside, both1).when(F.coalesce(first, F.lit(True)), F.coalesce(one1, zero)).otherwise(0.0)
    c2 = F.when(inside, both2).when(F.coalesce(first, F.lit(True)), 0.0).otherwise(F.coalesce(one2, zero))
    return told.select(*od.columns, c1.alias("c1"), c2.alias("c2"))


def vahadane_stains(px: DataFrame, penalty: float = 0.1, rounds: int = 10, least: float = 0.8) -> DataFrame:
    """image_id, s00..s12: sparse non-negative factors of the optical densities of pixels that are not white.

    A round codes every pixel for the current stains (an exact non-negative lasso) and updates the stains from nine sums an image, so pixels stay where they are.
    """
    od = cut(px.filter(lightness() / 100 < least).select(*AT, *[optical_density(c).alias(f"od_{c}") for c in "rgb"]), "od")
    images = od.select("image_id").distinct()
    stains = images.select("image_id", *[F.lit(DEFAULT_STAINS[i][j]).alias(f"s{i}{j}") for i in range(2) for j in range(3)])
    for _ in range(rounds):
        coded = lasso(od.join(stains, "image_id"), penalty)
        sums = coded.groupBy("image_id").agg(F.sum(F.col("c1") * F.col("c1")).alias("p"), F.sum(F.col("c1") * F.col("c2")).alias("q"), F.sum(F.col("c2") * F.col("c2")).alias("t"), *[F.sum(F.col(f"c{k}") * F.col(f"od_{c}")).alias(f"k{k}{j}") for k in (1, 2) for j, c in enumerate("rgb")])
        det = F.col("p") * F.col("t") - F.col("q") * F.col("q") + 1e-9
        raw = [[F.greatest((F.col("t") * F.col(f"k1{j}") - F.col("q") * F.col(f"k2{j}")) / det, F.lit(1e-9)) for j in range(3)], [F.greatest((F.col("p") * F.col(f"k2{j}") - F.col("q") * F.col(f"k1{j}")) / det, F.lit(1e-9)) for j in range(3)]]
        rows = sums.select("image_id", *[raw[i][j].alias(f"r{i}{j}") for i in range(2) for j in range(3)])
        size = lambda i: F.sqrt(sum((F.col(f"r{i}{j}") * F.col(f"r{i}{j}") for j in range(3)), F.lit(0.0)))
        stains = cut(rows.select("image_id", *[(F.col(f"r{i}{j}") / size(i)).alias(f"s{i}{j}") for i in range(2) for j in range(3)]), "stains")
    swap = F.col("s00") >= F.col("s10")
    return stains.select("image_id", *[F.when(swap, F.col(f"s{i}{j}")).otherwise(F.col(f"s{1 - i}{j}")).alias(f"s{i}{j}") for i in range(2) for j in range(3)])


def vahadane(px: DataFrame) -> DataFrame:
    return render(concentrations(densities(px).join(vahadane_stains(px), "image_id")), scale=None)
