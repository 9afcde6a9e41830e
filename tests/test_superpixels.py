"""Superpixels: clustering against plain k-means, the chain against its parts by hand."""

import numpy as np
import pytest

from tessera.operators import raster as P
from tessera.operators import superpixel as U


def lab(rgb):
    c = rgb / 255.0
    lin = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    f = lin @ np.array(P.XYZ).T / np.array(P.WHITE)
    f = np.where(f > 0.008856, np.cbrt(f), 7.787 * f + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def kmeans(image, step, compactness, rounds):
    h, w = image.shape[:2]
    cols, rows = -(-w // step), -(-h // step)
    color = lab(image)
    y, x = np.mgrid[:h, :w]
    seed = y // step * cols + x // step
    for _ in range(rounds - 1):
        means = {s: (color[seed == s].mean(0), y[seed == s].mean(), x[seed == s].mean()) for s in set(seed.ravel().tolist())}
        after = seed.copy()
        for i in range(h):
            for j in range(w):
                best = []
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        cy, cx = i // step + dy, j // step + dx
                        s = cy * cols + cx
                        if 0 <= cy < rows and 0 <= cx < cols and s in means:
                            m, my, mx = means[s]
                            best.append((((color[i, j] - m) ** 2).sum() / compactness**2 + ((i - my) ** 2 + (j - mx) ** 2) / step**2, s))
                after[i, j] = min(best)[1]
        seed = after
    return seed


def table(spark, images):
    return spark.createDataFrame([(k, y, x, *map(int, im[y, x])) for k, im in enumerate(images) for y in range(im.shape[0]) for x in range(im.shape[1])], "image_id long, y int, x int, r int, g int, b int")


def test_clusters_equal_plain_kmeans(spark):
    r = np.random.default_rng(3)
    images = [r.integers(0, 256, (17, 22, 3)), np.repeat(np.repeat(r.integers(0, 256, (3, 4, 3)), 6, 0), 6, 1)[:17, :22]]
    got = np.zeros((2, 17, 22), int)
    for p in U.clustered(table(spark, images), 17, 22, 5, compactness=10.0, rounds=4, sigma=0).collect():
        got[p.image_id, p.y, p.x] = p.seed
    for k, image in enumerate(images):
        assert (got[k] == kmeans(image, 5, 10.0, 4)).mean() > 0.995  # sums of means differ in their last digits


def test_number_or_size_of_superpixels():
    assert U.grid_step(100, 100, number=100) == 10 and U.grid_step(100, 100, size=25) == 5 and U.grid_step(100, 100, size=25, most=100) == 10
    for wrong in ({}, {"number": 4, "size": 9}, {"number": 0}):
        with pytest.raises(ValueError):
            U.grid_step(10, 10, **wrong)


def test_chain_gives_both_maps(spark):
    # Four plain quarters, one of them without tissue; two are nearly of one colour.
    image = np.zeros((16, 16, 3), int)
    image[:8, :8], image[:8, 8:], image[8:, :8], image[8:, 8:] = (200, 40, 40), (198, 41, 40), (40, 40, 200), (10, 200, 10)
    px = table(spark, [image])
    tissue = px.filter("y < 8 OR x < 8").select("image_id", "y", "x")
    for factor in (1, 2):
        rows = U.superpixels(px, 16, 16, number=4, tissue=tissue, factor=factor, thresh=0.05, rounds=3, sigma=0).collect()
        assert len(rows) == 256
        at = {(r.y, r.x): (r.initial, r.merged) for r in rows}
        quarter = lambda y, x: {at[a, b] for a in range(y, y + 8) for b in range(x, x + 8)}  # noqa: B023, E731
        assert all(len(quarter(y, x)) == 1 for y in (0, 8) for x in (0, 8))
        ((i1, m1),), ((i2, m2),), ((i3, m3),), ((i4, m4),) = quarter(0, 0), quarter(0, 8), quarter(8, 0), quarter(8, 8)
        assert len({i1, i2, i3, i4}) == 4 and m1 == m2 > 0 and m3 > 0 and m3 != m1 and m4 == 0


def pieces(seed, least):
    """Labels of connected pieces by plain floods, small ones joined to the left or above; seed is -1 where there is no pixel."""
    (h, w), first = seed.shape, {}
    own = np.full(seed.shape, -1)
    for i in range(h):
        for j in range(w):
            if seed[i, j] >= 0 and own[i, j] < 0:
                own[i, j], todo = i * w + j, [(i, j)]
                while todo:
                    a, b = todo.pop()
                    for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                        if 0 <= c < h and 0 <= d < w and own[c, d] < 0 and seed[c, d] == seed[i, j]:
                            own[c, d] = i * w + j
                            todo.append((c, d))
                beside = [own[c, d] for c, d in ((i, j - 1), (i - 1, j)) if c >= 0 and d >= 0 and own[c, d] >= 0]
                small = (own == i * w + j).sum() < least
                first[i * w + j] = first[beside[0]] if small and beside else i * w + j
    names = {r: k + 1 for k, r in enumerate(sorted(set(first.values())))}
    return np.array([[names[first[c]] if c >= 0 else 0 for c in row] for row in own])


def labelled(df, shape):
    out = np.zeros(shape, int)
    for p in df.collect():
        out[p.image_id, p.y, p.x] += p.label
    return out


def test_slic_equals_plain_steps_in_one_job(spark, monkeypatch):
    """No table is written between rounds, and a group is an image."""
    r = np.random.default_rng(5)
    smooth = (np.add.outer(np.arange(17) * 9, np.arange(22) * 4)[..., None] + r.integers(0, 30, (17, 22, 3))) % 256
    images = [r.integers(0, 256, (17, 22, 3)), smooth]
    monkeypatch.setattr(U, "cut", None)
    df = U.slic(table(spark, images), 17, 22, 5, compactness=10.0, rounds=4, sigma=0)
    assert df.dtypes == [("image_id", "bigint"), ("y", "int"), ("x", "int"), ("label", "int")]
    got = labelled(df, (2, 17, 22))
    for k, image in enumerate(images):
        assert (got[k] == pieces(kmeans(image, 5, 10.0, 4), 12)).all()


@pytest.mark.parametrize("how", [{"rounds": 3}, {"rounds": 2, "sigma": 0, "color_space": "hed"}])
def test_slic_of_larger_images_is_the_same(spark, monkeypatch, how):
    """Images of over TASK_PIXELS go by joins. One of these has a gap, one a pixel without its red; a pixel beyond an image is no part of it."""
    r = np.random.default_rng(6)
    px = table(spark, [r.integers(0, 256, (13, 18, 3)), r.integers(0, 256, (13, 18, 3))]).filter("image_id = 0 OR y < 6 OR x < 11").selectExpr("image_id", "y", "x", "IF(y = 2 AND x = 3, NULL, r) AS r", "g", "b")
    beyond = spark.createDataFrame([(0, 2, 40, 1, 2, 3)], px.schema)
    by_tasks = labelled(U.slic(px.unionByName(beyond), 13, 18, 4, **how), (2, 13, 18))
    monkeypatch.setattr(U, "TASK_PIXELS", 0)
    by_joins = labelled(U.slic(px, 13, 18, 4, **how), (2, 13, 18))
    assert (by_tasks == by_joins).all() and (by_tasks > 0).sum() == px.count()


def test_slic_of_one_seed_and_one_pixel(spark):
    assert labelled(U.slic(table(spark, [np.full((3, 4, 3), 7)]), 3, 4, 10), (1, 3, 4)).tolist() == [[[1] * 4] * 3]
    assert [tuple(r) for r in U.slic(table(spark, [np.full((1, 1, 3), 255)]), 1, 1, 1, rounds=1).collect()] == [(0, 0, 0, 1)]
    assert U.slic(table(spark, [np.full((3, 4, 3), 7)]).limit(0), 3, 4, 2).count() == 0
    with pytest.raises(ValueError):
        U.slic(table(spark, [np.full((1, 1, 3), 255)]), 1, 1, 1, color_space="xyz")
