"""Operators against brute force, on inputs that go beyond earlier caps."""

import inspect

import numpy as np
import pytest

from tessera import catalog, fixtures
from tessera.operators import raster as P
from tessera.operators import superpixel as U
from tessera.operators import tissue as T


def _pieces(mask):
    """4-connected pieces of a mask, each a list of (y, x), in the order of their first pixels."""
    seen, out = set(), []
    for at in map(tuple, np.argwhere(mask)):
        if at in seen:
            continue
        seen.add(at)
        piece = [at]
        for y, x in piece:
            for to in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                if 0 <= to[0] < mask.shape[0] and 0 <= to[1] < mask.shape[1] and mask[to] and to not in seen:
                    seen.add(to)
                    piece.append(to)
        out.append(piece)
    return out


def _tissue(image, sigma, min_size, kernel, background):
    """The reference's loop, image by image, and its rounds."""
    h, w, _ = image.shape
    luma = lambda a, b, c: (a * 4899 + b * 9617 + c * 1868 + 8192) >> 14
    image, found, rounds = image.copy(), np.zeros((h, w), bool), 0
    own = luma(image[..., 0], image[..., 1], image[..., 2])
    weights = np.array(P.kernel(sigma))
    r = len(weights) // 2
    while True:
        v = (255 - luma(image[..., 2], image[..., 1], image[..., 0])).astype(float)
        v = sum(k * np.pad(v, ((r, r), (0, 0)), "edge")[i : i + h] for i, k in enumerate(weights))
        v = sum(k * np.pad(v, ((0, 0), (r, r)), "edge")[:, i : i + w] for i, k in enumerate(weights))
        some, threshold = v[v > 0], 0.0
        if some.size and some.min() < some.max():
            edges = np.linspace(some.min(), some.max(), 257)
            middles, count = (edges[1:] + edges[:-1]) / 2, np.histogram(some, edges)[0]
            left, right = np.cumsum(count), np.cumsum(count[::-1])[::-1]
            mean = lambda c, m, n: np.cumsum(c * m) / np.maximum(n, 1)
            gap = mean(count, middles, left)[:-1] - mean(count[::-1], middles[::-1], right[::-1])[::-1][1:]
            threshold = middles[np.argmax(np.round(left[:-1] * right[1:] * gap**2 * (256 / (some.max() - some.min())) ** 2, 6))]
        piece = max(_pieces((v >= threshold) & (v > 0)), key=len, default=[])
        if len(piece) < min_size:
            return found, rounds
        grown = np.zeros((h, w), bool)
        for y, x in piece:
            grown[max(0, y - (kernel - 1) // 2) : y + kernel // 2 + 1, max(0, x - (kernel - 1) // 2) : x + kernel // 2 + 1] = True
        if not own[grown & (own > 0)].mean() < background or not (grown & ~found).any():
            return found, rounds
        found |= grown
        image[grown] = 255
        rounds += 1


def test_tissue_mask_takes_all_pieces(spark):
    rng = np.random.default_rng(3)
    h, w = 26, 62
    image = np.full((h, w, 3), 255)
    for k in range(14):
        y, x = 1 + k // 7 * 9, 1 + k % 7 * 9
        image[y : y + 4 + k % 2, x : x + 5] = rng.integers(60, 90, (4 + k % 2, 5, 3)) if k < 12 else rng.integers(70, 100, (4 + k % 2, 5, 3))
    image[19:25, 3:30] = rng.integers(238, 246, (6, 27, 3))
    wanted, rounds = _tissue(image, 0.6, 6, 3, 228.0)
    assert rounds > 10 and not wanted[22, 10]
    px = spark.createDataFrame([(0, y, x, *map(int, image[y, x])) for y in range(h) for x in range(w)], "image_id long, y int, x int, r int, g int, b int")
    got = T.gaussian_tissue_mask(px, h, w, sigma=0.6, min_size=6, kernel=3).collect()
    assert sorted((r.y, r.x) for r in got) == sorted(map(tuple, np.argwhere(wanted).tolist()))


def test_registered_tissue_mask_finds_mosaic_gray(spark, monkeypatch):
    image = np.full((fixtures.HEIGHT, fixtures.WIDTH, 3), 255)
    image[5:15, 10:40] = np.random.default_rng(1).integers(124, 131, (10, 30, 3))
    image[20:32, 90:140] = np.random.default_rng(2).integers(124, 131, (12, 50, 3))
    wanted, rounds = _tissue(image, 1.0, 10, 5, 228.0)
    assert rounds >= 2 and wanted[10, 20] and wanted[25, 100]
    px = spark.createDataFrame([(0, y, x, *map(int, image[y, x])) for y in range(fixtures.HEIGHT) for x in range(fixtures.WIDTH)], "image_id long, y int, x int, r int, g int, b int")
    monkeypatch.setattr(fixtures, "pixels", lambda spark, sf: px)
    got = catalog.QUERIES["tissue_mask"](spark, "").collect()
    assert sorted((r.y, r.x) for r in got) == sorted(map(tuple, np.argwhere(wanted).tolist()))


def test_tissue_rounds_of_an_image_are_one_job(spark):
    """Images with gaps, the second of one value and the third black: as by jobs over pixels, in jobs that do not grow with the rounds."""
    rng = np.random.default_rng(6)
    h, w = 14, 30
    images = [np.full((h, w, 3), 255), np.full((h, w, 3), 77), np.zeros((h, w, 3), int)]
    for k in range(2):
        images[0][2:8, 2 + k * 14 : 12 + k * 13] = rng.integers(60, 190, (6, 10 - k, 3))
    at = [(k, y, x, *map(int, images[k][y, x])) for k in range(3) for y in range(h) for x in range(w) if y < 10 or x < 24]
    px = spark.createDataFrame(at, "image_id long, y int, x int, r int, g int, b int").cache()
    spark.sparkContext.setJobGroup("tissue", "")
    got = T.gaussian_tissue_mask(px, h, w, sigma=0.6, min_size=6, kernel=3)
    rows = sorted(map(tuple, got.collect()))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("tissue")) <= 3
    spark.sparkContext.setJobGroup("others", "")
    assert got.schema.simpleString() == "struct<image_id:bigint,y:int,x:int>" and 0 < len(rows) < len(at)
    assert rows == sorted(map(tuple, T.tissue_by_pixels(px, h, w, 0.6, 6, 3, 228.0, 1).collect()))
    px.unpersist()


def _flooded(v, marks, mask):
    """A priority flood by search of the whole front: lowest value first, then the one touched first."""
    label, front, touched = dict(marks), [(v[at], 0, at) for at in marks], 0
    while front:
        front.remove(least := min(front))
        y, x = least[2]
        for to in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= to[0] < v.shape[0] and 0 <= to[1] < v.shape[1] and mask[to] and to not in label:
                touched += 1
                label[to] = label[y, x]
                front.append((v[to], touched, to))
    return label


@pytest.mark.parametrize("kind", ["int", "double"])
def test_watershed_floods_every_value(spark, kind):
    rng = np.random.default_rng(5)
    h, w = 14, 23
    # Negated distances in [-1, 0], as in the reference's nuclei; and integers of one band of 16.
    images = [-rng.random((h, w)) if kind == "double" else rng.integers(0, 16, (h, w)) for _ in range(3)]
    masks = [rng.random((h, w)) < 0.85 for _ in images]
    marks = [{(1, 2): 7, (12, 4): 3, (6, 20): 5} for _ in images]
    for m in masks:
        for at in marks[0]:
            m[at] = True
    px = spark.createDataFrame([(k, y, x, images[k][y, x].item()) for k in range(3) for y in range(h) for x in range(w)], f"image_id long, y int, x int, v {kind}")
    seeds = spark.createDataFrame([(k, *at, n) for k in range(3) for at, n in marks[k].items()], "image_id long, y int, x int, label int")
    mask = spark.createDataFrame([(k, int(y), int(x)) for k in range(3) for y, x in np.argwhere(masks[k])], "image_id long, y int, x int")
    for given, of in ((None, [np.ones((h, w), bool)] * 3), (mask, masks)):
        wanted = sorted((k, *at, n) for k in range(3) for at, n in _flooded(images[k], marks[k], of[k]).items())
        assert sorted(map(tuple, T.watershed(px, seeds, h, w, given).collect())) == wanted


def test_slic_labels_are_connected_and_not_small(spark):
    rng = np.random.default_rng(7)
    h, w, step = 24, 40, 6
    images = rng.integers(0, 256, (2, h, w, 3))
    px = spark.createDataFrame([(k, y, x, *map(int, images[k, y, x])) for k in range(2) for y in range(h) for x in range(w)], "image_id long, y int, x int, r int, g int, b int")
    assert inspect.signature(U.slic).parameters["rounds"].default == 10
    rows = U.slic(px, h, w, step).collect()
    assert len(rows) == 2 * h * w
    for k in range(2):
        lab = np.zeros((h, w), int)
        for r in rows:
            if r.image_id == k:
                lab[r.y, r.x] = r.label
        assert set(lab.ravel()) == set(range(1, lab.max() + 1))
        for n in range(1, lab.max() + 1):
            assert len(_pieces(lab == n)) == 1
            assert (lab == n).sum() >= step * step // 2 or n == lab[0, 0]


def test_connected_joins_chains_of_small_pieces(spark):
    # A large piece, then small ones that touch one another; label 1 has a second, detached large piece.
    picture = ["1111112311", "1111114511", "1111116711"]
    lab = spark.createDataFrame([(0, y, x, int(c)) for y, line in enumerate(picture) for x, c in enumerate(line)], "image_id long, y int, x int, label int")
    got = {(r.y, r.x): r.label for r in U.connected(lab, 10, 4).collect()}
    assert got == {(y, x): 1 if x < 8 else 2 for y in range(3) for x in range(10)}
