"""Tiled watershed and windowed extraction: against a flood of the whole image and a plain padded image."""

import numpy as np
import pytest

from tessera.operators import flood, nuclei, tissue


def table(spark, images, kind="double"):
    return spark.createDataFrame([(k, int(y), int(x), v.item()) for k, a in enumerate(images) for (y, x), v in np.ndenumerate(a)], f"image_id long, y int, x int, v {kind}")


def by_search(v, marks, mask):
    """The rule of ties on the whole image: least (pass, steps, label) of the front first."""
    label, front = dict(marks), [(v[at], 0, m, at) for at, m in marks.items()]
    while front:
        front.remove(least := min(front))
        height, steps, m, (y, x) = least
        for to in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= to[0] < v.shape[0] and 0 <= to[1] < v.shape[1] and mask[to] and to not in label:
                label[to] = m
                front.append((v[to], 0, m, to) if v[to] > height else (height, steps + 1, m, to))
    return label


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_tiles_equal_one_flood(spark, tile):
    rng = np.random.default_rng(8)
    h, w = 19, 26
    # Distinct values, one of them a spiral-like ridge that ways have to go around; and few values, so that ties decide.
    smooth = rng.permutation(h * w).reshape(h, w) / 7.0
    walls = smooth.copy()
    walls[3, :20] += 1000
    walls[8, 5:] += 1000
    walls[13, :22] += 1000
    images = [smooth, walls, rng.integers(0, 3, (h, w)).astype(float)]
    masks = [rng.random((h, w)) < 0.9, np.ones((h, w), bool), rng.random((h, w)) < 0.9]
    marks = [{(1, 2): 7, (12, 4): 3, (16, 20): 5}, {(0, 0): 2, (18, 1): 4}, {(1, 1): 9, (1, 20): 8, (17, 3): 1}]
    for m, own in zip(masks, marks):
        for at in own:
            m[at] = True
    px = table(spark, images)
    seeds = spark.createDataFrame([(k, *at, n) for k in range(3) for at, n in marks[k].items()], "image_id long, y int, x int, label int")
    mask = spark.createDataFrame([(k, int(y), int(x)) for k in range(3) for y, x in np.argwhere(masks[k])], "image_id long, y int, x int")
    got = sorted(map(tuple, flood.watershed_tiles(px, seeds, mask, tile).collect()))
    assert got == sorted((k, *at, n) for k in range(3) for at, n in by_search(images[k], marks[k], masks[k]).items())
    whole = sorted(map(tuple, tissue.watershed(px, seeds, h, w, mask).collect()))
    assert [r for r in got if r[0] < 2] == [r for r in whole if r[0] < 2]


def test_tiles_of_hard_images(spark):
    px = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, None), (0, 0, 2, 3.0), (1, 0, 0, 2.0), (None, 5, 5, 1.0)], "image_id long, y int, x int, v double")
    seeds = spark.createDataFrame([(0, 0, 0, 4), (0, 0, 0, 2), (2, 0, 0, 9), (0, 9, 9, 1)], "image_id long, y int, x int, label int")
    assert [tuple(r) for r in flood.watershed_tiles(px, seeds, tile=2).collect()] == [(0, 0, 0, 2)]
    assert flood.watershed_tiles(px.limit(0), seeds, tile=2).count() == 0
    assert flood.watershed_tiles(px, seeds.limit(0), tile=2).count() == 0


def drawn(h, w, centers, radius):
    y, x = np.mgrid[:h, :w]
    maps = np.zeros((h, w, 3))
    for cy, cx in centers:
        inside = (y - cy) ** 2 + (x - cx) ** 2 <= radius**2
        maps[inside] = np.stack([np.ones_like(y), (x - cx) / radius, (y - cy) / radius], -1)[inside]
    return maps


def test_windows_see_the_mirrored_image(spark, monkeypatch):
    monkeypatch.setattr(nuclei, "WINDOW", 16)
    monkeypatch.setattr(nuclei, "CORE", 10)
    rng = np.random.default_rng(4)
    h, w = 23, 9
    image = rng.integers(0, 256, (2, h, w, 3))
    px = spark.createDataFrame([(k, y, x, *map(int, image[k, y, x])) for k in range(2) for y in range(h) for x in range(w)], "image_id long, y int, x int, r int, g int, b int")
    tissue_ = rng.random((2, h, w)) < 0.7
    mask = spark.createDataFrame([tuple(map(int, at)) for at in np.argwhere(tissue_)], "image_id long, y int, x int")

    def model(windows):
        # Mean of the first channel over what surrounds a pixel by 3 places, and the others as they are.
        n = len(windows)
        near = np.stack([windows[:, dy : dy + 10, dx : dx + 10, 0] for dy in range(7) for dx in range(7)]).mean(0)
        return np.stack([near, windows[:, 3:13, 3:13, 1], windows[:, 3:13, 3:13, 2]], -1).reshape(n, 10, 10, 3)

    for given, seen in ((None, image), (mask, np.where(tissue_[..., None], image, 255))):
        rows = nuclei.predicted(px, model, h, w, given, batch=2).collect()
        assert len(rows) == 2 * h * w
        got = np.zeros((2, h, w, 3))
        for r in rows:
            got[r.image_id, r.y, r.x] = r.p, r.h, r.v
        big = np.pad(seen / 255.0, ((0, 0), (3, 3), (3, 3), (0, 0)), mode="reflect")
        want = np.stack([big[:, dy : dy + h, dx : dx + w, 0] for dy in range(7) for dx in range(7)]).mean(0)
        assert np.allclose(got[..., 0], want, atol=1e-6) and np.allclose(got[..., 1:], seen[..., 1:] / 255, atol=1e-6)


def test_nuclei_of_an_image_of_several_windows_and_tiles(spark):
    h, w, centers = 60, 210, [(14, 14), (14, 33), (40, 20), (30, 90), (30, 162), (31, 181), (45, 200)]
    maps = drawn(h, w, centers, 10)
    coded = np.round((maps + 1) * 100).astype(int)
    px = spark.createDataFrame([(5, y, x, *map(int, coded[y, x])) for y in range(h) for x in range(w)], "image_id long, y int, x int, r int, g int, b int")
    model = lambda windows: np.round(windows[:, 46:210, 46:210] * 255) / 100 - 1
    found, middles = nuclei.extract(px, model, h, w, tile=24)
    label = {(r.y, r.x): r.label for r in found.collect()}
    assert len({label[c] for c in centers}) == len(centers) == len(set(label.values()))
    at = {r.label: (r.cy, r.cx) for r in middles.collect()}
    for c in centers:
        assert abs(at[label[c]][0] - c[0]) <= 2 and abs(at[label[c]][1] - c[1]) <= 2
    for place, n in label.items():
        assert min((place[0] - y) ** 2 + (place[1] - x) ** 2 for (y, x) in centers if label[y, x] == n) <= 121
