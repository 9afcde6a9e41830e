"""Images by strips against Spark's own decoder, and patches turned by any angle against the whole image."""

import struct
import zlib

import numpy as np
import pytest

from tessera.operators import patches as A
from tessera.sources import images


def filtered(values, kinds):
    """A PNG whose scan lines take the given filters in turn."""
    h, w, n = values.shape
    lines, above = [], np.zeros((w, n), int)
    for k in range(h):
        line = values[k].astype(int)
        left, corner = np.vstack([np.zeros((1, n), int), line[:-1]]), np.vstack([np.zeros((1, n), int), above[:-1]])
        p = left + above - corner
        near = [abs(p - left), abs(p - above), abs(p - corner)]
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], above, corner))
        kind = kinds[k % len(kinds)]
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    body = zlib.compress(b"".join(lines))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + b"".join(chunk(b"IDAT", body[a : a + 100]) for a in range(0, len(body), 100)) + chunk(b"IEND", b"")


def test_strips_equal_the_decoder(spark, tmp_path):
    r = np.random.default_rng(1)
    for n in (1, 3, 4):
        values = r.integers(0, 256, (29, 13, n)).astype(np.uint8)
        if n == 4:
            values[..., 3] = 255
        (tmp_path / f"image{n}.png").write_bytes(filtered(values, [0, 1, 2, 3, 4, 4, 3]))
    wanted = sorted(map(tuple, images.scan(spark, str(tmp_path)).collect()))
    for rows in (1, 7, 64):
        assert sorted(map(tuple, images.scan_strips(spark, str(tmp_path), rows).collect())) == wanted
    assert len(wanted) == 3 * 29 * 13


def test_strips_hold_little_of_a_large_image(tmp_path):
    import tracemalloc

    values = np.zeros((6000, 3000, 3), np.uint8)
    values[::7] = 9
    content = images.png(values)
    tracemalloc.start()
    seen = sum(int(v[..., 0].sum()) for _, v in images.png_strips(content, 32))
    assert seen == int(values[..., 0].sum(dtype=np.int64)) and tracemalloc.get_traced_memory()[1] < 10e6
    tracemalloc.stop()


def test_what_is_no_png_is_named(spark, tmp_path):
    (tmp_path / "broken.png").write_bytes(images.png(np.ones((9, 9), np.uint8))[:-30])
    with pytest.raises(Exception, match="broken.png"):
        images.scan_strips(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("degrees", [0, 90, 30, 45, 201.5])
def test_turned_patches_show_what_lies_around(spark, degrees):
    r = np.random.default_rng(5)
    h, w, patch = 20, 26, 8
    image = r.integers(0, 256, (h, w, 3))
    px = spark.createDataFrame([(0, y, x, *map(int, image[y, x])) for y in range(h) for x in range(w)], "image_id long, y int, x int, r int, g int, b int")
    corners = [(0, 1, 6, 9), (0, 2, -3, 20)]
    df = spark.createDataFrame(corners, "image_id long, label int, top int, left int")
    got = {x.label: np.array(x.data).reshape(patch, patch, 3) for x in A.patch_pixels(df, px, patch, 255, None, degrees).collect()}
    c, t = (patch - 1) / 2, np.deg2rad(degrees)
    for _, label, top, left in corners:
        for ty in range(patch):
            for tx in range(patch):
                y, x = ty - c, tx - c
                sy, sx = top + int(np.rint(round(np.cos(t), 12) * y + round(np.sin(t), 12) * x + c)), left + int(np.rint(-round(np.sin(t), 12) * y + round(np.cos(t), 12) * x + c))
                want = image[sy, sx] if 0 <= sy < h and 0 <= sx < w else [255] * 3
                assert (got[label][ty, tx] == want).all()
    mean = lambda b: b.reshape(len(b), -1, 3).mean(1)
    augs = [(degrees, "n"), (0, "h"), (degrees, "v")]
    feats = {(x.label, x.aug): x.feat for x in A.seen(df, px, patch, mean, augs, dtype=np.float64, means=(0, 0, 0), deviations=(1, 1, 1)).collect()}
    for label, data in got.items():
        for k in (0, 2):
            assert feats[label, k] == pytest.approx(list(data.reshape(-1, 3).mean(0) / 255))
