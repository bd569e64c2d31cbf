import math

import numpy as np
from pyspark.sql import functions as F

from lodestrata.operators import images as I

rng = np.random.default_rng(5)
SHAPES = [(1, 1), (1, 7), (6, 1), (2, 2), (9, 13), (40, 23)]
IMAGES = [np.round(rng.uniform(0, 255, s)) for s in SHAPES]


def plain_laplacian(a):
    h, w = a.shape
    mirror = lambda k, n: 0 if n == 1 else -k if k < 0 else 2 * (n - 1) - k if k >= n else k
    out = [a[mirror(y - 1, h), x] + a[mirror(y + 1, h), x] + a[y, mirror(x - 1, w)] + a[y, mirror(x + 1, w)] - 4 * a[y, x] for y in range(h) for x in range(w)]
    mean = sum(out) / len(out)
    return sum((v - mean) ** 2 for v in out) / len(out)


def plain_resize(a, h, w):
    out = np.zeros((h, w))
    H, W = a.shape
    for y in range(h):
        for x in range(w):
            y0, y1, x0, x1 = y * H / h, (y + 1) * H / h, x * W / w, (x + 1) * W / w
            for v in range(H):
                for u in range(W):
                    out[y, x] += a[v, u] * max(0, min(y1, v + 1) - max(y0, v)) * max(0, min(x1, u + 1) - max(x0, u))
            out[y, x] /= (y1 - y0) * (x1 - x0)
    return out


def plain_blur(a, sigma):
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    h, w = a.shape
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            for dy, wy in enumerate(weights):
                for dx, wx in enumerate(weights):
                    out[y, x] += wy * wx / total**2 * a[min(h - 1, max(0, y + dy - reach)), min(w - 1, max(0, x + dx - reach))]
    return out


def test_against_plain_loops():
    for a in IMAGES:
        assert math.isclose(I.laplacian_variance(a), plain_laplacian(a), rel_tol=1e-9, abs_tol=1e-9)
        for h, w in ((1, 1), (3, 2), (min(5, a.shape[0]), min(7, a.shape[1]))):
            assert np.allclose(I.area_resized(a, h, w), plain_resize(a, h, w))
    assert np.allclose(I.blurred(IMAGES[4], 1.3), plain_blur(IMAGES[4], 1.3)) and np.allclose(I.blurred(IMAGES[1], 0.8), plain_blur(IMAGES[1], 0.8))
    assert np.array_equal(I.blurred(IMAGES[2], 0), IMAGES[2])


def frame(spark):
    rows = [(k, a.ravel().astype(int).tolist(), a.shape[1], a.shape[0], k % 2 == 1) for k, a in enumerate(IMAGES)]
    rows += [(90, None, 2, 2, True), (91, [1, 2, 3], 2, 2, False), (92, [1, None, 3, 4], 2, 2, False), (93, [], 0, 0, None), (94, [1, 2, 3, 4], None, 2, None)]
    return spark.createDataFrame(rows, "id long, pixels array<int>, width int, height int, guarded boolean")


def test_sharpness_and_quality(spark):
    found = {r.id: r.sharpness for r in I.with_sharpness(frame(spark).withColumn("sharpness", F.lit("old"))).collect()}
    assert all(math.isclose(found[k], plain_laplacian(a), rel_tol=1e-9, abs_tol=1e-9) for k, a in enumerate(IMAGES)) and all(found[k] is None for k in range(90, 95))
    q = spark.createDataFrame([(0.9, 60.0, 56.0, 200.0), (1.0, 999.0, 300.0, 300.0)], "c double, s double, w double, h double")
    assert [r.q for r in q.select(I.face_quality(F.col("c"), F.col("s"), F.col("w"), F.col("h")).alias("q")).collect()] == [0.66, 1.0]


def test_thumbnails_and_crops(spark):
    rows = I.thumbnails(frame(spark), side=8, sigma=1.0, guarded=F.col("guarded"))
    assert rows.columns == ["id", "pixels", "width", "height", "guarded", "thumbnail", "thumb_width", "thumb_height"]
    found = {r.id: r for r in rows.collect()}
    for k, a in enumerate(IMAGES):
        r = found[k]
        assert max(r.thumb_width, r.thumb_height) == min(8, max(a.shape))
        want = plain_resize(plain_blur(a, 1.0) if k % 2 else a, r.thumb_height, r.thumb_width)
        assert np.allclose(r.thumbnail, want.ravel())
    assert all(found[k].thumbnail is None for k in range(90, 95))
    boxes = frame(spark).filter("id = 4").select("*", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("xywh", b, strict=True)]) for b in ((2, 3, 4, 5), (-2, -2, 4, 4), (11, 7, 50, 50), (20, 20, 3, 3))])).alias("b")).select("*", "b.*").drop("b")
    crops = {(r.x, r.y): r for r in I.cropped(boxes).collect()}
    a = IMAGES[4]
    for key, part in {(2, 3): a[3:8, 2:6], (-2, -2): a[:2, :2], (11, 7): a[7:, 11:]}.items():
        assert np.array_equal(crops[key].crop, part.ravel()) and (crops[key].crop_height, crops[key].crop_width) == part.shape
    assert crops[20, 20].crop is None
