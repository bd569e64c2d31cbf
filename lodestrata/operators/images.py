"""Images as arrays of pixels: sharpness, area resize, crop and blur in Arrow batches.

An image is a row with ``pixels`` (grey values, row by row, of any number type), ``width`` and ``height``. A task holds
an Arrow batch and works on one image at a time. Defined results: images that are null, empty, hold unknown
pixels or have another number of them than width times height give null; all other columns stay, and columns
named as a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

# fixed values: the sharpness and size from which a face is as good as it gets, and the shares of a face's quality
SHARP, LARGE = 120.0, 112.0
OF_CONFIDENCE, OF_SHARPNESS, OF_SIZE = 0.40, 0.35, 0.25
#: Standard deviations of a Gaussian that its kernel has on either side.
TAIL = 3.0


def laplacian_variance(image: np.ndarray) -> float:
    """Variance of the Laplacian (four neighbours; borders are mirrored without repeating the edge)."""
    mirrored = image
    for axis in (0, 1):  # a single row or column is its own neighbour
        mirrored = np.pad(mirrored, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], "reflect" if image.shape[axis] > 1 else "edge")
    around = mirrored[:-2, 1:-1] + mirrored[2:, 1:-1] + mirrored[1:-1, :-2] + mirrored[1:-1, 2:]
    return float((around - 4 * image).var())


def shares(old: int, new: int) -> np.ndarray:
    """(new, old): which share of each old pixel a new one is made of; rows sum to 1."""
    edges = np.arange(new + 1) * (old / new)
    low, high = np.maximum.outer(edges[:-1], np.arange(old)), np.minimum.outer(edges[1:], np.arange(1, old + 1))
    return np.maximum(high - low, 0) * (new / old)


def area_resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Every new pixel is the mean of the area that it covers."""
    return shares(image.shape[0], height) @ image @ shares(image.shape[1], width).T


def gaussian(sigma: float) -> np.ndarray:
    reach = int(np.ceil(TAIL * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return weights / weights.sum()


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, a row pass and a column pass; what lies beyond a border is as the border."""
    if sigma <= 0:
        return image
    weights = gaussian(sigma)
    reach = len(weights) // 2
    for axis in (0, 1):
        n = image.shape[axis]
        total = np.zeros_like(image)
        for k, w in enumerate(weights.tolist()):
            total += w * np.take(image, np.clip(np.arange(n) + k - reach, 0, n - 1), axis=axis)
        image = total
    return image


def _over_images(images: DataFrame, made: list[StructField], work: Callable[[np.ndarray, dict], tuple], wanted: list[str] = ()) -> DataFrame:
    names = [f.name for f in made]
    kept = [c for c in images.columns if c not in names]
    at = {c: images.columns.index(c) for c in ("pixels", "width", "height", *wanted)}
    schema = StructType([*(images.schema[c] for c in kept), *made])
    of = {IntegerType(): pa.int32(), DoubleType(): pa.float64(), ArrayType(DoubleType()): pa.list_(pa.float64())}
    kinds, left = [of[f.dataType] for f in made], [images.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(at[c]).to_pylist() for c in ("width", "height")]
            others = [batch.column(at[c]).to_pylist() for c in wanted]
            out = []
            for k, (pixels, w, h) in enumerate(zip(batch.column(at["pixels"]), *sizes, strict=True)):
                values = pixels.values
                if values is None or not w or not h or w < 1 or h < 1 or len(values) != w * h or values.null_count:
                    out.append((None,) * len(kinds))
                    continue
                image = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(h, w)
                out.append(work(image, {c: o[k] for c, o in zip(wanted, others, strict=True)}))
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in left), *columns], [*kept, *names])

    return images.mapInArrow(run, schema)


def with_sharpness(images: DataFrame) -> DataFrame:
    """``images`` with ``sharpness``, the variance of the Laplacian."""
    return _over_images(images, [StructField("sharpness", DoubleType())], lambda image, _: (laplacian_variance(image),))


def cropped(images: DataFrame) -> DataFrame:
    """``images`` (with x, y, w, h in pixels) with ``crop``, ``crop_width`` and ``crop_height``: the part of the box
    that lies in the image, null where there is none."""

    def work(image: np.ndarray, box: dict) -> tuple:
        if any(v is None for v in box.values()):
            return None, None, None
        x, y = max(0, int(box["x"])), max(0, int(box["y"]))
        part = image[y : max(y, int(box["y"]) + int(box["h"])), x : max(x, int(box["x"]) + int(box["w"]))]
        return (part.ravel(), part.shape[1], part.shape[0]) if part.size else (None, None, None)

    made = [StructField("crop", ArrayType(DoubleType())), StructField("crop_width", IntegerType()), StructField("crop_height", IntegerType())]
    return _over_images(images, made, work, ["x", "y", "w", "h"])


def thumbnails(images: DataFrame, side: int = 256, sigma: float = 20.0, guarded: Column | None = None) -> DataFrame:
    """``images`` with ``thumbnail``, ``thumb_width`` and ``thumb_height``: no side longer than ``side``, area by area
    and never enlarged; blurred where ``guarded`` holds, before it is made smaller."""
    marked = images.withColumn("_guarded", F.lit(False) if guarded is None else F.coalesce(guarded, F.lit(False)))

    def work(image: np.ndarray, row: dict) -> tuple:
        h, w = image.shape
        scale = min(1.0, side / max(h, w))
        new_h, new_w = max(1, round(h * scale)), max(1, round(w * scale))
        image = blurred(image, sigma) if row["_guarded"] else image
        return area_resized(image, new_h, new_w).ravel(), new_w, new_h

    made = [StructField("thumbnail", ArrayType(DoubleType())), StructField("thumb_width", IntegerType()), StructField("thumb_height", IntegerType())]
    return _over_images(marked, made, work, ["_guarded"]).drop("_guarded")


def face_quality(confidence: Column, sharpness: Column, width: Column, height: Column) -> Column:
    """Quality of a face, 0 to 1 with three places, from its confidence, sharpness and size in pixels."""
    share = lambda c, of: F.least(F.lit(1.0), c / of)
    return F.round(OF_CONFIDENCE * confidence + OF_SHARPNESS * share(sharpness, SHARP) + OF_SIZE * share(F.least(width, height), LARGE), 3)
