"""Image transforms inside tasks: base transform and seeded augmentation variants.

Spark multiplies the image rows, seeds each variant from its key and spreads the work; numpy
only touches the pixels of one image at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohort.functions.keyed import seeded_key
from cohort.operators.fingerprint import grey, image_array

# Channel normalisation, and ranges and probabilities of the two augmentation modes.
MEAN = (0.485, 0.456, 0.406)
STD = (0.229, 0.224, 0.225)
IMAGE_SIZE = 224
CONSERVATIVE = {
    "affine": 0.7, "shift": 0.05, "scale": (0.9, 1.1), "rotate": 15,
    "light": 0.5, "brightness": 0.15, "contrast": 0.15,
    "noise": 0.3, "noise_std": (0.02, 0.06),
    "elastic": 0.3, "alpha": 50, "sigma": 5,
}
AGGRESSIVE = {
    "affine": 0.8, "shift": 0.08, "scale": (0.8, 1.2), "rotate": 30,
    "flip": 0.5,
    "light": 0.6, "brightness": 0.2, "contrast": 0.2,
    "clahe": 0.3, "clip_limit": 2.0, "tiles": 8,
    "blur": 0.2, "blur_sizes": (3, 5),
    "noise": 0.4, "noise_std": (0.02, 0.1),
    "elastic": 0.5, "alpha": 80, "sigma": 5,
    "cutout": 0.4, "hole": (8, 40),
}
MODES = {"base": {}, "conservative": CONSERVATIVE, "aggressive": AGGRESSIVE}


def sample(pixels: np.ndarray, ys: np.ndarray, xs: np.ndarray, edge: bool) -> np.ndarray:
    """Bilinear look-up at fractional positions; outside is the edge pixel or black."""
    height, width = pixels.shape[:2]
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    wy, wx = (ys - y0)[..., None], (xs - x0)[..., None]

    def at(y, x):
        found = pixels[np.clip(y, 0, height - 1), np.clip(x, 0, width - 1)]
        if edge:
            return found
        inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
        return found * inside[..., None]

    upper = at(y0, x0) * (1 - wx) + at(y0, x0 + 1) * wx
    lower = at(y0 + 1, x0) * (1 - wx) + at(y0 + 1, x0 + 1) * wx
    return upper * (1 - wy) + lower * wy


def resize(pixels: np.ndarray, size: int) -> np.ndarray:
    ys = (np.arange(size) + 0.5) * pixels.shape[0] / size - 0.5
    xs = (np.arange(size) + 0.5) * pixels.shape[1] / size - 0.5
    return sample(pixels, *np.meshgrid(ys, xs, indexing="ij"), edge=True)


def smooth(field: np.ndarray, sigma: float, reach: int) -> np.ndarray:
    """Gaussian smoothing along both axes with repeated edges."""
    weights = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2.0 * sigma * sigma))
    weights /= weights.sum()
    for axis in (0, 1):
        pad = [(0, 0)] * field.ndim
        pad[axis] = (reach, reach)
        padded = np.pad(field, pad, mode="edge")
        length = field.shape[axis]
        field = sum(w * np.take(padded, range(i, i + length), axis=axis)
                    for i, w in enumerate(weights))
    return field


def affine(x: np.ndarray, rng: np.random.Generator, p: dict) -> np.ndarray:
    side = x.shape[0]
    shift = rng.uniform(-p["shift"], p["shift"], 2) * side
    scale, turn = rng.uniform(*p["scale"]), np.deg2rad(rng.uniform(-p["rotate"], p["rotate"]))
    centre = (side - 1) / 2
    ys, xs = np.mgrid[:side, :side] - centre - shift[:, None, None]
    cos, sin = np.cos(turn) / scale, np.sin(turn) / scale
    return sample(x, cos * ys - sin * xs + centre, sin * ys + cos * xs + centre, edge=False)


def elastic(x: np.ndarray, rng: np.random.Generator, p: dict) -> np.ndarray:
    side = x.shape[0]
    moves = [smooth(rng.uniform(-1, 1, (side, side)), p["sigma"], 3 * p["sigma"]) * p["alpha"]
             for _ in range(2)]
    ys, xs = np.mgrid[:side, :side]
    return sample(x, ys + moves[0], xs + moves[1], edge=True)


def clahe(x: np.ndarray, clip_limit: float, tiles: int) -> np.ndarray:
    """Contrast-limited equalisation of brightness, blended between tile centres."""
    light = grey(x)
    level = np.clip(light * 255, 0, 255).astype(int)
    edges = np.linspace(0, x.shape[0], tiles + 1).astype(int)
    curves = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = level[edges[i]:edges[i + 1], edges[j]:edges[j + 1]]
            counts = np.bincount(part.ravel(), minlength=256).astype(float)
            limit = max(clip_limit * part.size / 256, 1.0)
            excess = np.maximum(counts - limit, 0).sum()
            curves[i, j] = np.cumsum(np.minimum(counts, limit) + excess / 256) / part.size
    place = np.clip((np.arange(x.shape[0]) + 0.5) / x.shape[0] * tiles - 0.5, 0, tiles - 1)
    low = np.minimum(place.astype(int), tiles - 2)
    part = place - low
    wy, wx = part[:, None], part[None, :]
    i, j = low[:, None], low[None, :]
    mapped = ((curves[i, j, level] * (1 - wx) + curves[i, j + 1, level] * wx) * (1 - wy)
              + (curves[i + 1, j, level] * (1 - wx) + curves[i + 1, j + 1, level] * wx) * wy)
    return x * (mapped / np.maximum(light, 1e-6))[..., None]


def cutout(x: np.ndarray, rng: np.random.Generator, p: dict) -> np.ndarray:
    height, width = rng.integers(p["hole"][0], p["hole"][1] + 1, 2)
    top = rng.integers(0, max(x.shape[0] - height, 0) + 1)
    left = rng.integers(0, max(x.shape[1] - width, 0) + 1)
    x = x.copy()
    x[top:top + height, left:left + width] = 0
    return x


def vary(x: np.ndarray, rng: np.random.Generator, p: dict) -> np.ndarray:
    """One random variant of 0-1 pixels; each step has its own probability."""
    def happens(step):
        return step in p and rng.random() < p[step]

    if happens("affine"):
        x = affine(x, rng, p)
    if happens("flip"):
        x = x[:, ::-1]
    if happens("light"):
        gain = 1 + rng.uniform(-p["contrast"], p["contrast"])
        x = np.clip(x * gain + rng.uniform(-p["brightness"], p["brightness"]), 0, 1)
    if happens("clahe"):
        x = np.clip(clahe(x, p["clip_limit"], p["tiles"]), 0, 1)
    if happens("blur"):
        size = int(rng.choice(p["blur_sizes"]))
        x = smooth(x, 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2)
    if happens("noise"):
        x = np.clip(x + rng.normal(0, rng.uniform(*p["noise_std"]), x.shape), 0, 1)
    if happens("elastic"):
        x = elastic(x, rng, p)
    if happens("cutout"):
        x = cutout(x, rng, p)
    return x


def transform_images(images: DataFrame, key: str = "path", mode: str = "base", variants: int = 1,
                     size: int = IMAGE_SIZE, seed: int = 42, keep: tuple[str, ...] = ()
                     ) -> DataFrame:
    """``variants`` tensors per decodable image: (key, keep..., variant, tensor in CHW order).

    ``base`` only resizes and normalises, so one variant is enough.  A variant depends on the
    seed, the key and its number, never on the partitioning.
    """
    if mode not in MODES:
        raise ValueError(f"unknown transform mode {mode!r}")
    params = MODES[mode]
    columns = [key, *keep, "variant"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tensors = []
            for h, w, c, data, digest in zip(frame["height"], frame["width"],
                                             frame["nChannels"], frame["data"],
                                             frame["digest"]):
                x = resize(image_array(h, w, c, data) / 255.0, size)
                x = vary(x, np.random.default_rng(int(digest, 16)), params)
                x = (x - np.array(MEAN)) / np.array(STD)
                tensors.append(x.transpose(2, 0, 1).astype(np.float32).ravel())
            yield frame[columns].assign(tensor=tensors)

    expanded = (images.where(F.col("image.height") > 0)
                .withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))
                .withColumn("digest", seeded_key(seed, F.col(key), F.col("variant")))
                .select(*columns, "digest", "image.height", "image.width", "image.nChannels",
                        "image.data"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                       for f in expanded.select(*columns).schema.fields)
    return expanded.mapInPandas(run, f"{fields}, tensor array<float>")
