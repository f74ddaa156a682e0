"""Kernels over arrays: scores of embeddings, boxes, pixels and tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDES = (1.0, 0.85, 0.7)


def fold_layers(layers: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[float], float]:
    """The single affine map of affine layers without activations: weights and bias."""
    w, b = layers[0][0].astype(float), layers[0][1].astype(float)
    for w2, b2 in layers[1:]:
        w, b = w2 @ w, w2 @ b + b2
    return w[0].tolist(), float(b[0])


def head_score(embedding: Column, weights: list[float], bias: float) -> Column:
    """The head's score of an embedding, which is brought to length 1 first; null for null or empty ones."""
    norm = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    dot = F.aggregate(F.zip_with(embedding, F.array(*map(F.lit, weights)), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when(norm > 0, dot / norm + bias)


def crop_candidates(sizes: DataFrame) -> DataFrame:
    """Square crops of images (id, width, height) as fractions (x, y, w, h): three sides of the short edge at nine places, each once.

    All of an image are made and deduplicated in one array, so nothing is shuffled; repeated rows of an image give its crops again.
    """
    w0, h0 = (F.greatest(c, F.lit(1)).cast("double") for c in ("width", "height"))
    places = (0.0, 0.5, 1.0)
    sides = F.transform(F.array(*map(F.lit, SIDES)), lambda s: F.struct((s * F.least(w0, h0) / w0).alias("w"), (s * F.least(w0, h0) / h0).alias("h")))
    box = lambda c, fx, fy: F.struct(F.round((1 - c["w"]) * fx, 9).alias("x"), F.round((1 - c["h"]) * fy, 9).alias("y"), F.round(c["w"], 9).alias("w"), F.round(c["h"], 9).alias("h"))
    boxes = F.flatten(F.transform(sides, lambda c: F.array(*(box(c, fx, fy) for fx in places for fy in places))))
    return sizes.select("id", F.explode(F.array_distinct(boxes)).alias("b")).select("id", "b.*")


def crop_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The pixels of a crop given in fractions as a struct (left, top, columns, rows), at least one and inside the frame."""
    left, top = (F.greatest(F.lit(0), F.least(n - 1, F.round(c * n).cast("int"))) for c, n in ((x, width), (y, height)))
    size = lambda c, n, start: F.greatest(F.lit(1), F.least(n - start, F.round(c * n).cast("int")))
    return F.struct(left.alias("left"), top.alias("top"), size(w, width, left).alias("columns"), size(h, height, top).alias("rows"))


#: The detector's frame, its strides, and what counts as a face.
FACE_FRAME, STRIDES, FACE_SCORE, FACE_PIXELS, FACE_OVERLAP = 640, (8, 16, 32), 0.6, 24.0, 0.3
EYE_WIDTH, EYES_APART = 160, 12.0


def decode_faces(outputs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], scale: float) -> list[dict]:
    """Faces of a detector's outputs, best first: for each stride the class and object scores, boxes (n, 4) and landmarks (n, 10) of its
    grid. `scale` is that of the letterbox; faces come in pixels of the image, overlapping ones once."""
    found = []
    for stride, (cls, obj, boxes, marks) in zip(STRIDES, outputs, strict=True):
        columns = FACE_FRAME // stride
        score = np.sqrt(np.clip(cls, 0, 1) * np.clip(obj, 0, 1))
        wide, tall = np.exp(boxes[:, 2]) * stride, np.exp(boxes[:, 3]) * stride
        for i in np.nonzero((score >= FACE_SCORE) & (wide >= FACE_PIXELS) & (tall >= FACE_PIXELS))[0]:
            at = np.array([i % columns, i // columns], dtype=float)
            centre = (at + boxes[i, :2]) * stride
            points = (at + marks[i].reshape(5, 2)) * stride / scale
            found.append({"score": float(score[i]), "x": float(centre[0] - wide[i] / 2) / scale, "y": float(centre[1] - tall[i] / 2) / scale, "w": float(wide[i]) / scale, "h": float(tall[i]) / scale, "points": points.tolist()})
    kept: list[dict] = []
    for f in sorted(found, key=lambda f: -f["score"]):
        if all(_overlap(f, k) < FACE_OVERLAP for k in kept):
            kept.append(f)
    return kept


def _overlap(a: dict, b: dict) -> float:
    x = max(0.0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
    y = max(0.0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    return x * y / max(1e-9, a["w"] * a["h"] + b["w"] * b["h"] - x * y)


def eye_sharpness(pixels: np.ndarray, face: dict) -> float | None:
    """Variance of the Laplacian around both eyes of a face in RGB pixels, at a fixed width; None where the eyes are too close to tell."""
    (x1, y1), (x2, y2) = face["points"][:2]
    apart = float(np.hypot(x2 - x1, y2 - y1))
    if apart < EYES_APART:
        return None
    left, right = int(max(0, min(x1, x2) - apart / 2)), int(min(pixels.shape[1], max(x1, x2) + apart / 2))
    top, bottom = int(max(0, min(y1, y2) - 0.4 * apart)), int(min(pixels.shape[0], max(y1, y2) + 0.4 * apart))
    if right - left < 8 or bottom - top < 4:
        return None
    part = pixels[top:bottom, left:right].astype(float)
    rows = max(3, round((bottom - top) / (right - left) * EYE_WIDTH))
    ys, xs = np.linspace(0, part.shape[0] - 1, rows), np.linspace(0, part.shape[1] - 1, EYE_WIDTH)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1_, x1_ = np.minimum(y0 + 1, part.shape[0] - 1), np.minimum(x0 + 1, part.shape[1] - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    scaled = (part[y0][:, x0] * (1 - fx) + part[y0][:, x1_] * fx) * (1 - fy) + (part[y1_][:, x0] * (1 - fx) + part[y1_][:, x1_] * fx) * fy
    luma = scaled @ np.array([0.299, 0.587, 0.114])
    lap = luma[:-2, 1:-1] + luma[2:, 1:-1] + luma[1:-1, :-2] + luma[1:-1, 2:] - 4 * luma[1:-1, 1:-1]
    return float(lap.var())


def judge_faces(frames: DataFrame) -> DataFrame:
    """(id, faces, eye_sharpness) of frames (id, width, height, rgb binary, faces: array of structs score, x, y, w, h, points): the eyes of
    the largest face that can be judged. A frame of the wrong length, or without faces, gives null eyes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, w, h, data, faces in zip(b.id, b.width, b.height, b.rgb, b.faces, strict=True):
                faces = [] if faces is None else [{"w": f["w"], "h": f["h"], "points": [list(p) for p in f["points"]]} for f in faces]
                ok = data is not None and len(data) == int(w) * int(h) * 3
                pixels = np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3) if ok else None
                eyes = (eye_sharpness(pixels, f) for f in sorted(faces, key=lambda f: -f["w"] * f["h"])) if ok else ()
                rows.append((i, len(faces), next((e for e in eyes if e is not None), None)))
            yield pd.DataFrame(rows, columns=["id", "faces", "eye_sharpness"])

    return frames.mapInPandas(run, "id bigint, faces int, eye_sharpness double")


def tile_table(sizes: DataFrame, tile: int = 512, overlap: int = 32) -> DataFrame:
    """(id, left, top, width, height) of the tiles that cover images (id, width, height), each overlapping its neighbours; the last ones
    of a row or column are moved back inside, and an image smaller than a tile is one."""
    starts = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - tile) / (tile - overlap))).cast("int")), lambda k: F.greatest(F.lit(0), F.least(k * (tile - overlap), n - tile))))
    spread = sizes.where("width > 0 and height > 0").select("id", "width", "height", F.explode(starts(F.col("width"))).alias("left")).select("*", F.explode(starts(F.col("height"))).alias("top"))
    return spread.select("id", "left", "top", F.least(F.lit(tile), F.col("width")).alias("width"), F.least(F.lit(tile), F.col("height")).alias("height"))


def describe_crop(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Where a square lies and how much of the frame it keeps, in words."""
    third = lambda c, low, high: F.when(c < 0.4, low).when(c > 0.6, high)
    across, down = third(x + w / 2, "left", "right"), third(y + h / 2, "upper", "lower")
    edge = F.when(down == "upper", "the top").when(down == "lower", "the bottom")
    place = F.coalesce(F.concat(F.lit("the "), down, F.lit(" "), across), edge, F.concat(F.lit("the "), across), F.lit("the centre"))
    return F.concat(F.lit("a square from "), place, F.lit(", keeping "), F.bround(w * h * 100).cast("int").cast("string"), F.lit("% of the frame"))


def box_contains(a: dict[str, Column], b: dict[str, Column], eps: float = 1e-6) -> Column:
    return (a["x"] <= b["x"] + eps) & (a["y"] <= b["y"] + eps) & (a["x"] + a["w"] + eps >= b["x"] + b["w"]) & (a["y"] + a["h"] + eps >= b["y"] + b["h"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of box structs (x, y, w, h)."""
    ix = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    iy = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - ix * iy
    return F.when(union > 0, ix * iy / union).otherwise(0.0)


def non_max_suppression(boxes: Column, most: float = 0.3) -> Column:
    """Boxes (array of structs score, x, y, w, h) kept greedily by score, each overlapping those kept by less than `most`."""
    ranked = F.reverse(F.array_sort(boxes))
    return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) >= most), kept).otherwise(F.concat(kept, F.array(b))))


def arrange_faces(boxes: Column) -> Column:
    """Faces at least 0.4 of the tallest, from left to right."""
    tall = F.array_max(F.transform(boxes, lambda b: b["h"]))
    return F.array_sort(F.filter(boxes, lambda b: b["h"] >= tall * 0.4), lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0))


def luma_quality(pixels: np.ndarray) -> tuple[float, float, float, float, float]:
    """(sharpness, sharpness_global, clip_shadows, clip_highlights, mean_luma) of RGB pixels: the variance of the Laplacian of the
    luma, the largest of 4 x 4 tiles and over the whole frame; shares of luma at most 2 and at least 253."""
    luma = pixels[..., 0] * 0.299 + pixels[..., 1] * 0.587 + pixels[..., 2] * 0.114
    lap = luma[:-2, 1:-1] + luma[2:, 1:-1] + luma[1:-1, :-2] + luma[1:-1, 2:] - 4 * luma[1:-1, 1:-1] if min(luma.shape) > 2 else np.zeros((1, 1))
    tiles = [t.var() for row in np.array_split(lap, min(4, lap.shape[0])) for t in np.array_split(row, min(4, lap.shape[1]), axis=1)]
    return float(max(tiles)), float(lap.var()), float((luma <= 2).mean()), float((luma >= 253).mean()), float(luma.mean())


def pixel_quality(frames: DataFrame) -> DataFrame:
    """Quality readings of raw frames (id, width, height, rgb binary); frames of the wrong length give nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["sharpness", "sharpness_global", "clip_shadows", "clip_highlights", "mean_luma"]
        for b in batches:
            rows = []
            for i, w, h, data in zip(b.id, b.width, b.height, b.rgb, strict=True):
                ok = data is not None and w == w and h == h and w and h and len(data) == int(w) * int(h) * 3
                rows.append((i, *(luma_quality(np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3).astype(float)) if ok else (None,) * 5)))
            yield pd.DataFrame(rows, columns=["id", *names])

    return frames.mapInPandas(run, "id bigint, sharpness double, sharpness_global double, clip_shadows double, clip_highlights double, mean_luma double")


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("r", "g", "b", "luma")]))
def histogram(rgb: pd.Series) -> pd.DataFrame:
    """256-bin counts of red, green, blue and BT.709 luma of packed RGB bytes; null stays null."""
    out = []
    for data in rgb:
        p = np.frombuffer(data or b"", np.uint8)[: len(data or b"") // 3 * 3].reshape(-1, 3)
        luma = np.clip(np.round(p @ np.array([0.2126, 0.7152, 0.0722])), 0, 255).astype(int)
        out.append({"r": np.bincount(p[:, 0], minlength=256).tolist(), "g": np.bincount(p[:, 1], minlength=256).tolist(), "b": np.bincount(p[:, 2], minlength=256).tolist(), "luma": np.bincount(luma, minlength=256).tolist()})
    return pd.DataFrame(out)


def tile_weights(size: int, overlap: int) -> np.ndarray:
    """Weights of a tile whose edges fade linearly over the overlap."""
    ramp = np.minimum(1.0, (np.minimum(np.arange(size), np.arange(size)[::-1]) + 1) / (overlap + 1)) if overlap else np.ones(size)
    return ramp[:, None] * ramp[None, :]


def blend_tiles(tiles: DataFrame) -> DataFrame:
    """Pixels (id, x, y, value) of overlapping weighted tile pixels (id, x, y, value, weight): their weighted means."""
    return tiles.groupBy("id", "x", "y").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))
