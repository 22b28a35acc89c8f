"""Image steps that need no imaging library. Decoding, rendering and recognition are pluggable callables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def gray(image: np.ndarray) -> np.ndarray:
    """Height x width from height x width x 3 (red, green, blue); others as they are."""
    return image if image.ndim == 2 else np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(image.dtype)


def crop_border(image: np.ndarray, share: float = 0.02) -> np.ndarray:
    """The image without a border of that share of either side."""
    h, w = image.shape[:2]
    dy, dx = int(h * share), int(w * share)
    return image[dy : h - dy, dx : w - dx]


def scaled_to_unit(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float32) / 255.0


def pad_batch(images: list[np.ndarray], multiple: int = 4, fill: float = 1.0) -> np.ndarray:
    """Images of one height, padded on the right to the widest, up to a multiple."""
    width = max(i.shape[1] for i in images)
    width = -(-width // multiple) * multiple
    return np.stack([np.pad(i, ((0, 0), (0, width - i.shape[1])), constant_values=fill) for i in images])


def recognize(lines: DataFrame, load: Callable[[], Callable[[list[bytes]], list[tuple[str, float]]]], batch: int = 16) -> DataFrame:
    """path, text, confidence of line images (path, image) by any recogniser; `load` runs once a worker. Blank texts stay: ocr.recognised_blocks numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            paths, images = b.column(0).to_pylist(), b.column(1).to_pylist()
            got = [r for i in range(0, len(images), batch) for r in model(images[i : i + batch])]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([t for t, _ in got], pa.string()), pa.array([c for _, c in got], pa.float64())], ["path", "text", "confidence"])

    return lines.select("path", "image").mapInArrow(run, "path string, text string, confidence double")
