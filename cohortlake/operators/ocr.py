"""Frames as images, and text regions from a pluggable engine.

An engine is a callable from a grey uint8 image to (text, x, y, w, h, confidence) tuples. It is
made once per Python worker by the factory given, so models load once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .zones import FRAME, frame_shape

Engine = Callable[[np.ndarray], Iterable[tuple[str, float, float, float, float, float]]]
REGIONS = "sop_instance_uid string, frame_index int, text string, x int, y int, w int, h int, confidence double"
# Rescale slope and intercept, window centre and width.
SLOPE, INTERCEPT, CENTRE, WIDTH = "0028,1053", "0028,1052", "0028,1050", "0028,1051"


def split_frames(pixels: np.ndarray) -> list[np.ndarray]:
    """Single images; a last axis of three or four is colour."""
    colour = pixels.ndim >= 3 and pixels.shape[-1] in (3, 4)
    return [pixels] if pixels.ndim - colour == 2 else list(pixels)


def _number(attributes: dict[str, str], tag: str) -> float | None:
    try:
        return float(attributes[tag].split("\\")[0])
    except (KeyError, ValueError, AttributeError):
        return None


def windowed(image: np.ndarray, attributes: dict[str, str]) -> np.ndarray:
    """Rescaled values inside the window; without usable attributes the image as it is."""
    slope, intercept = _number(attributes, SLOPE), _number(attributes, INTERCEPT)
    out = image * (1.0 if slope is None else slope) + (intercept or 0.0) if slope is not None or intercept is not None else image
    centre, width = _number(attributes, CENTRE), _number(attributes, WIDTH)
    if centre is None or not width or width <= 1:
        return out
    return np.clip(out, centre - 0.5 - (width - 1) / 2, centre - 0.5 + (width - 1) / 2)


def grey(image: np.ndarray) -> np.ndarray:
    """uint8 from the least to the largest value; colour is averaged."""
    image = image[..., :3].mean(axis=-1) if image.ndim == 3 else image.astype(np.float64)
    low, high = float(image.min(initial=np.inf)), float(image.max(initial=-np.inf))
    return ((image - low) / (high - low) * 255).astype(np.uint8) if high > low else np.zeros(image.shape, np.uint8)


def text_regions(frames: DataFrame, instances: DataFrame, factory: Callable[[], Engine]) -> DataFrame:
    """Regions with text and confidence above zero, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = factory()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                shape, kind = frame_shape(row)
                pixels = np.frombuffer(row["pixels"], kind, int(np.prod(shape))).reshape(shape)
                for k, image in enumerate(split_frames(pixels)):
                    for text, x, y, w, h, confidence in engine(grey(windowed(image, dict(row["attributes"] or ())))):
                        if text.strip() and confidence > 0:
                            rows.append((row["sop_instance_uid"], k, text, int(x), int(y), int(w), int(h), float(confidence)))
            kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in REGIONS.split(", ")])

    tags = F.map_filter("attributes", lambda k, v: k.isin(SLOPE, INTERCEPT, CENTRE, WIDTH))
    return frames.select("sop_instance_uid", *FRAME).join(instances.select("sop_instance_uid", tags.alias("attributes")), "sop_instance_uid").mapInArrow(run, REGIONS)


def joined_text(regions: DataFrame) -> DataFrame:
    """(sop_instance_uid, text): each instance's texts in reading order."""
    return regions.groupBy("sop_instance_uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "y", "x", "text"))), lambda r: r.text), " ").alias("text"))
