"""Evaluation of images from their files: measures, likeness to a reference, constraints of the prompt, category scores.

A file is one row with its bytes; it is decoded and measured in one pass over Arrow batches, a row at a time, so that memory
holds one image. A file that can't be decoded has an error and nothing else.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import image_constraints as C
from ..functions import image_measures as M


def measures(x: np.ndarray) -> dict[str, dict]:
    g = M.gray(x)
    return {
        "resolution": M.resolution(x),
        "color_histogram": M.histogram(x),
        "brightness_contrast_saturation": M.light(x),
        "edge_density": M.detail(g),
        "sharpness": M.sharpness(g),
        "composition": M.composition(g),
        "color_palette": M.palette(x),
        "perceptual_hash": M.hashes(x),
        "noise": M.noise(g),
    }


def categories(found: dict[str, dict], adherence: float, likeness: float | None) -> dict[str, float | None]:
    """Category scores from the measures as rounded, and overall, their plain mean."""
    mean = lambda *x: round(float(np.mean(x)), 1)
    light = found["brightness_contrast_saturation"]
    out = {
        "technical_quality": mean(found["resolution"]["resolution_score"], found["sharpness"]["sharpness_score"], found["noise"]["noise_score"]),
        "color_tone": mean(light["brightness_score"], light["contrast_score"], light["saturation_score"], found["color_histogram"]["color_diversity_score"], found["color_palette"]["color_harmony_score"]),
        "detail_texture": mean(found["edge_density"]["detail_score"], found["sharpness"]["sharpness_score"]),
        "composition": found["composition"]["composition_score"],
        "constraint_adherence": adherence,
        "reference_similarity": likeness,
    }
    return out | {"overall": mean(*[v for v in out.values() if v is not None])}


def png(x: np.ndarray) -> bytes:
    """An image as a PNG file, each line without a filter."""
    h, w = x.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), x.reshape(h, -1).astype(np.uint8)], axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def thumbnail(x: np.ndarray, most: int = 200) -> bytes:
    """A smaller PNG file whose sides are at most `most`."""
    scale = min(1.0, most / max(x.shape[:2]))
    return png(M.fitted(x, max(1, round(x.shape[0] * scale)), max(1, round(x.shape[1] * scale))))


_KINDS = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
_COLOUR = T.StructType([T.StructField("hex", T.StringType()), T.StructField("name", T.StringType()), T.StructField("percentage", T.DoubleType())])


def _struct(sample: dict) -> T.StructType:
    return T.StructType([T.StructField(k, T.ArrayType(_COLOUR) if isinstance(v, list) else _KINDS.get(type(v), T.DoubleType())) for k, v in sample.items()])


_IMAGE = (np.arange(16 * 16 * 3) % 251).astype(np.uint8).reshape(16, 16, 3)
_FOUND = measures(_IMAGE)
OUTPUT = T.StructType(
    [T.StructField(k, _struct(v)) for k, v in _FOUND.items()]
    + [
        T.StructField("reference_comparison", _struct(M.likeness(_IMAGE, _IMAGE[::-1]))),
        T.StructField("constraint_adherence", _struct(C.check(_IMAGE, C.parse(""), _FOUND))),
        T.StructField("category_scores", _struct(categories(_FOUND, 50.0, 50.0))),
        T.StructField("thumbnail", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


def evaluate_one(content: bytes | None, prompt: str, reference: bytes | None) -> dict:
    try:
        x = M.decode(content or b"")
        y = M.decode(reference) if reference else None
    except (ValueError, KeyError, struct.error, zlib.error, UnboundLocalError) as e:
        return {"error": f"can't be decoded: {e}"}
    found = measures(x)
    kept = C.check(x, C.parse(prompt), found)
    alike = M.likeness(x, y) if y is not None else None
    scores = categories(found, kept["overall_constraint_score"], alike["reference_similarity_score"] if alike else None)
    return found | {"constraint_adherence": kept, "reference_comparison": alike, "category_scores": scores, "thumbnail": thumbnail(x)}


def evaluate(rows: DataFrame, keys: Iterable[str], content: str = "content", prompt: str | None = None, reference: str | None = None) -> DataFrame:
    """keys and OUTPUT for every row: every family of measures as a struct, category scores, a thumbnail, or an error."""
    keys = list(keys)
    text = F.coalesce(F.col(prompt), F.lit("")) if prompt else F.lit("")
    other = F.col(reference) if reference else F.lit(None).cast("binary")
    picked = rows.select(*keys, F.col(content).alias("_x"), text.alias("_p"), other.alias("_r"))
    kinds = {f.name: to_arrow_type(f.dataType) for f in OUTPUT.fields}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x, p, r = (c.to_pylist()[0] for c in row.columns[len(keys) :])
                found = evaluate_one(x, p, r)
                made = [pa.array([found.get(k)], t) for k, t in kinds.items()]
                yield pa.RecordBatch.from_arrays([*row.columns[: len(keys)], *made], names=[*keys, *kinds])

    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[: len(keys)], *OUTPUT.fields]))


def paired(files: DataFrame, prompts: DataFrame, name: str = "name") -> DataFrame:
    """Image files with their prompts (and reference files) by name: a join on it, instead of the place in a list."""
    return files.join(prompts, name)
