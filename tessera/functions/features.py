"""Integer feature vectors from rendered faces, vectorised over rows.

A panorama's six faces of 16 x 16 pixels are drawn from the first eight bytes of its job id by a 64-bit xorshift; the
scene vector has 16 entries per face (four quadrants: sums of the channels and of horizontal changes), the object vector
8 per region of the front face. Rows are processed together in unsigned 64-bit numpy arithmetic, which wraps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.constants import FACE, FACES
from tessera.functions.text import palette


def seeds_of(keys: list[str]) -> np.ndarray:
    digests = b"".join(hashlib.sha256(k.encode()).digest()[:8] for k in keys)
    state = np.frombuffer(digests, dtype="<u8").copy()
    state[state == 0] = 1
    return state


def render_faces(keys: list[str], faces: int = FACES) -> np.ndarray:
    """n x faces x 16 x 16 x 3 bytes for job keys (asset, capture, lane and model, one per line); faces are drawn in order."""
    state, u = seeds_of(keys), np.uint64
    out = np.empty((len(keys), faces, FACE, FACE, 3), dtype=np.uint8)
    y, x = (np.arange(FACE * FACE, dtype=np.int64) // FACE)[:, None], (np.arange(FACE * FACE, dtype=np.int64) % FACE)[:, None]
    plus = [(v % 256).astype(np.uint8) for v in (13 * x + (x - 7) ** 2 + (y - 7) ** 2, 17 * y, x * y)]
    low, moved = np.empty((FACE * FACE, len(keys)), dtype="<u4"), np.empty_like(state)
    for f in range(faces):
        bias = (state >> u(f)).astype(np.uint8)
        for pixel in range(FACE * FACE):
            for shift, by in ((np.left_shift, u(13)), (np.right_shift, u(7)), (np.left_shift, u(17))):
                shift(state, by, out=moved)
                np.bitwise_xor(state, moved, out=state)
            low[pixel] = state  # bytes are all that colours need, and their sums wrap
        colour = low.view(np.uint8).reshape(FACE * FACE, len(keys), 4)
        for c, add in enumerate((bias, np.uint8(41 * f % 256), np.uint8(3) * bias)):
            out[:, f, :, :, c] = (colour[:, :, c] + add + plus[c]).T.reshape(len(keys), FACE, FACE)
    return out


def scene_vectors(faces: np.ndarray) -> np.ndarray:
    """n x 96 signed bytes."""
    n = len(faces)
    q = faces.astype(np.int32).reshape(n, FACES, 2, 8, 2, 8, 3).transpose(0, 1, 2, 4, 3, 5, 6)
    channels = q.sum(axis=(4, 5)) // 64 - 128
    change = np.abs(np.diff(q[..., 0], axis=5)).sum(axis=(4, 5)) // 56 - 128
    return np.clip(np.concatenate([channels, change[..., None]], axis=-1), -127, 127).astype(np.int8).reshape(n, 96)


def object_vectors(faces: np.ndarray) -> np.ndarray:
    """n x 128 signed bytes, from the front face."""
    n = len(faces)
    c = faces[:, 0].astype(np.int32).reshape(n, 4, 4, 4, 4, 3).transpose(0, 1, 3, 2, 4, 5)
    channels = c.sum(axis=(3, 4)) // 16 - 128
    gray = c.sum(axis=5) // 3
    low, high = gray.min(axis=(3, 4)), gray.max(axis=(3, 4))
    across = np.abs(np.diff(c[..., 0], axis=4)).sum(axis=(3, 4)) // 12 - 128
    down = np.abs(np.diff(c[..., 0], axis=3)).sum(axis=(3, 4)) // 12 - 128
    place = np.broadcast_to((np.arange(4)[None, :] + 4 * np.arange(4)[:, None]) * 8 - 60, (n, 4, 4))
    parts = [channels, ((low + high) * 8 // 16 - 128)[..., None], (high - low - 128)[..., None], across[..., None], down[..., None], place[..., None]]
    return np.clip(np.concatenate(parts, axis=-1), -127, 127).astype(np.int8).reshape(n, 128)


def box_reduced(image: np.ndarray, size: int = FACE) -> np.ndarray:
    """An image (height x width x 3) as size x size whole-number means of its boxes."""
    rows = np.arange(size + 1) * image.shape[0] // size
    columns = np.arange(size + 1) * image.shape[1] // size
    sums = np.add.reduceat(np.add.reduceat(image.astype(np.int64), rows[:-1], axis=0), columns[:-1], axis=1)  # an empty box takes the pixel at its start
    sizes = np.maximum(1, np.diff(rows))[:, None] * np.maximum(1, np.diff(columns))[None, :]
    return (sums // sizes[..., None]).astype(np.uint8)


def tinted(faces: np.ndarray, colour: tuple[int, int, int], strength: int, shift: int) -> np.ndarray:
    """Faces drawn towards a colour by strength per cent, then lighter or darker by shift."""
    mixed = faces.astype(np.int32) * (100 - strength) + np.array(colour) * strength
    return np.clip(mixed // 100 + shift, 0, 255).astype(np.uint8)


def description_vector(spark: SparkSession, prompt: str, lane: str, model: str) -> bytes:
    """The vector of one stated prompt, tinted as palette() says."""
    tint = spark.range(1).select(palette(F.lit(prompt)).alias("p")).first().p
    faces = tinted(render_faces([f"description:{prompt}\nprompt\n{lane}\n{model}"]), (tint.red, tint.green, tint.blue), tint.strength, tint["shift"])
    return (object_vectors if lane == "object" else scene_vectors)(faces)[0].tobytes()


@F.pandas_udf(T.BinaryType())
def faces_of(key: pd.Series) -> pd.Series:
    return pd.Series([x.tobytes() for x in render_faces(key.tolist())])


@F.pandas_udf(T.BinaryType())
def vector_of(key: pd.Series, lane: pd.Series) -> pd.Series:
    """The vector of a job key, by its lane; faces stay within the task."""
    out = np.full(len(key), b"", dtype=object)
    for name, make, faces in (("scene", scene_vectors, FACES), ("object", object_vectors, 1)):
        at = np.flatnonzero((lane == name).to_numpy())
        for i in range(0, len(at), 2048):
            rows = at[i : i + 2048]
            vectors = make(render_faces(key.iloc[rows].tolist(), faces))
            out[rows] = np.array([v.tobytes() for v in vectors], dtype=object)
    return pd.Series(out)
