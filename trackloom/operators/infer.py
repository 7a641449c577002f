"""Detector inference over frames: a session in each task, candidates as rows. The model is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.boxes import downscale
from trackloom.operators.detect import tile_grid
from trackloom.operators.pixels import bilinear

CANDIDATE = (
    "video_id long, frame long, det_id long, cx double, cy double, w double, h double, scores array<double>, pad_x double, pad_y double, scale_x double, "
    "scale_y double, tile_width double, tile_height double, offset_x double, offset_y double, frame_width double, frame_height double"
)


def prepare(image: np.ndarray, size: int) -> tuple[np.ndarray, float, float]:
    """A square float image, channels first, scaled to fit and padded right and below; and its scales."""
    h, w = image.shape[:2]
    r = min(size / w, size / h)
    nw, nh = round(w * r), round(h * r)
    out = np.full((size, size, 3), 114, float)
    out[:nh, :nw] = np.stack([bilinear(image[:, :, c], nh, nw) for c in range(3)], axis=2) if (nh, nw) != (h, w) else image
    return np.moveaxis(out, 2, 0).astype(np.float32) / 255, nw / w, nh / h


def area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Shrink: a pixel is the mean of the area that it covers."""
    out = image.astype(float)
    for axis, n in ((0, height), (1, width)):
        size = out.shape[axis]
        edge = np.arange(n + 1) * (size / n)
        whole = np.minimum(edge.astype(int), size - 1)
        share = (edge - whole).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        upto = np.take(np.cumsum(out, axis=axis) - out, whole, axis=axis) + np.take(out, whole, axis=axis) * share
        out = np.diff(upto, axis=axis) * (n / size)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


#: Where a model runs, the first that there is. Fixed values.
PROVIDERS = (
    "CUDAExecutionProvider",
    "CoreMLExecutionProvider",
    "MPSExecutionProvider",
    "MLComputeExecutionProvider",
    "DmlExecutionProvider",
    "TensorrtExecutionProvider",
    "OpenVINOExecutionProvider",
    "QNNExecutionProvider",
    "CPUExecutionProvider",
)


def provider(available: list[str]) -> str:
    """The best provider that is available; the last one if none of them is."""
    return next((p for p in PROVIDERS if p in available), PROVIDERS[-1])


def onnx_session(model: bytes, providers: list | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """Runs a model file's bytes, where ``providers`` says or at the best one there is; its first output holds, for each
    image, rows of centre, size and class scores."""
    import onnxruntime

    session = onnxruntime.InferenceSession(model, providers=providers or [provider(onnxruntime.get_available_providers())])
    name = session.get_inputs()[0].name
    return lambda images: session.run(None, {name: images})[0]


def _found(session: Callable, images: list[np.ndarray], places: list[dict], size: int, least: float) -> list[tuple]:
    """Candidates of tiles, by a row of ``video_id, frame, tile_id``, offsets and sizes each."""
    ready, out = [prepare(image, size) for image in images], []
    for r, (_, sx, sy), raw in zip(places, ready, session(np.stack([p[0] for p in ready])), strict=True):
        for k in np.flatnonzero(raw[4:].max(axis=0) >= least):
            cx, cy, w, h = raw[:4, k].tolist()
            ident = r["tile_id"] * raw.shape[1] + int(k)
            out.append((r["video_id"], r["frame"], ident, cx, cy, w, h, raw[4:, k].tolist(), 0.0, 0.0, sx, sy, r["tile_width"], r["tile_height"], r["offset_x"], r["offset_y"], r["width"], r["height"]))
    return out


def _batch(out: list[tuple]):
    import pyarrow as pa

    names = [c.strip().split(" ")[0] for c in CANDIDATE.split(",")]
    kinds = [pa.int64()] * 3 + [pa.float64()] * 4 + [pa.list_(pa.float64())] + [pa.float64()] * 10
    cols = list(zip(*out, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def candidates(tiles: DataFrame, open_session: Callable[[], Callable], size: int, batch_size: int = 4, least: float = 0.1) -> DataFrame:
    """Raw candidates of frames cut by ``detect.tiles`` (frame columns, ``pixels`` of the whole frame, tile columns).

    ``open_session()`` runs once in a task. Candidates under ``least`` in every class are left out.
    """

    def run(batches: Iterator) -> Iterator:
        session = open_session()
        for batch in batches:
            rows, out = batch.to_pylist(), []
            for i in range(0, len(rows), batch_size):
                part, images = rows[i : i + batch_size], []
                for r in part:
                    image = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3)
                    images.append(image[r["offset_y"] : r["offset_y"] + r["tile_height"], r["offset_x"] : r["offset_x"] + r["tile_width"]])
                out += _found(session, images, part, size, least)
            yield _batch(out)

    return tiles.mapInArrow(run, CANDIDATE)


def tiled_candidates(
    frames: DataFrame, open_session: Callable[[], Callable], size: int, tile: int = 640, overlap: float = 0.2, inference_size: int | None = None, batch_size: int = 4, least: float = 0.1
) -> DataFrame:
    """Raw candidates of frames ``video_id, frame, width, height, pixels`` in tiles, which are cut in the task: a frame goes
    to Python once, however many tiles it has.

    A frame whose longer edge is over ``inference_size`` is shrunk to it before; its candidates are in pixels of the
    smaller one, under ``frame_width`` and ``frame_height`` of that, so ``detect.decode`` gives the shares of the frame.
    Rows are those of :func:`candidates` over ``detect.tiles``. Null or short pixels give none.
    """
    fit = downscale("width", "height", inference_size) if inference_size else {"new_width": F.col("width"), "new_height": F.col("height")}
    sized = frames.select("video_id", "frame", "width", "height", "pixels", fit["new_width"].alias("nw"), fit["new_height"].alias("nh"))
    source = sized.where("width > 0 AND height > 0 AND length(pixels) >= width * height * 3").withColumn("tiles", tile_grid(F.col("nw"), F.col("nh"), tile, overlap))

    def run(batches: Iterator) -> Iterator:
        session = open_session()
        for batch in batches:
            for r in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                image = np.frombuffer(r["pixels"], np.uint8, r["width"] * r["height"] * 3).reshape(r["height"], r["width"], 3)
                w, h = r["nw"], r["nh"]
                image = image if (h, w) == image.shape[:2] else area(image, h, w)
                base = {"video_id": r["video_id"], "frame": r["frame"], "width": w, "height": h, "tile_width": min(tile, w), "tile_height": min(tile, h)}
                places, out = [base | t | {"tile_id": k} for k, t in enumerate(r["tiles"])], []
                for i in range(0, len(places), batch_size):
                    part = places[i : i + batch_size]
                    images = [image[p["offset_y"] : p["offset_y"] + p["tile_height"], p["offset_x"] : p["offset_x"] + p["tile_width"]] for p in part]
                    out += _found(session, images, part, size, least)
                yield _batch(out)

    return source.mapInArrow(run, CANDIDATE)
