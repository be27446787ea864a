"""Crop and pad geometry of images, and optional decoding."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crop_size(size: Column, fraction: float) -> Column:
    return F.greatest(F.floor(size * fraction), F.lit(1)).cast("int")


def centre_offset(size: Column, crop: Column) -> Column:
    return F.floor((size - crop) / 2).cast("int")


def pad_split(n: Column) -> tuple[Column, Column]:
    """n // 2 before and the rest after."""
    half = F.floor(n / 2).cast("int")
    return half, (n - half).cast("int")


def letterbox(height: Column, width: Column) -> tuple[Column, Column, Column, Column]:
    """top, bottom, left, right padding that makes an image square."""
    side = F.greatest(height, width)
    return (*pad_split(side - height), *pad_split(side - width))


def random_offset(size: Column, crop: Column, *key: Column, seed: int = 0) -> Column:
    """A crop offset drawn by hash, the same for all views that share a key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), size - crop + 1).cast("int")


def decoded_masks(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) of npy or npz masks to path, frame, height, width, mask (bytes)."""
    import io

    import numpy as np

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                if not isinstance(got, np.ndarray):
                    if "arr_0" not in got.files and len(got.files) != 1:
                        raise ValueError(f"{path} holds several arrays")
                    got = got["arr_0" if "arr_0" in got.files else got.files[0]]
                got = got[None] if got.ndim == 2 else got
                n, h, w = got.shape
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(n), pa.int32()), pa.array([h] * n, pa.int32()), pa.array([w] * n, pa.int32()), pa.array([np.ascontiguousarray(x, np.uint8).tobytes() for x in got], pa.binary())], names=["path", "frame", "height", "width", "mask"])

    return files.select("path", "content").mapInArrow(run, "path string, frame int, height int, width int, mask binary")


#: Codecs that need a software decoder, and decoders in the order in which they are tried.
SOFTWARE_ONLY = frozenset({"av1"})
DECODERS = ("torchcodec", "decord", "av")


def chosen_decoder(codec: str | None, wanted: str | None = None, present: Callable[[str], bool] | None = None) -> str:
    """The decoder asked for, or the first that is installed; codecs that need software decoding go to av."""
    from importlib.util import find_spec

    there = present or (lambda name: find_spec(name) is not None)
    if wanted is not None:
        if wanted not in DECODERS or not there(wanted):
            raise ValueError(f"decoder {wanted} is unknown or not installed")
        return wanted
    for name in (("av",) if codec in SOFTWARE_ONLY else DECODERS):
        if there(name):
            return name
    raise ValueError("no video decoder is installed")


def frame_rate(fraction: str) -> float:
    """15/1 or 29.97 as a number."""
    top, _, bottom = fraction.partition("/")
    return float(top) / float(bottom or 1)


def stream_info(stream: dict) -> dict:
    """fps, frames, duration and codec of a probed stream; frames are estimated where the container doesn't say."""
    fps, seconds, n = frame_rate(stream["r_frame_rate"]), float(stream.get("duration") or 0), int(stream.get("nb_frames") or 0)
    return {"fps": fps, "frames": n or int(seconds * fps), "duration": seconds, "codec": stream.get("codec_name") or None}


def video_info(files: DataFrame) -> DataFrame:
    """path, fps, frames, duration, codec of binaryFile rows; needs PyAV, opened on use."""

    def run(batches):
        import io

        import av

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with av.open(io.BytesIO(content)) as video:
                    s = video.streams.video[0]
                    own = stream_info({"r_frame_rate": str(s.average_rate), "nb_frames": s.frames, "duration": float(s.duration * s.time_base) if s.duration else 0, "codec_name": s.codec_context.name})
                rows.append((path, own["fps"], own["frames"], own["duration"], own["codec"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.string()), strict=True)], names=["path", "fps", "frames", "duration", "codec"])

    return files.select("path", "content").mapInArrow(run, "path string, fps double, frames long, duration double, codec string")


def _images(path: str, content: bytes, wanted: set[int] | None):
    """(frame, seconds, RGB image) of a video, decoded in order; all frames, or those wanted."""
    import io

    import av

    last = max(wanted) if wanted else None
    with av.open(io.BytesIO(content)) as video:
        for i, image in enumerate(video.decode(video=0)):
            if wanted is None or i in wanted:
                yield i, float(image.time or 0), image.to_ndarray(format="rgb24")
            if last is not None and i >= last:
                return


_FRAMES = "path string, frame long, t double, height int, width int, image binary"


def _frame_batch(path: str, i: int, t: float, image) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([i], pa.int64()), pa.array([t]), pa.array([image.shape[0]], pa.int32()), pa.array([image.shape[1]], pa.int32()), pa.array([image.tobytes()], pa.binary())], names=["path", "frame", "t", "height", "width", "image"])


def all_frames(files: DataFrame) -> DataFrame:
    """Every frame of videos with its time; one frame at a time is held."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, t, image in _images(path, content.as_py(), None):
                    yield _frame_batch(path, i, t, image)

    return files.select("path", "content").mapInArrow(run, _FRAMES)


def decoded_frames(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """binaryFile rows of videos and wanted (path, frame) to path, frame, t, height, width, image (RGB bytes); needs PyAV,
    opened on use.  A frame that a video doesn't have is an error, never a black one."""

    def run(batches):
        for batch in batches:
            for path, content, frames in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                need = set(frames)
                for i, t, image in _images(path, content.as_py(), set(frames)):
                    need.discard(i)
                    yield _frame_batch(path, i, t, image)
                if need:
                    raise ValueError(f"{path} has no frames {sorted(need)[:5]}")

    listed = wanted.groupBy("path").agg(F.sort_array(F.collect_set("frame")).alias("frames"))
    return files.select("path", "content").join(listed, "path").mapInArrow(run, _FRAMES)


def recorded_size(height: Column, width: Column, common: int) -> tuple[Column, Column]:
    """Height and width of a recorded view: scaled to a common height, both even."""
    even = lambda x: (F.floor(x / 2) * 2).cast("int")
    return even(F.lit(common)), even(F.round(width * common / height))
