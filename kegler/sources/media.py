"""Media at the edge: frames, clips and downloads behind callables that the caller injects.

The engine works on tables. What reads or writes video, images or the network is handed in, and a
missing tool is an error that names it.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kegler.config import DEFAULT_FPS, check_path
from kegler.schemas import FRAMES


def need_tool(name: str) -> str:
    found = shutil.which(name)
    if found is None:
        raise RuntimeError(f"{name} is needed and not on the PATH")
    return found


def run_tool(command: list[str], what: str, tail: int = 50, show: Callable[[str], None] = print) -> None:
    """Run a tool, show its lines as they come; on failure quote the last ones."""
    last: deque[str] = deque(maxlen=tail)
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True) as process:
        for line in process.stdout:
            last.append(line.rstrip())
            show(last[-1])
    if process.returncode:
        raise RuntimeError(f"{what} failed with {process.returncode}:\n" + "\n".join(last))


_MODELS: dict[str, object] = {}


def once_per_worker(load: Callable[[], object]) -> Callable[[], object]:
    """A getter of what ``load`` makes, which is kept for as long as the worker lives: models are loaded once, not once a task."""
    import pickle

    from pyspark import cloudpickle

    name = str(hash(cloudpickle.dumps(load, protocol=pickle.HIGHEST_PROTOCOL)))

    def get() -> object:
        if name not in _MODELS:
            _MODELS[name] = load()
        return _MODELS[name]

    return get


def download_once(address: str, folder: str, describe: Callable[[str], tuple[str, str]], fetch: Callable[[str, str], None]) -> str:
    """The file of an address in a cache folder, named by its id and extension, which ``describe`` tells. What is there is
    never written over; ``fetch`` writes to a name of its own first, so that what breaks off leaves nothing."""
    target = Path(folder) / "{}.{}".format(*describe(address))
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(f".{target.name}.{os.getpid()}.part")
        try:
            fetch(address, str(part))
            if not part.exists():
                raise RuntimeError(f"the downloader wrote no file for {address!r}")
            part.replace(target)
        finally:
            part.unlink(missing_ok=True)
    return str(target.resolve())


def resolve(source: str, download: Callable[[str], str] | None = None) -> str:
    """The absolute path of an existing file; anything else is an address, which ``download`` fetches.

    What ``download`` returns may have more lines; the last is the path.
    """
    if Path(source).is_file():
        return str(Path(source).resolve())
    if download is None:
        raise RuntimeError(f"{source!r} is no file, and there is no downloader")
    lines = download(source).splitlines()
    if not lines:
        raise RuntimeError(f"the downloader gave no path for {source!r}")
    return lines[-1].strip()


def videos(rows: DataFrame) -> DataFrame:
    """Frame rates that are missing or 0 become the usual one."""
    return rows.withColumn("fps", F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(DEFAULT_FPS)))


def with_frame_counts(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Videos with ``n_frames``: what the container says, or else the frames that were decoded."""
    counted = frames.groupBy("video_id").agg(F.count("*").alias("_n"))
    said = F.nullif("n_frames", F.lit(0)) if "n_frames" in rows.columns else F.lit(None).cast("long")
    return rows.join(counted, "video_id", "left").withColumn("n_frames", F.coalesce(said, "_n", F.lit(0)).cast("long")).drop("_n")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Decoded frames: partition and row-group pruning serve point and range reads."""
    return spark.read.schema(FRAMES).parquet(path)


def frame_range(frames: DataFrame, start: int, end: int) -> DataFrame:
    """Frames start to end - 1; the filter reaches the scan."""
    return frames.where((F.col("frame_index") >= start) & (F.col("frame_index") < end))


#: Decoded frames that are handed on together.
FRAMES_AT_ONCE = 16


def decode(files: DataFrame, decoder: Callable[[bytes], Iterator[tuple[int, int, int, bytes]]]) -> DataFrame:
    """Frames of binary files (path, content) by a decoder that yields (frame_index, width, height, pixels)."""
    columns = ["video_id", "frame_index", "width", "height", "pixels"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                frames = iter(decoder(content))
                while some := [(Path(path).stem, *row) for row in islice(frames, FRAMES_AT_ONCE)]:
                    yield pd.DataFrame(some, columns=columns)

    return files.select("path", "content").mapInPandas(run, FRAMES)


def read_images(spark: SparkSession, path: str, pattern: str = "*", decoder: Callable[[bytes], tuple[int, int, bytes] | None] | None = None) -> DataFrame:
    """path, content of files, or with a ``decoder`` path, width, height, pixels. A path that isn't there, or an
    image that the decoder can't read (it gives None), is an error that names it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(check_path(path)).select("path", "content")
    if decoder is None:
        return files

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = decoder(content)
                if found is None:
                    raise FileNotFoundError(f"no image can be read from {name}")
                rows.append((name, *found))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "pixels"])

    return files.mapInPandas(run, "path string, width int, height int, pixels binary")


def list_clips(spark: SparkSession, path: str, pattern: str = "shot_*.mp4") -> DataFrame:
    """video_id ('' for a folder), file_name of clips in order of their names; none is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
    if found.isEmpty():
        raise RuntimeError(f"no clips like {pattern} in {path}")
    return found.select(F.lit("").alias("video_id"), "file_name").orderBy("file_name")


def ensure_copy(target: str, exists: Callable[[str], bool], make: Callable[[str], None], source: str, factor: float) -> str:
    """The detection copy: the source itself from a factor of 1 on, else made once and kept."""
    if factor >= 1.0:
        return source
    if not exists(target):
        make(target)
    return target


def export_clips(clips: DataFrame, cut: Callable[[dict], None]) -> int:
    """Cut every clip of a manifest by ``cut``, on the executors; returns how many."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                cut(row)
            yield pd.DataFrame({"n": [len(batch)]})

    return clips.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# How clips are encoded anew.
VIDEO_CODEC, SPEED, QUALITY, AUDIO_CODEC, AUDIO_RATE = "libx264", "fast", "20", "aac", "128k"


def encode_options() -> list[str]:
    video = ["-c:v", VIDEO_CODEC, "-preset", SPEED, "-crf", QUALITY]
    return [*video, "-c:a", AUDIO_CODEC, "-b:a", AUDIO_RATE]


def quiet(tool: str) -> list[str]:
    """The tool, telling errors and progress only, and writing over what is there."""
    return [tool, "-loglevel", "error", "-stats", "-y"]


def cut_command(tool: str, video: str, start_text: str, duration_text: str, out: str) -> list[str]:
    """One clip. Seeking comes after the input and the clip is encoded anew, so that it may begin at any frame."""
    span = ["-ss", start_text, "-t", duration_text]
    return [*quiet(tool), "-i", video, *span, *encode_options(), out]


def join_command(tool: str, list_file: str, out: str, reencode: bool = False) -> list[str]:
    """Clips of a list file as one: their streams as they are, or encoded anew where their codecs differ."""
    how = encode_options() if reencode else ["-c", "copy"]
    return [*quiet(tool), "-f", "concat", "-safe", "0", "-i", list_file, *how, out]


def list_line(path: str) -> str:
    """The line of a clip in the list; ``manifest.concat_line`` for the driver."""
    slashed = path.replace("\\", "/")
    return "file '" + slashed.replace("'", "\\'") + "'"


def merge_clips(folder: str, out: str, pattern: str = "shot_*.mp4", reencode: bool = False, tool: str = "ffmpeg", run: Callable[[list[str], str], None] = run_tool) -> int:
    """Join the clips of a folder in order of their names; returns how many. No clip is an error; the list
    file goes whatever happens. Joining is one tool's work on one file, so it is the driver's."""
    clips = sorted(Path(folder).glob(pattern))
    if not clips:
        raise RuntimeError(f"no clips like {pattern} in {folder}")
    command = need_tool(tool)
    handle, list_file = tempfile.mkstemp(suffix=".txt", text=True)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.writelines(list_line(str(c.resolve())) + "\n" for c in clips)
        Path(out).parent.mkdir(parents=True, exist_ok=True)
        run(join_command(command, list_file, out, reencode), f"joining clips to {out}")
    finally:
        Path(list_file).unlink(missing_ok=True)
    return len(clips)
