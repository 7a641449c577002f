"""Uncompressed video as a data source: byte ranges of files are its partitions, and frames are read by their places.

A frame's bytes have a fixed length, so where one starts follows from its number: a long video spreads over tasks, and
one frame that is asked for is one range. Files are opened in the tasks, local ones or those of a store that pyarrow knows.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

FRAME = "video_id long, frame long, pts double, width int, height int, pixels binary"
MARK = b"FRAME\n"


@dataclass(frozen=True)
class Layout:
    """What a stream's first line says: picture size, rate, where frames start and how many bytes the planes have."""

    width: int
    height: int
    rate: tuple[int, int]
    full: bool
    first: int

    @property
    def chroma(self) -> tuple[int, int]:
        return (self.height, self.width) if self.full else (-(-self.height // 2), -(-self.width // 2))

    @property
    def planes(self) -> int:
        return self.width * self.height + 2 * self.chroma[0] * self.chroma[1]

    def pts(self, n: int) -> float:
        return n * self.rate[1] / self.rate[0]

    def frames(self, size: int) -> int | None:
        """Frames in a file of so many bytes; None where some have parameters, or the last one isn't whole."""
        count, rest = divmod(size - self.first, len(MARK) + self.planes)
        return None if rest else count

    def rgb(self, raw: np.ndarray) -> bytes:
        h, w, (ch, cw) = self.height, self.width, self.chroma
        y, u, v = raw[: w * h].reshape(h, w), raw[w * h : w * h + cw * ch].reshape(ch, cw), raw[w * h + cw * ch :].reshape(ch, cw)
        if not self.full:
            u, v = (p.repeat(2, axis=0).repeat(2, axis=1)[:h, :w] for p in (u, v))
        return _to_rgb(y, u, v).tobytes()


def layout(data: bytes) -> Layout:
    """Of the bytes at the start of a YUV4MPEG2 stream, 4:2:0 or 4:4:4."""
    end = data.find(b"\n")
    head = data[: max(end, 0)].decode("ascii", "replace").split(" ")
    if head[0] != "YUV4MPEG2":
        raise ValueError("not a YUV4MPEG2 stream")
    said = {p[0]: p[1:] for p in head[1:] if p}
    rate, base = (int(x) for x in said.get("F", "25:1").split(":"))
    return Layout(int(said["W"]), int(said["H"]), (rate, base), said.get("C", "420").startswith("444"), end + 1)


def _to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    y, u, v = (p.astype(float) for p in (y, u, v))
    y, u, v = (y - 16) * 255 / 219, (u - 128) * 255 / 224, (v - 128) * 255 / 224
    rgb = np.stack([y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def decode(data: bytes, wanted: Callable[[int], bool] = lambda n: True) -> Iterator[tuple[int, float, int, int, bytes | None]]:
    """Number, time in seconds, width, height and RGB pixels of each frame of a whole stream.

    Frames that aren't wanted are stepped over and have no pixels.
    """
    of = layout(data)
    at, n = of.first, 0
    while at < len(data):
        at = data.index(b"\n", at) + 1
        raw = np.frombuffer(data, np.uint8, of.planes, at)
        yield n, of.pts(n), of.width, of.height, of.rgb(raw) if wanted(n) else None
        at, n = at + of.planes, n + 1


# ---- files


def store(path: str):
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") or "://" not in path else fs.FileSystem.from_uri(path)


def files(path: str) -> list[tuple[str, int]]:
    """Files of a folder, a pattern or a file, with their bytes; names that begin with a dot or underscore aren't data."""
    from pyarrow import fs

    system, base = store(path)
    folder, name = posixpath.split(base.rstrip("/"))
    if any(c in name for c in "*?["):
        found = [f for f in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, name)]
    else:
        info = system.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
    shown = lambda f: all(part[:1] not in ("_", ".") for part in f.path[len(folder) :].split("/"))
    scheme = "file:" if system.type_name == "local" else path[: path.index("://") + 3]
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and shown(f))


class Opened:
    """Bytes of a file by their places."""

    def __init__(self, path: str):
        system, base = store(path)
        self.file = system.open_input_file(base)

    def bytes(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def close(self) -> None:
        self.file.close()


def video_id(path: str) -> int:
    """The hash of a path that Spark's ``xxhash64`` gives."""
    import xxhash

    return int.from_bytes(xxhash.xxh64(path.encode(), seed=42).digest(), "big", signed=True)


# ---- the source


@dataclass
class Wanted:
    """Numbers that are asked for: a range, and a set where values were named."""

    low: float = float("-inf")
    high: float = float("inf")
    named: frozenset | None = None

    @classmethod
    def of(cls, options: dict, low: str, high: str, named: str) -> Wanted:
        """What options say: bounds, both counted, and a list of values in JSON."""
        bound = lambda name, default: int(options[name]) if options.get(name) is not None else default
        listed = options.get(named)
        return cls(bound(low, float("-inf")), bound(high, float("inf")), None if listed is None else frozenset(json.loads(listed)))

    def all(self) -> bool:
        return self == Wanted()

    def has(self, n: int) -> bool:
        return self.low <= n <= self.high and (self.named is None or n in self.named)

    def within(self, low: int, high: int) -> list[int] | range:
        """The wanted numbers from ``low`` up to, not including, ``high``."""
        low, high = int(max(low, self.low)), int(min(high, self.high + 1))
        return range(low, max(low, high)) if self.named is None else sorted(n for n in self.named if low <= n < high)


@dataclass
class Span(D.InputPartition):
    """A byte range of a file: the frames that start in it."""

    path: str
    size: int
    start: int
    stop: int


@dataclass
class VideoReader(D.DataSourceReader):
    path: str
    names: tuple[str, ...]
    batch: int = 16
    span: int = 64 << 20
    frames: Wanted = field(default_factory=Wanted)
    videos: Wanted = field(default_factory=Wanted)

    def partitions(self) -> list[Span]:
        """Byte ranges of the wanted videos. Where frames are asked for, first lines are read to leave ranges out."""
        found = [(p, size) for p, size in files(self.path) if self.videos.has(video_id(p))]
        spans = [Span(p, size, at, min(at + self.span, size)) for p, size in found for at in range(0, size, self.span)]
        if not self.frames.all():
            with ThreadPoolExecutor(16) as pool:
                heads = dict(zip(found, pool.map(lambda f: self._head(*f), found), strict=True))
            spans = [s for s in spans if len(self._numbers(s, heads[s.path, s.size])) or (heads[s.path, s.size].frames(s.size) is None and not s.start)]
        return spans or [Span("", 0, 0, 0)]

    def _head(self, path: str, size: int) -> Layout:
        file = Opened(path)
        try:
            return layout(file.bytes(0, min(size, 4096)))
        finally:
            file.close()

    def _numbers(self, span: Span, of: Layout) -> list[int] | range:
        """Wanted frames that start in a range of a file with plain frames."""
        step, count = len(MARK) + of.planes, of.frames(span.size)
        at = lambda byte: max(0, -(-(byte - of.first) // step))
        return self.frames.within(at(span.start), min(at(span.stop), count)) if count is not None else []

    def read(self, span: Span) -> Iterator:
        if not span.path:
            return
        file, video = Opened(span.path), video_id(span.path)
        try:
            of, with_pixels = layout(file.bytes(0, min(span.size, 4096))), "pixels" in self.names
            if of.frames(span.size) is not None:
                numbers = self._numbers(span, of)
                for i in range(0, len(numbers), self.batch):
                    part = numbers[i : i + self.batch]
                    pixels = self._pixels(file, of, part) if with_pixels else [None] * len(part)
                    yield self._rows(video, [(n, of.pts(n), of.width, of.height, p) for n, p in zip(part, pixels, strict=True)])
            elif not span.start:  # frames with parameters: their places follow from those before them
                rows = [r for r in decode(file.bytes(0, span.size), lambda n: with_pixels and self.frames.has(n)) if self.frames.has(r[0])]
                for i in range(0, len(rows), self.batch):
                    yield self._rows(video, rows[i : i + self.batch])
        finally:
            file.close()

    def _pixels(self, file: Opened, of: Layout, numbers: list[int] | range) -> Iterator[bytes]:
        """Neighbouring frames are read at once."""
        step, i = len(MARK) + of.planes, 0
        while i < len(numbers):
            k = i + 1
            while k < len(numbers) and numbers[k] == numbers[k - 1] + 1:
                k += 1
            data = file.bytes(of.first + numbers[i] * step, (k - i) * step)
            for at in range(0, len(data), step):
                if data[at : at + len(MARK)] != MARK:
                    raise ValueError("a frame doesn't start where its number says")
                yield of.rgb(np.frombuffer(data, np.uint8, of.planes, at + len(MARK)))
            i = k

    def _rows(self, video: int, rows: list[tuple]):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}
        kind = {c: kinds[k] for c, k in (f.split(" ") for f in FRAME.split(", "))}
        columns = dict(zip(kind, zip(*((video, *r) for r in rows), strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kind[c]) for c in self.names], names=list(self.names))


class VideoSource(D.DataSource):
    """``spark.read.format("y4m")``. Options: ``batchSize`` frames leave a task at a time, ``spanBytes`` of a file are a
    partition; ``first``, ``last`` and ``frames`` (a list in JSON) say which frames are read, ``videos`` which files, by
    their ids. Columns come by the given schema, so one without ``pixels`` reads nothing but first lines.

    Spark can push filters to such a source, but (in 4.1) keeps one set of them for all queries of a DataFrame: of
    ``where frame = 1`` joined by ``where frame = 2`` both would read frame 2. So what to read is an option here.
    """

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema: StructType) -> VideoReader:
        names = tuple(f.name for f in schema)
        if unknown := set(names) - {c.split()[0] for c in FRAME.split(",")}:
            raise ValueError(f"frames have no {', '.join(sorted(unknown))}")
        o = self.options
        return VideoReader(o["path"], names, int(o.get("batchSize", 16)), int(o.get("spanBytes", 64 << 20)), Wanted.of(o, "first", "last", "frames"), Wanted.of(o, "", "", "videos"))


# ---- the sink


@dataclass
class Written(D.WriterCommitMessage):
    files: list[tuple[str, str]]


@dataclass
class FileWriter(D.DataSourceArrowWriter):
    """Rows as files: tasks write aside, the commit moves what finished tasks report to its names, an abort deletes all.

    A file appears whole or not at all. A task that runs twice leaves one copy, since only one attempt is reported; a
    batch that is written again is left alone if it was committed, and otherwise takes the same names.
    """

    path: str
    template: str
    content: str
    work: str
    overwrite: bool = False
    batch: str | None = None

    def write(self, iterator: Iterator) -> Written:
        import uuid

        system, base = store(self.path)
        own, made = f"{base}/{self.work}/{uuid.uuid4().hex}", []
        system.create_dir(own)
        for batch in iterator:
            for row in batch.to_pylist():
                if row[self.content] is not None:
                    name = self.template.format(**{k: v for k, v in row.items() if k != self.content})
                    if name.startswith(("/", "_", ".")) or ".." in name.split("/"):
                        raise ValueError(f"{name!r} names no file of this folder")
                    with system.open_output_stream(f"{own}/{len(made)}") as f:
                        f.write(row[self.content])
                    made.append((f"{own}/{len(made)}", name))
        return Written(made)

    def commit(self, messages: list, batch: int | str | None = None) -> None:
        system, base = store(self.path)
        batch = self.batch if batch is None else batch
        done = None if batch is None else f"{base}/_batches/{batch}"
        made = [f for m in messages if m for f in m.files]
        names = [name for _, name in made]
        if len({*names}) < len(names):
            self.abort(messages)
            raise ValueError(f"several rows name one file, as {next(n for n in names if names.count(n) > 1)!r}")
        if not (done and system.get_file_info(done).is_file):
            for aside, name in made:
                system.create_dir(posixpath.dirname(f"{base}/{name}"))
                system.move(aside, f"{base}/{name}")
            if self.overwrite:
                for path, _ in files(self.path):
                    rest = store(path)[1]
                    if rest.removeprefix(f"{base}/") not in {*names}:
                        system.delete_file(rest)
            if done:
                system.create_dir(posixpath.dirname(done))
                with system.open_output_stream(done) as f:
                    f.write(json.dumps(sorted(names)).encode())
        self.abort(messages)

    def abort(self, messages: list, batch: int | None = None) -> None:
        system, base = store(self.path)
        aside = f"{base}/{self.work}"
        if system.get_file_info(aside).type.name == "Directory":
            system.delete_dir(aside)


class FileStreamWriter(FileWriter, D.DataSourceStreamArrowWriter):
    """The same for a stream: a batch's number is what it is known by."""


class FileSink(D.DataSource):
    """``df.write.format("named_files")``: each row's ``content`` becomes a file below the path.

    Options: ``name`` is a template over the other columns (``{video_id}-{segment}.y4m``), ``content`` the column written,
    ``batch`` a key under which a write counts once. Null contents give no file, two rows with one name fail. ``overwrite``
    deletes what isn't written again, after the rest is in place.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def _made(self, kind: type, overwrite: bool):
        import uuid

        o = self.options
        return kind(o["path"], o["name"], o.get("content", "content"), f"_work-{uuid.uuid4().hex}", overwrite, o.get("batch"))

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return self._made(FileWriter, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> FileStreamWriter:
        return self._made(FileStreamWriter, False)


def register(spark: SparkSession) -> None:
    """Makes ``y4m`` and ``named_files`` known to a session."""
    for source in (VideoSource, FileSink):
        spark.dataSource.register(source)
