"""A data source of frame sets: the extension point for new formats."""

from __future__ import annotations

import importlib

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trackfold import schema
from trackfold.operators.segmentation import image_of


class FrameSet:
    """One field of view over time. Subclasses give frames (2-D arrays), times in seconds and labels, by index."""

    def __init__(self, label: str, **metadata):
        self.label, self.metadata = label, metadata

    def frame_count(self) -> int:
        raise NotImplementedError

    def frame(self, index: int):
        raise NotImplementedError

    def time(self, index: int) -> float:
        raise NotImplementedError

    def frame_label(self, index: int) -> str:
        return str(index)

    def __len__(self) -> int:
        return self.frame_count()

    def __getitem__(self, at):
        if isinstance(at, slice):
            return [self.frame(i) for i in range(*at.indices(len(self)))]
        if isinstance(at, int):
            if not -len(self) <= at < len(self):
                raise IndexError(at)
            return self.frame(at % len(self))
        raise TypeError(f"{type(at).__name__} is no index of frames")

    def __iter__(self):
        return (self.frame(i) for i in range(len(self)))


class _Part(InputPartition):
    def __init__(self, label: str, start: int, stop: int):
        self.label, self.start, self.stop = label, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options):
        module, _, name = options["factory"].rpartition(":")
        self.make = getattr(importlib.import_module(module), name)
        self.argument = options.get("argument", "")
        self.step = int(options.get("frames", 16))

    def partitions(self):
        return [_Part(s.label, i, min(i + self.step, len(s))) for s in self.make(self.argument) for i in range(0, len(s), self.step)]

    def read(self, partition):
        for s in self.make(self.argument):
            if s.label == partition.label:
                for i in range(partition.start, partition.stop):
                    yield s.label, i, None, float(s.time(i)), s.frame_label(i), tuple(image_of(s.frame(i)).values())


class FrameSetSource(DataSource):
    """format("frameset") with option factory = "module:function", a function that gives frame sets; each partition reads some frames of one."""

    @classmethod
    def name(cls):
        return "frameset"

    def schema(self):
        return schema.FRAMES

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSetSource)
