"""A custom source: sensor lines ``id,ts,vc`` from a folder on shared storage, one task per file.

    spark.dataSource.register(SensorDataSource)
    spark.readStream.format("sensor_lines").option("filesPerTrigger", 100).load(uri)

The folder is any place that ``pyarrow.fs`` can list: a local or shared path, ``hdfs://``, ``s3://``. Files are taken by
the time they were changed and then by name; every file is read once, whatever its name. With the option ``badLines`` set to
``keep`` a line that cannot be read comes as a row with its text in ``bad_line`` and nulls; otherwise such lines are
left out. For a socket use ``readers.sensors(readers.socket_lines(...))``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from millrace.schemas import WATER_SENSOR

BAD_LINE = "bad_line"
READ_BYTES = 1 << 20


class SensorFile(InputPartition):
    """One file of lines."""

    def __init__(self, path: str):
        super().__init__(path)


def _files(path: str) -> list[tuple[int, str]]:
    """(time of change in nanoseconds, path) of the files of a folder, oldest first; hidden ones are passed over."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    entries = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    files = [e for e in entries if e.type == fs.FileType.File and not e.base_name.startswith((".", "_"))]
    return sorted((e.mtime_ns or 0, e.path) for e in files)


def _parsed(line: str) -> tuple[str, int, int] | None:
    try:
        sensor, ts, level = line.split(",")
        return sensor, int(ts), int(level)
    except ValueError:
        return None


class _FileReader:
    def __init__(self, path: str, keep_bad: bool):
        self.path, self.keep_bad = path, keep_bad

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import io

        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.value) as raw, io.BufferedReader(raw, READ_BYTES) as lines:
            for raw_line in lines:
                line = raw_line.decode("utf-8", "replace").strip()
                row = _parsed(line) if line else None
                if row is not None:
                    yield (*row, None) if self.keep_bad else row
                elif line and self.keep_bad:
                    yield None, None, None, line


class SensorReader(_FileReader, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return [SensorFile(name) for _, name in _files(self.path)]


class SensorStreamReader(_FileReader, DataSourceStreamReader):
    """An offset is the time of change of the last file, and the names of the files of that time."""

    def __init__(self, path: str, keep_bad: bool, files_per_trigger: int | None):
        super().__init__(path, keep_bad)
        self.most = files_per_trigger
        self.position: dict | None = None

    def initialOffset(self) -> dict:
        return {"changed": -1, "names": []}

    def latestOffset(self) -> dict:
        """The next files after those named last, at most so many."""
        position = self.position or self.initialOffset()
        files = [file for file in _files(self.path) if not _within(file, position)][: self.most]
        files = [(position["changed"], name) for name in position["names"]] + files
        if files:
            last = files[-1][0]
            position = {"changed": last, "names": [name for changed, name in files if changed == last]}
        self.position = position
        return position

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.position is None:  # a query that goes on says first where it stands
            self.position = end
        new = [file for file in _files(self.path) if not _within(file, start) and _within(file, end)]
        return [SensorFile(name) for _, name in new]

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


def _within(file: tuple[int, str], offset: dict) -> bool:
    changed, name = file
    return changed < offset["changed"] or changed == offset["changed"] and name in offset["names"]


class SensorDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sensor_lines"

    @property
    def _keep_bad(self) -> bool:
        return self.options.get("badLines", "drop").lower() == "keep"

    def schema(self) -> str:
        return f"{WATER_SENSOR}, {BAD_LINE} string" if self._keep_bad else WATER_SENSOR

    def reader(self, schema) -> DataSourceReader:
        return SensorReader(self.options["path"], self._keep_bad)

    def streamReader(self, schema) -> DataSourceStreamReader:
        most = self.options.get("filesPerTrigger")
        return SensorStreamReader(self.options["path"], self._keep_bad, int(most) if most else None)
