"""One file per group, written by tasks and committed as a whole.

``write_files`` takes rows of (file, seq, content). A file is cut into pieces of ``PIECE`` numbers; tasks put the rows of a piece in the order of
``seq`` and keep its bytes in a file of their own. What then comes together for each file are only the places of its pieces, which one task
copies one after the other, a bounded step at a time, so no task sorts or holds a file. ``write_pieces`` is for rows that tasks make into
pieces themselves. Attempts write into folders of their own under the destination's ``_attempts``; when all tasks are done the files of
those that count move to their places, and a failed job leaves nothing. Files of the same name are replaced; others stay, unless
``overwrite`` asks for a folder with these files only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gridlens.sources.ranged import store_of

SCHEMA = "file string, seq long, held string, lo long, hi long"
ATTEMPTS = "_attempts"
HELD = "held"
#: Numbers of a file's rows that come together in one task.
PIECE = 1 << 16
#: Bytes copied at a time.
STEP = 8 << 20
Maker = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class GroupedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, job: str):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = store_of(self.path)
        folder = f"{top}/{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}"
        files, stream = [], None
        try:
            for batch in iterator:
                for file, held, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("file", "held", "lo", "hi")), strict=True):
                    if not files or file != files[-1]:
                        if stream:
                            stream.close()
                        if file is None or file.startswith("/") or ".." in file.split("/"):
                            raise ValueError(f"not a name for a file: {file!r}")
                        store.create_dir(f"{folder}/{file}".rpartition("/")[0], recursive=True)
                        stream = store.open_output_stream(f"{folder}/{file}")
                        files.append(file)
                    with store.open_input_file(f"{top}/{ATTEMPTS}/{self.job}/{HELD}/{held}") as pieces:
                        for at in range(lo, hi, STEP):
                            stream.write(pieces.read_at(min(STEP, hi - at), at))
        finally:
            if stream:
                stream.close()
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = store_of(self.path)
        made = [m for m in messages if m]
        kept = {f for m in made for f in m.files}
        store.create_dir(top, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(top, recursive=True)):
                name = f.path[len(top) :].lstrip("/")
                if f.is_file and name not in kept and name.split("/")[0] != ATTEMPTS:
                    store.delete_file(f.path)
        for folder in {f.rpartition("/")[0] for f in kept if "/" in f}:
            store.create_dir(f"{top}/{folder}", recursive=True)
        for m in made:
            for f in m.files:
                store.move(f"{m.folder}/{f}", f"{top}/{f}")
        _clear(self.path, self.job)

    def abort(self, messages: list[Written | None]) -> None:
        _clear(self.path, self.job)


def _clear(path: str, job: str) -> None:
    """Remove what a job's attempts left; the folder of attempts goes with the last job in it."""
    store, top = store_of(path.rstrip("/"))
    mine = f"{top}/{ATTEMPTS}/{job}"
    if store.get_file_info(mine).type != fs.FileType.NotFound:
        store.delete_dir(mine)
    if store.get_file_info(f"{top}/{ATTEMPTS}").type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(f"{top}/{ATTEMPTS}")):
        store.delete_dir(f"{top}/{ATTEMPTS}")


class GroupedFiles(DataSource):
    """Options: ``path``, ``job``. Rows must come as ``write_pieces`` deals and sorts them."""

    @classmethod
    def name(cls) -> str:
        return "grouped_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: T.StructType, overwrite: bool) -> GroupedWriter:
        if schema.names != ["file", "seq", "held", "lo", "hi"]:
            raise ValueError(f"rows of grouped files are {SCHEMA}")
        return GroupedWriter(self.options["path"], overwrite, self.options["job"])


def _kept(make: Maker | None, folder: str):
    """Rows of (file, seq, content), which ``make`` makes of what comes, as (file, seq, held, lo, hi): a task's contents are kept in one file, one after
    the other, and a row says where. Rows of a file side by side that have the same ``piece``, where there is one, are one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, there = store_of(folder)
        name, stream, at, last, row = uuid.uuid4().hex, None, 0, None, None
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            got, out[:] = list(zip(*out, strict=True)) or [()] * 5, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "seq", "held", "lo", "hi"])

        try:
            for batch in make(batches) if make else batches:
                pieces = batch.column("piece").to_pylist() if "piece" in batch.schema.names else range(batch.num_rows)
                for file, seq, piece, content in zip(batch.column("file").to_pylist(), batch.column("seq").to_pylist(), pieces, batch.column("content"), strict=True):
                    if stream is None:
                        store.create_dir(there, recursive=True)
                        stream = store.open_output_stream(f"{there}/{name}")
                    if row and (last != (file, piece) or "piece" not in batch.schema.names):
                        out.append((*row, at))
                        row = None
                    row, last = row or (file, seq, name, at), (file, piece)
                    if content.is_valid:
                        stream.write(content.as_buffer())
                        at += len(content.as_buffer())
                if len(out) >= 1024:
                    yield rows()
        finally:
            if stream:
                stream.close()
        if row:
            out.append((*row, at))
        yield rows()

    return task


def write_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write ``rows`` (file, seq, content as text or bytes), each file's content in the order of ``seq``."""
    piece = F.expr(f"greatest(cast(seq as long), 0L) div {PIECE}")
    rows = rows.select(F.col("file").cast("string").alias("file"), F.col("seq").cast("long").alias("seq"), piece.alias("piece"), F.col("content").cast("binary").alias("content"))
    write_pieces([(rows.repartition("file", "piece").sortWithinPartitions("file", "piece", "seq", "content"), None)], path, overwrite)


def write_pieces(parts: list[tuple[DataFrame, Maker | None]], path: str, overwrite: bool = False) -> None:
    """Write the rows (file, seq, content) that tasks make of each part's batches, as large as they are made: a piece of a file each, whose order is ``seq``."""
    spark, job = parts[0][0].sparkSession, uuid.uuid4().hex
    spark.dataSource.register(GroupedFiles)
    folder, places = f"{path.rstrip('/')}/{ATTEMPTS}/{job}/{HELD}", None
    for rows, make in parts:
        kept = rows.mapInArrow(_kept(make, folder), SCHEMA)
        places = kept if places is None else places.unionByName(kept)
    try:
        places.repartition("file").sortWithinPartitions("file", "seq", "held", "lo").write.format("grouped_files").options(path=path, job=job).mode("overwrite" if overwrite else "append").save()
    except BaseException:
        _clear(path, job)
        raise


def cell(name: str, kind: T.DataType) -> Column:
    """A column as text of a table: times in ISO, lists joined by ``/``, nothing and NaN as NaN for numbers, else as empty text."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), "/"), F.lit(""))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce(c.cast("string"), F.lit("NaN"))
    return F.coalesce(c.cast("string"), F.lit(""))


def lines(rows: DataFrame, file: Column, seq: Column, *columns: str, separator: str = "\t") -> DataFrame:
    """(file, seq, content): a line of each row, and the names of the columns as the first of each file.

    ``seq`` counts from 0; rows of a file with equal ``seq`` come in the order of their text.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    body = rows.select(file.alias("file"), seq.cast("long").alias("seq"), F.concat(F.concat_ws(separator, *[cell(c, kinds[c]) for c in columns]), F.lit("\n")).alias("content"))
    head = rows.select(file.alias("file")).distinct().select("file", F.lit(-1).cast("long").alias("seq"), F.lit(separator.join(columns) + "\n").alias("content"))
    return head.unionByName(body)
