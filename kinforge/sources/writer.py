"""Family-tree files written back: lossless lines, conversion between encodings, the header's CHAR line.

Files are written by the tasks that hold their lines, one line after the other, under a name of the task's
attempt that becomes the file's own at the end; a file that exists already is kept unless asked otherwise.
"""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinforge.operators._lineage import cut
from kinforge.sources import gedcom

#: What a target's name means, and its mark (fixed values).
TARGETS = {"UTF-8": "utf-8", "ANSEL": "ansel", "ASCII": "ascii", "UNICODE": "utf-16-le"}
MARKS = {"utf-8": codecs.BOM_UTF8, "utf-16-le": codecs.BOM_UTF16_LE, "utf-16-be": codecs.BOM_UTF16_BE}


def line_ends(spark: SparkSession, path: str) -> DataFrame:
    """(file, eol): CR LF where a file has any, else LF; a file of bare CR counts as LF."""
    files = spark.read.format("binaryFile").load(path)

    @F.pandas_udf("string")
    def eol(content):
        return content.map(lambda b: "\r\n" if "\r\n" in gedcom.decoded(b)[0] else "\n")

    return files.select(F.col("path").alias("file"), eol("content").alias("eol"))


def with_char(lines: DataFrame, name: str) -> DataFrame:
    """Lines whose first ``1 CHAR`` says ``name``; where a file has none, one stands behind its HEAD.

    A file without HEAD is an error, raised when its lines are read.
    """
    is_char = F.col("raw").rlike(r"\A1 CHAR(?:\z| )")
    is_head = F.col("raw").rlike(r"\A0 HEAD")
    at = lines.groupBy("file").agg(F.min(F.when(is_char, F.col("line_no"))).alias("char"), F.min(F.when(is_head, F.col("line_no"))).alias("head"))
    j = lines.join(at, "file")
    says = F.lit(f"1 CHAR {name}")
    lost = F.when(F.col("char").isNull() & F.col("head").isNull(), F.raise_error(F.concat(F.lit("no HEAD in "), F.col("file"))).cast("string"))
    same = j.select("file", F.col("line_no"), F.lit(0).alias("nth"), F.coalesce(lost, F.when(F.col("line_no") == F.col("char"), says).otherwise(F.col("raw"))).alias("raw"))
    new = at.filter("char IS NULL AND head IS NOT NULL").select("file", F.col("head").alias("line_no"), F.lit(1).alias("nth"), says.alias("raw"))
    # a new line takes its number behind HEAD, and all that follow move on by one
    every = same.unionByName(new).join(at.select("file", F.when(F.col("char").isNull(), F.col("head")).alias("behind")), "file")
    moved = F.when((F.col("line_no") > F.col("behind")) | (F.col("nth") == 1), 1).otherwise(0)
    return every.select("file", (F.col("line_no") + moved).alias("line_no"), "raw")


def census(lines: DataFrame, codec: str) -> DataFrame:
    """(file, lines, long_lines): lines, and those of more than 255 bytes in ``codec``."""

    @F.pandas_udf("long")
    def size(raw):
        return raw.map(lambda x: len(gedcom.encode_ansel(x) if codec == "ansel" and not x.isascii() else x.encode("utf-8" if codec == "ansel" else codec, "replace")))

    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(size("raw") > gedcom.MAX_LINE_BYTES).alias("long_lines"))


def write(lines: DataFrame, folder: str, codec: str = "utf-8", mark: bool = False, overwrite: bool = False, ends: DataFrame | None = None) -> DataFrame:
    """Writes (file, line_no, raw) as one file each under ``folder``; (path, lines, bytes) of what was written.

    ``ends`` (file, eol) has the line ends, LF where it has none. A character that ``codec`` lacks is an
    error that names its line.
    """
    lines = lines.select("file", "line_no", "raw")
    lines = lines.join(ends, "file", "left").withColumn("eol", F.coalesce("eol", F.lit("\n"))) if ends is not None else lines.withColumn("eol", F.lit("\n"))
    # a window, as Spark may leave a mere repartition out behind the join and then read its shuffle where it lies: several tasks would write one file
    one = lines.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("line_no")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        attempt, again = TaskContext.get().taskAttemptId(), TaskContext.get().attemptNumber() > 0  # a lost attempt may have left its file
        made: list[tuple[str, int, int]] = []
        name, out, n, size = None, None, 0, 0

        def close() -> None:
            if out is None:
                return
            out.close()
            target = f"{base}/{name}"
            if not overwrite and not again and fs.get_file_info(target).type != pafs.FileType.NotFound:
                fs.delete_file(f"{target}.{attempt}.part")
                raise FileExistsError(target)
            fs.move(f"{target}.{attempt}.part", target)
            made.append((target, n, size))

        for b in batches:
            for file, line_no, raw, eol in zip(*(b[c].to_pylist() for c in ("file", "line_no", "raw", "eol"))):
                own = file.rstrip("/").rsplit("/", 1)[-1]
                if own != name:
                    close()
                    name, n, size = own, 0, 0
                    out = fs.open_output_stream(f"{base}/{name}.{attempt}.part")
                    head = MARKS.get(codec, b"") if mark else b""
                    out.write(head)
                    size = len(head)
                try:
                    data = gedcom.encode_ansel(raw + eol) if codec == "ansel" else (raw + eol).encode(codec)
                except UnicodeEncodeError as e:
                    out.close()
                    fs.delete_file(f"{base}/{name}.{attempt}.part")
                    raise ValueError(f"{file}, line {line_no}: {codec} has no {e.object[e.start : e.end]!r}") from None
                out.write(data)
                n, size = n + 1, size + len(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "lines", "bytes"])

    return cut(one.mapInArrow(run, "path string, lines long, bytes long"))  # written now, and once


def convert(spark: SparkSession, path: str, folder: str, to: str = "UTF-8", source: str | None = None, mark: bool = False, normalize: bool = True, dry_run: bool = False, overwrite: bool = False) -> DataFrame:
    """Files of ``path`` in another encoding: file, source_codec, target_codec, lines, long_lines, written.

    ANSEL text is composed unless ``normalize`` is off. Empty files and bytes that don't decode are errors.
    With ``dry_run`` nothing is written.
    """
    if to.upper() not in TARGETS:
        raise ValueError(f"no such target: {to}")
    codec = TARGETS[to.upper()]
    bad = gedcom.input_issues(spark, path).first()
    if bad:
        raise ValueError(f"{bad['file']}: {bad['detail']} ({bad['code']})")

    @F.pandas_udf("string")
    def found(content):
        return content.map(lambda b: gedcom.decoded(b, source)[1])

    @F.pandas_udf("string")
    def composed(raw):
        return raw.map(lambda x: unicodedata.normalize("NFC", x))

    names = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), found("content").alias("source_codec"))
    lines = gedcom.read_lines(spark, path, source).join(names, "file")
    if normalize:
        lines = lines.withColumn("raw", F.when(F.col("source_codec") == "ansel", composed("raw")).otherwise(F.col("raw")))
    lines = with_char(lines.select("file", "line_no", "raw"), to.upper())
    out = names.join(census(lines, codec), "file").select("file", "source_codec", F.lit(codec).alias("target_codec"), "lines", "long_lines", F.lit(not dry_run).alias("written"))
    if not dry_run:
        write(lines, folder, codec, mark, overwrite, line_ends(spark, path))
    return out


def renumbered(nodes: DataFrame) -> DataFrame:
    """Lines numbered from 1 in each file, in their order."""
    return nodes.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("line_no")).cast("long"))
