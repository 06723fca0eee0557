"""Reports, catalogues, queues and ledgers."""

from __future__ import annotations

import hashlib
import itertools
import os
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from culler import schemas
from culler.functions.fields import BLANK, keys_and_values, missing, strip, tag, value
from culler.operators.stage import small_batches, stored

BOM = b"\xef\xbb\xbf"


def _pieces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines of report files as they are, and the blocks that they come from: two tables in the shared folder.

    Lines are (uri, start, id, raw): the block by file and first byte, a number that rises by one from line to line of a
    block, and the bytes with their terminator (LF, CR LF or CR). What is behind the last LF gets one too, and `open` says
    so. Blocks are (path, uri, start, first, before, total, utf8, bom, open, last), a file of a byte-order mark alone being
    one of no start; `before` counts the lines of its file in earlier blocks, `last` is true where the text ends with a
    terminator, so that an empty line follows. The reader skips the mark; the length of the file tells.
    """
    value = F.col("value")
    latin = F.concat(F.decode(value.cast("binary"), "ISO-8859-1"), F.lit("\n"))  # a character a byte
    raw = F.when(value.contains("\r"), F.transform(F.split(latin, r"(?<=\r)(?!\n)"), lambda x: F.encode(x, "ISO-8859-1"))).otherwise(F.array(F.concat(value, F.lit("\n")).cast("binary")))
    uri = F.col("_metadata.file_path").alias("uri")
    found = spark.read.option("lineSep", "\n").text(path).select(uri, F.col("_metadata.file_block_start").alias("start"), F.explode(raw).alias("raw"))
    lines = stored(found.select("uri", "start", F.monotonically_increasing_id().alias("id"), "raw"))
    ends_cr = F.substring("raw", -2, 2) == F.lit(b"\r\n")
    blocks = lines.groupBy("uri", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("bytes"), F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("valid"), F.max_by(ends_cr, "id").alias("cr"))
    files = spark.read.format("binaryFile").load(path).select("path", "length", uri)  # names and lengths; contents aren't read
    file = Window.partitionBy("uri")
    by_start = file.orderBy("start")
    more = F.col("length") - F.coalesce(F.sum("bytes").over(file), F.lit(0))
    rows = files.join(blocks, "uri", "left").withColumn("more", F.when(more.isin(-1, 0, 2, 3), more).otherwise(F.raise_error(F.concat(F.lit("not read byte by byte, compressed or changed meanwhile: "), "path"))))
    is_open = F.col("more").isin(-1, 2)
    is_last = F.row_number().over(file.orderBy(F.desc("start"))) == 1
    return lines, stored(
        rows.select(
            "path",
            "uri",
            "start",
            "first",
            F.coalesce(F.sum("n").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.coalesce(F.sum("n").over(file), F.lit(0)).alias("total"),
            F.coalesce(F.bool_and("valid").over(file), F.lit(True)).alias("utf8"),
            F.col("more").isin(2, 3).alias("bom"),
            is_open.alias("open"),
            (is_last & (~is_open | F.coalesce("cr", F.lit(False)))).alias("last"),
        )
    )


def _in_order(parts: tuple[str, ...], schema: str, give):
    """A function of rows (parts, start, id, raw): one task a part gives it its `raw` in order of (start, id), without sorting it in memory.

    Rows of following ids go as one, compressed; as they come, a worker adds them to a file in Spark's local folder and reads
    them back in order, so it holds a few MB however long a part is. `give(part, pieces)` yields batches of `schema`. `deal`
    brings the rows of a part to one task. The workers' functions are local, so that they reach executors without the package.
    """

    def packed(batches):
        """Rows that follow each other as one."""
        for b in batches:
            rows = b.select([*parts, "start", "id"]).to_pylist()
            raw = b.column("raw").to_pylist()
            at = [i for i, (x, y) in enumerate(zip(rows, rows[1:]), 1) if x | {"id": x["id"] + 1} != y]
            runs = [(i, j) for i, j in zip([0, *at], [*at, len(rows)]) if i < j]
            firsts = b.take(pa.array([i for i, _ in runs], pa.int64()))
            whole = [b"".join(raw[i:j]) for i, j in runs]
            small = [pa.compress(x, "zstd", asbytes=True) for x in whole]
            k = firsts.schema.get_field_index("raw")
            yield firsts.set_column(k, "raw", pa.array(small, pa.binary())).append_column("size", pa.array([len(x) for x in whole], pa.int64()))

    def replayed(batches):
        folder = next((x for x in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(x)), None)
        with tempfile.TemporaryFile(dir=folder) as file:
            found, end = [], 0
            for b in batches:
                rows = b.select([*parts, "start", "id", "size"]).to_pylist()
                for row, raw in zip(rows, b.column("raw")):
                    raw = raw.as_buffer()
                    file.write(raw)
                    found.append((tuple(row[c] for c in parts), row["start"], row["id"], end, raw.size, row["size"]))
                    end += raw.size
            found.sort()

            def read(at, n, size):
                file.seek(at)
                return pa.decompress(file.read(n), size, "zstd", asbytes=True)

            for part, pieces in itertools.groupby(found, lambda x: x[0]):
                yield from give(part, (read(*x[3:]) for x in pieces))

    def of(rows: DataFrame, deal) -> DataFrame:
        rows = rows.select(*parts, "start", "id", "raw")
        types = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        return deal(rows.mapInArrow(packed, f"{types}, size bigint")).mapInArrow(replayed, schema)

    return of


def _digests(at: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, report_md5), the MD5 of a file's bytes. It is a function of them in order, so a file is one task, by runs of lines."""

    def digest(part, pieces):
        """Holds one run, as the last byte of the last may not be the file's."""
        path, bom, is_open = part
        md5, held = hashlib.md5(BOM if bom else b""), b""
        for piece in pieces:
            md5.update(held)
            held = piece
        md5.update(held[:-1] if is_open else held)
        yield pa.RecordBatch.from_pydict({"path": [path], "report_md5": [md5.hexdigest()]})

    got = _in_order(("path", "bom", "open"), "path string, report_md5 string", digest)(at, lambda runs: runs.repartition("path"))
    mark_alone = blocks.filter("start IS NULL").select("path", F.md5(F.lit(BOM)).alias("report_md5"))
    with small_batches(at.sparkSession):
        return stored(got.unionByName(mark_alone))


def read_lines(spark: SparkSession, path: str, md5: bool = True) -> DataFrame:
    """(path, report_md5, line_no, line) of report files. A file is decoded once: UTF-8 if it is valid, Latin-1 if not; a byte-order mark goes.

    Files are read by blocks and their lines written once to the shared folder; lines keep their order by number. No file is
    held as a whole: text between two line feeds is one row. An empty file has no line. Without `md5`, report_md5 is left out.
    """
    lines, blocks = _pieces(spark, path)
    at = lines.join(blocks.filter("start IS NOT NULL").drop("total", "last"), ["uri", "start"])
    bare = F.substring("raw", F.lit(1), F.length("raw") - F.when(F.substring("raw", -2, 2) == F.lit(b"\r\n"), 2).otherwise(1))
    number = F.col("before") + F.col("id") - F.col("first")
    mark = F.when(F.col("bom") & (number == 0), F.decode(F.lit(BOM), "ISO-8859-1")).otherwise("")  # in Latin-1 it is text
    line = F.when(F.col("utf8"), bare.cast("string")).otherwise(F.concat(mark, F.decode(bare, "ISO-8859-1")))
    # behind a terminator there is one more line, and it is empty
    rows = at.select("path", number.alias("line_no"), line.alias("line")).unionByName(blocks.filter("last").select("path", F.col("total").alias("line_no"), F.lit("").alias("line")))
    return rows.join(_digests(at, blocks), "path").select("path", "report_md5", "line_no", "line") if md5 else rows


def _once(rows: DataFrame, *columns) -> DataFrame:
    """Rows with further columns, computed once however often they are used: a generator, which the optimizer doesn't copy."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def parse_entries(lines: DataFrame) -> DataFrame:
    """Entries of (line_no, line); other columns stay in front. Lines without a tag or an id go."""
    kept = [c for c in lines.columns if c not in ("line_no", "line")]
    line = F.ltrim(F.col("line"), F.lit(BLANK))
    tagged = lines.filter(tag(F.col("line")) != "").select(*kept, "line_no", tag(F.col("line")).alias("__tag"), F.ltrim(F.substring(line, F.length(tag(F.col("line"))) + 3, F.length(line)), F.lit(BLANK)).alias("__rest"))
    keys, values = keys_and_values(F.col("__rest"))
    pairs = _once(tagged, keys.alias("__k"), values.alias("__v"))
    got = lambda k: value(F.col("__k"), F.col("__v"), k)
    names = {"group": "grp"} | {k: k for k in ("role", "id", "parent", "match", "b3", "size", "w", "h", "name")}
    rows = _once(pairs, *[got(k).alias(f"__{n}") for k, n in names.items()]).filter(F.coalesce("__id", F.lit("")) != "")
    text = lambda k: F.coalesce(f"__{k}", F.lit("")).alias(k)
    role = F.upper(F.coalesce("__role", "__tag")).alias("role")
    return rows.select(*kept, "line_no", role, text("grp"), text("id"), missing(F.col("__parent")).alias("parent"), text("match"), *[missing(F.col(f"__{k}")).alias(k) for k in ("b3", "size", "w", "h")], text("name"))


def require_entries(entries: DataFrame) -> DataFrame:
    """The entries; refuses a report without any, whatever its format says."""
    if entries.isEmpty():
        raise ValueError("the report has no entry with an id: not a report of this kind")
    return entries


def parse_header(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """folder, folder_id, format: the last of each label before the first entry line. One row, or one for each `by` (e.g. path)."""
    s = strip(F.col("line"))
    first = lines.filter(tag(F.col("line")) != "").groupBy(*by).agg(F.min("line_no").alias("first_entry"))
    labelled = lines.filter(s.contains(":") & ~s.startswith("[") & ~F.substring_index(s, ":", 1).contains("="))
    rows = labelled.join(first, list(by), "left") if by else labelled.crossJoin(F.broadcast(first))  # one row of one number
    rows = rows.filter(F.coalesce(F.col("line_no") < F.col("first_entry"), F.lit(True)))
    label = F.lower(strip(F.substring_index(s, ":", 1)))
    val = strip(F.substring(s, F.instr(s, ":") + 1, F.length(s)))
    rows = rows.select(*by, "line_no", label.alias("label"), val.alias("val"))
    of = lambda cond: F.max_by(F.when(cond, F.col("val")), F.when(cond, F.col("line_no")))
    return rows.groupBy(*by).agg(of(F.col("label") == "folder").alias("folder"), of(F.col("label") == "folder id").alias("folder_id"), of(F.col("label").startswith("format")).alias("format"))


def render_lines(entries: DataFrame) -> DataFrame:
    """(line_no, line) that parse back to the entries."""
    part = lambda k, c: F.concat(F.lit(f"{k}="), F.coalesce(F.col(c), F.lit("")))
    return entries.select("line_no", F.concat(F.lit("["), F.col("role"), F.lit("] "), F.concat_ws(" | ", part("group", "grp"), *[part(k, k) for k in ("id", "parent", "match", "b3", "size", "w", "h", "name")])).alias("line"))


def write_report(entries: DataFrame, path: str, folder: str, folder_id: str, files: int = 1) -> None:
    """A report as text files of consecutive lines, each with the header first, so that each can be read alone.

    Lines are sorted by all tasks; one task a file only puts them one after another.
    """
    head = f"Folder: {folder}\nFolder ID: {folder_id}\nFORMAT: v2"

    def text(part, pieces):
        yield pa.RecordBatch.from_pydict({"value": [head]})
        for piece in pieces:
            yield pa.RecordBatch.from_arrays([pa.array([piece[:-1]], pa.binary()).view(pa.string())], ["value"])

    lines = render_lines(entries)
    dealt = lines.withColumn("file", F.lit(0)) if files == 1 else lines.repartitionByRange(files, "line_no").withColumn("file", F.spark_partition_id())
    in_order = dealt.repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no")
    raw = F.concat(F.coalesce("line", F.lit("")), F.lit("\n")).cast("binary")
    rows = in_order.select("file", F.lit(0).alias("start"), F.monotonically_increasing_id().alias("id"), raw.alias("raw"))
    with small_batches(entries.sparkSession):
        _in_order(("file",), "value string", text)(rows, lambda runs: runs.repartitionById(files, F.col("file"))).write.mode("overwrite").text(path)


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, md5, sha256) of files, from their bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def find_reports(catalog: DataFrame, name: str) -> DataFrame:
    """Files of exactly that name that are neither in the bin nor folders; the filter reaches the scan."""
    return catalog.filter((F.col("name") == name) & ~F.coalesce(F.col("trashed"), F.lit(False)) & (F.coalesce(F.col("mime_type"), F.lit("")) != "application/vnd.google-apps.folder"))


def the_report(catalog: DataFrame, name: str) -> str:
    """Id of the only report of that name; refuses to guess."""
    found = find_reports(catalog, name).select("id").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} report named {name!r}")
    return found[0]["id"]


def queue_json(rows: DataFrame) -> DataFrame:
    """One JSON text per queued row, nulls kept."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in ("line_no", "id", "parent", "name", "grp", "owned_by_me", "view_link", "created_time")]), {"ignoreNullFields": "false"}).alias("value"))


def write_queue(rows: DataFrame, path: str) -> None:
    queue_json(rows).write.mode("overwrite").text(path)


def parse_queue(texts: DataFrame) -> DataFrame:
    """Queue rows of the texts in `value`, and `bad`: those that are no JSON or lack id or parent. Blank texts go."""
    rows = texts.filter(strip(F.col("value")) != "").withColumn("j", F.from_json("value", schemas.QUEUE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows.select("j.*").withColumn("bad", F.col("_bad").isNotNull() | (F.coalesce("id", F.lit("")) == "") | (F.coalesce("parent", F.lit("")) == "")).drop("_bad")


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return parse_queue(spark.read.text(path))


def queue_counts(queue: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: lines of a queue, those that can't be read, and those whose id a ledger has already."""
    done = ledger.select("id").distinct().withColumn("__done", F.lit(True))
    return queue.join(done, "id", "left").agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("bad"), F.count_if(~F.col("bad") & F.col("__done")).alias("done"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LEDGER).option("mode", "DROPMALFORMED").json(path)


def append_ledger(new: DataFrame, ledger: DataFrame, path: str) -> None:
    """Appends rows whose (key, id) isn't there yet; the first of several in one batch wins."""
    new.dropDuplicates(["key", "id"]).join(ledger.select("key", "id").distinct(), ["key", "id"], "left_anti").write.mode("append").json(path)
