"""CSV files of one source whose headers differ: each file's columns are matched by name.

A first pass looks at lines without parsing them and keeps the first of each file. Files with the expected header need
nothing more; for the others a small table says where each column stands, which columns are unknown, and how wide a
line must be. The second pass parses each line at its file's width and takes the columns from their places. Unknown
columns are rescued per field, lines of another width verbatim.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.schemas import CORRUPT, RAW_COLUMNS, RESCUED
from audience_lens.sources.workspace import workspace

FILE = "_source_file"
_FIRST = "_first_block"
_PARSED = "_parsed"


def lines(reader) -> DataFrame:
    """Lines with their file and ingest time, from a batch or stream reader that has been given a path."""
    return reader.select("value", F.col("_metadata.file_path").alias(FILE),
                         (F.col("_metadata.file_block_start") == 0).alias(_FIRST), F.current_timestamp().alias("_ingested_at"))


def _fields(line: Column) -> Column:
    """Names in a header: quotes and a byte order mark removed, trimmed, in lower case."""
    bare = F.regexp_replace(line, "^﻿", "")
    found = F.regexp_extract_all(F.concat(bare, F.lit(",")), F.lit(r'\s*("(?:[^"]|"")*"|[^,]*)\s*,'), 1)
    return F.transform(found, lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), '^"|"$', ""), '""', '"'))))


def layouts(text: DataFrame, source: str) -> DataFrame:
    """(file, header, width, places, unknown) of each file whose first line isn't the expected header as it stands.

    ``places`` are the positions of the source's columns (0: missing); ``unknown`` are name and position of the others. A column
    that is named twice counts where it is named first; later ones are unknown, as ``name#position``. Names match in any
    case. A first line that names no column of the source is no header: its file has no width.
    """
    expected = RAW_COLUMNS[source]
    numbered = text.filter(F.col(_FIRST) & (F.trim("value") != "")).withColumn("n", F.monotonically_increasing_id())
    first = numbered.groupBy(FILE).agg(F.min_by("value", "n").alias("header")).filter(F.col("header") != ",".join(expected))
    named = first.withColumn("names", _fields(F.col("header")))
    placed = named.withColumn("places", F.array(*[F.array_position("names", F.lit(c)) for c in expected]))
    own = F.transform("names", lambda x, i: F.struct(
        F.when(F.array_position("names", x) == i + 1, x).otherwise(F.concat(x, F.lit("#"), (i + 1).cast("string"))).alias("name"),
        (i + 1).cast("int").alias("place")))
    unknown = F.filter(own, lambda x: ~x["name"].isin(*expected))
    known = F.exists("places", lambda p: p > 0)
    return placed.select(FILE, "header", F.when(known, F.size("names")).alias("width"), "places", unknown.alias("unknown"))


def _parsed(rows: DataFrame, widths: list[int], options: dict[str, str]) -> DataFrame:
    """Adds ``row``, the cells of a line at its ``width`` and what is wrong with it; null for other widths.

    A line is parsed once: the parser's result is a column of its own, of which ``row`` takes the parts.
    """
    names = {width: [f"c{i}" for i in range(width)] for width in widths}
    ddl = {width: ", ".join(f"{c} string" for c in (*own, CORRUPT)) for width, own in names.items()}
    parsed = {width: F.when(F.col("width") == width, F.from_csv("value", ddl[width], options)) for width in widths}
    rows = rows.withColumns({f"{_PARSED}{width}": line for width, line in parsed.items()})
    cells = F.lit(None)
    for width, own in names.items():
        line = F.col(f"{_PARSED}{width}")
        row = F.struct(F.array(*[line[c] for c in own]).alias("cells"), line[CORRUPT].alias("bad"))
        cells = F.when(F.col("width") == width, row).otherwise(cells)
    return rows.withColumn("row", cells)


def matched(text: DataFrame, source: str, options: dict[str, str], registry: str | None = None) -> DataFrame:
    """The source's columns, ``_corrupt_record``, ``_rescued_data`` and lineage of all lines but headers.

    Missing columns are null. Unknown columns that hold something come as one JSON object in ``_rescued_data``. A line with
    more or fewer fields than its file's header, and every line of a file without one, is also kept verbatim. Blank
    lines are left out, and so is a line that repeats its file's header. ``registry`` is the folder that keeps the layouts
    (in the work folder if not given); the optimizer picks the join with them by its size.
    """
    spark, expected = text.sparkSession, RAW_COLUMNS[source]
    registry = registry or f"{workspace(spark)}/headers/{uuid.uuid4().hex}"
    layouts(text, source).write.mode("overwrite").parquet(registry)
    found = spark.read.parquet(registry)
    widths = {len(expected)} | {r["width"] for r in found.select("width").distinct().collect() if r["width"]}  # a number a layout
    known = F.col("places").isNotNull()
    rows = text.filter(F.trim("value") != "").join(found, FILE, "left").filter(
        F.col("value") != F.coalesce(F.when(known & F.col("width").isNull(), F.lit("")), "header", F.lit(",".join(expected))))
    rows = _parsed(rows.withColumn("width", F.when(known, F.col("width")).otherwise(len(expected))), sorted(widths), options)

    def column(i: int) -> Column:
        place = F.coalesce(F.get("places", F.lit(i)), F.lit(i + 1)).cast("int")
        return F.when(place > 0, F.get("row.cells", place - 1))

    rescued = F.filter(F.transform("unknown", lambda x: F.struct(x["name"].alias("key"), F.get("row.cells", x["place"] - 1).alias("value"))),
                       lambda x: x["value"].isNotNull())
    return rows.select(
        *[column(i).alias(c) for i, c in enumerate(expected)],
        F.when(F.col("row").isNull(), F.col("value")).otherwise(F.col("row.bad")).alias(CORRUPT),
        F.when(F.size(rescued) > 0, F.to_json(F.map_from_entries(rescued))).alias(RESCUED), FILE, "_ingested_at")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark.read.text(path))
