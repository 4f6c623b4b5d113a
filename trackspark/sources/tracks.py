"""Track files and settings in, corrected tracks and segments out. Trials are rows, never a loop over folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..schema import BOX, POSITIONS, RAW_COLUMNS, STIMULUS_COLUMNS

SETTINGS = "experiment_settings.json"
UPDATED = "experiment_settings_updated.json"
_SETTINGS_SCHEMA = StructType([StructField(n, DoubleType()) for n in ("Framerate", "Pixel per mm", "Source x", "Source y")])


def _parts(path: Column) -> tuple[Column, Column]:
    """(folder, file name) of a file's path, unescaped."""
    pieces = F.split(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "/")
    return F.element_at(pieces, -2), F.element_at(pieces, -1)


def scan_trials(spark: SparkSession, root: str, tag: str = "data.csv", exclude: tuple[str, ...] = ("Omit",)) -> DataFrame:
    """trial_id, path of every file in ``root``/*/ whose name contains the tag; folders with an excluded part in their name are left out."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*{tag}*").load(f"{root}/*").select("path")
    folder, name = _parts(F.col("path"))
    found = listed.select(folder.alias("trial_id"), "path", name.alias("name"))
    for part in exclude:
        found = found.where(~F.contains("trial_id", F.lit(part)))
    return found


def pick_trial_file(files: DataFrame, exclude: tuple[str, ...] = ("filtered", "omit")) -> DataFrame:
    """The first file, by name, of each trial whose name has none of the excluded parts (case counts)."""
    for part in exclude:
        files = files.where(~F.contains("name", F.lit(part)))
    first = F.row_number().over(Window.partitionBy("trial_id").orderBy("name", "path"))
    return files.withColumn("_k", first).where("_k = 1").drop("_k")


#: A comma outside quotes.
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def header_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, names: the column names in the first line of every file. One row a file; only files' first splits are looked at, once: the index is kept on the executors while it is in use."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"))
    # Lines of a split come in the file's order, so the least number among a file's first split is its first line.
    first = lines.where("_start = 0 AND trim(value) <> ''").withColumn("_at", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "_at").alias("line"))
    cells = F.split(F.regexp_replace("line", "^\ufeff", ""), _COMMA)
    return first.select("path", F.transform(cells, lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")).alias("names")).localCheckpoint()


def _kind(name: str) -> str:
    return "long" if name == "Frame" else "double" if name in RAW_COLUMNS or name in STIMULUS_COLUMNS else "string"


def _by_header(spark: SparkSession, paths: str | list[str], index: DataFrame, wanted: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """trial_id and the wanted columns of all files in one scan; ``wanted``: for each the names it may have in a file, of which the first that is there counts, and its type.

    Every row meets its file's index row, which holds the places of the wanted columns; Spark broadcasts a small index and splits a large file's rows otherwise.
    """
    width = index.agg(F.max(F.size("names"))).first()[0] or 1
    places = F.array(*[F.coalesce(*[F.nullif(F.array_position("names", F.lit(n)), F.lit(0).cast("long")) for n in names]).cast("int") for names, _ in wanted.values()])
    cells = [f"_c{i}" for i in range(width)]
    rows = spark.read.csv(paths, schema=", ".join(f"{c} string" for c in cells), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="")
    rows = rows.select(F.array(*cells).alias("_cells"), F.col("_metadata.file_path").alias("path")).join(index.select("path", "names", places.alias("_places")), "path")
    # A header is no row: its cells are the names themselves.
    shown = F.transform(F.slice("_cells", 1, F.size("names")), lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^\ufeff", ""))
    rows = rows.where(shown != F.col("names"))
    picked = [F.get("_cells", F.get("_places", F.lit(i)) - 1).try_cast(kind).alias(out) for i, (out, (_, kind)) in enumerate(wanted.items())]
    return rows.select(*picked, _parts(F.col("path"))[0].alias("trial_id"))


def read_track_csv(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Files with a header each, read by the names in it: files may differ in the order and the number of their columns. Adds trial_id (the folder).

    ``columns``: the names to read; by default all that any file has, known ones first. A column that a file lacks is null there; empty, blank and malformed
    cells are missing. Of a repeated name the first counts. Files of a header alone have no row.
    """
    index = header_index(spark, paths)
    if columns is None:
        found = {r[0] for r in index.select(F.explode("names").alias("n")).where("n <> ''").distinct().collect()}  # names of columns, not of files
        known = [c for c in ["Frame", *RAW_COLUMNS, *STIMULUS_COLUMNS] if c in found]
        columns = known + sorted(found - set(known))
    return _by_header(spark, paths, index, {c: ((c,), _kind(c)) for c in columns})


def pick_stimulus(frames: DataFrame) -> DataFrame:
    """The first of the stimulus columns that is there becomes ``stimulus``; without one there is none."""
    found = [c for c in STIMULUS_COLUMNS if c in frames.columns]
    return frames.withColumnRenamed(found[0], "stimulus").drop(*found[1:]) if found else frames


def canonical(raw: DataFrame) -> DataFrame:
    """Raw column names to those used here; frame counts from 0 in each trial; NaN becomes null."""
    named = pick_stimulus(raw.withColumnsRenamed({k: v for k, v in RAW_COLUMNS.items() if k in raw.columns}))
    numbers = [c for c in [*POSITIONS, *BOX, "stimulus"] if c in named.columns]
    named = named.withColumn("frame", (F.row_number().over(Window.partitionBy("trial_id").orderBy("Frame")) - 1).cast("long")) if "Frame" in named.columns else named
    return named.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in numbers}).select("trial_id", "frame", *numbers)


def _moved(frames: DataFrame, trials: DataFrame, move) -> DataFrame:
    """``trials`` has one row a trial; Spark broadcasts it if it is small, else joins by shuffle."""
    names = [c for c in [*POSITIONS, *BOX] if c in frames.columns]
    met = frames.join(trials.select("trial_id", "ppmm", "source_x", "source_y"), "trial_id")
    return met.withColumns({c: move(F.col(c), F.col(f"source_{c[0]}"), F.col("ppmm")) for c in names}).select(*frames.columns)


def to_mm(frames: DataFrame, trials: DataFrame) -> DataFrame:
    return _moved(frames, trials, lambda c, source, ppmm: (c - source) / ppmm)


def to_pixels(frames: DataFrame, trials: DataFrame) -> DataFrame:
    return _moved(frames, trials, lambda c, source, ppmm: c * ppmm + source)


def load_tracks(spark: SparkSession, paths: str | list[str], trials: DataFrame | None = None) -> DataFrame:
    """Canonical frames of raw files of any layouts, in mm if trials are given. The stimulus of each file is the first of the stimulus columns that it has."""
    index = header_index(spark, paths)
    found = {r[0] for r in index.select(F.explode("names").alias("n")).where(F.col("n").isin("Frame", *RAW_COLUMNS, *STIMULUS_COLUMNS)).distinct().collect()}
    wanted = {new: ((raw,), "double") for raw, new in RAW_COLUMNS.items() if raw in found}
    if found & set(STIMULUS_COLUMNS):
        wanted["stimulus"] = (tuple(STIMULUS_COLUMNS), "double")
    frames = canonical(_by_header(spark, paths, index, {"Frame": (("Frame",), "long")} | wanted))
    return to_mm(frames, trials) if trials is not None else frames


def merged_settings(base: DataFrame, updated: DataFrame, source_in_mm: bool = False) -> DataFrame:
    """trial_id, fps, ppmm, source_x, source_y: an updated file overrides the pixels per mm alone; a source defaults to (0, 0)."""
    new = updated.select("trial_id", F.col("Pixel per mm").alias("_ppmm"))
    met = base.join(new, "trial_id", "left").withColumn("ppmm", F.coalesce("_ppmm", "Pixel per mm"))
    scale = F.col("ppmm") if source_in_mm else F.lit(1.0)
    return met.select("trial_id", F.col("Framerate").alias("fps"), "ppmm", *[(F.coalesce(F.col(f"Source {a}"), F.lit(0.0)) / scale).alias(f"source_{a}") for a in "xy"])


def load_settings(spark: SparkSession, root: str, source_in_mm: bool = False, base: str = SETTINGS, updated: str = UPDATED) -> DataFrame:
    """Settings of every trial folder of a root, from one file each; ``base`` and ``updated`` are the files' names or patterns of them."""

    def read(name: str) -> DataFrame:
        rows = spark.read.option("pathGlobFilter", name).json(f"{root}/*", schema=_SETTINGS_SCHEMA, multiLine=True)
        return rows.select("*", _parts(F.col("_metadata.file_path"))[0].alias("trial_id"))

    return merged_settings(read(base), read(updated), source_in_mm)


def trial_fps(trials: DataFrame) -> DataFrame:
    """Frame rate of the first trial."""
    return trials.orderBy("trial_id").limit(1).select("fps")


def read_analysis(spark: SparkSession, path: str) -> DataFrame:
    """A derived table with a header; numbers as doubles."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="")
    return raw.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in raw.columns])


def stimulus_sequence(frames: DataFrame) -> DataFrame:
    """frame and stimulus of the first trial."""
    first = frames.agg(F.min("trial_id").alias("trial_id"))
    return frames.join(F.broadcast(first), "trial_id").select("frame", "stimulus")


def import_distance(frames: DataFrame, distances: DataFrame) -> DataFrame:
    """Distances by camera position (trial_id, pos, distance) set beside the frames, which begin at start_frame (column of frames)."""
    at = distances.select("trial_id", F.col("pos").alias("_pos"), "distance")
    return frames.withColumn("_pos", F.col("frame") + F.col("start_frame")).join(at, ["trial_id", "_pos"], "left").drop("_pos")


def export_tracks(raw: DataFrame, corrected: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """Raw rows with their position columns replaced by corrected ones, in pixels if trials are given; other columns stay.

    raw: columns as in the file, trial_id, frame.
    """
    done = to_pixels(corrected, trials) if trials is not None else corrected
    back = {v: k for k, v in RAW_COLUMNS.items() if v in done.columns and k in raw.columns}
    new = done.select("trial_id", "frame", *[F.col(c).alias(f"_{c}") for c in back])
    met = raw.join(new, ["trial_id", "frame"], "left")
    return met.select(*[F.col(f"_{RAW_COLUMNS[c]}").alias(c) if c in back.values() else F.col(f"`{c}`") for c in raw.columns])


def by_folder(rows: DataFrame, order: str | None = None) -> DataFrameWriter:
    """A writer of one folder with one file a trial, in the order of a column.

    The number of tasks is given, as files cost more than rows and Spark would put a small table into one task. Tasks put their files in place themselves, not the driver when all are done.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "trial_id").sortWithinPartitions("trial_id", *[order] if order else [])
    return dealt.write.partitionBy("trial_id").option("mapreduce.fileoutputcommitter.algorithm.version", "2")


def write_tracks(rows: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> None:
    """One folder a trial, with one file in the order of the frames."""
    writer = by_folder(rows, next((c for c in ("Frame", "frame") if c in rows.columns), None)).mode(mode)
    writer.csv(path, header=True) if kind == "csv" else writer.parquet(path)


def export_segments(segments: DataFrame, path: str) -> None:
    segments.write.mode("overwrite").json(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="trial_id string, start_frame long, end_frame long")
