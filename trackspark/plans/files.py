"""Queries of the transforms around track files, over tables that stand for what the files hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.correct import remove_edge_frames
from ..operators.intervals import consecutive_ranges
from ..schema import POSITIONS, RAW_COLUMNS
from ..scratch import scratch
from ..sources import tracks
from .corrections import EDGE
from .fixture import SQL, pose, trials
from .frames import s6
from .ranges import sql_runs
from .registry import register

_BACK = {v: k for k, v in RAW_COLUMNS.items()}


def raw_table(frames: DataFrame, stimulus: str = "Stim Ch1") -> DataFrame:
    """The fixture with a raw file's column names; Frame starts at 5, and a note column is one that no operator knows."""
    return frames.select("trial_id", (F.col("frame") + 5).alias("Frame"), *[F.col(c).alias(_BACK[c]) for c in POSITIONS], F.col("stimulus").alias(stimulus), F.concat(F.lit("n"), F.col("frame")).alias("note"))


_MM = ", ".join(f"(p.{c} - source_{c[0]}) / ppmm AS {c}" for c in POSITIONS)


def mixed_files(spark: SparkSession, sf_dir: str) -> str:
    """The fixture as one folder of CSV files a trial, in two layouts: odd trials have their columns in reverse, the stimulus under its other name, and no notes."""
    root, own = scratch(spark, "trials"), pose(spark, sf_dir)
    plain, other = raw_table(own.where("trial_id % 2 = 0")), raw_table(own.where("trial_id % 2 = 1"), "stimulation").drop("note")
    for rows in (plain, other.select(*reversed(other.columns))):
        tracks.write_tracks(rows, root, mode="append")
    return root


def settings_files(spark: SparkSession, sf_dir: str) -> str:
    """The fixture's settings as JSON files, one or two in each trial's folder; the updated ones are compressed, which tells their names apart."""
    root = scratch(spark, "settings")
    for rows, codec in zip(_settings(trials(spark, sf_dir)), (None, "gzip")):
        tracks.by_folder(rows).mode("append").json(root, compression=codec)
    return root


@register("load_tracks", f"{SQL} SELECT 'trial_id=' || trial_id AS trial_id, frame, {_MM}, stimulus FROM pose p JOIN trials USING (trial_id)")
def load_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two layouts in one call, set to mm."""
    settings = trials(spark, sf_dir).withColumn("trial_id", F.concat(F.lit("trial_id="), "trial_id"))
    return tracks.load_tracks(spark, f"{mixed_files(spark, sf_dir)}/*", settings)


@register("pick_stimulus", f"{SQL} SELECT trial_id, frame, stimulus FROM pose")
def pick_stimulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pose(spark, sf_dir).select("trial_id", "frame", F.col("stimulus").alias("stimulation"), (-F.col("stimulus")).alias("Stim Ch1"))
    return tracks.pick_stimulus(both)


def _settings(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = own.select("trial_id", F.col("fps").alias("Framerate"), F.lit(4.0).alias("Pixel per mm"), F.when(F.col("trial_id") % 3 > 0, F.col("source_x")).alias("Source x"), F.when(F.col("trial_id") % 3 > 0, F.col("source_y")).alias("Source y"))
    return base, own.where("trial_id % 2 = 0").select("trial_id", F.col("ppmm").alias("Pixel per mm"))


_PPMM = "CASE WHEN trial_id % 2 = 0 THEN ppmm ELSE 4 END"


@register("load_settings", f"{SQL} SELECT 'trial_id=' || trial_id AS trial_id, fps, CAST({_PPMM} AS DOUBLE) AS ppmm, CASE WHEN trial_id % 3 > 0 THEN source_x ELSE 0 END / {_PPMM} AS source_x, CASE WHEN trial_id % 3 > 0 THEN source_y ELSE 0 END / {_PPMM} AS source_y FROM trials")
def load_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.load_settings(spark, settings_files(spark, sf_dir), True, "*.json", "*.json.gz")


@register("trial_fps", f"{SQL} SELECT fps FROM trials ORDER BY trial_id LIMIT 1")
def trial_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.trial_fps(trials(spark, sf_dir))


@register("stimulus_sequence", f"{SQL} SELECT frame, stimulus FROM pose WHERE trial_id = (SELECT min(trial_id) FROM pose)")
def stimulus_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.stimulus_sequence(pose(spark, sf_dir))


@register("import_distance", f"{SQL} SELECT a.trial_id, a.frame, b.xctr AS distance FROM pose a LEFT JOIN pose b ON b.trial_id = a.trial_id AND b.frame = a.frame + 5")
def import_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pose(spark, sf_dir)
    distances = own.select("trial_id", F.col("frame").alias("pos"), F.col("xctr").alias("distance"))
    return tracks.import_distance(own.select("trial_id", "frame", F.lit(5).alias("start_frame")), distances).select("trial_id", "frame", "distance")


_PX = ", ".join(f'{s6(f"d.{c} * ppmm + source_{c[0]}")} AS "{_BACK[c]}"' for c in POSITIONS)


@register("export_tracks", f"""{SQL}{EDGE.replace("FROM pose", "FROM mm").replace(", edge AS", ", mm AS (SELECT p.trial_id, frame, " + _MM + ", stimulus FROM pose p JOIN trials USING (trial_id)), edge AS")} SELECT trial_id, frame, frame + 5 AS pos, {_PX}, p.stimulus AS "Stim Ch1", 'n' || frame AS note FROM pose p JOIN edge d USING (trial_id, frame) JOIN trials USING (trial_id)""")
def export_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, settings = pose(spark, sf_dir), trials(spark, sf_dir)
    raw = raw_table(own).withColumnRenamed("Frame", "pos").withColumn("frame", F.col("pos") - 5)
    done = tracks.export_tracks(raw, remove_edge_frames(tracks.to_mm(own, settings)), settings)
    return done.withColumns({_BACK[c]: F.round(F.col(f"`{_BACK[c]}`"), 6) + F.lit(0.0) for c in POSITIONS})


def trial_files(spark: SparkSession, sf_dir: str) -> str:
    """The fixture as one folder of CSV files a trial, named trial_id=<number>."""
    root = scratch(spark, "trials")
    tracks.write_tracks(raw_table(pose(spark, sf_dir)), root)
    return root


# Folders whose name ends in 7 stand for those that a user leaves out.
_LEFT_OUT = ("7",)


@register("scan_trials", f"{SQL} SELECT DISTINCT 'trial_id=' || trial_id AS trial_id, TRUE AS is_csv FROM pose WHERE CAST(trial_id AS VARCHAR) NOT LIKE '%7%'")
def scan_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.scan_trials(spark, trial_files(spark, sf_dir), tag=".csv", exclude=_LEFT_OUT)
    return found.select("trial_id", F.endswith("name", F.lit(".csv")).alias("is_csv"))


@register("pick_trial_file", f"{SQL} SELECT 'trial_id=' || trial_id AS trial_id, count(*) AS files, min(CASE WHEN trial_id % 2 = 0 THEN 'a' ELSE 'b' END || '_data.csv') AS name FROM (SELECT DISTINCT trial_id FROM pose) GROUP BY trial_id")
def pick_trial_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three names for every scanned folder, of which one is of a filtered file and one, in every second folder, sorts first."""
    found = tracks.scan_trials(spark, trial_files(spark, sf_dir), tag=".csv", exclude=())
    even = F.regexp_extract("trial_id", "[0-9]+$", 0).cast("long") % 2 == 0
    names = F.array(F.lit("b_data.csv"), F.lit("a_filtered.csv"), F.when(even, F.lit("a_data.csv")).otherwise(F.lit("c_data.csv")))
    picked = tracks.pick_trial_file(found.withColumn("name", F.explode(names)))
    return picked.groupBy("trial_id").agg(F.count(F.lit(1)).alias("files"), F.min("name").alias("name"))


_RAW = ", ".join(f'{c} AS "{_BACK[c]}"' for c in POSITIONS)


@register(
    "read_track_csv",
    f"""{SQL} SELECT 'trial_id=' || trial_id AS trial_id, frame + 5 AS "Frame", {_RAW}, CASE WHEN trial_id % 2 = 1 THEN stimulus END AS "stimulation", CASE WHEN trial_id % 2 = 0 THEN stimulus END AS "Stim Ch1", CASE WHEN trial_id % 2 = 0 THEN 'n' || frame END AS note FROM pose""",
)
def read_track_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two layouts in one call, each read by its own header."""
    return tracks.read_track_csv(spark, f"{mixed_files(spark, sf_dir)}/*")


@register("read_analysis", f"{SQL} SELECT CAST(trial_id AS DOUBLE) AS trial_id, CAST(frame AS DOUBLE) AS frame, CASE WHEN frame > 0 THEN xctr END AS x, CAST(NULL AS DOUBLE) AS note FROM pose")
def read_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived table with a gap and a column of words, written and read."""
    path = scratch(spark, "analysis")
    pose(spark, sf_dir).select("trial_id", "frame", F.when(F.col("frame") > 0, F.col("xctr")).alias("x"), F.lit("word").alias("note")).write.csv(path, header=True)
    return tracks.read_analysis(spark, path)


@register("export_segments", f"{SQL} SELECT CAST(trial_id AS VARCHAR) AS trial_id, start_frame, end_frame FROM {sql_runs('(SELECT * FROM pose WHERE stimulus > 0)')}")
def export_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "segments")
    tracks.export_segments(consecutive_ranges(pose(spark, sf_dir).where("stimulus > 0")), path)
    return tracks.read_segments(spark, path)
