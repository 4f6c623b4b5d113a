"""Queries of interval and set algebra and of aggregations over segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import orientation
from ..functions.kinematics import speed
from ..operators import flags
from ..operators import intervals as iv
from ..operators import segments as seg
from .fixture import SQL, pose
from .frames import _WRAP as WRAP
from .frames import COUNTED, MH, TM, d2, d3, r6, s6, sql_angle, sql_norm
from .registry import ORACLES, register

# Flags: frames of overlap (ov) and of stimulus (st). Pieces: runs without overlap.
SETS = f"""{SQL},
ov AS (SELECT trial_id, frame FROM pose WHERE xhead = xtail AND yhead = ytail),
st AS (SELECT trial_id, frame FROM pose WHERE stimulus > 0),
rest AS (SELECT trial_id, frame FROM pose WHERE NOT (xhead = xtail AND yhead = ytail))"""


def sql_runs(source: str) -> str:
    return f"(SELECT trial_id, min(frame) AS start_frame, max(frame) AS end_frame FROM (SELECT trial_id, frame, frame - row_number() OVER (PARTITION BY trial_id ORDER BY frame) AS i FROM (SELECT DISTINCT trial_id, frame FROM {source})) GROUP BY trial_id, i)"


RUNS, LIT, PIECES = sql_runs("ov"), sql_runs("st"), sql_runs("rest")


def over(frames: DataFrame) -> DataFrame:
    return flags.flag_overlaps(frames)


def lit(frames: DataFrame) -> DataFrame:
    return frames.where("stimulus > 0").select("trial_id", "frame")


def lengths(frames: DataFrame) -> DataFrame:
    return frames.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"))


def pieces(frames: DataFrame) -> DataFrame:
    return iv.invert_ranges(iv.consecutive_ranges(over(frames)), lengths(frames))


def _query(name: str, build, sql: str | None) -> None:
    register(name, sql and f"{SETS} {sql}")(lambda spark, sf_dir: build(pose(spark, sf_dir)))


def _text(frames: DataFrame) -> DataFrame:
    return frames.select("trial_id", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


_query("consecutive_ranges", lambda f: iv.consecutive_ranges(over(f)), f"SELECT * FROM {RUNS}")
_query("consecutive_values", lambda f: _text(iv.consecutive_values(over(f))), f"SELECT trial_id, array_to_string(range(start_frame, end_frame + 1), ',') AS frames FROM {RUNS}")
_query("value_segments", lambda f: iv.value_segments(f, F.col("stimulus") == 100), "SELECT * FROM " + sql_runs("(SELECT * FROM pose WHERE stimulus = 100)"))
_query("ranges_to_list", lambda f: iv.ranges_to_list(iv.consecutive_ranges(over(f))), "SELECT * FROM ov")
_query("ranges_to_edges", lambda f: iv.ranges_to_edges(iv.consecutive_ranges(over(f))), f"SELECT trial_id, start_frame AS frame FROM {RUNS} UNION SELECT trial_id, end_frame + 1 FROM {RUNS}")
_query("invert_ranges", pieces, f"SELECT * FROM {PIECES}")
_query("fuse_ranges", lambda f: iv.fuse_ranges(iv.consecutive_ranges(over(f)), iv.consecutive_ranges(lit(f))), "SELECT * FROM " + sql_runs("(SELECT * FROM ov UNION SELECT * FROM st)"))
_query("filter_ranges", lambda f: iv.filter_ranges(iv.consecutive_ranges(lit(f)), iv.consecutive_ranges(over(f))), "SELECT * FROM " + sql_runs("(SELECT * FROM st EXCEPT SELECT * FROM ov)"))
_query("segment_lengths", lambda f: iv.segment_lengths(iv.consecutive_ranges(over(f)), True), f"SELECT *, end_frame - start_frame + 1 AS length FROM {RUNS}")
_query("segments_of_length", lambda f: iv.segments_of_length(iv.consecutive_ranges(over(f)), 2, 4, True), f"SELECT * FROM {RUNS} WHERE end_frame - start_frame + 1 IN (2, 3)")
_query("index_steps", lambda f: iv.index_steps(over(f)), f"SELECT trial_id, start_frame, end_frame - start_frame AS steps FROM {RUNS}")
_CUTS = "SELECT trial_id, frame FROM ov UNION SELECT DISTINCT trial_id, 0 FROM pose UNION SELECT trial_id, count(*) FROM pose GROUP BY trial_id"
_CUT = f"(SELECT trial_id, frame AS start_frame, lead(frame) OVER (PARTITION BY trial_id ORDER BY frame) AS end_frame, row_number() OVER (PARTITION BY trial_id ORDER BY frame) AS k FROM ({_CUTS}))"
_query("indices_to_segments", lambda f: iv.indices_to_segments(over(f), lengths(f), alternating=True), f"SELECT trial_id, start_frame, end_frame FROM {_CUT} WHERE end_frame IS NOT NULL AND k % 2 = 0")
_query("intervals", lambda f: _text(iv.intervals(over(f), lengths(f))), f"SELECT trial_id, array_to_string(range(start_frame, end_frame), ',') AS frames FROM {_CUT} WHERE end_frame IS NOT NULL")
_query("merge_flags", lambda f: iv.merge_flags(over(f), lit(f)), "SELECT * FROM ov UNION SELECT * FROM st")
_query("filter_flags", lambda f: iv.filter_flags(over(f), lit(f)), "SELECT * FROM ov EXCEPT SELECT * FROM st")
_query("match_flags", lambda f: iv.match_flags(over(f), lit(f)), "SELECT * FROM ov INTERSECT SELECT * FROM st")
_query("mismatch_flags", lambda f: iv.mismatch_flags(over(f), lit(f)), "(SELECT * FROM ov EXCEPT SELECT * FROM st) UNION (SELECT * FROM st EXCEPT SELECT * FROM ov)")


def _samples(frames: DataFrame) -> DataFrame:
    rows = frames.groupBy("trial_id", F.floor(F.col("frame") / 100).alias("sample")).agg(F.sort_array(F.collect_list(F.struct("frame", "xctr"))).alias("r"))
    return rows.select("trial_id", "sample", F.col("r.xctr").alias("values"))


_query("flatten_samples", lambda f: iv.flatten_samples(_samples(f)), "SELECT trial_id, row_number() OVER (PARTITION BY trial_id ORDER BY frame) - 1 AS position, xctr AS value FROM pose")

# Segments: the pieces, as half-open slices. v: frames with the values that the metrics use.
SEGS = f"""{SETS},
seg AS (SELECT * FROM {PIECES}),
v AS (SELECT *, {sql_norm(d2("xhead"), d2("yhead"))} AS hs, {sql_norm(d2("xtail"), d2("ytail"))} AS ts, {sql_norm(d2("xctr"), d2("yctr"))} AS cs,
 {sql_angle(TM, (d3("xtail"), d3("ytail")))} AS align, {sql_angle(TM, MH)} AS ha,
 CASE WHEN frame < n - 1 THEN {sql_norm(d2("xmid"), d2("ymid"))} END AS md, CASE WHEN frame < n - 1 THEN {sql_norm(d2("xhead"), d2("yhead"))} END AS hd, CASE WHEN frame < n - 1 THEN {sql_norm(d2("xtail"), d2("ytail"))} END AS td FROM {COUNTED})"""
IN = "LEFT JOIN v ON v.trial_id = s.trial_id AND v.frame >= s.start_frame AND v.frame < s.end_frame"
S = "s.trial_id, s.start_frame, s.end_frame"


def _segments(name: str, build, sql: str | None) -> None:
    register(name, sql and f"{SEGS} {sql}")(lambda spark, sf_dir: build(pose(spark, sf_dir)))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


_segments(
    "metrics_by_segment",
    lambda f: _rounded(seg.metrics_by_segment(f, pieces(f), speed("head"), 1), "mean", "std", "median"),
    f"SELECT {S}, {s6('avg(v.hs)')} AS mean, {s6('stddev_pop(v.hs)')} AS std, {s6('median(v.hs)')} AS median FROM seg s LEFT JOIN v ON v.trial_id = s.trial_id AND v.frame >= s.start_frame + 1 AND v.frame < s.end_frame - 1 GROUP BY ALL",
)
_segments(
    "cross_segment_delta_2d",
    lambda f: _rounded(seg.cross_segment_delta_2d(f, pieces(f), "head", "tail", 1), "delta"),
    f"SELECT {S}, {s6('sqrt((b.xtail-a.xhead)*(b.xtail-a.xhead)+(b.ytail-a.yhead)*(b.ytail-a.yhead))')} AS delta FROM seg s LEFT JOIN pose a ON a.trial_id=s.trial_id AND a.frame=s.start_frame-1 LEFT JOIN pose b ON b.trial_id=s.trial_id AND b.frame=s.end_frame+1",
)
_segments(
    "cross_segment_delta_1d",
    lambda f: seg.cross_segment_delta_1d(f, pieces(f), "xctr", 1, True),
    f"SELECT {S}, abs(b.xctr - a.xctr) AS delta FROM seg s LEFT JOIN pose a ON a.trial_id=s.trial_id AND a.frame=s.start_frame-1 LEFT JOIN pose b ON b.trial_id=s.trial_id AND b.frame=s.end_frame+1",
)
_TURNED = f"""tu AS MATERIALIZED (SELECT trial_id, frame, angle + sum(step) OVER (PARTITION BY trial_id ORDER BY frame) AS angle FROM {WRAP})"""
for _name, _chunk in (("cross_segment_delta_angular", None), ("cross_segment_delta_angular_chunked", 100)):
    _segments(
        _name,
        lambda f, chunk=_chunk: _rounded(seg.cross_segment_delta_1d(f.withColumn("turn", orientation(half=False)), pieces(f), "turn", 1, angular=True, chunk=chunk), "delta"),
        f"SELECT {S}, {s6('b.angle - a.angle')} AS delta FROM seg s LEFT JOIN tu a ON a.trial_id=s.trial_id AND a.frame=s.start_frame-1 LEFT JOIN tu b ON b.trial_id=s.trial_id AND b.frame=s.end_frame+1",
    )
    ORACLES[_name] = ORACLES[_name].replace(", ov AS", f", {_TURNED}, ov AS", 1).replace(",\nov AS", f",\n{_TURNED},\nov AS", 1)
_segments("segment_distance", lambda f: _rounded(seg.segment_distance(f, pieces(f)), "dist"), f"SELECT {S}, {s6('coalesce(sum(v.md), 0)')} AS dist FROM seg s {IN} GROUP BY ALL")
_segments(
    "segment_distance_combined",
    lambda f: _rounded(seg.segment_distance(f, pieces(f), "mid", 3, True), "dist"),
    f"SELECT trial_id, start_frame, end_frame, {s6('median(d)')} AS dist FROM (SELECT {S}, j.j, coalesce(sum(v.md), 0) AS d FROM seg s CROSS JOIN (VALUES (0), (1), (2)) j(j) LEFT JOIN v ON v.trial_id = s.trial_id AND v.frame >= s.start_frame AND v.frame < s.end_frame AND (v.frame - s.start_frame) % 3 = j.j GROUP BY ALL) GROUP BY ALL",
)
_segments(
    "segment_tortuosity",
    lambda f: _rounded(seg.segment_tortuosity(f, pieces(f)), "tortuosity"),
    f"""SELECT trial_id, start_frame, end_frame, {s6("dist / CASE WHEN net = 0 THEN 1e-4 ELSE net END")} AS tortuosity FROM (
 SELECT {S}, coalesce(sum(v.md), 0) AS dist, max(sqrt((b.xmid-a.xmid)*(b.xmid-a.xmid)+(b.ymid-a.ymid)*(b.ymid-a.ymid))) AS net FROM seg s {IN}
 LEFT JOIN pose a ON a.trial_id=s.trial_id AND a.frame=s.start_frame LEFT JOIN pose b ON b.trial_id=s.trial_id AND b.frame=s.end_frame-1 GROUP BY ALL)""",
)
_segments("travel_distance_ratio", lambda f: _rounded(seg.travel_distance_ratio(f, pieces(f)), "ratio"), f"SELECT {S}, {s6('coalesce(sum(v.hd), 0) / (coalesce(sum(v.td), 0) + 1e-3)')} AS ratio FROM seg s {IN} GROUP BY ALL")
RATIO = f"SELECT {S}, CASE WHEN count(v.hs) = 0 THEN 1 ELSE avg(v.hs) / nullif(avg(v.ts), 0) END AS ratio, least(count(v.hs), count(v.ts)) AS n FROM seg s {IN} GROUP BY ALL"
_segments("speed_ratio", lambda f: _rounded(seg.speed_ratio(f, pieces(f)), "ratio"), f"SELECT trial_id, start_frame, end_frame, {s6('ratio')} AS ratio, n FROM ({RATIO})")
_segments("alignment_angle", lambda f: _rounded(seg.alignment_angle(f, pieces(f)), "angle"), f"SELECT {S}, {s6('avg(v.align)')} AS angle FROM seg s {IN} GROUP BY ALL")
_RUN = "v.cs * 30 > 20 AND v.ha < pi()/4"
_segments(
    "run_alignment_angle",
    lambda f: _rounded(seg.run_alignment_angle(f, pieces(f), 30, 2, 20), "angle"),
    f"SELECT {S}, {s6(f'CASE WHEN count_if({_RUN}) > 2 THEN sum(CASE WHEN {_RUN} THEN v.align END) / count_if({_RUN}) END')} AS angle FROM seg s LEFT JOIN v ON v.trial_id = s.trial_id AND v.frame BETWEEN s.start_frame AND s.end_frame GROUP BY ALL",
)
FLAG = f"SELECT trial_id, start_frame, end_frame, CASE WHEN n >= 4 AND round(ratio, 9) < 0.95 THEN 1 WHEN n >= 4 AND round(ratio, 9) > 1.05 THEN -1 ELSE 0 END AS flag FROM ({RATIO})"


def flagged(frames: DataFrame) -> DataFrame:
    ratio = seg.speed_ratio(frames, pieces(frames))
    return ratio.select(*seg.KEYS, seg.flag_segment_metric(F.round("ratio", 9), F.col("n"), 0.95, 1.05, 4).alias("flag"))


_segments("flag_segment_metric", flagged, FLAG)
_B = "coalesce(last_value(nullif(flag, 0) IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY start_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {})"
_A = "coalesce(first_value(nullif(flag, 0) IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY start_frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)"
_segments("fill_ambiguous_following", lambda f: flagged(f).withColumn("fill", seg.fill_ambiguous_following()), f"SELECT *, CASE WHEN flag = 0 THEN {_B.format(_A)} ELSE 0 END AS fill FROM ({FLAG})")
_segments("merge_ambiguous", lambda f: flagged(f).withColumn("fill", seg.merge_ambiguous()), f"SELECT *, CAST(CASE WHEN flag = 0 THEN sign({_B.format(0)} + {_A}) ELSE 0 END AS INT) AS fill FROM ({FLAG})")
