"""Queries over single frames and neighbours: geometry, kinematics, flags, stops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import kinematics as k
from ..operators import activity, flags
from ..schema import xy
from .fixture import SQL, pose, trials
from .registry import register

KEYS = ["trial_id", "frame"]
W_SQL = "(PARTITION BY trial_id ORDER BY frame)"


def r6(c: Column) -> Column:
    """Six decimals, without negative zeros."""
    return F.round(c, 6) + F.lit(0.0)


def s6(sql: str) -> str:
    return f"(round({sql}, 6) + CAST(0 AS DOUBLE))"


def sql_norm(x: str, y: str) -> str:
    return f"sqrt(({x})*({x}) + ({y})*({y}))"


def sql_angle(a: tuple[str, str], b: tuple[str, str], half: bool = True) -> str:
    """Angle of two vectors by their units; a zero vector is a unit of zeros."""
    (ax, ay), (bx, by) = a, b
    na, nb = sql_norm(ax, ay), sql_norm(bx, by)
    unit = lambda c, n: f"(CASE WHEN {n} = 0 THEN CAST(0 AS DOUBLE) ELSE ({c})/{n} END)"
    dot = f"({unit(ax, na)}*{unit(bx, nb)} + {unit(ay, na)}*{unit(by, nb)})"
    full = f"(CASE WHEN {dot} IS NULL THEN NULL ELSE acos(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), {dot}))) END)"
    return full if half else f"({full} * CAST(sign(({ax})*({by}) - ({ay})*({bx})) AS DOUBLE))"


TM, MH = ("xmid-xtail", "ymid-ytail"), ("xhead-xmid", "yhead-ymid")
ONE = ("CAST(1 AS DOUBLE)", "CAST(0 AS DOUBLE)")
CROSS = f"CAST(sign(({TM[0]})*({MH[1]}) - ({TM[1]})*({MH[0]})) AS DOUBLE)"


def frame_query(name: str, build, sql: dict[str, str], exact: bool = False, source: str = "pose", where: str = "") -> None:
    """``build`` gives the columns; ``sql`` their DuckDB text over ``source``."""
    body = ", ".join(f"{v if exact else s6(v)} AS {c}" for c, v in sql.items())

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = dict(zip(sql, build()))
        return pose(spark, sf_dir).select(*KEYS, *[(c if exact else r6(c)).alias(n) for n, c in columns.items()])

    register(name, f"{SQL} SELECT trial_id, frame, {body} FROM {source}{where}")(query)


# Geometry
frame_query("keypoint_xy", lambda: [*xy("head")], {"x": "xhead", "y": "yhead"}, True)
frame_query("vector_between", lambda: [*g.vector_between("head", "tail")], {"vx": "xtail-xhead", "vy": "ytail-yhead"}, True)
frame_query("orientation_vector", lambda: [*g.body(), *g.body(True)], {"bx": TM[0], "by": TM[1], "hx": MH[0], "hy": MH[1]}, True)
_N = sql_norm(*TM)
frame_query("unit_vector", lambda: [*g.unit_vector(g.body())], {"ux": f"CASE WHEN {_N}=0 THEN 0 ELSE ({TM[0]})/{_N} END", "uy": f"CASE WHEN {_N}=0 THEN 0 ELSE ({TM[1]})/{_N} END"})
frame_query("vector_angle", lambda: [g.vector_angle(g.body(), g.body(True)), g.vector_angle(g.body(), g.body(True), False, True)], {"half": sql_angle(TM, MH), "signed": f"degrees({sql_angle(TM, MH, False)})"})
frame_query("cross_sign", lambda: [g.cross_sign(g.vector_between("head", "ctr"), g.vector_between("tail", "ctr"))], {"side": "CAST(sign((xctr-xhead)*(yctr-ytail) - (yctr-yhead)*(xctr-xtail)) AS DOUBLE)"}, True)
frame_query("ht_cross_sign", lambda: [g.ht_cross_sign()], {"side": CROSS}, True)
frame_query("head_angle", lambda: [g.head_angle()], {"angle": sql_angle(TM, MH, False)})
frame_query("orientation", lambda: [g.orientation(), g.orientation(half=False, head=True)], {"half": sql_angle(ONE, TM), "signed": sql_angle(ONE, MH, False)})
frame_query("custom_orientation", lambda: [g.custom_orientation("tail", "head", (0.0, 1.0))], {"angle": sql_angle((ONE[1], ONE[0]), ("xhead-xtail", "yhead-ytail"))})
frame_query("distance_from_origin", lambda: [g.distance_from("ctr", 640, 480)], {"distance": sql_norm("xctr-640", "yctr-480")})
frame_query("delta_in_frame", lambda: [g.delta_in_frame("head", "tail")], {"delta": sql_norm("xtail-xhead", "ytail-yhead")})
frame_query("perfect_overlap", lambda: [g.overlaps("head", "tail")], {"overlap": "(xhead=xtail AND yhead=ytail)"}, True)
frame_query("time_axis", lambda: [g.time_axis(F.lit(30.0))], {"t": "frame * (n / CAST(30 AS DOUBLE)) / (n - 1)"}, source="(SELECT *, count(*) OVER (PARTITION BY trial_id) AS n FROM pose)")
frame_query("stimulus_scale", lambda: [g.stimulus_scale()], {"scaled": "stimulus / CASE WHEN top = 0 THEN 1 ELSE top END"}, source="(SELECT *, max(stimulus) OVER (PARTITION BY trial_id) AS top FROM pose)")


@register("bearing", f"{SQL} SELECT trial_id, frame, {s6(sql_angle(('source_x-xctr', 'source_y-yctr'), TM))} AS angle FROM pose JOIN trials USING (trial_id)")
def bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = pose(spark, sf_dir).join(trials(spark, sf_dir), "trial_id")
    return met.select(*KEYS, r6(g.bearing((F.col("source_x"), F.col("source_y")))).alias("angle"))


@register("where_frames", f"{SQL} SELECT trial_id, frame FROM pose WHERE stimulus > 0 AND xhead > xtail")
def where_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.where_frames(pose(spark, sf_dir), (F.col("stimulus") > 0) & (F.col("xhead") > F.col("xtail")))


@register("time_slice", f"{SQL} SELECT trial_id, frame, xctr, yctr FROM pose JOIN trials USING (trial_id) WHERE frame >= 2*fps AND frame <= 5*fps - 1")
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = pose(spark, sf_dir).join(trials(spark, sf_dir), "trial_id")
    return g.time_slice(met, 2, 5, F.col("fps")).select(*KEYS, "xctr", "yctr")


@register("first_valid_position", f"{SQL} SELECT trial_id, arg_min(xctr, frame) FILTER (xctr <> 0) AS xctr, arg_min(yctr, frame) FILTER (yctr <> 0) AS yctr FROM pose GROUP BY trial_id")
def first_valid_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = pose(spark, sf_dir).withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in ("xctr", "yctr")})
    return g.first_valid_position(known)


@register("nan_to_zero", f"{SQL} SELECT trial_id, frame, CASE WHEN abs(xhead) > 0 AND xhead <> 640 THEN xhead ELSE 0 END AS x FROM pose")
def nan_to_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("xhead") == 640, F.lit(float("nan"))).when(F.col("xhead") != 0, F.col("xhead"))
    return pose(spark, sf_dir).select(*KEYS, g.nan_to_zero(bad).alias("x"))


@register("round_positions", f"{SQL} SELECT trial_id, frame, round_even(xhead/16*10, 0)/10 AS xhead, round_even(yctr/16*10, 0)/10 AS yctr FROM pose")
def round_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.round_positions(pose(spark, sf_dir).select(*KEYS, (F.col("xhead") / 16).alias("xhead"), (F.col("yctr") / 16).alias("yctr")))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(ref[i] AS DOUBLE)))"
_LEN = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@register("embedding_angle", f"WITH r AS (SELECT embedding AS ref FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(acos(greatest(-1, least(1, {_DOT} / ({_LEN('embedding')} * {_LEN('ref')})))), 4) + CAST(0 AS DOUBLE) AS angle FROM embeddings, r WHERE vec_id > 0")
def embedding_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = vectors.agg(F.min_by("embedding", "vec_id").alias("ref"))
    met = vectors.where("vec_id > 0").join(F.broadcast(first))
    return met.select("vec_id", (F.round(g.array_angle(F.col("embedding"), F.col("ref")), 4) + F.lit(0.0)).alias("angle"))


# Kinematics
def _lag(c: str, n: int = 1) -> str:
    return f"lag({c},{n}) OVER {W_SQL}"


def _lead(c: str, n: int = 1) -> str:
    return f"lead({c},{n}) OVER {W_SQL}"


def d2(c: str) -> str:
    return f"(CASE WHEN frame = n - 1 THEN {c} - {_lag(c)} ELSE {_lead(c)} - {c} END)"


def d3(c: str) -> str:
    return f"(CASE WHEN frame = 0 THEN {_lead(c)} - {c} WHEN frame = n - 1 THEN {c} - {_lag(c)} ELSE ({_lead(c)} - {_lag(c)}) / 2 END)"


def d5(c: str) -> str:
    return f"(CASE WHEN frame > 1 AND frame < n - 2 THEN (-{_lead(c, 2)} + 8*{_lead(c)} - 8*{_lag(c)} + {_lag(c, 2)}) / 12 ELSE {d3(c)} END)"


COUNTED = "(SELECT *, count(*) OVER (PARTITION BY trial_id) AS n FROM pose)"
frame_query("derivative_2pt", lambda: [k.derivative(F.col("xhead"), 2)], {"d": d2("xhead")}, source=COUNTED)
frame_query("derivative_3pt", lambda: [k.derivative(F.col("xhead"), 3)], {"d": d3("xhead")}, source=COUNTED)
frame_query("derivative_5pt", lambda: [k.derivative(F.col("xhead"), 5)], {"d": d5("xhead")}, source=COUNTED)
frame_query("speed", lambda: [k.speed("head", 30)], {"speed": f"{sql_norm(d2('xhead'), d2('yhead'))} * 30"}, source=COUNTED)
frame_query("motion_vector", lambda: [*k.motion_vector("ctr")], {"vx": d3("xctr"), "vy": d3("yctr")}, source=COUNTED)


def sql_way(a: str, b: str) -> str:
    return sql_norm(f"x{b} - {_lag('x' + a)}", f"y{b} - {_lag('y' + a)}")


DELTAS = {n: sql_way(a, b) for n, (a, b) in flags.DELTAS.items()}
frame_query("delta_between_frames", lambda: [k.delta_between("tail", "head", 30)], {"delta": f"{sql_way('tail', 'head')} * 30"})
frame_query("all_deltas", lambda: [k.delta_between(*flags.DELTAS[n]) for n in ("tt", "hh", "th", "ht")], {n: DELTAS[n] for n in ("tt", "hh", "th", "ht")})
frame_query("rolling_mean", lambda: [k.rolling(F.col("xctr"), 9)], {"m": "avg(v) OVER (PARTITION BY trial_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)"}, source="(SELECT *, CASE WHEN frame < count(*) OVER (PARTITION BY trial_id) - 1 THEN xctr END AS v FROM pose)")
frame_query("rolling_median", lambda: [k.rolling(F.col("xctr"), 9, "median")], {"m": "median(v) OVER (PARTITION BY trial_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)"}, source="(SELECT *, CASE WHEN frame < count(*) OVER (PARTITION BY trial_id) - 1 THEN xctr END AS v FROM pose)")

_ANGLED = f"(SELECT trial_id, frame, {sql_angle(ONE, TM)} AS angle FROM pose)"
frame_query("reorientation_rate", lambda: [k.reorientation(g.orientation())], {"rate": f"abs(angle - {_lag('angle')})"}, source=_ANGLED)

_PI = repr(math.pi)
_WRAP = f"""(SELECT trial_id, frame, angle, CASE WHEN d IS NULL OR abs(d) < {_PI} THEN 0 ELSE
 (CASE WHEN wrapped = -{_PI} AND d > 0 THEN {_PI} ELSE wrapped END) - d END AS step FROM (
 SELECT *, ((d + {_PI}) % (2*{_PI}) + 2*{_PI}) % (2*{_PI}) - {_PI} AS wrapped FROM (
 SELECT trial_id, frame, angle, angle - {_lag('angle')} AS d FROM (SELECT trial_id, frame, {sql_angle(ONE, TM, False)} AS angle FROM pose))))"""


@register("unwrap_angle", f"{SQL} SELECT trial_id, frame, {s6(f'angle + sum(step) OVER {W_SQL}')} AS angle FROM {_WRAP}")
def unwrap_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pose(spark, sf_dir).withColumn("signed", g.orientation(half=False))
    return k.unwrapped(made, "signed", "angle").select(*KEYS, r6(F.col("angle")).alias("angle"))


_TORT = f"""(SELECT *, sum(CASE WHEN frame > 0 THEN d END) OVER (PARTITION BY trial_id ORDER BY frame ROWS BETWEEN 14 PRECEDING AND 15 FOLLOWING) AS path,
 {sql_norm('last_value(xmid) OVER win - first_value(xmid) OVER win', 'last_value(ymid) OVER win - first_value(ymid) OVER win')} AS net
 FROM (SELECT *, {sql_way('mid', 'mid')} AS d FROM pose) WINDOW win AS (PARTITION BY trial_id ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING))"""


@register("local_tortuosity", f"{SQL} SELECT trial_id, frame, {s6('path / CASE WHEN net = 0 THEN 1e-4 ELSE net END')} AS tortuosity FROM {_TORT}")
def local_tortuosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.local_tortuosity(pose(spark, sf_dir), 30).select(*KEYS, r6(F.col("tortuosity")).alias("tortuosity"))


_STEPS = """(SELECT a.trial_id, a.frame, sum(CASE WHEN (c.frame - a.lo) % 3 = 0 AND c.frame + 3 <= a.hi THEN sqrt((e.xmid-c.xmid)*(e.xmid-c.xmid) + (e.ymid-c.ymid)*(e.ymid-c.ymid)) END) AS path, max(a.net) AS net
 FROM (SELECT p.trial_id, p.frame, greatest(0, p.frame-3) AS lo, least(p.n-1, p.frame+3) AS hi, sqrt((y.xmid-x.xmid)*(y.xmid-x.xmid) + (y.ymid-x.ymid)*(y.ymid-x.ymid)) AS net
   FROM (SELECT *, count(*) OVER (PARTITION BY trial_id) AS n FROM pose) p JOIN pose x ON x.trial_id=p.trial_id AND x.frame = greatest(0, p.frame-3) JOIN pose y ON y.trial_id=p.trial_id AND y.frame = least(p.n-1, p.frame+3)) a
 JOIN pose c ON c.trial_id = a.trial_id AND c.frame BETWEEN a.lo AND a.hi LEFT JOIN pose e ON e.trial_id = c.trial_id AND e.frame = c.frame + 3 GROUP BY a.trial_id, a.frame)"""


@register("local_tortuosity_step", f"{SQL} SELECT trial_id, frame, {s6('coalesce(path, 0) / CASE WHEN net = 0 THEN 1e-4 ELSE net END')} AS tortuosity FROM {_STEPS}")
def local_tortuosity_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.local_tortuosity(pose(spark, sf_dir), 20, "mid", 3).select(*KEYS, r6(F.col("tortuosity")).alias("tortuosity"))


# Flags
def sql_bent(threshold: float) -> str:
    na, nb = sql_norm(*TM), sql_norm(*MH)
    zero = "TRUE" if math.pi / 2 >= threshold else "FALSE"
    return f"(CASE WHEN {na} = 0 OR {nb} = 0 THEN {zero} ELSE ({TM[0]})*({MH[0]}) + ({TM[1]})*({MH[1]}) <= {math.cos(threshold)!r} * {na} * {nb} END)"


MINI = "tt IS NOT NULL AND hh IS NOT NULL AND th IS NOT NULL AND ht IS NOT NULL AND least(th, ht) < least(tt, hh)"
KIN = f"""
kin AS (SELECT *, {", ".join(f"{v} AS {n}" for n, v in DELTAS.items())}, {CROSS} AS z, {sql_bent(math.pi / 2)} AS v2, {sql_bent(math.pi / 4)} AS v4,
 coalesce(xhead = xtail AND yhead = ytail, FALSE) AS ov, count(*) OVER (PARTITION BY trial_id) AS n FROM pose),
nb AS (SELECT *, lag(z) OVER {W_SQL} AS pz, lag(v2) OVER {W_SQL} AS pv, coalesce(lag(ov) OVER {W_SQL}, FALSE) AS po FROM kin),
runs AS (SELECT trial_id, min(frame) AS a, max(frame) AS b FROM (SELECT trial_id, frame, frame - row_number() OVER {W_SQL} AS i FROM kin WHERE ov) GROUP BY trial_id, i),
outer_ AS (SELECT r.trial_id, r.a, r.b, greatest(r.a - 1, 0) AS oa, least(r.b + 1, m.n - 1) AS ob FROM runs r JOIN (SELECT trial_id, max(n) AS n FROM kin GROUP BY trial_id) m USING (trial_id)),
crossed AS (SELECT o.trial_id, o.ob AS frame, p.z AS az, q.z AS bz, p.v4 AS av, q.v4 AS bv,
 sqrt((q.xtail-p.xtail)*(q.xtail-p.xtail)+(q.ytail-p.ytail)*(q.ytail-p.ytail)) AS tt, sqrt((q.xhead-p.xhead)*(q.xhead-p.xhead)+(q.yhead-p.yhead)*(q.yhead-p.yhead)) AS hh,
 sqrt((q.xhead-p.xtail)*(q.xhead-p.xtail)+(q.yhead-p.ytail)*(q.yhead-p.ytail)) AS th, sqrt((q.xtail-p.xhead)*(q.xtail-p.xhead)+(q.ytail-p.yhead)*(q.ytail-p.yhead)) AS ht
 FROM outer_ o JOIN kin p ON p.trial_id=o.trial_id AND p.frame=o.oa JOIN kin q ON q.trial_id=o.trial_id AND q.frame=o.ob),
mdm AS (SELECT trial_id, frame FROM nb WHERE {MINI} AND NOT ov AND NOT po),
cosr AS (SELECT DISTINCT trial_id, frame FROM crossed WHERE abs(bz-az) > 0 AND av AND bv),
comm AS (SELECT DISTINCT trial_id, frame FROM crossed WHERE {MINI}),
com AS (SELECT DISTINCT trial_id, frame FROM crossed WHERE tt + hh > ht + th),
swaps AS (SELECT * FROM mdm UNION SELECT * FROM cosr UNION SELECT * FROM comm)"""
FLAGS = f"{SQL}, {KIN}"


def flag_query(name: str, query, sql: str) -> None:
    register(name, f"{FLAGS} {sql}")(lambda spark, sf_dir: query(pose(spark, sf_dir)))


flag_query("flag_discontinuities", lambda f: flags.flag_discontinuities(f, "head", 30, 600), "SELECT trial_id, frame FROM nb WHERE hh * 30 > 600")
flag_query("flag_delta_mismatches", flags.flag_delta_mismatches, "SELECT trial_id, frame FROM nb WHERE tt + hh > (ht + th)")
flag_query("flag_min_delta_mismatches", flags.flag_min_delta_mismatches, f"SELECT trial_id, frame FROM nb WHERE {MINI}")
flag_query("flag_sign_reversals", flags.flag_sign_reversals, "SELECT trial_id, frame FROM nb WHERE abs(z - pz) > 0 AND v2 AND pv")
flag_query("flag_overlaps", flags.flag_overlaps, "SELECT trial_id, frame FROM nb WHERE ov")
flag_query("overlap_edges", lambda f: flags.overlap_edges(f, 1), "SELECT trial_id, oa AS start_frame, ob AS end_frame FROM outer_")
flag_query("flag_overlap_mismatches", flags.flag_overlap_mismatches, "SELECT * FROM com")
flag_query("flag_overlap_min_mismatches", flags.flag_overlap_min_mismatches, "SELECT * FROM comm")
flag_query("flag_overlap_sign_reversals", flags.flag_overlap_sign_reversals, "SELECT * FROM cosr")
flag_query("flag_all_swaps", flags.flag_all_swaps, "SELECT * FROM swaps")
flag_query(
    "flag_table",
    lambda f: flags.flag_table(f, 30, 600),
    f"""SELECT trial_id, frame, ov AS overlap, coalesce(hh*30 > 600, FALSE) AS disc_head, coalesce(tt*30 > 600, FALSE) AS disc_tail,
 coalesce(tt + hh > ht + th AND NOT ov AND NOT po, FALSE) AS dm, coalesce({MINI} AND NOT ov AND NOT po, FALSE) AS mdm,
 coalesce(abs(z - pz) > 0 AND v2 AND pv AND NOT ov AND NOT po, FALSE) AS sr,
 (trial_id, frame) IN (SELECT (trial_id, frame) FROM com) AS com, (trial_id, frame) IN (SELECT (trial_id, frame) FROM comm) AS comm, (trial_id, frame) IN (SELECT (trial_id, frame) FROM cosr) AS cosr FROM nb""",
)
_KINDS = {"ht": "a AND NOT b", "hm": "b AND NOT a", "tm": "c AND NOT a", "all": "a AND b AND c"}
flag_query(
    "overlap_edges_by_type",
    flags.overlap_edges_by_type,
    "SELECT trial_id, kind, min(frame) AS start_frame, max(frame) AS end_frame FROM (SELECT *, frame - row_number() OVER (PARTITION BY trial_id, kind ORDER BY frame) AS i FROM ("
    + " UNION ALL ".join(f"SELECT trial_id, frame, '{kind}' AS kind FROM (SELECT trial_id, frame, ov AS a, (xhead=xmid AND yhead=ymid) AS b, (xtail=xmid AND ytail=ymid) AS c FROM kin) WHERE {c}" for kind, c in _KINDS.items())
    + ")) GROUP BY trial_id, kind, i",
)

# Stops. The SQL melts short slow islands first and numbers what is left, another way than the operator's.
STOPS = f"""{SQL},
sp AS (SELECT trial_id, frame, coalesce({sql_norm(d2('xctr'), d2('yctr'))} * 30 < 80, FALSE) AS slow FROM {COUNTED}),
isl AS (SELECT *, frame - row_number() OVER (PARTITION BY trial_id, slow ORDER BY frame) AS g FROM sp),
islands AS (SELECT trial_id, slow, min(frame) AS a, max(frame) AS b, count(*) AS len, max(max(frame)) OVER (PARTITION BY trial_id) AS final FROM isl GROUP BY trial_id, slow, g),
marked AS (SELECT *, (slow AND b < final AND len - 1 > 0.05 * 30) AS stop FROM islands),
sums AS (SELECT trial_id, act, bool_or(stop) AS stop, min(a) AS a, max(b) AS b, sum(CASE WHEN b < final THEN len - 1 ELSE 0 END) AS total FROM
 (SELECT trial_id, a, b, len, final, stop, sum(CASE WHEN stop OR was IS NULL OR was THEN 1 ELSE 0 END) OVER (PARTITION BY trial_id ORDER BY a) AS act
  FROM (SELECT *, lag(stop) OVER (PARTITION BY trial_id ORDER BY a) AS was FROM marked)) GROUP BY trial_id, act),
done AS (SELECT s.trial_id, s.frame, CAST(u.stop AS INT) AS stop, CASE WHEN s.frame = u.a THEN u.total / CAST(30 AS DOUBLE) ELSE 0 END AS duration
 FROM sp s JOIN sums u ON s.trial_id = u.trial_id AND s.frame BETWEEN u.a AND u.b)"""


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.detect_stops(pose(spark, sf_dir), k.speed("ctr", 30), 80, 0.05, 30)


@register("detect_stops", f"{STOPS} SELECT trial_id, frame, stop, {s6('duration')} AS duration FROM done")
def detect_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops(spark, sf_dir).withColumn("duration", r6(F.col("duration")))


@register("event_vector", f"{STOPS} SELECT trial_id, frame, {s6('duration')} AS duration FROM done WHERE duration > 0 AND stop = 1")
def event_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.event_vector(stops(spark, sf_dir)).withColumn("duration", r6(F.col("duration")))


@register("activity_summary", f"{STOPS} SELECT trial_id, stop, count(*) AS count, {s6('avg(duration)')} AS mean, {s6('stddev_pop(duration)')} AS std, {s6('sum(duration)')} AS total FROM done WHERE duration > 0 GROUP BY trial_id, stop")
def activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.activity_summary(stops(spark, sf_dir)).withColumns({c: r6(F.col(c)) for c in ("mean", "std", "total")})
