"""Operator 2: SimHash near-dedup by multi-index hashing.

Fingerprints that differ in at most r bits, cut into m segments, agree to within r // m bits in one of
the first r % m + 1 segments, or to within r // m - 1 bits in one of the rest. So every fingerprint is
entered in one table a segment, all values in those small Hamming balls are enumerated and fetched from
the tables, and the complete distance decides. Equal fingerprints are one entry. Before pairs are
fetched, each entry is linked with the pivots of its table rows; the join then leaves out pairs that are already in
one component, which keeps the links of a dense group in proportion to its size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, discard, fitting, let_go, release, row_groups, spread_join, stored

BITS = 64
SEED = 42
#: Distances that may be computed at the cost of one probe row, which is shuffled.
PROBE_COST = 50
#: Shingles whose bits are unpacked at a time.
UNPACKED = 100_000


def shingle_hashes(data: bytes, words: int) -> list[int]:
    """XXH64 of every shingle, repeats included, of lower-cased words; the whole sequence if it is shorter; none without words."""
    parts = data.lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    n = len(parts)
    if n <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    sizes = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]


def majority(hashes: list[int]) -> int:
    """The fingerprint: a bit is set if it is set in over half the hashes. As a signed 64-bit number."""
    if not hashes:
        return 0
    values = np.array(hashes, "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(values), UNPACKED):
        bits = np.unpackbits(values[at : at + UNPACKED].view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (signed long). Null text counts as empty, whose fingerprint is zero."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_groups(batch.column(1)):
                fps = [majority(shingle_hashes((t.as_py() or "").encode(), words)) for t in batch.column(1).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fps, pa.int64())], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def segments(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    bounds = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def radii(distance: int, count: int) -> list[int]:
    """The radius to search in each segment (-1: none); see the module's text for why these suffice."""
    whole, rest = divmod(distance, count)
    return [whole if i <= rest else whole - 1 for i in range(count)]


def tables_for(entries: int, distance: int) -> int:
    """The number of segments whose probes and expected table matches cost least for so many fingerprints. Every number finds all pairs."""

    def cost(count: int) -> float:
        each = [sum(math.comb(w, k) for k in range(r + 1)) * (PROBE_COST + entries / 2**w) for (_, w), r in zip(segments(count), radii(distance, count)) if r >= 0]
        return sum(each)

    return min(range(1, max(2, distance) + 1), key=cost)


def _segment(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def table_rows(entries: DataFrame, distance: int, count: int) -> DataFrame:
    """Every fingerprint's entry in each table that is searched: seg, value."""
    rows = [F.struct(F.lit(i).alias("seg"), _segment(F.col("fp"), a, w).alias("value")) for i, ((a, w), r) in enumerate(zip(segments(count), radii(distance, count))) if r >= 0]
    return entries.withColumn("row", F.explode(F.array(*rows))).select("*", "row.seg", "row.value").drop("row")


def _ball(masks: list[int], seg: int, value: Column) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(F.lit(seg).alias("seg"), value.bitwiseXOR(m).alias("value")))


def probe_rows(entries: DataFrame, distance: int, count: int) -> DataFrame:
    """Every value in the Hamming ball of each segment: seg, value."""
    balls = []
    for i, ((a, w), r) in enumerate(zip(segments(count), radii(distance, count))):
        masks = [sum(1 << b for b in bits) for k in range(r + 1) for bits in itertools.combinations(range(w), k)]
        if masks:
            balls.append(_ball(masks, i, _segment(F.col("fp"), a, w)))
    return entries.withColumn("row", F.explode(F.concat(*balls))).select("*", "row.seg", "row.value").drop("row")


def distance_of(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(entries: DataFrame, distance: int, count: int) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints at ``distance`` or less.

    ``entries``: distinct fp with weight (the documents that have it). Each table row is first linked to its pivot, the heaviest fingerprint
    with that value, if near enough; components of these links come next, and only pairs of
    different components are then looked for with complete balls. Join rows are links, never candidates.
    """
    n = entries.count()
    few = lambda table: fitting(table, count * n)
    rows = table_rows(few(entries), distance, count)
    pivot = F.max_by("fp", F.struct("weight", "fp"))
    pivots = few(rows.groupBy("seg", "value").agg(pivot.alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    stars = rows.join(pivots, ["seg", "value"]).where((distance_of("fp", "pivot") <= distance) & (F.col("fp") != F.col("pivot"))).select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = cut(few(stars))
    first = components(stars)
    known = entries.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("c"))
    known = cut(fitting(known, PROBE_COST * n))
    table = table_rows(known, distance, count).select("seg", "value", F.col("fp").alias("a"), F.col("c").alias("ca"))
    probes = probe_rows(known, distance, count).select("seg", "value", F.col("fp").alias("b"), F.col("c").alias("cb"))
    near = [table["seg"] == probes["seg"], table["value"] == probes["value"], F.col("ca") < F.col("cb"), distance_of("a", "b") <= distance]
    pairs = table.join(probes, near).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    return stars.union(pairs)


def near_groups(docs: DataFrame, words: int = 4, distance: int = 4, tables: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, fingerprint (16 lowercase hex digits), component_id (smallest key reachable).

    Texts without words have fingerprint zero and are linked like any other. Null text counts as
    empty. ``tables``, by default, are as many as cost least for the number of distinct fingerprints; the result does not depend on it. Rows with a null key take part as documents without a claim to name a component; repeated rows are rows of their own.
    """
    marks = cut(fingerprints(docs, words, key, text))
    entries = cut(marks.groupBy("fp").agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("weight")))
    n_entries = entries.count()
    found = components(links(entries.select("fp", "weight"), distance, tables or tables_for(n_entries, distance)))
    placed = entries.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    lows = placed.groupBy("c").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    named = spread_join(placed, lows, ["c"], "_n", n_entries).select("fp", "component_id", "weight")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return spread_join(marks, named, ["fp"], "weight", marks.count()).select(key, hexed.alias("fingerprint"), "component_id")


#: Bits of the wide fingerprints of ``similar_groups``.
WIDE = 256
#: Shingles put last in the order of the exact search, the documents they are looked for in, and the fewest of those that must hold one.
COMMON, COMMON_DOCS, COMMON_LEAST = 1 << 16, 5_000, 3
#: Standard deviations above the mean distance of a pair at the asked similarity beyond which a candidate is not verified: one such pair in 10**9.
MARGIN = 6
#: Texts whose keys are broadcast to choose them for verification; the keys of more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Most rounds of linking texts with pivots of their lists, and new links for each text below which no further round is made. The groups do not depend on either.
PIVOT_ROUNDS, ENOUGH_LINKS = 4, 0.01
#: Fingerprint columns.
WORDS = [f"w{i}" for i in range(WIDE // 64)]


def wide_fingerprint(values: np.ndarray) -> np.ndarray:
    """Majority bits (WIDE of them) of distinct hashes, each stretched to WIDE bits by a mixing step a word."""
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(values), UNPACKED // 4):
        part = values[at : at + UNPACKED // 4]
        stretched = np.empty((len(part), WIDE // 64), "<u8")
        for i in range(WIDE // 64):
            x = part + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            stretched[:, i] = x ^ x >> np.uint64(31)
        counts += np.unpackbits(stretched.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * counts > len(values)


def distance_for(similarity: float, margin: float = MARGIN) -> int:
    """Bits of WIDE that texts of this Jaccard similarity differ in, ``margin`` standard deviations above the mean."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(WIDE * share + margin * np.sqrt(WIDE * share * (1 - share)))


def distinct_shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(np.array(shingle_hashes((text or "").encode(), words), "<u8"))


def common_shingles(docs: DataFrame, words: int, key: str, text: str) -> np.ndarray:
    """Sorted hashes of shingles that many documents of a bounded sample hold. Any choice gives the same pairs; this one keeps their lists short."""
    n = docs.count()
    some = docs if n <= COMMON_DOCS else docs.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * COMMON_DOCS / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for a, b in row_groups(batch.column(0)):
                for t in batch.column(0).slice(a, b - a):
                    yield pa.RecordBatch.from_arrays([pa.array(distinct_shingles(t.as_py(), words).view("<i8"))], names=["h"])

    counted = some.select(text).mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_LEAST)
    rows = counted.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()
    return np.sort(rows["h"].to_numpy())


def wide_entries(docs: DataFrame, words: int, similarity: float, common: np.ndarray, key: str, text: str) -> DataFrame:
    """key, digest (of the text), n (distinct shingles), w0..w3 (the fingerprint), heads (the first shingles in the common order, so many
    that two texts as similar as asked must share one). Texts without words are left out."""
    kind = dict(docs.dtypes)[key]
    names = [key, "digest", "n", *WORDS, "heads"]
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        late = sent.value
        for batch in batches:
            for a, b in row_groups(batch.column(2)):
                rows, sizes, bits, heads = [], [], [], []
                for i, t in enumerate(batch.column(2).slice(a, b - a).to_pylist(), a):
                    own = distinct_shingles(t, words)
                    if not len(own):
                        continue
                    rows.append(i)
                    sizes.append(len(own))
                    bits.append(wide_fingerprint(own))
                    own = own.view("<i8")
                    own = own[np.argsort(late[np.searchsorted(late, own).clip(max=len(late) - 1)] == own, kind="stable")] if len(late) else own
                    heads.append(own[: len(own) - least_overlap(similarity, len(own)) + 1])
                packed = np.packbits(np.array(bits, bool).reshape(-1, WIDE), axis=1, bitorder="little").view("<i8").reshape(-1, WIDE // 64)
                taken = pa.array(rows, pa.int64())
                columns = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(sizes, pa.int32()), *[pa.array(packed[:, i]) for i in range(WIDE // 64)], pa.array(heads, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    ddl = ", ".join([f"`{key}` {kind}", "digest long", "n int", *[f"{w} long" for w in WORDS], "heads array<long>"])
    return docs.select(key, F.xxhash64(text).alias("digest"), text).mapInArrow(run, ddl)


def apart() -> Column:
    """Complete distance of the wide fingerprints aw0.. and bw0.. of a pair."""
    return sum((distance_of(f"a{w}", f"b{w}") for w in WORDS[1:]), distance_of("aw0", "bw0"))


def least_overlap(similarity: float, n: int) -> int:
    """Shingles that a text of ``n`` must share with any text as similar as that."""
    return max(1, int(np.ceil(similarity * n - 1e-9)))


def shingle_sets(docs: DataFrame, words: int, text: str) -> DataFrame:
    """node, shingles: the distinct hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for a, b in row_groups(batch.column(1)):
                sets = [distinct_shingles(t, words).view("<i8") for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select("node", text).mapInArrow(run, "node long, shingles array<long>")


def verified(pairs: DataFrame, entries: DataFrame, docs: DataFrame, words: int, similarity: float, key: str, text: str, nearest: bool = False, most: int | None = None) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' sets of distinct shingles have this Jaccard similarity at least.

    Complete distances of the fingerprints come first; only pairs that may be as similar as asked have their sets built from the texts. With ``nearest`` only
    the pair of each ``a`` whose fingerprints are closest is looked at. ``most``: there are no more pairs than that, if known.
    """
    few = (lambda table: table) if most is None else lambda table: fitting(table, most)
    marks = entries.select("node", *WORDS)
    pairs = few(few(pairs.select("a", "b")).distinct())
    for side in ("a", "b"):
        pairs = few(pairs.join(marks.select(F.col("node").alias(side), *[F.col(w).alias(f"{side}{w}") for w in WORDS]), side))
    pairs = pairs.where(apart() <= distance_for(similarity)).select("a", "b", apart().alias("apart"))
    pairs = cut(few(pairs.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))) if nearest else pairs.select("a", "b"))
    n = pairs.count()
    if not n:
        return pairs
    pairs = fitting(pairs, n)
    needed = fitting(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), 2 * n)
    named = cut(fitting(entries.select("node", F.col(key).alias("_key"), F.col("digest").alias("_digest"), "copies").join(needed, "node"), 2 * n))
    few = F.broadcast(named) if named.count() <= BROADCAST_KEYS else named
    body = docs.select(F.col(key).alias("_own"), F.col(text).alias("_text"))
    met = body.join(few, body["_own"].eqNullSafe(few["_key"]) & (F.xxhash64("_text") == few["_digest"])).select("node", "_text", "copies")
    met = met.where("copies = 1").unionByName(met.where("copies > 1").dropDuplicates(["node"]))
    sets = stored(shingle_sets(met, words, "_text"), "shingle-sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    good = cut(both.where(F.col("both") >= F.lit(similarity) * (F.size("sa") + F.size("sb") - F.col("both")) - 1e-9).select("a", "b").distinct())
    good = fitting(good, n)
    discard(sets)
    release(docs.sparkSession)
    return good


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest (xxhash64 of the text), component, stays of the texts that have a near copy or stand in several rows, one row for each key and text.

    Groups are the components of all pairs whose sets of distinct shingles are as similar as asked; component is the smallest key of a
    group and stays marks one row of it (null keys yield). Most copies are found by multi-index hashing: balls in the segments of 64 bits of
    the fingerprint, as in ``links``. No balls of a payable radius hold all pairs of such similarity, so the rest comes from a search
    that is complete at any number of rows: in one order of all shingles, sets of n that are that similar share one of their
    first n - ceil(similarity * n) + 1. Documents are first linked with the pivots of these lists, and only pairs of different
    components are then looked for. Candidates of either search pass complete distances and then their sets decide. Texts without words take no part.
    """
    made = wide_entries(docs, words, similarity, common_shingles(docs, words, key, text), key, text)
    made = stored(made.withColumn("node", F.monotonically_increasing_id()), "wide-entries")
    # Rows equal in key and text are one node.
    repeats = cut(made.groupBy(key, "digest").agg(F.min("node").alias("_first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").withColumnsRenamed({key: "_key", "digest": "_digest"}))
    n_repeats = repeats.count()
    if n_repeats:
        few = F.broadcast(repeats) if n_repeats <= BROADCAST_KEYS else repeats
        marked = made.join(few, made[key].eqNullSafe(few["_key"]) & (made["digest"] == few["_digest"]), "left").where("_first is null or node = _first")
        entries = stored(marked.withColumn("copies", F.coalesce("copies", F.lit(1))).drop("_key", "_digest", "_first"), "wide-entries")
    else:
        entries = made.withColumn("copies", F.lit(1))
    check = lambda pairs, nearest=False, most=None: verified(pairs, entries, docs, words, similarity, key, text, nearest, most)
    total = entries.count()

    marks = entries.groupBy(F.col("w0").alias("fp")).agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("weight"))
    marks = cut(fitting(marks, total))
    own = spread_join(entries.select("node", F.col("w0").alias("fp")), marks.where("weight > 1"), ["fp"], "weight", total)
    low = marks.select("fp", "low")
    near = links(marks.select("fp", "weight"), 4, tables_for(marks.count(), 4))
    near = near.join(low.toDF("a", "la"), "a").join(low.toDF("b", "lb"), "b")
    linked = check(own.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).union(near.select("la", "lb")))

    # Lists of the documents that share one of their first shingles; ``at`` is its place in the order, ``k`` the length of the list.
    heads = entries.select("node", "n", F.posexplode("heads").alias("at", "h"))
    lists = heads.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    live = stored(spread_join(heads, lists, ["h"], "k", entries.agg(F.coalesce(F.sum(F.size("heads")), F.lit(0))).first()[0]), "shared-heads")
    rows = live.count()
    release(docs.sparkSession)

    # A pair that is similar enough passes at the first shingle it shares: what follows that one must make up the overlap.
    needed = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-9)
    enough = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= needed
    sizes = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-9

    def placed(groups: DataFrame) -> DataFrame:
        return fitting(live.join(groups, "node", "left").select("h", "node", "n", "at", "k", F.coalesce("component", "node").alias("c")), rows)

    # Pivots first: each text meets one text of every list it is in, drawn by a hash of both, and is linked with the nearest of these if similar; rounds go on while they link
    # many, so that dense groups are nearly whole before pairs are looked for.
    for turn in range(PIVOT_ROUNDS):
        listed = placed(components(linked))
        order = F.struct(F.xxhash64("node", "h", F.lit(turn)), "node")
        low = listed.groupBy("h").agg(F.min_by(F.struct("node", "n", "at", "c"), order).alias("p"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.first("k").alias("k")).where("c0 <> c1")
        low = fitting(low, rows)
        near = spread_join(listed.drop("k"), low.select("h", "p", "k"), ["h"], "k", rows).select(F.col("node").alias("a"), F.col("p.node").alias("b"), F.col("n").alias("na"), F.col("p.n").alias("nb"), F.col("at").alias("ia"), F.col("p.at").alias("ib"), "c", F.col("p.c").alias("pc"))
        new = check(near.where((F.col("c") != F.col("pc")) & enough & sizes), True, rows)
        linked = linked.union(new)
        if new.count() <= total * ENOUGH_LINKS:
            break

    # Lists whose texts are all of one component are done. In the others the heaviest component, a dense group as a rule, does not meet itself; all other texts meet, and
    # the join's own condition holds the bounds and the complete distance, so it makes rows of likely pairs only and a list of unlike texts makes none.
    listed = cut(placed(components(linked)))
    sizes_of = listed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("k"))
    mixed = spread_join(listed.drop("k"), sizes_of.where("parts > 1").select("h", "main", "k"), ["h"], "k", rows)
    mixed = stored(mixed.select("h", "node", "n", "at", "c", (F.col("c") == F.col("main")).alias("in_main")).join(entries.select("node", *WORDS), "node"), "mixed-heads")
    # Of a pair, the smaller text has the shared shingle among the first 1 - 2 * share of its own, so two that have it later need not meet; neither need
    # texts in size bands (each 1 / similarity wide) that are not neighbours. So a passage that many texts share pairs few of them.
    share = similarity / (1 + similarity)
    band = F.floor(F.log(F.col("n")) / F.lit(float(-np.log(similarity))) + 1e-9) if similarity < 1 else F.col("n").cast("long")
    early = mixed.where(F.col("at") <= F.col("n") * F.lit(1 - 2 * share) + 1e-9).select("h", F.explode(F.array(band, band + 1)).alias("band"), "c", "in_main", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), *[F.col(w).alias(f"a{w}") for w in WORDS])
    right = mixed.select("h", band.alias("band"), F.col("c").alias("other"), F.col("in_main").alias("other_main"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), *[F.col(w).alias(f"b{w}") for w in WORDS])
    likely = (F.col("c") != F.col("other")) & (F.col("na") <= F.col("nb")) & enough & sizes & (apart() <= distance_for(similarity))
    keys = ["h", "band"]
    same = lambda x, y: [x[k] == y[k] for k in keys]
    meet = lambda x, y: x.join(y, [*same(x, y), likely]).select("a", "b")
    others, few = early.where("not in_main"), right.where("not other_main")
    cross = meet(others, right).union(meet(early.where("in_main"), few))
    found = components(linked.union(check(cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))))
    discard(mixed)

    if n_repeats:
        found = found.union(entries.where("copies > 1").select("node", F.col("node").alias("component")).join(found, "node", "left_anti"))
    named = cut(fitting(entries.select("node", key, "digest", "copies").join(found, "node"), total))
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "node")
    heads_of = named.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size"))
    out = cut(spread_join(named, heads_of, ["component"], "size", named.count()).select(key, "digest", F.col("first.key").alias("component"), (F.col("node") == F.col("first.node")).alias("stays"), "copies"))
    for table in {id(t): t for t in (made, entries, live)}.values():
        discard(table)
    return out


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each group of near copies the one with the smallest key, and all rows without a near copy.

    Rows are told apart by key and text: a key that other texts have too loses only the copies. Rows equal in both are
    copies of each other, of which any one stays; null keys yield to all others. Null texts and texts without words stay, repeated or not.
    """
    groups = similar_groups(docs, words, similarity, key, text).select(F.col(key).alias("_key"), F.col("digest").alias("_digest"), "stays", "copies")
    own = F.xxhash64(text)
    same = lambda g: docs[key].eqNullSafe(g["_key"]) & (own == g["_digest"])
    gone, some = groups.where("not stays"), groups.where("stays and copies > 1")
    left = docs.join(gone, same(gone), "left_anti")
    if some.isEmpty():
        return left
    twice = docs.join(some, same(some), "left_semi").withColumn("_digest", own).dropDuplicates([key, "_digest"]).drop("_digest")
    return left.join(some, same(some), "left_anti").unionByName(twice)
