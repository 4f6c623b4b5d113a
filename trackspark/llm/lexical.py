"""Operator 12: ranked lexical search with geometric blocks in each term's posting list.

Documents are sorted by a signature of their weighted terms (signs of random projections, so neighbours are similar) and dealt to
segments. In a segment the posting list of every term, in that order, is cut into blocks of similar documents, and each block keeps the largest impact
of every term among its documents. For a query, the product with this summary bounds the score of every document of the block from above.
A first look at the blocks with the largest bounds gives a score that the k-th result reaches at least; after it, only blocks whose
bound reaches that score are opened, and only in lists that a document of such a score must be in. Scores are then computed in full.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, row_groups, stored

#: Documents of a block, bits of a signature, blocks of each query that are looked at first.
BLOCK, BITS, FIRST_LOOKS = 64, 24, 12
#: Impacts in summaries are rounded up to multiples of this, so that one byte holds them: an impact is under a million.
GRAIN = 4096
#: Queries that are searched together; of more, each such part has an index of its own vocabulary.
ITEMS_AT_ONCE = 1_000
#: Documents of a segment at most.
SEGMENT = 10_000
SEED = 12
#: Bytes to split at become spaces, A-Z lower case; bytes over 0x7F belong to terms.
_SPLIT = bytes(c if c > 0x7F or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and other characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode().translate(_SPLIT).split()


class Queries(NamedTuple):
    """Queries of one part: terms and weights (how often asked times the term's weight) of query i stand at edges[i] to edges[i + 1]; ``floors``: the least score of interest."""

    edges: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    floors: np.ndarray

    def scores(self, impacts: np.ndarray) -> np.ndarray:
        """Of all queries, for a document's or a summary's impact of every term."""
        return np.add.reduceat(impacts[self.terms] * self.weights, self.edges[:-1])


class Index(NamedTuple):
    """``vectors``: doc, key, terms, impacts. ``blocks``: block, term, docs, coords, tops (see ``blocks_of``). ``weights`` of all terms; ``longest``: the largest impact of each."""

    vectors: DataFrame
    blocks: DataFrame
    weights: np.ndarray


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf: the terms of each query. Rows of one key are one query."""
    kind = dict(items.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(t)) for t in batch.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([w for c in counts for w in c], pa.binary()), pa.array([n for c in counts for n in c.values()], pa.int64())], names=["_key", "term", "tf"])

    own = items.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return own.mapInArrow(run, f"_key {kind}, term binary, tf long").groupBy("_key", "term").agg(F.sum("tf").alias("tf"))


def counted(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """_key, n (terms of the document), terms, tfs: those of the vocabulary, by their numbers there."""
    kind = dict(docs.dtypes)[key]
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            for a, b in row_groups(batch.column(1)):
                sizes, terms, tfs = [], [], []
                for t in batch.column(1).slice(a, b - a):
                    found = terms_of(t.as_py())
                    own = [(number[w], n) for w, n in Counter(found).items() if w in number]
                    sizes.append(len(found))
                    terms.append([i for i, _ in own])
                    tfs.append([n for _, n in own])
                lists = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(terms, lists), pa.array(tfs, lists)], names=["_key", "n", "terms", "tfs"])

    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return own.mapInArrow(run, f"_key {kind}, n long, terms array<int>, tfs array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, edges) of a column of lists."""
    edges = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[edges[0] : edges[-1]], edges - edges[0]


def signed(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds signature: the signs of a document's impacts, times the terms' weights, along random directions."""
    sent = rows.sparkSession.sparkContext.broadcast(np.random.default_rng(SEED).normal(size=(len(weights), BITS)).astype(np.float32) * weights[:, None].astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, powers = sent.value, 1 << np.arange(BITS, dtype=np.int64)
        for batch in batches:
            terms, edges = _flat(batch.column("terms"))
            impacts, _ = _flat(batch.column("impacts"))
            marks = np.zeros(batch.num_rows, np.int64)
            for i, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
                marks[i] = powers[impacts[a:b].astype(np.float32) @ directions[terms[a:b]] > 0].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], names=[*batch.schema.names, "signature"])

    return rows.mapInArrow(run, f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, signature long")


def blocks_of(docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, edges: np.ndarray, n_terms: int, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(term, docs, coords, tops) of every block of one segment, whose documents come in order of similarity: the list of each term cut every ``size`` documents.
    tops: for each term in coords the largest impact among the block's documents, in GRAINs, rounded up."""
    own = np.repeat(np.arange(len(docs)), np.diff(edges))
    order = np.argsort(terms, kind="stable")
    lists = np.flatnonzero(np.r_[True, np.diff(terms[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
    grains = ((impacts.astype(np.int64) + GRAIN - 1) // GRAIN).astype(np.uint8)
    top = np.zeros(n_terms, np.uint8)
    for first, last in zip(lists[:-1].tolist(), lists[1:].tolist()):
        for a in range(first, last, size):
            members = own[order[a : min(a + size, last)]]
            for i in members.tolist():
                x = terms[edges[i] : edges[i + 1]]
                top[x] = np.maximum(top[x], grains[edges[i] : edges[i + 1]])
            coords = np.flatnonzero(top)
            yield int(terms[order[a]]), docs[members], coords, top[coords]
            top[coords] = 0


def build_index(docs: DataFrame, vocabulary: list[bytes], key: str = "doc_id", text: str = "text", size: int = BLOCK) -> Index | None:
    """Index of all documents over the terms of a vocabulary; None if no document has a term at all."""
    rows = stored(counted(docs, vocabulary, key, text), "term-counts")
    total = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(total[0]), int(total[1])
    if not n_terms:
        discard(rows)
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the queries
        df[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    # The product of n and the number of documents may pass 64 bits, so it is formed in decimals.
    mass = f"25 + ((CAST(75 * n AS DECIMAL(20, 0)) * CAST({n_docs} AS DECIMAL(18, 0))) DIV CAST({n_terms} AS DECIMAL(20, 0)))"
    impacts = F.expr("transform(tfs, f -> CAST((1000000000L * f) DIV (1000L * f + 8 * m) AS INT))")
    own = rows.where(F.size("terms") > 0).withColumn("m", F.expr(mass)).select("_key", "terms", impacts.alias("impacts"))
    # Equal signatures are told apart by the rest, so that a large group of copies is dealt to many segments.
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_docs // SEGMENT)
    near = signed(own, weights).withColumn("salt", F.xxhash64("_key", "terms")).repartitionByRange(n_parts, "signature", "salt").sortWithinPartitions("signature", "salt")
    vectors = stored(near.select(F.monotonically_increasing_id().alias("doc"), "_key", "terms", "impacts"), "term-vectors")
    discard(rows)
    n_vocabulary, kind = len(vocabulary), "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
    names = ["segment", "at", "term", "docs", "coords", "tops"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SEGMENT):
                part = batch.slice(first, SEGMENT)
                numbers = part.column("doc").to_numpy()
                terms, edges = _flat(part.column("terms"))
                impacts, _ = _flat(part.column("impacts"))
                rows: list[tuple] = []
                for at, (term, members, coords, tops) in enumerate(blocks_of(numbers, terms, impacts, edges, n_vocabulary, size)):
                    rows.append((int(numbers[0]), at, term, members, np.diff(coords, prepend=0).astype(kind).tobytes(), tops.tobytes()))
                    if len(rows) == 2_000:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema)

    schema = pa.schema([("segment", pa.int64()), ("at", pa.int32()), ("term", pa.int32()), ("docs", pa.list_(pa.int64())), ("coords", pa.binary()), ("tops", pa.binary())])
    blocks = vectors.select("doc", "terms", "impacts").mapInArrow(run, "segment long, at int, term int, docs array<long>, coords binary, tops binary")
    return Index(vectors, stored(blocks, "term-blocks", "zstd"), weights)


def bounds_of(index: Index, queries: Queries) -> DataFrame:
    """item, segment, at, term, bound: of every block in the lists of a query's terms, the most that a document in it may score."""
    kind, n_terms = "<u2" if len(index.weights) <= 1 << 16 else "<u4", len(index.weights)
    # Of each term the queries that ask for it.
    order = np.argsort(queries.terms, kind="stable")
    asking, start = np.repeat(np.arange(len(queries.edges) - 1), np.diff(queries.edges))[order], np.searchsorted(queries.terms[order], np.arange(n_terms + 1))
    sent = index.blocks.sparkSession.sparkContext.broadcast((queries, asking, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, asking, start = sent.value
        top = np.zeros(n_terms, np.int64)
        for batch in batches:
            items, bounds, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for term, coords, tops in zip(batch.column("term").to_pylist(), batch.column("coords"), batch.column("tops")):
                at = np.cumsum(np.frombuffer(coords.as_buffer(), kind), dtype=np.int64)
                top[at] = np.frombuffer(tops.as_buffer(), np.uint8).astype(np.int64) * GRAIN
                own = asking[start[term] : start[term + 1]]
                items.append(own)
                bounds.append(queries.scores(top)[own])
                sizes.append(len(own))
                top[at] = 0
            taken = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items), pa.int32()), *[batch.column(c).take(taken) for c in ("segment", "at", "term")], pa.array(np.concatenate(bounds))], names=["item", "segment", "at", "term", "bound"])

    return index.blocks.select("segment", "at", "term", "coords", "tops").mapInArrow(run, "item int, segment long, at int, term int, bound long")


def scored(pairs: DataFrame, index: Index, queries: Queries, k: int) -> DataFrame:
    """item, doc, _key, score of the pairs (item, doc) whose scores reach the item's floor; of each batch the k best of an item, ties by key, null keys last."""
    asked = pairs.groupBy("doc").agg(F.collect_set("item").alias("items"))
    sent = pairs.sparkSession.sparkContext.broadcast(queries)
    n_terms, kind = len(index.weights), dict(index.vectors.dtypes)["_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        impact = np.zeros(n_terms, np.int64)
        for batch in batches:
            terms, edges = _flat(batch.column("terms"))
            impacts, _ = _flat(batch.column("impacts"))
            items, ends = _flat(batch.column("items"))
            rows, kept, scores = [], [], []
            for i in range(batch.num_rows):
                at = terms[edges[i] : edges[i + 1]]
                impact[at] = impacts[edges[i] : edges[i + 1]]
                own = items[ends[i] : ends[i + 1]]
                got = queries.scores(impact)[own]
                good = np.flatnonzero(got >= queries.floors[own])
                rows.append(np.full(len(good), i))
                kept.append(own[good])
                scores.append(got[good])
                impact[at] = 0
            row, item, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, kept, scores))
            keys = batch.column("_key").to_pylist()
            place = np.empty(len(keys), np.int64)
            place[sorted(range(len(keys)), key=lambda j: (keys[j] is None, keys[j] if keys[j] is not None else 0))] = np.arange(len(keys))
            order = np.lexsort((place[row], -score, item))
            row, item, score = row[order], item[order], score[order]
            starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
            nth = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
            row, item, score = row[nth < k], item[nth < k], score[nth < k]
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), batch.column("doc").take(taken), batch.column("_key").take(taken), pa.array(score)], names=["item", "doc", "_key", "score"])

    return index.vectors.join(asked, "doc").select("doc", "_key", "terms", "impacts", "items").mapInArrow(run, f"item int, doc long, _key {kind}, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("_key"), F.asc("doc")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(index: Index, queries: Queries, k: int) -> DataFrame:
    """item, rank, _key, score: the k best documents of each query with a score above 0. Exact: only what cannot be among them is passed over."""
    spark, n_items = index.blocks.sparkSession, len(queries.edges) - 1
    bounds = stored(bounds_of(index, queries), "block-bounds")
    look = Window.partitionBy("item").orderBy(F.desc("bound"), "segment", "at")
    first = bounds.withColumn("_nth", F.row_number().over(look)).where(F.col("_nth") <= FIRST_LOOKS)

    def opened(chosen: DataFrame) -> DataFrame:
        """The documents of blocks: pairs of item and doc."""
        asked = chosen.groupBy("segment", "at").agg(F.collect_set("item").alias("items"))
        rows = asked.join(index.blocks.select("segment", "at", "docs"), ["segment", "at"])
        return rows.select("items", F.explode("docs").alias("doc")).select(F.explode("items").alias("item"), "doc")

    floors = np.ones(n_items, np.int64)
    for r in _best(scored(opened(first), index, queries, k), k).where(F.col("rank") == k).select("item", "score").collect():  # one row a query
        floors[r["item"]] = r["score"]
    # Of each query the terms, by the most that they can add: as long as these together stay under the floor, a document needs another term too.
    most = np.zeros(len(index.weights), np.int64)
    for r in index.vectors.select(F.explode(F.arrays_zip("terms", "impacts")).alias("p")).groupBy("p.terms").agg(F.max("p.impacts").alias("top")).collect():  # one row a term
        most[r["terms"]] = r["top"]
    needed = []
    for i in range(n_items):
        at = slice(queries.edges[i], queries.edges[i + 1])
        add = queries.weights[at] * most[queries.terms[at]]
        order = np.argsort(add, kind="stable")
        needed += [(i, int(t), int(floors[i])) for t, total in zip(queries.terms[at][order], np.cumsum(add[order])) if total >= floors[i]]
    kept = spark.createDataFrame(needed, "item int, term int, floor long")
    pairs = opened(bounds.join(F.broadcast(kept), ["item", "term"]).where(F.col("bound") >= F.col("floor")))
    found = cut(_best(scored(pairs, index, queries._replace(floors=floors), k), k).select("item", "rank", "_key", "score"))
    discard(bounds)
    return found


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = BLOCK) -> DataFrame:
    """item, rank (from 1), key, score: for each query the k documents of the highest scores above 0, equal scores by ascending key, null keys last.

    A term weighs floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score sums the weight times (10**9 tf) div (1000 tf + 8 m) over the query's terms,
    m being 25 + (75 n N) div L. Null and empty texts have no terms: such documents match nothing, such queries return no row. Rows of one item id are one query
    whose terms add up; documents are rows, so repeated rows rank one by one. Other columns are dropped. Queries are searched
    ITEMS_AT_ONCE at a time, whose terms and thresholds are all that the driver and the tasks hold of them.
    """
    spark = docs.sparkSession
    asked = stored(item_terms(items, item, item_text), "query-terms")
    n_items = asked.select("_key").distinct().count()
    parts = -(-n_items // ITEMS_AT_ONCE)
    kind = items.schema[item].dataType.simpleString()
    out = spark.createDataFrame([], f"`{item}` {kind}, rank int, `{key}` {dict(docs.dtypes)[key]}, score long")
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("_key"), F.lit(parts)) == part).collect()
        ids = list(dict.fromkeys(r["_key"] for r in rows))
        vocabulary = sorted({bytes(r["term"]) for r in rows})
        index = build_index(docs, vocabulary, key, text, size) if rows else None
        if index is None:
            continue
        number, place = {w: i for i, w in enumerate(vocabulary)}, {x: i for i, x in enumerate(ids)}
        own = sorted((place[r["_key"]], number[bytes(r["term"])], r["tf"]) for r in rows)
        at, terms, tfs = np.array(own, np.int64).T
        queries = Queries(np.searchsorted(at, np.arange(len(ids) + 1)), terms, tfs * index.weights[terms], np.ones(len(ids), np.int64))
        found = search(index, queries, k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, `{item}` {kind}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select(F.col(item), "rank", F.col("_key").alias(key), "score"))
        discard(index.vectors)
        discard(index.blocks)
    discard(asked)
    return out
