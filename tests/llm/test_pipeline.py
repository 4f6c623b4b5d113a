"""The pipeline's stages, each against what it must keep, and the whole run."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline as c
from trackspark.llm import langid, secrets, simhash

from . import plain

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "123 456", None, None, None), (10**6 + 1, None, "en", None, None), (10**6 + 2, 'the token = "0123456789abcdef0123456789abcdef" of the and it is', "en", "s", 61)], docs.schema)
    docs = docs.unionByName(extra)
    kept = c.identify(spark, docs, SMALL)
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {10**6, 10**6 + 1}
    single = c.drop_exact(spark, kept, SMALL)
    last = {}
    for r in kept.collect():
        t = r["text"].encode().lower()
        last[t] = max(last.get(t, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(last.values())
    far = c.drop_near(spark, single, SMALL)
    rows = {r["doc_id"]: set(simhash.shingle_hashes(r["text"].encode(), 5)) for r in single.collect()}
    left = {r["doc_id"] for r in far.collect()}
    like = lambda a, b: len(rows[a] & rows[b]) / len(rows[a] | rows[b])
    for d in set(rows) - left:
        assert max(like(d, o) for o in rows if o != d) >= 0.8 - 1e-9
    clean = c.redact(spark, far, SMALL)
    assert clean.columns == c.COLUMNS
    assert clean.where("doc_id = 1000002").first()["text"] == 'the [SECRET]" of the and it is'
    packed = c.pack(spark, clean, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == left


def test_near_stage_is_that_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id is not null")
    group = plain.near_groups({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in c.drop_near(spark, docs, SMALL).collect()} == {d for d, g in group.items() if d == g}


def test_unlearned_languages_go_and_mixed_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = docs.where("lang <> 'es'")
    held = docs.where("lang = 'es' and n_chars > 200").withColumn("lang", F.lit(None).cast("string"))
    one = {r["lang"]: r["text"] for r in learned.where("doc_id % 7 = 1 and n_chars between 600 and 1200").groupBy("lang").agg(F.max_by("text", "doc_id").alias("text")).collect()}
    assert len(one) == 3
    extra = [(10**6, "Сегодня утром президент встретился с министрами " * 5, None, "s", 240), (10**6 + 1, "Σήμερα το πρωί ο πρόεδρος " * 5, None, "s", 130), (10**6 + 2, "\n".join(t[:600] for t in one.values()), None, "s", 1802)]
    left = {r["doc_id"] for r in c.identify(spark, learned.unionByName(held).unionByName(spark.createDataFrame(extra, docs.schema)), SMALL).select("doc_id").collect()}
    assert left & {10**6, 10**6 + 1, 10**6 + 2} == {10**6 + 2}
    foreign = {r["doc_id"] for r in held.collect()}
    assert len(foreign & left) < 0.02 * len(foreign)
    assert len(left - foreign) > 0.99 * learned.count()


def test_run_is_that_of_plain_versions(spark):
    """All five stages over every document of the small table, in loops; the places in the sequences are checked for being valid and few."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(docs)
    left = {}
    for r in docs.collect():
        label, score = plain.language(model, r["text"])
        if label != "und" and score >= c.LEAST_SCORE:
            assert abs(score - c.LEAST_SCORE) > 1e-3
            left[r["doc_id"]] = r["text"]
    last = {plain.lower(t): d for d, t in sorted(left.items())}
    left = {d: left[d] for d in last.values()}
    left = {d: left[d] for d, g in plain.near_groups(left).items() if d == g}
    tokenizer = Tokenizer.from_file(c.tokenizer("byte_bpe_50k.json"))
    want = collections.Counter()
    for d, t in left.items():
        marks = [False] * len(t)
        spans = [(int(x.split(":")[1]), int(x.split(":")[2])) for x in plain.base_spans(t).split(",") if x]
        assert not secrets.confirmed_spans(t)
        for a, b in spans:
            marks[a:b] = [True] * (b - a)
        # Spans that touch are still two secrets; those that overlap are one.
        starts = {a for a, b in spans if not any(x < a < y for x, y in spans)}
        clean = "".join("[SECRET]" if i in starts else "" if hidden else ch for i, (ch, hidden) in enumerate(zip(t, marks)))
        want.update(plain.pieces(tokenizer, d, clean))
    rows = c.run(spark, SMALL).collect()
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    used = collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        ends = [0]
        for offset, n in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 1024
    assert len(used) <= -(-sum(n for *_, n, _ in want.elements()) // 1024) + 2
    assert [n for n, _ in c.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "secret scans", "best-fit packing"]


def test_stages_take_empty_tables_nulls_repeats_and_other_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labelled = docs.where("lang is not null").limit(60)
    long = " ".join(labelled.where("lang = 'en'").first()["text"].split()[:40])
    odd = [(None, long, None, None, None), (7, long + " and then", None, None, None), (7, long + " and then", None, None, None), (8, None, None, None, None), (9, "", "en", None, 0), (None, "word " * 60_000, None, None, None)]
    both = labelled.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"kept": F.lit(1), "component": F.lit("x"), "lang_pred": F.lit(0), "_key": F.lit(2)})
    for table in (docs.limit(0), both):
        for _, stage in c.STAGES[:-1]:
            out = stage(spark, table, SMALL)
            assert out.columns == c.COLUMNS
            assert out.count() == 0 if table.isEmpty() else out.count() > 0
        assert set(c.pack(spark, table, SMALL).columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    single = c.drop_exact(spark, both, SMALL)
    assert single.where(F.col("text") == long + " and then").count() == 1
    near = c.drop_near(spark, single, SMALL).where(F.col("text").startswith(long))
    assert [r["doc_id"] for r in near.collect()] == [r["doc_id"] for r in near.collect() if r["doc_id"] is not None]
