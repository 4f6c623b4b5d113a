"""Fill-in-middle, lexical search and repetition rules against loops, with nulls, ties, repeats, empty tables, long texts and clashing names."""

import collections
import hashlib
import math
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.llm import infill, lexical, queries, repetition

SCHEMA = "doc_id long, text string, lang string, n long, form string, _key string, rank int"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(11)
    bag = ["the", "Of", "ion", "la", "eau", "ÉCOLE", "straße", "x1", "日本語", "|#", "done."]
    texts = [None, "", " \t\n ", "one", "a<P>b", "a<S>", "<M", "<" * 50, "é日" * 9000, "word " * 30, "line one\nline one\n\nline one\r\n x"]
    texts += [" ".join(rng.choice(bag, rng.integers(1, 90))) for _ in range(60)]
    texts += [texts[15]] * 3 + [f"{texts[20]} {texts[20]}", "q" * 300 + "".join(map(chr, range(200, 700))) * 2]
    rows = [(i * 7 % 113, t, "en", i, "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[14], (None, texts[30], None, None, None, None, None), (None, None, None, None, None, None, None)], SCHEMA).repartition(4).cache()


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def laid_out(key, text):
    """By slices of the string."""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", p, q - p, f"<S>{text[q:]}<P>{text[:p]}<M>{text[p:q]}"
    return n, "psm", p, q - p, f"<P>{text[:p]}<S>{text[q:]}<M>{text[p:q]}"


@pytest.mark.parametrize("size", [1, 7, infill.BLOCK])
def test_infill(docs, size):
    made = infill.fill_in_middle(docs, size=size).withColumn("restored", infill.restored()).collect()
    want = collections.Counter((k, *laid_out(k, t), t) for k, t in rows_of(docs))
    assert collections.Counter(map(tuple, made)) == want
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["word", "line"])
def test_infill_by_other_units(docs, unit):
    pieces = {"word": re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+"), "line": re.compile("[^\n]*\n|[^\n]+")}[unit]
    for r in infill.fill_in_middle(docs, unit, fim=100, spm=50, size=5).withColumn("back", infill.restored()).join(docs.select("doc_id", "text"), "doc_id").where("text = back").collect():
        parts = pieces.findall(r["text"])
        assert "".join(parts) == r["text"] and r["n"] == len(parts)
        if r["form"] != "plain":
            p, q = sorted(x % (len(parts) + 1) for x in infill.draws(1, r["doc_id"])[:2])
            assert (r["prefix_chars"], r["middle_chars"]) == (len("".join(parts[:p])), len("".join(parts[p:q])))


def test_markers_that_could_overlap_are_refused(docs):
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, markers=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, markers=("PP", "<S>", "<M>"))


def test_tree_finds_every_block():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 64, 100):
        counts = rng.integers(0, 4, (n, 2))
        tree = infill.BlockTree(counts)
        ends = np.cumsum(counts, axis=0)
        for unit in range(int(counts[:, 0].sum())):
            block = int(np.searchsorted(ends[:, 0], unit, side="right"))
            assert tree.descend(unit) == (block, *(ends[block] - counts[block]).tolist())


def ranked(docs, items, k):
    """Every document scored for every item."""
    word = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    terms = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = [(d, collections.Counter(x), len(x)) for d, t in docs if (x := terms(t))]
    n_all, total = len(own), sum(n for *_, n in own)
    df = collections.Counter(w for _, c, _ in own for w in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for i, q in asked.items():
        got = []
        for d, c, n in own:
            m = 25 + (75 * n * n_all) // total
            s = sum(q[w] * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in q if w in c)
            if s > 0:
                got.append((-s, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(got)[:k], 1)]
    return out


ITEMS = [(0, "the ION of x1"), (1, "日本語 la la la eau"), (2, None), (3, "nothing-of-this"), (4, "école straße done"), (5, ""), (None, "eau the"), (4, "école"), (6, "q" * 300)]


@pytest.mark.parametrize(("k", "size", "segment", "at_once"), [(10, 64, 10_000, 1000), (3, 2, 9, 2), (1, 1, 1000, 1000)])
def test_search(spark, docs, monkeypatch, k, size, segment, at_once):
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", at_once)
    monkeypatch.setattr(lexical, "SEGMENT", segment)
    monkeypatch.setattr(lexical, "FIRST_LOOKS", 1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.rank_documents(docs, items, k, size=size)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(ranked(rows_of(docs), ITEMS, k))


def test_blocks_that_cannot_hold_a_result_are_passed_over(spark):
    """Two clusters of documents: the far one's blocks stay shut, as their bounds do not reach the tenth score."""
    rng = np.random.default_rng(1)
    near = [(i, " ".join(rng.permutation(["red", "green", "blue", "grey", f"n{i}"]))) for i in range(300)]
    far = [(1000 + i, " ".join(["red", *rng.choice([f"w{j}" for j in range(40)], 60)])) for i in range(300)]
    docs = spark.createDataFrame(near + far, "doc_id long, text string")
    vocabulary = sorted({w.encode() for w in "red green blue grey".split()} | {f"w{j}".encode() for j in range(40)})
    index = lexical.build_index(docs, vocabulary, size=16)
    terms = np.array([vocabulary.index(w.encode()) for w in sorted("red green blue grey".split())])
    queries_ = lexical.Queries(np.array([0, 4]), terms, index.weights[terms], np.ones(1, np.int64))
    best = sorted(map(tuple, lexical.search(index, queries_, 10).select("rank", "_key", "score").collect()))
    assert [(r, d, s) for _, r, d, s in ranked(near + far, [(0, "red green blue grey")], 10)] == best
    bounds = lexical.bounds_of(index, queries_).collect()
    assert 0 < sum(r["bound"] >= best[-1][2] for r in bounds) < len(bounds)
    # A bound is never under a score in its block.
    held = {(r["segment"], r["at"]): r["docs"] for r in index.blocks.collect()}
    scores = {r["doc"]: r["score"] for r in lexical.scored(index.vectors.select(F.lit(0).alias("item"), "doc"), index, queries_, 10_000).collect()}
    assert all(r["bound"] >= max(scores.get(d, 0) for d in held[r["segment"], r["at"]]) for r in bounds)


def test_repetition(docs):
    docs = docs.where("coalesce(length(text), 0) < 2000")
    got = collections.Counter(map(tuple, repetition.quality_rules(docs).select("doc_id", *repetition.COUNTS, "base_failed", "kept").collect()))
    want = collections.Counter()
    for k, t in rows_of(docs):
        words = re.findall("[^\x20\x09-\x0d]+", t)
        n = len(words)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(n - 7))
        hit = {j for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        fine = [p for w in words for p in ([w] if len(w.encode()) <= repetition.LONG_WORD else w)]
        found = plain_repeats(fine)
        good = {s: at for s, at in found.items() if len(s) >= repetition.LEAST_REPEAT and len("".join(s)) >= repetition.LEAST_CHARS}
        inside = {j for s, at in good.items() for i in at for j in range(i, i + len(s))}
        chars = sum(len(fine[j]) for j in inside)
        longest, total = max(map(len, good), default=0), len("".join(words))
        failed = n < 20 or 100 * len(hit) > 30 * n
        kept = not failed and 100 * chars <= repetition.MOST_COVERED * total and longest <= repetition.MOST_LONGEST
        want[k, n, total, len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(good), longest, max((len("".join(s)) for s in good), default=0), chars, failed, kept] += 1
    assert got == want


def plain_repeats(parts):
    """Substrings of two symbols or more with their places, of which no longer one stands in all the same places."""
    n, ids = len(parts), {}
    parts = [ids.setdefault(p, len(ids)) for p in parts]
    names = {v: k for k, v in ids.items()}
    out, places = {}, {(): list(range(n))}
    while places:
        longer = collections.defaultdict(list)
        for s, at in places.items():
            for i in at:
                if i + len(s) < n:
                    longer[(*s, parts[i + len(s)])].append(i)
        longer = {s: at for s, at in longer.items() if len(at) > 1}
        for s, at in longer.items():
            before, after = {parts[i - 1] if i else -1 for i in at}, {parts[i + len(s)] if i + len(s) < n else -1 for i in at}
            if len(before) > 1 and len(after) > 1:
                out[tuple(names[x] for x in s)] = at
        places = longer
    return out


def test_long_texts_repeat_as_a_whole(docs):
    """A word of 18,000 code points, two by turns, repeats but for its first or last two."""
    (r,) = repetition.quality_rules(docs.where("length(text) > 2000")).collect()
    assert (r["n_words"], r["word_chars"], r["longest_repeat"], r["longest_chars"], r["covered_chars"], r["kept"]) == (1, 18000, 17998, 17998, 18000, False)


def test_suffix_order():
    rng = np.random.default_rng(4)
    for _ in range(100):
        parts = [[bytes([97 + x]) for x in rng.integers(0, rng.integers(1, 4), rng.integers(0, 25))] for _ in range(3)]
        symbols, ends, text = repetition._numbered(parts)
        order, levels = repetition.sorted_suffixes(symbols, ends)
        tails = [symbols[i : ends[i]].tolist() for i in range(len(symbols))]
        assert [tails[i] for i in order] == sorted(tails)
        shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert repetition.shared_prefixes(order, levels).tolist() == [shared(tails[order[i - 1]], tails[order[i]]) if i else 0 for i in range(len(order))]


def test_empty_tables(spark, docs):
    none, items = docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")
    for df in (infill.fill_in_middle(none), repetition.quality_rules(none), lexical.rank_documents(none, items), lexical.rank_documents(docs, items.limit(0)), lexical.rank_documents(docs.where("text = ''"), items)):
        assert df.isEmpty()


def test_keys_of_any_type(spark):
    docs = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), (None, "one two three")], "id string, body string")
    assert {r["id"]: r["restored"] for r in infill.fill_in_middle(docs, key="id", text="body").withColumn("restored", infill.restored()).collect()} == dict.fromkeys(["a", "b", None], "one two three")
    assert repetition.quality_rules(docs, "id", "body").count() == 3
    items = spark.createDataFrame([("q", "two words")], "name string, asks string")
    got = lexical.rank_documents(docs.union(spark.createDataFrame([("z", "other")], docs.schema)), items, 10, "id", "body", "name", "asks").collect()
    assert [(r["name"], r["rank"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", ["op10_repeated_windows", "op11_fenwick_infill", "op12_geometric_blocks"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for f in ("documents", "benchmark"):
        con.sql(f"create view {f} as select * from '{DATA}/{f}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
