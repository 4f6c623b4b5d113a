"""Operator 13: quality rules on repetition.

The suffixes of every text, as sequences of words, are sorted by prefix doubling; prefixes that neighbours share give the intervals of
suffixes with a common beginning, and those that cannot be longer to either side are the maximal repeated substrings. The union of
their places must not cover too much of a text, and none may be too long. Texts of a batch are sorted together: words of different
texts have different numbers, so no prefix is shared between texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_groups

#: Words of the windows of the base rule; least words of a text; percent of the words that may lie in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Least words and code points in them of a repeated substring that counts; percent of a text's word characters that such may cover; words that the longest may have.
LEAST_REPEAT, LEAST_CHARS, MOST_COVERED, MOST_LONGEST = 4, 16, 30, 50
#: A word of more bytes is searched as its code points, each of which counts as a word of its own, so that texts without spaces are searched too.
LONG_WORD = 64
SYMBOLS = b"#*$%&|<>"


def sorted_suffixes(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, levels): the suffixes in order, and for each k the ranks of all suffixes by their first 2**k symbols.

    ``ends``: for each place the end of its text. Two suffixes have the same rank in a level if and only if both are that
    long and begin alike. Each round sorts only the suffixes that are still tied. Levels end at the longest repeat, so memory is
    four bytes a symbol for each doubling up to it.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    key, slots = symbols[order], np.arange(n)
    rank, levels, h = np.zeros(n + 1, np.int64), [], 1
    rank[n] = -1
    at = order
    while len(slots):
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        slots = slots[~(new & np.r_[new[1:], True])]
        at = order[slots]
        follow = at + h
        key = rank[at] * (n + 2) + np.where(follow < ends[at], rank[np.minimum(follow, n)] + 2, 0)
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[slots] = at
        h *= 2
    return order, levels


def shared_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each place in the order the symbols that its suffix shares with the one before."""
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp
    k = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    i, j = order[k - 1], order[k]
    for level in range(len(levels) - 1, -1, -1):
        same = (levels[level][i] == levels[level][j]) << level
        lcp[k] += same
        i, j = i + same, j + same
    return lcp


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, symbols: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(symbols, first, last place in the order) of every repeated substring of at least so many symbols that cannot be made longer to the left or right in all its places."""
    before = np.where(order > 0, symbols[order - 1], -1)
    changes = np.cumsum(np.r_[False, before[1:] != before[:-1]])
    found, stack = [], []
    places = np.flatnonzero(lcp >= least)
    # Runs of shared prefixes that are long enough; a sentinel of zero closes each.
    for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1) if len(places) else []:
        first = int(run[0]) - 1
        for place, length in [*zip(run.tolist(), lcp[run].tolist()), (int(run[-1]) + 1, 0)]:
            low = place - 1 if place > first + 1 else first
            while stack and stack[-1][0] > length:
                size, low = stack.pop()
                if changes[place - 1] > changes[low]:
                    found.append((size, low, place - 1))
            if length and (not stack or stack[-1][0] < length):
                stack.append((length, low))
    return found


def reaches(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place of the text the symbols of the longest repeated substring that begins there."""
    reach = np.empty(len(order), np.int64)
    reach[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return reach


def covered(reach: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each symbol lies in a repeated substring; ``counts`` tells of each place whether the longest one there is long enough. These make the same union as the maximal ones."""
    at = np.flatnonzero(counts)
    steps = np.bincount(at, minlength=len(reach) + 1) - np.bincount(at + reach[at], minlength=len(reach) + 1)
    return np.cumsum(steps[:-1]) > 0


def _numbered(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, ends, text) of the symbols of several texts, equal within a text and different between texts."""
    codes: list[int] = []
    total = 0
    for own in parts:
        ids: dict[bytes, int] = {}
        codes += [total + ids.setdefault(w, len(ids)) for w in own]
        total += len(ids)
    sizes = np.array([len(x) for x in parts], np.int64)
    text = np.repeat(np.arange(len(parts)), sizes)
    return np.array(codes, np.int64), np.repeat(np.cumsum(sizes), sizes), text


def _points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def _fine(words: list[bytes]) -> list[bytes]:
    """The words, long ones as their code points."""
    return [p for w in words for p in ([w] if len(w) <= LONG_WORD else [c.encode() for c in w.decode()])]


def repetition_of(texts: list[str], window: int = WINDOW, least: int = LEAST_REPEAT, least_chars: int = LEAST_CHARS) -> dict[str, np.ndarray]:
    """Columns of counts for a batch of texts; see ``quality_rules``."""
    datas = [t.encode() for t in texts]
    words = [d.split() for d in datas]
    n = len(texts)
    out = {"n_words": np.array([len(w) for w in words], np.int64)}
    out["word_chars"] = np.array([_points(b"".join(w)) for w in words], np.int64)
    out["n_symbols"] = np.array([len(d) - len(d.translate(None, SYMBOLS)) for d in datas], np.int64)
    lines = [[x for x in d.split(b"\n") if x.strip()] for d in datas]
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)

    def search(parts: list[list[bytes]]):
        symbols, ends, text = _numbered(parts)
        order, levels = sorted_suffixes(symbols, ends)
        lcp = shared_prefixes(order, levels)
        return symbols, text, order, lcp, reaches(order, lcp)

    symbols, text, order, lcp, reach = search(words)
    out["n_repeat_words"] = np.bincount(text[covered(reach, reach >= window)], minlength=n)

    fine = [_fine(w) if w and max(map(len, w)) > LONG_WORD else w for w in words]
    if any(a is not b for a, b in zip(fine, words)):
        symbols, text, order, lcp, reach = search(fine)
    flat = [s for f in fine for s in f]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    codes = np.frombuffer(b"".join(flat), np.uint8)
    chars = np.add.reduceat((codes & 0xC0) != 0x80, np.cumsum(sizes) - sizes, dtype=np.int64) if len(flat) else np.zeros(0, np.int64)
    ends = np.r_[0, np.cumsum(chars)]
    repeats = np.array(maximal_repeats(order, lcp, symbols, least), np.int64).reshape(-1, 3)
    length, start = repeats[:, 0], order[repeats[:, 1]]
    size = ends[start + length] - ends[start]
    long = size >= least_chars
    own, length, size = text[start[long]], length[long], size[long]
    out["n_repeats"] = np.bincount(own, minlength=n)
    out["longest_repeat"], out["longest_chars"] = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(out["longest_repeat"], own, length)
    np.maximum.at(out["longest_chars"], own, size)
    at = np.arange(len(reach))
    inside = covered(reach, (reach >= least) & (ends[at + reach] - ends[at] >= least_chars))
    out["covered_chars"] = np.bincount(text[inside], chars[inside], minlength=n).astype(np.int64)
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "longest_repeat", "longest_chars", "covered_chars"]


def count_repetition(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, least: int = LEAST_REPEAT, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row a row: key and COUNTS.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier one), n_repeat_words (words in windows of
    ``window`` words found twice or more); and of the maximal repeated substrings of at least ``least`` words and ``least_chars`` code points in them: n_repeats (different ones),
    longest_repeat (words; code points count for words inside words of over LONG_WORD bytes), longest_chars, covered_chars (code points in words that lie in one).
    Null text counts as empty, with zeros. Repeated rows and null keys are rows like any other; other columns are dropped. A text of any length is
    sorted in one task, in memory of some 60 bytes a word and 4 more for each doubling up to its longest repeat.
    """
    kind = dict(docs.dtypes)[key]
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def work(keys: pa.Array, texts: list[str]) -> dict:
        return {"_key": keys, **{c: pa.array(v, pa.int64()) for c, v in repetition_of(texts, window, least, least_chars).items()}}

    def run(batches):
        for batch in batches:
            schema = pa.schema([batch.schema.field("_key"), *[(c, pa.int64()) for c in COUNTS]])
            yield from by_groups(work, schema, "_key", "_text")([batch])

    return own.mapInArrow(run, f"_key {kind}, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("_key", key)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", most_covered: int = MOST_COVERED, most_longest: int = MOST_LONGEST) -> DataFrame:
    """The counts of ``count_repetition`` and base_failed, kept.

    base_failed: fewer than LEAST_WORDS words, or over MOST_REPEATED percent of them in repeated windows. A text is kept if it has not failed so, its repeated
    substrings cover at most ``most_covered`` percent of its word characters and none has over ``most_longest`` words.
    """
    counts = count_repetition(docs, key, text)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    fine = (100 * F.col("covered_chars") <= most_covered * F.col("word_chars")) & (F.col("longest_repeat") <= most_longest)
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
