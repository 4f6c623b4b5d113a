"""Operator 4: language identification by script ranges and Viterbi spans.

A word's script narrows the languages to those learned in that script; its hashed character n-grams give
each of them a score. Over a text's words, Viterbi with a penalty for each switch labels spans; a text's
language is the one whose spans hold most letters. Words of a script that no language was learned in speak for none. Counts are learned on Spark from a bounded, hash-chosen
sample of the labelled rows; the model is languages x BUCKETS numbers, whatever the input.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MEMORY_BYTES, resident, row_groups

#: Labelled documents that the model is fitted on, chosen by a hash of the key; all if there are fewer.
TRAIN_DOCS = 20_000
#: Hash buckets of character n-grams of 1 to 4 characters.
BUCKETS = 1 << 16
#: Log-probability that a change of language costs, and weight of a word's n-grams, which overlap.
SWITCH, WEIGHT = 8.0, 0.4
UND = "und"
DIGIT = re.compile(r"\d")

# First and last code points of scripts (blocks of letters), in code order.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x137F)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
SCRIPT_NAMES = [*SCRIPTS, "other"]
_ranges = sorted((a, b, SCRIPT_NAMES.index(name)) for name, spans in SCRIPTS.items() for a, b in spans)
_lows, _highs, _kinds = (np.array(x) for x in zip(*_ranges))
_letters: list[np.ndarray] = []


def is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)], bool))
    return _letters[0][codes]


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """Number of each code point's script in SCRIPT_NAMES."""
    at = np.searchsorted(_lows, codes, side="right") - 1
    inside = (at >= 0) & (codes <= _highs[at])
    return np.where(inside, _kinds[at], len(SCRIPT_NAMES) - 1)


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram, and the words' letters and scripts (that of the first letter, -1 without one).

    Words are set in a row between spaces, which serve as their borders in the n-grams.
    """
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    space = codes == 32
    word = np.cumsum(space) - 1
    letter = is_letter(codes)
    letters = np.bincount(word[letter], minlength=len(words))[: len(words)]
    scripts = np.full(len(words), -1)
    at = np.flatnonzero(letter)[::-1]
    scripts[word[at]] = scripts_of(codes[at])
    numbers, buckets = [], []
    h = np.zeros(len(codes), np.uint64)
    clear = np.ones(len(codes), bool)
    for n in range(1, 5):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :].astype(np.uint64) + np.uint64(1)
        # A space may only be the first or the last of an n-gram, and not all of it.
        clear = clear[:m] & ~space[n - 2 : n - 2 + m] if n > 2 else clear[:m]
        good = clear & ~space if n == 1 else clear.copy()
        mixed = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
        numbers.append(word[:m][good])
        buckets.append((mixed >> np.uint64(40)).astype(np.int64)[good] & (BUCKETS - 1))
    return np.concatenate(numbers), np.concatenate(buckets), letters, scripts


def held_out(key: str, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == part


class Model:
    """Languages in order, log-probabilities (BUCKETS, languages), which languages were learned in which script, and the
    mean log-probabilities (2, languages) of a language's own n-grams and of n-grams drawn blindly."""

    def __init__(self, languages: list[str], scores: np.ndarray, candidates: np.ndarray, levels: np.ndarray):
        self.languages, self.scores, self.candidates, self.levels = languages, scores, candidates, levels


def quotas(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Rows of each language in a sample of ``most``: equal parts, and what small languages leave goes to the others."""
    out: dict[str, int] = {}
    for i, (l, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[l] = min(n, max(1, (most - sum(out.values())) // (len(sizes) - i)))
    return out


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TRAIN_DOCS) -> Model:
    """Fit on the rows with a label and a text, of which a hash of the key and text picks some ``most``, with a quota for each language."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}
    if sum(sizes.values()) > most:
        limits = F.create_map(*[F.lit(x) for l, q in quotas(sizes, most).items() for x in (l, int(np.ceil(1_000_000 * q / sizes[l])))])
        rows = rows.where(F.pmod(F.xxhash64(key, F.length(text)), F.lit(1_000_000)) < F.element_at(limits, F.col(lang)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            words: dict[str, Counter] = {}
            for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(l, Counter()).update(t.lower().split())
            for l, found in words.items():
                if not found:
                    continue
                number, bucket, letters, scripts = word_grams(list(found))
                times = np.array(list(found.values()), np.float64)
                own = counts.setdefault(l, np.zeros(BUCKETS + len(SCRIPT_NAMES)))
                own[:BUCKETS] += np.bincount(bucket, weights=times[number], minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(scripts[letters > 0], weights=times[letters > 0], minlength=len(SCRIPT_NAMES))
        for l, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at)), pa.array(at, pa.int32()), pa.array(own[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counted = rows.select(text, lang).mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counted["lang"].to_pylist()))
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    place = {l: i for i, l in enumerate(languages)}
    table[counted["bucket"].to_numpy(), [place[l] for l in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    scores = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)) if languages else grams
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    own = (grams / np.maximum(grams.sum(axis=0), 1) * scores).sum(axis=0)
    return Model(languages, scores.astype(np.float32), share >= 0.01, np.stack([own, scores.mean(axis=0)]))


class Scorer(dict):
    """word -> number of its row in ``rows``: scores of the languages, centred, and of none; log-probability of its n-grams in the best; their number; its letters."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.held = model, 0
        self.rows = np.zeros((0, len(model.languages) + 4), np.float32)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if self.held > MEMORY_BYTES:
            self.clear()
            self.held, self.rows, new = 0, self.rows[:0].copy(), list(words)
        self.held += sum(map(len, new)) + 250 * len(new)
        number, bucket, letters, scripts = word_grams(new)
        m, k = self.model, len(self.model.languages)
        own = np.zeros((len(new), k + 4), np.float32)
        for l in range(k):
            own[:, l] = WEIGHT * np.bincount(number, weights=m.scores[bucket, l], minlength=len(new))[: len(new)]
        allowed = m.candidates[scripts] & (scripts >= 0)[:, None]
        some = allowed.any(axis=1)
        top = np.where(allowed, own[:, :k], -np.inf).max(axis=1, initial=-np.inf)
        # Languages not learned in the word's script trail the candidates; words of no learned script speak against all languages, words without letters say nothing.
        against = (-SWITCH / 2 * letters).clip(-4 * SWITCH)[:, None]
        own[:, :k] = np.where(some[:, None], np.where(allowed, own[:, :k] - np.where(some, top, 0)[:, None], -4 * SWITCH), against)
        own[:, :k] = own[:, :k].clip(-4 * SWITCH)
        own[:, k] = np.where(some, -4 * SWITCH, 0)
        # Words with digits (keys, addresses) count in no likelihood.
        plain = some & ~np.fromiter((DIGIT.search(w) is not None for w in new), bool, len(new))
        own[:, k + 1] = np.where(plain, top, 0)
        own[:, k + 2] = np.where(plain, np.bincount(number, minlength=len(new))[: len(new)], 0)
        own[:, k + 3] = letters
        first = len(self.rows)
        self.rows = np.concatenate([self.rows, own])
        for i, w in enumerate(new, first):
            self[w] = i

    def of(self, words: list[str]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


def spans(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word on the best path.

    If no stretch gains over half a switch by another language than the text's best, no path beats the
    constant one: a path with m stretches in other languages switches at least m times, or m - 1 if it has no stretch of the best.
    """
    total = scores.sum(axis=0, dtype=np.float64)
    best = int(total.argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, scores.shape[1])), gain[:-1]]), axis=0)
    if (gain - low).max() <= switch / 2:
        return np.full(len(scores), best)
    rows = scores.tolist()
    state, back = rows[0], []
    for row in rows[1:]:
        top = max(state)
        lead = state.index(top)
        base = top - switch
        back.append([lead if x < base else i for i, x in enumerate(state)])
        state = [(x if x >= base else base) + s for x, s in zip(state, row)]
    at = state.index(max(state))
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return np.array(path[::-1])


def _labels(sent, name: str, texts: list, with_spans: bool) -> tuple[list, list, list, list]:
    """lang_pred, score, spans' number and spans of each text, with the worker's scorer for this model."""
    scorer = resident(name, lambda: Scorer(Model(*sent.value)))
    languages, (mean, blind) = scorer.model.languages, np.pad(scorer.model.levels, ((0, 0), (0, 1)))
    names = [*languages, UND]
    lists = [(t or "").lower().split() for t in texts]
    scorer.learn({w for ws in lists for w in ws} or {"-"})
    out: tuple = ([], [], [], [])
    for ws in lists:
        rows = scorer.of(ws)
        letters = rows[:, -1]
        if not letters.sum() or not languages:
            found = (UND, 0.0, 0, [])
        else:
            path = spans(rows[:, :-3])
            held = np.bincount(path, weights=letters, minlength=len(languages) + 1)
            at = int(held.argmax())
            learned = at < len(languages)
            if not learned:  # the likeliest language all the same, at a score of zero
                at = int((held[:-1] if held[:-1].any() else rows[:, : len(languages)].sum(axis=0)).argmax())
            grams, inside = rows[:, -2], (path < len(languages)) & (rows[:, -2] > 0)
            likely = (rows[:, -3] + rows[np.arange(len(path)), path]) / WEIGHT - grams * blind[path]
            full = (grams * (mean - blind)[path])[inside].sum()
            score = float(np.clip(likely[inside].sum() / full, 0, 1) * letters[inside].sum() / (letters[inside].sum() + held[-1])) if learned and full > 0 else 0.0
            bounds = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            found = (names[at], score, len(bounds) - 1, [{"first": x, "end": y, "lang": names[path[x]]} for x, y in zip(bounds, bounds[1:])] if with_spans else [])
        for column, v in zip(out, found):
            column.append(v)
    return out


def annotated(docs: DataFrame, model: Model, text: str = "text", with_spans: bool = False) -> DataFrame:
    """All columns, and lang_pred, lang_score, n_spans (and with ``with_spans``: spans, an array of first word, end word, lang).

    lang_pred is ``und``, score 0, if text is null or has no letter. If words of scripts that no language was learned in
    hold most letters, it is the language of most of the other letters, or of the best sum of scores, and the score is 0. lang_score is the mean log-probability of the text's n-grams in their spans' languages, from 0
    for n-grams drawn blindly to 1 for the language's own, times the share of letters in spans of a learned language; words with digits are left out of both. Without a learned language every text is ``und``. Input columns with these names are replaced.
    """
    made = ["lang_pred", "lang_score", "n_spans", *["spans"] * with_spans]
    docs = docs.drop(*made)
    name = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.scores, model.candidates, model.levels))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_groups(batch.column(place)):
                part = batch.slice(a, b - a)
                out = _labels(sent, name, part.column(place).to_pylist(), with_spans)
                columns = [*part.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int32())]
                if with_spans:
                    columns.append(pa.array(out[3], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *made])

    ddl = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", lang_pred string, lang_score double, n_spans int"
    return docs.mapInArrow(run, ddl + ", spans array<struct<first:int,end:int,lang:string>>" * with_spans)


def label_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 4, part: int = 2, most: int = TRAIN_DOCS) -> DataFrame:
    """key, held_out, lang_pred, score, n_spans of every document; learned only from labelled documents that are not held out.

    Held out are those whose crc32 of the key as text leaves ``part`` on division by ``parts`` (null key: of the empty text). Repeated rows are rows of
    their own and count as often as they stand there; other columns are not read; an empty table gives an empty one.
    """
    model = train(docs.where(~held_out(key, parts, part)), key, text, lang, most)
    found = annotated(docs.select(key, text), model, text)
    return found.select(key, held_out(key, parts, part).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "n_spans")
