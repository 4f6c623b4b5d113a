"""Plain versions of operators, in loops over single characters, words and pairs, for the tests."""

import re
import zlib

import numpy as np

from trackspark.llm import langid

WORD = re.compile("[^\x20\x09-\x0d]+")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def assignment(text, low, at):
    """(end, length of the value) of an assignment that begins at a place, or None; ``low``: the text in lower case."""
    word = next((k for k in KEYWORDS if low.startswith(k, at)), None)
    if word is None:
        return None
    i = at + len(word)
    i += text[i : i + 1] in ("'", '"') and i < len(text)
    while text[i : i + 1] == " ":
        i += 1
    if text[i : i + 1] not in (":", "=") or i >= len(text):
        return None
    i += 1
    while text[i : i + 1] == " ":
        i += 1
    i += i < len(text) and text[i] in "'\""
    end = i
    while end < len(text) and text[end] in VALUE:
        end += 1
    return (end, end - i) if end > i else None


def base_spans(text):
    """Spans of the base kinds as one string in the order asked for."""
    out, at, low = [], 0, lower(text)
    while at < len(text):
        found = assignment(text, low, at)
        if found and found[1] >= 6:
            out.append((at, 0, "assign", found[0]))
        at = found[0] if found else at + 1
    for kind, start, letters, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            end = at + len(start)
            while text.startswith(start, at) and end < len(text) and text[end] in letters:
                end += 1
            if text.startswith(start, at) and end > at + len(start):
                if end - at >= least:
                    out.append((at, 1 + (kind == "hex"), kind, end))
                at = end
            else:
                at += 1
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def script(c):
    return next((i for i, name in enumerate(langid.SCRIPT_NAMES[:-1]) if any(a <= ord(c) <= b for a, b in langid.SCRIPTS[name])), len(langid.SCRIPT_NAMES) - 1)


def grams(word):
    """Buckets of a word's n-grams of 1 to 4 characters; spaces stand at its ends, and none is a space alone."""
    text, out = f" {word} ", []
    for n in range(1, 5):
        for i in range(len(text) - n + 1):
            part = text[i : i + n]
            if n == 1 and part == " ":
                continue
            if n > 1 and part.strip() == "":
                continue
            h = 0
            for c in part:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
            out.append((((h ^ h >> 31) * 0xBF58476D1CE4E5B9 + n) % 2**64 >> 40) & (langid.BUCKETS - 1))
    return out


def word_scores(model, word):
    """(scores of the languages and of none, log-probability in the best language, n-grams, letters) of a word."""
    letters = [c for c in word if c.isalpha()]
    own, k = grams(word), len(model.languages)
    raw = langid.WEIGHT * model.scores[own].astype(np.float64).sum(axis=0)
    floor = -4 * langid.SWITCH
    allowed = model.candidates[script(letters[0])] if letters else np.zeros(k, bool)
    if allowed.any():
        top = raw[allowed].max()
        scores = [max(floor, raw[i] - top) if allowed[i] else floor for i in range(k)] + [floor]
    else:
        top = 0.0
        scores = [max(floor, -langid.SWITCH / 2 * len(letters))] * k + [0.0]
    plain = allowed.any() and not re.search(r"\d", word)
    return scores, top if plain else 0.0, len(own) if plain else 0, len(letters)


_known = {}


def language(model, text):
    """(label, score) of a text by full Viterbi over its words."""
    words = (text or "").lower().split()
    known = _known.setdefault(id(model), {})
    for w in set(words) - set(known):
        known[w] = word_scores(model, w)
    rows = [known[w] for w in words]
    k = len(model.languages) + 1
    if not model.languages or not sum(r[3] for r in rows):
        return "und", 0.0
    state, back = list(rows[0][0]), []
    for scores, *_ in rows[1:]:
        step = [max(range(k), key=lambda j: (state[j] - langid.SWITCH * (j != i), j == i)) for i in range(k)]
        state = [state[j] - langid.SWITCH * (j != i) + scores[i] for i, j in enumerate(step)]
        back.append(step)
    at = max(range(k), key=lambda i: state[i])
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    path.reverse()
    held = [sum(r[3] for r, p in zip(rows, path) if p == i) for i in range(k)]
    best = max(range(k), key=lambda i: (held[i], -i))
    if best == k - 1:
        rest = held[:-1] if any(held[:-1]) else [sum(np.float32(r[0][i]) for r in rows) for i in range(k - 1)]
        return model.languages[max(range(k - 1), key=lambda i: (rest[i], -i))], 0.0
    mean, blind = model.levels
    likely = full = letters = 0.0
    for (scores, top, n, m), p in zip(rows, path):
        if p < k - 1 and n:
            likely += (top + scores[p]) / langid.WEIGHT - n * blind[p]
            full += n * (mean - blind)[p]
            letters += m
    score = min(1.0, max(0.0, likely / full)) * letters / (letters + held[-1]) if full > 0 else 0.0
    return model.languages[best], score


def near_groups(texts, similarity=(4, 5)):
    """The groups of all pairs whose five-word shingle sets are so similar: key -> smallest key of its group."""
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(lower(t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in texts}
    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if similarity[1] * both >= similarity[0] * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return group


def pieces(tokenizer, doc_id, text, capacity=1024):
    """(doc_id, piece, start, length, crc32) of a document's pieces; a remainder comes first."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    cuts = [len(ids)]
    while cuts[-1] > capacity:
        cuts.append(cuts[-1] - capacity)
    bounds = [0, *reversed(cuts)]
    return [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
