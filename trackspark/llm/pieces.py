"""Operator 9: SentencePiece encoding and decoding for merge-type vocabularies.

A unit's characters are symbols; an agenda holds adjacent pairs that form a piece, ordered by score and
then by place. The best pair is merged and the pairs of the new symbol with its neighbours enter, until the agenda is empty.
Symbols that are no piece fall back to bytes. Units are the text's stretches that no piece can
cross. Every new unit is checked against the sentencepiece library, in one call an Arrow batch, and some texts
as a whole. A text is decoded from all its ids, piece by piece.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import resident, row_groups

SPACE = "▁"
#: Bytes that a Python worker's units may take before it starts anew.
MEMORY_BYTES = 160 << 20
#: One text in so many is also compared whole with the library's encode and decode; a difference ends the job.
CHECK_EVERY = 32
#: Texts that any other normalisation would change: spaces in runs and at the ends, controls, ligatures, widths, composed and decomposed letters.
PROBES = ["a", "  a  b ", "\ta\r\nb\u00a0c\u3000d\u200be\ufeff", "\ufb01\uff21\u2460\u00bd\u2126", "e\u0301 \u00e9 \uac00\u1100\u1161", "A\u0130\u00df", "\x00\x01\x7f\x85\u2028"]


class Coder(dict):
    """unit -> ids joined by commas, for one model file. Units have plain spaces; ``unlike`` has those whose ids by the agenda are not the library's."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.rank = {pieces[i]: -lib.get_score(i) for i in plain}
        self.id_of = {pieces[i]: i for i in plain}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_fall_back = lib.is_byte(self.byte_ids[0])
        self.pieces = pieces
        joins = [p for p in self.rank if len(p) > 1]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in joins):
            raise ValueError("pieces of this model run across spaces")
        # A line feed that is in no longer piece also parts units.
        self.feed_parts = not any("\n" in p for p in joins)
        self.unit = re.compile(r"\n| *[^ \n]+| +" if self.feed_parts else r" *[^ ]+| +")
        # A model that only marks spaces and puts one in front is spared the library's slower normalisation.
        self.marks_only = all(lib.normalize(t) == self.marked(t) for t in PROBES)
        self.unlike: set[str] = set()
        self.held = 0
        # Text of each id, by its decimal digits; a byte stands as its escape until the text is whole.
        self.spelled = {str(i): "" if lib.is_control(i) else " \u2047 " if lib.is_unknown(i) else p.replace(SPACE, " ") for i, p in enumerate(pieces)}
        if self.bytes_fall_back:
            self.spelled |= {str(i): bytes([b]).decode("ascii", "surrogateescape") for b, i in enumerate(self.byte_ids)}

    @staticmethod
    def marked(text: str) -> str:
        return SPACE + text.replace(" ", SPACE)

    def merge(self, unit: str) -> list[int]:
        """Ids of a unit by the agenda: entries (rank, a, b, c) would join the symbols a..b and b..c."""
        text, find = unit.replace(" ", SPACE), self.rank.get
        n = len(text)
        end, start = [*range(1, n + 1), 0], [*range(-1, n)]
        agenda = [(r, a, a + 1, a + 2) for a in range(n - 1) if (r := find(text[a : a + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, c = heapq.heappop(agenda)
            if end[a] != b or end[b] != c:
                continue  # a side has been merged since
            end[a], end[b], start[c] = c, 0, a
            if c < n and (r := find(text[a : end[c]])) is not None:
                heapq.heappush(agenda, (r, a, c, end[c]))
            if a and (r := find(text[start[a] : c])) is not None:
                heapq.heappush(agenda, (r, start[a], a, c))
        ids: list[int] = []
        a = 0
        while a < n:
            symbol = text[a : end[a]]
            a = end[a]
            if symbol in self.id_of:
                ids.append(self.id_of[symbol])
            else:
                ids += [self.byte_ids[b] for b in symbol.encode()] if self.bytes_fall_back else [self.library.unk_id()]
        return ids

    def learn(self, units: set[str]) -> None:
        """Encode what is new; hold it against the library, whose ids count where they differ."""
        new = [u for u in units if u not in self]
        if self.held > MEMORY_BYTES:
            self.clear()
            self.unlike.clear()
            self.held, new = 0, list(units)
        self.held += sum(map(len, new)) + 250 * len(new)
        # The library puts a space in front of each text: take it from units that begin with one, else shield by a line feed.
        asked = [u[1:] if u[0] == " " else "\n" + u for u in new]
        for unit, theirs in zip(new, self.library.encode(asked, num_threads=1)):
            ids = self.merge(unit)
            if unit[0] != " ":
                theirs = theirs[2:] if self.feed_parts else ids
            elif len(unit) == 1:
                theirs = ids
            if ids != theirs:
                self.unlike.add(unit)
                ids = theirs
            self[unit] = ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[tuple[str, bool]]:
        """(ids joined by commas, whether they are the agenda's own) of each text."""
        # The mark of a space in a text is to the model a space like any other.
        parts = [(self.unit.findall(" " + t.replace(SPACE, " ")) if t else []) if self.marks_only else None for t in texts]
        try:
            return [(self.whole(t), False) if p is None else self.joined(p) for t, p in zip(texts, parts)]
        except KeyError:
            self.learn({u for p in parts if p for u in p})
            return [(self.whole(t), False) if p is None else self.joined(p) for t, p in zip(texts, parts)]

    def joined(self, units: list[str]) -> tuple[str, bool]:
        return ",".join(map(self.__getitem__, units)), not self.unlike or self.unlike.isdisjoint(units)

    def whole(self, text: str) -> str:
        """The ids by the library alone, for models that normalise texts in other ways."""
        return ",".join(map(str, self.library.encode(text)))

    def decode(self, ids: str) -> str:
        """The text that the ids stand for: their pieces in a row, without the mark that the library puts in front."""
        if not ids:
            return ""
        numbers = ids.split(",")
        text = "".join(map(self.spelled.__getitem__, numbers))
        first = next((i for i in numbers if self.spelled[i]), "")
        text = text[1:] if first and self.pieces[int(first)].startswith(SPACE) else text
        if text.isascii() or not any("\udc80" <= c <= "\udcff" for c in set(text)):
            return text
        try:
            return text.encode("utf-8", "surrogateescape").decode()
        except UnicodeDecodeError:  # bytes that no text encodes to
            return self.library.decode([int(i) for i in numbers])


def coder(path: str) -> Coder:
    return resident(f"coder {path}", lambda: Coder(path))


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False, check_every: int = CHECK_EVERY) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256, by_agenda (and with ``ids``: ids, decoded) of every whole text.

    by_agenda says whether the agenda alone gave the ids; it is false where the library disagreed on a unit, so that its ids were taken, or where
    the model normalises texts in other ways than by marking spaces and they went to the library whole. Null counts as empty: no ids, empty decoded text. Null keys and repeated rows give rows of their own; other columns are not read.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = coder(path)
        for batch in batches:
            n_tokens, digests, decoded_digests, own_way, lists, spelled = [], [], [], [], [], []
            for first, end in row_groups(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(first, end - first).to_pylist()]
                for k, (t, own) in enumerate(zip(texts, enc.encode(texts))):
                    joined, by_agenda = own
                    decoded = enc.decode(joined)
                    if k % check_every == 0 and (joined != enc.whole(t) or decoded != enc.library.decode([int(i) for i in joined.split(",")] if joined else [])):
                        raise ValueError("a text's ids or its decoded text are not those of the sentencepiece library")
                    own_way.append(by_agenda)
                    n_tokens.append(joined.count(",") + 1 if joined else 0)
                    digests.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if ids:
                        lists.append([int(i) for i in joined.split(",")] if joined else [])
                        spelled.append(decoded)
            columns = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(digests), pa.array(decoded_digests), pa.array(own_way, pa.bool_())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "by_agenda"]
            if ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(spelled, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids array<int>, decoded string" if ids else ""
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, by_agenda boolean{more}")


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with ``out``: the text of their ids; null ids give null, none an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids)).to_pylist()
            texts = [None if x is None else own.decode(",".join(map(str, x))) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    docs = docs.drop(out)
    ddl = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{ddl}, `{out}` string")
