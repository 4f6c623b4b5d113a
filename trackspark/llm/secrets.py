"""Operator 1: secret scans with structural confirmation.

Pattern findings come first; then base64 and hex candidates are decoded, and only those whose bytes parse
as a private key (DER whose nested lengths fit and whose members are those of a private key, or an openssh-key-v1 blob whose public keys and private section are walked field by field) or as a signed
token (three base64url segments, a JSON header that names an algorithm) are reported as spans of their own. A candidate may be wrapped in lines, hex may have colons; where it ends follows from the lengths in it. Public keys and certificates are no secrets.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import by_groups, row_groups

# Fixed patterns of the base kinds; case counts only where said.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Order of kinds for spans with the same start.
KINDS = ["assign", "access", "hex", "pem", "der", "openssh", "jwt"]

# Candidates of the decoders. The first characters follow from what they must decode to: a DER sequence, the openssh magic, a JSON object after white space or none.
LINE_END = r"(?:\\r)?\\n|\r?\n[\x20\t]*"
BREAK = re.compile(LINE_END)
BASE64_START = re.compile(r"(?:M(?<![A-Za-z0-9+]M)[A-I]|b(?<![A-Za-z0-9+]b)3BlbnNzaC1rZXkt)(?=[A-Za-z0-9+/_-]{14}|djEA)")
BASE64_BODY = re.compile(rf"[A-Za-z0-9+/_-]+(?:(?:{LINE_END})[A-Za-z0-9+/_-]+)*")
HEX_START = re.compile(r"3(?<![0-9A-Fa-f]3)0(?=:?[0-9A-Fa-f]{2}:?[0-9A-Fa-f]{2})|6(?<![0-9A-Fa-f]6)[Ff](?=:?70:?65:?6[Ee])")
HEX_BODY = re.compile(rf"[0-9A-Fa-f]+(?:(?::|:?(?:{LINE_END}))[0-9A-Fa-f]+)*")
HEX_BREAK = re.compile(rf":?(?:{LINE_END})|:")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s\\]+?)-----END \1-----")
JWT = re.compile(r"([eICD](?<![A-Za-z0-9_-][eICD])[A-Za-z0-9_-]{12,})(?=\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*))")
OPENSSH = b"openssh-key-v1\x00"


def der_lengths(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> int | None:
    """End of the DER element at ``at`` if its length and the lengths nested in it fit exactly, else None."""
    end = len(data) if end is None else end
    if at + 2 > end or depth > 12:
        return None
    tag, n, body = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or body + k > end:
            return None
        n, body = int.from_bytes(data[body : body + k], "big"), body + k
        if n < 0x80 or n >> (8 * (k - 1)) == 0:
            return None
    if body + n > end:
        return None
    if tag & 0x20:
        inner = body
        while inner < body + n:
            inner = der_lengths(data, inner, body + n, depth + 1)
            if inner is None:
                return None
    return body + n


def members(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the members of a sequence whose lengths ``der_lengths`` has found right."""

    def element(at: int) -> tuple[int, int]:
        n, body = data[at + 1], at + 2
        if n & 0x80:
            body += n & 0x7F
            n = int.from_bytes(data[at + 2 : body], "big")
        return body, body + n

    at, end = element(0)
    out = []
    while at < end:
        body, after = element(at)
        out.append((data[at], data[body:after]))
        at = after
    return out


def is_der_key(data: bytes) -> bool:
    """A DER sequence that fills ``data`` and has the members of a private key.

    After a version of 0 or 1 these are an algorithm and an octet string (PKCS 8), an octet string (elliptic curves), or five integers and more (RSA,
    DSA); an encrypted key is an algorithm and an octet string. A public key has two integers, or an algorithm and a bit string; a certificate's first member holds its own.
    """
    if len(data) < 32 or data[0] != 0x30 or der_lengths(data) != len(data):
        return False
    parts = members(data)
    tags = [t for t, _ in parts]
    if tags[:1] == [0x02] and parts[0][1] in (b"\0", b"\1"):
        return tags[1:3] == [0x30, 0x04] or tags[1:2] == [0x04] or (len(tags) >= 6 and set(tags[1:6]) == {0x02})
    return tags == [0x30, 0x04] and parts[0][1][:1] == b"\x06"


def ssh_string(data: bytes, at: int, end: int) -> int | None:
    """End of the length-prefixed string at ``at``, if it ends by ``end``."""
    if at + 4 > end:
        return None
    after = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return after if after <= end else None


def ssh_fields(data: bytes, at: int, end: int) -> list[bytes] | None:
    """The strings that fill ``data`` from ``at`` to ``end`` exactly."""
    out = []
    while at < end:
        after = ssh_string(data, at, end)
        if after is None:
            return None
        out.append(data[at + 4 : after])
        at = after
    return out


def openssh_end(data: bytes) -> int | None:
    """End of the private key blob that ``data`` begins with, if every field of it is right.

    After the magic stand cipher, kdf and its options, a key count, as many public keys (a name of an algorithm and at least one more field, which fill their
    string exactly) and the private section. A section in the clear has the same check number twice and then the first public key's algorithm; an encrypted one fills whole blocks,
    and ciphers with a tag of their own have it after the section.
    """
    if not data.startswith(OPENSSH):
        return None
    at, head = len(OPENSSH), []
    for _ in range(3):
        after = ssh_string(data, at, min(len(data), at + 260))
        if after is None:
            return None
        head.append(data[at + 4 : after])
        at = after
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return None
    kinds = []
    for _ in range(keys):
        after = ssh_string(data, at, len(data))
        fields = ssh_fields(data, at + 4, after) if after else None
        if not fields or len(fields) < 2 or not re.fullmatch(rb"[a-z0-9@.-]{3,64}", fields[0]):
            return None
        kinds.append(fields[0])
        at = after
    after = ssh_string(data, at, len(data))
    if after is None:
        return None
    section = data[at + 4 : after]
    if head[0] == b"none":
        name = section[12 : 12 + int.from_bytes(section[8:12], "big")]
        return after if section[:4] == section[4:8] and name == kinds[0] else None
    tag = 16 if head[0].split(b"@")[0].endswith((b"gcm", b"poly1305")) else 0
    return after + tag if section and len(section) % 8 == 0 and after + tag <= len(data) else None


def decoded(run: str) -> bytes:
    """Bytes of a base64 run in either alphabet, padded as needed; empty if it does not decode."""
    run = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (ValueError, binascii.Error):
        return b""


def unhexed(run: str) -> bytes:
    """Bytes of a run of hex digits, an odd last one left out; empty if it does not decode."""
    try:
        return bytes.fromhex(run[: len(run) // 2 * 2])
    except ValueError:
        return b""


def is_jwt(header: str, payload: str) -> bool:
    """The header is a JSON object with an algorithm; the payload is one too, or is encrypted (header names enc)."""
    try:
        head = json.loads(decoded(header))
        if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
            return False
        return "enc" in head or isinstance(json.loads(decoded(payload)), dict)
    except (ValueError, RecursionError):
        return False


def der_size(head: bytes) -> int | None:
    """Bytes of the DER sequence that begins with these 10, if its first member can be a private key's: a version of 0 or 1, or a sequence."""
    if len(head) < 6 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    n = int.from_bytes(head[2 : 2 + k], "big") if k else head[1]
    inner = head[2 + k : 5 + k]
    return 2 + k + n if k <= 4 and (inner in (b"\2\1\0", b"\2\1\1") or inner[:1] == b"\x30") else None


def key_kind(data: bytes) -> str | None:
    return "openssh" if openssh_end(data) == len(data) else "der" if is_der_key(data) else None


def key_spans(text: str, start: re.Pattern, body: re.Pattern, breaks: re.Pattern, decode: Callable[[str], bytes], chars: Callable[[int], int], padding: str = "") -> Iterator[tuple[int, int, str]]:
    """Spans of bare keys whose characters begin where ``start`` matches. ``chars``: how many encode so many bytes. A key ends with its line or piece."""
    done = 0
    for m in start.finditer(text):
        if m.start() < done:
            continue
        first = decode(breaks.sub("", text[m.start() : m.start() + 32])[:20])
        size = der_size(first)
        if size is None:
            # The magic, and the length of a cipher's name.
            head = decode(breaks.sub("", text[m.start() : m.start() + 96])[: chars(21) // 4 * 4]) if first.startswith(OPENSSH[:4]) else b""
            if not head.startswith(OPENSSH + b"\0\0"):
                continue
        # All pieces up to the stated length; an openssh blob states its length only in its fields.
        most = len(text) if size is None else m.start() + 4 * chars(size) + 64
        run = body.match(text, m.start(), most)
        pieces, at = [], m.start()
        for x in breaks.finditer(text, m.start(), run.end()):
            pieces.append((at, x.start()))
            at = x.end()
        pieces.append((at, run.end()))
        joint = "".join(text[a:b] for a, b in pieces)
        if size is None:
            size, kind = openssh_end(decode(joint[: len(joint) - (len(joint) % 4 == 1)])), "openssh"
        else:
            kind = "der"
        if size is None or len(joint) < chars(size) or kind == "der" and not is_der_key(decode(joint[: chars(size)])):
            continue
        left = chars(size)
        for a, b in pieces:
            if left <= b - a:
                break
            left -= b - a
        if left == b - a:
            after = text[b : b + 2]
            done = b + len(after) - len(after.lstrip(padding) if padding else after)
            yield m.start(), done, kind


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """What the decoders confirm: PEM blocks, bare base64 or hex keys outside them, signed tokens."""
    out = []
    if "-----BEGIN" in text:
        out = [(*m.span(), "pem") for m in PEM.finditer(text) if key_kind(decoded(re.sub(r"\\[nr]|\s", "", m[2])))]
    last = 0
    for m in JWT.finditer(text):
        if m.start() >= last and is_jwt(m[1], m[2]):
            last = m.end(3)
            out.append((m.start(), last, "jwt"))
    bare = [*key_spans(text, BASE64_START, BASE64_BODY, BREAK, decoded, lambda n: (4 * n + 2) // 3, "="), *key_spans(text, HEX_START, HEX_BODY, HEX_BREAK, unhexed, lambda n: 2 * n)]
    return out + [x for x in bare if not any(a <= x[0] < b for a, b, _ in out)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    return base_spans(text), confirmed_spans(text)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def _rows(key: str, kind: pa.DataType, clean: bool) -> Iterator:
    schema = pa.schema([(key, kind), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), *[("clean_text", pa.string())] * clean])

    def work(keys: pa.Array, texts: list[str]) -> dict:
        out: dict = {f.name: [] for f in schema}
        out[key] = keys
        for text in texts:
            base, more = scan(text)
            for name in ("assign", "access", "hex"):
                out[f"n_{name}"].append(sum(k == name for *_, k in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + more))
            if clean:
                out["clean_text"].append(redacted(text, base + more))
        return out

    return work, schema


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, counts of the base kinds, the digest of the base spans, all spans.

    Null text counts as empty (no spans). Null keys and repeated rows give rows of their own; other
    columns are not read. Overlapping findings of different kinds are all kept. Offsets are code points. An empty table gives an empty
    one; a text is scanned whole, by one task, however long.
    """
    kind = dict(docs.dtypes)[key]
    arrow = to_arrow_type(docs.schema[key].dataType)
    work, schema = _rows(key, arrow, False)
    ddl = f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(key, text).mapInArrow(by_groups(work, schema, key, text), ddl)


def redact_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The same rows with secrets replaced in the text and the length column set anew where text changed; null text stays null.

    All columns stay, repeated rows and null keys with them; an empty table gives an empty one.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, end in row_groups(whole.column(at)):
                batch = whole.slice(first, end - first)
                old = batch.column(at).to_pylist()
                new = [t if t is None else redacted(t, [x for part in scan(t) for x in part]) for t in old]
                columns = list(batch.columns)
                columns[at] = pa.array(new, pa.string())
                if length in batch.schema.names:
                    k = batch.schema.names.index(length)
                    columns[k] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, batch.column(k).to_pylist())], batch.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
