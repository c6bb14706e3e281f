"""Secret scans: base patterns, and candidates confirmed by decoding their structure.

The base kinds (assign, access, hex) are patterns alone. A further candidate is reported only if, decoded
from base64 or hex, it parses: as a DER key whose nested lengths fill each other exactly (der), as an armoured
private key with such a body or an OpenSSH one (pem), as a signed token whose header names an algorithm (jwt),
or as an OpenSSH key with length-prefixed fields (ssh).

Elements nested more than twelve deep, which no key format has, count as no key.

Defined results: a null or empty text has no spans and the digest of no spans; repeated rows keep a row
each; an empty table gives an empty result; extra columns are not touched. Positions are code points, ends
exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import slices, span_digests

# The base patterns of the contract; the words that an assignment starts with.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "jwt", "ssh", "der")

_ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40})PRIVATE KEY-----")
_ARMOURED = re.compile(r"[A-Za-z0-9+/=\s:,.-]*")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)")
_SSH = re.compile(r"(?<![A-Za-z0-9+/])AAAA[A-Za-z0-9+/]{60,}={0,2}")
#: DER sequences with a long length begin with 30 8x, so with MI in base64.
_DER64 = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-P][A-Za-z0-9+/_-]{38,}={0,2}")
_DER16 = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9A-Fa-f]{2}){30,}(?![0-9A-Fa-f])")


def _base64(text: str) -> bytes | None:
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _nested(data: bytes, at: int, end: int, depth: int = 0) -> bool:
    """DER elements from ``at`` that end exactly at ``end``, as do the constructed ones in turn."""
    if depth > 12:
        return False
    while at < end:
        if end - at < 2:
            return False
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return False
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + size > end or (tag & 0x20 and not _nested(data, at, at + size, depth + 1)):
            return False
        at += size
    return True


def is_der_key(data: bytes | None) -> bool:
    """A sequence that fills the data and holds at least two elements, an integer or a sequence first, and a body of 16 bytes."""
    if not data or len(data) < 24 or data[0] != 0x30 or not _nested(data, 0, len(data)):
        return False
    width = data[1] & 0x7F if data[1] & 0x80 else 0
    body = data[2 + width :]
    size = body[1] if len(body) > 1 else 0
    return len(body) >= 16 and body[0] in (0x02, 0x30) and not size & 0x80 and len(body) > size + 2 or len(body) > 200 and body[0] in (0x02, 0x30)


def is_ssh_key(data: bytes | None) -> bool:
    """Length-prefixed fields that fill the data, the first an algorithm's name; or the private format's magic."""
    if not data:
        return False
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and re.match(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+$", fields[0]) is not None


def is_signed_token(header: str, payload: str) -> bool:
    try:
        head, body = json.loads(_base64(header) or b""), json.loads(_base64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _armoured(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the private keys between a line of armour and the next one, if that ends the same kind of key."""
    opened = None
    for m in _ARMOUR.finditer(text):
        if m[1] == "END" and opened and opened[2] == m[2] and _ARMOURED.fullmatch(text, opened.end(), m.start()) and _pem_body(text[opened.end() : m.start()]):
            yield opened.start(), m.end()
        opened = m if m[1] == "BEGIN" else None


def _pem_body(body: str) -> bool:
    lines = [line for line in body.split("\n") if ":" not in line]
    data = _base64("".join("".join(lines).split()))
    encrypted = "ENCRYPTED" in body
    return data is not None and (is_der_key(data) or is_ssh_key(data) or encrypted and len(data) >= 64)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind as listed."""
    found = []
    folded = text.encode("utf-8", "surrogatepass").lower()
    if any(word in folded for word in _ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of candidates whose decoded structure holds."""
    found = []
    if "-----BEGIN" in text:
        found += [("pem", *span) for span in _armoured(text)]
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    if "AAAA" in text:
        found += [("ssh", *m.span()) for m in _SSH.finditer(text) if is_ssh_key(_base64(m[0]))]
    starts, ends = (sorted(x) for x in zip(*((a, b) for kind, a, b in found if kind == "pem"), strict=True)) if any(f[0] == "pem" for f in found) else ([], [])
    inside = lambda a, b: (i := bisect_right(starts, a)) > 0 and b <= ends[i - 1]  # noqa: E731  armoured keys don't overlap
    loose = [m.span() for m in _DER64.finditer(text) if is_der_key(_base64(m[0]))] if "M" in text else []
    if "30" in text:
        loose += [m.span() for m in _DER16.finditer(text) if is_der_key(bytes.fromhex(m[0]))]
    found += [("der", a, b) for a, b in loose if not inside(a, b)]
    return found


def find_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind, start, end, base>>) of each document, by start, then kind as listed."""
    kind = docs.schema[key].dataType.simpleString()

    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for value in batch.column(1):
                value = value.as_py() or ""
                own = [(*s, True) for s in base_spans(value)] + [(*s, False) for s in confirmed_spans(value)]
                own.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                out.append([{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in own])
            yield pa.record_batch([batch.column(0), pa.array(out, spans)], [key, "spans"])

    return docs.select(key, text).mapInArrow(scan, f"`{key}` {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans): spans as ``kind:start:end``, comma-joined."""
    return span_digests(find_secrets(docs, key=key, text=text), {f"n_{kind}": kind for kind in BASE_KINDS}, key=key)
