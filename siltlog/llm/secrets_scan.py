r"""Secrets in texts: base patterns, and candidates confirmed by their structure.

Base kinds, leftmost and not overlapping within a kind: ``assign`` (a name, a sign and 6 or more value characters),
``access`` (an access key id of 20 or more characters), ``hex`` (24 or more hex digits).
Confirmed kinds are reported only after the candidate is decoded and parsed: ``der_key`` (base64 or hex of a DER
private key, encrypted or not: nested lengths must fill the value), ``ssh_key`` (base64 of an openssh key: length-prefixed
parts), ``pem_key`` (a PEM block whose body is one of these, or blocks of the cipher that its headers name), ``jwt`` (a signed token whose header and payload are JSON
objects and whose signature has the length of its algorithm).

Base64 may be wrapped: line breaks are real ones or escaped (\n in JSON and env strings). A key may begin anywhere in a run.

Spans count code points, end exclusive. Cases: a null text counts as empty and has no spans; ids may be null or
repeated; texts are scanned whole; an empty table gives an empty result; other columns are dropped by name first.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "der_key", "ssh_key", "pem_key", "jwt")

#: The end of a line, real or escaped.
_BREAK = r"(?:[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*)"
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
_BREAKS = re.compile(_BREAK)
#: Base64 of a DER sequence and of the openssh magic begin so.
_KEY_START = re.compile(r"(?=M[A-P]|b3BlbnNzaC1rZXktdjEA)")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----([^-]*(?:-(?!----)[^-]*)*)-----END \1PRIVATE KEY-----")
_PEM_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
_DEK = re.compile(r"DEK-Info:\s*[A-Za-z0-9-]+,\s*([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\s*$", re.M)
#: PKCS#5 and PKCS#12 encryption.
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
#: Signature bytes by algorithm; RSA ones are as long as the key.
_SIGNED = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114), "none": (0, 0)} | {k + n: (128, 1024) for k in ("RS", "PS") for n in ("256", "384", "512")}


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at ``at``, if its length is minimal and it ends by ``end``."""
    if at + 2 > end:
        return None
    tag, n, start = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or start + k > end:
            return None
        n, start = int.from_bytes(data[start : start + k], "big"), start + k
        if n < 0x80:
            return None
    return (tag, start, start + n) if start + n <= end else None


def _parts(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill data[at:end] without a gap."""
    out = []
    while at < end:
        if not (x := _tlv(data, at, end)):
            return None
        out.append(x)
        at = x[2]
    return out


def is_der_key(data: bytes) -> bool:
    """A PKCS#1, PKCS#8 (encrypted or not), SEC1 or DSA private key whose nested lengths all fit."""
    top = _tlv(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data) or not (inner := _parts(data, *top[1:])):
        return False
    tags = [t for t, _, _ in inner]
    version = data[inner[0][1] : inner[0][2]] if tags[0] == 2 else b""
    if tags == [0x30, 4]:
        algorithm = _parts(data, *inner[0][1:])
        return bool(algorithm) and algorithm[0][0] == 6 and data[algorithm[0][1] : algorithm[0][2]].startswith(_PBE) and inner[1][2] - inner[1][1] >= 16
    if len(tags) in (6, 9) and set(tags) == {2}:
        return version == b"\0" and all(b > a for _, a, b in inner)
    if len(tags) >= 3 and tags[:3] == [2, 0x30, 4] and version in (b"\0", b"\1"):
        algorithm = _parts(data, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == 6 and bool(_tlv(data, *inner[2][1:]))
    return len(tags) >= 2 and tags[:2] == [2, 4] and version == b"\1" and 16 <= inner[1][2] - inner[1][1] <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:])


def is_ssh_key(data: bytes) -> bool:
    """An openssh private key: magic, three names, the number of keys, then that many public blobs and one private one."""
    return ssh_key_size(data) == len(data)


def ssh_key_size(data: bytes) -> int:
    """The bytes of the openssh private key that data begins with; 0 if it doesn't."""
    if not data.startswith(b"openssh-key-v1\0"):
        return 0
    at = 15

    def part() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(part() is None for _ in range(3)) or at + 4 > len(data):
        return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 1 <= keys <= 16 and all(part() is not None for _ in range(keys + 1)) else 0


def _unbase64(text: str) -> bytes:
    text = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _key_kind(data: bytes) -> str | None:
    return "der_key" if is_der_key(data) else "ssh_key" if is_ssh_key(data) else None


def _key_at(run: str, at: int) -> tuple[int, str] | None:
    """(end, kind) of the key whose base64 begins at ``at`` of run; its own lengths tell where it ends."""
    if run[at] == "M":
        head = _unbase64(run[at : at + 12])  # 9 bytes: tag and length, and what the sequence begins with
        if len(head) < 9:
            return None
        k = head[1] & 0x7F if head[1] & 0x80 else 0
        if k > 4 or head[2 + k] not in (2, 0x30):
            return None
        size = 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])
        end = at - (-4 * size // 3)
        return (end, "der_key") if end <= len(run) and is_der_key(_unbase64(run[at:end])[:size]) else None
    size = ssh_key_size(_unbase64(run[at : len(run) - (len(run) - at) % 4] if (len(run) - at) % 4 == 1 else run[at:]))
    return (at - (-4 * size // 3), "ssh_key") if size else None


def key_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys in base64 runs, which may be wrapped."""
    out = []
    for m in _BASE64.finditer(text):
        raw = m[0].rstrip("=")
        start = _KEY_START.search(raw)
        if not start:
            continue
        run, ends, cuts = "", [], [x.span() for x in _BREAKS.finditer(raw)]
        if cuts:  # run's lines, and where each ends in run and begins in text
            lines = list(zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(raw)]))
            run = "".join(raw[a:b] for a, b in lines)
            n = 0
            for a, b in lines:
                n += b - a
                ends.append((n, m.start() + b))
        else:
            run, ends = raw, [(len(raw), m.start() + len(raw))]
        where = lambda i: next(p - (n - i) for n, p in ends if i < n)
        at = 0
        for x in _KEY_START.finditer(run):
            if x.start() >= at and (found := _key_at(run, x.start())):
                at, kind = found
                end = where(at - 1) + 1
                if at == len(run):  # its padding, as far as it is there
                    end += min(len(m[0]) - len(raw), -(at - x.start()) % 4)
                out.append((where(x.start()), end, kind))
    return out


def is_pem_key(body: str) -> bool:
    """Whether the body of a PEM block is a key, or whole blocks of the cipher that its headers name."""
    lines = [x.strip() for x in re.sub(r"(?:\\+[rnt])+", "\n", body).split("\n")]
    heads = [i for i, x in enumerate(lines) if _PEM_HEADER.match(x)]
    data = _unbase64("".join("".join(x for i, x in enumerate(lines) if i not in heads).split()))
    if _key_kind(data):
        return True
    dek = _DEK.search("\n".join(lines[i] for i in heads))
    return bool(dek) and len(data) >= 32 and len(data) % (len(dek[1]) // 2) == 0


def _is_object(data: bytes) -> dict | None:
    try:
        x = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def is_jwt(header: str, payload: str, signature: str) -> bool:
    head = _is_object(_unbase64(header))
    if not head or not isinstance(head.get("alg"), str) or head["alg"] not in _SIGNED or _is_object(_unbase64(payload)) is None:
        return False
    low, high = _SIGNED[head["alg"]]
    return low <= len(_unbase64(signature)) <= high


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out = key_spans(text)
    for m in _LONG_HEX.finditer(text):
        if m[0][0] in "36" and (kind := _key_kind(bytes.fromhex(m[0]))):
            out.append((m.start(), m.end(), kind))
    if "-----BEGIN " in text:
        out += [(m.start(), m.end(), "pem_key") for m in _PEM.finditer(text) if is_pem_key(m[2])]
    if "." in text and ("ey" in text or "ew" in text):  # a JSON object in base64url begins so
        out += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if m[1][:2] in ("ey", "ew") and is_jwt(m[1], m[2], m[3])]
    return out


def _sorted(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each run of overlapping spans replaced by ``[SECRET]``."""
    out, at = [], 0
    for a, b, _ in _sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, n_assign, n_access, n_hex, n_confirmed, base_sha256 and spans, one row for each of df."""
    rows = df.select(id_col, text_col)

    def scan(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = _sorted(base_spans(text or ""))
                more = confirmed_spans(text or "")
                n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
                out.append((*n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(_sorted(base + more))))
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=[id_col, "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"])

    return rows.mapInArrow(tidy(scan), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string")


def redact_secrets(df: DataFrame, text_col: str) -> DataFrame:
    """df with its secrets replaced by ``[SECRET]``; null texts stay null. Rows and columns stay as they are."""
    names = df.columns
    at = names.index(text_col)

    def scan(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [t if t is None or not (s := base_spans(t) + confirmed_spans(t)) else redact(t, s) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return df.mapInArrow(tidy(scan), df.schema)


def with_lengths(df: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df
