"""Secret scans with structural confirmation.

Patterns find base spans. Base64 and hex runs are then decoded, and reported as more spans only if what they hold is
built as it must be: a signed token with a JSON header that names an algorithm, an ASN.1 key whose nested lengths use
up all bytes, or an SSH key blob whose length-prefixed fields do.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, map_rows

# The base patterns. Letters of the assignment's names stand in either case, in ASCII only.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # AKIA[A-Z0-9]+ of 16 or more
HEX = re.compile(r"[0-9a-f]{32,}")  # [0-9a-f]+ of 32 or more
ASSIGN_LEAST = 8
#: Kinds in the order that breaks ties of spans: the base ones, then the confirmed ones.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
HINTS = ("passw", "secret", "token", "api")

PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*(?:PRIVATE|PUBLIC) KEY|CERTIFICATE)-----((?:(?:\s|\\+[nrt])*+[A-Z][A-Za-z0-9-]*+:[^\n\r\\]*+)*+)([A-Za-z0-9+/=\s\\]*+)-----END \1-----")
#: The header of an encrypted PEM body: a cipher, and its first block in hex.
DEK_INFO = re.compile(r"DEK-Info:\x20*([A-Z0-9-]+),\x20*((?:[0-9A-Fa-f]{16}){1,2})(?![0-9A-Fa-f])")
#: Line ends and other characters as string literals write them, and blanks.
ESCAPED = re.compile(r"\\+u([0-9a-fA-F]{4})|\\+[nrt]|\\|\s")
JWT = re.compile(r"(?<![\w-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
HEX_RUN = re.compile(r"[0-9a-fA-F]{24,}")
#: Where a key can begin in a run: a sequence (0x30 and a length), a short length prefix (0x000000), or openssh-key-v1.
STARTS = re.compile(r"(?=M[A-I]|AAAA|b3BlbnNza)")
HEX_STARTS = re.compile(r"(?=30|000000|6[fF]70656[eE]737368)")
PLAIN = str.maketrans("-_", "+/")
MAGIC = b"openssh-key-v1\0"
#: Fields of each type of SSH public key, the type among them.
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4}
#: Elements of the longest sequence that a key has on its two outer levels (ten in a certificate), and some more.
MOST_ITEMS = 16
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind; matches that are too short still use up their text."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    return found + [(*m.span(), "hex") for m in HEX.finditer(text)]


def from_base64(s: str) -> bytes | None:
    body = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the elements that use up data exactly, else None."""
    out, i = [], 0
    while i < len(data):
        if len(out) == MOST_ITEMS or i + 2 > len(data) or data[i] & 0x1F == 0x1F:
            return None
        tag, size, i = data[i], data[i + 1], i + 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or i + k > len(data):
                return None
            size, i = int.from_bytes(data[i : i + k], "big"), i + k
            if size < 0x80:
                return None  # a short length must be written short
        if i + size > len(data):
            return None
        out.append((tag, data[i : i + size]))
        i += size
    return out


SEQUENCE, INTEGER, BITS, OCTETS, OBJECT = 0x30, 0x02, 0x03, 0x04, 0x06


def der_key(data: bytes) -> bool:
    """A key or certificate: one sequence, whose parts are those of PKCS#1, DSA, PKCS#8 (encrypted or not), SEC1, a public key or X.509."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    parts = der_items(outer[0][1])
    if not parts:
        return False
    tags = [t for t, _ in parts]
    algorithm = lambda k: (x := der_items(parts[k][1])) is not None and bool(x) and x[0][0] == OBJECT
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:
        return algorithm(1)
    if tags in ([SEQUENCE, BITS], [SEQUENCE, OCTETS]):
        return algorithm(0)
    if tags in ([INTEGER] * 9, [INTEGER] * 6) or tags == [INTEGER] * 2 and len(parts[0][1]) >= 64:
        return True
    if tags[:2] == [INTEGER, OCTETS] and len(parts[1][1]) in (28, 32, 48, 66):
        return True
    return tags == [SEQUENCE, SEQUENCE, BITS] and der_items(parts[0][1]) is not None and algorithm(1)


def der_size(data: bytes) -> int:
    """Bytes of the sequence that data begins with, 0 if there is none or it is cut off."""
    if len(data) < 2 or data[0] != SEQUENCE:
        return 0
    size, i = data[1], 2
    if size & 0x80:
        k = size & 0x7F
        if not 1 <= k <= 4 or i + k > len(data):
            return 0
        size, i = int.from_bytes(data[i : i + k], "big"), i + k
    return i + size if i + size <= len(data) else 0


def openssh_size(data: bytes) -> int:
    """Bytes of the private key file that data begins with: its names, its public keys and its private part, else 0."""

    def field(i: int) -> tuple[bytes, int]:
        size = int.from_bytes(data[i : i + 4], "big")
        if i + 4 + size > len(data):
            raise ValueError("a field is cut off")
        return data[i + 4 : i + 4 + size], i + 4 + size

    try:
        cipher, i = field(len(MAGIC))
        _, i = field(i)
        _, i = field(i)
        count, i = int.from_bytes(data[i : i + 4], "big"), i + 4
        for _ in range(count):
            public, i = field(i)
            if not ssh_key(public):
                return 0
        private, i = field(i)
    except ValueError:
        return 0
    tag = 16 if re.search(b"gcm|poly1305", bytes(cipher[:64])) else 0
    return i + tag if count and len(private) >= 8 and len(private) % 8 == 0 and i + tag <= len(data) else 0


def ssh_size(data: bytes) -> int:
    """Bytes of the SSH public key blob (length-prefixed fields, the first a key type) or private key file that data begins with, else 0."""
    if bytes(data[: len(MAGIC)]) == MAGIC:
        return openssh_size(data)
    count, most, i = 0, None, 0
    while i < len(data) and count != most:
        size = int.from_bytes(data[i : i + 4], "big")
        if i + 4 + size > len(data):
            return 0
        if not count:
            name = bytes(data[i + 4 : i + 4 + min(size, 64)])
            if not re.fullmatch(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-nistp\d{3}|sk-[a-z0-9-]+@openssh\.com)", name):
                return 0
            most = SSH_FIELDS.get(name, 3 if name.startswith(b"ecdsa") else None)
        count, i = count + 1, i + 4 + size
    return i if count >= 2 else 0


def ssh_key(data: bytes) -> bool:
    """An SSH key that uses up all bytes."""
    return bool(data) and ssh_size(data) == len(data)


def key_at(data: bytes) -> tuple[str, int] | None:
    """The kind and bytes of the key that data begins with."""
    if (size := der_size(data)) and der_key(data[:size]):
        return "der", size
    return ("ssh", size) if (size := ssh_size(data)) else None


def keys_in(body: str, starts: re.Pattern, units: int, octets: int, decode: Callable[[str], bytes]) -> list[tuple[int, int, str]]:
    """Keys in a run whose every `units` characters hold `octets` bytes, tried at each place where one can begin.

    A key says its own length, so characters before and after it are no obstacle. Each alignment is decoded once.
    """
    found, aligned, end = [], {}, 0
    for p in (m.start() for m in starts.finditer(body)):
        if p < end:
            continue
        shift = p % units
        if shift not in aligned:
            aligned[shift] = memoryview(decode(body[shift:]))
        if got := key_at(aligned[shift][(p - shift) // units * octets :]):
            end = p - (-got[1] * units // octets)
            found.append((p, end, got[0]))
    return found


def whole_base64(s: str) -> bytes:
    """What s holds, without a last character that is no byte."""
    return from_base64(s[:-1] if len(s) % 4 == 1 else s) or b""


def run_keys(run: str) -> list[tuple[int, int, str]]:
    """Keys in a run of base64 or hex, each with the padding that belongs to it."""
    body = run.rstrip("=").translate(PLAIN)
    found = []
    for a, b, kind in keys_in(body, STARTS, 4, 3, whole_base64):
        pad = re.match("={0,%d}" % (-(b - a) % 4), run[b : b + 2])
        found.append((a, b + len(pad[0]), kind))
    taken = list(found)
    for m in HEX_RUN.finditer(body):
        more = keys_in(m[0], HEX_STARTS, 2, 1, lambda s: bytes.fromhex(s[: len(s) // 2 * 2]))
        found += [(m.start() + a, m.start() + b, k) for a, b, k in more if not overlaps(taken, m.start() + a, m.start() + b)]
    return found


def overlaps(spans: list[tuple], a: int, b: int) -> bool:
    """Whether a stretch meets one of the spans, which stand in order and apart."""
    k = bisect_left(spans, (b,)) - 1  # the last that begins before b
    return k >= 0 and spans[k][1] > a


def unescaped(m: re.Match) -> str:
    return chr(int(m[1], 16)).strip() if m[1] else ""


def json_object(part: str) -> dict | None:
    """The object that a part of a token holds; one nested deeper than the parser goes counts as an object of unknown members."""
    data = from_base64(part) or b""
    try:
        got = json.loads(data)
    except ValueError:
        return None
    except RecursionError:
        return {} if data.lstrip()[:1] == b"{" else None
    return got if isinstance(got, dict) else None


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    found, pems = [], []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = from_base64(ESCAPED.sub(unescaped, m[3]))
            sealed = DEK_INFO.search(m[2])
            if data and (len(data) % (len(sealed[2]) // 2) == 0 if sealed else der_key(data) or ssh_key(data)):
                pems.append(m.span())
                found.append((*m.span(), "pem"))
    if "eyJ" in text:
        for m in JWT.finditer(text):
            head, body, _ = m[0].split(".", 2)
            if "alg" in (json_object(head) or {}) and json_object(body) is not None:
                found.append((*m.span(), "jwt"))
    for m in RUN.finditer(text):
        if not overlaps(pems, m.start(), m.start() + 1):
            found += [(m.start() + a, m.start() + b, k) for a, b, k in run_keys(m[0])]
    return found


def ordered(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    return base_spans(text) + confirmed_spans(text) if text else []


def mask(text: str | None, spans: list[tuple[int, int, str]] | None = None) -> str | None:
    """The text with each secret replaced by [kind]; overlapping spans are replaced as one, named by the first."""
    if not text:
        return text
    out, at = [], 0
    for a, b, k in sorted(find_secrets(text) if spans is None else spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts and spans (code points, end exclusive).

    Null and empty texts have no spans (the digest is that of ''); a null id stays null; repeated rows each get their
    row; an empty table gives no rows; other columns are ignored. Each row is scanned on its own, whatever its length:
    no shuffle.
    """

    def start() -> Callable[..., tuple]:
        def one(key, text):
            base = base_spans(text) if text else []
            more = confirmed_spans(text) if text else []
            kinds = [k for _, _, k in base]
            digest = hashlib.sha256(ordered(base).encode()).hexdigest()
            return key, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, ordered(base + more)

        return one

    return map_rows(docs, [F.col(id_col).cast("long"), F.col(text_col)], SCHEMA, start)


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with secrets masked in the text; null stays null, all other columns stay as they are."""
    arrow_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def masking(texts: pa.Array) -> pa.Array:
        return pa.array([mask(t) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text_col, masking(F.col(text_col)))
