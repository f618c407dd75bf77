"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import json
import random
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom import shared
from gridloom.llm import bpe, common, langid, licenses, media, mixing, quality, queries, secrets, simhash, tokencount, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, __id long"


def docs(spark, items):
    """Rows of (doc_id, text[, lang[, source]]) with columns whose names clash with those that operators use."""
    full = [(*i, *[None] * (4 - len(i)), 0, "x", 0.5, 9) for i in items]
    return spark.createDataFrame(full, SCHEMA)


def got(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a b " * 3000), (5, "same"), (5, "same"), (None, "no id"), (8, "x" * 20000)]


def brute_row(name, text, libraries):
    """What an operator's row must hold for a text, by other means."""
    import re

    t, spaced = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
    raw = t.encode()
    padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    if name == "op1":
        return {"n_words": len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0}
    if name == "op2":
        return {"n_assign": 0, "n_access": 0, "n_hex": 0, "base_sha256": hashlib.sha256(b"").hexdigest(), "spans": ""}
    if name == "op3":
        return {"n_bytes": len(raw), "payload_bytes": len(padded), "payload_sha256": hashlib.sha256(padded).hexdigest(), "tail_crc32": zlib.crc32(padded[-64:]), "media_bytes": len(padded) + 44, "feature": f"audio/wav:{len(padded) + 44}:", "declared_type": "application/octet-stream", "corrected_type": "audio/wav"}
    if name == "op5":
        n = len(libraries[0].encode(t))
        return {"n_bytes": len(raw), "n_tokens": n, "over_limit": n > 4096}
    if name == "op6":
        return {"lang_pred": "und", "score": 0.0}
    if name == "op7":
        twice = len(spaced) if len(spaced) > 6 and len(set(spaced)) <= 2 else 0
        return {"n_words": len(spaced), "word_chars": sum(map(len, spaced)), "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": twice, "base_failed": True, "kept": False}
    if name == "op8":
        return {"fingerprint": f"{brute_components([(0, text)])[0]:016x}"}
    if name == "op9":
        return {"size": len(spaced)}
    ids = libraries[1].encode(t, add_special_tokens=False).ids
    return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), "decoded_sha256": hashlib.sha256(libraries[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()}


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_edges_and_empty_tables(spark, tmp_path, name):
    import sentencepiece
    import tokenizers

    libraries = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(queries.PIECES)), tokenizers.Tokenizer.from_file(queries.vocabulary(queries.WORDS))
    key, fn = next((k, q) for k, q in queries.QUERIES.items() if k.startswith(name + "_"))
    for part, items in (("full", EDGE), ("none", [])):
        docs(spark, items).write.parquet(f"{tmp_path}/{part}/documents.parquet")
        rows = fn(spark, f"{tmp_path}/{part}").collect()
        assert sorted((r["doc_id"] for r in rows), key=str) == sorted((i[0] for i in items), key=str), key
        texts = dict(items)
        for r in rows:
            for column, value in brute_row(name, texts[r["doc_id"]], libraries).items():
                assert r[column] == value, (key, r["doc_id"], column)


# 1
def test_license_automaton_equals_regular_expressions(spark):
    import re

    random.seed(1)
    vocab = sorted({w for t in licenses.TEMPLATES.values() for w in licenses.words_of(t)})[:40] + ["licensed", "under", "the", "mit", "license", "cc", "by", "nc", "4", "0"]
    scan = licenses.LicenseScanner()
    texts = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "(c) Copyright (C) 2020 Some One. ALL rights reserved", "under the mit licence", "Licensed under the Apache License, Version 2.0."]
    texts += [" ".join(random.choices(vocab, k=random.randint(0, 30))) for _ in range(300)]
    for t in texts:
        n, base, accepted = scan(t)
        joined = " " + "".join(w + " " for w in licenses.words_of(t))
        assert {x[2] for x in accepted} == {k for k, v in licenses.TEMPLATES.items() if re.search(licenses.as_regex(v), joined)}, t
        w = licenses.words_of(t)
        assert len(base) == sum(w[i : i + len(p.split())] == p.split() for p in licenses.BASE_PHRASES for i in range(len(w))) and n == len(w)
    assert [x[2] for x in scan(texts[0])[2]] == ["cc-by-nc-4.0-notice"] and scan("Aİb K")[0] == 2


def test_license_alternatives_of_several_words():
    templates = {"x": "provided <<alt:as is|with all faults|sold>> today"}
    scan = licenses.LicenseScanner(templates)
    labels = lambda t: [p[2] for p in scan(t)[2]]
    for t in ("Provided AS-IS today", "provided with all faults, today", "provided sold today"):
        assert labels(t) == ["x"], t
    for t in ("provided faults today", "provided as today", "provided is today", "provided as is with all faults today", "provided today"):
        assert not labels(t), t
    with pytest.raises(ValueError):
        licenses.parse("a <<alt:b|>> c")


def test_whole_license_texts():
    """A text with an altered condition loses the text's label, but keeps those of the parts that still match."""
    scan = licenses.LicenseScanner()
    mit = licenses.TEMPLATES["mit"].replace("<<opt>>including the next paragraph<</opt>>", "").replace("<<alt:authors or copyright holders|copyright holders>>", "authors or copyright holders")
    labels = lambda t: {p[2] for p in scan(t)[2]}
    assert labels("MIT License\n\nCopyright (c) 2020-2024 The Some Long Name Authors and Contributors. All rights reserved.\n\n" + mit.upper()) == {"mit", "mit-text", "warranty-disclaimer", "copyright-line"}
    assert labels(mit.replace("shall be included in all copies", "may be left out")) == {"mit-text", "warranty-disclaimer"}
    assert labels("SPDX-License-Identifier: Apache-2.0") == {"spdx-line"}


# 2
def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])) + body


def test_secrets():
    oid = der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(5, b""))
    pkcs8 = der(0x30, der(2, b"\0") + oid + der(4, bytes(range(40))))
    b64 = base64.b64encode(pkcs8).decode()
    enc = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    jwt = f"{enc({'alg': 'HS256'})}.{enc({'sub': 1})}.c2ln"
    ssh = base64.b64encode(struct.pack(">I", 11) + b"ssh-ed25519" + struct.pack(">I", 32) + bytes(32)).decode()
    text = f"é 😀 x {b64} y {jwt} z ssh-ed25519 {ssh} token: secret = abcdefgh12 PASSWORD='hunter2hunter' AKIA{'A' * 12} AKIA{'B' * 11} {'0f' * 16} {'f' * 31}\n-----BEGIN PRIVATE KEY-----\n{b64}\n-----END PRIVATE KEY-----"
    spans = secrets.find_secrets(text)
    assert Counter(k for _, _, k in spans) == {"assign": 1, "access": 1, "hex": 1, "der": 1, "jwt": 1, "ssh": 1, "pem": 1}
    assert [text[a:b] for a, b, k in spans if k == "assign"] == ["PASSWORD='hunter2hunter"]
    assert not secrets.confirmed_spans(base64.b64encode(pkcs8[:-1]).decode()) and not secrets.confirmed_spans(f"eyJhbGciOiJ9.{enc({})}.x")
    assert "hunter" not in secrets.mask(text) and secrets.mask(None) is None


def test_keys_inside_runs():
    """Keys behind an equals sign, inside longer runs, in hex with a prefix and in PEM with escaped line ends."""
    oid = der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + der(5, b""))
    ssh = base64.b64encode(struct.pack(">I", 11) + b"ssh-ed25519" + struct.pack(">I", 32) + bytes(32)).decode()
    for n in (40, 41, 42, 300):
        pkcs8 = der(0x30, der(2, b"\0") + oid + der(4, bytes(random.Random(n).randbytes(n))))
        b64, url = base64.b64encode(pkcs8).decode(), base64.urlsafe_b64encode(pkcs8).decode()
        for key in (b64, b64.rstrip("="), url):
            for lead in ("", "signing_key=", "x-", "/etc/", "\\n", "_", "abcde", "MIIE", "A"):
                assert secrets.confirmed_spans(f"é {lead}{key} end") == [(2 + len(lead), 2 + len(lead) + len(key), "der")], (n, lead)
        assert secrets.confirmed_spans(f"a/{b64.rstrip('=')}-tail/of/a/path") == [(2, 2 + len(b64.rstrip("=")), "der")]
        assert [k for *_, k in secrets.confirmed_spans(f"K={b64.rstrip('=')}/{ssh.rstrip('=')}")] == ["der", "ssh"]
        for lead in ("0x", "k", "f", "ff", "h="):
            assert secrets.confirmed_spans(lead + pkcs8.hex()) == [(len(lead), len(lead) + 2 * len(pkcs8), "der")], lead
        assert not secrets.confirmed_spans("x-" + base64.b64encode(pkcs8[:-1]).decode())
        lines = "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64))
        pem = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----\n"
        for text in (json.dumps({"private_key": pem}), json.dumps(json.dumps({"k": pem})), json.dumps({"k": pem}).replace("/", "\\/").replace("+", "\\u002b"), json.dumps({"k": pem.replace("\n", "\r\n")}), pem):
            assert [k for *_, k in secrets.confirmed_spans(text)] == ["pem"] and b64[:60] not in secrets.mask(text)


def test_key_encodings():
    """Encrypted PKCS#8, DSA, PEM with header lines, and private SSH files whose fields fill them."""
    rnd = random.Random(13)
    pem = lambda label, data, head="": f"-----BEGIN {label}-----\n{head}{base64.encodebytes(data).decode()}-----END {label}-----"
    kinds = lambda t: [k for *_, k in secrets.confirmed_spans(t)]
    field = lambda b: struct.pack(">I", len(b)) + b
    pbes2 = der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d") + der(0x30, der(4, bytes(8))))
    sealed = der(0x30, pbes2 + der(4, rnd.randbytes(128)))
    dsa = der(0x30, der(2, b"\0") + b"".join(der(2, b"\x01" + rnd.randbytes(k)) for k in (128, 20, 128, 128, 20)))
    for label, data in (("ENCRYPTED PRIVATE KEY", sealed), ("DSA PRIVATE KEY", dsa)):
        b64 = base64.b64encode(data).decode()
        assert kinds(pem(label, data)) == ["pem"] and kinds(f"k={b64}") == ["der"] and kinds(json.dumps(pem(label, data))) == ["pem"]
        assert not kinds(pem(label, data[:-1])) and not kinds(base64.b64encode(data[:-1]).decode())
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    for text in (pem("RSA PRIVATE KEY", rnd.randbytes(320), head), pem("DSA PRIVATE KEY", dsa, "Comment: mine\n\n")):
        assert kinds(text) == ["pem"] and kinds(json.dumps({"k": text})) == ["pem"] and secrets.mask(f"a {text} b") == "a [pem] b"
    assert not kinds(pem("RSA PRIVATE KEY", rnd.randbytes(321), head))
    public = field(b"ssh-ed25519") + field(rnd.randbytes(32))
    for cipher, tag in ((b"none", 0), (b"aes256-gcm@openssh.com", 16)):
        key = b"openssh-key-v1\0" + field(cipher) + field(b"none") + field(b"") + struct.pack(">I", 1) + field(public) + field(rnd.randbytes(144)) + bytes(tag)
        b64 = base64.b64encode(key).decode().rstrip("=")
        assert kinds(pem("OPENSSH PRIVATE KEY", key)) == ["pem"] and kinds(f"x={b64}") == kinds(key.hex()) == ["ssh"]
        assert not kinds(pem("OPENSSH PRIVATE KEY", key[:-1])) and not kinds(pem("OPENSSH PRIVATE KEY", key + b"\0"))
    assert not kinds(base64.b64encode(b"openssh-key-v1\0" + bytes(80)).decode())


def brute_secrets(text):
    """Base spans by looking at one character after another."""
    letters, found = "abcdefghijklmnopqrstuvwxyz", []
    low = "".join(c.lower() if c.lower() in letters and c.isascii() else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + letters + "0123456789+/_.=-")

    def run(i, allowed):
        while i < len(text) and text[i] in allowed:
            i += 1
        return i

    def assign(i):
        name = next((n for n in ("password", "passwd", "secret", "token", "apikey", "api_key") if low.startswith(n, i)), None)
        if not name:
            return None
        j = i + len(name)
        j += j < len(text) and text[j] in "\"'"
        j = run(j, " ")
        if j >= len(text) or text[j] not in ":=":
            return None
        j = run(j + 1, " ")
        k = j + (j < len(text) and text[j] in "\"'")
        end = run(k, value)
        return (end, end - k >= 8) if end > k else None

    def access(i):
        end = run(i + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) if text.startswith("AKIA", i) else 0
        return (end, end - i >= 16) if end > i + 4 else None

    def hexes(i):
        end = run(i, set("0123456789abcdef"))
        return (end, end - i >= 32) if end > i else None

    for kind, match in (("assign", assign), ("access", access), ("hex", hexes)):
        i = 0
        while i < len(text):
            got = match(i)
            if got and got[1]:
                found.append((i, got[0], kind))
            i = got[0] if got else i + 1
    return found


def test_base_secrets_against_brute_force():
    rnd = random.Random(14)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIkey", "tokentoken", '"', "'", " ", "  ", ":", "=", "==", "abc", "AbC/12+-_.", "x" * 9, "AKIA", "A1B2C3D4E5F6", "0123456789abcdef", "é", "ſ", "K", "\n", "\t", "f" * 31, "-", "İ"]
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert sorted(secrets.base_spans(t)) == sorted(brute_secrets(t)), t


def test_deeply_nested_tokens_and_hostile_texts():
    import time

    enc = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    head = enc(b'{"alg":"x"}')
    assert [k for *_, k in secrets.find_secrets(f"{head}.{enc(b'{"a":' * 100_000)}.x")] == ["jwt"]
    assert not secrets.find_secrets(f"{head}.{enc(b'[' * 100_000)}.x") and not secrets.find_secrets(f"{enc(b'{"a":' * 100_000)}.{head}.x")
    began = time.time()
    for unit in ("A", "MI", "MIIE", "30", "eyJ", "token=abcdefghij ", "-----BEGIN PRIVATE KEY-----\n"):
        secrets.find_secrets(unit * (400_000 // len(unit)))
    assert time.time() - began < 30


def test_secret_scan_and_mask(spark):
    df = docs(spark, [(1, 'token = "0123456789abcdef0123456789abcdef"'), (2, None)])
    spans = "assign:0:41,hex:9:41"
    assert got(secrets.scan_secrets(df)) == [(1, 1, 0, 1, hashlib.sha256(spans.encode()).hexdigest(), spans), (2, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")]
    assert got(secrets.masked(df), "doc_id", "text", "score") == [(1, '[assign]"', 0.5), (2, None, 0.5)]


# 3
def test_media(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", bytes(13)), (b"IEND", b"")))
    gz = zlib.compressobj(9, zlib.DEFLATED, 31)
    gz = gz.compress(b"hello") + gz.flush()
    sniff = media.Sniffer()
    blob = b"junk" + png + b"BM..RIFF...." + gz + png[:-1]
    assert sniff(blob) == [(4, len(png), "image/png"), (4 + len(png) + 12, len(gz), "application/gzip")]
    payload = bytes(range(256)) * 3
    assert media.from_wav(media.to_wav(payload)) == payload and sniff(media.to_wav(payload))[0] == (0, 44 + 768, "audio/wav")
    df = spark.createDataFrame([(png, "image/jpeg", 1), (None, "x/y", 2), (b"", None, 3)], "media binary, declared_type string, carved int")
    assert [(r["detected_type"], r["corrected_type"], r["carved"]) for r in media.sniffed(df).collect()] == [("image/png", "image/png", []), (None, "x/y", []), (None, None, [])]
    row = media.media_features(docs(spark, [(1, "é")])).first()
    data = "é".encode() + bytes(62)
    assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (2, 64, hashlib.sha256(data).hexdigest(), zlib.crc32(data))


def test_media_items_end_at_their_last_trailer(spark):
    """Saved-again and linearised PDFs, an archive in an archive, and op3's feature from the sniffed rows."""
    import io
    import zipfile

    def pdf(first):
        body = b"%PDF-1.4\n" + (b"startxref\n0\n%%EOF\n" if first else b"")
        for _ in range(2):
            body += b"1 0 obj\nendobj\n"
            body += b"xref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % len(body) + b"\n"
        return body[:-1]

    def archive(name, data):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, data)
        return out.getvalue()

    sniff, inner = media.Sniffer(), archive("a", b"text")
    outer = archive("b.zip", inner)
    early = b"%PDF-1.4\n%%EOF\n" + b"1 0 obj\nstartxref\n9\n%%EOF"
    items = [(pdf(False), "application/pdf"), (pdf(True), "application/pdf"), (outer, "application/zip"), (early, "application/pdf")]
    for data, kind in items:
        assert sniff(b"junk" + data + b"tail") == [(4, len(data), kind)]
        assert sniff(b"junk" + data + b" " + data) == [(4, len(data), kind), (5 + len(data), len(data), kind)]
    text = "x" + pdf(True).decode()
    row = media.media_features(docs(spark, [(1, text)])).first()
    stored = media.sniffed(media.store_texts(docs(spark, [(1, text)])).withColumn("declared_type", F.lit("x/y"))).first()
    assert stored["corrected_type"] == "audio/wav" and stored["detected_bytes"] == row["media_bytes"] == len(stored["media"])
    assert row["feature"] == f"audio/wav:{row['media_bytes']}:application/pdf@45+{len(pdf(True))}"


def ogg_page(flags, sequence, data):
    head = b"OggS\0" + bytes([flags]) + bytes(8) + struct.pack("<II", 7, sequence)
    tail = bytes([len(data)])
    body = head + bytes(4) + b"\x01" + tail + data
    crc = 0
    for x in body:  # the checksum bit by bit
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return head + struct.pack("<I", crc) + b"\x01" + tail + data


def test_more_media_formats():
    sniff = media.Sniffer()
    box = lambda kind, data: struct.pack(">I", 8 + len(data)) + kind + data
    mp4 = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", bytes(20)) + box(b"mdat", b"II*\0" + bytes(40))
    audio = ogg_page(2, 0, b"one") + ogg_page(4, 1, b"second page")
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    mp3 = b"ID3\x04\0\0\0\0\0\x05hello" + frame * 4
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 273, 4, 1, 38) + struct.pack("<HHII", 279, 4, 1, 10) + bytes(4) + b"0123456789"
    doc = b"\x42\x82\x84webm"
    webm = b"\x1a\x45\xdf\xa3" + bytes([0x80 | len(doc)]) + doc + b"\x18\x53\x80\x67\x85hello"
    flac = b"fLaC" + b"\x80\0\0\x22" + bytes(34) + b"\xff\xf8rest"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x04ab\xff\xda\0\x04abscan\xff\0\xff\xd9"
    gif = b"GIF89a" + bytes(7) + b"!\xfe\x02hi\0" + b"," + bytes(9) + b"\x02\x01x\0;"
    for data, kind in ((mp4, "video/mp4"), (audio, "application/ogg"), (mp3, "audio/mpeg"), (tiff, "image/tiff"), (webm, "video/webm"), (jpeg, "image/jpeg"), (gif, "image/gif")):
        assert sniff(data)[0] == (0, len(data), kind), kind
        assert sniff(b"text " + data + b" text" + data) == [(5, len(data), kind), (10 + len(data), len(data), kind)], kind
        cut = [n for _, n, k in sniff(b"text " + data[:-1]) if k == kind]
        assert cut == ([len(ogg_page(2, 0, b"one"))] if kind == "application/ogg" else [len(data) - len(frame)] if kind == "audio/mpeg" else []), kind
    assert sniff(b"x" + flac) == [(1, len(flac), "audio/flac")] and sniff(audio[:-1] + b"!") == [(0, len(ogg_page(2, 0, b"one")), "application/ogg")]


def test_media_of_hostile_bytes():
    """Repeated signatures, none of them an item, take time in proportion."""
    import time

    sniff, began = media.Sniffer(), time.time()
    for unit in (b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj\nstartxref\n9\n", b"PK\x03\x04PK\x05\x06" + bytes(18), b"\x1f\x8b\x08", b"\xff\xd8\xff\xc0\0\x04\0\0\xff\xda\0\x02", b"GIF89a" + bytes(7) + b"!\xfe\x40", b"RIFF\0\0\x10\0WAVE", b"\0\0\0\x0cftypfree"):
        sniff(unit * (2_000_000 // len(unit)))
    assert time.time() - began < 40


# 4
def test_warc(spark):
    pages = [(5, "http://a/ b\n", "same"), (2, None, "same"), (9, "u", "other"), (7, "v", None), (8, "w", ""), (None, "n", "same"), (9, "u", "other"), (3, "é", "same" * 3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    rows = [tuple(r) for r in warc.archived(df, file_limit=300).collect()]
    least = {}
    for i, _, h in pages:
        h = h or ""
        least[h] = min([x for x in (least.get(h), i) if x is not None], default=None)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        first = least[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert warc.archived(df.limit(0)).count() == 0


def test_warc_files_are_the_same_bytes_again(spark, tmp_path):
    """Other layouts give equal files, also where a third of the rows are alike, have one id, or have none."""
    rows = [(i, f"u{i}", "x" * (i % 700)) for i in range(1500)] + [(77, "hot", "the same page")] * 900 + [(78, f"u{i}", f"{i}") for i in range(900)] + [(None, f"n{i % 50}", None) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    tables = [got(warc.write_warc(df.repartition(k), f"file://{tmp_path}/{k}", file_limit=20_000, shard_bytes=100_000), "file", "records", "bytes", "sha256", "first_page", "last_page") for k in (1, 7)]
    assert tables[0] == tables[1] and sum(r[1] for r in tables[0]) == len(rows)
    records = Counter(int(r[0].split("-")[1]) for r in tables[0])
    assert len(records) > 15 and max(r[1] for r in tables[0]) <= 250
    back = warc.read_warc(spark, spark.read.parquet(f"file://{tmp_path}/1/manifest"), f"file://{tmp_path}/1")
    least, want = {}, Counter()
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    for i, _, h in rows:
        first = least.get(h or "")
        want[i, len(h or ""), "revisit" if first is not None and first != i else "response", first if first != i else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in back.collect()) == want
    (tmp_path / "1" / ".left.tmp").write_bytes(b"x")
    assert warc.remove_unfinished(f"file://{tmp_path}/1") == 1


# 5
def test_token_counts():
    import sentencepiece

    path = queries.vocabulary(queries.PIECES)
    sp, count = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.PieceCounter(path, most_cached=50)
    random.seed(2)
    texts = ["", " ", "  a  b ", "<s> </s> <unk> <0x0A>", "\x00a▁b", "日本語 😀 ñ\r\n\t", "a" * 5000, "ab" * 900 + " " * 40, None]
    texts += ["".join(random.choice("abcdeé日 \n.,1") for _ in range(random.randint(0, 200))) for _ in range(200)]
    assert [count(t) for t in texts] == [len(sp.encode(t or "")) for t in texts]


# 10
def test_bpe_equals_the_library():
    import tokenizers

    path = queries.vocabulary(queries.WORDS)
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.WordBPE(path, most_cached=50)
    random.seed(4)
    texts = ["", " ", "Don't 'LL we've", "ΣΑΣ İ ﬁ é́ ß ẞ ②³ \x1c\x85  x", "<|endoftext|>a<|startoftext|> <|END", "日本語😀", "a" * 3000, "abcd" * 40, None]
    texts += ["".join(random.choice("abcdeéÉ日' $1\n") for _ in range(random.randint(0, 200))) for _ in range(200)]
    own.prepare(texts[::2])
    for t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False), t
        assert own.digest(t)[1] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert own.digest(t)[2] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_library_on_every_code_point():
    """Alone, doubled, between letters and beside digits, on the planes that have letters."""
    import tokenizers

    path = queries.vocabulary(queries.WORDS)
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.WordBPE(path)
    points = [c for c in [*range(0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)] if not 0xD800 <= c < 0xE000]
    texts = []
    for k in range(0, len(points), 4):
        texts.append(" z ".join(f"{c} {c}{c} a{c}b {c}1{c}é{c}" for c in map(chr, points[k : k + 4])))
    for k in range(0, len(texts), 2000):
        part = texts[k : k + 2000]
        own.prepare(part)
        for t, found in zip(part, lib.encode_batch(part, add_special_tokens=False), strict=True):
            assert own.encode(t) == found.ids, t


def test_added_tokens_are_found_by_their_texts():
    own = bpe.WordBPE(queries.vocabulary(queries.WORDS))
    own.added = {"[[X]]": 49406, "[[X]]Y": 49407}
    import re

    own.special = re.compile(r"(\[\[X\]\]Y|\[\[X\]\])").split
    assert [i for i in own.encode("a [[X]]Y b[[X]]c") if i >= 49406] == [49407, 49406]


def test_caches_are_bounded_by_characters():
    made = []
    memo = common.Memo(lambda k: made.append(k) or len(k), most=1000, most_chars=100, longest=40)
    assert memo["x" * 41] == 41 and not memo and [memo["y" * 30 + str(i)] for i in range(9)] == [31] * 9 and len(memo) + len(memo.old) <= 8


# 6
def test_language_id(spark):
    random.seed(6)
    words = {"en": ["the", "thing", "with", "and", "that"], "fr": ["les", "étrange", "que", "mentir", "aux"], "de": ["der", "über", "schön", "nicht", "zeit"]}
    items = [(i, " ".join(random.choices(words[k], k=12)), None if i % 17 == 0 else k, None) for i in range(450) for k in [["en", "fr", "de"][i % 3]]]
    df = docs(spark, [*items, (1000, "12 !?", "en", None), (1001, None, "fr", None)])
    rows = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert rows[1000]["lang_pred"] == rows[1001]["lang_pred"] == "und"
    held = [i for i in items if zlib.crc32(str(i[0]).encode()) % 5 == 0]
    assert all(rows[i[0]]["held_out"] == (zlib.crc32(str(i[0]).encode()) % 5 == 0) and 0 <= rows[i[0]]["score"] <= 1 for i in items)
    assert sum(rows[i[0]]["lang_pred"] == ["en", "fr", "de"][i[0] % 3] for i in held) >= 0.97 * len(held)
    assert all(r["lang_pred"] == "und" for r in langid.identify(docs(spark, [(1, "abc")])).collect())


def test_language_id_leaves_no_language_out(spark):
    """As many labels as the bound are all learned; with one more the fit is refused."""
    items = [(i, chr(0x4E00 + i) * 3, f"l{i:03}", None) for i in range(1, 400) if zlib.crc32(str(i).encode()) % 5]
    most = langid.MOST_LABELS
    assert len(langid.train(docs(spark, items[:most])).labels) == most
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs(spark, items[: most + 1]))


def test_language_id_samples_rows_that_share_an_id(spark):
    """Rows without an id, or with one id, are picked one by one; rows alike don't crowd out the others."""
    random.seed(16)
    words = {"en": ["the", "thing", "with", "and"], "fr": ["les", "étrange", "que", "aux"]}
    items = [(None if i % 2 else 1, " ".join(random.choices(words[k], k=9)) + f" {i}", k) for i in range(600) for k in [("en", "fr")[i % 3 > 0]]] + [(3, "the thing with", "en")] * 4000
    df = docs(spark, items)
    rows = langid.training_rows(df, "doc_id", "text", "lang")
    langs, at, n = langid.sampled(rows, [("en", 4200), ("fr", 400)], 200)
    assert 60 <= langs.count("fr") <= 160 and langs.count("en") <= 60 and len({tuple(a) for a in at}) > 20
    model = langid.train(df)
    assert model.predict("the thing with and that")[0] == "en" and model.predict("les étrange que")[0] == "fr"


# 7
def test_quality_counts(spark):
    random.seed(7)
    items = [(i, "".join(random.choice(["a", "b", "c ", " ", "\n", " ", "$", "é "]) for _ in range(random.randint(0, 120)))) for i in range(150)]
    rows = {r["doc_id"]: r for r in quality.quality(docs(spark, items)).collect()}
    for i, t in items:
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), t.count("$"), len(lines) - len(set(lines)), len(twice))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(twice) > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_keeps_prose_and_drops_symbols(spark):
    random.seed(8)
    prose = [(i, " ".join("w" * random.randint(2, 8) + str(random.random())[:4] for _ in range(60)), "en", "s") for i in range(60)]
    junk = [(100 + i, " ".join(f"{random.random()}$$$###" for _ in range(60)), "en", "s") for i in range(5)]
    kept = {r["doc_id"] for r in quality.quality(docs(spark, prose + junk)).filter("kept").collect()}
    assert kept == {p[0] for p in prose}


def test_quality_fences_follow_the_group(spark):
    """Repeated lines and windows below what the base rule leaves are rejected by a group's own fence, and not where they are usual."""
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))

    def text(lines, again, window):
        out = [" ".join(word() for _ in range(8)) for _ in range(lines)]
        out += out[:again]
        if window:
            five = " ".join(word() for _ in range(5))
            out += [five + " " + word(), word() + " " + five]
        return "\n".join(out)

    items = [(i, text(20, 0, False), "en", "plain") for i in range(60)] + [(100 + i, text(20, 1, True), "en", "repeating") for i in range(60)]
    odd = {500: text(16, 0, False).replace("\n", "\nmenu\n", 5), 501: text(9, 0, True)}
    items += [(k, t, "en", "plain") for k, t in odd.items()] + [(600, odd[501], "en", "repeating")]
    rows = {r["doc_id"]: r for r in quality.quality(docs(spark, items)).collect()}
    assert not any(rows[k]["base_failed"] for k in (500, 501, 600))
    assert not rows[500]["kept"] and not rows[501]["kept"] and rows[600]["kept"] and all(rows[i]["kept"] for i, *_ in items[:120])


# 8
def brute_components(items):
    import xxhash

    def fp(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    return {i: fp(t) for i, t in items}


def linked(fps):
    ids = list(fps)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and root[b] > root[a]:
                    root[b], changed = root[a], True
    return root


def test_simhash_texts(spark):
    items = [(7, "one two three four five"), (3, "One  TWO three\nfour five"), (9, None), (4, ""), (11, "one two"), (12, "É two three"), (20, "one two three four six " * 50)]
    fps = brute_components(items)
    root = linked(fps)
    assert got(simhash.simhash_classes(docs(spark, items))) == sorted([(i, f"{fps[i]:016x}", root[i]) for i, _ in items], key=str)


def test_simhash_links_on_crowded_fingerprints(spark):
    """Chains, small buckets and one crowd of fingerprints that differ in few bits."""
    random.seed(9)
    base = [random.getrandbits(64) for _ in range(6)]
    fps = [b ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for b in base for _ in range(8)]
    crowd = random.getrandbits(64)
    for _ in range(150):
        x = crowd
        for _ in range(random.randint(0, 5)):
            x ^= 1 << random.randrange(40, 64)
        fps.append(x)
    chain = random.getrandbits(64)
    for k in range(0, 30, 2):
        chain ^= 3 << k
        fps.append(chain)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    marks = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    rows = {r["doc_id"]: r["component_id"] for r in simhash.with_components(marks).collect()}
    assert rows == linked(dict(enumerate(fps)))


def test_simhash_hot_groups(spark):
    """A group of copies with a third of the rows, and a component with a third of the fingerprints."""
    random.seed(12)
    hot = random.getrandbits(62)
    fps = [hot] * 700 + [hot ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)] + [random.getrandbits(63) for _ in range(900)]
    marks = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")
    rows = {r["doc_id"]: r["component_id"] for r in simhash.with_components(marks).collect()}
    assert len(rows) == len(fps) and rows == {i: 0 if i < 700 + 435 else i for i in range(len(fps))}


def test_simhash_chains_end_in_few_rounds(spark, monkeypatch):
    """Chains whose labels run by chance or rise from the middle, beside a star with a third of the links."""
    rnd, rounds = random.Random(17), []
    monkeypatch.setattr(simhash, "written", lambda df, name: rounds.append(name) or common.written(df, name))
    n = 1500
    mixed = rnd.sample(range(n), n)
    valley = [10_000 + abs(i - n // 2) * 2 + (i < n // 2) for i in range(n)]
    star = [(30_000, 30_000 + i) for i in range(1, n)]
    edges = spark.createDataFrame([(x[i], x[i + 1]) for x in (mixed, valley) for i in range(n - 1)] + star, "a long, b long")
    roots = {r["fp"]: r["root"] for r in simhash.components(edges).collect()}
    assert len(roots) == 3 * n and rounds.count("simhash-moves") <= 20
    assert all(len({r for fp, r in roots.items() if fp // 10_000 == k}) == 1 for k in (0, 1, 3)) and len(set(roots.values())) == 3
    assert simhash.components(edges.limit(0)).count() == 0


def test_joins_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(shared, "SMALL_ROWS", 10)
    big = spark.range(5000).selectExpr("if(id % 3 = 0, 7L, id) k", "id")
    small = spark.range(6000).selectExpr("id k", "id * 2 v")
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    rows = common.join_hot(big, small, "k", counts).collect()
    assert len(rows) == 5000 and all(r["v"] == 2 * r["k"] for r in rows)
    sums = common.running_sums(big, [F.col("k"), F.col("id")], {"before": F.col("id")}, "sums").orderBy("k", "id").collect()
    total = 0
    for r in sums:
        assert r["before"] == total
        total += r["id"]
    bounds = [f"{i:03d}" for i in range(0, 100, 7)]
    found = spark.range(120).select("id", common.searched(bounds, F.lpad(F.col("id").cast("string"), 3, "0")).alias("at")).collect()
    assert all(r["at"] == sum(int(b) <= r["id"] for b in bounds) for r in found)


def test_shared_folder_of_a_cluster_must_be_named(spark):
    class Conf(dict):
        pass

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Context.master = "local[2]"
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert common.shared_dir(Session()) == "hdfs://x/y"
    Session._jvm, Session._jsc = spark._jvm, spark._jsc
    Session.conf["spark.checkpoint.dir"] = "/tmp/shared"
    assert warc.file_system(common.shared_dir(Session()))[1] == "/tmp/shared" and common.shared_dir(Session()).startswith("file:/")


def test_one_of_each(spark):
    items = [(5, "same text here"), (2, "same text here"), (2, "same text here"), (8, "another one entirely"), (None, "same text here"), (None, "lonely text"), (None, "lonely text")]
    assert got(simhash.one_of_each(docs(spark, items)), "doc_id", "text", "fp") == sorted([(2, "same text here", "x"), (8, "another one entirely", "x"), (None, "lonely text", "x")], key=str)


def test_one_of_each_component_of_a_repeated_id(spark):
    """An id may name two components, or one and stand in another."""
    a, b, c, d = ("alpha beta gamma delta", "one two three four five", "red green blue white", "north south east west up")
    items = [(5, a), (5, b), (5, b), (9, a), (7, b), (3, c), (6, c), (6, d), (8, d)]
    assert got(simhash.one_of_each(docs(spark, items)), "doc_id", "text") == sorted([(5, a), (5, b), (3, c), (6, d)], key=str)


# 9
def shares(sizes, weights=(5, 2, 1)):
    """Targets by resharing round by round."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = total / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            total -= out[s]
        open_ -= over
    return out


def test_mixing(spark):
    random.seed(10)
    items = [(i, "w " * random.choice([0, 1, 5, 40, 200]), None, random.choice(["b", "a", None, "é", "c", "z"])) for i in range(700)]
    items += [(900, "same words here", None, "a")] * 300 + [(901, None, None, "empty"), (None, "no id", None, "b")]
    df = docs(spark, items)
    rows = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, _, s in items:
        sizes[s] += len((t or "").split())
    want = shares(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(rows) == len(items) and all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)
    again = mixing.mix(df.repartition(7))
    assert got(again, "doc_id", "size", "taken") == sorted([(r["doc_id"], r["size"], r["taken"]) for r in rows], key=str)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in rows)


def test_mixing_repeated_rows(spark):
    """A third of the rows repeat one row, others share id, source and size but not the text; a map column is no obstacle."""
    items = [(1, "one two three")] * 2500 + [(2, f"x y {i}") for i in range(300)] + [(1000 + i, "a b c d") for i in range(900)]
    df = spark.createDataFrame([(*i, {"k": 1}) for i in items], "doc_id long, text string, extra map<string,int>").withColumn("source", F.when(F.col("doc_id") == 2, "s").otherwise("t"))
    rows = mixing.mix(df).collect()
    want, out = Counter(), mixing.mixed(df)
    for r in rows:
        want[r["doc_id"]] += r["copies"]
    assert out.columns == df.columns and len(rows) == len(items)
    got_rows = out.groupBy("doc_id", "text").count().collect()
    have = Counter()
    for r in got_rows:
        have[r["doc_id"]] += r["count"]
    assert have == +want
    each = {r["text"]: r["count"] for r in got_rows if r["doc_id"] == 2}
    assert len(each) == 300 and max(each.values()) - min(each.values()) <= 1
    assert got(mixing.mixed(df.repartition(5)).select("doc_id", "text")) == got(out.select("doc_id", "text"))


def test_rounding_goes_up_a_tree(spark):
    pool = spark.range(9000).selectExpr("'s' source", "id doc_id", "id % 50 + 1 size", "1L rows", "0L extra", "0.37D x", "9000L units")
    rows = mixing.round_units(pool, 9000).collect()
    assert len(rows) == 9000 and {r["x"] for r in rows} == {0.0, 1.0}
    assert abs(sum(r["size"] * (r["x"] - 0.37) for r in rows)) <= 51


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    random.seed(11)
    texts = [" ".join(random.choice(["the", "thing", "with", "and", "that", "over", "under"]) + random.choice(["", "s", "ly"]) for _ in range(30)) for _ in range(40)]
    items = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)] + [(100 + i, texts[i], "en", "a") for i in range(5)] + [(200, "12 34", "en", "a"), (201, None, None, None)]
    spark.createDataFrame([(*i, len(i[1] or "")) for i in items], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        df2 = stage(spark, df, str(tmp_path))
        assert df2.columns == df.columns
        df = df2
    assert {r["doc_id"] for r in df.collect()} == set(range(40))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(range(40))


def test_pipeline_without_labels_keeps_all(spark):
    import corpus_pipeline

    df = docs(spark, [(1, "some text"), (2, None), (None, "12")])
    assert got(corpus_pipeline.language_id(spark, df, ""), "doc_id", "text") == got(df, "doc_id", "text")


def test_pipeline_stages_on_edges(spark):
    """Nulls, empty and long texts, repeated rows, an empty table, and columns named like the stages' own."""
    import corpus_pipeline

    names = "doc_id long, text string, lang string, source string, n_chars int, __lang string, __score double, fp long, row string, unit string, copies int, lang_pred string, k int"
    rnd = random.Random(18)
    prose = lambda k: " ".join(rnd.choice({"en": ["the", "thing", "with", "and"], "fr": ["les", "que", "aux", "étrange"]}[k]) + rnd.choice(["", "s", "ly"]) for _ in range(25))
    items = [(i, prose(k), k, "ab"[i % 2]) for i in range(60) for k in [("en", "fr")[i % 2]]]
    items += [(200, None, "en", "a"), (201, "", None, None), (202, " \n", "en", "a"), (203, "12 34", None, "a"), (204, prose("en") * 300, "en", None), (None, prose("en"), None, "a")]
    items += [(205, "password = hunter2hunter2 " + prose("en"), None, "b")] * 3
    rest = (1, "own", 0.25, 5, "r", "u", 9, "p", 3)
    full = spark.createDataFrame([(*i, *rest) for i in items], names)
    stages = dict(corpus_pipeline.STAGES)
    for df in (full, full.limit(0), full.drop("n_chars")):
        kept = stages["language_id"](spark, df, "")
        ids = [r["doc_id"] for r in kept.collect()]
        once = stages["simhash_near_dedup"](spark, kept, "")
        clean = stages["secret_scan"](spark, once, "")
        mix = stages["mixing"](spark, clean, "")
        tokens = stages["bpe"](spark, mix, "")
        assert all(x.columns == df.columns for x in (kept, once, clean, mix))
        if df.isEmpty():
            assert not ids and tokens.count() == 0
            continue
        assert sorted(ids, key=str) == sorted([*range(60), 204, None, 205, 205, 205], key=str)
        left = clean.collect()
        assert sorted((r["doc_id"] for r in left), key=str) == sorted([*range(60), 204, None, 205], key=str)
        assert all(r["__lang"] == "own" and r["row"] == "r" and r["k"] == 3 for r in left)
        (hidden,) = [r for r in left if r["doc_id"] == 205]
        assert hidden["text"].startswith("[assign] ") and ("n_chars" not in df.columns or hidden["n_chars"] == len(hidden["text"]))
        taken = Counter(r["doc_id"] for r in mix.collect())
        assert taken.keys() <= {r["doc_id"] for r in left} and max(taken.values()) <= 2 and tokens.count() == sum(taken.values())
