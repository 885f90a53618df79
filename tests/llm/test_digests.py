"""Digests of archives that others have written, by algorithm and encoding."""

import base64
import hashlib

import pytest
import zstandard

from tidewick.llm import toxicity, warc

PAYLOAD, HEAD = b"<p>text</p>", b"HTTP/1.1 200 OK\r\n\r\n"


def record(payload_digest, block_digest="", kind="response"):
    block = HEAD + (PAYLOAD if kind == "response" else b"")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <x>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n"
    if payload_digest:
        head += f"WARC-Payload-Digest: {payload_digest}\r\n"
    if block_digest:
        head += f"WARC-Block-Digest: {block_digest}\r\n"
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def forms(body):
    for name in ("sha1", "sha256", "md5"):
        raw = hashlib.new(name, body).digest()
        b32 = base64.b32encode(raw).decode()
        yield from (f"{name}:{t}" for t in (raw.hex(), raw.hex().upper(), b32, b32.rstrip("="), b32.lower()))
        yield f"{name.upper().replace('SHA', 'SHA-')}:{raw.hex()}"
    yield base64.b32encode(hashlib.sha1(body).digest()).decode()


SHA1 = base64.b32encode(hashlib.sha1(PAYLOAD).digest()).decode()


@pytest.mark.parametrize("form", list(forms(PAYLOAD)))
def test_payload_digests(form):
    assert warc.parse(record(form), "a")["payload_digest"] == SHA1
    with pytest.raises(warc.BadArchive, match="payload doesn't match"):
        warc.parse(record(form).replace(b"text", b"tezt"), "a")


@pytest.mark.parametrize("form", list(forms(HEAD + PAYLOAD)))
def test_block_digests(form):
    assert warc.parse(record("", form), "a")["payload_digest"] == SHA1
    with pytest.raises(warc.BadArchive, match="block doesn't match"):
        warc.parse(record("", form).replace(b"text", b"tezt"), "a")


@pytest.mark.parametrize("form", ["blake3:00ff", "sha512:" + "0" * 128, "sha1:notadigest", "sha1:" + "1" * 32, "odd", "xxh:"])
def test_unknown_forms_are_passed_on(form):
    assert warc.parse(record(form, form), "a")["payload_digest"] == SHA1
    assert warc.parse(record(form, kind="revisit"), "a")["payload_digest"] == form


def test_revisits_state_their_digest():
    raw = hashlib.sha1(PAYLOAD).digest()
    for form in (f"sha1:{raw.hex()}", f"sha1:{SHA1}", SHA1):
        assert warc.parse(record(form, kind="revisit"), "a")["payload_digest"] == SHA1
    assert warc.parse(record("sha256:" + "0" * 64, kind="revisit"), "a")["payload_digest"] == "sha256:" + "0" * 64


def test_only_archives_of_the_manifest_are_read(spark, tmp_path):
    kept, stray = (tmp_path / n for n in ("kept.warc.zst", "stray.warc.zst"))
    kept.write_bytes(zstandard.compress(record(f"sha1:{SHA1}")))
    stray.write_bytes(b"what an attempt that was lost has left")
    manifest = spark.createDataFrame([(str(kept), 1, 2)], "archive string, records long, bytes long")
    assert [bytes(r.payload) for r in warc.read_written(manifest).collect()] == [PAYLOAD]
    with pytest.raises(Exception, match="no frame"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_scores_carry_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "some text", 2, "x")], "doc_id long, text string, `a.b` int, `c d` string")
    (row,) = toxicity.score(docs, toxicity.Model({}, [], 1.0, 0.0)).collect()
    assert row["a.b"] == 2 and row["c d"] == "x" and 0 <= row.score <= 1
    assert toxicity.score(docs, toxicity.Model({}, [], 1.0, 0.0)).columns[:4] == docs.columns
