"""Digests that a WARC file states reach its derivatives; packing's shards follow bytes as well as documents."""

import hashlib
import os

import pytest

from wordloom.llm import packing, queries, warc


def test_stated_digests_are_preserved(spark, tmp_path):
    payload = b"<html><title>caf\xe9</title>\xff\xfe<p>x</html>"  # not UTF-8: a decoded copy has another digest
    head = b"HTTP/1.1 200 OK\r\nX: y"

    def record(i: int, *fields: str) -> bytes:
        block = head + b"\r\n\r\n" + payload
        lines = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:{i}>", *fields, f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    (tmp_path / "a.warc").write_bytes(record(1, "WARC-Payload-Digest: sha1:ABC", "WARC-Block-Digest: sha1:DEF") + record(2) + record(3, "WARC-Payload-Digest:  "))
    source = warc.read_warc(spark, str(tmp_path / "a.warc"))
    own = "sha256:" + hashlib.sha256(payload).hexdigest()
    assert {r.record_id: (r.payload_digest, r.block_digest) for r in source.collect()} == {"<urn:1>": ("sha1:ABC", "sha1:DEF"), "<urn:2>": (own, None), "<urn:3>": (own, None)}
    got = {(r.refers_to, r.type): r for r in warc.derive(source).collect()}
    assert len(got) == 6 and got["<urn:1>", "conversion"].source_payload_digest == "sha1:ABC"
    assert "source-payload-digest: sha1:ABC\r\nsource-block-digest: sha1:DEF\r\n" in got["<urn:1>", "metadata"].block
    assert got["<urn:2>", "metadata"].source_payload_digest == own and "source-block-digest" not in got["<urn:2>", "metadata"].block
    one = got["<urn:1>", "conversion"]
    assert one.block_digest == "sha256:" + hashlib.sha256(one.block.encode()).hexdigest()


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no vocabulary files")
def test_shards_follow_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 400, "x") for i in range(40)] + [(None, None, "x"), (99, "", "x"), (1, "word " * 400, "x")], "doc_id long, text string, length string")
    monkeypatch.setattr(packing, "SHARD_BYTES", 8000)
    _, shards = packing.pieces(docs, queries.tokenizer_file(), 128)
    assert shards == -(-41 * 2000 // 8000)
    rows = packing.pack(docs, queries.tokenizer_file(), 128).collect()
    assert len({r.sequence_id >> 40 for r in rows}) > 5
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 128
    assert sum(r.length for r in rows) == sum({(r.doc_id, r.start): r.doc_tokens for r in rows if not r.start}.values()) + next(r.doc_tokens for r in rows if r.doc_id == 1)
    assert packing.pieces(docs.limit(0), queries.tokenizer_file(), 128)[1] == 1
