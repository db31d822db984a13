"""The opN queries: against their SQL where there is one, else against brute force or by their purpose."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from tests.compare import differences
from wordtide.llm import queries as q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", list(q.oracle_sql()))
def test_sql(spark, name):
    assert differences(q.queries()[name](spark, SF), q.oracle_sql()[name], SF) == ""


def test_media_round_trip(spark):
    rows = {r["doc_id"]: r for r in q.op2_media(spark, SF).collect()}
    for doc_id, text in texts():
        body = text.encode()
        payload = body + b"\xff" * (max(1, -(-len(body) // 576)) * 576 - len(body))
        r = rows[doc_id]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(body), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])


def test_licence_base(spark):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    rows = {r["doc_id"]: r for r in q.op3_licenses(spark, SF).collect()}
    for doc_id, text in texts():
        words = WORD.findall(text.translate(LOWER))
        found = [(i, label, len(p.split())) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = rows[doc_id]
        assert (r["n_words"], r["n_base"]) == (len(words), len(found))
        assert r["base_labels"] == ",".join(sorted({x[1] for x in found}))
        assert r["first_word"] == min((x[0] for x in found), default=None)
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_quality_on_held_out(spark):
    rows = {r["doc_id"]: r for r in q.op6_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(rows[d]["predicted"], y) for d, y in labels if rows[d]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert np.mean([p == y for p, y in held]) > 0.9


def test_mixing_meets_targets(spark):
    rows = q.op7_mixing(spark, SF).collect()
    tokens, posterior, rate = np.array([r["n_tokens"] for r in rows]), np.array([r["posterior"] for r in rows]), np.array([r["rate"] for r in rows])
    assert (rate >= 0).all() and len(rows) == 200
    assert np.abs((tokens * rate) @ posterior / tokens.sum() - list(q.DOMAIN_WEIGHTS.values())).max() < 2e-3
    assert [r["copies"] for r in rows] == [int(c) for c in np.clip([r["copies"] for r in rows], np.floor(rate), np.floor(rate) + 1)]
