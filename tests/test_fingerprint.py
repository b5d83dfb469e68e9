"""Digests of large files against plain hashing."""

import hashlib

import numpy as np
import pytest

from plumbtrace.sources import files


@pytest.mark.parametrize("split", ["128m", "5000b"])
def test_large_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch, split):
    rng = np.random.default_rng(2)
    random = rng.integers(0, 256, 60_000).astype("uint8").tobytes()
    contents = {
        "random": random, "ends": random + b"\n", "mark": b"\xef\xbb\xbf" + random, "marked end": b"\xef\xbb\xbf" + random + b"\n",
        "returns": b"\r\n\r\n\n\r" * 900, "feeds": b"\n" * 3000, "one line": b"a" * 9000, "two ends": random + b"\n\n", "small": b"x\n",
        "zeros": bytes(7000), "latin": ("äö " * 3000).encode("latin1"), "packed.gz": random, "limit": random[:1000], "above": random[:1001]}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    whole = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path", "length", "sha2(content, 256) sha256").collect()
    monkeypatch.setattr(files, "WHOLE_FILE", 1000)
    monkeypatch.setattr(files, "PIECE", 700)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = files.input_fingerprint(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows) == sorted(whole) and "MapInArrow" in plan
    assert {r["path"].rsplit("/", 1)[1].replace("%20", " "): r["sha256"] for r in rows} == {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()}
