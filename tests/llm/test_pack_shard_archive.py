import base64
import hashlib
import random
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm.edge import empty, frame, got, rows
from tessera.llm import packing, sharding, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# ---- packing -----------------------------------------------------------------------------------
def check_packing(pieces, data, capacity):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in data:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), capacity):
            p = ids[s:s + capacity]
            want[i, s, len(p), zlib.crc32(p.tobytes()), len(ids)] += 1
    assert Counter(p[:5] for p in pieces) == want
    seqs = defaultdict(list)
    for p in pieces:
        seqs[p[5]].append((p[6], p[2]))
    assert sorted(seqs) == list(range(len(seqs)))
    for spans in seqs.values():
        at = 0
        for off, n in sorted(spans):
            assert off == at
            at += n
        assert at <= capacity
    return sum(p[2] for p in pieces), len(seqs)


COLS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_brute_force(spark, capacity):
    data = rows() + [(900 + k, "one two three four") for k in range(70)] + [(990, "<|endoftext|> it's İ ß Σας 12 don't x")]
    df = frame(spark, data=data).repartition(3)
    tokens, n = check_packing(got(packing.pack_documents(df, TOKENIZER, capacity=capacity), *COLS), data, capacity)
    assert n <= tokens / capacity * 1.02 + 1
    assert packing.pack_documents(empty(spark), TOKENIZER).count() == 0


def test_ranks_within_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 10)
    data = [(k, "a b c") for k in range(150)] + [(200 + k, "word " * k) for k in range(40)]
    check_packing(got(packing.pack_documents(frame(spark, data=data), TOKENIZER, capacity=32), *COLS), data, 32)


def test_sequences_hold_the_ids(spark):
    data = [(1, "a b c d"), (2, "e f"), (2, "e f"), (3, None), (4, "the " * 20)]
    df = frame(spark, data=data)
    placed = packing.pack_documents(df, TOKENIZER, capacity=16)
    seqs = got(packing.sequences(df, placed, TOKENIZER, capacity=16))
    assert all(len(ids) == 16 or len(ids) & (len(ids) - 1) == 0 for _, ids in seqs)
    crcs = {r["ids_crc32"] for r in placed.collect()}
    by = {s: ids for s, ids in seqs}
    for r in placed.collect():
        part = by[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["ids_crc32"] in crcs


def test_plan_places_every_copy_and_fills_best():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.randint(5, 60)
        counts = Counter(rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 120)))
        placed = Counter()
        for times, used in packing.plan(dict(counts), capacity):
            assert sum(k * n for k, n in used.items()) <= capacity
            for k, n in used.items():
                placed[k] += n * times
        assert placed == counts


def test_best_fill_is_the_largest_reachable_sum():
    rng = random.Random(2)
    for _ in range(200):
        room = rng.randint(1, 30)
        counts = {rng.randint(1, 12): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= room}
        used = packing.best_fill(sorted(counts, reverse=True), counts, room)
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


# ---- sharding ---------------------------------------------------------------------------------
def test_shards(spark):
    data = rows() + [(1000 + k, "t" * (k % 97)) for k in range(3000)] + [(None, "no id %d" % k) for k in range(500)]
    out = sharding.shard_by_bytes(frame(spark, data=data).repartition(4), shards=8)
    res = got(out, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert Counter(r[:3] for r in res) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    by = defaultdict(list)
    for r in res:
        by[r[4]].append(r)
    assert all(sorted(r[5] for r in g) == list(range(len(g))) for g in by.values())
    bytes_ = [sum(r[1] for r in by[s]) for s in range(8)]
    assert max(bytes_) - min(bytes_) <= max(r[1] for r in res)
    assert {r[3] for r in res} == {"bytes"} and {r[6] for r in res} == {None}
    assert sharding.shard_by_bytes(empty(spark)).count() == 0


def test_repeated_rows_spread_over_the_shards(spark):
    data = [(None, "same text")] * 1000 + [(7, "other")] * 800 + [(k, "text %d" % k) for k in range(10, 1210)]
    out = sharding.shard_by_bytes(frame(spark, data=data).repartition(3), shards=8)
    res = got(out, "doc_id", "size", "text_crc32", "shard", "slot")
    assert sorted((str(r[0]), r[1], r[2]) for r in res) == sorted((str(i), len(t) + 1, zlib.crc32(t.encode())) for i, t in data)
    for shard in range(8):
        mine = [r for r in res if r[3] == shard]
        assert sorted(r[4] for r in mine) == list(range(len(mine)))
        assert abs(sum(r[1] for r in mine) * 8 / sum(r[1] for r in res) - 1) < 0.03


def test_map_edits():
    rng = random.Random(3)
    loads = [(s, rng.randint(0, 1000)) for s in range(512)]
    first = sharding.balanced_map(loads, 8)
    grown = sharding.grow(first, loads, 8)
    moved = {s for s in first if grown[s] != first[s]}
    assert moved and all(grown[s] == 8 for s in moved)
    total = Counter()
    for s, n in loads:
        total[grown[s]] += n
    assert max(total.values()) - min(total.values()) <= 0.15 * sum(total.values()) / 9
    skewed = {s: 0 if s < 400 else s % 8 for s in range(512)}
    even = sharding.rebalance(skewed, loads, 8)
    total = Counter()
    for s, n in loads:
        total[even[s]] += n
    assert max(total.values()) - min(total.values()) <= 1000


def test_versions_of_the_map(spark):
    path = tempfile.mkdtemp() + "/map"
    sharding.store_map(spark, {0: 0, 1: 1}, path, 0)
    sharding.store_map(spark, {0: 2, 1: 1}, path, 1)
    assert got(sharding.read_map(spark, path)) == [(0, 2), (1, 1)] and got(sharding.read_map(spark, path, 0)) == [(0, 0), (1, 1)]


# ---- WARC ---------------------------------------------------------------------------------------
def pages(spark, data):
    from pyspark.sql import functions as F
    return frame(spark, "page_id", "html", data).withColumn("url", F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("http://x/é\n"), "page_id")))


@pytest.mark.parametrize("least", [0, 4])
def test_archive_round_trip(spark, least):
    data = rows() + [(300 + k, "<p>hot</p>") for k in range(40)]
    path = tempfile.mkdtemp() + "/warc"
    res = [tuple(r) for r in warc.archive_pages(pages(spark, data), path, min_bytes=least).collect()]
    low = {}
    for i, t in data:
        b = (t or "").encode()
        low.setdefault(b, []).append(i)
    want = Counter()
    for b, ids in low.items():
        real = [i for i in ids if i is not None]
        first, once = min(real) if real else None, False
        for i in ids:
            response = len(b) < least or (i == first and not once)
            once |= i == first
            want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else first] += 1
    assert Counter(res) == want
    store = spark.read.parquet(f"{path}/payloads")
    assert store.count() == len(low) and {bytes(r["payload"]) for r in store.collect()} == set(low)
    read = warc.read_archive(spark, path)
    assert read.where("not verified").count() == 0
    records = warc.record_bytes(read.where("record_type = 'response' and id is not null"))
    blocks = []
    for r in records.collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert block[size:] == b"\r\n\r\n"
        blocks.append(block[:size])
    assert set(blocks) == {b for b, ids in low.items() if any(i is not None for i in ids)}


def test_archive_of_nothing(spark):
    assert warc.archive_pages(pages(spark, []), tempfile.mkdtemp() + "/warc").count() == 0


def test_damaged_payload_is_noticed(spark):
    path = tempfile.mkdtemp() + "/warc"
    warc.write_archive(pages(spark, [(1, "one"), (2, "two")]), path)
    from pyspark.sql import functions as F
    bad = spark.createDataFrame([r for r in spark.read.parquet(f"{path}/payloads").collect()], "key binary, payload binary").withColumn(
        "payload", F.when(F.col("payload") == F.encode(F.lit("two"), "UTF-8"), F.encode(F.lit("tvo"), "UTF-8")).otherwise(F.col("payload")))
    bad.write.mode("overwrite").parquet(f"{path}/payloads")
    assert got(warc.read_archive(spark, path), "id", "verified") == [(1, True), (2, False)]
