import base64
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import sharding, warc
from skyloom.llm.scratch import folder

BIG = "<p>" + "x" * 300_000 + "</p>"
PAGES = [(5, "http://a/1", "<b>one</b>"), (3, "http://a/2", "<b>one</b>"), (9, None, "<b>one</b>"), (1, "http://a/\r\nEvil: 1 é", ""), (2, "u", None), (7, "u", BIG), (8, "u", BIG), (None, "u", "<i>n</i>"), (None, "u", "<b>one</b>"), (4, "u", "é漢🙂"), (3, "http://a/2", "<b>one</b>")]


def test_archives_come_back(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, refers_to string").repartition(3)
    got = warc.read(spark, warc.write(pages, folder(spark, "t"))).collect()
    assert len(got) == len(PAGES) and all(r.intact for r in got)
    want = []
    for i, _, h in PAGES:
        same = [x for x, _, g in PAGES if (g or "") == (h or "") and x is not None]
        first = min(same, default=None)
        refers = None if i == first else first
        b = (h or "").encode()
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)


def test_small_payloads_can_stay_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.read(spark, warc.write(pages, folder(spark, "t"), least_bytes=1000)).collect()
    assert {r.page_id for r in rows if r.record_type == "revisit"} == {8}


def test_files_are_plain_zstandard_frames(spark):
    path = warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), folder(spark, "t"))
    blob = bytes(spark.read.format("binaryFile").load(path).filter("path like '%.warc.zst'").first().content)
    assert blob[:4] == bytes.fromhex("5d2a4d18")
    parts = list(warc.frames(blob))
    assert parts[0][2] and sum(not s for _, _, s in parts) == len(PAGES) + 1 and parts[-1][1] == len(blob)
    assert [f["warc-type"] for f, _ in warc.read_archive(blob)][0] == "warcinfo"


def test_ids_that_are_strings(spark):
    """Line breaks, percent signs and other alphabets in an id stay in its header field."""
    ids = ["a\r\nEvil: 1", "b %41", "é漢", "", "plain", "a\r\nEvil: 1", None]
    pages = spark.createDataFrame([(i, "u", f"<b>{k % 3}</b>") for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = warc.read(spark, warc.write(pages, folder(spark, "t")), "string").collect()
    assert sorted(map(repr, (r.page_id for r in got))) == sorted(map(repr, ids)) and all(r.intact for r in got)
    by = {r.page_id: r.refers_to for r in got if r.page_id not in (None, "a\r\nEvil: 1")}
    assert by == {"b %41": None, "é漢": "a\r\nEvil: 1", "": None, "plain": "b %41"}


def test_no_pages(spark):
    assert warc.read(spark, warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder(spark, "t"))).count() == 0


def brute_flow(supply, capacity, cost):
    from itertools import product

    best = None
    cells = [(i, j) for i in range(len(supply)) for j in range(len(capacity))]
    for x in product(range(max(supply) + 1), repeat=len(cells)):
        f = dict(zip(cells, x, strict=True))
        if all(sum(f[i, j] for j in range(len(capacity))) == s for i, s in enumerate(supply)) and all(sum(f[i, j] for i in range(len(supply))) <= c for j, c in enumerate(capacity)):
            total = sum(f[c] * cost[c] for c in cells)
            best = total if best is None else min(best, total)
    return best


def test_flow_is_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(12):
        supply, cost = rng.integers(0, 4, 2).tolist(), rng.integers(0, 4, (2, 3))
        if not sum(supply):
            continue
        capacity = rng.integers(1, 4, 3).tolist()
        if sum(capacity) < sum(supply):
            with pytest.raises(ValueError):
                sharding.min_cost_flow(supply, capacity, cost)
            continue
        f = sharding.min_cost_flow(supply, capacity, cost)
        assert f.sum(1).tolist() == supply and (f.sum(0) <= capacity).all()
        assert int((f * cost).sum()) == brute_flow(supply, capacity, cost)


def read(spark, layouts, schema, docs, shards):
    """Rows of a layout; no row is lost and the slots of each shard are gapless."""
    rows = sharding.slotted(spark, layouts, schema).collect()
    assert len(rows) == docs.count()
    for s in range(shards):
        assert sorted(r["_slot"] for r in rows if r["_shard"] == s) == list(range(sum(r["_shard"] == s for r in rows)))
    return rows


def sizes(rows, shards):
    out = [0] * shards
    for r in rows:
        out[r["_shard"]] += len((r.text or "").encode()) + 16
    return out


def test_reshard(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text"), F.lit(1).alias("_slot"), F.lit("m").alias("_metadata"))
    path, new = folder(spark, "s"), folder(spark, "s")
    schema = sharding.lay_out(docs, F.when(F.col("doc_id") < 2500, 0).otherwise(9), path)
    plan = sharding.reshard(spark, path, schema, new, 7)
    rows = read(spark, [(path, [o for o in (0, 9) if o not in plan.giving]), (new, None)], schema, docs, 7)
    assert plan.giving == [0, 9]  # 9 has no new shard of its number
    size = sizes(rows, 7)
    assert max(size) - min(size) < 200 and size == plan.bytes
    assert abs(plan.moved - plan.least) < 7 * 114  # a block a shard at most either way
    assert {(r.doc_id, r.text, r["_slot_in"], r["_metadata_in"]) for r in rows} == {(i, "é" * (i % 50), 1, "m") for i in range(3000)}


@pytest.mark.parametrize("shards", [1, 3])
def test_odd_rows(spark, odd, empty, shards):
    for docs in (odd, empty):
        path, new = folder(spark, "s"), folder(spark, "s")
        schema = sharding.lay_out(docs, F.lit(0), path)
        plan = sharding.reshard(spark, path, schema, new, shards)
        rows = read(spark, [(path, [o for o in (0,) if o not in plan.giving]), (new, None)] if plan.giving else [(path, None)], schema, docs, shards)
        key = lambda r: repr((r.doc_id, r.text, r.lang, r["_text"]))
        assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))


def test_repeated_ids_are_spread(spark):
    """Half of all rows share one id, a quarter has none: blocks are places in files, so shards stay equal."""
    docs = spark.range(4000).select(F.when(F.col("id") < 2000, 7).when(F.col("id") > 2999, F.col("id")).alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 60).cast("int")).alias("text"))
    path, new = folder(spark, "s"), folder(spark, "s")
    schema = sharding.lay_out(docs.repartition(3), F.lit(0), path)
    plan = sharding.reshard(spark, path, schema, new, 40)
    size = sizes(read(spark, [(path, []), (new, None)], schema, docs, 40), 40)
    assert plan.giving == [0] and max(size) - min(size) < 200


def test_only_affected_files_are_rewritten(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    path, new, same = folder(spark, "s"), folder(spark, "s"), folder(spark, "s")
    schema = sharding.lay_out(docs, F.expr("case when doc_id < 400 then 0 when doc_id < 900 then 1 when doc_id < 1500 then 2 else 3 end"), path)
    before = sorted(spark.read.parquet(path).inputFiles())
    plan = sharding.reshard(spark, path, schema, new, 4)
    assert plan.giving == [2] and plan.moved == plan.least == 100 * 25
    rows = read(spark, [(path, [0, 1, 3]), (new, None)], schema, docs, 4)
    assert sizes(rows, 4) == [500 * 25] * 4 and sorted(spark.read.parquet(path).inputFiles()) == before
    moved = {r.doc_id for r in rows if r["_shard"] == 0} - set(range(400))
    assert len(moved) == 100 and all(900 <= i < 1500 for i in moved)
    # shards that are equal already: nothing is written
    equal = folder(spark, "s")
    schema = sharding.lay_out(docs, F.expr("cast(doc_id % 4 as int)"), equal)
    plan = sharding.reshard(spark, equal, schema, same, 4)
    assert plan.giving == [] and plan.moved == 0
    assert len(read(spark, [(equal, None)], schema, docs, 4)) == 2000


def test_moved_bytes_are_the_fewest(spark):
    """Against all ways to deal single rows of equal size."""
    from itertools import product

    rng = np.random.default_rng(4)
    for _ in range(6):
        old = rng.integers(0, 5, 6).tolist()
        plan = sharding.Plan([(o, k, 10, 1) for k, o in enumerate(old)], 3)
        best = min(sum(10 * (o != n) for o, n in zip(old, to, strict=True)) for to in product(range(3), repeat=6) if all(to.count(k) == 2 for k in range(3)))
        assert plan.moved == plan.least == best and plan.bytes == [20, 20, 20]


def test_many_old_shards(spark):
    """Thousands of old shards are no larger a network than the new ones."""
    plan = sharding.Plan([(o, b, 100 + o % 7, 1) for o in range(3000) for b in range(2)], 8)
    whole = sum(plan.bytes)
    assert max(plan.bytes) - min(plan.bytes) <= 2 * 107 and plan.flow.shape == (9, 8)
    assert plan.moved - (whole - sum(2 * (100 + o % 7) for o in range(8))) <= 8 * 2 * 107


def test_the_query_decides_a_flow(spark, tmp_path):
    rows = [(i % 900 if i % 5 else None, "word " * (i % 40) if i % 7 else None, "x") for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.query(spark, str(tmp_path)).collect()
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} == set(range(40))
    size = [sum(r.size for r in got if r.shard == s) for s in range(40)]
    assert max(size) - min(size) <= 2 * 216
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
