import zlib
from collections import Counter, defaultdict

import pytest

from coursepulse.llm import shards as sh


def check(rows, texts, shards, slots):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts
    )
    places = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards and 0 <= r.virtual_slot < slots
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len({(r.virtual_slot, r.shard) for r in rows}) == len({r.virtual_slot for r in rows})
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    return [sizes[s] for s in range(shards)]


def test_every_row_has_a_place_and_sizes_are_near_equal(spark, documents, tmp_path):
    texts = [(i, "é" * (i * 37 % 211)) for i in range(1500)]
    texts += [(7, "copy")] * 900 + [(None, "x"), (None, None), (8, None), (8, "")]
    path = str(tmp_path / "map")
    rows = sh.deal(spark, documents(texts, extra="slot"), 8, 512, path).collect()
    sizes = check(rows, texts, 8, 512)
    assert max(sizes) <= 1.001 * min(sizes)
    # The stored versions: the even first one, and the newest, which the rows were dealt by.
    first, newest = sh.SlotMap.load(spark, path, 0), sh.SlotMap.load(spark, path)
    assert first == sh.SlotMap.first(512, 8) and newest.version == 1
    assert all(newest.shard_of[r.virtual_slot] == r.shard for r in rows)
    assert len({r.virtual_slot for r in rows if r.doc_id == 7}) > 5


def test_shards_and_places_against_a_plain_layout(spark, documents, tmp_path):
    texts = [(i, "ab" * (i * 37 % 211)) for i in range(400)] + [(7, "copy")] * 200 + [(None, "x"), (9, None)] * 3
    docs = documents(texts)
    rows = sh.deal(spark, docs, 5, 64, str(tmp_path / "map")).collect()
    # Every row's slot by its key, hash and bundle; then the map by bytes; then rows slot by slot.
    hashed = docs.selectExpr("doc_id", "xxhash64(text) AS h", "octet_length(coalesce(text, '')) + 1 AS size").collect()
    seen, own = Counter(), []
    for r in sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
        own.append((r.doc_id, r.h, seen[r] // sh.BUNDLE, r.size))
        seen[r] += 1
    keys = spark.createDataFrame(sorted(set(own), key=str), "doc_id long, h long, bundle long, size int")
    slot_of = {(r.doc_id, r.h, r.bundle): r.s for r in keys.select("*", sh.slot("doc_id", "h", "bundle", slots=64).alias("s")).collect()}
    weight = Counter()
    for doc, h, bundle, size in own:
        weight[slot_of[doc, h, bundle]] += size
    shard_of = sh.SlotMap.first(64, 5).rebalanced(weight).shard_of
    own.sort(key=lambda o: slot_of[o[:3]])  # stable: key, hash and bundle within a slot
    filled, expected = Counter(), Counter()
    for doc, h, bundle, size in own:
        slot = slot_of[doc, h, bundle]
        expected[doc, size, shard_of[slot], filled[shard_of[slot]], slot] += 1
        filled[shard_of[slot]] += 1
    assert Counter((r.doc_id, r.size, r.shard, r.slot, r.virtual_slot) for r in rows) == expected


def test_growing_edits_the_map(spark):
    weight = {slot: 100 + slot * 7919 % 1000 for slot in range(1024)}
    old = sh.SlotMap.first(1024, 8).rebalanced(weight)
    new = old.rebalanced(weight, 9)
    load = Counter()
    for slot, shard in enumerate(new.shard_of):
        load[shard] += weight[slot]
    assert new.version == 2 and len(load) == 9 and max(load.values()) - min(load.values()) < 0.01 * min(load.values())
    assert new.moved(old) < 1024 / 5  # not dealt anew
    fewer = new.rebalanced(weight, 4)
    assert fewer.shards == 4 and set(fewer.shard_of) == {0, 1, 2, 3}


@pytest.mark.parametrize("weight", [{}, {3: 10}, {i: 1 for i in range(64)}, {0: 10**9, 8: 1, 16: 1}])
def test_rebalancing_ends(weight):
    new = sh.SlotMap.first(64, 8).rebalanced(weight)
    load = Counter({s: 0 for s in range(8)})
    for slot, w in weight.items():
        load[new.shard_of[slot]] += w
    assert max(load.values()) <= max(max(weight.values(), default=0), -(-sum(weight.values()) // 8))


def test_bounds_and_empty_table(spark, documents, tmp_path):
    with pytest.raises(ValueError):
        sh.SlotMap.first(4, 8)
    with pytest.raises(ValueError):
        sh.SlotMap.first(sh.MAX_SLOTS + 1, 8)
    empty = documents([(1, "x")]).where("doc_id > 1")
    assert sh.deal(spark, empty, 8, 64, str(tmp_path / "m")).count() == 0
