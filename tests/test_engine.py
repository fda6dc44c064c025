"""Views, scans, compaction, codecs and the store against small brute-force models."""

import random

import pytest

from tidelog.functions import bloom, codec
from tidelog.functions.bloom import Bloom
from tidelog.model import KV_LOG, Options, Status
from tidelog.operators import compaction, manifest, scan, snapshots, view
from tidelog.operators.batch import WriteBatch, assign_seq
from tidelog.sources.store import KVStore


def log_of(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, t, None if v is None else bytearray(v)) for k, s, t, v in rows], KV_LOG)


def model(rows, as_of):
    newest = {}
    for k, s, t, v in rows:
        if s <= as_of and s > newest.get(k, (0,))[0]:
            newest[k] = (s, t, v)
    return {k: v for k, (s, t, v) in newest.items() if t}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for s in range(1, 301):
        gone = rng.random() < 0.3
        out.append((b"k%02d" % rng.randrange(25), s, 0 if gone else 1, None if gone else b"v%d" % s))
    return out


def pairs(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}


def test_views_and_compaction_keep_every_visible_state(spark, rows):
    log = log_of(spark, rows)
    small = compaction.compact(log, 200)
    assert small.count() < log.count()
    for s in (1, 57, 200, 300):
        assert pairs(view.view(log, s)) == pairs(view.view_by_max(log, s)) == model(rows, s)
        if s >= 200:
            assert pairs(view.view(small, s)) == model(rows, s)


def test_tombstone_stays_over_deeper_file(spark):
    log = log_of(spark, [(b"a", 5, 0, None), (b"b", 6, 0, None)])
    deeper = spark.createDataFrame([(bytearray(b"a"), bytearray(b"a"))], "smallest_key binary, largest_key binary")
    assert [bytes(r["key"]) for r in compaction.compact(log, 9, deeper).collect()] == [b"a"]


def test_seek_prev_cursor(spark, rows):
    log, m = log_of(spark, rows), sorted(model(rows, 300).items())
    keys = [k for k, _ in m]
    for probe in (b"", b"k07", b"k07x", b"z"):
        hit = scan.seek(log, bytearray(probe)).first()
        want = next((k for k in keys if k >= probe), None)
        assert (bytes(hit["key"]) if hit else None) == want
        hit = scan.prev(log, bytearray(probe)).first()
        want = next((k for k in reversed(keys) if k < probe), None)
        assert (bytes(hit["key"]) if hit else None) == want
    c = scan.Cursor(log)
    assert not c.valid() and c.advance() and bytes(c.current()[0]) == keys[0]
    assert not c.prev() and not c.valid()
    assert [bytes(k) for k, _ in c.fetch(3)] == keys[:3]


def test_diff_forms_agree(spark, rows):
    log = log_of(spark, rows)
    a = sorted(map(str, snapshots.diff(log, 100, 250).collect()))
    assert a == sorted(map(str, snapshots.diff_by_join(log, 100, 250).select("key", "old_value", "new_value", "change").collect()))


def test_separator_and_successor_goldens():
    for a, b, want in [(b"abcd", b"abcf", b"abce"), (b"abc", b"acd", b"abd"), (b"abcdefghi", b"abcffghi", b"abce"), (b"a", b"a", b"a"), (b"a", b"b", b"a\0"), (b"abc", b"zzz", b"b"), (b"yyy", b"z", b"yz")]:
        assert codec.shortest_separator(a, b) == want
    for a, want in [(b"abcd", b"b"), (b"zzzz", b"{"), (b"", b"\0"), (b"\xff\xff\xff", b"\xff\xff\xff\0")]:
        assert codec.shortest_successor(a) == want


def test_codecs():
    assert codec.encode_internal_key(b"xyabxy", 97, 1) == bytes.fromhex("787961627879 0161000000000000")
    assert codec.encode_memtable_key(b"abc", 123, 1, b"231") == bytes.fromhex("0b616263017b00000000000003323331")
    assert codec.parse_memtable_key(codec.encode_memtable_key(b"k", 9, 0, b"")) == (b"k", 9, 0, b"")
    assert codec.crc32_cksum(bytes(32)) == 0xFFFFFFFF and codec.crc32_cksum(b"\xff" * 32) == 0x9A809998
    batch = WriteBatch().add(b"abc", b"def").add(b"123", b"456").add(b"xxx", b"yyy").delete(b"zzz").delete(b"010")
    assert len(batch.encode()) == 49 and list(WriteBatch.decode(batch.encode())) == list(batch)


def test_bloom_has_no_false_negatives():
    keys = [b"key%d" % i for i in range(2000)]
    raw = Bloom().create(keys)
    assert all(Bloom().may_hold(k, raw) for k in keys)
    assert sum(Bloom().may_hold(b"other%d" % i, raw) for i in range(2000)) < 80


def test_file_names(spark):
    names = ["CURRENT", "LOCK", "LOG", "LOG.old", "MANIFEST-01234", "001122.sst", "001122.ldb", "001122.dbtmp", "xyz.LOCK", "01a.sst", "0011.abc", "MANIFEST-trolol"]
    got = {r["name"]: (r["file_type"], r["file_id"]) for r in manifest.parse_file_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got["MANIFEST-01234"] == ("manifest", 1234) and got["001122.sst"] == ("table", 1122) and got["LOG.old"] == ("info_log", 0)
    assert all(got[n] == (None, None) for n in names[8:])


def test_assign_seq(spark):
    df = assign_seq(spark.range(1000), 50, "id")
    assert all(r["seq"] == 51 + r["id"] for r in df.collect())


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    with KVStore.open(spark, path, Options.for_test()) as s:
        for i in range(6):
            s.put(b"k%d" % i, b"v%d" % i)
        s.delete(b"k2")
        pin = s.snapshot()
        s.put(b"k4", b"new")
        assert (s.get(b"k1"), s.get(b"k2"), s.get(b"k4"), s.get(b"k4", pin)) == (b"v1", None, b"new", b"v4")
        with pytest.raises(Status):
            KVStore.open(spark, path)
    with KVStore.open(spark, path, Options.for_test()) as s:
        assert s.get(b"k4") == b"new" and s.get(b"k2") is None
        s.compact_range()
        assert pairs(s.scan()) == {b"k0": b"v0", b"k1": b"v1", b"k3": b"v3", b"k4": b"new", b"k5": b"v5"}
        assert not s.logs and all(f["level"] > 0 for f in s.files)
    with pytest.raises(Status):
        KVStore.open(spark, path, Options(comparator="other"))
    with pytest.raises(Status):
        KVStore.open(spark, path, Options(error_if_exists=True))


def test_store_reopen_script(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    with KVStore.open(spark, path) as s:
        for i in range(1, 6):
            s.put(b"xx%d" % i, b"11%d" % i)
        s.delete(b"xx2")
    with KVStore.open(spark, path) as s:
        s.delete(b"xx5")
    with KVStore.open(spark, path) as s:
        old = s.snapshot()
        s.put(b"xx4", b"222")
        new = s.snapshot()
        assert [s.get(k, old) for k in (b"xx3", b"xx2", b"xx5", b"xx4")] == [b"113", None, None, b"114"] and s.get(b"xx4", new) == b"222"
    with KVStore.open(spark, path) as s:
        assert (s.get(b"xx3"), s.get(b"xx4"), s.get(b"xx2")) == (b"113", b"222", None) and s.last_sequence == 8


def test_store_survives_crashes(spark, tmp_path):
    """A writer that is gone, a batch cut short, a lost CURRENT: nothing that was written is lost or deleted."""
    path = f"file://{tmp_path}/db"
    s = KVStore.open(spark, path, Options.for_test())
    s.put(b"a", b"1")
    s.maintain()
    s.put(b"b", b"2")
    s.write(WriteBatch().add(b"c", b"3").delete(b"a"))
    s.env.unlock(f"{path}/LOCK")
    log = tmp_path / "db" / f"{s.log_id:06d}.log"
    torn = sorted(p for p in log.iterdir() if p.name[0] != ".")[-1]
    whole = torn.read_bytes()
    s.env.write_bytes(f"{path}/{log.name}/{torn.name}", whole[:-3])
    with KVStore.open(spark, path, Options.for_test()) as s:
        assert (s.get(b"a"), s.get(b"b"), s.get(b"c"), s.last_sequence) == (b"1", b"2", None, 2)
    s.env.rename(f"{path}/CURRENT", f"{path}/gone")
    with pytest.raises(Status, match="Corruption"):
        KVStore.open(spark, path)
    s.env.rename(f"{path}/gone", f"{path}/CURRENT")
    with KVStore.open(spark, path) as s:
        assert pairs(s.scan()) == {b"a": b"1", b"b": b"2"}


def test_store_tables_are_disjoint_and_manifest_folds(spark, tmp_path):
    rng, want = random.Random(5), {}
    options = Options(max_file_size=2000, level0_trigger=2)
    s = KVStore.open(spark, f"file://{tmp_path}/db", options)
    s.EDITS = 4
    for turn in range(5):
        batch = WriteBatch()
        for _ in range(120):
            k = b"%04d" % rng.randrange(400)
            if rng.random() < 0.25:
                batch.delete(k)
                want.pop(k, None)
            else:
                want[k] = b"v%d" % turn
                batch.add(k, want[k])
        s.write(batch)
        while s.maintain():
            pass
    files = s.files
    s.close()
    with KVStore.open(spark, f"file://{tmp_path}/db", options) as s:
        s._check()
        assert sorted(map(str, s.files)) == sorted(map(str, files)) and pairs(s.scan()) == want
        s.compact_range()
        assert pairs(s.scan()) == want and s.log_df().count() == len(want) and len(s.files) > 2


def test_frames(spark):
    for n in (0, 1, codec.FRAME - codec.HEADER, codec.FRAME, 3 * codec.FRAME + 5):
        raw = bytes(i % 251 for i in range(n))
        framed = codec.frame_record(raw)
        assert codec.unframe_record(framed) == raw
        if n:
            assert codec.unframe_record(framed[:-1]) is None and codec.unframe_record(framed[:-1] + bytes([framed[-1] ^ 1])) is None


def test_async_store(spark, tmp_path):
    import asyncio

    from tidelog.streaming.aio import AsyncStore

    async def go():
        s = await AsyncStore.open(spark, f"file://{tmp_path}/db")
        await s.put(b"a", b"1")
        at = await s.get_snapshot()
        await s.write(WriteBatch().add(b"a", b"2").delete(b"b"))
        await s.compact_range()
        got = await s.get(b"a"), await s.get_at(at, b"a")
        await s.drop_snapshot(at)
        with pytest.raises(Status):
            await s.get_at(at, b"a")
        await s.close()
        return got

    assert asyncio.run(go()) == (b"2", b"1")


def test_key_conditions_reach_the_tables(spark, tmp_path):
    with KVStore.open(spark, f"file://{tmp_path}/db") as s:
        s.put(b"a", b"1")
        s.maintain()
        plan = s.scan(b"a", b"b")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(key" in pushed and "LessThanOrEqual(key" in pushed


def test_compaction_forms_agree(spark, rows):
    log = log_of(spark, rows)
    deeper = spark.createDataFrame([(bytearray(b"k05"), bytearray(b"k12"))], "smallest_key binary, largest_key binary")
    for d in (None, deeper):
        a = compaction.compact(log, 200, d).select("key", "seq", "kind").collect()
        b = compaction.mark(log, 200, d).where("reason IS NULL").select("key", "seq", "kind").collect()
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_tables_are_ranges_of_few_files(spark, tmp_path):
    """A compaction writes no more files than tasks, however small its tables; rows of tables that are gone are not read."""
    folder, rng, want = tmp_path / "db", random.Random(3), {}
    s = KVStore.open(spark, f"file://{folder}", Options(max_file_size=512, write_buffer_size=1 << 30, level0_trigger=2))
    for turn in range(2):
        batch = WriteBatch()
        for i in range(3000):
            want[b"%05d" % i] = b"%d" % turn
            batch.add(b"%05d" % i, want[b"%05d" % i])
        s.write(batch)
        s.maintain()
    s.compact_range()
    assert sum(p.suffix == ".ldb" for p in folder.iterdir()) <= 4 and len(s.files) >= 60
    assert max(f["size"] for f in s.files) <= 512 + 14 and sum(f["entries"] for f in s.files) == len(want)
    assert s.files_df().transform(compaction.overlaps).first()["overlaps"] == 0
    # Parts of the tables are deleted, and the deletions compacted away with them: their rows are still in the folders.
    gone = [*range(100, 900), *range(1500, 1510), *range(2900, 3000)]
    for a, b in ((0, 800), (800, 810), (810, 910)):
        batch = WriteBatch()
        for i in gone[a:b]:
            batch.delete(b"%05d" % i)
            del want[b"%05d" % i]
        s.write(batch)
        s._make_room()
        s.compact_range(b"%05d" % gone[a], b"%05d" % gone[b - 1])
    s.close()
    s = KVStore.open(spark, f"file://{folder}", s.options)
    assert pairs(s.scan()) == want and s.get(b"00500") is None and s.get(b"00999") == b"1" and s.log_df().count() == len(want)
    assert pairs(s.scan(b"00850", b"01505")) == {k: v for k, v in want.items() if b"00850" <= k <= b"01505"}


def test_moves_are_one_edit(spark, tmp_path, monkeypatch):
    """Tables that move down without being rewritten cost one edit together, and go where they went one by one."""
    s = KVStore.open(spark, f"file://{tmp_path}/db")
    tables = [{"level": 1, "file_id": 10 + i, "size": 1 << 20, "smallest_key": b"%03d" % i, "largest_key": b"%03d" % i, "entries": 1, "folder": 10 + i, "place": 0, "of": 1} for i in range(50)]
    s.files, edits = list(tables), []
    monkeypatch.setattr(s, "_commit", lambda: edits.append(1))
    while s.maintain():
        pass
    # Level 1 asks for a compaction from 10 MiB on.
    assert len(edits) == 1 and sorted(f["file_id"] for f in s.files if f["level"] == 1) == list(range(51, 60)) and len(s.files) == 50


def test_overlaps_are_counted_pair_by_pair(spark):
    rng = random.Random(9)
    spans = [(rng.randrange(1, 3), *sorted((rng.randrange(60), rng.randrange(60)))) for _ in range(80)]
    files = spark.createDataFrame([(level, bytearray([a]), bytearray([b])) for level, a, b in spans], "level int, smallest_key binary, largest_key binary")
    want = sum(x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2] for i, x in enumerate(spans) for y in spans[i + 1 :])
    assert compaction.overlaps(files).first()["overlaps"] == want


def test_tables_end_at_bounds(spark):
    rows = spark.createDataFrame([("f", bytearray([k]), s, 1, bytearray(b"v")) for k in range(40) for s in (1, 2)], f"file_id string, {KV_LOG}")
    bounds = [bytes([k]) for k in (4, 5, 17, 39)]
    got = compaction.cut_tables(rows, "file_id", 100, bounds).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(len(got))) and sum(r["entries"] for r in got) == 80
    assert all(not r["smallest_key"][0] <= b[0] < r["largest_key"][0] for r in got for b in bounds) and max(r["size"] for r in got) <= 120


def test_filters_are_counted_as_one_by_one(spark, monkeypatch):
    """Keys of all lengths against filters of many sizes, with ranges that meet some, none and all keys, in several chunks."""
    rng = random.Random(11)
    keys = [rng.randbytes(rng.choice((0, 1, 3, 4, 8, 8, 8, 13))) for _ in range(1500)]
    assert bloom.murmur3_32_of(keys).tolist() == [bloom.murmur3_32(k) for k in keys]
    filters = []
    for i in range(400):
        held = rng.sample(keys, rng.choice((3, 60, 60, 60, 61)))
        a, b = (min(held), max(held)) if i % 3 else sorted((rng.randbytes(2), rng.randbytes(2)))
        filters.append((bytearray(a), bytearray(b), bytearray(Bloom(rng.choice((1, 10, 10))).create(held))))
    filters += [(bytearray(b""), bytearray(b"\x80"), bytearray()), (bytearray(b"\x20"), bytearray(b"\xff"), bytearray(b"\0" * 8 + b"\x1f"))]
    want = {}
    for k in keys:
        n = sum(bytes(a) <= k <= bytes(b) and Bloom().may_hold(k, bytes(raw)) for a, b, raw in filters)
        if n:
            want[k] = want.get(k, 0) + n
    monkeypatch.setattr(bloom, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(bloom, "BLOCK", 100)
    asked = spark.createDataFrame([(bytearray(k),) for k in keys] + [(None,)], "key binary")
    got = bloom.count_holding(asked, spark.createDataFrame(filters, "smallest_key binary, largest_key binary, bloom binary"))
    assert {bytes(r["key"]): r["n_files"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_snapshot_query_takes_no_third_into_one_task(spark, tmp_path, monkeypatch):
    """The snapshot is taken at the right entry, and not by a limit, which gathers its rows in one task."""
    from tidelog.plans import storequeries

    statuses = ["O", "F", "P", "O", "O", "F", "O", "P", "O", "F"]
    rows = [(7 * i, i % 4, statuses[i], f"v{i}") for i in range(10)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    frame = type(spark.range(1))
    limit = frame.limit
    monkeypatch.setattr(frame, "limit", lambda df, n: limit(df, n) if n == 1 else pytest.fail(f"limit {n}"))
    got = {(r["at"], r["k"], r["seq"], r["v"]) for r in storequeries.kv_store_snapshot(spark, str(tmp_path)).collect()}
    want = set()
    for at, top in (("then", 3), ("now", 10)):
        newest = {k: (i + 1, s, v) for i, (_, k, s, v) in enumerate(rows[:top])}
        want |= {(at, k, seq, v) for k, (seq, s, v) in newest.items() if s != "F"}
    assert got == want
