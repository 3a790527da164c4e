"""The versioned store, and XML elements read across splits."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner import storage
from gleaner.operators import cache
from gleaner.operators.store import KeyedStore
from gleaner.sources import knowledge, xml_records

SCHEMA = "k string, n long, v string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def held(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_replaces_by_key(spark, tmp_path):
    store, want = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["k", "n"], 4), {}
    assert held(store.snapshot()) == [] and store.versions() == []
    rng = random.Random(1)
    for _ in range(4):
        data = [(rng.choice(["a", "b", None, ""]), rng.choice([1, 2, 3, None]), rng.choice("xyz")) for _ in range(9)]
        store.upsert(rows(spark, data))
        new = {}
        for k, n, v in data:
            new[k, n] = max(new.get((k, n), ""), v)
        want |= new
        assert held(store.snapshot()) == sorted(((k, n, v) for (k, n), v in want.items()), key=str)
    assert store.versions() == [1, 2, 3, 4]
    keys = rows(spark, [("a", 1, None), (None, 2, None), ("none", 9, None)])
    assert held(store.matching(keys)) == sorted(((k, n, v) for (k, n), v in want.items() if (k, n) in {("a", 1), (None, 2)}), key=str)
    store.remove(rows(spark, [("a", 1, None)]))
    assert held(store.snapshot()) == sorted(((k, n, v) for (k, n), v in want.items() if (k, n) != ("a", 1)), key=str)
    assert store.upsert(rows(spark, [])) == 5 and store.versions() == [1, 2, 3, 4, 5]
    store.replace(rows(spark, [("z", 1, "new")]))
    assert held(store.snapshot()) == [("z", 1, "new")]


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["k"], 16)
    store.upsert(rows(spark, [(str(i), i, "old") for i in range(200)]))
    before = store.manifest()["buckets"]
    store.upsert(rows(spark, [("7", 7, "new")]))
    after = store.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert store.snapshot().filter("v = 'new'").count() == 1 and store.snapshot().count() == 200


def test_readers_keep_their_snapshot(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["k"], 2)
    store.upsert(rows(spark, [("a", 1, "one")]))
    first = store.snapshot()
    store.upsert(rows(spark, [("a", 1, "two")]))
    store.vacuum(versions=2, age=0)
    assert held(first) == [("a", 1, "one")] and held(store.snapshot()) == [("a", 1, "two")] and held(store.snapshot(1)) == [("a", 1, "one")]
    store.upsert(rows(spark, [("a", 1, "three")]))
    store.vacuum(versions=1, age=0)
    assert store.versions() == [3] and held(store.snapshot()) == [("a", 1, "three")]


def test_a_crash_before_the_manifest_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["k"], 2)
    store.upsert(rows(spark, [("a", 1, "one")]))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(storage, "rename_new", killed)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(rows(spark, [("a", 1, "lost"), ("b", 2, "lost")]))
        with pytest.raises(KeyboardInterrupt):
            store.replace(rows(spark, [("c", 3, "lost")]))
    again = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["k"], 2)
    assert again.versions() == [1] and held(again.snapshot()) == [("a", 1, "one")]
    again.upsert(rows(spark, [("b", 2, "two")]))
    assert held(again.snapshot()) == [("a", 1, "one"), ("b", 2, "two")]
    left = len(list((tmp_path / "s" / "data").iterdir()))
    again.vacuum(versions=1, age=0)
    assert len(list((tmp_path / "s" / "data").iterdir())) < left and held(again.snapshot()) == [("a", 1, "one"), ("b", 2, "two")]


def test_of_two_writers_one_merges_into_the_others_version(spark, tmp_path, monkeypatch):
    mine, other = (KeyedStore(spark, str(tmp_path / "s"), SCHEMA, ["k"], 1) for _ in range(2))
    mine.upsert(rows(spark, [("a", 1, "one")]))
    rename, raced = storage.rename_new, []

    def late(*args):
        if not raced:
            raced.append(1)
            assert other.upsert(rows(spark, [("b", 2, "other")])) == 2
        return rename(*args)

    monkeypatch.setattr(storage, "rename_new", late)
    assert mine.upsert(rows(spark, [("c", 3, "mine")])) == 3
    assert held(mine.snapshot()) == [("a", 1, "one"), ("b", 2, "other"), ("c", 3, "mine")]


def test_caches_of_producers(spark, tmp_path):
    store = cache.open_store(spark, str(tmp_path / "caches"))
    answers = lambda *pairs: spark.createDataFrame(pairs, "cache_key string, answer string")
    assert cache.load(store, "summary").collect() == []
    cache.save(store, "summary", answers(("k", "b"), ("k", "a"), ("l", "c")))
    cache.save(store, "name", answers(("k", "n")))
    # Written from what was read of the same store.
    cache.save(store, "summary", cache.load(store, "summary").unionByName(answers(("m", "d"))))
    assert held(cache.load(store, "summary")) == [("k", "a"), ("l", "c"), ("m", "d")] and held(cache.load(store, "name")) == [("k", "n")]


# --- XML elements ---

TRICKY = """<?xml version="1.0"?>
<!DOCTYPE c [ <!ENTITY x "y"> ]>
<!-- <Weakness ID="0" Name="in a comment"> -> --->
<w:Catalog xmlns:w="urn:w"><w:Weaknesses>
<w:Weakness
 ID="1" Name="a > b" Status='x > "y"'><w:Description>one <!-- </w:Weakness> --> more</w:Description></w:Weakness>
<w:Weakness\tID='2'><![CDATA[ </w:Weakness> <w:Weakness ID="9"> ]] > ]]><w:Related_Weakness ID="5" /><Weaknesses/><WeaknessX ID="6">x</WeaknessX></w:Weakness >
<Weakness/><Weakness ID="4" Name="/>"/><?pi <Weakness ID="8"> ?><!----><![CDATA[]]><Weakness>> 3 &gt; 2 </Weakness
></w:Weaknesses></w:Catalog>
"""
WANT = [
    "<w:Weakness\n ID=\"1\" Name=\"a > b\" Status='x > \"y\"'><w:Description>one <!-- </w:Weakness> --> more</w:Description></w:Weakness>",
    "<w:Weakness\tID='2'><![CDATA[ </w:Weakness> <w:Weakness ID=\"9\"> ]] > ]]><w:Related_Weakness ID=\"5\" /><Weaknesses/><WeaknessX ID=\"6\">x</WeaknessX></w:Weakness >",
    "<Weakness/>",
    '<Weakness ID="4" Name="/>"/>',
    "<Weakness>> 3 &gt; 2 </Weakness\n>",
]


def read_in_pieces(text, cuts):
    """As two tasks a piece would, without Spark."""
    parts = text.split(">")
    block = [sum(i >= c for c in cuts) for i in range(len(parts))]
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(parts)), pa.array(block, pa.int64()), pa.array(parts)], ["file", "block", "value"])
    summaries = [b.to_pylist()[0] for b in xml_records._summaries(iter([batch]), "Weakness")]
    state, count, begins = 0, 0, {}
    for s in summaries:
        begins["f", s["block"]] = (state, count)
        state, count = s["ends"][state], count + s["begun"][state]
    found = {}
    for k in sorted(set(block)):
        own = batch.filter(pa.array([b == k for b in block]))
        for out in xml_records._records(iter([own]), "Weakness", begins):
            for r in out.to_pylist():
                found[r["record"]] = found.get(r["record"], "") + r["xml"]
    return [found[k] for k in sorted(found)], count


def test_elements_whole_and_cut_behind_every_tag():
    n = TRICKY.count(">") + 1
    assert read_in_pieces(TRICKY, []) == (WANT, 5)
    for i in range(1, n):
        assert read_in_pieces(TRICKY, [i]) == (WANT, 5), i
    assert read_in_pieces(TRICKY, list(range(1, n))) == (WANT, 5)
    rng = random.Random(0)
    for _ in range(50):
        assert read_in_pieces(TRICKY, sorted(rng.sample(range(1, n), 6))) == (WANT, 5)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_read_elements_with_splits_at_any_byte(spark, tmp_path, split):
    (tmp_path / "a.xml").write_text(TRICKY)
    (tmp_path / "b.xml").write_text(re.sub(r"\bw:", "", TRICKY))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(split, 40)))
    spark.conf.set("spark.sql.files.openCostInBytes", str(split))
    try:
        got = xml_records.read_elements(spark, str(tmp_path / "*.xml"), "Weakness").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by_file = {}
    for r in got:
        by_file.setdefault(r["file"][-5], {})[r["record"]] = r["xml"]
    assert by_file["a"] == dict(enumerate(WANT, 1))
    assert by_file["b"] == dict(enumerate([re.sub(r"\bw:", "", w) for w in WANT], 1))


def test_weaknesses_of_every_form_are_read(spark, tmp_path):
    (tmp_path / "list.xml").write_text('<C xmlns="urn:c"><Weakness\n ID="1" Name="n"><Description>d</Description></Weakness><Weakness ID="2" Name="m" Status="Deprecated"/><!-- <Weakness ID="3" Name="no"/> --></C>')
    (tmp_path / "prefixed.xml").write_text('<w:C xmlns:w="urn:c" xmlns:x="urn:x"><w:Weakness ID="4" Name="p" x:lang="en"><w:Description>e <x:b>f</x:b></w:Description></w:Weakness><w:Weakness ID="5" Name="q"/></w:C>')
    (tmp_path / "broken.xml").write_text('<C><Weakness ID="6" Name="r"><open></Weakness><Weakness ID="7" Name="s"/></C>')
    entries = knowledge.read_weaknesses(spark, str(tmp_path / "*.xml"))
    assert entries.count() == 6
    got = {r.key: (r.title, r.text) for r in knowledge.weaknesses(entries).collect()}
    assert got == {"CWE-1": ("n", "d"), "CWE-4": ("p", "e f"), "CWE-5": ("q", ""), "CWE-7": ("s", "")}
    assert ["ID=\"6\"" in r.xml for r in knowledge.unread(entries).collect()] == [True]
    assert knowledge.unread(entries.limit(0).unionByName(entries.filter(F.lit(False)))).count() == 0
