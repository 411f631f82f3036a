import random

import pytest
import xxhash

from sparktab.llm.simhash import fingerprint, links, near_duplicates, one_of_each_group
from tests.conftest import SF_CHECK, SF_SMALL

from .helpers import edge_frame, empty_frame, stored


def plain_fingerprint(text, k=3, seed=42):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, most=2):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("max_bits", "hot"), [(0, 2000), (1, 2000), (2, 2000), (2, 2), (3, 2), (4, 2000)])
def test_links_are_all_pairs_within_the_distance(spark, max_bits, hot):
    r = random.Random(5)
    values = {0, 1, 3, 7, 1 << 63, (1 << 64) - 1}
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    values = sorted(values)
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(values) for b in values[i + 1:]
            if (a ^ b).bit_count() <= max_bits}
    got = [tuple(x) for x in links(spark.createDataFrame([(signed(x),) for x in values], "fp long"),
                                   max_bits=max_bits, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    want = components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(set(want.values())) < len(want)


def test_fingerprint_of_few_and_many_words(monkeypatch):
    import sparktab.llm.simhash as s
    monkeypatch.setattr(s, "BLOCK", 7)
    for text in ("", " \t", "One", "one two", "a b c d e f g h i j k l m n", "Ünï Çode\x0bsplit\x85not"):
        assert fingerprint(text, 3, 42) == signed(plain_fingerprint(text))


def test_edges(spark, tmp_path):
    rows = near_duplicates(edge_frame(spark)).collect()
    assert len(rows) == 10
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {2}  # null, empty and blank texts link
    assert near_duplicates(empty_frame(spark)).count() == 0
    df = stored(spark, edge_frame(spark), tmp_path)
    kept = one_of_each_group(df)
    assert kept.columns == df.columns
    assert len([r for r in kept.collect() if r.doc_id == 1]) == 1
    assert sum(not (r.text or "").split() for r in kept.collect()) == 1


def test_other_splits_at_every_reading(spark, tmp_path, monkeypatch):
    from sparktab.llm import simhash

    from .helpers import read_differently
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.repartition(12).write.parquet(str(tmp_path / "parts"))
    docs = spark.read.parquet(str(tmp_path / "parts"))
    want = sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect())
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    read_differently(spark, monkeypatch, simhash)
    try:
        assert sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect()) == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_repeated_rows_leave_one(spark):
    from sparktab.llm.simhash import one_of_each_group
    rows = [(i, f"the same words in all of them {x}") for i, x in [(5, "a"), (5, "a"), (5, "a"), (7, "a"), (None, "a")]]
    rows += [(None, None), (3, "quite another text that stands here alone"), (8, ""), (9, None)]
    got = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == ["3", "5", "8"]


@pytest.mark.parametrize("hot", [2000, 2])
def test_variants_are_never_broadcast(spark, tmp_path, hot):
    spark.range(500).selectExpr("xxhash64(id div 2) ^ (id % 2) as fp").write.parquet(f"{tmp_path}/fps")
    found = links(spark.read.parquet(f"{tmp_path}/fps"), hot=hot)
    assert found.count() == 250
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_fingerprints_meet_their_counts_without_a_broadcast(spark, tmp_path, monkeypatch):
    from sparktab.llm import simhash
    plans = []
    monkeypatch.setattr(simhash, "written", lambda df, name: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or stored(spark, df, tmp_path / name))
    spark.range(500).selectExpr("xxhash64(id div 2) ^ (id % 2) as fp").write.parquet(f"{tmp_path}/fps")
    links(spark.read.parquet(f"{tmp_path}/fps"))
    assert len(plans) == 1 and "Generate" in plans[0] and "strategy=merge" in plans[0]
