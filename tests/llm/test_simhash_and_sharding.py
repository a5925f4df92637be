"""SimHash, sharding, graphs and numbering against plain Python."""

import random
import zlib
from itertools import combinations

import pytest
import xxhash

import corpus_pipeline
from pixelmill.llm import graph, near_sets, numbering, shards, simhash

SCHEMA = "doc_id long, text string, fp string, row_key int, component_id string"


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, linked):
    head = {i: i for i in range(len(ids))}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if linked(i, j):
            head[root(i)] = root(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(ids))]


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, "lost id"), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "ONE"), (8, "two words"), (8, "two words"), (9, "Ünï é ÜNÏ é x")]
    for g in range(6):
        base = [rng.choice(words) for _ in range(400)]
        for c in range(8):
            text = list(base)
            for _ in range(c // 2):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((100 * g + 10 + c, " ".join(text)))
    rows.append((999, " ".join(rng.choice(words) for _ in range(90_000))))
    return rows


@pytest.mark.parametrize("together", [512, 3])
def test_near_duplicates(spark, together):
    rows = corpus()
    got = simhash.near_duplicates(table(spark, rows), together=together).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    parts = plain_components([i for i, _ in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, parts)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == want
    assert len(set(parts)) < len(rows) - 20


def test_masks_cover_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(4)]
    assert len(masks) == 31 and all(30 <= m.bit_count() <= 36 for m in masks)
    rng = random.Random(1)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not d & m for m in masks)
    with pytest.raises(ValueError):
        simhash.fingerprint_links(None, "fp", 3)


def test_links_of_random_prints(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(20):
            p = base
            for b in rng.sample(range(64), rng.randrange(5)):
                p ^= 1 << b
            prints.add(p - (1 << 64) if p >> 63 else p)
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = plain_components(prints, lambda i, j: ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 4)
    for together in (512, 4):
        links = simhash.fingerprint_links(df, "fp", 4, together)
        got = {r["node"]: r["root"] for r in graph.components(links, "a", "b").collect()}
        assert [got.get(p, p) for p in prints] == want


def test_one_of_each(spark):
    rows = corpus()
    kept = simhash.one_of_each(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "row_key", "component_id"]
    prints = [plain_fingerprint(t) for _, t in rows]
    parts = plain_components([i for i, _ in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted({p or 0 for p in parts})


def test_near_dedup_stage_reaches_its_similarity(spark):
    """Planted copies from 0.7 up: every link of 0.8 or more counts, none below, against brute force."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = [(None, "lost id"), (3, None), (4, ""), (5, " \n"), (6, "one"), (7, "ONE"), (8, "a b c d"), (8, "a b c d"), (9, "a b c e")]
    for g in range(80):
        base = [word() for _ in range(rng.choice([60, 150, 400]))]
        rows.append((1000 + 10 * g, " ".join(base)))
        for c in range(1, 3):
            text = list(base)
            for _ in range(max(1, int(len(base) * rng.uniform(0.003, 0.035)))):
                text[rng.randrange(len(text))] = word()
            rows.append((1000 + 10 * g + c, " ".join(text) + " all of this line is shared by many"))

    def five(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [five(t) for _, t in rows]
    alike = lambda i, j: len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and alike(i, j) and sets[i] != sets[j]]
    wide = [(i, j) for i, j in near if (plain_fingerprint(rows[i][1]) ^ plain_fingerprint(rows[j][1])).bit_count() > 4]
    assert len(wide) > 20  # most would be lost by the fingerprints alone
    parts = plain_components([i for i, _ in rows], alike)
    kept = corpus_pipeline.near_dedup(spark, table(spark, rows), "")
    assert kept.columns == ["doc_id", "text", "fp", "row_key", "component_id"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted({p or 0 for p in parts})
    assert near_sets.one_of_each(table(spark, [])).count() == 0


def test_empty_tables(spark):
    none = table(spark, [])
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).count() == 0
    assert shards.sharded(none).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(200)]
    links = spark.createDataFrame([*path, *star, (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(201)}}


def test_numbering_of_hot_groups(spark):
    df = spark.range(5000, numPartitions=7).selectExpr("id % 3 = 0 as hot", "id", "if(id % 3 = 0, 0, id % 5) as g")
    got = numbering.numbered(df, "g", ["id"], "n", "test").collect()
    for g in range(5):
        own = sorted((r["id"], r["n"]) for r in got if r["g"] == g)
        assert [n for _, n in own] == list(range(len(own)))


def test_sharding(spark):
    rows = [(i, f"text {i}") for i in range(4000)] + [(None, None), (7, "again"), (7, "again"), (8, ""), (9, "é")]
    got = shards.sharded(table(spark, rows)).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"key"}
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(len(v) == 1 for v in by_id.values())
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and 400 < len(slots) < 600
    assert 330 < sum(r["grown_shard"] == 8 for r in got) < 560
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want


def test_weights(spark):
    df = spark.range(20000)
    got = df.select(shards.rendezvous([df.id], [1, 2, 1]).alias("s"), shards.rendezvous([df.id], [1, 3, 1]).alias("t")).collect()
    share = sum(r["s"] == 1 for r in got) / len(got)
    assert 0.48 < share < 0.52
    assert all(r["t"] in (r["s"], 1) for r in got)
    with pytest.raises(ValueError):
        shards.rendezvous([df.id], [1, 0])


def test_written_shards(spark, tmp_path):
    docs = table(spark, [(i, str(i)) for i in range(100)])
    shards.write_shards(docs, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
