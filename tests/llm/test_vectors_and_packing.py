"""Embedding links, packing and the pipeline against plain Python."""

import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pixelmill.llm import cap_filters, packing, queries


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "c") for i, v in rows], "vec_id long, embedding array<float>, links int, c string")


def plain_links(rows, cosine=0.95):
    """n_links and component of each row."""
    unit = []
    for _, v in rows:
        good = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float32).astype(np.float64) if good else None)
    n, head = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                n[i] += 1
                n[j] += 1
                head[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, n[i], least.get(root(i)) if unit[i] is not None else k) for i, (k, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("together", [1024, 7])
def test_near_vectors(spark, together):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(12):
        centre = rng.standard_normal(24)
        for _ in range(25):
            rows.append((len(rows), centre + rng.standard_normal(24) * rng.choice([0.05, 0.2, 0.3])))
    same = rng.standard_normal(24)
    rows += [(1000 + i, same) for i in range(40)] + [(2000, same * 3), (2001, [1.0] * 8), (2002, [1.0, 1.01] * 4), (2001, [1.0] * 8)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [float("nan")] + [1.0] * 23), (3004, [None] + [1.0] * 23), (3005, [float("inf")] * 24), (None, same), (3006, [3e38] * 24), (3007, [1e-40] * 24)]
    got = cap_filters.near_vectors(vectors(spark, rows), together=together).collect()
    want = plain_links(rows)
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr)
    missed = sum(w[1] for w in want) - sum(f[1] for f in found)
    assert 0 <= missed <= 0.02 * sum(w[1] for w in want)
    if not missed:
        assert found == want
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert cap_filters.near_vectors(vectors(spark, [])).count() == 0


def test_recall_at_the_bar():
    """Pairs at exactly the least cosine share a filter as often as asked for, also for many vectors."""
    for n in (100, 50_000, 20_000_000):
        code = cap_filters.chosen(n, 64, 0.95)
        r = np.random.default_rng(77)
        a, b = r.standard_normal((2, 400, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        parts = code.parts(64)
        (ra, fa), (rb, fb) = code.lists(a, parts), code.lists(b, parts)
        key = code.filters * code.copies
        assert len(np.unique(ra[np.isin(ra * key + fa, rb * key + fb)])) / 400 > 0.95


def test_decoding_lists_all_filters():
    code = cap_filters.Code(3, 5, 2)
    x = np.random.default_rng(1).standard_normal((20, 9))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for part in code.parts(9):
        turn, codes, bar = part
        y = x @ turn
        want = {(i, (a * 5 + b) * 5 + c) for i in range(20) for a in range(5) for b in range(5) for c in range(5) if y[i, :3] @ codes[0][a] + y[i, 3:6] @ codes[1][b] + y[i, 6:] @ codes[2][c] >= bar}
        assert set(zip(*(v.tolist() for v in code.decoded(x, part)))) == want


def planted(n, dim, cosines, rng):
    """Random unit vectors, half of them with a partner at one of the cosines."""
    a = rng.standard_normal((n // 2, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n // 2, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.choice(cosines, n // 2)[:, None]
    return np.concatenate((a, c * a + np.sqrt(1 - c * c) * b)).astype(np.float32)


@pytest.mark.parametrize("dim,dense", [(64, 8), (64, 0), (16, 8), (3, 8)])
def test_recall_on_planted_pairs(spark, dim, dense):
    """Pairs at and over the bar, by the registered parameters; dense 0: all links are counted inside filters."""
    rng = np.random.default_rng(dim)
    x = planted(2000 if dim > 3 else 400, dim, [0.94, 0.951, 0.96, 0.97, 0.999], rng)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in cap_filters.near_vectors(vectors(spark, rows), dense=dense).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    want = near.sum(axis=1)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.985 * want.sum()


def test_caps_of_all_dimensions():
    """The share of random unit vectors over the bar, and codes whose sampled recall is met for any length of vectors."""
    rng = np.random.default_rng(1)
    for dim in (2, 3, 8, 64):
        x = rng.standard_normal((200_000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for share in (0.3, 0.01):
            assert abs((x[:, 0] >= cap_filters.cap(dim, share)).mean() - share) < 0.1 * share
    for dim in (1, 2, 4, 12, 64):
        for n in (10, 1_000_000):
            code = cap_filters.chosen(n, dim, 0.95)
            x = planted(400, dim, [0.951], rng) if dim > 1 else np.ones((400, 1))
            a, b = x[:200], x[200:]
            sets = [set(zip(*(v.tolist() for v in code.lists(z / np.linalg.norm(z, axis=1, keepdims=True), code.parts(dim))))) for z in (a, b)]
            met = {i for i, _ in sets[0] & sets[1]}
            assert len(met) >= 0.97 * len(a)


def test_signs():
    rng = np.random.default_rng(5)
    x = planted(4000, 32, [0.95], rng).astype(np.float64)
    s = cap_filters.signs(x).view(np.uint64)
    apart = np.bitwise_count(s[:2000] ^ s[2000:]).sum(axis=1)
    assert s.shape == (4000, 2) and (apart <= cap_filters.signs_apart(0.95)).mean() >= 0.999
    assert cap_filters.signs_apart(1.0) == 0 and (np.bitwise_count(s[:1999] ^ s[1:2000]).sum(axis=1) <= cap_filters.signs_apart(0.95)).mean() < 0.001


TEXTS = [(None, "no id"), (1, None), (2, ""), (3, "Hello, world! it's 2024"), (3, "Hello, world! it's 2024"), (4, "a\x1cb c's don't İstanbul <|endoftext|> é ǆ"), (5, " ".join(f"token{i}x" for i in range(4000)))]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, piece int, sequence_id int")


def test_packing(spark):
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_path(), random.Random(1)
    rows = TEXTS + [(10 + i, " ".join(rng.choice(["alpha", "beta", "Gamma,", "delta."]) for _ in range(rng.choice([5, 300, 900, 2500])))) for i in range(80)]
    got = packing.packed(docs(spark, rows), path, with_ids=True)
    found = got.collect()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    want = []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr) == sorted(want, key=repr)
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r["length"] for r in found) // 4096) + 1
    joined = packing.sequences(got).collect()
    assert sorted(len(r["ids"]) for r in joined) == sorted(sum(n for _, n in p) for p in by.values())
    assert packing.packed(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_limit(rule):
    rng = random.Random(3)
    lengths = {n: rng.randrange(1, 30) for n in rng.sample(range(1, 101), 40)}
    limits = packing.Limits(100, 4, 6000)
    lengths = {n: k for n, k in lengths.items() if n * n <= 6000}
    load, numbers = {}, {}
    for length, first, count, bin0, offset in packing.plan(lengths, limits, rule):
        for k in range(count):
            load.setdefault(bin0 + k, []).append((offset, length))
            numbers.setdefault(length, []).append(first + k)
    assert {n: sorted(v) for n, v in numbers.items()} == {n: list(range(k)) for n, k in lengths.items()}
    for parts in load.values():
        assert sum(n for _, n in parts) <= 100 and len(parts) <= 4 and sum(n * n for _, n in parts) <= 6000
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
    with pytest.raises(ValueError):
        packing.plan({101: 1}, limits)


def one_by_one(pieces, limits, rule):
    """Each piece, long ones first, to the bin of least score that can take it; equal scores: the first bin."""
    whole, weights, room = limits.room(), np.array(limits.weights), []
    out = []
    for n in pieces:
        need = limits.need(n)
        fits = [(packing.score(r[None], need, whole, weights, rule)[0], b) for b, r in enumerate(room) if (r >= need).all()]
        b = min(fits)[1] if fits else len(room)
        room += [whole] if not fits else []
        room[b] = room[b] - need
        out.append((b, n))
    return sorted(tuple(sorted(n for c, n in out if c == b)) for b in range(len(room)))


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [packing.Limits(60), packing.Limits(60, 3, 1500), packing.Limits(60, 5, None, (1.0, 0.2, 3.0))])
def test_plan_is_best_fit_by_score(rule, limits):
    rng = random.Random(7)
    for _ in range(6):
        lengths = {n: rng.randrange(1, 9) for n in rng.sample(range(1, 39), 12)}
        bins = {}
        for length, _, count, bin0, _ in packing.plan(lengths, limits, rule):
            for k in range(count):
                bins.setdefault(bin0 + k, []).append(length)
        want = one_by_one([n for n in sorted(lengths, reverse=True) for _ in range(lengths[n])], limits, rule)
        assert sorted(tuple(sorted(v)) for v in bins.values()) == want


def test_the_score_decides(monkeypatch):
    """The registered query's limits go through the score, and another score gives another plan."""
    calls, plain = [], packing.score
    monkeypatch.setattr(packing, "score", lambda *a: calls.append(len(a[0])) or plain(*a))
    rng = random.Random(4)
    lengths = {n: rng.randrange(1, 40) for n in range(1, 4097, 7)}
    chosen = packing.plan(lengths)
    assert len(calls) == len(lengths) and max(calls) > 100
    monkeypatch.setattr(packing, "score", lambda *a: -plain(*a))
    assert packing.plan(lengths) != chosen


def test_plan_does_not_grow_with_the_number_of_pieces():
    rng = random.Random(2)
    lengths = {n: rng.randrange(1, 1000) for n in range(1, 4097, 3)}
    one, many = packing.plan(lengths), packing.plan({n: k * 10**6 for n, k in lengths.items()})
    assert len(many) < 3 * len(one)
    for c, p in ((lengths, one), ({n: k * 10**6 for n, k in lengths.items()}, many)):
        total = sum(n * k for n, k in c.items())
        assert max(s[3] + s[2] for s in p) <= -(-total // 4096) * 1.03 + 1
        assert sum(s[0] * s[2] for s in p) == total


def test_caches_start_again(monkeypatch):
    t = packing.CachedTokenizer(queries.tokenizer_path(), most=5)
    monkeypatch.setattr(t, "CHUNK", 12)
    texts = ("one two three four five six seven", "six seven eight nine, ten!", "one two", "", "a\x00b \x00 c", "İx, É. Σ ΑΣ e\u0301, ½ 12 _a\u2003b", "don't''s 're x're\x1d y", "日本語、テスト。" * 5, "x" * 50)
    for text in texts:
        assert t.ids(text).tolist() == t.inner.encode(text, add_special_tokens=False).ids
    for text, ids in zip(texts, t.all_ids(list(texts))):
        assert ids.tolist() == t.inner.encode(text, add_special_tokens=False).ids


def pipeline_docs(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    rows, labels = [], []
    passage = " ".join(word() for _ in range(60))
    question = " ".join(word() for _ in range(15))
    clean = [" ".join(word() for _ in range(120)) for _ in range(60)]
    for i, t in enumerate(clean):
        rows.append((i, t))
    rows += [(100 + i, f"{clean[20 + i]}\n{passage}") for i in range(5)]  # mostly copies
    rows += [(200 + i, " ".join(word() for _ in range(100)) + "\n" + passage) for i in range(4)]
    rows += [(300 + i, " ".join(word() for _ in range(50)) + " " + question + " " + word()) for i in range(4)]
    rows += [(400 + i, " ".join(rng.choice([word(), "vile", "rotten"]) for _ in range(80))) for i in range(40)]
    rows += [(500, clean[0]), (501, clean[1] + " end"), (502, ""), (503, None)]
    labels = [(i, 1, 0) for i in range(40)] + [(400 + i, 1, 1) for i in range(30)]
    return rows, labels, question


def test_pipeline(spark, tmp_path):
    rows, labels, question = pipeline_docs(spark)
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, question), (1, "short")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r["doc_id"]: r for r in now.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
    ids = {k: set(v) for k, v in kept.items()}
    assert not ids["quality classifier"] & set(range(400, 440))
    assert ids["quality classifier"] >= set(range(60)) | set(range(100, 105)) | set(range(200, 204)) | set(range(300, 304))
    lines = kept["line dedup"]
    assert 500 not in lines and lines[200]["text"].count("\n") == 0 and lines[100]["text"].count("\n") == 0
    assert lines[200]["n_chars"] == len(lines[200]["text"])
    near = ids["simhash near-dedup"]
    assert 501 not in near and set(range(60)) <= near
    clean = ids["benchmark decontamination"]
    assert not clean & {300, 301, 302, 303} and set(range(60)) <= clean
    assert ids["best-fit packing"] == clean
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(clean)


def test_registered_queries(spark):
    known = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in known) == list(range(1, 11))
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op5_line_dedup"]).fetchall()
    got = known["op5_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want)
