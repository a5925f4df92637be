"""The whole pipeline against the plain versions of its stages, each on what the plain one before kept."""

import math
import random
import zlib

import numpy as np
from test_simhash_and_sharding import plain_components
from test_text_operators import plain_dedup, plain_hits, plain_score
from tokenizers import Tokenizer

import corpus_pipeline
from pixelmill.llm import ordinal, queries, storage


def corpus():
    rng = random.Random(33)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(3, 9)))
    passage, question, shared = (" ".join(word() for _ in range(n)) for n in (60, 14, 9))
    rows = []
    for i in range(90):
        body = [" ".join(word() for _ in range(rng.choice([3, 25, 60]))) for _ in range(rng.randrange(1, 5))]
        if i % 9 == 0:
            body.insert(rng.randrange(len(body) + 1), passage)
        if i % 11 == 3:
            body[0] += " " + question + " " + word()
        if i % 13 == 5:
            body.append(" ".join([word(), "vile", "rotten"] * 12))
        if i % 7 == 1 and rows:  # near and exact copies
            copy = rows[rng.randrange(len(rows))][1].split(" ")
            for _ in range(rng.choice([0, 1, 3])):
                copy[rng.randrange(len(copy))] = word()
            body = [" ".join(copy)]
        rows.append((i, "\n".join(body)))
    rows += [(200, None), (201, ""), (202, " \n\n"), (203, shared), (203, shared), (204, rows[8][1]), (None, "no id " + question), (None, word())]
    labels = [(i, 1, int("vile" in t)) for i, t in rows[:70]] + [(500, 1, 1), (None, 0, 0), (7, None, None)]
    return rows, labels, [(1, question), (2, "short item"), (3, ""), (None, None)]


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows, labels, bench = corpus()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = ordinal.train(docs, ordinal.ratings(spark.read.parquet(str(tmp_path / "labels.parquet"))))

    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    good = [r for r in rows if 1 / (1 + math.exp(model.thresholds[-1] - plain_score(None if r[1] is None else r[1].encode(), model))) >= 0.5]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0))
    cut = [(i, after) for (i, before), after in zip(good, plain_dedup(good, 50)) if after == before or after.split()]

    def five(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [five(t) for _, t in cut]
    part = plain_components([i for i, _ in cut], lambda a, b: len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]))
    hits = {(r[0], r[1]) for r in plain_hits(cut, bench, 10) if r[5]}  # (id, number of words) of contaminated ones
    one = sorted({p for p in part if p is not None})
    nulls = [t for (i, t), p in zip(cut, part) if p is None]
    near = [next(r for r in cut if r[0] == p) for p in one] + [(None, t) for t in nulls]
    assert len({r[0] for r in cut}) > len(near) > 30

    now, at = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        at[name] = now.collect()
    texts = lambda name: sorted(((r["doc_id"], r["text"]) for r in at[name]), key=key)
    assert texts("quality classifier") == sorted(good, key=key) and len(good) < len(rows)
    assert texts("line dedup") == sorted(cut, key=key) and any(a != b for a, b in zip(sorted(good, key=key), sorted(cut, key=key)))
    assert texts("simhash near-dedup") == sorted(near, key=key)
    counted = {(r[0], r[1]): r[5] for r in plain_hits(near, bench, 10)}
    clean = [r for r in near if not plain_hits([r], bench, 10)[0][5]]
    assert texts("benchmark decontamination") == sorted(clean, key=key) and 0 < len(near) - len(clean) <= len(hits) and any(counted.values())

    plain = Tokenizer.from_file(queries.tokenizer_path())
    plain.encode_special_tokens = True
    want = []
    for i, t in clean:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, b, len(ids[b : b + 4096]), zlib.crc32(np.array(ids[b : b + 4096], "<u4").tobytes())) for k, b in enumerate(range(0, len(ids), 4096))]
    packed = at["best-fit packing"]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed), key=repr) == sorted(want, key=repr)
    ran = corpus_pipeline.run(spark, str(tmp_path))
    fields = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[f] for f in fields) for r in ran.collect()), key=repr) == sorted(want, key=repr)


def test_a_failed_run_leaves_no_tables(spark, tmp_path):
    rows, labels, _ = corpus()
    spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = set(storage._paths(spark))
    try:
        corpus_pipeline.run(spark, str(tmp_path))  # there is no benchmark table
    except Exception as e:
        assert "benchmark" in str(e)
    else:
        raise AssertionError("the missing table was not noticed")
    assert set(storage._paths(spark)) <= before
