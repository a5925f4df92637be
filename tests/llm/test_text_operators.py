"""Licenses, classifier, line dedup, language id, decontamination, language model: against plain Python or held-out rows."""

import hashlib
import math
import random
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from pixelmill.llm import decontaminate, gru_lm, language_bits, licenses, line_runs, ordinal

EXTRA = "doc_id long, text string, lang string, r long, hits string, score string"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "z", "q")[:2] + ((r[2] if len(r) > 2 else None), 1, "z", "q") for r in rows], EXTRA)


ODD = [(None, "no id here"), (1, None), (2, ""), (3, " \n\t "), (4, "...!!! ---")]


# --- decontamination ----------------------------------------------------------------------------


def plain_hits(docs, items, size):
    def words(t):
        out, now = [], ""
        for ch in (t or "") + " ":
            if "A" <= ch <= "Z":
                ch = ch.lower()
            if ord(ch) > 127 or ch.isdigit() and ord(ch) < 128 or "a" <= ch <= "z":
                now += ch
            elif now:
                out.append(now)
                now = ""
        return out

    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    rows = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for n in {len(k) for k in windows}:
                if tuple(w[i : i + n]) in windows and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        rows.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination(spark, block_bytes):
    rng = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "Étoile", "x1", "42", "ab", "a"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", ".", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 4, 6, 9]))) for i in range(12)] + [(2, "alpha beta gamma"), (50, None), (None, "x1 42 ab a")]
    docs = [(10 + i, text(rng.choice([3, 20, 200]))) for i in range(40)] + [(d[0], d[1]) for d in ODD] + [(99, text(30_000))]
    docs += [(77, "the alphaX beta"), (77, "the alphaX beta")]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, n_hit int")
    got = decontaminate.contamination(table(spark, docs), bench, size=4, block_bytes=block_bytes).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=repr)
    assert got == plain_hits(docs, [("" if i is None else i, t) for i, t in items], 4)
    clean = decontaminate.clean_documents(table(spark, docs), bench, size=4, block_bytes=block_bytes)
    assert clean.columns == table(spark, []).columns and clean.count() == sum(not r[5] for r in got)


@pytest.mark.parametrize("size,places", [(1, 16), (2, 0), (3, 1), (4, 0), (5, 2), (10, 16), (10, 1)])
def test_scanner_against_plain_windows(size, places):
    """Few words, so that blocks have many places; every way of looking them up gives the same."""
    rng = random.Random(size)
    text = lambda n, k: " ".join(rng.choice("abcd"[:k]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, size - 1, size, 2 * size + 1, 40]), rng.choice([2, 3, 4])).encode()) for i in range(25)]
    s = decontaminate.Scanner(items, size, places)
    docs = [(i, text(rng.randrange(80), rng.choice([2, 4]))) for i in range(60)] + [(100, items[-1][1].decode()), (101, "x " + items[-1][1].decode() + " x")]
    plain = {r[0]: r for r in plain_hits(docs, [(i, t.decode()) for i, t in items], size)}
    for i, t in docs:
        n, hit, found = s.scan(t.encode())
        assert (n, len(hit), len(found)) == plain[i][1:4]
        joined = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert joined == plain[i][4]


def test_very_long_text_and_many_equal_items():
    """A text of a million words, and a thousand items with the same beginning."""
    items = [(i, f"answer the following question by choosing one of these: number {i} or none of all".encode()) for i in range(1000)]
    s = decontaminate.Scanner(items)
    body = b"one two three " * 330_000 + items[7][1] + b" end " + items[7][1][:60]
    began = time.perf_counter()
    n, hit, found = s.scan(body)
    assert time.perf_counter() - began < 20
    assert n == 990_000 + 15 + 1 + 10 and hit[0] == 990_000 and found >= {7}
    assert [body[a:b] for a, b in s.spans(body)][0] == items[7][1]


def test_spans_are_in_the_original():
    s = decontaminate.Scanner([(1, b"Quick, brown FOX")], 3)
    plain = "é! a Quick--brown. fox b, quick\nBROWN (fox".encode()
    assert [plain[a:b] for a, b in s.spans(plain)] == [b"Quick--brown. fox", b"quick\nBROWN (fox"]
    assert s.spans(b"quick brown") == s.spans(b"") == []


def test_empty_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["contaminated"] for r in decontaminate.contamination(table(spark, ODD), none).collect())
    assert decontaminate.contamination(table(spark, []), none).count() == 0


# --- line dedup ---------------------------------------------------------------------------------


def plain_dedup(docs, least):
    """docs in order: texts with all lines gone that lie in a run of ``least`` words or more seen before."""
    seen, gone, solid = set(), [set() for _ in docs], []
    for k, (_, text) in enumerate(docs):
        lines = [] if text is None else text.split("\n")
        solid.append([(i, line) for i, line in enumerate(lines) if line.split()])
    for k, own in enumerate(solid):
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                n += len(own[b][1].split())
                run = tuple(line for _, line in own[a : b + 1])
                if n >= least:
                    if run in seen:
                        gone[k] |= {i for i, _ in own[a : b + 1]}
                    seen.add(run)
    return [None if t is None else "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone[k]) for k, (_, t) in enumerate(docs)]


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 1, 2, 3, 7]))) for _ in range(12)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 25)))) for i in range(40)]
    docs += [(100, docs[3][1]), (101, None), (102, ""), (103, "\n\n"), (104, "\n".join([lines[0]] * 60))]
    got, _, _ = line_runs.without_repeats(table(spark, docs), min_words=8)
    assert [r["text"] for r in sorted(got.collect(), key=lambda r: r["doc_id"])] == plain_dedup(docs, 8)


def test_line_dedup_edges(spark):
    long = " ".join(f"word{i}" for i in range(60))
    docs = [(None, long), (5, long), (5, long), (2, f"first\n{long}\nlast")]
    got, key, count = line_runs.without_repeats(table(spark, docs))
    assert {"doc_id", "text", "lang", "r", "hits", "score", key, count} == set(got.columns)
    texts = [r["text"] for r in got.collect()]
    assert sorted(texts) == ["", "", "", f"first\n{long}\nlast"]
    none, _, _ = line_runs.without_repeats(table(spark, []))
    assert none.count() == 0
    short = [(1, "a b c"), (2, "a b c")]
    same, _, _ = line_runs.without_repeats(table(spark, short))
    assert [r["text"] for r in same.collect()] == ["a b c", "a b c"]


def test_line_dedup_of_a_very_long_text(spark):
    """A document of 100,000 lines that repeat: time in proportion to its lines."""
    one = [f"line number {i % 7} of it" for i in range(100_000)]
    began = time.perf_counter()
    got, _, removed = line_runs.without_repeats(table(spark, [(1, "\n".join(one)), (2, "alone")]))
    kept = {r["doc_id"]: (r["text"], r[removed]) for r in got.collect()}
    assert time.perf_counter() - began < 60
    # the first 10 lines (50 words) are the first copy; a window that begins inside the first seven lines occurs nowhere before
    n = kept[1][0].count("\n") + 1
    assert kept[2] == ("alone", 0) and n == 7 and kept[1][1] == 100_000 - n


@pytest.mark.parametrize("seed", range(2))
def test_maximal_runs(spark, seed):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 5]))) for _ in range(8)] + ["", " "]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 30)))) for i in range(30)]
    got = line_runs.maximal_runs(table(spark, docs), min_words=8).collect()
    found = {}
    for r in got:
        text = docs[r["doc_id"]][1].split("\n")
        solid = [k for k in range(r["first"], r["last"] + 1) if text[k].split()]
        assert r["n_lines"] == len(solid) and solid[0] == r["first"] and solid[-1] == r["last"]
        found.setdefault(r["doc_id"], []).append(solid)
    want = plain_dedup(docs, 8)
    for (i, text), left in zip(docs, want):
        gone = {k for run in found.get(i, []) for k in run}
        assert "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone) == left
        place = {k: n for n, k in enumerate(k for k, x in enumerate(text.split("\n")) if x.split())}
        edges = sorted((place[run[0]], place[run[-1]]) for run in found.get(i, []))
        assert all(b + 1 < c for (_, b), (c, _) in zip(edges, edges[1:]))  # none can be joined with the next


def test_line_dedup_is_native(spark):
    got, _, _ = line_runs.without_repeats(table(spark, [(1, "x")]))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- classifier ---------------------------------------------------------------------------------


def test_ordinal_model(spark):
    rng = random.Random(8)
    vocab = [f"plain{i}" for i in range(200)]

    def doc(grade):
        words = [rng.choice(vocab) for _ in range(rng.randrange(30, 200))]
        for _ in range({0: 8, 1: 8, 2: 0}[grade]):
            words[rng.randrange(len(words))] = rng.choice(["vile", "rotten"]) if grade == 0 else rng.choice(["@@@", "%%%"])
        return " ".join(words)

    grades = [rng.choice([0, 1, 2, 2, 2]) for _ in range(900)]
    docs = table(spark, [(i, doc(g)) for i, g in enumerate(grades)] + ODD[:2])
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i < 700] + [(None, 1), (3, None), (4, 9)], "doc_id long, grade int")
    model = ordinal.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = ordinal.graded(docs, model).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] >= 700]
    right = sum((r["quality_tails"]["selected"]) == (grades[r["doc_id"]] == 2) for r in held)
    assert right / len(held) > 0.9
    mean = [np.mean([r["quality_tails"]["expected"] for r in held if grades[r["doc_id"]] == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert next(r for r in got if r["text"] is None)["quality_tails"]["score"] == 0
    assert ordinal.graded(table(spark, []), model).count() == 0
    blank = ordinal.train(docs, labels.limit(0))
    assert not blank.weights.any()


def plain_score(text, model):
    """The score of a text token by token: sums of weights by a polynomial hash, in Python's own numbers."""
    if not text:
        return 0.0
    full = 1 << 64
    inverse = pow(ordinal.PRIME, -1, full)

    def number(token, salt):
        h = sum((b + 1) * pow(ordinal.PRIME, i, full) for i, b in enumerate(token)) % full
        h = (h + salt * 0xD1B54A32D192ED03) % full
        h ^= h >> 31
        return (h * 0xBF58476D1CE4E5B9 % full) >> (64 - model.bits)

    assert inverse * ordinal.PRIME % full == 1
    tokens = [m.group().lower() for m in regex.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x00-\x20\x7f-\xff]+", text)]
    found, last = [], None
    for token in tokens:
        own = number(token, 0)
        found += [own] + [number(token[:n], k) for k, n in enumerate((4, 6, 8), 1) if len(token) > n]
        if own == last:
            found.append(ordinal.REPEAT >> (64 - model.bits))
        last = own
    return float(sum(float(model.weights[f]) for f in found) / math.sqrt(len(tokens))) if tokens else 0.0


def test_grades_against_plain_python(spark):
    """The whole operator, trained, against a version without arrays; nulls, blanks, repeated rows and ids, long texts."""
    rng = random.Random(21)
    texts = [" ".join(rng.choice(["vile", "Fine", "good", "%%%", "ugly!", "\u00c9t\u00e9", "wonderfully", "a"]) for _ in range(rng.randrange(0, 40))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "another text of the same id"), (900, "good " * 60_000), *ODD]
    labels = spark.createDataFrame([(i, (t.count("vile") == 0) + (t.count("good") > 2)) for i, t in enumerate(texts)] + [(3, 0), (3, 0), (None, 2)], "doc_id long, grade int")
    model = ordinal.train(table(spark, rows), labels)
    got = ordinal.graded(table(spark, rows), model).collect()
    assert len(got) == len(rows)
    for r in got:
        x = r["quality_tails"]
        score = plain_score(None if r["text"] is None else r["text"].encode(), model)
        tails = [1 / (1 + math.exp(c - score)) for c in model.thresholds]
        assert abs(x["score"] - score) < 1e-6 * max(1, abs(score)) and np.allclose(x["tails"], tails, atol=1e-6)
        assert abs(x["expected"] - sum(tails)) < 1e-6 and x["selected"] == (x["tails"][-1] >= 0.5)


def test_features_do_not_depend_on_blocks(monkeypatch):
    text = b" ".join(b"word%d," % i for i in range(3000))
    whole = np.sort(ordinal.features(text, 18)[0])
    monkeypatch.setattr(ordinal, "BLOCK", 4096)
    assert (np.sort(ordinal.features(text, 18)[0]) == whole).all()


# --- language id --------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(6)
    parts = {"aa": ["ka", "ro", "mi", "te"], "bb": ["sch", "ung", "ein", "gel"], "cc": ["éa", "ñu", "ção", "li"], None: ["zz"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 30)))
        rows.append((i, text, lang))
    rows += [(None, "karo mite", "aa"), (1000, None, "aa"), (1001, "12 34!", "bb"), (1002, "", None), (1003, "中文字", "aa"), (1003, "中文字", "aa")]
    got = language_bits.languages(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, _, lang in rows[:600]:
        held = zlib.crc32(str(i).encode()) % 3 == 1
        assert by[i]["held_out"] == held and 0 <= by[i]["score"] <= 1
        if lang:
            assert by[i]["lang_pred"] == lang
        assert by[i]["lang_pred"] in ("aa", "bb", "cc")
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == by[1002]["lang_pred"] == "und"
    assert by[1003]["lang_pred"] in ("aa", "bb", "cc")
    assert language_bits.languages(table(spark, [])).count() == 0
    alone = language_bits.languages(table(spark, [(5, "abc", None)])).collect()
    assert alone[0]["lang_pred"] == "und"


def plain_grams(text):
    """All n-grams of 3 to 5 characters, as strings."""
    x = " "
    for ch in (text or "").replace("\u03a3", "\u03c3").lower() + " ":
        ch = ch if ch.isalpha() else " "
        x += ch if ch != " " or x[-1] != " " else ""
    return [x[i : i + n] for n in (3, 4, 5) for i in range(len(x) - n + 1)]


def test_filters_hold_every_ngram(spark):
    """The registered form: every n-gram learnt is returned, others at about the rate of the fill."""
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    texts = [(" ".join(word("abcdefgh\u00e9") for _ in range(60)), "x") for _ in range(30)] + [(" ".join(word("efghijkl") for _ in range(60)), "y") for _ in range(20)] + [("only here", "z"), (None, "w"), ("12", "v")]
    f = language_bits.learn(table(spark, [(i, t, k) for i, (t, k) in enumerate(texts)]))
    assert f.langs[:3] == ("x", "y", "z") and set(f.langs[3:]) == {"v"}
    sets = {k: {g for t, own in texts if own == k for g in plain_grams(t)} for k in "xyz"}
    for text in (texts[0][0], texts[40][0], "only here", "a", "\u03a3\u03a3 \u0130x", " ".join(word("mnopqrstuvw") for _ in range(3000))):
        own, h = plain_grams(text), language_bits.grams(text)
        assert len(h) == len(own) and len(set(h.tolist())) == len(set(own))
        for k, false, hits in zip(f.langs, f.false, f.hits(h)):
            held = sum(g in sets.get(k, ()) for g in own)
            assert held <= hits <= held + 3 + 3 * false * len(own)
    assert 0 < f.false[0] < 0.03 and f.predict(texts[0][0])[0] == "x" and f.predict("12 !") == ("und", 0.0)
    assert f.predict("\u4e2d\u6587") == ("x", 0.0)  # no filter has any of it: the largest


def test_ngrams_do_not_depend_on_blocks():
    rng = random.Random(4)
    text = "".join(rng.choice("ab \n1\u03a3\u0130\u00c9c") for _ in range(500))
    want = np.sort(language_bits.grams(text))
    for block in (1, 2, 3, 7, 100):
        assert np.array_equal(np.sort(np.concatenate(list(language_bits.blocks(text, block=block)))), want)
    long = "word " * 400_000
    assert sum(map(len, language_bits.blocks(long))) == sum(2_000_001 - n + 1 for n in (3, 4, 5))
    assert max(map(len, language_bits.blocks(long))) <= 3 * (language_bits.BLOCK + 6)


def test_equal_counts_go_to_the_language_with_most(spark):
    rows = [(0, "abc abd", "b"), (2, "abc abd", "a"), (3, "abc xyz uvw", "c"), (3, "abc xyz uvw", "c")]
    f = language_bits.learn(table(spark, rows))
    assert f.langs == ("c", "a", "b") and f.predict("abd")[0] == "a" and f.predict("abc")[0] == "c"


# --- language model -----------------------------------------------------------------------------


def test_scores(spark):
    rng = random.Random(9)
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(left if i % 2 else right) for _ in range(rng.randrange(5, 60)))) for i in range(1000, 1400)] + [(d[0], d[1]) for d in ODD]
    got = gru_lm.scores(table(spark, docs), shape=gru_lm.Shape(8, 64, 16, 8), most=60, one_in=2).collect()
    train = Counter()
    for i, t in docs:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            train.update(gru_lm.tokens_of((t or "").encode()))
    total, distinct = sum(train.values()), len(train)
    want = {}
    for i, t in docs:
        tokens = gru_lm.tokens_of((t or "").encode())
        want[i] = (len(tokens), sum(x in train for x in tokens), sum(math.log10((train[x] + 1) / (total + distinct + 1)) for x in tokens))
    assert len(got) == len(docs)
    for r in got:
        n, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert gru_lm.scores(table(spark, [])).count() == 0


def test_rounds_pass_over_all_training_documents(spark, monkeypatch):
    rng, seen, averaged = random.Random(3), [], gru_lm._averaged
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30)))) for i in range(200)]

    def tallied(found):
        seen.append(found.agg({"n": "sum"}).first()[0])
        return averaged(found)

    monkeypatch.setattr(gru_lm, "_averaged", tallied)
    got = gru_lm.scores(table(spark, docs), shape=gru_lm.Shape(8, 64, 16, 8), most=60).collect()
    assert sum(seen) == got[0]["train_tokens"] == sum(r["n_tokens"] for r in got if not r["held_out"])


def test_network_is_a_distribution():
    shape = gru_lm.Shape(4, 8, 4, 3)
    words = [b"", *(b"w%d" % i for i in range(11))]
    counts = list(range(20, 8, -1))
    mass = [0] * 3
    for w, n in list(zip(words, counts))[8:]:
        mass[zlib.crc32(w[:2]) % 3] += n + 1
    v = gru_lm.Vocabulary(words, counts, sum(counts), len(words), mass, shape)
    v.ready()
    net = gru_lm.Network(v)
    rng = np.random.default_rng(0)
    net.w = {k: x + rng.normal(0, 0.5, x.shape).astype(np.float32) for k, x in net.w.items()}
    h = rng.normal(0, 0.5, (1, 4)).astype(np.float32)
    share = lambda i: math.exp(net.outputs(h, np.array([i]))[0][0])
    assert math.isclose(sum(share(i) for i in range(11)), 1, rel_tol=1e-5)  # 8 words and 3 classes of others


def test_state_is_carried_over_windows():
    v = gru_lm.Vocabulary([b"", b"a", b"b", b"c"], [4, 3, 2, 1], 10, 4, [0] * 3, gru_lm.Shape(4, 8, 4, 3))
    net = gru_lm.Network(v)
    docs = [np.random.default_rng(i).integers(0, 4, n) for i, n in enumerate((1, 5, 40, 100))]
    net.w["c"] += 1
    one = gru_lm.score_documents(net, docs, lanes=1, window=7)
    many = gru_lm.score_documents(net, docs, lanes=4, window=1000)
    assert np.allclose(one, many, rtol=1e-4)


def test_scores_against_a_plain_network():
    """Gates, classes and words one number at a time."""
    shape = gru_lm.Shape(hidden=3, words=6, in_class=3, rare=2)
    net = gru_lm.Network(gru_lm.Vocabulary([b"", b"a", b"b", b"c"], [7, 4, 2, 1], 14, 4, [5, 3], shape))
    rng = np.random.default_rng(9)
    net.w = {k: x + rng.normal(0, 0.4, x.shape).astype(np.float32) for k, x in net.w.items()}
    w, n = {k: x.astype(float).tolist() for k, x in net.w.items()}, 3
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    softmax = lambda row: [math.exp(v) / sum(map(math.exp, row)) for v in row]

    def plain(inputs):
        h, total = [0.0] * n, 0.0
        for i in inputs:
            cls = i // 3 if i < 6 else i - 6 + 2
            total += math.log(softmax([sum(a * b for a, b in zip(row, h)) + c for row, c in zip(w["c"], w["cb"])])[cls])
            if i < 6:
                rows = range(cls * 3, cls * 3 + 3)
                total += math.log(softmax([sum(a * b for a, b in zip(w["o"][r], h)) + w["ob"][r] for r in rows])[i - cls * 3])
            a = [x + g for x, g in zip(w["x"][i], w["g"])]
            u = [sum(h[j] * w["u"][j][k] for j in range(n)) for k in range(3 * n)]
            z, r = ([sigmoid(a[k] + u[k]) for k in range(o, o + n)] for o in (0, n))
            c = [math.tanh(a[2 * n + k] + r[k] * u[2 * n + k]) for k in range(n)]
            h = [z[k] * h[k] + (1 - z[k]) * c[k] for k in range(n)]
        return total

    documents = [rng.integers(0, 8, size) for size in (1, 2, 9, 40, 17)]
    assert np.allclose(gru_lm.score_documents(net, documents, lanes=2, window=5), [plain(d.tolist()) for d in documents], rtol=1e-4)


def test_a_very_long_document_among_short_ones():
    """Memory in proportion to the tokens, the same scores as alone."""
    import tracemalloc

    shape = gru_lm.Shape(hidden=4, words=8, in_class=4, rare=2)
    net = gru_lm.Network(gru_lm.Vocabulary([b"", b"a", b"b"], [9, 5, 2], 16, 3, [3, 3], shape))
    rng = np.random.default_rng(3)
    documents = [rng.integers(0, 10, 10) for _ in range(511)] + [rng.integers(0, 10, 100_000)]
    tracemalloc.start()
    got = gru_lm.score_documents(net, documents)
    assert gru_lm.train_documents(net, {k: np.full_like(x, 1e-3) for k, x in net.w.items()}, documents, 64, 16, 0.0) == 105_110
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
    for k in (0, 300, 511):
        assert abs(gru_lm.score_documents(net, [documents[k]])[0] - got[k]) < 1e-3 * abs(got[k])
    pools = gru_lm.Pools(50)
    full = [p for d in documents if (p := pools.add(d, len(d)))]
    assert sum(map(len, [*full, *pools.rest()])) == 512 and pools.rest() == []


def test_training_windows_are_full(monkeypatch):
    """One long document among short ones leaves no lanes idle; every token is learnt from once, in a document's order."""
    shape = gru_lm.Shape(hidden=4, words=8, in_class=4, rare=2)
    net = gru_lm.Network(gru_lm.Vocabulary([b"", b"a", b"b"], [9, 5, 2], 16, 3, [3, 3], shape))
    rng, seen, plain = np.random.default_rng(4), [], gru_lm.Network.gradients
    documents = [rng.integers(0, 10, n) for n in (*rng.integers(1, 40, 300).tolist(), 60_000, 1, 2_000)]

    def watched(self, h, x, fresh, live, scale):
        seen.append((x.copy(), fresh.copy(), live.copy()))
        return plain(self, h, x, fresh, live, scale)

    monkeypatch.setattr(gru_lm.Network, "gradients", watched)
    tokens = sum(map(len, documents))
    assert gru_lm.train_documents(net, {k: np.full_like(x, 1e-3) for k, x in net.w.items()}, documents, 64, 16, 0.1) == tokens
    assert len(seen) <= -(-tokens // (64 * 16)) + 1
    x, fresh, live = (np.concatenate(a).T.ravel() for a in zip(*seen))
    assert np.array_equal(x[live], np.concatenate(documents))
    assert np.array_equal(np.flatnonzero(fresh[live]), np.cumsum([0, *map(len, documents[:-1])]))


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_tokens_of_arrays_are_those_of_each_text(kind):
    rng = random.Random(1)
    odd = [b"", b" ", None, b" a  b\t\n", b"\x0ba\x0c", b"A\x00 \xff\xfe B", b"\x1c a\x85b \x1f", "\u00c9 x Y\u00a0z".encode(), b"\x00", b"aZ"]
    odd += [bytes(rng.choice(b" \t\nabAB\xc3\xa9\x00\x85\xa0\x1c\x1d") for _ in range(rng.randrange(40))) for _ in range(1000)]
    words = [b"", b"a", b"b", b"ab", "\u00e9".encode(), b"aa"]
    v = gru_lm.Vocabulary(words, [9, 8, 7, 6, 5, 4], 39, 6, [1, 1, 1], gru_lm.Shape(4, 4, 2, 3))
    v.ready()
    for most in (1, 50, 1 << 23):
        got = []
        for edges, tokens in gru_lm.tokens_in(pa.array([b"cut off", *odd], kind)[1:], most):
            plain = tokens.to_pylist()
            got += [plain[a:b] for a, b in zip(edges, edges[1:])]
            places = [words.index(t) if t in words else -1 for t in plain]
            inputs, at = v.encode(tokens)
            assert at.tolist() == places and inputs.tolist() == v.encode(tokens, listed=False)[0].tolist()
            assert inputs.tolist() == [k if 0 <= k < 4 else 4 + zlib.crc32(t[:2]) % 3 for k, t in zip(places, plain)]
        assert got == [gru_lm.tokens_of(t) for t in odd]
    assert list(gru_lm.tokens_in(pa.array([], kind))) == []


def test_a_window_runs_like_its_tokens_one_by_one():
    """States, gates and the state after, with documents that start inside the window."""
    net = gru_lm.Network(gru_lm.Vocabulary([b"", b"a", b"b", b"c"], [4, 3, 2, 1], 10, 4, [1, 2, 3], gru_lm.Shape(4, 8, 4, 3)))
    rng = np.random.default_rng(2)
    w = net.w = {k: x.astype(np.float64) + rng.normal(0, 0.5, x.shape) for k, x in net.w.items()}
    x, fresh, first = rng.integers(0, 11, (6, 5)), rng.random((6, 5)) < 0.2, rng.normal(0, 0.5, (5, 4))
    states, gates, _, after = net.run(first, x, fresh)
    for lane in range(5):
        h = first[lane]
        for t in range(6):
            h = np.zeros(4) if fresh[t, lane] else h
            assert np.allclose(states[t, :, lane], h)
            a, u = w["x"][x[t, lane]] + w["g"], h @ w["u"]
            z, r = (1 / (1 + np.exp(-(a[k : k + 4] + u[k : k + 4]))) for k in (0, 4))
            c = np.tanh(a[8:] + r * u[8:])
            assert np.allclose(gates[t, :, lane], np.concatenate((z, r, c)))
            h = z * h + (1 - z) * c
        assert np.allclose(after[lane], h)


def test_gradients():
    v = gru_lm.Vocabulary([b"", b"a", b"b", b"c"], [4, 3, 2, 1], 10, 4, [1, 2, 3], gru_lm.Shape(4, 8, 4, 3))
    net, rng = gru_lm.Network(v), np.random.default_rng(0)
    net.w = {k: x.astype(np.float64) + rng.normal(0, 0.3, x.shape) for k, x in net.w.items()}
    x, fresh = rng.integers(0, 11, (5, 3)), np.zeros((5, 3), bool)
    fresh[0] = fresh[3, 1] = True
    live = np.ones((5, 3), bool)
    live[4, 2] = False
    loss = lambda: net.gradients(np.zeros((3, 4)), x, fresh, live, 1.0)
    _, grads, _ = loss()
    for k in net.w:
        full = np.zeros_like(net.w[k])
        if k == "x":
            full[grads[k][0]] = grads[k][1]
        else:
            full = grads[k]
        i = np.unravel_index(np.argmax(np.abs(full)), full.shape)
        net.w[k][i] += 1e-3
        high = loss()[0]
        net.w[k][i] -= 2e-3
        low = loss()[0]
        net.w[k][i] += 1e-3
        assert math.isclose((high - low) / 2e-3, full[i], rel_tol=0.02)


# --- licenses -----------------------------------------------------------------------------------


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"]
    docs = [
        (1, "text before\nReleased under the MIT License.\ntext after"),
        (2, f"intro\n\n{mit}\n\nmore"),
        (3, mit.replace("sublicense", "relicense").replace("free of charge", "gratis").upper()),
        (4, "A licensed driver drove away."),
        (5, "This work is licensed under the GNU General Public License, version 2."),
        (6, "This work is licensed under the GNU General Public License, version 9."),
        (7, "x" * 50_000 + "\nAll rights reserved.\n" + "y " * 30_000),
        (8, "é\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        (8, "é\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        *[(d[0], d[1]) for d in ODD],
    ]
    got = licenses.scan(table(spark, docs)).collect()
    found = Counter((r["doc_id"], r["license"]) for r in got)
    assert found == Counter({(1, "MIT-notice"): 1, (2, "MIT"): 1, (3, "MIT"): 1, (5, "GPL-2.0-notice"): 1, (7, "all-rights-reserved"): 1, (8, "Apache-2.0-notice"): 2, (8, "MIT-notice"): 2})
    rows = {(r["doc_id"], r["license"]): r for r in got}
    assert rows[2, "MIT"]["exact"] and not rows[3, "MIT"]["exact"] and rows[3, "MIT"]["edits"] >= 2
    assert all(0 < r["reduction"] < 1 for r in got)
    r = rows[1, "MIT-notice"]
    assert docs[0][1][r["start"] : r["start"] + r["length"]] == "Released under the MIT License."
    for r in got:
        words = dict(docs[:9])[r["doc_id"]][r["words_start"] :][: r["words_length"]]
        assert words == words.strip(".\n") and (not r["exact"] or licenses.words_of(words) == licenses.words_of(licenses.TEMPLATES[r["license"]]))
    assert licenses.scan(table(spark, [])).count() == 0


@pytest.mark.parametrize("width,prefix", [(70, ""), (80, ""), (75, "# "), (75, " * "), (72, "// ")])
def test_wrapped_licenses(spark, width, prefix):
    docs, names = [], sorted(licenses.TEMPLATES)
    for i, k in enumerate(names):
        lines = textwrap.wrap(licenses.TEMPLATES[k], width - len(prefix))
        docs.append((i, "plain words of prose\n" * 90 + "\n".join(prefix + x for x in lines) + "\nmore words of prose" * 90))
    got = licenses.scan(table(spark, docs)).collect()
    assert sorted((r["doc_id"], r["license"], r["exact"]) for r in got) == [(i, k, True) for i, k in enumerate(names)]
    for r in got:
        text = dict(docs)[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert licenses.words_of(text.replace("\n" + prefix, "\n")) == licenses.words_of(licenses.TEMPLATES[r["license"]])


def test_all_licenses_of_a_block(spark):
    names, rng = sorted(licenses.TEMPLATES), random.Random(2)
    notices = [k for k in names if k.endswith("notice") or k == "all-rights-reserved"]
    full = [k for k in names if k not in notices]
    docs = [(i, "\n".join(licenses.TEMPLATES[k] for k in ks)) for i, ks in enumerate((notices, full, names, names[::-1], notices * 2))]
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    docs += [(10 + i, f"{prose(600)} {licenses.TEMPLATES[k]} {prose(600)}") for i, k in enumerate(names)]
    docs.append((50, f"{licenses.TEMPLATES['MIT']} " * 120))  # longer than one window
    got = Counter((r["doc_id"], r["license"]) for r in licenses.scan(table(spark, docs)).collect() if r["exact"])
    want = [(i, k) for i, ks in enumerate((notices, full, names, names[::-1], notices * 2)) for k in ks]
    assert got == Counter(want + [(10 + i, k) for i, k in enumerate(names)] + [(50, "MIT")] * 120)


def test_many_hits_in_a_long_text():
    """Offsets of 2,000 notices in one text of several bytes a character: no work in proportion to hits times text."""
    text = ("\u4e2d\u6587 \u00e9 " * 40 + "\nReleased under the MIT License.\n") * 2000
    raw, m = text.encode(), licenses.Matcher(licenses.TEMPLATES)
    places = [x.start() for x in regex.finditer(rb"Released", raw)]
    began = time.perf_counter()
    at = licenses._characters(raw, places)
    assert time.perf_counter() - began < 2 and all(text[at[p] :].startswith("Released") for p in places[::97])
    assert sum(len(m.matches([raw[a:b].decode().lower() for a, b in ((w.start(), w.end()) for w in licenses.RUN.finditer(raw, s, e))])) for s, e in licenses.blocks(raw, m.reach)) == 2000


def test_differences_against_plain_search():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(0)
    for _ in range(150):
        template = [rng.choice("abcd") for _ in range(rng.randrange(1, 6))]
        block = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
        want = min(edits(template, block[i:j]) for i in range(len(block) + 1) for j in range(i, len(block) + 1))
        got, first, end, _ = licenses.differences(block, template)
        assert got == want == edits(template, block[first:end])
