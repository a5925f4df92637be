"""Language-model scores: a gated recurrent network with a class-factored softmax, in numpy.

Every word belongs to a class.  Frequent words have classes of their own and a softmax inside;
all others, unseen ones included, fall into classes by their first two bytes, inside which they
follow their counts.  P(word) = P(class | state) P(word | class, state); biases start at the
logarithms of the corpus' counts, so the untrained network is the smoothed unigram model.
Training is truncated backpropagation over windows of all training documents laid end to end in
lanes of equal length; scoring carries the state over windows from a document's first word to its
end.  Texts are split, looked up and counted as Arrow arrays.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import tidy, written

#: The end token's entry in the table of counts; no word is empty.
END = b""
LN10 = math.log(10)


@dataclass(frozen=True)
class Shape:
    hidden: int = 24
    #: Frequent words with an output of their own, the end token among them, and how many share a class.
    words: int = 1024
    in_class: int = 64
    rare: int = 64

    @property
    def classes(self) -> int:
        return -(-self.words // self.in_class) + self.rare


class Vocabulary:
    """Words with known counts, by falling count; totals of the corpus."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, rare_mass: list[int], shape: Shape):
        self.counts, self.total, self.distinct, self.shape = np.array(counts, np.int64), total, distinct, shape
        self.words, self.rare_mass = words, np.array(rare_mass, np.float64)  # sum of count + 1 over a rare class' words
        self.index = None

    def __getstate__(self):
        return self.__dict__ | {"index": None, "frequent": None, "rare_of": None}

    def ready(self) -> None:
        if self.index is None:
            self.index = pa.array(self.words, pa.binary())
            self.frequent = self.index[: self.shape.words]
            first = [bytes(p) for p in np.arange(1 << 16, dtype=">u2").view("S1").reshape(-1, 2).view(np.uint8)]
            self.rare_of = np.array([zlib.crc32(p) % self.shape.rare for p in [*first, *(bytes([k]) for k in range(256)), END]], np.int32)

    def encode(self, tokens: pa.Array, listed: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(input number, place in the list or -1) of binary tokens; places of frequent words alone unless ``listed``."""
        at = pc.fill_null(pc.index_in(tokens, value_set=self.index if listed else self.frequent), -1).to_numpy()
        inputs, rare = at.copy(), np.flatnonzero((at < 0) | (at >= self.shape.words))
        if len(rare):
            inputs[rare] = self.shape.words + self.rare_of[_first_two(tokens)[rare]]
        return inputs, at


def _first_two(tokens: pa.Array) -> np.ndarray:
    """The first two bytes of each token as a number; tokens of one byte, then the empty one, come after all of two."""
    edges = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    starts, sizes = edges[:-1], np.diff(edges)
    data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)[: edges[-1]]
    data = np.concatenate((data, np.zeros(2, np.uint8)))
    first = data[starts].astype(np.int32)
    return np.where(sizes > 1, first << 8 | data[starts + 1], np.where(sizes == 1, first + (1 << 16), (1 << 16) + 256))


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased, and one end."""
    parts = text.lower().split() if text else []
    parts.append(END)
    return parts


def tokens_in(texts: pa.Array, most: int = 1 << 23) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """What ``tokens_of`` gives for each text of a binary array, some ``most`` bytes at a time: (edges, tokens); text i has tokens edges[i] to edges[i + 1]."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    large = pa.types.is_large_binary(texts.type)  # a cast of slices of these gives wrong bytes (pyarrow 23), one of copies doesn't
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        # ASCII functions don't look at other bytes, so these needn't be UTF-8; the space makes the end, an empty token
        some = pc.fill_null(texts.take(pa.array(range(a, b))).cast(pa.binary()) if large else texts[a:b], b"").view(pa.string())
        some = pc.ascii_trim_whitespace(pc.ascii_lower(some))
        some = pc.if_else(pc.equal(pc.binary_length(some), 0), some, pc.binary_join_element_wise(some, "", " "))
        lists = pc.ascii_split_whitespace(some)
        yield lists.offsets.to_numpy(), lists.values.view(pa.binary())


def _log_share(logit: np.ndarray, rows: np.ndarray, own: np.ndarray):
    """(log of the softmax at ``own``, row sums of the exponentials); ``logit`` becomes the exponentials."""
    if len(logit) and (top := logit.max()) > 60:  # biases are logarithms of shares, so this is rare
        logit -= np.maximum(logit.max(axis=1, keepdims=True), top - 60)
    picked = logit[rows, own]
    np.exp(logit, out=logit)
    total = logit @ np.ones(logit.shape[1], logit.dtype)
    return picked - np.log(np.maximum(total, np.float32(1e-37))), total


def _to_softmax_loss(e: np.ndarray, total: np.ndarray, rows: np.ndarray, own: np.ndarray, scale) -> np.ndarray:
    """``e``, the exponentials, made d loss / d logits in place."""
    e *= (scale / total)[:, None]
    e[rows, own] -= scale
    return e


class Network:
    """Weights by name; inputs are rows of ``x``."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 5):
        s, r = vocabulary.shape, np.random.default_rng(seed)
        own = np.zeros(s.words)
        own[: min(s.words, len(vocabulary.counts))] = vocabulary.counts[: s.words]
        by_class = (own + 1).reshape(-1, s.in_class)
        mass = np.concatenate((by_class.sum(axis=1), vocabulary.rare_mass + 1))
        self.w = {
            "x": r.normal(0, 0.1, (s.words + s.rare, 3 * s.hidden)),
            "u": r.normal(0, 1 / math.sqrt(s.hidden), (s.hidden, 3 * s.hidden)),
            "g": np.concatenate((np.full(s.hidden, 1.0), np.zeros(2 * s.hidden))),
            "c": np.zeros((s.classes, s.hidden)),
            "cb": np.log(mass / mass.sum()),
            "o": np.zeros((s.words, s.hidden)),
            "ob": np.log(by_class / by_class.sum(axis=1, keepdims=True)).ravel(),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.shape = s

    def classes_of(self, inputs: np.ndarray) -> np.ndarray:
        s = self.shape
        return np.where(inputs < s.words, inputs // s.in_class, inputs - s.words + s.words // s.in_class)

    def table(self) -> np.ndarray:
        """Each input's part of the gates with the biases; halved for z and r, since a sigmoid is half the tanh of the half, plus a half."""
        made = self.w["x"] + self.w["g"]
        made[:, : 2 * self.shape.hidden] *= 0.5
        return made

    def run(self, h: np.ndarray, inputs: np.ndarray, fresh: np.ndarray, table: np.ndarray | None = None):
        """(states before each token, gates z, r and c, recurrent parts, state after) of a window; arrays of (time, hidden, lane).

        ``h`` is (lane, hidden), inputs and fresh are (time, lane).  Lanes come last so that each gate's numbers lie together.
        """
        w, n, (steps, lanes) = self.w, self.shape.hidden, inputs.shape
        table = self.table() if table is None else table
        gates = np.ascontiguousarray(table.take(inputs, axis=0).transpose(0, 2, 1))
        kind, u = gates.dtype, np.ascontiguousarray(w["u"].T)
        u[: 2 * n] *= 0.5
        states, parts = np.empty((steps + 1, n, lanes), kind), np.empty((steps, 3 * n, lanes), kind)
        states[0] = h.T
        starts, mid, inner = fresh.any(axis=1).tolist(), kind.type(0.5), np.empty((n, lanes), kind)
        for t, (h, after, gate, part) in enumerate(zip(states, states[1:], gates, parts)):
            if starts[t]:
                h *= ~fresh[t]
            zr, c = gate[: 2 * n], gate[2 * n :]
            np.matmul(u, h, out=part)
            zr += part[: 2 * n]
            np.tanh(zr, out=zr)
            zr *= mid
            zr += mid
            np.multiply(zr[n:], part[2 * n :], out=inner)
            c += inner
            np.tanh(c, out=c)
            np.subtract(h, c, out=after)
            after *= zr[:n]
            after += c
        return states[:-1], gates, parts[:, 2 * n :], states[-1].T

    def outputs(self, states: np.ndarray, inputs: np.ndarray, grads: dict | None = None, scale: float = 1.0):
        """Natural log of P(token) of each row (in a rare class: of the class); with ``grads`` also d loss / d states."""
        w, s, n = self.w, self.shape, self.shape.hidden
        cls = self.classes_of(inputs)
        rows = np.arange(len(states))
        # a column of ones brings the biases and their gradients into the products
        own = np.concatenate((states, np.ones((len(states), 1), states.dtype)), axis=1)
        logit = own @ np.concatenate((w["c"], w["cb"][:, None]), axis=1).T
        out, total = _log_share(logit, rows, cls)
        back = None
        if grads is not None:
            d = _to_softmax_loss(logit, total, rows, cls, scale)
            made = (own.T @ d).T
            grads["c"], grads["cb"] = made[:, :n], made[:, n]
            back = d @ w["c"]
        frequent = np.flatnonzero(inputs < s.words)
        frequent = frequent[np.argsort(cls[frequent].astype(np.min_scalar_type(s.classes)), kind="stable")]
        edges = np.searchsorted(cls[frequent], np.arange(s.words // s.in_class + 1)).tolist()
        blocks = [(a, b, slice(k * s.in_class, (k + 1) * s.in_class)) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        own, word, rows = own[frequent], inputs[frequent] % s.in_class, rows[: len(frequent)]
        heads = np.concatenate((w["o"], w["ob"][:, None]), axis=1)
        logit = np.empty((len(frequent), s.in_class), own.dtype)
        for a, b, block in blocks:
            np.matmul(own[a:b], heads[block].T, out=logit[a:b])
        share, total = _log_share(logit, rows, word)
        out[frequent] += share
        if grads is not None:
            d = _to_softmax_loss(logit, total, rows, word, scale)
            made, more = np.zeros_like(heads), np.empty((len(frequent), n), own.dtype)
            for a, b, block in blocks:
                np.matmul(d[a:b].T, own[a:b], out=made[block])
                np.matmul(d[a:b], w["o"][block], out=more[a:b])
            grads["o"], grads["ob"] = made[:, :n], made[:, n]
            back[frequent] += more
        return out, back

    def gradients(self, h: np.ndarray, inputs: np.ndarray, fresh: np.ndarray, live: np.ndarray, scale: float):
        """(loss, gradients, state after) of a window; arrays of (time, lane). fresh: a document starts here."""
        w, n, (steps, lanes) = self.w, self.shape.hidden, inputs.shape
        states, gates, parts, h = self.run(h, inputs, fresh)
        grads: dict = {}
        kind, names, flat = gates.dtype, inputs.ravel(), np.flatnonzero(live.ravel())
        by_row = states.transpose(0, 2, 1).reshape(-1, n)
        # scale is that of a full window: one that few lanes still fill weighs as little
        ll, back = self.outputs(by_row[flat], names[flat], grads, kind.type(scale))
        if len(flat) < len(names):
            d_states = np.zeros((steps * lanes, n), kind)
            d_states[flat] = back
            back = d_states
        d_states = np.ascontiguousarray(back.reshape(steps, lanes, n).transpose(0, 2, 1))
        # each derivative is a factor known beforehand times that of the state after the token: by the sums
        # inside c, z and r, and by c's recurrent part; what u made lies together, what x made, too
        z, r, c, rest = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], 1 - gates[:, :n]
        d = np.empty((steps, 4, n, lanes), kind)
        by_c, by_z, by_r, by_part = d.transpose(1, 0, 2, 3)
        np.multiply(c, c, out=by_c)
        np.subtract(1, by_c, out=by_c)
        by_c *= rest
        np.subtract(states, c, out=by_z)
        by_z *= z
        by_z *= rest
        np.multiply(by_c, r, out=by_part)
        np.subtract(1, r, out=by_r)
        by_r *= parts
        by_r *= by_part
        dh, through, starts = np.zeros((n, lanes), kind), np.empty((n, lanes), kind), fresh.any(axis=1).tolist()
        d_all = d.reshape(steps, 4 * n, lanes)
        for t, own, recurrent, kept, more in zip(range(steps - 1, -1, -1), d[::-1], d_all[::-1, n:], z[::-1], d_states[::-1]):
            own *= dh
            dh *= kept
            dh += np.matmul(w["u"], recurrent, out=through)
            dh += more
            if starts[t]:
                dh *= ~fresh[t]
        rows = d_all.transpose(0, 2, 1).reshape(-1, 4 * n)
        grads["u"] = by_row.T @ rows[:, n:]
        order = np.argsort(names.astype(np.min_scalar_type(len(w["x"]))), kind="stable")
        names = names[order]
        heads = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1))
        # summed two by two, as parts of complex numbers: half as many additions
        pairs = rows.take(order, axis=0).view(np.result_type(kind, np.complex64))[:, : (3 * n + 1) // 2]
        made = np.add.reduceat(pairs, heads, axis=0).view(kind)
        made = np.concatenate((made[:, n : 3 * n], made[:, :n]), axis=1)
        grads["x"], grads["g"] = (names[heads], made), made.sum(axis=0)
        return -float(ll.sum()), grads, h

    def learn(self, grads: dict, sums: dict, rate: float) -> None:
        """One Adagrad step."""
        for k, g in grads.items():
            rows, g = g if k == "x" else (slice(None), g)
            some = sums[k][rows]
            some += g * g
            if k == "x":
                sums[k][rows] = some
            step = np.sqrt(some + 1e-8)
            np.divide(g, step, out=step)
            step *= 0.1 * rate if k in ("cb", "ob") else rate  # biases start where the counts put them
            self.w[k][rows] -= step

    def packed(self) -> bytes:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)]).astype("<f4").tobytes()

    def unpack(self, data: bytes) -> None:
        flat, at = np.frombuffer(data, "<f4"), 0
        for k in sorted(self.w):
            n = self.w[k].size
            self.w[k] = flat[at : at + n].reshape(self.w[k].shape).copy()
            at += n


def streams(documents: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole documents end to end in lanes, longest lane first: (input, document or -1, starts) of (time, lane)."""
    load, lists = [0] * lanes, [[] for _ in range(lanes)]
    heap = [(0, k) for k in range(lanes)]
    for i in sorted(range(len(documents)), key=lambda i: -len(documents[i])):
        n, k = heapq.heappop(heap)
        lists[k].append(i)
        load[k] = n + len(documents[i])
        heapq.heappush(heap, (load[k], k))
    lists, steps = [lists[k] for k in sorted(range(lanes), key=lambda k: -load[k])], max(load)
    x, who, fresh = np.zeros((lanes, steps), np.int64), np.full((lanes, steps), -1, np.int64), np.zeros((lanes, steps), bool)
    for k, own in enumerate(lists):
        at = 0
        for i in own:
            n = len(documents[i])
            x[k, at : at + n], who[k, at : at + n], fresh[k, at] = documents[i], i, True
            at += n
    return x.T.copy(), who.T.copy(), fresh.T.copy()


class Pools:
    """Documents kept by length until a pool holds ``enough`` tokens, so that those that run in step end together."""

    def __init__(self, enough: int, lanes: int = 1, most: int = 1 << 21):
        self.enough, self.lanes, self.most, self.held, self.sizes = enough, lanes, most, {}, Counter()

    def add(self, item, size: int) -> list | None:
        """The whole pool if it is full now."""
        pool = size.bit_length()
        self.held.setdefault(pool, []).append(item)
        self.sizes[pool] += size
        if self.sizes[pool] <= min(self.most, max(self.enough, self.lanes << pool - 1)):
            return None
        self.sizes.pop(pool)
        return self.held.pop(pool)

    def rest(self) -> list[list]:
        out = list(self.held.values())
        self.held, self.sizes = {}, Counter()
        return out


def score_documents(net: Network, documents: list[np.ndarray], lanes: int = 512, window: int = 16) -> np.ndarray:
    """Sum of natural log probabilities (of the class alone in rare classes) for each whole document."""
    out = np.zeros(len(documents))
    if not documents:
        return out
    sizes = [len(d) for d in documents]
    lanes = max(1, min(lanes, len(documents), 4 * sum(sizes) // max(sizes)))  # lanes are as long as the longest document
    x, who, fresh = streams(documents, lanes)
    h, table, a = np.zeros((lanes, net.shape.hidden), np.float32), net.table(), 0
    while a < len(x):
        busy = int((who[a] >= 0).sum())  # lanes that have ended are the last ones
        b = min(len(x), a + max(window, 8192 // busy))
        states, _, _, h = net.run(h[:busy], x[a:b, :busy], fresh[a:b, :busy], table)
        owner = who[a:b, :busy].ravel()
        live = np.flatnonzero(owner >= 0)
        ll, _ = net.outputs(states.transpose(0, 2, 1).reshape(-1, net.shape.hidden)[live], x[a:b, :busy].ravel()[live])
        out += np.bincount(owner[live], ll.astype(np.float64), len(documents))
        a = b
    return out


def train_documents(net: Network, sums: dict, documents: list[np.ndarray], lanes: int, window: int, rate: float) -> int:
    """Truncated backpropagation over all windows of the documents laid end to end in equal lanes; the state is carried on. Returns tokens.

    A document that crosses the end of its lane goes on at the start of the next from no state, so that every window but the last is full.
    """
    if not documents:
        return 0
    flat, starts = np.concatenate(documents), np.cumsum([0, *map(len, documents[:-1])])
    n = len(flat)
    lanes = max(1, min(lanes, n // (16 * window)))  # a lane has 16 windows at least: few documents cross, few tokens still make some steps
    steps = -(-n // lanes)
    x, fresh = np.zeros(lanes * steps, np.int64), np.zeros(lanes * steps, bool)
    x[:n], fresh[starts] = flat, True
    x, fresh, live = (a.reshape(lanes, steps).T.copy() for a in (x, fresh, np.arange(lanes * steps) < n))
    h = np.zeros((lanes, net.shape.hidden), np.float32)
    for a in range(0, steps, window):
        b = a + window
        _, grads, h = net.gradients(h, x[a:b], fresh[a:b], live[a:b], 1 / (window * lanes))
        net.learn(grads, sums, rate)
    return n


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text mod ``folds`` is ``fold`` (null id: as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word binary, n long) of all tokens of all texts given, summed over some four million tokens of a task first."""

    def tally(batches):
        held: list[pa.Array] = []

        def out():
            words, counts = pc.value_counts(pa.chunked_array(held, pa.binary())).flatten()
            held.clear()
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([words[at : at + 50_000], counts[at : at + 50_000]], names=["word", "n"])

        for b in batches:
            for _, tokens in tokens_in(b.column(0)):
                held.append(tokens)
                if sum(map(len, held)) > 4_000_000:
                    yield from out()
        yield from out()

    return docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(tally, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, shape: Shape, most: int = 1 << 18) -> tuple[Vocabulary, int]:
    """The words with at least so many tokens that ``most`` words or fewer have them, and that number."""
    hist = sorted(((r[0], r[1]) for r in counts.groupBy("n").agg(F.count("*")).collect()), reverse=True)  # distinct counts: about the root of the tokens
    total, distinct = sum(n * k for n, k in hist), sum(k for _, k in hist)
    least, got = (hist[0][0] + 1 if hist else 1), 0
    for n, k in hist:
        if got + k > most:
            break
        least, got = n, got + k
    top = sorted(((bytes(r[0]), r[1]) for r in counts.where(F.col("n") >= least).collect()), key=lambda r: (-r[1], r[0]))  # ``most`` rows at most
    prefix = F.crc32(F.substring("word", 1, 2)) % shape.rare
    mass = [0] * shape.rare
    for r in counts.groupBy(prefix.alias("p")).agg(F.sum(F.col("n") + 1)).collect():
        mass[r[0]] = r[1]
    for w, n in top[: shape.words]:
        mass[zlib.crc32(w[:2]) % shape.rare] -= n + 1
    return Vocabulary([w for w, _ in top], [n for _, n in top], total, distinct, mass, shape), least


@tidy
def _averaged(found: DataFrame, fan: int = 16) -> bytes | None:
    """The mean of packed weights, weighted by tokens, over rounds of groups of ``fan``."""

    def mean(table: pa.Table) -> pa.Table:
        total, weight = None, 0
        for w, n in zip(table["w"], table["n"].to_pylist()):
            x = np.frombuffer(w.as_py(), "<f4").astype(np.float64) * n
            total, weight = x if total is None else total + x, weight + n
        return pa.table({"part": pa.array([table["part"][0].as_py() // fan], pa.int64()), "n": pa.array([weight], pa.int64()), "w": pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())})

    found = written(found, "weights")
    while found.count() > fan:
        found = written(found.groupBy(F.floor(F.col("part") / fan)).applyInArrow(lambda t: mean(t), "part long, n long, w binary"), "weights")
    rows = found.collect()  # ``fan`` rows at most
    total = sum(r["n"] for r in rows)
    return sum(np.frombuffer(r["w"], "<f4").astype(np.float64) * (r["n"] / total) for r in rows).astype("<f4").tobytes() if total else None


def train(docs: DataFrame, vocab: Vocabulary, doc_id: str, text: str, rounds: int = 2, one_in: int | None = None, lanes: int = 64, window: int = 16, rate: float = 0.1, task_tokens: int = 400_000) -> Network:
    """Rounds of local descent: each task trains from the shared weights on its documents, the means are shared.

    Round k takes the documents whose hash mod ``one_in`` (``rounds`` if None) is k, so the rounds
    together pass over all of them; tasks get about ``task_tokens`` tokens each, so they don't grow.  After a round
    the whole step, half of it or none is taken, whichever scores one in 64 of the documents best
    that the round left out (all of these if the slice has none, and the round's own if it took all).
    """
    net, spark, one_in = Network(vocab), docs.sparkSession, one_in or rounds
    words = spark.sparkContext.broadcast(vocab)  # a bounded list of words
    for k in range(rounds):
        start = spark.sparkContext.broadcast(net.packed())

        def local(batches, start=start):
            v = words.value
            v.ready()
            own = Network(v)
            own.unpack(start.value)
            sums = {key: np.full_like(x, 1e-3) for key, x in own.w.items()}
            held, size, n = [], 0, 0
            for b in batches:
                for edges, tokens in tokens_in(b.column(0)):
                    for x in np.split(v.encode(tokens, listed=False)[0], edges[1:-1]):
                        held.append(x)
                        size += len(x)
                        if size > 100_000:
                            n += train_documents(own, sums, held, lanes, window, rate)
                            held, size = [], 0
            n += train_documents(own, sums, held, lanes, window, rate)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([own.packed()], pa.binary())], names=["part", "n", "w"])

        mine = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(one_in)) == k
        some = docs.where(mine).select(F.col(text).cast("binary").alias("t"))
        some = some.repartition(1 + vocab.total // (one_in * task_tokens))
        data = _averaged(some.mapInArrow(local, "part long, n long, w binary"))
        if not data:
            continue
        old, new = (np.frombuffer(d, "<f4") for d in (net.packed(), data))
        steps = [old.tobytes(), ((old + new) / 2).astype("<f4").tobytes(), data]
        slice_ = F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(k)), F.lit(64)) == 0
        for rated in (docs.where(~mine & slice_), docs.where(~mine), docs):
            if (best := _best(rated, text, words, steps, 1 + vocab.total // (64 * task_tokens))) is not None:
                break
        net.unpack(steps[best])
    return net


def _best(docs: DataFrame, text: str, words, candidates: list[bytes], tasks: int) -> int | None:
    """The packed weights under which the documents, dealt to so many tasks, are the most probable; None without documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(candidates)

    def rate(batches):
        v = words.value
        v.ready()
        nets, sums, pools, some = [], [0.0] * len(shipped.value), Pools(200_000), False
        for data in shipped.value:
            nets.append(Network(v))
            nets[-1].unpack(data)
        for b in batches:
            for edges, tokens in tokens_in(b.column(0)):
                some = True
                for x in np.split(v.encode(tokens, listed=False)[0], edges[1:-1]):
                    if full := pools.add(x, len(x)):
                        sums = [s + score_documents(n, full).sum() for s, n in zip(sums, nets)]
        for left in pools.rest():
            sums = [s + score_documents(n, left).sum() for s, n in zip(sums, nets)]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["k", "s"])

    some = docs.select(F.col(text).cast("binary").alias("t")).repartition(tasks)  # few: running in step, documents cost less together
    rows = some.mapInArrow(rate, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    return -max((r["s"], -r["k"]) for r in rows)[1] if rows else None


@tidy
def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shape: Shape = Shape(), most: int = 1 << 18, rounds: int = 2, one_in: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words and one end; a null or empty text is the end alone.  base_score: sum of
    log10((c + 1) / (N + V + 1)), c the token's count in training texts, N all, V distinct ones.
    score: the network's log10 probability of the whole text.  Words under the list's least count
    get theirs by a join, so that no task holds the whole vocabulary.  Documents run in step with
    those of about their length; a very long one is one stream, whose memory is in proportion to
    its tokens.  Repeated rows each come back; without training texts every token is unseen.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("binary").alias("t"))
    counts = written(word_counts(rows.where(~F.col("held_out")), "t"), "counts")
    vocab, least = vocabulary(counts, shape, most)
    net = train(rows.where(~F.col("held_out")), vocab, "doc_id", "t", rounds, one_in)
    spark = docs.sparkSession
    words, weights = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(net.packed())
    kind = rows.schema["doc_id"].dataType.simpleString()

    def rate(batches):
        v = words.value
        v.ready()
        own = Network(v)
        own.unpack(weights.value)
        counts1 = np.log10(v.counts + 1.0) if len(v.counts) else np.zeros(1)
        floor = math.log10(v.total + v.distinct + 1)
        rare_floor = np.log10(v.rare_mass + 1)
        key = TaskContext.get().partitionId() << 33
        pools = Pools(500_000)

        def out(waiting):
            nonlocal key
            docs, helds, xs, knowns, bases, listeds, losts = zip(*waiting)
            n = len(waiting)
            tails = [Counter(t) for t in losts]
            offsets = np.concatenate(([0], np.cumsum([len(c) for c in tails])))
            tail = pa.StructArray.from_arrays([pa.array([x for c in tails for x in c], pa.binary()), pa.array([x for c in tails for x in c.values()], pa.int64())], names=["word", "k"])
            score = score_documents(own, list(xs)) / LN10 + np.array(listeds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(key, key + n)), pa.array(docs, kinds[0]), pa.array(helds, pa.bool_()), pa.array([len(x) for x in xs], pa.int64()), pa.array(knowns, pa.int64()), pa.array(bases, pa.float64()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tail)],
                names=["r", "doc_id", "held_out", "n_tokens", "known", "base", "score", "tail"],
            )
            key += n

        kinds = None
        for b in batches:
            kinds = kinds or b.schema.types
            docs = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            for edges, tokens in tokens_in(b.column(2)):
                x, at = v.encode(tokens)
                rare, missing, firsts = x >= shape.words, np.flatnonzero(at < 0), edges[:-1]
                logs = np.where(at >= 0, counts1[at], 0.0)
                known, base = np.add.reduceat(at >= 0, firsts, dtype=np.int64), np.add.reduceat(logs, firsts) - np.diff(edges) * floor
                logs[~rare] = 0  # from here a rare word's share of its class, as far as its count is listed
                logs[rare] -= rare_floor[x[rare] - shape.words]
                inside = np.add.reduceat(logs, firsts).tolist()
                lost, bounds = tokens.take(pa.array(missing)).to_pylist(), np.searchsorted(missing, edges).tolist()
                edges = edges.tolist()
                for a, z, p, q, *sums, (i, held) in zip(edges, edges[1:], bounds, bounds[1:], known.tolist(), base.tolist(), inside, docs):  # docs last: zip takes none too many
                    if full := pools.add((i, held, x[a:z].copy(), *sums, lost[p:q]), z - a):
                        yield from out(full)
        for left in pools.rest():
            yield from out(left)

    made = rows.mapInArrow(rate, f"r long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, tail array<struct<word: binary, k: long>>")
    made = written(made, "scored")
    tail = made.select("r", F.explode("tail").alias("x")).select("r", "x.word", "x.k")
    rest = counts.where(F.col("n") < least).select(F.col("word").alias("w2"), "n")
    found = tail.join(rest, F.col("word") == F.col("w2")).groupBy("r").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("logs"))
    found = found.withColumnRenamed("r", "r2")
    out = made.drop("tail").join(found, F.col("r") == F.col("r2"), "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
