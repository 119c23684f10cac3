"""Gated recurrent language model: log-likelihood of whole documents.

Counts.  One pass counts the tokens of all training documents (a shuffle that grows with the vocabulary).  The most
frequent words, at most ``HEAD`` of them, are sent to every task; the others meet their counts in a join.

Output units.  The end of a text and the ``OWN`` most frequent words have a unit of their own; the other words share
units by their ending, head words and rare or unseen words apart.  The softmax is factored: the probability of a
token is that of its class of units, times that of its unit within the class, both from the recurrent state, times
the smoothed share of the word within its unit, from the counts: ``(c + 1) / (N_unit + V_unit + 1)``.  These sum to 1
over the known words and one unseen word per shared unit.

Network.  A gated recurrent cell in numpy, trained by backpropagation through windows of ``WINDOW`` tokens, state
carried from window to window and reset at the end of a text.  It starts from a fit on a bounded sample
of training documents (``SAMPLE``); then every task refines it over all its training documents, and the refined
weights are averaged by tokens (partial sums first).  Scoring carries the state through each whole document, however
long.  The weights depend on how the input is split into tasks and on the order of floating sums; counts and base
scores do not.

Words are told apart by 64-bit hashes.  Defined cases: a null or empty text is its end alone; a null doc_id counts as the empty
string (it is a training row); repeated rows are scored each, and count each in training; without training
documents all counts are 0; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recengine.llm.common import slices, texts, word_codes_and_endings
from recengine.session import written

UNITS, CLASSES, HIDDEN = 256, 16, 16
PER = UNITS // CLASSES
END, OWN, SHARED, RARE = 0, 191, 48, 16        # units: end, own words, endings of head words, endings of the others
HEAD = 1 << 18
WINDOW, STREAMS, TOGETHER, RATE = 16, 256, 1024, 0.1
SAMPLE, SAMPLE_PASSES = 2000, 4
END_CODE = np.uint64(0x5851F42D4C957F2D)
HELD_CODES = 1_500_000
BIN, TWICE = "cast(floor(8 * log2(n)) as int)", 8
SLICE = 32 << 20


# ---- tokens and counts

def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and endings of the tokens of a batch's texts (column 0), one text after the other, and tokens per text."""
    codes, endings, n = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], []
    end, none = np.full(1, END_CODE), np.zeros(1, np.int32)
    for raw in batch.column(0).cast(pa.binary()).to_pylist():
        code, ending = word_codes_and_endings(raw)
        codes += [code, end]
        endings += [ending, none]
        n.append(len(code) + 1)
    return np.concatenate(codes), np.concatenate(endings), np.array(n, np.int64)


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, endings, counts = (np.concatenate(x) for x in zip(*parts))
    unique, first, which = np.unique(codes, return_index=True, return_inverse=True)
    return unique, endings[first], np.bincount(which, counts, len(unique)).astype(np.int64)


def token_counts(training: DataFrame) -> DataFrame:
    """code, ending, n of all tokens of the training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2])], ["code", "ending", "n"])

        held, size = [], 0
        for batch in slices(batches, SLICE):
            codes, endings, _ = _tokens(batch)
            unique, first, n = np.unique(codes, return_index=True, return_counts=True)
            held.append((unique, endings[first], n))
            size += len(unique)
            if size > HELD_CODES:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > HELD_CODES // 2:
                    yield out(held[0])
                    held, size = [], 0
        if held:
            yield out(_merged(held))

    return (training.select("text").mapInArrow(run, "code long, ending int, n long")
            .groupBy("code").agg(F.max("ending").alias("ending"), F.sum("n").alias("n")))


@dataclass
class Vocabulary:
    """What every task knows of the corpus: at most ``HEAD`` words, and sums per unit."""
    total: int                # N: training tokens
    distinct: int             # V
    lowest: int               # bin of the counts from which words are in the head
    codes: np.ndarray         # head, ascending
    units: np.ndarray
    logs: np.ndarray          # log10(c + 1)
    within: np.ndarray        # per unit log10(N_unit + V_unit + 1); 0 for an own unit
    mass: np.ndarray          # tokens per unit

    def of(self, codes: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit, log10(c + 1) (0 outside the head) and whether in the head."""
        if not len(self.codes):
            known, at = np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
            units, logs = np.zeros(len(codes), np.uint8), np.zeros(len(codes))
        else:
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            known = self.codes[at] == codes
            units, logs = self.units[at], np.where(known, self.logs[at], 0.0)
        units = np.where(known, units, UNITS - RARE + endings % RARE).astype(np.uint8)
        units[codes == END_CODE] = END
        return units, logs, known


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """From the counts: the bins of the counts (at most 504 rows) give the head's threshold, the head is collected (at most
    ``head`` rows), the others are summed by ending (16 rows)."""
    bins = counts.groupBy(F.expr(BIN).alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
    lowest, room = 1 << 30, head
    for row in sorted(bins, key=lambda r: -r.bin):
        room -= row.words
        # words that stand once are never in the head: what their units get is what unseen words get
        if room < 0 or row.bin < TWICE:
            break
        lowest = row.bin
    top = counts.where(F.expr(BIN) >= lowest).select("code", "ending", "n").toArrow()
    codes, endings, n = top.column("code").to_numpy().view(np.uint64), top.column("ending").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(codes)
    codes, endings, n = codes[order], endings[order], n[order]
    units = (1 + OWN + endings % SHARED).astype(np.int64)
    frequent = np.lexsort((codes, -n))
    frequent = frequent[codes[frequent] != END_CODE][:OWN]
    units[frequent] = 1 + np.arange(len(frequent))
    units[codes == END_CODE] = END
    mass, kinds = np.bincount(units, n, UNITS), np.bincount(units, minlength=UNITS).astype(float)
    rare = counts.where(F.expr(BIN) < lowest).groupBy((F.col("ending") % RARE).alias("e")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
    for row in rare.collect():
        mass[UNITS - RARE + row.e] += row.n
        kinds[UNITS - RARE + row.e] += row.words
    within = np.where(np.arange(UNITS) <= OWN, 0.0, np.log10(mass + kinds + 1))
    return Vocabulary(int(sum(r.n for r in bins)), int(sum(r.words for r in bins)), lowest, codes, units.astype(np.uint8), np.log10(n + 1.0), within, mass)


# ---- the network

def _sigmoid(a: np.ndarray) -> None:
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1
    np.reciprocal(a, out=a)


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Over axis 0, in place; at least 1e-30."""
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return np.maximum(logits, 1e-30, out=logits)


class Network:
    """Weights in one flat array, with views of it; ``squares`` are Adagrad's sums."""

    def __init__(self, mass: np.ndarray, hidden: int = HIDDEN, seed: int = 11) -> None:
        h, rng = hidden, np.random.default_rng(seed)
        self.hidden = h
        self.shapes = {"inputs": (UNITS, 3 * h), "state": (h, 3 * h), "classes": (h, CLASSES), "class_bias": (CLASSES,), "units": (CLASSES, h, PER), "unit_bias": (CLASSES, PER)}
        self.load(rng.normal(0, 0.1, sum(math.prod(s) for s in self.shapes.values())), None)
        log = np.log(mass + 1.0)
        by_class = np.log(np.exp(log).reshape(CLASSES, PER).sum(1))
        self.class_bias[:] = by_class - by_class.max()
        self.unit_bias[:] = log.reshape(CLASSES, PER) - by_class[:, None]

    def load(self, flat: np.ndarray, squares: np.ndarray | None) -> None:
        self.flat = flat.astype(np.float32)
        self.squares = np.full(len(flat), 1e-8, np.float32) if squares is None else squares.astype(np.float32)
        self.grad = np.zeros(len(flat), np.float32)
        for of, prefix in ((self.flat, ""), (self.grad, "d_")):
            at = 0
            for name, shape in self.shapes.items():
                setattr(self, prefix + name, of[at:at + math.prod(shape)].reshape(shape))
                at += math.prod(shape)

    def run(self, x: np.ndarray, state: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the inputs x (steps, streams), from ``state``; an end as input resets it first.  ``keep`` gets
        what backpropagation needs."""
        h = self.hidden
        inputs, out = self.inputs[x], np.empty((*x.shape, h), np.float32)
        to_gates, to_new = np.ascontiguousarray(self.state[:, :2 * h]), np.ascontiguousarray(self.state[:, 2 * h:])
        resets = x == END
        some = resets.any(1)
        for t in range(len(x)):
            old = state * ~resets[t][:, None] if some[t] else state
            gates = old @ to_gates
            gates += inputs[t, :, :2 * h]
            _sigmoid(gates)
            z, r = gates[:, :h], gates[:, h:]
            rec = old @ to_new
            new = r * rec
            new += inputs[t, :, 2 * h:]
            new *= 2
            _sigmoid(new)           # tanh(a) = 2 sigmoid(2 a) - 1
            new *= 2
            new -= 1
            state = out[t]
            np.subtract(old, new, out=state)
            state *= z
            state += new
            if keep is not None:
                keep.append((old, rec, gates, new))
        return out

    def log_probs(self, states: np.ndarray, y: np.ndarray, grads: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of the units ``y`` (rows) by class and within it.  With ``grads``, the gradients of the sum of
        their negatives, by state into ``grads`` and by weight into the d_ arrays."""
        kind, unit = (y // PER).astype(np.uint8), y % PER
        rows, across = np.arange(len(y)), np.ascontiguousarray(states.T)
        p = _softmax(self.classes.T @ across + self.class_bias[:, None])
        out = np.log(p[kind, rows].astype(np.float64))
        if grads is not None:
            p[kind, rows] -= 1
            self.d_classes += across @ p.T
            self.d_class_bias += p.sum(1)
            back = self.classes @ p
        # rows of a class side by side: one product per class, all else at once
        order = np.argsort(kind, kind="stable")
        ends = np.cumsum(np.bincount(kind, minlength=CLASSES))
        spans = [(c, slice(int(a), int(b))) for c, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
        across, p = across[:, order], np.empty((PER, len(y)), np.float32)
        for c, own in spans:
            np.matmul(self.units[c].T, across[:, own], out=p[:, own])
            p[:, own] += self.unit_bias[c][:, None]
        p, unit = _softmax(p), unit[order]
        out[order] += np.log(p[unit, rows].astype(np.float64))
        if grads is not None:
            p[unit, rows] -= 1
            inner = np.empty_like(across)
            for c, own in spans:
                self.d_units[c] += across[:, own] @ p[:, own].T
                self.d_unit_bias[c] += p[:, own].sum(1)
                np.matmul(self.units[c], p[:, own], out=inner[:, own])
            grads[:] = back.T
            grads[order] += inner.T
        return out

    def learn(self, x: np.ndarray, y: np.ndarray, state: np.ndarray, rate: float = RATE) -> tuple[np.ndarray, float]:
        """One step on a window; the state after it and the loss."""
        h, keep = self.hidden, []
        self.grad[:] = 0
        states = self.run(x, state, keep)
        back = np.empty((x.size, h), np.float32)
        loss = -self.log_probs(states.reshape(-1, h), y.reshape(-1), back).sum()
        back = back.reshape(states.shape)
        d_in, d_rec, d_next = np.empty((*x.shape, 3 * h), np.float32), np.empty((*x.shape, 3 * h), np.float32), np.float32(0)
        back_state, resets = np.ascontiguousarray(self.state.T), x == END
        some = resets.any(1)
        for t in range(len(x) - 1, -1, -1):
            old, rec, gates, new = keep[t]
            z, r = gates[:, :h], gates[:, h:]
            d = back[t] + d_next
            slope = gates - gates * gates
            closed = d * (1 - z)
            d_new = closed * (1 - new * new)
            through, kept = d_in[t], d_rec[t]
            np.multiply(d * (old - new), slope[:, :h], out=through[:, :h])
            np.multiply(d_new * rec, slope[:, h:], out=through[:, h:2 * h])
            through[:, 2 * h:] = d_new
            kept[:, :2 * h] = through[:, :2 * h]
            np.multiply(d_new, r, out=kept[:, 2 * h:])
            d_next = kept @ back_state
            d -= closed             # d * z
            d_next += d
            if some[t]:
                d_next *= ~resets[t][:, None]
        self.d_state += np.concatenate([k[0] for k in keep]).T @ d_rec.reshape(-1, 3 * h)
        flat = x.reshape(-1).astype(np.uint8)
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.diff(flat[order].astype(np.int64), prepend=-1))
        self.d_inputs[flat[order[starts]]] += np.add.reduceat(d_in.reshape(-1, 3 * h)[order], starts)
        self.grad /= x.size
        self.squares += self.grad * self.grad
        self.flat -= rate * self.grad / np.sqrt(self.squares)
        return states[-1], float(loss)

    def fit(self, units: np.ndarray, rate: float = RATE) -> float:
        """One pass over texts that stand one after the other (each with its end), in parallel streams with carried state."""
        n = len(units)
        streams = int(min(STREAMS, max(1, n // (8 * WINDOW))))
        steps = -(-n // streams)
        y = np.full(steps * streams, END, np.uint8)     # the last stream is filled up with empty texts
        y[:n] = units
        y = y.reshape(streams, steps).T
        x = np.concatenate([np.full((1, streams), END, np.uint8), y[:-1]])
        # a stream that begins within a text starts as a text does
        state, loss = np.zeros((streams, self.hidden), np.float32), 0.0
        for t in range(0, steps, WINDOW):
            state, lost = self.learn(x[t:t + WINDOW], y[t:t + WINDOW], state, rate)
            loss += lost
        return loss

    def score(self, units: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Natural log probability of each of the texts (``n`` units each, one after the other), window by window with carried state.
        Texts are taken longest first, ``TOGETHER`` at a time, so that those still running are the first ones of the state."""
        order = np.argsort(-n, kind="stable")
        first, result = np.cumsum(n) - n, np.empty(len(n))
        units = np.append(units, np.uint8(END))
        for a in range(0, len(n), TOGETHER):
            own = order[a:a + TOGETHER]
            result[own] = self._score(units, first[own], n[own])
        return result

    def _score(self, units: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        running, t, state, out = len(n), 0, np.zeros((len(n), self.hidden), np.float32), np.zeros(len(n))
        while running := int(np.searchsorted(-n[:running], -t, "left")):
            at = np.arange(t, t + min(WINDOW, int(n[0]) - t))[:, None]
            live = at < n[:running]
            place = np.where(live, first[:running] + at, len(units) - 1)
            x, y = units[place - 1], units[place]
            if t == 0:
                x[0] = END
            states = self.run(x, state[:running])
            state = states[-1]
            if live.all():
                out[:running] += self.log_probs(states.reshape(-1, self.hidden), y.reshape(-1)).reshape(y.shape).sum(0)
            else:
                out[:running] += np.bincount(np.nonzero(live)[1], self.log_probs(states[live], y[live]), running)
            t += len(at)
        return out


# ---- training over the corpus

def _weights(net: Network, tokens: int) -> pa.RecordBatch:
    """Weights and sums, times the tokens they stand for."""
    both = np.concatenate([net.flat, net.squares]).astype(np.float64) * tokens
    return pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["weights", "tokens"])


def fitted(training: DataFrame, words: Vocabulary, start: tuple | None, passes: int = 1) -> tuple | None:
    """(weights, sums) refined by every task over its training texts and averaged by tokens."""
    spark = training.sparkSession
    held = spark.sparkContext.broadcast((words, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = held.value
        net, tokens = Network(words.mass), 0
        if start:
            net.load(*start)
        for batch in slices(batches, SLICE):
            codes, endings, n = _tokens(batch)
            units = words.of(codes, endings)[0]
            for _ in range(passes):
                net.fit(units)
            tokens += len(units)
        if tokens:
            yield _weights(net, tokens)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = 0.0, 0
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, tokens = total + np.frombuffer(w), tokens + n
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["weights", "tokens"])

    kind = "weights binary, tokens long"
    # a few hundred KB per task, summed in 16 tasks and then on the driver
    sums = training.select("text").mapInArrow(run, kind).repartition(16).mapInArrow(added, kind).collect()
    if not sums:
        return start
    both = sum(np.frombuffer(r.weights) for r in sums) / sum(r.tokens for r in sums)
    return both[:len(both) // 2], both[len(both) // 2:]


def trained(training: DataFrame, words: Vocabulary, sample: int = SAMPLE) -> tuple | None:
    """Start on about ``sample`` training documents in one task, then one pass over all of them."""
    documents = int(10 ** words.logs[words.codes == END_CODE].sum() + 0.5) - 1
    if documents < 1:
        return None
    few = training.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, sample / documents)))
    start = fitted(few.select("text").repartition(1), words, None, SAMPLE_PASSES)
    return fitted(training, words, start)


# ---- scoring

_SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base", pa.float64()), ("model", pa.float64()), ("codes", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def scored(docs: DataFrame, words: Vocabulary, weights: tuple | None) -> DataFrame:
    """Per document row what the head and the network give, and its other words (codes, times), whose counts are joined later."""
    held = docs.sparkSession.sparkContext.broadcast((words, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = held.value
        net = Network(words.mass)
        if weights:
            net.load(*weights)
        row, per_token = TaskContext.get().partitionId() << 40, math.log10(words.total + words.distinct + 1)
        for batch in slices(batches, SLICE):
            codes, endings, n = _tokens(batch)
            units, logs, known = words.of(codes, endings)
            doc = np.repeat(np.arange(len(n)), n)
            base = np.bincount(doc, logs, len(n))
            own = logs * (units > OWN) - words.within[units]
            model = net.score(units, n) / math.log(10) + np.bincount(doc, own, len(n))
            rest = np.flatnonzero(~known)
            rest = rest[np.lexsort((codes[rest], doc[rest]))]
            d, c = doc[rest], codes[rest]
            first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])])) if len(rest) else rest
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(d[first], minlength=len(n)))]).astype(np.int32))
            times = np.diff(np.append(first, len(rest)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(n))), batch.column(1).cast(pa.int64()), batch.column(2), pa.array(n),
                 pa.array(np.bincount(doc, known, len(n)).astype(np.int64)), pa.array(base - n * per_token), pa.array(model),
                 pa.ListArray.from_arrays(offsets, pa.array(c[first].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))], schema=_SCORED)
            row += len(n)

    return docs.select("text", "doc_id", "held_out").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, codes array<long>, times array<long>")


def score(docs: DataFrame, folds: int = 7, held: int = 2, head: int = HEAD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = texts(docs).withColumn("id", name).withColumn("held_out", F.crc32(F.col("id").cast("binary")) % folds == held)
    training = rows.where(~F.col("held_out"))
    counts = written(token_counts(training), "counts")
    words = vocabulary(counts, head)
    out = written(scored(rows, words, trained(training, words, sample)), "scored")
    rare = counts.where(F.expr(BIN) < words.lowest).select("code", F.log10(F.col("n") + 1).alias("log"))
    rest = (out.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
            .join(rare, "code").groupBy("row").agg(F.sum(F.col("log") * F.col("times")).alias("more"), F.sum("times").alias("known")))
    more = F.coalesce("more", F.lit(0.0))
    return (out.drop("codes", "times").join(rest, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
                    F.lit(words.total).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score")))
