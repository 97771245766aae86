"""Language-model scoring with a gated recurrent network, trained on the corpus in numpy.

Words of the lower-cased text are numbered by their counts over all documents; the network is one layer of gated recurrent
units whose output softmax is factored into classes of words and words of a class. Every task trains on its own documents
by truncated backpropagation, and the tasks' parameters are averaged; rounds take disjoint parts of the corpus, which
together are all of it. Documents run through lanes, one after another in each, and a lane's state is carried from window
to window and reset only where a document begins, so a document's log-likelihood is that of the complete document.

The vocabulary is every word of the corpus. The network tells the most frequent ones apart; those behind them are bands, each
of twice as many words as the one before, that are symbols to the network, and within a band a word has its share of the
band's occurrences in the corpus. Counts of all but the last band are a table of bounded size; the last band takes in all
rarer words, however many there are, and their occurrences are joined with their counts by a shuffle.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm import columnar as C
from offerlake.llm.shared import checkpoint

#: Symbols 1 to BANDS are the bands of rarer words, the last for those beyond the table.
END, BANDS = 0, 9
SPECIAL = 1 + BANDS
VOCABULARY, CLASS_SIZE, HIDDEN = 1024, 32, 24
ROUNDS, RATE = 2, 0.01
TRAIN_LANES, TRAIN_WINDOW, UPDATE_EVERY = 384, 16, 1
LANES, WINDOW = 384, 32
#: Parts that a model is averaged in, and teams of tasks whose averages are averaged.
BLOCKS, TEAMS = 16, 256
#: Words that a task holds at a time.
SHARD_WORDS = 4_000_000

Parameters = dict[str, np.ndarray]


def shapes(vocabulary: int = VOCABULARY, hidden: int = HIDDEN, size: int = CLASS_SIZE) -> dict[str, tuple[int, ...]]:
    classes = vocabulary // size
    return {"x": (vocabulary, 3 * hidden), "u": (hidden, 3 * hidden), "wc": (hidden, classes), "bc": (classes,), "ww": (classes, hidden, size), "bw": (classes, size)}


def initial(frequency: np.ndarray, hidden: int = HIDDEN, size: int = CLASS_SIZE, seed: int = 11) -> Parameters:
    """Small random weights, and output biases that give each word its share of the corpus."""
    rng = np.random.Generator(np.random.PCG64(seed))
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes(len(frequency), hidden, size).items()}
    share = (frequency + 1.0).reshape(-1, size)
    p["bc"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
    p["bw"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return p


def flatten(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflatten(flat: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def forward(p: Parameters, ids: np.ndarray, begins: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, tuple]:
    """States after each step (steps, lanes, hidden), the last one, and what backward() needs. ids, begins: (steps, lanes).

    In memory the lanes come last, so that each operation runs along them.
    """
    hidden, h, across = h.shape[1], h.T, p["u"].T.copy()
    gates = np.take(np.ascontiguousarray(p["x"].T), ids, axis=1, mode="clip")  # of inputs at first; then z, r and n of each step
    states = np.empty((hidden, *ids.shape), np.float32)
    before, inner = (np.empty_like(states), np.empty_like(states)) if keep else (None, None)
    for t, first in enumerate(begins.any(axis=1).tolist()):
        if first:
            h = h * ~begins[t]
        g = across @ h
        zr, n = gates[: 2 * hidden, t], gates[2 * hidden :, t]
        zr += g[: 2 * hidden]
        _logistic(zr)
        if keep:
            before[:, t], inner[:, t] = h, g[2 * hidden :]
        n += zr[hidden:] * g[2 * hidden :]
        n *= 2  # tanh(y) is 2 logistic(2 y) - 1
        _logistic(n)
        n *= 2
        n -= 1
        h = h - n
        h *= zr[:hidden]
        h += n
        states[:, t] = h
    return states.transpose(1, 2, 0), h.T, (before, inner, gates)


def _logistic(x: np.ndarray) -> None:
    """In place; by exp, which is much faster than tanh. Where exp overflows the result is zero, as it should be."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _choice(x: np.ndarray, target: np.ndarray, gradient: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of each column's target under the softmax of its logits x, which are overwritten, and its gradient."""
    at = target.astype(np.int64) * x.shape[1] + np.arange(x.shape[1])
    if x.size and x.max() > 80:
        np.minimum(x, 80, out=x)  # where exp is still finite
    chosen = x.ravel()[at]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    logp = chosen - np.log(total)
    if not gradient:
        return logp, None
    x *= -1 / total
    x.ravel()[at] += 1
    return logp, x


def output(p: Parameters, states: np.ndarray, targets: np.ndarray, gradients: Parameters | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of each target under its state; with gradients, those of the sum are added, and the states' returned.

    states: (n, hidden), targets: (n,). The class is chosen first and then the word within it.
    """
    size = p["bw"].shape[1]
    group, word = (targets // size).astype(np.int16), targets % size
    order = np.argsort(group, kind="stable")
    states, group, word = np.take(states.T, order, axis=1, mode="clip"), group[order], word[order]
    x = p["wc"].T @ states
    x += p["bc"][:, None]
    logp, d = _choice(x, group, gradients is not None)
    back = None
    if gradients is not None:
        gradients["wc"] += states @ d.T
        gradients["bc"] += d.sum(axis=1)
        back = p["wc"] @ d
    cut = np.searchsorted(group, np.arange(len(p["bc"]) + 1))
    for c in np.flatnonzero(np.diff(cut)).tolist():
        at = slice(cut[c], cut[c + 1])
        x = p["ww"][c].T @ states[:, at]
        x += p["bw"][c][:, None]
        chosen, d = _choice(x, word[at], gradients is not None)
        logp[at] += chosen
        if gradients is not None:
            gradients["ww"][c] += states[:, at] @ d.T
            gradients["bw"][c] += d.sum(axis=1)
            back[:, at] += p["ww"][c] @ d
    out = np.empty(len(order))
    out[order] = logp
    if back is not None:
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        back = np.take(back, place, axis=1, mode="clip").T
    return out, back


def backward(p: Parameters, ids: np.ndarray, begins: np.ndarray, kept: tuple, from_output: np.ndarray, gradients: Parameters) -> None:
    """Adds the gradients of one window, back to its first step and no further."""
    hidden = p["u"].shape[0]
    before, inner, gates = kept
    z, r, n = gates[:hidden], gates[hidden : 2 * hidden], gates[2 * hidden :]
    from_output, begun = from_output.transpose(2, 0, 1), begins.any(axis=1).tolist()
    ahead = np.zeros((hidden, ids.shape[1]), np.float32)
    into, through = np.empty(gates.shape, np.float32), np.empty(gates.shape, np.float32)
    # what a step's gradient is multiplied by, for all steps at once
    to_n, to_z, to_r = 1 - n * n, 1 - z, inner * (1 - r)
    to_n *= to_z
    to_z *= z
    to_z *= before - n
    to_r *= r
    for t in range(len(ids) - 1, -1, -1):
        ahead += from_output[:, t]
        dg, dn = through[:, t], into[2 * hidden :, t]
        np.multiply(ahead, to_z[:, t], out=dg[:hidden])
        np.multiply(ahead, to_n[:, t], out=dn)
        np.multiply(dn, to_r[:, t], out=dg[hidden : 2 * hidden])
        np.multiply(dn, r[:, t], out=dg[2 * hidden :])
        ahead *= z[:, t]
        ahead += p["u"] @ dg
        if begun[t]:
            ahead *= ~begins[t]
    into[: 2 * hidden] = through[: 2 * hidden]
    gradients["u"] += before.reshape(hidden, -1) @ through.reshape(3 * hidden, -1).T
    flat = ids.ravel()
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    gradients["x"][flat[order[first]]] += np.add.reduceat(np.take(into.reshape(3 * hidden, -1), order, axis=1, mode="clip"), first, axis=1).T


class Lanes:
    """Documents in lanes of about equal length, longer ones first: input, target (-1 behind the end) and document of each step."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, most: int):
        n = lengths + 1
        count = min(most, len(n))
        filled, place = np.zeros(count, np.int64), np.zeros((len(n), 2), np.int64)
        order = np.argsort(-n, kind="stable")
        heap = [(0, k) for k in range(count)]
        for d in order.tolist():
            length, k = heapq.heappop(heap)
            place[d] = (k, length)
            heapq.heappush(heap, (length + int(n[d]), k))
            filled[k] = length + n[d]
        by_length = np.argsort(-filled, kind="stable")
        rank = np.empty(count, np.int64)
        rank[by_length] = np.arange(count)
        self.filled, place[:, 0] = filled[by_length], rank[place[:, 0]]
        steps = int(filled.max())
        self.inputs = np.zeros((steps, count), np.int16)
        self.targets = np.full((steps, count), -1, np.int16)
        self.document = np.zeros((steps, count), np.int32)
        self.begins = np.zeros((steps, count), bool)
        start = np.cumsum(lengths) - lengths
        for d, (k, at) in enumerate(place.tolist()):
            own = words[start[d] : start[d] + lengths[d]]
            end = at + len(own)
            self.inputs[at + 1 : end + 1, k] = own
            self.targets[at:end, k] = own
            self.targets[end, k] = END
            self.document[at : end + 1, k] = d
            self.begins[at, k] = True

    def windows(self, size: int) -> Iterator[tuple[slice, slice]]:
        """Steps and the lanes that haven't ended before them; a long document's lane is not waited for by others."""
        for at in range(0, len(self.inputs), size):
            yield slice(at, min(at + size, len(self.inputs))), slice(0, int((self.filled > at).sum()))


def train(p: Parameters, words: np.ndarray, lengths: np.ndarray, memory: dict, lanes: int = TRAIN_LANES, window: int = TRAIN_WINDOW, every: int = UPDATE_EVERY, rate: float = RATE) -> Parameters:
    """One pass of truncated backpropagation over documents. memory holds the optimiser's moments from call to call.

    The state runs through all windows and each gives its gradient; those of `every` windows make one update (Adam), and so
    do those that are left at the end.
    """
    p = {k: v.copy() for k, v in p.items()}
    data = Lanes(words, lengths, lanes)
    h = np.zeros((data.inputs.shape[1], p["u"].shape[0]), np.float32)
    cuts = list(data.windows(window))
    gradients, steps = {k: np.zeros_like(v) for k, v in p.items()}, 0
    for number, w in enumerate(cuts, 1):
        ids, begins, targets = data.inputs[w], data.begins[w], data.targets[w]
        states, h, kept = forward(p, ids, begins, h[w[1]], keep=True)
        live = targets >= 0
        if live.all():
            _, back = output(p, states.reshape(-1, states.shape[2]), targets.ravel(), gradients)
            backward(p, ids, begins, kept, back.reshape(states.shape), gradients)
        elif live.any():
            _, back = output(p, states[live], targets[live], gradients)
            from_output = np.zeros_like(states)
            from_output[live] = back
            backward(p, ids, begins, kept, from_output, gradients)
        if live.any():
            steps += int(live.sum())
        if steps and (number % every == 0 or number == len(cuts)):
            memory["t"] = t = memory.get("t", 0) + 1
            for k, g in gradients.items():
                g *= 1.0 / steps
                m, v = memory.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
                g[...] = 0
            steps = 0
    return p


def likelihood(p: Parameters, words: np.ndarray, lengths: np.ndarray, lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
    """Log-likelihood of each document, its end included."""
    if not len(lengths):
        return np.zeros(0)
    data, total = Lanes(words, lengths, lanes), np.zeros(len(lengths))
    h = np.zeros((data.inputs.shape[1], p["u"].shape[0]), np.float32)
    for w in data.windows(window):
        states, h, _ = forward(p, data.inputs[w], data.begins[w], h[w[1]])
        live = data.targets[w] >= 0
        if live.all():
            logp, _ = output(p, states.reshape(-1, states.shape[2]), data.targets[w].ravel())
        else:
            logp, _ = output(p, states[live], data.targets[w][live])
        total += np.bincount(data.document[w][live], logp, len(lengths))
    return total


def _hashed(batches, column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """Batch, range of its rows, hashes of their words and words of each row."""
    for batch in batches:
        data, off = C.utf8(batch.column(column))
        for i, j in C.chunks(off):
            part, edges = data[off[i] : off[j]], off[i : j + 1] - off[i]
            starts, ends, rows = C.spans(part, edges)
            yield batch, i, j, C.hashes(part, starts, ends), np.bincount(rows, minlength=j - i)


def word_counts(docs: DataFrame) -> DataFrame:
    """Hash and count of every word of the corpus; docs has a column text. Tasks count their own words first."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return words, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(words: np.ndarray, n: np.ndarray):
            for k in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 50_000].view(np.int64)), pa.array(n[k : k + 50_000])], names=["word", "n"])

        for _, _, _, hashed, _ in _hashed(batches, 0):
            held.append(np.unique(hashed, return_counts=True))
            if sum(len(w) for w, _ in held) > 2_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield from rows(*held[0])
                    held = []
        if held:
            yield from rows(*merged())

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Words by hash: their number for the network, and the log of a word's share of the occurrences under its number.

    words and counts: the table of the most frequent words of the corpus, of `total` words and `documents` documents. By rank
    the first have numbers of their own, and each band is twice as long as all before it; the last band is all other words.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, documents: int, size: int = VOCABULARY):
        order, own = np.lexsort((words, -counts)), size - SPECIAL
        words, counts = words[order], counts[order].astype(np.float64)
        rank = np.arange(len(words))
        band = np.minimum(1 + np.floor(np.log2(np.maximum(rank, own) / own)).astype(np.int64), BANDS - 1)
        number = np.where(rank < own, rank + SPECIAL, band)
        self.frequency = np.bincount(number, counts, size)
        self.frequency[END], self.frequency[BANDS] = documents, total - counts.sum()
        share = np.where(rank < own, 0.0, np.log(counts / self.frequency[number]))
        by_hash = np.argsort(words)
        # one entry more, for words that aren't found
        self.words = np.append(words[by_hash], np.uint64(0))
        self.number = np.append(number[by_hash], BANDS).astype(np.int16)
        self.share = np.append(share[by_hash], 0.0).astype(np.float32)
        # words are looked for from the place of the first with the same upper bits
        self.shift = np.uint64(64 - max(1, int(len(words)).bit_length() + 1))
        upper = (self.words[:-1] >> self.shift).astype(np.int64)
        self.first = np.searchsorted(upper, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max(initial=0))

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """The table's place of each word; behind its end for those beyond it."""
        upper, end = (hashed >> self.shift).astype(np.int64), len(self.words) - 1
        at, last = self.first[upper], self.first[upper + 1]
        open_ = np.flatnonzero((self.words[at] != hashed) | (at == last))
        for _ in range(self.longest):
            at[open_] += 1
            over = at[open_] >= last[open_]
            at[open_[over]] = end
            open_ = open_[~over]
            open_ = open_[self.words[at[open_]] != hashed[open_]]
            if not len(open_):
                break
        return at

    def __call__(self, hashed: np.ndarray) -> np.ndarray:
        return self.number[self.find(hashed)]


def learn_vocabulary(docs: DataFrame, size: int = VOCABULARY) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of all documents, and the counts of all their words; docs has a column text.

    The table has the words of so great a count that they fit into all bands but the last; words of equal counts are all in
    it or all beyond it. Counts above 1,024 are told apart by their first ten bits there, so that the driver sees a bounded
    number of them.
    """
    counts = checkpoint(word_counts(docs))
    coarse = F.expr("shiftright(n, greatest(cast(floor(log2(n)) as int) - 9, 0))")
    by_count = counts.groupBy(F.floor(F.log2("n")), coarse).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).toArrow().sort_by([("least", "descending")])
    fit = np.cumsum(by_count["words"].to_numpy()) <= (size - SPECIAL) << (BANDS - 1)
    least = int(by_count["least"].to_numpy()[fit].min(initial=1 << 62))
    table = counts.filter(F.col("n") >= least).toArrow()
    vocabulary = Vocabulary(table["word"].to_numpy().view(np.uint64), table["n"].to_numpy(), int(by_count["n"].to_numpy().sum()), docs.count(), size)
    return vocabulary, counts


def _shards(batches, vocabulary: Vocabulary, column: int, rare: bool = False) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows (batch, first, last), word numbers and words of each row, of about SHARD_WORDS words at a time.

    With rare, rows have more parts: the words' shares of their bands by row, and row, hash and count of each word beyond
    the table.
    """
    held, words, lengths, size = [], [], [], 0
    for batch, i, j, hashed, n in _hashed(batches, column):
        if not rare:
            held.append((batch, i, j))
            words.append(vocabulary(hashed))
        else:
            found, row = vocabulary.find(hashed), np.repeat(np.arange(j - i), n)
            words.append(vocabulary.number[found])
            beyond = np.flatnonzero(words[-1] == BANDS)
            beyond = beyond[np.lexsort((hashed[beyond], row[beyond]))]
            first = np.flatnonzero((np.diff(row[beyond], prepend=-1) != 0) | (np.diff(hashed[beyond], prepend=~hashed[beyond[:1]]) != 0))
            times = np.diff(first, append=len(beyond))
            beyond = beyond[first]
            held.append((batch, i, j, np.bincount(row, vocabulary.share[found], j - i), row[beyond], hashed[beyond], times))
        lengths.append(n)
        size += len(hashed)
        if size >= SHARD_WORDS:
            yield held, np.concatenate(words), np.concatenate(lengths)
            held, words, lengths, size = [], [], [], 0
    if held:
        yield held, np.concatenate(words), np.concatenate(lengths)


def average(parts: DataFrame) -> np.ndarray:
    """Mean of parameter vectors, weighted; parts: block, team, weight and the block's values packed, from every task.

    A block's values are averaged by team first and then over the teams, batch by batch, so that however many tasks there
    are, none holds more than a block's values and a batch.
    """

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = 0.0, 0
        for batch in batches:
            for w, values in zip(batch["weight"].to_pylist(), batch["packed"], strict=True):
                total = total + w * np.frombuffer(zlib.decompress(values.as_py()), np.float32).astype(np.float64)
                weight += w
        packed = zlib.compress((total / weight).astype(np.float32).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([weight], pa.int64()), pa.array([packed], pa.binary())], names=["block", "weight", "packed"])

    schema = "block int, weight bigint, packed binary"
    rows = parts.groupBy("block", "team").applyInArrow(merge, schema).groupBy("block").applyInArrow(merge, schema).collect()  # the size of one model
    return np.concatenate([np.frombuffer(zlib.decompress(r["packed"]), np.float32) for r in sorted(rows, key=lambda r: r["block"])]) if rows else np.zeros(0, np.float32)


def learn(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Parameters:
    """Train on all documents: in round r on those whose text's hash falls to it, from the average of the round before.

    docs has a column text. Every task sends its parameters, in blocks, and nothing else.
    """
    spark, p = docs.sparkSession, initial(vocabulary.frequency)
    known = spark.sparkContext.broadcast(vocabulary)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(p)

        def run(batches, sent=sent, r=r):
            own, memory, weight = sent.value, {}, 0
            for _, words, lengths in _shards(batches, known.value, 0):
                own = train(own, words, lengths, memory, rate=RATE / (1 + r))
                weight += int(lengths.sum()) + len(lengths)
            if weight:
                blocks = np.array_split(flatten(own), BLOCKS)
                team = TaskContext.get().partitionId() % TEAMS
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([team] * BLOCKS, pa.int32()), pa.array([weight] * BLOCKS, pa.int64()), pa.array([zlib.compress(b.tobytes(), 1) for b in blocks], pa.binary())], names=["block", "team", "weight", "packed"])

        part = docs.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).select("text")
        flat = average(part.mapInArrow(run, "block int, team int, weight bigint, packed binary"))
        p = unflatten(flat, p) if len(flat) else p
    return p


def score(docs: DataFrame, vocabulary: Vocabulary, counts: DataFrame, p: Parameters) -> DataFrame:
    """doc_id, words, words that the network doesn't tell apart and log-likelihood of each row of docs (doc_id, text).

    A row for each document and one for each of its words beyond the table are joined with the words' counts and added up.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, p))

    def rows(at: pa.Array, doc: pa.Array, words: np.ndarray, times: np.ndarray, n_words: np.ndarray, unknown: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        arrays = [at, pa.array(words.view(np.int64)), pa.array(times.astype(np.int64)), doc, *(pa.array(x.astype(np.int32)) for x in (n_words, unknown)), pa.array(value.astype(np.float64))]
        return pa.RecordBatch.from_arrays(arrays, names=["row", "word", "times", "doc_id", "n_words", "n_unknown", "value"])

    def run(batches):
        known, own = sent.value
        for held, words, lengths in _shards(batches, known, 2, rare=True):
            logp = likelihood(own, words, lengths)
            unknown = np.bincount(np.repeat(np.arange(len(lengths)), lengths), words < SPECIAL, len(lengths))
            done = 0
            for batch, i, j, shares, row, beyond, times in held:
                own_rows, ids = slice(done, done + j - i), batch.column(0).slice(i, j - i)
                # a document's own row has a word that no other has, so that these rows spread over all tasks
                apart = C.mix(ids.to_numpy().view(np.uint64))
                yield rows(ids, batch.column(1).slice(i, j - i), apart, np.zeros(j - i), lengths[own_rows], unknown[own_rows], logp[own_rows] + shares)
                for k in range(0, len(row), 20_000):
                    part, none = row[k : k + 20_000], np.zeros(len(row[k : k + 20_000]))
                    yield rows(ids.take(pa.array(part)), pa.nulls(len(part), pa.int64()), beyond[k : k + 20_000], times[k : k + 20_000], none, none, none)
                done += j - i

    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = source.mapInArrow(run, "row bigint, word bigint, times bigint, doc_id bigint, n_words int, n_unknown int, value double")
    rest = math.log(max(1.0, float(vocabulary.frequency[BANDS])))
    share = F.when(F.col("times") > 0, F.col("times") * (F.log("n") - F.lit(rest))).otherwise(F.lit(0.0))
    joined = parts.join(counts, "word", "left").select("row", "doc_id", "n_words", "n_unknown", (F.col("value") + share).alias("value"))
    total = joined.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "n_words", "n_unknown")], F.sum("value").alias("log_likelihood"))
    return total.select("doc_id", "n_words", "n_unknown", "log_likelihood")


def language_model(docs: DataFrame) -> DataFrame:
    """Every document's log-likelihood under a network trained on all of them.

    A null or empty text has no words and the likelihood of its end alone; a null id stays null; repeated rows each give
    their row; other columns aren't read. A word is a run of letters, digits and underscores in lower case. n_unknown counts
    a document's words that the network knows by their band alone.
    """
    C.small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
    vocabulary, counts = learn_vocabulary(source)
    return score(source, vocabulary, counts, learn(source, vocabulary))
