"""Document scores by masked pseudo-likelihood.

A small network, written in numpy, predicts each word from ``SIDE`` words on
both sides of it: embeddings of the window, one hidden layer, and an output
factored into classes of words (class, then word within class). A document's
score is the sum of log P(word | both sides) over all its words.

Everything the model learns comes from all documents: word counts give the
vocabulary, the classes and the starting point (the unigram model); then, in
``ROUNDS`` rounds, every task masks every ``ROUNDS``-th position of its own
documents, in each round others, so that every word is a target once; it trains a copy of the network on them, and the copies are averaged,
weighted by their examples, in groups of ``FAN_IN`` (so no task sees more than
that many copies). What is gathered grows with the corpus; the network that is
sent to the tasks has a fixed size.

Words outside the vocabulary share ``RARE`` buckets by hash inside the network.
As targets they keep their own counts: P(word | window) is P(bucket | window)
times the word's share of the bucket's count. The counts of those words, as many
as the corpus has, stay a table that is joined on the word.
A word that was not counted (other documents than those of the fit) counts once.

Texts are cut into words twice: to count them, and once the vocabulary is known to
replace them by ids. Training and scoring read the ids. Only the ids and each
round's average are written to the shared folder: counts stay on the executors' disks,
and copies are averaged by the shuffles of one job. A file costs a task a child process
or more on a local file system, and many small tasks wrote many small files.

Defined results: a null or blank text has 0 words, a sum of 0 and a null mean.
Null ids, repeated rows and extra columns need no care: every row is scored by
its text alone. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, on_disk, ship_package, staged
from .columns import spans
from .registry import read_table, register

CLASSES = 64
PER_CLASS = 64
RARE = 256                   # buckets: the last classes
VOCAB = CLASSES * PER_CLASS
SIDE = 2
DIM = 12
HIDDEN = 24
ROUNDS = 2
RATE = 0.05
BATCH = 2048
SCORED = 16_384              # words scored together
FEW = 16                     # targets of a class that are handled with those of other classes
FAN_IN = 16
SLICE_WORDS = 60_000
SLICE_BYTES = 8_000_000      # of text that a task cuts into words at once
CACHE_MAX = 500_000          # counted words that a task holds
KNOWN = 200_000              # words outside the vocabulary whose counts are sent to the tasks
PAD = VOCAB                  # id beyond the ends of a document
STRIP = ".,;:!?()[]\"'“”«»*#$%&|"


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def bare(chunk: str) -> str:
    """A word without the punctuation around it (all of it, if nothing is left)."""
    return chunk.strip(STRIP) or chunk


def rare_id(word: str) -> int:
    import xxhash
    return VOCAB - RARE + xxhash.xxh64_intdigest(word) % RARE


def split_words(column) -> tuple:
    """The words of an Arrow column of texts, one after another, and how many each
    text has. Same as ``words_of``: Arrow cuts ASCII texts, Python cuts others first."""
    import pyarrow as pa
    import pyarrow.compute as pc
    text = column.fill_null("")
    odd = pc.or_(pc.invert(pc.string_is_ascii(text)), pc.match_substring_regex(text, "[\x1c-\x1f]"))
    other = text.filter(odd).to_pylist()
    text = pc.ascii_lower(text)
    if other:
        text = pc.replace_with_mask(text, odd, pa.array([" ".join(words_of(t)) for t in other], pa.string()))
    text = pc.ascii_trim_whitespace(text)
    lists = pc.ascii_split_whitespace(text)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    blank = pc.binary_length(text).to_numpy(zero_copy_only=False) == 0
    if blank.any():                                     # split into one empty word
        words = words.filter(pc.greater(pc.binary_length(words), 0))
        lengths[blank] = 0
    return words, lengths


def bare_words(chunks):
    """``bare`` of an Arrow column of words."""
    import pyarrow.compute as pc
    inner = pc.utf8_trim(chunks, characters=STRIP)
    return pc.if_else(pc.equal(pc.binary_length(inner), 0), chunks, inner)


def counted(words, n: np.ndarray | None = None) -> tuple:
    """Distinct words of an Arrow column and the sum of ``n`` (default: 1) of each."""
    coded = words.dictionary_encode()
    total = np.bincount(coded.indices.to_numpy(zero_copy_only=False), n, len(coded.dictionary))
    return coded.dictionary, total.astype(np.int64)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values``."""
    out, full = np.zeros(len(lengths)), lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[full])
    return out


def windows(ids: np.ndarray, lengths: np.ndarray, pick: np.ndarray | None = None) -> np.ndarray:
    """For every (or every picked) word, the ids of ``SIDE`` words before and after
    it in its document."""
    gap = np.repeat(np.arange(1, len(lengths) + 1) * SIDE, lengths)
    place = np.arange(len(ids)) + gap
    padded = np.full(len(ids) + SIDE * (len(lengths) + 1), PAD, np.int64)
    padded[place] = ids
    steps = [s for s in range(-SIDE, SIDE + 1) if s]
    chosen = place if pick is None else place[pick]
    out = np.empty((len(chosen), 2 * SIDE), np.int64)
    for k, s in enumerate(steps):
        out[:, k] = padded[chosen + s]
    return out


class Network:
    """Parameters as one float32 vector with named views."""

    SHAPES = (("embed", (VOCAB + 1, DIM)), ("w1", (2 * SIDE * DIM, HIDDEN)), ("b1", (HIDDEN,)),
              ("wc", (HIDDEN, CLASSES)), ("bc", (CLASSES,)), ("wv", (CLASSES, PER_CLASS, HIDDEN)), ("bv", (CLASSES, PER_CLASS)))
    SIZE = sum(int(np.prod(s)) for _, s in SHAPES)

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, at = flat, 0
        for name, shape in self.SHAPES:
            n = int(np.prod(shape))
            setattr(self, name, flat[at:at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Random window weights over the unigram model of ``counts``."""
        rng = np.random.default_rng(11)
        net = cls(np.zeros(cls.SIZE, np.float32))
        net.embed[:] = rng.normal(0, 0.3, net.embed.shape)
        net.w1[:] = rng.normal(0, 0.15, net.w1.shape)
        p = (counts + 0.5).reshape(CLASSES, PER_CLASS)
        net.bc[:] = np.log(p.sum(1) / p.sum())
        net.bv[:] = np.log(p / p.sum(1, keepdims=True))
        return net

    def hidden(self, window: np.ndarray) -> np.ndarray:
        return np.tanh(self.embed[window].reshape(len(window), -1) @ self.w1 + self.b1)

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(target) from hidden states."""
        by, out = ByClass(target), np.empty(len(target), h.dtype)
        out[by.order] = self._log_probs(h[by.order], by)
        return out

    def _log_probs(self, h: np.ndarray, by: ByClass) -> np.ndarray:
        """log P of targets in the order of ``by``."""
        rows = np.arange(len(h))
        z = h @ self.wc
        z += self.bc
        lp = z[rows, by.cls]
        lp -= _log_sum(z)
        self._word_logits(h, by, z)
        lp += z[rows, by.word]
        lp -= _log_sum(z)
        return lp

    def _word_logits(self, h: np.ndarray, by: ByClass, z: np.ndarray) -> None:
        """Logits of the words of each row's class; rows are in the order of ``by``."""
        for c, i, j in by.large:
            np.dot(h[i:j], self.wv[c].T, out=z[i:j])
            z[i:j] += self.bv[c]
        if len(by.small):
            some = by.padded(h) @ self.wv[by.small].transpose(0, 2, 1)
            some += self.bv[by.small][:, None]
            z[by.at:] = some[by.valid]

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log P of every word given both sides."""
        if not len(ids):
            return np.zeros(0)
        near = windows(ids, lengths)
        if not hasattr(self, "_slots"):
            # the window's layer, precomputed for each word and place
            w = self.w1.reshape(2 * SIDE, DIM, HIDDEN)
            self._slots = [self.embed @ w[s] for s in range(2 * SIDE)]
        out = np.empty(len(ids))
        for at in range(0, len(ids), SCORED):
            by = ByClass(ids[at:at + SCORED])
            k = near[at:at + SCORED][by.order]
            h = self._slots[0].take(k[:, 0], axis=0)
            for s in range(1, 2 * SIDE):
                h += self._slots[s].take(k[:, s], axis=0)
            h += self.b1
            np.tanh(h, out=h)
            out[at + by.order] = self._log_probs(h, by)
        return out

    def gradient(self, window: np.ndarray, target: np.ndarray, grad: Network) -> None:
        """Writes the gradient of the mean negative log probability to ``grad``."""
        n = len(target)
        by = ByClass(target)
        rows, at = np.arange(n), window[by.order].ravel()
        x = self.embed.take(at, axis=0).reshape(n, -1)
        h = x @ self.w1
        h += self.b1
        np.tanh(h, out=h)
        ones = np.ones(n, h.dtype)
        d = h @ self.wc
        d += self.bc
        _softmax(d, 1 / n)
        d[rows, by.cls] -= 1 / n
        np.dot(h.T, d, out=grad.wc)
        np.dot(ones, d, out=grad.bc)
        dh = d @ self.wc.T
        e = d
        self._word_logits(h, by, e)
        _softmax(e, 1 / n)
        e[rows, by.word] -= 1 / n
        grad.wv[by.absent] = 0
        grad.bv[by.absent] = 0
        back = np.empty_like(dh)
        for c, i, j in by.large:
            part = e[i:j]
            np.dot(part.T, h[i:j], out=grad.wv[c])
            np.dot(ones[i:j], part, out=grad.bv[c])
            np.dot(part, self.wv[c], out=back[i:j])
        if len(by.small):
            some = by.padded(e)
            grad.wv[by.small] = some.transpose(0, 2, 1) @ by.padded(h)
            grad.bv[by.small] = some.sum(1)
            back[by.at:] = (some @ self.wv[by.small])[by.valid]
        dh += back
        np.multiply(h, h, out=back)
        np.subtract(1, back, out=back)
        dh *= back
        np.dot(x.T, dh, out=grad.w1)
        np.dot(ones, dh, out=grad.b1)
        dx = (dh @ self.w1.T).reshape(-1, DIM)
        for k in range(DIM):
            grad.embed[:, k] = np.bincount(at, dx[:, k], VOCAB + 1)


class ByClass:
    """Order of targets by class: first the ``large`` classes (class, first row, last),
    then, from row ``at`` on, those of at most ``FEW`` rows, which are handled
    together in blocks padded to the same number of rows."""

    def __init__(self, target: np.ndarray) -> None:
        cls = target // PER_CLASS
        counts = np.bincount(cls, minlength=CLASSES)
        large = np.flatnonzero(counts > FEW)
        self.small = np.flatnonzero((counts > 0) & (counts <= FEW))
        self.absent = np.flatnonzero(counts == 0)
        place = np.zeros(CLASSES, np.uint8)
        place[large] = np.arange(len(large))
        place[self.small] = len(large) + np.arange(len(self.small))
        self.order = np.argsort(place[cls], kind="stable")
        ends = np.cumsum(counts[large]).tolist()
        self.large = list(zip(large.tolist(), [0, *ends], ends))
        self.at = ends[-1] if ends else 0
        few = counts[self.small]
        self.valid = np.arange(few.max(initial=0)) < few[:, None]
        self.cls = cls[self.order]
        self.word = target[self.order] - self.cls * PER_CLASS

    def padded(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((*self.valid.shape, rows.shape[1]), rows.dtype)
        out[self.valid] = rows[self.at:]
        return out


def _log_sum(z: np.ndarray) -> np.ndarray:
    """log of the sum of exp of every row; ``z`` is used up."""
    # no shift is needed unless logits are very large or very small
    if z.max(initial=0) < 40 and z.min(initial=0) > -40:
        np.exp(z, out=z)
        return np.log(z @ np.ones(z.shape[1], z.dtype))
    m = z.max(axis=1)
    return m + np.log(np.exp(z - m[:, None]).sum(1))


def _softmax(z: np.ndarray, scale: float) -> None:
    """Replaces the logits of every row by their softmax times ``scale``."""
    # no shift is needed unless logits are very large or very small
    if not (z.max() < 40 and z.min() > -40):
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    z *= (scale / total)[:, None]


def train(net: Network, examples: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = RATE) -> int:
    """Adagrad over batches of (window, target); returns the number of examples."""
    square = np.full(Network.SIZE, 1e-4, np.float32)
    grad, step = Network(np.zeros(Network.SIZE, np.float32)), np.empty(Network.SIZE, np.float32)
    n = 0
    for window, target in examples:
        for at in range(0, len(target), BATCH):
            net.gradient(window[at:at + BATCH], target[at:at + BATCH], grad)
            np.multiply(grad.flat, grad.flat, out=step)
            square += step
            np.sqrt(square, out=step)
            np.divide(grad.flat, step, out=step)
            step *= rate
            net.flat -= step
        n += len(target)
    return n


def masked(lengths: np.ndarray, r: int) -> np.ndarray:
    """The words that are targets in round ``r``: each place of a document in one round."""
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.flatnonzero((place + r) % ROUNDS == 0)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all documents, counted inside tasks first."""
    ship_package(docs.sparkSession)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        held: list[tuple] = []

        def merged() -> tuple:
            return counted(pa.concat_arrays([w for w, _ in held]), np.concatenate([n for _, n in held]))

        def rows(words, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([words, pa.array(n)], names=["word", "n"])
        for b in batches:
            for _, _, part in _text_slices(b.column(0)):
                chunks, n = counted(split_words(part)[0])
                held.append((bare_words(chunks), n))
                if sum(len(n) for _, n in held) > 2 * CACHE_MAX:
                    held = [merged()]
                    if len(held[0][1]) > CACHE_MAX:
                        yield rows(*held.pop())
        if held:
            yield rows(*merged())
    return (docs.select(F.col("text").cast("string")).mapInArrow(work, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _text_slices(column) -> Iterator[tuple]:
    """Rows of an Arrow column of texts, about ``SLICE_BYTES`` at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc
    column = column.cast(pa.string())
    for at, end in spans(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), SLICE_BYTES):
        yield at, end, column.slice(at, end - at)


def rare_counts(counts: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """``word, n, bucket`` of the counted words outside the vocabulary."""
    shared = counts.sparkSession.sparkContext.broadcast(vocab)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            words = b.column(0).to_pylist()
            out = np.array([w not in shared.value for w in words], bool)
            keys = pa.array([rare_id(w) - (VOCAB - RARE) for w in words], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keys], names=["word", "n", "bucket"]).filter(pa.array(out))
    return counts.select("word", "n").mapInArrow(work, "word string, n long, bucket int")


def frequent(rare: DataFrame) -> DataFrame:
    """The rare words from some count on, at most ``KNOWN``; found without a sort."""
    size = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for r in sorted(rare.groupBy(size.alias("size")).count().collect(), reverse=True):     # 8 rows per power of 2
        total += r["count"]
        if total > KNOWN:
            break
        least = r["size"]
    return rare.limit(0) if least is None else rare.filter(size >= least)


CODED = "uid long, doc_id long, n_tokens long, ids binary, gain double, rare array<string>"


def coded(docs: DataFrame, vocab: dict[str, int], rare: DataFrame) -> DataFrame:
    """Every document as 16-bit ids, with the sum of log n over its rare words
    that are ``frequent``, and its other rare words."""
    spark = docs.sparkSession
    ship_package(spark)
    known = frequent(rare).toArrow()                                                # at most ``KNOWN`` rows
    first = sorted(vocab, key=vocab.get)
    shared = spark.sparkContext.broadcast((first + known["word"].to_pylist(), known["bucket"].to_numpy(), known["n"].to_numpy()))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        words, buckets, n = shared.value
        value_set = pa.array(words, pa.string())
        plain = len(words) - len(n)
        id_of = np.concatenate((np.arange(plain), buckets + (VOCAB - RARE))).astype("<u2")
        gain_of = np.concatenate((np.zeros(plain), np.log(n.astype(np.float64))))
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            for at, end, part in _text_slices(b.column(1)):
                flat, lengths = split_words(part)
                chunks = flat.dictionary_encode()
                code = chunks.indices.to_numpy(zero_copy_only=False)
                distinct = bare_words(chunks.dictionary)
                place = pc.index_in(distinct, value_set=value_set).fill_null(-1).to_numpy(zero_copy_only=False)
                new = np.flatnonzero(place < 0)
                ids, gains = np.zeros(len(place), "<u2"), np.zeros(len(place))
                ids[place >= 0], gains[place >= 0] = id_of[place[place >= 0]], gain_of[place[place >= 0]]
                ids[new] = [rare_id(w) for w in distinct.take(pa.array(new)).to_pylist()]
                lone = np.flatnonzero((place < 0)[code])
                ends = np.concatenate(([0], np.cumsum(lengths)))
                data = ids[code].tobytes()
                uids = pa.array(np.arange(uid, uid + end - at))
                uid += end - at
                yield pa.RecordBatch.from_arrays(
                    [uids, b.column(0).slice(at, end - at), pa.array(lengths),
                     pa.array([data[2 * i:2 * j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()),
                     pa.array(sums(gains[code], lengths)),
                     pa.ListArray.from_arrays(pa.array(np.searchsorted(lone, ends).astype(np.int32)), distinct.take(pa.array(code[lone])))],
                    names=["uid", "doc_id", "n_tokens", "ids", "gain", "rare"])
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, CODED)


def _ids(lengths, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of coded documents, about ``SLICE_WORDS`` words at a time: their lengths and ids."""
    sizes = lengths.to_numpy(zero_copy_only=False)
    for at, end in spans(sizes, SLICE_WORDS):
        data = b"".join(column.slice(at, end - at).to_pylist())
        yield at, end, sizes[at:end], np.frombuffer(data, "<u2").astype(np.int64)


def fit(docs: DataFrame) -> tuple[dict[str, int], Network, np.ndarray, DataFrame]:
    """Vocabulary, network, counts of the rare buckets and counts of the words in them."""
    return _fit(docs)[0]


def _fit(docs: DataFrame) -> tuple[tuple[dict[str, int], Network, np.ndarray, DataFrame], DataFrame]:
    """What ``fit`` returns, and the documents it learned from as ids."""
    counts = on_disk(word_counts(docs))
    top = counts.orderBy(F.desc("n"), "word").limit(VOCAB - RARE).collect()     # a fixed number
    vocab = {r["word"]: i for i, r in enumerate(top)}
    freq = np.zeros(VOCAB)
    freq[:len(top)] = [r["n"] for r in top]
    rare = on_disk(rare_counts(counts, vocab))
    counts.unpersist()
    for b in rare.groupBy("bucket").agg(F.sum("n").alias("n")).collect():       # RARE rows
        freq[VOCAB - RARE + b["bucket"]] = b["n"]
    # a checkpoint keeps the tasks' shares of the documents, so each round trains the same copies
    texts = materialize(coded(docs, vocab, rare))
    net = Network.start(freq)
    for r in range(ROUNDS):
        net = _round(texts, net, r)
    return (vocab, net, freq[VOCAB - RARE:], rare), texts


def _round(texts: DataFrame, net: Network, r: int) -> Network:
    """Every task trains a copy on its own documents; the copies are averaged."""
    shared = texts.sparkSession.sparkContext.broadcast(net.flat)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        mine = Network(shared.value.copy())
        part = TaskContext.get().partitionId()

        def examples() -> Iterator:
            held, size = [], 0
            for b in batches:
                for _, _, lengths, ids in _ids(b.column(0), b.column(1)):
                    if not len(ids):
                        continue
                    pick = masked(lengths, r)
                    held.append((windows(ids, lengths, pick), ids[pick]))
                    size += len(pick)
                    if size >= 4 * BATCH:
                        yield tuple(np.concatenate(c) for c in zip(*held))
                        held, size = [], 0
            if size:
                yield tuple(np.concatenate(c) for c in zip(*held))
        n = train(mine, examples(), RATE / (1 + r))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([mine.flat.tobytes()], pa.binary())], names=["part", "n", "w"])

    def mean(pdf):
        import pandas as pd
        n = pdf["n"].to_numpy()
        w = sum(np.frombuffer(b, np.float32) * (k / n.sum()) for b, k in zip(pdf["w"], n))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN_IN], "n": [n.sum()], "w": [w.astype(np.float32).tobytes()]})
    copies = texts.select("n_tokens", "ids").mapInArrow(work, "part long, n long, w binary")
    parts = texts.rdd.getNumPartitions()
    while parts > 1:
        copies = copies.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(mean, "part long, n long, w binary")
        parts = -(-parts // FAN_IN)
    got = staged(copies, "lm-copies").first()                                   # one row, or none without words
    return Network(np.frombuffer(got["w"], np.float32).copy()) if got else net


def score(docs: DataFrame, fitted: tuple[dict[str, int], Network, np.ndarray, DataFrame]) -> DataFrame:
    """``doc_id, n_tokens, pseudo_log_likelihood, mean_log_prob`` of every document."""
    vocab, _, _, rare = fitted
    return _score(materialize(coded(docs, vocab, rare)), fitted)


def _score(texts: DataFrame, fitted: tuple[dict[str, int], Network, np.ndarray, DataFrame]) -> DataFrame:
    _, net, sizes, rare = fitted
    shared = texts.sparkSession.sparkContext.broadcast((net.flat, np.log(np.maximum(sizes, 1))))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        flat, log_sizes = shared.value
        model = Network(flat)
        for b in batches:
            for at, end, n, ids in _ids(b.column(2), b.column(3)):
                lp = model.score(ids, n)
                out = np.flatnonzero(ids >= VOCAB - RARE)
                lp[out] -= log_sizes[ids[out] - (VOCAB - RARE)]
                total = sums(lp, n) + b.column(4).slice(at, end - at).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, end - at) for i in range(3)), pa.array(total)],
                                                 names=["uid", "doc_id", "n_tokens", "base"])
    # all but the words whose own counts are still to be found
    base = texts.drop("rare").mapInArrow(work, "uid long, doc_id long, n_tokens long, base double")
    often = rare.filter("n > 1").select("word", F.log(F.col("n").cast("double")).alias("g"))       # log 1 adds nothing
    gain = (texts.select("uid", F.explode("rare").alias("word")).join(often, "word")
                .groupBy(F.col("uid").alias("_uid")).agg(F.sum("g").alias("g")))
    total = F.col("base") + F.coalesce(F.col("g"), F.lit(0.0))
    return (base.join(gain, F.col("uid") == F.col("_uid"), "left")
                .select("doc_id", "n_tokens", total.alias("pseudo_log_likelihood"),
                        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob")))


@register("op4_lm_score")
def op4_lm_score(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    fitted, texts = _fit(docs)
    return _score(texts, fitted)
