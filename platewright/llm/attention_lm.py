"""A small causal self-attention language model over subword ids, trained and applied in numpy inside Spark tasks.

The output is factored. Attention over the last ids gives a class distribution; inside its class an id is drawn
by counts given the id before. Both sum to one, so the score is a proper log-probability of the text: its
lower-cased words, in subwords, and an end. Counts come from all training texts, by way of the table of distinct
words, so each word is cut into subwords once. The attention weights are trained by rounds of local descent on all
training texts, averaged between rounds.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.llm.store import saved
from platewright.llm.words import blank_words, crc_mod, utf8

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pre-splitting pattern that belongs to the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A longer word is cut every so many bytes before it is split into subwords; nothing is left out.
LONGEST_WORD = 200
# A word held by at least 1 / 2^19 of all tokens is common: there are at most 2^19 of them, known to every task.
COMMON_BITS = 19
FLUSH = 600_000

WINDOW, STRIDE = 32, 24
KEY_DIM, DIM = 8, 16
OWN_ROWS, OWN_CLASSES, START_CLASSES, INNER_CLASSES = 1024, 44, 24, 18
CONTEXTS, FOLLOWERS = 512, 128
ALPHA = 5.0
CHUNK = 64
# Windows of a training step.
BATCH = 128
# Distinct words whose ids a task keeps.
KEPT_WORDS = 300_000
# Words that a task of a training round learns from. Each task sends its weights, so this bounds what a round shuffles.
TASK_WORDS = 400_000
# Bytes of text that a scoring task works on at a time.
SLICE_BYTES = 1 << 20


def _encoding(blob: bytes, pattern: str) -> tiktoken.Encoding:
    """The tokenizer from the bytes of its rank file, kept per worker process."""
    key = md5(blob).hexdigest()
    if key not in _ENCODINGS:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}
        _ENCODINGS[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def subwords(encoding: tiktoken.Encoding, words: list[bytes]) -> list[int]:
    """Ids of the words, each with a blank before it."""
    if not words:
        return []
    if max(map(len, words)) <= LONGEST_WORD:
        return encoding.encode_ordinary(" " + b" ".join(words).decode("utf-8", "replace"))
    out: list[int] = []
    for w in words:
        out += encoding.encode_ordinary(" " + w[:LONGEST_WORD].decode("utf-8", "replace"))
        for i in range(LONGEST_WORD, len(w), LONGEST_WORD):
            out += encoding.encode_ordinary(w[i : i + LONGEST_WORD].decode("utf-8", "replace"))
    return out


# -- counts over the whole corpus ------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their numbers in training texts and in all, added up per task."""
    train: Counter = Counter()
    rest: Counter = Counter()

    def flush() -> pa.RecordBatch:
        # A word of both kinds of text is two rows here; the aggregate adds them up.
        words = pa.array([*train, *rest], pa.binary())
        n = np.fromiter((*train.values(), *rest.values()), dtype=np.int64, count=len(words))
        learnt = np.where(np.arange(len(n)) < len(train), n, 0)
        train.clear()
        rest.clear()
        return pa.RecordBatch.from_arrays([words, pa.array(learnt), pa.array(n)], ["word", "n_train", "n_all"])

    for batch in batches:
        for raw, held in zip(batch.column("raw").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
            (rest if held else train).update(blank_words(raw))
            if len(train) + len(rest) > FLUSH:
                yield flush()
    yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """``raw, held_out`` -> ``word, n_train, n_all`` over all texts, written."""
    parts = texts.mapInArrow(_count_words, "word binary, n_train long, n_all long")
    return saved(parts.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")), "words")


def _pairs(blob, pattern: str):
    """Neighbouring subwords inside training words, weighted; -1 stands before a word's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(blob.value, pattern)
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            pairs = np.array(list(counts.keys()), dtype=np.int64).reshape(-1, 2)
            n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], ["prev", "id", "n"])

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n_train").to_pylist(), strict=True):
                last = -1
                for i in subwords(encoding, [word]):
                    counts[last, i] += n
                    last = i
            if len(counts) > FLUSH:
                yield flush()
        yield flush()

    return run


# -- the model --------------------------------------------------------------------------------------------------


class Layout:
    """Rows, classes and contexts of ids, and what counts say: P(id | class, id before) and P(class | id before).

    ``unigram`` and ``opening``: occurrences of each id in training words, and of those that open a word. ``pairs``:
    arrays (context, id, n) of neighbours inside words; ``following``: arrays (id, context of the next, n), which
    tell ids that open words apart by what follows them. Sizes are bounded by the vocabulary.
    """

    def __init__(
        self, vocabulary: int, starts: np.ndarray, unigram: np.ndarray, opening: np.ndarray,
        pairs: tuple, following: tuple, ends: int,
    ):
        self.end, self.begin = vocabulary, vocabulary + 1
        own = by_count(unigram)
        used = np.append(own, self.end)
        # One column per id that occurs and one that all others share.
        column = np.full(vocabulary + 1, len(used))
        column[used] = np.arange(len(used))
        context, seen, n = pairs
        table = np.zeros((CONTEXTS, len(used)))
        np.add.at(table, (context, column[seen]), n)
        smooth = np.append(unigram[own], ends) + 0.1
        self.classes = 2 + OWN_CLASSES + START_CLASSES + INNER_CLASSES
        cls = np.full(len(used), -1)
        cls[-1] = 0
        cls[: min(OWN_CLASSES, len(own))] = 1 + np.arange(min(OWN_CLASSES, len(own)))
        at = np.append(starts[own], False)
        base = 1 + OWN_CLASSES
        lead, nxt, many = following
        after = np.zeros((len(used) + 1, FOLLOWERS))
        np.add.at(after, (column[lead], np.minimum(nxt, FOLLOWERS - 1)), many)
        first = np.flatnonzero((cls < 0) & at)
        cls[first] = base + _clusters(after[first], smooth[first], START_CLASSES)
        inner = np.flatnonzero(cls < 0)
        cls[inner] = base + START_CLASSES + _clusters(table[:, inner].T, smooth[inner], INNER_CLASSES)
        others = max(1, vocabulary - len(own))
        self.column_of = column.astype(np.int32)
        self.class_of = np.append(cls, self.classes - 1)[column].astype(np.int32)
        self.context_of = np.append(contexts(own, starts), [CONTEXTS - 1, CONTEXTS - 1]).astype(np.int32)
        rows = np.empty(vocabulary + 2, dtype=np.int32)
        rows[: vocabulary + 1] = OWN_ROWS + self.class_of
        rows[own[:OWN_ROWS]] = np.arange(len(own[:OWN_ROWS]))
        rows[self.begin] = OWN_ROWS + self.classes
        self.row_of, self.rows = rows, OWN_ROWS + self.classes + 1

        per_class = np.bincount(cls, weights=smooth, minlength=self.classes)
        prior = smooth / per_class[cls]
        sums = np.stack([np.bincount(cls, weights=t, minlength=self.classes) for t in table])
        within = np.log((table + ALPHA * prior) / (sums[:, cls] + ALPHA))
        self.within = np.column_stack([within, np.full(CONTEXTS, -np.log(others))]).astype(np.float32)
        # Where a word ends, the next one opens as words do anywhere, or the text ends.
        per_class[-1] = 0.1 * others
        first = np.bincount(cls, weights=np.append(opening[own], ends) + 1e-3, minlength=self.classes)
        first /= first.sum()
        of_own = self.context_of[own]
        left = np.bincount(of_own, weights=unigram[own], minlength=CONTEXTS) - table.sum(axis=1)
        left[-1] = 1.0
        counts = sums + np.maximum(left, 0)[:, None] * first + 5.0 * per_class / per_class.sum()
        self.jump = np.log(np.maximum(counts, 1e-20) / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def by_count(unigram: np.ndarray) -> np.ndarray:
    """Ids that occur, commonest first, ties by id."""
    order = np.argsort(-unigram, kind="stable")
    return order[unigram[order] > 0]


def contexts(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Context of an id as predecessor: the commonest have their own, the rest one for word starts and one for others."""
    out = np.where(starts, CONTEXTS - 2, CONTEXTS - 3)
    top = own[: CONTEXTS - 3]
    out[top] = np.arange(len(top))
    return out


def _clusters(profiles: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means of predecessor profiles, seeded by the heaviest; ids without counts fall to the nearest mean."""
    if not len(profiles):
        return np.empty(0, dtype=int)
    x = np.sqrt(profiles / np.maximum(profiles.sum(axis=1, keepdims=True), 1.0)).astype(np.float32)
    means = x[np.argsort(-weight, kind="stable")[:k]]
    label = np.zeros(len(x), dtype=int)
    for _ in range(rounds):
        label = np.argmin(np.sum(means**2, axis=1)[None, :] - 2 * x @ means.T, axis=1)
        for c in range(len(means)):
            mine = label == c
            if mine.any():
                means[c] = np.average(x[mine], axis=0, weights=weight[mine])
    return label


SPLITS = (KEY_DIM, 2 * KEY_DIM, 2 * KEY_DIM + DIM)
WIDTH = 2 * KEY_DIM + 2 * DIM
# Weights stay within these bounds, which keeps exponentials in range: no maximum has to be taken off. Scoring
# checks that sums are finite.
MOST = {"rows": 4.0, "out": 4.0, "bias": 8.0, "near": 8.0}
DISTANCE = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]


def initial(layout: Layout, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    rows = rng.normal(0, 0.3, size=(layout.rows, WIDTH))
    return {
        "rows": rows.astype(np.float32),
        "out": rng.normal(0, 0.3, size=(DIM, layout.classes)).astype(np.float32),
        "bias": np.zeros(layout.classes, dtype=np.float32),
        "near": np.zeros(WINDOW, dtype=np.float32),
    }


def _mask(near: np.ndarray) -> np.ndarray:
    return np.where(DISTANCE >= 0, near[np.maximum(DISTANCE, 0)], -1e9).astype(np.float32)


def _attend(p: dict, rows: np.ndarray, mask: np.ndarray):
    """Hidden vectors of windows ``(n, WINDOW)`` of embedding rows, with what a backward pass needs."""
    t = p["rows"].take(rows, axis=0)
    q, k, v, e = np.split(t, SPLITS, axis=-1)
    s = np.matmul(q, k.swapaxes(-1, -2))
    s *= np.float32(KEY_DIM**-0.5)
    s += mask
    np.exp(s, out=s)
    s /= s.sum(axis=-1, keepdims=True)
    z = np.matmul(s, v)
    z += e
    return q, k, v, s, z


class Step:
    """Loss and gradients of batches of up to ``n`` windows, with buffers that are filled again and again.

    The network corrects what the counts say of the next class (``jump``). Weights stay within MOST, so exponentials
    need no maximum taken off; sums along short axes are products with ones.
    """

    def __init__(self, p: dict, n: int, kind=np.float32):
        classes = p["out"].shape[1]
        shape = lambda *d: np.empty(d, kind)
        self.t, self.dt = shape(n, WINDOW, WIDTH), shape(n, WINDOW, WIDTH)
        self.s, self.ds = shape(n, WINDOW, WINDOW), shape(n, WINDOW, WINDOW)
        self.o, self.z, self.h, self.dz = (shape(n, WINDOW, DIM) for _ in range(4))
        self.x, self.more = shape(n * WINDOW, classes), shape(n * WINDOW, classes)
        self.ones, self.each = np.ones(classes, kind), np.ones(WINDOW, kind)
        self.scale = kind(KEY_DIM**-0.5)
        self.g = {name: np.empty_like(v, dtype=kind) for name, v in p.items()}
        self.apart = np.maximum(DISTANCE, 0).ravel()
        self.before = np.tri(WINDOW, dtype=kind).ravel()
        self.column = np.arange(WIDTH)
        self.rowed = np.ones(n * WINDOW, kind)

    def gradients(
        self, p: dict, rows: np.ndarray, target: np.ndarray, jump: np.ndarray, before: np.ndarray, counted: np.ndarray
    ) -> tuple[dict, float]:
        """(gradients, mean loss); they live in the buffers. ``before``: row of ``jump`` at each counted position.

        ``counted`` marks the positions that hold a ``target``, and ``target`` has one entry for each of them.
        """
        n, places = len(rows), np.flatnonzero(counted)
        m = len(places)
        g, t, s, dz = self.g, self.t[:n], self.s[:n], self.dz[:n]
        np.take(p["rows"], rows, axis=0, out=t, mode="clip")
        q, k, v, e = np.split(t, SPLITS, axis=-1)
        q *= self.scale
        np.matmul(q, k.swapaxes(-1, -2), out=s)
        s += _mask(p["near"])
        np.exp(s, out=s)
        s /= (s @ self.each)[..., None]
        o = np.matmul(s, v, out=self.o[:n])
        z = np.add(o, e, out=self.z[:n])
        h = np.maximum(z, 0, out=self.h[:n]).reshape(-1, DIM).take(places, axis=0)
        x = np.matmul(h, p["out"], out=self.x[:m])
        x += np.take(jump, before, axis=0, out=self.more[:m], mode="clip")
        x += p["bias"]
        np.exp(x, out=x)
        total = x @ self.ones
        at = np.arange(m)
        loss = float(np.mean(np.log(total) - np.log(np.maximum(x[at, target], 1e-30))))
        x *= (1.0 / (total * m))[:, None]
        x[at, target] -= x.dtype.type(1.0 / m)
        np.matmul(h.T, x, out=g["out"])
        np.matmul(self.rowed[:m], x, out=g["bias"])
        flat = dz.reshape(-1, DIM)
        if m < len(flat):
            flat[:] = 0
        flat[places] = x @ p["out"].T
        dz *= z > 0
        ds = np.matmul(dz, v.swapaxes(-1, -2), out=self.ds[:n])
        # The weighted mean of a row of ds is what the attended value itself moves by.
        ds -= np.einsum("nwd,nwd->nw", dz, o)[..., None]
        ds *= s
        dt = self.dt[:n]
        dt[..., : SPLITS[0]] = np.matmul(ds, k)
        dt[..., : SPLITS[0]] *= self.scale
        dt[..., SPLITS[0] : SPLITS[1]] = np.matmul(ds.swapaxes(-1, -2), q)
        dt[..., SPLITS[1] : SPLITS[2]] = np.matmul(s.swapaxes(-1, -2), dz)
        dt[..., SPLITS[2] :] = dz
        # One running sum per row and column, over places that count both.
        cell = (rows.reshape(-1, 1) * WIDTH + self.column).ravel()
        g["rows"][:] = np.bincount(cell, weights=dt.ravel(), minlength=g["rows"].size).reshape(-1, WIDTH)
        pulls = ds.sum(axis=0).ravel() * self.before
        g["near"][:] = np.bincount(self.apart, weights=pulls, minlength=WINDOW)
        return g, loss


def train_step(p: dict, rows: np.ndarray, target: np.ndarray, jump: np.ndarray, counted: np.ndarray) -> tuple[dict, float]:
    """Gradients and mean loss of a batch of windows; ``counted`` marks positions that hold a target.

    ``jump``: for those positions, what the counts say of the next class.
    """
    step = Step(p, len(rows), p["rows"].dtype.type)
    return step.gradients(p, rows, target[counted], jump, np.arange(len(jump)), counted)


class Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.room = {k: np.empty_like(v) for k, v in p.items()}

    def step(self, p: dict, g: dict) -> None:
        """One step in place; ``g`` is used up."""
        self.t += 1
        far, wide = 1 - 0.9**self.t, 1 - 0.99**self.t
        for k in p:
            m, v, x, room = self.m[k], self.v[k], g[k], self.room[k]
            np.subtract(x, m, out=room)
            room *= p[k].dtype.type(0.1)
            m += room
            x *= x
            x -= v
            x *= p[k].dtype.type(0.01)
            v += x
            np.multiply(v, p[k].dtype.type(1 / wide), out=room)
            np.sqrt(room, out=room)
            room += p[k].dtype.type(1e-6)
            np.divide(m, room, out=room)
            room *= p[k].dtype.type(self.rate / far)
            p[k] -= room
            np.clip(p[k], -MOST[k], MOST[k], out=p[k])


def windows(lengths: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: positions ``(n, WINDOW)``, which are inside the text, which are to be scored.

    A text's first window scores all its positions, each later one the ``stride`` positions that are new, so every
    position is scored once.
    """
    first = np.concatenate([[0], np.cumsum(lengths)])
    many = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
    many[lengths == 0] = 0
    text = np.repeat(np.arange(len(lengths)), many)
    turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = (first[text] + turn * stride)[:, None] + np.arange(WINDOW)
    inside = at < first[text + 1][:, None]
    scored = inside & ((turn == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - stride))
    return np.minimum(at, max(0, int(first[-1]) - 1)), inside, scored


class Scorer:
    """Scoring of many texts with buffers that stay in the processor's cache and are filled again and again."""

    def __init__(self, p: dict, layout: Layout):
        self.p, self.layout = p, layout
        self.jump = layout.jump + p["bias"]
        self.mask = _mask(p["near"])
        # The scale of the attention logits is put into the query part once.
        self.rows = p["rows"].copy()
        self.rows[:, :KEY_DIM] *= np.float32(KEY_DIM**-0.5)
        f = np.float32
        self.t = np.empty((CHUNK, WINDOW, WIDTH), f)
        self.s = np.empty((CHUNK, WINDOW, WINDOW), f)
        self.z = np.empty((CHUNK, WINDOW, DIM), f)
        self.h = np.empty((CHUNK * WINDOW, DIM), f)
        self.x, self.more = (np.empty((CHUNK * WINDOW, layout.classes), f) for _ in range(2))
        self.ones, self.each = np.ones(layout.classes, f), np.ones(WINDOW, f)

    def logits(self, rows: np.ndarray, places: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Next-class logits at ``places`` (positions of the flattened windows)."""
        n, m = len(rows), len(places)
        t = self.rows.take(rows, axis=0, out=self.t[:n], mode="clip")
        q, k, v, e = np.split(t, SPLITS, axis=-1)
        s = np.matmul(q, k.swapaxes(-1, -2), out=self.s[:n])
        s += self.mask
        np.exp(s, out=s)
        z = np.matmul(s, v, out=self.z[:n])
        z /= (s @ self.each)[..., None]
        z += e
        h = z.reshape(-1, DIM).take(places, axis=0, out=self.h[:m], mode="clip")
        np.maximum(h, 0, out=h)
        x = np.matmul(h, self.p["out"], out=self.x[:m])
        x += self.jump.take(before, axis=0, out=self.more[:m], mode="clip")
        return x

    def log_probability(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each id sequence and its end."""
        layout = self.layout
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        if not len(lengths):
            return np.empty(0)
        rows, cls, before, goal = _laid_out(layout, texts, lengths)
        value = layout.within[before, layout.column_of.take(goal)].astype(np.float64)
        at, _, scored = windows(lengths, STRIDE)
        for i in range(0, len(at), CHUNK):
            here = at[i : i + CHUNK]
            places = np.flatnonzero(scored[i : i + CHUNK])
            where = here.ravel().take(places)
            x = self.logits(rows.take(here), places, before.take(where))
            mine = x[np.arange(len(where)), cls.take(where)]
            np.exp(x, out=x)
            total = x @ self.ones
            if not np.isfinite(total).all():
                raise FloatingPointError("attention logits out of range")
            value[where] += mine - np.log(total)
        return np.add.reduceat(value, np.cumsum(lengths) - lengths)


def log_probability(p: dict, layout: Layout, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each id sequence and its end."""
    return Scorer(p, layout).log_probability(texts)


# -- distributed training ---------------------------------------------------------------------------------------


def _local_rounds(model, rate: float, kind):
    """One pass of descent over a task's texts from the shared weights; yields token-weighted weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, start = pickle.loads(model.value)
        p = {k: v.copy() for k, v in start.items()}
        adam, step, seen = Adam(p, rate), Step(p, BATCH), 0
        held: list[np.ndarray] = []

        def learn() -> None:
            nonlocal seen
            lengths = np.array([len(t) + 1 for t in held])
            rows, cls, before, _ = _laid_out(layout, held, lengths)
            at, inside, _ = windows(lengths, WINDOW)
            order = np.random.default_rng(len(at)).permutation(len(at))
            for i in range(0, len(at), BATCH):
                some = order[i : i + BATCH]
                put, counted = at[some], inside[some]
                where = put[counted]
                g, _ = step.gradients(p, rows.take(put), cls.take(where), layout.jump, before.take(where), counted)
                adam.step(p, g)
            seen += len(rows)
            held.clear()

        size = 0
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                held.append(np.frombuffer(raw, dtype=kind))
                size += len(held[-1])
                if size > 200_000:
                    learn()
                    size = 0
        if held:
            learn()
        if seen:
            yield _packed({k: v * np.float64(seen) for k, v in p.items()}, seen)

    return run


def _laid_out(layout: Layout, texts: list[np.ndarray], lengths: np.ndarray):
    """For texts laid end to end, each with its end: embedding rows, classes, contexts and what is to come."""
    ends = np.cumsum(lengths)
    goal = np.empty(int(ends[-1]), dtype=np.int64)
    given = np.empty_like(goal)
    inner = np.ones(len(goal), dtype=bool)
    inner[ends - 1] = False
    goal[inner] = np.concatenate(texts) if texts else ()
    goal[ends - 1] = layout.end
    given[1:] = goal[:-1]
    given[ends - lengths] = layout.begin
    return layout.row_of.take(given), layout.class_of.take(goal), layout.context_of.take(given), goal


def _packed(sums: dict, seen: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"sums": pa.array([pickle.dumps(sums)], pa.binary()), "seen": pa.array([seen], pa.int64())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = None, 0
    for batch in batches:
        for blob, n in zip(batch.column("sums").to_pylist(), batch.column("seen").to_pylist(), strict=True):
            one = pickle.loads(blob)
            total = one if total is None else {k: total[k] + one[k] for k in one}
            seen += n
    if total is not None:
        yield _packed(total, seen)


def train(texts: DataFrame, layout: Layout, kind, tasks: int, rounds: int, rate: float) -> dict:
    """Rounds of local descent on ``ids`` and averaging. Sums are added over two levels of tasks; one row reaches the driver."""
    sc = texts.sparkSession.sparkContext
    p = initial(layout)
    spread = saved(texts.repartition(tasks), "training")
    for k in range(rounds):
        model = sc.broadcast(pickle.dumps((layout, p)))
        schema = "sums binary, seen long"
        sums = spread.mapInArrow(_local_rounds(model, rate * 0.5**k, kind), schema)
        if tasks > 8:
            sums = sums.repartition(math.isqrt(tasks)).mapInArrow(_added, schema)
        row = sums.coalesce(1).mapInArrow(_added, schema).first()
        if row is None:
            break
        p = {name: (v / row["seen"]).astype(np.float32) for name, v in pickle.loads(bytes(row["sums"])).items()}
        model.unpersist()
    return p


# -- scoring ----------------------------------------------------------------------------------------------------

PARTS = "n_tokens long, n_known long, base double, ids binary, rare array<struct<word:binary,n:int>>"
RARE = pa.struct([("word", pa.binary()), ("n", pa.int32())])


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded bytes of ``column``."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size += n
        if size > SLICE_BYTES:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _prepare(common, blob, pattern: str, end_count: int, kind):
    """Per text: subword ids, common words' part of the base sum, and the other words with counts.

    Columns besides ``raw`` pass through. A word's ids are kept for the next time it occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs: dict[bytes, tuple[float, bool]] = common.value
        encoding = _encoding(blob.value, pattern)
        ending = math.log10(end_count + 0.1)
        known_ids: dict[bytes, bytes] = {}

        def prepared(rows: pa.RecordBatch) -> pa.RecordBatch:
            tokens, known, base, ids = [], [], [], []
            rare_words, rare_counts, offsets = [], [], [0]
            for raw in rows.column("raw").to_pylist():
                words = blank_words(raw)
                total, sure = ending, int(end_count > 0)
                if len(known_ids) > KEPT_WORDS:
                    known_ids.clear()
                for w, n in Counter(words).items():
                    entry = logs.get(w)
                    if entry is None:
                        rare_words.append(w)
                        rare_counts.append(n)
                    else:
                        total += n * entry[0]
                        sure += n * entry[1]
                    if w not in known_ids:
                        known_ids[w] = np.array(subwords(encoding, [w]), dtype=kind).tobytes()
                tokens.append(len(words) + 1)
                known.append(sure)
                base.append(total)
                offsets.append(len(rare_words))
                ids.append(b"".join([known_ids[w] for w in words]))
            pairs = [pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int32())]
            rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(pairs, fields=list(RARE)))
            kept = [c for c in rows.schema.names if c != "raw"]
            return pa.RecordBatch.from_arrays(
                [rows.column(c) for c in kept]
                + [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(ids, pa.binary()), rare],
                [*kept, "n_tokens", "n_known", "base", "ids", "rare"],
            )

        for batch in batches:
            for part in _slices(batch, "raw"):
                yield prepared(part)

    return run


def _score(model, kind):
    """The model's log10 score of ``ids``; other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, p = pickle.loads(model.value)
        scorer = Scorer(p, layout)
        for batch in batches:
            for part in _slices(batch, "ids"):
                ids = [np.frombuffer(x, dtype=kind) for x in part.column("ids").to_pylist()]
                score = pa.array(scorer.log_probability(ids) / math.log(10))
                kept = [c for c in part.schema.names if c != "ids"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], score], [*kept, "score"])

    return run


def score_texts(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    tokenizer: str = TOKENIZER,
    pattern: str = PATTERN,
    rounds: int = 3,
    rate: float = 0.02,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Texts whose crc32(doc_id) mod 10 is not 0 are learnt from. ``base_score`` is the add-0.1 unigram score over
    words and an end; ``score`` the attention model's log10-probability. Attention weights are trained on
    all of them, as every count covers all of them. Texts are split into subwords once; training and scoring read
    the ids. Words above 1 / 2^19 of all tokens are scored in place from a
    broadcast of at most 2^19 words; the others are joined with the word table, where none of them is hot.

    Null and empty texts are one end. A null id is learnt from and never held out; repeated rows keep a row each;
    an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    held_out = F.coalesce(crc_mod(F.col(doc_id), 10) == 0, F.lit(False))
    texts = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), utf8(F.col(text)).alias("raw"))
    counts = word_counts(texts.select("raw", "held_out"))
    known = F.coalesce(F.sum((F.col("n_train") > 0).cast("long")), F.lit(0))
    n_words, n_distinct, n_all = counts.agg(
        F.coalesce(F.sum("n_train"), F.lit(0)), known, F.coalesce(F.sum("n_all"), F.lit(0))
    ).first()
    ends = texts.where(~F.col("held_out")).count()
    total, distinct = n_words + ends, n_distinct + int(ends > 0)
    floor = max(1, -(-n_all >> COMMON_BITS))
    listed = counts.where(F.col("n_all") >= floor).select("word", "n_train").toPandas()
    logs = {bytes(w): (math.log10(c + 0.1), c > 0) for w, c in zip(listed["word"], listed["n_train"].tolist(), strict=True)}
    common = sc.broadcast(logs)

    with open(tokenizer, "rb") as f:
        ranks = f.read()
    blob, encoding = sc.broadcast(ranks), _encoding(ranks, pattern)
    vocabulary = encoding.max_token_value + 1
    starts = np.array([encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(vocabulary)])
    pairs = counts.where("n_train > 0").select("word", "n_train").mapInArrow(_pairs(blob, pattern), "prev long, id long, n long")
    pairs = saved(pairs.groupBy("prev", "id").agg(F.sum("n").alias("n")), "pairs")
    layout = fitted_layout(pairs, vocabulary, starts, ends)

    kind = np.uint16 if vocabulary <= 1 << 16 else np.int32
    numbered = texts.withColumn("rid", F.monotonically_increasing_id())
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.drop("raw").schema.fields)
    prepared = saved(numbered.mapInArrow(_prepare(common, blob, pattern, ends, kind), f"{kept}, {PARTS}"), "prepared")
    tasks = max(1, total // TASK_WORDS)
    p = train(prepared.where(~F.col("held_out")).select("ids"), layout, kind, tasks, rounds, rate)
    model = sc.broadcast(pickle.dumps((layout, p)))
    passed = prepared.drop("rare")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in passed.drop("ids").schema.fields)
    scored = passed.mapInArrow(_score(model, kind), f"{fields}, score double")
    rare = prepared.select("rid", F.explode("rare").alias("w")).select("rid", F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    seen = counts.where(F.col("n_all") < floor).select("word", "n_train")
    other = rare.join(seen, "word").groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.col("n_train") + F.lit(0.1))).alias("more"),
        F.sum(F.when(F.col("n_train") > 0, F.col("n")).otherwise(0)).alias("more_known"),
    )
    per_token = F.lit(math.log10(total + 0.1 * (distinct + 1)))
    out = scored.join(other, "rid", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
    )


def fitted_layout(pairs: DataFrame, vocabulary: int, starts: np.ndarray, ends: int) -> Layout:
    """The layout from neighbour counts ``prev, id, n``; prev -1 opens a word.

    Collects one row per id and at most CONTEXTS rows per id: the size of the model, whatever the corpus.
    """
    opens = F.sum(F.when(F.col("prev") < 0, F.col("n")).otherwise(0))
    singles = pairs.groupBy("id").agg(F.sum("n").alias("n"), opens.alias("opens")).toPandas()
    unigram, opening = np.zeros(vocabulary), np.zeros(vocabulary)
    unigram[singles["id"].to_numpy(dtype=np.int64)] = singles["n"].to_numpy(dtype=float)
    opening[singles["id"].to_numpy(dtype=np.int64)] = singles["opens"].to_numpy(dtype=float)
    place = contexts(by_count(unigram), starts)
    # One entry per id of the vocabulary; -1 has none and drops out.
    place = pd.DataFrame({"i": np.arange(vocabulary), "context": place}).astype("int64")
    place = F.broadcast(pairs.sparkSession.createDataFrame(place))
    near = pairs.join(place.withColumnRenamed("i", "prev"), "prev").groupBy("context", "id").agg(F.sum("n").alias("n"))
    nexts = pairs.where("prev >= 0").join(place.withColumnRenamed("i", "id"), "id")
    nexts = nexts.withColumn("context", F.least(F.col("context"), F.lit(FOLLOWERS - 1)))
    nexts = nexts.groupBy("prev", "context").agg(F.sum("n").alias("n"))
    arrays = lambda rows, *names: tuple(rows[c].to_numpy(dtype=np.int64) for c in names)
    return Layout(
        vocabulary, starts, unigram, opening,
        arrays(near.toPandas(), "context", "id", "n"), arrays(nexts.toPandas(), "prev", "context", "n"), ends,
    )
