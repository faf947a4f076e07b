"""Toxicity as a weighted finite-state grammar over clauses.

Words are mapped to classes (insult, intent, violence, target, negation, report). Small deterministic
transducers rewrite the class string of a clause: negation and reported speech weaken what follows, a target
sharpens it, and intent + violence + target makes a threat. They are composed into one machine, which is run
over every clause that holds an insult or an act of violence. The lexicon of insults is weighted: beside the listed
words it holds word stems learnt jointly from labelled rows, so that several weak stems add up, and what the machine
makes of a stem in its clause scales it. The score is a logistic model of the matched clauses.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.llm.store import saved
from platewright.llm.words import crc_mod

# Word lists of the grammar. Words of a corpus are not listed here: they are learnt from its training rows.
INSULTS = """imbecile dumbass bastard degenerate vermin subhuman
dummkopf abschaum trottel versager arschloch
connard imbécile ordure salaud abruti
estúpido imbécil basura gilipollas pendejo""".split()
VIOLENCE = """kill murder hurt destroy stab strangle töten umbringen verletzen
tuer frapper détruire matar golpear destruir""".split()
INTENT = "will gonna shall going want werde wirst will vais va voy vamos".split()
TARGETS = """you your yourself he she they them him her people those these du dich dir ihr euch sie
tu toi te vous ils elles usted ustedes ellos ellas""".split()
NEGATIONS = "not never isn't aren't wasn't don't nicht kein keine pas jamais nunca jamás".split()
REPORTS = """said says say called calls wrote quoted claimed sagte nannte schrieb dit disait écrit
dijo llamó escribió""".split()

BREAK = re.compile(r"[.!?;:\n\r。！？；：।؟۔]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
PART = re.compile(r"[^'’]+")
# Scripts written without blanks between words: a word may begin at any of their letters.
SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
NEGATED_FOR, REPORTED_FOR, INTENT_FOR = 3, 8, 4
# Output classes of the composed machine, with the prior weight of one matched clause.
PRIOR = {"insult": 2.5, "at target": 3.0, "negated": 0.5, "reported": 0.5, "threat": 3.0, "violence": 0.5}
PRIOR_BIAS = -3.0
# What is left of a learnt stem in a clause that negates or reports it.
KEPT = {"negated": 0.3, "reported": 0.3}
# Bounds of the fit: labelled rows, and stems of the lexicon.
SAMPLE, MOST_STEMS = 12_000, 60_000
# Standard deviations by which a stem's log-odds must stand out to be tried.
STANDS_OUT = 2.0


class Transducer:
    """Deterministic letter transducer: ``step(state, letter) -> (state, letter)``."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this machine writes, the other reads."""

        def step(state, letter):
            a, out = self.step(state[0], letter)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self, letters: str) -> dict:
        """All reachable transitions, spelled out."""
        todo, seen, rows = [self.start], {self.start}, {}
        while todo:
            s = todo.pop()
            for x in letters:
                rows[s, x] = nxt, _ = self.step(s, x)
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return rows


def _countdown(opener: str, length: int, changes: dict[str, str]) -> Transducer:
    """For ``length`` letters after ``opener``, letters in ``changes`` are rewritten."""

    def step(left, x):
        if x == opener:
            return length, x
        out = changes.get(x, x) if left else x
        return max(0, left - 1), out

    return Transducer(0, step)


def _threats() -> Transducer:
    """Violence after intent becomes a threat."""

    def step(left, x):
        if x == "f":
            return INTENT_FOR, x
        out = "T" if x == "v" and left else x
        return max(0, left - 1), out

    return Transducer(0, step)


def _targets() -> Transducer:
    """An insult in a clause that names a target before it is aimed."""

    def step(seen, x):
        return (1 if x == "y" else seen), ("I" if x == "i" and seen else x)

    return Transducer(0, step)


# Letters: i insult, v violence, f intent, y target, n negation, r report, . other.
LETTERS = "ivfynr."
MACHINE = (
    _countdown("n", NEGATED_FOR, {"i": "j", "v": "w"})
    .then(_countdown("r", REPORTED_FOR, {"i": "q", "v": "w"}))
    .then(_threats())
    .then(_targets())
)
START, TABLE = MACHINE.start, MACHINE.table(LETTERS + "jqw")
OUTPUT = {"i": "insult", "I": "at target", "j": "negated", "q": "reported", "T": "threat", "v": "violence"}
NAMES = list(PRIOR)


CACHED_WORDS = 200_000


class Grammar:
    """The lexicon with learnt stems, ready to match. ``stems``: stem -> strength."""

    def __init__(self, stems: dict[str, float]):
        self.words = {}
        for letter, listed in (("y", TARGETS), ("f", INTENT), ("n", NEGATIONS), ("r", REPORTS)):
            self.words.update(dict.fromkeys(listed, letter))
        self.stems = stems
        self.listed = dict.fromkeys(VIOLENCE, "v") | dict.fromkeys(INSULTS, "i")
        self.lengths = sorted({len(w) for w in self.listed.keys() | stems.keys()})
        self.known: dict[str, tuple[str, bool, tuple[str, ...], bool]] = {}

    def entry(self, word: str) -> tuple[str, bool, tuple[str, ...], bool]:
        """A word's letter, whether a listed word begins it, the learnt stems that do, and whether any does; kept.

        A word begins after an apostrophe too, and at any letter of a script without blanks.
        """
        found = self.known.get(word)
        if found is None:
            letter, listed, stems = self.words.get(word, "."), False, []
            begins = {m.start() for m in PART.finditer(word)} | {m.start() for m in SPACELESS.finditer(word)}
            for at in sorted(begins):
                for k in self.lengths:
                    head = word[at : at + k]
                    if len(head) < k:
                        break
                    if head in self.listed:
                        letter, listed = self.listed[head], True
                    if head in self.stems:
                        stems.append(head)
            if stems and not listed:
                letter = "i"
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            found = self.known[word] = (letter, listed, tuple(dict.fromkeys(stems)), listed or bool(stems))
        return found

    def clauses(self, low: str) -> tuple[list[tuple[set[str], dict[str, str]]], int]:
        """Per clause with hits: classes of listed words, class of each stem; and the number of clauses."""
        out, n, known, entry = [], 0, self.known, self.entry
        for clause in BREAK.split(low):
            if not clause or clause.isspace():
                continue
            n += 1
            # Looked up here first: most words are known by now.
            entries = [known.get(w) or entry(w) for w in TOKEN.findall(clause)]
            if not [1 for e in entries if e[3]]:
                continue
            state, listed, stems = START, set(), {}
            for letter, is_listed, own, hit in entries:
                state, output = TABLE[state, letter]
                if hit:
                    name = OUTPUT.get(output)
                    if is_listed and name:
                        listed.add(name)
                    for s in own:
                        # The strongest reading of a stem in the clause counts.
                        if s not in stems or stems[s] in KEPT:
                            stems[s] = name if name in KEPT or name == "at target" else "insult"
            out.append((listed, stems))
        return out, max(1, n)

    def features(self, text: str) -> list[float]:
        """Per output class: sum over clauses of 1 for a listed word and the strengths of its learnt stems."""
        sums = dict.fromkeys(NAMES, 0.0)
        for listed, stems in self.clauses(text.lower())[0]:
            for name in listed:
                sums[name] += 1.0
            for s, name in stems.items():
                sums[name] += self.stems[s]
        return [math.log1p(sums[n]) for n in NAMES]

    def measure(self, text: str) -> tuple[list[float], dict[str, float]]:
        """Features of the listed words by class, and of each learnt stem by the share of clauses that hold it."""
        sums, counts = dict.fromkeys(NAMES, 0.0), {}
        found, n = self.clauses(text.lower())
        for listed, stems in found:
            for name in listed:
                sums[name] += 1.0
            for s, name in stems.items():
                counts[s] = counts.get(s, 0.0) + KEPT.get(name, 1.0)
        return [math.log1p(sums[c]) for c in NAMES], {s: math.log1p(20 * c / n) for s, c in counts.items()}


class Model:
    """Weighted stems, weights of the classes and bias; bounded by the sample, so it travels with each task."""

    def __init__(self, stems: dict[str, float], weights: list[float], bias: float):
        self.stems, self.weights, self.bias = stems, weights, bias

    def scorer(self):
        grammar, weights, bias = Grammar(self.stems), self.weights, self.bias

        def score(text: str | None) -> float:
            listed, stems = grammar.measure(text or "")
            z = bias + math.fsum(w * x for w, x in zip(weights, listed, strict=True))
            z += math.fsum(self.stems[s] * x for s, x in stems.items())
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return score


def fit_weights(
    listed: np.ndarray, rows: np.ndarray, stems: np.ndarray, values: np.ndarray, n_stems: int, y: np.ndarray,
    pull: float = 1.0, rounds: int = 150,
) -> tuple[list[float], list[float], float]:
    """(class weights, stem weights, bias) of one ridge-penalised logistic regression, by accelerated gradient steps.

    ``listed`` has a row per text; (rows, stems, values) are the non-zero stem features. Classes weigh the same in
    total, so a score is the probability at equal odds beforehand. Class weights are pulled to their prior and stem weights
    to nothing, so weights shrink with counts; none is negative.
    """
    prior = np.array([*PRIOR.values(), *[0.0] * n_stems, PRIOR_BIAS])
    n, k = len(y), len(PRIOR)
    if not 0 < y.sum() < n:
        return list(PRIOR.values()), [0.0] * n_stems, PRIOR_BIAS
    at, col = np.nonzero(listed)
    # Half the bytes of the usual kinds: these arrays are what the driver holds.
    rows, cols = np.concatenate([at.astype(np.int32), rows]), np.concatenate([col.astype(np.int32), stems + np.int32(k)])
    values = np.concatenate([listed[at, col].astype(np.float32), values])
    share = np.where(y == 1, 0.5 * n / y.sum(), 0.5 * n / (n - y.sum()))

    def outputs(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=values * w[cols], minlength=n) + w[-1]

    def back(r: np.ndarray) -> np.ndarray:
        g = np.bincount(cols, weights=values * r[rows], minlength=k + n_stems + 1)
        g[-1] = r.sum()
        return g

    top = np.ones(k + n_stems + 1)
    for _ in range(30):
        top = back(share * outputs(top))
        curve = float(np.linalg.norm(top))
        top /= curve
    rate = 1 / (1.1 * curve / 4 + pull)
    w, before = prior.copy(), prior.copy()
    for t in range(rounds):
        ahead = w + t / (t + 3) * (w - before)
        slope = back(share * (1 / (1 + np.exp(-np.clip(outputs(ahead), -30, 30))) - y)) + pull * (ahead - prior)
        before, w = w, ahead - rate * slope
        w[:-1] = np.maximum(w[:-1], 0.0)
    return [float(v) for v in w[:k]], [float(v) for v in w[k:-1]], float(w[-1])


FOLDS = 3


def calibrated(
    listed: np.ndarray, rows: np.ndarray, stems: np.ndarray, values: np.ndarray, n_stems: int, y: np.ndarray,
) -> tuple[list[float], list[float], float]:
    """``fit_weights`` of all rows, stretched so that rows of label 1 not fitted reach high scores.

    Every fold is scored by a fit of the others, with the stems that stand out there. Slope and offset of a logistic
    model of those scores, pulled to 1 and 0 and the slope never below 1, carry over to the weights of all rows: few
    labels leave small weights, and without this hardly a score would leave the middle.
    """
    weights, strengths, bias = fit_weights(listed, rows, stems, values, n_stems, y)
    n, fold = len(y), np.arange(len(y)) % FOLDS
    z = np.full(n, np.nan)
    for f in range(FOLDS):
        known = fold != f
        if not 0 < y[known].sum() < known.sum():
            continue
        inside = known[rows]
        toxic = np.bincount(stems[inside], weights=y[rows[inside]], minlength=n_stems)
        seen = np.bincount(stems[inside], minlength=n_stems)
        fine = (toxic >= 2) & (log_odds_of(toxic, seen, y[known].sum(), known.sum()) >= STANDS_OUT)
        inside &= fine[stems]
        order = (np.cumsum(known) - 1).astype(np.int32)
        own = fit_weights(listed[known], order[rows[inside]], stems[inside], values[inside], n_stems, y[known])
        use = ~known[rows] & fine[stems]
        part = np.bincount(rows[use], weights=values[use] * np.array(own[1])[stems[use]], minlength=n)
        z[~known] = (listed @ np.array(own[0]) + part + own[2])[~known]
    if np.isfinite(z).all() and 0 < y.sum() < n:
        share = np.where(y == 1, 0.5 * n / y.sum(), 0.5 * n / (n - y.sum()))
        x, line = np.column_stack([z, np.ones(n)]), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
            slope = x.T @ (share * (p - y)) + (line - [1.0, 0.0])
            line = line - np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.eye(2), slope)
        if line[0] > 1:
            a, b = float(line[0]), float(line[1])
            return [a * w for w in weights], [a * w for w in strengths], a * bias + b
    return weights, strengths, bias


STEM_LENGTHS, SPACELESS_LENGTHS = range(3, 11), range(2, 5)
STEM_SCHEMA = "stem string, toxic long, n long"


def _document_stems(text: str) -> set[str]:
    out = set()
    for w in {m.group() for m in TOKEN.finditer(text.lower())}:
        if not SPACELESS.match(w):
            out.update(w[:k] for k in STEM_LENGTHS if len(w) >= k)
        for m in SPACELESS.finditer(w):
            out.update(w[m.start() : m.start() + k] for k in SPACELESS_LENGTHS if len(w) >= m.start() + k)
    return out


def _sketch(text: str) -> int:
    """Smallest hash of three-word shingles: near copies mostly share it."""
    words = text.lower().split()
    if len(words) < 4:
        return xxhash.xxh64_intdigest(" ".join(words)) >> 1
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(len(words) - 2)) >> 1


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per stem and label, added up per task; a full table is handed on and begun anew."""
    counts: list[Counter] = [Counter(), Counter()]

    def flush() -> pa.RecordBatch:
        stems = list(counts[0].keys() | counts[1].keys())
        toxic = [counts[1][s] for s in stems]
        n = [counts[0][s] + t for s, t in zip(stems, toxic, strict=True)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(stems, pa.string()), pa.array(toxic, pa.int64()), pa.array(n, pa.int64())],
            ["stem", "toxic", "n"],
        )

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(_document_stems(text))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield flush()
    yield flush()


def log_odds(toxic, n, n_toxic: int, n_all: int):
    """How many standard deviations a stem's log-odds of label 1 lie above nothing, shrunk by half a document each."""
    a, b = toxic + F.lit(0.5), n - toxic + F.lit(0.5)
    odds = F.log(a / (F.lit(n_toxic + 1.0) - a)) - F.log(b / (F.lit(n_all - n_toxic + 1.0) - b))
    return odds / F.sqrt(1 / a + 1 / b)


def log_odds_of(toxic: np.ndarray, n: np.ndarray, n_toxic: float, n_all: float) -> np.ndarray:
    """The same on arrays."""
    a, b = toxic + 0.5, n - toxic + 0.5
    odds = np.log(a / (n_toxic + 1 - a)) - np.log(b / (n_all - n_toxic + 1 - b))
    return odds / np.sqrt(1 / a + 1 / b)


def choose_stems(rows: list[tuple[str, int, int]]) -> list[str]:
    """Stems in order; one that a stem a letter longer replaces in every document it begins a word of is left out."""
    held = {s: (t, n) for s, t, n in rows}
    longer = {(s[:-1], held[s]) for s in held}
    return sorted(s for s in held if (s, held[s]) not in longer)


def learn(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE
) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 3 is not 1.

    ``sample`` bounds the labelled rows used: those of smallest hash, about that many. Near copies count once. A stem
    is tried if it begins words in two toxic training texts and its log-odds stand out (STANDS_OUT); of
    more than MOST_STEMS the strongest are tried. Their weights and those of the classes are fitted together.
    Rows with null id, null label or several labels (the largest counts) are handled; without rows of both
    labels the prior grammar is returned.
    """
    marks = labels.where("toxic in (0, 1) and doc_id is not null").where(crc_mod(F.col("doc_id"), 3) != 1)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = marks.count()
    unit = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    marks = marks.where(unit < min(1.0, sample / max(1, known)))
    # At most about ``sample`` rows of two numbers: a bounded broadcast.
    marks = F.broadcast(marks.select(F.col("doc_id").alias("_id"), "toxic"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(marks, "_id")
    rows = rows.select("text", "toxic").where(F.col("text").isNotNull())
    sketch = F.pandas_udf(lambda s: s.map(_sketch), "long")
    rows = saved(rows.withColumn("sketch", sketch("text")), "toxicity")
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    single = saved(rows.dropDuplicates(["sketch", "toxic"]), "toxicity-single")
    n, toxic = single.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return Model({}, list(PRIOR.values()), PRIOR_BIAS)
    single = single.repartition(single.sparkSession.sparkContext.defaultParallelism)
    counted = single.select("text", "toxic").mapInArrow(_count_stems, STEM_SCHEMA).groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n")
    )
    found = counted.withColumn("z", log_odds(F.col("toxic"), F.col("n"), toxic, n)).where((F.col("toxic") >= 2) & (F.col("z") >= STANDS_OUT))
    found = found.orderBy(F.col("z").desc(), "stem").limit(MOST_STEMS)
    stems = choose_stems([tuple(r) for r in found.select("stem", "toxic", "n").collect()])
    place = {s: i for i, s in enumerate(stems)}

    @F.pandas_udf("listed array<double>, stems array<int>, x array<float>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(dict.fromkeys(place, 1.0))
        for batch in batches:
            out = []
            for t in batch:
                listed, own = grammar.measure(t)
                own = sorted((place[w], x) for w, x in own.items())
                out.append((listed, [i for i, _ in own], [x for _, x in own]))
            yield pd.DataFrame(out, columns=["listed", "stems", "x"])

    data = single.select("sketch", "toxic", measured("text").alias("m")).select("sketch", "toxic", "m.*").toArrow()
    data = data.sort_by([("sketch", "ascending"), ("toxic", "ascending")]).combine_chunks()
    flat = lambda c, kind: data.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    rows_of = np.repeat(np.arange(data.num_rows, dtype=np.int32), pc.list_value_length(data.column("stems")).to_numpy())
    weights, strengths, bias = calibrated(
        flat("listed", float).reshape(-1, len(NAMES)), rows_of, flat("stems", np.int32), flat("x", np.float32),
        len(stems), data.column("toxic").to_numpy().astype(float),
    )
    # Stems without weight say nothing and are not carried.
    return Model({s: w for s, w in zip(stems, strengths, strict=True) if w > 1e-6}, weights, bias)


def score_column(text, model: Model):
    """Probability of label 1 from the text alone; null text counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for batch in batches:
            yield pd.Series([score(t) for t in batch], dtype=float)

    return run(F.coalesce(text, F.lit("")))


def toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.7,
    sample: int = SAMPLE,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, from a model learnt on the other labelled rows.

    Null texts score like empty ones; a null id is never held out; repeated rows keep a row each; an empty
    table gives no rows; further columns are ignored, whatever their names.
    """
    model = learn(docs, labels, text, doc_id, sample)
    out = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(crc_mod(F.col(doc_id), 3) == 1, F.lit(False)).alias("held_out"),
        score_column(F.col(text), model).alias("score"),
    )
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.7,
    sample: int = SAMPLE,
) -> DataFrame:
    """The rows that are not predicted toxic, all columns as they were."""
    model = learn(docs, labels, text, doc_id, sample)
    kept = docs.withColumn("_toxicity", score_column(F.col(text), model)).where(F.col("_toxicity") < threshold)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
