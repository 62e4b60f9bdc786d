"""Operator 7, toxicity: a factorization machine over hashed terms (Rendle 2010).

Terms are lower-case words, their first three to five letters, and presence
only, hashed into ``BUCKETS``. The machine has a weight and ``FACTORS`` factors a
term, so it learns pairs of terms that matter together, which additive weights
cannot. It is trained on the driver over at most ``MOST_TRAINING`` labelled rows
(those of smallest hash), of which only the term numbers, counted in the
executors, are collected.

Of the terms, the machine uses the ``most_terms`` that tell most about the label by
themselves, if their log-likelihood ratio is ``least_ratio`` or more and ``least_seen``
training texts have them, and besides these the terms of the ``MOST_PAIRS`` pairs that
tell most beyond what either of the two tells alone, among the ``PAIRED`` terms that most
toxic training texts have. So a harmless insult and a harmless group name that
are toxic together are both in. ``fit(..., None, 0, 1)`` uses all terms: then the machine
learns rare words by heart, and held out it catches 0.62 to 0.87 of the toxic texts of the
check's tables at the threshold, whatever its rate, decay and shrinking of rare terms,
against 0.99 with the chosen terms (each leaves over 0.999 of the others alone).

Only ``text`` enters a score. Defined cases: null, empty and wordless texts get
the score of no terms; rows of the labels with a null label or id, and labels
without a document, are ignored; if no labelled row is toxic every score is 0, if
all are it is that of a weight of 30, about 1; an id that has several labels counts
as toxic if one says so; ids may repeat or be null; empty tables are allowed; other
columns are never read, whatever their names.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm.tables import discard, give_back, slices, stored, text_of

BUCKETS, FACTORS = 1 << 20, 8
#: Labelled rows that training reads at most, and their terms' bytes on the driver: rows past that, by hash, are left out too.
MOST_TRAINING, MOST_TRAINING_BYTES = 12_000, 256 << 20
#: Terms that the machine uses, see above.
MOST_TERMS, LEAST_RATIO, LEAST_SEEN = 3_000, 5.0, 3
#: Terms whose pairs are screened, pairs that are taken, and what a pair must tell beyond its terms: far more than the best of so many pairs does by chance.
PAIRED, MOST_PAIRS, LEAST_GAIN = 2048, 500, 20.0
THRESHOLD, HELD_OUT = 0.7, 1
_WORD = re.compile(r"[^\W\d_]+")


def terms_of_word(word: str) -> set[int]:
    terms = {word + "$", *(word[:k] for k in (3, 4, 5) if len(word) > k)}
    return {zlib.crc32(t.encode()) % BUCKETS for t in terms}


def terms_of(text: str | None) -> np.ndarray:
    found: set[int] = set()
    for w in set(_WORD.findall((text or "").lower())):
        found |= terms_of_word(w)
    return np.fromiter(sorted(found), np.int32, len(found))


@dataclass
class Machine:
    """score = sigmoid(bias + sum w + 1/2 (|sum v|^2 - sum |v|^2)), over the terms that are present; ``slots`` has the place of each bucket, or -1."""

    slots: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, terms: list[np.ndarray]) -> np.ndarray:
        if self.bias == -np.inf:
            return np.zeros(len(terms))
        out = np.full(len(terms), self.bias)
        for i, t in enumerate(terms):
            if len(t):
                v = self.v[t]
                s = v.sum(0)
                out[i] += self.w[t].sum() + 0.5 * (s @ s - np.vdot(v, v))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def told(bad: np.ndarray, seen: np.ndarray, toxic: int, n: int) -> np.ndarray:
    """Log-likelihood ratio of a feature that ``seen`` of ``n`` texts have, ``bad`` of the ``toxic`` ones among them."""
    ll = lambda a, b: a * np.log(np.maximum(a, 1e-9) / np.maximum(b, 1e-9))
    p, rest, outside = toxic / n, toxic - bad, n - seen
    return ll(bad, seen * p) + ll(seen - bad, seen * (1 - p)) + ll(rest, outside * p) + ll(outside - rest, outside * (1 - p))


def telling_pairs(terms: list[np.ndarray], labels: np.ndarray, candidates: np.ndarray, most: int = MOST_PAIRS, least: float = LEAST_GAIN) -> np.ndarray:
    """The terms of the pairs of ``candidates`` whose joint presence tells most beyond either term, by counts of all pairs."""
    m, toxic, n = len(candidates), int(labels.sum()), len(labels)
    place = np.full(BUCKETS, -1, np.int32)
    place[candidates] = np.arange(m)
    both, bad = (np.zeros((m, m), np.uint16 if n < 1 << 16 else np.uint32) for _ in range(2))
    for a in range(0, n, 1000):
        y = labels[a : a + 1000].astype(bool)
        there = np.zeros((len(y), m), np.float32)
        for i, t in enumerate(terms[a : a + 1000]):
            at = place[t]
            there[i, at[at >= 0]] = 1
        toxic_rows = there[y]
        for r in range(0, m, 256):  # some rows of the counts at a time: this runs on the driver
            both[r : r + 256] += (there[:, r : r + 256].T @ there).astype(both.dtype)
            bad[r : r + 256] += (toxic_rows[:, r : r + 256].T @ toxic_rows).astype(bad.dtype)
    alone = told(np.diag(bad).astype(float), np.diag(both).astype(float), toxic, n)
    found: list[tuple[float, int, int]] = []
    for i in range(m - 1):  # a row of pairs at a time
        gain = told(bad[i, i + 1 :].astype(float), both[i, i + 1 :].astype(float), toxic, n) - np.maximum(alone[i], alone[i + 1 :])
        found += [(-float(gain[j]), i, i + 1 + j) for j in np.flatnonzero(gain >= least).tolist()]
        found = sorted(found)[:most] if len(found) > 4 * most else found
    return candidates[sorted({k for _, i, j in sorted(found)[:most] for k in (i, j)})]


def fit(terms: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 2e-4, seed: int = 7, most_terms: int | None = MOST_TERMS, least_ratio: float = LEAST_RATIO, least_seen: int = LEAST_SEEN) -> Machine:
    toxic, n = int(labels.sum()), len(labels)
    if not 0 < toxic < n:
        return Machine(np.full(BUCKETS, -1, np.int32), -np.inf if not toxic else 30.0, np.zeros(0), np.zeros((0, FACTORS)))
    p = toxic / n
    seen, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for t, y in zip(terms, labels):
        seen[t] += 1
        bad[t] += y
    used = np.flatnonzero(seen >= least_seen)
    k, m = bad[used], seen[used]
    ratio = told(k, m, toxic, n)
    best = np.argsort(-ratio, kind="stable")[:most_terms]
    paired = used[np.sort(np.argsort(-k, kind="stable")[:PAIRED])]
    used = np.union1d(used[best[ratio[best] >= least_ratio]], telling_pairs(terms, labels, paired))
    slot = np.full(BUCKETS, -1, np.int32)
    slot[used] = np.arange(len(used))
    del seen, bad
    rows = [s[s >= 0] for s in (slot[t] for t in terms)]
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(used)), rng.normal(0, 0.02, (len(used), FACTORS)), float(np.log(p / (1 - p)))
    gw, gv, gb = np.full(len(used), 1e-2), np.full((len(used), FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        for i in rng.permutation(n):
            t = rows[i]
            s = v[t].sum(0)
            x = bias + w[t].sum() + 0.5 * (s @ s - (v[t] ** 2).sum())
            g = 1 / (1 + np.exp(-min(max(x, -30), 30))) - labels[i]
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            if len(t) and abs(g) > 1e-3:
                dw, dv = g + decay * w[t], g * (s - v[t]) + decay * v[t]
                gw[t] += dw * dw
                gv[t] += dv * dv
                w[t] -= rate * dw / np.sqrt(gw[t])
                v[t] -= rate * dv / np.sqrt(gv[t])
    return Machine(slot, float(bias), w, v)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_TRAINING, most_bytes: int = MOST_TRAINING_BYTES, most_terms: int | None = MOST_TERMS) -> Machine:
    """Fit on the labelled documents outside the held-out third (crc32 of the id as text, modulo 3)."""
    rows = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    rows = rows.where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != HELD_OUT)
    rows = stored(rows.orderBy(F.xxhash64("id"), "id").limit(most), "toxic-labels")
    plain = docs.select(docs[id_col].alias("__id"), text_of(docs, text_col).alias("text"))
    texts = plain.join(F.broadcast(rows), F.col("__id") == F.col("id")).select("id", "y", "text")

    def go(batches):
        for part in slices(batches, 256):
            terms = [terms_of(t).tobytes() for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array(terms, pa.binary())], ["id", "y", "terms"])
        give_back()

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("terms", T.BinaryType())])
    found = stored(texts.mapInArrow(go, schema).withColumn("h", F.xxhash64("id", "terms")), "toxic-terms", texts=True)
    # Labels are few, but an id may have many documents and a document many terms: both bounds are kept, in the order of a hash.
    bound = found.select("h", F.octet_length("terms").alias("size")).orderBy("h").limit(most).collect()
    total, last = 0, None
    for r in bound:
        total += r["size"]
        if total > most_bytes:
            break
        last = r["h"]
    got = found.where(F.col("h") <= last).orderBy("h", "id").limit(most).toArrow() if last is not None else found.limit(0).toArrow()
    discard(rows, found)
    y, lists = got["y"].to_numpy().astype(np.int64), got["terms"]
    del got
    terms = [np.frombuffer(x.as_py(), np.int32) for x in lists]
    del lists  # the driver holds the terms once
    machine = fit(terms, y, most_terms=most_terms)
    del terms
    give_back()
    return machine


class _Scorer:
    """Scores texts; remembers which slots a word has, for at most ``size`` words."""

    def __init__(self, machine: Machine, size: int = 150_000):
        self.machine, self.size, self.known = machine, size, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        slots, known, rows = self.machine.slots, self.known, []
        for text in texts:
            found: set[int] = set()
            for w in set(_WORD.findall((text or "").lower())):
                s = known.get(w)
                if s is None:
                    if len(known) >= self.size:
                        known.clear()
                    s = known[w] = tuple(int(slots[t]) for t in terms_of_word(w) if slots[t] >= 0)
                if s:
                    found.update(s)
            rows.append(np.fromiter(sorted(found), np.int64, len(found)))
        return self.machine.score(rows)

    def column(self, texts: pa.Array) -> np.ndarray:
        parts = [self(texts.slice(i, 256).to_pylist()) for i in range(0, len(texts), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)


def _broadcast(spark, machine: Machine):
    """The machine on the executors: at most ``BUCKETS`` places, weights and factors, 40 MB, whatever the input."""
    small = Machine(machine.slots, machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32))
    return spark.sparkContext.broadcast(small)


def toxicity_scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, score, predicted."""
    rows = docs.select(docs[id_col].alias(id_col), text_of(docs, text_col).alias("__text"))
    shared = _broadcast(docs.sparkSession, machine)

    def go(batches):
        scorer = _Scorer(shared.value)
        for b in batches:
            s = scorer.column(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])
        del scorer
        give_back()

    scored = rows.mapInArrow(go, T.StructType([rows.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
    return stored(scored, "toxicity", texts=True)


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns unchanged. Python sees the texts alone."""
    shared = _broadcast(docs.sparkSession, machine)

    @F.arrow_udf("boolean")
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(shared.value)
        for texts in parts:
            yield pa.array(scorer.column(texts) < threshold)
        del scorer
        give_back()

    return docs.where(clean(docs[text_col].cast("string")))
