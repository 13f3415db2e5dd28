"""Language identification by averaged subword embeddings.

A text is the average of the embeddings of its subwords, followed by a linear softmax. Subwords
are the runs of two, three and four bytes of its letters (ASCII and Latin-1 letters lower-cased,
everything that is no letter a space), hashed into ``BUCKETS`` rows. Embeddings and softmax are
trained together by stochastic gradient descent in numpy, on the driver, on a bounded sample.

As both layers are linear, they fold into one table of ``BUCKETS`` rows by languages, which is
what is broadcast; a prediction adds up its rows for the whole text. Predictions are one narrow
stage, whatever the sizes and the skew.

The score is the probability after temperature scaling. A text is rejected if its score is below
the one that ``REJECTED`` of clean texts stay under, or if it has no letter: the share of clean
text that rejection costs is set, not guessed. Temperature and least score come from counts, made
in Spark, of the scores of all labelled rows of the learning folds that the classifier was not
fitted on; their scores before scaling, a number for each language, are written once. With fewer than 1 / ``REJECTED`` of those, the share cannot be measured: the least
score is then just below the lowest of them, which costs one text in as many on average.

Defined results: ``und`` with score 0 for a null text, one without a letter, and any text if
nothing was learned; with one language learned, that one with score 1; a null id is in no fold
and not learned from; repeated rows each give a row; an empty table gives none; further columns
are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import bounded_sample, give_back, kept_table, whole

# Documented bounds of the sample: rows, and the largest number of subwords kept of one.
SAMPLE_ROWS = 2_000
BUCKETS = 8_192
DIM = 16
EPOCHS, BATCH, RATE = 12, 32, 4.0
CALIBRATION = 5  # every fifth sampled text is not fitted, so that small tables calibrate too
REJECTED = 0.0005
TEMPERATURES = np.geomspace(0.25, 4, 33)
CEILING = 0.5  # scores from here on are never rejected
BINS = 1 << 16  # scores below CEILING are counted in so many, the others in one more
UNKNOWN = "und"
SLICE = 1 << 20  # bytes looked at together


def _letters() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    for upper, lower in zip(range(65, 91), range(97, 123)):
        table[upper] = table[lower] = lower
    return table


LETTERS = _letters()
ORDERS = (2, 3, 4)
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def subwords(text: str) -> np.ndarray:
    """How often each bucket's subwords occur in a text."""
    counts = np.zeros(BUCKETS, np.int64)
    data = b" " + text.encode() + b" "
    for begin in range(0, len(data), SLICE):
        raw = np.frombuffer(data[max(0, begin - 3) : begin + SLICE], np.uint8)
        x = LETTERS[raw]
        capital = np.zeros(len(x), bool)  # À to Þ
        capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
        x = np.where(capital, x + 32, x).astype(np.uint32)
        space = x == 32
        apart = space[:-1] & space[1:]
        good = ~apart
        run = x
        for k, order in enumerate(ORDERS):
            run = run[: len(x) - order + 1] * np.uint32(257) + x[order - 1 :]
            if k:
                good = good[: len(run)] & ~apart[order - 2 :]
            seen = max(0, min(3, begin) - order + 1)  # already counted with the slice before
            hashed = (run * FACTORS[k]) >> np.uint32(19)
            counts += np.bincount(hashed[seen:][good[seen:]], minlength=BUCKETS)
    return counts


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times softmax weights, over temperature
    bias: np.ndarray
    least: float  # scores below it are rejected

    def logits(self, text: str) -> np.ndarray:
        counts = subwords(text)
        return (counts @ self.table) / max(counts.sum(), 1) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        scores = self.logits(text)
        p = np.exp(scores - scores.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def _softmax(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def trained(x: np.ndarray, y: np.ndarray, languages: int, seed: int = 5) -> tuple:
    """Embeddings and softmax weights, by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    w = np.zeros((DIM, languages), np.float32)
    b = np.zeros(languages, np.float32)
    target = np.eye(languages, dtype=np.float32)[y]
    steps = max(1, EPOCHS * -(-len(x) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            rows = order[i : i + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            batch = x[rows].astype(np.float32)
            batch /= np.maximum(batch.sum(axis=1, keepdims=True), 1)
            hidden = batch @ e
            off = (_softmax(hidden @ w + b) - target[rows]) / len(rows)
            back = batch.T @ (off @ w.T)
            w -= rate * (hidden.T @ off)
            b -= rate * off.sum(axis=0)
            e -= rate * BATCH * back
    return e, w, b


def logits_of(docs: DataFrame, model: Model, fitted: set[int]) -> DataFrame:
    """``own, logits`` of the rows of ``docs`` (key, lang, text) whose key was not fitted.

    ``own`` is the place of the row's language, -1 if it was not learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, fitted))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, left_out = shared.value
        place = {lang: k for k, lang in enumerate(known.languages)}
        for batch in batches:
            rows = [
                (place.get(lang, -1), known.logits(text))
                for key, lang, text in zip(*(batch.column(c).to_pylist() for c in ("key", "lang", "text")))
                if key not in left_out
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                ],
                ["own", "logits"],
            )

    return docs.mapInArrow(score, "own long, logits array<double>")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    own = batch.column("own").to_numpy()
    return own, batch.column("logits").flatten().to_numpy().reshape(len(own), -1)


def losses(scored: DataFrame) -> np.ndarray:
    """What each temperature costs over all rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TEMPERATURES))
        for batch in batches:
            if batch.num_rows:
                own, logits = _arrays(batch)
                logits, own = logits[own >= 0], own[own >= 0]
                for k, t in enumerate(TEMPERATURES):
                    total[k] -= np.log(_softmax(logits / t)[np.arange(len(own)), own] + 1e-9).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array(total)], ["t", "loss"])

    found = scored.mapInArrow(add, "t long, loss double").groupBy("t").agg(F.sum("loss").alias("loss"))
    total = np.zeros(len(TEMPERATURES))
    for r in found.collect():
        total[r.t] = r.loss
    return total


def score_counts(scored: DataFrame, t: float) -> np.ndarray:
    """How many rows score in each bin, at a temperature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BINS + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                top = _softmax(_arrays(batch)[1] / t).max(axis=1)
                n += np.bincount(np.minimum(top / CEILING * BINS, BINS).astype(np.int64), minlength=BINS + 1)
        bins = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n[bins])], ["bin", "n"])

    found = scored.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    n = np.zeros(BINS + 1, np.int64)
    for r in found.collect():
        n[r.bin] = r.n
    return n


def least_score(counts: np.ndarray) -> float:
    """The greatest border of bins below which new texts are ``REJECTED`` or fewer, on average."""
    below = np.concatenate([[0], np.cumsum(counts[:BINS])])
    # a text is below the k + 1 lowest of n others, k of them being below the border, by (k + 1) / (n + 1)
    allowed = max(0, int(REJECTED * (counts.sum() + 1)) - 1)
    return float(np.flatnonzero(below <= allowed)[-1] / BINS * CEILING)


def calibrated(docs: DataFrame, model: Model, fitted: set[int]) -> Model:
    """The model with its temperature and least score, from all rows it was not fitted on."""
    scored = kept_table(docs.sparkSession, logits_of(docs, model, fitted), "logits")
    if not scored.head(1):
        return model
    t = float(TEMPERATURES[losses(scored).argmin()])
    least = least_score(score_counts(scored, t))
    return Model(model.languages, model.table / t, model.bias / t, least)


def _fold(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def _letter() -> Column:
    return whole().rlike(r"\p{L}")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [subwords(text) for text in batch.column("text").to_pylist()]
        used = [np.flatnonzero(c).astype(np.uint16) for c in counts]
        yield pa.RecordBatch.from_pydict(
            {
                "key": batch.column("key"),
                "lang": batch.column("lang"),
                "used": pa.array([u.tobytes() for u in used], pa.binary()),
                "counts": pa.array(
                    [np.minimum(c[u], 65535).astype(np.uint16).tobytes() for c, u in zip(counts, used)],
                    pa.binary(),
                ),
            }
        )


def learn(docs: DataFrame) -> Model | None:
    """A model fitted on a bounded sample of the rows that may be learned from.

    It is calibrated on all the others.
    """
    usable = docs.where((_fold("doc_id") != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("text", "lang", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"))
    sample = bounded_sample(usable, SAMPLE_ROWS)
    rows = sample.mapInArrow(_features, "key long, lang string, used binary, counts binary").collect()
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    rows.sort(key=lambda r: (bytes(r.counts), r.lang, r.key))  # the same order whatever the partitions
    x = np.zeros((len(rows), BUCKETS), np.uint16)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.used, np.uint16)] = np.frombuffer(r.counts, np.uint16)
    y = np.array([languages.index(r.lang) for r in rows])
    mixed = np.random.default_rng(3).permutation(len(rows))
    kept = mixed[::CALIBRATION] if len(rows) >= 10 * CALIBRATION else mixed[:0]
    rest = np.setdiff1d(mixed, kept)
    e, w, b = trained(x[rest], y[rest], len(languages))
    model = Model(languages, (e @ w).astype(np.float64), b.astype(np.float64), CEILING)
    return calibrated(usable.where(_letter()), model, {rows[k].key for k in rest})


def identified(docs: DataFrame, model: Model | None, with_row: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of each row of ``docs`` (doc_id, text).

    ``with_row`` adds the whole row as a struct, ``row``, apart from any name of these.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column("row").field("text") if with_row else batch.column("_text")
            found = [
                known.predict(text or "") if has and known else (UNKNOWN, 0.0)
                for text, has in zip(texts.to_pylist(), batch.column("_letter").to_pylist())
            ]
            names = [n for n in batch.schema.names if n not in ("_text", "_letter")]
            values = [batch.column(n) for n in names]
            values += [pa.array([f[0] for f in found], pa.string())]
            values += [pa.array([f[1] for f in found], pa.float64())]
            values += [
                pa.array([f[0] == UNKNOWN or f[1] < known.least for f in found], pa.bool_())
            ]
            yield pa.RecordBatch.from_arrays(values, [*names, "lang_pred", "score", "rejected"])
        give_back()

    rows = docs.select(
        "doc_id",
        F.coalesce(_fold("doc_id") == 1, F.lit(False)).alias("held_out"),
        F.struct(*docs.columns).alias("row") if with_row else whole().alias("_text"),
        _letter().alias("_letter"),
    )
    schema = rows.drop("_text", "_letter").schema
    schema = schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(predict, schema)


def language_ids(docs: DataFrame, with_row: bool = False) -> DataFrame:
    """Learn from the table and predict all of it."""
    return identified(docs, learn(docs), with_row)
