"""Document quality by a linear-chain conditional random field over lines.

Every line with text is labelled good or bad from features of its own and of its two neighbours; the
document's raw value is the length-weighted mean of the lines' forward-backward marginals, which a
logistic curve fitted on the same sample turns into the probability of label 1.

Labels are known for documents only, so lines start with their document's label; lines of bad
documents that the fitted field finds good are relabelled and the field is fitted again.

Fitting takes at most TRAIN_DOCS labelled documents (those with the smallest hashes of their ids that
aren't held out) of at most TRAIN_LINES lines in all, each with all of its lines; both bounds are
parameters. Chains longer than CHAIN lines are fitted in pieces, whose features still see their neighbours.
Scoring reads whole texts as one chain.

Defined results: a null or blank text is scored as one empty line. A null label is not learned from; of
contradicting labels of a document the smaller one counts; repeated rows and labels are learned from once.
Without any label, or with one class only, every score is the share of label 1, 0.5 if there is none. A
null doc_id is not held out. Repeated rows are scored one by one, and texts of any length as a whole. An
empty table gives an empty table. Other columns are carried through; results replace columns of the same names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import materialize, table, trimmed

TRAIN_DOCS, TRAIN_LINES, CHAIN = 2500, 100_000, 64
FOLDS, THRESHOLD = 5, 0.3
STEPS, ROUNDS, RIDGE = 80, 2, 1e-3
#: Padded cells of lines handled at once.
CELLS = 200_000
#: Documents whose features are held at once.
AT_ONCE = 250
NO_SYMBOLS = str.maketrans("", "", "#*$%&|<>{}[]~^=\\_@")
NO_BARS = str.maketrans("", "", "|»›•·")
NO_DIGITS = str.maketrans("", "", "0123456789")
OWN = 20


def line_features(lines: list[str]) -> np.ndarray:
    """One row of OWN numbers for each line."""
    out = np.zeros((len(lines), OWN), np.float32)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words, size = line.split(), len(line)
        n = len(words)
        if not n:
            out[i, 0] = 1
            continue
        counts = Counter(words)
        symbols = (size - len(line.translate(NO_SYMBOLS))) / n
        bars = (size - len(line.translate(NO_BARS))) / n
        shouts = line.count("!!") / n
        same = sum(map(str.__eq__, words, words[1:])) / n
        letters = (size - n + 1) / n
        digits = (size - len(line.translate(NO_DIGITS))) / size
        out[i] = (
            0,
            min(symbols, 3),
            symbols > 0.3,
            min(bars, 1),
            bars > 0.2,
            min(shouts, 1),
            shouts > 0.2,
            line.isupper(),
            same,
            same > 0.3,
            len(counts) / n if n >= 8 else 1,
            counts.most_common(1)[0][1] / n if n >= 8 else 0,
            math.log1p(n) / 5,
            min(letters, 20) / 10,
            line[-1] in ".!?…",
            line[0].isupper(),
            digits,
            line in seen,
            n < 4,
            n > 60,
        )
        seen.add(line)
    return out


def lines_of(text: str | None) -> list[str]:
    return [x for line in (text or "").split("\n") if (x := line.strip())] or [""]


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features of each line, the one before and the one after, and whether there are such."""
    none = np.zeros((1, own.shape[1]), own.dtype)
    first, last = np.zeros((len(own), 1), own.dtype), np.zeros((len(own), 1), own.dtype)
    first[0] = last[-1] = 1
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), first, last, np.ones((len(own), 1), own.dtype)])


WIDTH = 3 * OWN + 3


def marginals(energy: np.ndarray, lengths: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """energy: documents x lines (of label 1 against 0); link: 2 x 2 log weights of label pairs.

    Gives the marginals of label 1 and the expected counts of label pairs.
    """
    docs, most = energy.shape
    e = np.clip(energy, -30, 30)
    emit = np.stack([1 / (1 + np.exp(e)), 1 / (1 + np.exp(-e))], axis=2)
    pair = np.exp(link)
    ahead = np.zeros((docs, most, 2))
    ahead[:, 0] = emit[:, 0]
    for t in range(1, most):
        a = (ahead[:, t - 1] @ pair) * emit[:, t]
        ahead[:, t] = a / a.sum(axis=1, keepdims=True)
    back = np.ones((docs, 2))
    good, pairs = np.zeros((docs, most)), np.zeros((2, 2))
    for t in range(most - 1, -1, -1):
        live = lengths > t
        back = np.where((lengths > t + 1)[:, None], back, 1.0)
        both = ahead[:, t] * back
        good[:, t] = np.where(live, both[:, 1] / both.sum(axis=1), 0)
        onward = emit[:, t] * back
        if t:
            joint = ahead[:, t - 1, :, None] * pair * onward[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True))[live].sum(axis=0)
        back = onward @ pair.T
        back /= back.sum(axis=1, keepdims=True)
    return good, pairs


class Field:
    """The fitted model: scale, weights, link, and the logistic curve over raw values."""

    def __init__(self) -> None:
        self.mean, self.spread = np.zeros(WIDTH), np.ones(WIDTH)
        self.weights, self.link = np.zeros(WIDTH), np.zeros((2, 2))
        self.curve = (0.0, 0.0)

    def padded(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(d) for d in docs])
        energy = np.zeros((len(docs), lengths.max()))
        weights = self.weights / self.spread
        flat = np.concatenate([d @ weights for d in docs]) - self.mean @ weights
        energy[np.arange(energy.shape[1]) < lengths[:, None]] = flat
        return energy, lengths

    def raw(self, docs: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """The length-weighted mean marginal of each document."""
        out = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(docs[order[end]]) * (end + 1 - at) <= CELLS:
                end += 1
            own = order[at:end]
            energy, lengths = self.padded([docs[i] for i in own])
            good, _ = marginals(energy, lengths, self.link)
            for i, g, n in zip(own, good, lengths.tolist(), strict=True):
                out[i] = float(g[:n] @ sizes[i]) / float(sizes[i].sum())
            at = end
        return out

    def scores(self, docs: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * self.raw(docs, sizes) + b)))


def fit(docs: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray) -> Field:
    """docs: features with neighbours of each document's lines; labels: of documents, 0 or 1."""
    field = Field()
    if not len(docs) or labels.min() == labels.max():
        share = float(labels.mean()) if len(docs) else 0.5
        field.curve = (0.0, math.log((share + 1e-6) / (1 - share + 1e-6)))
        return field
    flat = np.vstack(docs).astype(np.float64)
    field.mean, field.spread = flat.mean(axis=0), flat.std(axis=0) + 1e-3
    field.mean[-1], field.spread[-1] = 0, 1
    x = (flat - field.mean) / field.spread
    lines = np.array([len(d) for d in docs])
    y = np.repeat(labels, lines).astype(np.float64)
    bad = np.repeat(labels == 0, lines)
    chains = [d[at : at + CHAIN] for d in docs for at in range(0, len(d), CHAIN)]
    lengths = np.array([len(c) for c in chains])
    mask = np.arange(lengths.max()) < lengths[:, None]
    ends = np.cumsum(lines)
    moments = [np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)]
    step = 0
    for turn in range(ROUNDS):
        if turn:
            # lines that look good though their document is bad; each bad document keeps its worst line
            good = self_marginals[mask]
            worst = good <= np.repeat(np.minimum.reduceat(good, ends - lines), lines)
            y = np.where(bad & (good > 0.5) & ~worst, 1.0, y)
        padded = np.zeros(mask.shape)
        padded[mask] = y
        seen = np.zeros((2, 2))
        inner = mask[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                seen[a, b] = ((padded[:, :-1] == a) & (padded[:, 1:] == b) & inner).sum()
        for k in range(STEPS):
            energy, _ = field.padded(chains)
            good, pairs = marginals(energy, lengths, field.link)
            self_marginals = good
            slope = np.concatenate([x.T @ (good[mask] - y) / len(y) + RIDGE * field.weights, (pairs - seen).ravel() / len(y) + RIDGE * field.link.ravel()])
            step += 1
            moments[0] = 0.9 * moments[0] + 0.1 * slope
            moments[1] = 0.999 * moments[1] + 0.001 * slope**2
            move = 0.15 / (1 + k / 40) * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
            field.weights = field.weights - move[:WIDTH]
            field.link = field.link - move[WIDTH:].reshape(2, 2)
    raw = field.raw(docs, sizes)
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's steps on the logistic curve, damped by a small ridge
        p = 1 / (1 + np.exp(-(a * raw + b)))
        w = p * (1 - p)
        g = np.array([((p - labels) * raw).sum() + 0.05 * a, (p - labels).sum()])
        h = np.array([[(w * raw * raw).sum() + 0.05, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / max(1e-9, float(np.abs(d).max())))
        a, b = a - d[0], b - d[1]
    field.curve = (float(a), float(b))
    return field


def prepared(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    lines = lines_of(text)
    return with_neighbours(line_features(lines)), np.array([len(x) + 1 for x in lines], np.float64)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int, most_lines: int) -> DataFrame:
    """docs: id, text; labels: id, label. The rows to learn from (id, label, text): whole texts of at most `most` documents with most_lines lines in all.

    Documents are taken in order of the hashes of their ids; one with more than a tenth of most_lines isn't drawn,
    and the first that would go beyond most_lines ends the sample. Only ids, hashes and counts reach the driver.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(most)
    mark, lines = F.xxhash64("text").alias("mark"), (F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1).alias("lines")
    # at most `most` ids; written, so that the corpus is read once
    rows = materialize(docs.select("id", "text").join(F.broadcast(known), "id").select("id", "label", "text", mark, lines), "labelled")
    drawn = rows.select("id", "mark", "lines").where(F.col("lines") <= most_lines // 10).distinct().orderBy(F.xxhash64("id"), "id", "mark").limit(most).collect()
    total, chosen = 0, []
    for r in drawn:
        total += r["lines"]
        if total > most_lines:
            break
        chosen.append((r["id"], r["mark"]))
    chosen = docs.sparkSession.createDataFrame(chosen, "id long, mark long")
    return rows.join(F.broadcast(chosen), ["id", "mark"]).dropDuplicates(["id", "mark"]).select("id", "label", "text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> Field:
    """Fits on the driver, on all lines of at most `most` documents that have at most most_lines lines in all."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = sample(rows, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")), most, most_lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [prepared(t) for t in batch.column("text").to_pylist()]
            made = [(f.astype("<f4").tobytes(), s.astype("<f8").tobytes()) for f, s in made]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())], names=["id", "label", "features", "sizes"])

    got = sorted(rows.mapInArrow(trimmed(run), "id long, label int, features binary, sizes binary").collect(), key=lambda r: (r["id"], bytes(r["features"])))
    features = [np.frombuffer(r["features"], "<f4").reshape(-1, WIDTH) for r in got]
    return fit(features, [np.frombuffer(r["sizes"], "<f8") for r in got], np.array([r["label"] for r in got], np.int64))


def score(df: DataFrame, field: Field, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all of df if not given), score and predicted."""
    named = [c for c in (df.columns if keep is None else keep) if c not in ("score", "predicted")]
    df = df.select(*named, F.col(text_col).alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != "__text") + "score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, values = batch.column("__text"), np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, AT_ONCE):
                made = [prepared(t) for t in texts.slice(at, AT_ONCE).to_pylist()]
                values[at : at + AT_ONCE] = field.scores([m[0] for m in made], [m[1] for m in made])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in named), pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32))], names=[*named, "score", "predicted"])

    return df.mapInArrow(trimmed(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, field, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
