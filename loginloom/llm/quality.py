"""Quality by attention-based multiple-instance learning: a document is a bag of passages.

Every passage (PASSAGE words) of a text is described by counts of its bytes' classes and by how its words repeat, encoded
by a layer of units, and weighed by a learned gate (tanh and sigmoid units); the weighted mean of the encodings gives the
document's score. Only the documents' labels are known in training; which passages matter is learned from them.

The model is fitted on at most `sample` labelled rows (and PASSAGES passages), taken in order of a hash of doc_id; scoring
reads every passage of every text. Inputs of a score are the text's bytes alone.

Cases: a null or empty text is one empty passage and gets a score. Texts of any length have as many passages as they need.
Labels that are null, or whose document is missing, are left out; several labels of one document count as their mean.
Without any usable label every score is 0.5. Rows repeated, or in another order, get the same scores. Other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, tidy, words_of

PASSAGE = 48
#: Labelled rows, and passages of them, that a model is fitted on.
SAMPLE = 6_000
PASSAGES = 150_000
HIDDEN, GATE = 24, 12

# classes of bytes: each ASCII mark its own, then lower, upper, digit, space, line end, control, beyond ASCII
_CLASS = np.zeros(256, np.int64)
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
for _i, _b in enumerate(_MARKS):
    _CLASS[_b] = _i
_N = len(_MARKS)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32] = _N, _N + 1, _N + 2, _N + 3
_CLASS[[10, 13]] = _N + 4
_CLASS[[*range(10), 11, 12, *range(14, 32), 127]] = _N + 5
_CLASS[128:] = _N + 6
CLASSES = _N + 7
FEATURES = CLASSES + 6


def passages(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, features) of every passage; every document has one at least."""
    doc, start, length, hashed = words_of(raw, at)
    n_docs = len(at) - 1
    count = np.bincount(doc, minlength=n_docs)
    bags = np.maximum(1, -(-count // PASSAGE))
    first_bag = np.cumsum(bags) - bags
    in_doc = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    bag = first_bag[doc] + in_doc // PASSAGE
    owner = np.repeat(np.arange(n_docs), bags)
    n = len(owner)
    # a passage's bytes: from its first word to the next passage's
    begin = at[:-1][owner].copy()
    opens = np.flatnonzero((in_doc % PASSAGE == 0) & (in_doc > 0))
    begin[bag[opens]] = start[opens]
    of_byte = np.repeat(np.arange(n), np.diff(np.append(begin, len(raw))))
    x = np.zeros((n, FEATURES))
    x[:, :CLASSES] = np.bincount(of_byte * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES)
    size = np.maximum(1, x[:, :CLASSES].sum(1))
    x[:, :CLASSES] /= size[:, None]
    words = np.maximum(1, np.bincount(bag, minlength=n))
    for k, step in enumerate((1, 2)):
        same = np.zeros(len(doc), bool)
        same[step:] = (hashed[step:] == hashed[:-step]) & (bag[step:] == bag[:-step])
        x[:, CLASSES + k] = np.bincount(bag[same], minlength=n) / words
    if len(doc):
        order = np.lexsort((hashed, bag))
        fresh = np.r_[True, (hashed[order][1:] != hashed[order][:-1]) | (bag[order][1:] != bag[order][:-1])]
        x[:, CLASSES + 2] = np.bincount(bag[order[fresh]], minlength=n) / words
        x[:, CLASSES + 3] = np.minimum(1, np.bincount(bag, length, minlength=n) / words / 16)
    x[:, CLASSES + 4] = np.bincount(bag, minlength=n) / PASSAGE
    x[:, CLASSES + 5] = np.bincount(bag, minlength=n) == 0
    return owner, np.sqrt(x)


class Model:
    """Gated attention over encoded passages; trained by Adam on the log loss."""

    def __init__(self, parameters: dict[str, np.ndarray] | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = parameters or {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE) / 4, "o": draw(HIDDEN), "c": np.zeros(1)}

    def forward(self, owner: np.ndarray, x: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        """owner is sorted; every bag has a passage."""
        p, f = self.p, {}
        f["x"] = (x - p["mean"]) / p["scale"]
        f["h"] = np.maximum(0, f["x"] @ p["W"] + p["b"])
        f["t"], f["s"] = np.tanh(f["h"] @ p["V"]), 1 / (1 + np.exp(-(f["h"] @ p["U"])))
        e = (f["t"] * f["s"]) @ p["w"]
        first = np.searchsorted(owner, np.arange(bags))
        e = np.exp(e - np.maximum.reduceat(e, first)[owner])
        f["a"] = e / np.add.reduceat(e, first)[owner]
        f["z"] = np.add.reduceat(f["a"][:, None] * f["h"], first)
        f["y"] = 1 / (1 + np.exp(-np.clip(f["z"] @ p["o"] + p["c"][0], -30, 30)))
        return f

    def gradients(self, owner, f, label) -> dict[str, np.ndarray]:
        p, n = self.p, len(label)
        d = (f["y"] - label) / n
        g = {"o": f["z"].T @ d, "c": np.array([d.sum()])}
        dz = d[:, None] * p["o"]
        da = (dz[owner] * f["h"]).sum(1)
        first = np.searchsorted(owner, np.arange(n))
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[owner])
        g["w"] = (f["t"] * f["s"]).T @ de
        dt = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2)
        ds = de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
        dh = f["a"][:, None] * dz[owner] + dt @ p["V"].T + ds @ p["U"].T
        dh *= f["h"] > 0
        g["W"], g["b"] = f["x"].T @ dh, dh.sum(0)
        return {k: v + 1e-5 * p[k] for k, v in g.items()}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, size: int = 128, rate: float = 4e-3, seed: int = 5) -> Model:
        every = np.concatenate(bags)
        self.p["mean"], self.p["scale"] = every.mean(0), np.maximum(every.std(0), 0.05)
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), size):
                some = order[lo : lo + size]
                owner = np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])
                f = self.forward(owner, np.concatenate([bags[i] for i in some]), len(some))
                step += 1
                for k, g in self.gradients(owner, f, labels[some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, owner: np.ndarray, x: np.ndarray, bags: int) -> np.ndarray:
        return self.forward(owner, x, bags)["y"]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of `quality` from labelled rows whose crc32(doc_id as text) mod 4 is not 2; None without any."""
    usable = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("label_id"), "quality")
    usable = usable.filter(F.crc32(F.col("label_id").cast("string")) % 4 != 2)
    chosen = usable.groupBy("label_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64(F.lit(9), "label_id"), "label_id").limit(sample)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, hi, raw, at in text_chunks(batch.column(1)):
                owner, x = passages(raw, at)
                cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
                blobs = [x[a:b].astype(np.float32).tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(cuts), pa.int64()), pa.array(blobs, pa.binary()), batch.column(2).slice(lo, hi - lo)], ["doc_id", "n", "x", "quality"])

    # `sample` rows at most on this side
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "quality")
    found = rows.mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n long, x binary, quality double")
    bags, answers, total = [], [], 0
    for r in found.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(sample).toLocalIterator():
        total += r.n
        if bags and total > PASSAGES:
            break
        bags.append(np.frombuffer(r.x, np.float32).reshape(r.n, FEATURES).astype(np.float64))
        answers.append(r.quality)
    return Model().fit(bags, np.array(answers)) if bags else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with `quality_score`, a double from 0 to 1; every passage of every text is read, no shuffle."""
    docs = docs.drop("quality_score")
    at_text = docs.columns.index("text")
    parameters = model.p if model else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Model(parameters) if parameters else None
        for batch in batches:
            for lo, hi, raw, at in text_chunks(batch.column(at_text)):
                owner, x = passages(raw, at)
                y = own.score(owner, x, hi - lo) if own else np.full(hi - lo, 0.5)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(y, pa.float64())], [*part.schema.names, "quality_score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(tidy(run), f"{schema}, quality_score double")
