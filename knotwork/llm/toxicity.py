"""Toxicity by compression distance: two zstandard dictionaries, windows of words, calibrated thresholds.

A window is WORDS words, lower case. It is compressed under either dictionary; its gain is the number of bytes that the
toxic dictionary saves over the ordinary one. A document's windows above two thresholds, counted and as a share of all
its windows, give a probability. Every window of every whole text is compressed.

Training uses a bounded sample of labelled rows (SAMPLE rows and SAMPLE_BYTES of text of each label), divided: two thirds
make the dictionaries, the others calibrate the thresholds and weights. Most of a toxic text is ordinary, and a
dictionary of all of it tells little (area under the curve 0.6), so the passages that make it toxic are found by
compression first:

1. The toxic texts fall into FOLDS folds, and as much ordinary text into as many. A toxic window is kept where nearly all
   dictionaries of other toxic folds save bytes of it over the ordinary fold's dictionary.
2. Of a kept window, the words without which little is saved are its passages.
3. Each passage is tried alone behind the ordinary dictionary: those that shorten toxic windows far more often than
   ordinary ones make, behind the ordinary dictionary, the toxic one.

The ordinary dictionary is made by zstandard's own trainer from the ordinary texts.

Defined results: null, empty and word-less texts have no window and get the calibrated score of none; one very long text
is compressed in runs of windows, whole; label rows without document, null labels and unlabelled rows are not learnt
from; a labelled document that is there several times is learnt from once; with too few rows of a label, or no passage,
all scores are the share of toxic rows (0 without labels); rows that repeat a doc_id are scored one by one; equal gains
count alike, so the order of windows or rows changes nothing; a null doc_id is not held out; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, released, small_batches

#: Labelled rows, and bytes of their texts, of each label that the model is fitted on: the bound of what comes to the driver.
SAMPLE, SAMPLE_BYTES = 2000, 16 << 20
#: Words of a window; longer words than WIDTH bytes are cut into several.
WORDS, WIDTH = 3, 64
FOLDS = 6
#: Windows are kept if all folds but SPARE save AGREE bytes or more, passages if without them SHARE bytes less are saved.
SPARE, AGREE, SHARE = 1, 3, 2
#: So many passages are tried.
CANDIDATES = 500
#: A passage saves bytes of this share of the toxic windows, and so many times more often there than in ordinary ones.
LEAST, CONTRAST = 0.0008, 8.0
ORDINARY_BYTES = 32768
#: zstandard's levels: passages are looked for with short matches, documents scored with longer ones (less is saved by chance).
FINDING, SCORING = 3, 3
#: For scoring a window is written so many times: zstandard stores a few bytes as they are, and the repeats cost either side the same.
REPEAT = 2
#: Windows that are compressed in one call.
RUN = 100_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The last bytes of a dictionary start no match.
_END = b" " * 9


def windows(text: str | None, words: int = WORDS) -> list[bytes]:
    w = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if w and len(max(w, key=len)) > WIDTH:
        w = [x[i : i + WIDTH] for x in w for i in range(0, len(x), WIDTH)]
    return [b" " + b" ".join(w[i : i + words]) + b" " for i in range(0, len(w), words)]


class Packer:
    """Compressed lengths of windows under one dictionary."""

    def __init__(self, data: bytes, level: int):
        d = zstandard.ZstdCompressionDict(data + _END, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def lengths(self, some: list[bytes]) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for i in range(0, len(some), RUN):
            part = some[i : i + RUN]
            n = np.fromiter(map(len, part), "<u8", len(part))
            places = np.stack([np.cumsum(n) - n, n], 1).astype("<u8").tobytes()
            packed = self.packer.multi_compress_to_buffer(zstandard.BufferWithSegments(b"".join(part), places), threads=1)
            out.append(np.fromiter((len(packed[k]) for k in range(len(part))), np.int64, len(part)))
        return np.concatenate(out)


@dataclass
class Model:
    """Either dictionary, the two thresholds for gains, and the weights of the four features and the constant."""

    toxic: bytes
    ordinary: bytes
    thresholds: tuple[int, int]
    weights: tuple[float, ...]

    def __post_init__(self):
        self.packers: tuple[Packer, Packer] | None = None

    def __getstate__(self):
        return {"toxic": self.toxic, "ordinary": self.ordinary, "thresholds": self.thresholds, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def gains(self, some: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one."""
        if self.packers is None:
            self.packers = Packer(self.ordinary, SCORING), Packer(self.toxic, SCORING)
        some = [_framed(w) for w in some]
        return self.packers[0].lengths(some) - self.packers[1].lengths(some)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """For each text: its windows above either threshold, and all its windows."""
        g, n = self.gains_of(texts)
        ends = np.concatenate([[0], np.cumsum(n)])
        above = [np.concatenate([[0], np.cumsum(g >= t)]) for t in self.thresholds]
        return np.stack([*(a[ends[1:]] - a[ends[:-1]] for a in above), n], 1)

    def gains_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The gains of all windows, text by text, and each text's number of them; a run of windows is held at a time."""
        out, n, held = [np.zeros(0, np.int64)], [], []
        for t in texts:
            mine = windows(t)
            n.append(len(mine))
            held += mine
            if len(held) >= RUN:
                out.append(self.gains(held))
                held = []
        return np.concatenate([*out, self.gains(held)]), np.array(n, np.int64)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.toxic:
            return np.full(len(texts), self.weights[0])
        z = _features(self.counts(texts)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(counts: np.ndarray) -> np.ndarray:
    """Constant; of either threshold, log(1 + windows above it) and their per cent of all."""
    n = np.maximum(1, counts[:, 2])
    return np.stack([np.ones(len(counts)), np.log1p(counts[:, 0]), 100 * counts[:, 0] / n, np.log1p(counts[:, 1]), 100 * counts[:, 1] / n], 1)


def _unlike(texts: list[str | None]) -> list[list[bytes]]:
    """The windows of texts of which at most three tenths of the three-word shingles stand in earlier ones: copies would agree with each other."""
    seen: set = set()
    out = []
    for t in texts:
        w = windows(t, 1)
        mine = set(zip(w, w[1:], w[2:], strict=False))
        if len(mine & seen) <= 0.3 * len(mine):
            out.append(windows(t))
        seen |= mine
    return out


def _agreed(pairs: list[tuple[Packer, Packer]], some: list[bytes], spare: int) -> np.ndarray:
    """The bytes that all toxic folds but `spare` save at least."""
    gains = np.stack([ordinary.lengths(some) - toxic.lengths(some) for ordinary, toxic in pairs])
    return np.sort(gains, 0)[min(spare, len(pairs) - 1)]


def passages(toxic: list[list[bytes]], ordinary: list[list[bytes]], folds: int = FOLDS) -> list[tuple[bytes, int]]:
    """The CANDIDATES passages that the dictionaries of other toxic texts save most often, with their counts."""
    folds = min(folds, len(toxic) // 2)
    if folds < 2 or not ordinary:
        return []
    sides = []
    for k in range(folds):
        bad = b"".join(w for ws in toxic[k::folds] for w in ws)
        good, left = [], len(bad)
        for ws in ordinary[k::folds]:
            if left <= 0:
                break
            good.append(b"".join(ws))
            left -= len(good[-1])
        sides.append((Packer(b"".join(good), FINDING), Packer(bad, FINDING)))
    found: Counter = Counter()
    for k in range(folds):
        others = sides[:k] + sides[k + 1 :]
        mine = [w for ws in toxic[k::folds] for w in ws]
        gain = _agreed(others, mine, SPARE)
        kept = [(mine[i].split(), int(gain[i])) for i in np.flatnonzero(gain >= AGREE)]
        without = [(w[i], g, b" " + b" ".join(w[:i] + w[i + 1 :]) + b" ") for w, g in kept for i in range(len(w))]
        rest = _agreed(others, [x for *_, x in without], SPARE) if without else []
        found.update(word for (word, g, _), r in zip(without, rest, strict=True) if g - r >= SHARE)
    return sorted(found.items(), key=lambda x: (x[1], x[0]))[-CANDIDATES:]


def _contrasted(kept: list[tuple[bytes, int]], base: bytes, toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The passages that save bytes of LEAST of the toxic windows, and CONTRAST times as often there as in ordinary ones;
    those that save most windows last, where references are shortest."""
    every = Model(_joined(base, [w for w, _ in kept]), base, (0, 0), ())
    bad, good = ([_framed(w) for w, g in zip(some, every.gains(some), strict=True) if g >= SHARE] for some in (toxic, ordinary))  # the others no passage saves
    plain = Packer(base, SCORING).lengths(bad + good)
    out = []
    for w, _ in kept:
        saved = plain - Packer(_joined(base, [w]), SCORING).lengths(bad + good) >= SHARE
        n, m = int(saved[: len(bad)].sum()), int(saved[len(bad) :].sum())
        if n >= max(4, LEAST * len(toxic)) and (n + 0.5) / len(toxic) >= CONTRAST * (m + 0.5) / len(ordinary):
            out.append((n, w))
    return [w for _, w in sorted(out)]


def _joined(ordinary: bytes, passages: list[bytes]) -> bytes:
    """The toxic dictionary: the ordinary one, then the passages."""
    return ordinary + b"".join(b" " + w for w in passages) + b" "


def _framed(window: bytes) -> bytes:
    return window[:-1] * REPEAT + b" "


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary by zstandard's trainer; too few samples are taken as they are."""
    try:
        made = zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]
    start = made.find(b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00")  # the three repeat offsets end the header
    return made[start + 12 :] if start >= 0 else made


def fit(rows: list[tuple[str | None, int]], weight: dict[int, float] | None = None) -> Model:
    """rows: (text, label); weight: how many rows of the corpus a row of each label stands for."""
    weight = weight or {0: 1.0, 1: 1.0}
    toxic, ordinary = ([t for t, y in rows if y == k] for k in (1, 0))
    total = sum(weight[y] for _, y in rows)
    share = sum(weight[y] for _, y in rows if y) / total if rows else 0.0
    if len(toxic) < 8 or len(ordinary) < 8:
        return Model(b"", b"", (1, 1), (share,))
    third = lambda x, held: [t for i, t in enumerate(x) if (i % 3 == 2) == held]
    bad, good = _unlike(third(toxic, False)), _unlike(third(ordinary, False))
    flat = lambda x: [w for ws in x for w in ws]
    base = trained(flat(good), ORDINARY_BYTES)
    kept = passages(bad, good)
    chosen = _contrasted(kept, base, flat(bad), flat(good)) if kept else []
    if not chosen:
        return Model(b"", b"", (1, 1), (share,))
    dictionary = _joined(base, chosen)
    held = [*third(toxic, True), *third(ordinary, True)]
    y = np.repeat([1, 0], [len(third(toxic, True)), len(third(ordinary, True))])
    w = np.array([weight[k] for k in y.tolist()])
    g, n = Model(dictionary, base, (0, 0), ()).gains_of(held)
    owner = np.repeat(np.arange(len(held)), n)
    above = {k: np.bincount(owner[g >= k], minlength=len(held)) for k in range(1, 8)}
    best = (-np.inf, (0, 0), None)
    for low in range(1, 5):
        for high in range(low + 1, 8):
            beta, fitness = _logistic(_features(np.stack([above[low], above[high], n], 1)), y, w)
            if fitness > best[0]:
                best = (fitness, (low, high), beta)
    return Model(dictionary, base, best[1], tuple(best[2].tolist()))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of a ridge logistic regression by Newton steps, and their penalised log likelihood."""
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - 0.5 * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(beta)), grad)
        beta += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-12, 1 - 1e-12)
    return beta, float((w * np.where(y == 1, np.log(p), np.log(1 - p))).sum() - 0.25 * (beta**2).sum())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on labelled rows with crc32(doc_id) mod 3 other than 1: at most `sample` rows and `sample_bytes` of each label
    come to the driver, in the order of a hash; a row that alone is larger is passed over."""
    usable = labels.where("toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).select("doc_id", "toxic").distinct()
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    named = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    sized = named.select("doc_id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).distinct().join(usable, "doc_id")
    chosen, n = [], Counter()
    for label in (0, 1):
        left = sample_bytes
        for r in sized.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(sample).collect():
            if r["size"] <= left:
                left -= r["size"]
                chosen.append((r["h"], label))
                n[label] += 1
    wanted = docs.sparkSession.createDataFrame(chosen, "h bigint, label int")  # at most 2 * sample rows
    got = named.join(F.broadcast(wanted), "h").groupBy("h", "label").agg(F.first("text").alias("text")).collect()
    rows = [(r["text"], r["label"]) for r in sorted(got, key=lambda r: (r["h"], r["label"]))]
    return fit(rows, {k: counts.get(k, 0) / max(1, n[k]) for k in (0, 1)})


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", cut: float = 0.7) -> DataFrame:
    """doc_id, score, predicted."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            score = model.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(released(run), "doc_id bigint, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
