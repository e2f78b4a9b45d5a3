"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A text gets a leading marker and its spaces become markers (U+2581). No piece of the vocabulary has a marker after
another character (checked when it is loaded), so the best path of a text is the best paths of its marker-led words
joined; each worker keeps the paths of words it has met. New words are solved in a batch: the trie is walked for all of
them at once. A character that no piece covers becomes its bytes. Decoding joins pieces and bytes, turns markers into
spaces and drops the leading one; a text that itself has U+2581 decodes with spaces there, as the format has it.

The vocabulary file has merge ranks in place of scores; `rank_scores` turns rank r into -ln(r + 2), a Zipf law, and
`file_scores` takes the file's numbers. Null and empty texts give no ids; rows that repeat a doc_id or have none are encoded
one by one; a very long text is encoded whole in one worker; of paths of one score the one whose last piece starts first
is taken, as the library does; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, released, small_batches
from .tokens import batches_of, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 800_000
#: Words of up to so many bytes are solved in batches; longer ones one by one, in time linear in their length.
SHORT = 40
_WORD = re.compile(f"{MARK}*[^{MARK}]*")


class DoubleArray:
    """next(s, byte) = base[s] + byte + 1 where check of that is s; value[s] is the piece that ends at s, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        n = 1 << 16
        self.base, self.check, self.value = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.check[0] = 1 << 30
        start = 1
        work = [(0, 0, len(keys), 0)]  # state, range of keys, depth
        while work:
            state, lo, hi, depth = work.pop()
            if len(keys[lo][0]) == depth:
                self.value[state] = keys[lo][1]
                lo += 1
            if lo >= hi:
                continue
            heads = [keys[i][0][depth] for i in range(lo, hi)]
            cuts = [lo] + [lo + i for i in range(1, hi - lo) if heads[i] != heads[i - 1]] + [hi]
            labels = np.array([heads[c - lo] for c in cuts[:-1]], np.int64) + 1
            at = start
            while True:  # the first place where all labels fall on free cells, looked for a stretch at a time
                if at + 1024 + 257 >= len(self.check):
                    self._grow()
                free = at + np.flatnonzero(self.check[at : at + 1024] < 0) - labels[0]
                free = free[free >= 0]
                fits = free[(self.check[free[:, None] + labels] < 0).all(1)]
                if len(fits):
                    base = int(fits[0])
                    break
                if len(free) < 32 and at == start:
                    start += 1024  # nearly full: later nodes begin behind it
                at += 1024
            self.base[state] = base
            self.check[base + labels] = state
            for k, label in enumerate(labels.tolist()):
                work.append((base + label, cuts[k], cuts[k + 1], depth + 1))

    def _grow(self) -> None:
        n = len(self.check)
        self.base = np.concatenate([self.base, np.zeros(n, np.int32)])
        self.check = np.concatenate([self.check, np.full(n, -1, np.int32)])
        self.value = np.concatenate([self.value, np.full(n, -1, np.int32)])


def rank_scores(rank: int, score: float) -> float:
    return -math.log(rank + 2)


def file_scores(rank: int, score: float) -> float:
    return score


class Unigram:
    def __init__(self, path: str, scores=rank_scores, cache: int = CACHE):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(open(path, "rb").read())
        kinds = pb.ModelProto.SentencePiece
        self.pieces = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i, p in enumerate(model.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN)}
        self.apart = all(MARK not in self.pieces[i].lstrip(MARK) for i in normal)
        self.score = np.zeros(len(self.pieces), np.float32)
        for rank, i in enumerate(normal):
            self.score[i] = scores(rank, model.pieces[i].score)
        self.unknown = np.float32(self.score[normal].min() - np.float32(UNKNOWN_PENALTY))
        self.trie = DoubleArray([(self.pieces[i].encode(), i) for i in normal])
        self.widest = max(len(self.pieces[i].encode()) for i in normal)
        self.known: dict[str, bytes] = {}
        self.limit = cache

    # encoding

    def words(self, text: str) -> list[str]:
        """The text in marker-led words, the marker of a word with a single one left out."""
        if not text:
            return []
        if not self.apart:
            return ["\0" + MARK + text.replace(" ", MARK)]
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return ["\0" + w for w in _WORD.findall(MARK + text.replace(" ", MARK)) if w]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        parts = [self.words(t or "") for t in texts]
        new: set[str] = set()
        for p in parts:
            new.update(set(p).difference(self.known))
        full = len(self.known) + len(new) > self.limit
        self._learn(list(new))
        known = self.known
        out = [b"".join([known[w] for w in p]) for p in parts]
        if full:  # what was met first stays: frequent words are among it
            for w in new:
                del known[w]
        return out

    def _learn(self, new: list[str]) -> None:
        coded = [(w[1:] if w[:1] == "\0" else MARK + w).encode() for w in new]
        short: dict[int, list[int]] = {}
        for i, c in enumerate(coded):
            if len(c) <= SHORT:
                short.setdefault(-(-len(c) // 4), []).append(i)
            else:
                self.known[new[i]] = self._path_ids(c, *self._one(c))
        for some in short.values():
            for k in range(0, len(some), 4000):
                part = some[k : k + 4000]
                for i, path in zip(part, self._batch([coded[i] for i in part]), strict=True):
                    self.known[new[i]] = path

    def _path_ids(self, word: bytes, back, piece) -> bytes:
        ids: list[int] = []
        e = len(word)
        while e:
            s = back[e]
            if piece[e] >= 0:
                ids.append(piece[e])
            else:
                ids += [self.byte_id[b] for b in reversed(word[s:e])] if self.byte_id else [0]
            e = s
        return np.array(ids[::-1], "<u4").tobytes()

    def _batch(self, words: list[bytes]) -> list[bytes]:
        m, n = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(m, n).astype(np.int64)
        best = np.full((m, n + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back, piece = np.zeros((m, n + 1), np.int32), np.full((m, n + 1), -1, np.int32)
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        for s in range(n):
            first = text[:, s]
            rows = np.flatnonzero((s < size) & (best[:, s] > -np.inf) & ((first & 0xC0) != 0x80))
            if not len(rows):
                continue
            lead = first[rows]
            width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            single = np.zeros(m, bool)
            state, live = np.zeros(len(rows), np.int64), rows
            own = width
            for e in range(s, min(n, s + self.widest)):
                inside = e < size[live]
                nxt = base[state].astype(np.int64) + text[live, e] + 1
                ok = inside & (check[np.minimum(nxt, len(check) - 1)] == state) & (nxt < len(check))
                live, state, own = live[ok], nxt[ok], own[ok]
                if not len(live):
                    break
                v = value[state]
                end = v >= 0
                if end.any():
                    r, p = live[end], v[end]
                    single[r[own[end] == e + 1 - s]] = True
                    got = best[r, s] + score[p]
                    up = got > best[r, e + 1]
                    r = r[up]
                    best[r, e + 1], back[r, e + 1], piece[r, e + 1] = got[up], s, p[up]
            lone = ~single[rows]
            r, to = rows[lone], s + width[lone]
            if len(r):
                got = best[r, s] + self.unknown
                up = got > best[r, to]
                best[r[up], to[up]], back[r[up], to[up]], piece[r[up], to[up]] = got[up], s, -1
        back_l, piece_l = back.tolist(), piece.tolist()
        return [self._path_ids(w, back_l[i], piece_l[i]) for i, w in enumerate(words)]

    def _one(self, word: bytes) -> tuple[list[int], list[int]]:
        n = len(word)
        best: list = [None] * (n + 1)
        best[0] = np.float32(0)
        back, piece = [0] * (n + 1), [-1] * (n + 1)
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        for s in range(n):
            if best[s] is None:
                continue
            b = word[s]
            width = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            single, state = False, 0
            for e in range(s, n):
                nxt = int(base[state]) + word[e] + 1
                if nxt >= len(check) or check[nxt] != state:
                    break
                state = nxt
                if (p := int(value[state])) >= 0:
                    single |= e + 1 - s == width
                    if best[e + 1] is None or best[s] + score[p] > best[e + 1]:
                        best[e + 1], back[e + 1], piece[e + 1] = best[s] + score[p], s, p
            if not single and (best[s + width] is None or best[s] + self.unknown > best[s + width]):
                best[s + width], back[s + width], piece[s + width] = best[s] + self.unknown, s, -1
        return back, piece

    # decoding

    def decode(self, ids) -> str:
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i not in self.control:
                out += self._plain[i]
        text = out.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    @property
    def _plain(self) -> list[bytes]:
        if not hasattr(self, "_plain_pieces"):
            self._plain_pieces = [p.replace(MARK, " ").encode() for p in self.pieces]
        return self._plain_pieces


_models: dict[str, Unigram] = {}


def unigram(path: str) -> Unigram:
    if path not in _models:
        _models[path] = Unigram(path)
    return _models[path]


def encoded(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_byte_ids, and whether decoding gives the text back."""
    small_batches(docs.sparkSession)

    def run(batches):
        model = unigram(path)
        low, high = min(model.byte_of, default=0), max(model.byte_of, default=-1)
        plain = np.array(model._plain, object)
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for first, some in batches_of(texts):
                coded = model.encode(some)
                flat = [np.frombuffer(c, "<u4") for c in coded]
                n_bytes = [int(((f >= low) & (f <= high)).sum()) for f in flat]
                same = [(b"".join(plain[f].tolist())[1:].decode() if not k else model.decode(f.tolist())) == (t or "").replace(MARK, " ") for f, t, k in zip(flat, some, n_bytes, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(some)), pa.array(coded, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(same)], ["doc_id", "ids", "n_byte_ids", "same"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(released(run), "doc_id bigint, ids binary, n_byte_ids bigint, same boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = encoded(read(spark, sf_dir, "documents"), tokenizer_path(MODEL))
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), "n_byte_ids", F.crc32("ids").alias("ids_crc32"), F.col("same").alias("round_trip"))
