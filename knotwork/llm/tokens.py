"""Tokenizer encoding by cached pieces, token files, and reading them back.

Ids are those of the tokenizers library with add_special_tokens=False, its other settings as they are: the string of a
special token in a text is that token. Such a text goes to the library whole. Any other text is cut only where the
tokenizer itself always cuts, so the ids of the pieces, one after another, are the ids of the text: at ASCII white space
for a tokenizer that drops white space, and for the byte-level one before a single space or newline between two
characters that are not white space. Each worker keeps the ids of pieces it has met (at most `cache`, those met first);
new pieces go to the tokenizers library.

Defined results: null and empty texts have no ids but the end id; one very long text is encoded whole in one worker; rows
that repeat a doc_id are written one by one, null ids first, equal ids in the order of a hash of the text (so that many
rows of one id are spread over parts); ids beyond 16 bits make all files 32 bits wide; an empty table gives no part and
an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, released, shared_dir, small_batches

CACHE = 800_000
WORD_TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"
_DOUBLE = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Letters that every Unicode version and both tokenizers take for letters and that normalisation leaves alone.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]{0,8})")


def _byte_level() -> dict[int, str]:
    """The printable characters that byte-level tokenizers write bytes with: bytes that print stand for themselves, the
    others follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LEVEL = _byte_level()


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.limit, self.known, self.tails = cache, {}, {}
        spec = json.load(open(path, encoding="utf-8"))
        self.cut = self._whole
        added = spec.get("added_tokens") or []
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            return  # such a token may also be found in a changed text: no cutting
        before = spec.get("pre_tokenizer") or {}
        steps = before.get("pretokenizers", [])
        if not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            self.cut = self._spaces
        elif steps and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"[^\s\p{L}\p{N}]+" in steps[0].get("pattern", {}).get("Regex", ""):
            self.cut = self._words

    @staticmethod
    def _whole(text: str) -> list[str]:
        return [text]

    @staticmethod
    def _words(text: str) -> list:
        return text.encode().split()

    @staticmethod
    def _spaces(text: str) -> list[str]:
        if _DOUBLE.search(text):
            return ["\0" + x for x in _CUT.split(text)]
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\0" + pieces[0]
        return pieces

    def _text(self, piece) -> str:
        if self.cut == self._words:
            return piece.decode()
        if self.cut == self._spaces:
            return piece[1:] if piece[:1] == "\0" else piece if piece[:1] == "\n" else " " + piece
        return piece

    def encode(self, texts: list[str | None]) -> list[bytes]:
        pieces = [self.cut(t or "") for t in texts]
        whole = {i: t for i, t in enumerate(texts) if t and self.special and self.special.search(t)}
        for i in whole:
            pieces[i] = []
        new = set()
        for p in pieces:
            new.update(set(p).difference(self.known))
        full = len(self.known) + len(new) > self.limit
        self._learn(list(new))
        known = self.known
        out = [b"".join([known[x] for x in p]) for p in pieces]
        for i, t in whole.items():
            out[i] = array("I", self.model.encode(t, add_special_tokens=False).ids).tobytes()
        if full:  # what was met first stays: frequent pieces are among it
            for p in new:
                del known[p]
        return out

    def _learn(self, new: list) -> None:
        """A word of plain letters goes straight to the library's model, what follows it in punctuation is met apart; the rest
        goes through the whole tokenizer, many pieces a call (each token says which piece it is of)."""
        known, tails, rest = self.known, self.tails, []
        for p in new:
            text = self._text(p)
            if self.cut == self._whole or not (m := _PLAIN.fullmatch(text)):
                rest.append(p)
                continue
            word, tail = m.groups()
            ids = [t.id for t in self.model.model.tokenize((word.lower() if self.cut == self._words else word).encode().decode("latin-1").translate(_BYTE_LEVEL))]
            got = array("I", ids).tobytes()
            if tail:
                if tail not in tails:
                    tails[tail] = array("I", self.model.encode(tail, add_special_tokens=False).ids).tobytes()
                got += tails[tail]
            known[p] = got
        for i in range(0, len(rest), 2000):
            some = rest[i : i + 2000]
            made = self.model.encode([self._text(p) for p in some], is_pretokenized=True, add_special_tokens=False)
            ids, at = np.array(made.ids, "<u4"), np.searchsorted(np.array(made.word_ids, np.int64), np.arange(len(some) + 1)).tolist()
            for k, p in enumerate(some):
                known[p] = ids[at[k] : at[k + 1]].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One for each worker process, kept between tasks. Threads of the library stay off: tasks are the parallelism."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders or _encoders[path].limit != cache:
        _encoders.clear()
        _encoders[path] = Encoder(path, cache)
    return _encoders[path]


def batches_of(texts: list, limit: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """(first, texts) with about limit characters each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


# --- token files -----------------------------------------------------------------------------------------------------

NO_ID = -(2**63)


class Part(NamedTuple):
    """A part's number, the ids before it, its documents, and the names of its files."""

    part: int
    base: int
    docs: int
    name: str


_PARTS = "part bigint, base bigint, docs bigint, name string"


def _fs(folder: str):
    return pafs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, chunks) -> None:
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}") as out:
        for c in chunks:
            out.write(c)


def _get(folder: str, name: str, dtype: str) -> np.ndarray:
    """Memory-mapped where the folder is mounted, read otherwise."""
    fs, path = _fs(folder)
    path = f"{path}/{name}"
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if fs.get_file_info(path).size else np.zeros(0, dtype)
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read(), dtype)


def is_wide(path: str, end: int) -> bool:
    """Whether ids of this tokenizer, or the end id, need 32 bits."""
    from tokenizers import Tokenizer

    return max(end, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) > 0xFFFF


def write_tokens(docs: DataFrame, folder: str, path: str, end: int, text: str = "text", key: str = "doc_id") -> list[Part]:
    """Write <name>.bin (flat unsigned 16- or 32-bit ids) and <name>.idx (doc ids, 64-bit global offsets) for each part, in
    ascending doc_id order, and manifest.json, which lists the parts.

    Rows are dealt by ranges of doc_id. A part's base is the sum of the ids in the parts before it; one row for each
    part goes through the driver. Every attempt of a task writes files of its own name; those of the attempts that
    counted are in the manifest, the others are removed.
    """
    small_batches(docs.sparkSession)
    dtype = "<u4" if is_wide(path, end) else "<u2"

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        ids, sizes = [], []

        def flat():
            model = encoder(path)
            for b in batches:
                keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                ids.extend(NO_ID if k is None else k for k in keys)
                for _, some in batches_of(texts):
                    for coded in model.encode(some):
                        a = np.append(np.frombuffer(coded, "<u4"), np.uint32(end))
                        sizes.append(len(a))
                        yield a.astype(dtype).tobytes()

        _put(folder, f"{name}.bin", flat())
        _put(folder, f"{name}.len", [np.array([ids, sizes], "<i8").tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([sum(sizes)], pa.int64()), pa.array([name])], ["part", "docs", "ids", "name"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    made = dealt.mapInArrow(released(write), "part bigint, docs bigint, ids bigint, name string").collect()
    parts, base = [], 0
    for r in sorted(made):
        if r["docs"]:
            parts.append(Part(r["part"], base, r["docs"], r["name"]))
        base += r["ids"]

    def index(batches):
        for b in batches:
            names = []
            for start, name in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                ids, sizes = _get(folder, f"{name}.len", "<i8").reshape(2, -1)
                names.append(f"{name}-{uuid.uuid4().hex}.idx")
                _put(folder, names[-1], [ids.tobytes(), (start + np.concatenate([[0], np.cumsum(sizes)])).astype("<i8").tobytes()])
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(names, pa.string())], ["name", "idx"])

    indexed = {r["name"]: r["idx"] for r in _parts(docs.sparkSession, parts).mapInArrow(index, "name string, idx string").collect()}
    _commit(folder, parts, indexed, dtype)
    return parts


def _commit(folder: str, parts: list[Part], indexed: dict[str, str], dtype: str) -> None:
    """Give the index files that counted their names, write the manifest, remove what it does not list."""
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    for name, idx in indexed.items():
        fs.move(f"{path}/{idx}", f"{path}/{name}.idx")
    kept = {f"{p.name}.{x}" for p in parts for x in ("bin", "idx")}
    for f in fs.get_file_info(pafs.FileSelector(path)):
        if f.base_name not in kept:
            fs.delete_file(f.path)
    _put(folder, "manifest.json", [json.dumps({"dtype": dtype, "parts": parts}).encode()])


def read_manifest(folder: str) -> tuple[str, list[Part]]:
    """The width of the ids and the parts of a folder of token files."""
    fs, path = _fs(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        got = json.loads(f.read())
    return got["dtype"], [Part(*p) for p in got["parts"]]


def _parts(spark: SparkSession, parts: list[Part]) -> DataFrame:
    return spark.createDataFrame([tuple(p) for p in parts], _PARTS).repartition(max(1, len(parts)), "part")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the mapped files that the manifest lists."""
    dtype, parts = read_manifest(folder)

    def load(batches):
        for b in batches:
            for base, n, name in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True):
                flat, idx = _get(folder, f"{name}.bin", dtype), _get(folder, f"{name}.idx", "<i8")
                ids, at = idx[:n], idx[n:]
                crc = [zlib.crc32(flat[s - base : e - base].astype("<u4").tobytes()) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _parts(spark, parts).mapInArrow(released(load), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), folder, tokenizer_path(WORD_TOKENIZER), 2)
    return read_tokens(spark, folder)
