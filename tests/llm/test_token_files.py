"""Token files and packed windows against a fresh tokenizer, id by id."""

import collections
import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from knotwork.llm import packing, tokens, unigram
from knotwork.llm.tokens import BYTE_TOKENIZER, WORD_TOKENIZER, tokenizer_path

SCHEMA = "doc_id bigint, text string, part int, name string"


def corpus():
    rng = random.Random(6)
    words = ["the", "Größe", "don't", "x1", "日本", "<|endoftext|>", "...", "naïve"]
    rows = [(i % 23 if i % 5 else None, " ".join(rng.choices(words, k=rng.choice([0, 1, 7, 300])))) for i in range(90)]
    return [*rows, (3, None), (3, ""), (7, "long " * 9000), *[(11, "same text")] * 40]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in corpus()], SCHEMA).repartition(3)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("name", "end"), [(WORD_TOKENIZER, 2), (BYTE_TOKENIZER, 0), (BYTE_TOKENIZER, 70_000)])
def test_files(spark, docs, tmp_path, name, end):
    library = Tokenizer.from_file(tokenizer_path(name))
    folder = f"file://{tmp_path}"
    parts = tokens.write_tokens(docs, folder, tokenizer_path(name), end)
    want = collections.Counter((str(i), tuple([*library.encode(t or "", add_special_tokens=False).ids, end])) for i, t in corpus())
    dtype, listed = tokens.read_manifest(folder)
    assert listed == parts and dtype == ("<u4" if end > 65535 else "<u2")
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(["manifest.json", *[f"{p.name}.{x}" for p in parts for x in ("bin", "idx")]])
    got, at, last = collections.Counter(), 0, -(2**63)
    for p in parts:  # the files by themselves, without the reader
        flat, idx = np.fromfile(tmp_path / f"{p.name}.bin", dtype), np.fromfile(tmp_path / f"{p.name}.idx", "<i8")
        assert p.base == at
        for doc, s, e in zip(idx[: p.docs], idx[p.docs : -1], idx[p.docs + 1 :], strict=True):
            assert s == at and doc >= last
            got["None" if doc == tokens.NO_ID else str(doc), tuple(flat[s - p.base : e - p.base].tolist())] += 1
            at, last = e, doc
    assert got == want
    back = sorted((r.start, str(r.doc_id), r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(spark, folder).collect())
    assert sum(r[2] for r in back) == at and [r[0] for r in back] == np.cumsum([0, *[r[2] for r in back]])[:-1].tolist()
    assert collections.Counter((i, n, c) for _, i, n, c in back) == collections.Counter({(i, len(x), crc(x)): n for (i, x), n in want.items()})


def test_leftover_files_are_not_read(spark, docs, tmp_path):
    folder = f"file://{tmp_path}"
    (tmp_path / "part-000000-lost.bin").write_bytes(b"123")
    (tmp_path / "part-000000-lost.idx").write_bytes(b"123")
    tokens.write_tokens(docs.limit(5), folder, tokenizer_path(WORD_TOKENIZER), 2)
    assert tokens.read_tokens(spark, folder).count() == 5 and not (tmp_path / "part-000000-lost.bin").exists()
    assert json.loads((tmp_path / "manifest.json").read_text())["parts"]


def test_no_documents(spark, docs, tmp_path):
    assert tokens.write_tokens(docs.limit(0), f"file://{tmp_path}", tokenizer_path(WORD_TOKENIZER), 2) == []
    assert tokens.read_tokens(spark, f"file://{tmp_path}").count() == 0


def test_packed(docs):
    path = tokenizer_path(BYTE_TOKENIZER)
    library = Tokenizer.from_file(path)
    want = collections.Counter((str(i), tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in corpus())
    pieces = packing.packed(docs, path).collect()
    windows = collections.defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append((r.offset, r.length, r.tier, r.step_group))
    padding = 0
    for w in windows.values():
        at = 0
        for offset, n, tier, _ in sorted(w):
            assert offset == at and tier == sum(x[1] for x in w)
            at += n
        assert at <= 1024 and len({x[3] for x in w}) == 1
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    lengths = collections.Counter(len(x) for _, x in want)
    by_doc = collections.defaultdict(list)
    for r in pieces:
        by_doc[str(r.doc_id), r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    cut = collections.Counter()
    for (i, ids), n in want.items():
        mine = by_doc[i, len(ids)]
        for s, m, c in set(mine):
            if crc(ids[s : s + m]) == c:
                cut[i, ids] += m * mine.count((s, m, c))
        assert cut[i, ids] >= n * len(ids)
    assert sum(r.length for r in pieces) == sum(n * len(x) for (_, x), n in want.items()) and lengths


def test_step_groups():
    rng = random.Random(1)
    totals = [rng.choice([1024, 512, 64, 1]) for _ in range(3000)]
    got = packing.step_groups(totals, 4096)
    sums = np.bincount(got, totals)
    assert len(got) == 3000 and sums.max() - sums.min() <= 1024 and packing.step_groups([]) == []


def test_pieces_query(spark, docs, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    path = tokenizer_path(unigram.MODEL)
    model = pb.ModelProto()
    model.ParseFromString(open(path, "rb").read())
    model.trainer_spec.model_type = 1
    for p, s in zip(model.pieces, unigram.Unigram(path).score, strict=True):
        p.score = float(s)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    want = collections.Counter((str(i), len(ids), crc(ids)) for i, t in corpus() for ids in [library.encode(t or "")])
    rows = unigram.query(spark, str(tmp_path)).collect()
    assert collections.Counter((str(r.doc_id), r.n_pieces, r.ids_crc32) for r in rows) == want and all(r.round_trip for r in rows)
