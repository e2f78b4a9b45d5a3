"""Nulls in every column, repeated rows, long texts, clashing further columns and empty tables."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from knotwork.llm import chat, exact_dedup, ngram_join, packing, pii, quality, substring_dedup, tokens, toxicity, unigram

COLS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, ids string, n bigint, rep bigint, component string, digest string, score string"
MORE = ("x", "x", 1, 2, "x", "x", "x")
LONG = "word " * 60_000
ROWS = [(None, None, None, None, None, *MORE), (1, None, "en", None, 0, *MORE), (1, None, "en", None, 0, *MORE), (2, "", None, "s", 0, *MORE), (3, LONG, "en", "s", 5, *MORE), (4, "mail a@b.co now", "en", "s", 5, *MORE), (4, "mail a@b.co now", "en", "s", 5, *MORE)]
TOXIC = toxicity.Model(b" plain words zwitknob ", b" plain words ", (2, 4), (-2.0, 1.0, 0.1, 1.0, 0.1))


@pytest.fixture(scope="module", params=[ROWS, []], ids=["odd", "empty"])
def case(request, spark):
    return request.param, spark.createDataFrame(request.param, COLS)


@pytest.fixture(scope="module")
def small():
    return pii.train(steps=3)


def test_row_operators(case, small):
    rows, docs = case
    path = tokens.tokenizer_path(unigram.MODEL)
    assert exact_dedup.exact_dedup(docs).count() == quality.judged(docs).count() == substring_dedup.remove_repeats(docs).count() == len(rows)
    assert toxicity.scored(docs, TOXIC).where("score between 0 and 1").count() == len(rows)
    assert unigram.encoded(docs, path).where("same").count() == len(rows)
    found = pii.found(docs, small).collect()
    assert len(found) == len(rows) and sum(r.n_email for r in found) == (2 if rows else 0)
    clean = pii.redacted(docs, small)
    assert clean.columns == docs.columns and sorted(str(r.text)[:12] for r in clean.collect()) == sorted("mail <EMAIL>" if r[0] == 4 else str(r[1])[:12] for r in rows)


def test_join(case):
    rows, docs = case
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.jaccard_components(docs).collect())
    assert got == sorted((str(r[0]), {3: 1, 4: 1}.get(r[0], 0), str(r[0])) for r in rows)


def test_token_outputs(case, spark, tmp_path):
    rows, docs = case
    path = tokens.tokenizer_path(tokens.BYTE_TOKENIZER)
    model = Tokenizer.from_file(path)
    sizes = sorted((str(r[0]), len(model.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    tokens.write_tokens(docs, f"file://{tmp_path}", path, 0)
    back = tokens.read_tokens(spark, f"file://{tmp_path}").collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in back) == sizes
    assert sum(r.length for r in packing.packed(docs, path).collect()) == sum(n for _, n in sizes)


def test_chats_of_none(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, valid int, turns string")
    assert chat.read_back(chat.format_chats(none)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """The run against plain Python, given the quality verdicts (they have a test of their own)."""
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(5000)}"
    texts = [" ".join(word() for _ in range(120)) for _ in range(12)]
    texts += [texts[0] + " ", texts[1].replace("w", "W", 1), texts[2].rsplit(" ", 1)[0] + " edited", "short one", None, texts[3] + " write to ann.lee@mail.org"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    kept: dict[str, int] = {}
    for i in sorted(good, key=lambda i: (-len(texts[i]), i)):
        kept.setdefault("".join(texts[i].split()), i)
    sets = {}
    for i in sorted(kept.values()):
        w = texts[i].lower().split()
        mine = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        sets[i] = mine
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    model, tagger = Tokenizer.from_file(tokens.tokenizer_path(tokens.BYTE_TOKENIZER)), pii.tagger()
    want = {}
    for i in {i for i in sets if comp[i] == i}:
        t = texts[i]
        for k, s, e in sorted(pii.all_spans(tagger, [t])[0][1], key=lambda x: -x[1]):
            t = f"{t[:s]}<{pii.KINDS[k].upper()}>{t[e:]}"
        want[i] = [*model.encode(t, add_special_tokens=False).ids, 0]
    seen: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = want[r.doc_id]
        piece = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(piece)
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {i: len(x) for i, x in want.items()} and len(seen) < len(good)
