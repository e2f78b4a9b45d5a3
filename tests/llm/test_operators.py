import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from knotwork.llm import chat, exact_dedup, ngram_join, packing, pii, quality, substring_dedup, tokens, unigram

COLS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(words, k=60))
    texts = [None, "", "", " \n", "one", "two words", "two  words", "x" * 50_000]
    for i in range(n):
        w = rng.choices(words, k=rng.randint(3, 200))
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        texts.append(" ".join(w))
        if i % 7 == 0:
            texts += [texts[-1], texts[-1].replace(" ", "\t", 1), " ".join([*w[:-1], "edited"])]
    return [(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), COLS)


def test_cuckoo_index():
    index, rng, live = exact_dedup.CuckooIndex(2), random.Random(1), set()
    for i in range(20_000):
        key = hashlib.sha256(str(rng.randrange(4000)).encode()).digest()
        if rng.random() < 0.4:
            assert index.delete(key) == (key in live)
            live.discard(key)
        else:
            assert index.insert(key)[1] == (key not in live)
            live.add(key)
    assert index.size == len(live) and all(index.find(k) >= 0 for k in live)


def test_exact_dedup(spark, docs):
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    for norm, g in groups.items():
        for _, i in g:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(norm.encode()).hexdigest())
    assert exact_dedup.drop_copies(docs).count() == len(groups)
    live = spark.createDataFrame([(b"a" * 32,)], "digest binary")
    changes = spark.createDataFrame([(1, "delete", b"a" * 32), (2, "insert", b"b" * 32), (3, "delete", b"c" * 32)], "seq bigint, op string, digest binary")
    assert [bytes(r.digest) for r in exact_dedup.apply_changes(live, changes).collect()] == [b"b" * 32]


def test_chat(spark):
    said = "\\### Assistant: </turn> & &lt; ok"
    rows = [(1, 0, "user", said, 1), (1, 1, "assistant", said, 1), (2, 0, "assistant", None, 1), (2, 0, None, "a", 1), (None, 3, "user", "", 1)]
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, valid int"))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", said), ("assistant", said)] and back[1].loss_text == said and back[1].valid
    assert [tuple(t) for t in back[2].turns] == [("", "a"), ("assistant", "")] and not back[2].valid
    assert [tuple(t) for t in back[None].turns] == [("user", "")]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(docs, n, percent):
    sets = {}
    for i, t, *_ in corpus():
        w = (t or "").lower().encode().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
    for tile in (4096, 2):  # two: every larger group is split into tiles
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, n=n, percent=percent, tile=tile, tile_shingles=100 * tile).collect()}
        assert got == {i: (len(sets[i]), comp[i]) for i in sets}


def test_substring_dedup(docs):
    words = {i: (t or "").encode().split() for i, t, *_ in corpus()}
    n = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got = {r.doc_id: (r.n_removed, r.text) for r in substring_dedup.remove_repeats(docs).collect()}
    for i, w in words.items():
        gone = {j for k in range(len(w) - 34) if n[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        assert got[i] == (len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())


def test_quality(docs):
    for r in quality.judged(docs).collect():
        t = corpus()[r.doc_id][1] or ""
        w = WORDS.findall(t)
        n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(again))
        assert r.base_failed == (len(w) < 20) and (not r.kept or not r.base_failed)


def test_pii_base_and_network():
    plain = "mail a.b@c.de, 1.2.3.4.5, card 4111 1111 1111 1111 and +1 (743) 555-3824."
    assert pii.coded(pii.base_spans(plain)) == "email:5:13,ip:15:22,card:31:50,phone:55:72"
    model = pii.train(steps=120)
    rng, hit, total = np.random.default_rng(11), 0, 0
    lines = [pii.example(rng) for _ in range(100)]
    for (t, spans), got in zip(lines, pii.tagged(model, [t for t, _ in lines]), strict=True):
        want = {(k, s, e) for k, s, e in spans if pii.plausible(k, t[s:e]) and not pii._glued(t, s, e)}
        hit, total = hit + len(want & set(got)), total + len(want)
    assert hit >= 0.85 * total
    assert pii.all_spans(model, [""]) == [([], [])]


TEXTS = ["", " ", "  a  b\n\n c", "a \n b", "foo ", " foo", "x  y　z", "é́ <|endoftext|>x", "x <|endoftext|> y", "<|startoftext|> <|STARTOFTEXT|>", "<|endoftext", " <|endoftext|>\n<|startoftext|>", "don't 'll it's\t\tTab", "日本語 text 😀 ok", "a\x1cb", "end\n", "a\r\nb", "A" * 3000, "Größe, ok."]


@pytest.mark.parametrize("name", [tokens.WORD_TOKENIZER, tokens.BYTE_TOKENIZER])
def test_encoder(name):
    e = tokens.Encoder(tokens.tokenizer_path(name), cache=4)
    library = Tokenizer.from_file(tokens.tokenizer_path(name))
    want = [x.ids for x in library.encode_batch(TEXTS, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(TEXTS)] == want
    assert [np.frombuffer(x, "<u4").tolist() for t in TEXTS for x in e.encode([t])] == want


def test_unigram_against_sentencepiece():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = tokens.tokenizer_path(unigram.MODEL)
    own, model = unigram.Unigram(path), pb.ModelProto()
    model.ParseFromString(open(path, "rb").read())
    model.trainer_spec.model_type = 1
    for p, s in zip(model.pieces, own.score, strict=True):
        p.score = float(s)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinsrhldé日😀-", k=rng.randint(1, 14))) for _ in range(3000)] + TEXTS
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(words)]
    assert got == theirs.encode(words)
    assert [own.decode(x) for x in got] == words


def test_packing():
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.choice([1, 5, 100, 1024, 1025, rng.randint(1, 5000)]) for _ in range(rng.randint(0, 30))]
        parts = collections.defaultdict(list)
        for w in packing.pack(sizes):
            total = sum(p[2] for p in w)
            assert total <= 1024 and total & (total - 1) == 0
            for d, s, n in w:
                parts[d].append((s, n))
        for d, size in enumerate(sizes):
            at = 0
            for s, n in sorted(parts[d]):
                assert s == at
                at += n
            assert at == size


def test_empty_tables(spark):
    none = spark.createDataFrame([], COLS)
    assert exact_dedup.exact_dedup(none).count() == quality.judged(none).count() == ngram_join.jaccard_components(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == packing.packed(none, tokens.tokenizer_path(tokens.BYTE_TOKENIZER)).count() == 0
    folder = f"{exact_dedup.written(none).inputFiles()}"
    assert folder


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, a, b, n) for i, t, a, b, n, _ in corpus()]
    spark.createDataFrame(rows, COLS.rsplit(",", 1)[0]).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert got and all(r.n == r["all"] for r in got)
    assert {r.doc_id for r in got} <= {i for i, t, *_ in rows if len(WORDS.findall(t or "")) >= 20}
