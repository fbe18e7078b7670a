"""Encoding, packing and language labelling."""

from __future__ import annotations

import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import bpe, gru, language, packing

tiktoken = pytest.importorskip("tiktoken")
DOCUMENTS = "doc_id long, text string, lang string, source string, id int, ids string, tokens int, no int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 2, 3) for i, t, lang in rows], DOCUMENTS)


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def reference():
    with open(bpe.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(encoder, texts):
    ids, begins = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(begins, begins[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_encoding_equals_the_library(own, reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids_of(own, texts) == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(
    st.lists(
        st.sampled_from(
            [
                " ",
                "  ",
                "\n",
                "the",
                "ing",
                "é",
                "日本語",
                "<|endoftext|>",
                "'ll",
                "1234",
                "aaaa",
                "\x1c",
                "--",
                "👩‍🔬",
                "İ",
                "　",
            ],
        ),
        max_size=40,
    ),
)
def test_encoding_of_hard_pieces(own, reference, pieces):
    text = "".join(pieces)
    assert ids_of(own, [text]) == [reference.encode_ordinary(text)]


def test_encoding_of_one_long_word_and_of_many(own, reference):
    rng = random.Random(3)
    texts = [
        "".join(rng.choice("abcdefg") for _ in range(20_000)),
        " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(5_000)),
        "語" * 3000,
        " " * 999,
    ]
    assert ids_of(own, texts) == [reference.encode_ordinary(t) for t in texts]
    assert own.count(texts).tolist() == [len(reference.encode_ordinary(t)) for t in texts]


def test_encoder_starts_afresh_within_its_bounds(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    encoder = bpe.Encoder(bpe.default_vocabulary())
    for i in range(5):
        texts = [f"words {i} " + " ".join(f"w{i}{k}" for k in range(30))]
        assert ids_of(encoder, texts) == [reference.encode_ordinary(texts[0])]
    assert len(encoder.number) < 200


def test_encoding_of_a_table(spark, reference):
    rows = [
        (1, "Hello <|endoftext|> world", "en"),
        (2, "", "en"),
        (3, None, None),
        (4, "x" * 300_000, "en"),
        (1, "Hello <|endoftext|> world", "en"),
        (None, "a b", "en"),
        (6, " \n", "en"),
    ]
    got = sorted(((r.doc_id, list(r.ids)) for r in bpe.encode_column(documents(spark, rows)).collect()), key=str)
    want = sorted(((i, reference.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    assert got == want
    counts = sorted(((r.doc_id, r.tokens) for r in bpe.count_column(documents(spark, rows)).collect()), key=str)
    assert counts == sorted(((i, len(x)) for i, x in want), key=str)
    assert bpe.encode_column(documents(spark, [])).count() == 0


# --- packing ------------------------------------------------------------------------------------


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(1, 12))
def test_differencing_is_a_partition(sizes, windows):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    window, sums = packing.difference(sizes, windows)
    assert window.min() >= 0 and len(sums) <= windows
    assert np.bincount(window, weights=sizes, minlength=len(sums)).tolist() == sums.tolist()
    if len(sizes) > 2 * windows:
        assert sums.max() - sums.min() <= sizes.max()


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_packing_never_exceeds_the_capacity(sizes):
    sizes = np.array(sizes, np.int64)
    window = packing.pack(sizes, 64)
    if len(sizes):
        assert np.bincount(window, weights=sizes).max() <= 64
        # No worse than twice the least number, as any packing whose windows cannot be merged.
        assert window.max() + 1 <= 2 * -(-int(sizes.sum()) // 64) + 1


def test_packing_is_full():
    rng = np.random.default_rng(5)
    sizes = np.minimum(rng.lognormal(5.2, 0.9, 4000).astype(np.int64) + 1, 2048)
    window = packing.pack(sizes, 2048)
    assert sizes.sum() / (2048 * (window.max() + 1)) > 0.98


@pytest.mark.parametrize("block", [4, 4096])
def test_containers_of_a_table(spark, block):
    sizes = [0, None, 5, 10, 11, 10, 25, 100, 1, 1, 1, 9, 7, 7, 7, 3]
    rows = [(i, s) for i, s in enumerate(sizes)] + [(3, 10), (None, 4)]
    got = packing.containers(spark.createDataFrame(rows, "doc_id long, tokens long"), "doc_id", 10, block).toPandas()
    packed = got[got.container.notna()]
    assert packed.groupby("container").tokens.sum().max() <= 10
    assert sorted(got[got.container.isna()].doc_id.dropna()) == [0, 1]
    for i, s in enumerate(sizes):
        own = got[got.doc_id == i].sort_values("begin")
        if i != 3:
            assert own.tokens.sum() == (s or 0) and len(own) == max(1, -(-(s or 0) // 10))
            assert own.begin.tolist() == [k * 10 for k in range(len(own))]
    for _, own in packed.sort_values("at").groupby("container"):
        assert own["at"].tolist() == np.concatenate([[0], own.tokens.cumsum()[:-1]]).tolist()
    assert packed.tokens.sum() == sum(s or 0 for _, s in rows)
    assert packing.containers(spark.createDataFrame([], "doc_id long, tokens long"), "doc_id", 10).count() == 0
    with pytest.raises(ValueError):
        packing.containers(spark.createDataFrame([], "doc_id long, tokens long"), "doc_id", 0)


def test_packed_documents(spark):
    rows = [(i, "word " * (i % 90), "en") for i in range(200)] + [
        (900, "long " * 500, "en"),
        (901, None, "en"),
        (902, "", "en"),
    ]
    got = packing.packed_documents(documents(spark, rows), 128).toPandas()
    assert set(got.doc_id) == {i for i, _, _ in rows} and got[got.doc_id == 900].tokens.sum() == 501
    assert got[got.container.notna()].groupby("container").tokens.sum().max() <= 128


# --- languages ----------------------------------------------------------------------------------


def test_gradients_are_derivatives():
    rng = np.random.default_rng(1)
    network = gru.Network(3, units=4)
    for k in network.p:
        network.p[k] = network.p[k].astype(np.float64)
    x, lengths = gru.patches([bytes(rng.integers(97, 103, size=s).astype(np.uint8)) for s in (3, 9, 17, 12)])
    target = np.eye(3)[[0, 1, 2, 1]]
    _, grads = network.gradients(x, lengths, target)
    for k, value in network.p.items():
        flat, own = value.reshape(-1), np.asarray(grads[k]).reshape(-1)
        for i in np.argsort(-abs(own))[:4]:
            old = flat[i]
            flat[i] = old + 1e-3
            above = network.gradients(x, lengths, target)[0]
            flat[i] = old - 1e-3
            below = network.gradients(x, lengths, target)[0]
            flat[i] = old
            assert abs((above - below) / 2e-3 - own[i]) < 2e-4


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_sentences_cover_all_text(text):
    spans = language.sentences(text)
    assert all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    outside = text
    for a, b in reversed(spans):
        outside = outside[:a] + outside[b:]
    assert not outside.strip()


def test_sentences_and_what_they_tell():
    text = "One line that is\n wrapped softly. J. Smith wrote an-\nother one! 短い文です。二つ目。\nA heading\n\nV Abc, D Efg\n/srv/p/12.pdf 12 2020-01-01T00:00:00Z"
    parts = [text[a:b] for a, b in language.sentences(text)]
    assert parts[0] == "One line that is\n wrapped softly." and parts[1].startswith("J. Smith") and "A heading" in parts
    assert language.prepared(parts[0]) == "one line that is wrapped softly." and "another" in language.prepared(parts[1])
    assert language.tells("/srv/p/12.pdf 12 2020-01-01T00:00:00Z 10.5555/abc.1") == 0
    assert language.tells("three plain words") == 3 and language.tells("短い文です") >= 2


def test_a_short_sentence_ends_at_an_east_asian_mark():
    text = "我们提出新方法。We propose it as well. 短い文？ J. Smith agrees."
    parts = [text[a:b] for a, b in language.sentences(text)]
    assert parts == ["我们提出新方法。", "We propose it as well.", "短い文？", "J. Smith agrees."]


def test_labels_in_any_spelling():
    known = {
        "en-US": "en",
        "EN": "en",
        "eng": "en",
        "English": "en",
        "pt_BR": "pt",
        "ja-JP": "ja",
        "ger": "de",
        " de ": "de",
        "Español": "es",
    }
    assert {k: language.label_code(k) for k in known} == known
    assert [language.label_code(x) for x in (None, "", " ", "und", "??", "n/a", "unknown", "xx-YY")] == [None] * 8


SEEDS = {
    "en": "the of and that is was with for this have from they which their would about there been".split(),
    "de": "der die und das ist nicht mit den von sie ein auch sich werden wurde einer über".split(),
    "fr": "les des est une dans que pour qui avec sur par plus cette sont mais comme été".split(),
    "ru": "что это как все она был для они только когда было уже если чтобы может".split(),
}


def made(lang, rng, n=9):
    return " ".join(rng.choice(SEEDS[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def network():
    rng = random.Random(0)
    clean = [(k, made(k, rng)) for k in SEEDS for _ in range(10)]
    noisy = [(k if rng.random() > 0.2 else rng.choice(list(SEEDS)), made(k, rng)) for k in SEEDS for _ in range(250)]
    return language.fit(clean, noisy, steps=(120, 80))


def test_held_out_accuracy_with_wrong_labels(network):
    rng = random.Random(99)
    rows = [(k, made(k, rng)) for k in SEEDS for _ in range(100)]
    got = language.Reader(network).pooled([s for _, s in rows])
    assert np.mean([language.LANGUAGES[int(p[: language.NONE].argmax())] == k for (k, _), p in zip(rows, got)]) > 0.97


def test_every_position_is_labelled(network):
    reader = language.Reader(network)
    text = made("ru", random.Random(4)).lower()
    p = reader.positions(text)
    assert p.shape == (len(text.encode()), language.NONE + 1) and np.allclose(p.sum(1), 1, atol=1e-4)


def test_languages_of_a_table(spark, network):
    rng = random.Random(5)
    say = lambda k, n=4: " ".join(made(k, rng) for _ in range(n))
    rows = [
        (1, say("en"), "en-GB"), (2, say("de"), None), (3, say("fr"), "de"), (
            4,
            say("ru") + "\n\n" + say("en"),
            "ru",
        ), (5, None, "en"), (6, " \n", None),
        (7, "10.5555/1.2\n10.5555/3.4\n/srv/a1.pdf", "fr"), (8, say("en", 3000), "unknown"), (2, say("de"), None),
    ]
    docs = documents(spark, rows)
    whole = language.label(docs, None, network, whole=True).where("lang IS NOT NULL").toPandas()
    assert {i: set(x) for i, x in whole.groupby("doc_id").lang} == {
        1: {"en"},
        2: {"de"},
        3: {"fr"},
        4: {"ru", "en"},
        8: {"en"},
    }
    assert whole.confidence.between(0.5, 1).all()
    parts = language.label(docs, None, network).toPandas()
    assert set(parts[parts.lang.isna()].doc_id) == {5, 6, 7} and len(parts[parts.doc_id == 2]) == 2
    own = parts[parts.doc_id == 4].sort_values("begin")
    text = dict((i, t) for i, t, _ in rows)[4]
    assert own.lang.tolist() == ["ru", "en"] and own.end.iloc[0] <= text.index("\n\n") <= own.begin.iloc[1] and own.end.iloc[1] == len(text)
    assert language.label(docs.limit(0), None, network).count() == 0


def test_a_language_changes_within_a_sentence(spark, network):
    rng = random.Random(8)
    first, second = made("ru", rng)[:-1], made("en", rng)
    rows = [(1, f"{first} {second}", None), (2, made("en", rng, 30), None)]
    got = language.label(documents(spark, rows), None, network).orderBy("doc_id", "begin").toPandas()
    assert list(zip(got.doc_id, got.lang)) == [(1, "ru"), (1, "en"), (2, "en")]
    assert abs(got.begin[1] - len(first)) <= 8 and got.end[1] == len(rows[0][1])


def test_training_on_a_table(spark, monkeypatch):
    monkeypatch.setattr(language, "STEPS", (4, 2))
    monkeypatch.setattr(language.fit, "__defaults__", (3, (4, 2)))
    rng = random.Random(6)
    docs = documents(spark, [(i, made(k, rng), k) for i, k in enumerate(list(SEEDS) * 5)])
    samples = spark.createDataFrame(
        [(1, "en", made("en", rng)), (2, "xx", "nothing"), (3, "de", None)],
        "sample_id int, lang string, text string",
    )
    assert set(language.found(docs, samples).columns) == {"doc_id", "lang"}
    assert language.found(docs.limit(0), samples.limit(0)).count() == 0


def test_a_network_is_trained_once_for_a_corpus(spark, monkeypatch):
    rng = random.Random()  # another corpus each time: networks outlive sessions
    monkeypatch.setattr(language, "STEPS", (3, 1))
    docs = documents(spark, [(i, made(k, rng), k) for i, k in enumerate(list(SEEDS) * 3)])
    calls, fit = [], language.fit
    monkeypatch.setattr(language, "fit", lambda clean, picked: calls.append(1) or fit(clean, picked, steps=(3, 1)))
    one, two = language.train_on(docs, None), language.train_on(docs.repartition(3), None)
    assert len(calls) == 1 and all((one.p[k] == two.p[k]).all() for k in one.p)
    language.train_on(docs.where("doc_id > 0"), None)
    assert len(calls) == 2


def test_a_stretch_of_low_confidence_comes_out():
    p = np.full((1, language.NONE + 1), 0.05, np.float32)
    p[0, 3] = 0.4
    assert [s[:3] for s in language.stretches([(0, 9)], [2], p)] == [(0, 9, 3)]


def test_reading_gives_the_states_of_training():
    network = gru.Network(3, 1)
    x, lengths = gru.patches([b"some text", b"x", b"another, longer text of more patches"])
    assert np.array_equal(network._read(x, lengths), network.states(x, lengths)[0])
