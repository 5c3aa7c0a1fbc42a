"""SentencePiece: against the library, and the defined cases."""

import hashlib
import random

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")

from faultsieve.llm import sentencepiece_bpe as S  # noqa: E402

PATH = tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "the the the", "  two  spaces ", "line\nline\n\n", "▁ sign", "日本語 한국 🙂 ́", "<s> hi </s> <0x41>", "\t\0x", " " * 100, "▁" * 33 + "the", "x" * 3000, "ab" * 500]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary(open(PATH, "rb").read())


def test_merge_rounds_equal_the_library(library, vocabulary):
    random.seed(3)
    parts = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "日", "🙂", "x" * 4, "12", "<s>", "\t", "ing", "er", " " * 17, "und", "ção"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 50))) for _ in range(3000)]
    got = [ids for g in S.groups(texts, 5000) for ids in S.Encoder(vocabulary).encode(g)]
    for text, ids, want in zip(texts, got, library.encode(texts, add_bos=True, add_eos=True)):
        assert ids.tolist() == want, text
        assert vocabulary.decode(ids) == library.decode(want), text


def test_decoding_any_ids_equals_the_library(library, vocabulary):
    random.seed(4)
    for _ in range(1500):
        ids = [random.randrange(32000) if random.random() < 0.5 else random.randrange(3, 259) for _ in range(random.randint(0, 12))]
        assert vocabulary.decode(np.array(ids, dtype=np.int64)) == library.decode(ids), ids


def test_runs_of_spaces(library, vocabulary):
    encoder = S.Encoder(vocabulary)
    for n in range(1, 60):
        for end in ("", "the", "\n"):
            text = " " * n + end
            assert encoder.encode([text])[0].tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_long_words(library, vocabulary):
    rng = random.Random(3)
    texts = ["".join(rng.choices(letters, k=n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "etaoinshr", "0123456789abcdef", "aé漢😀-", "ab▁") for n in (33, 200, 60_000)]
    for text, ids in zip(texts, S.Encoder(vocabulary).encode(texts)):
        assert ids.tolist() == [1, *library.encode(text), 2]


def test_round_trip_query(documents, library):
    docs = documents([*enumerate(TEXTS), (0, None), (None, "no id"), (3, "a")])
    rows = S.round_trip(docs, PATH).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_encode_then_decode(documents, library):
    docs = documents([(1, "some words here"), (2, None)])
    assert {r.doc_id: r.text for r in S.decode(S.encode(docs, PATH), PATH).collect()} == {1: "some words here", 2: ""}
    assert S.round_trip(documents([]), PATH).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        S.Vocabulary(b"")


def test_workers_take_batches_in_slices():
    import pyarrow as pa

    from faultsieve.llm.common import ROWS, slices

    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 1, ROWS, 3 * ROWS + 7)]
    parts = list(slices(iter(batches)))
    assert [p.num_rows for p in parts] == [1, ROWS, ROWS, ROWS, ROWS, 7]
    assert [x for p in parts for x in p.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]
