import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import tokens
from corpusloom.llm.textops import text_slices
from tests.llm.helpers import doc, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.read_spec(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counted(counter, texts):
    return [int(n) for _, _, data, offsets in text_slices(pa.array(texts, pa.string()))
            for n in counter.count(data, offsets)]


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_equal_to_the_library_on_mixed_characters(counter, library):
    rng = random.Random(4)
    pieces = [*"aabst remvld'''  \n\t é12٣漢字!.-<|>😀́\x1c\x85", "<|endoftext|>",
              "'re", "'ll", "'s", " the", "ing"]
    texts = ["", " ", "  ", "\n\n a", "x<|endoftext|>  y", "<|endoftext|><|endoftext|>", "'s",
             "a" * 3000, " " * 700 + "b", "'re're'" * 90]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(70))) for _ in range(4000)]
    assert counted(counter, texts) == expected(library, texts)


def test_equal_to_the_library_on_every_code_point(counter, library):
    points = [chr(i) for i in range(1, 0x110000, 7) if not 0xD800 <= i < 0xE000]
    texts = [f"a{p}b {p} 1{p}2" for p in points]
    assert counted(counter, texts) == expected(library, texts)


def test_forgotten_pieces_are_compiled_again(counter, library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 3)
    texts = ["one two three four five six"] * 2 + ["seven one"]
    for text in texts:
        assert counted(counter, [text]) == expected(library, [text])


def test_unbroken_words_are_one_walk(counter, library):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choices(letters, k=100_000)), "".join(rng.choices("etaoin", k=50_000)),
             "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(20_000)),
             "漢字かな" * 20_000, "=" * 70_001, "ab" * 33_333, "aab" * 5_001]
    started = time.process_time()
    got = counted(counter, texts)
    assert time.process_time() - started < 30  # merging rank by rank took 23 s for the first
    assert got == expected(library, texts)


def test_forgotten_transitions_are_built_again(counter, library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_ARCS", 50)
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(1, 60))) for _ in range(300)]
    assert counted(counter, words) == expected(library, words)
    assert len(counter.merger.arcs) <= 51


def test_each_entry_that_its_bytes_give_is_one_token(counter, library):
    for entry in list(counter.merger.tokens)[::17]:
        try:
            text = entry.decode()
        except UnicodeDecodeError:
            continue
        assert counter.merger.compile([entry]) == [1]
        assert len(library.encode(text, add_special_tokens=False).ids) >= 1


def test_rows(spark, library):
    long = "word éé " * 40_000
    rows = [doc(1, "Hello world"), doc(1, "Hello world"), doc(2, None), doc(None, ""),
            doc(3, long), doc(4, "x " * 600)]
    docs = table(spark, rows).selectExpr("*", "1 AS n_tokens", "2 AS n_bytes")
    got = [r.asDict() for r in tokens.count_tokens(docs, PATH).collect()]
    assert len(got) == 6
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2] == {"doc_id": 2, "n_bytes": 0, "n_tokens": 0, "over_limit": False}
    assert by_id[3]["n_tokens"] == expected(library, [long])[0]
    assert by_id[3]["n_bytes"] == len(long.encode()) and by_id[3]["over_limit"]
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0
