import struct
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattice.llm import bpe_automaton as m

tokenizers = pytest.importorskip("tokenizers")
with open(m.vocabulary_path(), encoding="utf-8") as f:
    AUTOMATON = m.Automaton(f.read())
PLAIN = tokenizers.Tokenizer.from_file(m.vocabulary_path())
PLAIN.no_truncation()
PLAIN.no_padding()


def check(text):
    ids = PLAIN.encode(text, add_special_tokens=False).ids
    coded = AUTOMATON.encode(text)
    assert coded == struct.pack(f"<{len(ids)}I", *ids)
    assert AUTOMATON.decode(coded) == PLAIN.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aaabbcde  \n\t'stdm1 　\x1c\x85é漢😀½$"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_as_the_library(text):
    check(text)


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "a" * 5000, " " * 700, "\n\n  x", "the " * 1000, "it's we'll I'D"])
def test_cases(text):
    check(text)


def test_tiny_automaton_accepts_only_correct_pairs():
    vocab = {s: i for i, s in enumerate(m.byte_symbols())}
    merges = [("a", "a"), ("a", "b"), ("aa", "ab"), ("b", "aa")]
    for k, (x, y) in enumerate(merges):
        vocab[x + y] = 256 + k
    import json

    automaton = m.Automaton(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
    back = {i: s for s, i in vocab.items()}

    def merged(word):
        parts = list(word)
        for x, y in merges:
            i, out = 0, []
            while i < len(parts):
                if parts[i : i + 2] == [x, y]:
                    out.append(x + y)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    for n in range(1, 1 << 9):
        word = bin(n)[3:].replace("0", "a").replace("1", "b")
        ids = automaton.encode_word(word.encode())
        assert [back[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids)] == merged(word)


def test_rows(spark):
    rows = [(1, "héllo wörld", "ids", 3), (1, "héllo wörld", "ids", 3), (2, None, "ids", 3), (None, "x", "ids", 3), (4, "long " * 300_000, "ids", 3)]
    got = {r["doc_id"]: r for r in m.digests(spark.createDataFrame(rows, "doc_id long, text string, decoded string, n_tokens int")).collect()}
    assert got[2]["n_tokens"] == 0 and got[2]["ids_sha256"] == sha256(b"").hexdigest()
    assert got[4]["decoded_sha256"] == sha256(("long " * 300_000).encode()).hexdigest()
    assert None in got
    assert m.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_memory_of_a_long_word():
    import tracemalloc

    with open(m.vocabulary_path(), encoding="utf-8") as f:
        a = m.Automaton(f.read())
    word = "\u6f22\u5b57\u5566" * 120_000
    a.encode("warm")
    tracemalloc.start()
    ids = a.encode(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert a.decode(ids) == word and peak < 40 * len(word.encode())
