"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens that accepts exactly the correct tokenizations.
It begins as one state with an arc to itself for each byte. The gadget for a merge (u, v) adds a copy of the state that
all u-arcs lead to, without its v-arc, turns all u-arcs to the copy, and gives each state with a u-arc an arc for uv to
where v leads. All arcs of one label thus always lead to the same state, so the compiled tables hold one target for each
token, and of each state its parent, the one arc it lacks and the merge at which it came to be: 3 numbers a merge in
place of some billions of arcs. Whether a state has an arc is read off these by walking up parents and left parts.

A pre-split word is encoded by following arcs over its bytes: each prefix has one correct tokenization, so one state is
kept for each position. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_ready, table

#: White space as the vocabulary's library understands it.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What splits text into words before the merges.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Words a worker keeps the codes of; at more it starts afresh. It bounds memory and has no influence on results.
KEPT_WORDS = 400_000
#: Characters of such a word, at most; longer ones are rare, and encoded anew each time.
KEPT_CHARS = 128
#: Matches taken at a time from one text.
STEP = 1 << 18


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    symbols, more = [], 256
    for b in range(256):
        symbols.append(chr(b) if b in shown else chr(more))
        more += b not in shown
    return symbols


class Automaton:
    def __init__(self, vocabulary: str):
        """vocabulary: the JSON text of a byte-level BPE tokenizer."""
        spec = json.loads(vocabulary)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        of_symbol = {s: b for b, s in enumerate(byte_symbols())}
        size = max([*vocab.values(), *added.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.labels[i] = bytes(of_symbol[c] for c in token) if all(c in of_symbol for c in token) else token.encode()
        for token, i in added.items():
            self.labels[i] = token.encode()
        self.special = added
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.split = regex.compile(SPLIT)
        # tokens: the merge that makes each (-1: a byte), its left part, and the state that its arcs lead to
        self.made, self.left, self.target = [-2] * size, [-1] * size, [0] * size
        # states
        self.parent, self.lacks, self.birth = [0], [-1], [-1]
        for symbol in of_symbol:
            if symbol in vocab:
                self.made[vocab[symbol]] = -1
        for step, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(step, vocab[a], vocab[b], vocab[a + b])
        self.arcs: dict[int, bool] = {}
        self.trie: dict = {}
        for i in vocab.values():
            if self.made[i] > -2:
                node = self.trie
                for c in self.labels[i]:
                    node = node.setdefault(c, {})
                node[-1] = i
        self.words = _Words(self)

    def _gadget(self, step: int, u: int, v: int, uv: int) -> None:
        if self.made[uv] != -2:
            raise ValueError("two merges make the same token")
        if self.made[u] == -2 or self.made[v] == -2 or not self.has_arc(self.target[u], v):
            return  # no tokenization has u before v any more
        self.made[uv], self.left[uv], self.target[uv] = step, u, self.target[v]
        self.parent.append(self.target[u])
        self.lacks.append(v)
        self.birth.append(step)
        self.target[u] = len(self.parent) - 1

    def has_arc(self, state: int, token: int) -> bool:
        made, left, birth, lacks, parent = self.made, self.left, self.birth, self.lacks, self.parent
        while True:
            if made[token] < birth[state]:  # the state got it from its parent, if at all
                if lacks[state] == token:
                    return False
                state = parent[state]
            elif made[token] == -1:
                return True
            else:  # added to every state that has an arc for the left part
                token = left[token]

    def encode_word(self, word: bytes) -> bytes:
        """The ids of a pre-split word, as little-endian unsigned 32-bit integers."""
        n = len(word)
        # the state at each place, and the last token on the way there: 8 bytes for a byte of a word of any length
        states, last = array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)
        states[0] = 0
        arcs, target, trie = self.arcs, self.target, self.trie
        for i in range(n):
            state, node = states[i], trie
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None and states[j + 1] < 0:
                    key = state << 20 | token
                    arc = arcs.get(key)
                    if arc is None:
                        if len(arcs) > 2_000_000:
                            arcs.clear()
                        arc = arcs[key] = self.has_arc(state, token)
                    if arc:
                        states[j + 1], last[j + 1] = target[token], token
        ids, at = array("i"), n
        while at:
            ids.append(last[at])
            at -= len(self.labels[last[at]])
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, as little-endian unsigned 32-bit integers."""
        if self.special_split and self.special_split.search(text):
            return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self._plain(x) for x in self.special_split.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if len(text) < STEP:
            return b"".join(map(self.words.__getitem__, self.split.findall(text)))
        found, parts = self.split.finditer(text), []
        while some := [m.group() for m in islice(found, STEP)]:
            parts.append(b"".join(map(self.words.__getitem__, some)))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        labels = self.labels.__getitem__
        numbers = np.frombuffer(ids, dtype="<u4")
        return b"".join(b"".join(map(labels, numbers[k : k + STEP].tolist())) for k in range(0, len(numbers), STEP)).decode("utf-8", "replace")


class _Words(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        ids = self.automaton.encode_word(word.encode("utf-8"))
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


_COMPILED: dict[str, Automaton] = {}


def _automaton(vocabulary: str) -> Automaton:
    """One for each worker process."""
    if vocabulary not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[vocabulary] = Automaton(vocabulary)
    return _COMPILED[vocabulary]


def encode_decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as it is, ids (binary: the token ids as little-endian unsigned 32-bit integers), n_tokens and decoded.

    A null text counts as empty and has no tokens. Every row gives a row, repeated or not; texts of any length are encoded
    whole; other columns are ignored. The vocabulary file (some MB, read on the driver) is broadcast.
    """
    spark = df.sparkSession
    python_ready(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def coded(batches):
        automaton = _automaton(sent.value)
        for batch in batches:
            ids = [automaton.encode(t or "") for t in batch.column(1).to_pylist()]
            decoded = [automaton.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string())], names=["id", "ids", "n_tokens", "decoded"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(coded, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, n_tokens long, decoded string").withColumnRenamed("id", id_col)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame) -> DataFrame:
    coded = encode_decode(docs, vocabulary_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
