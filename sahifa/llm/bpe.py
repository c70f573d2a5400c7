"""Operator 5: byte-level BPE by a tokenization automaton.

The automaton reads tokens. It starts as one state with a loop for each byte, and every merge (a, b) -> ab
adds a gadget: wherever an arc a leads to a state with an arc b, an arc ab is drawn past it, to where b led;
then the state after a loses its arc b, in a copy of its own, since a and b in a row must now be ab. So the
state after a token depends on that token alone, and the automaton accepts exactly the token sequences that
BPE gives. Its rows are shared: a copied state keeps the row it was copied from and the cuts made since, a drawn
arc the column of the arc it was drawn past (all 50,000 x 50,000 entries would take gigabytes). An entry is put
together from these once and then stands in a transition table.

A pre-split word is read byte by byte. A second table, of the vocabulary's bytes, leads from each byte to the
longest token that ends there, and from that to the shorter ones. A prefix has one path only, so exactly one of
them continues the path of what is before it: its state. No path is tried and taken back. All new words of a
slice are read together, a byte of each at a time. Ids are decoded by writing out the arcs' labels.

Null text gives null tokens, empty text an empty array; any text, however long, is encoded whole. A token that its
own merges don't give is in no text's ids; it can be decoded. Columns named like the two that are added are replaced.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-splitting into words, as the public byte-level vocabularies have it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose tokens a worker keeps; beyond that it starts anew, which costs time and changes nothing.
KEPT_WORDS = 400_000
#: Slots of the transition table: a power of two. Once half are taken it is emptied, with the same effect.
ARC_SLOTS = 1 << 20
#: Longer words are read by themselves, as there are few of a length to read together.
TOGETHER = 300


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def plain_bpe(word: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """BPE by its definition: join the leftmost pair of lowest rank until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60 or (below is not None and best >= below):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Slots:
    """A hash table of non-negative 64-bit keys to numbers, on arrays."""

    def __init__(self, slots: int):
        self.bits = slots.bit_length() - 1
        self.keys, self.values, self.used = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], default)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.values[slot[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that aren't held yet, each once."""
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            # Of several keys for a slot one stays.
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        self.used += len(keys)

    def clear(self) -> None:
        self.keys.fill(-1)
        self.used = 0


class Automaton:
    """The automaton of a list of merges; a state is named by the token whose arcs lead to it."""

    def __init__(self, ranks: dict[bytes, int], arc_slots: int = ARC_SLOTS):
        self.size = size = max(ranks.values(), default=0) + 1
        self.label: list[bytes] = [b""] * size
        #: For ab: whose arcs its own were drawn past (a), the state that its state is a copy of (b), and when.
        self.head, self.tail, self.born = np.arange(size), np.arange(size), np.full(size, -1)
        #: Arcs that a gadget cut: (state, token) and the step.
        cut: dict[int, int] = {}
        read: list[tuple[bytes, int]] = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.label[rank] = token
            parts = plain_bpe(token, ranks, below=rank)
            if len(parts) == 2:
                a, b = ranks[parts[0]], ranks[parts[1]]
                self.head[rank], self.tail[rank], self.born[rank] = a, b, rank
                cut.setdefault(a * size + b, rank)
            if len(parts) <= 2 and token:
                read.append((token, rank))
        self.cut = Slots(1 << max(4, (4 * len(cut)).bit_length()))
        self.cut.put(np.fromiter(cut.keys(), np.int64, len(cut)), np.fromiter(cut.values(), np.int64, len(cut)))
        self.length = np.array([len(x) for x in self.label], np.int64)
        self.arc_table = Slots(arc_slots)
        self._read_bytes(read)

    def _read_bytes(self, tokens: list[tuple[bytes, int]]) -> None:
        """The table of bytes: `go` from each node's row by each byte, `ends` the longest token ending at a node, `shorter` the next one.

        Nodes that nothing goes on from share the row of the node that the text without its first byte leads to.
        """
        step: dict[tuple[int, int], int] = {}
        token_of, levels = [-1], [[(0, 0, 0)]]
        for token, rank in tokens:
            at = 0
            for depth, byte in enumerate(token, 1):
                to = step.get((at, byte))
                if to is None:
                    to = step[at, byte] = len(token_of)
                    token_of.append(-1)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((to, at, byte))
                at = to
            token_of[at] = rank
        n = len(token_of)
        inner = np.zeros(n, bool)
        inner[[at for at, _ in step]] = inner[0] = True
        del step
        row = np.cumsum(inner) - 1
        go = np.zeros((int(inner.sum()), 256), np.int32)
        back, ends = np.zeros(n, np.int32), np.array(token_of, np.int32)
        self.shorter = np.full(self.size, -1, np.int32)
        for depth, level in enumerate(levels):
            node, parent, byte = np.array(level).T
            if depth:
                # Where the text without its first byte leads.
                back[node] = go[row[back[parent]], byte] if depth > 1 else 0
                own = ends[node] >= 0
                self.shorter[ends[node[own]]] = ends[back[node[own]]]
                ends[node] = np.where(own, ends[node], ends[back[node]])
                row[node] = np.where(inner[node], row[node], row[back[node]])
                goes_on = node[inner[node]]
                go[row[goes_on]] = go[row[back[goes_on]]]
            if depth + 1 < len(levels):
                child, parent, byte = np.array(levels[depth + 1]).T
                go[row[parent], byte] = child
        self.go, self.row, self.ends = go.ravel(), row.astype(np.int32), ends

    def arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether the state after one token has an arc for another: what the gadgets left of it."""
        keys = states.astype(np.int64) * self.size + tokens
        known = self.arc_table.get(keys, -1)
        new = np.flatnonzero(known < 0)
        if len(new):
            fresh = np.unique(keys[new])
            found = np.concatenate([self._entry(k // self.size, k % self.size) for k in np.array_split(fresh, len(fresh) // 100_000 + 1)])
            known[new] = found[np.searchsorted(fresh, keys[new])]
            if 2 * (self.arc_table.used + len(fresh)) > len(self.arc_table.keys):
                self.arc_table.clear()
            self.arc_table.put(fresh[: len(self.arc_table.keys) // 2], found)
        return known > 0

    def _entry(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Entries of the transition table (1: there is an arc), from the shared rows and their cuts."""
        never = np.iinfo(np.int32).max
        out, left, until = np.ones(len(state), np.int32), np.arange(len(state)), np.full(len(state), never)
        while len(left):
            gone = self.cut.get(state * self.size + token, never) < until
            out[left[gone]] = 0
            # Back to the later of the two gadgets: the state was copied then, or the arc drawn.
            copied, drawn = self.born[state], self.born[token]
            later = copied > drawn
            until = np.where(later, copied, drawn + 1)
            go_on = ~gone & (later | (drawn >= 0))
            state, token = np.where(later, self.tail[state], state)[go_on], np.where(later, token, self.head[token])[go_on]
            left, until = left[go_on], until[go_on]
        return out

    def encode_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        state = np.empty(len(raw), np.int32)
        for i in np.flatnonzero(size > TOGETHER):
            state[begin[i] : begin[i] + size[i]] = self._read_one(words[i])
        order = np.argsort(-size, kind="stable")
        order = order[(size[order] > 0) & (size[order] <= TOGETHER)]
        at, count = begin[order], size[order]
        node = np.zeros(len(order), np.int32)
        for i in range(int(count[0]) if len(count) else 0):
            n = int(np.searchsorted(-count, -i, side="left"))
            node = self.go[(self.row[node[:n]].astype(np.int64) << 8) | raw[at[:n]]]
            self._settle(state, at[:n], self.ends[node], i)
            at = at[:n] + 1
        # From each word's end back to its begin: the tokens of its path.
        used = np.zeros(len(raw) + 1, bool)
        some = np.flatnonzero(size)
        at, first = begin[some] + size[some] - 1, begin[some]
        while len(at):
            used[at] = True
            at = at - self.length[state[at]]
            on = at >= first
            at, first = at[on], first[on]
        many = np.concatenate([[0], np.cumsum(used)])
        return state[used[:-1]], many[begin + size] - many[begin]

    def _settle(self, state: np.ndarray, at: np.ndarray, token: np.ndarray, before: int) -> None:
        """Put the state after each byte `at`, of which there are `before` others in its word: of the tokens ending there the one with an arc."""
        while True:
            if token.min() < 0:
                raise ValueError("the vocabulary has no tokens for some bytes")
            size = self.length[token]
            inner = np.flatnonzero(size <= before)
            good = np.ones(len(at), bool)
            good[inner] = self.arcs(state[at[inner] - size[inner]], token[inner])
            state[at[good]] = token[good]
            if good.all():
                return
            at, token = at[~good], self.shorter[token[~good]]

    def _read_one(self, word: bytes) -> list[int]:
        """The states after each byte of a long word, by the same tables."""
        go, row, ends, shorter, length = (memoryview(np.ascontiguousarray(x)) for x in (self.go, self.row, self.ends, self.shorter, self.length))
        state, node, known = [], 0, {}
        for i, byte in enumerate(word):
            node = go[row[node] << 8 | byte]
            token = ends[node]
            while token >= 0 and length[token] <= i:
                key = state[i - length[token]], token
                if key not in known:
                    known[key] = bool(self.arcs(np.array([key[0]]), np.array([token]))[0])
                if known[key]:
                    break
                token = shorter[token]
            if token < 0:
                raise ValueError("the vocabulary has no tokens for some bytes")
            state.append(token)
        return state

    def encode(self, word: bytes) -> list[int]:
        """The one path through the automaton whose labels spell the word."""
        return self.encode_many([word])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.label[i] for i in ids]).decode("utf-8", "replace")


class Encoder(dict):
    """Texts to ids. The dict has a row number for each word seen; `flat` has its ids, from `starts` on."""

    #: Letters, digits, punctuation and marks of which the re and regex modules think alike; others take the slow way.
    _usual = re.compile(r"[^ \n!-~À-ÖØ-öø-ſ‘-‟…–—€]")
    _doubled = ("  ", "\n\n", " \n", "\n ")

    def __init__(self, automaton: Automaton):
        import regex

        self.automaton = automaton
        self.slow = regex.compile(PATTERN).findall
        self.fast = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self._restart()

    def _restart(self) -> None:
        self.clear()
        self.flat, self.starts = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.rows_held = 0
        #: Words of rows that have no ids yet, and how many of them each of these rows has.
        self.words: list[str] = []
        self.parts: list[int] = []

    def __missing__(self, key: str) -> int:
        # "\0x" is x at a text's start, "\1x" a word that is split already, "\nx" x after a line's end, x else " x".
        lead = key[:1]
        if lead == "\1":
            words = [key[1:]]
        else:
            text = key[1:] if lead == "\0" else key if lead == "\n" else " " + key
            if key.isalpha():
                words = [text]
            elif key[-1] in ".," and key[:-1].isalpha():
                words = [text[:-1], key[-1]]
            else:
                words = (self.slow if self._usual.search(text) else self.fast)(text)
        self.words += words
        self.parts.append(len(words))
        row = self[key] = self.rows_held + len(self.parts) - 1
        return row

    def _learn(self) -> None:
        """Encode the new rows' words, all together."""
        ids, size = self.automaton.encode_many([w.encode() for w in self.words])
        to = np.concatenate([[0], np.cumsum(size)])[np.cumsum(self.parts)]
        held, n = int(self.starts[self.rows_held]), len(self.parts)
        while held + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
        while self.rows_held + n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), np.int64)])
        self.flat[held : held + len(ids)] = ids
        self.starts[self.rows_held + 1 : self.rows_held + n + 1] = held + to
        self.rows_held += n
        self.words, self.parts = [], []

    def rows(self, text: str) -> list[int]:
        if (
            self._usual.search(text)
            or text[0] in " \n"
            or text[-1] in " \n"
            or any(x in text for x in self._doubled)
        ):
            return [self["\1" + w] for w in self.slow(text)]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\0" + parts[0]
        return list(map(self.__getitem__, parts))

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, with the end."""
        if len(self) > KEPT_WORDS:
            self._restart()
        rows = array("q")
        count = [0]
        for text in texts:
            if text:
                rows.extend(self.rows(text))
            count.append(len(rows))
        if self.parts:
            self._learn()
        at = np.frombuffer(rows, np.int64) if len(rows) else np.zeros(0, np.int64)
        start = self.starts[at]
        size = self.starts[at + 1] - start
        ends = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[index], ends[np.array(count)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


_kept: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary file, compiled once in each process."""
    if path not in _kept:
        _kept[path] = Encoder(Automaton(read_ranks(path)))
    return _kept[path]


def bpe_encode(docs: DataFrame, text: str = "text", tokens: str = "tokens", count: str = "n_tokens", vocabulary: str = VOCABULARY, keep_text: bool = True) -> DataFrame:
    """docs with the columns tokens (array of ids) and count; both replace columns of these names.

    Null text has null tokens and count, empty text an empty array and 0. No shuffle: one pass over the rows.
    """
    common.ship(docs.sparkSession)
    docs = common.without(docs, tokens, count)
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, T.StructField(tokens, T.ArrayType(T.IntegerType(), False)), T.StructField(count, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in common.text_slices(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            ids, offsets = enc.encode_all(column.to_pylist())
            null = column.is_null()
            mask = pa.array(np.append(np.asarray(null), False)) if column.null_count else None
            at = pa.array(offsets.astype(np.int32))
            if mask is not None:
                at = pa.array(offsets.astype(np.int32), mask=np.asarray(mask))
            item = pa.field("element", pa.int32(), nullable=False)
            lists = pa.ListArray.from_arrays(at, pa.array(ids), type=pa.list_(item))
            sizes = pa.array(np.diff(offsets).astype(np.int32), mask=np.asarray(null))
            own = [c for c, name in zip(batch.columns, batch.schema.names) if keep_text or name != text]
            yield pa.RecordBatch.from_arrays([*own, lists, sizes], names=[*[f.name for f in kept], tokens, count])

    return docs.mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, tokens: str = "tokens", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """rows with the text that their ids spell; null ids give null text, an id outside the vocabulary fails."""
    common.ship(rows.sparkSession)
    if text != tokens:
        rows = common.without(rows, text)

    @F.pandas_udf("string")
    def decode(ids):
        automaton = encoder(vocabulary).automaton
        return ids.map(lambda x: automaton.decode(x), na_action="ignore")

    return rows.withColumn(text, decode(F.col(f"`{tokens}`")))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's ids."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs, keep_text=False).select("doc_id", "n_tokens", "tokens")
