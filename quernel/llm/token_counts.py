"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary whose merges are ranked by the merged piece tokenizes from left to right: the encoding
of a prefix is fixed by its last piece, and two pieces may stand side by side exactly when the merges leave
them apart. The transducer's state holds, for every start of a piece that may still be going on, the text
since that start, the last piece before it and how many tokens lie between it and here. Reading one character
moves to the next state and emits the change of the token count. States are compiled when first met.

A text is cut into chunks. A chunk's state map says what it does to any start state: characters up to its
first synchronizing place (a space after something else, which no piece spans) depend on the start state, all
after it doesn't. Maps compose associatively, and a prefix scan over a text's chunks gives its count.

Defined cases: null and empty texts have 0 tokens; equal rows give equal rows; an empty table gives an empty
one; columns other than key and text are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.session import ship

SPACE = "▁"
CHUNK = 1 << 15
#: Compiled words and transitions are dropped and compiled anew beyond these numbers, to bound a worker's memory.
MAX_WORDS, MAX_TRANSITIONS = 200_000, 800_000


class StateMap(NamedTuple):
    """What a chunk does to a start state: `head` is read from it; then, if synced, `count` tokens more and `end`."""

    head: str
    synced: bool
    count: int
    end: dict | None


class CountTransducer:
    """Emits token counts. pieces: piece -> rank (less merges first); weight of a character outside it: its UTF-8 bytes."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p))}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces that hold a space after another character are not supported")
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, dict] = {}
        self.words: dict[str, tuple[dict, int]] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.size = 0
        self.start = self._state((("", "", 0),))
        self.space = self.run(self.start, SPACE)  # the state after a space that follows no other space, and its count

    def _state(self, key: tuple) -> dict:
        """A state is its transitions: character -> (state, tokens emitted). At "" is its key: for each live start
        the suffix since it, the last piece before it, and the tokens from there to here, negated."""
        if key not in self.ids:
            self.ids[key] = {"": key}
        return self.ids[key]

    def _merges_apart(self, a: str, b: str) -> bool:
        """Run the vocabulary's own merges on a + b, best rank first and leftmost on ties: does none cross the border?"""
        parts, pieces, none = list(a + b), self.pieces, float("inf")
        border, at = len(a), list(range(len(a) + len(b)))
        ranks = [pieces.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            if at[i + 1] == border:
                return False
            parts[i] += parts.pop(i + 1)
            del at[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pieces.get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = pieces.get(parts[i] + parts[i + 1], none)
        return parts == ([a, b] if a else [b])

    def _stand(self, a: str, b: str) -> bool:
        """Whether the pieces a and b stay apart (a may be nothing: then whether b is the encoding of its text)."""
        got = self.apart.get((a, b))
        if got is None:
            if len(self.apart) > MAX_TRANSITIONS:
                self.apart.clear()
            got = self.apart[a, b] = self._merges_apart(a, b)
        return got

    def _compile(self, state: dict, ch: str) -> tuple[dict, int]:
        live, found = [], None
        for suffix, last, back in state[""]:
            s = suffix + ch
            if found is None and (len(s) == 1 or s in self.pieces) and self._stand(last, s):
                found = (s, back + (1 if s in self.pieces else len(ch.encode("utf-8", "surrogatepass"))))
            if s in self.prefixes:
                live.append((s, last, back))
        piece, emitted = found
        key = (*((s, last, back - emitted) for s, last, back in live), ("", piece, 0))
        self.size += 1
        out = state[ch] = (self._state(key), emitted)
        return out

    def run(self, state: dict, text: str) -> tuple[dict, int]:
        """The end state and the tokens emitted over text."""
        n = 0
        for ch in text:
            try:
                state, k = state[ch]
            except KeyError:
                state, k = self._compile(state, ch)
            n += k
        return state, n

    def body(self, text: str) -> tuple[dict, int]:
        """As run() over text that starts with a space in the state before any: word after word."""
        state, n, words, first, (space, one) = self.start, 0, self.words, True, self.space
        plain = "  " not in text and not text.endswith(" ")
        for w in text[1:].split(" ") if plain else _words(text):
            got = words.get(w)
            if got is None:
                if plain:
                    state, k = self.run(space, w)
                    got = (state, k + one)
                    if len(words) < MAX_WORDS:
                        words[w] = got
                else:
                    got = self.run(self.start, w.replace(" ", SPACE))
            elif not plain:
                got = self.run(self.start, w.replace(" ", SPACE))
            state = got[0]
            n += got[1]
        return state, n

    def chunk_map(self, chunk: str) -> StateMap:
        """chunk: text with spaces as such."""
        i, end = 0, len(chunk)
        while True:
            i = chunk.find(" ", i)
            if i < 0:
                return StateMap(chunk, False, 0, None)
            if i and chunk[i - 1] != " ":
                break
            i += 1
        state, n = self.body(chunk[i:end])
        return StateMap(chunk[:i], True, n, state)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if not a.synced:
            return StateMap(a.head + b.head, b.synced, b.count, b.end)
        state, n = self.run(a.end, b.head.replace(" ", SPACE))
        return StateMap(a.head, True, a.count + n + b.count, b.end if b.synced else state)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """Compose all, as a balanced tree: the up-sweep of a prefix scan."""
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        if self.size > MAX_TRANSITIONS:
            self.reset()
            gc.collect()
        text = " " + text.replace(SPACE, " ")
        m = self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return self.run(self.start, m.head.replace(" ", SPACE))[1] + (m.count if m.synced else 0)


def _words(text: str) -> list[str]:
    import re

    return re.findall(" +[^ ]*", text)


_compiled: dict[str, CountTransducer] = {}


def transducer(path: str) -> CountTransducer:
    """Compiled from a sentencepiece BPE model with byte fallback and a leading space; kept by the worker."""
    if path not in _compiled:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        _compiled[path] = CountTransducer({sp.id_to_piece(i): -sp.get_score(i) for i in plain})
    return _compiled[path]


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", *, model: str | None = None, limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and over_limit for each row."""
    ship(docs.sparkSession)
    src = docs.select(F.col(key).alias("doc_id"), F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long").alias("n_bytes"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        machine = transducer(model or public_tokenizers.path("piece_bpe_32k.model"))
        gc.disable()  # states refer to each other: a collection would walk all of them, again and again
        try:
            for b in batches:
                n = pd.Series([machine.count(t or "", chunk) for t in b["text"]], dtype="int64")
                yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": n, "over_limit": n > limit})
        finally:
            gc.enable()

    return src.mapInPandas(run, schema)
