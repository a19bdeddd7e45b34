"""Token counts by a linear longest-match automaton.

Greedy word pieces cut a word into the longest vocabulary entry that it begins
with, again and again.  The automaton is a trie of the vocabulary in which every
node also has a failure link and the number of pieces popped on the way along
it: where no child fits, the link leads to the node of what remains after those
pieces, so each character is read once and only counts are added, whatever the
length of the word.

The vocabulary marks the end of a word: a word is matched together with the
mark END.  Words are lower-cased maximal runs of letters, of digits, or of other
visible characters; their UTF-8 bytes are spelled in the vocabulary's byte
alphabet.  A word that cannot be cut into entries counts as one piece.  Null
texts count as empty, with no word.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import reserved, small_batches

END = "</w>"
WORD = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")
CACHE_ENTRIES = 600_000


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies:
    printable Latin-1 for itself, the rest from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Automaton:
    """Nodes are numbers, 0 the root; ``fail`` is -1 where no rest can follow."""

    def __init__(self, vocabulary: Iterable[str], end: str = END) -> None:
        self.end = end
        self.child: list[dict[str, int]] = [{}]
        is_entry = [False]
        for entry in vocabulary:
            node = 0
            for c in self._symbols(entry):
                following = self.child[node].get(c)
                if following is None:
                    following = self.child[node][c] = len(self.child)
                    self.child.append({})
                    is_entry.append(False)
                node = following
            is_entry[node] = node != 0
        self.fail = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, following in self.child[node].items():
                if is_entry[following]:
                    self.fail[following], self.popped[following] = 0, 1
                else:
                    at, count = self.fail[node], self.popped[node]
                    while at >= 0 and c not in self.child[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[following], self.popped[following] = self.child[at][c], count
                queue.append(following)

    def _symbols(self, text: str) -> list[str]:
        """Characters; the mark of a word's end is one symbol."""
        return [*text[: -len(self.end)], self.end] if text.endswith(self.end) else list(text)

    def count(self, word: str) -> int:
        """Pieces of a word (without its mark)."""
        node, n, child, fail, popped = 0, 0, self.child, self.fail, self.popped
        for c in [*word, self.end]:
            while c not in child[node]:
                n += popped[node]
                node = fail[node]
                if node < 0 or node == 0 and c not in child[0]:
                    return 1
            node = child[node][c]
        while node > 0:
            n += popped[node]
            node = fail[node]
        return n if node == 0 else 1


@lru_cache(maxsize=2)
def loaded(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        return Automaton(json.load(f)["model"]["vocab"])


class Counter:
    """Counts texts, remembering the words of a worker."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton, self.alphabet, self.known = automaton, byte_alphabet(), {}

    def _word(self, word: str) -> int:
        n = self.automaton.count("".join([self.alphabet[b] for b in word.encode()]))
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = n
        return n

    def text(self, text: str) -> tuple[int, int]:
        """Words and pieces."""
        words, known, make = WORD.findall(text.lower()), self.known.get, self._word
        return len(words), sum([known(w) or make(w) for w in words])


def count_tokens(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """docs' columns ``keep`` plus n_words and n_tokens.  A map over the scan, without a shuffle.

    Null texts count as empty, repeated rows are counted alike; columns named __text, n_words or
    n_tokens cannot be kept.
    """
    reserved(keep, "__text", "n_words", "n_tokens")
    small_batches(docs.sparkSession)

    def batches(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(loaded(path))
        for batch in it:
            found = [counter.text(x.as_py() or "") for x in batch.column("__text")]
            rest = batch.drop_columns(["__text"])
            yield rest.append_column("n_words", pa.array([a for a, _ in found], pa.int64())).append_column("n_tokens", pa.array([b for _, b in found], pa.int64()))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(batches, ", ".join([*fields, "n_words bigint", "n_tokens bigint"]))
