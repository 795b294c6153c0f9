"""Token counts by a unigram model, with one dynamic programme for all words that share a prefix.

A word (pre-token) is its characters after the mark that starts a word. Its tokens are the pieces of the vocabulary of
which the sum of scores is highest (fewest pieces on ties); a character that no piece covers costs its UTF-8 bytes, one
token each. The pieces come from a public vocabulary file, whose path is a parameter; a piece's score is the logarithm
of its Zipf probability by rank, 1 / (rank + 2.7).

Distinct words go into a trie. A node's forward score is the best score of the prefix it stands for, which depends on
its ancestors only, so it is computed once for all words that share the prefix; a word's terminal node stores its count.

Defined results: a null or empty text has no words and no tokens; repeated rows each get their result; an empty table
gives an empty result; columns beyond doc_id and text, of whatever names, are ignored; very long texts and words are
counted whole, in time linear in their length.

Scale: no shuffle. Each task has a trie of its own, begun anew at MOST_NODES nodes; terminal counts outlive it, in two
generations of MOST_WORDS words of which a word in use is always in one. Neither bound changes a result. The vocabulary,
at most MOST_PIECES pieces, is what is sent to executors.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MOST_NODES, MOST_WORDS, MOST_PIECES = 200_000, 250_000, 1_000_000
START = "▁"
_cache: dict = {}


def load(path: str = VOCABULARY) -> dict[str, float]:
    """Piece to score, from a sentencepiece vocabulary; control, unknown and byte pieces are left out."""
    import sentencepiece

    if path not in _cache:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n > MOST_PIECES:
            raise ValueError(f"{path} has {n} pieces; at most {MOST_PIECES} are sent to executors")
        pieces = [model.id_to_piece(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        _cache[path] = {p: -math.log(rank + 2.7) for rank, p in enumerate(pieces, 1)}
    return _cache[path]


class Trie:
    """Words to token counts.

    A node is [children, score, -tokens, open]: the best of its prefix, and the starts from which pieces may still reach
    beyond it, as (place in the tree of pieces, score and -tokens at the start). A new node looks only at these.
    """

    def __init__(self, scores: dict[str, float], most: int = MOST_NODES, most_words: int = MOST_WORDS):
        self.most, self.most_words = most, most_words
        self.byte = -math.log(len(scores) + 2.7) - 10.0
        self.pieces: list = [{}, None]
        for piece, score in scores.items():
            at = self.pieces
            for c in piece:
                at = at[0].setdefault(c, [{}, None])
            at[1] = score
        self.older: dict[bytes, int] = {}
        self.counts = _Counts(self)
        self.clear()

    def clear(self) -> None:
        self.root, self.size = [{}, 0.0, 0, ()], 1

    def add(self, word: bytes) -> int:
        """The number of tokens of a word, by way of the nodes that its prefixes share with other words."""
        if self.size > self.most:
            self.clear()
        node, pieces = self.root, self.pieces
        for c in START + word.decode("utf-8", "surrogatepass"):
            child = node[0].get(c)
            if child is None:
                width = len(c.encode("utf-8", "surrogatepass"))
                best, still = (node[1] + self.byte * width, node[2] - width), []
                for at, score, tokens in (*node[3], (pieces, node[1], node[2])):
                    at = at[0].get(c)
                    if at is not None:
                        if at[1] is not None and (found := (score + at[1], tokens - 1)) > best:
                            best = found
                        if at[0]:
                            still.append((at, score, tokens))
                child = node[0][c] = [{}, *best, still]
                self.size += 1
            node = child
        return -node[2]

    def total(self, words: list[bytes]) -> int:
        return sum(map(self.counts.__getitem__, words))


class _Counts(dict):
    """Terminal counts by word. Those in use stay known: of two generations only the older one is ever dropped."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        trie = self.trie
        if len(self) >= trie.most_words:
            trie.older = dict(self)
            self.clear()
        n = trie.older.get(word)
        if n is None:
            n = trie.add(word)
        self[word] = n
        return n


def _batches(scores: dict[str, float], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(scores, most)
        # A trie has no cycles; the collector would walk all its nodes again and again, for most of the run.
        collects = gc.isenabled()
        gc.disable()
        try:
            for batch in batches:
                # bytes.split() parts at ASCII white space, as words are defined here.
                split = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
                sizes = pa.array([len(w) for w in split], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array([trie.total(w) for w in split], pa.int64())], ["doc_id", "n_words", "n_tokens"])
        finally:
            if collects:
                gc.enable()

    return run


def count(docs: DataFrame, vocabulary: str = VOCABULARY, most: int = MOST_NODES) -> DataFrame:
    """One row a document: doc_id, n_words, n_tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_batches(load(vocabulary), most), f"doc_id {kind}, n_words long, n_tokens long")
