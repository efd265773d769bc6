"""Op 2, token counts: a unigram model's best segmentation, computed once for each shared prefix of distinct pre-tokens."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import ASCII_SPACE, by_batch, table

MARK = "▁"
SPACES = ASCII_SPACE.decode()
CODES = 0x110000
#: Nodes of a worker's trie; beyond it starts anew. It bounds memory, results do not depend on it.
KEPT = 1_000_000
MODELS: dict[str, tuple[dict[str, float], float, int]] = {}


def unigram_model(path: str) -> tuple[dict[str, float], float, int]:
    """(log probability of each piece, that of a fallback byte, longest piece) for a vocabulary file.

    The file ranks its pieces and has no probabilities, so the model is Zipf's: log p of the piece of rank r is
    -log(r + 1) - log H. Byte pieces together are one more rank."""
    if path not in MODELS:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        total = math.log(sum(1 / (r + 1) for r in range(len(names) + 1)))
        MODELS[path] = ({p: -math.log(r + 1) - total for r, p in enumerate(names)}, -math.log(len(names) + 1) - total, max(map(len, names)))
    return MODELS[path]


class PrefixTrie:
    """Distinct pre-tokens as a trie with forward scores: a node is a prefix and holds the best (score, tokens) of it.

    Node 0 is the mark alone. ``edges`` leads from (node, character), as one number, to the child. A word walks down as
    far as its prefix is there and scores the nodes that it adds, so every distinct prefix is scored once as long as
    the trie lives; the end of a pre-token stores its count in ``counts``."""

    def __init__(self, model: tuple[dict[str, float], float, int]):
        self.pieces, self.byte, self.longest = model
        self.edges: dict[int, int] = {}
        self.scores, self.tokens = array("d", (0.0,)), array("l", (0,))
        self.counts: dict[str, int] = {}
        self.forward(MARK, [0.0], [0], self.scores, self.tokens, 0)

    def forward(self, text: str, score: list[float], tokens: list[int], scores: array, counts: array, at: int) -> None:
        """Scores the prefix ``text`` from those of its own prefixes, and notes it in node ``at``."""
        find, end = self.pieces.get, len(text)
        width = len(text[-1].encode())
        best, count = score[end - 1] + self.byte * width, tokens[end - 1] + width
        for start in range(max(0, end - self.longest), end):
            p = find(text[start:])
            if p is not None and ((s := score[start] + p) > best or s == best and tokens[start] < count):
                best, count = s, tokens[start] + 1
        scores[at], counts[at] = best, count

    def insert(self, words: Iterable[str]) -> None:
        edges, scores, tokens = self.edges, self.scores, self.tokens
        for word in words:
            node = 0
            path, taken = [0.0, scores[0]], [0, tokens[0]]
            for depth, letter in enumerate(word, 2):
                edge = node * CODES + ord(letter)
                node = edges.get(edge, -1)
                if node < 0:
                    node = edges[edge] = len(scores)
                    scores.append(0.0)
                    tokens.append(0)
                    self.forward(MARK + word[: depth - 1], path, taken, scores, tokens, node)
                path.append(scores[node])
                taken.append(tokens[node])
            self.counts[word] = tokens[node]


TRIES: dict[str, PrefixTrie] = {}


def count_batch(texts: list[str | None], path: str) -> tuple[list[int], list[int]]:
    """Words and tokens of each text."""
    trie = TRIES.get(path)
    if trie is None or len(trie.scores) > KEPT:
        trie = TRIES[path] = PrefixTrie(unigram_model(path))
    split = [(t or "").encode().decode(errors="replace") for t in texts]
    table = str.maketrans(dict.fromkeys(SPACES, " "))
    words = [[w for w in t.translate(table).split(" ") if w] if any(c in t for c in SPACES[1:]) else [w for w in t.split(" ") if w] for t in split]
    trie.insert(set().union(*words).difference(trie.counts) if words else ())
    count = trie.counts
    return [len(w) for w in words], [sum(map(count.__getitem__, w)) for w in words]


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_tokens (both long).

    Words are runs of characters other than ASCII white space. Each word with a leading mark is segmented alone into
    the pieces of the vocabulary with the highest sum of log probabilities (ties: fewer tokens); characters outside
    all pieces are one token a byte. Null and empty texts have 0 and 0; texts of any length are counted whole; null ids
    and repeated rows stay; other columns are ignored; an empty table gives no rows. Each worker has its own trie, which
    lives through its tasks, so nothing is shuffled; memory is bounded by ``KEPT`` nodes and the words of one batch."""
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, tokens = count_batch(batch.column(1).to_pylist(), path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return by_batch(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
