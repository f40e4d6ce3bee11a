"""Token counts under a unigram model, by dynamic programming in a trie.

The best segmentation of a word's first d characters depends on these
characters only, so the forward scores belong to the nodes of a trie of the
distinct words: words that share a prefix share its scores.  The words of a
run come in order, which visits the trie depth first, so only the path to the
present word is held; a node is scored once a run.  Terminal counts are
stored, and a document's count is the sum over its words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import small_batches

#: What the piece file puts before every word.
WORD_MARK = "▁"

#: Scores are whole numbers, so that sums are exact and ties well defined.
SCALE = 1_000_000

#: Terminal counts, and characters of such words, that a Python worker keeps.
WORDS_KEPT, WORD_CHARS = 600_000, 64


def unigram_scores(path: str) -> dict[str, int]:
    """Piece -> cost, the scaled negative log-probability under a Zipf law of
    the piece's rank in the SentencePiece file.  Control, unknown and byte
    pieces are left out."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            out[sp.id_to_piece(i)] = round(SCALE * math.log(len(out) + 2))
    return out


class Trie:
    """Forward scores along the path to the present word.

    A node of the path is (cost, tokens, open): the least cost of a
    segmentation of the word so far and, of the cheapest, the fewest tokens;
    and the pieces that have begun and may go on, each as a place in the tree
    of pieces with the score at its start.  A character outside the
    vocabulary is one unknown token for each of its UTF-8 bytes (as with byte
    fallback), at ``unknown`` cost a byte.
    """

    def __init__(self, scores: dict[str, int]):
        self.unknown = max(scores.values(), default=SCALE) + SCALE
        self.pieces: dict = {}
        for piece, cost in scores.items():
            at = self.pieces
            for ch in piece:
                at = at.setdefault(ch, {})
            at[""] = cost  # no character is empty
        self.path: list[tuple[int, int, list]] = [(0, 0, [])]
        self.word = ""
        self.terminal: dict[str, int] = {}

    def _step(self, node: tuple[int, int, list], ch: str) -> tuple[int, int, list]:
        """The node after one more character."""
        cost, tokens, begun = node
        top = self.pieces.get(ch)
        alive = []
        if top is not None and "" in top:
            best, count = cost + top[""], tokens + 1
        else:
            raw = len(ch.encode("utf-8", "surrogatepass"))
            best, count = cost + raw * self.unknown, tokens + raw
        for at, start, before in begun:
            at = at.get(ch)
            if at is not None:
                alive.append((at, start, before))
                price = at.get("")
                if price is not None and (start + price < best or start + price == best and before + 1 < count):
                    best, count = start + price, before + 1
        if top is not None:
            alive.append((top, cost, tokens))
        return best, count, alive

    def insert(self, word: str) -> int:
        """Token count of ``word``; what it shares with the word before is
        not scored again."""
        known = self.terminal.get(word)
        if known is not None:
            return known
        if len(word) > WORD_CHARS:  # no path is kept of a long word, so its memory is not of its size
            node = self.path[0]
            for ch in word:
                node = self._step(node, ch)
            return node[1]
        path, last, d = self.path, self.word, 0
        for a, b in zip(word, last):
            if a != b:
                break
            d += 1
        del path[d + 1:]
        node = path[d]
        for ch in word[d:]:
            node = self._step(node, ch)
            path.append(node)
        self.word = word
        if len(self.terminal) >= WORDS_KEPT:
            self.terminal.clear()
        self.terminal[word] = node[1]
        return node[1]


def count_tokens(docs: DataFrame, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row.  ``pieces`` is the path of a
    SentencePiece file; words are what lies between white space, each with
    the word mark before it.

    * Null, empty and white-space texts have no words and no tokens.
    * Repeated rows and repeated or null ids each give their own row.
    * Whole texts are counted, however long; words without an end too.
    * Extra columns are not read; an empty table gives an empty result.

    Nothing is shuffled: a task's terminal counts are shared by all its
    documents and start anew when there are ``WORDS_KEPT``.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(unigram_scores(pieces))
        for b in batches:
            words = [Counter((t or "").split()) for t in b.column(1).to_pylist()]
            # in order: shared prefixes follow one another
            count = {w: trie.insert(WORD_MARK + w) for w in sorted(set().union(*words))} if words else {}
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([sum(c.values()) for c in words], pa.int64()),
                 pa.array([sum(n * count[w] for w, n in c.items()) for c in words], pa.int64())],
                ["doc_id", "n_words", "n_tokens"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
