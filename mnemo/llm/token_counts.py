"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

Distinct pre-tokens form a trie.  Each node holds the best unigram score of its prefix and the number of
tokens there, computed once from the nodes above it; where a pre-token ends its count is stored.  The pieces are those of a public vocabulary; as that file ranks pieces and gives no
probabilities, a piece of rank r is scored by Zipf's law, -ln(r + 2.7) - ln(H).  A character that no piece
covers counts as one token for each of its UTF-8 bytes.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from .tokenizing import text_slices

SPACE = "▁"
#: Counts a worker keeps before it starts anew.
LIMIT = 1_000_000


def load_pieces(model_file: str) -> dict[str, float]:
    """piece -> log score, for all ordinary pieces of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    norm = math.log(sum(1 / (r + 2.7) for r in range(len(names))))
    return {name: -math.log(r + 2.7) - norm for r, name in enumerate(names)}


class UnigramTrie:
    """Counts of distinct pre-tokens by a walk over their trie.

    New pre-tokens are walked in sorted order, which visits their trie depth first: the path from the root is
    kept, so the forward scores of a shared prefix are computed once.  Every node of the path holds the best
    score and fewest tokens of its prefix, and the places in the trie of pieces where a piece may go on.
    """

    def __init__(self, pieces: dict[str, float], limit: int = LIMIT):
        self.limit, self.terminal = limit, {}
        self.floor = min(pieces.values(), default=0.0) - 10.0
        self.root: dict = {}
        for piece, score in pieces.items():
            node = self.root
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = score

    def learn(self, words: set[str]) -> None:
        """Store the counts of pre-tokens not seen before (ties of the score: fewer tokens)."""
        best, count, alive, path = [0.0], [0], [[]], ""
        root, floor, terminal = self.root, self.floor, self.terminal
        for word in sorted(words):
            text = SPACE + word
            depth = 0
            for x, y in zip(text, path, strict=False):
                if x != y:
                    break
                depth += 1
            del best[depth + 1:], count[depth + 1:], alive[depth + 1:]
            for end in range(depth, len(text)):
                char = text[end]
                size = 1 if char < "\x80" else len(char.encode("utf-8", "surrogatepass"))
                top, least, going = best[end] + size * floor, count[end] + size, []
                for start, node in (*alive[end], (end, root)):
                    child = node.get(char)
                    if child is not None:
                        going.append((start, child))
                        score = child.get("")
                        if score is not None:
                            value = best[start] + score
                            if value > top or value == top and count[start] + 1 < least:
                                top, least = value, count[start] + 1
                best.append(top)
                count.append(least)
                alive.append(going)
            path = text
            terminal[word] = count[-1]

    def tokens(self, word: str) -> int:
        if word not in self.terminal:
            self.learn({word})
        return self.terminal[word]


_tries: dict[str, UnigramTrie] = {}


def trie_of(model_file: str) -> UnigramTrie:
    if model_file not in _tries:
        _tries[model_file] = UnigramTrie(load_pieces(model_file))
    return _tries[model_file]


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every whole text; null and blank texts have none of either.

    One row per input row; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        trie = trie_of(model_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words, tokens = [], []
            for lo, hi in text_slices(texts):
                found = [(t or "").split() for t in texts[lo:hi]]
                if len(trie.terminal) > trie.limit:
                    trie.terminal.clear()
                trie.learn({w for ws in found for w in ws} - trie.terminal.keys())
                words.extend(map(len, found))
                tokens.extend(sum(map(trie.terminal.__getitem__, ws)) for ws in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
