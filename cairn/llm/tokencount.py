"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

Each task gathers the distinct pre-tokens of a few million characters of text, inserts them in a trie level by
level, and computes the best score once for every trie node, from the nodes above it: a prefix that many
pre-tokens share is scored once. What a terminal node holds is its pre-token's token count, and a
document's count is the sum over its pre-tokens. Counts of known pre-tokens are kept for the next texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import utf8_slices

#: Score of a byte that no piece covers, in milli-nats.
BYTE_SCORE = -30_000
#: Distinct pre-tokens whose counts a task remembers (16 bytes each).
REMEMBERED = 3_000_000
#: Words of more bytes are not put in the trie, whose levels cost a pass each; they are scored one by one.
LONG_WORD = 256
_MUL = np.uint64(0x9E3779B97F4A7C15)
_models: dict[str, tuple] = {}


def load_model(path: str) -> dict[bytes, int]:
    """Pieces with integer scores from a sentencepiece file: Zipf's law over the rank, in milli-nats.

    The file's own scores are merge ranks, not probabilities; rank ``r`` gets ``-1000 * ln(r + 10)``,
    rounded. Control and byte pieces are left out; bytes without a piece cost ``BYTE_SCORE`` each.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i)):
            pieces[sp.id_to_piece(i).encode()] = int(np.rint(-1000 * np.log(i + 10)))
    return pieces


def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (h ^ byte) * _MUL + (h >> np.uint64(31))


class UnigramTrie:
    """Best-path token counts of many byte strings at once.

    ``pieces`` are looked up by a rolling hash of their bytes (checked to be free of clashes). The best path
    has the highest total score; of equal ones the one with the fewest tokens.
    """

    def __init__(self, pieces: dict[bytes, int]):
        self.pieces, self.lengths = pieces, {}
        for piece in pieces:
            self.lengths.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {end: sorted(found) for end, found in self.lengths.items()}
        self.longest = max(map(len, pieces), default=1)
        with np.errstate(over="ignore"):
            hashes = []
            for piece in pieces:
                h = np.full(1, len(piece), np.uint64)
                for byte in reversed(piece):
                    h = _step(h, np.uint64(byte + 1))
                hashes.append(h[0])
        keys = np.array(hashes, np.uint64)
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], np.array(list(pieces.values()), np.int64)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        # For each piece length, the last byte pairs that can end a piece: most spans fail here already.
        self.ends = np.zeros((self.longest + 1, 65536), bool)
        for piece in pieces:
            self.ends[len(piece), piece[-1] | (piece[-2] << 8 if len(piece) > 1 else 0)] = True

    def count_long(self, word: bytes) -> int:
        """The token count of one word, in time that is linear in its length: each place tries only the pieces that its last two bytes can end."""
        score, count = [0], [0]
        none: list[int] = []
        for end in range(1, len(word) + 1):
            best, fewest = score[-1] + BYTE_SCORE, count[-1] + 1
            pair = self.lengths.get(word[max(0, end - 2) : end], none) if end > 1 else none
            for length in (*self.lengths.get(word[end - 1 : end], none), *pair):
                if length <= end and (own := self.pieces.get(word[end - length : end])) is not None:
                    s, c = score[end - length] + own, count[end - length] + 1
                    if s > best or (s == best and c < fewest):
                        best, fewest = s, c
            score.append(best)
            count.append(fewest)
        return count[-1]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The token count of each of ``words``: sorted, distinct, not empty."""
        out = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        if len(short) < len(words):
            out[short] = self._shared([words[i] for i in short])
            for i in set(range(len(words))).difference(short):
                out[i] = self.count_long(words[i])
            return out
        return self._shared(words)

    def _shared(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        data = np.frombuffer(b"".join(words), np.uint8)
        out = np.zeros(n, np.int64)
        node = np.zeros(n, np.int64)  # of each word, its node on the level above
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint8))]
        alive = np.arange(n)
        for depth in range(1, int(sizes.max(initial=0)) + 1):
            alive = alive[sizes[alive] >= depth]
            byte = data[starts[alive] + depth - 1]
            above = node[alive]
            new = np.r_[True, (above[1:] != above[:-1]) | (byte[1:] != byte[:-1])]  # sorted words: children lie together
            child = np.cumsum(new) - 1
            node[alive] = child
            parent, last = above[new], byte[new]
            score, count = self._best(levels, parent, last, depth)
            levels.append((score, count, parent, last))
            if len(levels) > self.longest + 1:
                levels[-self.longest - 2] = None  # out of any piece's reach
            done = sizes[alive] == depth
            out[alive[done]] = count[child[done]]
        return out

    def _best(self, levels, parent: np.ndarray, last: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        up = levels[-1]
        score, count = up[0][parent] + BYTE_SCORE, up[1][parent] + 1
        before = up[3][parent] if depth > 1 else np.zeros(len(parent), np.uint8)
        pair = last.astype(np.int64) | (before.astype(np.int64) << 8)
        tails = []  # rolling hash inputs from the last byte backwards
        at = parent
        tails.append(last)
        with np.errstate(over="ignore"):
            for length in range(1, min(self.longest, depth) + 1):
                if length > 1:
                    above = levels[-length + 1]
                    tails.append(above[3][at])
                    at = above[2][at]
                here = np.flatnonzero(self.ends[length, pair if length > 1 else last.astype(np.int64)])
                if not len(here):
                    continue
                h = np.full(len(here), length, np.uint64)
                for tail in tails:
                    h = _step(h, tail[here].astype(np.uint64) + np.uint64(1))
                spot = np.searchsorted(self.keys, h)
                spot[spot == len(self.keys)] = 0
                hit = self.keys[spot] == h
                if not hit.any():
                    continue
                here, spot = here[hit], spot[hit]
                source = levels[-length]
                s, c = source[0][at[here]] + self.scores[spot], source[1][at[here]] + 1
                better = (s > score[here]) | ((s == score[here]) & (c < count[here]))
                score[here[better]], count[here[better]] = s[better], c[better]
        return score, count


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens``: one row per input row, over whole texts.

    Pre-tokens are the words between ASCII white space, each with the word-begin mark in front.

    Edge cases: a null, empty or blank text has no pre-token and no token; a null id is carried along; repeated
    rows are counted each; a word of any length is scored whole, in linear time; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _models:
            _models.clear()
            _models[model_path] = (UnigramTrie(load_model(model_path)),)
        (trie,) = _models[model_path]
        mark = "▁".encode()
        known_keys, known_counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in utf8_slices(batches, 1, 12 << 20):
            words: list[bytes] = []
            ends = [0]
            for text in batch.column(1).to_pylist():
                words += text.encode("utf-8", "surrogatepass").split() if text else ()
                ends.append(len(words))
            index: dict[bytes, int] = {}
            slot = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
            distinct = list(index)
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
            at = np.searchsorted(known_keys, keys)
            at[at == len(known_keys)] = 0
            old = known_keys[at] == keys if len(known_keys) else np.zeros(len(keys), bool)
            found = np.zeros(len(distinct), np.int64)
            found[old] = known_counts[at[old]]
            fresh = np.flatnonzero(~old)
            if len(fresh):
                fresh = np.array(sorted(fresh.tolist(), key=distinct.__getitem__))
                found[fresh] = trie.counts([mark + distinct[i] for i in fresh])
                if len(known_keys) + len(fresh) > REMEMBERED:
                    known_keys, known_counts = known_keys[:0], known_counts[:0]
                known_keys = np.concatenate((known_keys, keys[fresh]))
                order = np.argsort(known_keys, kind="stable")
                known_keys, known_counts = known_keys[order], np.concatenate((known_counts, found[fresh]))[order]
            total = np.r_[0, np.cumsum(found[slot])]
            bounds = np.array(ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(total[bounds[1:]] - total[bounds[:-1]])], ["doc_id", "n_pretokens", "n_tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
