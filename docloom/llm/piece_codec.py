"""SentencePiece encoding and decoding by Viterbi with forward scores shared between common prefixes.

Text is cut into marked words (a ``▁`` and what follows up to the next).  The distinct words of a
block are sorted, which is the depth-first order of their trie; the forward scores of the letters
that a word shares with the one before stay on a stack, only the rest is computed.

A forward score is the best sum of scores of the pieces that a prefix can end in.  For models of
scored pieces (unigram) that is all.  Merge models (BPE) have the same lattice with one more rule:
two pieces may follow each other only if merging leaves them as they are (any other step scores
minus infinity).  One path keeps that rule, and it gives the ids that merging gives; which pairs
keep it follows from the order of merges alone, without merging anything.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import byte_blocks, text_or_empty, tidy

MARK = "▁"
#: Bytes of text that are encoded together: the more, the more prefixes are shared; some 400,000 distinct
#: words, and as many bytes again as ten times the block at most, for a worker.
BLOCK_BYTES = 16_000_000
#: What a worker remembers of the words of the blocks before, in bytes.
CACHE_BYTES = 64_000_000


_ONE = (1,)
#: Pairs of pieces that an encoder remembers to be stable or not.
CACHED_PAIRS = 300_000


class PieceModel:
    """Pieces with scores; ``kind`` is ``bpe`` or ``unigram``.

    ``pieces``: (piece, score) by id, None for ids that are no text (control and unknown ids);
    ``bytes_from``: the id of byte 0, the other 255 follow; ``unknown``: the id of what has no
    piece where there are no byte ids.
    """

    def __init__(self, pieces: list[tuple[str, float] | None], kind: str = "bpe", bytes_from: int | None = 3, unknown: int = 0) -> None:
        if kind not in ("bpe", "unigram"):
            raise ValueError(kind)
        self.pieces, self.kind, self.bytes_from, self.unknown = pieces, kind, bytes_from, unknown
        self.ids = {p[0]: i for i, p in enumerate(pieces) if p}
        self.scores = {i: p[1] for i, p in enumerate(pieces) if p}
        # By its last two characters, which lengths a piece can have, the longest first; one is always tried.
        ends: dict[str, set[int]] = {}
        for piece in self.ids:
            ends.setdefault(piece[-2:], {1}).add(len(piece))
        self.lengths = {end: tuple(sorted(found, reverse=True)) for end, found in ends.items()}
        self.penalty = min(self.scores.values(), default=0.0) - 10.0

    @staticmethod
    def load(path: str, kind: str = "bpe") -> PieceModel:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        is_text = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        first = next((i for i in range(n) if model.is_byte(i)), None)
        return PieceModel([(model.id_to_piece(i), model.get_score(i)) if is_text(i) else None for i in range(n)], kind, first, model.unk_id())

    def spelled(self, char: str) -> list[int]:
        """Ids of a character that has no piece."""
        return [self.unknown] if self.bytes_from is None else [self.bytes_from + b for b in char.encode()]

    def merged(self, text: str) -> list[str]:
        """``text`` by merging: the adjacent pair of the highest score first, of equal ones the leftmost."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two symbols whose merge ends the merging of a piece's own letters; None if that does not
        end in the piece, so that no text ever gets it."""
        symbols = list(piece)
        while len(symbols) > 2:
            known = [(self.scores[i], -k) for k in range(len(symbols) - 1) if (i := self.ids.get(symbols[k] + symbols[k + 1])) is not None]
            if not known:
                return None
            k = -max(known)[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols[0], symbols[1]


@lru_cache(maxsize=1)
def encoder_of(path: str, kind: str) -> PrefixEncoder:
    """The encoder of a model file, made once by a worker."""
    return PrefixEncoder(PieceModel.load(path, kind))


class PrefixEncoder:
    """Encodes sets of marked words; what it has learnt stays, within CACHE_BYTES."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.words: dict[str, tuple[bytes, float]] = {}
        self._held = 0
        self._runs: dict[int, list[int]] = {}
        if model.kind == "bpe":
            # When a symbol comes to be: letters are there from the start, then the better score.
            self._made = {p: -model.scores[i] for p, i in model.ids.items() if len(p) > 1}
            self._split = {p: model.last_merge(p) for p in self._made}
            self._reached = {p for p in model.ids if len(p) == 1 or self._split[p]}
            self._pairs: dict[tuple[str, str], bool] = {}

    def _stable(self, left: str, right: str) -> bool:
        """Whether merging leaves two adjacent pieces as they are.

        Merging is undone, the later merge first.  What then stands at the border on both sides
        must have no merge of its own before the one that was undone, of equal ones the leftmost.
        """
        made, split = self._made, self._split
        limit, tie = inf, False
        while True:
            across = made.get(left + right)
            if across is not None and (across < limit or tie and across == limit):
                return False
            x, y = made.get(left, -inf) if len(left) > 1 else -inf, made.get(right, -inf) if len(right) > 1 else -inf
            if x == y == -inf:
                return True
            if x > y:
                limit, tie, left = x, False, split[left][1]
            else:  # a merge across is further left, so it comes first if it is as good
                limit, tie, right = y, True, split[right][0]

    def encode_words(self, words: set[str]) -> Iterator[tuple[str, list[int], float]]:
        """(word, ids, forward score) of each word; words hold marks at their start only."""
        ids, lengths, scores, penalty = self.model.ids, self.model.lengths, self.model.scores, self.model.penalty
        bpe = self.model.kind == "bpe"
        reached, pairs = (self._reached, self._pairs) if bpe else (ids, {})
        # By prefix length: the best last piece or, without one, character, and the score.
        last, score, before = [""], [0.0], ""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], score[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, top = "", score[-1] + penalty
                for n in lengths.get(word[end - 2 if end > 1 else 0 : end], _ONE):
                    if n > end:
                        continue
                    piece = word[end - n : end]
                    if piece not in reached:
                        continue
                    if bpe:
                        if n < end:
                            pair = last[end - n], piece
                            known = pairs.get(pair)
                            if known is None:
                                if len(pairs) >= CACHED_PAIRS:
                                    pairs.clear()
                                known = pairs[pair] = self._stable(*pair)
                            if not known:
                                continue
                        best, top = piece, score[end - n] + scores[ids[piece]]
                        break  # the one step that the rule admits
                    if not best or score[end - n] + scores[ids[piece]] > top:
                        best, top = piece, score[end - n] + scores[ids[piece]]
                last.append(best or word[end - 1])
                score.append(top)
            found, at = [], len(word)
            while at:
                piece = last[at]
                i = ids.get(piece)
                if i is None:
                    found += reversed(self.model.spelled(piece))
                else:
                    found.append(i)
                at -= len(piece)
            found.reverse()
            yield word, found, score[-1]
            before = word

    def _run(self, n: int) -> list[int]:
        """Ids of ``n`` marks and nothing else."""
        if n not in self._runs:
            self._runs[n] = self._doubled(n)
        return self._runs[n]

    def _doubled(self, n: int) -> list[int]:
        """Merging of equal characters: leftmost pairs of the best score, which sizes decide alone."""
        sizes = [1] * n
        by_size = {len(p): self.model.scores[i] for p, i in self.model.ids.items() if set(p) == {MARK}}
        while True:
            best = max(((by_size[s], s) for s in {a + b for a, b in zip(sizes, sizes[1:], strict=False)} if s in by_size), default=None)
            if best is None:
                break
            tied = {s for s in by_size if by_size[s] == best[0]}
            merged, i, changed = [], 0, False
            while i < len(sizes):
                if i + 1 < len(sizes) and sizes[i] + sizes[i + 1] in tied:
                    if changed and len(tied) > 1:  # a merge may bring another, further left
                        merged += sizes[i:]
                        break
                    merged.append(sizes[i] + sizes[i + 1])
                    i, changed = i + 2, True
                else:
                    merged.append(sizes[i])
                    i += 1
            sizes = merged
        return [x for s in sizes for x in ([self.model.ids[MARK * s]] if MARK * s in self.model.ids else self.model.spelled(MARK) * s)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, float]]:
        """Little-endian unsigned 32-bit ids of each text and the sum of its marked words' forward scores;
        a blank and a mark are the same."""
        if self._held > CACHE_BYTES:
            self.words, self._held = {}, 0
        words = self.words
        split = [[MARK + p for p in text.replace(" ", MARK).split(MARK)] if text else [] for text in texts]
        new = set().union(*split)
        new.difference_update(words)
        for word, ids, score in self.encode_words(new):
            words[word] = array("I", ids).tobytes(), score
            self._held += 300 + 4 * (len(word) + len(ids))  # the objects of an entry, roughly
        mark = self.model.ids.get(MARK, -1)
        out = []
        for parts in split:
            known = [words[p] for p in parts]
            raw, scores = zip(*known, strict=True) if known else ((), ())
            if MARK not in parts:
                out.append((b"".join(raw), float(sum(scores))))
                continue
            # A run of marks before a word: the last one is the word's, as long as it merges with it.
            pieces, run = [], 0
            for word, (own, _) in zip(parts, known, strict=True):
                if word == MARK:
                    run += 1
                    continue
                if run:
                    if int.from_bytes(own[:4], "little") == mark:
                        own, run = own[4:], run + 1
                    pieces.append(np.array(self._run(run), "<u4").tobytes())
                    run = 0
                pieces.append(own)
            if run:
                pieces.append(np.array(self._run(run), "<u4").tobytes())
            out.append((b"".join(pieces), float(sum(scores))))
        return out


class PieceDecoder:
    """Text of ids: marks are blanks, byte ids are UTF-8, the blank that encoding adds is taken off."""

    def __init__(self, model: PieceModel) -> None:
        self._raw = [p[0].replace(MARK, " ").encode() if p else b"" for p in model.pieces]
        if model.bytes_from is not None:
            for b in range(256):
                self._raw[model.bytes_from + b] = bytes([b])
        else:
            self._raw[model.unknown] = " ⁇ ".encode()

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self._raw.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=1)
def decoder_of(path: str, kind: str) -> PieceDecoder:
    """The decoder of a model file, made once by a worker."""
    return PieceDecoder(PieceModel.load(path, kind))


def encode_texts(docs: DataFrame, model_path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, ids, score) of each row of ``docs`` (doc_id, text): whole texts; null and empty have no ids.

    score is the sum of the forward scores of a text's marked words.  Other columns are ignored;
    repeated rows are repeated; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_path, kind)
        for batch in byte_blocks(batches, 1, BLOCK_BYTES):
            raw, scores = zip(*encoder.encode(batch.column(1).to_pylist()), strict=True)
            offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(scores, pa.float64())], names=["doc_id", "ids", "score"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return read.mapInArrow(tidy(run), "doc_id long, ids array<int>, score double")


def decode_ids(encoded: DataFrame, model_path: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text) of rows (doc_id, ids); null ids are none.

    ids_crc32 is unsigned, over the ids as little-endian unsigned 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_of(model_path, kind)
        for batch in batches:
            lists = [np.empty(0, np.int32) if not x.is_valid else x.values.to_numpy() for x in batch.column(1)]
            for start in range(0, len(lists), 1_000):
                own = lists[start : start + 1_000]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, 1_000), pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()), pa.array([decoder.decode(x) for x in own], pa.string())],
                    names=["doc_id", "n_ids", "ids_crc32", "text"],
                )

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidy(run), "doc_id long, n_ids long, ids_crc32 long, text string")


def round_trip(docs: DataFrame, model_path: str, kind: str = "bpe") -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), encoded, and decoded from the ids alone: doc_id,
    n_ids, ids_crc32, score, decoded_sha256 (lowercase hex of the decoded text).

    Both ways run in one pass, in the same worker.  Null text counts as empty and has no ids; other
    columns are ignored; repeated rows are repeated; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = encoder_of(model_path, kind), decoder_of(model_path, kind)
        gc.disable()  # hundreds of thousands of live words and no cycles: passes over them find nothing
        for batch in byte_blocks(batches, 1, BLOCK_BYTES):
            rows = [(len(raw) // 4, zlib.crc32(raw), score, hashlib.sha256(decoder.decode(np.frombuffer(raw, "<u4")).encode()).hexdigest()) for raw, score in encoder.encode(batch.column(1).to_pylist())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_ids", "ids_crc32", "score", "decoded_sha256"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return read.mapInArrow(tidy(run), "doc_id long, n_ids long, ids_crc32 long, score double, decoded_sha256 string")
