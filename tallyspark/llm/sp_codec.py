"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single pass over the text.

The pieces and scores of a model file go into an automaton. A pass over the text gives, at every position, all
pieces that end there (the automaton's output links); characters that no piece covers fall back to byte pieces. No
piece has a word mark inside, so the path breaks at every word mark and the pass runs word by word, with results
of frequent words remembered. The model file tells which path is taken:

Unigram: the path with the best sum of scores (Viterbi). Scores are summed exactly; of equal paths the one with the
longer last piece wins.

BPE: scores are an order of merges, and their sum means nothing. A segmentation is the one that merging gives if
and only if merging gives every two neighbours of it: a merge across a border is decided by the pieces at its sides
alone. So each prefix has exactly one last piece that merging leaves beside the last piece of the prefix before it,
and the pass finds it. What two neighbours merge to is found by merging them, and remembered.

A text gets a word mark in front, blanks become word marks; a literal word mark is spelled in bytes, so that
decoding gives the text back exactly. Null and empty texts have no ids.
"""

from __future__ import annotations

import array
import functools
import itertools
import re
import sys
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, text_or_empty

MARK = "▁"
#: Words remembered in a Python worker.
REMEMBERED = 300_000
#: Pairs of neighbours remembered in a Python worker.
REMEMBERED_PAIRS = 2_000_000
#: A character that no piece covers, where BPE needs the last piece.
UNKNOWN = -1
#: What a byte costs beyond the worst piece.
BYTE_PENALTY = 10.0
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Codec:
    def __init__(self, pieces: list[tuple[str, float, str]], bpe: bool = False):
        """pieces: (text, score, kind) by id; kind normal, byte, or anything else for pieces not matched in texts. bpe: scores are an order of merges."""
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.text: list[bytes] = [b""] * len(pieces)
        self.byte_ids = [-1] * 256
        self.inner_marks = False
        self.path = self.merged_path if bpe else self.best_path
        self.ranked: dict[str, tuple[float, int]] = {}
        self.shown: list[str] = [piece for piece, _, _ in pieces]
        self.pairs: dict[tuple[int, int], bool] = {}
        worst = min([s for _, s, kind in pieces if kind == "normal"], default=0.0)
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == "byte":
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.text[i] = i, bytes([value])
            elif kind == "normal" and piece:
                self.automaton.add_word(piece, (len(piece), score, i))
                self.ranked[piece] = (-score, i)
                self.text[i] = piece.replace(MARK, " ").encode()
                self.inner_marks |= MARK in piece.lstrip(MARK)
        self.automaton.make_automaton()
        self.byte_score = worst - BYTE_PENALTY
        self.known = Known(self.path)
        self.mark_ids = [self.byte_ids[b] for b in MARK.encode()]

    @classmethod
    def load(cls, path: str) -> Codec:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if sp.IsByte(i) else "other" if sp.IsControl(i) or sp.IsUnknown(i) or sp.IsUnused(i) else "normal"
        return cls([(sp.IdToPiece(i), sp.GetScore(i), kind(i)) for i in range(sp.GetPieceSize())], bpe=_is_bpe(sp))

    def best_path(self, word: str, literal: list[int] | None = None) -> tuple[int, ...]:
        """ids of the best segmentation. literal: how many word marks that stand for themselves come before each position."""
        n = len(word)
        score: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0  # ends up to here are final

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                c = word[done - 1]
                cost = score[done - 1] + self.byte_score * len(c.encode("utf-8", "surrogatepass"))
                if score[done] is None or cost > score[done]:
                    score[done], back[done] = cost, (done - 1, -1)

        for end, (length, gain, piece) in self.automaton.iter(word):
            end += 1
            if end - 1 > done:
                settle(end - 1)
            start = end - length
            if literal and literal[start] < literal[end]:
                continue
            total = score[start] + gain
            if score[end] is None or total > score[end] or total == score[end] and start < back[end][0]:
                score[end], back[end] = total, (start, piece)
        settle(n)
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte_ids[b] for b in reversed(word[start:at].encode("utf-8", "surrogatepass")))
            at = start
        return tuple(reversed(out))

    def merge(self, text: str) -> list[str]:
        """What merging leaves of a short text: the best score first, of equal ones the leftmost."""
        ranked, parts = self.ranked, list(text)
        while True:
            found = [(ranked[m][0], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in ranked]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def beside(self, last: int, piece: int) -> bool:
        """Whether merging leaves piece whole, and apart from the piece before it, if there is one."""
        at = (last, piece)
        known = self.pairs.get(at)
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            want = [self.shown[piece]] if last == UNKNOWN else [self.shown[last], self.shown[piece]]
            known = self.pairs[at] = self.merge("".join(want)) == want
        return known

    def merged_path(self, word: str, literal: list[int] | None = None) -> tuple[int, ...]:
        """ids that BPE's merges give. literal: how many word marks that stand for themselves come before each position."""
        n = len(word)
        lasts: list[int] = [UNKNOWN] * (n + 1)
        starts: list[int] = [-1, *range(n)]  # of the last piece of each prefix; a character of its own unless a piece is found
        pairs, found = self.pairs, -1
        for end, (length, _, piece) in self.automaton.iter(word):
            end += 1
            start = end - length
            if end == found or literal and literal[start] < literal[end]:
                continue
            fits = pairs.get((lasts[start], piece))
            if fits or fits is None and self.beside(lasts[start], piece):
                lasts[end], starts[end], found = piece, start, end
        out: list[int] = []
        at = n
        while at:
            start = starts[at]
            if lasts[at] >= 0:
                out.append(lasts[at])
            else:
                out.extend(self.byte_ids[b] for b in reversed(word[start:at].encode("utf-8", "surrogatepass")))
            at = start
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.inner_marks:
            before = [0, 0, *itertools.accumulate(c == MARK for c in text)]
            return list(self.path(MARK + text.replace(" ", MARK), before))
        first, *rest = text.split(MARK)
        out = self._words(MARK + first.replace(" ", MARK))
        for part in rest:  # nothing goes across a literal word mark
            out += self.mark_ids
            out += self._words(part.replace(" ", MARK))
        return out

    def _words(self, marked: str) -> list[int]:
        return list(itertools.chain.from_iterable(map(self.known.__getitem__, _WORDS.findall(marked))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


class Known(dict):
    """Words and their ids; a word that isn't there is segmented, and remembered if it is short."""

    def __init__(self, path):
        super().__init__()
        self.path = path

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.path(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


def _is_bpe(sp) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())
    return model.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec.load(path)


def _little(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit numbers."""
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def encode(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, text_bytes, round_trip (the ids decode to the text), and the ids if asked for."""

    def run(batches):
        code = codec(model)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            ids = [code.encode(t) for t in texts]
            arrays = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(_little(x)) for x in ids], pa.int64()),
                "text_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                "round_trip": pa.array([code.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
            }
            if with_ids:
                arrays["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(arrays)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text_bytes long, round_trip boolean" + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(batches):
        code = codec(model)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([code.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
