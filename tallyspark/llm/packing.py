"""Sum-of-squares online packing of tokenised documents into fixed windows.

Every document's ids (with a closing id) are cut into full windows and one remainder. A remainder goes to
the fill level that minimises the sum of the squared numbers of partially filled windows per level, which an
array indexed by level holds; opening a new window is level 0. Ties go to the fullest level. A window that
gets full is written out. At the end of a partition the windows still open are closed: one whose fill is a
power of two stands as it is, the pieces of the others are poured together and cut into full windows and
power-of-two windows, so that nothing is padded. Partitions pack on their own (no shuffle); a window's id
holds its partition's number, so a task that is run again yields the same rows.

Null texts count as empty (the closing id alone); a null doc_id is carried along; extra columns are ignored;
repeated rows are packed each; an empty table gives no rows. Long texts need memory for their own ids only.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, text_or_empty

#: Texts of these characters only take the fast encoder; any other text takes the tokenizers library itself.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]")


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids of a byte-level BPE file of the tokenizers library.

    The file's vocabulary and merges are run by tiktoken's engine, four times as fast; texts with unusual
    characters, or that hold a special token's string, are encoded by tokenizers. The ids are the same.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [x["content"] for x in spec.get("added_tokens", [])]
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in set(special)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = special

    @functools.cached_property
    def slow(self):
        """The library's own encoder, loaded by the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if _PLAIN.search(text) or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Packs pieces; ``out`` gets (doc_id, start, ids, doc_tokens, sequence, offset) of closed windows."""

    def __init__(self, size: int, first_sequence: int = 0):
        self.size, self.next = size, first_sequence
        self.count = np.zeros(size + 1, np.int64)  # windows open at each level
        self.open: dict[int, list[list]] = {}
        self.out: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.next, at))
            at += len(ids)
        self.next += 1

    def level_for(self, n: int) -> int:
        """The level where n more ids raise the sum of squares least."""
        c, size = self.count, self.size
        top = size - n
        after = 2 * c[n : size + 1] + 1
        after[top] = 0  # a full window is no longer partially filled
        cost = after - 2 * c[: top + 1] + 1
        cost[0] = after[0]
        usable = c[: top + 1] > 0
        usable[0] = True
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        return top - int(cost[::-1].argmin())

    def add(self, doc, ids: np.ndarray) -> None:
        size, n, at = self.size, len(ids), 0
        while n - at >= size:
            self._close([(doc, at, ids[at : at + size], n)])
            at += size
        if at == n:
            return
        piece, m = (doc, at, ids[at:], n), n - at
        level = self.level_for(m)
        window = [] if level == 0 else self.open[level].pop()
        if level:
            self.count[level] -= 1
        window.append(piece)
        if level + m == size:
            self._close(window)
        else:
            self.open.setdefault(level + m, []).append(window)
            self.count[level + m] += 1

    def finish(self) -> None:
        rest = []
        for level in sorted(self.open):
            for window in self.open[level]:
                if level & (level - 1) == 0:
                    self._close(window)
                else:
                    rest += window
        self.open.clear()
        self.count[:] = 0
        left = sum(len(p[2]) for p in rest)
        queue = rest[::-1]
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc, start, ids, total = queue.pop()
                if len(ids) > room:
                    queue.append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                window.append((doc, start, ids, total))
                room -= len(ids)
            self._close(window)

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _rows(pieces: list[tuple], with_ids: str) -> pa.RecordBatch:
    cols = list(zip(*pieces, strict=True)) if pieces else [[]] * 6
    arrays = {
        "doc_id": cols[0],
        "start": cols[1],
        "length": [len(x) for x in cols[2]],
        "ids_crc32": [zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in cols[2]],
        "doc_tokens": cols[3],
        "sequence_id": cols[4],
        "offset": cols[5],
    }
    out = {k: pa.array(v, pa.int64()) for k, v in arrays.items()}
    if with_ids == "array":
        out["ids"] = pa.array([x.astype(np.int32) for x in cols[2]], pa.list_(pa.int32()))
    elif with_ids == "binary":
        out["ids"] = pa.array([np.ascontiguousarray(x, "<u4").tobytes() for x in cols[2]], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, with_ids: str = "") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids "array" or "binary" (little-endian, 32 bits each) adds the ids."""

    def run(batches):
        context = TaskContext.get()
        packer = Packer(size, (context.partitionId() if context else 0) << 40)
        code = encoder(tokenizer)
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = code.ids(text)
                ids.append(end_id)
                packer.add(doc, np.array(ids, np.uint32))
                if len(packer.out) >= 4096:
                    yield _rows(packer.drain(), with_ids)
        packer.finish()
        if packer.out:
            yield _rows(packer.drain(), with_ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, SCHEMA + {"": "", "array": ", ids array<int>", "binary": ", ids binary"}[with_ids])
