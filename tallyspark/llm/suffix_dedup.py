"""Removal of long passages that occur earlier, by a logarithmic family of sparse suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of a smaller id, or
earlier in its own. Comparing all suffixes of a corpus isn't needed for that:

1. Anchors. Each window of LENGTH bytes chooses one position inside, the one whose K bytes have the smallest
   hash (winnowing). Equal windows choose the same place, so they can be found among windows with equal anchors.
   Consecutive windows that share an anchor are a region, and a task keeps one copy of equal regions. Anchors that
   very many different regions have (a line that a third of all documents holds) are found in a sample; their regions
   are cut into windows, each dealt by a hash of its own, so that no bucket holds them all. The sample decides only
   which way is taken.
2. Regions of equal anchors meet (dealt by the anchor's hash, in packed blocks). A region of the same hash as an
   earlier one is a span of a copy. If an anchor has several different regions, they are open.
3. The bytes of spans and of what they copy are compared, pieces of one place by their least and greatest, which
   combines on the map side. Should they differ, hashes have met by chance, and all is done again with other ones.
4. The bytes of open regions arrive in batches. A batch gets a suffix array (of the windows' suffixes to a depth
   of LENGTH bytes), is merge-scanned against the levels that exist, and becomes a level; levels of about equal
   size merge, so that a task holds a logarithmic number of them. Windows found in two regions are repeats unless
   they are the earliest.
5. Repeats become byte ranges of documents, the ranges are joined and cut out.

So no byte goes because of a hash alone. Partitions grow in number with the bytes of the input.

Null texts count as empty. Rows repeated with one id and text are one document and have one result each. Rows with a
null id, or with an id that stands for several texts, keep all bytes and take none from others. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, materialize, probable_rows, slices, text_or_empty

LENGTH, K = 100, 32
PLACES = LENGTH - K + 1  # places for an anchor in a window
PIECE = 1 << 20  # bytes hashed at once; positions take 20 bits beside a 44-bit hash
#: Rows in a packed block, anchors that a task gathers before it sends them on.
PACKED, GATHERED = 1 << 16, 1 << 21
#: Suffixes in a batch of the index family.
BATCH = 1 << 21
#: Bytes of text for which there is a partition at least.
PARTITION_BYTES = 1 << 26
#: One in so many documents tells hot anchors: those of so many regions there, and of so large a share of them, which bounds their number.
SAMPLED, HOT_REGIONS, HOT_SHARE = 16, 256, 1 / 20_000
#: Bytes of a copied span that are compared at once.
COMPARED = 1 << 16
#: Bits of the regions' hashes, by attempt.
BITS = (64, 64, 64, 64)
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_POWERS: list[np.ndarray] = []

ANCHOR = np.dtype([("anchor", "<u8"), ("region", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("before", "u1"), ("more", "u1")])
RANGE = np.dtype([("doc", "<i8"), ("start", "<u4"), ("stop", "<u4")])
#: Bytes of a document that are a copy of those at another place.
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("stop", "<u4"), ("of", "<i8"), ("at", "<u4")])


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for m in (_M1, _M2, pow(_M1, -1, 2**64), pow(_M2, -1, 2**64)):
            x = np.full(PIECE + 4 * LENGTH, m, np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x))
    return _POWERS


@functools.lru_cache(2)
def _tables(attempt: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11 + attempt)
    one, two = (rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    return one, two


def _mixed(h: np.ndarray, bits: int = 64) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits)


def anchors_of(data: np.ndarray, owner: np.ndarray, id_of: np.ndarray, offset: np.ndarray, hot: np.ndarray | None = None, attempt: int = 0, bits: int = 64) -> np.ndarray:
    """Regions of a buffer of at most PIECE bytes. owner: index of each byte's document; offset: where the buffer's byte 0 of that document lies.

    hot: sorted anchors whose regions are given window by window. attempt: which hash tables; bits: of a region's hash.
    """
    n = len(data)
    if n < LENGTH:
        return np.empty(0, ANCHOR)
    p1, p2, i1, i2 = _powers()
    t1, t2 = _tables(attempt)
    s1, s2 = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(t1[data] * p1[:n], out=s1[1:])
    np.cumsum(t2[data] * p2[:n], out=s2[1:])
    h = (s1[K:] - s1[:-K]) * i1[: n - K + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    low = np.uint64(PIECE - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    x = np.concatenate([v, np.full(-len(v) % PLACES + PLACES, 2**64 - 1, np.uint64)]).reshape(-1, PLACES)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    w = n - LENGTH + 1
    at = (np.minimum(behind[:w], ahead[PLACES - 1 : PLACES - 1 + w]) & low).astype(np.int64)
    whole = owner[:w] == owner[LENGTH - 1 :]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:w] != owner[: w - 1]) | (whole[1:] != whole[:-1])])
    end = np.r_[new[1:], w] - 1
    s, e = new[whole[new]], end[whole[new]]
    anchor, before = h[at[s]], at[s] - s
    if hot is not None and len(hot):
        cut = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
        n = (e - s + 1)[cut]
        windows = np.repeat(s[cut], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = _mixed((s1[windows + LENGTH] - s1[windows]) * i1[windows] + np.uint64(_M2))
        s, e = np.r_[s[~cut], windows], np.r_[e[~cut], windows]
        anchor, before = np.r_[anchor[~cut], key], np.r_[before[~cut], np.zeros(len(windows), np.int64)]
    out = np.empty(len(s), ANCHOR)
    out["anchor"] = anchor
    out["before"], out["more"] = before, e - s
    out["region"] = _mixed((s2[e + LENGTH] - s2[s]) * i2[s], bits) + (out["before"].astype(np.uint64) << np.uint64(8)) + out["more"]
    out["doc"] = id_of[owner[s]]
    out["start"] = s + offset[owner[s]]
    return out


def pieces_of(texts, ids):
    """Buffers (data, owner, ids, offsets) of at most PIECE bytes; a longer text goes on in the next with LENGTH - 1 bytes twice."""
    parts, size = [], 0

    def made():
        lens = [len(p[1]) for p in parts]
        begin = np.cumsum([0, *lens[:-1]])
        data = np.frombuffer(b"".join(p[1] for p in parts), np.uint8)
        return data, np.repeat(np.arange(len(parts)), lens), np.array([p[0] for p in parts], np.int64), np.array([p[2] for p in parts], np.int64) - begin

    for i, t in zip(ids, texts, strict=True):
        at = 0
        while len(t) - at >= LENGTH:
            part = t[at : at + PIECE - size]
            if len(part) < LENGTH or (len(part) < len(t) - at and size):
                yield made()
                parts, size = [], 0
                continue
            parts.append((i, part, at))
            size += len(part)
            if at + len(part) >= len(t):
                break
            at += len(part) - LENGTH + 1
    if parts:
        yield made()


def _ordered(a: np.ndarray) -> np.ndarray:
    """Sorted by anchor, region, document, start."""
    return a[np.lexsort((a["start"], a["doc"], a["region"], a["anchor"]))]


def _heads(new: np.ndarray) -> np.ndarray:
    """For each row, the row where its group began. new: where groups begin."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _leaders(a: np.ndarray) -> np.ndarray:
    """For each of some sorted rows, the first row of the same anchor and region."""
    return _heads(np.r_[True, (a["anchor"][1:] != a["anchor"][:-1]) | (a["region"][1:] != a["region"][:-1])]) if len(a) else np.empty(0, np.int64)


def _repeated(a: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Which of some sorted rows copy their leader. A row read twice is one occurrence."""
    return (a["doc"] != a["doc"][head]) | (a["start"] != a["start"][head])


def _once(a: np.ndarray) -> np.ndarray:
    """Of sorted rows, those that don't repeat the row before."""
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


def _spans(a: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """Rows as copies of their leaders, joined where one goes on in the next."""
    out = np.empty(len(a), SPAN)
    out["doc"], out["start"] = a["doc"], a["start"]
    out["stop"] = a["start"] + a["more"].astype(np.uint32) + np.uint32(LENGTH)
    out["of"], out["at"] = leader["doc"], leader["start"]
    return join_spans(out)


def join_spans(a: np.ndarray) -> np.ndarray:
    """Sorted by document, what they copy and place, with overlapping and touching spans of one shift joined."""
    if not len(a):
        return a
    shift = a["at"].astype(np.int64) - a["start"]
    order = np.lexsort((a["start"], shift, a["of"], a["doc"]))
    a, shift = a[order], shift[order]
    index = np.cumsum(np.r_[True, (a["doc"][1:] != a["doc"][:-1]) | (a["of"][1:] != a["of"][:-1]) | (shift[1:] != shift[:-1])]) - 1
    first, reach = _joined(a, index)
    out = a[first].copy()
    out["stop"] = reach
    return out


def _joined(a: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of index and start: where joined stretches begin, and where they stop."""
    reach = np.maximum.accumulate(a["stop"].astype(np.int64) + (index << 33))
    first = np.flatnonzero(np.r_[True, (a["start"].astype(np.int64) + (index << 33))[1:] > reach[:-1]])
    return first, (reach[np.r_[first[1:], len(a)] - 1] & ((1 << 33) - 1)).astype(np.uint32)


def groups(key: np.ndarray) -> list[tuple[int, int]]:
    """Where the runs of equal keys begin and end."""
    if not len(key):
        return []
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True))


def _packed(kind: str, rows: np.ndarray, bucket: np.ndarray | None, buckets: int):
    """Record batches of packed rows by bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    keys, blobs = [], []
    for s, e in groups(bucket):
        for k in range(s, e, PACKED):
            keys.append(int(bucket[s]))
            blobs.append(rows[k : min(e, k + PACKED)].tobytes())
    if keys:
        yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(keys)), "bucket": pa.array(keys, pa.int32()), "rows": pa.array(blobs, pa.binary())})


_BLOCK = "kind string, bucket int, rows binary"


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    x = doc.astype(np.uint64) * np.uint64(_M1)
    return ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _anchor_blocks(buckets: int, hot: np.ndarray, attempt: int, bits: int):
    def run(batches):
        def sent(rows):
            a = _ordered(np.concatenate(rows))
            head = _leaders(a)
            again = _repeated(a, head)
            spans = _spans(a[again], a[head[again]])
            yield from _packed("span", spans, _doc_bucket(spans["doc"], buckets), buckets)
            a = _once(a[~again])
            yield from _packed("anchor", a, (a["anchor"] % np.uint64(buckets)).astype(np.int32), buckets)

        gathered, count = [], 0
        for batch in slices(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for piece in pieces_of(texts, batch.column(0).to_pylist()):
                gathered.append(anchors_of(*piece, hot, attempt, bits))
                count += len(gathered[-1])
                if count >= GATHERED:
                    yield from sent(gathered)
                    gathered, count = [], 0
        if gathered:
            yield from sent(gathered)

    return run


def _frequent(attempt: int):
    """anchor, regions: how many different regions of a task have an anchor, if there are two; and of all anchors together (null)."""

    def run(batches):
        total = 0
        for batch in slices(batches, 2048):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            found = [anchors_of(*piece, None, attempt) for piece in pieces_of(texts, batch.column(0).to_pylist())]
            if not found:
                continue
            a = np.unique(np.concatenate(found)[["anchor", "region"]])
            total += len(a)
            key, count = np.unique(a["anchor"], return_counts=True)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(key[count > 1].view(np.int64)), "regions": pa.array(count[count > 1], pa.int64())})
        yield pa.RecordBatch.from_pydict({"anchor": pa.array([None], pa.int64()), "regions": pa.array([total], pa.int64())})

    return run


def _meet(buckets: int):
    """Anchors of some buckets: copies become spans, the first of each of several regions goes on as 'open' rows, both by document."""

    def run(batches):
        rows = []
        for batch in batches:
            for kind, bucket, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if kind == "span":
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([kind]), "bucket": pa.array([bucket], pa.int32()), "rows": pa.array([blob], pa.binary())})
                else:
                    rows.append(np.frombuffer(blob, ANCHOR))
        if not rows:
            return
        a = np.concatenate(rows)
        rows.clear()
        order = np.argsort(a["anchor"], kind="stable")  # most anchors occur once and need no more
        key = a["anchor"][order]
        same = key[1:] == key[:-1]
        a = _ordered(a[order[np.r_[False, same] | np.r_[same, False]]])
        head = _leaders(a)
        again = _repeated(a, head)
        spans = _spans(a[again], a[head[again]])
        yield from _packed("span", spans, _doc_bucket(spans["doc"], buckets), buckets)
        a = _once(a[~again])
        same = a["anchor"][1:] == a["anchor"][:-1]
        a = a[np.r_[False, same] | np.r_[same, False]] if len(a) else a
        yield from _packed("open", a, _doc_bucket(a["doc"], buckets), buckets)

    return run


def _blocks_of(batches, kinds: dict) -> dict[str, np.ndarray]:
    held: dict[str, list[np.ndarray]] = {k: [] for k in kinds}
    for batch in batches:
        for kind, _, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            held[kind].append(np.frombuffer(blob, kinds[kind]))
    return {k: np.concatenate(v) if v else np.empty(0, kinds[k]) for k, v in held.items()}


_MARKED = "doc_id long, open binary, spans binary, wanted binary"


def _marked(**kinds: np.ndarray):
    """A row for each document with its rows of each kind, which are in order of documents."""
    parts = {name: {int(a["doc"][s]): a[s:e].tobytes() for s, e in groups(a["doc"])} for name, a in kinds.items()}
    docs = sorted(set().union(*parts.values()))
    for k in range(0, len(docs), 4096):
        some = docs[k : k + 4096]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(some, pa.int64())} | {name: pa.array([p.get(d) for d in some], pa.binary()) for name, p in parts.items()})


def _by_document(batches):
    """Blocks dealt by document to one row a document: its open rows and its spans, joined."""
    found = _blocks_of(batches, {"open": ANCHOR, "span": SPAN})
    a = found["open"]
    yield from _marked(open=a[np.lexsort((a["start"], a["doc"]))], spans=join_spans(found["span"]), wanted=np.empty(0, RANGE))


def _copied(buckets: int):
    """Blocks of the places that spans copy, dealt by document."""

    def run(batches):
        for batch in slices(batches, 4096):
            blobs = [b for b in batch.column(0).to_pylist() if b]
            if blobs:
                a = np.frombuffer(b"".join(blobs), SPAN)
                out = np.empty(len(a), RANGE)
                out["doc"], out["start"], out["stop"] = a["of"], a["at"], a["at"] + (a["stop"] - a["start"])
                out = np.unique(out)
                yield from _packed("wanted", out, _doc_bucket(out["doc"], buckets), buckets)

    return run


def _copied_by_document(batches):
    yield from _marked(open=np.empty(0, ANCHOR), spans=np.empty(0, SPAN), wanted=np.unique(_blocks_of(batches, {"wanted": RANGE})["wanted"]))


def _ranges_by_document(batches):
    """Blocks of ranges and spans, dealt by document, to one row a document: doc_id, ranges (joined)."""
    found = _blocks_of(batches, {"range": RANGE, "span": SPAN})
    spans = np.empty(len(found["span"]), RANGE)
    for k in RANGE.names:
        spans[k] = found["span"][k]
    a = join_ranges(np.concatenate([found["range"], spans]))
    for s, e in groups(np.arange(len(a)) // (1 << 16)):
        part = a[s:e]
        cut = groups(part["doc"])
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([int(part["doc"][i]) for i, _ in cut], pa.int64()), "ranges": pa.array([part[i:j].tobytes() for i, j in cut], pa.binary())})


def join_ranges(a: np.ndarray) -> np.ndarray:
    """Sorted by document and start, with overlapping and touching ranges of a document joined."""
    if not len(a):
        return a
    a = a[np.lexsort((a["start"], a["doc"]))]
    first, reach = _joined(a, np.cumsum(np.r_[True, a["doc"][1:] != a["doc"][:-1]]) - 1)
    out = a[first].copy()
    out["stop"] = reach
    return out


def sort_suffixes(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``starts`` to a depth of LENGTH bytes: (order, group), where equal strings have one group.

    Sorted by ``first`` (a key that equal strings share), then by 8 bytes at a time; a suffix that is alone in its
    group is done.
    """
    order = np.argsort(first, kind="stable")
    key = first[order]
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1 if len(order) else np.empty(0, np.int64)
    tail = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(tail, (len(data) + 1, 8), (1, 1))
    for depth in range(0, LENGTH, 8):
        if not len(order):
            break
        same = group[1:] == group[:-1]
        live = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        if not len(live):
            break
        at = starts[order[live]] + min(depth, LENGTH - 8)
        word = words[at].view(">u8").ravel().astype(np.uint64)
        inner = np.lexsort((word, group[live]))
        order[live] = order[live][inner]
        word, g = word[inner], group[live]
        changed = np.zeros(len(order), np.int64)
        fresh = np.r_[True, g[1:] != g[:-1]]
        changed[live] = np.r_[False, word[1:] != word[:-1]] & ~fresh
        old = np.r_[True, group[1:] != group[:-1]]
        group = np.cumsum(old | changed.astype(bool)) - 1
    return order, group


class Level:
    """A suffix array over its own bytes. Each distinct string has one entry, its earliest occurrence."""

    __slots__ = ("data", "starts", "first", "doc", "pos")

    def __init__(self, data, starts, first, doc, pos):
        self.data, self.starts, self.first, self.doc, self.pos = data, starts, first, doc, pos

    def __len__(self):
        return len(self.starts)


class SuffixFamily:
    """Levels of geometrically growing size. ``repeats`` collects (doc, pos) of windows that are not the earliest."""

    def __init__(self):
        self.levels: list[Level] = []
        self.repeats: list[tuple[np.ndarray, np.ndarray]] = []

    def _distinct(self, data, starts, first, doc, pos) -> Level:
        order, group = sort_suffixes(data, starts, first)
        inner = np.lexsort((pos[order], doc[order], group))
        order, group = order[inner], group[inner]
        new = np.r_[True, group[1:] != group[:-1]] if len(order) else np.zeros(0, bool)
        head = order[_heads(new)] if len(order) else order
        again = (doc[order] != doc[head]) | (pos[order] != pos[head])
        self.repeats.append((doc[order[again]], pos[order[again]]))
        o = order[new]
        return Level(data, starts[o], first[o], doc[o], pos[o])

    def _merged(self, a: Level, b: Level) -> Level:
        data = np.concatenate([a.data, b.data])
        both = lambda k: np.concatenate([getattr(a, k), getattr(b, k)])
        return self._distinct(data, np.concatenate([a.starts, b.starts + len(a.data)]), both("first"), both("doc"), both("pos"))

    def scan(self, level: Level, new: Level) -> None:
        """Marks, of the strings that a level and a new batch share, the later occurrence; both keep the earlier."""
        shared = np.intersect1d(level.first, new.first)
        i, j = np.flatnonzero(np.isin(level.first, shared)), np.flatnonzero(np.isin(new.first, shared))
        if not len(i):
            return
        data = np.concatenate([level.data, new.data])
        order, group = sort_suffixes(data, np.concatenate([level.starts[i], new.starts[j] + len(level.data)]), np.concatenate([level.first[i], new.first[j]]))
        met = np.flatnonzero(group[1:] == group[:-1])  # a string occurs once in either
        x, y = order[met], order[met + 1]
        x, y = i[np.minimum(x, y)], j[np.maximum(x, y) - len(i)]
        apart = (new.doc[y] != level.doc[x]) | (new.pos[y] != level.pos[x])  # else both hold the same occurrence
        x, y = x[apart], y[apart]
        later = (new.doc[y] > level.doc[x]) | (new.doc[y] == level.doc[x]) & (new.pos[y] > level.pos[x])
        self.repeats.append((np.where(later, new.doc[y], level.doc[x]), np.where(later, new.pos[y], level.pos[x])))
        d, p = np.where(later, level.doc[x], new.doc[y]), np.where(later, level.pos[x], new.pos[y])
        level.doc[x], level.pos[x], new.doc[y], new.pos[y] = d, p, d, p

    def insert(self, data, starts, first, doc, pos) -> None:
        """A batch: its bytes, where the windows start in them, a key that equal windows share, and (doc, pos) of each."""
        new = self._distinct(data, starts, first, doc, pos)
        for level in self.levels:
            self.scan(level, new)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 >= len(self.levels[-2]):
            b, a = self.levels.pop(), self.levels.pop()
            keep = len(self.repeats)
            merged = self._merged(a, b)
            # both had the earliest occurrence of a shared string already: what the merge finds is known
            del self.repeats[keep:]
            self.levels.append(merged)


_PIECES = "bucket int, rows binary, bytes binary, of long, at long, length int, piece binary"


def _pieces(buckets: int):
    """Bytes of marked documents: open regions packed by anchor (lengths and rows, and the regions' bytes one after another), and
    pieces of spans and of what they copy, which are told by the place that is copied (of, at, length)."""

    def run(batches):
        for batch in slices(batches, 512):
            rows, parts = [], []
            told: dict[str, list] = {"of": [], "at": [], "length": [], "piece": []}

            def tell(of, at, piece):
                for k in range(0, len(piece), COMPARED):
                    part = piece[k : k + COMPARED]
                    for name, value in zip(told, (of, at + k, len(part), part), strict=True):
                        told[name].append(value)

            for doc, text, opened, spans, wanted in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if opened:
                    a = np.frombuffer(opened, ANCHOR)
                    rows.append(a)
                    parts += [data[s : s + m + LENGTH] for s, m in zip(a["start"].tolist(), a["more"].tolist(), strict=True)]
                for s, e, of, at in np.frombuffer(spans or b"", SPAN)[["start", "stop", "of", "at"]].tolist():
                    tell(of, at, data[s:e])
                for s, e in np.frombuffer(wanted or b"", RANGE)[["start", "stop"]].tolist():
                    tell(doc, s, data[s:e])
            out = []
            if rows:
                a = np.concatenate(rows)
                bucket = (a["anchor"] % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                out = [(int(bucket[order[s]]), a[order[s:e]].tobytes(), b"".join([parts[i] for i in order[s:e]])) for s, e in groups(bucket[order])]
            n, m = [None] * len(told["of"]), [None] * len(out)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([x[0] for x in out] + n, pa.int32()), "rows": pa.array([x[1] for x in out] + n, pa.binary()), "bytes": pa.array([x[2] for x in out] + n, pa.binary()),
                "of": pa.array(m + told["of"], pa.int64()), "at": pa.array(m + told["at"], pa.int64()), "length": pa.array(m + told["length"], pa.int32()), "piece": pa.array(m + told["piece"], pa.binary()),
            })

    return run


def _index(buckets: int, batch_size: int):
    """The index family over the regions of some buckets; gives blocks of ranges by document."""

    def run(batches):
        family, rows, data, count = SuffixFamily(), [], [], 0

        def flush():
            a = np.concatenate(rows)
            n = a["more"].astype(np.int64) + 1
            size = n + LENGTH - 1
            begin = np.cumsum(size) - size
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts = np.repeat(begin, n) + inner
            # equal windows have equal anchors at equal places
            first = np.repeat(a["anchor"], n) + (np.repeat(a["before"].astype(np.int64), n) - inner).astype(np.uint64) * np.uint64(_M2)
            family.insert(np.frombuffer(b"".join(data), np.uint8), starts, first, np.repeat(a["doc"], n), np.repeat(a["start"].astype(np.int64), n) + inner)
            rows.clear()
            data.clear()

        for batch in batches:
            for blob, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a = np.frombuffer(blob, ANCHOR)
                rows.append(a)
                data.append(text)
                count += int(a["more"].sum()) + len(a)
                if count >= batch_size:
                    flush()
                    count = 0
        if rows:
            flush()
        if not family.repeats:
            return
        out = np.empty(sum(len(d) for d, _ in family.repeats), RANGE)
        out["doc"] = np.concatenate([d for d, _ in family.repeats])
        out["start"] = np.concatenate([p for _, p in family.repeats])
        out["stop"] = out["start"] + np.uint32(LENGTH)
        out = join_ranges(out)
        yield from _packed("range", out, _doc_bucket(out["doc"], buckets), buckets)

    return run


def _cut(batches):
    for batch in slices(batches):
        cols = [batch.column(k).to_pylist() for k in range(3)]
        n_bytes, removed, spans, shas, texts = [], [], [], [], []
        for text, blob in zip(cols[1], cols[2], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            ranges = np.frombuffer(blob, RANGE)
            kept, at = [], 0
            for s, e in zip(ranges["start"].tolist(), ranges["stop"].tolist(), strict=True):
                kept.append(data[at:s])
                at = e
            kept.append(data[at:])
            left = b"".join(kept)
            n_bytes.append(len(data))
            removed.append(len(data) - len(left))
            spans.append(len(ranges))
            shas.append(hashlib.sha256(left).hexdigest())
            texts.append(left)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})


def _hot_anchors(rows: DataFrame, attempt: int) -> tuple[np.ndarray, int]:
    """Sorted anchors that very many regions of a sample have, and the bytes of all texts. There are at most 1 / HOT_SHARE of them."""
    size = Observation()
    sample = rows.observe(size, F.sum(F.octet_length("text")).alias("bytes")).where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    counts = materialize(sample.mapInArrow(_frequent(attempt), "anchor long, regions long").groupBy("anchor").agg(F.sum("regions").alias("regions")), "frequent-anchors")
    total = counts.where("anchor is null").agg(F.sum("regions")).first()[0] or 0
    found = counts.where(F.col("anchor").isNotNull() & (F.col("regions") >= max(HOT_REGIONS, HOT_SHARE * total))).select("anchor").collect()
    discard(counts)
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64)), size.get["bytes"] or 0


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, text of the rows whose id is not null and stands for one text."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    seen = rows.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    several = materialize(seen.where("lo <> hi").select("doc_id"), "several-texts")
    if several.isEmpty():
        discard(several)
        return rows
    return rows.join(several, "doc_id", "left_anti")


def repeated_ranges(docs: DataFrame, buckets: int | None = None, batch: int = BATCH, bits: tuple[int, ...] = BITS) -> DataFrame:
    """doc_id, ranges (packed starts and stops of the bytes to remove) of the documents that have any."""
    rows, fewest = _documents(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for attempt, width in enumerate(bits):
        hot, size = _hot_anchors(rows, attempt)
        parts = max(fewest, size // PARTITION_BYTES + 1)
        dealt = buckets or 8 * parts
        blocks = rows.mapInArrow(_anchor_blocks(dealt, hot, attempt, width), _BLOCK)
        met = materialize(blocks.repartition(parts, "bucket").mapInArrow(_meet(dealt), _BLOCK), "anchor-groups")
        marked = materialize(met.repartition(parts, "bucket").mapInArrow(_by_document, _MARKED), "marked")
        wanted = marked.select("spans").mapInArrow(_copied(dealt), _BLOCK).repartition(parts, "bucket").mapInArrow(_copied_by_document, _MARKED)
        marked_docs = materialize(marked.unionByName(wanted), "marked-documents")
        some = probable_rows(rows, "doc_id", marked_docs, "doc_id", marked_docs.count()).join(marked_docs, "doc_id")
        pieces = materialize(some.select("doc_id", "text", "open", "spans", "wanted").mapInArrow(_pieces(dealt), _PIECES), "pieces")
        discard(marked, marked_docs)
        compared = pieces.where("piece is not null").groupBy("of", "at", "length").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi"))
        if compared.where("lo <> hi").isEmpty():
            found = pieces.where("rows is not null").select("bucket", "rows", "bytes").repartition(parts, "bucket").mapInArrow(_index(dealt, batch), _BLOCK)
            ranges = found.union(met.where("kind = 'span'"))
            out = materialize(ranges.repartition(parts, "bucket").mapInArrow(_ranges_by_document, "doc_id long, ranges binary"), "repeats")
            discard(met, pieces)
            return out
        discard(met, pieces)
    raise RuntimeError("hashes met by chance in every attempt")


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row. how: as for repeated_ranges()."""
    ranges = repeated_ranges(docs, **how)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cut = probable_rows(rows, "doc_id", ranges, "doc_id").join(ranges, "doc_id").select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    whole = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    whole = whole.join(ranges.select("doc_id"), "doc_id", "left_anti")
    return whole.unionByName(cut)


#: The rows of remove_repeats() over documents (ids are not null there, and each stands for one text) in DuckDB's dialect: all windows, in hexadecimal.
ORACLE_SQL = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) as k from (select doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) as i from d where length(h) >= {2 * LENGTH})),
f as (select k, min((doc_id, i)) as f from w group by k having count(*) > 1),
r as (select doc_id, i from w join f using (k) where (doc_id, i) <> f),
g as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= {LENGTH} then 0 else 1 end as new from r),
q as (select doc_id, i, sum(new) over (partition by doc_id order by i) as q from g),
s as (select doc_id, min(i) as a, max(i) + {LENGTH} as b from q group by doc_id, q),
t as (select doc_id, list((a, b) order by a) as l, sum(b - a)::bigint as n_removed, count(*) as n_spans from s group by doc_id),
c as (select d.doc_id, h, n_removed, n_spans, case when l is null then h else list_aggregate(list_concat([substr(h, 1, 2 * l[1][1])],
 list_transform(range(1, len(l) + 1), lambda j: substr(h, 2 * l[j][2] + 1, case when j = len(l) then length(h) else 2 * (l[j + 1][1] - l[j][2]) end))), 'string_agg', '') end as left_over from d left join t using (doc_id))
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(left_over)) as kept_sha256 from c
"""
