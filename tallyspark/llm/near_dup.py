"""MinHash near-duplicate detection with tensored banding.

Two small collections of half keys (each of ``ROWS`` minhashes) are computed a document; the key of table
(i, j) is half key i of the first collection with half key j of the second, so that m * m tables need 2 * m half
keys. Documents of equal shingle sets are one class. Two classes are candidates if they meet in a table; of
their tables only the first counts. A pair is missed only if one collection has no half key in common: about
2 * (1 - J**ROWS)**m, 4e-7 at a similarity of 0.85 and 9.5e-6 at 0.80.

Candidates are verified on their whole shingle sets in two rounds, and a group's pairs are never all listed. Round
one compares the members of a bucket with a few leaders of the bucket; a large bucket is cut into blocks with leaders
of their own, which are then members of a smaller bucket, and so on. Verified links make components. Round two
compares the members of different components in a bucket by their minhash signatures: rows that agree with another in
``AGREE`` of 48 places (a pair at the threshold falls short of that with a chance of 1.8e-6 at 0.85, 3.3e-6 at 0.80) get their texts, and the
bucket's links are confirmed where the rows meet; what comes out are the links that connect it. Large buckets are dealt
out as pairs of blocks, a large component having blocks of its own, which don't meet each other. Components are found
by label propagation over verified links.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Null texts and texts without words have an empty set and no
links; texts of fewer words than a shingle are one shingle. Rows of one id are one document: each has a result, the
links of all its texts are its links. Rows of null id are linked with nothing, their component is null and they stay.
Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, fresh, materialize, probable_rows, slices, text_or_empty, without

SHINGLE, TABLES, ROWS = 5, 12, 2  # words, half keys in a collection, minhashes in a half key
PLACES = 2 * TABLES * ROWS
AGREE = {85: 28, 80: 25}
#: Members of a bucket, and their shingles, that meet in one task; a larger bucket is cut into blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
LEADERS = 6
#: Bytes of rows that a worker gathers before it goes to work on them.
GATHERED_BYTES = 1 << 25
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SCALE = np.random.default_rng(5).integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z to a-z, the other blanks to the blank.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
#: Bytes whose words are hashed at once; longer words than LONG_WORD are hashed on their own.
PIECE, LONG_WORD = 1 << 18, 1 << 14
_BYTE = np.random.default_rng(6).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UP, _DOWN = (np.cumprod(np.r_[np.uint64(1), np.full(PIECE, m, np.uint64)]) for m in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, polynomials taken from one running sum. data: lower-cased, blanks only between words."""
    import xxhash

    out, at, n = [], 0, len(data)
    while at < n:
        end = n if n - at <= PIECE else data.rfind(b" ", at, at + PIECE)
        if end < 0:  # one word fills the piece
            end = data.find(b" ", at)
            end = n if end < 0 else end
            out.append(np.array([xxhash.xxh3_64_intdigest(data[at:end])], np.uint64))
        else:
            b = np.frombuffer(data, np.uint8, end - at, at)
            edge = np.flatnonzero(np.diff(np.r_[False, b != 32, False]))
            s, e = edge[::2], edge[1::2]
            run = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_BYTE[b] * _UP[: len(b)], out=run[1:])
            h = (run[e] - run[s]) * _DOWN[s]
            h = (h ^ (h >> np.uint64(32))) * _MIX2
            for i in np.flatnonzero(e - s > LONG_WORD):
                h[i] = xxhash.xxh3_64_intdigest(b[s[i] : e[i]].tobytes())
            out.append(h)
        at = end + 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """A text's shingles as sorted distinct 64-bit hashes."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").translate(_PLAIN))
    if not len(h):
        return h
    n = max(1, len(h) - SHINGLE + 1)
    s = h[:n].copy()
    for k in range(1, min(SHINGLE, len(h))):
        s = (s ^ (s >> np.uint64(29))) * _MIX + h[k : k + n]
    s = (s ^ (s >> np.uint64(32))) * _MIX2
    return np.unique(s ^ (s >> np.uint64(29)))


def minhashes(shingles: np.ndarray, scale: np.ndarray = _SCALE) -> np.ndarray:
    """A minhash of 32 bits for each factor in scale."""
    low = np.full(len(scale), 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048]
        x = part[None, :] * scale[:, None]
        low = np.minimum(low, (x ^ (x >> np.uint64(31))).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def half_keys(low: np.ndarray) -> np.ndarray:
    """(2, TABLES) keys of 64 bits of a minhash signature."""
    parts = low.astype(np.uint64).reshape(2, TABLES, ROWS)
    key = np.zeros((2, TABLES), np.uint64)
    for r in range(ROWS):
        key = (key ^ parts[:, :, r]) * _MIX
        key ^= key >> np.uint64(29)
    return key


def _mark(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketches(batches):
    for batch in slices(batches):
        counts, marks, first, second, signature = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text)
            counts.append(len(s))
            if not len(s):
                for out in (marks, first, second, signature):
                    out.append(None)
                continue
            low = minhashes(s)
            a, b = half_keys(low).view(np.int64)
            marks.append(_mark(s))
            first.append(a)
            second.append(b)
            signature.append(low.astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column(0), "n_shingles": pa.array(counts, pa.int64()), "mark": pa.array(marks, pa.binary()),
            "first": pa.array(first, pa.list_(pa.int64())), "second": pa.array(second, pa.list_(pa.int64())), "signature": pa.array(signature, pa.binary()),
        })


def sketches(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_sketches, "doc_id long, n_shingles long, mark binary, first array<long>, second array<long>, signature binary")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """bucket, rep: the members of all buckets of two and more.

    Only half keys that two classes share can make a shared table, so the tables of the others are left out.
    """
    sides = []
    for side in ("first", "second"):
        keys = classes.select("rep", F.posexplode(side).alias("i", "key"))
        shared = keys.groupBy("i", "key").count().where("count > 1").drop("count")
        sides.append(keys.join(shared, ["i", "key"]).groupBy("rep").agg(F.collect_list(F.struct("i", "key")).alias(side)))
    tables = sides[0].join(sides[1], "rep").select("rep", F.explode("first").alias("a"), "second").select("rep", "a", F.explode("second").alias("b"))
    rows = tables.select(F.xxhash64("a.key", "b.key", "a.i", "b.i").alias("bucket"), (F.col("a.i") * TABLES + F.col("b.i")).cast("int").alias("table"), "rep")
    rows = materialize(rows, "bucket-rows")
    sizes = materialize(rows.groupBy("bucket").count().where("count > 1"), "bucket-sizes")
    out = materialize(rows.join(sizes, "bucket"), "buckets")
    discard(rows, sizes)
    return out


_PAIR = "x long, y long"
_MEMBER = "bucket long, part long, table int, rep long, signature binary, component long, block long, own boolean"


class Members:
    """Rows of some buckets, sorted by bucket, part and rep."""

    def __init__(self, t: pa.Table):
        for k in ("table", "rep", "component", "block", "own"):
            setattr(self, k, t.column(k).to_numpy())
        bucket, part = t.column("bucket").to_numpy(), t.column("part").to_numpy()
        self.starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
        self.signature = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(-1, PLACES)
        self.halves = self.signature.reshape(-1, 2, TABLES, ROWS)
        self.n = len(self.rep)

    def close(self, r: np.ndarray, s: np.ndarray, agree: int):
        """Of the rows r and s, the pairs that agree in enough places and have no earlier table in common."""
        r, s = (x[(self.signature[r] == self.signature[s]).sum(axis=1) >= agree] for x in (r, s))
        first = (self.halves[r] == self.halves[s]).all(axis=3).argmax(axis=2)
        mine = first[:, 0] * TABLES + first[:, 1] == self.table[r]
        return r[mine], s[mine]

    def with_leaders(self, agree: int):
        """Pairs of a row with a leader of its bucket, and the leaders; a row that is much like its leader takes no other."""
        which = np.repeat(np.arange(len(self.starts)), np.diff(np.r_[self.starts, self.n]))
        left = np.arange(self.n)
        for _ in range(LEADERS):
            if not len(left):
                return
            g = which[left]
            head = np.r_[True, g[1:] != g[:-1]]
            lead = left[np.flatnonzero(head)[np.cumsum(head) - 1]]
            r, s = lead[lead != left], left[lead != left]
            yield *self.close(r, s, agree), left[head]
            left = s[(self.signature[r] == self.signature[s]).sum(axis=1) < 0.8 * PLACES]

    def across(self, agree: int):
        """Pairs of rows of different components."""
        ends = np.repeat(np.r_[self.starts[1:], self.n], np.diff(np.r_[self.starts, self.n]))
        rows, shift = np.arange(self.n), 1
        while True:
            rows = rows[rows + shift < ends[rows]]
            if not len(rows):
                return
            for k in range(0, len(rows), 1 << 14):
                r = rows[k : k + (1 << 14)]
                s = r + shift
                # rows of one block meet in the block's own part
                r = r[(self.component[r] != self.component[s]) & ((self.block[r] != self.block[s]) | self.own[r])]
                if len(r):
                    yield self.close(r, r + shift, agree)
            shift += 1


def _by_bucket(batches, work, least: int):
    """Whole groups of equal bucket and part, some at a time, to work()."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < least and size < GATHERED_BYTES:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        b, p = t.column("bucket").to_numpy(), t.column("part").to_numpy()
        change = np.flatnonzero((b[1:] != b[:-1]) | (p[1:] != p[:-1]))
        if len(change):  # the last group may go on in the next batch
            yield from work(t.slice(0, int(change[-1]) + 1))
            t = t.slice(int(change[-1]) + 1)
        held = t.to_batches()
        rows, size = len(t), 0
    if rows:
        yield from work(pa.Table.from_batches(held).combine_chunks())


_LED = "x long, y long, bucket long, table int, signature binary"


def _leader_pairs(agree: int):
    """Pairs of a leader (x) and another row (y); of buckets in several blocks also the leaders (x), as members of the smaller bucket that they make."""

    def rows(x, y, bucket=None, table=None, signature=None):
        none = [None] * len(x)
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()), pa.array(none if y is None else y, pa.int64()), pa.array(none if bucket is None else bucket, pa.int64()), pa.array(none if table is None else table, pa.int32()), pa.array(none if signature is None else signature, pa.binary())],
            names=["x", "y", "bucket", "table", "signature"])

    def work(t):
        m, cut, bucket = Members(t), t.column("block").to_numpy() > 0, t.column("bucket").to_numpy()
        for r, s, lead in m.with_leaders(agree):
            x, y = m.rep[r], m.rep[s]
            for k in range(0, len(x), 1 << 16):
                a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                yield rows(a, b)
            lead = lead[cut[lead]]
            if len(lead):
                yield rows(m.rep[lead], None, bucket[lead], m.table[lead], [m.signature[i].tobytes() for i in lead])

    return lambda batches: _by_bucket(batches, work, 20_000)


def _open_members(agree: int):
    """The rows that have a candidate of another component, each once a bucket."""

    def work(t):
        m = Members(t)
        met = np.zeros(m.n, bool)
        for r, s in m.across(agree):
            met[r] = met[s] = True
        yield from t.filter(pa.array(met)).combine_chunks().to_batches(max_chunksize=4096)

    return lambda batches: _by_bucket(batches, work, 20_000)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = np.intersect1d(x, y, assume_unique=True).size
    return 100 * common >= percent * (len(x) + len(y) - common)


#: More minhashes, of the members that are still open, and how many a pair at the threshold agrees in but for a chance of 1e-7.
_FINE = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _links_across(agree: int, percent: int):
    """Links between rows of different components, confirmed on whole sets; of a group's links those that connect it."""
    fine = int(len(_FINE) * percent / 100 - 5.3 * (len(_FINE) * percent * (100 - percent)) ** 0.5 / 100)

    def work(t):
        m = Members(t)
        found = [np.stack(p) for p in m.across(agree)]
        pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), int)
        if not pairs.shape[1]:
            return
        used = np.unique(pairs)
        texts = t.column("text")
        sets = {int(i): shingle_set(texts[int(i)].as_py()) for i in used}
        low = np.stack([minhashes(sets[int(i)], _FINE) for i in used])
        at = np.searchsorted(used, pairs)
        same = np.concatenate([(low[at[0, k : k + 8192]] == low[at[1, k : k + 8192]]).sum(axis=1) for k in range(0, pairs.shape[1], 8192)])
        order = np.argsort(-same, kind="stable")
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        xs, ys = [], []
        for i in order[: int((same >= fine).sum())]:
            r, s = int(pairs[0, i]), int(pairs[1, i])
            a, b = find(int(m.component[r])), find(int(m.component[s]))
            if a != b and _linked(sets[r], sets[s], percent):
                root[max(a, b)] = min(a, b)
                xs.append(min(m.rep[r], m.rep[s]))
                ys.append(max(m.rep[r], m.rep[s]))
        yield pa.RecordBatch.from_pydict({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    return lambda batches: _by_bucket(batches, work, 2000)


_DEALT = ["bucket", "part", "table", "rep", "signature", "component", "block", "own"]


def _sorted(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "rep")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (bucket, table, rep, count, signature) with the block of a large bucket as part; block: how many blocks more than one its bucket has."""
    n = F.ceil(F.col("count") / BLOCK).cast("long")
    part = F.pmod(F.xxhash64("rep", "bucket"), n)
    return _sorted(rows.select("bucket", part.alias("part"), "table", "rep", "signature", F.col("rep").alias("component"), (n - 1).alias("block"), F.lit(True).alias("own")))


def leader_pairs(rows: DataFrame, agree: int) -> DataFrame:
    """The pairs (x, y) of round one, once each. rows: bucket, table, rep, count, signature."""
    led, counted = [], []
    while not counted or not counted[-1].isEmpty():
        led.append(materialize(_in_blocks(rows).mapInArrow(_leader_pairs(agree), _LED), "leader-pairs"))
        leaders = led[-1].where("bucket is not null").select("bucket", "table", F.col("x").alias("rep"), "signature")
        counted.append(materialize(leaders.groupBy("bucket").count(), "leaders"))
        rows = leaders.join(counted[-1], "bucket")
    pairs = functools.reduce(DataFrame.union, [t.where("bucket is null").select("x", "y") for t in led])
    once = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("x").alias("x"))
    out = materialize(once.select("x", F.when(F.col("x") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("y")), "candidate-pairs")
    discard(*led, *counted)
    return out


def _blocks(n, shingles):
    return F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES, F.lit(1))).cast("long")


def _dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of different components to where they meet. rows: bucket, table, rep, signature, component, n_shingles; n, shingles: of the bucket.

    A bucket of one block is one part. Else a component that fills a block has blocks of its own, the others share
    blocks, and a part is a pair of blocks that hold different components. Also returns the written table of blocks.
    """
    small = (F.col("n") <= BLOCK) & (F.col("shingles") <= BLOCK_SHINGLES)
    here = rows.where(small).withColumns({"part": F.lit(0).cast("long"), "block": F.lit(0).cast("long"), "own": F.lit(True)}).select(*_DEALT)
    large = rows.where(~small)
    sizes = large.groupBy("bucket", "component").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("k"), F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    alone = F.col("k") > 1
    shared = F.when(F.count_if(~alone) > 0, _blocks(F.coalesce(F.sum(F.when(~alone, F.col("c"))), F.lit(0)), F.coalesce(F.sum(F.when(~alone, F.col("s"))), F.lit(0)))).otherwise(0)
    info = sizes.groupBy("bucket").agg(shared.alias("shared"), F.array_sort(F.collect_list(F.when(alone, F.struct("component", "k")))).alias("filled"))
    info = materialize(info.select("bucket", "shared", F.expr("transform(filled, (x, i) -> struct(x.component as component, x.k as k, shared + aggregate(slice(filled, 1, i), 0L, (a, y) -> a + y.k) as at))").alias("filled")), "blocks")
    own = F.expr("get(filter(filled, x -> x.component = component), 0)")
    dealt = large.join(info, "bucket").withColumn("mine", own)
    dealt = dealt.withColumn("block", F.when(F.col("mine").isNull(), F.pmod(F.xxhash64("component"), F.col("shared"))).otherwise(F.col("mine.at") + F.pmod(F.xxhash64("rep"), F.col("mine.k"))))
    others = "concat(if(shared > 0, sequence(0L, shared - 1), cast(array() as array<bigint>)), flatten(transform(filter(filled, x -> x.component <> component), x -> sequence(x.at, x.at + x.k - 1))))"
    dealt = dealt.withColumn("other", F.explode(F.expr(others)))
    pair = F.least("block", "other") * (1 << 31) + F.greatest("block", "other")
    met = dealt.select("bucket", pair.alias("part"), "table", "rep", "signature", "component", "block", (F.col("block") == F.col("other")).alias("own"))
    return _sorted(here.unionByName(met)), info


def _verified(batches, percent: int):
    """Links of the rows in order of x, salt and y: a row without y brings the text that those behind it are compared with."""
    head: tuple = (None, None)
    for batch in slices(batches, 64):
        xs, ys = [], []
        for x, y, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if y is None:
                head = (x, shingle_set(text))
            elif _linked(head[1], shingle_set(text), percent):
                xs.append(x)
                ys.append(y)
        if xs:
            yield pa.RecordBatch.from_pydict({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})


def _of_mark(batches, text: int, mark: int):
    """The rows whose text has the shingle set of the mark; text, mark: the columns' places."""
    for batch in slices(batches):
        yield batch.filter(pa.array([_mark(shingle_set(t)) == m for t, m in zip(batch.column(text).to_pylist(), batch.column(mark).to_pylist(), strict=True)], pa.bool_()))


def _with_texts(docs: DataFrame, classes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (rep and others) with the text of a document of the class; and the written table that this reads.

    classes: rep, least (an id of it), mark, several (whether that id has other texts).
    """
    keyed = materialize(rows.join(classes.select("rep", "least", F.when(F.col("several"), F.col("mark")).alias("mark")), "rep"), "wanted")
    ids = keyed.select("least").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("least"), text_or_empty().alias("text"))
    found = probable_rows(texts, "least", ids.withColumnRenamed("least", "wanted"), "wanted", ids.count()).join(keyed, "least")
    out = found.where("mark is null")
    if not keyed.where("mark is not null").isEmpty():
        known = found.where("mark is not null")
        at = [known.columns.index(c) for c in ("text", "mark")]
        out = out.unionByName(known.mapInArrow(lambda batches: _of_mark(batches, *at), known.schema))
    return out.drop("least", "mark"), keyed


#: Pairs of one leader that a task verifies; a leader of more is verified by several.
PAIRS = 256


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of classes whose whole shingle sets reach the similarity. A leader's text travels once for each PAIRS of its pairs."""
    leaders = materialize(pairs.groupBy("x").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("salts")), "leaders")
    heads = leaders.select(F.col("x").alias("rep"), "x", F.lit(None).cast("long").alias("y"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    others = pairs.join(leaders, "x").select(F.col("y").alias("rep"), "x", "y", F.pmod(F.xxhash64("y"), F.col("salts")).cast("int").alias("salt"))
    rows, keyed = _with_texts(docs, classes, heads.unionByName(others))
    dealt = rows.repartition("x", "salt").sortWithinPartitions("x", "salt", "y")  # nulls come first
    out = materialize(dealt.select("x", "y", "text").mapInArrow(lambda batches: _verified(batches, percent), _PAIR), "links")
    discard(leaders, keyed)
    return out


def verify_across(members: DataFrame, docs: DataFrame, classes: DataFrame, agree: int, percent: int) -> DataFrame:
    """Links (x, y) between members of a bucket that are of different components."""
    rows, keyed = _with_texts(docs, classes, members)
    dealt = _sorted(rows.select(*members.columns, "text"))
    out = materialize(dealt.mapInArrow(_links_across(agree, percent), _PAIR).distinct(), "links")
    discard(keyed)
    return out


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """doc, component (smallest id reachable) of every id in ``links`` (x, y).

    Large-star and small-star steps by turns: a node's neighbours are linked to the smallest of them, until
    every node is linked to its component's smallest only. Each round is a written table.
    """
    edges = materialize(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "edges")
        stars = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty()
        discard(edges)
        edges = new
        if stars:
            break
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("doc"), F.col("v").alias("component"))
    out = out.union(edges.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct())
    out._stored_at = edges._stored_at
    return out


def _classes(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rep, mark, least (smallest id), several, n_shingles and the sketch of each set of documents of equal shingle sets; and the links between the classes of one id."""
    known = base.where("mark is not null and doc_id is not null")
    ids = known.groupBy("doc_id").agg(F.min(F.xxhash64("mark")).alias("lo"), F.max(F.xxhash64("mark")).alias("hi"))
    several = materialize(ids.where("lo <> hi").select("doc_id"), "several-texts")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "first", "second", "signature")]
    made = known.groupBy("mark").agg(F.min("doc_id").alias("least"), *firsts).withColumn("rep", F.monotonically_increasing_id())
    made = made.join(several.select(F.col("doc_id").alias("least"), F.lit(True).alias("several")), "least", "left")
    classes = materialize(made, "classes")
    own = known.join(several, "doc_id", "left_semi").select("doc_id", "mark").distinct().join(classes.select("mark", "rep"), "mark").select("doc_id", "rep")
    links = materialize(own.groupBy("doc_id").agg(F.min("rep").alias("x")).join(own, "doc_id").select("x", F.col("rep").alias("y")).where("x <> y"), "own-links")
    discard(several)
    return classes, links


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; documents of a similarity of percent / 100 and more are linked."""
    agree = AGREE.get(percent) or int(PLACES * percent / 100 - 5.2 * (PLACES * percent * (100 - percent)) ** 0.5 / 100)
    base = materialize(sketches(docs), "sketches")
    classes, same_id = _classes(base)
    buckets = bucket_rows(classes.select("rep", "first", "second"))
    signatures = classes.select("rep", "signature", "n_shingles")
    pairs = leader_pairs(buckets.join(signatures, "rep").select("bucket", "table", "rep", "count", "signature"), agree)
    verified = verify(pairs, docs, classes, percent)
    links = verified.union(same_id)
    near = components(links)
    labelled = buckets.join(near.withColumnRenamed("doc", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    rest = materialize(labelled.join(mixed, "bucket", "left_semi").join(signatures, "rep"), "mixed-members")
    sizes = materialize(rest.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")), "mixed-buckets")
    dealt, blocks = _dealt(rest.join(sizes, "bucket"))
    members = materialize(dealt.mapInArrow(_open_members(agree), _MEMBER), "open-members")
    more = verify_across(members, docs, classes, agree, percent)
    final = materialize(components(links.union(more)), "components")
    discard(buckets, pairs, rest, sizes, blocks, members, near)
    of = classes.join(final.withColumnRenamed("doc", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = materialize(of.join(smallest, "component").select("mark", "component_id"), "class-labels")
    out = base.join(of, "mark", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    done = materialize(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-labels")
    discard(base, classes, same_id, verified, more, final, of)
    return done


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its component."""
    labels = near_duplicates(docs, percent)
    name = fresh(docs)("gone")
    gone = materialize(labels.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "near-gone")
    discard(labels)
    return without(docs, "doc_id", gone, name, F.col("doc_id") == F.col(name), gone.count())


def oracle_sql(percent: int = 85) -> str:
    """The rows of near_duplicates() over documents (ids are not null there, and each stands for one text) in DuckDB's dialect: all shared shingles are counted."""
    return (
        "with recursive d as (select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents), "
        f"s as (select distinct r, doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') as h from (select r, doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) as i from d where len(w) > 0)), "
        "n as (select r, any_value(doc_id) as doc_id, count(*) as n from s group by r), p as (select a.r as x, b.r as y, count(*) as c from s a join s b on a.h = b.h and a.r < b.r group by all), "
        f"l as (select n.doc_id as x, m.doc_id as y from p join n on n.r = x join n m on m.r = y where 100 * c >= {percent} * (n.n + m.n - c) and n.doc_id <> m.doc_id), e as (select x, y from l union select y, x from l), "
        "k as (select x as doc_id, x as component from e union select e.y, k.component from k join e on e.x = k.doc_id and k.component < e.y), m as (select doc_id, min(component) as component from k group by doc_id) "
        "select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(least(component, d.doc_id), d.doc_id) as component_id, coalesce(least(component, d.doc_id), d.doc_id) = d.doc_id as kept from d left join n using (r) left join m on m.doc_id = d.doc_id"
    )
