"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is a polynomial hash over its UTF-8 bytes. It is computed from chunk hashes that
combine by length-shifted arithmetic, ``H(a + b) = H(a) * B**len(b) + H(b)``. The chunks of a huge document are rows
of their own, hashed by many tasks, and a grouped fold puts its fingerprint together; a shorter document's are hashed
where it is read. Two primes give about 62 bits, and the length is part of the key. Texts of equal fingerprint are
then compared chunk by chunk: for every (fingerprint, chunk number) the smallest and the largest chunk must agree, an
aggregation that combines on the map side, so that a group of copies costs one row a task however large it is. A group
that fails is split by its texts' SHA-256.

Nulls count as empty texts. Of equal texts exactly one row stays: that of the largest doc_id, rows of null ids being
the smallest; of rows repeated with that id one stays and the others go. Extra columns are ignored here and kept by
``drop_exact_duplicates``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import columns, discard, fresh, materialize, marked_rows, probable_rows, slices, text_or_empty

#: Bytes in a hashed chunk: 2**16 products under 2**39 stay within 64 bits.
CHUNK = 1 << 16
#: (prime, base) of the two fingerprints.
FIELDS = ((2147483647, 1000003), (2147483629, 16777619))
#: Bytes of a text beyond which its chunks are hashed by many tasks.
HUGE = 1 << 22
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(prime: int, base: int) -> np.ndarray:
    if (prime, base) not in _POWERS:
        out, x = np.empty(CHUNK, np.uint64), 1
        for i in range(CHUNK):
            out[CHUNK - 1 - i] = x
            x = x * base % prime
        _POWERS[prime, base] = out
    return _POWERS[prime, base]


def chunk_hash(chunk: bytes, prime: int, base: int) -> int:
    """The polynomial of at most CHUNK bytes; bytes count as 1 to 256 so that zeros matter."""
    b = np.frombuffer(chunk, np.uint8)
    return int((_powers(prime, base)[CHUNK - len(b) :] * (b.astype(np.uint64) + np.uint64(1))).sum()) % prime


def combine(left: tuple[int, int], right: tuple[int, int], prime: int, base: int) -> tuple[int, int]:
    """(hash, length) of a concatenation from its parts."""
    return (left[0] * pow(base, right[1], prime) + right[0]) % prime, left[1] + right[1]


def fingerprint(data: bytes) -> tuple[int, int]:
    """Both polynomial hashes, put together from chunk hashes."""
    out = []
    for prime, base in FIELDS:
        whole = (0, 0)
        for i in range(0, len(data), CHUNK):
            part = data[i : i + CHUNK]
            whole = combine(whole, (chunk_hash(part, prime, base), len(part)), prime, base)
        out.append(whole[0])
    return out[0], out[1]


_SCHEMA = "doc_id long, n_bytes long, fp1 long, fp2 long, text_sha256 string, row long, mark long"
KEY = ["n_bytes", "fp1", "fp2"]


def _fingerprints(batches):
    import xxhash

    for batch in slices(batches):
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        prints = [fingerprint(t) for t in texts]
        marks = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)  # what Spark's xxhash64 gives
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column(0), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "fp1": pa.array([m[0] for m in prints], pa.int64()), "fp2": pa.array([m[1] for m in prints], pa.int64()),
            "text_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), "row": batch.column(2), "mark": marks,
        })


def _chunk_hashes(batches):
    for batch in slices(batches, 64):
        chunks = batch.column(2).to_pylist()
        out = {"row": batch.column(0), "no": batch.column(1), "length": pa.array([len(c) for c in chunks], pa.int64())}
        for i, (prime, base) in enumerate(FIELDS, 1):
            out[f"h{i}"] = pa.array([chunk_hash(c, prime, base) for c in chunks], pa.int64())
            out[f"shift{i}"] = pa.array([pow(base, len(c), prime) for c in chunks], pa.int64())
        yield pa.RecordBatch.from_pydict(out)


#: The array of a text's chunks of bytes.
_CHUNKS = f"transform(sequence(0, cast((greatest(octet_length(text), 1) - 1) div {CHUNK} as int)), i -> substring(encode(text, 'UTF-8'), i * {CHUNK} + 1, {CHUNK}))"


def _huge_fingerprints(rows: DataFrame) -> DataFrame:
    """The same columns for huge texts: their chunks are dealt out, hashed and folded."""
    chunks = rows.select("row", F.posexplode(F.expr(_CHUNKS)).alias("no", "chunk")).repartition("row", "no")
    hashed = chunks.mapInArrow(_chunk_hashes, "row long, no int, length long, h1 long, shift1 long, h2 long, shift2 long")
    parts = hashed.groupBy("row").agg(F.sum("length").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("no", "h1", "shift1", "h2", "shift2"))).alias("parts"))
    fold = lambda i: F.expr(f"aggregate(parts, 0L, (a, x) -> (a * x.shift{i} + x.h{i}) % {FIELDS[i - 1][0]})")
    prints = parts.select("row", "n_bytes", fold(1).alias("fp1"), fold(2).alias("fp2"))
    own = rows.select("doc_id", "row", F.sha2("text", 256).alias("text_sha256"), F.xxhash64("text").alias("mark"))
    return own.join(prints, "row").select("doc_id", *KEY, "text_sha256", "row", "mark")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, fp1, fp2, text_sha256, row (a number of its own) and mark (xxhash64 of the text) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    huge = F.octet_length("text") > HUGE
    here = rows.where(~huge).withColumn("row", F.col("row") * 2).mapInArrow(_fingerprints, _SCHEMA)
    return here.unionByName(_huge_fingerprints(rows.where(huge).withColumn("row", F.col("row") * 2 + 1)))


def unequal_groups(docs: DataFrame, shared: DataFrame, keys: int) -> DataFrame:
    """Keys of the groups whose texts differ. shared: the keys, so many, that several rows have, and the least and greatest mark of their rows.

    Texts of one fingerprint and two marks differ. The others are compared chunk by chunk, where they lie: rows that a bitmap of the marks lets
    pass need no join, as one that passes by chance is alone with its mark.
    """
    texts = docs.select(text_or_empty().alias("text")).withColumn("mark", F.xxhash64("text"))
    passed = probable_rows(texts, "mark", shared.where("lo = hi").select(F.col("lo").alias("wanted")), "wanted", keys)
    chunks = passed.select("mark", F.posexplode(F.expr(_CHUNKS)).alias("no", "chunk"))
    differ = chunks.groupBy("mark", "no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).where("least <> most").select("mark").distinct()
    return shared.where("lo <> hi").select(*KEY).union(shared.join(differ, shared["lo"] == differ["mark"], "left_semi").select(*KEY)).distinct()


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256: a row for each input row."""
    stored = base = materialize(fingerprints(docs), "fingerprints")
    last = F.max(F.struct("doc_id", "row")).alias("last")
    marks = [F.min("mark").alias("lo"), F.max("mark").alias("hi")]
    shared = materialize(base.groupBy(*KEY).agg(F.count("*").alias("group_size"), last, *marks).where("group_size > 1"), "shared-fingerprints")
    unequal = materialize(unequal_groups(docs, shared, shared.count()), "unequal-groups")
    part, groups, split = F.lit(""), shared.drop("lo", "hi").withColumn("part", F.lit("")), unequal.count()
    if split:  # fingerprints that different texts have: told apart by SHA-256 as well
        apart = (F.broadcast(unequal) if split <= 1000 else unequal).withColumn("split", F.lit(True))
        base = base.join(apart, KEY, "left")
        part = F.when(F.col("split"), F.col("text_sha256")).otherwise(F.lit(""))
        again = base.where("split").groupBy(*KEY, F.col("text_sha256").alias("part")).agg(F.count("*").alias("group_size"), last).where("group_size > 1")
        groups = materialize(groups.join(apart, KEY, "left_anti").unionByName(again), "exact-groups")
    out = base.withColumn("part", part).join(groups, [*KEY, "part"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("last.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    done = materialize(out, "exact-labels")
    discard(stored, shared, unequal, groups)
    return done


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of rows repeated with one id and text, one stays (which, if other columns differ, isn't defined)."""
    labels = exact_duplicates(docs)
    name = fresh(docs)
    doc, sha, stays, rows, whole = (name(x) for x in ("id", "sha", "stays", "rows", "whole"))
    pairs = labels.where("group_size > 1").groupBy(F.col("doc_id").alias(doc), F.col("text_sha256").alias(sha)).agg(F.max("kept").alias(stays), F.count("*").alias(rows))
    judged = materialize(pairs.where(f"not {stays} or {rows} > 1"), "exact-judged")
    discard(labels)
    marked, hit = marked_rows(docs, "doc_id", judged, doc, judged.count())
    clear = marked.where(~F.col(hit)).drop(hit)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.sha2(text_or_empty(), 256) == F.col(sha))
    met = marked.where(F.col(hit).isNull() | F.col(hit)).join(judged, same, "left")
    single = met.where(F.col(rows).isNull()).select(*columns(docs))
    one = met.where(F.col(stays)).groupBy(doc, sha).agg(F.first(F.struct(*columns(docs))).alias(whole)).select(f"{whole}.*")
    return clear.unionByName(single).unionByName(one)
