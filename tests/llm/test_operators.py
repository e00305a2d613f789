"""The corpus operators against plain versions, on the small tables and on odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from tallyspark.llm import exact_dup, html_extract, lang_id, media, near_dup, packing, pii, queries, sp_codec, suffix_dedup, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 9000
PASSAGE = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix a jug of very bitter lemon juice tonight. "
TEXTS = [
    None, "", " \n\t ", "one two three", "ONE two Three", "word", LONG, LONG + "end", "x" * 70_000, "é" * 150, "a<|endoftext|>b", "日本語のテキスト 漢字 ▁ mark",
    PASSAGE + "alpha " * 30, "beta " * 20 + PASSAGE, PASSAGE + PASSAGE, "Mail bob@example.com or ann@x.org. Card 4111 1111 1111 1111, ip 10.0.0.300 10.0.0.30 call +1 (988) 555-2485!",
    "IBAN GB82 WEST 1234 5698 7654 32, a@b.c_d@e.fg", "nul \x00 byte", "tail   blanks   ", "word", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0" * 3000, "+" * 500,
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    small = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(1000 + i, t, "en" if i % 2 else None, "s", None, i) for i, t in enumerate(TEXTS)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part int")
    return small.withColumn("part", small.doc_id.cast("int")).unionByName(odd).withColumnsRenamed({"part": "rep"}).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    where, root = collections.defaultdict(list), {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for i in sorted(sets):
        for j, n in collections.Counter(j for s in sets[i] for j in where[s]).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            where[s].append(i)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates(docs, texts):
    want, sizes = components(texts, 85)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_large_groups(spark, monkeypatch):
    """A group of many different near copies, beside texts of a middling similarity, in small blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(150):
        words = list(base)
        for k in rng.integers(0, 120, i % 12):
            words[k] = f"z{rng.integers(10**6)}"
        rows[i] = " ".join(words)
    got = near_dup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), 85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components(rows, 85)[0]


def test_near_duplicates_ids(spark):
    """Rows of null id are linked with nothing; an id of two texts has the links of both."""
    def words(seed):
        return [f"{seed}{k}" for k in range(40)]

    a, b, c = words("a"), words("b"), words("c")
    rows = [(None, " ".join(a)), (None, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*b, "end"])), (9, " ".join(["start", *a])), (11, " ".join(c)), (11, " ".join(c)), (12, None), (13, " ".join([*c, "x"]))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted(
        [(None, None, True), (None, None, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (11, 11, True), (11, 11, True), (12, 12, True), (13, 11, False)], key=str)
    assert {tuple(r) for r in near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()} == {rows[0], *rows[2:4], rows[6], rows[8]}


@pytest.mark.parametrize("drop", [exact_dup.drop_exact_duplicates, near_dup.drop_near_duplicates, lang_id.keep_identified, pii.redact])
def test_odd_columns(spark, drop):
    """Extra columns of any name come through untouched."""
    odd = ["filter__bits", "bits", "gone__id", "gone", "hit", "id", "sha", "stays", "row", "rows", "pii__text", "pii__spans", "pii__email", "spans", "at", "a.b", "part"]
    rows = [(i, f"some words of english text number {i % 3} follow here", "en", *[f"{c}{i}" for c in odd]) for i in range(6)]
    table = spark.createDataFrame(rows, ["doc_id", "text", "lang", *odd])
    out = drop(table)
    assert out.columns == table.columns
    got = {tuple(r) for r in out.collect()}
    assert got <= set(rows) and len(got) == {"drop_exact_duplicates": 3, "drop_near_duplicates": 3}.get(drop.__name__, 6)


def test_near_duplicates_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(none).collect() == []


def repeats(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i].encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                mark[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out[i] = (len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("how", [{}, {"batch": 500}, {"bits": (2, 64)}, {"hot": True}])
def test_repeats(docs, texts, how, monkeypatch):
    """The whole way; in small batches; with region hashes that meet by chance at first; with every anchor a hot one."""
    how = dict(how)
    if how.pop("hot", False):
        monkeypatch.setattr(suffix_dedup, "HOT_REGIONS", 2)
        monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
        assert len(suffix_dedup._hot_anchors(suffix_dedup._documents(docs), 0)[0]) > 20
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(docs, **how).collect()}
    assert got == repeats(texts)


def test_repeats_ids(spark):
    """Rows of a null id, or of an id that stands for several texts, keep all bytes and take none from others."""
    rows = [(None, PASSAGE, None), (3, PASSAGE + "x", "en"), (3, PASSAGE + "y", "en"), (5, PASSAGE, "en"), (5, PASSAGE, "en"), (7, "a" + PASSAGE, "en")]
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()))
    n = len(PASSAGE)
    assert got == [(0, n, 0), (3, n + 1, 0), (3, n + 1, 0), (5, n, 0), (5, n, 0), (7, n + 1, n)]


def test_repeated_rows(docs, texts):
    """Every row twice: the results are those of the rows once, twice."""
    twice = docs.union(docs).repartition(5)
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(twice).collect())
    assert got == sorted(x for i, r in repeats(texts).items() for x in [(i, *r)] * 2)
    want, _ = components(texts, 85)
    assert sorted((r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(twice).collect()) == sorted(x for i in want.items() for x in [i] * 2)
    last = sorted({t: i for i, t in sorted(texts.items())}.values())
    assert sorted(r["doc_id"] for r in exact_dup.exact_duplicates(twice).where("kept").collect()) == last
    assert sorted(r["doc_id"] for r in exact_dup.drop_exact_duplicates(twice).collect()) == last


def test_null_ids(spark):
    """Rows without an id have results of their own, like those of any other row with the text."""
    rows = spark.createDataFrame([(None, PASSAGE, None), (None, None, "en"), (5, PASSAGE, "en")], "doc_id long, text string, lang string")
    size, sha = len(PASSAGE), hashlib.sha256(PASSAGE.encode()).hexdigest()
    got = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert got(exact_dup.exact_duplicates(rows).select("doc_id", "keep_id", "group_size", "kept")) == sorted([(None, 5, 2, False), (None, None, 1, True), (5, 5, 2, True)], key=str)
    assert got(near_dup.near_duplicates(rows).select("doc_id", "component_id", "kept")) == sorted([(None, None, True), (None, None, True), (5, 5, True)], key=str)
    assert got(suffix_dedup.remove_repeats(rows).select("doc_id", "n_bytes", "n_removed", "kept_sha256")) == sorted([(None, size, 0, sha), (None, 0, 0, hashlib.sha256(b"").hexdigest()), (5, size, 0, sha)], key=str)
    assert got(pii.pii_report(rows).select("doc_id", "spans")) == sorted([(None, ""), (None, ""), (5, "")], key=str)
    assert {(r["doc_id"], r["held_out"], r["lang_pred"]) for r in lang_id.identify(rows).collect()} == {(None, False, "en"), (None, False, "und"), (5, zlib.crc32(b"5") % 5 == 0, "en")}
    assert {(r["doc_id"], r["n_bytes"]) for r in media.text_media(rows).collect()} == {(None, size), (None, 0), (5, size)}
    packed = [(r["doc_id"], r["doc_tokens"]) for r in packing.pack(rows, queries.tokenizer_path("byte_bpe_50k.json")).collect()]
    assert (None, 1) in packed and {t for i, t in packed if i == 5} <= {t for i, t in packed if i is None}
    encoded = {(r["doc_id"], r["text_bytes"], r["round_trip"]) for r in sp_codec.encode(rows, queries.tokenizer_path("piece_bpe_32k.model"), with_ids=False).collect()}
    assert encoded == {(None, size, True), (None, 0, True), (5, size, True)}


def test_every_row_twice(spark, docs):
    """Operators that judge rows one by one give repeated rows their result each."""
    some = docs.where("doc_id < 40 or doc_id >= 1000").select("doc_id", "text", "lang")
    net = lang_id.fit(docs.where("doc_id < 1000").select("doc_id", "text", "lang"))
    path = queries.tokenizer_path("piece_bpe_32k.model")
    for name, run in (("pii", pii.pii_report), ("language", lambda d: lang_id.predict(d, net)), ("media", media.text_media), ("codec", lambda d: sp_codec.encode(d, path, with_ids=False))):
        once = collections.Counter(map(str, run(some).collect()))
        assert collections.Counter(map(str, run(some.union(some).repartition(3)).collect())) == once + once, name
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<div class=a>menu</div><div class=b><p>text number {i} of this host</p></div>") for i in range(6)], "page_id long, url string, html string")
    once = collections.Counter(map(str, html_extract.main_text(pages).collect()))
    assert collections.Counter(map(str, html_extract.main_text(pages.union(pages)).collect())) == once + once
    labelled = spark.createDataFrame([("http://x.example/a", True)], "url string, blocked boolean")
    once = collections.Counter(map(str, url_filter.judge_urls(pages, labelled).collect()))
    assert collections.Counter(map(str, url_filter.judge_urls(pages.union(pages), labelled).collect())) == once + once


def test_suffix_family_in_any_order():
    """Batches in any order of documents give the windows that aren't the earliest."""
    rng = np.random.default_rng(1)
    data = [bytes(rng.integers(97, 99, 260, dtype=np.uint8)) for _ in range(6)]
    data[4] = data[1][:150] + data[4][:110]
    data[5] = data[0]
    for order in ([0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0], [4, 0, 5, 1, 2, 3]):
        family = suffix_dedup.SuffixFamily()
        for d in order:
            starts = np.arange(161)
            first = np.array([zlib.crc32(data[d][s : s + 100]) for s in starts], np.uint64)
            family.insert(np.frombuffer(data[d], np.uint8), starts, first, np.full(161, d), starts)
        got = {(int(d), int(p)) for ds, ps in family.repeats for d, p in zip(ds, ps, strict=True)}
        seen, want = set(), set()
        for d in range(6):
            for s in range(161):
                if data[d][s : s + 100] in seen:
                    want.add((d, s))
                seen.add(data[d][s : s + 100])
        assert got == want


def test_long_text_in_pieces(monkeypatch):
    text = (PASSAGE * 3 + "tail " * 50).encode()
    whole = [(i, p) for p in suffix_dedup.pieces_of([text], [1]) for i in [1]]
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    cut = list(suffix_dedup.pieces_of([text, text[:300]], [1, 2]))
    assert len(whole) == 1 and len(cut) > 3
    starts = collections.Counter()
    for data, owner, ids, offset in cut:
        assert len(data) <= 256
        for k in range(len(data) - 99):
            if owner[k] == owner[k + 99]:
                d = int(ids[owner[k]])
                starts[d, int(k + offset[owner[k]])] += 1
    assert set(starts) == {(1, k) for k in range(len(text) - 99)} | {(2, k) for k in range(201)} and set(starts.values()) == {1}


def test_exact(docs, texts):
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in exact_dup.exact_duplicates(docs).collect()} == want
    kept = exact_dup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {w[1] for w in want}


def test_exact_unequal_texts_of_equal_fingerprint(docs, texts, monkeypatch):
    """With a fingerprint that says nothing the comparison of chunks tells the texts apart."""
    real = exact_dup.fingerprints
    monkeypatch.setattr(exact_dup, "fingerprints", lambda *a, **k: real(*a, **k).withColumns({k: F.lit(0).cast("long") for k in ("fp1", "fp2", "n_bytes")}))
    sizes = collections.Counter(texts.values())
    assert {r["doc_id"]: r["group_size"] for r in exact_dup.exact_duplicates(docs).collect()} == {i: sizes[t] for i, t in texts.items()}


def test_exact_unequal_texts_of_equal_marks(docs, texts, monkeypatch):
    """Where the marks say nothing either, chunks are compared: here every text has the mark of another one."""
    real = exact_dup.fingerprints

    def same(*a):
        base = real(*a).withColumns({k: F.lit(0).cast("long") for k in ("fp1", "fp2")})
        return base.withColumn("mark", F.when(F.col("n_bytes") == 12, F.xxhash64(F.lit("word"))).otherwise(F.col("mark")))

    monkeypatch.setattr(exact_dup, "fingerprints", same)
    sizes = collections.Counter(texts.values())
    assert {r["doc_id"]: r["group_size"] for r in exact_dup.exact_duplicates(docs).collect()} == {i: sizes[t] for i, t in texts.items()}


def test_exact_null_ids(spark):
    """One row of each text stays, also where ids are null or repeated."""
    rows = [(None, "bbb", 1), (None, "bbb", 2), (5, "aaa", 3), (5, "aaa", 4), (None, "aaa", 5), (2, "aaa", 6), (None, None, 7), (3, "", 8), (4, "single", 9), (None, "lone", 10), (5, "other", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep int")
    got = exact_dup.exact_duplicates(docs).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got if r["text_sha256"] == sha("aaa")), key=str) == sorted([(5, 5, 4, True), (5, 5, 4, False), (None, 5, 4, False), (2, 5, 4, False)], key=str)
    assert sorted(r["kept"] for r in got if r["text_sha256"] == sha("bbb")) == [False, True]
    left = [tuple(r) for r in exact_dup.drop_exact_duplicates(docs).collect()]
    assert sorted((i, t or "") if i else (0, t or "") for i, t, _ in left) == [(0, "bbb"), (0, "lone"), (3, ""), (4, "single"), (5, "aaa"), (5, "other")] and set(left) <= set(rows)


def test_exact_huge_texts(docs, texts, monkeypatch):
    """Texts whose chunks are dealt out have the fingerprints of those hashed in one place."""
    told = ["doc_id", *exact_dup.KEY, "text_sha256", "mark"]
    want = sorted(map(tuple, exact_dup.fingerprints(docs).select(*told).collect()))
    monkeypatch.setattr(exact_dup, "HUGE", 20)
    assert sorted(map(tuple, exact_dup.fingerprints(docs).select(*told).collect())) == want


def test_fingerprints_combine():
    data = bytes(range(256)) * 700
    for prime, base in exact_dup.FIELDS:
        want = 0
        for b in data[:3000]:
            want = (want * base + b + 1) % prime
        assert exact_dup.chunk_hash(data[:3000], prime, base) == want
        parts = [(exact_dup.chunk_hash(data[i : i + 1000], prime, base), len(data[i : i + 1000])) for i in range(0, 3000, 1000)]
        assert exact_dup.combine(exact_dup.combine(*parts[:2], prime, base), parts[2], prime, base) == (want, 3000)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    ids = {i: np.array([*slow.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    rows = packing.pack(docs, path).collect()
    at, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        at[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    for i, own in ids.items():
        spans = sorted(at[i])
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) == len(own)
    for pieces in windows.values():
        pieces.sort()
        total = sum(n for _, n in pieces)
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1].tolist()] and total <= 1024 and total & (total - 1) == 0


def test_packing_partitions(docs):
    """However the rows are dealt out, every id lies in one piece, and little is left to the closing of windows in large partitions."""
    path = queries.tokenizer_path("byte_bpe_50k.json")
    totals = []
    for n in (1, 5, 40):
        rows = packing.pack(docs.repartition(n, "doc_id"), path).collect()
        totals.append(sum(r["length"] for r in rows))
        fills = collections.Counter()
        for r in rows:
            fills[r["sequence_id"]] += r["length"]
        assert all(f & (f - 1) == 0 and f <= 1024 for f in fills.values())
    assert len(set(totals)) == 1
    shares = []
    for size in (2000, 20_000):
        p = packing.Packer(1024)
        for n in np.random.default_rng(7).integers(1, 2000, size):
            p.add(0, np.zeros(n, np.uint32))
        placed = len(p.drain())
        p.finish()
        shares.append(len(p.drain()) / placed)
    assert shares[1] < 0.5 * shares[0]  # the windows left open grow much slower than the documents


def test_packer_minimises_squares():
    rng = np.random.default_rng(2)
    p = packing.Packer(64)
    for doc, n in enumerate(rng.integers(1, 64, 400)):
        c = p.count.copy()
        best = {}
        for level in [0, *np.flatnonzero(c[: 65 - n]).tolist()]:
            d = c.copy()
            if level:
                d[level] -= 1
            if level + n < 64:
                d[level + n] += 1
            best.setdefault(int((d**2).sum()), []).append(level)
        assert p.level_for(int(n)) == max(best[min(best)])
        p.add(doc, np.zeros(n, np.uint32))


def test_media(docs, texts):
    got = {r["doc_id"]: r for r in media.text_media(docs).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        payload, r = media.pad(t.encode()), got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["position"], r["caption"]) == (0, f"text of {len(t.encode())} bytes") and r["media_sha256"] == hashlib.sha256(media.encode_image(payload)).hexdigest()


def test_interleaving_keeps_order(spark):
    page = '<p>One</p><figure><img src="sha256:aa" alt="x"><figcaption>Cap &amp; tion</figcaption></figure><script>no</script>two<img src="bb" alt="y">end'
    assert [(e["kind"], e["text"], e["digest"], e["caption"]) for e in media.interleave(page)] == [
        ("text", "One", None, None), ("media", None, "aa", "Cap & tion"), ("text", "two", None, None), ("media", None, "bb", "y"), ("text", "end", None, None)]
    seqs = media.sequences(spark.createDataFrame([(1, page), (2, None)], "doc_id long, html string"))
    found = media.resolve(seqs, spark.createDataFrame([("aa", 5)], "digest string, n_bytes long")).orderBy("position").collect()
    assert [(r["position"], r["digest"], r["n_bytes"]) for r in found] == [(1, "aa", 5), (3, "bb", None)]
    with pytest.raises(ValueError):
        media.decode_image(b"nothing")
    good = media.encode_image(media.pad(b"text"))
    assert media.features(good, 4, hashlib.sha256(b"text").hexdigest())[0] == 576
    with pytest.raises(ValueError):
        media.features(good[:-1] + b"x", 576, hashlib.sha256(media.pad(b"text")).hexdigest())


def test_media_sequences(spark):
    """Several media a page, some shared, one missing: captions and payloads stay with their places."""
    texts = {k: f"payload {k} " * 50 for k in range(4)}
    digest = {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}
    stored = media.materialize(media.store_texts(spark.createDataFrame([(t,) for t in [*texts.values(), texts[0]]], "text string")), "media")
    figure = lambda k, before: f"<figure>{f'<figcaption>Cap {k}</figcaption>' if before else ''}<img src='sha256:{digest[k]}'>{'' if before else f'<figcaption>Cap {k}</figcaption>'}</figure>"
    pages = [(1, f"<p>a</p>{figure(0, True)}<p>b &lt;</p>{figure(1, False)}<noscript><img src=x></noscript><video><source src='sha256:{digest[2]}' title='film'></video>"), (2, f"{figure(0, False)}tail<img src=gone>"), (3, None), (3, "<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out")]
    frame = spark.createDataFrame(pages, "page_id long, html string")
    seqs = media.sequences(frame, "page_id").collect()
    assert [[e["text"] or e["digest"] for e in r["elements"]] for r in seqs][0] == ["a", digest[0], "b <", digest[1], digest[2]]
    assert [(e["digest"], e["caption"]) for e in seqs[3]["elements"] if e["digest"]] == [("a", None), ("b", "in")]
    found = media.resolve(media.sequences(frame, "page_id"), media.catalog(media.read_media(stored))).collect()
    got = {(r["doc_id"], r["position"]): (r["caption"], r["n_bytes"], r["payload_sha256"]) for r in found}
    sha = lambda k: hashlib.sha256(media.pad(texts[k].encode())).hexdigest()
    assert {k: got[k] for k in ((1, 1), (1, 3), (1, 4), (2, 0), (2, 2))} == {(1, 1): ("Cap 0", 500, sha(0)), (1, 3): ("Cap 1", 500, sha(1)), (1, 4): ("film", 500, sha(2)), (2, 0): ("Cap 0", 500, sha(0)), (2, 2): (None, None, None)}


def test_sentencepiece(docs, texts):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    encoded = sp_codec.encode(docs, path)
    rows = encoded.collect()
    assert all(r["round_trip"] for r in rows) and len(rows) == len(texts)
    assert {r["doc_id"]: r["text"] for r in sp_codec.decode(encoded, path).collect()} == texts


def test_sentencepiece_best_path():
    pieces = [("<0x%02X>" % b, 0.0, "byte") for b in range(256)] + [(p, s, "normal") for p, s in (("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -3.5), ("▁a", -4.0), ("ba", -1.0), ("bab", -2.5), ("▁▁", -1.0))]
    code = sp_codec.Codec(pieces)
    score = {p: s for p, s, k in pieces if k == "normal"}

    def best(word):
        if not word:
            return 0.0
        return max([best(word[len(p) :]) + s for p, s in score.items() if word.startswith(p)] + [best(word[1:]) + code.byte_score * len(word[0].encode())])

    rng = np.random.default_rng(4)
    for _ in range(200):
        text = "".join(rng.choice(list("ab c"), rng.integers(1, 9)))
        ids = code.encode(text)
        assert code.decode(ids) == text
        got = sum(score[pieces[i][0]] if i >= 256 else code.byte_score for i in ids)
        assert got == pytest.approx(best("▁" + text.replace(" ", "▁")))


def test_sentencepiece_ids(docs, texts):
    from sentencepiece import SentencePieceProcessor

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp, code = SentencePieceProcessor(model_file=path), sp_codec.Codec.load(path)
    rows = [r for r in sp_codec.encode(docs, path).collect() if "▁" not in texts[r["doc_id"]]]  # a literal word mark is spelled in bytes here
    assert len(rows) > 100
    for r in rows:
        want = sp.encode(texts[r["doc_id"]])
        assert r["ids"] == want
        assert (r["n_tokens"], r["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
    rng = np.random.default_rng(5)
    pieces = [p.replace("▁", " ") for p in code.ranked]
    for n in range(1000):
        text = "".join(rng.choice(pieces, rng.integers(1, 12))) if n % 2 else "".join(rng.choice(list("ab  \n\té日x1"), rng.integers(1, 60)))
        assert code.encode(text) == sp.encode(text)
    parts = "of the ▁ mark".split("▁")
    assert code.encode("▁".join(parts)) == [*sp.encode(parts[0]), *(code.byte_ids[b] for b in "▁".encode()), *code.merged_path(parts[1].replace(" ", "▁"))]


def test_sentencepiece_literal_marks():
    """Many literal word marks take time in proportion to their number."""
    import time

    code = sp_codec.Codec.load(queries.tokenizer_path("piece_bpe_32k.model"))
    text = "a ▁▁b " * 50_000
    began = time.time()
    assert code.decode(code.encode(text)) == text and time.time() - began < 20


def test_language(docs, texts):
    rows = lang_id.identify(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 1000]
    assert len(rows) == len(texts) and held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, texts[r["doc_id"]]))) and 0 <= r["score"] <= 1


def plain_probabilities(net, window):
    """One window by loops."""
    best = np.full(net.kernel.shape[2], -np.inf)
    for i in range(len(window) - net.width + 1):
        r = sum(net.embed[window[i + k]].astype(float) @ net.kernel[k] for k in range(net.width))
        best = np.maximum(best, r)
    z = np.tanh(best) @ net.out + net.bias
    e = np.exp(z - z.max())
    return e / e.sum()


def test_language_network():
    """Gradients against differences, probabilities against loops, a text's score against the mean of its windows."""
    rng = np.random.default_rng(6)
    net = lang_id.ByteCnn(["a", "b", "c"])
    for name in ("embed", "kernel", "out", "bias", "taps"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.out = rng.normal(0, 0.5, net.out.shape)
    x, y = rng.integers(0, 256, (6, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    loss = lambda: -np.mean([np.log(plain_probabilities(net, w)[k]) for w, k in zip(x, y, strict=True)])
    for weight, gradient in zip((net.embed, net.kernel, net.out, net.bias), net.gradients(x, y), strict=True):
        flat, g = weight.reshape(-1), gradient.reshape(-1)
        places = np.argsort(-np.abs(g))[:4]
        for i in places:
            held, step = flat[i], 1e-6
            flat[i] = held + step
            up = loss()
            flat[i] = held - step
            down = loss()
            flat[i] = held
            assert (up - down) / (2 * step) == pytest.approx(g[i], rel=1e-3, abs=1e-7)
    data = bytes(rng.integers(97, 123, 700, dtype=np.uint8))
    windows = lang_id.windows_of(data)
    assert windows.shape == (3, lang_id.WINDOW) and windows.tobytes().rstrip(b" ") == data
    assert net.probabilities(windows) == pytest.approx(np.stack([plain_probabilities(net, w) for w in windows]))


def test_language_scores(spark, docs, texts):
    net = lang_id.fit(docs.where("doc_id < 1000").select("doc_id", "text", "lang"))
    rows = lang_id.predict(docs, net).where("doc_id >= 1000").collect()
    for r in rows:
        t = texts[r["doc_id"]]
        if len(t) < 2000 and any(map(str.isalpha, t)):
            mean = np.mean([plain_probabilities(net, w) for w in lang_id.windows_of(t.encode())], axis=0)
            assert (r["lang_pred"], r["score"]) == (net.languages[int(mean.argmax())], pytest.approx(float(mean.max()), rel=1e-4))


def test_language_many(spark, monkeypatch):
    """Every language can be learned, however many there are; more than the sample holds are an error."""
    rows = [(i, f"{chr(97 + i % 26) * 3} {chr(97 + i // 26 % 26) * 3} " * 30, f"l{i % 260:03d}") for i in range(520)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(lang_id.training_sample(table, 1)) > 100 and len({lang for _, lang in lang_id.training_sample(table, 300)}) == 260
    monkeypatch.setattr(lang_id, "MAX_SAMPLE", 100)
    with pytest.raises(ValueError):
        lang_id.training_sample(table)


def test_language_without_labels(spark):
    none = spark.createDataFrame([(1, "text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in lang_id.identify(none).collect()} == {"und"}


def test_pii(docs, texts):
    base = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    rows = {r["doc_id"]: r for r in pii.pii_report(docs).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in base.items() for m in re.finditer(p, t) if ok(k, m[0])]
        r = rows[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), (i, spans, r)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s.startswith(k + ":") for s in spans) for k in base]
        assert [s for s in r["spans"].split(",") if s and s.partition(":")[0] in base] == spans
        assert len(r["scores"]) == 0 or r["scores"].count(",") == r["spans"].count(",")
    assert "iban:5:32" in rows[1000 + TEXTS.index("IBAN GB82 WEST 1234 5698 7654 32, a@b.c_d@e.fg")]["spans"]


def test_pii_context_decides(spark):
    """An added kind counts only with a word that speaks for it; a base kind counts without, with a lower score."""
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'token = "{token}"'), (2, f"commit {token}"), (3, "SSN: 123-45-6789"), (4, "part 123-45-6789"), (5, "ssn 666-45-6789"), (6, "call +1 988 555 2485"), (7, "it is +1 988 555 2485"), (8, "my secret is " + "a" * 40)]
    got = {r["doc_id"]: (r["spans"], r["scores"]) for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("secret:9:49", "70"), 2: ("", ""), 3: ("ssn:5:16", "70"), 4: ("", ""), 5: ("", ""), 6: ("phone:5:20", "70"), 7: ("phone:6:21", "60"), 8: ("", "")}


def test_pii_redaction(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1015] == "Mail <EMAIL> or <EMAIL>. Card <CARD>, ip 10.0.0.300 <IP> call <PHONE>!" and texts[1000] is None


def test_main_text(spark):
    nav = "<nav><ul><li><a href=/{0}>{0}</a></li><li><a href=/b>b</a></li></ul></nav><div class=ad>buy {0}</div>"
    rows = []
    for i in range(8):
        rows.append((i, f"http://Host.example/{i}", f"<html><head><title>t{i}</title><script>var a='</p>';</script></head><body>{nav.format(i)}<article><h1>Head {i}</h1><p>Some <b>bo</b>ld&nbsp;&amp; text {i}<br>next"
                     f"<p>para two {i}</p><div class=box>Read our magazine</div></article><div class='comments'><p>nice {i}</p></div><footer>&copy; host</footer>"))
    rows += [(100, None, None), (101, "no url", ""), (102, "http://other/", "just text <i>here</i>")]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"Head {i} Some bold & text {i} next para two {i}" for i in range(8)} | {100: "", 101: "", 102: "just text here"}


def test_main_text_constant_paragraphs(spark):
    notice, box = "<p>Subscribe to <b>our</b> paper", "<div class=x7><p>Written by machines</p></div>"
    rows, want = [], {}
    for i in range(8):
        body = f"<h1>Head {i}</h1><p>Story {i} begins with quite some words here{notice if i % 2 else ''}<p>and ends {i} much later than it began"
        body = body.replace("<p>and", "<figure></figure><p>and") if i % 3 else body
        rows.append((i, f"http://a.example/{i}", f"<body><article>{body}{'' if i % 2 else notice}{box}</article>"))
        rows.append((100 + i, f"http://b.example/{i}", f"<body>{body}{'' if i % 2 else notice}{box}"))
        want[i] = want[100 + i] = f"Head {i} Story {i} begins with quite some words here and ends {i} much later than it began"
        copied = "<p>A long article that was copied to all pages</p><p>of this host</p>"
        rows.append((200 + i, f"http://c.example/{i}", f"<body><div class=ad>ad {i}</div><article>{copied}</article>"))
        rows.append((300 + i, f"http://d.example/{i}", f"<body><article><h1>Copy {i}</h1>{copied}</article>"))
        want[200 + i] = "A long article that was copied to all pages of this host"
        want[300 + i] = f"Copy {i} {want[200 + i]}"
        few = "<p>Said twice</p>" if i < 2 else ""
        rows.append((400 + i, f"http://e.example/{i}", f"<body><article><p>An article of its own, number {i}</p>{few}</article>"))
        want[400 + i] = f"An article of its own, number {i}" + (" Said twice" if few else "")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()} == want


def test_main_text_joined_wrappers(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one = sorted(map(tuple, html_extract.main_text(pages).collect()))
    monkeypatch.setattr(html_extract, "CARRIED_BYTES", 0)
    assert sorted(map(tuple, html_extract.main_text(pages).collect())) == one and all(t[3] > 0 for t in one)


def test_main_text_by_wrapper(spark):
    """Without telling tags and names the varying slots of a host's pages tell the article, also on pages where it is short."""
    rows, want = [], {}
    for i in range(9):
        menu = "<div><ul>" + "".join(f"<li><a href=/{k}>Section {k} of {i if k == 3 else 'all'}</a></li>" for k in range(6)) + "</ul></div>"
        head, body = f"Head {i}", [f"Story {i} part {k} tells a good deal" for k in range(3 if i else 0)]
        article = f"<div class=c1><h2>{head}</h2>" + "".join(f"<p>{b}</p>" for b in body) + "<div class=q>Read on</div></div>"
        page = f"<body><div class=top>The Paper</div>{menu}{article}<div class=z9>Weather {i}: rain and some wind today, {i} degrees</div><div>Imprint</div></body>"
        rows.append((i, f"http://Host.example/{i}", page))
        want[i] = " ".join([head, *body])
    pages = spark.createDataFrame([*rows, rows[3]], "page_id long, url string, html string").repartition(4)
    got = html_extract.main_text(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and len(got) == 10
    none = spark.createDataFrame([], "host string, wrapper string")
    alone = {r["page_id"]: r["text"] for r in html_extract.main_text(pages, none).collect()}
    assert "Weather" in alone[0] and alone[3] != want[3]  # the wrapper decides


def test_main_text_several_articles(spark):
    rows = [(i, f"http://h/{i}", "<body><div>menu</div><main>" + "".join(f"<article><h2>Item {i} {k}</h2><p>Its text {i} {k} is here</p><section id=related-work>Work {i} {k}</section></article>" for k in range(4)) + f"</main><div>last {i}</div>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(f"Item {i} {k} Its text {i} {k} is here Work {i} {k}" for k in range(4)) for i in range(6)}


def test_main_text_odd_markup(spark):
    odd = ["<div>" * 10000 + "deep text", "".join(f"<div id=c{k}>block {k}</div>" for k in range(10000)), "<a " * 30000, '<p title="x>y">quoted</p><a "', "a < b <p>c</p> &lt;d&gt; &#233; <!-- open", "</div></p>" * 20000 + "end", "<script>never closed"]
    rows = [(i, f"http://odd.example/{i % 2}", t) for i, t in enumerate(odd * 2)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "deep text" and got[1] == " ".join(f"block {k}" for k in range(10000)) and got[2].startswith("<a") and got[3] == 'quoted <a "'
    assert got[4] == "a < b c <d> é" and got[5] == "end" and got[6] == ""


def test_tree_matching():
    """Simple tree matching against its quadratic table, on random trees."""
    def tree(x):
        out = html_extract.Node(x[0])
        out.children = [tree(c) for c in x[1:]]
        return out

    def plain(a, b):
        if a.key != b.key:
            return 0
        table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children, 1):
            for j, y in enumerate(b.children, 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + plain(x, y))
        return 1 + table[-1][-1]

    def matched(a, b):
        table = {}
        html_extract._shaped(a, table)
        html_extract._shaped(b, table)
        return html_extract.match(a, b, {})

    a, b = tree(["r", ["a", ["x"], ["y"]], ["b"], ["c"]]), tree(["r", ["a", ["y"]], ["c"], ["d"]])
    assert matched(a, b) == 4 and len(html_extract.aligned(a, b)) == 4
    html_extract.merge(a, b)
    assert [c.key for c in a.children] == ["a", "b", "c", "d"] and a.children[0].pages == 2
    again = html_extract.Node.load(a.dump())
    assert again.dump() == a.dump()
    rng = np.random.default_rng(9)
    grown = lambda depth: ["abc"[rng.integers(3)], *[grown(depth - 1) for _ in range(rng.integers(0, 5) if depth else 0)]]
    for _ in range(300):
        a, b = tree(["r", *grown(3)[1:]]), tree(["r", *grown(3)[1:]])
        assert matched(a, b) == plain(a, b)
        assert len(html_extract.aligned(a, b)) == plain(a, b)


def test_large_wrapper_forgets_rare_nodes(monkeypatch):
    monkeypatch.setattr(html_extract, "MOST_NODES", 60)
    folded = html_extract.Induction()
    for i in range(40):
        folded.add("h", html_extract.Page(f"<div class=main><p>text {i}</p></div>" + "".join(f"<div id=u{i}x{k}>{k}</div>" for k in range(10))))
    root = folded.roots["h"]
    assert len(root.below()) <= 80 and root.pages == 40 and root.children[0].pages == 40
    assert html_extract.extract(html_extract.Page("<div class=main><p>text 3</p></div><div id=u3x1>1</div>"), root) == "text 3"


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://a.NET/x", "http://net/", "http://net", "https://www.example.net/en/1?q#f", "http://example.net/de/", "http://m.example.com/de/x", "ftp://x.org/fr/", "http://notnet/", "x://y.net?a://b/"]
    bad = [f"http://spam{i}.casino.example/win/{i}" for i in range(40)]
    good = [f"http://site{i}.example/page/{i}" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls + bad + good)), "page_id long, url string")
    labelled = spark.createDataFrame([(u, True) for u in bad[:30]] + [(u, False) for u in good[:40]], "url string, blocked boolean")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, labelled).collect()}
    assert len(got) == len(urls + bad + good)
    for i, u in enumerate(urls + bad + good):
        host, path = parts(u)
        fit = [(r, v) for r, v in url_filter.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, "block" if u in bad else "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), u


def test_url_rules_are_pruned(spark):
    """Both verdicts are mined; superfluous, rare and unsure rules go; a rule may need four tokens."""
    rows = [(["a", "b", "n"], True)] * 10 + [(["b", "c"], False)] * 40 + [(["a"], True)] * 5 + [(["rare"], True)]
    four = [["p", "q", "r", "s"], ["p", "q", "r"], ["p", "q", "s"], ["p", "r", "s"], ["q", "r", "s"]]
    rows += [(t, i == 0) for i, t in enumerate(four) for _ in range(30)]
    found = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), min_support=0.004).collect()
    assert sorted((r["tokens"], r["label"]) for r in found if r["label"] == "block") == [(["a"], "block"), (["n"], "block"), (["p", "q", "r", "s"], "block")]
    assert (["c"], "allow") in [(r["tokens"], r["label"]) for r in found]
    n, bad = len(rows), 46
    assert {tuple(r["tokens"]): r["sure"] for r in found}[("n",)] == pytest.approx((10 + 4 * bad / n) / 14)


def test_empty_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op1_url_rules", "op7_main_text"):
        assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op5_minhash", "op6_language", "op8_exact", "op9_pii", "op10_repeats", "op2_packing", "op3_media_columns", "op4_sentencepiece"])
def test_empty_tables(spark, name, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_oracles(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, sf_dir)
        want = con.sql(sql).df()
        cols = sorted(want.columns)
        assert sorted(df.columns) == cols
        assert plain(df.select(*cols).collect()) == plain(want[cols].itertuples(index=False, name=None)), name


def plain(rows):
    return sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in rows)


def test_url_oracle_with_telling_labels(spark, sf_dir, tmp_path):
    """Labels that follow the host and the path: rules of one and of two tokens, in Spark and in SQL."""
    import duckdb

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").union(spark.createDataFrame([(9000 + i, f"http://s{i % 9}.{'spam' if i % 2 else 'fine'}.example/{'win' if i % 3 else 'page'}/{i}", None) for i in range(90)], "page_id long, url string, html string"))
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    labels = pages.selectExpr("page_id as doc_id", "1 as quality", "cast(url like '%spam%' and url like '%win%' or url like '%casino%' as int) as toxic")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for table in ("pages", "labels"):
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    df = queries.op1_url_rules(spark, str(tmp_path))
    want = con.sql(queries.ORACLE["op1_url_rules"]).df()
    cols = sorted(want.columns)
    got = df.select(*cols).collect()
    assert plain(got) == plain(want[cols].itertuples(index=False, name=None))
    assert {r["matched"] for r in got} >= {"h:spam p:win"} and {r["verdict"] for r in got} == {"allow", "block"}


def test_pipeline_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_shared_folder_is_needed_on_a_cluster():
    """Without a shared folder a cluster's session is refused; one process makes its own."""
    from tallyspark.llm.common import shared_dir

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(Session(spark_master=master))
    assert shared_dir(Session(spark_master="yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert shared_dir(Session(spark_master="local[2]")).startswith("file:")


def test_pipeline(spark, sf_dir):
    """The stages against plain versions, each on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets, columns = [docs], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        sets.append(stage(spark, sets[-1], sf_dir).cache())
        assert sets[-1].columns == columns
    ids = [{r["doc_id"]: r["text"] for r in s.collect()} for s in sets]
    assert ids[0].keys() - ids[1].keys() == {i for i, t in ids[0].items() if not any(map(str.isalpha, t or ""))}
    last = {t: i for i, t in sorted(ids[1].items())}
    assert ids[2].keys() == set(last.values())
    roots, _ = components(ids[2], 80)
    assert ids[3].keys() == {i for i, r in roots.items() if i == r}
    assert ids[4].keys() == ids[3].keys() and any(ids[4][i] != ids[3][i] for i in ids[4])
    pieces = corpus_pipeline.STAGES[-1][1](spark, sets[-1], sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == ids[4].keys()
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in pieces)
    arrays = packing.pack(sets[-1], queries.tokenizer_path("byte_bpe_50k.json"), with_ids="array").collect()
    assert sorted(np.array(r["ids"], "<u4").tobytes() for r in arrays) == sorted(bytes(r["ids"]) for r in pieces)
