"""Operators over texts against plain restatements, on the smallest tables and on awkward rows."""

import glob
import hashlib
import os
import random
import tempfile
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
from audience_lens.llm import (byte_bpe, chunk_bpe, jaccard_join, packing, quality, secrets, suffix_dedup, token_counts,
                               token_files)
from audience_lens.llm.common import Scratch

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i % 7000}" for i in range(20_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
SCHEMA = "doc_id long, text string, spans string, n int, rk long, part string, length double, kept int"


def rows_of(*texts):
    """Rows with extra columns whose names the operators use themselves."""
    return [(i, t, "x", 1, 2, "p", 0.5, 3) for i, t in enumerate(texts)]


AWKWARD = rows_of(
    None, "", " \t\n ", "one", "one two three four", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" end",
    LONG, LONG + " tail", "é́ ﬁ \U0001F600 <|endoftext|>x<|startoftext|>\x00\x1c\x85 end", "a  b\n\n\nc   ▁▁d ",
    f"start {PASSAGE} one end", f"{PASSAGE}", f"other {PASSAGE} words here", "x" * 450, "ab" * 300, "same text " * 40,
    "same text " * 40, "dup line\ndup line\n \ndup line", "PASSWORD:abcdefgh1 secret= short token=a", "AKIA" + "A1" * 8,
    "| a | b | c |" * 9, "don't  'LL we'Re 12 345,67 --- ...")
AWKWARD += [(None, "no id at all but words enough to be a document of its own kind", "x", 1, 2, "p", 0.5, 3),
            (None, None, "x", 1, 2, "p", 0.5, 3), AWKWARD[4], AWKWARD[10]]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def listed(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_text(df, out, make, *names):
    """Compares the multiset of (id, values) with the plain restatement of each text."""
    want = sorted(((d is None, d or 0, *make(t)) for d, t in listed(df)), key=repr)
    got = sorted(((r.doc_id is None, r.doc_id or 0, *(r[n] for n in names)) for r in out.collect()), key=repr)
    assert got == want


@pytest.fixture(params=["awkward", "documents"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_quality_counts(docs):
    out = quality.quality_verdicts(docs)
    by_text(docs, out, brute.quality, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert out.filter("base_failed AND kept").count() == 0


def test_quality_fit_is_expectation_maximisation(spark):
    """The fitted numbers equal those of the same rounds over single votes."""
    random.seed(2)
    rows = []
    for _ in range(400):
        good = random.random() < 0.8
        rows.append([(1 if good else -1) * (1 if random.random() < 0.85 else -1) if random.random() < 0.8 else 0
                     for _ in quality.RULES])
    df = spark.createDataFrame(rows, ", ".join(f"v_{r} int" for r in quality.RULES))
    share, good, bad = quality.fit(df)
    v = np.array(rows)
    s, g, b = 0.85, np.full(v.shape[1], 0.9), np.full(v.shape[1], 0.5)
    for _ in range(quality.ROUNDS):
        odds = np.where(v == 1, g / (1 - b), np.where(v == -1, (1 - g) / b, 1.0)).prod(axis=1) * s / (1 - s)
        p = odds / (1 + odds)
        s = np.clip(p.mean(), *quality.SHARE_BOUNDS)
        g = np.clip((((v == 1).T * p).sum(axis=1) + 1) / (((v != 0).T * p).sum(axis=1) + 2), *quality.GOOD_BOUNDS)
        b = np.clip((((v == -1).T * (1 - p)).sum(axis=1) + 1) / (((v != 0).T * (1 - p)).sum(axis=1) + 2), *quality.BAD_BOUNDS)
    assert np.allclose([share, *good.values(), *bad.values()], [s, *g, *b], atol=1e-5)


def test_quality_has_no_python(documents):
    plan = quality.quality_verdicts(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_keep_good_keeps_all_columns(awkward):
    out = quality.keep_good(awkward)
    assert out.schema == awkward.schema
    ids = {r.doc_id for r in out.collect()}
    assert ids >= {10, 11, 12} and not ids & {0, 1, 2, 3, 4, 6} and not out.filter("text IS NULL").count()


def test_token_files(documents):
    blocks, freq = token_files.write_files(documents, WORDS)
    out = {r.doc_id: r for r in token_files.read_files(blocks, freq).collect()}
    want = brute.token_file(listed(documents))
    assert {d: (r.start, r.n_tokens, r.ids_crc32) for d, r in out.items()} == want
    assert all(zlib.crc32(brute.packed(r.ids)) == r.ids_crc32 for r in out.values())


def test_token_files_awkward(awkward, empty):
    blocks, freq = token_files.write_files(awkward, WORDS)
    out = sorted(token_files.read_files(blocks, freq).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((d for d, _ in listed(awkward)), key=lambda d: (d is not None, d or 0))
    at, texts = 0, defaultdict(list)
    for d, t in listed(awkward):
        texts[d].append([*brute.ids_of("word_bpe_49k.json", t), 2])
    for r in out:
        assert r.start == at and r.ids in texts[r.doc_id]
        at += r.n_tokens
    assert token_files.read_files(*token_files.write_files(empty, WORDS)).count() == 0


def test_ans_blocks():
    rng = np.random.default_rng(3)
    for n in (1, 255, 256, 257, 40_000, 70_001):
        ids = np.minimum(rng.geometric(0.01, n), 999).astype(np.int64)
        own = token_files.Table.from_counts(np.bincount(np.append(ids, 2), minlength=1000))
        assert own.freq.sum() == 1 << token_files.SCALE_BITS
        frame = token_files.encode_block(ids, [5, None], [n - n // 3, n // 3], own, 2)
        docs, lengths, back = token_files.decode_block(frame, own)
        assert docs == [5, None] and lengths.tolist() == [n - n // 3, n // 3] and (back == ids).all()
        damaged = bytearray(frame)
        damaged[-1 if n > 1 else 60] ^= 1
        with pytest.raises(ValueError):
            token_files.decode_block(bytes(damaged), own)
    entropy = -(p := np.bincount(ids) / n)[p > 0] @ np.log2(p[p > 0]) * n / 8
    assert len(frame) < 1.1 * entropy + 8 * token_files.LANES * (n // 131_072 + 2)


def test_chunk_bpe(docs):
    by_text(docs, chunk_bpe.encode_digests(docs), lambda t: brute.byte_bpe(t or ""), "n_tokens", "ids_sha256", "decoded_sha256")


def test_chunk_bpe_reuses_chunks(empty):
    coder, text = chunk_bpe.Coder(), LONG * 2
    first = coder.text(text)
    held, hits = len(coder.memo), coder.hits
    assert coder.text(text) == first and len(coder.memo) == held and coder.hits > hits + held // 2
    assert first[1].decode() == text
    assert chunk_bpe.encode_documents(empty).count() == 0


def test_byte_bpe_equals_the_library():
    random.seed(5)
    parts = ["<|endoftext|>", " ", "\n", "'s", "é", "ab", "12", "...", " ", "　", "\U0001F600", "\r\n", "\x85", "ß"]
    for _ in range(500):
        text = "".join(random.choices(parts, k=random.randint(0, 40)))
        assert byte_bpe.ids_of(text).tolist() == brute.ids_of("byte_bpe_50k.json", text)
        assert np.frombuffer(chunk_bpe.Coder().text(text)[0], "<u4").tolist() == byte_bpe.ids_of(text).tolist()


def test_token_counts(docs, empty):
    out = token_counts.token_counts(docs, PIECES, limit=1000)
    by_text(docs, out, lambda t: (len((t or "").encode()), (n := brute.n_pieces(t)), n > 1000), "n_bytes", "n_tokens", "over_limit")
    assert token_counts.token_counts(empty, PIECES).count() == 0


def test_whole_pieces_are_single_tokens():
    whole = token_counts.whole_pieces(PIECES)
    assert len(whole) > 20_000
    for s in random.Random(1).sample(sorted(s for s in whole if s.startswith(" ") and s != " "), 500):
        assert len(brute.pieces().encode(s[1:])) == 1


def test_packing(docs, empty):
    out = [r.asDict() for r in packing.pack_documents(docs).collect()]
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.03 * sum(r["length"] for r in out) / 1024 + 1
    want = []
    for d, t in listed(docs):
        ids = [*brute.ids_of("byte_bpe_50k.json", t or ""), 2]
        head = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(head, len(ids), 1024)]):
            own = ids[a:head if a == 0 else a + 1024]
            want.append((repr(d), k, a, len(own), zlib.crc32(brute.packed(own))))
    assert sorted(want) == sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("capacity", [6, 31, 100, 1024])
def test_plan_fills_bins_without_gaps(capacity):
    rng = random.Random(capacity)
    for _ in range(30):
        counts = {s: rng.randint(0, rng.choice([2, 40])) for s in range(1, capacity + 1) if rng.random() < 0.5}
        slots, n_bins = packing.plan(counts, capacity)
        bins, by_size = defaultdict(list), defaultdict(list)
        for slot in slots:
            by_size[slot[0]].append(slot)
        for size, n in counts.items():
            ranges = by_size[size]
            for (_, rank, first, offset), end in zip(ranges, [*(x[1] for x in ranges[1:]), n]):
                for r in range(rank, end):
                    bins[first + r - rank].append((offset, size))
        assert len(bins) == n_bins and sum(map(len, bins.values())) == sum(counts.values())
        for own in bins.values():
            assert sum(3 * s > capacity for _, s in own) <= 2
            at = 0
            for offset, size in sorted(own):
                assert offset == at
                at += size
            assert at <= capacity


def test_jaccard_groups(documents):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(documents).collect()}
    assert out == brute.components(listed(documents))


def test_jaccard_awkward(awkward, empty):
    out = jaccard_join.jaccard_groups(awkward).collect()
    assert len(out) == awkward.count()
    plain = brute.components({d: t for d, t in listed(awkward) if d is not None}.items())
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == plain[r.doc_id]
    assert {r.component_id for r in out if r.doc_id is None} == {None}
    assert jaccard_join.jaccard_groups(empty).count() == 0
    one = jaccard_join.one_of_each_group(awkward)
    assert one.schema == awkward.schema
    ids = [r.doc_id for r in one.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({c for _, c in plain.values()})
    assert {0, 1, 2, 15} <= set(ids) and 16 not in ids


def test_jaccard_chains_and_hot_lists(spark, monkeypatch):
    """A chain links documents that aren't alike, lists longer than a row and a group of near copies."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    rows, chain = [], list(base)
    for i in range(40):
        rows.append((i, " ".join(chain)))
        at = rng.randrange(100)
        chain[at:at + 3] = [rng.choice(words) for _ in range(3)]
    for i in range(100, 260):
        near = list(base)
        near[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(near)))
    for i in range(300, 340):  # alike, but not enough
        rows.append((i, " ".join(base[:60] + [rng.choice(words) for _ in range(60)])))
    monkeypatch.setattr(jaccard_join, "LIST", 16)
    out = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute.components(rows)


def test_jaccard_stragglers(spark, monkeypatch):
    """Copies around the threshold: some link only with others than the pivots, through edits they share, some with
    shorter ones, some with nothing; they are told apart by a few pairs a document, not by all of them."""
    rng = random.Random(17)
    rows, pairs = [], []
    for g in range(3):
        base = [f"b{g}_{i}" for i in range(150)]
        places = rng.sample(range(2, 148), 14)
        for i in range(110):
            own = list(base)
            for at in rng.sample(places if i % 2 else range(150), rng.randrange(1, 9)):
                own[at] = f"e{at % 3}" if i % 3 else f"p{g}_{i}_{at}"  # an edit that others have too, or one of its own
            rows.append((1000 * g + i, " ".join(own[rng.randrange(25) if i % 5 == 0 else 0:])))
    rows += [(5000 + i, " ".join([f"b0_{k}" for k in range(30)] + [f"q{i}_{k}" for k in range(120)])) for i in range(60)]
    rng.shuffle(rows)
    whole = jaccard_join.linked

    def counted(some, *rest):
        pairs.append(some.count())
        return whole(some, *rest)

    monkeypatch.setattr(jaccard_join, "linked", counted)
    out = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    plain = brute.components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == plain
    assert len({c for _, c in plain.values()}) > 75
    assert len(pairs) > 3 and sum(pairs) < (170 * 169 + 2 * 110 * 109) / 2 / 3  # of all pairs that share a base


def test_shared_counts(spark, monkeypatch):
    """N-grams that another group has, of whole sets and of halves; those of full buckets are left out of both counts."""
    rng = np.random.default_rng(4)
    pool = jaccard_join.mix64(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    own = {i: np.unique(rng.choice(pool, 60)) for i in range(80)}
    group = {i: i // 5 for i in own}
    for bins, most in ((1, 1 << 30), (7, 1 << 30), (3, 4)):
        monkeypatch.setattr(jaccard_join, "BINS", bins)
        monkeypatch.setattr(jaccard_join, "USUAL", most)
        monkeypatch.setattr(jaccard_join, "COMMON", 0)
        bucket = {int(g): int(g >> np.uint64(64 - jaccard_join.BUCKET_BITS)) for g in pool}
        counts = np.zeros(1 << jaccard_join.BUCKET_BITS, np.int64)
        for x in own.values():
            np.add.at(counts, [bucket[int(g)] for g in x], 1)
        told = {i: {int(g) for g in x if counts[bucket[int(g)]] <= most} for i, x in own.items()}
        plain = {i: sum(any(g in told[k] for k in own if group[k] != group[i]) for g in told[i]) for i in own}
        rows = [(i, group[i], bytearray(x.tobytes()), len(told[i])) for i, x in own.items()]
        sets = spark.createDataFrame(rows, "rk long, c long, own binary, told long").repartition(3)
        out = {r.rk: r.own for r in jaccard_join.shared_counts(sets, counts).collect()}
        assert out == {i: n for i, n in plain.items() if n}
        rows = [(i, group[i], bytearray((np.array(sorted(told[i]), np.uint64) >> np.uint64(1)).astype(np.uint32).tobytes()),
                 len(told[i])) for i in own]
        sets = spark.createDataFrame(rows, "rk long, c long, own binary, told long").repartition(3)
        assert {r.rk: r.own for r in jaccard_join.shared_counts(sets, counts, half=True).collect()} == out
        assert most > 4 or 0 < sum(map(len, told.values())) < sum(map(len, own.values()))


def test_scratch_leaves_no_shuffle_files(spark):
    folder = spark.sparkContext.getConf().get("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()))
    files = lambda: set(glob.glob(f"{folder}/**/blockmgr-*/*/shuffle_*.data", recursive=True))
    before, scratch, until = files(), Scratch(), time.time() + 20
    out = scratch.saved(spark.range(5000).groupBy(F.expr("id % 997").alias("k")).count(), "counts")
    assert out.count() == 997
    scratch.saved(out.repartition(3, "k"), "dealt")
    while len(files() - before) > 1 and time.time() < until:  # the count may keep one of its own
        time.sleep(0.2)
    assert len(files() - before) <= 1
    scratch.clear()


def test_hashing_holds_little_at_a_time():
    """A worker's share of an executor's memory: a text of several MB is hashed by stretches, alike wherever they end."""
    text = " ".join(f"w{i * i % 70001}" for i in range(700_000)).encode()
    jaccard_join._powers.cache_clear()
    tracemalloc.start()
    places, hashes = jaccard_join.word_hashes(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - places.nbytes - hashes.nbytes < 70e6
    assert (places[-1], hashes[-1]) == (text.rindex(b" ") + 1, jaccard_join.word_hashes(text[text.rindex(b" ") + 1:])[1][0])


def test_one_of_each_group_without_usable_ids(spark):
    """Groups are told apart by themselves: ids may be null or stand for several texts."""
    words = lambda s, n=40: [f"{s}{i}" for i in range(n)]
    near = lambda s: " ".join([*words(s), "more"])
    text = {s: " ".join(words(s)) for s in "abcdefgh"}
    rows = [(None, text["a"]), (None, text["b"]), (7, text["c"]), (7, text["d"]),  # unlinked, of equal size
            (None, text["e"]), (None, near("e")), (8, text["f"]), (8, near("f")),  # near copies, not of equal size
            (None, text["g"]), (9, near("g")), (5, text["h"]), (4, near("h")), (4, near("h")),
            (None, ""), (None, None), (3, ""), (2, "")]
    out = jaccard_join.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == 12
    for s, ids in {"a": {None}, "b": {None}, "c": {7}, "d": {7}, "e": {None}, "f": {8}, "g": {9}, "h": {4}}.items():
        own = [d for d, t in got if t and t.startswith(f"{s}0 ")]
        assert len(own) == 1 and set(own) == ids
    assert {(d, t) for d, t in got if not t} == {(None, ""), (None, None), (3, ""), (2, "")}


def digests(df, **options):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                   for r in suffix_dedup.dedup_digests(df, **options).collect()))


def plain_digests(rows):
    return sorted((d is None, d or 0, n, gone, spans, hashlib.sha256(kept).hexdigest())
                  for (d, _), (n, gone, spans, kept) in zip(rows, brute.dedup([t for _, t in rows])))


def test_suffix_dedup(docs, empty):
    assert digests(docs) == plain_digests(listed(docs))
    assert digests(empty) == []


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_of_shared_passages(spark, hot):
    """Passages at random offsets, overlapping repeats and low-entropy texts; also with the way for
    leading strings that are too frequent for one task."""
    rng = random.Random(hot)
    passages = ["".join(rng.choices("abcdefgh ", k=rng.choice([199, 200, 201, 260, 900]))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.choice([0, 0, 30]):] if rng.random() < 0.5 else
                 "".join(rng.choices("abcdefgh é", k=rng.randint(0, 300))) for _ in range(rng.randint(1, 5))]
        rows.append((i, "".join(parts)))
    rows += [(100, "ab" * 150), (101, "a" * 199), (102, "a" * 200), (103, "abc" * 100), (104, "xyzé" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert digests(df, hot=hot) == plain_digests(rows)


def test_without_repeats_keeps_rows_and_columns(awkward):
    out = suffix_dedup.without_repeats(awkward)
    assert out.schema == awkward.schema and out.count() == awkward.count()
    kept = {d: b.decode(errors="ignore") for (d, _), (*_, b) in zip(listed(awkward), brute.dedup([t for _, t in listed(awkward)]))}
    for r in out.filter("doc_id IS NOT NULL AND text IS NOT NULL").collect():
        assert r.text == kept[r.doc_id]


def test_secret_scan_base(docs, empty):
    def plain(text):
        spans = brute.secrets(text)
        kinds = [k for k, _, _ in spans]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        return (*(kinds.count(k) for k in secrets.KINDS), hashlib.sha256(joined.encode()).hexdigest())

    out = secrets.scan(docs)
    by_text(docs, out, plain, "n_assign", "n_access", "n_hex", "base_sha256")
    assert secrets.scan(empty).count() == 0


def test_secret_formats_are_inferred(spark):
    rng = random.Random(4)
    key = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    plain = ["internationalization", "misunderstandings.", "2024-01-31T12:00", "incomprehensible", "example.org/page"]
    rows = [(i, f"some words {rng.choice(plain)}{i} then token={key()} and {rng.choice(plain)}") for i in range(200)]
    loose = "-".join([key()[:20], key()[20:]])
    rows += [(1000, f"nothing but {loose} here"), (1001, "uncharacteristically long words, incomprehensibly so")]
    out = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1000].n_format == 1 and out[1000].spans == f"format:12:{12 + len(loose)}"
    assert sum(r.n_format for d, r in out.items() if d != 1000) == 0
    assert all(r.n_assign == 1 and r.n_hex == 1 for d, r in out.items() if d < 1000)


@pytest.mark.parametrize("n", [4, 200, 2000])
def test_frequent_unknown_formats_are_all_found(spark, n):
    """Credentials no base pattern names are found however many of the runs they are."""
    rng = random.Random(n)
    key = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    rows = [(i, f"incomprehensible WORDSINCAPITALLETTERS 4179672074533673 then token={key(40)}") for i in range(200)]
    rows += [(1000 + i, f"nothing but {key(20)}-{key(20)} uncharacteristically") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = secrets.scan(df).collect()
    assert all(r.spans == "format:12:53" if r.doc_id >= 1000 else r.n_format == 0 for r in out)
    assert {r.text for r in secrets.without_secrets(df).collect() if r.doc_id >= 1000} == {
        "nothing but [secret] uncharacteristically"}


def test_automaton_generalises():
    strings = ["0a" * n for n in range(2, 30)] * 3
    own = secrets.Automaton(strings)
    assert len(own.red) < 12
    assert own.log_likelihood("0a" * 20) > own.log_likelihood("a0" * 20) + 3


def test_automaton_keeps_lengths():
    """Strings of one length give a chain of states, whose likelihood is the product of shares by place; a string of
    another length is less likely by character."""
    rng = random.Random(9)
    learnt = ["".join(rng.choices("0000000000aaaaaa", k=40)) for _ in range(600)]
    own = secrets.Automaton(learnt)
    assert len(own.red) == 41
    for s in learnt[:20]:
        shares = [(sum(t[i] == c for t in learnt) + 0.02) / 601 for i, c in enumerate(s)] + [600.02 / 601]
        assert abs(own.log_likelihood(s) - float(np.log(shares).sum())) < 1e-9
        for other in (s[:20], s[:39], s + s[:1], s + s):
            assert own.log_likelihood(s) / 41 > own.log_likelihood(other) / (len(other) + 1) + 0.1


def test_candidates_are_what_base_spans_leave():
    found = lambda text: [r for _, _, r in secrets.candidates(text, secrets.base_spans(text))]
    digits = "0123456789abcdef" * 2
    assert found("eightchr seven77") == ["eightchr"] and found("sevench,abcdefgh") == ["abcdefgh"]
    assert found("username=QWERTYUIOP") == ["username", "QWERTYUIOP"] and found("cGFkZGVkIQ== x") == ["cGFkZGVkIQ=="]
    assert found(f"GHJKLMNPQR{digits}XYZXYZXYZ") == ["GHJKLMNPQR", "XYZXYZXYZ"] and found(f"x{digits}y") == []
    assert found(f"token=WWWWWWWW={digits}=YYYYYYYY ZZZZZZZZ") == ["ZZZZZZZZ"]
    text = f"QWERTYUIOP {digits} abcdefgh=ABCDEFGHI"
    assert all(text[a:b] == r for a, b, r in secrets.candidates(text, secrets.base_spans(text)))
    long = "Q" * 300_000
    assert found(long) == [long] and secrets.candidates("", []) == []


def test_rest_beside_a_base_span_is_scored(spark):
    rng = random.Random(3)
    key = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    rows = [(i, f"then token={key(16)} and") for i in range(200)]
    rows += [(1000, f"see {key(32)}/0a1b2c3d4e5f6071 there"), (1001, "see 0a1b2c3d4e5f6071 there"), (1002, "header=0a1b2c3d4e5f6071")]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] == "hex:4:36,format:36:53" and got[1001] == "format:4:20" and got[1002] == "format:7:23"


def test_masking(awkward):
    out = secrets.without_secrets(awkward)
    assert out.schema == awkward.schema and out.count() == awkward.count()
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[5] == "[secret]\" end" and got[0] is None and got[3] == "one"
    assert secrets.masked("abcdef", [(1, 3), (2, 4)], "*") == "a*ef"
