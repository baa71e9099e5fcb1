"""WARC archives, Merkle manifest and conversation repair against plain restatements and on awkward rows."""

import base64
import glob
import gzip
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from audience_lens.llm import conversations as cv
from audience_lens.llm import merkle, warc
from audience_lens.llm.common import lookup, saved
from audience_lens.llm.registry import ORACLE_SQL, QUERIES
from compare import compare, duck


# ---- lookups ----------------------------------------------------------------------------


def test_lookup_keeps_every_row_with_hot_and_missing_keys(spark):
    keys = ["hot"] * 3000 + [None] * 500 + [f"k{i}" for i in range(700)]
    rows = saved(spark.createDataFrame(list(enumerate(keys)), "n long, k string").repartition(5), "rows")
    values = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 700, 2)], "k string, v int")
    got = {r.n: r.v for r in lookup(rows, "k", values, "n").collect()}
    want = {n: 1 if k == "hot" else int(k[1:]) if k and int(k[1:]) % 2 == 0 else None for n, k in enumerate(keys)}
    assert got == want


# ---- WARC -------------------------------------------------------------------------------

LONG = "<p>" + "long words here " * 60_000 + "</p>"
PAGES = [
    (5, "http://a.example/x?y=1#z", "<p>same</p>", "u"), (3, "https://b.example", "<p>same</p>", "u"), (9, None, "<p>same</p>", "u"),
    (None, "http://c.example/", "<p>same</p>", "u"), (1, "http://d.example/\r\nWARC-Type: response", "", "u"), (2, "", None, "u"),
    (4, "not a url", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n", "u"), (6, "http://e.example/é", "ends so\r\n", "u"),
    (7, "http://f.example/", "é\U0001F600\x00\x1c\r\r\n\r\n\r\n", "u"), (8, "http://g.example/", LONG, "u"), (10, "http://h.example/", LONG, "u"),
    (11, "http://i.example/", "\r\n", "u"), (12, "http://i.example/", "\r\n\r\n", "u"), (13, "http://i.example/", "\n", "u"),
    (14, "http://j.example/", "<p>again</p>", "u"), (14, "http://j.example/", "<p>again</p>", "u"), (None, None, None, None)]
PAGE = "page_id long, url string, html string, digest string"


def archives(spark, tmp_path, pages, **options):
    warc.write_archives(pages, str(tmp_path / "warc"), **options)
    return saved(warc.read_records(spark, str(tmp_path / "warc")), "records")


def plainly(folder):
    """Records by a reader that knows nothing but lengths: (headers, block)."""
    out = []
    for name in glob.glob(f"{folder}/*.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            headers = [tuple(line.split(": ", 1)) for line in lines]
            n = int(dict(headers)["Content-Length"])
            assert version == "WARC/1.1" and rest[n:n + 4] == b"\r\n\r\n" and len(headers) == len(dict(headers))
            out.append((dict(headers), rest[:n]))
            data = rest[n + 4:]
    return out


def test_archives_are_what_the_format_says(spark, tmp_path):
    records = archives(spark, tmp_path, spark.createDataFrame(PAGES, PAGE).repartition(3))
    plain = plainly(tmp_path / "warc")
    kinds = [h["WARC-Type"] for h, _ in plain]
    assert kinds.count("request") == kinds.count("metadata") == kinds.count("response") + kinds.count("revisit") == len(PAGES)
    assert len({h["WARC-Record-ID"] for h, _ in plain}) == 3 * len(PAGES)
    bodies = {h["WARC-Record-ID"]: block.partition(b"\r\n\r\n")[2] for h, block in plain if h["WARC-Type"] == "response"}
    for h, block in plain:
        if h["WARC-Type"] == "response":
            assert h["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bodies[h["WARC-Record-ID"]]).digest()).decode()
        elif h["WARC-Type"] == "revisit":
            body = bodies[h["WARC-Refers-To"]]
            assert f"Content-Length: {len(body)}\r\n".encode() in block and block.endswith(b"\r\n\r\n")
    got = sorted((r.record_id, r.kind, bytes(r.payload), r.intact) for r in records.filter("kind <> 'metadata'").collect())
    want = sorted((h["WARC-Record-ID"], h["WARC-Type"], block.partition(b"\r\n\r\n")[2], True) for h, block in plain if h["WARC-Type"] != "metadata")
    assert got == want


def test_captures_return_every_page_with_its_payload(spark, tmp_path):
    captures = warc.assemble(archives(spark, tmp_path, spark.createDataFrame(PAGES, PAGE).repartition(3)))
    rows = captures.collect()
    assert len(rows) == len(PAGES) and all(r.n_requests == r.n_metadata == 1 and r.response and r.request and r.metadata for r in rows)
    body = {r.capture_id: bytes(r.response.payload) for r in rows if r.response.kind == "response"}

    def page(r):
        text = body[r.capture_id if r.response.kind == "response" else r.response.refers_to].decode()
        number = dict(r.metadata.fields).get("page-id")
        return (-1 if number is None else int(number), r.uri or "", text)

    def told(url):
        return (url or "").replace("\r", "%0D").replace("\n", "%0A")

    assert sorted(map(page, rows)) == sorted((-1 if i is None else i, told(u), h or "") for i, u, h, _ in PAGES)
    assert sum(r.response.kind == "response" for r in rows) == len({h or "" for _, _, h, _ in PAGES})
    same = [r for r in rows if r.response.payload_bytes == 11]
    assert {dict(r.metadata.fields).get("page-id") for r in same if r.response.kind == "response"} == {"3"}


def test_small_payloads_may_all_be_responses(spark, tmp_path):
    records = archives(spark, tmp_path, spark.createDataFrame(PAGES, PAGE), least=12)
    assert sorted(r.payload_bytes for r in records.filter("kind = 'revisit'").collect()) == [12, len(LONG)]


def test_no_pages_no_records(spark, tmp_path):
    records = archives(spark, tmp_path, spark.createDataFrame([], PAGE))
    assert records.count() == 0 and warc.assemble(records).count() == 0


def written(spark, tmp_path, data):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data[:9]) + gzip.compress(data[9:]))
    return warc.read_records(spark, str(tmp_path))


def made(kind, own, body=b"x", **headers):
    lines = "".join(f"{n.replace('_', '-')}: {v}\r\n" for n, v in headers.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {own}\r\n{lines}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_damaged_archives(spark, tmp_path):
    good = made("response", "a", b"abc", WARC_Payload_Digest="sha1:" + "A" * 32)
    assert [r.intact for r in written(spark, tmp_path, good).collect()] == [False]
    for data, fault in ((good[:-5], "inside a record"), (good + b"rubbish\r\n\r\n", "no record begins"), (good.replace(b"Length: 3", b"Length: x"), "without a length")):
        with pytest.raises(Exception, match=fault):
            written(spark, tmp_path, data).collect()


def test_links_in_any_direction_and_over_a_record(spark, tmp_path):
    data = b"".join([
        made("warcinfo", "w"), made("response", "r1"), made("request", "q1", WARC_Concurrent_To="r1"), made("metadata", "m1", WARC_Concurrent_To="q1"),
        made("request", "q2"), made("response", "r2", WARC_Concurrent_To="q2"), made("metadata", "m2", WARC_Concurrent_To="r2"), made("metadata", "m0", WARC_Concurrent_To="r2"),
        made("request", "q3", WARC_Concurrent_To="nowhere"), made("response", "r4"), made("response", "r1"),
        made("request", "q5") .replace(b"Content", b"WARC-Concurrent-To: r9\r\nWARC-Concurrent-To: r4\r\nContent")])
    captures = warc.assemble(saved(written(spark, tmp_path, data), "records"))
    got = {(r.capture_id, r.response and r.response.record_id, r.request and r.request.record_id, r.metadata and r.metadata.record_id,
            r.n_requests, r.n_metadata) for r in captures.collect()}
    assert got == {("r1", "r1", "q1", "m1", 1, 1), ("r2", "r2", "q2", "m0", 1, 2), ("q3", None, "q3", None, 1, 0), ("r4", "r4", "q5", None, 1, 0)}


# ---- Merkle manifest --------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i & ~1:(i & ~1) + 2]
        out.append((i & 1, [run[1 - (i & 1)]] if len(run) == 2 else []))
        i >>= 1
    return out


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text)."""
    def leaf(*values):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for d, source, lang, n, text in rows:
        hit = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        groups.setdefault(lang, []).append(((d is not None, d or 0), leaf(d, source, lang, n, text), d, leaf(d, source, lang, n + hit if hit else n, text)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: up([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in names}
    top = up([trees[g][-1][0] for g in names])
    out = []
    for rank, g in enumerate(names):
        for i, (_, own, d, seen) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            path, node = siblings(trees[g], i) + siblings(top, rank), seen
            for right, other in path:
                node = h("".join(other + [node] if right else [node] + other))
            out.append((d, own, trees[g][-1][0], top[-1][0], h("".join(x for _, o in path for x in o)), node, node == top[-1][0]))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digests(rows, span):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    seen = merkle.leaf_digest("doc_id", "source", "lang", F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")), "text")
    out = merkle.manifest(rows, "lang", "doc_id", merkle.leaf_digest("doc_id", "source", "lang", "n_chars", "text"), seen, span=span)
    for r in out.collect():
        assert merkle.fold(r.leaf, r.proof.split(",") if r.proof else []) == r.root
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=repr)


@pytest.mark.parametrize("span, n", [(1, 1), (1, 2), (2, 5), (2, 17), (3, 64), (3, 65), (12, 33)])
def test_manifest_of_any_size_and_span(spark, span, n):
    random.seed(n)
    rows = [(random.choice([i, i, None, 7]), random.choice([None, "s"]), random.choice([None, "", "en", "en", "en", "é", "z"]),
             random.choice([None, i]), random.choice([None, "", "text é", "x" * i])) for i in range(n)]
    rows += rows[:2]
    df = spark.createDataFrame([(*r, "t", 1, "p") for r in rows],
                               "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, h string").repartition(3)
    assert digests(df, span) == sorted(plain_manifest(rows), key=repr)


def test_manifest_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = sorted(plain_manifest(rows), key=repr)
    assert digests(docs, 3) == want
    got = QUERIES["op12_merkle_manifest"](spark, sf_dir)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == want
    assert 0 < got.filter("NOT verified").count() < len(want) / 4


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(df, "lang", "doc_id", merkle.leaf_digest("doc_id"))
    assert out.count() == 0 and set(COLUMNS) < set(out.columns)


def test_many_equal_rows_spread_over_superblocks(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("en").alias("lang"), F.lit("x").alias("text"))
    out = merkle.manifest(df, "lang", "doc_id", merkle.leaf_digest("text"), span=4)
    assert out.agg(F.count_if("verified"), F.count_distinct("root")).first()[:] == (3000, 1)
    assert out.select("proof").distinct().count() > 1


# ---- conversations ----------------------------------------------------------------------

GOOD = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, audit, digest) by trying every sequence of edits with at most two insertions in a place."""
    fills = [[("I" * n, x) for x in map("".join, itertools.product("ua", repeat=n))] for n in range(3)]
    fills = [f for some in fills for f in some]
    best = None
    for inserted in itertools.product(fills, repeat=len(rows) + 1):
        ways = [("DKRR", f) for f in faults(rows)]
        for chosen in itertools.product(range(4), repeat=len(rows)):
            cost = 3 * sum(len(i[0]) for i in inserted)
            audit, out = inserted[0][0], [(x, "") for x in inserted[0][1]]
            for (role, text), c, (letters, fault), (more, made) in zip(rows, chosen, ways, inserted[1:]):
                if c and fault in (1, 2):
                    break
                audit += letters[c] + more
                cost += (4, 0, 3, 3)[c] + 3 * (c > 0 and fault == 3)
                out += [] if c == 0 else [((role, "user", "assistant")[c - 1], text)]
                out += [(x, "") for x in made]
            else:
                if (best is None or (cost, audit) < best[:2]) and GOOD.fullmatch("".join((r[:1] or "?") for r, _ in out)):
                    names = {"u": "user", "a": "assistant"}
                    best = (cost, audit, h("\n".join(f"{names.get(r, r)}:{t}" for r, t in out)))
    return best


def streamed(rows, held=1000):
    one = cv.Conversation("k", held)
    spilled = []
    for i, ((role, text), fault) in enumerate(zip(rows, faults(rows))):
        one.add(str(i), role, text, fault)
        if one.full():
            spilled.append(one.spill())
    return one.end(), spilled


def test_repair_is_cheapest_and_least_by_exhaustion():
    random.seed(4)
    texts = ["Yes.", "No", "", "Well. ", "Yes.", "ok!"]
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2):
        rows = [(random.choice(["user", "assistant", "system", "tool", "", "user"]), random.choice(texts)) for _ in range(n)]
        end, _ = streamed(rows)
        assert (end[7], end[8], end[9]) == exhaustive(rows), rows


def by_strings(rows):
    """The same by whole strings: every state keeps its cost, edit string and lines."""
    names = {"u": "user", "a": "assistant"}
    follow, after = {"": "su", "s": "u", "u": "a", "a": "u"}, {"": "", "s": "s", "u": "u", "a": "a"}

    def filled(states):
        out = dict(states)
        for _ in range(2):
            for last, (cost, audit, lines) in list(out.items()):
                for x in follow[last].replace("s", ""):
                    way = (cost + 3, audit + "I", [*lines, f"{names[x]}:"])
                    if x not in out or way < out[x]:
                        out[x] = way
        return out

    states = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults(rows)):
        new = {}
        for last, (cost, audit, lines) in filled(states).items():
            ways = [(last, (cost + 4, audit + "D", lines))]
            if fault not in (1, 2):
                cut = 3 * (fault == 3)
                if role[:1] and role[:1] in follow[last]:
                    ways.append((role[:1], (cost + cut, audit + "K", [*lines, f"{role}:{text}"])))
                ways += [(x, (cost + cut + 3, audit + "R", [*lines, f"{names[x]}:{text}"])) for x in follow[last] if x in names]
            for state, way in ways:
                if state not in new or way < new[state]:
                    new[state] = way
        states = new
    cost, audit, lines = min(way for state, way in filled(states).items() if state in ("", "a"))
    return cost, audit, h("\n".join(lines))


def test_repair_of_longer_conversations_with_spilled_ways_back():
    random.seed(5)
    for n in range(4, 60):
        rows = [(random.choice(["user", "assistant", "user", "assistant", "system", "tool"]), random.choice(["a.", "b", "", f"c{i}!", f"d{i}."]))
                for i in range(n)]
        end, _ = streamed(rows)
        assert (end[7], end[8], end[9]) == by_strings(rows)
        end, spilled = streamed(rows, held=4)
        parts = [*spilled, end]
        whole = list(cv._traced(iter([cv._frame(parts[::-1])])))[0].iloc[0]
        assert (int(whole["cost"]), whole["audit"], whole["repaired_sha256"]) == by_strings(rows)


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    out = {c: (0, 0, 0, 0, 0, 0, "", h("")) for c in {r[0] for r in rows}}
    left = {}
    for c, *rest in damage(rows):
        left.setdefault(c, []).append(rest)
    for c, some in left.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in some if t is not None]
        pairs = [(r, x) for _, r, x in some]
        kinds = faults(pairs)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, digest = by_strings(pairs)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, kinds.count(1), kinds.count(2), kinds.count(3), illegal, cost, audit, digest)
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(out):
    rows = out.collect()
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in rows}
    assert len(got) == len(rows)
    return got


def conversations(spark):
    random.seed(6)
    rows = [(random.choice([None, 1, 2, 2 ** 62 + 1, -5, 7, 7, 7]), random.choice([None, i // 2, i, 2 ** 60]),
             random.choice([None, "", "user", "assistant", "system", "sÿ", "Assistant", "user"]),
             random.choice([None, "", " \t", "Fine.", "Fine", f"Is it {i}?", "é\U0001F600!", "　", "two\nlines.\r\n", "x" * 5000])) for i in range(120)]
    rows += rows[:10] + [(100 + i, 0, "user", "only this.") for i in range(60)]
    return rows, spark.createDataFrame([(*r, "k", True, "f") for r in rows],
                                       "conv_id long, turn long, role string, text string, key string, gone boolean, fault string").repartition(4)


@pytest.mark.parametrize("held", [1, 3, 1 << 18])
def test_repair_of_awkward_rows(spark, held):
    rows, df = conversations(spark)
    assert repaired(cv.repair(cv.damaged(df), gone=F.col("gone"), held=held)) == plain_repair(rows)


def test_repair_of_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(QUERIES["op13_conversation_repair"](spark, sf_dir)) == plain_repair(rows)


def test_repair_of_nothing_and_without_damage(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert cv.repair(spark.createDataFrame([], schema)).count() == 0
    row = cv.repair(spark.createDataFrame([("a", 1, "user", "Hello."), ("a", 3, "user", "Bye.")], schema)).first()
    assert (row.conv_id, row.gaps, row.illegal, row.cost, row.audit, row.n_rows) == ("a", 1, 1, 3, "KR", 2)


def test_conversations_are_dealt_once(spark, sf_dir):
    df = cv._with_faults(spark.createDataFrame([("a", False, 1, "user", "x")], "key string, gone boolean, turn_number long, role string, text string")
                      .repartition("key")).sortWithinPartitions("key", "turn_number")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["op11_warc", "op12_merkle_manifest"])
def test_twins(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE_SQL[name]) is None
