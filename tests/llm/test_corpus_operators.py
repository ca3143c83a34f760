"""Archives, near-duplicates, lines, mixing, decontamination and top-k against brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import components, decontamination, line_dedup, mixing, set_join, simhash, topk, warc
from keyloom.llm.common import table
from keyloom.llm.queries import op6_mixing, op8_decontamination

SF = "/root/testdata/sf0.001"

# archives


def expected_pages(rows, least=0):
    groups = {}
    for page, _, html in rows:
        groups.setdefault(html or "", []).append(page)
    out = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p in groups[html or ""] if p is not None]
        first = min(ids) if ids and len(data) >= least else None
        revisit = first is not None and page != first
        out[page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


def captured(spark, pages, **options):
    captures, index, folder = warc.archive(spark, pages, **options)
    found = warc.lookup(captures.select(F.col("key").alias("prefix")), index, folder)
    return captures, index, folder, warc.read_records(found, folder, payload=True)


def test_pages_come_back_from_the_archives(spark, frame, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, f"http://www.h{i % 4}.example.com/p/{i % 7}?q={i}", f"<p>page {i % 9}</p>") for i in range(40)]
    rows += [(50, None, None), (51, "", ""), (52, "not a url [", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (53, "http://a\r\nb: c", "ü" * 70_000)]
    rows += [(54, "http://x.org", "<p>page 1</p>"), (54, "http://x.org", "<p>page 1</p>"), (None, "http://x.org", "<p>page 1</p>"), (None, "http://x.org", "alone")]
    pages = frame([(*r, "x") for r in rows], "page_id long, url string, html string, key string")
    captures, index, folder, records = captured(spark, pages, parts=4)
    got = records.collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected_pages(rows)
    assert {r["page_id"]: r["html"] for r in got if r["record_type"] == "response" and r["page_id"]}[53] == "ü" * 70_000
    assert index.count() > 1

    asked = [warc.url_key("https://H1.example.com:443/p/1/?q=1") + " ", "com,example,h2)", "nowhere", None]
    found = warc.lookup(spark.createDataFrame([(x,) for x in asked], "prefix string"), index, folder).collect()
    keys = [r["key"] for r in captures.collect()]
    assert Counter((r["prefix"], r["key"]) for r in found) == Counter((p, k) for p in asked if p for k in keys if k.startswith(p))


def test_small_payloads_are_never_revisited(spark, frame):
    rows = [(1, "a.org", "ab"), (2, "a.org", "ab"), (3, "a.org", "abcdef"), (4, "b.org", "abcdef")]
    records = captured(spark, frame(rows, "page_id long, url string, html string"), least_bytes=3)[3]
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records.collect()) == expected_pages(rows, 3)


def test_no_pages_give_an_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert captured(spark, pages)[3].count() == 0


def test_block_search_reads_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    captures = spark.range(1000).select(F.format_string("k%06d", "id").alias("key"), F.lit("f").alias("file"), F.col("id").alias("offset"), F.lit(1).cast("long").alias("length"))
    index = warc.build_index(captures, f"file://{tmp_path}/index", 1)
    row = index.first()
    store, base = warc.filesystem(f"file:{tmp_path}/index")
    part = warc.Part(store, f"{base}/{row['name']}", row["directory"], row["size"])
    assert [c[2] for c in part.captures("k000777")] == ["777"] and part.reads <= 2
    assert len(list(part.captures("k0000"))) == 100 and not list(part.captures("j")) and not list(part.captures("z"))


@pytest.mark.parametrize("url, key", [
    ("http://WWW.Example.com/A/?b=C#d", "com,example)/a?b=c"), ("example.com", "com,example)/"), ("https://a.b.co:8080/x y", "co,b,a:8080)/x%20y"),
    ("http://10.0.0.1/x", "10.0.0.1)/x"), (None, "-"), ("", "-"), ("http://[::1]/", "::1)/"),
])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


# components and fingerprints


def grouped(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, frame, shape):
    rng = random.Random(5)
    pairs = {"chain": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(60)], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], "none": []}[shape]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == grouped([p for p in pairs if p[0] != p[1]], nodes)


def slow_fingerprint(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower()) if text else []
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "A", "a", "a b", "É b C", "x y z q", *(" ".join(rng.choice("ab cd Ef gh ij".split()) for _ in range(n)) for n in (3, 4, 50, 301))]
    monkeypatch.setattr(simhash, "AT_ONCE", 16)
    for n in (3, 5):
        assert [simhash.fingerprint(t, n) for t in texts] == [slow_fingerprint(t, n) for t in texts]


@pytest.mark.parametrize("bucket", [2, 4096])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    values = set()
    for _ in range(25):
        center = rng.getrandbits(64)
        values.add(center)
        for _ in range(10):
            x = center
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values |= {0, 1, 7, 15, 2**64 - 1}
    signed = [(v - 2**64 if v >> 63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in found]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    assert grouped(pairs, values) == grouped(near, values)


def near_groups(rows, n):
    fps = [slow_fingerprint(t, n) for _, t in rows]
    at = grouped([(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], range(len(rows)))
    return fps, at


ODD_TEXTS = [(3, None), (4, ""), (None, ""), (5, "one two three four"), (5, "one two three four"), (None, "one two three four"), (9, "long word " * 40_000)]


def test_near_duplicates_with_odd_rows(spark, frame):
    given = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").limit(60).collect()]
    rows = [(None if i is None else i + 1000, t) for i, t in ODD_TEXTS] + given
    docs = frame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string")
    out = simhash.near_duplicates(docs)
    fps, at = near_groups(rows, 3)
    least = {}
    for (i, _), g in zip(rows, at.values(), strict=True):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    want = Counter((i, f"{fp:016x}", least[at[k]]) for k, ((i, _), fp) in enumerate(zip(rows, fps, strict=True)))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out.collect()) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_first_of_each_group_keeps_columns(spark, frame):
    rows = [*ODD_TEXTS, (1, "one two three four"), (2, "one two three five")]
    docs = frame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string")
    out = simhash.first_of_each_group(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(3, None), (4, ""), (None, ""), (1, "one two three four"), (2, "one two three five"), (9, "long word " * 40_000)])
    assert simhash.first_of_each_group(docs.limit(0)).count() == 0


def shingles_of(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


@pytest.mark.parametrize("local", [4, 1])
def test_first_of_each_group_equals_brute_force_jaccard(spark, frame, monkeypatch, local):
    monkeypatch.setattr(set_join, "LOCAL", local)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=25)
    texts = [t for i in range(30) if (t := rng.choices(words, k=rng.choice([3, 100, 200, 400])) + passage * (i % 2))]
    for base in texts[:20]:
        for changed in (1, 2, 3, 4):
            copy = list(base)
            for _ in range(changed):
                copy[rng.randrange(len(copy))] = "new"
            texts.append(copy + rng.choices(words, k=rng.choice([0, 0, 9])))
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [shingles_of(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    at = grouped(pairs, range(len(rows)))
    first = {}
    for k in range(len(rows)):
        first.setdefault(at[k], k)
    assert len(pairs) > 40
    got = simhash.first_of_each_group(frame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(first.values())


# lines


def slow_removals(rows, t=0.8):
    """Line numbers to remove per row of (id, text), in the order given."""
    earlier, out = [], []
    for _, text in rows:
        gone = []
        for n, line in enumerate((text or "").encode().split(b"\n")):
            words = frozenset(re.findall(rb"[^\x20\x09-\x0D]+", line.lower()))
            if words and any(len(words & e) * (1 + t) >= t * (len(words) + len(e)) - 1e-9 for e in earlier):
                gone.append(n)
            if words:
                earlier.append(words)
        out.append(gone)
    return out


def varied_lines(seed, docs=60):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(400)]
    bases = [[rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 14, 30, 90]))] for _ in range(40)]
    rows = []
    for i in range(docs):
        lines = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                line[rng.randrange(len(line))] = rng.choice(common + rare)
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append((i, rng.choice(["\n", "\n\n"]).join(lines)))
    return rows


@pytest.mark.parametrize("hot, first", [(10**9, 8), (5, 8), (0, 1), (30, 1)])
def test_line_dedup_equals_brute_force(spark, frame, hot, first):
    rows = varied_lines(hot % 97)
    out = line_dedup.deduplicated(frame(rows, "doc_id long, text string"), hot=hot, first=first).collect()
    want = dict(zip((i for i, _ in rows), slow_removals(rows), strict=True))
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        assert [x["line"] for x in r["removed"]] == want[r["doc_id"]]
        lines = texts[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for n, x in enumerate(lines) if n not in want[r["doc_id"]])
        assert r["n_lines"] == sum(bool(x.split()) for x in lines) and r["n_removed"] == len(want[r["doc_id"]])
        for x in r["removed"]:
            assert (x["like_oid"], x["like_line"]) < (r["doc_id"], x["line"])


def test_many_candidates_in_small_pieces(spark, frame, monkeypatch):
    monkeypatch.setattr(line_dedup, "PAIRS", 64)
    monkeypatch.setattr(line_dedup, "CHUNK", 200)
    monkeypatch.setattr(line_dedup, "ROWS", 100)
    rows = [(i, "\n".join(f"a b c d e f g h i j k l m n x{(i * 7 + k) % 23} y{(i + k) % 5}" for k in range(6))) for i in range(30)]
    out = line_dedup.deduplicated(frame(rows, "doc_id long, text string"), first=2).collect()
    want = dict(zip((i for i, _ in rows), slow_removals(rows), strict=True))
    assert {r["doc_id"]: [x["line"] for x in r["removed"]] for r in out} == want


def test_line_dedup_holds_one_part_at_a_time(spark, frame, monkeypatch):
    # before, a task held all parts that are dealt to it at once
    candidates, mix = line_dedup._candidates, line_dedup._mix

    def alone(rows, threshold, most):
        assert len(np.unique(mix(rows["word"]) % np.uint64(8))) == 1
        return candidates(rows, threshold, most)

    monkeypatch.setattr(line_dedup, "_candidates", alone)
    rows = [(i, "\n".join(f"w{i} w{i + k} w{2 * i} w{k} w{i * k}" for k in range(20))) for i in range(40)]
    assert line_dedup.deduplicated(frame(rows, "doc_id long, text string")).count() == 40


def test_line_dedup_of_odd_rows(spark, frame):
    rows = [(1, "b a\nx y z"), (1, "A  B\nq r s"), (2, "x y z\n\nx y z"), (3, None), (4, ""), (5, "\n \t\n"), (6, "k " * 300_000), (None, "x y z\nnew line here"), (7, "w\n" * 3000), (7, "w\n" * 3000)]
    docs = frame([(*r, "c") for r in rows], "doc_id long, text string, n_lines string")
    out = line_dedup.deduplicated(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed", "removed"]
    got = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in out.collect())
    # documents of the repeated id 1 come last, by hash: one of them keeps its first line
    assert sum(n for (i, t, g), n in got.items() if i == 1 and g == 0) in (0, 1)
    assert got[3, None, 0] == got[4, "", 0] == got[5, "\n \t\n", 0] == got[6, "k " * 300_000, 0] == got[2, "x y z\n", 1] == 1
    assert got[7, "w\n", 2999] == 2
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0
    kept = line_dedup.without_repeats(frame([(1, "a b c d\ne f", 11), (2, "a b c d", 7), (3, "", 0), (4, "a b c d\nz", 9)], "doc_id long, text string, n_chars long"))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d\ne f", 11), (3, "", 0), (4, "z", 1)]


def test_ids_that_are_no_numbers(spark, frame):
    out = line_dedup.deduplicated(frame([("x", "a b"), ("y", "a b"), (None, "a b")], "doc_id string, text string")).collect()
    assert sorted(r["n_removed"] for r in out) == [0, 1, 1]


# mixing


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares the total by weight; what is above a cap goes back to the others until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_names = share * sum(sizes.values()), {}, list(names)
    while True:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_names) if open_names else 0
        over = [s for s in open_names if weight[s] * level >= most * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in open_names}
        target |= {s: most * sizes[s] for s in over}
        open_names = [s for s in open_names if s not in over]


def test_targets_equal_repeated_sharing(spark):
    rng = random.Random(2)
    for _ in range(3):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 1000]) for i in range(9)} | {None: 50, "é": 70}
        rows = [(s, n) for s, n in sizes.items()]
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        want = slow_targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def test_mix_comes_near_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 8)
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), int(rng.paretovariate(1.8) * 20)) for i in range(2000)]
    rows += [(5, "a", 30), (5, "a", 30), (None, "b", 20), (None, "b", 20), (9001, "c", 0), (9002, "empty", 0), (9003, "one", 700)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix(sizes).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter(rows)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in out)
    taken, target = Counter(), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        if r["size"]:
            assert r["copies"] in (math.floor(r["target"] / r["source_size"]), math.floor(r["target"] / r["source_size"]) + 1)
    for s in ("a", "b", "c", None):
        assert abs(taken[s] - target[s]) < 0.02 * target[s]
    again = mixing.mix(sizes.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_rounding_is_unbiased(spark):
    sizes = spark.createDataFrame([(i, "a", 10 + i % 7) for i in range(12)] + [(100, "b", 400)], "doc_id long, source string, size long")
    mean = Counter()
    for seed in range(8):
        for r in mixing.mix(sizes, seed=seed).collect():
            mean[r["source"]] += r["copies"] / 8
    x = {r["source"]: r["target"] / r["source_size"] for r in mixing.mix(sizes).collect()}
    assert abs(mean["a"] / 12 - x["a"]) < 0.1


def test_mixed_repeats_documents(spark, frame):
    rows = [(i, f"w{i} " * (1 + i % 5), "s" + str(i % 2), "old") for i in range(40)] + [(1, "dup dup", None, "old"), (1, "dup dup", None, "old"), (None, None, None, None), (77, "", "s0", None)]
    docs = frame(rows, "doc_id long, text string, source string, copy string")
    out = mixing.mixed(docs)
    assert out.columns == ["doc_id", "text", "source", "copy"]
    want = Counter()
    for r in mixing.mix(mixing.sizes_of(docs, [F.col("doc_id")])).collect():
        want[r["source"]] += r["taken"]
    got = Counter()
    for r in out.collect():
        got[r["source"]] += len(r["text"].split())
    total = sum(len(r[1].split()) if r[1] else 0 for r in rows)
    assert abs(sum(got.values()) - 1.5 * total) <= 10 and got.keys() == {s for s, n in want.items() if n}
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mix(mixing.sizes_of(docs.limit(0), [F.col("doc_id")])).count() == 0


def test_repeated_rows_share_whole_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 7)
    rows = [(None, "a", 10)] * 1001 + [(i, "a", 10) for i in range(50)] + [(3, "b", 5)] * 30 + [(4, "b", 0)] * 9
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix(sizes)
    got = out.collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(rows)
    x = {r["source"]: r["target"] / r["source_size"] for r in got}
    for key, n in Counter(rows).items():
        mine = [r["copies"] for r in got if (r["doc_id"], r["source"], r["size"]) == key]
        expected = n * x[key[1]] if key[2] else 0
        assert abs(sum(mine) - expected) <= 1 and max(mine) - min(mine) <= 1
    assert Counter(map(tuple, mixing.mix(sizes.repartition(7)).collect())) == Counter(map(tuple, got))


def test_many_rows_without_ids_take_no_longer(spark):
    def seconds(sizes):
        begin = time.perf_counter()
        mixing.mix(sizes).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    distinct = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(20).cast("long").alias("size"))
    seconds(distinct.limit(100))
    assert seconds(distinct.withColumn("doc_id", F.lit(None).cast("long"))) < 2 * seconds(distinct) + 2


def test_mixing_query_takes_near_the_targets(spark):
    rows = op6_mixing(spark, "/root/testdata/sf0.01").collect()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == words
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    want = slow_targets(sizes)
    assert all(math.isclose(target[s], want[s], rel_tol=1e-9) for s in want)
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] for s in want)


# decontamination

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow_contamination(rows, items, size=10):
    def words(t):
        return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if t else []

    found = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = Counter()
    for doc, text in rows:
        w, hit, named, any_hit = words(text), set(), set(), False
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                if (x := found.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    named |= {str(i) for i in x if i is not None}
        out[doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)] += 1
    return out


def contamination_cases():
    rng = random.Random(8)
    pool = ["the", "of", "a"] * 6 + [f"w{i}" for i in range(30)] + ["Größe", "ÀB", "x1"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(25)]
    items += [(3, "The of, a the of a the of a the of a"), (40, None), (41, "..."), (None, "w1 w2 w3 w4 w5"), (42, "the"), (43, items[0][1])]
    rows = []
    for d in range(50):
        parts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(40)))]
        for _ in range(rng.randrange(3)):
            text = rng.choice(items)[1] or ""
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([text, text.upper(), text.replace(" ", "-"), " ".join(text.split()[2:])]))
        rows.append((d, " / ".join(parts)))
    rows += [(0, rows[0][1]), (0, "other the"), (None, rows[1][1]), (None, rows[1][1]), (90, None), (91, ""), (92, "!!"), (94, "w1\x00w2\x7fw3{w4@w5 ÀB\u00a0x1\u2003 [a]`b^_"), (93, "w7 " * 50_000 + (items[5][1] or ""))]
    return rows, items


def test_contamination_equals_brute_force(spark, frame, monkeypatch):
    rows, items = contamination_cases()
    docs, bench = frame([(*r, "x", 1) for r in rows], "doc_id long, text string, item_id string, n_hit int"), frame(items, "item_id long, text string")
    want = slow_contamination(rows, items)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    out = decontamination.contamination(docs, bench)
    assert tuple(out.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in out.collect()) == want
    monkeypatch.setattr(decontamination, "TERMS_AT_ONCE", 7)
    assert Counter(tuple(r) for r in decontamination.contamination(docs, bench).collect()) == want
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({k: n for k, n in Counter(x[0] for x in want.elements() if not x[5]).items()})


def test_contamination_without_rows(spark, frame):
    docs, bench = frame([(1, "some words")], "doc_id long, text string"), frame([(1, "some words")], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert [r["contaminated"] for r in decontamination.contamination(docs, bench.limit(0)).collect()] == [False]
    assert [r["n_hit"] for r in decontamination.contamination(docs, bench).collect()] == [2]


def test_proximity_matches_allow_small_shifts(spark, frame):
    docs = frame([("a", "x x alpha beta gamma"), ("b", "alpha q beta gamma"), ("c", "alpha q q q q q beta gamma"), ("d", "alpha beta")], "k string, text string")
    wanted, _ = decontamination.windows(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    found = decontamination.occurrences(docs, ["k"], "text", wanted, slop=1)
    assert {r["k"] for r in found.collect()} == {"a", "b"}
    assert {r["k"] for r in decontamination.occurrences(docs, ["k"], "text", wanted).collect()} == {"a"}


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_matches_look_at_all_words(spark, frame, slop):
    rng = random.Random(slop)
    item = "one two three four five six seven eight two ten".split()
    texts = [item, [*item[:4], "x", *item[4:]], [*item[:1], *["x"] * 7, *item[8:]], ["one", "two"], [*item[:5], "seven", "six", *item[7:]], item[::-1], ["x", *item[1:]]]
    for _ in range(25):
        near = list(item)
        for _ in range(rng.randrange(4)):
            near.insert(rng.randrange(len(near)), rng.choice(["x", *item]))
            near.pop(rng.randrange(len(near)))
        texts.append(["x"] * rng.randrange(3) + near)
    docs = frame([(str(k), " ".join(t)) for k, t in enumerate(texts)], "k string, text string")
    wanted, _ = decontamination.windows(spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    found = {r["k"] for r in decontamination.occurrences(docs, ["k"], "text", wanted, slop=slop).collect()}
    counts = Counter(w for t in texts for w in t)
    rarest = min(set(item), key=lambda w: (counts[w], w))
    for k, t in enumerate(texts):
        begins = [p - item.index(rarest) for p, w in enumerate(t) if w == rarest]
        close = any(all(word in t[max(0, b + o - slop) : max(0, b + o + slop + 1)] for o, word in enumerate(item)) for b in begins)
        assert (str(k) in found) == close, t
    assert "2" not in found and "3" not in found and "0" in found


def test_long_repetitive_texts_and_windows(spark, frame):
    docs = frame([(1, "a " * 60_000), (2, "a " * 9), (3, "b " + "a " * 10)], "doc_id long, text string")
    rows = decontamination.contamination(docs, frame([(7, "a " * 10), (8, "c d")], "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in rows} == {1: (60_000, 60_000, 1), 2: (9, 0, 0), 3: (11, 10, 1)}


def test_decontamination_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert Counter(tuple(r) for r in op8_decontamination(spark, SF).collect()) == slow_contamination(rows, items)


# top-k


def slow_top(rows, queries, k):
    out = set()
    for q, v in queries:
        scored = sorted(((-int(np.dot(np.array(v, object), np.array(w, object))), c) for c, w in rows if c != q and len(w) == len(v)))[:k]
        out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)}
    return out


@pytest.mark.parametrize("high", [3, 40, 2**28])
def test_top_k_equals_brute_force(spark, frame, monkeypatch, high):
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 50)
    monkeypatch.setattr(topk, "TOGETHER", 3)
    monkeypatch.setattr(topk, "FIRST_DEPTH", 2)
    rng = np.random.default_rng(high)
    rows = [(i, rng.integers(-high, high, 6).tolist()) for i in range(200)] + [(300 + i, rng.integers(-high, high, 3).tolist()) for i in range(5)] + [(400 + i, []) for i in range(15)]
    vectors = frame(rows, "row long, vector array<long>")
    queries = [r for r in rows if r[0] % 10 == 0]
    got = {tuple(r) for r in topk.top_k(vectors, vectors.where("row % 10 = 0"), 6).collect()}
    assert got == slow_top(rows, queries, 6)


def test_lists_stop_early():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-50, 50, (4000, 3))
    vectors[17] = [900, 900, 900]
    lists = topk.Lists(np.arange(4000), vectors)
    seen = []
    lists.vectors = type("Seen", (), {"astype": lambda self, kind: type("Rows", (), {"__getitem__": lambda s, at: (seen.append(len(at)), vectors[at].astype(kind))[1]})()})()
    _, ids, scores = lists.best(np.array([9999]), np.array([[1, 1, 1]]), 1, True)
    assert ids.tolist() == [17] and scores.tolist() == [2700] and sum(seen) < 400


def test_vectors_that_take_no_part(spark):
    rows = [(1, [0.5, -0.01]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted((r["row"], r["vector"]) for r in vectors.collect()) == [(1, [32, -1]), (7, [64, 64]), (7, [64, 64])]
    assert {tuple(r) for r in topk.top_k(vectors, vectors.where("row = 1"), 5).collect()} == {(1, 1, 7, 1984), (1, 2, 7, 1984)}
    assert topk.top_k(vectors.limit(0), vectors, 5).count() == 0 and topk.top_k(vectors, vectors.limit(0), 5).count() == 0
