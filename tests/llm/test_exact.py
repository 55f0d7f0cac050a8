"""Operators against plain versions of themselves on small hostile tables."""

import pickle
import random
import re
import resource
import textwrap
import zlib
from html import unescape
from pathlib import Path
from urllib.parse import urljoin, urlsplit

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import components, decontaminate, licenses, line_dedup, packing, queries, secrets, simhash, substring_dedup, topk, url_filter
from sparkloom.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
EXTRA = ", host string, n int, x long, component_id long, score double, seq int, row long, length int, value map<string,int>"


def texts(r: random.Random, n: int, words: int = 60) -> list[str]:
    pool = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    return [" ".join(r.choice(pool) for _ in range(r.randint(1, words))) for _ in range(n)]


def hostile() -> list[tuple]:
    """Rows with nulls anywhere, empty and long texts, copies, repeated rows and keys."""
    r = random.Random(4)
    plain = texts(r, 12)
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(plain)]
    rows += [(20, None, None, None, None), (21, "", "en", "s0", 0), (22, "   \n\n\t ", "en", "s0", 7), (23, plain[0], "en", "s1", 1), (None, plain[1], "en", "s1", 1), (24, plain[2], None, None, 3), (25, "12 34 !?", "en", "s0", 8)]
    rows += [rows[3], rows[3], (30, " ".join(texts(r, 900)), "en", "s0", None), (31, "x" * 5000, "en", "s0", None), (32, "é" * 700 + "\U0001f600" * 300, "fr", "s0", None)]
    return rows


def table(spark, rows, schema=DOCS, extra=True):
    if extra:
        return spark.createDataFrame([(*t, "h", 1, 2, 3, 0.5, 4, 5, 6, {"a": 1}) for t in rows], schema + EXTRA).repartition(3)
    return spark.createDataFrame(rows, schema).repartition(3)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, i) for i in range(2001, 2100)] + [(None, 5), (7, None), (9, 9)]
    got = {tuple(x) for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    u = brute.Union()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            u.join(a, b)
    assert got >= {(x, u.root(x)) for x in u.up if u.root(x) != x}
    assert got <= {(x, u.root(x)) for x in u.up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark):
    r = random.Random(2)
    rows = []
    for i in range(80):
        lines = [r.choice(["home | about", "Cookies!", " ", "", "unique %d" % i, "twice", "é 日本"]) for _ in range(r.randint(0, 9))]
        rows.append((i, "\n".join(lines), "en", r.choice(["a", "a", "b", None]), 0))
    rows += hostile() + [(99, "home | about\nhome | about", "en", "a", 0)]
    docs = table(spark, rows)
    got = line_dedup.drop_boilerplate(docs, count="dropped")
    assert got.columns == [*docs.columns, "dropped"]
    assert sorted(map(repr, (tuple(x) for x in got.select("doc_id", "text", "dropped").collect()))) == sorted(map(repr, brute.drop_lines([(t[0], t[3], t[1]) for t in rows])))
    assert got.filter("dropped > 0").count() > 20


def test_urls(spark):
    r = random.Random(3)
    hosts = ["example.com", "www.Example.COM", "a.example.net", "x.de.net", "b.org", "other.io"]
    paths = ["/en/7", "/en/70/x", "/de/8", "/de/9", "/es/", "/EN/7", "", "/", "/q"]

    def url():
        end = r.choice(["", "?a=1", "#f", "?b=/en/7#x"])
        return f"{r.choice(['http', 'HTTPS'])}://{r.choice(hosts)}{r.choice(paths)}{r.randrange(25)}{end}"

    rows, edges = [], []
    for i in range(150):
        a, b = url(), url()
        own = re.match(r"[^:]+://[^/?#]*", a)[0]
        link, target = r.choice(
            [
                (f'<LINK href="{b}" rel=canonical>', b),
                (f"<link rel='canonical' href='{b}'/>", b),
                (f'<meta http-equiv="refresh" content="0; url={b}">', b),
                ('<link rel="canonical" href="/es/only">', own + "/es/only"),
                (f'<link rel="canonical" href="//{b.split("://")[1]}">', b),
                ("<link rel=stylesheet href=/x>", None),
                ("", None),
                ("", None),
            ]
        )
        rows.append((i, a, f"<html><head>{link}</head></html>"))
        edges += [(a, target)] if target else []
    redirects = [(url(), url()) for _ in range(25)] + [(rows[5][1], rows[6][1]), (None, rows[7][1]), (rows[8][1], "nowhere")]
    rows += [(200, None, None), (201, "no scheme", ""), (202, "", "<link rel=canonical href=http://b.org/es/>"), (203, "http://", None), rows[0], rows[0], (None, "http://b.org/es/x", None)]
    pages = spark.createDataFrame([(*t, "h", "p", "v") for t in rows], "page_id long, url string, html string, host string, path string, verdict string")
    got = url_filter.judge_urls(pages, URL_RULES, spark.createDataFrame(redirects, "src string, dst string"))
    want = brute.urls([t[:2] for t in rows], URL_RULES, edges + redirects)
    assert sorted(map(repr, (tuple(x) for x in got.select("page_id", "host", "path", "rule", "verdict").collect()))) == sorted(map(repr, want))
    assert got.filter("propagated").count() > 5
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_urls_of_relative_links(spark):
    urls = ["http://A.com/en/1.html", "http://a.com", "http://a.com/", "https://a.com/x/y/?p=/q/r", "http://a.com/x/y#z/w"]
    links = ["7.html", "?id=7", "?id=7&amp;b=1", "../x", "../../x", "./x", ".", "..", "../", "a/./b/../c", "d/..", "7?next=http://b.org/", "/r?a=1&#38;b=2", "http://b.org/?a&amp;b", "//b.org/s", "mailto:x@y.z", "#top", "x#y"]
    rows = [(u, f'<link rel="canonical" href="{t}">') for u in urls for t in links] + [(u, f'<meta http-equiv="refresh" content="0; url={t}">') for u in urls for t in links[:4]] + [(None, "<link rel=canonical href=x>")]
    node = lambda u: (lambda p: p.netloc.lower() + (p.path + (f"?{p.query}" if p.query else "") or "/"))(urlsplit(u))
    want = {(node(u), node(urljoin(u if urlsplit(u).path else f"{u}/", unescape(t)))) for u in urls for t in links if not t.startswith(("mailto:", "#"))}
    got = url_filter.alias_edges(spark.createDataFrame(rows, "url string, html string"))
    assert {tuple(x) for x in got.collect()} == {(a, b) for a, b in want if a != b}
    pages = spark.createDataFrame([(1, "http://b.com/x/1", '<link rel="canonical" href="../en/2">'), (2, "http://c.com/en/2", '<link rel=canonical href="http://b.com/x/1">')], "page_id long, url string, html string")
    assert {(x["page_id"], x["verdict"]) for x in url_filter.judge_urls(pages, [("block", "b.com/en/")]).collect()} == {(1, "block"), (2, "block")}


@pytest.mark.parametrize("dims,spread", [(3, 1.0), (16, 0.2), (64, 1.0)])
def test_topk(spark, dims, spread):
    rng = np.random.default_rng(dims)
    vectors = np.round(rng.normal(0, spread, (230, dims)), 2 if dims == 3 else 7).astype(np.float32)
    vectors[7] = 0
    vectors[11] = vectors[12] = vectors[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(300, None, 1), (400, [None] * dims, 1), (401, [float("nan")] * dims, 1), (402, [float("inf")] + [0.0] * (dims - 1), 1), (None, vectors[0].tolist(), 2)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3), F.col("vec_id") % 100 == 0)
    whole = np.floor(1024 * vectors.astype(float)).astype(object)
    want = set()
    for q in (0, 100, 200):
        scores = sorted((-sum(whole[q] * whole[c]), c) for c in range(230) if c != q)[:10]
        want |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(scores)}
    assert {tuple(x) for x in got.collect()} == want
    void = topk.top_k(spark.createDataFrame([(0, [], 0), (1, [1.0], 0), (2, [], 0)], "vec_id long, embedding array<float>, score int"), F.col("vec_id") % 2 == 0)
    assert sorted(tuple(x) for x in void.collect()) == [(0, 1, 1, 0), (0, 2, 2, 0), (2, 1, 0, 0), (2, 2, 1, 0)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, score int"), F.col("vec_id") == 0).count() == 0
    few = topk.top_k(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, score int"), F.col("vec_id") == 0)
    assert few.count() == 3


def test_topk_large_numbers(spark):
    rows = [(i, [float(2**40 + i), -float(2**41)]) for i in range(5)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2, scale=1)
    want = sorted((-(2**40 * (2**40 + i)) - 2**82, i) for i in range(1, 5))[:2]
    if -want[0][0] < 2**63:
        assert [(x["vec_id"], x["score"]) for x in got.orderBy("rank").collect()] == [(i, -s) for s, i in want]


def test_packing(spark):
    from tokenizers import Tokenizer

    r = random.Random(5)
    rows = [*hostile(), *((100 + i, t + r.choice(["", " É", " <|endoftext|>", "日本語"]), "en", "s", 0) for i, t in enumerate(texts(r, 400, 300)))]
    got = packing.pack(table(spark, rows), size=256).collect()
    slow = Tokenizer.from_file(packing.default_vocabulary())
    ids = [(t[0], [*slow.encode(t[1] or "", add_special_tokens=False).ids, 0]) for t in rows]
    want = sorted(repr((k, i, s, n, zlib.crc32(np.array(x[s : s + n], "<u4").tobytes()))) for k, x in ids for i, (s, n) in enumerate(packing.cut(np.array(x), 256)))
    assert sorted(repr((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"])) for x in got) == want
    bins: dict = {}
    for x in got:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for items in bins.values():
        end = 0
        for at, n in sorted(items):
            assert at == end
            end += n
        assert end <= 256
    total = sum(len(x) for _, x in ids)
    assert len(bins) <= -(-total // 256) * 1.01 + 1
    assert packing.pack(table(spark, rows).limit(0)).count() == 0


def test_both_tokenizers_give_the_same_ids():
    r = random.Random(12)
    slow, fast = packing._encoders(packing.default_vocabulary())
    plain = [chr(c) for c in range(0x2028) if packing.PLAIN.fullmatch(chr(c))]
    parts = [*plain, *"    \n\n\t'sdmtl0123456789aeiourstn", "'re", " 've", "<|endoftext|>", "<|", "  ", "\r\n", "don't", " the", "ñ", "’s", "—"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert fast.encode(text, allowed_special="all") == slow.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_holds_every_item(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 100): r.choice([1, 3, 1000]) for _ in range(r.randint(1, 40))}
    used: dict = {}
    bins = packing.plan_bins(counts, 100)
    for times, items in bins:
        assert 0 < sum(n * k for n, k in items) <= 100
        for n, k in items:
            used[n] = used.get(n, 0) + times * k
    assert used == counts
    assert len(bins) <= 3 * 100


def test_packing_swaps_the_smallest_for_a_tighter_pair():
    # Greedy puts 60 and 30 together, which leaves 10; 30 gives way to 25 and 15, which fill the gap of 40.
    assert packing.plan_bins({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0] == (1, [(60, 1), (25, 1), (15, 1)])


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"][1]
    odd = "  copyright (c) 2001 Someone\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " -- ")
    rows = [(1, mit), (2, odd), (3, "Copyright 2020 X\n\nReleased under the MIT licence!"), (4, mit + " extra"), (5, None), (6, ""), (7, "!!"), (8, mit.replace("non-infringement", "noninfringement")), (1, mit), (None, mit)]
    docs = spark.createDataFrame([(*t, "d", "l") for t in rows], "doc_id long, text string, digest string, license string")
    got = {(x["doc_id"], x["license"]) for x in licenses.scan_licenses(docs).collect()}
    assert got == {(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, None), (5, None), (6, None), (7, None), (8, "MIT"), (None, "MIT")}
    assert licenses.scan_licenses(docs).count() == len(rows)
    assert {x["digest"] for x in licenses.scan_licenses(docs).filter("doc_id = 5").collect()} == {None}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


WHOLE_TEXTS = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2-only", "GFDL-1.3": "GFDL-1.3-only", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only",
    "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def test_whole_license_texts(spark):
    folder = Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("Debian's copies of the licences aren't here")
    texts = {name: (folder / name).read_text() for name in WHOLE_TEXTS}
    terms = {name: t[: t.index("END OF TERMS AND CONDITIONS")] for name, t in texts.items() if "END OF TERMS AND CONDITIONS\n" in t}
    assert len(terms) >= 5
    rows = [(name, t, WHOLE_TEXTS[name]) for name, t in texts.items()] + [(f"{name}, terms", t, WHOLE_TEXTS[name]) for name, t in terms.items()]
    rows += [(f"{name}, unwrapped", re.sub(r"[ \t]*\n[ \t]*(?=\S)", " ", t), WHOLE_TEXTS[name]) for name, t in texts.items()]
    rows += [("Unlicense", licenses.KNOWN["Unlicense"][1].upper().replace("\n\n", "\n\n\n# "), "Unlicense")]
    rows += [(f"{name}, more", f"{t} extra", None) for name, t in texts.items()]
    docs = spark.createDataFrame([(*r[:2], "d", "l") for r in rows], "doc_id string, text string, digest string, license string")
    assert {(x["doc_id"], x["license"]) for x in licenses.scan_licenses(docs).collect()} == {(name, want) for name, _, want in rows}


def test_wrapped_licenses_with_holders(spark):
    rows = []
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "0BSD", "MIT-0", "Unlicense"):
        text = licenses.KNOWN[name][0]
        for width in (40, 61, 72, 79):
            wrapped = "\n\n".join(textwrap.fill(x, width) for x in text.split("\n"))
            for i, head in enumerate(("", "Copyright (c) 2001-2019, Jane Doe <j@x.org>\nAll rights reserved.\n\n", "Copyright 2020 The Foo Authors\n\n", "(c) 2011 X\n", "Copyright © X Inc.\n", "/* Copyright the Foo Authors.\n", "Copyright [yyyy] [name]\n")):
                rows.append((f"{name} {width} {i}", head + wrapped, name))
    rows += [("long", "word " * 400_000, None), ("line", "copyright notice and this\n" + licenses.KNOWN["MIT"][0], None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, want string")
    got = {x["doc_id"]: x["license"] for x in licenses.scan_licenses(docs).collect()}
    assert {k: v for k, _, v in rows if got[k] != v} == {}


def test_planted_licenses_equal_their_sql(spark):
    texts = [t for ts in licenses.KNOWN.values() for t in ts] + ["Copyright 2020 X\n" + licenses.KNOWN["ISC"][0].upper(), "no licence", None, "", "½ ²"]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = con.execute(queries.oracle_sql()["op5_license_scan"]).fetchall()
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "digest", "license").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and sum(x[2] is not None for x in want) >= len(texts) - 4


def test_leaks(spark):
    r = random.Random(6)
    pool = [f"w{i}" for i in range(400)]
    items = [[r.choice(pool) for _ in range(r.choice([5, 6, 9, 14, 30, 60]))] for _ in range(25)]
    rows, k = [], 0
    for item in items:
        for edits in (0, 1, 2, len(item) // 5, len(item) // 5 + 1, len(item) // 3):
            x = list(item)
            for _ in range(edits):
                at, kind = r.randrange(len(x)), r.randrange(3)
                x[at : at + 1] = [[], [r.choice(pool)], [x[at], r.choice(pool)]][kind]
            lead, tail = ([f"v{r.randrange(9999)}" for _ in range(r.randrange(30))] for _ in range(2))
            rows.append((k, " ".join(lead + x + tail).replace("w1 ", "W1, "), "en", "s", 0))
            k += 1
    rows += [(1000 + i, t, "en", "s", 0) for i, t in enumerate(texts(r, 30))] + [(2000, None, "en", "s", 0), (2001, "", "en", "s", 0), rows[0], (None, rows[0][1], "en", "s", 0)]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(91, None), (92, ""), (93, "!?")]
    want = []
    for key, text, *_ in rows:
        words = re.findall(r"\w+", (text or "").lower())
        for i, item in enumerate(items):
            if (e := brute.word_edits(item, words)) <= len(item) // 5:
                want.append(repr((key, i, e)))
    docs, benchmark = table(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    found = [repr((x["doc_id"], x["item_id"], x["edits"])) for x in decontaminate.find_leaks(docs, benchmark).collect()]
    assert set(found) <= set(want)
    assert len(found) >= 0.99 * len(want) and len(want) > 80
    hit = {x.split(",")[0] for x in found}
    kept = decontaminate.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(f"({x['doc_id']}" for x in kept.select("doc_id").collect()) == sorted(f"({t[0]}" for t in rows if f"({t[0]}" not in hit)
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("sizes", [(1, 2, 3, 4), (5,), (6, 7), (8, 9, 10, 11), (12, 13, 14, 15), (16,), (17, 24, 31), (45, 59), (200,)])
def test_tables_find_leaks_at_the_edit_limit(sizes):
    # The hardest copies alone: as many edits as the similarity allows. No other way than the tables leads to a window.
    r = random.Random(repr(sizes))
    pool = [f"w{i}" for i in range(400)]
    items = [[r.choice(pool) for _ in range(r.choice(sizes))] for _ in range(60)]
    docs = []
    for item in items * 2:
        x = list(item)
        for _ in range(len(item) // 5):
            at, kind = r.randrange(len(x)), r.randrange(3)
            x[at : at + 1] = [[], [r.choice(pool)], [x[at], r.choice(pool)]][kind]
        docs.append([*(f"v{r.randrange(99)}" for _ in range(r.randrange(9))), *x, *(f"v{r.randrange(99)}" for _ in range(r.randrange(9)))])
    own = lambda d: range(60) if max(sizes) < 5 else [d % 60]  # noqa: E731 - longer items of random words are in no other text
    want = {(d, i, e) for d, x in enumerate(docs) for i in own(d) if (e := brute.word_edits(items[i], x)) <= len(items[i]) // 5}
    found = set(decontaminate.Index([(i, [w.encode() for w in x]) for i, x in enumerate(items)]).leaks([" ".join(x) for x in docs]))
    assert found <= want and len(found) >= 0.95 * len(want) and len(want) >= 120


def test_leaks_of_very_short_and_very_long_items(spark):
    r = random.Random(16)
    long = [f"w{r.randrange(3000)}" for _ in range(5000)]
    edited = [w if r.random() > 0.1 else "other" for w in long]
    bench = spark.createDataFrame([(1, "solo"), (2, " ".join(long)), (3, "two words"), (4, "x " * 5)], "item_id long, text string")
    rows = [(1, "here solo stands"), (2, " ".join(["a"] * 30 + edited + ["b"] * 30)), (3, " ".join(long[:3800])), (4, " ".join(long[:4100])), (5, "two other words"), (6, "Two, WORDS"), (7, "x " * 50_000)]
    got = {(x["doc_id"], x["item_id"], x["edits"]) for x in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1, 0), (2, 2, sum(a != b for a, b in zip(long, edited, strict=True))), (4, 2, 900), (6, 3, 0), (7, 4, 0)}


def test_an_index_grows_with_words_alone():
    size = lambda n: len(pickle.dumps(decontaminate.Index([(1, [f"w{i}".encode() for i in range(n)])])))
    assert size(20_000) < 20_000 * 250


def test_leaks_over_several_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 12)
    monkeypatch.setattr(decontaminate, "SLICES", 2)
    items = [f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(6)]
    docs = spark.createDataFrame([(i, f"intro {t} outro") for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert len(decontaminate.indexes(bench)) == 3
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs, bench).collect()} == {(i, i) for i in range(6)}
    assert decontaminate.drop_leaks(docs, bench).count() == 0


def near_texts(r: random.Random) -> list[str]:
    out = texts(r, 120, 200)
    for t in out[:60]:
        words = t.split(" ")
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = r.choice(["zz", "Yy", "x\ty"])
            out.append(" ".join(words))
    return out


def test_simhash(spark):
    rows = [(i, t) for i, t in enumerate(near_texts(random.Random(7)))] + [(900, None), (901, ""), (902, " \t\x0b"), (903, "One"), (904, "oNE"), (905, "two words"), (906, "a\u00a0b \u2003c É é"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(*t, 1, 2) for t in rows], "doc_id long, text string, fp long, component_id long").repartition(3)
    got = {(x["doc_id"], f"{x['fp'] % 2**64:016x}", x["component_id"]) for x in simhash.near_duplicates(docs).collect()}
    want = brute.near_duplicates(rows)
    assert got == want
    assert len({c for *_, c in want}) < len(rows) - 20
    assert simhash.near_duplicates(docs).count() == len(rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({c for *_, c in want})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_first(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(rows)


@pytest.mark.parametrize("chunk", [8192, 20, 3])
def test_hamming_links_join_what_they_should(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(25)]
    hot = 0xABCD << 48  # one value of a block, as of a bucket with a third of all
    prints = {hot | r.getrandbits(48) for _ in range(60)}
    prints |= {p ^ (1 << r.randrange(48)) ^ (1 << r.randrange(48)) ^ (1 << r.randrange(48)) for p in sorted(prints)[:40]}
    prints |= {b for b in base} | {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(4)} | {0xFFFF << 48 | r.getrandbits(6) for _ in range(40)} | {0, 7, 2**64 - 1}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    got, want = brute.Union(), brute.Union()
    for x in links:
        assert ((x["a"] ^ x["b"]) % 2**64).bit_count() <= 3
        got.join(x["a"] % 2**64, x["b"] % 2**64)
    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 3:
                want.join(a, b)
    assert {p: got.root(p) for p in ordered} == {p: want.root(p) for p in ordered}


def passages(r: random.Random) -> list[tuple]:
    out = [" ".join(texts(r, 8)) for _ in range(30)]
    shared = [" ".join(texts(r, 12))[: r.choice([150, 199, 200, 201, 260, 900])] for _ in range(14)]
    for i in range(30):
        for _ in range(r.randrange(3)):
            at = r.randrange(len(out[i]))
            out[i] = out[i][:at] + r.choice(shared) + out[i][at:]
    out += ["ab" * 400, "x" * 199, "y" * 200, "z" * 201, "é" * 150, "éè" * 120 + "tail", None, "", out[3], out[3], out[4][10:], "q" + out[4]]
    return list(enumerate(out)) + [(3, out[3]), (None, out[5][:700])]


@pytest.mark.parametrize("most,shares", [(1500, 4), (1, 4), (2, 7)])
def test_repeats(spark, monkeypatch, most, shares):
    # With 1 or 2 contexts a key, keys grow to whole windows, and one lead is dealt over many partitions.
    monkeypatch.setattr(substring_dedup, "MOST", most)
    monkeypatch.setattr(substring_dedup, "SHARES", shares)
    rows = passages(random.Random(9))
    docs = spark.createDataFrame([(*t, 1, b"") for t in rows], "doc_id long, text string, mark long, ctx binary").repartition(4)
    got = sorted(map(repr, (tuple(x) for x in substring_dedup.remove_repeats(docs).collect())))
    assert got == sorted(map(repr, brute.removed(rows)))


def test_repeats_of_nothing(spark):
    schema = "doc_id long, text string"
    assert substring_dedup.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    got = substring_dedup.remove_repeats(spark.createDataFrame([(1, "short"), (2, None)], schema)).collect()
    assert sorted(tuple(x) for x in got) == sorted(brute.removed([(1, "short"), (2, None)]))


def test_repeats_across_pieces_of_a_long_text(monkeypatch):
    r = random.Random(10)
    text = " ".join(texts(r, 60)).encode()
    at = lambda *runs: {w: (g, p) for a in runs for g, p, s, e in zip(*(c.tolist() for c in a), strict=True) for w in range(s, e + 1)}
    whole = at(substring_dedup.anchors(text))
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    parts = at(*(substring_dedup.anchors(text, i) for i in range(0, len(text) - 199, 700)))
    assert whole == parts and len(whole) == len(text) - 199


def test_a_text_that_repeats_itself_is_settled_in_bounded_memory():
    for unit, size in ((b"x", 5_000_000), (bytes(range(33, 120)), 5_000_000), (b"0123456789" * 90 + b"!", 5_000_000)):
        text = (unit * (size // len(unit) + 1))[:size]
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        runs, spans = substring_dedup.distinct_runs(text)
        # What stands alone, at the ends of the text and of its pieces, meets its equals with all other texts.
        assert sum(b - a for a, b in spans) >= size - 2 * len(unit) and len(runs[0]) < 2 * len(unit) + 30
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_a_long_text_that_repeats_itself_meets_others(spark):
    rows = [(1, "x" * 400_000), (2, "a" + "x" * 199 + "b"), (3, "a" + "x" * 200 + "b"), (4, "y" * 199 + "z"), (5, "lead " + "0123456789" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, (tuple(x) for x in substring_dedup.remove_repeats(docs).collect())))
    assert got == sorted(map(repr, brute.removed(rows)))


def test_multikey_sort():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (500, 21)).astype(np.uint8)
    rows[100:200, :16] = rows[0, :16]
    assert [rows[i].tobytes() for i in substring_dedup.multikey_sort(rows)] == sorted(x.tobytes() for x in rows)


def plain_candidates(text: str) -> list[tuple]:
    """(candidate, before, after) of each, in order."""
    found = list(re.finditer(secrets.CANDIDATE, text))
    ends = [0, *(m.end() for m in found)]
    starts = [*(m.start() for m in found), len(text)]
    out = []
    for i, m in enumerate(found):
        said = re.match(secrets.ASSIGNED, m[0])[0] if re.fullmatch(secrets.ASSIGNED + secrets.VALUE, m[0]) else ""
        out.append((m[0][len(said) :], (text[ends[i] : starts[i]] + said)[-secrets.BEFORE :], text[ends[i + 1] : starts[i + 1]][: secrets.AFTER]))
    return out


def test_secrets(spark):
    found = secrets.labelled_findings(300, seed=99)
    rows = [(i, before + cand + after, "en", source, label) for i, (cand, before, after, source, label) in enumerate(found)]
    rows += [(1000, None, "en", None, 0), (1001, "", "en", "s", 0), (1002, "nothing here", "en", "s", 0), (1003, "a token=" + "Ab1" * 3000 + " and " + "Zz9-" * 6 + " key: short password:  's3cret!' pwd=ü€long", "en", None, 0), rows[1], (None, rows[1][1], "en", "s", 0)]
    docs = table(spark, rows)
    forest, want = secrets.default_forest(), []
    for key, text, _, source, _ in rows:
        for i, (cand, before, after) in enumerate(plain_candidates(text or "")):
            want.append((key, i, cand, before, round(secrets.forest_py(forest, secrets.features_py(cand, before, after, source)), 6) >= 0.5))
    got = secrets.scan_secrets(docs).collect()
    assert sorted(map(repr, ((x["doc_id"], x["seq"], x["candidate"], x["before"], x["is_secret"]) for x in got))) == sorted(map(repr, want))
    assert secrets.scan_secrets(docs.limit(0)).count() == 0
    assert secrets.scan_secrets(docs.drop("source")).count() == len(want)


def test_secrets_of_findings_made_by_hand(spark):
    lines = [x.split("\t") for x in (Path(__file__).parent / "findings.tsv").read_text().splitlines()]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(lines)], "doc_id long, text string")
    called = {x["doc_id"] for x in secrets.scan_secrets(docs).filter("is_secret").collect()}
    true = {i for i, (label, _) in enumerate(lines) if label == "1"}
    assert len(called & true) >= 0.9 * len(true), sorted(lines[i][1] for i in true - called)
    assert len(called - true) <= 0.1 * (len(lines) - len(true)), sorted(lines[i][1] for i in called - true)


def test_a_long_run_without_keyword_is_scanned_in_time(spark):
    docs = spark.createDataFrame([(1, "x" * 2_000_000), (2, "key" * 500_000)], "doc_id long, text string")
    assert secrets.scan_secrets(docs).count() >= 2


def test_hostile_rows_pass_every_operator(spark):
    docs = table(spark, hostile())
    n = docs.count()
    empty = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.drop_boilerplate(docs).count() == n
    assert licenses.scan_licenses(docs).count() == n
    assert simhash.near_duplicates(docs).count() == n
    assert decontaminate.drop_leaks(docs, empty).count() == n
    got = sorted(map(repr, (tuple(x) for x in substring_dedup.remove_repeats(docs).collect())))
    assert got == sorted(map(repr, brute.removed([t[:2] for t in hostile()])))
