"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, no rows and extra columns."""

import collections
import hashlib
import math
import random
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate, html, katz, licences, neardup, pieces, quality, queries, sharding, sql, substrings, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rnd.choices(words, k=70))
    out = [None, "", "   \n ", "One", "one", "a b", "a b c d e", "ÄÖ ß 🙂 naïve\x0bx", "x " * 3000]
    for _ in range(60):
        base = rnd.choices(words, k=rnd.randint(8, 160))
        out.append(" ".join(base))
        if rnd.random() < 0.5:
            near = list(base)
            near[rnd.randrange(len(near))] = "changed"
            out += [" ".join(near), " ".join(base)]
        if rnd.random() < 0.3:
            out.append(f"{' '.join(base[:20])}\n{passage}\nend {rnd.random()}")
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 2}", len(t or "")) for k, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, DOCS).cache()


def duck(docs, query, **more):
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    for k, v in more.items():
        c.register(k, v.toArrow())
    rel = c.sql(query)
    return rel.columns, rel.fetchall()


def same(df, answer):
    names, rows = answer
    columns = sorted(names)
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rows)


def test_quality_equals_sql(docs):
    found = quality.rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    same(found, duck(docs, sql.quality()))


def test_near_duplicates_equal_sql(docs):
    same(neardup.near_duplicates(docs, 2, 80), duck(docs, sql.near_duplicates()))


def test_hot_near_copies(spark):
    """A large group around the threshold: every link counts, as brute force finds them."""
    rnd = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(150):
        t = list(base)
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(60)] = f"e{rnd.randrange(40)}"
        rows.append((k, " ".join(t), "en", "s", 0))
    df = spark.createDataFrame(rows, DOCS)
    same(neardup.near_duplicates(df, 2, 80), duck(df, sql.near_duplicates()))


def test_short_near_copies_in_long_lists(spark):
    """Texts of 19 words, each linked with its group's first alone (16 of 20 shingles): splits of lists part none."""
    rnd, rows = random.Random(7), []
    for g in range(60):
        base = [f"g{g}w{k}" for k in range(19)]
        texts = [base] + [[*base[:k], f"x{g}.{k}", *base[k + 1 :]] for k in range(1, 18)]
        rows += [" ".join(t) for t in rnd.sample(texts, len(texts))]
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(rows)], DOCS)
    got = {(r.component_id, r["count"]) for r in neardup.near_duplicates(df, 2, 80).groupBy("component_id").count().collect()}
    assert got == {(18 * g, 18) for g in range(60)}


def test_substrings_equal_sql(docs):
    same(substrings.digest(docs, 50), duck(docs, sql.substrings()))


def test_substring_removal_keeps_the_rest(docs):
    kept = {r.doc_id: r.text for r in substrings.remove(docs, 50).collect()}
    want = {r.doc_id: r.kept_sha256 for r in substrings.digest(docs, 50).collect()}
    for k, t in kept.items():
        assert hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() == want[k]


def test_decontamination_equals_sql(spark, docs):
    t = odd_texts()
    items = spark.createDataFrame([(k, x) for k, x in enumerate([None, "", "one", "a, B!", t[12], " ".join(t[20].split()[3:15]), t[12]])], "item_id long, text string")
    same(decontaminate.digest(decontaminate.scan(docs, items)), duck(docs, sql.decontaminate(), benchmark=items))
    same(decontaminate.digest(decontaminate.scan(docs, items, most_words=15)), duck(docs, sql.decontaminate(), benchmark=items))
    left = decontaminate.remove(docs, items, coverage=1.0)
    assert left.columns == docs.columns
    hits = decontaminate.digest(decontaminate.scan(left, items)).filter("n_hit >= 10").count()
    assert hits == 0


def test_decontamination_does_not_depend_on_blocks(spark):
    w = [f"w{k}" for k in range(40)]
    items = spark.createDataFrame([(0, " ".join(w[:20])), (1, " ".join(w[20:])), (2, " ".join(w[11:26]))], "item_id long, text string")
    rows = [(7, " ".join(w)), (7, "other words"), (None, " ".join(w[:12]) + " end"), (None, None), (8, f"a b c d e f g h i j k l m {' '.join(w[5:30])} n o p q r s t")]
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], DOCS)
    one, more = ([sorted(map(repr, f(df, items, most_words=n).collect())) for f in (decontaminate.scan, decontaminate.remove)] for n in (1000, 20))
    assert one == more and len(one[0]) == 5 and len(one[1]) == 3
    assert "text='a b c d e f g h i j k l m  n o p q r s t'" in "".join(one[1])


def test_urls_equal_sql(spark):
    pages = spark.createDataFrame([(0, None), (1, "no scheme"), (2, "HTTP://A.Example.COM/en/x?q#f"), (3, "https://www.example.com/en/1"), (4, "x://b.net/es/"), (5, "x://net"), (5, "x://net"), (6, "https://h.co.uk/a"), (None, "x://c.org/")] + [(k, f"https://bad.example.org/{k}") for k in range(10, 40)], "page_id long, url string")
    labels = spark.createDataFrame([(k, 0 if 10 <= k < 36 else 1, 0) for k in range(2, 40)], "doc_id long, quality int, toxic int")
    bad = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    found = urls.judge(pages, bad, queries.RULES)
    same(found, duck(pages, sql.urls(queries.RULES), pages=pages, labels=labels))
    assert {r.verdict for r in found.filter("host = 'bad.example.org'").collect()} == {"block"}
    many = [("block", f"x{k}.com", "/") for k in range(300)] + queries.RULES
    assert sorted(map(repr, urls.judge(pages, bad, many).collect())) == sorted(map(repr, found.collect()))


def test_suffixes_and_rule_ties(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "x.github.io", "www.ck", "a.b.ck", "ck", "u:p@h.example.com:80", "10.0.0.1:8080", "[::1]", "", "one", "a.b.unknownsuffix", "x.y.com.", "city.kawasaki.jp", "b.c.kawasaki.jp")], "host string")
    got = {r.host: (r.domain, r.suffix) for r in urls.with_domains(hosts, urls.public_suffixes(spark)).collect()}
    assert len(got) == 14 and len(urls.public_suffixes(spark)) > 5000
    assert got["a.b.co.uk"] == ("b.co.uk", "co.uk") and got["x.github.io"] == ("x.github.io", "github.io")
    assert got["www.ck"] == ("www.ck", "ck") and got["a.b.ck"] == ("a.b.ck", "b.ck") and got["ck"] == ("ck", "ck")
    assert got["u:p@h.example.com:80"] == ("example.com", "com") and got["10.0.0.1:8080"] == ("10.0.0.1", "10.0.0.1") and got["[::1]"] == ("[::1]", "[::1]")
    assert got["city.kawasaki.jp"] == ("city.kawasaki.jp", "kawasaki.jp") or got["city.kawasaki.jp"] == ("city.kawasaki.jp", "jp")
    assert got["b.c.kawasaki.jp"] == ("b.c.kawasaki.jp", "c.kawasaki.jp") and got["x.y.com."] == ("y.com", "com") and got["one"] == ("one", "one")
    assert {r.host: r.suffix for r in urls.with_domains(hosts, ()).collect()}["a.b.co.uk"] == "uk"
    pages = spark.createDataFrame([(1, "http://b.a.com/bbbb"), (2, "http://a.com/b"), (3, "http://c.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    ties = [("block", "a.com", "/b"), ("allow", "com", "/bbb"), ("block", "c.com", "/"), ("allow", "c.com", "/")]
    few, many = (sorted(map(tuple, urls.judge(pages, none, ties + more).collect())) for more in ([], [("block", f"x{k}.com", "/") for k in range(300)]))
    assert few == many and [r[3:] for r in few] == [("a.com/b", "block"), ("a.com/b", "block"), ("c.com/", "allow")]
    assert urls.judge(pages.limit(0), none, ties).count() == 0


def test_sharding_is_even_gapless_and_keeps_groups(docs):
    rows = sharding.shard(docs, 5).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id].encode()) + 8, zlib.crc32(text[r.doc_id].encode()), "rows", None)
    sizes = [len(by[k]) for k in range(5)]
    assert len(rows) == len(text) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    groups = collections.defaultdict(set)
    for r in rows:
        groups[text[r.doc_id]].add(r.shard)
    assert max(map(len, groups.values())) == 1


def test_sharding_of_one_hot_group(spark):
    df = spark.range(90).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 60, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.shard(df, 4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in rows) == [22, 22, 23, 23]


def katz_by_hand(texts):
    docs = {k: (t or "").encode().lower().split() + [b" end"] for k, t in texts.items()}
    train = [k for k in docs if zlib.crc32(str(k).encode()) % 5 != 1]
    pairs = lambda k: zip([b" end", *docs[k][:-1]], docs[k], strict=True)
    uni = collections.Counter(w for k in train for w in docs[k])
    bi = collections.Counter(p for k in train for p in pairs(k))
    n, v = sum(uni.values()), len(uni)
    d1, d2 = (katz.discounts(collections.Counter(c.values())) for c in (uni, bi))
    cut = lambda c, d: c * (d[c - 1] if c <= katz.K else 1.0)
    p = {w: cut(c, d1) / n for w, c in uni.items()}
    unknown = 1 - math.fsum(p.values())
    seen = collections.defaultdict(dict)
    for (a, b), c in bi.items():
        seen[a][b] = cut(c, d2) / uni[a]
    for a, s in seen.items():
        if math.fsum(s.values()) > 1 - 1e-9:
            seen[a] = {w: q * uni[a] / (uni[a] + 1) for w, q in s.items()}
    alpha = {a: (1 - math.fsum(s.values())) / (1 - math.fsum(p[w] for w in s)) for a, s in seen.items()}
    for a in list(seen)[:20]:
        rest = unknown + math.fsum(q for w, q in p.items() if w not in seen[a])
        assert abs(math.fsum(seen[a].values()) + alpha[a] * rest - 1) < 1e-9
    out = {}
    for k, words in docs.items():
        score = sum(math.log10(seen.get(a, {}).get(b) or alpha.get(a, 1) * p.get(b, unknown)) for a, b in pairs(k))
        base = sum(math.log10((uni.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out[k] = (len(words), sum(w in uni for w in words), n, base, score)
    return out


@pytest.mark.parametrize("hot", [50_000, 100, 0])
def test_katz_equals_brute_force(docs, monkeypatch, hot):
    """With every word among the frequent ones, with some, and with none."""
    monkeypatch.setattr(katz, "HOT", hot)
    want = katz_by_hand({r.doc_id: r.text for r in docs.collect()})
    rows = katz.score(docs).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        got, real = (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), want[r.doc_id]
        assert got[:3] == real[:3]
        assert got[3:] == pytest.approx(real[3:], rel=1e-6, abs=1e-3)  # 3,000 times a pair of 7 digits


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(queries.MODEL)


def test_pieces_round_trip(spark, docs):
    enc = pieces.encode(docs, queries.MODEL, k=3)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pieces.decode(enc, queries.MODEL).collect()
    assert all(r.round_trip and r.text == text[r.doc_id] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r["rank"], r.perturbed, tuple(r.ids), r.inclusion))
    assert set(by) == set(text)
    for v in by.values():
        v.sort()
        assert len({x[2] for x in v}) == len(v)
        assert all(a[1] >= b[1] for a, b in zip(v, v[1:], strict=False)) and all(0 < x[3] <= 1 for x in v)


def test_html_cases(spark):
    page = lambda body: f"<html><head><title>t</title><script>var a='</p>';</script></head><body>{body}</body></html>"
    rows = [
        (0, "http://a.com/x/1", page("<nav>menu</nav><article><h1>T&amp;u</h1><p>one <b>b</b>old<br>two<p>three&nbsp;x</article><footer>f</footer>")),
        (1, "http://b.com/x/1", page("<div class='site-top'>Site</div><p>first story of the day</p><div>Foot</div>")),
        (2, "http://b.com/x/2", page("<div class='site-top'>Site</div><p>second story, longer than that</p><div>Foot</div>")),
        (3, None, None),
        (4, "http://a.com/x/2", ""),
        (5, "http://c.com/x", page("<main><p>kept</p><div class='comments'>no</div><form>no</form></main>")),
        (6, "http://d.com/x", "<article><p>cut off"),
    ]
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)).collect()}
    want = {0: "T&u one bold two three x", 1: "first story of the day", 2: "second story, longer than that", 3: "", 4: "", 5: "kept", 6: "cut off"}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def html_texts(spark, rows, *n):
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), *n).collect()
    assert len(got) == len(rows)
    return {r.page_id: r.text for r in got}


def test_html_differs_inside_the_container(spark):
    """What both sides have goes, if it is little; what one side has stays, and nothing comes in from outside."""
    page = lambda h, *x: f"<p>top</p><article><h1>{h}</h1><p>Share this</p>{''.join(f'<p>{y}</p>' for y in x)}</article><p>only {h}</p><div class='more-stories'><p>teaser of {h}</p></div>"
    story = {k: [f"{w} sentence of story {k} {'and so on ' * 4}" for w in ("first", "second")] for k in range(5)}
    story[2].append("a sentence that its neighbour has")
    story[3].append("a sentence that its neighbour has")
    rows = [(k, f"http://a.com/{k}", page(f"Title {k}", *story[k])) for k in range(5)] + [(9, "http://b.com/1", page("Alone", "some text"))]
    got = html_texts(spark, rows)
    text = lambda k, *more: " ".join(" ".join([f"Title {k}", *more, *story[k]]).split())
    assert got == {0: text(0, "Share this"), 1: text(1), 2: text(2), 3: text(3), 4: text(4, "Share this"), 9: "Alone Share this some text"}


def test_html_keeps_versions_of_an_article_whole(spark):
    """Updated, syndicated and continued articles beside each other lose nothing."""
    parts = [f"paragraph {k} {'word ' * 15}".strip() for k in range(10)]
    page = lambda h, *x: f"<div>Site</div><article><h1>{h}</h1>{''.join(f'<p>{y}</p>' for y in x)}</article>"
    rows = [(1, "http://a.com/1", page("Early", *parts)), (2, "http://a.com/2", page("Late", *parts[:9], "changed")), (3, "http://a.com/3", page("Latest", *parts[:8], "changed", "again"))]
    rows += [(4, "http://b.com/1", page("Early", *parts)), (5, "http://b.com/2", page("Late", *parts[1:]))]
    got = html_texts(spark, rows)
    assert got == {1: " ".join(["Early", *parts]), 2: " ".join(["Late", *parts[:9], "changed"]), 3: " ".join(["Latest", *parts[:8], "changed", "again"]), 4: " ".join(["Early", *parts]), 5: " ".join(["Late", *parts[1:]])}
    bare = lambda *x: "<div>Site</div>" + "".join(f"<p>{y}</p>" for y in x)
    got = html_texts(spark, [(1, "http://a.com/1", bare(*parts)), (2, "http://a.com/2", bare(*parts[:9], "changed")), (3, "http://b.com/1", bare(*parts)), (4, "http://b.com/2", bare(*parts[:9], "changed")), (5, "http://b.com/3", bare("another story"))])
    assert got == {1: " ".join(["Site", *parts]), 2: " ".join(["Site", *parts[:9], "changed"]), 3: " ".join(["Site", *parts]), 4: " ".join([*parts[:9], "changed"]), 5: "another story"}


def test_html_equals_brute_force(spark):
    """The whole operator against sorted pages, a table of common subsequences and the same rules, on pages of few
    different lines, with null and repeated ids and urls, other columns and no html."""
    rnd = random.Random(5)
    rows = []
    for k in range(150):
        own = [f"{rnd.choice('abcdefgh')} {'w ' * rnd.choice([0, 0, 14])}".strip() for _ in range(rnd.randint(0, 7))]
        cut = rnd.choice([0, len(own)])
        body = "".join(f"<p>{t}</p>" for t in own[:cut]) + f"<article>{''.join(f'<p>{t}</p>' for t in own[cut:])}</article>" * (cut < len(own))
        rows.append((rnd.choice([k, k, k // 2, None]), rnd.choice([f"http://h{k % 5}.com/{rnd.randint(0, 30)}", f"http://h{k % 5}.com/{rnd.randint(0, 30)}", None]), rnd.choice([body, body, body, None])))
    got = html.extract(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, at int"), 7).collect()

    def places(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    key = lambda r: ((r[1] or "").split("/")[2] if r[1] else "", "/" + r[1].split("/")[3] if r[1] else "", -(1 << 63) if r[0] is None else r[0], r[1] is not None, r[1] or "", [t for t, _ in html.lines(r[2] or "")], [m for _, m in html.lines(r[2] or "")])
    order, want = sorted(rows, key=key), []
    for k, r in enumerate(order):
        own = html.lines(r[2] or "")
        beside = [html.lines(order[j][2] or "") for j in (k - 1, k + 1) if 0 <= j < len(order) and key(order[j])[0] == key(r)[0]]
        beside = [x for x in beside if x]
        for x in beside:
            assert len(html.shared([t for t, _ in own], [t for t, _ in x])) == places([t for t, _ in own], [t for t, _ in x])
        want.append((r[0], r[1], html.main_text(own, *beside)))
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in got)


def test_html_short_story_under_long_menus(spark):
    site = "".join(f"<div>{'menu entry ' * 5}{k}</div>" for k in range(20))
    got = html_texts(spark, [(k, f"http://a.com/{k}", f"{site}<p>story {k}</p>{site}") for k in range(1, 4)] + [(4, "http://a.com/3", f"{site}<p>story 3</p>{site}")])
    assert {k: got[k] for k in (1, 2, 3)} == {k: f"story {k}" for k in (1, 2, 3)} and "menu entry" in got[4]


def test_html_texts_do_not_depend_on_ranges(spark):
    rows = [(k, f"http://h{k // 11}.com/{k:03}", f"<div>Site {k // 11}</div><p>story {k}</p><div>Foot</div>") for k in range(80)]
    few, many = (html_texts(spark, rows, n) for n in (1, 60))
    assert few == many == {k: f"story {k}" for k in range(80)}


def test_lcs_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
        assert len(html.shared(a, b)) == m[-1][-1]


def prose(rnd, n):
    words = "the a of and to in story river city was were on with it they many old new house road public general work free text copy file use".split()
    return " ".join(rnd.choice(words) for _ in range(n))


def test_licences(spark):
    rnd = random.Random(11)
    rows = [(0, None), (1, ""), (2, "Some text.\nReleased under the MIT License.\nMore."), (3, "Licensed under the Apache License, Version 2.0."), (4, "You need a driving license for this."), (5, "plain"), (5, "plain"),
            (6, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."), (None, "Released under the MIT License."), (7, "one\n\n \t\n//\ntwo\n...\n")]
    rows += [(k, prose(rnd, rnd.randint(5, 400))) for k in range(10, 90)] + [(90, " ".join(["word"] * 30000) + " Released under the MIT License.")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, row string, par int")
    got = licences.scan(df).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got}
    assert {k: found[k].families for k in (2, 3, 6, 90, None)} == {2: "MIT", 3: "Apache-2.0", 6: "CC-BY-NC-4.0,GPL", 90: "MIT", None: "MIT"}
    assert all(r.families == "" and r.licence is None for k, r in found.items() if k not in (2, 3, 6, 90, None))
    assert (found[0].n_paragraphs, found[1].n_paragraphs, found[2].n_paragraphs, found[7].n_paragraphs) == (0, 0, 1, 2)


def test_licences_of_wrapped_notices(spark):
    """Every notice, broken at 75 columns under each comment mark, below other lines; and inside prose without marks."""
    rnd = random.Random(12)
    rows = [(-k, None, prose(rnd, 200)) for k in range(1, 150)]
    for family, notices in licences.NOTICES.items():
        for n in notices:
            for mark in ("", "# ", " * ", "// "):
                body = "\n".join(mark + x for x in textwrap.wrap(n, 75))
                rows.append((len(rows), family, f"{mark}Copyright (c) 2021 A. Author\n{mark.rstrip()}\n{body}\n{mark}\nint main() {{ return 0; }}"))
    df = spark.createDataFrame(rows, "doc_id long, family string, text string")
    got = df.select("doc_id", "family").join(licences.scan(df), "doc_id").collect()
    known = [r for r in got if r.family]
    right = sum(r.licence == r.family for r in known)
    assert right >= 0.95 * len(known) and all(r.licence in (r.family, None) for r in known)
    assert not any(r.families for r in got if not r.family)


def test_licence_classifier_on_unseen_wordings(spark):
    rnd = random.Random(13)
    df = spark.createDataFrame([(k, prose(rnd, 150)) for k in range(150)], "doc_id long, text string")
    model = licences.Classifier(df, licences.stage(licences.notice_table(spark), "notices"))
    assert model.accuracy[0] >= 0.85 and model.accuracy[1] >= 0.97
    curve = lambda m: 1 / (1 + math.exp(-(model.slope * m + model.shift)))
    assert curve(-8) < 0.25 and curve(8) > 0.9


def test_licence_confirmation_equals_brute_force(spark):
    rnd = random.Random(14)
    notices = licences.stage(licences.notice_table(spark), "notices")
    rows = []
    for k in range(60):
        w = [w for n in rnd.choices(sum(licences.NOTICES.values(), []), k=2) for w in licences.words_of(n)]
        rows.append((k, " ".join(x for x in w if rnd.random() < 0.93)))
    features = spark.createDataFrame([], "g long, f int")
    hit = licences.hits(spark.createDataFrame([(k, k, t) for k, t in rows], "row long, doc_id long, text string"), features, notices)
    got = {(r.row, licences.CLASSES[r.y]): r.share for r in licences.confirmed(hit, notices).collect()}
    triples = lambda t: set(licences._triples(t))
    families = collections.defaultdict(set)
    for c, ns in licences.NOTICES.items():
        for n in ns:
            for t in triples(n):
                families[t].add(c)
    want = {}
    for k, text in rows:
        w = licences.words_of(text)
        here = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        for c, ns in licences.NOTICES.items():
            for n in ns:
                ts = triples(n)
                own = {t for t in ts if len(families[t]) == 1}
                share = min(len(ts & here) / len(ts), len(own & here) / len(own) if own else 1.0)
                if share >= licences.CONFIRM:
                    want[k, c] = max(share, want.get((k, c), 0))
    assert got == pytest.approx(want) and len(got) > 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (quality.rules(none), neardup.near_duplicates(none), substrings.digest(none), decontaminate.digest(decontaminate.scan(none, items)), katz.score(none), sharding.shard(none), pieces.encode(none, queries.MODEL), licences.scan(none)):
        assert df.count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extra_columns_stay(docs):
    more = docs.withColumn("rep", F.lit(1)).withColumn("root", F.lit(2)).withColumn("bucket", F.lit("b"))
    own = ["rep", "root", "bucket", "kept", "t_lang", "q_n_words", "base_failed", "repeat_keys", "doc", "hits", "items", "n", "key", "a b", "row", "node"]
    for c in own[3:]:
        more = more.withColumn(c, F.lit(c))
    items = docs.sparkSession.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    want = {r.doc_id: r for r in more.collect()}
    for f in (quality.keep, neardup.keep, substrings.remove, lambda d: decontaminate.remove(d, items)):
        rows = f(more).collect()
        assert rows and rows[0].__fields__ == more.columns
        assert all(r[c] == want[r.doc_id][c] for r in rows for c in (*own, "lang", "source"))
    for f in (quality.rules, neardup.near_duplicates, substrings.digest, sharding.shard, katz.score, lambda d: decontaminate.scan(d, items)):
        assert f(more).count() == len(want)


def test_null_ids_are_rows(spark):
    """Rows without a doc_id, also of equal texts, are rows of every result."""
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(None, long), (None, long), (None, None), (1, long), (2, long), (2, "another text under one id " * 3)]
    df = spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], DOCS)
    for f in (sharding.shard, quality.rules, neardup.near_duplicates, katz.score, substrings.digest):
        assert f(df).count() == len(rows), f
    assert pieces.encode(df, queries.MODEL, k=1).count() == len(rows)
    near = neardup.near_duplicates(df).filter("doc_id is null").collect()
    assert [(r.component_id, r.kept) for r in near] == [(None, True)] * 3 and sorted(r.n_shingles for r in near) == [0, 76, 76]
    assert neardup.keep(df).filter("doc_id is null").count() == 3
    gone = {(r.doc_id, r.n_removed) for r in substrings.digest(df).collect()}
    assert (None, 0) in gone and (2, 80) in gone and (1, 0) in gone


def test_sharding_cuts_few_links(docs, spark):
    """Every group that fits stays whole: no assignment of even sizes cuts fewer links here."""
    got = sharding.cut_links(sharding.shard(docs, 5)).first()
    assert got.groups > 10 and got.cut_links == got.split_groups == 0
    big = spark.range(90).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 60, "same").otherwise(F.col("id").cast("string")).alias("text"))
    assert sharding.cut_links(sharding.shard(big, 4)).first().cut_links == 60 - 23  # a shard holds 23 at most


def test_quality_thresholds_come_from_sketches(docs):
    """Every threshold follows the quartiles of its own group: other texts, other thresholds."""
    counted = quality.with_counts(docs.select("doc_id", "lang", "source", "text"), prefix="")
    one = quality.thresholds(counted, least=5).collect()
    more = quality.thresholds(counted.withColumn("word_chars", F.col("word_chars") * 2), least=5).collect()
    assert all(b.t_word_len_percent > a.t_word_len_percent for a, b in zip(sorted(one, key=repr), sorted(more, key=repr), strict=True))
    assert len({r.t_repeat_permille for r in one} | {r.t_word_len_percent for r in one}) > 2


def segmentations(word, voc):
    """(ids, weight) of all segmentations of a unit, by recursion over its characters."""
    piece = {b: i for i, b in enumerate(voc.bytes) if i not in set(voc.byte_ids.tolist()) and b}
    text = word.encode()

    def go(at):
        if at == len(text):
            yield (), 0.0
        for e in range(at + 1, len(text) + 1):
            if text[at:e] in piece:
                i = piece[text[at:e]]
                yield from (((i, *ids), voc.weight[i] + w) for ids, w in go(e))
        size = len(text[at:].decode()[0].encode()) if at < len(text) else 0
        if size and text[at : at + size] not in piece:
            spelt = tuple(voc.byte_ids[b] for b in text[at : at + size])
            yield from (((*spelt, *ids), size * voc.weight[-1] + w) for ids, w in go(at + size))

    return list(go(0))


def test_pieces_are_a_sample_without_replacement(vocabulary):
    """Ordered pairs and inclusion against all segmentations of a text, weighted by hand."""
    per_unit = [segmentations(u, vocabulary) for u in (" of", "\n", " é𐍈")]
    whole = [((*a, *b, *c), x + y + z) for a, x in per_unit[0] for b, y in per_unit[1] for c, z in per_unit[2]]
    total = np.logaddexp.reduce([w for _, w in whole])
    p = {tuple(map(int, ids)): math.exp(w - total) for ids, w in whole}
    assert 3 < len(p) < 300
    n, k = 40000, 3
    lat = pieces.Lattices(vocabulary)
    run = lat.read(" of\n é𐍈")
    lat.build()
    keys = pieces.mix(np.arange(n).astype(np.uint64))
    found, threshold = pieces.sample(lat, np.tile(run, n), np.arange(n + 1) * len(run), keys, k)
    drawn = []
    for x in found:
        assert len(x.doc) == n
        ids, counts = pieces._ids(lat, x)
        drawn.append([tuple(c.tolist()) for c in np.split(ids, np.cumsum(counts)[:-1])])
        assert [round(math.log(p[i]), 3) for i in drawn[-1][:500]] == np.round(x.log_prob[:500], 3).tolist()
    assert all(len(set(t)) == k for t in zip(*drawn, strict=True))
    got = collections.Counter(zip(drawn[0], drawn[1], strict=True))
    for (a, b), c in got.most_common(12):
        assert c / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.012)
    third = collections.Counter(zip(*drawn, strict=True))
    for (a, b, d), c in third.most_common(5):
        assert c / n == pytest.approx(p[a] * p[b] / (1 - p[a]) * p[d] / (1 - p[a] - p[b]), abs=0.012)
    # sums weighted by 1 / inclusion are unbiased: here of 1 and of the number of pieces, over all segmentations
    sure = [-np.expm1(-np.exp(x.log_prob - threshold)) for x in found]
    ones = sum(np.exp(x.log_prob) / s for x, s in zip(found, sure, strict=True))
    assert ones.mean() == pytest.approx(1, abs=0.02)
    length = sum(np.exp(x.log_prob) / s * np.array(list(map(len, d))) for x, s, d in zip(found, sure, drawn, strict=True))
    assert length.mean() == pytest.approx(sum(q * len(ids) for ids, q in p.items()), rel=0.02)


def test_pieces_give_all_segmentations_of_short_texts(spark, vocabulary):
    """Fewer than k: each once, with inclusion 1; repeated rows draw alike."""
    want = {tuple(map(int, ids)) for ids, _ in segmentations(" of", vocabulary)}
    rows = pieces.encode(spark.createDataFrame([(1, "of"), (1, "of"), (None, "of")], "doc_id long, text string"), queries.MODEL, k=50).collect()
    assert len(rows) == 3 * len(want) and {tuple(r.ids) for r in rows} == want
    assert all(r.inclusion == 1 and r.round_trip for r in rows)
    assert len({(r["rank"], tuple(r.ids), r.perturbed) for r in rows if r.doc_id}) == len(want)


def test_pieces_of_long_texts_without_spaces(spark, monkeypatch):
    text = "".join(chr(0x4E00 + (k * k) % 9000) for k in range(200_000)) + "QUJD" * 100_000
    df = spark.createDataFrame([(1, text), (2, "a b"), (3, text)], "doc_id long, text string")
    one = {(r.doc_id, r["rank"]): (r.round_trip, r.n_pieces, r.perturbed) for r in pieces.encode(df, queries.MODEL).drop("ids").collect()}
    assert len(one) == 6 and all(v[0] for v in one.values()) and one[1, 0][1:] != one[3, 0][1:]


def test_pieces_do_not_depend_on_what_is_remembered(docs, monkeypatch):
    rows = lambda: sorted(map(repr, pieces.encode(docs, queries.MODEL).collect()))
    one = rows()
    voc, held = pieces.Vocabulary(queries.MODEL), [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    lat, got = pieces.Lattices(voc), []
    for h in held:
        for batch in pieces._encode([h], lat, 2, 1):
            got += [(r["doc_id"], r["rank"], r["ids"]) for r in batch.to_pylist()]
        lat.forget()
    assert len(one) == len(got)
    assert sorted((d, k, i) for d, k, i in got) == sorted((r.doc_id, r["rank"], r.ids) for r in pieces.encode(docs, queries.MODEL).collect())
