"""Merkle manifest, URL reputation and phrase collocations against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalforge.llm import collocations as co
from evalforge.llm import merkle as mk
from evalforge.llm import urlrep as ur

from .conftest import SCHEMA, nasty_rows


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---------------------------------------------------------------- Merkle manifest

def leaf_of(row, bump=0):
    doc_id, text, lang, source, n_chars = row
    fields = (doc_id, source, lang, n_chars + bump if n_chars is not None else None, text)
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def brute_manifest(rows, fanout):
    def reduced(nodes):
        """Root and, for each leaf, its steps (place, siblings)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
            for k, i in enumerate(at):
                run = runs[i // fanout]
                paths[k].append((i % fanout, run[:i % fanout] + run[i % fanout + 1:]))
            at = [i // fanout for i in at]
            nodes = [H("".join(r)) for r in runs]
        return nodes[0], paths
    out, trees = [], {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    subs = {}
    for lang, docs in trees.items():
        docs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subs[lang] = reduced([leaf_of(r) for r in docs])
    order = sorted(subs, key=lambda x: (x is not None, (x or "").encode()))
    root, above = reduced([subs[x][0] for x in order])
    for k, lang in enumerate(order):
        for r, path in zip(trees[lang], subs[lang][1]):
            steps = path + above[k]
            touched = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf_of(r, 1) if touched else leaf_of(r)
            for place, others in steps:
                h = H("".join(others[:place] + [h] + others[place:]))
            out.append((r[0] if r[0] is not None else -99, leaf_of(r), subs[lang][0], root,
                        H("".join(d for _, o in steps for d in o)), h, h == root))
    return sorted(out)


def manifest_rows(docs, **how):
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "siblings", "folded")]
    got = mk.merkle_manifest(docs, **how).select(F.coalesce("doc_id", F.lit(-99)).alias("doc_id"), *hexed, "verified").collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("fanout,levels", [(2, 12), (2, 2), (3, 1)])
def test_manifest_nasty(spark, nasty, fanout, levels):
    assert manifest_rows(nasty, fanout=fanout, levels=levels) == brute_manifest(nasty_rows(), fanout)


def test_manifest_large_tree_many_layers(spark):
    rows = [(i * 3, f"text {i % 17}", "en" if i % 3 else f"l{i % 7}", "s", i) for i in range(700)] + [(5, "x", "en", "s", 1)] * 40
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = manifest_rows(docs, levels=3)
    assert got == brute_manifest(rows, 2)
    bad = [r for r in got if not r[-1]]
    assert bad and all(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in bad)


def test_manifest_of_one_and_none(spark, empty):
    assert manifest_rows(empty) == []
    row = [(1, "a", None, None, None)]
    (only,) = manifest_rows(spark.createDataFrame(row, SCHEMA))
    assert only == brute_manifest(row, 2)[0] and only[1] == only[2] == only[3] == only[5] and only[4] == H("")


def test_label_queue_spills_and_merges():
    rng, sent = random.Random(1), []
    with mk.LabelQueue(room=7) as q:
        for _ in range(500):
            m = (rng.randrange(60), rng.randrange(4), bytes([rng.randrange(256)]) * rng.randrange(5))
            q.push(*m)
            sent.append(m)
        assert len(q.runs) > 10
        for label in range(60):
            assert sorted(q.pop(label)) == sorted((p, d) for lab, p, d in sent if lab == label)


def test_sweeps_do_not_depend_on_the_room():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(53)]
    for fanout in (2, 5):
        deep = mk.depth(53, fanout)
        root, took = mk.forward(leaves, deep, fanout)
        assert (root, took) == mk.forward(leaves, deep, fanout, room=3)
        proofs = mk.reversed_sweep(53, took, b"", deep, fanout)
        assert proofs == mk.reversed_sweep(53, took, b"", deep, fanout, room=3)
        assert all(mk.fold(d, p) == root for d, p in zip(leaves, proofs))
        assert mk.fold(leaves[0], proofs[1]) != root


# ---------------------------------------------------------------- URL reputation

PAGES = "page_id long, url string"
LABELS = "doc_id long, quality int, toxic int"


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.ORG/en/12?x=/es/#y": ("a.example.org", "/en/12", "example.org/en/1"),
        "https://example.org/es/": ("example.org", "/es/", "example.org/es/"), "x://notexample.org/es/1": ("notexample.org", "/es/1", "org/"),
        "http://org": ("org", "", None), "http://x.org#/a": ("x.org", "", None), "ftp://a.com/fr/x": ("a.com", "/fr/x", "com/fr/"),
        "http://a.com/de/x://b.org/": ("a.com", "/de/x://b.org/", "com/de/"), "no scheme": ("", "", None), None: ("", "", None), "": ("", "", None),
        "http://ÄÉ.com/É?": ("ÄÉ.com", "/É", None), "://?": ("", "", None), "http://" + "a." * 5000 + "org/" + "x" * 9000: ("a." * 5000 + "org", "/" + "x" * 9000, "org/"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    host, path = ur.url_parts(F.col("url"))
    got = df.select("url", host.alias("h"), path.alias("p")).select("url", "h", "p", ur.fitting_rule(F.col("h"), F.col("p"))["rule"].alias("r"))
    assert {r["url"]: (r["h"], r["p"], r["r"]) for r in got.collect()} == cases


def test_domains(spark):
    cases = {"a.b.example.org": ("example.org", "org"), "x.co.uk": ("x.co.uk", "co.uk"), "a.b.co.uk:80": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
             "u@h.net.": ("h.net", "net"), "10.0.0.1": ("10.0.0.1", ""), "local": ("local", "local"), "": ("", ""), "ab.de": ("ab.de", "de"), "uk": ("uk", "uk")}
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    d, s = ur.host_family(F.col("h"))
    got = {r[0]: (r[1], r[2]) for r in df.select("h", d, s).collect()}
    assert got == cases


def brute_weight(children):
    """Weight of the parents from (parent, n, k) of each child, by analysis of variance written out."""
    fam = {}
    for p, n, k in children:
        if n:
            fam.setdefault(p, []).append((n, k))
    every = [c for f in fam.values() for c in f]
    total = sum(n for n, _ in every)
    between, within = len(every) - len(fam), total - len(every)
    if between <= 0:
        return ur.LEAST_WEIGHT
    if within <= 0:
        return ur.MOST_WEIGHT
    ssb = sum(n * (k / n - sum(b for _, b in f) / sum(a for a, _ in f)) ** 2 for f in fam.values() for n, k in f)
    ssw = sum(k * (1 - k / n) ** 2 + (n - k) * (k / n) ** 2 for n, k in every)
    n0 = (total - sum(sum(n * n for n, _ in f) / sum(n for n, _ in f) for f in fam.values())) / between
    msb, msw = ssb / between, ssw / within
    rho = (msb - msw) / (msb + (n0 - 1) * msw) if msb + (n0 - 1) * msw > 0 else 0
    return min(ur.MOST_WEIGHT, max(ur.LEAST_WEIGHT, (1 - rho) / rho)) if rho > 0 else ur.MOST_WEIGHT


def reputation_fixture(spark):
    rng, pages, labels = random.Random(4), [], []
    bad = {"spam.farm.org": 0.95, "a.good.org": 0.05, "b.good.org": 0.1, "c.good.org": 0.02, "pills.farm.org": 0.9, "x.mid.com": 0.4, "y.mid.com": 0.3}
    i = 0
    for host, rate in bad.items():
        for _ in range(60):
            pages.append((i, f"https://{host}/p/{i}"))
            if rng.random() < 0.7:
                labels.append((i, int(rng.random() >= rate), 0))
            i += 1
    pages += [(i + 1, "https://new.farm.org/p"), (i + 2, "https://new.good.org/p"), (i + 3, "http://unlucky.good.org/p"), (i + 4, None), (None, "http://a.good.org/z")]
    labels += [(i + 3, 0, 1), (None, 0, 1), (0, None, None)]
    return pages, labels, spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS).withColumn("host", F.lit("own"))


def test_reputation_by_hand(spark):
    pages, labels, p, q = reputation_fixture(spark)
    got = {r["page_id"]: r for r in ur.filter_urls(p, q, rules=()).collect()}
    lab = {d: int(quality == 0 or toxic == 1) for d, quality, toxic in labels if d is not None and not (quality is None and toxic is None)}
    hosts = {}
    for page_id, url in pages:
        h = url.split("://")[1].split("/")[0] if url else ""
        n, k = hosts.get(h, (0, 0))
        hosts[h] = (n + (page_id in lab), k + lab.get(page_id, 0))
    dom = lambda h: ".".join(h.split(".")[-2:])
    suf = lambda d: d.split(".")[-1]
    domains, suffixes = {}, {}
    for h, (n, k) in hosts.items():
        for at, key in ((domains, dom(h)), (suffixes, suf(h))):
            a, b = at.get(key, (0, 0))
            at[key] = (a + n, b + k)
    s1 = brute_weight([("", n, k) for n, k in suffixes.values()])
    s2 = brute_weight([(suf(d), n, k) for d, (n, k) in domains.items()])
    s3 = brute_weight([(dom(h), n, k) for h, (n, k) in hosts.items()])
    N, K = sum(n for n, _ in hosts.values()), sum(k for _, k in hosts.values())
    for page_id, url in pages:
        h = url.split("://")[1].split("/")[0] if url else ""
        m = (K + 0.5) / (N + 1)
        for s, (n, k) in ((s1, suffixes[suf(h)]), (s2, domains[dom(h)]), (s3, hosts[h])):
            m = (s * m + k) / (s + n)
        r = got[page_id]
        assert (r["n_labelled"], r["n_bad"]) == hosts[h]
        assert r["bad_rate"] == pytest.approx(m, rel=1e-6)
        assert r["verdict"] == ("block" if r["bound"] > ur.LIMIT else "allow") and r["rule"] is None
    by_host = {r["host"]: r["verdict"] for r in got.values()}
    assert by_host["spam.farm.org"] == by_host["pills.farm.org"] == "block"
    assert all(by_host[h] == "allow" for h in ("a.good.org", "b.good.org", "c.good.org", "new.good.org", "unlucky.good.org", "x.mid.com", ""))


@pytest.mark.parametrize("a,b", [(1, 1), (2, 5), (5, 2), (8, 8), (30, 10), (200, 100), (3000, 4000)])
def test_bound_is_near_the_beta_quantile(spark, a, b):
    """The posterior lies below the bound with a chance of some 5 %, by numerical integration."""
    bound = spark.sql(f"select {ur.lower_bound('a', 'b', ur.Z)} from (select cast({a} as double) a, cast({b} as double) b)").first()[0]
    x = np.linspace(0, 1, 2_000_001)[1:-1]
    log = (a - 1) * np.log(x) + (b - 1) * np.log(1 - x)
    p = np.exp(log - log.max())
    assert p[x < bound].sum() / p.sum() == pytest.approx(0.05, abs=0.01)


def test_reputation_without_labels_or_pages(spark):
    pages, _, p, q = reputation_fixture(spark)
    none = q.limit(0)
    got = ur.filter_urls(p, none).collect()
    assert len(got) == len(pages) and all(r["n_labelled"] == 0 and r["bad_rate"] == pytest.approx(0.5) for r in got)
    assert all(r["verdict"] == "allow" for r in got if r["rule"] is None)
    assert ur.filter_urls(p.limit(0), q).count() == 0


def test_reputation_hot_host_and_repeats(spark):
    rows = [(i % 50, "http://hot.org/x") for i in range(600)] + [(1000 + i, f"http://h{i}.org/x") for i in range(30)]
    labels = [(i, i % 2, 0) for i in range(50)] * 2
    got = ur.filter_urls(spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, LABELS), rules=()).collect()
    assert Counter(r["host"] for r in got)["hot.org"] == 600
    assert {(r["n_labelled"], r["n_bad"]) for r in got if r["host"] == "hot.org"} == {(1200, 600)}


# ---------------------------------------------------------------- collocations

def brute_collocations(rows, least, top, inside=80):
    counts, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                counts.update((lang, *w[i:i + m]) for i in range(len(w) - m + 1))
    known = {k: v for k, v in counts.items() if v >= least}
    out = {}
    for (lang, *w), a in known.items():
        if len(w) < 2:
            continue
        cut = min((2_000_000 * a // (counts[(lang, *w[:k])] + counts[(lang, *w[k:])]), k) for k in range(1, len(w)))
        longer = [v for (g, *x), v in known.items() if g == lang and len(x) > len(w) and any(x[i:i + len(w)] == w for i in range(len(x)))]
        if any(100 * v >= inside * a for v in longer):
            continue
        k = cut[1]
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), counts[(lang, *w[:k])], counts[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def phrase_rows():
    rng, rows = random.Random(11), []
    words = "the of new york city Über a b été x".split()
    for i in range(300):
        text = ""
        for _ in range(rng.randrange(60)):
            text += rng.choice(["new york city ", "New York ", "a a a a ", "of the", " the", "\tx ", rng.choice(words) + " ", ". ", ",", "\n", " \u00a0 ", f"w{rng.randrange(40)} "])
        rows.append((i, text, rng.choice(["en", "en", "fr", None]), "s", 0))
    return rows + rows[:20]


def collocation_rows(docs, **how):
    return sorted(tuple(r) for r in co.collocations(docs, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least,top,size", [(5, 2000, 1 << 20), (3, 7, 700), (30, 2000, 5000)])
def test_collocations_by_hand(spark, least, top, size):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"n": F.lit("own"), "shard": F.lit("own")})
    want = brute_collocations(rows, least, top)
    assert want and collocation_rows(docs, least=least, top=top, size=size) == want


def test_collocations_nasty(spark, nasty, empty):
    assert collocation_rows(nasty, least=2) == brute_collocations(nasty_rows(), 2, 2000)
    assert collocation_rows(empty) == []
    assert collocation_rows(spark.createDataFrame([(1, None, None, None, None), (2, " . ", "en", "a", 1)], SCHEMA), least=1) == []


def test_index_extends_both_ways():
    """Intervals of all phrases, however they were reached, against plain counting."""
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 6, 400)
    index = co.WordIndex(ids)
    grams = lambda m: Counter(tuple(ids[i:i + m]) for i in range(len(ids) - m + 1) if 0 not in ids[i:i + m])
    word, row, back, size = index.words()
    assert dict(zip(word.tolist(), size.tolist())) == {k[0]: v for k, v in grams(1).items()}
    phrases = [(int(w),) for w in word]
    for m, right in ((2, False), (3, True), (4, False)):
        of, new, row, back, size = index.extend(row, back, size, right)
        phrases = [phrases[o] + (int(w),) if right else (int(w),) + phrases[o] for o, w in zip(of, new)]
        assert dict(zip(phrases, size.tolist())) == dict(grams(m))


def test_ids_come_back():
    for ids in (np.zeros(0, np.uint32), np.arange(70_000, dtype=np.uint32) * 61_000):
        assert (co.unpack(co.pack(ids)) == ids).all()
    text = "Alpha beta, ALPHA\tgamma!beta"
    words, counts, ids = co.encode(b".".join(co.pieces(text, 5)))
    assert sorted(zip(words, counts.tolist())) == [("alpha", 2), ("beta", 2), ("gamma", 1)]
    assert [words[i - 1] if i else "." for i in ids.tolist() if i] == ["alpha", "beta", "alpha", "gamma", "beta"]
    assert math.isclose(len(ids), 7, abs_tol=2)
