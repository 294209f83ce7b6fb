"""URL filter, Merkle manifest and filter audit against brute force and the cases their docstrings define."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millwright.llm import filter_audit, merkle, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, part int, mask int, rank string"
LONG = "Word & " * 30_000


def documents(spark, rows):
    """(doc_id, text, source) rows, with columns whose names the operators use themselves."""
    data = [(i, t, "en", s, None if t is None else len(t), "r", 7, 9, "k") for i, t, s in rows]
    return spark.createDataFrame(data, SCHEMA)


ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", ""), (5, "one", "a"), (5, "one", "a"), (5, "two\n", "a"),
    (None, "one", "a"), (None, None, None), (6, LONG, "ä"), (7, "é ñ 漢字\x1c x\x00y\n\nThe End", "Z"), (8, "A B C\nd", "b"),
    (9, "A B C\nd", "b"), (0, "a " * 300, "a"), (-3, "a " * 300, None),
]


# --- 11 --------------------------------------------------------------------------------------------


def brute_urls(rows, rules=url_filter.RULES):
    parsed = []
    for i, url in rows:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(n + p), len(n), n + p, v) for v, n, p in rules
                if (host == n or host.endswith("." + n)) and path.startswith(p)]
        parsed.append((i, host, path, *(max(fits)[2:] if fits else (None, None))))
    listed = {h for _, h, _, _, v in parsed if v == "block" and h}
    return [(i, h, p, r, v or ("block" if h in listed else "allow")) for i, h, p, r, v in parsed]


URLS = [
    None, "", "no scheme", "http://", "https:///de/1", "http://COM/de/x", "http://a.com/de/", "http://a.com/DE/", "http://a.com/x?/de/",
    "http://a.com", "http://a.com#/fr/", "http://xcom/de/1", "http://ÄB.com/de/ü", "http://Äb.com/other", "u://v://a.com/de/",
    "http://example.org/en/12", "http://m.example.org/en/2", "http://m.example.org/es/", "http://notexample.org/es/", "http://b.org",
    "http://m.example.org", "\nhttp://a.com/\nde/", "ftp://a.com:80/de/", "http://h.net/x", "http://h.net/x", "http://" + "l" * 60_000 + ".com/de/",
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "<p>", "h", True, "k", 3) for i, u in rows],
                                 "page_id long, url string, html string, host string, listed boolean, key string, shard int")


def test_url_filter_brute_force(spark):
    r = random.Random(5)
    hosts = [f"{'m.' if i % 3 else ''}h{i}.{r.choice(['com', 'net', 'org', 'example.org'])}" for i in range(120)]
    made = [f"http://{r.choice(hosts)}/{r.choice(['fr', 'de', 'en', 'es'])}/{r.randrange(30)}" for _ in range(900)]
    rows = [*enumerate([*URLS, *made]), (None, "http://a.com/de/"), (7, "http://a.com/de/")]
    got = url_filter.op11_url_filter(pages(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_urls(rows))
    assert {x["verdict"] for x in got if x["rule"] is None} == {"allow", "block"}


def test_longest_rule_wins(spark):
    rules = [("allow", "com", "/"), ("block", "b.com", "/"), ("allow", "b.com", "/x/"), ("block", "com", "/x/y/z")]
    rows = list(enumerate(["http://b.com/", "http://c.com/", "http://a.b.com/x/", "http://b.com/x/y/zz", "http://com/x/y/z"]))
    got = url_filter.op11_url_filter(pages(spark, rows), rules).collect()
    assert Counter(map(tuple, got)) == Counter(brute_urls(rows, rules))


def test_no_pages(spark):
    assert url_filter.op11_url_filter(pages(spark, [])).collect() == []


def test_cascade_is_exact_over_many_shards_and_batches(spark):
    """Six shards, each a batch of its own; every key of the universe gets its exact answer, hot or not."""
    names = [f"key-{i}" for i in range(6000)]
    listed = {k for i, k in enumerate(names) if i % 7 == 0}
    rows = [(k, k in listed) for k in names] + [("key-0", False), ("key-0", True), ("key-1", False)] * 500
    cascades, shards = url_filter.cascade(spark.createDataFrame(rows, "key string, listed boolean"), shard_keys=1000)
    assert shards == 6 and cascades.count() == 6
    asked = spark.createDataFrame([(i, k) for i, k in enumerate([*names, None])], "n int, k string")
    got = url_filter.ask(asked, "k", cascades, shards, batch_bytes=1).collect()
    assert {x["k"]: x["listed"] for x in got} == {**{k: k in listed for k in names}, None: None}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 400), st.integers(0, 3000))
def test_cascade_levels(seed, inside, outside):
    keys = np.random.default_rng(seed).integers(0, 2**64, (inside + outside, 2), dtype=np.uint64)
    levels = url_filter.build_levels(keys[:inside], keys[inside:])
    known, listed = url_filter.Cascades([(0, levels)]).holds(np.zeros(len(keys), np.int64), keys[:, 0], keys[:, 1])
    assert known.all() and listed.tolist() == [True] * inside + [False] * outside
    bits = 8 * sum(len(blob) for _, _, blob in levels)
    assert bits < 64 * (len(levels) + 1) + 24 * inside  # a few bits a listed key, none for the others


# --- 12 --------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """(root, proof steps (left, right) of each node)"""
    steps, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            lo = p - p % 3
            steps[i].append((nodes[lo:p], nodes[p + 1 : lo + 3]))
            place[i] = p // 3
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], steps


def brute_merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    def leaf(i, s, g, n, t):
        return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, s, g, n, t)))

    by_source = {}
    for row in rows:
        i, *mid, t = row
        changed = i is not None and t is not None and zlib.crc32(str(i).encode()) % 2 == 0
        by_source.setdefault(row[1], []).append((i, leaf(*row), leaf(i, *mid, t.replace("\n", "")) if changed else leaf(*row)))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        docs = sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((docs, *brute_tree([x[1] for x in docs])))
    root, over = brute_tree([t[1] for t in trees])
    out = []
    for (docs, subroot, steps), top in zip(trees, over):
        for (i, own, used), path in zip(docs, steps):
            h = used
            for left, right in [*path, *top]:
                h = sha(*left, h, *right)
            proof = sha(*(x for a, b in [*path, *top] for x in [*a, *b]))
            out.append((i, own, subroot, root, proof, h, h == root))
    return out


def merkle_rows(rows):
    return [(i, s, "en", None if t is None else len(t), t) for i, t, s in rows]


FIELDS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest_rows(df):
    return Counter(tuple(x[c] for c in FIELDS) for x in df.collect())


def test_merkle_odd_rows(spark):
    got = digest_rows(merkle.op12_merkle(documents(spark, ODD)))
    assert got == Counter(brute_merkle(merkle_rows(ODD)))


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_merkle_butterfly(spark, depth):
    """Small blocks, so that up to six rounds run, with every kind of short last run; one source holds a third."""
    r = random.Random(depth)
    sizes = {"hot": 260, "one": 1, "two": 2, "three": 3, "four": 4, None: 10, "28": 28, "82": 82, **{f"s{i}": r.randrange(1, 40) for i in range(9)}}
    rows = [(s, k) for s, n in sizes.items() for k in range(n)]
    r.shuffle(rows)
    rows = [(i, f"text {k}\n of {s}\n" if k % 3 else f"flat {k}", s) for i, (s, k) in enumerate(rows)]
    got = merkle.op12_merkle(documents(spark, rows).repartition(5), depth)
    want = Counter(brute_merkle(merkle_rows(rows)))
    assert digest_rows(got) == want
    assert {x[-1] for x in want} == {True, False}


def test_swap_round_messages(spark):
    """A round gives each unit the roots of the other runs of its group, whatever the last run lacks."""
    units = 23
    state = spark.createDataFrame([(0, u, units, f"{u // 3}", []) for u in range(units)],
                                  f"tree long, unit long, units long, root string, proof {merkle.STEPS}")
    got = {x["unit"]: x["proof"][0] for x in merkle.swap_round(state, 1).collect()}
    assert set(got) == set(range(units))
    for u, step in got.items():
        group = [str(g) for g in range(u // 9 * 3, min(u // 9 * 3 + 3, 8))]
        at = group.index(str(u // 3))
        assert (step["before"], step["after"]) == ("".join(group[:at]), "".join(group[at + 1 :]))


def test_no_leaves(spark):
    assert merkle.op12_merkle(documents(spark, [])).collect() == []


def test_single_leaf(spark):
    [x] = merkle.op12_merkle(documents(spark, [(4, "x", "a")])).collect()
    assert x["leaf"] == x["subroot"] == x["root"] == x["folded_root"] and x["proof_sha256"] == sha("") and x["verified"]


# --- 13 --------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if x(q, t) == 1 and i is not None} for x in (lambda q, t: q, lambda q, t: t))
    ids = {}
    for i, t, _ in rows:
        if i is not None:
            ids[t or ""] = min(i, ids.get(t or "", i))
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and ids[t] < i}
        docs.append((s or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {d[0] for d in docs}:
        here = [d[1:] for d in docs if d[0] == part]
        steps, share = [], Counter()
        for o in orders:
            left = here
            for k, x in enumerate(o, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                redundant = sum(x in d[0] and bool(d[0] & set(o[: k - 1])) for d in here)
                steps.append((part, o, k, len(left), len(gone), redundant, sum(d[0] == {x} for d in here),
                              sum(d[1] for d in gone), sum(d[2] for d in gone), x))
                share[x] += len(gone)
        out += [(*s[:-1], share[s[-1]]) for s in steps]
    return out


LABELS = [(1, 1, 0), (4, 0, 1), (5, 1, None), (5, 0, 1), (None, 1, 1), (6, 1, 1), (9, 1, 0), (77, 1, 1), (0, None, None)]


def label_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "doc_id AS label_id", "1 AS good")


def test_audit_odd_rows(spark):
    got = filter_audit.op13_filter_audit(documents(spark, ODD), label_table(spark, LABELS)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_audit(ODD, LABELS))


def test_audit_brute_force(spark):
    r = random.Random(13)
    words = [f"w{i}" for i in range(400)] + ["CAPS", "A&B", "50%"]
    texts = [" ".join(r.choices(words[: r.choice([20, 400, 403])], k=r.choice([5, 150, 250, 320]))) for _ in range(60)]
    rows = [(i, r.choice(texts), "hot" if i % 3 else r.choice(["x", "y", None])) for i in range(240)]
    labels = [(i, r.randrange(2), r.randrange(2)) for i in range(0, 260, 2)]
    got = filter_audit.op13_filter_audit(documents(spark, rows), label_table(spark, labels)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_audit(rows, labels))


def test_audit_conserves_documents(spark):
    """Over the steps of any order, what is removed and what the last step keeps are all documents of the part."""
    got = filter_audit.op13_filter_audit(documents(spark, ODD), label_table(spark, [])).toPandas()
    sizes = Counter(s or "" for _, _, s in ODD)
    for (part, _), g in got.groupby(["part", "filter_order"]):
        assert g["removed"].sum() + g.loc[g["step"] == 5, "kept"].item() == sizes[part]
    assert got["good_lost"].sum() == got["toxic_lost"].sum() == 0


def test_audit_of_no_documents(spark):
    assert filter_audit.op13_filter_audit(documents(spark, []), label_table(spark, LABELS)).collect() == []
