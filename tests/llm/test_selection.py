"""Importance resampling, phrase collocations and url filters against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import collocations, resampling, urls
from tests.llm.test_operators import DOC, clashing, documents, same, text_of

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOC)


# --- importance resampling -------------------------------------------------------------------------------------------


def brute_resample(rows, target, buckets=10_000, longest=1, at_least=20, percent=10):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    found = [features(t) for _, t in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for (key, _), (words, f) in zip(rows, found):
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in out if r[4] >= at_least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = defaultdict(list)
    for i, r in enumerate(able[: len(able) * percent // 100]):
        ranks[r[:4]].append(i + 1)
    return Counter((*r[:4], ranks[r[:4]].pop(0) if ranks[r[:4]] and r[4] >= at_least else None) for r in out)


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 100), (3, 37)])
def test_resampling_against_plain(spark, docs, longest, percent):
    rows = [(r[0], r[1]) for r in documents()]
    target = [text_of(random.Random(5), 300), None, "", "Ré-ré 12 ré"]
    got = resampling.resample(clashing(docs), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), longest=longest, percent=percent)
    assert Counter(map(tuple, got.collect())) == brute_resample(rows, target, longest=longest, percent=percent)


def test_resampling_draws_towards_the_target(spark):
    rng = random.Random(6)
    word = lambda k: f"w{k}x"
    rows = [(i, " ".join(word(rng.randrange(50) + 50 * (i % 2)) for _ in range(60))) for i in range(400)]
    target = [(0, " ".join([word(k) for k in range(50)] * 400))]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(target, "item_id long, text string"), buckets=5000)
    drawn = [r["doc_id"] % 2 for r in got.where("rank IS NOT NULL").collect()]
    assert len(drawn) == 40 and sum(drawn) < 4


def test_resampling_of_odd_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = [(r[0], r[1]) for r in documents()]
    assert Counter(map(tuple, resampling.resample(docs, bench).collect())) == brute_resample(rows, [])
    assert resampling.resample(docs.limit(0), bench).count() == 0
    # one row a third of the table, repeated: ranks follow one another
    many = [(7, "a " * 30)] * 200 + [(i, text_of(random.Random(i), 25)) for i in range(100, 500)]
    got = resampling.resample(spark.createDataFrame(many, "doc_id long, text string"), bench, percent=100)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 601))
    assert Counter(map(tuple, got.collect())) == brute_resample(many, [], percent=100)
    with pytest.raises(ValueError):
        resampling.resample(docs, bench, buckets=70_000)


def test_streams_split_between_documents(spark, docs, monkeypatch):
    a = resampling.streams(docs.selectExpr("doc_id AS key", "cast(text AS binary) AS text"), 1, 1000)
    for r in a.collect():
        assert len(r["stream"]) == 2 * r["ends"][-1] and np.all(np.diff([0, *r["ends"]]) == r["words"])
        assert max(np.frombuffer(r["stream"], "<u2"), default=0) < 1000


# --- collocations ----------------------------------------------------------------------------------------------------


def brute_collocations(rows, min_count, longest=5, top=2000, inside=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        rest = []
        for p, a in some.items():
            if any(100 * b >= inside * a for q, b in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rest.append((" ".join(p), a, l, r, n[lang], score))
        rest.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out |= {(lang, i, *x) for i, x in enumerate(rest[:top], 1)}
    return out


def phrases_text(seed, n):
    rng = random.Random(seed)
    fixed = ["new york city", "Été à Paris", "one one one one", "a b c d e f"]
    parts = []
    for _ in range(n):
        parts.append(rng.choice([*fixed, *(rng.choice("uvwxyz") + str(rng.randrange(4)) for _ in range(4))]))
        parts.append(rng.choice([" ", " ", " ", "\t", " \t ", ". ", ",", "\n", "\x0b", "\xa0"]))
    return "".join(parts)


@pytest.fixture(scope="module")
def talk():
    rows = [(phrases_text(i, 40 + 400 * (i == 3)), ("en", "de", None, "und")[i % 4]) for i in range(60)]
    return rows + [rows[0]] * 20 + [(None, "en"), ("", "fr"), (" \t\n", None), ("x" * 3000, "en"), ("lonely words", "xx")]


@pytest.mark.parametrize("limits, inside", [({}, 100), ({"SLOTS": 7, "VOCABULARY": 5, "CHUNK": 16, "CELLS": 1}, 60)])
def test_collocations_against_plain(spark, talk, monkeypatch, limits, inside):
    """Also where candidates and words take several passes."""
    for k, v in limits.items():
        monkeypatch.setattr(collocations, k, v)
    df = clashing(spark.createDataFrame(talk, "text string, lang string"))
    got = [tuple(r) for r in collocations.mine(df, min_count=12, inside=inside).collect()]
    want = brute_collocations(talk, 12, inside=inside)
    assert len(got) == len(want) and set(got) == want
    assert any(len(r[2].split()) == 5 for r in want) and any("\xa0" in r[2] for r in want)


def test_collocations_of_odd_tables(spark, talk):
    df = spark.createDataFrame(talk, "text string, lang string")
    assert {tuple(r) for r in collocations.mine(df, min_count=12, longest=3, top=3).collect()} == brute_collocations(talk, 12, 3, 3)
    assert collocations.mine(df, min_count=10**6).count() == 0
    assert collocations.mine(df.limit(0)).count() == 0
    hot = spark.createDataFrame([("in the end it is", "en")] * 500 + [("it is", "de")] * 150, "text string, lang string")
    assert {tuple(r) for r in collocations.mine(hot).collect()} == brute_collocations([("in the end it is", "en")] * 500 + [("it is", "de")] * 150, 100)


def test_index_tells_absent_keys():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    index = collocations.Index.build(keys[::2])
    found = index.find(keys)
    assert (found[1::2] == -1).all() and sorted(found[::2]) == list(range(len(keys[::2])))
    assert (index.keys[found[::2]] == keys[::2]).all()


def test_streams_keep_only_runs():
    slots, words = np.array([-1, 3, -1, 4, 5, -1, -1, 6, 7, 8], np.int32), np.arange(10, dtype=np.int32)
    a, b = collocations.pack(slots, words)
    assert np.frombuffer(a, "<i4").tolist() == [4, 5, -1, 6, 7, 8] and np.frombuffer(b, "<i4").tolist() == [3, 4, 5, 7, 8, 9]


# --- url filters -----------------------------------------------------------------------------------------------------

RULES = [
    urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/"),
    urls.Rule("block", "org", "/fr/adv"), urls.Rule("allow", "b.c", ""), urls.Rule("block", "B.C", "/x/y"), urls.Rule("allow", "a.b.c", "/x"), urls.Rule("allow", "d", "/"), urls.Rule("block", "d", "/"),
]


def brute_judge(url, rules, default):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    rest = re.match(r"[^?#]*", rest)[0]
    host = re.match(r"[^/]*", rest)[0]
    path, host = rest[len(host) :], host.translate(LOWER)
    fits = [r for r in rules if (f".{host}".endswith("." + r.host.lower()) and path.startswith(r.path))]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict), default=None)
    return host, path, best and best.host.lower() + best.path, best.verdict if best else default


def test_urls_against_plain(spark):
    rng = random.Random(11)
    hosts = ["net", "a.net", "Example.NET", "x.example.net", "notexample.com", "example.com", "w.example.com", "org", "É.org", "b.c", "a.b.c", "z.a.b.c", "d", "net:80", "u@net", "net.", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/", "/de/é", "/fr/", "/fr/advert", "/fr/ad", "/x", "/x/y", "/x/yz/w", "//", "/en//", "/EN/"]
    rows = [f"{rng.choice(('http', 'HTTPS', ''))}://{h}{p}{rng.choice(('', '?q=/en/', '#a?b', '?a://net/'))}" for h in hosts for p in paths]
    rows += [None, "", "net/en", "http:/net/", "://net/", "http://net/\nx\r/y", "http://org" + "/fr" * 4000, "mailto:a@b", "a://b://net/"]
    table = [(i if i % 50 else None, u) for i, u in enumerate(rows + rows[:20])]
    df = clashing(spark.createDataFrame(table, "page_id long, url string"))
    want = Counter((i, *brute_judge(u, RULES, "block")) for i, u in table)
    assert Counter(map(tuple, urls.judge(df, RULES, "block").collect())) == want
    assert urls.judge(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(df, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urls.judge(df, [urls.Rule("deny", "a", "/")])


def test_long_lists_are_walked_in_parts(spark, monkeypatch):
    rng = random.Random(12)
    names = ["a", "b", "c"]
    make = lambda: urls.Rule(rng.choice(("allow", "block")), ".".join(rng.choice(names) for _ in range(rng.randint(1, 3))), "".join("/" + rng.choice(names) for _ in range(rng.randint(0, 3))) + rng.choice(("", "/")))
    rules = [make() for _ in range(60)]
    table = [(i, f"x://{'.'.join(rng.choice(names) for _ in range(4))}{''.join('/' + rng.choice(names) * rng.randint(1, 2) for _ in range(3))}") for i in range(150)]
    df = spark.createDataFrame(table, "page_id long, url string")
    monkeypatch.setattr(urls, "PART_BYTES", 1500)
    assert len(list(urls._parts(rules))) == 3
    got = urls.judge(df, rules)
    assert Counter(map(tuple, got.collect())) == Counter((i, *brute_judge(u, rules, "allow")) for i, u in table)
