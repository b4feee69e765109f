"""The graph engine on tiny graphs with known results."""

import itertools
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import expressions as X
from tessera.operators import align as al
from tessera.operators import assign, blocks, calibrate, citations, diff, explain, nodes, parse, report, similarity, sweep
from tessera.plans import adapters, catalog
from tests.graphs import baseline, edge, fact, frame, graph, rule


def aligned(spark, t, s, **kw):
    both = al.pair_sides(nodes.flatten_nodes(frame(spark, t)), nodes.flatten_nodes(frame(spark, s)))
    return both, al.align(both, **kw)


def mapping(df):
    return {r["teacher_id"]: (r["student_id"], round(r["similarity"], 6)) for r in df.collect()}


def scored(spark, t, s):
    both, a = aligned(spark, t, s)
    a = a.cache()
    te = nodes.flatten_edges(frame(spark, t)).withColumns({"student": F.lit("s"), "side": F.lit("t")})
    se = nodes.flatten_edges(frame(spark, s)).withColumns({"student": F.lit("s"), "side": F.lit("s")})
    m, h, e = diff.v_miss(both, a), diff.v_halluc(both, a), diff.e_diff(both, a, te.unionByName(se))
    total = diff.l_ged(m, h, e, both).first()
    return m.collect(), h.collect(), e.collect(), total["l_ged"]


def student(**change):
    return baseline("agent", "s", **change)


# --- citations and similarity ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,want",
    [
        ("§20-871(d)(2)", {"20-871(d)(2)"}),
        ("Section 20-871(d)(2)", {"20-871(d)(2)"}),
        ("section 20-871(d)(2).", {"20-871(d)(2)"}),
        ("Sec. 20-871(d)(2);", {"20-871(d)(2)"}),
        ("", set()),
        (None, set()),
        ("see attached schedule", set()),
        ("§ 6-1-1701", {"6-1-1701"}),
        ("§6-1-1701–1707", {"6-1-1701"}),
        ("§§20-870, 20-871", {"20-870"}),
        ("security", {"urity"}),
        ("SECTIONS 5", {"s"}),
    ],
)
def test_citation_tokens(spark, text, want):
    df = spark.createDataFrame([(text,)], "c string").select(X.citation_tokens(F.col("c")).alias("t"))
    assert set(df.first()["t"]) == want


def test_citations_match(spark):
    df = spark.createDataFrame([("§ 6-1-1701", "Sec. 6-1-1701", True), ("§ 20-871(d)(2)", "§ 20-871(e)", False)], "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", X.citations_match(F.col("a"), F.col("b"))).collect())


# Texts whose similarities are published.
A, B = "HireFlow is based in Austin Texas", "ResumeRank is an automated employment decision tool"


def test_identity_and_paraphrase(spark):
    _, a = aligned(spark, graph(facts=[fact("F1", A), fact("F2", B)]), graph(source="agent", agent="s", facts=[fact("F1", A), fact("F2", B)]))
    assert mapping(a) == {"F1": ("F1", 1.0), "F2": ("F2", 1.0)}
    s = graph(source="agent", agent="s", facts=[fact("F1", B + " used by NYC employers"), fact("F2", "HireFlow is headquartered in Austin Texas")])
    _, a = aligned(spark, graph(facts=[fact("F1", A), fact("F2", B)]), s)
    assert mapping(a) == {"F1": ("F2", 0.606478), "F2": ("F1", 0.701045)}


def test_unrelated_and_confidence(spark):
    t = graph(facts=[fact("F1", "the candidate filed an EEOC complaint in 2023")])
    both, a = aligned(spark, t, graph(source="agent", agent="s", facts=[fact("F1", "completely unrelated unicorn rainbow umbrella")]))
    assert mapping(a) == {"F1": (None, 0.0)}
    r = al.align_summary(a, both).first()
    assert (r["confidence"], r["unaligned_teacher"], r["unaligned_student"]) == (0.0, "F1", "F1")
    both, a = aligned(spark, baseline(), student())
    r = al.align_summary(a, both).first()
    assert (r["confidence"], r["unaligned_teacher"], r["unaligned_student"]) == (1.0, "", "")
    counts = {x["node_type"]: (x["teacher"], x["aligned"], x["unaligned"]) for x in al.type_counts(a).collect()}
    assert counts == {"F": (2, 2, 0), "I": (1, 1, 0), "R": (1, 1, 0), "A": (0, 0, 0), "C": (0, 0, 0), "O": (0, 0, 0)}


def test_empty_sides(spark):
    s = graph(source="agent", agent="s", facts=[fact("F1", A)])
    both, a = aligned(spark, graph(), s)
    r = al.align_summary(a, both).first()
    assert (r["confidence"], r["n_teacher"], r["unaligned_student"]) == (1.0, 0, "F1")


def test_rules_by_citation_then_text(spark):
    def pair(t, s):
        return mapping(aligned(spark, graph(rules=t), graph(source="agent", agent="s", rules=s))[1])

    assert pair([rule("R1", "§ 20-871(d)(2)", "x")], [rule("R1", "Section 20-871(d)(2)", "other")]) == {"R1": ("R1", 1.0)}
    got = pair([rule("R1", "see Appendix", "bias audit requirement annual")], [rule("R1", "schedule A", "bias audit requirement yearly")])
    assert got["R1"][0] == "R1" and 0.3 < got["R1"][1] < 0.7
    assert pair([rule("R1", "§ 6-1-1701", "duty of care")], [rule("R1", "§ 99-99-9", "invasive species")]) == {"R1": (None, 0.0)}
    # first fit in teacher order, not best fit: the second teacher goes without
    t = [rule("R1", "§ 1 and § 2", "p"), rule("R2", "§ 1", "q")]
    assert pair(t, [rule("R9", "§ 1", "zz")]) == {"R1": ("R9", 1.0), "R2": (None, 0.0)}


def _plain_tfidf(rows):
    """All pairs of rows (case, side, pos, text) with a cosine of 0.1 or more, by dictionaries."""
    found, terms = {}, {}
    for case, side, pos, text in rows:
        w = re.findall(r"\w{2,}", text.lower())
        terms[case, side, pos] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    for case in {r[0] for r in rows}:
        own = {k: v for k, v in terms.items() if k[0] == case}
        df = Counter(t for v in own.values() for t in v)
        vec = {k: {t: n * (math.log((1 + len(own)) / (1 + df[t])) + 1) for t, n in v.items()} for k, v in own.items()}
        norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vec.items()}
        for a, b in itertools.product(own, own):
            if (a[1], b[1]) == ("t", "s") and norm[a] and norm[b]:
                sim = round(sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) / norm[a] / norm[b], 9)
                if sim >= 0.1:
                    found[case, a[2], b[2]] = sim
    return found


@pytest.mark.parametrize("small,texts,products", [(256, 4096, 1 << 21), (0, 4096, 1 << 21), (0, 7, 64), (40, 11, 50)])
def test_tfidf_in_rows_and_in_blocks(spark, monkeypatch, small, texts, products):
    monkeypatch.setattr(similarity, "SMALL", small)
    monkeypatch.setattr(similarity, "TEXTS", texts)
    monkeypatch.setattr(blocks, "PRODUCTS", products)
    rng = random.Random(5)
    rows = [(f"c{c}", side, p, " ".join(rng.choice(["alpha", "Beta", "gamma", "x", "delta", "ünder", "zeta9", "§", "_a"]) for _ in range(rng.randrange(9)))) for c, n in enumerate((3, 20, 45)) for side in "ts" for p in range(n)]
    rows += [("one", "t", 0, "alone here"), ("none", "t", 0, ""), ("none", "s", 0, "")]
    df = spark.createDataFrame(rows, "case_id string, side string, pos int, match_text string").withColumns({"student": F.lit("s"), "node_type": F.lit("F")})
    got = {(r["case_id"], r["t_pos"], r["s_pos"]): round(r["similarity"], 9) for r in similarity.tfidf_pairs(df, 0.1).collect()}
    assert got == _plain_tfidf(rows)


def test_no_term_is_a_row(spark, monkeypatch):
    """What is joined and shuffled grows with texts and blocks, not with the products of their terms."""
    df = spark.createDataFrame([("c", "s", "F", side, p, "one two three four") for side in "ts" for p in range(30)], "case_id string, student string, node_type string, side string, pos int, match_text string")
    for small in (256, 0):
        monkeypatch.setattr(similarity, "SMALL", small)
        plan = similarity.tfidf_pairs(df, 0.1)._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan and "inline" not in plan and "sum((w_t" not in plan


def test_threshold_is_inclusive_and_fallback(spark):
    df = spark.createDataFrame([("c", "s", "F", side, p, t) for side, p, t in [("t", 1, "a"), ("t", 2, " B "), ("s", 1, "b"), ("s", 2, ""), ("t", 3, "")]], "case_id string, student string, node_type string, side string, pos int, match_text string")
    assert [(r["t_pos"], r["s_pos"], r["similarity"]) for r in similarity.tfidf_pairs(df, 0.1).collect()] == [(2, 1, 1.0)]
    with pytest.raises(ValueError):
        similarity.tfidf_pairs(df, 0.0)
    v = spark.createDataFrame([("c", "s", "F", "t", 1, [3.0, 4.0]), ("c", "s", "F", "s", 1, [4.0, 3.0]), ("c", "s", "F", "s", 2, [0.0, 0.0])], "case_id string, student string, node_type string, side string, pos int, vector array<float>")
    assert [(r["s_pos"], r["similarity"]) for r in similarity.embedding_pairs(v, 0.96).collect()] == [(1, 0.96)]
    with pytest.raises(Exception, match="no vector"):
        similarity.embedding_pairs(v.withColumn("vector", F.lit(None).cast("array<float>")), 0.5).collect()


def greedy(pairs):
    out, ts, ss = [], set(), set()
    for d, t, s in sorted((-x, t, s) for t, s, x in pairs):
        if t not in ts and s not in ss:
            out.append((t, s, -d))
            ts.add(t)
            ss.add(s)
    return sorted(out)


@pytest.mark.parametrize("limit", [20_000, 0])
def test_greedy_with_ties(spark, limit):
    rng, rows, want = random.Random(1), [], {}
    for g in range(30):
        pairs = [(t, s, rng.choice((0.1, 0.2, 0.5))) for t, s in itertools.product(range(rng.randint(1, 7)), range(rng.randint(1, 7))) if rng.random() < 0.7]
        rows += [(f"c{g}", "s", "F", t, s, x) for t, s, x in pairs]
        want[f"c{g}"] = greedy(pairs)
    df = spark.createDataFrame(rows, "case_id string, student string, node_type string, t_pos int, s_pos int, similarity double")
    got = {}
    for r in assign.greedy_assign(df, fold_pairs=limit).collect():
        got.setdefault(r["case_id"], []).append((r["t_pos"], r["s_pos"], r["similarity"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


PAIR = "case_id string, student string, node_type string, t_pos int, s_pos int, similarity double"


def test_ties_take_few_rounds(spark):
    """300 x 300 tied pairs are one block; with gaps in it, rounds follow the pairs folded, not the matches."""
    rng = random.Random(7)
    every = [(t, s, 1.0) for t in range(300) for s in range(300)]
    gaps = [x for x in every if rng.random() < 0.9 and x[0] < 220] + [(t, s, 0.5) for t in range(220, 300) for s in range(0, 300, 7)]
    for pairs, most in ((every, 1), (gaps, 5)):
        df = spark.createDataFrame([("c", "s", "F", *x) for x in pairs], PAIR)
        found, rounds = assign.solve_in_rounds(df)
        assert rounds <= most and sorted((r["t_pos"], r["s_pos"], r["similarity"]) for r in found.collect()) == greedy(pairs)


def test_rounds_agree_with_the_fold(spark):
    """Groups of many shapes, so that blocks, first pairs and folds of a few pairs all have their part."""
    rng, rows, want = random.Random(21), [], {}
    for g in range(25):
        n, m, levels = rng.randint(1, 12), rng.randint(1, 12), [round(rng.random(), 3) for _ in range(rng.randint(1, 4))]
        side = [rng.randrange(3) for _ in range(n + m)]
        pairs = [(t, s, levels[(side[t] + side[n + s]) % len(levels)]) for t in range(n) for s in range(m) if rng.random() < 0.95]
        rows += [(f"c{g}", "s", "F", *x) for x in pairs]
        want[f"c{g}"] = greedy(pairs)
    got = {}
    for r in assign.solve_in_rounds(spark.createDataFrame(rows, PAIR), fold_pairs=3)[0].collect():
        got.setdefault(r["case_id"], []).append((r["t_pos"], r["s_pos"], r["similarity"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_kinds_stand_for_their_nodes(spark):
    """Pairs of kinds, tied and not, give the matches of the walk over all pairs of nodes, in one round and in several."""
    rng, nodes_, alike, want = random.Random(3), [], [], {}
    for g in range(25):
        kinds = rng.randint(1, 5)
        own = {side: [(p, rng.randrange(kinds)) for p in rng.sample(range(40), rng.randint(1, 12))] for side in "ts"}
        sims = {(a, b): rng.choice((0.1, 0.2, 0.5)) for a in range(kinds) for b in range(kinds) if rng.random() < 0.7}
        nodes_ += [(f"c{g}", "s", "F", side, p, k) for side, rows in own.items() for p, k in rows]
        alike += [(f"c{g}", "s", "F", a, b, x) for (a, b), x in sims.items()]
        want[f"c{g}"] = greedy([(t, s, sims[a, b]) for t, a in own["t"] for s, b in own["s"] if (a, b) in sims])
    n = spark.createDataFrame(nodes_, "case_id string, student string, node_type string, side string, pos int, kind int")
    like = spark.createDataFrame(alike, "case_id string, student string, node_type string, t_kind int, s_kind int, similarity double")
    for most in (None, 2):
        got = {}
        for r in assign.greedy_by_kind(n, like, most).collect():
            got.setdefault(r["case_id"], []).append((r["t_pos"], r["s_pos"], r["similarity"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_ties_of_a_brand_make_no_pairs(spark, tmp_path):
    """6,000 parts of one brand would be 9 million pairs; only kinds are paired."""
    parts = spark.range(6000).selectExpr("id AS p_partkey", "'b' AS p_brand", "CAST(id % 50 + 1 AS INT) AS p_size")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["greedy_ties"](spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 3000
    assert got.where("similarity not in (0.5, 1)").count() == 0


@pytest.mark.parametrize("fold", [20_000, 0])
def test_alike_texts_are_assigned_by_kind(spark, fold):
    rng = random.Random(9)
    rows = [(f"c{c}", "s", "F", side, p, " ".join(rng.choice(["alpha", "Beta", "beta", "x", "zeta9", "§"]) for _ in range(rng.randrange(3)))) for c, n in enumerate((4, 30)) for side in "ts" for p in range(n)]
    df = spark.createDataFrame(rows, "case_id string, student string, node_type string, side string, pos int, match_text string")
    got, want = {}, {}
    for r in al.assign_texts(df, 0.1, fold).collect():
        got.setdefault(r["case_id"], []).append((r["t_pos"], r["s_pos"]))
    for r in similarity.tfidf_pairs(df, 0.1).collect():
        want.setdefault(r["case_id"], []).append((r["t_pos"], r["s_pos"], r["similarity"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: [x[:2] for x in greedy(v)] for k, v in want.items()}


def cite(rules):
    """The first student rule left that shares a token, for each teacher rule in order."""
    out, used = set(), set()
    for case in {r[0] for r in rules}:
        t, s = (sorted((p, set(tok)) for c, side, p, tok in rules if c == case and side == x) for x in "ts")
        for p, a in t:
            q = next((q for q, b in s if (case, q) not in used and a & b), None)
            if q is not None:
                used.add((case, q))
                out.add((case, p, q))
    return out


def rule_table(spark, rules):
    text = lambda tok: " and ".join(f"§ {x}" for x in tok) or "nothing"
    return spark.createDataFrame([(c, "s", "R", side, p, text(tok)) for c, side, p, tok in rules], "case_id string, student string, node_type string, side string, pos int, citation string")


def test_citations_in_order(spark):
    rng = random.Random(5)
    rules = [(f"c{g}", side, p, rng.choices(["1-1", "1-2", "2(a)", "2(b)", "3-9", "4"], k=rng.choice((0, 1, 1, 1, 2, 3)))) for g in range(20) for side in "ts" for p in range(rng.randint(0, 9))]
    rules += [("alone", side, p, ["7-7"]) for side, n in (("t", 9), ("s", 5)) for p in range(n)]
    got = citations.citation_matches(rule_table(spark, rules))
    assert {(r["case_id"], r["t_pos"], r["s_pos"]) for r in got.collect()} == cite(rules) and got.where("similarity <> 1").count() == 0
    assert citations.citation_matches(rule_table(spark, rules).limit(0)).count() == 0


@pytest.mark.parametrize("extra", [[], ["9-9"]])
def test_a_token_of_many_rules_makes_no_product(spark, extra):
    """5,000 rules on each side cite the same, and with ``extra`` one cites more: matches come in order, and no pairs are made."""
    rules = [("c", side, p, ["5-5", *(extra if p == 17 else [])]) for side in "ts" for p in range(5000)]
    m = citations.citation_matches(rule_table(spark, rules))
    assert [(r["t_pos"], r["s_pos"]) for r in m.orderBy("t_pos").collect()] == [(p, p) for p in range(5000)]
    work = list(citations.first_unused([(p, ["a", "b"]) for p in range(20_000)], [(p, ["b", "c"]) for p in range(20_000)]))
    assert work == [(p, p) for p in range(20_000)]


def test_errors_need_no_alignment(spark, monkeypatch):
    monkeypatch.setattr(al, "align", None)
    t, s = frame(spark, baseline()), frame(spark, student(), student(edges=[edge("E1", "F1", "R7", "triggers")]) | {"case_id": "E1", "agent_id": "z"})
    assert [tuple(r) for r in sweep.errors(t, s).collect()] == [("E1", "z", "edge_ref E1 dst=R7")]


# --- discrepancies ---------------------------------------------------------------------------------------------------


def test_identity_scores_zero(spark):
    assert scored(spark, baseline(), student()) == ([], [], [], 0.0)


def test_missing_and_extra_rule(spark):
    m, h, e, total = scored(spark, baseline(), student(rules=[], edges=[edge("E1", "F1", "I1", "triggers")]))
    assert [x["teacher_id"] for x in m] == ["R1"] and not h and not e and total == 4.0
    two = [rule("R1", "§ 20-871(d)(2)", "bias audit requirement"), rule("R2", "§ 99-99-9", "x")]
    m, h, e, total = scored(spark, baseline(), student(rules=two))
    assert not m and [(x["student_id"], x["reason"]) for x in h] == [("R2", "unaligned")] and total == 4.0


def test_edge_differences(spark):
    _, _, e, total = scored(spark, baseline(), student(edges=[edge("E1", "F1", "I1", "supports"), edge("E2", "R1", "I1", "applies-to")]))
    assert [(x["kind"], x["student_type"], x["weight"]) for x in e] == [("type_mismatch", "supports", 1.5)] and total == 1.5
    _, _, e, total = scored(spark, baseline(), student(edges=[edge("E1", "F1", "I1", "triggers")]))
    assert [(x["kind"], x["weight"]) for x in e] == [("missing", 4.0)] and total == 4.0
    extra = [edge("E1", "F1", "I1", "triggers"), edge("E2", "R1", "I1", "applies-to"), edge("E3", "F2", "I1", "supports")]
    assert scored(spark, baseline(), student(edges=extra))[3] == 0.0
    turned = [edge("E1", "I1", "F1", "triggers"), edge("E2", "R1", "I1", "applies-to")]
    assert [x["kind"] for x in scored(spark, baseline(), student(edges=turned))[2]] == ["missing"]
    several = [edge("E1", "F1", "I1", "supports"), edge("E2", "F1", "I1", "contradicts"), edge("E3", "R1", "I1", "applies-to")]
    assert [x["student_type"] for x in scored(spark, baseline(), student(edges=several))[2]] == ["supports"]
    assert scored(spark, baseline(), student(edges=[*several, edge("E4", "F1", "I1", "triggers")]))[3] == 0.0


def test_weights(spark):
    rows = [("R", "binding", 4.0), ("R", "persuasive", 2.0), ("R", "advisory", 1.5), ("R", "overruled", 1.0), ("R", None, 2.0), ("F", None, 1.0), ("X", None, 1.0), ("A", "binding", 2.5)]
    df = spark.createDataFrame(rows, "k string, a string, want double").withColumn("got", X.node_weight(F.col("k"), F.col("a")))
    assert all(r["got"] == r["want"] for r in df.collect())
    assert spark.range(1).select(X.edge_weight(F.lit(None).cast("double"), F.lit(None).cast("double"))).first()[0] == 1.0


def test_invariant_on_random_graphs(spark):
    """Extra nodes = student nodes - (teacher nodes - missing ones), however the partitions fall."""
    rng = random.Random(2)
    words = [A, B, "the audit was late", "notice was never sent", "scores are biased", "candidates were told"]
    for _ in range(3):
        t = graph(facts=[fact(f"F{i}", rng.choice(words)) for i in range(6)])
        s = graph(source="agent", agent="s", facts=[fact(f"F{i}", rng.choice(words)) for i in range(4)])
        m, h, _, _ = scored(spark, t, s)
        assert len(h) == 4 - (6 - len(m))


def test_breakdown_and_reports(spark, tmp_path):
    both, a = aligned(spark, baseline(), student(rules=[]))
    m, h = diff.v_miss(both, a), diff.v_halluc(both, a)
    kinds = diff.breakdown(m, h, both)
    assert {r["node_type"]: (r["v_miss"], r["v_halluc"]) for r in kinds.collect()} == {k: (1 if k == "R" else 0, 0) for k in S.NODE_TYPES}
    no_edges = spark.createDataFrame([], "case_id string, student string, teacher_eid string, teacher_src string, teacher_dst string, teacher_type string, student_src string, student_dst string, student_type string, kind string, weight double")
    scores = diff.l_ged(m, h, no_edges, both)
    nested = diff.reports(m, h, no_edges, scores, kinds).first()
    assert nested["student_id"] == "s" and [x["teacher_id"] for x in nested["v_miss"]] == ["R1"] and nested["e_diff"] == []
    bad = spark.createDataFrame([(-1.0,), (float("nan"),), (None,), (0.0,)], "l_ged double")
    assert diff.implausible(bad).count() == 3


def test_duplicate_ids(spark):
    g = frame(spark, graph(facts=[fact("F1", "old"), fact("F1", "new")]))
    assert [r["label"] for r in nodes.index_nodes(nodes.flatten_nodes(g)).collect()] == ["new"]
    assert nodes.node_counts(g).first()["f"] == 2


# --- parsing ---------------------------------------------------------------------------------------------------------


def parsed(spark, text):
    df = spark.createDataFrame([("E1", "agent", "m", "s", text)], "case_id string, source string, model_name string, agent_id string, text string")
    good, bad = parse.parse_responses(df)
    return good.collect(), [r["reason"] for r in bad.collect()]


GOOD = json.dumps({"case_id": "wrong", "facts": [{"fid": "F1", "label": "x"}], "issues": [{"iid": "I1", "label": "y"}], "edges": [{"eid": "E1", "src": "F1", "dst": "I1", "type": "triggers"}]})


@pytest.mark.parametrize("text", [GOOD, f"prose {S.JSON_MARKER}\n{GOOD}", f"prose\n{S.JSON_MARKER}\n```json\n{GOOD}\n```\nbye", f"Here it is: {GOOD} as asked", f"{S.JSON_MARKER}```\n{GOOD}\n```"])
def test_parse_shapes(spark, text):
    good, bad = parsed(spark, text)
    assert not bad and good[0]["case_id"] == "E1" and good[0]["agent_id"] == "s"
    assert good[0]["facts"][0]["polarity"] == "present" and good[0]["issues"][0]["status"] == "dispositive" and good[0]["rules"] == []


def test_vectors_meet_as_matrices(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 4)
    rng = random.Random(2)
    rows = [(f"c{c}", "s", "F", side, p, [rng.gauss(0, 1) for _ in range(3)]) for c, n in enumerate((2, 11)) for side in "ts" for p in range(n)]
    df = spark.createDataFrame(rows, "case_id string, student string, node_type string, side string, pos int, vector array<double>")
    pairs = similarity.embedding_pairs(df, 0.3)
    assert "zip_with" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for a, b in itertools.product(rows, rows):
        sim = sum(x * y for x, y in zip(a[5], b[5])) / math.sqrt(sum(x * x for x in a[5]) * sum(y * y for y in b[5]))
        if a[0] == b[0] and (a[3], b[3]) == ("t", "s") and sim >= 0.3:
            want[a[0], a[4], b[4]] = round(sim, 9)
    assert {(r["case_id"], r["t_pos"], r["s_pos"]): round(r["similarity"], 9) for r in pairs.collect()} == want


def test_parts_grow_in_number_not_in_rows(spark):
    df = adapters.spread(spark.range(0, 1000, 1, 1), rows=100)
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) <= 110


def test_a_cut_answer_keeps_its_end(spark):
    df = spark.createDataFrame([("Cut off === JSON GRAPH === {\"facts\": [{\"fid\": \"F12345\", \"label\": \"user ",), ("=== JSON GRAPH ===\n```json\n{} \n```\n",)], "text string")
    _, blob = parse.split_response(F.col("text"))
    assert [r[0] for r in df.select(parse.strip_fence(blob)).collect()] == ['{"facts": [{"fid": "F12345", "label": "user ', "{} "]


@pytest.mark.parametrize("text,why", [("nothing", "no graph found"), (f"{S.JSON_MARKER} {GOOD[:40]}", "graph can't be decoded"), (GOOD.replace('"I1", "type"', '"F99", "type"'), "edge_ref E1 dst=F99"), (GOOD.replace('"F1", "label"', '"fact-1", "label"'), "id fact-1")])
def test_parse_rejects(spark, text, why):
    good, bad = parsed(spark, text)
    assert not good and why in bad[0]


def test_sanitize_each_rule(spark):
    g = graph(
        edges=[edge("E1", "F1", "F1", "leads-to"), edge("E2", "F1", "F1", "supports")],
        conclusions=[{"cid": "C1", "determination": "maybe", "confidence": "sure"}, {"cid": "C2", "determination": None, "support_refs": ["A1"]}],
        rules=[rule("R1", "c", authority="casual")],
        applications=[{"aid": "A1", "rule_ref": "R1", "fact_refs": [], "issue_ref": "I1", "result": "odd", "reasoning": "r"}],
    )
    r = parse.sanitize(frame(spark, g)).first()
    assert [e["type"] for e in r["edges"]] == ["supports", "supports"]
    assert [(c["determination"], c["confidence"], c["support_refs"]) for c in r["conclusions"]] == [("conditional", "medium", []), (None, "medium", ["A1"])]
    assert r["rules"][0]["authority"] == "binding" and r["applications"][0]["result"] == "partial"
    assert r["changes"] == [
        "edge E1: type 'leads-to' → 'supports'",
        "conclusion C1: added missing support_refs=[]",
        "conclusion C1: confidence 'sure' → 'medium'",
        "conclusion C1: determination 'maybe' → 'conditional'",
        "conclusion C2: added missing confidence='medium'",
        "rule R1: authority 'casual' → 'binding'",
        "application A1: result 'odd' → 'partial'",
    ]


@pytest.mark.parametrize("letter,lists", [("fact-1", "facts"), ("issue_1", "issues"), ("rule-A", "rules"), ("app1", "applications"), ("conclusion", "conclusions"), ("ob-1", "obligations"), ("edge-1", "edges")])
def test_ids_are_checked(spark, letter, lists):
    key = "eid" if lists == "edges" else next(k for c, k in S.NODE_LISTS.values() if c == lists)
    v = parse.violations(frame(spark, graph(**{lists: [{key: letter}]}))).where("kind = 'id'").collect()
    assert [r["item"] for r in v] == [letter]


def test_valid_graph_has_no_violations(spark):
    g = baseline(
        applications=[{"aid": "A1", "rule_ref": "R1", "fact_refs": ["F1"], "issue_ref": "I1", "result": "violated", "reasoning": "r"}],
        conclusions=[{"cid": "C1", "determination": "non-compliant", "confidence": "high", "support_refs": ["A1"]}],
        obligations=[{"oid": "O1", "label": "post it", "required_by": "R1", "status": "mandatory", "jurisdiction": "NYC"}],
    )
    g["edges"].append(edge("E3", "F1", "F1", "supports"))
    df = frame(spark, g)
    assert parse.violations(df).count() == 0
    c = nodes.node_counts(df).first()
    assert (c["total"], c["summary"]) == (7, "F=2 I=1 R=1 A=1 C=1 O=1 E=3")
    assert nodes.incomplete(frame(spark, baseline())).first()["missing"] == "A,C,O"


def test_prompt_refills(spark):
    p = parse.build_prompt(F.lit("<<STATUTES>>|<<CASE_FACTS>>|<<CASE_QUESTION>>"), F.lit("s"), F.lit("see <<CASE_QUESTION>>"), F.lit("q?"))
    assert spark.range(1).select(p).first()[0] == "s|see q?|q?"


# --- explanations and reports ----------------------------------------------------------------------------------------


def test_edge_reasons_in_order(spark):
    app = {"aid": "A1", "rule_ref": "R1", "fact_refs": ["F1", "F7"], "issue_ref": "I1", "result": "violated", "reasoning": "because"}
    mute = {"aid": "A2", "rule_ref": "R9", "fact_refs": ["F1"], "issue_ref": "I1", "result": "partial", "reasoning": ""}
    g = baseline(
        applications=[mute, app],
        obligations=[{"oid": "O1", "label": "post it", "required_by": "R1"}],
        edges=[edge("E1", "F1", "I1", "triggers", "own"), edge("E2", "R1", "A1", "applies-to"), edge("E3", "A1", "I1", "fails-element"), edge("E4", "F1", "I1", "triggers"), edge("E5", "R1", "O1", "triggers"), edge("E6", "F2", "X9", "preempts", "")],
    )
    t = {r["edge"]: r for r in explain.edge_table(frame(spark, g)).collect()}
    assert t["E1"]["justification"] == "own" and t["E2"]["justification"] == "*(from A1's reasoning)* because"
    assert t["E3"]["justification"] == "*(from A1 — result=violated)* because"
    assert t["E4"]["justification"] == "*(from A1 which subsumes F1 under I1)* because"
    assert t["E5"]["justification"] == "*(from obligation O1)* post it" and t["E6"]["justification"] == "—" and t["E6"]["target_node"] == "X9 — (missing)"
    for f in (explain.edge_table, explain.application_traces):
        assert "Exchange" not in f(frame(spark, g))._jdf.queryExecution().executedPlan().toString()
    twice = g | {"facts": [*g["facts"], fact("F1", "the last one counts")], "applications": [app, mute]}
    t = {r["edge"]: r for r in explain.edge_table(frame(spark, twice, twice)).collect()}
    assert t["E1"]["source_node"] == "F1 — the last one counts" and explain.edge_table(frame(spark, twice, twice)).count() == 12
    c = explain.justification_coverage(explain.edge_table(frame(spark, g))).first()
    assert (c["edges"], c["own"], c["derived"], c["unknown"]) == (6, 1, 4, 1)
    tr = {r["aid"]: r for r in explain.application_traces(frame(spark, g)).collect()}
    assert tr["A1"]["facts"] == "F1: The depot opened in spring; F7: (missing)" and tr["A2"]["rule"] == "R9: (missing)"
    assert nodes.drawable_edges(nodes.flatten_edges(frame(spark, g)), nodes.flatten_nodes(frame(spark, g))).count() == 5
    story = explain.narrative(frame(spark, g)).first()["narrative"]
    assert "- **I1** *(dispositive)*: whether the drivers were told\n    - *Why connected:*\n        - **F1** →[*triggers*]→ **I1**: own" in story
    assert story.startswith("**F — Facts**") and story.endswith("- **O1** () — post it *(required by R1)*")


def test_label_diff(spark):
    a, b = frame(spark, graph(facts=[fact("F1", " Same "), fact("F2", "only a")])), frame(spark, graph(facts=[fact("F5", "same"), fact("F6", "only b")]))
    assert {(r["side"], r["node_id"]) for r in explain.label_diff(a, b).collect()} == {("a", "F2"), ("b", "F6")}


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_graphs_are_told_and_compared_where_they_are(spark):
    """A narrative shuffles nothing, and for the label differences each graph moves once, whole."""
    t, s = frame(spark, baseline()), frame(spark, baseline(source="agent", agent="s"))
    assert "Exchange" not in _physical(explain.narrative(t))
    assert _physical(explain.label_diff(t, s)).count("Exchange hashpartitioning") == 1


def test_tables_of_nodes_are_never_broadcast(spark):
    """However small they look: a table's guessed size leaves out what explodes and dictionaries hide, and the driver builds a broadcast."""
    both, a = aligned(spark, baseline(), baseline(source="agent", agent="s"))
    e = spark.createDataFrame([("E1", "s", side, 0, "E1", "F1", "I1", "triggers") for side in "ts"], "case_id string, student string, side string, pos int, eid string, src string, dst string, type string")
    miss, halluc, edges = diff.v_miss(both, a), diff.v_halluc(both, a), diff.e_diff(both, a, e)
    g = frame(spark, baseline())
    weighed = nodes.edges_with_weights(nodes.flatten_edges(g), nodes.flatten_nodes(g))
    for df in (miss, halluc, edges, diff.l_ged(miss, halluc, edges, a), diff.breakdown(miss, halluc, a), weighed, nodes.drawable_edges(nodes.flatten_edges(g), nodes.flatten_nodes(g))):
        assert "Broadcast" not in _physical(df)


def test_report_tables(spark):
    scores = spark.createDataFrame([("E1", "x", 1, 2, 3, 0.125), ("E1", "y", 1, 2, 3, 9.0), ("E2", "x", 1, 2, 3, 0.125), ("H1", "x", 0, 0, 0, 14.0)], "case_id string, student string, v_miss long, v_halluc long, e_diff long, l_ged double")
    cases = spark.createDataFrame([("E1", "easy", "training"), ("E2", "easy", "test")], "case_id string, tier string, role string")
    counts = spark.createDataFrame([("E1", "x", 7, 5, 1, 1, 1, 1, 1, 0)], "case_id string, student string, teacher_nodes long, student_nodes long, f long, i long, r long, a long, c long, o long")
    res = report.results_table(scores, cases, counts)
    assert len(res.columns) == 16 and Counter(r["tier"] for r in res.collect()) == {"easy": 3, "": 1}
    tiers = {(r["tier"], r["student"]): (r["cases"], r["l_ged"], r["teacher_nodes"]) for r in report.tier_summary(res).collect()}
    assert tiers[("easy", "x")] == (2, 0.12, 3.5) and tiers[("", "x")] == (1, 14.0, 0.0)
    assert [r["case_id"] for r in report.report_order(res).collect()] == ["E1", "E1", "E2", "H1"]
    rank = {r["case_id"]: r["correct"] for r in report.ranking(res, ["x", "y"]).collect()}
    assert rank == {"E1": True, "E2": False, "H1": False}
    assert report.melt_counts(res).count() == 3 + 4
    assert report.render_html(res).count("<tr>") == 5 + 5 + 4


def test_sweep_tells_what_could_not_be_compared(spark):
    """One bad graph takes out its own pairs only; a student without an agent id has scores like any other."""
    t = frame(spark, baseline(), baseline(case_id="E2", facts=[fact("F1", "x"), fact("fact-2", "y")]), baseline(case_id="E3", rules=[], edges=[]))
    mute = student(rules=[], edges=[edge("E1", "F1", "I1", "triggers")]) | {"agent_id": None}
    s = frame(spark, mute, student(), student(edges=[edge("E1", "F1", "F99", "triggers")]) | {"agent_id": "bad"}, student(case_id="E2"), student(case_id="E4"))
    scores, reports, errors = sweep.sweep(t, s)
    assert {(r["case_id"], r["student"]): r["l_ged"] for r in scores.collect()} == {("E1", ""): 4.0, ("E1", "s"): 0.0}
    assert {(r["case_id"], r["student_id"]) for r in reports.collect()} == {("E1", ""), ("E1", "s")}
    assert {(r["case_id"], r["student"]): r["error"] for r in errors.collect()} == {("E1", "bad"): "edge_ref E1 dst=F99", ("E2", "s"): "teacher: id fact-2 not F and a number", ("E4", "s"): "no teacher graph"}
    assert sweep.select_pairs(s, ["E1"], [""]).count() == 1


def test_threshold_scores_are_those_of_each_threshold(spark):
    words = ["the tool screens resumes", "the tool ranks resumes of applicants", "notice was given late", "notice was not given", "an audit took place", "no audit took place at all"]
    t = frame(spark, baseline(facts=[fact(f"F{i + 1}", w) for i, w in enumerate(words[::2])]))
    s = frame(spark, student(facts=[fact(f"F{i + 1}", w) for i, w in enumerate(words[1::2])]), baseline("agent", "w", facts=[fact("F1", "quite other words")]))
    both = al.pair_sides(nodes.flatten_nodes(t), nodes.flatten_nodes(s))
    pairs = both.select("case_id", "student").distinct()
    e = nodes.flatten_edges(t).drop("agent_id").join(pairs, "case_id").withColumn("side", F.lit("t")).unionByName(nodes.flatten_edges(s).withColumnRenamed("agent_id", "student").withColumn("side", F.lit("s")))
    levels, cols = (0.1, 0.3, 0.5), ("case_id", "student", "v_miss", "v_halluc", "e_diff", "l_ged")
    got = {(r["threshold"], *(r[c] for c in cols)) for r in calibrate.threshold_scores(both, e, levels).collect()}
    want = set()
    for level in levels:
        a = al.align(both, threshold=level)
        want |= {(level, *(r[c] for c in cols)) for r in diff.l_ged(diff.v_miss(both, a), diff.v_halluc(both, a), diff.e_diff(both, a, e), both).collect()}
    assert got == want and len({r[3] for r in want}) > 1
    judged = calibrate.judge(calibrate.threshold_scores(both, e, levels).where("case_id = 'E1'"), "s", "w")
    assert calibrate.recommend(judged).count() == 1


def test_curve_is_the_scores_of_each_threshold(spark):
    """Also where ids repeat, on both sides, so that an id's partner changes as the threshold falls."""
    rng = random.Random(3)
    words = "the tool screens ranks resumes of applicants notice was given late not an audit took place".split()
    some = lambda n, ids: [fact(f"F{i}", " ".join(rng.choices(words, k=5))) for i in ids[:n]]
    ids = [1, 2, 3, 3, 4, 5, 2]
    es = [edge(f"E{i}", f"F{a}", f"F{b}", rng.choice(("supports", "triggers"))) for i, (a, b) in enumerate(itertools.permutations(range(1, 6), 2))]
    t = frame(spark, *(graph(case=f"E{c}", facts=some(7, ids), edges=es) for c in range(4)))
    s = frame(spark, *(graph(case=f"E{c}", source="agent", agent="s", facts=some(6, ids), edges=rng.sample(es, 9)) for c in range(4)))
    both = al.pair_sides(nodes.flatten_nodes(t), nodes.flatten_nodes(s))
    e = nodes.flatten_edges(t).drop("agent_id").withColumn("student", F.lit("s")).withColumn("side", F.lit("t")).unionByName(nodes.flatten_edges(s).withColumnRenamed("agent_id", "student").withColumn("side", F.lit("s")))
    cols = ("case_id", "v_miss", "v_halluc", "e_diff", "l_ged")
    changes = calibrate.events(both, e, least=0.1)
    curve = sorted((r["case_id"], -r["threshold"], *(r[c] for c in cols[1:])) for r in calibrate.calibration_curve(changes).collect())
    assert len(curve) > 12 and len({r[4] for r in curve}) > 3
    levels = (0.15, 0.35, 0.55, 0.8)
    got = {(r["threshold"], *(r[c] for c in cols)) for r in calibrate.threshold_scores(both, e, levels).collect()}
    want = set()
    for level in levels:
        a = al.align(both, threshold=level)
        scores = diff.l_ged(diff.v_miss(both, a), diff.v_halluc(both, a), diff.e_diff(both, a, e), both).collect()
        want |= {(level, *(r[c] for c in cols)) for r in scores}
        for r in scores:  # the curve's last point at or above the level
            at = [x for x in curve if x[0] == r["case_id"] and -x[1] >= level]
            assert not at or at[-1][2:] == tuple(r[c] for c in cols[1:])
    assert got == want


def test_responses_that_share_ids(spark):
    bad = GOOD.replace('"I1", "type"', '"F99", "type"')
    df = spark.createDataFrame([("E1", "agent", "m", "s", t) for t in (GOOD, bad, GOOD, "none")], "case_id string, source string, model_name string, agent_id string, text string")
    good, rejects = parse.parse_responses(df)
    assert good.count() == 2 and sorted(r["reason"] for r in rejects.collect()) == ["edge_ref E1 dst=F99", "no graph found"]


@pytest.mark.parametrize("text,want", [
    ('{"a": 1, "b": [1, 2,], }x', {"a": 1, "b": [1, 2]}), ('{"a": {"b": [{"c": "d"}, {"e"', {"a": {"b": [{"c": "d"}]}}), ('x {"a": "} \\" ]"} y', {"a": '} " ]'}),
    ('{"a": [ "p", "q', {"a": ["p"]}), ('{"a": "b", "c": "d"', {"a": "b", "c": "d"}), ('{"a": "b", "c": tru', {"a": "b"}), ('{"a": 1, "k', {"a": 1}), ("none", None), ("{", {}), ('{"a": {}', {"a": {}}),
])
def test_repair(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parse.repair_json(F.col("t"))).first()[0]
    assert (json.loads(got) if got else None) == (want or None)


BROKEN = [
    ('{"f": [{"a": "1" "b": "2"} {"a": "3"}] "g": []}', {"f": [{"a": "1", "b": "2"}, {"a": "3"}], "g": []}),
    ('{"f": [{"a": "he said "yes" to it", "b": "line\nfeed\t"}]}', {"f": [{"a": 'he said "yes" to it', "b": "line\nfeed\t"}]}),
    ("{'f': [{'a': 'tenant\\'s duty', b: True, c: None, d: NaN, e: -1.5e3, g: 01}]}", {"f": [{"a": "tenant's duty", "b": True, "c": None, "d": None, "e": -1500.0, "g": "01"}]}),
    ("{f: [{a: F1, b: the tenant pays}]}", {"f": [{"a": "F1", "b": "the tenant pays"}]}),
    ('{"f": [{"a": "1", "b": "2", {"a": "3"}]}', {"f": [{"a": "1", "b": "2"}, {"a": "3"}]}),
    ('{"f": [{"a": "1"}, // more\n ... ], # note "x"\n "g": [] /* none */}', {"f": [{"a": "1"}], "g": []}),
    ('{"f": [{"a": "1"}, "g": [{"a": "2"}]}', {"f": [{"a": "1"}], "g": [{"a": "2"}]}),
    ('{"f": [{"a": ["x", "y", "b": "2"}]}', {"f": [{"a": ["x", "y"], "b": "2"}]}), ('{"f": [{"a": ["x", "y"}, {"a": []}]}', {"f": [{"a": ["x", "y"]}, {"a": []}]}),
    ('{"f": [{"a": "1,\n "b": "2"}]}', {"f": [{"a": "1", "b": "2"}]}), ('{"f": [{"a": }, {"b" "2"}], "g": [}', {"f": [{}, {"b": "2"}], "g": []}),
    ('{"f": [{"a": "C:\\x \\\\ \\u00e9 \\""}]}]]}}', {"f": [{"a": 'C:x \\ é "'}]}), ('{"f": [],, "g": [,1,,2,]}', {"f": [], "g": [1, 2]}), ('{"f": [{"a": "1"} }', {"f": [{"a": "1"}]}),
    ('{"f": [{"a": "http://x.y/z", "b": "a, b: c {d} [e]"}]', {"f": [{"a": "http://x.y/z", "b": "a, b: c {d} [e]"}]}), ('{"f": [{"a": "1"}}, {"a": "2"}]}', {"f": [{"a": "1"}, {"a": "2"}]}),
    ('{"f": [{"a": ""}, {"a": "", "b": ""}]', {"f": [{"a": ""}, {"a": "", "b": ""}]}), ('{"facts": [{"fid": "F1", "label": "a"}, {"fid": "F2", "la', {"facts": [{"fid": "F1", "label": "a"}]}),
    ('{"facts": [{"fid": "F1", "label": "a"}, {"fid": "F2", "label": "b", "polarity": "pre', {"facts": [{"fid": "F1", "label": "a"}, {"fid": "F2", "label": "b"}]}), ('{"facts": [{"fid": "F1", "la', {"facts": [{"fid": "F1"}]}),
]


def test_repair_of_broken_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BROKEN)], "i int, t string")
    for r in df.select("i", parse.repair_json(F.col("t")).alias("r")).collect():
        assert json.loads(r["r"]) == BROKEN[r["i"]][1], BROKEN[r["i"]][0]


def test_repair_of_whole_json_and_of_every_cut(spark):
    """Correct JSON keeps its value; wherever it is cut, what comes out is JSON and holds no node that wasn't there."""
    whole = json.loads(GOOD)
    texts = [GOOD[:i] for i in range(1, len(GOOD) + 1)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(4).orderBy("i").select(parse.repair_json(F.col("t"))).collect()]
    assert json.loads(got[-1]) == whole
    for text, out in zip(texts, got):
        for key, value in (json.loads(out) if out else {}).items():
            assert all(x.items() <= y.items() for x, y in zip(value, whole[key])) if isinstance(value, list) else value == whole[key], text


def test_repair_of_a_long_answer(spark):
    """Work grows with the tokens: 45,000 of them, escapes without end, and a node of many pieces."""
    nodes_ = ", ".join(f'{{"fid": "F{i}" "label": "x \\" y"}}' for i in range(5000))
    refs = ", ".join(f'"F{i}"' for i in range(3000))
    texts = ['{"facts": [' + nodes_ + ', {"fid": "F', '{"facts": [{"fid": "F1", "label": "' + '\\"' * 60_000 + '"}, {"fid', '{"conclusions": [{"cid": "C1" "determination": "x", "support_refs": [' + refs]
    got = [json.loads(r[0]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(parse.repair_json(F.col("t"))).collect()]
    assert [x["fid"] for x in got[0]["facts"]] == [f"F{i}" for i in range(5000)] and got[1]["facts"][0]["label"] == '"' * 60_000
    assert got[2]["conclusions"][0]["support_refs"] == [f"F{i}" for i in range(3000)]


def test_repair_of_a_quote_behind_many_backslashes(spark):
    """However many escaped backslashes stand before it, a quote inside a string is escaped."""
    text = '{"f": [{"a": "x' + "\\" * 34 + '" y" "b": 1}]}'
    got = spark.createDataFrame([(text,)], "t string").select(parse.repair_json(F.col("t"))).first()[0]
    assert json.loads(got) == {"f": [{"a": "x" + "\\" * 17 + '" y', "b": 1}]}


def test_a_cut_node_goes_and_its_graph_stays(spark):
    good, bad = parsed(spark, '{"facts": [{"fid": "F1", "label": "a"}, {"fid": "F2", "la')
    assert not bad and good[0]["repaired"] and [f["fid"] for f in good[0]["facts"]] == ["F1"]
    assert parsed(spark, S.JSON_MARKER + '{"facts": [{"fid": "F1", "la')[1] == ["required F1 label"]


def test_mended_graphs_say_so(spark):
    cut = GOOD[: GOOD.index('"edges"') + 12]
    good, bad = parsed(spark, f"{S.JSON_MARKER} {cut}")
    assert not bad and good[0]["repaired"] and [f["fid"] for f in good[0]["facts"]] == ["F1"] and good[0]["edges"] == []
    assert not parsed(spark, GOOD)[0][0]["repaired"]


def test_calibration(spark):
    rows = [(0.1, "b", 40, 19, 10.0), (0.1, "w", 1, 1, 9.0), (0.2, "b", 20, 9, 5.0), (0.2, "w", 1, 1, 9.0), (0.3, "b", 21, 3, 5.0), (0.3, "w", 1, 1, 9.0)]
    df = spark.createDataFrame(rows, "threshold double, student string, v_miss long, v_halluc long, l_ged double")
    assert calibrate.recommend(calibrate.judge(df, "b", "w")).first()["threshold"] == 0.2
    assert calibrate.recommend(calibrate.judge(df.where("threshold < 0.15"), "b", "w")).first()["threshold"] == 0.1


def test_sweep_resumes(spark):
    t = frame(spark, baseline(), baseline(case_id="E2"))
    s = frame(spark, student(rules=[], edges=[edge("E1", "F1", "I1", "triggers")]), student(case_id="E2", agent_id="s"), student(case_id="Z9"))
    scores, reports, errors = sweep.sweep(t, s)
    assert [tuple(r) for r in errors.collect()] == [("Z9", "s", "no teacher graph")]
    assert {(r["case_id"], r["student"]): (r["l_ged"], r["teacher_nodes"], r["student_nodes"]) for r in scores.collect()} == {("E1", "s"): (4.0, 4, 3), ("E2", "s"): (0.0, 4, 4)}
    assert {r["case_id"]: len(r["v_miss"]) for r in reports.collect()} == {"E1": 1, "E2": 0}
    done = scores.where("case_id = 'E1'").select("case_id", "student")
    assert [r["case_id"] for r in sweep.select_pairs(s, ["E1", "E2"], ["s"], done).collect()] == ["E2"]


def test_discrepancies_inside_a_row(spark):
    """What a pair's row tells by itself is what the tables tell; an id that is null is held by none."""
    ddl = "t array<struct<node_id string, node_type string>>, s array<struct<node_id string, node_type string>>, a array<struct<teacher_id string, student_id string>>"
    row = ([("F1", "F"), ("F2", "F"), ("R1", "R"), (None, "R")], [("F1", "F"), ("A1", "A"), (None, "C")], [("F1", "F1"), ("F2", None), ("R1", None), (None, None)])
    df = spark.createDataFrame([row, ([], [], [])], ddl)
    miss, extra = diff.missing_in(F.col("t"), F.col("a")), diff.extra_in(F.col("s"), F.col("a"))
    kinds = diff.breakdown_in(F.transform(miss, lambda x: x["node_type"]), F.transform(extra, lambda x: x["node_type"]))
    got, empty = df.select(F.transform(miss, lambda x: x["node_id"]).alias("m"), F.transform(extra, lambda x: x["node_id"]).alias("h"), kinds.alias("k")).collect()
    assert got["m"] == ["F2", "R1"] and got["h"] == ["A1", None]
    assert {r["node_type"]: (r["v_miss"], r["v_halluc"]) for r in got["k"]} == {"F": (1, 0), "I": (0, 0), "R": (1, 0), "A": (0, 1), "C": (0, 1), "O": (0, 0)}
    assert not empty["m"] and not empty["h"] and all((r["v_miss"], r["v_halluc"]) == (0, 0) for r in empty["k"])


def test_edges_inside_a_row(spark):
    """Weights from a graph's row are those of the joined tables; of nodes that share an id the last counts, and an end that isn't there weighs nothing."""
    g = frame(spark, baseline(), baseline(case_id="E2", agent_id="x", edges=[edge("E1", "F1", "Z9", "triggers"), edge("E2", "R1", "F1", "supports"), edge("E3", "F1", "Z9", "supports")]))
    cols = ("case_id", "agent_id", "pos", "eid", "src", "dst", "type", "weight")
    joined = nodes.edges_with_weights(nodes.flatten_edges(g), nodes.flatten_nodes(g)).select(*cols)
    assert sorted(map(str, nodes.weighted_edges(g).select(*cols).collect())) == sorted(map(str, joined.collect()))
    got = explain.inbound_edges(g).where("case_id = 'E2'")
    assert {r["dst"]: (r["n_edges"], r["inbound"]) for r in got.collect()} == {"Z9": (2, "E1 F1 triggers; E3 F1 supports"), "F1": (1, "E2 R1 supports")}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_equal_texts_meet_in_as_many_tasks_as_their_pairs_need(spark, monkeypatch):
    """Few rows that make many pairs aren't put into few tasks."""
    monkeypatch.setattr(similarity, "BLOCK", 2)
    monkeypatch.setattr(similarity, "TILES", 1)
    rows = [("c", "s", "F", side, i, f"F{i}", " 1") for side in "ts" for i in range(8)]
    pairs = similarity.tfidf_pairs(spark.createDataFrame(rows, "case_id string, student string, node_type string, side string, pos int, node_id string, match_text string"), 0.1)
    assert {(r["t_pos"], r["s_pos"], r["similarity"]) for r in pairs.collect()} == {(i, j, 1.0) for i in range(8) for j in range(8)}
    assert pairs.rdd.getNumPartitions() >= 16


def test_node_deltas_join_only_the_orders(spark):
    """Both graphs are counted in the order's own row: no more shuffles than the orders themselves take, and part's texts aren't read."""
    from tessera.plans import adapters, catalog

    d = "/root/testdata/sf0.001"
    deltas, orders = (df._jdf.queryExecution().optimizedPlan().toString() for df in (catalog.QUERIES["node_deltas"](spark, d), adapters.orders(spark, d)))
    assert 0 < deltas.count("Join ") <= orders.count("Join ")
    only_key = r"Project \[p_partkey#\d+L AS l_partkey#\d+L\]"
    assert re.search(only_key, deltas) and not re.search(only_key, orders)


NODES = "case_id string, student string, node_type string, side string, pos int, match_text string"


def _word_rows(seed, groups, words, most):
    rng = random.Random(seed)
    return [(f"c{c}", "s", "F", side, p, " ".join(rng.choice(words) for _ in range(rng.randrange(most)))) for c, n in enumerate(groups) for side in "ts" for p in range(n + (side == "s"))]


@pytest.mark.parametrize("texts,rounds,words", [(4, (1,), 6), (5, (1, 3), 30), (64, (2,), 12)])
def test_few_pairs_of_each_give_the_matches_of_all(spark, monkeypatch, texts, rounds, words):
    """Copies, ties and texts of one word, in one block and in many; what few pairs can't tell waits for later rounds."""
    monkeypatch.setattr(similarity, "TEXTS", texts)
    df = spark.createDataFrame(_word_rows(texts, (3, 22, 40), [f"w{k}" for k in range(words)], 5), NODES)
    kinds = df.withColumn("kind", F.col("pos"))
    made = similarity.term_blocks(df.withColumn("times", F.lit(1).cast("long")), 0.1)
    got, want = {}, {}
    for r in assign.greedy_by_nearest(kinds, made, 0.1, rounds).collect():
        got.setdefault(r["case_id"], []).append((r["t_pos"], r["s_pos"], round(r["similarity"], 9)))
    for r in similarity.tfidf_pairs(df, 0.1).collect():
        want.setdefault(r["case_id"], []).append((r["t_pos"], r["s_pos"], r["similarity"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(*x[:2], round(x[2], 9)) for x in greedy(v)] for k, v in want.items()}


def test_pairs_listed_follow_from_nodes(spark):
    """100 teachers and 100 students that all have something in common would be 10,000 pairs."""
    rng = random.Random(1)
    rows = [("c", "s", "F", side, p, " ".join(["all", *(f"w{rng.randrange(40)}" for _ in range(3))])) for side in "ts" for p in range(100)]
    df = spark.createDataFrame(rows, NODES)
    made = similarity.term_blocks(df.withColumn("times", F.lit(1).cast("long")), 0.001)
    assert similarity.block_pairs(made, 0.001).count() == 10_000
    assert similarity.nearest(made, 0.001, 3).select(F.sum(F.size("similarity"))).first()[0] < 1500
    alone = similarity.kept_in(made, df.where("pos < 10").select(*similarity.GROUP, "side", "pos"))
    assert similarity.block_pairs(alone, 0.001).collect() and {tuple(r) for r in similarity.block_pairs(alone, 0.001).collect()} == {tuple(r) for r in similarity.block_pairs(made, 0.001).where("t_pos < 10 and s_pos < 10").collect()}


def test_a_file_of_blocks_holds_one(spark, monkeypatch):
    """Spark's reader decodes many rows of a file at once, so blocks that share a file would all be in memory."""
    monkeypatch.setattr(similarity, "TEXTS", 5)
    df = spark.createDataFrame(_word_rows(2, (30, 40), ["ab", "cd", "ef"], 4), NODES)
    made = similarity.term_blocks(df.withColumn("times", F.lit(1).cast("long")), 0.1)
    assert made.count() > 20 and len(made.inputFiles()) >= made.count()


@pytest.mark.parametrize("small", [256, 0])
def test_counts_at_thresholds_without_pairs_as_rows(spark, monkeypatch, small):
    monkeypatch.setattr(similarity, "SMALL", small)
    monkeypatch.setattr(similarity, "TEXTS", 5)
    rows = _word_rows(4, (3, 12), ["ab", "cd", "ef", "gh"], 4) + [("plain", "s", "F", side, p, "x") for side in "ts" for p in range(3)]
    df = spark.createDataFrame(rows, NODES)
    pairs, levels = [tuple(r) for r in similarity.tfidf_pairs(df, 0.1).collect()], (0.1, 0.5, 0.999, 1.5)
    want = set()
    for x in levels:
        hit = [p for p in pairs if p[5] >= x]
        want |= {(x, len(hit), len({(p[0], p[3]) for p in hit}), len({(p[0], p[4]) for p in hit}))} if hit else set()
    assert {tuple(r) for r in calibrate.match_counts(df, levels).collect()} == want


def test_differences_inside_the_row_of_a_pair(spark):
    """Arrays of one row give what tables give, with ids that repeat, unknown ends, edges without a type and labels in capitals."""
    rng = random.Random(5)
    teachers, students, given = [], [], []
    for g in range(20):
        def lists(n, side):
            kinds = ["triggers", "supports", None]
            ids = [f"F{rng.randint(1, n)}" for _ in range(n)]
            edges = [edge(f"E{k}", f"F{rng.randint(1, n + 1)}", f"F{rng.randint(1, n)}", rng.choice(kinds)) for k in range(2 * n)]
            return {"facts": [fact(i, rng.choice(["a", " A", "b", "C", "d"])) for i in ids], "rules": [rule(i.replace("F", "R"), "§ 1", authority=rng.choice(["binding", "advisory"])) for i in ids], "edges": edges}
        teachers.append(graph(f"c{g}", **lists(4, "t")))
        students.append(graph(f"c{g}", "agent", "x", **lists(3, "s")))
        ids = {f["fid"] for f in teachers[-1]["facts"]} | {r["rid"] for r in teachers[-1]["rules"]}
        given += [(f"c{g}", "x", i, rng.choice([None, "F1", "F2", "R1"])) for i in sorted(ids)]
    t, s = frame(spark, *teachers), frame(spark, *students)
    aligned = spark.createDataFrame(given, "case_id string, student string, teacher_id string, student_id string")
    both = al.pair_sides(nodes.flatten_nodes(t), nodes.flatten_nodes(s))
    te = nodes.flatten_edges(t).drop("agent_id").withColumns({"student": F.lit("x"), "side": F.lit("t")})
    se = nodes.flatten_edges(s).drop("agent_id").withColumns({"student": F.lit("x"), "side": F.lit("s")})
    edges = diff.e_diff(both, aligned, te.unionByName(se))
    row = t.select("case_id", nodes.node_list().alias("t"), F.col("edges").alias("te")).join(s.select("case_id", nodes.node_list().alias("s"), F.col("edges").alias("se")), "case_id")
    row = row.join(aligned.groupBy("case_id").agg(F.collect_list(F.struct("teacher_id", "student_id")).alias("a")), "case_id")
    row = row.withColumn("differ", diff.e_diff_in(F.col("t"), F.col("a"), F.col("te"), F.col("se")))
    shown = row.select("case_id", F.inline("differ"))
    cols = shown.columns
    assert cols == edges.drop("student").columns and sorted(map(repr, map(tuple, shown.collect()))) == sorted(map(repr, map(tuple, edges.select(*cols).collect()))) and shown.count() > 20
    miss, halluc = diff.missing_in(F.col("t"), F.col("a")), diff.extra_in(F.col("s"), F.col("a"))
    want = diff.l_ged(diff.v_miss(both, aligned), diff.v_halluc(both, aligned), edges, both).drop("student")
    assert {tuple(r) for r in row.select("case_id", *diff.l_ged_in(miss, halluc, F.col("differ"))).collect()} == {tuple(r) for r in want.collect()}
    labels = row.select("case_id", F.inline(explain.label_diff_in(F.col("t"), F.col("s"))))
    whole = explain.label_diff(t, s).select(*labels.columns)
    assert labels.count() and sorted(map(repr, map(tuple, labels.collect()))) == sorted(map(repr, map(tuple, whole.collect())))


def test_given_differences_shuffle_no_more_than_the_orders(spark):
    """Edge differences, edit distances and label differences move lines and orders alone: no node or edge."""
    d = "/root/testdata/sf0.001"
    least = _physical(catalog.QUERIES["v_miss"](spark, d)).count("Exchange hashpartitioning")
    for name in ("e_diff", "lged", "label_diff"):
        assert _physical(catalog.QUERIES[name](spark, d)).count("Exchange hashpartitioning") == least
