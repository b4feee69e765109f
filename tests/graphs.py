"""Tiny graphs for tests."""

import json

from tessera import schema as S


def fact(i, label, **kw):
    return {"fid": i, "label": label, "polarity": "present", **kw}


def rule(i, citation, label="rule", authority="binding"):
    return {"rid": i, "citation": citation, "label": label, "authority": authority, "jurisdiction": "NYC"}


def edge(i, src, dst, kind, justification=None):
    return {"eid": i, "src": src, "dst": dst, "type": kind, "justification": justification}


def graph(case="E1", source="reference", agent=None, **lists):
    base = {c: [] for c, _ in S.NODE_LISTS.values()} | {"edges": []}
    return {"case_id": case, "source": source, "model_name": "m", "agent_id": agent, **base, **lists}


def frame(spark, *graphs):
    return spark.read.schema(S.GRAPH_DDL).json(spark.sparkContext.parallelize([json.dumps(g) for g in graphs], 2))


def baseline(source="reference", agent=None, **change):
    g = graph(
        source=source,
        agent=agent,
        facts=[fact("F1", "The depot opened in spring"), fact("F2", "A scheduler assigns the drivers")],
        issues=[{"iid": "I1", "label": "whether the drivers were told", "status": "dispositive"}],
        rules=[rule("R1", "§ 20-871(d)(2)", "notice to drivers")],
        edges=[edge("E1", "F1", "I1", "triggers"), edge("E2", "R1", "I1", "applies-to")],
    )
    return g | change
