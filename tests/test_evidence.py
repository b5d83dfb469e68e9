"""Evidence named by a query: JSON on one line, plain text, missing and unreadable files."""

import json

from plumbtrace.operators.enrich import MISSING_EVIDENCE, NO_EVIDENCE, evidence_lookup


def test_evidence_by_kind_of_file(spark):
    body = {"feature": "größe", "values": list(range(900)), "none": None, "share": 0.1}
    docs = [("a.json", json.dumps(body, indent=4, ensure_ascii=False)), ("b.json", "{broken"), ("c.json", None), ("d.json", ""),
            ("e.txt", '{\n  "kept": 1\n}' + "x" * 2000), ("f.txt", ""), ("g.JSON", "{\n}"), ("none", "never read"), ("i.json", "[ ]")]
    asked = [(k, name) for k, (name, _) in enumerate(docs)] + [(20, None), (21, ""), (22, "None"), (23, "absent.json"), (24, "a.json")]
    rows = evidence_lookup(
        spark.createDataFrame(asked, "item long, file string"), spark.createDataFrame(docs, "file string, text string"), "file", "text").collect()
    got = {r.item: r.evidence for r in rows}
    assert len(rows) == len(asked)
    assert got[0] == got[24] == json.dumps(body)[:1500] and "\n" not in got[0]
    assert got[1].startswith("Error loading XAI: Expecting property name")
    assert got[2] == MISSING_EVIDENCE and got[3].startswith("Error loading XAI: Expecting value")
    assert got[4] == docs[4][1][:1500] and got[5] == "" and got[6] == "{\n}" and got[8] == "[]"
    assert got[7] == got[20] == got[21] == got[22] == NO_EVIDENCE and got[23] == MISSING_EVIDENCE


def test_empty_documents(spark):
    rows = evidence_lookup(
        spark.createDataFrame([(1, "a.json")], "item long, file string"),
        spark.createDataFrame([], "file string, text string"), "file", "text").collect()
    assert [r.evidence for r in rows] == [MISSING_EVIDENCE]
