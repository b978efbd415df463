from collections import Counter

import pytest

from sitelens.llm import lines


def slow(rows):
    """Rows of the result by one pass in rank order; rows are different in (id, text)."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept, spans, units, at = [], [], 0, 0
        for line in (text.split("\n") if text is not None else []):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
            norm = " ".join(x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if x)
            if norm:
                units += 1
            if norm and norm in seen:
                spans.append(f"{at}:{at + len(line)}")
            else:
                kept.append(line)
                if norm:
                    seen.add(norm)
            at += len(line) + 1
        out.append((doc, units, len(spans), ",".join(spans), None if text is None else "\n".join(kept)))
    return Counter(out)


ODD = [(1, "A line\nb  LINE\n\n a line \nB line"), (2, "x\na LINE\ny"), (3, ""), (4, None), (5, "\n\n"), (None, "x\nz"), (6, "é\nÉ\né")]


@pytest.mark.parametrize("share", [2000, 1, 10 ** 9])
def test_against_one_pass_in_rank_order(spark, docs, texts, share, monkeypatch):
    monkeypatch.setattr(lines, "HOT_SHARE", share)
    df = docs.select("doc_id", "text").filter("doc_id >= 10").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    want = slow([(i, t) for i, t in texts.items() if i >= 10] + ODD)
    assert Counter(tuple(r) for r in lines.dedup(df).collect()) == want


def test_edges(edge, none):
    rows = lines.dedup(edge).collect()
    assert len(rows) == edge.count() and lines.dedup(none).collect() == []
    same = [r for r in rows if r.kept_text == "Same text here, twice."]
    assert {r.doc_id for r in same} == {1004} and len(same) == 1  # of rows equal in id and text one keeps its lines
    lost = [r for r in rows if r.doc_id == 1004 and r.kept_text == ""]
    assert [(r.n_units, r.n_removed, r.spans) for r in lost] == [(1, 1, "0:22")] * 2


def test_repeated_rows_and_rows_without_id(spark):
    text = "N one\n\nshared\nlast"
    rows = [(1, "shared"), *[(None, text)] * 3, *[(7, text)] * 2, *[(None, None)] * 2]
    got = Counter((r.doc_id, r.n_removed, r.kept_text) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, 0, "shared"): 1, (7, 1, "N one\n\nlast"): 1, (7, 3, ""): 1, (None, 3, ""): 3, (None, 0, None): 2}


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "p one\nq\n\np two"), (2, "P  One\nq\n\nnew")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.spans, r.kept_text) for r in lines.dedup(df, separator="\n\n").collect()}
    assert got == {1: (0, "", "p one\nq\n\np two"), 2: (1, "0:8", "new")}
