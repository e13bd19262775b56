from itertools import permutations

import pytest

from scriptorium.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Every order walked document by document."""
    import re

    texts = {}
    for r in rows:
        if r.doc_id is not None:
            t = r.text or ""
            texts[t] = min(texts.get(t, r.doc_id), r.doc_id)
    good = {r[0] for r in labels if r[1] == 1} - {None}
    toxic = {r[0] for r in labels if r[2] == 1} - {None}
    parts = {}
    for r in rows:
        t = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": re.search("[#$%&*|]", t) is not None, "E": r.doc_id is not None and r.doc_id > texts[t],
        }
        parts.setdefault(r.source or "", []).append((fails, r.doc_id in good, r.doc_id in toxic))
    out, total = {}, {}
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                out[part, order, k + 1] = [
                    len(left), len(gone), sum(any(d[0][g] for g in order[:k]) and d[0][f] for d in docs), sum([g for g in "ABCDE" if d[0][g]] == [f] for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def clashing(docs):
    """Columns whose names the plan uses itself."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("part", "digest", "first", "A", "E", "good", "toxic", "n", "subset")})


@pytest.mark.parametrize("extra", [False, True])
def test_filter_audit_equals_brute_force(spark, odd, extra):
    labels = [(1, 1, 0), (1, 1, 0), (5, 0, 1), (6, 1, None), (None, 1, 1), (11, 1, 1), (99, 1, 1)]
    docs = clashing(odd) if extra else odd
    got = filter_audit.audit(filter_audit.failures(docs, spark.createDataFrame(labels, LABELS)))
    rows = [tuple(r) for r in got.where("part is not null").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(odd.collect(), labels)
    whole = {r.filter_order: r.kept for r in got.where("part is null and step = 5").collect()}
    assert len(whole) == 120 and len(set(whole.values())) == 1


def test_filter_audit_of_nothing(spark, none):
    assert filter_audit.audit(filter_audit.failures(none, spark.createDataFrame([], LABELS))).count() == 0
