import re
from collections import Counter
from itertools import permutations

from odd_rows import LONG, NASTY

from isobar.llm import audit as module
from isobar.llm.audit import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(rows):
    """rows: (doc_id, text, lang); the letters that each fails."""
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        out.append("".join([
            "A" * (len(words) < 100), "B" * (100 * len(set(words)) < 80 * len(words)),
            "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)), "D" * bool(re.search(r"[#$%&*|]", text)),
            "E" * any(i is not None and j is not None and j < i and (other or "") == text for j, other, _ in rows),
        ]))
    return out


def brute_force(rows, labels):
    """Each order applied, filter after filter, to what the ones before have left."""
    failed, out = failures(rows), {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        removals = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone, left = [d for d in left if name in d[1]], [d for d in left if name not in d[1]]
                removals[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in own) - len(gone), sum(f == name for _, f in own),
                    sum(labels.get(i, (0, 0))[0] == 1 for i, _ in gone), sum(labels.get(i, (0, 0))[1] == 1 for i, _ in gone), name,
                ]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = removals[row[-1]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, 1, "h") for r in rows],
                                 "doc_id long, text string, lang string, part string, bits int, n long, hash string")


def check(spark, rows, labels):
    marks = spark.createDataFrame([(i, q, t, "z") for i, (q, t) in labels.items()], "doc_id long, quality int, toxic int, part string")
    result = audit(table(spark, rows), marks).collect()
    found = {(r.part, r.filter_order, r.step): list(r)[3:] for r in result}
    assert len(found) == len(result) and found == brute_force(rows, labels)


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(120))
    rows = [(i, t, ("en", None, "", "de")[k % 4]) for k, (i, t) in enumerate(NASTY)]
    rows += [(20, text, "en"), (21, text, "en"), (22, text, "de"), (22, text, "de"), (23, text + " $", "en"), (24, text.upper(), "en"),
             (25, LONG, "fr"), (26, LONG + " ", "fr"), (27, None, "fr"), (28, " ", "fr")]
    check(spark, rows, {20: (1, 0), 21: (1, 1), 22: (0, 1), 25: (1, 1), 5: (1, 0)})


def test_hot_text_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(module, "HOT", 3)
    rows = [(i, "the same" if i % 2 else f"own {i}", "en") for i in range(40)]
    check(spark, rows, {1: (1, 1), 3: (1, 0)})


def test_empty_tables(spark):
    assert audit(table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
