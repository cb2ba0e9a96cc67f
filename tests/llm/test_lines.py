import hashlib
from collections import defaultdict

from starwake.llm.lines import drop_common_lines
from tests.llm.corpus import BLANKS, documents, low, result

LONG = "the same old line of twenty and more"


def brute(rows):
    holders = defaultdict(set)
    for at, (doc, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            holders[low(line.strip(BLANKS))].add((at, doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = []
        for line in lines:
            key = low(line.strip(BLANKS))
            ids = [one for _, one in holders[key]]
            known = [one for one in ids if one is not None]
            last = max(known) if known else None
            gone.append(len(key) >= 20 and len(ids) >= 3 and doc != last)
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [
        (1, f"{LONG}\nown line one\n{LONG.upper()}  "),
        (2, f"\t{LONG}\r\nshort\nshort"),
        (3, f"{LONG}"),
        (4, None),
        (5, ""),
        (6, "é" * 20 + "\nÉ" + "é" * 19),
        (7, "é" * 20),
        (8, "é" * 20 + "\n" + "x" * 19),
        (9, "x" * 19 + "\n\n"),
        (10, "\n".join(f"line {n} {LONG}" for n in range(3000)) + f"\n{LONG}"),
        (10, "another text under one id"),
        (11, f"{LONG} "),
        (None, LONG),
        (None, None),
        (12, LONG),
        (12, LONG),
    ]
    got = drop_common_lines(documents(spark, rows))
    found = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()]
    assert sorted(found, key=str) == brute(rows)
    assert [name for name in got.columns if name not in ("n_lines", "n_dropped")] == [
        name for name in documents(spark, rows).columns if name != "n_lines"
    ]


def test_all_null_ids_keep_their_lines(spark):
    got = drop_common_lines(documents(spark, [(None, LONG)] * 3)).collect()
    assert [(r.n_dropped, r.text) for r in got] == [(0, LONG)] * 3


def test_empty_table(spark):
    assert drop_common_lines(documents(spark, [])).count() == 0


def test_digest_of_nothing_left(spark):
    got = result(drop_common_lines(documents(spark, [(1, LONG), (2, LONG), (3, LONG)])))
    assert got[1].text == "" and got[3].text == LONG
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
