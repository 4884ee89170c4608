import hashlib
import re

import odd
from feedloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(digits)):
            x = int(c) * (1 + i % 2)
            total += x - 9 if x > 9 else x
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [
        (m.start(), k, m.end(), kind)
        for k, (kind, pattern) in enumerate(BASE.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


TEXTS = [
    None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255 1.2.3.000000000000000000255",
    "+1 (234) 567-8901 +123 4 +12345678901234567890 +++1 234 567 890 (",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 4111  1111 1111 1111",
    "é😀 a.b+c@d-e.co.uk, ü 10.0.0.1 +49 30 1234567", "x" * 30_000 + "@a.b " + "9" * 30_000 + " 1.1.1.1",
    "a@b a@b. a@b.c. a@.b @a.b", " ".join(f"u{i}@h{i}.com" for i in range(2000)), "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "card 4111 1111 1111 1111\n4111 1111 1111 1111 ip 1.1.1.1\n2", "+4111 1111 1111 1111",
]


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = odd.documents(spark, [*rows, rows[4], rows[4], (None, TEXTS[6])])
    got = pii.digest(pii.sanitise(docs, keep=("doc_id", "text", "kept"))).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        want = base(r.text)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.spans == want
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(k + ":") for k in BASE)
        for kind, pattern in BASE.items():
            left = [m[0] for m in re.finditer(pattern, r.clean_text) if valid(kind, m[0])]
            assert left == [], (kind, r.clean_text[:80])


def test_disclosing_terms(spark):
    """A nickname that occurs with one address only goes; common words stay; what copies say is no evidence."""
    other = [f"other words today number {i}, a note from the tail" for i in range(60)]
    rows = [(i, f"note {i} of words from moonraker at moon@example.com today" + " tail" * i) for i in range(4)]
    rows += [(10 + i, t) for i, t in enumerate(other)]
    rows += [(100 + i, "secretive passage by copy@example.com for all") for i in range(5)]
    got = {r.doc_id: r for r in pii.sanitise(odd.documents(spark, rows)).collect()}
    for i in range(4):
        assert got[i].clean_text == f"note {i} of words from  at [EMAIL] today" + " tail" * i
        assert [s.action for s in got[i].all_spans if s.kind == 4] == ["remove"]
    assert got[100].clean_text == "secretive passage by [EMAIL] for all"
    assert [got[10 + i].clean_text for i in range(60)] == other


def test_two_documents_are_evidence(spark):
    """A name in both documents of a value is told from words of one of them, of one text's copies and of many."""
    other = [f"other words today number {i}, a note from the tail" for i in range(60)]
    rows = [(0, "first note from Moonraker, pair@example.com, lantern today"), (1, "later words by Moonraker: pair@example.com anchor")]
    rows += [(2, "single secretive passage, one@example.com")]
    rows += [(3 + i, "thrice@example.com lonesome, thrice@example.com willow, thrice@example.com") for i in range(3)]
    rows += [(10 + i, t) for i, t in enumerate(other)]
    got = {r.doc_id: r for r in pii.sanitise(odd.documents(spark, rows)).collect()}
    assert got[0].clean_text == "first note from , [EMAIL], lantern today"
    assert got[1].clean_text == "later words by : [EMAIL] anchor"
    assert got[2].clean_text == "single secretive passage, [EMAIL]"
    assert got[3].clean_text == "[EMAIL] lonesome, [EMAIL] willow, [EMAIL]"


def test_terms_of_whole_documents(spark):
    """A short name far from its value goes; so it is counted where it stands far off or in lower case, on both sides."""
    fill = " other words today, a note by an editor" * 20
    rows = [(i, f"Li and Moonraker,{fill} {i} end of it li@example.com") for i in range(3)]
    rows += [(3, f"far@example.com Jo, Beacon{fill} 3"), (4, f"far@example.com {fill} 4 jo: Beacon"), (5, f"Ann {fill} 5")]
    rows += [(10 + i, f"{fill} {i} end of it and an Ann") for i in range(60)]
    got = {r.doc_id: r for r in pii.sanitise(odd.documents(spark, rows)).collect()}
    for i in range(3):
        assert got[i].clean_text == f" and ,{fill} {i} end of it [EMAIL]"
    assert got[3].clean_text == f"[EMAIL] , {fill} 3"
    assert got[4].clean_text == f"[EMAIL] {fill} 4 : "
    assert got[5].clean_text == f"Ann {fill} 5"


def test_clean_keeps_columns(spark):
    docs = odd.documents(spark, [(odd.BIG, "at 1.1.1.1"), (2, None), (None, "x")])
    got = pii.clean(docs)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text, r["odd name.x"]) for r in got.collect()} == {(odd.BIG, "at [IP]", 1), (2, None, 1), (None, "x", 1)}
    assert pii.sanitise(odd.empty(spark)).collect() == []


def test_no_python(spark):
    plan = pii.digest(pii.sanitise(odd.documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow|Cartesian|NestedLoop", plan)
