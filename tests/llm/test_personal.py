"""Personal data against the patterns written plainly, and discovery on planted contexts."""

import random
import re

import pytest

from gradelake.llm import personal


def plain(text):
    """The patterns as they are stated."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1]))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_patterns():
    rng = random.Random(4)
    texts = ["", "a@b.c@d.e", "a@@b.c", "x.y+z@a-b.co.uk.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (743) 555-3824", "é@b.c ñ1.2.3.4", "@a.b +", "+1 2+3 4567890"]
    texts += ["".join(rng.choices(rng.choice(["ab@.-1 +", "0123456789.- ", "4111 -", "+12 ().-x", "a@b.c é"]), k=rng.randrange(80))) for _ in range(4000)]
    for t in texts:
        assert personal.base_spans(t) == plain(t), t
    assert personal.base_spans(None) == []
    for piece in ("a", "1", "@", ".", "1.", "a@", "+1 "):  # linear in long runs
        personal.base_spans(piece * 200_000)


def test_discovery(spark):
    rng = random.Random(6)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(60):
        said = rng.choices(words, k=30)
        if i % 3 == 0:
            said[10:11] = ["mailbox:", f"user{i}@host.example.org"]
        if i % 3 == 1 and i < 20:
            said[10:11] = ["mailbox:", f"user{i}(at)host"]
        if i % 3 == 2:
            said[5:6] = [said[5], f"id{i}x"]
        rows.append((i, " ".join(said), "x"))
    rows += [(100, None, None), (101, "", None), (None, "write to user1(at)host now", None), (102, "write to user1(at)host now", None), (102, "write to user1(at)host now", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = personal.find(frame).collect()
    assert len(got) == len(rows)
    texts = dict((k, t) for k, t, _ in rows)
    for r in got:
        text = texts[r.doc_id] or ""
        base = [tuple(s) for s in r.base]
        assert base == plain(text)
        new = [text[s.start:s.end] for s in r.spans if tuple(s) not in base]
        hidden = re.findall(r"user[0-9]+\(at\)host", text)
        assert new == hidden and all(s.kind == "email" for s in r.spans)
    assert personal.find(frame.limit(0)).count() == 0


@pytest.mark.parametrize("pure", [2, 4])
def test_much_evidence_is_kept(spark, pure):
    """Beliefs of values in several pure contexts round to one."""
    contexts = [("left" if i % 2 else "right", f"pure{chr(97 + i)}") for i in range(pure)]
    bases, new = [f"a{i}@b.c" for i in range(3000)], [f"a{i}(at)b" for i in range(3)]
    rows = [("email", v, *c) for v in bases for c in contexts] + [(None, v, *c) for v in new for c in contexts]
    seen = spark.createDataFrame(rows, "kind string, value string, side string, word string")
    words = spark.createDataFrame([(w, len(bases) + len(new)) for _, w in contexts], "word string, n long")
    got = {tuple(r) for r in personal.believe(seen, words).collect()}
    assert got == {(v, "email") for v in new}


def test_believed_values_open_contexts(spark):
    """Values lead to a context beside which no base entity stands."""
    texts = [f"mailbox: a{i}@b.c" for i in range(20)] + [f"{c} v{i}(at)host" for i in range(3) for c in ("mailbox:", "reach")] + ["reach w7(at)host"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.spans] for r in personal.find(frame).collect()}
    assert got == {i: [t.split()[1]] for i, t in enumerate(texts)}
