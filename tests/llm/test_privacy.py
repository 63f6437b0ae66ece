import hashlib
import math
import random
import re
from collections import Counter

import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shipwatch.llm import privacy as V
from tests.llm.helpers import clashing, docs, words

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (16 <= len(digits) <= 19 and V.luhn(digits)):
                continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


SIGNS = st.sampled_from([*"0123456789.@+-() _%", "a", "b.c", "é", "x@y.z", "1.2.3.4", "255", "256", "4111111111111111", "0007", "\n"])


@settings(max_examples=600, deadline=None)
@given(st.lists(SIGNS, max_size=40).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert V.base_spans(text) == brute(text)


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "1." * 200_000, "a" * 300_000 + "@", "a@" * 150_000, "+1" + " " * 300_000, "+" * 300_000, "1 -" * 100_000):
        V.base_spans(text)


def digest(base):
    return hashlib.sha256(",".join(f"{V.KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [(k, " ".join(words(40, k)) + " é the mail now") for k in range(60)]
    for k in range(6):          # one person, always with the same by-name, in different texts
        w = words(30, 500 + k)
        out.append((100 + k, " ".join(w[:15]) + " é Zorblatt the w1 mail jo@mail.example.org now " + " ".join(w[15:])))
    out += [(200 + k, out[0][1] + " unique copy word qqq at 10.0.0.7") for k in range(8)]       # copies count once
    out += [(300, "+1 (555) 123-4567 and 4111 1111 1111 1111"), (301, None), (302, ""), (None, "a@b.co"),
            (303, "x" * 50_000 + " 1.2.3.4"), (304, "nothing here")]
    r.shuffle(out)
    return out


def test_report(spark, rows):
    for table in (docs(spark, rows).repartition(3), clashing(docs(spark, rows))):
        got = V.privacy_report(table).collect()
        assert len(got) == len(rows)
        texts = {}
        for d, t in rows:
            texts.setdefault(d, []).append(t)
        for x in got:
            text = texts[x.doc_id][0]
            base = brute(text)
            assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
            assert x.base_sha256 == digest(base)
            spans = [s.split(":") for s in x.spans.split(",") if s]
            added = [text[int(a):int(b)] for k, a, b in spans if k == "term"]
            assert [s for s in spans if s[0] != "term"] == [[V.KINDS[k], str(a), str(b)] for k, a, b in base]
            # the by-name discloses the person; common words and words of a copied text do not
            assert added == (["Zorblatt"] if x.doc_id is not None and 100 <= x.doc_id < 106 else []), (x.doc_id, added)


def test_texts_are_sanitised(spark, rows):
    table = clashing(docs(spark, rows))
    out = V.sanitised(table)
    assert out.columns == table.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[300].text == "[PHONE] and [CARD]" and got[301].text is None and got[302].text == ""
    assert got[304].text == "nothing here" and got[None].text == "[EMAIL]"
    assert "é [TERM] the w1 mail [EMAIL] now" in got[103].text and got[103]._added == "x-_added"
    assert got[5].text == dict(rows)[5] and len(got) == len(rows)


def test_no_task_holds_two_python_workers(spark, monkeypatch):
    """A worker lives on after its task, so a second one a task is memory of the executor for good."""
    monkeypatch.setattr(spark, "createDataFrame", None)         # its rows come from Python workers of their own
    out = V.sanitised(spark.range(40).select(F.col("id").alias("doc_id"), F.lit("w1 w2 a@b.ch").alias("text")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Union" in plan, plan      # the quiet texts, and the others
    assert {r.text for r in out.collect()} == {"w1 w2 [EMAIL]"}


def test_overlapping_spans_become_one():
    assert V.redacted("call +4111111111111111 now", [("card", 6, 22), ("phone", 5, 22), ("term", 0, 4)]) == "[TERM] [PHONE] now"


def added_terms(spark, rows, table=None):
    """What the method adds, by document id, as text."""
    texts = dict(rows)
    return {x.doc_id: [texts[x.doc_id][int(a):int(b)] for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k == "term"]
            for x in V.privacy_report(table if table is not None else docs(spark, rows)).collect()}


def test_two_different_texts_are_evidence_and_one_is_not(spark):
    rows = [(k, " ".join(words(60, 900 + k, 60)) + " common") for k in range(1000)]
    rows += [(2000, "common Quillfeather w1 common 10.1.2.3 common"),
             (2001, "common w2 Brandywyne solo@mail.example.org common"), (2002, "w3 Brandywyne common solo@mail.example.org w4"),
             (2003, "w5 Ottoline common"), (2004, "w6 Ottoline w7"), (2005, "w8 Ottoline w9 10.9.9.9 common")]
    got = added_terms(spark, rows)
    assert got[2001] == got[2002] == ["Brandywyne"] and not got[2000]   # ordinary rare words stand in one text, too
    assert not any(got[d] for d in range(1000)) and not got[2005]      # common words; a name that stands mostly elsewhere


def test_rare_words_of_one_text_stay(spark):
    rows = [(k, " ".join(words(30, k, 60))) for k in range(400)]
    said = "the photosynthesis lecture discussed chlorophyll and mitochondria thoroughly contact {}"
    rows.append((500, said.format("bob@example.com")))
    clean = {r.doc_id: r.text for r in V.sanitised(docs(spark, rows)).collect()}
    assert clean[500] == said.format("[EMAIL]") and all(clean[k] == t for k, t in rows[:400])


def test_near_copies_are_one_kind(spark):
    base = [f"rare{k}" for k in range(120)]
    rows = [(k, " ".join(words(30, k, 60))) for k in range(400)]
    for k in range(60):
        w = list(base)
        w[2 * k] = f"edit{k}"
        rows.append((500 + k, " ".join(w) + " jo@mail.example.org"))
    assert not any(added_terms(spark, rows).values())


def wilson(k, n):
    p, z = k / n, V.DEVIATES
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def test_terms_are_those_of_a_plain_count(spark):
    """Many texts a term, copies, several entities; without near copies a text is its own kind."""
    r = random.Random(8)
    people = {f"name{k}": f"p{k}@mail.example.org" for k in range(12)}
    rows = []
    for k, (name, mail) in enumerate(people.items()):
        for _ in range(r.choice([1, 2, 5, 90])):                 # name and entity
            rows.append(" ".join([name, *words(12, r.random(), 5000), mail]))
        for _ in range(r.choice([0, 1, 3, 80])):                 # the name without it
            rows.append(" ".join([name, *words(12, r.random(), 5000)]))
    rows += [" ".join(words(12, r.random(), 5000)) for _ in range(300)]
    rows += rows[:60] + rows[:30]
    table = docs(spark, list(enumerate(rows))).repartition(5)
    texts = {t: (set(re.sub(r"\S+@\S+", "", t).split()), set(re.findall(r"\S+@\S+", t))) for t in rows}
    held, both, df = Counter(), Counter(), Counter()
    for terms, mails in texts.values():
        df.update(terms)
        held.update(mails)
        both.update((t, c) for t in terms for c in mails)
    want = set()
    for (t, c), k in both.items():
        own, left = math.log2(len(texts) / held[c]), -math.log2(wilson(k, df[t]))
        if left <= V.RESIDUAL and own - left >= V.DISCLOSURE * own:
            want.add(t)
    got = {t for _, found in added_terms(spark, list(enumerate(rows)), table).items() for t in found}
    assert got == want and any(t.startswith("name") for t in want) and len(want & set(people)) < 12
    # words that stand in two or three texts of one entity by chance are few
    assert len(want - set(people)) <= 0.001 * len(set(df) - set(people))


def test_a_disclosing_term_goes_at_all_its_places(spark):
    common = [" ".join(words(60, 900 + k, 60)) for k in range(1008)]
    rows = list(enumerate(common[:1000]))
    # far from the entity, twice; in a text without it; under a null id, whose text is its own
    rows += [(2000 + k, f"Quillfeather {c} solo@mail.example.org {c} Quillfeather") for k, c in enumerate(common[1000:])]
    rows += [(3000, "w1 w2 Quillfeather w3"), (None, "w4 quillfeather 1.2.3.4 w5")]
    got = added_terms(spark, rows)
    assert all(got[2000 + k] == ["Quillfeather", "Quillfeather"] for k in range(8))
    assert got[3000] == ["Quillfeather"] and got[None] == ["quillfeather"] and not any(got[k] for k in range(1000))
    clean = {r.doc_id: r.text for r in V.sanitised(clashing(docs(spark, rows))).collect()}
    assert clean[2000] == f"[TERM] {common[1000]} [EMAIL] {common[1000]} [TERM]"
    assert clean[3000] == "w1 w2 [TERM] w3" and clean[None] == "w4 [TERM] [IP] w5"
    assert all(clean[k] == common[k] for k in range(1000)) and len(clean) == len(rows)


def test_empty_table(spark):
    assert V.privacy_report(docs(spark, [])).collect() == []
    assert V.sanitised(docs(spark, [])).collect() == []
