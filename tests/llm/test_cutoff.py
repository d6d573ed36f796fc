import pytest

from paperstream.llm import cutoff

DOCS = "doc_id long, text string, source string, tab string"
CANDS = "doc_id string, cand_seq int, engine string, markdown string, text string, fld string"
WORDS = "the invoice lists total amounts due for goods that were delivered and checked by our records office".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 16))).capitalize() + "."


def letter(rng, n):
    return " ".join(sentence(rng) for _ in range(n)) + f"\n\n{rng.choice(['Ann', 'Bea', 'Cid'])} {rng.choice(['Moore', 'Nash'])}"


@pytest.fixture(scope="module")
def case(spark):
    import random

    rng = random.Random(5)
    docs, cands, true = [], [], set()
    for i in range(1500):
        text, source = letter(rng, rng.randrange(3, 14)), rng.choice(["fax", "mail", "desk", None])
        if source == "fax" and len(text) > 500:
            text = text[:500]
            true.add(("documents", str(i), "text"))
        elif source == "mail" and len(text) > 420:
            text = text[:417] + "..."
            true.add(("documents", str(i), "text"))
        elif source == "desk" and i % 40 == 0:
            text = text[:150].rstrip(" .") + " the goo"
            true.add(("documents", str(i), "text"))
        docs.append((i, text, source, "x"))
    fax = next(d for d in docs if ("documents", str(d[0]), "text") in true and d[2] == "fax")
    docs += [(9001, fax[1], "desk", "x"), (9002, None, "fax", "x"), (9003, "", "fax", "x"), (9004, " \n ", None, "x"), (9005, "Notes ........", "desk", "x")]
    true.add(("documents", "9001", "text"))
    # names at the limit look like a signature: only the significant length tells
    for i in range(9100, 9110):
        docs.append((i, (letter(rng, 14)[:488].rstrip() + " x" * 9)[:489] + "\n\n" + "Ann Moore", "fax", "x"))
        true.add(("documents", str(i), "text"))
    for i in range(300):
        full = letter(rng, 6)
        flat = " ".join(full.split())
        md, tx = (full, flat[:200]) if i % 5 == 0 else (full[:220], flat) if i % 5 == 1 else (full, flat)
        if i % 5 == 0:
            true.add(("candidates", f"{i}:0", "text"))
        if i % 5 == 1:
            true.add(("candidates", f"{i}:0", "markdown"))
        cands += [(str(i), 0, "Eng" if i % 2 else "eng", md, tx, "x")] * (2 if i % 7 == 0 else 1)
    cands += [("n", 1, None, None, None, "x"), ("n", 2, "eng", "", "", "x")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(cands, CANDS), true


def test_cut_values_are_found(case):
    d, c, true = case
    rows = [tuple(r) for r in cutoff.cut_values(d, c).collect()]
    assert len(rows) == len(set(rows))
    got = set(rows)
    assert len(got & true) / len(true) > 0.97 and len(got & true) / len(got) > 0.97
    assert ("documents", "9001", "text") in got and not any(k in ("9002", "9003", "9004", "9005") for _, k, _ in got)


def test_significance_decides(case):
    """Without significant lengths the rule `length` finds nothing, and values that only the length gives away are lost."""
    d, c, true = case
    rules = lambda fdr: {(r.tab, r.rec_key, r.fld): r.rule for r in cutoff.judged(d, c, fdr).where("rule is not null").collect()}
    with_, without = rules(cutoff.FDR), rules(-1.0)  # below any p
    assert {"length", "other_form", "transfer", "copy"} >= set(with_.values()) and "length" not in without.values()
    lost = with_.keys() - without.keys()
    assert {("documents", str(i), "text") for i in range(9100, 9110)} <= lost and len(lost - true) <= 2


def test_blanks_behind_a_value_change_nothing(spark):
    prose = "we write to confirm that the goods were delivered and " * 6 + "out a stop here"
    docs = spark.createDataFrame([(1, prose, "a", "x"), (2, prose + " " * 1985, "a", "x"), (3, prose + " " * 5000, "b", "x")], DOCS)
    got = cutoff.judged(docs, spark.createDataFrame([], CANDS)).collect()
    assert len(got) == 3 and {r.rule for r in got} == {"transfer"}
    a, b = cutoff._digest(prose), cutoff._digest(prose + " " * 1985)
    assert a[4:] == b[4:]


def test_the_limits_themselves(case):
    d, c, _ = case
    sure = {(r.grp, r.unit, r.len) for r in cutoff.limits(d, c).where("sure").collect()}
    assert ("fax", "chars", 500) in sure and ("mail", "body", 417) in sure
    assert not any(g == "desk" and u == "chars" for g, u, _ in sure)


def test_shares_and_empty_tables(case):
    d, c, true = case
    rows = {(r.tab, r.fld, r.grp): r for r in cutoff.cut_shares(d, c).collect()}
    assert (fax := rows["documents", "text", "fax"]).n_cut == fax.n_length + fax.n_other_form + fax.n_transfer + fax.n_copy > 0 and ("documents", "text", None) in rows
    assert cutoff.cut_values(d.where("false"), c.where("false")).count() == 0


def test_shape():
    assert cutoff.shape("Net Pay: $1,204.50") == "X X: $0,0.0"
    assert cutoff.shape("INV-8812 / claims desk") == "A-0 / claims desk"
    assert cutoff.shape("Total") == "Total" and cutoff.shape("Signed: _______") == "X: ~"
