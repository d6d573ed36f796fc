import pytest

from paperstream.llm import scan_decode as sd
from paperstream.llm import scan_repair as sr

PAGES = "doc_id string, page_no int, extracted_text string, fld string"
CANDS = "doc_id string, cand_seq int, markdown string, text string, tab string"
DOCS = "doc_id long, text string, word string"
BASE = "The invoice lists every certificate and the delivery office. The short-term balance was approved by the archive in March and the remaining payment is due. Confidential material matters not."


class Words(sd.Lexicon):
    """A lexicon that finds readings at once, by comparing all words: brute force beside the equi-join on strokes."""

    def __init__(self, counts):
        total = sum(counts.values())
        super().__init__({w: n / total for w, n in counts.items()})

    def reading(self, word):
        x = sd.found(word, self.part(word), self.frequent.items())
        return (x.word, x.places) if x and word not in self.frequent else (word, ())


@pytest.fixture(scope="module")
def lex():
    return Words(sd.count_words([BASE]))


def read(lex, *lines, following=""):
    return sd.Reader(lex).read(list(lines), list(range(len(lines))), following)


def test_readings(lex):
    for noisy, clean in (("inv0ice", "invoice"), ("certificatc", "certificate"), ("approvecl", "approved"), ("arnd", "arnd"), ("zzz", "zzz"), ("rnatters", "matters")):
        assert lex.reading(noisy)[0] == clean and sd.strokes(noisy) == sd.strokes(clean)
    assert sd.read_token(lex, "Inv0ice,")[0] == "Invoice," and sd.read_token(lex, "1,825.2l")[0] == "1,825.21"
    assert sd.read_token(lex, "$5<320.25")[0] == "$5,320.25" and not sd.read_token(lex, "INV-48219")[1]
    assert sd.read_token(lex, "(ertificate")[0] == "certificate" and lex.segment("theinvoicelists")[1] == ["the", "invoice", "lists"]


def test_strokes_keep_every_confusion(spark):
    pairs = [(read, true) for read, all_true in sd.CONFUSIONS.items() for true in all_true]
    assert all(sd.strokes(a) == sd.strokes(b) and sd.spots(f"x{a}y", f"x{b}y") == (1,) for a, b in pairs)
    words = [w for pair in pairs for w in pair] + ["windmill", "", "Ünïcode"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(sr.sd_strokes("w")).collect()
    assert [r[0] for r in got] == [sd.strokes(w) for w in words]
    assert sd.spots("a" * 300, "a" * 300) == () and sd.spots("cccc", "eeee") is None and sd.spots("abc", "abd") is None


def test_divided_words(lex):
    assert sd.divided(lex, "certi-", "ficate.")[0] == "certificate." and sd.divided(lex, "short-", "term") is None
    assert sd.divided(lex, "certi¬", "ficate") and sd.divided(lex, "INV-", "48") is None and sd.divided(lex, "certi-", "f1cate")[2]


def test_cheapest_path_over_lines(lex):
    assert read(lex, "the invo", "ice lists")[1] == ["the invoice", "lists"]  # no mark: no noise either
    assert read(lex, "the inv0", "ice lists") == ({(0, "misread")}, ["the invoice", "lists"], False)
    assert read(lex, "theinvoicelists every")[1] == ["the invoice lists every"]
    assert read(lex, "every certi-", "f1cate and short-", "term") == ({(0, "hyphen"), (1, "misread")}, ["every certificate", "and short-term", ""], False)
    assert read(lex, "every certi-", following="ficate")[1:] == (["every certificate"], True)
    assert read(lex, "every short-", following="term") == (set(), ["every short-"], False)
    assert read(lex, "a line", following="ficate")[1:] == (["a line"], False) and read(lex) == (set(), [], False)
    long = "every invoice lists the certi-\nficate " * 2000
    assert len(read(lex, *long.split("\n"))[0]) == 2000
    assert sd.join_lines(["发票", "总额", "total", "due"]) == "发票总额 total due"


def test_labels_and_paragraphs():
    assert [bool(sd.page_label(x)) for x in ("Page 2 of 5", "[3]", "— 4 —", "xiv", "12/14", "Pg 0O2", "see page 3", "| 3 |", "$12", "total")] == [True] * 6 + [False] * 4
    assert sd.page_label("xiv")[1] == 14 and sd.page_label("p. l2")[1] == 12
    lines = ["A first line that runs on over", "the next line and ends here.", "", "Another paragraph starts and it is", "long enough to be one.", "| a | b |", "| c | d |"]
    assert sd.paragraphs(lines) == [[0, 1], [3, 4], [5, 6]]


def tables(spark):
    pages = []
    for n in range(1, 7):
        body = "The invoice lists every certifi-\ncate and the delivery office. The short-\nterm balance was approved by\nthe archive in March and the rem-" if n < 6 else "aining payment is due."
        start = "Opening title of it all\n" if n == 1 else "aining payment is due.\n"
        pages.append(("s", n, f"INV-77 annual certificate review\n{start}{body if n < 6 else ''}\nConfidential\nPage {n} of 6", "x"))
    pages[2] = ("s", 3, pages[2][2].replace("delivery", "de1ivery"), "x")
    pages += [pages[1], ("s", 9, None, "x"), ("s", 8, "", "x"), ("s", 7, "  ", "x"), (None, 1, "lost", "x"), ("t", 1, "The invoice lists 466\n466", "x")]
    md = "The invoice lists every certifi-\ncate and the de1ivery office.\nConfidential\nPage 1\nThe balance was approved.\nConfidential\nPage 2"
    cands = [("1", 0, md, " ".join(md.split()), "x"), ("2", 0, None, None, "x"), ("3", 0, "", "", "x"), ("4", 0, "The invoice lists every certifi-", "The invoice lists every certifi-", "x")]
    docs = [(i, BASE, "x") for i in range(60)] + [(99, None, "x"), (98, "", "x")]
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame(cands + cands[:1], CANDS), spark.createDataFrame(docs, DOCS)


def test_noise_and_paragraphs(spark):
    read = sr.read_all(*tables(spark))
    rows = [tuple(r) for r in sr.noisy_lines(read).collect()]
    got = set(rows)
    assert len(rows) == len(got)
    page3 = {(n, k) for t, key, _, n, k in got if key == "s:3"}
    assert page3 == {(1, "running"), (3, "hyphen"), (4, "misread"), (6, "hyphen"), (7, "running"), (8, "page_no")}
    assert {(n, k) for _, key, _, n, k in got if key == "s:1"} >= {(1, "running"), (8, "page_no")} and ("scan_pages", "s:1", "extracted_text", 2, "running") not in got
    assert {(n, k) for _, key, fld, n, k in got if key == "1:0" and fld == "markdown"} == {(1, "hyphen"), (2, "misread"), (3, "running"), (4, "page_no"), (6, "running"), (7, "page_no")}
    assert {k for _, key, fld, _, k in got if key == "1:0" and fld == "text"} == {"hyphen", "misread", "running", "page_no"}
    assert not any(key in ("s:7", "s:8", "s:9", "2:0", "3:0", "4:0", "t:1") for _, key, *_ in got)
    paras = {(r.rec_key, r.para_no): r.text for r in sr.repaired(read).collect()}
    whole = " ".join(paras[k] for k in sorted(k for k in paras if k[0] == "s"))
    assert "Confidential" not in whole and whole.count("every certificate and the delivery office") == 5 and whole.count("short-term balance") == 5
    assert paras["1:0", 1].startswith("The invoice lists every certificate and the delivery office.")


def test_blank_pages_within_a_word_and_one_hot_document(spark):
    """However many blank pages part a word, it is joined; the pages of one document are all of the table."""
    _, cands, docs = tables(spark)
    pages = [("h", n, f"Annual certificate review\nThe invoice lists every balance and the certifi-\nPage {n}" if n % 7 == 1 else "" if n % 7 else f"Annua1 certificate review\ncate and the delivery office.\nPage {n}", "x") for n in range(1, 71)]
    read = sr.read_all(spark.createDataFrame(pages, PAGES), cands, docs)
    got = {tuple(r)[1:] for r in sr.noisy_lines(read).where("tab = 'scan_pages'").collect()}
    assert sum(k == "hyphen" for *_, k in got) == 10 and sum(k == "running" for *_, k in got) == 20 and sum(k == "page_no" for *_, k in got) == 20
    assert sum("certificate and the delivery" in r.text for r in sr.repaired(read).where("tab = 'scan_pages'").collect()) == 10


def test_empty_tables(spark):
    p, c, d = tables(spark)
    read = sr.read_all(p.where("false"), c.where("false"), d.where("false"))
    assert sr.noisy_lines(read).count() == 0 and sr.repaired(read).count() == 0


def test_lines_of_a_text_beyond_its_cut_markdown(spark):
    pages, _, docs = tables(spark)
    full = "The invoice lists every certificate.\nPrinted for Fen Textiles Works\n- 1 -\nThe delivery office was approved by the ar-\nPrinted for Fen Textiles Works\n- 2 -\nchive in March.\nPrinted for Fen Textiles Works\n3"
    flat = " ".join(full.split())
    cands = [("7", 0, full, flat, "x"), ("7", 1, "The invoice lists every certifi", flat.replace("- 1 - ", "").replace("- 2 - ", ""), "x"), ("8", 0, "The invoice lists", "The invoice lists every certificate. Page 1 of 4 The delivery office was approved.", "x"), ("9", 0, "The invoice lists", "The invoice lists every certificate and 3 balance payment is due.", "x")]
    rows = sr.noisy_lines(sr.read_all(pages, spark.createDataFrame(cands, CANDS), docs)).where("fld = 'text'").collect()
    got = {k: {r.noise for r in rows if r.rec_key == k} for k in ("7:0", "7:1", "8:0", "9:0")}
    assert got == {"7:0": {"hyphen", "running", "page_no"}, "7:1": {"hyphen", "running", "page_no"}, "8:0": {"page_no"}, "9:0": set()}


def test_paragraphs_go_on_where_a_text_runs_on_past_its_cut_markdown(spark):
    pages, _, docs = tables(spark)
    text = "The invoice lists every certi- f1cate and the delivery office. - 2 - The balance was approved in March and the remaining payment is due."
    cands = [("1", 0, "The invoice lists every certi-\nf1cate and the deliv...", text, "x"), ("2", 0, None, text, "x"), ("3", 0, "The invoice lists every certi-\nf1cate", text[:37], "x"), ("4", 0, "The invoice lists\n\nThe balance was approved in", "The invoice lists The balance was approved in March.", "x")]
    read = sr.read_all(pages, spark.createDataFrame(cands, CANDS), docs)
    paras = {}
    for r in sr.repaired(read).where("tab = 'candidates'").orderBy("para_no").collect():
        paras.setdefault(r.rec_key, []).append(r.text)
    whole = "The invoice lists every certificate and the delivery office. The balance was approved in March and the remaining payment is due."
    assert paras == {"1:0": [whole], "2:0": [whole], "3:0": ["The invoice lists every certificate"], "4:0": ["The invoice lists", "The balance was approved in March."]}
