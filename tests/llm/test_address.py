from itertools import combinations

from paperstream.llm import address
from paperstream.llm.address_parse import one_edit, parse

RECEIPTS = "id string, expected struct<company:string,address:string>, value string"
CANDS = "doc_id string, gen_seq int, field string, value string, id string"

PLACES = [
    ["NO. 12, JALAN MAWAR 3, TAMAN SERI, 14903 KOTABARU, PERLIS", "#12, jln. mawar 3, 14903 kotabaru", "12, Jalan Mawwar 3, Kotabaru, 14903, Perlis", "PERLIS, KOTABARU 14903, J. MAWAR 3, NO: 12", "No 12, Jalan Mawar 3, Kotabaru, Perlis"],
    ["NO. 12A, JALAN MAWAR 3, 14903 KOTABARU", "12-A, Jln Mawar 3, Kotabaru, 149O3"],
    ["NO. 12, JALAN MAWAR 4, 14903 KOTABARU, PERLIS", "12 jalan mawar 4 kotabaru 14903"],
    ["UNIT 3-4, NO. 12, JALAN MAWAR 3, 14903 KOTABARU", "#3-4, 12, Jalan Mawar 3, 14903 Kotabaru, Perlis"],
    ["14 & 16 NORTH ELM AVENUE, 20100 WESTFORD, UTARA", "14,16 N. Elm Ave, Westford 20100", "14-16 North Elm Av., 20100 Westford"],
    ["14 ELM AVENUE, 20100 WESTFORD, UTARA", "14 elm av., westford, utara"],
    ["LOT 7, PERSIARAN CENDANA, 14903 KOTABARU", "lot no 7, psrn cendaan, kotabaru 14903"],
]
NO_PLACE = ["Kotabaru, Perlis", "TEL 555-1234", "BILL 49184 COUNTER 1", "", None, "MEMBER NO 442", "x" * 20000]


def tables(spark, places=PLACES):
    receipts, cands, groups = [], [], []
    for i, forms in enumerate(places):
        keys = []
        for j, v in enumerate(forms):
            if j == 0:
                receipts.append((f"r{i}", ("c", v), "clash"))
                keys.append(f"receipt:r{i}")
            else:
                cands.append((f"r{i}", j, "address", v, "clash"))
                keys.append(f"cand:r{i}:{j}")
        groups.append(keys)
    cands += [(f"n{i}", i, "address", v, None) for i, v in enumerate(NO_PLACE)] + [("o", 1, "total", "12 JALAN MAWAR 3", None)]
    receipts += [("e", ("c", ""), None), ("f", ("c", None), None), ("g", None, None), receipts[0]]
    return spark.createDataFrame(receipts, RECEIPTS), spark.createDataFrame(cands + cands[:3], CANDS), groups


def test_same_places_and_only_those(spark):
    r, c, groups = tables(spark)
    rows = [tuple(x) for x in address.same_location(r, c).collect()]
    assert len(rows) == len(set(rows)) and all(a < b for a, b in rows)
    assert set(rows) == {tuple(sorted(p)) for g in groups for p in combinations(g, 2)}


def test_ambiguous_towns_link_to_nothing_or_to_the_street_that_exists(spark):
    places = [
        ["1 OAK ROAD, 30000 LEMDALE, UTARA", "1 oak road, 30000 lemdale"], ["1 OAK ROAD, 31000 LERDALE, UTARA", "1 oak rd, lerdale 31000"], ["5 FIR LANE, 30000 LEMDALE", "5 fir ln, ledale"], ["1 OAK ROAD, LEDALE"],
    ]
    r, c, _ = tables(spark, places)
    rows = {tuple(x) for x in address.same_location(r, c).collect()}
    assert ("cand:r2:1", "receipt:r2") in rows
    assert not any("receipt:r3" in pair for pair in rows)


def test_empty_tables(spark):
    r, c, _ = tables(spark)
    assert address.same_location(r.where("false"), c.where("false")).count() == 0


def test_parts():
    a = parse("UNIT 3-4, NO. 12A & 14, Jln. Mawar 3, Taman Seri, 149O3 Kotabaru")
    assert (a.unit, a.kind, a.street, a.street_no, a.code) == ("3-4", "jalan", "mawar", "3", "14903")
    assert parse("#731, Persiaran Vermil, 147, 80703 Lemocombe").unit == "731"
    assert parse("227-229 J. Ulindol 4, Suite 263, 53403 Lemoldbury").number == "227&229"
    assert one_edit("mawar", "mawwar") and one_edit("mawar", "mawra") and not one_edit("mawar", "mawwarr")


def test_recurring_misspellings_are_no_street_of_their_own(spark):
    def linked(common, rare, n_common, n_rare):
        """Whether each spelling's first record links to the other's, with so many records at each of six numbers."""
        rows = [(f"{s}{n}", k, "address", f"{n} Jalan {s} 3, 14903 Kotabaru", None) for s, times in ((common, n_common), (rare, n_rare)) for n in range(1, 7) for k in range(times)]
        cands = spark.createDataFrame(rows, CANDS)
        places = {r.rec_key: r.street for r in address.locations(spark.createDataFrame([], RECEIPTS), cands).collect()}
        return places[f"cand:{common}1:0"] == places[f"cand:{rare}1:0"]

    assert linked("Cendana", "Cendna", 12, 1) and linked("Tanjamin", "Tanjarnin", 3, 2)
    assert not linked("Mawar", "Mawas", 12, 10)


def test_street_names_of_several_words_and_other_street_words(spark):
    places = [
        ["5, Jalan Bukit Bintang, 50200 Kualapura, Selatan", "No 5 Jln Bukit Bintang 50200 Kualapura", "5 JALAN BUKIT BINTANG, KUALAPURA"], ["5, Jalan Bukit Jalil, 50200 Kualapura, Selatan", "#5, J. Bukit Jalil, Kualapura 50200"],
        ["5 Old Mill Road, 20100 Westford, Utara", "5 old mill rd, westford 20100"], ["5 New Mill Road, 20100 Westford, Utara", "5 New Mill Rd, Westford 20100"], ["5 Mill Road, 20100 Westford, Utara"],
        ["12 Oak Court, 20100 Westford, Utara", "12 Oak Ct, Westford 20100"], ["7 Elm Way, 20100 Westford", "7 elm wy, 20100 westford"], ["15 Lebuh Pantai, 50200 Kualapura", "15, Lbh Pantai, Kualapura 50200"],
        ["3 Rue de la Paix, 75002 Lutetia", "3, rue de la paix, 75002 lutetia"], ["3 Rue de la Victoire, 75002 Lutetia"], ["Hauptstraße 5, 10115 Spreestadt", "Hauptstr. 5, 10115 Spreestadt"], ["12 Broadwalk, 20100 Westford", "12 BROADWALK, WESTFORD 20100"],
    ]
    r, c, groups = tables(spark, places)
    rows = {tuple(x) for x in address.same_location(r, c).collect()}
    assert rows == {tuple(sorted(p)) for g in groups for p in combinations(g, 2)}
    found = {x.rec_key: x for x in address.locations(r, c).collect()}
    assert found["receipt:r0"].street == "bukit bintang" and {found[k].representative for k in groups[0]} == {min(groups[0])}
    assert all(found[k].n_records == len(g) and found[k].place_id == found[g[0]].place_id for g in groups for k in g)


def test_ambiguous_records_are_shown_with_their_candidates(spark):
    places = [["1 OAK ROAD, 30000 LEMDALE, UTARA", "1 oak road, 30000 lemdale"], ["1 OAK ROAD, 31000 LERDALE, UTARA", "1 oak rd, lerdale 31000"], ["1 OAK ROAD, LEDALE"]]
    found = {x.rec_key: x for x in address.locations(*tables(spark, places)[:2]).collect()}
    assert found["receipt:r2"].localities == ["30000", "31000"] and found["receipt:r2"].place_id is None and found["receipt:r2"].region == "utara"
    assert found["receipt:r0"].localities == ["30000"] and found["receipt:r0"].n_records == 2


def test_no_plan_repeats_its_parts(spark, monkeypatch):
    """What the driver holds grows with the largest plans: before parts used more than once were stored, one had 14 joins."""
    joins = {}

    def counted(df, name):
        joins[name] = df._jdf.queryExecution().executedPlan().toString().count("Join ")
        return stored(df, name)

    stored = address.stored
    monkeypatch.setattr(address, "stored", counted)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        r, c, _ = tables(spark)
        counted(address.same_location(r, c), "pairs")
        counted(address.locations(r, c), "locations")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(joins.values()) <= 5


def test_no_side_multiplied_by_a_generator_is_broadcast(spark):
    """Its size estimate is that before the generator, so a broadcast of it may be many times the threshold."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        r, c, _ = tables(spark)
        for df in (address.same_location(r, c), address.locations(r, c)):
            salted = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line and "salt#" in line]
            assert salted and all("SortMergeJoin" in line for line in salted)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
