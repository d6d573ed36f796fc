"""Problem 3: records of one place linked top-down: region, locality, street, number, unit.

Each level links within the level above; of every record the region is known first, from its code or its words. Localities are learnt from the records: a postal code's town is the word most
often beside it, its region the commonest other word. A record with no known code inherits every town that a word of it
spells - exactly, else with one edit - in the regions it names; if more than one is left, all stay candidates and the
street and number decide; what they leave undecided links to nothing. Within a locality, a rare spelling of a street
joins the commonest spelling one edit away. Where a value has no marks, how many words its street's name has the other records tell: the longest run
of words that is a whole name in enough of the records that begin with it. Spellings one edit apart are found by an equi-join on the words' forms with
one letter left out; no level compares all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperstream.llm.address_parse import parse
from paperstream.llm.common import stored

#: A code is known if its town stands beside it in so many records.
KNOWN_CODE = 2
#: Two spellings of one edit stay two streets if the rarer has so many house numbers, and at least this part of the other's.
OWN_NUMBERS, OWN_PART = 4, 0.34
#: And at least this part of the other's records per house number: a misspelling is rare at every number, however many numbers it reaches as records grow.
OWN_RECORDS = 0.34
#: A run of words is a street's whole name if it is set apart in this part of the records that begin with it.
ALONE_PART = 0.1
#: The pairs of one place are made in so many tasks.
SALTS = 8

PARSED = "rec_key string, number string, unit string, kind string, street string, more array<string>, whole boolean, street_no string, direction string, code string, rest array<string>, near array<string>"
STREET = ["kind", "street_no", "direction"]


def address_records(receipts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rec_key, value): receipts with a non-empty address, field candidates of the field address with a value; each record once."""
    r = receipts.select(F.concat(F.lit("receipt:"), "id").alias("rec_key"), F.col("expected.address").alias("value")).where(F.col("value") != "")
    c = candidates.where(F.col("field") == "address").select(F.concat(F.lit("cand:"), "doc_id", F.lit(":"), F.col("gen_seq").cast("string")).alias("rec_key"), "value")
    return r.unionByName(c).where(F.col("value").isNotNull() & F.col("rec_key").isNotNull()).distinct()


def _parsed(records: DataFrame) -> DataFrame:
    ordered = [x.split()[0] for x in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, a) for k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (a := parse(v)) is not None]
            columns = [[k for k, _ in rows], *([getattr(a, n) for _, a in rows] for n in ("number", "unit", "kind", "street", "street_no", "direction", "code"))]
            lists = [[getattr(a, n) for _, a in rows] for n in ("more", "rest", "near_code")]
            arrays = [*(pa.array(c, pa.string()) for c in columns), *(pa.array(c, pa.list_(pa.string())) for c in lists), pa.array([a.whole for _, a in rows], pa.bool_())]
            names = ["rec_key", "number", "unit", "kind", "street", "street_no", "direction", "code", "more", "rest", "near", "whole"]
            yield pa.RecordBatch.from_arrays([arrays[names.index(n)] for n in ordered], names=ordered)

    return records.mapInArrow(run, PARSED)


# Characters and pairs of them that OCR takes for one another, brought to one of them.
_CONFUSED = ("012589!|itfj", "olzsbgllllll")
_CONFUSED_PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "n"))


def _bone(word: str) -> Column:
    """Equal for words that differ only by doubled letters or common OCR confusions."""
    w = F.col(word)
    for pair, one in _CONFUSED_PAIRS:
        w = F.replace(w, F.lit(pair), F.lit(one))
    return F.regexp_replace(F.translate(w, *_CONFUSED), r"(.)\1+", "$1")


def _strokes(word: str) -> Column:
    """Equal for words that differ only in strokes, rounds and digits - i, l and 1, o and 0, s and 5 - or in pairs read as one letter, as rn and m."""
    w = F.col(word)
    for pair, one in _CONFUSED_PAIRS:
        w = F.replace(w, F.lit(pair), F.lit(one))
    return F.translate(w, "i1|!05289", "lllloszbg")


def _near_forms(word: str) -> Column:
    """The word, its forms with one letter left out, and its bone: words one edit or usual OCR confusions apart share one."""
    w = F.col(word)
    less = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.concat(less, F.array(w, F.concat(F.lit("~"), _bone(word)))))


def _localities(parsed: DataFrame) -> DataFrame:
    """(code, town, region, records) of known codes."""
    near = parsed.where("code <> ''").select("rec_key", "code", F.explode(F.array_distinct("near")).alias("word"))
    town = near.groupBy("code", "word").agg(F.count(F.lit(1)).alias("n")).groupBy("code").agg(F.max(F.struct("n", "word")).alias("top"))
    town = town.select("code", F.col("top.word").alias("town"), F.col("top.n").alias("records")).where(F.col("records") >= KNOWN_CODE)
    rest = parsed.where("code <> ''").select("code", F.explode(F.array_distinct("rest")).alias("word")).groupBy("code", "word").agg(F.count(F.lit(1)).alias("n"))
    region = rest.join(town, "code").where(F.col("word") != F.col("town")).groupBy("code").agg(F.max(F.struct("n", "word")).alias("top")).select("code", F.col("top.word").alias("region"))
    return town.join(region, "code", "left")


def _located(parsed: DataFrame, localities: DataFrame) -> DataFrame:
    """parsed with `region`, `locality` and `n_localities`, one row per candidate locality of a record."""
    known = parsed.join(localities.select("code", "region", F.lit(True).alias("known")), "code", "left")
    keep = ["rec_key", "number", "unit", "street", "more", "whole", *STREET, "region"]
    coded = known.where("known").select(*keep, F.col("code").alias("locality"), F.lit(1).cast("long").alias("n_localities"))
    others = known.where("known is null")
    words = others.select("rec_key", "rest", F.explode("rest").alias("word")).where(F.length("word") >= 4)
    words = words.select("rec_key", "rest", "word", F.explode(_near_forms("word")).alias("form"))
    towns = localities.select("code", "town", "region", F.explode(_near_forms("town")).alias("form"))
    # sides that a generator multiplied are never broadcast: their size estimate is that before it
    hits = words.join(towns.hint("merge"), "form").select("rec_key", F.col("code").alias("town_code"), "region", (F.col("word") != F.col("town")).cast("int").alias("inexact"), (~F.coalesce(F.array_contains("rest", F.col("region")), F.lit(False))).cast("int").alias("elsewhere"))
    # regions first, then exact spellings
    of_record = Window.partitionBy("rec_key")
    chosen = hits.groupBy("rec_key", "town_code", "region").agg(F.min(F.struct("elsewhere", "inexact")).alias("rank"))
    chosen = chosen.withColumn("best", F.min("rank").over(of_record)).where(F.col("rank") == F.col("best")).select("rec_key", "town_code", "region").withColumn("n", F.count(F.lit(1)).over(of_record))
    # an unknown code whose town is unknown too is a locality of its own
    inherited = others.drop("region").join(chosen, "rec_key", "left").where(F.col("town_code").isNotNull() | (F.col("code") != ""))
    inherited = inherited.select(*keep, F.coalesce("town_code", "code").alias("locality"), F.coalesce("n", F.lit(1)).alias("n_localities"))
    return coded.unionByName(inherited)


def _streets(located: DataFrame) -> DataFrame:
    """(locality, STREET, street, canon): each spelling's street, where that is another spelling."""
    group = ["locality", *STREET]
    forms = stored(located.groupBy(*group, "street").agg(F.count_distinct("number").alias("numbers"), F.count(F.lit(1)).alias("records")), "spellings")
    keys = forms.where("street <> ''").select(*group, "street", "numbers", "records", F.explode(_near_forms("street")).alias("form"))
    a, b = keys.alias("a"), keys.select(*group, "form", F.col("street").alias("other"), F.col("numbers").alias("other_numbers"), F.col("records").alias("other_records"))
    near = a.join(b.hint("merge"), [*group, "form"]).where((F.col("other_numbers") > F.col("numbers")) | ((F.col("other_numbers") == F.col("numbers")) & (F.struct("other_records", "other") > F.struct("records", "street"))))
    two = (F.col("numbers") >= OWN_NUMBERS) & (F.col("numbers") >= OWN_PART * F.col("other_numbers"))
    two = two & (F.col("records") * F.col("other_numbers") >= OWN_RECORDS * F.col("other_records") * F.col("numbers")) & (_strokes("street") != _strokes("other"))
    return near.where(~two).groupBy(*group, "street").agg(F.max(F.struct("other_numbers", "other_records", "other")).alias("top")).select(*group, "street", F.col("top.other").alias("canon"))


def _whole_names(named: DataFrame) -> DataFrame:
    """named with the street's whole name in `street`: its first word, and as many of `more` as the records show to belong to it."""
    group = ["locality", *STREET, "street"]
    runs = F.transform(F.sequence(F.lit(0), F.size("more")), lambda i: F.array_join(F.slice("more", F.lit(1), i), " "))
    seen = named.select(*group, "whole", F.size("more").alias("size"), F.posexplode(runs).alias("words", "tail"))
    seen = seen.groupBy(*group, "tail").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("whole") & (F.col("words") == F.col("size"))).alias("apart")).where(F.col("apart") >= ALONE_PART * F.col("n"))
    open_ = named.where(~F.col("whole"))
    tried = open_.select(*group, "more").distinct().select(*group, "more", F.posexplode(runs).alias("words", "tail"))
    found = tried.join(seen.hint("merge"), [*group, "tail"]).groupBy(*group, "more").agg(F.max(F.struct("words", "tail")).alias("found"))
    everything = F.array_join("more", " ")
    open_ = open_.join(found, [*group, "more"], "left").withColumn("street", F.rtrim(F.concat_ws(" ", "street", F.coalesce("found.tail", everything)))).drop("found")
    return named.where("whole").withColumn("street", F.rtrim(F.concat_ws(" ", "street", everything))).unionByName(open_)


def _canonical(located: DataFrame, spellings: DataFrame) -> DataFrame:
    """located with each street in its commonest spelling; twice, as the commonest spelling near a spelling may itself belong to a commoner one."""
    group = ["locality", *STREET]
    commoner = spellings.select(*group, F.col("street").alias("canon"), F.col("canon").alias("commoner"))
    spellings = spellings.join(commoner, [*group, "canon"], "left").select(*group, "street", F.coalesce("commoner", "canon").alias("canon"))
    return located.join(spellings, [*group, "street"], "left").withColumn("street", F.coalesce("canon", "street")).drop("canon")


PLACE = ["locality", *STREET, "street", "number", "unit"]


def _placed(receipts: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with their place, candidate places of the records that stay undecided).

    What is used more than once is stored: plans that repeat it grow until planning them fills the driver's memory.
    """
    parsed = stored(_parsed(address_records(receipts, candidates)), "addresses")
    located = stored(_located(parsed, stored(_localities(parsed), "towns")), "localities")
    first = stored(_canonical(located, stored(_streets(located), "streets")), "first_words")
    named = stored(_whole_names(first), "names")
    # names of several words have spellings of their own
    several = named.where(F.col("street").contains(" "))
    named = stored(_canonical(several, stored(_streets(several), "long_streets")).unionByName(named.where(~F.col("street").contains(" "))), "long_names")
    columns = ["rec_key", "region", *PLACE]
    sure = named.where("n_localities = 1").select(*columns)
    open_ = named.where("n_localities > 1")
    there = open_.join(sure.select(*PLACE).distinct(), PLACE, "left_semi")
    decided = there.withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("rec_key"))).where("left = 1").select(*columns)
    placed = stored(sure.unionByName(decided), "placed")
    return placed, open_.join(placed.select("rec_key"), "rec_key", "left_anti").select(*columns)


def locations(receipts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rec_key, place_id, representative, n_records, region, locality, kind, street, street_no, direction, number, unit, localities): one row per record with a street and a number.

    The records of one location have one place_id and one representative, the least of their keys; pairs of
    representatives and members, with the count, stand for all pairs. Of a record that stays ambiguous `localities` are
    the candidates and place, representative and count are null: ambiguity links to nothing, but is not dropped.
    """
    placed, open_ = _placed(receipts, candidates)
    salt = F.pmod(F.xxhash64("rec_key"), F.lit(SALTS)).cast("int")
    per = placed.groupBy(*PLACE).agg(F.min("rec_key").alias("representative"), F.count(F.lit(1)).alias("n_records"))
    per = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = ["region", *PLACE]
    sure = placed.withColumn("salt", salt).join(per.hint("merge"), [*PLACE, "salt"]).select("rec_key", F.xxhash64(*PLACE).alias("place_id"), "representative", "n_records", *parts, F.array("locality").alias("localities"))
    several = open_.groupBy("rec_key").agg(*[F.when(F.count_distinct(c) == 1, F.min(c)).alias(c) for c in parts], F.array_sort(F.collect_set("locality")).alias("localities"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("place_id", "long"), ("representative", "string"), ("n_records", "long"))]
    return sure.unionByName(several.select("rec_key", *nothing, *parts, "localities"))


def same_location(receipts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: the pairs of records of one location, as the problem's statement asks for them.

    Null, empty and unreadable addresses, towns alone and other values denote no location. Repeated rows are one record,
    so a record never pairs with itself. All parts of the place are compared; the pairs of a place with very many records
    are made in SALTS tasks.
    """
    placed, _ = _placed(receipts, candidates)
    a = placed.select(*PLACE, F.col("rec_key").alias("rec_a"), F.pmod(F.xxhash64("rec_key"), F.lit(SALTS)).cast("int").alias("salt"))
    b = placed.select(*PLACE, F.col("rec_key").alias("rec_b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return a.join(b.hint("merge"), [*PLACE, "salt"]).where(F.col("rec_a") < F.col("rec_b")).select("rec_a", "rec_b")
