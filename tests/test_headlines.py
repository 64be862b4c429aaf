"""Companies, events and amounts in headlines."""

import datetime

from pyspark.sql import functions as F

from marketlens.functions import headlines as H
from marketlens.operators import attribution, rules

# fixed values: headlines with known answers
MATCHES = [
    ("IBM CEO Arvind Krishna Confirms Quantum Computer For Andhra Pradesh", "ARVIND", "Arvind Ltd", False), ("Mr Arvind said demand is strong", "ARVIND", "Arvind Ltd", False),
    ("Arvind Posts Strong Q1 Results", "ARVIND", "Arvind Ltd", True), ("Arvind Ltd announces new denim capacity", "ARVIND", "Arvind Ltd", True), ("ITC Hotels acquires resort", "ITC", "ITC Ltd", False),
    ("BEL, Bharat Dynamics in focus", "BEL", "Bharat Electronics", True), ("L&T bags order", "LT", "Larsen & Toubro (L&T)", True), ("Acme Ltd gains", "LT", "Larsen & Toubro (L&T)", False), ("Larsen & Toubro's profit up", "LT", "Larsen & Toubro (L&T)", True),
    ("ITC Q1 profit up", "ITC", "ITC Ltd", True), ("shares of itc. and others", "ITC", "ITC Ltd", True), ("", "ITC", "ITC Ltd", False), (None, "ITC", None, False),
]
AMOUNTS = [
    ("wins Rs 900 crore order; stock up 5%", 900.0), ("Rs 12 crore per unit for a Rs 900 crore contract", 900.0), ("bags $500 million deal", 4150.0), ("order of 2.5 lakh crore", 250000.0), ("adds 50 lakh shares", None),
    ("US$ 1.2 billion deal", 9960.0), ("wins 1,200 cr order", 1200.0), ("nothing", None), ("deal of 3 mn and 4 lakh tonnes", 0.3), ("5 thousand crore", None), (None, None),
]


def test_named(spark):
    for title, ticker, name, want in MATCHES:
        titles = spark.createDataFrame([(1, title)], "id int, title string")
        assert (attribution.named(titles, spark.createDataFrame([(ticker, name)], "ticker string, name string")).count() == 1) is want, title


def test_amounts(spark):
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(AMOUNTS)], "i int, t string").select("i", H.amount(F.col("t")).alias("a")).orderBy("i").collect()
    for r, (text, want) in zip(got, AMOUNTS, strict=True):
        assert (r["a"] is None) == (want is None) and (want is None or abs(r["a"] - want) < 1e-6), text


def test_attributable(spark):
    texts = ["Defence stocks rally after Rs 500 crore orders", "Shares jump 5% on order", "Cabinet approves Rs 900 crore outlay", "BEL wins Rs 900 crore order", "BEL, HAL, BDL: orders worth Rs 5 crore", "BEL JV wins order", "Q1 results: Rs 5 crore"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", H.attributable(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [False, False, False, True, False, False, False]


def test_events(spark):
    texts = ["Acme denies merger with Beta \u2014 Acme bags contract", "Acme reportedly acquires Beta", "Acme signs MoU with Beta", "Export ban on copper", "Nothing happens", "MegaCorp signs multiyear commitment for custom smartphone chips", None]
    got = {r["id"]: (r["type"], r["certainty"], r["direction"]) for r in attribution.events(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, title string")).collect()}
    assert got == {0: ("order_win", "completed", "opportunity"), 1: ("acquisition", "reported", "opportunity"), 2: ("tie_up", "announced", "opportunity"), 3: ("supply_disruption", "completed", "risk"), 5: ("capacity_add", "completed", "opportunity")}


def test_coverage_of_old_items(spark):
    day = datetime.date
    titles = spark.createDataFrame([(1, "Same news", day(2025, 1, 1)), (2, "Same  news!", day(2026, 1, 1)), (3, "same news", day(2026, 1, 2)), (4, "Same news", day(2025, 1, 1)), (5, "!", day(2026, 1, 1)), (6, "Undated", None)], "id int, title string, day date")
    matches = titles.select("id", F.lit("T").alias("ticker"))
    got = {r["id"]: r["status"] for r in attribution.coverage(titles.withColumn("title", F.regexp_replace("title", " +", " ")), matches, spark.createDataFrame([(day(2026, 2, 1),)], "today date")).collect()}
    assert got == {1: "excluded", 2: "counted", 3: "merged", 4: "merged", 6: "counted"}


def test_materiality(spark):
    titles = spark.createDataFrame([(1, "T", "order_win", "wins Rs 900 crore order"), (2, "T", None, "sets up a stall"), (3, "U", "order_win", "wins Rs 900 crore order"), (4, "T", None, "Rs 10 crore deal")], "id int, ticker string, type string, title string")
    got = {r["id"]: (r["pct_of_revenue"], r["band"], r["weight"]) for r in attribution.materiality(titles, spark.createDataFrame([("T", 1000.0)], "ticker string, revenue double")).collect()}
    assert got == {1: (90.0, "transformative", 1.5), 2: (None, "unknown", 1.0), 3: (None, "unknown", 1.0), 4: (1.0, "immaterial", 0.25)}
    found = spark.createDataFrame([("opportunity", "Medium", 5.0), ("opportunity", "Medium", 4.9), ("risk", "Medium", 50.0), ("opportunity", "Critical", 50.0)], "direction string, severity string, materiality_pct double")
    assert [r["severity"] for r in rules.escalated(found).collect()] == ["High", "Medium", "Medium", "Critical"]


def _terms(spark):
    return spark.createDataFrame([(k, t) for k, ts in H.BATTLEGROUNDS.items() for t in ts], "sector string, term string")


def test_names_of_many_words(spark):
    """Names that begin alike, hold symbols, or lie within longer ones are met whole or not at all."""
    companies = spark.createDataFrame([("A", "Gamma & Sons1"), ("B", "Gamma & Sons2 (GS2)"), ("C", "Gamma"), ("D", None), ("E", ""), ("F", "Gamma Works Pvt Ltd")], "ticker string, name string")
    texts = {"gamma & sons2 wins": {"B", "C"}, "Gamma & Sons1's profit, GS2 slips": {"A", "B", "C"}, "Sons2 & Gamma": {"C"}, "Gamma Works Pvt": set(), "gamma works pvt ltd": {"C", "F"}, "": set(), ". & .": set(), "D and E meet": {"D", "E"}}
    titles = spark.createDataFrame(list(enumerate(texts)), "id int, title string")
    got = {k: set() for k in texts}
    for r in attribution.named(titles, companies).join(titles, "id").collect():
        got[r["title"]].add(r["ticker"])
    assert got == texts
    assert attribution.named(titles, companies.limit(0)).count() == 0


def test_containing(spark):
    rows = [("EMS", "a"), ("it", "b"), ("chip packaging", "c"), ("chip", "d"), ("", "e"), (None, "f"), ("chip", "d2")]
    terms = spark.createDataFrame(rows, "term string, sector string")
    texts = ["Systems grow", "Chip packaging unit", "CHIP", "x", "", None, "digit", "ch ip"]
    got = sorted(map(tuple, attribution.containing(spark.createDataFrame(list(enumerate(texts)), "id int, title string"), terms).select("id", "sector").collect()))
    assert got == sorted((i, s) for i, t in enumerate(texts) for k, s in rows if t and k and k.lower() in t.lower())


# fixed values: headlines with known sectors and companies
TRACKED = [
    ("Qualcomm-like MegaCorp signs multiyear commitment for custom smartphone chips", "capacity_add", ["manufacturing_electronics"], []),
    ("Suzlon Energy wins order for 300MW wind turbines", "order_win", ["clean_energy"], ["SUZLON"]),
    ("MegaCorp acquires a bakery chain", None, None, None),
    ("ITC Hotels to acquire GHK Hospitality for Rs 155 crore; shares decline 5%", None, None, None),
    ("Suzlon denies merger talk; Dixon bags order for laptops", "order_win", ["manufacturing_electronics"], ["DIXON"]),
    ("Rare earth export ban hits electronics manufacturing", "supply_disruption", ["manufacturing_electronics"], []),
]
FOLLOWED = [("SUZLON", "Suzlon Energy", "clean_energy"), ("DIXON", "Dixon Technologies", "manufacturing_electronics"), ("ITC", "ITC Ltd", "consumer"), ("DIXON2", "Dixon", "manufacturing_electronics")]


def _followed(spark):
    return spark.createDataFrame(FOLLOWED, "ticker string, name string, sector string")


def test_market_events(spark):
    day = datetime.date(2026, 8, 20)
    titles = spark.createDataFrame([(i, t[0], day) for i, t in enumerate(TRACKED)], "id int, title string, day date")
    companies = _followed(spark).where("ticker <> 'DIXON2'").withColumn("name", F.when(F.col("ticker") == "DIXON", "Dixon").otherwise(F.col("name")))
    got = {r["id"]: r for r in attribution.market_events(titles, _terms(spark), companies).collect()}
    for i, (title, kind, domains, actors) in enumerate(TRACKED):
        assert (i in got) == (kind is not None), title
        if kind:
            assert (got[i]["type"], got[i]["domains"], got[i]["actors"]) == (kind, domains, actors), title


def _event(i, title, day, phrase="", certainty="completed", domains=(), actors=(), direction="risk"):
    return (i, title, day, "supply_disruption", phrase, certainty, direction, list(domains), list(actors))


EVENT = "id int, title string, day date, type string, phrase string, certainty string, direction string, domains array<string>, actors array<string>"


def test_stress(spark):
    """Recent, settled risks by vocabulary and by inputs; each event once a sector."""
    today, sector = datetime.date(2026, 8, 20), "manufacturing_electronics"
    day = lambda n: today - datetime.timedelta(days=n)
    rows = [
        _event(1, "chip shortage", day(0), domains=[sector]), _event(2, "Copper prices surge on mine outage", day(14)), _event(3, "old news", day(15), domains=[sector]), _event(4, "not a risk", day(0), domains=[sector], direction="opportunity"),
        _event(5, "rumour", day(0), certainty="reported", domains=[sector]), _event(6, "copper shortage", day(3), domains=[sector, "clean_energy"]), _event(7, "undated", None, domains=[sector]),
    ]
    inputs = spark.createDataFrame([("copper", sector), ("rare earth", "clean_energy")], "src string, dst string")
    stress = attribution.sector_stress(spark.createDataFrame(rows, EVENT), inputs, F.lit(today))
    assert {r["sector"]: (r["n"], r["warns"]) for r in stress.collect()} == {sector: (3, True), "clean_energy": (1, False)}
    assert [tuple(r) for r in attribution.stress_warnings(stress, _followed(spark)).orderBy("ticker").collect()] == [(t, sector, "Medium", "risk", "Supply Stress (Forward)", 3) for t in ("DIXON", "DIXON2")]
    many = spark.createDataFrame([_event(i, "shortage", day(0), domains=[sector]) for i in range(5)], EVENT)
    got = attribution.supply_chain(many, _followed(spark)).collect()
    assert sorted((r["id"], r["ticker"]) for r in got) == [(i, t) for i in range(3) for t in ("DIXON", "DIXON2")]


def test_refreshed(spark):
    """Rules of now on events of before: corrected actors, orphans and old rows gone, a missing certainty filled in."""
    today = datetime.date(2026, 8, 20)
    rows = [
        _event(1, "ITC Hotels to acquire GHK Hospitality for Rs 155 crore", today, "to acquire", actors=["ITC"]), _event(2, "Suzlon wins order worth 300cr", today, "wins order", actors=[]),
        _event(3, "Suzlon reportedly in talks for a joint venture", today, "joint venture", certainty=""), _event(4, "Suzlon wins order worth 300cr", today - datetime.timedelta(days=46), "wins order", domains=["clean_energy"]),
        _event(5, "Dixon gains; ITC wins order", today - datetime.timedelta(days=45), "wins order", certainty="announced"), _event(6, "No one told", today, None, certainty=None, domains=["x"], actors=["ITC"]),
    ]
    companies = spark.createDataFrame([("SUZLON", "Suzlon"), ("DIXON", "Dixon"), ("ITC", "ITC Ltd")], "ticker string, name string")
    got = {r["id"]: (r["actors"], r["certainty"]) for r in attribution.refreshed(spark.createDataFrame(rows, EVENT), companies, F.lit(today)).collect()}
    assert got == {2: (["SUZLON"], "completed"), 3: (["SUZLON"], "reported"), 5: (["ITC"], "announced"), 6: ([], "completed")}
