from datetime import date

import pytest
from pyspark.sql import functions as F

from wachbuch.functions import dates, keys, places, rules
from wachbuch.operators import courts

TODAY = date(2026, 10, 11)

PLACES = [
    ("Bremen-Vegesack, OT Fähr-Lobbendorf, Kirchhofstraße", ["Vegesack"]), ("Bremen-Neustadt/Bremen-Mitte, OT Neustadt/Altstadt, Stephanibrücke", ["Neustadt", "Mitte"]),
    ("Bremen-Mitte OT Bahnhofsvorstadt", ["Mitte"]), ("Bremen – Gröpelingen, Seewenjestraße", ["Gröpelingen"]), ("Bremen, Vegesack, OT Grohn", ["Vegesack"]),
    ("Bemen-Mitte, OT Bahnhofsvorstadt", ["Mitte"]), ("Bremen-Vahr/Bundesautobahn 27", ["Vahr"]), ("Bremen-West, Findorff, Gröpelingen", ["Findorff", "Gröpelingen"]),
    ("Bremen-Nord, Blumenthal, OT Blumenthal und Vegesack, OT Fähr-Lobbendorf", ["Blumenthal", "Vegesack"]), ("Bremen, Burgdamm, Helsingborger Straße", ["Burglesum"]),
    ("Bremen, Mitte-Östliche Vorstadt", ["Mitte", "Östliche Vorstadt"]), ("Bremen-Obervieland-Industriehäfen", ["Obervieland", "Häfen"]), ("Bremen-Steintor", ["Östliche Vorstadt"]),
    ("Bremen, Mittelweg", []), ("Bremen, Stadtgebiet", []), ("Bremen Vegesacker Straße", []), ("Bremen, Weserstadion", []), ("Bremerhaven-Lehe, Hafenstraße", []), ("Hamburg", []), (None, []),
]


def values(spark, rows, schema, *cols):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
    return [tuple(r)[1:] for r in sorted(df.select("k", *cols).collect())]


def test_districts(spark):
    got = values(spark, [(p,) for p, _ in PLACES], "p string", places.districts_of(F.col("p")).alias("d"))
    assert [g[0] for g in got] == [w for _, w in PLACES]
    assert values(spark, [("Bremerhavener Straße",), ("Bremerhaven",)], "p string", places.other_city(F.col("p")).alias("o")) == [(False,), (True,)]


DAYS = [
    ("06.10.26, 13.30 Uhr", date(2026, 10, 7), date(2026, 10, 6)), ("28.9.26, 18 bis 20 Uhr", date(2026, 9, 15), date(2026, 9, 15)), ("08.10.26", date(2026, 10, 7), date(2026, 10, 7)),
    ("24.10.26, 15.30 Uhr", None, None), ("10.10.26", None, date(2026, 10, 10)), ("10.10.26", date(2027, 10, 11), date(2026, 10, 10)), (None, date(2027, 10, 11), None),
    ("November 2022", date(2026, 10, 7), date(2026, 10, 7)), ("31.10.2024", date(2025, 1, 28), date(2024, 10, 31)), ("01.03.2024", date(2025, 1, 28), date(2025, 1, 28)),
]


def test_incident_days(spark):
    got = values(spark, [(z, p) for z, p, _ in DAYS], "z string, p date", dates.incident_day(F.col("z"), F.col("p"), F.lit(TODAY)).alias("d"))
    assert [g[0] for g in got] == [w for *_, w in DAYS]


@pytest.mark.parametrize(("line", "want"), [("(07.10.2026)", "07.10.2026"), ("07.10.2026", "07.10.2026"), ("(06.02.26)", "06.02.2026"), ("(11.02.206)", None), ("Ort: Bremen", None)])
def test_date_lines(spark, line, want):
    assert values(spark, [(line,)], "x string", dates.date_line(F.col("x")).alias("d")) == [(want,)]


def test_iso_days(spark):
    got = values(spark, [("7.1.2026",), ("11.02.206",), (None,), ("31.13.2026",), ("30.02.2026",)], "x string", dates.iso_day(F.col("x")).cast("string").alias("d"))
    assert [g[0] for g in got] == ["2026-01-07", None, None, None, None]


def test_court_stages(spark):
    heads = {
        "Termin zur Urteilsverkündung in Sachen": "urteilstermin", "Urteil im Verfahren gegen": "urteil", "Entscheidung über eine Verurteilung": "sonstiges",
        "Terminsverschiebung für Auftakt": "terminaenderung", "Auftakt im Prozess nach Aufhebung durch den BGH": "auftakt", "Rechtskraft des Urteils": "rechtskraft",
    }
    got = values(spark, [(h,) for h in heads], "h string", rules.court_stage(F.col("h")).alias("s"))
    assert [g[0] for g in got] == list(heads.values())


def test_categories_in_order_and_with_umlauts(spark):
    texts = {"Überfallen und beraubt": "Raub", "Er hebelte die Tür auf": "Einbruch", "hebelte auf\ndie Tür": "Sonstiges", "Leiche nach Raub": "Toetungsdelikt", "Beschädigte Parkbank": "Sachbeschaedigung"}
    got = values(spark, [(t,) for t in texts], "t string", rules.category(F.col("t"), F.lit(None)).alias("c"))
    assert [g[0] for g in got] == list(texts.values())


RELEASE = "pm_id string, title string, publish_date string, source_url string"


def test_keys_of_a_number_used_twice(spark):
    rows = [("002825", "A", "01.02.2026", None), ("2825.0", "A", "01.02.2026", None), ("2825", "B", "05.02.2026", None), (None, "C", None, None)]
    got = [r.key for r in keys.with_keys(spark.createDataFrame(rows, RELEASE)).orderBy("title").collect()]
    assert got[0] == got[1] == "2825" and got[2].startswith("2825~") and len(got[2]) == 11 and got[3] == "t:C"


def test_days_repaired_by_neighbours(spark):
    page = "https://x/pressemeldungen-ab-11092026-9"
    rows = [("61526", "a", "14.09.2026", page), ("61626", "b", "14.08.2026", page), ("61726", "c", "15.09.2026", page)]
    got = {r.key: str(r.day) for r in keys.release_days(keys.with_keys(spark.createDataFrame(rows, RELEASE)), F.lit(TODAY)).collect()}
    assert got == {"61526": "2026-09-14", "61626": "2026-09-14", "61726": "2026-09-15"}
    rows = [("10226", "a", "14.03.2026", None), ("18026", "b", "14.06.2026", None), ("18126", "c", None, None)]
    got = {r.key: str(r.day) for r in keys.release_days(keys.with_keys(spark.createDataFrame(rows, RELEASE)), F.lit(TODAY)).collect()}
    assert got["18126"] == "2026-06-14"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def test_reflow(spark):
    assert one(spark, "Der Prozess in Bre-\nmen geht\nweiter", courts.reflow) == "Der Prozess in Bremen geht weiter"
    assert one(spark, "ein 30-\njähriger Mann\n\nEin-\nund Ausgang", courts.reflow) == "ein 30-jähriger Mann\n\nEin- und Ausgang"
    assert one(spark, "Termine:\nMontag, 1.2.\nDienstag, 2.2.", courts.reflow) == "Termine:\nMontag, 1.2.\nDienstag, 2.2."
    assert one(spark, "\n Er geht.\n Danach kommt eine viel längere Zeile - \n und das Ost-West-\n gespräch", courts.reflow) == "Er geht.\nDanach kommt eine viel längere Zeile - und das Ost-West-gespräch"
    assert one(spark, None, courts.reflow) == "" == one(spark, " \n\n", courts.reflow)


def test_events_of_a_charge(spark):
    text = "Tatvorwurf: Am 03.05.2025 in der Kirchhofstraße, " + "x" * 300 + " am 04.06.2025 am Mittelweg."
    got = one(spark, text, courts.events)
    assert [(e["date_min"], e["streets"]) for e in got] == [("2025-05-03", ["kirchhofstraße"]), ("2025-06-04", ["mittelweg"])]
    assert one(spark, "im Februar 2024", courts.events)[0]["date_max"] == "2024-02-29"
    assert one(spark, None, courts.events) == [] == one(spark, "im Sommer 2024", courts.events)
