from decimal import Decimal

from pyspark.sql import functions as F

from subventa.operators import extract as E
from subventa.operators import scan as S

KFW = """<html><head><title>Startgeld | KfW</title><meta name="description" content="Kurz und gut"></head>
<body><nav><p>Navigation bis zu 9 Mio. EUR</p></nav><main><h1 class="x">Kredit Nr.067ERP-Gründerkredit</h1>
<p>kurz</p><p>In wenigen Klicks prüfen Sie, ob Sie die Voraussetzungen für die Förderung erfüllen können.</p>
<p>Ein ausreichend langer Absatz, der als Zusammen­fassung dienen kann, <b>ja.<p>bis zu 200.000 Euro Kredit, bis zu 900 Euro</p>
<script>bis zu 5 Mio. EUR</script><form>bis zu 7 Mio. EUR</form></main></body></html>"""
EXIST = "<html><body><h1>Stipen­dium</h1><p>Das Stipendium: 3.000 € pro Monat, insgesamt EUR 50.000 an Mitteln.</p></body></html>"
EIC = """<html><body><article><h1 class="ecl-page-header__title">EIC Accelerator</h1><header>x</header><p>Support of UP TO €10 million for scaling, grant
component below €2.5 million as usual.</p></article><footer>maximum 900 million</footer></body></html>"""


def records(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, portal string, html string")
    return {r["page_id"]: r for r in E.with_rejections(E.extract_records(df)).collect()}


def test_portal_pages(spark):
    got = records(
        spark,
        [
            (1, "https://www.kfw.de/foo/Startgeld-(067)/", "kfw", KFW),
            (2, "https://exist.de/programm/exist-gruendungsstipendium/", "exist", EXIST),
            (3, "https://eic.ec.europa.eu/eic-accelerator_en", "eic", EIC),
            (4, "https://www.nrwbank.de/15086/gruendungszuschuss.html", "nrw", KFW),
            (5, "https://x.test/unknown", "bmbf", KFW),
            (6, "https://x.test/broken", "bw", None),
            (7, "https://bayernkapital.de/fonds/", "bayern", KFW),
        ],
    )
    kfw, exist, eic, nrw, unknown, broken, bayern = (got[i] for i in range(1, 8))
    assert kfw["title"] == "ERP-Gründerkredit" and kfw["source_doc_id"] == "Startgeld-(067)"
    assert kfw["summary"].startswith("Ein ausreichend langer Absatz, der als Zusammenfassung")
    assert "7 Mio" not in kfw["body"] and "5 Mio" not in kfw["body"] and "Navigation" not in kfw["body"]
    # navigation lies outside the content scope, so its amount is still seen
    assert kfw["funding_max_eur"] == Decimal("9000000") and kfw["funding_min_eur"] is None
    assert exist["title"] == "Stipendium" and exist["status"] == "rolling" and exist["deadline"] is None
    assert exist["source_doc_id"] == "exist-gruendungsstipendium"
    assert (exist["funding_min_eur"], exist["funding_max_eur"]) == (Decimal("3000"), Decimal("3000"))
    assert eic["country"] == "EU" and eic["source_doc_id"] == "eic-accelerator"
    # amounts read a dot before one digit as decimal; the footer lies outside the scope
    assert eic["funding_max_eur"] == Decimal("900000000") and eic["funding_min_eur"] == Decimal("2500000")
    assert nrw["summary"] == "Kurz und gut" and nrw["source_doc_id"] == "15086" and nrw["federal_state"] == "Nordrhein-Westfalen"
    assert nrw["title"] == "Kredit Nr.067ERP-Gründerkredit"
    assert unknown["parse_error"] == "unknown portal: bmbf"
    assert broken["parse_error"] and broken["reasons"]
    assert bayern["title"] == "Startgeld | KfW"
    assert kfw["reasons"] == [] and exist["reasons"] == []


def test_windows_match_a_scan_by_position(spark):
    text = "ab€cdefgh€€ij EUR x EUREUR " * 3
    got = spark.range(1).select(S.windows_around(F.lit(text), "€", 3).alias("w"), S.windows_around(F.lit(text), "EUR", 5).alias("v")).first()
    for cue, reach, have in (("€", 3, got["w"]), ("EUR", 5, got["v"])):
        at = [i for i in range(len(text)) if text.startswith(cue, i)]
        assert list(have) == [text[max(0, i - reach) : i + reach] for i in at]
    text = "maximumaximum up to 5, Up To"
    got = spark.range(1).select(S.windows_after(F.lit(text), ("up to", "maximum"), 8, True).alias("w")).first()["w"]
    low = text.lower()
    want = [low[i : i + 8] for i in range(len(low)) if low.startswith("maximum", i) or low.startswith("up to", i)]
    assert list(got) == want


def test_scan_texts_are_made_after_the_spreading(spark, tmp_path):
    from subventa.plans import QUERIES

    rows = [(i, 10, 20, n, 5.0, 1234.5, "R", "F") for i in (1, 1, 2) for n in range(1, 8)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    spark.createDataFrame(rows, f"{names}, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, portals in (("scan_cue_amounts", 6), ("scan_currency_amounts", 1)):
        df = QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Repartition") == 1 and "format_number" not in plan[plan.index("Repartition") :]
        assert df.count() == 3 * portals
    got = {r["portal"]: (r["lowest"], r["highest"], r["n"]) for r in QUERIES["scan_cue_amounts"](spark, str(tmp_path)).collect()}
    # a number with two dots and a dot at its end is unreadable; 1,234 reads as 1.234
    assert got["eic"] == (900000.0, 5000000.0, 2) and got["bayern"] == (5250000000.0, 5250000000.0, 1)


def test_deadline_takes_first_cue_with_a_date(spark):
    cues = ("Stichtag", "Antragsfrist", "Deadline")
    texts = [
        ("Deadline 01.01.2027. Antragsfrist 02.02.2027", "2027-02-02"),
        ("Stichtag offen " + "x" * 300 + " Deadline 01.01.2027 Stichtag 03.03.2027", "2027-01-01"),
        ("nichts", None),
    ]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    got = [r["d"] for r in df.select(S.first_deadline(F.col("t"), cues).cast("date").cast("string").alias("d")).collect()]
    assert got == [d for _, d in texts]


def test_split_valid(spark):
    base = ("https://a.test/123", "T", "S", "B", "kfw", "open", "DE")
    rows = [
        (1, *base, None),
        (2, "short", "T", "S", "B", "kfw", "open", "DE", None),
        (3, "https://a.test/124", "T" * 501, "S", "B", "kfw", "open", "DE", None),
        (4, "https://a.test/125", "T", "S", "B", "nope", "open", "DEU", None),
        (5, "https://a.test/126", "T", "S", "B", "kfw", "open", "DE", Decimal(-1)),
    ]
    df = spark.createDataFrame(
        rows,
        "id int, source_url string, title string, summary string, body string, portal string, status string, country string, funding_max_eur decimal(38,6)",
    )
    good, bad = E.split_valid(df)
    assert [r["id"] for r in good.collect()] == [1]
    reasons = {r["id"]: r["reasons"] for r in bad.collect()}
    assert reasons[4] == ["portal not allowed", "country not two letters"]
    assert set(reasons) == {2, 3, 4, 5}


def test_parts_of_few_pages_are_held_at_once(spark, monkeypatch):
    """A batch of many pages goes on in pieces, with a row for every page, empty and broken ones included."""
    frame = E.pd.DataFrame
    rows = [(i, f"https://www.kfw.de/{i}", "kfw", None if i % 50 == 7 else KFW) for i in range(1300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, portal string, html string")
    walk = {}
    monkeypatch.setattr(type(pages), "mapInPandas", lambda self, run, schema: walk.setdefault("run", run) and self)
    E.page_structure(pages)
    batch = frame(rows, columns=["page_id", "url", "portal", "html"])
    out = list(walk["run"](iter([batch, batch.iloc[:0]])))
    sizes = [len(p) for p in out]
    assert max(sizes) <= E.WALK_ROWS and sum(sizes) == 1300
    assert [i for p in out for i in p["page_id"]] == list(range(1300))
    assert sum(p["parse_error"].notna().sum() for p in out) == 26
