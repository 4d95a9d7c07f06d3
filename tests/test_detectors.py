"""Must fire and must not fire, offsets, guards, and a Python version of the scan's pattern half."""

import re
import time

import pytest
from pyspark.sql import functions as F

from lanternsift.operators import scanner
from lanternsift.operators.detectors import candidates, registry
from lanternsift.plans import api

FIRES = [
    ("mail a.b+c@x-y.co.uk.", [("EMAIL", "a.b+c@x-y.co.uk")]),
    (".bad@x.com or bad.@x.com", []),
    ("call (415) 555-2671 or +1 415.555.2671.", [("PHONE_US", "(415) 555-2671"), ("PHONE_US", "+1 415.555.2671")]),
    ("order 4155552671", []),
    ("order 415-555-2671", [("PHONE_US", "415-555-2671")]),
    ("call 115-555-2671", []),
    ("fax: 415-555-2671", [("FAX_NUMBER", "415-555-2671")]),
    ("SSN 123-45-6789, 666-12-3456, 900-12-3456, 123-45 6789", [("SSN", "123-45-6789")]),
    ("pay 4111 1111 1111 1111 or 4111 1111 1111 1112", [("CREDIT_CARD", "4111 1111 1111 1111")]),
    ("at 10.0.0.1. not 10.0.0.256 nor version 10.2.1.4 nor v1.2.3.4 nor 1.2.3.4.5", [("IP_ADDRESS", "10.0.0.1")]),
    ("::1 and 2001:db8::5, not 12:30:45 or std::x or ::", [("IP_ADDRESS", "::1"), ("IP_ADDRESS", "2001:db8::5")]),
    ("see https://a.b/c?d=1. (www.x.org)", [("URL", "https://a.b/c?d=1"), ("URL", "www.x.org")]),
    ("DOB: 02/03/1980, born March 5, 1979", [("DATE_DOB", "02/03/1980"), ("DATE_DOB", "March 5, 1979")]),
    ("on 02/03/1980; dob 30/30/1980; born 30 Feb 1980; dob 01/01/1850", []),
    ("MRN: 12345678, chart # 99812, the chart 4829471", [("MRN", "12345678"), ("MRN", "99812")]),
    ("insurance member id: ABC12345, gym member id: 777777", [("HEALTH_PLAN_ID", "ABC12345")]),
    ("acct no: 12345678, driver's license no: D1234567, DL: X99812", [("ACCOUNT_NUMBER", "12345678"), ("US_DRIVER_LICENSE", "D1234567"), ("US_DRIVER_LICENSE", "X99812")]),
    ("routing number 021000021, aba 021000022", [("BANK_ROUTING", "021000021")]),
    ("SWIFT DEUTDEFF, SOFTWARE, ABCDEF12", [("SWIFT_BIC", "DEUTDEFF"), ("SWIFT_BIC", "ABCDEF12")]),
    ("VIN 1M8GDM9AXKP042788, 1M8GDM9A1KP042788", [("VEHICLE_ID", "1M8GDM9AXKP042788")]),
    ("mac 00:1A:2b:3c:4d:5e, 00:1A-2b:3c:4d:5e", [("MAC_ADDRESS", "00:1A:2b:3c:4d:5e")]),
    ("EIN 12-3456789, tin 07-1234567", [("TAX_ID", "12-3456789")]),
    ("Dr. Jane Doe met John Q. Public at 12 Oak Tree Street, Boston", [("PERSON_NAME", "Jane Doe"), ("PERSON_NAME", "John Q. Public"), ("ADDRESS", "12 Oak Tree Street, Boston")]),
    ("Paris Baker lives on 44 Street Road; Jane went", []),
    ("", []),
    (None, []),
]


def test_fires_and_does_not_fire(spark):
    rows = [(i, t) for i, (t, _) in enumerate(FIRES)]
    got = {r["doc_id"]: r["entities"] for r in api.scan(spark.createDataFrame(rows, "doc_id long, text string"), as_of=F.lit("2024-01-01").cast("date")).collect()}
    for i, (text, want) in enumerate(FIRES):
        assert [(e["type"], e["text"]) for e in got[i]] == want, text
        for e in got[i]:
            assert text[e["start"] : e["end"]] == e["text"]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_guards_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    extra = spark.createDataFrame([(t,) for t, _ in FIRES], "text string")
    both = docs.union(extra).select(candidates(F.col("text")).alias("a"), candidates(F.col("text"), guard=False).alias("b"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_patterns_agree_with_python(spark):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = [t for t in [*docs, *(t for t, _ in FIRES)] if t] + ["ñ １２３ 415-555-2671 é@x.de"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for d in registry():
        if d.name not in ("email", "ssn", "ip_address", "mac_address", "vehicle_id"):
            continue
        flags = re.IGNORECASE if "(?i" in d.pattern else 0
        python = re.compile(re.sub(r"\(\?i?U?\)", "", d.pattern), flags)
        got = {r["i"]: r["n"] for r in frame.select("i", F.size(F.regexp_extract_all("text", F.lit(d.pattern), F.lit(0))).alias("n")).collect()}
        assert all(got[i] == len(python.findall(t)) for i, t in enumerate(texts)), d.name


ODD = [
    "İ mail x@y.org, İİ Dr. Jane Doe, İ account no: 12345678", "a@b.com@c.org x..y@z.de @@ a@b", "fax 415-555-2671 order 4155552671 415 555 2671 (415)555-2671",
    "born 02/03/1980 03/04/1981, date of  birth March 5 1979, dob 5 March 1979 2001-02-03", "1:2:3 a:b::c 12345:6:7:8 ::ffff:1 x::1 fe80::1: 1:2:3:4:5:6:7:8 .::2", "00-1A-2b-3c-4d-5e-00-1A-2b-3c-4d-5e 00:1a:2b:3c:4d:5e",
    "12 Oak Street 13 Elm  Tree Road, Boston 1234567 Oak Street 5 Way Way", "Jane Jane Doe Mr Smith mrs. John Smith O'Mary Smith Mary  Smith Mary-Smith Mary J. Hill Mary j. Hill MARY SMITH mary Smith Dr. Mary", "abcdefg1 ABCDEF12 ABCDEF12345 ABCDEF1234 xABCDEFGHIJ1",
    "http://a http://b.c/d. HTTPS://X.Y/z) www.www.x.org", "4111-1111-1111-1111 4111 1111-1111 1111 41111111111111111111 123-45-6789-1", "10.0.0.1.5 1.2.3.4. release 1.2.3.4 v 1.2.3.4 300.1.1.1", "DL: X99812 DL#DL: Y1234 driver's license no. D1 driver license DRIVER LICENSE: 12345",
    "1M8GDM9AXKP042788 1m8gdm9axkp042788 x1M8GDM9AXKP042788", "ein 12-3456789 tin12-3456789 EIN: 123456789 taxpayer id number 12-3456789", "MRN MRN: 12345 chart no. 4444 medical record number: A-12345", "health plan member id: 12345 medical subscriber # 99999a health   insurance member no: 123",
]


def test_scan_equals_its_column_form(spark):
    """The Arrow pass tries patterns at anchors only; the column form searches whole texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    texts = [r["text"] for r in docs.collect()] + [t for t, _ in FIRES] + ODD + [" ".join(ODD), "\n".join(t or "" for t, _ in FIRES)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    day = F.lit("2024-01-01").cast("date")
    got, want = ({r["doc_id"]: r["entities"] for r in f(rows, as_of=day).collect()} for f in (api.scan, api.scan_columns))
    assert {i: texts[i] for i in got if got[i] != want[i]} == {}
    assert sum(map(len, got.values())) > 100


def test_custom_detectors_go_by_columns(spark):
    from dataclasses import replace

    own = replace(registry()[0], type="URL")
    rows = spark.createDataFrame([("to a@b.org",)], "text string")
    assert scanner.keys_of([own]) is None and [e["type"] for e in api.scan(rows, detectors=[own]).first()["entities"]] == ["URL"]


def test_urls_are_clipped():
    (hit,) = scanner.find("see http://" + "a" * 5000, ["url"], False, 2024)
    assert hit[2] - hit[1] == 6 + scanner.URL_CLIP


def test_scan_is_linear():
    def took(text):
        t = time.perf_counter()
        scanner.resolve(scanner.find(text, list(scanner.REGISTRY), True, 2024))
        return time.perf_counter() - t

    words = "lorem ipsum dolor sit amet consectetur " * 7000
    plain = min(took(words) for _ in range(3))
    assert min(took(words + "Jane Doe") for _ in range(3)) < 3 * plain + 0.05
    assert min(took("a@b.org Jane Doe 415-555-2671 " * 4000) for _ in range(2)) < 20
    for hostile in ("0" * 200_000, "a" * 200_000, ":" * 100_000, "1 " * 100_000, "-" * 100_000, "a@" * 50_000, "Jane " * 40_000):
        assert took(hostile) < 20


def test_ipv4_cues_have_the_word_edges_of_their_sql(spark):
    """SQL's edges are of ASCII words, and only the end of the text before ends a cue."""
    texts = {"chöver. 1.2.3.4": 0, "höver é 1.2.3.4": 0, "ver é 1.2.3.4": 0, "cover. 1.2.3.4": 1, "v\n1.2.3.4": 1, "version ..\n\n1.2.3.4": 1, "v1.2.3.4": 0, "verä 1.2.3.4": 0, "a 1.2.3.4٣": 1, "٣1.2.3.4": 1, "Version: 1.2.3.4": 0}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = [d for d in registry() if d.name == "ip_address"]
    for found in (api.scan(docs, detectors=one, names=False), api.scan_columns(docs, detectors=one, names=False)):
        assert [r["n"] for r in found.select("doc_id", F.size("entities").alias("n")).orderBy("doc_id").collect()] == list(texts.values())
