"""Extraction: golden posts, odd cases and non-ASCII text."""

import pytest

from postlens.functions.extract import FIELDS, extract_fields, extract_phone
from postlens.plans.jobs import to_listings
from pyspark.sql import functions as F

GOLDEN = [
    (
        "1bhk semi furnished flat in Kondapur. Rent: 12,000. Contact: +91-9876543210",
        dict(bhk="1", rent=12000, location="Kondapur", furnished="semi", contact="9876543210"),
    ),
    (
        "1RK Fully Furnished Flat for Rent in Kondapur. Rent: 22,000/- (Negotiable)",
        dict(bhk="RK", rent=22000, location="Kondapur", furnished="fully"),
    ),
    (
        "3BHK gated community at Prestige High Fields. 25k rent. 18th floor. East facing. Car parking.",
        dict(bhk="3", rent=25000, gated_community=True, floor="18", facing="east", parking="car",
             amenities=["parking"]),
    ),
    (
        "Looking for male replacement in 2bhk. Rent 14k. Deposit 28000. Available from 1st May. "
        "Lift, gym, swimming pool.",
        dict(bhk="2", rent=14000, available_from="1 May", amenities=["lift", "gym", "swimming pool"]),
    ),
    (
        "2.5BHK semi furnished flat in Manikonda. Budget: 15-20k. No brokerage. Vegetarian preferred.",
        dict(bhk="2.5", rent=15000, location="Manikonda", furnished="semi"),
    ),
]

ODD = [
    ("rent", "for rent 2 rooms", 2000),
    ("rent", "call after 6 pm", 6000),
    ("rent", "1 month deposit", 1000),
    ("rent", "14.5k rent", 5000),
    ("rent", "counters. 11 months lease", 11000),
    ("rent", "rent: 14.5k", 14000),
    ("rent", "Rent: 500", None),
    ("rent", "Rent: ,", None),
    ("rent", "rent: 0", 0),
    ("rent", "rent: 99999999999999999999999", None),
    ("rent", "Rent: \u20b918,500", 18500),
    ("rent", "rent \u2013 9000", 9000),
    ("rent", "10k to 15k", 10000),
    ("bhk", "12bhk", "2"),
    ("bhk", "2 BHKs", None),
    ("bhk", "2.0bhk", "2.0"),
    ("bhk", "2bhk and 1 rk", "RK"),
    ("deposit", "Deposit 28000", None),
    ("deposit", "Deposit: 5, security 20,000", 20000),
    ("sqft", "1,200 sqft", 200),
    ("sqft", "950 sq. ft", 950),
    ("location", "near hi-tech city", "Hi-Tech City"),
    ("location", "whitefields", "Whitefields, Whitefield"),
    ("location", "uppal, miyapur, kphb, sr nagar", "Miyapur, Kphb, Sr Nagar"),
    ("available_from", "3 marble counters", "3 Mar"),
    ("available_from", "may 2024", "20 May"),
    ("available_from", "january 15", "15 January"),
    ("available_from", "1 january", "1 Jan"),
    ("available_from", "1st week of april", "Week 1 of Apr"),
    ("available_from", "ready  to move", "immediate"),
    ("floor", "2 floors", "2"),
    ("maintenance", "maintenance 2k", None),
    ("maintenance", "maintenance: Rs.2,500", 2500),
    ("parking", "no parking", "car"),
    ("parking", "two-wheeler parking", "bike"),
    ("parking", "2 wheeler parking, car park", "both"),
    ("facing", "north-east facing", "east"),
    ("lease_duration", "11 months lease", 11),
    ("lease_duration", "lock: 6 months", 6),
    ("contact", "919000000002", "9190000000"),
    ("contact", "+91 9000000002", "9000000002"),
    ("contact", "+91-XXXXXX", None),
    ("gated_community", "my home avatar", True),
    ("gated_community", "a flat", False),
    ("furnished", "furnished", None),
    ("amenities", "space, room", None),
    ("amenities", "ac, ro and dg set", ["power backup", "ac", "ro"]),
    # A combining mark ends a word: c + cedilla after decomposition.
    ("amenities", "fran\u00e7ais a\u00e7o", ["ac"]),
    ("amenities", "\u0430ac", None),
    # Bold mathematical letters and digits.
    ("bhk", "\U0001d7f0\U0001d5d5\U0001d5db\U0001d5de flat", "4"),
    ("contact", "\U0001d7f5\U0001d7ec\U0001d7ec\U0001d7ec\U0001d7ec\U0001d7ec\U0001d7ec\U0001d7ec\U0001d7ec\U0001d7ed", "9000000001"),
    # No-break space, line separator, file separator as white space.
    ("rent", "rent\u00a0:\u00a015000", 15000),
    ("rent", "rent\u2028:\u1c7f15000".replace("\u1c7f", "\u2029"), 15000),
    ("rent", "rent\x1c:\x1f15000", 15000),
    ("location", "hitech\u2028city", None),
    ("location", "hitech\u00a0city", "Hitech City"),
    # Digits of another script count as digits.
    ("rent", "rent: \u0967\u0968\u0969\u096a\u096b", 12345),
]


def test_golden_posts(spark):
    rows = extract_fields(spark.createDataFrame([(t,) for t, _ in GOLDEN], "text string")).collect()
    for (text, expected), row in zip(GOLDEN, rows):
        filled = {f: row[f] for f in FIELDS if row[f] is not None and row[f] is not False}
        assert filled == expected, text


def test_odd_cases(spark):
    data = [(i, case[1]) for i, case in enumerate(ODD)]
    rows = extract_fields(spark.createDataFrame(data, "i int, text string")).orderBy("i").collect()
    wrong = [(f, t, row[f], want) for (f, t, want), row in zip(ODD, rows) if row[f] != want]
    assert wrong == []


def test_null_text(spark):
    row = extract_fields(spark.createDataFrame([(None,)], "text string")).first()
    assert [row[f] for f in FIELDS if f != "gated_community"] == [None] * 14
    assert row.gated_community is False


def test_phone_of_the_model_path(spark):
    texts = ["call \U0001d7f5876543210", "\uff19876543210", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(extract_phone(F.col("text"))).collect()] == ["9876543210", None, None]


def test_filters_on_fields_do_not_repeat_the_text_function(spark):
    df = extract_fields(spark.range(1).selectExpr("id", "cast(id as string) text"))
    plan = df.where("rent > 5 and furnished = 'semi'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


CASCADE = [
    (
        "3BHK fully furnished flat in gated society Mantri Celestia, Wipro circle. Rent 17,666. Deposit 34000. "
        "Lift, gym, swimming pool. Move in 1st May. Call 9876543210",
        dict(bhk="3", rent=17666, deposit=None, location="Wipro Circle", gated_community=True, furnished="fully",
             available_from="1 May", amenities=["lift", "gym", "swimming pool"], contact="9876543210",
             listing_type="full_flat", food_preference=None, gender_preference="any", no_brokerage=False),
    ),
    (
        "1RK semi furnished in Kondapur. 12k rent. No brokerage. Vegetarian preferred. Female only.",
        dict(bhk="RK", rent=12000, location="Kondapur", furnished="semi", food_preference="veg",
             gender_preference="female", no_brokerage=True, listing_type="full_flat"),
    ),
    (
        "Looking for male flatmate in 2bhk at Prestige High Fields. 8k per person. Immediate move in. "
        "Parking, wifi, ac available.",
        dict(bhk="2", rent=None, gated_community=True, available_from="immediate", parking="car",
             amenities=["parking", "wifi", "ac"], gender_preference="male", listing_type="flatmate"),
    ),
]


@pytest.mark.parametrize("text, expected", CASCADE)
def test_full_listing(spark, text, expected):
    posts = spark.sql("select 1L post_id, 1 group_id, timestamp'2024-01-01' scraped_at, :t text, "
                      "cast(null as array<string>) images, cast(null as string) post_url", {"t": text})
    row = to_listings(posts).first()
    assert {k: row[k] for k in expected} == expected
