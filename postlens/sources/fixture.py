"""Rental posts derived from the ``orders`` table (and predictions from the posts).

The given tables hold no rental posts, so the posts are a pure function of each
order: one post per order, its text put together from fragments that are chosen
by the order key.  The work of every query therefore grows with ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import literal

# Text fragments; the fragment of a list is chosen by template key modulo length.
SIZE = ("1RK ", "1bhk ", "2 BHK ", "2.5BHK ", "3bhk ", "Spacious flat ", "12bhk ", "2 BHKs ")
FURNISHING = ("semi furnished flat", "Fully-Furnished flat", "un-furnished flat", "furnished flat", "flat")
PLACE = (" in Kondapur", " near Hi-Tech City", " at Whitefields", " in SR Nagar, KPHB, Uppal and Miyapur",
         " at Prestige High Fields", " in gated society Mantri Celestia", "", " at Gachibowli", " in Madhapur")
RENT = (". Rent: Rs.{N}", ". Rs. {N} / month", ". Rent is {N}", ". 25k rent", ". Rent 14k", ". Budget: 15-20k",
        ". 10-15k", ". for rent 2 rooms", ". call after 6 pm", ". 14.5k rent", ". Rent: 500", ". Rent: ,", "")
DEPOSIT = (". Deposit: 28000", ". Deposit 30000", ". Security - Rs.50,000", ". Advance 500", ". Deposit: 2000000", "")
DATE = (". Immediate move in", ". Available from 1st May", ". Available January 15", ". From 1st week of April",
        ". Ready to move", ". 3 marble counters", "")
DETAIL = (". 1,200 sqft", ". 950 sft, 18th floor", ". East facing", ". Maintenance: 2,500", ". Maintenance 2k",
          ". 11 months lease", ". Lock: 6 months", ". north-east facing", ". 2nd floor", "")
EXTRAS = (". Car parking", ". Bike parking and car parking", ". Two wheeler parking", ". Parking",
          ". Lift, gym, swimming pool, CCTV", ". AC, geyser, wi-fi, fridge")
FOOD = (". Vegetarian preferred", ". Non-veg allowed", ". No non-veg", ". Non-vegetarian ok",
        ". No food restriction", "", "", "")
TENANT = (". Female only", ". Male only", ". Looking for a male flatmate", ". Women only",
          ". Private room for family", ". Room for rent", "")
BROKER = (". No brokerage", ". Direct owner", "", "")
PHONE_PREFIX = ("+91-", "", "91")
REPOST = ". Repost: still available"
LISTS = (SIZE, FURNISHING, PLACE, RENT, DEPOSIT, DATE, DETAIL, EXTRAS, FOOD, TENANT, BROKER)

N_GROUPS = 16

# Model output per post_id modulo 8 (NULL: no prediction row for the post).
MODEL_OUTPUT = (
    None,
    "{}",
    '{"gated_community": true, "furnished": "fully", "available_from": "1st May", "amenities": ["Lift", "gym"]}',
    'Sure! {"gated_community": false, "furnished": "semi", "rent": 15500, "bhk": "2 BHK", "location": "Kokapet"} done {x}',
    '{"gated_community": true, "furnished": ',
    '{"amenities": ["lift", "rooftop bar", "WiFi"], "parking": "car and bike", "floor": "7", "deposit": 40000}',
    '{"available_from": "2024-05-01", "sqft": 1100, "rent": "12000-14000", "maintenance": 0, "facing": "west"}',
    '{"furnished": "yes", "location": false, "lease_duration": 11, "bhk": 3, "available_from": "Immediately"}',
)


def _pick(fragments, key: str) -> str:
    """SQL for ``fragments[key % len(fragments)]``, one look-up in a constant array."""
    return f"get(array({', '.join(map(literal, fragments))}), CAST({key} % {len(fragments)} AS INT))"


def posts_from_orders(orders: DataFrame) -> DataFrame:
    """``posts(post_id, group_id, scraped_at, text, images, post_url)``."""
    template = (
        "CASE o_orderkey % 8 WHEN 3 THEN o_orderkey - 1 WHEN 7 THEN o_orderkey - 3 ELSE o_orderkey END"
    )
    parts = [_pick(f, "_key") for f in LISTS]
    at = LISTS.index(RENT)
    parts[at] = f"replace({parts[at]}, '{{N}}', CAST(5000 + 500 * (_key % 40) AS STRING))"
    phone = (
        f"CASE WHEN _key % 5 = 4 THEN '' ELSE concat('. Contact: ', {_pick(PHONE_PREFIX, '_key')}, '9', "
        "lpad(CAST(_key AS STRING), 9, '0')) END"
    )
    repost = f"CASE WHEN o_orderkey % 8 = 7 THEN {literal(REPOST)} ELSE '' END"
    photo = "concat('https://img.example/', o_orderkey, '/{}.jpg')"
    keyed = orders.selectExpr("o_orderkey", "o_custkey", "o_orderdate", f"{template} AS _key")
    return keyed.selectExpr(
        "o_orderkey AS post_id",
        f"CAST(o_custkey % {N_GROUPS} AS INT) AS group_id",
        "o_orderdate AS scraped_at",
        f"concat({', '.join([*parts, phone, repost])}) AS text",
        f"""CASE o_orderkey % 4 WHEN 1 THEN array({photo.format('a')})
            WHEN 2 THEN array({photo.format('a')}, {photo.format('b')}) END AS images""",
        f"""CASE WHEN o_orderkey % 3 != 0
            THEN concat('https://groups.example/', o_custkey % {N_GROUPS}, '/posts/', o_orderkey)
            END AS post_url""",
    )


def groups_from_orders(orders: DataFrame) -> DataFrame:
    """``groups(group_id, url, name)``; one row per group that occurs, some unnamed."""
    group_id = (F.col("o_custkey") % N_GROUPS).cast("int")
    ids = orders.select(group_id.alias("group_id")).distinct()
    number = F.col("group_id").cast("string")
    return ids.select(
        "group_id",
        F.concat(F.lit("https://groups.example/"), number).alias("url"),
        F.when(F.col("group_id") % 5 != 4, F.concat(F.lit("Group "), number)).alias("name"),
    )


def predictions_from_posts(posts: DataFrame) -> DataFrame:
    """``predictions(post_id, raw_output)``; an eighth of the posts has none."""
    output = _pick([o or "" for o in MODEL_OUTPUT], "post_id")
    return posts.where("post_id % 8 != 0").selectExpr("post_id", f"{output} AS raw_output")


def saved_log_from_events(events: DataFrame) -> DataFrame:
    """``saved_log(listing_id, ts)``: each click toggles one listing."""
    return events.where(F.col("event_type") == "click").select(
        F.col("user_id").alias("listing_id"), "ts"
    )
