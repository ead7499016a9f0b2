"""Classes, normalisers, predictions, search, saved items, corpus, pages, tables."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from postlens.functions import classify, html
from postlens.functions.predictions import decode_predictions, merge_predictions
from postlens.operators import corpus, facets, ordering, saved, stats
from postlens.operators.order_statistics import kth_largest, kth_smallest
from postlens.operators.skew import lookup_join
from postlens.plans import catalogue, jobs
from postlens.sources import tables, versions
from tests.conftest import SF


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build).collect()]


def test_classes(spark):
    low = "lower(v)"
    assert column(spark, ["Looking for a tenant", "Private room", "flat"], classify.listing_type(low)) == [
        "flatmate", "room", "full_flat"]
    assert column(spark, ["Female only", "only male", "x"], classify.gender_preference(low)) == [
        "female", "male", "any"]
    food = classify.food_preference(classify.says_veg(low), classify.says_non_veg(low))
    assert column(spark, ["pure veg", "non veg ok", "no non-veg", "non-vegetarian", "x"], food) == [
        "veg", "non_veg", "any", "any", None]
    assert column(spark, ["Zero brokerage", "x", None], classify.no_brokerage(low)) == [True, False, False]


def test_normalisers(spark):
    v = F.col("v")
    assert column(spark, [" Furnished ", "Un-furnish", "UNFURNISHED", "semi", "fully", "", None],
                  classify.normal_furnished(v)) == ["fully", None, "unfurnished", "semi", "fully", None, None]
    assert column(spark, ["2 car", "Car", "two-wheeler", "bikes", "both", None],
                  classify.normal_parking(v)) == ["both", "car", "bike", None, "both", None]
    assert column(spark, ["12,000", "12000-14000", "999999", "1234567", "0900", None],
                  classify.normal_rent_text(v)) == [None, 12000, None, 123456, None, None]
    assert column(spark, [999, 1000, 500000, 500001], classify.normal_rent(v), "int") == [None, 1000, 500000, None]
    assert column(spark, [" rk ", "2 BHK", "2.5", "three", None], classify.normal_bhk(v)) == [
        "RK", "2", "2.5", None, None]


def test_enrich_is_idempotent(spark):
    once = jobs.to_listings(catalogue.posts(spark, SF))
    twice = classify.enrich(once).select(*once.columns)
    assert once.exceptAll(twice).isEmpty()


def test_decode_predictions(spark):
    raws = {
        1: 'x {"rent": 15000, "gated_community": "no", "floor": 7} y',
        2: '{"rent": "12000-14000", "gated_community": 0, "location": false}',
        3: '{"rent": 12000.5, "amenities": "lift", "gated_community": []}',
        4: '{"rent": 1234567, "gated_community": null}',
        5: '{"rent": "1234567", "gated_community": [1]}',
        6: '{broken', 7: '{"a": 1', 8: None, 9: "{}", 10: "{'rent': 9000}",
    }
    rows = {r.post_id: r for r in decode_predictions(
        spark.createDataFrame(list(raws.items()), "post_id long, raw_output string")).collect()}
    assert [rows[i].model_rent for i in range(1, 11)] == [15000, 12000, None, None, 123456] + [None] * 5
    assert [rows[i].model_gated_community for i in range(1, 6)] == [True, False, False, None, True]
    assert [rows[i].model_empty for i in range(1, 11)] == [False] * 5 + [True] * 5
    assert rows[1].model_floor == "7" and rows[2].model_location is None and rows[3].model_amenities is None


def test_last_of_repeated_keys_counts(spark):
    raws = [
        '{"bhk": 2, "bhk": 3}', '{"rent": 9000, "rent": "12000-14000", "floor": null, "floor": "7"}', '{"x": 1, "x": 2}',
        '{"bhk": 2, "bhk": null}', "{'bhk': 1, 'bhk': 2}", '{"bhk": 1, "bhk": 2', '{"bhk" 1, "bhk": 1}', '{"gated_community": true, "gated_community": 0}',
    ]
    got = decode_predictions(spark.createDataFrame(list(enumerate(raws)), "post_id long, raw_output string")).orderBy("post_id").collect()
    assert [r.model_bhk for r in got] == ["3"] + [None] * 7
    assert (got[1].model_rent, got[1].model_floor, got[7].model_gated_community) == (12000, "7", False)
    assert [r.model_empty for r in got] == [False] * 4 + [True] * 3 + [False]


def test_widest_object_must_be_one_value(spark):
    raws = {1: '{"floor": "3"} and {"floor": "4"}', 2: 'a {"floor": {"n": 1}} b', 3: '{"floor": "3"},{"floor": "4"}'}
    df = spark.createDataFrame(list(raws.items()), "post_id long, raw_output string")
    wide = {r.post_id: r.model_empty for r in decode_predictions(df, widest=True).collect()}
    narrow = {r.post_id: r.model_floor for r in decode_predictions(df).collect()}
    assert wide == {1: True, 2: False, 3: True}
    assert narrow == {1: "3", 2: None, 3: "3"}


def test_merge_priorities(spark):
    from postlens.functions.extract import extract_fields

    posts = spark.createDataFrame(
        [(1, "rent: 0, 2bhk, semi furnished kondapur"), (2, "plain text"), (3, "plain text")],
        "post_id long, text string")
    answers = spark.createDataFrame(
        [(1, '{"rent": 9000, "bhk": 3, "furnished": "yes", "location": "Kokapet", "deposit": 0}'),
         (2, '{"amenities": ["Lift", "pool table"], "available_from": "2024-05-01", "gated_community": true}')],
        "post_id long, raw_output string")
    rows = {r.post_id: r for r in merge_predictions(extract_fields(posts), answers).collect()}
    assert (rows[1].rent, rows[1].bhk, rows[1].furnished, rows[1].location) == (9000, "2", "yes", "Kokapet")
    assert rows[1].deposit is None
    assert (rows[2].amenities, rows[2].available_from, rows[2].gated_community) == (["Lift"], None, True)
    assert rows[3].gated_community is False and rows[3].bhk is None


def test_facets(spark):
    rows = spark.createDataFrame(
        [(1, "2", 9000, "Hi-Tech City", None), (2, "2.5", None, "Kondapur", "male"), (3, "RK", 500, None, "any")],
        "id long, bhk string, rent int, location string, gender_preference string")

    def ids(**filters):
        return sorted(r.id for r in facets.filter_listings(rows, **filters).collect())

    assert ids(bhk=2) == [1] and ids(min_rent=0) == [1, 2, 3] and ids(min_rent=600) == [1]
    assert ids(gender_preference="not_male") == [1, 3] and ids(gender_preference="any") == [3]
    assert ids(location="HI_tech") == [1] and ids(location="HI_tech", escape=True) == []
    assert ids(location="\\") == []


def test_pages_partition_the_result(spark):
    rows = catalogue.listings(spark, SF).select("id", "bhk", "rent", "created_at").where("bhk = 'RK'").cache()
    total = rows.count()
    seen = []
    for number in range(1, ordering.page_count(total) + 1):
        part, counted, shown = ordering.page(rows, number, "rent", total=total)
        assert (counted, shown) == (total, number)
        seen += [(r.rent, r.id) for r in part.collect()]
    expected = sorted(((r.rent, r.id) for r in rows.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), -x[1]))
    assert seen == expected
    assert ordering.page(rows, 0, total=total)[2] == 1
    assert ordering.page(rows, 10**6, total=total)[2] == ordering.page_count(total)


@pytest.mark.parametrize("sort_by", ["rent", "created_at", "bhk"])
def test_deep_pages_equal_a_sort(spark, sort_by):
    rows = catalogue.listings(spark, SF).select("id", "bhk", "rent", "created_at").where("id % 3 = 0 OR rent IS NULL").cache()
    expected = [r.id for r in rows.orderBy(*ordering.sort_order(sort_by)).select("id").collect()]
    filled = rows.where(F.col(sort_by).isNotNull()).count()
    for offset in {1, filled, filled + 1, len(expected) - 1, len(expected) + 1}:
        deep = ordering.top_listings(rows, sort_by, 12, offset, shallow=0)
        assert [r.id for r in deep.collect()] == expected[offset : offset + 12]
        assert "Offset" not in deep._jdf.queryExecution().optimizedPlan().toString()
    first = ordering.top_listings(rows, sort_by, 5).collect()[-1]
    after = ordering.top_after(rows, first[sort_by], first.id, sort_by, 5)
    assert [r.id for r in after.collect()] == expected[5:10]
    assert ordering.top_listings(rows.limit(0), sort_by, 5, 5, shallow=0).collect() == []


def test_kth_largest(spark):
    texts = ["", "a", "a\0", "abcdef", "abcdefg", "abcdefgé", "é", "𝒳", "𝒳" * 9, "\uffff", None, "a", "abcdefghijklm"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    ordered = sorted((t for t in texts if t is not None), key=lambda t: t.encode(), reverse=True)
    assert [kth_largest(rows, "t", k) for k in range(1, len(ordered) + 2)] == [*ordered, None]
    days = spark.sql("SELECT * FROM VALUES (DATE'1950-02-01'), (DATE'2024-02-29'), (NULL) AS t(d)")
    assert [str(kth_largest(days, "d", k)) for k in (1, 2, 3)] == ["2024-02-29", "1950-02-01", "None"]
    with pytest.raises(TypeError):
        kth_largest(days.select(F.lit(1.5).alias("x")), "x", 1)


def test_stats_equal_separate_counts(spark):
    rows = catalogue.listings(spark, SF).cache()
    row = stats.stats(rows).first()
    assert row.total == rows.count() and row.with_rent == rows.where("rent is not null").count()
    assert row.flatmate == rows.where("listing_type = 'flatmate'").count()
    assert row.veg == rows.where("food_preference = 'veg'").count()
    assert row.no_brokerage == rows.where("no_brokerage").count()


def test_toggles_equal_a_sequential_fold(spark):
    rng = random.Random(5)
    before = {i: ("kept", 0) for i in range(0, 10, 2)}
    log = [(rng.randrange(12), t) for t in range(1, 60)]
    state = dict(before)
    for listing, t in log:
        if listing in state:
            del state[listing]
        else:
            state[listing] = ("", t)
    saved_df = spark.createDataFrame([(i, n, t) for i, (n, t) in before.items()],
                                     "listing_id long, note string, created_at long")
    log_df = spark.createDataFrame(log, "listing_id long, ts long")
    got = {r.listing_id: (r.note, r.created_at) for r in saved.fold_toggles(log_df, saved_df).collect()}
    assert got == state


def test_add_keeps_first_and_refuses_unknown(spark):
    now = spark.createDataFrame([(1, "a", 1)], "listing_id long, note string, created_at long")
    more = spark.createDataFrame([(1, "b", 2), (2, "late", 5), (2, "first", 3), (9, "x", 4)], now.schema)
    listings = spark.createDataFrame([(1,), (2,)], "id long")
    got = sorted(saved.add_saved(now, more, listings).collect())
    assert got == [Row(1, "a", 1), Row(2, "first", 3)]
    assert [r[0] for r in saved.remove_saved(now, more).collect()] == []


def test_training_pairs(spark):
    long_text = "a flat near the lake with a view"
    rows = spark.createDataFrame(
        [(1, long_text, False, "semi", None, ["lift", 'a"b'], ), (2, "short", True, None, None, None),
         (3, long_text, None, None, None, None), (4, long_text, False, None, None, None)],
        "id long, raw_text string, gated_community boolean, furnished string, available_from string, amenities array<string>")
    got = {r.id: r for r in corpus.training_pairs(rows).collect()}
    assert sorted(got) == [1, 4]
    assert got[1].completion == json.dumps(
        {"gated_community": False, "furnished": "semi", "available_from": None, "amenities": ["lift", 'a"b']})
    assert got[1].prompt.endswith("\n\nPost: " + long_text)
    chat = corpus.chat_turns(corpus.training_pairs(rows)).where("id = 4").first().messages
    assert [m.role for m in chat] == ["system", "user", "assistant"] and chat[2].content == got[4].completion


def test_kth_smallest(spark):
    rng = random.Random(1)
    values = [rng.randrange(-2**62, 2**62) for _ in range(200)] + [7] * 50 + [2**63 - 1, -2**63]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values)
    for k in (1, 2, 100, 150, len(values)):
        assert kth_smallest(df, "v", k, buckets=16) == ordered[k - 1]
    assert kth_smallest(df, "v", 0) is None and kth_smallest(df, "v", 999) is None


def test_splits(spark):
    ids = spark.createDataFrame([(i * i,) for i in range(101)], "id long")
    ordered = corpus.split_ordered(ids).orderBy("id").collect()
    assert [r.split for r in ordered] == ["train"] * int(101 * 0.9) + ["valid"] * 11
    seeded = corpus.split_seeded(ids)
    assert seeded.where("split = 'valid'").count() == 11
    assert sorted(seeded.collect()) == sorted(corpus.split_seeded(ids.repartition(3)).collect())


def test_lookup_join_with_hot_keys(spark):
    big = spark.range(500).selectExpr("id", "if(id % 3 = 0, 0, id % 40) k")
    lookup = spark.range(30).selectExpr("id k", "id * 10 v")
    plain = big.join(lookup, "k").select("id", "k", "v")
    split = lookup_join(big, lookup, ["k"], hot_rows=20).select("id", "k", "v")
    assert sorted(plain.collect()) == sorted(split.collect())


PAGES = {
    1: '<a href="/x">n</a><a class="b" href="https://s/posts/9?ref=1">p</a><a href="https://s/posts/10">q</a>',
    2: "<a href='https://s/permalink/5/?x=1'>p</a>",
    3: '<a href="https://s/story.php?story_fbid=77&id=1">p</a>',
    4: '<a href="/about">p</a>',
    5: '<h1>Notifications</h1><img src="https://scontent/a.jpg"><img alt="" src="https://scontent/emoji/1.png">'
       '<img src="https://scontent/50x50/b.jpg"><img src="https://other/c.jpg"><img src="https://scontent/d.jpg">',
    6: "<h1>Short title <a href='#'> Flats &amp; <b>Rooms</b> </a></h1>",
    7: "<h1> ab </h1>", 8: "<h1>abc</h1>", 9: "<p>none</p>", 10: "<h1><span>In span</span> tail</h1>",
}


def test_page_extraction(spark):
    pages = spark.createDataFrame(list(PAGES.items()), "page_id long, html string")
    rows = {r.page_id: r for r in pages.select(
        "page_id", html.post_link(F.col("html")).alias("link"), html.image_sources(F.col("html")).alias("images"),
        html.page_title(F.col("html")).alias("title")).collect()}
    assert [rows[i].link for i in (1, 2, 3, 4)] == ["https://s/posts/9", "https://s/permalink/5/", "https://s/story.php", None]
    assert rows[5].images == ["https://scontent/a.jpg", "https://scontent/d.jpg"] and rows[4].images == []
    assert [rows[i].title for i in range(5, 11)] == [None, "Flats & Rooms", None, "abc", None, "In span"]
    links = html.page_links(pages).collect()
    assert [(r.page_id, r.position) for r in links if r.page_id == 1] == [(1, 1), (1, 2)]
    groups = spark.createDataFrame([("u1", "Old"), ("u2", None)], "url string, name string")
    found = spark.createDataFrame([("u1", PAGES[8]), ("u2", PAGES[5])], "url string, html string")
    assert sorted(html.with_titles(groups, found).collect(), key=str) == [Row("u1", "abc"), Row("u2", None)]


def test_tags_of_real_pages(spark):
    many = " ".join(f'data-{i}="{i}"' for i in range(100_000))
    pages = {
        1: """<a title="a > b" href="/posts/1">x</a>""", 2: "<a href=/posts/2>x</a>", 3: "<A data-href='/posts/0' HREF = '/posts/3?a=1&amp;b=2'>x</A>",
        4: f"<a {many} href='/posts/4'>x</a>", 5: "<!-- <a href='/posts/0'> --><script>'<a href=/posts/0>'</script><a href='/posts/5&amp;c'>x</a>",
        6: "<abbr href='/posts/0'></abbr><a disabled href='/posts/6' href='/posts/7'>x</a>", 7: "<a title='href=/posts/0' class=b>x</a>", 8: "<a href='/posts/8",
        9: "<h1 title='a > b'>Caf&eacute; &#8211; A&nbsp;b</h1><img alt='>' src=//scontent/x.jpg?a=1&amp;b><img/src='scontent/y'>", 10: None,
    }
    table = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    rows = {r.page_id: r for r in table.select(
        "page_id", html.post_link(F.col("html")).alias("link"), html.image_sources(F.col("html")).alias("images"),
        html.page_title(F.col("html")).alias("title")).collect()}
    assert [rows[i].link for i in range(1, 9)] == [
        "/posts/1", "/posts/2", "/posts/3", "/posts/4", "/posts/5&c", "/posts/6", None, None]
    assert rows[9].images == ["//scontent/x.jpg?a=1&b", "scontent/y"] and rows[9].title == "Café – A b"


def test_groups_file(spark, tmp_path):
    path = tmp_path / "groups.yaml"
    path.write_text("groups:\n  - url: https://g.example/1\n  - url: 'https://g.example/2'\n    name: Flats\n")
    rows = tables.read_groups(spark, str(path)).orderBy("group_id").collect()
    assert rows == [Row(0, "https://g.example/1", None), Row(1, "https://g.example/2", "Flats")]


def test_boundary_and_json_files(spark, tmp_path):
    rows = catalogue.listings(spark, SF).drop("group_id").limit(50).cache()
    back = tables.from_boundary(tables.to_boundary(rows))
    full = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("amenities", "images")})
    assert full.exceptAll(back).isEmpty()
    tables.write_json(rows, str(tmp_path / "lines"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "lines")).exceptAll(rows).isEmpty()
    (tmp_path / "array.json").write_text(json.dumps([{"id": 1, "raw_text": "caf\u00e9"}, {"id": 2}]))
    assert [r.id for r in tables.read_json_array(spark, str(tmp_path / "array.json")).collect()] == [1, 2]
    tables.write_listings(rows, str(tmp_path / "table"))
    assert tables.read_listings(spark, str(tmp_path / "table")).count() == 50
    pairs = corpus.training_pairs(rows)
    tables.write_training_pairs(pairs, str(tmp_path / "pairs"))
    tables.write_chat(corpus.chat_turns(pairs), str(tmp_path / "chat"))
    assert spark.read.json(str(tmp_path / "pairs")).columns == ["completion", "prompt"]
    assert spark.read.json(str(tmp_path / "chat")).columns == ["messages"]


def test_reextraction_keeps_what_the_model_said(spark):
    rows = catalogue.listings(spark, SF).drop("group_id").limit(3).cache()
    ids = sorted(r.id for r in rows.collect())
    said = ['{"amenities": ["rooftop bar", "lift"], "rent": "900", "bhk": 0, "location": false}',
            '{"amenities": "lift", "rent": "12-14k", "sqft": "1100", "gated_community": "no"}', "{}"]
    answers = spark.createDataFrame(list(zip(ids, said)), "post_id long, raw_output string")
    a, b = jobs.reextract(rows, answers).orderBy("id").collect()
    assert (a.amenities, a.rent, a.bhk, a.location) == (["rooftop bar", "lift"], 900, "0", "false")
    assert (b.amenities, b.rent, b.sqft, b.gated_community) == (["lift"], None, 1100, False)


def test_run_counters_tell_the_total_from_posts_without_group(spark):
    parsed = spark.createDataFrame([(None, True), (None, True), (1, True), (1, False)], "group_id int, parsed_ok boolean")
    new = spark.createDataFrame([(None,), (1,)], "group_id int")
    got = {(r.is_total, r.group_id): (r.parsed, r.new, r.failed) for r in stats.run_counters(parsed, new).collect()}
    assert got == {(0, None): (2, 1, 0), (0, 1): (1, 1, 1), (1, None): (3, 2, 1)}


def test_publish_only_with_results(spark, tmp_path):
    rows = catalogue.listings(spark, SF).limit(3)
    none = spark.createDataFrame([(0, "{}"), (1, "nothing")], "post_id long, raw_output string")
    assert jobs.publish_reextracted(rows, none, str(tmp_path / "new")) is False
    some = rows.limit(1).select(F.col("id").alias("post_id"), F.lit('{"rent": 9000}').alias("raw_output"))
    assert jobs.publish_reextracted(rows, some, str(tmp_path / "new")) is True
    assert spark.read.parquet(str(tmp_path / "new")).first().rent == 9000


def test_published_listings_are_renewed_as_a_whole(spark, tmp_path, monkeypatch):
    rows = catalogue.listings(spark, SF).limit(3).cache()
    stored, renewed = str(tmp_path / "stored"), str(tmp_path / "renewed")
    versions.publish(rows.withColumn("listing_type", F.lit("old")), stored)
    assert jobs.backfill_published(spark, stored)
    assert {r.listing_type for r in versions.read_published(spark, stored).collect()} == {r.listing_type for r in rows.collect()}
    none = spark.createDataFrame([(-1, "{}")], "post_id long, raw_output string")
    assert not jobs.publish_renewed(rows, none, renewed)
    some = rows.limit(1).select(F.col("id").alias("post_id"), F.lit('{"rent": 9000}').alias("raw_output"))
    assert jobs.publish_renewed(rows, some, renewed)

    def broken(*_):
        raise OSError("no space")

    # A failure after the rows and before the pointer leaves the old table.
    monkeypatch.setattr(versions.Versions, "publish", broken)
    with pytest.raises(OSError):
        jobs.publish_renewed(rows, some.withColumn("raw_output", F.lit('{"rent": 8000}')), renewed)
    assert versions.read_published(spark, renewed).first().rent == 9000
