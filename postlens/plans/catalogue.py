"""Named queries over the given tables, each ``(spark, sf_dir) -> DataFrame``.

Results use portable types only, so that another engine can check them: numbers as
BIGINT or DOUBLE, flags as 0/1, times and arrays as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, html
from ..functions import fixed_values as fv
from ..functions.arrays import array_to_json, json_to_array
from ..functions.cards import cards
from ..functions.extract import FIELDS, extract_fields, extract_phone
from ..functions.predictions import decode_predictions, merge_predictions
from ..operators import corpus, dedupe, facets, ordering, saved, stats
from ..operators.near_copies import drop_near_copies, long_enough
from ..sources import fixture
from ..sources.scratch import new_folder
from ..sources.json_arrays import read_json_arrays
from ..sources.schemas import LISTINGS
from ..sources.tables import (
    attach_groups, from_boundary, read_groups, read_listings, spread, to_boundary, write_chat, write_json, write_listings,
    write_training_pairs,
)
from ..sources.versions import publish, read_published
from ..streaming import ingest as stream_ingest
from ..streaming import totals as stream_totals
from . import jobs

# Rows collected before this day count as stored already in the admission queries.
STORED_BEFORE = "1998-01-01"
HREF_NEEDLES = ("/the", "/de", "/und", "/The", "example")

FILTERS = {
    "filter_min_rent": {"min_rent": 15000},
    "filter_max_rent": {"max_rent": 12000},
    "filter_bhk": {"bhk": 2},
    "filter_furnished": {"furnished": "semi"},
    "filter_gated": {"gated_community": True},
    "filter_listing_type": {"listing_type": "flatmate"},
    "filter_food": {"food_preference": "any"},
    "filter_gender": {"gender_preference": "female"},
    "filter_gender_not": {"gender_preference": "not_female"},
    "filter_no_brokerage": {"no_brokerage": True},
    "filter_parking": {"parking": "car"},
    "filter_location": {"location": "KONDA"},
    "filter_location_wildcard": {"location": "hi_tech%y"},
    "filter_has_contact": {"has_contact": True},
    "filter_has_images": {"has_images": True},
    "filter_has_rent": {"has_rent": True},
    "filter_falsy": {"min_rent": 0, "bhk": "", "location": None},
}
WEB_ARGS = {"min_rent": "8000", "max_rent": "20000", "bhk": "2", "gender_preference": "not_male",
            "has_contact": "on", "parking": "car", "listing_type": ""}
COMMAND_ARGS = {"max_rent": 25000, "furnished": "semi", "veg": True, "no_broker": True, "has_contact": True}
# Short values for the normalisers, chosen by the order key.
SHORT_VALUES = ("Furnished", " semi ", "2 car", "bike", "two wheeler", "rk", "RK ", "2.5 BHK", "both", "unfurnished",
                "fully", "Car", "3", "", "none")
# JSON texts of arrays, whole and broken, chosen by the order key.
ARRAY_TEXTS = ('["a", "b"]', "[", "", '{"a": 1}', "[]", '["x", null]', "null", '["q\\"r"]', "plain words", '["a"')
FULL_WIDTH_DIGITS = "０１２３４５６７８９"
#: Rows of a landed file, about.
LANDED_ROWS = 20_000
#: Orders whose post fails, one in so many.
FAILING = 13
SHOWN = ("id", "bhk", "rent", "location", "furnished", "listing_type", "gender_preference")


# Tables whose rows take long to process, and a key to spread them by.
INPUT_TASKS = "spark.postlens.inputTasks"  # not set: the files' splits decide
SPREAD = {"orders": "o_orderkey", "documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get(INPUT_TASKS, None)
    return spread(rows, SPREAD[name], int(tasks)) if tasks and name in SPREAD else rows


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.posts_from_orders(table(spark, sf_dir, "orders"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.groups_from_orders(table(spark, sf_dir, "orders"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.to_listings(posts(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.predictions_from_posts(posts(spark, sf_dir))


def saved_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.saved_log_from_events(table(spark, sf_dir, "events"))


def saved_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved.fold_toggles(saved_log(spark, sf_dir))


def portable(df: DataFrame) -> DataFrame:
    def plain(name: str, kind: str) -> Column:
        col = F.col(name)
        if kind in ("int", "tinyint", "smallint"):
            return col.cast("bigint")
        if kind == "boolean":
            return col.cast("int").cast("bigint")
        if kind.startswith("timestamp"):
            return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        if kind == "array<string>":
            return F.array_join(col, "|")
        return col

    return df.select(*[plain(n, k).alias(n) for n, k in df.dtypes])


# ---------------------------------------------------------------- extraction


def _extract(field: str):
    def run(spark, sf_dir):
        return extract_fields(posts(spark, sf_dir)).select("post_id", field)

    return run


def _classes(column: str):
    def run(spark, sf_dir):
        return listings(spark, sf_dir).select("id", column)

    return run


def _normaliser(name: str, function):
    """The whole post text as a value to normalise."""

    def run(spark, sf_dir):
        return posts(spark, sf_dir).select("post_id", function(F.col("text")).alias(name))

    return run


def normalize_short_values(spark, sf_dir):
    """Values of one or two words, as a model or a form gives them."""
    orders = table(spark, sf_dir, "orders")
    values = F.array(*map(F.lit, SHORT_VALUES))
    picked = orders.select("o_orderkey", F.get(values, (F.col("o_orderkey") % len(SHORT_VALUES)).cast("int")).alias("v"))
    return picked.select(
        "o_orderkey",
        classify.normal_furnished(F.col("v")).alias("furnished"),
        classify.normal_parking(F.col("v")).alias("parking"),
        classify.normal_bhk(F.col("v")).alias("bhk"),
    )


def extract_all(spark, sf_dir):
    return extract_fields(posts(spark, sf_dir)).select("post_id", *FIELDS)


def enrich_listings(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "id", "bhk", "rent", "furnished", "parking", "listing_type", "food_preference",
        "gender_preference", "no_brokerage",
    )


def backfill(spark, sf_dir):
    stored = listings(spark, sf_dir).select("id", "raw_text", "furnished", "parking", "rent", "bhk")
    return jobs.backfill(stored)[0].drop("raw_text")


def backfill_count(spark, sf_dir):
    return jobs.backfill(listings(spark, sf_dir))[1]


def contact_in_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extract_fields(documents).select("doc_id", "contact")


def phone_in_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", extract_phone(F.col("text")).alias("contact"))


def keywords_in_conversations(spark, sf_dir):
    low = "lower(text)"
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        classify.listing_type(low).alias("listing_type"),
        classify.gender_preference(low).alias("gender_preference"),
        classify.no_brokerage(low).alias("no_brokerage"),
    )


def long_documents(spark, sf_dir):
    documents = long_enough(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", F.char_length("text").alias("chars"))


def extract_styled_digits(spark, sf_dir):
    """Digits written in bold or in full width count as digits."""
    plain, key = "0123456789", F.col("post_id") % 3
    styled = F.when(key == 0, F.translate("text", plain, fv.BOLD_DIGITS)).when(
        key == 1, F.translate("text", plain, FULL_WIDTH_DIGITS)
    ).otherwise(F.col("text"))
    return extract_fields(posts(spark, sf_dir).withColumn("text", styled)).select("post_id", *FIELDS)


# ---------------------------------------------------------------- predictions


def repeated_keys(spark, sf_dir):
    """Answers that name a key twice: the last value counts."""
    key = F.col("o_orderkey")
    said = F.format_string(
        'ok {"bhk": %d, "floor": "%d", "rent": 9000, "bhk": "%d", "rent": %d, "floor": null} end',
        key % 4, key % 9, key % 5 + 1, 5000 + key % 100 * 100,
    )
    answers = table(spark, sf_dir, "orders").select(key.alias("post_id"), said.alias("raw_output"))
    return decode_predictions(answers).select("post_id", "model_bhk", "model_rent", "model_floor", "model_empty")


def decoded_predictions(spark, sf_dir):
    return decode_predictions(predictions(spark, sf_dir)).select(
        "post_id", "model_bhk", "model_rent", "model_deposit", "model_sqft", "model_location",
        "model_gated_community", "model_furnished", "model_available_from", "model_floor",
        "model_parking", "model_facing", "model_maintenance", "model_lease_duration",
        "model_amenities", "model_empty",
    )


def merged_fields(spark, sf_dir):
    extracted = extract_fields(posts(spark, sf_dir))
    return merge_predictions(extracted, predictions(spark, sf_dir)).select("post_id", *FIELDS)


def merged_listings(spark, sf_dir):
    rows = jobs.to_listings(posts(spark, sf_dir), predictions=predictions(spark, sf_dir))
    return rows.select("id", "bhk", "rent", "furnished", "parking", "location", "gated_community",
                       "available_from", "listing_type", "food_preference")


def merged_admission(spark, sf_dir):
    rows = jobs.ingest(posts(spark, sf_dir), predictions=predictions(spark, sf_dir))
    return rows.select("id", "contact", "bhk", "location")


def published_renewal(spark, sf_dir):
    """A published table is backfilled in place; what is re-extracted from it is published."""
    stored, renewed = (f"{new_folder(spark, 'published')}/{name}" for name in ("listings", "renewed"))
    publish(listings(spark, sf_dir), stored)
    jobs.backfill_published(spark, stored)
    jobs.publish_renewed(read_published(spark, stored), predictions(spark, sf_dir), renewed)
    return read_published(spark, renewed).select(
        "id", "bhk", "rent", "location", "furnished", "available_from", "contact", "amenities"
    )


def reextracted(spark, sf_dir):
    rows = jobs.reextract(listings(spark, sf_dir), predictions(spark, sf_dir))
    return rows.select("id", "bhk", "rent", "location", "furnished", "available_from", "contact", "amenities")


# ---------------------------------------------------------------- search


def _filter(filters: dict):
    def run(spark, sf_dir):
        return facets.filter_listings(listings(spark, sf_dir), **filters).select(*SHOWN)

    return run


def stored_search(spark, sf_dir):
    """Search over a stored table: extraction runs once, when the table is written."""
    path = new_folder(spark, "stored-search") + "/listings"
    write_listings(listings(spark, sf_dir).drop("group_id"), path)
    return facets.filter_listings(read_listings(spark, path), bhk=2, has_rent=True).select(*SHOWN)


def json_listings(spark, sf_dir):
    """Search over listings written as JSON lines."""
    path = new_folder(spark, "json-listings")
    write_json(listings(spark, sf_dir).drop("group_id"), path)
    return facets.filter_listings(spark.read.schema(LISTINGS).json(path), bhk=2, has_rent=True).select(*SHOWN)


def json_arrays(spark, sf_dir):
    """Search over listings written as JSON arrays of some thousand each, several a file."""
    path = new_folder(spark, "json-arrays")
    rows = listings(spark, sf_dir).drop("group_id")
    one = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    arrays = rows.groupBy(F.floor(F.col("id") / 4096).alias("part")).agg(F.array_join(F.collect_list(one), ",\n").alias("members"))
    arrays.select(F.concat(F.lit("["), "members", F.lit("]")).alias("value")).write.text(path)
    return facets.filter_listings(read_json_arrays(spark, path, LISTINGS), bhk=2, has_rent=True).select(*SHOWN)


def facets_web(spark, sf_dir):
    return _filter(facets.web_filters(WEB_ARGS))(spark, sf_dir)


def facets_command(spark, sf_dir):
    return _filter(facets.command_filters(**COMMAND_ARGS))(spark, sf_dir)


def count_filtered(spark, sf_dir):
    return stats.count_listings(facets.filter_listings(listings(spark, sf_dir), bhk=2, has_rent=True))


def _top(sort_by: str, limit: int, offset: int = 0):
    def run(spark, sf_dir):
        best = ordering.top_listings(listings(spark, sf_dir).select(*SHOWN, "created_at"), sort_by, limit, offset)
        return ordering.numbered(best, sort_by)

    return run


def _top_by_rank(sort_by: str, limit: int, offset: int):
    """Rows below an offset that is found by rank."""

    def run(spark, sf_dir):
        rows = listings(spark, sf_dir).select(*SHOWN, "created_at")
        return ordering.numbered(ordering.top_listings(rows, sort_by, limit, offset, shallow=0), sort_by)

    return run


def _page(number: int, shallow: int = ordering.SHALLOW):
    def run(spark, sf_dir):
        found = facets.filter_listings(listings(spark, sf_dir), bhk=2).select(*SHOWN, "created_at")
        rows, total, shown = ordering.page(found, number, "rent", shallow=shallow)
        return rows.withColumns({"total": F.lit(total), "page": F.lit(shown)})

    return run


def result_cards(spark, sf_dir):
    return cards(listings(spark, sf_dir))


def newest_matches(spark, sf_dir):
    """Newest distinct 2-BHK listings under 20,000 with a contact, by area."""
    fresh = dedupe.admit_new(listings(spark, sf_dir))
    found = facets.filter_listings(fresh, bhk=2, max_rent=20000, has_contact=True, location="n")
    best = ordering.top_listings(found.select(*SHOWN, "contact", "created_at"), "created_at", 50)
    return ordering.numbered(best, "created_at")


# ---------------------------------------------------------------- admission


def _split_by_day(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = listings(spark, sf_dir)
    earlier = F.col("scraped_at") < F.lit(STORED_BEFORE).cast("timestamp")
    return rows.where(~earlier), dedupe.admit_new(rows.where(earlier))


def dedupe_text(spark, sf_dir):
    return dedupe.unique_texts(listings(spark, sf_dir)).select("id", "raw_text")


def dedupe_triple(spark, sf_dir):
    return dedupe.unique_across_groups(listings(spark, sf_dir)).select("id", "contact", "bhk", "location")


def admit_new(spark, sf_dir):
    fresh, stored = _split_by_day(spark, sf_dir)
    return dedupe.admit_new(fresh, stored).select("id", "contact", "bhk", "location")


def copy_new(spark, sf_dir):
    fresh, stored = _split_by_day(spark, sf_dir)
    return jobs.copy_table(fresh, stored)[0].select("id", "raw_text")


def copy_counts(spark, sf_dir):
    fresh, stored = _split_by_day(spark, sf_dir)
    return jobs.copy_table(fresh, stored)[1]


def near_copies(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = drop_near_copies(documents, ["source"], order="doc_id")
    return kept.select("doc_id", "source")


def near_copies_posts(spark, sf_dir):
    kept = drop_near_copies(posts(spark, sf_dir), ["group_id"])
    return kept.select("post_id", "group_id")


# ---------------------------------------------------------------- counts


def dashboard(spark, sf_dir):
    return stats.stats(listings(spark, sf_dir))


def sync_report(spark, sf_dir):
    return stats.sync_report(listings(spark, sf_dir))


def run_counters(spark, sf_dir):
    return jobs.run_report(
        posts(spark, sf_dir),
        dedupe.admit_new(jobs.to_listings(posts(spark, sf_dir))).select("group_id"),
    )


def run_counters_failed(spark, sf_dir):
    """Posts without text fail, and their groups go on."""
    failing = posts(spark, sf_dir).withColumn("text", F.when(F.col("post_id") % FAILING != 0, F.col("text")))
    new = dedupe.admit_new(jobs.to_listings(failing.where(F.col("text").isNotNull())))
    return jobs.run_report(failing, new.select("group_id"))


def fill_rates(spark, sf_dir):
    return stats.fill_rates(extract_fields(posts(spark, sf_dir)))


# ---------------------------------------------------------------- saved items


def toggle_fold(spark, sf_dir):
    return saved_list(spark, sf_dir)


def toggle_fold_started(spark, sf_dir):
    """Toggles on top of a list that holds every buyer of the log already."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    before = events.groupBy(F.col("user_id").alias("listing_id")).agg(
        F.lit("bought").alias("note"), F.min("ts").alias("created_at")
    )
    return saved.fold_toggles(saved_log(spark, sf_dir), before)


def saved_listings(spark, sf_dir):
    return saved.saved_listings(listings(spark, sf_dir).select(*SHOWN), saved_list(spark, sf_dir))


def saved_flag(spark, sf_dir):
    return saved.with_saved_flag(listings(spark, sf_dir).select("id", "bhk"), saved_list(spark, sf_dir))


def saved_add(spark, sf_dir):
    views = table(spark, sf_dir, "events").where(F.col("event_type") != "click")
    additions = views.select(
        F.col("user_id").alias("listing_id"), F.col("event_type").alias("note"), F.col("ts").alias("created_at")
    )
    return saved.add_saved(saved_list(spark, sf_dir), additions, listings(spark, sf_dir).select("id"))


def saved_remove(spark, sf_dir):
    big = table(spark, sf_dir, "events").where(F.col("value") > 100)
    return saved.remove_saved(
        saved_list(spark, sf_dir), big.select(F.col("user_id").alias("listing_id"))
    )


def saved_remove_some(spark, sf_dir):
    third = table(spark, sf_dir, "events").where(F.col("user_id") % 3 == 0)
    return saved.remove_saved(
        saved_list(spark, sf_dir), third.select(F.col("user_id").alias("listing_id"))
    )


# ---------------------------------------------------------------- corpus


def training_pairs(spark, sf_dir):
    return corpus.training_pairs(listings(spark, sf_dir))


def chat_turns(spark, sf_dir):
    chats = corpus.chat_turns(corpus.training_pairs(listings(spark, sf_dir)))
    return chats.select("id", F.posexplode("messages").alias("turn", "m")).select("id", "turn", "m.role", "m.content")


def training_files(spark, sf_dir):
    path = new_folder(spark, "pairs")
    write_training_pairs(corpus.training_pairs(listings(spark, sf_dir)), path)
    return spark.read.schema("prompt string, completion string").json(path)


def chat_files(spark, sf_dir):
    path = new_folder(spark, "chats")
    write_chat(corpus.chat_turns(corpus.training_pairs(listings(spark, sf_dir))), path)
    chats = spark.read.schema("messages array<struct<role: string, content: string>>").json(path)
    return chats.select(F.posexplode("messages").alias("turn", "m")).select("turn", "m.role", "m.content")


def _training_ids(spark, sf_dir) -> DataFrame:
    return corpus.training_pairs(listings(spark, sf_dir)).select("id")


def split_ordered(spark, sf_dir):
    return corpus.split_ordered(_training_ids(spark, sf_dir))


def split_seeded(spark, sf_dir):
    return corpus.split_seeded(_training_ids(spark, sf_dir))


# ---------------------------------------------------------------- pages and tables


def page_links(spark, sf_dir):
    return html.page_links(table(spark, sf_dir, "pages"), HREF_NEEDLES)


def page_post_link(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", html.post_link(F.col("html"), HREF_NEEDLES).alias("link"))


def page_images(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", html.image_sources(F.col("html")).alias("images"))


def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


def post_groups(spark, sf_dir):
    named = attach_groups(posts(spark, sf_dir), groups(spark, sf_dir))
    return named.select("post_id", "group_name", "group_url", "scraped_at", "images", "post_url")


def boundary_form(spark, sf_dir):
    """Arrays to JSON text and back."""
    rows = listings(spark, sf_dir).select("id", array_to_json(F.col("amenities")).alias("as_text"))
    return rows.withColumn("as_array", json_to_array(F.col("as_text")))


def boundary_rows(spark, sf_dir):
    """Listings in row-store form; reading them back gives the flags and arrays again."""
    columns = ("amenities", "images", "gated_community", "no_brokerage")
    stored = to_boundary(listings(spark, sf_dir).select("id", *columns))
    back = from_boundary(stored).select("id", *[F.col(c).alias(f"{c}_back") for c in columns])
    return stored.join(back, "id")


def boundary_values(spark, sf_dir):
    """Whole and broken JSON texts read as arrays."""
    texts = F.array(*map(F.lit, ARRAY_TEXTS), F.lit(None))
    text = F.get(texts, (F.col("o_orderkey") % (len(ARRAY_TEXTS) + 1)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", json_to_array(text).alias("found"))


def groups_file(spark, sf_dir):
    """The group list as JSON lines."""
    path = new_folder(spark, "groups") + "/groups.json"
    groups(spark, sf_dir).write.json(path)
    return read_groups(spark, path).select("group_id", "url", "name")


def groups_yaml(spark, sf_dir):
    """The group list in its hand-kept form, entries in the order of their urls."""
    path = new_folder(spark, "groups") + "/groups.yaml"
    name = F.when(F.col("name").isNotNull(), F.concat(F.lit("\n    name: "), F.col("name"))).otherwise(F.lit(""))
    entry = F.concat(F.lit("  - url: "), F.col("url"), name)
    whole = F.concat(F.lit("groups:\n"), F.array_join(F.array_sort(F.collect_list(entry)), "\n"))
    groups(spark, sf_dir).agg(whole.alias("value")).write.text(path)
    return read_groups(spark, path).select("group_id", "url", "name")


# ---------------------------------------------------------------- streams


def _stream(spark, sf_dir, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _tasks(spark) -> int | None:
    tasks = spark.conf.get(INPUT_TASKS, None)
    return int(tasks) if tasks else None


def _in_batches(spark, rows: DataFrame, order: str, out: str, batches: int, start, form=None) -> None:
    """Land ``rows``, or what ``form`` makes of them, in so many parts in the given order.
    ``start(stream)`` begins a query over what has landed; with one checkpoint and all that is
    there, each part is one micro-batch, in as many files as its rows ask for.

    Rows are dealt out to the files before ``form`` makes texts of them."""
    form = form or (lambda part: part)
    low, high, count = rows.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    step = ((high or 0) - (low or 0)) // batches + 1
    files = count // (batches * LANDED_ROWS) + 1
    for k in range(batches):
        first = (low or 0) + k * step
        part = rows.where(F.col(order).between(first, first + step - 1))
        dealt = part.repartition(files, order) if files > 1 else part.coalesce(1)
        landing = form(dealt)
        landing.write.mode("append").parquet(f"{out}/landed")
        start(spark.readStream.schema(landing.schema).parquet(f"{out}/landed")).awaitTermination()


def stream_ingest_listings(spark, sf_dir):
    out = new_folder(spark, "stream-ingest")
    incoming = fixture.posts_from_orders(_stream(spark, sf_dir, "orders"))
    stream_ingest.start_ingest(incoming, f"{out}/listings", f"{out}/checkpoint", tasks=_tasks(spark)).awaitTermination()
    return spark.read.parquet(f"{out}/listings").select("id", "contact", "bhk", "location")


def stream_ingest_merged(spark, sf_dir):
    """Posts in four micro-batches, with predictions and both uniqueness rules."""
    out = new_folder(spark, "stream-merged")
    _in_batches(spark, table(spark, sf_dir, "orders"), "o_orderkey", out, 4, lambda incoming: stream_ingest.start_ingest(
        incoming, f"{out}/listings", f"{out}/checkpoint", predictions=predictions(spark, sf_dir), tasks=_tasks(spark)
    ), fixture.posts_from_orders)
    return spark.read.parquet(f"{out}/listings").select("id", "contact", "bhk", "location")


def stream_near_copies(spark, sf_dir):
    """Documents that survive the near-copy filter of their source, in two batches."""
    out = new_folder(spark, "stream-near")
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    near = stream_ingest.NearCopies(spark, f"{out}/documents", ["source"], order="doc_id", buckets=8)

    def batch(rows: DataFrame, batch_id: int) -> None:
        kept = near.filter(rows, "only", batch_id).select("doc_id", "source")
        kept.write.mode("overwrite").parquet(f"{out}/kept/batch_id={batch_id}")

    _in_batches(spark, documents, "doc_id", out, 2, lambda incoming: incoming.writeStream.foreachBatch(batch).option(
        "checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    return spark.read.parquet(f"{out}/kept").select("doc_id", "source")


def stream_unique_within(spark, sf_dir):
    """Texts that are unique within a horizon longer than the log, in three batches."""
    out = new_folder(spark, "stream-unique")
    rows = posts(spark, sf_dir).select("post_id", "text", F.col("scraped_at").cast("timestamp").alias("scraped_at"))
    _in_batches(spark, rows, "post_id", out, 3, lambda incoming: stream_ingest.unique_within(
        incoming, "10000 days").writeStream.format("parquet").option("path", f"{out}/unique").option(
        "checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    return spark.read.parquet(f"{out}/unique").select("text")


def stream_toggle(spark, sf_dir):
    out = new_folder(spark, "stream-toggle")
    log = fixture.saved_log_from_events(_stream(spark, sf_dir, "events"))
    stream_totals.start_toggles(log, f"{out}/state", f"{out}/checkpoint").awaitTermination()
    return stream_totals.saved_after_toggles(spark, f"{out}/state")


def stream_group_totals(spark, sf_dir):
    out = new_folder(spark, "stream-totals")
    incoming = fixture.posts_from_orders(_stream(spark, sf_dir, "orders"))
    stream_totals.start_group_totals(incoming, f"{out}/state", f"{out}/checkpoint").awaitTermination()
    return stream_totals.group_totals(spark, f"{out}/state")


def queries() -> dict:
    found = {f"extract_{field}": _extract(field) for field in FIELDS}
    found |= {
        "extract_all": extract_all,
        "classify_type": _classes("listing_type"),
        "classify_food": _classes("food_preference"),
        "classify_gender": _classes("gender_preference"),
        "classify_brokerage": _classes("no_brokerage"),
        "normalize_furnished": _normaliser("furnished", classify.normal_furnished),
        "normalize_parking": _normaliser("parking", classify.normal_parking),
        "normalize_rent_text": _normaliser("rent", classify.normal_rent_text),
        "normalize_bhk": _normaliser("bhk", classify.normal_bhk),
    }
    found |= {name: _filter(filters) for name, filters in FILTERS.items()}
    found |= {
        "top_rent": _top("rent", 50),
        "top_recent": _top("created_at", 20),
        "top_bhk": _top("bhk", 50, 25),
        "top_unknown_key": _top("shoe_size", 12),
        "page_3": _page(3),
        "page_beyond_last": _page(10**6),
        "page_last_by_rank": _page(10**6, shallow=0),
        "top_bhk_by_rank": _top_by_rank("bhk", 50, 1000),
        "top_recent_by_rank": _top_by_rank("created_at", 20, 700),
    }
    for function in (
        normalize_short_values, stored_search, enrich_listings, backfill, backfill_count, contact_in_documents, phone_in_documents,
        keywords_in_conversations, long_documents, decoded_predictions, merged_fields,
        merged_listings, merged_admission, reextracted, facets_web, facets_command, count_filtered,
        result_cards, newest_matches, dedupe_text, dedupe_triple, admit_new, copy_new, copy_counts,
        near_copies, near_copies_posts, dashboard, sync_report, run_counters, fill_rates, toggle_fold,
        toggle_fold_started, saved_listings, saved_flag, saved_add, saved_remove, training_pairs,
        chat_turns, split_ordered, split_seeded, page_links, page_post_link, page_images, page_title,
        post_groups, boundary_form, stream_ingest_listings, stream_ingest_merged, stream_near_copies,
        stream_toggle, stream_group_totals, extract_styled_digits, repeated_keys, json_listings, published_renewal,
        run_counters_failed, saved_remove_some, training_files, chat_files, boundary_rows, boundary_values, groups_file,
        groups_yaml, stream_unique_within, json_arrays,
    ):
        found[function.__name__] = function
    return {name: _ported(run) for name, run in found.items()}


def _ported(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(run(spark, sf_dir))

    return query


