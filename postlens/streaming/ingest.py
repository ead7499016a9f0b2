"""Incremental ingest of landed posts, and bounded duplicate removal on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedupe import admit_new, entering, text_key, triple_key
from ..operators.near_copies import (
    as_posts, gram_bits, head_marks, heads_in_texts, hits, long_enough, marks, marks_among, possible_heads, survivors,
)
from ..operators.skew import lookup_join
from ..plans.jobs import to_listings
from ..sources.schemas import POSTS
from ..sources.scratch import cut_lineage
from ..sources.versions import BucketIndex
from .runs import run_id

#: Buckets of an index.  A table keeps the number that it was begun with.
BUCKETS = 32
#: Posts that a task extracts, about.
TASK_ROWS = 20_000
KEYS = T.StructType([T.StructField("key", T.BinaryType())])
CORRUPT = "_corrupt_record"


def read_posts(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Landed JSON lines as a stream; lines that do not parse keep their text."""
    schema = T.StructType([*POSTS.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def _batch_path(table: str, run: str, batch_id: int) -> str:
    return f"{table.rstrip('/')}/run={run}/batch_id={batch_id}"


def _digest(key: Column) -> Column:
    return F.unhex(F.sha2(F.to_json(key), 256))


def key_index(spark: SparkSession, table: str, buckets: int = BUCKETS) -> BucketIndex:
    """Digests of the texts and of the triples of all rows of ``table``, beside it."""
    return BucketIndex(spark, table.rstrip("/") + "_keys", KEYS, ["key"], buckets)


def _not_stored(rows: DataFrame, index: BucketIndex, run: str, batch_id: int) -> DataFrame:
    """Rows whose text and whose triple are in no stored row."""
    if not index.settled(run, batch_id):
        return rows  # nothing is stored: no row is shuffled to look for it
    for key in (text_key(), triple_key()):
        # A row known by its id only never conflicts with another one.
        digest = F.when(key["kind"] != "row", _digest(key))
        keyed = rows.withColumn("_digest", digest)
        touched = index.touched(keyed.where("_digest IS NOT NULL"), "_digest")
        known = index.find(touched, run, batch_id).select(F.col("key").alias("_digest"))
        rows = keyed.join(known, "_digest", "left_anti").drop("_digest")
    return rows


def _keys() -> dict[str, Column]:
    """Digests of the keys of a row; NULL where it is known by its id only."""
    return {name: F.when(k["kind"] != "row", _digest(k)) for name, k in (("_text", text_key()), ("_triple", triple_key()))}


def _new_keys(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.explode(F.array("_text", "_triple")).alias("key")).where("key IS NOT NULL")


def _admit_two_keys(rows: DataFrame, index: BucketIndex, run: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Rows of a batch that enter when equal texts may have different triples, and their keys.

    Only keys are looked up and compared; ``rows(_row, _text, _triple, ...)``, numbered and
    with their :func:`_keys`, are joined once."""
    fresh = rows.select("_row", "id", "_text", "_triple")
    if index.settled(run, batch_id):
        for name in ("_text", "_triple"):
            touched = index.touched(fresh.where(F.col(name).isNotNull()), name)
            known = index.find(touched, run, batch_id).select(F.col("key").alias(name))
            fresh = cut_lineage(fresh.join(known, name, "left_anti"), "fresh-keys")
    # Half of a digest is enough to tell the keys of one batch from each other.
    half = [F.substring(name, 1, 16).alias(name) for name in ("_text", "_triple")]
    entered = cut_lineage(fresh.join(entering(fresh.select("id", *half)), "id", "left_semi"), "entered-keys")
    return rows.join(entered.select("_row"), "_row", "left_semi").drop("_row", "_text", "_triple"), entered


class NearCopies:
    """The near-copy filter across the batches of a run.

    Kept posts are stored with their winnowed grams, both by buckets.  A batch reads the
    grams that it shares and then the posts behind them, in both directions: stored heads
    in new texts, and new heads in stored texts.  What is left is filtered as one batch."""

    def __init__(self, spark: SparkSession, table: str, part: list[str], order: str = "post_id", buckets: int = BUCKETS):
        self.spark, self.path, self.part, self.order = spark, table.rstrip("/") + "_near", part, order
        self.buckets = buckets

    def filter(self, posts: DataFrame, run: str, batch_id: int) -> DataFrame:
        usable = cut_lineage(long_enough(posts), "batch-posts")
        new = as_posts(usable, self.part, self.order)
        new_heads = cut_lineage(head_marks(new), "new-heads")
        grams = BucketIndex(self.spark, self.path + "/grams", new_heads.schema, ["gram"], self.buckets)
        texts = BucketIndex(self.spark, self.path + "/posts", new.schema, ["node"], self.buckets)

        stored = bool(grams.settled(run, batch_id))
        marked = grams.find(grams.touched(marks(new)) if stored else [], run, batch_id)
        old_heads = marked.where("size > 0")
        known = gram_bits(new_heads.select("gram").unionByName(old_heads.select("gram")))
        found = cut_lineage(hits(new, known), "new-hits")
        known.destroy()
        own = cut_lineage(possible_heads(found, new_heads), "candidates")
        live = new.select("part", "head", "node")
        if stored:
            dropped = cut_lineage(self._known_copies(live, new_heads, found, marked, texts, run, batch_id), "known-copies")
            live = cut_lineage(live.join(dropped, "node", "left_anti"), "live-posts")
            own = own.join(dropped, "node", "left_anti")
        inside = cut_lineage(lookup_join(own, live.select("part", "head").distinct(), ["part", "head"]), "heads")
        ids = survivors(live, inside).withColumnRenamed("node", self.order)
        kept = cut_lineage(usable.join(ids, self.order, "left_semi"), "kept-posts")
        left = as_posts(kept, self.part, self.order)
        grams.append(marks(left), run, batch_id)
        texts.append(left, run, batch_id)
        return kept

    def _known_copies(self, live: DataFrame, new_heads: DataFrame, found: DataFrame, marked: DataFrame,
                      texts: BucketIndex, run: str, batch_id: int) -> DataFrame:
        """Nodes of the new posts that a stored post makes a near-copy.

        ``found`` are the :func:`hits` of the new texts, ``marked`` the stored grams."""
        old_heads = cut_lineage(
            marked.where("size > 0").join(found.select("gram").distinct(), "gram", "left_semi"), "old-heads"
        )
        known = gram_bits(new_heads)
        shared = cut_lineage(
            marks_among(marked, known).join(new_heads.select("gram").distinct(), "gram", "left_semi"), "old-marks"
        )
        known.destroy()
        behind = texts.find(texts.touched(shared.select("node").distinct(), "node"), run, batch_id)
        held = heads_in_texts(shared, behind, new_heads)
        nodes = old_heads.select("node").distinct()
        old = texts.find(texts.touched(nodes, "node"), run, batch_id).join(nodes, "node", "left_semi").select("part", "head")
        # A new post may begin with a stored head, or hold it further on.
        holding = possible_heads(found.withColumn("own_head", F.lit("")), old_heads).join(old.distinct(), ["part", "head"])
        return holding.select("node").unionByName(live.join(held, ["part", "head"], "left_semi").select("node")).distinct()


def _reason(batch: DataFrame) -> Column:
    """Why a row cannot become a listing; NULL for good rows."""
    broken = F.col(CORRUPT).isNotNull() if CORRUPT in batch.columns else F.lit(False)
    return (
        F.when(broken, "not a JSON object").when(F.col("post_id").isNull(), "no id").when(F.col("text").isNull(), "no text")
    )


def start_ingest(
    posts: DataFrame,
    table: str,
    checkpoint: str,
    groups: DataFrame | None = None,
    predictions: DataFrame | None = None,
    near_copies_within: list[str] | None = None,
    quarantine: str | None = None,
    after_batch: Callable[[DataFrame, int], None] | None = None,
    tasks: int | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Extract, admit and append each micro-batch of a post stream; ends when all is read.

    Batch after batch this gives what the sequential rule gives for the whole stream: a
    post is dropped as a near-copy of an earlier kept one of its part, and a listing
    enters unless an earlier one that entered has its text or its triple.  Uniqueness has
    no time limit, so it is looked up in an index of stored keys, of which a batch reads
    the buckets that it needs, and not in stream state.  With ``predictions`` equal texts
    may have different triples, and both rules are settled together inside the batch.

    Rows that cannot become listings go to ``quarantine`` with the reason and their group;
    the others go on.  A batch writes into folders of its own and replaces them when it
    runs again.  ``tasks`` deals out a batch whose files are few and small; ``buckets`` is
    the size of the indexes, for a new table: take so many that one is a few megabytes.
    """
    name = run_id(posts.sparkSession, checkpoint)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if tasks:
            batch = batch.repartition(tasks)
        reason = _reason(batch)
        if quarantine or CORRUPT in batch.columns:
            # Read once; a part that is lost is read again from the landed files.
            batch = batch.persist()
        if quarantine:
            kept = [c for c in ("group_id", "post_id", CORRUPT) if c in batch.columns]
            bad = batch.withColumn("reason", reason).where("reason IS NOT NULL").select("reason", *kept)
            bad.write.mode("overwrite").parquet(_batch_path(quarantine, name, batch_id))
        good = batch.where(reason.isNull()).drop(CORRUPT)
        if near_copies_within:
            good = NearCopies(spark, table, near_copies_within, buckets=buckets).filter(good, name, batch_id)
        index = key_index(spark, table, buckets)
        said = predictions
        if said is not None:
            # Answers to ids beyond those of the batch are not even shuffled.
            *ends, count = batch.agg(F.min("post_id"), F.max("post_id"), F.count(F.lit(1))).first()
            said = said.where(F.col("post_id").between(*map(F.lit, ends)))
            # Texts take long for their size, so that their number tells how many tasks they are worth.
            good = good.repartition(max(tasks or 1, count // TASK_ROWS + 1), "post_id")
        listings = to_listings(good, groups, said)
        if predictions is None:
            admitted, keys = admit_new(_not_stored(cut_lineage(listings, "batch-listings"), index, name, batch_id)), None
        else:
            keyed = listings.withColumns(_keys() | {"_row": F.monotonically_increasing_id()})
            admitted, keys = _admit_two_keys(cut_lineage(keyed, "batch-listings"), index, name, batch_id)
        admitted.write.mode("overwrite").parquet(_batch_path(table, name, batch_id))
        # Read back: the keys are those of the rows that were written.
        written = spark.read.schema(admitted.schema).parquet(_batch_path(table, name, batch_id))
        index.append(_new_keys(written.withColumns(_keys()) if keys is None else keys), name, batch_id)
        if after_batch:
            after_batch(written, batch_id)
        batch.unpersist()

    return (
        posts.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def quarantined(spark: SparkSession, quarantine: str) -> DataFrame:
    """Failed rows per group and reason."""
    rows = spark.read.parquet(quarantine)
    group = F.col("group_id") if "group_id" in rows.columns else F.lit(None).cast("int")
    return rows.groupBy(group.alias("group_id"), "reason").agg(F.count("*").alias("failed"))


def unique_within(posts: DataFrame, horizon: str, text: str = "text") -> DataFrame:
    """Exact text uniqueness on a stream for as long as ``horizon`` (for example "30 days").

    State is bounded by the horizon; use :func:`start_ingest` for uniqueness without limit.
    """
    return (
        posts.withColumn("_digest", F.sha2(text, 256))
        .withWatermark("scraped_at", horizon)
        .dropDuplicatesWithinWatermark(["_digest"])
        .drop("_digest")
    )
