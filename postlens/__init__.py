"""Analytics over free-text rental posts on Spark.

All functions take and return DataFrames; see README.md for the overview.
"""

from .functions.cards import cards
from .functions.classify import enrich
from .functions.extract import extract_fields
from .functions.html import page_links
from .functions.predictions import merge_predictions
from .operators.corpus import chat_turns, split_ordered, split_seeded, training_pairs
from .operators.dedupe import admit_new, admit_new_two_keys, unique_across_groups, unique_texts
from .operators.facets import filter_listings
from .operators.near_copies import drop_near_copies
from .operators.ordering import numbered, page, top_listings
from .operators.saved import add_saved, fold_toggles, remove_saved, saved_listings, with_saved_flag
from .operators.stats import count_listings, fill_rates, run_counters, stats
from .plans.jobs import ingest, to_listings
from .session import session

__all__ = [
    "add_saved", "admit_new", "admit_new_two_keys", "cards", "chat_turns", "count_listings",
    "drop_near_copies", "enrich", "extract_fields", "fill_rates", "filter_listings", "fold_toggles",
    "ingest", "merge_predictions", "numbered", "page", "page_links", "remove_saved", "run_counters",
    "saved_listings", "session", "split_ordered", "split_seeded", "stats", "to_listings",
    "top_listings", "training_pairs", "unique_across_groups", "unique_texts", "with_saved_flag",
]
