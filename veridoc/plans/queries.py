"""All registered queries, by area."""

from veridoc.plans.registry import QUERIES, SQL  # noqa: F401
from veridoc.plans import q_corpus, q_pairing, q_runs, q_text, q_words, q_masking, q_diff, q_blocks, q_campaign, q_compare, q_sources  # noqa: F401
