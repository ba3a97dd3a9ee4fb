"""All registered queries of this package."""

from veridoc.llm.registry import QUERIES, SQL  # noqa: F401
from veridoc.llm import q_dedup, q_divergence, q_fixity, q_html, q_language, q_mixing, q_quotes, q_sampling  # noqa: F401
from veridoc.llm import q_sharding, q_simhash, q_tokens, q_vectors  # noqa: F401
