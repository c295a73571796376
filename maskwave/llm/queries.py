"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversations import OP11_SQL, op11_conversations
from .decontaminate import OP4_SQL, op4_leaks
from .divergence import OP12_SQL, op12_divergence
from .html import op3_html
from .language import op9_language
from .media import op5_media
from .mixing import op10_mix
from .repeats import OP2_SQL, op2_repeats
from .secrets import op1_secrets, op1_sql
from .sharding import op13_sharding
from .simhash import op8_simhash
from .toxicity import op6_toxicity
from .urls import op7_sql, op7_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_repeats": op2_repeats,
    "op3_html": op3_html,
    "op4_leaks": op4_leaks,
    "op5_media": op5_media,
    "op6_toxicity": op6_toxicity,
    "op7_urls": op7_urls,
    "op8_simhash": op8_simhash,
    "op9_language": op9_language,
    "op10_mix": op10_mix,
    "op11_conversations": op11_conversations,
    "op12_divergence": op12_divergence,
    "op13_sharding": op13_sharding,
}
ORACLE_SQL: dict[str, str] = {"op1_secrets": op1_sql(), "op2_repeats": OP2_SQL, "op4_leaks": OP4_SQL, "op7_urls": op7_sql(), "op11_conversations": OP11_SQL, "op12_divergence": OP12_SQL}
