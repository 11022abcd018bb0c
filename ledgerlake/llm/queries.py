"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from ledgerlake.llm.bwt_dedup import op8_suffix_dedup
from ledgerlake.llm.chat import SQL as CHAT_SQL
from ledgerlake.llm.chat import op7_chat
from ledgerlake.llm.decontaminate import op2_decontaminate
from ledgerlake.llm.html_text import op9_html_text
from ledgerlake.llm.licenses import SQL as LICENSE_SQL
from ledgerlake.llm.licenses import op4_licenses
from ledgerlake.llm.mixing import op6_mixing
from ledgerlake.llm.quality_rules import op10_quality_rules
from ledgerlake.llm.simhash import op5_simhash
from ledgerlake.llm.token_store import op3_token_store
from ledgerlake.llm.toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_decontaminate,
        op3_token_store,
        op4_licenses,
        op5_simhash,
        op6_mixing,
        op7_chat,
        op8_suffix_dedup,
        op9_html_text,
        op10_quality_rules,
    )
}
ORACLE_SQL: dict[str, str] = {"op4_licenses": LICENSE_SQL, "op7_chat": CHAT_SQL}
