"""Importing this module files all queries of the subpackage."""

from tradebook.llm import (  # noqa: F401  (importing files the queries)
    bytebpe,
    chat,
    decontamination,
    filteraudit,
    langid,
    lzprint,
    neighbours,
    packing,
    sharding,
    simhash,
    suffixdedup,
    tokencount,
    vectorcodes,
)
from tradebook.llm.book import ORACLES, QUERIES  # noqa: F401
