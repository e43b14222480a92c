"""Expressions over user agents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgetide.functions import fixed_values as fixed


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the text has one of the words; plain searches, cheaper than a pattern.

    A word that holds another one of the list adds nothing and is left out.
    """
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return reduce(lambda a, b: a | b, [text.contains(w) for w in needed])


def client_class(user_agent: Column) -> Column:
    """mobile, tablet, desktop or other, in that order of precedence."""
    text = F.lower(user_agent)
    answer = F.when(user_agent.isNull(), F.lit("unknown"))
    for name, words in fixed.CLIENT_WORDS:
        answer = answer.when(contains_any(text, words), F.lit(name))
    return answer.otherwise(F.lit("other"))


def is_bot(user_agent: Column) -> Column:
    return F.coalesce(contains_any(F.lower(user_agent), fixed.BOT_WORDS), F.lit(False))
