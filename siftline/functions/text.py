"""Text predicates of the keyword rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# Lists longer than this are looked up by an automaton.
LONG_LIST = 64


def normalize_text(col: Column, missing: str = "") -> Column:
    """Text as string, missing as ``missing``, lower-cased. No Unicode normalisation."""
    return F.lower(F.coalesce(col.cast("string"), F.lit(missing)))


def first_keyword(text: Column, phrases: Sequence[str]) -> Column:
    """First phrase, in list order, found anywhere in ``text``; NULL when there is none.

    A regular expression would give the leftmost hit in the text, which is another phrase
    whenever two phrases occur. Short lists are a chain in the JVM that stops at the first hit; its time
    grows with the list. Long ones are one automaton a task, which passes over each text once.
    """
    if not phrases:
        return F.lit(None).cast("string")
    if len(phrases) > LONG_LIST and find_spec("ahocorasick"):
        return _by_automaton(tuple(phrases))(text)
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases])


def _by_automaton(phrases: tuple[str, ...]):
    """Column function for ``first_keyword``. Nested, so that workers need no copy of this module."""

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        places: dict[str, int] = {}
        for k, phrase in enumerate(phrases):
            places.setdefault(phrase, k)
        # The empty phrase is in every text, so phrases behind it are never the first.
        last = places.pop("", len(phrases))
        automaton = ahocorasick.Automaton()
        for phrase, k in places.items():
            if k < last:
                automaton.add_word(phrase, k)
        automaton.make_automaton()
        some = len(automaton) > 0

        def first(text):
            if text is None:
                return None
            best = min((k for _, k in automaton.iter(text)), default=last) if some else last
            return phrases[min(best, last)] if min(best, last) < len(phrases) else None

        for batch in texts:
            yield pd.Series([first(t) for t in batch], dtype="object")

    return F.pandas_udf(find, "string")
