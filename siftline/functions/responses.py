"""Reading model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.config import CLASS, ID, REASON, SCORE

RECORDS_SCHEMA = f"array<struct<{ID}:string,{SCORE}:string,{CLASS}:string,{REASON}:string>>"

# Stands behind a response to see that all of it was read.
END_MARK = "-- end of response --"

FENCE = "```"
JSON_FENCE = FENCE + "json"


# All characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _strip(text: Column) -> Column:
    """Drop white space, line breaks included, at both ends. ``trim`` only drops blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_fence(response: Column) -> Column:
    """Text inside the first code fence; a json fence is preferred; unfenced text as it is."""
    fenced_json = F.split_part(
        F.split_part(response, F.lit(JSON_FENCE), F.lit(2)), F.lit(FENCE), F.lit(1)
    )
    fenced = F.split_part(response, F.lit(FENCE), F.lit(2))
    return _strip(
        F.when(F.contains(response, F.lit(JSON_FENCE)), fenced_json)
        .when(F.contains(response, F.lit(FENCE)), fenced)
        .otherwise(response)
    )


def parse_scores(text: Column) -> Column:
    """Records of a JSON list of objects; NULL for any other text.

    As lenient as Python's reader: of a repeated key the last value counts, and ``NaN`` and
    infinities are numbers. Wrapping the text in brackets with a marked list behind it, and asking
    for exactly these two, rules out a top-level object and text after the list, which
    ``from_json`` alone accepts.
    """
    wrapped = F.concat(F.lit("["), text, F.lit(f',[{{"{ID}":"{END_MARK}"}}]]'))
    options = {"allowSingleQuotes": "false"}

    def read(controls: str) -> Column:
        return F.from_json(wrapped, f"array<{RECORDS_SCHEMA}>", {**options, "allowUnquotedControlChars": controls})

    # Raw line breaks inside strings are no JSON, but only drop the value they stand in: a second
    # reading that allows them then differs. In an array of one, the parsed lists are tested and
    # taken without parsing them again.
    good = F.filter(
        F.array(F.struct(read("false").alias("x"), read("true").alias("y"))),
        lambda r: r["x"].eqNullSafe(r["y"])
        & (F.size(r["x"]) == 2)
        & F.coalesce(F.get(F.get(r["x"], F.lit(1)), F.lit(0))[ID] == END_MARK, F.lit(False))
        & F.get(r["x"], F.lit(0)).isNotNull()
        & F.forall(F.get(r["x"], F.lit(0)), lambda v: v.isNotNull()),
    )
    return F.get(F.get(good, F.lit(0))["x"], F.lit(0))
