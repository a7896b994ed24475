"""Numeric tokens in running text, and their canonical form.

One scan finds the whole token; its parts are told apart by the signs it holds, as each can
stand in one place only. Digits are ASCII; runs of more than 28 digits are kept exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An opening bracket, a currency sign, a minus next to the digits, the digits, a closing bracket, a percent sign.
TOKEN = r"\(?\s*\$?\s*-?[0-9][0-9,]*(?:\.[0-9]+)?\s*\)?\s*%?"
#: What a token holds besides its digits and point.
DRESS = "()$,%- \t\n\x0b\f\r"
LEADER_LINE = r"(?md)^.*\.{5,}.*$"
LIST_MARK = r"(?md)^[ \t]*\([0-9][0-9]?\)(?=$|\s)"


def strip_furniture(text: Column) -> Column:
    """The text without table-of-contents lines and list marks at the heads of lines; patterns are tried only where their signs stand."""
    no_leaders = F.when(text.contains("....."), F.regexp_replace(text, LEADER_LINE, "")).otherwise(text)
    return F.when(text.contains("("), F.regexp_replace(no_leaders, LIST_MARK, "")).otherwise(no_leaders)


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def canonical(token: Column) -> Column:
    """Separators, currency and needless zeros go; a minus or both brackets make it negative; zero has no sign."""
    digits = F.translate(token, DRESS, "")
    whole = F.ltrim(F.substring_index(digits, ".", 1), F.lit("0"))
    whole = F.when(whole == "", "0").otherwise(whole)
    rest = F.when(digits.contains("."), F.rtrim(F.substring_index(digits, ".", -1), F.lit("0"))).otherwise("")
    plain = F.when(rest == "", whole).otherwise(F.concat_ws(".", whole, rest))
    negative = (token.contains("-") | (token.contains("(") & token.contains(")"))) & (plain != "0")
    return F.concat(F.when(negative, "-").otherwise(""), plain, F.when(token.contains("%"), "%").otherwise(""))


def with_canonical(tokens: DataFrame, raw: str, name: str) -> DataFrame:
    """The rows with ``raw`` replaced by its canonical form.

    Each step is a column of its own, so that none is computed anew where the next ones use it.
    """
    t = F.col(raw)
    digits = tokens.withColumn("_d", F.translate(t, DRESS, ""))
    whole = F.ltrim(F.substring_index("_d", ".", 1), F.lit("0"))
    rest = F.when(F.col("_d").contains("."), F.rtrim(F.substring_index("_d", ".", -1), F.lit("0"))).otherwise("")
    parts = digits.withColumn("_w", F.when(whole == "", "0").otherwise(whole)).withColumn("_f", rest).drop("_d")
    plain = parts.withColumn("_p", F.when(F.col("_f") == "", F.col("_w")).otherwise(F.concat_ws(".", "_w", "_f"))).drop("_w", "_f")
    negative = (t.contains("-") | (t.contains("(") & t.contains(")"))) & (F.col("_p") != "0")
    sign, unit = F.when(negative, "-").otherwise(""), F.when(t.contains("%"), "%").otherwise("")
    return plain.withColumn(name, F.concat(sign, "_p", unit)).drop(raw, "_p")


def numeric_tokens(text: Column) -> Column:
    """All canonical tokens of a text in order, page furniture left out; for large tables, explode and use ``with_canonical``."""
    return F.transform(raw_tokens(strip_furniture(text)), canonical)


def digits_only(token: Column) -> Column:
    """The token without its sign and percent sign, as it can be found in raw text."""
    return F.rtrim(F.ltrim(token, F.lit("-")), F.lit("%"))
