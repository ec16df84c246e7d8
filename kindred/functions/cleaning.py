"""Null policies, normalisation and list/text conversions, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed value: the characters a text strip removes (Unicode white space and the four
# ASCII separators)
_SPACE = r"[\s\x1c-\x1f]"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space of every kind (``trim`` removes spaces only)."""
    return F.regexp_replace(as_column(c), rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapse_spaces(c: Column | str) -> Column:
    return strip(F.regexp_replace(as_column(c), rf"(?U){_SPACE}+", " "))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def fill_empty(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Nulls become ``''``; named columns of other types are cast to text first."""
    wanted = string_columns(df) if cols is None else cols
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in wanted})


def drop_null_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys))


def strip_lower(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Strip and lower-case every text column, leaving other types alone."""
    wanted = string_columns(df) if cols is None else cols
    return df.withColumns({c: F.lower(strip(c)) for c in wanted})


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    return df.filter(strip(col) != "")


def normalize_name(c: Column | str) -> Column:
    """Strip and lower; a missing name becomes the text ``nan``."""
    return F.lower(strip(F.coalesce(as_column(c).cast("string"), F.lit("nan"))))


def normalize_company_name(c: Column | str) -> Column:
    """Lower-case words only: punctuation removed, white space collapsed, missing → ``''``."""
    bare = F.regexp_replace(F.lower(strip(c)), rf"(?U)[^\w\s]", "")
    return F.coalesce(collapse_spaces(bare), F.lit(""))


def pair_key(left: Column | str, right: Column | str) -> tuple[Column, Column]:
    """The pair without its order, as two columns."""
    both = F.array_sort(F.array(as_column(left), as_column(right)))
    return both[0].alias("pair_lo"), both[1].alias("pair_hi")


def join_list(c: Column | str, sep: str = "; ") -> Column:
    return F.coalesce(F.array_join(as_column(c), sep), F.lit(""))


def split_list(c: Column | str, sep: str = "; ") -> Column:
    return F.split(as_column(c), literal_pattern(sep), -1)


def quote_list(c: Column | str) -> Column:
    """``'a'|'b'``; a missing list is ``Unknown``."""
    quoted = F.transform(as_column(c), lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.coalesce(F.array_join(quoted, "|"), F.lit("Unknown"))


def quote_list_text(c: Column | str) -> Column:
    return F.coalesce(as_column(c), F.lit("Unknown"))


def parse_list_literal(c: Column | str) -> Column:
    """Text holding a list literal → array; other text → one-element array; ``nan`` → null."""
    col = as_column(c)
    parsed = F.from_json(
        col,
        T.ArrayType(T.StringType()),
        {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"},
    )
    return F.when(col == "nan", None).when(col.startswith("["), parsed).otherwise(
        F.when(col.isNotNull(), F.array(col))
    )


def list_literal(c: Column | str) -> Column:
    """An array of text written as a list literal, e.g. ``['a', 'b']``."""

    def quoted(x: Column) -> Column:
        escaped = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        plain = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        double = F.concat(F.lit('"'), escaped, F.lit('"'))
        return F.when(x.contains("'") & ~x.contains('"'), double).otherwise(plain)

    return F.concat(F.lit("["), F.array_join(F.transform(as_column(c), quoted), ", ", "None"), F.lit("]"))


def match_text(*cols: Column | str, sep: str = "|") -> Column:
    """Columns joined into one text; a missing one shows as ``nan``."""
    parts = [F.coalesce(as_column(c).cast("string"), F.lit("nan")) for c in cols]
    return F.concat_ws(sep, *parts)


def first_letter(c: Column | str) -> Column:
    """First character, null for an empty text."""
    return F.nullif(F.substring(as_column(c), 1, 1), F.lit(""))


def first_filled(*cols: Column | str, default: str = "UNKNOWN") -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(as_column(c), F.lit("")) for c in cols], F.lit(default))


def label_first(df: DataFrame, label: str = "label") -> DataFrame:
    """Label column to the front; rows without a label dropped."""
    rest = [c for c in df.columns if c != label]
    return df.select(label, *rest).dropna(subset=[label])


def literal_pattern(text: str) -> str:
    """Regular expression that matches ``text`` itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
