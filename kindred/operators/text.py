"""Records as text, and texts as fixed-length features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.cleaning import as_column
from kindred.operators.ranking import global_row_number

# fixed values: special tokens with their ids, ahead of the vocabulary
SPECIAL_TOKENS = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3}

# fixed value: a token is a run of letters, digits and underscores, or one other character
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def tagged(fields: dict[str, Column | str]) -> Column:
    """``COL name VAL value`` for every field."""
    parts = [F.concat(F.lit(f"COL {name} VAL "), as_column(c).cast("string")) for name, c in fields.items()]
    return F.concat_ws(" ", *parts)


def tagged_line(left: Column, right: Column, label: Column, sep: str = " \t ") -> Column:
    return F.concat(left, F.lit(sep), right, F.lit(sep), label.cast("int").cast("string"))


def all_but_first(df: DataFrame, skip: str = "id") -> Column:
    """Every column but the id, missing ones left out, joined by a space."""
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns if c != skip])


def with_fallback(name: str, description: str) -> Column:
    """Name and description, or the name alone without a description."""
    return F.when(F.col(description).isNull(), F.col(name)).otherwise(F.concat_ws(" ", name, description))


def dash_joined(*cols: str) -> Column:
    """``A - B - C`` with nothing in the place of a missing value."""
    return F.concat_ws(" - ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def tokenize(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(as_column(c)), F.lit(f"({TOKEN})"), F.lit(1))


def kept_lengths(a: Column, b: Column, room: int) -> tuple[Column, Column]:
    """How many tokens of each side stay when the longer one is cut until both fit ``room``.

    On equal lengths the second side is cut. Written without a loop: the first side keeps half
    the room (rounded up) or what the second leaves, whichever is more.
    """
    la, lb = F.size(a), F.size(b)
    half = (room + 1) // 2
    first = F.when(la + lb <= room, la).otherwise(F.least(la, F.greatest(F.lit(half), F.lit(room) - lb)))
    return first, F.when(la + lb <= room, lb).otherwise(F.lit(room) - first)


def truncate_pair(a: Column, b: Column, room: int) -> tuple[Column, Column]:
    ka, kb = kept_lengths(a, b, room)
    return F.slice(a, F.lit(1), ka), F.slice(b, F.lit(1), kb)


def vocabulary(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct tokens of the columns with ids that follow the special tokens, in token order."""
    tokens = df.select(F.explode_outer(F.concat(*[F.coalesce(tokenize(c), F.array().cast("array<string>")) for c in cols])).alias("token"))
    ranked = global_row_number(tokens.filter(F.col("token").isNotNull()).distinct(), "token", "_rank")
    return ranked.select("token", (F.col("_rank") - 1 + len(SPECIAL_TOKENS)).cast("int").alias("token_id"))


@dataclass(frozen=True)
class FeatureLayout:
    """Where the special tokens go and how the rest is filled."""

    max_length: int = 128
    cls_at_end: bool = False
    cls_segment: int = 1
    extra_sep: bool = False
    pad_left: bool = False
    pad_id: int = SPECIAL_TOKENS["[PAD]"]
    pad_segment: int = 0
    segment_a: int = 0
    segment_b: int = 1
    mask_real_as_one: bool = True


def label_id(label: Column | str, labels: list[str] | None) -> Column:
    """Index of the label in the list, an error for an unknown one; ``None`` → a number."""
    col = as_column(label)
    if labels is None:
        return col.cast("double")
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), col.cast("string"))
    unknown = F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(col.cast("string"), F.lit("null"))))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(unknown.cast("int"))


def pair_features(
    pairs: DataFrame,
    vocab: DataFrame,
    labels: list[str] | None,
    layout: FeatureLayout = FeatureLayout(),
    row_id: str = "id",
) -> DataFrame:
    """``text_a, text_b, label`` → ``input_ids, input_mask, segment_ids, label_id``.

    Texts are cut to fit before any token is looked up, so a pair never spreads to more than
    ``max_length`` rows.
    """
    none = F.array().cast("array<string>")
    a, b = F.coalesce(tokenize("text_a"), none), F.coalesce(tokenize("text_b"), none)
    cut = pairs.select(row_id, label_id("label", labels).alias("label_id"), a.alias("_a"), b.alias("_b"))
    alone = F.size("_b") == 0
    room_pair = layout.max_length - (4 if layout.extra_sep else 3)
    room_one = layout.max_length - (3 if layout.extra_sep else 2)
    ka, kb = truncate_pair(F.col("_a"), F.col("_b"), room_pair)
    cut = cut.select(
        row_id,
        "label_id",
        F.when(alone, F.slice("_a", 1, room_one)).otherwise(ka).alias("_a"),
        F.when(alone, none).otherwise(kb).alias("_b"),
    )
    sep = [F.lit("[SEP]")]
    first = F.concat(F.col("_a"), F.array(*sep * (2 if layout.extra_sep else 1)))
    second = F.when(F.size("_b") > 0, F.concat(F.col("_b"), F.array(*sep))).otherwise(none)
    cls, cls_seg = F.array(F.lit("[CLS]")), F.array(F.lit(layout.cls_segment))
    body = F.concat(first, second)
    segments = F.concat(
        F.array_repeat(F.lit(layout.segment_a), F.size(first)), F.array_repeat(F.lit(layout.segment_b), F.size(second))
    )
    tokens = F.concat(body, cls) if layout.cls_at_end else F.concat(cls, body)
    segments = F.concat(segments, cls_seg) if layout.cls_at_end else F.concat(cls_seg, segments)
    placed = cut.select(row_id, "label_id", tokens.alias("_tokens"), segments.alias("_segments"))

    special = F.create_map(*[F.lit(x) for kv in SPECIAL_TOKENS.items() for x in kv])
    # outer: there always is a token, and the plain form would add a filter that computes them again
    spread = placed.select(row_id, F.posexplode_outer("_tokens").alias("_at", "token"))
    # the special tokens of every pair have constant ids: they stay out of the join
    constant = special[F.col("token")]
    fixed = spread.filter(constant.isNotNull()).select(row_id, "_at", constant.alias("_id"))
    words = spread.filter(constant.isNull()).join(vocab, "token", "left")
    found = fixed.unionByName(words.select(row_id, "_at", F.coalesce("token_id", F.lit(SPECIAL_TOKENS["[UNK]"])).alias("_id")))
    ids = found.groupBy(row_id).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_id"))), lambda x: x["_id"]).alias("_ids")
    )
    whole = placed.join(ids, row_id)
    missing = F.lit(layout.max_length) - F.size("_ids")
    real, blank = (1, 0) if layout.mask_real_as_one else (0, 1)

    def padded(values: Column, filler: int) -> Column:
        fill = F.array_repeat(F.lit(filler), missing)
        return F.concat(fill, values) if layout.pad_left else F.concat(values, fill)

    return whole.select(
        row_id,
        padded(F.col("_ids"), layout.pad_id).alias("input_ids"),
        padded(F.array_repeat(F.lit(real), F.size("_ids")), blank).alias("input_mask"),
        padded(F.col("_segments"), layout.pad_segment).alias("segment_ids"),
        "label_id",
    )
