"""Document fingerprints by winnowing, in DataFrame operations only.

A text is read as units: runs of up to 16 characters without white space, and single ideographs and kana, whose
scripts do not part words. The hash of ``k`` following units is the rolling polynomial

    h(i + 1) = ((h(i) - c(i) * BASE^(k-1)) * BASE + c(i + k)) mod MODULUS

over 60-bit codes c of the units. As SQL arrays have no running state, the same values are computed for all
positions at once by doubling: the hashes of 2m units come from two hashes of m units. From every window of
``window`` following hashes the smallest is chosen, of equal ones the rightmost; a fingerprint is the chosen
hashes with their positions (numbers of their first units), each position once. So two texts that share
``window + k - 1`` following units share a hash, and hashes depend on nothing farther away than that.

Minima are taken by doubling too: hash and position are one number, the hash in front and later positions
smaller, so the least of two numbers is the rightmost smallest hash. A text is worked through in stretches of
``STRETCH`` positions, each read with the neighbours its windows need, so what is held besides the units
themselves does not grow with the text.

Defined results: a null text is the empty text; a text without units has the empty fingerprint, and two empty
fingerprints are alike (1.0); a text of fewer than ``k`` units has one hash over all of them, one with fewer
hashes than a window has one window. Equal texts have equal fingerprints. Repeated rows give repeated results,
an empty table an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.ranking import global_row_number
from kindred.session import cut_lineage

K, WINDOW = 5, 16
STRETCH = 4096
UNIT_CHARS = 16
# Scripts whose words are not parted by white space: kana, ideographs.
_SINGLE = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
UNIT = rf"[{_SINGLE}]|[^\x20\x09-\x0D{_SINGLE}]{{1,{UNIT_CHARS}}}"
# The largest prime below 2^47, so that 15 bits are left for a position; the base is small, so products fit 63 bits.
MODULUS = 140737488355213
BASE = 13
_POSITION_BITS = 16
_LAST = (1 << _POSITION_BITS) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _with_later(items: Column, by: int, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` of every item and the one ``by`` places later, as far as there is one."""
    return F.zip_with(
        F.slice(items, 1, F.greatest(F.size(items) - by, F.lit(0))), F.slice(items, by + 1, F.greatest(F.size(items) - by, F.lit(0))), combine
    )


def _doublings(n: int) -> list[int]:
    """How far to look ahead, step by step, so that spans of one item become spans of ``n``."""
    steps, span = [], 1
    while span < n:
        steps.append(min(span, n - span))
        span += steps[-1]
    return steps


def unit_codes(text: Column) -> Column:
    """A code below 2^60 for every unit of a text."""
    units = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(UNIT), F.lit(0))
    return F.transform(units, lambda u: F.conv(F.substring(F.md5(u), 1, 15), 16, 10).cast("long") % MODULUS)


def rolling_hashes(codes: Column, k: int) -> Column:
    """The hash of every ``k`` following codes; of all codes where there are fewer, none where there is none."""

    def span(hashes: Column, size: int) -> Column:
        """From hashes of ``size`` units to those of ``k``."""
        if size == k:
            return hashes
        if 2 * size <= k:
            factor = pow(BASE, size, MODULUS)
            doubled = _with_later(hashes, size, lambda a, b: (a * factor + b) % MODULUS)
            return _let(doubled, lambda h: span(h, 2 * size))
        # the last units one by one: what is left is smaller than a doubling
        rest = k - size
        wider = hashes
        for j in range(rest):
            wider = F.zip_with(
                F.slice(wider, 1, F.greatest(F.size(codes) - (size + j), F.lit(0))),
                F.slice(codes, size + j + 1, F.greatest(F.size(codes) - (size + j), F.lit(0))),
                lambda a, c: (a * BASE + c) % MODULUS,
            )
        return wider

    whole = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * BASE + c) % MODULUS)
    return F.when(F.size(codes) == 0, F.array().cast("array<long>")).when(F.size(codes) < k, F.array(whole)).otherwise(span(codes, 1))


def _chosen(hashes: Column, window: int) -> Column:
    """The numbers (hash, position) that are the least of a window; ascending positions, each once."""
    numbered = F.transform(hashes, lambda h, i: h * (_LAST + 1) + (F.lit(_LAST) - i))

    def least(items: Column, steps: list[int]) -> Column:
        if not steps:
            return F.array_distinct(items)
        return _let(_with_later(items, steps[0], lambda a, b: F.least(a, b)), lambda x: least(x, steps[1:]))

    return _let(
        numbered,
        lambda n: F.when(F.size(n) <= window, F.array(F.array_min(n))).otherwise(least(n, _doublings(window))),
    )


def _fingerprint_of_codes(codes: Column, k: int, window: int) -> Column:
    last = F.greatest(F.size(codes) - k, F.lit(0))  # position of the last hash

    def stretch(j: Column) -> Column:
        begin = F.greatest(j * STRETCH - (window - 1), F.lit(0))
        until = (j + 1) * STRETCH + (window - 1) + (k - 1)
        chosen = _let(F.slice(codes, begin + 1, until - begin), lambda c: _let(rolling_hashes(c, k), lambda h: _chosen(h, window)))
        placed = F.transform(
            chosen,
            lambda x: F.struct(
                F.shiftright(x, _POSITION_BITS).alias("hash"),
                (begin + F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST).cast("long"))).cast("int").alias("position"),
            ),
        )
        # a position belongs to one stretch, which sees all windows that hold it
        return F.filter(placed, lambda p: (p["position"] >= j * STRETCH) & (p["position"] < (j + 1) * STRETCH))

    stretches = F.sequence(F.lit(0), F.floor(last / STRETCH).cast("int"))
    return F.when(F.size(codes) == 0, F.array().cast("array<struct<hash:bigint,position:int>>")).otherwise(
        F.flatten(F.transform(stretches, stretch))
    )


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The fingerprint of a text: an array of (hash, position), positions ascending."""
    return _let(unit_codes(text), lambda codes: _fingerprint_of_codes(codes, k, window))


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes in all hashes of two arrays of hashes, from 0 to 1."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def hashes_of(printed: Column) -> Column:
    return F.transform(printed, lambda e: e["hash"])


def as_text(printed: Column) -> Column:
    """A fingerprint as text: ``hash:position`` in hexadecimal and decimal digits, one after another."""
    return F.array_join(F.transform(printed, lambda e: F.concat(F.lower(F.hex(e["hash"])), F.lit(":"), e["position"].cast("string"))), " ")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: the id, ``n_chars`` code points and the ``fingerprint``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col), F.char_length(text).cast("long").alias("n_chars"), fingerprint(text, k, window).alias("fingerprint"))


def _neighbours(rows: DataFrame) -> DataFrame:
    """Per distinct (id, text): how often it occurs, and the keys before and after it by descending id.

    The order is numbered in ranges; neighbours meet by number, so no window sees the whole table.
    """
    falling = F.lit(2**63 - 1).cast("decimal(20,0)") - F.col("id").cast("decimal(20,0)")
    place = F.coalesce(F.lpad(falling.cast("string"), 20, "0"), F.lit("~"))  # rows without id come last
    keys = rows.groupBy("key").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    ordered = cut_lineage(keys.withColumn("_order", F.concat(place, "key")))
    ranked = cut_lineage(global_row_number(ordered, "_order").select("rank", "key", "n", "copies"))
    total = ranked.agg(F.max("rank")).first()[0] or 0
    before = ranked.select((F.col("rank") % F.lit(max(total, 1)) + 1).alias("rank"), F.col("key").alias("before"), F.col("n").alias("before_n"))
    return cut_lineage(ranked.join(before, "rank").select("key", "n", "copies", "before", "before_n"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` beside an edited text: its last third replaced by the beginning of the next row.

    Rows follow one another by descending id, without id last, rows of one id by the digest of their text, copies
    side by side; after the last comes the first. Columns: the id, ``n_chars``, ``fingerprint``, ``edited``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    Texts cross the network once, by their key, with copies combined before; from there only the beginning that the
    row before asks for and the fingerprint's hashes go on to that row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.sha2(text, 256))
    keyed = docs.select(key.alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    rows = keyed.select("key", "id", F.char_length("text").cast("long").alias("n"))
    around = _neighbours(rows)
    # two plain arrays are a third of the bytes of an array of structs
    printed = keyed.withColumn("print", fingerprint(F.col("text"), k, window)).select(
        "key", F.struct("id", "text", F.col("print.hash").alias("hashes"), F.col("print.position").alias("positions")).alias("row")
    )
    once = printed.groupBy("key").agg(F.first("row").alias("row"))
    placed = once.join(around, "key").select("key", "n", "copies", "before", "before_n", "row")
    third = lambda n: ((n - n % 3) / 3).cast("int")
    ahead = placed.select(
        F.col("before").alias("key"),
        F.substring(F.col("row.text"), F.lit(1), third(F.col("before_n"))).alias("ahead"),
        F.col("row.hashes").alias("next_hashes"),
    )
    own = F.col("row.hashes")
    own_print = F.arrays_zip(own.alias("hash"), F.col("row.positions").alias("position"))
    head = F.substring(F.col("row.text"), F.lit(1), (F.col("n") - third(F.col("n"))).cast("int"))
    # of equal rows all but the last are followed by a copy of themselves
    last = F.struct(F.lit(1).cast("long").alias("times"), F.col("ahead"), F.col("next_hashes"))
    copy = F.struct(
        (F.col("copies") - 1).alias("times"),
        F.substring(F.col("row.text"), F.lit(1), third(F.col("n"))).alias("ahead"),
        own.alias("next_hashes"),
    )
    met = placed.join(ahead, "key").withColumn("case", F.explode(F.when(F.col("copies") > 1, F.array(last, copy)).otherwise(F.array(last))))
    edited = met.select(
        F.col("row.id").alias(id_col), F.col("n").alias("n_chars"), own_print.alias("fingerprint"), own.alias("_own"),
        F.concat(head, F.col("case.ahead")).alias("edited"), F.col("case.next_hashes").alias("_next"), F.col("case.times").alias("_times"),
    )
    changed = edited.withColumn("edited_fingerprint", fingerprint(F.col("edited"), k, window))
    scored = changed.select(
        id_col, "n_chars", "fingerprint", "edited", "edited_fingerprint", "_times",
        likeness(F.col("_own"), hashes_of(F.col("edited_fingerprint"))).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )
    return scored.withColumn("_time", F.explode(F.expr("sequence(1L, _times)"))).drop("_times", "_time")
