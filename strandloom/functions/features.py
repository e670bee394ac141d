"""Feature tables: entries, their locations as ordered intervals, and what the intervals say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sequence as S

#: Where keys and locations stand in a line of a feature table.
MARGIN = "FT   "
INDENT = "FT" + " " * 19
ITEM = r"(complement\(*)?([<>]?)(\d+)(?:(\.\.|\.|\^)([<>]?)(\d+))?"


def location_text(intervals: Column) -> Column:
    """Intervals (start, end, complement), in order, as a location; one base is a number, several intervals are joined."""
    bounds = lambda x: F.when(x["start"] == x["end"], x["start"].cast("string")).otherwise(F.concat(x["start"].cast("string"), F.lit(".."), x["end"].cast("string")))
    one = F.transform(intervals, lambda x: F.when(x["complement"], F.concat(F.lit("complement("), bounds(x), F.lit(")"))).otherwise(bounds(x)))
    return F.when(F.size(intervals) > 1, F.concat(F.lit("join("), F.array_join(one, ","), F.lit(")"))).otherwise(F.array_join(one, ","))


def entry_text(key: Column, location: Column, qualifiers: dict[str, Column]) -> Column:
    """An entry as lines of a feature table; locations go on in the next line behind a comma. Quotes in values are doubled."""
    first = F.concat(F.lit(MARGIN), F.rpad(key, 16, " "), F.replace(location, F.lit(","), F.lit(",\n" + INDENT)))
    rest = [F.concat(F.lit(f"\n{INDENT}/{name}="), F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"')) for name, value in qualifiers.items()]
    return F.concat(first, *rest)


def location_intervals(location: Column) -> Column:
    """The intervals of a location in the order they are read: array of start, end, complement, between, open_start, open_end.

    ``a..b`` goes from a to b, ``a`` is one base, ``a^b`` lies ``between`` two bases, ``a.b`` is one base
    somewhere in a to b; ``<`` and ``>`` are kept. ``complement`` before an interval turns that one; before a join or an order
    it turns each of them and their order. Of a bound in brackets, ``(a.b)..c``, the outer value counts. Names of other
    entries before a colon are dropped. Null and texts without a number give no intervals.
    """
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(location, F.lit("")), r"\s+", ""), r"[A-Za-z_][\w.]*:", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\(([<>]?\d+)\.\d+\)\.\.", "$1.."), r"\.\.\(\d+\.([<>]?\d+)\)", "..$1")
    turned = plain.rlike(r"^complement\((join|order)\(")
    inner = F.regexp_replace(plain, r"^complement\((?=join\(|order\()", "")
    part = lambda x, i: F.regexp_extract(x, ITEM, i)
    found = F.transform(
        F.regexp_extract_all(inner, F.lit(ITEM), 0),
        lambda x: F.struct(
            part(x, 3).cast("long").alias("start"),
            F.when(part(x, 6) == "", part(x, 3)).otherwise(part(x, 6)).cast("long").alias("end"),
            (part(x, 1) != "").alias("complement"),
            (part(x, 4) == "^").alias("between"),
            part(x, 2).alias("open_start"),
            part(x, 5).alias("open_end"),
        ),
    )
    names = ["start", "end", "complement", "between", "open_start", "open_end"]
    flipped = F.transform(F.reverse(found), lambda x: F.struct(*[(~x[n] if n == "complement" else x[n]).alias(n) for n in names]))
    return F.when(turned, flipped).otherwise(found)


def entries(text: Column) -> Column:
    """Entries of a feature table: array of key, location (without blanks) and qualifiers, a map of names to values.

    A value in quotes may hold slashes and doubled quotes, and goes on over lines, which a blank joins; a qualifier without a value
    has an empty one, of equal names the last counts. Lines that aren't part of the table are skipped.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: x.startswith(MARGIN))
    marked = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"^FT {3}\S"), F.concat(F.lit("\x01"), F.substring(x, 6, 1 << 30))).otherwise(F.concat(F.lit("\n"), F.ltrim(F.substring(x, 6, 1 << 30))))), "")
    whole = F.filter(F.split(marked, "\x01"), lambda x: x != "")
    # possessive, so that long values take no stack
    pattern = r'\n/([\w-]+)(?:=("(?:[^"]++|"")*+"|[^\n]*))?'
    value = lambda x: F.regexp_extract(x, pattern, 2)
    clean = lambda v: F.when(v.startswith('"'), F.replace(F.regexp_replace(F.replace(v, F.lit("\n"), F.lit(" ")), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(v)

    def entry(x: Column) -> Column:
        pairs = F.transform(F.regexp_extract_all(x, F.lit(pattern), 0), lambda q: F.struct(F.regexp_extract(q, pattern, 1).alias("name"), clean(value(q)).alias("value")))
        # bound once: what a lambda captures is worked out anew for each element
        last = F.transform(F.array(pairs), lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda later: later["name"] == p["name"])))[0]
        place = F.regexp_replace(F.substring_index(x, "\n/", 1), r"^\S+|\s+", "")
        return F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("key"), place.alias("location"), F.map_from_entries(last).alias("qualifiers"))

    return F.transform(whole, entry)


def spliced(seq: Column, intervals: Column) -> Column:
    """The intervals' bases one after the other, complemented ones turned; places between two bases add none."""
    piece = lambda x: F.substring(seq, x["start"].cast("int"), (x["end"] - x["start"] + 1).cast("int"))
    pieces = F.transform(F.filter(intervals, lambda x: ~x["between"]), lambda x: F.when(x["complement"], S.reverse_complement(piece(x))).otherwise(piece(x)))
    return F.array_join(pieces, "")
