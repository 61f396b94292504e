"""Turn exported text cells into typed values. All helpers tolerate nulls."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t\n\r\x0b\x0c"
EVENT_DATA = "struct<EventData:struct<Data:array<map<string,string>>>>"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def filled(c: Column) -> Column:
    """The cell as it is, or null when it is empty."""
    return F.nullif(c, F.lit(""))


def stripped(c: Column) -> Column:
    """The trimmed cell, or null when nothing is left."""
    return filled(strip(c))


def int_or_null(c: Column) -> Column:
    return strip(c).try_cast("bigint")


def size_or_null(c: Column) -> Column:
    n = int_or_null(c)
    return F.when(n >= 0, n)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin("true", "1", "yes"), F.lit(False))


def truthy_or_null(c: Column) -> Column:
    return F.when(stripped(c).isNotNull(), truthy(c))


def instant(c: Column) -> Column:
    """Timestamp text with or without zone; zone-less text is UTC."""
    return F.try_to_timestamp(strip(c))


def full_path(parent: Column, name: Column) -> Column:
    head = F.rtrim(F.coalesce(parent, F.lit("")), F.lit("\\/"))
    tail = F.coalesce(name, F.lit(""))
    return F.when(head != "", F.concat(head, F.lit("\\"), tail)).otherwise(tail)


def _pieces(c: Column, separator: str) -> Column:
    parts = F.transform(F.split(c, separator), strip)
    return F.filter(parts, lambda p: p != "")


def split_list(c: Column) -> Column:
    """Split on the first of `;` `|` `,` that occurs at all."""
    cell = F.coalesce(c, F.lit(""))
    return (
        F.when(cell.contains(";"), _pieces(cell, ";"))
        .when(cell.contains("|"), _pieces(cell, "\\|"))
        .otherwise(_pieces(cell, ","))
    )


def reasons(c: Column) -> Column:
    return _pieces(F.coalesce(c, F.lit("")), "\\|")


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _last_wins(entries: Column) -> Column:
    """Map from (key, value) structs; of equal keys the last one is kept."""

    def build(es: Column) -> Column:
        def is_last(entry: Column, i: Column) -> Column:
            later = F.slice(es, i + 2, F.size(es))
            return ~F.exists(later, lambda other: other["key"] == entry["key"])

        keys = F.transform(es, lambda e: e["key"])
        distinct = F.size(F.array_distinct(keys)) == F.size(es)
        return F.map_from_entries(F.when(distinct, es).otherwise(F.filter(es, is_last)))

    return let(entries, build)


def event_data(payload: Column) -> Column:
    """`@Name` -> `#text` of the event payload; unreadable payloads give an empty map."""
    data = F.from_json(payload, EVENT_DATA)["EventData"]["Data"]
    named = F.filter(
        F.coalesce(data, F.array().cast("array<map<string,string>>")),
        lambda m: m["@Name"].isNotNull() & m["#text"].isNotNull(),
    )
    return _last_wins(
        F.transform(named, lambda m: F.struct(m["@Name"].alias("key"), m["#text"].alias("value")))
    )


def extra_map(c: Column) -> Column:
    """`k: v; k: v`, cut at the first colon of each pair."""
    pairs = F.filter(_pieces(F.coalesce(c, F.lit("")), ";"), lambda p: p.contains(":"))
    return _last_wins(
        F.transform(
            pairs,
            lambda p: F.struct(
                strip(F.substring_index(p, ":", 1)).alias("key"),
                strip(F.substr(p, F.instr(p, ":") + 1)).alias("value"),
            ),
        )
    )


def logon_type(c: Column) -> Column:
    """A number, or the number after the label `LogonType`."""
    label = F.regexp_extract(c, r"(?i)LogonType\s+(\d+)", 1)
    return F.coalesce(int_or_null(c), label.try_cast("bigint")).cast("int")


def first_filled(*cells: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cells])


def zoned_instant(date: Column, time: Column, zone: Column) -> Column:
    """`MM/DD/YYYY` plus time plus zone as an instant; other date text is tried as it is."""
    d, t, z = strip(date), strip(time), stripped(zone)
    american = r"^(\d{1,2})/(\d{1,2})/(\d{1,4})$"
    iso = F.when(
        d.rlike(american),
        F.concat_ws(
            "-",
            F.lpad(F.regexp_extract(d, american, 3), 4, "0"),
            F.lpad(F.regexp_extract(d, american, 1), 2, "0"),
            F.lpad(F.regexp_extract(d, american, 2), 2, "0"),
        ),
    ).otherwise(d)
    local = F.concat(iso, F.lit(" "), t)
    return F.coalesce(
        F.try_to_timestamp(F.concat(local, F.lit(" "), F.coalesce(z, F.lit("UTC")))),
        F.try_to_timestamp(local),
    )


def sha1_of_file_id(c: Column) -> Column:
    cell = strip(c)
    return F.when((F.length(cell) == 44) & cell.startswith("0000"), F.lower(F.substring(cell, 5, 40)))


def run_times(*cells: Column) -> Column:
    return F.filter(F.array(*cells), lambda t: F.coalesce(strip(t), F.lit("")) != "")


def listing_name(name: Column) -> Column:
    """Listing path without deletion suffix and leading slashes."""
    bare = F.regexp_replace(strip(name), r"\s*\((?:realloc|deleted)\)$", "")
    return strip(F.ltrim(bare, F.lit("/")))


def listing_deleted(name: Column, inode: Column) -> Column:
    return strip(inode).startswith("*") | strip(name).rlike(r"\((?:realloc|deleted)\)$")


def listing_inode(inode: Column) -> Column:
    bare = F.ltrim(strip(inode), F.lit("*"))
    return int_or_null(F.substring_index(bare, "-", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def inode_name(inode: Column, path: Column) -> Column:
    name = F.replace(base_name(path), F.lit(" ($FILE_NAME)"), F.lit(""))
    return F.concat(inode.cast("string"), F.lit(":"), name)


def scrub_addresses(c: Column) -> Column:
    """Replace the memory address in `<X object at 0x…>` so that reruns hash alike."""
    return F.regexp_replace(
        c, r"<([a-zA-Z0-9_.]+) object at 0x[0-9a-fA-F]+>", "<$1 object at 0xMEMADDR>"
    )


def normalize_path(c: Column) -> Column:
    slashes = F.translate(F.lower(strip(c)), "/", "\\")
    return F.rtrim(F.regexp_replace(slashes, r"\\+", r"\\"), F.lit("\\"))


def severity_rank(level: Column) -> Column:
    """Position on the severity scale, null for unknown words."""
    from .fixed import SEVERITIES

    scale = F.array(*[F.lit(s) for s in SEVERITIES])
    position = F.array_position(scale, F.lower(strip(level)))
    return F.when(position > 0, (position - 1).cast("int"))


def contains_ci(haystack: Column, needle: str) -> Column:
    """Case-blind substring; `%` and `_` have no special meaning."""
    return F.contains(F.lower(haystack), F.lit(needle.lower()))


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))
