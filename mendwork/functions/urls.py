"""URL functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import _col, clean, let, some

# Query keys that only track visits
TRACKING = r"(?i)^(utm_[a-z]+|gclid|fbclid|mc_[a-z]+|ref|ref_src|source|sessionid|sid|hsCtaTracking)$"

#: scheme, authority, path, query and fragment (RFC 3986, appendix B)
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, PARTS, index)


def canonical(url: Column | str) -> Column:
    """One spelling of a product's address.

    Trimmed; scheme and host in lower case; query pairs without tracking keys
    and without empty keys, sorted; no fragment; no slashes at the end. Null or
    empty: null. Escapes stay as they are.
    """

    def spelled(p: Column) -> Column:
        key = lambda pair: F.substring_index(pair, "=", 1)
        kept = F.filter(F.split(p["query"], "&"), lambda pair: (key(pair) != "") & ~key(pair).rlike(TRACKING))
        query = let(F.array_join(F.array_sort(kept), "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
        scheme = F.when(p["scheme"] != "", F.concat(F.lower(p["scheme"]), F.lit(":"))).otherwise("")
        host = F.when((p["host"] != "") | p["slashes"], F.concat(F.lit("//"), F.lower(p["host"]))).otherwise("")
        return F.regexp_replace(F.concat(scheme, host, p["path"], query), "/+$", "")

    return F.when(F.coalesce(_col(url), F.lit("")) != "", let(let(F.trim(_col(url)), _parts), spelled))


def _parts(u: Column) -> Column:
    names = ("scheme", "host", "path", "query", "fragment")
    return F.struct(*[part(u, i + 1).alias(n) for i, n in enumerate(names)], F.contains(u, F.lit("://")).alias("slashes"), F.contains(u, F.lit("?")).alias("asks"), F.contains(u, F.lit("#")).alias("points"), u.alias("whole"))


def base_of(url: Column | str) -> Column:
    """scheme://host of an absolute address, else the address; null as ''."""
    root = r"^([A-Za-z][\w+.-]*://[^/?#]+)"
    return let(F.coalesce(_col(url), F.lit("")), lambda u: F.coalesce(some(F.regexp_extract(u, root, 1)), u))


def host_of(url: Column | str) -> Column:
    return part(_col(url), 2)


def _without_dots(path: Column) -> Column:
    """Resolve . and .. segments of an absolute path."""

    def kept(segments: Column) -> Column:
        out = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
        )
        slash = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise("")
        return let(out, lambda a: F.concat(F.lit("/"), F.array_join(a, "/"), F.when(F.size(a) > 0, slash).otherwise("")))

    return let(F.slice(F.split(path, "/"), 2, 1 << 20), kept)


def join(base: Column, reference: Column) -> Column:
    """``reference`` resolved against ``base`` (RFC 3986, section 5.2)."""

    def joined(both: Column) -> Column:
        b, r = both["b"], both["r"]
        root = F.concat(F.when(b["scheme"] != "", F.concat(b["scheme"], F.lit(":"))).otherwise(""), F.lit("//"), b["host"])
        tail = F.concat(F.when(r["asks"], F.concat(F.lit("?"), r["query"])).otherwise(""), F.when(r["points"], F.concat(F.lit("#"), r["fragment"])).otherwise(""))
        folder = F.when(b["path"] == "", F.lit("/")).otherwise(F.regexp_replace(b["path"], "[^/]*$", ""))
        merged = F.when(F.startswith(r["path"], F.lit("/")), r["path"]).otherwise(F.concat(folder, r["path"]))
        same = F.concat(root, b["path"], F.when(~r["asks"] & (b["query"] != ""), F.concat(F.lit("?"), b["query"])).otherwise(""), tail)
        return (
            F.when(r["whole"] == "", b["whole"])
            .when(r["scheme"] != "", r["whole"])
            .when(F.startswith(r["whole"], F.lit("//")), F.concat(b["scheme"], F.lit(":"), r["whole"]))
            .when(b["host"] == "", r["whole"])
            .when(r["path"] == "", same)
            .otherwise(F.concat(root, let(merged, _without_dots), tail))
        )

    return let(F.struct(let(base, _parts).alias("b"), let(reference, _parts).alias("r")), joined)


def resolve(raw: Column | str, base: Column) -> Column:
    """Absolute address of a link; http(s) links stay, blank links are null."""
    return let(clean(raw), lambda t: F.when(t == "", F.lit(None).cast("string")).when(t.rlike("^https?://") | (base == ""), t).otherwise(join(base, t)))


def layout_and_page(url: Column | str, default_layout: Column | str) -> tuple[Column, Column]:
    """Layout and page number that an address of the page store names.

    ``fixture://layout/page-N`` names both; else the number is the first of
    page=N, /page-N or /list/N, and 1 if there is none.
    """
    u = _col(url)
    direct = r"^fixture://([^/]+)/page-(\d+)"
    number = F.regexp_extract(u, r"(?:[?&]page=|/page-|/list/)(\d+)", 1)
    layout = F.coalesce(some(F.regexp_extract(u, direct, 1)), F.lit(default_layout) if isinstance(default_layout, str) else default_layout)
    page = F.coalesce(some(F.regexp_extract(u, direct, 2)), some(number), F.lit("1")).cast("int")
    return layout, page
