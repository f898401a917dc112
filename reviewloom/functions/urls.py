"""URL references resolved against the address of their page, by the public rules (RFC 3986), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.html import let
from reviewloom.functions.text import strip

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"  # scheme, authority, path, query


def without_dots(path: Column) -> Column:
    """A path without "." and "..": each ".." takes the segment before it away, those at the top go."""

    def step(done: Column, segment: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment == ".", done).when(segment == "..", up).otherwise(F.concat(done, F.array(segment)))

    def joined(segments: Column) -> Column:
        last = F.element_at(segments, -1)
        kept = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.array().cast("array<string>"), step)
        open_end = F.when(last.isin(".", ".."), let(kept, lambda k: F.concat(k, F.array(F.lit(""))))).otherwise(kept)
        return F.concat(F.lit("/"), F.array_join(open_end, "/"))

    return F.when(F.rlike(path, F.lit(r"(?:^|/)\.\.?(?:/|$)")), let(F.split(path, "/", -1), joined)).otherwise(path)


def resolve_url(base: Column, reference: Column) -> Column:
    """The absolute form of a reference on a page at ``base``.

    A reference with a scheme stays as it is; an empty one is the page. Null if either is null.
    """
    ref = strip(reference)

    def part(of: Column, group: int) -> Column:
        return F.regexp_extract(of, _PARTS, group)

    def from_base(r: Column) -> Column:
        scheme, authority, path, query = (part(base, g) for g in (1, 2, 3, 4))
        rest = F.regexp_extract(r, r"^[^?#]*(.*)$", 1)
        own = F.regexp_extract(r, r"^([^?#]*)", 1)
        folder = F.when((path == "") & (authority != ""), F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
        at_root = F.concat(scheme, authority, without_dots(own), rest)
        relative = F.concat(scheme, authority, without_dots(F.concat(folder, own)), rest)
        page = F.concat(scheme, authority, path)
        return (
            F.when(F.rlike(r, F.lit(SCHEME)), r)
            .when(r.startswith("//"), F.concat(scheme, r))
            .when(r == "", F.concat(page, query))
            .when(r.startswith("#"), F.concat(page, query, r))
            .when(r.startswith("?"), F.concat(page, r))
            .when(r.startswith("/"), at_root)
            .otherwise(relative)
        )

    return let(ref, from_base)
