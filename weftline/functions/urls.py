"""URL and domain functions as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions that are no pages.
DEAD_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "svg", "webp", "css", "js", "pdf", "zip", "mp4", "mp3", "woff", "woff2", "ico", "xml", "json")
#: Top-level domains that are not public.
PRIVATE_TLDS = ("local", "localhost", "internal", "test", "invalid", "lan")


def host_of(url: Column) -> Column:
    """Lower-case host without ``www.``; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path of an absolute URL, ``/`` where it is empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def path_depth(url: Column) -> Column:
    """Number of path segments that are not empty."""
    return F.size(path_segments(path_of(url))).cast("long")


def reverse_domain(domain: Column) -> Column:
    """a.b.com <-> com.b.a, in lower case, without ``www.``"""
    return F.array_join(F.reverse(F.split(F.regexp_replace(F.lower(domain), r"^www\.", ""), r"\.")), ".")


def valid_domain(raw: Column) -> Column:
    """The public domain in a user's input, or null: scheme, www, user, port and path are cut off, addresses and
    private names refused."""
    d = F.lower(F.trim(raw))
    for pattern in (r"^[a-z][a-z0-9+.-]*://", r"^[^/@]*@", r"^www\.", r"[/?#].*$", r":[0-9]+$"):
        d = F.regexp_replace(d, pattern, "")
    ok = (
        F.length(d).between(4, 253)
        & d.rlike(r"^([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$")
        & ~d.rlike(r"^[0-9.]+$")
        & ~F.element_at(F.split(d, r"\."), -1).isin(*PRIVATE_TLDS)
    )
    return F.when(ok, d)


def same_site(a: Column, b: Column) -> Column:
    """Equal, or one is a sub-domain of the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def suffixes(host: Column) -> Column:
    """The host and its parents of two labels or more: an equi-join on these replaces a suffix theta join."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))


def dead_extension(url: Column) -> Column:
    return F.lower(path_of(url)).rlike(r"\.(" + "|".join(DEAD_EXTENSIONS) + ")$")


def true_destination(url: Column, target: Column) -> Column:
    """A link counts for a target if its host is the target, or its path (not its query) holds the target, or the
    path holds the target's brand label of four letters or more (a gateway)."""
    brand = F.element_at(F.split(target, r"\."), 1)
    path = F.lower(path_of(url))
    return F.coalesce(same_site(host_of(url), target) | F.contains(path, target) | ((F.length(brand) >= 4) & F.contains(path, brand)), F.lit(False))


def unwrap_redirect(url: Column) -> Column:
    """The first of the parameters uddg, url, u, r, q that is an http(s) address, else the URL itself."""
    found = [F.url_decode(F.regexp_extract(url, rf"[?&]{k}=([^&#]*)", 1)) for k in ("uddg", "url", "u", "r", "q")]
    return F.coalesce(*[F.when(f.rlike("^https?://"), f) for f in found], url)


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``x``, which is worked out once however often it is used there."""
    return F.element_at(F.transform(F.array(x), then), 1)


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, its ``.`` and ``..`` segments resolved, spelled out or as %2e."""
    plain = lambda x: F.replace(F.lower(x), F.lit("%2e"), F.lit("."))

    def resolved(parts: Column) -> Column:
        kept = F.aggregate(
            F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"),
            lambda a, x: F.when(plain(x) == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(plain(x) == ".", a).otherwise(F.array_append(a, x)),
        )
        ends = plain(F.element_at(parts, -1)).isin(".", "..")  # such an end leaves the folder
        return let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(ends & (F.size(k) > 0), "/").otherwise("")))

    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), let(F.split(path, "/"), resolved)).otherwise(path)


def canonical(url: Column) -> Column:
    """An http(s) address as browsers write it: lower-case scheme and host, no standard port, a path without dot segments. Others
    stay; one without a host is null."""
    root = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#]*)", 1)), "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    whole = F.concat(root, let(path_of(url), without_dots), rest)
    return F.when(~url.rlike("(?i)^https?:"), url).when(url.rlike("(?i)^https?://[^/?#]"), whole)


def absolutize(base: Column, href: Column) -> Column:
    """href resolved against base: absolute, protocol-relative, root-relative, document-relative and empty references, with
    white space around them cut off and backslashes read as slashes."""
    href = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    web = lambda h: F.when(F.contains(h, F.lit("\\")) & (~h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | h.rlike("(?i)^https?:")), F.concat(F.replace(F.regexp_extract(h, r"^([^?#]*)", 1), F.lit("\\"), F.lit("/")), F.regexp_extract(h, r"^[^?#]*(.*)$", 1))).otherwise(h)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")

    def resolved(h: Column) -> Column:
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(F.startswith(h, F.lit("//")), F.concat(scheme, h))
            .when(F.startswith(h, F.lit("/")), F.concat(root, h))
            .when(F.startswith(h, F.lit("?")), F.concat(root, path_of(base), h))
            .when(F.startswith(h, F.lit("#")) | (h == ""), F.concat(F.regexp_replace(base, "#.*$", ""), h))
            .otherwise(F.concat(root, folder, h))
        )

    return let(let(let(href, web), resolved), canonical)


#: The letters that spell a place name's length, and what stands before it.
LENGTHS, UULE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "w+CAIQICI"


def uule(place: Column) -> Column:
    """The parameter that pins a search to a place: a letter for the name's length (in 16-bit units), then the name in base64."""
    length = F.octet_length(F.encode(place, "UTF-16BE")) / 2
    return F.concat(F.lit(UULE), F.substring(F.lit(LENGTHS), (1 + F.pmod(length, F.lit(64))).cast("int"), F.lit(1)), F.regexp_replace(F.base64(F.encode(place, "UTF-8")), r"\s", ""))
