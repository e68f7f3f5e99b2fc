"""Where a page says it belongs: canonical links and refreshes of its markup, as absolute URLs, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a browser doesn't read as markup: comments, and elements whose content is text. Without an end they reach to the page's end.
NOT_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title|xmp|iframe)(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\z)"
#: A tag to its end, over quoted values with ``>`` in them; 500 values at most, so that no page can exhaust a stack.
TAG = r"""(?is)<(?:link|meta|base)(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+'){0,500}+>"""
#: One attribute with its value, quoted or not. Read one after the other, so that a value isn't taken for attributes.
ATTRIBUTE = r"""(?s)[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?"""
#: Names of references that stand for characters of URLs.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "sol": "/", "colon": ":", "period": ".", "quest": "?", "num": "#", "equals": "=", "percnt": "%",
    "plus": "+", "comma": ",", "semi": ";", "lowbar": "_", "hyphen": "-", "excl": "!", "ast": "*", "lpar": "(", "rpar": ")", "commat": "@", "dollar": "$", "nbsp": " ",
}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used; nested uses would multiply the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decoded(text: Column) -> Column:
    """Character references of the form ``&#47;``, ``&#x2f;`` and ``&sol;`` as their characters; others stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    valid = lambda code: (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    char = lambda code: F.when(valid(code), F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"))
    number = lambda n: F.when(F.substring(n, 1, 1).isin("x", "X"), F.conv(F.substr(n, F.lit(2)), 16, 10)).otherwise(n).try_cast("int")

    def one(part: Column) -> Column:
        of_number = bound(number(F.regexp_extract(part, r"^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)), char)
        found = F.coalesce(of_number, F.try_element_at(names, F.regexp_extract(part, r"^([A-Za-z]+);", 1)))
        return bound(found, lambda c: F.when(c.isNotNull(), F.concat(c, F.regexp_extract(part, r"(?s)^[^;]*;(.*)$", 1))).otherwise(F.concat(F.lit("&"), part)))

    return bound(F.split(text, "&"), lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), "")))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, references decoded, blanks around it dropped; null without one."""
    pairs = F.regexp_extract_all(F.regexp_replace(tag, "(?i)^<[a-z]+", ""), F.lit(ATTRIBUTE), F.lit(0))
    own = F.get(F.filter(pairs, lambda p: F.lower(F.regexp_extract(p, r"^([^\s=]+)", 1)) == name), F.lit(0))
    return F.trim(decoded(F.regexp_extract(own, r"""(?s)^[^=]*=\s*(["']?)(.*?)\1$""", 2)))


def _resolved(path: Column) -> Column:
    """A path without ``.`` and ``..``."""
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)
    step = lambda a, s: F.when(s == "..", up(a)).when(s == ".", a).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def absolute(link: Column, url: Column) -> Column:
    """``link`` as it is meant on a page with that absolute URL; null for an empty link, a fragment, or a scheme without ``//``."""
    origin = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*([^?#]*/)", 1)

    def joined(to: Column) -> Column:
        return (
            F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
            .when(to.rlike(r"^(?:#|$|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
            .when(F.startswith(to, F.lit("//")), F.concat(F.regexp_extract(url, r"^([^:/?#]*:)", 1), to))
            .when(F.startswith(to, F.lit("/")), F.concat(origin, to))
            .when(F.startswith(to, F.lit("?")), F.concat(origin, path, to))
            .otherwise(F.concat(origin, F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")), to))
        )

    def undotted(whole: Column) -> Column:
        dotted = F.concat(F.regexp_extract(whole, r"^([^/]*//[^/?#]*)", 1), _resolved(F.regexp_extract(whole, r"^[^/]*//[^/?#]*([^?#]*)", 1)), F.regexp_extract(whole, r"^[^?#]*(.*)$", 1))
        return F.when(F.locate("/.", whole) > 0, dotted).otherwise(whole)

    return bound(link, lambda to: bound(joined(to), undotted))


def alias_targets(html: Column, url: Column) -> Column:
    """Absolute URLs of all canonical links and meta refreshes of a page, in markup only, resolved against its ``<base>`` if it has one."""
    kind = lambda tag, name: F.startswith(F.lower(tag), F.lit(f"<{name}"))
    rels = lambda tag: F.split(F.lower(F.coalesce(attribute(tag, "rel"), F.lit(""))), r"\s+")

    def of_tags(tags: Column) -> Column:
        links = F.transform(F.filter(tags, lambda t: kind(t, "link") & F.array_contains(rels(t), "canonical")), lambda t: attribute(t, "href"))
        refresh = F.filter(tags, lambda t: kind(t, "meta") & (F.lower(F.coalesce(attribute(t, "http-equiv"), F.lit(""))) == "refresh"))
        moved = F.transform(refresh, lambda t: F.regexp_extract(attribute(t, "content"), r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?([^"']*)""", 1))
        bases = F.transform(F.filter(tags, lambda t: kind(t, "base")), lambda t: attribute(t, "href"))
        home = F.coalesce(absolute(F.get(F.filter(bases, lambda h: F.length(h) > 0), F.lit(0)), url), url)
        found = bound(home, lambda at: F.transform(F.concat(links, moved), lambda to: absolute(to, at)))
        return F.filter(found, lambda x: x.isNotNull())

    tags = F.regexp_extract_all(F.regexp_replace(html, NOT_MARKUP, ""), F.lit(TAG), F.lit(0))
    hinted = F.coalesce(html.rlike(r"(?i)canonical|http-equiv"), F.lit(False))
    return F.when(hinted, bound(tags, of_tags)).otherwise(F.array().cast("array<string>"))
