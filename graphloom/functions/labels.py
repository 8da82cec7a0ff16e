"""Names and labels: local names, label normal forms, token sets, identifiers and URIs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.canon import let, strip


def _bare_iri(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), r"(?s)^<(.*)>$", "$1"))


def _is_scheme(s: Column) -> Column:
    return s.startswith("http://") | s.startswith("https://") | s.startswith("urn:")


def _after_first_colon(s: Column) -> Column:
    return F.when(s.contains(":") & ~_is_scheme(s), s.substr(F.locate(":", s) + 1, F.length(s))).otherwise(s)


def local_name(c: Column) -> Column:
    """The last part of an IRI or compact identifier: behind the last '#', else the last '/', else the first ':'.

    A URN or web address without '#' and '/' stays whole. Null gives null.
    """
    last = lambda s: F.when(s.contains("#"), F.substring_index(s, "#", -1)).when(s.contains("/"), F.substring_index(s, "/", -1)).otherwise(_after_first_colon(s))
    return strip(let(_bare_iri(c), last))


def label(c: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """A label without IRI parts, punctuation, case and one role suffix.

    The first of suffixes that ends the cleaned label behind a space is cut. If the label as written ends
    in '_' and a suffix, that is cut instead, from the label as written.
    """
    clean = lambda x: F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", "")
    part = let(_bare_iri(c), lambda s: F.when(s.contains("#"), F.substring_index(s, "#", -1)).when(s.contains("/"), F.substring_index(s, "/", -1)).otherwise(s))
    part = let(part, _after_first_colon)
    if not suffixes:
        return strip(F.regexp_replace(clean(part), r"(?U)\s+", " "))

    def without_suffix(s: Column) -> Column:
        out = F.when(F.lit(False), s)
        for suf in suffixes:
            out = out.when(s.endswith(f" {suf.lower()}"), strip(s.substr(F.lit(1), F.length(s) - len(suf) - 1)))
        return out.otherwise(s)

    def cut(s: Column) -> Column:
        ending = rf"(?i)_({'|'.join(suffixes)})$"
        return F.when(s.rlike(ending), strip(clean(F.regexp_replace(s, ending, "")))).otherwise(let(strip(F.regexp_replace(clean(s), r"(?U)\s+", " ")), without_suffix))

    return let(part, cut)


def tokens(c: Column, pattern: str = r"(?U)\w+") -> Column:
    """The distinct lower-case tokens of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)))


def search_terms(c: Column) -> Column:
    """Runs of ASCII letters and digits, in order and with repetitions."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members of two sets over all members; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def identifier(c: Column) -> Column:
    """struct(namespace, value) of 'namespace:value', split at the first colon, both parts stripped; null where a part is empty."""
    ns, value = strip(F.split_part(c, F.lit(":"), F.lit(1))), strip(c.substr(F.locate(":", c) + 1, F.length(c)))
    return F.when(c.contains(":") & (ns != "") & (value != ""), F.struct(ns.alias("namespace"), value.alias("value")))


def namespace_of(c: Column) -> Column:
    return F.split_part(c, F.lit(":"), F.lit(1))


def resource_identifier(c: Column, prefixes: dict[str, str], default: str) -> Column:
    """struct(namespace, value) of a raw resource name.

    A URN gives its scheme in upper case and the rest, a web address its last path part under the
    part before it, if that is alphanumeric and short; a name that contains one of the prefixes has that prefix's
    namespace; a compact identifier has its own prefix in upper case; all others have the default.
    """
    s = F.regexp_replace(strip(c), "^<|>$", "")
    made = lambda ns, v: F.struct(ns.alias("namespace"), v.alias("value"))
    parts = F.split(F.regexp_replace(s, "/+$", ""), "/")
    last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    out = F.when(F.lower(s).startswith("urn:") & (F.size(F.split(s, ":")) >= 3), made(F.upper(F.split_part(s, F.lit(":"), F.lit(2))), F.regexp_replace(s, "^[^:]*:[^:]*:", "")))
    for prefix, ns in prefixes.items():
        out = out.when(F.lower(s).contains(prefix.lower()), made(F.lit(ns), local_name(s)))
    out = out.when(s.rlike("^https?://"), made(F.when(before.rlike("^[A-Za-z0-9]{1,12}$"), F.upper(before)).otherwise(F.lit(default)), last))
    out = out.when(s.rlike("^[^:/]+:[^:]"), made(F.upper(F.split_part(s, F.lit(":"), F.lit(1))), F.regexp_replace(s, "^[^:]*:", "")))
    return out.otherwise(made(F.lit(default), s))


def sanitized(c: Column, default: str) -> Column:
    """An id without angle brackets and quotes around it, its white space as '_'; the default where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(strip(c), r"""^[<"']+|[>"']+$""", ""), r"(?U)\s+", "_")
    return F.when(s.isNull() | (s == ""), F.lit(default)).otherwise(s)


def source_uri(c: Column, prefixes: tuple[str, ...], redundant: tuple[str, ...] = (), canonical: str | None = None) -> Column:
    """A source's URI with its first matching prefix (in any case) and one redundant prefix cut, in lower case, under the canonical prefix."""
    s = _bare_iri(c)
    alternatives = "|".join(p.replace(".", r"\.").replace("/", "/") for p in prefixes)
    s = F.regexp_replace(s, f"(?i)^(?:{alternatives})", "")
    if redundant:
        s = F.regexp_replace(s, f"(?i)^(?:{'|'.join(redundant)})", "")
    return F.concat(F.lit(prefixes[0] if canonical is None else canonical), F.lower(strip(s)))


def patent_number(c: Column) -> Column:
    """A patent number as CC:number:kind: commas dropped, spaces as colons, upper case."""
    s = F.upper(F.regexp_replace(F.regexp_replace(strip(c), ",", ""), r"\s+", ":"))
    return F.regexp_replace(s, r"^([A-Z]{2})(\d+)([A-Z][A-Z0-9]*)$", "$1:$2:$3")


def kind_of(name: Column, prefixes: dict[str, tuple[str, ...]], default: str = "concept") -> Column:
    """The first kind one of whose prefixes the identifier contains, in any case."""
    out = F.when(F.lit(False), F.lit(default))
    for kind, words in prefixes.items():
        found = reduce(lambda a, b: a | b, (F.lower(name).contains(w.lower()) for w in words))
        out = out.when(found, kind)
    return out.otherwise(default)


def masked(c: Column, keep: int = 200) -> Column:
    """A message with secrets masked, cut behind keep characters."""
    s = F.regexp_replace(c, r"(?i)(api[_-]?key|token|password|secret|bearer)(\s*[=:]\s*|\s+)\S+", "$1$2***")
    return F.when(F.length(s) > keep, F.concat(F.substring(s, 1, keep), F.lit("..."))).otherwise(s)
