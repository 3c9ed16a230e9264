"""Canonical form, hashes and identities of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unique_sorted(values: Column) -> Column:
    """A set-like array in its one form: distinct, in binary order, nulls last."""
    return F.array_sort(F.array_distinct(values))


def same_set(a: Column, b: Column) -> Column:
    return unique_sorted(a) == unique_sorted(b)


def canonical_json(fields: dict[str, Column], keep_nulls: bool = True) -> Column:
    """JSON with keys in binary order; nulls are written, or left out where a record version wants that."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.to_json(ordered, {"ignoreNullFields": "false" if keep_nulls else "true"})


def sha256(text: Column) -> Column:
    """Lower-case hex of the UTF-8 text's SHA-256."""
    return F.sha2(text, 256)


def semantic_hash(fields: dict[str, Column], sets: tuple[str, ...] = (), keep_nulls: bool = True) -> Column:
    """Hash of a record's content; fields named in `sets` don't depend on order or repeats."""
    return sha256(canonical_json({k: unique_sorted(c) if k in sets else c for k, c in fields.items()}, keep_nulls))


def first_basis(*choices: tuple[str, dict[str, Column]]) -> Column:
    """struct(kind, value): the first basis whose parts are all there; null if none is.

    The order of choices is the rule: occurrence identities put a source's own
    id before the URL, change detection the URL before the id.
    """
    options = []
    for kind, parts in choices:
        there = F.lit(True)
        for c in parts.values():
            there = there & c.isNotNull()
        options.append(F.when(there, F.struct(F.lit(kind).alias("kind"), canonical_json(parts).alias("value"))))
    return F.coalesce(*options)


def identity_hash(scope: Column, basis: Column) -> Column:
    """Hash of a scope (an endpoint) and a basis from first_basis; null without a basis."""
    return F.when(basis.isNotNull(), sha256(canonical_json({"basis": basis, "scope": scope})))


def set_hash(values: Column) -> Column:
    """Aggregate: hash of a group's values whatever their order; the values should be short, such as hashes."""
    return sha256(F.to_json(F.sort_array(F.collect_list(values))))


def short_id(prefix: str, stem: Column, parts: list[Column], stem_length: int = 8, digits: int = 12) -> Column:
    """prefix-stem-hex: the first hex digits, upper case, of the hash of the parts joined by a bar."""
    digest = F.upper(F.substring(sha256(F.concat_ws("|", *parts)), 1, digits))
    return F.concat_ws("-", F.lit(prefix), F.substring(stem, 1, stem_length), digest)


#: Tokens of JSON text: strings, numbers, and all between them.
_TOKENS = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'
#: Control characters that JSON writers escape by number, in the lower-case form.
_ESCAPES = ["0b", "0e", "0f", "1a", "1b", "1c", "1d", "1e", "1f"]


def json_number(token: Column) -> Column:
    """A number's one form, that of ECMAScript: the digits that a double needs, without exponent from 1e-6 up to 1e21; one beyond all doubles is an error.

    The digits are Java's; before Java 19 it writes one digit too many for a
    few doubles (5e-324 as 4.9e-324), each always the same.
    """
    value = token.cast("double")
    text = F.abs(value).cast("string")
    parts = F.split(text, "E")
    point = F.split(parts[0], r"\.")
    shift = F.coalesce(F.try_element_at(parts, F.lit(2)).cast("int"), F.lit(0))
    # all digits, and how many of them stand before the point
    whole = F.concat(point[0], F.coalesce(F.try_element_at(point, F.lit(2)), F.lit("")))
    bare = F.regexp_replace(whole, "^0+", "")
    n = F.length(point[0]) + shift - (F.length(whole) - F.length(bare))
    digits = F.regexp_replace(bare, "0+$", "")
    k = F.length(digits)
    cut = lambda start, size: F.substr(digits, start, size)
    exponent = F.concat(cut(F.lit(1), F.lit(1)), F.when(k > 1, F.concat(F.lit("."), cut(F.lit(2), k))).otherwise(""), F.lit("e"), F.when(n > 0, "+").otherwise("-"), F.abs(n - 1).cast("string"))
    made = (
        F.when(k == 0, "0")
        .when((k <= n) & (n <= 21), F.concat(digits, F.repeat(F.lit("0"), n - k)))
        .when((n > 0) & (n <= 21), F.concat(cut(F.lit(1), n), F.lit("."), cut(n + 1, k)))
        .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), digits))
        .otherwise(exponent)
    )
    endless = F.raise_error(F.concat(F.lit("not a finite number: "), token)).cast("string")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")) | value.isNull(), endless).when((value < 0) & (k > 0), F.concat(F.lit("-"), made)).otherwise(made)


def canonical_text(json: Column) -> Column:
    """The one form of free-form JSON of any depth (C1): no white space, keys sorted at every level, numbers in one form, -0 as 0.

    The text is parsed to a VARIANT, whose objects keep their keys in order, and
    written from it.  What is no JSON, a key twice in an object, and a number
    that isn't finite are errors; null stays null.
    """
    text = F.to_json(F.parse_json(json))
    string = lambda t: F.aggregate(F.array(*map(F.lit, _ESCAPES)), t, lambda acc, e: F.replace(acc, F.concat(F.lit("\\u00"), F.upper(e)), F.concat(F.lit("\\u00"), e)))

    def one(t: Column) -> Column:
        return F.when(t.startswith('"'), F.when(F.contains(t, F.lit("\\u00")), string(t)).otherwise(t)).when(t.rlike("^[-0-9]"), json_number(t)).otherwise(t)

    # a number beyond all doubles turns into another token when it is parsed, so it is looked for in what was given
    endless = F.exists(F.regexp_extract_all(json, F.lit(_TOKENS), 0), lambda t: t.rlike("^[-0-9]") & (F.abs(t.try_cast("double")) == float("inf")))
    made = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), 0), one), "")
    return F.when(endless, F.raise_error(F.lit("a number that is not finite")).cast("string")).otherwise(made)


def canonical_hash(json: Column) -> Column:
    """Hash of free-form JSON, whatever the order of its keys, its white space and the form of its numbers."""
    return sha256(canonical_text(json))
