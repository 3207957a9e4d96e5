"""Domain-name and URL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import tables


def _bind(c: Column, body) -> Column:
    """Evaluate `c` once and hand its value to `body`, however often `body` uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add derived columns that are computed once per row.

    A plain derived column is computed again in every filter that uses it; a generated one is not.
    """
    for name, c in columns.items():
        df = df.withColumn(name, F.explode(F.array(c)))
    return df


def strip_dots(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"^\.+|\.+$", "")


def first_label(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def label_count(c: Column) -> Column:
    """Number of dots in a name."""
    return F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))


def label_entropy(c: Column) -> Column:
    """Shannon entropy in bits of the leftmost label; 0 for an empty label.

    Characters are summed in sorted order so the floating-point result is reproducible.
    """
    def entropy(label: Column) -> Column:
        n = F.length(label)

        def bits(ch: Column) -> Column:
            p = (n - F.length(F.replace(label, ch, F.lit("")))) / n
            return p * F.log2(p)

        chars = F.array_sort(F.array_remove(F.array_distinct(F.split(label, "")), ""))
        return F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda acc, ch: acc - bits(ch))).otherwise(0.0)

    return _bind(first_label(F.lower(c)), entropy)


def suspicious_tld(c: Column) -> Column:
    return (F.instr(c, ".") > 0) & F.substring_index(F.lower(c), ".", -1).isin(tables.SUSPICIOUS_TLDS)


def domain_in_list(c: Column, domains) -> Column:
    """Equals a listed domain or lies below one."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | (c == d) | c.endswith("." + d)
    return F.coalesce(hit, F.lit(False))


def on_cdn(c: Column) -> Column:
    """Ends with a CDN domain; the match has no dot boundary, but the name needs a dot."""
    hit = F.lit(False)
    for d in tables.HIGH_ENTROPY_CDNS:
        hit = hit | c.endswith(d)
    return hit & (F.instr(c, ".") > 0)


def domain_suffixes(c: Column) -> Column:
    """The name and its parents that have at least two labels, most specific first."""
    def parents(labels: Column) -> Column:
        n = F.size(labels)
        return F.when(n >= 2, F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(
                F.array().cast("array<string>"))

    return _bind(F.split(strip_dots(c), r"\."), parents)


def url_host(c: Column) -> Column:
    """Host of a URL in lower case: scheme, path, user info and port removed, each once."""
    def after(text: Column, mark: str) -> Column:
        at = F.instr(text, mark)
        return F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).otherwise(text)

    rest = F.substring_index(after(c, "://"), "/", 1)
    return F.lower(F.trim(F.substring_index(after(rest, "@"), ":", 1)))
