"""Lookups: indicators, prefix tables, hostnames. What is looked up becomes a table, which Spark broadcasts if it is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import domain_suffixes
from ..functions.net import ip_hex
from .lineage import cut


#: Levels of a prefix index: prefixes of up to so many bits, in buckets of addresses that share so many hex digits.
LEVELS = ((16, 2), (32, 4), (48, 8), (64, 12), (128, 16))


def _address_key(c: Column) -> Column:
    """Family and 32 hex digits of an address, IPv4 filled up on the right; text order is address order."""
    hexed = ip_hex(c)
    return F.concat(F.when(F.length(hexed) == 8, "4").otherwise("6"), F.rpad(hexed, 32, "0"))


def _halves(digits: Column) -> tuple[Column, Column]:
    return tuple(F.conv(F.substring(digits, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))


def _digits(high: Column, low: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.conv(x.cast("string"), 10, 16)), 16, "0") for x in (high, low)))


def _size(bits: Column) -> Column:
    """Addresses of a block in units of its half: 2 ** (64 - bits), or 2 ** (128 - bits) in the lower half."""
    powers = F.array(*[F.lit(str(1 << k)).cast("decimal(20,0)") for k in range(65)])  # doubles would be rounded
    return F.element_at(powers, (F.when(bits <= 64, 64 - bits).otherwise(128 - bits) + 1).cast("int"))


def _block_start(digits: Column, bits: Column) -> Column:
    """Hex digits of the first address of the block of `bits` bits around an address."""
    (high, low), size, zero = _halves(digits), _size(bits), F.lit(0).cast("decimal(20,0)")
    return _digits(F.when(bits <= 64, high - high % size).otherwise(high), F.when(bits <= 64, zero).otherwise(low - low % size))


def _block_next(start: Column, bits: Column) -> Column:
    """Hex digits of the first address behind a block, null behind the last address."""
    (high, low), size, zero = _halves(start), _size(bits), F.lit(0).cast("decimal(20,0)")
    full = F.lit(str(1 << 64)).cast("decimal(20,0)")
    carry = F.when(low + size == full, 1).otherwise(0)
    up = F.when(bits <= 64, high + size).otherwise(high + carry)
    return F.when(up < full, _digits(up.cast("decimal(20,0)"), F.when((bits <= 64) | (carry == 1), zero).otherwise((low + size).cast("decimal(20,0)"))))


def _networks(table: DataFrame, fields: list[str], order: str | None) -> DataFrame:
    """(_family, _start, _bits, _level, _order, fields) of the valid networks of column `cidr`; host bits are cleared."""
    key = _address_key(F.split_part("cidr", F.lit("/"), F.lit(1)))
    bits = F.split_part("cidr", F.lit("/"), F.lit(2)).try_cast("int")
    nets = (table.select(key.alias("_key"), bits.alias("_bits"), (F.col(order) if order else F.lit(0)).alias("_order"), *fields)
            .withColumn("_family", F.left("_key", F.lit(1)))
            .where((F.col("_bits") >= 0) & (F.col("_bits") <= F.when(F.col("_family") == "4", 32).otherwise(128))))
    level = F.lit(len(LEVELS) - 1)
    for k in range(len(LEVELS) - 2, -1, -1):
        level = F.when(F.col("_bits") <= LEVELS[k][0], k).otherwise(level)
    return (nets.withColumn("_start", _block_start(F.substring("_key", 2, 32), F.col("_bits")))
            .select("_family", "_start", "_bits", level.alias("_level"), "_order", *fields))


def prefix_index(table: DataFrame, fields: list[str], best: Column, order: str | None = None) -> DataFrame:
    """Nested networks as disjoint, sorted ranges: (level, bucket, ranges) with ranges array<struct<key, hit>>.

    A range reaches from its key to the next one; `hit` is what `best`, an aggregate over `fields`, `_bits` and
    `_order`, picks among the networks that hold it, null where there is none. A level knows the networks up to its
    bits, so an address is settled by the deepest level that has its bucket. A bucket of the first four levels has
    at most 2 * 65,536 ranges, one of the last as many as networks within one /64 are listed.
    """
    nets = _networks(table, fields, order)
    digits = F.element_at(F.array(*[F.lit(w) for _, w in LEVELS]), F.col("_level") + 1)

    def bucket(key):
        return F.concat("_family", F.left(key, digits))

    start, bits = F.col("_start"), F.col("_bits")
    # blocks wider than a bucket of the first level lie in several of them
    wide = F.pow(F.lit(2), 8 - bits).cast("int")
    first = F.conv(F.left(start, F.lit(2)), 16, 10).cast("int")
    over = F.transform(F.sequence(F.lit(0), wide - 1), lambda i: F.rpad(F.lpad(F.lower(F.hex((first + i).cast("long"))), 2, "0"), 32, "0"))
    after = _block_next(start, bits)
    inside = F.when(F.left(after, digits) == F.left(start, digits), after)
    own = F.array_compact(F.array(F.rpad(F.left(start, digits), 32, "0"), start, inside))
    points = (nets.select("_family", "_level", F.explode(F.when(bits < 8, over).otherwise(own)).alias("_key"))
              .withColumn("_bucket", bucket(F.col("_key"))).distinct())
    # at most 33 + 129 rows
    lengths = F.broadcast(nets.select(F.col("_family").alias("_f"), F.col("_bits").alias("_b")).distinct())
    most = F.element_at(F.array(*[F.lit(n) for n, _ in LEVELS]), F.col("_level") + 1)
    probes = points.join(lengths, (F.col("_family") == F.col("_f")) & (F.col("_b") <= most)).withColumn("_at", _block_start(F.col("_key"), F.col("_b")))
    nets = nets.drop("_level").withColumnsRenamed({"_family": "_f", "_bits": "_b"})
    hits = (probes.join(nets.withColumnRenamed("_start", "_at"), ["_f", "_b", "_at"]).withColumnRenamed("_b", "_bits")
            .groupBy("_level", "_bucket", "_key").agg(best.alias("hit")))
    ranges = F.array_sort(F.collect_list(F.struct(F.col("_key").alias("key"), "hit")))
    index = points.join(hits, ["_level", "_bucket", "_key"], "left").groupBy(F.col("_level").alias("level"), F.col("_bucket").alias("bucket"))
    return cut(index.agg(ranges.alias("ranges")))  # a table: made once, and of a size by which Spark joins it


def _at_or_before(ranges: Column, key: Column) -> Column:
    """The hit of the last range that begins at or before `key`, by bisection."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ranges) + 1)).cast("int"))
    low = F.aggregate(
        steps, F.struct(F.lit(1).alias("lo"), F.size(ranges).alias("hi")),
        lambda a, _: F.when(a.lo >= a.hi, a).when(
            F.element_at(ranges, F.floor((a.lo + a.hi + 1) / 2).cast("int"))["key"] <= key,
            F.struct(F.floor((a.lo + a.hi + 1) / 2).cast("int").alias("lo"), a.hi.alias("hi"))).otherwise(
            F.struct(a.lo.alias("lo"), (F.floor((a.lo + a.hi + 1) / 2).cast("int") - 1).alias("hi"))), lambda a: a.lo)
    return F.element_at(ranges, low)["hit"]


def index_lookup(df: DataFrame, ip: str, index: DataFrame, out: str) -> DataFrame:
    """Add the hit of each address as `out`, null without one. Rows are joined to at most one row of the index a level,
    so the number of rows stays and a streaming `df` needs no state."""
    found = F.lit(None).cast(index.schema["ranges"].dataType.elementType["hit"].dataType)
    df = df.withColumn("_key", _address_key(F.col(ip)))
    used = sorted(r[0] for r in index.select("level").distinct().collect())  # five numbers at most
    for k, (_, width) in ((k, LEVELS[k]) for k in used):
        side = index.where(F.col("level") == k).select(F.col("bucket").alias(f"_b{k}"), F.col("ranges").alias(f"_r{k}"))
        df = df.join(side, F.left("_key", F.lit(width + 1)) == F.col(f"_b{k}"), "left")
        mine = _at_or_before(F.col(f"_r{k}"), F.substring("_key", 2, 32))
        found = F.when(F.col(f"_r{k}").isNotNull(), mine).otherwise(found)
    made = [f"_{c}{k}" for c in "br" for k in used]
    return df.withColumn(out, found).drop("_key", *made)


def _hits_of(df: DataFrame, ip: str, index: DataFrame, out: str, how: str) -> DataFrame:
    """`df` with the hit of each address: rows of a stream look it up themselves, a table's distinct addresses once.

    The hits are a table, so its actual size tells Spark whether the rows must be shuffled to meet it.
    """
    if df.isStreaming:
        found = index_lookup(df, ip, index, out)
        return found if how == "left" else found.where(F.col(out).isNotNull())
    addresses = df.select(F.col(ip).alias("_ip")).where(F.col(ip).isNotNull()).distinct()
    hits = cut(index_lookup(addresses, "_ip", index, out).where(F.col(out).isNotNull()).select("_ip", out))
    return df.join(hits, df[ip] == hits["_ip"], how).drop("_ip")


def prefix_match(df: DataFrame, ip: str, table: DataFrame, fields: list[str], out: str,
                 first_by: str | None = None, how: str = "left") -> DataFrame:
    """Join the best containing CIDR of each address as struct `out`; `how`: left, or inner for rows with a hit only.

    Best is the longest prefix, or the smallest `first_by` where given.
    """
    rank = F.struct(F.col("_order"), (-F.col("_bits")).alias("b"))
    index = prefix_index(table, fields, F.min_by(F.struct(*fields), rank), first_by)
    return _hits_of(df, ip, index, out, how)


_FACTS = {"country": "", "country_name": "", "asn": 0, "org": ""}


def facts_index(prefixes: DataFrame) -> DataFrame:
    """Index of country and network, each from the longest prefix that names one."""
    longest = -F.col("_bits")
    named = F.when(F.coalesce("country", F.lit("")) != "", longest)
    best = F.struct(F.min_by(F.struct("country", "country_name"), named).alias("c"),
                    F.min_by(F.struct("asn", "org"), F.when(F.col("asn").isNotNull(), longest)).alias("a"))
    return prefix_index(prefixes, list(_FACTS), best)


def _facts(hit: Column) -> dict[str, Column]:
    return {c: F.coalesce(hit["c" if c.startswith("country") else "a"][c].cast("bigint" if c == "asn" else "string"), F.lit(d))
            for c, d in _FACTS.items()}


def prefix_facts(addresses: DataFrame, ip: str, prefixes: DataFrame) -> DataFrame:
    """Country and network of distinct addresses, each from the longest prefix that names one.

    Unknown countries are empty, unknown AS numbers 0. Addresses without any prefix drop out.
    """
    hits = index_lookup(addresses.select(F.col(ip)), ip, facts_index(prefixes), "_hit").where("_hit is not null")
    return hits.select(ip, *(v.alias(c) for c, v in _facts(F.col("_hit")).items()))


def _with_facts(df: DataFrame, ip: str, prefixes: DataFrame, wanted: list[str]) -> DataFrame:
    found = _hits_of(df, ip, facts_index(prefixes), "_hit", "left")
    return found.withColumns({c: v for c, v in _facts(F.col("_hit")).items() if c in wanted}).drop("_hit")


def geo_lookup(df: DataFrame, ip: str, prefixes: DataFrame) -> DataFrame:
    """Add `country` and `country_name` of the longest matching prefix; empty when unknown."""
    return _with_facts(df, ip, prefixes, ["country", "country_name"])


def asn_lookup(df: DataFrame, ip: str, prefixes: DataFrame) -> DataFrame:
    """Add `asn` (0 when unknown) and `org` of the longest matching prefix."""
    return _with_facts(df, ip, prefixes, ["asn", "org"])


_HIT = ["value", "kind", "source", "category"]
FEW = 100_000  # listed domains that are broadcast to the rows of a table


def match_ip(df: DataFrame, ip: str, indicators: DataFrame, out: str = "hit", how: str = "left") -> DataFrame:
    """Struct of the matching indicator: the exact address, else the first CIDR in feed order.

    `how`: left, or inner for rows with a hit only. A streaming `df` is joined row by row, without state.
    """
    exact = indicators.where("kind = 'ip'").select(
        F.col("value").alias("_v"), F.struct(*_HIT).alias("_exact"))
    nets = indicators.where("kind = 'cidr'").withColumn("cidr", F.col("value"))
    rank = F.struct(F.col("_order"), (-F.col("_bits")).alias("b"))
    index = prefix_index(nets, _HIT, F.min_by(F.struct(*_HIT), rank), "feed_order")

    def resolved(rows: DataFrame, address: str) -> DataFrame:
        rows = index_lookup(rows.join(exact, rows[address] == exact["_v"], "left"), address, index, "_net")
        return rows.withColumn(out, F.coalesce("_exact", "_net")).drop("_v", "_exact", "_net")

    if df.isStreaming:
        found = resolved(df, ip)
        return found if how == "left" else found.where(F.col(out).isNotNull())
    addresses = df.select(F.col(ip).alias("_ip")).where(F.col(ip).isNotNull()).distinct()
    hits = cut(resolved(addresses, "_ip").where(F.col(out).isNotNull()).select("_ip", out))
    return df.join(hits, df[ip] == hits["_ip"], how).drop("_ip")


def match_domain(df: DataFrame, name: str, indicators: DataFrame, out: str = "hit", how: str = "left") -> DataFrame:
    """Struct of the most specific listed domain among the name and its parents; `how` as in `match_ip`.

    Rows are joined once per number of labels that listed domains have, and the most specific hit is picked inside the
    row: those of a stream, which cannot pick the best of several rows without state, and those of a table while so few
    domains are listed that they can be broadcast. Beyond, the distinct names of a table look their parents up.
    """
    listed = indicators.where("kind = 'domain'").select(
        F.lower("value").alias("_suffix"), F.struct(*_HIT).alias("_hit"))
    if not df.isStreaming:
        listed = cut(listed.groupBy("_suffix").agg(F.min("_hit").alias("_hit")).where(F.contains("_suffix", F.lit("."))))
        few = listed.count() <= FEW
    if df.isStreaming or few:
        labels = F.size(F.split("_suffix", r"\."))
        depths = sorted(r[0] for r in listed.select(labels).where(labels > 1).distinct().collect())  # at most 127 numbers
        best, rows = F.lit(None), df.withColumn("_parents", domain_suffixes(F.col(name)))
        for n in depths:
            side = listed.where(labels == n).select(F.col("_suffix").alias(f"_s{n}"), F.col("_hit").alias(f"_h{n}"))
            side = side if df.isStreaming else F.broadcast(side)
            mine = F.when(F.size("_parents") >= n - 1, F.expr(f"try_element_at(_parents, -{n - 1})"))
            rows = rows.join(side, mine == F.col(f"_s{n}"), "left")
            best = F.coalesce(F.col(f"_h{n}"), best)
        found = rows.withColumn(out, best).drop("_parents", *(f"_{c}{n}" for c in "sh" for n in depths))
        return found if how == "left" else found.where(F.col(out).isNotNull())
    probes = (df.select(F.col(name).alias("_name")).where(F.col(name).isNotNull()).distinct()
              .select("_name", F.posexplode(domain_suffixes(F.col("_name"))).alias("_pos", "_suffix")))
    hits = cut(probes.join(listed, "_suffix").groupBy("_name").agg(F.min_by("_hit", "_pos").alias(out)))
    return df.join(hits, df[name] == hits["_name"], how).drop("_name")


def with_hostname(df: DataFrame, devices: DataFrame | None, ip: str, out: str = "hostname") -> DataFrame:
    """Hostname of a device by address; empty when unknown."""
    if devices is None:
        return df.withColumn(out, F.lit(""))
    names = devices.select(F.col("ip").alias("_ip"), F.col("hostname").alias("_host"))
    return (df.join(names, df[ip] == names["_ip"], "left")
            .withColumn(out, F.coalesce("_host", F.lit(""))).drop("_ip", "_host"))


def not_allowed(c: Column, allowed) -> Column:
    """True unless the value is allowlisted."""
    return ~c.isin(list(allowed)) if allowed else F.lit(True)
