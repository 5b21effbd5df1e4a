"""Addresses and the networks of a table that they lie in: the longest prefix by hash joins.

A network is one row, its leading bits. An address is looked up once for each length that networks of its version have,
33 and 129 at most; so neither the plan nor the work of an address grows with the number of networks, and no network is
compared with an address by its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.ip import address_bits, address_digits, find_ips, network_prefix
from emberlog.scratch import scratch, stored

#: Networks, or labelled addresses, that are broadcast at most; with more, both sides are joined by a shuffle.
MOST_BROADCAST = 500_000


def network_index(networks: DataFrame, network: str = "network") -> DataFrame:
    """(prefix, network) of a text column of networks, such as 192.0.2.0/24, 2001:db8::/32 or 192.0.2.7; stored.

    Host bits don't count; of several ways to write a network the first in order stands for all. A text that is no
    network, or null, raises an error.
    """
    prefix, text = network_prefix(F.col(f"`{network}`")), F.col(f"`{network}`")
    checked = networks.select(text.alias("network"), F.coalesce(prefix, F.raise_error(F.concat(F.lit("no network: "), F.coalesce(text, F.lit("null")))).cast("string")).alias("prefix"))
    return stored(checked.groupBy("prefix").agg(F.min("network").alias("network")), f"{scratch(networks.sparkSession, 'networks')}/index")


def longest_networks(addresses: DataFrame, index: DataFrame, ip: str = "ip") -> DataFrame:
    """(ip, network, length): each distinct canonical address of a column that lies in a network of the index, and the longest such network.

    Texts that are no addresses, and nulls, lie in none. IPv4 and IPv6 never mix.
    """
    lengths = [(r["v"], r["n"]) for r in index.select(F.left("prefix", F.lit(1)).alias("v"), (F.char_length("prefix") - 2).alias("n")).distinct().collect()]  # 162 at most
    of = lambda v: F.array(*[F.lit(n) for n in sorted(n for w, n in lengths if w == v)]).cast("array<int>")
    v6 = F.contains("ip", F.lit(":"))
    known = addresses.select(F.col(f"`{ip}`").alias("ip")).where("ip is not null").distinct()
    tried = known.select("ip", address_bits(address_digits(F.col("ip"))).alias("bits"), F.when(v6, "6:").otherwise("4:").alias("version"), F.explode(F.when(v6, of("6")).otherwise(of("4"))).alias("length"))
    tried = tried.select("ip", "length", F.concat("version", F.left("bits", F.col("length"))).alias("prefix"))
    side = F.broadcast(index) if index.count() <= MOST_BROADCAST else index
    best = tried.join(side, "prefix").groupBy("ip").agg(F.max(F.struct("length", "network")).alias("best"))
    return best.select("ip", "best.network", "best.length")


def label_networks(rows: DataFrame, networks: DataFrame, ip: str = "ip", network: str = "network", name: str = "network") -> DataFrame:
    """rows with `name`, the longest of the table's networks that the address in column `ip` lies in; null if there is none.

    Each distinct address is looked up once; an address of very many rows is joined by broadcast with up to
    MOST_BROADCAST labelled addresses, beyond that in a join whose large partitions Spark splits.
    """
    found = stored(longest_networks(rows, network_index(networks, network), ip).select(F.col("ip").alias("_labelled"), F.col("network").alias("_label")), f"{scratch(rows.sparkSession, 'networks')}/found")
    side = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
    out = rows.join(side, F.col(f"`{ip}`") == F.col("_labelled"), "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != name], F.col("_label").alias(name))


def addresses_in_networks(lines: DataFrame, networks: DataFrame, network: str = "network") -> DataFrame:
    """(source, line_no, ip, network): each address in lines (source, line_no, text) that lies in one of the table's networks, with the longest such network."""
    each = lines.select("source", "line_no", F.explode(find_ips(F.col("text"))).alias("ip")).distinct()
    return label_networks(each, networks, network=network).where("network is not null")
