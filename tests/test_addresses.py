"""Addresses and networks in Spark expressions against the standard library."""

from __future__ import annotations

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from emberlog.functions import ip
from emberlog.operators import networks


def _texts(n, seed):
    """Ways to write addresses, right and wrong ones, with many zeros."""
    rng, out = random.Random(seed), []
    group = lambda: rng.choice(["0", "0", "0", "00", "0000", "1", "db8", "0DB8", "ffff", "FFFF", "fe80", f"{rng.randrange(65536):x}"])
    v4 = lambda: ".".join(str(rng.choice([0, 1, 9, 10, 192, 255, 256, rng.randrange(256)])) for _ in range(rng.choice([4, 4, 4, 4, 4, 3])))
    for _ in range(n):
        groups = [group() for _ in range(rng.choice([8, 8, 8, 7, 6, 5, 4, 3, 2, 1, 9]))]
        if rng.random() < 0.5:
            groups.insert(rng.randrange(len(groups) + 1), "")
        text = ":".join(groups)
        if rng.random() < 0.5:
            text = text.replace("::", ":") if rng.random() < 0.1 else (":" + text if text.startswith(":") else text + ":" if text.endswith(":") else text)
        kind = rng.random()
        if kind < 0.12:
            text = rng.choice(["::ffff:", "::FFFF:0:", "0:0:0:0:0:ffff:", "1::", "::", "1:2:3:4:5:6:", "1:2:3:4:5:6:7:"]) + v4()
        elif kind < 0.2:
            text = v4()
        elif kind < 0.24:
            text += rng.choice(["%eth0", "%", "%a%b", "%1"])
        elif kind < 0.28:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["g", ":", ".", " ", "0", "::"]) + text[at:]
        out.append(text)
    return out


def test_normalized_addresses_equal_the_standard_library(spark):
    texts = list(dict.fromkeys([*_texts(100_000, 1), "", ":", "::", ":::", "::1", "1::", "0::0", "fe80::1%eth0", "::ffff:1.2.3.4%x", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "12345::", "1.2.3.4:", "::1.2.3.04"]))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", "t", ip._address(F.col("t")).alias("a"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    wrong = [(r["t"], r["a"], ip.canonical(r["t"])) for r in rows.collect() if r["a"] != ip.canonical(r["t"])]
    assert not wrong and sum(ip.canonical(t) is not None for t in texts) > 20_000


def test_addresses_with_blanks_and_brackets_and_in_lines(spark):
    rows = spark.createDataFrame([(" [2001:DB8::0:1]\n", "at 10:20:30 from ::1. and [fe80::A]:22, 1.2.3.4.5, 192.0.2.7: ::ffff:192.0.2.9 abc::d::e"), (None, None)], "a string, b string")
    got = rows.select(ip.normalize_ip(F.col("a")), ip.normalize_ip(F.col("a"), brackets=False), ip.find_ips(F.col("b"))).collect()
    strip = [t.strip(".:") for t in re.findall(ip.TOKEN, rows.first()["b"])]
    assert tuple(got[0]) == ("2001:db8::1", None, [a for a in map(ip.canonical, strip) if a]) and tuple(got[1]) == (None, None, None)


def test_digits_of_addresses(spark):
    own = ["192.0.2.7", "0.0.0.0", "::", "2001:db8::1:0:0:5", "fe80::1%eth0", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"]
    got = [r[0] for r in spark.createDataFrame([(a,) for a in own], "a string").select(ip.address_digits(F.col("a"))).collect()]
    assert got == [f"{int(ipaddress.ip_address(a.split('%')[0])):0{32 if ':' in a else 8}x}" for a in own]


@pytest.mark.parametrize("most", [0, 500_000])
def test_longest_networks_equal_a_search(spark, monkeypatch, most):
    """Nested, repeated and oddly written networks of both versions; by broadcast and by a shuffle."""
    monkeypatch.setattr(networks, "MOST_BROADCAST", most)
    rng = random.Random(8)
    nets = [f"10.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}/{rng.choice([8, 14, 16, 20, 24, 31, 32])}" for _ in range(300)]
    nets += [f"2001:db8:{rng.randrange(4):x}::{rng.randrange(9)}/{rng.choice([32, 46, 48, 64, 127, 128])}" for _ in range(100)] + ["10.1.2.3", "2001:DB8:0::5", nets[0], "::/0"]
    ips = [f"10.{rng.randrange(5)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(400)] + [f"2001:db8:{rng.randrange(5):x}::{rng.randrange(12):x}" for _ in range(100)] + ["11.0.0.1", "::1", None]
    rows = spark.createDataFrame([(k, a) for k, a in enumerate(ips)], "k int, ip string")
    found = networks.label_networks(rows, spark.createDataFrame([(n,) for n in nets], "network string"))
    parsed = [ipaddress.ip_network(n, strict=False) for n in nets]
    for r in found.collect():
        inside = [n for n in parsed if r["ip"] and ipaddress.ip_address(r["ip"]) in n]
        assert (r["network"] and ipaddress.ip_network(r["network"], strict=False)) == max(inside, key=lambda n: n.prefixlen, default=None), r
    assert found.count() == len(ips)
    for bad in ("10.0.0.0/33", "10.0.0.0/x", "x/8", "1.2.3.4/8/8", "::/129", None):
        with pytest.raises(Exception, match="no network"):
            networks.network_index(spark.createDataFrame([(bad,)], "network string"))


def test_fifty_thousand_networks(spark):
    nets = spark.range(50_000).select(F.concat(F.lit("10."), F.floor(F.col("id") / 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string"), F.lit(".0/24")).alias("network"))
    rows = spark.createDataFrame([("10.0.5.9",), ("10.195.79.1",), ("10.195.80.1",)], "ip string")
    found = networks.label_networks(rows, nets)
    assert sorted((r["ip"], r["network"]) for r in found.collect()) == [("10.0.5.9", "10.0.5.0/24"), ("10.195.79.1", "10.195.79.0/24"), ("10.195.80.1", None)]
    assert len(found._jdf.queryExecution().executedPlan().toString()) < 20_000
